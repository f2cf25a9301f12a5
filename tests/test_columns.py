"""Column functions against written-out results."""

from pyspark.sql import functions as F

from modcensus.functions.classify import (
    call_version,
    file_type,
    normalize_source,
    source_type,
    terragrunt_name,
)
from modcensus.functions.links import blob_url, platform_name, scope_text, target_text
from modcensus.functions.text import in_locale_order, newlines, strip_space


def check(column_values, function, table):
    got = column_values(function, [key if isinstance(key, tuple) else (key,) for key, _ in table])
    assert dict(zip([k for k, _ in table], got)) == dict(table)


def test_file_type(column_values):
    check(
        column_values,
        file_type,
        [
            ("main.tf", "terraform"),
            ("a/b/prod.tfvars", "terraform"),
            ("a/.terraform.lock.hcl", "terraform"),
            (".terraform.lock.hcl", "terraform"),
            ("terragrunt.hcl", "terragrunt"),
            ("live/eu/terragrunt.hcl", "terragrunt"),
            ("live/common.hcl", "terragrunt"),
            ("x.terraform.lock.hcl", None),
            ("a.terraform.lock/b.hcl", "terragrunt"),
            ("main.tf.json", None),
            ("MAIN.TF", None),
            ("README.md", None),
            ("tf", None),
            (".tf", "terraform"),
            ("", None),
        ],
    )


def test_source_type_first_rule_wins(column_values):
    check(
        column_values,
        source_type,
        [
            ("./net", "local"),
            ("../net", "local"),
            ("/srv/net", "local"),
            ("/srv/net.zip", "local"),
            ("https://acme.jfrog.io/tf/net", "artifactory"),
            ("https://acme.jfrog.io/tf/net.zip", "archive"),
            ("https://acme.jfrog.io/tf/net.zip?ref=1", "artifactory"),
            ("https://dl.acme.io/net.tar.gz", "archive"),
            ("https://dl.acme.io/net.zip?ref=1", "unknown"),
            ("acme/net/aws", "registry"),
            ("acme/net/aws//sub", "registry"),
            ("app.terraform.io/acme/net/aws", "registry"),
            ("tfr:///terraform-aws-modules/net/aws", "registry"),
            ("tfr:///foo/bar/aws", "unknown"),
            ("github.com/acme/net", "registry"),
            ("git::git@ssh.dev.azure.com:v3/o/p/m", "registry"),
            ("git::https://git.acme.io/net.git", "git"),
            ("https://github.com/acme/net", "git"),
            ("git@gitlab.com:acme/net.git", "git"),
            ("acme/net", "unknown"),
            ("net", "unknown"),
            ("a//b/c", "unknown"),
        ],
    )


def test_call_version(column_values):
    check(
        column_values,
        call_version,
        [
            (("a?ref=v1", "2.0"), "2.0"),
            (("a?ref=v1", None), "v1"),
            (("a?version=3&ref=v1", None), "3"),
            (("a?ref=v1&version=3", None), "3"),
            (("a?depth=1&ref=v1", None), "v1"),
            (("a?ref=", None), None),
            (("a?ref=&ref=v2", None), "v2"),
            (("a?href=v1", None), None),
            (("a", None), None),
            (("a?ref=tags/0.4.0", None), "tags/0.4.0"),
        ],
    )


def test_normalize_source(column_values):
    check(
        column_values,
        normalize_source,
        [
            ("a/b/c", "a/b/c"),
            ("a?ref=v1", "a"),
            ("a?ref=v1&depth=1", "a?depth=1"),
            ("a?depth=1&ref=v1", "a?depth=1"),
            ("a?depth=1&ref=v1&x=2", "a?depth=1&x=2"),
            ("a?version=1", "a"),
            ("a?version=1&ref=2&a=1", "a?a=1"),
            ("a?ref=1&version=2", "a"),
            ("a?&", "a"),
            ("a?ref=", "a"),
            ("a?x=1&ref=1&ref=2", "a?x=1"),
            ("a?ref=1&b?ref=2&c", "a?b?ref=2&c"),
            ("a?preference=1", "a?preference=1"),
            ("a?ref=x\ny", "a"),
        ],
    )


def test_terragrunt_name(column_values):
    check(
        column_values,
        terragrunt_name,
        [
            (("live/eu/vpc/terragrunt.hcl", "x"), "vpc"),
            (("vpc/terragrunt.hcl", "x"), "vpc"),
            (("terragrunt.hcl", "git::https://h/a/b.git//net/vpc?ref=1"), "vpc"),
            (("a.hcl", "git::https://h/a/b.git//?ref=1"), "b"),
            (("a.hcl", "https://h/repo.git"), "repo"),
            (("a.hcl", "git::https://h/a/b.git//net/"), "net"),
            (("a.hcl", "a///"), "unknown"),
            (("a.hcl", "x//.git"), ""),
            (("a.hcl", "../modules/db"), "db"),
            (("a.hcl", "../modules/db.tar.gz"), "db"),
            (("a.hcl", "../modules/db.git.zip"), "db.git"),
            (("a.hcl", "a/b/"), "unknown"),
            (("a.hcl", ".git"), "unknown"),
            (("a.hcl", "net"), "net"),
            (("a.hcl", "x// / "), "x"),
            (("vpc/terragrunt.hcl.bak", "net"), "net"),
        ],
    )


def test_text_helpers(column_values):
    check(column_values, newlines, [("", 0), ("a", 0), ("a\n", 1), ("\r\n\n\r", 2), ("é\né", 1)])
    check(
        column_values,
        strip_space,
        [("\u00a0\ufeff a b\t\n", "a b"), ("a", "a"), (" \u2003 ", ""), ("", "")],
    )


def test_links(column_values):
    check(
        column_values,
        blob_url,
        [
            (("github", "https://ghe.acme.io/a/b", "a/b", "main", "x y.tf"), "https://github.com/a/b/blob/main/x y.tf"),
            (("gitlab", "https://gl.acme.io/a/b", "a/b", "dev", "x.tf"), "https://gl.acme.io/a/b/-/blob/dev/x.tf"),
        ],
    )
    check(
        column_values,
        platform_name,
        [
            ("github", "GitHub"),
            ("github-self-hosted", "GitHub Self-Hosted"),
            ("gitlab", "GitLab"),
            ("gitlab-self-hosted", "GitLab Self-Hosted"),
            ("bitbucket", "Bitbucket"),
            ("bitbucket-self-hosted", "Bitbucket Self-Hosted"),
            ("local", "Local Filesystem"),
            ("other", "other"),
        ],
    )
    check(column_values, target_text, [(("a", "b/c"), "a/b/c"), (("a", None), "a"), (("a", ""), "a")])
    check(
        column_values,
        scope_text,
        [
            (("local", "/srv/iac", None), "Local directory: iac"),
            (("local", "/srv/iac/", None), "Local directory: iac"),
            (("github", "acme", "net"), "Single repository: net"),
            (("github", "acme", ""), "All repositories in acme"),
        ],
    )


def test_locale_order(spark):
    words = ["~> 3.0", "B", "a", "b", "A", "../x", "./x", ">= 1", "v1.0", "é", "f", "e", "1.10", "1.9", "_x", "-x"]
    frame = spark.createDataFrame([(w,) for w in words], "w STRING")
    got = [r.w for r in frame.orderBy(in_locale_order(F.col("w"))).collect()]
    assert got == ["_x", "-x", "../x", "./x", ">= 1", "~> 3.0", "1.10", "1.9", "a", "A", "b", "B", "e", "é", "f", "v1.0"]
