"""Extraction: hand-made files, and random texts against a plain regular-expression search."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from modcensus.operators.extract import (
    CHUNK,
    call_sources,
    module_calls,
    terraform_calls,
    terragrunt_calls,
    union_calls,
)
from modcensus.schemas import IAC_FILES


def files_of(spark, contents, kind="terraform", path="main.tf"):
    rows = [(kind, f"org/repo{i}", path, text, f"https://h/{i}", None, None) for i, text in enumerate(contents)]
    return spark.createDataFrame(rows, IAC_FILES)


def calls_of(spark, text, kind="terraform", path="main.tf"):
    rows = module_calls(files_of(spark, [text], kind, path)).orderBy("block_pos").collect()
    return [(r.name, r.source, r.source_type, r.version, r.line_number) for r in rows]


def test_two_blocks_with_places(spark):
    text = '\n\n\nmodule "net" {\n  source  = "acme/net/aws"\n  version = "~> 3.0"\n}\n\n# c\n\n\nmodule "db" {\n  source = "./db"\n}\n'
    assert calls_of(spark, text) == [
        ("net", "acme/net/aws", "registry", "~> 3.0", 4),
        ("db", "./db", "local", None, 12),
    ]


TERRAFORM_CASES = [
    ('resource "x" "y" {\n source = "a/b/c"\n}', []),
    ('module "a" {\n version = "1"\n}', []),
    ('module "a" {\n source = ""\n}', []),
    ('module "a"{ source = "x" }', []),
    ('module a { source = "x" }', []),
    ('module "a" { source = "x" }', [("a", "x", "unknown", None, 1)]),
    ('/*\nmodule "a" {\n source = "x"\n}\n*/', [("a", "x", "unknown", None, 2)]),
    ('submodule "a" {\n source = "x"\n}', [("a", "x", "unknown", None, 1)]),
    ('module "a" {\n tags = { b = 1 }\n source = "x"\n}', []),
    ('module "a" {\n source = "x"\n tags = { version = "9" }\n version = "1"\n}', [("a", "x", "unknown", "9", 1)]),
    ('module "a" {\n engine_version = "13"\n version = "1"\n source = "x"\n}', [("a", "x", "unknown", "13", 1)]),
    ('module "a" {\n source = " x "\n}', [("a", " x ", "unknown", None, 1)]),
    ('module "a" {\n source = "x\ny"\n}', [("a", "x\ny", "unknown", None, 1)]),
    ('module\u00a0"a"\ufeff{\nsource\u2003=\u00a0"x"\n}', [("a", "x", "unknown", None, 1)]),
    ('\r\n\r\nmodule "a" {\r\n source = "x?ref=v1"\r\n}', [("a", "x?ref=v1", "unknown", "v1", 3)]),
    ('\r\rmodule "a" { source = "x" }', [("a", "x", "unknown", None, 1)]),
    ('module "source =" {\n source = "x"\n}', [("source =", "x", "unknown", None, 1)]),
    ('module "a" {\n source = "x"\n', []),
    ('module "a" { source = "x" } module "b" { source = "y" }', [("a", "x", "unknown", None, 1), ("b", "y", "unknown", None, 1)]),
    ('terraform {\n source = "x"\n}', []),
    ("", []),
]
TERRAGRUNT_CASES = [
    ('terraform {\n source = "git::https://h/a/b.git//net?ref=v1"\n}', [("net", "git::https://h/a/b.git//net?ref=v1", "git", "v1", 1)]),
    ('terraform{source="x"}', [("x", "x", "unknown", None, 1)]),
    ('terraform {\n source = "  x  "\n version = "1"\n}', [("x", "x", "unknown", None, 1)]),
    ('terraform {\n source = "   "\n}\nterraform {\n source = "y"\n}', [("y", "y", "unknown", None, 4)]),
    ('terraform {\n required_providers {\n  aws = {\n   source = "hashicorp/aws"\n  }\n }\n}', [("aws", "hashicorp/aws", "unknown", None, 1)]),
    ('terraform {\n extra {\n }\n source = "x"\n}', []),
    ('# terraform {\n source = "x"\n}', [("x", "x", "unknown", None, 1)]),
    ('module "a" { source = "x" }', []),
    ('terraform {\n source = "tfr:///example-org/queue/cloud?version=2.9.4"\n}\ninputs = {\n worker_version = "8"\n}', [("cloud", "tfr:///example-org/queue/cloud?version=2.9.4", "unknown", "2.9.4", 1)]),
]


def check_cases(spark, cases, kind, path):
    """All texts in one job, each in a repository of its own."""
    found = {i: [] for i in range(len(cases))}
    for r in module_calls(files_of(spark, [text for text, _ in cases], kind, path)).orderBy("block_pos").collect():
        number = int(r.repository.removeprefix("org/repo"))
        found[number].append((r.name, r.source, r.source_type, r.version, r.line_number))
    assert [(text, found[i]) for i, (text, _) in enumerate(cases)] == cases


def test_terraform_cases(spark):
    check_cases(spark, TERRAFORM_CASES, "terraform", "main.tf")


def test_terragrunt_cases(spark):
    check_cases(spark, TERRAGRUNT_CASES, "terragrunt", "live.hcl")


def test_directory_names_a_terragrunt_call(spark):
    rows = calls_of(spark, 'terraform {\n source = "../m"\n}', "terragrunt", "eu/vpc/terragrunt.hcl")
    assert rows == [("vpc", "../m", "local", None, 1)]


def test_dispatch_by_type(spark):
    both = 'module "a" { source = "x" }\nterraform { source = "y" }\n'
    rows = files_of(spark, [both]).unionByName(files_of(spark, [both, None], "terragrunt", "a.hcl"))
    found = module_calls(rows)
    assert sorted((r.type, r.source, r.line_number) for r in found.collect()) == [
        ("terraform", "x", 1),
        ("terragrunt", "y", 2),
    ]
    parts = union_calls(terraform_calls(rows), terragrunt_calls(rows))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, found.collect()))


def test_many_blocks_cross_chunks(spark):
    count = 2 * CHUNK + 7
    text = "".join(f'# {i}\nmodule "m{i}" {{\n  source = "s{i}"\n}}\n' for i in range(count))
    rows = module_calls(files_of(spark, [text])).collect()
    assert sorted((r.block_pos, r.name, r.line_number) for r in rows) == [
        (i, f"m{i}", 4 * i + 2) for i in range(count)
    ]


def test_comment_line_shifts_every_line(spark):
    text = 'module "a" {\n source = "x"\n}\nmodule "b" {\n source = "y"\n}\n'
    plain = [row[-1] for row in calls_of(spark, text)]
    assert [row[-1] for row in calls_of(spark, "# c\n" + text)] == [line + 1 for line in plain]


SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def searched(text, kind):
    """The same calls by a direct search."""
    if kind == "terraform":
        block = re.compile(rf'module{SPACE}+"([^"]+)"{SPACE}+\{{([\s\S]*?)\}}')
    else:
        block = re.compile(rf"terraform{SPACE}*\{{([\s\S]*?)\}}")
    rows = []
    for position, found in enumerate(block.finditer(text)):
        body = found.group(found.lastindex)
        source = re.search(rf'source{SPACE}*={SPACE}*"([^"]+)"', body)
        if not source:
            continue
        address = source.group(1)
        if kind == "terragrunt":
            address = re.sub(rf"\A{SPACE}+|{SPACE}+\Z", "", address)
        if address:
            rows.append((position, address, text[: found.start()].count("\n") + 1))
    return rows


PIECES = st.sampled_from(
    ['module "a" {', 'module\t"b"\n{', 'module "c"{', "terraform {", "terraform{", "}", "\n", "\r\n", " ", '"', "{",
     'source = "x"', 'source="  y "', 'source = ""', 'version = "1"', "# é\n", "\u00a0", "source", "module", "terraform"]
)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=40).map("".join), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    for kind, path in (("terraform", "a.tf"), ("terragrunt", "a.hcl")):
        rows = files_of(spark, texts, kind, path)
        got = sorted((r.repository, r.block_pos, r.source, r.line_number) for r in module_calls(rows).collect())
        wanted = sorted((f"org/repo{i}", *row) for i, text in enumerate(texts) for row in searched(text, kind))
        assert got == wanted
        assert sorted(r.source for r in call_sources(rows).collect()) == sorted(row[2] for row in wanted)
