"""File kinds, source kinds, versions, normalized sources and module names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from modcensus.fixed import TERRAFORM, TERRAGRUNT
from modcensus.functions.text import first_group, strip_space


def file_type(path: Column) -> Column:
    """``terraform``, ``terragrunt`` or NULL, from the path alone (case-sensitive)."""
    base = F.substring_index(path, "/", -1)
    is_terraform = path.endswith(".tf") | path.endswith(".tfvars") | (base == ".terraform.lock.hcl")
    is_terragrunt = path.endswith(".hcl") & ~base.contains(".terraform.lock")
    return F.when(is_terraform, TERRAFORM).when(is_terragrunt, TERRAGRUNT)


def source_type(source: Column) -> Column:
    """Kind of a module source; the first rule that holds decides."""
    is_archive = source.endswith(".tar.gz") | source.endswith(".zip")
    return (
        F.when(source.startswith("./") | source.startswith("../") | source.startswith("/"), "local")
        .when(source.contains("jfrog.io") & ~is_archive, "artifactory")
        .when(is_archive, "archive")
        .when(
            source.contains("terraform-aws-modules")
            | source.contains(".terraform.io")
            | source.rlike(r"\A[^/]+/[^/]+/[^/]+"),
            "registry",
        )
        .when(
            source.contains("git::") | source.contains("github.com") | source.contains("gitlab.com"),
            "git",
        )
        .otherwise("unknown")
    )


def call_version(source: Column, attribute: Column | None = None) -> Column:
    """Version attribute if set, else the ``version`` parameter, else the ``ref`` parameter."""
    in_source = F.when(
        source.contains("="),
        F.coalesce(first_group(source, "[?&]version=([^&]+)"), first_group(source, "[?&]ref=([^&]+)")),
    )
    return in_source if attribute is None else F.coalesce(attribute, in_source)


def normalize_source(source: Column) -> Column:
    """Source without its ``ref`` and ``version`` parameters.

    For each parameter: the first leading one followed by another parameter gives
    way to it, a leading one at the end goes, and so do all later ones. At last a
    trailing run of ``?`` and ``&`` goes.
    """
    text = source
    for parameter in ("ref", "version"):
        text = F.regexp_replace(text, rf"(?s)\A(.*?)\?{parameter}=[^&]*&", "$1?")
        text = F.regexp_replace(text, rf"\?{parameter}=[^&]*\z|&{parameter}=[^&]*", "")
    return F.regexp_replace(text, r"[?&]+\z", "")


def _without_suffix(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\.(git|tar\.gz|zip)\z", "")


def terragrunt_name(path: Column, source: Column) -> Column:
    """Name of a Terragrunt call: its directory, else the last meaningful part of its source."""
    directory = first_group(path, r"([^/]+)/terragrunt\.hcl\z")

    address = F.substring_index(source, "?", 1)
    tail = F.substring_index(address, "//", -1)
    head = F.left(address, F.length(address) - F.length(tail) - 2)
    inner = F.filter(F.split(tail, "/"), lambda part: strip_space(part) != "")
    outer = F.substring_index(head, "/", -1)
    after_double_slash = F.when(F.size(inner) > 0, _without_suffix(F.element_at(inner, -1))).otherwise(
        F.coalesce(F.nullif(_without_suffix(outer), F.lit("")), F.lit("unknown"))
    )

    last = F.substring_index(address, "/", -1)
    plain = F.when(strip_space(last) == "", "unknown").otherwise(
        F.coalesce(F.nullif(_without_suffix(last), F.lit("")), F.lit("unknown"))
    )
    return F.coalesce(directory, F.when(address.contains("//"), after_double_slash).otherwise(plain))
