"""Scan targets: ``platform:owner[/repository]``, ``platform://host/owner[/repository]``, ``local:path``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.fixed import (
    BAD_IDENTIFIER,
    BAD_IDENTIFIER_FORM,
    BAD_REPOSITORY,
    BAD_URL,
    BAD_URL_FORMAT,
    GITHUB,
    GITHUB_SELF_HOSTED,
    GITLAB,
    GITLAB_SELF_HOSTED,
    LOCAL,
    NO_IDENTIFIER,
    NO_PLATFORM,
    NO_TARGET,
    PLATFORM_ALIASES,
    SCANNABLE_PLATFORMS,
    UNSUPPORTED_PLATFORM,
    URL_WITHOUT_OWNER,
)
from modcensus.functions.links import platform_name, scope_text, target_text
from modcensus.functions.text import filled, looked_up
from modcensus.runtime import evaluated

# characters that a web address path, or a host, writes as %XX
_ESCAPED_IN_PATH = r"""[^!-~]|["<>`{}]"""
_ESCAPED_IN_HOST = r"[^ -~]"
_BAD_IN_HOST = r"[\x00\t\n\r #/:<>?@\[\\\]^|]"


def _platform(alias: Column) -> Column:
    return looked_up(alias, PLATFORM_ALIASES)


def _unsupported(alias: Column) -> Column:
    return filled(UNSUPPORTED_PLATFORM, alias, F.lit(", ".join(PLATFORM_ALIASES)))


def _escaped(text: Column, pattern: str) -> Column:
    def one(char: Column) -> Column:
        code = F.regexp_replace(F.hex(F.encode(char, "UTF-8")), "(..)", "%$1")
        return F.when(char.rlike(pattern), code).otherwise(char)

    return F.when(text.rlike(pattern), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def _resolved(segments: Column) -> Column:
    """Path segments without '.', and with every '..' taking back the one before it."""
    lower = F.transform(segments, lambda s: F.regexp_replace(s, "(?i)%2e", "."))
    pairs = F.arrays_zip(segments.alias("text"), lower.alias("plain"))
    return F.aggregate(
        pairs,
        F.array().cast("array<string>"),
        lambda seen, s: F.when(s["plain"] == ".", seen)
        .when(s["plain"] == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        .otherwise(F.array_append(seen, s["text"])),
    )


def _url_columns(targets: DataFrame) -> DataFrame:
    text = F.regexp_replace("original_input", r"\A[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]+", "")
    scheme = F.lower(F.regexp_extract(text, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(text, r"\A[^:]*:", ""), r"(?s)[?#].*\z", "")
    rows = targets.withColumn("_scheme", scheme).withColumn("_rest", rest)

    has_host = F.col("_rest").startswith("//")
    authority = F.when(has_host, F.regexp_extract("_rest", r"\A//([^/]*)", 1)).otherwise("")
    path = F.when(has_host, F.regexp_replace("_rest", r"\A//[^/]*", "")).otherwise(F.col("_rest"))
    place = F.substring_index(authority, "@", -1)
    rows = (
        rows.withColumn("_authority", authority)
        .withColumn("_path", path)
        .withColumn("_name", F.regexp_extract(place, r"\A(\[[^\]]*\]|[^:]*)", 1))
        .withColumn("_port", F.regexp_extract(place, r"\A(?:\[[^\]]*\]|[^:]*):(.*)\z", 1))
        .withColumn("_after_name", F.regexp_replace(place, r"\A(?:\[[^\]]*\]|[^:]*)", ""))
    )
    name, port = F.col("_name"), F.col("_port")
    bad = (
        (F.col("_scheme") == "")
        | ((F.col("_after_name") != "") & ~F.col("_after_name").startswith(":"))
        | ((port != "") & ~(port.rlike(r"\A[0-9]+\z") & (F.expr("try_cast(_port AS INT)") <= 65535)))
        | ((name == "") & ((F.col("_after_name") != "") | F.col("_authority").contains("@")))
        | (~name.startswith("[") & name.rlike(_BAD_IN_HOST))
        | ((F.col("_scheme") == "file") & (F.col("_after_name") != ""))
    )
    segments = F.split("_path", "/")
    resolved = F.when(
        F.col("_path").startswith("/"),
        F.transform(_resolved(F.slice(segments, F.lit(2), F.size(segments))), lambda s: _escaped(s, _ESCAPED_IN_PATH)),
    ).otherwise(segments)
    host = F.when((F.col("_scheme") == "file") & (F.lower(name) == "localhost"), "").when(
        F.col("_scheme") == "file", F.lower(name)
    ).otherwise(_escaped(name, _ESCAPED_IN_HOST))
    parsed = evaluated(
        rows,
        _bad_url=F.coalesce(bad, F.lit(True)),
        _url_alias=F.col("_scheme"),
        _url_parts=F.filter(resolved, lambda s: s != ""),
        _url_host=host,
        _url_port=F.expr("try_cast(_port AS INT)").cast("string"),
        _url_platform=_platform(F.col("_scheme")),
    )
    return parsed.drop("_scheme", "_rest", "_authority", "_path", "_name", "_port", "_after_name")


def _local_path(text: Column, base_dir: str) -> Column:
    absolute = text.startswith("/")
    full = F.when(absolute, text).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), text))
    parts = _resolved(F.filter(F.split(full, "/"), lambda s: s != ""))
    plain = F.concat(F.lit("/"), F.array_join(parts, "/"))
    keeps_slash = absolute & text.endswith("/") & (F.size(parts) > 0)
    return F.when(keeps_slash, F.concat(plain, F.lit("/"))).otherwise(plain)


def scan_targets(inputs: DataFrame, base_dir: str = "/") -> DataFrame:
    """Parses ``original_input``; what cannot be parsed carries its ``error`` and no platform.

    Relative local paths are resolved against ``base_dir``.
    """
    text = F.col("original_input")
    rows = _url_columns(inputs)
    rest = F.substr(text, F.instr(text, ":") + 1)
    rows = evaluated(
        rows,
        _is_url=F.coalesce(text.contains("://"), F.lit(False)),
        _alias=F.lower(F.substring_index(text, ":", 1)),
        _remainder=rest,
        _parts=F.split(rest, "/"),
        _platform=_platform(F.lower(F.substring_index(text, ":", 1))),
    )

    # web address form
    base = F.col("_url_platform")
    host_name = F.col("_url_host")
    url_platform = (
        F.when((base == GITLAB) & (host_name != "gitlab.com"), GITLAB_SELF_HOSTED)
        .when((base == GITHUB) & (host_name != "github.com"), GITHUB_SELF_HOSTED)
        .otherwise(base)
    )
    url_problem = (
        F.when(F.col("_bad_url"), BAD_URL)
        .when(base.isNull(), _unsupported(F.col("_url_alias")))
        .when(F.size("_url_parts") == 0, URL_WITHOUT_OWNER)
    )
    url_error = filled(BAD_URL_FORMAT, text, url_problem)
    url_parts = F.col("_url_parts")
    url_repository = F.when(
        F.size(url_parts) > 1, F.array_join(F.slice(url_parts, F.lit(2), F.size(url_parts)), "/")
    )
    port = F.coalesce(F.concat(F.lit(":"), F.col("_url_port")), F.lit(""))

    # short form
    platform = F.col("_platform")
    first = F.col("_parts")[0]
    repository = F.when(
        F.size("_parts") > 1, F.array_join(F.slice("_parts", F.lit(2), F.size("_parts")), "/")
    )
    vcs_error = (
        F.when(first == "", filled(BAD_IDENTIFIER_FORM, platform, F.col("_remainder")))
        .when(~first.rlike(r"\A[a-zA-Z0-9._-]+\z"), filled(BAD_IDENTIFIER, platform, first))
        .when(
            (repository != "") & ~repository.rlike(r"\A[a-zA-Z0-9._/-]+\z"),
            filled(BAD_REPOSITORY, platform, repository),
        )
    )
    short_error = (
        F.when(~text.contains(":"), filled(NO_PLATFORM, text))
        .when(F.col("_remainder") == "", filled(NO_IDENTIFIER, F.col("_alias")))
        .when(platform.isNull(), _unsupported(F.col("_alias")))
        .when(platform != LOCAL, vcs_error)
    )

    is_url = F.col("_is_url")
    error = F.when(text.isNull() | (text == ""), NO_TARGET).when(
        is_url, url_error
    ).otherwise(short_error)
    rows = evaluated(rows, error=error)

    def if_parsed(value: Column) -> Column:
        return F.when(F.col("error").isNull(), value)

    is_local = ~is_url & (platform == LOCAL)
    parsed = evaluated(
        rows,
        platform=if_parsed(F.when(is_url, url_platform).otherwise(platform)),
        identifier=if_parsed(
            F.when(is_url, url_parts[0]).when(is_local, _local_path(F.col("_remainder"), base_dir)).otherwise(first)
        ),
        repository=if_parsed(F.when(is_url, url_repository).when(~is_local, repository)),
        host=if_parsed(F.when(is_url, F.concat(F.lit("https://"), host_name, port))),
    )
    return parsed.select(*inputs.columns, "platform", "identifier", "repository", "host", "error")


def described_targets(targets: DataFrame) -> DataFrame:
    """Adds display name, target and scope for report headers, and whether a scan supports the platform.

    Bitbucket targets parse but cannot be scanned.
    """
    platform, identifier, repository = F.col("platform"), F.col("identifier"), F.col("repository")
    return (
        targets.withColumn("platform_name", platform_name(platform))
        .withColumn("supported", platform.isin(SCANNABLE_PLATFORMS + [LOCAL]))
        .withColumn("target", F.when(platform.isNotNull(), target_text(identifier, repository)))
        .withColumn("scope", F.when(platform.isNotNull(), scope_text(platform, identifier, repository)))
    )
