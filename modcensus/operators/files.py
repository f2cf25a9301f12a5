"""Files of repository trees: which to take, and their contents."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.fixed import (
    BAD_GITHUB_CONTENT,
    BAD_GITLAB_CONTENT,
    FILE_TYPES,
    GITHUB_PLATFORMS,
    SKIP_DIRECTORIES,
    TERRAFORM,
    TERRAGRUNT,
)
from modcensus.functions.classify import file_type
from modcensus.functions.links import blob_url
from modcensus.operators.joins import join_single, never_broadcast
from modcensus.operators.limits import first_per_group
from modcensus.runtime import evaluated

NO_CONTENT = "No content was landed for this file"
NO_TREE = "No file tree was landed for this repository"
FILE_KEY = ["host", "repository", "path"]


def in_skipped_directory(path: Column) -> Column:
    """True below a directory that local scans leave out: a listed name, or one with a leading dot."""
    names = "|".join(re.escape(name) for name in SKIP_DIRECTORIES)
    return path.rlike(rf"(\A|/)(\.[^/]*|{names})/")


def outside_skipped_directories(rows: DataFrame) -> DataFrame:
    """For local trees only; remote trees are not pruned."""
    return rows.where(~in_skipped_directory(F.col("path")))


def keep_file_types(rows: DataFrame, types: list[str] | None, local: bool = False) -> DataFrame:
    """Remote: no list keeps every path, an empty list none. Local: both keep any IaC file."""
    if local and not types:
        types = FILE_TYPES
    if types is None:
        return rows
    return rows.where(file_type(F.col("path")).isin(types) if types else F.lit(False))


def match_paths(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Unanchored (Java) patterns on the path. Exclusion wins; an empty include list keeps nothing."""
    def any_of(patterns: list[str]) -> Column:
        return reduce(Column.__or__, [F.col("path").rlike(p) for p in patterns], F.lit(False))

    rows = rows.where(~any_of(exclude)) if exclude else rows
    return rows if include is None else rows.where(any_of(include))


def first_files(rows: DataFrame, n: int | None) -> DataFrame:
    """First ``n`` files of every repository in tree order; no limit when ``n`` is None or 0."""
    if not n:
        return rows
    return first_per_group(rows, ["host", "repository"], [F.col("tree_pos")], n, spread=["path"])


def candidate_files(
    tree: DataFrame,
    repositories: DataFrame,
    file_types: list[str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Files of the given repositories whose content a scan needs.

    All tests on the entry come before the join, which spreads a repository with very many
    entries. ``repositories`` has one row per (host, full name), as listings have.
    """
    entries = tree.where((F.col("entry_type") == "blob") & (F.col("path") != ""))
    types = FILE_TYPES if file_types is None else file_types
    entries = match_paths(keep_file_types(entries, types), include, exclude)
    # a flag, so that the join moves hashes only for those who read them
    entries = entries.withColumn("_has_sha", F.coalesce("sha", F.lit("")) != "")
    provider = F.col("provider")
    listed = repositories.select(
        "host", "full_name", "provider", "list_pos", "default_branch", F.col("url").alias("_repository_url")
    )
    rows = (
        join_single(entries, never_broadcast(listed), ["host", "full_name"], "inner", spread=["path"])
        .where(~provider.isin(GITHUB_PLATFORMS) | F.col("_has_sha"))
        .select(
            file_type(F.col("path")).alias("file_type"),
            F.col("full_name").alias("repository"),
            "path",
            blob_url(
                provider, F.col("_repository_url"), F.col("full_name"), F.col("default_branch"), F.col("path")
            ).alias("url"),
            "sha",
            "provider",
            "host",
            "list_pos",
            "tree_pos",
        )
    )
    return first_files(rows, max_files)


def _bytes_of(content: Column) -> Column:
    """Base64 as lenient readers take it: the strict decoder first, the clean-up only if it fails."""
    clean = F.regexp_replace(F.translate(content, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    whole = F.when(F.length(clean) % 4 == 1, F.left(clean, F.length(clean) - 1)).otherwise(clean)
    padded = F.concat(whole, F.repeat(F.lit("="), F.pmod(-F.length(whole), F.lit(4))))
    return F.coalesce(F.try_to_binary(content, F.lit("base64")), F.unbase64(padded))


def decoded_content(provider: Column, encoding: Column, content: Column) -> Column:
    """Text of a landed file; NULL when the response has no shape the provider documents.

    Bytes that are not UTF-8 become U+FFFD. GitLab may also send the text itself.
    """
    text = F.make_valid_utf8(_bytes_of(content).cast("string"))
    is_base64 = encoding.eqNullSafe("base64")
    return F.when(
        provider.isin(GITHUB_PLATFORMS), F.when(is_base64 & content.isNotNull(), text)
    ).otherwise(F.when(is_base64 & (content != ""), text).otherwise(content))


def attach_contents(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """Candidates with ``content``, or with ``error`` where it is missing or malformed.

    One failed file never stops the others. The same path test runs on the contents before
    the join, so that only IaC files are shuffled; the key (host, repository, path) is unique.
    Use ``attach_outcomes`` where the text is not wanted.
    """
    rows = candidates.join(never_broadcast(_landed(contents, F.col("content").alias("_raw"))), FILE_KEY, "left")
    text = decoded_content(F.col("provider"), F.col("encoding"), F.col("_raw"))
    has_text = _has_text(F.col("_raw").isNotNull())
    return _with_error(evaluated(rows, content=F.when(has_text, text)), has_text).drop("encoding", "_raw", "_landed")


def attach_outcomes(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """Candidates with ``error`` only: contents are reduced to flags where they are read.

    Nothing is decoded, and no text crosses the network.
    """
    landed = _landed(contents, F.col("content").isNotNull().alias("_filled"))
    rows = candidates.join(never_broadcast(landed), FILE_KEY, "left")
    return _with_error(rows, _has_text(F.col("_filled"))).drop("encoding", "_filled", "_landed")


def _landed(contents: DataFrame, value: Column) -> DataFrame:
    return contents.where(file_type(F.col("path")).isNotNull()).select(
        "host", F.col("full_name").alias("repository"), "path", "encoding", value, F.lit(True).alias("_landed")
    )


def _has_text(filled: Column) -> Column:
    """Whether a response has a shape that its provider documents: GitHub sends base64 only."""
    return filled & (~F.col("provider").isin(GITHUB_PLATFORMS) | F.col("encoding").eqNullSafe("base64"))


def _with_error(rows: DataFrame, has_text: Column) -> DataFrame:
    bad = F.when(F.col("provider").isin(GITHUB_PLATFORMS), BAD_GITHUB_CONTENT).otherwise(BAD_GITLAB_CONTENT)
    return rows.withColumn("error", F.when(F.col("_landed").isNull(), NO_CONTENT).when(~has_text, bad))


def fetched_files(attached: DataFrame) -> DataFrame:
    """Successful files as the ``iac_files`` table; remote listings carry no size."""
    return attached.where(F.col("error").isNull()).select(
        "file_type", "repository", "path", "content", "url", "sha", F.lit(None).cast("bigint").alias("size")
    )


def fetch_errors(attached: DataFrame) -> DataFrame:
    return attached.where(F.col("error").isNotNull()).select("host", "repository", "path", "provider", "error")


def fetch_counts(attached: DataFrame) -> DataFrame:
    """Successes and failures per repository with any candidate file."""
    return attached.groupBy("host", "repository").agg(
        F.count_if(F.col("error").isNull()).alias("success_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
    )


def landed_trees(tree: DataFrame) -> DataFrame:
    """(host, full_name) of the trees with any entry: a manifest for landings that keep none."""
    return tree.select("host", "full_name").distinct()


def repository_outcomes(repositories: DataFrame, trees: DataFrame, attached: DataFrame) -> DataFrame:
    """A row for each listed repository: did its scan succeed, and how many of its files.

    ``trees`` is the manifest of landed trees, one row or more for each (host, full_name), whether the tree
    has entries or not. A repository that it lacks failed; an empty tree, or one without wanted files, is a
    success with zero files. ``attached`` is what ``attach_contents`` or ``attach_outcomes`` give.
    """
    scanned = trees.select("host", "full_name").distinct().withColumn("_scanned", F.lit(True))
    counts = fetch_counts(attached).withColumnRenamed("repository", "full_name")
    rows = repositories.select("host", "full_name", "provider").join(never_broadcast(scanned), ["host", "full_name"], "left")
    rows = rows.join(never_broadcast(counts), ["host", "full_name"], "left")
    failed = F.col("_scanned").isNull()
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "host",
        F.col("full_name").alias("repository"),
        "provider",
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed, NO_TREE).alias("error"),
        F.coalesce("success_count", zero).alias("success_count"),
        F.coalesce("error_count", zero).alias("error_count"),
    )


def scan_errors(outcomes: DataFrame, attached: DataFrame) -> DataFrame:
    """All failures of a scan in one table: a row for each failed repository (no path) and each failed file."""
    failed = outcomes.where(F.col("status") == "error")
    repositories = failed.select(
        F.lit("repository").alias("kind"), "host", "repository", F.lit(None).cast("string").alias("path"), "provider", "error"
    )
    return repositories.unionByName(fetch_errors(attached).withColumn("kind", F.lit("file")))


def scan_totals(outcomes: DataFrame) -> DataFrame:
    """One row: repositories and files, succeeded and failed."""
    zero = F.lit(0).cast("bigint")
    return outcomes.agg(
        F.count_if(F.col("status") == "success").alias("repository_successes"),
        F.count_if(F.col("status") == "error").alias("repository_errors"),
        F.coalesce(F.sum("success_count"), zero).alias("file_successes"),
        F.coalesce(F.sum("error_count"), zero).alias("file_errors"),
    )


def repository_file_counts(files: DataFrame) -> DataFrame:
    """Files by type per repository, and over all of them (``repository`` NULL, ``overall`` true).

    Where files carry their ``host``, repositories of one name on several hosts are apart.
    """
    keys = [name for name in ("host", "repository") if name in files.columns]
    return files.groupingSets([keys, []], *keys).agg(
        (F.grouping("repository") == 1).alias("overall"),
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("file_type") == TERRAFORM).alias("terraform_files"),
        F.count_if(F.col("file_type") == TERRAGRUNT).alias("terragrunt_files"),
    )
