"""Summaries of module calls.

All of them start from ``usage_counts``: one row per (type, source, version). That
is the only aggregate over the calls themselves; it combines before its shuffle, so
a source with a third of all calls costs one row per task. What follows works on
distinct sources, and classifies and normalizes each of them once instead of once
per call.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from modcensus.fixed import FILE_TYPES, TERRAFORM, TERRAGRUNT
from modcensus.functions.classify import normalize_source, source_type
from modcensus.functions.text import in_locale_order
from modcensus.runtime import with_position


def usage_counts(calls: DataFrame) -> DataFrame:
    """(type, source, version, n) from calls."""
    return calls.groupBy("type", "source", "version").agg(F.count(F.lit(1)).alias("n"))


def _with_totals(counts: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Per-key totals and per-version counts in one grouping-sets pass.

    ``entry`` is 'total' or 'version'. Rows without a version count in the total only.
    """
    sets = [[*keys, "version"], keys]
    return (
        counts.groupingSets(sets, *keys, "version")
        .agg(F.grouping("version").alias("_total"), F.sum("n").alias("n"), *extra)
        .where((F.col("_total") == 1) | F.col("version").isNotNull())
        .withColumn("entry", F.when(F.col("_total") == 1, "total").otherwise("version"))
        .drop("_total")
    )


def raw_summary(usage: DataFrame) -> DataFrame:
    """Per type and raw source: number of calls, and number per version."""
    return _with_totals(usage, ["type", "source"]).select("type", "source", "entry", "version", "n")


def merged_summary(usage: DataFrame) -> DataFrame:
    """Raw summaries of both types, where a Terragrunt entry replaces a Terraform one.

    Counts of a source used in both types are not added up. ``usage`` is read several times:
    pass a landed table.
    """
    summary = raw_summary(usage)
    terragrunt = summary.where(F.col("type") == TERRAGRUNT)
    replaced = terragrunt.where(F.col("entry") == "total").select("source")
    kept = summary.where(F.col("type") == TERRAFORM).join(replaced, "source", "left_anti")
    return kept.unionByName(terragrunt).select("source", "entry", "version", "n")


def normalized_summary(usage: DataFrame) -> DataFrame:
    """Per normalized source: calls, calls per version, and the kind of its first raw source.

    Total rows also tell whether any call of the source is ``versioned``.
    """
    source = F.col("source")
    per_source = usage.groupBy("source", "version").agg(F.sum("n").alias("n"))
    rows = per_source.select(
        normalize_source(source).alias("module"), "source", source_type(source).alias("_type"), "version", "n"
    )
    first_type = F.min_by("_type", in_locale_order(source)).alias("source_type")
    versioned = F.max(F.col("version").isNotNull()).alias("versioned")
    is_total = F.col("entry") == "total"
    return _with_totals(rows, ["module"], first_type, versioned).select(
        "module",
        F.when(is_total, F.col("source_type")).alias("source_type"),
        F.when(is_total, F.col("versioned")).alias("versioned"),
        "entry",
        "version",
        "n",
    )


def summary_order(source: str, entry: str = "entry") -> list[Column]:
    """Sources in locale order; in each its total, then its versions in locale order."""
    return [
        in_locale_order(F.col(source)),
        F.col(source),
        F.col(entry),
        in_locale_order(F.col("version")),
        F.col("version"),
    ]


def ranked_summary(usage: DataFrame) -> DataFrame:
    """Normalized summary with its place in report order as ``position``."""
    return with_position(normalized_summary(usage), summary_order("module"))


def percent_text(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, computed and rounded as floating point numbers are.

    The share is a double; the decimal nearest to its exact binary value is shown, the upper one
    when two are equally near. So 3 of 2000 gives 0.1: the double next to 0.15 lies below it.
    """
    share = F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)) * 100  # nothing of nothing is 0
    tenths = F.floor(share * 10)
    middle = (tenths * 2 + 1) / F.lit(20.0)
    # the double next to the middle may lie below it: compare twenty times its value, the rounding
    # error of that sum included, with the whole number it stands for
    large, small = middle * 16, middle * 4
    total = large + small
    error = (large - (total - (total - large))) + (small - (total - large))
    middle_is_low = (total - (tenths * 2 + 1)) + error < 0
    up = (share > middle) | ((share == middle) & ~middle_is_low)
    shown = tenths + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%d", F.floor(shown / 10), F.pmod(shown, F.lit(10)))


def source_type_share(usage: DataFrame) -> DataFrame:
    """Calls per source kind, most frequent first; ties in order of the first source seen."""
    per_source = usage.groupBy("source").agg(F.sum("n").alias("n"))
    per_type = (
        per_source.withColumn("source_type", source_type(F.col("source")))
        .groupBy("source_type")
        .agg(F.sum("n").alias("n"), F.min(in_locale_order(F.col("source"))).alias("_first"))
    )
    # at most one row per source kind from here on
    return per_type.select(
        F.row_number().over(Window.orderBy(F.desc("n"), F.asc("_first"))).alias("rank"),
        "source_type",
        "n",
        percent_text(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("percent"),
    )


def file_type_share(usage: DataFrame) -> DataFrame:
    """Calls per file type; both types are listed even at zero."""
    def calls_of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0).cast("bigint"))

    totals = usage.agg(calls_of(TERRAFORM).alias("tf"), calls_of(TERRAGRUNT).alias("tg"))
    lines = F.array(
        F.struct(F.lit(1).alias("rank"), F.lit(TERRAFORM).alias("type"), F.col("tf").alias("n")),
        F.struct(F.lit(2).alias("rank"), F.lit(TERRAGRUNT).alias("type"), F.col("tg").alias("n")),
    )
    return totals.select("tf", "tg", F.inline(lines)).select(
        "rank", "type", "n", percent_text(F.col("n"), F.col("tf") + F.col("tg")).alias("percent")
    )


def watched_files(files: DataFrame) -> tuple[DataFrame, Observation]:
    """The files, and metrics that count them by type in whatever pass reads them next.

    That pass should end with a write and no exchange: its tasks count once, however often they are tried.
    """
    seen, kind = Observation(), F.col("file_type")
    per_type = [F.count_if(kind == name).alias(name) for name in FILE_TYPES]
    return files.observe(seen, *per_type, F.count_if(~F.coalesce(kind.isin(FILE_TYPES), F.lit(False))).alias("other")), seen


def observed_files(spark: SparkSession, seen: Observation) -> DataFrame:
    """(type, n) of the files that a pass over ``watched_files`` has read."""
    rows = [(None if name == "other" else name, n) for name, n in seen.get.items()]
    return spark.createDataFrame(rows, "type STRING, n LONG")


def scan_counts(files: DataFrame, usage: DataFrame, file_counts: DataFrame | None = None) -> DataFrame:
    """One row of counters: modules and files, together and per type.

    ``files`` counts every matched file, with or without calls; its content is not read. With ``file_counts``
    (type, n) the files are not read at all.
    """
    if file_counts is None:
        file_counts = files.groupBy(F.col("file_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    measures = file_counts.select(F.lit("file").alias("what"), "type", "n").unionByName(
        usage.select(F.lit("module").alias("what"), "type", "n")
    )

    def total(what: str, kind: str | None = None) -> Column:
        test = F.col("what") == what
        if kind is not None:
            test = test & (F.col("type") == kind)
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("bigint"))

    return measures.agg(
        total("module").alias("module_count"),
        total("file").alias("file_count"),
        total("module", TERRAFORM).alias("terraform_module_count"),
        total("module", TERRAGRUNT).alias("terragrunt_module_count"),
        total("file", TERRAFORM).alias("terraform_file_count"),
        total("file", TERRAGRUNT).alias("terragrunt_file_count"),
    )


def unique_sources(usage: DataFrame) -> DataFrame:
    """Per type: number of sources, and of sources with any version."""
    per_source = usage.groupBy("type", "source").agg(F.max(F.col("version").isNotNull()).alias("versioned"))
    return per_source.groupBy("type").agg(
        F.count(F.lit(1)).alias("sources"), F.count_if("versioned").alias("versioned_sources")
    )
