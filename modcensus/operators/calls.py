"""Order of calls, and file type by existence of a Terraform call."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.fixed import TERRAFORM, TERRAGRUNT
from modcensus.functions.text import in_locale_order
from modcensus.operators.joins import FEW_SALTS, join_single
from modcensus.runtime import with_position


def report_order() -> list[Column]:
    """Source, version (calls without one last), repository, path, line; text in locale order."""
    return [
        in_locale_order(F.col("source")),
        in_locale_order(F.col("version")).asc_nulls_last(),
        in_locale_order(F.col("repository")),
        in_locale_order(F.col("file_path")),
        F.col("line_number"),
        F.col("block_pos"),
    ]


def sorted_calls(calls: DataFrame) -> DataFrame:
    """Calls in report order: a range sort on a composite key, so no source fills a task."""
    return calls.orderBy(*report_order())


def positioned_calls(calls: DataFrame) -> DataFrame:
    """Calls with their place in report order as ``position``."""
    return with_position(calls, report_order())


def listed_file_type(calls: DataFrame) -> DataFrame:
    """Adds ``file_type``: terraform if any Terraform call has this source and path, in any repository.

    Scanned calls already carry this value in ``type``; this is for call tables from elsewhere.
    ``calls`` is read twice: pass a landed table.
    """
    keys = ["source", "file_path"]
    seen = calls.where(F.col("type") == TERRAFORM).select(*keys).distinct().withColumn("_seen", F.lit(True))
    return (
        join_single(
            calls, seen, keys, "left", spread=["repository", "line_number", "block_pos"], salts=FEW_SALTS
        )
        .withColumn("file_type", F.when(F.col("_seen"), TERRAFORM).otherwise(TERRAGRUNT))
        .drop("_seen")
    )
