"""Queries over the derived corpus, their SQL, and the comparison."""

import tempfile
from functools import cache

from pyspark.sql import SparkSession

from modcensus import runtime


@cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="modcensus-")


def own_folder(spark: SparkSession) -> str:
    """A local folder, for local sessions that name none."""
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"Set {runtime.CHECKPOINT_SETTING} to a folder that all executors share.")
    return _temporary()


runtime.use_folder(own_folder)
