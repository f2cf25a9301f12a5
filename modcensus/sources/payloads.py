"""Landed repository listings of GitHub and GitLab as the ``repositories`` table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modcensus.fixed import GITHUB, GITLAB, PAGE_SIZE, PUBLIC_HOSTS
from modcensus.functions.text import none_if_empty
from modcensus.operators.repositories import owned_by
from modcensus.schemas import GITHUB_REPOSITORY, GITLAB_PROJECT


def read_pages(spark: SparkSession, path: str, page_number: Column | None = None) -> DataFrame:
    """Landed response bodies, one file per page: (``page``, ``body``).

    The page number is by default the last number in the file name.
    """
    files = spark.read.text(path, wholetext=True)
    number = F.regexp_extract("_metadata.file_name", r"(\d+)\D*\z", 1).cast("bigint")
    return files.select((number if page_number is None else page_number).alias("page"), F.col("value").alias("body"))


def _listed(pages: DataFrame, schema: str) -> DataFrame:
    """One row per payload with its place in the listing. Pages hold at most ``PAGE_SIZE``.

    A page that cannot be read fails the listing; it must not shrink unnoticed. So does one with
    more items, as their places would be those of the next page.
    """
    items = F.from_json("body", f"ARRAY<STRUCT<{schema}>>", {"mode": "FAILFAST"})
    return (
        pages.select("page", F.posexplode(items).alias("_at", "_item"))
        .where(F.when(F.col("_at") >= PAGE_SIZE, F.raise_error(F.lit("A landed page has too many items"))).isNull())
        .select((F.col("page") * PAGE_SIZE + F.col("_at")).cast("bigint").alias("list_pos"), "_item.*")
    )


def github_payloads(pages: DataFrame) -> DataFrame:
    return _listed(pages, GITHUB_REPOSITORY)


def gitlab_payloads(pages: DataFrame) -> DataFrame:
    return _listed(pages, GITLAB_PROJECT)


def github_repositories(
    payloads: DataFrame, provider: str = GITHUB, host: str = PUBLIC_HOSTS[GITHUB]
) -> DataFrame:
    """``provider`` and ``host`` tell where the listing was landed from."""
    owner = F.coalesce(
        none_if_empty(F.col("owner.login")),
        none_if_empty(F.col("owner.path")),
        none_if_empty(F.col("owner.name")),
        F.lit(""),
    )
    return payloads.select(
        F.lit(provider).alias("provider"),
        F.lit(host).alias("host"),
        "list_pos",
        owner.alias("owner"),
        "name",
        "full_name",
        "default_branch",
        "archived",
        "private",
        F.col("html_url").alias("url"),
        "clone_url",
    )


def single_name() -> Column:
    return F.coalesce(none_if_empty(F.col("path")), F.col("name"))


def gitlab_repositories(
    payloads: DataFrame,
    listing: bool = True,
    provider: str = GITLAB,
    host: str = PUBLIC_HOSTS[GITLAB],
    carry: list[str] | None = None,
) -> DataFrame:
    """A listing names a project by its path; a single lookup falls back to its display name.

    ``carry`` names further columns to keep.
    """
    name = F.col("path") if listing else single_name()
    return payloads.select(
        F.lit(provider).alias("provider"),
        F.lit(host).alias("host"),
        "list_pos",
        F.col("namespace.path").alias("owner"),
        name.alias("name"),
        F.col("path_with_namespace").alias("full_name"),
        F.coalesce(none_if_empty(F.col("default_branch")), F.lit("main")).alias("default_branch"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        (~F.col("visibility").eqNullSafe("public")).alias("private"),
        F.col("web_url").alias("url"),
        F.col("http_url_to_repo").alias("clone_url"),
        *(carry or []),
    )


def owned_projects(payloads: DataFrame, owners: DataFrame) -> DataFrame:
    """Projects of one GitLab host with each of the (``owner``, ``is_group``) rows that own them."""
    projects = payloads.select(
        "*",
        F.lit(GITLAB).alias("provider"),
        F.lit("").alias("host"),
        F.col("namespace.path").alias("owner"),
        F.col("path_with_namespace").alias("full_name"),
    )
    owned = owned_by(projects, owners.withColumn("host", F.lit("")).distinct())
    return owned.select(*payloads.columns, F.col("_owner").alias("owner"), "is_group")
