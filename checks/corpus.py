"""The corpus in Spark: projections of the driver's tables (see ``rules``)."""

import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import rules
from modcensus.fixed import GITLAB_SELF_HOSTED
from modcensus.functions.classify import file_type
from modcensus.functions.links import blob_url
from modcensus.runtime import land, shared_folder
from modcensus.sources.layout import ContentsLayout
from modcensus.sources.payloads import (
    github_payloads,
    github_repositories,
    gitlab_payloads,
    gitlab_repositories,
)

FILES_A_BUCKET = 250_000  # joins take a bucket as one task


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    """What files are composed of: place, repository, path and, for documents, the text."""
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS o",
        "o_custkey AS c",
        "o_orderkey * 8 AS tree_pos",
        f"{rules.ORDER_PATH} AS path",
        f"{rules.ORDER_IS_TERRAGRUNT} AS tg",
        f"{rules.ORDER_BLOCKS} AS blocks",
        f"{rules.ORDER_START} AS start",
        "CAST(NULL AS STRING) AS text",
        "false AS is_document",
    )
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id AS o",
        "doc_id AS c",
        "1000000000000 + doc_id * 8 AS tree_pos",
        f"{rules.DOCUMENT_PATH} AS path",
        f"{rules.DOCUMENT_IS_TERRAGRUNT} AS tg",
        f"{rules.DOCUMENT_BLOCKS} AS blocks",
        "CAST(NULL AS STRING) AS start",
        "text",
        "true AS is_document",
    )
    seeds = orders.unionAll(documents)
    cores = spark.sparkContext.defaultParallelism
    if seeds.rdd.getNumPartitions() < cores:  # small tables come as one split each
        seeds = seeds.repartition(cores, "path")
    return seeds.selectExpr("*", f"{rules.REPO_FULL_NAME} AS full_name", f"{rules.OWN_HOST} AS h", f"{rules.TWIN_HOST} AS twin")


def _content() -> Column:
    """The text of a file out of its seed."""
    glue = f"(CASE WHEN is_document THEN text || {rules.NL} ELSE '' END)"
    blocks = f"array_join(transform(sequence(1L, blocks), k -> {rules.GLUED_BLOCK.replace('glue', glue)}), '')"
    return F.expr(
        f"(CASE WHEN is_document THEN text || {rules.NL} ELSE start END) || CASE WHEN blocks = 0 THEN '' ELSE {blocks} END "
        "|| (CASE WHEN is_document THEN text ELSE '' END)"
    )


@cache
def _landed(application: str, spark: SparkSession, folder: str) -> DataFrame:
    columns = ["o", "c", "tree_pos", "full_name", "h", "twin", "path"]
    return land(_seeds(spark, folder).select(*columns, _content().alias("content")), "files", compact=True)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Landed files: place, repository, path and plain content.

    Written once per session and folder, so that queries read a table as they would
    read one of landed files, instead of composing every text again.
    """
    return _landed(spark.sparkContext.applicationId, spark, folder)


def iac_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = files(spark, folder).selectExpr(
        "*",
        f"{rules.REPO_PROVIDER} AS provider",
        f"{rules.REPO_URL} AS repository_url",
        f"coalesce({rules.REPO_BRANCH}, 'main') AS branch",
    )
    return rows.select(
        file_type(F.col("path")).alias("file_type"),
        F.col("full_name").alias("repository"),
        "path",
        "content",
        blob_url(
            F.col("provider"), F.col("repository_url"), F.col("full_name"), F.col("branch"), F.col("path")
        ).alias("url"),
        F.md5("path").alias("sha"),
        F.octet_length("content").cast("bigint").alias("size"),
    )


def hosted_files(spark: SparkSession, folder: str) -> DataFrame:
    """host, repository and file_type of the files on all their hosts; twins share their names."""
    return _on_hosts(files(spark, folder)).select("host", F.col("full_name").alias("repository"), file_type(F.col("path")).alias("file_type"))


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr("c_custkey AS c")


def _pages(spark: SparkSession, folder: str, host: str, body: str) -> DataFrame:
    """One-payload pages of a host in listing order; every 13th payload is listed again at the end."""
    again = f"CASE WHEN c % 13 = 0 THEN array(0L, {rules.AGAIN}L) ELSE array(0L) END"
    own = f"struct({rules.OWN_HOST} AS h, 0L AS after)"
    twin = f"struct({rules.TWIN_HOST} AS h, {rules.TWIN_PAGES}L AS after)"
    return (
        _customers(spark, folder)
        .selectExpr("c", f"explode({again}) AS again")
        .selectExpr("c", "again", f"inline(array({own}, {twin}))")
        .where(f"h = '{host}'")
        .selectExpr("c + again + after AS page", f"{body} AS body")
    )


def github_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, "github", rules.GITHUB_PAGE)


def gitlab_pages(spark: SparkSession, folder: str, host: str = "gitlab") -> DataFrame:
    return _pages(spark, folder, host, rules.GITLAB_PAGE)


def repositories(spark: SparkSession, folder: str) -> DataFrame:
    """The listings of three hosts."""
    github = github_repositories(github_payloads(github_pages(spark, folder)))
    gitlab = gitlab_repositories(gitlab_payloads(gitlab_pages(spark, folder)))
    self_hosted = gitlab_payloads(gitlab_pages(spark, folder, "self"))
    return github.unionByName(gitlab).unionByName(
        gitlab_repositories(self_hosted, provider=GITLAB_SELF_HOSTED, host=rules.SELF_HOST)
    )


def _on_hosts(rows: DataFrame) -> DataFrame:
    """Files on their own host, and the twin's part of them; ``is_twin`` tells them apart."""
    own = "struct(h AS on, false AS is_twin)"
    twin = f"struct(CASE WHEN {rules.TWIN_HAS} THEN twin END AS on, true AS is_twin)"
    placed = rows.selectExpr("*", f"inline(array({own}, {twin}))").where("on IS NOT NULL").drop("h")
    return placed.withColumnRenamed("on", "h").withColumn("host", F.expr(rules.REPO_HOST))


def tree_entries(spark: SparkSession, folder: str) -> DataFrame:
    extras = ", ".join(
        f"CASE WHEN {condition} THEN struct({path} AS path, '{kind}' AS entry_type, {i + 1}L AS at) END"
        for i, (condition, path, kind) in enumerate(rules.EXTRAS)
    )
    entries = f"filter(array(struct(path, 'blob' AS entry_type, 0L AS at), {extras}), e -> e IS NOT NULL)"
    landed = _on_hosts(_seeds(spark, folder).where(rules.HAS_TREE))
    rows = landed.selectExpr("o", "host", "full_name", "tree_pos", f"inline({entries})")
    return rows.selectExpr(
        "host",
        "full_name",
        "path",
        "entry_type",
        f"CASE WHEN {rules.HAS_SHA} THEN md5(path) END AS sha",
        "CAST(NULL AS BIGINT) AS size",
        "tree_pos + at AS tree_pos",
    )


def landed_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: one row for each landed tree, those without entries too."""
    hosts = f"array({rules.OWN_HOST}, {rules.TWIN_HOST})"
    rows = _customers(spark, folder).where(rules.TREE_LANDED).selectExpr("c", f"explode({hosts}) AS h").where("h IS NOT NULL")
    return rows.selectExpr(f"{rules.REPO_HOST} AS host", f"{rules.REPO_FULL_NAME} AS full_name")


@cache
def _landed_contents(application: str, spark: SparkSession, folder: str) -> ContentsLayout:
    # texts are composed and encoded behind the layout's exchange
    rows = _on_hosts(_seeds(spark, folder).where(rules.IS_LANDED)).where(f"NOT is_twin OR {rules.TWIN_IS_LANDED}")
    plain, empty = F.expr(rules.IS_PLAIN), F.expr(rules.IS_EMPTY_RESPONSE)
    encoded = F.base64(_content())
    broken = F.overlay(encoded, F.lit("\n"), F.lit(61), F.lit(0))
    place = f"{shared_folder(spark).rstrip('/')}/modcensus/contents-{uuid.uuid4().hex}"
    count = sum(table(spark, folder, name).count() for name in ("orders", "documents"))
    layout = ContentsLayout(place, owner_buckets=8, buckets=max(8, count // FILES_A_BUCKET))
    layout.write(
        rows,
        encoding=F.when(plain, "text").otherwise("base64"),
        content=F.when(empty, F.lit(None)).when(plain, _content()).otherwise(broken),
    )
    return layout


def contents_layout(spark: SparkSession, folder: str) -> ContentsLayout:
    """Landed responses: base64 bodies broken into lines, as the providers send them."""
    return _landed_contents(spark.sparkContext.applicationId, spark, folder)


def file_contents(spark: SparkSession, folder: str) -> DataFrame:
    return contents_layout(spark, folder).read(spark)


def scan_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return _customers(spark, folder).selectExpr("c", f"{rules.TARGET} AS original_input")


def fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        f"{rules.LOG_PLATFORM} AS platform",
        "event_type AS operation",
        f"{rules.LOG_STATUS} AS status",
        f"{rules.LOG_CODE} AS code",
        "'request ' || event_id AS message",
        f"{rules.LOG_BODY_MESSAGE} AS body_message",
    )
