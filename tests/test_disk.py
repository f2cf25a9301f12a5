"""What lies on disk beside the results: landed contents, shuffle files, outcomes."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks import catalog, corpus, rules
from modcensus.runtime import land, shared_folder
from modcensus.schemas import FILE_CONTENTS
from modcensus.sources.layout import KEY, ContentsLayout
from tests.test_plans import plan_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Null keys and texts, repeated rows, and documents of one and of many words."""
    path = str(tmp_path_factory.mktemp("tables"))
    orders = [(i, i * 7 % 50) for i in range(400)] + [(5, 35), (5, 35), (7, None), (None, 3)]
    spark.createDataFrame(orders, "o_orderkey LONG, o_custkey LONG").repartition(2).write.parquet(f"{path}/orders.parquet")
    documents = [(i, "word " * (i % 9) + "ende ü") for i in range(60)] + [(60, None), (61, ""), (8, "word")]
    spark.createDataFrame(documents, "doc_id LONG, text STRING").write.parquet(f"{path}/documents.parquet")
    spark.range(50).selectExpr("id AS c_custkey").write.parquet(f"{path}/customer.parquet")
    return path


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_of_a_landing_go_with_it(spark, tmp_path):
    rows = spark.range(3000).selectExpr("'h' AS host", "'a/b' AS full_name", "id || '.tf' AS path", "'text' AS encoding", "md5(id || '') AS content")
    before = shuffle_files(spark)
    layout = ContentsLayout(str(tmp_path / "layout"), owner_buckets=4, buckets=3)
    layout.write(rows)
    land(rows.repartition(5, "path"), "outcomes", compact=True)
    assert not shuffle_files(spark) - before
    assert layout.read(spark).count() == 3000


def test_a_write_sorts_small_parts(spark, tmp_path):
    """A task has a part of a bucket, not the whole; still one file for each bucket of an owner bucket."""
    layout = ContentsLayout(str(tmp_path / "layout"), owner_buckets=5, buckets=3)
    layout.write(spark.range(600).selectExpr("'h' AS host", "'o' || id % 20 || '/r' AS full_name", "id || '.tf' AS path", "'text' AS encoding", "'t' AS content"))
    files = layout.read(spark).select("owner_bucket", F.pmod(F.hash(*KEY), F.lit(3)).alias("bucket"), F.input_file_name().alias("file")).distinct()
    pairs = files.select("owner_bucket", "bucket").distinct().count()
    writers = files.select(F.regexp_extract("file", r"part-(\d+)-", 1)).distinct().count()
    assert pairs == files.count() == files.select("file").distinct().count()
    assert writers == pairs > 3


def test_columns_are_computed_behind_the_exchange(spark, tmp_path):
    rows = spark.range(300).selectExpr("'h' AS host", "'o' || id % 7 || '/r' AS full_name", "id || '.tf' AS path", "CAST(id AS INT) AS n")
    rows = rows.unionAll(spark.createDataFrame([(None, None, None, None)], "host STRING, full_name STRING, path STRING, n INT"))
    content = F.base64(F.repeat(F.lit("x"), F.col("n")).cast("binary"))
    layout = ContentsLayout(str(tmp_path / "layout"), owner_buckets=2, buckets=3)
    layout.write(rows, encoding=F.lit("base64"), content=content)
    wanted = rows.select(*KEY, F.lit("base64").alias("encoding"), content.alias("content"))
    assert rows_of(layout.read(spark).drop("owner_bucket")) == rows_of(wanted)
    assert layout.read(spark).drop("owner_bucket").columns == spark.createDataFrame([], FILE_CONTENTS).columns


def test_contents_are_those_of_the_files(spark, folder):
    encoded = "base64(content)"
    files = corpus._on_hosts(corpus.files(spark, folder).where(rules.IS_LANDED)).where(f"NOT is_twin OR {rules.TWIN_IS_LANDED}")
    wanted = files.selectExpr(
        "host", "full_name", "path", f"CASE WHEN {rules.IS_PLAIN} THEN 'text' ELSE 'base64' END AS encoding",
        f"CASE WHEN {rules.IS_EMPTY_RESPONSE} THEN NULL WHEN {rules.IS_PLAIN} THEN content "
        f"ELSE substr({encoded}, 1, 60) || chr(10) || substr({encoded}, 61) END AS content",
    )
    landed = corpus.file_contents(spark, folder).drop("owner_bucket")
    assert rows_of(landed) == rows_of(wanted) and len(rows_of(wanted)) > 400
    some = next(p for p in corpus.contents_layout(spark, folder).read(spark).inputFiles())
    assert pq.read_metadata(some.removeprefix("file://")).row_group(0).column(0).compression == "ZSTD"


def test_contents_need_no_landed_files(spark, folder, monkeypatch):
    def landed(*_):
        raise AssertionError("files were landed")

    monkeypatch.setattr(corpus, "_landed", landed)
    monkeypatch.setattr(corpus, "_landed_contents", corpus._landed_contents.__wrapped__)
    assert catalog.q_fetch_counts(spark, folder).count() > 0


def test_buckets_grow_with_the_files(spark, folder, monkeypatch):
    assert corpus._landed_contents.__wrapped__("a", spark, folder).buckets == 8
    monkeypatch.setattr(corpus, "FILES_A_BUCKET", 40)
    layout = corpus._landed_contents.__wrapped__("a", spark, folder)
    assert layout.buckets == (404 + 63) // 40
    assert rows_of(layout.read(spark)) == rows_of(corpus.file_contents(spark, folder))


@pytest.mark.parametrize("name", ["q_fetch_counts", "q_partial_failures", "q_repo_failures", "q_scan_totals", "q_content_decode", "q_scan_owner"])
def test_joins_move_no_hashes(spark, folder, name):
    lines = plan_of(catalog.all_queries()[name](spark, folder)).splitlines()
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hash" in line]
    assert moved and not any("AS sha#" in line or ", sha#" in line for line in moved)


def test_landed_outcomes_have_what_errors_need(spark, folder, monkeypatch):
    landed = []
    monkeypatch.setattr(catalog, "land", lambda rows, *a, **k: landed.append(land(rows, *a, **k)) or landed[-1])
    errors = catalog.q_scan_errors(spark, folder)
    assert landed[0].columns == ["host", "repository", "path", "provider", "error"]
    assert {row["kind"] for row in errors.select("kind").distinct().collect()} == {"file", "repository"}
    assert shared_folder(spark) in landed[0].inputFiles()[0]
