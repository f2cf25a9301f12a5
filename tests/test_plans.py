"""Physical plans: what a large cluster would run."""

import re

import pytest

from checks import catalog, corpus
from modcensus.operators import calls as call_ops
from modcensus.operators.extract import call_sources, module_calls
from modcensus.operators.files import attach_contents, attach_outcomes, candidate_files
from modcensus.operators.repositories import first_listed
from modcensus.operators.usage import normalized_summary, raw_summary, usage_counts
from modcensus.plans.scan import scan_module_calls
from modcensus.runtime import land
from modcensus.schemas import FILE_CONTENTS, IAC_FILES, REPOSITORIES, TREE_ENTRIES
from modcensus.sources.layout import ContentsLayout

FOLDER = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def stored(spark, tmp_path, schema, name):
    """An empty Parquet table of that schema; plans do not need rows."""
    path = str(tmp_path / name)
    spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def files(spark, tmp_path):
    return stored(spark, tmp_path, IAC_FILES, "files")


def test_extraction_is_one_narrow_pass(files):
    for frame in (module_calls(files), call_sources(files)):
        plan = plan_of(frame)
        assert plan.count("FileScan") == 1 and "Exchange" not in plan
        assert optimized(frame).count("regexp_extract_all") == 2  # one per file type
        scan = next(line for line in plan.splitlines() if "FileScan" in line)
        assert "StringContains(content,source)" in scan
    assert re.search(r"ReadSchema: struct<file_type:string,content:string>", plan_of(call_sources(files)))


def test_sources_do_not_pay_for_line_numbers(files):
    assert "split(content" not in optimized(call_sources(files))


def test_summaries_shuffle_counts_only(files):
    usage = usage_counts(call_sources(files))
    plan = plan_of(usage)
    assert plan.count("Exchange") == 1 and "partial_count" in plan
    for summary in (raw_summary(usage), normalized_summary(usage)):
        exchanges = [line for line in plan_of(summary).splitlines() if "Exchange" in line]
        assert exchanges and all("hashpartitioning" in line for line in exchanges)
        assert plan_of(summary).count("FileScan") == 1


def test_type_filter_reaches_the_scan(files):
    plan = plan_of(module_calls(files.where("file_type = 'terragrunt'")))
    assert "EqualTo(file_type,terragrunt)" in plan


def test_early_extraction_never_shuffles_contents(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = scan_module_calls(
            stored(spark, tmp_path, REPOSITORIES, "repositories"),
            stored(spark, tmp_path, TREE_ENTRIES, "tree"),
            stored(spark, tmp_path, FILE_CONTENTS, "contents"),
        )
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan and plan.count("SortMergeJoin") == 2
        lines = plan.splitlines()
        start = next(i for i, line in enumerate(lines) if "posexplode" in line)
        end = next(i for i in range(start, len(lines)) if "FileScan" in lines[i])
        assert "content" in lines[end] and not any("Exchange" in line for line in lines[start:end])
        shuffled = [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line]
        assert len(shuffled) >= 4 and not any(re.search(r"[\[ ]content#", line) for line in shuffled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_a_list_of_repositories_prunes_partitions_of_contents(spark, tmp_path, threshold):
    """For a list of any size: the wanted buckets, not the list, are broadcast."""
    layout = ContentsLayout(str(tmp_path / "layout"), owner_buckets=4, buckets=4)
    layout.write(spark.createDataFrame([("h", "a/b", "x.tf", "text", "t")], FILE_CONTENTS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        frame = scan_module_calls(
            stored(spark, tmp_path, REPOSITORIES, "repositories"),
            stored(spark, tmp_path, TREE_ENTRIES, "tree"),
            layout.read(spark),
            owner_buckets=4,
        )
        lines = plan_of(frame).splitlines()
        scan = next(line for line in lines if "FileScan" in line and "content" in line)
        assert "dynamicpruning" in scan and "owner_bucket" in scan
        start = next(i for i, line in enumerate(lines) if "posexplode" in line)
        end = lines.index(scan)
        assert not any("Exchange hash" in line or "Exchange range" in line for line in lines[start:end])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_attached_where_they_lie(spark, tmp_path):
    """No exchange carries contents of a layout."""
    layout = ContentsLayout(str(tmp_path / "layout"), owner_buckets=4, buckets=4)
    layout.write(spark.createDataFrame([("h", "a/b", "x.tf", "text", "t")], FILE_CONTENTS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        candidates = candidate_files(stored(spark, tmp_path, TREE_ENTRIES, "tree"), stored(spark, tmp_path, REPOSITORIES, "repositories"))
        lines = plan_of(attach_contents(candidates, layout.read(spark))).splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "content" in line)
        join = max(i for i in range(scan) if "SortMergeJoin" in lines[i] and "LeftOuter" in lines[i])
        assert join < scan
        moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line]
        assert moved and not any(re.search(r"content#|_raw#", line) for line in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_outcomes_never_move_or_decode_contents(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        candidates = candidate_files(stored(spark, tmp_path, TREE_ENTRIES, "tree"), stored(spark, tmp_path, REPOSITORIES, "repositories"))
        plan = plan_of(attach_outcomes(candidates, stored(spark, tmp_path, FILE_CONTENTS, "contents")))
        lines = plan.splitlines()
        shuffled = [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line]
        assert len(shuffled) >= 4 and not any(re.search(r"[\[ ](content|_raw)#", line) for line in shuffled)
        assert "base64" not in plan.replace("<=> base64", "").replace("= base64", "") and "make_valid_utf8" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report_order_is_a_range_sort(spark, files):
    plan = plan_of(call_ops.sorted_calls(module_calls(files)))
    assert "rangepartitioning" in plan and "SinglePartition" not in plan


def test_corpus_is_written_once(spark):
    assert corpus.files(spark, FOLDER) is corpus.files(spark, FOLDER)


def test_landed_tables_keep_their_schema(spark, files):
    assert land(files, "t").schema == files.schema


@pytest.mark.parametrize(
    "name",
    [
        "q_content_decode", "q_fetch_counts", "q_max_files", "q_partial_failures", "q_repo_exists", "q_repo_failures",
        "q_scan_errors", "q_scan_owner", "q_scan_totals", "q_tree_files", "q_single_repo", "q_target_limit",
    ],
)
def test_listings_and_files_are_never_broadcast(spark, name):
    """Estimates take a listing of gigabytes for a few megabytes; only the wanted buckets of owners may travel."""
    plan = plan_of(catalog.all_queries()[name](spark, FOLDER))
    assert "SortMergeJoin" in plan
    assert plan.count("BroadcastExchange") == (1 if name == "q_scan_owner" else 0)


SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.fixture
def small_skew(spark):
    for key, value in SMALL_SKEW.items():
        spark.conf.set(key, value)
    yield
    for key in SMALL_SKEW:
        spark.conf.unset(key)


def test_hot_keys_are_split(spark, small_skew, tmp_path):
    """A third of all calls have one source and path, a third of all tree entries one repository."""
    path = str(tmp_path / "calls")
    spark.range(60000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 's' || id END AS source", "'main.tf' AS file_path",
        "IF(id % 2 = 0, 'terraform', 'terragrunt') AS type", "'r' || id AS repository", "1 AS line_number", "0 AS block_pos",
    ).write.parquet(path)
    listed = call_ops.listed_file_type(spark.read.parquet(path))
    rows = listed.collect()
    assert len(rows) == 60000
    assert "skew=true" in plan_of(listed)
    hot = {r.file_type for r in rows if r.source == "hot"}
    assert hot == {"terraform"} and sum(r.file_type == "terragrunt" for r in rows) == 20000

    tree = str(tmp_path / "hot-tree")
    spark.range(60000).selectExpr(
        "'h' AS host", "CASE WHEN id % 3 = 0 THEN 'o/hot' ELSE 'o/r' || id % 1000 END AS full_name", "id || '.tf' AS path",
        "'blob' AS entry_type", "'1' AS sha", "1L AS size", "id AS tree_pos",
    ).write.parquet(tree)
    repositories = spark.range(-1, 1000).selectExpr(
        "'github' AS provider", "'h' AS host", "id AS list_pos", "'o' AS owner", "IF(id < 0, 'hot', 'r' || id) AS name",
        "'o/' || IF(id < 0, 'hot', 'r' || id) AS full_name", "'main' AS default_branch", "false AS archived",
        "false AS private", "'u' AS url", "'c' AS clone_url",
    )
    candidates = candidate_files(spark.read.parquet(tree), first_listed(repositories))
    assert len(candidates.collect()) == 60000
    assert "skew=true" in plan_of(candidates)
    limited = candidate_files(spark.read.parquet(tree), first_listed(repositories), max_files=5)
    assert sorted(r.tree_pos for r in limited.where("repository = 'o/hot'").collect()) == [0, 3, 6, 9, 12]
