"""The landing layout of contents."""

import pytest

from modcensus.operators.extract import module_calls
from modcensus.operators.files import attach_contents, candidate_files, fetched_files
from modcensus.plans.scan import scan_files, scan_module_calls
from modcensus.schemas import FILE_CONTENTS, REPOSITORIES, TREE_ENTRIES
from modcensus.sources.layout import KEY, ContentsLayout

GITLAB_HOST = "https://gitlab.com"
BLOCK = 'module "m{}" {{\n  source = "git::https://x/{}"\n}}\n'


@pytest.fixture
def tables(spark):
    """Three owners; one repository has most of the files."""
    names = [("big/one", 60), ("big/sub/two", 3), ("small/three", 2), ("none/four", 0)]
    repositories = [("gitlab", GITLAB_HOST, i, name.rsplit("/", 1)[0], name.rsplit("/", 1)[1], name, "main", False, False, "u", "c") for i, (name, _) in enumerate(names)]
    tree, contents = [], []
    for name, count in names:
        for i in range(count):
            tree.append((GITLAB_HOST, name, f"d/{i}.tf", "blob", "s", None, i))
            contents.append((GITLAB_HOST, name, f"d/{i}.tf", "text", BLOCK.format(i, name)))
    contents.append((None, "x/y", "a.tf", "text", None))
    return (
        spark.createDataFrame(repositories, REPOSITORIES),
        spark.createDataFrame(tree, TREE_ENTRIES),
        spark.createDataFrame(contents, FILE_CONTENTS),
    )


@pytest.fixture
def layout(tables, tmp_path):
    layout = ContentsLayout(str(tmp_path / "landed"), owner_buckets=5, buckets=3)
    layout.write(tables[2])
    return layout


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


def test_contents_come_back(spark, tables, layout):
    assert rows_of(layout.read(spark).select(*tables[2].columns)) == rows_of(tables[2])


def test_another_session_opens_the_folder(spark, tables, layout):
    spark.sql(f"DROP TABLE {layout.table}")
    opened = ContentsLayout.open(spark, layout.folder)
    assert opened == layout
    assert rows_of(opened.read(spark).select(*tables[2].columns)) == rows_of(tables[2])
    assert ContentsLayout.open(spark, layout.folder) == layout  # a known table is used


def test_a_scan_gives_the_same_calls(spark, tables, layout):
    repositories, tree, contents = tables
    for chosen in (repositories, repositories.where("full_name LIKE 'big/%'"), repositories.where("false")):
        plain = scan_module_calls(chosen, tree, contents)
        pruned = scan_module_calls(chosen, tree, layout.read(spark), owner_buckets=layout.owner_buckets)
        assert rows_of(plain) == rows_of(pruned)
        assert rows_of(plain) == rows_of(module_calls(fetched_files(scan_files(chosen, tree, contents))).select(*plain.columns))
    assert pruned.count() == 0


def test_a_scan_of_one_owner_reads_its_partition_only(spark, tables, layout):
    repositories, tree, _ = tables
    frame = scan_module_calls(repositories.where("owner = 'small'"), tree, layout.read(spark), owner_buckets=layout.owner_buckets)
    assert frame.count() == 2
    frame.collect()
    metrics = frame._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in metrics


def test_a_hot_repository_is_spread_over_the_buckets(spark, tables, layout):
    repositories, tree, contents = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        attached = attach_contents(candidate_files(tree, repositories), layout.read(spark))
        assert rows_of(attached) == rows_of(attach_contents(candidate_files(tree, repositories), contents))
        files = layout.read(spark).where("full_name = 'big/one'").selectExpr("input_file_name() AS file").distinct().count()
        assert files == layout.buckets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert KEY[-1] == "path"
