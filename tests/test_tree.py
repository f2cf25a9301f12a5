"""Directory trees."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from modcensus.fixed import SKIP_DIRECTORIES
from modcensus.sources import tree
from modcensus.sources.tree import list_tree, read_directory_tree, read_tree, tree_errors


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "checkout"
    for path, text in {
        "main.tf": 'module "a" { source = "x" }',
        "_x.tf": "",
        ".hidden.tf": "h",
        ".terraform.lock.hcl": "lock",
        "README.md": "no",
        "live/eu/terragrunt.hcl": "é",
        "live/us/terragrunt.hcl": "us",
        "live/eu/deep/er/vars.tfvars": "v",
        ".hidden/x.tf": "no",
        "live/.cache/x.tf": "no",
        **{f"{name}/x.tf": "no" for name in SKIP_DIRECTORIES},
        **{f"live/{name}/x.tf": "no" for name in SKIP_DIRECTORIES},
    }.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text, encoding="utf-8")
    return folder


FOUND = [
    ".hidden.tf", ".terraform.lock.hcl", "_x.tf", "live/eu/deep/er/vars.tfvars", "live/eu/terragrunt.hcl",
    "live/us/terragrunt.hcl", "main.tf",
]


def paths_of(frame):
    return sorted(r.path for r in frame.collect())


def test_tree(spark, root):
    rows = {r.path: r for r in read_directory_tree(spark, str(root)).collect()}
    assert sorted(rows) == FOUND
    r = rows["live/eu/terragrunt.hcl"]
    assert (r.file_type, r.repository, r.content, r.size, r.sha) == ("terragrunt", "checkout", "é", 2, None)
    assert r.url == f"file://{root}/live/eu/terragrunt.hcl"
    assert rows[".terraform.lock.hcl"].file_type == "terraform"


def test_filters(spark, root):
    assert paths_of(read_directory_tree(spark, str(root), file_types=["terragrunt"])) == [
        "live/eu/terragrunt.hcl", "live/us/terragrunt.hcl",
    ]
    assert paths_of(read_directory_tree(spark, str(root), file_types=[])) == FOUND
    assert paths_of(read_directory_tree(spark, str(root), include=["^live/"], exclude=["us/"])) == [
        "live/eu/deep/er/vars.tfvars", "live/eu/terragrunt.hcl",
    ]


def test_links(spark, root, tmp_path):
    outside = tmp_path / "shared"
    outside.mkdir()
    (outside / "s.tf").write_text("s")
    (outside / "sub").mkdir()
    (outside / "sub" / "t.tf").write_text("t")
    os.symlink(outside / "s.tf", root / "linked.tf")
    os.symlink(outside / "s.tf", root / "linked.txt")
    os.symlink(root / "missing.tf", root / "broken.tf")
    os.symlink(outside, root / "shared")
    os.symlink(root / "live" / "us", root / "again")  # inside the root: rows twice
    os.symlink(root / "live" / "us", root / "build2")
    os.symlink(root / "live", outside / "nested")  # a link in a linked directory is not followed
    os.symlink(root, root / "live" / "us" / "loop")
    got = paths_of(read_directory_tree(spark, str(root)))
    # through the loop everything below the root once more, under its own path
    expected = sorted(
        FOUND + ["linked.tf", "../shared/s.tf", "../shared/sub/t.tf"] + ["live/us/terragrunt.hcl"] * 2
        + FOUND + ["linked.tf"]
    )
    assert got == expected


def test_bad_roots(spark, root, tmp_path):
    with pytest.raises(FileNotFoundError, match="Directory does not exist: "):
        read_directory_tree(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError, match="Unable to access directory: .* - Path is not a directory: "):
        read_directory_tree(spark, str(root / "main.tf"))


def test_unreadable_entries(spark, root):
    if os.geteuid() == 0:
        pytest.skip("root reads everything")
    (root / "live" / "us").chmod(0)
    try:
        assert "live/us/terragrunt.hcl" not in paths_of(read_directory_tree(spark, str(root)))
        errors = tree_errors(read_tree(spark, str(root))).collect()
        assert [(r.kind, r.path) for r in errors] == [("directory", "live/us")]
    finally:
        (root / "live" / "us").chmod(0o755)


def test_failed_file_is_an_error_row(spark, root, monkeypatch):
    os.symlink("/proc/self/mem", root / "proc.tf")  # opens, but cannot be read from its start
    rows = {r.path: r for r in read_tree(spark, str(root)).collect()}
    assert rows["proc.tf"].content is None and "Failed to read file" in rows["proc.tf"].error
    assert rows["main.tf"].error is None
    assert [(r.kind, r.path) for r in tree_errors(read_tree(spark, str(root))).collect()] == [("file", "proc.tf")]


def test_many_directories_make_few_tasks(spark, tmp_path):
    for i in range(700):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.tf").write_text("x = 1\n" * (i % 5))
    listed = list_tree(spark, str(tmp_path), tasks=16)
    assert listed.rdd.getNumPartitions() <= 16 and listed.where("kind = 'file'").count() == 700
    (tmp_path / "big.tf").write_text("y" * (9 << 20))
    rows = read_tree(spark, str(tmp_path)).selectExpr("path", "length(content) AS n", "size", "error").collect()
    assert len(rows) == 701 and {r.n for r in rows if r.path == "big.tf"} == {9 << 20}
    assert sum(r.n for r in rows if r.path != "big.tf") == sum(6 * (i % 5) for i in range(700)) and not any(r.error for r in rows)


def made_tree(folder, directories):
    for path, count in directories.items():
        (folder / path).mkdir(parents=True, exist_ok=True)
        for i in range(count):
            (folder / path / f"{i}.tf").write_text("")


@pytest.mark.parametrize("budget", [1, 7, 10**6])
def test_rounds_find_what_one_walk_finds(spark, root, tmp_path, budget):
    os.symlink(root / "live", tmp_path / "to_live")
    os.symlink(tmp_path / "to_live", root / "linked")
    whole = sorted((r.kind, r.path) for r in list_tree(spark, str(root)).collect())
    assert sorted((r.kind, r.path) for r in list_tree(spark, str(root), budget=budget).collect()) == whole and len(whole) > 10


def test_a_deep_chain(spark, tmp_path):
    """Deeper than Python recurses."""
    made = [tmp_path]
    for _ in range(1_200):
        made.append(made[-1] / "d")
        made[-1].mkdir()
    (made[-1] / "end.tf").write_text("")
    names = [r.path for r in list_tree(spark, str(tmp_path), budget=500).collect()]
    (made[-1] / "end.tf").unlink()
    for folder in reversed(made[1:]):  # such a chain is too deep for some clean-ups
        folder.rmdir()
    assert names == ["/".join(["d"] * 1_200 + ["end.tf"])]


def test_a_lopsided_tree_is_dealt_evenly(spark, tmp_path, monkeypatch):
    """One directory has nearly all; after a few entries its parts are handed to all tasks."""
    made_tree(tmp_path, {"small": 1, **{f"big/sub/d{i}": 20 for i in range(60)}})
    landed = []

    def watched(rows, label):
        landed.append(land(rows, label))
        return landed[-1]

    land = tree.land
    monkeypatch.setattr(tree, "land", watched)
    assert list_tree(spark, str(tmp_path), tasks=6, budget=40).count() == 1201
    per_task = [r.n for r in landed[-1].groupBy(F.input_file_name()).agg(F.count_if(F.col("kind") == "file").alias("n")).collect()]
    assert len(per_task) >= 5 and max(per_task) <= 0.5 * sum(per_task)


def test_an_unreadable_directory_is_a_row(tmp_path, monkeypatch):
    made_tree(tmp_path, {"ok": 1, "bad": 1})
    scandir = os.scandir

    def denied(path):
        if str(path).endswith("bad"):
            raise PermissionError("denied")
        return scandir(path)

    monkeypatch.setattr(os, "scandir", denied)
    frames = tree._walk(str(tmp_path), 100)([pd.DataFrame([("open", str(tmp_path))], columns=["kind", "full_path"])])
    rows = [tuple(row) for frame in frames for row in frame[["kind", "path", "error"]].itertuples(index=False)]
    assert sorted(rows, key=str) == [("file", "ok/0.tf", None), ("unreadable", "bad", "denied")]
