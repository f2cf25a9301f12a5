"""Directory trees as the ``iac_files`` table.

Spark's own file readers leave out names that start with a dot or an underscore, which a
scan has to see. So the tree is listed by tasks of our own, in rounds: each round lists the open
directories, dealt evenly to all tasks, and a task hands on what it has not opened after ``BUDGET``
entries. However the tree is shaped, a deep or large part of it is soon spread, and
the files are then read in tasks of even size.
"""

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modcensus.fixed import DIRECTORY_DENIED, NO_DIRECTORY, NOT_A_DIRECTORY, SKIP_DIRECTORIES
from modcensus.functions.classify import file_type
from modcensus.operators.files import keep_file_types, match_paths
from modcensus.runtime import land
from modcensus.schemas import IAC_FILES

LISTED = "kind STRING, path STRING, full_path STRING, error STRING"
READ = "path STRING, full_path STRING, is_directory BOOLEAN, body BINARY, size BIGINT, error STRING"
OPEN, LINKED = "open", "linked"  # directories still to be listed; linked ones are below a followed link
BUDGET = 5_000  # entries that one open directory, with what is below it, takes of a task


def _enters(name: str) -> bool:
    return name not in SKIP_DIRECTORIES and not name.startswith(".")


def check_root(root: str) -> None:
    """Raise unless ``root`` is a directory that can be read."""
    if not os.path.lexists(root):
        raise FileNotFoundError(NO_DIRECTORY.format(root))
    if not os.path.isdir(root):
        raise NotADirectoryError(NOT_A_DIRECTORY.format(root, root))
    if not os.access(root, os.R_OK):
        raise PermissionError(DIRECTORY_DENIED.format(root))


BATCH_BYTES, BATCH_FILES = 8 << 20, 1_000


def _walk(root: str, budget: int):
    """Lists open directories and what is below them, up to ``budget`` entries for each."""
    import pandas as pd

    def row(kind: str, path: str, error: str | None = None) -> tuple:
        return kind, os.path.relpath(path, root).replace(os.sep, "/"), path, error

    def listed(start: str, mode: str) -> Iterator[tuple]:
        stack, left = [(start, mode)], budget
        while stack:
            if left <= 0:
                yield from (row(kind, path) for path, kind in stack)
                return
            path, kind = stack.pop()
            try:
                with os.scandir(path) as found:
                    entries = sorted(found, key=lambda e: e.name, reverse=True)
            except OSError as problem:
                yield row("unreadable", path, str(problem))
                continue
            left -= len(entries) + 1
            for entry in entries:
                if entry.is_symlink():
                    # a link to a file counts under the link's path, one to a directory under the real path;
                    # below a followed link no further ones to directories are followed
                    target = os.path.realpath(entry.path)
                    if os.path.isfile(target):
                        yield row("file", entry.path)
                    elif kind == OPEN and os.path.isdir(target) and _enters(entry.name):
                        stack.append((target, LINKED))
                elif entry.is_file():
                    yield row("file", entry.path)
                elif entry.is_dir() and _enters(entry.name):
                    stack.append((entry.path, kind))

    def walk(batches: Iterator) -> Iterator:
        for batch in batches:
            for path, kind in zip(batch["full_path"], batch["kind"]):
                yield pd.DataFrame(list(listed(path, kind)), columns=["kind", "path", "full_path", "error"], dtype=object)

    return walk


def _read_bodies(batches: Iterator) -> Iterator:
    """Bytes of the listed files, in batches of about ``BATCH_BYTES``; a larger file is one of its own."""
    import pandas as pd

    def made(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["path", "full_path", "is_directory", "body", "size", "error"])
        return frame.astype({"size": "Int64"})

    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for kind, path, full_path, problem_before in zip(batch["kind"], batch["path"], batch["full_path"], batch["error"]):
            if kind != "file":
                rows.append((path, full_path, True, None, None, problem_before))
                continue
            try:
                with open(full_path, "rb") as file:
                    body = file.read()
                row = (path, full_path, False, body, os.stat(full_path).st_size, None)
            except OSError as problem:
                row = (path, full_path, False, None, None, f"Failed to read file: {full_path} - {problem}")
            size = len(row[3] or b"")
            if rows and (held + size > BATCH_BYTES or len(rows) >= BATCH_FILES):
                yield made(rows)
                rows, held = [], 0
            rows.append(row)
            held += size
        if rows:
            yield made(rows)


def list_tree(spark: SparkSession, root: str, tasks: int | None = None, budget: int = BUDGET) -> DataFrame:
    """Names below ``root`` and directories that cannot be read; every executor must see the folder under the same path.

    Each round is landed, so a lost executor does not list a tree that has changed meanwhile.
    """
    root = os.path.abspath(root)
    check_root(root)
    tasks = tasks or spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(OPEN, root)], "kind STRING, full_path STRING")
    listed = None
    while listed is None or frontier.head(1):
        dealt = frontier.select("kind", "full_path").repartition(tasks, "full_path")
        found = land(dealt.mapInPandas(_walk(root, budget), LISTED), "tree")
        names = found.where(~F.col("kind").isin(OPEN, LINKED))
        listed = names if listed is None else listed.unionByName(names)
        frontier = found.where(F.col("kind").isin(OPEN, LINKED))
    return listed


def read_tree(
    spark: SparkSession,
    root: str,
    file_types: list[str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Files with ``content`` or ``error``; names are filtered before anything is read.

    Directories that could not be listed are rows too, with an ``error`` and without a ``file_type``: one
    pass over the tree gives all that a scan has to tell.
    """
    root = os.path.abspath(root)
    listed = list_tree(spark, root)
    names = match_paths(keep_file_types(listed.where(F.col("kind") == "file"), file_types, local=True), include, exclude)
    names = names.unionByName(listed.where(F.col("kind") == "unreadable"))
    spread = names.repartition(tasks or spark.sparkContext.defaultParallelism, "full_path")
    read = spread.mapInPandas(_read_bodies, READ)
    return read.select(
        F.when(~F.col("is_directory"), file_type(F.col("path"))).alias("file_type"),
        F.lit(os.path.basename(root)).alias("repository"),
        "path",
        F.make_valid_utf8(F.col("body").cast("string")).alias("content"),
        F.concat(F.lit("file://"), "full_path").alias("url"),
        F.lit(None).cast("string").alias("sha"),
        "size",
        "error",
    )


def read_directory_tree(spark: SparkSession, root: str, **filters) -> DataFrame:
    """The ``iac_files`` table of a directory. Links to directories inside it give repeated rows."""
    rows = read_tree(spark, root, **filters).where(F.col("error").isNull()).drop("error")
    return rows.to(spark.createDataFrame([], IAC_FILES).schema)


def tree_errors(read: DataFrame) -> DataFrame:
    """Directories that could not be listed and files that could not be read, of a landed ``read_tree``.

    The scan goes on without them. The tree is not listed again.
    """
    kind = F.when(F.col("file_type").isNull(), "directory").otherwise("file")
    return read.where(F.col("error").isNotNull()).select(kind.alias("kind"), "path", "error")
