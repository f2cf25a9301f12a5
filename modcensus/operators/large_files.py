"""Module calls of very large files, many tasks to a file.

A block ends at a closing brace, so a text is cut behind closing braces, into pieces of about ``PIECE``
characters that are dealt to all tasks. Only a quoted name may hold a brace: a cut may stand inside of
the name of a block that began before. What each piece says about its end (a name is open, none is, or
as before it, where it has no quote) is carried on over the pieces of a file, as are line feeds and
blocks; pieces that an open name ties together are put together again, all others are searched where
they are. The sums of the pieces before are added to the found calls.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modcensus.fixed import SPACE, TERRAFORM
from modcensus.functions.text import newlines
from modcensus.operators.extract import block_count, module_calls
from modcensus.operators.joins import join_single
from modcensus.runtime import land

PIECE = 1 << 20  # characters
LARGE = 1 << 26  # bytes from which on a file is worth the further passes


def _cut(content: Column, piece: int) -> Column:
    """The text in pieces of ``piece`` characters and what follows up to the next closing brace."""
    return F.regexp_extract_all(content, F.lit(rf"(?s).{{{piece}}}[^}}]*+\}}|.+"), F.lit(0))


def _name_open(content: Column) -> Column:
    """Whether the name of a block is open at a piece's end, NULL where the piece has no quote."""
    rest = F.length(F.substring_index(content, '"', -1))
    before = F.left(content, F.length(content) - rest - 1)
    opened = (F.col("file_type") == TERRAFORM) & before.rlike(rf"module{SPACE}+\z")
    return F.when(F.contains(content, F.lit('"')), opened)


def file_pieces(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """Each file's columns, its number ``_file``, and ``_piece`` and ``content`` of its pieces, landed and evenly spread."""
    others = [name for name in files.columns if name != "content"]
    numbered = files.where(F.col("content") != "").withColumn("_file", F.monotonically_increasing_id())
    pieces = numbered.select(*others, "_file", F.posexplode(_cut(F.col("content"), piece)).alias("_piece", "content"))
    # landed, as numbers of files must not change while their pieces are searched; with a number of tasks of
    # its own, as adaptive execution would merge texts that compress well
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return land(land(pieces, "pieces").repartition(tasks, "_file", "_piece"), "spread-pieces")


def stitched_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces again, those put together between which a name is open; ``_piece`` is that of the first."""
    ends = pieces.select("_file", "_piece", _name_open(F.col("content")).alias("_open"))
    order = Window.partitionBy("_file").orderBy("_piece")
    ends = ends.withColumn("_open", F.coalesce(F.last("_open", ignorenulls=True).over(order), F.lit(False)))
    ends = ends.withColumn("_tied", F.coalesce(F.lag("_open").over(order), F.lit(False)))
    firsts = F.max(F.when(~F.col("_tied"), F.col("_piece"))).over(order)
    tied = land(ends.withColumn("_first", firsts).where("_open OR _tied").select("_file", "_piece", "_first"), "tied")
    key = ["_file", "_piece"]
    others = [name for name in pieces.columns if name not in (*key, "content")]
    parts = pieces.join(tied, key).groupBy("_file", "_first", *others).agg(F.sort_array(F.collect_list(F.struct("_piece", "content"))).alias("_parts"))
    together = parts.select(*others, "_file", F.col("_first").alias("_piece"), F.array_join("_parts.content", "").alias("content"))
    return pieces.join(tied, key, "left_anti").unionByName(together)


def large_file_calls(files: DataFrame, carry: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """The rows of ``module_calls``, for files that one task should not search alone."""
    carry = carry or []
    columns = ["file_type", "repository", "path", "content", "url", *carry]
    pieces = stitched_pieces(file_pieces(files.select(*columns), piece))
    before = Window.partitionBy("_file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.select("_file", "_piece", newlines(F.col("content")).alias("_lines"), block_count().alias("_blocks"))
    sums = sums.select("_file", "_piece", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in ("_lines", "_blocks")))
    calls = module_calls(pieces, carry=[*carry, "_file", "_piece"])
    moved = {
        "line_number": (F.col("line_number") + F.col("_lines")).cast("int"),
        "block_pos": (F.col("block_pos") + F.col("_blocks")).cast("int"),
    }
    return join_single(calls, sums, ["_file", "_piece"], "inner", spread=["block_pos"], salts=2).withColumns(moved).drop("_file", "_piece", "_lines", "_blocks")


def calls_of_any_size(files: DataFrame, carry: list[str] | None = None, large: int = LARGE, piece: int = PIECE) -> DataFrame:
    """``module_calls`` for files of up to ``large`` bytes, pieces for larger ones. ``size`` is used where it is known."""
    size = F.coalesce("size", F.octet_length("content"))
    small = module_calls(files.where((size <= large) | size.isNull()), carry)
    return small.unionByName(large_file_calls(files.where(size > large), carry, piece))
