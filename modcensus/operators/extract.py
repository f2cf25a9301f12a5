"""Module calls out of file contents.

Extraction is one narrow pass: no shuffle, every file read once whatever its kind,
and the content is dropped before the per-file arrays are exploded.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.fixed import (
    SOURCE_ATTRIBUTE,
    TERRAFORM,
    TERRAFORM_BLOCK,
    TERRAGRUNT,
    TERRAGRUNT_BLOCK,
    VERSION_ATTRIBUTE,
)
from modcensus.functions.classify import call_version, source_type, terragrunt_name
from modcensus.functions.text import first_group, newlines, strip_space
from modcensus.runtime import evaluated

_BLOCK = {TERRAFORM: TERRAFORM_BLOCK, TERRAGRUNT: TERRAGRUNT_BLOCK}
_KEYWORD = {TERRAFORM: "module", TERRAGRUNT: "terraform"}
CHUNK = 256


def _by_type(value) -> Column:
    kind = F.col("file_type")
    return F.when(kind == TERRAFORM, value(TERRAFORM)).when(kind == TERRAGRUNT, value(TERRAGRUNT))


def _may_have_calls() -> Column:
    """Cheap substring test that spares most files the pattern search."""
    kind, content = F.col("file_type"), F.col("content")
    per_type = [(kind == t) & content.contains(_KEYWORD[t]) for t in _BLOCK]
    return content.contains("source") & reduce(Column.__or__, per_type)


def _running_starts(steps: Column) -> Column:
    """(starts, line): where each step begins when counting from line 0, and the line after all of them."""
    nothing = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("line"))
    return F.aggregate(
        steps,
        nothing,
        lambda seen, step: F.struct(
            F.array_append(seen["starts"], seen["line"] + step["before"]).alias("starts"),
            (seen["line"] + step["before"] + step["inside"]).alias("line"),
        ),
    )


def _steps(blocks: Column, gaps: Column) -> Column:
    """Line feeds before and inside of every block."""
    return F.zip_with(
        blocks,
        F.slice(gaps, F.lit(1), F.size(blocks)),
        lambda block, gap: F.struct(newlines(gap).alias("before"), newlines(block).alias("inside")),
    )


def _chunks(steps: Column) -> Column:
    """Running line counts within chunks of ``CHUNK`` blocks.

    Appending to an array copies it, so one run over all blocks of a huge file would take
    quadratic time.
    """
    firsts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(CHUNK)))
    return F.transform(firsts, lambda first: _running_starts(F.slice(steps, first, F.lit(CHUNK))))


def _block_starts(chunks: Column) -> Column:
    """Line number of every block start: each chunk moves by the lines of those before it."""
    whole = F.transform(
        chunks, lambda chunk: F.struct(F.lit(0).alias("before"), chunk["line"].alias("inside"))
    )
    moved = F.zip_with(
        chunks,
        _running_starts(whole)["starts"],
        lambda chunk, offset: F.transform(chunk["starts"], lambda line: line + offset + 1),
    )
    return F.flatten(moved)


def block_count() -> Column:
    """Number of blocks in ``content``, with a source or without."""
    return _by_type(lambda t: F.regexp_count("content", F.lit(_BLOCK[t])))


def _sourced_blocks(files: DataFrame, with_lines: bool) -> DataFrame:
    """One row per block that names a source, with ``_block``, ``_body`` and ``source``."""
    keep = [c for c in files.columns if c != "content"]
    content = F.col("content")
    blocks = _by_type(lambda t: F.regexp_extract_all(content, F.lit(_BLOCK[t]), F.lit(0)))
    hits = files.where(_may_have_calls())
    if with_lines:
        gaps = _by_type(lambda t: F.split(content, _BLOCK[t], -1))
        # one projection each: an expression used twice stays in its own and is computed once
        found = hits.select(*keep, blocks.alias("_blocks"), gaps.alias("_gaps"))
        found = found.select(*keep, "_blocks", _steps(F.col("_blocks"), F.col("_gaps")).alias("_steps"))
        found = found.select(*keep, "_blocks", _chunks(F.col("_steps")).alias("_chunks"))
        starts = _block_starts(F.col("_chunks"))
        pairs = F.arrays_zip(F.col("_blocks").alias("block"), starts.alias("line"))
        rows = found.select(*keep, F.posexplode(pairs).alias("block_pos", "_hit")).select(
            *keep, "block_pos", F.col("_hit.block").alias("_block"), F.col("_hit.line").alias("line_number")
        )
    else:
        rows = hits.select(*keep, F.explode(blocks).alias("_block"))

    # a Terraform header ends its only quoted text with the second quote; neither the rest of a
    # header nor the closing brace can add to a match of the attribute patterns
    block = F.col("_block")
    after_name = F.substr(block, F.length(F.substring_index(block, '"', 2)) + 2)
    body = _by_type(lambda t: after_name if t == TERRAFORM else block)
    source = F.regexp_extract("_body", SOURCE_ATTRIBUTE, 1)
    rows = evaluated(rows, _body=body)
    rows = evaluated(rows, source=_by_type(lambda t: source if t == TERRAFORM else strip_space(source)))
    return rows.where(F.col("source") != "")


def _version() -> Column:
    """Terragrunt blocks have no version attribute; what looks like one is ignored."""
    attribute = F.when(F.col("file_type") == TERRAFORM, first_group(F.col("_body"), VERSION_ATTRIBUTE))
    return call_version(F.col("source"), attribute)


def module_calls(files: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """All module calls of Terraform and Terragrunt files (table ``module_calls``).

    ``carry`` names further columns of ``files`` to keep.
    """
    carry = carry or []
    columns = ["file_type", "repository", "path", "content", "url", *carry]
    rows = _sourced_blocks(files.select(*columns), with_lines=True)
    source = F.col("source")
    name = _by_type(
        lambda t: F.substring_index(F.substring_index("_block", '"', 2), '"', -1)
        if t == TERRAFORM
        else terragrunt_name(F.col("path"), source)
    )
    return rows.select(
        name.alias("name"),
        "source",
        source_type(source).alias("source_type"),
        _version().alias("version"),
        "repository",
        F.col("path").alias("file_path"),
        F.col("url").alias("file_url"),
        "line_number",
        F.col("file_type").alias("type"),
        "block_pos",
        *carry,
    )


def terraform_calls(files: DataFrame) -> DataFrame:
    return module_calls(files.where(F.col("file_type") == TERRAFORM))


def terragrunt_calls(files: DataFrame) -> DataFrame:
    return module_calls(files.where(F.col("file_type") == TERRAGRUNT))


def union_calls(*calls: DataFrame) -> DataFrame:
    """Bag union of call frames, duplicates kept."""
    return reduce(DataFrame.unionByName, calls)


def file_sources(files: DataFrame) -> DataFrame:
    """Each file's columns but its content, and ``sources``: (source, version) of its calls in one array.

    For small state per file; the tables of calls come from ``module_calls``.
    """
    content = F.col("content")
    blocks = F.when(_may_have_calls(), _by_type(lambda t: F.regexp_extract_all(content, F.lit(_BLOCK[t]), F.lit(0))))

    def found(block: Column) -> Column:
        after_name = F.substr(block, F.length(F.substring_index(block, '"', 2)) + 2)
        body = _by_type(lambda t: after_name if t == TERRAFORM else block)
        text = F.regexp_extract(body, SOURCE_ATTRIBUTE, 1)
        source = _by_type(lambda t: text if t == TERRAFORM else strip_space(text))
        attribute = F.when(F.col("file_type") == TERRAFORM, first_group(body, VERSION_ATTRIBUTE))
        return F.struct(source.alias("source"), call_version(source, attribute).alias("version"))

    named = F.filter(F.transform(blocks, found), lambda call: call["source"] != "")
    return files.withColumn("sources", F.coalesce(named, F.array().cast("array<struct<source: string, version: string>>"))).drop("content")


def call_sources(files: DataFrame) -> DataFrame:
    """(type, source, version) of every call, without places.

    What the summaries need; spares the second pattern pass that line numbers cost.
    """
    rows = _sourced_blocks(files.select("file_type", "content"), with_lines=False)
    return rows.select(F.col("file_type").alias("type"), "source", _version().alias("version"))
