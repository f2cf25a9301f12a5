"""CSV, JSON and report as frames of text lines, and their writers.

Every format is a frame of lines in the order of its partitions; each row is sorted once, and the
part files in name order are the document. No row gathers a whole report: in JSON a source and each of its
versions are lines of their own.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.fixed import FILE_TYPES, TERRAFORM, TERRAGRUNT
from modcensus.functions.links import file_link
from modcensus.functions.text import in_locale_order
from modcensus.operators.calls import report_order, sorted_calls
from modcensus.operators.extract import call_sources, module_calls
from modcensus.operators.joins import FEW_SALTS, join_single
from modcensus.operators.usage import (
    file_type_share,
    merged_summary,
    normalized_summary,
    observed_files,
    scan_counts,
    source_type_share,
    summary_order,
    usage_counts,
    watched_files,
)
from modcensus.runtime import land, landed_tables, with_position

# --- fixed values: output formats ------------------------------------------------
CSV_HEADER = "module,source_type,file_type,version,repository,file_path,line_number,file_link"
REPORT_KINDS = {
    frozenset([TERRAFORM]): "Terraform",
    frozenset([TERRAGRUNT]): "Terragrunt",
    frozenset([TERRAFORM, TERRAGRUNT]): "Infrastructure as Code",
}
REPORT_RULE = "============================"


@dataclass(frozen=True)
class ScanInfo:
    """What a report says about the scan itself."""

    platform: str
    source: str
    target: str
    scope: str
    repository_pattern: str | None = None
    timestamp: str | None = None
    file_types: list[str] = field(default_factory=lambda: list(FILE_TYPES))

    def __post_init__(self) -> None:
        if frozenset(self.file_types) not in REPORT_KINDS:
            raise ValueError(f"file_types must be some of {FILE_TYPES}, not {self.file_types!r}")

    @property
    def both_types(self) -> bool:
        return set(self.file_types) == set(FILE_TYPES)


# --- CSV ---------------------------------------------------------------------------


def _csv_columns() -> dict[str, Column]:
    return {
        "module": F.col("source"),
        "source_type": F.col("source_type"),
        "file_type": F.col("type"),
        "version": F.coalesce("version", F.lit("")),
        "repository": F.col("repository"),
        "file_path": F.col("file_path"),
        "line_number": F.col("line_number"),
        "file_link": file_link(F.col("file_url"), F.col("line_number")),
    }


def csv_rows(calls: DataFrame) -> DataFrame:
    """The eight columns of the CSV export."""
    return calls.select(*[value.alias(name) for name, value in _csv_columns().items()])


def csv_line() -> Column:
    """CSV line of a call. Inner quotes are doubled, so that the line can be read back."""
    def cell(name: str, value: Column) -> Column:
        if name == "line_number":
            return value.cast("string")
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    return F.concat_ws(",", *[cell(name, value) for name, value in _csv_columns().items()])


def csv_lines(calls: DataFrame) -> DataFrame:
    """Lines of the CSV export, sorted: the header, then the calls."""
    header = calls.sparkSession.range(1).select(
        F.lit(0).alias("_section"),
        *[F.lit(None).cast(column.dataType).alias(column.name) for column in calls.schema],
        F.lit(CSV_HEADER).alias("value"),
    )
    rows = calls.select(F.lit(1).alias("_section"), *calls.columns, csv_line().alias("value"))
    return header.unionByName(rows).orderBy("_section", *report_order()).select("value")


# --- JSON --------------------------------------------------------------------------


def json_text(text: Column) -> Column:
    """JSON string literal, with its quotes."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _json_fields() -> dict[str, Column]:
    return {
        "name": F.col("name"),
        "source": F.col("source"),
        "sourceType": F.col("source_type"),
        "version": F.col("version"),
        "repository": F.col("repository"),
        "filePath": F.col("file_path"),
        "fileUrl": F.col("file_url"),
        "lineNumber": F.col("line_number"),
        "type": F.col("type"),
    }


def json_modules(calls: DataFrame) -> DataFrame:
    """Calls with the field names of the JSON export."""
    return calls.select(*[value.alias(name) for name, value in _json_fields().items()])


def json_object() -> Column:
    """JSON object of a call; an absent version is left out."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in _json_fields().items()]))


def json_module_lines(calls: DataFrame) -> DataFrame:
    """One JSON object per call, in report order: the ``modules`` data set of large scans."""
    return sorted_calls(calls).select(json_object().alias("value"))


def _comma_unless(last: Column) -> Column:
    return F.when(last, "").otherwise(",")


def _json_head(counts: DataFrame, info: ScanInfo) -> DataFrame:
    def entry(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'    "{name}": '), value)

    texts = {
        "platform": info.platform,
        "source": info.source,
        "target": info.target,
        "scope": info.scope,
        "repoPattern": info.repository_pattern,
    }
    stamp = F.lit(info.timestamp) if info.timestamp else F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    )
    numbers = {
        "moduleCount": "module_count",
        "fileCount": "file_count",
        "terraformModuleCount": "terraform_module_count",
        "terragruntModuleCount": "terragrunt_module_count",
        "terraformFileCount": "terraform_file_count",
        "terragruntFileCount": "terragrunt_file_count",
    }
    entries = [entry(name, json_text(F.lit(text))) for name, text in texts.items() if text is not None]
    entries.append(entry("timestamp", json_text(stamp)))
    entries += [entry(name, F.col(column).cast("string")) for name, column in numbers.items()]
    head = F.concat(
        F.lit('{\n  "metadata": {\n'), F.concat_ws(",\n", *entries), F.lit('\n  },\n  "modules": [')
    )
    return counts.select(head.alias("value"))


def _json_module_rows(calls: DataFrame) -> DataFrame:
    """Objects in report order, each with the end of the one before it; the last is ended by what follows.

    So no row has to know whether it is the last, only whether it is the first of all: that one is in the first
    place of the sort's first partition.
    """
    def entry(name: str, value: Column) -> Column:  # NULL, and so left out, without a value
        shown = value.cast("string") if name == "lineNumber" else json_text(value)
        return F.concat(F.lit(f'      "{name}": '), F.when(value.isNotNull(), shown))

    entries = F.concat_ws(",\n", *[entry(name, value) for name, value in _json_fields().items()])
    is_first = F.monotonically_increasing_id() == 0
    before = F.when(is_first, "").otherwise("    },\n")
    return sorted_calls(calls).select(F.concat(before, F.lit("    {\n"), entries).alias("value"))


def _json_summary_rows(usage: DataFrame) -> DataFrame:
    """Opening line per source, a line per version, and a closing line per versioned source."""
    summary = land(merged_summary(usage), "summary")
    totals = summary.where(F.col("entry") == "total").drop("entry", "version")
    versions = summary.where(F.col("entry") == "version").drop("entry")
    last_version = versions.groupBy("source").agg(
        F.max_by("version", in_locale_order(F.col("version"))).alias("_last_version")
    )
    source = F.col("source")
    last_source = (  # one row
        totals.orderBy(in_locale_order(source).desc(), source.desc())
        .limit(1)
        .select("source", F.lit(True).alias("_is_last"))
    )
    sources = totals.join(last_version, "source", "left").join(F.broadcast(last_source), "source", "left")
    versioned = F.col("_last_version").isNotNull()
    comma = _comma_unless(F.coalesce("_is_last", F.lit(False)))
    opening = F.concat(
        F.lit("    "), json_text(source), F.lit(': {\n      "count": '), F.col("n").cast("string"),
        F.lit(',\n      "versions": {'), F.when(versioned, "").otherwise(F.concat(F.lit("}\n    }"), comma)),
    )
    closing = F.when(versioned, F.concat(F.lit("      }\n    }"), comma))
    lines = F.array(
        F.struct(F.lit(0).alias("_rank"), opening.alias("value")),
        F.struct(F.lit(2).alias("_rank"), closing.alias("value")),
    )
    version = F.concat(
        F.lit("        "), json_text(F.col("version")), F.lit(": "), F.col("n").cast("string"),
        _comma_unless(F.col("version") == F.col("_last_version")),
    )
    return (
        sources.select("source", F.lit(None).cast("string").alias("version"), F.inline(lines))
        .where(F.col("value").isNotNull())
        .unionByName(
            join_single(
                versions, last_version, ["source"], "inner", spread=["version"], salts=FEW_SALTS
            ).select(
                "source", "version", F.lit(1).alias("_rank"), version.alias("value")
            )
        )
    )


def json_lines(calls: DataFrame, files: DataFrame, info: ScanInfo, file_counts: DataFrame | None = None) -> DataFrame:
    """Lines of the JSON document, in the order of partitions. ``calls`` is read twice: pass a landed table.

    Each section is sorted once and by itself; partitions of a union follow each other, so nothing is sorted
    over sections.
    """
    usage = land(usage_counts(calls), "usage")
    last_end = F.when(F.count(F.lit(1)) > 0, "    }\n").otherwise("")
    between = usage.agg(F.concat(last_end, F.lit('  ],\n  "summary": {')).alias("value"))
    end = calls.sparkSession.range(1).select(F.lit("  }\n}").alias("value"))
    sections = [
        _json_head(scan_counts(files, usage, file_counts), info),
        _json_module_rows(calls),
        between,
        _json_summary_rows(usage).orderBy(*summary_order("source", "_rank")).select("value"),
        end,
    ]
    return reduce(DataFrame.unionAll, sections)


# --- report ------------------------------------------------------------------------


def _report_head(counts: DataFrame, info: ScanInfo) -> DataFrame:
    def total(text: str, what: str) -> Column:
        plain = F.concat(F.lit(text), F.col(f"{what}_count").cast("string"))
        if not info.both_types:
            return plain
        split = F.format_string(
            " (%d Terraform, %d Terragrunt)", f"terraform_{what}_count", f"terragrunt_{what}_count"
        )
        return F.concat(plain, split)

    lines = [
        F.lit(f"\n{REPORT_KINDS[frozenset(info.file_types)]} Module Usage Report"),
        F.lit(REPORT_RULE),
        F.lit(f"Platform: {info.platform}"),
        F.lit(f"Target: {info.target}"),
        F.lit(f"Scope: {info.scope}"),
        F.lit(f"Repository filter: {info.repository_pattern}") if info.repository_pattern else None,
        total("Total modules found: ", "module"),
        total("Total files analyzed: ", "file"),
        F.lit("\nModule Summary by Source:"),
    ]
    return counts.select(F.posexplode(F.array(*[line for line in lines if line is not None])).alias("rank", "text"))


def _report_sources(usage: DataFrame) -> DataFrame:
    summary = normalized_summary(usage)
    title = F.concat(
        F.lit("\n"), F.col("module"),
        F.format_string(" (%d instances, type: %s)", "n", "source_type"),
    )
    below = F.when(F.col("versioned"), "  Versions:").otherwise("  No version constraints found")
    version = F.concat(F.lit("    - "), F.col("version"), F.format_string(": %d instances", "n"))
    lines = F.when(F.col("entry") == "total", F.array(title, below)).otherwise(F.array(version))
    return summary.select(
        "module", "version", F.posexplode(lines).alias("_at", "text"), "entry"
    ).select(
        F.col("module").alias("source"),
        F.when(F.col("entry") == "total", F.col("_at")).otherwise(2).alias("rank"),
        "version",
        "text",
    )


def _share_line(label: str) -> Column:
    return F.concat(
        F.lit("  "), F.col(label), F.format_string(": %d modules (%s%%)", "n", "percent")
    )


def _with_title(lines: DataFrame, title: str) -> DataFrame:
    first = lines.sparkSession.range(1).select(F.lit(0).alias("rank"), F.lit(title).alias("text"))
    return first.unionByName(lines)


def report_rows(files: DataFrame, usage: DataFrame, info: ScanInfo, file_counts: DataFrame | None = None) -> DataFrame:
    """Lines of the text report with their sort keys. ``usage`` is read several times: pass a landed table."""
    parts = [
        _report_head(scan_counts(files, usage, file_counts), info),
        _report_sources(usage),
        _with_title(
            source_type_share(usage).select("rank", _share_line("source_type").alias("text")),
            "\nModules by Source Type:",
        ),
    ]
    if info.both_types:
        parts.append(
            _with_title(
                file_type_share(usage).select("rank", _share_line("type").alias("text")),
                "\nModules by File Type:",
            )
        )
    rows = None
    for section, part in enumerate(parts):
        missing = {k: F.lit(None).cast("string") for k in ("source", "version") if k not in part.columns}
        part = part.withColumns({"section": F.lit(section), **missing}).select(
            "section", "source", "rank", "version", "text"
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def report_line_order() -> list[Column]:
    return [F.col("section"), *summary_order("source", "rank")]


def numbered_report(files: DataFrame, usage: DataFrame, info: ScanInfo) -> DataFrame:
    """Report lines with their number as ``line_no``."""
    return with_position(report_rows(files, usage, info), report_line_order(), "line_no").select(
        "section", "source", "line_no", "text"
    )


def report_lines(files: DataFrame, usage: DataFrame, info: ScanInfo, file_counts: DataFrame | None = None) -> DataFrame:
    """Lines of the text report, sorted."""
    rows = report_rows(files, usage, info, file_counts).orderBy(*report_line_order())
    return rows.select(F.col("text").alias("value"))


# --- export ------------------------------------------------------------------------


def document(files: DataFrame, info: ScanInfo, output_format: str = "table") -> DataFrame | None:
    """All lines of a scan as ``json``, ``csv`` or text report, in order; None without calls.

    Files are read once: metrics of that pass count them. Format names are not case-sensitive; an
    unknown one gives the report. The lines read landed tables: use them inside ``runtime.landed_tables``
    to have those removed at its end.
    """
    kind = output_format.lower()
    spark = files.sparkSession
    files, seen = watched_files(files)
    if kind in ("json", "csv"):
        calls = land(module_calls(files), "calls")
        if calls.isEmpty():
            return None
        return json_lines(calls, files, info, observed_files(spark, seen)) if kind == "json" else csv_lines(calls)
    # landed before they are counted: a pass without exchange counts its files reliably
    usage = land(usage_counts(land(call_sources(files), "sources")), "usage")
    return None if usage.isEmpty() else report_lines(files, usage, info, observed_files(spark, seen))


def export(files: DataFrame, info: ScanInfo, output_format: str, path: str) -> bool:
    """Write ``document`` as text files, whole. Without calls nothing is written, and the result is False."""
    with landed_tables(files.sparkSession):
        lines = document(files, info, output_format)
        if lines is None:
            return False
        lines.write.mode("overwrite").text(path)
        return True
