"""Summaries, distributions and order over small hand-made call tables."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from modcensus.operators import calls as call_ops
from modcensus.operators import usage
from modcensus.schemas import IAC_FILES, MODULE_CALLS


def calls_of(spark, rows):
    """rows: (type, source, version[, repository, path, line])"""
    full = []
    for i, row in enumerate(rows):
        kind, source, version, *place = row
        repository, path, line = place or ("org/r", f"{i}.tf", 1)
        full.append(("n", source, "unknown", version, repository, path, "u", line, kind, 0))
    return spark.createDataFrame(full, MODULE_CALLS)


def counts_of(spark, rows):
    return usage.usage_counts(calls_of(spark, rows))


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


ROWS = [
    ("terraform", "a", "1"),
    ("terraform", "a", "1"),
    ("terraform", "a", None),
    ("terraform", "b", None),
    ("terragrunt", "a", "2"),
    ("terragrunt", "c", "2"),
    ("terragrunt", "c", "3"),
]


def test_usage_counts(spark):
    assert rows_of(counts_of(spark, ROWS), "type", "source", "version", "n") == sorted(
        [
            ("terraform", "a", "1", 2),
            ("terraform", "a", None, 1),
            ("terraform", "b", None, 1),
            ("terragrunt", "a", "2", 1),
            ("terragrunt", "c", "2", 1),
            ("terragrunt", "c", "3", 1),
        ],
        key=str,
    )


def test_raw_summary(spark):
    assert rows_of(usage.raw_summary(counts_of(spark, ROWS)), "type", "source", "version", "n", "entry") == sorted(
        [
            ("terraform", "a", None, 3, "total"),
            ("terraform", "a", "1", 2, "version"),
            ("terraform", "b", None, 1, "total"),
            ("terragrunt", "a", None, 1, "total"),
            ("terragrunt", "a", "2", 1, "version"),
            ("terragrunt", "c", None, 2, "total"),
            ("terragrunt", "c", "2", 1, "version"),
            ("terragrunt", "c", "3", 1, "version"),
        ],
        key=str,
    )


def test_merged_summary_overrides_and_does_not_add(spark):
    assert rows_of(usage.merged_summary(counts_of(spark, ROWS)), "source", "version", "n", "entry") == sorted(
        [
            ("a", None, 1, "total"),
            ("a", "2", 1, "version"),
            ("b", None, 1, "total"),
            ("c", None, 2, "total"),
            ("c", "2", 1, "version"),
            ("c", "3", 1, "version"),
        ],
        key=str,
    )


def test_normalized_summary_adds_over_types_and_takes_the_first_kind(spark):
    rows = [
        ("terraform", "https://h/m.zip", None),  # archive, sorts first
        ("terraform", "https://h/m.zip?ref=1", "1"),  # unknown
        ("terragrunt", "https://h/m.zip?ref=1", "1"),
        ("terraform", "x", None),
    ]
    assert rows_of(
        usage.normalized_summary(counts_of(spark, rows)), "module", "source_type", "versioned", "version", "n"
    ) == sorted(
        [
            ("https://h/m.zip", "archive", True, None, 3),
            ("https://h/m.zip", None, None, "1", 2),
            ("x", "unknown", False, None, 1),
        ],
        key=str,
    )


def test_ranked_summary(spark):
    rows = [("terraform", s, v) for s, v in [("b", "10"), ("b", "9"), ("B", None), ("./z", "~> 1"), ("a", None)]]
    ranked = usage.ranked_summary(counts_of(spark, rows)).orderBy("position").collect()
    assert [(r.position, r.module, r.version) for r in ranked] == [
        (1, "./z", None), (2, "./z", "~> 1"), (3, "a", None), (4, "b", None), (5, "b", "10"), (6, "b", "9"), (7, "B", None),
    ]


def test_source_type_share(spark):
    rows = [("terraform", s, None) for s in ["z", "z", "./l", "./l", "acme/n/aws", "git::x", "git::y", "git::z"]]
    share = usage.source_type_share(counts_of(spark, rows)).orderBy("rank").collect()
    # local and unknown are level: the one with the first source comes first
    assert [(r.source_type, r.n, r.percent) for r in share] == [
        ("git", 3, "37.5"), ("local", 2, "25.0"), ("unknown", 2, "25.0"), ("registry", 1, "12.5"),
    ]


def test_percent_text(spark):
    pairs = [(n, whole) for whole in (1, 3, 7, 16, 200, 400, 1000, 2000, 4000, 8000) for n in range(whole + 1)]
    frame = spark.createDataFrame(pairs, "part BIGINT, whole BIGINT")
    got = [r.p for r in frame.select(usage.percent_text(F.col("part"), F.col("whole")).alias("p")).collect()]
    exact = [
        str(Decimal(n / whole * 100).quantize(Decimal("0.1"), ROUND_HALF_UP)) for n, whole in pairs
    ]
    assert got == exact
    assert dict(zip(pairs, got))[(3, 2000)] == "0.1" and dict(zip(pairs, got))[(1, 16)] == "6.3"


def test_file_type_share_lists_both(spark):
    share = usage.file_type_share(counts_of(spark, [("terraform", "a", None)]))
    assert rows_of(share, "rank", "type", "n", "percent") == [(1, "terraform", 1, "100.0"), (2, "terragrunt", 0, "0.0")]


def test_scan_counts_include_files_without_calls(spark):
    files = spark.createDataFrame(
        [(t, "r", p, "", "u", None, None) for t, p in [("terraform", "a"), ("terraform", "b"), ("terragrunt", "c")]],
        IAC_FILES,
    )
    row = usage.scan_counts(files, counts_of(spark, ROWS)).first()
    assert tuple(row) == (7, 3, 4, 3, 2, 1)
    assert tuple(usage.scan_counts(files.limit(0), counts_of(spark, ROWS).limit(0)).first()) == (0,) * 6


def test_unique_sources(spark):
    assert rows_of(usage.unique_sources(counts_of(spark, ROWS)), "type", "sources", "versioned_sources") == [
        ("terraform", 2, 1), ("terragrunt", 2, 2),
    ]


def test_report_order(spark):
    rows = [
        ("terraform", "a", None, "r", "p", 1),
        ("terraform", "a", "2", "r", "p", 9),
        ("terraform", "a", "10", "r", "p", 8),
        ("terraform", "A", "1", "r", "p", 1),
        ("terraform", "a", "2", "R", "p", 1),
        ("terraform", "a", "2", "r", "b", 7),
        ("terraform", "a", "2", "r", "b", 10),
    ]
    placed = call_ops.positioned_calls(calls_of(spark, rows)).orderBy("position").collect()
    assert [(r.source, r.version, r.repository, r.file_path, r.line_number) for r in placed] == [
        ("a", "10", "r", "p", 8),
        ("a", "2", "r", "b", 7),
        ("a", "2", "r", "b", 10),
        ("a", "2", "r", "p", 9),
        ("a", "2", "R", "p", 1),
        ("a", None, "r", "p", 1),
        ("A", "1", "r", "p", 1),
    ]
    assert [r.position for r in placed] == list(range(1, 8))
    assert [r.is_last for r in placed] == [False] * 6 + [True]
    plain = [r.line_number for r in call_ops.sorted_calls(calls_of(spark, rows)).collect()]
    assert plain == [r.line_number for r in placed]


def test_positions_over_many_partitions(spark):
    rows = spark.range(20000).select(
        F.lit("n").alias("name"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("git").alias("source_type"),
        F.lit(None).cast("string").alias("version"), F.lit("r").alias("repository"),
        F.format_string("%06d", F.col("id")).alias("file_path"), F.lit("u").alias("file_url"),
        F.lit(1).alias("line_number"), F.lit("terraform").alias("type"), F.lit(0).alias("block_pos"),
    )
    placed = call_ops.positioned_calls(rows.repartition(8)).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(1, 20001))
    keys = [(r.source, r.file_path) for r in placed]
    assert keys == sorted(keys)


def test_listed_file_type_ignores_the_repository(spark):
    rows = [
        ("terraform", "a", None, "r1", "p", 1),
        ("terragrunt", "a", None, "r2", "p", 1),
        ("terragrunt", "a", None, "r2", "q", 1),
        ("terragrunt", "b", None, "r1", "p", 1),
    ]
    got = call_ops.listed_file_type(calls_of(spark, rows))
    assert rows_of(got, "repository", "source", "file_path", "file_type") == [
        ("r1", "a", "p", "terraform"), ("r1", "b", "p", "terragrunt"), ("r2", "a", "p", "terraform"),
        ("r2", "a", "q", "terragrunt"),
    ]
