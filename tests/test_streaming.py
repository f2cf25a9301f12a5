"""Incremental scans give the same tables as one scan."""

from modcensus.operators.extract import call_sources, file_sources, module_calls
from modcensus.operators.usage import usage_counts
from modcensus.schemas import IAC_FILES
from modcensus.streaming.incremental import landed_files, read_calls, read_usage, scan_incrementally
from modcensus.streaming.tracked import landed_versions, track_usage, tracked_usage


def test_incremental_scan(spark, tmp_path):
    landing, output, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    rows = [
        ("terraform", "r", f"{i}.tf", f'module "m" {{ source = "s{i % 3}?ref={i % 2}" }}\n' * (i % 4), "u", None, None)
        for i in range(20)
    ]
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, IAC_FILES).write.mode("append").parquet(landing)
        scan_incrementally(landed_files(spark, landing), output, checkpoint).awaitTermination()
    scan_incrementally(landed_files(spark, landing), output, checkpoint).awaitTermination()  # nothing new

    whole = module_calls(spark.createDataFrame(rows, IAC_FILES))
    key = str
    assert sorted(read_calls(spark, output).collect(), key=key) == sorted(whole.collect(), key=key)
    assert sorted(read_usage(spark, output).collect(), key=key) == sorted(usage_counts(whole).collect(), key=key)


def texts_of(numbers, mark):
    block = 'module "m" {{ source = "s{}?ref={}" version = "{}" }}\n'
    return [("terraform", "r", f"{i}.tf", block.format(i % 3, mark, i % 2) * (i % 4) + 'module "x" { source = "x" }', "u", f"{i}{mark}", None) for i in numbers]


def test_sources_of_files_are_those_of_the_calls(spark):
    rows = spark.createDataFrame([*texts_of(range(9), 1), ("terragrunt", "r", "a.hcl", 'terraform { source = " y?ref=2 " }', "u", None, None), ("terraform", "r", "n.tf", None, "u", None, None)], IAC_FILES)
    found = file_sources(rows).selectExpr("file_type AS type", "inline(sources)")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, call_sources(rows).collect()))
    assert file_sources(rows).count() == 11


def test_replaced_and_repeated_files_count_once(spark, tmp_path):
    landing, output, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    first, second = texts_of(range(12), 1), texts_of(range(4, 8), 2)
    emptied = [("terraform", "r", "9.tf", "nothing", "u", "new", None), ("terraform", "r", "10.tf", None, "u", "none", None)]
    now: dict = {}
    for part in (first[:6], first[2:], second, first[:3], [*emptied, *second]):  # some again, some with other contents
        spark.createDataFrame(part, IAC_FILES).coalesce(1).write.mode("append").parquet(landing)
        # each run is a restart from the checkpoint
        track_usage(landed_versions(spark, landing), output, checkpoint).awaitTermination()
        now |= {row[2]: row for row in part}
        whole = usage_counts(call_sources(spark.createDataFrame(list(now.values()), IAC_FILES)))
        assert sorted(map(repr, tracked_usage(spark, output).collect())) == sorted(map(repr, whole.collect()))
