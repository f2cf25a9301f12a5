"""CSV, JSON and report as written documents."""

import csv
import io
import json
from contextlib import contextmanager

import pytest

from modcensus import runtime
from modcensus.operators.usage import file_type_share, usage_counts
from modcensus.operators.extract import module_calls
from modcensus.runtime import land
from modcensus.schemas import IAC_FILES
from modcensus.sinks import documents

INFO = documents.ScanInfo(
    platform="GitHub", source="github:acme", target="acme", scope="All repositories in acme",
    repository_pattern="infra", timestamp="2024-01-01T00:00:00.000Z",
)
FILES = [
    ("terraform", "o/r", "a.tf", 'module "n" {\n source = "b/c/d"\n version = "~> 1"\n}\nmodule "m" { source = "./x" }'),
    ("terraform", "o/r", "b.tf", 'module "k" { source = "B/c/d?ref=2" }\nmodule "k" { source = "both" }'),
    ("terragrunt", "o/q", "e/terragrunt.hcl", 'terraform { source = "both?x=1" }\nterraform { source = "both" }'),
    ("terraform", "o/r", "none.tf", "x = 1"),
]


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(*f, f"https://h/{f[2]}", None, None) for f in FILES], IAC_FILES)


def written(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))


def test_csv(files, tmp_path):
    assert documents.export(files, INFO, "CSV", str(tmp_path / "out"))
    text = written(tmp_path / "out")
    lines = text.splitlines()
    assert lines[0] == "module,source_type,file_type,version,repository,file_path,line_number,file_link"
    assert lines[1] == '"./x","local","terraform","","o/r","a.tf",5,"https://h/a.tf#L5"'
    assert [row[0] for row in csv.reader(lines[1:])] == ["./x", "b/c/d", "B/c/d?ref=2", "both", "both", "both?x=1"]
    assert [row[2] for row in csv.reader(lines[1:])][3:] == ["terragrunt", "terraform", "terragrunt"]


def test_csv_quotes_are_doubled(spark, files, tmp_path):
    calls = module_calls(files).selectExpr("* EXCEPT (repository)", "'a\"b' AS repository")
    text = "\n".join(r.value for r in documents.csv_lines(land(calls, "t")).collect())
    assert {row["repository"] for row in csv.DictReader(io.StringIO(text))} == {'a"b'}


def test_json(files, tmp_path):
    assert documents.export(files, INFO, "json", str(tmp_path / "out"))
    text = written(tmp_path / "out")
    document = json.loads(text)
    assert text.rstrip("\n") == json.dumps(document, indent=2, ensure_ascii=False)
    assert list(document["metadata"]) == [
        "platform", "source", "target", "scope", "repoPattern", "timestamp", "moduleCount", "fileCount",
        "terraformModuleCount", "terragruntModuleCount", "terraformFileCount", "terragruntFileCount",
    ]
    assert document["metadata"]["moduleCount"] == 6 and document["metadata"]["fileCount"] == 4
    assert document["modules"][0] == {
        "name": "m", "source": "./x", "sourceType": "local", "repository": "o/r", "filePath": "a.tf",
        "fileUrl": "https://h/a.tf", "lineNumber": 5, "type": "terraform",
    }
    assert document["modules"][1]["version"] == "~> 1"
    assert document["summary"] == {
        "./x": {"count": 1, "versions": {}},
        "b/c/d": {"count": 1, "versions": {"~> 1": 1}},
        "B/c/d?ref=2": {"count": 1, "versions": {"2": 1}},
        "both": {"count": 1, "versions": {}},  # Terragrunt's entry only
        "both?x=1": {"count": 1, "versions": {}},
    }


def test_json_lines_with_several_versions(spark):
    text = "".join(f'module "a" {{ source = "s" version = "{v}" }}\n' for v in ["2", "10", "1", "2"])
    files = spark.createDataFrame([("terraform", "r", "a.tf", text, "u", None, None)], IAC_FILES)
    lines = documents.json_lines(land(module_calls(files), "t"), files, INFO).collect()
    assert json.loads("\n".join(r.value for r in lines))["summary"] == {"s": {"count": 4, "versions": {"1": 1, "10": 1, "2": 2}}}


def test_json_modules_are_sorted_once(files):
    """One range exchange over the rows of calls, and none over the whole document."""
    calls = land(module_calls(files), "t")
    plan = documents.json_lines(calls, files, INFO)._jdf.queryExecution().executedPlan().toString()
    ranges = [line for line in plan.splitlines() if "rangepartitioning" in line]
    assert sum("file_path" in line for line in ranges) == 1 and not any("_section" in line for line in ranges)


def test_json_of_no_calls(spark, files):
    calls = land(module_calls(files).where("false"), "t")
    document = json.loads("\n".join(row.value for row in documents.json_lines(calls, files, INFO).collect()))
    assert document["modules"] == [] and document["summary"] == {}


def test_json_module_lines(files):
    rows = [json.loads(r.value) for r in documents.json_module_lines(module_calls(files)).collect()]
    assert [r["source"] for r in rows][:3] == ["./x", "b/c/d", "B/c/d?ref=2"]
    assert "version" not in rows[0]


REPORT = """
Infrastructure as Code Module Usage Report
============================
Platform: GitHub
Target: acme
Scope: All repositories in acme
Repository filter: infra
Total modules found: 6 (4 Terraform, 2 Terragrunt)
Total files analyzed: 4 (3 Terraform, 1 Terragrunt)

Module Summary by Source:

./x (1 instances, type: local)
  No version constraints found

b/c/d (1 instances, type: registry)
  Versions:
    - ~> 1: 1 instances

B/c/d (1 instances, type: registry)
  Versions:
    - 2: 1 instances

both (2 instances, type: unknown)
  No version constraints found

both?x=1 (1 instances, type: unknown)
  No version constraints found

Modules by Source Type:
  unknown: 3 modules (50.0%)
  registry: 2 modules (33.3%)
  local: 1 modules (16.7%)

Modules by File Type:
  terraform: 4 modules (66.7%)
  terragrunt: 2 modules (33.3%)
"""


def test_report(files, tmp_path):
    assert documents.export(files, INFO, "anything", str(tmp_path / "out"))
    assert written(tmp_path / "out") == REPORT


def test_report_of_one_type(files):
    info = documents.ScanInfo("GitHub", "s", "t", "c", file_types=["terraform"])
    chosen = files.where("file_type = 'terraform'")
    usage = usage_counts(module_calls(chosen))
    text = "\n".join(r.value for r in documents.report_lines(chosen, usage, info).collect())
    assert text.startswith("\nTerraform Module Usage Report\n")
    assert "Total modules found: 4\nTotal files analyzed: 3\n" in text
    assert "Modules by File Type" not in text and "Repository filter" not in text


def test_nothing_is_written_without_calls(files, tmp_path):
    for rows in (files.limit(0), files.where("path = 'none.tf'")):
        for kind in ("json", "csv", "table"):
            assert not documents.export(rows, INFO, kind, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_documents_are_whole(spark, tmp_path):
    block = 'module "m" { source = "b/c/d" }\n'
    rows = spark.createDataFrame([("terraform", "o/r", f"{i}.tf", block * 15, "u", None, None) for i in range(100)], IAC_FILES)
    assert documents.document(rows, INFO, "csv").count() == 1501
    assert "Platform: GitHub" in [r.value for r in documents.document(rows, INFO).collect()]
    assert documents.export(rows, INFO, "csv", str(tmp_path / "out"))
    assert len(written(tmp_path / "out").splitlines()) == 1501


def test_no_landed_table_is_left(spark, files, tmp_path):
    with open_folder(tmp_path / "scratch"):
        for kind in ("json", "csv", "table"):
            assert documents.export(files, INFO, kind, str(tmp_path / kind))
        assert not [p for p in (tmp_path / "scratch").rglob("*") if p.is_file()]


@contextmanager
def open_folder(path):
    before = list(runtime._own_folder)
    runtime.use_folder(str(path))
    try:
        yield
    finally:
        runtime._own_folder[:] = before


def test_types_of_a_report(spark, files):
    info = documents.ScanInfo("GitHub", "s", "t", "c", file_types=["terragrunt", "terraform"])
    assert "Infrastructure as Code Module" in documents.document(files, info).first().value
    with pytest.raises(ValueError):
        documents.ScanInfo("GitHub", "s", "t", "c", file_types=["hcl"])


def test_shares_of_nothing(spark):
    empty = spark.createDataFrame([], "type STRING, source STRING, version STRING, n BIGINT")
    assert [(r.type, r.n, r.percent) for r in file_type_share(empty).orderBy("rank").collect()] == [("terraform", 0, "0.0"), ("terragrunt", 0, "0.0")]


@pytest.mark.parametrize("kind", ["json", "csv", "table"])
def test_an_export_reads_its_files_once(spark, files, tmp_path, kind):
    """Each task that reads the files leaves a mark."""
    marks = tmp_path / "marks"
    marks.mkdir()
    place = str(marks)

    def read(batches):
        import uuid

        open(f"{place}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    watched = files.coalesce(1).mapInPandas(read, files.schema)
    assert documents.export(watched, INFO, kind, str(tmp_path / "out"))
    assert len(list(marks.iterdir())) == 1
    assert documents.export(files, INFO, kind, str(tmp_path / "plain"))
    text = ["\n".join(sorted(row.value for row in spark.read.text(str(tmp_path / name)).collect())) for name in ("out", "plain")]
    assert [line for line in text[0].splitlines() if "timestamp" not in line] == [line for line in text[1].splitlines() if "timestamp" not in line]
