"""Files searched in pieces give the rows of the search in one."""

import random

import pytest

from modcensus.operators.extract import module_calls
from modcensus.operators.large_files import calls_of_any_size, file_pieces, large_file_calls, stitched_pieces
from modcensus.schemas import IAC_FILES
from tests.test_extract import files_of

WORDS = [
    'module "a" {', 'module "a}b" {', 'module "', '" {', 'module\t"c"\n{', "terraform {", "}", "}", "\n", " ", '"', "{",
    'source = "x"', 'source="y}"', 'version = "1"', "# é😀\n", "\u00a0", "module", "terraform", "} }\n", 'module "d" { source = "z" }\n',
]


def random_text(draw, size):
    return "".join(draw.choice(WORDS) for _ in range(size))


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("piece", [1, 7, 60])
@pytest.mark.parametrize(("kind", "path"), [("terraform", "a.tf"), ("terragrunt", "a.hcl")])
def test_pieces_give_the_same_calls(spark, piece, kind, path):
    draw = random.Random(piece)
    texts = [random_text(draw, draw.randrange(120)) for _ in range(150)] + ["", 'module "', "}", "}}}}"]
    files = files_of(spark, texts, kind, path)
    files = files.unionAll(files.where("repository LIKE \'%7\'"))  # repeated rows
    assert rows_of(large_file_calls(files, piece=piece)) == rows_of(module_calls(files))


def test_open_names_tie_pieces_together(spark):
    text = 'x } y } module "n } } m" { source = "s" } z } module "q" { source = "t" }'
    pieces = file_pieces(files_of(spark, [text]), 1)
    parts = stitched_pieces(pieces)
    assert "".join(row.content for row in sorted(pieces.collect(), key=lambda row: row._piece)) == text
    assert "".join(row.content for row in sorted(parts.collect(), key=lambda row: row._piece)) == text
    assert any("n } } m" in row.content for row in parts.collect()) and 1 < parts.count() < pieces.count()


def test_one_large_file_is_dealt_to_many_tasks(spark):
    count = 20_000
    text = "".join(f'# {i} {"x" * 400}\nmodule "m{i}" {{\n  source = "s{i}"\n}}\n' for i in range(count))
    files = files_of(spark, [text])
    pieces = file_pieces(files, 100_000)
    assert pieces.selectExpr("input_file_name()").distinct().count() > 3 and pieces.count() > 30
    rows = large_file_calls(files, piece=100_000).collect()
    assert sorted((r.block_pos, r.name, r.line_number) for r in rows) == [(i, f"m{i}", 4 * i + 2) for i in range(count)]


def test_sizes_choose_the_way(spark):
    text = 'module "a" {\n source = "s"\n}\n'
    rows = [("terraform", f"r{i}", "a.tf", content, "u", None, size) for i, (content, size) in enumerate([(text, None), (text * 50, None), (text * 50, 1), (text, 10**9), (None, None)])]
    files = spark.createDataFrame(rows, IAC_FILES)
    assert rows_of(calls_of_any_size(files, large=200, piece=40)) == rows_of(module_calls(files))
