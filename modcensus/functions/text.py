"""Small text helpers shared by the column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from modcensus.fixed import SPACE


def strip_space(text: Column) -> Column:
    """Trim the wide whitespace class, not only the space character."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL (not '') when there is none."""
    return none_if_empty(F.regexp_extract(text, pattern, group))


def newlines(text: Column) -> Column:
    """Number of line feeds; a lone carriage return does not end a line."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def in_locale_order(text: Column) -> Column:
    """Sort key in Unicode root-locale order. Use it only as a sort key."""
    return F.collate(text, "UNICODE")


def filled(template: str, *values: Column) -> Column:
    """The template with its {} replaced by the values, NULL if one is."""
    first, *others = template.split("{}")
    return F.concat(F.lit(first), *(part for value, text in zip(values, others, strict=True) for part in (value, F.lit(text))))


def looked_up(key: Column, table: dict) -> Column:
    """Value of ``key`` in a small fixed table, NULL when it is not there."""
    return F.create_map(*[F.lit(item) for pair in table.items() for item in pair])[key]
