"""Shapes of cells: data, sub-shape of data, header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagespan.functions.text import is_empty, strip

# The patterns that make a cell data, any case, from its start.
DATA_PATTERNS = (
    r"\d+$",
    r"\d+\.\d+$",
    r"\d{1,2}/\d{1,2}",
    r"\d{1,2}-\d{1,2}",
    r"https?://",
    r"[A-Z]+-\d+$",
    r"\$[\d,]+",
    r"[\d,]+\s*%$",
    r"Row\s*\d+",
    r"\d+\.\d+\.\d+",
    r"[\d,]+\.\d+$",
    r"[\d,]+$",
    r"\d+\.?\d*\s*\([\d,\s.]+\)",
    r"\d+\.?\d*\s*[xX×]\s*10",
)
_DATA = "(?iU)^(?:" + "|".join(DATA_PATTERNS) + ")"
# Names that a parser makes up, placeholder cells, and the longest label.
AUTO_NAME = r"(?iU)^(column|unnamed)[_:]?\s*\d+$"
PLACEHOLDERS = ("DATA", "N/A", "NA", "NULL", "-", "0", "TBD", "NONE", "YES", "NO")
HEADER_CHARS = 30


def looks_like_data(cell: Column) -> Column:
    return F.coalesce(strip(cell).rlike(_DATA), F.lit(False))


def sub_shape(cell: Column) -> Column:
    """Null for cells that aren't data."""
    s = strip(cell)
    kind = (
        F.when(s.rlike("(?i)^https?://"), "url")
        .when(s.startswith("$"), "currency")
        .when(s.endswith("%"), "percent")
        .when(s.rlike(r"(?U)^\d{1,2}[/-]\d{1,2}"), "date_like")
        .when(s.rlike(r"(?U)^\d+$"), "bare_int")
        .when(s.rlike(r"(?U)^[\d,]+$"), "grouped_int")
        .when(s.rlike(r"(?U)^\d+\.\d+$|^[\d,]+\.\d+$"), "float")
        .otherwise("other_data")
    )
    return F.when(looks_like_data(cell), kind)


def header_shaped(cell: Column) -> Column:
    s = strip(F.coalesce(cell, F.lit("")))
    return (s == "") | ((F.char_length(s) <= HEADER_CHARS) & ~s.rlike(AUTO_NAME) & ~looks_like_data(s))


def filled(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")


def header_by_contrast(rows: Column) -> Column:
    """The first row has one data sub-shape throughout and at least 60% of the next two rows' cells have another."""
    first = filled(F.get(rows, F.lit(0)))
    shapes = F.array_distinct(F.transform(first, lambda c: F.coalesce(sub_shape(c), F.lit("-"))))
    one = F.get(shapes, F.lit(0))
    body = filled(F.flatten(F.slice(rows, 2, 2)))
    other = F.filter(body, lambda c: F.coalesce(sub_shape(c), F.lit("-")) != one)
    return F.when((F.size(rows) >= 2) & (F.size(first) >= 2) & (F.size(shapes) == 1) & (one != "-") & (F.size(body) > 0), F.size(other) / F.size(body) >= F.lit(0.6)).otherwise(F.lit(False))


def is_data_row(rows: Column) -> Column:
    """Whether the first of the non-blank rows is data, so that the fragment has no header."""
    row = F.get(rows, F.lit(0))
    cells = filled(row)
    upper = F.transform(cells, F.upper)
    several = F.size(cells) >= 3
    data = F.exists(row, looks_like_data) & ~header_by_contrast(rows)
    url = F.exists(row, lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("http"))
    repeated = several & (F.size(F.array_distinct(upper)) < F.lit(0.5) * F.size(cells))
    placeholder = several & F.arrays_overlap(upper, F.array(*[F.lit(p) for p in PLACEHOLDERS]))
    long = (F.size(cells) > 0) & (F.size(F.filter(cells, lambda c: F.char_length(c) > HEADER_CHARS)) >= F.lit(0.5) * F.size(cells))
    return F.coalesce(data | url | is_sparse(rows) | repeated | placeholder | long, F.lit(False))


def is_sparse(rows: Column) -> Column:
    row = F.get(rows, F.lit(0))
    return F.coalesce((F.size(filled(row)) < F.size(row) / 2) & is_empty(F.get(row, F.lit(0))), F.lit(False))


def is_header_orphan(columns: Column, headerless: Column, rows: Column, max_rows: int) -> Column:
    """A small fragment that is all header: its columns and its few rows look like labels."""
    named = F.exists(columns, lambda c: ~is_empty(c) & ~c.rlike(AUTO_NAME))
    own = filled(columns)
    shapes = F.array_distinct(F.transform(own, lambda c: F.coalesce(sub_shape(c), F.lit("-"))))
    uniform = (F.size(own) >= 2) & (F.size(shapes) == 1) & (F.get(shapes, F.lit(0)) != "-")
    labels = ~F.exists(columns, looks_like_data) | uniform
    return F.coalesce(~headerless & (F.size(rows) <= max_rows) & named & labels & F.forall(F.flatten(rows), header_shaped), F.lit(False))
