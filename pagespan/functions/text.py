"""Text and set functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts whose characters are tokens of their own, as they appear in Unicode character names.
SEPARATE_SCRIPTS = ("CJK", "KANGXI", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")


@lru_cache(1)
def separate_class() -> str:
    """A Java regex class of the characters whose Unicode name holds one of SEPARATE_SCRIPTS."""
    parts, start, last = [], None, None
    for cp in range(0x80, 0x110000):
        name = unicodedata.name(chr(cp), "")
        if name and any(s in name for s in SEPARATE_SCRIPTS):
            if start is None:
                start = cp
            last = cp
        elif start is not None and cp != last:
            parts.append((start, last))
            start = None
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a != b else f"\\x{{{a:X}}}" for a, b in parts)


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends. A text that begins and ends with a printed ASCII character needs no pattern."""
    plain = F.ascii(x).between(33, 126) & F.ascii(F.right(x, F.lit(1))).between(33, 126)
    return F.when(plain, x).otherwise(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+$", "")


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", "")


def is_empty(x: Column) -> Column:
    """Null or white space only. A text that begins with a printed ASCII character isn't, and needs no pattern."""
    return F.when(F.ascii(x).between(33, 126), F.lit(False)).otherwise(F.coalesce(~x.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True)))


def tokens(x: Column) -> Column:
    """The distinct tokens: characters of separate scripts one by one, other letters as lower-cased words. Separate scripts begin
    above U+0E00; texts without such characters need no class of them."""
    sep, x = separate_class(), F.coalesce(x, F.lit(""))
    plain = F.transform(F.regexp_extract_all(x, F.lit("\\p{L}+"), F.lit(0)), F.lower)
    found = F.regexp_extract_all(x, F.lit(f"[{sep}]|[\\p{{L}}&&[^{sep}]]+"), F.lit(0))
    mixed = F.transform(found, lambda t: F.when(t.rlike(f"^[{sep}]"), t).otherwise(F.lower(t)))
    return F.array_distinct(F.when(x.rlike("[\\x{0E00}-\\x{10FFFF}]"), mixed).otherwise(plain))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def both_have_own(a: Column, b: Column) -> Column:
    """Both sets have an element that the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def normal_name(x: Column) -> Column:
    return F.lower(strip(x))


def numeric_like_names(columns: Column) -> Column:
    """At least 70% of the names are digits or begin with `unnamed:`."""
    names = F.transform(columns, normal_name)
    like = F.filter(names, lambda c: c.rlike(r"(?U)^\d+$") | c.startswith("unnamed:"))
    return F.when(F.size(columns) > 0, F.size(like) / F.size(columns) >= F.lit(0.7)).otherwise(F.lit(False))


def has_digit(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?U)\d"), F.lit(False))


def clean_header(x: Column) -> Column:
    """`Name.Name` (equal but for case and outer space) becomes `Name`; else the stripped name."""
    s = strip(x)
    p = F.split(s, r"\.")
    twice = (F.size(p) == 2) & (normal_name(F.get(p, F.lit(0))) == normal_name(F.get(p, F.lit(1))))
    return F.when(s.contains("."), F.when(twice, strip(F.get(p, F.lit(0)))).otherwise(s)).otherwise(s)


def clean_grid_header(x: Column, position: Column) -> Column:
    """As a grid gives it: exact repeats only, blank names by position."""
    s = strip(F.coalesce(x, F.lit("")))
    p = F.split(s, r"\.")
    one = F.when((F.size(p) == 2) & (F.get(p, F.lit(0)) == F.get(p, F.lit(1))), F.get(p, F.lit(0))).otherwise(s)
    return F.when(one == "", F.concat(F.lit("Column_"), position.cast("string"))).otherwise(one)
