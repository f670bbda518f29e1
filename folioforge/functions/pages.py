"""Options that users write: page ranges, languages, modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PAGES = 500
PART = r"^\s*([0-9]{1,9})\s*(?:-\s*([0-9]{1,9})\s*)?$"


def page_range(c: Column) -> Column:
    """struct<pages array<int>, error string> of '1-3,7': sorted distinct pages; null for all pages. A part
    that isn't a number or a rising range, or over MOST_PAGES pages in a part or in all, is an error."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ",", -1), lambda p: F.trim(p) != "")
    first = lambda p: F.regexp_extract(p, PART, 1).try_cast("int")
    last = lambda p: F.coalesce(F.regexp_extract(p, PART, 2).try_cast("int"), first(p))
    wrong = F.filter(parts, lambda p: ~p.rlike(PART) | (first(p) < 1) | (last(p) < first(p)))
    wide = F.exists(parts, lambda p: last(p) - first(p) + 1 > MOST_PAGES)
    bad = F.size(wrong) > 0
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(F.when(bad | wide, F.array().cast("array<string>")).otherwise(parts), lambda p: F.sequence(first(p), last(p))))))
    error = F.when(bad, F.concat(F.lit("'"), F.trim(F.get(wrong, F.lit(0))), F.lit("' is not a valid page range"))).when(wide | (F.size(pages) > MOST_PAGES), "that page range covers too many pages")
    return F.struct(F.when(error.isNull() & (F.size(pages) > 0), pages).alias("pages"), error.alias("error"))


def usable_languages(requested: Column, installed: Column) -> Column:
    """struct<languages, missing> of 'eng+ben' against those installed, in the order asked for; where
    none is installed: eng, or else the first."""
    asked = F.filter(F.transform(F.split(requested, r"\+", -1), lambda x: F.trim(x)), lambda x: x != "")
    usable = F.filter(asked, lambda x: F.array_contains(installed, x))
    fallback = F.when(F.array_contains(installed, "eng"), "eng").otherwise(F.get(installed, F.lit(0)))
    return F.struct(F.when(F.size(usable) > 0, F.array_join(usable, "+")).otherwise(fallback).alias("languages"), F.array_except(asked, installed).alias("missing"))


def recognition_mode(c: Column) -> Column:
    """auto, force or off; anything else is auto."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("auto", "force", "off"), x).otherwise("auto")
