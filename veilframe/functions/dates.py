"""Birth-date generalisation expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Right-closed age bins and their labels.
AGE_EDGES = (0, 18, 30, 50, 70, 100)
AGE_LABELS = ("0-18", "19-30", "31-50", "51-70", "70+")


def parse_date(c: Column) -> Column:
    """Date, or null where the text is no date (a plain cast raises in ANSI mode)."""
    return c.try_cast("date")


def age_years(birthdate: Column, as_of: dt.date | str) -> Column:
    """Whole years of 365 days. ``floor`` and not ``div``: future dates round down, not to zero."""
    return F.floor(F.datediff(F.lit(as_of).cast("date"), birthdate) / 365).cast("int")


def birth_month(c: Column) -> Column:
    return F.month(c)


def birth_year(c: Column) -> Column:
    return F.year(c)


def bucketize(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin (edges[i], edges[i+1]]; null outside all of them."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin")
    out = F.when(c <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(c <= F.lit(upper), F.lit(label))
    return out


def age_group(age: Column) -> Column:
    return bucketize(age, AGE_EDGES, AGE_LABELS)
