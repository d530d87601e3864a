"""Masks and roles against a few lines of plain Python, over many odd strings."""

import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from veilframe.functions import masks
from veilframe.functions.dates import age_group
from veilframe.operators.clean import column_modes

ALPHABET = list("ab1. -_/é你😀'\"\\%") + ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ", "　", "​", "᠎"]


def _texts(n=600):
    rng = random.Random(11)
    return [None, "", " ", "."] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def _digest(kind, text):
    return getattr(hashlib, kind)(text.encode()).hexdigest()


def expected(text):
    blank = text is None or text == ""
    h = None if blank else _digest("sha256", text)
    words = [] if blank else text.split()
    whole = "" if blank else text.split(".")[0]
    return (
        text if blank else f"{h[:3]}-{h[3:5]}-{h[5:9]}",
        "Patient_" + _digest("md5", "Unknown" if blank else text)[:8],
        f"Street_{len(words)}_Redacted" if len(words) > 1 else "Address_Redacted",
        whole[:3] + "XX" if len(whole) >= 3 else "00000",
    )


def test_masks_follow_the_rules_on_any_text(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    c = F.col("c")
    out = df.select("i", masks.mask_ssn(c), masks.mask_first_name(c), masks.mask_address(c), masks.mask_zip(c)).orderBy("i").collect()
    wrong = [(texts[r[0]], tuple(r)[1:], expected(texts[r[0]])) for r in out if tuple(r)[1:] != expected(texts[r[0]])]
    assert not wrong, wrong[:5]


def test_age_groups_like_right_closed_cuts(spark):
    ages = list(range(-3, 110)) + [None]
    cut = pd.cut(pd.Series(ages, dtype="float64"), bins=[0, 18, 30, 50, 70, 100], labels=["0-18", "19-30", "31-50", "51-70", "70+"])
    df = spark.createDataFrame(list(enumerate(ages)), "i int, a int")
    got = [r[0] for r in df.orderBy("i").select(age_group(F.col("a"))).collect()]
    assert got == [None if pd.isna(v) else v for v in cut]


def test_modes_like_the_smallest_most_frequent(spark):
    rng = random.Random(3)
    data = [(rng.choice(["b", "B", "é", "a", "z", None]), rng.choice(["x", "y", None])) for _ in range(200)]
    df = spark.createDataFrame(data, "p string, q string")
    frame = pd.DataFrame(data, columns=["p", "q"])
    got = {r["column"]: r["mode"] for r in column_modes(df, ["p", "q"]).collect()}
    assert got == {c: frame[c].mode()[0] for c in ("p", "q")}
