"""Rules over single lines and texts against independent readings of them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import compare as C
from lectern.functions import text as T
from lectern.plans.facets import LINE_NOISE, without_data


def column(spark, rows, expr, schema="a string, b string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_unwrapped(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", ".", "\n", "\n", " "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    want = [re.sub("\n+", "\n", "".join(" " if c == "\n" and t[i - 1 : i] != "." and t[i + 1 : i + 2] != "\n" else c for i, c in enumerate(t))) for t in texts]
    assert column(spark, [(t, "") for t in texts], C.unwrapped(F.col("a"))) == want


@pytest.mark.parametrize(("line", "label"), [
    ("Part 3 Overview", True), ("chapter 12", True), ("GENERAL TERMS HERE", True), ("Overview of rules", True), ("Repeal of acts", True), ("repeal of acts", False), ("Overview of the rules that follow below", False),
    ("(1) Overview", False), ("F12 words", False), ("Levy on ferries", False), ("Textual amendments", False), ("Scope: rules", False), ("Scope 2019", False), ("", False), ("OVERVIEW", True), ("FERRIES", False),
])
def test_labels_of_navigation(spark, line, label):
    assert column(spark, [(line, "")], T.is_breadcrumb(F.col("a"))) == [label]


def test_noise_and_rows_without_data(spark):
    noise = {"12": True, "Page 3 of 10": True, "F12 words": True, "Extent": True, "Schedule 4: rules": True, "Words in s. 4": True, "inserted by the act": True, "The officer pays": False, "2019 was fine": False, "": False}
    assert column(spark, [(x, "") for x in noise], F.rlike(F.lower("a"), F.lit(LINE_NOISE))) == list(noise.values())
    rows = {("", ""): True, ("", "https://x.org"): False, ("A title", ""): False, ("x" * 81, ""): True, ("x" * 81, "https://x.org"): False, ("* note", "https://x.org"): True, ("SME check-point", ""): True}
    assert column(spark, list(rows), without_data(F.col("a"), F.col("b"), F.lit(None).cast("string"))) == list(rows.values())
    assert column(spark, [("A title", "")], without_data(F.col("a"), F.col("b"), F.lit("click any cell to edit"))) == [True]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_similarities_by_code_points(spark):
    rng = random.Random(2)
    rows = [tuple("".join(rng.choice(["é", "ü", "漢", "字", "a", " ", "b ", "[F2] "]) for _ in range(rng.randrange(14))) for _ in range(2)) for _ in range(150)] + [("漢字漢字", "かなかな"), ("", "a"), ("", ""), ("[F2] one two", "one two")]

    def ratio(x, y):
        return 0.0 if (x == "") != (y == "") else 1 - lev(x, y) / max(len(x), len(y)) if x or y else 1.0

    bag = lambda x: " ".join(sorted(re.sub(r"[\W_]+", " ", x.lower()).strip().split(" ")))
    bare = lambda x: re.sub(r"\s", "", x)
    best = lambda x, y: max(ratio(bag(x), bag(y)), ratio(bare(x), bare(y)))
    said = lambda x: re.sub(" +", " ", re.sub(r"\[[A-Z]{1,2}[0-9]+[A-Z]?\]", " ", x)).strip()
    want = [best(said(x), said(y)) if said(x) and said(y) and best(said(x), said(y)) >= 0.97 else best(x, y) for x, y in rows]
    assert column(spark, rows, C.combined_ratio(F.col("a"), F.col("b"))) == pytest.approx(want)
    assert want[150] == 0.0
