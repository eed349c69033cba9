"""What is compared in the task that reads a row, held to the column functions and to all pairs."""

import random

from pyspark.sql import functions as F

from lectern.functions import compare as C
from lectern.functions import text as T
from lectern.operators import alignment as A
from lectern.plans import comparisons, revisions


def test_sections_in_order_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    some = lambda: [None if rng.random() < 0.05 else sorted({rng.choice("abcdefghijkl") for _ in range(rng.randrange(6))}) for _ in range(rng.randrange(14))]
    texts = [(i, some(), some()) for i in range(40)] + [(None, [["a"]], [["a"]]), (90, None, [["a"]]), (91, [[]], [[]]), (92, [], [["a"]])]
    lists = spark.createDataFrame(texts, "id long, old array<array<string>>, new array<array<string>>")
    side = lambda c, no: lists.select("id", F.posexplode(c).alias(no, f"w{no}"))
    near = side("old", "a").join(side("new", "b"), "id").where(F.abs(F.col("a") - F.col("b")) <= 3).select("id", "a", "b", T.jaccard(F.col("wa"), F.col("wb")).alias("similarity")).where("similarity > 0.3")
    found = A.matched_in_order(lists, 3, 0.3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, A.in_order(near).collect())) and found.where("id = 91").count() == 1
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_ratios_in_tasks_are_those_of_the_columns(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("ab é\n😀") for _ in range(rng.choice([0, 3, 8, 70, 600, 1300])))
    made = [(i, text(), text()) for i in range(60)] + [(90, None, "x"), (91, "", ""), (92, " ", "x"), (93, "abcdefg", "abcdefg")]
    rows = spark.createDataFrame(made, "id long, a string, b string")
    grams = F.when((F.size("x") == 0) | (F.size("y") == 0), 0.0).otherwise(T.jaccard(F.col("x"), F.col("y")))
    slow = rows.withColumns({"x": C.grams(F.col("a")), "y": C.grams(F.col("b"))}).select("id", C.guarded(F.col("a"), F.col("b")).alias("r"), F.when(F.col("a").isNotNull(), grams).alias("g"))
    got = A.with_ratios(rows, {"r": ("a", "b")}, {"g": ("a", "b")})
    assert got.columns == ["id", "r", "g"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, slow.collect()))


def test_turns_with_markers(spark, tmp_path):
    turns = ["the rent is due", "[F12] the rent is [C3A]due", "[F12]", "", "  ", "the rent [F1]is due  now", "the rents are due now, [F1]", "due is rent the", None, "a [x] b"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.combined for r in comparisons.pair_similarity(spark, str(tmp_path)).collect()}
    slow = comparisons.pairs(spark, str(tmp_path)).select("turn", F.round(C.combined_ratio(F.col("a"), F.col("b")), 6).alias("c"))
    assert got == {r.turn: r.c for r in slow.collect()} and got[1] == 1.0


def test_plans_hold_no_pairs(spark):
    plan = revisions.ordered_matches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = comparisons.pair_similarity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan
