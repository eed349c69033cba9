"""The suppression rules on lines drawn at random, each with what an independent reading of the rule says."""

import random

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.suppression import split_blocks, suppression, weaker

NOUNS = "warehouse ferry orchard signal harbour library engine garden bridge market".split()
VERBS = "inspects repairs records measures paints counts".split()


def outcomes(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(suppression(F.col("a"), F.col("b"))).collect()]


def lines(seed, n=25):
    rng = random.Random(seed)
    return [f"{rng.choice(NOUNS)} keeper {rng.choice(VERBS)} {rng.choice(NOUNS)} no {rng.randrange(10, 99)} daily" for _ in range(n)]


def test_changes_that_are_shown(spark):
    rng = random.Random(1)
    pairs = []
    for x in lines(1):
        words = x.split()
        at = rng.choice([0, 1, 2, 3])
        pairs.append((x, " ".join([*words[:at], rng.choice(["teapots", "lantern"]), *words[at + 1 :]])))  # a word
        pairs.append((x, x.replace(words[5], str(int(words[5]) + 100))))  # a number
        pairs.append((x, x.replace(words[2], words[2].capitalize())))  # case, as many words
        one, two = rng.sample("abcdefg", 2)
        pairs.append((f"({one}) {x}", f"({two}) {x}"))  # an outline mark
        pairs.append((f"under ({rng.randrange(1, 9)}) {x}", f"under ({rng.randrange(10, 19)}) {x}"))
    assert set(outcomes(spark, pairs)) == {None}


def test_changes_that_are_hidden(spark):
    rng = random.Random(2)
    made = {k: [] for k in ("space", "capitals", "punctuation", "label", "marker", "anchor", "reflow", "same", "citation", "noise")}
    for x in lines(2):
        w = x.split()
        made["same"].append((x, x))
        made["space"] += [(x, x.replace(" ", rng.choice(["  ", "\t", " \n"]))), (x, f"{x[:2]} {x[2:]}")]
        made["capitals"].append((x, x.upper()))
        made["punctuation"].append((x, f"{x}{rng.choice('.;,')}"))
        made["label"].append((f"{rng.choice('ghjk')}{rng.randrange(99)} {x}", f"{rng.choice('qrst')}{rng.randrange(100, 199)} {x}"))
        made["marker"].append((f"{w[0]} [F{rng.randrange(9)}] {' '.join(w[1:])}", x))
        made["anchor"].append((f"({rng.choice('abcd')}) {x}", x))
        made["reflow"].append((x, " ".join(w[3:] + w[:3])))
        made["citation"].append((f"{x} (with sch. 2)", f"{x}, (with sch. 2 )".replace(", (", " (")))
        made["noise"].append(("." * rng.randrange(8, 40), ". " * rng.randrange(8, 20)))
    for reason, pairs in made.items():
        assert set(outcomes(spark, pairs)) <= {reason} | ({"space"} if reason == "citation" else set()), reason


def test_leaders_with_an_amendment_label_are_no_noise(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(30):
        dots, label = "." * rng.randrange(9, 60), f"{rng.choice('CFM')}{rng.randrange(1, 999)}"
        rows += [(f"{rng.choice([label, f'[{label}]'])}{rng.choice(['', ' '])}({rng.randrange(9)}) {dots}", False), (dots, True), (f"({rng.randrange(9)}) {dots}", True), (str(rng.randrange(9999)), True)]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, line string").orderBy("i").select(T.is_noise(F.col("line"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]


def test_lines_cut_in_two(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i, x in enumerate(lines(4, 30)):
        w = x.split()
        at, other = rng.randrange(2, 6), i % 3 == 0
        head, rest = " ".join(w[:at]), " ".join(w[at:] if not other else ["teapots", "lantern", *w[at + 1 :]])
        if i % 2:
            rows += [(i, 1, "mod", x, head), (i, 2, "add", None, rest)]
        else:
            rows += [(i, 1, "del", head, None), (i, 2, "mod", rest, x)]
        rows.append((i, 3, "add", None, "quite another line"))
        want[i] = not other
    got = split_blocks(spark.createDataFrame(rows, "i int, no int, kind string, old string, new string"), ["i"], "no").collect()
    assert {(r.i, r.no): r.split for r in got} == {(i, no): w and no < 3 for i, w in want.items() for no in (1, 2, 3)}


def test_weaker_lines(spark):
    x = "the keeper counts the ferries of the harbour no 12 daily"
    pairs = [(x, f"(a) {x}", True), (f"(a) {x}", x, False), (x, x.replace("12", "13"), False), (x, x, False), ("", x, False)]
    df = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(weaker(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_looks_are_made_once(spark):
    """reasons from looks made once a row are those of the rules, and a row is compared once, however many of its neighbours ask."""
    from lectern.operators.suppression import suppressed

    made = lines(8, 40)
    pairs = [(x, y) for x in made[:20] for y in (x, x.upper(), x + ".", "(a) " + x, x + " as amended", x[:20], "F 2 " + x, x.replace("keeper", "keepers"), " ".join(reversed(x.split())), made[-1], "", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in suppressed(df, "a", "b").orderBy("i").select("reason").collect()]
    assert got == outcomes(spark, pairs)
    rows = spark.createDataFrame([(1, 1, "mod", "x", "y")], "i int, no int, kind string, old string, new string")
    plan = split_blocks(rows, ["i"], "no")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") <= 12
