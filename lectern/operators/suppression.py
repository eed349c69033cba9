"""Whether a change from one line to another is shown: rules in their order, each of which hides the change for a reason or insists that it is shown. The first that holds decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import text as T
from .relational import dealt_over

#: A rule's reason where it insists that the change is shown.
SHOWN = "shown"
#: An outline mark at the start of a line, the label of an amendment there, and the words that head a division.
OUTLINE = r"^\((?:[a-z]{1,3}|[0-9]{1,3}[a-z]?|[ivxlcdm]{1,6})\)"
AMENDMENT = r"^\[?[a-z][0-9]+[a-z]?\]?\s*"
MARK_WORD = r"^(?:\([0-9]+[a-z]?\))?\([a-z]{1,3}\)$|^\([0-9]+[a-z]?\)$"
#: Similarities and overlaps of lines that count as the same wording.
CONTAINED, NEAR, NEAR_OVERLAP, ALIKE, ALIKE_OVERLAP = 0.70, 0.92, 0.95, 0.82, 0.92


def key(line: Column) -> Column:
    """Lower case with marks kept: quotes plain, words joined at line ends, amendment labels put together, single spaces."""
    return F.lower(C.compact_markers(C.normalised(line)))


def _words(x: Column) -> Column:
    return F.split(x, " ")


def _aligned_change(a: Column, b: Column) -> Column:
    """Lines of equally many words, four at least, of which one or two differ, and one of these is a word of four letters and more, not by its marks only, or an outline mark on both sides."""
    wa, wb = _words(a), _words(b)
    pairs = F.filter(F.zip_with(wa, wb, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"] != p["y"])
    bare = lambda w: F.regexp_replace(w, "[^a-z0-9]", "")
    core = lambda w: F.regexp_replace(w, r"^[^a-z0-9()]+|[^a-z0-9()]+$", "")
    word = lambda w: (F.length(bare(w)) >= 4) & F.rlike(bare(w), F.lit("[a-z]"))
    mark = lambda w: F.rlike(core(w), F.lit(MARK_WORD))
    real = F.exists(pairs, lambda p: (word(p["x"]) & word(p["y"]) & (bare(p["x"]) != bare(p["y"]))) | (mark(p["x"]) & mark(p["y"])))
    return (F.size(wa) == F.size(wb)) & (F.size(wa) >= 4) & F.size(pairs).between(1, 2) & real


def _numbers(x: Column) -> Column:
    return F.array_sort(T.numeric_tokens(x))


#: What makes a line rich in structure, how many of them count in full, and how much richer a line is that an extraction has lost marks of.
MARKS = (r"\((?:[a-z]{1,3}|[0-9]{1,3}|[ivxlcdm]{1,6})\)", r"\[[a-z][0-9]+[a-z]?\]", r"\b[fcems][0-9]+[a-z]?\b", r"\b(?:s\.|sch\.|para\.|art\.|reg\.)\s*[0-9]")
FULL, RICHER, BODY = 6, 0.18, 0.95


def richness(line: Column) -> Column:
    """From 0 to 1: how many outline marks, labels and citations a line has."""
    return _richness(key(line))


def _richness(k: Column) -> Column:
    hits = sum((F.regexp_count(k, F.lit(p)) for p in MARKS), F.lit(0))
    return F.least(F.lit(1.0), hits / FULL)


def weaker(x: Column, y: Column, look: Callable[[str, Column], Column] | None = None) -> Column:
    """Whether line x looks like y with marks or brackets lost: the wording behind the outline marks is the same, numbers included, and y is richer or has more brackets."""
    look = look or made
    p, q = look("wording", x), look("wording", y)
    similar = F.greatest(T.levenshtein_ratio(p, q), C.sort_ratio(p, q))
    brackets = lambda v: F.regexp_count(look("key", v), F.lit(r"[\[(]"))
    return (p != "") & (q != "") & (similar >= BODY) & T.subset(_numbers(p), _numbers(q)) & ((_richness(look("key", y)) - _richness(look("key", x)) >= RICHER) | (brackets(x) < brackets(y)))


#: What the rules look at in a line, and in its key.
LOOKS: dict[str, Callable[[Column], Column]] = {
    "key": key, "bare": lambda x: F.regexp_replace(x, r"\s+", ""), "letters": lambda x: F.regexp_replace(x, "[^A-Za-z]", ""), "content": lambda x: key(C.content_only(x)), "wording": C.without_anchors, "signature": C.signature,
    "count": lambda x: F.size(_words(C.normalised(x))), "noise": T.is_noise,
}
FROM_KEY: dict[str, Callable[[Column], Column]] = {
    "label": lambda x: F.regexp_replace(x, AMENDMENT, ""), "tight": lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+([,)\]])", "$1"), r"([\[(])[ \t]+", "$1"), "outline": lambda x: F.regexp_extract(x, OUTLINE, 0),
    "marks": lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), "bag": lambda x: F.array_sort(_words(x)), "numbers": _numbers, "said": T.content_words,
}


def made(name: str, line: Column) -> Column:
    """One of the looks of a line, made where it stands."""
    return LOOKS[name](line) if name in LOOKS else FROM_KEY[name](key(line))


def similarity(a: Column, b: Column, look: Callable[[str, Column], Column] = made) -> Column:
    """The larger of the ratios of both keys and of their sorted words."""
    bag = lambda x: F.array_join(look("bag", x), " ")
    return F.greatest(T.levenshtein_ratio(look("key", a), look("key", b)), T.levenshtein_ratio(bag(a), bag(b)))


def rules(a: Column, b: Column, look: Callable[[str, Column], Column] = made, similar: Column | None = None) -> list[tuple[str, Column]]:
    """(reason, condition) in the order in which they are tried; look: where the looks of a line come from, similar: similarity() of both."""
    ka, kb = look("key", a), look("key", b)
    one = lambda name: (look(name, a), look(name, b))
    (bare_a, bare_b), (na, nb) = one("bare"), one("numbers")
    capitals = (look("letters", a) == F.upper(look("letters", a))) | (look("letters", b) == F.upper(look("letters", b)))
    case_only = (F.lower(bare_a) == F.lower(bare_b)) & (look("count", a) == look("count", b))
    similar = similarity(a, b, look) if similar is None else similar
    overlap = T.jaccard(*one("said"))
    shorter = F.length(ka) <= F.length(kb)
    short, long = F.when(shorter, ka).otherwise(kb), F.when(shorter, kb).otherwise(ka)
    few, many = F.when(shorter, na).otherwise(nb), F.when(shorter, nb).otherwise(na)
    same_numbers = na == nb
    equal = lambda name: look(name, a) == look(name, b)
    both = lambda name: (look(name, a) != "") & equal(name)
    return [
        ("noise", look("noise", a) & look("noise", b)),
        ("same", a == b),
        ("space", bare_a == bare_b),
        (SHOWN, case_only & ~capitals),
        ("capitals", case_only),
        ("space", F.lower(bare_a) == F.lower(bare_b)),
        ("format", ka == kb),
        (SHOWN, _aligned_change(ka, kb)),
        ("label", both("label")),
        ("marker", both("content")),
        ("anchor", both("wording")),
        ("citation", equal("tight")),
        ("weaker", ((look("outline", a) == "") != (look("outline", b) == "")) & (weaker(a, b, look) | weaker(b, a, look))),
        (SHOWN, ~equal("outline")),
        ("punctuation", equal("marks")),
        ("reflow", equal("bag")),
        ("cut", (F.length(short) >= 6) & F.contains(long, short) & (F.size(F.array_except(few, many)) == 0) & (similar >= CONTAINED)),
        ("near", same_numbers & (((similar >= NEAR) & (overlap >= NEAR_OVERLAP)) | ((similar >= ALIKE) & (overlap >= ALIKE_OVERLAP)))),
        ("signature", both("signature") & T.subset(na, nb)),
    ]


def _first(found: list[tuple[str, Column]]) -> Column:
    ladder = None
    for reason, holds in found:
        ladder = F.when(holds, reason) if ladder is None else ladder.when(holds, reason)
    return ladder


def suppression(a: Column, b: Column) -> Column:
    """The reason why a change from line a to line b isn't shown; null where it is."""
    return F.nullif(_first(rules(a, b)), F.lit(SHOWN))


#: The rules that ask for similarities, which are worked out only where no rule before them decides.
LATE = 3


def suppressed(x: DataFrame, a: str, b: str, name: str = "reason") -> DataFrame:
    """x with suppression() of its columns a and b, and the looks of both (look_..._a and _b): each look is made once a row, however many rules ask for it."""
    sides = {"a": a, "b": b}
    at = lambda look, side: F.col(f"look_{look}_{side}")
    made_once = lambda looks, of: {f"look_{n}_{s}": f(of(s)) for n, f in looks.items() for s in sides}
    x = x.withColumns({"look_line_a": F.col(a), "look_line_b": F.col(b)}).withColumns(made_once(LOOKS, lambda s: F.col(f"look_line_{s}")))
    x = x.withColumns(made_once(FROM_KEY, lambda s: at("key", s)))
    given = {"line_a": F.col("look_line_a"), "line_b": F.col("look_line_b")}
    look = lambda n, line: at(n, "a" if line is given["line_a"] else "b")
    found = rules(given["line_a"], given["line_b"], look, F.col("look_similar"))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  keeps a value from being worked out once more wherever it is asked for
    x = x.select("*", once(_first(found[:-LATE])).alias("look_early"))
    x = x.select("*", once(F.when(F.col("look_early").isNull(), similarity(given["line_a"], given["line_b"], look))).alias("look_similar"))
    return x.withColumn(name, F.nullif(F.coalesce("look_early", _first(found[-LATE:])), F.lit(SHOWN)))


#: Words of a line that may miss one, the share of them that agree, and the similarity of joined lines.
MANY, AGREE, JOINED = 10, 0.97, 0.92


def _bags(p: Column) -> tuple[Column, Column]:
    """The words of a line without its outline marks, and its letters, digits and spaces."""
    bare = F.trim(F.regexp_replace(p, r"[^\p{L}\p{N}_ ]+", " "))
    return F.array_sort(F.filter(F.split(bare, " +"), lambda w: w != "")), bare


def same_words(a: Column, b: Column) -> Column:
    """The same words in any order behind the outline marks; of many words one may be missing if nearly all agree, numbers included."""
    return _same_bags(*_bags(C.without_anchors(a)), *_bags(C.without_anchors(b)))


def _same_bags(x: Column, bare_x: Column, y: Column, bare_y: Column) -> Column:
    most = F.greatest(F.size(x), F.size(y))
    shared = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    loose = (most >= MANY) & (F.abs(F.size(x) - F.size(y)) <= 1) & (shared / most >= AGREE) & T.subset(_numbers(bare_x), _numbers(bare_y))
    return (x == y) | loose


def joined_equivalent(x: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """x with whether its lines a and b, one of them joined from neighbours, say the same: their change would be hidden, or they agree behind their outline marks, by letters, by words, or nearly and with their numbers."""
    columns = x.columns
    x = suppressed(x, a, b, "look_reason")
    p, q = F.col("look_wording_a"), F.col("look_wording_b")
    x = x.withColumns({f"look_{n}_{s}": c for s, w in (("a", p), ("b", q)) for n, c in zip(("bag", "plain"), _bags(w), strict=True)})
    near = (p != "") & (q != "") & (F.greatest(T.levenshtein_ratio(p, q), C.sort_ratio(p, q)) >= JOINED) & T.subset(_numbers(p), _numbers(q))
    letters = (F.col("look_signature_a") != "") & (F.col("look_signature_a") == F.col("look_signature_b"))
    words = _same_bags(*[F.col(f"look_{n}_{s}") for s in ("a", "b") for n in ("bag", "plain")])
    says = F.when(F.col("look_reason").isNotNull(), True).otherwise(F.coalesce(((p != "") & (p == q)) | letters | words | near, F.lit(False)))
    return x.select(*columns, says.alias(name))


def split_blocks(changes: DataFrame, group: list[str], order: str) -> DataFrame:
    """changes (group, order, kind, old, new) with `split`: whether a modification and the addition behind it, or a deletion and the modification behind it, are one line that only one version has cut in two.

    Each row is compared with the one behind it only, and tells it what came of it.
    """
    w = Window.partitionBy(*group).orderBy(order)
    # Few bytes of lines take long, so they are dealt by number and not by size.
    x = changes.repartition(dealt_over(changes.sparkSession), *group).withColumns({f"{c}_behind": F.lead(c).over(w) for c in ("kind", "old", "new")})
    joined = lambda a, b: F.concat_ws(" ", a, b)
    c = F.col
    added, removed = (c("kind") == "mod") & (c("kind_behind") == "add"), (c("kind") == "del") & (c("kind_behind") == "mod")
    x = x.withColumn("whole", F.when(added, c("old")).when(removed, joined(c("old"), c("old_behind")))).withColumn("halves", F.when(added, joined(c("new"), c("new_behind"))).when(removed, c("new_behind")))
    x = joined_equivalent(x.withColumn("pair", F.coalesce(added | removed, F.lit(False))), "whole", "halves", "says")
    says = F.col("pair") & F.col("says")
    x = x.withColumn("says", says)
    return x.withColumn("split", F.col("says") | F.coalesce(F.lag("says").over(w), F.lit(False))).select(*changes.columns, "split")
