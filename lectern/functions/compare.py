"""Comparison of two versions of a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Quotes that count as plain ones.
CURLY, STRAIGHT = "‘’“”", "''\"\""


def normalised(text: Column) -> Column:
    """Words broken at a line end are joined, line feeds and runs of white space become one space, curly quotes plain ones."""
    joined = F.regexp_replace(text, T.as_re2(r"([A-Za-z])-[ \t]*\n\s*([A-Za-z])"), "$1$2")
    return T.collapsed(F.translate(joined, CURLY, STRAIGHT))


def unwrapped(text: Column) -> Column:
    """A line feed that neither follows a full stop nor comes before another becomes a space; those left are single."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<!\.)\n(?!\n)", " "), r"\n+", "\n")


def tokens(text: Column, most: int = 40_000) -> Column:
    """Words without punctuation at their ends, those with a letter or digit only, at most so many."""
    stripped = F.transform(F.split(text, r"\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.slice(F.filter(stripped, lambda x: x != ""), 1, most)


def sentences(text: Column) -> Column:
    """Pieces that end at . ! ? or, before a capital or a bracket, at ; or :."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|(?<=[;:])\s+(?=[A-Z(])"), lambda x: F.trim(x) != "")


def long_words(text: Column) -> Column:
    return F.filter(T.words(text), lambda w: F.length(w) >= 3)


def grams(text: Column, n: int = 6) -> Column:
    """Distinct runs of n characters, none of a shorter text."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(T.shingles(text, n))


#: A bracketed amendment marker such as [F17A].
AMENDED = r"\[[A-Z]{1,2}[0-9]+[A-Z]?\]"


def content_only(text: Column) -> Column:
    """Without amendment markers."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, AMENDED, " "), " +", " "))


def compact_markers(text: Column) -> Column:
    """F 17 A becomes F17A."""
    return F.regexp_replace(text, r"\b([CFIPXME]) ?([0-9]+) ?([A-Z]?)\b", "$1$2$3")


def word_bag(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(T.comparison_key(text), " ")), " ")


def sort_ratio(a: Column, b: Column) -> Column:
    """Levenshtein ratio of the sorted words; 1 where only spacing or punctuation differ, 0 where one line has no words."""
    return guarded(word_bag(a), word_bag(b))


def bare(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"\s+", "")


def spaceless_ratio(a: Column, b: Column) -> Column:
    """Levenshtein ratio of the characters without white space; 0 where one line has none."""
    return guarded(bare(a), bare(b))


def guarded(a: Column, b: Column) -> Column:
    return F.when((a == "") != (b == ""), 0.0).otherwise(T.levenshtein_ratio(a, b))


#: Fixed value: lines whose contents agree so far count by that.
AGREED = 0.97


def combined_ratio(a: Column, b: Column) -> Column:
    """The similarity of two lines: that of what they say beside amendment markers where it is AGREED and above, else the larger of the ratios of sorted words and of characters."""
    best = lambda x, y: F.greatest(sort_ratio(x, y), spaceless_ratio(x, y))
    content = best(content_only(a), content_only(b))
    said = (content_only(a) != "") & (content_only(b) != "")
    return F.when(said & (content >= AGREED), content).otherwise(best(a, b))


def difference(a: Column, b: Column) -> Column:
    """same, space (only white space differs), punctuation (only that differs too), case, or words."""
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    key = lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")
    return F.when(a == b, "same").when(bare(a) == bare(b), "space").when(key(a) == key(b), "punctuation").when(F.lower(key(a)) == F.lower(key(b)), "case").otherwise("words")


def signature(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]+", "")


#: An outline marker at the start of a provision.
MARKER = r"(?:\((?:[a-z]{1,3}|[0-9]{1,3}|[ivxlcdm]{1,6})\)?|(?:[a-z]{1,3}|[0-9]{1,3}|[ivxlcdm]{1,6})[).:])"


def without_anchors(text: Column) -> Column:
    """Without up to four outline markers at the start, such as (a), 2. or iv)."""
    return F.trim(F.regexp_replace(normalised(F.lower(text)), rf"^(?: *{MARKER} *){{1,4}}", ""))


def anchor(line: Column) -> Column:
    """What a line is anchored at: a section, part, chapter or schedule with its number, a bracketed mark, a date, or nothing."""
    low = T.lowered(T.trimmed(line))
    found = lambda p: F.regexp_extract(low, T.as_re2(p), 1)
    named = [(k, rf"^{w} ([0-9]+[a-z]?|[ivxlc]+)\b") for k, w in (("part", "part"), ("chapter", "chapter"), ("schedule", "schedule"), ("sec", "(?:section|sec\\.)"), ("ann", "annex"))]
    ladder = F.lit(None).cast("string")
    steps = [*named, ("sec", r"^([0-9]+[a-z]?)\.? [a-z]"), ("mark", r"^\(([a-z0-9]{1,4})\)"), ("date", r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})")]
    return F.coalesce(*[F.when(found(p) != "", F.concat(F.lit(f"{k}:"), found(p))) for k, p in steps], ladder)


def anchor_score(a: Column, b: Column) -> Column:
    """1 for one anchor, 0.5 for anchors of one family, 0 otherwise and without anchors."""
    family = lambda x: F.substring_index(x, ":", 1)
    return F.coalesce(F.when(a == b, 1.0).when(family(a) == family(b), 0.5), F.lit(0.0))


def alignment_key(line: Column) -> Column:
    """ANCH:: and the anchor, or the first 60 characters of the line's comparison key."""
    return F.coalesce(F.concat(F.lit("ANCH::"), anchor(line)), F.substring(T.comparison_key(line), 1, 60))


def rolling_hash(text: Column) -> Column:
    """h * 31 + code of each character, in unsigned 32 bits."""
    chars = F.split(text, "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c).cast("long"), F.lit(1 << 32)))


def meaningful(value: Column) -> Column:
    """The trimmed value, or null where it says nothing."""
    v = F.trim(value)
    return F.when(~v.isin("", "—", "-", "{}", "[]", "null"), v)


def title_of(name: Column) -> Column:
    """A file name or last part of a path as a title: no ending, spaces for underscores and hyphens, the first letter a capital."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[A-Za-z0-9]{1,5}$", ""), "[_-]+", " "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 10_000))


def plain_xml(text: Column) -> Column:
    """Without tags; the five predefined entities are decoded, & last."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def csv_field(value: Column) -> Column:
    """Quoted, inner quotes doubled, where the value holds a comma, a quote or a line end."""
    return F.when(F.rlike(value, F.lit('[,"\n\r]')), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


#: Roman digits.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(numeral: Column) -> Column:
    """The value of a Roman numeral in either case: a digit before a larger one is taken off."""
    value = F.create_map(*[F.lit(x) for item in ROMAN.items() for x in item])
    digits = F.transform(F.filter(F.split(F.upper(numeral), ""), lambda c: c != ""), lambda c: value[c])
    each = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def ordinal_key(label: Column) -> Column:
    """4B is 402, 4 is 400, Part IV is 400 as well: a hundred times the first number, with the letter behind it, or the last word that is a Roman numeral; a billion for what has neither. Numbers of ten digits and more have neither, as a long text has no place among labels."""
    number, letter = F.regexp_extract(label, r"([0-9]+)", 1), F.upper(F.regexp_extract(label, r"^[^0-9]*[0-9]+([A-Za-z])(?:[^A-Za-z]|$)", 1))
    numeral = F.regexp_extract(F.trim(label), r"(?:^|\s)([IVXLCDMivxlcdm]+)[.,;:]*$", 1)
    arabic = F.when(F.length(number) <= 9, number.try_cast("long") * 100 + F.when(letter == "", 0).otherwise(F.ascii(letter) - 64))
    return F.coalesce(arabic, F.when((number == "") & (numeral != ""), roman(numeral).cast("long") * 100), F.lit(1_000_000_000).cast("long"))
