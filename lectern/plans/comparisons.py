"""Comparison functions over conversations (a turn and the one before it as two versions), documents, pages and part labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import text as T
from ..operators import alignment as A
from ..operators import relational as R
from ..sources.tables import table


def pairs(spark, d) -> DataFrame:
    """(conv_id, turn, a, b): each turn and the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("a"), F.col("text").alias("b")).where("a is not null and b is not null")


PAIRS_SQL = "(SELECT conv_id, turn, a, b FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations) WHERE a IS NOT NULL AND b IS NOT NULL)"


def normalised_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.collapsed("text")).alias("collapsed"), F.md5(C.normalised(F.col("text"))).alias("normalised"), F.md5(C.unwrapped(F.col("text"))).alias("unwrapped"))


def edge_tokens(spark, d):
    t = C.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


def sentence_counts(spark, d):
    s = C.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.array_max(F.transform(s, lambda x: F.length(x))).alias("longest"))


def pair_similarity(spark, d):
    """Similarities of each turn and the one before: content words, long words, runs of six characters, sorted words, characters without spaces, and the combined one, by code points."""
    made = {"c": T.content_words, "l": C.long_words}
    # Distances take time with the square of a turn's length, so turns are dealt evenly after the window.
    p = pairs(spark, d).repartition(R.dealt_over(spark), "conv_id", "turn")
    p = p.select("conv_id", "turn", "a", "b", *[f(F.col(x)).alias(f"{k}_{x}") for k, f in made.items() for x in ("a", "b")])
    both = lambda f, k: f(F.col(f"{k}_a"), F.col(f"{k}_b"))
    # What both say beside their markers is compared for those that have any; for others it is what they are.
    marked = F.rlike("a", F.lit(C.AMENDED)) | F.rlike("b", F.lit(C.AMENDED))
    said = {x: F.when(marked, C.content_only(F.col(x))) for x in ("a", "b")}
    forms = {f"{k}_{x}": f(c) for k, f, of in (("bag", C.word_bag, F.col), ("bare", C.bare, F.col), ("said_bag", C.word_bag, said.get), ("said_bare", C.bare, said.get)) for x in ("a", "b") for c in (of(x),)}
    p = p.select("conv_id", "turn", "a", "b", both(T.jaccard, "c").alias("content"), both(T.jaccard, "l").alias("long"), ((said["a"] != "") & (said["b"] != "")).alias("said"), *[c.alias(k) for k, c in forms.items()])
    p = A.with_ratios(p, {k: (f"{k}_a", f"{k}_b") for k in ("bag", "bare", "said_bag", "said_bare")}, {"grams": ("a", "b")})
    agreed = F.greatest("said_bag", "said_bare")
    combined = F.when(F.col("said") & (agreed >= C.AGREED), agreed).otherwise(F.greatest("bag", "bare"))
    p = p.select("conv_id", "turn", "content", "long", "grams", F.col("bag").alias("sorted"), F.col("bare").alias("chars"), combined.alias("combined"))
    return p.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("content", "long", "grams", "sorted", "chars", "combined")])


def pair_numbers(spark, d):
    """Whether the numbers of one line of a document's are among those of the line before it."""
    w = Window.partitionBy("doc_id").orderBy("no")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    p = lines.withColumn("before", F.lag("line").over(w)).where("before is not null")
    return p.groupBy("doc_id").agg(F.count_if(T.subset(T.numeric_tokens(F.col("before")), T.numeric_tokens(F.col("line")))).alias("matching"), F.count("*").alias("n"))


def difference_kinds(spark, d):
    """How the turns of a conversation differ from the version in lower case or without its full stops, and from the one before."""
    p = pairs(spark, d)
    edited = F.when(F.col("turn") % 2 == 0, F.replace("b", F.lit("."), F.lit(""))).otherwise(F.lower("b"))
    return p.select("conv_id", "turn", C.difference(F.col("b"), edited).alias("edited"), C.difference(F.col("a"), F.col("b")).alias("before"), (C.word_bag(F.col("b")) == C.word_bag(edited)).alias("reflowed"), F.md5(C.signature(F.col("b"))).alias("signature"))


def labels_of_parts(spark, d) -> DataFrame:
    """(p_partkey, line): a provision line made of each part's columns."""
    p = table(spark, d, "part")
    kinds = F.array(*[F.lit(x) for x in ("Part {n} ", "Chapter {n} ", "Schedule {n} ", "Section {n}A ", "({n}) ", "{n}. ", "{n}B ", "[F{n}A] ", "F {n} A ", "")])
    kind = F.element_at(kinds, (F.col("p_size") % 10 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.replace(kind, F.lit("{n}"), F.col("p_size").cast("string")), "p_name").alias("line"))


LABELS_SQL = """(SELECT p_partkey, replace((['Part {n} ', 'Chapter {n} ', 'Schedule {n} ', 'Section {n}A ', '({n}) ', '{n}. ', '{n}B ', '[F{n}A] ', 'F {n} A ', ''])[p_size % 10 + 1], '{n}', p_size::VARCHAR) || p_name AS line FROM part)"""


def provision_lines(spark, d):
    """Provision lines without markers and anchors, their ordinal, and markers put together."""
    line = F.col("line")
    return labels_of_parts(spark, d).select("p_partkey", C.content_only(line).alias("content"), C.without_anchors(line).alias("bare"), C.compact_markers(line).alias("compact"), C.ordinal_key(F.substring_index(line, " ", 2)).alias("ordinal"))


def provision_anchors(spark, d):
    """Anchor and alignment key of each provision line, and how well its anchor fits that of the line before it in its brand."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    x = labels_of_parts(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").withColumn("anchor", C.anchor(F.col("line")))
    return x.select("p_partkey", "anchor", C.alignment_key(F.col("line")).alias("key"), C.anchor_score(F.lag("anchor").over(w), F.col("anchor")).alias("score"))


def page_titles(spark, d):
    """Title from the path, rolling hash of the address, whether it is safe to fetch, and the plain text's digest."""
    url = F.col("url")
    host = F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)
    private = F.rlike(host, F.lit(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)"))
    path = F.regexp_replace(url, r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", C.title_of(path).alias("title"), C.rolling_hash(url).alias("hash"), ((host != "") & ~private).alias("safe"), F.md5(C.plain_xml(F.col("html"))).alias("plain"))


def csv_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat_ws(",", F.col("doc_id").cast("string"), C.csv_field(F.col("text")))).alias("line"))


def first_meaningful(spark, d):
    """The first key of an event's properties that says something, and labels that are derived from the event."""
    key = lambda k: C.meaningful(F.get_json_object("props", f"$.{k}"))
    status = F.when(F.col("event_type") == "ONGOING", "DRAFT").otherwise(F.col("event_type"))
    era = F.when(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "old").otherwise("new")
    return table(spark, d, "events").select("event_id", F.coalesce(key("title"), key("k"), F.lit("?")).alias("first"), status.alias("status"), era.alias("era"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat_ws("/", era, status).alias("format"))


def process_types(spark, d):
    """Users with an urgent order count as evergreen, those with other orders as periodic, the rest as none."""
    u, o = table(spark, d, "customer"), table(spark, d, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    kind = F.when(F.col("urgent") == 1, "evergreen").when(F.col("urgent") == 0, "periodic").otherwise("none")
    return u.join(o, u.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment", kind.alias("type")).agg(F.count("*").alias("n"))


def expanded_values(spark, d):
    """`Brand Chapters 4, 5` as a row for each chapter."""
    text = F.concat(F.col("p_brand"), F.lit(" Chapters "), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") + 1).cast("string"))
    x = table(spark, d, "part").select("p_partkey", F.regexp_extract(text, r"^(.*) Chapters ([0-9, ]+)$", 1).alias("name"), F.explode(F.split(F.regexp_extract(text, r"^(.*) Chapters ([0-9, ]+)$", 2), ", *")).alias("value"))
    return x.select("p_partkey", F.concat_ws(" Chapter ", "name", "value").alias("entry"))


def ids_of_texts(spark, d):
    """The ids in each part's brand, type and name: digits after a mark, padded to four, in order and once each; and team names as `Name (CODE) / Region`, taken apart."""
    text = F.concat_ws(" ", "p_brand", F.concat(F.lit("#"), F.col("p_size").cast("string")), "p_name", "p_brand")
    ids = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("#([0-9]+)"), F.lit(1)), lambda x: F.lpad(x, 4, "0")))
    return table(spark, d, "part").select("p_partkey", F.array_join(ids, ";").alias("ids"))


def authorities(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    text = F.concat("n_name", F.lit(" ("), F.upper(F.substring("n_name", 1, 3)), F.lit(") / "), "r_name")
    got = [F.regexp_extract(text, r"^(.*) \(([A-Z]+)\) / (.*)$", i).alias(c) for i, c in ((1, "name"), (2, "code"), (3, "geography"))]
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", *got)


def link_notes(spark, d):
    """Links of each page with the note behind them (their text), balanced to the closing bracket."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    x = table(spark, d, "pages").select("page_id", F.posexplode(found).alias("no", "link"))
    return x.select("page_id", "no", F.regexp_extract("link", 'href="([^"]*)"', 1).alias("url"), F.trim(F.regexp_extract("link", ">([^<]*)<", 1)).alias("note"))


def line_zip(spark, d):
    """Lines of a turn beside those of the turn before, by position, where both have equally many."""
    split = lambda c: F.split(c, "\n")
    p = pairs(spark, d).where(F.size(split("a")) == F.size(split("b")))
    x = p.select("conv_id", "turn", F.posexplode(F.arrays_zip(split("a").alias("x"), split("b").alias("y"))).alias("no", "z"))
    return x.select("conv_id", "turn", "no", F.md5("z.x").alias("old"), F.md5("z.y").alias("new"))


def orphan_pairs(spark, d):
    """Each turn with the first later one of its conversation that begins with the same word."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.regexp_extract("text", r"^(\w+)", 1)).alias("word")).where("word <> ''")
    w = Window.partitionBy("conv_id", "word").orderBy("turn")
    return c.select("conv_id", "turn", "word", F.lead("turn").over(w).alias("later")).where("later is not null")


def unmatched_turns(spark, d):
    """Turns without a near copy (spaceless ratio of 0.8 and more) in the turn before or after them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"before": F.lag("text").over(w), "after": F.lead("text").over(w)})
    near = lambda x: F.coalesce(C.spaceless_ratio(F.col("text"), F.col(x)) >= 0.8, F.lit(False))
    return c.where(~near("before") & ~near("after")).groupBy("role").agg(F.count("*").alias("n"))


def emphasis_changes(spark, d):
    """Lines that documents have in several spellings of case or punctuation: how many spellings, and in how many documents."""
    x = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("key", T.comparison_key(F.col("line"))).where("key <> ''")
    return x.groupBy("key").agg(F.countDistinct("line").alias("spellings"), F.countDistinct("doc_id").alias("docs")).where("spellings > 1").select(F.md5("key").alias("key"), "spellings", "docs")


_KEY = lambda x: rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_WORDS = lambda x: f"list_filter(list_distinct(string_split({_KEY(x)}, ' ')), lambda w: w <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_JACCARD = lambda a, b: f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"
_BAG = lambda x: f"array_to_string(list_sort(string_split({_KEY(x)}, ' ')), ' ')"
_RATIO = lambda a, b: f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"
_BARE = lambda x: rf"regexp_replace({x}, '\s+', '', 'g')"
_ALNUM = lambda x: rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g')"
_DIFF = lambda a, b: f"CASE WHEN {a} = {b} THEN 'same' WHEN {_BARE(a)} = {_BARE(b)} THEN 'space' WHEN {_ALNUM(a)} = {_ALNUM(b)} THEN 'punctuation' WHEN lower({_ALNUM(a)}) = lower({_ALNUM(b)}) THEN 'case' ELSE 'words' END"
#: The letters beyond ASCII of the given turns: DuckDB measures distances in bytes, so each of them becomes a byte of its own in the oracle.
_BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_ONE = lambda x: f"translate({x}, '{_BEYOND}', {' || '.join(f'chr({c})' for c in [*range(1, 9), *range(14, 27)])})"
_GUARDED = lambda a, b: f"(CASE WHEN ({a} = '') <> ({b} = '') THEN 0.0 ELSE {_RATIO(_ONE(a), _ONE(b))} END)"
_SAID = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '\[[A-Z]{{1,2}}[0-9]+[A-Z]?\]', ' ', 'g'), ' +', ' ', 'g'))"
_BEST = lambda a, b: f"greatest({_GUARDED(_BAG(a), _BAG(b))}, {_GUARDED(_BARE(a), _BARE(b))})"
_GRAMS = lambda x: f"list_distinct(list_transform(range(1, length({x}) - 4), lambda i: substring({x}, i, 6)))"
_NORM = lambda x: rf"trim(regexp_replace(translate(regexp_replace({x}, '([A-Za-z])-[ \t]*\n\s*([A-Za-z])', '\1\2', 'g'), '‘’“”', '''''\"\"'), '\s+', ' ', 'g'))"
_CONTENT = lambda x: f"list_filter({_WORDS(x)}, lambda w: NOT list_contains({_STOP}, w) AND length(w) > 1)"
_LONG = lambda x: f"list_filter({_WORDS(x)}, lambda w: length(w) >= 3)"
_ANCHOR_STEPS = [("part", r"^part ([0-9]+[a-z]?|[ivxlc]+)\b"), ("chapter", r"^chapter ([0-9]+[a-z]?|[ivxlc]+)\b"), ("schedule", r"^schedule ([0-9]+[a-z]?|[ivxlc]+)\b"), ("sec", r"^(?:section|sec\.) ([0-9]+[a-z]?|[ivxlc]+)\b"),
    ("ann", r"^annex ([0-9]+[a-z]?|[ivxlc]+)\b"), ("sec", r"^([0-9]+[a-z]?)\.? [a-z]"), ("mark", r"^\(([a-z0-9]{1,4})\)"), ("date", r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})")]
_ANCHOR = "coalesce(" + ", ".join(f"CASE WHEN regexp_extract(lower(trim(line)), '{p}', 1) <> '' THEN '{k}:' || regexp_extract(lower(trim(line)), '{p}', 1) END" for k, p in _ANCHOR_STEPS) + ")"

QUERIES = {
    "normalised_texts": (normalised_texts, rf"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, md5({_NORM('text')}) AS normalised, md5(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\.\n([^\n]|$)', '.' || chr(1) || '\1', 'g'), '\.\n([^\n]|$)', '.' || chr(1) || '\1', 'g'), '(\n*)\n', '\1 ', 'g'), chr(1), chr(10)), '\n+', chr(10), 'g')) AS unwrapped FROM documents"),
    "edge_tokens": (edge_tokens, r"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id,
        list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '') AS t FROM documents)"""),
    "sentence_counts": (sentence_counts, r"""SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, list_filter(string_split(
        regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '([;:])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents)"""),
    "pair_similarity": (pair_similarity, f"""WITH p AS (SELECT *, {_SAID('a')} AS sa, {_SAID('b')} AS sb FROM {PAIRS_SQL}), q AS (SELECT *, {_BEST('sa', 'sb')} AS said FROM p)
        SELECT conv_id, turn, round({_JACCARD(_CONTENT('a'), _CONTENT('b'))}, 6) AS content, round({_JACCARD(_LONG('a'), _LONG('b'))}, 6) AS long,
        round(CASE WHEN length(a) < 6 OR length(b) < 6 THEN 0.0 ELSE {_JACCARD(_GRAMS('a'), _GRAMS('b'))} END, 6) AS grams, round({_GUARDED(_BAG('a'), _BAG('b'))}, 6) AS sorted,
        round({_GUARDED(_BARE('a'), _BARE('b'))}, 6) AS chars, round(CASE WHEN sa <> '' AND sb <> '' AND said >= 0.97 THEN said ELSE {_BEST('a', 'b')} END, 6) AS combined FROM q"""),
    "pair_numbers": (pair_numbers, """WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents),
        p AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(line), '([0-9]+[a-z]?)', 1)) AS y, list_distinct(regexp_extract_all(lower(lag(line) OVER (PARTITION BY doc_id ORDER BY no)), '([0-9]+[a-z]?)', 1)) AS x FROM l)
        SELECT doc_id, count(*) FILTER (WHERE len(list_intersect(x, y)) = least(len(x), len(y))) AS matching, count(*) AS n FROM p WHERE x IS NOT NULL GROUP BY 1"""),
    "difference_kinds": (difference_kinds, f"""WITH p AS (SELECT *, CASE WHEN turn % 2 = 0 THEN replace(b, '.', '') ELSE lower(b) END AS e FROM {PAIRS_SQL})
        SELECT conv_id, turn, {_DIFF('b', 'e')} AS edited, {_DIFF('a', 'b')} AS before, {_BAG('b')} = {_BAG('e')} AS reflowed, md5(regexp_replace(lower(b), '[^a-z]+', '', 'g')) AS signature FROM p"""),
    "provision_lines": (provision_lines, rf"""SELECT * EXCLUDE (digits) FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(line, '\[[A-Z]{{1,2}}[0-9]+[A-Z]?\]', ' ', 'g'), ' +', ' ', 'g')) AS content,
        trim(regexp_replace({_NORM('lower(line)')}, '^(?: *{C.MARKER} *){{1,4}}', '')) AS bare, regexp_replace(line, '\b([CFIPXME]) ?([0-9]+) ?([A-Z]?)\b', '\1\2\3', 'g') AS compact,
        coalesce(regexp_extract(array_to_string(string_split(line, ' ')[1:2], ' '), '([0-9]+)', 1), '') AS digits, CASE WHEN digits = '' THEN 1000000000 ELSE digits::BIGINT * 100
          + coalesce(ascii(nullif(upper(regexp_extract(array_to_string(string_split(line, ' ')[1:2], ' '), '^[^0-9]*[0-9]+([A-Za-z])(?:[^A-Za-z]|$)', 1)), '')) - 64, 0) END AS ordinal FROM {LABELS_SQL})"""),
    "provision_anchors": (provision_anchors, f"""WITH x AS (SELECT p_partkey, p_brand, line, {_ANCHOR} AS anchor FROM {LABELS_SQL} JOIN part USING (p_partkey)),
        y AS (SELECT *, lag(anchor) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM x)
        SELECT p_partkey, anchor, coalesce('ANCH::' || anchor, substring({_KEY('line')}, 1, 60)) AS key, coalesce(CASE WHEN b = anchor THEN 1.0 WHEN string_split(b, ':')[1] = string_split(anchor, ':')[1] THEN 0.5 END, 0.0)::DOUBLE AS score FROM y"""),
    "page_titles": (page_titles, r"""WITH p AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '\.[A-Za-z0-9]{1,5}$', ''), '[_-]+', ' ', 'g')) AS t, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)
        SELECT page_id, upper(substring(t, 1, 1)) || substring(t, 2) AS title, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS hash,
        host <> '' AND NOT regexp_matches(host, '^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') AS safe,
        md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS plain FROM p"""),
    "csv_lines": (csv_lines, """SELECT doc_id, md5(doc_id::VARCHAR || ',' || CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS line FROM documents"""),
    "first_meaningful": (first_meaningful, """WITH e AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'old' ELSE 'new' END AS era, CASE WHEN event_type = 'ONGOING' THEN 'DRAFT' ELSE event_type END AS status FROM events)
        SELECT event_id, coalesce(CASE WHEN trim(json_extract_string(props, '$.title')) NOT IN ('', '—', '-', '{}', '[]', 'null') THEN trim(json_extract_string(props, '$.title')) END,
          CASE WHEN trim(json_extract_string(props, '$.k')) NOT IN ('', '—', '-', '{}', '[]', 'null') THEN trim(json_extract_string(props, '$.k')) END, '?') AS first,
        status, era, strftime(ts, '%Y-%m-%d') AS day, era || '/' || status AS format FROM e"""),
    "process_types": (process_types, """WITH o AS (SELECT o_custkey, max((o_orderpriority = '1-URGENT')::INT) AS urgent FROM orders GROUP BY 1)
        SELECT c_mktsegment, CASE WHEN urgent = 1 THEN 'evergreen' WHEN urgent = 0 THEN 'periodic' ELSE 'none' END AS type, count(*) AS n FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1, 2"""),
    "expanded_values": (expanded_values, "SELECT p_partkey, p_brand || ' Chapter ' || unnest([p_size, p_size + 1]) AS entry FROM part"),
    "ids_of_texts": (ids_of_texts, """SELECT p_partkey, CASE WHEN regexp_extract(p_brand, '#([0-9]+)', 1)::INT = p_size THEN lpad(p_size::VARCHAR, 4, '0') ELSE lpad(regexp_extract(p_brand, '#([0-9]+)', 1), 4, '0') || ';' || lpad(p_size::VARCHAR, 4, '0') END AS ids FROM part"""),
    "authorities": (authorities, "SELECT n_nationkey, n_name AS name, upper(substring(n_name, 1, 3)) AS code, r_name AS geography FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "link_notes": (link_notes, """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 0) AS x FROM pages), m AS (SELECT page_id, unnest(range(len(x))) AS no, unnest(x) AS link FROM l)
        SELECT page_id, no, regexp_extract(link, 'href="([^"]*)"', 1) AS url, trim(regexp_extract(link, '>([^<]*)<', 1)) AS note FROM m"""),
    "line_zip": (line_zip, f"""WITH p AS (SELECT *, string_split(a, chr(10)) AS x, string_split(b, chr(10)) AS y FROM {PAIRS_SQL}), q AS (SELECT conv_id, turn, x, y, unnest(range(len(x))) AS no FROM p WHERE len(x) = len(y))
        SELECT conv_id, turn, no, md5(x[no + 1]) AS old, md5(y[no + 1]) AS new FROM q"""),
    "orphan_pairs": (orphan_pairs, r"""WITH c AS (SELECT conv_id, turn, lower(regexp_extract(text, '^(\w+)', 1)) AS word FROM conversations), l AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id, word ORDER BY turn) AS later FROM c WHERE word <> '')
        SELECT conv_id, turn, word, later FROM l WHERE later IS NOT NULL"""),
    "unmatched_turns": (unmatched_turns, f"""WITH c AS (SELECT role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)
        SELECT role, count(*) AS n FROM c WHERE NOT coalesce({_RATIO(_BARE('text'), _BARE('p'))} >= 0.8, false) AND NOT coalesce({_RATIO(_BARE('text'), _BARE('q'))} >= 0.8, false) GROUP BY 1"""),
    "emphasis_changes": (emphasis_changes, f"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), y AS (SELECT doc_id, line, {_KEY('line')} AS key FROM x)
        SELECT md5(key) AS key, count(DISTINCT line) AS spellings, count(DISTINCT doc_id) AS docs FROM y WHERE key <> '' GROUP BY key HAVING count(DISTINCT line) > 1"""),
}
