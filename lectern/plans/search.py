"""Nested values, texts found among others, and patterns of labels, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nested as N
from ..operators import patterns as P
from ..operators import probe as S
from ..operators import relational as R
from ..sources.tables import table
from .comparisons import LABELS_SQL, labels_of_parts
from .revisions import _RATIO, EDITED_SQL, edited_lines


def event_versions(spark, d) -> DataFrame:
    """(event_id, old, new): nested JSON of each event as it was and as it came in, with empty strings, nulls and arrays."""
    e, n = table(spark, d, "events"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda *v: F.element_at(F.array(*v), (n % len(v) + 1).cast("int"))
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    tags = pick(F.lit("[]"), F.concat(F.lit("["), k.cast("string"), F.lit(',"-"]')), F.lit('["—",null]'))
    new = F.concat(F.lit('{"title":'), pick(F.lit('""'), text("event_type"), F.lit("null"), F.lit('" - "')), F.lit(',"tags":'), tags, F.lit(',"more":{"kind":'), text("event_type"), F.lit(',"note":'), pick(F.lit("null"), F.lit('"n"'), F.lit("0"), F.lit('"null"'), F.lit("false")), F.lit("}}"))
    old = F.concat(F.lit('{"title":"old","tags":["t",{"u":""}],"more":'), pick(F.lit('{"note":"was","by":7}'), F.lit('"plain"'), F.lit("null")), F.lit(',"k":'), k.cast("string"), F.lit("}"))
    return e.select("event_id", old.alias("old"), new.alias("new"))


def leaf_counts(spark, d):
    """How many values of each event's old and new JSON say something."""
    return N.leaf_count(N.leaf_count(event_versions(spark, d), "old", "old_leaves"), "new", "new_leaves").select("event_id", "old_leaves", "new_leaves")


def deep_merge(spark, d):
    """The deep merge of each event's new JSON with its old one."""
    x = N.deep_merge(event_versions(spark, d), "new", "old")
    part = lambda p: F.get_json_object("merged", p)
    return x.select("event_id", part("$.title").alias("title"), part("$.tags").alias("tags"), part("$.more.kind").alias("kind"), part("$.more.note").alias("note"), part("$.more.by").alias("by"), part("$.k").alias("k"))


def corpus_probe(spark, d):
    """The provision line most similar to each edited line, found by an index of word runs."""
    nodes = labels_of_parts(spark, d).select(F.col("p_partkey").alias("node"), "line").groupBy(F.concat_ws(" ", "line", "line").alias("text")).agg(F.min("node").alias("node"))
    index = R.kept(S.run_index(nodes.select("node", "text")))
    queries = edited_lines(spark, d).select(F.col("p_partkey").alias("query"), F.concat_ws(" ", "b", "a").alias("text"))
    return S.probe(queries, index).select(F.col("query").alias("p_partkey"), "node", "shared", F.round("similarity", 6).alias("similarity"))


def heading_subsets(spark, d):
    """Part names all of whose words stand in a provision line of another part."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("left"))
    lines = labels_of_parts(spark, d).groupBy(F.col("line").alias("text")).agg(F.min("p_partkey").alias("right"))
    return S.token_subsets(p, lines).where(F.col("left") != F.col("right")).select(F.col("left").alias("p_partkey"), F.col("right").alias("line_of"))


def document_lines(spark, d) -> DataFrame:
    """(change, text): the lines of documents, numbered by document and line."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "text"))
    return x.select((F.col("doc_id") * (1 << 20) + F.col("no")).alias("change"), "text")


def change_locate(spark, d):
    """The line of the documents that is most similar to each benchmark passage, by runs of six characters."""
    x = S.locate_change(table(spark, d, "benchmark").withColumnRenamed("item_id", "context"), document_lines(spark, d))
    return x.select(F.col("context").alias("item_id"), F.floor(F.col("change") / (1 << 20)).alias("doc_id"), (F.col("change") % (1 << 20)).alias("line_no"), F.round("similarity", 6).alias("similarity"))


def passage_windows(spark, d):
    """Where in its document each located benchmark passage fits best."""
    found = change_locate(spark, d).select("item_id", "doc_id")
    x = found.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")), "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return S.best_window(x).select("item_id", "doc_id", "start", F.round("overlap", 6).alias("overlap"))


#: Columns whose values are taken as examples of labels.
LABELS = {"customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",), "nation": ("n_name",), "region": ("r_name",), "part": ("p_name", "p_brand", "p_type"), "orders": ("o_orderpriority", "o_orderstatus"), "conversations": ("role",), "documents": ("source",)}


def examples(spark, d) -> DataFrame:
    """(id, text): the values of the label columns of all tables, by column."""
    every = [table(spark, d, t).select(F.lit(c).alias("id"), F.col(c).alias("text")) for t, columns in LABELS.items() for c in columns]
    return reduce(DataFrame.union, every).distinct()


def pattern_inference(spark, d):
    """The patterns of the values of each label column, and how many values have each."""
    return P.infer(examples(spark, d)).select(F.col("id").alias("label"), "pattern", "examples")


def pattern_conflicts(spark, d):
    """Label columns whose patterns overlap."""
    found = P.infer(examples(spark, d)).select(F.lit("all").alias("id"), F.concat_ws(":", "id", "pattern").alias("level"), "pattern")
    return P.conflicts(found).select("a", "b")


_RUNS = r"[0-9]+|[A-Z]+|[a-z]+|\s+|[^0-9A-Za-z\s]"
_QUOTE = lambda x: rf"regexp_replace({x}, '([\\.^$|?*+(){{}}\[\]\-#&~])', '\\\1', 'g')"
_KIND = lambda x: rf"CASE WHEN regexp_matches({x}, '^[0-9]') THEN '[0-9]' WHEN regexp_matches({x}, '^[A-Z]') THEN '[A-Z]' WHEN regexp_matches({x}, '^[a-z]') THEN '[a-z]' WHEN regexp_matches({x}, '^\s') THEN '\s' ELSE {_QUOTE(x)} END"
_KEY = lambda x: rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_GRAMS = lambda k, n: f"list_distinct(list_transform(range(1, greatest(1, len(string_split({k}, ' ')) - {n} + 1) + 1), lambda i: array_to_string(string_split({k}, ' ')[i:i + {n} - 1], ' ')))"
_BAG = lambda k: f"array_to_string(list_sort(string_split({k}, ' ')), ' ')"
_CHARS = lambda k: f"(CASE WHEN length({k}) < 6 THEN [] ELSE list_distinct(list_transform(range(1, length({k}) - 4), lambda i: substr({k}, i, 6))) END)"

QUERIES = {
    "leaf_counts": (leaf_counts, """SELECT event_id, (2 + 1 + (ARRAY[2, 1, 0])[event_id % 3 + 1])::BIGINT AS old_leaves,
        ((event_id % 4 = 1)::INT + (event_id % 3 = 1)::INT + 1 + (ARRAY[0, 1, 1, 0, 1])[event_id % 5 + 1])::BIGINT AS new_leaves FROM events"""),
    "deep_merge": (deep_merge, """WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
        SELECT event_id, CASE WHEN event_id % 4 = 1 THEN event_type ELSE 'old' END AS title, CASE WHEN event_id % 3 = 1 THEN '[' || k || ',"-"]' ELSE '["t",{"u":""}]' END AS tags, event_type AS kind,
        CASE event_id % 5 WHEN 1 THEN 'n' WHEN 2 THEN '0' WHEN 4 THEN 'false' WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN 'was' ELSE 'null' END ELSE CASE WHEN event_id % 3 = 0 THEN 'was' END END AS note,
        CASE WHEN event_id % 3 = 0 THEN '7' END AS by, k FROM e"""),
    "corpus_probe": (corpus_probe, f"""WITH n AS (SELECT line || ' ' || line AS text, min(p_partkey) AS node FROM {LABELS_SQL} GROUP BY 1), nk AS MATERIALIZED (SELECT node, {_KEY("text")} AS key FROM n),
        ng AS MATERIALIZED (SELECT node, key, {_GRAMS("key", 4)} AS runs FROM nk), qk AS (SELECT p_partkey AS query, {_KEY("b || ' ' || a")} AS asked FROM {EDITED_SQL}), qg AS MATERIALIZED (SELECT *, {_GRAMS("asked", 4)} AS wanted FROM qk WHERE asked <> ''),
        m AS (SELECT query, node, count(*) AS shared FROM (SELECT query, unnest(wanted) AS run FROM qg) JOIN (SELECT node, unnest(runs) AS run FROM ng) USING (run) GROUP BY 1, 2),
        c AS (SELECT m.query, m.node, m.shared, asked, key FROM m JOIN qg USING (query) JOIN ng ON ng.node = m.node WHERE shared >= greatest(1, ceil(len(wanted) * 0.2 - 1e-9)) QUALIFY row_number() OVER (PARTITION BY m.query ORDER BY m.shared DESC, m.node) <= 20),
        s AS (SELECT *, greatest({_RATIO("asked", "key")}, {_RATIO(_BAG("asked"), _BAG("key"))}) AS sim FROM c)
        SELECT query AS p_partkey, node, shared::INTEGER AS shared, round(sim, 6) AS similarity FROM s WHERE sim >= 0.82 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, shared DESC, node) = 1"""),
    "heading_subsets": (heading_subsets, f"""WITH a AS (SELECT min(p_partkey) AS p_partkey, list_distinct(string_split({_KEY("p_name")}, ' ')) AS w FROM part GROUP BY p_name), b AS (SELECT min(p_partkey) AS line_of, list_distinct(string_split({_KEY("line")}, ' ')) AS v FROM {LABELS_SQL} GROUP BY line)
        SELECT p_partkey, line_of FROM a JOIN b ON list_has_all(v, w) WHERE p_partkey <> line_of"""),
    "change_locate": (change_locate, f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
        r AS MATERIALIZED (SELECT doc_id, no, {_CHARS(_KEY("line"))} AS runs FROM l), q AS MATERIALIZED (SELECT item_id, {_CHARS(_KEY("text"))} AS runs FROM benchmark),
        m AS (SELECT item_id, doc_id, no, count(*) AS shared FROM (SELECT item_id, unnest(runs) AS run FROM q) JOIN (SELECT doc_id, no, unnest(runs) AS run FROM r) USING (run) GROUP BY 1, 2, 3),
        s AS (SELECT m.*, shared / (len(q.runs) + len(r.runs) - shared) AS sim FROM m JOIN q USING (item_id) JOIN r ON r.doc_id = m.doc_id AND r.no = m.no)
        SELECT item_id, doc_id, no AS line_no, round(sim, 6) AS similarity FROM s WHERE sim >= 0.25 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id, no) = 1"""),
    "passage_windows": (passage_windows, None),
    "pattern_inference": (pattern_inference, f"""WITH e AS ({" UNION ".join(f"SELECT '{c}' AS id, {c} AS text FROM {t}" for t, columns in LABELS.items() for c in columns)}),
        r AS (SELECT id, text, regexp_extract_all(text, '{_RUNS}') AS runs FROM e WHERE text <> ''), s AS (SELECT *, array_to_string(list_transform(runs, lambda x: {_KIND("x")}), '') AS shape FROM r),
        p AS (SELECT id, shape, unnest(runs) AS run, unnest(range(len(runs))) AS no FROM s), b AS (SELECT id, shape, no, min(length(run)) AS low, max(length(run)) AS high, min(run) AS one, max(run) AS other, count(*) AS n FROM p GROUP BY 1, 2, 3),
        k AS (SELECT *, CASE WHEN one = other AND n > 1 AND regexp_matches(one, '^[A-Za-z]') THEN {_QUOTE("one")} ELSE {_KIND("one")} || CASE WHEN high = 1 THEN '' WHEN low = high THEN '{{' || low || '}}' ELSE '{{' || low || ',' || high || '}}' END END AS piece FROM b)
        SELECT id AS label, string_agg(piece, '' ORDER BY no) AS pattern, max(n) AS examples FROM k GROUP BY id, shape"""),
    "pattern_conflicts": (pattern_conflicts, None),
}
