"""Document dataflow: lines, sections, runs, similarity, containment, changes, over documents, conversations, labels, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import relational as R
from ..sources.tables import table


def repeated_lines(spark, d):
    """Lines that stand in three documents and more: headers, footers, license lines."""
    return D.lines(table(spark, d, "documents")).groupBy(F.trim("line").alias("line")).agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs >= 3")


def noise_lines(spark, d):
    x = D.lines(table(spark, d, "documents"))
    return x.groupBy("doc_id").agg(F.count_if(T.is_noise(F.col("line"))).alias("noise"), F.count("*").alias("n"))


def heading_sections(spark, d):
    """Short lines begin sections that extend to the next one; texts before the first heading have none."""
    x = D.lines(table(spark, d, "documents")).where(F.length("line") <= 24)
    end = F.lead("line_no").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return x.select("doc_id", "line_no", F.trim("line").alias("heading"), end.alias("end"))


def small_turn_merge(spark, d):
    """Turns under 300 characters join the turn before; the merged parts with their extent and length."""
    c = table(spark, d, "conversations")
    parts = D.islands(c, ["conv_id"], ["turn"], (F.col("turn") == 0) | (F.length("text") >= 300), "part")
    return parts.groupBy("conv_id", "part").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


def forward_fill_question(spark, d):
    """The turn of the last question for each turn."""
    c = D.forward_fill(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "question")
    return c.select("conv_id", "turn", "question")


def neighbour_context(spark, d):
    """The last three words of the turn before and the role of the turn after."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = F.split(F.trim("text"), " ")
    tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), F.lit(3)), " ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag(tail).over(w).alias("before"), F.lead("role").over(w).alias("next_role"))


def label_pivot(spark, d):
    """Labelled documents by language: counts of each kind, with the share of toxic ones."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return x.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"), F.count("*").alias("n"), F.floor(F.count_if(F.col("toxic") == 1) * 100 / F.count("*") + 0.5).cast("long").alias("toxic_percent"))


def section_groups(spark, d):
    """Documents by source in the order of first appearance; no source counts as Ungrouped."""
    x = table(spark, d, "documents").groupBy(F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("Ungrouped")).alias("section")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return x.withColumn("position", F.row_number().over(Window.orderBy("first_doc")).cast("long"))


def sequence_gaps(spark, d):
    """Conversations whose turns have gaps or repeats."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("turn").alias("turns"), F.max("turn").alias("last"), F.min("turn").alias("first"))
    return c.select("conv_id", (F.col("last") - F.col("first") + 1 - F.col("turns")).alias("missing"), (F.col("n") - F.col("turns")).alias("repeated"))


def preferred_by_length(spark, d):
    """Of the documents of a source and language the one with the most characters, then the smallest id."""
    return R.last_n(table(spark, d, "documents"), ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")], 1).select("source", "lang", "doc_id", "n_chars")


def content_ids(spark, d):
    """Documents by the hash of their trimmed text: the first of each and how many there are."""
    return table(spark, d, "documents").groupBy(T.stable_id(F.coalesce("text", F.lit(""))).alias("content_id")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


def numeric_profile(spark, d):
    """Distinct numbers of each document and how many there are."""
    tokens = T.numeric_tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), F.array_join(F.array_sort(tokens), " ").alias("numbers"))


def levenshtein_pairs(spark, d):
    """Different part names with one first letter and a ratio of 0.7 and above."""
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("k", F.substring("name", 1, 1))
    a, b = n.select(F.col("name").alias("a"), "k"), n.select(F.col("name").alias("b"), "k")
    return a.join(b, "k").where("a < b").withColumn("ratio", T.levenshtein_ratio(F.col("a"), F.col("b"))).where("ratio >= 0.7").select("a", "b", T.rounded(F.col("ratio")).alias("ratio"))


def trigram_neighbours(spark, d):
    """Different brands' part names with a trigram similarity of 0.6 and above."""
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    sets = n.select(F.xxhash64("name").alias("id"), F.lit("all").alias("block"), T.shingles(F.col("name"), 3).alias("words"), "name")
    pairs = D.similar_sets(sets, 0.6)
    names = sets.select("id", "name")
    out = pairs.join(names.withColumnsRenamed({"id": "a", "name": "x"}), "a").join(names.withColumnsRenamed({"id": "b", "name": "y"}), "b")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), T.rounded(F.col("similarity")).alias("similarity"))


def near_documents(spark, d):
    """Different documents of one language with a word similarity of 0.8 and above; of equal word sets the smallest id stands for all."""
    worded = table(spark, d, "documents").where(F.rlike("text", F.lit(r"[\p{L}\p{N}]")))
    x = worded.select("doc_id", F.col("lang").alias("block"), F.array_sort(T.words(F.col("text"))).alias("words"))
    sets = x.groupBy("block", "words").agg(F.min("doc_id").alias("id"))
    return D.similar_sets(sets, 0.8)


def similar_documents(spark, d):
    return near_documents(spark, d).select("a", "b", T.rounded(F.col("similarity")).alias("similarity"))


def document_changes(spark, d):
    """Word-level changes between similar documents by kind."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    pairs = near_documents(spark, d).select("a", "b").join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return D.word_differences(pairs).groupBy("a", "b").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("add", "del", "mod")])


def text_chunks(spark, d):
    """Chunks of at most 1500 characters and an overlap of 150: how many, and the longest."""
    return D.chunks(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).cast("long").alias("longest"))


def passage_containment(spark, d):
    return D.contained(table(spark, d, "documents"), table(spark, d, "benchmark"))


def section_of_line(spark, d):
    """The deepest section around each line: sections open at short lines, and the last one opened contains the line."""
    x = D.lines(table(spark, d, "documents"))
    filled = D.forward_fill(x, ["doc_id"], ["line_no"], F.when(F.length("line") <= 24, F.col("line_no")), "section")
    return filled.groupBy("doc_id", F.coalesce("section", F.lit(-1).cast("long")).alias("section")).agg(F.count("*").alias("n"))


def page_links(spark, d):
    """Links of each page, distinct ones, and its host without www."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"#]+)'), F.lit(1))
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"^www\.", "")
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("distinct_links"))


def host_graph(spark, d):
    """Pages of a host family laid out as a tree of ten children a node, with the root and depth of each."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([a-z]+\.[a-z]+)(?:[/?#:]|$)", 1).alias("family"))
    first = p.groupBy("family").agg(F.min("page_id").alias("root"))
    nth = F.row_number().over(Window.partitionBy("family").orderBy("page_id")) - 1
    # Depth 1 holds ten pages, depth 2 a hundred, and the rest lies below.
    return p.withColumn("nth", nth).join(first, "family").select("page_id", "root", F.when(F.col("nth") == 0, 0).when(F.col("nth") <= 10, 1).when(F.col("nth") <= 110, 2).otherwise(3).cast("long").alias("depth"))


def text_statistics(spark, d):
    """Characters, and the distinct words of each text summed, by language."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"), F.max(F.length(t)).cast("long").alias("longest"), F.sum(F.size(T.words(t))).alias("words"))


def change_confidence(spark, d):
    """Confidence and reason of each change between similar part names, by how similar they are."""
    r = F.col("ratio")
    return levenshtein_pairs(spark, d).select("a", "b", F.when(r >= 0.92, 0.96).when(r >= 0.82, 0.88).otherwise(0.74).alias("confidence"), F.when(r >= 0.92, "wording").when(r >= 0.82, "partial").otherwise("rewrite").alias("reason"))


def field_changes(spark, d):
    """What changed from each event of a user to the next, a row for each field whose value differs; a field that is missing on one side differs."""
    e = table(spark, d, "events").select("user_id", "event_id", F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")).alias("after"))
    before = F.lag("after").over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = e.withColumn("before", before).where("before is not null")
    fields = pairs.select("user_id", "event_id", "before", F.explode("after").alias("field", "after"))
    changed = fields.withColumn("before", F.element_at("before", F.col("field"))).where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select("user_id", "event_id", "field", "before", "after")


def level_consolidation(spark, d):
    """Turns, order lines and parts by level; a level that any of the three knows has a row."""
    by = lambda name, level, out: table(spark, d, name).groupBy(F.col(level).cast("long").alias("level")).agg(F.count("*").alias(out))
    x = by("conversations", "turn", "turns").join(by("lineitem", "l_linenumber", "order_lines"), "level", "full").join(by("part", "p_size", "parts"), "level", "full")
    return x.select("level", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("turns", "order_lines", "parts")])


_LINES = "(SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) x WHERE trim(line) <> ''"
_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> ''))"
QUERIES = {
    "repeated_line_headers": (repeated_lines, f"SELECT trim(line) AS line, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM {_LINES} GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3"),
    "noise_lines": (noise_lines, f"SELECT doc_id, count(*) FILTER ((length(line) - length(replace(line, '.', '')) >= 6 AND (length(line) - length(replace(line, '.', ''))) * 2 >= length(line) AND NOT regexp_matches(trim(line), '^\\[?[A-Z]{{1,2}}[0-9]+[A-Z]?\\]?')) OR regexp_matches(trim(line), '^(page )?[0-9]{{1,4}}$')) AS noise, count(*) AS n FROM {_LINES} GROUP BY 1"),
    "heading_sections": (heading_sections, f"SELECT doc_id, line_no, trim(line) AS heading, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS \"end\" FROM {_LINES} AND length(line) <= 24"),
    "small_section_merge": (small_turn_merge, "SELECT conv_id, part, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM (SELECT *, sum(CASE WHEN turn = 0 OR length(text) >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM conversations) GROUP BY 1, 2"),
    "forward_fill_section": (forward_fill_question, "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations"),
    "neighbour_context": (neighbour_context, "SELECT conv_id, turn, lag(array_to_string(w[greatest(1, len(w) - 2):len(w)], ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM (SELECT *, string_split(trim(text), ' ') AS w FROM conversations)"),
    "change_kind_pivot": (label_pivot, "SELECT lang, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1) AS good, count(*) AS n, floor(count(*) FILTER (toxic = 1) * 100 / count(*) + 0.5)::BIGINT AS toxic_percent FROM labels JOIN documents USING (doc_id) GROUP BY 1"),
    "section_groups": (section_groups, "SELECT *, row_number() OVER (ORDER BY first_doc) AS position FROM (SELECT coalesce(nullif(trim(source), ''), 'Ungrouped') AS section, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1)"),
    "seq_gap_report": (sequence_gaps, "SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS missing, count(*) - count(DISTINCT turn) AS repeated FROM conversations GROUP BY 1"),
    "preferred_by_sequence": (preferred_by_length, "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1"),
    "content_dedup": (content_ids, "SELECT substr(md5(trim(coalesce(text, ''))), 1, 12) AS content_id, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1"),
    "numeric_tokens": (numeric_profile, r"SELECT doc_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS numbers FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[0-9]+[a-z]?')) AS t FROM documents)"),
    "levenshtein_ratio": (levenshtein_pairs, "WITH n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT a.name AS a, b.name AS b, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS r FROM n a JOIN n b ON a.name < b.name AND substr(a.name, 1, 1) = substr(b.name, 1, 1)) SELECT a, b, floor(r * 10000 + 0.5) / 10000 AS ratio FROM p WHERE r >= 0.7"),
    "trigram_jaccard_pairs": (trigram_neighbours, "WITH n AS (SELECT name, list_distinct(list_transform(generate_series(1, greatest(1, length(name) - 2)), lambda i: substr(name, i, 3))) AS s FROM (SELECT DISTINCT p_name AS name FROM part)), p AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS r FROM n a JOIN n b ON a.name < b.name) SELECT a, b, floor(r * 10000 + 0.5) / 10000 AS similarity FROM p WHERE r >= 0.6"),
    "token_jaccard_pairs": (similar_documents, f"""
        WITH w AS (SELECT doc_id, lang, list_sort({_WORDS}) AS s FROM documents), n AS (SELECT lang, s, min(doc_id) AS id, len(s) AS k FROM w WHERE len(s) > 0 GROUP BY lang, s),
        p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, a.k + b.k AS u FROM n a JOIN n b ON a.id < b.id AND a.lang IS NOT DISTINCT FROM b.lang AND a.k >= 0.8 * b.k AND b.k >= 0.8 * a.k)
        SELECT a, b, floor(i / (u - i) * 10000 + 0.5) / 10000 AS similarity FROM p WHERE i / (u - i) >= 0.8"""),
    "change_confidence": (change_confidence, "WITH n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT a.name AS a, b.name AS b, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS e FROM n a JOIN n b ON a.name < b.name AND substr(a.name, 1, 1) = substr(b.name, 1, 1)), r AS (SELECT a, b, floor(e * 10000 + 0.5) / 10000 AS r FROM p WHERE e >= 0.7) SELECT a, b, (CASE WHEN r >= 0.92 THEN 0.96 WHEN r >= 0.82 THEN 0.88 ELSE 0.74 END)::DOUBLE AS confidence, CASE WHEN r >= 0.92 THEN 'wording' WHEN r >= 0.82 THEN 'partial' ELSE 'rewrite' END AS reason FROM r"),
    "field_changes": (field_changes, """
        WITH e AS (SELECT user_id, event_id, event_type AS t, json_extract_string(props, '$.k') AS k, lag(event_type) OVER w AS t0, lag(json_extract_string(props, '$.k')) OVER w AS k0, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, event_id, 'event_type' AS field, t0 AS before, t AS after FROM e WHERE n > 1 AND t0 IS DISTINCT FROM t
        UNION ALL SELECT user_id, event_id, 'k', k0, k FROM e WHERE n > 1 AND k0 IS DISTINCT FROM k"""),
    "level_consolidation": (level_consolidation, """
        SELECT level, coalesce(turns, 0) AS turns, coalesce(order_lines, 0) AS order_lines, coalesce(parts, 0) AS parts FROM (SELECT turn AS level, count(*) AS turns FROM conversations GROUP BY 1)
        FULL JOIN (SELECT l_linenumber::BIGINT AS level, count(*) AS order_lines FROM lineitem GROUP BY 1) USING (level) FULL JOIN (SELECT p_size::BIGINT AS level, count(*) AS parts FROM part GROUP BY 1) USING (level)"""),
    "document_changes": (document_changes, None),
    "text_chunks": (text_chunks, None),
    "passage_containment": (passage_containment, "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)"),
    "interval_containment": (section_of_line, f"SELECT doc_id, section, count(*) AS n FROM (SELECT doc_id, coalesce(last_value(CASE WHEN length(line) <= 24 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), -1) AS section FROM {_LINES}) GROUP BY 1, 2"),
    "page_links": (page_links, r"""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS host, len(l) AS links, len(list_distinct(l)) AS distinct_links FROM (SELECT *, regexp_extract_all(html, '<a href="([^"#]+)', 1) AS l FROM pages)"""),
    "page_tree_depth": (host_graph, r"SELECT page_id, min(page_id) OVER (PARTITION BY family) AS root, CASE WHEN nth = 0 THEN 0 WHEN nth <= 10 THEN 1 WHEN nth <= 110 THEN 2 ELSE 3 END::BIGINT AS depth FROM (SELECT page_id, family, row_number() OVER (PARTITION BY family ORDER BY page_id) - 1 AS nth FROM (SELECT page_id, regexp_extract(url, '([a-z]+\.[a-z]+)(?:[/?#:]|$)', 1) AS family FROM pages))"),
    "text_statistics": (text_statistics, f"SELECT lang, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars, max(length(coalesce(text, ''))) AS longest, sum(len({_WORDS}))::BIGINT AS words FROM documents GROUP BY 1"),
}
