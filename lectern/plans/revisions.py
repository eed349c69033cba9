"""Two versions of documents, provisions and XML: alignment, suppression, structural comparison, merge, chunks and a bounded crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import text as T
from ..operators import alignment as A
from ..operators import differences as B
from ..operators import relational as R
from ..operators.suppression import AMENDMENT, MARK_WORD, MARKS, OUTLINE, split_blocks, suppressed
from ..sources import xml as X
from ..sources.tables import table
from .comparisons import LABELS_SQL, labels_of_parts
from .documents import near_documents


def versions(spark, d) -> DataFrame:
    """(doc_id, old, new): each document and an edited one: every fourth sentence is gone, `the` reads `this`, and a closing sentence is added."""
    s = C.sentences(C.normalised(F.coalesce("text", F.lit(""))))
    kept = F.filter(s, lambda x, i: i % 4 != 3)
    edited = F.transform(kept, lambda x: F.regexp_replace(x, r"\bthe\b", "this"))
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("old"), F.concat(F.array_join(edited, " "), F.lit(" Added by the editor at last.")).alias("new"))


def sentence_alignment(spark, d):
    """Aligned sentences of both versions by the assignment with the largest sum of character ratios, and those that only one has."""
    return A.align(versions(spark, d), "doc_id", "old", "new").select(F.col("id").alias("doc_id"), "a", "b", F.round("similarity", 6).alias("similarity"), A.kind().alias("kind"))


def document_comparison(spark, d):
    """Sentences and words changed between both versions of each document."""
    return A.compared(A.align(versions(spark, d), "doc_id", "old", "new")).withColumnRenamed("id", "doc_id")


def word_diff(spark, d):
    """Word differences of both versions of each document: how many words each has, their digest as rebuilt from the runs, the changed words, and whether the change is meaningful."""
    x = B.word_differences(R.spread(versions(spark, d)))
    side = lambda op: F.md5(F.array_join(F.flatten(F.transform(F.filter("runs", lambda r: r["op"].isin("equal", op)), lambda r: r["words"])), " "))
    sizes = [F.size(c).alias(c) for c in ("runs", "words_removed", "words_added", "words_modified")]
    return x.select("doc_id", "old_words", "new_words", "common", *sizes, side("delete").alias("old_md5"), side("insert").alias("new_md5"), "change_ratio", "meaningful")


def line_versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Old and new (pair, no, line, key): the lines of near copies among the documents. A pair is known by the hash of its two ids."""
    pairs = R.kept(near_documents(spark, d).select("a", "b", F.xxhash64("a", "b").alias("pair")))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line")).withColumn("no", F.col("no").cast("long"))
    side = lambda c: pairs.select("pair", F.col(c).alias("doc_id")).join(lines, "doc_id").select("pair", "no", "line", T.comparison_key(F.col("line")).alias("key"))
    return side("a"), side("b")


def block_diff(spark, d):
    """Runs of equal, deleted, inserted and replaced lines between near copies."""
    old, new = line_versions(spark, d)
    return B.block_runs(old, new, B.matched_blocks(old, new)).select("pair", "op", "a", "a2", "b", "b2")


def block_changes(spark, d):
    """Lines of near copies that are equal, modified, deleted or added, by pair."""
    x = B.block_changes(*line_versions(spark, d))
    return x.groupBy("pair").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("equal", "mod", "del", "add")], F.round(F.min(F.when(F.col("kind") == "mod", F.col("similarity"))), 6).alias("least_similarity"))


def ordered_matches(spark, d):
    """Sections (of 500 characters) of both versions of each document, matched in their order with the largest sum of word similarities."""
    parts = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(c) - 1, F.lit(0)) / 500).cast("int")), lambda i: T.words(F.substring(F.col(c), i * 500 + 1, F.lit(500))))
    lists = R.spread(versions(spark, d)).select(F.col("doc_id").alias("id"), parts("old").alias("old"), parts("new").alias("new"))
    return A.matched_in_order(lists, None, 0.03).select(F.col("id").alias("doc_id"), "a", "b", F.round("similarity", 6).alias("similarity"))


def edited_lines(spark, d) -> DataFrame:
    """(p_partkey, a, b): provision lines and an edit of each, by the part's price."""
    line, low = F.col("line"), F.lower("line")
    words = F.split(line, " ")
    edits = [
        line, F.replace(line, F.lit(" "), F.lit("  ")), F.concat(line, F.lit(".")), F.initcap(line), F.upper(line), F.concat(F.lit("[F12] "), line), F.concat(F.lit("(a) "), line), F.concat(line, F.lit(" as amended")),
        F.regexp_replace(line, "[0-9]+", "7"), F.concat(F.lit("F350 "), low), F.array_join(F.reverse(words), " "), F.regexp_replace(line, "a", "e"), F.concat(F.substring(line, 1, 3), F.lit(" "), F.substring(line, 4, 500)), F.substring(line, 1, 20),
    ]
    x = labels_of_parts(spark, d).join(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    nth = (F.floor("p_retailprice") % len(edits)).cast("int")
    return x.select("p_partkey", line.alias("a"), F.element_at(F.array(*edits), nth + 1).alias("b"))


EDITED_SQL = f"""(SELECT p_partkey, line AS a, [line, replace(line, ' ', '  '), line || '.', array_to_string(list_transform(string_split(line, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' '), upper(line), '[F12] ' || line, '(a) ' || line, line || ' as amended',
  regexp_replace(line, '[0-9]+', '7', 'g'), 'F350 ' || lower(line), array_to_string(list_reverse(string_split(line, ' ')), ' '), replace(line, 'a', 'e'), left(line, 3) || ' ' || substr(line, 4), left(line, 20)]
  [floor(p_retailprice)::INT % 14 + 1] AS b FROM {LABELS_SQL} JOIN part USING (p_partkey))"""


def suppression_flags(spark, d):
    """Each edit with the first rule that suppresses it; null where the change is shown."""
    return suppressed(edited_lines(spark, d).repartition(R.dealt_over(spark), "p_partkey"), "a", "b").select("p_partkey", "reason")


def cut_lines(spark, d) -> DataFrame:
    """(p_partkey, no, kind, old, new): provision lines that one version has cut in two, the second half reworded at times."""
    x = edited_lines(spark, d).select("p_partkey", F.concat_ws(" ", "a", "b").alias("line"))
    n = F.length("line") - F.length(F.substring_index("line", " ", -2))
    first, rest = F.trim(F.expr("substring(line, 1, length(line) - length(substring_index(line, ' ', -2)))")), F.substring_index("line", " ", -2)
    rest = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("another "), rest)).otherwise(rest)
    change = lambda no, kind, old, new: F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), old.alias("old"), new.alias("new"))
    none = F.lit(None).cast("string")
    added = F.array(change(1, "mod", F.col("line"), first), change(2, "add", none, rest))
    removed = F.array(change(1, "del", first, none), change(2, "mod", rest, F.col("line")))
    return x.where(n > 0).select("p_partkey", F.explode(F.when(F.col("p_partkey") % 2 == 0, added).otherwise(removed)).alias("c")).select("p_partkey", "c.*")


def split_lines(spark, d):
    """Changes of cut lines, and whether both halves together say what the whole line says."""
    return split_blocks(cut_lines(spark, d), ["p_partkey"], "no").select("p_partkey", "no", "kind", "split")


def number_modifications(spark, d):
    """Provision lines of each brand's parts as deletions, those of the next size, some of them reworded, as additions: pairs that are likely one modification, by how they rank."""
    x = labels_of_parts(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey")
    no = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    old = F.concat_ws(" ", "p_type", F.lit("No."), F.col("p_size").cast("string"), "line")
    new = F.concat_ws(" ", "p_type", F.when(F.col("p_size") > 40, "of the schedule"), F.lit("No."), F.when(F.col("p_size") % 4 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1).cast("string"), "line")
    both = F.array(F.struct(F.lit("del").alias("kind"), old.alias("line")), F.struct(F.lit("add").alias("kind"), new.alias("line")))
    changes = R.kept(x.withColumn("no", no).select("p_brand", "no", F.explode(both).alias("x")).select("p_brand", "no", "x.*"))
    found = A.likely_changes(changes, ["p_brand"], "no")
    return found.select("p_brand", "a", "b", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def changed_lines(spark, d) -> DataFrame:
    """(pair, no, kind, line): the lines of near copies that only one of them has, as deletions and additions."""
    old, new = line_versions(spark, d)
    runs = B.block_runs(old, new, B.matched_blocks(old, new)).where("op <> 'equal'")
    side = lambda x, kind, lo, hi: runs.select("pair", F.explode(F.when(F.col(hi) > F.col(lo), F.sequence(lo, F.col(hi) - 1))).alias("no")).join(x, ["pair", "no"]).select("pair", "no", F.lit(kind).alias("kind"), "line")
    return R.kept(side(old, "del", "a", "a2").union(side(new, "add", "b", "b2")))


def modified_pairs(spark, d):
    """Lines that only one of two near copies has: pairs of a deletion and an addition that become one modification, and the rest, by kind."""
    return A.modified_lines(changed_lines(spark, d), ["pair"], "no").groupBy("pair", "kind").agg(F.count("*").alias("n"))


def unmatched_lines(spark, d):
    """Lines that only one of two near copies has and that have no likely counterpart in the other one."""
    return A.unmatched(changed_lines(spark, d), ["pair"], "no").select("pair", "no", "kind", F.md5("line").alias("line"))


#: The order of an order's lines; line numbers repeat.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def order_xml(spark, d, version: str, *more: str) -> DataFrame:
    """(o_orderkey, more, xml): an order with its lines; more: columns of orders. The new version leaves out lines with more than 45 pieces, doubles quantities under 5, and marks urgent orders."""
    li = table(spark, d, "lineitem")
    quantity = F.col("l_quantity").cast("int")
    if version == "new":
        li, quantity = li.where("l_quantity <= 45"), F.when(quantity < 5, quantity * 2).otherwise(quantity)
    line = F.concat(F.lit('<line part="'), F.col("l_partkey").cast("string"), F.lit('"><quantity>'), quantity.cast("string"), F.lit("</quantity><flag>"), "l_returnflag", F.lit("</flag></line>"))
    # Few bytes of lines make documents that take long, so they are dealt by number, and before they are written out.
    lines = li.repartition(R.dealt_over(spark), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, line.alias("line")))).alias("lines"))
    o = table(spark, d, "orders").repartition(R.dealt_over(spark), "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(' urgent="yes"')).otherwise("") if version == "new" else F.lit("")
    body = F.array_join(F.transform(F.coalesce("lines", F.array()), lambda x: x["line"]), "")
    return o.select("o_orderkey", *more, F.concat(F.lit('<?xml version="1.0"?><!-- order '), F.col("o_orderkey").cast("string"), F.lit(" --><order"), urgent, F.lit("><status>"), "o_orderstatus", F.lit("</status>"), body, F.lit("</order>")).alias("xml"))


def xml_changes(spark, d) -> DataFrame:
    return X.changes(*[X.elements(order_xml(spark, d, v), "o_orderkey", "xml") for v in ("old", "new")])


def xml_compare(spark, d):
    """Additions, removals, modifications and unchanged elements between both versions of each order's document, by path."""
    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("addition", "additions"), ("removal", "removals"), ("modification", "modifications"), ("same", "same"))]
    return xml_changes(spark, d).groupBy(F.col("id").alias("o_orderkey")).agg(*kinds)


def xml_merge(spark, d):
    """The merged document of each order: additions and modifications are taken, removals of lines with more than 48 pieces accepted, modifications of quantities below 3 refused."""
    old, new = (X.elements(order_xml(spark, d, v), "o_orderkey", "xml") for v in ("old", "new"))
    number = F.col("text").cast("int")
    decisions = old.where("tag = 'quantity'").select("id", F.when(number > 48, F.col("parent")).when(number < 3, F.col("path")).alias("path"), (number > 48).alias("accept")).where("path is not null")
    return X.assembled(X.merged(old, new, decisions)).select(F.col("id").alias("o_orderkey"), F.md5("xml").alias("xml"), F.length("xml").alias("chars"))


def xml_elements(spark, d):
    """Elements of the old documents by tag: how many, how many with an attribute `part`, the deepest, and the largest index among siblings."""
    x = X.elements(order_xml(spark, d, "old"), "o_orderkey", "xml")
    return x.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.map_contains_key("attributes", "part")).alias("with_part"), F.max("depth").alias("depth"), F.max(F.regexp_extract("path", r"\[([0-9]+)\]$", 1).cast("int")).alias("last_index"))


def xml_chunks(spark, d):
    """Each line of an order's document as a document of its own, within the tags of its ancestors; chunks of more than 90 bytes are flagged."""
    x = X.document_chunks(order_xml(spark, d, "new"), "o_orderkey", "xml", "line", "part", most_bytes=90)
    return x.select(F.col("id").alias("o_orderkey"), "no", "of", "path", "xml", "size", "oversized")


def xml_rejoined(spark, d):
    """The documents that the chunks of each order's old document give when they are put together."""
    x = X.document_chunks(order_xml(spark, d, "old"), "o_orderkey", "xml", "line")
    return X.rejoined(x).select(F.col("id").alias("o_orderkey"), F.md5("xml").alias("xml"))


def xml_annotated(spark, d):
    """The old documents with the kind of each element's change to the new version."""
    old, new = (X.elements(order_xml(spark, d, v), "o_orderkey", "xml") for v in ("old", "new"))
    return X.annotated(old, X.changes(old, new)).select(F.col("id").alias("o_orderkey"), F.md5("xml").alias("xml"))


def xml_edits(spark, d):
    """The old documents in which the order's state is replaced by `shipped` where it is F, and open ones get a note."""
    old = X.elements(order_xml(spark, d, "old"), "o_orderkey", "xml")
    edits = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "replace").otherwise("insert").alias("kind"), F.col("o_orderstatus").alias("old"), F.when(F.col("o_orderstatus") == "F", "shipped").otherwise("(open)").alias("new"))
    return X.assembled(X.applied(old, edits)).select(F.col("id").alias("o_orderkey"), F.md5("xml").alias("xml"))


def link_crawl(spark, d, depth: int = 5, children: int = 10):
    """Suppliers reached from the first one, each with its least depth: a link leads to the supplier of the next line of an order; at most ten links of a page, the first ones, are followed, to depth 5."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.lead("l_suppkey").over(w).alias("to")).where("`to` is not null and page <> `to`").distinct()
    links = links.withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("to"))).where(F.col("nth") <= children).select("page", "to")
    front = table(spark, d, "supplier").agg(F.min("s_suppkey").alias("page")).select("page", F.lit(0).alias("depth"))
    seen = front
    for level in range(1, depth + 1):
        front = front.join(links, "page").select(F.col("to").alias("page")).distinct().join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.union(front)
    return seen


_ORDER = ", ".join(LINE_ORDER)
_KEY = lambda x: rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_NOISE = lambda x: rf"((length({x}) - length(replace({x}, '.', '')) >= 6 AND (length({x}) - length(replace({x}, '.', ''))) * 2 >= length({x}) AND NOT regexp_matches(trim({x}), '^\[?[A-Z]{{1,2}}[0-9]+[A-Z]?\]?')) OR regexp_matches(trim({x}), '^(page )?[0-9]{{1,4}}$'))"
#: Columns of a line x of the oracle of the suppression rules, each over those before it.
_LINE = [
    ("bare", lambda x: rf"regexp_replace({x}, '\s+', '', 'g')"), ("plain", lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"), ("letters", lambda x: f"regexp_replace({x}, '[^A-Za-z]', '', 'g')"),
    ("k", lambda x: rf"lower(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '\b([CFIPXME]) ?([0-9]+) ?([A-Z]?)\b', '\1\2\3', 'g'))"),
    ("content", lambda x: rf"lower(regexp_replace(trim(regexp_replace(regexp_replace({x}, '\[[A-Z]{{1,2}}[0-9]+[A-Z]?\]', ' ', 'g'), '\s+', ' ', 'g')), '\b([CFIPXME]) ?([0-9]+) ?([A-Z]?)\b', '\1\2\3', 'g'))"),
    ("bottom", lambda x: rf"trim(regexp_replace(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), '^(?: *{C.MARKER} *){{1,4}}', ''))"), ("sign", lambda x: f"regexp_replace(lower({x}), '[^a-z]+', '', 'g')"),
]
_FROM_KEY = [
    ("label", lambda k: rf"regexp_replace({k}, '{AMENDMENT}', '')"), ("tight", lambda k: rf"regexp_replace(regexp_replace({k}, '[ \t]+([,)\]])', '\1', 'g'), '([\[(])[ \t]+', '\1', 'g')"), ("outline", lambda k: f"regexp_extract({k}, '{OUTLINE}')"),
    ("marks", lambda k: rf"trim(regexp_replace({k}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"), ("w", lambda k: f"string_split({k}, ' ')"), ("bag", lambda k: f"list_sort(string_split({k}, ' '))"), ("nums", lambda k: rf"list_sort(list_distinct(regexp_extract_all({k}, '\d+[a-z]?')))"),
    ("cw", lambda k: "list_filter(list_distinct(string_split(" + _KEY(k) + ", ' ')), lambda w: len(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], w))"),
]
_RATIO = lambda a, b: f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"
_OVERLAP = "(CASE WHEN len(list_distinct(list_concat(a_cw, b_cw))) = 0 THEN 1.0 ELSE len(list_intersect(a_cw, b_cw))::DOUBLE / len(list_distinct(list_concat(a_cw, b_cw))) END)"
_WORD = lambda w: f"(length(regexp_replace({w}, '[^a-z0-9]', '', 'g')) >= 4 AND regexp_matches({w}, '[a-z]'))"
_MARK = lambda w: f"regexp_matches(regexp_replace({w}, '^[^a-z0-9()]+|[^a-z0-9()]+$', '', 'g'), '{MARK_WORD}')"
_CASE = "lower(a_bare) = lower(b_bare) AND len(string_split(a_plain, ' ')) = len(string_split(b_plain, ' '))"
_HITS = lambda k: "least(1.0, (" + " + ".join(f"len(regexp_extract_all({k}, '{p}'))" for p in MARKS) + ") / 6.0)"
_BRACKETS = lambda k: rf"len(regexp_extract_all({k}, '[\[(]'))"
_NUMBERS = lambda x: rf"list_distinct(regexp_extract_all(lower({x}), '\d+[a-z]?'))"
_SUBSET = lambda x, y: f"len(list_intersect({x}, {y})) = least(len({x}), len({y}))"
_SORTED = lambda x: f"array_to_string(list_sort(string_split({_KEY(x)}, ' ')), ' ')"
_NEARLY = f"greatest({_RATIO('a_bottom', 'b_bottom')}, CASE WHEN ({_SORTED('a_bottom')} = '') <> ({_SORTED('b_bottom')} = '') THEN 0.0 ELSE {_RATIO(_SORTED('a_bottom'), _SORTED('b_bottom'))} END)"
_WEAKER = lambda x, y: f"({_HITS(y + '_k')} - {_HITS(x + '_k')} >= 0.18 OR {_BRACKETS(x + '_k')} < {_BRACKETS(y + '_k')})"


def _ladder(source: str, rest: str) -> str:
    """The suppression rules over pairs (a, b) of `source`; rest: what is selected from them, `reason` among the columns."""
    return f"""WITH e AS (SELECT *, {", ".join(f"{f(x)} AS {x}_{n}" for n, f in _LINE for x in "ab")} FROM {source}),
  k AS (SELECT *, {", ".join(f"{f(x + '_k')} AS {x}_{n}" for n, f in _FROM_KEY for x in "ab")} FROM e),
  s AS (SELECT *, greatest({_RATIO("a_k", "b_k")}, {_RATIO("array_to_string(a_bag, ' ')", "array_to_string(b_bag, ' ')")}) AS sim, {_OVERLAP} AS over, CASE WHEN length(a_k) <= length(b_k) THEN a_k ELSE b_k END AS s_k, CASE WHEN length(a_k) <= length(b_k) THEN b_k ELSE a_k END AS l_k,
    CASE WHEN length(a_k) <= length(b_k) THEN a_nums ELSE b_nums END AS s_nums, CASE WHEN length(a_k) <= length(b_k) THEN b_nums ELSE a_nums END AS l_nums,
    CASE WHEN len(a_w) = len(b_w) THEN list_filter(range(1, len(a_w) + 1), lambda i: a_w[i] <> b_w[i]) END AS differ FROM k),
  r AS (SELECT *, nullif(CASE WHEN {_NOISE("a")} AND {_NOISE("b")} THEN 'noise' WHEN a = b THEN 'same' WHEN a_bare = b_bare THEN 'space'
    WHEN {_CASE} AND NOT (a_letters = upper(a_letters) OR b_letters = upper(b_letters)) THEN 'shown' WHEN {_CASE} THEN 'capitals' WHEN lower(a_bare) = lower(b_bare) THEN 'space' WHEN a_k = b_k THEN 'format'
    WHEN len(a_w) >= 4 AND len(differ) BETWEEN 1 AND 2 AND len(list_filter(differ, lambda i: ({_WORD("a_w[i]")} AND {_WORD("b_w[i]")} AND regexp_replace(a_w[i], '[^a-z0-9]', '', 'g') <> regexp_replace(b_w[i], '[^a-z0-9]', '', 'g')) OR ({_MARK("a_w[i]")} AND {_MARK("b_w[i]")}))) > 0 THEN 'shown'
    WHEN a_label <> '' AND a_label = b_label THEN 'label' WHEN a_content <> '' AND a_content = b_content THEN 'marker' WHEN a_bottom <> '' AND a_bottom = b_bottom THEN 'anchor' WHEN a_tight = b_tight THEN 'citation'
    WHEN (a_outline = '') <> (b_outline = '') AND a_bottom <> '' AND b_bottom <> '' AND {_NEARLY} >= 0.95 AND {_SUBSET(_NUMBERS("a_bottom"), _NUMBERS("b_bottom"))} AND ({_WEAKER("a", "b")} OR {_WEAKER("b", "a")}) THEN 'weaker'
    WHEN a_outline <> b_outline THEN 'shown' WHEN a_marks = b_marks THEN 'punctuation' WHEN a_bag = b_bag THEN 'reflow'
    WHEN length(s_k) >= 6 AND contains(l_k, s_k) AND len(list_filter(s_nums, lambda n: NOT list_contains(l_nums, n))) = 0 AND sim >= 0.70 THEN 'cut'
    WHEN a_nums = b_nums AND ((sim >= 0.92 AND over >= 0.95) OR (sim >= 0.82 AND over >= 0.92)) THEN 'near'
    WHEN a_sign <> '' AND a_sign = b_sign AND len(list_intersect(a_nums, b_nums)) = least(len(a_nums), len(b_nums)) THEN 'signature' END, 'shown') AS reason FROM s)
  {rest}"""


_SUPPRESSION = _ladder(EDITED_SQL, "SELECT p_partkey, reason FROM r")
_PLAINLY = lambda x: rf"trim(regexp_replace({x}_bottom, '[^\p{{L}}\p{{N}}_ ]+', ' ', 'g'))"
_BAGS = lambda x: f"list_sort(list_filter(regexp_split_to_array({_PLAINLY(x)}, ' +'), lambda w: w <> ''))"
_CUT = f"""(SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN line ELSE head || ' ' || rest END AS a, CASE WHEN p_partkey % 2 = 0 THEN head || ' ' || rest ELSE line END AS b FROM (
  SELECT p_partkey, line, trim(left(line, length(line) - length(tail))) AS head, CASE WHEN p_partkey % 3 = 0 THEN 'another ' ELSE '' END || tail AS rest FROM (
    SELECT p_partkey, a || ' ' || b AS line, array_to_string(list_slice(string_split(a || ' ' || b, ' '), -2, -1), ' ') AS tail FROM {EDITED_SQL}) WHERE length(line) > length(tail)))"""
_SPLIT = _ladder(_CUT, f"""SELECT p_partkey, no::INTEGER AS no, CASE WHEN p_partkey % 2 = 0 THEN CASE no WHEN 1 THEN 'mod' ELSE 'add' END ELSE CASE no WHEN 1 THEN 'del' ELSE 'mod' END END AS kind,
  reason IS NOT NULL OR (a_bottom <> '' AND a_bottom = b_bottom) OR (a_sign <> '' AND a_sign = b_sign) OR {_BAGS("a")} = {_BAGS("b")}
    OR (greatest(len({_BAGS("a")}), len({_BAGS("b")})) >= 10 AND abs(len({_BAGS("a")}) - len({_BAGS("b")})) <= 1 AND len(list_filter({_BAGS("a")}, lambda w: list_contains({_BAGS("b")}, w))) / greatest(len({_BAGS("a")}), len({_BAGS("b")})) >= 0.97
      AND {_SUBSET(_NUMBERS(_PLAINLY("a")), _NUMBERS(_PLAINLY("b")))})
    OR (a_bottom <> '' AND b_bottom <> '' AND {_NEARLY} >= 0.92 AND {_SUBSET(_NUMBERS("a_bottom"), _NUMBERS("b_bottom"))}) AS split FROM r, (SELECT unnest([1, 2]) AS no)""")

_OLD = f"(SELECT l_orderkey, l_partkey, l_returnflag, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem)"
_NEW = f"(SELECT l_orderkey, l_partkey, l_returnflag, CASE WHEN l_quantity < 5 THEN l_quantity::INT * 2 ELSE l_quantity::INT END AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem WHERE l_quantity <= 45)"
_BOTH = f"(SELECT coalesce(a.l_orderkey, b.l_orderkey) AS k, coalesce(a.rn, b.rn) AS rn, a.l_partkey AS pa, b.l_partkey AS pb, a.q AS qa, b.q AS qb, a.l_returnflag AS fa, b.l_returnflag AS fb FROM {_OLD} a FULL JOIN {_NEW} b ON a.l_orderkey = b.l_orderkey AND a.rn = b.rn)"

QUERIES = {
    "sentence_alignment": (sentence_alignment, None),
    "document_comparison": (document_comparison, None),
    "word_diff": (word_diff, None),
    "block_diff": (block_diff, None),
    "block_changes": (block_changes, None),
    "ordered_matches": (ordered_matches, None),
    "suppression_flags": (suppression_flags, _SUPPRESSION),
    "split_lines": (split_lines, _SPLIT),
    "number_modifications": (number_modifications, None),
    "modified_pairs": (modified_pairs, None),
    "unmatched_lines": (unmatched_lines, None),
    "xml_compare": (xml_compare, f"""WITH l AS (SELECT k, sum(CASE WHEN pa IS NULL THEN 3 ELSE 0 END) AS additions, sum(CASE WHEN pb IS NULL THEN 3 ELSE 0 END) AS removals,
          sum(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN (qa <> qb)::INT + (fa <> fb)::INT + (qa <> qb OR fa <> fb OR pa <> pb)::INT ELSE 0 END) AS modifications, sum(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 3 ELSE 0 END) AS paired FROM {_BOTH} GROUP BY 1)
        SELECT o_orderkey, coalesce(additions, 0)::BIGINT AS additions, coalesce(removals, 0)::BIGINT AS removals, coalesce(modifications, 0)::BIGINT AS modifications, (1 + coalesce(paired - modifications, 0))::BIGINT AS same FROM orders LEFT JOIN l ON k = o_orderkey"""),
    "xml_merge": (xml_merge, f"""WITH m AS (SELECT k, rn, CASE WHEN pa IS NULL OR pb IS NULL THEN coalesce(pa, pb) ELSE pb END AS p, CASE WHEN pb IS NULL OR qa < 3 THEN qa ELSE qb END AS q, CASE WHEN pb IS NULL THEN fa ELSE fb END AS f FROM {_BOTH} WHERE NOT (pb IS NULL AND qa > 48)),
        l AS (SELECT k, string_agg('<line part="' || p || '"><quantity>' || q || '</quantity><flag>' || f || '</flag></line>', '' ORDER BY rn) AS body FROM m GROUP BY 1),
        x AS (SELECT o_orderkey, '<order><status>' || o_orderstatus || '</status>' || coalesce(body, '') || '</order>' AS xml FROM orders LEFT JOIN l ON k = o_orderkey)
        SELECT o_orderkey, md5(xml) AS xml, length(xml)::INTEGER AS chars FROM x"""),
    "xml_rejoined": (xml_rejoined, f"""SELECT o_orderkey, md5('<order>' || string_agg('<line part="' || l_partkey || '"><quantity>' || q || '</quantity><flag>' || l_returnflag || '</flag></line>', '' ORDER BY rn) || '</order>') AS xml FROM orders JOIN {_OLD} ON l_orderkey = o_orderkey GROUP BY 1"""),
    "xml_annotated": (xml_annotated, f"""WITH l AS (SELECT k, string_agg('<line part="' || pa || '"' || CASE WHEN pb IS NULL THEN ' change="removal"' WHEN qa <> qb OR fa <> fb OR pa <> pb THEN ' change="modification"' ELSE '' END
          || '><quantity' || CASE WHEN pb IS NULL THEN ' change="removal"' WHEN qa <> qb THEN ' change="modification"' ELSE '' END || '>' || qa || '</quantity><flag' || CASE WHEN pb IS NULL THEN ' change="removal"' WHEN fa <> fb THEN ' change="modification"' ELSE '' END || '>' || fa || '</flag></line>', '' ORDER BY rn) AS body FROM {_BOTH} GROUP BY 1)
        SELECT o_orderkey, md5('<order><status>' || o_orderstatus || '</status>' || coalesce(body, '') || '</order>') AS xml FROM orders LEFT JOIN l ON k = o_orderkey"""),
    "xml_edits": (xml_edits, f"""WITH l AS (SELECT l_orderkey AS k, string_agg('<line part="' || l_partkey || '"><quantity>' || q || '</quantity><flag>' || l_returnflag || '</flag></line>', '' ORDER BY rn) AS body FROM {_OLD} GROUP BY 1)
        SELECT o_orderkey, md5('<order><status>' || CASE WHEN o_orderstatus = 'F' THEN 'shipped' ELSE o_orderstatus || ' (open)' END || '</status>' || coalesce(body, '') || '</order>') AS xml FROM orders LEFT JOIN l ON k = o_orderkey"""),
    "xml_elements": (xml_elements, f"""WITH o AS (SELECT count(*) AS n FROM orders), l AS (SELECT count(*) AS n, max(rn) - 1 AS i FROM {_OLD} JOIN orders ON o_orderkey = l_orderkey)
        SELECT 'order' AS tag, n, 0 AS with_part, 0 AS depth, 0::BIGINT AS last_index FROM o UNION ALL SELECT 'status', n, 0, 1, 0 FROM o UNION ALL SELECT 'line', n, n, 1, i FROM l UNION ALL SELECT 'quantity', n, 0, 2, 0 FROM l UNION ALL SELECT 'flag', n, 0, 2, 0 FROM l"""),
    "xml_chunks": (xml_chunks, f"""WITH x AS (SELECT o_orderkey, rn::INTEGER AS no, count(*) OVER (PARTITION BY o_orderkey) AS of, '/order[0]/line[' || (rn - 1) || ']' AS path,
          '<order' || CASE WHEN o_orderpriority = '1-URGENT' THEN ' urgent="yes"' ELSE '' END || '><line part="' || l_partkey || '"><quantity>' || q || '</quantity><flag>' || l_returnflag || '</flag></line></order>' AS xml FROM {_NEW} JOIN orders ON o_orderkey = l_orderkey)
        SELECT *, strlen(xml)::INTEGER AS size, strlen(xml) > 90 AS oversized FROM x"""),
    "link_crawl": (link_crawl, f"""WITH RECURSIVE l AS (SELECT DISTINCT page, "to" FROM (SELECT l_suppkey AS page, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS "to" FROM lineitem) WHERE "to" IS NOT NULL AND page <> "to"),
        k AS (SELECT page, "to" FROM l QUALIFY row_number() OVER (PARTITION BY page ORDER BY "to") <= 10),
        c AS (SELECT min(s_suppkey) AS page, 0 AS depth FROM supplier UNION SELECT k."to", c.depth + 1 FROM c JOIN k USING (page) WHERE c.depth < 5)
        SELECT page, min(depth) AS depth FROM c GROUP BY 1"""),
}
