"""Intake checks and reports: bound scans, damaged events, page reports, quality summaries, heading joins and line classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import xml as X
from ..sources.tables import table
from .comparisons import PAIRS_SQL, pairs
from .facets import LINES_SQL, lines
from .revisions import order_xml


def bound_scan(spark, d):
    """Users of a team with a balance in bounds that are given as parameters, never as text of the query."""
    view = table(spark, d, "customer")
    return spark.sql("SELECT c_custkey, c_name FROM {users} WHERE c_nationkey = :team AND c_acctbal BETWEEN :low AND :high", args={"team": 3, "low": 0.0, "high": 5000.0}, users=view)


def damaged_events(spark, d):
    """Events whose properties, cut after five characters where their value is over 50, can't be read any more count as empty."""
    props = F.when(F.col("value") > 50, F.substring("props", 1, 5)).otherwise(F.col("props"))
    read = F.from_json(props, "k long", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").groupBy("event_type").agg(F.count(read["k"]).alias("readable"), F.count_if(read["k"].isNull()).alias("empty"), F.coalesce(F.sum(read["k"]), F.lit(0)).alias("total"))


def host_report(spark, d):
    """One report for each host: its pages by depth of the path and address, as a digest of the list."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    x = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_count(path, F.lit("/")).alias("depth"), "url")
    item = F.transform(F.array_sort(F.collect_list(F.struct("depth", "url"))), lambda i: F.concat(F.lit("<li>"), i["url"], F.lit("</li>")))
    return x.groupBy("host").agg(F.count("*").alias("pages"), F.md5(F.concat(F.lit("<ul>"), F.array_join(item, ""), F.lit("</ul>"))).alias("report"))


def quality_summary(spark, d):
    """For each source: documents, those without a text, short and long ones, and the warnings that follow."""
    n = F.length(F.coalesce("text", F.lit("")))
    x = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < 200)).alias("short"), F.count_if(n > 10_000).alias("long"))
    warnings = F.array_compact(F.array(F.when(F.col("empty") > 0, "NO_TEXT"), F.when(F.col("short") * 20 > F.col("docs"), "MANY_SHORT"), F.when(F.col("long") * 20 > F.col("docs"), "MANY_LONG")))
    return x.withColumn("warnings", F.array_join(warnings, ","))


def missing_numbers(spark, d):
    """Line numbers that are missing between 1 and the largest of each order, and how many occur again. The numbers between two neighbours are made from the gap; an order that misses none makes none."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("no"))
    seen = x.groupBy("l_orderkey", "no").agg(F.count("*").alias("n"))
    before = F.coalesce(F.lag("no").over(Window.partitionBy("l_orderkey").orderBy("no")), F.lit(0))
    gap = F.when(F.col("no") - before > 1, F.array_join(F.transform(F.sequence(before + 1, F.col("no") - 1), lambda i: i.cast("string")), ","))
    gaps = seen.withColumn("gap", gap).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("no", "gap")))), lambda g: g["gap"]), ",").alias("missing"), (F.sum("n") - F.count("*")).alias("repeated"))
    return gaps


def heading_join(spark, d):
    """Sentences that a turn and the one before share, by their key: the first place of each on either side."""
    def keyed(c, no):
        s = pairs(spark, d).select("conv_id", "turn", F.posexplode(F.split(c, r"[.!?]")).alias("no", "s")).withColumn("key", T.comparison_key(F.col("s"))).where("key <> ''")
        return s.groupBy("conv_id", "turn", "key").agg(F.min("no").alias(no))

    return keyed("a", "old_no").join(keyed("b", "new_no"), ["conv_id", "turn", "key"]).select("conv_id", "turn", F.md5("key").alias("key"), "old_no", "new_no")


#: A line of a table of contents, ends of sentences, and words that leave a line open.
TOC, ENDS, OPEN = r"(\.{3,}|\s{3,}|\t)\s*[0-9ivxlc]+\s*$", r"[.!?:;]['\"”)]*\s*$", r"(?i)(,|\b(and|or|of|the|to|in|a))\s*$"


def line_ends(spark, d):
    """Lines of a table of contents, lines that end a sentence, and lines left open, by document."""
    found = [F.count_if(F.rlike("line", F.lit(p))).alias(n) for n, p in (("contents", TOC), ("ended", ENDS), ("open", OPEN))]
    return lines(spark, d).groupBy("doc_id").agg(*found)


def xml_validity(spark, d):
    """Orders' documents that are well formed, where those of cancelled size (over 400,000) lack their last ten characters."""
    x = order_xml(spark, d, "old", "o_totalprice")
    x = x.withColumn("xml", F.when(F.col("o_totalprice") > 400000, F.expr("substring(xml, 1, length(xml) - 10)")).otherwise(F.col("xml")))
    return X.element_counts(x, "o_orderkey", "xml").select(F.col("id").alias("o_orderkey"), F.col("elements").isNotNull().alias("valid"), F.coalesce("elements", F.lit(0)).alias("elements"))


def top_units(spark, d):
    """Units of a document that lie in no unit of the same tag: of nested divisions, the outer ones. A document is made of the teams of each region."""
    n = table(spark, d, "nation")
    body = F.concat(F.lit("<div n='"), F.col("n_nationkey").cast("string"), F.lit("'><div n='inner'>"), "n_name", F.lit("</div></div>"))
    docs = n.groupBy("n_regionkey").agg(F.concat(F.lit("<r>"), F.array_join(F.sort_array(F.collect_list(body)), ""), F.lit("</r>")).alias("xml"))
    e = X.elements(docs, "n_regionkey", "xml").where("tag = 'div'")
    above = e.select("id", F.col("path").alias("above"))
    inner = e.join(above, (e["id"] == above["id"]) & F.col("path").startswith(F.concat("above", F.lit("/"))), "left_semi").select("id", "path")
    return e.join(inner, ["id", "path"], "left_anti").groupBy(F.col("id").alias("n_regionkey")).agg(F.count("*").alias("units"))


def level_fill(spark, d):
    """Levels 1 to 60 with the number of parts that have each; levels that no part has are filled in with the count of none and marked."""
    have = table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("level")).agg(F.count("*").alias("n"))
    every = spark.range(1, 61).withColumnRenamed("id", "level")
    return every.join(have, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("filled")).union(have.join(every, "level", "left_anti").select("level", "n", F.lit(False)))


_KEY = r"trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g'))"

QUERIES = {
    "bound_scan": (bound_scan, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal BETWEEN 0 AND 5000"),
    "damaged_events": (damaged_events, """SELECT event_type, count(k) AS readable, count(*) - count(k) AS empty, coalesce(sum(k), 0)::BIGINT AS total
        FROM (SELECT event_type, CASE WHEN value > 50 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events) GROUP BY 1"""),
    "host_report": (host_report, r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(regexp_extract_all(regexp_replace(url, '[?#].*$', ''), '/')) AS depth, url FROM pages)
        SELECT host, count(*) AS pages, md5('<ul>' || string_agg('<li>' || url || '</li>', '' ORDER BY depth, url) || '</ul>') AS report FROM p GROUP BY 1"""),
    "quality_summary": (quality_summary, """WITH s AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty, count(*) FILTER (WHERE length(text) BETWEEN 1 AND 199) AS short, count(*) FILTER (WHERE length(text) > 10000) AS long FROM documents GROUP BY 1)
        SELECT *, array_to_string(list_filter([CASE WHEN empty > 0 THEN 'NO_TEXT' END, CASE WHEN short * 20 > docs THEN 'MANY_SHORT' END, CASE WHEN long * 20 > docs THEN 'MANY_LONG' END], lambda x: x IS NOT NULL), ',') AS warnings FROM s"""),
    "missing_numbers": (missing_numbers, """SELECT l_orderkey, array_to_string(list_filter(range(1, max(l_linenumber) + 1), lambda i: NOT list_contains(list(DISTINCT l_linenumber::BIGINT), i)), ',') AS missing,
        count(*) - count(DISTINCT l_linenumber) AS repeated FROM lineitem GROUP BY 1"""),
    "heading_join": (heading_join, f"""WITH p AS {PAIRS_SQL}, x AS (SELECT conv_id, turn, unnest(range(len(regexp_split_to_array(a, '[.!?]')))) AS no, unnest(regexp_split_to_array(a, '[.!?]')) AS s FROM p),
        y AS (SELECT conv_id, turn, unnest(range(len(regexp_split_to_array(b, '[.!?]')))) AS no, unnest(regexp_split_to_array(b, '[.!?]')) AS s FROM p),
        kx AS (SELECT conv_id, turn, {_KEY} AS key, min(no) AS old_no FROM x GROUP BY 1, 2, 3), ky AS (SELECT conv_id, turn, {_KEY} AS key, min(no) AS new_no FROM y GROUP BY 1, 2, 3)
        SELECT conv_id, turn, md5(key) AS key, old_no, new_no FROM kx JOIN ky USING (conv_id, turn, key) WHERE key <> ''"""),
    "line_ends": (line_ends, "SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}')) AS \"{n}\"" for n, p in (("contents", TOC), ("ended", ENDS), ("open", OPEN))) + f" FROM ({LINES_SQL}) GROUP BY 1"),
    "xml_validity": (xml_validity, """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT o_orderkey, o_totalprice <= 400000 AS valid, CASE WHEN o_totalprice <= 400000 THEN 2 + 3 * coalesce(n, 0) ELSE 0 END::BIGINT AS elements FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""),
    "top_units": (top_units, "SELECT n_regionkey, count(*) AS units FROM nation GROUP BY 1"),
    "level_fill": (level_fill, """WITH h AS (SELECT p_size AS level, count(*) AS n FROM part GROUP BY 1), e AS (SELECT unnest(range(1, 61)) AS level)
        SELECT coalesce(e.level, h.level)::BIGINT AS level, coalesce(n, 0) AS n, n IS NULL AS filled FROM e FULL JOIN h ON e.level = h.level"""),
}
