"""Predicates, joins, groupings and mutations of the application tables: customers as users, orders as tasks, line items as their changes, pages as crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table

NOW = "2001-08-02 00:00:00"


def deleted():
    """An order counts as deleted at its date when it is finished."""
    return F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))


#: The order of an order's lines; line numbers repeat.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
DELETED_SQL = "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END"


def nested_orders(spark, d):
    """Each order as a nested JSON object with its user inside."""
    o, u = table(spark, d, "orders"), table(spark, d, "customer")
    user = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), user.alias("user")))
    return o.join(u, o.o_custkey == u.c_custkey).select("o_orderkey", body.alias("body"))


def soft_delete_filter(spark, d):
    return table(spark, d, "orders").where(deleted().isNull()).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def soft_delete_restore(spark, d):
    """All orders after those above 300,000 were deleted now and urgent ones restored; restoring wins."""
    o = table(spark, d, "orders")
    after = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).when(F.col("o_totalprice") > 300000, F.lit(NOW).cast("timestamp_ntz")).otherwise(deleted())
    return o.select("o_orderkey", after.alias("deleted_at"))


def null_or_in_set(spark, d):
    """Orders that aren't deleted, or whose user is in the building segment."""
    o, u = table(spark, d, "orders"), table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("mine"))
    return o.join(u, "o_custkey", "left").where(deleted().isNull() | F.col("mine")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def section_match(spark, d):
    """Documents of the section src1, or of no or an unknown section and in English."""
    named = F.lower(F.coalesce("source", F.lit(""))) == "src1"
    legacy = (F.col("source").isNull() | (F.col("source") == "unknown")) & (F.col("lang") == "en")
    return table(spark, d, "documents").where(named | legacy).groupBy("lang").agg(F.count("*").alias("n"))


def case_insensitive_match(spark, d):
    return table(spark, d, "customer").where(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).groupBy("c_nationkey").agg(F.count("*").alias("n"))


def prefix_filter(spark, d):
    p = table(spark, d, "part").where(F.col("p_type").startswith("PROMO") | ~F.col("p_type").like("%S%"))
    return p.groupBy("p_type").agg(F.count("*").alias("n"))


def month_retention(spark, d):
    """Orders that a retention of 36 months keeps, by month."""
    limit = F.expr(f"timestamp_ntz'{NOW}' - interval 36 months")
    return table(spark, d, "orders").where(F.col("o_orderdate") >= limit).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def tri_state_facet(spark, d):
    """How many users each choice of a facet shows: all, those without the mark, one team, or one own group (CUSTOM_ and its name)."""
    u = table(spark, d, "customer")
    choices = spark.createDataFrame([("ALL",), ("NONE",), ("7",), ("CUSTOM_BUILDING",)], "choice string")
    groups = u.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("without"))
    c = F.col("choice")
    shown = F.when(c == "ALL", F.col("n")).when(c == "NONE", F.col("without"))
    shown = shown.when(c.startswith("CUSTOM_"), F.when(F.col("c_mktsegment") == F.substring(c, 8, 100), F.col("n")).otherwise(0)).otherwise(F.when(F.col("c_nationkey") == c.try_cast("int"), F.col("n")).otherwise(0))
    return groups.crossJoin(F.broadcast(choices)).groupBy("choice").agg(F.sum(shown).alias("shown"))  # four choices


def lines(spark, d) -> DataFrame:
    """(doc_id, no, line) of all documents."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))


LINES_SQL = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents"
#: Lines that are noise to the detection of changes within a chunk, and titles of rows that hold no data.
LINE_NOISE = r"^([0-9]{1,4}$|page\s+[0-9]+\s*(of\s+[0-9]+)?$|[fc][0-9]+(\s|$)|textual\s+amendments?\s*$|modifications?\s+etc\.?\s*$|(commencement|extent)\s*$|(part|chapter|section|schedule)\s+[0-9]+[a-z]?\s*[:\-–]\s*\S|words?\s+in\s+s\.\s*[0-9]|(inserted|omitted|repealed|substituted)\s+(by|with\s+effect)|s\.i\.\s*[0-9]{4}/[0-9]+)"
NOT_DATA = r"^\*|\bsme\s*check[-\s]*point\b|\btoc\s*[-\s]*sorting\s*order\b|\bclick\s+any\s+cell\s+to\s+edit\b"


def without_data(title, url, comments):
    """Rows that hold no data: neither a title nor an address; boilerplate in the title; boilerplate in the comments of a row without an address; or a title of more than 80 characters without one."""
    name, note = (F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))) for x in (title, comments))
    address = F.trim(F.coalesce(url, F.lit(""))) != ""
    boiler = lambda x: F.rlike(x, F.lit(NOT_DATA))
    return ((name == "") & ~address) | boiler(name) | (~address & boiler(note)) | (~address & (F.length(name) > 80))


def line_classes(spark, d):
    """Lines that are labels of navigation, noise to the detection of changes, or titles without data (no address, the next line as the comments), by document."""
    w = Window.partitionBy("doc_id").orderBy("no")
    x = lines(spark, d).withColumn("next", F.lead("line").over(w))
    found = {"breadcrumbs": T.is_breadcrumb(F.col("line")), "noise": F.rlike(F.lower("line"), F.lit(LINE_NOISE)), "not_data": without_data(F.col("line"), F.lit(None).cast("string"), F.col("next"))}
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), *[F.count_if(c).alias(n) for n, c in found.items()])


def pages_with_content(spark, d):
    """Whether a page has content: 500 characters and more, and more than 300 of text."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), " +", " "))
    return table(spark, d, "pages").select("page_id", F.length(text).alias("n_text"), ((F.length("html") >= 500) & (F.length(text) > 300)).alias("has_content"))


def window_overlap(spark, d):
    """Orders whose span of shipping dates overlaps March 1995, both ends included."""
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    return spans.where("first <= timestamp_ntz'1995-03-31 00:00:00' and last >= timestamp_ntz'1995-03-01 00:00:00'").select("l_orderkey", "first", "last")


def section_changes(spark, d):
    """Changes (line items) of the urgent section, counted by kind; a change belongs to the section of its order."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    li = table(spark, d, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"))


def role_members(spark, d):
    """Users by role and status membership: privileged roles, and roles that are shown while active."""
    u = table(spark, d, "customer").select(F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("privileged"), (F.col("c_acctbal") > 0).alias("active"))
    return u.groupBy("privileged", "active").agg(F.count("*").alias("n"))


def task_star(spark, d):
    """Each order with user (inner), team and region (left) and its line items (left, grouped before the join)."""
    o, u, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    found = o.join(u, o.o_custkey == u.c_custkey).join(n, u.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(li, o.o_orderkey == li.l_orderkey, "left")
    return found.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("quantity", F.lit(0)).alias("quantity"))


def policy_pivot(spark, d):
    """Users by team, looked up by the team's slug, with one column for each role."""
    n = table(spark, d, "nation").select("n_nationkey", F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "-").alias("slug"))
    u = table(spark, d, "customer").select("c_nationkey", F.when(F.col("c_acctbal") > 5000, "ADMIN").otherwise("USER").alias("role"))
    return u.join(n, u.c_nationkey == n.n_nationkey).groupBy("slug").agg(F.count_if(F.col("role") == "ADMIN").alias("admins"), F.count_if(F.col("role") == "USER").alias("users"))


def unfiltered_list(spark, d):
    """Users with their order keys as a list that holds one null where there is no order."""
    u, o = table(spark, d, "customer"), table(spark, d, "orders")
    keys = F.array_join(F.array_sort(F.collect_list(F.coalesce(F.col("o_orderkey").cast("string"), F.lit("null")))), ",")
    return u.join(o, u.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("*").alias("entries"), keys.alias("keys"))


def style_vote(spark, d):
    """Documents of which more than 4 of 10 word characters stand in capitalised words."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[ \n]+")).alias("word")).where("word <> ''")
    flag = F.rlike("word", F.lit("^[A-Z]"))
    return w.groupBy("doc_id").agg(F.sum(F.length("word")).alias("chars"), F.sum(F.when(flag, F.length("word")).otherwise(0)).alias("capital")).withColumn("marked", F.col("capital") * 10 > F.col("chars") * 4)


def body_size(spark, d):
    """The size class (of 500 characters) that holds most characters of each source, the smaller one of equals."""
    by = table(spark, d, "documents").groupBy("source", F.expr("n_chars div 500").alias("size")).agg(F.sum("n_chars").alias("chars"))
    return by.groupBy("source").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("size"), F.max("chars").alias("chars"))


def zone_headers(spark, d):
    """Lines in the first or last 15 % of a document that 2 documents of a source and at least a thousandth of them have there, each counted once a document."""
    at = lines(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    zone = F.when(F.col("no") < F.col("n") * 0.15, "top").when(F.col("no") >= F.col("n") * 0.85, "bottom")
    src = table(spark, d, "documents").select("doc_id", "source")
    sizes = src.groupBy("source").agg(F.count("*").alias("docs"))
    found = at.withColumn("zone", zone).where("zone is not null and trim(line) <> ''").join(src, "doc_id").groupBy("source", "zone", "line").agg(F.countDistinct("doc_id").alias("n_docs"))
    return found.join(sizes, "source").where("n_docs >= greatest(2, docs / 1000.0)").select("source", "zone", F.md5("line").alias("line"), "n_docs")


def median_gap(spark, d):
    """Median days between the shipping dates of an order's neighbouring lines, by line status. Lines of one day and number come as they stand in the table."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "file", "place")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_shipdate", "l_linenumber", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    gaps = lines.select("l_linestatus", F.datediff(F.lead("l_shipdate").over(w), "l_shipdate").alias("gap")).where("gap is not null")
    return gaps.groupBy("l_linestatus").agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.count("*").alias("gaps"))


def level_census(spark, d):
    """Levels (sizes of parts) that at least two parts have, with their first three parts."""
    p = table(spark, d, "part").select(F.col("p_size").alias("level"), "p_partkey")
    first = p.withColumn("nth", F.row_number().over(Window.partitionBy("level").orderBy("p_partkey"))).where("nth <= 3")  # cut before the shuffle
    samples = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return p.groupBy("level").agg(F.count("*").alias("n")).where("n >= 2").join(first.groupBy("level").agg(samples.alias("samples")), "level")


#: Tags to choose from, in the order of choice.
CANDIDATES = ("article", "section", "p", "li", "div")


def tag_selection(spark, d):
    """The first candidate tag with two elements and more on each page."""
    count = lambda t: F.regexp_count(F.lower("html"), F.lit(f"<{t}[ >]"))
    return table(spark, d, "pages").select("page_id", F.coalesce(*[F.when(count(t) >= 2, t) for t in CANDIDATES]).alias("tag"))


def crawl_summary(spark, d):
    """Pages, pages with content and bytes of each host's site."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_if(F.length("html") > 0).alias("success"), F.sum(F.octet_length("html")).alias("bytes"), F.max(F.octet_length("html")).alias("largest"))


#: Probes by priority, what they tell, and the weight of the answer.
PROBES = (("numbered", r"[0-9]", 1.0), ("two_words", r"^\S+ \S+$", 0.9), ("text", r"[a-z]", 0.5))


def example_types(spark, d):
    """What the names of a brand's parts look like: the first probe that at least half of them match, and the share of those times its weight."""
    votes = [F.avg(F.rlike("p_name", F.lit(p)).cast("int")).alias(n) for n, p, _ in PROBES]
    by = table(spark, d, "part").groupBy("p_brand").agg(*votes)
    kind = F.coalesce(*[F.when(F.col(n) >= 0.5, n) for n, _, _ in PROBES])
    sure = F.coalesce(*[F.when(F.col(n) >= 0.5, F.col(n) * w) for n, _, w in PROBES])
    return by.select("p_brand", kind.alias("type"), F.round(sure, 6).alias("confidence"))


def ordinal_runs(spark, d):
    """The increasing run of each order's quantities that begins at the first smallest one and takes every larger one on its way."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    li = table(spark, d, "lineitem").withColumn("low", F.min("l_quantity").over(Window.partitionBy("l_orderkey")))
    started = F.max((F.col("l_quantity") == F.col("low")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    li = li.withColumn("started", started).where("started = 1")
    before = F.max("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return li.withColumn("before", before).where("before is null or l_quantity > before").select("l_orderkey", "l_linenumber", "l_quantity")


def position_scores(spark, d):
    """How near an order's line stands to its rank by price: 1 - distance / tolerance, the tolerance 0.2 for many lines and up to 0.5 for few."""
    w, p = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER), Window.partitionBy("l_orderkey").orderBy("l_extendedprice", *LINE_ORDER)
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) / n).alias("a"), (F.row_number().over(p) / n).alias("b"), F.least(F.lit(0.5), F.lit(0.2) / F.least(F.lit(1.0), n / 4)).alias("tolerance"))
    return li.select("l_orderkey", "l_linenumber", F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("a") - F.col("b")) / F.col("tolerance")), 6).alias("score"))


def sibling_index(spark, d):
    """How often each tag opens on a page, as the largest index among its kind, counted from zero."""
    tags = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all(F.lower("html"), F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))).alias("at", "tag"))
    index = F.row_number().over(Window.partitionBy("page_id", "tag").orderBy("at")) - 1
    return tags.withColumn("index", index).groupBy("page_id", "tag").agg(F.max("index").alias("last_index"))


def user_sort(spark, d):
    """The first 50 users by a chosen key (name, descending, without regard to case)."""
    return table(spark, d, "customer").orderBy(F.desc(F.lower("c_name")), "c_custkey").limit(50).select("c_custkey", "c_name")


def sentinel_sort(spark, d):
    """Rank of each supplier by its balance, those without a positive one last."""
    key = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(1e9)
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(key, "s_suppkey")).alias("rank"))


def best_url(spark, d):
    """The best link of each page: most slashes, then with a query or fragment, then the longest, then the first by code point."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))
    rank = F.struct(F.regexp_count("url", F.lit("/")), F.rlike("url", F.lit("[?#]")).cast("int"), F.length("url"))
    best = links.groupBy("page_id").agg(F.max(rank).alias("best"), F.count("*").alias("links"))
    found = links.withColumn("rank", rank).join(best, "page_id").where("rank = best").groupBy("page_id", "links").agg(F.min("url").alias("url"))
    return found.select("page_id", "url", "links")


def capped_lines(spark, d):
    """The first 30 lines of each document, as a digest, and how many were left out."""
    all_lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.slice(all_lines, 1, 30), "\n")).alias("shown"), F.greatest(F.lit(0), F.size(all_lines) - 30).alias("left_out"))


def path_sets(spark, d):
    """Links that only English pages, only others, or both have, counted by kind."""
    links = table(spark, d, "pages").select(F.rlike("html", F.lit('lang="en"')).alias("en"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url")).distinct()
    kinds = links.groupBy("url").agg(F.count("*").alias("n"), F.max(F.col("en").cast("int")).alias("en"))
    kind = F.when(F.col("n") == 2, "both").when(F.col("en") == 1, "only_en").otherwise("only_other")
    return kinds.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def chunk_concat(spark, d):
    """Parts and suppliers as two batches of one list, numbered through: the ids of the second batch begin after the first."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    offset = p.agg(F.max("p_partkey").alias("offset"))
    second = s.crossJoin(F.broadcast(offset)).select((F.col("s_suppkey") + F.coalesce("offset", F.lit(0))).alias("id"), F.col("s_name").alias("name"))  # one row
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).union(second)


def patched(spark, d) -> DataFrame:
    """Orders with the changes of a patch: a new status and priority, null where the patch keeps what is there."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_totalprice") > 400000, "P")
    priority = F.when(F.col("o_orderstatus") == "O", "3-MEDIUM")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("old_status"), F.col("o_orderpriority").alias("old_priority"), F.coalesce(status, "o_orderstatus").alias("status"), F.coalesce(priority, "o_orderpriority").alias("priority"))


def partial_update(spark, d):
    return patched(spark, d).select("o_orderkey", "status", "priority")


def audit_append(spark, d):
    """One audit row for each field that the patch changes."""
    changes = F.array(*[F.when(F.col(f"old_{c}") != F.col(c), F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("before"), F.col(c).alias("after"))) for c in ("status", "priority")])
    return patched(spark, d).select("o_orderkey", F.explode(F.array_compact(changes)).alias("x")).select("o_orderkey", "x.field", "x.before", "x.after")


def reassign_owner(spark, d):
    """Orders after users with a balance under -900 are gone: theirs go to the first user that stays in the same team, or to none."""
    u, o = table(spark, d, "customer"), table(spark, d, "orders")
    heirs = u.where("c_acctbal >= -900").groupBy("c_nationkey").agg(F.min("c_custkey").alias("heir"))
    gone = u.where("c_acctbal < -900").join(heirs, "c_nationkey", "left").select(F.col("c_custkey").alias("o_custkey"), "heir", F.lit(True).alias("gone"))
    return o.join(gone, "o_custkey", "left").select("o_orderkey", F.when(F.col("gone"), F.col("heir")).otherwise(F.col("o_custkey")).alias("owner"))


def rederived(spark, d):
    """Orders whose stored status differs from the one that their lines tell."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.min("l_linestatus") != F.max("l_linestatus"), "P").otherwise(F.min("l_linestatus")).alias("derived"))
    o = table(spark, d, "orders")
    return o.join(li, o.o_orderkey == li.l_orderkey).where("derived <> o_orderstatus").select("o_orderkey", "o_orderstatus", "derived")


def insert_returning(spark, d):
    """Rows that an insert of negative-balance suppliers as users returns: new ids follow the largest one, in the order of the suppliers' keys within their team."""
    u, s = table(spark, d, "customer"), table(spark, d, "supplier").where("s_acctbal < 0")
    teams = s.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    before = teams.select("s_nationkey", (F.sum("n").over(Window.orderBy("s_nationkey")) - F.col("n")).alias("before"))  # one row a team
    nth = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    top = u.agg(F.coalesce(F.max("c_custkey"), F.lit(0)).alias("top"))
    return s.withColumn("nth", nth).join(before, "s_nationkey").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("before") + F.col("nth")).alias("id"), F.col("s_name").alias("name"))


_BASE = f"SELECT *, {DELETED_SQL} AS deleted_at FROM orders"
_PATCH = """SELECT o_orderkey, o_orderstatus AS old_status, o_orderpriority AS old_priority, CASE WHEN o_totalprice > 400000 THEN 'P' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderstatus = 'O' THEN '3-MEDIUM' ELSE o_orderpriority END AS priority FROM orders"""

QUERIES = {
    "nested_orders": (nested_orders, """SELECT o_orderkey, json_object('id', o_orderkey, 'status', o_orderstatus, 'user', json_object('id', c_custkey, 'name', c_name))::VARCHAR AS body
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "soft_delete_filter": (soft_delete_filter, f"SELECT o_orderpriority, count(*) AS n FROM ({_BASE}) WHERE deleted_at IS NULL GROUP BY 1"),
    "soft_delete_restore": (soft_delete_restore, f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_totalprice > 300000 THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at FROM ({_BASE})"""),
    "null_or_in_set": (null_or_in_set, f"""SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM ({_BASE})
        WHERE deleted_at IS NULL OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1"""),
    "section_match": (section_match, "SELECT lang, count(*) AS n FROM documents WHERE lower(coalesce(source, '')) = 'src1' OR ((source IS NULL OR source = 'unknown') AND lang = 'en') GROUP BY 1"),
    "case_insensitive_match": (case_insensitive_match, "SELECT c_nationkey, count(*) AS n FROM customer WHERE lower(c_mktsegment) = lower('Building') GROUP BY 1"),
    "prefix_filter": (prefix_filter, "SELECT p_type, count(*) AS n FROM part WHERE p_type LIKE 'PROMO%' OR p_type NOT LIKE '%S%' GROUP BY 1"),
    "month_retention": (month_retention, f"SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 36 MONTH GROUP BY 1"),
    "tri_state_facet": (tri_state_facet, """SELECT 'ALL' AS choice, count(*) AS shown FROM customer UNION ALL SELECT 'NONE', count(*) FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT '7', count(*) FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'CUSTOM_BUILDING', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'"""),
    "line_classes": (line_classes, rf"""WITH a AS (SELECT doc_id, no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS next FROM ({LINES_SQL})),
        b AS (SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS low, lower(trim(regexp_replace(coalesce(next, ''), '\s+', ' ', 'g'))) AS note, regexp_replace(line, '[^A-Za-z]', '', 'g') AS letters FROM a),
        c AS (SELECT *, len(string_split(low, ' ')) AS n, string_split(low, ' ')[1] AS first FROM b)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE low <> '' AND n <= 6 AND NOT regexp_matches(low, '^\(|^[fcems][0-9]+\b') AND (regexp_matches(low, '{T.DIVISION}') OR (NOT regexp_matches(low, '{T.MARKED}') AND low NOT IN {T.TITLES}
          AND ((letters <> '' AND letters = upper(letters) AND n BETWEEN 2 AND 5) OR (first IN {tuple(T.LABELS)} AND n <= 4 AND regexp_matches(low, '^[a-z]+( [a-z]+)*$'))
            OR (first IN {tuple(T.MORE_LABELS)} AND n BETWEEN 2 AND 4 AND regexp_matches(trim(line), '^[A-Z][a-z]') AND NOT regexp_matches(low, '[,;0-9]')))))) AS breadcrumbs,
        count(*) FILTER (WHERE regexp_matches(lower(line), '{LINE_NOISE}')) AS noise, count(*) FILTER (WHERE low = '' OR regexp_matches(low, '{NOT_DATA}') OR regexp_matches(note, '{NOT_DATA}') OR length(low) > 80) AS not_data FROM c GROUP BY 1"""),
    "pages_with_content": (pages_with_content, """SELECT page_id, length(t) AS n_text, length(html) >= 500 AND length(t) > 300 AS has_content
        FROM (SELECT *, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), ' +', ' ', 'g')) AS t FROM pages)"""),
    "window_overlap": (window_overlap, """SELECT l_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1
        HAVING min(l_shipdate) <= TIMESTAMP '1995-03-31' AND max(l_shipdate) >= TIMESTAMP '1995-03-01'"""),
    "section_changes": (section_changes, """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"""),
    "role_members": (role_members, "SELECT c_mktsegment IN ('BUILDING', 'MACHINERY') AS privileged, c_acctbal > 0 AS active, count(*) AS n FROM customer GROUP BY 1, 2"),
    "task_star": (task_star, """SELECT o_orderkey, c_name, n_name, r_name, count(l_orderkey) AS n_lines, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS quantity
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4"""),
    "policy_pivot": (policy_pivot, """SELECT regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS slug, count(*) FILTER (WHERE c_acctbal > 5000) AS admins, count(*) FILTER (WHERE c_acctbal <= 5000) AS users
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""),
    "unfiltered_list": (unfiltered_list, """SELECT c_custkey, count(*) AS entries, array_to_string(list_sort(list(coalesce(o_orderkey::VARCHAR, 'null'))), ',') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""),
    "style_vote": (style_vote, r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM documents)
        SELECT doc_id, sum(length(word))::BIGINT AS chars, sum(CASE WHEN regexp_matches(word, '^[A-Z]') THEN length(word) ELSE 0 END)::BIGINT AS capital,
        sum(CASE WHEN regexp_matches(word, '^[A-Z]') THEN length(word) ELSE 0 END) * 10 > sum(length(word)) * 4 AS marked FROM w WHERE word <> '' GROUP BY 1"""),
    "body_size": (body_size, """WITH s AS (SELECT source, n_chars // 500 AS size, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2)
        SELECT source, size, chars FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY chars DESC, size) = 1"""),
    "zone_headers": (zone_headers, f"""WITH l AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({LINES_SQL})),
        z AS (SELECT doc_id, line, CASE WHEN no < n * 0.15 THEN 'top' WHEN no >= n * 0.85 THEN 'bottom' END AS zone FROM l WHERE trim(line) <> ''),
        s AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1)
        SELECT source, zone, md5(line) AS line, count(DISTINCT doc_id) AS n_docs FROM z JOIN documents USING (doc_id) JOIN s USING (source) WHERE zone IS NOT NULL
        GROUP BY source, zone, line, docs HAVING count(DISTINCT doc_id) >= greatest(2, docs / 1000.0)"""),
    "median_gap": (median_gap, """WITH g AS (SELECT l_linestatus, datediff('day', l_shipdate, lead(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber)) AS gap FROM lineitem)
        SELECT l_linestatus, quantile_cont(gap, 0.5)::DOUBLE AS median_gap, count(*) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY 1"""),
    "level_census": (level_census, "SELECT p_size AS level, count(*) AS n, array_to_string(list_sort(list(p_partkey))[1:3], ',') AS samples FROM part GROUP BY 1 HAVING count(*) >= 2"),
    "tag_selection": (tag_selection, "SELECT page_id, coalesce(" + ", ".join(f"CASE WHEN len(regexp_extract_all(lower(html), '<{t}[ >]')) >= 2 THEN '{t}' END" for t in CANDIDATES) + ") AS tag FROM pages"),
    "crawl_summary": (crawl_summary, """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, count(*) FILTER (WHERE length(html) > 0) AS success, sum(strlen(html))::BIGINT AS bytes, max(strlen(html)) AS largest FROM pages GROUP BY 1"""),
    "example_types": (example_types, "WITH v AS (SELECT p_brand, " + ", ".join(f"avg(regexp_matches(p_name, '{p}')::INT) AS {n}" for n, p, _ in PROBES) + " FROM part GROUP BY 1) SELECT p_brand, coalesce("
        + ", ".join(f"CASE WHEN {n} >= 0.5 THEN '{n}' END" for n, _, _ in PROBES) + ") AS type, round(coalesce(" + ", ".join(f"CASE WHEN {n} >= 0.5 THEN {n} * {w} END" for n, _, w in PROBES) + "), 6) AS confidence FROM v"),
    "ordinal_runs": (ordinal_runs, f"""WITH a AS (SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey) AS low FROM lineitem),
        b AS (SELECT * FROM a QUALIFY max((l_quantity = low)::INT) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) = 1),
        c AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
        SELECT l_orderkey, l_linenumber, l_quantity FROM c WHERE before IS NULL OR l_quantity > before"""),
    "position_scores": (position_scores, f"""WITH a AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS a,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, {", ".join(LINE_ORDER)}) AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(greatest(0.0, 1 - abs(a / n - b / n) / least(0.5, 0.2::DOUBLE / least(1.0::DOUBLE, n / 4))), 6) AS score FROM a"""),
    "sibling_index": (sibling_index, "SELECT page_id, tag, count(*) - 1 AS last_index FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2"),
    "user_sort": (user_sort, "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name) DESC, c_custkey LIMIT 50"),
    "sentinel_sort": (sentinel_sort, "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 1e9 END, s_suppkey) AS rank FROM supplier"),
    "best_url": (best_url, """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages)
        SELECT page_id, url, count(*) OVER (PARTITION BY page_id) AS links FROM l
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(url) - length(replace(url, '/', '')) DESC, regexp_matches(url, '[?#]')::INT DESC, length(url) DESC, url) = 1"""),
    "capped_lines": (capped_lines, "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:30], chr(10))) AS shown, greatest(0, len(string_split(text, chr(10))) - 30) AS left_out FROM documents"),
    "path_sets": (path_sets, """WITH l AS (SELECT DISTINCT regexp_matches(html, 'lang="en"') AS en, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages),
        k AS (SELECT url, count(*) AS n, max(en::INT) AS en FROM l GROUP BY 1) SELECT CASE WHEN n = 2 THEN 'both' WHEN en = 1 THEN 'only_en' ELSE 'only_other' END AS kind, count(*) AS n FROM k GROUP BY 1"""),
    "chunk_concat": (chunk_concat, "SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT s_suppkey + (SELECT coalesce(max(p_partkey), 0) FROM part), s_name FROM supplier"),
    "partial_update": (partial_update, f"SELECT o_orderkey, status, priority FROM ({_PATCH})"),
    "audit_append": (audit_append, f"""SELECT o_orderkey, 'status' AS field, old_status AS before, status AS after FROM ({_PATCH}) WHERE old_status <> status
        UNION ALL SELECT o_orderkey, 'priority', old_priority, priority FROM ({_PATCH}) WHERE old_priority <> priority"""),
    "reassign_owner": (reassign_owner, """WITH h AS (SELECT c_nationkey, min(c_custkey) AS heir FROM customer WHERE c_acctbal >= -900 GROUP BY 1)
        SELECT o_orderkey, CASE WHEN c_acctbal < -900 THEN heir ELSE o_custkey END AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN h USING (c_nationkey)"""),
    "rederived_status": (rederived, """WITH l AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'P' ELSE min(l_linestatus) END AS derived FROM lineitem GROUP BY 1)
        SELECT o_orderkey, o_orderstatus, derived FROM orders JOIN l ON l_orderkey = o_orderkey WHERE derived <> o_orderstatus"""),
    "insert_returning": (insert_returning, "SELECT (SELECT coalesce(max(c_custkey), 0) FROM customer) + row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS id, s_name AS name FROM supplier WHERE s_acctbal < 0"),
}
