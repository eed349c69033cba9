"""Relational reporting over customers (users), nations (teams), regions, orders (uploads, tasks) and line items (assignees)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..sources.sinks import insert_ignore, upsert
from ..sources.tables import table

NOW = "2001-08-02 00:00:00"


def scoped(spark: SparkSession, d: str, role: str, actor: int, team: int | None) -> DataFrame:
    """Orders that an actor sees. A team's rows come by a semi join with its members."""
    orders, users = table(spark, d, "orders"), table(spark, d, "customer")
    if role == "ADMIN" and team is not None:
        return orders.join(users.where(F.col("c_nationkey") == team), orders.o_custkey == users.c_custkey, "left_semi")
    return orders.where(R.visible(role, F.col("o_custkey"), F.lit(None), actor, team))


def counts(orders: DataFrame, users: DataFrame, now: str = NOW) -> DataFrame:
    """(metric, key, value): every count of the dashboard; the counts of one table come from one pass over it."""
    recent = F.col("o_orderdate") >= F.lit(now).cast("timestamp_ntz") - F.expr("interval 7 days")
    by_status = orders.groupBy(F.col("o_orderstatus").alias("key")).agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"))
    status = by_status.select(F.lit("orders_by_status").alias("metric"), "key", F.col("n").alias("value"))
    last = by_status.select(F.lit("orders_last_7_days_by_status").alias("metric"), "key", F.col("recent").alias("value"))
    roles = users.groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    return status.union(last).union(roles.select(F.lit("users_by_role"), "key", "n")).union(roles.select(F.lit("active_users_by_role"), "key", "active"))


def dashboard_counts(spark, d):
    return counts(table(spark, d, "orders"), table(spark, d, "customer"))


def _scoped_sql(condition: str) -> str:
    return f"SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE {condition} GROUP BY 1"


def _status(df):
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def scoped_team(spark, d):
    return _status(scoped(spark, d, "ADMIN", 0, 3))


def scoped_self(spark, d):
    return _status(scoped(spark, d, "USER", 37, None))


def scoped_none(spark, d):
    return _status(scoped(spark, d, "ADMIN", 0, None))


def scoped_all(spark, d):
    return _status(scoped(spark, d, "SUPER_ADMIN", 0, None))


def recent_activity(spark, d):
    """The ten most recent orders with their user; the user is a guarded struct, flattened for the report."""
    o, u = table(spark, d, "orders"), table(spark, d, "customer")
    top = o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10)
    user = F.when(F.col("c_custkey").isNotNull(), F.struct("c_custkey", "c_name"))
    return top.join(u, top.o_custkey == u.c_custkey, "left").withColumn("user", user).select("o_orderkey", "o_orderstatus", F.col("user.c_custkey").alias("user_id"), F.col("user.c_name").alias("user_name"))


def users_page(spark, d):
    """Page 2 of the users with team and role names, 25 rows a page, in the order of name and id."""
    u, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    joined = u.join(n, u.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return R.page(joined, [F.asc(F.lower("c_name")), F.asc("c_custkey")], 2, 25).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("n_name").alias("team"), F.col("r_name").alias("region"))


def tasks_with_assignees(spark, d):
    """Each order with its parts as one ordered list; the child side is aggregated before the join."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    people = li.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    lines = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), ",")
    return o.join(people, o.o_orderkey == people.l_orderkey, "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(lines, F.lit("")).alias("lines"))


def visible_tasks_exists(spark, d):
    """Orders with at least one returned line of quantity 45 and more."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li.where("l_returnflag = 'R' and l_quantity >= 45"), o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


def team_member_counts(spark, d):
    """Users and suppliers of each nation; each side is counted before it is joined."""
    n = table(spark, d, "nation")
    u = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("users"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return n.join(u, n.n_nationkey == u.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left").select("n_name", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def latest_version(spark, d):
    """Every user with the key and status of the latest order, null without one."""
    u, o = table(spark, d, "customer"), table(spark, d, "orders")
    last = R.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return u.join(last, u.c_custkey == last.o_custkey, "left").select("c_custkey", "o_orderkey", "o_orderstatus")


def last_n_history(spark, d):
    return R.last_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


def next_version_number(spark, d):
    """The next number of each user's series and its label, 1 where there is none."""
    u, o = table(spark, d, "customer"), table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    following = F.coalesce("n", F.lit(0)) + 1
    return u.join(o, u.c_custkey == o.o_custkey, "left").select("c_custkey", following.alias("next_version"), F.concat(F.lit("v"), following.cast("string"), F.lit(".0")).alias("label"))


def next_business_id(spark, d):
    """The next id of each brand's numbered names: the largest numeric suffix and one, padded to three digits."""
    number = F.expr(r"try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) as bigint)")
    return table(spark, d, "part").groupBy("p_type").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("n")).select("p_type", T.padded_id("DOC-", F.col("n")).alias("next_id"))


def region_classify_counts(spark, d):
    """Users by the first continent whose keywords the region's name has; classes without users are absent."""
    u, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    kind = R.first_match(F.col("r_name"), [("West", ["america", "europe"]), ("East", ["asia", "middle"]), ("South", ["africa"])], "Other")
    return u.join(n, u.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy(kind.alias("continent")).agg(F.count("*").alias("users"))


def _changes(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.lit(None).cast("bigint").alias("o_custkey"), F.lit("X").alias("o_orderstatus"))


def upsert_orders(spark, d):
    """Stored orders after changes that set the status, keep the user and add keys that weren't there."""
    return upsert(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _changes(spark, d), ["o_orderkey"])


def insert_ignore_orders(spark, d):
    return insert_ignore(table(spark, d, "orders"), _changes(spark, d), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


def cascade_delete(spark, d):
    """Line items that remain when the orders of users with a negative balance go, counted by status."""
    gone = table(spark, d, "customer").where("c_acctbal < 0")
    o = table(spark, d, "orders").join(gone, F.col("o_custkey") == gone.c_custkey, "left_anti")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == o.o_orderkey, "left_semi").groupBy("l_linestatus").agg(F.count("*").alias("n"))


def progress_status(spark, d):
    """Status derived from the share of closed lines: all closed, some, or none."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("n"))
    percent = F.floor(F.col("done") * 100 / F.col("n") + 0.5).cast("long")
    return li.select("l_orderkey", percent.alias("percent"), F.when(percent == 100, "COMPLETED").when(percent > 0, "IN_PROGRESS").otherwise("PENDING").alias("status"))


def title_duplicates(spark, d):
    """Titles that are equal once normalised, with how many rows share each."""
    return table(spark, d, "part").groupBy(T.comparison_key(F.col("p_name")).alias("title")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


def snapshot_compare(spark, d):
    """Full outer comparison of two snapshots of the parts by path: added, removed, changed and equal."""
    p = table(spark, d, "part")
    path = F.concat_ws("/", "p_type", F.col("p_partkey").cast("string"))
    old = p.where("p_size % 7 <> 0").select(path.alias("path"), F.col("p_brand").alias("old_value"))
    new = p.where("p_size % 5 <> 0").select(path.alias("path"), F.when(F.col("p_size") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("new_value"))
    kind = F.when(F.col("old_value").isNull(), "add").when(F.col("new_value").isNull(), "del").when(F.col("old_value") != F.col("new_value"), "mod").otherwise("same")
    return old.join(new, "path", "full_outer").select("path", kind.alias("kind"), "old_value", "new_value")


def option_list(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().orderBy("p_brand")


def user_kpis(spark, d):
    u = table(spark, d, "customer")
    return u.agg(F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_if(F.col("c_acctbal") <= 0).alias("inactive"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("builders"), F.count("*").alias("n"))


def facet_search(spark, d):
    """Suppliers and parts that pass a text search over several columns, a multi-select and a range."""
    p = table(spark, d, "part")
    return p.where(R.all_of(R.any_contains(["p_name", "p_type"], "Ring"), R.one_of("p_brand", ["Brand#2", "Brand#12"]), R.one_of("p_size", []), F.col("p_retailprice") > 900)).select("p_partkey", "p_name", "p_brand")


def numeric_id_sort(spark, d):
    """Brands in the order of the number in their name, with their rank."""
    number = F.regexp_replace("p_brand", r"\D", "").cast("int")
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return brands.select("p_brand", "n", F.row_number().over(Window.orderBy(number, "p_brand")).cast("long").alias("position"))


def audit_fanout(spark, d):
    """One notification for each user of a nation that had an urgent open order."""
    u = table(spark, d, "customer")
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").join(u, F.col("o_custkey") == u.c_custkey).groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("o_orderkey").alias("about"))
    return u.join(o, u.c_nationkey == o.nation).select("c_custkey", "about")


def statements(spark, d):
    """One text column of insert statements from two tables of different shape."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    n = table(spark, d, "nation").select(F.concat(F.lit("INSERT INTO team VALUES ("), F.col("n_nationkey").cast("string"), F.lit(", "), quote("n_name"), F.lit(");")).alias("statement"))
    return n.union(table(spark, d, "region").select(F.concat(F.lit("INSERT INTO role VALUES ("), F.col("r_regionkey").cast("string"), F.lit(", "), quote("r_name"), F.lit(");"))))


QUERIES = {
    "dashboard_counts": (dashboard_counts, f"""
        SELECT 'orders_by_status' AS metric, o_orderstatus AS key, count(*) AS value FROM orders GROUP BY 2
        UNION ALL SELECT 'orders_last_7_days_by_status', o_orderstatus, count(*) FILTER (o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) FROM orders GROUP BY 2
        UNION ALL SELECT 'users_by_role', c_mktsegment, count(*) FROM customer GROUP BY 2
        UNION ALL SELECT 'active_users_by_role', c_mktsegment, count(*) FILTER (c_acctbal > 0) FROM customer GROUP BY 2"""),
    "scoped_counts_team": (scoped_team, _scoped_sql("o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")),
    "scoped_counts_self": (scoped_self, _scoped_sql("o_custkey = 37")),
    "scoped_counts_none": (scoped_none, _scoped_sql("1 = 0")),
    "scoped_counts_all": (scoped_all, _scoped_sql("true")),
    "recent_activity_top10": (recent_activity, "SELECT o_orderkey, o_orderstatus, c_custkey AS user_id, c_name AS user_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10"),
    "users_page": (users_page, "SELECT c_custkey AS user_id, c_name AS name, n_name AS team, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey ORDER BY lower(c_name), c_custkey LIMIT 25 OFFSET 25"),
    "tasks_with_assignees": (tasks_with_assignees, """
        SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(concat_ws(':', l_linenumber, l_partkey, l_suppkey), ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""),
    "visible_tasks_exists": (visible_tasks_exists, "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45)"),
    "team_member_counts": (team_member_counts, "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS users, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation"),
    "latest_version_lateral": (latest_version, "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true"),
    "last_n_history": (last_n_history, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 5"),
    "next_version_number": (next_version_number, "SELECT c_custkey, count(o_orderkey) + 1 AS next_version, 'v' || (count(o_orderkey) + 1) || '.0' AS label FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "next_business_id": (next_business_id, r"SELECT p_type, 'DOC-' || CASE WHEN length(n::VARCHAR) >= 3 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END AS next_id FROM (SELECT p_type, coalesce(max(try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT)), 0) + 1 AS n FROM part GROUP BY 1)"),
    "region_classify_counts": (region_classify_counts, """
        SELECT CASE WHEN lower(r_name) LIKE '%america%' OR lower(r_name) LIKE '%europe%' THEN 'West' WHEN lower(r_name) LIKE '%asia%' OR lower(r_name) LIKE '%middle%' THEN 'East' WHEN lower(r_name) LIKE '%africa%' THEN 'South' ELSE 'Other' END AS continent, count(*) AS users
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""),
    "upsert_orders": (upsert_orders, "WITH c AS (SELECT o_orderkey * 2 AS o_orderkey, 'X' AS s FROM orders WHERE o_orderpriority = '1-URGENT') SELECT coalesce(c.o_orderkey, o.o_orderkey) AS o_orderkey, o.o_custkey, coalesce(c.s, o.o_orderstatus) AS o_orderstatus FROM orders o FULL OUTER JOIN c ON c.o_orderkey = o.o_orderkey"),
    "insert_ignore_orders": (insert_ignore_orders, "SELECT DISTINCT o_orderkey * 2 AS o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)"),
    "cascade_delete": (cascade_delete, "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1"),
    "progress_status": (progress_status, "SELECT l_orderkey, percent, CASE WHEN percent = 100 THEN 'COMPLETED' WHEN percent > 0 THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status FROM (SELECT l_orderkey, floor(count(*) FILTER (l_linestatus = 'F') * 100 / count(*) + 0.5)::BIGINT AS percent FROM lineitem GROUP BY 1)"),
    "title_duplicates": (title_duplicates, r"SELECT trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS title, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1"),
    "snapshot_compare": (snapshot_compare, """
        WITH o AS (SELECT p_type || '/' || p_partkey AS path, p_brand AS v FROM part WHERE p_size % 7 <> 0), n AS (SELECT p_type || '/' || p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS v FROM part WHERE p_size % 5 <> 0)
        SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.v IS NULL THEN 'add' WHEN n.v IS NULL THEN 'del' WHEN o.v <> n.v THEN 'mod' ELSE 'same' END AS kind, o.v AS old_value, n.v AS new_value FROM o FULL OUTER JOIN n ON o.path = n.path"""),
    "option_list": (option_list, "SELECT DISTINCT p_brand FROM part"),
    "user_kpis": (user_kpis, "SELECT count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_acctbal <= 0) AS inactive, count(*) FILTER (c_mktsegment = 'BUILDING') AS builders, count(*) AS n FROM customer"),
    "facet_search": (facet_search, "SELECT p_partkey, p_name, p_brand FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%') AND p_brand IN ('Brand#2', 'Brand#12') AND p_retailprice > 900"),
    "numeric_id_sort": (numeric_id_sort, r"SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY regexp_replace(p_brand, '\D', '', 'g')::INT, p_brand) AS position FROM part GROUP BY 1"),
    "audit_fanout": (audit_fanout, "WITH o AS (SELECT c_nationkey AS nation, max(o_orderkey) AS about FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey, about FROM customer JOIN o ON c_nationkey = nation"),
    "insert_statements": (statements, "SELECT 'INSERT INTO team VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''');' AS statement FROM nation UNION ALL SELECT 'INSERT INTO role VALUES (' || r_regionkey || ', ''' || replace(r_name, '''', '''''') || ''');' FROM region"),
}
