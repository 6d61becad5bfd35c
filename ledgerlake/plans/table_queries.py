"""The engine's operators over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlake.functions.columns import blob_path, nonfinite_tag, refs_in
from ledgerlake.operators.aggregate import curve, ragged_groups, varying_columns
from ledgerlake.operators.dedup import latest_attempt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str = ""):
    """Register a function under ``name``, or its own, with its SQL."""

    def put(f):
        QUERIES[name or f.__name__], SQL[name or f.__name__] = f, sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TIDY = """SELECT seed, method, step, name, value FROM (
  SELECT user_id % 5 AS seed, 'm' || CAST(user_id % 3 AS VARCHAR) AS method, CAST(dayofyear(ts) AS BIGINT) AS step, event_type AS name, value,
    row_number() OVER (PARTITION BY user_id % 5, 'm' || CAST(user_id % 3 AS VARCHAR), dayofyear(ts), event_type ORDER BY event_id DESC) AS r
  FROM events) WHERE r = 1"""
CURVE = f"""SELECT method, step AS x, round(avg(value), 6) AS y, round(stddev_samp(value) / sqrt(count(DISTINCT seed)), 6) AS yerr, count(DISTINCT seed) AS n
FROM ({TIDY}) WHERE name = 'click' AND value IS NOT NULL GROUP BY method, step"""


@query(TIDY)
def tidy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("seed"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("method"), F.dayofyear("ts").cast("long").alias("step"), F.col("event_type").alias("name"), "value", F.col("event_id").alias("attempt")
    )
    return latest_attempt(events, ["seed", "method", "step", "name"]).drop("attempt")


@query(CURVE, "curve")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curve(tidy_frame(spark, sf_dir).filter("name = 'click'"), over="seed", x="step", by=["method"])
    return out.select("method", F.col("step").alias("x"), F.round("y", 6).alias("y"), F.round("yerr", 6).alias("yerr"), "n")


@query(f"SELECT method, min(n) AS least, max(n) AS most FROM ({CURVE}) GROUP BY method HAVING count(DISTINCT n) > 1")
def curve_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ragged_groups(curve_points(spark, sf_dir), ["method"])


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dups FROM lineitem")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = Window.partitionBy("l_orderkey", "l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(key).alias("dups"))


STATUS = """SELECT user_id, day, CASE WHEN max(CASE WHEN tail = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'finished' WHEN max(CASE WHEN tail = 'error' THEN 1 ELSE 0 END) = 1 THEN 'failed' ELSE 'incomplete' END AS status
FROM (SELECT user_id, CAST(dayofyear(ts) AS BIGINT) AS day, hour(ts) // 12 AS half, max_by(event_type, event_id) AS tail FROM events GROUP BY 1, 2, 3) GROUP BY user_id, day"""


@query(STATUS)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = read(spark, sf_dir, "events").groupBy("user_id", F.dayofyear("ts").cast("long").alias("day"), F.floor(F.hour("ts") / 12).alias("half")).agg(F.max_by("event_type", "event_id").alias("tail"))
    folded = tails.groupBy("user_id", "day").agg(F.bool_or(F.col("tail") == "purchase").alias("done"), F.bool_or(F.col("tail") == "error").alias("bad"))
    return folded.select("user_id", "day", F.when(F.col("done"), "finished").when(F.col("bad"), "failed").otherwise("incomplete").alias("status"))


@query(f"SELECT status, count(*) AS n FROM ({STATUS}) GROUP BY status")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def config_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def coords_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def coords_json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT lang, count(*) AS n, min(ref) AS first_ref FROM (SELECT lang, unnest(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS ref FROM documents) GROUP BY lang")
def refs_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "documents").select("lang", F.explode(refs_in(F.col("text"), "[0-9]{3}-[0-9]{4}")).alias("ref"))
    return each.groupBy("lang").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS id, 'blobs/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3) AS path FROM documents")
def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return read(spark, sf_dir, "documents").select("doc_id", F.substring(digest, 1, 16).alias("id"), blob_path(F.concat(F.lit("blob:"), digest)).alias("path"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_anti")


@query("SELECT conv_id, max_by(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def last_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


@query("SELECT conv_id, count(*) = max(turn) - min(turn) + 1 AS contiguous, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def attempts_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") == F.max("turn") - F.min("turn") + 1).alias("contiguous"), F.min("turn").alias("first_turn"))


@query("SELECT event_type, user_id, count(DISTINCT props) AS props FROM events GROUP BY event_type, user_id")
def varying_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varying_columns(read(spark, sf_dir, "events"), ["event_type", "user_id"], ["props"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS value,
CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'nan' WHEN l_discount = 0 THEN '+inf' END AS nonfinite FROM lineitem""", "nonfinite_tag")
def nonfinite_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.round(F.col("l_tax") / F.col("l_discount"), 6))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", ratio.alias("v"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *nonfinite_tag(F.col("v")))


@query("""SELECT (r - 1) // 4096 AS shard, count(*) AS n, min(l_orderkey) AS first_key FROM
(SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS r FROM lineitem) GROUP BY 1""")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.streaming.record_stream import numbered

    rows = numbered(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"])
    return rows.groupBy(F.expr("row_no div 4096").alias("shard")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS size, round(CAST(list_max(embedding) AS DOUBLE), 6) AS most, round(CAST(list_min(embedding) AS DOUBLE), 6) AS least FROM embeddings")
def array_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda f: F.round(f("embedding").cast("double"), 6)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("size"), rounded(F.array_max).alias("most"), rounded(F.array_min).alias("least"))


@query("""SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer
UNION ALL BY NAME SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = lambda t: t.toDF(*[c.split("_", 1)[1].replace("custkey", "key").replace("suppkey", "key") for c in t.columns])
    return bare(read(spark, sf_dir, "customer")).unionByName(bare(read(spark, sf_dir, "supplier")), allowMissingColumns=True)


@query("SELECT * EXCLUDE (c_custkey, c_name, c_acctbal), count(*) AS n, round(avg(c_acctbal), 6) AS y FROM customer GROUP BY ALL")
def runs_group_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.plans.reader import rewrite_exclude

    sql = rewrite_exclude("SELECT * EXCLUDE (c_custkey, c_name, c_acctbal), count(*) AS n, round(avg(c_acctbal), 6) AS y FROM {t} GROUP BY ALL")
    return spark.sql(sql, t=read(spark, sf_dir, "customer"))


@query("SELECT event_type, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("y"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS place FROM orders")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.dense_rank().over(w).cast("long").alias("place"))


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_linenumber <= 2) ON o_orderkey = l_orderkey")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders").select("o_orderkey").filter("o_orderkey % 3 <> 0"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").filter("l_orderkey % 5 <> 0 AND l_linenumber <= 2")
    return orders.join(lines, F.expr("o_orderkey = l_orderkey"), "full")


@query("SELECT c_custkey, count(o_orderkey) AS n, sum(o_totalprice) IS NULL AS none FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), F.expr("c_custkey = o_custkey"), "left")
    return both.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").isNull().alias("none"))


@query("SELECT s_suppkey, n_nationkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_suppkey", "s_nationkey")
    return rich.join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.expr("s_nationkey = n_nationkey"), "right").drop("s_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(chosen, F.expr("o_custkey = c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 nations with 5 regions: both sides of a fixed size."""
    return read(spark, sf_dir, "region").select("r_name").crossJoin(read(spark, sf_dir, "nation").select("n_name"))


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour of a click: equal users, a range of times."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    a, b = events.filter("event_type = 'click'").alias("a"), events.filter("event_type = 'purchase'").alias("b")
    near = F.expr("a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
    return a.join(b, near).select("a.user_id", F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("then_id"))


@query("""SELECT p.event_id, max_by(c.event_id, (c.ts, c.event_id)) AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
ON p.user_id = c.user_id AND c.ts <= p.ts GROUP BY p.event_id""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click at or before each purchase of a user: one sort of both sides, no join."""
    events = read(spark, sf_dir, "events").filter("event_type IN ('click', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    before = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(before)
    return events.select("event_id", "event_type", last.alias("click_id")).filter("event_type = 'purchase'").drop("event_type")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type, p_size), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = [F.col("p_brand"), F.col("p_type"), F.col("p_size")]
    return read(spark, sf_dir, "part").groupingSets([key[:1], key[1:], []], *key).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def analytic_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    moving = F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, Window.currentRow)), 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"), moving.alias("moving"))


@query("SELECT o_custkey AS custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")).subtract(read(spark, sf_dir, "customer").filter("c_nationkey < 10").select("c_custkey"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS middle, round(stddev_samp(p_retailprice), 4) AS spread, round(corr(p_retailprice, p_size), 6) AS corr FROM part GROUP BY p_brand")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.5), 4).alias("middle"), F.round(F.stddev_samp("p_retailprice"), 4).alias("spread"), F.round(F.corr("p_retailprice", "p_size"), 6).alias("corr"))


@query("SELECT event_type, true AS near FROM events GROUP BY event_type")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch's count of users lies within 10 % of the exact one, for each type."""
    both = read(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"))
    return both.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))
