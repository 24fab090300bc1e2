"""Queries over changing tables, text fields and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, versioned
from ..sources import io
from .registry import query, table


@query("snapshot_diff", """WITH a AS (SELECT p_partkey AS id, p_size AS size, p_brand AS brand FROM part WHERE p_partkey % 10 <> 3), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size, p_brand AS brand FROM part WHERE p_partkey % 10 <> 4)
  SELECT id, a.size AS old_size, b.size AS new_size, CASE WHEN a.brand IS NULL THEN 'added' WHEN b.brand IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (id) WHERE a.size IS DISTINCT FROM b.size""")
def snapshot_diff(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size AS size")
    after = p.where("id % 10 <> 4").withColumn("size", F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return versioned.snapshot_diff(p.where("id % 10 <> 3"), after, "id", ["size"])


@query("row_updates", "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN 99 ELSE p_size END AS size FROM part")
def row_updates(spark, sf):
    now = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_size AS size")
    return versioned.updated(now, now.where("id % 9 = 0").select("id", F.lit(99).alias("size")))


@query("row_deletes", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def row_deletes(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_quantity > 49").selectExpr("l_partkey AS id").distinct()
    return table(spark, sf, "part").selectExpr("p_partkey AS id").join(gone, "id", "left_anti")


@query("reordered_rows", "WITH f AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size = 7) SELECT p_partkey AS id, coalesce(r, p_partkey + 1099511627776) AS pos FROM part LEFT JOIN f ON id = p_partkey")
def reordered_rows(spark, sf):
    p = table(spark, sf, "part")
    front = ranking.global_rank(p.where("p_size = 7").select(F.col("p_partkey").alias("id"), "p_retailprice"), [F.desc("p_retailprice"), F.col("id")], "pos").select("id", "pos")
    return versioned.reordered(p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos")), front)


@query("merged_sources", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::BIGINT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey::BIGINT FROM supplier")
def merged_sources(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "cast(s_nationkey AS bigint) AS nation")
    return io.union_all([a, b])


@query("settings_delta", """WITH a AS (SELECT user_id AS k, max(event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS k, max(event_id - event_id % 2) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1)
  SELECT k, a.v AS old_v, b.v AS new_v FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def settings_delta(spark, sf):
    ev = table(spark, sf, "events")
    a = ev.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("v"))
    b = ev.where("event_id % 3 <> 0").groupBy(F.col("user_id").alias("k")).agg(F.max(F.expr("event_id - event_id % 2")).alias("v"))
    return versioned.snapshot_diff(a, b, "k", ["v"]).drop("change")


@query("json_paths", "SELECT event_id, k AS path, json_extract_string(props, k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_paths(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    return rows


@query("text_normalised", """SELECT c_custkey AS id, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS callsign, substr(upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')), 1, 3) AS prefix,
  CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 'car' WHEN contains(lower(c_mktsegment), 'house') THEN 'home' ELSE 'other' END AS kind FROM customer""")
def text_normalised(spark, sf):
    call = F.upper(F.regexp_replace("c_name", "[^A-Za-z0-9]", ""))
    seg = F.lower("c_mktsegment")
    kind = F.when(seg.contains("auto"), "car").when(seg.contains("house"), "home").otherwise("other")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), call.alias("callsign"), F.substring(call, 1, 3).alias("prefix"), kind.alias("kind"))


@query("prefix_dictionary", "WITH d AS (SELECT substr(n_name, 1, 1) AS code, min(n_name) AS label FROM nation GROUP BY 1) SELECT label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN d ON code = substr(n_name, 1, 1) GROUP BY 1")
def prefix_dictionary(spark, sf):
    n = table(spark, sf, "nation").withColumn("code", F.substring("n_name", 1, 1))
    d = n.groupBy("code").agg(F.min("n_name").alias("label"))
    return table(spark, sf, "customer").join(n, F.expr("c_nationkey = n_nationkey")).join(d, "code").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("height_fallback", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 25 THEN p_size::DOUBLE END, CASE WHEN p_size > 10 THEN (p_size % 10) * 3.2 END, 5.0) AS height FROM part")
def height_fallback(spark, sf):
    h = F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size").cast("double")), F.when(F.col("p_size") > 10, F.col("p_size") % 10 * F.lit(3.2)), F.lit(5.0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), h.alias("height"))


@query("array_minimum", "SELECT l_orderkey AS id, min(l_extendedprice) FILTER (l_returnflag IN ('A', 'R')) AS ceiling FROM lineitem GROUP BY 1")
def array_minimum(spark, sf):
    """The lowest base of the layers with some codes, from an array of layers."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("code"), F.col("l_extendedprice").alias("base"))).alias("layers"))
    return rows.select("id", F.array_min(F.transform(F.filter("layers", lambda x: x["code"].isin("A", "R")), lambda x: x["base"])).alias("ceiling"))
