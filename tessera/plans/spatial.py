"""Queries over points, sites and boxes: geographic scalars, radius, nearest, inside, overlap, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import joins, ranking
from .fixtures import KM, PTS, SITES, points, sites
from .registry import query, table

PAIRS = f"pairs AS (SELECT id, site, {KM} AS km FROM pts, sites)"


@query("geo_scalars", f"""WITH {PTS} SELECT id, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2))), 5) AS km,
  round(((degrees(atan2(sin(radians(20 - lon)) * cos(radians(10)), cos(radians(lat)) * sin(radians(10)) - sin(radians(lat)) * cos(radians(10)) * cos(radians(20 - lon)))) + 360) % 360), 5) AS bearing,
  round(least((lon - lat + 720) % 360, 360 - (lon - lat + 720) % 360), 5) AS angle,
  round(ln(tan(pi() / 4 + radians(lat) / 2)), 5) AS my, round((lon + 180) / 360 * 1024, 5) AS tx, round((1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2 * 1024, 5) AS ty,
  round(-abs(elev) * sin(radians(lon)), 5) AS u, round(-abs(elev) * cos(radians(lon)), 5) AS v, round(elev * 1.943844, 5) AS kt, round(elev * 3.28084, 5) AS ft,
  round(floor((lon + 180) / 360 * 1024) * (2 * pi() * 6378137 / 1024) - pi() * 6378137, 3) AS west, round(pi() * 6378137 - (floor((1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2 * 1024) + 1) * (2 * pi() * 6378137 / 1024), 3) AS south FROM pts""")
def geo_scalars(spark, sf):
    lat, lon, elev = F.col("lat"), F.col("lon"), F.col("elev")
    tx, ty = geo.tile_of(lon, lat, 10)
    r = lambda c, n: F.round(c, 5).alias(n)
    return points(spark, sf).select("id", r(geo.haversine(lat, lon, F.lit(10.0), F.lit(20.0)), "km"), r(geo.bearing(lat, lon, F.lit(10.0), F.lit(20.0)), "bearing"), r(geo.angle_between(lon, lat), "angle"), r(geo.mercator_y(lat), "my"), r(tx, "tx"), r(ty, "ty"), r(geo.wind_u(F.abs(elev), lon), "u"), r(geo.wind_v(F.abs(elev), lon), "v"), r(geo.knots(elev), "kt"), r(geo.feet(elev), "ft"), *(F.round(c, 3).alias(n) for c, n in zip(geo.tile_box(F.floor(tx), F.floor(ty), 10), ("west", "south"))))


@query("zoom_levels", f"WITH {PTS} SELECT id, greatest(6, least(14, round_even(log2(512.0 * 360 / (256 * (abs(elev) / 100 + 0.001))), 0)))::INT AS zoom FROM pts")
def zoom_levels(spark, sf):
    return points(spark, sf).select("id", geo.zoom_for(F.lit(0.0), F.abs("elev") / 100 + 0.001, 512, 14).alias("zoom"))


@query("value_codecs", f"""WITH {PTS} SELECT id, abs(cents) % 256 * 256 + id % 256 + (id % 7)::DOUBLE / 256 - 32768 AS terrain, CASE WHEN id % 10 = 9 THEN NULL ELSE round((id % 10) * 0.01 + 273.15, 6) END AS unpacked,
  greatest(-32768, least(32767, round(elev * 1000)))::INT AS tenths, floor((elev + 32768) / 256)::INT AS r, floor((elev + 32768) % 256)::INT AS g, floor((elev - floor(elev)) * 256)::INT AS b FROM pts""")
def value_codecs(spark, sf):
    p = points(spark, sf)
    return p.select("id", geo.elevation_decoded(F.abs("cents") % 256, F.col("id") % 256, F.col("id") % 7).alias("terrain"), F.round(geo.unpacked(F.col("id") % 10, 0.01, 273.15, 9), 6).alias("unpacked"), geo.tenths(F.col("elev") * 100).cast("int").alias("tenths"), *(c.alias(n) for c, n in zip(geo.elevation_encoded(F.col("elev")), "rgb")))


@query("radius_counts", f"WITH {PTS}, {SITES}, {PAIRS} SELECT id, count(*) FILTER (km <= 1500) AS n FROM pairs GROUP BY 1")
def radius_counts(spark, sf):
    return joins.radius_counts(points(spark, sf).select("id", "lat", "lon"), sites(spark, sf), 1500)


@query("nearest_three", f"WITH {PTS}, {SITES}, {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, site) AS rank FROM pairs) SELECT id, site, round(km, 4) AS km, rank FROM r WHERE rank <= 3")
def nearest_three(spark, sf):
    return joins.nearest_k(points(spark, sf).select("id", "lat", "lon"), sites(spark, sf), 3, 2500).withColumn("km", F.round("km", 4))


@query("capture", f"WITH {PTS}, {SITES}, {PAIRS} SELECT id, arg_min(site, km) AS site, round(min(km), 4) AS km FROM pairs WHERE km <= 1000 GROUP BY 1")
def capture(spark, sf):
    return joins.nearest_within(points(spark, sf).select("id", "lat", "lon"), sites(spark, sf), 1000).withColumn("km", F.round("km", 4))


@query("free_points", f"WITH {PTS}, {SITES}, {PAIRS} SELECT id FROM pairs GROUP BY 1 HAVING min(km) > 700")
def free_points(spark, sf):
    return joins.none_within(points(spark, sf).select("id", "lat", "lon"), sites(spark, sf), 700).select("id")


@query("site_scores", f"WITH {PTS}, {SITES}, {PAIRS} SELECT site, count(*) AS captured, round(count(*) + avg(1 - km / 1200) * 0.5, 5) AS score FROM pairs WHERE km <= 1200 GROUP BY 1")
def site_scores(spark, sf):
    return ranking.site_scores(points(spark, sf).select("id", "lat", "lon"), sites(spark, sf), 1200).withColumn("score", F.round("score", 5))


_HOP = "2 * 6371.0 * asin(sqrt(pow(sin(radians(y2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y2)) * pow(sin(radians(x2 - lon) / 2), 2)))"


@query("service_kpis", f"""WITH {PTS}, {SITES}, {PAIRS}, c AS (SELECT id, arg_min(site, km) AS site FROM pairs WHERE km <= 1000 GROUP BY id), p AS (SELECT pts.*, site FROM pts LEFT JOIN c USING (id)),
  a AS (SELECT *, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2 FROM p WINDOW w AS (PARTITION BY nation ORDER BY id)),
  b AS (SELECT *, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2 FROM p WHERE site IS NULL WINDOW w AS (PARTITION BY nation ORDER BY id)),
  r AS (SELECT nation, count(*) AS n, count(*) FILTER (id % 7 = 0) AS nf, count(site) AS red, count(site) FILTER (id % 7 = 0) AS fc, count(DISTINCT site) AS l, sum({_HOP}) AS kb FROM a GROUP BY 1),
  s AS (SELECT nation, sum({_HOP}) AS ka FROM b GROUP BY 1), t AS (SELECT *, coalesce(ka, 0) AS k2, kb / 0.5 + n * 2 AS tb, coalesce(ka, 0) / 0.5 + ((n - red) * 120 + l * 180 + red * 15) / 60 AS ta FROM r LEFT JOIN s USING (nation))
  SELECT nation AS round, red AS redirected, fc AS failed_avoided, round(kb - k2, 2) AS distance_saved_km, round(tb - ta, 1) AS time_saved_min, red - l AS stops_removed, round((n - nf) / (tb / 10), 2) AS productivity_before, round((n - nf + fc) / (ta / 10), 2) AS productivity_after, greatest(0, floor((tb - ta) / (tb / n)))::BIGINT AS extra_capacity FROM t""")
def service_kpis(spark, sf):
    """A round per nation: parcels in order of their ids, those near a site go to it; two minutes drive a kilometre."""
    p = points(spark, sf).select("id", "lat", "lon", "nation")
    captured = joins.nearest_within(p.select("id", "lat", "lon"), sites(spark, sf), 1000).select("id", "site")
    rows = p.join(captured, "id", "left")

    def tour(stops, name):
        w = Window.partitionBy("nation").orderBy("id")
        after = [F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in ("lat", "lon")]
        return stops.withColumn("km", geo.haversine(F.col("lat"), F.col("lon"), *after)).groupBy("nation").agg(F.sum("km").alias(name))

    counts = rows.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 7 == 0).alias("n_failed"), F.count("site").alias("redirected"), F.count_if(F.col("site").isNotNull() & (F.col("id") % 7 == 0)).alias("failed_captured"), F.count_distinct("site").alias("lockers"))
    rounds = counts.join(tour(rows, "km_before"), "nation").join(tour(rows.where("site IS NULL"), "km_after"), "nation", "left").fillna(0.0, ["km_after"])
    rounds = rounds.withColumns({"drive_before": F.col("km_before") / 0.5, "drive_after": F.col("km_after") / 0.5}).withColumnRenamed("nation", "round")
    return ranking.service_kpis(rounds)


_APART = "2 * 6371.0 * asin(sqrt(pow(sin(radians(q.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - c.lon) / 2), 2)))"


@query("greedy_sites", f"""WITH RECURSIVE {PTS}, p(pick, id, lat, lon, score) USING KEY (pick) AS ((SELECT 1, id, lat, lon, cents::DOUBLE FROM pts ORDER BY cents DESC, id LIMIT 1)
  UNION (SELECT (SELECT max(pick) + 1 FROM recurring.p AS z), c.id, c.lat, c.lon, c.cents::DOUBLE FROM pts c WHERE (SELECT max(pick) FROM recurring.p AS y) < 5 AND NOT EXISTS (SELECT 1 FROM recurring.p AS q WHERE {_APART} <= 3000) ORDER BY c.cents DESC, c.id LIMIT 1)) SELECT pick, id, lat, lon, score FROM p""")
def greedy_sites(spark, sf):
    """Best points at least 3000 km apart; each pick needs the one before (tests compare with a loop)."""
    return ranking.greedy_apart(points(spark, sf).select("id", "lat", "lon", F.col("cents").cast("double").alias("score")), "score", 3000, 5)


_BOX = "-60.0 + nation * 5 AS w, -40.0 + nation * 2 AS s, -60.0 + nation * 5 + 12 AS e, -40.0 + nation * 2 + 15 AS n"


@query("points_in_zones", f"WITH {PTS}, z AS (SELECT n_nationkey AS zone, -60.0 + n_nationkey * 5 AS x, -40.0 + n_nationkey * 2 AS y FROM nation) SELECT id, zone FROM pts, z WHERE lon + 0.003 > x AND lat + 0.003 > y AND (lon + 0.003 - x) / 12 + (lat + 0.003 - y) / 15 < 1")
def points_in_zones(spark, sf):
    z = table(spark, sf, "nation").selectExpr("cast(n_nationkey AS bigint) AS zone", "-60.0D + n_nationkey * 5 AS x", "-40.0D + n_nationkey * 2 AS y")
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    rings = z.select("zone", F.array(corner(0.0, 0.0), corner(12.0, 0.0), corner(0.0, 15.0)).alias("ring"))
    moved = points(spark, sf).select("id", (F.col("lon") + 0.003).alias("lon"), (F.col("lat") + 0.003).alias("lat"))
    return joins.points_in_rings(moved, rings, 5.0).select("id", "zone")


@query("ring_areas", "SELECT n_nationkey AS zone, round(12.0 * 15 / 2 * pow(pi() / 180 * 6371000, 2) * cos(radians(-40.0 + n_nationkey * 2)) / 1e6, 3) AS km2 FROM nation")
def ring_areas(spark, sf):
    z = table(spark, sf, "nation").selectExpr("n_nationkey AS zone", "-60.0D + n_nationkey * 5 AS x", "-40.0D + n_nationkey * 2 AS y")
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    return z.select("zone", F.round(geo.ring_area_m2(F.array(corner(0.0, 0.0), corner(12.0, 0.0), corner(0.0, 15.0))) / 1e6, 3).alias("km2"))


_BOXES = "b AS (SELECT s_suppkey AS id, s_suppkey * 37 % 360 - 180.0 AS w, s_suppkey * 53 % 160 - 80.0 AS s, s_suppkey * 37 % 360 - 180.0 + 14 + s_suppkey % 9 AS e, s_suppkey * 53 % 160 - 80.0 + 13 + s_suppkey % 5 AS n FROM supplier)"


def _boxes(spark, sf):
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_suppkey * 37 % 360 - 180.0D AS w", "s_suppkey * 53 % 160 - 80.0D AS s", "s_suppkey * 37 % 360 - 180.0D + 14 + s_suppkey % 9 AS e", "s_suppkey * 53 % 160 - 80.0D + 13 + s_suppkey % 5 AS n")


@query("box_overlaps", f"WITH {_BOXES} SELECT p.id AS a, q.id AS b FROM b p, b q WHERE p.id < q.id AND p.w <= q.e AND q.w <= p.e AND p.s <= q.n AND q.s <= p.n")
def box_overlaps(spark, sf):
    return joins.box_overlaps(_boxes(spark, sf), _boxes(spark, sf), 10.0).where("a < b")


@query("box_predicates", f"WITH {_BOXES} SELECT id, w <= 40 AND e >= -40 AND s <= 30 AND n >= -30 AS overlaps, w >= -40 AND s >= -30 AND e <= 40 AND n <= 30 AS within, w BETWEEN -40 AND 40 AND s BETWEEN -30 AND 30 AS corner FROM b")
def box_predicates(spark, sf):
    own = tuple(F.col(c) for c in "wsen")
    area = tuple(F.lit(float(x)) for x in (-40, -30, 40, 30))
    return _boxes(spark, sf).select("id", geo.boxes_overlap(own, area).alias("overlaps"), geo.box_within(own, area).alias("within"), geo.corner_within(own, area).alias("corner"))


@query("grid_samples", f"WITH {PTS}, g AS (SELECT (n_nationkey * 2)::INT AS row, n_nationkey::INT AS col, n_regionkey AS value FROM nation) SELECT id, value FROM (SELECT id, greatest(0, least(49, floor((60 - lat) / 2)))::INT AS row, greatest(0, least(24, floor((lon + 25) / 2)))::INT AS col FROM pts) LEFT JOIN g USING (row, col)")
def grid_samples(spark, sf):
    grid = table(spark, sf, "nation").selectExpr("cast(n_nationkey * 2 AS int) AS row", "cast(n_nationkey AS int) AS col", "n_regionkey AS value")
    return joins.sample_grid(points(spark, sf), grid, -25.0, 60.0, 2.0, 50, 25).select("id", "value")


@query("dimension_lookup", "SELECT c_custkey AS id, n_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 1")
def dimension_lookup(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 4 <> 1").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return table(spark, sf, "customer").join(n, F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query("lookup_default", "WITH d AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderkey % 11 = 0 GROUP BY 1) SELECT c_custkey AS id, coalesce(n, 0) AS n FROM customer LEFT JOIN d ON c_custkey = id")
def lookup_default(spark, sf):
    d = table(spark, sf, "orders").where("o_orderkey % 11 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").join(d, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


@query("fallback_lookup", """WITH t AS (SELECT 'ABC' || p_partkey AS key, p_size AS size FROM part WHERE p_partkey % 3 = 0), q AS (SELECT p_partkey AS id, 'ABC' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE '' END AS key FROM part)
  SELECT q.id, coalesce(a.size, b.size) AS size FROM q LEFT JOIN t a ON a.key = q.key LEFT JOIN t b ON b.key = regexp_extract(q.key, '^([A-Z]{3}[0-9]{1,4})[A-Z]$', 1)""")
def fallback_lookup(spark, sf):
    part = table(spark, sf, "part")
    t = part.where("p_partkey % 3 = 0").selectExpr("concat('ABC', p_partkey) AS key", "p_size AS size")
    q = part.selectExpr("p_partkey AS id", "concat('ABC', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE '' END) AS key")
    return joins.with_fallback(q, t, "key", F.regexp_extract("key", "^([A-Z]{3}[0-9]{1,4})[A-Z]$", 1), "size").select("id", "size")


@query("transfer_pairs", "WITH s AS (SELECT s_suppkey // 10 AS grp, s_suppkey AS item, s_suppkey % 3 AS line FROM supplier) SELECT p.grp, p.item AS a, q.item AS b FROM s p JOIN s q USING (grp) WHERE p.item < q.item AND p.line <> q.line")
def transfer_pairs(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey div 10 AS grp", "s_suppkey AS item", "s_suppkey % 3 AS line")
    return joins.same_group_pairs(s, "grp", "item", "line")


@query("walking_transfers", f"WITH {SITES}, p AS (SELECT a.site AS a, b.site AS b, a.site_lat AS lat, a.site_lon AS lon, b.site_lat, b.site_lon FROM sites a, sites b WHERE a.site < b.site AND a.site % 5 <> b.site % 5) SELECT a, b, round({KM}, 4) AS km FROM p WHERE {KM} <= 900")
def walking_transfers(spark, sf):
    s = sites(spark, sf)
    left = s.select(F.col("site").alias("id"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))
    return joins.radius_pairs(left, s, 900).where("id < site AND id % 5 <> site % 5").select(F.col("id").alias("a"), F.col("site").alias("b"), F.round("km", 4).alias("km"))


@query("series_override", "WITH live AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier WHERE s_suppkey % 4 = 0), fixed AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN -1.0 END AS v FROM supplier) SELECT id, coalesce(live.v, fixed.v) AS v FROM fixed LEFT JOIN live USING (id) WHERE coalesce(live.v, fixed.v) IS NOT NULL")
def series_override(spark, sf):
    s = table(spark, sf, "supplier")
    live = s.where("s_suppkey % 4 = 0").selectExpr("s_suppkey AS id", "s_acctbal AS v_live")
    fixed = s.selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 3 = 0 THEN -1.0D END AS v_fixed")
    return fixed.join(live, "id", "left").select("id", F.coalesce("v_live", "v_fixed").alias("v")).where("v IS NOT NULL")


_SC = """q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 > 0 THEN p_size::DOUBLE END AS a, p_retailprice AS b FROM part), m AS (SELECT a AS median FROM (SELECT a, row_number() OVER (ORDER BY a) - 1 AS i, count(*) OVER () AS n FROM q WHERE a IS NOT NULL) WHERE i = n // 2),
  r AS (SELECT id, coalesce(a, median) AS a, b FROM q, m), e AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM r), w AS (SELECT id, ((a - la) / (ha - la) * 2 + (b - lb) / (hb - lb)) / 3 AS raw FROM r, e)"""


@query("weighted_scores", f"WITH {_SC} SELECT id, round((raw - (SELECT min(raw) FROM w)) / ((SELECT max(raw) FROM w) - (SELECT min(raw) FROM w)) * 100, 5) AS score FROM w")
def weighted_scores(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 9 > 0 THEN cast(p_size AS double) END AS a", "p_retailprice AS b")
    return ranking.min_max_score(rows, {"a": 2.0, "b": 1.0}).select("id", F.round("score", 5).alias("score"))


@query("even_sample", "WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey FROM r, n WHERE i IN (SELECT (j * n) // 100 FROM (SELECT unnest(range(100)) AS j), n)")
def even_sample(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    ranked = ranking.global_rank(rows, ["o_orderkey"]).withColumn("i", F.col("rank") - 1)
    return ranking.even_sample(ranked, "i", rows.count(), 100).select("o_orderkey")


@query("step_sample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey FROM r WHERE i % 13 = 0 AND i < 13 * 50")
def step_sample(spark, sf):
    ranked = ranking.global_rank(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"]).withColumn("i", F.col("rank") - 1)
    return ranking.step_sample(ranked, "i", 13, 50).select("o_orderkey")


@query("hash_sample", "SELECT event_id FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 37 = 0")
def hash_sample(spark, sf):
    return ranking.hash_sample(table(spark, sf, "events"), "event_id", 37).select("event_id")


@query("seeded_firsts", "WITH r AS (SELECT c_custkey AS id, c_nationkey AS k, md5('7|' || c_custkey) AS h FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h) AS i FROM r) SELECT id, k FROM f WHERE i = 1 ORDER BY h LIMIT 20")
def seeded_firsts(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.md5(F.concat(F.lit("7|"), F.col("c_custkey"))).alias("h"))
    return ranking.first_per(rows, ["k"], ["h"]).orderBy("h").limit(20).select("id", "k")


@query("first_source_wins", "WITH u AS (SELECT user_id, event_id, 1 AS src FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 2 FROM events WHERE event_type <> 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY src, event_id) AS i FROM u) SELECT user_id, event_id, src FROM r WHERE i = 1")
def first_source_wins(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    u = ev.where("event_type = 'click'").withColumn("src", F.lit(1)).unionByName(ev.where("event_type <> 'click'").withColumn("src", F.lit(2)))
    return ranking.first_per(u, ["user_id"], ["src", "event_id"]).select("user_id", "event_id", "src")


@query("latest_per_key", "SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_key(spark, sf):
    return ranking.first_per(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), "event_id"]).select("user_id", "event_id", "ts")


@query("top_three_per_group", "WITH r AS (SELECT c_nationkey AS nation, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT * FROM r WHERE rank <= 3")
def top_three_per_group(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), "c_acctbal")
    return ranking.top_per_group(rows, ["nation"], [F.desc("c_acctbal"), "id"], 3).drop("c_acctbal")


@query("newest_log", "SELECT event_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 40")
def newest_log(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").limit(40).select("event_id", "ts")


@query("paged", "SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer ORDER BY CASE WHEN c_acctbal < 5000 THEN c_acctbal END DESC NULLS LAST, c_name, c_custkey LIMIT 60 OFFSET 100")
def paged(spark, sf):
    """A page by balance, unknown ones (here those of 5,000 and more) last."""
    rows = table(spark, sf, "customer").withColumn("balance", F.when(F.col("c_acctbal") < 5000, F.col("c_acctbal")))
    return ranking.page(rows, [F.desc_nulls_last("balance"), "c_name", "c_custkey"], 100, 60).select("c_custkey", "c_name", "total")


@query("filter_specs", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_name LIKE '%1%' AND c_mktsegment LIKE 'B%' AND c_custkey IS NOT NULL")
def filter_specs(spark, sf):
    specs = [{"column": "c_acctbal", "op": ">=", "value": 1000}, {"column": "c_name", "op": "contains", "value": "1"}, {"column": "c_mktsegment", "op": "starts", "value": "B"}, {"column": "c_custkey", "op": "not_null"}, {"column": "x; DROP", "op": "="}, {"column": "c_name", "op": "like"}]
    return ranking.filtered(table(spark, sf, "customer"), specs, [{"column": "c_name", "dir": "desc"}]).select("c_custkey", "c_name", "c_acctbal")
