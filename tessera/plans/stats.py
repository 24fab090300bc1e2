"""Queries over values and time: quantiles, histograms, superlatives, series, documents, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import joins, ranking
from .fixtures import PIXELS, PTS, pixels, points
from .registry import query, table

CENTS = "cast(round({} * 100) AS bigint)"


@query("weighted_median", f"""WITH {PTS}, v AS (SELECT nation, elev, sum(greatest(cents, 1)) AS w FROM pts GROUP BY 1, 2), r AS (SELECT nation, elev, sum(w) OVER (PARTITION BY nation ORDER BY elev) AS run, sum(w) OVER (PARTITION BY nation) AS whole FROM v)
  SELECT nation, min(elev) AS weighted_median FROM r WHERE run * 2 >= whole GROUP BY 1""")
def weighted_median(spark, sf):
    return agg.weighted_median(points(spark, sf).withColumn("w", F.greatest("cents", F.lit(1))), "elev", "w", ["nation"])


@query("weighted_median_of_all", f"WITH {PTS}, v AS (SELECT elev, sum(greatest(cents, 1)) AS w FROM pts GROUP BY 1), r AS (SELECT elev, sum(w) OVER (ORDER BY elev) AS run, sum(w) OVER () AS whole FROM v) SELECT min(elev) AS weighted_median FROM r WHERE run * 2 >= whole")
def weighted_median_of_all(spark, sf):
    return agg.weighted_median(points(spark, sf).withColumn("w", F.greatest("cents", F.lit(1))), "elev", "w")


@query("histogram_equal_width", f"""WITH {PTS}, e AS (SELECT min(elev) AS lo, max(elev) AS hi FROM pts), c AS (SELECT least(floor((elev - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM pts, e GROUP BY 1)
  SELECT b.bin, round(lo + (hi - lo) * b.bin / 20, 6) AS left_edge, round(lo + (hi - lo) * (b.bin + 1) / 20, 6) AS right_edge, coalesce(n, 0) AS n FROM (SELECT unnest(range(20))::INT AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""")
def histogram_equal_width(spark, sf):
    return agg.histogram(points(spark, sf), "elev", 20).withColumns({c: F.round(c, 6) for c in ("left_edge", "right_edge")})


@query("histogram_pixels", f"""WITH {PIXELS}, e AS (SELECT min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM pixels), c AS (SELECT least(floor((value - lo) / (hi - lo) * 64), 63)::INT AS bin, count(*) AS n FROM pixels, e GROUP BY 1)
  SELECT b.bin, round(lo + (hi - lo) * b.bin / 64, 6) AS left_edge, round(lo + (hi - lo) * (b.bin + 1) / 64, 6) AS right_edge, coalesce(n, 0) AS n FROM (SELECT unnest(range(64))::INT AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""")
def histogram_pixels(spark, sf):
    return agg.histogram(pixels(spark, sf), "value", 64, widen=True).withColumns({c: F.round(c, 6) for c in ("left_edge", "right_edge")})


@query("band_stats", f"""WITH {PTS} SELECT nation, count(elev) AS n, 0::BIGINT AS missing, min(elev) AS low, max(elev) AS high, round(avg(elev), 6) AS mean, round(stddev_pop(elev), 6) AS std,
  round(quantile_cont(elev, 0.5), 6) AS median, round(quantile_cont(elev, 0.02), 6) AS p2, round(quantile_cont(elev, 0.98), 6) AS p98 FROM pts GROUP BY 1""")
def band_stats(spark, sf):
    return agg.band_stats(points(spark, sf), ["nation"], "elev").withColumns({c: F.round(c, 6) for c in ("mean", "std", "median", "p2", "p98")})


@query("median_of_cells", f"WITH {PTS}, c AS (SELECT cell // 4096 AS cell, nation, avg(cents) AS v FROM pts GROUP BY 1, 2) SELECT nation, round(median(v), 6) AS median FROM c GROUP BY 1")
def median_of_cells(spark, sf):
    cells = points(spark, sf).groupBy(F.expr("cell div 4096").alias("cell"), "nation").agg(F.avg("cents").alias("v"))
    return cells.groupBy("nation").agg(F.round(F.median("v"), 6).alias("median"))


for _t, _name in ((0.5, "upper_median"), (0.95, "floor_p95")):

    def _quantile(spark, sf, t=_t):
        return agg.floor_quantile(points(spark, sf), ["nation"], "cents", t)

    query(_name, f"WITH {PTS}, r AS (SELECT nation, cents, row_number() OVER (PARTITION BY nation ORDER BY cents) - 1 AS i, count(*) OVER (PARTITION BY nation) AS n FROM pts) SELECT nation, cents AS quantile FROM r WHERE i = least(floor(n * {_t}), n - 1)")(_quantile)


@query("top_counts", "SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, key LIMIT 15")
def top_counts(spark, sf):
    return agg.top_n(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "key"), "key", 15)


@query("superlatives", "SELECT o_orderpriority AS kind, arg_max(o_orderkey, (round(o_totalprice * 100)::BIGINT * 100000000 - o_orderkey)) AS o_orderkey, max(round(o_totalprice * 100)::BIGINT) AS cents FROM orders GROUP BY 1")
def superlatives(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), "o_orderkey", F.expr(CENTS.format("o_totalprice")).alias("cents"))
    return agg.superlative(rows, ["kind"], "cents", "o_orderkey", ["o_orderkey", "cents"])


@query("day_histogram", "SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 500")
def day_histogram(spark, sf):
    return agg.day_histogram(table(spark, sf, "events"), "ts")


@query("daily_extremes", "SELECT event_type, ts::DATE AS day, max(value - 273.15) AS tmax, min(value - 273.15) AS tmin, round(avg(value - 273.15), 6) AS tmean FROM events GROUP BY 1, 2")
def daily_extremes(spark, sf):
    c = F.col("value") - 273.15
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max(c).alias("tmax"), F.min(c).alias("tmin"), F.round(F.avg(c), 6).alias("tmean"))


@query("annual_totals", "WITH s AS (SELECT year(o_orderdate)::INT AS period, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total FROM orders WHERE o_totalprice > 100000 AND year(o_orderdate) % 2 = 0 GROUP BY 1) SELECT y::INT AS period, coalesce(total, 0) AS total FROM (SELECT unnest(range(1990, 2001)) AS y) LEFT JOIN s ON y = period")
def annual_totals(spark, sf):
    rows = table(spark, sf, "orders").where("o_totalprice > 100000 AND year(o_orderdate) % 2 = 0")
    return agg.per_period(rows, F.year("o_orderdate"), F.expr(CENTS.format("o_totalprice")), 1990, 2000)


@query("range_kpis", """WITH y AS (SELECT c_nationkey AS nation, year(o_orderdate)::INT AS y, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1993 AND 1996 GROUP BY 1, 2)
  SELECT nation, sum(c)::BIGINT AS cumulative, arg_max(y, c * 10000 - y) AS worst_year, round(100.0 * max(c) / sum(c), 6) AS worst_percent FROM y GROUP BY 1""")
def range_kpis(spark, sf):
    rows = table(spark, sf, "orders").where("year(o_orderdate) BETWEEN 1993 AND 1996").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
    y = rows.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("y")).agg(F.sum(F.expr(CENTS.format("o_totalprice"))).alias("c"))
    return y.groupBy("nation").agg(F.sum("c").alias("cumulative"), F.max_by("y", F.struct("c", -F.col("y"))).alias("worst_year"), F.round(F.try_divide(F.max("c") * 100, F.sum("c")), 6).alias("worst_percent"))


@query("catalog_summary", "SELECT n_name AS park, count(*) AS n, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def catalog_summary(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    return rows.join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("park"), "n", "first", "last")


@query("cumulative_curve", f"WITH {PTS} SELECT l::DOUBLE / 8 AS level, count(elev) AS n FROM (SELECT unnest(range(41)) AS l) LEFT JOIN pts ON elev <= l::DOUBLE / 8 GROUP BY 1")
def cumulative_curve(spark, sf):
    return agg.cumulative_curve(points(spark, sf), "elev", [i / 8 for i in range(41)])


@query("calendar_axis", """WITH a AS (SELECT ts::DATE AS day, count(*) AS images FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT ts::DATE AS day, max(value) AS wind FROM events WHERE event_type <> 'view' GROUP BY 1), s AS (SELECT min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events)
  SELECT d::DATE AS day, coalesce(images, 0) AS images, coalesce(wind, 0) AS wind FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM s) LEFT JOIN a ON a.day = d::DATE LEFT JOIN b ON b.day = d::DATE""")
def calendar_axis(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    images = ev.where("event_type = 'view'").groupBy("day").agg(F.count(F.lit(1)).alias("images"))
    wind = ev.where("event_type <> 'view'").groupBy("day").agg(F.max("value").alias("wind"))
    axis = ev.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return axis.join(images, "day", "left").join(wind, "day", "left").select("day", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("wind", F.lit(0.0)).alias("wind"))


@query("mean_of_columns", "SELECT l_orderkey, l_linenumber, round((coalesce(CASE WHEN l_discount > 0.05 THEN l_quantity END, 0) + l_tax) / (1 + (l_discount > 0.05)::INT), 6) AS mean FROM lineitem")
def mean_of_columns(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_discount") > 0.05, F.col("l_quantity")))
    return rows.select("l_orderkey", "l_linenumber", F.round(agg.mean_of("q", "l_tax"), 6).alias("mean"))


@query("extent", f"WITH {PTS} SELECT nation, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n, round((min(lon) + max(lon)) / 2, 6) AS cx, round((min(lat) + max(lat)) / 2, 6) AS cy FROM pts GROUP BY 1")
def extent(spark, sf):
    box = points(spark, sf).groupBy("nation").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    return box.withColumn("cx", F.round(F.expr("(w + e) / 2"), 6)).withColumn("cy", F.round(F.expr("(s + n) / 2"), 6))


_LIST = "files AS (SELECT url AS path, length(html)::BIGINT AS size FROM pages)"


@query("prefix_roll_up", f"WITH {_LIST}, p AS (SELECT string_split(path, '/') AS a, size FROM files), x AS (SELECT array_to_string(a[1:i], '/') AS prefix, size FROM (SELECT a, size, unnest(range(1, len(a))) AS i FROM p)) SELECT prefix, sum(size)::BIGINT AS bytes, count(*) AS files FROM x GROUP BY 1")
def prefix_roll_up(spark, sf):
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("size"))
    return agg.prefix_roll_up(files, "path", "size")


_ENTRIES = "e AS (SELECT DISTINCT array_to_string(string_split(url, '/')[1:3 + page_id % 3], '/') AS path FROM pages)"


def _entries(spark, sf):
    return table(spark, sf, "pages").select(F.array_join(F.slice(F.split("url", "/"), F.lit(1), (F.col("page_id") % 3 + 3).cast("int")), "/").alias("path")).distinct()


@query("outermost_entries", f"WITH {_ENTRIES} SELECT path FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE starts_with(e.path, o.path || '/'))")
def outermost_entries(spark, sf):
    return agg.outermost(_entries(spark, sf), "path")


@query("closest_ancestor", f"WITH {_ENTRIES} SELECT e.path, arg_max(o.path, length(o.path)) AS ancestor FROM e JOIN e o ON starts_with(e.path, o.path || '/') GROUP BY 1")
def closest_ancestor(spark, sf):
    return agg.closest_ancestor(_entries(spark, sf), "path")


@query("document_totals", """WITH n AS (SELECT l_orderkey AS doc, sum(l_quantity * l_extendedprice) AS net FROM lineitem GROUP BY 1)
  SELECT doc, round((net - CASE WHEN doc % 2 = 0 THEN net * 10 / 100 ELSE 10 END) * 1.2 + 5, 2) AS total FROM n""")
def document_totals(spark, sf):
    docs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))).alias("items"))
    total = agg.document_total("items", F.lit(10.0), F.col("doc") % 2 == 0, F.lit(20.0), F.lit(5.0))
    return docs.select("doc", F.round(total, 2).alias("total"))


@query("next_numbers", "SELECT o_custkey AS client, lpad((max(o_orderkey % 10000) + 1)::VARCHAR, 4, '0') AS next FROM orders GROUP BY 1")
def next_numbers(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("client"), F.concat(F.lit("INV-"), F.col("o_custkey"), F.lit("-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("number"))
    return agg.next_number(rows, "client", "number")


@query("client_summary", "SELECT o_custkey AS client, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def client_summary(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest")).orderBy(F.desc("latest"), "client")


@query("distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def distinct_counts(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("user_id").alias("users"), F.to_date("ts").alias("days"))
    return agg.distinct_counts(rows, ["event_type"], ["users", "days"])


_DAILY = "d AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1, 2)"


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


@query("rolling_week", f"WITH {_DAILY} SELECT event_type, day, round(avg(v) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS rolling FROM d")
def rolling_week(spark, sf):
    return ranking.rolling_mean(_daily(spark, sf), ["event_type"], "day", "v", 7).select("event_type", "day", F.round("rolling", 6).alias("rolling"))


_SERIES = "s AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS day, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE AS v FROM orders GROUP BY 1, 2)"


def _series(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.expr(CENTS.format("o_totalprice"))).cast("double").alias("v"))


@query("calendar_deviation", f"WITH {_SERIES} SELECT series, day, round(v - avg(v) OVER (PARTITION BY series, month(day), day(day)), 2) AS deviation FROM s")
def calendar_deviation(spark, sf):
    return ranking.calendar_deviation(_series(spark, sf), ["series"], "day", "v").select("series", "day", F.round("deviation", 2).alias("deviation"))


@query("day_readout", f"WITH {_SERIES} SELECT month(day)::INT AS m, day(day)::INT AS d, min(v) AS low, round(avg(v), 4) AS mean, max(v) AS high FROM s WHERE year(day) IN (1993, 1994, 1996) GROUP BY 1, 2")
def day_readout(spark, sf):
    return _series(spark, sf).where("year(day) IN (1993, 1994, 1996)").groupBy(F.month("day").alias("m"), F.dayofmonth("day").alias("d")).agg(F.min("v").alias("low"), F.round(F.avg("v"), 4).alias("mean"), F.max("v").alias("high"))


@query("as_of_rate", """WITH r AS (SELECT o_custkey % 5 AS pair, o_orderdate::DATE AS day, max(o_orderkey) AS rate FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2), q AS (SELECT o_orderkey AS id, o_custkey % 5 AS pair, o_orderdate::DATE AS day FROM orders)
  SELECT id, (SELECT arg_max(rate, day) FROM r WHERE r.pair = q.pair AND r.day <= q.day) AS rate FROM q""")
def as_of_rate(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("pair"), F.to_date("o_orderdate").alias("day"))
    rates = q.where("id % 3 = 0").groupBy("pair", "day").agg(F.max("id").alias("rate"))
    return joins.as_of(q, rates, ["pair"], "day", "rate", F.trunc("day", "month")).select("id", "rate")


@query("path_costs", """WITH s AS (SELECT o_custkey AS route, o_orderkey AS i, o_orderkey % 25 AS stop FROM orders), h AS (SELECT route, stop AS a, coalesce(lead(stop) OVER (PARTITION BY route ORDER BY i), first_value(stop) OVER (PARTITION BY route ORDER BY i)) AS b FROM s)
  SELECT route, CASE WHEN count(*) FILTER (a = 7 AND b > 20) = 0 THEN sum(abs(a - b) + 1)::BIGINT END AS cost, count(*) AS hops, count(*) FILTER (a = 7 AND b > 20) AS unpriced FROM h GROUP BY 1""")
def path_costs(spark, sf):
    stops = table(spark, sf, "orders").select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 25).alias("stop"))
    ends = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("b"))
    costs = ends.where("NOT (a = 7 AND b > 20)").withColumn("cost", F.abs(F.col("a") - F.col("b")) + 1)
    return ranking.path_cost(stops, costs, ["route"], "i", "stop")


@query("legs", """WITH h AS (SELECT user_id AS trip, event_id AS i, CASE WHEN event_id % 3 = 0 OR event_id % 10 = 1 THEN NULL ELSE event_id * 7 // 31 % 2 END AS line, event_id % 50 AS cost FROM events),
  w AS (SELECT *, last_value(line IGNORE NULLS) OVER (PARTITION BY trip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, first_value(line IGNORE NULLS) OVER (PARTITION BY trip ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS comes,
    row_number() OVER p > 1 AND lag(line) OVER p IS NULL AS again FROM h WINDOW p AS (PARTITION BY trip ORDER BY i)),
  k AS (SELECT * FROM w WHERE line IS NOT NULL OR (NOT again AND coalesce(was <> comes, true))),
  g AS (SELECT *, sum(CASE WHEN line IS NOT NULL AND coalesce(was = line, false) THEN 0 ELSE 1 END) OVER (PARTITION BY trip ORDER BY i) AS leg FROM k)
  SELECT trip, leg::BIGINT AS leg, line, count(*) AS hops, sum(cost)::BIGINT AS cost, min(i) AS first FROM g GROUP BY 1, 2, 3""")
def legs(spark, sf):
    hops = table(spark, sf, "events").selectExpr("user_id AS trip", "event_id AS i", "CASE WHEN event_id % 3 = 0 OR event_id % 10 = 1 THEN NULL ELSE event_id * 7 div 31 % 2 END AS line", "event_id % 50 AS cost")
    return ranking.legs(hops, ["trip"], "i", "line", "cost")


@query("thinned_paths", "WITH r AS (SELECT user_id, event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id FROM r WHERE i % 4 = 0 OR i = n - 1")
def thinned_paths(spark, sf):
    return ranking.thinned(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 4)


@query("sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def sessions(spark, sf):
    from ..streaming import live

    return live.sessions(table(spark, sf, "events"), "user_id", "6 hours")


@query("global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY round(o_totalprice * 100)::BIGINT, o_orderkey) AS rank FROM orders")
def global_rank(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(CENTS.format("o_totalprice")).alias("cents"))
    return ranking.global_rank(rows, ["cents", "o_orderkey"]).select("o_orderkey", "rank")


