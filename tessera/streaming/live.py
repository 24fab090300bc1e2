"""Live traffic and hazard feeds; each works on a batch and, where it says so, on a stream.

Events are (hex, cs, reg, kind, region, lat, lon, alt_baro text, gs, rate, track, squawk, source_rank, ts).  Late rows
beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geo

#: Emergency codes by rank, and altitude bands (lower edges in feet).
EMERGENCY = ("7700", "7600")
BANDS = ((float("-inf"), "<10k"), (10_000, "10-20k"), (20_000, "20-30k"), (30_000, "30-40k"), (40_000, ">40k"))
WATERMARK = "10 minutes"


def altitude(alt_baro: Column) -> Column:
    return F.when(alt_baro == "ground", F.lit(0.0)).otherwise(alt_baro.try_cast("double"))


def altitude_band(feet: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, name in BANDS:
        out = F.when(feet >= low, F.lit(name)).otherwise(out)
    return out


def airborne(events: DataFrame) -> DataFrame:
    """Stateless: drops rows without a position or on the ground, adds the altitude in feet."""
    return events.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.coalesce("alt_baro", F.lit("")) != "ground")).withColumn("feet", altitude(F.col("alt_baro")))


def first_seen(events: DataFrame) -> DataFrame:
    """Batch: one row per aircraft, by source rank and time; rows without an id go."""
    w = Window.partitionBy("hex").orderBy("source_rank", "ts", "lat", "lon")
    return events.where("hex is not null").withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def airline(cs: Column) -> Column:
    """The first three letters of a callsign, if it has as many."""
    letters = F.substring(F.regexp_replace(F.upper(cs), "[^A-Z]", ""), 1, 3)
    return F.when(F.length(letters) == 3, letters)


#: How many airlines and types are told.
MOST = {"airline": 12, "type": 10}


def pulse(events: DataFrame, airlines: list[str], most: dict[str, int] | None = None) -> DataFrame:
    """Batch: facet, name, n: the airborne aircraft, each once, by region, airline (of `airlines`), type and band.

    Only the `most` frequent airlines and types are told (12 and 10), ties by name.
    """
    return counted(first_seen(airborne(events)), airlines, MOST if most is None else most)


def counted(fleet: DataFrame, airlines: list[str], most: dict[str, int]) -> DataFrame:
    """facet, name, n of a fleet, one row for each aircraft."""
    code = airline(F.col("cs"))
    kind = F.upper(F.trim("kind"))
    facets = {"region": F.col("region"), "airline": F.when(code.isin(airlines), code), "type": F.when(kind != "", kind), "band": altitude_band(F.col("feet"))}
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), c.alias("name")) for f, c in facets.items())))
    counts = fleet.select(each.alias("x")).where("x.name is not null").groupBy("x.facet", "x.name").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "name"))
    limit = F.coalesce(*(F.when(F.col("facet") == f, n) for f, n in most.items()), F.lit(2**31 - 1)) if most else F.lit(2**31 - 1)
    return counts.withColumn("_i", place).where(F.col("_i") <= limit).drop("_i")


def summary(fleet: DataFrame, airlines: list[str], regions: list[str], most: dict[str, int] | None = None) -> DataFrame:
    """facet, name, n of a fleet: as `pulse`, with regions and bands that have none, all aircraft (total) and those
    whose `flags` mark them as military (bit 0)."""
    spark = fleet.sparkSession
    counts = counted(fleet, airlines, MOST if most is None else most)
    empty = spark.createDataFrame([("region", r) for r in regions] + [("band", name) for _, name in BANDS], "facet string, name string")
    marked = F.count_if(F.col("flags").bitwiseAND(1) == 1)
    sums = fleet.agg(F.count(F.lit(1)).alias("total"), marked.alias("military")).select(F.explode(F.array(*(F.struct(F.lit(x).alias("facet"), F.lit("all").alias("name"), F.col(x).alias("n")) for x in ("total", "military")))).alias("x")).select("x.*")
    whole = counts.join(F.broadcast(empty), ["facet", "name"], "full").select("facet", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return whole.unionByName(sums)


def superlatives(fleet: DataFrame) -> DataFrame:
    """what (fastest, highest), cs, kind, region, value: the first aircraft with the highest speed and altitude."""
    order = ["source_rank", "ts", "lat", "lon", "hex"]
    told = lambda c: F.coalesce(F.when(F.trim(c) != "", F.upper(F.trim(c))), F.lit("—")).alias(c)
    each = F.explode(F.array(*(F.struct(F.lit(what).alias("what"), value.cast("double").alias("value")) for what, value in (("fastest", F.rint("gs")), ("highest", F.floor("feet"))))))
    exact = F.when(F.col("x.what") == "fastest", F.col("gs")).otherwise(F.col("feet"))
    rows = fleet.select("*", each.alias("x")).where("x.value is not null").withColumn("_v", exact)
    first = F.min_by(F.struct(told("cs"), told("kind"), "region", "x.value"), F.struct(-F.col("_v"), *order))
    return rows.groupBy("x.what").agg(first.alias("b")).select("what", "b.*")


FLEET = "hex string, cs string, kind string, region string, feet double, gs double, flags int, lat double, lon double, source_rank int, ts timestamp"


def fleet_changes(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Stream: the rows of FLEET that join the fleet (n = 1) and leave it (n = -1).

    The state of an aircraft is its row, the first by source and time; a better row replaces it, and one that isn't
    heard of for `gap_minutes` (by the watermark) leaves.  The sum of n by row is the fleet, and `summary` and
    `superlatives` of that are what a batch over the same events gives.
    """
    names = [f.split()[0] for f in FLEET.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, *kept[1:], -1)], columns=[*names, "n"])
            return
        rows = pd.concat(list(frames))
        first = rows.sort_values(["source_rank", "ts", "lat", "lon"], na_position="first").iloc[0]
        new = tuple(None if pd.isna(first[c]) else first[c].to_pydatetime() if c == "ts" else first[c].item() if hasattr(first[c], "item") else first[c] for c in names)
        place = lambda row: (row[9] is not None, row[9] or 0, row[10], row[7], row[8])
        changed = kept is None or place(new) < place(kept)
        state.update(new if changed else kept)
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + gap_minutes * 60_000)
        if changed:
            out = [(*new, 1)] if kept is None else [(*kept, -1), (*new, 1)]
            yield pd.DataFrame(out, columns=[*names, "n"])

    rows = airborne(events).where("hex is not null").withWatermark("ts", WATERMARK).select(*names)
    return rows.groupBy("hex").applyInPandasWithState(step, f"{FLEET}, n long", FLEET, "append", GroupStateTimeout.EventTimeTimeout)


def fleet_of(changes: DataFrame) -> DataFrame:
    """The fleet after all `changes`: rows that joined and haven't left."""
    names = [f.split()[0] for f in FLEET.split(", ")]
    return changes.groupBy(*names).agg(F.sum("n").alias("n")).where("n > 0").drop("n")


def pulse_stream(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Stream: distinct aircraft of each tumbling window by band of their highest altitude; append mode."""
    per = airborne(events).withWatermark("ts", WATERMARK).groupBy(F.window("ts", window), "hex").agg(F.max("feet").alias("feet"))
    return per.groupBy("window", altitude_band(F.col("feet")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def emergencies(events: DataFrame) -> DataFrame:
    """Batch or stream: one row per aircraft that has a position and an emergency code; in a batch its first code by
    rank and then its first row, in a stream its first row within the watermark.  `label` names it."""
    rows = events.where(F.col("squawk").isin(*EMERGENCY) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    named = [F.when(F.trim(c) != "", F.trim(c)) for c in ("cs", "reg")]
    rows = rows.withColumn("label", F.coalesce(*named, F.upper("hex")))
    if events.isStreaming:
        return rows.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["hex"])
    w = Window.partitionBy("hex").orderBy(F.desc("squawk"), "ts", "lat", "lon")
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Batch or stream: activity of an id without a pause longer than `gap`."""
    rows = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def phase(events: DataFrame, lat: float, lon: float) -> DataFrame:
    """Batch or stream, stateless: ground, arrival, departure or overhead as seen from an airport, and minutes to go.

    Below 20,000 ft a flight arrives if it climbs less than 200 ft/min on a track within 55 degrees of the field, and
    departs if it climbs more than 300 ft/min within 70 degrees of the way out.  The time to go takes 80 kt at least.
    """
    here, field = (F.col("lat"), F.col("lon")), (F.lit(lat), F.lit(lon))
    nm = F.round(geo.haversine(*here, *field) / geo.KM_PER_NM, 1)
    rate, feet = F.coalesce("rate", F.lit(0.0)), altitude(F.col("alt_baro"))
    low = (feet < 20_000) & F.col("track").isNotNull()
    arrives = low & (rate < 200) & (geo.angle_between(F.col("track"), geo.bearing(*here, *field)) <= 55)
    departs = low & (rate > 300) & (geo.angle_between(F.col("track"), geo.bearing(*field, *here)) <= 70)
    kind = F.when(F.col("alt_baro") == "ground", "ground").when(arrives, "arrival").when(departs, "departure").otherwise("overhead")
    speed = F.greatest(F.when(F.col("gs") > 0, F.col("gs")).otherwise(F.lit(80.0)), F.lit(80.0))
    eta = F.when(kind == "arrival", F.rint(nm / speed * 60).cast("int"))
    return events.where("lat is not null and lon is not null").withColumn("nm", nm).withColumn("phase", kind).withColumn("eta_min", eta)


def strong_quakes(quakes: DataFrame, now: Column, least: float = 2.5) -> DataFrame:
    """Batch or stream, stateless: magnitude, depth and age in hours (0 at least), all to one place."""
    age = F.greatest((F.unix_timestamp(now) - F.unix_timestamp("ts")) / 3600, F.lit(0.0))
    return quakes.where(F.col("mag") >= least).withColumn("mag", F.round("mag", 1)).withColumn("depth", F.round("depth", 1)).withColumn("age_h", F.round(age, 1))


def last_geometry(events: DataFrame, per_kind: int = 120) -> DataFrame:
    """Each event at its last place, the newest of each kind."""
    rows = events.withColumn("geom", F.element_at("geometry", -1)).drop("geometry")
    w = Window.partitionBy("kind").orderBy(F.desc("geom.ts"), "event_id")
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= per_kind).drop("_i")


#: The event categories that are told, and how many of a kind at most.
EVENT_KINDS = {"Wildfires": "wildfires", "Severe Storms": "storms", "Volcanoes": "volcanoes", "Sea and Lake Ice": "ice"}
EVENT_MOST = {"wildfires": 120}


def event_groups(events: DataFrame) -> DataFrame:
    """kind, event_id, title, category, lat, lon: natural events (seq, event_id, title, categories array<string>,
    geometry array<struct<type, coordinates as JSON>>) at their last observed place, by the kind of their first category.

    The place is a point or the first corner of a polygon's first ring; events of other kinds, and those whose last
    geometry gives no place, go.  Of kinds in EVENT_MOST only the first by `seq` are told.
    """
    category = F.get("categories", F.lit(0))
    kind = F.coalesce(*(F.when(category == c, k) for c, k in EVENT_KINDS.items()))
    last = F.when(F.size("geometry") > 0, F.element_at("geometry", -1))
    at = lambda i: F.coalesce(*(F.when(last["type"] == t, F.get_json_object(last["coordinates"], f"$[{path}{i}]")) for t, path in (("Point", ""), ("Polygon", "0][0][")))).try_cast("double")
    rows = events.select("seq", "event_id", F.coalesce("title", F.lit("")).alias("title"), category.alias("category"), kind.alias("kind"), at(1).alias("lat"), at(0).alias("lon")).where("kind is not null and lat is not null and lon is not null")
    capped = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in EVENT_MOST.items()), F.lit(2**31 - 1))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("seq", "event_id"))
    few = rows.where(F.col("kind").isin(*EVENT_MOST)).withColumn("_i", place).where(F.col("_i") <= capped).drop("_i")
    return rows.where(~F.col("kind").isin(*EVENT_MOST)).unionByName(few).drop("seq")


def cover_circles(searches: DataFrame, radius_nm: float, each_nm: float = 250.0) -> DataFrame:
    """For each search (id, lat, lon), the centres of circles of `each_nm` that cover a circle of `radius_nm` (a square
    lattice): id, lat, lon."""
    step = each_nm * 2**0.5
    n = int(radius_nm // step) + 1
    places = [(i * step, j * step) for i in range(-n, n + 1) for j in range(-n, n + 1) if ((i * step) ** 2 + (j * step) ** 2) ** 0.5 <= radius_nm + each_nm]
    off = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in places))).alias("o")
    y = F.col("lat") + F.col("o.dy") / 60
    return searches.select("id", "lat", "lon", off).select("id", y.alias("lat"), (F.col("lon") + F.col("o.dx") / (60 * F.cos(F.radians(y)))).alias("lon"))


def flight_candidates(events: DataFrame, airlines: DataFrame, routes: DataFrame, n: int) -> DataFrame:
    """Airborne at 10,000 ft or more, with an exact callsign (three letters, one to four digits) of a known airline
    (airline, iata) and a known route (cs, origin, destination): one row per flight, the first n by source and time."""
    form = "^([A-Z]{3})([0-9]{1,4})$"
    cs = F.upper(F.trim("cs"))
    rows = airborne(events).withColumn("cs", cs).where((F.col("feet") >= 10_000) & F.col("cs").rlike(form))
    rows = rows.withColumn("airline", F.regexp_extract("cs", form, 1)).join(airlines.select("airline", "iata"), "airline")
    rows = rows.withColumn("flight", F.concat("iata", F.regexp_extract("cs", form, 2)))
    w = Window.partitionBy("flight").orderBy("source_rank", "ts", "hex")
    once = rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").join(routes.select("cs", F.concat_ws(" > ", "origin", "destination").alias("route")), "cs")
    return once.orderBy("source_rank", "ts", "flight").limit(n).select("flight", "cs", "hex", "feet", "route")


#: What lies under the points of the wind grid, by longitude, in the north and in the south.
NORTH = {-120: "the N Pacific", -90: "North America", -60: "the N Atlantic", -30: "the N Atlantic", 0: "W Europe", 30: "E Europe", 60: "Central Asia", 90: "Asia", 120: "E Asia", 150: "the NW Pacific"}
SOUTH = {-120: "the S Pacific", -90: "South America", -60: "the S Atlantic", -30: "the S Atlantic", 0: "the S Atlantic", 30: "southern Africa", 60: "the Indian Ocean", 90: "the Indian Ocean", 120: "Australia", 150: "the S Pacific"}


def wind_region(lat: Column, lon: Column) -> Column:
    """The region of a point of the wind grid, or the band it lies in."""
    named = lambda table: F.coalesce(*(F.when(lon == x, name) for x, name in table.items()))
    return F.when(lat >= 0, F.coalesce(named(NORTH), F.lit("the northern band"))).otherwise(F.coalesce(named(SOUTH), F.lit("the southern band")))
