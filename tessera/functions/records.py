"""Rules for single records: weather, runways, airlines, lines, brands, categories, nested settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weather codes and what they mean.
WEATHER = {
    0: "Clear skies", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Depositing rime fog", 51: "Light drizzle", 53: "Drizzle", 55: "Dense drizzle", 56: "Freezing drizzle", 57: "Freezing drizzle",
    61: "Light rain", 63: "Rain", 65: "Heavy rain", 66: "Freezing rain", 67: "Freezing rain", 71: "Light snow", 73: "Snow", 75: "Heavy snow", 77: "Snow grains", 80: "Light showers", 81: "Showers", 82: "Violent showers",
    85: "Snow showers", 86: "Snow showers", 95: "Thunderstorm", 96: "Thunderstorm, hail", 99: "Thunderstorm, heavy hail",
}
#: Brands that are known by a part of a name, in the order in which they are looked for.
BRANDS = ["starbucks", "dutch bros", "summer moon", "coffee bean", "caffe medici", "caffé medici", "black rock", "houndstooth", "jo's", "epoch", "ruta maya", "dunkin", "scooter", "peet", "panera", "mcdonald", "tim horton", "allegro", "caribou", "biggby", "stumptown", "blue bottle", "philz", "la colombe"]
#: Kilometres per mile of visibility, metres per degree.
KM_PER_MILE, METRES_PER_DEGREE = 1.609, 111_320.0


def labelled(code: Column, table: Mapping[int, str] = WEATHER) -> Column:
    """The label of a code, null for an unknown one."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), code.cast("int"))


def ceiling(layers: Column) -> Column:
    """The lowest base of the broken and overcast layers (array of struct cover, base)."""
    return F.array_min(F.transform(F.filter(layers, lambda x: x["cover"].isin("BKN", "OVC") & x["base"].isNotNull()), lambda x: x["base"]))


def visibility_km(text: Column) -> Column:
    """Whole kilometres of a visibility in miles, from a number or a text that starts with one ("10+")."""
    return F.rint(F.regexp_extract(text.cast("string"), "^([0-9.]+)", 1).try_cast("double") * KM_PER_MILE).cast("int")


def age_minutes(now: Column, observed: Column) -> Column:
    """Whole minutes since a time in seconds, 0 at least."""
    return F.greatest(F.rint((now - observed) / 60), F.lit(0)).cast("int")


def runway_winds(winds: DataFrame, runways: DataFrame, by: str) -> DataFrame:
    """by, pair, ident, heading, head_kt, cross_kt, best: the end of each runway with the most head wind, and whether
    its runway is the best.

    winds: by, wind_dir, wind_kt (nulls count as calm); runways: by, pair ("09L/27R"), at.  Of equal ends and runways
    the first counts (`at` orders the runways).
    """
    ends = runways.select(by, "pair", "at", F.posexplode(F.split("pair", "/")).alias("_i", "ident")).withColumn("_n", F.regexp_extract("ident", "^([0-9]+)", 1)).where("_n <> ''")
    ends = ends.withColumn("heading", F.col("_n").cast("int") * 10 % 360).join(winds, by, "left")
    turn = F.radians(F.col("wind_dir") - F.col("heading"))
    ends = ends.withColumn("_h", F.coalesce(F.col("wind_kt") * F.cos(turn), F.lit(0.0))).withColumn("_c", F.coalesce(F.abs(F.col("wind_kt") * F.sin(turn)), F.lit(0.0)))
    best = F.max_by(F.struct("ident", "heading", F.rint("_h").cast("int").alias("head_kt"), F.rint("_c").cast("int").alias("cross_kt")), F.struct("_h", -F.col("_i")))
    per = ends.groupBy(by, "pair", "at").agg(best.alias("e")).select(by, "pair", "at", "e.*")
    top = per.groupBy(by).agg(F.max_by("pair", F.struct("head_kt", -F.col("at"))).alias("_best"))
    return per.join(top, by).select(by, "pair", "ident", "heading", "head_kt", "cross_kt", (F.col("pair") == F.col("_best")).alias("best"))


def fleet_type(km: Column, rules: Column) -> Column:
    """The aircraft type that an airline's rules give for a route, else a usual type by length.

    rules: struct of turboprop_below, narrowbody_below (km, null for none) and of the types turboprop, short, medium,
    long, ultra_long; null for an airline without rules.  Narrow bodies never fly 7,000 km or more.
    """
    far = F.coalesce(rules["long"], rules["medium"])
    below = F.coalesce(rules["turboprop_below"], F.lit(0))
    own = F.when((km < below) & rules["turboprop"].isNotNull(), rules["turboprop"]).when(km < 1200, rules["short"])
    own = own.when(km < F.least(F.greatest(F.coalesce(rules["narrowbody_below"], F.lit(0)), F.lit(1200)), F.lit(7000)), rules["medium"]).when(km < 7000, far).otherwise(F.coalesce(rules["ultra_long"], far))
    usual = F.when(km < 1500, "A320").when(km < 3500, "B738").when(km < 9000, "B789").otherwise("B77W")
    return F.when(km.isNotNull(), F.coalesce(F.when(rules.isNotNull(), own), usual))


def flight_minutes(km: Column, turboprop: Column, jet_kmh: float, turboprop_kmh: float) -> Column:
    """Whole minutes at the mean speed of the class, and 25 for climb and descent."""
    return F.floor(km / F.when(turboprop, turboprop_kmh).otherwise(jet_kmh) * 60 + 25).cast("int")


def line_category(kind: Column, operator_kind: Column, name: Column, operator: Column, street: Sequence[str]) -> Column:
    """0 high-speed, 4 street and monorail (kinds in `street`), 2 underground or other public, 1 national, 3 private."""
    under = operator.contains("地下鉄") | operator.contains("メトロ") | name.contains("地下鉄")
    return F.when(operator_kind == "1", 0).when(kind.isin(*street), 4).when(under | (operator_kind == "3"), 2).when(operator_kind == "2", 1).otherwise(3)


def brand(name: Column) -> Column:
    """A known brand's name in title case, else the name up to `#`; "(unknown)" without a name."""
    plain = F.trim(F.regexp_replace(name, "(?s)#.*$", ""))
    out = None
    for b in BRANDS:
        title = F.lit(b.title().replace("Mcdonald", "McDonald"))
        out = F.when(F.lower(plain).contains(b), title) if out is None else out.when(F.lower(plain).contains(b), title)
    return F.when(F.coalesce(name, F.lit("")) == "", "(unknown)").otherwise(out.otherwise(plain))


def in_category(categories: Column, part: str) -> Column:
    """Whether a struct of categories has `part` anywhere in its text; a park is no parking."""
    text = F.lower(F.to_json(categories))
    found = text.contains(part)
    return found & ~text.contains("parking") if part == "park" else found


def large_enough(w: Column, s: Column, e: Column, n: Column, least_m2: float) -> Column:
    """Whether a box in degrees has an area of `least_m2` or more, measured at its middle latitude."""
    per_lon = METRES_PER_DEGREE * F.cos(F.radians((s + n) / 2))
    return (e - w) * (n - s) >= least_m2 / (per_lon * METRES_PER_DEGREE)


def densified(lines: DataFrame, step_m: float = 40.0) -> DataFrame:
    """id, k, x, y: points at equal distances along each line (id, points array<struct x, y> in degrees), about
    `step_m` apart at the line's middle latitude, both ends included; rounded to five places."""
    size = F.size("points")
    hop = lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))
    rows = lines.where(size >= 2).withColumn("_d", F.zip_with(F.slice("points", F.lit(1), size - 1), F.slice("points", F.lit(2), size - 1), hop))
    rows = rows.withColumn("_len", F.aggregate("_d", F.lit(0.0), lambda a, x: a + x))
    y = F.transform("points", lambda p: p["y"])
    step = step_m / (METRES_PER_DEGREE * F.cos(F.radians((F.array_min(y) + F.array_max(y)) / 2)))
    rows = rows.withColumn("_n", F.greatest(F.floor(F.col("_len") / step).cast("int"), F.lit(1)))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_at", F.col("_len") * F.col("k") / F.col("_n"))
    # the segment that holds the place, and how far along it
    walk = F.aggregate("_d", F.struct(F.lit(0).alias("i"), F.col("_at").alias("rest"), F.lit(False).alias("done")), lambda a, d: F.when(a["done"] | (a["rest"] <= d), F.struct(a["i"].alias("i"), a["rest"].alias("rest"), F.lit(True).alias("done"))).otherwise(F.struct((a["i"] + 1).alias("i"), (a["rest"] - d).alias("rest"), F.lit(False).alias("done"))))
    rows = rows.withColumn("_w", walk).withColumn("_i", F.least(F.col("_w.i"), size - 2)).withColumn("_p", F.get("points", F.col("_i"))).withColumn("_q", F.get("points", F.col("_i") + 1))
    long = F.get("_d", F.col("_i"))
    part = F.when(F.col("_w.done"), F.when(long > 0, F.col("_w.rest") / long).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
    return rows.select("id", "k", F.round(F.col("_p.x") + (F.col("_q.x") - F.col("_p.x")) * part, 5).alias("x"), F.round(F.col("_p.y") + (F.col("_q.y") - F.col("_p.y")) * part, 5).alias("y"))


def leaf_paths(df: DataFrame, keys: Sequence[str], json: str, deepest: int = 100) -> DataFrame:
    """keys, path, value: the leaves of nested JSON objects under dotted paths, values as JSON text.

    Objects are opened level by level; arrays are leaves, an empty object has none.
    """
    spark = df.sparkSession
    now, out = df.select(*keys, F.lit("").alias("_at"), F.try_parse_json(json).alias("_v")), None
    for _ in range(deepest):
        level = now.where(F.schema_of_variant("_v").startswith("OBJECT")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_k", "_child"))
        level = level.select(*keys, F.concat("_at", "_k").alias("path"), F.col("_child").alias("_v"))
        open_ = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
        leaves = level.where(~open_).select(*keys, "path", F.to_json("_v").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        now = level.where(open_).select(*keys, F.concat("path", F.lit(".")).alias("_at"), "_v")
        if not now.limit(1).count():
            return out
    raise RuntimeError(f"objects nested deeper than {deepest}")


def json_get(json: Column, path: str) -> Column:
    """The JSON text at a dotted path; null where a step is missing or no object."""
    return F.get_json_object(json, "$" + "".join(f"['{k}']" for k in path.split(".")))


def _members(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def json_set(json: Column, path: str, value: Column) -> Column:
    """The object with `value` (JSON text) at a dotted path; steps that are no objects become objects."""
    key, *rest = path.split(".")
    m = _members(json)
    child = F.try_element_at(m, F.lit(key))
    new = F.parse_json(json_set(F.when(_is_object(child), F.to_json(child)).otherwise("{}"), ".".join(rest), value) if rest else value)
    return F.to_json(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), new)))


def json_delete(json: Column, path: str) -> Column:
    """The object without the member at a dotted path; unchanged where a step is missing or no object."""
    key, *rest = path.split(".")
    m = _members(json)
    without = F.map_filter(m, lambda k, _: k != key)
    if not rest:
        return F.to_json(without)
    child = F.try_element_at(m, F.lit(key))
    new = F.parse_json(json_delete(F.when(_is_object(child), F.to_json(child)).otherwise("{}"), ".".join(rest)))
    return F.when(_is_object(child), F.to_json(F.map_concat(without, F.create_map(F.lit(key), new)))).otherwise(json)
