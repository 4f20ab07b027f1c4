"""Adapters that shape the star-schema tables as locations, map elements, road vertices and questions.

The same SQL text serves Spark and the oracle; coordinates come from integers and one division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = ["land_use", "building_height", "urban_density", "road_type", "green_space", "amenity_richness", "road_surface", "junction_type", "water_proximity", "transit_density", "camera_direction", "mismatch_binary", "mismatch_mcq"]
LAND_USE = ["residential", "commercial", "retail", "industrial", "mixed", "institutional", "open_space", "transport"]
ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


def pick(expr: str, values: list[str | None]) -> str:
    return f"case {expr} " + " ".join(f"when {k} then {'null' if v is None else repr(v)}" for k, v in enumerate(values)) + " end"


LOCATIONS = """select concat('city', lpad(cast(c_nationkey as string), 2, '0'), '_', lpad(cast(c_custkey as string), 6, '0')) as sample_id, c_custkey, n_name as city, r_name as country, n_nationkey,
 (-80000000 + c_nationkey * 6450000 + (c_custkey * 7919) % 20000) / cast(1000000 as double) as lat,
 (10000000 + c_nationkey * 500000 + (c_custkey * 104729) % 60000) / cast(1000000 as double) as lon,
 case when c_custkey % 10 = 0 then 3 else 4 end as streetview_count
 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

ELEMENTS = """select cast(row_number() over (partition by l_orderkey order by ORDER) + l_orderkey * 64 as bigint) as ord,
 (-80000000 + (l_orderkey % 25) * 6450000 + (l_partkey * 7907 + l_suppkey * 131 + l_linenumber * 17) % 20000) / cast(1000000 as double) as lat,
 (10000000 + (l_orderkey % 25) * 500000 + (l_partkey * 611953 + l_orderkey * 37) % 60000) / cast(1000000 as double) as lon,
 (l_partkey + l_linenumber) % 8 as cat, case when l_suppkey % 5 = 0 then null else cast(floor(l_quantity) as int) % 25 end as levels, KIND as kind,
 SURFACE as surface, l_suppkey % 37 = 0 as roundabout, l_suppkey % 11 = 0 as bridge
 from lineitem""".replace("ORDER", ORDER).replace("KIND", pick("l_partkey % 5", ["grass", "retail", "residential", None, "industrial"])).replace("SURFACE", pick("l_suppkey % 7", ["asphalt", "sett", "", None, "gravel", "sett", "paved"]))

ROADS = """select l_orderkey as way, row_number() over (partition by l_orderkey order by ORDER) - 1 as pos,
 (-80000000 + (l_orderkey % 25) * 6450000 + (l_orderkey * 31) % 20000 + l_linenumber * 200) / cast(1000000 as double) as lat,
 (10000000 + (l_orderkey % 25) * 500000 + (l_orderkey * 53) % 60000 + ((l_linenumber * l_linenumber) % 7) * 150) / cast(1000000 as double) as lon
 from lineitem""".replace("ORDER", ORDER)

QUESTIONS = f"""select concat('loc_', lpad(cast(l_orderkey as string), 8, '0')) as sample_id, n_name as city, {pick("l_orderkey % 8", LAND_USE)} as land_use,
 case when l_orderkey % 10 = 0 then 3 when l_orderkey % 11 = 0 then null else 4 end as streetview_count,
 row_number() over (partition by l_orderkey order by {ORDER}) - 1 as pos, {pick("l_partkey % 13", TOPICS)} as topic,
 {pick("l_suppkey % 3", ["easy", "medium", "hard"])} as difficulty, substr('ABCD', cast(l_partkey % 4 + 1 as int), 1) as answer,
 cast((l_orderkey * 17 + l_linenumber) % 25 as int) as neg_key, l_linenumber % 3 as run_ord, l_quantity as value
 from lineitem join nation on n_nationkey = l_orderkey % 25"""

SAMPLES = f"""select concat('city', lpad(cast(c_nationkey as string), 2, '0'), '_', lpad(cast(c_custkey as string), 6, '0')) as sample_id, c_custkey, n_name as city,
 case when c_custkey % 11 = 0 then null else c_custkey * 37 % 200 end as building_count, case when c_custkey % 7 = 0 then null else c_custkey * 13 % 30 end as median_levels,
 c_custkey * 29 % 40 as amenity_count, case when c_custkey % 17 = 0 then null else c_custkey % 3 = 0 end as has_park, c_custkey * 5 % 9 as transit_stops,
 case when c_custkey % 4 = 0 then null else (c_custkey * 211 % 2500) / cast(10 as double) end as water_m,
 {pick("c_custkey % 9", ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unknown", None, "footway"])} as road_type,
 {pick("c_custkey % 7", ["asphalt", "sett", "gravel", "concrete", "wood", None, "paved"])} as surface,
 {pick("c_custkey % 6", ["roundabout", "signalized", "unsignalized", "grade_separated", None, "odd"])} as junction,
 {pick("c_custkey % 10", [*LAND_USE, None, "odd"])} as land_use, cast(c_custkey * 73 % 400 as double) as bearing, case when c_custkey % 10 = 0 then 3 else 4 end as streetview_count,
 {pick("c_custkey % 4", ["grass", "retail", "residential", None])} as landuse_raw, {pick("c_custkey % 5", ["office", "warehouse", "house", "church", None])} as top_type
 from customer join nation on c_nationkey = n_nationkey"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(sql, **used)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key before much is done with each: a file may be one task. What groups or joins by the key needs no other shuffle. A number that is given isn't made smaller."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def locations(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, LOCATIONS)


def elements(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, ELEMENTS)


def numbered_elements(spark: SparkSession, d: str) -> DataFrame:
    """The same elements, of which only the lines' own columns are shuffled to be numbered, and nothing where the number isn't read."""
    number = f"row_number() over (partition by l_orderkey order by {ORDER})"
    wanted = dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey", *ORDER.split(", ")])
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(*wanted).withColumn("_number", F.expr(number))
    return spark.sql(ELEMENTS.replace(number, "_number").replace("from lineitem", "from {lineitem}"), lineitem=lines)


def roads(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, ROADS)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, QUESTIONS)


def samples(spark: SparkSession, d: str) -> DataFrame:
    return dealt(frame(spark, d, SAMPLES), "sample_id")


def dealt_questions(spark: SparkSession, d: str) -> DataFrame:
    """The same questions, shuffled once, by sample_id, which is a function of the order's key."""
    key, order = "concat('loc_', lpad(cast(l_orderkey as string), 8, '0'))", "partition by l_orderkey"
    wanted = ["l_orderkey", "l_partkey", "l_suppkey", *ORDER.split(", ")]
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(*dict.fromkeys(wanted), F.expr(key).alias("_sample"))
    sql = QUESTIONS.replace(key, "_sample").replace(order, "partition by l_orderkey, _sample").replace("from lineitem join nation ", "from {lineitem} join {nation} ")
    return spark.sql(sql, lineitem=dealt(lines, "_sample"), nation=spark.read.parquet(f"{d}/nation.parquet"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Questions nested in their locations."""
    q = dealt_questions(spark, d)
    each = F.struct("pos", "topic", "difficulty", "answer", "neg_key", "run_ord", "value")
    return q.groupBy("sample_id", "city", "land_use", "streetview_count").agg(F.sort_array(F.collect_list(each)).alias("s")).select(
        "sample_id", "city", "land_use", "streetview_count", F.transform("s", lambda x: x.dropFields("pos")).alias("questions"))


def unseen(spark: SparkSession, d: str) -> DataFrame:
    """A third of the cities."""
    return spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("city"))
