"""Readers of question records, map extracts, sample tables and image listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_TAGS = T.MapType(T.StringType(), T.StringType())
ROADS = T.StructType([T.StructField("elements", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", _TAGS), T.StructField("geometry", T.ArrayType(_POINT))])))])
CONTEXT = T.StructType([T.StructField("elements", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("center", _POINT), T.StructField("tags", _TAGS)])))])
_BAD = "_corrupt"


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records, one a line; blank lines are skipped and a malformed one stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(records with a key, count of skipped lines: malformed or without a key)."""
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r")).select("r.*")
    good = F.col(_BAD).isNull() & (F.coalesce(F.col(key), F.lit("")) != "")
    return rows.where(good).drop(_BAD), rows.agg(F.count_if(~good).alias("skipped"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, by file), file and value of each line. Lines are numbered in the order of their places: blocks of a file are counted, and a block's number of lines before it is added."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    inner = rows.withColumn("i", F.row_number().over(Window.partitionBy("file", "block").orderBy("k")))
    n = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = n.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    return inner.join(before, ["file", "block"]).select((F.col("i") + F.col("before")).alias("line_no"), "file", "value")


def jsonl_numbered(spark: SparkSession, path: str, schema: T.StructType, key: str = "sample_id") -> DataFrame:
    """Records, one a line; malformed lines are skipped, and a record without a key gets ``unknown_`` and its line's number."""
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select("line_no", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r")).select("line_no", "r.*").where(F.col(_BAD).isNull())
    return rows.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("unknown_"), F.col("line_no").cast("string")))).drop(_BAD, "line_no")


def jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records, one a line; a malformed line stops the read with its file and number."""
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select("line_no", "file", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    stop = F.raise_error(F.concat(F.col("file"), F.lit(" line "), F.col("line_no").cast("string"), F.lit(" isn't a record")))
    checked = rows.withColumn("r", F.when(F.col(f"r.{_BAD}").isNotNull(), stop.cast(full)).otherwise(F.col("r")))
    return checked.select("r.*").drop(_BAD)


def jsonl_dropping(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_samples(spark: SparkSession, path: str, schema: T.StructType, nested: dict[str, str] | None = None) -> DataFrame:
    """Sample table; columns named in ``nested`` hold JSON (or single-quoted) text of the given type, and unreadable text is null."""
    df = spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)
    return df.withColumns({c: F.from_json(c, t, {"allowSingleQuotes": "true"}) for c, t in (nested or {}).items()})


def road_nodes(spark: SparkSession, path: str) -> DataFrame:
    """way, pos, lat, lon, road_name and highway_type of all vertices of a road extract."""
    e = spark.read.schema(ROADS).option("multiLine", "true").json(path).select(F.posexplode("elements").alias("way", "e"))
    tag = lambda k, default: F.coalesce(F.try_element_at("e.tags", F.lit(k)), F.lit(default))
    g = e.select("way", tag("name", "unnamed").alias("road_name"), tag("highway", "unknown").alias("highway_type"), F.posexplode("e.geometry").alias("pos", "p"))
    return g.select("way", "pos", "p.lat", "p.lon", "road_name", "highway_type")


def context_elements(spark: SparkSession, path: str) -> DataFrame:
    """ord, lat, lon (of the centre if it is whole, else the element's own; without either the element is dropped), tags."""
    e = spark.read.schema(CONTEXT).option("multiLine", "true").json(path).select(F.posexplode("elements").alias("ord", "e"))
    centred = F.col("e.center.lat").isNotNull() & F.col("e.center.lon").isNotNull()
    at = lambda k: F.when(centred, F.col(f"e.center.{k}")).otherwise(F.col(f"e.{k}")).alias(k)
    return e.select(F.col("ord").cast("bigint").alias("ord"), at("lat"), at("lon"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags")).where("lat is not null and lon is not null")


def categories(elements: DataFrame) -> DataFrame:
    """One row for each category that an element's tags give it."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    has = lambda k: F.map_contains_key("tags", k)
    names = F.array(
        F.when(has("building"), "building"), F.when(has("amenity"), "amenity"), F.when(has("landuse"), "landuse"), F.when(t("leisure") == "park", "park"),
        F.when(t("highway") == "traffic_signals", "signal"), F.when((t("natural") == "water") | has("waterway"), "water"),
        F.when((t("highway") == "bus_stop") | t("railway").isin("station", "tram_stop", "halt", "subway_entrance") | has("public_transport"), "transit"))
    return elements.withColumn("category", F.explode(F.filter(names, lambda x: x.isNotNull())))


def image_listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path below its folder, folder number and length; file contents are never read."""
    out = None
    for k, folder in enumerate(folders):
        root = folder.rstrip("/")
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", f"^.*?{root.split('://')[-1]}/", "").alias("path"), F.lit(k).alias("dir_ord"), "length")
        out = one if out is None else out.unionByName(one)
    return out
