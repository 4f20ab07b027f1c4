"""Reports as rows of text (ord, line), and the frames that statistics read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.operators.records import blank
from terralens.operators.stats import percent

SPLITS = ("train", "validation", "benchmark")
#: Rows of a section's dimensions begin so far apart.
_ROOM = 10_000


def sample_frame(records: DataFrame) -> DataFrame:
    """One row a record (location, metadata, validation, questions) for statistics; empty and missing labels are ``unknown``, a missing view count is four."""
    m = lambda c: F.col(f"metadata.{c}").alias(c)
    known = lambda c: F.coalesce(blank(F.col(f"metadata.{c}")), F.lit("unknown")).alias(c)
    place = lambda c: F.coalesce(F.col(f"location.{c}"), F.lit("Unknown")).alias(c)
    asked = F.coalesce("questions", F.array().cast(records.schema["questions"].dataType))
    return records.select(
        "sample_id", place("city"), place("country"), F.coalesce("validation.streetview_count", F.lit(4)).alias("sv_count"), F.size(asked).alias("question_count"), known("land_use_category"),
        *(m(c) for c in ("osm_building_count", "osm_amenity_count", "osm_median_building_levels", "osm_water_distance_m", "osm_transit_stop_count", "osm_has_park")),
        *(known(c) for c in ("road_type", "osm_road_surface", "osm_junction_type", "osm_dominant_landuse_raw")), F.transform(asked, lambda q: q["topic"]).alias("topics_in_sample"))


def question_frame(records: DataFrame) -> DataFrame:
    """One row a question for statistics."""
    text = lambda c, default: F.coalesce(F.col(f"q.{c}"), F.lit(default)).alias(c)
    return records.select("sample_id", F.coalesce("location.city", F.lit("Unknown")).alias("city"), F.explode("questions").alias("q")).select(
        "sample_id", "city", text("topic", "unknown"), text("difficulty", "unknown"), text("answer", "?"), F.coalesce(F.size("q.options"), F.lit(0)).alias("n_options"))


def _line(ord_: Column, *parts: Column | str) -> Column:
    return F.struct(ord_.cast("int").alias("ord"), F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("line"))


def split_report(tagged: DataFrame) -> DataFrame:
    """(ord, line) of a split's statistics (tagged with ``split``): for each part its totals, and counts with percents of topics, difficulties, land uses and answers, in order.

    One pass counts everything: a row gives its value in each dimension, which are counted together.
    """
    number = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")) - 1
    dims = ("topic", "difficulty", "land_use", "answer")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("d"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for k, c in enumerate(dims)))).alias("x")
    counts = tagged.select("split", each).groupBy("split", "x.d", "x.value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("split", "d"))
    hardness = F.coalesce(F.nullif(F.array_position(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.col("value")), F.lit(0)), F.lit(9))
    rank = F.row_number().over(Window.partitionBy("split", "d").orderBy(F.when(F.col("d") == 1, hardness), "value"))
    name = F.element_at(F.array(*map(F.lit, dims)), F.col("d") + 1)
    body = counts.select(_line(number * 10 * _ROOM + (F.col("d") + 1) * _ROOM + rank, "  ", name, " ", F.col("value"), ": ", F.col("n"), " (", percent(F.col("n"), total), ")").alias("x"))
    totals = tagged.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("l"), F.array_join(F.array_sort(F.collect_set("city")), ", ").alias("c"), F.countDistinct("city").alias("k"))
    at = number * 10 * _ROOM
    head = totals.select(F.explode(F.array(_line(at, "[", F.upper("split"), "]"), _line(at + 1, "  Total questions: ", F.col("n")), _line(at + 2, "  Total locations: ", F.col("l")), _line(at + 3, "  Cities: ", F.col("k"), " (", F.col("c"), ")"))).alias("x"))
    return body.unionByName(head).select("x.*")


def accuracy_lines(accuracy: DataFrame) -> DataFrame:
    """(ord, line) of an accuracy table in markdown (topic, n, correct, accuracy, delta), by topic."""
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("topic")) + 1
    sign = F.when(F.col("delta") >= 0, "+").otherwise("-")
    shown = lambda c: percent(F.abs(c), F.lit(1))
    rows = accuracy.select(_line(rank, "| ", F.col("topic"), " | ", shown("accuracy"), " | ", F.col("correct"), "/", F.col("n"), " | ", sign, shown("delta"), " |").alias("x")).select("x.*")
    head = accuracy.sparkSession.createDataFrame([(0, "| Topic | Accuracy | Correct/Total | vs Base |"), (1, "|-------|----------|---------------|---------|")], "ord int, line string")
    return reduce(DataFrame.unionByName, [head, rows])
