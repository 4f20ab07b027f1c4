"""Validation of records and quality of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.operators.questions import JUNCTION, LAND_USE, ROAD, SURFACE

# Cities where very high buildings are plausible.
SKYSCRAPER_CITIES = [
    "New York City", "Tokyo", "Singapore", "Chicago", "Seoul",
    "Hong Kong", "Shanghai", "Dubai", "Toronto", "Sydney",
    "London", "Paris", "Moscow", "St. Petersburg", "Istanbul",
    "Mumbai", "Buenos Aires", "São Paulo", "Rio de Janeiro",
    "Bangkok", "Kuala Lumpur", "Taipei", "Mexico City",
]
SMALL_BYTES = 5000
#: A picture that the audit accepts.
AUDIT_BYTES = 5120
IMAGE_TOPICS = ("camera_direction", "mismatch_binary", "mismatch_mcq")


def present(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda x: x.isNotNull())


def asked_issues(asked: Column) -> Column:
    """Issues of each of a record's questions: an array of (topic, options as a map, answer), numbered from 0."""
    def of(q: Column, i: Column) -> Column:
        at = F.concat(F.lit("all_questions["), i.cast("string"), F.lit("] ("), F.coalesce(q["topic"], F.lit("?")), F.lit(") "))
        values, n = F.map_values(q["options"]), F.coalesce(F.size(q["options"]), F.lit(0))
        keyed = F.coalesce(F.map_contains_key(q["options"], F.coalesce(q["answer"], F.lit(""))), F.lit(False))
        return present(
            F.when((F.coalesce(q["answer"], F.lit("")) != "") & ~keyed, F.concat(F.lit("CRITICAL: "), at, F.lit("answer key not in options"))),
            F.when((n > 0) & (F.size(F.array_distinct(values)) != n), F.concat(F.lit("WARNING: "), at, F.lit("has duplicate options"))),
            F.when((n > 0) & (n != 4), F.concat(F.lit("WARNING: "), at, F.lit("expected 4 options, got "), n.cast("string"))))
    return F.flatten(F.transform(asked, of))


def record_issues(views: tuple[str, ...] = ("along_fwd", "along_bwd", "cross_left", "cross_right"), asked: Column | None = None) -> Column:
    """Issues of a record: question, answer, options (array of texts), sat_bytes (null: missing), view_bytes (map), levels.

    asked: the array of all questions, if records have one; a record without any is only well if it has a question of its own.
    """
    c = F.col
    n = F.size("options")
    letters = F.slice(F.array(*(F.lit(x) for x in "ABCDEFGH")), 1, F.greatest(n, F.lit(0)))
    seen = F.aggregate(F.map_values("view_bytes"), F.lit(0), lambda a, x: a + (F.coalesce(x, F.lit(0)) > SMALL_BYTES).cast("int"))
    own = present(
        F.when(F.coalesce("question", F.lit("")) == "", "CRITICAL: No question generated"),
        F.when((F.coalesce("answer", F.lit("")) != "") & ~F.coalesce(F.array_contains(letters, c("answer")), F.lit(False)), "CRITICAL: Answer key not in options"),
        F.when((n > 0) & (F.size(F.array_distinct("options")) != n), "CRITICAL: Duplicate options"),
        F.when((n > 0) & (n != 4), F.concat(F.lit("WARNING: Expected 4 options, got "), n.cast("string"))),
        F.when(c("sat_bytes").isNull(), "CRITICAL: Missing satellite image").when(c("sat_bytes") < SMALL_BYTES, "CRITICAL: Satellite image too small (likely blank/cloud)"),
        *(F.when(F.coalesce(F.try_element_at("view_bytes", F.lit(v)), F.lit(0)) <= SMALL_BYTES, f"WARNING: Missing/small SV image: {v}") for v in views),
        F.when(seen == 0, "CRITICAL: No street view images at all"))
    levels = present(F.when((c("levels") < 0) | (c("levels") > 200), F.concat(F.lit("WARNING: Implausible building levels: "), c("levels").cast("double").cast("string"))))
    if asked is None:
        return F.concat(own, levels)
    some = F.coalesce(F.size(asked), F.lit(0)) > 0
    of_all = F.when(some, asked_issues(asked)).otherwise(present(F.when(F.coalesce("question", F.lit("")) == "", "WARNING: No questions in all_questions array")))
    return F.concat(own, of_all, levels)


def is_valid(issues: Column) -> Column:
    return ~F.exists(issues, lambda x: x.contains("CRITICAL"))


def severity_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("issues").alias("i")).groupBy(F.substring_index("i", ":", 1).alias("severity")).agg(F.count("*").alias("n"))


def dataset_issues(q: DataFrame) -> DataFrame:
    """Warnings on a whole set of questions (sample_id, city, topic, answer, land_use), one row each."""
    total = q.agg(F.count("*").alias("n"), F.countDistinct("topic").alias("topics"), F.countDistinct("city").alias("cities"), F.countDistinct("land_use").alias("uses"), F.countDistinct("sample_id").alias("samples"))
    most = q.where("answer is not null").groupBy("answer").agg(F.count("*").alias("m")).agg(F.max("m").alias("most"))
    one = total.unionByName(most, allowMissingColumns=True)
    one = one.agg(*(F.max(x).alias(x) for x in one.columns))
    c = F.col
    rules = present(F.when(c("most") > 0.4 * c("n"), "answer skew"), F.when(c("topics") < 3, "few topics"), F.when(c("cities") < 2, "few cities"), F.when(c("uses") < 3, "few land uses"), F.when(c("topics") < 5, "few question types"), F.when(c("n") / F.nullif(c("samples"), F.lit(0)) < 2, "few questions per sample"))
    return one.select(F.explode(rules).alias("issue"))


def completeness(variants: bool = False) -> Column:
    """Why the metadata behind a question is incomplete; an empty text where it is complete.

    ``variants``: also judge arrow_paths (map), binary_variants (array) and mcq_variants (array of composite_path and correct_pos), which three topics need.
    """
    c, t = F.col, F.col("topic")
    quoted = lambda name: F.coalesce(F.concat(F.lit("'"), c(name), F.lit("'")), F.lit("None"))
    odd = lambda label, name: F.concat(F.lit(f"{label}="), quoted(name), F.lit(" not in valid set"))
    bad = lambda name, values: ~F.coalesce(c(name).isin(list(values)), F.lit(False))
    return (F.when((t == "land_use") & bad("land_use", LAND_USE), odd("land_use_category", "land_use"))
            .when((t == "building_height") & (F.coalesce("median_levels", F.lit(0)) == 0), "osm_median_building_levels is null or 0")
            .when((t == "building_height") & (c("median_levels") < 0), F.concat(F.lit("osm_median_building_levels="), c("median_levels").cast("string"), F.lit(" <= 0")))
            .when((t == "road_type") & bad("road_type", ROAD), odd("road_type", "road_type"))
            .when((t == "urban_density") & c("building_count").isNull(), "osm_building_count is null")
            .when((t == "green_space") & c("has_park").isNull(), "osm_has_park is null")
            .when((t == "amenity_richness") & c("amenity_count").isNull(), "osm_amenity_count is null")
            .when((t == "road_surface") & bad("surface", SURFACE), odd("osm_road_surface", "surface"))
            .when((t == "junction_type") & bad("junction", JUNCTION), odd("osm_junction_type", "junction"))
            .when((t == "water_proximity") & c("water_m").isNull(), "osm_water_distance_m is null")
            .when((t == "transit_density") & c("transit_stops").isNull(), "osm_transit_stop_count is null")
            .when((t == "camera_direction") & c("bearing").isNull(), "road_bearing is null")
            .when((t == "camera_direction") & ~c("bearing").between(0, 360), F.concat(F.lit("road_bearing="), c("bearing").cast("string"), F.lit(" out of 0-360 range")))
            .otherwise(variant_gaps() if variants else ""))


def variant_gaps() -> Column:
    """What the placement topics lack: four arrows, a variant, or a part of one."""
    t = F.col("topic")
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    return (F.when((t == "camera_direction") & (size("arrow_paths") < 4), F.concat(F.lit("camera_arrow_paths has only "), size("arrow_paths").cast("string"), F.lit("/4 entries")))
            .when((t == "mismatch_binary") & (size("binary_variants") == 0), "mismatch_binary_variants is empty")
            .when((t == "mismatch_mcq") & (size("mcq_variants") == 0), "mismatch_mcq_variants is empty")
            .when((t == "mismatch_mcq") & F.exists("mcq_variants", lambda v: empty(v["composite_path"]) | empty(v["correct_pos"])), "mismatch_mcq variant missing composite_path or correct_pos")
            .otherwise(""))


def image_checks(q: DataFrame, listing: DataFrame, key: str = "question_id") -> DataFrame:
    """``q`` with images_ok: whether every picture that a placement question refers to (arrow_paths, binary_variants, mcq_variants) has enough bytes in the first folder that has it; null for other topics.

    listing: path, dir_ord, length.
    """
    c, t = F.col, F.col("topic")
    none = F.array().cast("array<string>")
    binary = F.transform("binary_variants", lambda v: F.coalesce(F.nullif(v["negative_stv_composite"], F.lit("")), v["composite_stv_path"]))
    paths = F.when(t == "camera_direction", F.map_values("arrow_paths")).when(t == "mismatch_binary", binary).when(t == "mismatch_mcq", F.transform("mcq_variants", lambda v: v["composite_path"]))
    # an arrow without a path is missing; a variant without one isn't looked for
    wanted = F.when(t == "camera_direction", F.transform(paths, lambda p: F.coalesce(p, F.lit("")))).otherwise(F.filter(paths, lambda p: F.coalesce(p, F.lit("")) != ""))
    refs = q.where(t.isin(*IMAGE_TOPICS)).select(key, F.explode(F.coalesce(wanted, none)).alias("path"))
    first = listing.groupBy("path").agg(F.min(F.struct("dir_ord", "length")).alias("m")).select("path", c("m.length").alias("length"))
    bad = refs.join(first, "path", "left").where(F.coalesce("length", F.lit(0)) < AUDIT_BYTES).select(key, F.lit(True).alias("_bad")).distinct()
    return q.join(bad, key, "left").withColumn("images_ok", F.when(t.isin(*IMAGE_TOPICS), c("_bad").isNull())).drop("_bad")


def plausibility() -> Column:
    """Suspicions about a question's metadata."""
    c, t = F.col, F.col("topic")
    lu = F.coalesce("land_use", F.lit(""))
    bc, ac, lv = (F.coalesce(x, F.lit(0)) for x in ("building_count", "amenity_count", "median_levels"))
    return present(
        F.when((t == "land_use") & (lu == "open_space") & (bc > 50), "open_space but building_count>50"),
        F.when((t == "land_use") & (lu == "residential") & (bc == 0), "residential but building_count=0"),
        F.when((t == "land_use") & (lu == "industrial") & (ac > 15), "industrial but amenity_count>15"),
        F.when((t == "urban_density") & (bc > 150) & (ac == 0), "very_high_density but amenity_count=0"),
        F.when((t == "green_space") & F.coalesce("has_park", F.lit(False)) & (lu == "industrial") & (bc > 80), "has_park=True but heavy industrial area (lu=industrial, bc>80)"),
        F.when((t == "building_height") & (lv >= 21) & (lu == "residential") & ~F.coalesce(c("city").isin(SKYSCRAPER_CITIES), F.lit(False)), F.concat(F.lit("skyscraper height but lu=residential in non-skyscraper city ("), c("city"), F.lit(")"))),
        F.when((t == "building_height") & (lv > 100), F.concat(F.lit("implausible building levels: "), lv.cast("string"))),
        F.when((t == "road_type") & (c("road_type") == "motorway") & (c("junction") == "unsignalized"), "motorway but junction_type=unsignalized"),
    )


def assess(q: DataFrame) -> DataFrame:
    """Quality rows. q: sample_id, city, topic, difficulty, answer, n_options, images_ok (nullable) and the metadata; variants are judged if they are there."""
    c = F.col
    rows = q.withColumn("missing", completeness({"arrow_paths", "binary_variants", "mcq_variants"} <= set(q.columns))).withColumn("flags", plausibility())
    invalid = c("answer").isNull() | ~F.coalesce(c("n_options").isin(2, 4), F.lit(False))
    overall = (F.when(invalid, "invalid").when(c("missing") != "", "low_metadata").when(~F.coalesce("images_ok", F.lit(True)), "missing_images").when(F.size("flags") > 0, "suspicious").otherwise("pass"))
    reasons = F.concat_ws("; ", F.nullif("missing", F.lit("")), F.nullif(F.array_join("flags", "; "), F.lit("")), F.when(~c("images_ok"), "images missing"), F.when(invalid, "invalid structure"))
    return rows.select("sample_id", "city", "topic", "difficulty", "answer", (c("missing") == "").cast("int").alias("metadata_complete"), (F.size("flags") > 0).cast("int").alias("plausibility_flag"), c("images_ok").cast("int").alias("images_ok"), overall.alias("overall_quality"), reasons.alias("flag_reasons"))


def by_topic(rows: DataFrame, sparse: int = 1000) -> DataFrame:
    total = Window.partitionBy(F.lit(1))
    n = rows.groupBy("topic").agg(F.count("*").alias("n"), (F.avg("metadata_complete") * 100).alias("meta_pct"), (F.avg(1 - F.col("plausibility_flag")) * 100).alias("plausible_pct"), (F.avg((F.col("overall_quality") == "pass").cast("int")) * 100).alias("pass_pct"))
    mark = F.concat_ws(",", F.when(F.col("n") < sparse, "SPARSE"), F.when(F.col("meta_pct") < 60, "LOW METADATA"))
    return n.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(total)).withColumn("mark", mark)


def matrix(rows: DataFrame, topics: list[str]) -> DataFrame:
    """Completeness in percent, a row for each city and a column for each topic."""
    return rows.groupBy("city").pivot("topic", topics).agg(F.round(F.avg("metadata_complete") * 100, 3))


def top_reasons(rows: DataFrame, k: int = 5) -> DataFrame:
    each = rows.where("plausibility_flag = 1").select("topic", F.explode(F.split("flag_reasons", "; ")).alias("reason")).groupBy("topic", "reason").agg(F.count("*").alias("n"))
    return each.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "reason"))).where(F.col("r") <= k)


def recommendations(rows: DataFrame) -> DataFrame:
    """Rules of thumb on the quality rows: the topic that is removed anyway; topics with little metadata, many flags; cities with few questions; topics that miss images."""
    c = F.col
    odd = rows.where("topic = 'water_proximity'").select(F.lit("remove type").alias("rule"), c("topic").alias("subject")).distinct()
    low = rows.where("topic <> 'water_proximity'").groupBy("topic").agg(F.avg("metadata_complete").alias("v")).where("v < 0.6").select(F.lit("low metadata").alias("rule"), c("topic").alias("subject"))
    flagged = rows.groupBy("topic").agg(F.avg("plausibility_flag").alias("v")).where("v > 0.05").select(F.lit("many flags"), "topic")
    few = rows.groupBy("city").agg((F.count("*") / F.countDistinct("sample_id")).alias("v")).where("v < 12").select(F.lit("few questions"), "city")
    images = rows.where("images_ok is not null").groupBy("topic").agg(F.avg(1 - c("images_ok")).alias("v")).where("v > 0.05").select(F.lit("missing images"), "topic")
    return reduce(DataFrame.union, [odd, low, flagged, few, images])
