"""Nested records from samples and their questions, back to samples, and what viewers show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.functions.text import safe_int, sid_from_path
from terralens.operators import records as R
from terralens.operators.questions import LAND_USE

VIEWS = ("along_fwd", "along_bwd", "cross_left", "cross_right")
GEO_TOPICS = ("mismatch_mcq", "mismatch_binary", "camera_direction")
GEO_TEXTS = ("sat_marked_path", "mismatch_strategy", "composite_stv_path", "composite_stv_labeled_path", "stv_shown_composite", "mismatch_negative_stv_composite", "query_stv_path", "query_stv_angle")
GEO_LISTS = ("stv_shown_paths", "mismatch_negative_stv_paths")
GEO_MAPS = ("option_composite_paths", "option_sat_paths")
#: Metadata that generation reads at the top level, and their names there if those differ.
PROMOTED = ("land_use_category", "osm_building_count", "osm_has_park", "osm_amenity_count", "osm_amenity_types", "osm_road_surface", "osm_junction_type", "osm_water_distance_m", "osm_transit_stop_count", "road_bearing")
RENAMED = {"road_type": "highway_type", "osm_median_building_levels": "osm_median_levels"}
GENERATED = ("questions", "all_questions", "mismatch_binary_variants", "mismatch_mcq_variants", "camera_arrow_paths", "sat_marked_path", "stv_composite_path", "stv_composite_labeled_path")


def presence(samples: DataFrame, listing: DataFrame) -> DataFrame:
    """sample_id, has_sat and views (0 to 4) by the files that a listing (path) has."""
    kind = F.split("path", "/")[1]
    view = F.regexp_extract("path", "_(" + "|".join(VIEWS) + r")\.jpg$", 1)
    files = listing.where(kind.isin("sat", "sv")).select(sid_from_path(F.col("path")).alias("sample_id"), (kind == "sat").alias("sat"), F.nullif(F.when(kind == "sv", view), F.lit("")).alias("view"))
    per = files.groupBy("sample_id").agg(F.bool_or("sat").alias("has_sat"), F.countDistinct("view").alias("views"))
    return samples.select("sample_id").join(per, "sample_id", "left").select("sample_id", F.coalesce("has_sat", F.lit(False)).alias("has_sat"), F.coalesce("views", F.lit(0)).cast("int").alias("views"))


def question_arrays(questions: DataFrame) -> DataFrame:
    """sample_id and questions: an array by ``pos`` of a sample's questions (question, options, answer, topic, difficulty); placement fields are null where a question has none."""
    have = set(questions.columns)
    field = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    extra = [field("mismatch_is_match", "boolean"), *(field(c, "string") for c in GEO_TEXTS), *(field(c, "array<string>") for c in GEO_LISTS), *(field(c, "map<string,string>") for c in GEO_MAPS)]
    each = F.struct("pos", F.struct("question", F.coalesce(field("options", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("options"), "answer", "topic", "difficulty", F.lit("template").alias("generation_method"), *extra).alias("q"))
    # options are maps, which can't be ordered: positions are, and they tell a sample's questions apart
    got = questions.groupBy("sample_id").agg(F.collect_list(each).alias("a"))
    return got.select("sample_id", F.transform(F.array_sort("a", lambda x, y: x["pos"] - y["pos"]), lambda x: x["q"]).alias("questions"))


def build_records(samples: DataFrame, questions: DataFrame, present: DataFrame) -> DataFrame:
    """One nested record a sample: location, images, best question, all questions, metadata and validation.

    samples: sample_id, lat, lon and whatever of the other columns there is; a missing one is null. Members that only some records have (marked
    image, composites, census) are null structs or fields elsewhere. present: see ``presence``.
    """
    have = set(samples.columns)
    c = lambda name, kind="string": (F.col(f"s.{name}") if name in have else F.lit(None)).cast(kind)
    text = lambda name: F.coalesce(c(name), F.lit(""))
    sid = F.col("s.sample_id")
    view = lambda v: F.concat(F.lit("images/sv/"), sid, F.lit(f"_{v}.jpg"))
    category = F.coalesce(c("land_use_category"), F.lit("unknown"))
    labels = F.create_map(*(F.lit(x) for kv in LAND_USE.items() for x in kv))
    whole = lambda name: safe_int(c(name)).alias(name)
    images = F.struct(
        F.concat(F.lit("images/sat/"), sid, F.lit(".png")).alias("satellite"), F.coalesce(c("satellite_actual_source"), c("satellite_source"), F.lit("unknown")).alias("satellite_source"),
        F.coalesce(c("satellite_date"), F.lit("unknown")).alias("satellite_date"), *(view(v).alias(f"streetview_{v}") for v in VIEWS), F.lit("Google Street View").alias("streetview_source"),
        c("road_bearing", "double").alias("streetview_road_bearing"), c("sv_date").alias("streetview_date"), R.blank(c("sat_marked_path")).alias("satellite_marked"), R.blank(c("stv_composite_path")).alias("stv_composite"),
        F.when(R.blank(c("stv_composite_path")).isNotNull(), c("stv_composite_labeled_path")).alias("stv_composite_labeled"))
    census = F.struct(c("census_tract").alias("tract"), safe_int(c("census_population")).alias("population"), safe_int(c("census_median_income")).alias("median_income"))
    metadata = F.struct(
        category.alias("land_use_category"), F.coalesce(F.try_element_at(labels, category), category).alias("land_use_label"), F.coalesce(c("metadata_radius_m", "int"), F.lit(200)).alias("metadata_radius_m"),
        whole("osm_building_count"), safe_int(c("osm_median_levels")).alias("osm_median_building_levels"), c("osm_dominant_landuse_raw").alias("osm_dominant_landuse_raw"), whole("osm_amenity_count"),
        c("osm_amenity_types", "array<string>").alias("osm_amenity_types"), F.coalesce(c("osm_has_park", "boolean"), F.lit(False)).alias("osm_has_park"), c("osm_building_types", "map<string,bigint>").alias("osm_building_types"),
        c("road_name").alias("road_name"), c("highway_type").alias("road_type"), c("osm_road_surface").alias("osm_road_surface"), c("osm_junction_type").alias("osm_junction_type"), c("osm_water_distance_m", "double").alias("osm_water_distance_m"),
        whole("osm_transit_stop_count"), c("road_bearing", "double").alias("road_bearing"), F.when(R.blank(c("census_tract")).isNotNull(), census).alias("census"))
    issues = F.coalesce(c("validation_issues", "array<string>"), F.array().cast("array<string>"))
    location = F.struct(c("lat", "double").alias("latitude"), c("lon", "double").alias("longitude"), text("city_name").alias("city"), *(text(x).alias(x) for x in ("country", "neighborhood", "road_name", "geo_suburb")))
    rows = samples.alias("s").join(question_arrays(questions).alias("q"), "sample_id", "left").join(present.alias("p"), "sample_id", "left")
    sat, views, asked = F.coalesce("p.has_sat", F.lit(False)), F.coalesce("p.views", F.lit(0)), F.coalesce(F.size("q.questions"), F.lit(0))
    count = F.when(F.col("q.questions").isNull(), 0).otherwise(asked)
    return rows.select(
        "sample_id", R.modality(sat, views).alias("image_modality"), location.alias("location"), images.alias("images"), *(text(x).alias(x) for x in ("question", "answer", "difficulty", "topic")),
        F.coalesce(c("options", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("options"), F.lit("template").alias("generation_method"), count.alias("question_count"), F.col("q.questions").alias("questions"), metadata.alias("metadata"),
        F.struct((sat & (views == 4)).alias("all_images_present"), sat.alias("satellite_present"), views.alias("streetview_count"), issues.alias("issues")).alias("validation"))


def city_of(location_city: Column, city: Column) -> Column:
    """The nested name, else the flat one, else an empty text."""
    return F.coalesce(location_city, city, F.lit(""))


def view_count_of(nested: Column) -> Column:
    return F.coalesce(nested, F.lit(0))


def promote(records: DataFrame) -> DataFrame:
    """Records without generated fields, and with the metadata that generation reads as columns of its own; a column that is there already keeps its values where it has any."""
    inside = set(records.select("metadata.*").columns)
    names = {k: k for k in PROMOTED} | RENAMED
    up = {to: F.coalesce(F.col(to), F.col(f"metadata.{k}")) if to in records.columns else F.col(f"metadata.{k}") for k, to in names.items() if k in inside}
    return records.withColumns(up).drop(*GENERATED)


def explode_viewer(records: DataFrame) -> DataFrame:
    """Questions of the placement topics with their sample's id, location and images."""
    return records.select(F.col("sample_id").alias("_sid"), F.col("location").alias("_loc"), F.col("images").alias("_images"), F.explode("questions").alias("q")).select("_sid", "_loc", "_images", "q.*").where(F.col("topic").isin(*GEO_TOPICS))


def viewer_filter(questions: DataFrame, topics: tuple[str, ...] = GEO_TOPICS, match: tuple[bool, ...] = (True, False), strategy: str = "all", difficulty: str = "all") -> DataFrame:
    """What a viewer's choices leave. A question without a strategy or difficulty passes any choice of it; one without a match flag counts as no match."""
    out = questions.where(F.col("topic").isin(*topics))
    if len(match) < 2:
        out = out.where((F.col("topic") != "mismatch_binary") | F.coalesce("mismatch_is_match", F.lit(False)).isin(*match))
    for column, chosen in (("mismatch_strategy", strategy), ("difficulty", difficulty)):
        if chosen != "all":
            out = out.where(F.coalesce(R.blank(F.col(column)), F.lit(chosen)) == chosen)
    return out


def viewer_counts(questions: DataFrame) -> DataFrame:
    t, yes = F.col("topic"), F.coalesce("mismatch_is_match", F.lit(False))
    return questions.agg(F.count("*").alias("n"), F.count_if(t == "mismatch_mcq").alias("mcq"), F.count_if((t == "mismatch_binary") & yes).alias("binary_yes"), F.count_if((t == "mismatch_binary") & ~yes).alias("binary_no"), F.count_if(t == "camera_direction").alias("camera"))


def census_wanted(samples: DataFrame) -> DataFrame:
    """Samples whose country has census tracts."""
    return samples.where("country = 'USA'")


def select_cities(wanted: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cities of ``wanted`` that are known, and those that aren't."""
    return wanted.join(known, "city", "left_semi"), wanted.select("city").join(known, "city", "left_anti")


def cached_locations(cache: DataFrame, fresh: DataFrame, n: int) -> DataFrame:
    """The first ``n`` cached locations (city, ordinal) of each city that has so many, and the fresh ones of all others."""
    enough = cache.groupBy("city").agg(F.count("*").alias("c")).where(F.col("c") >= n).select("city")
    kept = cache.join(enough, "city", "left_semi").where(F.col("ordinal") <= n)
    return kept.unionByName(fresh.join(enough, "city", "left_anti").select(cache.columns))


def composite_counts(samples: DataFrame) -> DataFrame:
    """How many samples have a marked image, arrows, and variants of either kind."""
    some = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    return samples.agg(F.count_if(R.blank(F.col("sat_marked_path")).isNotNull()).alias("dots"), some("camera_arrow_paths").alias("arrows"), some("mismatch_mcq_variants").alias("mcq"), some("mismatch_binary_variants").alias("pairs"))


def run_summary(records: DataFrame) -> DataFrame:
    """(section, value, n) of a run: totals, cities, topics, answers, land uses, topics of all questions, images. Two passes: over records, over questions."""
    valid = ~F.exists("validation.issues", lambda x: x.contains("CRITICAL"))
    pair = lambda section, value: F.struct(F.lit(section).alias("section"), value.cast("string").alias("value"))
    flags = {"samples": F.lit(True), "valid": valid, "satellite": F.col("validation.satellite_present"), "four views": F.col("validation.streetview_count") == 4}
    counted = {"city": F.col("location.city"), "topic": R.blank(F.col("topic")), "answer": R.blank(F.col("answer")), "land use": R.blank(F.col("metadata.land_use_label"))}
    each = F.array(*(F.when(ok, pair("total", F.lit(k))) for k, ok in flags.items()), *(F.when(v.isNotNull(), pair(k, v)) for k, v in counted.items()))
    n = F.coalesce("question_count", F.lit(1))
    by = records.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).groupBy("x.section", "x.value").agg(F.count("*").cast("double").alias("n"))
    numbers = records.agg(F.sum(n).alias("total"), (F.sum(n) / F.count("*")).alias("average"), F.min(n).alias("least"), F.max(n).alias("most"))
    long = numbers.select(F.explode(F.array(*(F.struct(F.lit("questions").alias("section"), F.lit(c).alias("value"), F.col(c).cast("double").alias("n")) for c in numbers.columns))).alias("x")).select("x.*")
    asked = records.select(F.explode("questions").alias("q")).groupBy(F.col("q.topic").alias("value")).agg(F.count("*").cast("double").alias("n")).select(F.lit("question topic").alias("section"), "value", "n")
    return by.unionByName(long).unionByName(asked)
