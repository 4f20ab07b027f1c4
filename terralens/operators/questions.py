"""Multiple-choice questions from location attributes: a question is (correct option, distractors), then shuffled by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions.text import hash_key

# Fixed labels.
LAND_USE = {
    "residential": "Residential",
    "commercial": "Commercial & Office",
    "retail": "Retail & Shopping",
    "industrial": "Industrial & Manufacturing",
    "mixed": "Mixed Use",
    "institutional": "Public Facilities & Institutions",
    "open_space": "Open Space & Recreation",
    "transport": "Transportation & Infrastructure",
}
HEIGHT = [("Low-rise (1-3 floors)", 1, 3), ("Mid-rise (4-7 floors)", 4, 7), ("High-rise (8-20 floors)", 8, 20), ("Skyscraper (20+ floors)", 21, 999)]
ROAD = {
    "motorway": "Motorway / Highway",
    "trunk": "Major trunk road",
    "primary": "Primary arterial road",
    "secondary": "Secondary road",
    "tertiary": "Tertiary / collector road",
    "residential": "Local residential street",
}
DENSITY = [("Low density (suburban/rural)", 0, 15), ("Moderate density (urban fringe)", 16, 50), ("High density (dense urban)", 51, 150), ("Very high density (urban core)", 151, 9999)]
SURFACE = {
    "asphalt": "Asphalt", "paved": "Asphalt", "concrete": "Concrete", "concrete:plates": "Concrete", "cobblestone": "Cobblestone/Sett", "sett": "Cobblestone/Sett", "paving_stones": "Cobblestone/Sett",
    "unpaved": "Unpaved/Gravel", "gravel": "Unpaved/Gravel", "dirt": "Unpaved/Gravel", "ground": "Unpaved/Gravel", "sand": "Unpaved/Gravel", "compacted": "Unpaved/Gravel",
}
SURFACES = ["Asphalt", "Cobblestone/Sett", "Unpaved/Gravel", "Concrete"]
JUNCTION = {"roundabout": "Roundabout", "signalized": "Signalized intersection", "unsignalized": "Unsignalized intersection", "grade_separated": "Grade-separated (overpass/underpass)"}
WATER = [("Yes — directly adjacent to a water body", 0, 50), ("Yes — nearby but not adjacent", 50, 150), ("No water body in view", 150, 99999)]
WATER_FILLER = "A seasonal water body may be present"
TRANSIT = [("None (no transit stops within 300m)", 0, 0), ("Low (1–2 stops)", 1, 2), ("Moderate (3–5 stops)", 3, 5), ("High (6+ stops)", 6, 9999)]
PARK_YES = ["Yes, green space or parks are present nearby", "No, the area is fully built-up with no visible green space", "The area is primarily industrial with no recreational space", "Only small private gardens exist, no public green space"]
PARK_NO = ["No, the area is densely built with no parks nearby", "Yes, a large public park is adjacent to this area", "Yes, several pocket parks and green corridors exist", "The area has extensive waterfront promenades and green space"]
AMENITY = ["High — numerous shops, restaurants, and services", "Moderate — some neighborhood shops and cafes", "Low — few services, primarily residential", "Minimal — industrial area with almost no amenities"]
DIFFICULTY = {"land_use": "easy", "building_height": "easy", "road_type": "easy", "urban_density": "medium", "green_space": "easy", "amenity_richness": "medium", "road_surface": "easy", "junction_type": "medium", "water_proximity": "medium", "transit_density": "medium"}


def _texts(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _label(key: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), key)


def _bin(x: Column, bins: list[tuple[str, int, int]], open_end: bool = False) -> Column:
    out = F.lit(None).cast("string")
    for label, lo, hi in reversed(bins):
        out = F.when((x >= lo) & ((x < hi) if open_end else (x <= hi)), label).otherwise(out)
    return out


def correct_options() -> dict[str, tuple[Column, Column]]:
    """For each topic the correct option (null: no question) and all options."""
    c = F.col
    park = F.when(c("has_park"), PARK_YES[0]).when(~c("has_park") & (F.coalesce("building_count", F.lit(0)) > 20), PARK_NO[0])
    n = c("amenity_count")
    return {
        "land_use": (_label(c("land_use"), LAND_USE), _texts(LAND_USE.values())),
        "building_height": (_bin(F.when(c("median_levels") > 0, c("median_levels")), HEIGHT), _texts(x[0] for x in HEIGHT)),
        "road_type": (_label(c("road_type"), ROAD), _texts(ROAD.values())),
        "urban_density": (_bin(c("building_count"), DENSITY), _texts(x[0] for x in DENSITY)),
        "green_space": (park, F.when(c("has_park"), _texts(PARK_YES)).otherwise(_texts(PARK_NO))),
        "amenity_richness": (F.when(n >= 20, AMENITY[0]).when(n >= 5, AMENITY[1]).when(n >= 1, AMENITY[2]).when(n.isNotNull(), AMENITY[3]), _texts(AMENITY)),
        "road_surface": (_label(c("surface"), SURFACE), _texts(SURFACES)),
        "junction_type": (_label(c("junction"), JUNCTION), _texts(JUNCTION.values())),
        "water_proximity": (_bin(c("water_m"), WATER, True), _texts([*(x[0] for x in WATER), WATER_FILLER])),
        "transit_density": (_bin(c("transit_stops"), TRANSIT), _texts(x[0] for x in TRANSIT)),
    }


def shuffled(values: Column, *salt: Column | str) -> Column:
    """Values in hash order under a salt."""
    keyed = F.transform(values, lambda v: F.struct(hash_key(*salt, v).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def choice_questions(samples: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """sample_id, topic, difficulty, correct, options (four, shuffled) and the answer's letter: one row for each topic that a sample supports."""
    made = []
    for topic, (right, options) in correct_options().items():
        if topics is None or topic in topics:
            others = F.slice(shuffled(F.array_remove(options, F.coalesce(right, F.lit(""))), F.col("sample_id"), topic), 1, 3)
            made.append(F.struct(F.lit(topic).alias("topic"), F.lit(DIFFICULTY[topic]).alias("difficulty"), right.alias("correct"), others.alias("others")))
    rows = samples.select("sample_id", F.explode(F.array(*made)).alias("q")).where("q.correct is not null").select("sample_id", "q.*")
    options = shuffled(F.concat(F.array("correct"), F.col("others")), F.col("sample_id"), F.col("topic"), "order")
    return rows.withColumn("options", options).withColumn("answer", F.substring(F.lit("ABCD"), F.array_position("options", F.col("correct")).cast("int"), F.lit(1))).drop("others")


def distractors(samples: DataFrame, same_city: bool, k: int = 3) -> DataFrame:
    """``k`` other samples for each sample (sample_id, rank, other), of the same or of other cities; pools of fewer than ``k`` give none.

    Samples are numbered in hash order in their city, by counting hash buckets, and cities one after the other. Own city: the numbers after
    the sample's. Other cities: the numbers outside the city's block form one range; a hashed start and equal strides choose
    ``k`` of them. Either way an equi-join of k rows a sample, whatever the cities' sizes.
    """
    keyed = samples.select("sample_id", "city", hash_key("pool", F.col("sample_id")).alias("_k")).withColumn("_b", F.substring("_k", 1, 3))
    counts = keyed.groupBy("city", "_b").agg(F.count("*").alias("_n"))
    base = counts.select("city", "_b", (F.sum("_n").over(Window.partitionBy("city").orderBy("_b")) - F.col("_n")).alias("_base"))
    cities = counts.groupBy("city").agg(F.sum("_n").alias("n"))
    cities = cities.select("city", "n", (F.sum("n").over(Window.orderBy("city")) - F.col("n")).alias("first"), F.sum("n").over(Window.orderBy("city").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    rank = F.row_number().over(Window.partitionBy("city", "_b").orderBy("_k")) - 1
    numbered = keyed.join(base, ["city", "_b"]).withColumn("o", F.col("_base") + rank).join(cities, "city")
    at = numbered.select(F.col("sample_id").alias("other"), (F.col("first") + F.col("o")).alias("at"))
    step = numbered.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    if same_city:
        pick = step.where(F.col("n") > k).withColumn("at", F.col("first") + (F.col("o") + F.col("rank") + 1) % F.col("n"))
    else:
        m = F.col("total") - F.col("n")
        start = F.conv(F.substring("_k", 1, 8), 16, 10).cast("bigint")
        j = (start + F.col("rank") * F.floor(m / k)) % m
        pick = step.where(m >= k).withColumn("at", F.when(j < F.col("first"), j).otherwise(j + F.col("n")))
    return pick.join(at, "at").select("sample_id", "rank", "other")


def mismatch_mcq(samples: DataFrame, same_city: bool) -> DataFrame:
    """A variant per sample with three distractors: positions A to D by hash, the correct one's letter, and the difficulty."""
    d = distractors(samples, same_city).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("others"))
    options = shuffled(F.concat(F.array("sample_id"), F.col("others")), F.col("sample_id"), "grid")
    return d.withColumn("options", options).select("sample_id", F.array_join("options", ",").alias("options"), F.substring(F.lit("ABCD"), F.array_position("options", F.col("sample_id")).cast("int"), F.lit(1)).alias("correct_pos"), F.lit("hard" if same_city else "easy").alias("difficulty"))


def mismatch_binary(samples: DataFrame, same_city: bool) -> DataFrame:
    """Two questions per sample: its own views (yes) and the first distractor's (no)."""
    d = distractors(samples, same_city).where("rank = 0").select("sample_id", "other")
    both = F.explode(F.array(F.struct(F.lit(True).alias("is_match"), F.col("sample_id").alias("shown")), F.struct(F.lit(False).alias("is_match"), F.col("other").alias("shown")))).alias("v")
    return d.select("sample_id", both).select("sample_id", "v.*", F.when(F.col("v.is_match"), "A").otherwise("B").alias("answer"), F.lit("hard" if same_city else "easy").alias("difficulty"))


def camera_direction(samples: DataFrame, views: DataFrame) -> DataFrame:
    """A question for each view that exists (sample_id, view) of samples with all four arrows; the answer is the view's place in hash order."""
    names = _texts(["along_fwd", "along_bwd", "cross_left", "cross_right"])
    return (samples.select("sample_id").join(views, "sample_id").withColumn("options", shuffled(names, F.col("sample_id"), F.col("view"), "camera"))
            .select("sample_id", "view", F.substring(F.lit("ABCD"), F.array_position("options", F.col("view")).cast("int"), F.lit(1)).alias("answer")))


def question_score() -> Column:
    """Base score of a question before its topic's use counts."""
    c, t = F.col, F.col("topic")
    return (F.when(t == "building_height", F.when((c("median_levels") > 15) | (c("median_levels") <= 2), 5).otherwise(2))
            .when(t == "land_use", F.when(c("land_use").isin("industrial", "open_space", "institutional"), 5).otherwise(3))
            .when(t == "road_type", F.when(c("road_type").isin("motorway", "trunk", "primary"), 4).otherwise(2))
            .when(t == "junction_type", F.when(c("junction") == "roundabout", 5).otherwise(3))
            .when(t.isin("road_surface", "water_proximity", "mismatch_mcq"), 4).when(t.isin("amenity_richness", "transit_density"), 2).otherwise(3))


def ranked_candidates(scored: DataFrame) -> DataFrame:
    """Each sample's questions by falling score, then by place; the first is the best before uses count."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "pos")))


def best_questions(scored: DataFrame) -> DataFrame:
    """For each sample in order, the question of highest score less three times its topic's uses so far in its city (first on a tie).

    scored: city, ord, sample_id, pos, topic, score. Uses are counted city by city, so a fold covers one city and cities run in parallel; compact rows are folded as a sorted
    stream, never held together. ``uses.best_questions_in_order`` has one counter for all samples.
    """
    import pyarrow as pa

    from terralens.operators.uses import Fold

    schema = pa.schema([("sample_id", pa.string()), ("pos", pa.int32()), ("topic", pa.string())])

    def run(batches):
        place, rows, fold, out = None, [], None, []
        for b in batches:
            for city, sample, p, t, x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if place != (city, sample):
                    if rows:
                        out.append((place[1], *fold.choose(rows)))
                    if place is None or place[0] != city:
                        fold = Fold({})
                    place, rows = (city, sample), []
                rows.append((p, x, t))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if rows:
            out.append((place[1], *fold.choose(rows)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    rows = scored.select("city", "ord", "sample_id", F.col("pos").cast("int").alias("pos"), "topic", F.col("score").cast("long").alias("score"))
    ordered = rows.repartition("city").sortWithinPartitions("city", "ord", "sample_id", "pos")
    return ordered.select("city", "sample_id", "pos", "topic", "score").mapInArrow(run, "sample_id string, pos int, topic string")


def enabled(questions: DataFrame, topics: list[str]) -> DataFrame:
    """Questions of the topics that are switched on."""
    return questions.where(F.col("topic").isin(topics))


def by_option_count(questions: DataFrame, n: int) -> DataFrame:
    return questions.where(F.size("options") == n)
