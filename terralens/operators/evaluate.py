"""Evaluation of predictions, training records and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.operators.stats import cumulated


def accuracy(p: DataFrame) -> DataFrame:
    """Share of predictions that start with the answer: overall, by topic and by difficulty, in one pass."""
    right = F.startswith(p["predicted"], p["gold"]).cast("int")
    keys = F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("value")), F.struct(F.lit("topic").alias("level"), F.col("topic").alias("value")), F.struct(F.lit("difficulty").alias("level"), F.col("difficulty").alias("value")))).alias("k")
    return p.select(keys, F.coalesce(right, F.lit(0)).alias("r")).groupBy("k.level", "k.value").agg(F.count("*").alias("n"), F.sum("r").alias("correct"), F.round(F.avg("r"), 6).alias("accuracy"))


def floor_quantiles(df: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Element floor(n * share) of the sorted values, from counts of distinct values."""
    cum = cumulated(df.select(F.col(value).alias("v")), "v")
    wanted = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    at = cum.select("v", "n", "upto", "total", wanted).withColumn("k", F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1))
    return at.where("k >= upto - n and k < upto").select("share", F.col("v").alias("value"))


def length_bucket(length: Column) -> Column:
    """Next of the context sizes; at least 8192."""
    return F.when(length <= 8192, 8192).when(length <= 16384, 16384).otherwise(32768)


def epoch_deltas(acc: DataFrame, baseline: float) -> DataFrame:
    """Change of each topic's accuracy (topic, epoch, accuracy) to the epoch before, or to the baseline; falls of over two points are marked."""
    w = Window.partitionBy("topic").orderBy("epoch")
    d = F.col("accuracy") - F.lag("accuracy", 1, baseline).over(w)
    return acc.withColumn("delta", F.round(d, 6)).withColumn("fell", d < -0.02)


def against_baseline(accuracy: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each topic's accuracy and its change to a baseline (topic, accuracy), in which a missing topic counts as 0."""
    base = baseline.select("topic", F.col("accuracy").alias("base"))
    return accuracy.join(base, "topic", "left").select("topic", "accuracy", F.round(F.col("accuracy") - F.coalesce("base", F.lit(0.0)), 6).alias("delta"))


def batch_plan(rows: Column, batch: int) -> Column:
    """(effective, accumulate, steps): a thousandth of the rows, from 8 to 32, in batches of ``batch``."""
    wanted = F.greatest(F.lit(8), F.least(F.lit(32), F.floor(rows / 1000))).cast("int")
    times = F.greatest(F.lit(1), F.floor(wanted / batch)).cast("int")
    return F.struct((times * batch).alias("effective"), times.alias("accumulate"), F.ceil(rows / (times * batch)).alias("steps"))


ARROW, COMPOSITE, BINARY, MEGA = "satellite_arrow", "streetview_composite", "streetview_binary", "streetview_mega"


def shown_images(r: DataFrame) -> Column:
    """References of the images of a training record, in order, by its image_mode: arrow options A to D; the marked image and four views, its own or the other
    location's; the marked image and the grid; else the primary image. r: image_mode, primary, satellite, views (array), negative (array), options (map)."""
    c = F.col
    arrows = F.filter(F.transform(F.array(*map(F.lit, "ABCD")), lambda k: F.try_element_at(c("options"), k)), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    mode = F.coalesce("image_mode", F.lit("satellite_only"))
    return (F.when(mode == ARROW, F.coalesce(arrows, none)).when(mode == COMPOSITE, F.concat(F.array("satellite"), F.coalesce("views", none))).when(mode == BINARY, F.concat(F.array("satellite"), F.coalesce("negative", none)))
            .when(mode == MEGA, F.array("satellite", "primary")).otherwise(F.array("primary")))


def training_record(text: Column, images: Column, answer: Column, system: str) -> Column:
    """The messages of a record: system, user (text, then images by reference) and assistant."""
    part = lambda kind, t, i: F.struct(F.lit(kind).alias("type"), t.alias("text"), i.alias("image"))
    null = F.lit(None).cast("string")
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.concat(F.array(part("text", text, null)), F.transform(images, lambda i: part("image", null, i)))
    return F.array(said("system", F.array(part("text", F.lit(system), null))), said("user", user), said("assistant", F.array(part("text", answer, null))))


def prompt(question: Column, options: Column) -> Column:
    """Question and lettered options as one text."""
    return F.concat_ws("\n", question, F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(". "), o)), "\n"))


def compare(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Base and tuned answers of each question side by side, matched by question, and what tuning changed."""
    b = base.select("question_id", F.col("predicted").alias("base"))
    right = lambda x: F.coalesce(F.startswith(F.col(x), F.col("gold")), F.lit(False))
    change = F.when(right("base") == right("tuned"), "same").when(right("tuned"), "better").otherwise("worse")
    return b.join(tuned.select("question_id", F.col("predicted").alias("tuned"), "gold"), "question_id").select("question_id", right("base").alias("base_right"), right("tuned").alias("tuned_right"), change.alias("change"))


def chat_messages(turns: DataFrame) -> DataFrame:
    """One record per conversation with its messages in order."""
    each = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(each.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content"))).alias("messages"))
