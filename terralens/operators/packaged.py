"""Checks of packaged splits: fields, files, answers, overlaps, ids, copies and cities; and manifests of what is copied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralens.operators.split import id_counts

REQUIRED = ("question_id", "sample_id", "city", "topic", "answer", "question", "options")
PAIRS = (("train", "validation"), ("train", "benchmark"), ("validation", "benchmark"))


def _texts(value: Column, kind: T.DataType) -> Column | None:
    """All texts that are values within a value, in their order, as an array that may hold nulls; None for a type without any."""
    none = F.array().cast("array<string>")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.array(value.cast("string"))
    if isinstance(kind, T.StructType):
        found = [t for f in kind.fields if (t := _texts(value.getField(f.name), f.dataType)) is not None]
        return F.concat(*(F.coalesce(t, none) for t in found)) if found else None
    if isinstance(kind, (T.ArrayType, T.MapType)):
        values, inner = (value, kind.elementType) if isinstance(kind, T.ArrayType) else (F.map_values(value), kind.valueType)
        if isinstance(inner, T.StringType):
            return values
        if _texts(F.lit(None), inner) is None:
            return None
        return F.flatten(F.transform(values, lambda x: F.coalesce(_texts(x, inner), none)))
    if isinstance(kind, T.VariantType):
        # JSON has a colon after a key's quote and none after a value's
        found = F.regexp_extract_all(F.concat(F.lit("["), F.to_json(value), F.lit("]")), F.lit(r'(?<=[:,\[])"(images/(?:[^"\\]|\\.)*+)"(?!:)'), F.lit(1))
        return F.transform(found, lambda x: F.regexp_replace(x, r'\\(.)', "$1"))
    return None


def nested_image_paths(records: DataFrame) -> Column:
    """All image references anywhere in a row, as an array: texts below images/ that are values, at any depth, never keys of maps. The schema tells where texts are, and nothing else is read."""
    found = [t for f in records.schema.fields if (t := _texts(F.col(f"`{f.name}`"), f.dataType)) is not None]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(none, *(F.coalesce(t, none) for t in found)), lambda x: x.startswith("images/")))


def path_class(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, parts[1]).otherwise("unknown")


def _check(check: str, bad: Column, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("rule"), F.when(bad, "FAIL").otherwise("PASS").alias("result"), detail.cast("string").alias("detail"))


def _rows(df: DataFrame, *checks: Column) -> DataFrame:
    return df.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def fields(df: DataFrame, label: str) -> DataFrame:
    """A file must have rows and all required fields."""
    missing = sorted(set(REQUIRED) - set(df.columns))
    return _rows(df.agg(F.count("*").alias("n")), _check(f"{label}: fields", (F.col("n") == 0) | F.lit(bool(missing)), F.concat_ws(" ", F.col("n").cast("string"), F.lit(",".join(missing)))))


def images_exist(df: DataFrame, listing: DataFrame, label: str) -> DataFrame:
    """All references must be files of the listing (path); missing ones are counted by class."""
    paths = df.select(F.explode(nested_image_paths(df)).alias("path")).distinct()
    found = paths.join(listing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    by = found.groupBy(path_class(F.col("path")).alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("gone"))
    total = by.agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"), F.array_sort(F.collect_list(F.when(F.col("gone") > 0, F.concat_ws(": ", "class", F.col("gone").cast("string"))))).alias("by"))
    some = F.coalesce("gone", F.lit(0))
    return _rows(total, _check(f"{label}: images", some > 0, F.concat(some.cast("string"), F.lit("/"), F.coalesce("n", F.lit(0)).cast("string"), F.when(some > 0, F.concat(F.lit(" ("), F.array_join("by", ", "), F.lit(")"))).otherwise(""))))


def answers(df: DataFrame, label: str, masked: bool) -> DataFrame:
    """A public file has no answer, a private one has all."""
    n = df.agg((F.count("answer") if masked else F.count_if(F.col("answer").isNull())).alias("n"))
    return _rows(n, _check(f"{label}: {'no answers' if masked else 'all answers'}", F.col("n") > 0, F.col("n")))


def overlaps(tagged: DataFrame, label: str) -> DataFrame:
    """No location may be in two splits (split: train, validation or benchmark): one aggregate for all pairs."""
    sets = tagged.groupBy("sample_id").agg(*(F.bool_or(F.col("split") == s).alias(s) for s in ("train", "validation", "benchmark")))
    n = sets.agg(*(F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in PAIRS))
    return _rows(n, *(_check(f"{label}: {a}/{b} overlap", F.col(f"{a}_{b}") > 0, F.col(f"{a}_{b}")) for a, b in PAIRS))


def unique_ids(tagged: DataFrame, label: str) -> DataFrame:
    n = id_counts(tagged, "question_id").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return _rows(n, _check(f"{label}: unique ids", F.col("n") > 0, F.col("n")))


def file_digests(files: DataFrame) -> DataFrame:
    """path and md5 of the files of a listing with content."""
    return files.select("path", F.md5("content").alias("md5"))


def same_files(digests: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Two files (path, md5) must be byte for byte the same; a file that isn't there differs."""
    n = digests.agg(F.max(F.when(F.col("path") == a, F.col("md5"))).alias("a"), F.max(F.when(F.col("path") == b, F.col("md5"))).alias("b"))
    return _rows(n, _check(f"{label}: same benchmark", ~F.coalesce(F.col("a") == F.col("b"), F.lit(False)), F.concat_ws(" ", "a", "b")))


def unseen_not_in_train(tagged: DataFrame, unseen: DataFrame, label: str) -> DataFrame:
    bad = tagged.where("split = 'train'").join(unseen.select("city").distinct(), "city", "left_semi").agg(F.array_sort(F.collect_set("city")).alias("c"))
    return _rows(bad, _check(f"{label}: unseen cities", F.size("c") > 0, F.array_join("c", ",")))


def city_sets(tagged: DataFrame, unseen: DataFrame) -> DataFrame:
    """Cities that a split lacks, one row each: every city must be in the benchmark, and every unseen city that the data have in validation or benchmark."""
    per = tagged.groupBy("city").agg(*(F.bool_or(F.col("split") == s).alias(s) for s in ("validation", "benchmark")))
    new = unseen.select("city", F.lit(True).alias("new")).distinct()
    lacks = F.array(F.when(~F.col("benchmark"), "benchmark"), F.when(F.coalesce("new", F.lit(False)) & ~F.col("validation") & ~F.col("benchmark"), "validation"))
    return per.join(new, "city", "left").select("city", F.explode(F.filter(lacks, lambda x: x.isNotNull())).alias("lacks"))


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether all rows of ``a`` are in ``b``, and how many aren't."""
    return a.subtract(b).agg((F.count("*") == 0).alias("subset"), F.count("*").alias("missing"))


def check_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("result").agg(F.count("*").alias("n"))


def suite(tagged: DataFrame, public: DataFrame, listing: DataFrame, unseen: DataFrame, label: str) -> DataFrame:
    """All checks on splits (tagged with ``split``) and the public benchmark."""
    parts = [tagged_checks(tagged, unseen, label), images_exist(tagged, listing, label), answers(public, label, True), unique_ids(tagged, label)]
    return reduce(DataFrame.unionByName, parts)


def tagged_checks(tagged: DataFrame, unseen: DataFrame, label: str) -> DataFrame:
    """``fields``, ``answers`` of the private benchmark, ``overlaps`` and ``unseen_not_in_train`` in one pass by location."""
    c = F.col
    missing = sorted(set(REQUIRED) - set(tagged.columns))
    new = unseen.select(c("city").alias("_city")).distinct()
    per = tagged.join(new, c("city") == c("_city"), "left").groupBy("sample_id").agg(
        F.count("*").alias("n"), F.count_if((c("split") == "benchmark") & c("answer").isNull()).alias("blank"), *(F.bool_or(c("split") == s).alias(s) for s in ("train", "validation", "benchmark")),
        F.collect_set(F.when(c("split") == "train", c("_city"))).alias("new"))
    # a location counts once, however many new cities it has
    first = F.coalesce(c("_k"), F.lit(0)) == 0
    total = per.select("*", F.posexplode_outer("new").alias("_k", "_new")).agg(
        *(F.coalesce(F.sum(F.when(first, c(k))), F.lit(0)).alias(k) for k in ("n", "blank")), *(F.count_if(first & c(a) & c(b)).alias(f"{a}_{b}") for a, b in PAIRS), F.array_sort(F.collect_set("_new")).alias("new"))
    return _rows(total, _check(f"{label}: fields", (c("n") == 0) | F.lit(bool(missing)), F.concat_ws(" ", c("n").cast("string"), F.lit(",".join(missing)))), _check(f"{label}: all answers", c("blank") > 0, c("blank")),
                 *(_check(f"{label}: {a}/{b} overlap", c(f"{a}_{b}") > 0, c(f"{a}_{b}")) for a, b in PAIRS), _check(f"{label}: unseen cities", F.size("new") > 0, F.array_join("new", ",")))


def copy_manifest(paths: DataFrame, sources: DataFrame, present: DataFrame) -> DataFrame:
    """path, status (present, copied or missing) and the folder to copy from: files already at the target are left, others come from the first folder that has them."""
    best = sources.groupBy("path").agg(F.min("dir_ord").alias("dir_ord"))
    there = present.select("path", F.lit(True).alias("there")).distinct()
    rows = paths.select("path").distinct().join(there, "path", "left").join(best, "path", "left")
    status = F.when(F.col("there"), "present").when(F.col("dir_ord").isNotNull(), "copied").otherwise("missing")
    return rows.select("path", status.alias("status"), F.when(F.col("there").isNull(), F.col("dir_ord")).alias("dir_ord"))


def copy_counts(manifest: DataFrame) -> DataFrame:
    """Files that are at the target in the end, and missing ones."""
    return manifest.agg(F.count_if(F.col("status") != "missing").alias("copied"), F.count_if(F.col("status") == "missing").alias("missing"))


def package_variation(packages: DataFrame) -> DataFrame:
    """Distinct images and questions of each package (package, question_id, paths)."""
    per = packages.groupBy("package").agg(F.countDistinct("question_id").alias("questions"))
    images = packages.select("package", F.explode("paths").alias("path")).groupBy("package").agg(F.countDistinct("path").alias("images"))
    return per.join(images, "package", "left").select("package", "questions", F.coalesce("images", F.lit(0)).alias("images"))
