"""How often rows are shuffled, and that combined checks give what the single ones give."""

import re

import pytest
from pyspark.sql import functions as F

from terralens.plans.catalog import QUERIES


@pytest.mark.parametrize("name, most", [("split_pipeline", 1), ("dedup_per_location", 1), ("nested_paths", 1), ("stratified_downsample", 3)])
def test_questions_are_shuffled_once(spark, name, most):
    """Lines are dealt by location once for each pass; no question is shuffled to be nested, numbered, chosen or joined."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert sum("_sample#" in x for x in exchanges) <= most
    assert not any("topic#" in x and "sample_id#" in x or "question_id#" in x for x in exchanges)


@pytest.mark.parametrize("name", ["picture_means", "build_record", "run_summary"])
def test_samples_are_dealt_before_work(spark, name):
    """A table of one row group is one task, so nothing is done with samples before they are dealt."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(sample_id#\d+, \d+\), REPARTITION_BY_NUM", plan)


def test_ids_are_counted_once_dealt(spark):
    from terralens.operators.split import duplicate_ids

    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "question_id string")
    assert tuple(duplicate_ids(df).first()) == (2, 6) and tuple(duplicate_ids(df.where("question_id = ''")).first()) == (0, 0)
    assert "REPARTITION_BY_NUM" in duplicate_ids(df)._jdf.queryExecution().executedPlan().toString()


def test_checks_of_a_location_in_two_splits_and_cities(spark):
    """One pass gives what the single checks give; a location with several new cities counts once."""
    from terralens.operators import packaged as P

    rows = [("q1", "a", "X", "t", None, "benchmark"), ("q1", "a", "Y", "t", "A", "train"), ("q3", "a", "X", "t", "A", "train"), (None, "b", "Z", "t", None, "train"), ("q5", None, None, "t", None, "validation"), ("q6", None, "Z", "t", "B", "benchmark")]
    t = spark.createDataFrame([(*r, "q", {"A": "images/a.png"}) for r in rows], "question_id string, sample_id string, city string, topic string, answer string, split string, question string, options map<string,string>")
    new = spark.createDataFrame([("X",), ("Y",), (None,)], "city string")
    single = [P.fields(t, "l"), P.answers(t.where("split = 'benchmark'"), "l", False), P.overlaps(t, "l"), P.unseen_not_in_train(t, new, "l")]
    for some in (None, "split = 'none'"):
        parts = single if some is None else [P.fields(t.where(some), "l"), P.answers(t.where(some), "l", False), P.overlaps(t.where(some), "l"), P.unseen_not_in_train(t.where(some), new, "l")]
        want = sorted(tuple(r) for p in parts for r in p.collect())
        assert sorted(tuple(r) for r in P.tagged_checks(t if some is None else t.where(some), new, "l").collect()) == want
    odd = t.select(F.array(F.map_from_arrays(F.array(F.lit("images/key")), F.array(F.lit("images/a\nb"), ))).alias("x"), F.lit(3).alias("n"), F.struct(F.array(F.lit(None).cast("string"), F.lit("images/c")).alias("y"), F.lit(1).alias("images/d")).alias("images/z"))
    assert odd.select(P.nested_image_paths(odd)).first()[0] == ["images/a\nb", "images/c"]
    assert "to_json" not in odd.select(P.nested_image_paths(odd))._jdf.queryExecution().optimizedPlan().toString()
