import os
import re

import pytest

from terralens.llm import scratch


def test_temporary_tables_go(spark):
    kept = scratch.save(spark.range(3), "kept")
    with scratch.temporary(spark):
        inner = scratch.save(spark.range(5), "inner")
        path = re.sub("^file:/+", "/", inner.inputFiles()[0])
        assert inner.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        sparkContext = Context
        conf = type("F", (), {"get": staticmethod(lambda k, d: None)})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_addresses_are_whole(spark):
    assert scratch.shared_dir(spark).startswith("file:/")


def test_tables_on_the_way_go(spark):
    seen = []

    def make():
        seen.append(scratch.save(spark.range(4), "inner"))
        return seen[0].where("id > 1")
    out = scratch.save_alone(spark, make, "outer")
    assert out.count() == 2 and os.path.exists(re.sub("^file:/+", "/", out.inputFiles()[0]))
    with pytest.raises(Exception):
        seen[0].count()
