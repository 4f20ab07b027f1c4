import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralens.operators.spatial import road_bearings, spread_stops
from terralens.sources import files, sinks
from terralens.streaming import upsert

ROW = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("run", T.IntegerType()), T.StructField("v", T.StringType())])


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"sample_id": "a", "run": 1}\n\n{bad\n{"run": 2}\n{"sample_id": "", "run": 3}\n{"sample_id": "b", "run": 4, "v": null}\n')
    rows, skipped = files.jsonl_tolerant(spark, str(tmp_path / "r.jsonl"), ROW)
    assert sorted(r.sample_id for r in rows.collect()) == ["a", "b"] and skipped.first().skipped == 3
    assert files.jsonl_dropping(spark, str(tmp_path / "r.jsonl"), ROW).where("run > 0").count() == 4


def test_map_extracts(spark, tmp_path):
    (tmp_path / "roads.json").write_text(json.dumps({"elements": [{"id": 1, "tags": {"name": "A", "highway": "primary"}, "geometry": [{"lat": 0.0, "lon": 0.0}, {"lat": 1.0, "lon": 0.0}]}, {"id": 2, "geometry": [{"lat": 1.0, "lon": 1.0}]}]}))
    nodes = files.road_nodes(spark, str(tmp_path / "roads.json"))
    assert sorted((r.way, r.pos, r.road_name, r.highway_type) for r in nodes.collect()) == [(0, 0, "A", "primary"), (0, 1, "A", "primary"), (1, 0, "unnamed", "unknown")]
    assert sorted((r.pos, r.bearing) for r in road_bearings(nodes).collect()) == [(0, 0.0), (1, 0.0)]
    (tmp_path / "c.json").write_text(json.dumps({"elements": [{"lat": 1.0, "lon": 2.0, "center": {"lat": 5.0}, "tags": {"building": "yes", "amenity": "cafe"}}, {"center": {"lat": 3.0, "lon": 4.0}, "tags": {"leisure": "park"}}, {"tags": {"amenity": "bar"}}]}))
    e = files.categories(files.context_elements(spark, str(tmp_path / "c.json")))
    assert sorted((r.lat, r.lon, r.category) for r in e.collect()) == [(1.0, 2.0, "amenity"), (1.0, 2.0, "building"), (3.0, 4.0, "park")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q1", "train", "A", [1, 2]), ("q2", "benchmark", "B", None)], "question_id string, split string, answer string, x array<int>")
    sinks.write_jsonl(sinks.public_benchmark(df), str(tmp_path / "j"))
    lines = [json.loads(x) for x in (r.value for r in spark.read.text(str(tmp_path / "j")).collect())]
    assert all("answer" in x and x["answer"] is None for x in lines)
    sinks.write_csv(df, str(tmp_path / "c"))
    back = files.csv_samples(spark, str(tmp_path / "c"), T.StructType([T.StructField(c, T.StringType()) for c in df.columns]), {"x": "array<int>"})
    assert {r.question_id: r.x for r in back.collect()} == {"q1": [1, 2], "q2": None}
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("split = 'train'").count() == 1


def test_listing(spark, tmp_path):
    for k, names in enumerate((["a.png"], ["a.png", "sub/b.png"])):
        for n in names:
            p = tmp_path / f"d{k}" / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x" * (k + 1))
    got = files.image_listing(spark, [str(tmp_path / "d0"), str(tmp_path / "d1")])
    assert sorted(map(tuple, got.collect())) == [("a.png", 0, 1), ("a.png", 1, 2), ("sub/b.png", 1, 2)]


def test_stream_upsert(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z"), ("", 4, "n"), ("b", 0, "old")]):
        spark.createDataFrame(rows, ROW).write.mode("append").json(src)
        upsert.upsert_to_parquet(spark.readStream.schema(ROW).json(src), "sample_id", "run", out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, upsert.read_merged(spark, out, "sample_id", "run").collect())) == [("a", 3, "z"), ("b", 1, "y")]


def test_spread_stops_is_greedy(spark):
    df = spark.createDataFrame([([(2, 0.00025, 0.0), (0, 0.0, 0.0), (1, 0.00015, 0.0)],)], "s array<struct<ord:int,lat:double,lon:double>>")
    assert [x.ord for x in df.select(spread_stops(F.col("s")).alias("k")).first().k] == [0, 2]
