"""What reaches outside: services, numbered lines, copies, pictures."""

import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralens.operators import packaged, pixels, spatial
from terralens.sources import files, sinks, web

ROW = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("run", T.IntegerType())])


@pytest.fixture(scope="module")
def server():
    seen: dict[str, int] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            status = 429 if self.path.startswith("/busy") and seen[self.path] < 3 else 404 if self.path.startswith("/none") else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"status": "OK", "date": "2024-01", "location": {"lat": 1.5, "lng": 2.5}}).encode() if self.path.startswith("/pano") else b'{"status": "ZERO_RESULTS"}')

        def log_message(self, *a):
            pass
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_requests_are_repeated_and_cached(spark, server, tmp_path):
    base, seen = server
    asked = [("a", f"{base}/busy/1"), ("b", f"{base}/none"), ("c", f"{base}/pano/1")]
    got = {r.key: r for r in web.responses(spark, asked, waitScale="0.0001").collect()}
    assert {k: r.status for k, r in got.items()} == {"a": 200, "b": 404, "c": 200} and seen["/busy/1"] == 3
    cache = str(tmp_path / "cache")
    first = {r.key for r in web.cached(spark, asked, cache, waitScale="0.0001").collect()}
    before = dict(seen)
    again = {r.key: r.status for r in web.cached(spark, asked[::2], cache).collect()}
    assert first == {"a", "c"} == set(again) and seen == before
    p = {r.key: r for r in web.panoramas(web.responses(spark, [("x", f"{base}/pano/2"), ("y", f"{base}/zero")])).collect()}
    assert (p["x"].status, p["x"].date, p["x"].lat, p["x"].lon) == ("OK", "2024-01", 1.5, 2.5) and (p["y"].status, p["y"].lat) == ("ZERO_RESULTS", None)


def test_waits_grow_and_attempts_end():
    waits = []

    class Refused(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(504)
            self.end_headers()

        def log_message(self, *a):
            pass
    s = http.server.HTTPServer(("127.0.0.1", 0), Refused)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    assert web.fetch(f"http://127.0.0.1:{s.server_port}/", pause=waits.append)[0] == 504
    s.shutdown()
    assert waits == [60.0, 120.0]


def test_survey_answers(spark):
    rows = spark.createDataFrame([("a", b'[["NAME", "INCOME", "PEOPLE"], ["Tract 1", "-666666666", "4000"]]'), ("b", b"")], "key string, body binary")
    got = {r.key: r["values"] for r in web.surveys(rows).collect()}
    assert got == {"a": {"NAME": "Tract 1", "INCOME": None, "PEOPLE": "4000"}, "b": None}


def test_median_composite(spark):
    rows = [("t", 0, "r", float(v), c) for v, c in ((1000, 5.0), (3000, 1.0), (9000, 50.0), (2000, 19.0))] + [("t", 1, "r", 500.0, 20.0)]
    got = {r.pixel: (round(r.value, 6), r.scenes) for r in web.median_composite(spark.createDataFrame(rows, "tile string, pixel int, band string, value double, cloud double")).collect()}
    assert got == {0: (0.2, 3)}


def test_numbered_lines(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("".join(f'{{"sample_id": "{"" if k % 3 else "s" + str(k)}", "run": {k}}}\n' if k % 5 else "\n" if k % 2 else "{bad\n" for k in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.numbered_lines(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 1
        assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, 4001))
        got = {r.run: r.sample_id for r in files.jsonl_numbered(spark, str(path), ROW).collect()}
        assert got == {k: f"s{k}" if k % 3 == 0 else f"unknown_{k}" for k in range(1, 4001) if k % 5}
        with pytest.raises(Exception, match="line 10 "):
            files.jsonl_strict(spark, str(path), ROW).where("run is not null").coalesce(1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    good = tmp_path / "good.jsonl"
    good.write_text('{"sample_id": "a", "run": 1}\n\n{"sample_id": "b", "run": 2}\n')
    assert files.jsonl_strict(spark, str(good), ROW).count() == 2


def test_copies_and_reports(spark, tmp_path):
    for k, names in enumerate((["images/a.png"], ["images/a.png", "images/b.png"])):
        for n in names:
            p = tmp_path / f"d{k}" / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(bytes([k]) * (10 + k))
    folders = [f"file://{tmp_path}/d{k}" for k in range(2)]
    listing = files.image_listing(spark, folders)
    paths = spark.createDataFrame([("images/a.png",), ("images/b.png",), ("images/c.png",)], "path string")
    manifest = packaged.copy_manifest(paths, listing, paths.limit(0))
    done = {r.path: r.bytes for r in sinks.copy_files(manifest, folders, f"file://{tmp_path}/out").collect()}
    assert done == {"images/a.png": 10, "images/b.png": 11} and (tmp_path / "out/images/a.png").read_bytes() == b"\0" * 10
    assert tuple(packaged.copy_counts(packaged.copy_manifest(paths, listing, files.image_listing(spark, [f"file://{tmp_path}/out"]))).first()) == (2, 1)
    digests = packaged.file_digests(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "out")))
    a, b = sorted(r.path for r in digests.collect())
    assert packaged.same_files(digests, a, a, "x").first().result == "PASS" and packaged.same_files(digests, a, b, "x").first().result == packaged.same_files(digests, a, "gone", "x").first().result == "FAIL"
    sinks.write_lines(spark.createDataFrame([(2, "b"), (1, "a"), (10, "c")], "ord int, line string"), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a", "b", "c"]
    row = spark.createDataFrame([("s", "c", "t", "easy", "A", 1, 0, None, "pass", "")], "sample_id string, city string, topic string, difficulty string, answer string, metadata_complete int, plausibility_flag int, images_ok int, overall_quality string, flag_reasons string")
    sinks.write_quality(row.select(*reversed(row.columns)), str(tmp_path / "q"))
    assert {r.value for r in spark.read.text(str(tmp_path / "q")).collect()} == {",".join(sinks.QUALITY_COLUMNS), "s,c,t,easy,A,1,0,,pass,"}


def test_paths_at_any_depth_but_no_keys(spark):
    df = spark.createDataFrame([({"images/key.png": "images/v.png"}, [["images/l.png"]], 'say "images/no.png" ,"images/no.png"', "images/é \\x.png")], "m map<string,string>, l array<array<string>>, t string, u string")
    assert sorted(df.select(packaged.nested_image_paths(df)).first()[0]) == ["images/l.png", "images/v.png", "images/é \\x.png"]


def test_pictures(spark):
    rng = np.random.RandomState(1)
    pics = [rng.randint(0, 256, (40, 60, 3)).astype(np.uint8) for _ in range(4)]
    rows = [("k", i, 60, 40, p.tobytes()) for i, p in enumerate(pics)] + [("three", i, 60, 40, p.tobytes()) for i, p in enumerate(pics[:3])]
    df = spark.createDataFrame(rows, "key string, place int, width int, height int, rgb binary")
    got = pixels.grids(df, 20, ("A", "B", "C", "D")).collect()
    assert [r.key for r in got] == ["k"] and (got[0].width, got[0].height) == (40, 40)
    canvas = np.frombuffer(got[0].rgb, np.uint8).reshape(40, 40, 3)
    plain = pixels.grid(pics, 20)
    for k in range(4):
        y, x = divmod(k, 2)
        off = np.abs(plain[20 * y : 20 * y + 20, 20 * x : 20 * x + 20].astype(int) - by_weights(pics[k], 20, 20))
        assert off.max() <= 1 and (off == 0).mean() > 0.99  # halves may be rounded either way
    assert (canvas != plain).any() and (pixels.grid(pics, labels=["A", "", "", ""])[9:23, 7:17].reshape(-1, 3).max(axis=0) == 255).all()
    one = df.where("place = 0 and key = 'k'").drop("place")
    dot = np.frombuffer(pixels.dots(one).first().rgb, np.uint8).reshape(40, 60, 3)
    for y in range(40):
        for x in range(60):
            d2 = (x - 30) ** 2 + (y - 20) ** 2
            assert tuple(dot[y, x]) == ((255, 0, 0) if d2 <= 64 else (255, 255, 255) if d2 <= 100 else tuple(pics[0][y, x]))
    big = spark.createDataFrame([("k", 200, 200, bytes(200 * 200 * 3), b) for b in (0.0, 90.0)] + [("n", 200, 200, bytes(120000), None)], "key string, width int, height int, rgb binary, bearing double")
    up, right = (np.frombuffer(r.rgb, np.uint8).reshape(200, 200, 3)[..., 0] for r in pixels.arrows(big).orderBy("key").collect())
    assert up[25, 100] == 255 and up[100, 175] == 0 and right[100, 175] == 255 and right[25, 100] == 0 and (up.T[::-1].T == up).mean() > 0.99
    small = pixels.resized(one, 30).first()
    assert (small.width, small.height, len(small.rgb)) == (30, 20, 1800)
    means = pixels.channel_means(one).first()
    assert np.allclose([means.r, means.g, means.b], pics[0].reshape(-1, 3).mean(axis=0))


def cubic(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0


def by_weights(p, width, height):
    """Each target pixel as a weighted sum, one after the other: across, then down."""
    def line(row, n):
        scale, out = len(row) / n, []
        for t in range(n):
            mid, wide = (t + 0.5) * scale, max(scale, 1)
            at = range(max(int(mid - 2 * wide + 0.5), 0), min(int(mid + 2 * wide + 0.5), len(row)))
            w = [cubic((k - mid + 0.5) / wide) for k in at]
            out.append([min(255, max(0, int(np.floor(sum(a * int(row[k][c]) for a, k in zip(w, at)) / sum(w) + 0.5)))) for c in range(3)])
        return np.array(out)
    across = np.stack([line(row, width) for row in p])
    return np.stack([line(col, height) for col in across.swapaxes(0, 1)]).swapaxes(0, 1)


def test_lower_and_upper_places(spark):
    df = spark.createDataFrame([([(3, 1), (1, 2)],), ([],)], "p array<struct<v:int,n:bigint>>")
    assert [r.m for r in df.select(spatial.upper_median_of_counts(F.col("p")).alias("m")).collect()] == [1.0, None]


def test_places_and_blocks(spark):
    rows = [("a", b'{"display_name": "x", "address": {"suburb": "", "city_district": "D", "country": "C"}}'), ("b", b'{"Block": {"FIPS": "360610076001234"}}'), ("c", b"{}")]
    df = spark.createDataFrame(rows, "key string, body binary")
    assert {r.key: tuple(r)[1:] for r in web.addresses(df).collect()} == {"a": ("x", "D", "C"), "b": (None, "", ""), "c": (None, "", "")}
    assert {r.key: tuple(r)[1:] for r in web.census_blocks(df).collect()} == {"a": (None, None, None), "b": ("36", "061", "007600"), "c": (None, None, None)}
