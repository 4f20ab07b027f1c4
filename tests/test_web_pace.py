"""Requests as rows: the rate of a host over all tasks, and a cache that goes on where it stopped."""

import http.server
import threading
import time

import pytest

from terralens.sources import web


@pytest.fixture
def server():
    seen: list[tuple[float, str]] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((time.monotonic(), self.path))
            self.send_response(500 if self.path.startswith("/bad") else 200)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *a):
            pass
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_pace_waits_for_each_host():
    now, waits = [0.0], []
    p = web.Pace(2.0, clock=lambda: now[0], pause=waits.append)
    for host in ("a", "b", "a", "a"):
        p.wait(host)
    assert waits == [0.5, 1.0]
    now[0] = 10.0
    p.wait("a")
    assert len(waits) == 2


@pytest.mark.parametrize("lanes", [1, 3])
def test_the_rate_holds_over_tasks(spark, server, lanes):
    base, seen = server
    asked = spark.createDataFrame([(f"k{i}", f"{base}/{i}") for i in range(24)] + [("none", None)], "key string, url string").repartition(6)
    got = {r.key: (r.status, bytes(r.body or b"")) for r in web.answers(asked, rate=20.0, lanes=lanes).collect()}
    assert got == {f"k{i}": (200, f"/{i}".encode()) for i in range(24)} | {"none": (None, b"")}
    times = sorted(t for t, _ in seen)
    assert len(times) == 24
    # a second's worth of requests, and the first of each lane at once
    assert all(times[i + 10] - times[i] > (10 - lanes) / 20 * 0.8 for i in range(14))


def test_many_requests_and_a_second_run(spark, server, tmp_path):
    base, seen = server
    cache = str(tmp_path / "cache")
    asked = spark.range(600).selectExpr("concat('k', id) as key", f"concat('{base}/', case when id % 50 = 0 then 'bad' else 'ok' end, id) as url")
    first = web.cached(spark, asked, cache, rounds=3)
    assert {r.key for r in first.select("key").collect()} == {f"k{i}" for i in range(600) if i % 50} and len(seen) == 600
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    again = web.cached(spark, asked.union(asked), cache)
    assert again.count() == 588 and len(seen) == 612
    assert web.cached(spark, asked.limit(0), str(tmp_path / "other")).count() == 0
