"""Packages appear whole or not at all."""

import os

import pytest

from terralens.sources import packages


def made(spark, tmp_path, n=40):
    rows = []
    for k in range(n):
        p = tmp_path / "in" / f"{k % 3}" / f"é {k}.bin"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bytes([k]) * (k * 1000))
        rows.append((f"images/{k % 4}/{k}.bin", f"file://{str(p).replace(' ', '%20')}"))
    return spark.createDataFrame(rows, "path string, source string").repartition(6)


def inside(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if "/_files" not in d}


def test_copy_replace_move_and_dry_run(spark, tmp_path):
    files, out = made(spark, tmp_path), tmp_path / "out" / "package"
    want = {f"images/{k % 4}/{k}.bin": k * 1000 for k in range(40)}
    dry = {r.path: r.bytes for r in packages.publish(files, f"file://{out}", dry_run=True).collect()}
    assert dry == want and not out.parent.exists()
    got = {r.path: r.bytes for r in packages.publish(files.union(files), f"file://{out}").collect()}
    assert got == want == inside(out) and os.listdir(out.parent) == ["package"] and not (out / "_partial").exists()
    with pytest.raises(FileExistsError):
        packages.publish(files, f"file://{out}")
    few = files.where("path like 'images/1/%'")
    packages.publish(few, f"file://{out}", replace=True, move=True)
    assert inside(out) == {k: v for k, v in want.items() if k.startswith("images/1/")} and os.listdir(out.parent) == ["package"]
    assert len(inside(tmp_path / "in")) == 30
    packages.remove_sources(packages.listed(spark, f"file://{out}"))
    none = packages.publish(files.limit(0), f"file://{tmp_path}/empty")
    assert none.count() == 0 and (tmp_path / "empty").is_dir()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    files, out = made(spark, tmp_path), tmp_path / "out" / "package"
    bad = files.union(spark.createDataFrame([("images/x", f"file://{tmp_path}/missing"), (None, "file:///a"), ("b", None)], files.schema))
    with pytest.raises(Exception, match="missing"):
        packages.publish(bad, f"file://{out}")
    assert not out.exists() and os.listdir(tmp_path) and not [x for x in os.listdir(tmp_path / "out")]
    dry = {r.path: r.bytes for r in packages.publish(bad, f"file://{out}", dry_run=True).collect()}
    assert dry["images/x"] is None and len(dry) == 41
    packages.publish(files, f"file://{out}")
    with pytest.raises(Exception, match="missing"):
        packages.publish(bad, f"file://{out}", replace=True)
    assert len(inside(out)) == 40 and os.listdir(out.parent) == ["package"]


@pytest.mark.parametrize("path", ["../x", "/x", "a/../../x", "_files/x", "."])
def test_paths_stay_inside(path):
    with pytest.raises(ValueError):
        packages._inside(path)


def test_lists_of_attempts_that_were_not_kept_go(tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    w = packages._Writer({"path": f"file://{tmp_path}/out"}, False)
    rows = [("x/a", f"file://{tmp_path}/a")]
    lost, kept = w.write(iter(rows)), w.write(iter(rows))
    assert lost.listed != kept.listed and w.write(iter([])).listed is None
    w.commit([kept, None])
    assert os.listdir(tmp_path / "out" / "_files") == [kept.listed] and (tmp_path / "out" / "x" / "a").read_bytes() == b"abc"
