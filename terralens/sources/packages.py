"""Packages of files, copied or moved in two phases.

Tasks copy files into a fresh folder beside the target and list what they did; only the commit, when all tasks are done, gives the folder the target's name, by one
renaming. So a reader sees the old package or the new one. A task that fails and is repeated writes the same names anew, and only lists of the attempts that were committed remain.
Moved files are deleted at their old places after that, by a job over the committed lists that can be repeated. The driver holds a list's name for each task and no paths.
The target must be in a store that renames folders (local, HDFS).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Folder of a package with the lists of its files, and one for files that aren't whole yet.
LISTS, PARTIAL = "_files", "_partial"
_LISTED = "path string, source string, bytes long"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and place of an address; escapes in it count, and letters that need one get it."""
    return fs.FileSystem.from_uri(quote(uri.rstrip("/"), safe="%:/?#[]@!$&'()*+,;=~"))


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def _copied(source: str, store: fs.FileSystem, partial: str, to: str) -> int:
    here, a = _at(source)
    n = 0
    with here.open_input_stream(a, compression=None) as i, store.open_output_stream(partial, compression=None) as o:
        while piece := i.read(1 << 20):
            o.write(piece)
            n += len(piece)
    store.create_dir(posixpath.dirname(to), recursive=True)
    store.move(partial, to)
    return n


def _inside(path: str) -> str:
    """A path that stays in the package."""
    clean = posixpath.normpath(path)
    if clean.startswith(("/", "..")) or clean.split("/")[0] in (LISTS, PARTIAL, "."):
        raise ValueError(f"{path!r} is no place in a package")
    return clean


@dataclass
class _Done(WriterCommitMessage):
    listed: str | None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, replace: bool):
        self.target, self.replace = options["path"].rstrip("/"), replace
        self.fresh = f"{self.target}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Done:
        store, base = _at(self.fresh)
        listed = f"{uuid.uuid4().hex}.jsonl"
        out = None
        for path, source in iterator:
            if out is None:
                for d in (LISTS, PARTIAL):
                    store.create_dir(f"{base}/{d}", recursive=True)
                out = store.open_output_stream(f"{base}/{LISTS}/{listed}", compression=None)
            clean = _inside(path)
            n = _copied(source, store, f"{base}/{PARTIAL}/{uuid.uuid4().hex}", f"{base}/{clean}")
            out.write((json.dumps({"path": clean, "source": source, "bytes": n}) + "\n").encode())
        if out is None:
            return _Done(None)
        out.close()
        return _Done(listed)

    def commit(self, messages: list) -> None:
        store, fresh = _at(self.fresh)
        target = _at(self.target)[1]
        kept = {m.listed for m in messages if m is not None and m.listed}
        store.create_dir(f"{fresh}/{LISTS}", recursive=True)
        for info in store.get_file_info(fs.FileSelector(f"{fresh}/{LISTS}")):
            if posixpath.basename(info.path) not in kept:
                store.delete_file(info.path)
        if _exists(store, f"{fresh}/{PARTIAL}"):
            store.delete_dir(f"{fresh}/{PARTIAL}")
        old = None
        if _exists(store, target):
            if not self.replace:
                store.delete_dir(fresh)
                raise FileExistsError(self.target)
            old = f"{fresh}.old"
            store.move(target, old)
        store.move(fresh, target)
        if old:
            store.delete_dir(old)

    def abort(self, messages: list) -> None:
        store, fresh = _at(self.fresh)
        if _exists(store, fresh):
            store.delete_dir(fresh)


class PackageSink(DataSource):
    """Rows of path (in the package) and source (address of a file). Option: path, the package's address."""

    @classmethod
    def name(cls) -> str:
        return "file_package"

    def schema(self) -> str:
        return "path string, source string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def _planned(files: DataFrame) -> DataFrame:
    """One source for each path, the least."""
    return files.where("path is not null and source is not null").groupBy("path").agg(F.min("source").alias("source"))


def planned_sizes(files: DataFrame) -> DataFrame:
    """What ``publish`` would copy: path, source and bytes, null for a source that isn't there. Nothing is written."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = []
            for source in b.column(1).to_pylist():
                store, at = _at(source)
                info = store.get_file_info(at)
                sizes.append(info.size if info.type == fs.FileType.File else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["path", "source", "bytes"])
    return _planned(files).mapInArrow(run, _LISTED)


def listed(spark: SparkSession, target: str) -> DataFrame:
    """path, source and bytes of a package's files, as committed."""
    return spark.read.schema(_LISTED).json(f"{target.rstrip('/')}/{LISTS}")


def publish(files: DataFrame, target: str, *, replace: bool = False, move: bool = False, dry_run: bool = False) -> DataFrame:
    """Makes the package ``target`` of rows (path, source) and returns its list: path, source, bytes.

    A package that is there already is an error unless ``replace``. A missing source fails the whole package, and nothing appears. ``move`` deletes the sources once the package is committed.
    ``dry_run``: only the list of what would be done. No rows make an empty package. Of two sources for a path the least is taken; rows with a null are none.
    """
    spark = files.sparkSession
    if dry_run:
        return planned_sizes(files)
    store, at = _at(target)
    if not replace and _exists(store, at):
        raise FileExistsError(target)
    spark.dataSource.register(PackageSink)
    # a path's hash, so that a folder's files are dealt over all tasks
    rows = _planned(files).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    rows.write.format("file_package").mode("overwrite" if replace else "append").option("path", target).save()
    done = listed(spark, target)
    if move:
        remove_sources(done)
    return done


def remove_sources(done: DataFrame) -> None:
    """Deletes the sources of a committed list; those that are gone already are passed over, so it can be repeated."""
    def run(rows) -> None:
        for r in rows:
            store, at = _at(r.source)
            if _exists(store, at):
                store.delete_file(at)
    done.select("source").foreachPartition(run)
