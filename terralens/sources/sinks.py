"""Writers of records, splits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True, escape='"')


def public_benchmark(df: DataFrame) -> DataFrame:
    """The benchmark without answers."""
    return df.withColumn("answer", F.lit(None).cast("string"))


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each split, questions in the order of their ids within files."""
    df.repartitionByRange("split", "question_id").sortWithinPartitions("split", "question_id").write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(path)


#: Fixed order of the quality report's columns.
QUALITY_COLUMNS = ("sample_id", "city", "topic", "difficulty", "answer", "metadata_complete", "plausibility_flag", "images_ok", "overall_quality", "flag_reasons")


def write_quality(rows: DataFrame, path: str) -> None:
    """The quality report as CSV; an unknown image check is an empty field."""
    rows.select(*QUALITY_COLUMNS).write.mode("overwrite").option("emptyValue", "").csv(path, header=True, escape='"')


def write_lines(lines: DataFrame, path: str) -> None:
    """A report (ord, line) as one text file. Reports are short: they are aggregates."""
    lines.coalesce(1).sortWithinPartitions("ord", "line").select("line").write.mode("overwrite").text(path)


def copy_files(manifest: DataFrame, folders: list[str], target: str) -> DataFrame:
    """Copies the files that a manifest (path, status, dir_ord) marks as copied, on the executors, and returns path and bytes.

    Addresses are those of a shared store (local paths on one machine). A file appears under its name when it is whole, so a task can be repeated.
    """
    def run(batches):
        import posixpath
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            done = []
            for path, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (here, a), (there, z) = (fs.FileSystem.from_uri(f"{base.rstrip('/')}/{path}") for base in (folders[k], target))
                there.create_dir(posixpath.dirname(z), recursive=True)
                part, n = f"{z}.{uuid.uuid4().hex}", 0
                with here.open_input_stream(a, compression=None) as source, there.open_output_stream(part, compression=None) as out:
                    while piece := source.read(1 << 20):
                        out.write(piece)
                        n += len(piece)
                there.move(part, z)
                done.append((path, n))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "bytes"])
    return manifest.where("status = 'copied'").select("path", "dir_ord").repartition("path").mapInArrow(run, "path string, bytes long")
