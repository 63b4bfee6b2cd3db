"""File sources of the triage and telemetry inputs: JSON-lines build logs, run manifests, model SQL files and
telemetry event files. Schemas are declared; nothing is inferred."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.schemas import EVENT, MANIFEST
from runscope.session import cut


def _stem(path_col, suffix_regex: str):
    return F.regexp_extract(path_col, r"([^/]+?)" + suffix_regex + "$", 1)


def write_text_files(rows: DataFrame, base: str, order: str | None = None) -> None:
    """Write (path, value) rows as text files below ``base``, a folder that all executors share: the rows of a path,
    in their ``order``, are the file's lines.

    The rows are sorted by path inside partitions and streamed, so a worker holds one batch, however long a file is. A
    file is moved to its name when it is complete: a task that runs again replaces it, readers never see a part.
    """
    def write(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        current, part, out, n = None, None, None, 0

        def close():
            out.close()
            store.move(part, f"{root}/{current}")
            return pa.RecordBatch.from_pydict({"path": [current], "n_lines": [n]})

        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                if path != current:
                    if out is not None:
                        yield close()
                    current, n = path, 0
                    folder, name = os.path.split(f"{root}/{path}")
                    store.create_dir(folder, recursive=True)
                    part = f"{folder}/_{name}.{uuid.uuid4().hex}"  # readers pass over names that start so
                    out = store.open_output_stream(part)
                out.write((value + "\n").encode())
                n += 1
        if out is not None:
            yield close()

    keys = ["path"] + ([order] if order else [])
    # A fixed number of tasks: most of the time goes into opening files, which a partition's bytes don't tell.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism,
                int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.where("path IS NOT NULL AND value IS NOT NULL").repartition(tasks, "path").sortWithinPartitions(*keys)
    rows.select("path", "value").mapInArrow(write, "path string, n_lines long").write.format("noop").mode(
        "overwrite").save()


#: Files that a task reads before one more is used; bytes or rows that leave a task together.
TASK_FILES, BATCH_BYTES, BATCH_ROWS = 4096, 1 << 22, 8192


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (
        name.startswith("_") and "=" not in name and not name.startswith(("_common_metadata", "_metadata")))


def _quoted(path: str) -> str:
    """A path as ``_metadata.file_path`` gives it."""
    return re.sub(r"[^A-Za-z0-9_\-.!~'()*;/:@&=+$,\u0080-\U0010ffff]", lambda m: quote(m[0], safe=""), path)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded rows and bytes; the last column is the long one."""
    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _roots(spark: SparkSession, path: str) -> list[str]:
    """The URIs that a path, or a pattern of paths, stands for."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        raise FileNotFoundError(path)
    return [f.getPath().toUri().toString() for f in found]


class Listing:
    """The files below ``path`` whose names end in ``suffix``: ``files`` has (path, size, modified_at), paths within
    their store, which all executors reach.

    The folders of a level are listed by many tasks, then those of the next level. Names are rows of a table and never
    meet on the driver, which holds nothing that grows with the number of files.
    """

    def __init__(self, spark: SparkSession, path: str, suffix: str):
        from pyarrow import fs

        roots = _roots(spark, path)
        paths = [fs.FileSystem.from_uri(u)[1] for u in roots]
        self.store = store = roots[0]
        #: What stands before a path in its URI.
        prefix = store.removesuffix(_quoted(paths[0]))
        self.prefix = "file:" if prefix == "file://" else prefix
        schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("ms", pa.int64())])

        def entries(batches):
            from pyarrow import fs

            reader, _ = fs.FileSystem.from_uri(store)
            for folder in (x for batch in batches for x in batch.column("path").to_pylist()):
                here = reader.get_file_info(folder)
                inside = here.type == fs.FileType.Directory
                for f in reader.get_file_info(fs.FileSelector(folder)) if inside else [here]:
                    is_folder = f.type == fs.FileType.Directory
                    if not (inside and _hidden(f.base_name)) and (is_folder or f.base_name.endswith(suffix)):
                        yield f.path, is_folder, f.size or 0, f.mtime_ns // 1_000_000

        folders, self.files = spark.createDataFrame([(x,) for x in paths], "path string"), None
        while folders is not None:
            level = cut(folders.mapInArrow(lambda batches: _batches(entries(batches), schema),
                                           "path string, folder boolean, size bigint, ms bigint"), "listing")
            found = level.where(~F.col("folder")).select("path", "size", F.timestamp_millis("ms").alias("modified_at"))
            self.files = found if self.files is None else self.files.unionByName(found)
            below = level.where("folder").select("path")
            folders = None if below.isEmpty() else below.repartition(4 * spark.sparkContext.defaultParallelism)


def _split_bytes(spark: SparkSession) -> int:
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))


def _dealt(files: DataFrame, size: str = "size") -> DataFrame:
    """Files, or splits of them, dealt out to as many tasks as their number and bytes ask for."""
    spark = files.sparkSession
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return files.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_FILES),
                                 -(-total // _split_bytes(spark))))


def _read_whole(listing: Listing) -> DataFrame:
    """(path, modified_at, value) of the listed files that hold something, each text whole; the path quoted."""
    store = listing.store

    def texts(batches):
        from pyarrow import fs

        reader, _ = fs.FileSystem.from_uri(store)
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("modified_at")):
                with reader.open_input_stream(path, compression=None) as f:
                    yield _quoted(path), at, f.read()

    schema = pa.schema([("path", pa.string()), ("modified_at", pa.timestamp("us", "UTC")), ("value", pa.binary())])
    read = _dealt(listing.files.where("size > 0")).mapInArrow(lambda batches: _batches(texts(batches), schema),
                                            "path string, modified_at timestamp, value binary")
    return read.withColumn("value", F.col("value").cast("string"))


def _split_lines(f, start: int, end: int) -> Iterator[bytes]:
    """The lines of an open file that begin in a split of it; the last one is read on to its end."""
    at = max(start - 1, 0)
    f.seek(at)
    at += len(f.readline()) if start else 0
    while at < end and (line := f.readline()):
        text = line.removesuffix(b"\n")
        yield text.removeprefix(b"\xef\xbb\xbf") if at == 0 else text
        at += len(line)


def read_log_files(spark: SparkSession, path: str, suffix: str = ".log") -> DataFrame:
    """IO-7: build logs ``<run_id>.log`` -> (run_id, line_no, value), line numbers from 0.

    A long log is read in several splits by several tasks. A first pass over the long logs counts the lines of each
    split (no text leaves the reader); the counts of the splits before it, summed up over the small table of splits,
    are where its numbers begin. The splits are rows of a table, so both passes see the same ones.
    """
    listing, width = Listing(spark, path, suffix), _split_bytes(spark)
    store = listing.store
    splits = (listing.files.withColumn("start", F.explode(F.sequence(
                  F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(width).cast("bigint"))))
              .select("path", "size", "start", F.least(F.col("start") + width, F.col("size")).alias("end"),
                      F.least(F.lit(width), F.col("size") - F.col("start")).alias("length")))

    def each(batches):
        from pyarrow import fs

        reader, _ = fs.FileSystem.from_uri(store)
        for row in (r for batch in batches for r in batch.to_pylist()):
            with io.BufferedReader(reader.open_input_file(row["path"]), 1 << 20) as f:
                yield row, f

    def count(batches):
        for row, f in each(batches):
            yield row["path"], row["start"], sum(1 for _ in _split_lines(f, row["start"], row["end"]))

    def read(batches):
        for row, f in each(batches):
            path = _quoted(row["path"])
            for i, line in enumerate(_split_lines(f, row["start"], row["end"]), row["first"]):
                yield path, i, line

    counts = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n", pa.int64())])
    lines = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("value", pa.binary())])
    long = _dealt(splits.where(F.col("size") > width), "length").mapInArrow(
        lambda batches: _batches(count(batches), counts), "path string, start bigint, n bigint")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    firsts = long.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = splits.join(firsts, ["path", "start"], "left").withColumn("first", F.coalesce("first", F.lit(0)))
    raw = _dealt(placed, "length").mapInArrow(lambda batches: _batches(read(batches), lines),
                                              "path string, line_no bigint, value binary")
    return raw.select(_stem(F.col("path"), suffix.replace(".", r"\.")).alias("run_id"), "line_no",
                      F.col("value").cast("string").alias("value"))


def _manifest_columns(df: DataFrame, file_name, suffix: str) -> DataFrame:
    stem = _stem(file_name, suffix.replace(".", r"\."))
    return df.select(F.coalesce("run_id", stem).alias("run_id"), "command", "exit_code", "log_file", "started_at",
                     "success", "modified_at")


def read_manifests(spark: SparkSession, path: str, suffix: str = ".manifest.json") -> DataFrame:
    """IO-8: one JSON document per run; the run id is the file stem when the document lacks it."""
    texts = _read_whole(Listing(spark, path, suffix)).where(F.col("value").rlike(r"\S"))
    found = F.from_json("value", T.ArrayType(MANIFEST))
    rows = texts.select("path", "modified_at", F.explode(F.coalesce(
        found, F.array(F.lit(None).cast(MANIFEST)))).alias("m"))
    return _manifest_columns(rows.select("path", "modified_at", "m.*"), F.col("path"), suffix)


def newest_file(spark: SparkSession, path: str, suffix: str) -> str | None:
    """The file below ``path`` that was modified last (of several the last in path order); no file is opened."""
    listing = Listing(spark, path, suffix)
    newest = listing.files.agg(F.max_by("path", F.struct("modified_at", "path"))).first()[0]
    return newest and listing.prefix + newest


def read_newest_manifest(spark: SparkSession, path: str, suffix: str = ".manifest.json") -> DataFrame:
    """IO-8 / WI-1: the manifest file that was modified last, chosen by file time alone; the only one that is read."""
    newest = newest_file(spark, path, suffix)
    if newest is None:
        return read_manifests(spark, path, suffix).limit(0)
    df = (spark.read.schema(MANIFEST).option("multiLine", True).json(newest)
          .withColumn("_file", F.col("_metadata.file_name"))
          .withColumn("modified_at", F.col("_metadata.file_modification_time")))
    return _manifest_columns(df, F.col("_file"), suffix)


def read_model_files(spark: SparkSession, root: str) -> DataFrame:
    """IO-9: every ``*.sql`` under ``root`` (recursive) -> (path, sql); the model name is the file stem."""
    listing = Listing(spark, root, ".sql")
    return _read_whole(listing).select(F.concat(F.lit(listing.prefix), "path").alias("path"),
                                       F.col("value").alias("sql"))


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry event log files (JSON lines of the event envelope plus ``seq``); ``data`` stays raw JSON."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(path)
    return parse_event_lines(lines)


def strict_json(lines: DataFrame, value, schema: str, keep: list) -> DataFrame:
    """``keep`` columns of the lines and ``found``: a list with the line's object, if it is one JSON object and nothing
    else, with double quotes only; else null, empty, or of several elements.

    The text is read as the only element of a list, so that anything after the object breaks the syntax or makes a
    second element. The parse stands in a generator: what reads ``found`` refers to its output, so the optimiser can't
    copy the parse into every field and filter that uses it.
    """
    parsed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), f"array<{schema}>", {"allowSingleQuotes": "false"})
    return lines.select(*keep, F.explode(F.array(parsed)).alias("found"))


_ENVELOPE = "struct<seq:bigint,run_id:string,type:string,agent:string,timestamp:string,data:string>"


def parse_event_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON text -> event envelope. Lines that are not one JSON object, or lack a seq, run_id or type, are flagged
    ``valid = false`` so callers can route them to a dead-letter output instead of failing."""
    parsed = strict_json(lines, F.col(value), _ENVELOPE, [F.col(value).alias("_raw")])
    parsed = parsed.select("_raw", F.when(F.size("found") == 1, F.col("found")[0]).alias("e"))
    valid = F.col("e").isNotNull() & F.col("e.seq").isNotNull() & F.col("e.run_id").isNotNull() \
        & F.col("e.type").isNotNull()
    return parsed.select(*[F.col(f"e.{f.name}").alias(f.name) for f in EVENT.fields],
                         F.coalesce(valid, F.lit(False)).alias("valid"), F.col("_raw").alias("raw"))
