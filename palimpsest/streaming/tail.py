"""Tail of growing line files as a stream with offsets of its own: (bytes read, generation, head) of each file.

A micro-batch takes complete lines only, at most so many bytes of a file, and at most so many bytes in all. A file that
shrank, or whose first bytes are others than before, was replaced: its generation rises and it is read from the start.
What a batch will read is stored for the consumer before it is read, so that a stopped stream goes on where it ended, and
a batch that failed is read again between the same offsets. Files must be reachable from all executors by a path.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from palimpsest.catalog import Entry
from palimpsest.sources.shared import remove, shared_folder
from palimpsest.sources.tables import table

SCHEMA = "file string, generation int, start long, line string"
_HEAD = 256


def _digest(f, size: int) -> str:
    f.seek(0)
    return hashlib.sha256(f.read(size)).hexdigest()


class Stretch(InputPartition):
    def __init__(self, file: str, generation: int, start: int, end: int):
        self.file, self.generation, self.start, self.end = file, generation, start, end


class Tail(DataSourceStreamReader):
    """Offsets are {file: [bytes, generation, bytes of the head, digest of the head]}."""

    def __init__(self, options: dict):
        self.path, self.offsets = options["path"], options["offsets"]
        self.file_bytes, self.batch_bytes = int(options.get("maxfilebytes", 64 << 20)), int(options.get("maxbatchbytes", 1 << 30))
        self.line_bytes = int(options.get("maxlinebytes", 4 << 20))
        self.planned = self._stored()

    def _stored(self) -> dict:
        try:
            with open(self.offsets) as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _store(self, offsets: dict) -> None:
        os.makedirs(os.path.dirname(self.offsets), exist_ok=True)
        with open(f"{self.offsets}.new", "w") as f:
            json.dump(offsets, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.offsets}.new", self.offsets)

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[str]:
        found = []
        for folder, _, names in os.walk(self.path):
            found += [os.path.relpath(os.path.join(folder, n), self.path) for n in names if not n.startswith((".", "_"))]
        return sorted(found)

    def _next(self, f, size: int, at: int, most: int) -> int:
        """Where the last complete line ends that begins in the next ``most`` bytes, ``at`` if there is none yet."""
        end = min(size, at + most)
        f.seek(at)
        while end > at:
            data = f.read(end - at)
            cut = data.rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            if end - at >= self.line_bytes:
                raise ValueError(f"{f.name}: a line of over {self.line_bytes} bytes at {at}")
            if end == size:
                return at
            end = min(size, at + min(2 * (end - at), self.line_bytes))
            f.seek(at)
        return at

    def latestOffset(self) -> dict:
        new, left = dict(self.planned), self.batch_bytes
        for name in self._files():
            if left <= 0:
                break
            try:
                with open(os.path.join(self.path, name), "rb") as f:
                    size = os.fstat(f.fileno()).st_size
                    at, generation, head, digest = new.get(name, [0, 0, 0, ""])
                    if size < at or head and _digest(f, head) != digest:
                        at, generation, head = 0, generation + 1, 0
                    end = self._next(f, size, at, min(self.file_bytes, left))
                    if end > at or at == 0 and name in new and generation != new[name][1]:
                        head = head if head == _HEAD else min(_HEAD, end)
                        new[name] = [end, generation, head, _digest(f, head)]
                        left -= end - at
            except FileNotFoundError:  # gone since it was listed
                continue
        self.planned = new
        return new

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.planned = end
        self._store(end)
        found = []
        for name, (stop, generation, *_) in end.items():
            at, before, *_ = start.get(name, [0, 0, 0, ""])
            at = at if before == generation else 0
            if stop > at:
                found.append(Stretch(name, generation, at, stop))
        return found

    def read(self, partition: Stretch):
        with open(os.path.join(self.path, partition.file), "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                yield partition.file, partition.generation, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class LineTail(DataSource):
    """Format ``line_tail``. Options: path (a folder), offsets (a file of the consumer), maxFileBytes, maxBatchBytes, maxLineBytes."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Tail:
        return Tail(dict(self.options))


def local_path(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} can't be tailed: it is not a path that every executor can open")
    return path


def line_tail(spark: SparkSession, path: str, offsets: str, **bounds: int) -> DataFrame:
    """(file, generation, start, line): the lines of the files of a folder, as a stream that ``offsets`` lets go on."""
    spark.dataSource.register(LineTail)
    reader = spark.readStream.format("line_tail").option("path", local_path(path)).option("offsets", local_path(offsets))
    for k, v in bounds.items():
        reader = reader.option(k, v)
    return reader.load()


def read_on(lines: DataFrame, base: str) -> DataFrame:
    """Run a tail until it has read what is there, each batch to a folder of its own; all that was ever read comes back."""
    spark = lines.sparkSession
    names = ", ".join(f"`{c}` {t}" for c, t in lines.dtypes)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    query = lines.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(f"{names}, batch long").parquet(f"{base}/out")


def _log(spark, sf_dir) -> DataFrame:
    """The event log as JSON lines."""
    return table(spark, sf_dir, "events").select("event_id", F.format_string('{"id":%d,"kind":"%s"}', "event_id", "event_type").alias("value"))


def _tailed(spark, sf_dir) -> tuple[DataFrame, str]:
    import atexit
    import uuid

    base = f"{shared_folder(spark)}/tail-{uuid.uuid4().hex}"
    atexit.register(remove, spark, base)
    lines = _log(spark, sf_dir)
    for part in (lines.filter("event_id % 3 = 0"), lines.filter("event_id % 3 <> 0")):  # stopped, and resumed when there is more
        part.select("value").write.mode("append").text(f"{base}/log")
        found = read_on(line_tail(spark, f"{base}/log", f"{base}/offsets/events.json", maxBatchBytes=8 << 20, maxFileBytes=1 << 20), base)
    return found, base


def s05(spark, sf_dir):
    """The log read by a tail that was stopped and resumed: every line once."""
    found = _tailed(spark, sf_dir)[0].select(F.from_json("line", "id long, kind string").alias("e"))
    return found.select(F.col("e.id").alias("event_id"), "e.kind")


def m02(spark, sf_dir):
    """What the consumer's stored offsets say has been read, beside what was."""
    found, base = _tailed(spark, sf_dir)
    offsets = spark.read.text(f"{base}/offsets").select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("file", "at"))
    stored = offsets.agg(F.sum(F.col("at")[0].cast("long")).alias("stored_bytes"), F.max(F.col("at")[1].cast("int")).alias("generation"))
    read = found.agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    return read.join(F.broadcast(stored)).select(F.lit("events").alias("consumer"), "lines", "bytes", "stored_bytes", "generation")  # one row


_LINE = "'{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}'"
ENTRIES = {
    "S05_resumed_tail": Entry(s05, "select event_id, event_type kind from events"),
    "M02_offsets": Entry(m02, f"select 'events' consumer, count(*) as lines, cast(sum(strlen({_LINE})+1) as bigint) as bytes, cast(sum(strlen({_LINE})+1) as bigint) stored_bytes, 0 as generation from events"),
}
