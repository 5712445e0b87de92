"""Pluggable loaders and sinks as Spark data sources.

A loader is an object with

    shards(options) -> list            what can be read on its own (any picklable values)
    rows(options, shard) -> iterator   dicts of one shard, the same ones each time

``register_loader`` makes it a format of the session: ``spark.read.format(name)`` plans one
partition per shard, so loading is as parallel as the loader's shards, and columns, filters
and joins that follow are Spark's. A shard that fails midway is read again from its start and
the rows that were handed on are skipped, so a retry neither loses nor repeats rows.

``NdjsonSink`` is the way back: each task writes one file under a name that readers ignore,
and the files get their names when all tasks are done; a job that fails leaves none.
"""

from __future__ import annotations

import itertools
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: rows handed to Spark at a time
BATCH = 2048


class Shard(InputPartition):
    def __init__(self, value):
        super().__init__(value)


def _cell(value, field: T.StructField, shard):
    """The value in the field's type; a missing one is null, one of another type raises."""
    if value is None:
        if not field.nullable:
            raise ValueError(f"shard {shard!r}: no value for {field.name}")
        return None
    kind = field.dataType
    good = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.FloatType: (int, float),
            T.BooleanType: bool, T.BinaryType: (bytes, bytearray)}.get(type(kind))
    if good is not None and (not isinstance(value, good) or isinstance(value, bool) and good is not bool):
        raise ValueError(f"shard {shard!r}: {field.name} is {type(value).__name__}, not {kind.simpleString()}")
    return value


def resumed(make, retries: int, wait: float) -> Iterator:
    """The items of ``make()``, which is called again after an error; items that were handed on
    are skipped then. Gives up after ``retries`` errors without a new item between them."""
    done, failed = 0, 0
    while True:
        try:
            for item in itertools.islice(make(), done, None):
                yield item
                done, failed = done + 1, 0
            return
        except Exception:
            failed += 1
            if failed > retries:
                raise
            time.sleep(wait * 2 ** (failed - 1))


class LoaderReader(DataSourceReader):
    def __init__(self, loader, schema: T.StructType, options: dict):
        self.loader, self.schema, self.options = loader, schema, options

    def partitions(self) -> list[Shard]:
        return [Shard(s) for s in self.loader.shards(self.options)] or [Shard(None)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        if partition.value is None:
            return
        names = self.schema.fieldNames()
        arrow = to_arrow_schema(self.schema)
        found = resumed(lambda: iter(self.loader.rows(self.options, partition.value)),
                        int(self.options.get("retries", 3)), float(self.options.get("wait", 0.1)))
        while part := list(itertools.islice(found, BATCH)):
            columns = [[_cell(r.get(n), f, partition.value) for r in part]
                       for n, f in zip(names, self.schema.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for c, n in zip(columns, names, strict=True)],
                                             schema=arrow)


def register_loader(spark: SparkSession, format_name: str, loader, schema: T.StructType | str) -> None:
    """Make ``loader`` readable as ``spark.read.format(format_name)``. ``schema`` is the schema
    of its rows unless the reader is given another (columns the rows don't have are null)."""
    declared = schema

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self):
            return declared

        def reader(self, schema: T.StructType) -> LoaderReader:
            return LoaderReader(loader, schema, dict(self.options))

    spark.dataSource.register(Source)


# ---- newline-delimited JSON through any file system that pyarrow knows ----

def _open(path: str):
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):  # Hadoop's way to write a local path
        path = path[len("file:"):]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class NdjsonLoader:
    """Shards are the ``.json`` files below option ``path`` (or those named in ``files``)."""

    def shards(self, options: dict) -> list[str]:
        from pyarrow import fs
        system, root = _open(options["path"])
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json") and f.base_name[0] not in "._")

    def rows(self, options: dict, shard: str) -> Iterator[dict]:
        system, _ = _open(options["path"])
        with system.open_input_stream(shard) as raw, pa.PythonFile(raw, "r") as f:
            import io
            for line in io.TextIOWrapper(io.BufferedReader(f), encoding="utf-8"):
                if line.strip():
                    yield json.loads(line)


@dataclass
class Written(WriterCommitMessage):
    draft: str
    name: str
    rows: int


class NdjsonWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        one, n = uuid.uuid4().hex, 0  # a task that is run again writes another draft
        draft = f"{root}/_{self.job}-{one}"
        with system.open_output_stream(draft) as out:
            for row in iterator:
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False).encode() + b"\n")
                n += 1
        return Written(draft, f"{root}/part-{one}.json", n)

    def commit(self, messages) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None:
                system.move(m.draft, m.name)

    def abort(self, messages) -> None:
        from pyarrow import fs
        system, root = _open(self.path)
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                system.delete_file(f.path)


class NdjsonSink(DataSource):
    """``df.write.format("ndjson_sink").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "ndjson_sink"

    def writer(self, schema: T.StructType, overwrite: bool) -> NdjsonWriter:
        if overwrite:
            raise ValueError("the sink only appends; write to a new path")
        return NdjsonWriter(self.options["path"])


def register_sink(spark: SparkSession) -> None:
    spark.dataSource.register(NdjsonSink)
