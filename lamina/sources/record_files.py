"""Record files as a Spark data source: shards of compressed blocks with an index behind them, pruned and addressed by it.

A dataset is a folder with ``_index/*.json``, one for each write that was committed, and the folders of their shards. A shard
is blocks of Arrow rows, then a JSON index of them (offset, length, rows, least and greatest value of the index column),
its length and a mark. Files that no index names are not part of the dataset.

    register(spark)
    df.write.format("records").option("index", "distance").mode("append").save(path)
    spark.read.format("records").load(path)                      # and .where("distance = 3"), .where("_record IN (5, 17)")

Paths are whatever ``pyarrow.fs`` opens, seen alike by driver and executors. ``_record`` numbers a dataset's records from 0, in the
order of its writes; with ``option("number", "true")`` it is a column. Comparisons of the index column and of ``_record`` with
values choose shards on the driver and blocks in the tasks.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

MARK = b"LAMINAR1"
BLOCK_ROWS, SHARD_ROWS, SPLIT_BYTES = 1024, 10_000, 64 << 20
NUMBER = "_record"


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    shards: list


@dataclass
class Split(InputPartition):
    """One shard, or blocks ``first`` to ``last`` of it; its first record's number."""

    path: str
    base: int
    first: int
    last: int


class Span:
    """What filters leave of one column: values from ``low`` to ``high``, or one of ``among``."""

    def __init__(self):
        self.low = self.high = self.among = None

    def add(self, f: Filter) -> bool:
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            values.discard(None)
            self.among = values if self.among is None else self.among & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = f.value if self.low is None else max(self.low, f.value)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = f.value if self.high is None else min(self.high, f.value)
        else:
            return False
        return True

    def meets(self, least, greatest) -> bool:
        """Whether some value from least to greatest may pass; None: there is no value, and none passes a comparison."""
        if self.low is None and self.high is None and self.among is None:
            return True
        if least is None:
            return False
        if self.among is not None and not any(least <= v <= greatest for v in self.among):
            return False
        return (self.low is None or greatest >= self.low) and (self.high is None or least <= self.high)


def footer(store: files.FileSystem, path: str) -> list[dict]:
    with store.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MARK:
            raise ValueError(f"not a whole record file: {path}")
        (n,) = struct.unpack("<Q", tail[:8])
        return json.loads(f.read_at(n, size - 16 - n))


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("record files need a path")
        return path.rstrip("/")

    def indexes(self) -> list[dict]:
        """The committed writes in order."""
        store, root = opened(self._path())
        if store.get_file_info(f"{root}/_index").type == files.FileType.NotFound:
            raise FileNotFoundError(f"no record files at {self._path()}")
        found = sorted((i.base_name, i.path) for i in store.get_file_info(files.FileSelector(f"{root}/_index")) if i.base_name.endswith(".json"))
        out = []
        for _, path in found:
            with store.open_input_file(path) as f:
                out.append(json.loads(f.read()))
        if not out:
            raise FileNotFoundError(f"no record files at {self._path()}")
        return out

    def schema(self) -> StructType:
        own = StructType.fromJson(self.indexes()[0]["schema"])
        return StructType([*own.fields, StructField(NUMBER, LongType())]) if self.options.get("number", "false") == "true" else own

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``records`` known to a session, and lets it see filters, without which Spark refuses to read it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordFiles)


class RecordReader(DataSourceReader):
    def __init__(self, source: RecordFiles, schema: StructType):
        self.path, self.indexes, self.names = source._path(), source.indexes(), schema.names
        self.column = self.indexes[0]["index"]
        if any(x["index"] != self.column or x["schema"] != self.indexes[0]["schema"] for x in self.indexes):
            raise ValueError("writes of one dataset have one schema and one index column")
        self.by_value, self.by_number = Span(), Span()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == (self.column,):
                self.by_value.add(f)
            elif column == (NUMBER,):
                self.by_number.add(f)
            yield f  # blocks are chosen, not rows: Spark still looks at each row

    def partitions(self) -> list[Split]:
        out, base = [], 0
        for x in self.indexes:
            for s in x["shards"]:
                if s["rows"] and self.by_value.meets(s["min"], s["max"]) and self.by_number.meets(base, base + s["rows"] - 1):
                    parts = max(1, min(s["blocks"], s["bytes"] // SPLIT_BYTES))
                    cuts = [s["blocks"] * i // parts for i in range(parts + 1)]
                    out += [Split(s["path"], base, a, b) for a, b in zip(cuts, cuts[1:])]
                base += s["rows"]
        return out or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, root = opened(self.path)
        at = partition.base
        with store.open_input_file(f"{root}/{partition.path}") as f:
            for i, b in enumerate(footer(store, f"{root}/{partition.path}")):
                wanted = partition.first <= i < partition.last and self.by_value.meets(b["min"], b["max"]) and self.by_number.meets(at, at + b["rows"] - 1)
                if wanted:
                    for batch in ipc.open_stream(pa.BufferReader(f.read_at(b["length"], b["offset"]))):
                        if NUMBER in self.names:
                            batch = batch.append_column(NUMBER, pa.array(range(at, at + batch.num_rows), pa.int64()))
                        yield batch.select(self.names)
                at += b["rows"]


class RecordWriter(DataSourceArrowWriter):
    """Tasks write shards of at most ``shard_rows`` into a folder of the write's own; the driver commits by naming them in one index.

    A failing task deletes its files; a failing write its folder. Until the index stands nobody reads them, and an
    overwrite deletes the old ones only then.
    """

    def __init__(self, source: RecordFiles, schema: StructType, overwrite: bool):
        self.source, self.path, self.overwrite, self.schema = source, source._path(), overwrite, schema.jsonValue()
        option = source.options.get
        self.index, self.block_rows, self.shard_rows = option("index", ""), int(option("block_rows", str(BLOCK_ROWS))), int(option("shard_rows", str(SHARD_ROWS)))
        if self.index and self.index not in schema.names:
            raise ValueError(f"no column {self.index!r} to index")
        if min(self.block_rows, self.shard_rows) < 1:
            raise ValueError("blocks and shards hold 1 row or more")
        self.run = f"write-{uuid.uuid4().hex}"

    def _span(self, batch: pa.RecordBatch) -> tuple:
        import pyarrow.compute as pc

        if not self.index:
            return None, None
        m = pc.min_max(batch.column(self.index)).as_py()
        return m["min"], m["max"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = opened(self.path)
        store.create_dir(f"{root}/{self.run}", recursive=True)
        context = TaskContext.get()
        name = f"{self.run}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        shards, made = [], []
        try:
            for n, rows in enumerate(self._shards(iterator)):
                path = f"{name}-{n:05d}.rec"
                made.append(path)
                with store.open_output_stream(f"{root}/{path}") as f:
                    blocks, at = [], 0
                    for batch in rows:
                        sink = pa.BufferOutputStream()
                        with ipc.new_stream(sink, batch.schema, options=ipc.IpcWriteOptions(compression="zstd")) as w:
                            w.write_batch(batch)
                        data = sink.getvalue()
                        f.write(data)
                        low, high = self._span(batch)
                        blocks.append({"offset": at, "length": data.size, "rows": batch.num_rows, "min": low, "max": high})
                        at += data.size
                    tail = json.dumps(blocks).encode()
                    f.write(tail + struct.pack("<Q", len(tail)) + MARK)
                known = [b for b in blocks if b["min"] is not None]
                shards.append({"path": path, "rows": sum(b["rows"] for b in blocks), "blocks": len(blocks), "bytes": at, "min": min((b["min"] for b in known), default=None), "max": max((b["max"] for b in known), default=None)})
        except BaseException:
            for path in made:
                if store.get_file_info(f"{root}/{path}").type != files.FileType.NotFound:
                    store.delete_file(f"{root}/{path}")
            raise
        return Written(shards)

    def _blocks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, self.block_rows - n)
                at, n = at + part.num_rows, n + part.num_rows
                held.append(part)
                if n == self.block_rows:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def _shards(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
        blocks, left = self._blocks(iterator), []

        def one(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            room = self.shard_rows
            batch = first
            while batch is not None:
                if batch.num_rows > room:
                    left.append(batch.slice(room))
                    yield batch.slice(0, room)
                    return
                room -= batch.num_rows
                yield batch
                if not room:
                    return
                batch = next(blocks, None)

        while (first := left.pop() if left else next(blocks, None)) is not None:
            yield one(first)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        old = self._old(store, root)
        shards = [s for m in messages if m is not None for s in m.shards]
        place = 0 if not old else 1 + max(int(p.rsplit("/", 1)[1].split("-")[0]) for p in old)
        store.create_dir(f"{root}/_index", recursive=True)
        final, text = f"{root}/_index/{place:06d}-{self.run}.json", json.dumps({"schema": self.schema, "index": self.index, "run": self.run, "shards": shards})
        with store.open_output_stream(f"{final}.new") as f:
            f.write(text.encode())
        store.move(f"{final}.new", final)
        for path in old if self.overwrite else []:
            with store.open_input_file(path) as f:
                run = json.loads(f.read())["run"]
            store.delete_file(path)
            if store.get_file_info(f"{root}/{run}").type != files.FileType.NotFound:
                store.delete_dir(f"{root}/{run}")

    @staticmethod
    def _old(store: files.FileSystem, root: str) -> list[str]:
        if store.get_file_info(f"{root}/_index").type == files.FileType.NotFound:
            return []
        return sorted(i.path for i in store.get_file_info(files.FileSelector(f"{root}/_index")) if i.base_name.endswith(".json"))

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.run}").type != files.FileType.NotFound:
            store.delete_dir(f"{root}/{self.run}")
