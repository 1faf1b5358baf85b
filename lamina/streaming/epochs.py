"""Epochs over a table as an endless stream that can stop and go on: each epoch is every row once, in an order of its own.

    spark.dataSource.register(Epochs)
    stream = spark.readStream.format("epochs").option("path", table).option("state", folder).option("seed", 7).load()

The offset is (epoch, position). An epoch's order is fixed by seed and number: row groups in a seeded order, and the rows of each
in one. ``state`` is a folder for one query, beside its checkpoint: it keeps the table's row groups as they were
when the stream began, so that files which come later change no epoch, and the last offset that was planned, as a source is
not told where a restarted query stands before it has to say how far it can go.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.record_files import opened

EPOCH, POSITION = "_epoch", "_position"


@dataclass
class Part(InputPartition):
    """Rows ``first`` to ``last`` of a row group's order in an epoch; ``at`` is the first one's position."""

    epoch: int
    block: int
    first: int
    last: int
    at: int


def row_groups(path: str) -> list[tuple[str, int, int]]:
    """file, row group, rows of a Parquet table's groups that have any, in the order of file names."""
    store, root = opened(path)
    if store.get_file_info(root).type == files.FileType.File:
        found = [root]
    else:
        found = sorted(i.path for i in store.get_file_info(files.FileSelector(root, recursive=True)) if i.base_name.endswith(".parquet") and not i.base_name.startswith(("_", ".")))
    out = []
    for f in found:
        meta = pq.read_metadata(f, filesystem=store)
        out += [(f, g, n) for g in range(meta.num_row_groups) if (n := meta.row_group(g).num_rows)]
    if not out:
        raise ValueError(f"no rows at {path}")
    return out


class Epochs(DataSource):
    """Options: path (Parquet), state, seed (0), rows (a batch, 10,000), epochs (how many; none: no end)."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> StructType:
        store, _ = opened(self.options["path"])
        own = from_arrow_schema(pq.read_schema(row_groups(self.options["path"])[0][0], filesystem=store))
        return StructType([*own.fields, StructField(EPOCH, LongType()), StructField(POSITION, LongType())])

    def streamReader(self, schema: StructType) -> EpochReader:
        return EpochReader(dict(self.options), schema.names)


class EpochReader(DataSourceStreamReader):
    def __init__(self, options: dict, names: list[str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.state, self.seed, self.names = low["path"], low["state"].rstrip("/"), int(low.get("seed", 0)), [n for n in names if n not in (EPOCH, POSITION)]
        self.rows, self.epochs = int(low.get("rows", 10_000)), int(low["epochs"]) if "epochs" in low else None
        if self.rows < 1:
            raise ValueError("a batch has 1 row or more")
        held = self._read("groups.json")
        if held is None:
            held = {"seed": self.seed, "groups": row_groups(self.path)}
            self._write("groups.json", held)
        if held["seed"] != self.seed:
            raise ValueError("this state belongs to another seed")
        self.groups = held["groups"]
        self.total = sum(n for *_, n in self.groups)
        self.at = self._read("offset.json") or self.initialOffset()
        self.order: tuple[int, np.ndarray, np.ndarray] | None = None

    def _read(self, name: str):
        store, root = opened(self.state)
        if store.get_file_info(f"{root}/{name}").type == files.FileType.NotFound:
            return None
        with store.open_input_file(f"{root}/{name}") as f:
            return json.loads(f.read())

    def _write(self, name: str, what) -> None:
        store, root = opened(self.state)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}.new") as f:
            f.write(json.dumps(what).encode())
        store.move(f"{root}/{name}.new", f"{root}/{name}")

    def initialOffset(self) -> dict:
        return {"epoch": 0, "position": 0}

    def latestOffset(self) -> dict:
        """One batch on; a batch ends where its epoch does."""
        if self.epochs is None or self.at["epoch"] < self.epochs:
            to = self.at["position"] + self.rows
            self.at = {"epoch": self.at["epoch"] + 1, "position": 0} if to >= self.total else {"epoch": self.at["epoch"], "position": to}
        return self.at

    def _order(self, epoch: int) -> tuple[np.ndarray, np.ndarray]:
        """The row groups' order in an epoch, and the position at which each one's rows begin."""
        if self.order is None or self.order[0] != epoch:
            blocks = np.random.default_rng([self.seed, epoch]).permutation(len(self.groups))
            size = np.array([n for *_, n in self.groups])[blocks]
            self.order = epoch, blocks, np.concatenate([[0], np.cumsum(size)])
        return self.order[1:]

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if (end["epoch"], end["position"]) > (self.at["epoch"], self.at["position"]):
            self.at = end
        self._write("offset.json", end)
        out = []
        for epoch in range(start["epoch"], end["epoch"] + 1):
            a = start["position"] if epoch == start["epoch"] else 0
            b = self.total if epoch < end["epoch"] else end["position"]
            if a >= b:
                continue
            blocks, begins = self._order(epoch)
            for k in range(int(np.searchsorted(begins, a, side="right")) - 1, len(blocks)):
                if begins[k] >= b:
                    break
                low, high = max(a, int(begins[k])), min(b, int(begins[k + 1]))
                out.append(Part(epoch, int(blocks[k]), low - int(begins[k]), high - int(begins[k]), low))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        path, group, n = self.groups[partition.block]
        order = np.random.default_rng([self.seed, partition.epoch, partition.block]).permutation(n)[partition.first : partition.last]
        with pq.ParquetFile(path, filesystem=store) as f:
            rows = f.read_row_group(group, columns=self.names).select(self.names).take(pa.array(order))
        k = rows.num_rows
        rows = rows.append_column(EPOCH, pa.array([partition.epoch] * k, pa.int64())).append_column(POSITION, pa.array(range(partition.at, partition.at + k), pa.int64()))
        yield from rows.combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        pass


def epochs(spark: SparkSession, path: str, state: str, seed: int, rows: int, n: int | None = None) -> DataFrame:
    """The stream of ``n`` epochs (none: no end) over a Parquet table, ``rows`` at a time, with _epoch and _position."""
    spark.dataSource.register(Epochs)
    out = spark.readStream.format("epochs").option("path", path).option("state", state).option("seed", seed).option("rows", rows)
    return (out if n is None else out.option("epochs", n)).load()
