"""Batches of frames that an application pushes, as a stream with offsets that can be read again.

The application hands each batch to an Inbox, which keeps it as one numbered file in a
folder that driver and executors share. A stream's offset is the number of the next
batch, so a query that starts again from its checkpoint reads on where it was, and what
it has to read again is what it read before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vidlake.streaming.channels import use_rocksdb

_SUFFIX = ".arrow"


def _folder(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def _numbers(place: str) -> list[int]:
    store, path = _folder(place)
    files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(_SUFFIX)) for f in files if f.base_name.endswith(_SUFFIX))


class Inbox:
    """The application's end: push(rows) keeps a batch and gives its number. One application writes to an inbox."""

    def __init__(self, place: str):
        self.place = place
        self.next = max(_numbers(place), default=-1) + 1

    def push(self, rows: pd.DataFrame | pa.Table) -> int:
        store, path = _folder(self.place)
        store.create_dir(path)
        table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows, preserve_index=False)
        name, number = f"{path}/{self.next:012d}", self.next
        with store.open_output_stream(f"{name}.part") as out, pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        store.move(f"{name}.part", f"{name}{_SUFFIX}")  # a batch is there as a whole or not at all
        self.next += 1
        return number


class _Batch(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceStreamReader):
    def __init__(self, place: str, names: list[str]):
        self.place, self.names = place, names

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        """The number after the last that is there; numbers have no gaps, as one application gives them in order."""
        return {"next": max(_numbers(self.place), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Batch(n) for n in range(start["next"], end["next"])]

    def read(self, partition: _Batch) -> Iterator[pa.RecordBatch]:
        store, path = _folder(self.place)
        with store.open_input_stream(f"{path}/{partition.number:012d}{_SUFFIX}") as f, pa.ipc.open_stream(f) as reader:
            table = reader.read_all()
        table = table.append_column("batch_no", pa.array([partition.number] * table.num_rows, pa.int64())).select(self.names)
        yield from table.combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        pass  # batches stay, to be read again


class PushedBatches(DataSource):
    """Format "pushed" with option path: every batch that is there goes into the next micro-batch, each as a task of its own."""

    @classmethod
    def name(cls) -> str:
        return "pushed"

    def schema(self) -> str:
        raise ValueError("the schema of pushed rows has to be given")

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], schema.names)


def read_pushed(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """A stream of the rows of an inbox (channel_index, width, height, ...) with batch_no, the batch they came in."""
    spark.dataSource.register(PushedBatches)
    return spark.readStream.format("pushed").schema(f"{schema}, batch_no long").option("path", place).load()


class _Accept(StatefulProcessor):
    """A channel's frame size, which its first batch of one size has set."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "width int, height int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, taken = self.size.get(), []
        for _, batch in pd.concat(list(rows)).groupby("batch_no", sort=True):
            sizes = set(zip(batch["width"], batch["height"]))
            if len(sizes) == 1 and (size is None or sizes == {tuple(size)}):
                if size is None:
                    size = tuple(int(v) for v in next(iter(sizes)))
                    self.size.update(size)
                taken.append(batch.assign(fps=1))
        if taken:
            yield pd.concat(taken)[[*self.columns, "fps"]]

    def close(self) -> None:
        pass


def accepted_batches_stream(rows: DataFrame) -> DataFrame:
    """As accepted_batches, of a stream of read_pushed: a batch lies in one micro-batch, and batches come in order."""
    use_rocksdb(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", fps int"
    return rows.groupBy("channel_index").transformWithStateInPandas(_Accept(rows.columns), schema, "append", "none")
