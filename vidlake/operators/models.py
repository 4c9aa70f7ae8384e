"""User models on frames and targets, and user stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _together(results: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results one after another, those of the same columns and types as one: each that is handed on costs more than a small model."""
    held, kinds = [], None
    for out in results:
        own = (tuple(out.columns), tuple(out.dtypes))
        if held and own != kinds:
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(out)
        kinds = own
    if held:
        yield pd.concat(held, ignore_index=True)


def apply_model(frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, batch_size: int = 32, profile: ResourceProfile | None = None) -> DataFrame:
    """fn over batches of batch_size rows, the last of a task's batches shorter; rows reach fn in Arrow batches, and results of equal types leave in such. profile: the stage's resources."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = len(rows) - len(rows) % batch_size
            yield from _together(fn(rows.iloc[at : at + batch_size]) for at in range(0, whole, batch_size))
            held = rows.iloc[whole:] if whole < len(rows) else None
        if held is not None and len(held):
            yield fn(held)

    return frames.mapInPandas(run, schema, profile=profile)


#: Models of this worker, by name.
_loaded: dict[str, object] = {}


def _model(name: str, load: Callable[[], object]) -> object:
    """The worker's own model: a function of the module, as what is inside another is sent anew with every task."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def apply_loaded_model(frames: DataFrame, name: str, load: Callable[[], object], fn: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str | StructType, batch_size: int = 32, profile: ResourceProfile | None = None) -> DataFrame:
    """fn(model, batch) over batches, as apply_model; the model is loaded once by each Python worker that needs it, and kept under its name.

    profile: the resources of the stage that runs the model (cores, memory, accelerators),
    so that model stages and the others of one job can have executors of different kinds.
    Workers live on between tasks and batches (spark.python.worker.reuse).
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return fn(_model(name, load), batch)

    return apply_model(frames, run, schema, batch_size, profile)


def apply_model_on_targets(targets: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, batch_size: int = 32, gate: Callable[[DataFrame], DataFrame] | None = None, crop: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """fn over batches of gated and cropped targets; gates stand before it, as nothing is pushed through Python."""
    for step in (gate, crop):
        targets = targets.transform(step) if step else targets
    return apply_model(targets, fn, schema, batch_size)


def pipeline(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any functions of a DataFrame, one after another."""
    for stage in stages:
        df = df.transform(stage)
    return df


def _ledger(spark: SparkSession, path: str):
    """A folder with an empty file for each batch that is done, in any store that Spark reads."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, lambda batch: jvm.org.apache.hadoop.fs.Path(folder, str(batch))


def once_each(callback: Callable[[DataFrame, int], None], ledger: str) -> Callable[[DataFrame, int], None]:
    """callback for foreachBatch, called for each batch until it has once succeeded: a batch in the ledger is not given again.

    A batch counts as done after its callback, so one that fails, or is cut off, is
    given again; what the callback writes must then take the place of what it wrote.
    write_once does so.
    """

    def run(df: DataFrame, batch: int) -> None:
        store, entry = _ledger(df.sparkSession, ledger)
        if not store.exists(entry(batch)):
            callback(df, batch)
            store.create(entry(batch), True).close()

    return run


def write_once(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger: object):
    """Starts a stream whose rows come to path once each: a folder a batch, written anew where a batch is run again, and a ledger beside the checkpoint."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch}")

    writer = df.writeStream.foreachBatch(once_each(keep, f"{checkpoint}/ledger")).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def on_results(df: DataFrame, callback: Callable[[DataFrame, int], None], **options: str):
    """Calls back with each micro-batch of a stream, or once with a batch."""
    if df.isStreaming:
        return df.writeStream.foreachBatch(callback).options(**options).start()
    callback(df, 0)
    return None
