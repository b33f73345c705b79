"""What several operators share: shared-folder tables, column selection and schemas."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter of documents, 2 MB at least and 32 MB at most; in between eight for each id.
FILTER_BITS = 1 << 24
MOST_FILTER_BITS = 1 << 28


#: Rows of an Arrow batch where the session doesn't say: texts can be long, and a worker holds a batch several times.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches unless the session already does."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) in (None, "10000"):
        spark.conf.set(name, str(BATCH_ROWS))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which what it has freed goes back to the system: a worker waits for its next task beside those that work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), a temporary one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        if not sc.getCheckpointDir() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='panelspark-')}"
        spark.conf.set("spark.checkpoint.dir", named) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read again after an executor is lost."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/panelspark-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        self.names.add(name)
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Frees tables that nothing reads any more."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(hadoop).delete(path, True)
            self.names.discard(name)

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """Saves ``df``, frees every other table of this scratch and lets Spark clean up the shuffles behind them."""
        out = self.save(df, name)
        self.drop(*(self.names - {name}))
        self.collect()
        return out

    def collect(self) -> None:
        """Lets Spark clean up the shuffles that nothing refers to."""
        self.spark._jvm.System.gc()


def need(df: DataFrame, *columns: str) -> None:
    """Raises ValueError for columns that are missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"Missing required columns: {missing}")


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone: whatever other columns are called, they can't clash with an operator's own."""
    need(df, id_col, text_col)
    bound_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_of(column: Column, bits: int = FILTER_BITS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("long")


def filter_of(ids: DataFrame, bits: int | None = None) -> bytes:
    """A bit for each slot that an id of ``ids`` falls into: at most MOST_FILTER_BITS / 64 longs are read back, whatever the number of ids."""
    if bits is None:
        bits = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (8 * ids.count()).bit_length()))
    slot = slot_of(F.col(ids.columns[0]), bits)
    words_ = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    table = np.zeros(bits // 64, np.int64)
    found = words_.toArrow()
    table[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return table.tobytes()


def in_filter(bits: bytes, slot: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits, np.uint64)
    return (table[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def routed(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in ``ids``, all other rows): every row is in exactly one, and no row of ``ids`` in the second.

    The rows aren't shuffled: a filter of bits of a fixed size decides, and lets some others pass when it fills up.
    """
    bits = filter_of(ids)
    shared = df.sparkSession.sparkContext.broadcast(bits)
    slotted = df.withColumn("__slot", F.coalesce(slot_of(F.col(f"`{id_col}`").cast("long"), 8 * len(bits)), F.lit(0)))

    def part(want: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = pa.array(in_filter(shared.value, batch.column(batch.num_columns - 1).to_numpy()))
                yield batch.select(range(batch.num_columns - 1)).filter(hit if want else pc.invert(hit))

        return run

    return slotted.mapInArrow(lean(part(True)), df.schema), slotted.mapInArrow(lean(part(False)), df.schema)


def without(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id isn't in ``ids`` (one column); rows that can't be in it aren't shuffled."""
    hit, rest = routed(df, ids, id_col)
    return rest.unionByName(hit.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_anti").select(*df.columns))
