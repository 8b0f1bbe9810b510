"""Session helpers of the large-corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch. Spark's own limit is by rows first, and so many long texts would fill a Python worker's memory.
BATCH_BYTES = 4 << 20
#: Allocations of this size and more go back to the system as soon as they are freed (glibc's own limit rises to 32 MB and keeps freed arrays).
MAPPED_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` through the shared checkpoint folder, so that later steps neither repeat it nor hang on one executor.

    The folder is the one the cluster names in spark.checkpoint.dir. Where that is unset, a session in one process gets a folder of its own (tests), and any other is refused.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-checkpoint-"))
    return df.checkpoint()


#: Rows of a few numbers that a task should have at least.
ROWS_A_TASK = 25_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df` of about so many short rows in no more tasks than that is worth: many tiny tasks and files cost more than their rows, also where the session does not merge them. Large tables stay as they are."""
    tasks = max(1, rows // ROWS_A_TASK)
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: What this Python worker keeps for later tasks of one operator: a name and an object.
_kept: dict[str, object] = {}


def kept(name: str, make):
    """The object of that name, made once for as long as the worker runs tasks that keep it."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def over_batches(df: DataFrame, work, schema, keeps: str | None = None) -> DataFrame:
    """mapInArrow over batches of at most about BATCH_BYTES (a longer row is a batch of its own). `keeps`: name of what `work` keeps in its worker for later tasks."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def lean(batches):
        settle()
        if keeps not in _kept:
            _kept.clear()
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


_settled = False


def settle() -> None:
    """Once in a worker: let freed arrays and Arrow buffers return to the system, rather than stay with the allocators."""
    global _settled
    if _settled:
        return
    _settled = True
    pa.set_memory_pool(pa.system_memory_pool())
    tune = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
    if tune is not None:
        tune(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD
        tune(-8, 2)  # M_ARENA_MAX


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, more of them than run at a time."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc_mod3(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 3; rows with 1 are held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with other names for its columns that clash with `names` (an operator's own), and what each column was called."""
    taken = {c.lower() for c in docs.columns} | {n.lower() for n in names}
    back = {}
    for c in docs.columns:
        new = c
        if c.lower() in {n.lower() for n in names}:
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
        back[new] = c
    return docs.toDF(*back), back


def named_back(df: DataFrame, back: dict[str, str]) -> DataFrame:
    """The columns of `aside`, under the names that they had."""
    return df.select(*(F.col(f"`{n}`").alias(old) for n, old in back.items()))
