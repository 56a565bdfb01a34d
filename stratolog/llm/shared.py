"""What several operators share: intermediate tables, word splitting and batch helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid
from typing import ClassVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, set as that, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stratolog-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows of an Arrow batch between Spark and Python where the session leaves the default of 10,000 rows:
#: with sets and long texts in its rows such a batch can outgrow an executor.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes after which such a batch ends all the same, where the session leaves the default: packed rows are large.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, and let Python workers find this package where it lies."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    there = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in there.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, there) if x)
    if int(spark.conf.get(_ROWS, "10000")) == 10_000:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def give_back(spark: SparkSession) -> None:
    """Let each executor collect its garbage, so that heap which the stages before grew goes back to the system.

    A JVM's heap grows in a stage and else hardly shrinks, while the next stage's Python workers need the room.
    One task for each core reaches all executors where none is busy.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


class Workspace:
    """Intermediate tables as Parquet in the shared folder, which cut lineage and outlive executors.

    They are deleted by close(), by close_workspaces(), or when the driver's interpreter ends: lazy results
    still read them until they have been written or collected.
    """

    opened: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark, self.at = spark, f"{shared_folder(spark)}/stratolog-{uuid.uuid4().hex}"
        if not self.opened:
            atexit.register(close_workspaces)
        self.opened.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read from there; the shuffle files of its plan go once it is written."""
        path, before = f"{self.at}/{name}-{uuid.uuid4().hex[:8]}", self.spark.conf.get(_FREE, None)
        self.spark.conf.set(_FREE, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_FREE) if before is None else self.spark.conf.set(_FREE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame) -> None:
        """Delete a table of this workspace that nothing reads any more."""
        for path in {os.path.dirname(f) for f in table.inputFiles()}:
            self._delete(path)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            self._delete(self.at)
        except Exception:  # noqa: BLE001  the session may have ended, and the folder with it
            pass


def close_workspaces() -> None:
    """Delete the intermediate tables of all operators so far; call it once their results are written."""
    while Workspace.opened:
        Workspace.opened.pop().close()


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """docs with all columns but the used ones renamed out of an operator's way, and the names."""
    names = [c if c in used else f"_x{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def made_apart(docs: DataFrame, used: tuple[str, ...], made: tuple[str, ...], make) -> DataFrame:
    """make(docs) with the columns `made` behind those of docs, whatever the others are called.

    Columns that aren't used are renamed while make runs. One that has the name of a column made gives way to it.
    """
    inner, names = set_aside(docs, *used)
    taken = {c.lower() for c in made}
    stay = [(n, c) for n, c in zip(names, docs.columns) if c.lower() not in taken]
    return make(inner).select(*[n for n, _ in stay], *made).toDF(*[c for _, c in stay], *made)


def with_fields(docs: DataFrame, **fields: T.DataType) -> T.StructType:
    """The schema of docs and these fields behind it."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField(k, t) for k, t in fields.items()])


#: Bytes of text that one step of a worker handles at once; a longer text makes a step of its own.
STEP_BYTES = 2 << 20


def sliced(batches, text: str, most: int = STEP_BYTES):
    """The batches cut into slices of bounded text size."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b[text]), 0).to_pylist()
        lo, size = 0, 0
        for k, n in enumerate(sizes):
            if k > lo and size + n > most:
                yield b.slice(lo, k - lo)
                lo, size = k, 0
            size += n
        if lo < len(sizes):
            yield b.slice(lo)


def gathered(batches, rows: int):
    """The batches joined to larger ones of at least so many rows, the last one aside."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: What a Python worker keeps from task to task, by the step that uses it.
_KEPT: dict[str, dict] = {}


def kept(step: str, key, make):
    """What make returns, kept by this process for tasks of the step."""
    own = _KEPT.setdefault(step, {})
    if key not in own:
        own[key] = make()
    return own[key]


def forget(but: str = "") -> None:
    """Let go what this process keeps for all steps but one."""
    for step in [x for x in _KEPT if x != but]:
        del _KEPT[step]


def trimmed(run, keeps: str = ""):
    """run, which gives freed memory back when a task or group ends: Python workers live on from stage to stage.

    What the worker keeps for steps other than `keeps` goes first.
    """

    @functools.wraps(run)  # Spark reads from the annotations how a group comes
    def task(batches):
        forget(keeps)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return task


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def split_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lowered: bytes methods know ASCII white space and letters only."""
    return text.lower().split()


def keyed(docs: DataFrame, space: Workspace) -> DataFrame:
    """docs with _row, which tells apart the rows whose doc_id is null or repeated; it is 0 for all others.

    Only those rows need a key that each reading finds again, so only they are written.
    """
    odd = space.table(docs.groupBy(F.col("doc_id").alias("_of")).count().filter("count > 1 or _of is null"), "repeated")
    if odd.isEmpty():
        return docs.withColumn("_row", F.lit(0).cast("long"))
    more = odd.filter("_of is not null")
    theirs = docs.filter("doc_id is null").unionAll(docs.join(more, F.col("doc_id") == F.col("_of"), "left_semi"))
    theirs = space.table(theirs.withColumn("_row", F.monotonically_increasing_id() + 1), "odd-rows")
    own = docs.filter("doc_id is not null").join(more, F.col("doc_id") == F.col("_of"), "left_anti")
    return own.withColumn("_row", F.lit(0).cast("long")).unionAll(theirs)


def held_out(doc_id: str = "doc_id", modulus: int = 10, remainder: int = 0):
    return F.crc32(F.col(doc_id).cast("string")) % modulus == remainder
