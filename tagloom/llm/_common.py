"""Helpers shared by the operators: Arrow mapping over texts, and cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Texts handed to a mapping function at once hold about this many bytes.
BATCH_BYTES = 2 << 20


def lower_ascii(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def held_out(col):
    """True for rows whose crc32(id as text) leaves 2 modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % 4 == 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; set here only where the session names none (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: survives lost executors, ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: as `cut`, for tables that columns make small."""
    place = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete shuffles and checkpoints that nothing refers to: it does once the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def quoted(name: str):
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


class Shelf:
    """Columns that an operator carries along, under the names f0, f1, ... until its results are there.

    No operator uses such a name, so none of the input's names meets one of an operator's own. A column named like
    an output (letter case aside) gives way to the output.
    """

    def __init__(self, columns: list[str], outputs: tuple[str, ...] | list[str]):
        taken = {x.lower() for x in outputs}
        self.names = [c for c in columns if c.lower() not in taken]
        self.keys = [f"f{i}" for i in range(len(self.names))]
        self.put = [quoted(c).alias(k) for c, k in zip(self.names, self.keys)]
        self.back = [F.col(k).alias(c) for c, k in zip(self.names, self.keys)]


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """Inner join of a written table `rows` to a written `table`, which has each key once.

    A key with over 1/(4 x partitions) of the rows is hot, so at most 4 x partitions are: their entries of `table`
    are sent to all tasks (the bound on their number is the bound on the broadcast), and all others meet in a join.
    `count` names the column of `table` that has the number of rows of each key, if there is one.
    """
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1, rows.count() // n)
    counts = table.withColumn("__rows", F.col(count)) if count else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    hot = F.broadcast(cut(counts.where(F.col("__rows") > limit).select(*keys)))
    return rows.join(F.broadcast(table.join(hot, keys, "left_semi")), keys).unionByName(rows.join(hot, keys, "left_anti").join(table, keys))


def batches(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of `column` (strings) with about `limit` bytes each; a longer row is alone in its range."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if size and size + (n or 0) > limit:
            yield start, i
            start, size = i, 0
        size += n or 0
    if start < len(column):
        yield start, len(column)


_kept: dict = {}


def kept(key, make):
    """This worker's value for `key`, made once; only the last key's is kept, as workers outlive the step they serve."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[pa.Array], dict[str, list | pa.Array]]],
    outputs: T.StructType,
    carry: list[str],
) -> DataFrame:
    """`carry` columns of `df` and `outputs`, computed from the texts in Arrow batches of bounded size.

    `make` runs once in each task and returns the function from an Arrow string array to the output columns.
    A carried column whose name (letter case aside) is also an output's gives way to the output.
    """
    shelf = Shelf(carry, outputs.names)
    carry = shelf.keys
    kept = df.select(*shelf.put, quoted(text_col).cast("string").alias("text"))
    schema = T.StructType([*kept.schema.fields[:-1], *[T.StructField(f"out{i}", f.dataType) for i, f in enumerate(outputs)]])
    types = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in parts:
            texts = part.column(len(carry))
            for a, b in batches(texts):
                got = work(texts.slice(a, b - a))
                own = [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, types.field(f"out{i}").type) for i, f in enumerate(outputs)]
                rest = [part.column(i).slice(a, b - a).cast(types.field(i).type) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*rest, *own], schema=types)

    return kept.mapInArrow(run, schema).select(*shelf.back, *[F.col(f"out{i}").alias(f.name) for i, f in enumerate(outputs)])
