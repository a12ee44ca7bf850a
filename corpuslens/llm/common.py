"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a Python function gets at once; bounds a worker's memory.
SLICE_ROWS = 256
#: Bytes of text after which a slice ends, however few its rows.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, sized_by: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most SLICE_ROWS rows and about SLICE_BYTES bytes."""
    n = batch.num_rows
    if sized_by is None:
        for at in range(0, n, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(sized_by)), 0).to_pylist()
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and (i - at >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < n:
        yield batch.slice(at, n - at)


def map_slices(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, sized_by: str = "text") -> DataFrame:
    """mapInArrow over bounded slices.

    ``make`` runs once in each task and returns the function of a slice; a
    slice is a dict of column lists, and so is what the function returns.
    Tasks are independent and deterministic, so a lost executor costs only the
    repetition of its tasks.
    """
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, sized_by):
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def kept_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    """The rows whose text a function keeps, with all columns, whatever their names; columns go by their places.

    ``make`` gives, once in each task, a function from texts to {"kept": booleans}.
    """
    names = df.columns
    at = names.index(text_col)
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))

    def run():
        keep = make()
        return lambda part: part | keep(part[f"c{at}"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema)) + ", kept boolean"
    return map_slices(plain, run, schema, sized_by=f"c{at}").where("kept").drop("kept").toDF(*names)


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows, so that very long texts don't add up; a lower setting of the session stays."""
    given = int(spark.conf.get(BATCH_ROWS, "10000"))
    if not 0 < given <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: that of spark.checkpoint.dir, which a cluster must name."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set, and a machine's own folder is not shared")
        import tempfile

        base = tempfile.mkdtemp(prefix="corpuslens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, id_col: str, n: int, salt: str) -> DataFrame:
    """Rows of the ``n`` ids with the least hashes, one row of each id; never more than ``n``, and the same ones in each run.

    Two times as many hashes as are wanted, by their share of the table, are
    ordered; texts are read only for the rows that are taken.
    """
    h = F.xxhash64(F.col(id_col), F.lit(salt))
    total = df.count()
    cut = min((1 << 63) - 1, (2 * n << 64) // max(1, total) - (1 << 63))
    least = df.select(h.alias("h")).where(F.col("h") <= cut).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if least is None:
        return df.where(F.lit(False))
    one = df.select(h.alias("_h"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")).where(F.col("_h") <= least).groupBy("_h").agg(F.min("_row").alias("_row"))
    return one.select("_row.*")


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all training.  A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))
