"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on this machine alone (as in tests) may leave it unset; it
    gets a temporary folder then.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``durable``, but as a Parquet table in that folder, for wide rows: it is smaller there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores before it as it needs to be no column of the frames (case does not tell names apart)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(data: bytes) -> bytes:
    """bytes.lower() touches A-Z only, which is what the contracts ask for."""
    return data.lower()


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_column(doc_id: Column, modulus: int) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict], tuple | list | None]], schema: str, many: bool = False
) -> DataFrame:
    """Rows of ``df`` through a Python function, Arrow batch by Arrow batch.

    ``make`` builds the function once per task, so that it can hold caches.
    The function gets one value per column and returns one tuple, or with
    ``many`` a list of tuples.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                columns = [c.to_pylist() for c in batch.slice(start, 2000).columns]
                rows = [f(*values) for values in zip(*columns, strict=True)]
                if many:
                    rows = [r for found in rows for r in found]
                if rows:
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)
