"""Helpers shared by the corpus operators: reading, shared folders, Arrow batches, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch that a Python operator turns into Python objects at once.
SLICE_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Tables up to this size on disk are dealt over so many partitions before Python or array work.
SMALL, DEALT = 16 << 20, 24


def spread(df: DataFrame) -> DataFrame:
    """A table of at most SMALL bytes is often one file and one task: deal it over DEALT partitions,
    whatever the number of cores. Larger inputs stay as they are, without a shuffle; no row is left out.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(DEALT) if size <= SMALL else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where both are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` stay within ``limit``, else as it is."""
    return F.broadcast(df) if rows <= limit else df


#: Rows of a list of documents, each an id and a hash, up to which it is broadcast.
LISTED = 1_000_000


def text_key(docs: DataFrame) -> Column:
    """64 bits of a row's text; a null text has its own."""
    return F.xxhash64(docs["text"])


def split_listed(docs: DataFrame, listed: DataFrame, limit: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """The rows that ``listed`` (doc_id, text_key), a written table, names, and those that it doesn't.

    A list of at most ``limit`` rows is broadcast, so that no text is shuffled; a longer one is joined.
    """
    listed = hinted(listed.select(F.col("doc_id").alias("_listed_id"), F.col("text_key").alias("_listed_key")), listed.count(), limit)
    same = docs["doc_id"].eqNullSafe(listed["_listed_id"]) & (text_key(docs) == listed["_listed_key"])
    return docs.join(listed, same, "left_semi"), docs.join(listed, same, "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; pure ASCII texts take the fast byte path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; null ids fall in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def map_texts(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    make: Callable[[], Callable[[list[str]], list]],
    fields: Sequence[T.StructField],
) -> DataFrame:
    """One output row per input row: the ``keys`` as they are, then ``fields`` from the text.

    ``make()`` runs once per task and returns a function from a list of texts (null as None) to a
    list of columns. Batches are cut to SLICE_ROWS rows, so long texts never pile up as objects.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(df.schema[k] for k in keys), *fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                columns = f(part.column(n).to_pylist())
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                arrays += [pa.array(c, type=arrow.field(n + i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*keys, F.col(text).cast("string")).mapInArrow(run, schema)


def hashed_sample(df: DataFrame, key: str, rows: int, n: int | None = None) -> DataFrame:
    """At most ``rows`` of ``n`` rows, chosen by a hash of ``key``: the same rows on every run.

    Beyond twice that many, a bound on the hash that twice the sample is expected to pass goes before
    the sort, so that what tasks hand on grows neither with the input nor with its partitions.
    """
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40))
    n = df.count() if n is None else n
    if n > 2 * rows:
        df = df.filter(h < int((1 << 40) * 2 * rows / n))
    return df.orderBy(h, F.col(key)).limit(rows)
