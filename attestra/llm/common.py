"""Helpers that every operator of this subpackage shares.

* ``shared_root``  the folder that driver and executors share (of the session);
* ``stored``       write a frame there and read it again, which cuts lineage
  and lets a lost executor be survived;
* ``pick``         take the columns an operator needs from a table that may
  have extra columns, in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder as shared_root

#: Rows, and bytes, in one Arrow batch handed to Python, and bytes of text that
#: are worked on together.
ARROW_ROWS, ARROW_BYTES, SLICE_BYTES = 512, 64 << 20, 8 << 20


#: What empties the tables that an operator keeps in a worker process.
_WORKER_TABLES: dict[str, Callable[[], None]] = {}


def worker_tables(owner: str, empty: Callable[[], None]) -> None:
    _WORKER_TABLES[owner] = empty


def take_worker(owner: str) -> None:
    """Worker processes are used again by later stages: whoever starts in one
    empties the tables of the others, so that they don't add up."""
    for name, empty in _WORKER_TABLES.items():
        if name != owner:
            empty()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/attestra/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows and bytes of the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def byte_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts hold at most so many bytes (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    yield batch.slice(start)


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns`` of ``df``; extra columns are ignored."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that hold more than one of this many parts of all rows are hot, so there
#: are at most so many; the rows of each are dealt to ``SALTS`` places.
HOT_PARTS, SALTS = 200, 32


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """The hot keys of a table of counts: at most ``HOT_PARTS``, at any size."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > total / HOT_PARTS).select(key).collect()]


def salted_join(rows: DataFrame, one: DataFrame, key: str, hot: list, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row per key; the rows of hot keys are
    spread by a hash of ``by``, and the hot rows of ``one`` copied to match."""
    is_hot = F.col(key).isin(hot)
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    copied = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
