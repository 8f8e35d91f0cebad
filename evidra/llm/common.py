"""Helpers that the operators share: tables, words, working folders, bounded lookups.

Executors import this package; on a cluster ship it with ``--py-files`` (a zip of ``evidra``).
"""

from __future__ import annotations

import uuid
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidra.session import cut_lineage, ensure_checkpoint_dir

WORD = "[^\\x20\\x09-\\x0D]+"
_BREAKS = str.maketrans("\t\n\x0b\x0c\r", "     ")
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most ``BATCH_BYTES``, rather than by row count."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"  # 64 MB where nobody has set it
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder; the caller's files live as long as it does."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that later passes and lost executors reread it."""
    bounded_batches(df.sparkSession)
    return cut_lineage(df)


def words(text: str) -> list[str]:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return [w for w in text.translate(_BREAKS).split(" ") if w]


def crc_part(column: Column, parts: int) -> Column:
    """The row's remainder of the unsigned CRC-32 of its id as text; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lookup_bounded(facts: DataFrame, lookup: DataFrame, key: str, rows: Column, hot_share: float = 0.002) -> DataFrame:
    """``facts LEFT JOIN lookup`` on ``key`` where the lookup knows how many facts a key has.

    ``rows`` is the lookup's column with that count. Keys with more than ``hot_share`` of all counted
    facts number at most 1 / hot_share, so they are broadcast under a proven bound; the other keys are
    shuffled and none of them can fill a task. Null keys match nothing and are not shuffled.
    """
    lookup = written(lookup.withColumn("_n", rows))
    total = lookup.agg(F.sum("_n")).first()[0] or 0
    floor = int(total * hot_share)
    hot = lookup.where(F.col("_n") > floor).drop("_n")
    cold = lookup.where(F.col("_n") <= floor).drop("_n")
    kept = [c for c in lookup.columns if c not in (key, "_n")]
    marked = facts.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    done = marked.where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    rest = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot", *kept)
    return done.unionByName(rest.join(cold, key, "left"))


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "float": pa.float32(), "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32()),
}


def batch(ddl: str, *columns) -> pa.RecordBatch:
    """Columns as a record batch of exactly the types that ``ddl`` names."""
    fields = [f.strip().rsplit(" ", 1) for f in ddl.split(",")]
    arrays = []
    for (_, kind), c in zip(fields, columns, strict=True):
        want = _ARROW[kind]
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        if not isinstance(c, pa.Array):
            c = pa.array(c, type=want) if isinstance(c, list) else pa.array(c)
        arrays.append(c if c.type == want else c.cast(want))
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])
