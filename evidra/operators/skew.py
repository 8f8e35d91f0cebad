"""Joins of a large side with hot keys to lookup sides that have one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType

from evidra.session import cut_lineage

HOT_ROWS = 5_000_000
BROADCAST_ROWS = 50_000
#: Buckets that rows without a key are dealt to; they match nothing.
NULL_SALTS = 1_024


def hot_keys_of(facts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[DataFrame | None]:
    """For each key column: (key, _salts) of its values with more than ``hot_rows`` facts, or None.

    At most rows / hot_rows of them exist. All columns are counted in one pass that combines map-side; a
    value gets a salt for every ``hot_rows`` of its rows, so no task takes more than about that many.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).cast("string").alias("k")) for i, k in enumerate(keys)]))
    counts = facts.select(listed.alias("c")).where("c.k is not null").groupBy("c.i", "c.k").agg(F.count("*").alias("n"))
    hot = cut_lineage(counts.where(F.col("n") > hot_rows))
    found = {r["i"] for r in hot.select("i").distinct().collect()}  # at most one row per key column
    kinds = dict(facts.dtypes)
    salts = F.ceil(F.col("n") / hot_rows).cast("int").alias("_salts")
    return [hot.where(F.col("i") == i).select(F.col("k").cast(kinds[k]).alias(k), salts) if i in found else None for i, k in enumerate(keys)]


def hot_keys(facts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """See :func:`hot_keys_of`."""
    return hot_keys_of(facts, [key], hot_rows)[0]


def frequent_keys(facts: DataFrame, keys: Sequence[str], hot_rows: int) -> list[DataFrame | None]:
    """Like :func:`hot_keys_of`, but a sketch finds the keys of over about ``hot_rows`` facts, so nothing is shuffled.

    At most the ``BROADCAST_ROWS`` most frequent values of a column are told.
    """
    most = min(facts.count() // hot_rows, BROADCAST_ROWS)
    if not most:
        return [None] * len(keys)
    tracked = min(1_000_000, max(1_000, 100 * most))
    sketch = cut_lineage(facts.agg(*[F.expr(f"approx_top_k({k}, {most}, {tracked})").alias(k) for k in keys]))
    salts = F.ceil(F.col("f.count") / hot_rows).cast("int").alias("_salts")
    found = [sketch.select(F.explode(k).alias("f")).where(F.col("f.item").isNotNull() & (F.col("f.count") > hot_rows)).select(F.col("f.item").alias(k), salts) for k in keys]
    return [None if hot.isEmpty() else hot for hot in found]


def lookup_with(
    facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None, apart: bool = False
) -> DataFrame:
    """The join itself, for hot keys that are already known.

    Rows without a key are kept or dropped as the join says, but dealt over ``NULL_SALTS`` buckets; a hot
    key's rows over its salts, and only its lookup row is repeated, once per salt. With ``apart``, up to
    ``BROADCAST_ROWS`` hot keys are looked up where their rows are, by broadcast; the facts are read twice then.
    """
    if how not in ("left", "inner"):
        raise ValueError("facts must be the preserved side")
    hashable = [f.name for f in facts.schema if not isinstance(f.dataType, MapType)]
    spread = F.xxhash64(*hashable)
    empty = F.pmod(spread, F.lit(NULL_SALTS)).cast("int")
    if hot is None:
        if how == "inner":
            return facts.where(F.col(key).isNotNull()).join(lookup, key, how)
        left = facts.withColumn("_salt", F.when(F.col(key).isNull(), empty).otherwise(0))
        # Exploded, as a literal would be folded out of the join's keys.
        return left.join(lookup.withColumn("_salt", F.explode(F.array(F.lit(0)))), [key, "_salt"], how).drop("_salt")
    marked = F.broadcast(hot)  # few keys, see hot_keys_of
    if apart and hot.count() <= BROADCAST_ROWS:
        known = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
        told = facts.join(known, key, "left")
        few = F.broadcast(lookup.join(F.broadcast(hot.select(key)), key, "left_semi"))
        cold = lookup_with(told.where("_hot IS NULL").drop("_hot"), lookup, key, how)
        return cold.unionByName(told.where("_hot").drop("_hot").join(few, key, how))
    salt = F.when(F.col(key).isNull(), empty).when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")).cast("int")).otherwise(0)
    left = facts.join(marked, key, "left").withColumn("_salt", salt).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = lookup.join(marked, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def salted_lookup(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``facts.join(lookup, key, how)`` with keys of more than ``hot_rows`` facts, and null keys, split up."""
    return salted_lookups(facts, [(lookup, key)], how, hot_rows)


def salted_lookups(
    facts: DataFrame, lookups: Sequence[tuple[DataFrame, str]], how: str = "left", hot_rows: int = HOT_ROWS, apart: bool = False
) -> DataFrame:
    """Several lookups in a row; hot keys are counted on the facts as they come in, in one pass.

    A lookup has one row per key, so it adds no rows and the counts stay an upper bound.
    """
    out = facts
    for (lookup, key), hot in zip(lookups, hot_keys_of(facts, [key for _, key in lookups], hot_rows)):
        out = lookup_with(out, lookup, key, how, hot, apart)
    return out


def checked_lookup(
    facts: DataFrame, small: DataFrame, key: str, how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Lookup into a side expected to be small, such as one row per property type.

    It is materialised and counted: up to ``max_rows`` rows it is broadcast and the facts are
    not shuffled at all; beyond, hot keys are salted.
    """
    small = cut_lineage(small)
    if small.count() <= max_rows:
        return facts.join(F.broadcast(small), key, how)
    return salted_lookup(facts, small, key, how)
