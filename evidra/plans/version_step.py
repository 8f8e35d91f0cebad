"""One version step: what new rows change is written as the new version's part of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.operators import summaries as SU
from evidra.sources import changelog, snapshot
from evidra.sources.normalize import KEYS, one_per_key


def delta(previous: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The new rows of which the key, or something about it, is not stored yet."""
    keys = KEYS[name]
    return changelog.changes(previous, one_per_key(new, keys), keys, name)


def step(
    spark: SparkSession, root: str, old: str, new: str, incoming: dict[str, DataFrame], description: str = "",
    deletes: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Write version ``new`` as what ``incoming`` and ``deletes`` change in ``old``; returns (metric, before, after, delta).

    Rows of earlier versions are not written again. A row of a known key is merged into the stored one by the
    table's rules when it is read; ``deletes`` holds the keys of rows that end with ``old``.
    """
    deletes = deletes or {}
    names = [*incoming, *(n for n in deletes if n not in incoming)]
    before = {n: snapshot.load_version(spark, root, n, old) for n in names}
    for n in names:
        gone = deletes.get(n)
        known = before[n] if gone is None else before[n].join(gone.select(*KEYS[n]), KEYS[n], "left_anti")
        rows = delta(known, incoming[n], n) if n in incoming else None
        changelog.append(spark, root, n, new, old, rows, gone)
    after = {n: snapshot.load_version(spark, root, n, new) for n in names}
    counts = SU.counts(**after)
    snapshot.append_version(spark, root, new, old, counts, description)
    return SU.stats_delta(SU.counts(**before), counts)
