"""Versioned tables as change logs that are merged when they are read.

A version writes what it changes: rows with ``_op`` ("upsert" or "delete"), ``_no`` (the version's number in its
lineage) and ``_seq`` (the order of writes inside a version). A table as of a version is the replay of its lineage:
a delete ends what was known of a key, and later upserts are merged field by field under the table's rules:

* ``last``   the last write that is not null wins (the default),
* ``first``  the first one that is not null stays, later ones only fill gaps,
* ``name``   a name that does not look like a structure, then the longer, then the smaller one.

The replay is one aggregation that combines map-side, so a key written millions of times is no hot key. Folding a
prefix of the log and replaying the rest gives the same rows, which is what compaction does: it writes the
table as of a version as that version's base, and reading starts there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidra.functions import scalar
from evidra.sources import snapshot
from evidra.sources.normalize import KEYS

META = ["_op", "_no", "_seq"]
#: Fields whose rule is not ``last``, by table; ``*`` stands for all others of the table.
RULES = {"molecules": {"name": "name", "*": "first"}}


def rule_of(name: str, column: str, rules: dict | None = None) -> str:
    own = (RULES if rules is None else rules).get(name, {})
    return own.get(column, own.get("*", "last"))


def _better_name(column: str) -> Column:
    """Ascending order of preference of names."""
    text = F.col(column).cast("string")
    return F.struct(scalar.looks_like_structure(text), -F.length(text), text)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of a log; those of a plain table are upserts of before all versions."""
    def field(column: str, kind: str, default) -> Column:
        have = F.col(column) if column in rows.columns else F.lit(None)
        return F.coalesce(have.cast(kind), F.lit(default)).alias(column)

    return rows.select(*[c for c in rows.columns if c not in META], field("_op", "string", "upsert"), field("_no", "long", 0), field("_seq", "long", 0))


def replayed(log: DataFrame, keys: list[str], name: str = "", rules: dict | None = None) -> DataFrame:
    """The table that a log says: one row per key that is not deleted. Rows with a null key are left out."""
    log = numbered(log).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    fields = [c for c in log.columns if c not in keys and c not in META]
    when = F.struct("_no", "_seq")
    gone = log.where("_op = 'delete'").groupBy(*keys).agg(F.max(when).alias("_gone"))
    live = log.where("_op = 'upsert'").join(gone, keys, "left").where(F.col("_gone").isNull() | (when > F.col("_gone")))

    def merged(c: str) -> Column:
        # Writes of one order are told apart by their values, whatever the layout.
        at = F.struct("_no", "_seq", F.to_json(F.struct(c)))
        if rule_of(name, c, rules) == "name":
            return F.min_by(c, F.when(F.col(c).isNotNull(), _better_name(c)))
        pick = F.min_by if rule_of(name, c, rules) == "first" else F.max_by
        return pick(c, F.when(F.col(c).isNotNull(), at))

    if not fields:
        return live.select(*keys).distinct()
    return live.groupBy(*keys).agg(*[merged(c).alias(c) for c in fields]).select(*[c for c in log.columns if c not in META])


def changes(previous: DataFrame, new: DataFrame, keys: list[str], name: str = "", rules: dict | None = None) -> DataFrame:
    """The rows of ``new`` (one per key) that say something ``previous`` does not."""
    fields = [c for c in new.columns if c not in keys]
    known = [c for c in fields if c in previous.columns]
    old = previous.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in known], F.lit(True).alias("_known"))

    def says_more(c: str) -> Column:
        own, stored = F.col(c), F.col(f"_old_{c}")
        rule = rule_of(name, c, rules)
        if rule == "first":
            return own.isNotNull() & stored.isNull()
        if rule == "name":
            return own.isNotNull() & (stored.isNull() | (_better_name(c) < _better_name(f"_old_{c}")))
        return own.isNotNull() & ~own.eqNullSafe(stored)

    more = F.col("_known").isNull()
    for c in fields:
        more = more | (says_more(c) if c in known else F.col(c).isNotNull())
    return new.join(old, keys, "left").where(more).select(*new.columns)


def log_rows(number: int, upserts: DataFrame | None, deletes: DataFrame | None, keys: list[str], seq: str | None = None) -> DataFrame:
    """A version's part of a log: its deletes first, then its upserts in the order of ``seq``."""
    parts = []
    if upserts is not None:
        order = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
        parts.append(upserts.select("*", F.lit("upsert").alias("_op"), F.lit(number).cast("long").alias("_no"), order.alias("_seq")))
    if deletes is not None:
        least = F.lit(-(1 << 63)).cast("long")
        parts.append(deletes.select(*keys).distinct().select("*", F.lit("delete").alias("_op"), F.lit(number).cast("long").alias("_no"), least.alias("_seq")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def append(
    spark: SparkSession, root: str, name: str, version: str, parent: str | None, upserts: DataFrame | None = None,
    deletes: DataFrame | None = None, keys: list[str] | None = None, seq: str | None = None,
) -> None:
    """Write one version's changes of a table. The same call again writes the same rows in their place."""
    number = 1 if parent is None else len(snapshot.lineage(spark, root, parent)) + 1
    rows = log_rows(number, upserts, deletes, keys or KEYS[name], seq)
    snapshot.save_tables({name: rows}, root, version)
    if parent is not None:
        snapshot.set_parent(spark, root, version, parent)


def _exists(spark: SparkSession, path: str) -> bool:
    probe = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return probe.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(probe)


def _parts(spark: SparkSession, root: str, name: str, version: str) -> list[str]:
    """Folders to read for a version: back to the nearest compacted one."""
    out = []
    for v in snapshot.lineage(spark, root, version):
        base = f"{root}/_base/{name}/version={v}"
        if _exists(spark, base):
            return [*out, base]
        folder = f"{root}/{name}/version={v}"
        if _exists(spark, folder):
            out.append(folder)
    return out


def load(spark: SparkSession, root: str, name: str, version: str, keys: list[str] | None = None, rules: dict | None = None) -> DataFrame:
    """A table as of a version."""
    parts = _parts(spark, root, name, version)
    return replayed(spark.read.option("mergeSchema", "true").parquet(*parts), keys or KEYS[name], name, rules)


def compact(spark: SparkSession, root: str, name: str, version: str, keys: list[str] | None = None, rules: dict | None = None) -> None:
    """Write the table as of ``version`` as the base that it and its successors are read from.

    The log stays as it is, so earlier versions can still be read.
    """
    number = len(snapshot.lineage(spark, root, version))
    base = load(spark, root, name, version, keys, rules)
    base.select("*", F.lit("upsert").alias("_op"), F.lit(number).cast("long").alias("_no"), F.lit((1 << 63) - 1).cast("long").alias("_seq")).write.mode(
        "overwrite"
    ).parquet(f"{root}/_base/{name}/version={version}")
