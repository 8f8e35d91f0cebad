"""How far the sources of a language differ in their use of terms (operator 13), by Arrow compute functions.

Counting: inside mapInArrow a batch of texts is lower-cased (``ascii_lower``), cut (``split_pattern_regex``),
dictionary-encoded and grouped by hash (``group_by``) to (lang, source, term, occurrences, documents). A task
merges these partial counts until they exceed ``HELD`` rows; Spark adds them up by term.

Divergence: the kept terms of a language are dealt over shards by the term's hash. A shard holds all
sources' counts of its terms as columns, next to the groups' totals, and computes shares and differences of
whole shards at once. Sums of pairs add up over shards; a group's top terms of all shards are ranked again.
All arithmetic is on integers: shares are whole parts in 10^9, divided digit group by digit group so that
no product leaves 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from evidra.llm.common import batch, written
from evidra.llm.textcols import slices

#: Fixed values of the audit: least documents of a kept term, smoothing, parts of a whole, ranks of terms.
LEAST_DOCUMENTS, SMOOTH, WHOLE_DIGITS, RANKS = 30, 5, 9, 50
#: Bytes below U+0080 that are no letters separate terms; anything else is part of one.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SLICE = 1 << 20
#: Rows of partial counts that a task holds before it hands them on.
HELD = 300_000
#: Kept (term, source) rows of a shard, about, and cells of shares worked on at once.
SHARD_ROWS, CELLS = 200_000, 1 << 20

COUNTS = "lang string, source string, term string, n long, documents long"
_KEYS = ["lang", "source", "term"]


def _counts_of(part: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of a slice."""
    lowered = pc.ascii_lower(part.column("text"))  # as it is: a cast slice is read from the wrong place
    pieces = pc.split_pattern_regex(lowered, SEPARATORS)
    row, term = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    some = pc.not_equal(term, "")
    encoded = pc.dictionary_encode(pc.filter(term, some))
    flat = pa.table({"row": pc.filter(row, some).cast(pa.int64()), "code": encoded.indices})
    by_row = flat.group_by(["row", "code"]).aggregate([([], "count_all")])
    groups = [pc.dictionary_encode(part.column(c)) for c in ("lang", "source")]
    where = by_row.column("row")
    coded = pa.table(
        {**{c: pc.take(g.indices, where) for c, g in zip(("lang", "source"), groups)}, "code": by_row.column("code"), "n": by_row.column("count_all")}
    )
    counts = coded.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    columns = [pc.take(g.dictionary, counts.column(c)) for c, g in zip(("lang", "source"), groups)]
    term = pc.take(encoded.dictionary, counts.column("code"))
    return pa.table({"lang": columns[0], "source": columns[1], "term": term, "n": counts.column("n_sum"), "documents": counts.column("count_all")})


def _merged(tables: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("documents", "sum")])
    return added.rename_columns({"n_sum": "n", "documents_sum": "documents"}).select(_KEYS + ["n", "documents"])


def _partial(batches):
    held: list[pa.Table] = []
    merged = 0

    def flush(table: pa.Table):
        yield from (batch(COUNTS, *b.columns) for b in table.combine_chunks().to_batches(max_chunksize=50_000))

    for rows in batches:
        for part in slices(rows, "text", SLICE):
            held.append(_counts_of(part))
            if sum(t.num_rows for t in held) > merged + HELD:
                held = [_merged(held)]
                merged = held[0].num_rows
                if merged > HELD:
                    yield from flush(held.pop())
                    merged = 0
    if held:
        yield from flush(_merged(held))


def shares(count: np.ndarray, total: np.ndarray | int, terms: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), by long division in steps of three digits."""
    over = np.asarray(total, np.int64) + SMOOTH * np.asarray(terms, np.int64)
    rest = np.asarray(count, np.int64) + SMOOTH
    whole, rest = np.divmod(rest, over)
    for _ in range(WHOLE_DIGITS // 3):
        digits, rest = np.divmod(rest * 1000, over)
        whole = whole * 1000 + digits
    return whole + 1


SHARD = "lang string, source string, part string, item string, value long"


def _shard_rows(lang, sources: list[str], totals: np.ndarray, terms: int, group: np.ndarray, names: list[str], code: np.ndarray, n: np.ndarray):
    """The shard's part of each pair's sum, and the largest differences of each group."""
    width = len(names)
    whole = np.zeros(width, np.int64)
    np.add.at(whole, code, n)
    mean = shares(whole, int(totals.sum()), terms)
    own = shares(n, totals[group], terms)
    value = own - mean[code]
    keep = np.flatnonzero((value > 0) & (n > 0))
    rank = np.array(names, object)[code[keep]]
    order = np.lexsort((_ranks(rank), -value[keep], group[keep]))
    keep = keep[order]
    g = group[keep]
    place = np.arange(len(keep)) - np.searchsorted(g, g)
    keep = keep[place < RANKS]
    yield batch(
        SHARD, [lang] * len(keep), [sources[i] for i in group[keep]], ["term"] * len(keep), [names[i] for i in code[keep]], value[keep]
    )
    # Shares of all sources, a strip of terms at a time.
    sums = np.zeros((len(sources), len(sources)), np.int64)
    order = np.argsort(code, kind="stable")
    group, code, n = group[order], code[order], n[order]
    strip = max(1, CELLS // len(sources))
    for at in range(0, width, strip):
        a, b = np.searchsorted(code, [at, at + strip])
        counts = np.zeros((len(sources), min(strip, width - at)), np.int64)
        counts[group[a:b], code[a:b] - at] = n[a:b]
        p = shares(counts, totals[:, None], terms)
        for i in range(len(sources) - 1):
            sums[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(1)
    sums += sums.T
    for i, source in enumerate(sources):
        others = [j for j in range(len(sources)) if j != i]
        yield batch(SHARD, [lang] * len(others), [source] * len(others), ["pair"] * len(others), [sources[j] for j in others], sums[i, others])


def _ranks(names: np.ndarray) -> np.ndarray:
    """Positions in the order of the names' UTF-8 bytes, which is that of their code points."""
    return np.unique(names.astype(str), return_inverse=True)[1] if len(names) else np.zeros(0, np.int64)


def _shards(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (lang, shard): the language's groups (no term) and the shard's counts."""
    table = pa.Table.from_batches(list(batches))
    heads = table.filter(pc.is_null(table.column("term"))).sort_by("source")
    rows = table.filter(pc.is_valid(table.column("term")))
    sources = heads.column("source").to_pylist()
    group = pc.index_in(rows.column("source"), heads.column("source").combine_chunks()).to_numpy().astype(np.int64)
    encoded = rows.column("term").combine_chunks().dictionary_encode()
    n = rows.column("n").to_numpy()
    terms = heads.column("terms").to_pylist()[0] if heads.num_rows else 0
    yield from _shard_rows(
        key[0].as_py(), sources, heads.column("n").to_numpy(), terms, group, encoded.dictionary.to_pylist(), encoded.indices.to_numpy().astype(np.int64), n
    )


def kept_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the terms that at least ``LEAST_DOCUMENTS`` documents of their language have."""
    counted = docs.mapInArrow(_partial, COUNTS)
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    everywhere = F.sum("documents").over(Window.partitionBy("lang", "term"))
    return by_source.withColumn("_all", everywhere).where(F.col("_all") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n")


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): differences of every pair of a language's sources, and the
    ``RANKS`` terms that a source uses most above its language's share.

    Nulls in lang, source and text are empty strings, and an empty string is a language or source like any other.
    A group without kept terms has pairs but no terms; a source alone in its language has no pairs. Repeated rows
    are documents of their own; ties rank by the item's bytes; an empty table gives no rows. Only lang, source
    and text are read. Memory: a shard's counts and one number for each pair of a language's sources.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = written(kept_counts(docs))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").groupBy("lang", "source").agg(F.count("*").alias("_d")).join(totals, ["lang", "source"], "left")
    sizes = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("_rows"))
    sizes = sizes.withColumn("shards", F.ceil(F.col("_rows") / SHARD_ROWS)).drop("_rows")
    groups = written(
        groups.join(sizes, "lang", "left").select(
            "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("shards", F.lit(1)).alias("shards")
        )
    )
    per_lang = groups.select("lang", "shards").distinct()
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard")
    rows = kept.join(per_lang, "lang").select("lang", shard, "source", "term", "n", F.lit(None).cast("long").alias("terms"))
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", F.lit(None).cast("string").alias("term"), "n", "terms")
    found = heads.unionByName(rows).groupBy("lang", "shard").applyInArrow(_shards, SHARD)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= RANKS))
