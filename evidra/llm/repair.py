"""Repair of conversations by weighted CYK parsing of their rows (operator 12).

A conversation is a string of rows, and the repair grammar says which edits turn it into a legal string of
role initials, ``(s?(ua)+)?``. In Chomsky normal form its nonterminals are N(p, q), "the rows of this span
take the roles' state from p to q", with N(p, q) -> N(p, r) N(r, q) for all states r and, for a single row,
the edits keep, rerole and delete. Inserted turns derive from the empty span, so every one-row span is
closed under insertions on both sides. A cell is the least (cost, audit) of a nonterminal over a span, audit
being the edits' initials.

The nonterminals of one span hold for every way to split it, because each names the states at both ends: one
split of a span gives the same least cells as all of them. So spans are built bottom-up by length, 1, 2, 4
and so on: within a run of rows in the task that has them, then over up to ``FAN`` runs, up to whole
conversations. Equal costs over one span never give audits of which one begins the other (they differ
by insertions, which cost), so the least audit of a span is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidra.llm.common import batch, written

#: The costs of the edits and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
MOVES = {(0, 1): "s", (0, 2): "u", (1, 2): "u", (2, 3): "a", (3, 2): "u"}
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
#: Rows of a run are at most 2^RUN positions apart; each further round joins the runs of 2^FAN as many.
RUN, FAN = 12, 5
#: Rows of a range partition of the sorted table, about.
PARTITION_ROWS = 250_000

Cell = tuple[int, str]
Cells = tuple[Cell | None, ...]
_RULES = [(4 * p + q, 4 * p + r, 4 * r + q) for p in range(4) for q in range(p and 1, 4) for r in range(4)]


def _least(a: Cell | None, b: Cell | None) -> Cell | None:
    return b if a is None else a if b is None else min(a, b)


def combined(x: Cells, y: Cells) -> Cells:
    """The cells of a span from those of its two halves."""
    out: list[Cell | None] = [None] * 16
    for to, left, right in _RULES:
        a, b = x[left], y[right]
        if a is not None and b is not None:
            c = (a[0] + b[0], a[1] + b[1])
            if out[to] is None or c < out[to]:
                out[to] = c
    return tuple(out)


@lru_cache(None)
def inserted() -> Cells:
    """The empty span: user and assistant turns inserted out of nothing, closed under concatenation."""
    cells: list[Cell | None] = [(0, "") if p == q else (INSERT, "I") if MOVES.get((p, q), "s") != "s" else None for p in range(4) for q in range(4)]
    while True:
        closed = tuple(_least(a, b) for a, b in zip(cells, combined(tuple(cells), tuple(cells))))
        if closed == tuple(cells):
            return closed
        cells = list(closed)


@lru_cache(None)
def row_cells(initial: str, bad: bool, truncated: bool) -> Cells:
    """The cells of one row, with insertions before and after it; a bad row can only be deleted."""
    cells: list[Cell | None] = [(DELETE, "D") if p == q else None for p in range(4) for q in range(4)]
    for (p, q), letter in MOVES.items():
        if not bad and initial == letter:
            cells[4 * p + q] = (TRUNCATED * truncated, "K")
        elif not bad and letter != "s":
            cells[4 * p + q] = (REROLE + TRUNCATED * truncated, "R")
    return combined(combined(inserted(), tuple(cells)), inserted())


def parsed(spans: list[Cells]) -> Cells:
    """The cells of adjacent spans together, by doubling the length of spans."""
    while len(spans) > 1:
        pairs = [combined(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0] if spans else inserted()


def cheapest(cells: Cells) -> Cell:
    """The repair of a whole conversation, which starts from nothing and ends after an assistant or empty."""
    return min(c for c in (cells[q] for q in FINAL) if c is not None)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows as the audit's damage leaves them; ``copies`` is 0 for a
    dropped row and 2 for a repeated one. Nulls in role and text, and in the damage key, are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` in the order of (conv_id, turn, role, text), nulls first, as a table in which ``at`` ascends.

    A range sort: a conversation of any size is cut over as many partitions as its rows need.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "_copy"]
    numbered = rows.withColumn("_copy", F.monotonically_increasing_id())  # spreads equal rows; they are alike
    parts = max(1, rows.count() // PARTITION_ROWS)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    dealt = numbered.repartitionByRange(max(parts, _partitions(rows)), *order).sortWithinPartitions(*order)
    return written(
        dealt.select(
            F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", "text", "copies",
            F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
        )
    )


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


BLOCK = "conv_id long, at long, first string, last string, illegal long, costs array<long>, audits array<string>"


def _block(conv, at: int, first: str, last: str, illegal: int, cells: Cells) -> tuple:
    return conv, at, first, last, illegal, [None if c is None else c[0] for c in cells], [None if c is None else c[1] for c in cells]


def _blocks_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())
    names = [f.split()[0] for f in BLOCK.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _runs(batches):
    """A block per conversation and stretch of 2^RUN positions, from rows in order."""
    memory: dict[tuple, Cells] = {}

    def small(leaves: tuple) -> Cells:
        if leaves not in memory:
            memory[leaves] = parsed([row_cells(*leaf) for leaf in leaves])
        return memory[leaves]

    def block(key, leaves: list[tuple]):
        spans = [small(tuple(leaves[i : i + 2])) for i in range(0, len(leaves), 2)]
        return _block(key[0], held_at, raw[0], raw[-1], _illegal(raw), parsed(spans))

    held_key, held_at, leaves, raw, out = None, 0, [], [], []
    for rows in batches:
        cols = [rows.column(c).to_pylist() for c in ("conv_id", "at", "initial", "bad", "truncated", "copies")]
        for conv, at, initial, bad, truncated, copies in zip(*cols):
            key = conv, at >> RUN
            if key != held_key:
                if leaves:
                    out.append(block(held_key, leaves))
                held_key, held_at, leaves, raw = key, at, [], []
            leaf = initial if initial in ("s", "u", "a") else "", bad, truncated and not bad
            leaves.append(leaf)
            raw.append(initial)
            for _ in range(copies - 1):
                leaves.append((leaf[0], True, False))
                raw.append(initial)
        if len(out) >= 512:
            yield _blocks_batch(out)
            out = []
    if leaves:
        out.append(block(held_key, leaves))
    yield _blocks_batch(out)


def _merged(table: pa.Table) -> pa.Table:
    """Adjacent blocks of one conversation as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    spans = [tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])) for r in rows]
    joints = _illegal_joints(rows)
    one = _block(rows[0]["conv_id"], rows[0]["at"], rows[0]["first"], rows[-1]["last"], sum(r["illegal"] for r in rows) + joints, parsed(spans))
    return pa.Table.from_batches([_blocks_batch([one])])


def _illegal_joints(rows: list[dict]) -> int:
    return sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))


def _audited(batches):
    for rows in batches:
        best = []
        for r in rows.to_pylist():
            cells = tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"]))
            best.append((r["conv_id"], r["illegal"], *cheapest(cells)))
        yield batch(AUDIT, *([list(c) for c in zip(*best)] if best else [[]] * 4))


AUDIT = "conv_id long, illegal long, cost long, audit string"


def audits(sorted_rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conv_id of :func:`ordered` rows.

    A conversation without rows has zeros and an empty audit.
    """
    slim = sorted_rows.where("copies > 0").select("conv_id", "at", "turn", "digest", "initial", "blank", "truncated", "copies")
    # ``at`` ascends with the order, so the least one of equal rows is the one seen first; it is a key of its own.
    firsts = slim.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    again = F.col("_first").isNull()
    marked = slim.join(firsts, "at", "left").select(
        "conv_id", "at", "initial", "copies", again.alias("again"), "blank", (F.col("blank") | again).alias("bad"), "truncated"
    )
    marked = written(marked)
    dealt = marked.repartitionByRange(max(1, _partitions(marked)), "at").sortWithinPartitions("at")
    blocks = written(dealt.mapInArrow(_runs, BLOCK))
    done = None
    for shift in range(RUN + FAN, 64 + FAN, FAN):  # conversations over several runs, round by round
        several = blocks.groupBy("conv_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("conv_id").alias("_c"))
        whole = blocks.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
        done = whole if done is None else done.unionByName(whole)
        open_ = blocks.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
        level = F.shiftright("at", min(shift, 63)).alias("_level")
        blocks = written(open_.select("*", level).groupBy("conv_id", "_level").applyInArrow(_without_level, BLOCK))
        if blocks.isEmpty():
            break
    found = done.mapInArrow(_audited, AUDIT).withColumnRenamed("conv_id", "_c")

    present = F.col("copies") > 0
    turn = F.when(present, F.col("turn"))
    gaps = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    spans = sorted_rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"))
    many = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    blank, sound = F.col("blank"), ~F.col("blank")
    faults = marked.groupBy(F.col("conv_id").alias("_f")).agg(
        many(F.when(blank, F.col("copies"))).alias("blank"),
        many(F.when(sound, F.col("copies") - F.when(F.col("again"), 0).otherwise(1))).alias("duplicate"),
        many(F.when(sound & ~F.col("again") & F.col("truncated"), 1)).alias("truncated"),
    )
    out = spans.join(faults, F.col("conv_id").eqNullSafe(F.col("_f")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", F.col("gaps").cast("long").alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
    )


def _without_level(table: pa.Table) -> pa.Table:
    return _merged(table.drop_columns(["_level"]))


VERDICT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
EDITED = "conv_id long, place long, edit string, role string, text string"
DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _streams(batches):
    """For each conversation its verdict row and then its repaired rows, as they come.

    Input: a conversation's verdict (``at`` null) followed by its rows in order; one row is held at a time.
    """
    verdict = letters = None
    at = place = length = 0

    def role_at(place: int) -> str:
        return ("user", "assistant")[(place - length % 2) % 2]

    def insertions():
        nonlocal at, place
        while at < len(letters) and letters[at] == "I":
            yield "row", (verdict["conv_id"], place, "I", role_at(place), "")
            at, place = at + 1, place + 1

    for rows in batches:
        for r in rows.to_pylist():
            if r["at"] is None:
                if verdict is not None:
                    yield from insertions()
                verdict, letters = r, r["audit"]
                at = place = 0
                length = len(letters) - letters.count("D")
                yield "verdict", r
                continue
            for _ in range(r["copies"]):
                yield from insertions()
                edit = letters[at]
                at += 1
                if edit != "D":
                    yield "row", (r["conv_id"], place, edit, r["role"] if edit == "K" else role_at(place), r["text"])
                    place += 1
    if verdict is not None:
        yield from insertions()


def _edited(batches):
    held, size = [], 0
    for kind, r in _streams(batches):
        if kind == "row":
            held.append(r)
            size += len(r[4]) + 50
            if size > 1 << 20:
                yield batch(EDITED, *[list(c) for c in zip(*held)])
                held, size = [], 0
    if held:
        yield batch(EDITED, *[list(c) for c in zip(*held)])


def _digested(batches):
    held, verdict, digest = [], None, None

    def close():
        held.append((verdict["conv_id"], *(verdict[c] for c in VERDICT), digest.hexdigest()))

    for kind, r in _streams(batches):
        if kind == "verdict":
            if verdict is not None:
                close()
            verdict, digest, first = r, hashlib.sha256(), True
            if len(held) >= 4096:
                yield batch(DIGESTS, *[list(c) for c in zip(*held)])
                held.clear()
        else:
            digest.update((("" if first else "\n") + f"{r[3]}:{r[4]}").encode())
            first = False
    if verdict is not None:
        close()
        yield batch(DIGESTS, *[list(c) for c in zip(*held)])


def _with_rows(verdicts: DataFrame, sorted_rows: DataFrame) -> DataFrame:
    """Verdicts and rows of each conversation behind one another, in the order of :func:`_streams`."""
    none = [F.lit(None).cast("long").alias(c) for c in VERDICT[:-1]] + [F.lit(None).cast("string").alias("audit")]
    rows = sorted_rows.where("copies > 0").select("conv_id", "at", "role", "text", "copies", *none)
    heads = verdicts.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("at", "long"), ("role", "string"), ("text", "string"), ("copies", "int"))], *VERDICT)
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("at"))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the cheapest legal form of every conversation.

    ``rows`` has conv_id, turn, role, text and copies, as :func:`damaged` gives them.
    """
    table = ordered(rows)
    return _with_rows(written(audits(table)), table).mapInArrow(_edited, EDITED)


def repair_audit(conversations: DataFrame) -> DataFrame:
    """One row of counts, cost, audit and digest of the repaired rows for every conv_id, null included.

    Rows are damaged, ordered by turn (nulls first; equal turns by role and text, in code-point order), and
    repaired. Nulls in role and text are one space; a null conv_id is a conversation of its own. Repeated rows are
    duplicates. A conversation of which nothing is left has zeros, an empty audit and the empty string's
    digest; an empty table gives no rows. Only conv_id, turn, role and text are read. SHA-256 is sequential: the
    rows of one conversation pass through one task as a stream, of which it holds a batch.
    """
    table = ordered(damaged(conversations))
    return _with_rows(written(audits(table)), table).mapInArrow(_digested, DIGESTS)
