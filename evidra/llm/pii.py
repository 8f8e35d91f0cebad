"""Personal data in texts (operator 11): rules, and a character-level BiLSTM-CRF that adds what they miss.

The network is trained in numpy on a bounded sample of stretches of text whose spans the rules have labelled. Half
of the labelled spans are rewritten first, as people write them to be read but not harvested (``name (at) host``,
``1 [.] 2``, a phone number without its plus), so the network learns what the rules cannot say.

A text is decoded in windows of ``WINDOW`` characters that overlap by ``OVERLAP``. Windows without what any span
must have (an @ or a bracketed at, or ``LEAST_DIGITS`` digits) cannot hold one and are not decoded. Spans of all
windows of a text are reconciled together: pieces that touch a window's edge are joined with their continuation,
spans must pass their kind's exact check (Luhn, parts up to 255, numbers of digits) and leave the rules' spans
alone, and of those that overlap the set with the largest total score stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from evidra.llm import lstm_crf
from evidra.llm.common import batch
from evidra.llm.gru import Adam
from evidra.llm.pii_rules import KINDS, LOCAL, Span, base_spans, luhn

UNITS = 12
WINDOW, OVERLAP, LANES = 160, 64, 1024
#: The sample: about so many documents, of these so many stretches of a kind (and without any), each so long.
SAMPLE_DOCUMENTS, PER_KIND, STRETCH = 20_000, 400, 240
TRAIN_WINDOW, TRAIN_LANES, TRAIN_STEPS, RATE = 64, 192, 200, 0.03
LEAST_DIGITS = 4
SYMBOLS, PAD = 131, 130
TAGS = 1 + 2 * len(KINDS)

_FOLLOWS = np.ones((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    _FOLLOWS[:, 2 + 2 * _k] = False
    _FOLLOWS[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True

_AT = re.compile(r"\s{0,2}[(\[{]\s?at\s?[)\]}]\s{0,2}", re.I)
_DOT = re.compile(r"\s{0,2}[(\[{]\s?(?:dot|\.)\s?[)\]}]\s{0,2}", re.I)
_ANCHOR = re.compile(r"@|[(\[{]\s?at\s?[)\]}]", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\s{0,2}\.\s{0,2}([0-9]+)\s{0,2}\.\s{0,2}([0-9]+)\s{0,2}\.\s{0,2}([0-9]+)")
_IN_EMAIL, _IN_NUMBER = LOCAL - frozenset("."), frozenset("0123456789")
_CARD = re.compile(r"[0-9]+(?:[ ._/-]{1,3}[0-9]+)*")
_PHONE = re.compile(r"(?:\+|00|\()?[0-9]+(?:[ ()./-]{1,3}[0-9]+)*")


def symbols_of(text: str) -> np.ndarray:
    """ASCII as it is with all digits alike; other letters are 128, other characters 129."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(code < 128, code, 128).astype(np.int64)
    out[(code >= 48) & (code <= 57)] = 48
    out[(code >= 0x2000) & (code < 0x2C00)] = 129
    return out


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b, k = max(a, 0), min(b, length), KINDS.index(kind)
        if a < b:
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
    return tags


STRETCHES = "kind string, chance long, stretch string, spans string"


def _stretches(batches):
    """A stretch around one span of each kind that a text has, and one from anywhere."""
    for rows in batches:
        out = []
        for text, chance in zip(rows.column("text").to_pylist(), rows.column("chance").to_pylist()):
            spans = base_spans(text)
            middle = {kind: (a + b) // 2 for kind, a, b in spans} | {"": chance % (len(text) + 1)}
            for kind, at in middle.items():
                a = max(0, min(at - STRETCH // 2, len(text) - STRETCH))
                b = a + STRETCH
                inside = [(k, x - a, y - a) for k, x, y in spans if x < b and y > a]
                out.append((kind, chance, text[a:b], ",".join(f"{k}:{x}:{y}" for k, x, y in inside)))
        if out:
            yield batch(STRETCHES, *[list(c) for c in zip(*out)])


def sample(docs: DataFrame) -> list[tuple[str, list[Span]]]:
    """(stretch, its spans) from rows whose hash falls into a share of about ``SAMPLE_DOCUMENTS`` rows."""
    share = max(1, docs.count() // SAMPLE_DOCUMENTS)
    chance = F.xxhash64("text")
    some = docs.where("text <> ''").select("text", chance.alias("chance")).where(F.pmod("chance", F.lit(share)) == 0)
    order = Window.partitionBy("kind").orderBy("chance", "stretch", "spans")
    picked = some.mapInArrow(_stretches, STRETCHES).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= PER_KIND)
    rows = picked.orderBy("kind", "_r").select("stretch", "spans").collect()
    parse = lambda s: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]
    return [(r.stretch, parse(r.spans)) for r in rows]


def _rewritten(kind: str, value: str, rng: np.random.Generator) -> str:
    """``value`` in a way that the rules do not know; the words and signs are of the choices below."""

    def one(*choices: str) -> str:
        return choices[rng.integers(len(choices))]

    if kind == "email":
        name, host = value.rsplit("@", 1)
        dot = one(".", " [dot] ", "(dot)", "[.]", " (dot) ")
        return name + one(" (at) ", "(at)", " [at] ", "[at]", " {at} ", " @ ") + host.replace(".", dot)
    if kind == "ip":
        return value.replace(".", one("[.]", "(.)", " . ", "[dot]", " (dot) ", ". "))
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "card":
        return one(".", "_", "/", "  ", " - ", " / ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    head, a, b = digits[:-7], digits[-7:-4], digits[-4:]
    area = head[-3:]
    return one(f"({area}) {a}-{b}", f"00{head} {a} {b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"0{head}/{a} {b}", f"{head} {area} {a} {b}")


def _number(rng: np.random.Generator) -> str:
    """A number that is no personal data: dates, amounts, versions, plain runs."""
    n = [int(x) for x in rng.integers(0, 10_000, 4)]
    forms = (f"{1900 + n[0] % 130}-{n[1] % 12 + 1:02}-{n[2] % 28 + 1:02}", f"{n[0]},{n[1] % 1000:03},{n[2] % 1000:03}", f"{n[0]}.{n[1]}", f"{n[0] % 9}.{n[1] % 30}.{n[2] % 30}",
             f"{n[0]}{n[1]}{n[2]}{n[3]}"[: 4 + n[3] % 13], f"{n[0] % 100}:{n[1] % 60:02}", f"{n[0]}-{n[1]}", f"{n[0]} / {n[1]}")
    return forms[rng.integers(len(forms))]


def varied(stretch: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The stretch with half of its whole spans rewritten, and with now and then a plain number."""
    out, moved, last, size = [], [], 0, 0
    for kind, a, b in spans:
        if a < last:
            continue
        out.append(stretch[last:a])
        size += len(out[-1])
        value = stretch[a:b]
        if a > 0 and b < len(stretch) and rng.random() < 0.5:
            value = _rewritten(kind, value, rng)
        moved.append((kind, size, size + len(value)))
        out.append(value)
        size += len(value)
        last = b
    text = "".join(out) + stretch[last:]
    if rng.random() < 0.5:
        spaces = [m for m in range(len(text)) if text[m] == " " and not any(a <= m < b for _, a, b in moved)]
        if spaces:
            at = spaces[rng.integers(len(spaces))]
            number = " " + _number(rng)
            text = text[:at] + number + text[at:]
            moved = [(k, a, b) if a < at else (k, a + len(number), b + len(number)) for k, a, b in moved]
    return text, moved


def trained(rows: list[tuple[str, list[Span]]], seed: int = 0) -> dict[str, np.ndarray] | None:
    """A network of the labelled stretches; None if none of them has a span."""
    if not any(spans for _, spans in rows):
        return None
    rng = np.random.default_rng(seed)
    p = lstm_crf.start(rng, SYMBOLS, UNITS, TAGS, _FOLLOWS)
    adam = Adam(p, RATE)
    for done in range(TRAIN_STEPS):
        symbols = np.full((TRAIN_WINDOW, TRAIN_LANES), PAD, np.int64)
        live, tags = np.zeros(symbols.shape, np.float32), np.zeros(symbols.shape, np.int64)
        for lane in range(TRAIN_LANES):
            text, spans = varied(*rows[rng.integers(len(rows))], rng)
            at = int(rng.integers(max(1, len(text) - TRAIN_WINDOW + 1)))
            part = text[at : at + TRAIN_WINDOW]
            symbols[: len(part), lane], live[: len(part), lane] = symbols_of(part), 1
            tags[: len(part), lane] = tags_of(len(part), [(k, a - at, b - at) for k, a, b in spans])
        adam.update(lstm_crf.gradients(p, symbols, live, tags)[1], RATE * 0.05 ** (done / TRAIN_STEPS))
    return p


def checked(kind: str, text: str, a: int, b: int) -> Span | None:
    """The span, grown to whole words and without blanks and signs around it, if it is what it was taken for."""
    part = _IN_EMAIL if kind == "email" else _IN_NUMBER
    while 0 < a < len(text) and text[a] in part and text[a - 1] in part:
        a -= 1
    while 0 < b < len(text) and text[b] in part and text[b - 1] in part:
        b += 1
    value = text[a:b]
    if kind == "email":
        flat = _DOT.sub(".", _AT.sub("@", value)).replace(" @ ", "@")
        whole = flat.strip(" ,;:.!?\n")
        if not _EMAIL.fullmatch(whole):
            return None
        cut = len(value) - len(value.lstrip(" ,;:.!?\n")), len(value) - len(value.rstrip(" ,;:.!?\n"))
        return kind, a + cut[0], b - cut[1]
    if kind == "ip":
        edge = re.search(r"[0-9]", value)
        if not edge:
            return None
        last = max(i for i, c in enumerate(value) if "0" <= c <= "9")
        parts = _QUAD.fullmatch(_DOT.sub(".", value[edge.start() : last + 1]))
        if not parts or any(len(x) > 3 or int(x) > 255 for x in parts.groups()):
            return None
        return kind, a + edge.start(), a + last + 1
    found = (_CARD if kind == "card" else _PHONE).search(value)
    if not found:
        return None
    x, y = a + found.start(), a + found.end()
    digits = "".join(c for c in text[x:y] if "0" <= c <= "9")
    if (x and text[x - 1].isalnum()) or (y < len(text) and text[y].isalnum()):
        return None
    if kind == "card":
        return (kind, x, y) if 12 <= len(digits) <= 19 and luhn(digits) else None
    return (kind, x, y) if 9 <= len(digits) <= 15 and len(digits) < y - x else None


def windows_of(text: str, symbols: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the windows that can hold a span."""
    n = len(symbols)
    starts = np.arange(0, max(n - OVERLAP, 1), WINDOW - OVERLAP)
    ends = np.minimum(starts + WINDOW, n)
    digits = np.concatenate([[0], np.cumsum(symbols == 48)])
    anchors = np.zeros(n + 1, np.int64)
    for m in _ANCHOR.finditer(text):
        anchors[m.start() + 1] = 1
    anchors = np.cumsum(anchors)
    fit = (digits[ends] - digits[starts] >= LEAST_DIGITS) | (anchors[ends] > anchors[starts])
    return list(zip(starts[fit].tolist(), ends[fit].tolist()))


def _pieces(tags: np.ndarray, gain: np.ndarray):
    """(kind, start, end, gain) of a window's tagged runs."""
    at = np.flatnonzero(tags)
    if not len(at):
        return
    kind = (tags[at] - 1) // 2
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(kind) != 0) | (tags[at][1:] % 2 == 1)])
    heads = np.flatnonzero(new)
    for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(at)]):
        a, b = int(at[x]), int(at[y - 1]) + 1
        yield KINDS[int(kind[x])], a, b, float(gain[a:b].sum())


def reconciled(text: str, pieces: list[tuple[str, int, int, float, bool]], base: list[Span]) -> list[Span]:
    """The added spans of a text from the pieces of all its windows: (kind, start, end, gain, at an edge)."""
    whole: list[list] = []
    for kind, a, b, gain, edge in sorted(pieces, key=lambda x: (KINDS.index(x[0]), x[1], x[2])):
        last = whole[-1] if whole else None
        if last and last[0] == kind and a <= last[2] and (edge or last[4]):
            last[3] += gain * max(0, b - last[2]) / (b - a)  # the overlap is counted once
            last[2], last[4] = max(last[2], b), edge
        else:
            whole.append([kind, a, b, gain, edge])
    own = sorted((a, b) for _, a, b in base)
    found: dict[Span, float] = {}
    for kind, a, b, gain, _ in whole:
        kinds = (kind,) if kind == "email" else (kind, *(k for k in KINDS[1:] if k != kind))  # numbers are told apart by their checks
        span = next(filter(None, (checked(k, text, a, b) for k in kinds)), None)
        if span and not any(x < span[2] and y > span[1] for x, y in own[max(0, bisect_right(own, (span[1], 0)) - 8) : bisect_right(own, (span[2], 0)) + 1]):
            found[span] = max(gain, found.get(span, 0.0))
    # Weighted interval scheduling over all spans of the text.
    spans = sorted(found, key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends, best = [s[2] for s in spans], [(0.0, 0, ())]
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, i)
        with_it = (best[before][0] + found[s], s)
        best.append((*with_it, before) if with_it[0] > best[i][0] else (best[i][0], None, i))
    out, i = [], len(spans)
    while i:
        _, s, to = best[i]
        if s:
            out.append(s)
        i = to
    return out


def added_spans(model: dict | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans beside the base ones, for a list of texts."""
    out: list[list[Span]] = [[] for _ in texts]
    if model is None:
        return out
    lanes: list[tuple[int, int, int, np.ndarray]] = []
    pieces: dict[int, list] = {}

    def decode():
        live = np.zeros((WINDOW, len(lanes)), np.float32)
        symbols = np.full(live.shape, PAD, np.int64)
        for j, (_, a, b, s) in enumerate(lanes):
            symbols[: b - a, j], live[: b - a, j] = s, 1
        tags, gain = lstm_crf.decoded(model, symbols, live)
        for j, (i, a, b, _) in enumerate(lanes):
            for kind, x, y, g in _pieces(tags[: b - a, j], gain[: b - a, j]):
                edge = (x == 0 and a > 0) or (y == b - a and b < len(texts[i]))
                pieces.setdefault(i, []).append((kind, a + x, a + y, g, edge))
        lanes.clear()

    for i, text in enumerate(texts):
        if sum(map(text.count, "0123456789")) < LEAST_DIGITS and not _ANCHOR.search(text):
            continue
        symbols = symbols_of(text)
        for a, b in windows_of(text, symbols):
            lanes.append((i, a, b, symbols[a:b]))
            if len(lanes) == LANES:
                decode()
    if lanes:
        decode()
    for i, found in pieces.items():
        out[i] = reconciled(texts[i], found, base[i])
    return out


SPANS = "doc_id long, kind string, start long, end long, base boolean"
DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def _found(model, rows):
    texts = [t or "" for t in rows.column("text").to_pylist()]
    base = [base_spans(t) for t in texts]
    return base, added_spans(model, texts, base)


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, base) of every span, in code points with the end exclusive."""
    model = docs.sparkSession.sparkContext.broadcast(trained(sample(docs)))  # a few thousand numbers

    def find(batches):
        for rows in batches:
            ids = rows.column("doc_id").to_pylist()
            out = [(i, k, a, b, own) for i, base, more in zip(ids, *_found(model.value, rows)) for own, spans in ((True, base), (False, more)) for k, a, b in spans]
            if out:
                yield batch(SPANS, *[list(c) for c in zip(*out)])

    return docs.select("doc_id", "text").mapInArrow(find, SPANS)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    The numbers and ``base_sha256`` are of the rules' spans, ``spans`` lists these and the ``n_added`` of the network.
    Null texts are empty; rows without spans have zeros, the empty string's digest and no spans; repeated rows and
    null ids are rows like any other; an empty table gives no rows. Without any span in the sample nothing is
    added. Only doc_id and text are read; texts of any length are read whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(sample(docs)))

    def find(batches):
        for rows in batches:
            base, more = _found(model.value, rows)
            counts = [[sum(k == kind for k, _, _ in spans) for spans in base] for kind in KINDS]
            sums = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
            yield batch(DIGEST, rows.column("doc_id"), *counts, sums, [joined(a + b) for a, b in zip(base, more)], [len(b) for b in more])

    return docs.select("doc_id", "text").mapInArrow(find, DIGEST)
