"""Personal data, conversation repair and source divergence against plain versions on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evidra.llm import divergence, lstm_crf, pii, repair
from evidra.llm.pii_rules import KINDS, base_spans, luhn

# --- conversation repair ---

WS = " \t\n\x0b\x0c\r"
CONV = "conv_id long, turn long, role string, text string, cost long, audit string, at long, _level string"


def faults(rows):
    """(initial, bad, truncated) and the fault of each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(WS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def plain_best(rows):
    """The cheapest (cost, audit) by trying states row by row, without spans."""
    insertions = {(0, 0): "", (1, 1): "", (2, 2): "", (3, 3): "", (0, 2): "I", (0, 3): "II", (1, 2): "I", (1, 3): "II", (2, 3): "I", (3, 2): "I"}
    best = {q: (2 * len(s), s) for (p, q), s in insertions.items() if p == 0}
    for initial, fault in faults(rows):
        step = defaultdict(list)
        for p, (cost, audit) in best.items():
            step[p].append((cost + 3, audit + "D"))
            if fault in ("", "truncated"):
                for (a, b), letter in repair.MOVES.items():
                    if a == p and (letter == initial or letter != "s"):
                        step[b].append((cost + (fault == "truncated") + (0 if letter == initial else 2), audit + ("K" if letter == initial else "R")))
        after = defaultdict(list)
        for p, found in step.items():
            for (a, b), s in insertions.items():
                if a == p:
                    after[b].append((min(found)[0] + 2 * len(s), min(found)[1] + s))
        best = {q: min(x) for q, x in after.items()}
    return min(best[q] for q in (0, 3) if q in best)


def plain_repair(rows):
    """The audit's columns of one conversation's (turn, role, text) rows after damage, in order."""
    cost, audit = plain_best([r[1:] for r in rows]) if rows else (0, "")
    marks = faults([r[1:] for r in rows])
    count = Counter(f for _, f in marks)
    letters = [i for i, _ in marks]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    size, out, at = len(audit.replace("D", "")), [], 0
    for e in audit:
        role = ("user", "assistant")[(len(out) - size % 2) % 2]
        if e == "I":
            out.append(f"{role}:")
            continue
        _, own, text = rows[at]
        at += 1
        if e != "D":
            out.append(f"{own if e == 'K' else role}:{text}")
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_audit(rows):
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        damaged[conv]
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        damaged[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: plain_repair(sorted(r, key=order)) for conv, r in damaged.items()}


def conversation_rows():
    rng = random.Random(4)
    texts = ["Fine.", "Fine.", "so what", "Really? ", "", None, " \n", "é!", "no end,", "Ok!\t", "a.b"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "unknown"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles[: 4 if rng.random() < 0.7 else 9]), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."))
    rows += [(7, 1, "user", "Twice.")] * 3 + [(8, 1, "b", "x."), (8, 1, "a", "y.")]
    rows += [(1000, i, ("user", "assistant")[i % 2], f"Turn {i}." if i % 7 else "again") for i in range(9000)]
    return rows


def test_cells_of_spans_agree_with_row_by_row_search_however_spans_are_split():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["A.", "B.", "c", "", "D!"])) for _ in range(rng.randint(0, 7))]
        leaves = [repair.row_cells(i if i in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for i, f in faults(rows)]
        want = plain_best(rows)
        assert repair.cheapest(repair.parsed(leaves)) == want
        for k in range(1, len(leaves)):
            assert repair.cheapest(repair.combined(repair.parsed(leaves[:k]), repair.parsed(leaves[k:]))) == want


def test_repairs_give_legal_roles_and_no_cheaper_edits_exist():
    for rows in itertools.product([("user", "A."), ("assistant", "b"), ("system", "C."), ("user", "")], repeat=3):
        cost, audit = plain_best(rows)
        assert repair.cheapest(repair.parsed([repair.row_cells(i, f in ("blank", "duplicate"), f == "truncated") for i, f in faults(rows)])) == (cost, audit)
        assert sum(e != "I" for e in audit) == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_conversations_are_audited_as_one_by_one(spark, parts, monkeypatch):
    monkeypatch.setattr(repair, "RUN", 6)
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], CONV).repartition(parts)
    got = repair.repair_audit(frame)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in got.collect()]
    want = plain_audit(rows)
    assert len(found) == len(want)
    for conv, *rest in found:
        assert tuple(rest) == want[conv], conv


def test_repaired_rows_are_legal_and_carry_their_texts(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (2, 0, "user", "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    got = [tuple(r) for r in repair.repaired(frame).orderBy("conv_id", "place").collect()]
    audit = plain_best([r[2:] for r in rows[:3]])[1]
    assert {r[0] for r in got} == {1} and "".join(r[3][0] for r in got) in ("sua", "suaua", "ua")
    assert [r[2] for r in got] == [e for e in audit if e != "D"]


def test_an_empty_table_of_conversations_has_no_rows(spark):
    assert repair.repair_audit(spark.createDataFrame([], CONV)).count() == 0


# --- source divergence ---


def plain_divergence(rows, least, ranks):
    docs = [(lang or "", source or "", text or "") for lang, source, text in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for _, _, t in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        seen, count = Counter(), Counter()
        groups = sorted({s for l, s, _ in docs if l == lang})
        for (l, s, _), w in zip(docs, words):
            if l == lang:
                seen.update(set(w))
                count.update((s, x) for x in w)
        kept = [t for t, n in seen.items() if n >= least]
        v = len(kept)
        total = {s: sum(count[s, t] for t in kept) for s in groups}
        share = {(s, t): 1 + 10**9 * (count[s, t] + 5) // (total[s] + 5 * v) for s in groups for t in kept}
        mean = {t: 1 + 10**9 * (sum(count[s, t] for s in groups) + 5) // (sum(total.values()) + 5 * v) for t in kept}
        for s in groups:
            pairs = [(o, sum(abs(share[s, t] - share[o, t]) for t in kept)) for o in groups if o != s]
            terms = [(t, share[s, t] - mean[t]) for t in kept if count[s, t] and share[s, t] > mean[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, i, f, n + 1) for n, (i, f) in enumerate(order)}
    return out


@pytest.mark.parametrize("shard_rows, held", [(200_000, 300_000), (5, 3)])
def test_divergences_are_those_of_plain_counting(spark, monkeypatch, shard_rows, held):
    monkeypatch.setattr(divergence, "LEAST_DOCUMENTS", 3)
    monkeypatch.setattr(divergence, "RANKS", 4)
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(8)
    vocabulary = ["the", "The", "été", "ÉTÉ", "ß", "a1b", "x-y", "中文", " ", "İ", "z", "{q}", "end."]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for _ in range(120)]
    rows += [("lone", "only", None), ("en", "hot", "the " * 5000), ("xx", "a", ""), ("xx", "b", "once")]
    frame = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], "lang string, source string, text string, n long, value long, item string").repartition(4)
    got = divergence.source_divergence(frame)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_divergence(rows, 3, 4))


def test_shares_divide_exactly_where_products_would_overflow():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 1 << 51, 2000)
    total = count + rng.integers(0, 1 << 51, 2000)
    got = divergence.shares(count, total, 1 << 20)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (n + 5 * (1 << 20)) for c, n in zip(count.tolist(), total.tolist())]


def test_an_empty_table_has_no_divergences(spark, empty):
    assert divergence.source_divergence(empty).count() == 0


# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_rules_find_what_the_patterns_say():
    rng = random.Random(6)
    pieces = ["a", "@", ".", "-", "1", "25", "255", "256", "0007", "+", " ", "(", ")", "b.c", "é", "4111111111111111", "x@y.zz", "１", "\n", "1.2.3.4", "+1 (743) 555-3824", "%"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert base_spans(text) == plain_spans(text), repr(text)


def test_rules_take_linear_time_on_long_runs():
    for text in ("a" * 300_000 + " ", "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "1 " * 150_000, "@" * 300_000):
        base_spans(text)  # a search from every position would take hours


def test_gradients_are_those_of_small_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in lstm_crf.start(rng, 10, 3, pii.TAGS, pii._FOLLOWS).items()}
    symbols, live, tags = rng.integers(0, 9, (6, 4)), np.ones((6, 4)), np.zeros((6, 4), int)
    live[4:, 2] = 0
    tags[1:3, 0], tags[3, 1] = (1, 2), 3
    grads = lstm_crf.gradients(p, symbols, live, tags)[1]
    for name, at in (("table_a", (symbols[1, 0], 1)), ("hidden_a", (1, 5)), ("table_b", (symbols[2, 0], 7)), ("hidden_b", (0, 7)), ("out", (5, 2)), ("bias", (5,)), ("moves", (0, 1))):
        old, sides = p[name][at], []
        for step in (1e-3, -1e-3):
            p[name][at] = old + step
            sides.append(lstm_crf.gradients(p, symbols, live, tags)[0])
        p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - grads[name][at]) < 1e-5, name


def test_the_best_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    p = lstm_crf.start(rng, 10, 3, 3, np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool))
    p["moves"] += rng.normal(0, 1, (3, 3)).astype(np.float32)
    symbols, live = rng.integers(0, 9, (5, 1)), np.ones((5, 1), np.float32)
    em = lstm_crf.emissions(p, symbols, live)[0][:, 0]
    score = lambda path: sum(em[t, k] for t, k in enumerate(path)) + sum(p["moves"][a, b] for a, b in zip(path, path[1:]))
    assert tuple(lstm_crf.decoded(p, symbols, live)[0][:, 0]) == max(itertools.product(range(3), repeat=5), key=score)


def test_pieces_of_windows_are_joined_and_the_best_set_stays():
    text = "x" * 90 + " call 4111.1111.1111.1111 now or mail jo (at) ho.com ok"
    a = text.index("4111")
    halves = [("card", a, a + 9, 5.0, True), ("card", a + 5, a + 19, 5.0, True)]
    assert pii.reconciled(text, halves, []) == [("card", a, a + 19)]
    assert pii.reconciled(text, halves, [("card", a + 2, a + 4)]) == []
    b = text.index("jo (at)")
    both = [("email", b, b + 14, 3.0, False), ("email", b, b + 12, 1.0, False)]
    assert pii.reconciled(text, both, []) == [("email", b, b + 14)]
    assert pii.checked("card", "x 4111.1111.1111.1112 y", 2, 21) is None and pii.checked("ip", "1 . 2 . 3 . 256", 0, 15) is None


@pytest.fixture(scope="module")
def private_rows():
    rng = random.Random(12)

    def card():
        head = "4" + "".join(rng.choices("0123456789", k=14))
        return next(head + d for d in "0123456789" if luhn(head + d))

    makers = [
        lambda: f"{rng.choice(['ann', 'bo', 'li'])}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        card, lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    ]
    words = "the of and in thing ent ation her with at on for is was no".split()
    rows = []
    for i in range(400):
        text = rng.choices(words, k=60)
        if i % 2:
            text[rng.randrange(60)] = makers[i // 2 % 4]()
        rows.append((i, " ".join(text) + "."))
    return rows + [(None, None), (None, ""), (5000, "4" * 4000), (5001, rows[1][1] + " ü " * 3000 + rows[3][1]), (1, rows[1][1])]


def test_the_network_finds_labelled_and_rewritten_spans_and_leaves_plain_text_alone(spark, private_rows, monkeypatch):
    frame = spark.createDataFrame([(*r, "s", "k", 3) for r in private_rows], "doc_id long, text string, spans string, kind string, chance long").repartition(3)
    found = pii.personal_data(frame).collect()
    got = {(r.doc_id, r.spans): r for r in found}
    for doc_id, text in private_rows:
        base = plain_spans(text or "")
        row = next(r for (i, _), r in got.items() if i == doc_id)
        assert [row[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert row.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(row.spans.split(",")) and (base or row.n_added or not row.spans)
    assert len(found) == len(private_rows)
    model = pii.trained(pii.sample(frame.where("doc_id < 200")))
    monkeypatch.setattr(pii, "trained", lambda rows: model)
    assert {(r.doc_id, r.kind, r.start, r.end) for r in pii.personal_spans(frame).where("base").collect()} == {(i, *s) for i, t in private_rows for s in plain_spans(t or "")}
    held = [t for i, t in private_rows if i is not None and 200 <= i < 400]
    base = [plain_spans(t) for t in held]
    alone = pii.added_spans(model, held, [[] for _ in held])
    assert sum(set(b) <= set(a) for a, b in zip(alone, base) if b) >= 0.8 * sum(map(bool, base))
    assert not any(pii.added_spans(model, held, base))
    other = [t.replace("@", " (at) ") for t, b in zip(held, base) if b and b[0][0] == "email"]
    assert sum(map(bool, pii.added_spans(model, other, [[] for _ in other]))) >= 0.8 * len(other)


def test_without_spans_or_rows_nothing_is_added(spark, empty):
    assert pii.personal_data(empty).count() == 0
    plain = spark.createDataFrame([(1, "no data here"), (2, None)], "doc_id long, text string")
    assert [(r.spans, r.n_added) for r in pii.personal_data(plain).orderBy("doc_id").collect()] == [("", 0)] * 2
    assert pii.windows_of("", pii.symbols_of("")) == []
    assert pii.added_spans(None, ["a"], [[]]) == [[]] and pa.array([]).null_count == 0
