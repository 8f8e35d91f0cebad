"""Language, scores, quality, similarity, leaks and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidra.llm import gru, jaccard, langid, lm, tiling, weak_quality
from evidra.llm.components import components
from evidra.llm.queries import QUERIES
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


# Similar documents


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=repr)


def similar(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return key(tuple(r) for r in jaccard.similar_documents(docs).collect())


def test_awkward_rows(docs, rows):
    got = key(tuple(r) for r in jaccard.similar_documents(docs).collect())
    # Rows of equal id and text are one document; their set and class are the same.
    assert got == key(brute_components(rows))


def test_empty_table(empty):
    assert jaccard.similar_documents(empty).count() == 0
    assert jaccard.unique_documents(empty).count() == 0


def edited(rng, base, share):
    w = base.split(" ")
    for i in rng.choice(len(w), max(1, int(len(w) * share)), replace=False):
        w[i] = f"e{rng.integers(10**6)}"
    return " ".join(w)


def test_random_near_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(25):
        base = sentence(100 + g, int(rng.integers(6, 120)))
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06]))) for k in range(int(rng.integers(1, 7)))]
    assert similar(spark, rows) == key(brute_components(rows))


def test_a_large_group_and_a_shared_passage(spark):
    rng = np.random.default_rng(6)
    base, passage = sentence(500, 100), sentence(501, 40)
    rows = [(k, edited(rng, base, 0.01)) for k in range(80)]
    rows += [(100 + k, sentence(600 + k, 40) + " " + passage) for k in range(60)]
    rows += [(200 + k, base) for k in range(40)]
    # Chains: each is similar to the next one and not to the one after.
    w = sentence(700, 200).split(" ")
    rows += [(300 + k, " ".join(w[8 * k : 8 * k + 60])) for k in range(10)]
    assert similar(spark, rows) == key(brute_components(rows))


def test_copies_make_no_index_entries(spark):
    """Of exact copies under different ids, and of repeated rows, one is listed."""
    rows = [(i, sentence(1)) for i in range(50)] + [(60, sentence(2))] * 20 + [(70, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.xxhash64("doc_id", "text")).repartition(4)
    classes = docs.where("doc_id IN (0, 60)").select("rid").distinct()
    got = jaccard.prefixes_of(docs, classes, np.zeros(0, np.uint32)).collect()
    assert key((r.rid, r.n) for r in got) == key((r.rid, 56) for r in classes.collect())
    assert all(len(r.data) == 8 * jaccard.prefix_length(56) for r in got)


def test_members_of_balls_may_link_where_leaders_do_not(spark):
    base = sentence(800, 104).split(" ")  # 100 shingles
    rows = []
    for side, lo in ((0, 0), (1, 15)):
        part = base[lo : lo + 80]
        rows += [(10 * side + k, " ".join(part[:k] + base[lo + k : lo + 80 - (k if side else 0)])) for k in range(4)]
        rows.append((10 * side + 5, " ".join(part + (base[80:84] if side == 0 else []))))
    assert similar(spark, rows) == key(brute_components(rows))


def test_one_stays(docs, rows):
    kept = jaccard.unique_documents(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    groups = Counter(c for (_, t), (_, _, c) in zip(rows, brute_components(rows)) if shingles(t) and c is not None)
    with_set = [(d, t) for (d, t), n in got.items() for _ in range(n) if shingles(t)]
    assert {d for d, _ in with_set if d is not None} == set(groups) and len(with_set) == len(set(with_set))
    assert sum(n for (_, t), n in got.items() if not shingles(t)) == sum(1 for _, t in rows if not shingles(t))


def test_lists_are_skipped_by_position_without_loss():
    rng = np.random.default_rng(0)
    n = 700
    low = rng.integers(1, 40, n)
    rows = {"ball": np.arange(n), "comp": rng.integers(0, 90, n), "low": low, "high": low + rng.integers(0, 3, n), "rest": np.maximum(1, low - rng.integers(0, 9, n))}
    rows = {c: v[np.argsort(rows["low"], kind="stable")] for c, v in rows.items()}
    got = {tuple(sorted(p)) for x in jaccard._list_pairs(rows) for p in x.tolist()}
    want = set()
    for i in range(n):
        for j in range(i):
            a, b = ({c: int(v[k]) for c, v in rows.items()} for k in (i, j))
            if a["comp"] != b["comp"] and 4 * a["high"] >= 3 * b["low"] and 4 * b["high"] >= 3 * a["low"] and 7 * min(a["rest"], b["rest"]) >= 3 * (a["low"] + b["low"]):
                want.add(tuple(sorted((a["ball"], b["ball"]))))
    assert got == want


def test_a_group_that_does_not_link_gives_few_pairs(spark, monkeypatch):
    """Texts that share a list and two thirds of their shingles are ruled out by their parities inside the list."""
    words, met = sentence(900).split(" "), []
    rows = [(k, " ".join([*words[:at], f"p{k}", f"q{k}", *words[at + 2 :]])) for k, at in ((k, 4 + k % 50) for k in range(150))]
    texts = jaccard.compared

    def counted(pairs, docs, sets):
        met.append(pairs.count())
        return texts(pairs, docs, sets)

    monkeypatch.setattr(jaccard, "compared", counted)
    got = similar(spark, rows)
    assert got == key(brute_components(rows))
    assert sum(met) < 6 * len(rows)


def test_lists_give_every_pair_that_may_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: int(n)][rng.random(int(n)) > cut], rng.integers(0, 1 << 63, 9).astype(np.uint64)])) for n, cut in zip(rng.integers(20, 400, 90), rng.choice([0.02, 0.1, 0.3], 90))]
    n = np.array([len(s) for s in sets])
    away = np.where(np.arange(90) % 7, 0.0, 0.08)
    cols = {"token": np.repeat([5, 9], 90), "ball": np.tile(np.arange(90), 2), "comp": np.tile(np.arange(90), 2), **{c: np.tile(n, 2) for c in ("low", "high", "rest", "n")}, "away": np.tile(away, 2)}
    table = pa.table({**cols, "bits": [jaccard.folded(jaccard.parities(s)) for s in sets] * 2})
    got = [(r["a"], r["b"]) for b in jaccard._pairs(False)(table.to_batches(max_chunksize=50)) for r in b.to_pylist()]
    likest = [(r["a"], r["b"]) for b in jaccard._pairs(True)(table.to_batches(max_chunksize=50)) for r in b.to_pylist()]
    may = lambda i, j: 1 - len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) <= 0.25 + away[i] + away[j] + 1e-9
    fits = lambda i, j: 4 * n[i] >= 3 * n[j] and 4 * n[j] >= 3 * n[i]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if fits(i, j) and may(i, j)}
    assert want and want <= set(got) and len(got) == len(set(got)) < 90 * 89 // 4
    assert len(likest) <= 90 and {tuple(sorted(p)) for p in likest} <= set(got)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Leaks


def brute_tiles(text, item, least):
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for c in range(len(text)):
                n = 0
                while a + n < len(item) and c + n < len(text) and free_i[a + n] and free_t[c + n] and item[a + n] == text[c + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, c)
        if best[0] < least:
            return out
        n, a, c = best
        for k in range(n):
            free_t[c + k] = free_i[a + k] = False
        out.append(n)


def test_tiles_are_the_longest_first():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64)
        item = rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64)
        got, want = tiling.greedy_tiles(text, item, 3), brute_tiles(text.tolist(), item.tolist(), 3)
        assert sum(n for *_, n in got) == sum(want) and max((n for *_, n in got), default=0) == max(want, default=0)
        assert all(text[a : a + n].tolist() == item[b : b + n].tolist() for a, b, n in got)


def test_leaks(spark, docs, empty):
    item = sentence(900, 40).split(" ")
    moved = " ".join(item[20:] + ["between"] + item[:20])
    cases = [
        (1, "before " + " ".join(item).upper() + " after"), (2, sentence(1, 300) + " " + moved), (3, " ".join(item[:15])), (4, " ".join(item[:21])),
        (5, None), (6, ""), (7, " ".join(x for w in item for x in (w, "gap"))), (None, " ".join(item)),
    ]
    table = spark.createDataFrame(cases, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "too short", 0), (4, "", 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): round(r.coverage, 3) for r in tiling.contaminated(table, benchmark).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0, (4, 1): 0.525, (None, 1): 1.0}
    assert sorted(r.doc_id for r in tiling.decontaminated(table, benchmark).collect()) == [3, 5, 6, 7]
    assert tiling.contaminated(table, benchmark.limit(0)).count() == 0
    assert tiling.contaminated(empty, benchmark).count() == 0
    assert tiling.decontaminated(docs, benchmark).columns == docs.columns
    blocks = list(tiling.item_blocks(benchmark, block_words=15))
    assert sum(len(b.ids) for b in blocks) == 4 and len(blocks) > 1


def test_leaks_of_whole_tables(spark, sf):
    plain = lambda t: " " + " ".join(re.sub(r"[^\w\s]|_", " ", t.lower()).split()) + " "
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs for b in items if plain(b.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_string_tiling"](spark, sf).collect()}
    assert want and got == want


# Quality


def brute_counts(text):
    text = text or ""
    w = words(text, lower=False)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows, empty):
    got = Counter(tuple(r)[:7] for r in weak_quality.quality(docs).collect())
    want = Counter()
    for i, t in rows:
        c = brute_counts(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert weak_quality.quality(empty).count() == 0
    assert weak_quality.quality_kept(empty).columns == empty.columns


def test_quality_query_counts_and_labels(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    judged = [(r.kept, labels[r.doc_id] == 1) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_accuracies_are_found_without_labels():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.7
    chances = [(0.6, 0.3, 0.1), (0.5, 0.4, 0.1), (0.7, 0.2, 0.1), (0.4, 0.3, 0.3)]
    votes = np.stack([np.where(good, *(rng.choice([-1, 0, 1], good.size, p=p) for p in ((0.05, 0.3, 0.65), c))) for c in chances], 1)
    codes = Counter(((votes + 1) * 3 ** np.arange(4)).sum(1).tolist())
    prior, found = weak_quality.fit(codes, 4)
    assert abs(prior - 0.7) < 0.05
    for (bad, fine), c in zip(found, chances):
        assert abs(bad[0] - c[0]) < 0.08 and abs(fine[2] - 0.65) < 0.05
    assert weak_quality.fit({}, 4)[0] == weak_quality.PRIOR


def test_posterior_column_agrees_with_the_plain_one(spark):
    prior, chances = weak_quality.fit({0: 5, 40: 9, 80: 30}, 4)
    codes = spark.range(81).select(F.col("id").cast("int").alias("c"))
    for r in codes.select("c", weak_quality.posterior(F.col("c"), prior, chances).alias("p")).collect():
        assert math.isclose(r.p, weak_quality.posterior_of(weak_quality.unpacked(r.c, 4), prior, chances), rel_tol=1e-9)


def test_quality_plan_has_no_python(spark, sf):
    plan = QUERIES["op8_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Recurrent networks


def test_backpropagation_agrees_with_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.start(rng, 7, 4).items()}
    symbols, keep = rng.integers(0, 7, (6, 3)), (rng.random((6, 3)) > 0.2).astype(float)
    aim = rng.normal(size=(6, 3, 4))
    loss = lambda: float((gru.run(p, symbols, np.zeros((3, 4)), keep)[0] * aim).sum())
    states, kept = gru.run(p, symbols, np.zeros((3, 4)), keep)
    grads = gru.back(p, symbols, kept, aim, keep)
    for name in p:
        for at in [tuple(rng.integers(0, s) for s in p[name].shape) for _ in range(8)]:
            before = p[name][at]
            p[name][at] = before + 1e-3
            up = loss()
            p[name][at] = before - 1e-3
            down = loss()
            p[name][at] = before
            assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-2


def test_reading_agrees_with_training_layout():
    rng = np.random.default_rng(1)
    p = gru.start(rng, 9, 5)
    symbols = rng.integers(0, 9, (4, 6))
    states, _ = gru.run(p, symbols, np.zeros((6, 5), np.float32))
    reader, h = gru.Reader(p), np.zeros((5, 6), np.float32)
    for t in range(4):
        h = reader.step(symbols[t], h)
        assert np.allclose(h.T, states[t], atol=1e-5)


def test_every_position_is_pooled_whatever_the_window():
    model = langid.Model(["a", "b", "c"], seed=3)
    raw = np.random.default_rng(0).integers(0, 256, 900).astype(np.uint8)
    start = np.array([0, 0, 1, 300, 900])
    got = model.pooled(raw, start)
    assert np.allclose(got[0], 0) and np.allclose(got[1:].sum(1), 1, atol=1e-5)
    for i in range(1, 4):
        lone = model.pooled(raw[start[i] : start[i + 1]], np.array([0, start[i + 1] - start[i]]))
        assert np.allclose(lone[0], got[i], atol=1e-5)


def test_languages_of_held_out_documents(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_language_id"](spark, sf).collect()
    assert len(rows) == len(docs) and rows[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_every_label_is_a_language(spark, monkeypatch):
    rows = [(i, f"text {i}", f"l{i % 70}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {lang for lang, _ in langid.sample(docs)} == {r[2] for r in rows}
    monkeypatch.setattr(langid, "STRETCHES", 140)
    assert set(Counter(lang for lang, _ in langid.sample(docs)).values()) == {2}
    monkeypatch.setattr(langid, "MOST_LABELS", 69)
    with pytest.raises(ValueError):
        langid.sample(docs)


def test_language_of_awkward_rows(docs, rows, empty):
    got = langid.languages(docs).collect()
    assert len(got) == len(rows)
    letters = Counter(r.doc_id for r in got if r.lang_pred == "und")
    assert letters == Counter(i for i, t in rows if not any(c.isalpha() for c in t or ""))
    assert langid.languages(empty).count() == 0
    assert langid.language_kept(docs).columns == docs.columns
    assert langid.language_kept(docs).count() == sum(any(c.isalpha() for c in t or "") for _, t in rows)


def brute_base(rows, learn):
    tokens = [words(t) + [None] for _, t in rows]
    counts = Counter(w for t, (i, _) in zip(tokens, rows) if learn(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for t, (i, _) in zip(tokens, rows)]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def test_scores(docs, rows, empty):
    got = key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm.scored(docs).collect())
    assert got == key((*r[:4], round(r[4], 5)) for r in brute_base(rows, lambda i: not held_out(i)))
    assert lm.scored(empty).count() == 0
    alone = lm.scored(docs, F.lit(True)).collect()
    assert len(alone) == len(rows) and {r.n_known for r in alone} == {0}


def test_network_probabilities_add_up_and_state_is_carried():
    class Counts:
        unigrams = np.random.default_rng(0).random(lm.CLASS * lm.CLASSES + lm.TAILS) * 100

    p = lm.start_weights(Counts())
    rng = np.random.default_rng(1)
    p["word_w"] += rng.normal(0, 0.5, p["word_w"].shape).astype(np.float32)
    p["class_w"] += rng.normal(0, 0.5, p["class_w"].shape).astype(np.float32)
    scorer, n = lm.Scorer(p), len(p["word_b"])
    prefix = rng.integers(0, n, 70)  # over two windows
    texts = np.concatenate([np.append(prefix, w) for w in range(n)])
    scores = scorer.score(texts, np.full(n, 71)) - scorer.score(prefix, np.array([70]))
    assert abs((10.0**scores).sum() - 1) < 1e-3


def test_training_lowers_the_loss():
    class Counts:
        unigrams = np.ones(lm.CLASS * lm.CLASSES + lm.TAILS)

    text = np.tile([5, 9, 77, 300, 1200, 0], 3000)
    p = lm.start_weights(Counts())
    before = lm.Scorer(p).score(text[:600], np.array([600]))[0]
    lm.train(p, text)
    assert lm.Scorer(p).score(text[:600], np.array([600]))[0] > 0.5 * before


def test_every_training_document_is_learned_from_once(docs, rows, monkeypatch):
    """A bounded share of the documents would reach few of the words."""
    seen, real = [], lm.trained

    def spy(learning, like, blocks):
        seen.extend(learning.where(F.col("round").between(0, lm.ROUNDS - 1)).where(F.col("block").between(0, blocks - 1)).collect())
        return real(learning, like, blocks)

    monkeypatch.setattr(lm, "trained", spy)
    monkeypatch.setattr(lm, "BLOCK_WORDS", 50)
    lm.scored(docs).count()
    assert Counter(len(r.symbols) // 2 for r in seen) == Counter(len(words(t)) + 1 for i, t in rows if not held_out(i))


@pytest.mark.parametrize("block_words", [1_000_000, 150])
def test_scores_do_not_follow_the_layout(spark, monkeypatch, block_words):
    """One block, and so many that copies are averaged in groups."""
    monkeypatch.setattr(lm, "BLOCK_WORDS", block_words)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.4, 60 + i % 50) % 3000) for i in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = None
    for parts in (1, 8, 50):
        got = {r.doc_id: r.score for r in lm.scored(table.repartition(parts, F.rand(parts))).collect()}
        first = first or got
        assert max(abs(got[i] - first[i]) / abs(first[i]) for i in first) < 1e-5


def test_training_leaves_no_short_text_out():
    class Counts:
        unigrams = np.ones(lm.CLASS * lm.CLASSES + lm.TAILS)

    for n in (1, 7, 30, 300):
        p = lm.start_weights(Counts())
        first = p["word_b"].copy()
        lm.train(p, np.full(n, 5))
        assert (p["word_b"] != first).any()


def test_language_model_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op2_lm_scores"](spark, sf).collect()
    want = {r[0]: r for r in brute_base(docs, lambda i: not held_out(i))}
    for r in rows:
        i, n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held_out(i)) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    assert len(rows) == len(docs)


# The pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline
    from evidra.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names, kept = [], [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == columns
        names.append(name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    _, good, unique, clean = kept[1:]
    assert all(not (brute_counts(texts[i])[0] < 50) for i in good)
    groups = brute_components([(i, texts[i]) for i in sorted(good)])
    assert unique == {c for _, _, c in groups}
    assert len(clean) < len(unique)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in final.collect()} == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == clean
    assert corpus_pipeline.ORACLE_SQL is None


def test_sql_of_queries(spark, sf):
    from evidra.llm.queries import SQL
    from tools.check_oracle import connect, normal

    con = connect(sf)
    for name, sql in SQL.items():
        df, want = QUERIES[name](spark, sf), con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, want.fetchall()), name


@pytest.mark.parametrize("name", ["op1_language_id", "op6_main_text", "op9_string_tiling"])
def test_plans_have_no_cross_product(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_parities_bound_the_overlap_of_sets_of_any_sizes():
    rng = np.random.default_rng(5)
    for n, m, shared in ((1, 1, 1), (1, 1, 0), (7, 9, 7), (300, 330, 290), (300, 900, 120), (3_000, 40, 40), (20_000, 21_000, 15_000)):
        pool = np.unique(rng.integers(0, 1 << 63, n + m + 50, dtype=np.int64).astype(np.uint64))
        rng.shuffle(pool)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        bound = jaccard.most_common(jaccard.parities(a), jaccard.parities(b), n, m)
        assert bound == jaccard.most_common(jaccard.parities(b), jaccard.parities(a), m, n)
        assert shared <= bound <= min(n, m)
        if min(n, m) >= 300 and max(n, m) < 2 * min(n, m):  # of sizes that may link, the bound is close
            assert bound - shared < 0.2 * (n + m - 2 * shared) + 5
