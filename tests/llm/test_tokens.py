"""Token counts, token files and packing against the tokenizers library and plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evidra.llm import packing, rans, textcols
from evidra.llm.bpe import Encoder, whole_tokens
from evidra.llm.queries import QUERIES, bpe_file
from evidra.llm.textcols import slices
from evidra.llm.token_count import token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_file())


@pytest.fixture(scope="module")
def encode(library):
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return Encoder(bpe_file())


def test_any_mix_of_characters_encodes_as_the_library_does(encoder, encode):
    random.seed(1)
    pieces = [
        "a", "B", "é", "ß", "1", "²", "½", " ", "  ", "\n", "\t", "'s", "'", "'re", "'ll", "!", "_", "中", "‍", "́", "<|endoftext|>",
        " ", "　", "٣", "😀", "Ⅷ", "\x1c", "\x85", "don't", "n ", "\x7f", "\x00", "thing", "ing",
    ]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 12))) for _ in range(5000)] + [None, "", "'", " 's", "x" * 300]
    ids, counts = encoder.encode_column(pa.array(texts))
    for got, text in zip(np.split(ids, np.cumsum(counts)[:-1]), texts):
        assert got.tolist() == encode(text), repr(text)


def test_a_sliced_column_and_an_empty_one(encoder, encode):
    column = pa.array(["zero", "one two", None, "three"]).slice(1, 2)
    ids, counts = encoder.encode_column(column)
    assert ids.tolist() == encode("one two") and counts.tolist() == [len(ids), 0]
    assert encoder.encode_column(pa.array([], pa.string()))[1].tolist() == []
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "b" * 5, "c"])], ["text"])
    assert [s.num_rows for s in slices(batch, "text", 10)] == [1, 3] or sum(s.num_rows for s in slices(batch, "text", 10)) == 4


def test_texts_longer_than_the_power_tables_hash_as_short_ones_do(monkeypatch):
    raw = np.frombuffer(b"some words that come again " * 20_000, np.uint8)
    start = np.arange(0, len(raw), 27)
    want = textcols.Hasher(raw).of(start, start + 26)
    monkeypatch.setattr(textcols, "_STEP", 4)
    monkeypatch.setattr(textcols, "_UP", textcols._powers(textcols._ODD))
    monkeypatch.setattr(textcols, "_DOWN", textcols._powers(textcols._INVERSE))
    assert len(raw) > 2 * (4 << 15)
    got = textcols.Hasher(raw).of(start, start + 26)
    assert len(np.unique(got)) == 1 and (got == want).all()


def test_the_table_starts_anew_when_it_is_full(encode, monkeypatch):
    from evidra.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_TOKENS", 3)
    small = Encoder(bpe_file())
    for text in ("one two three four five", "six seven one two", "one"):
        assert small.encode_column(pa.array([text]))[0].tolist() == encode(text)


def test_whole_tokens_are_proved(library):
    proved = whole_tokens(library)
    assert 50_000 < len(proved) <= library.get_vocab_size()
    for token in list(proved)[::997]:
        assert [t.id for t in library.model.tokenize(token)] == [proved[token]]


def test_counts(docs, rows, encode, empty):
    got = Counter(tuple(r) for r in token_counts(docs, bpe_file(), limit=40).collect())
    want = Counter((i, len((t or "").encode()), len(encode(t)), len(encode(t)) > 40) for i, t in rows)
    assert got == want
    assert token_counts(empty, bpe_file()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 1025, 70_000])
def test_token_files_go_round(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(0.6, n) * 7).astype(np.int64) % 50_257
    data = rans.encode_file(ids)
    import io

    file = rans.File(io.BytesIO(data))
    assert file.read(0, n).tolist() == ids.tolist()
    for lo, hi in ((0, 1), (n // 3, n // 2), (n - 1, n), (n // 2, n // 2)):
        if 0 <= lo <= hi <= n:
            assert file.read(lo, hi).tolist() == ids[lo:hi].tolist()


def test_reads_begin_at_checkpoints_over_several_blocks(monkeypatch):
    import io

    monkeypatch.setattr(rans, "LANES", 8)
    monkeypatch.setattr(rans, "BLOCK_STEPS", 16)
    monkeypatch.setattr(rans, "CHECKPOINT", 4)
    ids = np.random.default_rng(0).integers(0, 60, 1000)
    file = rans.File(io.BytesIO(rans.encode_file(ids)))
    for lo in range(0, 1000, 37):
        assert file.read(lo, min(lo + 150, 1000)).tolist() == ids[lo : lo + 150].tolist()


def test_a_damaged_block_is_noticed():
    import io

    data = bytearray(rans.encode_file(np.arange(5000) % 300))
    data[-3] ^= 1
    with pytest.raises(ValueError):
        rans.File(io.BytesIO(bytes(data))).read(0, 5000)


def test_frequencies_add_up_and_none_is_lost():
    for counts in ([1], [1] * 50_000, [10**9] + [1] * 1000, [3, 5, 7]):
        got = rans.frequencies(np.array(counts))
        assert got.sum() == 1 << rans.SCALE and got.min() >= 1


def test_token_digests(docs, rows, encode, empty):
    got = [tuple(r) for r in rans.token_digests(docs, bpe_file(), 2).collect()]
    order = [r for r in got]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = Counter((i, len(encode(t)) + 1, crc(encode(t) + [2])) for i, t in rows)
    assert Counter((i, n, c) for i, _, n, c in got) == want
    at = 0
    for i, start, n, _ in sorted(order, key=lambda r: r[1]):
        assert start == at
        at += n
    ids = [i for i, *_ in sorted(order, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert rans.token_digests(empty, bpe_file(), 2).count() == 0


def test_files_hold_whole_documents(docs, rows, encode):
    from evidra.llm.common import work_dir

    index = rans.write_ids(docs, bpe_file(), 2, work_dir(docs.sparkSession, "test"), file_ids=200)
    assert index.select("path").distinct().count() >= 1
    got = rans.read_ids(index, lambda ids: ",".join(map(str, ids.tolist())), "doc_id long, start long, n_tokens long, ids string")
    assert Counter(r.ids for r in got.collect()) == Counter(",".join(map(str, encode(t) + [2])) for _, t in rows)


def check_bins(histogram, capacity, bins):
    held = Counter()
    for count, runs in bins:
        assert count > 0 and 0 < sum(n * k for n, k in runs) <= capacity
        for n, k in runs:
            held[n] += k * count
    assert held == Counter({n: c for n, c in histogram.items() if c})


def test_packing_plans_hold_every_piece_and_come_near_the_bound():
    rng = np.random.default_rng(3)
    for draw in (lambda: rng.integers(1, 2049, 4000), lambda: np.minimum(2048, rng.lognormal(6.5, 1, 4000).astype(int) + 1), lambda: np.full(999, 700), lambda: np.ones(5000, int)):
        histogram = Counter(draw().tolist())
        bins = packing.pack(histogram)
        check_bins(histogram, 2048, bins)
        lengths = sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True)
        rooms: list[int] = []  # best fit, decreasing, piece by piece
        import bisect

        for n in lengths:
            k = bisect.bisect_left(rooms, n)
            room = rooms.pop(k) if k < len(rooms) else 2048
            bisect.insort(rooms, room - n)
        assert sum(c for c, _ in bins) <= len(rooms) * 1.01 + 1
    assert packing.pack({}) == []
    with pytest.raises(ValueError):
        packing.pack({2049: 1})


def test_packed_sequences_have_no_gaps(docs, rows, encode, empty):
    got = packing.packed(docs, bpe_file(), 0, per_salt=5).collect()
    pieces = Counter()
    for i, t in rows:
        ids = encode(t) + [0]
        first = (len(ids) - 1) % 2048 + 1
        for number, lo in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[lo : first if number == 0 else lo + 2048]
            pieces[i, number, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(empty, bpe_file(), 0).count() == 0


def test_registered_queries_on_whole_tables(spark, sf, encode):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    files = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, sf).collect()}
    packed = QUERIES["op10_packing"](spark, sf).collect()
    at = 0
    for r in sorted(docs):
        ids = encode(r.text)
        assert counts[r.doc_id] == len(ids)
        assert (files[r.doc_id].start, files[r.doc_id].n_tokens) == (at, len(ids) + 1)
        at += len(ids) + 1
    total = sum(len(encode(r.text)) + 1 for r in docs)
    assert sum(r.length for r in packed) == total
    assert len({r.sequence_id for r in packed}) <= -(-total // 2048) * 1.05 + 1
