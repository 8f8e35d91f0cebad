"""Token-ID files (operator 5) coded by a static range asymmetric numeral system.

A file holds the ids of some whole documents. One frequency table, shared by the file's blocks, gives
every id its share of ``2**SCALE`` slots. A block is coded on its own: ``LANES`` interleaved coders take
the ids in turn, so that one array operation codes or decodes one id of every lane. A coder's state lies
in [2^31, 2^63) and gives off or takes in 32 bits at a time. Every ``CHECKPOINT`` steps the states and
the position in the stream are kept, so decoding can begin there; every block has a CRC-32.

    magic, lanes, block steps, checkpoint steps, symbols, blocks, ids     header
    ids of the symbols, their frequencies                                 u32 each
    offset, ids, words, checkpoints, CRC-32                               per block
    word position and states per checkpoint, words                        per block
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from evidra.llm.bpe import TOKEN_SLICE, encoder
from evidra.llm.common import batch, work_dir, written
from evidra.llm.files import create, new_name, open_random
from evidra.llm.textcols import slices

MAGIC = b"EVRANS01"
SCALE = 18
LANES, BLOCK_STEPS, CHECKPOINT = 1024, 512, 256
FILE_IDS = 4 << 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<8sIIIIIQ")
INDEX = "doc_id long, part int, file int, path string, lo long, n_tokens long"
_BLOCK = np.dtype([("offset", "<u8"), ("ids", "<u4"), ("words", "<u4"), ("marks", "<u4"), ("crc", "<u4")])


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole numbers of at least 1 that add up to ``2**scale``, near the counts' shares."""
    size = 1 << scale
    if len(counts) > size:
        raise ValueError("more symbols than slots")
    got = np.maximum(1, (counts * (size / counts.sum())).astype(np.int64))
    over = int(got.sum()) - size
    while over > 0:  # take from the largest, never below 1
        top = np.argsort(-got, kind="stable")[: max(1, len(got) // 8)]
        take = np.minimum(got[top] - 1, max(1, over // len(top)))
        take = np.minimum(take, np.maximum(0, over - np.concatenate([[0], np.cumsum(take)[:-1]])))
        got[top] -= take
        over -= int(take.sum())
    got[np.argmax(got)] -= over
    return got


def encode_block(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[bytes, int, int]:
    """A block's bytes, its words and its checkpoints; ``symbols`` fill whole rows of lanes."""
    x = np.full(symbols.shape[1], _LOW, np.uint64)
    chunks, marks, given = [], [], 0
    for t in range(len(symbols) - 1, -1, -1):
        s = symbols[t]
        f = freq[s]
        full = x >= (f << np.uint64(63 - SCALE))
        if full.any():
            chunks.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            given += len(chunks[-1])
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + start[s]
        if t % CHECKPOINT == 0:
            marks.append((given, x))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
    data = b"".join(struct.pack("<I", len(words) - n) + state.astype("<u8").tobytes() for n, state in marks[::-1])
    return data + words.tobytes(), len(words), len(marks)


def encode_file(ids: np.ndarray) -> bytes:
    """The file's bytes for one sequence of ids."""
    table, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = frequencies(counts) if len(ids) else counts
    wide = freq.astype(np.uint64)
    start = np.cumsum(wide) - wide
    common = int(np.argmax(freq)) if len(freq) else 0
    per = LANES * BLOCK_STEPS
    directory, payload = [], []
    offset = 0
    for at in range(0, len(ids), per):
        part = symbols[at : at + per]
        lanes = np.full(-(-len(part) // LANES) * LANES, common, np.int64)
        lanes[: len(part)] = part
        data, words, marks = encode_block(lanes.reshape(-1, LANES), wide, start)
        directory.append((offset, len(part), words, marks, zlib.crc32(data)))
        payload.append(data)
        offset += len(data)
    head = _HEAD.pack(MAGIC, LANES, BLOCK_STEPS, CHECKPOINT, len(table), len(directory), len(ids))
    return b"".join([head, table.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array(directory, _BLOCK).tobytes(), *payload])


class File:
    """A file opened for decoding; ``source`` has ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = source
        magic, self.lanes, self.steps, self.every, n, blocks, self.ids = _HEAD.unpack(source.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.table = np.frombuffer(source.read(4 * n), "<u4")
        self.freq = np.frombuffer(source.read(4 * n), "<u4").astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(n, dtype=np.int32), self.freq.astype(np.int64))
        self.blocks = np.frombuffer(source.read(_BLOCK.itemsize * blocks), _BLOCK)
        self.base = _HEAD.size + 8 * n + _BLOCK.itemsize * blocks

    def block(self, number: int, first: int = 0) -> np.ndarray:
        """Ids of a block from the checkpoint at or before its id ``first``; checks the block's sum."""
        b = self.blocks[number]
        mark = 4 + 8 * self.lanes
        self.source.seek(self.base + int(b["offset"]))
        data = self.source.read(mark * int(b["marks"]) + 4 * int(b["words"]))
        if zlib.crc32(data) != b["crc"]:
            raise ValueError("a block is damaged")
        k = min(first // (self.lanes * self.every), int(b["marks"]) - 1)
        at = struct.unpack_from("<I", data, k * mark)[0]
        x = np.frombuffer(data, "<u8", self.lanes, k * mark + 4).astype(np.uint64)
        words = np.frombuffer(data, "<u4", -1, mark * int(b["marks"])).astype(np.uint64)
        begin, total = k * self.every, -(-int(b["ids"]) // self.lanes)
        out = np.empty((total - begin, self.lanes), np.int32)
        mask = np.uint64((1 << SCALE) - 1)
        for t in range(total - begin):
            slot = x & mask
            s = self.slots[slot]
            out[t] = s
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.start[s]
            need = x < _LOW
            n = int(np.count_nonzero(need))
            if n:
                x[need] = (x[need] << np.uint64(32)) | words[at : at + n]
                at += n
        return self.table[out.ravel()[: int(b["ids"]) - begin * self.lanes]]

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the file, decoding only from the nearest checkpoints."""
        per, out = self.lanes * self.steps, []
        for number in range(lo // per, -(-hi // per)):
            first = max(lo - number * per, 0)
            begin = first // (self.lanes * self.every) * self.lanes * self.every
            got = self.block(number, first)
            out.append(got[first - begin : max(min(hi - number * per, per), 0) - begin])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order.

    Returns, and stores, one row per document: doc_id, path, lo and n_tokens in the file, and start, the
    ids of all documents before it. Documents are split over tasks by ranges of doc_id; a file ends after
    the document that brings it to ``file_ids`` ids. Rows of equal id follow each other by a hash of their
    text; null ids come first.
    """

    def write(batches):
        enc, part_no = encoder(tokenizer), TaskContext.get().partitionId()
        ids, docs_in, counts, number = [], [], [], 0

        def flush():
            nonlocal number, ids, docs_in, counts
            n = np.concatenate(counts)
            path = new_name(folder, ".rans")
            with create(path) as out:
                out.write(encode_file(np.concatenate(ids)))
            rows = batch(INDEX, pa.concat_arrays(docs_in), np.full(len(n), part_no), np.full(len(n), number), [path] * len(n), np.cumsum(n) - n, n)
            number, ids, docs_in, counts = number + 1, [], [], []
            return rows

        for rows in batches:
            for part in slices(rows, "text", TOKEN_SLICE):
                flat, n = enc.encode_column(part.column("text"))
                ends = np.cumsum(n)
                ids.append(np.insert(flat, ends, end_id).astype(np.uint16))
                docs_in.append(part.column("doc_id"))
                counts.append(n + 1)
                if sum(map(len, ids)) >= file_ids:
                    yield flush()
        if counts:
            yield flush()

    order = ["doc_id", F.xxhash64("text")]
    index = written(
        docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(write, INDEX)
    )
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("_n"))
    parts = files.groupBy("part").agg(F.sum("_n").alias("_p"))
    before = Window.unboundedPreceding, -1
    # One row per task, then one row per file of a task: small tables, however many ids there are.
    parts = parts.select("part", F.coalesce(F.sum("_p").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("_a"))
    files = files.select("part", "file", F.coalesce(F.sum("_n").over(Window.partitionBy("part").orderBy("file").rowsBetween(*before)), F.lit(0)).alias("_b"))
    place = files.join(parts, "part").select("part", "file", (F.col("_a") + F.col("_b")).alias("_at"))
    return index.join(place, ["part", "file"]).select("doc_id", "path", "lo", "n_tokens", (F.col("_at") + F.col("lo")).alias("start"))


def read_ids(index: DataFrame, per_document, schema: str) -> DataFrame:
    """Decode the indexed documents: ``per_document(ids)`` gives the last column of ``schema``.

    A file's documents are sorted by their place and its blocks decoded one after another, once.
    """

    def read(batches):
        path, held = None, np.zeros(0, np.uint32)
        for rows in batches:
            made = []
            for p, a, n in zip(*(rows.column(c).to_pylist() for c in ("path", "lo", "n_tokens"))):
                if p != path:
                    path, file = p, File(open_random(p))
                    held = file.read(0, file.ids)
                made.append(per_document(held[a : a + n]))
            yield batch(schema, rows.column("doc_id"), rows.column("start"), rows.column("n_tokens"), made)

    return index.repartition("path").sortWithinPartitions("path", "lo").mapInArrow(read, schema)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written and read back.

    A null text is an empty one: its only id is ``end_id``. Repeated rows are documents of their own; an
    empty table gives no rows; only doc_id and text are read.
    """
    folder = work_dir(docs.sparkSession, "rans")
    index = write_ids(docs, tokenizer, end_id, folder)
    return read_ids(index, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "doc_id long, start long, n_tokens long, ids_crc32 long")
