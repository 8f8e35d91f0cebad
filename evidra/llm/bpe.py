"""Exact byte-level BPE ids and counts of whole columns.

Texts are cut into pre-tokens by character classes on arrays; equal pre-tokens are found by hash and
resolved once, in a table that a worker keeps over its tasks. A pre-token that is a vocabulary string
proved to encode alone (:func:`whole_tokens`) is one token without further work; only the rest is merged,
side by side: in each round every pre-token does its first merge of lowest rank, from the library's own
vocabulary and merge list. Texts with special strings or with characters whose class the library sees
otherwise, and pre-tokens of over ``LONG`` bytes, are encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from evidra.llm.textcols import Hasher, Texts, texts_of

#: Each worker process keeps one encoder per file, over all its tasks.
_ENCODERS: dict[str, "Encoder"] = {}
CACHE_TOKENS = 1_000_000
LONG = 64
#: Bytes of text encoded at a time; each time the table of pre-tokens grows once.
TOKEN_SLICE = 4 << 20
_NONE = np.int64(1) << np.int64(40)
_LETTER, _DIGIT, _OTHER, _SPACE, _DISPUTED = range(1, 6)


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable Latin-1 bytes stand
    for themselves, the others are numbered from U+0100 in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


def encoder(path: str) -> "Encoder":
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def whole_tokens(tokenizer) -> dict[str, int]:
    """Vocabulary strings whose own encoding is that one token, with its id.

    A string of the vocabulary need not be reachable: the merges of its letters may end elsewhere.
    Each is run through the library's merges here, which proves those that are kept.
    """
    out = {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        got = tokenizer.model.tokenize(token)
        if len(got) == 1 and got[0].id == number:
            out[token] = number
    return out


class Rows:
    """Lists of ids by number, stored one after another."""

    def __init__(self):
        self.flat, self.start = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.uint16)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])

    def lengths(self, at: np.ndarray) -> np.ndarray:
        return self.start[at + 1] - self.start[at]

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The lists of the given numbers, joined."""
        n = self.lengths(at)
        ends = np.cumsum(n)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - n), n)
        return self.flat[where]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        as_byte = {c: b for b, c in enumerate(self.letters)}
        self.whole = {bytes(as_byte[c] for c in t): i for t, i in whole_tokens(self.library).items()}
        self.first_ids = np.array([vocabulary[c] for c in self.letters], np.int64)
        with open(path, encoding="utf-8") as f:
            merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(f)["model"]["merges"]]
        pairs = ((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges)
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs))
        order = np.argsort((left << 16) | right, kind="stable")
        self.keys, self.ranks, self.made = ((left << 16) | right)[order], order.astype(np.int64), made
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.classes = np.zeros(0x110000, np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known, self.number, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), Rows()

    def _classify(self, codes: np.ndarray) -> None:
        """The library's class of characters not met before: what do they join with?

        Each is set between two letters, two digits and two signs; one that joins with none, and is
        kept apart from a sign by nothing but blanks, is a blank.
        """
        for code in codes.tolist():
            c = chr(code)
            n = [len(self.library.pre_tokenizer.pre_tokenize_str(f"{x}{c}{x}")) for x in "a1!"]
            kind = {(1, 3, 3): _LETTER, (3, 1, 3): _DIGIT, (3, 3, 1): _OTHER, (3, 3, 3): _SPACE, (2, 2, 2): _SPACE}.get(tuple(n), _DISPUTED)
            if kind == _SPACE and not c.isspace():
                kind = _DISPUTED
            self.classes[code] = kind

    def _cut(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts of all pre-tokens, their number a row, and rows left to the library."""
        raw = texts.raw
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        seen = np.bincount(codes, minlength=1)
        new = np.flatnonzero(seen)
        new = new[self.classes[new] == 0]
        if len(new):
            self._classify(new)
        kind = self.classes[codes]
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
        first = np.searchsorted(lead, texts.start)
        n = len(codes)
        row_start = np.zeros(n + 1, bool)
        row_start[first] = True
        blank = kind == _SPACE
        run = np.ones(n, bool)
        run[1:] = (kind[1:] != kind[:-1]) | row_start[1:n]
        # A blank right before something else starts what follows it; other last blanks stand alone.
        before = np.zeros(n, bool)
        before[:-1] = blank[:-1] & ~blank[1:] & ~row_start[1:n]
        cut = run | before
        joined = np.flatnonzero(before & (codes == 32)) + 1
        cut[joined] = False
        self._contractions(codes, cut, row_start)
        at = np.flatnonzero(cut)
        count = np.diff(np.searchsorted(at, first))
        left = np.zeros(texts.rows, bool)
        odd = np.flatnonzero(kind == _DISPUTED)
        if len(odd):
            left[np.searchsorted(first, odd, "right") - 1] = True
        data = raw.tobytes()
        for s in self.special:
            at_byte = data.find(s)
            while at_byte >= 0:
                left[np.searchsorted(texts.start, at_byte, "right") - 1] = True
                at_byte = data.find(s, at_byte + 1)
        return (lead[at] if n else at), count, left

    @staticmethod
    def _contractions(codes: np.ndarray, cut: np.ndarray, row_start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are tokens of their own where an apostrophe starts one."""
        n = len(codes)
        at = np.flatnonzero(cut & (codes == 39))
        if not len(at):
            return
        ahead = np.zeros((len(at), 2), np.int64)
        open_row = np.ones(len(at), bool)
        for k in (1, 2):
            open_row &= (at + k < n) & ~row_start[np.minimum(at + k, n)]
            ahead[open_row, k - 1] = codes[at[open_row] + k]
        one = np.isin(ahead[:, 0], [ord(c) for c in "stmd"])
        two = np.isin(ahead[:, 0] << 8 | ahead[:, 1], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        for found, size in ((at[one], 2), (at[two & ~one], 3)):
            cut[found + 1] = False
            after = found + size
            after = after[after < n]
            cut[after] = True

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 16) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge_equal(self, letters: np.ndarray, put) -> None:
        """Merge words of one size; ``put(rows, ids)`` gets those that are done, by their final length."""
        rows = np.arange(len(letters))
        ids = self.first_ids[letters]
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.argmin(1)
            rank = ranks[np.arange(len(rows)), best]
            ended = rank == _NONE
            if ended.any():
                put(rows[ended], ids[ended])
                going = ~ended
                rows, ids, ranks, best, rank = rows[going], ids[going], ranks[going], best[going], rank[going]
                if not len(rows):
                    return
            lines, width = np.arange(len(rows)), ids.shape[1]
            after = np.arange(width - 1)[None, :] > best[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[lines, best] = self.made[rank]
            if width == 2:
                put(rows, ids)
                return
            ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            has = best < width - 2
            ranks[lines[has], best[has]] = self._rank(ids[lines[has], best[has]], ids[lines[has], best[has] + 1])
            has = best > 0
            ranks[lines[has], best[has] - 1] = self._rank(ids[lines[has], best[has] - 1], ids[lines[has], best[has]])

    def _resolve(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Append the ids of new pre-tokens to the table, in the given order."""
        size = end - start
        most = int(size.max())
        counts = np.zeros(len(start), np.int64)
        table = np.zeros((len(start), min(most, LONG)), np.uint16)
        data, rest, longer = raw.tobytes(), np.ones(len(start), bool), {}
        whole = self.whole
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
            number = whole.get(data[a:b])
            if number is not None:
                table[i, 0], counts[i], rest[i] = number, 1, False
            elif b - a > LONG:
                longer[i] = [t.id for t in self.library.model.tokenize("".join(self.letters[x] for x in data[a:b]))]
                counts[i], rest[i] = len(longer[i]), False
        for n in np.unique(size[rest]).tolist():
            members = np.flatnonzero(rest & (size == n))
            for lo in range(0, len(members), 32768):
                part = members[lo : lo + 32768]

                def put(rows, ids, part=part):
                    table[part[rows], : ids.shape[1]] = ids
                    counts[part[rows]] = ids.shape[1]

                self._merge_equal(raw[start[part, None] + np.arange(n)], put)
        if longer:
            flat = np.concatenate([np.asarray(longer[i]) if i in longer else table[i, : counts[i]] for i in range(len(start))])
        else:
            flat = table[np.arange(table.shape[1])[None, :] < counts[:, None]]
        self.ids.extend(flat, counts)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another (16 bits each), and the number of ids of each row."""
        texts = texts_of(column)
        if len(self.known) > CACHE_TOKENS:
            self._reset()
        start, count, left = self._cut(texts)
        if not len(start):
            return np.zeros(0, np.uint16), np.zeros(texts.rows, np.int64)
        end = np.append(start[1:], len(texts.raw))
        hashed = Hasher(texts.raw).of(start, end)
        order = np.argsort(hashed, kind="stable")
        ordered = hashed[order]
        heads = np.ones(len(order), bool)
        heads[1:] = ordered[1:] != ordered[:-1]
        distinct, sample = ordered[heads], order[heads]
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        fresh = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if fresh.any():
            base = len(self.ids.start) - 1
            self._resolve(texts.raw, start[sample[fresh]], end[sample[fresh]])
            known = np.concatenate([self.known, distinct[fresh]])
            number = np.concatenate([self.number, base + np.arange(fresh.sum())])
            by = np.argsort(known, kind="stable")
            self.known, self.number = known[by], number[by]
            at = np.searchsorted(self.known, distinct)
        numbers = np.empty(len(order), np.int64)
        numbers[order] = self.number[at][np.cumsum(heads) - 1]
        total = np.concatenate([[0], np.cumsum(self.ids.lengths(numbers))])
        ends = np.cumsum(count)
        counts = total[ends] - total[ends - count]
        ids = self.ids.gather(numbers)
        if left.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(left).tolist():
                text = texts.raw[texts.start[i] : texts.start[i + 1]].tobytes().decode()
                parts[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts
