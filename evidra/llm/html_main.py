"""Main text of web pages by host suffix arrays (operator 6).

Pages are parsed to blocks of text with the elements around them. The blocks of a host's pages, joined to
one stream of words, are sorted as suffixes; runs of words that recur on distinct pages are that host's
boilerplate. A block that such runs cover is left out, unless the page itself marks it as article text.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments that carry their own
elements or names are left out as well, so a page alone on its host is cut too.

Runs are counted over the whole host, whatever its size. Each batch of pages sorts its own suffixes and
hands on at most ``PAGES`` distinct owners of a (host, run); these are combined by run, so neither a large
host nor a run on all of its pages is one task's work. Only runs that touch an unmarked block are handed on.
An owner is a distinct page content: copies of an unmarked page on several urls of a host count once.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evidra.llm.common import batch, lookup_bounded, mixed, words, written
from evidra.llm.textcols import _ODD, _VALUES, texts_of, words_of

#: A run of at least so many words on at least so many distinct pages of a host is boilerplate.
RUN, PAGES = 4, 3
COVERED = 0.8
#: A block goes if repeated stretches of at least so many words cover ``COVERED`` of it, or repeated words all of it.
LONG = 8
TEXT = "page_id long, url string, text string, n_chars long"
#: Runs whose hash falls on no slot of a run that touches an unmarked block need no count.
SLOTS = 1 << 20
#: Up to so many repeated runs are broadcast; more are joined to the pages.
AT_HAND = 1 << 20
_BLOCKS = "_uid long, page_id long, url string, _host long, blocks array<string>, kinds string"
_COUNTS = "k long, owner long, n long"

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = set("script style noscript template textarea title svg math iframe object canvas noframes xmp".split())
#: Without a close tag these run to the end of the page; the others' content is then read on as markup.
TO_END = set("script style textarea title".split())
OUTSIDE = set("nav header footer aside form menu dialog button select option fieldset head".split())
#: A class or id is page furniture if the whole of it is such a word, with a place before or a box after it: ``site-header``,
#: ``share-buttons``; ``no-sidebar``, ``entry-header`` and ``related-work`` are not.
_FURNITURE = (
    "ads?|adverts?|advertis\\w+|sponsor\\w*|promos?|promotions?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|footer|sidebar|aside|cookies?|"
    "consent|notices?|alerts?|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|comments?|disqus|replies|widgets?|login|search"
)
_PLACES = "site|main|top|bottom|left|right|primary|secondary|global|mobile|sub|side|page|user|reader|google"
_BOXES = (
    "box|bar|block|list|links?|buttons?|icons?|container|wrapper|wrap|section|area|slot|unit|form|panel|posts?|articles?|stories|items?|thread|feed|"
    "inner|media|toggle|[0-9]+"
)
#: The header of a site is furniture, that of an article is part of it.
_HEADS = "header|masthead"
NAMED_INSIDE, NAMED = (
    re.compile(rf"(?:^|\s)(?:(?:{_PLACES})[_-]+)*(?:{w})(?:[_-]+(?:{w}|{_BOXES}))*(?:$|\s)", re.I) for w in (_FURNITURE, f"{_FURNITURE}|{_HEADS}")
)
ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|alert|dialog|form|menu|menubar)$", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Closing one of these is implied by the elements that cannot stand inside it.
_IMPLIED = {"p": BLOCK - {"li", "html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


def _unwanted(name: str, attributes: str, article: bool) -> str:
    """``h`` if the element is hidden, ``x`` if it is page furniture by element, role or name, else empty."""
    found = "x" if name in OUTSIDE and not (article and name == "header") else ""
    if not attributes or name in ("html", "body", "article", "main"):
        return found
    named = NAMED_INSIDE if article else NAMED
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "h"
        if key == "role" and ROLES.match(value) or key in ("class", "id") and named.search(value):
            found = "x"
    return found


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(text, kind) of every block in page order; kind is ``a`` inside an article, ``x`` inside an unwanted
    element and ``-`` elsewhere. A page header inside an article is part of it. What holds the page's largest
    article is a wrapper and not unwanted, whatever its element or names, unless it is hidden."""
    out: list[tuple[str, tuple, int]] = []
    stack: list[tuple[str, tuple, int]] = []  # element, unwanted elements around, outermost article around or 0
    held: list[str] = []
    sizes: dict[int, tuple[int, tuple]] = {}  # article: characters of its text, unwanted elements around it
    at, n, elements = 0, len(page), 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            bad, article = stack[-1][1:] if stack else ((), 0)
            out.append((text, bad, article))
            if article and bad == sizes[article][1]:
                sizes[article] = (sizes[article][0] + len(text), bad)

    while at < n:
        tag = _TAG.search(page, at)
        # A "<" that opens no tag is text.
        end = tag.start() if tag else n
        if end > at:
            held.append(entities.unescape(page[at:end]))
        if not tag:
            break
        at = tag.end() if tag.end() > tag.start() else tag.start() + 1
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if tag.group(1):
            if any(e == name for e, *_ in stack):
                if name in BLOCK:
                    flush()
                while stack.pop()[0] != name:
                    pass
            continue
        if name in RAW:
            flush() if name == "title" else None
            if name in TO_END or not tag.group(3).endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else n if name in TO_END else at
            continue
        if name in BLOCK:
            flush()
            while stack and (name in _IMPLIED.get(stack[-1][0], ()) or stack[-1][0] in ("b", "i", "em", "strong", "span", "a", "u") and name in BLOCK):
                stack.pop()
        elif name == "br":
            held.append(" ")
        if name in VOID or tag.group(3).endswith("/"):
            continue
        bad, article = stack[-1][1:] if stack else ((), 0)
        mark = _unwanted(name, tag.group(3), bool(article))
        elements += 1
        if mark:
            bad = (*bad, (elements, mark))
        if name in ("article", "main") and not article:
            article = elements
            sizes[article] = (0, bad)
        stack.append((name, bad, article))
    flush()
    around = max(sizes.values(), key=lambda s: s[0], default=(0, ()))[1]
    wrappers = {e for e in around if e[1] != "h"}
    return [(text, "x" if any(e not in wrappers for e in bad) else "a" if article else "-") for text, bad, article in out]


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` words or more, and each position's rank in that order.

    Prefix doubling: ranks by the first k words, paired with the ranks k words on, give those by 2k.
    Equal ranks are equal runs of at least ``depth`` words.
    """
    _, rank = np.unique(stream, return_inverse=True)
    k = 1
    while True:
        after = np.full(len(rank), -1, np.int64)
        after[:-k] = rank[k:]
        key = rank.astype(np.int64) * (len(rank) + 1) + after + 1
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.diff(key[order]) != 0]).cumsum()
        rank = np.empty(len(key), np.int64)
        rank[order] = changed
        k *= 2
        if k >= depth or changed[-1] == len(rank) - 1:
            return order, rank


def repeated(stream: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which words lie in runs of ``RUN`` words or more that occur on ``PAGES`` distinct pages.

    ``page`` numbers each word's page; words of page -1 part the pages and differ from each other.
    """
    covered = np.zeros(len(stream), bool)
    if len(stream) <= RUN:
        return covered
    order, rank = suffix_array(stream, RUN)
    owner = page[order]
    group = rank[order]
    new_page = np.ones(len(order), bool)
    by = np.lexsort((owner, group))
    g, o = group[by], owner[by]
    new_page[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    pages = np.zeros(int(g[-1]) + 1, np.int64)
    np.add.at(pages, g, new_page)
    starts = np.zeros(len(stream) + 1, np.int64)
    common = order[(pages[group] >= PAGES) & (owner >= 0)]
    np.add.at(starts, common, 1)
    np.add.at(starts, np.minimum(common + RUN, len(stream)), -1)
    return np.cumsum(starts[:-1]) > 0


def long_stretches(covered: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The covered words that lie in stretches of at least ``LONG`` of them on one page."""
    if not len(covered):
        return covered
    first = np.flatnonzero(np.concatenate([[True], (covered[1:] != covered[:-1]) | (page[1:] != page[:-1])]))
    length = np.diff(np.append(first, len(covered)))
    return covered & (np.repeat(length, length) >= LONG)


def _content(blocks: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(blocks).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def main_texts(pages: list[tuple[list[str], str]]) -> list[str]:
    """The kept blocks of one host's pages, one line each: the plain form of :func:`main_text`."""
    vocabulary: dict[str, int] = {}
    owners: dict[tuple, int] = {}
    stream, owner, page_of, spans = [], [], [], []
    for p, (blocks, kinds) in enumerate(pages):
        for b, text in enumerate(blocks):
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            spans.append((p, b, len(stream), len(stream) + len(own)))
            stream += own
            once = kinds[b] == "a" or "a" not in kinds
            owner += [owners.setdefault(tuple(blocks) if once else (p,), len(owners))] * len(own)
        stream.append(-1 - p)
        owner.append(-1)
        page_of += [p] * (len(stream) - len(page_of))
    common = repeated(np.array(stream, np.int64), np.array(owner, np.int64))
    long = long_stretches(common, np.array(page_of, np.int64))
    covered, stretched = (np.concatenate([[0], np.cumsum(c)]) for c in (common, long))
    kept: list[list[str]] = [[] for _ in pages]
    for p, b, lo, hi in spans:
        kind = pages[p][1][b]
        boiler = covered[hi] - covered[lo] == hi - lo or stretched[hi] - stretched[lo] >= COVERED * (hi - lo)
        if kind == "a" or kind == "-" and not boiler:
            kept[p].append(pages[p][0][b])
    return ["\n".join(k) for k in kept]


class Runs:
    """The runs of ``RUN`` words inside the pages of a batch, those of a page one after another.

    ``key`` is a hash of host and run, ``owner`` the page or content that a run counts for, ``touches``
    whether it lies on a word of an unmarked block. A marked page's article is safe, so the rest of it
    counts by page; all else counts by content.
    """

    def __init__(self, rows: pa.RecordBatch):
        self.blocks, self.kinds = rows.column("blocks").to_pylist(), rows.column("kinds").to_pylist()
        n_blocks = np.array([len(b) for b in self.blocks], np.int64)
        w = words_of(texts_of(pa.array([t for b in self.blocks for t in b], pa.string())), _VALUES)
        self.kind = np.frombuffer("".join(self.kinds).encode(), np.uint8)
        self.count, self.hashed = w.count, w.hashed
        block_page = np.repeat(np.arange(len(n_blocks)), n_blocks)
        self.block = np.repeat(np.arange(len(block_page)), w.count)
        self.page = block_page[self.block]
        self.start = np.zeros(0, np.int64)
        if len(self.page) >= RUN:
            self.start = np.flatnonzero(self.page[: len(self.page) - RUN + 1] == self.page[RUN - 1 :])
        host = rows.column("_host").to_numpy().view(np.uint64)
        key = np.zeros(len(self.start), np.uint64)
        for i in range(RUN):
            key = key * np.uint64(_ODD) + mixed(self.hashed[self.start + i] + np.uint64(i + 1))
        self.host = host[self.page[self.start]]
        self.key = mixed(key + mixed(self.host))
        open_words = np.concatenate([[0], np.cumsum(self.kind[self.block] == ord("-"))])
        self.touches = open_words[self.start + RUN] > open_words[self.start]
        content = np.array([_content(b) for b in self.blocks], np.uint64)
        own = mixed(rows.column("_uid").to_numpy().view(np.uint64))
        first, marked = self.page[self.start], np.array(["a" in k for k in self.kinds], bool)
        by_page = marked[first] & (self.kind[self.block[self.start]] != ord("a"))
        self.owner = np.where(by_page, own[first], content[first])

    def slot(self) -> np.ndarray:
        return (self.key % np.uint64(SLOTS)).astype(np.int64)

    def counts(self, wanted: np.ndarray):
        """(key, owner, touching runs) of at most ``PAGES`` owners of each wanted run; the first has the sum."""
        rank = suffix_array(np.unique(self.hashed, return_inverse=True)[1], RUN)[1][self.start[wanted]]
        key, owner, host, touches = (x[wanted] for x in (self.key, self.owner, self.host, self.touches))
        by = np.lexsort((owner, host, rank))
        rank, host, owner, key = rank[by], host[by], owner[by], key[by]
        new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (host[1:] != host[:-1])])
        head = np.flatnonzero(new)
        pair = np.flatnonzero(new | np.concatenate([[True], owner[1:] != owner[:-1]]))
        group = np.cumsum(new)[pair] - 1
        place = np.arange(len(pair)) - np.searchsorted(group, group)
        n = np.where(place == 0, np.add.reduceat(touches[by].astype(np.int64), head)[group], 0)
        few = place < PAGES
        return key[pair][few].view(np.int64), owner[pair][few].view(np.int64), n[few]

    def texts(self, known: np.ndarray) -> list[str]:
        """What stays of every page, where the runs with a key in ``known`` are repeated."""
        starts = np.zeros(len(self.page) + 1, np.int64)
        common = self.start[np.isin(self.key, known)]
        np.add.at(starts, common, 1)
        np.add.at(starts, common + RUN, -1)
        covered = np.cumsum(starts[:-1]) > 0
        whole, long = (np.bincount(self.block, c, len(self.kind)) for c in (covered, long_stretches(covered, self.page)))
        boiler = (whole == self.count) | (long >= COVERED * self.count)
        keep = (self.kind == ord("a")) | (self.kind == ord("-")) & ~boiler
        out, at = [], 0
        for blocks in self.blocks:
            out.append("\n".join(t for t, k in zip(blocks, keep[at : at + len(blocks)]) if k))
            at += len(blocks)
        return out


def _parse(batches):
    uid = TaskContext.get().partitionId() << 40
    for rows in batches:
        if rows.num_rows:
            parsed = [blocks_of(h or "") for h in rows.column("html").to_pylist()]
            yield batch(
                _BLOCKS, uid + np.arange(rows.num_rows), rows.column("page_id"), rows.column("url"), rows.column("_host"),
                pa.array([[t for t, _ in p] for p in parsed], pa.list_(pa.string())), ["".join(k for _, k in p) for p in parsed],
            )
            uid += rows.num_rows


def _slots(batches):
    for rows in batches:
        if any("-" in k for k in rows.column("kinds").to_pylist()):
            runs = Runs(rows)
            yield batch("slot long", np.unique(runs.slot()[runs.touches]))


def _repeated_runs(parsed: DataFrame) -> DataFrame | None:
    """(k, n): runs on ``PAGES`` owners of a host, and how often they touch unmarked blocks."""
    slots = parsed.mapInArrow(_slots, "slot long").distinct().toArrow().column("slot").to_numpy()  # at most SLOTS rows
    if not len(slots):
        return None
    mask = np.zeros(SLOTS, bool)
    mask[slots] = True
    held = parsed.sparkSession.sparkContext.broadcast(mask)

    def count(batches):
        for rows in batches:
            runs = Runs(rows)
            wanted = held.value[runs.slot()]
            if wanted.any():
                yield batch(_COUNTS, *runs.counts(wanted))

    owners = parsed.mapInArrow(count, _COUNTS).groupBy("k", "owner").agg(F.sum("n").alias("n"))
    runs = owners.groupBy("k").agg(F.count("*").alias("pages"), F.sum("n").alias("n"))
    return written(runs.where((F.col("pages") >= PAGES) & (F.col("n") > 0)).select("k", "n"))


def _touching(batches):
    for rows in batches:
        runs = Runs(rows)
        yield batch("_uid long, k long", rows.column("_uid").to_numpy()[runs.page[runs.start[runs.touches]]], runs.key[runs.touches].view(np.int64))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty html, or one with boilerplate only, has the empty text; pages with a null or relative
    url are taken as one host. Repeated rows are pages of their own, with null ids or without, but an
    unmarked content counts once on its host; an empty table gives no rows; only page_id, url and html are
    read. Runs are told apart by 64-bit hashes.
    """
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))).alias("_host")
    parsed = written(pages.select("page_id", "url", "html", host).mapInArrow(_parse, _BLOCKS))
    repeated_runs = _repeated_runs(parsed)
    known = np.zeros(0, np.uint64)
    joined = repeated_runs is not None and repeated_runs.count() > AT_HAND
    if joined:
        facts = lookup_bounded(parsed.mapInArrow(_touching, "_uid long, k long"), repeated_runs.withColumn("hit", F.lit(True)), "k", F.col("n"))
        hits = facts.where("hit").groupBy("_uid").agg(F.collect_set("k").alias("hits"))
        parsed = parsed.join(hits, "_uid", "left")
    elif repeated_runs is not None:
        known = repeated_runs.select("k").toArrow().column("k").to_numpy().view(np.uint64)
    held = parsed.sparkSession.sparkContext.broadcast(known)

    def extract(batches):
        for rows in batches:
            if rows.num_rows:
                own = held.value
                if joined:  # keys hold the host, so a batch's hits hold for all its pages
                    own = np.unique(rows.column("hits").flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
                kinds = rows.column("kinds").to_pylist()
                if any("-" in k for k in kinds):
                    texts = Runs(rows).texts(own)
                else:
                    texts = ["\n".join(t for t, c in zip(b, k) if c == "a") for b, k in zip(rows.column("blocks").to_pylist(), kinds)]
                yield batch(TEXT, rows.column("page_id"), rows.column("url"), texts, [len(t) for t in texts])

    return parsed.mapInArrow(extract, TEXT)
