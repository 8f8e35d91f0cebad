"""WARC archives and main texts."""

import gzip
import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pytest

from evidra.llm import html_main, warc
from evidra.llm.common import work_dir
from evidra.llm.files import open_random
from evidra.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, digest string, first long, _host string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "é x " * 60, "<p>" + "y " * 100
    rows = [
        (3, "http://a.example/1", big), (1, "http://a.example/2", big), (2, None, big), (4, "http://b.example/ \r\n:x", "short"), (5, "http://b.example/", "short"),
        (6, "", None), (7, "http://b.example/é", ""), (None, "http://b.example/n", big), (None, None, other), (8, "http://c.example", other),
        (8, "http://c.example", other), (9, "http://c.example", "z" * 500_000), (-4, "u", "WARC/1.1\r\n\r\n" * 20),
    ]
    return spark.createDataFrame([(*r, "d", 1, "h") for r in rows], PAGES).repartition(3)


def wanted(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    first: dict = {}
    for i, p in payloads:
        if i is not None and len(p) >= 100:
            first[p] = min(i, first.get(p, i))
    out = Counter()
    for i, p in payloads:
        revisit = p in first and i != first[p]
        out[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None] += 1
    return out


def test_archives_go_round(pages, spark):
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert Counter(tuple(r) for r in warc.archived(pages).collect()) == wanted(rows)
    assert warc.archived(pages.limit(0)).count() == 0


def test_records_are_readable_from_their_offset_alone(pages, spark):
    index = warc.write_archives(pages, work_dir(spark, "test")).collect()
    for r in index:
        data = open_random(r.path).read_at(r.length, r.offset)
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        fields, http, payload = warc.parsed(text)
        assert len(http) + 4 + len(payload) == int(fields["Content-Length"]) and text.endswith(b"\r\n\r\n")
        assert "\n" not in fields.get("WARC-Target-URI", "")
    whole = b"".join(gzip.decompress(open_random(p).read()) for p in sorted({r.path for r in index}))
    assert whole.count(b"WARC-Record-ID:") == len(index)


def test_a_few_chosen_records(pages, spark):
    index = warc.write_archives(pages, work_dir(spark, "test"))
    got = warc.read_records(index.where("page_id IN (1, 9)")).collect()
    assert {r.page_id for r in got} == {1, 9}


def test_neighbouring_ranges_are_one_read():
    offset, length = np.array([0, 10, 20, 200_000, 0]), np.array([10, 10, 10, 10, 5])
    assert warc.ranges(offset, length, ["a"] * 4 + ["b"]) == [(0, 3), (3, 4), (4, 5)]
    assert warc.ranges(np.zeros(0, int), np.zeros(0, int), []) == []


def test_ids_hold_the_page():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), None):
        assert warc.page_of(warc.record_id(page)) == page


def test_blocks_of_marked_pages():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='no-sidebar'>"
        "<header>Site</header><nav><ul><li>Menu</ul></nav><!-- <p>no --><div class=\"ad\">Buy</div><div id='cookie-notice'>We use</div>"
        "<article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>\n text<p>Two<br>lines &lt;b&gt; &eacute;&#233;"
        "<ul><li>a<li>b</ul><aside>Side</aside><div class='share-buttons'>Share</div><table><tr><td>x<td>y</table><form>Say<input></form>"
        "<div class='comments'><p>Me first</div></article><div role='complementary'>C</div><div hidden>H</div><footer>F</footer>"
    )
    got = [t for t, k in html_main.blocks_of(page) if k != "x"]
    assert got == ["Head & line", "One bold text", "Two lines <b> éé", "a", "b", "x", "y"]


@pytest.mark.parametrize("page", ["", "<", "<<<>>>", "a < b and c > d", "<p", "</p></div>", "<script>never closed", "<p>x</p", "&bogus; &amp", "<p>1</b>2</i>", "\x00<p>\x00"])
def test_broken_pages(page):
    for text, kind in html_main.blocks_of(page):
        assert text == " ".join(text.split()) and kind in "ax-"


def test_text_before_a_cut_end_stays():
    assert [t for t, _ in html_main.blocks_of("<article><p>all of it")] == ["all of it"]
    assert [t for t, _ in html_main.blocks_of("a < b")] == ["a < b"]


@pytest.mark.parametrize("tag", ["<svg width='1'/>", "<math/>", "<object data='x'/>", "<svg>", "<noscript>", "<template>", "<canvas>"])
def test_an_unclosed_element_does_not_drop_the_rest(tag):
    assert [t for t, _ in html_main.blocks_of(f"<article><p>before{tag}<p>after</article><p>end")] == ["before", "after", "end"]


@pytest.mark.parametrize("attribute", ["style='overflow:hidden'", "data-hidden='false'", "title='a hidden lake'", 'data-class="nav"'])
def test_hidden_is_an_attribute_of_its_own(attribute):
    for name in ("body", "div", "article"):
        assert [k for _, k in html_main.blocks_of(f"<{name} {attribute}><p>text</{name}>")] != ["x"]
    assert [k for _, k in html_main.blocks_of("<div lang=en hidden><p>text</div><div HIDDEN=''>more</div>")] == ["x", "x"]


def test_suffix_ranks_are_those_of_sorted_runs():
    rng = np.random.default_rng(0)
    for _ in range(40):
        stream = rng.integers(0, 3, rng.integers(2, 60))
        order, rank = html_main.suffix_array(stream, 4)
        runs = [tuple(stream[i : i + 64].tolist()) for i in order]
        assert [r[:4] for r in runs] == sorted(r[:4] for r in runs)
        for a, b in zip(order[:-1], order[1:]):
            if rank[a] == rank[b]:
                assert stream[a : a + 4].tolist() == stream[b : b + 4].tolist()


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, pages = 60, 5
        stream, page = rng.integers(0, 3, n), np.sort(rng.integers(0, pages, n))
        stream, page = np.concatenate([np.append(stream[page == p], -1 - p) for p in range(pages)]), np.concatenate([np.append(page[page == p], -1) for p in range(pages)])
        seen: dict = {}
        for i in range(len(stream) - html_main.RUN + 1):
            seen.setdefault(tuple(stream[i : i + html_main.RUN]), set()).add(page[i])
        want = np.zeros(len(stream), bool)
        for i in range(len(stream) - html_main.RUN + 1):
            if page[i] >= 0 and len(seen[tuple(stream[i : i + html_main.RUN])]) >= html_main.PAGES:
                want[i : i + html_main.RUN] = True
        assert (html_main.repeated(stream, page) == want).all()


def test_what_a_host_repeats_goes_and_unique_runs_stay():
    bar, foot = "home news about us contact", "all rights reserved by the paper"
    own = [" ".join(f"w{p}x{j}" for j in range(30)) for p in range(6)]
    kept = html_main.main_texts([([bar, text, foot], "---") for text in own])
    assert kept == own
    assert html_main.main_texts([([bar, "same lead in every article here"], "-a")] * 4) == ["same lead in every article here"] * 4
    assert html_main.main_texts([([], ""), (["alone"], "-")]) == ["", "alone"]


@pytest.mark.parametrize("page, kept", [
    ('<div id="page" class="site no-sidebar"><p>Story</div>', ["Story"]),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Text</article>', ["Title", "Text"]),
    ('<article><div class="header"><h1>Title</h1></div><div class="related-work"><p>Others</div><div class="related-posts"><p>Read on</div></article>', ["Title", "Others"]),
    ('<form id="all"><div class="widget"><main><p>Story</main></div><p>Send</form>', ["Story", "Send"]),
    ('<article><p>The long story</article><aside><article><p>Teaser</article></aside>', ["The long story"]),
    ('<div class="site-header">Name</div><div id="main-nav">Menu</div><div class="comment-list">Me</div><p class="comments-open">Text', ["Text"]),
    ('<div hidden><article><p>Draft</article></div><p>Text', ["Text"]),
])
def test_names_do_not_decide_on_wrappers_or_parts_of_articles(page, kept):
    assert [t for t, k in html_main.blocks_of(page) if k != "x"] == kept


def test_short_common_phrases_do_not_cut_prose():
    """Four-word phrases on many pages of a host stay in texts; long repeats go, also where a block goes on."""
    phrases = [" ".join(f"p{i}w{j}" for j in range(5)) for i in range(6)]
    prose = [" own{} ".join(phrases[i % 6] for i in range(p, p + 4)).format(*(f"{p}a{j}" for j in range(3))) for p in range(12)]
    bar = "one long notice that the whole host repeats on each page"
    pages = [([t, f"{bar} on day{p}", f"{bar} then"], "---") for p, t in enumerate(prose)]
    assert html_main.main_texts(pages) == prose


def test_copies_of_an_unmarked_page_keep_their_text():
    text = [" ".join(f"w{j}" for j in range(50)), "and a last line of it"]
    assert html_main.main_texts([(text, "--")] * 3) == ["\n".join(text)] * 3


def html_of(blocks, kinds):
    return "".join(f"<article><p>{t}</p></article>" if k == "a" else f"<div>{t}</div>" for t, k in zip(blocks, kinds))


@pytest.mark.parametrize("at_hand", [1 << 20, 0])
def test_hosts_of_every_size_follow_one_rule(spark, monkeypatch, at_hand):
    """A bar on 1% of a large host's pages goes from all of them, copies stay whole on both."""
    monkeypatch.setattr(html_main, "AT_HAND", at_hand)
    bar, rows, want = "sale ends on friday buy now", [], {}
    for host, n in (("big", 600), ("small", 7)):
        own = [([" ".join(f"{host}{p}x{j}" for j in range(20))], "-") for p in range(n)]
        for p in range(0, n, 100 if host == "big" else 2):
            own[p] = ([bar, *own[p][0]], "--")
        own += [(["one page that stands on many urls of this host", "x y"], "--")] * 4 + [([bar, "its own article"], "-a")]
        for (blocks, kinds), text in zip(own, html_main.main_texts(own)):
            assert bar not in text
            want[len(rows)] = text
            rows.append((len(rows), f"http://{host}.example/{len(rows)}", html_of(blocks, kinds)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in html_main.main_text(table).collect()} == want


def test_awkward_pages(pages):
    got = html_main.main_text(pages).collect()
    assert len(got) == 13 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[6] == "" and by[7] == "" and by[4] == "short" and len(by[9]) == 500_000
    assert html_main.main_text(pages.limit(0)).count() == 0


def test_articles_of_whole_tables(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op6_main_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", pages[r.page_id], re.S).group(1)
        parts = re.split(r"</?(?:p|h1|li|ul)[^>]*>", article)
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in parts]
        assert r.text == "\n".join(x for x in lines if x)
