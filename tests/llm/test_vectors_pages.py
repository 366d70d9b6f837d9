"""Vectors, archives and page extraction."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest

from abacist.llm import html, vectors, warc


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [rng.standard_normal(20) for _ in range(150)]
    for k in range(60):
        rows.append(rows[k % 7] + 0.12 * rng.standard_normal(20))
    rows += [rows[3]] * 3 + [rows[5] * 2.5]
    out = [(i, x.tolist()) for i, x in enumerate(rows)]
    out += [(900, None), (901, []), (902, [0.0] * 20), (903, [float("nan")] * 20), (904, [1.0, None]), (905, [1.0, 0.0]), (906, [2.0, 0.1]), (907, [float("inf")] + [0.0] * 19)]
    return out


@pytest.mark.parametrize("cell_rows", [8, 100_000])
def test_vectors(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    rows = vector_rows()
    ids = [i for i, _ in rows]
    links = set()
    for k, (a, x) in enumerate(rows):
        for b, y in rows[:k]:
            if a < 900 and b < 900 or {a, b} == {905, 906}:
                x_, y_ = np.array(x), np.array(y)
                if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= 0.9:
                    links |= {(a, b), (b, a)}
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = min(root[a], root[b])
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id long, embedding array<double>, rep string, weight int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.similar_vectors(df).collect()}
    assert got == {i: (sum(a == i for a, _ in links), root[i], root[i] == i) for i in ids}
    assert vectors.similar_vectors(df.limit(0)).count() == 0


def test_tiles_of_cells_with_many_visitors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 8)
    shared = []
    spread = vectors._spread
    monkeypatch.setattr(vectors, "_spread", lambda s: shared.append(s) or spread(s))
    rows = [(i, x) for i, x in vector_rows() if i < 210]
    vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([1] * len(rows)), pa.array([x for _, x in rows])], names=["id", "weight", "vector"])
    sent = Counter(x for out in spread(shared[0])([batch]) for x in zip(out["tile"].to_pylist(), out["side"].to_pylist()))
    assert 0 < max(sent.values()) <= 4 * 8


def page_rows():
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefgh é\r\n") for _ in range(300_000))
    return [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "http://b/ü", None), (2, "u", ""), (7, "v", "short"), (8, "v", "short"), (1, "w", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (4, "w", "z" * 100), (6, "w", "z" * 100), (10, "w", "z" * 99), (11, "w", "z" * 99)]


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 1000)
    rows = page_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(df, folder)
    chunks = warc.read_archives(manifest, folder).collect()
    payload = {}
    for c in sorted(chunks, key=lambda c: (c.page_id, c.chunk_no)):
        assert len(c.data) <= warc.CHUNK_BYTES
        payload[c.page_id] = payload.get(c.page_id, b"") + bytes(c.data)
        if c.record_type == "response":
            assert (c.payload_bytes, c.payload_digest) == (len(payload[c.page_id]), hashlib.sha256(payload[c.page_id]).hexdigest())
    want = {i: (h or "").encode() for i, _, h in rows}
    again = {5: 3, 6: 4}
    assert payload == {i: b"" if i in again else h for i, h in want.items()}
    last = {c.page_id: (c.payload_bytes, c.payload_digest, c.record_type, c.refers_to) for c in chunks if c.last}
    assert last == {i: (len(h), hashlib.sha256(h).hexdigest(), "revisit" if i in again else "response", again.get(i)) for i, h in want.items()}
    whole = b"".join(gzip.decompress(open(f.path, "rb").read()) for f in pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(f"{tmp_path}/archives")))
    assert whole.count(b"WARC-Record-ID: <urn:page:") == len(rows)
    assert b"\r\nX: y" not in whole.split(b"\r\n\r\n")[0]


def test_archives_of_nothing_and_null_ids(spark):
    df = spark.createDataFrame([(None, "u", "q" * 200), (None, "u", "q" * 200), (1, "u", "q" * 200)], "page_id long, url string, html string")
    assert sorted(r.record_type for r in warc.round_trip(df).collect()) == ["response"] * 3
    assert warc.round_trip(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work well for all of you.</p></div>
<div id="page"><div class="post"><h2>A   title &amp; more</h2><p>First <b>bold</b>ed para&shy;graph of the text, with a <a href=#>link</a> in it.<p>Second one,
unclosed, that runs on for quite some words.<div class="ad">Buy this now, it is cheap and it is good for you, they say.</div>
<table><tr><td>cell one<td>cell two</table><ul><li>point one of the list<li>point two</ul><pre>code  line</pre></div>
<div class="comments"><article><p>I am a reader and I think that this is all quite wrong, sorry.</p></article></div></div>
<aside class="sidebar"><p>Popular stories that other people have read on this very fine site.</p></aside>
<form><p>Send us a message about this page and leave your name here.</p><input><button>Go</button></form>
<footer><p>Copyright by the people who made this site and who own it.</p></footer><!-- end <p>never</p> --></body></html>"""


def test_page():
    assert html.main_text(PAGE) == "A title & more First bolded para\xadgraph of the text, with a link in it. Second one, unclosed, that runs on for quite some words. cell one cell two point one of the list point two code line"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("just some words that are not in any element at all", "just some words that are not in any element at all"),
        ("<article>a<br>b<!-- c", "a b"),
        ("<article><p>x &lt;b&gt; &#233;&nbsp; y</p></article><script>z", "x <b> é y"),
        ("<article><p>1 < 2 and <3</p></article>", "1 < 2 and <3"),
        ("<main><p title='a>b'>kept</p></main><p>Outside of it.</p>", "kept"),
        ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
        ('<article><p hidden>no</p><p style="display:none">no</p><p>yes</p></article>', "yes"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_deep_and_broken_pages_end():
    assert html.main_text("<div>" * 3000 + "words in the deep that are long enough to be a sentence of their own." + "</div>" * 10)
    assert html.main_text('<p a="' * 2000) == ""
    assert len(html.main_text("<article>" + "<p>some words here</p>" * 3000)) == 3000 * 16 - 1


def brute_cut(found, scores):
    """Least cost over all labellings of a few blocks."""
    n = len(found)
    places = sorted({b[2].number for b in found})
    top = None
    for m in range(1 << n):
        keep = [bool(m >> k & 1) for k in range(n)]
        cost = sum(s if s > 0 and not k else -s if s < 0 and k else 0 for s, k in zip(scores, keep))
        for k in range(1, n):
            if keep[k] != keep[k - 1]:
                cost += html.NEXT_EDGE + (html.SIBLING_EDGE if found[k][2] is found[k - 1][2] else 0)
        for p in places:
            yes = sum(html.CONTAINER_EDGE for b, k in zip(found, keep) if b[2].number == p and k)
            no = sum(html.CONTAINER_EDGE for b, k in zip(found, keep) if b[2].number == p and not k)
            cost += min(yes, no)
        top = cost if top is None else min(top, cost)
        if m == sum(1 << k for k, x in enumerate(html.cut(found, scores)) if x):
            mine = cost
    return top, mine


def test_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(40):
        page = "".join(f"<div>{''.join(f'<p>block {rng.random()}</p>' if rng.random() < 0.5 else f'text {rng.random()}<br>' for _ in range(rng.randint(1, 3)))}</div>" for _ in range(3))
        found = html.blocks(page)[:8]
        scores = [rng.uniform(-2, 2) for _ in found]
        best, mine = brute_cut(found, scores)
        assert mine == pytest.approx(best)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old", 3), (2, None, None, None, None)], "page_id long, url string, html string, text string, N_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {1: (html.main_text(PAGE), len(html.main_text(PAGE))), 2: ("", 0)}
    assert html.extract(df.limit(0)).count() == 0


def test_hidden_inline_elements_end_with_their_tag():
    rest = "two three four five six seven eight nine ten eleven twelve."
    for mark in ('<i aria-hidden="true"></i>', '<span style="display:none">x</span>', "<span hidden>x<span>y</span>z</span>", '<b hidden><em class="none">x</em></b>', "<x-icon hidden>x</x-icon>"):
        assert html.main_text(f"<p>one {mark} {rest}</p>").split() == ["one", *rest.split()], mark
    whole = f"<article><span hidden>x</span><p>One {rest}</p><p>Again {rest}</p></article>"
    assert html.main_text(whole) == f"One {rest} Again {rest}"
    assert [b[0] for b in html.blocks("<p>a <span hidden>x <div>y</span> z</div> <p>b <i hidden>x</p><p>c</p>")] == ["a", "y z", "b", "c"]
    assert [b[0] for b in html.blocks("<div><span hidden>x<div>y</span>z</div>w</span>v</div><div>u</div>")] == ["v", "u"]
    assert [b[0] for b in html.blocks("<div><b hidden>x<div>y</b>z</div>w</div>")] == ["z", "w"]
    assert [b[0] for b in html.blocks('<div><span class="none">a <span>b</span> c</span> d</div>')] == ["a b c d"]
