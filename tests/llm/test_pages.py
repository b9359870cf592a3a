"""Main text of pages, and shards of documents."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from emberlog.llm import extraction, markup, sharding

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style>
<script>var t="</p><article>";</script></head><body class="page has-sidebar">
<header class="top">Site name <nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies, many of them, and tell you about it here.</div>
<div class="wrap"><div class="post-{n} entry"><h1>Title &amp; more</h1>
<p>First  paragraph,\nwith <b>bold</b> and <a href="x">a link</a>.<br>Next line&nbsp;here.
<p>Second one, not closed, about a river, a stone, and the long way home in rain.
<ul><li>one<li>two</ul>
<div class="ad">Buy this now, it is cheap, very cheap, and good.</div>
<form><input name="q"><label>Search</label></form>
<table><tr><td>cell<td>other</table></div>
<aside>Read also: another page about something else entirely.</aside></div>
<section class="comments"><article class="comment"><p>First! A comment, longer than the article
itself, on and on and on, with many words, many commas, and nothing to say, really.</p></article></section>
<footer>&copy; somebody</footer></body></html>"""
TEXT = "\n\n".join(
    [
        "Title & more",
        "First paragraph, with bold and a link. Next line here.",
        "Second one, not closed, about a river, a stone, and the long way home in rain.",
        "one", "two", "cell", "other",
    ]
)


def test_paths_are_generalised():
    path, score = markup.best_container(markup.parse(PAGE.format(n=7)))
    assert path == markup.best_container(markup.parse(PAGE.format(n=81)))[0]
    assert path.endswith("div.entry.post-#") and score > 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("just text", "just text"),
        ("<nav>menu</nav>", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<p>open <!-- never closed <p>x", "open"),
        ("<body><p>1 < 2 &amp;&amp; 3 > 2</p>", "1 < 2 && 3 > 2"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</p></article>", "T\n\nx"),
        ("<main><p>a</p><script>if (a</p>b) {}</script><p>c</p></main>", "a\n\nc"),
        ('<nav><article><p>kept, although the menu is not closed</p>', "kept, although the menu is not closed"),
        ("<form><article><p>inside a form</p></article></form>", "inside a form"),
        ('<div title="a > b"><p>text</p></div>', "text"),
        ("<p>un<b>bro</b>ken</p>", "unbroken"),
        ("<div>" * 50_000 + "<p>deep</p>" + "</div>" * 50_000, "deep"),
        ("<p><table>" + "<div>x" * 20_000, "\n\n".join(["x"] * 20_000)),
        ('<p a="' + "x" * 1000, '<p a="' + "x" * 1000),
    ],
)
def test_extract_alone(html, text):
    assert extraction.extract(html, None) == text


@pytest.mark.parametrize(
    "name",
    ["content-with-sidebar", "layout-sidebar-right", "elementor-widget-container",
     "article-share-wrapper", "sidebar-layout", "widget"],
)
def test_wrapper_with_a_marked_name(name):
    body = PAGE.replace('class="wrap"', f'class="{name}"')
    if name == "widget":
        body = "<body><div class='widget'><p>all there is</p></div></body>"
        assert extraction.extract(body, None) == "all there is"
    else:
        body = body.replace("comments", "post-comments").format(n=1)
        assert extraction.extract(body.replace("A comment, longer", "So"), None) == TEXT


@pytest.mark.parametrize("name", ["post-share-row", "related-posts", "left-sidebar", "comments"])
def test_marked_parts_of_a_page_go(name):
    body = PAGE.replace('class="ad"', f'class="{name}"').format(n=1)
    assert extraction.extract(body, None) == TEXT


ARTICLE = "<div><p>The river runs, and the stones stay where they have always been, in the rain.</p></div>"
LINE = "The river runs, and the stones stay where they have always been, in the rain."


@pytest.mark.parametrize("tag", ["form", "aside", "header"])
def test_a_page_wrapped_in_one_element(tag):
    """As some frameworks write all of their pages."""
    body = f"<body><{tag} id='f'><nav>menu</nav>{ARTICLE}<footer>f</footer></{tag}></body>"
    assert extraction.extract(body, None) == LINE
    small = f"<body>{ARTICLE}<{tag}>Sign in, or read more.</{tag}></body>"
    assert extraction.extract(small, None) == LINE
    inside = f"<body><{tag}><article>{ARTICLE}</article></{tag}><div>{LINE * 9}</div></body>"
    assert LINE in extraction.extract(inside, None)


@pytest.mark.parametrize("depth", [10, 300, 5000])
def test_an_element_closed_far_below(depth):
    body = f"<body><nav>{'<div>' * depth}menu</nav>{ARTICLE}</body>"
    assert extraction.extract(body, None) == LINE


def test_votes_are_counted_as_they_are(spark):
    """The host's path against a plain count over the pages."""
    rng = random.Random(5)
    rows = []
    for n in range(120):
        cls = rng.choice(["post", "entry", "main-text"])
        words = " ".join(rng.choice(["river", "stone,", "rain"]) for _ in range(rng.randint(3, 40)))
        html = rng.choice([None, f"<div class='{cls}'><p>{words}</p></div>", f"<p>{words}</p>"])
        rows.append((n, f"http://h{rng.randrange(6)}.example/{n}", html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.host: r.path for r in extraction.host_paths(extraction.with_host(pages)).collect()}
    votes: dict = {}
    for _, url, html in rows:
        path, score = markup.best_container(markup.parse(html)) if html else ("", 0)
        if path:
            count, total = votes.setdefault(url.split("/")[2], {}).get(path, (0, 0.0))
            votes[url.split("/")[2]][path] = count + 1, total + score
    # Equal votes go to the larger score, which floats may round either way.
    for host, counts in votes.items():
        most = max(v[0] for v in counts.values())
        best = [p for p, v in counts.items() if v[0] == most]
        assert got[host] in best
        if len(best) > 1:
            assert counts[got[host]][1] == pytest.approx(max(counts[p][1] for p in best))
    assert set(got) == set(votes)


def test_hosts_agree(spark):
    """A page whose comments outweigh its article follows its host's other pages."""
    long_article = PAGE.replace("Second one", "Second one, " + "and much more, " * 60)
    rows = [(n, f"http://a.example/{n}", long_article.format(n=n), "clash") for n in range(5)]
    rows += [
        (10, "https://u@A.example:80/x", PAGE.format(n=1), None),
        (11, None, PAGE.format(n=2), None),
        (12, "not a url", "<p>plain</p>", None),
        (13, "http://a.example/y", None, None),
        (14, "http://a.example/z", "<main><p>another layout</p></main>", None),
        (None, "http://b.example/", "", None),
        (10, "https://u@A.example:80/x", PAGE.format(n=1), None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    for bound in (extraction.MOST_BROADCAST_HOSTS, 0):
        extraction.MOST_BROADCAST_HOSTS, kept = bound, extraction.MOST_BROADCAST_HOSTS
        got = [(r["page_id"], r["text"], r["n_chars"]) for r in extraction.main_text(pages).collect()]
        extraction.MOST_BROADCAST_HOSTS = kept
        texts = {}
        for page_id, text, count in got:
            assert count == len(text)
            texts.setdefault(page_id, []).append(text)
        assert texts[10] == [TEXT, TEXT] and len(got) == len(rows)
        assert (texts[12], texts[13], texts[14]) == (["plain"], [""], ["another layout"])
        assert texts[None] == [""]
    assert extraction.main_text(pages.limit(0)).collect() == []


def spread(sizes, parts, shards):
    total = np.zeros(shards, np.int64)
    np.add.at(total, parts, sizes)
    return total


def test_differencing_beats_dealing_in_turn():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 10_000, 500)
    vectors = np.zeros((500, 8), np.int64)
    vectors[:, 0] = sizes
    parts = sharding.difference(vectors)
    assert all(sorted(p) == list(range(8)) for p in parts.tolist())
    got = spread(sizes, parts[:, 0], 8)
    in_turn = spread(sizes, np.arange(500) % 8, 8)
    assert np.ptp(got) < np.ptp(in_turn) / 50
    assert sharding.difference(np.zeros((0, 8), np.int64)).shape == (0, 8)


def test_partial_partitions_combine():
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 1000, (40, 5))
    moved = sharding.difference(vectors)
    total = np.zeros(5, np.int64)
    np.add.at(total, moved, vectors)
    assert total.sum() == vectors.sum() and np.ptp(total) <= np.ptp(vectors, axis=1).max()


@pytest.mark.parametrize("batch", [20_000, 7])
def test_shards(documents, nothing, spark, batch):
    rng = random.Random(4)
    more = [(1000 + n, "w" * rng.randint(0, 3000), None, None, None, None, None) for n in range(300)]
    docs = documents.unionByName(spark.createDataFrame(more, documents.schema))
    got = sharding.shard_documents(docs, shards=10, batch_size=batch).collect()
    texts = docs.select("doc_id", "text").collect()
    wanted = sorted(
        str((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())))
        for r in texts
    )
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == wanted
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = {}
    shard_of = {r["doc_id"]: r["shard"] for r in got}
    for r in texts:
        by_text.setdefault(r["text"], set()).add(shard_of[r["doc_id"]])
    assert all(len(s) == 1 for s in by_text.values())
    assert set(sizes) == set(range(10))
    # The long text of the fixture is larger than an even share.
    rest = sorted(sizes.values())[:-1]
    assert rest[-1] - rest[0] < (200 if batch > 100 else 5_000)
    assert sharding.shard_documents(nothing).collect() == []
