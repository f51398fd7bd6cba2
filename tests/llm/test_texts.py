"""Main text, quality rules, language and contamination against plain Python."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import TABLES
from streamlat.llm import decontamination, html_text, language, quality, queries
from streamlat.llm.support import read

NAMES = ("row", "n_words", "spans", "host", "lines", "line", "removed", "print", "documents")


def own():
    """Columns whose names the operators use inside."""
    return {c: F.lit("own") for c in NAMES}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in read(spark, TABLES, "documents").collect()}


# --- main text -----------------------------------------------------------------------


def article(page):
    inside = page[page.index("<article>") + 9:page.index("</article>")]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<b>|</b>|<br>", " ", inside))
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_main_text(spark):
    pages = {r.page_id: r.html for r in read(spark, TABLES, "pages").collect()}
    rows = queries.QUERIES["op2_main_text"](spark, TABLES).collect()
    assert {r.page_id: r.text for r in rows} == {k: article(p) for k, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def content(page):
    return html_text.main_text(page).split("\n")


def test_boilerplate_of_many_kinds():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="main-content"><h2>T</h2>
      <p>One&nbsp;&amp; two<br>three.</p><div class="share">x</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
      <section class="comments"><article class="comment"><p>A long comment of a reader.</p></article></section>
      <noscript>on!</noscript></div><aside>side</aside><div class="cookie-notice">We use</div>
      <form><p>Name <input></p></form><script>if (a < b) "<p>"</script><footer>f</footer></body></html>"""
    assert content(page) == ["T", "One & two three.", "a", "b", "c", "d"]


LONG = "A sentence of the article that says what happened, where it happened and to whom. " * 3
NOTICE = ("We use cookies and similar technologies to measure how this site is read and to show what may interest you. "
          "You can accept all of them or change your preferences at any time; read more in the privacy policy. ") * 2


@pytest.mark.parametrize("page, expected", [
    ("<body><h1>T</h1><p>One short line.</p><p>Two short lines.</p></body>",
     ["T", "One short line.", "Two short lines."]),
    ("<body><div><h1>Title</h1><p>A paragraph of sixty characters that is the whole article.</p></div></body>",
     ["Title", "A paragraph of sixty characters that is the whole article."]),
    # Neutral names, with menu, notice and copyright line told by links, wording and place.
    (f"""<body><div class="x1">The Daily Site</div><div class="x2"><a href="/">Home</a> <a href="/a">About us</a></div>
     <div class="x3"><h1>Title</h1><p>{LONG}</p><p>Short end.</p></div><div class="x4">{NOTICE}</div>
     <div class="x5">© 2024 The Daily Site</div></body>""", ["Title", LONG.strip(), "Short end."]),
    # A table layout with lists.
    (f"""<table><tr><td><ul><li><a href="1">One</a><li><a href="2">Two</a></ul><td><h1>Title</h1>{LONG}<ul><li>First point.
     <li>Second point.</ul></table>""", ["Title", LONG.strip(), "First point.", "Second point."]),
    # A name of content on something small does not make the rest boilerplate.
    (f"""<div class="text">Hello.</div><div class="c"><p>First.</p><p>{LONG}</p><p>Last.</p></div><nav>menu</nav>
     <form><p>Name</p></form><div class="advert">Buy</div>""", ["Hello.", "First.", LONG.strip(), "Last."]),
    # Sections of an article named like boilerplate, and real boilerplate within it.
    (f"""<article><h1>T</h1><section class="related-work"><h2>Related work</h2><p>Others did it.</p></section>
     <div class="search-results"><p>We found four.</p></div><div class="box">{NOTICE}</div><div class="share">Share</div>
     <div class="related-posts"><a href="1">Another</a></div><div>Advertisement</div><p>End.</p>
     <p>All rights reserved.</p><div class="comment-list"><p>{LONG}</p></div></article><p>Unmarked.</p>""",
     ["T", "Related work", "Others did it.", "We found four.", "End.", "All rights reserved."]),
    # An article about cookies stays.
    ("<main><p>The baker makes cookies. Some sites use chocolate for cookies.</p><p>All is well.</p></main>",
     ["The baker makes cookies. Some sites use chocolate for cookies.", "All is well."])])
def test_templates_without_marks(page, expected):
    assert content(page) == expected


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<a href='x", "</p></div>", "<!-- x", "<script>x",
                                  "<p>" * 3000, "<div>" * 3000 + "x", "&am &#x110000; &#0;", "<td>x</tr></table>"])
def test_broken_pages_do_not_fail(page):
    html_text.main_text(page)


def cost(values, edges, label):
    return (sum(abs(v) for v, on in zip(values, label) if v and on != (v > 0))
            + sum(w for a, b, w in edges if label[a] != label[b]))


@pytest.mark.parametrize("seed", range(60))
def test_the_cut_is_minimal(seed):
    choose = random.Random(seed)
    n = choose.randint(1, 9)
    values = [choose.randint(-10, 10) for _ in range(n)]
    edges = [(i - 1, i, choose.randint(0, 8)) for i in range(1, n)]
    edges += [(i - 2, i, choose.randint(0, 5)) for i in range(2, n)]
    best = min(cost(values, edges, [bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(values, edges, html_text.least_cut(values, edges)) == best


def test_edges_of_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>x</p></article>"), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    assert sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect())) == [
        (0, "x", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).collect() == []


# --- quality -------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words, windows, covered, seen, again = WORD.findall(text), defaultdict(list), set(), set(), 0
    for k in range(len(words) - 2):
        windows[tuple(words[k:k + 3])].append(k)
    for places in windows.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(3))
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def brute_quality(rows, share=quality.MOST_SHARE, least=quality.LEAST_DOCUMENTS):
    """Words that frequent lines take from each text, and whether enough are left."""
    holders, everyone = defaultdict(set), defaultdict(set)
    for k, r in enumerate(rows):
        who, host = (r.doc_id, None) if r.doc_id is not None else (None, k), r.source or ""
        everyone[host].add(who)
        for line in (r.text or "").split("\n"):
            if WORD.search(line):
                holders[host, quality.normal_line(line)].add(who)
    out = []
    for r in rows:
        host, gone = r.source or "", 0
        for line in (r.text or "").split("\n"):
            n = len(holders.get((host, quality.normal_line(line)), ())) if WORD.search(line) else 0
            if n > least and n > share * len(everyone[host]):
                gone += len(WORD.findall(line))
        base = base_counts(r.text or "")
        out.append((r.doc_id, *base, not base[-1] and base[0] - gone >= quality.LEAST_LEFT * base[0], gone))
    return out


@pytest.mark.parametrize("share, least", [(quality.MOST_SHARE, quality.LEAST_DOCUMENTS), (0.0, 1), (0.05, 0)])
def test_quality_by_brute_force(spark, share, least):
    rows = read(spark, TABLES, "documents").collect()
    got = quality.quality(read(spark, TABLES, "documents"), share=share, least=least).collect()
    assert sorted(map(tuple, got)) == sorted(brute_quality(rows, share, least))
    assert least or any(r.n_removed_words for r in got)


def test_quality_query(spark, documents):
    rows = queries.QUERIES["op9_line_frequency"](spark, TABLES).collect()
    assert sorted(map(tuple, rows)) == sorted(brute_quality(list(documents.values())))


def test_frequent_lines(spark):
    def text(i, shared):
        own = " ".join(f"w{i}x{k}" for k in range(60))
        return f"{own}\n" + "\n".join(shared)

    line = "Shared100  line100 host100"
    rows = [(i, text(i, ["shared777 LINE123 host000"] * 2), "a") for i in range(6)]
    rows += [(10, text(0, [line]), "b") for i in range(9)]               # one document, nine rows
    rows += [(None, text(0, [line]), "c") for i in range(9)]             # nine documents
    rows += [(30 + i, text(0, [line]), "d") for i in range(9)]           # copies are documents
    rows += [(20, "\n".join([line] * 30), "a"), (21, " ".join(f"v{k}" for k in range(80)) + "\n" + "\n".join(
        f"shared{k} line{k} host{k}" for k in range(100, 300)), "a"), (22, None, None), (23, "", None),
        (24, "\n".join(["long line of words " * 5] * 20_000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(own())
    made = quality.quality(docs, share=0.5, least=6, with_text=True).collect()
    got = {r.doc_id: r for r in made}
    assert len(made) == len(rows)
    assert all(got[i].n_removed_words == 6 and got[i].kept and "\n" not in got[i].text for i in range(6))
    assert got[10].n_removed_words == 0 and got[10].text.endswith(line)
    # Where all lines of all documents are the same, none is left.
    assert got[None].n_removed_words == got[38].n_removed_words == 63 and not got[38].kept
    assert not got[21].base_failed and not got[21].kept and got[20].base_failed
    assert got[22].n_words == got[23].n_words == 0 and got[24].n_words == 400_000
    same = {r.doc_id: tuple(r) for r in quality.quality(docs, share=0.5, least=6).collect()}
    assert same == {k: tuple(r)[:9] for k, r in got.items()}
    assert quality.quality(docs.limit(0)).collect() == []


# --- language ------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, documents):
    rows = queries.QUERIES["op10_language"](spark, TABLES).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_is_learned_from_held_out_or_unlabelled(spark):
    docs = spark.createDataFrame([(i, "text", None if i % 3 else "en") for i in range(60)],
                                 "doc_id long, text string, lang string")
    kept = language.sample(docs.withColumn("text", F.concat("text", F.lit(" "), "doc_id"))).collect()
    ids = {int(r.text.split()[1]) for r in kept}
    assert ids == {i for i in range(0, 60, 3) if zlib.crc32(str(i).encode()) % 5}
    assert language.sample(docs, 5).count() == 5


def test_edges_of_language(spark, documents):
    trained = language.train(read(spark, TABLES, "documents"))
    rows = [(1, None, "en"), (2, "", None), (3, "123 ...", "xx"), (None, "the and of this that", None),
            (4, "the " * 60000, None), (4, "the " * 60000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(own())
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.predict(docs, trained).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert language.identified(docs, trained).dtypes == docs.dtypes
    assert language.identified(docs, trained).count() == 3
    none = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), trained).collect() == []


# --- contamination -------------------------------------------------------------------

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(text):
    return TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    windows = defaultdict(set)
    for name, text in items:
        words = low_words(text)
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[k:k + n])].add(str(name))
    widths = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, found = low_words(text), set(), set()
        for n in widths:
            for k in range(len(words) - n + 1):
                if names := windows.get(tuple(words[k:k + n])):
                    found |= names
                    hit.update(range(k, k + n))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(words), len(hit), len(found), sha, bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_contamination_of_odd_texts(spark, block_bytes):
    choose = random.Random(5)
    items = [(i, " ".join(choose.choice("abcd") for _ in range(choose.choice([1, 4, 9, 10, 11, 14]))))
             for i in range(8)] + [(90, None), (91, "..."), (92, "É ñ " * 6), (92, "É ñ " * 6)]
    texts = ["".join(choose.choice(["a", "b", "c", "d", "É", "ñ", "A B", "e"]) + choose.choice([" ", "-", "\n"])
                     for _ in range(choose.randint(0, 60))) for _ in range(150)]
    texts += [None, "", items[0][1], " ".join(t for _, t in items if t)] + [items[5][1] + " é"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(own())
    bench = spark.createDataFrame(items, "item_id long, text string")
    if block_bytes == 1:
        items, bench = items[:3], bench.limit(3)
    got = decontamination.contamination(docs, bench, block_bytes=16 if block_bytes == 1 else block_bytes).collect()
    assert [tuple(r)[1:6] for r in sorted(got)] == brute(texts, items)
    clean = decontamination.clean(docs, bench)
    assert clean.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in clean.collect()) == [
        i for i, b in enumerate(brute(texts, items)) if not b[-1]]


def brute_longest(text, items, window=10):
    """Length and place of the longest run of words shared with an item, of a window or the whole item."""
    words, best = low_words(text), (0, -1)
    for _, item in items:
        other = low_words(item)
        for i in range(len(words)):
            for j in range(len(other)):
                n = 0
                while i + n < len(words) and j + n < len(other) and words[i + n] == other[j + n]:
                    n += 1
                if n >= min(window, len(other)) and (n, -i) > (best[0], -best[1]):
                    best = n, i
    return best


@pytest.mark.parametrize("seed", range(8))
def test_longest_match_by_brute_force(seed):
    choose = random.Random(seed)
    letters = "ab" if seed % 2 else "abcd"
    items = [(str(i), " ".join(choose.choice(letters) for _ in range(choose.choice([0, 2, 9, 10, 17, 40]))))
             for i in range(choose.randint(1, 6))]
    texts = [" ".join(choose.choice(letters + "e") for _ in range(choose.randint(0, 50))) for _ in range(12)]
    texts += [t for _, t in items] + [" ".join([items[0][1], "e", items[-1][1]])]
    block = decontamination.Block(items)
    expected = [brute_longest(t, items) for t in texts]
    assert [r[3:] for r in decontamination.look_up(block, texts)] == expected
    # Whatever else is in the shard.
    assert [decontamination.look_up(block, [t])[0][3:] for t in texts] == expected


def test_longest_match_of_equal_words_is_not_quadratic():
    text = "a " * 32000
    begin = time.process_time()
    row = decontamination.look_up(decontamination.Block([("1", text)]), [text, "b " + text])
    assert [r[3:] for r in row] == [(32000, 0), (32000, 1)]
    assert time.process_time() - begin < 10


def test_longest_match_and_empty_tables(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[3:25]) + " z"), (2, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert (rows[1].longest, rows[1].longest_at, rows[1].n_hit) == (22, 2, 22)
    assert (rows[2].longest, rows[2].longest_at) == (0, -1)
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), items).collect() == []


@pytest.mark.parametrize("block_bytes", [1 << 20, 16])
def test_items_without_id_count_as_passages(spark, block_bytes):
    words = [f"w{i}" for i in range(40)]
    items = [(None, " ".join(words[:12])), (7, " ".join(words[20:31])), (None, " ".join(words[22:33]))]
    texts = [" ".join(words[:12]), " ".join(words), "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontamination.contamination(docs, bench, block_bytes=block_bytes).collect())
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(12, 0, True), (25, 1, True), (0, 0, False)]
    assert got[1].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert [r.doc_id for r in decontamination.clean(docs, bench, block_bytes=block_bytes).collect()] == [2]


@pytest.mark.parametrize("name", ["comment-body", "sidebar-content", "footer-text", "ad-content", "main-menu", "comment content"])
def test_bad_names_win(name):
    text = "Words that a reader wrote below the page. " * 3
    page = f"<body><article><p>The story.</p></article><div class='{name}'><p>{text}</p></div></body>"
    assert content(page) == ["The story."]
    assert content("<div class='main-content has-sidebar'><p>The story.</p></div>") == ["The story."]


@pytest.mark.parametrize("tag", ["select", "svg", "object", "audio", "math", "video", "template", "head"])
def test_silent_elements_without_end_do_not_take_the_page(tag):
    assert content(f"<article><{tag}><p>The story.</p></article>") == ["The story."]
    assert content("<article><p>x</p><script><p>no</p></article>") == ["x"]
