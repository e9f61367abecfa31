import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortia.llm import decontaminate, licences, webpages
from cohortia.llm import decontaminate as D
from cohortia.llm.hashing import hash_words, text_buffers

ARTICLE = "<h1>Head &amp; line</h1><p>First  paragraph\nof words.<p>Second <b>bold</b><br>one &#x41;.</p><ul><li>x<li>y</ul>"
TEXT = "Head & line\nFirst paragraph of words.\nSecond bold one A.\nx\ny"


def page(article, around="div class='post-7 content'"):
    tag = around.split()[0]
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href=/a>Home</a></ul></nav><!-- note --><div class='cookie-notice'>We use cookies on this page, very many of them.</div>"
        f"<div id=wrap><{around}>{article}<div class=ad>Buy now</div><form>Mail <input></form></{tag}><aside>Side</aside>"
        "<section class=comments><p>Nice article, thank you very much.</p></section></div><footer>&copy; me</footer></body></html>"
    )


def test_article_only():
    for around in ("div class='post-7 content'", "article", "main role=main", "td"):
        assert webpages.Page(page(ARTICLE, around)).text([]) == TEXT


def test_broken_markup():
    cases = {"": "", "plain": "plain", "<p>a": "a", "a<b>c": "ac", "<div title=\"a>b\">q</div>": "q", "<!-- open": "", "<script>x": "", "</p></div>": "", "<p>x</p><nav>n</nav>": "x", "&lt;i&gt;": "<i>"}
    for html, text in cases.items():
        assert webpages.Page(html).text([]) == text
    assert webpages.Page("<article>" + "<div>" * 3000 + "deep").text([]) == "deep"


def test_hosts_agree(spark):
    long_aside = "<div class=teaser>" + "<p>Read this other story about something else entirely, it is long.</p>" * 4 + "</div>"
    rows = [(k, f"http://h.example.org/{k}", page(ARTICLE * 3).replace("<aside>", long_aside + "<aside>", 0)) for k in range(9)]
    odd = page("<p>Short.</p>").replace("<aside>", long_aside + "<aside>")
    rows += [(20, "http://H.example.org:80/odd", odd), (21, None, odd), (22, "http://h.example.org/none", None), (23, "http://h.example.org/none", ""), (24, "http://h.example.org/x", "<p>bare"), (20, "http://H.example.org:80/odd", odd)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, paths string")
    got = webpages.extract_text(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[20].text == "Short."  # by itself the teaser would win
    assert by[21].text != "Short." and by[22].text == by[23].text == "" and by[24].text == "bare"
    assert by[0].text == "\n".join([TEXT] * 3) and by[0].n_chars == len(by[0].text)
    assert webpages.extract_text(pages.limit(0)).count() == 0


def test_many_winners_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(webpages, "SMALL_BYTES", 0)
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/", page(ARTICLE)) for k in range(12)], "page_id long, url string, html string")
    assert [r.text for r in webpages.extract_text(pages).collect()] == [TEXT] * 12


def test_host_expressions_agree(spark):
    from pyspark.sql import functions as F

    urls = ["http://a.B.org:8/x", "https://u:p@c.org?q", "//d.org/#f", "e.org/x", "", None, "http://", "HTTPS://F.org"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(
        "url", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host")
    )
    assert all(r.host == webpages.host_of(r.url) for r in got.collect())


def dice(a, b):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    x, y = (set(zip(w, w[1:])) for w in (words(a), words(b)))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_licences_against_every_template(spark, make, odd_rows):
    listed = licences._templates()
    rng = random.Random(4)
    rows = []
    for k, (_, text) in enumerate(rng.sample(listed, 60)):
        words = text.split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, f"Some prose before it.\n{' '.join(words)}\nand after it"))
    rows += [(900 + k, r[1]) for k, r in enumerate(odd_rows)]
    want = {}
    for k, text in rows:
        for line in (text or "").split("\n"):
            best = max(dice(line, t) for _, t in listed)
            if best >= licences.THRESHOLD:
                want.setdefault(k, []).append(round(best, 9))
    got = {}
    for r in licences.scan_licences(make(rows)).where("passage = 'line'").collect():
        got.setdefault(r.doc_id, []).append(round(r.dice, 9))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_licence_over_lines(make):
    body = dict(licences._templates())["ISC"].replace(" ", " \n", 30)
    isc = next(t for n, t in licences._templates() if n == "ISC" and len(t) > 300)
    lines = "\n".join(isc[i : i + 70] for i in range(0, len(isc), 70) if True)
    words = isc.split()
    lines = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    got = licences.scan_licences(make([(1, f"Intro.\n\n{lines}\n\nOutro of the page."), (2, lines), (3, body)])).collect()
    assert ("paragraph", "ISC") in {(r.passage, r.licence) for r in got if r.doc_id == 1}
    assert "ISC" in {r.licence for r in got if r.doc_id == 2}
    assert licences.scan_licences(make([])).count() == 0


def test_licences_wherever_they_lie(make):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
    mit, bsd = licences._MIT_BODY, f"{licences._BSD_HEAD}\n\n{licences._BSD_NAMES}\n\n{licences._BSD_TAIL}"
    parts = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    statement = "This project is licensed under the MIT License, see the LICENSE file for details, and now for something else."
    commented = "\r\n".join("# " + " ".join(mit.split()[k : k + 9]) for k in range(0, 200, 9))
    texts = {
        1: (f"{prose(300)}\n\n{parts}\n\n{prose(300)}", [("run", "MIT")]),
        2: (f"{prose(40)}\n\n{bsd}\n\n{prose(40)}\n\n{parts}\n\n{prose(5)}\n\n{parts}", [("run", "BSD-3-Clause"), ("run", "MIT"), ("run", "MIT")]),
        3: (f"{prose(9)} {statement} {prose(40)}", [("run", "MIT")]),
        4: (f"# {prose(200)}\r\n#\r\n{commented}\r\n#  \r\n# {prose(200)}", [("paragraph", "MIT")]),
        5: (f"{prose(9)} This project is licensed under the Zebra License, as is this: This project is licensed under the", []),
        6: (f"{prose(90)} {mit[:500]} {prose(90)}", []),
        7: (f"{prose(20)}\nReleased under the MIT License.\n{prose(20)}", [("line", "MIT")]),
    }
    got = licences.scan_licences(make([(k, t) for k, (t, _) in texts.items()])).collect()
    for k, (text, want) in texts.items():
        assert sorted((r.passage, r.licence) for r in got if r.doc_id == k) == want, k
        assert all(r.dice > 0.99 for r in got if r.doc_id == k)
    assert {r.first_byte for r in got if r.doc_id in (1, 3)} == {texts[1][0].index("Permission"), texts[3][0].index("This project")}


def test_whole_licence_texts_and_spdx_lines(make):
    whole = dict(licences.full_texts())
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= whole.keys()
    texts = [(k, t) for k, t in whole.items()]
    docs = [(k, t) for k, (_, t) in enumerate(texts)] + [(100 + k, f"Our notes on this.\n\n{t}\n\nMore notes.") for k, (_, t) in enumerate(texts)]
    ids = ["MIT", "Apache-2.0", "GPL-2.0-or-later", "BSD-3-Clause", "CC-BY-SA-4.0", "MPL-2.0"]
    docs += [(200 + k, f"/* SPDX-License-Identifier: {i} */\nint main() {{}}") for k, i in enumerate(ids)] + [(300, "SPDX-License-Identifier: Zebra-1.0")]
    said = ["Distributed under the terms of the MIT License", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Available under the Apache License, Version 2.0"]
    docs += [(400 + k, f"Well. {s}, which we like and which many others like as well.") for k, s in enumerate(said)]
    got = licences.scan_licences(make(docs)).collect()
    for k, (name, _) in enumerate(texts):
        assert name in {r.licence for r in got if r.doc_id == k and r.passage == "text" and r.dice > 0.99}
        best = max((r for r in got if r.doc_id == 100 + k and r.passage in ("text", "run")), key=lambda r: r.dice)
        assert best.licence == name and best.dice > 0.95
    for k, i in enumerate(ids):
        assert {r.licence for r in got if r.doc_id == 200 + k} == {i.removesuffix("-or-later")}
    assert not [r for r in got if r.doc_id == 300]
    assert [{r.licence for r in got if r.doc_id == 400 + k} for k in range(3)] == [{"MIT"}, {"CC-BY-SA-4.0"}, {"Apache-2.0"}]


def test_own_templates(make):
    mine = [("House-1", "You may read this text in our house on any day but Sunday")]
    docs = make([(1, f"Intro words here. {mine[0][1]}. More words there."), (2, "Released under the MIT License.")])
    assert [(r.doc_id, r.licence) for r in licences.scan_licences(docs, templates=mine).collect()] == [(1, "House-1")]


def test_runs_against_every_window(make):
    rng = random.Random(7)
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    listed = [t for t in licences._templates() if t[0] == "MIT" and len(t[1].split()) < 8]
    rows = []
    for k in range(150):
        part = rng.choice(listed)[1].split()
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = rng.choice(["other", "the", "MIT", "under"])
        rows.append((k, " ".join([*(f"a{j}" for j in range(rng.randrange(9))), *part, *(f"b{j}" for j in range(rng.randrange(9)))])))
    got = {}
    for r in licences.scan_licences(make(rows)).where("licence = 'MIT'").collect():
        got[r.doc_id] = max(got.get(r.doc_id, 0), round(r.dice, 9))
    for k, text in rows:
        w = words(text)
        runs = [" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
        best = max((dice(run, t) for run in runs for _, t in listed if "mit" in run.split()), default=0)
        assert got.get(k, 0) == (round(best, 9) if best >= licences.THRESHOLD else 0), text


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            step = decontaminate.MATCH if x == y else decontaminate.MISMATCH
            h[i + 1, j + 1] = max(0, h[i, j] + step, h[i, j + 1] + decontaminate.GAP, h[i + 1, j] + decontaminate.GAP)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)
        assert decontaminate.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.randrange(14, 50)))) for k in range(30)] + [(90, "the of and to in the of and to in the of"), (91, ""), (92, None), (93, "zebra")]
    rows, truth = [], set()
    for k in range(400):
        words = say(rng.randrange(0, 200))
        if k % 4 == 0:
            i = k // 4 % 30 if k % 3 else 7  # item 7 is in very many documents
            part = items[i][1].split()
            for _ in range(len(part) // 8):
                part[rng.randrange(len(part))] = rng.choice(["Edited", "words"])
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in part]
            truth.add((k, i))
        rows.append((k, " ".join(words)))
    return items, rows, truth


def test_leaks(spark, make, leaked):
    items, rows, truth = leaked
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make(rows)
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= truth
    # Anything else must hold up against the full alignment matrix.
    text, words = dict(rows), lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for r in got:
        item = words(dict(items)[r.item_id])
        assert smith_waterman(item, words(text[r.doc_id])) >= decontaminate.THRESHOLD * decontaminate.MATCH * len(item)
        assert 0 <= r.first_word <= r.last_word < len(words(text[r.doc_id]))
    blocks = decontaminate.find_leaks(docs, bench, block_bytes=500).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in blocks) == sorted((r.doc_id, r.item_id, r.score) for r in got)
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(text) - {r.doc_id for r in got}


def test_leaks_of_odd_rows(spark, make, odd_rows, leaked):
    bench = spark.createDataFrame([(k, t, 1) for k, t in leaked[0]], "item_id long, text string, doc_id int")
    docs = make(odd_rows).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "score")
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert decontaminate.drop_leaks(docs, bench).count() == len(odd_rows)
    assert decontaminate.find_leaks(make([]), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == len(odd_rows)


PROSE = "<body><article><h1>T</h1><p>" + "Article prose goes on here. " * 20 + "</p>{}</article></body>"


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ("<section id='related-work'><p>" + "Prior systems did this. " * 20 + "</p></section>", True),
        ("<h3 id='search'>Search</h3>", True),
        ("<p class='notice'>" + "Take notice of this rather long paragraph. " * 5 + "</p>", True),
        ("<section id='feedback'><ul><li>" + "Answers of the panel, in their own words. " * 8 + "</li></ul></section>", True),
        ("<table id='footer-sizes'><tr><td>" + "Cells of a long table about footers. " * 8 + "</td></tr></table>", True),
        ("<p class='notice'>We use cookies.</p>", False),
        ("<section class='comments'>" + "<p>I do not agree with this at all.</p>" * 9 + "</section>", False),
        ("<section id='comments'>" + "<p>I do not agree with this at all.</p>" * 9 + "</section>", False),
        ("<section class='related'>" + "Teasers of other stories without a link. " * 9 + "</section>", False),
        ("<section class='related'>" + "<a href='x'>Another story of this site that is linked here</a> " * 9 + "</section>", False),
        ("<ul class='share'><li>Mail</li><li>Print</li></ul>", False),
        ("<div class='newsletter'>" + "Get our letter every week, it costs nothing. " * 9 + "</div>", False),
        ("<section hidden id='x'>" + "Hidden words of a hidden section. " * 9 + "</section>", False),
        ("<div class='comments'><h3>Comments</h3><p>" + "I do not agree with this at all. " * 9 + "</p></div>", False),
    ],
)
def test_names_from_content_do_not_make_boilerplate(part, kept):
    from cohortia.llm.webpages import Page

    text = Page(PROSE.format(part)).text([])
    plain = Page(PROSE.format("")).text([])
    assert text.startswith(plain) and (len(text) > len(plain)) == kept


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 100_000 + "deep text here</div>",
        "<ul><li><ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000 + "</span>" * 50_000,
        "<body>" + "<p>" * 100_000 + "<div>" * 50_000 + "x" + "</i>" * 100_000,
        "<table>" * 30_000 + "<tr><td>x" * 30_000,
        "<header>" + "<div>" * 50_000 + "<h1>t</h1>x" * 20_000,
    ],
)
def test_deep_pages_take_linear_time(html):
    import time

    from cohortia.llm.webpages import Page

    began = time.process_time()
    page = Page(html)
    best = page.best()
    page.text([page.path(best[0])] if best else [])
    assert time.process_time() - began < 20


@pytest.mark.parametrize("corpus_bytes", [None, 30e9, 100e12])
def test_edited_copies_are_found_whatever_the_corpus(sf, corpus_bytes):
    """Copies with 10, 20 and 30 % of words replaced that still reach the score, counts scaled to the size of the corpus; every pair is aligned."""
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist() if t]
    corpus = np.array([w for t in texts for w in re.findall(r"[a-z0-9]+", t.lower())])
    names = [t for t in pq.read_table(f"{sf}/benchmark.parquet", columns=["text"]).column("text").to_pylist() if t][:40]
    hashed = lambda many: hash_words(*text_buffers(pa.array(many, pa.string())), D._ABC)
    of = lambda w, i: w.hashes[w.first[i] : w.first[i + 1]]
    w, docs = hashed(names), hashed(texts)
    items = D.Items(list(range(len(names))), [of(w, i) for i in range(len(names))])
    values = np.unique(np.concatenate(items.words))
    counts = np.array([(docs.hashes == v).sum() for v in values])
    factor = 1 if corpus_bytes is None else corpus_bytes / sum(len(t.encode()) for t in texts)
    finder = D.Finder(items, D.choose_seeds(items, values, (counts * factor).astype(np.int64), int(len(docs.hashes) * factor)), D.THRESHOLD)
    rng = np.random.default_rng(11)
    for rate in (0.1, 0.2, 0.3):
        copies = []
        for t in names:
            for _ in range(3):
                edited = [str(rng.choice(corpus)) if rng.random() < rate else x for x in re.findall(r"[a-z0-9]+", t.lower())]
                around = [str(x) for x in rng.choice(corpus, 40)]
                copies.append(" ".join([*around[:20], *edited, *around[20:]]))
        words = hashed(copies)
        true = {(c, k) for c in range(len(copies)) for k, item in enumerate(items.words) if D.align(item, of(words, c))[0] >= D.THRESHOLD * D.MATCH * len(item)}
        got = {leak[:2] for leak in finder.leaks(words)}
        assert got <= true and len(true) > 60
        assert len(got) >= 0.98 * len(true)
