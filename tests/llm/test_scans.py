"""Benchmark passages, licenses, packing, pages and personal data against brute force and round trips."""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelift.llm import decontamination, html_text, licenses, packing, personal, tagger, words

from .conftest import EDGE

BENCH = [(1, "a b c d e f g h i j k"), (2, "Hello  World"), (3, None), (4, "x x x x x x x x x x"), (5, ""), (None, "a b")]
DOCS = [(1, "a b c d e f g h i j k x"), (2, None), (3, ""), (4, "A-b c.D e f g h i j, k é hello World"), (None, "hello world"), (1, "x " * 12), (5, "hello world hello world")]


def brute_hits(docs, bench, n=10):
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    windows = {}
    for item, t in bench:
        w = rx.findall(low(t))
        for j in range(len(w) - min(n, len(w)) + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[j : j + min(n, len(w))]), set()).add(str(item))
    for d, t in docs:
        w, hit, items = rx.findall(low(t)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j : j + k])) in windows:
                    hit.update(range(j, j + k))
                    items |= windows[x]
        yield d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 500, 8])
def test_decontamination(frame, block):
    docs, bench = [*DOCS, *EDGE], frame(BENCH, "item_id long, text string")
    df = frame(docs).withColumns({"starts": F.lit(1), "items": F.lit("clash")})
    got = decontamination.decontamination(df, bench, block_bytes=block).drop("starts", "ends").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_hits(docs, BENCH)))


def test_broadcast_block_is_bounded():
    rng = random.Random(1)
    items = [(str(i), " ".join(rng.choice(["ab", "c", "é", "longer", "x-y"]) for _ in range(rng.choice([0, 3, 9, 10, 11, 400]))).encode()) for i in range(300)]
    w = decontamination.Windows(items, 10)
    assert w.nbytes - w.front.nbytes <= sum(decontamination.needed(t) for _, t in items)
    assert len(pickle.dumps(w)) < 1.1 * w.nbytes + 10_000  # what goes out is what is counted


def test_benchmark_text_goes(frame):
    docs = frame([(1, "one two three four five six seven eight nine ten, Hello world! eleven twelve", 9), (2, None, None), (3, "hello world", 1)], "doc_id long, text string, n_chars long").withColumn("row", F.lit("r"))
    got = {r.doc_id: (r.text, r.n_chars) for r in decontamination.remove_spans(docs, frame(BENCH, "item_id long, text string")).collect()}
    assert got == {1: ("one two three four five six seven eight nine ten, ! eleven twelve", 65), 2: (None, None)}
    empty = frame([], "item_id long, text string")
    assert decontamination.remove_spans(docs, empty).count() == 3 and decontamination.decontamination(docs.limit(0), empty).count() == 0


def test_windows_stay_in_their_text():
    w = words.Words([b"a b", b"", b"c", b"d e f g"], words.AS_IS)
    h, whole = w.windows(3)
    assert whole.tolist() == [False, False, False, True, True] and int(h[3]) == words.phrase([b"d", b"e", b"f"])


def brute_lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


def test_banded_alignment():
    rng = random.Random(2)
    for _ in range(200):
        a = [bytes([rng.randint(97, 101)]) for _ in range(rng.randint(1, 14))]
        b = [bytes([rng.randint(97, 101)]) for _ in range(rng.randint(1, 14))]
        places = licenses.banded(a, b, 0, 30)
        assert len(places) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in places) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:]))  # noqa: RUF007, B905


def test_licenses(frame):
    rng = random.Random(4)
    docs = [*EDGE]
    for i, (_, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = t.split()
        if len(w) > licenses.NOTICE:
            w[rng.randrange(5, len(w))] = "other"
        docs.append((100 + i, "é filler words here.\n" + " ".join(w).upper() + "\nmore filler " * 5))
    got = {r.doc_id: r.licenses for r in licenses.scanned(frame(docs).withColumn("start", F.lit(1))).collect() if r.doc_id is not None and r.doc_id >= 100}
    for i, (name, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        best = got[100 + i][0]
        assert best.template == name and best.start == 21 and best.matched >= 0.8 * best.words, (name, got[100 + i])
    assert licenses.scanned(frame(EDGE)).agg(F.sum("n_licenses")).first()[0] == 0 and licenses.scanned(frame([])).count() == 0
    own = frame([("t1", "alpha beta gamma delta epsilon"), ("t2", "one two three four five six"), (None, "x")], "template_id string, text string")
    one = licenses.scanned(frame([(1, "One, two three four five six; alpha beta gamma delta epsilon")]), own, block_bytes=8).first()
    assert [(x.template, x.start, x.end) for x in one.licenses] == [("t2", 0, 28), ("t1", 30, 60)]


def test_whole_and_short_licenses(frame):
    index = licenses.Index(list(licenses.known()))
    scan = lambda t: [(x[0], x[3], x[4]) for x in next(index.scan([t.encode()], licenses.BAND, licenses.COVERAGE))]
    whole = {k.removeprefix("whole-"): v.decode() for k, v in licenses.known() if k.startswith("whole-")}
    assert {"mit", "isc", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "apache-2.0", "mpl-2.0"} <= set(whole)
    for name, text in whole.items():
        w = text.split()
        w[len(w) // 3] = "other"
        got = scan("Some words before. " + " ".join(w) + " and some after")
        assert len(got) == 1 and got[0][0] == f"whole-{name}" and got[0][2] - 3 <= got[0][1] < got[0][2], (name, got)
    # a template shorter than what winnowing is sure to share is found whatever words stand around it
    rng = random.Random(8)
    words_ = lambda: " ".join(str(rng.randint(0, 999)) for _ in range(6))
    docs = [(i, f"{words_()} All rights reserved. {words_()}") for i in range(60)] + [(99, "all rights are reserved")]
    got = {r.doc_id: [(x.template, x.matched, x.words) for x in r.licenses] for r in licenses.scanned(frame(docs)).collect()}
    assert all(got[i] == [("all-rights-reserved", 3, 3)] for i in range(60)) and got[99] == []


def test_versions_and_variants_are_told_apart():
    index = licenses.Index(list(licenses.known()))
    of = lambda t: [(x[0], x[5]) for x in next(index.scan([t.encode()], licenses.BAND, licenses.COVERAGE))]
    cases = {
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "this work is licensed under the GNU Lesser General Public License, version 3": "lgpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
        "Licensed under CC BY 3.0.": "cc-by-3.0", "Licensed under CC BY-ND 4.0": "cc-by-nd-4.0", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0", "Licensed under CC BY 4.0": "cc-by-4.0",
        "Released under the BSD License.": "bsd-name", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "all-rights-reserved",
    }
    for said, name in cases.items():
        for text in (said, f"Some words stand before. {said} And some after it."):
            assert [x for x, _ in of(text)] == [name], (text, of(text))
    for said in ("Released under the Frobnicate License.", "Licensed under CC BY 5.0", "This work is licensed under the GNU General Public License, version 4."):
        assert of(said) == []
    assert of("This work is licensed under the GNU Lesser General Public License, version 3.") == [("lgpl-3.0", "gpl-3.0")]
    two, three = (dict(licenses.known())[f"whole-bsd-{n}-clause"].decode() for n in (2, 3))
    assert of(two)[0][0] == "whole-bsd-2-clause" and [x for x, _ in of(three)] == ["whole-bsd-3-clause"] and of(three)[0][1] is not None


def test_scan_by_brute_force():
    """Every notice aligned on every diagonal of 200 texts on which it shares a run that it must share finds what the index finds."""
    rng = random.Random(17)
    notices = [(k, v.encode()) for k, v in sorted(licenses.TEMPLATES.items()) if len(v.split()) < 12]
    index = licenses.Index(notices)
    words_ = "the under licensed released license version public by cc 2 3 0 rights reserved all work is gnu general mit plain".split()
    texts = []
    for _ in range(200):
        own = []
        for _ in range(rng.randint(0, 3)):
            said = re.findall(r"[0-9A-Za-z]+", rng.choice(notices)[1].decode())
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                said[rng.randrange(len(said))] = rng.choice(words_)
            own += [rng.choice(words_) for _ in range(rng.randint(0, 5))] + said
        texts.append(" ".join(own))
    some = 0
    for text, got in zip(texts, index.scan([t.encode() for t in texts], licenses.BAND, licenses.COVERAGE), strict=True):
        own = [w.lower() for w in text.split()]
        at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in own])])
        codes, found = np.array([index.ids.get(w.encode(), -1) for w in own]), []
        for t, template in enumerate(index.words):
            lost = len(template) - math.ceil(licenses.COVERAGE * len(template))
            g = min(licenses.GRAM, -(-(len(template) - lost) // (lost + 1)))
            runs = {i - j for i in range(len(own) - g + 1) for j in range(len(template) - g + 1) if (codes[i : i + g] == template[j : j + g]).all()}
            for diagonal in sorted(runs):
                low, high = max(0, diagonal - licenses.BAND), min(len(own), diagonal + len(template) + licenses.BAND)
                pairs = licenses.banded(template, codes[low:high], diagonal - low, licenses.BAND)
                if pairs and len(pairs) >= licenses.COVERAGE * len(template) and set(index.required[t]) <= {i for i, _ in pairs}:
                    x, y = low + pairs[0][1], low + pairs[-1][1]
                    found.append((index.names[t], int(at[x]), int(at[y]) + len(own[y]), len(pairs), len(template), None, 0, 0))
        want = licenses.best_of(found)
        assert [x[:5] for x in got] == [x[:5] for x in want], (text, got, want)
        some += len(want)
    assert some > 100


def test_packing_round_trip(frame):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "Größe", "42", "🙂"]) for _ in range(rng.choice([0, 3, 40, 700, 3000])))) for i in range(60)] + [(900, None), (901, ""), (902, "<|endoftext|>"), (903, "word " * 20_000)]
    pieces = packing.packed(frame(docs).withColumn("start", F.lit(7)).repartition(5)).collect()
    encode, by = packing.encoder("byte_bpe_50k.json"), {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for d, t in docs:
        ids, at = np.array([*encode(t or ""), 0], "<u4"), 0
        for p in sorted(by.pop(d), key=lambda p: p.start):
            own = ids[at : at + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(own.tobytes())) and bytes(p.ids) == own.tobytes()
            at += p.length
        assert at == len(ids)
    assert not by
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two
    assert packing.packed(frame([])).count() == 0


def test_ranks_are_the_tokenizer():
    """Ids are those of the library's tokenizer as the file gives it, strings of its added token in a text included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a, b = packing.encoder("byte_bpe_50k.json"), packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    assert b("<|endoftext|> a") == [50256, 257]
    for t in [t or "" for _, t in EDGE] + ["<|endoftext|> a", "a<|endoftext|><|endoftext|>", "<|endoftext|", "x <|endoftext|>\n\n y  <|ENDOFTEXT|>"]:
        assert plain.encode(t, add_special_tokens=False).ids == a(t) == b(t)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy this now, it is a long advert text that goes on and on</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>&nbsp;text<br>next<p>Second <i>para</i></p><form><p>Subscribe</p></form><aside>Side</aside><section class="comments"><article>A comment</article></section><p it's>odd</p></article><footer>&copy; x</footer></body></html>"""


def test_pages(frame):
    assert html_text.main_lines(html_text.stripped(PAGE)) == ["Title & more", "First bold text", "next", "Second para", "odd"]
    plain = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>" + "A long paragraph of text. " * 6 + "</p><p>" + "Another one follows here. " * 6 + "</p></div><div class='footer'>end</div><p>ok</p></body>"
    assert [x[:9] for x in html_text.main_lines(html_text.stripped(plain))] == ["A long pa", "Another o", "ok"]
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (4, "u", "<div " * 3), (4, "u", "<"), (5, "u", "<p>" * 3000 + "deep")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(frame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[2] == got[3] == ("", 0) and got[None] == ("x", 1) and got[5] == ("deep", 4) and html_text.extracted(frame([], "page_id long, url string, html string")).count() == 0


def test_marks_are_evidence_only():
    of = lambda page: [x[:9] for x in html_text.main_lines(html_text.stripped(page))]
    body = "".join(f"<p>{n} paragraph of the text. " + "It goes on and on. " * 5 + "</p>" for n in ("First", "Second"))
    assert of(f"<body><article class=card><h3>Teaser</h3><p>Read on</p></article><div>{body}</div></body>") == ["First par", "Second pa"]
    links = "<ul>" + "".join(f"<li><a href=/{i}>Another story of the day {i}</a></li>" for i in range(8)) + "</ul>"
    assert of(f"<article><h1><a href=/>The headline</a></h1>{body}{links}<p>About us</p></article>") == ["The headl", "First par", "Second pa"]
    assert of(f"<div>Home</div><article><h1>Headline</h1>{body}</article><div>Imprint</div>") == ["Headline", "First par", "Second pa"]
    assert of("<article><p>x</p></article><div>y</div>") == ["x"]
    assert of(f"<article><h1>Hi</h1><p>By B</p><p>May</p><p>x</p>{body}</article>") == ["Hi", "By B", "May", "x", "First par", "Second pa"]


def test_open_elements_have_no_cap():
    of = lambda page: html_text.main_lines(html_text.stripped(page))
    text = "A long paragraph of the text that is to be kept, whatever stands before it."
    table = "<table>" + "<tr><td>a<td>b<td>c" * 200 + "</table>"
    items = "<ul>" + "<li>item<ul><li>sub</ul>" * 600 + "</ul>" + "<dl>" + "<dt>t<dd>d" * 300 + "</dl>"
    for open_ones in (table, items, "<span>" * 3000, "<section>" * 3000):
        lines = of(f"<article><p>{text}</p>{open_ones}<div class=ad>Buy this advert</div><div>{text}</div><nav>Menu</nav><div hidden>Hidden</div><p>{text}</p></article>")
        assert lines.count(text) == 3 and not {"Buy this advert", "Menu", "Hidden"} & set(lines)
    assert [len(html_text.stripped(x)) for x in (table, items)] == [600, 1800]
    # an end tag that may be left out ends no element around the list or table
    nested = "<ul><li>one<div>in<table><tr><td>cell<ul><li>deep</ul>after<tr><td>next</table>rest</div><li class=ad>ad<li>two</ul>"
    assert [(x.text, x.weight > 0) for x in html_text.stripped(nested)] == [("one", True), ("in", True), ("cell", True), ("deep", True), ("after", True), ("next", True), ("rest", True), ("ad", False), ("two", True)]


def test_names_and_attributes():
    of = lambda page: html_text.main_lines(html_text.stripped(page))
    text = "A long paragraph of the text that is to be kept, whatever stands before it."
    kept = ('title="a hidden gem"', "data-x='hidden class=ad'", 'class="related-work"', 'id="notice-of-appeal"', 'class="social-science"', 'class="menu-planning"', 'alt="role=navigation"')
    for a in kept:
        assert of(f"<article><p>{text}</p><div {a}><p>{text} {a[:5]}</p></div></article>") == [text, f"{text} {a[:5]}"], a
    assert of(f"<article><header class=header><h1>Head</h1></header><div class=entry-header><p>By B</p></div><p>{text}</p></article>") == ["Head", "By B", text]
    gone = ("hidden", "class=ad", 'class="ad-slot-3"', 'class="cookie-banner"', 'id="siteHeader"', 'class="article-comments"', 'class="relatedPosts"', 'class="share-bar"', "role=navigation", 'aria-hidden="true"', 'class="post-sidebar left"')
    for a in gone:
        assert of(f"<article><p>{text}</p><div {a}><p>No {text}</p></div></article><div {a}>No {text}</div>") == [text], a
    assert of(f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be {text}</p></article>") == [f"Let x=2 be {text}"]
    assert of(f"<article><p>One <script>var a='<p>';</script>two <svg><g><path/></g></svg>three <button>Buy</button>{text}</p></article>") == [f"One two three {text}"]
    deep = "<div>" * 2000 + "<nav>Menu</nav>" + f"<article><p>{text}</p></article>"
    assert of(deep) == [text]


def brute_between(length, window, surge):
    """Lines with text from the first window of ``surge`` characters to the next window without any, and so on."""
    kept, i = [], 0
    total = lambda k: sum(length[k : k + window])
    while i < len(length):
        if length[i] and total(i) >= surge:
            while i < len(length) and total(i):
                kept += [i] if length[i] else []
                i += 1
        i += 1
    return kept


def test_surge_and_dive_points():
    rng = random.Random(12)
    some = 0
    for _ in range(400):
        lines = [html_text.Line(str(i) + "x" * 8 * rng.choice([0, 0, 1, 3, 9]), rng.choice([0.0, 0.5, 1.0, 1.0]), False, 0) for i in range(rng.randint(0, 25))]
        length = html_text.lengths(lines)
        want = [lines[i].text for i in brute_between(length, 3, 60)]
        assert html_text.surged(lines, length, 3, 60) == want
        some += 0 < len(want) < sum(n > 0 for n in length)
    assert some > 50  # the windows decide


def brute_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(7)
    for _ in range(3000):
        x = "".join(rng.choice(["a@b.c", "1.2.3", ".4", "255", "256.", "@", "é", "4", "0", " ", "-", "+1 (017) 555-7713", "4111111111111111", ".", "x", "\n", "@@", "-.", "+4"]) for _ in range(rng.randint(0, 14)))
        assert personal.base_spans(x) == brute_spans(x), x


def test_gradient():
    rng = np.random.default_rng(0)
    t = tagger.Tagger({k: v.astype(float) for k, v in tagger.Tagger.new(4, 1).weights.items()})
    codes, tags = rng.integers(0, tagger.SYMBOLS, (3, 7)), rng.integers(0, len(tagger.TAGS), (3, 7))
    grad = t.gradient(codes, tags)[1]
    for k, g in grad.items():
        i = tuple(rng.integers(0, n) for n in g.shape)
        i = (i[0], codes[0, 2], i[2]) if k == "in" else i
        w = t.weights[k]
        w[i] += 1e-5
        up = t.gradient(codes, tags)[0]
        w[i] -= 2e-5
        assert g[i] == pytest.approx((up - t.gradient(codes, tags)[0]) / 2e-5, abs=1e-6)
        w[i] += 1e-5


def test_spelt_out_addresses():
    assert all(personal.regions(f"{'x' * 60} {said} {'y' * 60}") for said in ("jane at example[.]org", "jane.doe at example.com", "jane[at]example.org", "j@x dot de", "1"))
    assert not personal.regions("She looked at home. Then at him, dot by dot")
    model, rng = personal.trained(), random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    for shape in ("%s.%s at %s.com", "%s at %s[.]org", "%s at %s dot org", "%s (at) %s (dot) net"):
        right = 0
        for _ in range(25):
            said, before = shape % tuple(word() for _ in range(shape.count("%s"))), " ".join(personal._word(rng) for _ in range(12)) + " "
            right += ("email", len(before), len(before) + len(said)) in next(personal.all_spans([before + said + " " + personal._word(rng)], model))[1]
        assert right >= 18, (shape, right)


def test_regions_hold_all_that_can_be_accepted():
    rng = random.Random(21)
    bits = ["jane", "doe", " at ", " AT\t", "at", "[at]", "{ @ }", "(at", ".", " dot ", "[.]", "(dot)", " ", "  ", "\n", "@", "com", "x-y", "+1 ", "826", "-", "(5)", "é", "123.4.5.6", "4111111111111111", ","]
    seen = 0
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 16)))
        where = personal.regions(text)
        spans = [m.span() for m in personal._SPELT.finditer(text)]
        for kind in ("ip", "card", "phone"):
            spans += [s[1:] for a in range(len(text)) for z in (a + 3, a + 9, a + 16, len(text)) if z <= len(text) and (s := personal.shaped(text, (kind, a, z)))]
        seen += len(spans)
        for a, z in spans:
            assert any(x <= a and z <= y for x, y in where), (text, text[a:z], where)
    assert seen > 1000


def brute_tags(model, codes):
    """Scores of each window by itself, a weighted mean for each character, and the best path by the book."""
    k, width = len(tagger.TAGS), tagger.WINDOW
    total, weight = np.zeros((len(codes), k)), np.zeros(len(codes))
    for at in range(0, max(1, len(codes) - width + tagger.STRIDE), tagger.STRIDE):
        own = codes[at : at + width]
        e = model.emissions(np.pad(own, (0, width - len(own)))[None])[0][:, 0]
        for i in range(len(own)):
            w = min(i, width - 1 - i) + 1
            total[at + i] += w * e[i]
            weight[at + i] += w
    e = total / weight[:, None]
    best, paths = {t: e[0][t] + model.weights["start"][t] for t in range(k)}, {t: [t] for t in range(k)}
    for row in e[1:]:
        came = {t: max(range(k), key=lambda b, t=t: best[b] + model.weights["change"][b, t]) for t in range(k)}
        best, paths = {t: best[came[t]] + model.weights["change"][came[t], t] + row[t] for t in range(k)}, {t: [*paths[came[t]], t] for t in range(k)}
    return paths[max(best, key=best.get)]


def test_spans_by_brute_force():
    """One best path over all overlapping windows of a stretch, and what is kept of it; texts longer than a window and than several."""
    model, rng = personal.trained(), random.Random(31)
    many = [" ".join(personal._made(rng, rng.choice(personal.KINDS)) if rng.random() < 0.3 else personal._word(rng) for _ in range(n)) for n in (1, 4, 12, 30, 60, 90)] + ["", "no such thing"]
    for text, (base, every) in zip(many, personal.all_spans(many, model), strict=True):
        want = list(personal.base_spans(text))
        assert base == want
        for a, z in personal.regions(text):
            for kind, x, y in tagger.spans_of(np.array(brute_tags(model, tagger.coded(text[a:z])))):
                s = personal.shaped(text, (kind, a + x, a + y))
                if s and all(s[2] <= o[1] or s[1] >= o[2] for o in want):
                    want.append(s)
        assert every == sorted(want, key=personal._rank)
    lone = [tagger.coded(t) for t in many]
    assert [t.tolist() for t in tagger.decode_regions(model, lone, most=50)] == [t.tolist() for t in tagger.decode_regions(model, lone)]


def test_method_adds_and_keeps(frame):
    model = personal.trained()
    text = "Reach me: +1 (826) 555-4081 190.137.223.20 thanks, " + "plain words " * 40 + "and a@b.example.org"
    base, every = next(personal.all_spans([text], model))
    assert set(base) <= set(every) and ("phone", 10, 27) in every and ("phone", 10, 27) not in base
    held = personal.labelled(300, 77)
    found = [set(s) for _, s in personal.all_spans(held[0], model)]
    right = sum(len(f & set(s)) for f, s in zip(found, held[1], strict=True))
    base_right = sum(len(set(personal.base_spans(t)) & set(s)) for t, s in zip(*held, strict=True))
    assert right / sum(map(len, found)) > 0.9 and right > base_right
    got = personal.redacted(frame([(1, text, 3), (2, None, None)], "doc_id long, text string, n_chars long").withColumn("row", F.lit(1)), model).orderBy("doc_id").collect()
    assert "[PHONE] [IP]" in got[0].text and "[EMAIL]" in got[0].text and got[0].n_chars == len(got[0].text) and got[1].text is None
    rows = personal.found(frame(EDGE).withColumn("spans", F.lit(1)), model).collect()
    assert len(rows) == len(EDGE) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)


WRAPPERS = ['<form id="aspnetForm">', *(f'<div class="{c}">' for c in ("text-widget", "widget-text", "section-header", "story-header", "main-header", "social-content", "banner-content", "header-image-article", "alert", "page header")), '<div role="alert">', "<header>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_are_no_furniture(wrapper):
    """A tag or a name never drops a page's whole text; what is furniture beside it goes as before."""
    prose = ["First paragraph of some length, with words enough to be prose.", "Second one, also of a length that counts as text.", "Third."]
    end = "</form>" if "form" in wrapper else "</header>" if wrapper == "<header>" else "</div>"
    of = lambda body: html_text.main_lines(html_text.stripped(f"<body><nav><ul><li><a href=1>Home</a></ul></nav>{body}<div class='ad'>Buy now</div><footer>© someone, all rights reserved and so on</footer>"))
    assert of(f"{wrapper}<div>{''.join(f'<p>{t}</p>' for t in prose)}</div>{end}") == prose
    assert of(f"{wrapper}<p>short</p>{end}") == ["short"]
    # beside a marked article, or beside more text than it holds, it is furniture
    assert of(f"{wrapper}<p>{prose[0]}</p>{end}<article><p>{prose[1]}</p></article>") == prose[1:2]
    if "-" not in wrapper:
        assert of(f"{wrapper}<p>Log in</p>{end}" + "".join(f"<p>{t}</p>" for t in prose)) == prose
    assert of("") == [] and of("<div class='comments'><p>" + prose[0] * 3 + "</p></div>") == []


def test_soft_furniture_against_sums_by_element():
    rng = random.Random(6)
    for _ in range(300):
        lines = []
        for i in range(rng.randrange(12)):
            marks = tuple(sorted(rng.sample([-1, -2, 3], rng.randrange(3))))
            text = "x" * rng.randrange(1, 60)
            lines.append(html_text.Line(f"{i}{text}", 0.0 if marks else 1.0, False, rng.choice([0, 0, len(text)]), rng.choice([0.5, 1.0]), marks))
        plain = [len(x.text) - x.linked for x in lines]
        big = [m for m in (-1, -2) if 2 * sum(n for n, x in zip(plain, lines, strict=True) if m in x.marks) > sum(plain)]
        want = [x.hint if x.marks and all(m in big for m in x.marks) else x.weight for x in lines]
        assert [x.weight for x in html_text.unwrapped(lines)] == want
