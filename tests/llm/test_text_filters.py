import os
import random
import re
import time

import numpy as np
import pytest

from folia.llm import decontamination, html_text, licenses, pii, toxicity

from .conftest import words


def test_chain_on_held_out_rows(spark, make):
    r = random.Random(4)
    bad = ["vile", "awful", "nasty"]
    texts = [(i, " ".join(words(i, 80) + ([r.choice(bad)] * 3 if i % 5 == 0 else []))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(400)] + [(401, None, None)], "doc_id long, quality int, toxic int")
    docs = make(texts)
    chain = toxicity.train(docs, labels)
    got = {x.doc_id: x.rejected for x in toxicity.score(docs, chain).collect()}
    held = [i for i in range(402, 600)]
    assert np.mean([got[i] == (i % 5 == 0) for i in held]) > 0.97
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not v for v in got.values())


def test_chain_without_labels(spark, make, edge_texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make(edge_texts)
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == len(edge_texts) and not any(x.rejected for x in got)


def brute_chain(texts, labels):
    """The chain by its definition, each fit on its own with words counted in Python; log-odds by text number."""
    own = [set(toxicity.distinct_words(t).tolist()) for t in texts]
    fold = [x[0] for x in labels]
    earlier, out = np.zeros((len(texts), 0)), []
    for k in range(len(labels[0][1])):
        y = np.array([np.nan if x[1][k] is None else x[1][k] for x in labels], float)
        column = np.zeros(len(texts))
        for f in range(toxicity.FOLDS + 1):
            use = [i for i in range(len(texts)) if not np.isnan(y[i]) and fold[i] != f]
            n1 = sum(y[i] for i in use)
            count, pos = {}, {}
            for i in use:
                for w in own[i]:
                    count[w] = count.get(w, 0) + 1
                    pos[w] = pos.get(w, 0) + y[i]
            score = {}
            for w, n in count.items():
                cells = [pos[w] + 0.5, n1 - pos[w] + 0.5, n - pos[w] + 0.5, len(use) - n1 - n + pos[w] + 0.5]
                score[w] = abs(np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])) / np.sqrt(sum(1 / c for c in cells))
            words = sorted((w for w in count if count[w] >= toxicity.LEAST_DOCS and score[w] >= toxicity.LEAST_SCORE), key=lambda w: -score[w])[: toxicity.MOST_WORDS]
            at = {w: j for j, w in enumerate(words)}
            place = [(r, at[w]) for r, i in enumerate(use) for w in own[i] if w in at]
            row, col = np.array([p[0] for p in place], int), np.array([p[1] for p in place], int)
            weight, back, bias = toxicity.fit(row, col, len(words), y[use], earlier[use])
            z = np.array([sum(weight[at[w]] for w in own[i] if w in at) for i in range(len(texts))]) + earlier @ back + bias
            if f < toxicity.FOLDS:
                column[[g == f for g in fold]] = np.clip(z, -20, 20)[[g == f for g in fold]]
            else:
                out.append((z, back))
        earlier = np.column_stack((earlier, column))
    return out


def test_chain_equals_its_definition(spark, make):
    r = random.Random(8)
    texts = [(i, " ".join(words(i, 60) + (["vile", "rude"] * 2 if i % 4 == 0 else []) + (["junk"] * (r.randrange(3))))) for i in range(240)]
    labels = [(i, int(i % 3 != 0 if r.random() < 0.9 else i % 3 == 0), int(i % 4 == 0 if r.random() < 0.9 else i % 4 != 0)) for i in range(240)]
    docs = make(texts)
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    folds = {x.i: x.f for x in spark.range(240).selectExpr("id AS i", f"CAST(pmod(xxhash64(id, 'fold'), {toxicity.FOLDS}) AS int) AS f").collect()}
    first, second = brute_chain([t for _, t in texts], [(folds[i], (1 - q, x)) for i, q, x in labels])
    for i, t in texts:
        p = chain.models[0].score(toxicity.distinct_words(t), np.zeros(0))
        assert abs(p - first[0][i]) < 1e-6
    assert np.allclose(chain.models[1].chain, second[1], atol=1e-6) and len(chain.models[1].words) > 0


def test_chain_on_odd_rows(spark, make, edge_texts):
    """String ids, repeated ids with different texts and labels in any order, null ids, very long texts, an empty table."""
    texts = [(f"d{i}", " ".join(words(i, 30) + (["vile"] * 2 if i % 3 == 0 else []))) for i in range(90)] + [("d3", "other text"), (None, "vile vile"), ("long", "vile word " * 40_000)]
    labels = [(f"d{i}", 1, int(i % 3 == 0)) for i in range(90)] + [("d4", 0, None), ("d4", None, None), (None, 1, 1)]
    kind = "doc_id string, text string, p_toxic double", "doc_id string, quality int, toxic int"
    out = []
    for turn in (1, -1):
        docs = spark.createDataFrame([(i, t, 0.0) for i, t in texts[::turn]], kind[0])
        got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels[::turn], kind[1]))).collect()
        assert len(got) == len(texts)
        out.append(sorted((x.doc_id or "", round(x.p_toxic, 9), round(x.p_low_quality, 9)) for x in got))
    assert out[0] == out[1]
    assert dict((i, p) for i, p, _ in out[0])["long"] > 0.5
    none = make([])
    empty = toxicity.train(none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(none, empty).count() == 0 and toxicity.drop_toxic(none, empty).count() == 0


def brute_tiles(a, b, size):
    """Greedy string tiling by its definition."""
    marked_a, marked_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in marked_a and j + k not in marked_b:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < size:
            return total
        marked_a.update(range(i, i + k))
        marked_b.update(range(j, j + k))
        total += k


def test_tiling_covers_reordered_passages(spark, make, edge_texts):
    items = [(0, " ".join(words(500, 40))), (1, " ".join(words(501, 24))), (2, "just three words"), (3, None), (4, "")]
    a, b = items[0][1].split(), items[1][1].split()
    docs = edge_texts + [(60, "Start. " + " ".join(a[20:] + a[:20]).upper() + "! end"), (61, " ".join(b[:10])), (62, "some Just, three-words here"), (63, " ".join(b))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.item_words, x.tiled_words, x.contaminated) for x in decontamination.contamination(make(docs), bench).collect()}
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for (d, i), (n, m, bad) in got.items():
        text = next(t for j, t in docs if j == d)
        own = norm(items[i][1])
        assert n == len(own) and m == brute_tiles(own, norm(text), min(5, n)) and bad == (m >= 0.8 * n)
    assert {k for k, v in got.items() if v[2]} == {(60, 0), (62, 2), (63, 1)}
    kept = decontamination.drop_contaminated(make(docs), bench)
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {60, 62, 63}


def test_tiling_equals_its_definition():
    """Random sequences over few words, so that matches overlap and repeat, against the definition."""
    r = np.random.default_rng(3)
    for turn in range(150):
        a, b = r.integers(1, 3 + turn % 7, 40).astype(np.uint64), r.integers(1, 3 + turn % 7, 90).astype(np.uint64)
        got = decontamination.tiles(a, b, 5)
        assert sum(t[2] for t in got) == brute_tiles(a.tolist(), b.tolist(), 5)
        assert all((a[q : q + n] == b[p : p + n]).all() for p, q, n in got)


def test_tiling_of_repetitive_texts():
    """Time follows the texts, not the pairs of equal seeds."""
    index = decontamination.Index([(0, "same " * 500), (1, "ab cd " * 300)])
    began = time.perf_counter()
    assert decontamination._coverage(index, "same " * 200_000) == [(0, 500, 500)]
    assert decontamination._coverage(index, "ab cd " * 20_000) == [(1, 600, 600)]
    assert time.perf_counter() - began < 5


def test_benchmark_in_blocks(spark, make, monkeypatch):
    items = [(i, " ".join(words(600 + i, 20))) for i in range(20)]
    docs = [(i, "x y z " + t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    got = {(x.doc_id, x.item_id) for x in decontamination.contamination(make(docs), bench).where("contaminated").collect()}
    assert got == {(i, i) for i in range(20)}


def test_surrogates(make):
    texts = [(0, None), (1, ""), (2, "no entity here 4.0 and 12"), (3, "mail été.34@mail7.example.com, call +1 (017) 555-7713 or 233.254.104.120"),
             (4, "again été.34@mail7.example.com! card 9807915762804490"), (5, "Mrs. Smith met Herr Иванов"), (5, "Mrs. Smith met Herr Иванов"),
             (6, '"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" 078-05-1120'), (None, "x@y.org")]
    docs = make(texts)
    got = pii.pseudonymise(docs).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    assert by[0].text is None and by[1].text == "" and by[2].text == texts[2][1] and by[2].n_entities == 0
    mail = re.search(r"\S+@\S+\.com", by[3].text).group()
    assert mail != "été.34@mail7.example.com" and mail in by[4].text and re.fullmatch(r"[a-zß-ö]{3}\.\d\d@[a-z]{4}\d\.example\.com", mail)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[3].text) and "555-7713" not in by[3].text
    octets = re.search(r"(\d+)\.(\d+)\.(\d+)\.(\d+)$", by[3].text).groups()
    assert all(len(o) == 3 and int(o) <= 255 for o in octets)
    assert re.search(r"card \d{16}$", by[4].text) and "9807915762804490" not in by[4].text
    assert re.match(r"Mrs\. [A-Z][a-z]{4} met Herr [А-Я][а-я]{5}$", by[5].text) and "Иванов" not in by[5].text
    assert re.search(r'"[0-9a-f]{40}" \d{3}-\d{2}-\d{4}', by[6].text) and by[6].n_entities == 2


def test_surrogates_stay_distinct(make):
    # Two-digit hosts leave few surrogates, so draws collide.
    texts = [(i, f"a{i % 10}@h{i // 10}.com") for i in range(100)]
    got = [r.text for r in pii.pseudonymise(make(texts)).collect()]
    assert len(set(got)) == 100 and not set(got) & {t for _, t in texts}


def test_spellings_of_an_entity_agree(make):
    texts = [(0, "Mr. Smith"), (1, "Mr Smith"), (2, "Mr. John Smith"), (3, "saw John Smith there"), (4, "Mrs Jane Smith"), (5, "a.b@x.com"), (6, "A.B@X.com"), (7, "+1 (017) 555-7713"), (8, "+1-017-555-7713"),
             (9, "+10175557713"), (10, "743-555-3824"), (11, "1234-5678-9012-3456"), (12, "1234567890123456"), (13, "Dr. Maria Jones"), (14, "Ms. Maria Jones")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(make(texts)).collect()}
    family = got[0].removeprefix("Mr. ")
    assert re.fullmatch("[A-Z][a-z]+", family) and family != "Smith" and got[1] == f"Mr {family}"
    john = got[2].split(" ")[1]
    assert got[2] == f"Mr. {john} {family}" and got[3] == f"saw {john} {family} there" and john in pii.NAMES["m"]
    assert got[4].split(" ")[1] in pii.NAMES["f"] and got[4].endswith(family)
    assert got[6].lower() == got[5] and re.fullmatch(r"[A-Z]\.[A-Z]@[a-z]\.example\.com", got[6])
    digits = {re.sub(r"\D", "", got[i]) for i in (7, 8, 9)}
    assert len(digits) == 1 and digits != {"10175557713"} and got[7].startswith("+1 (") and got[8].startswith("+1-") and re.fullmatch(r"\+1\d{10}", got[9])
    assert re.fullmatch(r"\d{3}-\d{3}-\d{4}", got[10]) and got[10] != texts[10][1]
    assert got[11].replace("-", "") == got[12] != "1234567890123456"
    assert got[13].removeprefix("Dr. ") == got[14].removeprefix("Ms. ") != "Maria Jones"


def test_draws_come_to_an_end(make):
    """More values than surrogates of their length, and scripts whose letters have no alphabet."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [(i, f"{x}@{y}.com") for i, (x, y) in enumerate((x, y) for x in letters for y in letters)] + [(1000, "a@b.net.com"), (1001, "a@c.net.com")]
    texts += [(1100, "Mr. Պետրոս"), (1101, "Mr. Ვახო"), (1102, "ⴰⴱ@ⴰ.com"), (1103, "ⴰⴳ@ⴰ.com")] + [(2000 + i, f"{i // 10}.{i % 10}.1.1") for i in range(100)]
    got = [r.text for r in pii.pseudonymise(make(texts)).collect()]
    assert len(set(got)) == len(texts) and not set(got) & {t for _, t in texts if not t.endswith("Ვახო")}


def brute_matches(text):
    import regex

    return [m.group() for m in regex.finditer(pii.ANY, text or "")]


def test_entities_against_another_matcher(make, edge_texts):
    """Each text is its pieces between matches, with as many replacements, in all columns and rows."""
    import regex

    texts = edge_texts + [(50, "mail a@b.org, " * 3000), (51, "x 1.2.3.4 y"), (51, "x 1.2.3.4 y"), (52, "Mr. Lee and Ann Lee, 555.123.4567; 0123456789abcdef0123456789abcdef")]
    got = pii.pseudonymise(make(texts))
    assert got.columns == [c for c in make(texts).columns if c != "n_entities"] + ["n_entities"]
    rows = got.collect()
    assert len(rows) == len(texts) and pii.pseudonymise(make([])).count() == 0
    left = list(rows)
    for i, t in texts:
        between = regex.split("(?:" + pii.ANY + ")", t) if t is not None else None
        own = next(r for r in left if r.doc_id == i and (r.text is None) == (t is None) and r.n_entities == len(brute_matches(t))
                   and (t is None or regex.fullmatch(r"(?:.+?)".join(map(regex.escape, between)), r.text, regex.S)))
        left.remove(own)
        assert not brute_matches(t) and own.text == t or own.text != t


def test_pii_plan_is_native(make):
    found = pii.pseudonymise(make([(1, "x@y.org")]))._jdf.queryExecution().toString()
    assert "Python" not in found and "Pandas" not in found and "Arrow" not in found


def test_licenses(make):
    mit = licenses.KNOWN["MIT"]
    texts = [(0, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE")), (1, "some text\nLicensed under CC BY-NC 4.0."), (2, None), (3, "nothing"), (4, licenses.KNOWN["ISC"].replace(",", ";"))]
    got = {r.doc_id: (r.license_id, r.n_license_lines, r.license_lines) for r in licenses.licenses(make(texts)).collect()}
    assert got[0][0] == "MIT" and got[1] == (None, 1, "CC-BY-NC-4.0") and got[2] == (None, 0, "") and got[3][0] is None and got[4][0] == "ISC"
    assert licenses.licenses(make([])).count() == 0


def test_licenses_as_published(make):
    isc = "ISC License\n\nCopyright (c) 2020, Some One\n\n" + licenses.KNOWN["ISC"].replace("\n", " ").replace("above copyright", "above\ncopyright")
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + licenses.KNOWN["MIT"]
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + licenses.PUBLISHED["BSD-3-Clause"]
    wide = licenses.KNOWN["MIT"].replace("\n", " ").replace(" ", "   ")
    texts = [(0, isc), (1, mit), (2, bsd), (3, "intro\n" + wide), (4, None), (5, "(c) you may copy"), (6, "you may copy"), (7, "(c) Some One\nyou may copy")]
    got = {r.doc_id: r for r in licenses.licenses(make(texts), published=True).collect()}
    assert [got[i].license_id for i in range(5)] == ["ISC", "MIT", "BSD-3-Clause", None, None]
    assert (got[3].n_license_lines, got[3].license_lines) == (1, "MIT")
    assert got[5].digest != got[6].digest == got[7].digest


def test_spellings_beside_each_other(make):
    """Equal neighbours, repeated rows, a very long text and ids of any kind."""
    texts = [(0, "licence licence sub licence"), (1, "license license sublicense"), (1, "License, license: sublicense!"), (2, "word " * 200_000), (None, "licence")]
    for published in (False, True):
        got = licenses.licenses(make(texts), published).collect()
        assert len(got) == len(texts) and len({r.digest for r in got if r.doc_id in (0, 1)}) == 1


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_whole_published_licenses(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1"}
    texts = {n: open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read() for n in files}
    docs = spark.createDataFrame([(n, t) for n, t in texts.items()] + [(n + "-wrapped", " ".join(t.upper().split(" "))) for n, t in texts.items()], "doc_id string, text string")
    got = {r.doc_id: r.license_id for r in licenses.licenses(docs, published=True).collect()}
    assert all(got[n] == name and got[n + "-wrapped"] in (name, None) for n, name in files.items())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">Buy now, it is a very good offer for all of you today.</div>
<div id="content"><h1>Head &amp; line</h1><p><b>First   paragraph with some words.<br><p>Second one with <a href="x">a link</a> inside of it, and more text.</p><form><input><button>Go</button></form></div>
<aside>related things</aside><div class="comments"><p>I think this is a long comment by a reader of the page.</p></div><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph with some words.\nSecond one with a link inside of it, and more text."
    for odd in (None, "", "<", "<p", "<div", "<a href='x>y", "<!--", "<script>", "</div></p>", "<p>" * 3000):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("plain words") == "plain words"


def paragraphs(word, n):
    return "".join(f"<p>{f'{word}{i} ' * 50}</p>" for i in range(n))


def test_main_text_of_split_sections():
    """Sections in sibling divs and a headline beside them are all of the article; a list of links is not."""
    links = "<div class='list'>" + "".join(f"<a href='/{i}'>entry {i}</a> " for i in range(30)) + "</div>"
    for first in (1, 2, 5):
        for head in ("Head", "Head of all " * 15):
            for around in ("{}", "<div>{}</div>", "<div><div>{}</div></div>"):
                page = "<body>" + around.format(f"<h1>{head}</h1><div>{paragraphs('aa', first)}</div><div>{paragraphs('bb', 6)}</div>") + links + "</body>"
                text = html_text.main_text(page)
                assert text.startswith("Head") and "entry" not in text and text.count("\n") == first + 6
    once = html_text.main_text(f"<body><div><div>{paragraphs('aa', 3)}</div><div>{paragraphs('bb', 3)}</div></div></body>")
    assert once.count("aa1") == 50


def test_main_text_under_layout_names():
    """Layout classes of a wrapper don't take its article out; elements named as menus, comments or sidebars go."""
    for name in ("content with-sidebar", "no-sidebar", "post has-comments", "page header-fixed", "sidebar", "nav-left widget"):
        for tag in ("{}", "<article>{}</article>"):
            text = html_text.main_text(f"<body><div class='{name}'>{tag.format(paragraphs('aa', 4))}</div><div class='site-footer'><p>{'foot ' * 20}</p></div></body>")
            assert text.count("aa3") == 50 and "foot" not in text, name
    page = f"<body><div class='a'>{paragraphs('aa', 4)}</div>" + "".join(f"<div class='x {n}'><p>{'other ' * 40}</p></div>" for n in ("comments", "widget-area", "sidebar", "cookie-notice")) + "</body>"
    assert "other" not in html_text.main_text(page)
    assert "x+1" in html_text.main_text(f"<article><p>{'word ' * 30}<math><mi>x</mi>+<mn>1</mn></math></p></article>")


def test_scan_is_linear():
    """Broken pages of some 100 kB, each of which a backtracking or nested scan would not finish."""
    for page in ("<a" * 50_000, "<div>" * 30_000, "<div>" * 15_000 + "</b>" * 15_000, "<a '>'" * 20_000, "<i><div>" + "<b>" * 9_000 + "</i>" * 9_000, "<div><body>" * 9_000, "</script " * 9_000, "<li>" * 20_000):
        began = time.process_time()
        assert isinstance(html_text.main_text(page), str)
        assert time.process_time() - began < 3, page[:10]
    assert html_text.main_text("<div>" * 2000 + "deep" + "</div>" * 2000) == "deep"


def test_names_are_weighed_with_content():
    page = f"""<body><div id=c><div class="article-header"><h1>The title</h1></div><p class="notice">The notice period is three months.</p><div class="share">{paragraphs('aa', 2)}</div>
    <div class="share"><a href=x>one site</a> <a href=y>another site</a></div>{paragraphs('bb', 5)}<div class="comments"><p>{'opinion ' * 30}</p></div></div></body>"""
    text = html_text.main_text(page)
    assert text.startswith("The title\nThe notice period is three months.\naa0") and "bb4" in text and "another site" not in text and "opinion" not in text


def test_density_is_the_formula():
    """Densities and the core of random trees against the formula, each node counted on its own."""
    r = random.Random(12)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return "".join(r.choice("ab ") for _ in range(r.randrange(60)))
        tag = r.choice(["div", "div", "a", "span", "section"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randrange(1, 4))) + f"</{tag}>"

    for _ in range(60):
        root, pieces = html_text.parse("<body>" + "".join(tree(5) for _ in range(3)) + "</body>")
        nodes = html_text._measure(root, pieces)
        below = {x: [y for y in nodes if y is not x and any(z is x for z in above(y))] for x in nodes}
        chars = lambda x: sum(len("".join(t.split())) for _, t, n in pieces if n is x or n in below[x])  # noqa: E731, B023
        links = lambda x: [y for y in [x, *below[x]] if y.tag == "a" and not any(z.tag == "a" for z in above(y) if z is x or z in below[x])]  # noqa: E731, B023
        body = next(x for x in nodes if x.tag == "body")
        for x in nodes:
            c, t, lc = chars(x), len(below[x]), sum(chars(y) for y in links(x))
            assert (x.chars, x.tags) == (c, t)
            if x.tag == "a" or any(y.tag == "a" for y in below[x]):
                continue
            ratio = body.link_chars / max(1, body.chars)
            base = np.log(lc + ratio * c + np.e)
            want = 0 if not c else c / max(1, t) * np.log(max(c * max(1, t), 1.0)) / (np.log(base) if base > 1 + 1e-9 else 1)
            assert abs(x.density - want) < 1e-9 * max(1, want)
        most = max(sum(y.density for y in x.children) for x in nodes)
        core = html_text.main_nodes(root, pieces)[0]
        assert core.tag in html_text.INLINE or sum(y.density for y in core.children) == most or core is body or any(sum(y.density for y in x.children) == most for x in below[core])


def above(x):
    while x is not None:
        yield x
        x = x.parent


def test_pages_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 3
    assert html_text.extract(pages.limit(0)).count() == 0
