"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftnet.llm import html_text, langid, licences, line_dedup, mixing, packing, quality, simhash, token_counts, topk
from weftnet.llm.common import salted_join

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
TEXTS = [
    (1, "The cat sat on the mat and the dog ran off to it."),
    (2, "The cat sat on the mat and the dog ran off to it."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one"),
    (7, LONG),
    (8, "a b c d e a b c d e a b c d e f\nx\nx\n\nx"),
    (8, "a b c d e a b c d e a b c d e f\nx\nx\n\nx"),
    (None, "Ünïcode wörds «ok» — 日本語 ½ # $ %"),
    (9, "The cat sat on the mat and the dog ran off to it now."),
]


def documents(spark, rows=TEXTS):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, score double"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", 0.5) for i, t in rows], schema)


def words(text):
    return re.findall(WORD, text or "")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# 1


def test_quality_measures(spark):
    df = quality.measures(documents(spark), ["doc_id"])
    want = []
    for i, t in TEXTS:
        w = words(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)))
    assert rows_of(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want, key=str)


def test_quality_verdict(spark):
    clean = "the cat and the dog went to a house in the town that was built for them by people with money and it is on the hill. "
    function = "the and to a in that was for by with it is on".split()
    prose = [" ".join(f"{w}{'' if w in function else (i * 7 + j) % 89}" for j, w in enumerate((clean * 6).split())) for i in range(30)]
    junk = [" ".join(f"{'QWERTY'[k % 6:]}{k * 31 % 997}!!" for k in range(n, n + 150)) for n in (0, 400)]
    signs = [" ".join(f"fox{k}$$$ ***" for k in range(100))]
    rows = list(enumerate(prose + junk + signs))
    out = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    assert all(out[i].kept for i in range(30))
    assert not any(out[i].kept or out[i].base_failed for i in (30, 31, 32))
    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    x, y = np.array(p) / 4, np.array(q) / 4
    m = (x + y) / 2
    want = np.sqrt(sum(v * np.log2(v / w) for a in (x, y) for v, w in zip(a, m, strict=True) if v) / 2)
    got = spark.range(1).select(quality.hist_js(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]
    assert abs(got - want) < 1e-12
    assert quality.judge(documents(spark, [])).count() == 0
    assert all(r.kept is False for r in quality.judge(documents(spark, [(1, None), (2, "")])).collect())


def test_quality_of_other_scripts(spark):
    rnd = np.random.default_rng(8)
    cyrillic = "и в не на что он с как это по но из у за от так его для вы ты дом река город книга окно дерево слово время".split()
    english = "the of and to in is that it for was on are house river town book window tree word time people water stone road".split()
    han = list("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可")
    rows = []
    for i in range(40):
        rows.append((3 * i, " ".join(rnd.choice(cyrillic, 200)) + ".", "ru"))
        rows.append((3 * i + 1, "".join(rnd.choice(han, 900)) + "。 " + " ".join("".join(rnd.choice(han, 4)) for _ in range(20)), "zh"))
        rows.append((3 * i + 2, " ".join(rnd.choice(english, 200)) + ".", "en"))
    rows += [(200, " ".join(f"ЩЪЬ{i}!!Ж" for i in range(200)), "ru"), (201, " ".join(f"★☆{i}§§¤¤¤" for i in range(200)), "zh"), (202, " ".join(f"zq{'x' * (i % 7)}{i}k" for i in range(200)), None)]
    schema = "doc_id long, text string, lang string, word_hist string"
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(*r, "other") for r in rows], schema)).collect()}
    assert all(out[i].kept and out[i].ref_lang == lang for i, _, lang in rows[:120])
    assert not any(out[i].kept or out[i].base_failed for i in (200, 201, 202))
    found = dict(quality.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert {"и", "не", "the", "of", "的", "了"} <= set(found) and "щъь" not in found

    # the histograms against counts by another library
    regex = pytest.importorskip("regex")
    texts = [t for _, t, _ in rows[:6]] + ["", "Äpfel, ÉTÉ école e\u0301 ½ 12 ٣ Ωmega שלום مرحبا नमस्ते ไทย 한국 かな カナ 漢字 😀 «x» <b> ქართული", "THE the THE of"]
    known = sorted(found.items())
    spaced = r"[\p{L}\p{M}--[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]]+"
    measured = quality.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"], "text", known).collect()
    assert len(measured) == len(texts)
    for r in measured:
        t = texts[r.doc_id]
        letters = [c for c in t if regex.match(r"\p{L}", c) and not regex.match(r"\p{Lu}|[a-z]", c)]
        scripts = [sum(bool(regex.match(rf"\p{{{name}}}", c)) for c in letters) for name in quality.SCRIPTS]
        marks = [c for c in t if (c < "\x80" and regex.match(r"[\p{P}`^~=_]", c) or c >= "\x80" and regex.match(r"\p{P}", c)) and not re.match(quality.SYMBOLS, c)]
        want = [len(re.findall(r"[\x20\x09-\x0D]", t)), len(re.findall(quality.SYMBOLS, t)), len(regex.findall(r"\p{Lu}", t)), len(regex.findall(r"\p{Nd}", t)), len(marks)]
        want += [*scripts, len(letters) - sum(scripts), len(regex.findall(r"\p{M}", t)), len(re.findall("[a-z]", t))]
        assert r.char_hist[: len(want)] == want and sum(r.char_hist) == len(t), (t, r.char_hist, want)
        n = Counter(regex.findall(spaced + r"|\p{L}", t.lower(), flags=regex.V1))
        pairs = [(i, n[w]) for i, (w, _) in enumerate(known, 1) if n[w]]
        rest = sum(n.values()) - sum(k for _, k in pairs)
        assert [tuple(e) for e in r.word_hist] == pairs + ([(len(known) + 1, rest)] if rest else [])


# 2

PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div id="cookie-notice">We use cookies on this site.</div><div class="wrap-7"><aside class="sidebar">More</aside>
<div class="post-content p12"><h1>A &amp; B &#169;</h1><p>First   <b>part</b>
 of it, with words enough to be the text of a page.<p>Second&nbsp;part, &lt;not a tag&gt; and a < b.<ul><li>one<li>two</ul><script>var x="<p>no</p>";</script>
<form>Search <input></form><div class="ad">Buy this</div><!-- note --></div><div class="comments"><p>I like this text very much, thank you, it is good.</p></div></div><footer>&copy; us</footer></body></html>"""
PAGE_TEXT = "A & B ©\nFirst part of it, with words enough to be the text of a page.\nSecond part, <not a tag> and a < b.\none\ntwo"


def test_html_frames():
    """Forms and layout names around the article don't drop it; forms to fill in and boilerplate inside them go."""
    prose = "<p>" + "Some words of the article, and more. " * 5 + "</p>"
    want = " ".join(("Some words of the article, and more. " * 5).split())
    search = "<form class='search-form'><input name=q><label>Find it</label></form>"
    for page in (
        f"<body><form id='aspnetForm' action='/x'><div class='menu'>Menu</div><article><h1>Title</h1>{prose}</article><div class='sidebar'>Side</div></form></body>",
        f"<body><FORM><main><h1>Title</h1>{prose}</main><div class='comments'><p>A comment.</p></div></FORM></body>",
        f"<body><div class='content-with-sidebar'><h1>Title</h1>{prose}</div><div class='sidebar'>Side</div></body>",
        f"<body><div class='page'><h1>Title</h1>{prose}</div>{search}<form><p>Subscribe to our letter, please. Do it now.</p></form></body>",
    ):
        assert html_text.page_text(page, None) == "Title\n" + want, page
    assert html_text.page_text("<form><p>Only a form to fill in.</p></form>", None) == ""
    assert not html_text.marks_boilerplate("content-with-sidebar") and html_text.marks_boilerplate("ad-visible-banner") and html_text.marks_boilerplate("page-sidebar")
    many = "<form>" * 20_000
    assert html_text.page_text(many, None) == ""


def test_html_pages(spark):
    other = "<html><body><div class='wrap-9'><div class='post-content p3'>Short.</div><div class='teaser'>" + "A long teaser of another article, with commas, and stops. " * 9 + "</div></div></body></html>"
    rows = [(1, "http://www.a.com/1", PAGE), (2, "https://A.com:80/2", PAGE.replace("p12", "p77")), (2, "https://A.com:80/2", PAGE.replace("p12", "p77")), (3, "http://u@a.com/x", other), (4, "http://b.com", None), (5, None, ""), (6, "http://c.com", "plain text & <b>more</b>"), (7, "x", "<p>un<b>closed <i>tags</p> <div>and</div> </section>stray")]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert out[1].text == out[2].text == PAGE_TEXT and out[1].n_chars == len(PAGE_TEXT)
    assert out[3].text == "Short."  # its own best container is the teaser; its host's pages agree on another path
    assert html_text.page_text(other, None) == "Short."
    assert out[4].text == out[5].text == "" and out[6].text == "plain text & more"
    assert out[7].text.split("\n") == ["unclosed tags", "and", "stray"]
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(pages.limit(0)).count() == 0


def test_names_of_elements():
    for name in ("post-share", "article-ad", "entry-related", "content-newsletter", "post-footer", "share-buttons", "relatedPosts", "ad-728x90", "cookie-notice", "comments", "site-nav"):
        assert html_text.marks_boilerplate(name), name
    for name in ("has-sidebar", "share-enabled", "no-comments", "notice-of-meeting", "content", "post", "advance", "tags", "social-history", "[&>p]:mt-4", "adventure", ""):
        assert not html_text.marks_boilerplate(name), name


def random_page(rnd):
    """A page of a random layout, made of blocks that say what they are: the page, and the text that is its article's."""
    import random

    rnd = random.Random(int(rnd.integers(1 << 30)))
    words = lambda tag, n: " ".join(f"{tag}{rnd.randrange(10_000)}" for _ in range(n))
    body, want = [], []

    def add(form, n, linked=False):
        text = words("good", n)
        want.append(text)
        body.append(form.format(f'<a href="/x?a=1&b=2">{text}</a>' if linked else text))

    add("<h1>{}</h1>", 6)
    add('<p class="lead">{}</p>', 20)
    inner = rnd.random() < 0.5
    body.append('<div class="text">' if inner else "")
    for _ in range(rnd.randint(3, 9)):
        kind = rnd.randrange(6)
        if kind == 0:
            add("<p>{}</p>", 8, linked=True)
        elif kind == 1:
            add('<h2 id="notice-of-meeting">{}</h2>', 4)
        elif kind == 2:
            items = [words("good", 5) for _ in range(3)]
            want.extend(items)
            body.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
        else:
            add("<p>{}", rnd.randint(15, 60))
        if rnd.random() < 0.4:
            name = rnd.choice(["post-share", "article-ad", "entry-related", "content-newsletter", "ad", "comment-list"])
            body.append(f'<div class="{name}"><p>{words("bad", 12)}</p></div>')
        if rnd.random() < 0.2:
            body.append(f"<form>{words('bad', 3)}<input></form><script>var s='<p>{words('bad', 3)}</p>';</script><aside>{words('bad', 9)}</aside>")
    body.append("</div>" if inner else "")
    outer = rnd.choice(["<article>{}</article>", '<main class="[&>p]:mt-4">{}</main>', '<div class="post has-sidebar">{}</div>', '<article class="post share-enabled">{}</article>', "<main><article>{}</article></main>"])
    site = f"<header><h2>{words('bad', 3)}</h2></header><nav><ul><li><a href=/>{words('bad', 2)}</a></ul></nav><div id='cookie-notice'>{words('bad', 8)}</div>"
    end = f"<section class='comments'><p>{words('bad', 30)}</p></section><footer>{words('bad', 5)}</footer>"
    return f"<!doctype html><html><head><title>{words('bad', 5)}</title></head><body class='has-sidebar'>{site}<div class='wrap'>{outer.format(''.join(body))}</div>{end}</body></html>", "\n".join(want)


def test_generated_pages(spark):
    """Each block of many random pages is either in the text or not, as it was made, alone and with its host's other pages."""
    rnd = np.random.default_rng(12)
    pages = [random_page(rnd) for _ in range(400)]
    for source, want in pages:
        assert html_text.page_text(source, None) == want
    rows = [(i, f"http://h{i % 7}.org/{i}", source) for i, (source, _) in enumerate(pages)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = sum(out[i] == want for i, (_, want) in enumerate(pages))
    assert right == len(pages)


def test_pages_to_paths(spark, monkeypatch):
    """Pages give the same where there are too many hosts to send their paths to the pages."""
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", random_page(np.random.default_rng(i))[0]) for i in range(30)], "page_id long, url string, html string")
    want = sorted(map(tuple, html_text.extract(pages).collect()))
    monkeypatch.setattr(html_text, "FEW_HOSTS", 0)
    assert sorted(map(tuple, html_text.extract(pages).collect())) == want


def test_salted_join(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)], "k string, v long")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "k string, w long")
    out = salted_join(rows, small, "k", F.col("v"))
    assert out.count() == 3000 and {(r.k, r.w) for r in out.filter("w is not null").collect()} == {("hot", 1), ("k3", 2)}


# 3


def naive_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    out = simhash.near_duplicates(documents(spark))
    assert rows_of(out, "doc_id", "fingerprint") == sorted(((i, f"{naive_fingerprint(t):016x}") for i, t in TEXTS), key=str)
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got[2] == 1 and got[4] == got[5] == 3 and got[8] == 8 and got[None] is None
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert {r.doc_id for r in simhash.keep_one(documents(spark)).collect()} >= {1, 3, 6, 7, 8, None}
    assert simhash.keep_one(documents(spark)).groupBy("doc_id").count().filter("count > 1").count() == 0


def components(values, bits=4):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(find(i), set()).add(v)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("block,groups", [(2048, 6), (8, 6), (16, 7), (2048, 8)])
def test_links_connect_all(spark, block, groups):
    rnd = np.random.default_rng(3)
    values = {int(x) for x in rnd.integers(0, 1 << 63, 60, dtype=np.uint64)} | {0, (1 << 64) - 1}
    for v in list(values)[:25]:
        for _ in range(8):
            x = v
            for b in rnd.choice(64, int(rnd.integers(1, 7)), replace=False).tolist():
                x ^= 1 << b
            values.add(x)
            v = x if rnd.random() < 0.5 else v
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = simhash.links(fps, block=block, groups=groups)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    named = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(found).collect()}
    got = {}
    for v in values:
        got.setdefault(named.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == components(values)


# 4


def test_top_k(spark):
    rnd = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(rnd.normal(0, 0.2, (120, 6)))]
    vectors += [(50, vectors[50][1]), (50, vectors[50][1]), (100, vectors[3][1]), (200, vectors[7][1]), (201, vectors[7][1]), (300, None), (301, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.1] * 6), (304, [0.5, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    out = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, block_rows=64, chunk_rows=2)
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, np.pad(v, (0, 6 - len(v)))) for i, v in whole]
    want = []
    for at, (q, v) in enumerate(whole):
        best = sorted((-int(v @ x), i) for j, (i, x) in enumerate(whole) if j != at)[:5] if q % 50 == 0 else []
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert rows_of(out, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


# 5


def test_licences(spark):
    mit = "The MIT License\n\n" + ". ".join(licences.SENTENCES[x][0] for x in ("mit-grant", "mit-notice", "no-warranty")).title() + "."
    rows = [(1, mit), (2, "Text.\nLicensed under the Apache License, Version 2.0.\nMore."), (3, "No licence, all wrongs reserved."), (4, None), (5, "All rights reserved.\nReleased under the MIT License."), (6, "licensed  under THE apache license -- version 2.0!")]
    out = {r.doc_id: r for r in licences.recognise(documents(spark, rows)).collect()}
    assert {i: r.licence for i, r in out.items() if r.licence} == {1: "MIT", 2: "Apache-2.0", 5: "MIT", 6: "Apache-2.0"}
    assert out[1].rule == "mit-grant mit-notice no-warranty" and out[5].sentences == "all-rights mit-named"
    assert licences.recognise(documents(spark, [])).count() == 0


# 6


def test_token_counts(spark, tmp_path):
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = P.path(name)
        rows = [*TEXTS, (20, "a <|endoftext|> b"), (21, "x" * 3000)]
        docs = documents(spark, rows)
        out = token_counts.count_tokens(docs, path, str(tmp_path / name))
        if name.endswith(".json"):
            t = tokenizers.Tokenizer.from_file(path)
            n = lambda s: len(t.encode(s, add_special_tokens=False))
        else:
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            n = lambda s: len(m.encode(s))
        want = sorted(((i, len((t or "").encode()), n(t or "")) for i, t in rows), key=str)
        assert rows_of(out, "doc_id", "n_bytes", "n_tokens") == want and "_key" in out.columns
        stored = spark.read.parquet(str(tmp_path / name))
        assert stored.count() == len({t or "" for _, t in rows})
        again = token_counts.count_tokens(docs.unionByName(documents(spark, [(30, "new text")])), path, str(tmp_path / name))
        assert again.count() == len(rows) + 1 and spark.read.parquet(str(tmp_path / name)).count() == stored.count() + 1
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0


# 7


def naive_targets(sizes, total=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = total * sum(sizes.values()), set(order), {}
    while free:
        per = left / sum(weight[s] for s in free)
        over = [s for s in free if per * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: per * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rnd.integers(0, 60))), [None, "é", "b", "a", "z", "empty"][int(rnd.integers(0, 5)) if i % 3 else 2]) for i in range(600)]
    rows += [(600, None, "empty"), (601, "", "empty"), (5, rows[5][1], rows[5][2]), (None, "w w", "a")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size long, _source string")
    out = mixing.copies(docs, mixing.n_words(F.col("text")), [F.col("doc_id")]).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = naive_targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] == len(words(r.text)) and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.copies <= int(rate) + (rate > int(rate))
    for s in sizes:
        taken = sum(r.copies * r["size"] for r in out if r.source == s)
        assert abs(taken - target[s]) <= 60
    again = mixing.copies(docs.repartition(7), mixing.n_words(F.col("text")), [F.col("doc_id")]).collect()
    assert sorted((str(r.doc_id), r.copies) for r in again) == sorted((str(r.doc_id), r.copies) for r in out)
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r.copies for r in out) and mixed.columns == [*docs.columns, "copy"]
    assert mixing.copies(docs.limit(0), mixing.n_words(F.col("text")), [F.col("doc_id")]).count() == 0


def test_inclusion_rates(spark):
    """Over many offsets each document is taken as often as its source's rate says, large ones included."""
    sizes = [1, 2, 3, 5, 8, 400, 90, 7, 7, 7, 30, 2]
    docs = spark.createDataFrame([(i, n, "a" if i % 3 else "b") for i, n in enumerate(sizes)], "doc_id long, n long, source string")
    seeds, taken, rates = 200, Counter(), {}
    rows = docs.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("source", F.concat_ws("-", "source", "seed"))
    for r in mixing.copies(rows, F.col("n"), [F.col("doc_id"), F.col("seed")], weights=(1,), total=0.7).collect():
        rates[r.doc_id] = r.target / r.source_size
        assert int(rates[r.doc_id]) <= r.copies <= int(rates[r.doc_id]) + 1
        taken[r.doc_id] += r.copies
    for i, rate in rates.items():
        assert abs(taken[i] / seeds - rate) < 4 * max(rate * (1 - rate), 0.02) ** 0.5 / seeds**0.5, (i, taken[i] / seeds, rate)


# 8


def naive_phrases(text, known):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in known:
            k += 1
        n, i = n + 1, i + k
    return n


def test_cross_parsing(monkeypatch):
    rnd = np.random.default_rng(1)
    letters = {"aa": "abcd", "bb": "abcdefghijk", "zh": "".join(chr(c) for c in range(0x4E00, 0x4E00 + 900)), "ru": "".join(chr(c) for c in range(0x430, 0x450))}
    write = lambda own, n: "".join(own[int(x)] if x >= 0 else " " for x in rnd.integers(-1, len(own), n))
    sample = {name: write(own, 700) for name, own in letters.items()}
    learned = langid.Languages(sample)
    texts = [learned.codes(write(own, n)) for own in letters.values() for n in (0, 1, 7, 300, 63)] + [learned.codes(sample["aa"][20:120]), learned.codes("9 \u0e01!")]
    text_of = lambda codes: "".join(chr(100 + int(c)) for c in codes)
    want = [[naive_phrases(text_of(t), text_of(learned.codes(sample[name]))) for name in learned.names] for t in texts]
    assert learned.names == sorted(sample)
    for few in (0, 48, 10_000):  # all at once, as it is, and one by one
        monkeypatch.setattr(langid, "FEW", few)
        assert learned.phrases(texts).tolist() == want
    assert learned.phrases([]).shape == (0, 4) and langid.Languages({}).phrases([texts[3]]).shape == (1, 0)


def test_scripts(spark):
    """Languages of many letters, each in a script of its own, are told apart."""
    rnd = np.random.default_rng(7)
    scripts = [range(0x61, 0x7B), range(0x430, 0x451), range(0x3B1, 0x3CA), range(0x5D0, 0x5EB), range(0x4E00, 0x4E00 + 1500), range(0x6000, 0x6000 + 1500), range(0x61, 0x75)]
    words = [["".join(chr(int(c)) for c in rnd.choice(list(own), int(rnd.integers(1, 7)))) for _ in range(400)] for own in scripts]
    rows = [(7 * i + k, " ".join(rnd.choice(words[k], 60)), f"l{k}") for i in range(30) for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang == r.lang_pred for r in langid.identify(docs, langid.learn(docs), ["doc_id", "lang"]).collect())


def test_more_letters_than_sixteen_bits():
    """Letters of samples are told apart however many there are."""
    letters = [chr(c) for c in range(0x3400, 0x32000) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    assert len(letters) > 0x10000
    last = letters[-40:]
    learned = langid.Languages({"a": "".join(letters[:-40]), "b": "".join(last)})
    assert learned.alphabet == len(letters) + 2 and len(set(learned.codes("".join(last)).tolist())) == 40
    assert learned.phrases([learned.codes("".join(last))]).tolist() == [[40, 1]]


def test_language_id(spark):
    samples = {"en": "the quick brown fox jumps over the lazy dog while they think about things ", "de": "der schnelle braune fuchs springt über den faulen hund und sie denken nach ", "fr": "le renard brun rapide saute par dessus le chien paresseux et ils pensent "}
    rnd = np.random.default_rng(4)
    rows = [(i, " ".join(rnd.permutation(samples[lang].split())), lang) for i in range(90) for lang in [list(samples)[i % 3]]]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !?", "de"), (203, "fuchs und hund", None), (203, "fuchs und hund", None), (None, "the dog and the fox", "en"), (204, "fox dog " * 20_000, "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    learned = langid.learn(docs)
    out = langid.identify(docs, learned, ["doc_id", "lang"]).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r for r in out}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202)) and got[203].lang_pred == "de" and got[204].lang_pred == "en"
    assert all(got[i].lang_pred == got[i].lang for i in range(90))
    ids = [i for i, _, _ in rows if i is not None]
    marked = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(marked[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in ids) and marked[None] is False
    texts = {r.text for r in docs.collect()}
    sample = langid.labelled_sample(docs, docs_per_language=4, chars=120)
    assert set(sample) == set(samples) and all(0 < len(t.split("\n")) <= 4 and set(t.split("\n")) <= texts for t in sample.values())
    assert all(len(t.split("\n")) == 1 for t in langid.labelled_sample(docs, total_chars=10).values())
    assert langid.identify(docs.limit(0), learned, ["doc_id"]).count() == 0
    nothing = langid.learn(docs.filter("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


# 9


def naive_dedup(rows):
    """Windows and blocks by trying each; the first place of each block; extension line by line."""
    order = sorted({(i is None, i or 0, (t or ""), t is None) for i, t in rows})
    first, out = {}, {}
    for none, i, t, null in order:
        if null:
            continue
        lines = [" ".join(x.split()) for x in t.split("\n")]
        counts = [len(x.split()) for x in lines]
        reach = lambda a, n: next((e for e in range(a + 1, len(lines) + 1) if sum(counts[a:e]) >= n), None)  # noqa: B023, E731
        ends = [reach(a, 10) for a in range(len(lines))]
        chosen = set()
        for a in range(len(lines)):
            e = reach(a, 25) or (len(lines) if a == 0 else None)
            if e is None:
                break
            inside = [b for b in range(a, e) if ends[b] is not None and ends[b] <= e]
            if inside:
                code = lambda b: xxhash.xxh64_intdigest(struct.pack(f"<{ends[b] - b}Q", *[xxhash.xxh64_intdigest(x.encode(), 9) for x in lines[b : ends[b]]]))  # noqa: B023, E731
                chosen.add(min(inside, key=lambda b: (code(b), -b)))
        gone = set()
        for b in sorted(chosen):
            block = tuple(lines[b : ends[b]])
            for key in [block, *([(lines[b - 1], block, 1)] if b else []), *([(block, lines[ends[b]], 2)] if ends[b] < len(lines) else [])]:
                if key not in first:
                    first[key] = (lines, b)
                    continue
                other, q = first[key]
                lo, hi = 0, 0
                while b - lo > 0 and q - lo > 0 and lines[b - lo - 1] == other[q - lo - 1]:
                    lo += 1
                while b + hi < len(lines) and q + hi < len(other) and lines[b + hi] == other[q + hi]:
                    hi += 1
                gone.update(range(b - lo, b + hi))
        out[None if none else i, t] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def test_line_dedup(spark):
    rnd = np.random.default_rng(6)
    pool = [" ".join(f"v{x}" for x in rnd.integers(0, 5000, n)) for n in (3, 8, 12, 25, 60, 7, 9, 30, 0, 15)]
    rows = []
    for i in range(60):
        lines = [pool[k] if rnd.random() < 0.5 else f"own {i} {k} " + "z " * int(rnd.integers(0, 30)) for k in rnd.integers(0, len(pool), int(rnd.integers(1, 12)))]
        if i % 4 == 0:
            at = int(rnd.integers(0, len(lines) + 1))
            lines[at:at] = [pool[1], pool[6], pool[2], pool[5], pool[1], pool[9], pool[3]]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "\n" * 500), (104, (pool[4] + "\n") * 40), (5, rows[5][1]), (None, rows[4][1])]
    out = line_dedup.dedup_lines(documents(spark, rows)).collect()
    want = naive_dedup(rows)
    assert len(out) == len(rows)
    source = Counter(rows)
    for r in out:
        if r.doc_id == 100:
            assert r.text is None and r.n_lines == 0 and r.n_removed == 0
    got = Counter((r.doc_id, r.text) for r in out if r.text is not None)
    assert got == Counter({k: v for k, v in Counter((i, want[i, t]) for (i, t), n in source.items() if t is not None for _ in range(n)).items()})
    assert {r.text for r in out if r.doc_id == 102} == {""}
    assert [r.n_removed for r in out if r.doc_id == 104][0] in (39, 40, 41)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# 10


def test_run_with_other_neighbours(spark):
    """The first text with a block has other lines around it; a later text that repeats a whole run loses all of it.

    Runs of 25 words or more are found for certain (x has 26, the others 12); runs under 10 never go by themselves.
    """
    line = lambda name: " ".join(f"{name}{k}" for k in range(26 if name == "x" else 12))
    rows = [(1, "\n".join(map(line, "axb"))), (2, "\n".join(map(line, "cxd"))), (3, "\n".join(map(line, "ecxdf")))]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert out[1] == rows[0][1] and "x0" not in out[2] and not {"c0", "x0", "d0"} & set(out[3].split()) and {"e0", "f0"} <= set(out[3].split())
    for n in (9, 25, 26, 40):
        run = " ".join(f"r{k}" for k in range(n))
        texts = [(i, f"{run}\n{' '.join(f'own{i}x{k}' for k in range(30))}") for i in range(12)]
        kept = [r.doc_id for r in line_dedup.dedup_lines(documents(spark, texts)).collect() if "r0" in r.text]
        assert sorted(kept) == (list(range(12)) if n < 10 else [0])


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rows = [*TEXTS, (20, "it's <|endoftext|> HERE"), (21, "İstanbul é ﬁ x́ \x1c \x85 y")]
    pieces = packing.cut_into_pieces(documents(spark, rows), path)
    want = []
    for i, s in rows:
        ids = [*t.encode(s or "", add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(struct.pack(f"<{len(ids[a : a + 2048])}I", *ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
    assert rows_of(pieces, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    encoder = packing.WordIds(path)
    assert encoder.by_word
    for s in ("don't CAN'T 's''s", "a\xa0b½²3 ÀÿŸ€", "", "x" * 5000, "'tis", "１２ ３"):
        assert encoder.encode([s])[0] == encoder.whole(s)
    rnd = np.random.default_rng(8)
    lengths = [int(x) for x in rnd.integers(1, 2049, 3000)] + [2048] * 5 + [1] * 50
    many = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    for task_pieces in (100_000, 500):
        out = packing.pack(many, task_pieces=task_pieces).collect()
        assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(lengths))
        bins = {}
        for r in out:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(bins) <= 1.05 * sum(lengths) / 2048
    assert packing.pack(many.limit(0)).count() == 0
    # with many pieces to an open bin, levels lose little against one task; with few, no sequence but those of the last tasks is half empty
    small = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rnd.integers(1, 900, 8000))], "doc_id long, length long")
    fills = [[r["n"] for r in packing.pack(small, open_bins=b, task_pieces=n).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()] for b, n in ((32, 100_000), (32, 1000), (8, 12))]
    assert len(fills[1]) <= 1.01 * len(fills[0])
    assert all(sum(x <= 1024 for x in own) <= 1 + 8000 // 12 // 16 for own in fills) and len(fills[2]) <= 2 * sum(fills[2]) / 2048 + 42
    named = spark.createDataFrame([("a", "one two", 1), (None, None, 2), ("a", "one two", 1)], "doc_id string, text string, more int")
    assert sorted((r.doc_id or "", r.length) for r in packing.cut_into_pieces(named, path).collect()) == [("", 1), ("a", 3), ("a", 3)]


def test_word_memory(monkeypatch):
    """Ids are the library's however few words a worker keeps."""
    path = P.path("word_bpe_49k.json")
    texts = [" ".join(f"w{i}x{k % 7}" for k in range(50)) for i in range(40)]
    for most in (0, 5, 60, 10_000):
        monkeypatch.setattr(packing, "CACHE_WORDS", most)
        encoder = packing.WordIds(path)
        for at in range(0, 40, 4):
            assert encoder.encode(texts[at : at + 4]) == [encoder.whole(t) for t in texts[at : at + 4]]
            assert len(encoder.ids) <= most


def test_open_bins():
    packer = packing.BestFit(10, 2)
    assert [packer.put(n) for n in (6, 7, 3, 9, 4, 1)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 9)]
    packer = packing.BestFit(10, 2)
    for n in (6, 7, 8):
        packer.put(n)  # no room for 8 in two bins: the fullest, of 7, is closed
    assert packer.put(3) == (0, 6) and packer.put(2) == (2, 8)
