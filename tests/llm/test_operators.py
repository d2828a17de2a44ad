"""Training-data operators against brute force, round trips and edge rows."""

import hashlib
import html
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.llm import common, decontaminate, embeddings, html_text, langid, licenses, packing, secrets, simhash, token_records, warc
from zonepulse.llm.tokens import Encoder

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_TEXTS = [None, "", " ", "\n", "a", "a  b", " a ", "It's WE'LL 12 345...", "x\ty\x0bz", "日本語 テキスト", "foó ́bar ΑΣ", "<|endoftext|> x", "a\xa0b", "😀 a😀b", "same", "same", "q" * 5000]


def docs_of(spark, texts, extra=True):
    rows = [(k, t, "en", 1, 2, 3) for k, t in enumerate(texts)]
    # extra columns whose names clash with those the operators use inside
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, fp int, piece int")
    return df if extra else df.select("doc_id", "text", "lang")


def groups(n, links):
    label = list(range(n))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(k) for k in range(n)]


def variants(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return " ".join(words)


def corpus(rng, n=60):
    base = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 120))) for _ in range(n // 3)]
    return [variants(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(n)] + base[:5]


# common


def test_connected_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 260)]
    want = groups(300, links)
    got = dict(map(tuple, common.connected_components(spark.createDataFrame([(None, 3), *links], "a long, b long")).collect()))
    assert got == {k: want[k] for ab in links if ab[0] != ab[1] for k in ab}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 language ID


def language_texts(rng, lang, n):
    sounds = {"aa": ["ba", "na", "ra", "lo"], "bb": ["sch", "eit", "ung", "zu"], "cc": ["tion", "eau", "que", "re"]}[lang]
    return [" ".join("".join(rng.choices(sounds, k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))).capitalize() + "." for _ in range(n)]


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(t, lang) for lang in ("aa", "bb", "cc") for t in language_texts(rng, lang, 60)]
    rng.shuffle(rows)
    odd = [(None, "aa"), ("", "bb"), ("123 !!", "cc"), ("Xzxq wvkx жжж", None), (rows[0][0] * 500, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows + odd)], "doc_id long, text string, lang string")
    model = langid.train(df.where(langid.fold() != 0))
    got = {r["id"]: r for r in langid.identify(df, model).collect()}
    held = [k for k in range(len(rows)) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 20 and all(got[k]["pred"] == rows[k][1] for k in held)
    assert not any(got[k]["rejected"] for k in range(len(rows)))
    n = len(rows)
    assert [got[n + k]["pred"] for k in range(3)] == [None] * 3 and all(got[n + k]["rejected"] and got[n + k]["score"] == 0 for k in range(3))
    assert got[n + 3]["rejected"] and got[n + 4]["pred"] == rows[0][1] and not got[n + 4]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_identified(df)
    assert kept.schema == df.schema and kept.where("doc_id < 180").count() == 180


def test_long_texts_do_not_starve_their_language(spark):
    rng = random.Random(4)
    rows = [(" ".join(language_texts(rng, lang, 40)), lang) for lang in ("aa", "bb") for _ in range(3)]
    rows += [(" ".join(language_texts(rng, "bb", 900)), "bb")] + [(t, "bb") for t in language_texts(rng, "bb", 20)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert min(len(t) for t, lang in rows if lang == "aa") > 2000
    model = langid.train(df, max_chars=2000)  # less than any text of aa
    assert model.langs == ["aa", "bb"]
    held = [(t, lang) for lang in ("aa", "bb") for t in language_texts(rng, lang, 30)]
    best = model.predict([t.encode() for t, _ in held])[0]
    assert [model.langs[j] for j in best] == [lang for _, lang in held]


@pytest.mark.parametrize("n, joined", [(60, 1), (400, 200)])
def test_unlearned_languages_are_rejected(spark, n, joined):
    rng = random.Random(6)
    rows = []
    for lang in ("aa", "bb"):
        texts = language_texts(rng, lang, n)
        rows += [(" ".join(texts[k : k + joined]), lang) for k in range(0, n, joined)]  # a few long texts calibrate too
    # a label in another script makes the alphabet large
    rows += [("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200)), "zz") for _ in range(40)]
    model = langid.train(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string"))
    assert np.isfinite(model.limit)
    other = [t for t in language_texts(rng, "cc", 40) if len(t) > 40]
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(30)) for _ in range(10)]
    rejected = lambda texts: model.predict([t.encode() for t in texts])[4]
    assert rejected(other).all() and rejected(noise).all()
    assert not rejected(language_texts(rng, "aa", 40) + language_texts(rng, "bb", 40)).any()


def test_language_model_sums_to_one():
    import pandas as pd

    grams = defaultdict(int)
    for w in ["banana ", "nab ", "ban "]:
        t = "   " + w
        for k in range(len(t) - 3):
            grams[t[k : k + 4]] += 1
    model = langid.Model(pd.DataFrame([("x", g, n) for g, n in grams.items()], columns=["lang", "gram", "n"]))
    chars = [langid._GAP, *range(2, 5), langid._UNKNOWN]  # noqa: SLF001
    for context in ((2, 3, 2), (1, 1, 1), (4, 4, 4), (3, 2, 4)):
        keys = np.array([(context[0] << 48) | (context[1] << 32) | (context[2] << 16) | c for c in chars], np.uint64)
        assert abs(np.exp(model.log_probs(keys, 4)[0]).sum() - 1) < 1e-4


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "x")], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert [r["pred"] for r in langid.identify(df, None).collect()] == [None, None]
    assert langid.train(df.limit(0)) is None


# 2 HTML


PAGE = """<html lang=en><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>
  text&nbsp;here.<p>Second<div class="ad">Buy <div>now</div></div><p>Short.</p><ul><li>item</ul><script>var t="</p>";</script><!-- no --></article>
<aside>Side</aside><form><p>Mail</p></form><section id="comments"><p>A long reader comment that says nothing much but goes on and on for a while.</p></section><footer>&copy; x</footer>"""


def test_html_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst bold text here.\nSecond\nShort.\nitem"
    assert html_text.main_text("") == html_text.main_text("<p></p>") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("plain &lt;b&gt; text") == "plain <b> text"
    assert html_text.main_text('<div class="ad">x<article><p>y</article>') == "y"
    long = "word " * 60
    page = f"<div><a href=x>{long}</a></div><p>tiny</p><br>" + "<div class=menu>x</div>" + f"<p>{long}</p><p>end</p>"
    assert html_text.main_text(page) == long.strip() + "\nend"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", "<p>" * 2000 + "é"), (3, "u", "<p>" * 2000 + "é")], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert [(r["id"], r["n_chars"]) for r in got] == [(1, len(html_text.main_text(PAGE))), (2, 0), (3, 1), (3, 1)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_generated_articles_are_whole(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choices("abc d&<é", k=rng.randint(1, 90))) for _ in range(8)]
    want = [" ".join(p.split()) for p in parts]
    page = "<nav>menu " * 3 + "</nav>" * 3 + "<article>" + "".join(f"<p>{html.escape(p)}</p>" for p in parts) + "</article><footer>f"
    assert html_text.main_text(page) == "\n".join(w for w in want if w)


def test_blocks_end_where_text_outside_links_dives():
    links = "".join(f"<li><a href=/{k}>A link of the page {k}</a>" for k in range(6))
    body = "".join(f"<p>{'plain words ' * 12}{k}</p>" for k in range(3)) + "<p>The end.</p>"
    want = "\n".join(f"{'plain words ' * 12}{k}" for k in range(3)) + "\nThe end."
    # no article, no class names: menu, footer and links around the text
    menu, foot = f"<ul>{links}</ul>", "<div>(c) Some Site, all rights kept</div>"
    table = "<table>" + "".join(f"<tr><td><a href=/{k}>Other page {k}</a></td></tr>" for k in range(5)) + "</table>"
    assert html_text.main_text(f"<body>{menu}<div><h1>Title</h1>{body}</div>{foot}") == "Title\n" + want
    assert html_text.main_text(f"<body>{table}<div>{body}</div>{table}{foot}") == want
    # inside a holder, and dense text beside one
    assert html_text.main_text(f"<article>{body}{menu}<p>x</p></article>") == want
    assert html_text.main_text(f"<article><p>Short teaser.</p></article>{menu}<div>{body}</div>{menu}") == "Short teaser.\n" + want
    # short articles, single links and anchors stay
    assert html_text.main_text(f"<article>{body}</article><article><p>Two</p><p><a href=x>three</a></p></article>") == want + "\nTwo\nthree"
    assert html_text.main_text("<article><a name=top><p>One</p><p>two</p></article>") == "One\ntwo"


def test_html_compound_names():
    body = "".join(f"<p>{'word ' * 40}{k}</p>" for k in range(2))
    want = html_text.main_text(f"<article>{body}</article>")
    cases = [
        f'<div class="main-menu"><a>Home</a><a>About</a></div>{body}',
        f'<div class="main-menu"><a href=x>Home</a><a href=y>About</a></div><div class="content">{body}</div>',
        f'<div class="post-navigation">Next post</div><div class="post">{body}</div>',
        f'<div id="mainMenu">Home</div><div class="post has-sidebar">{body}<div class="post-share">Share this on X</div><div class="article-sidebar">Read also</div></div>',
        f'<div class="post-meta">By someone</div><div class="entry-content">{body}</div><div class="siteFooter">Imprint</div>',
        f'<article>{body}<div class="comment-body">I like it</div></article>',
        f'<div role="main">{body}</div><div class="content-footer">Imprint</div>',
    ]
    for page in cases:
        assert html_text.main_text(page) == want, page
    assert html_text.main_text('<article><header class="entry-header"><h1>Title</h1></header><p>x <math><mi>a</mi></math> y</p></article>') == "Title\nx a y"


def article(n=4):
    return "".join(f"<p>{'plain words here ' * 7}{k}</p>" for k in range(n))


TEASER = f"<article><h3>Card</h3><p>{'teaser words ' * 12}</p></article>"
READER = f'<article><p>{"reader says " * 12}</p></article>'


@pytest.mark.parametrize(
    "page",
    [
        '<nav><a href=/a>Home</a></nav><div class="elementor-widget-container">{}</div>',
        '<nav><a href=/a>Home</a></nav><div class="two-sidebar-layout">{}</div>',
        '<div class="cookies-recipe">{}</div>',
        '<div class="social-science">{}</div><footer>x</footer>',
        f'<article>{{}}</article><aside class="related">{TEASER}{TEASER}</aside>',
        f"<article>{{}}</article><footer>{TEASER}</footer>",
        f'<article>{{}}</article><div class="related">{TEASER}{TEASER}</div>',
        f'<article>{{}}</article><section class="comments">{READER}{READER}{READER}</section>',
        f'<article>{{}}</article><div id="comments">{READER}{READER}</div>',
        "<body><form id=aspnetForm><nav><a href=x>Home</a></nav><div>{}</div><footer>x</footer></form>",
        f'<div class="ad">Buy {TEASER}</div><article>{{}}</article>',
        '<article>{}<div class="post-share">Share on X</div><form><p>Mail us</p></form></article>',
        '<article title="a > b" data-x=\'<p class="ad">\'>{}</article>',
    ],
)
def test_names_are_held_against_the_text(page):
    want = html_text.main_text(f"<article>{article()}</article>")
    assert want.count("\n") == 3 and html_text.main_text(page.replace("{}", article())) == want


def test_headings_sections_and_links_of_articles():
    body = article()
    want = html_text.main_text(f"<article>{body}</article>")
    page = f'<article><h2 id="related-work">Related work</h2>{body}<section id="discussion"><h2 id="discussion-title">Discussion</h2>{body}</section><h2 id=search>Search</h2><p class="promotion">She got a promotion.</p></article>'
    assert html_text.main_text(page) == f"Related work\n{want}\nDiscussion\n{want}\nSearch\nShe got a promotion."
    # links that are never closed
    assert html_text.main_text(f"<p>Intro <a href=x>link</p>{body}") == f"Intro link\n{want}"
    assert html_text.main_text(f"<div><a href=x>Home<a href=y>About{body}</div>").endswith(want)


def test_scanning_is_linear():
    pages = ['<a title="x>' * 90_000, "<a title='x \">" * 70_000, "<" * 10**6, "<p " * 300_000, '<a x="' * 160_000, '<a x=">="' * 100_000 + ">", "<!-- " * 200_000, "<script>" * 120_000, "<div class=ad>" * 70_000 + "word " * 90_000, "<a href=x>t" * 90_000, "<ul><li>" * 110_000, "<form>" * 150_000 + "x"]
    for page in pages:
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 8, page[:20]


@pytest.mark.parametrize("seed", range(4))
def test_generated_pages_equal_what_they_were_made_of(seed):
    """Trees of elements, some of them boilerplate, with end tags left out and attributes quoted in every way; the text is known from their making."""
    rng = random.Random(seed)
    quoted = lambda name: rng.choice([f'class="{name}"', f"class='{name}'", f"class={name}", f'title="a > b" class="x {name}"'])

    def words():
        return " ".join(rng.choice(["word", "caf&eacute;", "a&amp;b", "&lt;i&gt;", "x"]) for _ in range(rng.randint(8, 25)))

    def part(depth):
        """(markup, lines)"""
        kind = rng.random()
        if depth and kind < 0.35:
            inner = [part(depth - 1) for _ in range(rng.randint(1, 4))]
            tag = rng.choice(["div", "section"])
            return f"<{tag} {quoted(rng.choice(['row', 'wrapper', 'text', 'has-sidebar']))}>" + "".join(m for m, _ in inner) + f"</{tag}>", [x for _, found in inner for x in found]
        if kind < 0.55:
            name = rng.choice(["ad", "post-share", "newsletter", "breadcrumbs"])
            return f"<div {quoted(name)}><p>{rng.choice(['Buy now', 'Share this', 'Sign up'])}</p><div>x</div></div>", []
        if kind < 0.65:
            return rng.choice(["<aside><p>Beside</p></aside>", "<script>if (a < b) '</p>'</script>", "<!-- <p>no</p> -->", "<form><p>Mail</p><select><option>1</select></form>"]), []
        text = words()
        mark = rng.choice(["{}", "<b>{}</b>", '<span title="<p>">{}</span>', "<a name=q>{}</a>"]).format(text)
        return f"<p>{mark}" + rng.choice(["</p>", "</P >", ""]), [" ".join(html.unescape(text).split())]

    for _ in range(60):
        inner = [part(3) for _ in range(rng.randint(3, 8))] + [(f"<p>{'closing words ' * 9}</p>", [("closing words " * 9).strip()])]
        page = "<html><head><title>t</title></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav><article>" + "".join(m for m, _ in inner) + "</article><footer>Bottom</footer>"
        assert html_text.main_text(page) == "\n".join(x for _, found in inner for x in found)


def slow_blocks(rows, window, edge):
    """Runs of lines outside all windows without text, and the largest window sum of each."""
    line = [None] * edge + rows + [None] * edge
    size = [x[1] if x else 0 for x in line]
    dived = [False] * len(line)
    for k in range(len(line) - window + 1):
        if sum(size[k : k + window]) == 0:
            dived[k : k + window] = [True] * window
    found, run = [], []
    for k in range(len(line) + 1):
        if k < len(line) and not dived[k]:
            run.append(k)
        elif run:
            sums = [sum(size[j] for j in run if i <= j < i + window) for i in range(-window, len(line))]
            found.append((max(sums), [line[j][0] for j in run if line[j]]))
            run = []
    return [x for x in found if x[0]]


def test_html_blocks_equal_slow_line_blocks():
    rng = random.Random(5)
    for _ in range(2000):
        rows = [rng.choice([None, ("link", 0), (f"t{k}", rng.randint(1, 99)), (f"t{k}", rng.randint(1, 99))]) for k in range(rng.randint(0, 14))]
        rows = [x for r in rows for x in ([r] * rng.choice((1, 1, 1, 3)) if r is None or not r[1] else [r])]
        window, edge = rng.randint(1, 4), rng.randint(0, 4)
        got = list(html_text._blocks(rows, window, edge))  # noqa: SLF001
        assert got == slow_blocks(rows, window, edge), (rows, window, edge)



# 3 secrets


def brute_spans(text):
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def secret_text(rng):
    bits = ["token", "Secret", "API_KEY", "apikey", "passwd", "secret:token:", " = ", ":", "=", '"', "'", "AKIA", "deadbeef", "0123456789", "ſecret", "é", "x", " ", "\n", "ABCDEF0123", "password=tok"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))


def test_base_spans_equal_brute_force():
    rng = random.Random(8)
    for _ in range(3000):
        text = secret_text(rng)
        assert secrets.base_spans(text) == brute_spans(text), text


def test_inferred_formats(spark):
    rng = random.Random(3)
    token = lambda: "ghp_" + "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGH", k=36))
    texts = [f'say token = "{token()}" and go' for _ in range(80)] + [f"see the-plain-words-page-{k}.html.en for it" for k in range(40)] + [f"key {token()} alone", None, "", "word " * 3000]
    df = docs_of(spark, texts)
    grammar = secrets.learn(df)
    got = {r["id"]: [(s["s"], s["e"], s["kind"]) for s in r["spans"]] for r in secrets.scan(df, grammar).collect()}
    assert got[120] == [(4, 44, "auto")] and got[121] == got[122] == got[123] == []
    assert all(got[k] == brute_spans(texts[k]) for k in range(120))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[120] == "key [auto] alone" and clean[121] is None and clean[80] == texts[80]
    assert secrets.redact(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_of_planted_formats(spark, seed):
    """Credentials of four labelled formats, planted without a name among other tokens: nine in ten are found, no other token is."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = digits + low + low.upper()
    formats = [lambda: "ghp_" + pick(every, 36), lambda: "sk_live_" + pick(every, 24), lambda: f"eyJ{pick(every, 30)}.{pick(every + '_-', 40)}", lambda: pick(every + "+/", 43) + "="]
    others = [
        lambda: f"/usr/share/doc/package-{rng.randint(1, 99)}/readme-{rng.randint(1, 9)}.txt.gz", lambda: f"the-{pick(low, 6)}-page-number-{rng.randint(1, 99)}.html", lambda: f"2024-01-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:00:00.000Z+00:00",
        lambda: f"https://example.org/{pick(low, 8)}/{pick(low, 9)}/{rng.randint(100, 999)}", lambda: f"CamelCaseIdentifier{pick(low, 5).title()}Number{rng.randint(1, 99)}", lambda: f"version_{rng.randint(0, 30)}.{rng.randint(0, 30)}-release-candidate{rng.randint(0, 9)}",
    ]
    words = lambda n: " ".join(pick(low, rng.randint(2, 9)) for _ in range(n))
    texts = [f'{words(20)} {rng.choice(["token", "secret", "api_key"])} = "{formats[k % 4]()}" {words(9)}' for k in range(240)]
    texts += [f"{words(15)} {rng.choice(others)()} {words(5)} {rng.choice(others)()}" for _ in range(2000)]
    planted = {}
    for k in range(80):
        before, value = words(12) + " ", formats[k % 4]()
        planted[len(texts)] = (len(before), len(before) + len(value.rstrip("=")))
        texts.append(before + value + " " + words(6))
    df = docs_of(spark, texts, extra=False)
    got = {r["id"]: [(x["s"], x["e"]) for x in r["spans"] if x["kind"] == "auto"] for r in secrets.scan(df, secrets.learn(df)).collect()}
    found = sum(any(a <= s and e <= b for a, b in got[k]) for k, (s, e) in planted.items())
    assert found >= 0.9 * len(planted) and not any(got[k] for k in range(240, 2240))


def test_automaton_keeps_prefixes_and_lengths():
    rng = random.Random(1)
    of = lambda n, letters="0123456789abcdef": "".join(rng.choices(letters, k=n))
    machine = secrets.Automaton(["sk-" + of(40) for _ in range(150)])
    assert len(machine.next) == 44  # one state a place: the alphabet merges, the places do not
    own = sum(machine.score("sk-" + of(40)) for _ in range(20)) / 20
    for other in ("sk-" + of(39), "sk-" + of(41), "sk-" + of(20), of(43), "S1-" + of(40), "sk-" + of(40, "GHIJKL")):
        assert own > machine.score(other) + 0.05, other
    # words of no fixed length fold into loops
    loose = secrets.Automaton([of(1 + int(rng.expovariate(1 / 12)), "ghij0123") for _ in range(300)])
    assert len(loose.next) < 12


def test_automaton_tests_and_scores_equal_brute_force():
    rng = random.Random(2)
    strings = ["".join(rng.choices("0a", k=rng.randint(1, 9))) for _ in range(60)]
    machine = secrets.Automaton.__new__(secrets.Automaton)
    machine._merge = lambda: None  # noqa: SLF001  the prefix tree alone
    machine.__init__(strings)
    spelt = [x.translate(secrets._CLASSES) for x in strings]  # noqa: SLF001
    path = lambda word: __import__("functools").reduce(lambda state, c: machine.next[state][c], word, 0)
    behind = lambda word: [x[len(word) :] for x in spelt if x.startswith(word)]
    for one, two in (("", "d"), ("d", "h"), ("dd", "h"), ("hd", "dh")):
        x, y = behind(one), behind(two)
        share = lambda rows, test: sum(map(test, rows)) / len(rows)
        gaps = [abs(share(x, f) - share(y, f)) for c in ("d", "h") for f in [lambda r, c=c: r[:1] == c]] + [abs(share(x, f) - share(y, f)) for k in range(10) for f in [lambda r, k=k: len(r) <= k]]
        want = max(gaps) / (math.sqrt(math.log(2 / secrets.ALPHA) / 2) * (len(x) ** -0.5 + len(y) ** -0.5))
        assert abs(machine._apart(path(one), path(two)) - want) < 1e-9  # noqa: SLF001
    # each state's symbols, with the end and an unseen one, have probabilities that sum to one
    merged = secrets.Automaton(strings)
    for seen in merged.count:
        total = sum((seen[c] + merged.usual.get(c, merged.rare)) / (seen.total() + 1) for c in [*merged.usual, "new"])
        assert abs(total - 1) < 1e-9


def test_learnt_formats_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}" in file-{rng.randint(0, 10**9)}-of-words.txt' for _ in range(900)]
    one, many = (secrets.learn(docs_of(spark, rows).repartition(n), sample_strings=50) for n in (1, 13))
    assert one.threshold == many.threshold and [len(a.next) for a in one.kinds.values()] == [len(a.next) for a in many.kinds.values()]
    assert len(one.kinds["assign"].next) > 30
    assert secrets.scan(docs_of(spark, []), one).count() == 0
    nameless = spark.createDataFrame([(None, rows[0]), (None, None)], "doc_id long, text string")
    assert [(r["id"], len(r["spans"])) for r in secrets.scan(nameless, one).orderBy("spans").collect()] == [(None, 0), (None, 2)]


def test_candidates_are_scored_whole_and_in_parts():
    rng = random.Random(5)
    key = lambda n=40: "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))
    words = lambda n: "/".join("".join(rng.choices("ghijklmnop", k=7)) for _ in range(n)) + "/p1"
    grammar = secrets.Grammar({"assign": [key(rng.choice((32, 40, 90))) for _ in range(200)]}, [words(rng.randint(3, 20)) for _ in range(200)])
    auto = lambda text: [text[s:e] for s, e, kind in grammar.spans(text) if kind == "auto"]
    own = key()
    # the name in front and a fixed span inside leave the other parts to be scored
    assert auto(f"export AWS_SECRET_ACCESS_KEY={own} now") == [own]
    parts = lambda text: [v for _, _, v in secrets.candidates(text, secrets.base_spans(text))]
    assert parts(f"{own}_token=abcdef123") == [own + "_"]
    assert parts(f"{own}+G{'0123456789abcdef' * 2}G+{own[::-1]}=") == [own + "+G", "G+" + own[::-1]]
    # the end of a long run counts as its start does
    assert auto(f"see {words(10)}/{own} there") == [own]
    assert auto(words(9) + key(400)) != [] and auto(words(60)) == []
    # a start like a key does not decide on the run, only on its own part
    assert all(x.startswith(own) and len(x) < 60 for x in auto(own + "-" + words(200)))


# 4 decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(doc, items):
    words, hit, ids = WORD.findall((doc or "").translate(LOW)), set(), set()
    for key, text in items:
        own = WORD.findall((text or "").translate(LOW))
        n = min(13, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                ids.add(str(key))
    return len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_contamination_equals_brute_force(spark, block_words):
    rng = random.Random(6)
    word = lambda: rng.choice(["Alpha", "bé", "c3", "d", "e", "f", "gg", "H", "日本"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(k, text(rng.choice([1, 5, 12, 13, 14, 20, 40]))) for k in range(12)] + [(99, items_copy := text(30)), (100, items_copy), (101, None), (102, "!!"), (None, text(13))]
    items = [i for i in items if len(WORD.findall(i[1] or "")) != 1] + [(7, "日本日本")]
    texts = [text(rng.randint(0, 200)) for _ in range(30)]
    for k in range(0, 30, 2):
        source = WORD.findall(rng.choice(items[:8])[1])
        a = rng.randint(0, max(0, len(source) - 14))
        texts[k] += " -- " + "; ".join(w.upper() for w in source[a : a + rng.randint(11, 18)]) + " tail"
    texts += [None, "", "\x00\x7f", texts[0]]
    df = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["id"]: (r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in decontaminate.contamination(df, bench, block_words=block_words).collect()}
    known = [i for i in items if i[0] is not None]
    assert got == {k: brute_hits(t, known) for k, t in enumerate(texts)}
    kept = decontaminate.decontaminate(df, bench, block_words=block_words)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if not v[3]}


def test_contamination_with_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.contamination(docs_of(spark, ["a b", None]), bench).collect()] == [0, 0]
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0


def test_winnowing_keeps_one_fingerprint_in_every_window():
    rng = np.random.default_rng(2)
    for n in (1, 5, 9, 10, 200):
        grams = rng.integers(0, 40, n).astype(np.uint64)
        chosen = set(decontaminate._selected(grams, 9).tolist())  # noqa: SLF001
        assert chosen and all(chosen & set(range(k, k + 9)) for k in range(max(1, n - 8)))


# 5 packing and 9 token records


@pytest.mark.parametrize("path, keep", [(WORDS, False), (BYTES, True)])
def test_cached_ids_equal_the_library(path, keep):
    rng = random.Random(9)
    whole = tokenizers.Tokenizer.from_file(path)
    coder = Encoder(path, keep, cache=50)
    bits = ["The", "été", "don't", "x1", "12", "...", "!?", "a_b", "(c)", "'s", "Σας", "ß", "👍", "naïve,", "E.", "'", "ﬁ"]
    texts = [t or "" for t in ODD_TEXTS] + [rng.choice([" ", "\n", "  "]).join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)] + [" ".join(rng.choices(bits, k=50)).replace(" The", "\nThe") for _ in range(50)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert coder.ids(texts) == want and coder.ids(texts[::-1]) == want[::-1]


def test_packing(spark):
    rng = random.Random(5)
    texts = ODD_TEXTS + [" ".join(rng.choices(["alpha", "beta", "gamma9"], k=rng.randint(1, 60))) for _ in range(150)]
    df, cap = docs_of(spark, texts), 64
    coder = Encoder(WORDS, False)
    rows = packing.best_fit_pack(df, WORDS, capacity=cap, group_pieces=40).collect()
    bins, per = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        per[r["id"]].append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    for k, text in enumerate(texts):
        ids = coder.ids([text or ""])[0] + (1).to_bytes(4, "little")
        own = sorted(per[k], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [(a // 4, len(ids[a : a + 4 * cap]) // 4, zlib.crc32(ids[a : a + 4 * cap])) for a in range(0, len(ids), 4 * cap)]
    total = sum(r["length"] for r in rows)
    groups_n = len([r for r in rows if r["length"] < cap]) // 40 + 1
    assert len(bins) <= total / cap * 1.25 + groups_n
    assert packing.best_fit_pack(df.limit(0), WORDS).count() == 0


def test_packed_ids_lay_tokens_out(spark):
    df = docs_of(spark, ["one two three", "four five", None])
    laid = packing.packed_ids(packing.pack(packing.pieces(df, WORDS, with_ids=True, capacity=16), 16)).collect()
    assert sorted(len(r["ids"]) // 4 for r in laid) == [8] and bytes(laid[0]["ids"]).count((1).to_bytes(4, "little")) == 3


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths, room = rng.integers(1, 21, 60), []
        where, offset = packing.best_fit_decreasing(lengths, 20)
        for length in sorted(lengths.tolist(), reverse=True):
            fits = [(r, k) for k, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(20 - length)
        assert where.max() + 1 == len(room)
        assert all(lengths[where == b].sum() <= 20 for b in range(len(room)))


def test_token_records_round_trip(spark, tmp_path):
    texts = ODD_TEXTS + ["tail text"] * 3
    df = docs_of(spark, texts).orderBy(F.desc("doc_id")).unionByName(docs_of(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")))
    manifest = token_records.write_records(df, BYTES, folder=f"file://{tmp_path}/out", partitions=3)
    got = token_records.read_records(manifest, with_ids=True).orderBy("start").collect()
    coder, start = Encoder(BYTES, True), 0
    want = [(None, "null id"), *enumerate(texts)]
    for r, (key, text) in zip(got, want, strict=True):
        ids = coder.ids([text or ""])[0] + (2).to_bytes(4, "little")
        assert (r["id"], r["start"], r["n_tokens"], r["ids_crc32"], np.array(r["ids"], "<u4").tobytes()) == (key, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    shard = manifest.orderBy(F.desc("records")).first()
    whole = token_records.read_at(shard["path"], shard["index_path"], shard["width"], [1, 0])
    assert whole[0][0] == whole[1][0] + 1 if whole[1][0] is not None else whole[0][0] == 0
    path = token_records.filesystem(shard["path"])[1]
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="does not match its checksum"):
        token_records.read_records(manifest).collect()
    assert token_records.read_records(token_records.write_records(df.limit(0), BYTES)).count() == 0


# 6 WARC


def test_warc_round_trip(spark):
    big, rng = "<p>" + "é text " * 50, random.Random(1)
    pages = [(5, "http://a/\r\nx", big), (3, None, big), (9, "u", big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", big + "\r\n\r\n" * 3)]
    pages += [(100 + k, f"http://h/{k}", "".join(rng.choices("abcdef <>", k=400))) for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_archives(df.repartition(3))
    got = warc.read_archives(manifest, with_payload=True).collect()
    assert len(got) == len(pages)
    for r in got:
        payload = next((h or "") for k, _, h in pages if k == r["id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        twin = r["id"] in (5, 9)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if twin else ("response", None))
        assert twin or bytes(r["payload"]) == payload
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    # the file itself begins with the dictionary's skippable frame
    with open(manifest.first()["path"].removeprefix("file://"), "rb") as f:
        assert struct.unpack("<I", f.read(4))[0] in (warc.SKIPPABLE, 0xFD2FB528)


def test_warc_reader_rejects_damage():
    import io

    import zstandard

    good = warc.record(1, "u", hashlib.sha256(b"x").hexdigest(), b"x", None)
    head, block = warc.parse(good)
    assert warc.http_payload(block) == (1, b"x") and head["warc-type"] == "response"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        if bad != good:
            with pytest.raises(ValueError):
                warc.parse(bad)
    words = zstandard.ZstdCompressionDict(b"some dictionary text " * 40, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    framed = zstandard.ZstdCompressor(dict_data=words).compress(good)
    data = warc.dictionary_frame(words.as_bytes()) + framed + framed
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    assert list(warc.frames(io.BytesIO(data))) == [good, good]
    with pytest.raises(ValueError, match="truncated"):
        list(warc.frames(io.BytesIO(data[:-3])))


def foreign_record(kind, block, extra=(), version="WARC/1.0", name="Content-Length"):
    head = [version, f"WARC-Type: {kind}", f"warc-record-id: <urn:uuid:{len(block)}-{kind}>", "WARC-DATE: 2020-01-01T00:00:00Z", *extra, f"{name}: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_reader_takes_archives_from_elsewhere(spark, tmp_path):
    import base64

    import zstandard

    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    body = b"<p>hello"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<p>he\r\n3;x=1\r\nllo\r\n0\r\n\r\n"
    message = "Content-Type: application/http; msgtype=response"
    records = [
        foreign_record("warcinfo", b"software: x\r\nformat: WARC\r\n", ["Content-Type: application/warc-fields"], name="content-length"),
        foreign_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", ["Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/", "X-Folded: one", "  two", "\tthree"]),
        foreign_record("response", http, [message, f"WARC-Payload-Digest: {sha1(body)}", "WARC-Target-URI: http://a/"]),
        foreign_record("response", chunked, [message, f"WARC-Payload-Digest: {sha1(body)}"]),
        foreign_record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", [message, f"WARC-Payload-Digest: {sha1(body)}", "WARC-Refers-To: <urn:uuid:1>"]),
        foreign_record("metadata", b"k: v", [], "WARC/0.18"),
        foreign_record("resource", b"", ["Content-Type: image/png", "WARC-Payload-Digest: xyz:unknown"]),
    ]
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "a.warc.zst").write_bytes(b"".join(map(pack, records)))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "path string")
    got = warc.read_archives(paths, with_payload=True).collect()
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "revisit", "metadata", "resource"]
    assert [bytes(r["payload"]) for r in got[2:4]] == [body, body] and [r["payload_bytes"] for r in got] == [27, 0, 8, 8, None, 4, 0]
    assert got[2]["payload_digest"] == hashlib.sha256(body).hexdigest() and got[4]["payload_digest"] == sha1(body) and got[4]["refers_to_id"] == "<urn:uuid:1>"
    assert all(r["id"] is None and r["record_id"].startswith("<urn:uuid:") for r in got) and got[1]["url"] == "http://a/"
    assert warc.parse(records[1])[0]["x-folded"] == "one two three"
    (tmp_path / "b.warc.zst").write_bytes(pack(foreign_record("response", http, [message, f"WARC-Payload-Digest: {sha1(b'other')}"])))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/b.warc.zst",)], "path string")).collect()


def test_warc_roles_beyond_the_broadcast(spark, monkeypatch):
    rows = [(k, f"u{k % 7}", f"{k % 5} " + "text " * 40, "clash", 1) for k in range(60)] + [(3, "again", "3 " + "text " * 40, "clash", 1)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, digest string, n int")
    near = sorted(map(str, warc.with_roles(pages, "page_id", "url", "html", 100).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    for hot in (5, 13, 1000):
        monkeypatch.setattr(warc, "HOT_ROWS", hot)
        assert sorted(map(str, warc.with_roles(pages, "page_id", "url", "html", 100).collect())) == near


# 7 licences


def test_published_licenses(spark):
    import os

    title = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License', "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003", "Zlib": "The zlib/libpng Licence", "Unlicense": "The Unlicense"}
    rows = []
    for name, head in title.items():
        body = licenses.KNOWN[name]
        rows += [(name, f"{head}\n\nCopyright (c) 2021, Some One <a@b.c>\nAll rights reserved.\n\n{body}\n"), (name, f"Copyright 2019-2022 X\n\n{head}\n{'=' * 20}\n\n{body}"), (name, f"  {head}  \r\n\r\n" + body.replace("\n", "\r\n\r\n"))]
    rows.append(("BSD-3-Clause", licenses.KNOWN["BSD-3-Clause"].replace("\n1. ", "\n * ").replace("\n2. ", "\n * ").replace("\n3. ", "\n (3) ")))
    rows.append(("MIT", "The MIT License (MIT)\n\n" + licenses.KNOWN["MIT"].replace("and/or sell copies", "\n   and/or\n   sell copies")))
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        path = f"/usr/share/common-licenses/{file}"
        if os.path.exists(path):
            with open(path) as f:
                rows.append((name, f.read()))
    rows += [(None, "MIT License"), (None, "MIT License\n\nsome other text"), ("MIT notice", "Released under the MIT License."), (None, licenses.KNOWN["MIT"] + " and more")]
    df = spark.createDataFrame([(k, text, name, "x") for k, (name, text) in enumerate(rows)], "doc_id int, text string, license string, digest string")
    got = {r["id"]: r["license"] for r in licenses.scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in rows]
    # repeated rows, and a table of known texts
    own = licenses.digests_of(spark.createDataFrame([("Mine", "Some Licence\n\nMy own text."), ("Mine", "my own text"), (None, "x"), ("Y", None)], "license string, text string"))
    again = spark.createDataFrame([("k", "My own\ntext"), ("k", "My own\ntext")], "doc_id string, text string")
    assert [(r["id"], r["license"]) for r in licenses.scan(again, own).collect()] == [("k", "Mine")] * 2


def test_canonical_form_equals_slow_form(spark):
    rng = random.Random(23)
    parts = ["The MIT License", "licence", "Licences", "\n", "\n\n", " ", "  ", "Copyright (c) 2020", "(c) 2001 X", "1. ", "(a) ", "sub-licence", "sub license", "https://x.org", "per cent", "non-infringement", "NONINFRINGEMENT", "é", "©", "word", "-", "version 2.0", "Apache License, Version 2.0", "\t", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = [r["c"] for r in docs_of(spark, texts).orderBy("doc_id").select(licenses.canonical(F.col("text")).alias("c")).collect()]

    def slow(text):
        text = text.lower()
        text = re.sub(licenses.LINE_STARTS.replace("(?md)", "(?m)"), " ", text)
        lines = text.split("\n")
        heads = [bool(re.fullmatch("|".join([*licenses.TITLE_LINES, "[^a-z0-9\n]*"]), line)) for line in lines[:-1]]
        cut = heads.index(False) if False in heads else len(heads)
        while cut and not re.search("[a-z0-9]", "\n".join(lines[cut:])):
            cut -= 1
        text = "\n".join(lines[cut:])
        text = " ".join(re.findall("[a-z0-9]+", text))
        for old, new in licenses.SPELLINGS:
            text = text.replace(old, new)
        return text

    assert got == list(map(slow, texts))


def test_long_texts_neither_recurse_nor_take_quadratic_time(spark):
    """A million characters of each kind that a front line may be made of, before a licence and without one."""
    n, body = 1_000_000, licenses.KNOWN["ISC"]
    heads = ["\n" * n, "MIT License\n" * (n // 12), "-" * n + "\n", "- \n" * (n // 3), "version 2" + "1" * n + "\n", " " * n, "(c) " * (n // 4), "a" * n + " license\n", "license (" + "x" * n, "license v" + "." * n, "https://" + "h" * n + "\n", "a b " * (n // 4)]
    rows = [(2 * k, head + body) for k, head in enumerate(heads)] + [(2 * k + 1, head) for k, head in enumerate(heads)]
    began = time.time()
    got = {r["id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert time.time() - began < 60 and len(got) == len(rows)
    # what is a head goes, what is not stays
    assert [k for k, _ in enumerate(heads) if got[2 * k] == "ISC"] == [0, 1, 2, 3, 5, 7, 10]
    assert not any(got[2 * k + 1] for k in range(len(heads)))


def test_license_scan(spark):
    body = licenses.KNOWN["MIT"]
    texts = [body, "Copyright (c) 2020 A Person\n\n" + body.upper().replace(",", " ;"), body.replace("sublicense", "sub-licence"), "x " + body, None, "", "!!!", "Released under the MIT licence"]
    got = {r["id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [got[k]["license"] for k in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, "MIT notice"]
    assert got[4]["digest"] is None and got[5]["digest"] == got[6]["digest"] == hashlib.sha256(b"").hexdigest()
    own = spark.createDataFrame([(got[3]["digest"], "Mine"), (got[3]["digest"], "Also")], "digest string, license string")
    assert {r["id"]: r["license"] for r in licenses.scan(docs_of(spark, texts), own).collect()}[3] == "Also or Mine"
    assert licenses.scan(docs_of(spark, [])).count() == 0


# 8 embeddings


def brute_links(rows):
    vec = [np.array(v, float) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None else None for _, v, label in rows]
    return [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if vec[a] is not None and vec[b] is not None and rows[a][2] == rows[b][2] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] / (np.linalg.norm(vec[a]) * np.linalg.norm(vec[b])) >= 0.98]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 12, "block_rows": 5}, {"cell_rows": 6, "block_rows": 5, "first_cells": 2, "refine": 2}])
def test_embedding_links_equal_brute_force(spark, options):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8))
    rows = []
    for k in range(150):
        v = centers[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.4])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 2)))
    rows += [(150 + k, rows[7][1], 1) for k in range(10)] + [(160, [x * 2 for x in rows[8][1]], 0)]
    rows += [(161, None, 1), (162, [0.0] * 8, 1), (163, [float("nan")] * 8, 1), (164, [None, 1.0], 1), (165, rows[8][1], None), (166, [1.0, 0.0], 1), (167, [], 1), (168, [float("inf")] * 8, 1)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    links = brute_links(rows)
    want, degree = groups(len(rows), links), [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in embeddings.embedding_components(spark.createDataFrame(rows, schema), **options).collect()}
    assert got == {k: (degree[k], want[k], want[k] == k) for k in range(len(rows))}
    assert embeddings.embedding_components(spark.createDataFrame([], schema)).count() == 0


def test_embeddings_with_negative_and_missing_ids(spark):
    rows = [(-5, [1.0, 0.0], 1), (-7, [1.0, 0.01], 1), (None, [1.0, 0.02], 1), (None, [0.0, 1.0], 1), (3, [0.0, -1.0], 1), (3, [0.0, -1.0], 1)]
    got = embeddings.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(-5, 2, -7, False), (-7, 2, -7, True), (None, 2, -7, False), (None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)]))


# 10 SimHash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block_rows", [simhash.BLOCK_ROWS, 3])
def test_simhash_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    rng = random.Random(7)
    texts = ODD_TEXTS + corpus(rng) + ["a b\xa0c", "A  b\nC", "a b c"]
    df = docs_of(spark, texts)
    prints = [brute_fingerprint(t) for t in texts]
    got = {r["id"]: r for r in simhash.simhash_components(df).collect()}
    assert {k: r["fp"] % (1 << 64) for k, r in got.items()} == dict(enumerate(prints))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = groups(len(texts), links)
    assert {k: r["component"] for k, r in got.items()} == dict(enumerate(want))
    kept = simhash.simhash_dedup(df, radius=2, shingle=3, words=1)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns
    assert simhash.simhash_components(df.limit(0)).count() == 0


def brute_wide(text):
    """256 bits over distinct five-word shingles, in Python integers."""
    words, full = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW)), (1 << 64) - 1
    hashes = {xxhash.xxh64_intdigest(" ".join(words[k : k + 5]).encode(), 42) for k in range(max(1, len(words) - 4))} if words else set()

    def mixed(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by & full
        return x ^ x >> 31

    out = 0
    for k in range(4):
        own = [mixed(h + k * 0x9E3779B97F4A7C15 & full) if k else h for h in hashes]
        out |= sum(1 << 64 * k + b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    return out


def near_texts(rng):
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [[word() for _ in range(rng.randint(60, 300))] for _ in range(40)]
    copies = []
    for words in base[:20]:
        for _ in range(3):
            own = list(words)
            for k in rng.sample(range(len(own)), max(1, len(own) // 70)):
                own[k] = word()
            copies.append(own)
    return [" ".join(w) for w in base + copies]


@pytest.mark.parametrize("block_rows", [simhash.WIDE_ROWS, 2])
def test_wide_simhash_dedup_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(simhash, "WIDE_ROWS", block_rows)
    monkeypatch.setattr(simhash, "GONE_ROWS", 0 if block_rows == 2 else 1000)  # both ways of leaving rows out
    texts = near_texts(random.Random(17)) + ODD_TEXTS
    df = docs_of(spark, texts)
    prints = [brute_wide(t) for t in texts]
    assert [int.from_bytes(r["fp"], "little") for r in simhash.fingerprints(df, shingle=5, words=4).orderBy("id").collect()] == prints
    want = groups(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS_WIDE])
    kept = sorted(r["doc_id"] for r in simhash.simhash_dedup(df).collect())
    assert kept == sorted(set(want))
    # every copy of at least 0.8 went, every text of its own stayed
    assert kept[:40] == list(range(40)) and not set(kept) & set(range(40, 100))
    assert simhash.simhash_dedup(df.limit(0)).count() == 0


def test_sampled_keys_meet_the_recall():
    rng = np.random.default_rng(3)
    for n in (10, 10**6, 10**9):
        samples = simhash.key_samples(n, 256, 44)
        met = 0
        for _ in range(400):
            differ = np.zeros(256, bool)
            differ[rng.permutation(256)[:44]] = True
            met += bool((~differ[samples]).all(axis=1).any())
        assert met >= 400 * (simhash.RECALL - 0.05), n


def test_one_hot_key_costs_a_fixed_number_of_copies(spark):
    rng = random.Random(19)
    # 100,000 fingerprints that agree in their upper half: one key of the first tables holds all
    prints = sorted({0x1234567800000000 | rng.getrandbits(32) for _ in range(100_000)})
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long").repartition(8), 2).collect()}
    known, links = set(prints), []
    flips = [1 << a for a in range(32)] + [1 << a | 1 << b for a in range(32) for b in range(a)]
    for p in prints:
        links += [(p, p ^ f) for f in flips if p ^ f in known and p ^ f < p]
    place = {p: k for k, p in enumerate(prints)}
    assert groups(len(prints), [(place[a], place[b]) for a, b in got]) == groups(len(prints), [(place[a], place[b]) for a, b in links])


def test_rows_that_share_an_id(spark):
    a, b = "one two three four five six seven", "these are quite different words in every place"
    rows = [(5, a), (5, b), (5, b), (3, a), (7, b), (9, None), (9, None), (9, "other text that stands alone here")]
    got = [(r["doc_id"], r["text"]) for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (9, None), (9, "other text that stands alone here")], key=str)
    text_ids = spark.createDataFrame([("a-1", a), ("b-2", a), ("c-3", b)], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in simhash.simhash_dedup(text_ids).collect()) == ["a-1", "c-3"]
    assert {r["id"]: r["component"] for r in simhash.simhash_components(text_ids).collect()} == {"a-1": "a-1", "b-2": "a-1", "c-3": "c-3"}


def test_links_of_dense_fingerprints_in_small_blocks(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for block in (1024, 4):
        edges = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, block).collect()
        place = {p: k for k, p in enumerate(signed)}
        want = groups(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
        assert groups(len(prints), [(place[r["a"]], place[r["b"]]) for r in edges]) == want


def test_rows_without_id_stay(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "a b c d"), (1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in simhash.simhash_dedup(df).collect()))) == ["1", "None", "None"]


def test_scores_do_not_depend_on_slices(monkeypatch):
    import pandas as pd

    rng = random.Random(5)
    texts = ["".join(rng.choices("abc de", k=rng.choice([0, 1, 5, 300, 40_000]))).encode() for _ in range(12)] + [b"", b"a" * 20_000]
    model = langid.Model(pd.DataFrame([("x", "ab c", 3), ("y", "abca", 2), ("y", " abd", 1)], columns=["lang", "gram", "n"]))
    whole = model.score(texts)
    monkeypatch.setattr(langid, "SLICE_VALUES", 1)
    cut = model.score(texts)
    alone = np.vstack([model.score([t])[0] for t in texts])
    assert np.allclose(whole[0], cut[0]) and np.allclose(whole[0], alone) and (whole[1] == cut[1]).all()


# shared helpers, bounds and languages


class Context:
    master = "spark://host:7077"
    folder = None

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder + "/set"


class Session:
    def __init__(self, **conf):
        self.conf, self.sparkContext = conf, Context()


def test_shared_folder():
    at = Session(**{"spark.checkpoint.dir": "hdfs://h/x/"})
    assert common.shared_dir(at) == "hdfs://h/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    given = Session()
    given.sparkContext.folder = "file:///mnt/given"
    assert common.shared_dir(given) == "file:///mnt/given"
    alone = Session()
    alone.sparkContext.master = "local[4]"
    assert common.shared_dir(alone) == common.shared_dir(alone) == common.DEFAULT_SHARED_DIR + "/set"
    assert common.filesystem("file:///tmp/x")[1] == "/tmp/x"


def test_shared_tables_are_released(spark, tmp_path, monkeypatch):
    import os

    from zonepulse.sources import shared

    assert common.qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and common.qualified(spark, "s3a://b/x") == "s3a://b/x"
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    assert common.materialize(spark.range(3), "x").count() == 3
    assert any(files for _, _, files in os.walk(tmp_path))
    common.release(spark)
    assert not any(files for _, _, files in os.walk(tmp_path))


def test_many_benchmark_blocks_and_a_long_item(spark):
    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    items = [(k, words(rng.choice((5, 40, 60)))) for k in range(60)] + [(99, words(2000))]
    long = items[-1][1].split()
    docs = [words(30) + " " + " ".join(long[k : k + 14]) + " " + words(9) for k in range(0, 1980, 66)] + [items[3][1], items[4][1] + " " + words(500), words(50), None]
    df = docs_of(spark, docs).withColumn("row", F.lit(1)).withColumn("spans", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate._blocks(bench, "item_id", "text", 250)) >= 20  # noqa: SLF001
    got = {r["id"]: (r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in decontaminate.contamination(df, bench, block_words=250).collect()}
    want = {k: brute_hits(t, items) for k, t in enumerate(docs)}
    assert got == want
    kept = decontaminate.decontaminate(df, bench, block_words=250)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k, w in want.items() if not w[3]]


def test_blocks_of_languages_score_alike():
    import pandas as pd

    rng = random.Random(37)
    rows = []
    for lang in range(60):
        letters = "".join(chr(97 + (lang * 7 + k) % 26) for k in range(6)) + " "
        text = "".join(rng.choices(letters, k=300))
        for k in range(len(text) - 3):
            rows.append((f"l{lang:02}", text[k : k + 4], 1))
    counts = pd.DataFrame(rows, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False).sum()
    whole, cut = langid.Model(counts, block_langs=60), langid.Model(counts)
    texts = [b"", b"hello there", "жук".encode(), b"abcdefg " * 50] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200)).encode() for _ in range(10)]
    assert len(cut.blocks) == 8 and np.allclose(whole.score(texts)[0], cut.score(texts)[0], atol=1e-3)
    values = lambda m: sum(a.values.size for b in m.blocks for a in b.grams.values())
    assert values(cut) * 3 < values(whole)


def test_slow_kneser_ney_gives_the_same_probabilities():
    import pandas as pd

    rng = random.Random(41)
    data = {lang: Counter("".join(rng.choices("abc ", weights=w, k=120))[k : k + 3] for k in range(118)) for lang, w in (("x", (5, 2, 1, 2)), ("y", (1, 1, 6, 2)))}
    model = langid.Model(pd.DataFrame([(lang, g, n) for lang, c in data.items() for g, n in c.items()], columns=["lang", "gram", "n"]), order=3)
    chars = len(set("".join(g for c in data.values() for g in c)) - {" "}) + 2

    def levels(counts):
        out = {3: counts}
        for n in (2, 1):
            out[n] = Counter(g[1:] for g in out[n + 1])
        return out

    def slow(of, gram):
        n = len(gram)
        if n == 0:
            return 1 / chars
        counts = of[n]
        one, two = (sum(v == k for v in counts.values()) for k in (1, 2))
        cut = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
        mine = {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        if not mine:
            return slow(of, gram[1:])
        total = sum(mine.values())
        return max(counts[gram] - cut, 0) / total + cut * len(mine) / total * slow(of, gram[1:])

    for text in ("abc ab cab", "ccc cca", "a", "zq a"):
        sums, n = model.score([text.encode()])
        padded = "  " + text + " "
        for j, lang in enumerate(model.langs):
            of = levels(data[lang])
            want = sum(math.log(slow(of, padded[k - 2 : k + 1])) for k in range(2, 2 + int(n[0])))
            assert abs(sums[0, j] - want) < 1e-3, (text, lang)


def test_identify_edge_rows(spark):
    texts = ["the cat and the dog " * 20, "le chat et le chien " * 20] * 40
    df = spark.createDataFrame([(f"d-{k}", t, "en" if k % 2 == 0 else "fr", 0.5, "x") for k, t in enumerate(texts)], "doc_id string, text string, lang string, score double, pred string")
    model = langid.train(df)
    odd = spark.createDataFrame([("a-1", "the cat and the dog " * 20, "zz"), ("a-1", "the cat and the dog " * 20, "zz"), (None, None, None), ("e", "", None), ("n", "123", None)], "doc_id string, text string, lang string")
    got = [(r["id"], r["pred"], r["rejected"]) for r in langid.identify(odd, model).collect()]
    assert got[0] == got[1] == ("a-1", "en", False) and got[2:] == [(None, None, True), ("e", None, True), ("n", None, True)]
    assert langid.identify(odd.limit(0), model).count() == 0
    # without labels nothing can be rejected but texts without letters
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert [r["doc_id"] for r in langid.keep_identified(bare).collect()] == ["a-1", "a-1"]
    assert langid.keep_identified(bare.limit(0)).count() == 0


def test_ids_keep_their_type(spark):
    text_ids = spark.createDataFrame([("a-1", 'token = "abcdef12"', "<p>x</p>", "u"), (None, None, None, None)], "doc_id string, text string, html string, url string")
    assert {r["id"] for r in secrets.scan(text_ids, secrets.learn(text_ids)).collect()} == {"a-1", None}
    assert {r["id"] for r in html_text.extract(text_ids.withColumnRenamed("doc_id", "page_id")).collect()} == {"a-1", None}
    bench = spark.createDataFrame([("q", "token abcdef12")], "item_id string, text string")
    assert {(r["id"], r["n_hit"]) for r in decontaminate.contamination(text_ids, bench).collect()} == {("a-1", 2), (None, 0)}
    assert {r["id"] for r in licenses.scan(text_ids).collect()} == {"a-1", None}
    # files keep them as text, whatever stands in them
    odd = ["a-1", "7", "", "x>y <z> %41", "é\r\nb", None]
    many = spark.createDataFrame([(k, "one two three " * 2000 if k == "7" else "same page " * 20, f"u{n}") for n, k in enumerate(odd)], "doc_id string, text string, url string")
    packed = packing.best_fit_pack(many, WORDS, capacity=512).collect()
    assert {r["id"] for r in packed} == set(odd) and [r["piece"] for r in sorted((r for r in packed if r["id"] == "7"), key=lambda r: r["start"])] == list(range(12))
    read = token_records.read_records(token_records.write_records(many, BYTES)).collect()
    assert [r["id"] for r in sorted(read, key=lambda r: r["start"])] == [None, "", "7", "a-1", "x>y <z> %41", "é\r\nb"]
    pages = warc.read_archives(warc.write_archives(many, "doc_id", payload_col="text"))
    assert pages.schema["id"].dataType == T.StringType()
    got = {r["id"]: (r["record_type"], r["refers_to"]) for r in pages.collect()}
    assert got == {None: ("response", None), "": ("response", None), "7": ("response", None), "a-1": ("revisit", ""), "x>y <z> %41": ("revisit", ""), "é\r\nb": ("revisit", "")}
    few = spark.createDataFrame([(1.5, "a b", "u")], "doc_id double, text string, url string")
    assert [r["id"] for r in packing.best_fit_pack(few, WORDS).collect()] == [1.5] and [r["id"] for r in token_records.read_records(token_records.write_records(few, BYTES)).collect()] == ["1.5"]
