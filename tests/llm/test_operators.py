"""Each operator on small tables: nulls, empty and long texts, ties and repeated
rows, empty tables, clashing column names, and brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)


def clashing(spark, pairs, names):
    """The documents with extra columns named like an operator's own."""
    df = docs_of(spark, pairs)
    for n in names:
        df = df.selectExpr("*", f"'x' AS `{n}`")
    return df


VOCAB = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(VOCAB, n))


BASE = prose(1, 120)
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, BASE), (7, BASE), (7, BASE),
        (8, BASE + " tail"), (9, "x " + prose(2, 300)), (10, prose(2, 300) + " y z"), (None, BASE), (None, None),
        (11, prose(3, 6000)), (12, "a" * 5000)]


# -- quality rules -------------------------------------------------------------

def repeat_words(w):
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    return len({i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)})


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(w))


def test_quality_measures_and_verdict(spark):
    from quire.llm import quality
    loop = " ".join(["a b c d e f g h"] * 5)
    cases = EDGE + [(20, loop), (21, "l1 x\nl1 x\n\nl2 #$\nl1 x"), (22, " ".join(["GO!!"] * 5 + [prose(9, 25)])),
                    (23, "é #" * 30), (24, " ".join(["$$"] * 40))]
    got = quality.measure(clashing(spark, cases, ["kept", "measures"])).collect()
    assert Counter((r.doc_id,) + tuple(r[c] for c in quality.MEASURES) for r in got) == Counter(
        (i,) + brute_quality(t) for i, t in cases)
    assert all(not (r.base_failed and r.kept) for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert {6, 7, 9, 10, 11} <= kept and not kept & {1, 2, 3, 4, 20, 24}
    stay = quality.keep_good(docs_of(spark, cases))
    assert stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r.doc_id for r in stay.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.measure(docs_of(spark, [])).count() == 0


def test_cascade_order_changes_no_verdict(spark):
    from pyspark.sql import functions as F
    from quire.llm import quality
    df = docs_of(spark, EDGE)
    a = df.select(quality.cascade(list(quality.RULES), F.col("text")).alias("k"), "doc_id")
    b = df.select(quality.cascade(list(quality.RULES)[::-1], F.col("text")).alias("k"), "doc_id")
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    order = quality.plan_cascade(df)
    assert {r.name for r, _, _ in order} == {r.name for r in quality.RULES}


def test_cascade_order_follows_cost_and_selectivity(spark):
    """A rule that costs much and one that never rejects come after a cheap one that
    rejects; the order is the same each time."""
    from pyspark.sql import functions as F
    from quire.llm import quality
    df = docs_of(spark, [(i, "wort " * 60 + str(i)) for i in range(300)])
    heavy = quality.Rule("heavy", lambda m: F.exists(F.sequence(F.lit(1), F.lit(8)), lambda k: F.size(F.filter(
        m.words, lambda w: F.sha2(F.concat(w, k.cast("string")), 256) == "")) > 0) | m.text.endswith("3"))
    never, cheap = quality.Rule("never", lambda m: m.n_words < 0), quality.Rule("cheap", lambda m: m.text.endswith("3"))
    for given in [(heavy, never, cheap), (never, cheap, heavy)]:
        order = quality.plan_cascade(df, given, sample_rows=20)
        print([(r.name, share, seconds) for r, share, seconds in order])
        assert order[0][0].name == "cheap" and order[0][1] > 0
        assert {r.name: share for r, share, _ in order}["heavy"] == order[0][1]
    assert quality.hash_sample(df, 1000).count() == 300 and 0 < quality.hash_sample(df, 20).count() < 60


# -- URL filters ---------------------------------------------------------------

def test_urls(spark):
    from quire.llm import urls
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
                                   ("a.example.org", "/", "block"), ("com", "/de/", "block")], "host string, path string, verdict string")
    cases = [None, "", "no scheme", "http://Example.ORG/es/x", "https://www.example.org/en/123?q=/es/", "http://example.org/en/2",
             "http://example.org", "http://notexample.org/es/", "http://b.a.example.org/es/", "x://y://com/de/", "http://x.com/de/#f",
             "http://x.com/de/#f", "http://com:80/de/", "http:///de/", "http://" + "a." * 300 + "org/" + "p" * 3000]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(cases)], "page_id int, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    table = [tuple(r) for r in rules.collect()]
    for i, u in enumerate(cases):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = max(((len(h + p), len(h), v == "block", h + p, v) for h, p, v in table
                   if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict_) == (host, path, fit and fit[3], fit[4] if fit else "allow"), u
        assert r.verdict == "v"
    assert urls.judge(pages.limit(0), rules).count() == 0
    clash = pages.selectExpr("url", "page_id as best", "'b' as b_host", "'p' as B_PATH", "'h' as host")
    assert {(r.best, r.b_host, r.B_PATH, r.host, r.host_, r.verdict) for r in urls.judge(clash, rules).collect()} == {
        (i, "b", "p", "h", r.host, r.verdict_) for i, r in got.items()}
    assert {r.verdict_ for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


# -- HTML extraction -----------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class="top"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- c <p>no</p> -->
<div class="cookie-notice">We use cookies, really, a lot, here.</div><div id="sidebar"><p>Side, text, with commas, many.</p></div>
%s<section id="comments"><p>First, reader, says, something, long.</p></section>
<form><p>Subscribe, now</p><input name=q></form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("article,want", [
    ("<article><h1>Head &amp; line</h1><p>One,\n  two <b>three</b>.<p>Four &lt;five&gt;&#33;</article>", "Head & line\nOne, two three.\nFour <five>!"),
    ("<div><div class='story'><p>Alpha, beta, gamma, delta.</p><p>Short.</p><ul><li>item one</li><li>item two</li></ul></div></div>",
     "Alpha, beta, gamma, delta.\nShort.\nitem one\nitem two"),
    ("<main><p>Only, this.</main>", "Only, this."),
    ("<article><header><h1>Kept</h1></header><p>Body.</p><aside>Ad, ad, ad.</aside><div class=ad>Buy</div></article>", "Kept\nBody."),
])
def test_html(article, want):
    from quire.llm.html import main_text
    assert main_text(PAGE % article) == want


@pytest.mark.parametrize("mark,long", [("article", 20), ("article", 200), ("main", 20), ("div id='story'", 20), ("div><div", 20)])
def test_html_keeps_long_and_short_sections(mark, long):
    from quire.llm.html import main_text
    para = "Alpha, beta, gamma. " + "x" * 100
    page = (f"<{mark}><h1>Head</h1><section><h2>One</h2>" + f"<p>{para}</p>" * long + f"</section><section><h2>Two</h2><p>{para}</p></section>"
            f"<div><p>Last</p></div></{mark.split()[0].split('>')[0]}>" + "</div>" * (mark == "div><div"))
    assert main_text(PAGE % page) == "\n".join(["Head", "One"] + [para] * long + ["Two", para, "Last"])


def test_html_keeps_parts_below_the_body_but_no_link_lists():
    from quire.llm.html import main_text
    links = "<section><h2><a href=/x>More</a></h2>" + "<a href=/y>one, two, three, four</a> " * 9 + "</section>"
    page = "<h1>Head</h1><section>" + "<p>Alpha, beta, gamma.</p>" * 9 + "</section><section><h2>Two</h2><p>Short</p></section>" + links
    assert main_text(PAGE % page) == "\n".join(["Head"] + ["Alpha, beta, gamma."] * 9 + ["Two", "Short"])


STORY = "<h1>Head</h1><p>" + "Alpha, beta, gamma. " * 20 + "</p><p>Last</p>"
STORY_TEXT = "Head\n" + " ".join(["Alpha, beta, gamma."] * 20) + "\nLast"


@pytest.mark.parametrize("page", [
    '<div style="overflow: hidden"><article>%s</article></div>', '<div data-id="ad-1" title="role=menu"><article>%s</article></div>',
    '<div data-x=hidden-gems aria-labelledby=hidden><article>%s</article></div>', "<div style='a:hidden' class=story id='x'>%s</div>",
    '<div class="content-sidebar-wrap"><article>%s</article><aside>Side</aside></div>', '<div id="has-sidebar"><main>%s</main></div>',
    '<div class="has-sidebar"><div class="no-ads"><article>%s<div class="share">Share</div></article><div class="widget">W, w</div></div></div>',
    '<div class="post share-enabled">%s</div>', '<main><h1></h1><section class="post comments-open">%s</section></main>',
    '<article><div class="post share-enabled">%s</div><p hidden>no</p><p aria-hidden="true">no</p><p class="ad">no</p></article>',
    '<article>%s</article><div class="sidebar"><article><p>Other, article, here.</p></article></div>',
    '<article>%s</article><div id="respond"><article><p>' + "Long, comment. " * 99 + "</p></article></div>",
    '<article>%s<div class="comments"><article><p>' + "Long, comment. " * 99 + "</p></article></div></article>",
    '<div class="content-sidebar-wrap"><article>%s</article><div class="comments"><article>' + "Long, comment. " * 99 + "</article></div></div>",
    '<div class="related"><article><p>Other.</p></article></div><div class="has-sidebar"><article>%s</article></div>',
])
def test_html_drops_no_article_by_accident(page):
    from quire.llm.html import main_text
    assert main_text(PAGE % (page % STORY)) == STORY_TEXT


def test_html_links_keep_their_words():
    from quire.llm.html import main_text
    page = "<article><p>See <a href=\"/x/hidden-gems\">these gems</a>, <a href='/x?id=comment'>this one</a> or <a href=/a?role=menu&class=ad>that</a>.</article>"
    assert main_text(PAGE % page) == "See these gems, this one or that."


@pytest.mark.parametrize("page,want", [
    ("<main><h1>Title</h1><article>%s</article></main>", "Title\n" + STORY_TEXT),
    ("<main><div><h1>Title</h1><p>Lead.</p><article>%s</article></div><p>Tail.</p></main>", "Title\nLead.\n" + STORY_TEXT + "\nTail."),
    ("<main><article>%s</article><h2>Comments</h2><div class='comments'><p>Reader.</p></div><p><a href=/>All linked</a></p></main>", STORY_TEXT),
    ("<main><article>%s</article><h2>Off</h2><h3>Off</h3><ul><li><a href=/>More</a></li></ul><h2>On</h2><p>Tail.</p></main>", STORY_TEXT + "\nOn\nTail."),
    ("<article>%s<section class='related-work'><h2>Related work</h2><p>Earlier.</p></section></article>", STORY_TEXT + "\nRelated work\nEarlier."),
    ("<article>%s<p class='side-note'>Note.</p><div class='related-posts'><p>Other.</p></div><p class='ad-slot-3'>Buy</p></article>", STORY_TEXT + "\nNote."),
])
def test_html_parts_beside_the_article_and_whole_class_words(page, want):
    from quire.llm.html import main_text
    assert main_text(PAGE % (page % STORY)) == want


def test_html_against_pages_built_from_known_blocks(spark):
    """Pages are built from article blocks and clutter at random places, so the
    text is known without reading them; operator and builder share no code."""
    import random
    from quire.llm import html
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    clutter = ["<nav><ul><li><a href=/a>Home, sweet, home</a></li></ul></nav>", "<div class='cookie-banner'>We use, well, cookies.</div>",
               "<aside><p>Side, by, side.</p></aside>", "<div class='share-buttons'><a href=#>Share</a></div>", "<form><p>Join, us</p><input></form>",
               "<script>var p = '<p>no, no</p>';</script>", "<style>p{color:red}</style>", "<!-- <p>no</p> -->", "<div class='ad-slot-1'>Buy, now</div>",
               "<div id=comments><p>First, reader, here.</p><p>Second, reader.</p></div>", "<footer>Imprint, and so on</footer>", "<p hidden>no</p>"]
    pages, want = [], []
    for _ in range(300):
        body, blocks = [], []
        for _ in range(rnd.choice([3, 8, 60])):
            text = [word() for _ in range(rnd.choice([6, 20, 200]))]
            said = " ".join(t + rnd.choice(["", "", ",", " &", " <"]) for t in text)
            code = said.replace("&", "&amp;").replace("<", rnd.choice(["&lt;", "&#60;", "&#x3C;"])).replace(" ", rnd.choice([" ", "\n  ", " \t"]))
            at = rnd.choice(text[1:-1])
            if rnd.random() < 0.3 and said.split().count(at) == 1:
                code = code.replace(at, rnd.choice(["<b>%s</b>", "<a href='/x?id=ad'>%s</a>", "<em>%s<!-- c --></em>"]) % at)
            tag = rnd.choice(["p", "p", "p", "h2", "li", "blockquote"])
            body.append((f"<ul><li>{code}</ul>" if tag == "li" else f"<p>{code}" if tag == "p" else f"<{tag}>{code}</{tag}>"))
            blocks.append(" ".join(said.split()))
            if rnd.random() < 0.2:
                body.append(rnd.choice(clutter))
        around = rnd.choice(["<article>%s</article>", "<main>%s</main>", "<div><article>%s</article></div>", "<main><article><div>%s</div></article></main>"])
        before, after = "".join(rnd.sample(clutter, 3)), "".join(rnd.sample(clutter, 4))
        pages.append((len(pages), f"<html><body>{before}{around % ''.join(body)}{after}</body></html>"))
        want.append("\n".join(blocks))
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}


def test_html_edges(spark):
    from quire.llm import html
    deep = "<div>" * 20000 + "<p>deep, text here</p>"
    cases = [None, "", "plain words only", "<p>unclosed", "<", "<a href='x", "<!-- open", "<script>x", deep, "<p>a</p>" * 3000, "<p title=5\">q</p>"]
    pages = spark.createDataFrame([(i, c, "t") for i, c in enumerate(cases)] + [(3, cases[3], "t")], "page_id int, html string, text string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[0].text_ == got[1].text_ == "" and got[2].text_ == "plain words only" and got[3].text_ == "unclosed"
    assert got[8].text_ == "deep, text here" and got[9].text_ == "\n".join("a" * 3000) and got[0].text == "t"
    assert all(r.n_chars == len(r.text_) for r in got.values())
    assert html.extract(pages.limit(0)).count() == 0


# -- secrets -------------------------------------------------------------------

KIND = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}


def brute_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in KIND["assign"].finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in KIND["access"].finditer(t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in KIND["hex"].finditer(t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


PARTS = st.sampled_from(["password", "Token", "API_KEY", "secret=", ": ", "=", "'", '"', " ", "abc", "abcdef12", "AKIA", "ABCDEFGHIJ123456",
                         "0123456789abcdef", "é🙂", "\n", "user=bob", "https://h.example.com/x", "ſecret", "x" * 150])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.lists(PARTS, max_size=14).map("".join), min_size=20, max_size=40))
def test_secrets_base_spans(spark, texts):
    from quire.llm import secrets
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(docs_of(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[i].n_assign == sum(x.startswith("assign") for x in want)
        assert set(want) <= set(got[i].spans.split(",") if got[i].spans else [])


def test_secrets_linking_and_redaction(spark):
    from quire.llm import secrets
    far = " word" * 60
    many = " ".join(f"token=abcdef{i:06d}" for i in range(1500))
    cases = EDGE + [(30, "user=alice"), (31, "user=alice password=hunter2"), (32, "user=alice" + far + " password=hunter2"),
                    (33, "see https://db.example.com/a then secret=abcd"), (34, "secret=abcd"), (35, many), (36, "é🙂 token = \"abcdef123456\" end")]
    found = secrets.digest(secrets.scan(clashing(spark, cases, ["spans", "text_hash", "base"]))).collect()
    assert len(found) == len(cases)
    got = {r.doc_id: r.spans for r in found}
    assert got[30] == "" and got[34] == "" and got[31] == "user:0:10,assign:11:27"
    assert got[32].startswith("assign") and "endpoint" in got[33] and "short" in got[33]
    assert got[35].split(",") == brute_secrets(many) and got[1] == ""
    clean = {r.doc_id: r for r in secrets.redact(clashing(spark, cases, ["spans", "text_hash"])).collect()}
    assert clean[31].text == "[secret] [secret]" and clean[36].text == 'é🙂 [secret]" end' and clean[36].n_chars == len(clean[36].text)
    assert clean[1].text is None and clean[30].text == "user=alice" and clean[35].text == " ".join(["[secret]"] * 1500)
    assert clean[6].spans == "x"
    assert secrets.scan(docs_of(spark, [])).count() == 0 and secrets.redact(docs_of(spark, [])).count() == 0


# -- n-gram Jaccard join -------------------------------------------------------

def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_join(cases):
    sets = [shingles(t) for _, t in cases]
    parent, links = list(range(len(cases))), [0] * len(cases)

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) * 10 >= 8 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(cases)):
        groups[top(i)].append(cases[i][0])
    return Counter((cases[i][0], min((x for x in groups[top(i)] if x is not None), default=None), links[i]) for i in range(len(cases)))


def edited(text, seed, n):
    rng = np.random.default_rng(seed)
    w = text.split()
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"e{seed}"
    return " ".join(w)


def test_jaccard_join(spark):
    from quire.llm import jaccard
    cases = EDGE + [(100 + k, edited(BASE, k, 1 + k % 4)) for k in range(60)] + [(200, "one"), (201, "one\ttwo\nthree four")]
    df = clashing(spark, cases, ["digest", "class_id", "bands"])
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect()) == brute_join(cases)
    stay = jaccard.keep_first(df)
    assert stay.columns == df.columns
    ids = Counter(r.doc_id for r in stay.collect())
    firsts = {c for d, c, _ in brute_join(cases) if c is not None}
    blank = Counter(i for i, t in cases if not shingles(t))
    assert ids == Counter({c: 1 for c in firsts} | blank)
    assert jaccard.join(docs_of(spark, [])).count() == 0


def test_jaccard_blocks_lose_nothing(spark, monkeypatch):
    from quire.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    cases = [(k, edited(BASE, k, k % 3)) for k in range(90)]
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs_of(spark, cases)).collect()) == brute_join(cases)


def test_pruning_keeps_pairs_at_the_threshold():
    from quire.llm import jaccard
    for n in jaccard.STEPS:
        assert jaccard.least_agreements(n) < 0.8 * n
    assert jaccard.least_agreements(125) > 0.5 * 125
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 60, 300, dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[:280], rng.integers(0, 1 << 60, 15, dtype=np.uint64)])) for s in sets[:20]]
    i, j = np.triu_indices(len(sets), 1)
    assert (jaccard._common(sets, i, j) == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]).all()


# -- decontamination -----------------------------------------------------------

def test_decontamination(spark):
    from quire.llm import decontaminate
    items = [(i, prose(500 + i, n)) for i, n in enumerate((5, 6, 8, 15, 16, 17, 30, 40, 63, 64, 65, 130))]
    items += [(50, None), (51, ""), (52, "two words"), (52, "two words"), (None, prose(777, 20))]
    cases = EDGE + [(100 + (i or 70), prose(900, 500) + " " + t + " " + prose(950, 700)) for i, t in items if t]
    cases += [(300, "two words"), (301, edited(items[7][1], 3, 1)), (302, " ".join(items[7][1].split()[:20])), (303, prose(12, 9000) + " " + items[9][1])]
    bank = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.search(clashing(spark, cases, ["hits", "item_id"]), bank).collect()
    want = {(d, i) for d, t in cases for i, q in items if shingles(q) and len(shingles(q) & shingles(t)) * 10 >= 8 * len(shingles(q))}
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter(want)
    assert all(r.containment >= 0.8 for r in got)
    clean = decontaminate.clean(clashing(spark, cases, ["text_hash"]), bank)
    bad = {d for d, _ in want}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _ in cases if d not in bad)
    assert decontaminate.search(docs_of(spark, []), bank).count() == 0
    assert decontaminate.search(docs_of(spark, cases), bank.limit(0)).count() == 0


@pytest.mark.parametrize("plain", [[], [(900, prose(900, 40)), (901, prose(901, 9))]])
def test_decontamination_of_items_that_repeat_themselves(spark, plain):
    from quire.llm import decontaminate
    def loop(seed, distinct, n):
        return " ".join((prose(seed, distinct).split() * n)[:n + 4])
    items = [(i, loop(600 + i, d, n)) for i, (d, n) in enumerate([(1, 100), (1, 2), (2, 90), (3, 60), (3, 100), (6, 60), (6, 100), (12, 40)] * 4)] + plain
    # the passage stands whole, or with a fifth of its distinct shingles missing at most, in other text
    cases = [(1000 + i, prose(700 + i, 300) + " " + t + " " + prose(800 + i, 200)) for i, t in items]
    cases += [(2000 + i, prose(720 + i, 150) + " " + " ".join(t.split()[:len(set(t.split())) + 3]) + " " + prose(820 + i, 150)) for i, t in items]
    cases += [(3000, " ".join(prose(3, 4000).split())), (3001, None), (None, items[3][1])]
    got = decontaminate.search(docs_of(spark, cases), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {(d, i) for d, t in cases for i, q in items if shingles(q) and len(shingles(q) & shingles(t)) * 10 >= 8 * len(shingles(q))}
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter(want)


# -- substring dedup -----------------------------------------------------------

def brute_substrings(cases):
    first = {}
    for i, t in cases:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12 if i is not None else 0):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, t in cases:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        out[i, len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [8 << 20, 500])
def test_substrings(spark, monkeypatch, block):
    from quire.llm import substrings
    monkeypatch.setattr(substrings, "BLOCK", block)
    p = prose(41, 60).split()
    cases = EDGE + [(60, " ".join(p)), (40, " ".join(p[10:40]) + " q " + " ".join(p[35:60])), (50, " ".join(p[:13])), (55, " ".join(p[:12])),
                    (61, " ".join(p[20:35]) + " " + " ".join(p[:20])), (62, " ".join(["r"] * 50)), (63, " ".join(["r"] * 70))]
    cases += [(1000 + k, prose(3000 + k, 20) + " " + " ".join(p[5:25]) + " " + prose(4000 + k, 20)) for k in range(40)]
    df = clashing(spark, cases, ["seeds", "text_hash", "n_words"]).repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(df).collect())
    assert got == brute_substrings(cases)
    for r in substrings.factors(df).collect():
        source = next(t for i, t in cases if i == r.ref_doc)
        own = [t for i, t in cases if i == r.doc_id]
        run = WORD.findall(source)[r.ref_start:r.ref_start + r.n_words]
        assert len(run) == r.n_words >= 13 and any(WORD.findall(t)[r.start:r.start + r.n_words] == run for t in own)
    kept = {r.doc_id: r.text for r in substrings.strip(df).collect()}
    assert kept[50] == " ".join(p[:13]) and kept[7] == "" and kept[1] is None
    assert substrings.report(docs_of(spark, [])).count() == 0


# -- sharding ------------------------------------------------------------------

def minimax(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards
    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_sharding(spark, shards):
    from quire.llm import sharding
    rng = np.random.default_rng(shards)
    cases = EDGE + [(1000 + k, "hot text") for k in range(300)] + [(2000 + k, "x" * int(rng.integers(0, 900)) + "é") for k in range(250)]
    got = sharding.assign(clashing(spark, cases, ["shard", "digest", "salt"]), shards).collect()
    assert len(got) == len(cases)
    groups = defaultdict(int)
    for _, t in cases:
        groups[(t or "").encode()] += len((t or "").encode()) + 16
    order = sorted(groups, key=lambda t: hashlib.sha256(t).digest())
    loads = defaultdict(int)
    for r in got:
        loads[r.shard] += r["size"]
    assert max(loads.values()) == minimax([groups[t] for t in order], shards) and max(loads) < shards
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in cases)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_sharding_empty_and_files(spark, tmp_path):
    from quire.llm import sharding
    assert sharding.assign(docs_of(spark, []), 5).count() == 0
    cases = [(k, prose(k, 30)) for k in range(50)]
    plan = sharding.write_shards(docs_of(spark, cases), 4, f"file://{tmp_path}/out").collect()
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert Counter((r.doc_id, r.shard, r.slot) for r in back.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in plan)


# -- byte-level BPE ------------------------------------------------------------

@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers as P
    import tiktoken
    from quire.llm import bpe
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, tokens, monkeypatch):
    from quire.llm import bpe
    ranks, pattern, library = tokens
    odd = ["it's We'LL", "　 a \u0085b\n\n  c\x1cd 漢字 🙂🙂 ١٢٣", "<|endoftext|>", "  lead", "tail  ", "\u00a0\u2003x", "z" * 700, "Ünïcödé" * 200,
           "".join(map(chr, range(1, 0x250))), "abc123def 1,000.50", "\r\n\t \n"]
    cases = EDGE + [(500 + i, t) for i, t in enumerate(odd)]
    for pieces in (bpe.BLOCK_PIECES, 50):
        monkeypatch.setattr(bpe, "BLOCK_PIECES", pieces)
        df = clashing(spark, cases, ["ids", "pieces", "words"])
        got = bpe.decode(bpe.encode(df, ranks, pattern), ranks).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in cases)
        assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in got) == Counter((i, t or "") for i, t in cases)
    got = bpe.encode(docs_of(spark, cases), ranks, pattern, digests=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter(map(tuple, got)) == Counter((i, len(e := library.encode_ordinary(t or "")), sha(",".join(map(str, e)).encode()),
                                                sha((t or "").encode())) for i, t in cases)
    assert bpe.encode(docs_of(spark, []), ranks, pattern).count() == 0


def test_bpe_plans_do_not_spell_out_tables(spark, tokens):
    """The driver keeps the text of many plans; tables of ranks and tokens have no place in them."""
    from quire.llm import bpe
    ranks, pattern, _ = tokens
    docs = docs_of(spark, [(1, "lorem ipsum thandering")])
    for df in (bpe.encode(docs, ranks, pattern, digests=True), bpe.decode(bpe.encode(docs, ranks, pattern), ranks)):
        assert df.count() == 1
        assert len(df._jdf.queryExecution().toString()) < 200_000


def test_components_of_chains_cycles_and_stars(spark):
    from quire.llm.graph import components
    links = [(i + 1, i) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (100, 101)] + [(200, x) for x in range(201, 230)] + [(300, 300)]
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert Counter(map(tuple, got)) == Counter([(x, 1) for x in range(1, 41)] + [(x, 100) for x in (100, 101, 102)] + [(x, 200) for x in range(200, 230)])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bpe_heap_equals_library(tokens):
    from quire.llm import bpe
    ranks, _, library = tokens
    for word in ("a" * 300, "thandering" * 40, "漢字" * 60, "aabbab" * 50):
        assert bpe.heap_merge(word.encode(), ranks) == library.encode_ordinary(word)


# -- toxicity ------------------------------------------------------------------

def test_toxicity(spark):
    from quire.llm import toxicity
    rng = np.random.default_rng(3)
    bad = ["grumblefuss", "nastyboots", "dreckling"]
    cases, labels = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.3)
        w = list(rng.choice([f"{a}{b}" for a in ("lor", "mip", "san", "teo", "vul") for b in ("em", "ist", "ora", "ude", "ix")], 30))
        if toxic:
            w[int(rng.integers(30))] = bad[i % 3]
        cases.append((i, " ".join(w) + "."))
        labels.append((i, 1, toxic))
    extra = [(900, None), (901, ""), (None, "grumblefuss"), (902, "lorem g.r.u.m.b.l.e.f.u.s.s misora"), (903, "mipude n a s t y b o o t s vulix"),
             (904, "lorem teoora " * 3000), (905, "teoist dreckxling lorem"), (906, "lorem misora vulix sanude")]
    labels += [(906, 1, None), (5000, 1, 1)]
    df = clashing(spark, cases + extra, ["score", "toxic"])
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, known).collect()}
    assert len(got) == len(cases) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for i, r in got.items() if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and not got[None].held_out and held
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[902].predicted and got[903].predicted and got[905].predicted
    assert not got[900].predicted and not got[904].predicted and got[900].score == got[901].score
    none = toxicity.score(df, known.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.score(df.limit(0), known).count() == 0
