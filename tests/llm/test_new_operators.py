"""Operators 11 to 13 against brute force on small tables, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import collocations, hard_negatives, pii

DOCS = "doc_id long, text string, lang string, words string, label int"


# ---------------------------------------------------------------- 11
PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                    "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_equal_the_patterns(seed):
    rnd = random.Random(seed)
    bits = ["a", "b.c", "@", "x@y.z", "é", " ", "\n", "+", "1", "44", "256", "1.2.3.4", ".", "-", "(", ")", "4845168114407329", "+1 (017) 555-7713",
            "0000255.1.1.1", "a@b", "@@", "a@b.c@d.e", "12 34", "1.2.3.4.5.6.7.8"]
    for _ in range(400):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), repr(text)


def test_messages_equal_enumeration_on_a_tree():
    texts = ["a +1 (017) 555-7713 b 0175557713 c (017) 555-7713", "12345678 x 4845.1681.1440.7329"]
    graph = pii.Graph([pii.mentions(t) for t in texts])
    w = pii.defaults()
    rnd = np.random.default_rng(3)
    w = {k: v + rnd.normal(0, 0.4, v.shape) for k, v in w.items()}
    w["skip"] = (w["skip"] + w["skip"].T) / 2
    graph.chain = graph.chain[:0]
    graph.skip = graph.skip[:2]               # a tree: messages are exact
    got = pii.marginals(graph, w)
    k = len(pii.KINDS) + 1
    own = graph.x @ w["unary"]
    total, sums = 0.0, np.zeros((graph.n, k))
    for y in itertools.product(range(k), repeat=graph.n):
        if any(graph.label[i] >= 0 and graph.label[i] != y[i] or graph.label[i] < 0 and not graph.possible[i, y[i]] for i in range(graph.n)):
            continue
        p = math.exp(sum(own[i, y[i]] for i in range(graph.n) if graph.label[i] < 0) + sum(w["skip"][y[a], y[b]] for a, b in graph.skip))
        total += p
        for i in range(graph.n):
            sums[i, y[i]] += p
    assert np.allclose(got, sums / total, atol=1e-3)


def test_gradient_lowers_the_loss_and_learns_kinds():
    texts = [f"tel {i} +1 (0{10 + i}) 555-{1000 + i} order {10000000 + i} end" for i in range(60)]
    w = pii.learn(pii.Graph([pii.mentions(t) for t in texts]))
    found = pii.find(["tel (017) 555-7713 order 12345678 end"], w)[0]
    assert [(s["kind"], s["base"]) for s in found] == [("phone", False)]


def test_skip_edges_carry_a_kind_to_copies():
    w = pii.defaults()
    far = "filler words " * 400
    with_evidence, without = pii.find([f"+1 (017) 555-7713 {far} 0175557713", f"{far} 0175557713"], w)
    assert [(s["kind"], s["base"]) for s in with_evidence] == [("phone", True), ("phone", False)]
    assert without == []
    # many copies: edges grow with mentions
    graph = pii.Graph([pii.mentions("0175557713 x " * 500)])
    assert graph.n == 500 and len(graph.skip) <= 2 * graph.n


def test_pii_edges(spark):
    rows = [(1, None, "en", "a", 1), (2, "", None, None, None), (None, "x@y.zz", "en", "b", 0), (3, "x@y.zz", "en", "b", 0),
            (3, "x@y.zz", "en", "b", 0), (4, "é" * 50 + " 10.0.0.1 " + "z" * 200_000 + " 10.0.0.256", "en", "c", 0),
            (5, "joe at host dot org, joe [at] host.org", "en", "", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).withColumn("start", F.lit(2))
    got = sorted(((r.doc_id or -1), r.n_email, r.n_ip, r.spans, r.base_sha256) for r in pii.digest(pii.scan(df)).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (1, 0, 0, "", empty) and got[2] == (2, 0, 0, "", empty)
    assert [g[3] for g in got if g[0] in (-1, 3)] == ["email:0:6"] * 3
    assert [g for g in got if g[0] == 4][0][1:4] == (0, 1, "ip:51:59")
    assert [g for g in got if g[0] == 5][0][1:3] == (0, 0)
    assert pii.digest(pii.scan(df.limit(0))).count() == 0
    hidden = {r.doc_id: r.text for r in pii.redact(df.where("doc_id in (1, 3)")).collect()}
    assert hidden == {1: None, 3: "[email]"}


# ---------------------------------------------------------------- 12
def brute_negatives(rows, anchors, k=5):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None
          and all(x is not None and math.isfinite(x) for x in r[2])]
    q = [[math.floor(256 * x) for x in r[2]] for r in ok]
    out = []
    for a in range(len(ok)):
        if not anchors(ok[a][0]):
            continue
        s = [(-sum(x * y for x, y in zip(q[a], q[b])), ok[b][0], ok[b][1]) for b in range(len(ok)) if len(q[b]) == len(q[a])]
        for sp, p, _ in sorted(x for x in s if x[2] == ok[a][1] and x[1] != ok[a][0])[:k]:
            window = sorted(x for x in s if x[2] != ok[a][1] and -80 * sp <= -100 * x[0] <= -100 * sp)[:k]
            out += [(ok[a][0], p, i + 1, n, -sp, -sn) for i, (sn, n, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("seed,block", [(1, 16_384), (2, 2), (3, 5)])
def test_hard_negatives(spark, seed, block):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(3), [rnd.choice([-0.5, 0.0, 0.25, 0.5, rnd.random()]) for _ in range(4)]) for i in range(90)]
    rows += [(7, 0, rows[7][2]), (7, 0, rows[7][2]), (20, 1, rows[3][2])]                       # repeated ids
    rows += [(100 + i, i % 2, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]                          # one vector holds a third
    rows += [(200, None, [1.0] * 4), (201, 1, None), (202, 1, [None] * 4), (203, 1, [float("nan")] * 4), (204, 1, [float("inf")] * 4),
             (None, 1, [1.0] * 4), (205, 1, [1.0, 1.0]), (210, 1, [1.0, 0.5]), (206, 2, []), (207, 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit(1)).withColumn("anchor", F.lit(1)).repartition(5)
    got = hard_negatives.mine(df, df.where("vec_id % 10 = 0"), block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_edges(spark):
    schema = "vec_id long, label int, embedding array<double>"
    empty = spark.createDataFrame([], schema)
    assert hard_negatives.mine(empty).count() == 0
    big = [(0, 0, [3e6, 1.0]), (1, 0, [2e6, 1.0]), (2, 1, [1.9e6, 2.0]), (3, 1, [1.0, 1.0])]     # products beyond 2^53
    df = spark.createDataFrame(big, schema)
    assert sorted(tuple(r) for r in hard_negatives.mine(df).collect()) == brute_negatives(big, lambda i: True)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, 0, [1e12]), (1, 0, [1e12])], schema)).count()


# ---------------------------------------------------------------- 13
def brute_phrases(rows, least, top, cover=100):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][w[i:i + k]] += 1
    out = []
    for lang, c in f.items():
        kept = [g for g, a in c.items() if len(g) > 1 and a >= least]
        gone = {g[i:i + k] for g in kept for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * c[g] >= cover * c[g[i:i + k]]}
        rows = []
        for g in set(kept) - gone:
            s, k = min((1000 * c[g] * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-s, -c[g], " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, left, right, n[lang], -s) for i, (s, a, g, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed,least,top,cover", [(1, 3, 2000, 100), (2, 2, 7, 100), (3, 3, 2000, 60)])
def test_collocations(spark, monkeypatch, seed, least, top, cover):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 60)
    rnd = random.Random(seed)
    words = ["a", "B", "b", "cé", "Cé", "d\x01", "e", "A"]
    rows = [("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for _ in range(rnd.randint(0, 25))),
             rnd.choice(["en", "en", None, "und", "x\ty", ""])) for _ in range(60)]
    rows += [("the same words again and again", "en")] * 30 + [(None, "en"), ("", None), (" ,. ", "fr"), ("z " * 3000, "en")]
    df = spark.createDataFrame([(i, t, lang, "w", 1) for i, (t, lang) in enumerate(rows)], DOCS).withColumn("f", F.lit(1)).repartition(4)
    got = collocations.mine(df, least, top, cover)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, top, cover)


def test_collocations_empty(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS), 1).count() == 0
