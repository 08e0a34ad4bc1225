"""Toxicity by a subsequence string-kernel machine with Nyström landmarks
(operator 1).

*Kernel.* A word, with a mark before and after it, is described by all its
subsequences of three symbols within ``SPAN`` places; a subsequence that is
spread over d places counts ``DECAY ** d``. The kernel of two words is the
product of their descriptions, normalised by length, so an insult keeps most of
its likeness when characters are inserted or left out. Letters are folded to
lower case, other characters inside a word are skipped, and runs of single
letters are read as one word.

*Machine.* Landmarks are words of labelled sentences (the most telling ones and
others drawn at random). Nyström features (kernel with the landmarks, times the
inverse root of their kernel matrix) feed a linear machine with squared hinge
loss. Labels belong to whole sentences: a sentence of a toxic text is explained
by its highest-scoring words, which are chosen anew in each round. Because the
machine is linear in landmark kernels, its landmark expansion folds into one
weight for each subsequence, so a word is scored without visiting landmarks.

*Score.* A text's score is a calibrated probability from the highest word and
sentence scores and the number of telling words in the whole text, shifted so
that 0.3 is the cut that served the training rows best.

Labels are learnt from the whole texts of at most ``TRAIN_ROWS`` labelled ids (in
the order of a hash of the id; twice as many rows where ids repeat); this bound
is the only sample, every text is scored whole. Held-out rows (crc32 of the id as text
modulo 4 is 2) are never learnt from. Defined results: null and empty texts get
the score of a text without words; without labels of both kinds every score is
0; null ids are not held out; repeated rows get equal scores; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_or_empty

SPAN = 4
DECAY = 0.75
LANDMARKS = 256
TRAIN_ROWS = 3_000
TRAIN_WORDS = 5_000
ROUNDS = 3
CUT = 0.3
#: Characters scored at once.
SLICE = 1 << 20

SYMBOLS = 64
MARK = 63
_OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def _alphabet() -> np.ndarray:
    """Symbol of each code point of the basic plane: letters 1 to 62, white space
    and line ends -2, sentence ends -3, others -1 (skipped)."""
    out = np.full(1 << 16, -1, np.int8)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x) - 96 if "a" <= x <= "z" else 27 + (c * 7919 >> 3) % 36
        elif x.isspace():
            out[c] = -2
    return out


_CODES = _alphabet()
_ENDS = [ord(x) for x in ".!?\n"]


class Symbols:
    """Words of some texts as marked symbol strings: ``s`` (symbols), ``word``
    (its word), and for each word its text and sentence."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(t.lower().replace("\n", "\n ") for t in texts)
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(raw < (1 << 16), _CODES[np.minimum(raw, (1 << 16) - 1)], np.int8(-1))
        lengths = np.array([len(t.lower()) + t.lower().count("\n") + 1 for t in texts], np.int64)
        text_at = np.repeat(np.arange(len(texts)), lengths)[:len(codes)]
        end = np.isin(raw, np.array(_ENDS, np.uint32))
        # a sentence ends at a mark followed by white space, or at a line's end
        after = np.ones(len(raw), bool)
        after[:-1] = codes[1:] == -2
        sentence_at = np.cumsum((end & after) | (raw == 10)) - ((end & after) | (raw == 10))
        letters = np.flatnonzero(codes > 0)
        gap = np.cumsum(codes == -2)[letters] if len(letters) else np.zeros(0, np.int64)
        new = np.ones(len(letters), bool)
        new[1:] = gap[1:] != gap[:-1]
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(letters)))
        # runs of single letters within one text are one word
        single = size == 1
        same_text = np.zeros(len(starts), bool)
        if len(starts):
            same_text[1:] = text_at[letters[starts[1:]]] == text_at[letters[starts[:-1]]]
            keep = np.ones(len(starts), bool)
            keep[1:] = ~(single[1:] & single[:-1] & same_text[1:])
            starts = starts[keep]
        size = np.diff(np.append(starts, len(letters)))
        self.n = len(starts)
        self.size = size
        self.text = text_at[letters[starts]] if self.n else np.zeros(0, np.int64)
        self.sentence = sentence_at[letters[starts]] if self.n else np.zeros(0, np.int64)
        first = starts + 2 * np.arange(self.n)
        self.s = np.full(len(letters) + 2 * self.n, MARK, np.int32)
        word = np.repeat(np.arange(self.n), size)
        self.s[np.arange(len(letters)) + 2 * word + 1] = codes[letters]
        self.word = np.repeat(np.arange(self.n), size + 2)
        self.first = first
        self.raw, self.letters, self.starts = raw, letters, starts

    def strings(self) -> list[str]:
        chars = "".join(map(chr, self.raw[self.letters].tolist()))
        ends = np.append(self.starts[1:], len(self.letters))
        return [chars[a:b] for a, b in zip(self.starts.tolist(), ends.tolist())]

    def triples(self):
        """(places, codes, weight) for each spread of three symbols."""
        n = len(self.s)
        for a, b in _OFFSETS:
            if n <= b:
                continue
            at = np.flatnonzero(self.word[b:] == self.word[:n - b])
            yield at, (self.s[at] * SYMBOLS + self.s[at + a]) * SYMBOLS + self.s[at + b], DECAY ** b

    def norm(self) -> np.ndarray:
        """Length normalisation of each word."""
        m = (self.size + 2).astype(np.float32)
        total = sum(np.maximum(m - b, 0) * np.float32(DECAY ** (2 * b)) for _, b in _OFFSETS)
        return 1 / np.sqrt(np.maximum(total, 1e-6))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.s), np.float32)
        for at, codes, w in self.triples():
            sums[at] += weights[codes] * np.float32(w)
        return np.add.reduceat(sums, self.first) * self.norm() if self.n else np.zeros(0, np.float32)


def _slices(texts: list[str]):
    """(a, b) of runs of texts with about ``SLICE`` characters."""
    a = 0
    while a < len(texts):
        total, b = 0, a
        while b < len(texts) and (b == a or total + len(texts[b]) <= SLICE):
            total += len(texts[b])
            b += 1
        yield a, b
        a = b


#: How much less than the word itself each of its disguises counts in training.
DISGUISE = 4


def _disguised(word: str) -> list[str]:
    """The word with one character more (at a few inner places) or one less."""
    n = len(word)
    if n < 5:
        return []
    at = sorted({2, n // 2, n - 2})
    return [word[:k] + "x" + word[k:] for k in at] + [word[:k] + word[k + 1:] for k in sorted({n // 2, n - 2})]


def _sparse(words: list[str]):
    """(word, code, value) of the normalised descriptions."""
    x = Symbols(words)
    norm = x.norm()
    rows, codes, values = [], [], []
    for at, c, w in x.triples():
        rows.append(x.text[x.word[at]])
        codes.append(c)
        values.append(w * norm[x.word[at]])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(values).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray          # one for each subsequence of three symbols
    bias: float
    calibration: np.ndarray      # of the text features, intercept last

    def features(self, texts: list[str]) -> np.ndarray:
        """Highest word, mean of the three highest sentences, telling words (log,
        and per word), words (log)."""
        out = np.zeros((len(texts), 5), np.float64)
        out[:, :2] = -1.5
        for a, b in _slices(texts):
            x = Symbols(texts[a:b])
            if x.n:
                f = np.clip(x.scores(self.weights) + self.bias, -1.5, 1.5)
                doc = x.text
                head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                own = doc[head] + a
                count = np.diff(np.append(head, len(doc)))
                out[own, 0] = np.maximum.reduceat(f, head)
                sentence = np.flatnonzero(np.append(True, (x.sentence[1:] != x.sentence[:-1]) | (doc[1:] != doc[:-1])))
                best, of = np.maximum.reduceat(f, sentence), doc[sentence]
                order = np.lexsort((-best, of))
                best, of = best[order], of[order]
                rank = np.arange(len(of)) - np.searchsorted(of, of)
                top = rank < 3
                out[:, 1][a:b] = np.bincount(of[top], best[top], b - a) / np.maximum(np.bincount(of[top], minlength=b - a), 1)
                out[np.setdiff1d(np.arange(a, b), own), 1] = -1.5
                telling = np.add.reduceat((f > 0).astype(np.float64), head)
                out[own, 2], out[own, 3], out[own, 4] = np.log1p(telling), telling / count, np.log1p(count)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.features(texts) @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 15) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    v = np.zeros(x.shape[1])
    for _ in range(steps):
        margin = 1 - y * (x @ v)
        on = margin > 0
        grad = v - 2 * c * x[on].T @ (weight[on] * margin[on] * y[on])
        hess = np.eye(len(v)) + 2 * c * (x[on] * weight[on, None]).T @ x[on]
        step = np.linalg.solve(hess, grad)
        v = v - step
        if np.abs(step).max() < 1e-6:
            break
    return v


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        reg = np.full(len(v), ridge)
        reg[-1] = 1e-3
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(reg), x.T @ (p - y) + reg * v)
        v -= step
        if np.abs(step).max() < 1e-8:
            break
    return v


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> Model | None:
    """Model from labelled texts; None without both labels."""
    y = np.asarray(labels)
    if not len(y) or not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    ids, parts, done = {}, [], 0
    for a, b in _slices(texts):
        x = Symbols(texts[a:b])
        parts.append(np.array([[ids.setdefault(w, len(ids)) for w in x.strings()], x.sentence + done, x.text + a], np.int32).T)
        done += int(x.sentence.max()) + 1 if x.n else 0
    found = pd.DataFrame(np.concatenate(parts), columns=["w", "s", "d"])
    if not len(found):
        return None
    vocabulary = np.array(list(ids), dtype=object)
    pairs = found[["w", "d"]].drop_duplicates()
    pairs["y"] = y[pairs.d.to_numpy()]
    seen = pairs.groupby("w").y.agg(["sum", "count"]).sort_index()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    odds = np.log((seen["sum"] + 0.25) / (n1 + 0.5)) - np.log((seen["count"] - seen["sum"] + 0.25) / (n0 + 0.5))
    # telling words are frequent among toxic texts and rare among others
    telling = (odds * np.sqrt(seen["sum"])).sort_values(ascending=False, kind="stable")
    top = list(telling.index[:LANDMARKS // 2][(telling.iloc[:LANDMARKS // 2] > 0).to_numpy()])
    clean = seen[seen["sum"] == 0]
    others = clean.index.to_numpy()
    drawn = rng.choice(len(others), min(len(others), LANDMARKS - len(top)), replace=False, p=(
        clean["count"] / clean["count"].sum()).to_numpy()) if len(others) else []
    landmarks = top + [others[i] for i in drawn]

    # training words: the candidates of toxic sentences, and words of clean texts by frequency
    score0 = (odds * np.sqrt(np.maximum(seen["sum"], 1e-9))).to_numpy()
    toxic_words = telling.index[:2 * LANDMARKS][(telling.iloc[:2 * LANDMARKS] > 0).to_numpy()].to_numpy()
    p = (seen["count"] - seen["sum"]).to_numpy(np.float64) ** 0.5
    some = min(TRAIN_WORDS, int((p > 0).sum()))
    negative = seen.index.to_numpy()[rng.choice(len(p), some, replace=False, p=p / p.sum())] if some else np.array([], np.int64)
    rare = pairs[(pairs.y == 1) & (seen["count"].to_numpy()[pairs.w] <= 2)].w.drop_duplicates().to_numpy()
    rare = rare[rng.permutation(len(rare))[:TRAIN_WORDS // 4]]
    train = pd.unique(np.concatenate([toxic_words, negative, rare]))

    lr, lc, lv = _sparse(list(vocabulary[landmarks]))
    codes = np.unique(lc)
    basis = np.zeros((len(landmarks), len(codes)), np.float32)
    np.add.at(basis, (lr, np.searchsorted(codes, lc)), lv)
    km = basis.astype(np.float64) @ basis.T
    value, vector = np.linalg.eigh(km)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    def nystrom(chosen):
        out = np.zeros((len(chosen), root.shape[1]), np.float32)
        for a in range(0, len(chosen), 256):
            part = list(chosen[a:a + 256])
            r, c, v = _sparse(part)
            at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            hit = codes[at] == c
            dense = np.zeros((len(part), len(codes)), np.float32)
            np.add.at(dense, (r[hit], at[hit]), v[hit])
            out[a:a + 256] = dense @ basis.T @ root.astype(np.float32)
        return out

    features = nystrom(vocabulary[train])
    bad = found[y[found.d.to_numpy()] == 1].drop_duplicates(["w", "s"])
    clean_count = (seen["count"] - seen["sum"]).to_numpy(np.float64)
    f = score0
    weights, bias = np.zeros(SYMBOLS ** 3, np.float32), 0.0
    for _ in range(ROUNDS):
        # the sentences of each toxic text that look worst are explained by their highest words
        own = bad.assign(f=f[bad.w.to_numpy()]).sort_values(["d", "f", "w"], ascending=[True, False, True])
        witness = own.groupby("d").head(3)
        evidence = np.bincount(witness.w, minlength=len(vocabulary)).astype(np.float64)
        # clean words that look toxic so far join the training words
        hard = np.argsort(-np.where(clean_count > 0, f, -np.inf), kind="stable")[:TRAIN_WORDS // 2]
        extra = np.setdiff1d(np.concatenate([hard[clean_count[hard] > 0], np.flatnonzero(evidence > 1)]), train)
        train, features = np.concatenate([train, extra]), np.concatenate([features, nystrom(vocabulary[extra])])
        pos_weight, neg_weight = evidence[train], clean_count[train]
        share = pos_weight / np.maximum(pos_weight + neg_weight * (n1 / n0), 1e-9)
        pos, neg = np.flatnonzero((pos_weight > 0) & (share > 0.5)), np.flatnonzero(neg_weight > 0)
        if not len(pos) or not len(neg):
            return None
        wp, wn = np.sqrt(pos_weight[pos]), np.sqrt(neg_weight[neg])
        # telling words also stand for themselves with a character more or less
        spelled = [(x, wp[k] / DISGUISE) for k, w in enumerate(vocabulary[train[pos]]) if pos_weight[pos[k]] > 1
                   for x in _disguised(w) if x not in ids]
        z = np.concatenate([features[pos], nystrom([x for x, _ in spelled]), features[neg]])
        t = np.concatenate([np.ones(len(pos) + len(spelled)), -np.ones(len(neg))])
        wp = np.concatenate([wp, [x for _, x in spelled]])
        v = _machine(z, t, np.concatenate([wp / wp.sum(), wn / wn.sum()]) * 200)
        weights[codes] = basis.T.astype(np.float64) @ (root @ v[:-1])
        bias = float(v[-1])
        f = np.concatenate([Symbols(list(vocabulary[a:a + 50_000])).scores(weights) for a in range(0, len(vocabulary), 50_000)]) + bias
    model = Model(weights, bias, np.zeros(6))
    feats = model.features(texts)
    model.calibration = _logistic(feats, y.astype(np.float64))
    p = model.score(texts)
    best, cut = -1.0, 0.5
    for c in np.linspace(0.05, 0.95, 91):
        said = p >= c
        both = (said & (y == 1)).sum()
        f1 = 2 * both / max(1, said.sum() + (y == 1).sum())
        if f1 > best:
            best, cut = f1, c
    model.calibration[-1] += np.log(CUT / (1 - CUT)) - np.log(cut / (1 - cut))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
                  rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """At most ``rows`` labelled rows that are not held out, by a hash of the id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k_")).agg(
        F.max(label).alias("y"))
    known = known.where(F.pmod(F.crc32(F.col("k_").cast("string")), F.lit(4)) != 2)
    d = docs.select(F.col(key).alias("k_"), F.col(text).alias("t"))
    chosen = known.orderBy(F.xxhash64("k_"), "k_").limit(rows)
    return d.join(F.broadcast(chosen), "k_").orderBy("k_", "t").limit(2 * rows).toPandas()


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    spark = docs.sparkSession
    sample = training_rows(docs, labels, text, key, label)
    model = fit(sample.t.tolist(), sample.y.to_numpy()) if len(sample) else None
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select(F.col(key).alias("doc_id"), held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(texts.tolist()))

    out = docs.select(F.col(key).alias("doc_id"), held, scored(text_or_empty(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
