"""Personal data (operator 11), by a skip-chain conditional random field.

**Mentions.** Base rules find addresses, network addresses, card and phone
numbers. Other *mentions* are number groups and spelled-out addresses
(``name [at] host dot org``) that no base span overlaps. Mentions are the
variables of the field; what is no mention is outside (so most words never
become variables). Their labels: ``none`` or one of the kinds.

**Potentials.** A mention's own potential comes from its shape: digits, groups,
separators, brackets, neighbours, the word before. The signs by which the base
rules decide (a leading plus, the checksum) are no features, or the model would
only repeat the rules. A kind that a mention's digits rule out (a checksum that
fails, a part over 255) has no potential. *Chain* edges join neighbouring
mentions. *Skip* edges join mentions of one document, however far apart, that
are alike: the same last nine digits, the same address or name part. All
edges of a kind share one table of potentials. A group of alike mentions is
joined to its first one and along the text, not pairwise, so edges grow with
mentions.

**Learning.** Base spans are the labels of their mentions, other mentions are
``none``; weights maximise the pseudo-likelihood (each mention given its shape
and its neighbours' labels) on at most ``TRAIN_ROWS`` documents, chosen by a hash
of their ids, around defaults that also hold when nothing is found there.

**Inference.** Base mentions are clamped to their kinds. ``ROUNDS`` rounds of loopy
sum-product messages, damped, run on the mentions of every document; a mention
with a marginal of ``LEAST`` or more for a kind becomes a span. So a number that
the base rules miss is found where the document writes it in full elsewhere, and
copies agree. Documents do not influence each other: results do not depend on
how rows are dealt.

Defined results: a null or empty text has no spans; rows with null ids and
repeated rows are rows of the result; empty tables work; other columns are
ignored. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hex_digest, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Documents that the weights are learned from, at most.
TRAIN_ROWS = 4_000
#: Bytes of text that are worked on at a time (one text, if that has more).
BLOCK_BYTES = 16_000_000
#: Rounds of message passing, share of the old message kept, least marginal of a span.
ROUNDS, DAMPING, LEAST = 12, 0.3, 0.5
#: Characters between mentions that a chain edge spans at most.
NEAR = 40
#: Buckets of the word before a mention.
WORDS = 32
NONE = 0
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

# ---------------------------------------------------------------- mentions
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = r"(?:\([0-9]{1,5}\)|[0-9]{1,5}(?![0-9]))"
_NUMBER = re.compile(rf"\+?(?:[0-9]{{6,}}|{_GROUP}(?:[\x20./-]{{1,2}}{_GROUP})*)")
_AT = re.compile(r"[\x20]?[\[({][\x20]?(?:at|AT|@)[\x20]?[\])}][\x20]?|\x20(?:at|AT)\x20")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{1,63})+")
_SPELLED = re.compile(r"[\x20]?[\[({]?[\x20]?\b(?:dot|DOT)\b[\x20]?[\])}]?[\x20]?|[\[({]\.[\])}]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            # the next address may not begin before this sign
            free = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' spans, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _DOTTED.finditer(text):
        if "." not in m[0]:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, 1, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _others(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str]]:
    """(start, end, form, normal) of mentions that no base span overlaps."""
    found = []
    for m in _AT.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, m.end())
        # a bare " at " counts only before a spelled-out host
        if start < m.start() and host and (m[0].strip().lower() != "at" or _SPELLED.search(host[0])):
            found.append((start, host.end(), "spelled", f"{text[start:m.start()]}@{_SPELLED.sub('.', host[0])}"))
    for m in _NUMBER.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 7:
            found.append((m.start(), m.end(), "number", m[0]))
    out, at, free = [], 0, 0
    for start, end, form, normal in sorted(found):
        while at < len(base) and base[at][2] <= start:
            at += 1
        # base spans are few around one place; those that begin before the mention ends may overlap
        if start >= free and not any(b[0] < end and b[2] > start for b in base[max(0, at - 4):at + 4]):
            out.append((start, end, form, normal))
            free = end
    return out


# ---------------------------------------------------------------- features
N_FEATURES = 64 + WORDS


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def describe(text: str, start: int, end: int, form: str, normal: str) -> tuple[list[int], list[bool], list[int]]:
    """Features that hold, labels that are possible, keys for skip edges."""
    groups = _DIGITS.findall(normal)
    digits = "".join(groups)
    n = len(digits)
    has = [0, 1 + min(n, 20) if form == "number" else 22]
    has.append(23 + min(len(groups), 6))
    marks = {c for c in normal if not c.isalnum() and c != "+"}
    has += [30 + i for i, c in enumerate(" .-()/@") if c in marks]
    has.append(38 + (not marks) + 2 * (len({len(g) for g in groups}) == 1))
    before = text[max(0, start - 24):start]
    after = text[end:end + 1]
    has += [42] * bool(before[-1:].isalnum()) + [43] * after.isalnum() + [44] * (before[-1:] in ("", "\n")) + [45] * (form == "spelled")
    has += [46 + min(len(groups[0]), 6), 53 + min(len(groups[-1]), 6)] if groups else []
    word = before.split()[-1:]
    has.append(64 + _hash("w", word[0].lower()) % WORDS if word else 60)
    if form == "number":
        dotted = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and not marks - set(" .")
        possible = [True, False, dotted, 12 <= n <= 19 and luhn(digits), 7 <= n <= 15]
        keys = [_hash("d", digits[-9:])]
    else:
        address = normal.lower()
        possible = [True, True, False, False, False]
        keys = [_hash("e", address), _hash("l", address.partition("@")[0])]
    return sorted(set(has)), possible, keys


def mentions(text: str) -> list[tuple]:
    """(start, end, label or -1, features, possible, keys) in order; the label is
    known for base spans."""
    base = base_spans(text)
    out = []
    for start, kind, end in base:
        form = "spelled" if kind == 0 else "number"
        out.append((start, end, kind + 1, *describe(text, start, end, form, text[start:end])))
    for start, end, form, normal in _others(text, base):
        out.append((start, end, -1, *describe(text, start, end, form, normal)))
    return sorted(out, key=lambda x: x[:3])


class Graph:
    """Mentions of many documents and the edges between them, as arrays."""

    def __init__(self, per_doc: list[list[tuple]]):
        flat = [m for doc in per_doc for m in doc]
        self.n = len(flat)
        self.doc = np.repeat(np.arange(len(per_doc)), [len(d) for d in per_doc])
        self.start = np.array([m[0] for m in flat], np.int64)
        self.end = np.array([m[1] for m in flat], np.int64)
        self.label = np.array([m[2] for m in flat], np.int64)
        self.x = np.zeros((self.n, N_FEATURES), np.float32)
        for i, m in enumerate(flat):
            self.x[i, m[3]] = 1
        self.possible = np.array([m[4] for m in flat], bool).reshape(-1, len(KINDS) + 1)
        node = np.array([i for i, m in enumerate(flat) for _ in m[5]], np.int64)
        key = np.array([k for m in flat for k in m[5]], np.int64)
        a = np.arange(self.n - 1)
        near = a[(self.doc[:-1] == self.doc[1:]) & (self.start[1:] - self.end[:-1] <= NEAR)] if self.n else a
        self.chain = np.stack([near, near + 1], 1) if len(near) else np.zeros((0, 2), np.int64)
        self.skip = self._alike(node, key)

    def _alike(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Alike mentions of one document: each with the first and the one before."""
        if not len(node):
            return np.zeros((0, 2), np.int64)
        order = np.lexsort((node, key, self.doc[node]))
        node, key = node[order], key[order]
        same = (key[1:] == key[:-1]) & (self.doc[node[1:]] == self.doc[node[:-1]])
        group = np.concatenate([[0], np.cumsum(~same)])
        first = node[np.searchsorted(group, group)]
        pairs = np.concatenate([np.stack([node[:-1], node[1:]], 1)[same], np.stack([first, node], 1)])
        return np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0).reshape(-1, 2)


# ---------------------------------------------------------------- model
def defaults() -> dict[str, np.ndarray]:
    """Potentials before learning: kinds are rare, alike mentions agree."""
    k = len(KINDS) + 1
    unary = np.zeros((N_FEATURES, k))
    unary[0, 1:] = -3.0
    unary[45, 1] = 4.0                       # a spelled-out address
    skip = np.eye(k) * 1.5
    skip[1:, 1:] += np.eye(k - 1) * 2.0
    return {"unary": unary, "chain": np.zeros((k, k)), "skip": skip}


def learn(graph: Graph, steps: int = 300, rate: float = 0.05, hold: float = 0.01) -> dict[str, np.ndarray]:
    """Weights of greatest pseudo-likelihood (Adam), held near the defaults."""
    start = defaults()
    if not graph.n:
        return start
    k = len(KINDS) + 1
    y = np.eye(k)[np.maximum(graph.label, NONE)]
    around = {"skip": np.zeros((graph.n, k)), "before": np.zeros((graph.n, k)), "after": np.zeros((graph.n, k))}
    for a, b in ((0, 1), (1, 0)):
        np.add.at(around["skip"], graph.skip[:, a], y[graph.skip[:, b]])
    np.add.at(around["before"], graph.chain[:, 1], y[graph.chain[:, 0]])
    np.add.at(around["after"], graph.chain[:, 0], y[graph.chain[:, 1]])
    # many alike neighbours are one vote of their mean, as far as learning goes
    around["skip"] /= np.maximum(around["skip"].sum(1, keepdims=True), 1)
    x = graph.x.astype(np.float64)
    barred = np.where(graph.possible | (y > 0), 0.0, -1e9)
    w = {n: v.copy() for n, v in start.items()}
    m = {n: np.zeros_like(v) for n, v in w.items()}
    v2 = {n: np.zeros_like(v) for n, v in w.items()}
    for t in range(1, steps + 1):
        z = x @ w["unary"] + around["skip"] @ w["skip"] + around["before"] @ w["chain"] + around["after"] @ w["chain"].T + barred
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = (p - y) / graph.n
        grad = {"unary": x.T @ d, "skip": around["skip"].T @ d, "chain": around["before"].T @ d + d.T @ around["after"]}
        grad["skip"] = (grad["skip"] + grad["skip"].T) / 2
        for n in w:
            g = grad[n] + hold * (w[n] - start[n]) / np.sqrt(graph.n)
            m[n] = 0.9 * m[n] + 0.1 * g
            v2[n] = 0.999 * v2[n] + 0.001 * g * g
            w[n] -= rate * (m[n] / (1 - 0.9 ** t)) / (np.sqrt(v2[n] / (1 - 0.999 ** t)) + 1e-8)
    return w


def marginals(graph: Graph, w: dict[str, np.ndarray]) -> np.ndarray:
    """Label probabilities of every mention by damped sum-product messages."""
    k = len(KINDS) + 1
    own = graph.x.astype(np.float64) @ w["unary"]
    own[~graph.possible] = -60.0
    known = graph.label >= 0
    own[known] = np.where(np.arange(k)[None] == graph.label[known][:, None], 0.0, -60.0)
    edges = [(graph.chain, w["chain"]), (graph.skip, w["skip"])]
    source = np.concatenate([x for e, _ in edges for x in (e[:, 0], e[:, 1])])
    target = np.concatenate([x for e, _ in edges for x in (e[:, 1], e[:, 0])])
    sizes = [len(e) for e, _ in edges for _ in (0, 1)]
    ends = np.cumsum([0, *sizes])
    tables = [t for _, p in edges for t in (p, p.T)]
    back = np.concatenate([np.arange(ends[i ^ 1], ends[(i ^ 1) + 1]) for i in range(4)]) if len(source) else source
    message = np.zeros((len(source), k))

    def beliefs():
        return own + np.stack([np.bincount(target, message[:, c], graph.n) for c in range(k)], 1) if len(source) else own

    for _ in range(ROUNDS if len(source) else 0):
        out = (beliefs()[source] - message[back])
        new = np.empty_like(message)
        for i in range(4):
            part = out[ends[i]:ends[i + 1]][:, :, None] + tables[i][None]
            top = part.max(1, keepdims=True)
            new[ends[i]:ends[i + 1]] = np.log(np.exp(part - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    b = beliefs()
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


# ---------------------------------------------------------------- jobs
def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right")) - at)
            yield batch.slice(at, n)
            at += n


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Weights from the mentions of at most ``rows`` documents."""
    order = F.xxhash64(F.col(key).cast("string"))
    ids = docs.select(order.alias("h")).where("h is not null")
    n = ids.count()
    # about twice as many rows as are wanted pass by the hash, whatever their texts
    share = min(1.0, 2.0 * rows / max(n, 1))
    line = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    picked = docs.where(order <= F.lit(line)).select(order.alias("h"), text_or_empty(text).alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [mentions(t) for t in part.column(1).to_pylist()]
            have = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_pydict({
                "h": part.column(0).take(pa.array(have, pa.int64())),
                "found": pa.array([[dict(zip(("start", "end", "label", "features", "possible", "keys"), m)) for m in found[i]] for i in have],
                                  pa.list_(_MENTION))})
    chosen = picked.mapInArrow(described, f"h bigint, found array<{_MENTION_SQL}>").orderBy("h", F.size("found")).limit(rows)
    per_doc = [[(m["start"], m["end"], m["label"], m["features"], m["possible"], m["keys"]) for m in x]
               for x in chosen.select("found").toArrow().column(0).to_pylist()]
    return learn(Graph(per_doc))


_MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int64()), ("features", pa.list_(pa.int64())),
                      ("possible", pa.list_(pa.bool_())), ("keys", pa.list_(pa.int64()))])
_MENTION_SQL = ("struct<start:bigint,end:bigint,label:bigint,features:array<bigint>,possible:array<boolean>,keys:array<bigint>>")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])


def find(texts: list[str], w: dict[str, np.ndarray]) -> list[list[dict]]:
    """Spans of each text, by start and kind."""
    per_doc = [mentions(t) for t in texts]
    graph = Graph(per_doc)
    out: list[list[dict]] = [[] for _ in texts]
    if not graph.n:
        return out
    p = marginals(graph, w)
    best = p[:, 1:].argmax(1) + 1
    base = graph.label > 0
    kind = np.where(base, graph.label, best)
    score = p[np.arange(graph.n), kind]
    for i in np.flatnonzero(base | (score >= LEAST)):
        out[graph.doc[i]].append({"kind": KINDS[kind[i] - 1], "start": int(graph.start[i]), "end": int(graph.end[i]),
                                  "base": bool(base[i]), "score": float(score[i])})
    for spans in out:
        spans.sort(key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, whether a base rule found it, the
    probability of its kind) of every row."""
    w = train(docs, text, key) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(find(part.column(1).to_pylist(), w), pa.list_(_SPAN))], names=["doc_id", "spans"])
    return docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[key]}, spans {SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The report of ``scan``: counts and digest of the base spans, all spans."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    return found.select("doc_id", *[count(k) for k in KINDS],
                        hex_digest(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[kind]`` (of spans that
    overlap, the earlier one)."""
    w = train(docs, text, key) if weights is None else weights

    def clean(t: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [t[at:s["start"]], f"[{s['kind']}]"]
                at = s["end"]
            else:
                at = max(at, s["end"])
        return "".join(out) + t[at:]

    @F.pandas_udf("string")
    def hide(texts):
        import pandas as pd
        values = [t if t is not None and t == t else "" for t in texts]
        return pd.Series([clean(t, s) for t, s in zip(values, find(values, w))], index=texts.index)
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), hide(F.col(text))))
