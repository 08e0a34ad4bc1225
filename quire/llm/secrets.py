"""Secret scans with multipart credential linking (operator 6, DataFrame functions only).

Every text is searched for parts of credentials. *Strong* parts (assignments of
a password, secret, token or key; access identifiers; long hexadecimal strings)
are reported as they stand. *Weak* parts say little alone: a user name, a
service address, a short assigned value, a long mixed token. They are reported
only when a part of a complementary role lies within the same scope
(``SCOPE`` characters between the two spans): a secret beside an identifier or
an address, and the other way round. Parts become rows, are placed in the bins
that their reach touches, and an interval semi-join on (document, bin) decides;
pairs are never built, and a document with very many parts is dealt out by bin.

Spans are code-point offsets, end exclusive, of the whole match. Defined
results: a null text is empty and an empty text has no span; equal texts have
equal spans; repeated rows each get theirs (rows are matched by id and text
hash, null ids included); an empty table gives an empty result; other columns
pass through ``redact`` unchanged and are ignored by ``scan``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, free_name, let, text_or_empty

#: Characters that may lie between two parts of one credential.
SCOPE = 120
#: Width of the bins of the interval join, in characters.
BIN = 256
#: Elements whose running sums one fold computes.
FOLD = 512

ID, SECRET, ENDPOINT = "id", "secret", "endpoint"


@dataclass(frozen=True)
class Kind:
    """A pattern and what it finds. ``least`` is the length that group ``group``
    of a match must have. Kinds are listed in the order spans are sorted by."""
    name: str
    pattern: str
    role: str
    weak: bool
    group: int = 0
    least: int = 0
    most: int = 1 << 30


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_USERS = "|".join(map(_either, ("username", "user", "login", "client_id", "account_id")))

BASE = (
    Kind("assign", ASSIGN, SECRET, False, 2, 6),
    # a run that reaches the length matches where the unbounded run would
    Kind("access", "AKIA[A-Z0-9]{16,}", ID, False),
    Kind("hex", "[0-9a-f]{24,}", SECRET, False),
)
LINKED = (
    Kind("user", rf"""({_USERS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", ID, True, 2, 3),
    Kind("endpoint", r"(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|s3)(?::[a-z]+)?://[A-Za-z0-9._:@/-]+", ENDPOINT, True),
    Kind("short", ASSIGN, SECRET, True, 2, 3, 5),
    Kind("mixed", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[^\x20\x09-\x0D]*[A-Z])(?=[^\x20\x09-\x0D]*[a-z])"
                  r"[A-Za-z0-9+/_-]{32,}", SECRET, True),
)


def prefix_sums(a: Column) -> Column:
    """Sums of all elements before each element. Folds run over blocks, so the
    copies they make stay small for long arrays too."""
    def fold(x):
        return F.aggregate(x, F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("o")),
                           lambda acc, v: F.struct((acc["s"] + v).alias("s"),
                                                   F.concat(acc["o"], F.array(acc["s"])).alias("o")))["o"]

    def blocks(x):
        starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(FOLD))
        return F.transform(starts, lambda s: F.slice(x, s, F.lit(FOLD)))

    def joined(bs):
        offsets = fold(F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, v: s + v)))
        return let(offsets, lambda o: F.flatten(F.transform(bs, lambda b, i: let(
            fold(b), lambda p: F.transform(p, lambda v: v + F.get(o, i))))))

    return F.when(F.size(a) <= FOLD, fold(a)).otherwise(let(blocks(a), joined))


def find(text: Column, kind: Kind, order: int) -> Column:
    """array<struct(start, order, end)> of the leftmost non-overlapping matches.

    The pieces between matches give the places: a match starts where all
    earlier pieces and matches end."""
    pattern = F.lit(kind.pattern)

    def placed(x):
        long_enough = lambda m: F.length(
            F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m).between(kind.least, kind.most)
        lengths = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"],
                             lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        spans = let(lengths, lambda ls: F.zip_with(
            prefix_sums(F.transform(ls, lambda v: (v["g"] + v["m"]).cast("long"))), ls,
            lambda before, v: F.struct((before + v["g"]).alias("start"), F.lit(order).alias("order"),
                                       (before + v["g"] + v["m"]).alias("end"))))
        if not kind.group:
            return spans
        both = F.zip_with(spans, x["found"], lambda s, m: F.struct(s.alias("s"), long_enough(m).alias("ok")))
        return F.transform(F.filter(both, lambda v: v["ok"]), lambda v: v["s"])

    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    return F.when(text.rlike(kind.pattern), let(F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, 0).alias("found")), placed)).otherwise(empty)


def _roles(kinds: tuple[Kind, ...], order: Column, of) -> Column:
    """Literal lookup of a kind's property by its place in the list."""
    out = F.lit(None)
    for i, k in enumerate(kinds):
        out = F.when(order == i, F.lit(of(k))).otherwise(out)
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id",
         base: tuple[Kind, ...] = BASE, linked: tuple[Kind, ...] = LINKED) -> DataFrame:
    """doc_id, text_hash, base (array of spans) and spans (base and linked ones),
    a row for each row of ``docs``; a span is struct(start, order, end, kind),
    sorted by start, then kind as listed."""
    kinds = base + linked
    t = text_or_empty(text)
    parts = cut_lineage(docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(t).alias("text_hash"),
        F.array_sort(F.concat(*[find(t, k, i) for i, k in enumerate(base)])).alias("base"),
        F.concat(*[find(t, k, len(base) + i) for i, k in enumerate(linked)]).alias("weak")), "secret-parts")

    some = parts.where(F.size("weak") > 0).dropDuplicates(["doc_id", "text_hash"]).select(
        "doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("p"))
    some = some.select("doc_id", "text_hash", "p", _roles(kinds, F.col("p.order"), lambda k: k.role).alias("role"),
                       _roles(kinds, F.col("p.order"), lambda k: k.weak).alias("weak"))

    def in_bins(df, reach):
        return df.withColumn("bin", F.explode(F.sequence(
            F.floor((F.greatest(F.col("p.start") - reach, F.lit(0))) / BIN), F.floor((F.col("p.end") + reach) / BIN))))

    w = in_bins(some.where("weak"), 0).alias("w")
    o = in_bins(some, SCOPE).alias("o")
    near = (F.col("o.p.start") <= F.col("w.p.end") + SCOPE) & (F.col("w.p.start") <= F.col("o.p.end") + SCOPE)
    complementary = (F.col("w.role") != F.col("o.role")) & ((F.col("w.role") == SECRET) | (F.col("o.role") == SECRET))
    linked_spans = w.join(o, F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.text_hash") == F.col("o.text_hash"))
                          & (F.col("w.bin") == F.col("o.bin")) & near & complementary, "left_semi")
    linked_spans = linked_spans.groupBy("doc_id", "text_hash").agg(F.collect_set("p").alias("more"))

    a, b = parts.alias("a"), linked_spans.alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    named = lambda c: F.transform(c, lambda s: F.struct(
        s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"),
        _roles(kinds, s["order"], lambda k: k.name).alias("kind")))
    everything = F.array_sort(F.concat(F.col("a.base"), F.coalesce(F.col("b.more"), F.array())))
    return out.select("a.doc_id", "a.text_hash", named(F.col("a.base")).alias("base"), named(everything).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from what ``scan`` returns."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k.name) for k in BASE],
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping or touching
    spans by one); a column n_chars, where there is one, follows the text."""
    found = scan(docs, text, key).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    h, s = free_name(docs, "text_hash"), free_name(docs, "spans")
    found = found.select(F.col("doc_id").alias("k_"), F.col("text_hash").alias("h_"), F.col("spans").alias("s_")).alias("f")
    d = docs.withColumn(h, F.xxhash64(text_or_empty(text))).alias("d")
    d = d.join(found, F.col(f"d.{key}").eqNullSafe(F.col("f.k_")) & (F.col(f"d.{h}") == F.col("f.h_")), "left")
    d = d.select("d.*", F.col("f.s_").alias(s)).drop(h)

    def reach(x):
        """Spans with the farthest end of all spans before them."""
        return F.aggregate(x, F.struct(F.lit(0).cast("long").alias("e"),
                                       F.array().cast("array<struct<a:bigint,b:bigint>>").alias("g")),
                           lambda acc, v: F.struct(
                               F.greatest(acc["e"], v["end"]).alias("e"),
                               F.when(v["start"] > acc["e"], F.concat(acc["g"], F.array(F.struct(
                                   acc["e"].alias("a"), v["start"].alias("b"))))).otherwise(
                                       F.when(F.size(acc["g"]) == 0, F.array(F.struct(
                                           F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))).otherwise(acc["g"])).alias("g")))

    t = text_or_empty(text)
    clean = let(reach(F.col(s)), lambda r: F.concat(
        F.array_join(F.transform(r["g"], lambda g: F.substr(t, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))), mark),
        F.lit(mark), F.substr(t, (r["e"] + 1).cast("int"))))
    d = d.withColumn(text, F.when(F.col(s).isNotNull(), clean).otherwise(F.col(text))).drop(s)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(
            F.length(text)).cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)
