"""Operators over document sets (P*, M*, A2, A3, J4, Q2, Q3).

Flat forms work on ``DocumentSet`` element tables with joins and partial
aggregates, so a huge document is spread over many tasks. Nested forms are
column expressions on one document per row (no shuffle at all).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quire.functions import nested as N
from quire.functions.text import blank_label
from quire.operators.ordering import ordered_rank
from quire.session import dealt
from quire.sources.documents import DocumentSet


# ------------------------------------------------------------ P1 - P3, P6, P7
def flatten_entities(ds: DocumentSet, kind: str) -> DataFrame:
    """P1 (flat form): one row per element of the documents that exist, ``pos``
    counted from 0 within its array."""
    df = ds.kind(kind).join(ds.header.select("doc_id"), "doc_id", "left_semi")
    if "deal_id" in df.columns:
        at = F.row_number().over(Window.partitionBy("doc_id", "deal_id").orderBy("pos")) - 1
        return df.withColumn("pos", at.cast("bigint"))
    ranked = ordered_rank(df, "doc_id", "pos", "_at")
    return ranked.withColumn("pos", F.col("_at") - 1).drop("_at")


def element_lookup(ds: DocumentSet, kind: str, keys: DataFrame) -> DataFrame:
    """Every element whose (doc_id, id) is in ``keys`` (all matches: ids
    need not be unique). A semi join, so duplicate keys do not duplicate."""
    return ds.kind(kind).join(keys.select("doc_id", "id"), ["doc_id", "id"], "left_semi")


def documents_with(ds: DocumentSet, kind: str, pred: Column, negate: bool = False) -> DataFrame:
    """``[not] exists`` an element matching ``pred``; a document without
    the array counts as having none."""
    hits = ds.kind(kind).where(pred).select("doc_id")
    how = "left_anti" if negate else "left_semi"
    return ds.header.select("doc_id").join(hits, "doc_id", how)


def has_element_flag(ds: DocumentSet, kind: str, pred: Column, name: str) -> DataFrame:
    """P3 as a flag per document (exists -> true, else false)."""
    hits = ds.kind(kind).where(pred).select("doc_id").distinct().withColumn(name, F.lit(True))
    return ds.header.select("doc_id").join(hits, "doc_id", "left") \
             .select("doc_id", F.coalesce(F.col(name), F.lit(False)).alias(name))


def blank_labels(ds: DocumentSet, kind: str, field: str, name: str) -> DataFrame:
    """``coalesce(nullif(field, ''), '(vazio)')`` per element."""
    return ds.kind(kind).select("doc_id", "id", blank_label(field).alias(name))


def first_transition_author(nested: DataFrame) -> DataFrame:
    """P7 (nested): ``historico->0->>'quem'`` per deal; NULL when empty."""
    d = nested.select("doc_id", F.explode(F.col("doc.deals")).alias("d"))
    return d.select("doc_id", F.col("d.id").alias("deal_id"), N.first_field("d.historico", "quem").alias("who"))


def first_transition_author_flat(ds: DocumentSet) -> DataFrame:
    """P7 (flat): the author of the lowest-``pos`` transition of each deal
    (partial ``min_by``), NULL for deals without transitions."""
    first = ds.transitions.groupBy("doc_id", "deal_id").agg(F.min_by("quem", "pos").alias("who"))
    return ds.deals.select("doc_id", F.col("id").alias("deal_id")).join(first, ["doc_id", "deal_id"], "left")


# ------------------------------------------------------------ A2 / A3
KINDS = ("partners", "customers", "deals")


def entity_counts(ds: DocumentSet) -> DataFrame:
    """A2 (flat): array lengths per document plus version and author.

    Per-kind partial counts, joined on doc_id with the header."""
    out = ds.header.select("doc_id", "version", "updated_by")
    for k in KINDS:
        c = ds.kind(k).groupBy("doc_id").agg(F.count(F.lit(1)).alias(k))
        out = out.join(c, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias(k) for k in KINDS],
                      "version", "updated_by")


def entity_counts_nested(nested: DataFrame) -> DataFrame:
    """A2 (nested): ``jsonb_array_length`` of the three arrays."""
    return nested.select("doc_id", *[N.array_len(F.col("doc")[k]).alias(k) for k in KINDS],
                         "version", "updated_by")


def blocking_items(ds: DocumentSet) -> DataFrame:
    """A3 (flat): open items and blocking ones per deal; zero-item deals stay.
    Items are pre-aggregated per deal before the join."""
    agg = ds.items.groupBy("doc_id", "deal_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("bloqueante")).alias("blocking"))
    deals = ds.deals.select("doc_id", F.col("id").alias("deal_id"))
    return deals.join(agg, ["doc_id", "deal_id"], "left").select(
        "doc_id", "deal_id", F.coalesce("items", F.lit(0)).cast("bigint").alias("items"),
        F.coalesce("blocking", F.lit(0)).cast("bigint").alias("blocking"))


def blocking_items_nested(nested: DataFrame) -> DataFrame:
    """A3 (nested): ``size`` (NULL for a missing array) and a correlated count via
    higher-order filter."""
    d = nested.select("doc_id", F.explode(F.col("doc.deals")).alias("d"))
    return d.select("doc_id", F.col("d.id").alias("deal_id"),
                    N.array_len("d.pendencias").alias("items"),
                    N.count_where("d.pendencias", lambda p: F.coalesce(p["bloqueante"], F.lit(False))).alias("blocking"))


# ------------------------------------------------------------ J4
def deal_customers(ds: DocumentSet) -> DataFrame:
    """J4 generalised: each deal with the customer it references in the same
    document (equi-join on doc_id and customer id) and its open-item counts,
    value label and creator - the 12 columns of the change script's check."""
    c = ds.customers.select("doc_id", F.col("id").alias("cliente_id"), F.col("nome").alias("cliente"),
                            F.col("setor"))
    d = ds.deals.select("doc_id", F.col("id").alias("negocio_id"), "frente", "etapa", "publico",
                        "responsavel", blank_label("valor").alias("valor"), F.col("clienteId"))
    counts = blocking_items(ds).withColumnRenamed("deal_id", "negocio_id")
    who = first_transition_author_flat(ds).select("doc_id", F.col("deal_id").alias("negocio_id"),
                                                  F.col("who").alias("criado_por"))
    j = d.join(c, (d["doc_id"] == c["doc_id"]) & (d["clienteId"] == c["cliente_id"]), "inner").drop(c["doc_id"])
    j = j.join(counts, ["doc_id", "negocio_id"], "left").join(who, ["doc_id", "negocio_id"], "left")
    return j.select("doc_id", "cliente_id", "cliente", "setor", "negocio_id", "frente", "etapa", "publico",
                    "responsavel", "valor", F.col("items").alias("pendencias"),
                    F.col("blocking").alias("bloqueantes"), "criado_por")


def deal_customer_check(ds: DocumentSet, pairs: DataFrame) -> DataFrame:
    """J4 as the change script asks it: for each (doc_id, deal_id, customer_id) of
    ``pairs``, the deal and the customer with these two ids - the deal's own
    customer reference is not used - in the 12 columns of the check. What lies
    inside deals is filtered by the pairs first, so nothing is crossed."""
    p = pairs.select("doc_id", F.col("deal_id").alias("negocio_id"), F.col("customer_id").alias("cliente_id")).distinct()
    c = ds.customers.select("doc_id", F.col("id").alias("cliente_id"), F.col("nome").alias("cliente"), "setor")
    d = ds.deals.select("doc_id", F.col("id").alias("negocio_id"), "frente", "etapa", "publico", "responsavel",
                        blank_label("valor").alias("valor"))
    keys = ["doc_id", "negocio_id"]
    asked = p.select(*keys).distinct()
    items, who = F.count(F.lit(1)).alias("pendencias"), F.min_by("quem", "pos").alias("criado_por")
    blocking = F.count_if(F.col("bloqueante")).alias("bloqueantes")


    def per_deal(df, *aggs):
        return df.withColumnRenamed("deal_id", "negocio_id").groupBy(*keys).agg(*aggs)
    named = asked.withColumnRenamed("negocio_id", "deal_id")
    both = ds.items_with_transitions(named, ["bloqueante"], ["pos", "quem"])
    if both is not None:
        inside = [per_deal(both, items, blocking, who)]
    else:
        of = ["doc_id", "deal_id"]
        inside = [per_deal(ds.items.join(named, of, "left_semi"), items, blocking), per_deal(ds.transitions.join(named, of, "left_semi"), who)]
    j = p.join(d, keys).join(c, ["doc_id", "cliente_id"])
    for one in inside:
        j = j.join(one, keys, "left")
    return j.select("doc_id", "cliente_id", "cliente", "setor", "negocio_id", "frente", "etapa", "publico", "responsavel", "valor",
                    *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("pendencias", "bloqueantes")], "criado_por")


# ------------------------------------------------------------ M1 - M5 (flat)
def append_if_absent(ds: DocumentSet, new_customers: DataFrame, new_deals: DataFrame) -> tuple[DocumentSet, DataFrame]:
    """M1: per document, append the new customer *and* the new deal unless a
    deal with the new deal's id already exists (only deals are checked, so
    an existing customer id is duplicated). Patches for documents that do
    not exist change nothing. Returns the new set and (doc_id, appended)."""
    exists = ds.deals.select("doc_id", "id").join(new_deals.select("doc_id", "id"), ["doc_id", "id"], "left_semi") \
                     .select("doc_id").distinct()
    go = new_deals.select("doc_id").distinct().join(ds.header.select("doc_id"), "doc_id", "left_semi") \
                  .join(exists, "doc_id", "left_anti")
    def add(kind: str, new: DataFrame) -> DataFrame:
        cur = ds.kind(kind)
        tail = cur.groupBy("doc_id").agg(F.max("pos").alias("_m"))
        n = new.join(go, "doc_id", "left_semi").join(tail, "doc_id", "left")
        n = n.withColumn("pos", F.coalesce(F.col("_m"), F.lit(-1)) + F.col("_k")).drop("_m", "_k")
        return cur.unionByName(n.select(*cur.columns))
    out = ds.with_kind("customers", add("customers", new_customers)).with_kind("deals", add("deals", new_deals))
    report = new_deals.select("doc_id").distinct().join(go.withColumn("appended", F.lit(True)), "doc_id", "left") \
                      .select("doc_id", F.coalesce("appended", F.lit(False)).alias("appended"))
    return out, report


def merged_patches(patches: DataFrame) -> DataFrame:
    """One patch per (doc_id, id): later keys win over earlier ones."""
    order = F.col("seq") if "seq" in patches.columns else F.to_json("patch")
    one = patches.groupBy("doc_id", "id").agg(F.sort_array(F.collect_list(F.struct(
        order.alias("o"), F.map_entries("patch").alias("e")))).alias("_all"))
    empty = F.create_map().cast("map<string,string>")

    def later(acc, x):
        p = F.map_from_entries(x["e"])
        return F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(p, k)), p)
    return one.select("doc_id", "id", F.aggregate("_all", empty, later).alias("patch"))


def patch_elements(ds: DocumentSet, kind: str, patches: DataFrame) -> DocumentSet:
    """M2: shallow right-wins merge ``e || patch`` for the element with the
    patch's (doc_id, id); ``patch`` is a map<string,string> column - a key
    present with a NULL value sets the field to NULL, a key ``id`` renames the
    element. Several patches of one element are merged first, in the order of
    a column ``seq`` if there is one (else by their text). Other elements and
    fields are unchanged."""
    cur = ds.kind(kind)
    p = merged_patches(patches).withColumnRenamed("patch", "_patch")
    j = cur.join(p, ["doc_id", "id"], "left")
    fields = [c for c in cur.columns if c not in ("doc_id", "pos", "deal_id")]
    keys = [c for c in ("doc_id", "deal_id", "pos") if c in cur.columns]

    def value(f):
        typ = cur.schema[f].dataType
        if isinstance(typ, (ArrayType, MapType, StructType)):
            return F.from_json(F.col("_patch")[f], typ)
        return F.col("_patch")[f].cast(typ)
    out = j.select(*keys, *[
        F.when(F.coalesce(F.map_contains_key("_patch", f), F.lit(False)), value(f)).otherwise(F.col(f)).alias(f)
        for f in fields])
    return ds.with_kind(kind, out.select(*cur.columns))


def set_path(ds: DocumentSet, kind: str, values: DataFrame) -> DocumentSet:
    """M3 ``jsonb_set(doc, '{kind}', value)``: for documents present in
    ``values`` the whole array is replaced by the given elements."""
    cur = ds.kind(kind)
    kept = cur.join(values.select("doc_id").distinct(), "doc_id", "left_anti")
    return ds.with_kind(kind, kept.unionByName(values.select(*cur.columns)))


def full_replace(ds: DocumentSet, incoming: DocumentSet) -> DocumentSet:
    """M5 ``set dados = ...``: documents present in ``incoming`` are replaced
    wholesale (every element kind); the rest are kept."""
    keys = incoming.header.select("doc_id")
    def swap(kind):
        return ds.kind(kind).join(keys, "doc_id", "left_anti").unionByName(incoming.kind(kind).select(*ds.kind(kind).columns))
    h = ds.header.join(keys, "doc_id", "left_anti").unionByName(incoming.header.select(*ds.header.columns))
    return DocumentSet(h, swap("partners"), swap("customers"), swap("deals"), swap("items"), swap("transitions"))


def full_replace_rows(current: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """M5 on document rows: the incoming row wins, the rest are kept."""
    kept = current.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming.select(*current.columns))


# ------------------------------------------------------------ M1 - M3 (nested)
def append_if_absent_nested(nested: DataFrame, patches: DataFrame) -> DataFrame:
    """M1 on nested documents: ``patches`` has doc_id, customer (struct) and
    deal (struct); the guard looks only at deal ids."""
    j = nested.join(patches, "doc_id", "left")
    guard = F.col("deal").isNull() | N.has_id("doc.deals", F.col("deal.id"))
    doc = F.col("doc").withField("customers", N.append_if_absent("doc.customers", F.array("customer"), guard)) \
                      .withField("deals", N.append_if_absent("doc.deals", F.array("deal"), guard))
    return j.select("doc_id", "version", "updated_at", "updated_by", doc.alias("doc"),
                    (~guard).alias("appended"))


def patch_elements_nested(nested: DataFrame, kind: str, patches: DataFrame) -> DataFrame:
    """M2 on nested documents: ``patches`` (doc_id, id, patch map) - one
    patch per document here, joined on doc_id and applied inside the row."""
    etype = nested.schema["doc"].dataType[kind].dataType.elementType
    j = nested.join(patches.select("doc_id", F.col("id").alias("_pid"), F.col("patch").alias("_patch")), "doc_id", "left")
    arr = F.col("doc")[kind]
    new = F.when(F.col("_pid").isNull(), arr).otherwise(N.patch_by_id(arr, F.col("_pid"), F.col("_patch"), etype))
    return j.withColumn("doc", F.col("doc").withField(kind, new)).drop("_pid", "_patch")


def set_path_nested(nested: DataFrame, kind: str, value: Column) -> DataFrame:
    """M3 on nested documents: replace ``doc.kind`` by ``value``."""
    return nested.withColumn("doc", F.col("doc").withField(kind, value))


# ------------------------------------------------------------ Q2 / Q3
def expected_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Q2: actual entity counts next to expected ones, with a match flag.

    ``actual``/``expected``: doc_id + one column per kind."""
    a = actual.select("doc_id", F.stack(F.lit(3), *[x for k in KINDS for x in (F.lit(k), F.col(k).cast("bigint"))])
                      .alias("kind", "actual"))
    e = expected.select("doc_id", F.stack(F.lit(3), *[x for k in KINDS for x in (F.lit(k), F.col(k).cast("bigint"))])
                        .alias("kind", "expected"))
    j = a.join(e, ["doc_id", "kind"], "full")
    return j.select("doc_id", "kind", "actual", "expected",
                    F.col("actual").eqNullSafe(F.col("expected")).alias("match"))


def reference_check(ds: DocumentSet) -> DataFrame:
    """Q3: per document, how many deal references (customer, partner) there
    are and how many do not resolve to an element of the same document."""
    def part(df, id_col, customer, asks):
        return df.where(F.col(id_col).isNotNull()).select(
            "doc_id", F.lit(customer).alias("_customer"), F.col(id_col).alias("ref"), F.lit(asks).alias("_asks"))
    rows = part(ds.deals, "clienteId", True, True).unionByName(part(ds.deals, "parceiroId", False, True))
    for df, customer in ((ds.customers, True), (ds.partners, False)):     # nothing is found in a document without an id
        rows = rows.unionByName(part(df.where(F.col("doc_id").isNotNull()), "id", customer, False))
    # references and elements meet in one table of distinct ids, which needs neither a sorted copy of the rows nor the
    # elements without repeats first; ids hardly repeat within a task, so nothing is counted before the shuffle
    keys = ["doc_id", "_customer", "ref"]
    ids = dealt(rows, *keys).groupBy(*keys).agg(F.count_if("_asks").alias("_n"), F.count_if(~F.col("_asks")).alias("_found"))
    kinds = ids.where(F.col("_n") > 0).groupBy("doc_id", "_customer").agg(
        F.sum("_n").alias("refs"), F.sum(F.when(F.col("_found") == 0, F.col("_n")).otherwise(0)).alias("missing"))
    return kinds.select("doc_id", F.when(F.col("_customer"), "customer").otherwise("partner").alias("ref_kind"), "refs", "missing")
