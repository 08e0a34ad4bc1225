"""Document sets: the flat (normalised) form the engine works on, the nested
form at the load/export edges, and the sources/sinks S1-S6.

Flat form (``DocumentSet``): one DataFrame per element kind, keyed by
``doc_id`` (and ``deal_id`` for elements nested in a deal); ``pos`` orders the
elements of an array. Nested form: one row per document with
``doc = struct<partners, customers, deals<..., pendencias, historico>>``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quire.functions.text import LOAD_LABEL, date_text, iso_text
from quire.session import dealt, shared_path
from quire.sources.tables import Tables

PARTNER_FIELDS = ["id", "nome", "responsavel", "tier", "status"]
CUSTOMER_FIELDS = ["id", "nome", "tipo", "setor", "uf", "receitaRecorrente", "publico"]
DEAL_FIELDS = ["id", "titulo", "frente", "clienteId", "parceiroId", "responsavel", "valor",
               "etapa", "prazo", "fechadoEm", "notas", "publico"]
ITEM_FIELDS = ["id", "texto", "responsavel", "prazo", "bloqueante", "resolvida"]
TRANSITION_FIELDS = ["para", "quem", "quando"]
#: Documents of one exported file at most: a compressed file is read by one task.
FILE_DOCUMENTS = 10_000


@dataclass(frozen=True)
class Compact:
    """The rows that elements are made of, before their fields are written out as
    text: nesting moves these and writes the fields inside the finished array.

    ``rows`` has doc_id, ``deal`` (equal for the deal and for the elements inside
    it, NULL where the id is NULL) and ``row``, a struct; ``pos`` and ``fields`` make
    an element's position and fields of ``row``. Kinds with the same ``rows`` move
    together."""
    rows: DataFrame
    pos: Callable[[Column], list[Column]]
    fields: Callable[[Column], list[Column]]
    #: of elements inside a deal: doc_id, deal_id and ``row`` of the deals in a frame
    #: (doc_id, deal_id), which are picked before the rows inside them move
    of_deals: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class DocumentSet:
    header: DataFrame        # doc_id, version, updated_at, updated_by
    partners: DataFrame      # doc_id, pos, PARTNER_FIELDS
    customers: DataFrame     # doc_id, pos, CUSTOMER_FIELDS
    deals: DataFrame         # doc_id, pos, DEAL_FIELDS
    items: DataFrame         # doc_id, deal_id, pos, ITEM_FIELDS   (deal.pendencias)
    transitions: DataFrame   # doc_id, deal_id, pos, TRANSITION_FIELDS (deal.historico)
    #: of some kinds, by name, the rows that the elements above are made of
    compact: dict[str, Compact] = field(default_factory=dict)

    def kind(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_kind(self, name: str, df: DataFrame) -> "DocumentSet":
        return replace(self, compact={k: c for k, c in self.compact.items() if k != name}, **{name: df})

    def compact_rows(self, name: str, fields: list[str]) -> Compact:
        """How ``nest`` takes a kind: its compact rows, or its elements as they are."""
        if name in self.compact:
            return self.compact[name]
        df = self.kind(name)
        deal = "deal_id" if "deal_id" in df.columns else "id"
        return Compact(df.select("doc_id", F.col(deal).alias("deal"), F.struct("pos", *fields).alias("row")),
                       lambda r: [r["pos"]], lambda r: [r[f].alias(f) for f in fields])

    def items_with_transitions(self, asked: DataFrame, of_item: list[str], of_transition: list[str]) -> DataFrame | None:
        """Where every item has its transition in the same compact row: doc_id,
        deal_id and the named fields of both (``pos`` is the transition's) inside
        the deals of ``asked`` (doc_id, deal_id), in one pass; else None."""
        i, t = self.compact.get("items"), self.compact.get("transitions")
        if i is None or t is None or i.rows is not t.rows or i.of_deals is None:
            return None
        r = F.col("row")
        item, transition = F.struct(*i.fields(r)), F.struct(F.struct(*t.pos(r)).alias("pos"), *t.fields(r))
        return i.of_deals(asked).select("doc_id", "deal_id", *[item[f].alias(f) for f in of_item],
                                        *[transition[f].alias(f) for f in of_transition])


# ------------------------------------------------------------ from the tables
def from_tables(t: Tables) -> DocumentSet:
    """One document per customer: its orders are deals, their line items are
    open items (blocking = returned, resolved = shipped-final) and stage
    transitions (shipments), its suppliers are partners."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                        "o_orderpriority")
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
                           "l_linestatus", "l_shipdate")
    lo = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == o["o_orderkey"], "inner")

    def deal_text(key):
        return F.concat(F.lit("N-"), key.cast("string"))
    deal_id = deal_text(F.col("l_orderkey"))
    # a line's place within its order decides all fields of its item and transition
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus"]

    def item_pos(r):
        return [r[c].alias(c) for c in line]

    def item(r):
        return [r["l_linenumber"].cast("string").alias("id"),
                F.concat(F.lit("part "), r["l_partkey"].cast("string")).alias("texto"),
                F.concat(F.lit("supplier-"), r["l_suppkey"].cast("string")).alias("responsavel"),
                date_text(r["l_shipdate"]).alias("prazo"),
                (r["l_returnflag"] == "R").alias("bloqueante"),
                (r["l_linestatus"] == "F").alias("resolvida")]

    def transition_pos(r):
        return [r[c].alias(c) for c in ("l_shipdate", "l_suppkey", "l_linestatus")]

    def transition(r):
        return [r["l_linestatus"].alias("para"),
                F.concat(F.lit("supplier-"), r["l_suppkey"].cast("string")).alias("quem"),
                iso_text(r["l_shipdate"]).alias("quando")]
    cols = {c: F.col(c) for c in line}
    items = lo.select(F.col("o_custkey").alias("doc_id"), deal_id.alias("deal_id"), F.struct(*item_pos(cols)).alias("pos"), *item(cols))
    transitions = lo.select(
        F.col("o_custkey").alias("doc_id"), deal_id.alias("deal_id"), F.struct(*transition_pos(cols)).alias("pos"), *transition(cols))
    lines = lo.select(F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("deal"), F.struct(*line).alias("row"))

    def lines_of(asked):
        a = asked.select(F.col("doc_id").alias("_doc"), F.col("deal_id").alias("_deal"))
        picked = o.select("o_orderkey", "o_custkey").join(
            a, (F.col("o_custkey") == F.col("_doc")) & (deal_text(F.col("o_orderkey")) == F.col("_deal")), "left_semi")
        return li.join(picked, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("doc_id"), deal_id.alias("deal_id"), F.struct(*line).alias("row"))
    first_supplier = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("_sup"))
    od = o.join(first_supplier, o["o_orderkey"] == first_supplier["l_orderkey"], "left")
    def deal(r):
        key, customer, status, priority = (r[f"o_{c}"] for c in ("orderkey", "custkey", "orderstatus", "orderpriority"))
        stage = F.when(status == "F", "9").when(status == "O", "2").otherwise("perdido")
        return [deal_text(key).alias("id"),
                F.concat(F.lit("Order "), key.cast("string")).alias("titulo"),
                priority.alias("frente"),
                F.concat(F.lit("C-"), customer.cast("string")).alias("clienteId"),
                F.concat(F.lit("P-"), r["_sup"].cast("string")).alias("parceiroId"),
                F.substr(priority, F.lit(3)).alias("responsavel"),
                F.when(priority == "5-LOW", F.lit(""))
                 .otherwise(F.floor(r["o_totalprice"]).cast("bigint").cast("string")).alias("valor"),
                stage.alias("etapa"),
                date_text(r["o_orderdate"]).alias("prazo"),
                F.when(status == "F", date_text(r["o_orderdate"])).alias("fechadoEm"),
                F.lit("").alias("notas"),
                F.lit(None).cast("string").alias("publico")]
    order = [*o.columns, "_sup"]
    deals = od.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), *deal({c: F.col(c) for c in order}))
    orders = od.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("deal"), F.struct(*order).alias("row"))
    sup = t.supplier.select("s_suppkey", "s_name")

    def partner(r):
        return [F.concat(F.lit("P-"), r["s_suppkey"].cast("string")).alias("id"),
                r["s_name"].alias("nome"), F.lit("").alias("responsavel"), F.lit("").alias("tier"),
                F.lit("Ativo").alias("status")]
    pairs = lo.select(F.col("o_custkey").alias("doc_id"), F.col("l_suppkey"))

    def named(p):
        return p.join(sup, p["l_suppkey"] == sup["s_suppkey"], "inner")
    # a task's lines hardly repeat a pair, so none are looked for before the shuffle; counts per document follow without another
    partners = named(dealt(pairs, "doc_id").distinct()).select("doc_id", F.col("s_suppkey").alias("pos"), *partner({c: F.col(c) for c in sup.columns}))
    # a nested document is one row: its pairs meet where it is put together
    suppliers = named(pairs.repartition("doc_id").distinct()).select(
        "doc_id", F.lit(None).cast("bigint").alias("deal"), F.struct(*sup.columns).alias("row"))
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name")
    customers = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(
        F.col("c_custkey").alias("doc_id"), F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("nome"), F.lit("PJ").alias("tipo"), F.col("c_mktsegment").alias("setor"),
        F.col("n_name").alias("uf"), F.floor("c_acctbal").cast("bigint").alias("receitaRecorrente"),
        F.lit(None).cast("string").alias("publico"))
    header = c.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("version"),
                      F.lit(None).cast("timestamp_ntz").alias("updated_at"),
                      F.lit(LOAD_LABEL).alias("updated_by"))
    return DocumentSet(header, partners, customers, deals, items, transitions, {
        "partners": Compact(suppliers, lambda r: [r["s_suppkey"]], partner),
        "deals": Compact(orders, lambda r: [r["o_orderkey"]], deal),
        "items": Compact(lines, item_pos, item, lines_of), "transitions": Compact(lines, transition_pos, transition, lines_of)})


# ------------------------------------------------------------ nesting (M4)
def _sorted_array(df: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """M4 for one kind: collect elements per key and order them by ``pos``."""
    packed = F.struct(F.col("pos").alias("p"), F.struct(*fields).alias("e"))
    # sort_array orders by pos first (ties only between equal positions)
    agg = df.groupBy(*keys).agg(F.sort_array(F.collect_list(packed)).alias("_a"))
    return agg.select(*keys, F.transform("_a", lambda x: x["e"]).alias(name))


def rebuild_arrays(df: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """M4 ``jsonb_agg``: flat elements -> ordered array per key."""
    return _sorted_array(df, keys, fields, name)


def _empty(fields_df: DataFrame, fields: list[str]):
    return F.array().cast(ArrayType(fields_df.select(F.struct(*fields).alias("s")).schema["s"].dataType))


def _packed(pos: list[Column], element: Column) -> Column:
    """An element behind its position, whose columns stand side by side: a struct
    within the struct would have its order worked out anew at every comparison."""
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(pos)], element.alias("e"))


def _ordered(rows: Column, pos, element) -> Column:
    """M4 inside a row: the elements made of an array's rows, in order of ``pos``."""
    packed = F.transform(rows, lambda r: _packed(pos(r), element(r)))
    return F.transform(F.sort_array(packed), lambda x: x["e"])


def _deal_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several frames (doc_id, deal, row) as arrays per document and deal,
    one per frame. They are dealt out by document alone, so that what is grouped
    by document next to them needs no further shuffle."""
    out = None
    for name, df in parts.items():
        cols = [F.col("row").alias(n) if n == name else F.lit(None).cast(other.schema["row"].dataType).alias(n) for n, other in parts.items()]
        one = df.where(F.col("doc_id").isNotNull()).select("doc_id", "deal", *cols)
        out = one if out is None else out.unionByName(one)
    return out.repartition("doc_id").groupBy("doc_id", "deal").agg(*[F.collect_list(n).alias(n) for n in parts])


def nest(ds: DocumentSet) -> DataFrame:
    """Flat -> nested: doc_id, version, updated_at, updated_by, doc. One row per
    document is the result here (export, nested twins); queries that need no
    nesting use the flat form. Compact rows move where there are any; a deal and
    its items move together, and the texts of fields are written last."""
    inside = {"pendencias": ds.compact_rows("items", ITEM_FIELDS), "historico": ds.compact_rows("transitions", TRANSITION_FIELDS)}
    of = ds.compact_rows("deals", DEAL_FIELDS)
    # the deals and the rows inside them must name their deal alike
    if len({k in ds.compact for k in ("deals", "items", "transitions")}) > 1:
        return nest(replace(ds, compact={k: c for k, c in ds.compact.items() if k == "partners"}))
    parts, names = {"_deals": of.rows}, {}
    for name, c in inside.items():
        names[name] = next((n for n, df in parts.items() if df is c.rows), f"_{name}")
        parts[names[name]] = c.rows
    # a deal without an id holds nothing
    known = {n: F.when(F.col("deal").isNotNull(), F.col(n)).otherwise(F.slice(n, 1, 0)).alias(n) for n in parts if n != "_deals"}
    deals = _deal_rows(parts).where(F.size("_deals") > 0).select("doc_id", "_deals", *known.values()).groupBy("doc_id").agg(
        F.collect_list(F.struct(*parts)).alias("_all"))

    def deal_element(r, group):
        return F.struct(*of.fields(r), *[
            _ordered(group[names[n]], c.pos, lambda x, c=c: F.struct(*c.fields(x))).alias(n) for n, c in inside.items()])

    def packed(group):
        return F.transform(group["_deals"], lambda r: _packed(of.pos(r), deal_element(r, group)))
    h = ds.header
    arrays = {}
    for name, fields in (("partners", PARTNER_FIELDS), ("customers", CUSTOMER_FIELDS)):
        c = ds.compact_rows(name, fields)
        h = h.join(c.rows.groupBy("doc_id").agg(F.collect_list("row").alias(f"_{name}")), "doc_id", "left")
        arrays[name] = _ordered(F.coalesce(f"_{name}", F.array().cast(ArrayType(c.rows.schema["row"].dataType))), c.pos,
                                lambda r, c=c: F.struct(*c.fields(r)))
    none = F.array().cast(deals.schema["_all"].dataType)
    h = h.join(deals, "doc_id", "left")
    arrays["deals"] = F.transform(F.sort_array(F.flatten(F.transform(F.coalesce("_all", none), packed))), lambda x: x["e"])
    return h.select("doc_id", "version", "updated_at", "updated_by", F.struct(*[a.alias(n) for n, a in arrays.items()]).alias("doc"))


def flatten(nested: DataFrame, kind: str) -> DataFrame:
    """P1 on nested documents: one row per element of ``doc.<kind>`` with its
    array position (``posexplode``; a missing array yields no rows)."""
    return nested.select("doc_id", F.posexplode(F.col("doc")[kind]).alias("pos", "e")) \
                 .select("doc_id", "pos", "e.*")


def flatten_deal_elements(nested: DataFrame, kind: str) -> DataFrame:
    """P1 one level down: elements of each deal's ``kind`` array."""
    deals = nested.select("doc_id", F.explode(F.col("doc")["deals"]).alias("d"))
    return deals.select("doc_id", F.col("d.id").alias("deal_id"),
                        F.posexplode(F.col("d")[kind]).alias("pos", "e")).select("doc_id", "deal_id", "pos", "e.*")


# ------------------------------------------------------------ S1 / S4
def export_documents(nested: DataFrame, path: str) -> str:
    """One JSON document per line (doc_id + stamps + document), in gzip files
    (the keys of every element make most of the text)."""
    out = nested.select(F.to_json(F.struct("doc_id", "version", "updated_at", "updated_by", "doc")).alias("value"))
    out.write.mode("error").option("compression", "gzip").option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)
    return path


def load_documents(spark: SparkSession, path: str, key: str = "doc_id", arrays_at: str | None = None) -> DataFrame:
    """JSON text -> VARIANT document, one value per line.

    Returns doc_id, doc (VARIANT, the whole line), raw and ``reason`` (see
    ``parse_documents``); ``quarantine`` splits off the rejected lines."""
    raw = spark.read.text(path)
    return parse_documents(raw, "value", key, arrays_at)


# Spark's JSON parser stops after the first complete value and ignores what
# follows ("123 abc" parses as 123); a document must be one whole value. The
# text is therefore parsed inside a wrapper  [ text , MARK ]  that only yields
# a two-element array ending in MARK when the text is exactly one value. MARK
# is the text's own SHA-256: no text holds its own hash, so none can close the
# wrapper itself.
def parse_json_strict(df: DataFrame, text_col: str, out: str = "doc") -> DataFrame:
    """Adds ``out``: the text as VARIANT when it is exactly one JSON value,
    else NULL. Of equal keys in one object the last wins."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    t = F.col(text_col)
    mark = F.sha2(t.cast("binary"), 256)
    d = df.withColumn("_q_w", F.try_parse_json(F.concat(F.lit("["), t, F.lit('\n,"'), mark, F.lit('"]'))))
    whole = (F.size(F.try_variant_get("_q_w", "$", "array<variant>")) == 2) & \
            (F.try_variant_get("_q_w", "$[1]", "string") == mark)
    return d.withColumn(out, F.when(whole, F.try_variant_get("_q_w", "$[0]", "variant"))).drop("_q_w")


def parse_documents(df: DataFrame, text_col: str, key: str | None = "doc_id",
                    arrays_at: str | None = None, arrays=("partners", "customers", "deals")) -> DataFrame:
    """Parse ``text_col`` as one JSON document per row (other columns kept);
    ``key`` names a top-level field copied out as ``doc_id``.

    ``reason`` is NULL for a loaded document, else 'not_json' (not exactly
    one JSON value), 'not_object', 'bad_key' (``key`` absent or no whole number)
    or - when ``arrays_at`` is given -
    'missing_array' if one of ``arrays`` is absent, null or not an array
    there (an empty array is fine)."""
    others = [c for c in df.columns if c != text_col]
    d = parse_json_strict(df.select(*others, F.col(text_col).alias("raw")), "raw", "doc")
    # the text is one valid JSON value here, so it is an object iff its first
    # non-blank character opens one (no walk over the whole document)
    is_object = F.col("raw").rlike(r"^[ \t\n\r]*\{")
    reason = F.when(F.col("doc").isNull(), F.lit("not_json")) \
              .when(~is_object, F.lit("not_object"))
    keyed = [F.try_variant_get("doc", f"$.{key}", "bigint").alias("doc_id")] if key else []
    if key:
        reason = reason.when(F.try_variant_get("doc", f"$.{key}", "bigint").isNull(), F.lit("bad_key"))
    if arrays_at is not None:
        missing = None
        for a in arrays:
            m = F.try_variant_get("doc", f"{arrays_at}.{a}", "array<variant>").isNull()
            missing = m if missing is None else (missing | m)
        reason = reason.when(missing, F.lit("missing_array"))
    return d.select(*others, *keyed, "doc", "raw", reason.alias("reason"))


def quarantine(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split S1's output into (documents, quarantined rows with reason)."""
    return loaded.where(F.col("reason").isNull()), loaded.where(F.col("reason").isNotNull()).select(
        *[c for c in loaded.columns if c != "doc"])


def flatten_variant(loaded: DataFrame, path: str, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """P1 on loaded (VARIANT) documents: one row per element of the array at
    ``path`` with its position and the named fields as text (``->>``: a
    number 2 gives '2', a JSON null gives NULL, a missing key NULL). A
    missing path or a non-array yields no rows."""
    keys = keys or ["doc_id"]
    arr = F.try_variant_get(F.col("doc"), path, "array<variant>")
    ex = loaded.select(*keys, F.posexplode(arr).alias("pos", "_e"))
    return ex.select(*keys, F.col("pos").cast("bigint").alias("pos"),
                     *[F.try_variant_get("_e", f"$.{f}", "string").alias(f) for f in fields])


def variant_array_len(doc, path: str):
    """``jsonb_array_length(doc->path)``: NULL when missing or not an array."""
    return F.size(F.try_variant_get(doc, path, "array<variant>")).cast("bigint")


def replace_load(current: DataFrame, incoming: DataFrame, label: str = LOAD_LABEL,
                 at=None) -> DataFrame:
    """Upsert by doc_id; incoming documents overwrite, version resets to
    1 and the author is the load label. Nothing is archived."""
    stamp = at if at is not None else F.lit(None).cast("timestamp_ntz")
    new = incoming.withColumn("version", F.lit(1)).withColumn("updated_by", F.lit(label)) \
                  .withColumn("updated_at", stamp)
    kept = current.join(incoming.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(new.select(*current.columns))


def ensure_documents(current: DataFrame, keys: DataFrame, default_doc, default_deals=0) -> DataFrame:
    """S3: keys without a document get the default one; others untouched."""
    missing = keys.select("doc_id").distinct().join(current.select("doc_id"), "doc_id", "left_anti")
    fill = missing.select(
        "doc_id", F.lit(1).alias("version"), default_doc.alias("doc"),
        F.lit(default_deals).cast("bigint").alias("n_deals"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("string").alias("updated_by"))
    return current.unionByName(fill.select(*current.columns))


# ------------------------------------------------------------ S5 / S6
def read_envelope(raw: DataFrame, text_col: str = "body", fields: dict[str, str] | None = None) -> DataFrame:
    """A response body is either an array of users or ``{users: [...]}``;
    anything else yields no users. One output row per user: id (text, whatever
    its form) and ``fields`` (name -> type; the e-mail unless given)."""
    keep = [c for c in raw.columns if c != text_col]
    parsed = parse_json_strict(raw, text_col, "_q_v")
    v = F.col("_q_v")
    users = F.coalesce(F.try_variant_get(v, "$.users", "array<variant>"),
                       F.try_variant_get(v, "$", "array<variant>"))
    return parsed.select(*keep, F.explode(users).alias("u")).select(
        *keep, F.try_variant_get("u", "$.id", "string").alias("id"),
        *[F.try_variant_get("u", f"$.{f}", kind).alias(f) for f, kind in (fields or {"email": "string"}).items()])


def scan_columns(spark: SparkSession, path: str, cols: list[str], schema: str) -> DataFrame:
    """Read named columns; a missing or unreadable path gives an empty
    DataFrame with the requested schema."""
    try:
        return spark.read.parquet(path).select(*cols)
    except AnalysisException:   # missing path or columns: the API answers []
        return spark.createDataFrame([], schema).select(*cols)


def stage_parquet(df: DataFrame, name: str) -> str:
    """Write ``df`` below the shared folder and return the path."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return path
