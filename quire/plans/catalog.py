"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
whose columns match the oracle SQL of the same key. Every query reads the
given tables (or data Spark derives from them) in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import access as X
from quire.operators import checks as Q
from quire.operators import documents as DO
from quire.operators import open_documents as OD
from quire.operators import operations as OP
from quire.operators import people as U
from quire.operators import versions as V
from quire.operators.ordering import DEFAULT_CHUNK, last_wins_by_key
from quire.sources import documents as D
from quire.sources import roles
from quire.sources.tables import Tables
from quire.session import cut_lineage, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ============================================================ write log (V*)
#: Chunk width of the twins that take the fold and the ordered helpers through
#: several chunks on small tables.
SMALL_CHUNK = 512


def _e1(spark, sf_dir, materialize=False, chunk_width=DEFAULT_CHUNK):
    t = Tables(spark, sf_dir)
    w = roles.writes(t, chunk_width)
    return V.apply_writes(w, roles.profiles(t), roles.base_documents(w), chunk_width, materialize=materialize)


def _stamped(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("outcome") == V.APPLIED) \
        .withColumn("updated_at", F.col("ts")).withColumn("updated_by", F.col("author"))


@query("e1_history_listing")
def e1_history_listing(spark, sf_dir):
    """Flagship (V6): write log -> author/gate -> conflicts -> stamps -> history."""
    _, history, _ = _e1(spark, sf_dir)
    return V.history_listing(history)


@query("v5_resolve_conflicts")
def v5_resolve_conflicts(spark, sf_dir):
    resolved, _, _ = _e1(spark, sf_dir)
    return resolved.select("doc_id", "seq", "actor", "expected_version", "eligible", "outcome", "version")


@query("v5_resolve_conflicts_chunked")
def v5_resolve_conflicts_chunked(spark, sf_dir):
    resolved, _, _ = _e1(spark, sf_dir, chunk_width=SMALL_CHUNK)
    return resolved.select("doc_id", "seq", "actor", "expected_version", "eligible", "outcome", "version")


def _images(history: DataFrame) -> DataFrame:
    return history.select("hist_id", "doc_id", "version", "doc", F.col("n_deals").alias("deals"), "updated_at", "updated_by")


@query("v2_before_images")
def v2_before_images(spark, sf_dir):
    return _images(_e1(spark, sf_dir)[1])


@query("v2_before_images_chunked")
def v2_before_images_chunked(spark, sf_dir):
    return _images(_e1(spark, sf_dir, chunk_width=SMALL_CHUNK)[1])


@query("v3_stamp_author_time")
def v3_stamp_author_time(spark, sf_dir):
    resolved, _, _ = _e1(spark, sf_dir)
    return _stamped(resolved).select("doc_id", "seq", "version", "updated_at", "updated_by")


@query("v7_current_snapshot")
def v7_current_snapshot(spark, sf_dir):
    _, _, current = _e1(spark, sf_dir)
    return current.select("doc_id", "version", F.col("n_deals").alias("deals"), "updated_at", "updated_by")


@query("v8_noop_write_report")
def v8_noop_write_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = roles.writes(t)
    base = roles.base_documents(w)
    resolved, _, _ = V.apply_writes(w, roles.profiles(t), base)
    return V.noop_write_report(_stamped(resolved), base)


@query("v4_claims_overridden")
def v4_claims_overridden(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = roles.writes(t)
    resolved, _, _ = V.apply_writes(w, roles.profiles(t), roles.base_documents(w))
    return V.claims_overridden(w, _stamped(resolved))


@query("v1_stamp_versions")
def v1_stamp_versions(spark, sf_dir):
    """Editor writes without a version predicate: every one counts."""
    t = Tables(spark, sf_dir)
    w = roles.writes(t)
    accepted = V.write_gate(V.ignore_claimed_fields(w), roles.profiles(t)).where(F.col("eligible"))
    return V.stamp_versions(accepted, roles.base_documents(w)).select("doc_id", "seq", "version")


@query("v1_stamp_versions_chunked")
def v1_stamp_versions_chunked(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = roles.writes(t, SMALL_CHUNK)
    accepted = V.write_gate(V.ignore_claimed_fields(w), roles.profiles(t)).where(F.col("eligible"))
    return V.stamp_versions(accepted, roles.base_documents(w), SMALL_CHUNK).select("doc_id", "seq", "version")


@query("j2_author_name")
def j2_author_name(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return V.author_name(roles.writes(t), roles.profiles(t)).select("doc_id", "seq", "actor", "author")


@query("j3_write_gate")
def j3_write_gate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return V.write_gate(roles.writes(t), roles.profiles(t)).select("doc_id", "seq", "actor", "eligible")


@query("p8_status_lines")
def p8_status_lines(spark, sf_dir):
    _, _, current = _e1(spark, sf_dir)
    line = F.concat(F.lit("versao "), F.col("version").cast("string"),
                    F.lit(", autor "), F.coalesce(F.col("updated_by"), F.lit("?")),
                    F.lit(", negocios "), F.col("n_deals").cast("string"))
    return current.select("doc_id", line.alias("line"))


@query("p8_document_lines")
def p8_document_lines(spark, sf_dir):
    _, history, current = _e1(spark, sf_dir, materialize=True)
    return X.document_lines(current, history)


@query("p8_count_lines")
def p8_count_lines(spark, sf_dir):
    return X.count_lines(X.row_counts(_sizes(spark, sf_dir), _actor_kinds(Tables(spark, sf_dir))))


@query("l1_sort_by_version")
def l1_sort_by_version(spark, sf_dir):
    h = roles.history_log(Tables(spark, sf_dir))
    return V.sort_by_version(h).select("doc_id", "version", "updated_by", F.length("doc").cast("bigint").alias("chars"))


@query("v7_conversation_snapshot")
def v7_conversation_snapshot(spark, sf_dir):
    h = roles.history_log(Tables(spark, sf_dir)).withColumn("seq", F.col("version").cast("bigint")) \
        .withColumn("n_deals", F.lit(0).cast("bigint")).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    cur = V.current_snapshot(h, None)
    return cur.select("doc_id", "version", "updated_by", F.length("doc").cast("bigint").alias("chars"))


@query("v9_provisional_flag")
def v9_provisional_flag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return V.provisional_flag(roles.flag_events(t), roles.profiles(t))


@query("a4_last_wins_by_key")
def a4_last_wins_by_key(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", "event_type")
    return last_wins_by_key(e, "user_id", "event_id")


def _reloads(spark, sf_dir, chunk_width=DEFAULT_CHUNK):
    t = Tables(spark, sf_dir)
    w = cut_lineage(roles.mixed_log(t, chunk_width), "mixed-log")
    return V.apply_log(w, roles.profiles(t), roles.given_base(w), chunk_width)


@query("s2_reload_outcomes")
def s2_reload_outcomes(spark, sf_dir):
    """S2 within the write log: reloads set the version back to 1."""
    return _reloads(spark, sf_dir)[0].select("doc_id", "seq", "expected_version", "load", "outcome", "version")


@query("s2_reload_outcomes_chunked")
def s2_reload_outcomes_chunked(spark, sf_dir):
    return _reloads(spark, sf_dir, SMALL_CHUNK)[0].select("doc_id", "seq", "expected_version", "load", "outcome", "version")


@query("s2_reload_history")
def s2_reload_history(spark, sf_dir):
    """V6 across reloads: listed by epoch, then version; documents compared."""
    return V.reload_listing(_reloads(spark, sf_dir)[1])


@query("s2_reload_history_chunked")
def s2_reload_history_chunked(spark, sf_dir):
    return V.reload_listing(_reloads(spark, sf_dir, SMALL_CHUNK)[1])


@query("s2_reload_current")
def s2_reload_current(spark, sf_dir):
    current = _reloads(spark, sf_dir)[2]
    return current.select("doc_id", "epoch", "version", F.col("n_deals").alias("deals"), "updated_at", "updated_by", "doc")


# ============================================================ documents
def _docs(spark, sf_dir) -> D.DocumentSet:
    return D.from_tables(Tables(spark, sf_dir))


@query("p1_flatten_deals")
def p1_flatten_deals(spark, sf_dir):
    f = DO.flatten_entities(_docs(spark, sf_dir), "deals")
    return f.select("doc_id", "pos", "id", "etapa", "valor",
                    F.col("clienteId").alias("cliente_id"), F.col("parceiroId").alias("parceiro_id"),
                    "prazo", F.col("fechadoEm").alias("fechado_em"))


@query("p1_flatten_items")
def p1_flatten_items(spark, sf_dir):
    f = DO.flatten_entities(_docs(spark, sf_dir), "items")
    return f.select("doc_id", "deal_id", "pos", "id", "texto", "responsavel",
                    "prazo", "bloqueante", "resolvida")


@query("p2_element_lookup")
def p2_element_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    keys = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("doc_id"), F.concat(F.lit("N-"), F.col("o_orderkey").cast("string")).alias("id"))
    return DO.element_lookup(D.from_tables(t), "deals", keys).select("doc_id", "id", "etapa", "valor", "frente")


@query("p3_documents_with")
def p3_documents_with(spark, sf_dir):
    return DO.has_element_flag(_docs(spark, sf_dir), "deals", F.col("etapa") == "perdido", "has_lost_deal")


@query("p3_documents_without")
def p3_documents_without(spark, sf_dir):
    return DO.documents_with(_docs(spark, sf_dir), "items", F.col("bloqueante"), negate=True)


@query("p6_blank_label")
def p6_blank_label(spark, sf_dir):
    return DO.blank_labels(_docs(spark, sf_dir), "deals", "valor", "valor")


@query("p7_first_transition_author")
def p7_first_transition_author(spark, sf_dir):
    ds = _docs(spark, sf_dir)
    return DO.first_transition_author_flat(ds).join(ds.header.select("doc_id"), "doc_id", "left_semi")


@query("p7_first_transition_author_nested")
def p7_first_transition_author_nested(spark, sf_dir):
    return DO.first_transition_author(D.nest(_docs(spark, sf_dir)))


@query("a2_entity_counts")
def a2_entity_counts(spark, sf_dir):
    return DO.entity_counts(_docs(spark, sf_dir))


@query("a2_entity_counts_nested")
def a2_entity_counts_nested(spark, sf_dir):
    return DO.entity_counts_nested(D.nest(_docs(spark, sf_dir)))


@query("a3_blocking_items")
def a3_blocking_items(spark, sf_dir):
    return DO.blocking_items(_docs(spark, sf_dir))


@query("a3_blocking_items_nested")
def a3_blocking_items_nested(spark, sf_dir):
    return DO.blocking_items_nested(D.nest(_docs(spark, sf_dir)))


@query("e3_change_script")
def e3_change_script(spark, sf_dir):
    """Guarded append, patch by id, check of the counts, check of a deal and a
    customer by two ids (the new customer, which the first deal does not name)."""
    t = Tables(spark, sf_dir)
    cust, deal = _new_elements(t)
    ds, _ = DO.append_if_absent(D.from_tables(t), cust, deal)
    ds = DO.patch_elements(ds, "deals", _deal_patches(t))
    p = roles.label_patches(t)
    pairs = p.select("doc_id", F.col("deal_id"), F.concat(F.lit("C-L"), F.col("doc_id").cast("string")).alias("customer_id")).unionByName(
        p.where(F.col("first_order").isNotNull()).select(
            "doc_id", F.concat(F.lit("N-"), F.col("first_order").cast("string")).alias("deal_id"),
            F.explode(F.array(F.concat(F.lit("C-"), F.col("doc_id").cast("string")),
                              F.concat(F.lit("C-L"), F.col("doc_id").cast("string")))).alias("customer_id")))
    check = DO.deal_customer_check(ds, pairs)
    counts = DO.entity_counts(ds).select("doc_id", "partners", "customers", "deals")
    return check.join(counts, "doc_id")


@query("j4_deal_customers")
def j4_deal_customers(spark, sf_dir):
    return DO.deal_customers(_docs(spark, sf_dir))


def _new_elements(t: Tables):
    p = roles.label_patches(t)
    cust = p.select("doc_id", F.lit(1).cast("bigint").alias("_k"),
                    F.concat(F.lit("C-L"), F.col("doc_id").cast("string")).alias("id"),
                    F.concat(F.lit("Client L"), F.col("doc_id").cast("string")).alias("nome"),
                    F.lit("PJ").alias("tipo"), F.lit("SERVICES").alias("setor"), F.lit("").alias("uf"),
                    F.lit(0).cast("bigint").alias("receitaRecorrente"), F.lit("B2B").alias("publico"))
    deal = p.select("doc_id", F.lit(1).cast("bigint").alias("_k"), F.col("deal_id").alias("id"),
                    F.lit("New deal").alias("titulo"), F.lit("3-MEDIUM").alias("frente"),
                    F.concat(F.lit("C-L"), F.col("doc_id").cast("string")).alias("clienteId"),
                    F.lit(None).cast("string").alias("parceiroId"), F.lit("owner").alias("responsavel"),
                    F.lit("").alias("valor"), F.lit("2").alias("etapa"), F.lit("").alias("prazo"),
                    F.lit(None).cast("string").alias("fechadoEm"), F.lit("").alias("notas"),
                    F.lit("B2B").alias("publico"))
    return cust, deal


@query("m1_append_if_absent")
def m1_append_if_absent(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cust, deal = _new_elements(t)
    ds, report = DO.append_if_absent(D.from_tables(t), cust, deal)
    counts = DO.entity_counts(ds).select("doc_id", "customers", "deals")
    return report.join(counts, "doc_id", "inner")


@query("m1_append_if_absent_nested")
def m1_append_if_absent_nested(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nested = D.nest(D.from_tables(t))
    cust, deal = _new_elements(t)
    etype = nested.schema["doc"].dataType
    ctype = etype["customers"].dataType.elementType
    dtype = etype["deals"].dataType.elementType
    empty_items = F.array().cast(dtype["pendencias"].dataType)
    empty_trans = F.array().cast(dtype["historico"].dataType)
    patches = cust.select("doc_id", F.struct(*D.CUSTOMER_FIELDS).cast(ctype).alias("customer")).join(
        deal.select("doc_id", F.struct(*D.DEAL_FIELDS, empty_items.alias("pendencias"),
                                       empty_trans.alias("historico")).cast(dtype).alias("deal")), "doc_id")
    out = DO.append_if_absent_nested(nested.join(patches.select("doc_id"), "doc_id", "left_semi"), patches)
    return out.select("doc_id", "appended", F.size("doc.customers").cast("bigint").alias("customers"),
                      F.size("doc.deals").cast("bigint").alias("deals"))


def _deal_patches(t: Tables):
    """Change-script patches: the first order of each labelled document gets
    a new owner; toxic ones are sent for review and lose their notes (a key
    set to JSON null overrides)."""
    p = roles.label_patches(t).where(F.col("first_order").isNotNull())
    patch = F.when(F.col("toxic") == 1,
                   F.create_map(F.lit("responsavel"), F.lit("revisar"), F.lit("notas"), F.lit(None).cast("string"))) \
             .otherwise(F.create_map(F.lit("responsavel"), F.concat(F.lit("owner-"), F.col("doc_id").cast("string"))))
    return p.select("doc_id", F.concat(F.lit("N-"), F.col("first_order").cast("string")).alias("id"),
                    patch.alias("patch"))


@query("m2_patch_elements")
def m2_patch_elements(spark, sf_dir):
    t = Tables(spark, sf_dir)
    patches = _deal_patches(t)
    ds = DO.patch_elements(D.from_tables(t), "deals", patches)
    return ds.deals.select("doc_id", "id", "responsavel", "notas")


@query("m2_patch_elements_nested")
def m2_patch_elements_nested(spark, sf_dir):
    t = Tables(spark, sf_dir)
    patches = _deal_patches(t)
    nested = D.nest(D.from_tables(t))
    out = DO.patch_elements_nested(nested, "deals", patches)
    return D.flatten(out, "deals").select("doc_id", "id", "responsavel", "notas")


def _loaded(spark, sf_dir) -> DataFrame:
    """The documents as a load of their JSON export reads them (VARIANT)."""
    path = D.export_documents(D.nest(_docs(spark, sf_dir)), shared_path(spark, "export"))
    return D.load_documents(spark, path)


def _open_patches(t: Tables) -> DataFrame:
    """Change scripts as JSON, with keys that no schema has: the first deal of
    each labelled document gets a registration number, a list and a score, in two
    patches; toxic ones lose their notes (JSON null)."""
    p = roles.label_patches(t).where(F.col("first_order").isNotNull())
    key = F.concat(F.lit("N-"), F.col("first_order").cast("string"))
    first = F.concat(F.lit('{"cnpj":"00-'), F.col("doc_id").cast("string"), F.lit('","score":'), F.col("doc_id").cast("string"),
                     F.lit(',"tags":["a",1],"responsavel":"first"}'))
    second = F.when(F.col("toxic") == 1, F.lit('{"responsavel":"revisar","notas":null}')).otherwise(
        F.concat(F.lit('{"responsavel":"owner-'), F.col("doc_id").cast("string"), F.lit('"}')))
    return p.select("doc_id", key.alias("id"), F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), first.alias("patch")), F.struct(F.lit(2).alias("seq"), second.alias("patch")))).alias("p")) \
        .select("doc_id", "id", "p.seq", "p.patch")


def _operations(spark, sf_dir):
    """(log with scopes, wanted versions): the applied writes of the log as operations."""
    t = Tables(spark, sf_dir)
    w = roles.writes(t)
    base = roles.base_documents(w)
    resolved, _, _ = V.apply_writes(w, roles.profiles(t), base, materialize=False)
    applied = cut_lineage(resolved.where(F.col("outcome") == V.APPLIED).select("doc_id", "seq", "version", "kind"), "applied")
    return OP.scoped_log(roles.operations(applied), base), roles.three_versions(applied)


@query("m5_operation_elements")
def m5_operation_elements(spark, sf_dir):
    """M1, M2, M3 and M5 as operations in the write log: every document at three
    versions, in flat form."""
    return OP.elements_at(*_operations(spark, sf_dir))


@query("m5_operation_documents")
def m5_operation_documents(spark, sf_dir):
    """The same versions as whole documents."""
    return OP.documents_at(*_operations(spark, sf_dir))


@query("m2_patch_open")
def m2_patch_open(spark, sf_dir):
    """M2 on loaded documents: unknown keys and the types of values survive."""
    out = OD.patch_elements(_loaded(spark, sf_dir), ["doc", "deals"], _open_patches(Tables(spark, sf_dir)))
    e = out.select("doc_id", F.posexplode(F.try_variant_get("doc", "$.doc.deals", "array<variant>")).alias("pos", "e"))

    def text(f):
        return F.try_variant_get("e", f"$.{f}", "string")
    return e.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), text("id").alias("id"), text("responsavel").alias("responsavel"),
        text("notas").alias("notas"), text("cnpj").alias("cnpj"), F.try_variant_get("e", "$.score", "bigint").alias("score"),
        F.schema_of_variant(F.try_variant_get("e", "$.score", "variant")).alias("score_type"),
        F.to_json(F.try_variant_get("e", "$.tags", "variant")).alias("tags"),
        F.size(OD.as_object(F.col("e"))).cast("bigint").alias("n_keys"))


@query("m3_set_at_path")
def m3_set_at_path(spark, sf_dir):
    """M3 at paths of loaded documents: a field of the first deal, a new key of the
    last one, a new top-level key, and a path whose parent is missing; documents of
    toxic labels send a NULL, which is rejected."""
    t = Tables(spark, sf_dir)
    sent = t.labels.select("doc_id", F.when(F.col("toxic") == 0, F.try_parse_json(F.concat(
        F.lit('{"by":"label","n":'), F.col("doc_id").cast("string"), F.lit("}")))).alias("value"))
    docs = _loaded(spark, sf_dir).drop("reason")
    for path in (["doc", "deals", 0, "prazo"], ["doc", "deals", -1, "review"], ["doc", "review"], ["doc", "absent", "review"]):
        docs = OD.set_path(docs.drop("reason"), path, sent)

    def at(path, kind="string"):
        return F.try_variant_get("doc", path, kind)
    deals = at("$.doc.deals", "array<variant>")
    last = F.try_element_at(deals, F.lit(-1))
    return docs.select(
        "doc_id", "reason", at("$.doc.deals[0].prazo.n", "bigint").alias("first_n"), at("$.doc.deals[0].id").alias("first_id"),
        F.try_variant_get(last, "$.review.by", "string").alias("last_by"), F.try_variant_get(last, "$.id", "string").alias("last_id"),
        F.to_json(at("$.doc.review", "variant")).alias("review"), at("$.doc.absent", "variant").isNull().alias("absent"),
        F.size(deals).cast("bigint").alias("deals"))


def _listed(deals) -> Column:
    """Content of an array of deals as text, in array order."""
    return F.array_join(F.transform(deals, lambda d: F.concat_ws(":", d["id"], d["etapa"], d["valor"], d["clienteId"])),
                        ",").alias("listed")


@query("m3_set_path")
def m3_set_path(spark, sf_dir):
    nested = D.nest(_docs(spark, sf_dir))
    out = DO.set_path_nested(nested, "deals", F.filter("doc.deals", lambda d: d["etapa"] != "perdido"))
    return out.select("doc_id", F.size("doc.deals").cast("bigint").alias("deals"), _listed("doc.deals"))


@query("m4_rebuild_arrays")
def m4_rebuild_arrays(spark, sf_dir):
    ds = _docs(spark, sf_dir)
    arr = D.rebuild_arrays(ds.deals, ["doc_id"], D.DEAL_FIELDS, "deals")
    return arr.select("doc_id", F.size("deals").cast("bigint").alias("n"),
                      F.get("deals", 0)["id"].alias("first_id"), F.element_at("deals", -1)["id"].alias("last_id"),
                      _listed("deals"))


def _doc_rows(spark, sf_dir) -> DataFrame:
    nested = D.nest(_docs(spark, sf_dir))
    return nested.select("doc_id", F.to_json("doc").alias("doc"), F.size("doc.deals").cast("bigint").alias("n_deals"))


@query("m5_full_replace")
def m5_full_replace(spark, sf_dir):
    cur = _doc_rows(spark, sf_dir).withColumn("source", F.lit("kept"))
    _, _, snap = _e1(spark, sf_dir)
    inc = snap.select("doc_id", "doc", "n_deals").withColumn("source", F.lit("incoming"))
    return DO.full_replace_rows(cur, inc, "doc_id").select("doc_id", "source", F.col("n_deals").alias("deals"))


@query("q2_expected_counts")
def q2_expected_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # expectations leave lost deals out, so documents that hold some don't match
    actual = DO.entity_counts(D.from_tables(t))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    li = t.lineitem.select("l_orderkey", "l_suppkey")
    sup = t.supplier.select("s_suppkey")
    parts = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(sup, li["l_suppkey"] == sup["s_suppkey"]) \
        .groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count_distinct("l_suppkey").alias("partners"))
    deals = o.where(F.col("o_orderstatus") != "P").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("deals"))
    exp = t.customer.select(F.col("c_custkey").alias("doc_id")).join(parts, "doc_id", "left").join(deals, "doc_id", "left") \
        .select("doc_id", F.coalesce("partners", F.lit(0)).alias("partners"), F.lit(1).alias("customers"),
                F.coalesce("deals", F.lit(0)).alias("deals"))
    return DO.expected_counts(actual, exp)


@query("q3_reference_check")
def q3_reference_check(spark, sf_dir):
    return DO.reference_check(_docs(spark, sf_dir))


# ============================================================ sources / sinks
@query("s1_load_documents")
def s1_load_documents(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = D.export_documents(D.nest(D.from_tables(t)), shared_path(spark, "export"))
    exported = D.load_documents(spark, path, arrays_at="$.doc").select(
        F.lit("export").alias("source"), F.col("doc_id").alias("id"), "reason", "doc")
    texts = D.parse_documents(t.documents.select(F.col("doc_id").alias("id"), "text"), "text", key=None,
                              arrays_at="$.doc").select(F.lit("documents").alias("source"), "id", "reason", "doc")
    both = exported.unionByName(texts)
    return both.select("source", "id", "reason", D.variant_array_len(F.col("doc"), "$.doc.deals").alias("deals"))


@query("p1_flatten_loaded_deals")
def p1_flatten_loaded_deals(spark, sf_dir):
    """P1 on documents loaded from JSON text (VARIANT): fields read as text."""
    path = D.export_documents(D.nest(_docs(spark, sf_dir)), shared_path(spark, "export"))
    loaded = D.load_documents(spark, path)
    f = D.flatten_variant(loaded, "$.doc.deals", ["id", "etapa", "valor", "clienteId", "parceiroId", "prazo",
                                                 "fechadoEm"])
    return f.select("doc_id", "pos", "id", "etapa", "valor", F.col("clienteId").alias("cliente_id"),
                    F.col("parceiroId").alias("parceiro_id"), "prazo", F.col("fechadoEm").alias("fechado_em"))


@query("s2_replace_load")
def s2_replace_load(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, _, current = _e1(spark, sf_dir)
    reviewed = t.labels.where(F.col("quality") == 1).select("doc_id")
    incoming = _doc_rows(spark, sf_dir).join(reviewed, "doc_id", "left_semi")
    out = D.replace_load(current.select("doc_id", "version", "doc", "n_deals", "updated_at", "updated_by"), incoming)
    return out.select("doc_id", "version", "updated_by", F.col("n_deals").alias("deals"))


@query("s3_ensure_documents")
def s3_ensure_documents(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, _, current = _e1(spark, sf_dir)
    keys = t.customer.select(F.col("c_custkey").alias("doc_id"))
    out = D.ensure_documents(current.select("doc_id", "version", "doc", "n_deals", "updated_at", "updated_by"),
                             keys, F.lit(roles.EMPTY_DOCUMENT))
    return out.select("doc_id", "version", F.col("n_deals").alias("deals"), "updated_by")


@query("s4_export_roundtrip")
def s4_export_roundtrip(spark, sf_dir):
    path = D.export_documents(D.nest(_docs(spark, sf_dir)), shared_path(spark, "export"))
    back = D.load_documents(spark, path)
    return back.select("doc_id", F.try_variant_get("doc", "$.version", "int").alias("version"),
                       F.try_variant_get("doc", "$.updated_by", "string").alias("updated_by"),
                       *[D.variant_array_len(F.col("doc"), f"$.doc.{k}").alias(k) for k in DO.KINDS],
                       _listed(F.try_variant_get("doc", "$.doc.deals", "array<struct<id:string,etapa:string,valor:string,clienteId:string>>")))


@query("s5_read_envelope")
def s5_read_envelope(spark, sf_dir):
    """Users served in pages of at most 200: pages of people without e-mail
    come wrapped as {users: [...]}, the others as a bare array."""
    u = roles.users(Tables(spark, sf_dir)).select("id", "email")
    u = u.withColumn("page", F.floor(F.col("id") / 200).cast("bigint")) \
         .withColumn("form", F.when(F.col("email").isNull(), "object").otherwise("array"))
    pages = u.groupBy("page", "form").agg(F.collect_list(F.struct("id", "email")).alias("users"))
    body = F.when(F.col("form") == "object", F.to_json(F.struct("users"))).otherwise(F.to_json("users"))
    return D.read_envelope(pages.select("page", "form", body.alias("body")))


@query("e2_people_listing")
def e2_people_listing(spark, sf_dir):
    """S5 -> L3 -> J5 -> L2: users read from response bodies (ids as text), the
    first page of 200, joined with their profiles and sorted for display."""
    t = Tables(spark, sf_dir)
    u = roles.users(t)
    u = u.withColumn("page", F.floor(F.col("id") / 200).cast("bigint")).withColumn("id", F.col("id").cast("string"))
    stamps = ("last_sign_in_at", "created_at", "email_confirmed_at", "confirmed_at")
    pages = u.groupBy("page").agg(F.collect_list(F.struct("id", "email", "raw_user_meta_data", *stamps)).alias("users"))
    micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    body = F.when(F.col("page") % 2 == 0, F.to_json(F.struct("users"), micros)).otherwise(F.to_json("users", micros))
    users = D.read_envelope(pages.select("page", body.alias("body")), fields={
        "email": "string", "raw_user_meta_data": "string", **{s: "timestamp_ntz" for s in stamps}}).drop("page")
    profiles = roles.profiles(t).withColumn("id", F.col("id").cast("string"))
    return U.locale_sort(U.people_listing(U.first_page(users, 200), profiles))


@query("s6_scan_columns")
def s6_scan_columns(spark, sf_dir):
    path = D.stage_parquet(roles.profiles(Tables(spark, sf_dir)), "profiles")
    return D.scan_columns(spark, path, U.PROFILE_COLS,
                          "id long, nome string, papel string, email string, senha_provisoria boolean")


# ============================================================ people
@query("u1_derive_profiles")
def u1_derive_profiles(spark, sf_dir):
    return U.derive_profiles(roles.users(Tables(spark, sf_dir)))


@query("j6_insert_if_absent")
def j6_insert_if_absent(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return U.insert_if_absent(roles.profiles(t), U.derive_profiles(roles.users(t)), order="id")


@query("j1_backfill_email")
def j1_backfill_email(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return U.backfill_email(roles.profiles(t), roles.users(t))


@query("j5_people_listing")
def j5_people_listing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return U.people_listing(roles.users(t), roles.profiles(t))


@query("l2_locale_sort")
def l2_locale_sort(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return U.locale_sort(U.people_listing(roles.users(t), roles.profiles(t)))


@query("l3_first_page")
def l3_first_page(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return U.locale_sort(U.people_listing(U.first_page(roles.users(t), 200), roles.profiles(t)))


def _create_requests(t: Tables) -> DataFrame:
    u = roles.users(t)
    valid = U.validate_people_commands(u.select(
        "id", "email", U.meta_field("raw_user_meta_data", "nome").alias("nome"),
        U.meta_field("raw_user_meta_data", "papel").alias("papel")))
    ok = valid.where(F.col("reason").isNull()).select("id")
    return u.join(ok, "id", "left_semi").select(
        "id", "email", U.meta_field("raw_user_meta_data", "nome").alias("nome"),
        U.meta_field("raw_user_meta_data", "papel").alias("papel"))


@query("j7_repair_missing_profiles")
def j7_repair_missing_profiles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return U.repair_missing_profiles(roles.users(t), roles.profiles(t), _create_requests(t))


@query("j8_insert_from_users")
def j8_insert_from_users(spark, sf_dir):
    t = Tables(spark, sf_dir)
    u = roles.users(t)
    debit = t.customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"))
    req = debit.join(u.select("id", "email"), "id").select("email", "nome", F.lit("editor").alias("papel"))
    return U.insert_from_users(roles.profiles(t), u, req)


@query("j9_remove_people")
def j9_remove_people(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, _, outcomes = U.remove_people(roles.users(t), roles.profiles(t), roles.removal_requests(t))
    return outcomes


@query("j10_orphan_profiles")
def j10_orphan_profiles(spark, sf_dir):
    """Users removed without the cascade leave their profiles orphaned."""
    t = Tables(spark, sf_dir)
    users_after, _, _ = U.remove_people(roles.users(t), roles.profiles(t), roles.removal_requests(t))
    return U.orphan_profiles(roles.profiles(t), users_after).select("id", "nome")


@query("q1_constraint_report")
def q1_constraint_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    users_after, _, _ = U.remove_people(roles.users(t), roles.profiles(t), roles.removal_requests(t))
    return Q.constraint_report(roles.profiles(t), users_after)


@query("q1_document_constraints")
def q1_document_constraints(spark, sf_dir):
    """Q1 on the document and history tables. Documents of toxic labels are
    delivered twice, without content where quality is low, so rules do trip."""
    t = Tables(spark, sf_dir)
    _, history, current = _e1(spark, sf_dir)
    again = current.join(t.labels.where(F.col("toxic") == 1).select("doc_id", "quality"), "doc_id").withColumn(
        "doc", F.when(F.col("quality") == 1, F.col("doc"))).drop("quality")
    return Q.document_constraints(current.unionByName(again), "pipeline", "doc_id").unionByName(
        Q.document_constraints(history, "pipeline_historico", "hist_id"))


@query("u2_validate_people_commands")
def u2_validate_people_commands(spark, sf_dir):
    return U.validate_people_commands(roles.create_commands(Tables(spark, sf_dir)))


@query("u3_partial_profile_update")
def u3_partial_profile_update(spark, sf_dir):
    t = Tables(spark, sf_dir)
    updated, _ = U.partial_profile_update(roles.profiles(t), roles.profile_changes(t))
    return updated


@query("u3_update_outcomes")
def u3_update_outcomes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, outcomes = U.partial_profile_update(roles.profiles(t), roles.profile_changes(t))
    return outcomes


@query("u4_update_by_name")
def u4_update_by_name(spark, sf_dir):
    t = Tables(spark, sf_dir)
    derived = U.derive_profiles(roles.users(t))
    lab = t.labels.select("doc_id", "toxic")
    cmds = lab.join(derived.select(F.col("id").alias("doc_id"), "nome"), "doc_id").select(
        F.col("doc_id").alias("seq"), "nome", F.when(F.col("toxic") == 1, "leitor").otherwise("editor").alias("papel"))
    return U.update_by_name(derived, cmds).select("id", "nome", "papel")


@query("u4_rename_by_name")
def u4_rename_by_name(spark, sf_dir):
    """Names set by name: good documents rename their person, toxic ones set the role."""
    t = Tables(spark, sf_dir)
    derived = U.derive_profiles(roles.users(t))
    lab = t.labels.select("doc_id", "quality", "toxic")
    cmds = lab.join(derived.select(F.col("id").alias("doc_id"), "nome"), "doc_id").select(
        F.col("doc_id").alias("seq"), "nome", F.when(F.col("toxic") == 1, "leitor").alias("papel"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Nome "), F.col("doc_id").cast("string"))).alias("novo_nome"))
    return U.update_by_name(derived, cmds).select("id", "nome", "papel")


@query("u4_update_in_order")
def u4_update_in_order(spark, sf_dir):
    """Commands by name whose renames decide what the next ones match."""
    t = Tables(spark, sf_dir)
    return U.update_by_name_in_order(roles.profiles(t), roles.name_commands(t)).select("id", "nome", "papel")


@query("u3_update_in_order")
def u3_update_in_order(spark, sf_dir):
    """Several partial updates per person, in order, by field."""
    t = Tables(spark, sf_dir)
    updated, _ = U.partial_profile_update(roles.profiles(t), roles.repeated_changes(t))
    return updated


@query("j9_remove_in_order")
def j9_remove_in_order(spark, sf_dir):
    """Several removal requests per person: the first that may, removes."""
    t = Tables(spark, sf_dir)
    _, _, outcomes = U.remove_people(roles.users(t), roles.profiles(t), roles.repeated_removals(t))
    return outcomes


@query("u2_command_log_people")
def u2_command_log_people(spark, sf_dir):
    """People after a log that creates, updates and removes them repeatedly."""
    t = Tables(spark, sf_dir)
    after, _ = U.apply_commands(roles.profiles(t), roles.people_log(t))
    return after


@query("u2_command_log_outcomes")
def u2_command_log_outcomes(spark, sf_dir):
    """What became of each command of that log."""
    t = Tables(spark, sf_dir)
    _, outcomes = U.apply_commands(roles.profiles(t), roles.people_log(t))
    return outcomes


@query("u5_normalise_email")
def u5_normalise_email(spark, sf_dir):
    return U.normalise_emails(roles.users(Tables(spark, sf_dir)).select("id", "email"))


@query("p4_changed_rows")
def p4_changed_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return U.changed_rows(roles.profiles(t), U.derive_profiles(roles.users(t)), "id", ["nome", "papel"])


@query("p5_role_check")
def p5_role_check(spark, sf_dir):
    u = roles.users(Tables(spark, sf_dir))
    return U.role_check(u.withColumn("_role", U.meta_field("raw_user_meta_data", "papel", "role")), "_role")


# ============================================================ access
def _actor_kinds(t: Tables) -> DataFrame:
    r = roles.requests(t)
    p = roles.profiles(t).select(F.col("id").alias("actor"), "papel")
    j = r.join(p, "actor", "left")
    kind = F.when(F.col("actor").isNull(), "anon").when(F.col("papel").isNull(), "sem_perfil").otherwise(F.col("papel"))
    return j.select(kind.alias("actor_kind"), X.actor_class("actor").alias("actor_class")).distinct()


def _sizes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, history, current = _e1(spark, sf_dir, materialize=True)
    return X.table_sizes(roles.profiles(t), current, history)


@query("x2_access_outcomes")
def x2_access_outcomes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return X.access_outcomes(roles.requests(t), roles.profiles(t)).select(
        "request_id", "actor", "verb", "tbl", "outcome")


@query("x1_visible_rows")
def x1_visible_rows(spark, sf_dir):
    return X.visible_rows(roles.requests(Tables(spark, sf_dir)), _sizes(spark, sf_dir))


@query("a1_row_counts")
def a1_row_counts(spark, sf_dir):
    return X.row_counts(_sizes(spark, sf_dir), _actor_kinds(Tables(spark, sf_dir)))


@query("x4_history_immutability")
def x4_history_immutability(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return X.history_immutability(X.access_outcomes(roles.requests(t), roles.profiles(t)))



# ============================================================ streaming
STREAM_PARTS = 4


@query("t1_stream_versioned_writes")
def t1_stream_versioned_writes(spark, sf_dir):
    """The write log replayed as 4 commits through per-document state; must
    equal the batch fold (v5)."""
    from quire.streaming.writes import replay_commits
    t = Tables(spark, sf_dir)
    w = roles.writes(t).select("doc_id", "seq", "actor", "expected_version")
    return replay_commits(spark, w, STREAM_PARTS, roles.profiles(t))


@query("t1_stream_trigger")
def t1_stream_trigger(spark, sf_dir):
    """T1 in full: the log with reloads arrives in commits over given documents;
    outcomes, before-images and current rows of the whole stream in one table."""
    from quire.streaming.trigger import replay
    t = Tables(spark, sf_dir)
    w = cut_lineage(roles.mixed_log(t), "mixed-log")
    # merged after every second commit, so that both ways of reading state occur
    done = replay(spark, w, roles.profiles(t), roles.given_base(w), STREAM_PARTS, merge_every=2)
    none = F.lit(None)
    writes = done.outcomes().select(
        F.lit("write").alias("kind"), "doc_id", "seq", "outcome", none.cast("bigint").alias("epoch"), "version",
        none.cast("timestamp_ntz").alias("updated_at"), none.cast("string").alias("updated_by"), none.cast("string").alias("doc"))
    image = ["epoch", "version", "updated_at", "updated_by", "doc"]
    old = done.history().select(F.lit("before").alias("kind"), "doc_id", F.col("hist_id").alias("seq"), none.cast("string").alias("outcome"), *image)
    now = done.current(done.commits).select(
        F.lit("now").alias("kind"), "doc_id", none.cast("bigint").alias("seq"), none.cast("string").alias("outcome"), *image)
    return writes.unionByName(old).unionByName(now)


@query("t2_stream_profiles")
def t2_stream_profiles(spark, sf_dir):
    """Users arrive in 4 batches; profiles are derived and inserted when
    absent - the table afterwards equals j6."""
    from quire.streaming.profiles import replay_profiles
    t = Tables(spark, sf_dir)
    table = D.stage_parquet(roles.profiles(t), "t2-profiles")
    users = roles.users(t).withColumn("seq", F.col("id"))
    return replay_profiles(spark, users, STREAM_PARTS, table)


@query("t3_stream_provisional_flag")
def t3_stream_provisional_flag(spark, sf_dir):
    """Flag events in 4 batches; the merged snapshot equals v9."""
    from quire.streaming.flags import run_flags
    from quire.streaming.writes import stage_log
    t = Tables(spark, sf_dir)
    ev = roles.flag_events(t).withColumn("seq", F.col("event_id"))
    return run_flags(spark, stage_log(ev, STREAM_PARTS, "t3-events"), roles.profiles(t))


@query("x3_scenario_report")
def x3_scenario_report(spark, sf_dir):
    """Every event as a scripted step (reads, writes, forged claims,
    stale versions, reader writes, history deletes) against its document."""
    t = Tables(spark, sf_dir)
    w = roles.writes(t)
    return X.scenario_report(roles.scenario_steps(t, w), roles.profiles(t), roles.base_documents(w))


@query("x3_scenario_report_chunked")
def x3_scenario_report_chunked(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = roles.writes(t, SMALL_CHUNK)
    return X.scenario_report(roles.scenario_steps(t, w), roles.profiles(t), roles.base_documents(w), SMALL_CHUNK)
