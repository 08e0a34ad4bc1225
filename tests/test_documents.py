"""Document operators: nested vs flat forms agree; array edge cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions import nested as N
from quire.operators import documents as DO
from quire.sources import documents as D
from quire.sources.tables import Tables
from tests.conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def ds(spark):
    return D.from_tables(Tables(spark, SF_SMALL))


@pytest.fixture(scope="module")
def nested(ds):
    return D.nest(ds).cache()


def test_flat_and_nested_counts_agree(ds, nested):
    assert rows(DO.entity_counts(ds)) == rows(DO.entity_counts_nested(nested))
    known = ds.header.select("doc_id")
    flat = DO.blocking_items(ds).join(known, "doc_id", "left_semi")
    assert rows(flat) == rows(DO.blocking_items_nested(nested))
    first = DO.first_transition_author_flat(ds).join(known, "doc_id", "left_semi")
    assert rows(first) == rows(DO.first_transition_author(nested))


def test_flatten_rebuild_round_trip_keeps_order(ds, nested):
    flat = D.flatten(nested, "deals").select("doc_id", "pos", "id")
    rebuilt = D.rebuild_arrays(flat.withColumnRenamed("pos", "p").withColumn("pos", F.col("p")),
                               ["doc_id"], ["id"], "deals")
    back = rebuilt.select("doc_id", F.transform("deals", lambda e: e["id"]).alias("ids"))
    orig = nested.select("doc_id", F.transform("doc.deals", lambda e: e["id"]).alias("ids"))
    nonempty = orig.where(F.size("ids") > 0)
    assert rows(back) == rows(nonempty)


def test_export_load_round_trip(spark, nested):
    from quire.session import shared_path
    path = D.export_documents(nested, shared_path(spark, "test-export"))
    back = D.load_documents(spark, path)
    assert back.where(F.col("reason").isNotNull()).count() == 0
    got = back.select("doc_id", D.variant_array_len(F.col("doc"), "$.doc.deals").alias("n"))
    want = nested.select("doc_id", F.size("doc.deals").cast("bigint").alias("n"))
    assert rows(got) == rows(want)


def test_missing_vs_empty_array(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, deals array<struct<id:string,bloqueante:boolean>>")
    got = rows(df.select("doc_id", N.array_len("deals").alias("n"), N.has_id("deals", F.lit("x")).alias("h"),
                         N.count_where("deals", lambda e: e["bloqueante"]).alias("c"),
                         N.first_field("deals", "id").alias("f")))
    assert got == [(1, None, False, 0, None), (2, 0, False, 0, None)]


def test_parse_reasons(spark):
    df = spark.createDataFrame([("a", '{"doc_id": 1, "deals": []}'), ("b", "[1,2]"), ("c", "5"), ("d", "nope"),
                                ("e", '{"doc_id": 2}'), ("f", '{"doc_id": "x7"}'), ("g", '{"deals": []}')], "k string, t string")
    got = {r["k"]: (r["doc_id"], r["reason"]) for r in D.parse_documents(df, "t").collect()}
    assert got == {"a": (1, None), "b": (None, "not_object"), "c": (None, "not_object"),
                   "d": (None, "not_json"), "e": (2, None), "f": (None, "bad_key"), "g": (None, "bad_key")}
    # array present vs missing
    v = D.parse_documents(df, "t").select("k", D.variant_array_len(F.col("doc"), "$.deals").alias("n"))
    assert {r["k"]: r["n"] for r in v.collect()}["a"] == 0
    assert {r["k"]: r["n"] for r in v.collect()}["e"] is None


def test_read_envelope_forms(spark):
    bodies = spark.createDataFrame([(1, '[{"id": 1, "email": "a"}]'), (2, '{"users": [{"id": 2}]}'), (6, '[{"id": 6}] x'),
                                    (3, '{"other": 1}'), (4, '7'), (5, 'garbage')], "page long, body string")
    assert rows(D.read_envelope(bodies)) == [(1, "1", "a"), (2, "2", None)]


def test_scan_columns_missing_path(spark):
    out = D.scan_columns(spark, "/nonexistent/quire/path", ["id", "nome"], "id long, nome string")
    assert out.count() == 0 and out.columns == ["id", "nome"]


def flat_set(spark):
    h = spark.createDataFrame([(1, 1, None, "x"), (2, 1, None, "x")], "doc_id long, version int, updated_at timestamp_ntz, updated_by string")
    deals = spark.createDataFrame([(1, 0, "N-1", "a", ""), (1, 1, "N-2", "b", "n")],
                                  "doc_id long, pos long, id string, responsavel string, notas string")
    cust = spark.createDataFrame([(1, 0, "C-1", "c")], "doc_id long, pos long, id string, nome string")
    empty = spark.createDataFrame([], "doc_id long, pos long, id string")
    return D.DocumentSet(h, empty, cust, deals, empty, empty)


def test_patch_is_shallow_and_null_overrides(spark):
    ds = flat_set(spark)
    patches = spark.createDataFrame([(1, "N-2", {"responsavel": "z", "notas": None}), (2, "N-9", {"notas": "q"})],
                                    "doc_id long, id string, patch map<string,string>")
    got = rows(DO.patch_elements(ds, "deals", patches).deals, "doc_id", "id", "responsavel", "notas")
    assert got == [(1, "N-1", "a", ""), (1, "N-2", "z", None)]


def test_append_guard_and_idempotence(spark):
    ds = flat_set(spark)
    nc = spark.createDataFrame([(1, 1, "C-1", "dup"), (2, 1, "C-5", "new"), (3, 1, "C-7", "ghost")],
                               "doc_id long, _k long, id string, nome string")
    nd = spark.createDataFrame([(1, 1, "N-3", "p", ""), (2, 1, "N-3", "p", ""), (3, 1, "N-3", "p", "")],
                               "doc_id long, _k long, id string, responsavel string, notas string")
    out, rep = DO.append_if_absent(ds, nc, nd)
    assert rows(rep) == [(1, True), (2, True), (3, False)]          # doc 3 does not exist
    assert rows(out.customers, "doc_id", "id") == [(1, "C-1"), (1, "C-1"), (2, "C-5")]   # existing id duplicated
    assert rows(out.deals, "doc_id", "pos", "id") == [(1, 0, "N-1"), (1, 1, "N-2"), (1, 2, "N-3"), (2, 0, "N-3")]
    again, rep2 = DO.append_if_absent(out, nc, nd)                   # re-run: guard holds, content unchanged
    assert rows(rep2) == [(1, False), (2, False), (3, False)]
    assert rows(again.deals) == rows(out.deals) and rows(again.customers) == rows(out.customers)


def test_nested_append_guard(spark):
    df = spark.createDataFrame([(1, 1, None, "x", ([("C-1",)], [("N-1",)]))],
                               "doc_id long, version int, updated_at timestamp_ntz, updated_by string, "
                               "doc struct<customers:array<struct<id:string>>, deals:array<struct<id:string>>>")
    p = spark.createDataFrame([(1, ("C-1",), ("N-2",))], "doc_id long, customer struct<id:string>, deal struct<id:string>")
    once = DO.append_if_absent_nested(df, p)
    assert once.first()["appended"] is True
    twice = DO.append_if_absent_nested(once.drop("appended"), p)
    r = twice.first()
    assert r["appended"] is False and len(r["doc"]["customers"]) == 2 and len(r["doc"]["deals"]) == 2


def test_several_patches_of_one_element_and_a_patched_id(spark):
    ds = flat_set(spark)
    p = spark.createDataFrame([(1, "N-1", 2, {"responsavel": "z"}), (1, "N-1", 1, {"responsavel": "a", "notas": "n"}),
                               (1, "N-2", 1, {"id": "N-9"})], "doc_id long, id string, seq int, patch map<string,string>")
    out = DO.patch_elements(ds, "deals", p).deals
    assert rows(out.where("doc_id = 1"), "id", "responsavel", "notas")[0] == ("N-1", "z", "n")
    assert {r[0] for r in rows(out.where("doc_id = 1"), "id")} == {"N-1", "N-9"}
    assert out.count() == ds.deals.count()


def test_last_of_equal_keys_wins(spark):
    df = spark.createDataFrame([("a", '{"x": 1, "x": 2}')], "k string, t string")
    d = D.parse_documents(df, "t", key=None)
    assert d.select(D.F.try_variant_get("doc", "$.x", "int").alias("x"), "reason").first()[:] == (2, None)


def test_missing_array_is_quarantined(spark):
    df = spark.createDataFrame([("a", '{"partners": [], "customers": [], "deals": []}'),
                                ("b", '{"partners": [], "customers": []}'),
                                ("c", '{"partners": [], "customers": [], "deals": null}'),
                                ("d", '{"partners": [], "customers": [], "deals": 3}')], "k string, t string")
    good, bad = D.quarantine(D.parse_documents(df, "t", key=None, arrays_at="$"))
    assert [r["k"] for r in good.collect()] == ["a"]
    assert rows(bad, "k", "reason") == [("b", "missing_array"), ("c", "missing_array"), ("d", "missing_array")]


def test_whole_text_must_be_one_json_value(spark):
    cases = {"a": ("123 abc", None), "b": ('{"a":1} xyz', None), "c": ('[1,2] 3', None), "d": ('  {"a": 1}\n', "o"),
             "e": ('5', "s"), "f": ('{"a":1}, {"b":2}', None), "g": ('{"a":1}] x', None),
             "h": ('{"a":1}\n,"\\u0000quire-end"] junk', None), "i": ('{"x": "\\u0000quire-end"}', "o")}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, t string")
    got = {r["k"]: r["reason"] for r in D.parse_documents(df, "t", key=None).collect()}
    want = {k: {None: "not_json", "o": None, "s": "not_object"}[v[1]] for k, v in cases.items()}
    assert got == want


def test_nest_moves_an_order_and_its_lines_once(spark, ds):
    """Rows of a document are dealt out once, by document, and as the tables have
    them: no text of an element's fields crosses a shuffle."""
    plan = D.nest(ds)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("REPARTITION_BY_COL"):]
    assert "o_orderpriority" in below and "l_partkey" in below
    assert "part " not in below and "supplier-" not in below and "date_format" not in below and "Order " not in below


def test_nest_of_flat_and_compact_rows_is_the_same(spark, ds):
    flat = D.DocumentSet(ds.header, ds.partners, ds.customers, ds.deals, ds.items, ds.transitions)
    some = D.nest(ds.with_kind("items", ds.items))
    want = rows(D.nest(ds).select("doc_id", F.to_json("doc").alias("j")))
    assert rows(D.nest(flat).select("doc_id", F.to_json("doc").alias("j"))) == want
    assert rows(some.select("doc_id", F.to_json("doc").alias("j"))) == want


def test_nest_of_repeated_and_missing_keys(spark):
    """Repeated documents and deals come with all their elements each; elements of
    missing deals, documents or ids are in no document."""
    ds = flat_set(spark)
    none = "cast(null as string) as "
    ds = D.DocumentSet(
        ds.header.unionByName(ds.header.where("doc_id = 1")),
        spark.createDataFrame([], "doc_id long, pos long, id string, nome string, responsavel string, tier string, status string"),
        ds.customers.selectExpr("*", *[none + f for f in ("tipo", "setor", "uf", "publico")], "0L as receitaRecorrente"),
        spark.createDataFrame([(1, 2, "N-1"), (1, 1, "N-1"), (1, 0, None), (None, 0, "N-1"), (9, 0, "N-1")], "doc_id long, pos long, id string").selectExpr(
            "*", *[none + f for f in D.DEAL_FIELDS if f != "id"]),
        spark.createDataFrame([(1, "N-1", 1, "b"), (1, "N-1", 0, "a"), (1, None, 0, "c"), (None, "N-1", 0, "d"), (2, "N-1", 0, "e")],
                              "doc_id long, deal_id string, pos long, id string").selectExpr(
            "*", none + "texto", none + "responsavel", none + "prazo", "true as bloqueante", "false as resolvida"),
        spark.createDataFrame([(1, "N-1", 0, "2")], "doc_id long, deal_id string, pos long, para string").selectExpr("*", none + "quem", none + "quando"))
    got = [(r.doc_id, [c.id for c in r.doc.customers], [(d.id, [i.id for i in d.pendencias], [x.para for x in d.historico]) for d in r.doc.deals])
           for r in D.nest(ds).collect()]
    one = (1, ["C-1"], [(None, [], []), ("N-1", ["a", "b"], ["2"]), ("N-1", ["a", "b"], ["2"])])
    assert sorted(got, key=lambda r: r[0]) == [one, one, (2, [], [])]


def test_export_is_compressed(spark, nested):
    from quire.session import shared_path
    path = D.export_documents(nested, shared_path(spark, "test-export"))
    files = spark.read.text(path).inputFiles()
    assert files and all(f.endswith(".gz") for f in files)


def test_reference_check_of_repeated_and_missing_ids(spark):
    """References and elements meet in one grouping, without a join of sorted rows."""
    deals = spark.createDataFrame(
        [(1, "C-1", "P-1"), (1, "C-1", "P-9"), (1, None, "P-1"), (None, "C-1", None), (2, "C-2", None)],
        "doc_id long, clienteId string, parceiroId string")
    ids = "doc_id long, id string"
    customers = spark.createDataFrame([(1, "C-1"), (1, "C-1"), (None, "C-1"), (1, "P-9"), (3, "C-3")], ids)
    partners = spark.createDataFrame([(1, "P-1"), (1, None), (2, "C-2")], ids)
    out = DO.reference_check(D.DocumentSet(None, partners, customers, deals, None, None))
    assert rows(out, "doc_id", "ref_kind", "refs", "missing") == rows(spark.createDataFrame(
        [(1, "customer", 2, 0), (1, "partner", 3, 1), (None, "customer", 1, 1), (2, "customer", 1, 1)],
        "doc_id long, ref_kind string, refs long, missing long"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_deal_check_reads_the_lines_of_asked_deals_once(spark, ds):
    pairs = ds.deals.where(F.col("pos") % 3 == 0).select("doc_id", F.col("id").alias("deal_id"), F.col("clienteId").alias("customer_id"))
    pairs = spark.createDataFrame(pairs.collect(), pairs.schema)
    one = DO.deal_customer_check(ds, pairs)
    plain = D.DocumentSet(ds.header, ds.partners, ds.customers, ds.deals, ds.items, ds.transitions)
    assert rows(one) == rows(DO.deal_customer_check(plain, pairs)) and one.count() > 50
    assert sum("Relation" in line and "l_orderkey" in line for line in one._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 1
