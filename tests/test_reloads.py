"""Reloads in the write log (S2 with V5), the full streaming trigger (T1), names
changed in order (U4), repeated people commands (U3, J9), open documents (M2, M3)."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import open_documents as OD
from quire.operators import people as U
from quire.operators import versions as V
from quire.operators.ordering import CHUNK, even_chunks
from quire.session import cut_lineage, shared_path
from quire.streaming import trigger as T

PEOPLE = [(1, "Ana", "editor"), (2, "Bia", "leitor")]


def make_log(rnd, n, step=1):
    out = []
    for i in range(n):
        load = rnd.random() < 0.08
        exp = None if load or rnd.random() < 0.2 else rnd.randint(1, 6)
        out.append((rnd.choice([0, 0, 0, 1, 2]), i * step, rnd.choice([1, 1, 2, None]), exp, load, i % 7, f'{{"v":{i}}}'))
    return out


def frame(spark, log):
    df = spark.createDataFrame(log, "doc_id long, seq long, actor long, expected_version int, load boolean, n_deals long, doc string")
    return df.withColumn("ts", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,seq % 100000)"))


def replay(log, base):
    """(outcomes, history, current) of a literal replay; images are (epoch, version, doc, by)."""
    people = {k: (n, p) for k, n, p in PEOPLE}
    state, out, history = dict(base), {}, {}
    for doc, seq, actor, exp, load, _, text in sorted(log, key=lambda x: x[1]):
        old = state.get(doc)
        version = old[1] if old else 1
        if load:
            state[doc] = ((old[0] if old else 0) + 1, 1, text, "carga inicial")
            out[seq] = ("loaded", 1)
        elif people.get(actor, ("", ""))[1] != "editor":
            out[seq] = ("forbidden", None)
        elif exp is not None and exp != version:
            out[seq] = ("conflict", None)
        else:
            history[seq] = old
            state[doc] = (old[0] if old else 0, version + 1, text, people[actor][0])
            out[seq] = ("applied", version + 1)
    return out, history, state


def base_rows(spark):
    return spark.createDataFrame([(0, 2, "{}", 0, "x", 3), (1, 1, "{}", 0, "x", 0), (2, 4, "{}", 0, "x", 0)],
                                 "doc_id long, version int, doc string, n_deals long, updated_by string, epoch long") \
        .withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))


BASE = {0: (3, 2, "{}", "x"), 1: (0, 1, "{}", "x"), 2: (0, 4, "{}", "x")}


@pytest.mark.parametrize("seed,width", [(1, 1), (2, 5), (3, 64), (4, 1 << 20)])
def test_log_with_reloads_equals_replay(spark, seed, width):
    log = make_log(random.Random(seed), 160)
    profiles = spark.createDataFrame(PEOPLE, "id long, nome string, papel string")
    outcomes, history, current = V.apply_log(frame(spark, log), profiles, base_rows(spark), width)
    out, hist, state = replay(log, BASE)
    assert {r.seq: (r.outcome, r.version) for r in outcomes.collect()} == out
    assert {r.hist_id: (r.epoch, r.version, r.doc, r.updated_by) for r in history.collect()} == hist
    assert {r.doc_id: (r.epoch, r.version, r.doc, r.updated_by) for r in current.collect()} == state


def test_chunks_are_even_whatever_the_order_values(spark):
    rows = [(0, i) for i in range(3000)] + [(0, 10 ** 15)] + [(1, -i * 10 ** 6) for i in range(1, 500)]
    df = cut_lineage(spark.createDataFrame(rows, "doc_id long, seq long").repartition(5))
    got, top = even_chunks(df, "doc_id", "seq", 64)
    sizes, bounds = {}, {}
    for r in got.collect():
        sizes[r.doc_id, r[CHUNK]] = sizes.get((r.doc_id, r[CHUNK]), 0) + 1
        a, b = bounds.get((r.doc_id, r[CHUNK]), (r.seq, r.seq))
        bounds[r.doc_id, r[CHUNK]] = (min(a, r.seq), max(b, r.seq))
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) <= 64 and top == max(c for _, c in sizes)
    for doc in (0, 1):
        own = [bounds[doc, c] for c in sorted(c for d, c in sizes if d == doc)]
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))


def test_trigger_over_commits_and_a_restart(spark):
    log = make_log(random.Random(9), 120, step=10 ** 6)
    profiles = spark.createDataFrame(PEOPLE, "id long, nome string, papel string")
    names = [f.split()[0] for f in T.LOG_SCHEMA.split(", ")]
    df = cut_lineage(frame(spark, log).select(*names).repartition(3))
    inbox, root = shared_path(spark, "inbox"), shared_path(spark, "trigger")
    T.Trigger(spark, root, profiles, merge_every=2).start(base_rows(spark))
    for k in range(3):                        # each commit by a new process's object
        df.where((F.col("seq") >= k * 40 * 10 ** 6) & (F.col("seq") < (k + 1) * 40 * 10 ** 6)).write.mode("append").parquet(inbox)
        t = T.Trigger(spark, root, profiles, merge_every=2)
        n = t.run(inbox)
    assert n == 3
    out, hist, state = replay(log, BASE)
    assert {r.seq: (r.outcome, r.version) for r in t.outcomes().collect()} == out
    assert {r.hist_id: (r.epoch, r.version, r.doc, r.updated_by) for r in t.history().collect()} == hist
    assert {r.doc_id: (r.epoch, r.version, r.doc, r.updated_by) for r in t.current(n).collect()} == state
    again = cut_lineage(spark.read.schema(T.LOG_SCHEMA).parquet(f"{root}/log/2"))
    t.commit(again, 2)                        # a commit run again writes the same rows
    assert {r.hist_id: (r.epoch, r.version) for r in t.history().collect()} == {k: v[:2] for k, v in hist.items()}


@pytest.mark.parametrize("seed", range(4))
def test_names_in_order_equal_a_replay(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "c", "d", None]
    people = [(i, rnd.choice(names), rnd.choice(["editor", "leitor"])) for i in range(12)]
    cmds = [(s, rnd.choice(names), rnd.choice([None, "editor", "leitor"]), rnd.choice([None, None, "a", "b", "c", "d", "e"])) for s in range(1, 25)]
    state = {i: [n, p] for i, n, p in people}
    for _, name, role, new in cmds:
        for v in state.values():
            if name is not None and v[0] == name:
                v[0], v[1] = new if new is not None else v[0], role if role is not None else v[1]
    got = U.update_by_name(spark.createDataFrame(people, "id long, nome string, papel string"),
                           spark.createDataFrame(cmds, "seq long, nome string, papel string, novo_nome string"))
    assert {r.id: [r.nome, r.papel] for r in got.collect()} == state


def test_repeated_people_commands(spark):
    profiles = spark.createDataFrame([(1, "Old", "leitor", "a", False)], "id long, nome string, papel string, email string, senha_provisoria boolean")
    cmds = spark.createDataFrame([(1, 1, " New ", None), (2, 1, " ", "editor"), (3, 1, None, "x")], "cmd_id long, id long, nome string, papel string")
    updated, outcomes = U.partial_profile_update(profiles, cmds)
    assert [(r.nome, r.papel) for r in updated.collect()] == [("New", "editor")]
    assert {r.cmd_id: r.reason for r in outcomes.collect()} == {1: None, 2: None, 3: "nada-para-salvar"}
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, email string")
    asked = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 1, 9), (4, 7, 9), (5, None, 9), (6, 2, 2)], "request_id long, target long, actor long")
    left, _, outcomes = U.remove_people(users, profiles, asked)
    assert [r.id for r in left.collect()] == [2]
    assert {r.request_id: r.outcome for r in outcomes.collect()} == {
        1: "nao-remove-a-si", 2: "removido", 3: "remover-falhou", 4: "remover-falhou", 5: "sem-id", 6: "nao-remove-a-si"}


DOC = {"a": {"b": [1, {"c": None}, "x"]}, "n": None}


@pytest.mark.parametrize("path,create,want", [
    (["a", "b", 0], True, {"a": {"b": [{"v": 1}, {"c": None}, "x"]}, "n": None}),
    (["a", "b", -1], True, {"a": {"b": [1, {"c": None}, {"v": 1}]}, "n": None}),
    (["a", "b", 9], True, {"a": {"b": [1, {"c": None}, "x", {"v": 1}]}, "n": None}),
    (["a", "b", -9], True, {"a": {"b": [{"v": 1}, 1, {"c": None}, "x"]}, "n": None}),
    (["a", "b", 9], False, DOC), (["new"], False, DOC),
    (["new"], True, {**DOC, "new": {"v": 1}}), (["n"], True, {**DOC, "n": {"v": 1}}),
    (["a", "b", 1, "c"], False, {"a": {"b": [1, {"c": {"v": 1}}, "x"]}, "n": None}),
    (["missing", "x"], True, DOC), (["a", "b", 0, "x"], True, DOC), (["a", "z", 0], True, DOC), (["n", "x"], True, DOC)])
def test_set_at(spark, path, create, want):
    df = spark.createDataFrame([(1, json.dumps(DOC))], "doc_id long, t string").select("doc_id", F.parse_json("t").alias("doc"))
    sent = spark.createDataFrame([(1, '{"v": 1}')], "doc_id long, t string").select("doc_id", F.parse_json("t").alias("value"))
    row = OD.set_path(df, path, sent, create).select("reason", F.to_json("doc").alias("j")).first()
    assert row.reason is None and json.loads(row.j) == want
    null = sent.select("doc_id", F.try_parse_json(F.lit("no json")).alias("value"))
    row = OD.set_path(df, path, null, create).select("reason", F.to_json("doc").alias("j")).first()
    assert row.reason == "null_value" and json.loads(row.j) == DOC


def test_open_patches_keep_unknown_keys_and_types(spark):
    doc = {"deals": [{"id": "N-1", "x": 1, "y": {"z": 1}}, {"id": "N-2", "k": 1.5}, 7, {"no": "id"}], "other": [1]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(doc)), (3, '{"deals": 5}')], "doc_id long, t string") \
        .select("doc_id", F.parse_json("t").alias("doc"))
    patches = spark.createDataFrame([(1, "N-1", 2, '{"y": {"w": 2}, "cnpj": "00"}'), (1, "N-1", 1, '{"cnpj": 1, "list": [1, "a"]}'),
                                     (1, "N-2", 1, '{"k": null, "id": "N-9"}'), (1, "N-2", 3, "[1]"), (2, "N-7", 1, '{"q": 1}'),
                                     (3, "N-1", 1, '{"q": 1}')], "doc_id long, id string, seq long, patch string")
    got = {r.doc_id: json.loads(r.j) for r in OD.patch_elements(df, ["deals"], patches).select("doc_id", F.to_json("doc").alias("j")).collect()}
    want = {"deals": [{"id": "N-1", "x": 1, "y": {"w": 2}, "cnpj": "00", "list": [1, "a"]}, {"id": "N-9", "k": None}, 7, {"no": "id"}], "other": [1]}
    assert got == {1: want, 2: doc, 3: {"deals": 5}}


def test_set_at_works_out_each_part_once(spark):
    """A value or document that stands in an expression several times is worked out
    as often, and once more for each key of the objects around it."""
    for path in (["a"], ["a", "b", 0, "c"], ["a", -1, "b", "c", "d", "e"]):
        text = str(OD.set_at(F.col("the_doc"), path, F.parse_json(F.col("the_value"))))
        assert text.count("the_value") == 1 and text.count("the_doc") <= 2


def test_merge_works_out_a_patch_once(spark):
    text = str(OD.merged(F.col("old"), F.try_variant_get(F.try_parse_json("the_patch"), "$", "map<string,variant>")))
    assert text.count("the_patch") == 1
