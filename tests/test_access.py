"""Access decisions and the scripted three-actor scenario (expected results
derived by reading the scenario script; see SURVEY section 5)."""

from pyspark.sql import functions as F

from quire.operators import access as X
from tests.conftest import rows

EDITOR, READER, NOPROFILE = 11, 22, 33


def profiles(spark):
    return spark.createDataFrame([(EDITOR, "Ana", "editor", None, False), (READER, "Bruna", "leitor", None, False)],
                                 "id long, nome string, papel string, email string, senha_provisoria boolean")


def test_decision_table(spark):
    reqs = []
    i = 0
    for actor in (None, EDITOR, READER, NOPROFILE):
        for tbl in X.TABLES:
            for verb in ("select", "update", "insert", "delete"):
                i += 1
                reqs.append((i, actor, verb, tbl))
    df = spark.createDataFrame(reqs, "request_id long, actor long, verb string, tbl string")
    out = {(r["actor"], r["tbl"], r["verb"]): r["outcome"] for r in X.access_outcomes(df, profiles(spark)).collect()}
    for tbl in X.TABLES:
        for verb in ("select", "update", "insert", "delete"):
            assert out[(None, tbl, verb)] == "denied"
    for actor in (EDITOR, READER, NOPROFILE):
        for tbl in X.TABLES:
            assert out[(actor, tbl, "select")] == "allowed"
            assert out[(actor, tbl, "insert")] == "denied"
            assert out[(actor, tbl, "delete")] == "denied"
    assert out[(EDITOR, "pipeline", "update")] == "allowed"
    assert out[(READER, "pipeline", "update")] == "no_rows"
    assert out[(NOPROFILE, "pipeline", "update")] == "no_rows"
    assert out[(EDITOR, "perfil", "update")] == "denied"


def test_service_bypasses(spark):
    df = spark.createDataFrame([(1, None, "delete", "pipeline_historico", True)],
                               "request_id long, actor long, verb string, tbl string, service boolean")
    assert X.access_outcomes(df, profiles(spark)).first()["outcome"] == "allowed"


def test_scenario(spark):
    S = "step long, doc_id long, actor long, verb string, tbl string, expected_version int, " \
        "claimed_version int, claimed_author string, n_deals long"
    steps = [
        (1, 1, None, "select", "perfil", None, None, None, None),
        (2, 1, None, "select", "pipeline", None, None, None, None),
        (3, 1, None, "select", "pipeline_historico", None, None, None, None),
        (4, 1, None, "update", "pipeline", None, None, None, 0),
        (5, 1, EDITOR, "select", "pipeline", None, None, None, None),
        (6, 1, EDITOR, "update", "pipeline", None, None, None, 2),
        (7, 1, EDITOR, "select", "pipeline", None, None, None, None),
        (8, 1, EDITOR, "update", "pipeline", None, 999, "Mallory", 2),
        (9, 1, EDITOR, "update", "pipeline", 1, None, None, 0),
        (10, 1, READER, "select", "pipeline", None, None, None, None),
        (11, 1, READER, "update", "pipeline", None, None, None, 0),
        (12, 1, READER, "delete", "pipeline_historico", None, None, None, None),
    ]
    n = 5  # version after the unattributed write that loads one deal
    base = spark.createDataFrame([(1, n, None, 1, None, "desconhecido")],
                                 "doc_id long, version int, doc string, n_deals long, updated_at timestamp_ntz, updated_by string")
    out = {r["step"]: r for r in X.scenario_report(spark.createDataFrame(steps, S), profiles(spark), base, chunk_width=2).collect()}
    for s in (1, 2, 3, 4):
        assert out[s]["outcome"] == "denied" and out[s]["version"] is None
    assert (out[5]["outcome"], out[5]["version"], out[5]["deals"]) == ("allowed", n, 1)
    assert out[6]["outcome"] == "applied"
    assert (out[7]["version"], out[7]["author"], out[7]["deals"], out[7]["history"]) == (n + 1, "Ana", 2, 1)
    assert (out[8]["outcome"], out[8]["version"], out[8]["author"]) == ("applied", n + 2, "Ana")
    assert (out[9]["outcome"], out[9]["version"]) == ("conflict", n + 2)
    assert out[10]["version"] == n + 2
    assert out[11]["outcome"] == "no_rows" and out[11]["version"] == n + 2
    assert out[12]["outcome"] == "denied" and out[12]["history"] == 2


def test_visible_rows_is_per_actor_not_per_row(spark):
    sizes = spark.createDataFrame([("perfil", 2), ("pipeline", 1), ("pipeline_historico", 7)], "tbl string, rows long")
    actors = spark.createDataFrame([(None,), (EDITOR,), (EDITOR,)], "actor long")
    got = rows(X.visible_rows(actors, sizes), "actor", "tbl", "visible_rows")
    assert got == [(11, "perfil", 2), (11, "pipeline", 1), (11, "pipeline_historico", 7),
                   (None, "perfil", 0), (None, "pipeline", 0), (None, "pipeline_historico", 0)]
