"""Writes that carry operations: documents at every version against a literal replay."""

import json
import random

import pytest

from quire.operators import operations as O

LOG = "doc_id long, seq long, version int, op string, field string, payload string, other int"


def ident(x):
    return None if not isinstance(x, dict) or x.get("id") is None else str(x["id"])


def apply(doc, op, field, payload):
    try:
        value = json.loads(payload)
    except (TypeError, ValueError):
        return doc
    if op == "replace":
        return value if isinstance(value, dict) else doc
    if field is None:
        return doc
    if op == "set":
        return doc | {field: value}
    if op not in ("append", "patch") or ident(value) is None:
        return doc
    have = doc.get(field, [] if op == "append" else None)
    if not isinstance(have, list):
        return doc
    if op == "append":
        return doc if any(ident(e) == ident(value) for e in have) else doc | {field: have + [value]}
    return doc | {field: [e | {k: v for k, v in value.items() if k != "id"} if ident(e) == ident(value) else e for e in have]}


def random_operation(rnd, n):
    op = rnd.choice(["append"] * 4 + ["patch"] * 6 + ["set", "replace", "other", None])
    field = rnd.choice(["deals", "deals", "customers", "a b", None])
    element = {"id": rnd.choice([1, "1", "x", "y\"z", None]), rnd.choice("pqr"): rnd.choice([n, None, "é\n", [1, {"k": n}], {"m": n}, True])}
    if op == "set":
        payload = rnd.choice([[], [element, {"id": "x"}, {"id": "x", "twice": 1}, 5, None, [1]], n, None, {"id": "x"}, "text"])
    elif op == "replace":
        payload = rnd.choice([{}, {"deals": [{"id": "x", "p": 0}], "flag": n}, {"customers": None}, [1], {"deals": 7}])
    else:
        payload = element
    text = json.dumps(payload)
    return op, field, rnd.choice([text] * 9 + [text + " tail", None, "{"])


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_documents_at_every_version_equal_a_literal_replay(spark, chunk):
    rnd = random.Random(chunk)
    base = [(0, 3, '{"deals":[{"id":1,"p":0}],"note":"n"}'), (1, 1, "{}"), (2, 1, None)]
    state = {0: (3, json.loads(base[0][2])), 1: (1, {}), 2: (1, {}), 3: (0, {})}
    want, log = {(d, v): doc for d, (v, doc) in state.items() if d != 3}, []
    for n in range(240):
        d = rnd.choice([0, 0, 0, 0, 1, 2, 3])
        op, field, payload = random_operation(rnd, n)
        version, doc = state[d]
        state[d] = (version + 1, apply(doc, op, field, payload))
        want[d, version + 1] = state[d][1]
        log.append((d, 1000 * n if n % 2 else 1000 * n + 7, version + 1, op, field, payload, n))
    log.sort(key=lambda r: r[1])
    rnd.shuffle(log)
    rows = O.scoped_log(spark.createDataFrame(log, LOG), spark.createDataFrame(base, "doc_id long, version int, doc string"), chunk)
    ask = spark.createDataFrame(list(want) + [(0, 9999), (77, 1), (None, 1), (0, None), (0, 3)], "doc_id long, version int")
    got = {(r.doc_id, r.version): r.doc for r in O.documents_at(rows, ask).collect()}
    assert set(got) == set(want)
    for k in want:
        assert json.loads(got[k]) == want[k], k


def test_empty_log_and_base(spark):
    log, base = spark.createDataFrame([], LOG), spark.createDataFrame([], "doc_id long, version int, doc string")
    ask = spark.createDataFrame([(1, 1)], "doc_id long, version int")
    rows = O.scoped_log(log, base)
    assert O.documents_at(rows, ask).count() == 0 and O.elements_at(rows, ask).count() == 0
