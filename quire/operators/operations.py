"""A write log whose writes carry operations instead of whole documents, and the
documents at any version rebuilt from it (M1, M2, M3 and M5 as one ordered fold).

An operation changes one top-level ``field`` of an open document, or all of it:

* ``append``   adds the object ``payload`` to the array at ``field`` unless an
  element with its ``id`` is there; a missing field becomes an array;
* ``patch``    merges ``payload`` (an object) into every element with its ``id``;
* ``set``      replaces the value at ``field``;
* ``replace``  replaces the document (an object).

An operation that cannot be read (unknown kind, no JSON, no field, no ``id``),
and one that finds no array, no element or its element already there, leaves the
document as it is; it has a version all the same, as a write that changes nothing.

The fold is not played row by row. A ``set`` or ``replace`` starts a new *scope*
of a field: its commit number. Within a scope elements only come and keys are only
overlaid, so at any moment an element is there if its first row is, and a key has
the value of the latest patch after that row. Elements and patches are rows with
their scope; a version is the rows of its scopes up to its commit number, latest
per key by a partial ``max_by``. So one document with a large share of the log is
spread over tasks by element and key, and any number of versions share one pass.

Log: doc_id, seq (unique, rising), version (of the document after the write: rows
of applied writes only), op, field, payload (JSON text). Base: doc_id, version,
doc (JSON text); a document without a base row begins empty. Ids of elements are
compared as text and stay as they are under a patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.open_documents import as_array, as_object, merged
from quire.operators.ordering import DEFAULT_CHUNK, ordered_last
from quire.session import cut_lineage
from quire.sources.documents import parse_json_strict

APPEND, PATCH, SET, REPLACE = "append", "patch", "set", "replace"
#: Commit number of the base row.
BASE_SEQ = -(1 << 62)
VALUE, ARRAY, ELEMENT = "value", "array", "element"
_SCOPE = ["doc_id", "field", "scope"]
_PLACE = ["doc_id", "version", "field"]


def _json() -> Column:
    return F.try_parse_json("json")


def scoped_log(log: DataFrame, base: DataFrame, chunk_width: int = DEFAULT_CHUNK) -> DataFrame:
    """Log and base as rows with ``json`` (the payload, NULL where the operation
    cannot be read), ``id`` and ``scope``; ``rep`` is the last replace up to a row."""
    start = base.select("doc_id", F.lit(BASE_SEQ).cast("bigint").alias("seq"), "version", F.lit(REPLACE).alias("op"),
                        F.lit(None).cast("string").alias("field"), F.col("doc").alias("payload"))
    rows = start.unionByName(log.select(*start.columns))
    rows = parse_json_strict(rows, "payload", "_value")
    value, op = F.col("_value"), F.col("op")
    ident = F.when(as_object(value).isNotNull(), F.try_variant_get(value, "$.id", "string"))
    reads = F.when(op == REPLACE, as_object(value).isNotNull()) \
             .when(op == SET, F.col("field").isNotNull() & value.isNotNull()) \
             .when(op.isin(APPEND, PATCH), F.col("field").isNotNull() & ident.isNotNull())
    rows = rows.select("doc_id", "seq", "version", "op", F.when(op != REPLACE, F.col("field")).alias("field"), ident.alias("id"),
                       F.when(reads, F.to_json("_value")).alias("json"))
    resets = F.col("json").isNotNull()
    rows = ordered_last(rows.withColumn("_r", resets & (F.col("op") == REPLACE)), "doc_id", "seq", ["seq"], "_r", "_rep_", chunk_width)
    rows = ordered_last(rows.withColumn("_s", resets & (F.col("op") == SET)), ["doc_id", "field"], "seq", ["seq"], "_s", "_set_", chunk_width)
    rep = F.coalesce("_rep_seq", F.lit(BASE_SEQ).cast("bigint"))
    return cut_lineage(rows.select("doc_id", "seq", "version", "op", "field", "id", "json", rep.alias("rep"),
                                   F.greatest(rep, "_set_seq").alias("scope")), "operations")


def _births(rows: DataFrame) -> DataFrame:
    """Values, arrays and elements with the commit that brought them (``seq``) and
    their place in it (``pos``)."""
    sent = rows.where("json IS NOT NULL").withColumn("_value", _json())
    whole = sent.where(F.col("op") == REPLACE).select("doc_id", F.explode(as_object(F.col("_value"))).alias("field", "_v"), "seq")
    whole = whole.unionByName(sent.where(F.col("op") == SET).select("doc_id", "field", F.col("_value").alias("_v"), "seq"))
    whole = whole.withColumn("_items", as_array(F.col("_v"))).withColumn("scope", F.col("seq"))
    none = F.lit(None).cast("string")
    kind = F.when(F.col("_items").isNull(), VALUE).otherwise(ARRAY)
    tops = whole.select(*_SCOPE, "seq", F.lit(-1).cast("bigint").alias("pos"), kind.alias("kind"), none.alias("id"),
                        F.to_json("_v").alias("json"))
    items = whole.select(*_SCOPE, "seq", F.posexplode("_items").alias("pos", "_e"))
    ident = F.when(as_object(F.col("_e")).isNotNull(), F.try_variant_get("_e", "$.id", "string"))
    items = items.select(*_SCOPE, "seq", F.col("pos").cast("bigint").alias("pos"), F.lit(ELEMENT).alias("kind"), ident.alias("id"),
                         F.to_json("_e").alias("json"))
    # the first append of an id, where the scope's value is no bare value and did not bring it
    taken = tops.where(F.col("kind") == VALUE).select(*_SCOPE)
    there = items.where("id IS NOT NULL").select(*_SCOPE, "id").distinct()
    appends = rows.where("json IS NOT NULL").where(F.col("op") == APPEND).groupBy(*_SCOPE, "id").agg(
        F.min_by(F.struct("seq", "json"), "seq").alias("_f"))
    appends = appends.join(there, [*_SCOPE, "id"], "left_anti").join(taken, _SCOPE, "left_anti").select(
        *_SCOPE, F.col("_f.seq").alias("seq"), F.lit(0).cast("bigint").alias("pos"), F.lit(ELEMENT).alias("kind"), "id",
        F.col("_f.json").alias("json"))
    return cut_lineage(tops.unionByName(items).unionByName(appends), "operation-rows")


def _alive(df: DataFrame, targets: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``df`` that belong to the wanted versions: up to the version's
    commit and in the scope that the field has then."""
    j = df.join(targets, "doc_id").where("seq <= upto AND scope >= rep")
    j = j.join(sets, _PLACE, "left").where("scope = coalesce(set_at, rep)")
    return j.drop("upto", "rep", "set_at")


def _text(fields: Column) -> Column:
    """JSON text of a map of JSON texts, keys in order."""
    def one(e):
        key = F.to_json(F.array(e["key"]))
        return F.concat(F.substring(key, F.lit(2), F.length(key) - 2), F.lit(":"), e["value"])
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(fields)), one), ","), F.lit("}"))


def _targets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    ask = wanted.select("doc_id", "version").where("version IS NOT NULL").distinct()
    return rows.select("doc_id", "version", F.col("seq").alias("upto"), "rep").join(ask, ["doc_id", "version"], "left_semi")


def elements_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted versions (doc_id, version) in flat form, from ``scoped_log``: one
    row per value (kind 'value'), array (kind 'array': that it is there) and
    element (kind 'element'), with ``born``, ``pos`` (their order), ``id`` and
    ``json``. Versions that the log does not reach have no rows."""
    targets = cut_lineage(_targets(rows, wanted), "operation-targets")
    sets = rows.where((F.col("op") == SET) & F.col("json").isNotNull()).select("doc_id", "field", "seq") \
        .join(targets, "doc_id").where("seq <= upto AND seq > rep").groupBy(*_PLACE).agg(F.max("seq").alias("set_at"))
    births = _births(rows)
    born = births.where("kind = 'element' AND id IS NOT NULL").groupBy(*_SCOPE, "id").agg(F.min("seq").alias("_born"))
    cells = rows.where("json IS NOT NULL").where(F.col("op") == PATCH).select(*_SCOPE, "id", "seq", F.explode(as_object(_json())).alias("key", "_v"))
    cells = cells.where("key <> 'id'").withColumn("_v", F.to_json("_v")).join(born, [*_SCOPE, "id"]).where("seq > _born").drop("_born")
    latest = _alive(cells, targets, sets).groupBy(*_PLACE, "id", "key").agg(F.max_by("_v", "seq").alias("_v"))
    patches = latest.groupBy(*_PLACE, "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "_v"))).alias("_patch"))
    out = _alive(births, targets, sets).join(patches, [*_PLACE, "id"], "left")
    fields = F.transform_values(as_object(_json()), lambda _, v: F.to_json(v))
    new = F.when((F.col("kind") == ELEMENT) & fields.isNotNull(),
                 _text(F.when(F.col("_patch").isNull(), fields).otherwise(merged(fields, F.col("_patch"))))).otherwise(F.col("json"))
    return out.select(*_PLACE, "kind", F.col("seq").alias("born"), "pos", "id", new.alias("json"))


def documents_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted versions as whole documents: doc_id, version, doc (JSON text,
    fields in order). The nested form: one row holds one document."""
    flat = elements_at(rows, wanted)
    items = F.array_sort(F.collect_list(F.when(F.col("kind") == ELEMENT, F.struct("born", "pos", "json"))))
    parts = flat.groupBy(*_PLACE).agg(items.alias("_items"), F.max(F.when(F.col("kind") == VALUE, F.col("json"))).alias("_value"))
    array = F.concat(F.lit("["), F.array_join(F.transform("_items", lambda e: e["json"]), ","), F.lit("]"))
    parts = parts.withColumn("_value", F.coalesce("_value", array))
    docs = parts.groupBy("doc_id", "version").agg(_text(F.map_from_entries(F.collect_list(F.struct("field", "_value")))).alias("doc"))
    return _targets(rows, wanted).select("doc_id", "version").join(docs, ["doc_id", "version"], "left") \
        .withColumn("doc", F.coalesce("doc", F.lit("{}")))
