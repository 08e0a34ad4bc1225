"""Operators on documents whose shape is open (VARIANT): merges and sets keep
keys that no schema knows and the types of JSON values (M2, M3).

Objects are read as maps of VARIANT, arrays as arrays of VARIANT, and put
together again; nothing is a shuffle but the grouping of patches by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,variant>"
_LIST = "array<variant>"


def as_object(v: Column) -> Column:
    """Keys and values of an object; NULL for anything else."""
    return F.try_variant_get(v, "$", _MAP)


def as_array(v: Column) -> Column:
    """Elements of an array; NULL for anything else."""
    return F.try_variant_get(v, "$", _LIST)


def bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, however often ``then`` uses
    it: a lambda's argument is a value, a column named twice is two expressions,
    and one inside another lambda runs for each of its elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def merged(old: Column, patch: Column) -> Column:
    """``old || patch`` of two maps: shallow, the right side wins."""
    return bound(patch, lambda p: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(p, k)), p))


def set_at(v: Column, path: list, value: Column, create: bool = True) -> Column:
    """``jsonb_set(v, path, value, create)``: the value at ``path`` (keys, and
    positions in arrays, negative ones from the end) is replaced. A missing last
    key is added, a position beyond an array's end appends and one before its
    start prepends, if ``create``. Where a parent is missing or of another kind
    nothing changes. A NULL ``value`` (not a JSON null) gives NULL, as the
    studied function does: callers reject such a write."""
    return bound(value, lambda x: F.when(x.isNotNull(), _set_at(v, path, x, create)))


def _set_at(v: Column, path: list, value: Column, create: bool) -> Column:
    """``set_at`` of a value that is not NULL. Each level reads its object or array
    once; ``v`` and ``value`` should be cheap (columns, arguments of lambdas)."""
    if not path:
        return value
    head, rest = path[0], path[1:]

    def in_array(items):
        n = F.size(items)
        at = F.lit(head) if head >= 0 else n + head
        inside = (at >= 0) & (at < n)
        replaced = F.transform(items, lambda x, i: F.when(i == at, _set_at(x, rest, value, create)).otherwise(x))
        new = F.when(inside, replaced)
        if create and not rest:
            new = new.otherwise(F.concat(items, F.array(value)) if head >= 0 else F.concat(F.array(value), items))
        else:
            new = new.otherwise(items)
        return F.when(items.isNull(), v).otherwise(F.to_variant_object(new))

    def in_object(fields):
        have = F.map_contains_key(fields, F.lit(head))
        # a key that holds JSON null is there
        old = F.try_element_at(fields, F.lit(head))
        new = merged(fields, F.create_map(F.lit(head), _set_at(old, rest, value, create)))
        go = have | F.lit(create and not rest)
        return F.when(fields.isNull() | ~go, v).otherwise(F.to_variant_object(new))
    return bound(as_array(v), in_array) if isinstance(head, int) else bound(as_object(v), in_object)


def _at(path: list[str]) -> str:
    return "$" + "".join(f".{p}" for p in path)


def one_patch(patches: DataFrame) -> DataFrame:
    """Patches (doc_id, id, seq, patch: JSON text of an object) as one map of
    VARIANT per element: of several patches later keys win. A patch that is no
    object changes nothing."""
    parsed = F.try_variant_get(F.try_parse_json("patch"), "$", _MAP)
    rows = patches.where(parsed.isNotNull()).groupBy("doc_id", "id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "patch"))).alias("all"))
    empty = F.create_map().cast(_MAP)
    return rows.select("doc_id", "id", F.aggregate("all", empty, lambda acc, x: merged(
        acc, F.try_variant_get(F.try_parse_json(x["patch"]), "$", _MAP))).alias("patch"))


def patch_elements(loaded: DataFrame, path: list[str], patches: DataFrame) -> DataFrame:
    """M2 on loaded documents (doc_id, doc, ...): every element of the array at
    ``path`` whose ``id`` has a patch becomes ``element || patch``. Keys that no
    schema knows stay, a JSON null is a value, a patched ``id`` renames. Documents
    and elements without a patch, and elements that are no objects, stay as they
    are; the order of elements too."""
    by_doc = one_patch(patches).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "patch"))).alias("_patches"))
    j = loaded.join(by_doc, "doc_id", "left")

    def one(e):
        def patched(p):
            return bound(as_object(e), lambda fields: F.when(fields.isNull(), e).otherwise(F.to_variant_object(merged(fields, p))))
        return bound(F.try_element_at("_patches", F.try_variant_get(e, "$.id", "string")),
                     lambda p: F.when(p.isNull(), e).otherwise(patched(p)))

    def in_doc(items):
        new = set_at(F.col("doc"), path, F.to_variant_object(F.transform(items, one)), create=False)
        return F.when(items.isNull(), F.col("doc")).otherwise(new)
    doc = F.when(F.col("_patches").isNull(), F.col("doc")).otherwise(bound(F.try_variant_get("doc", _at(path), _LIST), in_doc))
    return j.withColumn("doc", doc).drop("_patches")


def set_path(loaded: DataFrame, path: list, values: DataFrame, create: bool = True) -> DataFrame:
    """M3 at a path: documents with a row in ``values`` (doc_id, value: VARIANT)
    get it there. A NULL value would make the document NULL, which its column
    forbids: the document stays and ``reason`` is 'null_value'."""
    j = loaded.join(values.select("doc_id", F.col("value").alias("_value"), F.lit(True).alias("_sent")), "doc_id", "left")
    new = set_at(F.col("doc"), path, F.col("_value"), create)
    reason = F.when(F.col("_sent") & F.col("_value").isNull(), F.lit("null_value"))
    return j.withColumn("reason", reason).withColumn("doc", F.coalesce(new, F.col("doc"))).drop("_value", "_sent")
