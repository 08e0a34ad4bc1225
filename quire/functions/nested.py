"""Column expressions over nested documents (one document per row).

They run inside a row, so they never shuffle; the document size bounds the
work. Arrays of structs are addressed by an ``id`` field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quire.functions.text import col


def array_len(c) -> Column:
    """``jsonb_array_length``: NULL for a missing array, 0 for an empty one."""
    return F.when(col(c).isNull(), F.lit(None).cast("bigint")).otherwise(F.size(col(c)).cast("bigint"))


def has_element(arr, pred) -> Column:
    """``exists(select 1 from jsonb_array_elements(arr) e where pred(e))``.
    A missing array counts as 'no element'."""
    return F.coalesce(F.exists(col(arr), pred), F.lit(False))


def has_id(arr, id_value) -> Column:
    return has_element(arr, lambda e: e["id"] == id_value)


def count_where(arr, pred) -> Column:
    """Correlated ``count(*)`` of matching elements; NULL array -> 0."""
    return F.coalesce(F.size(F.filter(col(arr), pred)), F.lit(0)).cast("bigint")


def first_field(arr, field: str) -> Column:
    """``arr->0->>field``: NULL when the array is empty or missing."""
    return F.get(col(arr), 0)[field]


def append_if_absent(arr, new_elements, guard) -> Column:
    """Append ``new_elements`` unless ``guard`` is true. A missing array stays
    missing (the caller quarantines it)."""
    return F.when(guard, col(arr)).otherwise(F.concat(col(arr), col(new_elements)))


def patch_by_id(arr, id_value, patch, element_type) -> Column:
    """M2 on one document: shallow right-wins merge ``e || patch`` on the
    element(s) whose id matches. ``patch`` is a map<string,string> column; a
    key present replaces the field (cast to its type), even with NULL (a JSON
    null overrides); absent keys keep the element's value."""
    fields = [(f.name, f.dataType) for f in element_type.fields if f.name != "id"]

    def value(name, typ):
        # atomic fields take the text cast to their type; nested ones (arrays,
        # objects) take the text as JSON
        if isinstance(typ, (ArrayType, MapType, StructType)):
            return F.from_json(patch[name], typ)
        return patch[name].cast(typ)

    def merge(e):
        out = e
        for name, typ in fields:
            hit = F.coalesce(F.map_contains_key(patch, F.lit(name)), F.lit(False))
            out = out.withField(name, F.when(hit, value(name, typ)).otherwise(e[name]))
        return out
    return F.transform(col(arr), lambda e: F.when(e["id"] == id_value, merge(e)).otherwise(e))
