"""Nested columns cut to an allowed shape, without row-wise code: the schema is walked once, at planning time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .nested import PRIVATE

#: Allowed fields: a name, or a name with what is allowed below it. None allows all that is not private.
Shape = dict[str, "Shape | None"] | None


def shaped(c: Column, kind: DataType, allowed: Shape = None, private: tuple[str, ...] = PRIVATE, filled: bool = False) -> Column | None:
    """c with the allowed fields only, at any depth of structs, arrays and maps; None where nothing of it is left.

    Private names go wherever they stand, also when they are allowed, and as keys of maps; names compare without case. Fields that are allowed and not there are no
    error. With filled, blank texts and empty arrays and maps become null (so JSON leaves them out) and so do structs all of whose fields are. Null stays null.
    """
    low = {p.lower() for p in private}
    inner = lambda x, k, a: shaped(x, k, a, private, filled)
    if isinstance(kind, StructType):
        parts = []
        for f in kind.fields:
            if f.name.lower() in low or (allowed is not None and f.name not in allowed):
                continue
            part = inner(c.getField(f.name), f.dataType, None if allowed is None else allowed[f.name])
            if part is not None:
                parts.append((f.name, part))
        if not parts:
            return None
        there = c.isNotNull()
        if filled:
            some = F.lit(False)
            for _, part in parts:
                some = some | part.isNotNull()
            there = there & some
        return F.when(there, F.struct(*[part.alias(name) for name, part in parts]))
    if isinstance(kind, ArrayType):
        if inner(F.lit(None).cast(kind.elementType), kind.elementType, allowed) is None:
            return None
        out = F.transform(c, lambda x: inner(x, kind.elementType, allowed))
        if filled:
            out = F.filter(out, lambda x: x.isNotNull())
            return F.when(F.size(out) > 0, out)
        return out
    if isinstance(kind, MapType):
        if inner(F.lit(None).cast(kind.valueType), kind.valueType, allowed) is None:
            return None
        out = F.map_filter(c, lambda k, _: ~F.lower(k.cast("string")).isin(*low)) if isinstance(kind.keyType, StringType) else c
        out = F.transform_values(out, lambda _, v: inner(v, kind.valueType, allowed))
        if filled:
            out = F.map_filter(out, lambda _, v: v.isNotNull())
            return F.when(F.size(out) > 0, out)
        return out
    if filled and isinstance(kind, StringType):
        return F.when(F.trim(c) != "", c)
    return c


def public_context(df: DataFrame, columns: list[str], private: tuple[str, ...] = PRIVATE) -> Column:
    """The context a model may see, as JSON of the columns: without private fields at any depth, nulls, blanks and empty lists; `{}` if nothing is left."""
    low = {p.lower() for p in private}
    parts = [(c, shaped(F.col(c), df.schema[c].dataType, None, private, True)) for c in columns if c.lower() not in low]
    kept = [part.alias(c) for c, part in parts if part is not None]
    return F.coalesce(F.to_json(F.struct(*kept)), F.lit("{}")) if kept else F.lit("{}")
