"""JSON, nested values, content-addressed ids and private fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that public output never carries.
PRIVATE = ("likes", "comments", "shares", "collects", "interactions", "followers", "followers_total", "gmv", "sales", "price", "douyin_handle", "author_name", "publish_date", "publish_time")
# Fixed value: a token that a machine wrote.
MACHINE_VALUE = r"^[A-Za-z0-9][A-Za-z0-9_.:-]*$"


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in order and nulls kept as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(n: int, **fields: Column) -> Column:
    return F.substring(F.sha2(canonical_json(**fields), 256), 1, n)


def content_id(prefix: str, n: int = 12, **fields: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), content_hash(n, **fields))


def lenient_object(c: Column) -> Column:
    """A JSON object found in text: the whole, a fenced block, the first flat braces, the widest braces; null if none."""
    text = F.coalesce(c, F.lit(""))
    tries = [text, F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{"), x) for x in tries])


def strict_reason(c: Column, key: str) -> Column:
    """Why a reply is not the strict object with the key; null if it is."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(text == "", "EMPTY")
        .when(text.startswith("```"), "FENCED")
        .when(~text.startswith("{") | ~text.endswith("}"), "NOT_OBJECT")
        .when(F.try_parse_json(text).isNull(), "NOT_JSON")
        .when(F.get_json_object(text, f"$.{key}").isNull(), "MISSING_KEY")
    )


def leaves(c: Column) -> Column:
    """The strings of a JSON text at any depth, without keys, escapes as they are written; of text that is no JSON, null or without strings none."""
    return strings(F.to_json(F.try_parse_json(F.coalesce(c, F.lit("")))))


def strings(json: Column) -> Column:
    """The same of a text that `to_json` has written, or null."""
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?'), F.lit(0))
    found = F.transform(F.filter(tokens, lambda t: t.endswith('"')), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    return F.coalesce(found, F.array().cast("array<string>"))


def machine_values(c: Column) -> Column:
    """A JSON object or list whose strings, of which it has some, are all machine tokens."""
    nest = F.substring(F.ltrim(F.coalesce(c, F.lit(""))), 1, 1).isin("{", "[")
    return nest & (F.size(leaves(c)) > 0) & F.forall(leaves(c), lambda x: x.rlike(MACHINE_VALUE))


def public(df: DataFrame, private: tuple[str, ...] = PRIVATE) -> DataFrame:
    """Without private columns; names compare without case."""
    low = {p.lower() for p in private}
    return df.select(*[c for c in df.columns if c.lower() not in low])


def assert_public(df: DataFrame, private: tuple[str, ...] = PRIVATE) -> None:
    """Fails at planning time if a private column is left at any depth of the schema."""
    def names(kind, path=""):
        for f in getattr(kind, "fields", []):
            yield f.name, path + f.name
            yield from names(f.dataType, f"{path}{f.name}.")
        for inner in (getattr(kind, "elementType", None), getattr(kind, "valueType", None)):
            if inner is not None:
                yield from names(inner, path)

    low = {p.lower() for p in private}
    found = [p for n, p in names(df.schema) if n.lower() in low]
    if found:
        raise ValueError(f"private fields in public output: {', '.join(found)}")


def has_private_key(json: Column, private: tuple[str, ...] = PRIVATE) -> Column:
    """A private name occurs as a key of JSON text, not as a value."""
    return F.coalesce(json, F.lit("")).rlike(f'"({"|".join(private)})"\\s*:')


def keep(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def first_text(*columns: Column) -> Column:
    """The first that is not null or blank, else empty."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def distinct_texts(c: Column) -> Column:
    """Ordered distinct strings that are not blank; null gives none."""
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))
