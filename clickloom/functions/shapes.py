"""JSON checked against a StructType with rules, compiled to VARIANT expressions.

The rules of a field stand in its metadata (``model.ruled``): ``required``, ``null`` (null is allowed), ``enum`` (allowed
texts), ``closed`` (an object may have no other keys), ``fraction`` (an integer that is cut from a number).  Types are those of the interchange format: a string is a string;
an integer may come as a whole number or as text of one, a number as text of it, a boolean as 0, 1 or one of the usual
words, a time as ISO text or as a number.  VARIANT fields hold anything.

``problems`` gives every violation with its path (``events.3.target.url``), in the order of the shape."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

PROBLEMS = "array<struct<path:string,reason:string>>"
WHOLE = r"^\s*[+-]?\d+(\.0*)?\s*$"
#: Texts that mean a boolean.
BOOLEAN_WORDS = ["0", "off", "f", "false", "n", "no", "1", "on", "t", "true", "y", "yes"]


def _none() -> Column:
    return F.array().cast(PROBLEMS)


def _one(path: Column, reason: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason")))


def _unless(ok: Column, path: Column, reason: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(_one(path, reason))


def _number(kind: Column) -> Column:
    return kind.isin("BIGINT", "INT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _value(v: Column, kind: T.DataType, rules: dict, path: Column) -> Column:
    """Problems of a value that is there and not null."""
    if isinstance(kind, T.VariantType):
        return _none()
    if isinstance(kind, T.StructType):
        inside = problems(v, kind, path, closed=rules.get("closed", False))
        return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), _one(path, "not an object")).otherwise(inside)
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(v, "$", "array<variant>")

        def item(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("."), i.cast("string"))
            void = F.schema_of_variant(x) == "VOID"
            return F.when(F.coalesce(void, F.lit(True)), _one(at, "null")).otherwise(_value(x, kind.elementType, rules, at))

        return F.when(items.isNull(), _one(path, "not an array")).otherwise(F.flatten(F.transform(items, item)))
    have, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    if isinstance(kind, T.LongType):
        number = _number(have) if rules.get("fraction") else _number(have) & text.rlike(WHOLE)
        return _unless((have == "BOOLEAN") | number | (have == "STRING") & text.rlike(WHOLE), path, "not an integer")
    if isinstance(kind, T.DoubleType):
        return _unless((have == "BOOLEAN") | _number(have) | (have == "STRING") & text.try_cast("double").isNotNull(), path, "not a number")
    if isinstance(kind, T.BooleanType):
        word = (have == "STRING") & F.lower(text).isin(*BOOLEAN_WORDS)
        return _unless((have == "BOOLEAN") | word | _number(have) & text.try_cast("double").isin(0.0, 1.0), path, "not a boolean")
    if isinstance(kind, T.TimestampType):
        return _unless(_number(have) | (have == "STRING") & F.try_to_timestamp(text).isNotNull(), path, "not a time")
    allowed = rules.get("enum")
    listed = _none() if allowed is None else _unless(text.isin(*allowed), path, "not one of " + ", ".join(allowed))
    return F.when(have == "STRING", listed).otherwise(_one(path, "not a string"))


def problems(v: Column, shape: T.StructType, path: Column | None = None, closed: bool = False) -> Column:
    """The violations of an object (``v``: VARIANT) as an array of (path, reason); empty: none."""
    before = F.lit("") if path is None else F.concat(path, F.lit("."))
    found = []
    for f in shape.fields:
        at = F.concat(before, F.lit(f.name))
        x = F.variant_get(v, f"$.{f.name}", "variant")
        absent = _one(at, "missing") if f.metadata.get("required") else _none()
        void = _none() if f.metadata.get("null") else _one(at, "null")
        found.append(F.when(x.isNull(), absent).when(F.schema_of_variant(x) == "VOID", void).otherwise(_value(x, f.dataType, f.metadata, at)))
    if closed:
        keys = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
        others = F.array_except(keys, F.array(*[F.lit(f.name) for f in shape.fields]))
        found.append(F.coalesce(F.transform(others, lambda k: F.struct(F.concat(before, k).alias("path"), F.lit("unknown key").alias("reason"))), _none()))
    return F.concat(*found)


def told(found: Column) -> Column:
    """Problems as one text: ``path: reason; ...``."""
    return F.array_join(F.transform(found, lambda p: F.concat(p["path"], F.lit(": "), p["reason"])), "; ")
