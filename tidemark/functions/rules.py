"""Quality rules as columns: named predicates, a registry of them, and those that a JSON schema implies."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import blank, finite


class Rule(NamedTuple):
    """passes is never null."""

    name: str
    passes: Column


def not_null(column: str) -> Rule:
    return Rule(f"not_null({column})", ~blank(F.col(column)))


def in_range(column: str, low: float | None = None, high: float | None = None, closed: bool = True) -> Rule:
    """Null and NaN fail; without closed the limits themselves fail."""
    c = F.col(column).cast("double")
    ok = finite(c)
    if low is not None:
        ok &= (c >= low) if closed else (c > low)
    if high is not None:
        ok &= (c <= high) if closed else (c < high)
    return Rule(f"in_range({column})", F.coalesce(ok, F.lit(False)))


def positive(column: str) -> Rule:
    return Rule(f"positive({column})", in_range(column, 0, closed=False).passes)


def custom(name: str, condition: Column) -> Rule:
    """A null condition fails."""
    return Rule(name, F.coalesce(condition, F.lit(False)))


class Registry:
    """Rules by dataset."""

    def __init__(self) -> None:
        self._rules: dict[str, list[Rule]] = {}

    def register(self, dataset: str, *rules: Rule) -> None:
        self._rules.setdefault(dataset, []).extend(rules)

    def of(self, dataset: str) -> list[Rule]:
        return list(self._rules.get(dataset, []))


def failed(rules: list[Rule]) -> Column:
    """The names of the rules that a row breaks, in rule order."""
    return F.array_compact(F.array(*[F.when(~r.passes, F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")


def schema_rules(schema: dict, column: Callable[[str], Column] = F.col) -> list[Rule]:
    """Rules of a JSON schema's top-level properties: required, type, enum, const, minimum, maximum, minLength.

    Columns hold text or typed values; an absent optional value passes.
    """
    rules = []
    for name, spec in schema.get("properties", {}).items():
        c = column(name)
        absent = c.isNull()
        if name in schema.get("required", []):
            rules.append(Rule(f"required({name})", ~absent))
        kinds = spec.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        as_kind = {"number": "double", "integer": "bigint", "boolean": "boolean"}
        wanted = [k for k in kinds if k != "null"]
        if wanted and all(k in as_kind for k in wanted):
            rules.append(Rule(f"type({name})", absent | F.coalesce(*[c.try_cast(as_kind[k]).cast("string") for k in wanted]).isNotNull()))
        if "enum" in spec or "const" in spec:
            allowed = [str(x) for x in spec.get("enum", [spec.get("const")]) if x is not None]
            rules.append(Rule(f"enum({name})", absent | c.cast("string").isin(*allowed)))
        if "minimum" in spec or "maximum" in spec:
            number = c.try_cast("double")
            inside = finite(number) & (number >= spec.get("minimum", float("-inf"))) & (number <= spec.get("maximum", float("inf")))
            rules.append(Rule(f"limits({name})", absent | F.coalesce(inside, F.lit(False))))
        if "minLength" in spec:
            rules.append(Rule(f"length({name})", absent | (F.length(F.trim(c)) >= spec["minLength"])))
    return rules


def schema_faults(schema: dict, value: Column, kind: T.DataType, path: Column | None = None) -> Column:
    """The rules of a JSON schema that a value breaks, as texts that name its place (`type(items[2].price)`), in the schema's order.

    value is a struct, an array, text or a number, of type kind. Objects, arrays and their
    items are followed as deep as the schema goes: required, type, enum, const, minimum,
    maximum, minLength, minItems. A null counts as absent: only required minds it; in an array
    it breaks the items' type unless that allows null.
    """
    path = F.lit("") if path is None else path
    none = F.array().cast("array<string>")
    at = lambda name: F.concat(F.lit(f"{name}("), path, F.lit(")"))
    kinds = spec_kinds(schema)
    parts: list[Column] = []
    if isinstance(kind, T.StructType):
        if kinds and "object" not in kinds:
            parts.append(F.array(at("type")))
        required, known = schema.get("required", []), {f.name: f.dataType for f in kind}
        for name in [*schema.get("properties", {}), *[r for r in required if r not in schema.get("properties", {})]]:
            inner = F.concat(path, F.when(path == "", F.lit(name)).otherwise(F.lit(f".{name}")))
            here = F.array(F.concat(F.lit("required("), inner, F.lit(")")))
            if name not in known:
                if name in required:
                    parts.append(here)
                continue
            child, spec = value[name], schema.get("properties", {}).get(name, {})
            if name in required:
                parts.append(F.when(child.isNull(), here).otherwise(none))
            parts.append(F.when(child.isNotNull(), schema_faults(spec, child, known[name], inner)).otherwise(none))
    elif isinstance(kind, T.ArrayType):
        if kinds and "array" not in kinds:
            parts.append(F.array(at("type")))
        if "minItems" in schema:
            parts.append(F.when(F.size(value) < schema["minItems"], F.array(at("length"))).otherwise(none))
        spec = schema.get("items", {})
        empty = none if not spec_kinds(spec) or "null" in spec_kinds(spec) else None

        def item(x: Column, i: Column) -> Column:
            place = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            lacking = empty if empty is not None else F.array(F.concat(F.lit("type("), place, F.lit(")")))
            return F.when(x.isNull(), lacking).otherwise(schema_faults(spec, x, kind.elementType, place))

        parts.append(F.flatten(F.transform(value, item)))
    else:
        own = [Rule(r.name.split("(")[0], r.passes) for r in schema_rules({"properties": {"": schema}}, lambda _: value)]
        if {"object", "array"} >= set(kinds) and kinds:
            own = [Rule("type", F.lit(False))]
        parts += [F.when(~r.passes, F.array(at(r.name))).otherwise(none) for r in own]
    return F.concat(*parts) if parts else none


def spec_kinds(spec: dict) -> list[str]:
    kinds = spec.get("type", [])
    return [kinds] if isinstance(kinds, str) else list(kinds)
