"""Shapes of nested JSON, each compiled into one expression over a VARIANT that names the first fault.

A fault is struct(path, reason): the path of the first value that does not fit, in the order of the declared fields, such as
messages[2].role, and why.  A value that fits gives null.  Everything stays in the JVM, whatever the nesting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank

FAULT = "struct<path:string,reason:string>"


def fault(path: Column, reason: str) -> Column:
    return F.struct(path.alias("path"), F.lit(reason).alias("reason")).cast(FAULT)


def _none() -> Column:
    return F.lit(None).cast(FAULT)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def members(value: Column) -> Column:
    """The fields of an object by name; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def string_of(value: Column) -> Column:
    """The text of a JSON string; null for anything else."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


@dataclass(frozen=True)
class Text:
    """A string; blank, null, a pattern, a choice and a length in UTF-8 bytes as asked for."""

    blank: bool = True
    nullable: bool = False
    pattern: str | None = None
    choices: tuple[str, ...] = ()
    most_bytes: int | None = None
    least: int = 0
    #: (reason, predicate over the string) that must hold, in order
    rules: tuple[tuple[str, Callable[[Column], Column]], ...] = ()

    def fault(self, value: Column, path: Column) -> Column:
        def checked(text: Column) -> Column:
            out = F.when(text.isNull(), fault(path, "not_a_string_or_null" if self.nullable else "not_a_string"))
            if self.choices:
                out = out.when(~text.isin(*self.choices), fault(path, "unsupported_value"))
            if not self.blank:
                out = out.when(is_blank(text), fault(path, "blank"))
            if self.least:
                out = out.when(F.char_length(text) < self.least, fault(path, "empty"))
            if self.pattern:
                out = out.when(~text.rlike(f"\\A(?:{self.pattern})\\z"), fault(path, "pattern"))
            if self.most_bytes is not None:
                out = out.when(F.octet_length(text) > self.most_bytes, fault(path, "too_long"))
            for reason, holds in self.rules:
                out = out.when(~holds(text), fault(path, reason))
            return out

        out = let(string_of(value), checked)
        return F.when(kind(value) == "VOID", _none()).otherwise(out) if self.nullable else out


@dataclass(frozen=True)
class Integer:
    """A whole number written as one, within bounds."""

    low: int | None = None
    high: int | None = None
    reason: str = "out_of_range"

    def fault(self, value: Column, path: Column) -> Column:
        number = F.try_variant_get(value, "$", "long")
        out = F.when(F.coalesce(kind(value), F.lit("")) != "BIGINT", fault(path, "not_an_integer"))
        if self.low is not None:
            out = out.when(number < self.low, fault(path, self.reason))
        if self.high is not None:
            out = out.when(number > self.high, fault(path, self.reason))
        return out


@dataclass(frozen=True)
class Boolean:
    def fault(self, value: Column, path: Column) -> Column:
        return F.when(F.coalesce(kind(value), F.lit("")) != "BOOLEAN", fault(path, "not_a_boolean"))


@dataclass(frozen=True)
class Items:
    """A sequence whose elements fit a shape; with `key`, a field (or place) whose strings must differ, and be in order if asked."""

    of: object
    least: int = 0
    most: int | None = None
    key: str | None = None
    ordered: bool = False

    def fault(self, value: Column, path: Column) -> Column:
        def place(i: Column) -> Column:
            return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))

        def checked(items: Column) -> Column:
            found = F.filter(F.transform(items, lambda x, i: self.of.fault(x, place(i))), lambda f: f.isNotNull())
            out = F.when(items.isNull(), fault(path, "not_a_sequence"))
            if self.least:
                out = out.when(F.size(items) < self.least, fault(path, "too_few"))
            if self.most is not None:
                out = out.when(F.size(items) > self.most, fault(path, "too_many"))
            out = out.when(F.size(found) > 0, F.get(found, F.lit(0)))
            if self.key:
                keys = F.transform(items, lambda x: F.try_variant_get(x, self.key, "string"))
                out = out.when(F.size(F.array_distinct(keys)) < F.size(items), fault(path, "repeated"))
                if self.ordered:
                    out = out.when(F.array_sort(keys) != keys, fault(path, "not_in_order"))
            return out

        return let(elements(value), checked)


@dataclass(frozen=True)
class Object:
    """An object that has all required fields and no others but the optional ones, each of its shape."""

    required: dict[str, object] = field(default_factory=dict)
    optional: dict[str, object] = field(default_factory=dict)
    #: all names in the order in which they are looked at; else the required ones come first
    order: tuple[str, ...] = ()

    def fault(self, value: Column, path: Column) -> Column:
        shapes = self.required | self.optional
        names = lambda keys: F.array(*[F.lit(k) for k in keys]).cast("array<string>")
        below = lambda name: F.concat(path, F.when(path == "", "").otherwise("."), name)

        def checked(fields: Column) -> Column:
            extra = F.array_sort(F.array_except(F.map_keys(fields), names(shapes)))
            absent = F.array_except(names(sorted(self.required)), F.map_keys(fields))
            out = F.when(fields.isNull(), fault(path, "not_an_object")).when(F.size(extra) > 0, fault(below(F.get(extra, F.lit(0))), "unknown_key"))
            out = out.when(F.size(absent) > 0, fault(below(F.get(absent, F.lit(0))), "missing_key"))
            found = []
            for name in self.order or shapes:
                at = F.try_element_at(fields, F.lit(name))
                inner = shapes[name].fault(at, below(F.lit(name)))
                found.append(F.when(at.isNotNull(), inner) if name in self.optional else inner)
            return out.otherwise(F.coalesce(*found, _none()))

        return let(members(value), checked)


@dataclass(frozen=True)
class Pair:
    """A sequence of exactly two strings that are not blank."""

    def fault(self, value: Column, path: Column) -> Column:
        def checked(items: Column) -> Column:
            texts = F.transform(items, string_of)
            out = F.when(items.isNull() | (F.size(items) != 2) | F.exists(texts, lambda t: t.isNull()), fault(path, "not_two_strings"))
            return out.when(F.exists(texts, is_blank), fault(path, "blank"))

        return let(elements(value), checked)


@dataclass(frozen=True)
class Nullable:
    of: object

    def fault(self, value: Column, path: Column) -> Column:
        return F.when(kind(value) == "VOID", _none()).otherwise(self.of.fault(value, path))


def first_fault(text: Column, shape: object) -> Column:
    """struct(path, reason) of a JSON text: bad_json, the shape's first fault, or null.

    A repeated key is bad JSON.
    """
    root = F.lit("")
    return let(F.try_parse_json(text), lambda v: F.when(v.isNull(), fault(root, "bad_json")).otherwise(shape.fault(v, root)))
