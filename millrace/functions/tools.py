"""Tool calls of a policy model against a typed profile, compiled to column expressions.

A call is {"tool", "arguments"}.  A profile names its tools, each an object shape with types, bounds and optional arguments, whose
defaults the parsed call gets; the first fault is named by its path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import FAULT, Integer, Object, Text, fault, let, members, string_of
from .text import is_blank, json_object, json_string

# First parts of paths that no tool may touch.
RESERVED = (".pvrl", "grader", "reference")


def _relative(text: Column) -> Column:
    """Parts parted by single slashes, none of them . or .. and none empty."""
    return text.rlike(r"\A(?!\.{1,2}(?:/|\z))[^/]+(?:/(?!\.{1,2}(?:/|\z))[^/]+)*\z")


#: A normalised relative POSIX path, or a pattern of such.
PATH = Text(
    rules=(
        ("not_posix_text", lambda t: ~is_blank(t) & ~t.contains("\x00") & ~t.contains("\\")),
        ("not_normalized", _relative),
        ("reserved", lambda t: ~F.substring_index(t, "/", 1).isin(*RESERVED)),
    )
)


@dataclass(frozen=True)
class Limits:
    read_default_lines: int = 200
    read_lines: int = 2_000
    write_bytes: int = 1_048_576
    replacements: int = 100


@dataclass(frozen=True)
class Tool:
    arguments: Object
    #: values of optional arguments that a call leaves out
    defaults: dict[str, int] = field(default_factory=dict)


def standard_tools(limits: Limits = Limits()) -> dict[str, Tool]:
    """read, write, edit, glob and bash; arguments are looked at in the order given."""
    return {
        "read": Tool(
            Object({"path": PATH}, {"start_line": Integer(1), "max_lines": Integer(1, limits.read_lines)}, order=("start_line", "max_lines", "path")),
            {"start_line": 1, "max_lines": limits.read_default_lines},
        ),
        "write": Tool(Object({"content": Text(most_bytes=limits.write_bytes), "path": PATH})),
        "edit": Tool(
            Object({"old_text": Text(least=1), "path": PATH, "new_text": Text()}, {"expected_replacements": Integer(1, limits.replacements)}, order=("old_text", "expected_replacements", "path", "new_text")),
            {"expected_replacements": 1},
        ),
        "glob": Tool(Object({"pattern": PATH})),
        "bash": Tool(Object({"command": Text(blank=False, rules=(("nul", lambda t: ~t.contains("\x00")),))})),
    }


#: Tools that each profile enables.
PROFILES = {"self_contained_v0": ("read", "write", "bash"), "repository": ("read", "write", "edit", "glob", "bash")}


def parse_typed_call(text: Column, profile: str = "repository", tools: dict[str, Tool] | None = None, enabled: tuple[str, ...] | None = None) -> Column:
    """struct(tool, call, path, reason) of one call; call is its canonical JSON with defaults filled in, null with a fault.

    Faults: bad_json, those of shapes, unknown_tool, and disabled_tool for one that the profile does not enable.
    """
    tools = standard_tools() if tools is None else tools
    enabled = PROFILES[profile] if enabled is None else enabled
    none = F.lit(None).cast("string")

    def result(name: Column, call: Column, found: Column) -> Column:
        return F.struct(name.alias("tool"), F.when(found.isNull(), call).alias("call"), found["path"].alias("path"), found["reason"].alias("reason"))

    def canonical(name: str, tool: Tool, given: Column) -> Column:
        parts = {}
        for key, shape in (tool.arguments.required | tool.arguments.optional).items():
            value = F.try_element_at(given, F.lit(key))
            if isinstance(shape, Integer):
                number = F.try_variant_get(value, "$", "long")
                parts[key] = F.coalesce(number, F.lit(tool.defaults.get(key))).cast("string")
            else:
                parts[key] = json_string(string_of(value))
        return json_object(tool=F.lit(f'"{name}"'), arguments=json_object(**parts))

    def walked(fields: Column) -> Column:
        whole = Object({"tool": Text(), "arguments": _Anything()})
        # keys and the tool's type first, then the tool, then its arguments
        outer = F.when(fields.isNull(), fault(F.lit(""), "not_an_object")).otherwise(whole.fault(F.to_variant_object(fields), F.lit("")))
        name = string_of(F.try_element_at(fields, F.lit("tool")))
        given = F.try_element_at(fields, F.lit("arguments"))
        inner, call = F.when(~name.isin(*tools), fault(F.lit("tool"), "unknown_tool")).when(~name.isin(*enabled), fault(F.lit("tool"), "disabled_tool")), none
        for key, tool in tools.items():
            inner = inner.when(name == key, tool.arguments.fault(given, F.lit("arguments")))
            call = F.when(name == key, canonical(key, tool, members(given))).otherwise(call)
        return result(name, call, F.coalesce(outer, inner, F.lit(None).cast(FAULT)))

    return let(F.try_parse_json(text), lambda v: F.when(v.isNull(), result(none, none, fault(F.lit(""), "bad_json"))).otherwise(let(members(v), walked)))


@dataclass(frozen=True)
class _Anything:
    def fault(self, value: Column, path: Column) -> Column:
        return F.lit(None).cast(FAULT)
