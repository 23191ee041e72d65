"""The canonical record and result schemas."""

from __future__ import annotations

from .functions.shapes import Boolean, Integer, Items, Nullable, Object, Pair, Text

MESSAGES = "array<struct<role:string,content:string>>"
PROVENANCE = (
    "struct<source_id:string,revision:string,license:struct<name:string,url:string,attribution:string>,"
    "split:string,record_id:string,url:string,source_metadata:map<string,string>>"
)
VALIDATION = "struct<results:array<struct<validator_id:string,passed:boolean,detail:string>>>"
RECORD = f"schema_version int, messages {MESSAGES}, language string, provenance {PROVENANCE}, validation {VALIDATION}"
#: Position in the input decides which copy is first; Spark rows have none, so it is a column.
INDEXED_RECORD = f"input_index long, {RECORD}"
#: The same as a record line has it: source_metadata is a sequence of pairs there.
LINE = RECORD.replace("source_metadata:map<string,string>", "source_metadata:array<array<string>>")
_NAME, _NOTE = Text(blank=False), Text(blank=False, nullable=True)
#: What a record line must be, fields in the order in which they are looked at.
RECORD_SHAPE = Object(
    required={
        "schema_version": Integer(1, 1, reason="schema_version"),
        "messages": Items(Object({"role": Text(choices=("system", "user", "assistant")), "content": Text()})),
        "language": Text(pattern="[a-z][a-z0-9_-]*"),
        "provenance": Object(
            required={"source_id": _NAME, "revision": _NAME, "license": Object({"name": _NAME}, {"url": _NOTE, "attribution": _NOTE})},
            optional={"split": _NOTE, "record_id": _NOTE, "url": _NOTE, "source_metadata": Items(Pair(), key="$[0]", ordered=True)},
        ),
    },
    optional={"validation": Nullable(Object({"results": Items(Object({"validator_id": Text(pattern="[a-z][a-z0-9_.-]*"), "passed": Boolean()}, {"detail": _NOTE}), least=1, key="$.validator_id")}))},
)
RESULT = (
    "problem_id string, language string, generated_text string, generated_code string, parse_status string, compile_status string, "
    "tests struct<passed:int,total:int>, error_category string, error_message string, "
    "generation struct<prompt_tokens:int,generated_tokens:int,latency_seconds:double,tokens_per_second:double>"
)
