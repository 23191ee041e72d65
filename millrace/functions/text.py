"""Text, JSON and array expressions over Columns.

All of them stay in the JVM.  Where a row can be malformed they give an error column, never an exception: what must
not occur is asked for by a violation query (see operators.checks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string>"
#: White space as Python's str.strip() sees it, for Java regexes.
SPACE = r"[\s\x1c-\x1f]"
#: A word or a single mark; the same class on every engine.
OVERLAP_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def normalize_text(text: Column) -> Column:
    """Without one leading byte-order mark, and with line feeds for CRLF and CR."""
    return F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "\r\n?", "\n")


def is_blank(text: Column) -> Column:
    return text.rlike(f"(?U)^{SPACE}*$")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize_messages(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), normalize_text(m["content"]).alias("content")))


def single_turn(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """Messages of one exchange; a null system message is left out."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [message("user", user), message("assistant", assistant)]
    if system is None:
        return F.array(*turns)
    return F.array_compact(F.array(F.when(system.isNotNull(), message("system", system)), *turns))


# --- canonical JSON --------------------------------------------------------------------------------------


def json_string(text: Column) -> Column:
    """JSON string as canonical JSON writes it: non-ASCII kept, control characters in lower-case hex."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for code in (c for c in range(0x20) if chr(c) not in "\n\r\t\f\b"):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def json_object(**fields: Column) -> Column:
    """Compact object of ready JSON values, keys in order."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def json_array(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hash_list_sha256(hashes: Column) -> Column:
    """Digest of a list of hex digests."""
    return sha256(F.concat(F.lit('["'), F.array_join(hashes, '","'), F.lit('"]')))


def prompt_sha256(messages: Column) -> Column:
    """Of a prompt history, normalised."""
    each = F.transform(messages, lambda m: json_object(role=json_string(m["role"]), content=json_string(normalize_text(m["content"]))))
    return sha256(json_object(schema_version=F.lit("1"), messages=json_array(each)))


def response_sha256(content: Column) -> Column:
    return sha256(json_object(schema_version=F.lit("1"), role=F.lit('"assistant"'), content=json_string(normalize_text(content))))


def record_sha256(prompt: Column, response: Column) -> Column:
    quoted = lambda h: F.concat(F.lit('"'), h, F.lit('"'))
    return sha256(json_object(schema_version=F.lit("1"), prompt_sha256=quoted(prompt), response_sha256=quoted(response)))


def with_fingerprints(records: DataFrame) -> DataFrame:
    """records with prompt_sha256, response_sha256 and record_sha256; the prompt is all messages but the last."""
    last = F.element_at("messages", -1)["content"]
    out = records.withColumns(
        {"prompt_sha256": prompt_sha256(F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))), "response_sha256": response_sha256(last)}
    )
    return out.withColumn("record_sha256", record_sha256(F.col("prompt_sha256"), F.col("response_sha256")))


# --- overlap ---------------------------------------------------------------------------------------------


def overlap_tokens(text: Column) -> Column:
    """Of the normalised text: line ends are no tokens, so that only the byte-order mark is taken off."""
    marked = F.startswith(text, F.lit("\ufeff"))
    return F.regexp_extract_all(F.when(marked, F.substring(text, F.lit(2), F.lit((1 << 31) - 1))).otherwise(text), F.lit(OVERLAP_TOKEN), 0)


def prompt_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), normalize_text(m["content"]))), "\n")


def with_shingles(df: DataFrame, text: Column, name: str, size: int = 5, least: int = 16) -> DataFrame:
    """df with the array `name` of the distinct shingle hashes of text; empty under `least` tokens.

    Tokens and their hashes pass through explode(), so that they are made once a row, not once for each shingle.
    """
    tokens = F.explode(F.array(F.coalesce(overlap_tokens(text), F.array().cast("array<string>"))))
    run = ", ".join(f"element_at(_hashes, i + {k})" for k in range(size))
    shingles = F.expr(f"array_distinct(transform(sequence(1, size(_hashes) - {size - 1}), i -> xxhash64({run})))")
    out = df.withColumn("_tokens", tokens).withColumn("_hashes", F.explode(F.array(F.transform("_tokens", lambda w: F.xxhash64(w))))).drop("_tokens")
    return out.withColumn(name, F.when(F.size("_hashes") >= max(least, size), shingles).otherwise(F.array().cast("array<bigint>"))).drop("_hashes")


def overlap_score(left: Column, right: Column) -> Column:
    """Shared shingles over those of the smaller set; 0 if either is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least > 0, F.size(F.array_intersect(left, right)) / least).otherwise(0.0)


# --- reasoning markup ------------------------------------------------------------------------------------

OPEN, CLOSE = "<think>", "</think>"


def marked_parts(text: Column) -> Column:
    """struct(reasoning, answer) of a text that begins with the opening marker: what is before and after the first closing one, as it stands."""
    inside = F.substring(F.substring_index(text, CLOSE, 1), F.lit(len(OPEN) + 1), F.lit((1 << 31) - 1))
    after = F.substring(text, F.instr(text, CLOSE) + len(CLOSE), F.lit((1 << 31) - 1))
    return F.struct(inside.alias("reasoning"), after.alias("answer"))


def split_reasoning(text: Column) -> Column:
    """struct(reasoning, answer, error) of a completion whose reasoning is marked, or only closed."""
    bare = strip(text)
    opened, closed = F.instr(bare, OPEN), F.instr(bare, CLOSE)
    full = F.when((closed > 0) & (opened != 1), F.concat(F.lit(OPEN), bare)).otherwise(bare)
    reasoning, answer = strip(marked_parts(full)["reasoning"]), strip(marked_parts(full)["answer"])
    error = (
        F.when((opened > 1) & (closed > 0), "opening marker is not leading")
        .when((opened > 1) & (closed == 0), "opening marker without a closing one")
        .when((opened == 1) & (closed == 0), "opened without closing")
        .when((closed > 0) & (answer == ""), "no answer after the reasoning")
        .when((closed > 0) & (answer.contains(OPEN) | answer.contains(CLOSE)), "answer holds markup")
    )
    return F.struct(
        F.when(error.isNull() & (closed > 0) & (reasoning != ""), reasoning).alias("reasoning"),
        F.when(error.isNull(), F.when(closed > 0, answer).otherwise(bare)).alias("answer"),
        error.alias("error"),
    )


def has_markup(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["content"].contains(OPEN) | m["content"].contains(CLOSE))


def markup_count(messages: Column) -> Column:
    """How many reasoning markers, opening and closing, all messages hold together."""
    each = F.transform(messages, lambda m: F.coalesce(F.regexp_count(m["content"], F.lit(f"{OPEN}|{CLOSE}")), F.lit(0)))
    return F.aggregate(each, F.lit(0), lambda a, n: a + n)


# --- completions -----------------------------------------------------------------------------------------


def first_fence(text: Column) -> Column:
    """Code of the first fenced block, unlabelled or labelled as Python; else the text."""
    code = F.regexp_extract(text, r"(?s)```(?:[pP]ython3?|py)?[ \t]*\n(.*?)```", 1)
    return F.when(text.rlike(r"(?s)```(?:[pP]ython3?|py)?[ \t]*\n.*?```"), code).otherwise(text)


def without_echo(completion: Column, prompt: Column) -> Column:
    return F.when(F.startswith(completion, prompt), F.substring(completion, F.char_length(prompt) + 1, F.lit(1 << 30))).otherwise(completion)


def until_stop(text: Column, stops: list[str]) -> Column:
    """text up to the earliest of the stop words."""
    at = F.array_min(F.filter(F.array(*[F.instr(text, s) for s in stops]), lambda p: p > 0))
    return F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(text)


# --- policies --------------------------------------------------------------------------------------------


def answer_budget(prompt_tokens: Column, most: int = 1792, window: int = 2048, reserve: int = 128) -> Column:
    """Tokens left for an answer; null where none are."""
    left = F.least(F.lit(most), F.lit(window - reserve) - prompt_tokens)
    return F.when(left > 0, left)


def inject_policy(messages: Column, policy: Column, mark: str = "\n\n") -> Column:
    """The policy appended to the system message, or as one before all others."""
    head = messages[0]
    added = F.struct(F.lit("system").alias("role"), F.concat(head["content"], F.lit(mark), policy).alias("content"))
    alone = F.struct(F.lit("system").alias("role"), policy.alias("content"))
    rest = F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when(head["role"] == "system", F.concat(F.array(added), rest)).otherwise(F.concat(F.array(alone), messages))


def strip_policy(messages: Column, policy: Column, mark: str = "\n\n") -> Column:
    """What inject_policy began with; null where the policy is not there as it put it."""
    head = messages[0]
    suffix = F.concat(F.lit(mark), policy)
    rest = F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))
    bare = F.struct(F.lit("system").alias("role"), F.substring(head["content"], F.lit(1), F.char_length(head["content"]) - F.char_length(suffix)).alias("content"))
    system = head["role"] == "system"
    return F.when(system & (head["content"] == policy), rest).when(system & F.endswith(head["content"], suffix), F.concat(F.array(bare), rest))


# --- masks and spans -------------------------------------------------------------------------------------


def true_runs(mask: Column) -> Column:
    """Half-open spans of the longest runs of true."""
    n = F.size(mask)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(index, lambda i: F.get(mask, i) & ~F.coalesce(F.get(mask, i - 1), F.lit(False)))
    ends = F.filter(index, lambda i: F.get(mask, i) & ~F.coalesce(F.get(mask, i + 1), F.lit(False)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def completion_mask(full: Column, prompt: Column) -> Column:
    """False over the prompt and true after it; null where full does not begin with prompt."""
    proven = (F.size(full) >= F.size(prompt)) & (F.slice(full, F.lit(1), F.size(prompt)) == prompt)
    return F.when(proven, F.concat(F.array_repeat(F.lit(False), F.size(prompt)), F.array_repeat(F.lit(True), F.size(full) - F.size(prompt))))


def truncate_utf8(text: Column, most: int, marker: str) -> Column:
    """text, or if it has over `most` bytes the longest prefix of whole characters that fits with the marker."""
    room = most - len(marker.encode())
    octets = F.substring(text.cast("binary"), F.lit(1), F.lit(room + 1))
    # a cut is whole if the byte after it begins a character; at most three bytes are given up
    step = lambda k: F.hex(F.substring(octets, F.lit(room + 1 - k), F.lit(1))).rlike("^[89AB]")
    whole = F.when(~step(0), room).when(~step(1), room - 1).when(~step(2), room - 2).otherwise(room - 3)
    cut = F.concat(F.substring(octets, F.lit(1), whole).cast("string"), F.lit(marker))
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)


# --- metadata and trainer shapes -------------------------------------------------------------------------


def metadata_int(metadata: Column, key: str) -> Column:
    """struct(value, problem) of an integer that the metadata must hold."""
    raw = F.try_element_at(metadata, F.lit(key))
    value = F.when(raw.rlike(r"^-?\d{1,18}$"), raw.try_cast("long"))
    return F.struct(value.alias("value"), F.when(raw.isNull(), f"{key} is missing").when(value.isNull(), f"{key} is no integer").alias("problem"))


def metadata_update(metadata: Column, changes: dict[str, Column]) -> Column:
    """metadata with keys set; a null value takes the key out."""
    flat = [x for k, v in changes.items() for x in (F.lit(k), v.cast("string"))]
    kept = F.map_filter(metadata, lambda k, _: ~k.isin(list(changes)))
    return F.map_filter(F.map_concat(kept, F.create_map(*flat)), lambda _, v: v.isNotNull())


def metadata_sorted(metadata: Column) -> Column:
    return F.array_sort(F.map_entries(metadata))


def prompt_completion(messages: Column) -> Column:
    """struct(prompt, completion): all messages but the last, and the last."""
    history = F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.struct(history.alias("prompt"), F.slice(messages, -1, 1).alias("completion"))
