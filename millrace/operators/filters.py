"""Content, length and validator filters over records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_messages
from ..registry import TOKEN_COUNTS
from .checks import zero_filled_counts

CONTENT_REASONS = ["invalid_text_encoding", "malformed_record", "empty_prompt", "empty_response"]
#: Marks a record whose raw line holds a lone surrogate, which parsing would hide (see sources.jsonl).
BAD_ENCODING = "bad_encoding"


def well_formed(messages: Column) -> Column:
    """Perhaps a system message, then user and assistant in turn, the assistant last."""
    start = F.when(F.get(messages, F.lit(0))["role"] == "system", 2).otherwise(1)
    body = F.slice(messages, start, F.greatest(F.size(messages), F.lit(1)))
    wrong = F.filter(F.transform(body, lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda w: w)
    return F.coalesce((F.size(body) > 0) & (F.size(body) % 2 == 0) & (F.size(wrong) == 0), F.lit(False))


def content_reasons(messages: Column, bad_encoding: Column | None = None) -> Column:
    """Every reason why a record's content is refused, in order; empty if it is accepted."""
    blank = lambda role: F.exists(messages, lambda m: (m["role"] == role) & is_blank(m["content"]))
    named = [] if bad_encoding is None else [F.when(bad_encoding, CONTENT_REASONS[0])]
    named += [F.when(~well_formed(messages), CONTENT_REASONS[1]), F.when(blank("user"), CONTENT_REASONS[2]), F.when(blank("assistant"), CONTENT_REASONS[3])]
    return F.array_compact(F.array(*named))


def filter_content(records: DataFrame) -> DataFrame:
    """records with normalised messages, `reasons` and `accepted`."""
    out = records.withColumn("messages", normalize_messages(F.col("messages")))
    bad = F.col(BAD_ENCODING) if BAD_ENCODING in records.columns else None
    return out.withColumn("reasons", content_reasons(F.col("messages"), bad)).withColumn("accepted", F.size("reasons") == 0)


def reason_counts(filtered: DataFrame, domain: list[str] | None = None) -> DataFrame:
    return zero_filled_counts(filtered.select(F.explode("reasons").alias("reason")), "reason", domain or CONTENT_REASONS)


Validator = Callable[[DataFrame], Column]


def with_validation(records: DataFrame, validators: dict[str, Validator]) -> DataFrame:
    """Evidence of validators appended to `validation`; rows are never dropped.

    A validator gives struct(passed, detail).  An id that a record already carries makes `id_collision` true.
    """
    results = F.col("validation.results")
    shape = "array<struct<validator_id:string,passed:boolean,detail:string>>"
    old = F.coalesce(results, F.array().cast(shape))
    # each validator is one column, so that one with a UDF runs once a row
    verdicts = {i: v(records) for i, v in validators.items()}
    new = [F.struct(F.lit(i).alias("validator_id"), v["passed"].alias("passed"), v["detail"].alias("detail")) for i, v in verdicts.items()]
    both = F.concat(old, F.array(*new).cast(shape)) if new else old
    ids = F.transform(both, lambda r: r["validator_id"])
    return records.withColumns({"id_collision": F.size(F.array_distinct(ids)) < F.size(ids), "validation": F.struct(both.alias("results"))})


def validation_passed() -> Column:
    return F.forall("validation.results", lambda r: r["passed"])


def language_validator(language: str) -> Validator:
    def check(records: DataFrame) -> Column:
        same = F.col("language") == language
        return F.struct(same.alias("passed"), F.when(~same, F.concat(F.lit("language="), F.col("language"))).alias("detail"))

    return check


def python_validator(records: DataFrame) -> Column:
    """The language validator of Python records, as a hook by name."""
    return language_validator("python")(records)


def word_token_count(messages: Column) -> Column:
    """The stand-in tokenizer: two tokens, and one for each word of all messages."""
    words = lambda m: F.size(F.filter(F.split(m["content"], r"\s+"), lambda w: w != ""))
    return F.lit(2) + F.aggregate(F.transform(messages, words), F.lit(0), lambda a, n: a + n)


def quarter_token_count(messages: Column) -> Column:
    """A token for each four characters of a message or part of four."""
    return F.aggregate(F.transform(messages, lambda m: F.ceil(F.char_length(m["content"]) / 4).cast("int")), F.lit(0), lambda a, n: a + n)


TOKEN_COUNTS.add("words", word_token_count)
TOKEN_COUNTS.add("quarters", quarter_token_count)


def filter_length(records: DataFrame, least: int, most: int, count: Callable[[Column], Column] | str = word_token_count) -> DataFrame:
    """records with token_count and length_reason (too_short, too_long or null); bounds count as inside.

    count: a function of the messages, or the name of a registered one.
    """
    count = TOKEN_COUNTS.get(count) if isinstance(count, str) else count
    out = records.withColumn("token_count", count(F.col("messages")))
    return out.withColumn("length_reason", F.when(F.col("token_count") < least, "too_short").when(F.col("token_count") > most, "too_long"))


def token_distribution(counted: DataFrame, column: str = "token_count") -> DataFrame:
    """Count, least, most, mean and nearest-rank percentiles, as one row."""
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by {column})").cast("long")
    return counted.agg(
        F.count(column).alias("n"), F.min(column).cast("long").alias("least"), F.max(column).cast("long").alias("most"), F.avg(column).alias("mean"),
        rank(0.5).alias("p50"), rank(0.9).alias("p90"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
    )


def histogram(counted: DataFrame, column: str = "token_count") -> DataFrame:
    return counted.groupBy(F.col(column).cast("long").alias(column)).agg(F.count("*").alias("n"))


def source_contract_violations(records: DataFrame, *, language: str, source_id: str, revision: str, license_name: str, split: str | None = None) -> DataFrame:
    """Records that are not of the source they were read as."""
    p = "provenance."
    ok = (F.col("language") == language) & (F.col(p + "source_id") == source_id) & (F.col(p + "revision") == revision)
    ok = ok & (F.col(p + "license.name") == license_name) & F.col(p + "split").eqNullSafe(F.lit(split)) & F.col(p + "record_id").isNotNull()
    return records.where(~F.coalesce(ok, F.lit(False)))
