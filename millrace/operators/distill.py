"""Distillation data: shards and their completeness, reconstruction, merging, funnels and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_reasoning, strip


#: What is measured of a teacher's rows: its own prompt, completion, reasoning and answer, and what the student gets.
LENGTHS = (
    "teacher_prompt_tokens", "teacher_completion_tokens", "reasoning_chars", "teacher_final_answer_tokens", "student_prompt_tokens", "student_final_answer_tokens", "student_full_record_tokens",
)


def shard_index(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("long")


def shard_status(expected: DataFrame, payload: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Of each shard: complete, incomplete (no sidecar, or too few rows), corrupt (digest differs) or error.

    expected: shard, n.  payload: shard, n, sha256.  sidecar: shard, sha256; it is the mark of a commit, and one
    without its payload is an error.
    """
    p, s = payload.select("shard", F.col("n").alias("p_n"), F.col("sha256").alias("p_h")), sidecar.select("shard", F.col("sha256").alias("s_h"))
    both = expected.join(p, "shard", "full_outer").join(s, "shard", "full_outer")
    status = (
        F.when(F.col("s_h").isNotNull() & F.col("p_h").isNull(), "error").when(F.col("s_h").isNull(), "incomplete")
        .when(F.col("s_h") != F.col("p_h"), "corrupt").when(~F.coalesce(F.col("n") == F.col("p_n"), F.lit(False)), "incomplete").otherwise("complete")
    )
    return both.select("shard", status.alias("status"))


def resume(wanted: DataFrame, cached: DataFrame, key: str = "item_id", contract: str = "prompt_sha256") -> DataFrame:
    """wanted with status hit (cached under the same contract), miss, or drift, and the cached response of hits."""
    c = cached.select(F.col(key), F.col(contract).alias("_contract"), F.col("response").alias("_response"))
    out = wanted.join(c, key, "left")
    status = F.when(F.col("_contract").isNull(), "miss").when(F.col("_contract") == F.col(contract), "hit").otherwise("drift")
    return out.withColumns({"status": status, "response": F.when(F.col("_contract") == F.col(contract), F.col("_response"))}).drop("_contract", "_response")


def unknown_cached(wanted: DataFrame, cached: DataFrame, key: str = "item_id") -> DataFrame:
    return cached.join(wanted, key, "left_anti")


def reconstruct(source: DataFrame, shards: DataFrame) -> DataFrame:
    """Records of the source whose last message is the shard row's answer, joined by input_index.

    Rows whose record or prompt hash is not the source's have the problem "drift"; absent ones, "missing".
    """
    s = shards.select("input_index", F.col("input_record_sha256").alias("_r"), F.col("prompt_sha256").alias("_p"), "final_response", "finish_reason")
    out = source.join(s, "input_index", "left")
    same = (F.col("_r") == F.col("record_sha256")) & (F.col("_p") == F.col("prompt_sha256"))
    answer = F.struct(F.lit("assistant").alias("role"), F.col("final_response").alias("content"))
    history = F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))
    problem = F.when(F.col("_r").isNull(), "missing").when(~same, "drift")
    return out.withColumns({"messages": F.when(same, F.concat(history, F.array(answer))).otherwise(F.col("messages")), "problem": problem}).drop("_r", "_p", "final_response")


def merge_compressed(rows: DataFrame, compressed: DataFrame) -> DataFrame:
    """rows (input_index, answer, tokens) with compressed answers where there are any, and what was before."""
    c = compressed.select("input_index", F.col("answer").alias("_answer"), F.col("tokens").alias("_tokens"))
    out = rows.join(c, "input_index", "left")
    return out.withColumns({
        "answer": F.coalesce("_answer", "answer"), "tokens_before": F.col("tokens"), "tokens": F.coalesce("_tokens", "tokens"), "compressed": F.col("_answer").isNotNull(),
    }).drop("_answer", "_tokens")


def merge_accounting(merged: DataFrame, cap: int) -> DataFrame:
    return merged.agg(
        F.count("*").alias("n"), F.count_if("compressed").alias("compressed"), F.sum("tokens_before").cast("long").alias("tokens_before"), F.sum("tokens").cast("long").alias("tokens_after"),
        F.count_if(F.col("tokens_before") > cap).alias("over_before"), F.count_if(F.col("tokens") > cap).alias("over_after"),
    )


def compression_targets(rows: DataFrame, window: int = 2048) -> DataFrame:
    """Rows that stopped and whose prompt and answer exceed the window, their answer exceeding its budget."""
    return rows.where((F.col("finish_reason") == "stop") & (F.col("full_tokens") > window) & (F.col("answer_tokens") > F.col("budget")))


def compression_violations(rows: DataFrame, window: int = 2048) -> DataFrame:
    """Rows too long although the answer keeps its budget: the budget was wrong."""
    return rows.where((F.col("finish_reason") == "stop") & (F.col("full_tokens") > window) & (F.col("answer_tokens") <= F.col("budget")))


def prefilter(rows: DataFrame) -> DataFrame:
    """rows (finish_reason, quality_passed) with prefilter_reason: not_stopped, quality, or null."""
    stopped = F.coalesce(F.col("finish_reason") == "stop", F.lit(False))
    return rows.withColumn("prefilter_reason", F.when(~stopped, "not_stopped").when(~F.coalesce("quality_passed", F.lit(False)), "quality"))


def funnel(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Rows left after each stage: stages name boolean columns, applied in turn."""
    alive, out = F.lit(True), [F.count("*").alias("input")]
    for stage in stages:
        alive = alive & F.coalesce(F.col(stage), F.lit(False))
        out.append(F.count_if(alive).alias(stage))
    return rows.agg(*out)


def length_diagnostics(rows: DataFrame, least: int, most: int) -> DataFrame:
    """Stop rate, acceptance by length given a stop, and token percentiles; one row."""
    stop, fits = F.col("finish_reason") == "stop", F.col("tokens").between(least, most)
    p = lambda q, name: F.expr(f"percentile_disc({q}) within group (order by tokens)").cast("long").alias(name)
    out = rows.agg(F.count("*").alias("total"), F.count_if(stop).alias("stopped"), F.count_if(stop & fits).alias("accepted"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"))
    return out.withColumns({"stop_rate": F.try_divide("stopped", "total"), "accept_rate": F.coalesce(F.try_divide("accepted", "stopped"), F.lit(0.0))})


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(distribution, n, least, most, mean, p50, p90, p95, p99) of each column of whole numbers; nulls are not counted.

    One pass makes (distribution, value, count) rows, as many as there are different lengths; ranks are sums over these.
    Percentiles are nearest-rank: the smallest value that at least that share of the rows does not exceed.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("distribution"), F.col(c).cast("long").alias("value")) for c in columns])
    counts = rows.select(F.inline(pairs)).where("value is not null").groupBy("distribution", "value").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("distribution").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"rank": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy("distribution"))})
    at = lambda q, name: F.min(F.when(F.col("rank") * 100 >= F.col("n") * q, F.col("value"))).alias(name)
    mean = F.sum(F.col("value") * F.col("c")) / F.sum("c")
    out = ranked.groupBy("distribution").agg(F.sum("c").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), mean.alias("mean"), *[at(q, f"p{q}") for q in (50, 90, 95, 99)])
    return out


def teacher_lengths(rows: DataFrame, window: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(summary, distributions) of rows with finish_reason and the seven LENGTHS.

    summary: total, stopped, stop_rate, accepted (stopped and within the window), accept_rate given a stop.
    """
    stop, fits = F.col("finish_reason") == "stop", F.col("student_full_record_tokens") <= window
    out = rows.agg(F.count("*").alias("total"), F.count_if(stop).alias("stopped"), F.count_if(stop & fits).alias("accepted"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({"stop_rate": rate("stopped", "total"), "accept_rate": rate("accepted", "stopped")}), distributions(rows, list(LENGTHS))


def salvage(rows: DataFrame) -> DataFrame:
    """rows (completion, finish_reason) with reasoning, answer, mode and error.

    mode: wrapped and closing-only for reasoning that is marked, by the way it begins; truncated-reasoning-only for an
    unmarked completion cut off by its length, all of which is reasoning, so that its answer is empty; refused for what cannot be
    told apart: malformed markup, and an unmarked completion that stopped.  A refused row has neither reasoning nor answer.
    """
    bare = strip(F.col("completion"))
    out = rows.withColumn("_s", split_reasoning(F.col("completion")))
    marked, cut = bare.contains("<think>") | bare.contains("</think>"), F.col("finish_reason") == "length"
    refused = F.when(marked, F.col("_s.error")).when(~F.coalesce(cut, F.lit(False)), "no boundary between reasoning and answer")
    mode = F.when(F.col("error").isNotNull(), "refused").when(~marked, "truncated-reasoning-only").when(bare.startswith("<think>"), "wrapped").otherwise("closing-only")
    out = out.withColumn("error", F.when(F.col("completion").isNull(), "no completion").otherwise(refused)).withColumn("mode", mode)
    reasoning = F.when(F.col("mode") == "truncated-reasoning-only", F.when(bare != "", bare)).when(F.col("error").isNull(), F.col("_s.reasoning"))
    answer = F.when(F.col("mode") == "truncated-reasoning-only", "").when(F.col("error").isNull(), F.col("_s.answer"))
    return out.select(*rows.columns, reasoning.alias("reasoning"), answer.alias("answer"), "mode", "error")


def semantic_accounts(split: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(partition, before, kept, refused, unverified, problem) of a filtered split, counted anew, and verdicts about records it lacks.

    A partition's problem is unverified (records without a verdict), contradictory (records with several), or emptied.  Verdicts
    about no record of the split are a row without a partition, their number in `before`.
    """
    own = verdicts.groupBy("record_sha256").agg(F.count_if("passed").alias("yes"), F.count_if(~F.col("passed")).alias("no"))
    rows = split.select("record_sha256", "partition").join(own, "record_sha256", "left")
    yes, no = F.coalesce("yes", F.lit(0)) > 0, F.coalesce("no", F.lit(0)) > 0
    counts = rows.groupBy("partition").agg(F.count("*").alias("before"), F.count_if(yes).alias("kept"), F.count_if(~yes & no).alias("refused"), F.count_if(~yes & ~no).alias("unverified"), F.count_if(yes & no).alias("_both"))
    problem = F.when(F.col("unverified") > 0, "unverified").when(F.col("_both") > 0, "contradictory").when(F.col("kept") == 0, "emptied")
    unknown = own.join(split.select("record_sha256").distinct(), "record_sha256", "left_anti").agg(F.count("*").alias("before")).where("before > 0")
    none = [F.lit(None).cast("long").alias(c) for c in ("kept", "refused", "unverified")]
    return counts.withColumn("problem", problem).drop("_both").unionByName(unknown.select(F.lit(None).cast("string").alias("partition"), "before", *none, F.lit("unknown_record").alias("problem")))


def semantic_filter(split: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of an existing split whose verdict passed, in the partition they had."""
    return split.join(verdicts.where("passed").select("record_sha256").distinct(), "record_sha256", "left_semi")
