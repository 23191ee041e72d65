"""Token ledgers and the alignment of rollout trajectories.

A session's turns (session_id, turn_index, prompt_ids, output_ids) hold a ledger: each prompt begins with all that
went before, its rest being what was appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _turns() -> Window:
    return Window.partitionBy("session_id").orderBy("turn_index")


def ledger(turns: DataFrame) -> DataFrame:
    """turns with appended_ids, prefix_ok and state problems; the first prompt is appended whole."""
    before = F.lag(F.concat("prompt_ids", "output_ids")).over(_turns())
    known = F.coalesce(before, F.array().cast("array<int>"))
    kept = F.when(F.size("prompt_ids") >= F.size(known), F.slice("prompt_ids", F.lit(1), F.size(known)) == known).otherwise(F.lit(False))
    appended = F.slice("prompt_ids", F.size(known) + 1, F.greatest(F.size("prompt_ids") - F.size(known), F.lit(0)))
    out = turns.withColumns({"prefix_ok": kept, "appended_ids": F.when(kept, appended), "_place": F.row_number().over(_turns()) - 1})
    problem = (
        F.when(F.col("turn_index") != F.col("_place"), "turn_gap").when(~F.col("prefix_ok"), "prefix_changed")
        .when(F.size("output_ids") == 0, "output_missing").when((F.col("_place") > 0) & (F.size("appended_ids") == 0), "nothing_appended")
    )
    return out.withColumn("problem", problem).drop("_place")


def segment_violations(turns: DataFrame) -> DataFrame:
    """Turns whose segments (kind, start, end) do not cover the appended ids without gap or overlap."""
    end = F.aggregate("segments", F.lit(0), lambda at, s: F.when((at >= 0) & (s["start"] == at) & (s["end"] > at), s["end"]).otherwise(F.lit(-1)))
    return turns.where(~F.coalesce(end == F.size("appended_ids"), F.lit(False)))


def offsets(turns: DataFrame, appended: str = "n_appended", output: str = "n_output") -> DataFrame:
    """turns with input_start, action_start and action_end: half-open places in the session's token sequence."""
    before = F.sum(F.col(appended) + F.col(output)).over(_turns().rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return turns.withColumns({"input_start": start, "action_start": start + F.col(appended), "action_end": start + F.col(appended) + F.col(output)})


def align(turns: DataFrame) -> DataFrame:
    """One row a session: input_ids, action_ids, action_mask, and problem where log-probabilities do not fit.

    turns: appended_ids, output_ids, log_probs.  A session's turns are one conversation, so one row may hold them.
    """
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "appended_ids", "output_ids", "log_probs")))
    grouped = turns.groupBy("session_id").agg(rows.alias("t"))
    each = lambda f: F.flatten(F.transform("t", f))
    mask = each(lambda t: F.concat(F.array_repeat(F.lit(False), F.size(t["appended_ids"])), F.array_repeat(F.lit(True), F.size(t["output_ids"]))))
    fits = F.forall("t", lambda t: (F.size(t["log_probs"]) == F.size(t["output_ids"])) & F.forall(t["log_probs"], lambda p: ~F.isnan(p) & (p <= 0)))
    return grouped.select(
        "session_id", each(lambda t: F.concat(t["appended_ids"], t["output_ids"])).alias("input_ids"), each(lambda t: t["output_ids"]).alias("action_ids"),
        mask.alias("action_mask"), F.aggregate(each(lambda t: t["log_probs"]), F.lit(0.0), lambda a, p: a + p).alias("log_prob_sum"),
        F.when(~fits, "log_probs_do_not_fit").alias("problem"),
    )


def bind_rewards(aligned: DataFrame, rewards: DataFrame) -> DataFrame:
    """aligned with reward; a session without one has the problem "reward_missing"."""
    out = aligned.join(rewards, "session_id", "left")
    return out.withColumn("problem", F.coalesce("problem", F.when(F.col("reward").isNull() | F.isnan("reward"), "reward_missing")))
