"""Evaluation analytics: pass rates, paired outcomes, exact tests, repeated runs, selection and gates."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from .checks import assert_empty, membership_drift


# --- aggregates ------------------------------------------------------------------------------------------


def pass_at_1(results: DataFrame, *keys: str) -> DataFrame:
    """total, passed, failed, timeout, harness and pass_at_1 (null if the harness failed anywhere) of each key.

    passed counts error_category none; all_tests_passed, which may differ, counts rows whose tests all passed.
    """
    cat = F.col("error_category")
    out = results.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(cat == "none").alias("passed"), F.count_if(~cat.isin("none", "timeout", "harness")).alias("failed"),
        F.count_if(cat == "timeout").alias("timeout"), F.count_if(cat == "harness").alias("harness"),
        F.count_if((F.col("tests.passed") == F.col("tests.total")) & (F.col("tests.total") > 0)).alias("all_tests_passed"),
    )
    return out.withColumn("pass_at_1", F.when(F.col("harness") == 0, F.col("passed") / F.col("total")))


def suite_comparison(paired: DataFrame) -> DataFrame:
    """Base and candidate passes of each suite and, as suite "all", of all tasks together."""
    agg = paired.rollup("suite").agg(
        F.count("*").alias("total"), F.count_if("base_passed").alias("base_passed"), F.count_if("candidate_passed").alias("candidate_passed"),
        F.count_if(F.col("candidate_passed") & ~F.col("base_passed")).alias("improvements"), F.count_if(F.col("base_passed") & ~F.col("candidate_passed")).alias("regressions"),
    )
    out = agg.withColumn("suite", F.coalesce("suite", F.lit("all")))
    return out.withColumns({"delta": F.col("candidate_passed") - F.col("base_passed"), "base_rate": F.col("base_passed") / F.col("total"), "candidate_rate": F.col("candidate_passed") / F.col("total")})


def transition(base: Column, candidate: Column) -> Column:
    return F.when(base & candidate, "preserved_pass").when(~base & ~candidate, "preserved_fail").when(candidate, "improvement").otherwise("regression")


def flip_matrix(paired: DataFrame) -> DataFrame:
    return paired.groupBy("suite", transition(F.col("base_passed"), F.col("candidate_passed")).alias("transition")).agg(F.count("*").alias("n"))


def category_scores(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Score of each category; a case without a response has failed, with the detail "response missing"."""
    both = cases.join(responses, "case_id", "left")
    scored = both.withColumn("passed", F.coalesce(F.col("response") == F.col("expected"), F.lit(False)))
    return scored.groupBy("category").agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.col("response").isNull()).alias("missing"),
    )


def duplicate_groups(results: DataFrame, code: str = "code_sha256", least: int = 2) -> DataFrame:
    """Codes that several tasks share, with their number and first and last task."""
    return results.groupBy(code).agg(F.count("*").alias("tasks"), F.min("task_id").alias("first_task"), F.max("task_id").alias("last_task")).where(F.col("tasks") >= least)


def token_summary(rows: DataFrame, column: str, cap: int, *keys: str) -> DataFrame:
    """Mean, interpolated median, nearest-rank p95, most, and rows at the cap."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(column).alias("mean"), F.median(column).alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {column})").alias("p95"), F.max(column).alias("most"), F.count_if(F.col(column) == cap).alias("at_cap"),
    )


def suite_performance(rows: DataFrame) -> DataFrame:
    """rows: suite, tokens, latency.  Tokens a second, 0 where the latency is 0."""
    out = rows.groupBy("suite").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("latency").alias("latency"))
    return out.withColumn("tokens_per_second", F.when(F.col("latency") > 0, F.col("tokens") / F.col("latency")).otherwise(0.0))


# --- exact tests -----------------------------------------------------------------------------------------


def sign_tail(improvements: int, regressions: int) -> float:
    """P(at least so many improvements) of a fair coin over the discordant pairs; exact integers."""
    n = improvements + regressions
    return float(sum(math.comb(n, k) for k in range(improvements, n + 1))) / float(2**n) if n else 1.0


def _log_tail(improvements: int, regressions: int) -> float:
    """The same where 2 ** n is beyond a double."""
    n = improvements + regressions
    if n <= 1000:
        return sign_tail(improvements, regressions)
    half = n * math.log(2)
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - half for k in range(improvements, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


#: One call for each row of an aggregate: exact integer arithmetic is what a Python function is needed for.
sign_tail_udf = F.udf(lambda a, b: None if a is None or b is None else _log_tail(int(a), int(b)), T.DoubleType())


def minimum_net_gain(comparisons: int, alpha: float = 0.05) -> int:
    """The least gain without regressions that survives Bonferroni."""
    gain = 1
    while 0.5**gain > alpha / comparisons:
        gain += 1
    return gain


def paired_effect(paired: DataFrame, *, comparisons: int, alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    b, c = F.col("base_passed"), F.col("candidate_passed")
    out = paired.groupBy(*keys).agg(
        F.count("*").alias("total_tasks"), F.count_if(c & ~b).alias("improvements"), F.count_if(b & ~c).alias("regressions"),
        F.count_if(b & c).alias("unchanged_pass"), F.count_if(~b & ~c).alias("unchanged_fail"),
    )
    out = out.withColumns({"net_improvement": F.col("improvements") - F.col("regressions"), "unadjusted_p_value": sign_tail_udf("improvements", "regressions")})
    least = minimum_net_gain(comparisons, alpha)
    out = out.withColumns({
        "delta_rate": F.col("net_improvement") / F.col("total_tasks"), "adjusted_p_value": F.least(F.lit(1.0), F.col("unadjusted_p_value") * comparisons),
        "minimum_net_improvement": F.lit(least),
    })
    return out.withColumn("strong_evidence", (F.col("net_improvement") >= least) & (F.col("adjusted_p_value") <= alpha))


def paired_membership_violations(base: DataFrame, candidate: DataFrame, key: str = "task_id") -> DataFrame:
    return membership_drift(base, candidate, key)


def paired_join(base: DataFrame, candidate: DataFrame, key: str = "task_id", passed: str = "passed") -> DataFrame:
    """(key, base_passed, candidate_passed) of two runs over the same tasks; other tasks on one side, or a repeated one, are an error."""
    assert_empty(paired_problems(base, candidate, key), "the runs are not of the same tasks")
    return base.select(key, F.col(passed).alias("base_passed")).join(candidate.select(key, F.col(passed).alias("candidate_passed")), key)


def paired_problems(base: DataFrame, candidate: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, problem): tasks that the candidate lacks (missing), only it has (unexpected), or that a side has several times (repeated)."""
    both = base.select(key, F.lit(1).alias("b"), F.lit(0).alias("c")).unionAll(candidate.select(key, F.lit(0).alias("b"), F.lit(1).alias("c")))
    counts = both.groupBy(key).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    problem = F.when(F.col("c") == 0, "missing").when(F.col("b") == 0, "unexpected").when(F.greatest("b", "c") > 1, "repeated")
    return counts.select(key, problem.alias("problem")).where("problem is not null")


# --- repeated runs ---------------------------------------------------------------------------------------


def run_variance(runs: DataFrame) -> DataFrame:
    """runs: run, task_id, passed, all runs with the same tasks.  One row of variance and flips."""
    per_run = runs.groupBy("run").agg(F.count_if("passed").alias("p"), F.count("*").alias("n"))
    scores = per_run.agg(
        F.count("*").alias("run_count"), F.max("n").alias("task_count"), (F.max("p") - F.min("p")).alias("score_range"), F.var_pop("p").alias("score_variance"),
        F.var_pop(F.col("p") / F.col("n")).alias("rate_variance"),
    )
    before = F.lag("passed").over(Window.partitionBy("task_id").orderBy("run"))
    flips = runs.withColumn("flip", F.coalesce(before != F.col("passed"), F.lit(False)))
    tasks = flips.groupBy("task_id").agg(F.count_if("flip").alias("f"), (F.min("passed") != F.max("passed")).alias("unstable"))
    changes = tasks.agg(F.sum("f").alias("flips"), F.count_if("unstable").alias("unstable_tasks"))
    out = scores.join(F.broadcast(changes))
    return out.withColumn("flip_rate", F.col("flips") / ((F.col("run_count") - 1) * F.col("task_count")))


def run_membership_violations(runs: DataFrame) -> DataFrame:
    days = runs.agg(F.count_distinct("run").alias("days"))
    return runs.groupBy("task_id").agg(F.count("*").alias("n")).join(F.broadcast(days)).where("n <> days")


# --- reproduction, selection, gates ----------------------------------------------------------------------


def reproduction_diff(expected: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that are missing, unexpected or changed, with the names of the changed fields."""
    left = expected.select(F.col(key), F.lit(True).alias("_l"), *[F.col(f).alias(f"l_{f}") for f in fields])
    right = found.select(F.col(key), F.lit(True).alias("_r"), *[F.col(f).alias(f"r_{f}") for f in fields])
    both = left.join(right, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), f) for f in fields]))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "unexpected").when(F.size("changed") > 0, "changed")
    out = both.withColumn("changed", changed).withColumn("status", status).where("status is not null")
    return out.select(key, "status", F.when(F.col("status") == "changed", F.array_join("changed", ",")).otherwise("").alias("changed_fields"))


def select_candidate(scores: DataFrame) -> DataFrame:
    """The eligible candidate of most passes; then the earliest step, the lowest rate, the label."""
    return scores.where("eligible").orderBy(F.desc("combined_passed"), "step", "learning_rate", "label").limit(1)


def gate(evidence: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each check (check_id, passed) of one row of evidence; what is null has not passed."""
    rows = F.array(*[F.struct(F.lit(i).alias("check_id"), F.coalesce(c, F.lit(False)).alias("passed")) for i, c in checks.items()])
    return evidence.select(F.explode(rows).alias("c")).select("c.*")


def gate_decision(checked: DataFrame) -> DataFrame:
    """All checks must pass; the failed ones are named in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_id"))))
    return checked.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.array_join(failed, ",").alias("failed_checks"))


def study_gates(min_stop: float = 0.90, min_accept: float = 0.80) -> dict[str, Column]:
    """For evidence stop_rate, accept_rate, contamination_status."""
    return {"stop_rate": F.col("stop_rate") >= min_stop, "student_length_accept_rate_given_stop": F.col("accept_rate") >= min_accept, "contamination": F.col("contamination_status") == "clean"}


def preservation_gates(minimum: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """For evidence <suite>_passed, <suite>_total: at least so many of exactly so many."""
    return {f"{s}_preservation": (F.col(f"{s}_total") == total) & (F.col(f"{s}_passed") >= passed) for s, (passed, total) in minimum.items()}


def cross_language_conclusion(rows: DataFrame) -> DataFrame:
    """rows: language, base_passed, candidate_passed, total.  catastrophic: all that passed is lost; inconclusive: nothing did."""
    c = F.when(F.sum("base_passed") == 0, "inconclusive").when(F.count_if((F.col("base_passed") > 0) & (F.col("candidate_passed") == 0)) > 0, "catastrophic").otherwise("none")
    return rows.agg(c.alias("conclusion"))


@F.pandas_udf(T.BooleanType())
def json_equal(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two texts are equal JSON: key order, the way a number is written and repeated keys (the last holds) do not matter."""

    def equal(a: str | None, b: str | None) -> bool:
        try:
            return a is not None and b is not None and json.loads(a) == json.loads(b)
        except (ValueError, RecursionError):
            return False

    return pd.Series([equal(a, b) for a, b in zip(left, right, strict=True)], dtype=object)


def response_score(kind: Column, expected: Column, response: Column) -> Column:
    """exact text, equal JSON whatever its key order, or a response that is one marked tool call and nothing else."""
    call = F.regexp_extract(response, r"(?s)\A<tool_call>(.+)</tool_call>\z", 1)
    same = F.when(kind == "exact", response == expected).otherwise(json_equal(F.when(kind == "json", response).when(kind == "tool_call", call), expected))
    return F.coalesce(same, F.lit(False))


def structural_score(text: Column, tokens: Column, required: list[str], forbidden: list[str], budget: int) -> Column:
    """struct(passed, reason): text that is not blank, ended before its budget of tokens, and has the patterns in any case."""
    missing = F.array_compact(F.array(*[F.when(~text.rlike(f"(?ims){p}"), F.lit(p)) for p in required]).cast("array<string>"))
    reason = F.when(text.isNull() | is_blank(text), "empty response").when(tokens.isNull() | (tokens >= budget), "generation reached the token budget")
    for p in forbidden:
        reason = reason.when(text.rlike(f"(?im){p}"), f"forbidden pattern matched: {p}")
    reason = reason.when(F.size(missing) > 0, F.concat(F.lit("missing required patterns: "), F.array_join(missing, ", ")))
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"))


def marked_passes(stderr: Column, marker: str, total: Column) -> Column:
    """Distinct numbers from 1 to total on lines of the marker."""
    found = F.regexp_extract_all(stderr, F.lit(rf"(?m)^\Q{marker}\E(\d{{1,9}})$"), 1)
    return F.size(F.filter(F.array_distinct(F.transform(found, lambda x: x.cast("int"))), lambda n: (n >= 1) & (n <= total)))


def outcome_category(status: Column, passed: Column, total: Column) -> Column:
    """Error category from the recorded status of an execution and its passed tests."""
    return (
        F.when(status == "timeout", "timeout").when(status.isin("harness_error", "not_started"), "harness").when(status == "syntax_error", "syntax")
        .when((status == "ok") & (passed == total), "none").when(status == "ok", "assertion").otherwise("runtime")
    )


def promotion_gates(policy: dict) -> dict[str, Column]:
    """The eight checks of an adapter's promotion.

    policy: combined (least passed, total), suites {name: (passed, total)}, general (least passed, total, most
    regressions), cross_conclusion, languages {name: (least passed, total)}, contamination, load_required.
    """
    passed, total = policy["combined"]
    least, cases, regressions = policy["general"]
    cross = F.col("cross_language_conclusion") == policy["cross_conclusion"]
    for name, (n, of) in policy["languages"].items():
        cross = cross & (F.col(f"{name}_total") == of) & (F.col(f"{name}_passed") >= n)
    return {
        "combined_gain": (F.col("combined_total") == total) & (F.col("combined_passed") >= passed),
        **preservation_gates(policy["suites"]),
        "general_tool_preservation": (F.col("general_total") == cases) & (F.col("general_passed") >= least) & (F.col("general_regressions") <= regressions),
        "cross_language_preservation": cross,
        "contamination_evidence": F.col("contamination_status") == policy["contamination"],
        "adapter_load_validation": F.col("load_validated") | F.lit(not policy["load_required"]),
    }


def superiority_gates(*, margin: int, alpha: float, most_regression_rate: float) -> dict[str, Column]:
    """For a row of paired_effect(): a teacher is better by enough tasks, beyond chance, and loses few."""
    return {
        "net_improvement": F.col("net_improvement") >= margin,
        "significance": F.col("adjusted_p_value") <= alpha,
        "regression_rate": F.try_divide("regressions", "total_tasks") <= most_regression_rate,
        "improvements_exceed_regressions": F.col("improvements") > F.col("regressions"),
    }


def teacher_evidence(paired: DataFrame, primary: list[str], suites: list[str]) -> DataFrame:
    """One row of paired (suite, base_passed, candidate_passed): totals, passes and net gain of the primary suites together and of each suite."""
    b, c = F.col("base_passed"), F.col("candidate_passed")
    out = []
    for name, inside in (("primary", F.col("suite").isin(primary)), *((s, F.col("suite") == s) for s in suites)):
        up, down = F.count_if(inside & c & ~b), F.count_if(inside & b & ~c)
        out += [F.count_if(inside).alias(f"{name}_total"), F.count_if(inside & c).alias(f"{name}_passed"), up.alias(f"{name}_improvements"), down.alias(f"{name}_regressions"), (up - down).alias(f"{name}_net")]
    return paired.agg(*out).withColumn("primary_p_value", sign_tail_udf("primary_improvements", "primary_regressions"))


def teacher_gates(primary: dict, non_regression: dict[str, int], non_catastrophic: dict[str, int]) -> dict[str, Column]:
    """The checks of a teacher's superiority over teacher_evidence(): nine, for two suites of either kind.

    primary: total, least_passed, least_net, least_gain (of the pass rate), most_p.  non_regression: suite to the least net gain.
    non_catastrophic: suite to the most passes it may lose.
    """
    net, total = F.col("primary_net"), F.col("primary_total")
    checks = {
        "primary_membership_exact": total == primary["total"], "primary_minimum_teacher_score": F.col("primary_passed") >= primary["least_passed"], "primary_minimum_net_effect": net >= primary["least_net"],
        "primary_minimum_rate_effect": F.try_divide(net, total) >= primary["least_gain"], "primary_paired_significance": F.col("primary_p_value") <= primary["most_p"],
    }
    checks |= {f"{s}_non_regression": F.col(f"{s}_net") >= least for s, least in non_regression.items()}
    return checks | {f"{s}_non_catastrophic": F.col(f"{s}_net") >= -most for s, most in non_catastrophic.items()}


def target_gate(partitions: DataFrame, required: int) -> DataFrame:
    """Development and qualification passes together against the number required."""
    out = partitions.agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    return out.withColumns({"required": F.lit(required), "met": F.col("passed") >= required})
