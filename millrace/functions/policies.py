"""Prompt policies: an instruction for a teacher model, put into a record's system message and taken out again.

A policy leaves its id, its digest and, where it grants each row an answer budget, the numbers the budget came from in the
record's metadata, so that taking it out can verify all of them.  What does not verify is a problem, not a guess.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MESSAGE, answer_budget, metadata_update, strip

# The metadata keys of a policy.
POLICY, DIGEST = "distillation.input_policy", "distillation.input_policy_sha256"
PROMPT_TOKENS, BUDGET = "distillation.student_prompt_tokens", "distillation.final_answer_budget_tokens"
WINDOW, RESERVE, CEILING = "distillation.student_max_tokens", "distillation.answer_budget_reserve_tokens", "distillation.answer_budget_ceiling_tokens"
_MARK = "\n\n"


@dataclass(frozen=True)
class Budget:
    """Tokens of a row's answer: what the window leaves after the prompt and a reserve, up to a ceiling."""

    window: int = 2048
    reserve: int = 128
    ceiling: int = 1792

    def of(self, prompt_tokens: Column) -> Column:
        return answer_budget(prompt_tokens, self.ceiling, self.window, self.reserve)


@dataclass(frozen=True)
class Policy:
    """An instruction; with a budget it is a template that names {answer_budget}."""

    id: str
    template: str
    budget: Budget | None = None

    @property
    def digest(self) -> str:
        if self.budget is None:
            return hashlib.sha256(self.template.encode()).hexdigest()
        fields = {"policy_id": self.id, "template": self.template, "student_max_tokens": self.budget.window, "safety_reserve_tokens": self.budget.reserve, "max_answer_tokens": self.budget.ceiling}
        return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def instruction(self, granted: Column) -> Column:
        return F.lit(self.template) if self.budget is None else F.replace(F.lit(self.template), F.lit("{answer_budget}"), granted.cast("string"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _rest(messages: Column) -> Column:
    return F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))


def apply_policy(messages: Column, metadata: Column, policy: Policy, prompt_tokens: Column | None = None) -> Column:
    """struct(messages, metadata, problem) of a record given the policy; a record with a problem stays as it is.

    The prompt, all messages but the last, must end with a user's; prompt_tokens are those of the prompt, which only a budget needs.
    Problems: no_answer, no_user_message, policy_present, prompt_tokens (none counted), no_budget.
    """
    granted = policy.budget.of(prompt_tokens) if policy.budget else F.lit(None).cast("int")
    problem = (
        F.when(~F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False)), "no_answer")
        .when(F.try_element_at(metadata, F.lit(POLICY)).isNotNull() | F.try_element_at(metadata, F.lit(DIGEST)).isNotNull(), "policy_present")
        .when(~F.coalesce(F.try_element_at(messages, F.lit(-2))["role"] == "user", F.lit(False)), "no_user_message")
    )
    facts = {POLICY: F.lit(policy.id), DIGEST: F.lit(policy.digest)}
    if policy.budget:
        problem = problem.when(~F.coalesce(prompt_tokens >= 1, F.lit(False)), "prompt_tokens").when(granted.isNull(), "no_budget")
        facts |= {PROMPT_TOKENS: prompt_tokens, BUDGET: granted, WINDOW: F.lit(policy.budget.window), RESERVE: F.lit(policy.budget.reserve), CEILING: F.lit(policy.budget.ceiling)}
    head = F.get(messages, F.lit(0))
    words = policy.instruction(granted)
    ended = F.regexp_replace(head["content"], r"(?U)[\s\x1c-\x1f]+$", "")
    added = F.when(head["role"] == "system", F.concat(F.array(_message("system", F.concat(ended, F.lit(_MARK), words))), _rest(messages))).otherwise(F.concat(F.array(_message("system", words)), messages))
    done = problem.isNull()
    return F.struct(F.when(done, added).otherwise(messages).alias("messages"), F.when(done, metadata_update(metadata, facts)).otherwise(metadata).alias("metadata"), problem.alias("problem"))


def _whole(metadata: Column, key: str) -> Column:
    raw = F.try_element_at(metadata, F.lit(key))
    return F.when(strip(raw).rlike(r"^\+?\d{1,18}$"), strip(raw).try_cast("long"))


def _unbudgeted(policy: Policy, metadata: Column) -> Column:
    return F.lit(None).cast("string")


def _budget_problem(policy: Policy, metadata: Column) -> Column:
    """What the numbers in the metadata say against the policy's."""
    b = policy.budget
    numbers = {k: _whole(metadata, k) for k in (PROMPT_TOKENS, BUDGET, WINDOW, RESERVE, CEILING)}
    out = F.when(F.greatest(*[n.isNull() for n in numbers.values()]), "policy_numbers")
    for key, wanted, name in ((WINDOW, b.window, "window"), (RESERVE, b.reserve, "reserve"), (CEILING, b.ceiling, "ceiling")):
        out = out.when(numbers[key] != wanted, f"policy_{name}")
    granted = b.of(numbers[PROMPT_TOKENS])
    return out.when((numbers[PROMPT_TOKENS] < 1) | granted.isNull() | (numbers[BUDGET] != granted), "policy_budget")


def strip_policies(messages: Column, metadata: Column, policies: list[Policy]) -> Column:
    """struct(messages, problem): the record's messages without the policy that its metadata names; without one, as they are.

    The metadata stays: it is provenance.  A record with a problem stays as it is.  Problems, in the order of looking:
    incomplete_policy, unknown_policy, policy_digest, no_answer, then for budgets policy_numbers, policy_window, policy_reserve,
    policy_ceiling and policy_budget, then no_system_message, empty_system_message, policy_text, and nothing_left.
    """
    name, digest = F.try_element_at(metadata, F.lit(POLICY)), F.try_element_at(metadata, F.lit(DIGEST))
    head, last = F.get(messages, F.lit(0)), F.try_element_at(messages, F.lit(-1))
    same = F.struct(messages.cast(f"array<{MESSAGE}>").alias("messages"), F.lit(None).cast("string").alias("problem"))
    failed = lambda reason: F.struct(messages.cast(f"array<{MESSAGE}>").alias("messages"), reason.alias("problem"))
    out = F.when(name.isNull() & digest.isNull(), same).when(name.isNull() | digest.isNull(), failed(F.lit("incomplete_policy")))
    for policy in policies:
        words = policy.instruction(_whole(metadata, BUDGET))
        tail = F.concat(F.lit(_MARK), words)
        alone, after = head["content"] == words, F.endswith(head["content"], tail)
        bare = F.substring(head["content"], F.lit(1), F.char_length(head["content"]) - F.char_length(tail))
        left = F.when(alone, _rest(messages)).otherwise(F.concat(F.array(_message("system", bare)), _rest(messages))).cast(f"array<{MESSAGE}>")
        problem = F.coalesce(
            F.when(digest != policy.digest, "policy_digest").when(~F.coalesce(last["role"] == "assistant", F.lit(False)), "no_answer"),
            (_budget_problem if policy.budget else _unbudgeted)(policy, metadata),
            F.when(head["role"] != "system", "no_system_message").when(~alone & after & (bare == ""), "empty_system_message").when(~alone & ~after, "policy_text")
            .when(~F.coalesce(F.try_element_at(left, F.lit(-1))["role"] == "assistant", F.lit(False)), "nothing_left"),
        )
        out = out.when(name == policy.id, F.when(problem.isNotNull(), failed(problem)).otherwise(F.struct(left.alias("messages"), F.lit(None).cast("string").alias("problem"))))
    return out.otherwise(failed(F.lit("unknown_policy")))
