"""Contamination of training records by protected examples, and across environment partitions.

Exact matches are equi-joins on hashes.  Overlap candidates come from an equi-join on the rarest shingles of the smaller
set (overlap_pairs()), never from pairs, and are then counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_text, prompt_sha256, prompt_text, response_sha256, sha256, with_shingles
from ..work import discard, placed, written

SHINGLE, LEAST_TOKENS, THRESHOLD = 5, 16, 0.8
#: Protected shingles that are broadcast; more of them are joined by a shuffle.
FEW = 500_000
#: Pairs of equal hashes that one task makes.
PAIRS = 1_000_000
CHECKERS = ("exact_prompt", "overlap_prompt", "exact_solution", "overlap_solution")
COLUMNS = ("checker_id", "protected_dataset_id", "finding_type", "training_record_sha256", "protected_record_id", "score")


def protected_example(benchmark: DataFrame, dataset_id: str) -> DataFrame:
    """A benchmark table (item_id, text) as examples whose prompt and solution are its text."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return benchmark.select(
        F.lit(dataset_id).alias("protected_dataset_id"), F.col("item_id").cast("string").alias("protected_record_id"),
        message.alias("prompt_messages"), F.col("text").alias("solution"),
    )


def overlap_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(lid, rid, raw) of all pairs of left (lid, shingles) and right (rid, shingles) whose overlap coefficient is `threshold` or more.

    The coefficient is the count of shared shingles over those of the smaller set.  Of n shingles of the smaller one, all but
    the first n - ceil(threshold * n) + 1 in any order are too few to reach it, so a pair is a candidate only if the other set has one
    of these; the order puts shingles that few of left have first.  A shingle that most sets have, such as a licence line's, makes
    candidates only of sets that have little else.  Candidates are then counted exactly.  A lid of several rows is one set.
    """
    needed = lambda n: f"cast(ceil(round({threshold} * {n}, 6)) as int)"
    right = written(right.where("size(shingles) > 0").dropDuplicates(["rid"]).select("rid", F.size("shingles").alias("m"), F.col("shingles").alias("theirs")), "overlap-right")
    words = right.select(F.explode("theirs").alias("s")).distinct()
    # if right's shingles are few, left's meet them where they are, and only hits move
    words = F.broadcast(words) if (right.agg(F.sum("m")).first()[0] or 0) <= FEW else words
    hits = left.where("size(shingles) > 0").select("lid", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(words, "s")
    sets = written(hits.groupBy("lid", "n").agg(F.collect_set("s").alias("own")), "overlap-left")
    each = sets.select("lid", "n", F.explode("own").alias("s"))
    rarity = written(each.groupBy("s").agg(F.count("*").alias("df")), "rarity")
    ranks = F.broadcast(rarity) if rarity.count() <= FEW else rarity
    in_order = lambda keys, rows: rows.join(ranks, "s").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "s"))), lambda x: x["s"]).alias("ranked"))
    # shingles of one side alone stand before all others; they can be no candidate's
    first = lambda n: F.explode(F.expr(f"slice(ranked, 1, greatest(0, {n} - {needed(n)} + 1 - ({n} - size(ranked))))"))
    theirs = in_order(("rid", "m"), right.select("rid", "m", F.explode("theirs").alias("s")))
    by_right = theirs.select("rid", "m", first("m").alias("s")).join(each, "s").where("n >= m").select("lid", "rid")
    ours = in_order(("lid", "n"), each)
    by_left = ours.select("lid", "n", first("n").alias("s")).join(right.select("rid", "m", F.explode("theirs").alias("s")), "s").where("n < m").select("lid", "rid")
    counted = by_right.unionAll(by_left).distinct().join(sets, "lid").join(right, "rid")
    scored = counted.select("lid", "rid", (F.size(F.array_intersect("own", "theirs")) / F.least("n", "m")).alias("raw"))
    return scored.where(F.col("raw") >= threshold)


def equal_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lid, rid) of all pairs of left (k, lid) and right (k, rid) of one k, each once if a lid has but one k; nulls match nothing.

    Repeated rows go before the join, so that pairs are not shuffled; a k of very many pairs is dealt to as many tasks as they need.
    """
    left, right = (written(df.where("k is not null").distinct(), "equal-side") for df in (left, right))
    sizes = left.groupBy("k").agg(F.count("*").alias("n")).join(right.groupBy("k").agg(F.count("*").alias("m")), "k").where(f"n * m > {PAIRS}")
    hot = F.broadcast(written(sizes.select("k", F.expr(f"least(n, cast(ceil(n * m / {PAIRS}) as bigint))").alias("parts")), "hot-keys"))
    dealt = left.join(hot, "k", "left").select("k", "lid", F.pmod(F.xxhash64("lid"), F.coalesce("parts", F.lit(1))).alias("part"))
    copied = right.join(hot, "k", "left").select("k", "rid", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(copied, ["k", "part"]).select("lid", "rid")


#: Of overlaps within one set of texts: bits of a shingle's name, the share of names that all texts are indexed by, one of how many
#: texts is counted for frequent shingles, from which count there a shingle is one, and how many are known.
NAME_BITS, EARLY, COUNTED, OFTEN, MOST_OFTEN = 48, 0.25, 16, 4, 500_000
#: Ranges of names, one after another, in which the shingles of one text alone are counted; the first is that of EARLY.
RANGES = 4
#: Rare needs of texts that are broadcast; more of them are found by a shuffle.
FEW_LATE = 4_000_000
_LONGS = T.ArrayType(T.LongType())


def _parts(often, threshold: float):
    """Of a text's shingles: those it is indexed by, and those that it needs beyond them, of which a text that it overlaps must have one."""

    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, ranks = often.value
        for batch in batches:
            rows = []
            for shingles in batch:
                own = np.asarray(shingles, dtype=np.int64)
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                common = names[at] == own
                rare = own[~common]
                early = rare[: np.searchsorted(rare, int(EARLY * (1 << NAME_BITS)))]
                spare = len(own) - math.ceil(round(threshold * len(own), 6))  # so many may be missing
                others = np.concatenate([rare[len(early) :], own[common][np.argsort(ranks[at[common]], kind="stable")]])
                rows.append((early, others[: max(0, spare + 1 - len(early))], len(own), len(early) - spare))
            yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object if k < 2 else "int32") for k, c in enumerate(("early", "late", "n", "least"))})

    return F.pandas_udf(parts, T.StructType([T.StructField("early", _LONGS), T.StructField("late", _LONGS), T.StructField("n", T.IntegerType()), T.StructField("least", T.IntegerType())]))


def _among(wanted):
    def among(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = np.append(wanted.value, 1 << 62)
        for batch in batches:
            own = [np.asarray(s, dtype=np.int64) for s in batch]
            yield pd.Series([x[names[np.searchsorted(names, x)] == x] for x in own], dtype=object)

    return F.pandas_udf(among, _LONGS)


def named_sets(df: DataFrame, name: str) -> DataFrame:
    """df (key, text) as a table (key, shingles): the shingles' names in order, which Parquet then stores by their differences."""
    sets = with_shingles(df, F.col("text"), "s").where("size(s) > 0")
    names = F.sort_array(F.array_distinct(F.transform("s", lambda x: F.shiftrightunsigned(x, 64 - NAME_BITS))))
    return written(sets.select("key", names.alias("shingles")), name, **{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"})


def _alone(sets: DataFrame) -> DataFrame:
    """(key, range, alone): how many shingles of each range of names a set has that no other set has; none, no row.

    A range at a time, whose shuffle goes before the next one's comes.
    """
    width, parts = (1 << NAME_BITS) // RANGES, []
    for k in range(RANGES):
        inside = F.filter("shingles", lambda s: (s >= k * width) & (s < (k + 1) * width))  # noqa: B023
        held = sets.select("key", F.explode(inside).alias("s")).groupBy("s").agg(F.min("key").alias("key"), F.max("key").alias("_last"))
        part = held.where("key = _last").groupBy("key").agg(F.count("*").alias("alone"))
        parts.append(written(part.select("key", F.lit(k).alias("range"), "alone"), "alone", tidy=True))
    return reduce(DataFrame.unionAll, parts)


def overlaps_within(sets: DataFrame, threshold: float = THRESHOLD, last: bool = False) -> DataFrame:
    """(lid, rid, raw) of all pairs, in both orders, of different keys of named_sets() whose overlap coefficient is `threshold` or more.

    A set that is the smaller of a pair may miss so many of its shingles in the other and no more.  All sets are indexed by their
    rare shingles of the first quarter of names: a pair that shares fewer of these than the smaller has, less those that may be missing,
    is none.  A set that has too few of them to say so needs some others too, the least frequent ones, of which one must be shared;
    all sets are looked through for these few alone.  What is frequent is judged by a share of the texts, and decides only the order.
    Shingles that no other text has are counted too: a text with more of them than may be missing is never the smaller one, and what
    is left to be missing bounds the count.  Candidates that remain are then counted exactly.  Repeated rows of a key are one set.
    last: nothing reads sets after this, so that they are deleted when those of the candidates have been taken out.
    """
    spark = sets.sparkSession
    counted = sets.where(F.pmod(F.xxhash64("key"), F.lit(COUNTED)) == 0).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    often = counted.where(f"c >= {OFTEN}").orderBy(F.desc("c"), "s").limit(MOST_OFTEN).toPandas().sort_values("s")
    names, ranks = np.append(often["s"].to_numpy(np.int64), 1 << 62), np.append(often["c"].to_numpy(np.int64), 0)
    parts = sets.select("key", _parts(spark.sparkContext.broadcast((names, ranks)), threshold)("shingles").alias("p"))
    parts = written(parts.select("key", "p.*"), "parts", tidy=True, **{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"})
    one = lambda df: df.repartition("s").dropDuplicates(["s", "key"])
    halves = lambda df, *c: [df.select("s", *[F.col(x).alias(f"{x}_{y}") for x in c]) for y in "uv"]
    u, v = halves(one(parts.select("key", "n", "least", F.explode("early").alias("s"))), "key", "n", "least")
    shared = u.join(v, "s").where("key_u < key_v").groupBy("key_u", "key_v").agg(F.count("*").alias("c"), F.first(F.expr("if(n_u = n_v, least(least_u, least_v), if(n_u < n_v, least_u, least_v))")).alias("needed"))
    early = written(shared.where("c >= greatest(1, needed)").select("key_u", "key_v", "c"), "early-pairs", tidy=True)
    late = parts.where("size(late) > 0").select(F.col("key").alias("key_u"), F.col("n").alias("n_u"), F.explode("late").alias("s")).distinct()
    wanted = late.select("s").distinct()
    if wanted.count() <= FEW_LATE:
        held = spark.sparkContext.broadcast(np.sort(wanted.toPandas()["s"].to_numpy(np.int64)))
        having = sets.select("key", F.size("shingles").alias("n"), F.explode(_among(held)("shingles")).alias("s"))
    else:
        having = sets.select("key", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(wanted, "s", "left_semi")
    met = late.join(having.distinct().select("s", F.col("key").alias("key_v"), F.col("n").alias("n_v")), "s").where("key_u <> key_v and n_u <= n_v")
    met = met.select(F.least("key_u", "key_v").alias("key_u"), F.greatest("key_u", "key_v").alias("key_v"), F.lit(0).cast("long").alias("c"))
    pairs = early.unionAll(met).groupBy("key_u", "key_v").agg(F.max("c").alias("c"))
    # what no other text has is missing from all of them
    alone = _alone(sets).groupBy("key").agg(F.sum("alone").alias("alone"), F.sum(F.when(F.col("range") > 0, F.col("alone")).otherwise(0)).alias("beyond"))
    spare = F.col("n") - F.ceil(F.round(F.lit(threshold) * F.col("n"), 6))
    sizes = parts.select("key", "n", "least").distinct().join(alone, "key", "left").na.fill(0, ["alone", "beyond"])
    sizes = written(sizes.select("key", "n", (F.col("alone") <= spare).alias("may"), (F.col("least") + F.col("beyond")).alias("bound")), "sizes", tidy=True)
    pairs = pairs.join(sizes.toDF("key_u", "n_u", "may_u", "bound_u"), "key_u").join(sizes.toDF("key_v", "n_v", "may_v", "bound_v"), "key_v")
    # the smaller set moves to the larger one
    small = F.expr("n_u < n_v or n_u = n_v and key_u < key_v")
    pairs = pairs.where(F.when(small, F.expr("may_u and c >= bound_u")).otherwise(F.expr("may_v and c >= bound_v")))
    pairs = written(pairs.select(F.when(small, F.col("key_u")).otherwise(F.col("key_v")).alias("small"), F.when(small, F.col("key_v")).otherwise(F.col("key_u")).alias("large"), F.least("n_u", "n_v").alias("n")), "overlap-pairs", tidy=True)
    # all pairs are counted, in rounds that move half as many shingles as all sets have
    rounds = math.ceil(2 * (pairs.agg(F.sum("n")).first()[0] or 0) / (sizes.agg(F.sum("n")).first()[0] or 1)) or 1
    discard(parts, early, sizes)
    keys = written(pairs.select(F.explode(F.array("small", "large")).alias("key")).distinct(), "overlap-keys", tidy=True)
    few = F.broadcast(keys) if keys.count() <= FEW else keys
    named = written(sets.join(few, "key", "left_semi").dropDuplicates(["key"]), "overlap-sets", tidy=True, **{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"})
    discard(keys)
    if last:
        discard(sets)
    a, b = named.select(F.col("key").alias("small"), F.col("shingles").alias("a")), named.select(F.col("key").alias("large"), F.col("shingles").alias("b"))
    done = []
    for k in range(rounds):
        some = pairs.where(F.pmod(F.xxhash64("small", "large"), F.lit(rounds)) == k)
        scored = some.join(a, "small").join(b, "large").select("small", "large", (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("raw")).where(F.col("raw") >= threshold)
        done.append(written(scored, "overlaps-within", tidy=True))
    scored = reduce(DataFrame.unionAll, done)
    discard(pairs, named)
    return scored.select(F.col("small").alias("lid"), F.col("large").alias("rid"), "raw").unionAll(scored.select("large", "small", "raw"))


def training_findings(fingerprinted: DataFrame, protected: DataFrame, *, size: int = SHINGLE, least: int = LEAST_TOKENS, threshold: float = THRESHOLD, checkers: tuple[str, ...] = CHECKERS) -> DataFrame:
    """Exact prompt and solution matches, and high overlaps of pairs that do not match exactly; of `checkers` alone.

    Findings are about record_sha256, so copies of a record may be among the rows or not.
    """
    rows = fingerprinted.withColumnRenamed("record_sha256", "training_record_sha256")
    keys = ["training_record_sha256", "protected_dataset_id", "protected_record_id"]
    names = F.struct("protected_dataset_id", "protected_record_id")
    own_id = "input_index" if "input_index" in rows.columns else "training_record_sha256"
    hashes = protected.select(names.alias("rid"), prompt_sha256(F.col("prompt_messages")).alias("_prompt"), response_sha256(F.col("solution")).alias("_solution"))
    parts = []
    history = F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))
    sides = {
        "prompt": ("prompt_sha256", "_prompt", prompt_text(history), prompt_text(F.col("prompt_messages"))),
        "solution": ("response_sha256", "_solution", F.element_at("messages", -1)["content"], F.col("solution")),
    }
    if any(c.startswith("exact_") for c in checkers):
        narrow = written(rows.select("training_record_sha256", "prompt_sha256", "response_sha256").distinct(), "training-hashes")
    for kind, (own, theirs, text, guarded) in sides.items():
        if f"exact_{kind}" in checkers:
            exact = equal_pairs(narrow.select(F.col(own).alias("k"), F.col("training_record_sha256").alias("lid")), hashes.select(F.col(theirs).alias("k"), "rid"))
            parts.append(exact.select(F.lit(f"exact_{kind}").alias("checker_id"), "rid.protected_dataset_id", F.lit(f"exact_{kind}_match").alias("finding_type"),
                                      F.col("lid").alias("training_record_sha256"), "rid.protected_record_id", F.lit(1.0).alias("score")))
        if f"overlap_{kind}" in checkers:
            left = with_shingles(rows.select(F.col(own_id).alias("lid"), text.alias("t")), F.col("t"), "shingles", size, least)
            right = with_shingles(protected.select(names.alias("rid"), guarded.alias("t")), F.col("t"), "shingles", size, least)
            near = written(overlap_pairs(left.drop("t"), right.drop("t"), threshold), "overlaps")
            # only rows that overlap are hashed, and held against the exact matches
            ids = near.select("lid").distinct()
            ids = F.broadcast(ids) if near.count() <= FEW else ids
            named = rows.join(ids, rows[own_id] == ids["lid"], "left_semi").select(F.col(own_id).alias("lid"), "training_record_sha256", F.col(own).alias("_own"))
            named = named if own_id == "input_index" else named.distinct()
            found = near.join(named, "lid").join(hashes.select("rid", F.col(theirs).alias("_own")).distinct(), ["rid", "_own"], "left_anti")
            found = found.select("training_record_sha256", "rid.*", "raw").groupBy(*keys).agg(F.max("raw").alias("raw"))
            parts.append(found.select(F.lit("high_overlap").alias("checker_id"), "protected_dataset_id", F.lit(f"high_{kind}_overlap").alias("finding_type"),
                                      "training_record_sha256", "protected_record_id", F.bround("raw", 6).alias("score")))
    return reduce(DataFrame.unionByName, parts).select(*COLUMNS)


def status(findings: DataFrame | None) -> str:
    """not_run is never clean."""
    return "not_run" if findings is None else "clean" if findings.isEmpty() else "findings"


def component_collisions(components: DataFrame, references: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Components (component_id, text) against references (reference_id, text): the strongest match of each pair.

    exact text, then normalised text, then overlap.
    """
    hashed = lambda df, key: df.select(key, sha256(F.col("text")).alias("_exact"), sha256(normalize_text(F.col("text"))).alias("_normal"))
    left, right = hashed(components, "component_id"), hashed(references, "reference_id")
    keys = ["component_id", "reference_id"]
    # equal texts are equal when normalised: one join finds both
    equal = left.join(right, left["_normal"] == right["_normal"])
    ranked = [equal.select(*keys, F.when(left["_exact"] == right["_exact"], 0).otherwise(1).alias("rank"), F.lit(1.0).alias("score"))]
    sets = lambda df, key, name: with_shingles(df.select(F.col(key).alias(name), "text"), F.col("text"), "shingles").drop("text")
    overlap = overlap_pairs(sets(components, "component_id", "lid"), sets(references, "reference_id", "rid"), threshold)
    ranked.append(overlap.select(F.col("lid").alias("component_id"), F.col("rid").alias("reference_id"), F.lit(2).alias("rank"), F.bround("raw", 6).alias("score")))
    best = reduce(DataFrame.unionByName, ranked).groupBy(*keys).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    return best.select(*keys, F.element_at(F.array(F.lit("exact"), F.lit("normalized"), F.lit("overlap")), F.col("rank") + 1).alias("match"), "score")


def cross_partition_groups(entries: DataFrame) -> DataFrame:
    """(text_sha256, role, entries, least): texts, normalised, that entries of more than one role have, a row for each role.

    entries counts them and least is the smallest entry_id: a text of many copies is a few rows, not all its pairs.
    """
    groups = entries.select("entry_id", "role", sha256(normalize_text(F.col("text"))).alias("text_sha256")).groupBy("text_sha256", "role")
    sized = groups.agg(F.count("*").alias("entries"), F.min("entry_id").alias("least"))
    shared = sized.groupBy("text_sha256").agg(F.count("*").alias("n")).where("n > 1").select("text_sha256")
    return sized.join(shared, "text_sha256", "left_semi")


def cross_partition_collisions(entries: DataFrame) -> DataFrame:
    """(left_id, left_role, right_id, right_role, class_id, links): every entry whose text, normalised, other roles have, a row for each such role.

    class_id is the least entry_id of the text, right_id that of the other role, and links counts the entries of that role: all pairs of
    entries are told, each by its class, in as many rows as entries and roles.
    """
    each = F.struct(F.col("role").alias("right_role"), F.col("least").alias("right_id"), F.col("entries").alias("links"))
    texts = cross_partition_groups(entries).groupBy("text_sha256").agg(F.min("least").alias("class_id"), F.collect_list(each).alias("sides"))  # as many as roles
    named = entries.select(F.col("entry_id").alias("left_id"), F.col("role").alias("left_role"), sha256(normalize_text(F.col("text"))).alias("text_sha256"))
    linked = named.join(texts, "text_sha256").withColumn("side", F.explode("sides")).where("side.right_role <> left_role")
    return linked.select("left_id", "left_role", "side.right_id", "side.right_role", "class_id", "side.links")


def cross_partition_members(entries: DataFrame) -> DataFrame:
    """(entry_id, role, text_sha256, other_id): the entries of cross_partition_groups(), with the smallest entry_id of another role."""
    each = F.struct("role", "least")
    roles = cross_partition_groups(entries).groupBy("text_sha256").agg(F.collect_list(each).alias("roles"))  # as many as roles
    named = entries.select("entry_id", "role", sha256(normalize_text(F.col("text"))).alias("text_sha256")).join(roles, "text_sha256")
    return named.selectExpr("entry_id", "role", "text_sha256", "array_min(transform(filter(roles, r -> r.role <> role), r -> r.least)) as other_id")


def admission(entries: DataFrame, findings: DataFrame | None, key: str = "entry_id") -> DataFrame:
    """entries with admitted: only a check that ran and found nothing about an entry admits it."""
    if findings is None:
        return entries.withColumn("admitted", F.lit(False))
    named = findings.select(F.col(key)).distinct().withColumn("_found", F.lit(True))
    return entries.join(named, key, "left").withColumn("admitted", F.col("_found").isNull()).drop("_found")


#: Roles of environment entries, and of an author's demonstrations.
ROLES = ("training_curriculum", "calibration_diagnostic", "development_evaluation", "qualification_evaluation")
AUTHOR = "author_few_shot"
#: Which roles an entry of a role must share nothing with; demonstrations only with what is evaluated.
APART = {r: tuple(o for o in ROLES if o != r) + ((AUTHOR,) if r.endswith("evaluation") else ()) for r in ROLES}


def _apart(own: Column, other: Column) -> Column:
    rules = F.create_map(*[x for r, others in APART.items() for x in (F.lit(r), F.array(*[F.lit(o) for o in others]))])
    return F.coalesce(F.array_contains(F.try_element_at(rules, own), other), F.lit(False))


def _sides(entries: DataFrame, key: str) -> DataFrame:
    """(key, sides): for each key, its roles and the least entry_id of each: as many as there are roles, however many entries."""
    least = entries.where(F.col(key).isNotNull()).groupBy(key, "role").agg(F.min("entry_id").alias("least"))
    return least.groupBy(key).agg(F.collect_list(F.struct("role", "least")).alias("sides"))


def _least_apart(sides: str) -> Column:
    """The least entry_id of a role from which the row's role must be apart; null if there is none."""
    return F.array_min(F.transform(F.filter(sides, lambda s: _apart(F.col("role"), s["role"])), lambda s: s["least"]))


def environment_findings(components: DataFrame, protected: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Findings (checker_id, finding_type, entry_id, component_id, other_id, score) about environment entries.

    components: entry_id, kind (candidate, partition or author), role, task_id, environment_id, component_id, text; a row for each
    text of an entry.  protected: benchmark_id, record_id, component_id, text.

    Against protected examples: an equal task id, and texts by their strongest match (exact, normalised, overlap).
    Between roles that must be apart (APART): equal task ids, one environment in several roles or twice in one, and texts: of
    equal texts each entry names the least entry_id of a role it must be apart from, so a text of many copies is as many rows,
    not all their pairs; of overlaps, that of each other text.  A role outside ROLES is a finding of its own.
    """
    texts = components.select("entry_id", "kind", "role", "component_id", "text").withColumns({"_exact": sha256(F.col("text")), "_normal": sha256(normalize_text(F.col("text")))})
    owners = components.select("entry_id", "kind", "role", "task_id", "environment_id").distinct()
    none = F.lit(None).cast("string")
    by_kind = lambda usual: F.when(F.col("kind") == "author", "author-few-shot").when(F.col("kind") == "partition", "partition-overlap").otherwise(usual)

    def rows(df: DataFrame, checker: Column, kind: Column, component: Column = none, score: Column | None = None) -> DataFrame:
        score = F.lit(None) if score is None else score
        return df.select(checker.alias("checker_id"), kind.alias("finding_type"), "entry_id", component.alias("component_id"), F.col("other_id").cast("string").alias("other_id"), score.cast("double").alias("score"))

    held = lambda *c: F.concat_ws("/", *c)
    named = owners.join(protected.select(F.col("record_id").alias("task_id"), held("benchmark_id", "record_id").alias("other_id")).distinct(), "task_id")
    out = [rows(named, by_kind(F.lit("exact-task-id")), F.lit("exact-task-id"))]
    # a text's shingles are made once, for protected examples and for one another; its name there is 8 bytes
    texts = texts.withColumn("_class", F.xxhash64("_normal"))
    sets = named_sets(components.where("text is not null").select(F.xxhash64(sha256(normalize_text(F.col("text")))).alias("key"), "text"), "text-sets")
    guard = protected.select(held("benchmark_id", "record_id", "component_id").alias("other_id"), "text", sha256(F.col("text")).alias("_exact"), sha256(normalize_text(F.col("text"))).alias("_normal"))
    same = texts.join(guard.select("other_id", F.col("_exact").alias("_theirs"), "_normal").distinct(), "_normal")
    same = same.select("entry_id", "kind", "component_id", "other_id", F.when(F.col("_exact") == F.col("_theirs"), 0).otherwise(1).alias("rank"), F.lit(1.0).alias("score"))
    theirs = named_sets(guard.select(F.col("other_id").alias("key"), "text"), "guard-sets").select(F.col("key").alias("rid"), "shingles")
    over = overlap_pairs(sets.withColumnRenamed("key", "lid"), theirs, threshold).select(F.col("lid").alias("_class"), F.col("rid").alias("other_id"), F.lit(2).alias("rank"), F.bround("raw", 6).alias("score"))
    subject = ["entry_id", "kind", "component_id", "other_id"]
    hits = same.unionByName(texts.join(over, "_class").select(*subject, "rank", "score")).groupBy(*subject).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    hits = hits.withColumn("type", F.element_at(F.array(F.lit("exact-content"), F.lit("normalized-content"), F.lit("text-overlap")), F.col("rank") + 1))
    out.append(rows(hits, by_kind(F.col("type")), F.col("type"), F.col("component_id"), F.col("score")))

    checker = F.lit("partition-overlap")
    same_task = owners.join(_sides(owners, "task_id"), "task_id").withColumn("other_id", _least_apart("sides")).where("other_id is not null")
    out.append(rows(same_task, checker, F.lit("exact-task-id")))
    placed_ = owners.where(F.col("kind") != "author")
    roles = placed_.groupBy("environment_id", "role").agg(F.min("entry_id").alias("low"), F.max("entry_id").alias("high"))
    several = placed_.join(_sides(placed_, "environment_id"), "environment_id").withColumn("other_id", _least_apart("sides")).where("other_id is not null")
    out.append(rows(several, checker, F.lit("environment-role-conflict")))
    twice = placed_.join(roles.where("low < high"), ["environment_id", "role"]).withColumn("other_id", F.when(F.col("entry_id") == F.col("low"), F.col("high")).otherwise(F.col("low")))
    out.append(rows(twice, checker, F.lit("environment-task-conflict")))

    one, score = F.lit(1.0), F.col("score")
    equal = texts.join(_sides(texts, "_exact").withColumnRenamed("sides", "_of_exact"), "_exact").join(_sides(texts, "_normal").withColumnRenamed("sides", "_of_normal"), "_normal")
    equal = equal.withColumns({"_very": _least_apart("_of_exact"), "_alike": _least_apart("_of_normal")}).where("_alike is not null").withColumn("other_id", F.coalesce("_very", "_alike"))
    out.append(rows(equal, checker, F.when(F.col("_very").isNotNull(), "exact-content").otherwise("normalized-content"), F.col("component_id"), one))
    # overlaps are found between texts, each once, and then told to the entries that have them
    sides = written(_sides(texts, "_class"), "sides")
    near = overlaps_within(sets, threshold, last=True)
    apart = near.join(sides.withColumnRenamed("_class", "rid"), "rid").select(F.col("lid").alias("_class"), "sides", F.bround("raw", 6).alias("score"))
    told = texts.join(apart, "_class").withColumn("other_id", _least_apart("sides")).where("other_id is not null")
    out.append(rows(told, checker, F.lit("text-overlap"), F.col("component_id"), score))
    odd = owners.where((F.col("kind") != "author") & ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).withColumn("other_id", none)
    out.append(rows(odd, checker, F.lit("unknown-role")))
    return reduce(DataFrame.unionByName, out).distinct()


#: The total order of findings in a report; nulls come first.
ORDER = ("checker_id", "finding_type", "entry_id", "component_id", "other_id", "score")


def in_order(findings: DataFrame) -> DataFrame:
    """findings with `place`, from 0 in the total order of a report."""
    return placed(findings, "place", *[F.col(c).asc_nulls_first() for c in ORDER])
