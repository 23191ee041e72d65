"""Uniform random shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first: the matrix whose row sums are
the partitions' counts and whose column sums are the shard sizes, with the law that a uniform permutation of
all rows would give it (multivariate hypergeometric).  Partitions are halved down a binary tree; each
node splits its shard capacities between its halves.  Then every partition permutes its rows locally and deals
them out by its row of the matrix, and every shard permutes what it got.

Everything is DataFrame and SQL: the draws are inverse transforms over hashes of the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
SEED = 20260
#: Rows that one task orders when a shard is permuted; larger shards are cut by their random key.
RUN = 1 << 16
#: Tree levels after which nodes are spread over tasks.
SPREAD = 5

#: One hypergeometric draw: x of the drawn rows fall into `good` of `pop` places, for a uniform u in [0, 1).
#: Weights are walked from the mode, up then down, 12 standard deviations either way (beyond: under 1e-30).
_UP = "(1D * (good - x) * (drawn - x)) / ((x + 1D) * (pop - good - drawn + x + 1D))"
_DOWN = "(1D * x * (pop - good - drawn + x)) / ((good - x + 1D) * (drawn - x + 1D))"


def _let(bindings: dict[str, str], body: str) -> str:
    """SQL for body with each name bound to its value, later values seeing earlier names."""
    for name, value in reversed(bindings.items()):
        body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return body


def _walk(first: str, last: str, ratio: str, start: str, target: str) -> str:
    """Sum of the weights from first to last and the first x at which their sum passes target (or null)."""
    return (
        f"aggregate(sequence({first}, {last}), named_struct('p', {start}, 's', 0D, 'at', cast(null as bigint)), "
        f"(a, x) -> named_struct('p', a.p * {ratio}, 's', a.s + a.p, 'at', coalesce(a.at, if(a.s + a.p > {target}, x, null))))"
    )


def _draw(pop: str, good: str, drawn: str, u: str) -> str:
    inner = _let(
        {
            "lo": "greatest(0L, drawn - (pop - good))",
            "hi": "least(drawn, good)",
            "m": "least(hi, greatest(lo, cast(floor((drawn + 1D) * (good + 1D) / (pop + 2D)) as bigint)))",
            "w": "cast(12 * sqrt(drawn * (good / cast(pop as double)) * ((pop - good) / cast(pop as double)) * (pop - drawn) / greatest(pop - 1D, 1D)) + 12 as bigint)",
            "up": _walk("m", "least(hi, m + w)", _UP, "1D", "1e300") + ".s",
            "below": f"if(m > lo, {_walk('m - 1', 'greatest(lo, m - 1 - w)', _DOWN, '1D * m * (pop - good - drawn + m) / ((good - m + 1D) * (drawn - m + 1D))', '1e300')}.s, 0D)",
            "t": f"({u}) * (up + below)",
        },
        f"if(t < up, coalesce({_walk('m', 'least(hi, m + w)', _UP, '1D', 't')}.at, m), "
        f"coalesce({_walk('m - 1', 'greatest(lo, m - 1 - w)', _DOWN, '1D * m * (pop - good - drawn + m) / ((good - m + 1D) * (drawn - m + 1D))', '(t - up)')}.at, m))",
    )
    return f"if({drawn} = 0 or {good} = 0, 0L, if({good} = {pop}, {drawn}, " + _let({"pop": pop, "good": good, "drawn": drawn}, inner) + "))"


def _split(seed: int) -> Column:
    """What the left half of a node takes of each capacity: `caps` array, `taken` rows, `lo`, `hi` name the node."""
    u = f"shiftrightunsigned(xxhash64({seed}, lo_, hi_, s_), 11) / 9007199254740992D"
    step = _draw("acc_.rest", "caps[s_]", "acc_.rows", u)
    return F.expr(
        "aggregate(sequence(0, size(caps) - 1), "
        "named_struct('rest', aggregate(caps, 0L, (a_, c_) -> a_ + c_), 'rows', taken, 'out', cast(array() as array<bigint>)), "
        f"(acc_, s_) -> element_at(transform(array({step}), x_ -> named_struct('rest', acc_.rest - caps[s_], 'rows', acc_.rows - x_, "
        "'out', concat(acc_.out, array(x_)))), 1)).out"
    )


def communication_matrix(counts: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(block, caps): how many rows of each block (block, n) go to each shard; the sizes are at most one apart.

    One small row for each input partition is all that is handled here.  No blocks: no rows.
    """
    root = counts.agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("leaves")).where("size(leaves) > 0")
    total = "aggregate(leaves, 0L, (a, x) -> a + x.n)"
    size = f"{total} div {shards} + if(s < {total} % {shards}, 1, 0)"
    nodes = root.select("leaves", F.expr(f"transform(sequence(0, {shards} - 1), s -> {size})").alias("caps"))
    blocks, depth = counts.count(), 0
    while 1 << depth < blocks:
        halves = (
            nodes.withColumn("half", F.expr("size(leaves) - size(leaves) div 2"))
            .withColumn("taken", F.expr("aggregate(slice(leaves, 1, half), 0L, (a, x) -> a + x.n)"))
            .withColumn("lo_", F.expr("leaves[0].block"))
            .withColumn("hi_", F.expr("leaves[size(leaves) - 1].block"))
            .withColumn("left", F.when(F.size("leaves") > 1, _split(seed)).otherwise(F.col("caps")))
        )
        nodes = halves.select(
            F.explode(
                F.expr(
                    "if(size(leaves) = 1, array(named_struct('leaves', leaves, 'caps', caps)), "
                    "array(named_struct('leaves', slice(leaves, 1, half), 'caps', left), "
                    "named_struct('leaves', slice(leaves, half + 1, size(leaves)), 'caps', transform(caps, (c, i) -> c - left[i]))))"
                )
            ).alias("node")
        ).select("node.leaves", "node.caps")
        depth += 1
        if depth == SPREAD:
            nodes = nodes.repartition(F.expr("leaves[0].block"))
    return nodes.select(F.expr("leaves[0].block").alias("block"), "caps")


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the carried columns of every row, uniformly shuffled.

    size: UTF-8 bytes of the text plus 16, a null text having none.  Shard counts differ by at most one;
    slots run from 0 without gaps.  Only the bytes of a text, of any length, are counted and hashed; it does not move unless it is
    carried.  Rows of equal random keys are told apart by their running number.  Each row is dealt for itself: repeated rows and null ids too.
    Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)],
        F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = materialize(rows, "shard-rows")  # from here on a row's block and rid are fixed
    counts = rows.groupBy("block").agg(F.count("*").alias("n"))
    matrix = communication_matrix(counts, shards, seed)
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "rid"), "rid")
    placed = rows.withColumn("at", F.row_number().over(local) - 1).join(matrix, "block")
    # the shard is the number of shards whose cumulated counts the position has passed
    dealt = placed.withColumn(
        "shard",
        F.expr("aggregate(caps, named_struct('sum', 0L, 'passed', 0), (a, c) -> named_struct('sum', a.sum + c, 'passed', a.passed + if(at >= a.sum + c, 1, 0))).passed"),
    ).drop("caps", "at", "block")
    key = F.xxhash64(F.lit(seed + 2), "rid")
    runs = counts.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(shards * RUN))).alias("runs")).first()["runs"] or 1
    dealt = dealt.withColumn("key", key).withColumn("run", F.floor(F.shiftrightunsigned("key", 11) / F.lit(2.0**53) * F.lit(int(runs))).cast("long"))
    sizes = dealt.groupBy("shard", "run").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy(F.shiftrightunsigned("key", 11), "rid")
    slotted = dealt.withColumn("place", F.row_number().over(within) - 1).join(starts, ["shard", "run"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("place")).cast("long").alias("slot"),
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
    )
