"""Prefix trie of conversations as a z-fast trie.

A conversation is a string of turns.  Prefixes are known by 128-bit hashes that add up turn by turn (exclusive or of
hashes of place and turn), so the hash of any prefix is at hand.  The trie is a table of compacted nodes: the places where
conversations part or end.  A node lies at the end of an edge from its parent's depth `pd` to its own depth `e`, and is
found by its handle, the prefix whose length is the number in (pd, e] that the most powers of two divide.

Conversations are inserted in batches.  Each finds the deepest node on its path by fat binary search, which asks
for one handle in each round and takes as many rounds as its length has bits; then its exit edge by the prefix one turn longer,
and on it the last turn it shares.  Only turns beyond that are looked at for new nodes.  In the end edges are expanded:
every prefix is a row, with sums over the subtree below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, frame, materialize

#: Shares of the conversations that have been inserted after each batch, in sixteenths.
BATCHES = (1, 4, 16)
#: Nodes that are broadcast at most (counted), about 100 bytes each; more are shuffled to the conversations that ask.
FEW = 250_000
#: Width of a block of conv_ids: as many ids are joined in one row at most.
BLOCK = 1024
_ROOT = "named_struct('a', 0L, 'b', 0L)"


def fattest(low: str, high: str) -> str:
    """SQL for the number in (low, high] that the most powers of two divide; low < high."""
    # high without its bits below the highest one in which they differ
    return f"({high} & -(shiftleft(1, length(bin({low} ^ {high})) - 1)))"


def turn_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation, its turns in order as structs (known, turn, x, y, n).

    x, y: hashes of role and text, null as empty; n: code points of the text.  Null turns come first; turns of one
    number are ordered by their hashes, so repeated rows are turns that follow one another.  Rows without a conv_id belong to no
    conversation.  A conversation is a row of 32 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(1729), text, role).alias("y"), F.char_length(text).cast("long").alias("n"),
        ).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def with_common_heads(own: DataFrame, every: int = 100, spread: int = 6) -> DataFrame:
    """Each conversation with its first h turns replaced by those of conversation c - c % every; h = crc32(decimal c) % spread.

    Of a shorter one all are taken, of an absent one none; own turns after the first h follow.
    """
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, spread).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.filter("turns", lambda t: F.lit(False)))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, len, p, n): p[d] is the hash of the first d + 1 turns, n[d] the code points of their texts."""
    turns = conversations.select("conv_id", F.posexplode_outer("turns").alias("d", "t"))
    mark = lambda *c: F.bit_xor(F.xxhash64(F.lit(c[0]), "d", *c[1:]))
    path = Window.partitionBy("conv_id").orderBy("d")
    known = turns.where("d is not null").select("conv_id", "d", mark(1, "t.x", "t.y").over(path).alias("a"), mark(2, "t.y", "t.x").over(path).alias("b"), F.sum("t.n").over(path).alias("n"))
    empty = turns.where("d is null").select("conv_id", F.lit(None).cast("int").alias("d"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    places = F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "a", "b", "n"))))
    rows = known.unionAll(empty).groupBy("conv_id").agg(places.alias("s"))
    return rows.select("conv_id", F.size("s").alias("len"), F.expr("transform(s, x -> struct(x.a as a, x.b as b))").alias("p"), F.expr("transform(s, x -> x.n)").alias("n"))


def _at(p: str, d: str) -> Column:
    """The prefix of length d >= 0 of a path p; null beyond its end."""
    return F.expr(f"if({d} = 0, {_ROOT}, get({p}, {d} - 1))")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


class ZFastTrie:
    """Compacted nodes (p, e, pd, up, name, handle, rep) below the root, of the conversations inserted so far.

    p, up: prefixes at the ends of a node's edge; name: the prefix one turn into the edge; rep: a conversation through the node.
    Conversations (conv_id, len, p) must all be in `paths`, from which edges are read.
    """

    def __init__(self, paths: DataFrame):
        self.paths = paths
        self.nodes: DataFrame | None = None
        self.size = 0

    def locate(self, batch: DataFrame) -> DataFrame:
        """batch with x, the turns it shares with the trie, and its exit node (ep, ee, epd, erep), null where x is a node's own place."""
        if self.nodes is None:
            return batch.selectExpr("*", "0 as x", "cast(null as struct<a: bigint, b: bigint>) as ep", "cast(null as int) as ee", "cast(null as int) as epd", "cast(null as bigint) as erep")
        handles = _small(self.nodes.select("handle", F.col("e").alias("_e"), F.col("p").alias("_p"), F.col("pd").alias("_pd")), self.size)
        rows = batch.selectExpr("*", "0 as lo", "len as hi")
        for _ in range((batch.agg(F.max("len")).first()[0] or 0).bit_length()):
            asked = rows.withColumn("f", F.expr(f"if(lo < hi, {fattest('lo', 'hi')}, null)")).withColumn("_ask", F.when(F.col("f").isNotNull(), _at("p", "f")))
            met = asked.join(handles, F.col("_ask") == F.col("handle"), "left").withColumn("_on", F.col("_p") == _at("p", "_e"))
            # on the whole edge: its node is passed; on a part of it: the parent is the deepest; else no node is so deep
            low = F.when(F.col("_on"), F.col("_e")).when(F.col("_e").isNotNull(), F.greatest("lo", "_pd")).otherwise(F.col("lo"))
            high = F.when(F.col("_on") | F.col("f").isNull(), F.col("hi")).when(F.col("_e").isNotNull(), low).otherwise(F.col("f") - 1)
            rows = met.select(*batch.columns, low.alias("lo"), high.alias("hi"))
        names = _small(self.nodes.select("name", F.col("p").alias("ep"), F.col("e").alias("ee"), F.col("pd").alias("epd"), F.col("rep").alias("erep")), self.size)
        out = rows.withColumn("_next", F.when(F.col("lo") < F.col("len"), _at("p", "lo + 1"))).join(names, F.col("_next") == F.col("name"), "left")
        edges = self.paths.select(F.col("conv_id").alias("erep"), F.col("p").alias("_edge"))
        along = out.join(edges, "erep", "left")
        shared = "aggregate(sequence(lo + 1, least(len, ee)), lo, (x, d) -> if(x = d - 1 and get(p, d - 1) = get(_edge, d - 1), d, x))"
        return along.select(*batch.columns, F.expr(f"if(ee is null, lo, {shared})").alias("x"), "ep", "ee", "epd", "erep")

    def insert(self, batch: DataFrame) -> None:
        """Add conversations, no two of which are alike."""
        found = materialize(self.locate(batch), "located")
        own = found.where("len > x").select("conv_id", "x", "len", "p", F.explode(F.expr("sequence(x + 1, len)")).alias("d"))
        own = own.select("conv_id", "x", "d", _at("p", "d").alias("at"), _at("p", "d - 1").alias("before"), (F.col("d") == F.col("len")).alias("ends"))
        places = own.groupBy("at").agg(F.first("before").alias("before"), F.max("ends").alias("ends"))
        forks = places.groupBy(F.col("before").alias("at")).agg(F.count("*").alias("ways")).where("ways > 1")
        stops = materialize(places.where("ends").select("at").unionAll(forks.select("at")).distinct(), "stops")
        # the node before each on a conversation's path; what the trie has of the path ends at x, a node from now on
        path = Window.partitionBy("conv_id").orderBy("d")
        reached = own.join(stops, "at", "left_semi").withColumn("pd", F.coalesce(F.lag("d").over(path), F.col("x")))
        new = reached.groupBy("at").agg(F.first("d").alias("e"), F.first("pd").alias("pd"), F.min("conv_id").alias("rep"))
        new = new.select(F.col("at").alias("p"), "e", "pd", "rep")
        cut = found.where("ee is not null and x < ee").groupBy("ep", "ee", "epd", "erep", "x").agg(F.first(_at("p", "x")).alias("p"))
        edge = Window.partitionBy("ep").orderBy("x")
        cut = cut.withColumn("pd", F.coalesce(F.lag("x").over(edge), F.col("epd")))
        upper = cut.select("p", F.col("x").alias("e"), "pd", F.col("erep").alias("rep"))
        lower = cut.groupBy(F.col("ep").alias("p")).agg(F.first("ee").alias("e"), F.max("x").alias("pd"), F.first("erep").alias("rep"))
        changed = reduce(DataFrame.unionByName, [new, upper, lower]).join(self.paths.select(F.col("conv_id").alias("rep"), F.col("p").alias("_path")), "rep")
        changed = changed.select("p", "e", "pd", _at("_path", "pd").alias("up"), _at("_path", "pd + 1").alias("name"), _at("_path", fattest("pd", "e")).alias("handle"), "rep")
        kept = [] if self.nodes is None else [self.nodes.join(lower, "p", "left_anti")]
        nodes = materialize(reduce(DataFrame.unionByName, [*kept, changed]), "trie")
        for old in (found, stops, self.nodes):
            discard(old)
        self.nodes, self.size = nodes, nodes.count()


def end_digests(ends: DataFrame) -> DataFrame:
    """(p, ends_sha256) of conversations (conv_id, p) that end at a place: hash of their decimal ids, ascending, comma-joined.

    Ids are joined in blocks of BLOCK, then a place's blocks are hashed in order as they stream by, none being kept.
    """
    blocks = ends.groupBy("p", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, state = None, None
        for pdf in batches:
            done = []
            for a, b, ids in zip(pdf["a"], pdf["b"], pdf["ids"], strict=True):
                if (a, b) != place:
                    done += [(*place, state.hexdigest())] if place else []
                    place, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield frame(done, ["a", "b", "ends_sha256"])
        if place:
            yield frame([(*place, state.hexdigest())], ["a", "b", "ends_sha256"])

    ordered = blocks.select("p.a", "p.b", "block", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "block")
    return ordered.select("a", "b", "ids").mapInPandas(digest, "a long, b long, ends_sha256 string").select(F.struct("a", "b").alias("p"), "ends_sha256")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """A row for each prefix of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turnless conversations are members of the root.  Null roles and texts are empty; null turns come first; see
    turn_hashes() for ties and repeated rows.  Texts of any length are read whole.  No conversations: no rows.
    """
    all_paths = materialize(prefixes(with_common_heads(turn_hashes(conversations))), "paths")
    ends = all_paths.select("conv_id", "len", _at("p", "len").alias("p"))
    # conversations that are alike are one; the smallest id stands for them
    distinct = materialize(ends.where("len > 0").groupBy("p").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")), "distinct")
    paths = materialize(all_paths.join(distinct.select("conv_id", "copies"), "conv_id"), "strings")
    trie = ZFastTrie(paths.select("conv_id", "p"))
    draw, before = F.pmod(F.xxhash64("conv_id"), F.lit(BATCHES[-1])), 0
    for upto in BATCHES:
        trie.insert(paths.where((draw >= before) & (draw < upto)).select("conv_id", "len", "p"))
        before = upto
    nodes = trie.nodes

    # each conversation's nodes, from the root's child to its own end
    steps = paths.select("conv_id", "copies", "len", F.posexplode("p").alias("d", "p")).withColumn("d", F.col("d") + 1)
    stops = steps.join(_small(nodes.select("p", "pd"), trie.size), "p")
    kids = nodes.groupBy(F.col("up").alias("p")).agg(F.count("*").alias("kids"))
    sized = stops.groupBy("p").agg(F.sum("copies").alias("n_convs"), F.min("conv_id").alias("least")).join(kids, "p", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    sized = materialize(sized, "sized")
    # what the edges from a node down save is given to all nodes above it, once, by the smallest conversation through it
    told = stops.join(_small(sized, trie.size), "p").join(paths.select("conv_id", F.col("n").alias("_n")), "conv_id")
    edge = "get(_n, d - 1) - if(pd = 0, 0L, get(_n, pd - 1))"
    told = told.withColumn("own", F.when(F.col("least") == F.col("conv_id"), F.expr(f"(n_convs - 1) * ({edge})")).otherwise(0))
    told = told.withColumn("leaf", F.when((F.col("kids") == 0) & (F.col("d") == F.col("len")), 1).otherwise(0))
    below = Window.partitionBy("conv_id").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    told = told.select("p", "own", F.coalesce(F.sum("own").over(below), F.lit(0)).alias("below"), (F.coalesce(F.sum("leaf").over(below), F.lit(0)) + F.col("leaf")).alias("leaf"))
    summed = materialize(told.groupBy("p").agg(F.sum("own").alias("own"), F.sum("below").alias("below"), F.sum("leaf").alias("n_leaves")).join(sized, "p").join(nodes, "p"), "summed")

    parents = summed.select(F.col("p").alias("up"), F.col("least").alias("_above"))
    top = ends.agg(F.min("conv_id").alias("_top"), F.count("*").alias("_all")).where("_all > 0")  # one row
    edges = summed.join(paths.select(F.col("conv_id").alias("rep"), F.col("n").alias("_n"), F.col("p").alias("_path")), "rep")
    edges = edges.join(_small(parents, trie.size), "up", "left").join(F.broadcast(top))
    rows = edges.select("*", F.explode(F.expr("sequence(pd + 1, e)")).alias("depth"))
    last = F.col("depth") == F.col("e")
    saved = F.expr("below + (n_convs - 1) * (get(_n, e - 1) - if(depth = 1, 0L, get(_n, depth - 2)))")
    inner = rows.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("pd") + 1, F.col("least")).otherwise(F.coalesce("_above", "_top")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("kids")).otherwise(1).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(last, F.col("p")).alias("p"),
    )
    whole = summed.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("saved"), F.count_if(F.col("kids") == 0).alias("leaves"), F.count_if(F.col("pd") == 0).alias("ways"))
    root = top.join(F.broadcast(whole)).select(
        F.col("_top").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("_all").alias("n_convs"), F.col("ways").alias("n_children"),
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.expr(_ROOT).alias("p"),
    )
    out = inner.unionByName(root).join(end_digests(ends), "p", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
