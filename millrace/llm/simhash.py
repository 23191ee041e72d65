"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the perfect Hamming code of length 63 has covering radius
1.  Two fingerprints that differ in at most 2 bits have a point within 1 bit of both, and that point an
anchor within 1; so both lie within 2 = radius + half the threshold of one anchor.  A fingerprint is
copied to its 32 anchors at that distance (1 if it is an anchor itself), and fingerprints are compared
within an anchor only.  (Radius plus the whole threshold, 3, would reach 652 anchors and find no more.)
Bit 63 lies outside the code; it counts in comparisons only.

A ball of radius 2 holds at most 2 * 2017 fingerprints, so that no anchor's group grows with the input:
equal fingerprints are one row before they are copied.

The pipeline's stage (one_of_each) links texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
Its first candidates are those of the method above, over the fingerprints of these shingles, and an exact check follows.
Two texts at 0.8 differ in about 10 of 64 bits, more than anchors can cover; what they leave apart MinHash bands find, missing a
pair at 0.8 with probability (1 - 0.8 ** BAND_ROWS) ** BANDS, 3e-5, and 4e-8 at 0.85; every candidate is verified.
Bands are long, so that texts that only share a passage, a quarter of their shingles, are no candidates
(3e-4 of such pairs are): a passage in a third of all texts would otherwise make pairs by the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, discard, fresh, keyed, materialize, text_key

THRESHOLD = 2
SHINGLE = 3
#: Of the stage: words in a shingle, and bands and MinHashes in each.
WORDS = 5
BANDS, BAND_ROWS = 56, 8
#: Of the stage: bits by which pairs that differ too much are left out before they become rows, and rounds of centres of bands.
BITS, ROUNDS = 1024, 5
#: Shingles before one on which two sets meet, by which most of their further meetings are known as such.
BEFORE = 4
#: Texts that are found by a broadcast of their keys; more of them are found by a shuffle.
FEW = 200_000
_SLICE = 1 << 15
_FACTORS = np.random.default_rng(8).integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; 0 if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([_hash(b" ".join(words))], dtype=np.uint64)
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(_hash, runs), dtype=np.uint64, count=len(words) - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: the bits that more than half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = np.ascontiguousarray(hashes[at : at + _SLICE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def _parity(x: Column, mask: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(mask))) % 2


def _syndrome(x: Column) -> Column:
    """0 for an anchor, else the position (1 to 63) whose flip gives the nearest anchor."""
    masks = [sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1) for k in range(6)]
    out = _parity(x, masks[0])
    for k in range(1, 6):
        out = out + _parity(x, masks[k]) * (1 << k)
    return out


def _copies(fps: DataFrame) -> DataFrame:
    """(fp, anchor): each fingerprint with the anchors within 2 bits of its lower 63 bits.

    With syndrome s, flipping the two positions i and i ^ s leads to an anchor (position 0 flips nothing);
    for s = 0 the fingerprint is the only anchor so near.
    """
    low = F.col("fp").bitwiseAND(F.lit((1 << 63) - 1))
    flip = "(case when {0} = 0 then 0L else shiftleft(1L, {0} - 1) end)"
    near = F.expr(
        "transform(filter(sequence(0, 63), i -> i < (i ^ s) or (s = 0 and i = 0)), "
        f"i -> low ^ {flip.format('i')} ^ {flip.format('(i ^ s)')})"
    )
    return fps.select("fp", low.alias("low")).select("fp", "low", _syndrome(F.col("low")).cast("int").alias("s")).select("fp", F.explode(near).alias("anchor"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])))
def _forest(groups: pd.Series) -> pd.Series:
    """Links that join what is linked within an anchor's group: a spanning forest, not all pairs."""
    out = []
    for group in groups:
        fps = np.asarray(group, dtype=np.int64).view(np.uint64)
        left = np.arange(len(fps))
        links = []
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                i = front.pop()
                near = np.bitwise_count(fps[left] ^ fps[i]) <= THRESHOLD
                found = left[near]
                links += [(int(fps[i].view(np.int64)), int(fps[j].view(np.int64))) for j in found]
                front += found.tolist()
                left = left[~near]
        out.append([{"u": u, "v": v} for u, v in links])
    return pd.Series(out)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column fp, distinct) at THRESHOLD or fewer bits."""
    groups = _copies(fps).groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.explode(_forest("fps")).alias("link")).select("link.u", "link.v").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, fp, part, component_id for every row; part: the component's smallest fingerprint, as its name.

    component_id is the smallest doc_id reachable over links of 2 or fewer differing bits, the
    document's own included; null where all of them are null.  Texts without words have fingerprint 0 and
    link like any other.  An empty table gives an empty result.  Texts of any length are read whole; repeated rows each
    have a row; of equal ids nothing is chosen, so there are no ties.
    """
    rows = keyed(docs)
    rows = materialize(rows.select("doc_id", "tkey", _fingerprints("text").alias("fp")), "fingerprints")
    each = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fp")
    parts = connected_components(fingerprint_links(each.select("fp")))
    named = each.join(parts, each["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    named = materialize(named, "parts")
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "part").select(F.col("fp").alias("_fp"), "part", "component_id")
    return rows.join(ids, rows["fp"] == ids["_fp"]).select("doc_id", "tkey", "fp", "part", "component_id")


# --- near-duplicates by shared words -------------------------------------------------------------------------


def word_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text; a shorter one is one shingle of all its words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(min(WORDS, len(words)))), strict=False))
    return np.unique(np.fromiter(map(_hash, runs), dtype=np.uint64, count=max(1, len(words) - WORDS + 1)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each of BANDS bands of BAND_ROWS MinHashes of a set; none of an empty one."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least, high = np.full(len(_FACTORS), ~np.uint32(0)), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(least, (_FACTORS[:, None] * high[None, at : at + 1024]).min(axis=1), out=least)
    bands = least.reshape(BANDS, -1)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=b) for b, row in enumerate(bands)], dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """BITS bits, as longs: for each of as many classes of hashes, whether the set has an odd number of them.

    Two sets differ in at least as many elements as their bits differ.
    """
    odd = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_LONGS = T.ArrayType(T.LongType())
_SKETCH = T.StructType(
    [T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bands", _LONGS), T.StructField("bits", _LONGS)]
)


@F.pandas_udf(_SKETCH)
def _sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            words = word_set(text)
            rows.append((xxhash.xxh3_64_intdigest(words.tobytes()), len(words), majority(words), band_keys(words), parities(words)))
        ids = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
        lists = {name: pd.Series([r[k] for r in rows], dtype=object) for k, name in ((3, "bands"), (4, "bits"))}
        yield pd.DataFrame({"sid": ids, "n": [r[1] for r in rows], "fp": [r[2] for r in rows], **lists})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _word_sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([word_set(t).view(np.int64) for t in batch], dtype=object)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets (sid, words) have a Jaccard similarity of at least 4/5, exactly."""
    left, right = sets.select(F.col("sid").alias("u"), F.col("words").alias("a")), sets.select(F.col("sid").alias("v"), F.col("words").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", (F.size("a") + F.size("b")).alias("sum"), F.size(F.array_intersect("a", "b")).alias("shared"))
    return both.where(F.col("shared") * 5 >= (F.col("sum") - F.col("shared")) * 4).select("u", "v")


_FITS = "5L * least({0}, {1}) >= 4L * greatest({0}, {1})"


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets (sid, n, fp, distinct) whose fingerprints anchors bring together.

    Each set with the least of its fingerprint, and the least sets of two linked fingerprints; sizes rule some out.
    """
    least = materialize(sets.groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("least")), "fingerprints")
    equal = sets.join(least, "fp").where("sid <> least.sid").select(F.struct("sid", "n").alias("a"), F.col("least").alias("b"))
    links = fingerprint_links(least.select("fp"))
    first, second = least.select(F.col("fp").alias("u"), F.col("least").alias("a")), least.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    pairs = links.join(first, "u").join(second, "v").select("a", "b").unionAll(equal).where(_FITS.format("a.n", "b.n"))
    return pairs.select(F.least("a.sid", "b.sid").alias("u"), F.greatest("a.sid", "b.sid").alias("v")).distinct()


def prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of members (sid, n, part, bits) of different parts that a similarity of 4/5 does not rule out.

    Shingles are ordered by how few members have them.  Two sets of that similarity have 4/9 of their sizes' sum in common: of
    the smaller one 8/9 at least, of the larger one 4/5.  So one of the first n/9 of the smaller is among the first n/5 of the larger,
    and only these meet.  Sets that are further apart than that mostly begin with shingles of their own, and then make no pair,
    however many of them there are.  Of those that meet, three kinds of pairs are left out within the join: where what both have from
    there on is less than 4/9 of both sizes (of the first meeting, this is all they share); those whose parities() differ in more elements
    than the similarity allows, a ninth of both sizes; and those that have met just before, so that few pairs come out twice.
    """
    each = members.join(sets, "sid").select("sid", "n", "part", "bits", F.explode("words").alias("w"))
    rarity = each.groupBy("w").agg(F.count("*").alias("df"))
    ranked = each.select("sid", "w").join(rarity.where("df > 1"), "w").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
    # shingles of one member alone stand before all others
    first = ranked.join(members, "sid").select("sid", "n", "part", (F.col("n") - F.size("s")).alias("own"), F.transform("s", lambda x: x["w"]).alias("s"))
    reach = "slice(s, 1, greatest(0, n - cast(ceil(n * 4 / 5) as int) + 1 - own))"
    entry = f"transform({reach}, (w, i) -> struct(own + i as at, w, slice(s, greatest(1, i + 1 - {BEFORE}), least(i, {BEFORE})) as before))"
    first = materialize(first.select("sid", "n", "part", F.explode(F.expr(entry)).alias("x")).select("sid", "n", "part", "x.*"), "prefixes")
    mixed = first.groupBy("w").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("w")
    bits = members.select("sid", *[F.get("bits", F.lit(k)).alias(f"bit{k}") for k in range(BITS // 64)])
    met = first.join(mixed, "w", "left_semi").join(bits, "sid")
    side = lambda df, x: df.select("w", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "w"])
    small, large = side(met.where("at <= n - cast(ceil(n * 8 / 9) as int)"), "u"), side(met, "v")
    apart = " + ".join(f"bit_count(bit{k}_u ^ bit{k}_v)" for k in range(BITS // 64))
    near = " and ".join(f"9 * (n_{x} - at_{x}) >= 4 * (n_u + n_v)" for x in "uv")
    close = F.expr(
        f"part_u <> part_v and sid_u <> sid_v and n_u <= n_v and {_FITS.format('n_u', 'n_v')} and {near} "
        f"and 9 * ({apart}) <= n_u + n_v and not arrays_overlap(before_u, before_v)"
    )
    pairs = small.join(large, (small["w"] == large["w"]) & close)
    return pairs.select(F.least("sid_u", "sid_v").alias("u"), F.greatest("sid_u", "sid_v").alias("v")).distinct()


def word_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, part for every row; part names the component over links of Jaccard similarity 4/5 or more.

    Texts with the same shingles are one set.  Sets whose fingerprints differ in THRESHOLD or fewer bits are linked by anchors, and
    sets that share a band are candidates as well, each verified by its shingles: in bands that are not connected yet every set against a centre,
    ROUNDS times; then, of sets in bands still unconnected, the pairs that prefix_pairs() leaves, so that neither a band of many near copies nor one of many sets below the similarity is
    held against itself.  Texts without words are copies of one another.
    Texts of any length are read whole; an empty table gives an empty result.
    """
    texts = keyed(docs)
    rows = materialize(texts.select("doc_id", "tkey", _sketch("text").alias("s")).select("doc_id", "tkey", "s.*"), "word-sets")
    alike = materialize(fingerprint_pairs(rows.where("n > 0").select("sid", "n", "fp").distinct()), "fingerprint-pairs")
    each = rows.where("n > 0").dropDuplicates(["sid"]).select("sid", "n", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    bands = materialize(each.join(shared, "band").select("band", "sid", "n"), "bands")
    # the shingles of the candidates
    wanted = bands.select("sid").unionAll(alike.select("u")).unionAll(alike.select("v")).distinct()
    keys = materialize(rows.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("tkey").alias("_key")), "wanted")
    keys = F.broadcast(keys) if keys.count() <= FEW else keys
    sets = texts.join(keys, texts["tkey"] == keys["_key"]).select("sid", "text").dropDuplicates(["sid"]).select("sid", _word_sets("text").alias("words"))
    sets = materialize(sets, "words")
    links = materialize(_similar(alike, sets), "fingerprint-links")
    near = materialize(connected_components(links), "near")
    discard(alike)
    discard(links)
    for k in range(ROUNDS):
        # bands whose sets are not all connected: all of a band against a centre of this round's
        named = bands.join(near, bands["sid"] == near["node"], "left").select("band", "sid", "n", F.coalesce("component", "sid").alias("part"))
        mixed = named.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct(F.xxhash64(F.lit(k), "sid").alias("draw"), "sid", "n", "part")).alias("c")).where("low < high")
        left = materialize(named.join(mixed.select("band", "c"), "band"), "mixed-bands")
        star = left.where("part <> c.part").where(_FITS.format("n", "c.n")).select(F.least("sid", "c.sid").alias("u"), F.greatest("sid", "c.sid").alias("v")).distinct()
        more = materialize(_similar(star, sets), "star-links")
        before, near = near, materialize(connected_components(more.unionAll(near.select(F.col("node").alias("u"), F.col("component").alias("v")))), "near")
        for table in (left, more, before):
            discard(table)
    named = bands.join(near, bands["sid"] == near["node"], "left").select("band", "sid", "n", F.coalesce("component", "sid").alias("part"))
    mixed = named.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("band")
    members = named.join(mixed, "band", "left_semi").select("sid", "n", "part").distinct()
    members = materialize(members.join(rows.where("n > 0").groupBy("sid").agg(F.first("bits").alias("bits")), "sid"), "members")
    more = materialize(_similar(prefix_pairs(members, sets), sets), "other-links")
    parts = connected_components(more.unionAll(near.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    for table in (bands, sets, near, members, more):
        discard(table)
    return rows.join(parts, rows["sid"] == parts["node"], "left").select("doc_id", "tkey", F.coalesce("component", "sid").alias("part"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component of word_duplicates() one row stays, that of the smallest doc_id.

    Rows that share doc_id and text are one document and one of them stays; a null doc_id ranks last; of several
    texts under the smallest doc_id the one with the smallest hash stays.  All columns are kept.
    """
    found = word_duplicates(docs)
    kept = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("doc_id"), F.col("k.tkey").alias("tkey"))
    own_id, own_key = fresh(docs, "_mr_id"), fresh(docs, "_mr_key")
    own = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_key: text_key()})
    kept_rows = own.join(kept, own[own_id].eqNullSafe(kept["doc_id"]) & (own[own_key] == kept["tkey"]), "left_semi")
    return kept_rows.dropDuplicates([own_id, own_key]).select(*[F.col(f"`{c}`") for c in docs.columns])
