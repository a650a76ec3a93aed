r"""Near-duplicates by SimHash with anchor-point covering, for a rule by similarity: sets of word shingles alike by a threshold.

This is the search of the pipeline's near-duplicate stage, whose rule is five-word shingles and a Jaccard similarity of
0.8 or more. At 0.8 the SimHash of two sets differs in 15 % of its bits, so 64 bits with a radius of 3, op3's contract,
can't find them. Here a fingerprint has 2048 bits, cut into 89 blocks of 23. The anchors of a block are the words of the
perfect [23,12] Golay code (covering radius 3): every block has one nearest anchor, and sets that share an anchor in any
block meet. Two sets at the threshold share a block's anchor with a chance of 0.12, and none of 89 in one case in 1e5;
sets of few shingles, whose bits differ more often, have the anchors of a second fingerprint too (one in 1e6 at worst).

Of those that meet, pairs whose fingerprints differ in too many bits for the threshold go: first by 128 bits beside the
anchor, then by all (in one case in a million at the threshold). The pairs left are compared exactly, by both whole sets.
So these chances are the only ways to lose a link, and nothing below the threshold links.

Equal sets collapse first. Where many pairs at an anchor are near, as in a large group of near copies, only connections
are wanted, not all pairs. In rounds some members of such an anchor (one, then MORE_PIVOTS times more a round, those at
the most such anchors first: an original before its edited copies) are compared with all of its members in other
components and then leave. It is done when the members left at each anchor lie in one component, so no pair that could
still connect anything goes uncompared. Joins on keys that may be hot deal their rows over many tasks.

Defined cases: null and wordless texts have the empty set and are equal to each other; a text of fewer words than a
shingle has one, the whole sequence; a very long text is read whole, its hashes in chunks; rows without an id neither
link nor give a row; repeated rows and ids give a row each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_pass, content_key, join_hot, materialize, only_some
from skarn.llm.minhash import set_id, shingles
from skarn.llm.simhash import components, stars

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
BLOCK = 23
BLOCKS = 89
#: 64-bit numbers of a fingerprint; its last FAST_WORDS go with every anchor.
WORDS = 32
FAST_WORDS = 2
#: Sets of fewer shingles have the anchors of a second fingerprint, and only the fast words rule their pairs out.
SMALL = 32
#: Standard deviations by which the bits of a pair at the threshold may differ more than they should, and what sets of few
#: shingles add to the share of bits that should (at most 0.01, but for four shingles against five).
DEVIATIONS = 4.8
UNEVEN = 0.01
#: With more near pairs than so many, and than so many a member, an anchor is left to the rounds; with more members than
#: CELL it is without a look.
FEW_PAIRS = 64
PAIRS_A_MEMBER = 8
CELL = 1 << 15
#: By this factor the pivots of an anchor grow from round to round.
MORE_PIVOTS = 8
_CHUNK = 255
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MASKS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 2 * WORDS), dtype=np.uint64)
_FACTORS = _FACTORS | np.uint64(1)
#: Generator polynomial of the binary Golay code (fixed value).
_GOLAY = 0b101011100011


def _syndrome(value: int) -> int:
    for bit in range(BLOCK - 1, 10, -1):
        if value >> bit & 1:
            value ^= _GOLAY << (bit - 11)
    return value


_LOW = np.array([_syndrome(v) for v in range(1 << 12)], dtype=np.uint32)
_HIGH = np.array([_syndrome(v << 12) for v in range(1 << 11)], dtype=np.uint32)
#: The error of each syndrome: every pattern of at most three bits has a syndrome of its own.
_ERROR = np.zeros(1 << 11, dtype=np.uint32)
for _bits in ((1 << i) | (1 << j) | (1 << k) for i in range(BLOCK) for j in range(i + 1) for k in range(j + 1)):
    _ERROR[_LOW[_bits & 0xFFF] ^ _HIGH[_bits >> 12]] = _bits


def nearest_anchor(block: np.ndarray) -> np.ndarray:
    """The Golay word within three bits of a value of 23 bits."""
    return block ^ _ERROR[_LOW[block & np.uint32(0xFFF)] ^ _HIGH[block >> np.uint32(12)]]


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set, WORDS numbers; of a small set two of them, one after the other; of the empty set none."""
    words = 0 if not len(hashes) else 2 * WORDS if len(hashes) < SMALL else WORDS
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes) if words else 0, _CHUNK):
        x = (hashes[at : at + _CHUNK, None] ^ _MASKS[:words]) * _FACTORS[:words]
        x = (x ^ (x >> np.uint64(29))) * _PRIME
        x ^= x >> np.uint64(32)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)


def anchors(prints: np.ndarray) -> np.ndarray:
    """For fingerprints (n, WORDS): the anchor of each block (n, BLOCKS), numbered by block and the code's 12 data bits."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little", count=BLOCK * BLOCKS)
    weights = (1 << np.arange(BLOCK)).astype(np.float32)  # sums below 2 ** 24 are exact
    blocks = (bits.reshape(-1, BLOCKS, BLOCK).astype(np.float32) @ weights).astype(np.uint32)
    return (nearest_anchor(blocks) >> np.uint32(11)).astype(np.int32) + (np.arange(BLOCKS, dtype=np.int32) << 12)


_SIGNED = "doc_id long, k1 long, k2 long, set binary, size long, print array<long>"


def _print_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, prints = [], [], []
            for text in batch.column(3):
                own = shingles(text.as_py(), size)
                sets.append(set_id(own)), sizes.append(len(own)), prints.append(fingerprint(own))
            columns = [pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["doc_id", "k1", "k2", "set", "size", "print"])

    return run


_AT_ANCHORS = "anchor int, v long, f1 long, f2 long"


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            v, lists = part.column(0).to_numpy(), part.column(1)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            firsts = np.cumsum(sizes) - sizes
            for more in range(2):
                has = np.flatnonzero(sizes >= (more + 1) * WORDS)
                prints = flat[(firsts[has] + more * WORDS)[:, None] + np.arange(WORDS)]
                found = anchors(prints) + np.int32(more * BLOCKS << 12)
                fast = [np.repeat(prints[:, WORDS - FAST_WORDS + i], BLOCKS) for i in range(FAST_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(np.repeat(v[has], BLOCKS)), *map(pa.array, fast)], names=["anchor", "v", "f1", "f2"])


def _most(bits: int, threshold: float) -> float:
    """In how many bits two sets at the threshold differ at most, chances of one in a million aside."""
    share = math.acos(2 * threshold / (1 + threshold)) / math.pi + UNEVEN
    return bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))


def meetings(anchor: np.ndarray, v: np.ndarray, f1: np.ndarray, f2: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by anchor, f1 and f2 unsigned: a and b of the near pairs at anchors that have few of them, and the places of the members left to the rounds."""
    starts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(anchor)))
    group, found = np.repeat(np.arange(len(starts)), sizes), np.zeros(len(starts), dtype=np.int64)
    end, limit, seen = np.repeat(starts + sizes, sizes), np.maximum(FEW_PAIRS, PAIRS_A_MEMBER * sizes), np.repeat(sizes > CELL, sizes)
    one, two = math.ceil(_most(64, threshold)), math.ceil(_most(128, threshold))
    at, step, pairs = np.flatnonzero(~seen), 1, []
    found[sizes > CELL] = np.iinfo(np.int64).max // 2
    while len(at := at[at + step < end[at]]):
        near = np.bitwise_count(f1[at] ^ f1[at + step])
        near, first = at[near <= one], near[near <= one]
        near = near[first + np.bitwise_count(f2[near] ^ f2[near + step]) <= two]
        if len(near):
            seen[near] = seen[near + step] = True
            np.add.at(found, group[near], 1)
            pairs.append(np.stack([near, near + step])[:, found[group[near]] <= limit[group[near]]])
        step += 1
    hot = (found > limit)[group]
    p, q = np.concatenate([np.zeros((2, 0), dtype=np.int64), *pairs], axis=1)
    p, q = p[~hot[p]], q[~hot[p]]
    return np.minimum(v[p], v[q]), np.maximum(v[p], v[q]), np.flatnonzero(hot & seen)


def _meeting_batches(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("anchor", pa.int32())])

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b, left = meetings(*rows, threshold)
        if len(a) or len(left):
            own = rows[1][left]
            anchor = pa.concat_arrays([pa.nulls(len(a), pa.int32()), pa.array(rows[0][left])])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, own])), pa.array(np.concatenate([b, own])), anchor], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; only the last anchor of a batch is carried on."""
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append([batch.column(i).to_numpy() if i < 2 else batch.column(i).to_numpy().view(np.uint64) for i in range(4)])
            if rest[0][0][0] != rest[-1][0][-1]:
                rows = [np.concatenate(x) for x in zip(*rest, strict=True)]
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                yield from found([x[:last] for x in rows])
                rest = [[x[last:].copy() for x in rows]]
        if rest:
            yield from found([np.concatenate(x) for x in zip(*rest, strict=True)])

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(x.as_py(), size).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["v", "hashes"])

    return run


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs a, b whose similarity reaches the threshold, from their whole sets."""
    of_b = join_hot(pairs, sets.select(F.col("v").alias("b"), F.col("hashes").alias("y")), ["b"], _counted(pairs, "b"))
    of_both = join_hot(of_b, sets.select(F.col("v").alias("a"), F.col("hashes").alias("x")), ["a"], _counted(pairs, "a"))
    common = of_both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("both"))
    return common.filter(F.col("n") / (F.col("both") - F.col("n")) >= threshold).select("a", "b")


def _near(threshold: float, one: tuple[str, str], other: tuple[str, str]) -> Column:
    """Whether sizes and whole fingerprints of two sets allow the threshold."""
    (size, own), (size_, own_) = one, other
    differ = reduce(Column.__add__, (F.bit_count(F.get(own, F.lit(i)).bitwiseXOR(F.get(own_, F.lit(i)))) for i in range(WORDS)))
    return (F.least(size, size_) / F.greatest(size, size_) >= threshold) & ((F.least(size, size_) < SMALL) | (differ <= _most(64 * WORDS, threshold)))


def _near_pairs(pairs: DataFrame, signs: DataFrame, threshold: float) -> DataFrame:
    of = lambda x: signs.select(F.col("v").alias(x), F.col("size").alias(f"size_{x}"), F.col("print").alias(f"print_{x}"))
    of_both = join_hot(join_hot(pairs, of("b"), ["b"], _counted(pairs, "b")), of("a"), ["a"], _counted(pairs, "a"))
    return of_both.filter(_near(threshold, ("size_a", "print_a"), ("size_b", "print_b"))).select("a", "b")


def _across(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs a, b whose ends lie in different components."""
    root = lambda x: linked.select(F.col("child").alias(x), F.col("root").alias(f"root_{x}"))
    of_b = join_hot(pairs, root("b"), ["b"], _counted(pairs, "b"), "left")
    of_both = join_hot(of_b, root("a"), ["a"], _counted(pairs, "a"), "left")
    return of_both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_groups(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, k1, k2, root, component_id: one row per row of documents that has an id; groups for simhash.keep_first."""
    row, text = ["doc_id", "k1", "k2"], F.col("text").cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *content_key(text), text.alias("text")).filter("doc_id is not null")
    docs = materialize(arrow_pass(texts, _print_batches(shingle_words), _SIGNED), "prints")
    one = docs.groupBy("set").agg(F.first(F.struct(*row, "size", "print")).alias("x"))
    signs = materialize(one.select(F.monotonically_increasing_id().alias("v"), "set", "x.*"), "distinct-sets")

    at_anchors = arrow_pass(signs.select("v", "print"), _anchor_batches, _AT_ANCHORS)
    dealt = at_anchors.repartition("anchor").sortWithinPartitions("anchor")
    met = materialize(arrow_pass(dealt, _meeting_batches(threshold), "a long, b long, anchor int"), "meetings")
    pairs = materialize(met.filter("anchor is null").select("a", "b").distinct(), "meeting-pairs")
    pairs = materialize(_near_pairs(pairs, signs, threshold), "pairs")
    crowd = materialize(met.filter("anchor is not null").select("anchor", F.col("a").alias("v")), "crowds")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).unionByName(crowd.select("v")).distinct()
    wanted = materialize(signs.select("v", *row).join(wanted, "v"), "wanted")
    again = materialize(docs.select(*row).join(wanted, row, "left_semi").groupBy(*row).count().filter("count > 1").select(*row), "repeated-rows")
    of_wanted = only_some(texts, wanted, row).join(wanted, row)
    if not again.isEmpty():
        of_wanted = of_wanted.join(again, row, "left_anti").unionByName(of_wanted.join(again, row, "left_semi").dropDuplicates(["v"]))
    sets = materialize(arrow_pass(of_wanted.select("v", "text"), _set_batches(shingle_words), "v long, hashes array<long>"), "shingle-sets")

    firsts = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    links = materialize(_similar(firsts, sets, threshold), "similar")
    linked = stars(links)  # most pairs left lie in one component now, and need no look
    rest = materialize(_across(pairs.join(firsts, ["a", "b"], "left_anti"), linked), "pairs-across")
    more = materialize(_similar(rest, sets, threshold), "similar")
    if not more.isEmpty():
        linked = stars(more.unionByName(linked.select(F.col("child").alias("a"), F.col("root").alias("b"))))
    degrees = crowd.groupBy("v").agg(F.count("*").alias("degree"))
    members = materialize(crowd.join(signs.select("v", "size", "print").join(degrees, "v"), "v"), "members")
    pivots, of_set = 1, ["size", "print", "degree"]
    while True:
        placed = materialize(members.join(linked, members["v"] == linked["child"], "left").select("anchor", "v", *of_set, F.coalesce("root", "v").alias("root")), "placed")
        split = materialize(placed.groupBy("anchor").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high").select("anchor", "n"), "split-anchors")
        if split.isEmpty():
            break
        members = materialize(join_hot(placed, split.select("anchor"), ["anchor"], split), "members")
        deal = F.xxhash64("v", F.lit(pivots))
        part = F.pmod(deal, F.lit(pivots).cast("long")).alias("part")
        leading = members.groupBy("anchor", part).agg(F.max_by(F.struct("v", "root", *of_set), F.struct("degree", deal, "v")).alias("x"))
        leading = materialize(leading.select("anchor", *(F.col(f"x.{c}").alias(f"pivot_{c}") for c in ("v", "root", "size", "print"))), "pivots")
        across = join_hot(members, leading, ["anchor"], split).filter(F.col("root") != F.col("pivot_root")).filter(_near(threshold, ("size", "print"), ("pivot_size", "pivot_print")))
        pairs = materialize(across.select(F.col("pivot_v").alias("a"), F.col("v").alias("b")).distinct(), "pairs")
        links = materialize(_similar(pairs, sets, threshold), "similar")
        if not links.isEmpty():
            linked = stars(links.unionByName(linked.select(F.col("child").alias("a"), F.col("root").alias("b"))))
        members = members.drop("root").join(leading.select("anchor", F.col("pivot_v").alias("v")), ["anchor", "v"], "left_anti")
        pivots *= MORE_PIVOTS
    named = signs.select("v", "set")
    of_child = linked.join(named.select(F.col("v").alias("child"), F.col("set").alias("c")), "child")
    by_set = join_hot(of_child, named.select(F.col("v").alias("root"), F.col("set").alias("r")), ["root"], _counted(linked, "root"))
    return components(docs.select(*row, "set"), "set", by_set.select(F.col("c").alias("child"), F.col("r").alias("root")))
