r"""Near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

This is the candidate search of the pipeline's near-duplicate stage, whose rule is five-word shingles and a similarity of
0.8 or more. The SimHash of two sets at 0.8 differs in 9.7 of 64 bits, give or take 2.9, which is far beyond what
anchors can cover (README), so the keys that bring candidates together are minima here; what links, groups and stays
is decided by simhash.components and simhash.keep_first.

Every text gives the set of its 64-bit shingle hashes, known by 128 bits of it. Equal sets collapse first. Of a distinct
set BANDS keys are made, each from BAND_ROWS minima of seeded hashes; sets that share a key are candidates, and a
candidate pair links only if its similarity, computed from both whole sets, reaches the threshold. A pair of
similarity s shares no key with probability (1 - s ** BAND_ROWS) ** BANDS, 3.2e-6 at 0.8; this and the sketch below are
the only ways to lose a link. Pairs are compared whole unless their sizes rule the threshold out or their sketches, two
bits of each of MINIMA minima, disagree so often that, at the threshold, it would be one case in a million.
So sets that share a long passage, and many keys with it, but are not similar cost a few machine instructions a pair.

Within a key only connections are wanted, not all pairs. In rounds some members of a key (one, then eight times more a
round, those that share the most keys with others first: an original before its edited copies) are compared with all of
its members in other components and then leave the key. It is done when the members
left in each key lie in one component, so no pair that could still connect anything goes uncompared. Joins on keys and
pivots that may be hot deal their rows over many tasks.

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
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_pass, ascii_lower_words, content_key, join_hot, kept, materialize
from skarn.llm.simhash import Forest, components, stars

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 24
BAND_ROWS = 4
SEED = 42
#: Minima of a set, of which the first make its keys. Two bits of each are its sketch, SKETCH_WORDS numbers of 64 bits.
MINIMA = 1024
SKETCH_WORDS = MINIMA * 2 // 64
#: Standard deviations by which the sketches of a pair at the threshold may disagree more than they should.
SKETCH_DEVIATIONS = 4.8
#: By this factor the pivots of a key grow from round to round.
MORE_PIVOTS = 8
_CHUNK = 1 << 8
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, MINIMA, 1), dtype=np.uint32)
_MASKS, _FACTORS = _DRAWN[0], _DRAWN[1] | np.uint32(1)
_KEPT_WORDS = 100_000


class _WordHashes(dict):
    """Word -> its hash; emptied between texts when full."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_HASHES = _WordHashes()
kept(_HASHES.clear)


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted. A shingle's hash mixes those of its words in their order."""
    words = ascii_lower_words(text)
    if len(_HASHES) > _KEPT_WORDS:
        _HASHES.clear()
    ids = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(ids))
    out = np.full(len(ids) - size + 1 if size else 0, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * _PRIME + ids[k : k + len(out)]
    return np.unique((out ^ (out >> np.uint64(32))) * _PRIME)


def set_id(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def minima(hashes: np.ndarray) -> np.ndarray:
    """MINIMA minima of seeded 32-bit hashes, none for the empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(short), _CHUNK):
        low = np.minimum(low, ((short[None, at : at + _CHUNK] ^ _MASKS) * _FACTORS).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band of the first minima; bands have keys of their own."""
    if not len(low):
        return np.zeros(0, dtype=np.int64)
    low, key = low[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = (key ^ (key >> np.uint64(29))) * _PRIME + low[:, k]
    return ((key ^ (key >> np.uint64(31))) * _PRIME).view(np.int64)


def sketch(low: np.ndarray) -> np.ndarray:
    """Two well mixed bits of each minimum, packed."""
    if not len(low):
        return np.zeros(SKETCH_WORDS, dtype=np.int64)
    bits = (((low ^ (low >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(30)).astype(np.uint64).reshape(SKETCH_WORDS, 32)
    return np.bitwise_or.reduce(bits << np.arange(0, 64, 2, dtype=np.uint64), axis=1).view(np.int64)


_SIGNED = "doc_id long, k1 long, k2 long, set binary, size long, sketch array<long>, keys array<long>"


def _key_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, sketches, keys = [], [], [], []
            for text in batch.column(3):
                own = shingles(text.as_py(), size)
                low = minima(own)
                sets.append(set_id(own)), sizes.append(len(own)), sketches.append(sketch(low)), keys.append(band_keys(low))
            columns = [pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["doc_id", "k1", "k2", "set", "size", "sketch", "keys"])

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(x.as_py(), size) for x in batch.column(0)[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set", "hashes"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: those of the pairs (pivot, member) whose similarity reaches the threshold. Only the sets in the pairs are moved."""

    def of(side: str, name: str) -> DataFrame:
        return sets.join(pairs.select(F.col(side).alias("set")).distinct(), "set", "left_semi").select(F.col("set").alias(side), F.col("hashes").alias(name))

    of_member = pairs.join(of("member", "y"), "member")
    of_both = join_hot(of_member, of("pivot", "x"), ["pivot"], pairs.groupBy("pivot").agg(F.count("*").alias("n")))
    common = of_both.select("pivot", "member", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("both"))
    return common.filter(F.col("n") / (F.col("both") - F.col("n")) >= threshold).select(F.col("pivot").alias("a"), F.col("member").alias("b"))


def _near(threshold: float) -> Column:
    """Whether sizes and sketches of a member and a pivot allow the threshold."""
    sizes = F.least("size", "pivot_size") / F.greatest("size", "pivot_size") >= threshold
    wrong = (1 - threshold) * 3 / 4
    most = MINIMA * wrong + SKETCH_DEVIATIONS * math.sqrt(MINIMA * wrong * (1 - wrong))
    low_bits = F.lit(0x5555555555555555)
    words = [F.get("sketch", F.lit(i)).bitwiseXOR(F.get("pivot_sketch", F.lit(i))) for i in range(SKETCH_WORDS)]
    differ = reduce(Column.__add__, (F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low_bits)) for x in words))
    return sizes & (differ <= most)


def similar_groups(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, k1, k2, root, component_id: one row per row of documents that has an id; groups for simhash.keep_first."""
    row, text = ["doc_id", "k1", "k2"], F.col("text").cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *content_key(text), text.alias("text")).filter("doc_id is not null")
    docs = materialize(arrow_pass(texts, _key_batches(shingle_words), _SIGNED), "sets")
    of_set = ["size", "sketch", "degree"]
    distinct = materialize(docs.groupBy("set").agg(F.first(F.struct(*row, "size", "sketch", "keys")).alias("x")).select("set", "x.*"), "distinct-sets")
    keyed = distinct.select("set", F.explode("keys").alias("key"))
    split = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    shared = materialize(join_hot(keyed, split, ["key"], split), "sharing")
    signs = materialize(distinct.drop("keys").join(shared.groupBy("set").agg(F.sum("n").alias("degree")), "set"), "signs")
    members = materialize(shared.drop("n").join(signs.select("set", *of_set), "set").withColumn("root", F.col("set")), "members")
    wanted = materialize(signs.select(*row), "wanted")  # narrow, so that the texts needn't move unless it is large
    again = materialize(docs.select(*row).join(wanted, row, "left_semi").groupBy(*row).count().filter("count > 1").select(*row), "repeated-rows")
    hashed = lambda some: arrow_pass(some.select("text"), _set_batches(shingle_words), "set binary, hashes array<long>")
    of_wanted = texts.join(wanted, row, "left_semi")
    if again.isEmpty():
        sets = materialize(hashed(of_wanted), "shingle-sets")
    else:
        once = hashed(of_wanted.join(again, row, "left_semi")).groupBy("set").agg(F.first("hashes").alias("hashes"))
        sets = materialize(hashed(of_wanted.join(again, row, "left_anti")).unionByName(once), "shingle-sets")

    linked = documents.sparkSession.createDataFrame([], "child binary, root binary")
    pivots = 1
    while not split.isEmpty():
        deal = F.xxhash64("set", F.lit(pivots))
        part = F.pmod(deal, F.lit(pivots).cast("long")).alias("part")
        leading = members.groupBy("key", part).agg(F.max_by(F.struct("set", "root", *of_set), F.struct("degree", deal, "set")).alias("x"))
        leading = materialize(leading.select("key", *(F.col(f"x.{c}").alias(f"pivot_{c}") for c in ("set", "root", "size", "sketch"))), "pivots")
        met = join_hot(members, leading, ["key"], split).filter(F.col("root") != F.col("pivot_root")).filter(_near(threshold))
        pairs = materialize(met.select(F.col("pivot_set").alias("pivot"), F.col("set").alias("member")).distinct(), "pairs")
        links = materialize(_similar(pairs, sets, threshold), "similar")
        if not links.isEmpty():
            linked = stars(links.unionByName(linked.select(F.col("child").alias("a"), F.col("root").alias("b"))))
        left = members.drop("root").join(leading.select("key", F.col("pivot_set").alias("set")), ["key", "set"], "left_anti")
        placed = materialize(left.join(linked, left["set"] == linked["child"], "left").select("key", "set", *of_set, F.coalesce("root", "set").alias("root")), "placed")
        split = materialize(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high").select("key", "n"), "split-keys")
        members = join_hot(placed, split.select("key"), ["key"], split)
        pivots *= MORE_PIVOTS
    return components(docs.select(*row, "set"), "set", linked)


def brute_force(rows: list[tuple[int, str | None]], size: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> dict[int, int]:
    """For tests: the component of each row, by its place, from all pairs of sets of word tuples."""
    sets = []
    for _, text in rows:
        words = ascii_lower_words(text)
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
    known = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                known.join(i, j)
    return {i: known.root(i) for i in range(len(rows))}
