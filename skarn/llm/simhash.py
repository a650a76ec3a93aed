r"""SimHash near-duplicate detection by anchor-point covering.

Every document gets a 64-bit SimHash of its three-word shingles. Two fingerprints link when they differ in at
most three bits, and documents form the connected components of those links.

Links are found without comparing all pairs. Of two fingerprints within three bits, one 32-bit half differs in at
most one bit. In each half the anchors are the words of a covering code: the perfect [31,26] Hamming code
(covering radius 1) on 31 bits, with the last bit as it is. A fingerprint has one home anchor, within radius 1, and
is replicated to each anchor within radius 1 plus threshold 1, 17 of the 2^27 anchors of a half. So any link
x, y meets at the home anchor of x, in the half where they differ in one bit at most.

Equal fingerprints are collapsed before replication, by a partial aggregate, so groups of exact copies cost one
row. Members of anchors that are no fingerprint's home go at once. Anchors with many members are split by the 16-bit
quarters of the fingerprint: two fingerprints within three bits agree in one quarter at least, so the split loses no
link. What is still larger than CELL is dealt into a grid of cells, homes by rows and members by columns, so that every
home meets every member in one cell and no task holds more than about 2 * CELL fingerprints of a group. In a cell homes
are compared with members, and the links found are a spanning forest of theirs, never all pairs.

Components come from rounds of large-star and small-star contraction on written edge tables. Joins on keys that may
be hot (a fingerprint with many copies, the root of a large component) deal the rows of such a key over many tasks.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text of one or two words
has one shingle, the whole sequence; a very long text is read whole, its hashes in chunks; repeated rows and repeated
ids each give a row; a null doc_id gives a row whose component_id is the smallest id of its component, null if the
component has none; an empty table gives no row. Other columns are ignored.

`keep_first` decides row by row: rows are told apart by id and text, so of rows that share an id but not a text each
goes or stays by its own component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import all_but, arrow_pass, ascii_lower_words, columns_of, content_key, discard, join_hot, materialize, only_some

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: An anchor with more members than this is split by quarters.
HOT_ANCHOR = 4096
#: A group with more members than this is dealt into a grid of cells.
CELL = 4096
_CHUNK = 1 << 16
_LOW31 = np.uint64((1 << 31) - 1)


def simhash(text: str | None) -> int:
    """The SimHash of one text, as an unsigned integer."""
    words = ascii_lower_words(text)
    if not words:
        return 0
    shingles = max(1, len(words) - SHINGLE_WORDS + 1)
    if len(words) < SHINGLE_WORDS:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=shingles)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, shingles, _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > shingles, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(simhash, (x.as_py() for x in batch.column(3))), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(prints.view(np.int64))], names=["doc_id", "k1", "k2", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, k1, k2, fp: the text's key, and the fingerprint's 64 bits as a signed long."""
    text = F.col("text").cast("string")
    return arrow_pass(documents.select(F.col("doc_id").cast("long").alias("doc_id"), *content_key(text), text.alias("text")), _fingerprint_batches, "doc_id long, k1 long, k2 long, fp long")


def _parity_positions(x: np.ndarray) -> np.ndarray:
    """Hamming syndrome of the low 31 bits: the XOR of the 1-based positions of the bits that are set."""
    out = np.zeros(x.shape, dtype=np.uint64)
    for bit in range(31):
        out ^= ((x >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def half_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit values: an array (n, 17) of anchors, first the home anchor, and which of them are there."""
    one = np.uint64(1)
    syndrome = _parity_positions(half)
    flip = np.where(syndrome > 0, one << (np.maximum(syndrome, one) - one), np.uint64(0))
    home = half ^ flip
    out, there = [home, home ^ (one << np.uint64(31))], [np.ones(half.shape, bool)] * 2
    for i in range(1, 32):
        j = syndrome ^ np.uint64(i)
        # each pair i < j of positions with i ^ j = syndrome gives a codeword at distance two
        there.append((syndrome > 0) & (j > np.uint64(i)))
        out.append(half ^ (one << np.uint64(i - 1)) ^ (one << (np.maximum(j, one) - one)))
    return np.stack(out, axis=1), np.stack(there, axis=1)


def _anchor_batches(homes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                half = (prints >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
                anchors, there = half_anchors(half)
                if homes_only:
                    anchors, there = anchors[:, :1], there[:, :1]
                row, column = np.nonzero(there)
                anchor = (anchors[row, column] | np.uint64(side << 32)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor)] if homes_only else [pa.array(anchor), pa.array(prints[row].view(np.int64)), pa.array(column == 0)], names=["anchor"] if homes_only else ["anchor", "fp", "home"])

    return run


class Forest:
    """Union-find over positions of an array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def cell_links(homes: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """Links (home, member) that connect all that the links of these homes with these members connect."""
    nodes, members = np.unique(np.concatenate([homes, members])), np.unique(members)
    places = np.searchsorted(nodes, members)
    label, links = np.arange(len(nodes)), []
    for p in np.unique(np.searchsorted(nodes, homes)).tolist():
        near = places[(np.bitwise_count(members ^ nodes[p]) <= MAX_BITS) & (label[places] != label[p])]
        if len(near):
            others, first = np.unique(label[near], return_index=True)
            links += [(int(nodes[p]), int(nodes[q])) for q in near[first]]
            label[np.isin(label, others)] = label[p]
    return links


_HOME, _MEMBER = 1, 2
_GROUP = ("anchor", "part", "across", "down")


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, so that a group's rows follow each other; only the last group of a batch is carried on."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest: list[np.ndarray] = []

    def links(key: np.ndarray, fp: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1])
        ends = np.append(starts[1:], len(fp))
        found = []
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start > 1:
                own, kind = fp[start:end], role[start:end]
                found += cell_links(own[kind & _HOME > 0], own[kind & _MEMBER > 0])
        a, b = (np.array(found, dtype=np.uint64).T if found else np.zeros((2, 0), dtype=np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda i: batch.column(i).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        part = [np.stack([column(i) for i in range(4)], axis=1), column(4).view(np.uint64), column(5)]
        key, fp, role = [np.concatenate(x) for x in zip(rest, part, strict=True)] if rest else part
        last = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1 if np.any(key[0] != key[-1]) else 0
        if last:
            yield links(key[:last], fp[:last], role[:last])
        rest = [x[last:] for x in (key, fp, role)]
    if rest:
        yield links(*rest)


def _sized(rows: DataFrame, *keys: str) -> DataFrame:
    """rows of the groups that have a home and another member, with the group's size as `size`."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.max("home").alias("any_home")).filter("size > 1 AND any_home")
    sizes = materialize(sizes.select(*keys, "size"), "sizes")
    return join_hot(rows, sizes, list(keys), sizes.withColumnRenamed("size", "n"))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """a, b (a < b): links that connect all that links of three bits or fewer connect, from distinct fp values."""
    fp = materialize(prints.select("fp"), "prints")
    homes = materialize(arrow_pass(fp, _anchor_batches(True), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")), "homes")
    members = arrow_pass(fp, _anchor_batches(False), "anchor long, fp long, home boolean")
    met = materialize(join_hot(members, homes.select("anchor"), ["anchor"], homes, "left_semi"), "anchors")
    quarters = F.array(*(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF) + q * 0x10000 + 1 for q in range(4)))
    parts = F.when(F.col("size") > HOT_ANCHOR, quarters).otherwise(F.array(F.lit(0).cast("long")))
    parted = _sized(met, "anchor").select("anchor", "fp", "home", F.explode(parts).alias("part"))
    grid = F.ceil(F.col("size") / CELL).cast("long")
    spot = F.pmod(F.xxhash64("fp"), grid)
    lines = F.sequence(F.lit(0).cast("long"), grid - 1)
    cell = lambda across, down, role: F.struct(across.alias("across"), down.alias("down"), role.alias("role"))
    nought = F.lit(0).cast("long")
    whole = F.array(cell(nought, nought, F.when(F.col("home"), _HOME | _MEMBER).otherwise(_MEMBER)))
    as_member = F.transform(lines, lambda i: cell(i, spot, F.lit(_MEMBER)))
    as_home = F.when(F.col("home"), F.transform(lines, lambda i: cell(spot, i, F.lit(_HOME)))).otherwise(F.slice(as_member, 1, 0))
    cells = F.when(grid == 1, whole).otherwise(F.concat(as_member, as_home))
    placed = _sized(parted, "anchor", "part").select("anchor", "part", "fp", F.explode(cells).alias("c")).select("anchor", "part", "c.across", "c.down", "fp", "c.role")
    dealt = placed.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return arrow_pass(dealt, _link_batches, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every child has one root, which is no child."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("child")), F.struct(F.col("v").alias("x"), F.lit(0).alias("child")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.child").alias("roots"), F.min("e.child").alias("low"))
    return seen.filter("roots > 1 OR roots = 1 AND low = 0").isEmpty()


def stars(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """child, root: for every linked vertex but the roots, the smallest vertex of its component.

    Rounds of large-star and small-star; each is written, until the edges are stars.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _settled(edges):
            return edges.select(F.col("u").alias("child"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = materialize(join_hot(both.filter("v > u"), low.select("u", "m"), ["u"], low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
        small = join_hot(large, low.select("u", "m"), ["u"], low).select(F.explode(pairs).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        old, edges = (edges, large), materialize(small, "stars")
        for written in old:
            discard(written)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(docs: DataFrame, vertex: str, linked: DataFrame) -> DataFrame:
    """docs with `root`, the smallest vertex of the row's component, and component_id, the smallest doc_id of it.

    docs has doc_id and a column of vertices; linked has the child and root of every linked vertex but the roots.
    """
    own = materialize(docs.groupBy(F.col(vertex).alias("vertex")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "vertices")
    members = linked.unionByName(linked.select(F.col("root").alias("child"), "root").distinct())
    known = materialize(own.join(members, own["vertex"] == members["child"], "left").select("vertex", "first", "copies", F.coalesce("root", "vertex").alias("root")), "components")
    several = materialize(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).filter("n > 1"), "lowest")
    named = join_hot(known, several.drop("n"), ["root"], several, "left")
    whole = materialize(named.select(F.col("vertex").alias(vertex), "root", F.coalesce("component_id", "first").alias("component_id"), "copies"), "components")
    return join_hot(docs, whole.drop("copies"), [vertex], whole.withColumnRenamed("copies", "n"))


def similar_rows(documents: DataFrame) -> DataFrame:
    """doc_id, k1, k2, fp, root, component_id: one row per row of documents; groups for keep_first."""
    docs = materialize(fingerprints(documents), "fingerprints")
    return components(docs, "fp", stars(fingerprint_links(docs.select("fp").distinct())))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of documents."""
    return similar_rows(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of documents that stay: of each component the one with the smallest id, once.

    groups has doc_id, k1, k2 (the text's key), root and component_id; without it the components are those of
    near_duplicates. If several texts of a component share its smallest id, the one with the smallest key stays; of rows
    alike in id and text one stays. Rows without an id can't stand for a component; they are kept as they are.
    """
    row = ["doc_id", "k1", "k2"]
    groups = similar_rows(documents) if groups is None else groups
    found = materialize(groups.filter("doc_id is not null").select(*row, "root", "component_id"), "components")
    heads = found.filter("doc_id = component_id")
    crowded = materialize(heads.groupBy("root").count().filter("count > 1").select("root"), "crowded")
    mine = [F.col("doc_id").cast("long").alias("doc_id"), *content_key(F.col("text").cast("string"))]
    packed = documents.select(F.struct(*columns_of(documents)).alias("row"), *mine)
    gone = found.filter("doc_id <> component_id").select(*row)
    if crowded.isEmpty():
        gone = materialize(gone.distinct(), "gone", keep=True)
        return all_but(packed, gone, row).unionByName(only_some(packed, gone, row).join(gone, row, "left_anti")).select("row.*")
    counts = heads.join(crowded, "root").groupBy("root", *row).count()
    best = materialize(counts.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("k1", "k2"))), "heads")
    gone = materialize(gone.unionByName(best.filter("place > 1").select(*row)).distinct(), "gone", keep=True)
    again = materialize(best.filter("place = 1 AND count > 1").select(*row), "again", keep=True)
    once = only_some(packed, again, row).join(again, row, "left_semi").dropDuplicates(row)
    left = gone.unionByName(again)
    kept = all_but(packed, left, row).unionByName(only_some(packed, left, row).join(left, row, "left_anti"))
    return kept.select("row.*").unionByName(once.select("row.*"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """For tests: fingerprint and component of each id by comparing all pairs."""
    prints = [(i, simhash(t)) for i, t in rows]
    known = Forest(len(prints))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= MAX_BITS:
                known.join(i, j)
    lowest = reduce(lambda d, k: d | {known.root(k): min(d.get(known.root(k), prints[k][0]), prints[k][0])}, range(len(prints)), {})
    return {prints[k][0]: (f"{prints[k][1]:016x}", lowest[known.root(k)]) for k in range(len(prints))}
