import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from skarn.llm import common, simhash


def _plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_against_plain():
    for text in (None, "", "  \n", "One", "One two", "Äé one two three", "a b c d " * 50):
        assert simhash.simhash(text) == _plain(text)


def test_anchors_cover_every_link():
    rng = random.Random(1)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << bit
        met = False
        for side in (0, 32):
            halves = np.array([(x >> side) & 0xFFFFFFFF, (y >> side) & 0xFFFFFFFF], dtype=np.uint64)
            anchors, there = simhash.half_anchors(halves)
            assert there[0].sum() in (2, 17)
            met |= anchors[0][0] in anchors[1][there[1]]
        assert met


def _labels(pairs, nodes):
    known = simhash.Forest(len(nodes))
    at = {n: i for i, n in enumerate(nodes)}
    for a, b in pairs:
        known.join(at[a], at[b])
    return [known.root(i) for i in range(len(nodes))]


def test_cell_links_connect_what_all_links_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << np.uint64(b)) for b in (1, 2, 17, 40, 63)] + [base ^ np.uint64(0x1F << 20)]))
    for homes in (prints, prints[::3], prints[:0]):
        for members in (prints, prints[1::2]):
            found = simhash.cell_links(homes, members)
            all_links = [(int(h), int(m)) for h in homes for m in members if h != m and int(h ^ m).bit_count() <= 3]
            assert {frozenset(x) for x in found} <= {frozenset(x) for x in all_links}
            nodes = [int(p) for p in prints]
            assert _labels(found, nodes) == _labels(all_links, nodes)
            assert len(found) < len(nodes)


def test_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "short"), (4, "x " * 9000)]
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(i % 4):
            copy = list(text)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    frame = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, fp int")
    want = simhash.brute_force(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)
    monkeypatch.setattr(simhash, "HOT_ANCHOR", 1)
    monkeypatch.setattr(simhash, "CELL", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()} == want
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component_id is None) for r in simhash.near_duplicates(frame).collect())
    assert got == [(False, False), (False, False), (True, False), (True, True)]
    assert sorted(str(r.doc_id) for r in simhash.keep_first(frame).collect()) == ["5", "None", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_repeated_ids_are_told_apart_by_text(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (6, c, "1"), (6, c, "2"), (7, a, "v"), (8, b, "w"), (None, a, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, note string")
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_first(frame).collect())
    assert kept == [("3", a), ("5", b), ("6", c), ("None", a)]


def test_several_texts_of_the_smallest_id(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = next(t for i in range(400) if simhash.simhash(t := text.replace(f"w{i}", "x", 1)) != simhash.simhash(text) and (simhash.simhash(t) ^ simhash.simhash(text)).bit_count() <= 3)
    frame = spark.createDataFrame([(5, text), (5, near), (5, near), (9, text)], "doc_id long, text string")
    kept = simhash.keep_first(frame).collect()
    assert [r.doc_id for r in kept] == [5]


def test_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    large = spark.createDataFrame([(1, "same")] * 50 + [(2, "b")] * 4 + [(3, "c"), (4, "d")], "k long, v string").repartition(5)
    small = spark.createDataFrame([(1, 10), (3, 30), (2, 20)], "k long, w long")
    counts = large.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        want = sorted(map(repr, large.join(small, "k", how).collect()))
        joined = common.join_hot(large, small, ["k"], counts, how)
        assert sorted(map(repr, joined.collect())) == want
    copies = common.join_hot(large.withColumn("part", F.spark_partition_id()), small.withColumn("s", F.lit(1)), ["k"], counts)
    assert copies.count() == 55


def test_stars_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.child: r.root for r in simhash.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200, 202: 200}
    assert simhash.stars(spark.createDataFrame([], "a long, b long")).count() == 0
