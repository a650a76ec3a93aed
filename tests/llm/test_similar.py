import random

import numpy as np

import corpus_pipeline
from skarn.llm import common, minhash, similar


def _edited(rng: random.Random) -> list[tuple[int, str | None]]:
    words = [f"w{i}" for i in range(500)]
    rows: list[tuple[int, str | None]] = [(0, None), (1, " "), (2, "short"), (3, "Short"), (4, "x " * 9000)]
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([8, 9, 12, 30, 60, 200, 400]))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(i % 4):
            copy = list(text)
            for _ in range(max(1, len(text) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy + [rng.choice(words)] * (i % 2))))
    return rows


def test_anchors_cover_every_block():
    blocks = np.random.default_rng(1).integers(0, 1 << 23, 50_000, dtype=np.uint32)
    nearest = similar.nearest_anchor(blocks)
    assert int(np.bitwise_count(blocks ^ nearest).max()) == 3
    assert len(np.unique(similar.nearest_anchor(np.arange(1 << 16, dtype=np.uint32) << np.uint32(7)))) <= 4096
    assert (similar.nearest_anchor(nearest) == nearest).all()


def test_sets_at_the_threshold_meet_and_pass():
    rng, met = np.random.default_rng(2), []
    for common, only in [(4, 1), (12, 3), (16, 4), (80, 20), (800, 200)] * 40:
        hashes = rng.integers(0, 1 << 64, common + only, dtype=np.uint64)
        x, y = (similar.fingerprint(h) for h in (hashes[:common], hashes))
        shared = [(similar.anchors(x[None, i : i + 32]) == similar.anchors(y[None, i : i + 32])).sum() for i in range(0, min(len(x), len(y)), 32)]
        differ = int(np.bitwise_count((x[:32] ^ y[:32]).view(np.uint64)).sum())
        met.append(sum(shared) > 0 and (common < similar.SMALL or differ <= similar._most(2048, 0.8)))
    assert all(met)


def test_stage_finds_by_simhash_what_all_pairs_find(spark, monkeypatch):
    def not_this(*_):
        raise AssertionError("the stage's method is SimHash")

    rows = _edited(random.Random(5))
    want = {rows[i][0]: rows[c][0] for i, c in minhash.brute_force(rows).items()}
    monkeypatch.setattr(minhash, "similar_groups", not_this)
    frame = spark.createDataFrame([*rows, (None, rows[-1][1]), (7, rows[7][1])], "doc_id long, text string")
    kept = corpus_pipeline.one_of_each_group(spark, frame, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, set(want.values())), "None"])


def test_crowded_anchors(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(f"c{i}.{k}" if rng.random() < 0.02 else w for k, w in enumerate(base))) for i in range(40)] + _edited(rng)[5:60]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = {rows[i][0]: rows[c][0] for i, c in minhash.brute_force(rows).items()}
    for name, value in [("FEW_PAIRS", 1), ("PAIRS_A_MEMBER", 0), ("MORE_PIVOTS", 4)]:
        monkeypatch.setattr(similar, name, value)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    monkeypatch.setattr(similar, "CELL", 3)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows[:60], "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: rows[c][0] for i, c in minhash.brute_force(rows[:60]).items()}


def test_empty(spark):
    assert similar.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_are_parted_by_marks(spark):
    rows, some = spark.range(3000).selectExpr("id", "if(id = 7, null, id) as k"), spark.range(5, 60).selectExpr("if(id = 7, null, id) as k")
    may, others = ({r.id for r in f(rows, some, ["k"]).collect()} for f in (common.only_some, common.all_but))
    assert set(range(5, 60)) <= may and not may & others and may | others == set(range(3000)) and len(may) < 100


def test_pairs_within_a_component_are_not_compared_again(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long")
    linked = spark.createDataFrame([(2, 1), (3, 1)], "child long, root long")
    assert sorted(map(tuple, similar._across(pairs, linked).collect())) == [(3, 4), (8, 9)]
