import random

import corpus_pipeline
from skarn.llm import common, minhash, simhash


def test_near_copies_with_edits_go(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "Short"), (4, "x " * 9000), (5, "one two three four"), (6, "one  two three four")]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(i % 5):
            copy = list(text)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    base = [f"v{i}" for i in range(200)]  # a chain: each within the threshold of the next, the ends far apart
    for i in range(12):
        rows.append((len(rows), " ".join(f"z{k}" if k < 12 * i else w for k, w in enumerate(base))))
    frame = spark.createDataFrame([*rows, (None, rows[-1][1]), (7, rows[7][1])], "doc_id long, text string")
    want = {rows[i][0]: rows[c][0] for i, c in minhash.brute_force(rows).items()}
    got = minhash.similar_groups(frame).collect()
    assert len(got) == len(rows) + 1 and {r.doc_id: r.component_id for r in got} == want
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(minhash, "MORE_PIVOTS", 4)
    kept = corpus_pipeline.one_of_each_group(spark, frame, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, set(want.values())), "None"])
    assert len(set(want.values())) < len({c for _, c in simhash.brute_force(rows).values()})


def test_empty(spark):
    assert minhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
