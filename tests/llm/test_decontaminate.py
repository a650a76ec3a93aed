import random

import duckdb

from skarn.llm import decontaminate
from skarn.llm.queries import queries

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _fixture():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)] + ["Éa", "x-y"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([30, 10, 11, 9, 4, 1, 12, 25, 14])] + [(20, None), (21, " .,"), (1, "dup "), (None, "no name item of more than ten words is here and on")]
    items += [(30, "same " * 14), (31, items[0][1])]
    docs = [(0, None), (1, ""), (2, "same " * 40), (3, "no name item of more than ten words is here and on")]
    for i in range(60):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            text = (rng.choice(items)[1] or "").split()
            parts += [" ".join(text[rng.randint(0, 3) :][: rng.randint(5, 40)]).upper(), say(rng.randint(0, 20))]
        docs.append((100 + i, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs + docs[:5], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = _fixture()
    want = sorted(map(repr, decontaminate.brute_force(docs, items)))
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, hits int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame, bench).select(COLUMNS).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontaminate, "_SLICE_WORDS", 100)
    monkeypatch.setattr(decontaminate, "_PAIRS", 5)
    live = []
    send = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: live.append(send(x)) or live[-1])
    assert sorted(repr(tuple(r)) for r in decontaminate.contamination(frame, bench).select(COLUMNS).collect()) == want
    assert len(live) > 6 and sum(b._jbroadcast.isValid() for b in live) == 1
    kept = decontaminate.keep_clean(frame, bench)
    assert kept.columns == frame.columns
    clean = {repr(d) for d, w in zip(docs, decontaminate.brute_force(docs, items), strict=True) if not w[-1]}
    assert {repr((r.doc_id, r.text)) for r in kept.collect()} == clean


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(docs, none).collect()] == [0]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({decontaminate.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in queries()["op8_decontaminate"](spark, sf).select(COLUMNS).collect())
    assert got == want and any(r[-1] for r in got)
