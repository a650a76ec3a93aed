import random

import duckdb

from skarn.llm import quality
from skarn.llm.queries import queries


def _plain(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_counts_against_plain(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a\x1cb\x85c d", "x\n\nx\nx \n x", "😀 # é"] + ["w " * n for n in (7, 8, 9, 25)]
    for _ in range(40):
        texts.append("".join(rng.choice(["a", "b", "the ", " ", "\n", "#", "é", ". "]) for _ in range(rng.randint(0, 160))))
    frame = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(None, None, False)], "doc_id long, text string, kept boolean")
    rows = quality.judge(frame).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r)[1:7] == _plain(texts[r.doc_id]), repr(texts[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality.judge(frame.limit(0)).count() == 0


def test_verdict(spark):
    prose = "the cat sat on the mat and it was warm in there for all of us to see what came by that day at home"
    bad = [" ".join(w + "***" for w in prose.split()), prose.upper(), " ".join(w for w in prose.split() for _ in range(3)), " | ".join(w * 3 for w in "alpha beta gamma delta".split() * 3) + " x y z w v u t s r q"]
    rows = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(list(enumerate([prose, *bad])), "doc_id long, text string")).collect()}
    assert rows == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    counts = queries()["op2_quality"](spark, sf).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in counts}
    assert n[1, True] > 50 * n.get((1, False), 0)
    assert n[0, False] > 10 * n.get((0, True), 0)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    frame = queries()["op2_quality"](spark, sf)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        assert sorted(db.execute(quality.ORACLE).fetchall()) == sorted(tuple(r) for r in frame.collect())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
