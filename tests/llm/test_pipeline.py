import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skarn.llm import decontaminate, language, minhash, packing, pii
from skarn.llm.wordbpe import encoder

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r.asDict() for r in docs.collect()]
    model = language.fit(language.labelled_sample(docs))
    sources = [{"host": "s:" + r["source"], "domain": "", "suffix": "", "declared": r["lang"], "body": r["text"]} for r in rows]
    kept = [r for r, (name, p) in zip(rows, language.brute_force(sources, model), strict=True) if name != "und" and p >= language.MIN_POSTERIOR]
    kept.sort(key=lambda r: r["doc_id"])
    groups = minhash.brute_force([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for i, r in enumerate(kept) if groups[i] == i]
    clean = decontaminate.brute_force([(r["doc_id"], r["text"]) for r in kept], items)
    kept = [r for r, c in zip(kept, clean, strict=True) if not c[-1]]
    trees = pii.model()
    texts = {r["doc_id"]: pii.redacted(r["text"], [s for part in spans for s in part]) for r, spans in zip(kept, pii.spans_of([r["text"] for r in kept], *trees), strict=True)}
    assert 100 < len(kept) < len(rows)

    pieces: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    encode = encoder("word_bpe_49k.json").document
    for doc_id, own in pieces.items():
        ids, at = encode(texts[doc_id]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.frombuffer(ids, "<u4")[at : at + r.length].tobytes()) and r.length <= packing.WINDOW
            at += r.length
        assert at == len(ids) // 4


def test_stages_keep_columns(spark):
    rows = [(i, f"the of and in to that is {i} words of text number {i * 7919} here", "en", "s", 40, "extra") for i in range(30)] + [(None, None, None, None, None, None), (5, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").withColumns({"a.b`c": F.lit(1.5), "kept": F.lit(None).cast("string"), "fp": F.array(F.lit("x")), "clean": F.current_timestamp()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, SF)
        assert docs_after.columns == docs.columns
        docs = docs_after
    assert docs.count() > 0


def test_run_on_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [r.text for r in docs.orderBy("doc_id").collect() if r.lang == "en" and 300 < len(r.text) < 3000 and not any(c.isdigit() for c in r.text)]
    a, b, c = (" ".join(reversed(t.split())) for t in plain[:3])
    rows = [(900003, a), (900005, a), (900005, b), (900006, c), (900006, c), (900007, None), (900008, "")]
    odd = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).filter("doc_id >= 900000").collect()
    encode = encoder("word_bpe_49k.json").document
    assert sorted((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == [(i, len(encode(t)) // 4) for i, t in [(900003, a), (900005, b), (900006, c)]]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
