import io
import random
import zlib

import numpy as np
import pytest
import zstandard

from skarn.llm import common, packing, tokenfile, unigram, wordbpe

ODD = [
    None, "", " ", "a", "It's the END, isn't it? 'tis we'll", "Äé ÑANDÚ d'été. ÉCOLE, ½ ² x1y22 İstanbul ſtraße ŉ",
    "é Á, ́x 한글 조합 漢字 Σίσυφος ΣΑΣ", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> <| |>", "a\x00b \x1c\x1d \x85\xa0 z ​",
    "tabs\tand\nnew\r\nlines\x0b\x0c.", "٣٤ १२ Ⅷ ªº", "😀😀 x😀y", "_under_score_ -- ... ,;", "w" * 5000, "▁ a▁b▁▁c ▁", "<0x41> <unk> </s>",
]


def _random_texts(n, seed=5):
    rng = random.Random(seed)
    letters = "abcdeTHing.,'0 9 \n\té Ö ß́一<|>▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordbpe.resolve(wordbpe.DEFAULT_TOKENIZER))


def test_ids_equal_library(library):
    mine = wordbpe.WordEncoder(wordbpe.DEFAULT_TOKENIZER, kept=50)
    for text in ODD + _random_texts(1500):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want, repr(text)


def test_counts_equal_library():
    whole = unigram.library_tokenizer()
    mine = unigram.Counter(unigram.zipf_scores(unigram.pieces_of(unigram.DEFAULT_PIECES)), kept=50)
    for text in ODD + _random_texts(1500, 6):
        assert mine.count(text) == len(whole.encode(text or "", add_special_tokens=False).ids), repr(text)


def test_ties_go_to_longest_last_piece():
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), ("a", -2.0), ("aa", -2.0), ("b", -1.0), ("ab", -3.0), ("aab", -4.0), ("ba", -3.0)]
    mine, theirs = unigram.Counter(vocab), Tokenizer(models.Unigram(vocab, unk_id=0))
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        assert mine.viterbi(word) == len(theirs.encode(word).ids), word


def _check_packing(rows, library, window=packing.WINDOW):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
    fill = [sum(r.length for r in own) for own in sequences.values()]
    padded = sum(window - n for n in fill if n & (n - 1))
    return docs, padded / max(1, sum(fill))


def test_packing(spark, library):
    rng = random.Random(3)
    words = "the quick brown fox jumps over a lazy dog".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 700, 5000]))) for _ in range(150)] + [None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("x", "y").repartition(7)
    rows = packing.pack(frame, open_windows=3).collect()
    docs, padding = _check_packing(rows, library)
    assert padding < 0.02
    assert len(docs) == len(texts)
    for (doc_id, total), own in docs.items():
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1]
        assert total == len(ids)
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == total
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (4, "same", 1), (4, "same", 1), (5, "w" * 9000, 2)], "doc_id long, text string, sequence_id int")
    assert sorted(map(str, (r.doc_id for r in packing.pack(odd).filter("start = 0").collect()))) == ["4", "4", "5", "None"]


def test_packing_in_rounds(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    frame = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(300)], "doc_id long, text string").repartition(9)
    rows = packing.pack(frame, window=64, open_windows=2, min_cut=1).collect()
    _, padding = _check_packing(rows, library, 64)
    assert padding == 0 and sum(r.length for r in rows) == sum(i % 90 + 1 for i in range(300))


def test_packer_keeps_its_bound():
    packer, rng = packing.Packer(64, 4, 8), random.Random(1)
    for i in range(500):
        packer.add(i, 0, b"\1\0\0\0" * rng.randint(1, 200), 0)
        assert len(packer.open) <= 4
    packer.finish()
    fill = [sum(len(p[2]) // 4 for p in w) for w in packer.closed]
    assert all(n <= 64 for n in fill) and sum(64 - n >= 8 and n & (n - 1) > 0 for n in fill) == 0


def test_file_round_trip():
    sink, rng = io.BytesIO(), np.random.default_rng(1)
    docs = [(3, rng.integers(0, 49408, 5)), (None, np.array([1])), (9, rng.integers(0, 49408, 40000)), (9, np.array([2, 1]))]
    writer = tokenfile.Writer(sink)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    reader = tokenfile.Reader(sink)
    assert reader.doc_ids == [3, None, 9, 9]
    for k, (_, ids) in enumerate(docs):
        assert reader.document(k).tolist() == ids.tolist()
    assert [ids.tolist() for _, ids in reader.find([3])] == [docs[0][1].tolist()]
    data = bytearray(sink.getvalue())
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data)), read_across_frames=True).read()
    assert plain == b"".join(ids.astype("<u2").tobytes() for _, ids in docs)
    data[int(reader.places[2]) + 2000] ^= 1
    broken = tokenfile.Reader(io.BytesIO(bytes(data)))
    assert broken.document(0).tolist() == docs[0][1].tolist()
    with pytest.raises((tokenfile.Corrupt, zstandard.ZstdError)):
        broken.document(2)
    for bad in (b"", b"too short", b"x" * 40):
        with pytest.raises(tokenfile.Corrupt):
            tokenfile.Reader(io.BytesIO(bad))


def test_token_files(spark, library):
    rows = [(9, "the end"), (2, None), (5, "a b c"), (5, "a b c"), (5, "a a"), (None, "x"), (700, "long " * 3000), (-4, "neg")]
    rows += [(1000 + i, f"doc {i}") for i in range(200)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    got = sorted((r for r in tokenfile.token_files(frame).collect()), key=lambda r: r.start)
    at = 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.token_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts(spark):
    frame = spark.createDataFrame([(1, "Hello world"), (None, None), (1, "Hello world"), (2, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_tokens) for r in unigram.token_counts(frame).collect())
    n = len(unigram.library_tokenizer().encode("Hello world").ids)
    assert got == [("1", n), ("1", n), ("2", 0), ("None", 0)]


def test_ids_of_a_large_vocabulary_keep_their_width(tmp_path):
    with pytest.raises(ValueError):
        tokenfile.Writer(io.BytesIO()).add(1, np.array([1, 70_000]))
    sink = io.BytesIO()
    writer = tokenfile.Writer(sink, 4)
    writer.add(1, np.array([1, 70_000]))
    writer.close()
    assert tokenfile.Reader(sink).document(0).tolist() == [1, 70_000]


def test_files_deal_rows_of_one_id(spark, tmp_path):
    frame = spark.createDataFrame([(None, "same text", "x")] * 40 + [(None, f"text {i}", "x") for i in range(40)] + [(2, "b", "y"), (1, "a", "z")], "doc_id long, text string, n_tokens string").repartition(6)
    folder = f"file://{tmp_path}/tokens"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = tokenfile.write_files(frame, folder)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 2 and max(r.n_docs for r in manifest.collect()) < 60
    rows = sorted(tokenfile.read_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 80 + [1, 2]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert not [x for x in (tmp_path / "tokens").iterdir() if x.name.startswith(".part")]


def test_long_texts_pack_in_linear_time():
    import time

    began = time.perf_counter()
    packer = packing.Packer()
    packer.add(1, 0, b"\1\0\0\0" * 8_000_000, 8_000_000)
    assert time.perf_counter() - began < 3 and sum(len(p[2]) // 4 for w in packer.closed for p in w) + sum(len(p[2]) // 4 for w in packer.open for p in w[1]) == 8_000_000


def test_counts_of_odd_tables(spark):
    frame = spark.createDataFrame([(1, "a b", 9), (None, None, 9), (1, "a b", 9), (2, "w" * 20_000, 9)], "doc_id long, text string, n_tokens int")
    got = unigram.token_counts(frame).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got)[0] == 0
    assert unigram.token_counts(frame.limit(0)).count() == 0


def test_small_files_share_tables_and_tasks(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(64)], "doc_id long, text string").repartition(6)
    folder = f"file://{tmp_path}/tokens"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = tokenfile.write_files(frame, folder)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 2 and len(manifest.inputFiles()) == 1
    rows = tokenfile.read_files(manifest, folder)
    assert rows.rdd.getNumPartitions() == 1 and sorted(r.doc_id for r in rows.collect()) == list(range(64))


def test_a_worker_drops_what_another_operator_kept():
    wordbpe.encoder.cache_clear()
    common.begin("packing")
    wordbpe.encoder(wordbpe.DEFAULT_TOKENIZER).document("a b")
    common.begin("packing")
    assert wordbpe.encoder.cache_info().currsize == 1
    common.begin("similar")
    assert wordbpe.encoder.cache_info().currsize == 0


def test_batches_from_spark_are_small(spark):
    import pyarrow as pa

    def buffers(batches):  # of the whole batch that Spark sent, not of the part cut from it
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.get_total_buffer_size()], pa.int64())], names=["n"])

    frame = spark.range(0, 6000, 1, 1).selectExpr("repeat('word ', 1000) AS text")
    assert max(r.n for r in common.arrow_pass(frame, buffers, "n long").collect()) < 3 * common.BATCH_BYTES
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "100k")  # a session's own bound holds
        assert max(r.n for r in common.arrow_pass(frame, buffers, "n long").collect()) < 300_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_word_cache_is_bounded_by_bytes(library):
    mine = wordbpe.WordEncoder(wordbpe.DEFAULT_TOKENIZER, kept_bytes=100_000)
    for i in range(40):
        text = " ".join(f"{i:02}{k:03}" + "7" * 55 for k in range(50))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        for kept in (mine, mine.old):
            assert sum(len(c) + len(ids) for c, ids in kept.items()) <= 100_000 + 400
    assert mine.old
