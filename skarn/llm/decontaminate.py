r"""Benchmark decontamination by a prefix-filtered set join.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item's windows are its runs of ten
words, or the whole item if shorter. A window is a set of shingles (five words, or the whole window if shorter) at
fixed places. As a window must be contained whole, one prefix shingle of it is enough to find it: the rarest over
all documents, counted in a first pass. The second pass joins only those prefix shingles with the documents' shingles;
a match gives the place that the window would have, which must lie inside the document (length and positional
bounds), and the window's words are then compared exactly.

The items are taken in blocks of at most BLOCK_WORDS words (an item may pass that bound by its own length). Each block's
index is broadcast, used and destroyed before the next, so what is broadcast and what a worker holds is bounded
however many items there are, and every block is held against every document. A single block is one scan that reports at
once; with more, each block's hits are written by text key, and joined with the documents' narrow columns at the end.
Documents are never shuffled by a single block. The shingle counts are, one row per shingle of the block and task at most.

Defined cases: a null or wordless text has no words and no hit; a null or wordless item has no window; an item
without an id marks words but is not listed; repeated items count once; repeated rows and ids of documents give a row
each; very long texts are compared whole, _SLICE_WORDS words or one text at a time; an empty table on either side gives
no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import arrow_pass, columns_of, content_key, join_hot, materialize

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
BLOCK_WORDS = 500_000
_SLICE_WORDS = 1_000_000
#: Pairs of a place and a window that are verified at a time.
_PAIRS = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters in lower case, digits as they are, other ASCII bytes to spaces; bytes of other characters stay.
_WORD_BYTES = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` ids."""
    n = len(ids) - size + 1
    out = np.full(max(0, n), size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * _PRIME + ids[k : k + len(out)]
    return out


class Index:
    """The windows of a block of items, their shingles and, once rarity is known, their prefixes."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        known: dict[tuple, int] = {}
        self.windows: list[np.ndarray] = []
        self.items: list[set] = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for at in range(max(1, len(ids) - WINDOW_WORDS + 1)) if ids else ():
                key = tuple(ids[at : at + WINDOW_WORDS])
                if key not in known:
                    known[key] = len(self.windows)
                    self.windows.append(np.array(key, dtype=np.uint64))
                    self.items.append(set())
                self.items[known[key]].add(name)
        hashes = {}
        for w in self.windows:
            size = min(SHINGLE_WORDS, len(w))
            hashes.setdefault(size, []).append(_rolled(w, size))
        #: By shingle size: the distinct hashes, sorted.
        self.shingles = {size: np.unique(np.concatenate(h)) for size, h in hashes.items()}

    def __getstate__(self) -> dict:
        """What tasks need: without the windows as objects, about 200 bytes a window."""
        return self.__dict__ | {"windows": None, "items": [tuple(names) for names in self.items]}

    def places(self) -> dict[int, int]:
        """Where each size's shingles begin in one numbering of all."""
        out, at = {}, 0
        for size in sorted(self.shingles):
            out[size] = at
            at += len(self.shingles[size])
        return out

    def set_prefixes(self, counts: dict[int, int]) -> None:
        """counts: documents' occurrences by shingle number. A window's prefix is its rarest shingle, the first of equals."""
        place, by_size = self.places(), {}
        for k, w in enumerate(self.windows):
            size = min(SHINGLE_WORDS, len(w))
            numbers = np.searchsorted(self.shingles[size], _rolled(w, size))
            offset = min(range(len(numbers)), key=lambda o: (counts.get(place[size] + int(numbers[o]), 0), o))
            by_size.setdefault((size, len(w)), []).append((int(numbers[offset]), k, offset))
        #: By shingle size and window length: sorted prefix hashes, and for each a run of (window, offset).
        self.prefixes = {}
        for (size, length), rows in by_size.items():
            rows.sort()
            number, window, offset = (np.array(x) for x in zip(*rows, strict=True))
            own, first = np.unique(number, return_index=True)
            self.prefixes[size, length] = (self.shingles[size][own], np.append(first, len(rows)), window, offset, np.stack([self.windows[k] for k in window]))


def _slices(texts: pa.Array) -> Iterator[tuple[list[list[bytes]], int]]:
    """Runs of documents of bounded size, as lists of words."""
    out, n, first = [], 0, 0
    for k, text in enumerate(texts):
        out.append(words_of(text.as_py()))
        n += len(out[-1])
        if n >= _SLICE_WORDS:
            yield out, first
            out, n, first = [], 0, k + 1
    if out:
        yield out, first


def _numbered(docs: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids, 0 for a word of no item and after each document; and where the documents begin."""
    sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs)) + 1
    starts = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), dtype=np.uint64)
    for words, at in zip(docs, starts.tolist(), strict=True):
        ids[at : at + len(words)] = np.fromiter(map(vocabulary.get, words, repeat(0)), dtype=np.uint64, count=len(words))
    return ids, starts


def _candidates(ids: np.ndarray, size: int) -> np.ndarray:
    """Places where `size` words in a row are words of items."""
    run = np.cumsum(np.append(0, ids > 0))
    return np.flatnonzero(run[size:] - run[:-size] == size)


def _found(ids: np.ndarray, places: np.ndarray, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places, those whose shingle is wanted, and which it is."""
    h = np.full(len(places), size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _PRIME + ids[places + k]
    at = np.searchsorted(wanted, h)
    at[at == len(wanted)] = 0
    good = wanted[at] == h
    return places[good], at[good]


def _count_batches(index_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        place = index.places()
        counts = np.zeros(sum(map(len, index.shingles.values())), dtype=np.int64)
        for batch in batches:
            for docs, _ in _slices(batch.column(0)):
                ids, _ = _numbered(docs, index.vocabulary)
                for size, wanted in index.shingles.items():
                    _, which = _found(ids, _candidates(ids, size), size, wanted)
                    counts[place[size] : place[size] + len(wanted)] += np.bincount(which, minlength=len(wanted))
        number = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(counts[number])], names=["shingle", "n"])

    return run


def _matches(ids: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window number, start and length of every occurrence, each compared word by word."""
    out = [[np.zeros(0, np.int64)] * 3]
    near = {size: _candidates(ids, size) for size in {s for s, _ in index.prefixes}}
    for (size, length), (wanted, first, window, offset, words) in index.prefixes.items():
        every, which_of = _found(ids, near[size], size, wanted)
        part = np.cumsum(first[which_of + 1] - first[which_of]) // _PAIRS
        for cut in np.split(np.arange(len(every)), np.flatnonzero(np.diff(part)) + 1):
            places, which = every[cut], which_of[cut]
            n = first[which + 1] - first[which]
            entry = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = np.repeat(places, n) - offset[entry]
            inside = (start >= 0) & (start + length <= len(ids))
            start, entry = start[inside], entry[inside]
            for k in range(length):
                same = ids[start + k] == words[entry, k]
                start, entry = start[same], entry[same]
            out.append([window[entry], start, np.full(len(start), length)])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hits(texts: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Of each text with a hit: its number, the places (begin, end) of its hits and the items' names."""
    for docs, first in _slices(texts):
        ids, starts = _numbered(docs, index.vocabulary)
        window, start, length = _matches(ids, index)
        doc = np.searchsorted(starts, start, side="right") - 1
        order = np.argsort(doc, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
            begin = start[own] - starts[doc[own[0]]]
            names = set().union(*(index.items[w] for w in set(window[own].tolist()))) - {None}
            yield first + int(doc[own[0]]), np.unique(np.stack([begin, begin + length[own]], axis=1), axis=0), sorted(names)


_REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def _report(n: int, hits: np.ndarray, items: list[str]) -> tuple:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hits[:, 0], 1)
    np.add.at(edge, hits[:, 1], -1)
    hit = int((np.cumsum(edge) > 0).sum())
    return n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, items


def _rows(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


_NO_HITS = np.zeros((0, 2), dtype=np.int64)


def _report_batches(index_of):
    """Documents (doc_id, text) to reports, by one index or by none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k: (hits, names) for k, hits, names in _hits(batch.column(1), index_of.value)} if index_of else {}
            yield _rows(batch.column(0), [_report(len(words_of(t.as_py())), *found.get(k, (_NO_HITS, []))) for k, t in enumerate(batch.column(1))])

    return run


def _hit_batches(index_of):
    """Texts (k1, k2, text) to the hits of those that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [*_hits(batch.column(2), index_of.value)]
            at = pa.array([k for k, _, _ in found], pa.int64())
            columns = [pa.array([h.astype("<i8").tobytes() for _, h, _ in found], pa.binary()), pa.array([n for _, _, n in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["k1", "k2", "hits", "items"])

    return run


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words and the hits and items of all blocks to reports."""
    for batch in batches:
        rows = []
        for n, hits, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            places = np.frombuffer(b"".join(hits or ()), "<i8").reshape(-1, 2)
            rows.append(_report(n, places, sorted(set().union(*(items or ())))))
        yield _rows(batch.column(0), rows)


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], words_of(row[1])))
        n += len(block[-1][1]) + 1
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def indexes(documents: DataFrame, benchmark: DataFrame) -> Iterator:
    """For each block of items with a window, its broadcast index with prefixes chosen by the corpus counts, and whether it is the only one.

    An index is destroyed when the next is asked for; what uses it must be written by then.
    """
    context = documents.sparkSession.sparkContext
    texts = documents.select(F.col("text").cast("string"))
    with_windows = (index for index in map(Index, _blocks(benchmark)) if index.windows)
    index, first = next(with_windows, None), True
    while index:
        sent = context.broadcast(index)
        counts = arrow_pass(texts, _count_batches(sent), "shingle long, n long").groupBy("shingle").agg(F.sum("n"))
        index.set_prefixes(dict(map(tuple, counts.collect())))  # at most one row per shingle of the block
        sent.destroy()
        sent, index = context.broadcast(index), None
        index = next(with_windows, None)
        yield sent, first and index is None
        first = False
        if index:
            sent.destroy()


def _hits_by_text(documents: DataFrame, benchmark: DataFrame) -> tuple:
    """The index of a single block, or the written hits of several, by text key: (index, None) or (None, hits); None twice without any."""
    text, written = F.col("text").cast("string"), []
    for index, alone in indexes(documents, benchmark):
        if alone:
            return index, None
        found = arrow_pass(documents.select(*content_key(text), text), _hit_batches(index), "k1 long, k2 long, hits binary, items array<string>")
        written.append(materialize(found.dropDuplicates(["k1", "k2"]), "benchmark-hits"))
    return None, reduce(DataFrame.unionByName, written) if written else None


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items: a row per row of documents."""
    text = F.col("text").cast("string")
    index, hits = _hits_by_text(documents, benchmark)
    if hits is None:
        return arrow_pass(documents.select(F.col("doc_id").cast("long"), text), _report_batches(index), f"doc_id long, {_REPORT}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([len(words_of(t.as_py())) for t in batch.column(3)], pa.int64())], names=["doc_id", "k1", "k2", "n_words"])

    narrow = materialize(arrow_pass(documents.select(F.col("doc_id").cast("long"), *content_key(text), text), counted, "doc_id long, k1 long, k2 long, n_words long"), "word-counts")
    of_text = materialize(hits.groupBy("k1", "k2").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items")), "benchmark-hits")
    joined = join_hot(narrow, of_text, ["k1", "k2"], narrow.groupBy("k1", "k2").agg(F.count("*").alias("n")), "left")
    return arrow_pass(joined.select("doc_id", "n_words", "hits", "items"), _join_batches, f"doc_id long, {_REPORT}")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents without a hit, with all their columns; by a single block one scan and no shuffle."""
    row, text = F.struct(*columns_of(documents)).alias("row"), F.col("text").cast("string").alias("text")
    index, hits = _hits_by_text(documents, benchmark)
    if hits is not None:
        gone = materialize(hits.select("k1", "k2").distinct(), "benchmark-rejects")
        return documents.select(row, *content_key(text)).join(gone, ["k1", "k2"], "left_anti").select("row.*")
    if index is None:
        return documents
    packed = documents.select(row, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[k for k, _, _ in _hits(batch.column(1), index.value)]] = False
            yield batch.filter(pa.array(clean)).select([0])

    return arrow_pass(packed, run, T.StructType([packed.schema["row"]])).select("row.*")


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """For tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by plain search."""
    out = []
    windows = [(i, w[a : a + 10]) for i, t in items if (w := words_of(t)) for a in range(max(1, len(w) - 9))]
    for doc_id, text in docs:
        words, hit, names = words_of(text), set(), set()
        for name, w in windows:
            for a in range(len(words) - len(w) + 1):
                if words[a : a + len(w)] == w:
                    hit.update(range(a, a + len(w)))
                    names.add(name)
        names = sorted(str(n) for n in names if n is not None)
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


#: DuckDB SQL of the query's rows.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
