"""Packing documents into training sequences with bounded-space online packing.

Each task keeps a fixed number of open windows. A document's full windows are cut off at once; what is left goes to
the open window that it fits best. When it fits none, the fullest window is emitted; if its gap is worth a cut, the
start of the document fills it first. What stays open at a task's end is merged in rounds, each packing the leftovers
of up to FAN tasks by the same rule, until one is left; its windows are joined, and the last rest is cut into powers
of two, which need no padding. Leftovers are bounded by the open windows of a task, whatever the corpus.

Each round is written to the shared folder before the next reads it, so a lost executor can't pack a task anew in
another order.

Defined cases: null and empty texts are one end id; repeated rows and ids are packed as often as they come; a null
doc_id stays null; very long texts are cut in one walk over their ids; of windows that a rest fits equally well the one
opened first takes it; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_pass, materialize
from skarn.llm.wordbpe import DEFAULT_TOKENIZER, encoder

WINDOW = 2048
OPEN_WINDOWS = 16
MIN_CUT = 16
FAN = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task")] + [("ids", pa.binary())])


class Packer:
    """Pieces are (doc_id, start, ids as bytes, doc_tokens); windows are lists of pieces."""

    def __init__(self, size: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT):
        self.size, self.most, self.min_cut = size, open_windows, min_cut
        self.open: list[list] = []  # [free, pieces]
        self.closed: list[list[tuple]] = []

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        width = 4 * self.size
        whole = len(ids) // width * width
        self.closed += [[(doc_id, start + at // 4, ids[at : at + width], doc_tokens)] for at in range(0, whole, width)]
        start, ids = start + whole // 4, ids[whole:]
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] >= n]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                self.open.append(best := [self.size, []])
            else:
                best = min(self.open, key=lambda w: w[0])
                if best[0] < self.min_cut:
                    self._close(best)
                    continue
                n = best[0]
            best[1].append((doc_id, start, ids[: 4 * n], doc_tokens))
            best[0] -= n
            start, ids = start + n, ids[4 * n :]
            if not best[0]:
                self._close(best)

    def _close(self, window: list) -> None:
        self.closed.append(window[1])
        self.open = [w for w in self.open if w is not window]

    def taken(self) -> list[list[tuple]]:
        done, self.closed = self.closed, []
        return done

    def finish(self) -> None:
        """Join the open windows into full ones; cut the last rest into powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open = []
        left = sum(len(p[2]) // 4 for p in pieces)
        sizes = [self.size] * (left // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if (left % self.size) >> b & 1]
        for size in sizes:
            window, room = [], size
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                n = min(room, len(ids) // 4)
                window.append((doc_id, start, ids[: 4 * n], total))
                room -= n
                if 4 * n < len(ids):
                    pieces.insert(0, (doc_id, start + n, ids[4 * n :], total))
            self.closed.append(window)


def _rows(windows: list[list[tuple]], first: int, task: int, keep_ids: bool) -> pa.RecordBatch:
    rows = []
    for k, window in enumerate(windows):
        at = 0
        for doc_id, start, ids, total in window:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, first + k, at, task, ids if keep_ids else None))
            at += len(ids) // 4
    columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _pack(pieces: Iterator[Iterator[tuple]], round_no: int, last: bool, sizes: tuple) -> Iterator[pa.RecordBatch]:
    """Closed windows without their ids, then the open ones with them."""
    task = TaskContext.get().partitionId()
    packer, first = Packer(*sizes), (round_no << 58) + (task << 32)
    for batch in pieces:
        for piece in batch:
            packer.add(*piece)
            if len(packer.closed) >= 512:
                windows = packer.taken()
                yield _rows(windows, first, task, False)
                first += len(windows)
    if last:
        packer.finish()
    windows = packer.taken()
    yield _rows(windows, first, task, False)
    yield _rows([w[1] for w in packer.open], first + len(windows), task, True)


def _documents(tokenizer: str, sizes: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document = encoder(tokenizer).document

        def pieces(batch):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = document(text.as_py())
                yield doc_id, 0, ids, len(ids) // 4

        return _pack(map(pieces, batches), 0, False, sizes)

    return run


def _leftovers(round_no: int, last: bool, sizes: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True) for batch in batches)
        return _pack(pieces, round_no, last, sizes)

    return run


def pack(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    sizes = (window, open_windows, min_cut)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    done = [materialize(arrow_pass(texts, _documents(tokenizer, sizes), SCHEMA), "packed")]
    tasks = (done[-1].agg(F.max("task")).first()[0] or 0) + 1
    last = False
    while not last:
        tasks = -(-tasks // FAN)
        last = tasks == 1
        rest = done[-1].filter("ids is not null").withColumn("bucket", F.expr(f"task div {FAN}"))
        dealt = rest.repartition(tasks, "bucket").sortWithinPartitions("bucket", "task", "sequence_id", "offset").drop("bucket")
        done.append(materialize(arrow_pass(dealt, _leftovers(len(done), last, sizes), SCHEMA), "merged"))
        tasks = max(tasks, 1)
    closed = [d.filter("ids is null").drop("task", "ids") for d in done]
    return reduce(DataFrame.unionByName, closed)
