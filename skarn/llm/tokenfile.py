"""Token-id files: one independent zstandard frame per document, a trailing seek table, a checksum per frame.

Layout of a file, all little-endian, readable by any zstandard decoder:

- a frame per document, its ids as unsigned 16- or 32-bit integers;
- a skippable frame with the documents: flags (bit 0: id is null), doc_ids, id width;
- the seek table of the public seekable format, a skippable frame: per frame its compressed size, its size and the low
  32 bits of the XXH64 of its content; then the number of frames, a descriptor byte and the magic number.

A reader loads the two tables from the end and decompresses the frames of the documents asked for, no others.
Files are written in ascending doc_id order (equal ids by the first HEAD_CHARS characters of the text, null ids first), one per range partition, under a
temporary name and then renamed, so that a task that runs again replaces its own file; what failed attempts leave is
removed at the end. Ranges go on below the id, by the text's head and hash and the row's place, so the rows of an id that
many share are dealt over many files. The width of an id follows from the tokenizer's vocabulary; an id that is wider than its
field is an error. File number k is followed by
file k + 1; the manifest has each file's documents and tokens, from which the place of a document among all ids comes.

Defined cases: null and empty texts are one end id; repeated rows are written as often as they come; a very long text is
one frame; an empty table gives an empty manifest and no row; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import arrow_pass, filesystem, fresh_dir, materialize
from skarn.llm.wordbpe import DEFAULT_TOKENIZER, encoder

#: Fixed values of the public zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
LEVEL = 3
#: Rows of equal ids are in the order of so many characters of their texts.
HEAD_CHARS = 64
#: Small files are read several to a task, so that each has so many tokens or so.
TASK_TOKENS = 1 << 19
MANIFEST = "part long, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Corrupt(ValueError):
    """A frame whose content doesn't have its checksum, or a file without its tables."""


class Writer:
    """Streams documents into a file; keeps a few numbers per document for the tables."""

    def __init__(self, sink, width: int = 2, level: int = LEVEL):
        self.sink, self.width = sink, width
        self.press = zstandard.ZstdCompressor(level=level)
        self.frames, self.ids, self.flags, self.tokens = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} needs more than {self.width} bytes")
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.press.compress(raw)
        self.sink.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id or 0)
        self.flags.append(doc_id is None)
        self.tokens += len(ids)

    def close(self) -> None:
        n = len(self.frames)
        index = struct.pack("<IB", n, self.width) + np.array(self.flags, "u1").tobytes() + np.array(self.ids, "<i8").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", n, CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Random access to a file that can be sought."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END)
        if end < 9:
            raise Corrupt("no seek table")
        n, flag, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise Corrupt("no seek table")
        table = end - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(n, 3)
        self.places = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        head = int(self.places[-1]) + 8
        found, self.width = struct.unpack("<IB", self._at(head, 5))
        if found != n:
            raise Corrupt("the tables differ")
        flags = np.frombuffer(self._at(head + 5, n), "u1")
        ids = np.frombuffer(self._at(head + 5 + n, 8 * n), "<i8")
        self.doc_ids = [None if f else int(i) for f, i in zip(flags, ids, strict=True)]
        self.counts = self.frames[:, 1] // self.width
        self.open = zstandard.ZstdDecompressor()

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int) -> np.ndarray:
        """The ids of document number k; only its frame is read."""
        size, raw_size, check = (int(x) for x in self.frames[k])
        raw = self.open.decompress(self._at(int(self.places[k]), size), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise Corrupt(f"frame {k}")
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        wanted = set(doc_ids)
        for k, i in enumerate(self.doc_ids):
            if i in wanted:
                yield i, self.document(k)


def _write_batches(folder: str, tokenizer: str, width: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context = encoder(tokenizer), TaskContext.get()
        document, wide = words.document, width or (2 if words.whole.get_vocab_size() <= 1 << 16 else 4)
        files, base = filesystem(folder)
        part = context.partitionId()
        path, own = f"{base}/part-{part:07d}.tok.zst", f"{base}/.part-{part:07d}-{context.taskAttemptId()}"
        sink = writer = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    sink = files.open_output_stream(own)
                    writer = Writer(sink, wide)
                writer.add(doc_id, np.frombuffer(document(text.as_py()), "<u4"))
        if writer:
            writer.close()
            sink.close()
            if files.get_file_info(path).type == pafs.FileType.NotFound:
                files.move(own, path)
            else:  # another attempt of this task has put the same file there
                files.delete_file(own)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.frames)], "n_tokens": [writer.tokens]})

    return run


def write_files(documents: DataFrame, folder: str, tokenizer: str = DEFAULT_TOKENIZER, width: int | None = None) -> DataFrame:
    """Write the files; the manifest has a row per file: part, path, n_docs, n_tokens."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", "head", "h", "place")
    placed = texts.withColumns({"head": F.left("text", F.lit(HEAD_CHARS)), "h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = arrow_pass(dealt, _write_batches(folder, tokenizer, width), MANIFEST)
    manifest = materialize(written.repartition(1), "manifest")  # a row per file: one small table, not a table per task
    files, base = filesystem(folder)
    for left in files.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if left.base_name.startswith(".part-"):
            files.delete_file(left.path)
    return manifest


def _read_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(path) as source:
                    reader = Reader(source)
                    sums = [zlib.crc32(reader.document(k).astype("<u4").tobytes()) for k in range(len(reader))]
                    counts = reader.counts.astype(np.int64)
                    starts = start + np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files, a task per file or TASK_TOKENS."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.cast("long").alias("start"))
    files, tokens = manifest.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return arrow_pass(placed.repartition(max(1, min(files, -(-tokens // TASK_TOKENS)))), _read_batches(folder), ROWS)


def token_files(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    folder = folder or fresh_dir(documents.sparkSession, "token-files")
    return read_files(write_files(documents, folder, tokenizer), folder)
