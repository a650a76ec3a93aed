r"""Language identification by Bayesian evidence fusion.

For each text a naive Bayes model of character trigrams within words gives log-likelihoods for each language and for
`und` (a flat model: what is no known language fits it better). They are fused with three further kinds of evidence:
the declared markup language, the address suffix and the host. Each value's posteriors come from grouped aggregates of
the text posteriors over all rows, so one very common host only costs partial sums. The host prior is smoothed by
its domain, the domain by the whole corpus. A declaration or suffix counts as the ratio of its smoothed posteriors to
the corpus prior, so a value that says nothing, or that no other row has, leaves the result as it is: a row's own
posterior is taken out of the counts of its host, domain, declaration and suffix alike.

The trigram model is fitted on the driver on at most SAMPLE_PER_LANGUAGE labelled documents of each language: those
with the smallest hashes of their ids. The per-row evidence is written once as a narrow table; only that is
aggregated and joined, never the texts. Joins on hosts, domains, declarations and suffixes deal the rows of a hot value
over many tasks.

A row is kept if its language is known and its posterior reaches MIN_POSTERIOR. Text evidence is tempered, as
neighbouring trigrams aren't independent.

Defined cases: null, empty and wordless texts have no language (`und`, not kept); null or odd declarations,
suffixes and hosts are the value "" and count like any other; very long texts are read whole, in time in proportion to
their length, and so is markup that is never closed; repeated rows and ids give a row each; of equal posteriors the
first language in the alphabet wins; without labelled documents the model has no language and all rows are `und`; an
empty table gives no row; other columns are ignored. `keep_known` decides row by row, by what a row's text, declaration
and source say, whatever its id.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import arrow_pass, columns_of, content_key, join_hot, materialize

SAMPLE_PER_LANGUAGE = 500
UNDETERMINED = "und"
MIN_POSTERIOR = 0.5
TEMPER = 0.5
#: Pseudo-counts: of the corpus in a declaration or suffix, of a domain in its host, of the corpus in a domain.
VALUE_WEIGHT, HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 5.0, 20.0
#: The flat model's loss per trigram, as a share of the loss of a trigram that no sample has.
FLAT_SHARE = 0.65
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]+")
_PARTS = 64
_SLICE_CHARS = 1 << 20
#: Trigrams of at most so many different letters are looked up in a table of all triples, others in a sorted list.
_TABLE_LETTERS = 200
_SPACE = 32


def _spaced(text: str | None) -> str:
    """The lower-cased words of a text with one space around each; empty if there is none."""
    words = _GAP.sub(" ", text.lower()).strip(" ") if text else ""
    return f" {words} " if words else ""


def _codes(spaced: str) -> np.ndarray:
    return np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """Keys of the trigrams within words, each with the space on its sides."""
    a, b, c = (codes[k : len(codes) - 2 + k].astype(np.uint64) for k in range(3))
    return ((a << np.uint64(42)) | (b << np.uint64(21)) | c)[b != _SPACE]


class TrigramModel:
    """Log-likelihoods of trigrams by language. keys are sorted; scores has a row for each and a last one for all others."""

    def __init__(self, languages: list[str], keys: np.ndarray, scores: np.ndarray):
        self.languages, self.keys = languages, keys
        flat = FLAT_SHARE * float(np.mean(scores[-1])) if languages else 0.0
        self.rows = np.concatenate([scores, np.full((len(scores), 1), flat)], axis=1)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "keys": self.keys, "rows": self.rows}

    @cached_property
    def scores(self) -> dict[str, np.ndarray]:
        """The rows by trigram."""
        part = lambda k, shift: chr(k >> shift & 0x1FFFFF)
        return {part(k, 42) + part(k, 21) + part(k, 0): row for k, row in zip(self.keys.tolist(), self.rows, strict=False)}

    def word(self, word: str) -> np.ndarray:
        """Log-likelihoods of a word's trigrams, the flat model's last; for tests, one by one."""
        s = f" {word} "
        return np.sum([self.scores.get(s[i : i + 3], self.rows[-1]) for i in range(len(s) - 2)], axis=0)

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Letter -> its number, and the rows' numbers by three letters' numbers; None if there are too many letters."""
        letters = np.unique(np.concatenate([self.keys >> np.uint64(s) & np.uint64(0x1FFFFF) for s in (0, 21, 42)]))
        n = len(letters) + 1
        if n > _TABLE_LETTERS:
            return None
        number = np.zeros(0x110000, dtype=np.int32)
        number[letters.astype(np.int64)] = np.arange(1, n)
        place = reduce(lambda at, s: at * n + number[(self.keys >> np.uint64(s) & np.uint64(0x1FFFFF)).astype(np.int64)], (42, 21, 0), np.zeros(len(self.keys), dtype=np.int64))
        table = np.full(n**3, len(self.keys), dtype=np.int32)
        table[place] = np.arange(len(self.keys))
        return number, table

    def _places(self, codes: np.ndarray) -> np.ndarray:
        if self._table is None:
            keys = _trigrams(codes)
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            return np.where(self.keys[at] == keys, at, len(self.keys))
        number, table = self._table
        n = round(len(table) ** (1 / 3))
        x = number[codes]
        return table[(x[:-2] * n + x[1:-1]) * n + x[2:]][codes[1:-1] != _SPACE]

    def text(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words and the log-likelihoods of a text, the flat model's last."""
        spaced = _spaced(text)
        if not spaced or not self.languages:
            return max(0, spaced.count(" ") - 1), np.zeros(self.rows.shape[1])
        codes, counts = _codes(spaced), np.zeros(len(self.rows), dtype=np.int64)
        if len(codes) <= len(self.rows):
            return spaced.count(" ") - 1, self.rows[self._places(codes)].sum(axis=0)
        for at in range(0, len(codes) - 2, _SLICE_CHARS):
            counts += np.bincount(self._places(codes[at : at + _SLICE_CHARS + 2]), minlength=len(counts))
        return spaced.count(" ") - 1, counts @ self.rows


def fit(labelled: dict[str, list[str]]) -> TrigramModel:
    languages = sorted(labelled)
    counted = []
    for k in languages:
        codes = _codes("".join(map(_spaced, labelled[k])))
        counted.append(np.unique(_trigrams(codes), return_counts=True) if len(codes) > 2 else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in counted)]))
    counts = np.zeros((len(keys) + 1, len(languages)))
    for i, (own, n) in enumerate(counted):
        counts[np.searchsorted(keys, own), i] = n
    return TrigramModel(languages, keys, np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * (len(keys) + 1)))


def labelled_sample(documents: DataFrame) -> dict[str, list[str]]:
    """Texts of at most SAMPLE_PER_LANGUAGE documents per language, those with the smallest hashes of their ids.

    Every declared language has its sample. The ids are chosen from the narrow columns, one row per distinct id and
    language; their texts are then fetched by id, of repeated rows the smallest text.
    """
    named = documents.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", F.lower(F.col("lang").cast("string")).alias("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    part = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))  # so that no task ranks all rows of a language
    hashed = named.distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(_PARTS)))
    first = hashed.withColumn("n", part).filter(F.col("n") <= SAMPLE_PER_LANGUAGE).withColumn("n", place).filter(F.col("n") <= SAMPLE_PER_LANGUAGE)
    chosen = materialize(first.select("doc_id", "lang"), "labelled-ids")
    out: dict[str, list[str]] = {}
    rows = documents.filter("text is not null").select("doc_id", F.lower(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text")).join(chosen, ["doc_id", "lang"], "left_semi")
    for r in rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id", "lang").toLocalIterator():
        out.setdefault(r.lang, []).append(r.text)
    return out


_RAW = re.compile(r"<(script|style)\b", re.I)
_RAW_END = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_HTML_TAG = re.compile(r"<html\b[^>]*", re.I)
_DECLARED = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)


def text_of_html(source: str | None) -> str:
    """A page's text without comments, scripts, styles and tags, each a space; what is never closed is text.

    Every kind of closing mark is looked for in vain once at most, so the time is in proportion to the length.
    """
    source, out, at, lost = source or "", [], 0, set()
    while (open_ := source.find("<", at)) != -1:
        out.append(source[at:open_])
        end = -1
        if "-->" not in lost and source.startswith("<!--", open_):
            end = source.find("-->", open_ + 4)
            end = end + 3 if end != -1 else lost.add("-->") or -1
        if end == -1:
            close = source.find(">", open_)
            if close == -1:
                out.append(source[open_:])
                at = len(source)
                break
            end = close + 1
            raw = _RAW.match(source, open_)
            if raw and (name := raw[1].lower()) not in lost:
                stop = _RAW_END[name].search(source, end)
                end = stop.end() if stop else lost.add(name) or end
        out.append(" ")
        at = end
    return html.unescape("".join([*out, source[at:]]))


def declared_in_html(source: str | None) -> str:
    """The language of the first <html> tag with one, wherever it stands; each tag is passed once."""
    found = (_DECLARED.search(source, *m.span()) for m in _HTML_TAG.finditer(source or ""))
    return next((f[1].lower() for f in found if f), "")


def _plain(documents: DataFrame, column: str) -> Column:
    """A column's text in lower case, "" where it is null or missing."""
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))) if column in documents.columns else F.lit("")


def _document_key(documents: DataFrame) -> list[Column]:
    return content_key(F.col("text").cast("string"), _plain(documents, "lang"), _plain(documents, "source"))


def evidence_of_documents(documents: DataFrame) -> DataFrame:
    """The declaration is the lang column, the host the source; there is no address."""
    return documents.select(
        F.lit("documents").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), *_document_key(documents),
        F.concat(F.lit("s:"), _plain(documents, "source")).alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"), _plain(documents, "lang").alias("declared"), F.col("text").cast("string").alias("body"),
    )


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(
        F.lit("pages").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), *content_key(F.col("html").cast("string"), F.col("url").cast("string")),
        F.concat(F.lit("h:"), host).alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.substring_index(host, ".", -1).alias("suffix"), F.lit("").alias("declared"), F.col("html").cast("string").alias("body"),
    )


_NARROW = {"kind": "string", "doc_id": "long", "page_id": "long", "k1": "long", "k2": "long", "host": "string", "domain": "string", "suffix": "string"}


def _scored(sources: DataFrame, model: TrigramModel) -> DataFrame:
    shared = sources.sparkSession.sparkContext.broadcast(model)  # at most the trigrams of the bounded sample
    names, n = list(_NARROW), len(_NARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            declared, words, scores = [], [], []
            for kind, said, body in zip(batch.column(0), batch.column(n), batch.column(n + 1), strict=True):
                body, said = body.as_py(), said.as_py()
                if kind.as_py() == "pages":
                    said, body = declared_in_html(body), text_of_html(body)
                count, score = own.text(body)
                declared.append(said), words.append(count), scores.append(score)
            columns = [pa.array(declared, pa.string()), pa.array(words, pa.int64()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *columns], names=[*names, "declared", "n_words", "score"])

    kept = sources.select(*(F.col(c).cast(t).alias(c) if c in sources.columns else F.lit(None).cast(t).alias(c) for c, t in _NARROW.items()), "declared", "body")
    return arrow_pass(kept, run, ", ".join(f"{c} {t}" for c, t in _NARROW.items()) + ", declared string, n_words long, score array<double>")


def _softmax(z: Column) -> Column:
    shifted = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.element_at(F.transform(F.array(shifted), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))), 1)


def _sums(frame: DataFrame, k: int, key: str) -> DataFrame:
    """kind, key, n_<key> (the sums of the posteriors), n (the rows) by key, a partial aggregate; written."""
    sums = frame.groupBy("kind", key).agg(*(F.sum(F.get("text_p", F.lit(i))).alias(f"s{i}") for i in range(k)), F.count("*").alias("n"))
    return materialize(sums.select("kind", key, F.array(*(F.coalesce(f"s{i}", F.lit(0.0)) for i in range(k))).alias(f"n_{key}"), "n"), f"language-{key}")


def _smoothed(counts: Column, parent: Column, weight: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, parent, lambda n, p: (n + weight * p) / (total + weight))


def identify(sources: DataFrame, model: TrigramModel) -> DataFrame:
    """kind, doc_id, page_id, language, posterior, text_language, declared, n_words, kept: a row per row of sources."""
    return _identified(sources, model).drop("k1", "k2")


def _identified(sources: DataFrame, model: TrigramModel) -> DataFrame:
    """The rows of identify with the keys of the sources."""
    names = [*model.languages, UNDETERMINED]
    k = len(names)
    scored = _scored(sources, model).withColumn("text_p", F.when(F.col("n_words") > 0, _softmax(F.transform("score", lambda v: v * TEMPER))))
    rows = materialize(scored, "language-evidence")
    total = [float(v or 0) for v in rows.agg(*(F.sum(F.get("text_p", F.lit(i))) for i in range(k))).first()]
    prior = F.array(*(F.lit((n + 1) / (sum(total) + k)) for n in total))
    none = F.array(*(F.lit(0.0) for _ in names))
    joined = rows
    for key in ("declared", "suffix", "domain", "host"):
        sums = _sums(rows, k, key)
        joined = join_hot(joined, sums.drop("n"), ["kind", key], sums, "left")
    own = F.coalesce("text_p", none)
    less = lambda c: F.zip_with(F.coalesce(c, none), own, lambda n, p: F.greatest(n - p, F.lit(0.0)))
    host_p = _smoothed(less("n_host"), _smoothed(less("n_domain"), prior, DOMAIN_WEIGHT), HOST_WEIGHT)
    ratio = lambda c: F.zip_with(_smoothed(less(c), prior, VALUE_WEIGHT), prior, lambda p, q: F.log(p / q))
    parts = [F.transform("score", lambda v: v * TEMPER), F.transform(host_p, lambda p: F.log(p + 1e-9)), ratio("n_declared"), ratio("n_suffix")]
    fused = joined.withColumn("z", reduce(lambda x, y: F.zip_with(x, y, lambda a, b: a + b), parts)).withColumn("p", F.when(F.col("n_words") > 0, _softmax(F.col("z"))))
    name = lambda c: F.coalesce(F.element_at(F.array(*map(F.lit, names)), F.array_position(c, F.array_max(c)).cast("int")), F.lit(UNDETERMINED))
    out = fused.select("kind", "doc_id", "page_id", "k1", "k2", name("p").alias("language"), F.round(F.coalesce(F.array_max("p"), F.lit(0.0)), 6).alias("posterior"), name("text_p").alias("text_language"), "declared", "n_words")
    return out.withColumn("kept", (F.col("language") != UNDETERMINED) & (F.col("posterior") >= MIN_POSTERIOR))


def keep_known(documents: DataFrame, model: TrigramModel) -> DataFrame:
    """The rows of documents that aren't rejected, with all their columns. Rows of one text, declaration and source are judged alike."""
    rejected = _identified(evidence_of_documents(documents), model).filter("not kept").select("k1", "k2").distinct()
    packed = documents.select(F.struct(*columns_of(documents)).alias("row"), *_document_key(documents))
    return packed.join(materialize(rejected, "language-rejects", keep=True), ["k1", "k2"], "left_anti").select("row.*")


def brute_force(rows: list[dict], model: TrigramModel) -> list[tuple[str, float]]:
    """For tests: language and posterior of rows of one kind, with the same rules in plain Python."""
    k = len(model.languages) + 1
    words = [_WORD.findall((r["body"] or "").lower()) for r in rows]
    scores = [np.sum([model.word(w) for w in own] or [np.zeros(k)], axis=0) for own in words]
    norm = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    text_p = [norm(TEMPER * s) if n else np.zeros(k) for s, n in zip(scores, words, strict=True)]
    total = np.sum(text_p, axis=0)
    prior = (total + 1) / (total.sum() + k)
    by = {key: {v: np.sum([p for r, p in zip(rows, text_p, strict=True) if r[key] == v], axis=0) for v in {r[key] for r in rows}} for key in ("host", "domain", "declared", "suffix")}
    smooth = lambda n, parent, weight: (n + weight * parent) / (n.sum() + weight)
    out = []
    for r, s, n, p in zip(rows, scores, words, text_p, strict=True):
        if not n:
            out.append((UNDETERMINED, 0.0))
            continue
        others = {key: np.maximum(values[r[key]] - p, 0) for key, values in by.items()}
        z = TEMPER * s + np.log(smooth(others["host"], smooth(others["domain"], prior, DOMAIN_WEIGHT), HOST_WEIGHT) + 1e-9)
        for key in ("declared", "suffix"):
            z = z + np.log(smooth(others[key], prior, VALUE_WEIGHT) / prior)
        q = norm(z)
        out.append(([*model.languages, UNDETERMINED][int(q.argmax())], round(float(q.max()), 6)))
    return out


def expected_loss(model: TrigramModel, text: str) -> float:
    """Nats per trigram under the best language, to judge FLAT_SHARE."""
    words = _WORD.findall(text.lower())
    return float(-model.text(text)[1][:-1].max() / max(1, sum(len(w) for w in words))) if words else math.inf
