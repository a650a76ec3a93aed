import random
import time

import pytest

from skarn.llm import common, language

SEEDS = {
    "en": "the and of that with this which when there their over under water house light night",
    "de": "der die und das nicht schlecht ich auch über straße zwischen licht nacht haus wasser",
}


def _texts(seed, n):
    rng = random.Random(seed)
    return {k: [" ".join(rng.choice(v.split()) for _ in range(40)) for _ in range(n)] for k, v in SEEDS.items()}


def test_fused_posteriors_against_plain(spark):
    model = language.fit(_texts(1, 30))
    rng, rows = random.Random(2), []
    for i, (k, texts) in enumerate(_texts(3, 12).items()):
        for t in texts:
            rows.append({"host": rng.choice(["a.de", "b.com", "x.b.com"]), "body": " ".join(t.split()[: rng.choice([1, 3, 40])]), "declared": rng.choice([k, k, "", "fr"]), "suffix": ["com", "de"][i]})
    rows += [{"host": "a.de", "body": b, "declared": "en", "suffix": "com"} for b in (None, "", "123 !", "zqxv kjwq xxqz vvkq " * 20, "漢字 漢字 " * 40)]
    for r in rows:
        r["domain"] = ".".join(r["host"].split(".")[-2:])
    frame = spark.createDataFrame([("documents", i, None, r["host"], r["domain"], r["suffix"], r["declared"], r["body"]) for i, r in enumerate(rows)], "kind string, doc_id long, page_id long, host string, domain string, suffix string, declared string, body string")
    got = {r.doc_id: r for r in language.identify(frame, model).collect()}
    for i, (name, p) in enumerate(language.brute_force(rows, model)):
        assert got[i].language == name and abs(got[i].posterior - p) < 1e-4, (rows[i], got[i], name, p)
    assert all(not got[i].kept for i in range(len(rows) - 5, len(rows)))
    assert {r.language for r in got.values()} == {"en", "de", "und"}


def test_documents_and_pages(spark):
    texts = _texts(5, 25)
    docs = [(i, t, k, "s", "c") for k in texts for i, t in enumerate(texts[k], 100 * (k == "de"))]
    docs += [(900, None, None, None, "c"), (901, "", "en", "s", "c"), (None, texts["en"][0], "en", "s", "c"), (None, "", "en", "s", "c"), (0, texts["en"][0], "en", "s", "c")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, kept string")
    model = language.fit(language.labelled_sample(documents))
    assert model.languages == ["de", "en"]
    kept = language.keep_known(documents, model)
    assert kept.columns == documents.columns
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(d[:2]) for d in docs if d[1])
    page = '<!DOCTYPE html><html class="x" lang="de-AT"><script>the of and</script><p>{}</p><!-- the --></html>'
    pages = spark.createDataFrame([(1, "https://u@www.a.de:80/x", page.format(texts["de"][1])), (2, None, None), (3, "nonsense", "<p>" + texts["en"][2])], "page_id long, url string, html string")
    evidence = language.evidence_of_pages(pages).collect()
    assert [(r.host, r.domain, r.suffix) for r in evidence[:2]] == [("h:www.a.de", "a.de", "de"), ("h:", "", "")]
    got = {r.page_id: r for r in language.identify(language.evidence_of_pages(pages), model).collect()}
    assert (got[1].language, got[1].declared, got[1].kept) == ("de", "de", True)
    assert (got[2].language, got[2].kept) == ("und", False) and got[3].language == "en"


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    model = language.fit(language.labelled_sample(documents))
    assert language.identify(language.evidence_of_documents(documents), model).count() == 0
    other = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [r.language for r in language.identify(language.evidence_of_documents(other), model).collect()] == ["und"]


def test_sample_has_every_language_and_repeated_ids(spark):
    rows = [(i, f"text of language {i % 70}", f"l{i % 70}") for i in range(140)]
    rows += [(7, f"copy {i}", "l7") for i in range(600)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.labelled_sample(documents)
    assert set(got) == {f"l{k}" for k in range(70)}
    assert all(len(v) == 2 for v in got.values())
    assert sorted(got["l7"]) == ["copy 0", "text of language 7"]


def test_declaration_after_a_long_banner():
    page = "<!-- " + "banner " * 2000 + "-->\n<html lang=fr><p>x</p></html>"
    assert language.declared_in_html(page) == "fr"
    assert language.declared_in_html("<html " * 20000) == ""


def test_sampled_texts_are_whole(spark):
    text = "the " * 1500 + "zyx"
    model = language.fit(language.labelled_sample(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")))
    assert "zyx" in model.scores


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    texts = _texts(8, 20)
    docs = [(i, t, k, "s") for k in texts for i, t in enumerate(texts[k], 100 * (k == "de"))] + [(3, "123 456", "en", "s"), (3, "zqxv kjwq xxqz vvkq " * 20, "xx", "q")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    kept = language.keep_known(documents, language.fit(_texts(8, 20))).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(d[:2] for d in docs[:-2])


def test_hot_values_change_nothing(spark, monkeypatch):
    model = language.fit(_texts(1, 30))
    rows = [("documents", i, None, "s:hot" if i % 3 else f"s:{i}", "", "", "en", t) for i, t in enumerate(_texts(3, 30)["de"])]
    frame = spark.createDataFrame(rows, "kind string, doc_id long, page_id long, host string, domain string, suffix string, declared string, body string").repartition(4)
    want = sorted(map(repr, language.identify(frame, model).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(repr, language.identify(frame, model).collect())) == want


def test_scores_by_table_and_by_search(monkeypatch):
    model = language.fit(_texts(1, 30))
    texts = [None, "", "a", "the Straße 12 ́x", "漢字 the", "x" * 10_000, "light " * 9000]
    one_by_one = [sum((model.word(w) for w in language._WORD.findall((t or "").lower())), start=0 * model.rows[0]) for t in texts]
    table = [model.text(t) for t in texts]
    monkeypatch.setattr(language, "_TABLE_LETTERS", 1)
    monkeypatch.setattr(language, "_SLICE_CHARS", 100)
    searched = [language.TrigramModel(model.languages, model.keys, model.rows[:, :-1]).text(t) for t in texts]
    for t, want, (n, a), (m, b) in zip(texts, one_by_one, table, searched, strict=True):
        assert n == m == len(language._WORD.findall((t or "").lower()))
        assert abs(a - want).max() < 1e-6 * (1 + abs(want).max()) and abs(b - want).max() < 1e-6 * (1 + abs(want).max())


@pytest.mark.parametrize("mark", ["<!--", "<script>", "<style ", "<", "</script ", "<!-- x >", "<script>x</style>"])
def test_malformed_markup_takes_linear_time(mark):
    began = time.perf_counter()
    language.text_of_html(mark * (1_000_000 // len(mark)))
    assert time.perf_counter() - began < 2


def test_text_of_markup():
    page = "a<!-- b -->c<script x>d</SCRIPT >e<style>f</style>g<p class=x>h &amp; i</p><scripty>j<script>k <!-- l > m"
    assert language.text_of_html(page).split() == "a c e g h & i j k m".split()
    assert language.text_of_html("a < b") == "a < b" and language.text_of_html(None) == ""


def test_accuracy_outside_the_sample_without_the_declaration(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = {k: v[:100] for k, v in language.labelled_sample(documents).items()}
    seen = {t for v in labelled.values() for t in v}
    rest = [r for r in documents.filter("lang is not null").collect() if r.text not in seen]
    hidden = spark.createDataFrame([(r.doc_id, r.text, None, r.source) for r in rest], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(language.evidence_of_documents(hidden), language.fit(labelled)).collect()}
    judged = [(r.lang, got[r.doc_id]) for r in rest if got[r.doc_id].n_words >= 5]
    assert len(judged) > 400
    assert sum(lang == g.language for lang, g in judged) / len(judged) > 0.97
