import hashlib
import random
import re

import numpy as np

from skarn.llm import pii


def _plain(text):
    """The base kinds straight from their patterns."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if low <= len(d) <= high and (kind == "phone" or luhn):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_base_against_patterns():
    rng = random.Random(9)
    for alphabet, n in (("a@.b-1 ", 6000), ("0123456789.", 3000), ("0123456789 -", 3000), ("+0123456789 ().-", 4000), ("aé@.1+ -(", 4000)):
        for _ in range(n // 4):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(text) == _plain(text), text
    fixed = "x.55@mail4.example.com, 10.0.0.255 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 2390409500648960 +1 (377) 555-0271 é@é.c"
    assert pii.base_spans(fixed) == _plain(fixed) and len(_plain(fixed)) >= 5


def test_long_runs_end():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+" + "(" * 200_000, "A1" * 200_000, "a@" * 100_000, "1:" * 100_000, "a-" * 200_000, "AB12" + "ABCD " * 50_000):
        pii.spans_of([text], *pii.model())


def test_held_out_accuracy():
    trees, thresholds = pii.model()
    x, y, kinds = pii.examples(3000, 99)
    chosen = trees.probability(x) >= np.array([thresholds[k] for k in kinds])
    assert y[chosen].mean() > 0.98
    assert chosen[y == 1].mean() > 0.95
    for kind in pii.ADDED_KINDS:
        own = kinds == kind
        assert chosen[own & (y == 1)].mean() > 0.9, kind


def test_added_spans_and_redaction(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'Thstorti token = "{key}" thhantou with. Mail a.b@c.org now; commit {key}.'
    rows = [(1, text, "n"), (2, None, "n"), (3, "", None), (None, "clean prose of words", "n"), (1, text, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.detect(frame).collect()
    first = next(r for r in got if r.doc_id == 1)
    at = text.index(key)
    assert first.spans == f"secret:{at}:{at + 40},email:{text.index('a.b@')}:{text.index(' now')}"
    assert first.n_email == 1 and first.base_sha256 == hashlib.sha256(f"email:{text.index('a.b@')}:{text.index(' now')}".encode()).hexdigest()
    assert all(r.spans == "" for r in got if r.doc_id != 1) and len(got) == 5
    clean = pii.redact(frame)
    assert clean.columns == frame.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] == f'Thstorti token = "<SECRET>" thhantou with. Mail <EMAIL> now; commit {key}.'
    assert texts[2] is None and texts[3] == "" and texts[None] == "clean prose of words"
    assert pii.detect(frame.limit(0)).count() == 0


def test_addresses_of_letters_only():
    for text in ("mac de:ad:be:ef:ca:fe of the server", "host fe:ab::cd:ef here"):
        assert pii.proposals(text) == [p for p in pii.proposals(text + " in room 7") if p[2] <= len(text)] != []
    assert pii.proposals("clean prose: well-known words") == []


def test_added_spans_against_plain_choice():
    fitted, source, rng = pii.model(), pii._Examples(31), random.Random(31)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            _, before, span, _ = source.case()
            parts.append(before + span)
        text = rng.choice([" ", ", ", "\n"]).join(parts + [source.word()])
        base, added = pii.spans_of([text], *fitted)[0]
        assert sorted(added) == sorted(pii.plain_choice(text, *fitted)), text
        assert all(e <= s or b <= a for a, e in [x[1:] for x in base] for s, b in [x[1:] for x in added])


def test_secrets_without_digits_and_signed_tokens():
    fitted = pii.model()
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    for text, want in (("password: hunterXYZ now", "hunterXYZ"), (f"bearer {token} end", token), ("pwd=Tr0ck!horse9 ok", "Tr0ck!horse9"), ("the password is required here", None), ("secret: confidential.", None), ("a token of love", None)):
        found = [text[s:e] for _, s, e in pii.spans_of([text], *fitted)[0][1]]
        assert found == ([want] if want else []), text


def test_features_cover_the_whole_span():
    head = "0123456789abcdef" * 32
    assert pii.features(head + "a" * 88, "secret", 0, 600) != pii.features(head + "Z" * 88, "secret", 0, 600)


def test_many_spans_end():
    text = " ".join(f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" +{i % 90 + 1} (377) 555-0{i % 1000:03d}' for i in range(3000))
    base, added = pii.spans_of([text], *pii.model())[0]
    assert len(base) + len(added) > 3000


def test_counts_of_added_spans_and_clean_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.detect(frame).collect()
    assert all(r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in r.spans.split(",") if x]) for r in rows)
    assert 0 < sum(r.n_added > 0 for r in rows) < 0.05 * len(rows)
