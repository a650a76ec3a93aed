r"""Personal data: high-recall generators propose spans, boosted trees judge them, calibrated thresholds select.

The four base kinds (email, ip, card, phone) are exact patterns with a check each; what passes is always kept. Further
generators propose spans of other kinds, overlaps included: secrets (keys, tokens, signed tokens), passwords after a key
word, national id numbers, IBANs, phone numbers without a country code, IPv6 and hardware addresses,
and phone and account numbers that a base pattern loses by running on into other digits. Each proposal gets format features (digits, letters,
entropy, check sums) of its whole span and context features (key words before it, neighbours, quotes). The trees are fitted on the driver
on TRAINING_ROWS generated, labelled proposals with a fixed seed; a held-out part calibrates the scores, and each
kind's threshold is the lowest with the wanted precision there. Selected spans are taken by score, equal scores by
place in the text and then by kind; one that overlaps a base span or a better one is left out.

Out of scope: names of persons, postal addresses and other data without a form of their own.

Places are code points, ends exclusive. A pass is one scan, nothing is shuffled.

Defined cases: null and empty texts have no span; very long texts and spans are read whole; overlapping base spans of
different kinds are all kept; repeated rows, ids and nulls of doc_id come back as they are, a row each; an empty table
gives no row; other columns are ignored by `detect` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.boosting import Boosted
from skarn.llm.common import arrow_pass, columns_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "ssn", "iban", "localphone", "ipv6", "mac", "intlphone", "account", "password")
KINDS = BASE_KINDS + ADDED_KINDS
TRAINING_ROWS = 14000
PRECISION = 0.99
_RANK = {k: i for i, k in enumerate(KINDS)}

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails at the first digit of a run fails at the others too, so it may start there only.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}={0,2}"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "localphone": re.compile(r"(?<![0-9+-])\(?[0-9]{3,4}\)?[ .-][0-9]{3}[ .-]?[0-9]{3,4}(?![0-9-])"),
    # what the base patterns lose when they run on into digits that follow
    "intlphone": re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])"),
    "account": re.compile(r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])"),
    "ipv6": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "mac": re.compile(r"(?<![0-9A-Za-z:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])"),
}
#: Kinds that match without a digit; all of them need a colon or a hyphen.
_DIGITLESS = ("ipv6", "mac")
#: Signed tokens, which have dots inside.
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*)?")
#: A value after a word that announces one; looked for in lower-cased texts with such a word.
_ANNOUNCED = ("passw", "passphrase", "pwd", "secret", "token", "api_key", "api key", "apikey", "api-key", "access_key", "access key", "credential")
_PASSWORD = re.compile(r"(?:passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access)[ _-]?key|credentials?)\"?\s{0,3}(?:=|:|\bis\b)\s{0,3}[\"'`]?([^\s\"'`,;<>()]{6,})", re.I)
#: Key words of a proposal's context, by feature.
_WORDS = {
    "secret": ("token", "secret", "key", "passw", "pwd", "credential", "auth", "bearer"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "person": ("ssn", "social security", "tax id", "national id", "insurance"),
    "bank": ("iban", "account", "bank", "transfer", "payee"),
    "net": ("ip", "addr", "host", "mac", "server", "client", "device"),
    "other": ("commit", "sha", "md5", "checksum", "hash", "order", "invoice", "isbn", "part no", "version", "build", "rev", "uuid", "time", "score", "file", "img", "page"),
}
_WORD_PATTERNS = [re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})") for words in _WORDS.values()]
_BEFORE, _AFTER = 32, 1
_HEXA = frozenset("0123456789abcdefABCDEF")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at != -1:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base kinds by start, then kind."""
    out = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _only_digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


def proposals(text: str) -> list[tuple[str, int, int]]:
    """What the generators of the added kinds propose; overlaps are wanted."""
    generators = _GENERATORS if _DIGIT.search(text) else {k: _GENERATORS[k] for k in _DIGITLESS} if ":" in text or "-" in text else {}
    out = [(kind, *m.span()) for kind, pattern in generators.items() for m in pattern.finditer(text)]
    if "eyJ" in text and (signed := [("secret", *m.span()) for m in _SIGNED.finditer(text)]):
        whole = _Taken(signed)  # their parts are no proposals of their own
        out = [p for p in out if p[0] != "secret" or whole.free(*p[1:])] + signed
    low = text.lower()
    if any(word in low for word in _ANNOUNCED):
        secrets = _Taken([p for p in out if p[0] == "secret"])  # which need no word before them
        out += [("password", *m.span(1)) for m in _PASSWORD.finditer(text) if secrets.free(*m.span(1))]
    return out


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    s, before = text[start:end], text[max(0, start - _BEFORE) : start].lower()
    n, counts = len(s), Counter(s)
    digits, letters, upper = (sum(v for c, v in counts.items() if test(c)) for test in (str.isdigit, str.isalpha, str.isupper))
    plain = s.replace("-", "").replace("_", "")
    tail = before.rstrip("\"'`( ")
    shape = [
        float(_RANK[kind]), float(n), digits / n, letters / n, upper / n, (n - digits - letters) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()), float(_HEXA.issuperset(counts)),
        float(counts["-"] + counts["_"] + counts["/"]), max(map(len, re.findall("[a-zA-Z]+", s)), default=0) / n,
        sum(a.isdigit() != b.isdigit() for a, b in zip(plain, plain[1:], strict=False)) / n, float(counts[":"]),
        sum(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False)) / n, float(s[-1:] in tuple(".!?")), float(counts["."]),
    ]
    checks = [
        float(kind == "iban" and _mod97(s) or kind == "account" and _luhn(_only_digits(s))),
        float(kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
        float(s.startswith(("sk_", "pk_", "ghp_", "AKIA", "xox", "eyJ"))), float(s[:1] == "("),
        float("::" in s or s.count(":") == 7), float(kind == "ipv6" and all(len(p) == 2 for p in s.split(":"))),
    ]
    context = [max((m.start() for m in p.finditer(before)), default=-1) / _BEFORE for p in _WORD_PATTERNS]
    around = [float(before[-1:] in tuple("\"'`")), float(tail[-1:] in tuple("=:")), float(text[end : end + _AFTER] in tuple("\"'`")), float(before[-1:] in tuple("/.#"))]
    return shape + checks + context + around


class _Examples:
    """Labelled proposals in invented contexts."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(["th", "er", "on", "an", "re", "in", "la", "que", "ch", "ung", "o", "a"]) for _ in range(self.rng.randint(1, 4)))

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(n))

    def digits(self, n: int) -> str:
        return self.chars("0123456789", n)

    def iban(self, valid: bool) -> str:
        body = self.digits(self.rng.choice([14, 16, 18, 20]))
        country = self.rng.choice(["DE", "FR", "ES", "GB", "IT", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check if valid else (check + self.rng.randint(1, 90)) % 97 + 1:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if self.rng.random() < 0.5 else s

    def password(self, good: bool) -> tuple[str, str]:
        """Text before and a value after a word that announces one."""
        r, lower = self.rng, "abcdefghijklmnopqrstuvwxyz"
        before = r.choice(["password", "Password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "access key", "credentials"]) + r.choice([" = ", "=", ": ", " is ", ' = "', ": '", ":"])
        long = self.word() + self.word()
        if good:
            span = r.choice([
                long + self.chars(lower.upper(), r.randint(2, 6)), long + r.choice("!@#$%^&*_-+") + self.chars(lower + "0123456789", r.randint(1, 6)), long + self.digits(r.randint(1, 5)),
                self.chars(lower + lower.upper(), r.randint(8, 30)), self.chars(lower + lower.upper() + "0123456789!@#$%^&*", r.randint(8, 30)), "".join(self.word().capitalize() for _ in range(4)),
                self.chars(lower, 3) + "-" + self.chars(lower.upper(), 3) + "-" + self.chars(lower + "0123456789", 4), "".join(c.upper() if r.random() < 0.4 else c for c in long + "ab"),
            ])
            return before, span if len(span) >= 6 else span + "XyZ!"[: 6 - len(span)] + "Q9"
        span = r.choice([
            long, long.capitalize(), long + ".", long.upper(), r.choice(["required", "optional", "string", "missing", "invalid", "expired", "changed", "wrong.", "correct", "confidential", "stored", "hidden", "encrypted"]),
            "your_" + r.choice(["password", "token", "key"]), "YOUR_TOKEN_HERE", "xxxxxxxx", "********", "${" + self.word().upper() + "_KEY}", "{{" + self.word() + "}}", "os.environ", "config." + self.word(), "self." + self.word() + "_" + self.word(), "[REDACTED]", "None...", "undefined", "https://" + self.word() + ".example.com/" + self.word(),
        ])
        return before, span if len(span) >= 6 else span + "ation"

    def case(self) -> tuple[str, str, str, int]:
        """kind, text before, the span, label."""
        r, hexa, alnum = self.rng, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        kind, good = r.choice(ADDED_KINDS + ("secret", "secret")), r.random() < 0.5
        sep = r.choice([" = \"", "=", ": ", " is ", " ", ": '"])
        if kind == "password":
            return kind, *self.password(good), int(good)
        if kind == "secret":
            if good and r.random() < 0.15:
                part = alnum + "-_"
                return kind, r.choice(["token" + sep, "bearer ", "authorization: bearer ", "jwt ", self.word() + " "]), "eyJ" + self.chars(part, r.randint(10, 40)) + ".eyJ" + self.chars(part, r.randint(10, 120)) + r.choice(["", ".", "." + self.chars(part, r.randint(20, 90))]), 1
            if good:
                span = r.choice([self.chars(hexa, r.choice([32, 40, 40, 64])), self.chars(alnum, r.randint(20, 64)), "sk_live_" + self.chars(alnum, 24), "ghp_" + self.chars(alnum, 36), "AKIA" + self.chars(alnum[:26] + "0123456789", 16)])
                known = span.startswith(("sk_", "ghp_", "AKIA"))
                return kind, (r.choice(["token", "api_key", "api key", "secret", "password", "auth token", "access_key", "bearer"]) + sep if not known or r.random() < 0.5 else self.word() + " "), span, 1
            return kind, *r.choice([
                (r.choice(["commit ", "sha1: ", "md5 ", "checksum ", "hash ", "revision ", "uuid "]), self.chars(hexa, r.choice([32, 40, 64]))),
                (self.word() + " ", self.chars(hexa, r.choice([32, 40, 64]))),
                (self.word() + r.choice([" ", "/", "."]), "-".join(self.word() for _ in range(r.randint(3, 6))) + "-" + self.digits(r.randint(1, 4))),
                (r.choice(["file ", "", "img ", "key "]), f"IMG_{self.digits(8)}_{self.digits(6)}"),
                (self.word() + " ", "_".join(self.word() for _ in range(4)) + self.digits(1)),
                (r.choice(["order ", "invoice ", "isbn ", "number ", self.word() + " "]), self.digits(r.randint(16, 24))),
                (self.word() + " ", f"{r.randint(1990, 2030)}-{self.digits(2)}-{self.digits(2)}-{self.word()}-{self.word()}-{self.word()}"),
                ("base64,", self.chars(alnum, 700)),
            ]), 0
        if kind == "ssn":
            first = f"{r.choice([r.randint(1, 665), r.randint(667, 899)]):03d}"
            if good:
                return kind, r.choice(["ssn" + sep, "social security number" + sep, "tax id" + sep, self.word() + " "]), f"{first}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", 1
            return kind, *r.choice([(self.word() + " ", f"{r.choice(['000', '666', '9' + self.digits(2)])}-{self.digits(2)}-{self.digits(4)}"), (r.choice(["order ", "part no ", "isbn ", "invoice "]), f"{first}-{self.digits(2)}-{self.digits(4)}"), (self.word() + " ", f"{first} {self.digits(2)} {self.digits(4)}")]), 0
        if kind == "iban":
            return kind, r.choice(["iban" + sep, "bank account" + sep, self.word() + " "]), self.iban(good), int(good)
        if kind == "localphone":
            a, b, c = self.digits(3), self.digits(3), self.digits(4)
            if good:
                form = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
                return kind, (r.choice(["phone", "tel", "call", "mobile", "fax"]) + r.choice([": ", " ", ". ", " me at "]) if form[0] != "(" or r.random() < 0.5 else self.word() + " "), form, 1
            return kind, *r.choice([(r.choice(["order ", "invoice ", "version ", "score ", "part no ", "page "]), r.choice([f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b}{c}"])), (self.word() + " ", f"{a} {b} {c}"), (self.word() + " ", f"{a} {b}{c[:3]}")]), 0
        if kind == "intlphone":
            a, b, c = self.digits(3), self.digits(3), self.digits(4)
            if good:
                return kind, r.choice([self.word() + " ", "phone ", "call ", "tel: ", "fax "]), f"+{r.randint(1, 99)} " + r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}"]), 1
            return kind, r.choice(["order ", "score ", "version ", self.word() + " "]), r.choice([f"+{a}{b}{c}", f"+{r.randint(1, 9)}{a} {b}{c[:3]}"]), 0
        if kind == "account":
            body = r.choice("23456") + self.digits(14)
            check = next(d for d in "0123456789" if _luhn(body + d))
            span = body + (check if good else r.choice([d for d in "0123456789" if d != check]))
            span = r.choice([span, span, " ".join(span[i : i + 4] for i in range(0, 16, 4))])
            return kind, r.choice([self.word() + " ", "card ", "account "] if good else [self.word() + " ", "order ", "invoice ", "isbn ", "account "]), span, int(good)
        if kind == "ipv6":
            if good:
                groups = [self.chars(hexa, 4) for _ in range(8)]
                return kind, r.choice(["ip ", "host ", "addr" + sep, self.word() + " "]), r.choice([":".join(groups), ":".join(groups[:3]) + "::" + groups[3]]), 1
            return kind, *r.choice([(r.choice(["time ", self.word() + " ", "at "]), f"{self.digits(2)}:{self.digits(2)}:{self.digits(2)}"), (r.choice(["score ", self.word() + " "]), f"{self.digits(1)}:{self.digits(1)}:{self.digits(1)}"), (self.word() + " ", ":".join(self.chars(hexa, 2) for _ in range(4)))]), 0
        if good:
            mark = r.choice(":-")
            return kind, r.choice(["mac ", "device ", self.word() + " ", "addr" + sep]), mark.join(self.chars(hexa, 2) for _ in range(6)), 1
        return kind, r.choice([self.word() + " ", "order ", "time ", "version "]), "-".join(self.digits(2) for _ in range(6)), 0

    def row(self) -> tuple[list[float], int, str]:
        kind, before, span, label = self.case()
        if before and self.rng.random() < 0.3:
            before = before[0].upper() + before[1:]
        head = " ".join(self.word() for _ in range(self.rng.randint(0, 6)))
        if self.rng.random() < 0.25:  # a key word of some kind, which says nothing
            head += " " + self.rng.choice(self.rng.choice(list(_WORDS.values()))) + " " + self.word()
        if kind in ("intlphone", "account") and self.rng.random() < 0.3:
            head += " " + self.digits(self.rng.randint(3, 16))
        run_on = " " + self.digits(self.rng.randint(2, 16)) if self.rng.random() < 0.2 else ""
        after = run_on + ('"' if before.endswith('"') else "'" if before.endswith("'") else "") + self.rng.choice([" ", ". ", ", "]) + self.word()
        text = f"{head} {before}{span}{after}"
        start = len(head) + 1 + len(before)
        return features(text, kind, start, start + len(span)), label, kind


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    source = _Examples(seed)
    x, y, kinds = zip(*(source.row() for _ in range(n)), strict=True)
    return np.array(x), np.array(y, dtype=float), np.array(kinds)


@lru_cache(maxsize=1)
def model(seed: int = 11) -> tuple[Boosted, dict[str, float]]:
    """The fitted trees and each added kind's threshold."""
    x, y, kinds = examples(TRAINING_ROWS, seed)
    n = len(y) * 2 // 3
    trees = Boosted().fit(x[:n], y[:n]).calibrate(x[n:], y[n:])
    p = trees.probability(x[n:])
    thresholds = {}
    for kind in ADDED_KINDS:
        own, good = p[kinds[n:] == kind], y[n:][kinds[n:] == kind]
        order = np.argsort(-own)
        precision = np.cumsum(good[order]) / np.arange(1, len(own) + 1)
        enough = np.flatnonzero(precision >= PRECISION)
        thresholds[kind] = max(0.5, float(own[order][enough[-1]])) if len(enough) else 1.0
    return trees, thresholds


class _Taken:
    """Places of a text that spans hold, as disjoint intervals in order."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.held: list[tuple[int, int]] = []
        for _, start, end in sorted(spans, key=lambda s: s[1:]):
            if self.held and start < self.held[-1][1]:
                start, end = self.held[-1][0], max(end, self.held.pop()[1])
            self.held.append((start, end))

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.held, (end,))
        return not at or self.held[at - 1][1] <= start

    def take(self, start: int, end: int) -> bool:
        """Whether the place was free; it is held from now on."""
        if self.free(start, end):
            insort(self.held, (start, end))
            return True
        return False


def spans_of(texts: list[str | None], trees: Boosted, thresholds: dict[str, float]) -> list[tuple[list, list]]:
    """For each text its base spans and its added spans."""
    base = [base_spans(t) if t else [] for t in texts]
    found = [(k, *p) for k, t in enumerate(texts) if t for p in proposals(t)]
    added: list[list] = [[] for _ in texts]
    if found:
        p = trees.probability(np.array([features(texts[k], *s) for k, *s in found]))
        taken = {k: _Taken(base[k]) for k in {k for k, *_ in found}}
        for score, (k, kind, start, end) in sorted(zip(p.tolist(), found, strict=True), key=lambda f: (-f[0], f[1][0], f[1][2], _RANK[f[1][1]], f[1][3])):
            if score >= thresholds[kind] and taken[k].take(start, end):
                added[k].append((kind, start, end))
    return list(zip(base, added, strict=True))


def plain_choice(text: str, trees: Boosted, thresholds: dict[str, float]) -> list[tuple[str, int, int]]:
    """For tests: the added spans of a text, one proposal after the other, held against all spans before it."""
    base, chosen = base_spans(text), []
    scored = [(float(trees.probability(np.array([features(text, *p)]))[0]), p) for p in proposals(text)]
    for score, (kind, start, end) in sorted(scored, key=lambda f: (-f[0], f[1][1], _RANK[f[1][0]], f[1][2])):
        if score >= thresholds[kind] and all(end <= s or e <= start for _, s, e in base + chosen):
            chosen.append((kind, start, end))
    return chosen


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], _RANK[s[0]])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


_SLICE = 256


def _spans(texts: list, fitted) -> Iterator[tuple[list, list]]:
    for at in range(0, len(texts), _SLICE):
        yield from spans_of(texts[at : at + _SLICE], *fitted)


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: a row per row of documents."""
    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, added in _spans(batch.column(1).to_pylist(), fitted):
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return arrow_pass(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(documents: DataFrame) -> DataFrame:
    """documents with every span of every text replaced by its kind; n_chars, if there, is counted anew."""
    fitted = model()
    packed = documents.select(F.struct(*columns_of(documents)).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            new = [redacted(t, base + added) if t else t for t, (base, added) in zip(texts, _spans(texts, fitted), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row", "text"])

    out = arrow_pass(packed, run, T.StructType([*packed.schema.fields]))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(documents.dtypes).get("n_chars", "long"))}
    return out.select(*(fresh.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns))
