"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns (email, ip, card, phone) are matched in linear time. The field scores whole candidate segments of up to
LONGEST tokens: features look at a segment's digits, shape, checksum and words before it, a dynamic programme over
(segment, type) picks boundaries and types together, and weights maximise the conditional likelihood of generated
sentences (they hold phone numbers without a plus sign or in pairs of digits, dotted card numbers, addresses with ports,
secrets and keys, and versions, dates, prices, social security and bank numbers, version-six addresses and keys of prose as
what to leave alone). An entity must hold a marked token: one with a digit or ``@``, or a ``:`` or ``=`` after a word for
a secret. Tokens further from one than LONGEST can only be outside, so decoding the runs around such tokens decodes the
whole text exactly.

Spans of the patterns always stay; a span of the field is added where it overlaps none of them. Added ones are of the
patterns' kinds or of the kind ``secret``.

Defined cases: null text is empty and has no span; repeated rows each get a row; a null doc_id stays; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.arrowtools import pieces

# The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
MAIL_HOST = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DOTTED = r"[0-9]+(?:\.[0-9]+)*"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

ADDED = "secret"
TYPES = (*KINDS, ADDED)
LONGEST = 5
_NAMES = re.compile("(?i)pass|pwd|secret|token|key")  # what every name below holds
SECRET = r"(?:pass(?:word|wd|phrase|wort)?|pwd|secret|token|api[_-]?key|key)\w*"
KEPT = 200_000
LOOK = 40
EDGES = ".,;:!?|()[]{}<>\"'"


def luhn(digits: str) -> bool:
    """Checksum of a card number."""
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each @, then a dotted host."""
    out, done, after = [], 0, 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            low = max(done, after)
            start = low + len(text[low:at].rstrip(LOCAL))
            if start < at and (m := re.compile(MAIL_HOST).match(text, at)):
                out.append((start, m.end()))
                done = m.end()
        after, at = at + 1, text.find("@", at + 1)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers at a time of every dotted run, each at most 255."""
    out = []
    for m in re.finditer(DOTTED, text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(CARD, text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(PHONE, text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all patterns, by kind, then start."""
    found = (emails(text) if "@" in text else [], *((f(text) for f in (addresses, cards, phones)) if re.search("[0-9]", text) else ([], [], [])))
    return [(k, a, b) for k, spans in zip(KINDS, found) for a, b in spans]


# The field.

CUES = {
    "phone": "tel phone call mobile fax telefon teléfono téléphone handy whatsapp",
    "email": "mail email e-mail contact correo courriel",
    "ip": "ip host server address login adresse dirección",
    "card": "card visa mastercard amex karte tarjeta carte iban",
    ADDED: "password passwd pwd token secret api_key apikey key passwort contraseña",
    "count": "version license lizenz release licence page chapter no. section v",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
OUT = len(TYPES)


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in re.compile(r"\S+").finditer(text, start, end)]


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without marks at its edges; an opening bracket stays if its other half is inside."""
    while a < b and text[b - 1] in EDGES:
        b -= 1
    while a < b and text[a] in EDGES and not (text[a] == "(" and ")" in text[a:b]):
        a += 1
    return a, b


def bucket(n: int) -> str:
    for low in (20, 16, 11, 8, 5, 3, 1):
        if n >= low:
            return str(low)
    return "0"


def features(s: str, before: str, size: int) -> list[str]:
    """Features of a whole segment ``s`` of ``size`` tokens after the word ``before``."""
    digits = re.sub("[^0-9]", "", s)
    shape = re.sub("(.)\\1+", "\\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s[:64]))))
    out = ["bias", f"size{size}", f"digits{bucket(len(digits))}", f"digits{bucket(len(digits))}/{size}"]
    out += [f"shape {shape}"] if len(shape) <= 12 else []
    out += ["letters"] if re.search("[^\\W\\d_]", s) else ["no letters"]
    if cue := _CUE.get(before.strip(EDGES + "=").lower()):
        out.append(f"after {cue}")
    if "@" in s:
        out.append("at and dot" if re.search(r"[^\s@]@[^\s@]+\.[^\s@]", s) else "at")
    if 13 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/[0-9]+)?", s):
        out.append("quad")
    if (at := assigned(s)) is not None:
        out.append(f"assigned secret {s[at]}" + (" with digits" if digits else "") + (" word" if s[at + 1 :].lstrip().isalpha() else ""))
    elif re.match(rf"(?i){SECRET}\s*[:=]", s):
        out.append("assigned and more")
    if re.search(r"\b(?:[0-9a-f]{16,}|[A-Z0-9]{16,})\b", s) and digits and re.search("[A-Za-z]", s):
        out.append("key run")
    if re.fullmatch(r"\+?[0-9() .-]*", s):
        out.append(f"dial {bucket(len(digits))}" + ("(" if "(" in s else "") + ("+" if s[0] == "+" else ""))
    return out


def names_secret(text: str, low: int, end: int) -> bool:
    """Whether the word that ends at ``end`` (and starts at ``low`` at the earliest) names a secret."""
    start = end
    while start > low and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return _NAMES.search(text, start, end) is not None


def after_name(text: str, low: int, at: int) -> bool:
    """Whether a secret's name ends before ``at``, but for white space and assignment marks; looks back to ``low``."""
    while at > low and (text[at - 1] in ":=" or text[at - 1].isspace()):
        at -= 1
    return names_secret(text, low, at)


def assigned(s: str) -> int | None:
    """The first assignment mark of a segment between a secret's name and its last token, of six characters or more."""
    last = max((m.end() for m in re.finditer(r"\s+", s)), default=0)
    marks = [m.start() for m in re.compile("[:=]").finditer(s, last, max(last, len(s) - 6))]
    before = len(s[:last].rstrip()) - 1
    if last and len(s) - last >= 6 and s[before] in ":=":
        marks.insert(0, before)
    low = 0
    for at in marks:
        if names_secret(s, low, low + len(s[low:at].rstrip())):
            return at
        low = at + 1
    return None


def marked(text: str, a: int, b: int) -> bool:
    """Whether a token may be in an entity by itself."""
    s = text[a:b]
    if re.search("[0-9@]", s):
        return True
    at = max(s.rfind(":"), s.rfind("="))
    return at >= 0 and after_name(text, max(0, a - LOOK), a + at)


class Field:
    """Weights by (type, feature) and between neighbouring types."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None, moves: np.ndarray | None = None):
        self.weights = weights or {}
        self.moves = moves if moves is not None else np.zeros((OUT + 1, OUT + 1))
        self.known: dict[tuple[str, ...], list[float]] | None = None  # scores by features, once learning is over

    def segments(self, text: str, toks: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """By end: (start, features) of each candidate entity."""
        own = [marked(text, a, b) for a, b in toks]
        out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(toks) + 1)]
        for j in range(1, len(toks) + 1):
            for i in range(max(0, j - LONGEST), j):
                if any(own[i:j]):
                    a, b = trimmed(text, toks[i][0], toks[j - 1][1])
                    if a < b:
                        before = text[slice(*toks[i - 1])] if i else ""
                        out[j].append((i, features(text[a:b], before, j - i)))
        return out

    def scores(self, feats: list[str]) -> list[float]:
        if self.known is None:
            return [sum(self.weights.get((t, f), 0.0) for f in feats) for t in range(OUT)]
        key = tuple(feats)
        if key not in self.known:
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[key] = [sum(self.weights.get((t, f), 0.0) for f in feats) for t in range(OUT)]
        return self.known[key]

    def decode(self, text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(type, first token, end token) of the best segmentation."""
        n, moves = len(toks), self.moves.tolist()
        none = float("-inf")
        best = [[none] * (OUT + 1) for _ in range(n + 1)]
        best[0][OUT] = 0.0
        back: list[list[tuple[int, int]]] = [[(0, OUT)] * (OUT + 1) for _ in range(n + 1)]
        into: list[list[tuple[float, int]]] = []  # by token and next type: the best score before it, and the type there
        for j, found in enumerate(self.segments(text, toks)):
            now = best[j]
            if j:
                now[OUT], p = into[j - 1][OUT]
                back[j][OUT] = (j - 1, p)
            for i, feats in found:
                part, reach = self.scores(feats), into[i]
                for y in range(OUT):
                    s = reach[y][0] + part[y]
                    if s > now[y]:
                        now[y], back[j][y] = s, (i, reach[y][1])
            into.append([max((now[p] + moves[p][y], -p) for p in range(OUT + 1)) for y in range(OUT + 1)])
            into[-1] = [(s, -p) for s, p in into[-1]]
        out, j, y = [], n, max(range(OUT + 1), key=lambda y: best[n][y])
        while j:
            i, p = back[j][y]
            if y != OUT:
                out.append((y, i, j))
            j, y = i, p
        return out[::-1]

    def learn(self, text: str, toks: list[tuple[int, int]], gold: set[tuple[int, int, int]], rate: float) -> None:
        """One step up the gradient of the log-likelihood of ``gold`` (forward-backward over segments)."""
        n, found = len(toks), self.segments(text, toks)
        arcs = [(j - 1, j, OUT, 0.0, None) for j in range(1, n + 1)]
        for j in range(1, n + 1):
            for i, f in found[j]:
                s = self.scores(f)
                arcs += [(i, j, y, float(s[y]), f) for y in range(OUT)]
        arcs.sort(key=lambda x: x[1])
        alpha = np.full((n + 1, OUT + 1), -np.inf)
        alpha[0, OUT] = 0
        for i, j, y, s, _ in arcs:
            alpha[j, y] = np.logaddexp(alpha[j, y], _sum(alpha[i] + self.moves[:, y]) + s)
        beta = np.full((n + 1, OUT + 1), -np.inf)
        beta[n] = 0
        for i, j, y, s, _ in sorted(arcs, key=lambda x: -x[0]):
            beta[i] = np.logaddexp(beta[i], self.moves[:, y] + s + beta[j, y])
        total = _sum(alpha[n])
        grad, moves = {}, np.zeros_like(self.moves)
        for i, j, y, s, f in arcs:
            p = np.exp(alpha[i] + self.moves[:, y] + s + beta[j, y] - total)
            moves[:, y] -= p
            share = p.sum()
            for x in f or ():
                grad[y, x] = grad.get((y, x), 0.0) - share
            if (y, i, j) in gold:
                for x in f or ():
                    grad[y, x] += 1.0
        at, last = 0, OUT
        ends = {i: (y, j) for y, i, j in gold}
        while at < n:
            y, at = ends.get(at, (OUT, at + 1))
            moves[last, y] += 1
            last = y
        self.moves += rate * moves
        for k, g in grad.items():
            self.weights[k] = self.weights.get(k, 0.0) * (1 - 1e-4) + rate * g

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(type, start, end) of every entity in a whole text."""
        out = []
        for lo, hi in windows(text):
            toks = tokens(text, lo, hi)
            for y, i, j in self.decode(text, toks):
                out.append((TYPES[y], *trimmed(text, toks[i][0], toks[j - 1][1])))
        return out


def _sum(x: np.ndarray) -> float:
    m = x.max()
    return m + math.log(np.exp(x - m).sum()) if m > -np.inf else -np.inf


def windows(text: str) -> list[tuple[int, int]]:
    """Runs of text around the marked tokens: LONGEST tokens to either side, overlapping ones joined."""
    out: list[list[int]] = []
    seen = 0
    for m in re.finditer("[0-9@:=]+", text):
        if m.start() < seen or (m[0].strip(":=") == "" and not after_name(text, max(0, m.start() - LOOK), m.start())):
            continue
        lo, hi = m.start(), m.end()
        back = re.compile(r"\s*\S+")
        for _ in range(LONGEST):
            while lo > 0 and not text[lo - 1].isspace():
                lo -= 1
            while lo > 0 and text[lo - 1].isspace():
                lo -= 1
        while lo > 0 and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        seen = hi
        for _ in range(LONGEST):
            nxt = back.match(text, hi)
            hi = nxt.end() if nxt else len(text)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated sentence with its entities."""
    r = rng.randint
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("aeiounrstlmdhé") for _ in range(r(2, 9)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    body = d(15)
    card = next(body + c for c in "0123456789" if luhn(body + c))
    makers = {
        "phone": [lambda: f"+{r(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"+{d(11)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{r(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}"],
        "email": [lambda: f"{w()}.{r(1, 99)}@{w()}.example.com", lambda: f"{w()}@{w()}.org", lambda: f"{w()}_{w()}@{w()}.{w()}.net"],
        "ip": [lambda: ".".join(str(r(0, 255)) for _ in range(4)), lambda: ".".join(str(r(0, 255)) for _ in range(4)) + f":{r(20, 9999)}"],
        "card": [lambda: card, lambda: " ".join(card[i : i + 4] for i in range(0, 16, 4)), lambda: ".".join(card[i : i + 4] for i in range(0, 16, 4)), lambda: "-".join(card[i : i + 4] for i in range(0, 16, 4))],
        ADDED: [lambda: f"password={hexa(18)}", lambda: f'token = "{hexa(40)}"', lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"api_key: {hexa(32)}", lambda: f"{rng.choice(['password', 'secret', 'pwd', 'token'])}={w()}{w()}xq", lambda: f"{rng.choice(['password', 'passwd'])}: {w()}{w()}xq"],
    }
    plain = [lambda: f"{r(1, 9)}.{r(0, 9)}", lambda: f"{r(1, 9)}.{r(0, 9)}.{r(0, 9)}", lambda: str(r(1, 2100)), lambda: f"{r(1, 28)}/{r(1, 12)}/{r(1990, 2030)}", lambda: f"{r(0, 23)}:{d(2)}", lambda: f"${r(1, 900)}.{d(2)}", lambda: f"{r(1990, 2030)}-{r(10, 12)}-{r(10, 28)}", lambda: d(r(5, 9)), lambda: f"{w()}{r(1, 99)}", lambda: f"@{w()}", lambda: f"{r(1, 99)}%", lambda: d(r(20, 30)), lambda: f"{d(3)}.{d(3)}"]
    plain += [lambda: f"ssn {d(3)}-{d(2)}-{d(4)}", lambda: "iban " + " ".join(["DE" + d(2)] + [d(4) for _ in range(4)] + [d(2)]), lambda: ":".join(hexa(4) for _ in range(8)), lambda: f"{rng.choice(['key', 'token', 'secret'])}: {w()} {w()}"]
    text, spans = "", []
    for _ in range(r(2, 4)):
        text += " ".join(w() for _ in range(r(1, 4))) + " "
        kind = rng.choice([*TYPES, None, None, None])
        if kind is None:
            text += (rng.choice(["version", "page", w(), w()]) + " ") + rng.choice(plain)()
        else:
            text += rng.choice(["", "", rng.choice(CUES[kind].split()) + " "]) if kind != ADDED else ""
            made = rng.choice(makers[kind])()
            spans.append((kind, len(text), len(text) + len(made)))
            text += made
        text += rng.choice(["", ".", ",", ""]) + " "
    return text.strip(), spans


_TRAINED: dict[tuple[int, int, int], Field] = {}


def trained(n: int = 260, epochs: int = 5, seed: int = 5) -> Field:
    """The field after ``epochs`` passes over ``n`` generated sentences; made once a process."""
    key = (n, epochs, seed)
    if key not in _TRAINED:
        rng, field = random.Random(seed), Field()
        made = [sentence(rng) for _ in range(n)]
        for e in range(epochs):
            for text, spans in made:
                toks = tokens(text, 0, len(text))
                gold = {(TYPES.index(k), next(i for i, t in enumerate(toks) if t[1] > a), next(i for i, t in enumerate(toks) if t[1] >= b) + 1) for k, a, b in spans}
                field.learn(text, toks, gold, 0.3 / (1 + e))
        field.weights = {k: v for k, v in field.weights.items() if abs(v) > 1e-3}
        field.known = {}
        _TRAINED[key] = field
    return _TRAINED[key]


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the patterns, and all spans: those and what the field adds; by kind as listed, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more, i, reach = [], 0, 0
    for k, a, b in sorted(field.spans(text), key=lambda s: s[1]):  # those of the field don't overlap, so their ends are in order too
        while i < len(taken) and taken[i][0] < b:
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= a:
            more.append((k, a, b))
    return base, sorted(base + more, key=lambda s: (TYPES.index(s[0]), s[1], s[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, base array<struct<kind: string, start: int, end: int>>, spans array<struct<kind: string, start: int, end: int>>"
_SPANS = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]


def _finder(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct(_SPANS))
        rows = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]
        for batch in batches:
            for part in pieces(batch, 1, 8 << 20):
                both = [find(t or "", field) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([rows(b) for b, _ in both], kind), pa.array([rows(a) for _, a in both], kind)], names=["doc_id", "base", "spans"])

    return run


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, end exclusive) of every row."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_finder(trained()), FOUND)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, base_sha256, spans, the number of spans added and of all."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
