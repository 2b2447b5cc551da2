"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as the begin (B) or inside (I) of a secret or outside (O), from their shape, the words
around and features of the whole text; spans are decoded by Viterbi. It is trained here, by gradients of the
log-likelihood through forward and backward sums, on texts whose patterns' spans serve as labels, once as they are
and some times with another secret and another word before it, so that it learns more than the patterns say. Only tokens
near an unusual run can be B or I: letters, digits, hyphens and underscores, 8 at least, with a digit, a capital
after a small letter, or 8 capitals in it. All others are O by constraint, so decoding the neighbourhoods of such
runs is decoding the whole text; runs of small letters alone are never tagged.
"""

from __future__ import annotations

import math
import pickle
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import documents, text_of

# Fixed patterns, and the least length of what they find.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
#: Texts with and without a pattern's span that the field is trained on, each; rounds; characters around a run.
SAMPLE, EPOCHS, BEFORE, AFTER, RUN = 300, 6, 60, 30, 8
KEY = re.compile("|".join(["password", "passwd", "secret", "token", "api_?key"]), re.I)
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and not overlapping within a kind; by start, then as the kinds are listed."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secret_parts(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The secrets themselves: of an assignment, the value."""
    out = []
    for s, e, kind in spans:
        out.append(ASSIGN.match(text, s).span(2) if kind == "assign" else (s, e))
    return out


def _class(b: int) -> int:
    c = chr(b)
    return ord("9" if c.isdigit() else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "-" if c in "-_" else " ")


#: Each byte's class: small letter, capital, digit, joint or other; one byte a character, others than ASCII are other.
CLASSES = bytes(map(_class, range(128))) + b" " * 128
UNUSUAL, OUTSIDE = re.compile(rb"9|aA|A{8}"), re.compile(rb"[^aA9-]")


def neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Parts of the text around unusual runs."""
    out: list[list[int]] = []
    kinds = text.encode("ascii", "replace").translate(CLASSES)
    at = 0
    while m := UNUSUAL.search(kinds, at):
        s = m.start()
        while s and kinds[s - 1] != 32:
            s -= 1
        end = OUTSIDE.search(kinds, m.end())
        e = at = end.start() if end else len(kinds)
        if len(kinds[s:e].strip(b"-")) < RUN:
            continue
        low, high = max(0, s - BEFORE), min(len(text), e + AFTER)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def shape(token: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c for c in token[:64])
    return re.sub(r"(.)\1+", r"\1\1", kinds)[:6]


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    return [
        f"file:lines{min(4, (text.count(chr(10)) + 1).bit_length() // 2)}",
        f"file:equals{min(3, text.count('='))}",
        f"file:quotes{min(3, text.count(chr(34)) // 2)}",
        f"file:size{min(6, n.bit_length() // 3)}",
    ]


def features(tokens: list[str], file: list[str]) -> list[list[str]]:
    shapes = [shape(t) for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        word, mixed = t.isalnum(), any(c.isdigit() for c in t) and any(c.isalpha() for c in t)
        kind = "mark" if not word else "mixed" if mixed else "digits" if t.isdigit() else "letters"
        f = ["bias", f"shape:{shapes[i]}", f"kind:{kind}:{min(10, len(t) // 4)}", f"prev:{shapes[i - 1] if i else '^'}", f"next:{shapes[i + 1] if i + 1 < len(tokens) else '$'}"]
        turns = sum(a.islower() and b.isupper() for a, b in zip(t, t[1:])) if kind == "letters" and len(t) >= RUN else 0
        if turns:
            f.append(f"turns:{min(4, turns)}")
        if kind in ("mixed", "digits") or turns > 1 or (kind == "letters" and len(t) >= RUN and t.isupper()):
            f.append(f"entropy:{kind}:{int(2 * entropy(t))}")
            f.append(f"hex:{kind}:{all(c in '0123456789abcdef' for c in t)}")
            f += [f"{x}:{kind}" for x in file]
            for back in range(1, 6):
                if i >= back and tokens[i - back].isalpha():
                    f.append(f"after:{tokens[i - back].lower()}")
                    break
            if i and tokens[i - 1] in "\"'=:":
                f.append(f"told:{tokens[i - 1]}")
            if i and i + 1 < len(tokens) and tokens[i - 1] == tokens[i + 1]:
                f.append(f"within:{tokens[i - 1]}")
        out.append(f)
    return out


class Field:
    """Weights of emissions and transitions over (B, I, O); I follows B or I only."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.emit = np.zeros((0, 3))
        self.move = np.zeros((3, 3))
        self.move[O, I] = -1e4
        self.first = np.array([0.0, -1e4, 0.0])

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.names.get
        out = np.zeros((len(rows), 3))
        for i, r in enumerate(rows):
            k = [x for x in map(get, r) if x is not None]
            if k:
                out[i] = self.emit[k].sum(0)
        return out

    def viterbi(self, emit: np.ndarray) -> list[int]:
        best, back = (self.first + emit[0]).tolist(), []
        move = self.move.tolist()
        for e in emit[1:].tolist():
            step, now = [], []
            for y in (B, I, O):
                x = max((B, I, O), key=lambda x: best[x] + move[x][y])
                step.append(x), now.append(best[x] + move[x][y] + e[y])
            best, back = now, [*back, step]
        y = max((B, I, O), key=best.__getitem__)
        out = [y]
        for step in reversed(back):
            out.append(y := step[y])
        return out[::-1]

    def marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each label, and expected counts of each transition."""
        n = len(emit)
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        a[0] = self.first + emit[0]
        for t in range(1, n):
            x = a[t - 1][:, None] + self.move
            top = x.max(0)
            a[t] = emit[t] + top + np.log(np.exp(x - top).sum(0))
        for t in range(n - 2, -1, -1):
            x = self.move + emit[t + 1] + b[t + 1]
            top = x.max(1)
            b[t] = top + np.log(np.exp(x - top[:, None]).sum(1))
        z = np.logaddexp.reduce(a[-1])
        pair = np.exp(a[:-1, :, None] + self.move + (emit[1:] + b[1:])[:, None, :] - z).sum(0) if n > 1 else np.zeros((3, 3))
        return np.exp(a + b - z), pair

    def fit(self, data: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, seed: int = 5) -> None:
        seen = Counter(f for rows, _ in data for r in rows for f in set(r))
        self.names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
        self.emit = np.zeros((len(self.names), 3))
        ids = [([[self.names[f] for f in r if f in self.names] for r in rows], labels) for rows, labels in data]
        rng, squares, moved = np.random.default_rng(seed), np.full((len(self.names), 3), 1e-2), np.full((3, 3), 1e-2)
        for _ in range(epochs):
            for k in rng.permutation(len(ids)):
                rows, labels = ids[k]
                if not rows:
                    continue
                emit = np.array([self.emit[r].sum(0) for r in rows])
                p, pair = self.marginals(emit)
                for t, y in enumerate(labels):
                    p[t, y] -= 1
                for t in range(1, len(labels)):
                    pair[labels[t - 1], labels[t]] -= 1
                for r, g in zip(rows, p):
                    if np.abs(g).max() > 1e-4:
                        squares[r] += g * g
                        self.emit[r] -= rate * g / np.sqrt(squares[r])
                moved += pair * pair
                step = rate * pair / np.sqrt(moved)
                step[O, I] = 0
                self.move -= step


def labelled(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the neighbourhoods of a text, its patterns' spans taken as the truth."""
    return told(text, secret_parts(text, base_spans(text)))


def told(text: str, parts: list[tuple[int, int]]) -> list[tuple[list[list[str]], list[int]]]:
    file, out = file_features(text), []
    for low, high in neighbourhoods(text):
        at = [m.span() for m in TOKEN.finditer(text, low, high)]
        labels = [O] * len(at)
        for s, e in parts:
            inside = [i for i, (a, b) in enumerate(at) if a >= s and b <= e]
            for n, i in enumerate(inside):
                labels[i] = I if n else B
        out.append((features([text[a:b] for a, b in at], file), labels))
    return out


#: What secrets that no pattern knows are made of: letters, letters and digits, groups of them;
#: copies of a
#: text with others in it, and what may stand between a word and them.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

VARIANTS = 3
BETWEEN = (" ", " is ", ": ", " => ", "=", ' "', " '", " (", ", ", ":")


def varied(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with each secret drawn anew, and the words of the pattern's key by other words of the text."""
    spans = base_spans(text)
    others = [w for w in text[:5_000].split() if w.isalpha() and w.isascii()] or ["word"]
    out, parts, done, size = [], [], 0, 0

    def put(x: str) -> None:
        nonlocal size
        out.append(x)
        size += len(x)

    for (s, e, _), (low, high) in zip(spans, secret_parts(text, spans)):
        if s < done:
            continue
        put(text[done:s])
        put(rng.choice(others) + rng.choice(BETWEEN) if rng.random() < 0.6 else KEY.sub(lambda m: rng.choice(others), text[s:low]))
        letters, n = rng.choice(ALPHABETS), rng.randint(12, 40)
        new = "".join(rng.choices(letters, k=n))
        if rng.random() < 0.3:
            new = "-".join(new[i : i + 4] for i in range(0, n - n % 4, 4))
        parts.append((size, size + len(new)))
        put(new)
        put(text[high:e])
        done = e
    put(text[done:])
    return "".join(out), parts


def train(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field trained on ``sample`` texts with a pattern's span and as many without, chosen by a hash of the text."""
    pattern = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    rows = docs.select(text_of().alias("text")).where(F.col("text").rlike("[0-9]|[a-z][A-Z]")).select(F.xxhash64("text").alias("k"), "text")
    keyed = rows.select("k", F.col("text").rlike(pattern).alias("has"))
    # hashes are chosen first; only the chosen texts are read
    chosen = {has: [r[0] for r in keyed.where(F.col("has") == has).select("k").distinct().orderBy("k").limit(sample).collect()] for has in (True, False)}

    def read(batches):
        for batch in batches:
            data = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng, d = random.Random(k), labelled(text)
                if any(y != O for _, labels in d for y in labels):
                    d += [x for _ in range(VARIANTS) for x in told(*varied(text, rng))]
                data.append((k, pickle.dumps(d)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in data], pa.int64()), pa.array([d for _, d in data], pa.binary())], ["k", "d"])

    every = chosen[True] + chosen[False]
    got = {r[0]: bytes(r[1]) for r in rows.where(F.col("k").isin(every)).mapInArrow(read, "k long, d binary").collect()} if every else {}  # at most 2 x sample texts
    data = [x for _, d in sorted(got.items()) for x in pickle.loads(d)]
    if not any(y != O for _, labels in data for y in labels):
        return None
    field = Field()
    field.fit(data)
    return field


def added(text: str, base: list[tuple[int, int, str]], field: Field) -> list[tuple[int, int, str]]:
    """Spans the field finds that no pattern's span touches."""
    out, file = [], None
    for low, high in neighbourhoods(text):
        file = file or file_features(text)
        at = [m.span() for m in TOKEN.finditer(text, low, high)]
        if not at:
            continue
        labels, run = field.viterbi(field.scores(features([text[a:b] for a, b in at], file))), None
        for (a, b), y in [*zip(at, labels), ((0, 0), O)]:
            if y == I and run:
                run[1] = b
                continue
            if run and run[1] - run[0] >= 6 and all(run[1] <= s or run[0] >= e for s, e, _ in base):
                out.append((run[0], run[1], "crf"))
            run = [a, b] if y == B else None
    return out


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    docs: doc_id, text; other columns are ignored. Null text is empty: no spans. Repeated rows are scanned each.
    Offsets are code points, ends exclusive.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # features of a bounded sample

    def run(batches):
        field = sent.value
        for batch in batches:
            out = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = added(text, base, field) if field else []
                spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                say = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
                for column, x in zip(out, (*(sum(k == kind for _, _, k in base) for kind in KINDS[:3]), sha256(say(base).encode()).hexdigest(), say(spans), len(more))):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
    )


def op1_crf_secrets(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, train(docs))
