"""Language identification by unigram models that sum over all segmentations.

Each language has a probability for every piece of a fixed public byte-level vocabulary. A text is cut where white
space stands and where letters meet marks or digits of ASCII, as the vocabulary itself is; words carry the space
before them. A word's probability is the sum over all its segmentations into pieces, by a forward algorithm over its
bytes, many words at once in a trie; a text is the product of its words. Pieces are estimated by
expectation-maximisation on word counts of labelled rows.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import documents, remainder_is, text_of

#: Labelled rows per language that the model is fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 400, 3
#: Words whose scores a worker remembers at once (memory only; others are computed again).
REMEMBER = 600_000
#: Bytes of a word up to which words are summed together; a longer one is summed alone.
TOGETHER, CELLS = 64, 1 << 20
#: Probabilities are held times this for each byte of a piece, so that no word that is summed together runs out of range.
SCALE = 1e3
ALPHABET = [b > 127 or chr(b).isalpha() for b in range(256)]
#: Marks and digits of ASCII to spaces; all else to spaces.
LETTERS, OTHERS = (bytes(b if x == keep else 32 for b, x in enumerate(ALPHABET)) for keep in (True, False))


def vocabulary(path: str | None = None) -> list[bytes]:
    import public_tokenizers as P

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        found = {base64.b64decode(x.split()[0]).lower() for x in f}
    return sorted(found | {bytes([b]) for b in range(256)})


def split(text: str | None) -> list[bytes]:
    """Lower-cased words, then runs of marks and digits (their order does not matter to a product)."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    return raw.translate(LETTERS).split() + raw.translate(OTHERS).split()


def piece_text(word: bytes) -> bytes:
    """A word as the vocabulary has it: letters with the space before them."""
    return b" " + word if ALPHABET[word[0]] else word


class Trie:
    """Pieces by their bytes. Edges lie in an open table of (node, byte), so that arrays of nodes step at once."""

    def __init__(self, pieces: list[bytes]):
        edges: dict[int, int] = {}
        ends, nodes = {}, 1
        for number, p in enumerate(pieces):
            at = 0
            for b in p:
                code = at << 8 | b
                if code not in edges:
                    edges[code] = nodes
                    nodes += 1
                at = edges[code]
            ends[at] = number
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.bits = max(4, (4 * nodes).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slots = self.slot(np.fromiter(edges, np.int64, len(edges))).tolist()
        for (code, to), s in zip(edges.items(), slots):
            while self.keys[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.child[s] = code, to

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        code = node.astype(np.int64) << 8 | byte
        slot = self.slot(code)
        there = self.keys[slot]
        out = np.where(there == code, self.child[slot], -1)
        todo = np.flatnonzero((there != code) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            hit = there == code[todo]
            out[todo[hit]] = self.child[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


class Lattice:
    """Words of at most TOGETHER bytes, longest first, and every piece that lies in them by its start and length."""

    def __init__(self, words: list[bytes], trie: Trie):
        self.order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        self.size = np.array([len(words[k]) for k in self.order])
        n, longest = len(words), int(self.size.max(initial=0))
        raw = np.frombuffer(b"".join(words[k] for k in self.order), np.uint8)
        text = np.zeros((longest + 1, n), np.uint8)
        column = np.repeat(np.arange(n), self.size)
        text[np.arange(len(raw)) - np.repeat(np.cumsum(self.size) - self.size, self.size), column] = raw
        #: (start, length, columns, pieces)
        self.spans: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for s in range(longest):
            live = np.arange(int(np.searchsorted(-self.size, -s)))  # the words that reach beyond s
            node = np.zeros(len(live), np.int32)
            for e in range(s, longest):
                long = int(np.searchsorted(live, np.searchsorted(-self.size, -e)))
                live, node = live[:long], node[:long]
                node = trie.step(node, text[e, live])
                ok = node >= 0
                live, node = live[ok], node[ok]
                if not len(live):
                    break
                piece = trie.piece[node]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    self.spans.append((s, e + 1, live[hit], piece[hit]))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """(positions, words, languages): summed probabilities of all ways to a position."""
        alpha = np.zeros((int(self.size.max(initial=0)) + 1, len(self.size), prob.shape[1]))
        alpha[0] = 1
        for s, e, k, piece in self.spans:  # each start comes after all spans that end there
            alpha[e, k] += alpha[s, k] * prob[piece]
        return alpha

    def totals(self, prob: np.ndarray) -> np.ndarray:
        """(words, languages) in the order the words were given."""
        out = np.empty((len(self.size), prob.shape[1]))
        out[self.order] = self.forward(prob)[self.size, np.arange(len(self.size))]
        return out

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece: weight is words x languages."""
        alpha, column = self.forward(prob), np.arange(len(self.size))
        beta = np.zeros_like(alpha)
        beta[self.size, column] = weight[self.order] / np.maximum(alpha[self.size, column], 1e-300)
        out = np.zeros_like(prob)
        for s, e, k, piece in reversed(self.spans):
            flow = beta[e, k] * prob[piece]
            beta[s, k] += flow
            flow *= alpha[s, k]
            for g in range(prob.shape[1]):
                out[:, g] += np.bincount(piece, weights=flow[:, g], minlength=len(prob))
        return out


def scales(pieces: list[bytes]) -> np.ndarray:
    """What each piece's probability is held times; no lattice has pieces of more than TOGETHER bytes."""
    return (SCALE ** np.minimum(TOGETHER, [len(p) for p in pieces]).astype(float))[:, None]


def batches_of(words: list[bytes]) -> list[list[int]]:
    """Numbers of the words in batches of like lengths and bounded cells."""
    out: list[list[int]] = []
    for k in sorted(range(len(words)), key=lambda k: len(words[k])):
        if not out or (len(out[-1]) + 1) * (len(words[k]) + 1) > CELLS:
            out.append([])
        out[-1].append(k)
    return out


class Model:
    """Probabilities of pieces, (pieces, languages), each column summing to one."""

    def __init__(self, langs: list[str], pieces: list[bytes], prob: np.ndarray, trie: Trie | None = None):
        self.langs, self.trie = langs, trie or Trie(pieces)
        self.scaled, self.logs = prob * scales(pieces), np.log(prob)

    def word(self, w: bytes) -> np.ndarray:
        """log probability of a word of any length in each language, summed over its segmentations in logs."""
        ahead, nodes, piece = {0: [0.0] * len(self.langs)}, self.nodes(), self.trie.piece
        for s in range(len(w)):
            a, node, e = ahead.pop(s), 0, s
            while e < len(w) and (node := nodes.get(node << 8 | w[e])) is not None:
                e += 1
                if (k := piece[node]) >= 0:
                    ways = [x + y for x, y in zip(a, self.logs[k].tolist())]
                    there = ahead.get(e)
                    ahead[e] = ways if there is None else [max(x, y) + math.log1p(math.exp(-abs(x - y))) for x, y in zip(there, ways)]
        return np.array(ahead[len(w)])

    def nodes(self) -> dict[int, int]:
        if not hasattr(self, "_nodes"):
            live = np.flatnonzero(self.trie.keys >= 0)
            self._nodes = dict(zip(self.trie.keys[live].tolist(), self.trie.child[live].tolist()))
        return self._nodes

    def many(self, words: list[bytes]) -> np.ndarray:
        """(words, languages): log probabilities."""
        out = np.empty((len(words), len(self.langs)))
        size = np.array([len(w) for w in words])
        short = np.flatnonzero(size <= TOGETHER).tolist()
        for part in batches_of([words[k] for k in short]):
            rows = [short[k] for k in part]
            out[rows] = np.log(np.maximum(Lattice([words[k] for k in rows], self.trie).totals(self.scaled), 1e-300)) - (size[rows] * math.log(SCALE))[:, None]
        for k in np.flatnonzero(size > TOGETHER):
            out[k] = self.word(words[k])
        return out


def fit(counts: dict[str, dict[bytes, int]], path: str | None = None, rounds: int = ROUNDS) -> Model:
    """counts: language -> word (as `piece_text` gives it) -> count. Every piece of the vocabulary has a share.

    A word of more than TOGETHER bytes teaches in parts of that length: only the pieces over a cut are not counted.
    """
    langs = sorted(counts)
    pieces = vocabulary(path)
    parts: dict[bytes, np.ndarray] = {}
    for g, c in enumerate(langs):
        for w, n in counts[c].items():
            for at in range(0, len(w), TOGETHER):
                parts.setdefault(w[at : at + TOGETHER], np.zeros(len(langs)))[g] += n
    words = sorted(parts)
    weight = np.array([parts[w] for w in words]).reshape(len(words), len(langs))
    trie, scale = Trie(pieces), scales(pieces)
    prob = np.repeat(np.array([0.05 ** max(0, 3 - len(p)) for p in pieces])[:, None], len(langs), 1)
    prob /= prob.sum(0)
    lattices = [(Lattice([words[k] for k in part], trie), weight[part]) for part in batches_of(words)]
    single = np.array([len(p) == 1 for p in pieces])[:, None]
    for _ in range(rounds):
        uses = np.zeros_like(prob)
        for lattice, w in lattices:
            uses += lattice.expected(prob * scale, w)
        prob = uses + 0.01 + 0.5 * single
        prob /= prob.sum(0)
    return Model(langs, pieces, prob, trie)


def train(labelled: DataFrame, sample: int = SAMPLE, path: str | None = None, rounds: int = ROUNDS) -> Model | None:
    """labelled: text, lang. Fitted on at most about ``sample`` rows of each language, chosen by a hash of the text."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    share = F.create_map(*(x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, sample / n)))))
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def count(batches):
        got: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in split(text):
                    got[lang, w] = got.get((lang, w), 0) + 1
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got]), pa.array([k[1] for k in got], pa.binary()), pa.array(list(got.values()), pa.int64())], ["lang", "w", "n"])

    counted = rows.where(draw < F.element_at(share, F.col("lang"))).mapInArrow(count, "lang string, w binary, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {g: {} for g in sizes}
    for r in counted.collect():  # the words of the bounded sample
        counts[r[0]][piece_text(bytes(r[1]))] = r[2]
    return fit(counts, path, rounds=rounds)


class Remembered:
    """Words a worker has scored with a model, over all the tasks it runs; it starts anew when it holds too many."""

    key, index, rows = None, {}, np.zeros((0, 0))

    @classmethod
    def totals(cls, model: Model, key: str, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Each text's summed log probabilities by language."""
        if cls.key != key or len(cls.index) > REMEMBER:
            cls.key, cls.index, cls.rows = key, {}, np.zeros((1024, len(model.langs)))
        index, new = cls.index, {}
        for words in texts:
            new.update((w, None) for w in words if w not in index)
        if new:
            first, words = len(index), list(new)
            index.update(zip(words, range(first, first + len(words))))
            if len(index) > len(cls.rows):
                cls.rows = np.concatenate([cls.rows, np.zeros((max(len(cls.rows), len(words)), len(model.langs)))])
            cls.rows[first : len(index)] = model.many([piece_text(w) for w in words])
        return [cls.rows[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(0) for words in texts]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text and any others) with lang_pred and score.

    ``und`` with score 0 where text is null or has no letter, or where nothing was learned; else the language of
    highest probability (ties: first in order) and its posterior under equal priors. Ties and repeated rows are
    scored each; an empty table gives no rows. Columns named lang_pred or score are replaced.
    """
    import uuid

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # the vocabulary times the languages
    at = names.index("text")

    def score(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            live = [n for n, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
            pred, conf = ["und"] * len(texts), [0.0] * len(texts)
            for low in range(0, len(live), 256):  # the words of some texts are summed together
                part = live[low : low + 256]
                for n, total in zip(part, Remembered.totals(model, key, [split(texts[n]) for n in part])):
                    p = np.exp(total - total.max())
                    best = int(np.argmax(p))
                    pred[n], conf[n] = model.langs[best], float(p[best] / p.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(conf, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", lang_pred string, score double"
    return docs.select(*names).mapInArrow(score, schema)


def op4_segmentation_langid(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~remainder_is("doc_id", 4, 2)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", remainder_is("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
