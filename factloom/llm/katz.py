"""Katz backoff language model: bigrams that back off to unigrams.

Counts up to K are discounted by Good-Turing (by half a count where the counts of counts do not allow it), larger
ones by half a count; what is taken goes to the words not seen after a history, by weights that make every
history's probabilities sum to one. Counts live in tables dealt by key: groups of documents ask buckets of words
for unigram counts, send their bigrams with them to buckets of histories, and get sums of log probabilities back.
The probability of a token is that of its bigram, or the weight of its history times that of its unigram; words
never seen share the unigram mass left, as many of them as there are known ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, documents, pack, release, remainder_is, unpack, written
from factloom.llm.groups import MESSAGE, NEWS, TEXT, counts, dealt, deliver, delta, group_documents, rows, text_messages, undelta

K = 5
#: Parts that the words after a history are dealt to, so that no task holds all of a frequent history.
SPLIT = 8
#: Tokens with spaces in them are no words of a text.
START, END = b" start", b" end"
STATS, HISTORY, EVENT, SUMS, BASE = 2, 3, 4, 5, 6
#: Tokens whose words are counted before they are sent.
FLUSH = 6_000_000
#: Bytes of text in a group.
GROUP_BYTES = 12_000_000


class Numbers(dict):
    """word -> number, from 0 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.fromiter(map(xxh64_intdigest, self), np.uint64, len(self))


def discounts(n: list[int]) -> list[float]:
    """What is left of a count of 1..K, from the numbers n[r-1] of items counted r times, r = 1..K+1."""
    if min(n[: K + 1]) > 0:
        tail = (K + 1) * n[K] / n[0]
        d = [(((r + 1) * n[r] / n[r - 1]) / r - tail) / (1 - tail) if tail < 1 else 0.0 for r in range(1, K + 1)]
        if all(0 < x < 1 for x in d):
            return d
    return [(r - 0.5) / r for r in range(1, K + 1)]


class Unigrams:
    """Probabilities of words by their counts."""

    def __init__(self, tokens: int, types: int, n: list[int]):
        self.tokens, self.types, self.d = tokens, types, discounts(n)
        small = sum(r * n[r - 1] for r in range(1, K + 1))
        kept = sum(d * r * n[r - 1] for r, d in zip(range(1, K + 1), self.d)) + (tokens - small) - 0.5 * (types - sum(n[:K]))
        self.left = max(1e-12, 1 - kept / tokens) if tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        """Of words counted c times; 0: of each unseen word."""
        c = c.astype(np.float64)
        if not self.tokens:
            return np.full(len(c), self.left)
        rate = np.r_[0.0, self.d][np.minimum(c, K).astype(np.int64)]
        return np.where(c == 0, self.left / max(1, self.types), np.where(c <= K, rate * c, c - 0.5) / self.tokens)


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def score(docs: DataFrame, held: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    docs: doc_id, text; other columns are ignored; ``held`` says which rows the model does not learn from. Null
    text is empty: its one token is the end. Repeated rows count and are scored each. Without any training row
    all words are unseen ones. Words are told apart by 64 bits of hash.
    """
    groups, buckets = counts(docs, GROUP_BYTES)
    there = dealt(docs, groups, held)

    def ask(batches):
        """The words of my documents and how often they train."""
        vocabulary, wait, size = Numbers(), {}, 0

        def send():
            key = vocabulary.hashes()
            to, out = buckets_of(key, buckets), []
            order = np.lexsort((key, to))
            place = np.empty(len(key), np.int32)
            place[order] = np.arange(len(key), dtype=np.int32)
            key, to = key[order], to[order]
            for g, parts in wait.items():
                x = np.concatenate(parts)
                x = np.sort(2 * place[x >> 1] + (x & 1))
                k = x >> 1
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                n, k = np.add.reduceat(x & 1, first, dtype=np.uint32), k[first]
                cuts = np.flatnonzero(np.r_[True, to[k][1:] != to[k][:-1]])
                out += [(int(to[k[s]]), g, pack(delta(key[k[s:e]]), n[s:e])) for s, e in zip(cuts, np.r_[cuts[1:], len(k)])]
            yield from rows(out)

        for batch in batches:
            for g, held, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                w = vocabulary.of([START, *text.encode("utf-8", "surrogatepass").translate(LOWER).split(), END])
                w *= 2
                w[1:] += not held
                wait.setdefault(g, []).append(w)
                size += len(w)
                if size > FLUSH:
                    yield from send()
                    vocabulary, wait, size = Numbers(), {}, 0
        if wait:
            yield from send()

    def answer(bucket, got):
        found = [(g, *unpack(d)) for g, messages in got.items() for d in messages]
        keys = [undelta(k) for _, k, _ in found]
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([n for *_, n in found]), minlength=len(unique)).astype(np.uint64)
        at, by = 0, {}
        for (g, _, _), k in zip(found, keys):
            by.setdefault(g, []).append(inverse[at : at + len(k)])
            at += len(k)
        yield from rows([(-1, STATS, pack(tally(total), np.array([bucket, len(unique)], np.int64)))])
        for g, parts in by.items():
            i = np.unique(np.concatenate(parts))
            yield from rows([(g, NEWS, pack(delta(unique[i]), total[i].astype(np.uint64), delta(i), np.array([bucket], np.int64)))])

    asked = there.mapInArrow(ask, MESSAGE)
    told = written(deliver(asked, buckets, answer))
    del asked
    release(docs.sparkSession)
    stats = [unpack(r[0]) for r in told.where(F.col("to") == -1).select("data").collect()]  # a row per bucket
    one = sum((x[0] for x in stats), np.zeros(K + 3, np.int64))
    sizes = np.zeros(buckets, np.int64)
    for _, x in stats:
        sizes[x[0]] = x[1]
    before = np.cumsum(sizes) - sizes  # words are numbered bucket by bucket
    unigrams = Unigrams(int(one[0]), int(one[1]), one[2:].tolist())
    tokens, types = unigrams.tokens, unigrams.types

    def pairs(group, got):
        """Base scores, and my bigrams with the counts of their words for the buckets of histories."""
        found = group_documents(got.get(TEXT, []))
        if not found:
            return
        news = [unpack(d) for d in got[NEWS]]
        key, c, number = (np.concatenate(x) for x in zip(*((undelta(k), c, before[b[0]] + undelta(i)) for k, c, i, b in news)))
        order = np.argsort(key)
        vocabulary, index, sizes = Numbers(), [], []
        for _, _, text in found:
            index.append(vocabulary.of([START, *text.translate(LOWER).split(), END]))
            sizes.append(len(index[-1]) - 1)
        mine = order[np.searchsorted(key, vocabulary.hashes(), sorter=order)]
        by = np.argsort(number[mine])
        place = np.empty(len(mine), np.int32)
        place[by] = np.arange(len(mine), dtype=np.int32)
        number, c = number[mine][by], c[mine][by]
        history, word = place[np.concatenate([x[:-1] for x in index])], place[np.concatenate([x[1:] for x in index])]
        start, end = place[vocabulary[START]], place[vocabulary[END]]
        sizes = np.array(sizes)
        doc = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
        del index
        base = np.bincount(doc, weights=np.log10((c.astype(np.float64) + 0.5) / (tokens + 0.5 * (types + 1)))[word], minlength=len(found))
        known = np.bincount(doc, weights=(c > 0)[word], minlength=len(found)).astype(np.int64)
        held = np.array([h for _, h, _ in found], bool)
        ids = np.array([0 if i is None else i for i, _, _ in found], np.int64)
        none = np.array([i is None for i, _, _ in found], np.uint8)
        out = [(group % buckets, (group << 3) | BASE, pack(ids, none, held.astype(np.uint8), sizes.astype(np.int64), known, base))]
        code = history.astype(np.int64) * len(number) + word
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n = np.diff(np.r_[first, len(code)])
        train = np.add.reduceat((~held[doc]).astype(np.int64), first)
        h, w = code[first] // len(number), code[first] % len(number)
        to = (number[h] + number[w] % SPLIT * 7919) % buckets
        by = np.argsort(to.astype(np.uint16 if buckets < 65536 else np.int64), kind="stable")  # h stays in order
        cuts = np.flatnonzero(np.r_[True, to[by][1:] != to[by][:-1]])
        starts = first
        for s, e in zip(cuts, np.r_[cuts[1:], len(by)]):
            k = by[s:e]
            new = np.flatnonzero(np.r_[True, h[k][1:] != h[k][:-1]])
            spots = np.repeat(starts[k] - np.r_[0, np.cumsum(n[k])[:-1]], n[k]) + np.arange(n[k].sum())
            # the start of a text is as frequent as its end
            seen = np.where(h[k][new] == start, c[end], c[h[k][new]])
            out.append((int(to[k[0]]), (group << 3) | NEWS, pack(
                delta(number[h[k][new]]), np.diff(np.r_[new, len(k)]).astype(np.int32), seen.astype(np.uint64),
                number[w[k]], c[w[k]].astype(np.uint64), train[k].astype(np.uint32), n[k].astype(np.uint32), doc[spots].astype(np.int32))))
            if len(out) >= 16:
                yield from rows(out)
                out = []
        yield from rows(out)

    def evaluate(bucket, got):
        """Sums over bigrams by document; counts of counts; what each history has kept; where backing off needs it."""
        found = []
        for kind, messages in got.items():
            group, what = kind >> 3, kind & 7
            if what == BASE:
                yield from rows([(group, BASE, d) for d in messages])
            else:
                found += [(group, *unpack(d)) for d in messages]
        if not found:
            return
        h = np.concatenate([np.repeat(undelta(x[1]), x[2]) for x in found])
        seen = np.concatenate([np.repeat(x[3], x[2]) for x in found])
        w, c, train = (np.concatenate([x[k] for x in found]) for k in (4, 5, 6))
        order = np.lexsort((w, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])]
        pair = np.empty(len(h), np.int64)
        pair[order] = np.cumsum(new) - 1
        head = order[new]
        r = np.bincount(pair, weights=train).astype(np.int64)
        hs, ws = h[head], c[head]
        yield from rows([(-2, STATS, pack(tally(r)))])
        p1 = unigrams.p(ws)
        start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        add = lambda x: np.add.reduceat(x, start)
        large = add(np.where(r > K, r - 0.5, 0.0))
        by_r = [add((r == k).astype(np.int64)).astype(np.uint32) for k in range(1, K + 1)]
        taken = add(np.where(r > 0, p1, 0.0))
        keys, total = hs[start], seen[head][start]
        live = total > 0
        out = {}
        part = keys % buckets
        for b in np.unique(part[live]):
            k = np.flatnonzero(live & (part == b))
            out.setdefault(int(b), []).append((int(b), HISTORY, pack(delta(keys[k]), total[k], large[k], taken[k], *(x[k] for x in by_r))))
        yield from rows([x for v in out.values() for x in v])
        with np.errstate(divide="ignore"):
            fixed = np.where(r > 0, np.log10(np.where(r > K, r - 0.5, np.maximum(r, 1)) / np.maximum(seen[head], 1).astype(np.float64)), np.log10(p1))
        at, sums, events = 0, {}, {}
        for group, _, n, *_, uses, doc in found:
            m = int(n.sum())
            p = np.repeat(pair[at : at + m], uses)
            at += m
            sums.setdefault(group, []).append((doc, p))
        for group, parts in sums.items():
            doc, p = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            who, d = np.unique(doc, return_inverse=True)
            small = [np.bincount(d, weights=r[p] == k, minlength=len(who)).astype(np.uint32) for k in range(1, K + 1)]
            yield from rows([(group, SUMS, pack(delta(who), np.bincount(d, weights=fixed[p], minlength=len(who)), *small))])
            back = np.flatnonzero((r[p] == 0) & (seen[head][p] > 0))
            if len(back):
                k = np.searchsorted(start, p[back], "right") - 1
                key, order = keys[k], np.lexsort((doc[back], keys[k], part[k]))
                key, who, to = key[order], doc[back][order], part[k][order]
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                for s, e in zip(cuts, np.r_[cuts[1:], len(to)]):
                    events.setdefault(int(to[s]), []).append((int(to[s]), (group << 3) | EVENT, pack(delta(key[s:e]), who[s:e])))
        yield from rows([x for v in events.values() for x in v])

    sent = deliver(told.where(F.col("to") >= 0).union(text_messages(there)), min(groups, 100_000), pairs)
    table = written(deliver(sent, buckets, evaluate))
    two = sum((unpack(r[0])[0] for r in table.where(F.col("to") == -2).select("data").collect()), np.zeros(K + 3, np.int64))
    d = discounts(two[2:].tolist())

    def weigh(bucket, got):
        """Sums over the weights of histories by document."""
        parts = [unpack(x) for x in got.get(HISTORY, [])]
        events = [(kind >> 3, *unpack(x)) for kind, messages in got.items() if kind & 7 == EVENT and kind != HISTORY for x in messages]
        if not events:
            return
        keys = np.concatenate([undelta(x[0]) for x in parts])
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        add = lambda k: np.bincount(inverse, weights=np.concatenate([x[k] for x in parts]), minlength=len(unique))
        total = np.concatenate([x[1] for x in parts])[first].astype(np.float64)
        kept = add(2) + sum(d[r - 1] * r * add(3 + r) for r in range(1, K + 1))
        weight = np.log10(np.maximum(1 - kept / total, 1e-300) / np.maximum(1 - add(3), 1e-12))
        by = {}
        for group, k, who in events:
            by.setdefault(group, []).append((who, weight[np.searchsorted(unique, undelta(k))]))
        for group, x in by.items():
            who, v = (np.concatenate([y[k] for y in x]) for k in (0, 1))
            docs, inverse2 = np.unique(who, return_inverse=True)
            zero = np.zeros(len(docs), np.uint32)
            yield from rows([(group, SUMS, pack(delta(docs), np.bincount(inverse2, weights=v, minlength=len(docs)), *[zero] * K))])

    def finish(group, got):
        for data in got.get(BASE, []):
            ids, none, held, n, known, base = unpack(data)
            total = np.zeros(len(ids))
            logs = np.log10(d)
            for x in sorted(got.get(SUMS, [])):  # the order of sums does not depend on arrival
                who, fixed, *small = unpack(x)
                total[undelta(who)] += fixed + sum(s * v for s, v in zip(small, logs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=none.astype(bool)), pa.array(held.astype(bool)), pa.array(n), pa.array(known), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(base), pa.array(total)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    backing = table.where((F.col("kind") == HISTORY) | (F.col("kind").bitwiseAND(7) == EVENT)).where("to >= 0")
    done = table.where(F.col("kind").isin(SUMS, BASE)).union(deliver(backing, buckets, weigh))
    return deliver(done, min(groups, 100_000), finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def tally(c: np.ndarray) -> np.ndarray:
    """Sum, how many are over 0, and how many are 1, 2 .. K + 1."""
    n = np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)
    return np.array([int(c.sum()), int((c > 0).sum()), *n[1 : K + 2]], np.int64)


def op9_katz_scoring(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), remainder_is("doc_id", 5, 1))
