"""Pairs of sentences that translate one another (problem 5).

Cross-lingual term vectors are learned by singular value decomposition of paired document terms:
per pair of languages, the terms of both sides of a document, or of two sentences that share code names
and numbers of their own, make one row of a term matrix. Its leading right singular vectors come from
one pass over all rows with a fixed random sketch. Sentences are sums of term vectors; within a document, mutual neighbours by margin score are pairs, wherever they stand, and a sentence left over
joins a pair if the merged window of two fits the other side better than its part alone. Names, code and numbers, have no
part in the score: they are an exact check on what the vectors propose. Nor does what all sentences share tell anything: a pair is closer
than either is to the mean of all.

What is sent to the driver and back has a fixed bound: BUCKETS rows for each pair of LANGUAGES.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm import sentences
from driftmark.runtime import checkpointed, ship

#: Terms are hashed into so many buckets per pair of languages; dimensions of the vectors, and of the sketch beyond them.
BUCKETS, DIMENSIONS, SPARE, SEED = 1 << 15, 96, 32, 7
_BLOCK = 512
#: Ends a sentence's terms in the packed arrays; stands for no term.
_STOP = (1 << 16) - 1

# Frequent function words, to tell the language of a text whose language isn't given.
_FUNCTION_WORDS = {
    "en": "the of and to is in that for with by this are".split(),
    "de": "der die das und ist nicht mit für von den ein zu".split(),
    "es": "el la los las que en del por para una con se".split(),
    "fr": "le la les des est et dans pour une que sur du".split(),
    "pt": "o os das dos que em para uma com não do da".split(),
}
_OF_WORD: dict[str, list[str]] = {}
for _lang, _ws in _FUNCTION_WORDS.items():
    for _w in _ws:
        _OF_WORD.setdefault(_w, []).append(_lang)


#: Languages that have a model of their own with each other; all others are one, so the number of models is bounded.
LANGUAGES = frozenset("ar de en es fr hi it ja ko pt ru zh".split())


@dataclass(frozen=True)
class Thresholds:
    """Least cosines of pairs: with equal names, without any, with names in part in common (with none in common there is no pair); and for
    merged windows, with the least gain over one part. above: how much closer a pair is than either of it to the mean of all. block: sentence
    pairs that are held at once."""

    named: float = 0.35
    plain: float = 0.72
    partly: float = 0.45
    window: float = 0.72
    above: float = 0.02
    gain: float = 0.02
    neighbours: int = 4
    order_weight: float = 0.02
    block: int = 1 << 22


def language(lang: str | None, found: list[str]) -> str:
    """Two-letter language, one of LANGUAGES: the given one without region, else by script and function words; '' if nothing tells."""
    if lang and lang.strip():
        given = re.split(r"[-_]", lang.strip().lower())[0]
        return given if given in LANGUAGES else ""
    votes: Counter[str] = Counter()
    for w in sentences.tokens(found):
        if "一" <= w[0] <= "鿿":
            votes["zh"] += 2
        for x in _OF_WORD.get(w.lower(), ()):
            votes[x] += 1
    return min(votes, key=lambda k: (-votes[k], k)) if votes else ""


#: Added to the hashes of names, to tell them from terms.
_NAME = 1 << 32


class _Hashed:
    """Hashed sentences of many texts, one after the other. terms: each sentence's, with _STOP after them, from first[k] to first[k + 1];
    names: each sentence's in order, without repetition, from name_first[k] to name_first[k + 1]. memo: of tokens, begun anew when full."""

    def __init__(self, tokens: list[str], memo: dict):
        if len(memo) > 300_000:
            memo.clear()
        for token in set(tokens).difference(memo):
            name, terms = sentences.terms_of(token)
            hashes = [zlib.crc32(x.encode()) for x in terms]
            memo[token] = [x % (1 << 31) + _NAME for x in hashes] if name else [x % BUCKETS for x in hashes]
        memo[sentences.BETWEEN] = [_STOP]
        values = np.fromiter(chain.from_iterable(map(memo.__getitem__, tokens)), np.int64)
        named = values >= _NAME
        self.terms = values[~named].astype(np.uint16)
        self.first = np.r_[0, np.flatnonzero(self.terms == _STOP) + 1]
        at = np.flatnonzero(named)
        code = np.unique((np.searchsorted(np.flatnonzero(values == _STOP), at) << 31) + (values[at] - _NAME))
        self.names = (code & (1 << 31) - 1).astype(np.int32)
        self.name_first = np.searchsorted(code >> 31, np.arange(len(self.first)))

    def of(self, sentence: np.ndarray) -> np.ndarray:
        """The terms of these sentences, one after the other, without _STOP."""
        low, size = self.first[sentence], self.first[sentence + 1] - self.first[sentence] - 1
        return self.terms[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _pack(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


#: Columns of a prepared document; all but the first three are packed arrays. Sides: a source, b target.
_PREPARED = (
    "tab string, rec_id bigint, langs string, a_at binary, a_size binary, a_terms binary, a_names binary, a_n binary, "
    "b_at binary, b_size binary, b_terms binary, b_names binary, b_n binary, rows binary, row_size binary"
)


def prepare_one(source: str, target: str, source_lang: str | None, target_lang: str | None, patch: bool, memo: dict) -> list | None:
    """The packed columns of one pair of texts from ``langs`` on; None if a side has no sentence."""
    return prepare_many([(patch, source, target, source_lang, target_lang)], memo)[0]


def prepare_many(pairs: list[tuple], memo: dict) -> list[list | None]:
    """What ``prepare_one`` gives for each (patch, source, target, source_lang, target_lang), hashed and packed together."""
    cut_pairs, tokens, n = [], [], 0
    for patch, source, target, source_lang, target_lang in pairs:
        cut = sentences.of_patch if patch else sentences.of_markdown
        a = cut(source)
        b = cut(target) if a else []
        if not b:
            cut_pairs.append(None)
            continue
        (at_a, text_a), (at_b, text_b) = zip(*a), zip(*b)
        langs = "-".join(sorted((language(source_lang, text_a), language(target_lang, text_b))))
        tokens += sentences.tokens(text_a)
        tokens += sentences.tokens(text_b)
        cut_pairs.append((langs, at_a, at_b, n))
        n += len(a) + len(b)
    held = _Hashed(tokens, memo)
    first, name_first, names = held.first, held.name_first, held.names.tobytes()
    size, name_size = np.diff(first).astype(np.int32), np.diff(name_first).astype(np.int32)
    bound, filled = (name_first * 4).tolist(), (size > 1).tolist()
    keys = [names[lo:hi] for lo, hi in zip(bound, bound[1:])]
    rows, ends = [], [0]
    for one in cut_pairs:
        if one:
            _, at_a, at_b, lo = one
            mid, hi = lo + len(at_a), lo + len(at_a) + len(at_b)
            rows += [[lo + k for k in r] for r in _rows(keys[lo:mid], keys[mid:hi], filled[lo:hi])]
        ends.append(len(rows))
    row_sentences = np.fromiter(chain.from_iterable(rows), np.int64)
    row_terms = held.of(row_sentences)
    row_ends = np.cumsum(np.r_[0, size[row_sentences] - 1])[np.cumsum([0, *map(len, rows)])]
    row_size = np.diff(row_ends).astype(np.int32)
    out: list[list | None] = []
    for k, one in enumerate(cut_pairs):
        if not one:
            out.append(None)
            continue
        langs, at_a, at_b, lo = one
        packed: list = [langs]
        for at in (at_a, at_b):
            hi = lo + len(at)
            packed += [_pack(at, np.int32), size[lo:hi].tobytes(), held.terms[first[lo]:first[hi]].tobytes(), names[bound[lo]:bound[hi]], name_size[lo:hi].tobytes()]
            lo = hi
        packed += [row_terms[row_ends[ends[k]]:row_ends[ends[k + 1]]].tobytes(), row_size[ends[k]:ends[k + 1]].tobytes()]
        out.append(packed)
    return out


def _rows(ka: list[bytes], kb: list[bytes], filled: list[bool]) -> list[list[int]]:
    """Rows of the term matrix, as sentences, those of b counted on from a: the two that alone have certain names, and what stands between such pairs on both sides.

    ka, kb: the names of each; filled: which have terms. Pairs that cross others bound no stretch. What has nothing opposite is one row with the like on the other side.
    """
    n, m = len(ka), len(kb)
    ca, cb = Counter(ka), Counter(kb)
    where = {k: n + j for j, k in enumerate(kb)}
    pairs = [(i, where[k]) for i, k in enumerate(ka) if k and ca[k] == 1 and cb.get(k) == 1]
    rows = [[*p] for p in pairs]
    free = filled[:]
    for p in pairs:
        free[p[0]] = free[p[1]] = False
    # The pairs in the order of both sides: those that no neighbour on the source side crosses.
    bounds = [p for x, p in enumerate(pairs) if (x == 0 or pairs[x - 1][1] < p[1]) and (x == len(pairs) - 1 or p[1] < pairs[x + 1][1])]
    steady, low = [], -1
    for i, j in bounds:
        if j > low:
            steady.append((i, j))
            low = j
    rest_a: list[int] = []
    rest_b: list[int] = []
    pi, pj = -1, n - 1
    for i, j in [*steady, (n, n + m)]:
        ta = [x for x in range(pi + 1, i) if free[x]]
        tb = [x for x in range(pj + 1, j) if free[x]]
        if ta and tb:
            rows.append(ta + tb)
        else:
            rest_a += ta
            rest_b += tb
        pi, pj = i, j
    if rest_a and rest_b:
        rows.append(rest_a + rest_b)
    return [r for r in rows if any(filled[x] for x in r)]


def _parts(batch, size: int, most: int = 1 << 21):
    """Slices of a batch, of ``size`` rows, or of as few as hold ``most`` bytes; one row at least."""
    at = 0
    while at < batch.num_rows:
        n = min(size, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > most:
            n //= 2
        yield batch.slice(at, n)
        at += n


def prepared(pairs: DataFrame) -> DataFrame:
    """Sentences and hashed terms of ``tab, rec_id, patch, source, target, source_lang, target_lang``; a row per pair of texts that both hold a sentence."""
    ship(pairs.sparkSession)
    names = [c.split()[0] for c in _PREPARED.split(", ")]

    def prepare(batches):
        import pyarrow as pa

        memo: dict = {}
        types = [pa.string(), pa.int64(), pa.string(), *[pa.binary()] * 12]
        for big in batches:
            for b in _parts(big, 500):
                tabs, recs, *texts = (c.to_pylist() for c in b.columns)
                out = [[tab, rec, *one] for tab, rec, one in zip(tabs, recs, prepare_many(list(zip(*texts)), memo)) if one]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], types[k]) for k in range(15)], names)

    rows = pairs.where("source IS NOT NULL AND target IS NOT NULL AND length(source) > 0 AND length(target) > 0")
    return rows.select("tab", "rec_id", "patch", "source", "target", "source_lang", "target_lang").mapInArrow(prepare, _PREPARED)


def _matrix(b) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per pair of languages of a batch: (langs, row, term, count) of the entries of its rows, in order of row."""
    held: dict[str, list] = {}
    for langs, terms, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
        held.setdefault(langs, []).append((np.frombuffer(terms, np.uint16), np.frombuffer(sizes, np.int32)))
    out = []
    for langs, parts in held.items():
        terms = np.concatenate([p[0] for p in parts]).astype(np.int64)
        sizes = np.concatenate([p[1] for p in parts])
        if not len(terms):
            continue
        code, count = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * BUCKETS + terms, return_counts=True)
        out.append((langs, code // BUCKETS, code % BUCKETS, count))
    return out


def _frequencies(docs: DataFrame) -> dict[str, tuple[int, np.ndarray]]:
    """Per pair of languages the number of rows and in how many each bucket is; BUCKETS numbers at most are collected."""

    def count(batches):
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}
        for b in batches:
            for langs, row, term, _ in _matrix(b):
                at = held.setdefault(langs, np.zeros(BUCKETS + 1, np.int64))
                at[:BUCKETS] += np.bincount(term, minlength=BUCKETS)
                at[BUCKETS] += len(np.unique(row))
        out = [(k, int(i), int(v[i])) for k, v in held.items() for i in np.flatnonzero(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["langs", "bucket", "n"])

    rows = docs.select("langs", "rows", "row_size").mapInArrow(count, "langs string, bucket int, n bigint").groupBy("langs", "bucket").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for langs, bucket, n in rows.collect():
        out.setdefault(langs, np.zeros(BUCKETS + 1, np.int64))[bucket] = n
    return {k: (int(v[BUCKETS]), v[:BUCKETS]) for k, v in out.items()}


def _sketch_matrix() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS + SPARE), dtype=np.float32)


def _weights(frequencies: dict[str, tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.log1p(n / np.maximum(f, 1)).astype(np.float32) for k, (n, f) in frequencies.items()}


def _products(row: np.ndarray, n: int, term: np.ndarray, weight: np.ndarray, table: np.ndarray, block: int = 1 << 18):
    """Blocks (first row, X, terms) of the matrix X of n rows with these entries, and X times the rows of ``table`` for its terms.

    Only the columns that occur are held, ``block`` numbers at once; a product of dense blocks is faster than a sum over gathered rows.
    """
    there = np.zeros(len(table), bool)
    there[term] = True
    terms = np.flatnonzero(there)
    code = np.cumsum(there)[term] - 1
    known, step = table[terms], max(1, block // max(1, len(terms)))
    edges = np.searchsorted(row, np.arange(0, n + step, step))
    for k in range(-(-n // step)):
        lo, hi = edges[k], edges[k + 1]
        rows = min(step, n - k * step)
        x = np.zeros(rows * len(terms), np.float32)
        np.add.at(x, (row[lo:hi] - k * step) * len(terms) + code[lo:hi], weight[lo:hi])
        x = x.reshape(rows, len(terms))
        yield k * step, x, terms, x @ known


def sketch_batch(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, sums): the rows of X'(X omega) that a batch of rows X, tf-idf and of length 1, adds to."""
    w = np.log1p(count).astype(np.float32) * idf[term]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    index = np.cumsum(np.r_[False, row[1:] != row[:-1]])
    norm = np.sqrt(np.add.reduceat(w * w, first))
    w = w / np.maximum(norm, 1e-9)[index]
    total = None
    for _, x, terms, seen in _products(index, len(first), term, w, omega):
        total = x.T @ seen if total is None else total + x.T @ seen
    return terms, total


def vectors_of(y: np.ndarray, omega: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term vectors from the sketch y = X'(X omega), by the Nystroem form of X'X: right singular vectors by the root of the singular values, times idf."""
    core = omega.T.astype(np.float64) @ y
    values, basis = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(initial=0.0), 0.0) * 1e-7
    if not good.any():
        return np.zeros((len(y), 1), np.float32)
    u, s, _ = np.linalg.svd(y @ (basis[:, good] / np.sqrt(values[good])), full_matrices=False)
    # Two languages share at most half as many directions as they have terms; the rest tells them apart.
    k = max(1, min(DIMENSIONS, len(y) // 2))
    return (u[:, :k] * np.sqrt(s[:k]) * idf[:, None]).astype(np.float32)


#: Per pair of languages: buckets in order, their vectors, the mean of all.
Model = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _sketched(docs: DataFrame, entries, weights: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Buckets and their vectors from one pass; ``entries`` makes (langs, row, term, count) of batches."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers a pair of languages

    def sketch(batches):
        import pyarrow as pa

        omega = _sketch_matrix()
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for langs, row, term, n in entries(batches):
            if langs not in held:
                held[langs] = np.zeros((BUCKETS, DIMENSIONS + SPARE), np.float32), np.zeros(BUCKETS, bool)
            total, seen = held[langs]
            terms, sums = sketch_batch(row, term, n, shared.value[langs], omega)
            total[terms] += sums
            seen[terms] = True
        out = []
        for langs, (total, seen) in held.items():
            for lo in range(0, BUCKETS, _BLOCK):
                ids = np.flatnonzero(seen[lo:lo + _BLOCK]) + lo
                if len(ids):
                    out.append((langs, lo, ids.astype(np.int32).tobytes(), total[ids].tobytes()))
        types = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], ["langs", "block", "ids", "sums"])

    def add(key, pdf):
        import pandas as pd

        total, seen = np.zeros((_BLOCK, DIMENSIONS + SPARE), np.float64), np.zeros(_BLOCK, bool)
        for ids, sums in zip(pdf.ids, pdf.sums):
            at = np.frombuffer(ids, np.int32) - key[1]
            total[at] += np.frombuffer(sums, np.float32).reshape(len(at), -1)
            seen[at] = True
        at = np.flatnonzero(seen)
        return pd.DataFrame({"langs": [key[0]], "ids": [(at + key[1]).astype(np.int32).tobytes()], "sums": [total[at].astype(np.float32).tobytes()]})

    parts = docs.mapInArrow(sketch, "langs string, block int, ids binary, sums binary")
    held: dict[str, list] = {}
    for langs, ids, sums in parts.groupBy("langs", "block").applyInPandas(add, "langs string, ids binary, sums binary").collect():
        held.setdefault(langs, []).append((np.frombuffer(ids, np.int32), np.frombuffer(sums, np.float32)))
    omega, model = _sketch_matrix(), {}
    for langs, blocks in sorted(held.items()):
        ids = np.concatenate([b[0] for b in blocks])
        y = np.concatenate([b[1].reshape(len(b[0]), -1) for b in blocks]).astype(np.float64)
        order = np.argsort(ids)
        ids, y = ids[order], y[order]
        model[langs] = (ids, vectors_of(y, omega[ids], weights[langs][ids]))
    shared.unpersist()
    return model


def _slices(batches, size: int):
    for big in batches:
        for at in range(0, big.num_rows, size):
            yield big.slice(at, size)


def with_mean(vectors: dict[str, tuple[np.ndarray, np.ndarray]], frequencies: dict[str, tuple[int, np.ndarray]]) -> Model:
    """Adds the direction of the mean of all rows."""
    out = {}
    for langs, (ids, v) in vectors.items():
        mean = (frequencies[langs][1][ids].astype(np.float64)[:, None] * v).sum(0)
        out[langs] = ids, v, (mean / max(np.sqrt((mean * mean).sum()), 1e-9)).astype(np.float32)
    return out


def learn(docs: DataFrame) -> Model:
    """The model of each pair of languages, from all rows of all documents."""

    def entries(batches):
        for b in _slices(batches, 200):
            yield from _matrix(b)

    frequencies = _frequencies(docs)
    return with_mean(_sketched(docs.select("langs", "rows", "row_size"), entries, _weights(frequencies)), frequencies)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)


def _best_mean(x: np.ndarray, k: int) -> np.ndarray:
    """Mean of the k greatest of each row."""
    size = x.shape[1]
    return x.mean(axis=1) if size <= k else np.partition(x, size - k, axis=1)[:, size - k:].sum(axis=1) / k


class _Scores:
    """Margin scores of the sentences of two texts, block of rows by block of rows: as many as ``Thresholds.block`` are in memory at once.

    Texts that fit into one block, nearly all, are scored once; of longer ones the blocks are made again for each round.
    """

    def __init__(self, ua: np.ndarray, ub: np.ndarray, na: list[frozenset], nb: list[frozenset], mean: np.ndarray, t: Thresholds):
        self.ua, self.ub, self.na, self.t = ua, ub, na, t
        self.n, self.m = len(ua), len(ub)
        self.step = max(1, t.block // max(1, self.m))
        self.holders: dict[int, list[int]] = {}
        for j, names in enumerate(nb):
            for x in names:
                self.holders.setdefault(x, []).append(j)
        self.size_b = np.array([len(x) for x in nb], np.float32)
        self.ground_a, self.ground_b = ua @ mean + t.above, ub @ mean + t.above
        #: Scores and places of the sentences that are free, if all fit into one block.
        self.held: np.ndarray | None = None
        # The means of the best of each row and column, for the margin.
        k = t.neighbours
        if self.step >= self.n:
            self.cos = ua @ ub.T
            self.mean_a, self.mean_b = _best_mean(self.cos, k), _best_mean(self.cos.T, k)
            self.held, self.left_a, self.left_b = self.block(0), np.arange(self.n), np.arange(self.m)
            return
        rows, best = [], None
        for lo in range(0, self.n, self.step):
            cos = ua[lo:lo + self.step] @ ub.T
            rows.append(_best_mean(cos, k))
            top = cos.T if best is None else np.concatenate([best, cos.T], axis=1)
            best = np.partition(top, top.shape[1] - k, axis=1)[:, -k:] if top.shape[1] > k else top
        self.mean_a, self.mean_b = np.concatenate(rows), best.mean(axis=1)

    def block(self, lo: int) -> np.ndarray:
        """Scores of the rows from lo on; -9 where the cosine is too low for what the names of both say."""
        t, hi = self.t, min(self.n, lo + self.step)
        cos = self.cos if self.step >= self.n else self.ua[lo:hi] @ self.ub.T
        size_a = np.array([len(x) for x in self.na[lo:hi]], np.float32)
        # Without names in common: plain where neither has any, else no pair.
        least = np.where(size_a[:, None] + self.size_b == 0, t.plain, 2.0)
        for i, names in enumerate(self.na[lo:hi]):
            if names:
                common: dict[int, int] = {}
                for x in names:
                    for j in self.holders.get(x, ()):
                        common[j] = common.get(j, 0) + 1
                for j, n in common.items():
                    least[i, j] = t.named if n == len(names) == self.size_b[j] else t.partly
        np.maximum(least, np.maximum(self.ground_a[lo:hi, None], self.ground_b), out=least)
        place = np.abs((np.arange(lo, hi) / self.n)[:, None] - np.arange(self.m) / self.m)
        rank = 2 * cos - self.mean_a[lo:hi, None] - self.mean_b - t.order_weight * place
        rank[cos < least] = -9.0
        return rank

    def neighbours(self, free_a: np.ndarray, free_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of the mutual best among the free; in ties the first."""
        if self.held is not None:
            if not self.held.size:
                return self.left_a[:0], self.left_b[:0]
            every, at = np.arange(len(self.held)), self.held.argmax(1)
            rows = np.flatnonzero((self.held[every, at] > -8) & (self.held.argmax(0)[at] == every))
            return self.left_a[rows], self.left_b[at[rows]]
        best_a, at_a = np.full(self.n, -9.0), np.zeros(self.n, np.intp)
        best_b, at_b = np.full(self.m, -9.0), np.zeros(self.m, np.intp)
        every = np.arange(self.m)
        for lo in range(0, self.n, self.step):
            rank = self.block(lo)
            hi = lo + len(rank)
            rank[~free_a[lo:hi], :] = -9.0
            rank[:, ~free_b] = -9.0
            at_a[lo:hi] = rank.argmax(1)
            best_a[lo:hi] = rank[np.arange(hi - lo), at_a[lo:hi]]
            top = rank.argmax(0)
            value = rank[top, every]
            better = value > best_b
            at_b[better], best_b[better] = top[better] + lo, value[better]
        rows = np.flatnonzero((best_a > -8) & (at_b[at_a] == np.arange(self.n)) & (best_b[at_a] > -8))
        return rows, at_a[rows]

    def keep(self, free_a: np.ndarray, free_b: np.ndarray) -> None:
        """Leaves only the free in the scores that are held."""
        if self.held is not None:
            a, b = free_a[self.left_a], free_b[self.left_b]
            self.held, self.left_a, self.left_b = self.held[a][:, b], self.left_a[a], self.left_b[b]


def align_document(va: np.ndarray, vb: np.ndarray, na: list[frozenset], nb: list[frozenset], t: Thresholds = Thresholds(),
                   mean: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of sentences that translate one another. va, vb: sums of term vectors; na, nb: names; mean: the direction of all sentences' mean, if there is a corpus."""
    n, m = len(va), len(vb)
    ua, ub = _unit(va), _unit(vb)
    scores = _Scores(ua, ub, na, nb, np.zeros(va.shape[1], np.float32) if mean is None else mean, t)
    found: list[tuple[int, int]] = []
    free_a, free_b = np.ones(n, bool), np.ones(m, bool)
    while True:
        rows, cols = scores.neighbours(free_a, free_b)
        if not len(rows):
            break
        found += zip(rows.tolist(), cols.tolist())
        free_a[rows] = free_b[cols] = False
        scores.keep(free_a, free_b)
    if found and free_a.any():
        found += [(i, j) for j, i in _joins(ub, va, nb, na, [(j, i) for i, j in found], free_a, t)]
    if found and free_b.any():
        found += _joins(ua, vb, na, nb, found, free_b, t)
    if free_a.any() and free_b.any():
        found += [(i, j) for j, i in _merges(ub, va, nb, na, free_b, free_a, t)]
        found += _merges(ua, vb, na, nb, free_a, free_b, t)
    return found


def _joins(ua: np.ndarray, vb: np.ndarray, na: list, nb: list, found: list[tuple[int, int]], free: np.ndarray, t: Thresholds) -> list[tuple[int, int]]:
    """Pairs (i, j) for sentences j of b left over: i says what j and the sentence paired with i say.

    That is so if the merged window of both fits i better than the other alone, and their names are those of i.
    """
    counts = Counter(i for i, _ in found)
    single = [(i, j) for i, j in found if counts[i] == 1]
    left = np.flatnonzero(free)
    if not single:
        return []
    i_of, j_of = (np.array(x) for x in zip(*single))
    new = vb[left]
    length_new = np.einsum("ij,ij->i", new, new)
    hits = []
    step = max(1, t.block // len(left))
    for lo in range(0, len(single), step):
        unit, other = ua[i_of[lo:lo + step]], vb[j_of[lo:lo + step]]
        with_other = np.einsum("ij,ij->i", unit, other)
        size = np.einsum("ij,ij->i", other, other)
        length = size[:, None] + 2 * (other @ new.T) + length_new[None, :]
        merged = (with_other[:, None] + unit @ new.T) / np.sqrt(np.maximum(length, 1e-12))
        gain = merged - (with_other / np.maximum(np.sqrt(size), 1e-9))[:, None]
        p, q = np.nonzero((merged >= t.window) & (gain >= t.gain))
        hits.append((gain[p, q], p + lo, q))
    gains, p, q = (np.concatenate(x) for x in zip(*hits))
    out: list[tuple[int, int]] = []
    taken: set[int] = set()
    for x in np.argsort(-gains, kind="stable"):
        i, k, j = int(i_of[p[x]]), int(j_of[p[x]]), int(left[q[x]])
        if i not in taken and free[j] and nb[j] <= na[i] <= nb[j] | nb[k]:
            out.append((i, j))
            taken.add(i)
            free[j] = False
    return out


def _merges(ua: np.ndarray, vb: np.ndarray, na: list, nb: list, free_a: np.ndarray, free_b: np.ndarray, t: Thresholds) -> list[tuple[int, int]]:
    """Pairs (i, j), (i, k) of sentences left over on both sides, where i says what j and k say together."""
    out: list[tuple[int, int]] = []
    left = np.flatnonzero(free_b)
    if len(left) < 2:
        return out
    size = np.sqrt(np.maximum(np.einsum("ij,ij->i", vb[left], vb[left]), 1e-12))
    dots = vb[left] @ ua.T
    for i in np.flatnonzero(free_a):
        near = np.array([x for x in range(len(left)) if free_b[left[x]] and nb[left[x]] <= na[i]], np.intp)
        best = None
        # Each part with all after it: every pair, as a short or distant part may complete a window.
        for y, x in enumerate(near[:-1]):
            rest = near[y + 1:]
            both = vb[left[x]] + vb[left[rest]]
            merged = (dots[x, i] + dots[rest, i]) / np.maximum(np.sqrt(np.einsum("ij,ij->i", both, both)), 1e-9)
            alone = np.maximum(dots[x, i] / size[x], dots[rest, i] / size[rest])
            for z in np.flatnonzero((merged >= t.window) & (merged - alone >= t.gain)):
                j, k = int(left[x]), int(left[rest[z]])
                if na[i] == nb[j] | nb[k] and (best is None or merged[z] > best[0]):
                    best = (merged[z], j, k)
        if best:
            out += [(int(i), best[1]), (int(i), best[2])]
            free_b[best[1]] = free_b[best[2]] = False
            free_a[i] = False
    return out


_SIDES = [c.split()[0] for c in _PREPARED.split(", ")][:13]


class _Aligner:
    """Aligns slices of prepared documents; term vectors of all their sentences in the same languages are summed at once."""

    def __init__(self, model: Model):
        self.model = {}
        for langs, (ids, vectors, mean) in model.items():
            at = np.zeros(1 << 16, np.int32)  # 0 is no vector: unknown buckets and _STOP
            at[ids] = np.arange(1, len(ids) + 1, dtype=np.int32)
            self.model[langs] = at, np.concatenate([np.zeros((1, vectors.shape[1]), np.float32), vectors]), mean

    def __call__(self, rows: list[tuple], t: Thresholds):
        """Yields (row, pairs) for each document that has vectors, by languages."""
        held: dict[str, list[tuple]] = {}
        for r in rows:
            if r[2] in self.model:
                held.setdefault(r[2], []).append(r)
        for langs, group in held.items():
            at, vectors, mean = self.model[langs]
            place = at[np.frombuffer(b"".join(x for r in group for x in (r[5], r[10])), np.uint16)]
            size = np.frombuffer(b"".join(x for r in group for x in (r[4], r[9])), np.int32)
            known = place > 0
            sentence = np.repeat(np.arange(len(size)), size)[known]
            sums = np.zeros((len(size), vectors.shape[1]), np.float32)
            for lo, _, _, seen in _products(sentence, len(size), place[known], np.ones(len(sentence), np.float32), vectors):
                sums[lo:lo + len(seen)] = seen
            lo = 0
            for r in group:
                mid = lo + len(r[4]) // 4
                hi = mid + len(r[9]) // 4
                yield r, align_document(sums[lo:mid], sums[mid:hi], _names(r[6], r[7]), _names(r[11], r[12]), t, mean)
                lo = hi


def _names(flat: bytes, counts: bytes) -> list[frozenset]:
    names, out, lo = np.frombuffer(flat, np.int32).tolist(), [], 0
    for c in np.frombuffer(counts, np.int32).tolist():
        out.append(frozenset(names[lo:lo + c]) if c else _NO_NAMES)
        lo += c
    return out


_NO_NAMES: frozenset = frozenset()


def aligned(docs: DataFrame, model: Model, t: Thresholds = Thresholds()) -> DataFrame:
    """``tab, rec_id, src_start, tgt_start`` of each pair of sentences of prepared documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS by DIMENSIONS numbers a pair of languages

    def align(batches):
        import pyarrow as pa

        aligner = _Aligner(shared.value)
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32())
        for b in _slices(batches, 100):
            tabs, recs, src, tgt = [], [], [], []
            for r, pairs in aligner(list(zip(*(c.to_pylist() for c in b.columns))), t):
                if pairs:
                    at_a, at_b = np.frombuffer(r[3], np.int32), np.frombuffer(r[8], np.int32)
                    i, j = zip(*pairs)
                    src.append(at_a[list(i)])
                    tgt.append(at_b[list(j)])
                    tabs += [r[0]] * len(pairs)
                    recs += [r[1]] * len(pairs)
            if tabs:
                cols = (tabs, recs, np.concatenate(src), np.concatenate(tgt))
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], ["tab", "rec_id", "src_start", "tgt_start"])

    return docs.select(*_SIDES).mapInArrow(align, "tab string, rec_id bigint, src_start int, tgt_start int")


def align_sentences(pairs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """``tab, rec_id, src_start, tgt_start`` for ``tab, rec_id, patch, source, target, source_lang, target_lang``.

    A sentence that says what two on the other side say pairs with both; one without counterpart
    comes out in no row. Null and empty sides, and sides without sentences, give no rows; null languages are
    told by the text. Of equal sentences those at nearer relative places pair up. An empty input gives
    none. Texts are read whole; sentences and hashed terms are written once to the shared checkpoint folder.
    """
    docs = checkpointed(prepared(pairs))
    return aligned(docs, learn(docs), thresholds)


def pairs_of_sides(patches: DataFrame) -> DataFrame:
    """The two sides of each ``sync_id`` of changed files as input of ``align_sentences``; latest version, one shuffle. Null ids pair nothing."""
    row = F.struct("loaded_at", "diff_id", "patch", "lang")
    both = patches.where("sync_id IS NOT NULL AND patch IS NOT NULL").groupBy("sync_id").agg(
        F.max(F.when(F.col("side") == "source", row)).alias("s"), F.max(F.when(F.col("side") == "target", row)).alias("t"))
    return both.where("s IS NOT NULL AND t IS NOT NULL").select(
        F.lit("diff_file").alias("tab"), F.col("sync_id").alias("rec_id"), F.lit(True).alias("patch"),
        F.col("s.patch").alias("source"), F.col("t.patch").alias("target"), F.col("s.lang").alias("source_lang"), F.col("t.lang").alias("target_lang"))


def pairs_of_pages(pages: DataFrame) -> DataFrame:
    """Source and target of each page as input of ``align_sentences``; latest version of each ``pair_id``, one shuffle."""
    row = F.struct("loaded_at", "source_content", "target_content", "source_lang", "target_lang")
    return pages.where("pair_id IS NOT NULL").groupBy("pair_id").agg(F.max(row).alias("r")).select(
        F.lit("structure_pair").alias("tab"), F.col("pair_id").alias("rec_id"), F.lit(False).alias("patch"),
        F.col("r.source_content").alias("source"), F.col("r.target_content").alias("target"), F.col("r.source_lang").alias("source_lang"), F.col("r.target_lang").alias("target_lang"))
