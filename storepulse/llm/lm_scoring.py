"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network, in numpy: the words up to `reach` places on both sides of a masked word have embeddings that a weight per
place scales; their sum through tanh gives a hidden vector, which predicts the word's class and the word within its
class. The vocabulary grows with the square root of the corpus. A word outside it is predicted by its last byte, and the bytes
before that by a model of spelling counted over all such words, so every word has a probability of its own.

Training is data parallel: every word of every text is once a target. In each round a bounded number of tasks take gradient steps over the
round's share of the texts, and a shuffled aggregation averages their parameters, weighted by tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.batches import runs, slices, text_bytes
from storepulse.plans.lineage import cut

#: Ids of words outside the vocabulary, one for each last byte.
ENDINGS = 256

#: The place between words where spelling begins and ends; no word holds this byte.
GAP = 0x20


def spelling_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words but their last, and for the gap before each: the code of (byte, next, next but one); and whose word it is."""
    joined = np.frombuffer(b" " + b" ".join(words) + b"  ", dtype=np.uint8).astype(np.int64)
    here, one, two = joined[:-2], joined[1:-1], joined[2:]
    spelt = one != GAP
    # a word's own gap is the one before it
    owner = np.cumsum(here == GAP) - 1
    return (((two << 8) | one) << 8 | here)[spelt], owner[spelt]


@dataclass
class Spelling:
    """log P(byte | the two bytes after it): of the seen codes, sorted; of the codes' pairs without the last; else `floor`."""

    codes: np.ndarray
    logs: np.ndarray
    pairs: np.ndarray
    backoff: np.ndarray
    floor: float = math.log(1 / 256)

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, strength: float = 8.0) -> Spelling:
        """From the counts of codes; a context's unseen bytes share `strength` times the mass of one, evenly."""
        order = np.argsort(codes)
        codes, counts = codes[order].astype(np.int64), counts[order].astype(np.float64)
        pairs, at = np.unique(codes >> 8, return_inverse=True)
        totals = np.bincount(at, weights=counts, minlength=len(pairs)) + strength
        return cls(codes, np.log((counts + strength / 256) / totals[at]) if len(codes) else counts, pairs, np.log(strength / 256 / totals))

    def log_likelihoods(self, words: list[bytes]) -> np.ndarray:
        """log P(the bytes before the last | the last) of each word."""
        if not words:
            return np.zeros(0)
        codes, owner = spelling_codes(words)
        rows, table = self.table
        return np.bincount(owner, weights=table[rows[codes >> 8], codes & 255], minlength=len(words))

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each pair of bytes, and the logs of each row by the byte before; row 0 is that of pairs not seen."""
        rows = np.zeros(1 << 16, dtype=np.int32)
        rows[self.pairs] = np.arange(1, len(self.pairs) + 1)
        table = np.repeat(np.r_[self.floor, self.backoff][:, None], 256, axis=1)
        table[rows[self.codes >> 8], self.codes & 255] = self.logs
        return rows, table


@dataclass
class WindowNetwork:
    """inner: word embeddings; places: a weight vector per place; outer_class and outer_word: output vectors, with a bias as the last component."""

    words: list[bytes]
    side: int
    reach: int
    spelling: Spelling
    inner: np.ndarray
    places: np.ndarray
    outer_class: np.ndarray
    outer_word: np.ndarray

    @classmethod
    def fresh(cls, words: list[bytes], counts: list[int], rest: int, size: int, reach: int, seed: int, spelling: Spelling | None = None) -> WindowNetwork:
        """An untrained network whose biases are the words' frequencies; `rest` is how many sayings the words outside have."""
        random = np.random.default_rng(seed)
        side = math.ceil(math.sqrt(len(words) + ENDINGS))
        n = side * side
        draw = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
        places = np.ones((2 * reach, size), dtype=np.float32)
        empty = np.zeros(0, dtype=np.int64)
        net = cls(words, side, reach, spelling or Spelling.of(empty, empty), draw(n + 1, size), places, draw(side, size + 1), draw(n, size + 1))
        net.inner[n] = 0  # padding
        share = np.full(n, 1e-3)
        share[: len(words)] = 1 + np.array(counts, dtype=np.float64)
        share[len(words) : len(words) + ENDINGS] = 1 + rest / ENDINGS
        grid = share.reshape(side, side)
        net.outer_class[:, -1] = np.log(grid.sum(axis=1) / grid.sum())
        net.outer_word[:, -1] = np.log(grid / grid.sum(axis=1, keepdims=True)).reshape(-1)
        return net

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def ids(self, bodies: list[bytes], index: dict[bytes, int]) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
        """The ids of each text's words; the words outside the vocabulary, whose ids come after it by their last byte; the text of each of those."""
        texts, outside, counts, first = [], [], [], len(self.words)
        for body in bodies:
            words = body.lower().split()
            ids = np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int32, count=len(words))
            at = np.flatnonzero(ids < 0).tolist()
            if at:
                own = [words[k] for k in at]
                ids[at] = [first + w[-1] for w in own]
                outside += own
            texts.append(ids)
            counts.append(len(at))
        return texts, outside, np.repeat(np.arange(len(texts)), counts)

    def padded(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one row of ids with padding between; the places of their words; the text of each."""
        pad = np.full(self.reach, self.side * self.side, dtype=np.int32)
        row = np.concatenate([pad, *(x for t in texts for x in (t, pad))])
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        return row, np.flatnonzero(row != self.side * self.side), owner

    def hidden(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden vectors of all places of a row but `reach` at both ends, and the embeddings of the whole row."""
        e, n = self.inner.take(row, axis=0), len(row) - 2 * self.reach
        total = np.zeros((n, e.shape[1]), dtype=np.float32)
        for j, d in enumerate(self._offsets()):
            total += e[d : d + n] * self.places[j]
        return np.tanh(total, out=total), e

    def _offsets(self) -> list[int]:
        return [d for d in range(2 * self.reach + 1) if d != self.reach]

    def _sorted(self, ids: np.ndarray) -> np.ndarray:
        """Their stable order; numbers of two bytes are sorted by radix."""
        return np.argsort(ids.astype(np.int16) if self.side * self.side < 1 << 15 else ids, kind="stable")

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = target // self.side
        order = np.argsort(own.astype(np.int16) if self.side < 1 << 15 else own, kind="stable")
        return order, np.searchsorted(own[order], np.arange(self.side + 1))

    @staticmethod
    def _with_one(h: np.ndarray) -> np.ndarray:
        return np.concatenate([h, np.ones((len(h), 1), dtype=h.dtype)], axis=1)

    def _steep(self) -> np.ndarray:
        """For the classes' vectors, at the end, and those of each class's words: whether exp of the logits might overflow."""
        # |h| < 1 bounds the logits by these sums
        return np.r_[np.abs(self.outer_word).sum(axis=1).reshape(self.side, self.side).max(axis=1), np.abs(self.outer_class).sum(axis=1).max()] > 80

    @staticmethod
    def _logits(h: np.ndarray, outer: np.ndarray, steep: bool) -> np.ndarray:
        """The logits of hidden vectors that end in a one for the bias; less their largest if steep."""
        z = h @ outer.T
        if steep:
            z -= z.max(axis=1, keepdims=True)
        return z

    def log_probabilities(self, h: np.ndarray, target: np.ndarray, rows: int = 2048) -> np.ndarray:
        """log P(class) + log P(word in class)."""
        out, steep, ones, h = np.empty(len(h)), self._steep(), np.ones(self.side, dtype=h.dtype), self._with_one(h)
        for i in range(0, len(h), rows):
            z = self._logits(h[i : i + rows], self.outer_class, steep[-1])
            own = z[np.arange(len(z)), target[i : i + rows] // self.side]
            out[i : i + rows] = own - np.log(np.exp(z, out=z) @ ones)
        order, edges = self._by_class(target)
        hs, within, found = h[order], target[order] % self.side, np.empty(len(h))
        for c in np.flatnonzero(np.diff(edges)):
            a, b = edges[c], edges[c + 1]
            z = self._logits(hs[a:b], self.outer_word[c * self.side : (c + 1) * self.side], steep[c])
            own = z[np.arange(b - a), within[a:b]]
            found[a:b] = own - np.log(np.exp(z, out=z) @ ones)
        out[order] += found
        return out

    def _pull(self, h: np.ndarray, outer: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the summed log of a softmax's denominator: of h and of outer."""
        e = self._logits(h, outer, steep)
        np.exp(e, out=e)
        share = 1 / (e @ np.ones(len(outer), dtype=e.dtype))
        return (e @ outer[:, :-1]) * share[:, None], e.T @ (h * share[:, None])

    def log_likelihoods(self, texts: list[np.ndarray], batch: int = 16384) -> np.ndarray:
        """Each text's sum of log P(word or last byte | the words on both sides)."""
        row, places, owner = self.padded(texts)
        found, r = np.zeros(len(texts)), self.reach
        for i in range(0, len(places), batch):
            at = places[i : i + batch]
            h, _ = self.hidden(row[at[0] - r : at[-1] + r + 1])
            found += np.bincount(owner[i : i + batch], weights=self.log_probabilities(h[at - at[0]], row[at]), minlength=len(texts))
        return found

    def gradients(self, row: np.ndarray, at: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the summed log-likelihood of the places `at`, which lie `reach` or more from the row's ends: (ids, rows) of inner, and the other arrays' whole."""
        r, side, steep = self.reach, self.side, self._steep()
        part = row[at[0] - r : at[-1] + r + 1]
        every, e = self.hidden(part)
        here = at - at[0]
        # in the order of the targets, so that those of a class, and those of a word, are runs
        target = row[at]
        order = self._sorted(target)
        target, here = target[order], here[order]
        h = self._with_one(every.take(here, axis=0))
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        names, sums = target[first], np.add.reduceat(h, first, axis=0)
        d_word, d_class = np.zeros_like(self.outer_word), np.zeros_like(self.outer_class)
        d_word[names] = sums
        own = names // side
        of_class = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        d_class[own[of_class]] = np.add.reduceat(sums, of_class, axis=0)
        dh = self.outer_class[target // side, :-1] + self.outer_word[target, :-1]
        for i in range(0, len(h), 2048):
            fall, d = self._pull(h[i : i + 2048], self.outer_class, steep[-1])
            dh[i : i + 2048] -= fall
            d_class -= d
        ends = np.r_[first[of_class], len(h)]
        for c, i, j in zip(own[of_class].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            block = slice(c * side, (c + 1) * side)
            fall, d = self._pull(h[i:j], self.outer_word[block], steep[c])
            dh[i:j] -= fall
            d_word[block] -= d
        dh *= 1 - h[:, :-1] * h[:, :-1]
        dt = np.zeros_like(every)
        dt[here] = dh
        d_row, d_places = np.zeros_like(e), np.empty_like(self.places)
        for j, d in enumerate(self._offsets()):
            d_row[d : d + len(dt)] += dt * self.places[j]
            d_places[j] = (dt * e[d : d + len(dt)]).sum(axis=0)
        by = self._sorted(part)
        ids = part[by]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        gains, ids = np.add.reduceat(d_row.take(by, axis=0), first, axis=0), ids[first]
        real = ids != side * side
        return (ids[real], gains[real]), d_places, d_class, d_word

    def step(self, row: np.ndarray, at: np.ndarray, rate: float, squares: list[np.ndarray]) -> None:
        """One step of gradient ascent, scaled by the root of the sums of squared gradients so far."""
        (ids, d_inner), *whole = self.gradients(row, at)
        squares[0][ids] += d_inner * d_inner
        self.inner[ids] += rate * d_inner / np.sqrt(squares[0][ids])
        for a, d, s in zip(self.arrays()[1:], whole, squares[1:], strict=True):
            s += d * d
            a += rate * d / np.sqrt(s)

    def arrays(self) -> list[np.ndarray]:
        return [self.inner, self.places, self.outer_class, self.outer_word]

    def with_arrays(self, arrays: list[np.ndarray]) -> WindowNetwork:
        return WindowNetwork(self.words, self.side, self.reach, self.spelling, *(np.array(a, dtype=np.float32) for a in arrays))


def word_counts(rows: DataFrame) -> DataFrame:
    """word (bytes, lower-cased A-Z), n of all texts."""
    from collections import Counter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for part in slices(batches, "text"):
            for body in part.column("text").to_pylist():
                found.update(body.lower().split())
            if len(found) > 400_000:
                yield told()
        if found:
            yield told()

    return rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_of(words: DataFrame) -> Spelling:
    """From all rows (word, n); the counts of three bytes, at most 256 ** 3 of them, come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, owner = spelling_codes(batch.column("word").to_pylist())
                names, at = np.unique(codes, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at, weights=batch.column("n").to_numpy()[owner]).astype(np.int64))], ["code", "n"])

    found = words.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return Spelling.of(found.code.to_numpy(np.int64), found.n.to_numpy(np.int64))


def _averaged(sent: DataFrame) -> DataFrame:
    """chunk, weights (float32 bytes): the means, weighted by tokens, of rows (chunk, task, tokens, weights)."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = weight = key = None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["chunk", "weights"])

        for (chunk,), _, rows, _ in runs(batches, ["chunk"], 256):
            if chunk != key:
                if key is not None:
                    yield told()
                total, weight, key = 0.0, 0, int(chunk)
            for tokens, data in zip(rows.column("tokens").to_pylist(), rows.column("weights").to_pylist(), strict=True):
                total = total + np.frombuffer(data, dtype=np.float32).astype(np.float64) * tokens
                weight += tokens
        if key is not None:
            yield told()

    return sent.repartition("chunk").sortWithinPartitions("chunk", "task").mapInArrow(mean, "chunk long, weights binary")


def train(docs: DataFrame, text: str = "text", growth: float = 0.5, size: int = 16, reach: int = 3, rounds: int = 2, rate: float = 0.1, batch: int = 16384, trainers: int = 32, chunk: int = 4096, seed: int = 11) -> WindowNetwork:
    """A network trained on every word of all docs, once: each text in one round, by the hash of its words.

    The vocabulary is the `growth` times square root of all words' number most frequent words. Up to `trainers` partitions
    train one each; of more partitions P, sqrt(trainers * P) tasks take several each, so that what is averaged grows with the
    corpus and not faster. The means depend on how the rows are parted, as the steps of a task do; the same parts give the same
    network. Null texts count as empty, repeated rows train as often as they are there, and an empty table gives the untrained network."""
    rows = docs.select(text_bytes(text).alias("text"))
    counts = cut(word_counts(rows), "words")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    top = counts.orderBy(F.desc("n"), "word").limit(math.ceil(growth * math.sqrt(total))).collect()
    if not top:
        return WindowNetwork.fresh([], [], 0, size, reach, seed)
    outside = counts.filter((F.col("n") < top[-1].n) | ((F.col("n") == top[-1].n) & (F.col("word") > F.lit(bytes(top[-1].word)))))
    net = WindowNetwork.fresh([bytes(r.word) for r in top], [r.n for r in top], total - sum(r.n for r in top), size, reach, seed, spelling_of(outside))
    parts = rows.rdd.getNumPartitions()
    few = rows.coalesce(math.ceil(math.sqrt(trainers * parts))) if parts > trainers else rows
    for turn in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(net)

        def fit(batches: Iterator[pa.RecordBatch], speed: float = rate / (1 + turn), shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            own = own.with_arrays(own.arrays())
            index, tokens = own.index(), 0
            squares = [np.full_like(a, 1.0) for a in own.arrays()]
            for part in slices(batches, "text"):
                texts = [t for t in own.ids(part.column("text").to_pylist(), index)[0] if len(t)]
                if not texts:
                    continue
                row, places, _ = own.padded(texts)
                for i in range(0, len(places), batch):
                    own.step(row, places[i : i + batch], speed, squares)
                tokens += len(places)
            if tokens:
                flat = np.concatenate([a.reshape(-1) for a in own.arrays()])
                pieces = [flat[i : i + chunk].tobytes() for i in range(0, len(flat), chunk)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array([task] * len(pieces), pa.int64()), pa.array([tokens] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["chunk", "task", "tokens", "weights"])

        share = few.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        means = _averaged(share.mapInArrow(fit, "chunk long, task long, tokens long, weights binary")).collect()
        if not means:
            continue
        flat = np.concatenate([np.frombuffer(m.weights, dtype=np.float32) for m in sorted(means, key=lambda m: m.chunk)])
        ends = np.cumsum([a.size for a in net.arrays()])[:-1]
        net = net.with_arrays([x.reshape(a.shape) for x, a in zip(np.split(flat, ends), net.arrays(), strict=True)])
    return net


def score_documents(docs: DataFrame, net: WindowNetwork, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood (summed over all words), per_word (null without words): one row per row of docs, whole texts.

    Null texts count as empty (0 words, likelihood 0). Repeated rows and equal ids each give a row; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = own.index()
        for part in slices(batches, "text", 1 << 20):
            texts, spelt, owner = own.ids(part.column("text").to_pylist(), index)
            sums, n = own.log_likelihoods(texts), [len(t) for t in texts]
            if spelt:
                sums += np.bincount(owner, weights=own.spelling.log_likelihoods(spelt), minlength=len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array([s / c if c else None for s, c in zip(sums.tolist(), n, strict=True)], pa.float64())], ["doc_id", "n_words", "log_likelihood", "per_word"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(score, "doc_id long, n_words long, log_likelihood double, per_word double")
