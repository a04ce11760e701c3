"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Training: words and their beginnings are counted by class in a bounded sample of labelled documents; log-odds with an
informative Dirichlet prior keep what is significant. Scoring: one Arrow stage over the scan finds all maximal
segments of every whole text in linear time; no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.batches import slices, text_bytes
from storepulse.plans.lineage import cut

_WORDS = re.compile(r"[^\W\d_]+").findall
#: No word scores more than this.
TOP = 6.0


def tokens(text: bytes) -> list[str]:
    return _WORDS(text.decode("utf-8", "replace").lower())


def features(word: str) -> list[str]:
    """The word, and its beginnings of 5, 4 and 3 letters, marked."""
    return [word, *(f"{word[:k]}*" for k in (5, 4, 3) if len(word) >= k)]


@dataclass
class ToxicityModel:
    """odds: log-odds of significant features. drift: the score of any other token. rate, scale: lambda and K of
    the extreme-value law of clean documents. slope, offset: the logistic map from evidence to a score."""

    odds: dict[str, float] = field(default_factory=dict)
    drift: float = -0.3
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    offset: float = -4.0
    most: int = 300_000
    kept: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "kept": {}}

    def score_of(self, word: str) -> float:
        found = [self.odds[f] for f in features(word) if f in self.odds]
        return min(TOP, max(found)) if found else 0.0

    def scores(self, words: list[str]) -> list[float]:
        """Of each token; 0 stands for the drift."""
        try:
            return list(map(self.kept.__getitem__, words))
        except KeyError:
            if len(self.kept) > self.most:
                self.kept.clear()
            for w in set(words).difference(self.kept):
                self.kept[w] = self.score_of(w)
            return list(map(self.kept.__getitem__, words))

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first token, last token, score). Every saying of a word counts."""
        return maximal_segments([(i, s) for i, s in enumerate(self.scores(words)) if s > 0], self.drift)

    def excess(self, score: float, n: int) -> float:
        """By how much -log of the expected number of such segments in n clean tokens is above 0."""
        return self.rate * score - math.log(max(self.scale * n, 1.0))

    def evidence(self, words: list[str], passages: list[tuple[int, int, float]] | None = None) -> float:
        """Summed excess of the significant passages; the best passage's deficit if none is."""
        if not words:
            return -math.log(max(self.scale, 1.0))
        found = [self.excess(s, len(words)) for _, _, s in (self.passages(words) if passages is None else passages)]
        good = sum(x for x in found if x > 0)
        return good if good else max(found, default=self.excess(0.0, len(words)))

    def probability(self, evidence: float) -> float:
        x = self.slope * squash(evidence) + self.offset
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def squash(evidence: float) -> float:
    return math.copysign(math.log1p(abs(evidence)), evidence)


def maximal_segments(positive: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences where tokens not in `positive` score `drift` (< 0); time linear in the tokens.

    A candidate keeps the place of the last one before it whose sum before is smaller, so that a search never meets
    a candidate again that an earlier search passed over. Where there is none, all candidates so far are final."""
    final: list[tuple[int, int, float]] = []
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, place of the last one with a smaller sum before
    total, at = 0.0, 0
    for i, s in positive:
        total += drift * (i - at)
        at = i + 1
        first, before, after = i, total, total + s
        total = after
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0:
                final += [(a, b, hi - lo) for a, b, lo, hi, _ in kept]
                kept = [(first, i, before, after, -1)]
                break
            if kept[j][3] >= after:
                kept.append((first, i, before, after, j))
                break
            first, _, before, _, back = kept[j]
            del kept[j:]
            j = back
    return [*final, *((a, b, hi - lo) for a, b, lo, hi, _ in kept)]


def sample_labels(labels: DataFrame, per_class: int, doc_id: str = "doc_id", label: str = "toxic", folds: int = 5) -> DataFrame:
    """doc_id, toxic of at most per_class training rows of each class, by hash; fold 0 of crc32(doc_id) is held out."""
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter(f"toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % {folds} <> 0").distinct()
    by = F.xxhash64("doc_id", F.lit(7))
    return usable.filter("toxic = 1").orderBy(by, "doc_id").limit(per_class).union(usable.filter("toxic = 0").orderBy(by, "doc_id").limit(per_class))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, doc_id: str = "doc_id", text: str = "text", prior: float = 0.06, significance: float = 2.2, margin: float = 1.28, most_features: int = 50_000) -> ToxicityModel:
    """A model from at most per_class labelled documents of each class, by hash of the id.

    Words and beginnings are counted once a document. The prior has the pooled rate of a feature and a mass of `prior` times the
    number of documents, 5 to 200. A feature scores the lower bound of its log-odds, `margin` standard errors under the estimate, TOP at
    most; it must have a z of `significance`, a bound of 0.5, and be in no more than 2 % of the clean documents. At most most_features
    features are kept, the most significant, which bounds the model as per_class bounds the sample. Labels that are neither 0 nor 1 and null ids
    are left out; a row of docs or labels that is there twice counts twice or once. Without documents of both classes, an empty table
    included, the model knows no features and scores everything low."""
    sample = sample_labels(labels, per_class)
    # at most 2 * per_class ids; cut, so that the corpus is scanned once and the passes below read the sample alone
    own = cut(docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        docs_of = [0, 0]
        for part in slices(batches, "text"):
            for body, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                docs_of[toxic] += 1
                found[toxic].update({f for w in set(tokens(body)) for f in features(w)})
        found[0][""], found[1][""] = docs_of
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][x] for x in names], pa.int64()), pa.array([found[0][x] for x in names], pa.int64())], ["feature", "bad", "good"])

    counts = own.mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = counts.filter("feature = ''").first()
    if not sums or not sums.bad or not sums.good:
        return ToxicityModel()
    # a feature is in a document or not; the prior has the pooled rate
    share = (F.col("bad") + F.col("good") + 0.5) / F.lit(float(sums.bad + sums.good + 1))
    mass = min(200.0, max(5.0, prior * (sums.bad + sums.good)))
    a, rest = share * mass, (1 - share) * mass
    odds = F.log((F.col("bad") + a) / (sums.bad - F.col("bad") + rest)) - F.log((F.col("good") + a) / (sums.good - F.col("good") + rest))
    variance = 1 / (F.col("bad") + a) + 1 / (F.col("good") + a)
    rare = F.col("good") <= 0.02 * sums.good  # frequent in clean documents too: no mark of a toxic passage
    best = (
        counts.filter("feature <> ''").select("feature", (odds - margin * F.sqrt(variance)).alias("odds"), (odds / F.sqrt(variance)).alias("z"), rare.alias("rare"))
        .filter(f"z >= {significance} and odds >= 0.5 and rare").orderBy(F.desc("z"), "feature").limit(most_features).collect()
    )
    model = ToxicityModel(odds={r.feature: float(r.odds) for r in best})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, top, histogram = [], [], []
            for body in part.column("text").to_pylist():
                words = tokens(body)
                n.append(len(words))
                top.append(max((s for _, _, s in model.passages(words)), default=0.0))
                values = np.minimum(np.array(model.scores(words), dtype=float), TOP)
                histogram.append(np.bincount(np.ceil(values * 2).astype(int), minlength=int(2 * TOP) + 1).tolist())
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(n, pa.int64()), pa.array(top, pa.float64()), pa.array(histogram, pa.list_(pa.int64()))], ["toxic", "n", "top", "histogram"])

    seen = own.mapInArrow(measure, "toxic int, n long, top double, histogram array<long>").toPandas()
    clean = seen[(seen.toxic == 0) & (seen.n > 0)]
    steps = np.stack(clean.histogram.to_numpy()).sum(axis=0) if len(clean) else np.array([1])
    chances, values = steps / steps.sum(), np.where(np.arange(len(steps)) == 0, model.drift, np.arange(len(steps)) / 2)
    low, high = 1e-3, 3.0  # the positive root of sum(p * exp(lambda * s)) = 1
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (chances * np.exp(middle * values)).sum() < 1 else (low, middle)
    model.rate = low
    if len(clean):
        model.scale = float(np.exp(np.clip((model.rate * clean.top - np.log(clean.n)).mean() - np.euler_gamma, -12, 3)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = [squash(model.evidence(tokens(b))) for b in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(x, pa.float64())], ["toxic", "x"])

    points = own.mapInArrow(weigh, "toxic int, x double").toPandas()
    x, y = points.x.to_numpy(), points.toxic.to_numpy().astype(float)
    w, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = float(w[0]), float(w[1])
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted, passages (first token, last token, score of each significant one): one row per row of docs; whole texts.

    Null texts count as empty, and texts without words get the score of no evidence. Repeated rows and equal ids each give a row, null ids too; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "text"):
            found, spans = [], []
            for body in part.column("text").to_pylist():
                words = tokens(body)
                passages = own.passages(words)
                found.append(own.probability(own.evidence(words, passages)))
                spans.append([{"first": a, "last": b, "score": s} for a, b, s in passages if own.excess(s, len(words)) > 0])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64()), pa.array([int(p >= 0.5) for p in found], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(score, "doc_id long, score double, predicted int, passages array<struct<first:long,last:long,score:double>>")


def clean_documents(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, in the columns of docs: null and empty texts and repeated rows stay; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, text):
            bodies = [t.encode() if t is not None else b"" for t in part.column(text).to_pylist()]
            yield part.filter(pa.array([own.probability(own.evidence(tokens(b))) < 0.5 for b in bodies], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
