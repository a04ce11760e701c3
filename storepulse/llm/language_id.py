"""Languages of texts by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over hashed byte n-grams tells the languages whose bit is set from the
others; its weights are log-odds of counts that one scan of the training rows gathers, summed by Spark per language and bucket. A second scan
measures how often each classifier is right on each language. A text gets the language whose codeword loses least against the classifiers'
margins, each bit weighing as much as its classifier may be trusted on that language; a text whose nearest codewords are near each other is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.batches import slices

#: Buckets of hashed n-grams, and the lengths of n-grams in bytes.
BUCKETS, ORDERS = 1 << 16, (2, 3, 4)
#: Bytes of one text whose n-grams are held at once.
WINDOW = 1 << 20
#: Neighbouring words of a text agree with each other: for the score a text is worth as much evidence as this many of its bytes, on average, at most.
EVIDENCE = 8
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters is space, letters of ASCII are lower case; other bytes stay.
_FOLD = bytes([b | 32 if chr(b).isalpha() else 32 for b in range(128)] + list(range(128, 256)))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a whole lower-cased text, runs of other characters being one space, in pieces of bounded size."""
    folded = np.frombuffer(b" %b " % b" ".join(text.lower().encode().translate(_FOLD).split()), dtype=np.uint8)
    for start in range(0, len(folded), WINDOW):
        part = gram = folded[start : start + WINDOW + ORDERS[-1] - 1].astype(np.uint32)
        out = []
        for n in range(2, ORDERS[-1] + 1):
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            if n in ORDERS:
                out.append((gram[:WINDOW] * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(16))
        yield np.concatenate(out)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each language: all distinct splits of up to seven languages, else the best of 200 random codes of 10 log2 bits."""
    if languages <= 1:
        return np.ones((languages, 0))
    if languages <= 7:
        bits = (1 << languages - 1) - 1
        return np.array([[1.0 if (b + 1) >> (languages - 1 - row) & 1 else -1.0 for b in range(bits)] for row in range(languages)])
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(languages)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(languages, width))
        agree = code @ code.T - 2 * width * np.eye(languages)
        split = np.abs(code.sum(axis=0)) < languages
        nearest = (width - agree.max()) / 2
        if split.all() and nearest > far:
            best, far = code, nearest
    return best


@dataclass(frozen=True)
class Model:
    """languages by code point; code: a row of bits for each; weights: a row for each bucket; trust: how far each bit counts for each language;
    sure: the score below which a text is ambiguous."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    sure: float

    def margins(self, text: str) -> tuple[np.ndarray, float]:
        """The classifiers' evidence for each bit, in nats, and the number of bytes that give it; n-grams share bytes, so each byte counts once."""
        found, grams = np.zeros(self.code.shape[1]), 0
        for b in buckets(text):
            found += np.ones(len(b), np.float32) @ self.weights.take(b, axis=0)
            grams += len(b)
        return found / len(ORDERS), grams / len(ORDERS)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Per text and language the mean logistic loss of the bits, weighed by trust; margins: a row for each text."""
        return np.stack([(np.logaddexp(0.0, -margins * code) * trust).sum(axis=1) for code, trust in zip(self.code, self.trust, strict=True)], axis=1)


def _trusted(right: np.ndarray) -> np.ndarray:
    """Rates of right bits by language, as weights that sum to 1."""
    return right / np.maximum(right.sum(axis=1, keepdims=True), 1e-12) if right.shape[1] else right


def _rows(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(f"`{text}`").cast("string").alias("body"))


def _judgeable(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _gram_counts(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """n-grams by language and bucket, over all labelled rows; each task gives at most one row for each language and filled stretch of buckets."""
    number, stretch = {lang: i for i, lang in enumerate(languages)}, 4096

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        held: dict[int, list[np.ndarray]] = {}
        grams = 0

        def count() -> None:
            for lang, lists in held.items():
                counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(lists), minlength=BUCKETS)
            held.clear()

        for part in slices(batches, "body"):
            for lang, body in zip(part.column("lang").to_pylist(), part.column("body").to_pylist(), strict=True):
                if lang in number and _judgeable(body):
                    for b in buckets(body):
                        held.setdefault(number[lang], []).append(b)
                        grams += len(b)
                if grams > WINDOW:
                    count()
                    grams = 0
        count()
        for lang, own in counts.items():
            filled = np.flatnonzero(own)
            for at in range(0, len(filled), stretch):
                b = filled[at : at + stretch]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), lang)), pa.array(b), pa.array(own[b])], ["lang", "bucket", "n"])

    summed = labelled.mapInArrow(walk, "lang bigint, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[summed["lang"].to_numpy(dtype=int), summed["bucket"].to_numpy(dtype=int)] = summed["n"].to_numpy(dtype=float)
    return counts


def _bit_weights(counts: np.ndarray, code: np.ndarray, smoothing: float) -> np.ndarray:
    """Log-odds of each bucket between the languages whose bit is set and the others; a language counts by its shares, not its size."""
    share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    columns = [np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)) for bit in code.T]
    return np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((counts.shape[1], 0), np.float32)


def _right_bits(labelled: DataFrame, model: Model) -> np.ndarray:
    """The share of each language's labelled rows whose bits are told right, over all of them."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        number = {lang: i for i, lang in enumerate(m.languages)}
        right, rows = np.zeros(m.code.shape), np.zeros(len(m.languages))
        for part in slices(batches, "body"):
            for lang, body in zip(part.column("lang").to_pylist(), part.column("body").to_pylist(), strict=True):
                if lang in number and _judgeable(body):
                    i = number[lang]
                    right[i] += m.margins(body)[0] * m.code[i] > 0
                    rows[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows), pa.array(right.tolist(), pa.list_(pa.float64()))], ["lang", "n", "bits"])

    parts = labelled.mapInArrow(walk, "lang bigint, n double, bits array<double>")
    bits = parts.groupBy("lang").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("bits")[b]) for b in range(model.code.shape[1]))).alias("bits")).collect()
    out = np.full(model.code.shape, 1e-6)
    for row in bits:
        out[row.lang] = (np.array(row.bits) + 1e-6) / (row.n + 1e-6) if row.n else out[row.lang]
    return out


def train(docs: DataFrame, lang: str = "lang", text: str = "text", most_languages: int = 256, smoothing: float = 0.5, sure: float = 0.9) -> Model:
    """A model of the rows of docs with a language and a text with a letter: all of them, each counted.

    The most_languages most frequent languages are learnt (ties: by code point), which bounds the model; other rows are left out. Null languages,
    null texts and texts without a letter teach nothing; repeated rows count each time; an empty table gives a model without languages."""
    labelled = _rows(docs, text, F.col(f"`{lang}`").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("body").isNotNull())
    seen = labelled.filter(F.col("body").rlike(r"\p{L}")).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    languages = sorted(r.lang for r in seen)
    code = codewords(len(languages))
    blind = Model(languages, code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.full(code.shape, 1.0 / max(code.shape[1], 1)), sure)
    if len(languages) < 2:
        return blind
    even = Model(languages, code, _bit_weights(_gram_counts(labelled, languages), code, smoothing), blind.trust, sure)
    return Model(languages, code, even.weights, _trusted(_right_bits(labelled, even)), sure)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, second, ambiguous: one row per row of docs, from its whole text alone.

    score is the softmax of the losses, scaled to a bounded number of bytes, at the nearest language; a text is ambiguous below model.sure.
    Null texts, texts without a letter, and all texts of a model without languages are `und` with score 0. Ties go to the first language by code
    point. Rows with equal ids and null ids are judged each; an empty table gives none; other columns are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches, "body"):
            names, scores, seconds, near = [], [], [], []
            for body in part.column("body").to_pylist():
                if not m.languages or not _judgeable(body):
                    names.append(UNKNOWN), scores.append(0.0), seconds.append(None), near.append(True)
                    continue
                margins, size = m.margins(body)
                loss = m.losses(margins[None, :])[0]
                order = np.argsort(loss, kind="stable")
                share = np.exp((loss[order[0]] - loss) * min(1.0, EVIDENCE / size))
                names.append(m.languages[order[0]]), scores.append(round(float(1 / share.sum()), 6))
                seconds.append(m.languages[order[1]] if len(order) > 1 else None)
                near.append(scores[-1] < m.sure)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(seconds, pa.string()), pa.array(near, pa.bool_())], ["doc_id", "lang_pred", "score", "second", "ambiguous"])

    rows = _rows(docs, text, F.col(f"`{doc_id}`").alias("doc_id"))
    return rows.mapInArrow(walk, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, second string, ambiguous boolean")
