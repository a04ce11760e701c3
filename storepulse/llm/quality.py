"""Line-first cleaning: rules judge each line, failing lines go, then documents that lose too much text go.

One scan counts, over all documents, which short lines recur with differing surroundings: these are boilerplate. A second
judges every document in one Arrow stage. Only hashes of lines are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.batches import slices, text_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document rules. What they look at are properties of characters and the shape of lines, in any language."""

    least_separators: int = 3
    separator_share: float = 0.15
    title_words: int = 5
    symbol_share: float = 0.1
    shouted_words: int = 4
    exclamations: int = 4
    repeated_words: int = 10
    distinct_share: float = 0.3
    prose_words: int = 5
    least_words: int = 20
    most_repeated: float = 0.3
    most_lost: float = 0.2
    most_lost_to_boilerplate: float = 0.5
    #: A line of at most so many words is boilerplate if that share of its documents differ in the rest, and they are that many, and that share of all documents.
    boilerplate_words: int = 30
    boilerplate_differing: float = 0.5
    boilerplate_documents: int = 10
    boilerplate_share: float = 1e-4


#: Words without a letter or digit: what stands between the entries of a menu.
_SEPARATORS = re.compile(r"(?<!\S)[^\w\s]+(?!\S)").findall


@cache
def sentence_ends() -> tuple[str, ...]:
    """Characters that may end a line of prose: the ends of sentences in any script, colons, closing brackets and quotation marks."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return tuple(regex.findall(r"[\p{Sentence_Terminal}\p{Quotation_Mark}\p{Pe}\p{Pf}:;…]", every))


def line_key(words: list[bytes]) -> int:
    """A hash of the line's words; A-Z count as lower case and every number as 0."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(_DIGITS(b"0", b" ".join(words).lower())) - (1 << 63)


_DIGITS = re.compile(rb"[0-9]+").sub


def failed_rule(line: str, rules: LineRules) -> str | None:
    """The first rule that the line fails: navigation, symbols, shouting, repetition, punctuation; None if it stays. Lines without words stay."""
    line = line.strip(" \t\r\x0b\x0c")
    words = line.split()
    if not words:
        return None
    separators = len(_SEPARATORS(line))
    if separators >= rules.least_separators and separators >= rules.separator_share * len(words):
        return "navigation"
    if sum(map(line.count, "#*$%&|<>")) > rules.symbol_share * len(line):
        return "symbols"
    if (line.isupper() and len(words) >= rules.shouted_words) or line.count("!!") >= rules.exclamations:
        return "shouting"
    if len(words) >= rules.title_words and all(w[0].isupper() or not w[0].isalpha() for w in words) and sum(w[0].isupper() for w in words) >= rules.title_words:
        return "navigation"  # entries of a menu; prose has words in lower case
    if len(words) >= rules.repeated_words and len(set(words)) < rules.distinct_share * min(len(words), 200):
        return "repetition"
    ends = sentence_ends()
    if line.endswith(ends) or (len(words) >= rules.prose_words and any(w.endswith(ends) for w in words)):
        return None  # a line with a sentence in it is prose that was cut off
    return "punctuation"


def boilerplate_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> frozenset[int]:
    """Keys of the short lines that many documents hold which differ in the rest; copies of one document do not make a line boilerplate.

    The rest of a document is told by the least hash of its other lines' sentences. Rows (line, rest) are counted over all
    documents, partly before they are shuffled. As each such line is in boilerplate_share of the documents at least, there are no more
    than the mean number of lines of a document divided by that share. Null and one-line documents count for no line; an empty table has none."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for part in slices(batches, "text"):
            keys, rests = [], []
            for body in part.column("text").to_pylist():
                least: dict[int, int] = {}
                short = []
                for line in body.split(b"\n"):
                    words = line.split()
                    if words:
                        key = line_key(words)
                        if key not in least:
                            least[key] = min(map(xxh64_intdigest, line.split(b".")))
                            if len(words) <= rules.boilerplate_words:
                                short.append(key)
                if len(least) > 1:
                    (one, first), (_, second) = sorted(least.items(), key=lambda x: x[1])[:2]
                    keys += short
                    rests += [(second if k == one else first) - (1 << 63) for k in short]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rests, pa.int64())], ["line", "rest"])

    rows = docs.select(text_bytes(text).alias("text"))
    lines = rows.mapInArrow(pairs, "line long, rest long").groupBy("line", "rest").agg(F.count("*").alias("n")).groupBy("line").agg(F.count("*").alias("differing"), F.sum("n").alias("n"))
    least = max(rules.boilerplate_documents, rules.boilerplate_share * rows.count())
    return frozenset(r.line for r in lines.filter((F.col("differing") >= least) & (F.col("differing") >= rules.boilerplate_differing * F.col("n"))).select("line").collect())


def repeated_window_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of `size` words (a power of two) found twice or more, the first included."""
    n = len(words)
    if n <= size:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    if len(known) == n:
        return 0
    width = 1
    while width < size:  # windows twice as wide, named by the pair of their halves
        pairs = codes[:-width] * (int(codes.max()) + 1) + codes[width:]
        values, codes, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        width *= 2
    again = np.flatnonzero(counts[codes] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + size, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, dtype=np.uint8))
_IS_POINT = (np.arange(256) & 0xC0) != 0x80
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, dtype=np.uint8))


def judge(text: bytes, rules: LineRules, known: frozenset[int]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words, reasons, cleaned text."""
    words = text.split()
    bytes_of = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    seen: set[bytes] = set()
    duplicates = lost = common = 0
    reasons: dict[str, int] = {}
    stay = []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            duplicates += line in seen
            seen.add(line)
            why = failed_rule(line.decode("utf-8", "replace"), rules) or ("boilerplate" if known and len(own) <= rules.boilerplate_words and line_key(own) in known else None)
            if why:
                reasons[why] = reasons.get(why, 0) + 1
                lost += len(own)
                common += len(own) * (why == "boilerplate")
                continue
        stay.append(line)
    repeated = repeated_window_words(words)
    base = len(words) < rules.least_words or 100 * repeated > 100 * rules.most_repeated * len(words)
    # a short document with a licence line is no junk: what boilerplate takes may be more
    kept = not base and lost - common <= rules.most_lost * len(words) and lost <= rules.most_lost_to_boilerplate * len(words)
    return len(words), int(bytes_of[_IS_POINT & ~_IS_SPACE].sum()), int(bytes_of[_IS_SYMBOL].sum()), duplicates, repeated, base, kept, lost, reasons, b"\n".join(stay)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: LineRules = LineRules(), known: frozenset[int] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words, reasons (a map from rule to lines).

    One row per row of docs; repeated rows and equal ids are judged each. A null text has no words and fails. Whole texts are judged,
    lines of any length. `known` are keys of boilerplate lines, by default those of docs. An empty table gives no rows."""
    lines = boilerplate_lines(docs, text, rules) if known is None else known
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.map_(pa.string(), pa.int64())]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words", "reasons"]
    shared = docs.sparkSession.sparkContext.broadcast(lines)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [judge(t, rules, shared.value)[:9] for t in part.column("text").to_pylist()]
            columns = [pa.array([f[:8][i] if i < 8 else list(f[8].items()) for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, reasons map<string,long>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(report, schema)


def clean_documents(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", rules: LineRules = LineRules(), known: frozenset[int] | None = None) -> DataFrame:
    """The documents that stay, with the lines that stay, in the columns of docs; `chars`, if there, is counted anew.

    Null and empty texts go, repeated rows are judged each, and an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(boilerplate_lines(docs, text, rules) if known is None else known)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            bodies = [b.encode() if b is not None else b"" for b in part.column(text).to_pylist()]
            found = [judge(b, rules, shared.value) for b in bodies]
            keep = part.filter(pa.array([f[6] for f in found], pa.bool_()))
            texts = [f[9].decode() for f in found if f[6]]
            columns = [pa.array(texts, f.type) if f.name == text else pa.array(map(len, texts), f.type) if f.name == chars else keep.column(i) for i, f in enumerate(keep.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=keep.schema)

    return docs.mapInArrow(clean, docs.schema)
