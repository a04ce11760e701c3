"""Periodic stretches of words: found online by catchers over dyadic blocks, taken out of texts.

A square of half-length p holds, in its first half, a whole aligned block of B words, B being a power of two with 2B-1 <= p < 4B-1. When such a
block is complete, a catcher is kept for it under the block's last two words. Each appended word looks up the catchers that wait for it and the
word before it, and compares the suffix with theirs; a block that is met again p words later opens a stretch of period p, which later words carry on or close. Stretches that
hold enough periods are runs. A word costs a few comparisons and each document stands alone, so that no row is shuffled.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.batches import slices, text_bytes

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SquareCatcher:
    """The runs of a sequence that grows by words: maximal stretches of smallest period q whose length is at least max(least, exponent * q).

    exponent must be 4 or more: then any two runs that share a stretch have one period, so a stretch is told once, by its smallest period."""

    def __init__(self, least: int = 6, exponent: int = 4):
        if exponent < 4:
            raise ValueError("exponent must be 4 or more")
        self.least, self.exponent = least, exponent
        self.words: list = []
        self.waiting: dict = {}  # last two words of a block: its catchers, as (end of the block, size)
        self.ended: set = set()  # last words of blocks
        self.open: dict[int, int] = {}  # period of a stretch that goes on: its start
        self.runs: list[tuple[int, int, int]] = []  # start, length, period

    def append(self, word) -> None:
        self.extend((word,))

    def extend(self, more: Iterable) -> None:
        words, waiting, ended, stretches = self.words, self.waiting, self.ended, self.open
        n = len(words)
        last, before = (words[-1] if n else None), (words[-2] if n > 1 else None)
        for word in more:
            words.append(word)
            if stretches:
                broken = [p for p in stretches if words[n - p] != word]
                if broken:
                    self._close(broken, n)
            # blocks of one word: periods 1 and 2
            if word == last and n:
                stretches.setdefault(1, n - 1)
            elif word == before and n > 1:
                stretches.setdefault(2, n - 2)
            n += 1
            if word in ended and (ends := (last, word)) in waiting:
                waiting[ends] = self._caught(waiting[ends], n)
            if not n & 1:
                ended.add(word)
                size, ends = 2, (last, word)
                catchers = waiting.get(ends)
                if catchers is None:
                    catchers = waiting[ends] = []
                while not n & size - 1:
                    catchers.append((n, size))
                    size += size
            before, last = last, word

    def _caught(self, catchers: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """Opens a stretch for each catcher whose block is met again at the end of n words; gives the catchers that may still be met."""
        words, stretches, rest = self.words, self.open, []
        for catcher in catchers:
            end, size = catcher
            p = n - end
            if p >= 4 * size - 1:
                continue
            rest.append(catcher)
            if p < 2 * size - 1 or p in stretches or (stretches and self._told(p, n)) or words[end - size : end] != words[n - size : n]:
                continue
            start = end - size
            while start and words[start - 1] == words[start - 1 + p]:
                start -= 1
            stretches[p] = start
        return rest

    def _told(self, p: int, n: int) -> bool:
        """Whether the last p words have a period that divides p: then a stretch of period p has that period all over."""
        return any(not p % q and n - start >= p for q, start in self.open.items())

    def _close(self, periods: list[int], end: int) -> None:
        if len(periods) == 1:
            start = self.open.pop(periods[0])
            if end - start >= max(self.least, self.exponent * periods[0]):
                self.runs.append((start, end - start, periods[0]))
            return
        told = set()
        for p in sorted(periods):
            start = self.open.pop(p)
            if end - start >= max(self.least, self.exponent * p) and start not in told:
                told.add(start)
                self.runs.append((start, end - start, p))

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs by start and period; the sequence ends here."""
        self._close(list(self.open), len(self.words))
        self.runs.sort(key=lambda r: (r[0], r[2]))
        return self.runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed: one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, numbered from 0. A run is a stretch of words with smallest period q that is at least
    max(least, exponent * q) long and that no neighbour extends. collapsed holds, joined by one space, the words outside what runs repeat.
    Null and empty texts have no words, no run and an empty collapsed text. Rows with equal ids and null ids are judged each; an empty table
    gives none; other columns are left out."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # catchers make many small objects and no cycles
        try:
            yield from judged(batches)
        finally:
            gc.enable()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            ids, texts = part.column(0), []
            counts, found = [], []
            for body in part.column("body").to_pylist():
                words = body.split()
                catcher = SquareCatcher(least, exponent)
                catcher.extend(words)
                runs = catcher.finish()
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(collapsed(words, runs)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_bytes(f"`{text}`").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(walk, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def looped_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: in a tenth of the documents, by a hash of the id, the words from some place on repeat with some period. Null ids are left alone.

    h is the id's CRC-32 and g = h div 10; where h is divisible by 10, word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    split = chosen.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[CAST(a + (i - a) % p AS INT)])), ' ')")
    return placed.select("doc_id", F.when(F.col("p").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and hashes of all runs and of the collapsed text, of a table of periodic_runs."""
    first = F.expr("array_min(transform(runs, r -> struct(-r.length AS least, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    f = found.withColumn("first", first)
    length = -F.col("first.least")
    return f.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.start").alias("start"), length.alias("length"), F.col("first.period").alias("period"),
        F.expr("1000 * -first.least div first.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
