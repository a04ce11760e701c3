"""Packing documents into training sequences: first-fit decreasing over randomised groups.

Plan: one Arrow stage tokenises each document and cuts it at multiples of the sequence length; one shuffle
deals the pieces by a random key; one Arrow stage packs each group of a bounded number of tokens.
Only the last piece of a document carries its ids through the shuffle, two bytes each.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.batches import slices, text_bytes

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: What is known of a tokenizer whose words can be encoded one by one; any other is run over whole texts.
KNOWN_NORMALISERS = [["NFC", "Replace", "Lowercase"]]
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds(dict):
    """Ids of words, as little-endian bytes, from a tokenizer that drops white space; a word is encoded when first met, then kept.

    A run of Latin letters, with at most one mark after it, goes to the model as the tokenizer would hand it over; every other
    word goes through the whole tokenizer. `most` bounds the words kept; words over `long` bytes are never kept. A
    tokenizer that is not known to part texts at white space is run over whole texts."""

    MARKS = ".,!?;:"

    def __init__(self, path: str, most: int = 1_000_000, long: int = 64):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer, self.most, self.long = Tokenizer.from_file(path), most, long
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.cut = self.tokenizer.model.tokenize
        steps = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        split = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        added = told.get("added_tokens", [])
        self.parted = (
            steps in KNOWN_NORMALISERS and split.get("pattern", {}).get("Regex") == KNOWN_PATTERN and split.get("behavior") == "Removed" and not told.get("post_processor")
            and all(t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
            and not any(all(c.isalpha() or c in self.MARKS for c in t["content"]) for t in added)
        )
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.marks = {m: self._bytes(t.id for t in self.cut(m)) for m in self.MARKS} if self.parted else {}

    def _bytes(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if self.parted:
            look = self.__getitem__
            return [b"".join(map(look, t.split())) for t in texts]
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def __missing__(self, word: bytes) -> bytes:
        s = word.decode("utf-8", "replace")
        stem, mark = (s[:-1], self.marks[s[-1]]) if s[-1] in self.marks and len(s) > 1 else (s, b"")
        # letters up to U+024F but U+0130: composed already, and lower case is one letter for one
        if stem.isalpha() and (stem.isascii() or (max(stem) < "\u0250" and "\u0130" not in stem)):
            low = stem.lower()
            own = self._bytes(t.id for t in self.cut(low if stem.isascii() else low.encode().decode("latin-1").translate(self.alphabet))) + mark
        else:
            own = self._bytes(self.tokenizer.encode(s, add_special_tokens=False).ids)
        if len(word) <= self.long:
            if len(self) >= self.most:
                self.clear()
            self[word] = own
        return own


def id_kind(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


_OWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This process's WordIds of a tokenizer: the tasks that a worker runs share the words it has met."""
    if path not in _OWN:
        _OWN[path] = WordIds(path)
    return _OWN[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Tournament:
    """A tournament tree of bin capacities: each inner node holds the larger of its two children's."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """The first bin that has room, which then has that much less."""
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        tree[node] -= length
        at = node - self.size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
        return at


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the pieces in each bin, in the order in which they were placed; equal lengths keep their order."""
    tree, bins = Tournament(len(lengths), capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = tree.place(lengths[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def powers_of_two(total: int) -> list[int]:
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


def pack_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096,
    end_id: int = 2, group_tokens: int = 1 << 22, group_bytes: int = 16 << 20, waste: float = 1 / 64, seed: int = 17,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document's ids are the tokenizer's for the whole text (null text: empty), then end_id. A document over
    `capacity` is cut at multiples of it. The pieces left are dealt to random groups, whose number grows with
    the bytes of text, and each group of at most group_tokens is packed on its own by first-fit decreasing. A bin
    left with over `waste` of its capacity empty is cut at powers of two, where sequences need no padding.
    Repeated rows and equal ids are packed row by row. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"), F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("salt"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = np.array([end_id], dtype=words.kind).tobytes()
        for part in slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for key, salt, found in zip(part.column("doc_id").to_pylist(), part.column("salt").to_pylist(), words.of(part.column("text").to_pylist()), strict=True):
                ids = np.frombuffer(found + end, dtype=words.kind)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for column, value in zip(out, (key, start, len(piece), crc(piece), len(ids), salt, piece.tobytes() if len(piece) < capacity else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 6 + [pa.binary()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def finished(group: list[tuple]) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            whole, rest = [p for p in group if p[2] == capacity], [p for p in group if p[2] < capacity]
            for p in whole:
                out.append((*p[:5], sequence, 0))
                sequence += 1
            for members in first_fit_decreasing([p[2] for p in rest], capacity):
                pieces, total = [rest[i] for i in members], sum(rest[i][2] for i in members)
                ends = powers_of_two(total) if capacity - total > waste * capacity else [total]
                room, offset = ends[0], 0
                for key, start, length, check, tokens, ids in pieces:
                    done = 0
                    while done < length:
                        take = min(length - done, room)
                        own = check if take == length else crc(np.frombuffer(ids, dtype=kind)[done : done + take])
                        out.append((key, start + done, take, own, tokens, sequence, offset))
                        done, room, offset = done + take, room - take, offset + take
                        if not room:
                            ends = ends[1:]
                            sequence, room, offset = sequence + 1, ends[0] if ends else 0, 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

        group, tokens = [], 0
        for batch in batches:
            for p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")), strict=True):
                group.append(p)
                tokens += p[2]
                if tokens >= group_tokens:
                    yield finished(group)
                    group, tokens = [], 0
        if group:
            yield finished(group)

    from tokenizers import Tokenizer

    kind = id_kind(Tokenizer.from_file(tokenizer).get_vocab_size())
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first().n
    groups = max(1, math.ceil(total / group_bytes))
    pieces = rows.mapInArrow(cut_up, f"{PIECES}, salt long, ids binary")
    dealt = pieces.repartition(groups, "salt").sortWithinPartitions("salt", "doc_id", "start")
    return dealt.mapInArrow(pack, f"{PIECES}, sequence_id long, offset long")
