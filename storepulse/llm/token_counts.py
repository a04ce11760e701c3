"""Token counts by distinct pre-tokens, without materialising ids.

In a SentencePiece BPE vocabulary split at white space no piece has a word mark after another character, so
merges never cross the place where a word begins. Counting pieces thus needs one run of the model per distinct
pre-token. Pre-tokens seen often (a bounded number) are looked up from a broadcast dictionary as documents are
read; the rest go through a shuffled join of (pre-token, document, frequency) with the dictionary table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.batches import slices, text_bytes
from storepulse.plans.lineage import cut

MARK = "▁"


class Pieces:
    """The model without its leading word mark, and the pattern of pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only models without normalisation of characters or white space are counted by pre-token")
        plain = [p.piece for p in proto.pieces if p.type == 1]
        if any(p.type == 4 for p in proto.pieces) or any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
            raise ValueError("a piece of this vocabulary crosses pre-tokens")
        rules.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        line = "" if any("\n" in p for p in plain) else "\n"
        self.find = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if line else f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def pretokens(self, text: bytes) -> list[str]:
        return self.find(MARK + text.decode("utf-8", "replace").replace(" ", MARK)) if text else []

    def counts(self, pretokens: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(pretokens, num_threads=1)]


def pretoken_vocabulary(docs: DataFrame, model: str) -> DataFrame:
    """pretoken, freq, pieces of a table with a binary column text: each distinct pre-token once."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, found = Pieces(model), Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pretoken", "freq"])
            found.clear()
            return out

        for part in slices(batches, "text"):
            for body in part.column("text").to_pylist():
                found.update(pieces.pretokens(body))
            if len(found) > 400_000:
                yield told()
        if found:
            yield told()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces.counts(batch.column("pretoken").to_pylist()), pa.int64())], ["pretoken", "freq", "pieces"])

    seen = docs.select("text").mapInArrow(blocks, "pretoken string, freq long")
    return seen.groupBy("pretoken").agg(F.sum("freq").alias("freq")).mapInArrow(count, "pretoken string, freq long, pieces long")


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, head: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): one row per row of docs, whole texts.

    Counts are those of the SentencePiece model for the text, without begin or end; strings of special tokens
    inside a text are ordinary text. Null texts count as empty (0 tokens); repeated rows give repeated rows.
    At most `head` pre-tokens, the most frequent of the whole table, are broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    words = cut(pretoken_vocabulary(rows, model), "pretokens")
    step = F.floor(F.log2("freq") * 8)
    enough, often = 0, 1 << 30
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        enough += r["count"]
        if enough > head:
            break
        often = r.step
    frequent = words.filter(step >= often).select("pretoken", "pieces").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(frequent.pretoken, frequent.pieces.tolist(), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, look = Pieces(model), known.value.get
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for part in slices(batches, "text"):
            rid, doc, token, n, size = [], [], [], [], []
            for key, name, body in zip(*(part.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
                total = 0
                for word, freq in Counter(pieces.pretokens(body)).items():
                    count = look(word)
                    if count is None:
                        for column, value in zip((rid, doc, token, n, size), (key, None, word, freq, None), strict=True):
                            column.append(value)
                    else:
                        total += freq * count
                for column, value in zip((rid, doc, token, n, size), (key, name, None, total, len(body)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((rid, doc, token, n, size), kinds, strict=True)], ["rid", "doc_id", "token", "n", "size"])

    keyed = rows.withColumn("rid", F.monotonically_increasing_id())
    parts = keyed.mapInArrow(frequencies, "rid long, doc_id long, token string, n long, size long")
    # a row of known counts has no pre-token; a key of its own keeps such rows apart in the join
    parts = parts.withColumn("pretoken", F.coalesce("token", F.concat(F.lit("\x01"), F.col("rid").cast("string"))))
    rare = words.filter(step < often).select("pretoken", "pieces")
    sums = (
        parts.join(rare, "pretoken", "left")
        .groupBy("rid")
        .agg(F.sum(F.when(F.col("token").isNull(), F.col("n")).otherwise(F.col("n") * F.col("pieces"))).alias("n_tokens"), F.max("size").alias("n_bytes"), F.max("doc_id").alias("doc_id"))
    )
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
