"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Fingerprints at most d bits apart, split into d + r blocks, agree in at least r of them; every choice of r
blocks is a join key. Only distinct fingerprints are joined, and a run of one key gives links that span it,
never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.batches import runs, slices, text_bytes
from storepulse.operators.components import connected_components
from storepulse.plans.lineage import cut

#: Rows of one key that a task compares at once; a longer run is dealt out as pairs of blocks.
BLOCK = 4096

#: Bytes of shingle sets in a part of a family; a task compares two parts.
PART_BYTES = 4 << 20


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> bytes:
    """XXH64 (big-endian) of every shingle of the lower-cased text, repeats included; b'' without words."""
    from xxhash import xxh64_digest

    found = text.lower().split()
    if len(found) < words:
        return xxh64_digest(b" ".join(found), seed) if found else b""
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    starts = [0, *ends[: len(found) - words].tolist()]
    return b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)])


def fingerprint(hashes: bytes) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without hashes."""
    n = len(hashes) // 8
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long): one row per row of docs. Null and empty texts have fp 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(of, "doc_id long, fp long")


def spanning_links(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected by pairs within the distance: each fingerprint reached is linked once."""
    left, right, rest = [], [], np.arange(len(fps))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            p = frontier.pop()
            near = np.bitwise_count(fps[rest] ^ fps[p]) <= distance
            hit, rest = rest[near], rest[~near]
            if len(hit):
                left.append(np.full(len(hit), fps[p]))
                right.append(fps[hit])
                frontier.extend(hit.tolist())
    return left, right


def _linker(keys: list[str], distance: int, most: int, defer: bool):
    names = ["a", "b", *keys, "block"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, number, rows, last in runs(batches, keys, most):
            fps = np.unique(rows.column("fp").to_numpy()).view(np.uint64)
            if defer and (number or not last):
                n = len(fps)
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(n, pa.int64()), *(pa.array(np.full(n, k)) for k in key), pa.array(np.full(n, number, dtype=np.int64))], names)
            elif len(fps) > 1:
                left, right = spanning_links(fps, distance)
                if left:
                    a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), pa.int64()) for _ in keys), pa.nulls(len(a), pa.int64())], names)

    return link


def near_links(fps: DataFrame, distance: int = 3, blocks: int = 6, block_rows: int = BLOCK) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) whose components are those of all pairs within the distance.

    Every choice of blocks - distance of the blocks is a key. Runs of a key up to block_rows are compared in one
    task; the rows of a longer one are dealt to all pairs of its blocks, so no task holds more than two blocks.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed)))).select("fp", F.col("pos").cast("long").alias("pos"), F.col("col").alias("key"))
    schema = "a long, b long, pos long, key long, block long"
    first = cut(keyed.repartition("pos", "key").sortWithinPartitions("pos", "key", "fp").mapInArrow(_linker(["pos", "key"], distance, block_rows, True), schema), "links")
    links = first.filter("b is not null").select("a", "b")
    long_runs = first.filter("b is null")
    if not long_runs.isEmpty():
        many = long_runs.groupBy("pos", "key").agg(F.max("block").alias("top"))
        grid = (
            long_runs.join(many, ["pos", "key"])
            .select("pos", "key", F.col("a").alias("fp"), "block", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("other"))
            .select("fp", "pos", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        )
        keys = ["pos", "key", "lo", "hi"]
        dealt = grid.repartition(*keys).sortWithinPartitions(*keys, "fp")
        links = links.union(dealt.mapInArrow(_linker(keys, distance, 2 * block_rows, False), "a long, b long, pos long, key long, lo long, hi long, block long").select("a", "b"))
    return links.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs.

    component_id is the smallest doc_id that links of at most `distance` differing bits reach. Texts without words
    have fingerprint zero and are linked like any other. Repeated rows and equal ids each give a row; an empty table gives none.
    """
    fps = cut(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(near_links(nodes.select("fp"), distance, blocks))
    of = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(ids, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similarity 0.8 on shingle sets is far beyond three of 64 bits, so it takes wide fingerprints: the signs of many random
# projections of a document's hashed shingle set. Blocks of a wide fingerprint are the join keys, and the Hamming distance
# gives the angle between the sets, hence their Jaccard similarity.


def wide_fingerprints(docs: DataFrame, doc_id: str, text: str, words: int, bits: int, sketch: int, seed: int) -> DataFrame:
    """doc_id, n (distinct shingles), fp (bits / 8 bytes), own (a hash of 16 bytes of the set of shingles); the last two are null without words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        planes = np.random.default_rng(seed).standard_normal((sketch, bits), dtype=np.float32)
        for part in slices(batches, "text", 1 << 20):
            sizes, packed, names, bodies = [], [], [], part.column("text").to_pylist()
            for start in range(0, len(bodies), 256):
                some = bodies[start : start + 256]
                folded = np.zeros((len(some), sketch), dtype=np.float32)
                for row, body in zip(folded, some, strict=True):
                    h = np.unique(np.frombuffer(shingle_hashes(body, words), dtype=">u8").astype(np.uint64))
                    row += np.bincount((h % np.uint64(sketch)).astype(np.int64), weights=np.where(h >> np.uint64(63), 1.0, -1.0), minlength=sketch)
                    sizes.append(len(h))
                    names.append(xxh3_128_digest(h.tobytes()) if len(h) else None)
                packed += [p.tobytes() for p in np.packbits(folded @ planes > 0, axis=1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([p if n else None for p, n in zip(packed, sizes, strict=True)], pa.binary()), pa.array(names, pa.binary())], ["doc_id", "n", "fp", "own"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(of, "doc_id long, n long, fp binary, own binary")


def spanning_pairs(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of 0..n-1 that connect what all near pairs connect; near(i, rest) tells which of rest are near i."""
    left, right, rest = [], [], np.arange(n)
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            hit = near(i, rest)
            found, rest = rest[hit], rest[~hit]
            left.append(np.full(len(found), i))
            right.append(found)
            frontier.extend(found.tolist())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))


def _likely_linker(keys: list[str], bits: int, least: float, most: int, defer: bool):
    """Spanning links of each run by the estimated similarity. With defer, the rows of a run of several blocks are passed on with the block's number."""
    names = ["a", "b", "n", "fp", *keys, "part"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0

        def told():
            a, b = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
            left.clear(), right.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary()), *(pa.nulls(len(a), pa.int64()) for _ in [*keys, "part"])], names)

        for key, number, rows, last in runs(batches, keys, most):
            if defer and (number or not last):
                m = rows.num_rows
                yield from pa.table([rows.column("rep"), pa.nulls(m, pa.int64()), rows.column("n"), rows.column("fp"), *(pa.array(np.full(m, k)) for k in key), pa.array(np.full(m, number, dtype=np.int64))], names=names).to_batches()
                continue
            if rows.num_rows < 2:
                continue
            reps, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy().astype(float)
            fps = np.frombuffer(b"".join(rows.column("fp").to_pylist()), dtype=np.uint64).reshape(len(reps), -1)

            def near(i: int, rest: np.ndarray, n=n, fps=fps) -> np.ndarray:
                cosine = np.cos(np.pi * np.bitwise_count(fps[rest] ^ fps[i]).sum(axis=1, dtype=np.int64) / bits)
                both = np.minimum(cosine * np.sqrt(n[i] * n[rest]), np.minimum(n[i], n[rest]))
                return both / (n[i] + n[rest] - both) >= least

            i, j = spanning_pairs(len(reps), near)
            if len(i):
                left.append(reps[i]), right.append(reps[j])
                held += len(i)
            if held > 200_000:
                yield told()
                held = 0
        if held:
            yield told()

    return link


def likely_links(nodes: DataFrame, bits: int, block_bytes: int, least: float, block_rows: int = BLOCK) -> DataFrame:
    """a, b: links among nodes (rep, fp, n) whose components are those of all pairs that share a block and are estimated at `least` or more.

    Runs of a block up to block_rows are compared in one task; the rows of a longer one are dealt to all pairs of its parts."""
    blocks = bits // 8 // block_bytes
    keyed = nodes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.conv(F.hex(F.expr("fp").substr(i * block_bytes + 1, F.lit(block_bytes))), 16, 10).cast("long")))).select("rep", F.col("pos").cast("long").alias("block"), F.col("col").alias("key"))
    shared = Window.partitionBy("block", "key")
    meeting = keyed.withColumn("m", F.count("*").over(shared)).filter("m > 1").select("block", "key", "rep").join(nodes, "rep").select("block", "key", "rep", "n", "fp")
    schema = "a long, b long, n long, fp binary, block long, key long, part long"
    first = cut(meeting.repartition("block", "key").sortWithinPartitions("block", "key", "rep").mapInArrow(_likely_linker(["block", "key"], bits, least, block_rows, True), schema), "likely")
    links = first.filter("b is not null").select("a", "b")
    long_runs = first.filter("b is null")
    if not long_runs.isEmpty():
        many = long_runs.groupBy("block", "key").agg(F.max("part").alias("top"))
        grid = (
            long_runs.join(many, ["block", "key"])
            .select("block", "key", F.col("a").alias("rep"), "n", "fp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("other"))
            .filter("part <> other")
            .select("block", "key", "rep", "n", "fp", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
        )
        keys = ["block", "key", "lo", "hi"]
        dealt = grid.repartition(*keys).sortWithinPartitions(*keys, "rep")
        links = links.union(dealt.mapInArrow(_likely_linker(keys, bits, least, 2 * block_rows, False), "a long, b long, n long, fp binary, block long, key long, lo long, hi long, part long").select("a", "b"))
    return links.distinct()


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 3072, sketch: int = 4096, block_bytes: int = 3, slack: float = 0.08, seed: int = 29, block_rows: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, component_id of the distinct ids: groups connected by pairs whose Jaccard similarity of word shingles is `similarity` or more.

    component_id is the smallest doc_id of the group; texts without words, null ones too, are alone. Rows with equal ids are one member, in the
    group of the smallest id that any of their texts reaches. An empty table gives none. Equal sets of shingles are one node. Documents that share a block are compared each with each
    by wide fingerprints: the fraction of differing bits gives an estimate of the similarity (its standard error is about 0.03 at 0.8), and
    pairs estimated at similarity - slack or more make families. Within a family every pair is compared exactly by its sets of shingles.
    Both comparisons give links that span their groups, so a large group gives about as many links as it has rows.
    """
    fps = cut(wide_fingerprints(docs, doc_id, text, words, bits, sketch, seed), "wide")
    nodes = cut(fps.filter("own is not null").groupBy("own").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    families = connected_components(likely_links(nodes.select("rep", "n", "fp"), bits, block_bytes, similarity - slack, block_rows))
    # cut, as components start with an Arrow stage: two in one task take two Python workers a core, which the executor then keeps
    exact = cut(_exactly(docs, families, doc_id, text, words, similarity, part_bytes), "exact")
    groups = connected_components(exact).withColumnRenamed("node", "rep")
    of = nodes.join(groups, "rep", "left").select("own", F.coalesce("component", "rep").alias("component_id"))
    named = fps.filter("own is not null").select("doc_id", "own").join(of, "own").select("doc_id", "component_id")
    return named.union(fps.filter("own is null").select("doc_id", F.col("doc_id").alias("component_id"))).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _exactly(docs: DataFrame, families: DataFrame, doc_id: str, text: str, words: int, similarity: float, part_bytes: int) -> DataFrame:
    """a, b: links that span what the pairs of a family (node, component) connect whose sets of shingle hashes have that Jaccard similarity or more.

    A family's sets are parted by hash to about part_bytes and dealt to all pairs of parts, so no task holds more than two parts."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [np.unique(np.frombuffer(shingle_hashes(t, words), dtype=np.uint64)).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows, _ in runs(batches, ["component", "lo", "hi"], 1 << 30):
            ids, sets = rows.column("doc_id").to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets])
            names, codes = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(n)
            marked = np.zeros(len(names), dtype=bool)

            def near(i: int, rest: np.ndarray, n=n, codes=codes, ends=ends, marked=marked) -> np.ndarray:
                out = np.zeros(len(rest), dtype=bool)
                fit = np.flatnonzero((np.minimum(n[i], n[rest]) >= similarity * np.maximum(n[i], n[rest])) & (n[rest] > 0))
                if len(fit):
                    some = rest[fit]
                    marked[codes[ends[i] - n[i] : ends[i]]] = True
                    starts = np.r_[0, np.cumsum(n[some])[:-1]]
                    at = np.arange(n[some].sum()) + np.repeat(ends[some] - n[some] - starts, n[some])
                    both = np.add.reduceat(marked[codes[at]].astype(np.int64), starts)
                    marked[codes[ends[i] - n[i] : ends[i]]] = False
                    out[fit] = both >= similarity * (n[i] + n[some] - both)
                return out

            i, j = spanning_pairs(len(ids), near)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    members = families.select(F.col("node").alias("doc_id"), "component").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).join(members.select("doc_id"), "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(sets_of, "doc_id long, shingles binary").join(members, "doc_id"), "sets")
    sizes = sets.groupBy("component").agg(F.ceil(F.sum(F.length("shingles")) / part_bytes).alias("parts"))
    dealt = (
        sets.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        .select("component", "doc_id", "shingles", "parts", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .filter("parts = 1 or own <> other")
        .select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "doc_id", "shingles")
    )
    return dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "doc_id").mapInArrow(compare, "a long, b long")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of similar ones, the one with the smallest id, in the columns of docs.

    Rows with equal ids are one document: of them the row with the least text stays, of equal texts the one with the least hash of
    all columns that can be hashed. Rows without id stay as they are; an empty table gives none."""
    named = docs.filter(F.col(doc_id).isNotNull())
    kept = similar_groups(named, doc_id, text, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("id"))
    rows = named.select(F.col(doc_id).cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    plain = [F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    least = F.min_by("row", F.struct(F.col("row")[text], F.xxhash64(*plain))).alias("row")
    stay = rows.join(kept, "id", "left_semi").groupBy("id").agg(least).select("row.*")
    return stay.union(docs.filter(F.col(doc_id).isNull()))
