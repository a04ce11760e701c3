"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors are one class. The graph starts from windows of a few sorted random projections. A round gathers at
every class its neighbours and some of those it is a neighbour of, with vectors of one byte per component, and compares
them with each other. A list that is full of candidates is saturated: it is enlarged and the rounds go on. Then a fresh bounded
sample is compared with all rows, in double precision; while too few of its links are found, lists are enlarged, projections are
added and the rounds go on. What the audit sees never enters the graph. The edges of the graph are kept by cosine in double
precision; only a class whose list stays saturated at its largest is compared with its whole component, in blocks.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.batches import runs
from storepulse.operators.components import connected_components
from storepulse.plans.lineage import cut

BLOCK = 1024
log = logging.getLogger(__name__)


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, dtype=kind) if rows else np.zeros((0, 1), dtype=kind)


def _codes(column, size: int) -> np.ndarray:
    """Unit vectors again, from one signed byte per component."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, size).astype(np.float32)
    return data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-9)


def vector_classes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows (vec_id, rep), rep null if the vector links with nothing; the classes (rep, label, v, weight) of equal vectors of one label."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v"))).withColumn("hash", F.xxhash64("v"))
    classes = cut(rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    named = classes.select("rep", F.col("label").alias("l"), F.col("v").alias("u"), F.xxhash64("v").alias("h"))
    members = rows.join(named, (F.col("hash") == F.col("h")) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("u")), "left").select("vec_id", "rep")
    return members, classes


def _quantised(classes: DataFrame) -> DataFrame:
    """rep, label, size, code: the unit vector's components times 127, a byte each."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column("v").to_pylist():
                x = unit(np.array([v], dtype=np.float64))[0]
                codes.append(np.round(x / np.abs(x).max() * 127).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("group"), pa.array(codes, pa.binary())], ["rep", "group", "code"])

    # vectors of another length are never compared, so it is part of the group
    return classes.select("rep", F.xxhash64("label", F.size("v")).alias("group"), "v").mapInArrow(code, "rep long, group long, code binary")


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each a's k most similar b."""
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.array([], dtype=int)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    keep = rank < k
    return a[keep], b[keep], sim[keep]


def _edges(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, dtype=np.int64)), pa.array(np.asarray(b, dtype=np.int64)), pa.array(np.asarray(sim, dtype=np.float32))], ["a", "b", "sim"])


EDGE = "a long, b long, sim float"


def _seeded(codes: DataFrame, table: int, window: int, seed: int, parts: int, k: int, bits: int) -> DataFrame:
    """Neighbours from a window over the classes, sorted by group, the signs of `bits` random projections and one more projection."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("code").to_pylist()
            signs, along = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
            lengths = np.array([len(r) for r in rows])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                x = _codes(pa.array([rows[i] for i in at]), int(size)) @ np.random.default_rng((seed, table, int(size))).standard_normal((int(size), bits + 1)).astype(np.float32)
                signs[at], along[at] = (x[:, :bits] > 0) @ (1 << np.arange(bits)), x[:, bits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs), pa.array(along)], [*batch.schema.names, "signs", "along"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            reps, groups, codes_ = rows.column("rep").to_numpy(), rows.column("group").to_numpy(), rows.column("code").to_pylist()
            a, b, s = [], [], []
            lengths = np.array([len(c) for c in codes_])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                x = _codes(pa.array([codes_[i] for i in at]), int(size))
                for d in range(1, window + 1):
                    same = np.flatnonzero(groups[at][:-d] == groups[at][d:]) if len(at) > d else []
                    if len(same):
                        sim = np.einsum("ij,ij->i", x[same], x[same + d])
                        left, right = reps[at][same], reps[at][same + d]
                        a += [left, right]
                        b += [right, left]
                        s += [sim, sim]
            if a:
                yield _edges(*_best(np.concatenate(a), np.concatenate(b), np.concatenate(s), k))
            carry = rows.slice(max(0, rows.num_rows - window))

    keyed = codes.mapInArrow(key, "rep long, group long, code binary, signs long, along double")
    return keyed.repartitionByRange(parts, "group", "signs", "along", "rep").sortWithinPartitions("group", "signs", "along", "rep").mapInArrow(near, EDGE)


def _lists(edges: DataFrame, wide: DataFrame | None, k: int, most_k: int) -> DataFrame:
    """Each a's best b: as many as `wide` (a, k) says, else k. The rank is cut to most_k before rows of a class meet."""
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    best = one.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("rank") <= most_k)
    if wide is not None:
        best = best.join(wide, "a", "left").filter(F.col("rank") <= F.greatest(F.coalesce("k", F.lit(k)), F.lit(k)))
    else:
        best = best.filter(F.col("rank") <= k)
    return best.select("a", "b", "sim")


def _saturated(lists: DataFrame, wide: DataFrame | None, k: int, about: float) -> DataFrame:
    """a, k: the lists that are full and whose last entry is a candidate, so that more candidates may lie beyond it."""
    ends = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("last"))
    ends = ends.join(wide, "a", "left") if wide is not None else ends.withColumn("k", F.lit(None).cast("int"))
    return ends.withColumn("k", F.greatest(F.coalesce("k", F.lit(k)), F.lit(k))).filter((F.col("n") >= F.col("k")) & (F.col("last") >= about)).select("a", "k")


def _refined(lists: DataFrame, codes: DataFrame, wide: DataFrame | None, k: int, most_k: int) -> DataFrame:
    """Edges found by comparing, at every class, its neighbours with each other that are better than the ends' worst."""
    ends = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("last"))
    ends = ends.join(wide, "a", "left") if wide is not None else ends.withColumn("k", F.lit(None).cast("int"))
    full = F.col("n") >= F.greatest(F.coalesce("k", F.lit(k)), F.lit(k))
    floors = ends.select("a", F.when(full, F.col("last")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
    # of those that have a class in their list, k by hash; map tasks keep k of a hub's before they send any
    back = lists.select(F.col("b").alias("at"), F.col("a").alias("member"))
    by = Window.partitionBy("at").orderBy(F.xxhash64("member", "at"), "member")
    back = back.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("at", "member")
    own = lists.select(F.col("a").alias("at"), F.col("b").alias("member"))
    around = own.union(back).union(floors.select(F.col("a").alias("at"), F.col("a").alias("member"))).distinct()
    placed = around.join(codes.join(floors.withColumnRenamed("a", "rep"), "rep", "left").select(F.col("rep").alias("member"), "code", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor")), "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, rows, _ in runs(batches, ["at"], 2 * most_k + 2):
            codes_ = rows.column("code")
            reps, floor = rows.column("member").to_numpy(), rows.column("floor").to_numpy()
            if len(reps) < 2:
                continue
            x = _codes(codes_, len(codes_[0].as_py()))
            sim = x @ x.T
            np.fill_diagonal(sim, -3)
            i, j = np.nonzero(sim > floor[:, None])
            if len(i):
                held.append((reps[i], reps[j], sim[i, j]))
                size += len(i)
            if size > 100_000:
                yield _edges(*_best(*_unique(*map(np.concatenate, zip(*held, strict=True))), most_k))
                held, size = [], 0
        if held:
            yield _edges(*_best(*_unique(*map(np.concatenate, zip(*held, strict=True))), most_k))

    found = placed.select("at", "member", "code", "floor").repartition("at").sortWithinPartitions("at", "member").mapInArrow(compare, EDGE)
    return found


def _unique(a, b, s):
    _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
    return a[first], b[first], s[first]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors in double precision of the vectors of each length."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, unit(values[starts[at][:, None] - starts[0] + np.arange(size)])


def _audit(classes: DataFrame, threshold: float, sample: int, turn: int) -> DataFrame:
    """a, b: all links (cosine of threshold or more) of a sample, fresh each turn, of at most `sample` classes a, by brute force against all rows."""
    queries = classes.orderBy(F.xxhash64("rep", F.lit(3 + turn)), "rep").limit(sample).select("rep", "label", "v").collect()
    table: dict = {}
    for q in queries:
        table.setdefault((q.label, len(q.v)), []).append(q)
    known = {key: (np.array([q.rep for q in own]), unit(np.array([q.v for q in own], dtype=np.float64))) for key, own in table.items()}
    shared = classes.sparkSession.sparkContext.broadcast(known)

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, reps = np.array(batch.column("label").to_pylist(), dtype=object), batch.column("rep").to_numpy()
            for at, x in _by_length(batch.column("v")):
                for label in set(labels[at].tolist()):
                    own, q = shared.value.get((label, x.shape[1]), (None, None))
                    if own is not None:
                        here = at[labels[at] == label]
                        i, j = np.nonzero(q @ x[labels[at] == label].T >= threshold)
                        a, b = own[i], reps[here[j]]
                        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return classes.select("rep", "label", "v").mapInArrow(against, "a long, b long")


def _recall(truth: DataFrame, pairs: DataFrame, whole: DataFrame | None = None) -> float | None:
    """The share of their links that sampled classes find, averaged over classes of about as many links; the least of these averages.

    A link is found if it is an edge (a, b) of pairs, or if its ends are in one component of `whole` (component, rep, saturated) and one of them is
    saturated, for these are compared. None, unmeasured, without any link."""
    edges = pairs.union(pairs.select("b", "a")).distinct().withColumn("edge", F.lit(True))
    known, met = truth.join(edges, ["a", "b"], "left"), F.coalesce("edge", F.lit(False))
    if whole is not None:
        for end in "ab":
            known = known.join(whole.select(F.col("rep").alias(end), F.col("component").alias(f"c{end}"), F.col("saturated").alias(f"s{end}")), end, "left")
        met = met | F.coalesce((F.col("ca") == F.col("cb")) & (F.col("sa") | F.col("sb")), F.lit(False))
    each = known.groupBy("a").agg(F.count("*").alias("n"), F.avg(met.cast("double")).alias("found"))
    strata = each.groupBy(F.floor(F.log(4.0, "n")).alias("stratum")).agg(F.count("*").alias("classes"), F.avg("found").alias("found")).collect()
    n = sum(s.classes for s in strata)
    return min([s.found for s in strata if s.classes >= 12] + [sum(s.found * s.classes for s in strata) / n]) if n else None


LINK = "a long, b long, n long"


def _links(a, b, gained: list[tuple]) -> pa.RecordBatch:
    """Rows (a, b, 0) of links, and rows (class, null, n) of what classes gain."""
    names, n = np.concatenate([g[0] for g in gained]), np.concatenate([g[1] for g in gained])
    return pa.RecordBatch.from_arrays([pa.array(np.r_[names, a].astype(np.int64)), pa.array([*[None] * len(names), *np.asarray(b).tolist()], pa.int64()), pa.array(np.r_[n, np.zeros(len(a))].astype(np.int64))], ["a", "b", "n"])


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of the edges (a, b), each there once, the links by cosine in double precision: rows (a, b, 0), and (a, null, weight of b) and (b, null, weight of a)."""
    end = lambda e: classes.select(F.col("rep").alias(e), F.col("v").alias(f"v{e}"), F.col("weight").alias(f"w{e}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, wa, wb = (batch.column(c).to_numpy() for c in ("a", "b", "wa", "wb"))
            for (at, x), (_, y) in zip(_by_length(batch.column("va")), _by_length(batch.column("vb")), strict=True):
                at = at[np.einsum("ij,ij->i", x, y) >= threshold]
                yield _links(a[at], b[at], [(a[at], wb[at]), (b[at], wa[at])])

    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "va", "vb", "wa", "wb").mapInArrow(check, LINK)


def _compared(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Over (component, rep, v, weight, saturated): the links of saturated classes with all of their component.

    Rows (a, b null, n) of links that a gains in a pair of blocks, and rows (a, b, 0) that span the links there. The saturated classes of a component are
    dealt in blocks against blocks of all its classes, so no task holds more than two blocks, and no pair becomes a row."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).alias("rights"), F.ceil(F.count_if("saturated") / block).alias("lefts")).filter("lefts > 0")
    placed, hashed, zero = members.join(sizes, "component"), F.xxhash64("rep"), F.lit(0).cast("long")
    rest = ["rep", "v", "weight", "saturated"]
    left = placed.filter("saturated").select("component", F.pmod(hashed, F.col("lefts")).alias("lo"), F.explode(F.sequence(zero, F.col("rights") - 1)).alias("hi"), F.lit(0).alias("side"), *rest)
    right = placed.select("component", F.explode(F.sequence(zero, F.col("lefts") - 1)).alias("lo"), F.pmod(hashed, F.col("rights")).alias("hi"), F.lit(1).alias("side"), *rest)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows, _ in runs(batches, ["component", "lo", "hi"], 1 << 20):
            reps, weight, side = (rows.column(c).to_numpy() for c in ("rep", "weight", "side"))
            i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(i) and len(j):
                x = unit(_matrix(rows.column("v"), np.float64))
                linked = (x[i] @ x[j].T >= threshold) & (reps[i][:, None] != reps[j])
                # a saturated class on the right gains its links where it is on the left
                other = ~np.array(rows.column("saturated").to_pylist(), dtype=bool)[j]
                at, to = _spanning(linked)
                yield _links(reps[i][at], reps[j][to], [(reps[i], linked @ weight[j]), (reps[j][other], weight[i] @ linked[:, other])])

    return left.union(right).repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "side", "rep").mapInArrow(compare, LINK)


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (left, right) that connect what all links of a bipartite matrix connect."""
    i_out, j_out = [], []
    left, right = np.flatnonzero(linked.any(axis=1)), np.ones(linked.shape[1], dtype=bool)
    seen = np.zeros(linked.shape[0], dtype=bool)
    for start in left:
        if seen[start]:
            continue
        seen[start], frontier = True, [start]
        while frontier:
            i = frontier.pop()
            new = np.flatnonzero(linked[i] & right)
            i_out += [i] * len(new)
            j_out += new.tolist()
            right[new] = False
            if len(new):
                more = np.flatnonzero(linked[:, new].any(axis=1) & ~seen)
                for m in more:
                    i_out.append(m)
                    j_out.append(int(new[np.flatnonzero(linked[m, new])[0]]))
                seen[more] = True
                frontier += more.tolist()
    return np.array(i_out, dtype=int), np.array(j_out, dtype=int)


def near_duplicate_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, k: int = 6, most_k: int = 96, tables: int = 10, window: int = 16,
    rounds: int = 2, recall: float = 0.97, most_turns: int = 5, sample: int = 1024, linked: int = 50, most_sample: int = 16384, slack: float = 0.006, seed: int = 5,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.

    Pairs of one label with cosine >= threshold are links; only rows of equal, non-null labels are compared. n_links counts
    the other vectors linked directly, copies included; component_id is the smallest vec_id that links reach, the row's own
    included; kept says that they are equal. Vectors that are null, empty, zero or hold null or non-finite components, and
    those of null label, link with nothing. Of rows with equal vec_id and vector each counts the others; an empty table gives none.

    `slack` covers the error of the one-byte codes. A turn is `rounds` rounds and more while lists are saturated, each time four times as long
    up to most_k, and an audit of `sample` classes, of four times as many, up to most_sample, while fewer than `linked` of them have
    links. A turn whose recall is short doubles k and the number of projections. If most_turns do not suffice, every label is compared
    whole, in blocks: exact, and quadratic. A sample without links leaves the recall unmeasured, which is logged as a warning unless the sample was
    every class.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members, classes = vector_classes(vectors, vec_id, embedding, label)
    codes = cut(_quantised(classes), "codes")
    about, count = threshold - slack, codes.count()
    bits = min(40, max(4, math.ceil(math.log2(1 + count / window))))
    lists = wide = pairs = whole = None
    start = 0
    for turn in range(most_turns):
        for t in range(start, tables):
            own = _seeded(codes, t, window, seed, parts, k, bits)
            lists = own if lists is None else lists.union(own)
        start, lists = tables, cut(_lists(lists, wide, k, most_k), "lists")
        left = rounds
        while left > 0:
            left -= 1
            lists = cut(_lists(lists.union(_refined(lists, codes, wide, k, most_k)), wide, k, most_k), "lists")
            saturated = cut(_saturated(lists, wide, k, about), "saturated")
            if not saturated.filter(F.col("k") < most_k).isEmpty():
                grown = saturated.withColumn("k", F.least(F.col("k") * 4, F.lit(most_k)))
                wide = cut(grown if wide is None else wide.union(grown).groupBy("a").agg(F.max("k").alias("k")), "wide")
                left = max(left, 1)
        pairs = cut(lists.filter(F.col("sim") >= about).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        # a class in more lists than the longest has room for counts as saturated too
        degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").count()
        full = cut(saturated.select(F.col("a").alias("rep")).union(degree.filter(F.col("count") > most_k).select("rep")).distinct(), "full")
        whole = None
        if not full.isEmpty():
            groups = connected_components(pairs).withColumnRenamed("node", "rep").join(full.withColumn("full", F.lit(True)), "rep", "left")
            whole = cut(groups.select("component", "rep", F.coalesce("full", F.lit(False)).alias("saturated")), "groups")
        size = sample
        truth = cut(_audit(classes, threshold, size, turn), "audit")
        while size < min(most_sample, count) and truth.select("a").distinct().count() < linked:
            size *= 4
            truth = cut(_audit(classes, threshold, size, turn), "audit")
        reached = _recall(truth, pairs, whole)
        if reached is None and size < count:
            log.warning("recall is unmeasured: no links in a sample of %d of %d classes", size, count)
        elif reached is not None:
            log.info("turn %d: recall %.3f of the links of a sample of %d of %d classes", turn, reached, min(size, count), count)
        if reached is None or reached >= recall:
            break
        k, tables = 2 * k, 2 * tables
        most_k = max(most_k, 2 * k)
    else:
        pairs, whole = None, codes.select("rep", F.col("group").alias("component"), F.lit(True).alias("saturated"))
    links = None
    if whole is not None:
        links = _compared(whole.join(classes, "rep").select("component", "rep", "v", "weight", "saturated"), threshold)
    if pairs is not None:
        if whole is not None:
            for end in "ab":
                pairs = pairs.join(full.withColumnRenamed("rep", end), end, "left_anti")
        edges = _verified(pairs, classes, threshold)
        links = edges if links is None else links.union(edges)
    links = cut(links, "verified")
    final = connected_components(links.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    degrees = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    of = classes.select("rep", "weight").join(final, "rep", "left").join(degrees, "rep", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("links"), F.coalesce("component", "rep").alias("component_id"))
    known = members.filter("rep is not null").join(of, "rep").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = members.filter("rep is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
