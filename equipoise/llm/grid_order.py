"""Embedding near-dedup: an epsilon grid order join under cosine similarity.

Unit vectors lie within eps of each other exactly if their cosine reaches the threshold. They are sorted by
their grid cells of width eps on the leading principal axes; the sorted sequence is cut into intervals.
Intervals whose boxes are further apart than eps are never joined; the others meet pair by pair, are cut
into shorter intervals and these again, until what can't be ruled out is compared, in the end in double precision.
Equal vectors are one, with a count, from the start, and a pair of intervals sends counts and a spanning
forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import drop, store
from .stars import components


def _rows(raw: bytes | pa.Buffer, many: int) -> np.ndarray:
    x = np.frombuffer(raw, dtype="<f8").reshape(many, -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _units(raw: list[bytes]) -> np.ndarray:
    return _rows(b"".join(raw), len(raw))


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Stored (vec_id, raw, k1, k2, dim): the components as little-endian doubles and two hashes of them; raw null for a vector that links with nothing."""
    v = F.col(vec_col).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for x in batch.column(1):
                a = np.asarray(x.values.to_numpy(zero_copy_only=False) if x.is_valid and not x.values.null_count else [], dtype="<f8")
                big = np.abs(a).max(initial=0)
                fine = len(a) and np.isfinite(big) and big > 0
                raw.append((np.where(a == 0, 0.0, a / big) if not 1e-100 < big < 1e100 else a + 0.0).tobytes() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    ship_package(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).mapInArrow(run, "vec_id long, raw binary")
    rows = rows.withColumn("raw", F.when(F.col("vec_id").isNotNull(), F.col("raw")))
    return store(rows.select("vec_id", "raw", F.xxhash64("raw").alias("k1"), F.xxhash64("raw", F.lit(7)).alias("k2"), (F.octet_length("raw") / 8).cast("int").alias("dim")))


def axes(distinct: DataFrame, dim: int, many: int) -> np.ndarray:
    """The `many` leading principal axes (columns). Each task adds its vectors' products up; dim * dim sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _units([r.as_py() for r in batch.column(0)]) if batch.num_rows else np.zeros((0, dim))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["i", "s"])

    sums = np.zeros(dim * dim)
    for r in distinct.select("raw").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r["i"]] = r["s"]
    return np.linalg.eigh(sums.reshape(dim, dim))[1][:, ::-1][:, :many].copy()


def intervals(distinct: DataFrame, dim: int, basis: np.ndarray, eps: float, size: int) -> DataFrame:
    """Stored intervals of the grid order: block, rep ids, counts, vectors, and the box of each on the axes (the last being what lies off them).

    Sorted rows are numbered through, and each `size` of them are an interval, however many partitions they lie in.
    """
    many = basis.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _units([r.as_py() for r in batch.column(2)]) @ basis if batch.num_rows else np.zeros((0, many))
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(list(cells), pa.list_(pa.int32()))], ["rep", "copies", "raw", "cells"])

    def box(table: pa.Table) -> pa.Table:
        ids, copies = (table.column(c).to_numpy() for c in ("rep", "copies"))
        raw = table.column("raw").to_pylist()
        p = _framed(_units(raw), basis)
        row = [[int(table.column("block")[0].as_py())], [ids.astype("<i8").tobytes()], [copies.astype("<i8").tobytes()], [b"".join(raw)], [p.min(axis=0)], [p.max(axis=0)], [int(np.floor(p[:, 0].min() / eps))], [int(np.floor(p[:, 0].max() / eps))]]
        kinds = [pa.int64()] + [pa.binary()] * 3 + [pa.list_(pa.float64())] * 2 + [pa.int32()] * 2
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("block", "ids", "copies", "raw", "low", "high", "from", "to"), row, kinds, strict=True)})

    placed = store(distinct.select("rep", "copies", "raw").mapInArrow(place, "rep long, copies long, raw binary, cells array<int>"))
    order = [F.get("cells", i) for i in range(many)] + [F.col("rep")]
    ranges = max(1, -(-distinct.count() // (4 * size)))
    ordered = store(placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("rep", "copies", "raw", F.monotonically_increasing_id().alias("at")))
    drop(placed)
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ranked = ordered.withColumn("part", part).join(starts, "part").select("rep", "copies", "raw", F.floor((row + F.col("start")) / size).alias("block"))
    return store(ranked.groupBy("block").applyInArrow(box, "block long, ids binary, copies binary, raw binary, low array<double>, high array<double>, `from` int, `to` int"))


def _framed(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors on the axes, and the length of what lies off them."""
    p = u @ basis
    return np.concatenate((p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))[:, None]), axis=1)


def join_intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, eps: float, threshold: float, same: bool = False, leaf: int = 512) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Slices of the unit vectors x and y and which of their pairs reach the threshold, where any do; recursively, skipping intervals whose boxes lie further apart than eps.

    Products in single precision rule pairs out; what comes within their error of the threshold is compared in double
    precision. `same`: x and y are one interval, of which each pair is met once, and no vector with itself.
    """
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    least = threshold - 1e-6 - 2.0 * x.shape[1] * float(np.finfo(np.float32).eps)

    def go(a: slice, b: slice) -> Iterator[tuple[slice, slice, np.ndarray]]:
        if same and b.start < a.start:
            return
        gap = np.maximum(0, np.maximum(py[b].min(axis=0) - px[a].max(axis=0), px[a].min(axis=0) - py[b].max(axis=0)))
        if (gap * gap).sum() > eps * eps * (1 + 1e-9):
            return
        n, m = a.stop - a.start, b.stop - b.start
        if n <= leaf and m <= leaf:
            near = x32[a] @ y32[b].T >= least
            if same and a.start == b.start:
                near &= np.tri(n, k=-1, dtype=bool).T
            i, j = np.nonzero(near)
            if 8 * len(i) > near.size:
                near &= x[a] @ y[b].T >= threshold
            else:
                near[i, j] = np.einsum("ij,ij->i", x[a][i], y[b][j]) >= threshold
            if near.any():
                yield a, b, near
            return
        for s in (a,) if n <= leaf else (slice(a.start, a.start + n // 2), slice(a.start + n // 2, a.stop)):
            for t in (b,) if m <= leaf else (slice(b.start, b.start + m // 2), slice(b.start + m // 2, b.stop)):
                yield from go(s, t)

    yield from go(slice(0, len(x)), slice(0, len(y)))


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked vector's label and the smallest label that links reach from it within this matrix."""
    i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    part, a, b = linked[np.ix_(i, j)], left[i], right[j]
    la, lb, top = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(part, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(part, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            return np.concatenate((a, b)), np.concatenate((na, nb))
        la, lb = na, nb


def _matched(pairs: DataFrame, basis: np.ndarray, eps: float, threshold: float) -> DataFrame:
    """(id, links, root) rows of each pair of intervals: copies linked to id, and a smaller or equal id reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, ids_a, n_a, raw_a, ids_b, n_b, raw_b = (batch.column(c)[k] for c in range(7))
                ids_a, n_a, ids_b, n_b = (np.frombuffer(v.as_buffer(), "<i8") for v in (ids_a, n_a, ids_b, n_b))
                x, y = _rows(raw_a.as_buffer(), len(ids_a)), _rows(raw_b.as_buffer(), len(ids_b))
                links_a, links_b = np.zeros(len(x)), np.zeros(len(y))
                low, high = [], []
                for a, b, linked in join_intervals(x, y, _framed(x, basis), _framed(y, basis), eps, threshold, same.as_py()):
                    dense = linked.astype(np.float64)
                    links_a[a] += dense @ n_b[b]
                    links_b[b] += n_a[a] @ dense
                    node, least = _forest(linked, ids_a[a], ids_b[b])
                    low.append(least[node != least]), high.append(node[node != least])
                if not low:
                    continue
                if same.as_py():
                    ids, counts = ids_a, links_a + links_b
                else:
                    ids, counts = np.concatenate((ids_a, ids_b)), np.concatenate((links_a, links_b))
                hit = np.flatnonzero(counts)
                hit = hit[np.argsort(ids[hit])]
                ids, counts = ids[hit], counts[hit].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(_settle(ids, np.concatenate(high), np.concatenate(low)))], ["id", "links", "root"])

    return pairs.mapInArrow(run, "id long, links long, root long")


def _settle(ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest id that edges reach from each of the sorted ids."""
    u, v = np.searchsorted(ids, high), np.searchsorted(ids, low)
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[u], label[v])
        now = label.copy()
        np.minimum.at(now, u, least)
        np.minimum.at(now, v, least)
        now = now[now]
        if (now == label).all():
            return ids[label]
        label = now


def near_duplicates(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", many_axes: int = 8, size: int = 8192, most_bytes: int = 1 << 24) -> DataFrame:
    """vec_id, n_links, component_id, kept for all vectors: linked where their cosine is `threshold` or more, in double precision.

    n_links counts the other vectors linked directly, copies included; component_id is the smallest vec_id
    that links reach, itself included. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do rows with a null vec_id; vectors of different lengths don't link. Rows
    that repeat a vec_id are vectors of their own with one name. An empty table gives no rows; other columns are not read. Intervals
    hold `size` vectors, fewer where these have more than `most_bytes`; which of them meet is found by joining on the cells of the first axis.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = vectors(table, id_col, vec_col)
    distinct = store(rows.where("raw is not null").groupBy("k1", "k2", "dim", "raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    found = None
    for dim in sorted(r["dim"] for r in distinct.select("dim").distinct().collect()):  # a few lengths of vectors
        own = distinct.where(F.col("dim") == dim)
        basis = axes(own, dim, min(many_axes, dim))
        blocks = intervals(own, dim, basis, eps, max(1, min(size, most_bytes // (8 * dim))))
        boxes = blocks.select("block", "low", "high", F.explode(F.sequence(F.col("from"), F.col("to") + 1)).alias("cell"))
        far = F.aggregate(F.arrays_zip("low", "high", "low_b", "high_b"), F.lit(0.0), lambda acc, z: acc + F.pow(F.greatest(F.lit(0.0), z["low_b"] - z["high"], z["low"] - z["high_b"]), 2))
        other = boxes.select(F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), "cell")
        pairs = boxes.join(other, "cell").where((F.col("block") <= F.col("block_b")) & (far <= eps * eps * (1 + 1e-9))).select("block", "block_b").distinct()
        left = blocks.select("block", F.col("ids").alias("ia"), F.col("copies").alias("na"), F.col("raw").alias("ra"))
        right = blocks.select(F.col("block").alias("block_b"), F.col("ids").alias("ib"), F.col("copies").alias("nb"), F.col("raw").alias("rb"))
        met = store(pairs).join(left, "block").join(right, "block_b")
        each = _matched(met.select((F.col("block") == F.col("block_b")).alias("same"), "ia", "na", "ra", "ib", "nb", "rb"), basis, eps, threshold)
        found = each if found is None else found.union(each)
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return plain
    found = store(found)
    roots = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = distinct.join(links, distinct["rep"] == links["id"], "left").join(roots, distinct["rep"] == roots["node"], "left")
    answer = store(known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    drop(found)
    valid = rows.select("vec_id", F.when(F.col("raw").isNotNull(), F.col("k1")).alias("k1"), F.when(F.col("raw").isNotNull(), F.col("k2")).alias("k2"))
    out = valid.join(answer, ["k1", "k2"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", (F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))).alias("kept"))
