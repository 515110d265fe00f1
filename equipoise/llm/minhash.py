"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, components by stars.

A document's vertex is the 64-bit fingerprint of its shingle set, so exact copies are one vertex from
the start. In each bucket of a band every member is compared with one hub, the one that shares most buckets
with others, then with one of another component; both are linear in the bucket, and buckets whose members
are all connected are done. Members of what is left are gathered into clusters of buckets that overlap,
and a cluster is compared by blocks of bounded size with whole sets: a pair of blocks counts the shingles
that its sets share by matrix products and puts out a spanning forest of confirmed links, never its pairs. So no
candidate pair goes without a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import drop, mix, shingles, store
from .stars import components


def multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(keys: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    """For each universal hash (a * key + b, high half) the minimum over the keys; memory is bounded by `block` keys at a time."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(keys), block):
            np.minimum(low, (keys[i : i + block, None] * a[None, :] + b[None, :]).min(axis=0), out=low)
    return low >> np.uint64(32)


def fingerprint(keys: np.ndarray) -> int:
    """Of a sorted set of shingle hashes, as a signed long."""
    with np.errstate(over="ignore"):
        total = mix(keys).sum(dtype=np.uint64) + mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return int(mix(np.asarray([total ^ np.uint64(len(keys))])).astype(np.int64)[0])


def sketch(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, node (fingerprint), bands (a hash for each band, its number within), signature (16 bits of each minimum)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(bands * rows, seed)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, node, buckets, signs = [], [], [], []
            for text in batch.column(1):
                keys = shingles(text.as_py(), width)
                n.append(len(keys))
                if not len(keys):
                    node.append(None), buckets.append(None), signs.append(None)
                    continue
                low = minima(keys, a, b)
                node.append(fingerprint(keys))
                with np.errstate(over="ignore"):
                    at = salt.copy()
                    for r in low.reshape(bands, rows).T:
                        at = mix(at * np.uint64(0x9E3779B97F4A7C15) + r)
                buckets.append(at.astype(np.int64))
                signs.append(low.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(signs, pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "bands", "signature"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, bands array<long>, signature binary")


def _estimated(pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs with signatures sa and sb those whose share of equal minima is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(np.mean(np.frombuffer(x.as_py(), "<u2") == np.frombuffer(y.as_py(), "<u2")) >= least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, set): the whole shingle set of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(0)]
            found = [k for k in found if len(k)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(k) for k in found], pa.int64()), pa.array([k.tobytes() for k in found], pa.binary())], ["node", "set"])

    return docs.select("text").mapInArrow(run, "node long, set binary")


def _confirmed(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs with whole sets ka and kb those with den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, None
            for ka, kb in zip(batch.column(2), batch.column(3), strict=True):
                raw = ka.as_buffer().to_pybytes()
                if raw != last:
                    last, x = raw, np.frombuffer(raw, np.uint64)
                y = np.frombuffer(kb.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many keys each set of x shares with each of y; by products of `columns` keys at a time, so memory is bounded."""
    row = [np.repeat(np.arange(len(s)), [len(k) for k in s]) for s in (x, y)]
    key = [np.concatenate(s) if s else np.empty(0, np.uint64) for s in (x, y)]
    known = np.intersect1d(np.unique(key[0]), np.unique(key[1]), assume_unique=True)
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    if not len(known):
        return out
    at = []
    for r, k in zip(row, key, strict=True):
        spot = np.minimum(np.searchsorted(known, k), len(known) - 1)
        hit = np.flatnonzero(known[spot] == k)
        hit = hit[np.argsort(spot[hit], kind="stable")]
        at.append((r[hit], spot[hit]))
    for low in range(0, len(known), columns):
        part = []
        for (r, spot), many in zip(at, (len(x), len(y)), strict=True):
            a, b = np.searchsorted(spot, (low, low + columns))
            dense = np.zeros((many, min(columns, len(known) - low)), dtype=np.float32)
            dense[r[a:b], spot[a:b] - low] = 1
            part.append(dense)
        out += np.rint(part[0] @ part[1].T).astype(np.int64)
    return out


def _compare(num: int, den: int):  # noqa: ANN202
    """For one pair of blocks (rows node, root, side, set): links that connect different roots, as a forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("set")]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) else left
        both = shared_counts([sets[i] for i in left], [sets[i] for i in right])
        size = np.asarray([len(s) for s in sets])
        linked = (den * both >= num * (size[left][:, None] + size[right][None, :] - both)) & (root[left][:, None] != root[right][None, :])
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while r in above:
                r = above[r]
            return r

        out = []
        for i, j in np.argwhere(linked):
            a, b = top(int(root[left[i]])), top(int(root[right[j]]))
            if a != b:
                above[max(a, b)] = min(a, b)
                out.append((int(node[left[i]]), int(node[right[j]])))
        cols = list(zip(*out, strict=True)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def clusters(members: DataFrame, spreads: int = 2) -> DataFrame:
    """Stored (kind, part, node, root): parts such that any two members of a bucket lie in one of them.

    A node goes to the largest of its buckets, then to the largest that any of its fellows has gone to, and
    so on `spreads` times; buckets that still aren't within one cluster are parts of their own. members: (bucket, node, root).
    """
    sizes = store(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")))
    label = store(members.join(sizes, "bucket").groupBy("node").agg(F.max(F.struct("size", "bucket")).alias("label")))
    for _ in range(spreads):
        best = store(members.join(label, "node").groupBy("bucket").agg(F.max("label").alias("label")))
        drop(label)
        label = store(members.join(best, "bucket").groupBy("node").agg(F.max("label").alias("label")))
        drop(best)
    met = members.join(label, "node")
    split = store(met.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket"))
    whole = met.groupBy(F.lit(0).alias("kind"), F.col("label.bucket").alias("part"), "node").agg(F.min("root").alias("root"))
    out = store(whole.union(members.join(split, "bucket").select(F.lit(1).alias("kind"), F.col("bucket").alias("part"), "node", "root")))
    drop(sizes), drop(label), drop(split)
    return out


def _block_links(parts: DataFrame, sets: DataFrame, num: int, den: int, rows: int, keys: int) -> DataFrame:
    """(a, b): links between members of different roots in each part, by pairs of blocks of about `rows` sets and `keys` shingles at most."""
    parts = parts.join(sets.select("node", F.octet_length("set").alias("bytes")), "node")
    sizes = parts.groupBy("kind", "part").agg(F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum("bytes") / 8 / keys)).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = store(sizes.where("low != high").select("kind", "part", "blocks"))
    named = parts.select("kind", "part", "node", "root").join(sizes, ["kind", "part"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("kind", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", (F.col("own") > F.col("other")).cast("int").alias("side"))
    return dealt.join(sets, "node").groupBy("kind", "part", "i", "j").applyInArrow(_compare(num, den), "a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, bands: int = 48, rows: int = 5, seed: int = 11, margin: float = 0.16,
    hub_rounds: int = 2, block_rows: int = 256, block_keys: int = 500_000, with_text_key: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for all documents: linked where den * intersection >= num * union of their shingle sets.

    A set is the distinct `width`-word shingles of the whole text, A-Z lowered; with fewer words the
    whole sequence; none for a null text or one without words, which is linked with nothing. A pair at the
    threshold misses all bands with a chance of (1 - 0.75 ** 5) ** 48 = 2e-6. Comparisons with hubs look at signatures first, which let
    pass what they estimate up to `margin` (some five standard errors) below the threshold (a margin of `num / den` lets all pass); what hubs leave open is compared by whole sets alone.
    component_id: the smallest doc_id reachable. Rows with a null doc_id stay alone (component_id null, kept true); rows
    that repeat a doc_id are rows of their own, linked by their texts alone; `with_text_key` adds xxhash64 of the text, by which they can be told apart. An empty table gives no rows; other columns are not read.
    """
    seen = store(sketch(docs, width, bands, rows, seed))
    named = seen.where("node is not null and doc_id is not null")
    nodes = store(named.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n")))
    spread = named.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("n"))
    shared = store(spread.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low < top").select("bucket"))
    found = store(spread.join(shared, "bucket").select("bucket", "node", "n").distinct())
    sizes = store(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")))
    weight = store(found.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight")))
    members = store(found.join(weight, "node").select("bucket", "node", "n", "weight"))
    for x in (shared, found, sizes, weight):
        drop(x)
    likely = F.least("n", "m") * den >= F.greatest("n", "m") * num
    texts = docs.select(F.col("doc_id").cast("long").alias("first"), F.col("text").cast("string").alias("text"))
    place = lambda x: nodes.join(x, "node").select("node", "first")

    def whole_sets(need: DataFrame) -> DataFrame:
        """Stored (node, set) of the stored (node, first)."""
        found = _sets(texts.join(need.select("first").distinct(), "first", "left_semi"), width)
        return store(found.join(need.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    def test(pairs: DataFrame) -> DataFrame:
        """Stored links among the pairs (a, b)."""
        pairs = store(pairs.distinct())
        need = place(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        signs = store(seen.select(F.col("doc_id").alias("first"), "node", "signature").join(need, ["first", "node"], "left_semi").select("node", "signature").dropDuplicates(["node"]))
        with_a = pairs.join(signs.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
        passed = store(_estimated(with_a.join(signs.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b"), num / den - margin))
        drop(pairs), drop(signs)
        need = store(place(passed.select(F.col("a").alias("node")).union(passed.select(F.col("b").alias("node"))).distinct()))
        whole = whole_sets(need)
        with_b = passed.join(whole.select(F.col("node").alias("b"), F.col("set").alias("kb")), "b")
        links = store(_confirmed(with_b.join(whole.select(F.col("node").alias("a"), F.col("set").alias("ka")), "a"), num, den))
        drop(passed), drop(need), drop(whole)
        return links

    links = roots = None
    for turn in range(hub_rounds + 1):
        root = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = store(root.select("bucket", "node", "n", "weight", "root"))
        # the member that shares most with others is the likely centre; then that of another component, then any
        order = [F.xxhash64("node", F.lit(turn)).alias("o")] if turn > 1 else []
        best = F.max(F.struct(*order, "weight", F.col("node").alias("hub"), F.col("n").alias("m"), F.col("root").alias("hub_root")))
        divided = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), best.alias("c")).where("low < high").select("bucket", "c.hub", "c.m", "c.hub_root")
        divided = store(divided)
        if divided.isEmpty():
            break
        if turn < hub_rounds:
            if turn == 1:
                away = placed.join(divided.select("bucket", "hub_root"), "bucket").where("root != hub_root").drop("hub_root")
                divided = store(away.groupBy("bucket").agg(best.alias("c")).select("bucket", "c.hub", "c.m", "c.hub_root"))
            more = test(placed.join(divided, "bucket").where("root != hub_root").where(likely).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")))
        else:
            left = store(placed.join(divided.select("bucket"), "bucket", "left_semi").select("bucket", "node", "root"))
            whole = whole_sets(store(place(left.select("node").distinct())))
            more = store(_block_links(clusters(left), whole, num, den, block_rows, block_keys))
            drop(left), drop(whole)
        drop(placed), drop(divided)
        links = more if links is None else store(links.union(more))
        roots = components(links)
    linked = nodes.withColumn("root", F.lit(None).cast("long")) if roots is None else nodes.join(roots, "node", "left")
    named_nodes = linked.select("node", "first", F.coalesce("root", "node").alias("root"))
    firsts = store(named_nodes.groupBy("root").agg(F.min("first").alias("component_id")))
    answer = store(named_nodes.join(firsts, "root").select("node", "component_id"))
    alone = F.when(F.col("node").isNull() | F.col("doc_id").isNull(), F.col("doc_id"))
    rows_ = seen.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = rows_.join(answer, "node", "left").withColumn("component_id", F.coalesce(alone, "component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"), *["text_key"] * with_text_key)
