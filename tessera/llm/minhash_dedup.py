"""MinHash near-dedup by an LSH forest.

Texts become sets of five-word shingles and MinHash signatures of 64 slots. Texts with
equal sets are one node (a class), however many copies there are. The forest is 16 orders of the
signatures, each beginning at another slot. In each order, sorted as a whole over all
executors, a node's candidates are its neighbours whose longest common prefix is two slots or more: where
nodes are sparse a prefix of two slots suffices, where they are dense the
neighbours are those that agree much deeper. Candidates are confirmed on the full shingle sets.

What shares two slots in an order is a region. Regions that the neighbourhood does not cover and
that hold several components after that are compared on the full sets, the nodes outside the region's largest component
with all others, and no number of partners is capped: small regions pair by pair, larger ones in
blocks of bounded size. Regions of more than LARGE_REGION nodes are taken apart first, by fresh orders of slots
that nothing else uses, deeper ones for larger regions, and of each depth so many that a pair at
similarity 0.75 parts in all of them with a chance below MISS.

Null and empty texts have no shingles and are linked with nothing. Rows that repeat
a ``doc_id`` stay, each with the component of its own text. A row without a doc_id is linked
with nothing. Other columns of the input pass through `deduplicated` unchanged, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import dropped, free, joined_side, written
from tessera.llm.textops import U64, UNSPACED, Words, mixed, pieces

SHINGLE = 5
SLOTS = 64
TREES = 16
STRIDE = SLOTS // TREES
DEPTH = 12
LEAST_DEPTH = 2
NEIGHBOURS = 3
#: Regions of so many nodes are compared pair by pair, larger ones in blocks.
SMALL_REGION = 32
#: Nodes and shingles of one side of a block, about.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1 << 20
#: Regions of more nodes are dealt anew by fresh slots.
LARGE_REGION = 8192
#: (nodes of the region at most, slots of a fresh order).
FRESH_DEPTHS = ((1 << 16, 6), (1 << 20, 10), (None, 14))
MISS = 1e-5

_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 1 << 63, SLOTS, dtype=np.int64).astype(U64)
_MUL = _rng.integers(0, 1 << 63, SLOTS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_PLACE = mixed(np.arange(SHINGLE, dtype=U64) + U64(31)) | U64(1)


def shingle_sets(column: pa.Array, words: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for row, end, data, offsets in pieces(column):
        w = Words(data, offsets, UNSPACED)
        place = _PLACE if words == SHINGLE else mixed(np.arange(words, dtype=U64) + U64(31)) | U64(1)
        n = len(w.hash)
        with np.errstate(over="ignore"):
            if n >= words:
                rolled = w.hash[: n - words + 1] * place[0]
                for k in range(1, words):
                    rolled = rolled + w.hash[k : n - words + 1 + k] * place[k]
                rolled = mixed(rolled)
            for i in range(end - row):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if b - a >= words:
                    s = np.sort(rolled[a : b - words + 1])
                    keep = np.empty(len(s), dtype=bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    yield s[keep]
                elif b > a:
                    yield mixed(np.array([(w.hash[a:b] * place[: b - a]).sum() + U64(b - a)], dtype=U64), 7)
                else:
                    yield np.empty(0, dtype=U64)


def signature(shingles: np.ndarray, xor: np.ndarray = _XOR, mul: np.ndarray = _MUL) -> np.ndarray:
    least = np.full(len(xor), ~U64(0), dtype=U64)
    with np.errstate(over="ignore"):
        step = max(64, (1 << 18) // len(xor))
        for at in range(0, len(shingles), step):
            block = (shingles[None, at : at + step] ^ xor[:, None]) * mul[:, None]
            np.minimum(least, block.min(axis=1), out=least)
    return (least >> U64(32)).astype(np.uint32).view(np.int32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, f1, f2, sig = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            with np.errstate(over="ignore"):
                f1.append(int(mixed(s, 1).sum().view(np.int64)) if len(s) else 0)
                f2.append(int(mixed(s, 2).sum().view(np.int64)) if len(s) else 0)
            sig.append(signature(s) if len(s) else np.zeros(SLOTS, np.int32))
        flat = pa.array(np.concatenate(sig) if sig else np.empty(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SLOTS), flat)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists],
            names=["doc_id", "h", "n_shingles", "f1", "f2", "sig"],
        )


SIGNED = "doc_id long, h long, n_shingles long, f1 long, f2 long, sig array<int>"


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and h, by which texts of one doc_id are told apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_shingles, f1 and f2 (128 bits of the shingle set) and sig."""
    return _rows(docs).mapInArrow(_signed, SIGNED)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near rows of a sorted partition; its first and last rows too, for the seams (b is null there)."""
    names = ["a", "b", "lcp", "tree", "node", "n", "key"]
    tail = None
    first = True

    def seam(rows: pa.Table) -> pa.RecordBatch:
        k = rows.num_rows
        none = pa.nulls(k, pa.int64())
        cols = [none, none, pa.nulls(k, pa.int32()), rows.column("tree"), rows.column("node"), rows.column("n"), rows.column("key")]
        return pa.table(cols, names=names).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).select(["tree", "node", "n", "key"])
        if first:
            yield seam(rows.slice(0, NEIGHBOURS))
            first = False
        if tail is not None:
            rows = pa.concat_tables([tail, rows]).combine_chunks()
        fresh = tail.num_rows if tail is not None else 0
        tree = rows.column("tree").to_numpy()
        node = rows.column("node").to_numpy()
        n = rows.column("n").to_numpy()
        key = rows.column("key").combine_chunks()
        key = (key.chunk(0) if isinstance(key, pa.ChunkedArray) else key).flatten().to_numpy().reshape(-1, DEPTH)
        for step in range(1, NEIGHBOURS + 1):
            if len(node) <= step:
                break
            i = np.arange(max(0, fresh - step), len(node) - step)
            j = i + step
            lcp = (np.cumprod(key[i] == key[j], axis=1)).sum(axis=1)
            ok = (tree[i] == tree[j]) & (lcp >= LEAST_DEPTH) & (node[i] != node[j])
            ok &= 100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j])
            i, j, lcp = i[ok], j[ok], lcp[ok]
            if len(i):
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                k = len(a)
                keys = pa.nulls(k, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(lcp.astype(np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), keys], names=names)
        tail = rows.slice(max(0, rows.num_rows - NEIGHBOURS))
    if tail is not None:
        yield seam(tail)


NEAR = "a long, b long, lcp int, tree int, node long, n long, key array<int>"


def forest(classes: DataFrame) -> DataFrame:
    """(tree, key, node, n): a row for each class and order; key holds the order's first slots."""
    rows = classes.where("n > 0").select("node", "n", F.concat("sig", F.slice("sig", 1, DEPTH)).alias("sig"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    return rows.select("tree", F.slice("sig", F.col("tree") * STRIDE + 1, F.lit(DEPTH)).alias("key"), "node", "n")


def candidates(orders: DataFrame) -> DataFrame:
    """(a, b, weight): neighbours in any order, a < b; weight adds up the common prefixes."""
    by = ["tree", "key", "node"]
    found = written(orders.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_neighbours, NEAR), "near")
    seams = found.where("b is null").select("tree", "key", "node", "n")  # a few rows of each partition
    seams = seams.coalesce(1).sortWithinPartitions(*by).mapInArrow(_neighbours, NEAR)
    pairs = found.where("b is not null").select("a", "b", "lcp").unionByName(seams.where("b is not null").select("a", "b", "lcp"))
    return written(pairs.groupBy("a", "b").agg(F.sum("lcp").alias("weight")), "pairs")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [
            100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= 75 * (len(x) + len(y) - both)
            for x, y in zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")), strict=True)
        ]
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) whose whole shingle sets are alike enough."""
    text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.select("a", "b").join(text("a"), "a").join(text("b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes that ``links`` (a, b) names; component is the least node.

    Stars alternate until nothing changes: every node's larger neighbours are hung
    on its least one, then all its neighbours are. Each step is a minimum by
    key and a join.
    """
    star = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star")
    sums = None
    while True:
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = written(hung.select("e.u", "e.v").where("u != v").distinct(), "star")
        dropped(star)
        star, old = small, sums
        sums = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "u"))).first()
        if sums == old:
            break
    roots = star.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of the pairs whose ends are not yet in one component."""
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"comp_{c}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return out.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).drop("comp_a", "comp_b")


def _best(pairs: DataFrame) -> DataFrame:
    """The heaviest pair of each node."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "weight")
    top = ends.groupBy("node").agg(F.max(F.struct("weight", "a", "b")).alias("x"))
    return top.select("x.a", "x.b").distinct()


def _pairs_of(comp: DataFrame) -> DataFrame:
    """Components as links, for more to come."""
    return comp.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))


REGION = ["tree", "prefix"]


def _mixed(rows: DataFrame, comp: DataFrame, least: int) -> DataFrame:
    """The rows (tree, prefix, node, n) of regions of more than ``least`` nodes in several components.

    Added are the node's component, the region's largest one (main), and the nodes and shingles of the region and outside main.
    """
    rows = rows.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy(*REGION, "component").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("own_n"))
    sizes = parts.groupBy(*REGION).agg(F.max(F.struct("own", "own_n", "component")).alias("main"), F.sum("own").alias("size"), F.sum("own_n").alias("size_n"))
    sizes = sizes.where((F.col("size") > least) & (F.col("size") > F.col("main.own")))
    sizes = sizes.select(*REGION, F.col("main.component").alias("main"), "size", "size_n", (F.col("size") - F.col("main.own")).alias("rest"), (F.col("size_n") - F.col("main.own_n")).alias("rest_n"))
    return written(rows.select(*REGION, "node", "n", "component").join(sizes, REGION), "dense")


def _pairs_within(rows: DataFrame) -> DataFrame:
    """(a, b): the pairs across components in each region."""
    one = rows.where("component != main").select(*REGION, F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"))
    two = rows.select(*REGION, F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), (F.col("component") == F.col("main")).alias("first"))
    pairs = one.join(two, REGION).where("cx != cy and (first or x < y) and 100 * least(nx, ny) >= 75 * greatest(nx, ny)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def fresh_orders(depth: int) -> int:
    """How many orders of so many slots let a pair at similarity 0.75 part in all of them with a chance below MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - 0.75**depth))


def _fresh(depth: int):
    """The regions of fresh orders: rows (tree, prefix, node, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fresh_orders(depth)
        xor, mul = mixed(np.arange(k * depth, dtype=U64), depth), mixed(np.arange(k * depth, dtype=U64), 100 + depth) | U64(1)
        place, tree = mixed(np.arange(depth, dtype=U64)), np.arange(k, dtype=np.int32) + 10_000 * depth
        for batch in batches:
            for node, s in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                slots = signature(s, xor, mul).reshape(k, depth).astype(np.int64)
                with np.errstate(over="ignore"):
                    prefix = mixed((slots.view(U64) * place).sum(axis=1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(prefix), pa.array(np.full(k, node)), pa.array(np.full(k, len(s)))], names=["tree", "prefix", "node", "n"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "set"])


def _compared(rows: pa.Table) -> pa.Table:
    """The links between the nodes of either side of a block that are in unlike components."""
    side, node, component = (rows.column(c).to_numpy() for c in ("side", "node", "component"))
    node, first, index = np.unique(node, return_index=True, return_inverse=True)
    component = component[first]
    x, y = index[side == 1], index[side == 0]
    binary = rows.column("set").take(pa.array(first)).to_pylist()
    sets = [np.frombuffer(s, dtype=U64) for s in binary]
    n = np.array([len(s) for s in sets])
    _, ids, copies = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = copies > 1  # what one node alone has is in no intersection
    width = int(shared.sum())
    keep = shared[ids]
    column, row = (np.cumsum(shared) - 1)[ids[keep]], np.repeat(np.arange(len(sets)), n)[keep]
    sort = np.argsort(column, kind="stable")
    column, row = column[sort], row[sort]
    both = np.zeros((len(x), len(y)), dtype=np.float32)  # whole numbers below 2^24
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        has = np.zeros((len(sets), min(4096, width - at)), dtype=np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        both += has[x] @ has[y].T
    both = both.astype(np.int64)
    ok = (100 * both >= 75 * (n[x][:, None] + n[y] - both)) & (component[x][:, None] != component[y])
    i, j = np.nonzero(ok)
    a, b = node[x[i]], node[y[j]]
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _links_within(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the confirmed links across components in each region, the nodes outside its largest component against all, in blocks."""
    blocks = lambda nodes, shingles: F.ceil(F.greatest(F.col(nodes) / BLOCK_NODES, F.col(shingles) / BLOCK_SHINGLES)).cast("int")
    rows = rows.select(*REGION, "node", "component", "main", blocks("rest", "rest_n").alias("k1"), blocks("size", "size_n").alias("k2"))
    block = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    one = rows.where("component != main").select(*REGION, "node", "component", F.lit(1).alias("side"), block("k1").alias("i"), every("k2").alias("j"))
    two = rows.select(*REGION, "node", "component", F.lit(0).alias("side"), every("k1").alias("i"), block("k2").alias("j"))
    dealt = one.unionByName(two).join(texts.mapInArrow(_sets, "node long, set binary"), "node")
    return dealt.groupBy(*REGION, "i", "j").applyInArrow(_compared, "a long, b long").distinct()


def dense_links(docs: DataFrame, classes: DataFrame, orders: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b): the links across components in the regions that hold more nodes than a neighbourhood."""
    dense = _mixed(orders.select("tree", F.xxhash64(F.slice("key", 1, LEAST_DEPTH)).alias("prefix"), "node", "n"), comp, NEIGHBOURS + 1)
    groups, least = [dense.where(F.col("size") <= LARGE_REGION)], LARGE_REGION
    for most, depth in FRESH_DEPTHS:
        large = dense.where((F.col("size") > least) & (F.lit(most is None) | (F.col("size") <= (most or 0))))
        least = most or least
        if not large.isEmpty():
            again = written(_texts(docs, classes, large.select("node")).mapInArrow(_fresh(depth), "tree int, prefix long, node long, n long"), "fresh")
            groups.append(_mixed(again, comp, 1))
    every = reduce(DataFrame.unionByName, groups)
    pairs = written(_pairs_within(every.where(F.col("size") <= SMALL_REGION)), "rest")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    broad = every.where(F.col("size") > SMALL_REGION)
    texts = _texts(docs, classes, ends.unionByName(broad.select("node")))
    found = confirmed(pairs, texts)
    if not broad.isEmpty():
        found = found.unionByName(_links_within(broad, texts))
    return written(found, "links")


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of some nodes; of several texts of one node, which have the same shingles, one."""
    named = written(classes.select("node", "at.doc_id", "at.h").join(nodes.distinct(), "node", "left_semi"), "named")
    rows = _rows(docs).where("text is not null and doc_id is not null")
    return written(rows.join(joined_side(named, named.count()), ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"]), "texts")


HAS = "n_shingles > 0 and doc_id is not null"
SET = ["n_shingles", "f1", "f2"]


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept for each row of ``docs``."""
    signed = written(signatures(docs), "signed")
    # a class is named by a number of its own: several texts may have one doc_id
    classes = signed.where(HAS).groupBy(*SET).agg(F.min(F.struct("doc_id", "h")).alias("at"), F.first("sig").alias("sig"))
    classes = written(classes.withColumnRenamed("n_shingles", "n").withColumn("node", F.monotonically_increasing_id()), "classes")
    orders = written(forest(classes), "orders")
    pairs = candidates(orders)
    texts = _texts(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    # the heaviest pair of each node first; most of the others fall away as their ends get together
    best = written(_best(pairs), "best")
    comp = written(components(written(confirmed(best, texts), "links")), "comp")
    links = written(confirmed(_across(pairs.join(best, ["a", "b"], "left_anti"), comp), texts), "links")
    for more in (lambda: links, lambda: dense_links(docs, classes, orders, comp)):
        found = more()
        if not found.isEmpty():
            comp = written(components(found.unionByName(_pairs_of(comp))), "comp")
    # the least doc_id of each component that has several classes
    least = comp.join(classes.select("node", "at.doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = classes.select(F.col("n").alias("n_shingles"), "f1", "f2", "node", "at.doc_id").join(comp.join(least, "component").select("node", "least"), "node", "left")
    named = named.select(*SET, F.coalesce("least", "doc_id").alias("component"))
    out = signed.drop("sig").join(named, SET, "left")
    component = F.when(F.expr(HAS), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id that can be reached over links, kept whether that is the row's own.
    """
    return _judged(docs).drop("h")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a document of a lesser id.

    Of rows that repeat both doc_id and text all stay; rows of one doc_id with unlike texts are judged each for itself.
    """
    id_, h = free(docs, "id", "h")
    gone = _judged(docs).where("not kept").select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h)), "left_anti")
