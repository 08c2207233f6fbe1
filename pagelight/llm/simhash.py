"""SimHash near-duplicates through Gray-order hierarchical indexes.

Fingerprints: every whole text is lower-cased (A-Z), cut into words at ASCII white space, and each
shingle of consecutive words votes with its XXH64 (seed 42) on 64 bits.

Links: equal fingerprints are one node, named by its smallest doc_id. Nodes within ``max_bits`` bits
must agree in some block of bits, so they are dealt by masked bit patterns (the upper nodes of the
index). Each bucket is sorted by Gray rank, and runs of neighbours are factored, level by level, into
nodes that hold the bits their members share. A search adds up the differences on the bits that each
level adds and drops a whole subtree once they exceed the bound. A bucket above ``max_bucket`` nodes
is dealt again by blocks of its free bits, which finds the same links, so no hot pattern stays in one
task. A task returns a spanning forest of its links, not all pairs, and the forests meet in
large-star/small-star rounds.

Defined results: a null or empty text has fingerprint zero, linked like any other; equal rows share a
component; rows with a null doc_id take the component of their fingerprint, or null if no row with an
id shares it; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import forget, fresh, written

FAN = 8
MAX_BUCKET = 4096
#: Query-member pairs that a task looks at in one step.
STEP = 1 << 21


def fingerprint_words(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle of ``words``."""
    from xxhash import xxh64_intdigest as h

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, rows: int = 1 << 16) -> int:
    """Bits set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, rows):
        bits = np.unpackbits(hashes[at : at + rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            fp = [majority(fingerprint_words((x.as_py() or b"").lower().split(), shingle)) for x in text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], schema=schema)

    return rows.mapInArrow(run, "doc_id long, fp long")


def blocks(mask: int, n: int) -> list[int]:
    """The free bits of ``mask`` in ``n`` contiguous groups."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [round(i * len(free) / n) for i in range(n + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cut, cut[1:], strict=False)]


def first_masks(n: int, max_bits: int, bucket: int) -> list[int]:
    """Masks of which two fingerprints within ``max_bits`` bits agree on one at least, wide enough for ``n`` nodes."""
    from itertools import combinations

    for parts in range(max_bits + 1, max_bits + 9):
        keep = parts - max_bits
        if n / 2 ** (64 * keep / parts) <= bucket / 2:
            break
    own = blocks(0, parts)
    return [sum(c) for c in combinations(own, keep)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Join the trees of the pairs (a, b) in place; a root is its tree's smallest index. Returns the pairs that joined two trees."""
    joined = [np.empty((0, 2), np.int64)]
    while len(a):
        ra, rb = parent[a], parent[b]
        while True:
            na, nb = parent[ra], parent[rb]
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        np.minimum.at(parent, high, low)
        won = np.flatnonzero(parent[high] == low)
        _, first = np.unique(high[won], return_index=True)
        joined.append(np.c_[a[won[first]], b[won[first]]])
    return joined


class GrayIndex:
    """Hierarchical index of the sorted codes of many buckets at once."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        """codes sorted by bucket and Gray rank; bucket: ascending numbers."""
        self.codes = codes
        n = len(codes)
        first = np.searchsorted(bucket, bucket)  # where each row's bucket begins
        self.stop = np.searchsorted(bucket, bucket, side="right")
        group, within = bucket, np.arange(n) - first
        ands, ors, low, high = codes, codes, np.arange(n), np.arange(n) + 1
        self.levels = []
        while True:
            key = within // FAN
            heads = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
            child_low, child_high = heads, np.r_[heads[1:], len(group)]
            ands, ors = np.bitwise_and.reduceat(ands, heads), np.bitwise_or.reduceat(ors, heads)
            low, high = low[heads], high[child_high - 1]
            group, within = group[heads], key[heads]
            self.levels.append({"same": ~(ands ^ ors), "pattern": ands, "children": (child_low, child_high), "rows": (low, high)})
            if len(np.unique(group)) == len(group):
                break
        self.root_of = np.searchsorted(group, bucket)

    def pairs(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, later row of its bucket, differing bits) at ``most`` differing bits or fewer."""
        q, node = queries, self.root_of[queries]
        seen = np.zeros(len(q), np.uint64)  # bits on which the path so far has counted differences
        acc = np.zeros(len(q), np.int64)
        for level in reversed(self.levels):
            fresh = level["same"][node] & ~seen
            acc = acc + np.bitwise_count((self.codes[q] ^ level["pattern"][node]) & fresh)
            go = (acc <= most) & (level["rows"][1][node] > q + 1)
            q, node, acc = q[go], node[go], acc[go]
            seen = level["same"][node]
            a, z = level["children"][0][node], level["children"][1][node]
            n = z - a
            at = np.repeat(np.arange(len(q)), n)
            node = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            q, acc, seen = q[at], acc[at], seen[at]
        go = node > q
        q, node = q[go], node[go]
        bits = np.bitwise_count(self.codes[q] ^ self.codes[node])
        near = bits <= most
        return q[near], node[near], bits[near]


def forest(table: np.ndarray, mask: np.ndarray, code: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of a task that span all its linked rows, as pairs of node names; closer ones are taken first."""
    if not len(code):
        return node, node
    order = np.lexsort((gray_rank(code), code & mask, mask, table))
    table, mask, code, node = table[order], mask[order], code[order], node[order]
    key = code & mask
    bucket = np.cumsum(np.r_[0, (table[1:] != table[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
    names, mine = np.unique(node, return_inverse=True)
    parent = np.arange(len(names))
    index = GrayIndex(code, bucket)
    work = np.cumsum(index.stop - np.arange(len(code)))
    cuts = np.unique(np.r_[0, np.searchsorted(work, np.arange(STEP, int(work[-1]) + STEP, STEP)), len(code)])
    taken = []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        x, y, bits = index.pairs(np.arange(a, z), most)
        for d in range(most + 1):
            taken += union(parent, mine[x[bits == d]], mine[y[bits == d]])
    both = names[np.concatenate(taken)] if taken else np.empty((0, 2), np.int64)
    return both.max(axis=1), both.min(axis=1)


def links(nodes: DataFrame, max_bits: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Of nodes (node, fp) with distinct fp: pairs (a, b), a > b, that connect whatever lies within ``max_bits`` bits.

    A column ``table``, if there is one, keeps apart fingerprints of different kinds.
    """
    spark = nodes.sparkSession
    if "table" not in nodes.columns:
        nodes = nodes.withColumn("table", F.lit(0))
    nodes = nodes.select("table", "node", "fp")
    n = nodes.count()

    def spread(rows: DataFrame, masks: list[int]) -> DataFrame:
        return rows.withColumn("mask", F.explode(F.array(*[F.lit(signed(m)) for m in masks])))

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("table").to_numpy(), b.column("mask").to_numpy(), b.column("fp").to_numpy(), b.column("node").to_numpy()) for b in batches]
        if got:
            table, mask, code, node = (np.concatenate(x) for x in zip(*got, strict=True))
            a, b = forest(table, mask.view(np.uint64), code.view(np.uint64), node, max_bits)
            for at in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], schema=schema)

    masks = first_masks(n, max_bits, max_bucket)
    rows, out, count, made = spread(nodes, masks), [], n, []
    key = F.col("fp").bitwiseAND(F.col("mask"))
    while True:
        hot = rows.groupBy("table", "mask", key.alias("key")).count().filter(F.col("count") > max_bucket)
        hot = written(hot, "simhash-hot")
        made.append(hot)
        hot_n = hot.agg(F.sum("count")).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(count * len(masks) / 400_000))
        if not hot_n:
            cool = rows
        else:
            rows = rows.withColumn("key", key)
            cool = rows.join(hot, ["table", "mask", "key"], "left_anti").drop("key")
        out.append(cool.repartition(tasks, "table", "mask", key).select("table", "mask", "fp", "node").mapInArrow(search, "a long, b long"))
        if not hot_n:
            break
        narrower = {m: [m | b for b in blocks(m, max_bits + 1)] for m in masks}
        finer = F.create_map(*[x for m, more in narrower.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(y)) for y in more]))])
        rows = rows.join(hot.select("table", "mask", "key"), ["table", "mask", "key"], "left_semi").select("table", "node", "fp", F.explode(finer[F.col("mask")]).alias("mask"))
        masks = sorted({y for more in narrower.values() for y in more})
        count = hot_n
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    found = written(found, "simhash-links")
    for x in made:
        forget(x)
    return found


#: Edges that one task joins by itself.
ONE_TASK = 500_000


def components(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node in ``pairs`` (a, b), but for components' smallest nodes: the smallest node that can be reached.

    Large-star and small-star rounds; up to ``one_task`` edges (16 bytes each), counted first, make one task.
    """
    pairs = written(pairs, "edges")
    if pairs.count() <= one_task:
        schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
            if got:
                a, b = (np.concatenate(x) for x in zip(*got, strict=True))
                names, at = np.unique(np.r_[a, b], return_inverse=True)
                parent = np.arange(len(names))
                union(parent, at[: len(a)], at[len(a) :])
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                far = np.flatnonzero(parent != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[parent[far]])], schema=schema)

        done = written(pairs.coalesce(1).mapInArrow(join, "node long, component long"), "components")
        forget(pairs)
        return done
    edges, before = pairs, None
    while True:
        # the smallest neighbours are written first: a join of two plain exchanges, which AQE splits where a hub has most of the rows
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "smallest")
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()
        new = written(small, "components")
        forget(low)
        state = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if before is not None:
            forget(edges)
        if before == state:
            return new.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges, before = new, state


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).filter(F.col("node").isNotNull()), "nodes")
    found = components(links(nodes, max_bits, max_bucket))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    done = near_duplicates(docs)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
