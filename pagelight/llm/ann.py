"""Approximate nearest neighbours by balanced posting lists.

Fit, on a bounded sample: largest inner product becomes smallest distance by one more coordinate, which
fills every vector up to the largest norm. k-means, splitting overfull clusters, gives centroids with
balanced shares; a graph links each centroid to its nearest ones. The distance ratio for pruning is the
one that reaches ``target`` recall on sample queries answered exactly.

Index: every vector goes to the list of its nearest centroid, and a boundary vector also to those
within ``spill`` times that distance, unless a centroid chosen before is nearer to that centroid than
the vector is. Lists that hold more than ``chunk`` vectors, as many equal ones would make, are dealt
over several tasks by a hash of the id.

Search: a query walks the in-memory centroid graph from its entry points while it finds centroids
within the ratio of the nearest; every list within the ratio is read, and where these are the home of
too few vectors, the next nearest lists too. Lists lie together in regions of up to ``chunk`` vectors, and a
query travels once to each region that holds lists it wants. A task compares a block of queries with the
lists that each wants (with the whole region, where that is a quarter of its lists or more), and sends
each query's best of the region; queries then merge theirs. A region that more than ``QUERIES`` queries
want is read by several tasks, so that no task holds more than that of either side. The number of lists
grows with the table up to ``max_lists``, which bounds the centroids and the graph that are broadcast,
and the sample with the lists: ``LIST_SAMPLE`` vectors for each, ``SAMPLE`` at least.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part; an
inner product joins vectors of one length only, and the index holds the table's most frequent length
(of ties the smallest): queries of another length are compared with every vector of theirs, block by
block; rows with a null id take no part; of rows with equal ids each is a candidate, but the query's own id is none; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import written

SAMPLE = 20_000
LIST_SAMPLE = 8
LIST_ROWS = 512
MAX_LISTS = 1 << 14
CHUNK = 1 << 16
#: Queries that a task compares with a region.
QUERIES = 1 << 16
TARGET = 0.99
SPILL, REPLICAS = 1.05, 4
DEGREE = 16
#: Scores that a task holds at once.
CELLS = 1 << 21


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def blocks(n: int, width: int) -> list[slice]:
    """Slices of ``n`` rows with at most ``CELLS`` scores of ``width`` columns in each."""
    step = max(1, CELLS // max(1, width))
    return [slice(a, min(n, a + step)) for a in range(0, n, step)]


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[b], c).argmin(axis=1) for b in blocks(len(x), len(c))])


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids with balanced shares: a cluster above 1.5 times the mean takes the place of the smallest one."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for r in range(rounds):
        near = nearest_of(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if r < rounds - 3:
            for big, small in zip(np.argsort(-n, kind="stable"), np.argsort(n, kind="stable"), strict=True):
                if n[big] <= 1.5 * len(x) / k or n[small] >= 0.5 * len(x) / k:
                    break
                members = x[near == big]
                c[small] = members[rng.integers(len(members))]
    return c


class Lists:
    """Centroids, their graph and the pruning ratio."""

    def __init__(self, sample: np.ndarray, n_lists: int, norm: float, top: int, target: float):
        self.norm = norm
        x = self.lifted(sample)
        self.centroids = kmeans(x, n_lists)
        c = self.centroids
        self.edges = np.concatenate([np.argsort(distances(c[b], c), axis=1, kind="stable")[:, 1 : DEGREE + 1] for b in blocks(n_lists, n_lists)])
        self.entries = np.unique(np.linspace(0, n_lists - 1, min(n_lists, 32)).astype(int))
        self.ratio = 1.0
        self.ratio = self.calibrated(sample, x, top, target)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))]

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """Of lifted vectors, the lists of each, the nearest first."""
        d = distances(x, self.centroids)
        order = np.argsort(d, axis=1, kind="stable")[:, : 2 * REPLICAS]
        out = []
        for row, near in zip(d, order, strict=True):
            chosen = [near[0]]
            for c in near[1:]:
                if row[c] > SPILL * row[near[0]] or len(chosen) == REPLICAS:
                    break
                if (distances(self.centroids[chosen], self.centroids[c : c + 1]) > row[c]).all():
                    chosen.append(c)
            out.append(np.array(chosen))
        return out

    @staticmethod
    def true_best(sample: np.ndarray, block: slice, top: int) -> np.ndarray:
        s = sample[block] @ sample.T
        s[np.arange(len(s)), np.arange(block.start, block.stop)] = -np.inf
        return np.argsort(-s, axis=1, kind="stable")[:, : min(top, len(sample) - 1)]

    def calibrated(self, sample: np.ndarray, x: np.ndarray, top: int, target: float) -> float:
        """The distance ratio within which ``target`` of the sample's true neighbours lie."""
        m = min(len(sample), 512)
        q = np.c_[sample[:m], np.zeros(m)]
        best = np.concatenate([self.true_best(sample, b, top) for b in blocks(m, len(sample))])
        d = distances(q, self.centroids)
        wanted = np.unique(best)
        of = dict(zip(wanted.tolist(), [h for b in blocks(len(wanted), len(d[0])) for h in self.homes(x[wanted[b]])], strict=True))
        need = [d[i, of[j]].min() / max(d[i].min(), 1e-12) for i in range(m) for j in best[i].tolist()]
        return float(np.quantile(need, target)) * 1.0005 if need else 1.0

    def probes(self, q: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """Of each query, the lists within the ratio that a walk over the graph finds, and the next nearest until they are home to ``least`` vectors, of ``held`` in each list."""
        q = np.c_[q, np.zeros(len(q))]
        n, k = len(q), len(self.centroids)
        d = np.full((n, k), np.inf)
        d[:, self.entries] = distances(q, self.centroids[self.entries])
        open_ = np.isfinite(d)
        while True:
            bound = np.minimum(d.min(axis=1), np.inf)[:, None] * self.ratio
            nearest = d == d.min(axis=1)[:, None]
            go = open_ & ((d <= bound) | nearest)
            if not go.any():
                break
            open_ &= ~go
            at, node = np.nonzero(go)
            rows, cols = np.repeat(at, self.edges.shape[1]), self.edges[node].reshape(-1)
            new = np.zeros((n, k), bool)
            new[rows, cols] = True
            new &= ~np.isfinite(d)
            rows, cols = np.nonzero(new)
            for a in range(0, len(rows), 1 << 16):
                r, c = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
                d[r, c] = np.sqrt(np.maximum(0, ((q[r] - self.centroids[c]) ** 2).sum(axis=1)))
            open_ |= new
        chosen = [np.flatnonzero(row <= row.min() * self.ratio) for row in d]
        for i, lists in enumerate(chosen):
            if held[lists].sum() < least:
                order = np.argsort(distances(q[i : i + 1], self.centroids)[0], kind="stable")
                order = np.r_[lists, order[~np.isin(order, lists)]]
                chosen[i] = order[: np.searchsorted(np.cumsum(held[order]), least) + 1]
        return chosen


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query its ``top`` rows: (ids, scores), nearest first, ties to the smaller id. Scores do not depend on the block."""
    out: list = [None] * len(q)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    # what the order of summation can change in a score
    slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((x * x).sum(axis=1).max(initial=0.0)) * np.sqrt((q * q).sum(axis=1))
    for a in range(0, len(q), max(1, CELLS // max(1, len(x)))):
        block = slice(a, a + max(1, CELLS // max(1, len(x))))
        s = q[block] @ x.T
        s[q_ids[block][:, None] == ids[None]] = -np.inf
        for i, row in enumerate(s):
            keep = np.flatnonzero(row > -np.inf)
            if len(keep) > top:
                least = np.partition(row, len(row) - top)[len(row) - top]
                keep = np.flatnonzero((row >= least - slack[a + i]) & (row > -np.inf))
            exact = (x[keep] * q[a + i]).sum(axis=1)
            chosen = np.lexsort((ids[keep], -exact))[:top]
            out[a + i] = ids[keep][chosen], exact[chosen]
    return out


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the rows (id, vector) without their replicas."""
    _, at, n = np.unique(ids, return_inverse=True, return_counts=True)
    again, seen = np.flatnonzero(n[at] > 1), set()
    keep = n[at] == 1
    for i in again.tolist():
        name = (int(ids[i]), x[i].tobytes())
        keep[i] = name not in seen
        seen.add(name)
    return np.flatnonzero(keep)


def merged(parts: list[tuple[np.ndarray, np.ndarray]], top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` of several (ids, scores), replicas once."""
    pairs = np.unique(np.rec.fromarrays([np.concatenate([p[k] for p in parts]) for k in (0, 1)]))
    order = np.lexsort((pairs.f0, -pairs.f1))[:top]
    return pairs.f0[order], pairs.f1[order]


def best_of_region(q_ids: np.ndarray, q: np.ndarray, wants: list[np.ndarray], ids: np.ndarray, x: np.ndarray, home: np.ndarray, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query its ``top`` rows in the lists that it wants of a region with rows (id, vector, list)."""
    order = np.argsort(home, kind="stable")
    ids, x, home = ids[order], x[order], home[order]
    lists, start = np.unique(home, return_index=True)
    stop = np.r_[start[1:], len(home)]
    found: list[list] = [[] for _ in q_ids]
    wide = np.array([4 * len(w) >= len(lists) for w in wants], bool)
    if wide.any():
        keep, own = distinct_rows(ids, x), np.flatnonzero(wide)
        for i, best in zip(own.tolist(), best_of(q_ids[own], q[own], ids[keep], x[keep], top), strict=True):
            found[i].append(best)
    few = np.flatnonzero(~wide)
    if len(few):
        flat, asker = np.concatenate([wants[i] for i in few]), np.repeat(few, [len(wants[i]) for i in few])
        for name, a, z in zip(lists.tolist(), start.tolist(), stop.tolist(), strict=True):
            own = asker[flat == name]
            for i, best in zip(own.tolist(), best_of(q_ids[own], q[own], ids[a:z], x[a:z], top) if len(own) else [], strict=True):
                found[i].append(best)
    return [merged(f, top) if f else (np.empty(0, np.int64), np.empty(0)) for f in found]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.filter(~F.exists(v, bad) & F.exists(v, lambda c: c != 0))


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, chunk: int = CHUNK, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` rows found, by largest inner product."""
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("norm2"))
    found = lengths.orderBy(F.desc("rows"), "n").limit(2).collect()
    if not found:
        return spark.createDataFrame([], shape)
    dim, total, norm = found[0].n, found[0]["rows"], float(np.sqrt(found[0].norm2)) * (1 + 1e-9)
    common = rows.filter(F.size("v") == dim)
    wanted = usable(queries, id_col, vec_col)
    n_lists = int(min(max_lists, max(1, total // list_rows)))
    drawn = common.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, LIST_SAMPLE * n_lists)).toArrow()
    sample = np.stack(drawn.column("v").to_numpy())
    n_lists = min(n_lists, max(1, len(sample) // LIST_SAMPLE))
    held = spark.sparkContext.broadcast(Lists(sample, n_lists, norm, top, target))

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = held.value
        for batch in batches:
            for b in blocks(batch.num_rows, n_lists):
                some = batch.slice(b.start, b.stop - b.start)
                homes = lists.homes(lists.lifted(matrix(some.column("v"))))
                take = pa.array(np.repeat(np.arange(len(homes)), [len(h) for h in homes]))
                home = np.concatenate([np.arange(len(h)) == 0 for h in homes])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(homes), pa.int32()), pa.array(home), some.column("id").take(take), some.column("v").take(take)], names=["list", "home", "id", "v"])

    posted = common.mapInArrow(post, "list int, home boolean, id long, v array<double>")
    others = lambda some: some.filter(F.size("v") != dim)
    if len(found) > 1:
        posted = posted.unionByName(others(rows).select((-F.size("v")).alias("list"), F.lit(True).alias("home"), "id", "v"))
    posted = written(posted, "posted")
    # numbers of lists: max_lists, and one for each other length
    sizes = posted.groupBy("list").agg(F.count("*").alias("rows"), F.sum(F.col("home").cast("long")).alias("homes")).collect()
    homes = np.zeros(n_lists, np.int64)
    for r in sizes:
        if r.list >= 0:
            homes[r.list] = r.homes
    # regions: neighbours in the numbering together, a list that is too long or of another length alone and in parts
    room = min(chunk, max(1, -(-sum(r["rows"] for r in sizes) // (4 * spark.sparkContext.defaultParallelism))))
    region_of, parts, filled, region = np.zeros(n_lists, np.int32), {}, 0, 0
    for r in sorted(sizes, key=lambda r: r.list):
        if r.list >= 0:
            if filled and filled + r["rows"] > room:
                region, filled = region + 1, 0
            region_of[r.list], filled = region, filled + r["rows"]
        if r["rows"] > chunk:
            parts[region if r.list >= 0 else r.list] = -(-r["rows"] // chunk)

    def looked_up(table: dict, key: str):
        return F.coalesce(F.create_map(*[F.lit(int(x)) for kv in table.items() for x in kv])[F.col(key)], F.lit(1)) if table else F.lit(1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(region, id, v, lists): a query once for each region."""
        for batch in batches:
            for b in blocks(batch.num_rows, n_lists):
                some = batch.slice(b.start, b.stop - b.start)
                take, where, which = [], [], []
                for i, lists in enumerate(held.value.probes(matrix(some.column("v")), homes, top + 1)):
                    lists = lists[np.argsort(region_of[lists], kind="stable")]
                    names, start = np.unique(region_of[lists], return_index=True)
                    take += [i] * len(names)
                    where += names.tolist()
                    which += np.split(lists.astype(np.int32), start[1:])
                offsets = np.r_[0, np.cumsum([len(w) for w in which])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *which]), pa.int32()))
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), some.column("id").take(at), some.column("v").take(at), lists], names=["region", "id", "v", "lists"])

    probed = wanted.filter(F.size("v") == dim).mapInArrow(split, "region int, id long, v array<double>, lists array<int>")
    if len(found) > 1:
        alone = (-F.size("v")).cast("int")
        probed = probed.unionByName(others(wanted).select(alone.alias("region"), "id", "v", F.array(alone).alias("lists")))
    asked = {}
    if wanted.count() > QUERIES:
        asked = {r.region: -(-r["count"] // QUERIES) for r in probed.select("region").groupBy("region").count().collect() if r["count"] > QUERIES}
    named = F.when(F.col("list") < 0, F.col("list")).otherwise(F.get(F.lit(region_of.tolist()).cast("array<int>"), F.greatest(F.col("list"), F.lit(0))))
    dealt = lambda n: F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    n_parts, n_asked = looked_up(parts, "region"), looked_up(asked, "region")
    posted = posted.select("list", "id", "v", named.alias("region")).withColumn("part", dealt(n_parts)).withColumn("block", every(n_asked))
    probed = probed.withColumn("block", dealt(n_asked)).withColumn("part", every(n_parts))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"query_id": [], "found": []}
        if left.num_rows and right.num_rows:
            q_ids = left.column("id").to_numpy()
            wants = left.column("lists").combine_chunks()
            ends = np.cumsum(wants.value_lengths().to_numpy())
            wants = np.split(wants.flatten().to_numpy(), ends[:-1])
            for i, (ids, scores) in enumerate(best_of_region(q_ids, matrix(left.column("v")), wants, right.column("id").to_numpy(), matrix(right.column("v")), right.column("list").to_numpy(), top)):
                out["query_id"].append(int(q_ids[i]))
                out["found"].append(pickle.dumps((ids.tobytes(), scores.tobytes())))
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "found": pa.array(out["found"], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for query, packed in zip(batch.column("query_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                got = [pickle.loads(x) for x in packed]
                ids, scores = merged([(np.frombuffer(g[0], np.int64), np.frombuffer(g[1], np.float64)) for g in got], top)
                for column, values in zip(out, ([query] * len(ids), range(1, len(ids) + 1), ids.tolist(), scores.tolist()), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    near = probed.groupBy("region", "part", "block").cogroup(posted.groupBy("region", "part", "block")).applyInArrow(compare, "query_id long, found binary")
    # one row for each region that a query visits
    return near.groupBy("query_id").agg(F.collect_list("found").alias("found")).mapInArrow(merge, shape)


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
