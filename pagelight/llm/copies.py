"""Near copies for the corpus pipeline: SimHash proposes, counted shingles complete, whole texts decide.

Two texts are near copies if their sets of ``shingle``-word shingles share ``similarity`` (Jaccard). A
fingerprint radius alone cannot find them all: texts that differ by one block of words lie many bits
apart. So there are two sources of candidates, and every candidate is verified on both whole texts
before it joins anything:

1. The Gray-order index of ``simhash`` links fingerprints of the shingles within ``max_bits`` bits; equal
   fingerprints are tried against one head. What passes is contracted, large groups of copies at first.
2. A prefix join that misses no pair. Each task packs the shingle hashes of its texts by ranges of hash
   values; each range counts in how many texts a hash stands. In the order (count, hash), the same for
   all texts, two texts of ``similarity`` share one of their first ``n - ceil(similarity * n) + 1`` hashes,
   and the first that they share bounds what they can share at all (positional bound). A hash of one
   text only never travels back; so rare shingles make the keys and common passages hardly ever do.
   A hash that stands in ``HOT`` texts of a task goes out as a count, and its texts by task.

A pair that shares a key must also pass by the parities of its texts' hashes in ``PARITY`` bits (a bitmap filter):
two bitmaps never differ in more bits than the sets do in hashes, so no pair of ``similarity`` fails.

Each key's texts are first tried against ``HEADS`` of them, others in each round, while more than ``FEW`` pairs
a row are left and a round makes a tenth of them needless; then in all pairs that are not joined yet. Hashes have 64 bits: equal hashes of different shingles cost
a comparison.

Defined results: a null or empty text equals any other without words; equal texts are one; rows that
repeat a doc_id are one document, whose texts join their groups; rows without an id take no part; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import forget, fresh, if_small, plan_bytes, written
from pagelight.llm.simhash import components, links, majority
from pagelight.llm.substring import pack, pack_ids, runs, unpack, unpack_ids, window_hashes, word_hashes

SIMILARITY, WORDS = 0.8, 5
#: Hashes that a task gathers before it sends them.
BLOCK = 1 << 21
#: Bytes of the stored table for each range of hash values.
RANGE_BYTES = 3 << 20
#: Texts of one block that share a hash, from which on the block sends their number.
HOT = 64
#: Heads of a key in one round.
HEADS = 8
#: Pairs for each row of the keys that are tried without more heads.
FEW = 8
#: Bits of a text's parities, a multiple of 64.
PARITY = 512
#: Kinds of rows between the tasks.
SHINGLES, SIZES, COMMON, COUNTS = range(4)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; the whole text is one if it has fewer words."""
    words = word_hashes((text or b"").lower().split())
    return np.unique(window_hashes(words, min(shingle, len(words)))) if len(words) else np.empty(0, np.uint64)


def shingle_set(text: bytes | None, n: int) -> set[bytes]:
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar(a: bytes | None, b: bytes | None, n: int, least: float) -> bool:
    """Whether the shingle sets' Jaccard similarity is ``least`` or more; texts without words are alike."""
    x, y = shingle_set(a, n), shingle_set(b, n)
    return len(x & y) >= least * len(x | y) - 1e-12


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bit i of ``PARITY``: whether an odd number of the hashes have the remainder i; in words of 64 bits."""
    odd = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def by_group(groups: int, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(group, payload): the rows of each group of ids."""
    group = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % groups
    order = np.argsort(group, kind="stable")
    group = group[order]
    for a, z in runs(group):
        own = order[a:z]
        yield int(group[a]), pickle.dumps((pack_ids(ids[own]), *(c[own].tobytes() for c in columns)))


def block_rows(ids: list[int], sets: list[np.ndarray], prints: list[int], bits: int, groups: int, number: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, key, payload) rows of a block of texts."""
    own, n = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64)
    for group, raw in by_group(groups, own, n, np.array(prints, np.uint64)):
        yield SIZES, group, raw
    h, doc = np.concatenate(sets), np.repeat(own, n)
    if not len(h):
        return
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    h, doc = h[new], doc[new]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.diff(np.r_[head, len(h)])
    often = np.repeat(count >= HOT, count)
    hot, hot_n = h[head[count >= HOT]], count[count >= HOT]
    if len(hot):
        yield COMMON, number, pickle.dumps((hot.tobytes(), hot_n.tobytes(), doc[often].tobytes()))
    h, doc = h[~often], doc[~often]
    shift = np.uint64(64 - bits)
    ranges = np.unique(np.r_[h >> shift, hot >> shift])
    cut, hot_cut = (np.r_[np.searchsorted(x >> shift, ranges), len(x)] for x in (h, hot))
    for i, r in enumerate(ranges.tolist()):
        a, z, u, v = cut[i], cut[i + 1], hot_cut[i], hot_cut[i + 1]
        yield SHINGLES, r, pickle.dumps((pack(h[a:z]) if z > a else None, pack_ids(doc[a:z]) if z > a else None, hot[u:v].tobytes(), hot_n[u:v].tobytes()))


def count_range(payloads: list[bytes], groups: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, key, payload): by group of texts the hashes of two texts or more with their counts; the counts of the common ones."""
    parts = [pickle.loads(p) for p in payloads]
    h = np.concatenate([np.empty(0, np.uint64), *(unpack(p[0]) for p in parts if p[0])])
    doc = np.concatenate([np.empty(0, np.int64), *(unpack_ids(p[1]) for p in parts if p[1])])
    hot, hot_n = np.frombuffer(b"".join(p[2] for p in parts), np.uint64), np.frombuffer(b"".join(p[3] for p in parts), np.int64)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    h, doc = h[new], doc[new]
    names, at = np.unique(np.r_[h, hot], return_inverse=True)
    df = np.bincount(at, np.r_[np.ones(len(h), np.int64), hot_n], len(names)).astype(np.int64)
    mine = df[at[: len(h)]]
    shared = mine > 1
    if shared.any():
        for group, raw in by_group(groups, doc[shared], h[shared], mine[shared]):
            yield SHINGLES, group, raw
    if len(hot):
        common = np.unique(at[len(h) :])
        yield COUNTS, 0, pickle.dumps((names[common].tobytes(), df[common].tobytes()))


def first_shared(sizes: list[bytes], shared: list[bytes], similarity: float) -> dict[str, np.ndarray]:
    """Of a group of texts: their fingerprints (key null), and the hashes of other texts too among their first ones."""
    got = [pickle.loads(p) for p in sizes]
    ids, once = np.unique(np.concatenate([unpack_ids(g[0]) for g in got]), return_index=True)
    n, fp = (np.concatenate([np.frombuffer(g[i], np.int64) for g in got])[once] for i in (1, 2))
    got = [pickle.loads(p) for p in shared]
    doc = np.concatenate([np.empty(0, np.int64), *(unpack_ids(g[0]) for g in got)])
    h, df = (np.concatenate([np.empty(0, np.int64), *(np.frombuffer(g[i], np.int64) for g in got)]) for i in (1, 2))
    order = np.lexsort((h, df, doc))
    doc, h, df = doc[order], h[order], df[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    doc, h, df = doc[new], h[new], df[new]
    at = np.searchsorted(ids, doc)
    count = np.bincount(at, minlength=len(ids))
    pos = n[at] - count[at] + np.arange(len(doc)) - (np.cumsum(count) - count)[at]
    first = np.where(n > 0, n - np.maximum(1, np.ceil(similarity * n - 1e-9).astype(np.int64)) + 1, 0)
    keep = pos < first[at]
    none = ids[n == 0]  # texts without words share a key of their own
    zero = np.zeros(len(none), np.int64)
    return {
        "key": np.r_[h[keep], zero],
        "df": np.r_[df[keep], zero],
        "id": np.r_[doc[keep], none],
        "size": np.r_[n[at][keep], zero],
        "pos": np.r_[pos[keep], zero],
        "ids": ids,
        "n": n,
        "fp": fp,
    }


def keyed(rows: DataFrame, shingle: int, similarity: float, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, df, id, size, pos, fp) of rows (id, text): a row with a null key and the fingerprint for each text, and one for each key."""
    bits = max(4, min(24, (size // RANGE_BYTES).bit_length()))
    groups = 1 << bits
    shape = "kind int, key long, payload binary"
    sent = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("payload", pa.binary())])

    def table(found: list[tuple[int, int, bytes]]) -> pa.Table:
        return pa.Table.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(sent)], schema=sent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, sets, prints, total, number = [], [], [], 0, TaskContext.get().partitionId() << 20
        one = lambda x: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(x, sent, strict=True)], schema=sent)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, own in enumerate(batch.column("id").to_pylist()):
                hashes = shingle_hashes(texts[i].as_py(), shingle)
                ids.append(own)
                sets.append(hashes)
                prints.append(majority(hashes))
                total += len(hashes)
                if total >= BLOCK:
                    yield from map(one, block_rows(ids, sets, prints, bits, groups, number))
                    ids, sets, prints, total, number = [], [], [], 0, number + 1
        if ids:
            yield from map(one, block_rows(ids, sets, prints, bits, groups, number))

    def count(part: pa.Table) -> pa.Table:
        kind, key, payloads = part.column("kind")[0].as_py(), part.column("key")[0].as_py(), part.column("payload").to_pylist()
        return table([*count_range(payloads, groups)] if kind == SHINGLES else [(kind, key, p) for p in payloads])

    counted = written(rows.mapInArrow(send, shape).groupBy("kind", "key").applyInArrow(count, shape), "counted-shingles")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                h, df = (np.frombuffer(x, np.int64) for x in pickle.loads(raw))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(df)], names=["h", "df"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                h, n, doc = pickle.loads(raw)
                h, n = np.frombuffer(h, np.int64), np.frombuffer(n, np.int64)
                ends = np.cumsum(n) * 8
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([doc[z - 8 * k : z] for z, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], names=["h", "docs"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.frombuffer(x, np.int64) for x in batch.column("docs").to_pylist()]
            n = [len(d) for d in docs]
            found = [(SHINGLES, g, p) for g, p in by_group(groups, np.concatenate(docs), np.repeat(batch.column("h").to_numpy(), n), np.repeat(batch.column("df").to_numpy(), n))] if docs else []
            yield from table(found).to_batches()

    common = counted.filter(F.col("kind") == COMMON).select("payload").mapInArrow(places, "h long, docs binary")
    often = counted.filter(F.col("kind") == COUNTS).select("payload").mapInArrow(numbers, "h long, df long")
    back = counted.filter(F.col("kind").isin(SHINGLES, SIZES)).unionByName(common.join(often, "h").mapInArrow(grouped, shape))
    out = pa.schema([(c, pa.int64()) for c in ("key", "df", "id", "size", "pos", "fp")])

    def first(part: pa.Table) -> pa.Table:
        kinds, payloads = part.column("kind").to_pylist(), part.column("payload").to_pylist()
        x = first_shared([p for k, p in zip(kinds, payloads, strict=True) if k == SIZES], [p for k, p in zip(kinds, payloads, strict=True) if k == SHINGLES], similarity)
        none, nil = pa.nulls(len(x["ids"]), pa.int64()), pa.nulls(len(x["key"]), pa.int64())
        texts = [none, none, pa.array(x["ids"]), pa.array(x["n"]), none, pa.array(x["fp"])]
        keys = [*(pa.array(x[c]) for c in out.names[:5]), nil]
        return pa.concat_tables([pa.Table.from_arrays(texts, schema=out), pa.Table.from_arrays(keys, schema=out)])

    return back.groupBy("key").applyInArrow(first, "key long, df long, id long, size long, pos long, fp long"), [counted]


def named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, id) of the distinct texts of rows (doc_id, mark): an id for each text, its smallest doc_id if that is free; and (doc_id, mark) of all others."""
    marked = written(rows.select("doc_id", "mark").distinct(), "marks")
    texts = written(marked.groupBy("mark").agg(F.min("doc_id").alias("doc_id")), "distinct-texts")
    first = texts.groupBy("doc_id").agg(F.min("mark").alias("mark"))
    more = written(texts.join(first, ["doc_id", "mark"], "left_anti"), "more-texts")  # texts under a doc_id that has another one
    above = (marked.agg(F.max("doc_id")).first()[0] or 0) + 1
    own = first.withColumn("id", F.col("doc_id")).unionByName(more.withColumn("id", F.lit(above) + F.monotonically_increasing_id()).select("doc_id", "mark", "id"))
    return written(own, "text-ids"), marked


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WORDS, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every document with an id: documents linked by equal texts or by near copies."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).filter("doc_id IS NOT NULL").withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))
    ids, marked = named(rows)
    copies = written(marked.join(ids, ["doc_id", "mark"], "left_anti"), "equal-texts")
    own = rows.join(if_small(copies), ["doc_id", "mark"], "left_anti")
    odd = ids.filter("id <> doc_id")
    own = own.withColumn("id", F.col("doc_id")) if odd.isEmpty() else own.join(odd, ["doc_id", "mark"], "left").withColumn("id", F.coalesce("id", "doc_id"))
    own = own.select("id", "text")
    keys, made = keyed(own, shingle, similarity, plan_bytes(docs, text_col))
    keys = written(keys, "prefix-keys")
    for df in made:
        forget(df)
    prints = keys.filter("key IS NULL").select("id", "fp")
    every = keys.filter("key IS NOT NULL").select("key", "df", "id", "size", "pos")
    # keys of the same texts propose the same pairs: the first in the order of all will do (128 bits of the members' hashes)
    member = [F.xxhash64("id"), F.xxhash64("id", F.lit(1))]
    sets = every.groupBy("key", "df").agg(F.count("*").alias("n"), *[F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(member)])
    one = written(sets.filter("n > 1").groupBy("n", "h0", "h1").agg(F.min(F.struct("df", "key")).alias("k")).select("k.key"), "first-keys")
    shared = written(every.join(one, "key", "left_semi").select("key", "id", "size", "pos"), "keys")
    heads = written(prints.groupBy("fp").agg(F.min("id").alias("node")), "heads")
    proposed = links(heads, max_bits).unionByName(prints.join(heads, "fp").filter("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")))
    proposed = written(proposed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidate-pairs")
    wanted = written(shared.select("id").unionByName(proposed.select(F.col("a").alias("id"))).unionByName(proposed.select(F.col("b").alias("id"))).distinct(), "candidate-ids")
    held = written(own.join(if_small(wanted), "id", "left_semi").dropDuplicates(["id"]), "candidate-texts")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    bits = [f"bits{i}" for i in range(PARITY // 64)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parities(shingle_hashes(x.as_py(), shingle)) for x in batch.column("text").cast(pa.binary())]
            columns = np.array(made, np.int64).reshape(len(made), len(bits)).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["id", *bits])

    signs = written(held.select("id", "text").mapInArrow(sign, ", ".join(f"{c} long" for c in ("id", *bits))), "parities")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).cast(pa.binary()) for c in ("text_a", "text_b"))
            good = pa.array([similar(s.as_py(), t.as_py(), shingle, similarity) for s, t in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], schema=pair)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return written(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "near-pairs")

    def may_be(pos: Column, size: Column, at: Column, other: Column) -> Column:
        """By their sizes, and by what stands behind the key, if it is the first that they share."""
        enough = 1 + F.least(size - pos, other - at) - 1 >= similarity / (1 + similarity) * (size + other) - 1e-6
        return (F.least(size, other) >= similarity * F.greatest(size, other) - 1e-9) & enough

    def near() -> Column:
        """By the parities: texts of ``similarity`` differ in a share of their hashes at most."""
        differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in bits), F.lit(0))
        return differ <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("size_")) + 1e-6

    own_ = ["id", "size", "pos", "comp", *bits]
    sure, tried, turn, before = verified(proposed), proposed, 0, math.inf
    while True:
        comp = components(sure)
        grouped = shared.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).select("key", "id", "size", "pos", "comp")
        # what is left of a key: the members outside its largest component, and all that they may still be alike to
        parts = grouped.groupBy("key", "comp").agg(F.count("*").alias("n"))
        open_ = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most")).filter("parts > 1")
        rest = written(grouped.join(open_.select("key", "main", (F.col("all") - F.col("most")).alias("pairs")), "key").join(signs, "id"), "open-keys")
        forget(comp)
        left = rest.agg(F.count("*").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if not left.rows:
            break
        if left.pairs <= FEW * left.rows or left.pairs > 0.9 * before:
            turn = None
        before = left.pairs
        if turn is None:
            small = rest.filter("comp <> main").select("key", *own_)
            other = rest.select("key", *[F.col(c).alias(f"{c}_") for c in own_])
            found = small.join(other, "key").filter(F.col("comp") != F.col("comp_"))
        else:
            some = [F.min_by(F.struct(*own_), F.xxhash64("id", F.lit(turn * HEADS + i))) for i in range(HEADS)]
            head = rest.groupBy("key").agg(F.array_distinct(F.array(*some)).alias("h")).select("key", F.explode("h").alias("h")).select("key", *[F.col(f"h.{c}").alias(f"{c}_") for c in own_])
            found = rest.join(written(head, "key-heads"), "key").filter(F.col("comp") != F.col("comp_"))
        found = found.filter(may_be(F.col("pos"), F.col("size"), F.col("pos_"), F.col("size_")) & near())
        pairs = found.select(F.greatest("id", "id_").alias("a"), F.least("id", "id_").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidate-pairs")
        more = verified(pairs)
        forget(rest)
        sure = sure.unionByName(more)
        if turn is None:
            break
        tried = tried.unionByName(pairs)
        turn += 1
    # a text's group is that of its smallest document, one doc_id may stand under several texts
    name = ids.select("id", F.col("doc_id").alias("node"))
    linked = sure.join(name.select(F.col("id").alias("a"), F.col("node").alias("x")), "a").join(name.select(F.col("id").alias("b"), F.col("node").alias("y")), "b")
    linked = linked.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    equal = marked.join(ids.select("mark", F.col("doc_id").alias("node")), "mark").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comp = components(linked.unionByName(equal))
    return marked.select("doc_id").distinct().join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its group, with all their columns; rows without an id stay."""
    gone = written(near_copies(docs, id_col=id_col, **options).filter("component_id < doc_id").select(F.col("doc_id").alias(fresh(docs, "gone"))), "copies")
    return docs.join(if_small(gone), docs[id_col] == gone[gone.columns[0]], "left_anti")
