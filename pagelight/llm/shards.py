"""Sharding by sampled splitters, on DataFrame functions only.

Records are ordered by (crc32 of the text, doc_id), so equal texts lie side by side and yet a group of
copies can be cut anywhere; rows equal in both are told apart by their size and by a mark that each gets
when the keys are written, so that a mass of equal rows is cut as well. A size-weighted sample of keys gives quantile boundaries of many small
ranges; a range that comes out above ``overfull`` times the mean is sampled again and subdivided. The
exact sizes of the ranges, and running sums inside each, then give every record its place in the whole
order, and the place its shard: 16 stretches of near-equal bytes, whose ends differ from the ideal by
one record at most. No task sees more than a range; what reaches the driver is bounded by the sample
and the number of ranges.

Defined results: a null text has no bytes and crc32 0, as the empty one; a null doc_id comes before all
others; equal rows take neighbouring slots; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelight.llm.common import forget, fresh, written

#: Sampled keys for each range.
SAMPLES = 64
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 50_000, 64, 4096
OVERFULL = 2.0
ROUNDS = 6
BINS = 4096
LEAST = -(1 << 63)
#: What records are ordered by.
ORDER = ["crc", "key", "size", "tie"]
Key = tuple[int, int, int, int]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).cast("long").alias("crc"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("key"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))


def drawn(rows: DataFrame, rate: Column, seed: int) -> DataFrame:
    """Rows by a draw whose chance is size times rate; ``n`` counts how often a row larger than 1 / rate is due."""
    u = F.pmod(F.xxhash64(F.lit(seed), *ORDER), F.lit(1 << 40)) / float(1 << 40)
    due = F.col("size") * rate
    return rows.filter(u < due).select(*ORDER, F.greatest(F.lit(1.0), due).alias("n"))


def quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """Boundaries that cut the weighted sample in ``parts`` of near-equal weight."""
    total, run, cuts = sum(n for _, n in sample), 0.0, []
    for key, n in sorted(sample):
        if run >= (len(cuts) + 1) * total / parts:
            cuts.append(key)
        run += n
    return cuts


def ranged(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """``rows`` with their range number. Splitters are looked up by the crc's upper bits, then among the few of that bin."""
    spark = rows.sparkSession
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    flat = ",".join(":".join(map(str, key)) for key in sorted(set(splitters)))
    cuts = F.transform(F.split(F.lit(flat), ","), lambda s: F.struct(*[F.split(s, ":")[i].cast("long").alias(c) for i, c in enumerate(ORDER)]))
    bins = spark.range(BINS).withColumn("cuts", cuts).select(
        F.col("id").alias("bin"),
        F.size(F.filter("cuts", lambda s: F.shiftright(s.crc, 20) < F.col("id"))).alias("before"),
        F.filter("cuts", lambda s: F.shiftright(s.crc, 20) == F.col("id")).alias("own"),
    )
    # BINS rows and at most MAX_RANGES * 2 splitters: bounded whatever the input
    placed = rows.withColumn("bin", F.shiftright("crc", 20)).join(F.broadcast(bins), "bin")
    after = F.size(F.filter("own", lambda s: s <= F.struct(*ORDER)))
    return placed.withColumn("range", F.col("before") + after).drop("bin", "before", "own")


def split_points(rows: DataFrame, n_rows: int, total: int, overfull: float = OVERFULL, samples: int = SAMPLES) -> list[Key]:
    ranges = max(MIN_RANGES, min(MAX_RANGES, n_rows // RANGE_ROWS))
    take = lambda df: [(tuple(r[c] for c in ORDER), r.n) for r in df.collect()]
    splitters = quantiles(take(drawn(rows, F.lit(ranges * samples / total), 0)), ranges)
    mean = total / ranges
    for seed in range(1, ROUNDS + 1):
        sizes = ranged(rows, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.min(F.struct(*ORDER)).alias("low"), F.max(F.struct(*ORDER)).alias("high"))
        full = [r for r in sizes.filter((F.col("bytes") > overfull * mean) & (F.col("low") != F.col("high"))).collect() if len(splitters) < 2 * MAX_RANGES]
        if not full:
            break
        rate = F.create_map(*[F.lit(x) for r in full for x in (r.range, 4.0 * samples / mean)])[F.col("range")]
        wanted = ranged(rows, splitters).filter(F.col("range").isin([r.range for r in full]))
        again = drawn(wanted.withColumn("rate", rate), F.col("rate"), seed).select(*ORDER, "n")
        found = take(again)
        for r in full:
            low, high = tuple(r.low), tuple(r.high)
            own = [s for s in found if low <= s[0] <= high]
            splitters += quantiles(own, max(2, round(r.bytes / mean))) or [high]
        splitters = sorted(set(splitters))
    return splitters


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", overfull: float = OVERFULL, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, size, crc, shard, slot) of every document; shards are stretches of near-equal bytes, slots count from 0 in each."""
    rows = written(sized(docs, id_col, text_col), "shard-keys")
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if not whole.n:
        return rows.select("doc_id", "size", "crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = ranged(rows, split_points(rows, whole.n, whole.bytes, overfull, samples))
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # one row for each range: bounded, and small enough for one task and a broadcast
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    inside = Window.partitionBy("range").orderBy(*ORDER)
    located = placed.withColumn("rn", F.row_number().over(inside)).withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(base), "range")
    middle = 2 * (F.col("bytes_before") + F.col("run")) - F.col("size")
    shard = F.least(F.floor(middle / F.lit(2 * whole.bytes / shards)), F.lit(shards - 1)).cast("int")
    out = written(located.select("doc_id", "size", "crc", shard.alias("shard"), (F.col("rows_before") + F.col("rn") - 1).alias("place")), "shard-places")
    forget(rows)
    first = out.groupBy("shard").agg(F.min("place").alias("first"))
    return out.join(F.broadcast(first), "shard").select("doc_id", "size", "crc", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents to one folder for each shard. Rows find their shard by id, text size and checksum."""
    own = {c: fresh(docs, f"{c}_") for c in ("id", "size", "crc")}
    name = fresh(docs, "shard")
    places = assign(docs, shards, id_col, text_col)
    # equal rows stay together
    once = places.groupBy(F.col("doc_id").alias(own["id"]), F.col("size").alias(own["size"]), F.col("crc").alias(own["crc"])).agg(F.min("shard").alias(name))
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    same = docs[id_col].cast("long").eqNullSafe(once[own["id"]]) & (F.octet_length(raw).cast("long") + 1 == once[own["size"]]) & (F.crc32(raw).cast("long") == once[own["crc"]])
    docs.join(once, same).drop(*own.values()).write.partitionBy(name).mode("overwrite").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bytes FROM documents),
k AS (
    SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INT)])), 4294967295) AS crc FROM b, tab),
o AS (
    SELECT doc_id, size, crc, row_number() OVER (ORDER BY crc, doc_id NULLS FIRST, size) AS place,
           sum(size) OVER (ORDER BY crc, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS run, sum(size) OVER () AS total FROM k),
s AS (SELECT *, CAST(least(floor((2 * run - size) / (2 * total / 16)), 15) AS INT) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM s
"""
