"""Labelled rows for the classifiers: a bounded, deterministic sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``; null ids are in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def by_hash(rows: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most ``n`` rows, the same ones in every run: those whose hashed keys come first."""
    return rows.orderBy(F.xxhash64(*cols), *cols).limit(n)


def numbers_of(docs: DataFrame, ids: DataFrame, body: Callable[[str], bytes], id_col: str, text_col: str) -> list[tuple[int, bytes, int]]:
    """(id, body(text), label) of the sampled ids, in the order of their ids; one text speaks for an id.

    ``ids`` holds a bounded number of rows, ``body`` returns a bounded number of bytes and runs where the texts are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("mark", pa.int64()), ("found", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([body(x.as_py()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), batch.column("mark"), found], schema=schema)

    chosen = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("mark"), "text")
    done = chosen.mapInArrow(run, "doc_id long, label int, mark long, found binary").groupBy("doc_id", "label").agg(F.min_by("found", "mark").alias("found"))
    return sorted((r.doc_id, bytes(r.found), r.label) for r in done.collect())


def labelled(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label): one row for each labelled document; rows without id or label give none, of clashing labels the larger holds."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))
