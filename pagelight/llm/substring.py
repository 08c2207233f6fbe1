"""Substring deduplication by Rabin-Karp hashes of every token window, counted in Spark.

Documents are dealt into groups by id and text, once; every later step reads that exchange again.

1. Each group hashes every window of ``window`` consecutive words of its documents (a Rabin-Karp polynomial
   over 64-bit word hashes, cut to ``SPARE`` bits more than the table has groups) and sends each hash once,
   packed by ranges of hash values, without ids: about three bytes a window, however often it stands there.
2. Each range is counted: hashes that several groups hold go back to these groups.
3. Only for windows of these hashes a group sends a 64-bit hash of the words' text itself with its smallest
   doc_id, so that windows which merely share a short hash part here.
4. Each range answers the groups whose smallest document is not the smallest of all.
5. A group marks the windows so answered, and those that a smaller document of its own holds; marked windows
   merge into maximal removal intervals.

So a passage in a third of all documents costs each group one entry. Groups, ranges and the tasks that take
them grow in number with the input, tasks up to ``MAX_TASKS``, and a task holds one group or range at a time; the
share of windows that reach step 3 for nothing stays below 0.1 %. Two different windows count as equal only if
both the polynomial and the hash of their text collide, 98 bits or more in all: at 10^13 windows, where the
polynomial has 54 bits, 10^-9 such pairs are expected.

Defined results: a null or empty text has no words; a text of fewer than ``window`` words loses
nothing; rows with the same doc_id are never judged against each other; a null doc_id counts as larger
than any other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import plan_bytes

WINDOW = 13
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a window's hash beyond those that name its range. Sources of a range are numbered in 24 bits.
SPARE = 30
#: Bytes of the stored table for each group, and for each range of hash values.
GROUP_BYTES = 3 << 20
#: Groups or ranges for each task, and tasks of a shuffle at most.
TASK_GROUPS, MAX_TASKS = 4, 20_000
NO_ID, BELOW = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of each window of word hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, window):
        out *= BASE
        out += words[j : j + n]
    return mixed(out)


def text_hashes(words: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    """Hash of the words' text for each window that begins at one of ``at``. No word holds a blank, so the text names the words."""
    from xxhash import xxh3_64_intdigest

    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    text = b" ".join(words)
    spans = zip(starts[at].tolist(), (ends[at + window - 1] - 1).tolist(), strict=True)
    return np.fromiter((xxh3_64_intdigest(text[a:z]) for a, z in spans), np.uint64, len(at))


def pack(x: np.ndarray) -> tuple[int, int, bytes]:
    """Ascending integers as (first, bytes for each step, steps)."""
    step = np.diff(x).astype(np.uint64)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return int(x[0]), width, step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: tuple[int, int, bytes], kind=np.uint64) -> np.ndarray:
    first, width, raw = packed
    step = np.zeros((len(raw) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.empty(len(step) + 1, np.uint64)
    out[0] = np.array(first, kind).view(np.uint64)
    out[1:] = step.reshape(-1).view(np.uint64)
    return np.cumsum(out, dtype=np.uint64).view(kind)


def pack_ids(ids: np.ndarray) -> tuple[int, int, bytes]:
    """Any integers as (smallest, bytes for each, differences from it)."""
    low = int(ids.min())
    off = (ids - low).astype(np.uint64)
    width = max(1, (int(off.max()).bit_length() + 7) // 8)
    return low, width, off.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ids(packed: tuple[int, int, bytes]) -> np.ndarray:
    low, width, raw = packed
    off = np.zeros((len(raw) // width, 8), np.uint8)
    off[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return (off.reshape(-1).view(np.uint64) + np.array(low, np.int64).view(np.uint64)).view(np.int64)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return list(zip(heads.tolist(), [*heads[1:].tolist(), len(x)], strict=True))


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending, each once: sorting beats the hash table that ``numpy.unique`` fills."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``among``, an ascending array: a bit table first, binary search for what it lets through."""
    if not len(among) or not len(x):
        return np.zeros(len(x), bool)
    size = np.uint64((1 << max(10, min(24, len(among).bit_length() + 4))) - 1)
    table = np.zeros(int(size) + 1, bool)
    table[among & size] = True
    out = table[x & size]
    maybe = np.flatnonzero(out)
    near = np.minimum(np.searchsorted(among, x[maybe]), len(among) - 1)
    out[maybe] = among[near] == x[maybe]
    return out


class Group:
    """The documents of a group: words, ids and short window hashes, and keys of the windows that matter."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], bits: int, window: int) -> None:
        self.window = window
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.words = [(t or b"").split() for t in texts]
        cut = np.uint64(64 - bits - SPARE)
        self.hashes = [window_hashes(word_hashes(w), window) >> cut if len(w) >= window else np.empty(0, np.uint64) for w in self.words]
        self.flat = np.concatenate([*self.hashes, np.empty(0, np.uint64)])

    def repeated(self) -> np.ndarray:
        """Hashes that stand more than once here, ascending, with repeats."""
        x = np.sort(self.flat)
        return x[1:][x[1:] == x[:-1]]

    def keys(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text hash, document's place, window's place) of every window with a hash in ``among``."""
        hit = np.flatnonzero(member(self.flat, among))
        stops = np.cumsum([len(h) for h in self.hashes], dtype=np.int64)
        doc = np.searchsorted(stops, hit, side="right")
        at = hit - np.concatenate([[0], stops])[doc]
        texts = [text_hashes(self.words[int(doc[a])], at[a:z], self.window) for a, z in runs(doc)]
        return self.flat[hit], np.concatenate([*texts, np.empty(0, np.uint64)]), doc, at


def smallest(h: np.ndarray, text: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, head, smallest id) of entries in the order of hash, text hash and id; heads begin a key."""
    order = np.lexsort((ids, text, h))
    h, text, ids = h[order], text[order], ids[order]
    head = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
    return order, head, ids[head][np.cumsum(head) - 1] if len(h) else ids


def ranged(h: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, begin, end) of ascending hashes."""
    key = h >> np.uint64(SPARE)
    return [(int(key[a]), a, z) for a, z in runs(key)]


def send_hashes(group: Group) -> Iterator[tuple[int, bytes]]:
    h = distinct(group.flat)
    for key, a, z in ranged(h):
        yield key, pickle.dumps(pack(h[a:z]))


def count_hashes(key: int, sources: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(group, hashes): those of a range that several groups hold."""
    low, spare = np.uint64((1 << SPARE) - 1), np.uint64(SPARE)
    parts = [((unpack(pickle.loads(p)) & low) << np.uint64(24)) | np.uint64(s) for s, p in zip(sources, payloads, strict=True)]
    x = np.sort(np.concatenate(parts))
    h, source = x >> np.uint64(24), x & np.uint64((1 << 24) - 1)
    same = h[1:] == h[:-1]
    held = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    y = np.sort((source[held] << spare) | h[held])
    for a, z in runs(y >> spare):
        yield int(y[a] >> spare), pickle.dumps(pack((y[a:z] & low) | np.uint64(key << SPARE)))


def send_keys(group: Group, payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(range, keys with the smallest id) of the windows whose hash other groups hold too."""
    h, text, doc, _ = group.keys(np.sort(np.concatenate([unpack(pickle.loads(p)) for p in payloads])))
    order, head, first = smallest(h, text, group.ids[doc])
    h, text, first = h[order][head], text[order][head], first[head]
    for key, a, z in ranged(h):
        yield key, pickle.dumps((pack(h[a:z]), text[a:z].tobytes(), pack_ids(first[a:z])))


def count_keys(sources: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(group, keys) of which another group holds a smaller document."""
    parts = [pickle.loads(p) for p in payloads]
    hs = [unpack(h) for h, _, _ in parts]
    h, text = np.concatenate(hs), np.concatenate([np.frombuffer(t, np.uint64) for _, t, _ in parts])
    ids, source = np.concatenate([unpack_ids(i) for _, _, i in parts]), np.repeat(np.array(sources, np.int64), [len(x) for x in hs])
    order, _, first = smallest(h, text, ids)
    late = order[ids[order] > first]
    late = late[np.argsort(source[late], kind="stable")]
    for a, z in runs(source[late]):
        own = late[a:z]
        yield int(source[own[0]]), pickle.dumps((pack(h[own]), text[own].tobytes()))


def marked(group: Group, payloads: list[bytes]) -> list[np.ndarray | None]:
    """For each document where its marked windows begin, as booleans; None where it has none."""
    told = [pickle.loads(p) for p in payloads]
    far_h = np.concatenate([*(unpack(h) for h, _ in told), np.empty(0, np.uint64)])
    far_text = np.concatenate([*(np.frombuffer(t, np.uint64) for _, t in told), np.empty(0, np.uint64)])
    h, text, doc, at = group.keys(np.sort(np.concatenate([far_h, group.repeated()])))
    # a key told from afar counts as held by a document below all others
    ids = np.concatenate([group.ids[doc], np.full(len(far_h), BELOW)])
    order, _, first = smallest(np.concatenate([h, far_h]), np.concatenate([text, far_text]), ids)
    late = np.zeros(len(ids), bool)
    late[order] = ids[order] > first
    gone = late[: len(h)]
    out: list[np.ndarray | None] = [None] * len(group.ids)
    doc, at = doc[gone], at[gone]
    for a, z in runs(doc):
        d = int(doc[a])
        out[d] = np.zeros(len(group.hashes[d]), bool)
        out[d][at[a:z]] = True
    return out


def removal(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Words covered by the windows that begin where ``starts`` is true."""
    edge = np.zeros(n_words + 1, np.int64)
    edge[: len(starts)] += starts
    edge[window : window + len(starts)] -= starts
    return np.cumsum(edge[:-1]) > 0


def intervals(covered: np.ndarray) -> list[dict]:
    edge = np.diff(np.r_[0, covered.astype(np.int8), 0])
    return [{"start": int(a), "stop": int(z)} for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): word intervals that go, and the words that stay, joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bits = max(4, min(24, (plan_bytes(docs, text_col) // GROUP_BYTES).bit_length()))
    sent = pa.schema([("key", pa.int64()), ("grp", pa.int64()), ("payload", pa.binary())])
    shape = "key long, grp long, payload binary"
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.string())])

    def table(made: list[tuple[int, int, bytes]]) -> pa.Table:
        columns = zip(*made, strict=True) if made else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, sent, strict=True)], schema=sent)

    def group(docs: pa.Table) -> Group:
        return Group(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist(), bits, window)

    def hashes(docs: pa.Table) -> pa.Table:
        own = docs.column("grp")[0].as_py()
        return table([(key, own, p) for key, p in send_hashes(group(docs))])

    def shared(sent: pa.Table) -> pa.Table:
        key = sent.column("key")[0].as_py()
        return table([(key, g, p) for g, p in count_hashes(key, sent.column("grp").to_pylist(), sent.column("payload").to_pylist())])

    def keys(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return table([])
        own = told.column("grp")[0].as_py()
        return table([(key, own, p) for key, p in send_keys(group(docs), told.column("payload").to_pylist())])

    def late(sent: pa.Table) -> pa.Table:
        key = sent.column("key")[0].as_py()
        return table([(key, g, p) for g, p in count_keys(sent.column("grp").to_pylist(), sent.column("payload").to_pylist())])

    def apply(docs: pa.Table, told: pa.Table) -> pa.Table:
        own = group(docs)
        made: list[list] = [[], [], [], []]
        for words, starts in zip(own.words, marked(own, told.column("payload").to_pylist()), strict=True):
            gone, n_gone, kept = [], 0, words
            if starts is not None:
                covered = removal(starts, len(words), window)
                gone, n_gone = intervals(covered), int(covered.sum())
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            for column, value in zip(made, (len(words), n_gone, gone, b" ".join(kept).decode()), strict=True):
                column.append(value)
        return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(), *(pa.array(x, f.type) for x, f in zip(made, list(out)[1:], strict=True))], schema=out)

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, (1 << bits) // TASK_GROUPS))
    by = lambda df, column: df.repartition(tasks, column).groupBy(column)
    dealt = by(rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << bits))), "grp")
    held = by(by(dealt.applyInArrow(hashes, shape), "key").applyInArrow(shared, shape), "grp")
    told = by(by(dealt.cogroup(held).applyInArrow(keys, shape), "key").applyInArrow(late, shape), "grp")
    return dealt.cogroup(told).applyInArrow(apply, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept string")


def digest(docs: DataFrame) -> DataFrame:
    done = remove_repeats(docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words WHERE len(ws) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (
    SELECT DISTINCT doc_id, i + j AS pos
    FROM (SELECT w.doc_id, w.i FROM windows w JOIN firsts f ON w.win = f.win AND w.doc_id > f.first_doc), range(0, 13) t(j)),
per_word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM words),
left_over AS (
    SELECT p.doc_id, string_agg(p.w, ' ' ORDER BY p.pos) AS kept, count(*) AS n_kept
    FROM per_word p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos WHERE g.pos IS NULL GROUP BY p.doc_id)
SELECT words.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN left_over ON words.doc_id = left_over.doc_id
"""
