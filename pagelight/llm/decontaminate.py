"""Benchmark decontamination by a prefix-filtered join, on DataFrame functions only.

A benchmark item becomes windows of ``window`` consecutive words (an item of fewer words is one window),
a window the set of its placed shingles of up to ``shingle`` words. All shingles of a window must stand in
a document that holds it, so one of them is a sufficient prefix: the rarest, by how often its first word
stands in the corpus, from one pass that counts the benchmark's words. Documents then build shingles only
where such a first word stands, with the words around them; an equi-join with the prefix shingles,
positional and length bounds, and the comparison of the whole window with the words around the place
decide. So only places of prefix shingles are ever joined or shuffled, never texts and never all shingles.
Up to ``inline_words`` first words are part of the scan's filter; beyond, every shingle is joined with the
prefix shingles, of which Spark broadcasts a small table or builds a Bloom filter.

Defined results: a null text has no words; an item without words has no windows; items with equal
item_id count once, items without one count as one that has no name in the list; equal documents each give a row and rows that share a doc_id but not the text are
judged apart; empty tables give empty results or clean documents; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelight.llm.common import ascii_lower, forget, fresh, if_small, written

WINDOW, SHINGLE = 10, 5
#: First words that the scan itself looks for.
INLINE_WORDS = 10_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; a null text has none."""
    lowered = ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def windows_of(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(item, win, len, k): each item's windows as word arrays, with their length and the length of their shingles."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    spread = own.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(window)).alias("win")).distinct()
    return spread.withColumn("len", F.size("win")).withColumn("k", F.least(F.lit(shingle), F.col("len")))


def prefixes(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """(win, len, k, at, word, gram): of each window the shingle whose first word is rarest in the corpus; none if a word of the window stands nowhere."""
    one = wins.select("win", "len", "k").distinct()
    vocabulary = written(one.select(F.explode("win").alias("word")).distinct(), "benchmark-vocabulary")
    often = rows.select(F.explode("words").alias("word")).join(if_small(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("often"))
    often = written(often, "benchmark-words")
    forget(vocabulary)
    rated = one.select("win", "len", "k", F.posexplode("win").alias("at", "word")).join(often, "word", "left")
    rare = F.min(F.when(F.col("at") <= F.col("len") - F.col("k"), F.struct("often", "word", "at"))).alias("rare")
    rated = rated.groupBy("win", "len", "k").agg(rare, F.count("often").alias("found")).filter(F.col("found") == F.col("len"))
    rated = rated.select("win", "len", "k", F.col("rare.at").alias("at"), F.col("rare.word").alias("word"))
    return rated.withColumn("gram", F.array_join(F.slice("win", F.col("at") + 1, F.col("k")), " "))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", inline_words: int = INLINE_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, mark, start, len, win): every place where a window of an item stands; and the windows (item, win) and other tables to forget in the end.

    ``mark`` tells apart different texts under one doc_id.
    """
    wins = written(windows_of(items, window, shingle, item_col, item_text), "windows")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), words_of(F.col(text_col)).alias("words"))
    prefix = written(prefixes(rows, wins), "prefix-shingles")
    lengths = sorted(r.k for r in prefix.select("k").distinct().collect())  # at most ``shingle`` numbers
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(rows.dtypes)['doc_id']}, mark long, start int, len int, win array<string>"), [wins, prefix]
    firsts = [r.word for r in prefix.select("word").distinct().limit(inline_words + 1).collect()]
    words, size = F.col("words"), F.size("words")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    if len(firsts) <= inline_words:
        places = F.filter(places, lambda i: F.get(words, i).isin(firsts))

    def near(i: Column) -> Column:
        """The place with the shingles that begin there and the words before and behind it."""
        low = F.greatest(F.lit(0), i - (window - 1))
        grams = F.array(*[F.when(i + k <= size, F.array_join(F.slice(words, i + 1, F.lit(k)), " ")) for k in lengths])
        return F.struct(i.alias("pos"), low.alias("low"), F.slice(words, low + 1, i - low + window).alias("around"), grams.alias("grams"))

    spread = rows.select("doc_id", "mark", F.explode(F.transform(places, near)).alias("p")).select("doc_id", "mark", "p.pos", "p.low", "p.around", F.explode("p.grams").alias("gram")).filter("gram IS NOT NULL")
    met = spread.join(if_small(prefix.select("gram", "at", "len", "win")), "gram").withColumn("start", F.col("pos") - F.col("at"))
    held = met.filter((F.col("start") >= 0) & (F.slice("around", F.greatest(F.lit(1), F.col("start") - F.col("low") + 1), F.col("len")) == F.col("win")))
    return held.select("doc_id", "mark", "start", "len", "win").distinct(), [wins, prefix]


def hits(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, mark, n_hit, n_items, items) of every document in which a window of an item stands."""
    found, (wins, *made) = occurrences(docs, items, **options)
    found = written(found, "occurrences")
    for df in made:
        forget(df)
    order = Window.partitionBy("doc_id", "mark").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_id", "mark", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    fresh = spans.withColumn("before", F.coalesce(F.max("stop").over(order), F.lit(0)))
    hit = fresh.groupBy("doc_id", "mark").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("n_hit"))
    named = found.select("doc_id", "mark", "win").distinct().join(wins.select("item", "win"), "win").select("doc_id", "mark", "item").distinct()
    named = named.groupBy("doc_id", "mark").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    return hit.alias("h").join(named.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.mark") == F.col("i.mark"))).select("h.doc_id", "h.mark", "n_hit", "n_items", "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items) of every document; an item without id counts, but has no name in ``items``."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    joined = rows.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.mark") == F.col("f.mark")), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("d.doc_id", "n_words", number("n_hit"), number("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(fresh(docs, "doc_")), F.col("mark").alias(fresh(docs, "mark_")))
    doc, mark = (found[c] for c in found.columns)
    return docs.join(found, docs[id_col].eqNullSafe(doc) & (F.xxhash64(docs[text_col].cast("string")) == mark), "left_anti")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
    SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS win
    FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (
    SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)),
found AS (SELECT p.doc_id, p.i, p.n, w.item FROM places p JOIN wins w ON p.n = w.n AND p.win = w.win),
hit AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN named ON dw.doc_id = named.doc_id
"""
