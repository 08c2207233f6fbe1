"""Personal data: pattern matches, widened by bootstrapped contextual extraction, on DataFrame functions only.

Base spans come from fixed patterns. They seed the bootstrap: every base span, of any kind and as a whole,
and every identifier-like token outside them (a run of non-blank characters with a digit, an at sign, an
underscore or an inner dot or bracket) stands between a left and a right word, its lexical patterns. In each
round a pattern's confidence is the share of its occurrences that are known (base spans, or discovered
before), and it counts once ``support`` distinct known ones back it; a token's confidence is one less the
product of what its patterns doubt. Tokens at ``accept`` or more with ``MIN_CHARS`` characters and
``MIN_DIGITS`` digits at least are known in the next round, until a round finds no more; weaker ones, such
as a bare number, teach nothing elsewhere. At last every identifier-like token beside a pattern of high
confidence is a span of kind ``id``. Patterns and tokens are counted where they stand, so a frequent word
is added up before it is shuffled, and whatever grows stays in Spark. A context word is the nearest word on
that side, of any length, with neither digit nor line break between.

Work grows with a text's length, not with its square: positions are running sums by chunks of ``CHUNK``
matches, contexts come from the pieces between neighbouring matches, and which tokens lie in base spans is
told by one ordered window over a text's spans.

Defined results: a null text is the empty one; equal rows each give a row; rows that share a doc_id but
not the text are apart; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelight.llm.common import ascii_lower, forget, fresh, written

#: Fixed patterns. Possessive forms match what the plain ones match, without recursion; a match begins at the start of a run or where the last one ended.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
ORDER = [*KINDS, "id"]
BYTE = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
MARK = r"(?:[0-9@_]|(?<=[A-Za-z0-9])[.\[(](?=[A-Za-z0-9]))"
TOKEN = rf"(?<!\S)\S*?{MARK}\S*+"
LEFT = r"(?<!\p{L})(\p{L}++)[^\p{L}\p{N}\n]*+$"
RIGHT = r"^[^\p{L}\p{N}\n]*+(\p{L}++)(?!\p{N})"
MIN_CHARS, MIN_DIGITS = 6, 4
SUPPORT, CONFIDENT, ACCEPT = 3, 0.8, 0.9
#: Matches of a text that are folded one by one.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(xs: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each of an integer array's elements what ``both`` (a sum, a maximum) makes of all up to it, from zero; by chunks, as each step of a fold copies its result."""
    cut = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda k: F.slice(xs, k * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<int>>"))

    def scan(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return let(both(acc.at, x), lambda now: F.struct(now.alias("at"), F.concat(acc.out, F.array(now)).alias("out")))

        return F.aggregate(part, first, step, lambda acc: acc.out)

    def joined_(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), both))
        return let(F.concat(F.array(F.lit(0)), scan(totals, F.lit(0))), lambda starts: F.flatten(F.transform(chunks, lambda c, k: scan(c, F.get(starts, k)))))

    return let(cut, joined_)


def word(text: Column, pattern: str) -> Column:
    return F.nullif(ascii_lower(F.regexp_extract(text, pattern, 1)), F.lit(""))


def matches(text: Column, pattern: str, good: Callable[[Column], Column]) -> Column:
    """The good matches of ``pattern`` as structs (start, stop, what, left, right), in code points, with the words beside them."""

    def located(v: Column) -> Column:
        lengths = F.transform(v.found, lambda m, i: F.length(m) + F.length(F.get(v.gaps, i)))
        none = F.lit("")

        def place(ends: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                before = F.concat(F.coalesce(F.get(v.found, i - 1), none), F.get(v.gaps, i))
                after = F.concat(F.get(v.gaps, i + 1), F.coalesce(F.get(v.found, i + 1), none))
                end = F.get(ends, i)
                return F.when(good(m), F.struct((end - F.length(m)).alias("start"), end.alias("stop"), m.alias("what"), word(before, LEFT).alias("left"), word(after, RIGHT).alias("right")))

            return F.filter(F.transform(v.found, one), lambda x: x.isNotNull())

        return let(running(lengths, lambda a, x: a + x), place)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), located)


def luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.floor(2 * d.cast("int") / 10).cast("int") + (2 * d.cast("int")) % 10))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, what: Column) -> Column:
    if kind == "ip":
        return what.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")
    digits = F.regexp_replace(what, r"[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,ord:int,stop:int>>"
PLACE = "array<struct<start:int,ord:int,stop:int,from:int,to:int,what:string,left:string,right:string>>"


def place(s: Column, ord_: int, begin: Column, end: Column, what: Column) -> Column:
    """Where it is, of which kind, from where to where it may overlap others, and between which words."""
    return F.struct(begin.alias("start"), F.lit(ord_).alias("ord"), end.alias("stop"), s.start.alias("from"), s.stop.alias("to"), what.alias("what"), s.left.alias("left"), s.right.alias("right"))


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind."""
    own = F.transform(matches(text, KINDS[kind], lambda m: valid(kind, m)), lambda s: place(s, ORDER.index(kind), s.start, s.stop, s.what))
    need = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    return F.when(need & text.rlike("[0-9]" if kind != "email" else "@"), own).otherwise(F.array().cast(PLACE))


def tokens_of(text: Column) -> Column:
    """Identifier-like tokens, cut to their first and last letter or digit."""

    def core(s: Column) -> Column:
        what = F.regexp_extract(s.what, r"[A-Za-z0-9](?:.*[A-Za-z0-9])?", 0)
        begin = s.start + F.length(F.regexp_extract(s.what, r"^[^A-Za-z0-9]*+", 0))
        return place(s, len(KINDS), begin, begin + F.length(what), what)

    return F.when(text.rlike(MARK), F.transform(matches(text, TOKEN, lambda m: F.lit(True)), core)).otherwise(F.array().cast(PLACE))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s.ord + 1), s.start.cast("string"), s.stop.cast("string"))), ",")


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, email, ip, card, phone, base, places): spans by kind, and every span and identifier-like token with its context."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = rows.withColumns({k: base_spans(F.col("text"), k) for k in KINDS} | {"tokens": tokens_of(F.col("text"))})
    plain = lambda c: F.transform(c, lambda s: F.struct(s.start.alias("start"), s.ord.alias("ord"), s.stop.alias("stop")))
    every = F.concat(*[F.col(k) for k in KINDS])
    return rows.select("doc_id", "mark", *[plain(F.col(k)).alias(k) for k in KINDS], plain(every).alias("base"), F.concat(every, F.col("tokens")).alias("places"))


def apart(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, start, stop, what, left, right, known) of base spans that no other one covers, and of tokens that no base span touches."""
    one = rows.filter(F.size("places") > 0).groupBy("doc_id", "mark").agg(F.first("places").alias("places"))
    flat = one.select("doc_id", "mark", F.explode("places").alias("p")).select("doc_id", "mark", "p.*")
    token = F.col("ord") == len(KINDS)
    # a base span begins in a token: it follows its token at once, and the tokens that it reaches come after it
    order = Window.partitionBy("doc_id", "mark").orderBy("from", token, F.desc("to"), "ord")
    before = F.max(F.when(~token, F.col("to"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumns({"before": F.coalesce(before, F.lit(0)), "next": F.lead(F.when(~token, F.col("from"))).over(order)})
    free = (F.col("before") <= F.col("from")) & F.coalesce(F.col("next") >= F.col("to"), F.lit(True)) & F.col("what").rlike(MARK)
    return flat.filter(F.when(token, free).otherwise(F.col("before") < F.col("to"))).select("doc_id", "mark", "start", "stop", "what", "left", "right", (~token).alias("known"))


def confident(edges: DataFrame, known: DataFrame, support: int, confident_: float, accept: float) -> DataFrame:
    """High-confidence patterns of the graph ``edges`` (pattern, what, n), seeded by ``known`` (what), at the fixed point of the rounds."""
    strong = (F.length("what") >= MIN_CHARS) & (F.length(F.regexp_replace("what", "[^0-9]", "")) >= MIN_DIGITS)
    known = written(known, "pii-known")
    while True:
        rated = edges.join(known.withColumn("is", F.lit(True)), "what", "left")
        patterns = rated.groupBy("pattern").agg((F.sum(F.when(F.col("is"), F.col("n")).otherwise(0)) / F.sum("n")).alias("conf"), F.count(F.when(F.col("is"), 1)).alias("support"))
        patterns = written(patterns.filter((F.col("support") >= support) & (F.col("conf") >= confident_)).select("pattern", "conf"), "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))))
        more = edges.filter(strong).join(patterns, "pattern").groupBy("what").agg((1 - doubt).alias("conf")).filter(F.col("conf") >= accept).select("what")
        more = written(more.join(known, "what", "left_anti"), "pii-more")
        if more.isEmpty():
            return patterns.select("pattern")
        grown = written(known.unionByName(more), "pii-known")
        for df in (known, more, patterns):
            forget(df)
        known = grown


def found_by_context(rows: DataFrame, support: int = SUPPORT, confident_: float = CONFIDENT, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, mark, extra): spans that the bootstrap adds. ``rows`` come from ``marked``."""
    places = written(apart(rows), "pii-tokens")
    beside = places.select("doc_id", "mark", "start", "stop", "what", "known", F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"))).alias("pattern")).filter("pattern IS NOT NULL")
    edges = written(beside.groupBy("pattern", "what").agg(F.count("*").alias("n")), "pii-edges")
    seeds = places.filter("known").select("what").distinct()
    patterns = confident(edges, seeds, support, confident_, accept)
    new = beside.filter(~F.col("known")).join(patterns, "pattern", "left_semi").select("doc_id", "mark", "start", "stop").distinct()
    ord_ = F.lit(ORDER.index("id"))
    return new.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", ord_.alias("ord"), "stop")).alias("extra"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, mark, email, ip, card, phone, base, all): spans as (start, ord, stop), sorted; ord counts along ``ORDER``."""
    rows = written(marked(docs, id_col, text_col), "pii-spans")
    extra = found_by_context(rows, **options)
    both = rows.drop("places").alias("r").join(extra.alias("e"), F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.mark") == F.col("e.mark")), "left")
    own = [F.col(f"r.{c}") for c in ["doc_id", "mark", *KINDS, "base"]]
    return both.select(*own, F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))).alias("all"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets; overlapping spans by that of the first."""
    found = spans(docs, id_col, text_col, **options).filter(F.size("all") > 0).select(*[F.col(c).alias(fresh(docs, f"{c}_")) for c in ("doc_id", "mark", "all")]).distinct()
    doc, mark, every = (found[c] for c in found.columns)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    both = docs.join(found, docs[id_col].eqNullSafe(doc) & (F.xxhash64(text) == mark), "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in ORDER])

    def replaced(v: Column) -> Column:
        """v: spans, and how far each one and all before it reach. By chunks, as each cut walks from the start of its text."""
        reach = lambda i: F.coalesce(F.get(v.ends, i - 1), F.lit(0))

        def part(k: Column) -> Column:
            low, high = reach(k * CHUNK), F.get(v.ends, F.least((k + 1) * CHUNK, F.size(v.ends)) - 1)

            def one(piece: Column) -> Column:
                def cut(s: Column, j: Column) -> Column:
                    at = reach(k * CHUNK + j)
                    return F.when(s.start >= at, F.concat(F.substring(piece, at - low + 1, s.start - at), F.element_at(names, s.ord + 1))).otherwise(F.lit(""))

                return F.array_join(F.transform(F.slice(v.spans, k * CHUNK + 1, F.lit(CHUNK)), cut), "")

            return let(F.substring(text, low + 1, high - low), one)

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v.ends) - 1) / CHUNK).cast("int")), part)
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(v.ends, -1) + 1, F.length(text)))

    whole = let(F.struct(every.alias("spans"), running(F.transform(every, lambda s: s.stop), lambda a, x: F.greatest(a, x)).alias("ends")), replaced)
    return both.select(*[F.when(every.isNull(), docs[c]).otherwise(whole).alias(c) if c == text_col else docs[c] for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans(docs).select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
