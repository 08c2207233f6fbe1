"""Recognised words to a chosen page text: reconstruction, scoring, candidate search, script probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelight.functions import dims
from pagelight.functions import text as T

EARLY_STOP, FALLBACK_BELOW = 85.0, 40.0


def _kept(words: DataFrame) -> DataFrame:
    return words.withColumn("text", T.strip(F.col("text"))).filter("text <> ''")


def _placed() -> Column:
    """The words of a group with their places, in input order."""
    return F.sort_array(F.collect_list(F.struct(F.struct("block_num", "par_num").alias("par"), "line_num", "ord", "text")))


def _joined(placed: Column) -> Column:
    """One pass over ``_placed`` words: what parts a word from the one before it depends on their places alone."""

    def one(word: Column, i: Column) -> Column:
        last = F.get(placed, i - 1)
        near = F.when(word["line_num"].eqNullSafe(last["line_num"]), " ").otherwise("\n")
        return F.concat(F.when(i == 0, "").when(word["par"].eqNullSafe(last["par"]), near).otherwise("\n\n"), word["text"])

    return T.strip(F.array_join(F.transform(placed, one), ""))


def rebuilt(words: Column) -> Column:
    """What ``reconstruct`` makes of an array of all words of a key, each (block_num, par_num, line_num, ord, text), without a row for each."""
    placed = F.transform(words, lambda w: F.struct(F.struct(w["block_num"].alias("block_num"), w["par_num"].alias("par_num")).alias("par"), w["line_num"].alias("line_num"), w["ord"].alias("ord"), T.strip(w["text"]).alias("text")))
    return T.bound(F.sort_array(F.filter(placed, lambda w: w["text"] != "")), _joined)


def line_text(line: Column) -> Column:
    """The words of a line, parted by white space of ASCII, each stripped and joined by blanks: any white space around such a part is one blank."""
    return T.strip(F.regexp_replace(line, r"(?U)[\s&&[^ \t\r\f\n]]*+[ \t\r\f\n]\s*+", " "))


def reconstruct(words: DataFrame, key: str) -> DataFrame:
    """(key, text): words joined by blanks in input order, lines by one break, paragraphs by two.

    ``words`` has key, block_num, par_num, line_num, ord and text. Words are gathered by key before the one exchange.
    """
    return _kept(words).groupBy(key).agg(T.bound(_placed(), _joined).alias("text"))


def heard(words: DataFrame, key: str) -> DataFrame:
    """``reconstruct`` and ``word_confidence`` of keys with a word that is not blank, from one aggregation of the words."""
    return _kept(words).groupBy(key).agg(T.bound(_placed(), _joined).alias("text"), *_confidence())


def _confidence() -> list[Column]:
    valid = (F.col("conf") >= 0) & ~T.blank(F.col("text"))
    tall = valid & (F.col("height") > 0)
    n, total = F.count(F.when(valid, 1)), F.sum(F.when(valid, F.col("conf")))
    return [
        n.alias("n_valid"),
        F.when(n > 0, total / n).otherwise(0.0).alias("avg_conf"),
        F.when(n > 0, F.count(F.when(valid & (F.col("conf") >= 50), 1)) / n).otherwise(0.0).alias("high_share"),
        F.count(F.when(tall, 1)).alias("n_heights"),
        F.coalesce(F.sum(F.when(tall, F.col("height"))), F.lit(0)).alias("h1"),
        F.coalesce(F.sum(F.when(tall, F.col("height") * F.col("height"))), F.lit(0)).alias("h2"),
    ]


def word_confidence(words: DataFrame, key: str) -> DataFrame:
    """Mean confidence and share of sure words, over words with a confidence, and the sums that line heights need."""
    return words.groupBy(key).agg(*_confidence())


def line_consistency(words: Column, lines: Column, n: Column, h1: Column, h2: Column) -> Column:
    """From words per line, and from the spread of line heights once there are four."""
    per = words / lines
    base = F.when(lines > 0, F.when((per >= 3) & (per <= 20), 0.95).when(per > 0, 0.70).otherwise(0.5)).otherwise(0.5)
    spread = F.sqrt(n * h2 - h1 * h1) / n / (h1 / n + 1e-5)
    return F.when(n >= 4, base * 0.6 + F.greatest(F.lit(0.0), 1 - spread) * 0.4).otherwise(base)


def target_match(target: Column, shares: dict[str, Column]) -> Column:
    """How well the text's script fits a target such as ``tam+eng``: any part with a share of .30 is enough."""
    known = F.create_map(*[x for code, share in shares.items() for x in (F.lit(code), share)])
    found = F.transform(F.split(F.lower(target), r"\+"), lambda c: F.coalesce(known[F.trim(c)], F.lit(0.0)))
    top = F.array_max(found)
    return F.when(top >= 0.30, 1.0).when(top >= 0.10, 0.7).otherwise(0.2)


CONFIDENCE = ["n_valid", "avg_conf", "high_share", "n_heights", "h1", "h2"]


def measured(pages: DataFrame) -> DataFrame:
    """Adds what a score needs of ``text`` itself; candidates that read the same text can share it."""
    made = T.with_scripts(pages, "text", False, "share_").withColumns({"ws": T.words(F.col("text")), "empty": T.blank(F.col("text"))})
    made = made.withColumns(T.statistics(F.col("text")) | {"word_count": F.when(F.col("empty"), 0).otherwise(F.size("ws"))})
    made = made.withColumns({"runs": T.garbage_runs(F.col("text")), "primary": F.greatest(*T.shares_of("share_").values())})
    return made.withColumns(
        {
            "valid_ratio": F.when(F.size("ws") > 0, F.size(F.filter("ws", lambda w: w.rlike(r"\p{L}"))) / F.size("ws")).otherwise(0.0),
            "length_ratio": F.when(F.size("ws") > 0, F.size(F.filter("ws", lambda w: F.length(w).between(2, 25))) / F.size("ws")).otherwise(0.0),
            "penalty": F.when(F.col("runs") > 0, F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("symbol_ratio") * 2) + F.col("runs") * 0.1)).otherwise(F.least(F.lit(1.0), F.col("symbol_ratio") * 2)),
            "volume": F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1), F.col("word_count")) + 1) / 1.8),
        }
    ).drop("ws")


def composed(made: DataFrame, key: str, target: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """Composite score of ``measured`` texts with word confidences beside them; columns named in ``also`` are handed on."""
    made = made.fillna(0, CONFIDENCE).withColumns(
        {
            "match": target_match(target, T.shares_of("share_")),
            "consistency": line_consistency(F.col("word_count"), F.col("line_count"), F.col("n_heights"), F.col("h1"), F.col("h2")),
        }
    )
    raw = F.col("avg_conf") * 0.30 + F.col("high_share") * 20.0 + F.col("valid_ratio") * 20.0 + F.col("primary") * F.col("match") * 15.0 + F.col("consistency") * F.col("length_ratio") * 15.0
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * (1 - F.col("penalty") * 0.5) * (0.6 + 0.4 * F.col("volume"))))
    empty = F.col("empty")
    zero = lambda c: F.when(empty, 0.0).otherwise(c)
    return made.select(
        key,
        *also,
        T.rounded(zero(F.col("avg_conf")), 2).alias("word_confidence_avg"),
        T.rounded(zero(F.col("valid_ratio")), 3).alias("valid_word_ratio"),
        T.rounded(zero(F.col("primary")), 3).alias("alpha_ratio"),
        T.rounded(F.when(empty, 1.0).otherwise(F.col("penalty")), 3).alias("symbol_penalty"),
        T.rounded(zero(F.col("consistency")), 3).alias("line_consistency"),
        T.rounded(zero(score), 2).alias("composite_score"),
        F.when(empty, 0).otherwise(F.col("word_count")).alias("total_words"),
        F.when(empty, 0).otherwise(F.col("char_count")).alias("total_chars"),
    )


def scored(pages: DataFrame, confidence: DataFrame, key: str, target: str | Column = "eng") -> DataFrame:
    """Composite score, 0 to 100, of recognised pages (key, text) with their word confidences, for a target script or a column of them."""
    target = F.lit(target) if isinstance(target, str) else target
    return composed(measured(pages.join(confidence, key, "left")), key, target)


def candidate_grid(pages: DataFrame, key: str, fast: bool, max_variants: int = 4, max_psms: int = 2) -> DataFrame:
    """Every candidate of a page in evaluation order: variants, then modes, then the page's languages."""
    max_variants, max_psms = (2, 1) if fast else (max_variants, max_psms)
    variants = sorted((e, name) for name, _, in_fast, e in dims.VARIANTS if e and (in_fast or not fast))[:max_variants]
    cells = [F.struct(F.lit(v * 100 + p * 10).alias("step"), F.lit(name).alias("variant"), F.lit(psm).alias("psm")) for v, (_, name) in enumerate(variants) for p, psm in enumerate(dims.PSMS[:max_psms])]
    spread = pages.select(key, F.posexplode(T.candidate_languages(F.col("script"))).alias("lang_ord", "lang"))
    return spread.select(key, "lang_ord", "lang", F.inline(F.array(*cells))).select(key, (F.col("step") + F.col("lang_ord")).alias("ord"), "variant", "psm", "lang")


def evaluated(candidates: DataFrame, key: str, stop: float = EARLY_STOP) -> DataFrame:
    """Candidates that a search in order reaches before one scores ``stop`` or more, that one included."""
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return candidates.withColumn("done", F.coalesce(F.max(F.col("score") >= stop).over(before), F.lit(False))).filter(~F.col("done")).drop("done")


def with_fallback(tried: DataFrame, fallback: DataFrame, pages: DataFrame, key: str, below: float = FALLBACK_BELOW) -> DataFrame:
    """Adds the fallback candidates of pages without a candidate at ``below`` or more."""
    best = tried.groupBy(key).agg(F.max("score").alias("best"))
    weak = pages.select(key).join(best, key, "left").filter(F.col("best").isNull() | (F.col("best") < below)).select(key)
    return tried.unionByName(fallback.join(weak, key, "left_semi"))


def best(candidates: DataFrame, key: str) -> DataFrame:
    """The best candidate of each page; of equals the one evaluated first."""
    others = [F.col(c) for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("score", -F.col("ord"))).alias("b")).select(key, "b.*")


def searched(candidates: DataFrame, key: str, stop: float = EARLY_STOP, below: float = FALLBACK_BELOW) -> DataFrame:
    """Candidates that ``evaluated`` and ``with_fallback`` leave, of candidates with ``is_fallback``, in one exchange and without making any twice."""
    first = F.col("is_fallback") == F.lit(False)
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    made = candidates.withColumn("_tried", F.coalesce(first & ~F.coalesce(F.max(first & (F.col("score") >= stop)).over(before), F.lit(False)), F.lit(False)))
    made = made.withColumn("_best", F.max(F.when(F.col("_tried"), F.col("score"))).over(Window.partitionBy(key)))
    return made.filter(F.col("_tried") | (F.col("is_fallback") & (F.col("_best").isNull() | (F.col("_best") < below)))).drop("_tried", "_best")


def probe_decision(evidence: DataFrame, key: str) -> DataFrame:
    """(key, script, ratio) from probe texts (key, probe_lang, probe_text, fallback_lang).

    Probes are looked at in order, a preferred script first. The first sure one decides; else the best
    probe of another script than English with five characters, else English with ten, else the fallback.
    """
    ord_ = F.array_position(F.array(*map(F.lit, dims.PROBE_ORDER)), F.col("probe_lang"))
    preferred = F.lower(F.coalesce("fallback_lang", F.lit("eng")))
    made = T.with_scripts(evidence, "probe_text", True).withColumn("chars", T.lookup_column("probe_lang", {c: F.col(f"n_{c}") for c in dims.LANGS}))
    made = made.withColumns(
        {
            "ord": F.when((F.col("probe_lang") == preferred) & (preferred != "eng"), 0).otherwise(ord_),
            "ratio": F.when(F.col("total") > 0, F.col("chars") / F.col("total")).otherwise(0.0),
            "given": ~T.blank(F.col("probe_text")),
            "fallback": F.when(preferred.isin(dims.LANGS), preferred).otherwise("eng"),
        }
    )
    eng = F.col("probe_lang") == "eng"
    sure = F.col("given") & F.when(eng, (F.col("chars") >= 20) & (F.col("ratio") >= 0.75)).otherwise((F.col("chars") >= 8) & (F.col("ratio") >= 0.35))
    likely = F.col("given") & ~eng & (F.col("chars") >= 5) & (F.col("ratio") >= 0.20)
    one = F.struct(F.col("probe_lang").alias("script"), "ratio")
    found = made.groupBy(key).agg(
        F.min_by(F.when(sure, one), F.when(sure, F.col("ord"))).alias("first"),
        F.max_by(F.when(likely, one), F.when(likely, F.struct("chars", "ratio", -F.col("ord")))).alias("strongest"),
        F.max(F.when(eng & F.col("given") & (F.col("chars") >= 10), one)).alias("english"),
        F.first("fallback").alias("fallback"),
    )
    chosen = F.coalesce("first", "strongest", "english", F.struct(F.col("fallback").alias("script"), F.lit(0.0).alias("ratio")))
    return found.select(key, chosen.alias("c")).select(key, "c.script", "c.ratio")


def process(pages: DataFrame, candidates: DataFrame, words: DataFrame, stop: float = EARLY_STOP, below: float = FALLBACK_BELOW) -> DataFrame:
    """One result row for each page (page_id, status, script): the whole search from recognised words to sentences.

    ``candidates`` has cand, page_id, ord, variant, psm, lang and is_fallback, ``words`` the words of each
    cand. Pages of bad quality and pages without text give an error row. Only the winner is cleaned.
    """
    own = candidates.join(pages.filter("status = 'OK'").select("page_id"), "page_id", "left_semi")
    # words are the bulk: they are gathered once, and text and score of a candidate stay together until the page's winner is known
    read = heard(words, "cand").join(own, "cand").select("page_id", "text", F.array(_reading()).alias("readings"))
    return process_texts(pages, read, stop, below)


def readings(candidates: DataFrame, confidence: DataFrame) -> DataFrame:
    """(page_id, readings): the candidates of each page with a confidence, as ``process_texts`` takes them."""
    return confidence.join(candidates, "cand").groupBy("page_id").agg(F.collect_list(_reading()).alias("readings"))


def _reading() -> Column:
    return F.struct("ord", "variant", "psm", "lang", "is_fallback", *CONFIDENCE)


def process_texts(pages: DataFrame, texts: DataFrame, stop: float = EARLY_STOP, below: float = FALLBACK_BELOW) -> DataFrame:
    """``process`` of texts (page_id, text, readings), where all ``readings`` gave that text: a text is measured once, whoever read it.

    Texts that are dealt by page_id stay where they are.
    """
    each = measured(texts.filter("text <> ''")).withColumn("r", F.explode("readings")).select("*", "r.*").drop("r", "readings")
    scores = composed(each, "page_id", F.col("lang"), ("ord", "variant", "psm", "is_fallback", "text"))
    ranked = scores.select("page_id", "ord", "variant", "psm", "is_fallback", "text", F.col("composite_score").alias("score"), F.col("word_confidence_avg").alias("average_confidence"))
    winner = best(searched(ranked, "page_id", stop, below), "page_id").withColumn("cleaned", T.clean(F.col("text"))).drop("text")
    named = T.with_scripts(winner, "cleaned", True, "share_").withColumn("sentences", T.sentences(F.col("cleaned")))
    # rows of one page id are rows of one page: each gets the winner once
    out = pages.join(named.withColumnRenamed("page_id", "_page"), (F.col("page_id") == F.col("_page")) & (F.col("status") == "OK"), "left")
    valid = F.col("variant").isNotNull()
    out = out.withColumn("language", F.when(valid, T.detect_language(F.col("cleaned"), T.shares_of("share_"), F.col("script"))))
    error = F.when(F.col("status") != "OK", F.concat(F.lit("Image quality issue: "), "status")).when(~valid, "No readable text found on page")
    return out.select(
        "page_id",
        valid.alias("is_valid"),
        F.coalesce("language", F.lit("unknown")).alias("detected_language"),
        F.when(valid, T.language_name(F.col("language"))).otherwise("Unknown").alias("detected_script"),
        F.coalesce("score", F.lit(0.0)).alias("composite_score"),
        F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
        F.coalesce("variant", F.lit("none")).alias("selected_variant"),
        F.coalesce("psm", F.lit(0)).alias("selected_psm"),
        F.coalesce("cleaned", F.lit("")).alias("cleaned_text"),
        F.coalesce("sentences", F.array().cast("array<string>")).alias("sentences"),
        error.alias("error_message"),
    )
