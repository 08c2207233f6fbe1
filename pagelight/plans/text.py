"""Queries over page text, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.functions import dims
from pagelight.functions import text as T
from pagelight.plans.registry import documents, query

R = lambda x, places: f"floor(({x}) * {10.0**places} + 0.5) / {10.0**places}"

# SQL building blocks; RE2 has no lookaround, so boundaries are kept in groups

NOISE = [
    (1, "Wrapped demon-\nstration and recon-\n  struction of a-\nb-\nc."),
    (2, "12\n\nChapter One\nIt starts here.\n\nPage 12"),
    (3, "- 7 -\nline\n12\nline\n12 of 300\n9/300"),
    (4, "Title\n-----------\n^^^^^\n--\n|\nrest,,, of;; it:: a||b ~x~ `y`"),
    (5, "one\r\ntwo\rthree\tfour\n\n\n\n\nfive   six"),
    (6, "பாரதி ஒரு கவிஞர்."),
    (7, "यह पुस्तक है।\nदे-\nश"),
    (8, "   \n  "),
    (9, ""),
]
SPOKEN = [
    (1, "Hello there! Here is Dr. Smith. How are you? Fine."),
    (2, "राम बालक है। वह जाता है॥ क्या आप हैं?"),
    (3, "It costs 3.50 today. ok then. Émile came! \"Quoted.\" (Yes) no. 7 left"),
    (4, "First part\n\nsecond part\nwith a line. A"),
    (5, "MR. X met mrs. Y vs. Z e.g. this etc. Then Vol. 3 No. 4."),
    (6, None),
    (7, " "),
]
LANGUAGE = [
    (1, "A plain English page.", "hin"),
    (2, "தமிழ் ஒரு மொழி", "eng"),
    (3, "कबीर हिन्दी के कवि थे", "eng"),
    (4, "ಕನ್ನಡ ಸಾಹಿತ್ಯ", "eng"),
    (5, "తెలుగు భాష", "eng"),
    (6, "മലയാളം ഭാഷ", "eng"),
    (7, "abcd efgh தமிழ்", "eng"),
    (8, "12 34 !!", "kan"),
    (9, "Привет мир", "tam"),
    (10, "", "mal"),
    (11, None, "tel"),
    (12, "éèà ab", "hin"),
]


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({columns}))"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_clean(source: str, key: str, text: str) -> str:
    """A query (key, cleaned) over ``source``."""
    joined = rf"regexp_replace(replace(regexp_replace(coalesce({text}, ''), '\r\n|\r', chr(10), 'g'), chr(9), ' '), '([\p{{L}}\p{{N}}_]+)-\n\s*([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
    tidy = "s"
    for pattern, to in ((",+", ","), (";+", ";"), (":+", ":"), (r"\|+", ""), ("[~^`]+", ""), (" +", " ")):
        tidy = f"regexp_replace({tidy}, '{pattern}', '{to}', 'g')"
    number = r"(?i)^[-–—\s]*(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?[-–—\s]*$"
    return rf"""
    SELECT {key}, CASE WHEN {sql_strip("raw")} = '' THEN '' ELSE {sql_strip(r"regexp_replace(array_to_string(list_filter(list_transform(ls, lambda s, i: CASE WHEN s = '' THEN '' WHEN (i <= 2 OR i >= len(ls) - 1) AND regexp_matches(s, '" + number + r"') THEN NULL WHEN regexp_matches(s, '^[^\p{L}\p{N}]{3,}$') OR regexp_matches(s, '^[^\p{L}\p{N}]$') THEN NULL ELSE " + tidy + r" END), lambda s: s IS NOT NULL), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} END AS cleaned
    FROM (SELECT {key}, coalesce({text}, '') AS raw, list_transform(string_split({joined}, chr(10)), lambda s: {sql_strip("s")}) AS ls FROM {source})"""


def sql_sentences(source: str, key: str, text: str) -> str:
    """A query (key, ss) of sentence lists over ``source``."""
    guarded = rf"regexp_replace(regexp_replace(coalesce({text}, ''), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g')"
    back = "s"
    for i, abbr in enumerate(dims.ABBREVIATIONS):
        escaped = abbr.replace(".", r"\.")
        guarded = rf"regexp_replace({guarded}, '(^|[^\p{{L}}\p{{N}}_]){escaped}', '\1{chr(0xE000 + i)}', 'gi')"
        back = f"replace({back}, '{chr(0xE000 + i)}', '{abbr}')"
    once = r"""regexp_replace({x}, '([.!?।॥])\s+([A-Z\x{{0900}}-\x{{0D7F}}\p{{Nd}}"''(])', '\1' || chr(1) || '\2', 'g')"""
    cut = once.format(x=once.format(x=guarded))
    cut = rf"regexp_replace({cut}, '\n\s*\n', chr(1), 'g')"
    tidy = sql_strip(rf"regexp_replace({back}, '\n+', ' ', 'g')")
    return f"SELECT {key}, list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {tidy}), lambda s: length(s) >= 2) AS ss FROM {source}"


def sql_kept(text: str, marks: bool) -> str:
    return rf"regexp_replace(coalesce({text}, ''), '[^\p{{L}}{r'\p{M}' if marks else ''}]', '', 'g')"


def sql_shares(source: str, keys: str, text: str, marks: bool) -> str:
    """A query (keys, text, eng .. mal, total) of counts and then shares."""
    counts = ", ".join(rf"length(regexp_replace(kept, '[^\x{{{lo:04X}}}-\x{{{hi:04X}}}]', '', 'g')) AS n_{c}" for c, lo, hi in dims.SCRIPTS)
    shares = ", ".join(f"CASE WHEN total > 0 THEN n_{c} / total ELSE 0.0 END AS {c}" for c in dims.LANGS)
    ns = ", ".join(f"n_{c}" for c in dims.LANGS)
    return f"SELECT {keys}, txt, total, {ns}, {shares} FROM (SELECT {keys}, txt, length(kept) AS total, {counts} FROM (SELECT {keys}, {text} AS txt, {sql_kept(text, marks)} AS kept FROM {source}))"


TOP = f"greatest({', '.join(dims.LANGS)})"
MAIN = "CASE " + " ".join(f"WHEN {c} = {TOP} THEN '{c}'" for c in dims.LANGS) + " END"
BLANK = f"(txt IS NULL OR {sql_strip('txt')} = '')"


def sql_language(default: str) -> str:
    return f"CASE WHEN {BLANK} THEN {default} WHEN {TOP} >= 0.20 AND {MAIN} <> 'eng' THEN {MAIN} WHEN eng >= 0.40 THEN 'eng' WHEN {TOP} > 0.10 THEN {MAIN} ELSE {default} END"


def sql_stats(t: str) -> dict[str, str]:
    ws = rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"
    n = f"length({t})"
    some = {
        "char_count": n,
        "word_count": f"len({ws})",
        "alpha_ratio": rf"length(regexp_replace({t}, '[^\p{{L}}\p{{M}}]', '', 'g')) / {n}",
        "digit_ratio": rf"length(regexp_replace({t}, '[^\p{{Nd}}]', '', 'g')) / {n}",
        "symbol_ratio": rf"length(regexp_replace({t}, '[\p{{L}}\p{{M}}\p{{Nd}}\s{T.PUNCTUATION.replace(chr(39), chr(39) * 2)}]', '', 'g')) / {n}",
        "avg_word_length": f"CASE WHEN len({ws}) > 0 THEN list_sum(list_transform({ws}, lambda w: length(w))) / len({ws}) ELSE 0.0 END",
        "line_count": f"len(list_filter(string_split({t}, chr(10)), lambda x: {sql_strip('x')} <> ''))",
    }
    return {k: f"CASE WHEN {t} IS NULL OR {sql_strip(t)} = '' THEN 0 ELSE {v} END" for k, v in some.items()}


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def report(docs: DataFrame) -> DataFrame:
    """One row for each page: cleaned text, language, sentences and statistics."""
    cleaned = docs.select("doc_id", T.clean(F.col("text")).alias("cleaned"))
    made = T.with_scripts(cleaned, "cleaned", True, "share_").withColumn("language", T.detect_language(F.col("cleaned"), T.shares_of("share_"), F.lit("eng")))
    return made.withColumns({"sentences": T.sentences(F.col("cleaned")), **T.statistics(F.col("cleaned"))})


_STATS = sql_stats("cleaned")


@query(
    f"""WITH c AS ({sql_clean("documents", "doc_id", "text")}), s AS ({sql_sentences("c", "doc_id", "cleaned")}), l AS ({sql_shares("c", "doc_id", "cleaned", True)})
    SELECT c.doc_id, md5(cleaned) AS cleaned_md5, {sql_language("'eng'")} AS language, coalesce(n.name, upper({sql_language("'eng'")})) AS language_name, len(ss) AS n_sentences, {_STATS["word_count"]} AS word_count, {_STATS["line_count"]} AS line_count, {R(_STATS["alpha_ratio"], 6)} AS alpha_ratio
    FROM c JOIN s ON c.doc_id = s.doc_id JOIN l ON c.doc_id = l.doc_id LEFT JOIN {values([(a, b) for a, b in dims.NAMES.items()], "code, name")} n ON n.code = {sql_language("'eng'")}"""
)
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = report(documents(spark, sf_dir))
    return made.select("doc_id", F.md5(F.col("cleaned").cast("binary")).alias("cleaned_md5"), "language", T.language_name(F.col("language")).alias("language_name"), F.size("sentences").alias("n_sentences"), "word_count", "line_count", T.rounded(F.col("alpha_ratio"), 6).alias("alpha_ratio"))


@query(sql_clean("documents", "doc_id", "text"))
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(sql_clean(values(NOISE[:5] + NOISE[7:], "id, text"), "id", "text"))
def clean_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, NOISE[:5] + NOISE[7:], "id int, text string").select("id", T.clean(F.col("text")).alias("cleaned"))


@query(f"WITH s AS ({sql_sentences('documents', 'doc_id', 'text')}) SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM s")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"WITH s AS ({sql_sentences(values(SPOKEN, 'id, text'), 'id', 'text')}) SELECT id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM s")
def sentences_indic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, SPOKEN, "id int, text string").select("id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"WITH s AS ({sql_sentences('documents', 'doc_id', 'text')}) SELECT doc_id, len(ss) AS n_sentences, coalesce(list_max(list_transform(ss, lambda x: length(x))), 0) AS longest FROM s")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ss = documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("ss"))
    return ss.select("doc_id", F.size("ss").alias("n_sentences"), F.coalesce(F.array_max(F.transform("ss", F.length)), F.lit(0)).alias("longest"))


def _share_sql(marks: bool) -> str:
    return f"SELECT doc_id, {', '.join(R(c, 6) + f' AS {c}' for c in dims.LANGS)}, {MAIN} AS dominant FROM ({sql_shares('documents', 'doc_id', 'text', marks)})"


def _shares(spark: SparkSession, sf_dir: str, marks: bool) -> DataFrame:
    made = T.with_scripts(documents(spark, sf_dir).select("doc_id", "text"), "text", marks).withColumn("dominant", T.dominant(T.shares_of()))
    return made.select("doc_id", *[T.rounded(v, 6).alias(k) for k, v in T.shares_of().items()], "dominant")


@query(_share_sql(False))
def script_shares_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir, False)


@query(_share_sql(True))
def script_shares_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir, True)


@query(f"SELECT id, {', '.join(f'n_{c}' for c in dims.LANGS)}, total FROM ({sql_shares(values(LANGUAGE, 'id, text, fallback'), 'id', 'text', True)})")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.with_scripts(rows(spark, LANGUAGE, "id int, text string, fallback string"), "text", True)
    return made.select("id", *[f"n_{c}" for c in dims.LANGS], "total")


@query(f"SELECT doc_id, {', '.join(R(v, 6) + f' AS {k}' for k, v in sql_stats('text').items())} FROM documents")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *[T.rounded(v, 6).alias(k) for k, v in T.statistics(F.col("text")).items()])


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g')) AS letters FROM documents")
def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.chars(F.col("text"), r"\p{L}\p{M}").alias("letters"))


@query(f"SELECT id, {sql_language('fallback')} AS language FROM ({sql_shares(values(LANGUAGE, 'id, text, fallback'), 'id, fallback', 'text', True)}) UNION ALL SELECT doc_id + 100, {sql_language(chr(39) + 'eng' + chr(39))} FROM ({sql_shares('documents', 'doc_id', 'text', True)})")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rows(spark, LANGUAGE, "id long, text string, fallback string").unionByName(documents(spark, sf_dir).select((F.col("doc_id") + 100).alias("id"), "text", F.lit("eng").alias("fallback")))
    return T.with_scripts(both, "text", True).select("id", T.detect_language(F.col("text"), T.shares_of(), F.col("fallback")).alias("language"))


_PRIMARY = f"CASE WHEN {BLANK} THEN fallback WHEN {TOP} >= 0.25 THEN {MAIN} ELSE fallback END"


@query(f"SELECT id, {_PRIMARY} AS language FROM ({sql_shares(values(LANGUAGE, 'id, text, fallback'), 'id, fallback', 'text', False)}) UNION ALL SELECT doc_id + 100, {_PRIMARY.replace('fallback', chr(39) + 'eng' + chr(39))} FROM ({sql_shares('documents', 'doc_id', 'text', False)})")
def primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rows(spark, LANGUAGE, "id long, text string, fallback string").unionByName(documents(spark, sf_dir).select((F.col("doc_id") + 100).alias("id"), "text", F.lit("eng").alias("fallback")))
    return T.with_scripts(both, "text", False).select("id", T.primary_language(F.col("text"), T.shares_of(), F.col("fallback")).alias("language"))


CODES = [(1, "eng"), (2, "hin"), (3, "TAM"), (4, "fr"), (5, None), (6, "tel"), (7, "kan"), (8, "mal")]
_PAIRS = values([(c, i, p) for c in dims.LANGS for i, p in enumerate(dims.pairs(c))], "lang, ord, ocr_lang")


@query(f"SELECT c.id, coalesce(p.ord, 0) AS ord, coalesce(p.ocr_lang, 'eng') AS ocr_lang, coalesce(n.name, upper(c.code)) AS name, coalesce(i.iso, lower(c.code)) AS iso FROM {values(CODES, 'id, code')} c LEFT JOIN {_PAIRS} p ON p.lang = lower(coalesce(c.code, 'eng')) LEFT JOIN {values(list(dims.NAMES.items()), 'code, name')} n ON n.code = c.code LEFT JOIN {values([(a, b) for a, b, _ in dims.LANGUAGES], 'code3, iso')} i ON i.code3 = lower(c.code)")
def language_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = rows(spark, CODES, "id int, code string")
    return given.select("id", F.posexplode(T.candidate_languages(F.col("code"))).alias("ord", "ocr_lang"), T.language_name(F.col("code")).alias("name"), T.to_iso(F.col("code")).alias("iso"))


SETTINGS = [(1, "eng+tam, hin"), (2, ""), (3, None), (4, " , +"), (5, "kan")]


@query(f"SELECT id, unnest(list_filter(list_transform(string_split(replace(CASE WHEN raw IS NULL OR raw = '' THEN 'eng,tam,kan,tel,mal,hin' ELSE raw END, '+', ','), ','), lambda x: {sql_strip('x')}), lambda x: x <> '')) AS code FROM {values(SETTINGS, 'id, raw')}")
def config_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, SETTINGS, "id int, raw string").select("id", F.explode(T.setting_list(F.col("raw"))).alias("code"))
