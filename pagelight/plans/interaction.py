"""Queries over frames, buttons, speech and states; the events derive from ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.functions import dims
from pagelight.functions import text as T
from pagelight.operators import interaction as O
from pagelight.plans.registry import query, table
from pagelight.plans.text import R, quoted, rows, values

ORDER = ["ts", "event_id"]
_CORNERS = {"x1": "60 + k", "y1": "40", "x2": "560 + k", "y2": "40", "x3": "560 + k", "y3": "440", "x4": "60 + k", "y4": "440"}
_SMALL = {"x1": "60", "y1": "40", "x2": "160", "y2": "40", "x3": "160", "y3": "120", "x4": "60", "y4": "120"}


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event: lost on errors, too small on purchases, else a page shifted by the value."""
    own = table(spark, sf_dir, "events").withColumn("k", F.floor("value").cast("int") % 40)
    small = F.col("event_type") == "purchase"
    found = F.col("event_type") != "error"
    quad = {c: F.when(found, F.when(small, F.expr(_SMALL[c])).otherwise(F.expr(_CORNERS[c])).cast("double")) for c in _CORNERS}
    made = own.select("user_id", "ts", "event_id", found.alias("found"), F.lit(640).alias("width"), F.lit(480).alias("height"), *[v.alias(c) for c, v in quad.items()])
    side = lambda a, b: F.col(f"x{a}") * F.col(f"y{b}") - F.col(f"x{b}") * F.col(f"y{a}")
    return made.withColumn("area_ratio", F.abs(side(1, 2) + side(2, 3) + side(3, 4) + side(4, 1)) / 2 / (F.col("width") * F.col("height")))


_Q = ", ".join(f"CAST(CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN {_SMALL[c]} ELSE {_CORNERS[c]} END AS DOUBLE) AS {c}" for c in _CORNERS)
_GAP = " + ".join(f"sqrt(pow(x{i} - lag(x{i}) OVER s, 2) + pow(y{i} - lag(y{i}) OVER s, 2))" for i in range(1, 5))
STABLE = f"""f AS (SELECT user_id, ts, event_id, event_type <> 'error' AS found, {_Q} FROM (SELECT *, CAST(floor(value) AS INT) % 40 AS k FROM events)),
g AS (SELECT *, abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2 / (640 * 480) AS area_ratio FROM f),
u AS (SELECT *, coalesce(found AND area_ratio >= 0.15, false) AS usable FROM g),
v AS (SELECT *, sum(CASE WHEN usable THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM u),
m AS (SELECT *, row_number() OVER s AS rn, ({_GAP}) / 4 / sqrt(640 * 640 + 480 * 480) AS moved FROM v WINDOW s AS (PARTITION BY user_id, segment, usable ORDER BY ts, event_id)),
r AS (SELECT *, CASE WHEN NOT usable THEN NULL WHEN rn = 1 THEN 0.0 ELSE moved END AS movement, sum(CASE WHEN rn = 1 OR moved <= 0.03 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id, segment, usable ORDER BY ts, event_id) AS run FROM m),
c AS (SELECT *, CASE WHEN usable THEN run - least(0, min(run) OVER (PARTITION BY user_id, segment, usable ORDER BY ts, event_id)) ELSE 0 END AS stable_count FROM r),
st AS (SELECT user_id, event_id, ts, area_ratio, movement, stable_count, CASE WHEN NOT usable THEN 'PAGE_NOT_FOUND' WHEN stable_count >= 4 THEN 'PAGE_STABLE' ELSE 'PAGE_DETECTED' END AS status FROM c)"""


@query(f"WITH {STABLE} SELECT user_id, event_id, {R('area_ratio', 6)} AS area_ratio, {R('movement', 6)} AS movement, stable_count, status FROM st")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = O.stability(frames(spark, sf_dir), "user_id", ORDER)
    return made.select("user_id", "event_id", T.rounded(F.col("area_ratio"), 6).alias("area_ratio"), T.rounded(F.col("movement"), 6).alias("movement"), "stable_count", "status")


@query(f"""WITH {STABLE} SELECT user_id, event_id, CASE WHEN status = 'PAGE_STABLE' THEN 'PAGE STABLE (' || stable_count || '/4)' WHEN status = 'PAGE_DETECTED' THEN 'HOLD STILL (' || stable_count || '/4)'
WHEN area_ratio IS NULL THEN 'SEARCHING FOR BOOK PAGE...' ELSE 'PAGE TOO SMALL (' || printf('%.1f', area_ratio * 100) || '%)' END AS label,
CASE WHEN status = 'PAGE_STABLE' THEN '0,255,0' WHEN status = 'PAGE_DETECTED' THEN '0,255,255' WHEN area_ratio IS NULL THEN '0,0,255' ELSE '0,165,255' END AS colour, status <> 'PAGE_NOT_FOUND' AS outlined FROM st""")
def frame_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the preview of each frame shows."""
    made = O.stability(frames(spark, sf_dir), "user_id", ORDER)
    shown = made.select("user_id", "event_id", O.overlay(F.col("status"), F.col("area_ratio"), F.col("stable_count")).alias("o"))
    return shown.select("user_id", "event_id", "o.label", F.array_join("o.colour", ",").alias("colour"), "o.outlined")


@query(f"WITH {STABLE} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM st WHERE status = 'PAGE_STABLE') WHERE rn = 1")
def first_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_stable(O.stability(frames(spark, sf_dir), "user_id", ORDER), "user_id", ORDER).select("user_id", "event_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest frame of each device, as a still capture takes it."""
    newest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest.alias("f")).select("user_id", "f.*")


_STATES = f"[{', '.join(quoted(s) for s in dims.STATES)}]"
_EDGES = f"[{', '.join(quoted(f'{a}>{b}') for a, more in dims.EDGES.items() for b in more)}]"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, dims.STATES)), ((F.col("event_id") * 5 + F.floor("value").cast("int")) % 11 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state.alias("requested"))


REPLAY = f"""rq AS (SELECT user_id, ts, event_id, {_STATES}[CAST((event_id * 5 + CAST(floor(value) AS INT)) % 11 + 1 AS INT)] AS requested FROM events),
hist AS (SELECT user_id, list(requested ORDER BY ts, event_id) AS reqs, list(event_id ORDER BY ts, event_id) AS ids FROM rq GROUP BY user_id),
path AS (SELECT user_id, reqs, ids, string_split(list_reduce(list_prepend('INITIALIZING', reqs), lambda acc, x: acc || '|' || CASE WHEN list_contains({_EDGES}, string_split(acc, '|')[-1] || '>' || x) THEN x ELSE string_split(acc, '|')[-1] END), '|') AS states FROM hist),
each AS (SELECT user_id, unnest(ids) AS event_id, unnest(reqs) AS requested, unnest(states[:len(reqs)]) AS from_state, unnest(states[2:]) AS to_state FROM path)"""


@query(f"WITH {REPLAY} SELECT user_id, event_id, requested, from_state, to_state, from_state = requested OR list_contains({_EDGES}, from_state || '>' || requested) AS accepted, from_state <> to_state AS notified FROM each")
def fsm_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.replay(requests(spark, sf_dir), "user_id", ORDER, "requested").drop("ts")


@query(f"WITH {REPLAY} SELECT user_id, event_id, from_state, requested FROM each WHERE from_state <> requested AND NOT list_contains({_EDGES}, from_state || '>' || requested)")
def fsm_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = dims.table(spark, "fsm_edges").toDF("e_from", "e_to")
    made = O.replay(requests(spark, sf_dir), "user_id", ORDER, "requested").select("user_id", "event_id", "from_state", "requested")
    return O.rejected(made, edges)


@query(f"WITH {REPLAY}, leds AS {values(list(dims.LEDS.items()), 'state, led')} SELECT user_id, event_id, led FROM (SELECT user_id, event_id, l.led, lag(l.led) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM each JOIN leds l ON l.state = to_state WHERE from_state <> to_state) WHERE led IS DISTINCT FROM before".replace("leds AS (SELECT", "leds AS (SELECT", 1))
def led_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light patterns set by state changes; only changes of the pattern are shown. Events are numbered in time."""
    moves = O.replay(requests(spark, sf_dir), "user_id", ORDER, "requested").filter("notified").withColumn("led", T.lookup(dims.LEDS, F.col("to_state"))).filter("led IS NOT NULL")
    return O.changes(moves, "user_id", ["event_id"], "led").select("user_id", "event_id", "led")


_TRIGGERS = sorted({t for _, t, _ in dims.RULES}) + ["V:PREVIOUS_PAGE"]
_RULE_LIST = f"[{', '.join(quoted(f'{s}|{t}') for s, t, _ in dims.RULES)}]"
_NEXT_LIST = f"[{', '.join(quoted(n) for _, _, n in dims.RULES)}]"


def _asked(state: str, trigger: str) -> str:
    at = lambda s: f"{_NEXT_LIST}[list_position({_RULE_LIST}, {s} || '|' || {trigger})]"
    return f"coalesce({at(state)}, {at(chr(39) + '*' + chr(39))})"


_LAST = "string_split(acc, '|')[-1]"


@query(f"""WITH t AS (SELECT user_id, list([{", ".join(map(quoted, _TRIGGERS))}][CAST((event_id * 7 + CAST(floor(value) AS INT)) % {len(_TRIGGERS)} + 1 AS INT)] ORDER BY ts, event_id) AS ts FROM events GROUP BY user_id),
p AS (SELECT user_id, ts, string_split(list_reduce(list_prepend('WAIT_WAKE_WORD', ts), lambda acc, x: acc || '|' || CASE WHEN coalesce(list_contains({_EDGES}, {_LAST} || '>' || {_asked(_LAST, "x")}), false) THEN {_asked(_LAST, "x")} ELSE {_LAST} END), '|') AS st FROM t),
e AS (SELECT user_id, unnest(ts) AS x, unnest(st[:len(ts)]) AS s, unnest(st[2:]) AS n, st[-1] AS final FROM p)
SELECT user_id, any_value(final) AS state, CAST(count(*) FILTER (list_contains({_EDGES}, s || '>' || {_asked("s", "x")})) AS INT) AS handled, CAST(count(*) FILTER ({_asked("s", "x")} <> s AND NOT list_contains({_EDGES}, s || '>' || {_asked("s", "x")})) AS INT) AS refused FROM e GROUP BY user_id""")
def dispatch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    trigger = F.element_at(F.array(*map(F.lit, _TRIGGERS)), ((F.col("event_id") * 7 + F.floor("value").cast("int")) % len(_TRIGGERS) + 1).cast("int"))
    return O.dispatch(table(spark, sf_dir, "events").select("user_id", *ORDER, trigger.alias("trigger")), "user_id", ORDER, "trigger")


@query("""SELECT user_id, list_reduce(list_prepend(175, list(CAST(CASE WHEN event_type IN ('view', 'signup') THEN 25 WHEN event_type = 'click' THEN -25 ELSE 0 END AS INT) ORDER BY ts, event_id)), lambda acc, x: greatest(80, least(350, acc + x))) AS total,
any_value(greatest(0.0, least(1.0, user_id / 100.0))) AS volume FROM events GROUP BY user_id""")
def speed_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("event_type").isin("view", "signup"), 25).when(F.col("event_type") == "click", -25).otherwise(0)
    made = O.clamped_total(table(spark, sf_dir, "events").select("user_id", *ORDER, change.alias("change")), "user_id", ORDER, "change")
    return made.withColumn("volume", O.clamp(F.col("user_id") / 100, 0.0, 1.0))


@query("SELECT user_id, list_reduce(list_prepend(0, list(CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN 1 WHEN event_type = 'click' THEN -1 ELSE 0 END ORDER BY ts, event_id)), lambda acc, x: CASE WHEN x > 0 THEN least(acc + 1, 8) WHEN x < 0 AND acc >= 8 THEN 0 WHEN x < 0 THEN greatest(acc - 1, 0) ELSE acc END) AS at FROM events GROUP BY user_id")
def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.when(F.col("event_type").isin("view", "signup", "purchase"), 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return O.progress(table(spark, sf_dir, "events").select("user_id", *ORDER, move.alias("move")), "user_id", ORDER, "move", 8)


@query("""SELECT event_id, seconds, CASE WHEN seconds <= 0.05 THEN NULL WHEN least(seconds - 0.05, 2.0) >= 1.5 THEN 'POWER_LONG_PRESS' ELSE 'POWER_PRESS' END AS event FROM (SELECT event_id, (event_id % 250) / 100.0 AS seconds FROM events)""")
def press_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 250 / 100.0).alias("seconds"))
    return made.withColumn("event", O.press_class(F.col("seconds")))


_HOUR = 3_600_000


@query(f"""WITH h AS (SELECT event_type, list(CAST(epoch_us(ts) AS BIGINT) ORDER BY ts, event_id) AS us, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY event_type),
f AS (SELECT event_type, us, ids, list_reduce(list_prepend(CAST([0] AS BIGINT[]), list_transform(us, lambda x: CAST([x] AS BIGINT[]))), lambda acc, x: CASE WHEN len(acc) = 1 OR x[1] - acc[-1] >= CAST({_HOUR * 1000} AS BIGINT) THEN list_append(acc, x[1]) ELSE acc END)[2:] AS kept FROM h)
SELECT event_type, event_id FROM (SELECT event_type, unnest(us) AS t, unnest(ids) AS event_id, kept FROM f) WHERE list_contains(kept, t)""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Button presses by kind; an hour stands in for the bounce time, as the events are sparse."""
    own = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return O.debounce(own, "event_type", "us", "event_id", _HOUR)


SAID = [
    (1, "", None, None),
    (2, "Hey Vision, start reading", None, None),
    (3, "hey vision", None, None),
    (4, "continue reading please", None, None),
    (5, "stop english", None, None),
    (6, "STOP TALKING", None, None),
    (7, "go back", None, None),
    (8, "turn  the volume up", None, None),
    (9, "volume up", None, None),
    (10, "don't translate", None, None),
    (11, "translation", None, None),
    (12, "read it in Tamil", None, None),
    (13, None, None, None),
    (14, "nothing of use", None, None),
    (15, "pause", "NEXT_PAGE", None),
    (16, None, "SET_LANGUAGE", "hi"),
    (17, "voices", None, None),
    (18, "once more", None, None),
    (19, "shut down", None, None),
    (20, "softer", None, None),
]


def _intent_sql(t: str) -> tuple[str, str]:
    said = f"lower({t})"
    lang = lambda give: " ".join(f"WHEN contains({said}, '{n}') THEN '{give(n, c)}'" for n, c in dims.SPOKEN_LANGUAGES)
    esc = lambda p: p.replace("'", "''")
    intents = " ".join(f"WHEN regexp_matches({said}, '{esc(p)}') THEN '{n}'" for n, p in dims.INTENTS)
    none = f"WHEN {t} IS NULL OR {t} = '' THEN"
    return f"CASE {none} 'UNKNOWN' {lang(lambda n, c: 'SET_LANGUAGE')} {intents} WHEN regexp_matches({said}, '{esc(dims.WAKE_WORD)}') THEN 'WAKE_WORD' ELSE 'UNKNOWN' END", f"CASE {none} NULL {lang(lambda n, c: c)} END"


_I, _A = _intent_sql("text")


@query(f"SELECT seq, coalesce(inj, {_I}) AS intent, CASE WHEN inj IS NOT NULL THEN inj_arg ELSE {_A} END AS arg, coalesce(regexp_matches(lower(text), '{dims.WAKE_WORD}'), false) AS wake FROM (SELECT * FROM {values(SAID, 'seq, text, inj, inj_arg')} UNION ALL SELECT 1000 + conv_id * 100 + turn, text, NULL, NULL FROM conversations)")
def intent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = rows(spark, SAID, "seq long, text string, injected_intent string, injected_arg string")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 1000).alias("seq"), "text", F.lit(None).cast("string").alias("injected_intent"), F.lit(None).cast("string").alias("injected_arg"))
    intent, arg = T.parse_command(F.col("text"))
    return O.heard(said.unionByName(turns), intent, arg).select("seq", "intent", "arg", T.is_wake_word(F.col("text")).alias("wake"))


_SPOKEN = [(1, "en"), (2, "ENG"), (3, "ta"), (4, "tam"), (5, "fr"), (6, "ml"), (7, "hin")]


def _voice_sql(board: bool, installed: list[str] | None) -> str:
    table_ = {c: dims.voice(c, board) for c in [*dims.ISO, *dims.ISO.values()]}
    english = dims.voice("en", board)
    wanted = "coalesce(CASE " + " ".join(f"WHEN lower(lang) = '{c}' THEN '{v}'" for c, v in table_.items()) + f" END, '{english}')"
    if board or installed is None:
        return wanted
    return f"CASE WHEN {wanted} IN ({', '.join(map(quoted, installed)) or 'NULL'}) THEN {wanted} WHEN {english in installed} THEN '{english}' END"


@query(f"SELECT id, {_voice_sql(True, None)} AS board, {_voice_sql(False, ['Samantha', 'Veena'])} AS desktop, {_voice_sql(False, ['Rishi'])} AS no_english FROM {values(_SPOKEN, 'id, lang')}")
def voice_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    return rows(spark, _SPOKEN, "id int, lang string").select("id", O.voice_for(lang, True).alias("board"), O.voice_for(lang, False, ["Samantha", "Veena"]).alias("desktop"), O.voice_for(lang, False, ["Rishi"]).alias("no_english"))
