"""Frames, buttons, utterances and the state machine, over ordered events of each device or session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelight.functions import dims

MIN_AREA, MOVEMENT, STABLE_FRAMES = 0.15, 0.03, 4
PRESS_SECONDS, SETTLE_SECONDS, HOLD_SECONDS = 1.5, 0.05, 2.0


def stability(frames: DataFrame, key: str, order: list[str], min_area: float = MIN_AREA, movement: float = MOVEMENT, required: int = STABLE_FRAMES) -> DataFrame:
    """Adds movement, stable count and status to frames with found, area_ratio, corners (x1, y1 .. x4, y4), width and height.

    A frame without a page, or with one too small, resets the count. A still frame adds one and a moved
    one takes one, never below zero; so the count is the running sum less the lowest point below zero
    that the sum has had since the reset, which windows give without a fold.
    """
    ordered = Window.partitionBy(key).orderBy(*order)
    usable = F.col("found") & (F.col("area_ratio") >= min_area)
    made = frames.withColumn("usable", F.coalesce(usable, F.lit(False)))
    made = made.withColumn("segment", F.sum(F.when(F.col("usable"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "segment", "usable").orderBy(*order)
    gap = lambda i: F.sqrt(F.pow(F.col(f"x{i}") - F.lag(f"x{i}").over(inside), 2) + F.pow(F.col(f"y{i}") - F.lag(f"y{i}").over(inside), 2))
    diagonal = F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height"))
    moved = F.when(diagonal == 0, 1.0).otherwise((gap(1) + gap(2) + gap(3) + gap(4)) / 4 / diagonal)
    made = made.withColumns({"first": F.row_number().over(inside) == 1, "moved": moved})
    made = made.withColumn("movement", F.when(~F.col("usable"), None).when(F.col("first"), 0.0).otherwise(F.col("moved")))
    made = made.withColumn("step", F.when(F.col("first") | (F.col("movement") <= movement), 1).otherwise(-1))
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("run", F.sum("step").over(run))
    made = made.withColumn("stable_count", F.when(F.col("usable"), F.col("run") - F.least(F.lit(0), F.min("run").over(run))).otherwise(0))
    status = F.when(~F.col("usable"), "PAGE_NOT_FOUND").when(F.col("stable_count") >= required, "PAGE_STABLE").otherwise("PAGE_DETECTED")
    return made.withColumn("status", status).drop("usable", "segment", "first", "moved", "step", "run")


def overlay(status: Column, area_ratio: Column, stable_count: Column, required: int = STABLE_FRAMES) -> Column:
    """Struct (label, colour, outlined) of what a preview shows: a banner's text, its colour as blue, green, red, and whether the page is outlined."""
    count = F.concat(F.lit(" ("), stable_count.cast("string"), F.lit(f"/{required})"))
    share = F.concat(F.lit("PAGE TOO SMALL ("), F.format_string("%.1f", area_ratio * 100), F.lit("%)"))
    # The texts and colours of the banner.
    shown = [("PAGE_STABLE", F.concat(F.lit("PAGE STABLE"), count), (0, 255, 0)), ("PAGE_DETECTED", F.concat(F.lit("HOLD STILL"), count), (0, 255, 255))]
    made = lambda label, colour, outlined: F.struct(label.alias("label"), F.array(*map(F.lit, colour)).alias("colour"), F.lit(outlined).alias("outlined"))
    case = F.when(status == shown[0][0], made(*shown[0][1:], True)).when(status == shown[1][0], made(*shown[1][1:], True))
    return case.when(area_ratio.isNotNull(), made(share, (0, 165, 255), False)).otherwise(made(F.lit("SEARCHING FOR BOOK PAGE..."), (0, 0, 255), False))


def first_stable(tracked: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The frame at which each device's search ends: its first stable one."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return tracked.filter("status = 'PAGE_STABLE'").withColumn("rank", rank).filter("rank = 1").drop("rank")


def history(events: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """(key, events): each key's events in order, as structs of ``columns``. One key's events are one fold."""
    kept = F.struct(*order, *columns)
    return events.groupBy(key).agg(F.array_sort(F.collect_list(kept)).alias("events"))


#: Events of a key that are folded one by one.
CHUNK = 256


def before(events: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state before each of an array's events; ``kind`` is its type. By chunks, as every step of a fold copies what it has gathered."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(events) - 1) / CHUNK).cast("int")), lambda k: F.slice(events, k * CHUNK + 1, F.lit(CHUNK)))
    none = F.array().cast(f"array<{kind}>")

    def inner(chunk: Column, state: Column) -> Column:
        begin = F.struct(state.cast(kind).alias("now"), none.alias("path"))
        return F.aggregate(chunk, begin, lambda acc, e: F.struct(step(acc.now, e).cast(kind).alias("now"), F.concat(acc.path, F.array(acc.now)).alias("path")))

    def outer(acc: Column, chunk: Column) -> Column:
        once = F.transform(F.array(inner(chunk, acc.now)), lambda r: F.struct(r.now.alias("now"), F.concat(acc.out, F.array(r.path)).alias("out")))
        return F.element_at(once, 1)

    begin = F.struct(start.cast(kind).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(chunks, begin, outer, lambda acc: F.flatten(acc.out))


def _edges() -> Column:
    return F.array(*[F.lit(f"{a}>{b}") for a, more in dims.EDGES.items() for b in more])


def replay(events: DataFrame, key: str, order: list[str], requested: str, start: str = "INITIALIZING") -> DataFrame:
    """One row for each request: the state before and after, whether it was allowed, whether listeners hear of it."""
    step = lambda state, e: F.when(F.array_contains(_edges(), F.concat(state, F.lit(">"), e[requested])), e[requested]).otherwise(state)
    folded = history(events, key, order, requested).withColumn("before", before(F.col("events"), F.lit(start), step, "string"))
    each = folded.select(key, F.explode(F.arrays_zip("events", "before")).alias("z")).select(key, *[F.col("z.events")[c].alias(c) for c in [*order, requested]], F.col("z.before").alias("from_state"))
    allowed = F.array_contains(_edges(), F.concat("from_state", F.lit(">"), requested))
    same = F.col("from_state") == F.col(requested)
    return each.withColumns({"to_state": F.when(allowed, F.col(requested)).otherwise(F.col("from_state")), "accepted": allowed | same, "notified": allowed & ~same})


def rejected(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Of requests (from_state, requested), those that no edge allows; staying in a state is allowed."""
    found = requests.filter(F.col("from_state") != F.col("requested"))
    return found.join(F.broadcast(edges), (F.col("from_state") == F.col("e_from")) & (F.col("requested") == F.col("e_to")), "left_anti")


def dispatch(events: DataFrame, key: str, order: list[str], trigger: str, start: str = "WAIT_WAKE_WORD") -> DataFrame:
    """(key, state, handled, refused): final state of each session when triggers act by the rules, and how many led to a move or asked for a forbidden one."""
    rules = F.create_map(*[F.lit(x) for s, t, n in dims.RULES for x in (f"{s}|{t}", n)])

    def step(acc: Column, e: Column) -> Column:
        asked = F.coalesce(rules[F.concat(acc.state, F.lit("|"), e[trigger])], rules[F.concat(F.lit("*|"), e[trigger])])
        allowed = F.coalesce(F.array_contains(_edges(), F.concat(acc.state, F.lit(">"), asked)), F.lit(False))
        refused = asked.isNotNull() & (asked != acc.state) & ~allowed
        return F.struct(F.when(allowed, asked).otherwise(acc.state).alias("state"), (acc.handled + allowed.cast("int")).alias("handled"), (acc.refused + F.coalesce(refused, F.lit(False)).cast("int")).alias("refused"))

    begin = F.struct(F.lit(start).alias("state"), F.lit(0).alias("handled"), F.lit(0).alias("refused"))
    return history(events, key, order, trigger).select(key, F.aggregate("events", begin, step).alias("r")).select(key, "r.*")


def clamped_total(events: DataFrame, key: str, order: list[str], change: str, start: int = 175, low: int = 80, high: int = 350) -> DataFrame:
    """(key, total): a value that each event changes and that never leaves its bounds."""
    step = lambda acc, e: F.greatest(F.lit(low), F.least(F.lit(high), acc + e[change]))
    return history(events, key, order, change).select(key, F.aggregate("events", F.lit(start), step).alias("total"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def progress(events: DataFrame, key: str, order: list[str], move: str, total: int) -> DataFrame:
    """(key, at): sentence index. 1 reads on up to the end, -1 repeats: the sentence before, or from the start once all are read."""
    step = lambda acc, e: F.when(e[move] > 0, F.least(acc + 1, F.lit(total))).when((e[move] < 0) & (acc >= total), 0).when(e[move] < 0, F.greatest(acc - 1, F.lit(0))).otherwise(acc)
    return history(events, key, order, move).select(key, F.aggregate("events", F.lit(0), step).alias("at"))


def changes(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_before", before).filter(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def debounce(events: DataFrame, key: str, time_us: str, tie: str, millis: int) -> DataFrame:
    """Events at least ``millis`` after the last accepted one of their key."""
    passes = lambda last, e: last.isNull() | (e[time_us] - last >= millis * 1000)
    folded = history(events, key, [time_us, tie]).withColumn("before", before(F.col("events"), F.lit(None), lambda last, e: F.when(passes(last, e), e[time_us]).otherwise(last), "bigint"))
    each = folded.select(key, F.explode(F.arrays_zip("events", "before")).alias("z"))
    return each.filter(passes(F.col("z.before"), F.col("z.events"))).select(key, F.col(f"z.events.{tie}").alias(tie))


def press_class(seconds: Column) -> Column:
    """Event of a press held so long: none if it ends while it settles; the hold is measured up to its cap."""
    held = F.least(seconds - SETTLE_SECONDS, F.lit(HOLD_SECONDS))
    return F.when(seconds <= SETTLE_SECONDS, None).when(held >= PRESS_SECONDS, "POWER_LONG_PRESS").otherwise("POWER_PRESS")


def voice_for(language: Column, board: bool, installed: list[str] | None = None) -> Column:
    """Voice of a language; on the desktop only an installed one, else the English one, else none."""
    table = {code: dims.voice(code, board) for code in [*dims.ISO, *dims.ISO.values()]}
    english = dims.voice("en", board)
    wanted = F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(language)], F.lit(english))
    if board or installed is None:
        return wanted
    return F.when(wanted.isin(*installed), wanted).when(F.lit(english in installed), english)


def heard(utterances: DataFrame, intent: Column, arg: Column) -> DataFrame:
    """Adds intent and argument: an injected command comes before what was said."""
    given = F.col("injected_intent").isNotNull()
    return utterances.withColumns({"intent": F.when(given, F.col("injected_intent")).otherwise(intent), "arg": F.when(given, F.col("injected_arg")).otherwise(arg)})
