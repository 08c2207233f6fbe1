"""Queries over images. Each nation gets a drawn page of 72 x 64 pixels, made by integer arithmetic in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.functions.text import rounded
from pagelight.operators import image as I
from pagelight.plans.registry import query, table
from pagelight.plans.text import R, rows, values

WIDTH, HEIGHT = 72, 64


def drawn(images: DataFrame, key: str) -> DataFrame:
    """Colour pixels (image_id, y, x, b, g, r): a gradient page with dark strokes; some images are dark, bright or flat."""
    i, y, x = F.col("image_id"), F.col("y"), F.col("x")
    cells = images.select(F.col(key).cast("long").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))).alias("c"))
    spots = cells.select("image_id", F.floor(F.col("c") / WIDTH).cast("int").alias("y"), (F.col("c") % WIDTH).alias("x"))
    stroke = ((x * 3 + y * 5 + i * 7) % 11 < 3) & (y % 6 < 3)
    v = F.when(i % 5 == 1, (x + y) % 20).when(i % 5 == 2, 250 + (x * y) % 6).when(i % 5 == 3, 120 + F.floor((x + y) / 16)).when(stroke, 30 + (x + i) % 40).otherwise(180 + (x * 2 + y + i) % 70)
    v = F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")
    return spots.select("image_id", "y", "x", v.alias("b"), F.least(F.lit(255), v + (x % 7)).cast("int").alias("g"), F.greatest(F.lit(0), v - (y % 5)).cast("int").alias("r"))


_V = """greatest(0, least(255, CASE WHEN image_id % 5 = 1 THEN (x + y) % 20 WHEN image_id % 5 = 2 THEN 250 + (x * y) % 6 WHEN image_id % 5 = 3 THEN 120 + (x + y) // 16
WHEN (x * 3 + y * 5 + image_id * 7) % 11 < 3 AND y % 6 < 3 THEN 30 + (x + image_id) % 40 ELSE 180 + (x * 2 + y + image_id) % 70 END))"""
COLOUR = f"colour AS (SELECT image_id, y, x, v AS b, least(255, v + x % 7) AS g, greatest(0, v - y % 5) AS r FROM (SELECT *, {_V} AS v FROM (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(c // {WIDTH} AS BIGINT) AS y, CAST(c % {WIDTH} AS BIGINT) AS x FROM nation, range({WIDTH * HEIGHT}) t(c))))"
GRAY = f"{COLOUR}, px AS (SELECT image_id, y, x, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS v FROM colour)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = drawn(table(spark, sf_dir, "nation"), "n_nationkey")
    return made.select("image_id", "y", "x", I.gray(F.col("b"), F.col("g"), F.col("r")).alias("v"))


@query(f"WITH {COLOUR} SELECT * FROM colour")
def synthetic_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(table(spark, sf_dir, "nation"), "n_nationkey")


@query(f"WITH {GRAY} SELECT * FROM px")
def grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir)


def _near_sql(source: str, axis: str, other: str) -> str:
    w = f"OVER (PARTITION BY image_id, {other} ORDER BY {axis})"
    return f"SELECT *, coalesce(lag(v) {w}, lead(v) {w}, v) + coalesce(lead(v) {w}, lag(v) {w}, v) AS s FROM {source}"


QUALITY = f"""{GRAY}, hor AS ({_near_sql("px", "x", "y")}), ver AS ({_near_sql("px", "y", "x")}),
lap AS (SELECT h.image_id, h.v, h.s + u.s - 4 * h.v AS lap FROM hor h JOIN ver u ON h.image_id = u.image_id AND h.y = u.y AND h.x = u.x),
q AS (SELECT image_id, sum(v) / count(*) AS mean_brightness, sqrt((count(*) * sum(v * v) - sum(v) * sum(v)) / (count(*) * count(*))) AS contrast_std, count(*) FILTER (v >= 252) / count(*) AS overexposed_ratio,
      count(*) FILTER (v <= 15) / count(*) AS underexposed_ratio, (count(*) * sum(lap * lap) - sum(lap) * sum(lap)) / (count(*) * count(*)) AS blur_score FROM lap GROUP BY image_id),
st AS (SELECT *, CASE WHEN mean_brightness < 30 OR underexposed_ratio > 0.65 THEN 'IMAGE_TOO_DARK' WHEN mean_brightness > 248 AND contrast_std < 15 THEN 'IMAGE_TOO_BRIGHT' WHEN blur_score < 25 THEN 'IMAGE_TOO_BLURRY' WHEN contrast_std < 12 THEN 'IMAGE_LOW_CONTRAST' ELSE 'OK' END AS status FROM q)"""
_FIGURES = ["mean_brightness", "contrast_std", "overexposed_ratio", "underexposed_ratio", "blur_score"]


@query(f"WITH {QUALITY} SELECT image_id, {', '.join(R(c, 4) + f' AS {c}' for c in _FIGURES)}, status, status = 'OK' AS is_acceptable FROM st")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = I.quality(pixels(spark, sf_dir))
    return made.select("image_id", *[rounded(F.col(c), 4).alias(c) for c in _FIGURES], "status", "is_acceptable")


@query(f"WITH {QUALITY} SELECT image_id FROM st WHERE status = 'OK'")
def acceptable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.quality(pixels(spark, sf_dir)).filter("is_acceptable").select("image_id")


@query(f"""WITH {GRAY}, p AS (SELECT image_id, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM px GROUP BY image_id),
s AS (SELECT px.image_id, CASE WHEN p99 > p1 THEN CAST(floor(greatest(0.0, least(255.0, (v - p1) * (255.0 / (p99 - p1))))) AS BIGINT) ELSE v END AS v FROM px JOIN p ON p.image_id = px.image_id)
SELECT s.image_id, any_value({R("p1", 4)}) AS p1, any_value({R("p99", 4)}) AS p99, CAST(sum(v) AS BIGINT) AS total, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high FROM s JOIN p ON p.image_id = s.image_id GROUP BY s.image_id""")
def contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pixels(spark, sf_dir)
    out = I.stretch(own).groupBy("image_id").agg(F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    return I.contrast_bounds(own).join(out, "image_id").select("image_id", rounded(F.col("p1"), 4).alias("p1"), rounded(F.col("p99"), 4).alias("p99"), "total", "low", "high")


@query(f"""WITH {GRAY}, b1 AS (SELECT image_id, y, x, s + 2 * v AS v FROM ({_near_sql("px", "x", "y")})), b2 AS (SELECT image_id, y, x, (s + 2 * v + 8) >> 4 AS v FROM ({_near_sql("b1", "y", "x")})),
hist AS (SELECT image_id, v, count(*) AS n FROM b2 GROUP BY ALL), whole AS (SELECT image_id, sum(n) AS total, sum(n * v) AS moment FROM hist GROUP BY image_id),
run AS (SELECT h.image_id, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS m0, total, moment FROM hist h JOIN whole ON whole.image_id = h.image_id WINDOW w AS (PARTITION BY h.image_id ORDER BY v)),
best AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY CAST(m0 * total - moment * w0 AS DOUBLE) * (m0 * total - moment * w0) / (CAST(w0 AS DOUBLE) * (total - w0)) DESC, v) AS rn FROM run WHERE w0 < total)
SELECT whole.image_id, coalesce(best.v, 0) AS threshold FROM whole LEFT JOIN best ON best.image_id = whole.image_id AND rn = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.otsu(I.blur3(pixels(spark, sf_dir)))


@query(f"""WITH {COLOUR}, cells AS (SELECT image_id, y // 8 AS cy, x // 8 AS cx, floor(sum(b) / 64.0 + 0.5) AS b, floor(sum(g) / 64.0 + 0.5) AS g, floor(sum(r) / 64.0 + 0.5) AS r FROM colour GROUP BY ALL),
gr AS (SELECT image_id, cy, cx, CAST(r * 4899 + g * 9617 + b * 1868 + 8192 AS BIGINT) >> 14 AS v FROM cells),
bits AS (SELECT image_id, cy, cx, CASE WHEN lead(v) OVER (PARTITION BY image_id, cy ORDER BY cx) > v THEN 1 ELSE 0 END AS bit FROM gr),
bytes AS (SELECT image_id, cy, CAST(sum(bit * (1 << CAST(7 - cx AS INT))) AS INT) AS byte FROM bits WHERE cx < 8 GROUP BY ALL)
SELECT image_id, string_agg(substr('0123456789abcdef', byte // 16 + 1, 1) || substr('0123456789abcdef', byte % 16 + 1, 1), '' ORDER BY cy) AS image_hash FROM bytes GROUP BY image_id""")
def dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dhash(drawn(table(spark, sf_dir, "nation"), "n_nationkey"), WIDTH, HEIGHT)


@query(f"WITH {GRAY} SELECT image_id, y - 3 AS y, x - 3 AS x, v FROM px WHERE y BETWEEN 3 AND 60 AND x BETWEEN 3 AND 68")
def safe_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.safe_crop(pixels(spark, sf_dir), WIDTH, HEIGHT)


# quadrilaterals: four shuffled corners for every customer

_QX, _QY = ["60 + k % 40", "560 + k % 37", "555 - k % 30", "50 + k % 21"], ["40 + k % 9", "44 - k % 13", "430 + k % 41", "445 - k % 25"]


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in zip(_QX, _QY, strict=True)]
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("p", F.array(*points))
    turned = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at("p", ((i + F.col("k")) % 4 + 1).cast("int")))
    return own.select(F.col("k").alias("image_id"), turned.alias("pts"))


_PTS = f"""pts AS (SELECT k AS image_id, i, CAST(CASE (i + k) % 4 {" ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(_QX))} END AS DOUBLE) AS x, CAST(CASE (i + k) % 4 {" ".join(f"WHEN {j} THEN {y}" for j, y in enumerate(_QY))} END AS DOUBLE) AS y FROM (SELECT c_custkey AS k FROM customer), range(4) t(i)),
c AS (SELECT image_id, arg_min(struct_pack(x := x, y := y), (x + y) * 10 + i / 10) AS tl, arg_min(struct_pack(x := x, y := y), (y - x) * 10 + i / 10) AS tr, arg_max(struct_pack(x := x, y := y), (x + y) * 10 - i / 10) AS br, arg_max(struct_pack(x := x, y := y), (y - x) * 10 - i / 10) AS bl FROM pts GROUP BY image_id)"""
_NAMES = ["tl", "tr", "br", "bl"]


@query(f"WITH {_PTS} SELECT image_id, {', '.join(f'{n}.{a} AS {n}_{a}' for n in _NAMES for a in 'xy')} FROM c")
def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quads(spark, sf_dir).select("image_id", I.order_points(F.col("pts")).alias("c"))
    return made.select("image_id", *[F.col("c")[i][a].alias(f"{n}_{a}") for i, n in enumerate(_NAMES) for a in "xy"])


def _len_sql(p: str, q: str) -> str:
    return f"floor(sqrt(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y)))"


@query(f"""WITH {_PTS}, s AS (SELECT image_id, CAST(greatest({_len_sql("br", "bl")}, {_len_sql("tr", "tl")}) AS INT) AS w, CAST(greatest({_len_sql("tr", "br")}, {_len_sql("tl", "bl")}) AS INT) AS h,
abs(tl.x * tr.y - tr.x * tl.y + tr.x * br.y - br.x * tr.y + br.x * bl.y - bl.x * br.y + bl.x * tl.y - tl.x * bl.y) / 2 AS area FROM c)
SELECT image_id, CASE WHEN w >= 50 AND h >= 50 THEN w END AS width, CASE WHEN w >= 50 AND h >= 50 THEN h END AS height, {R("area / (640 * 480)", 6)} AS area_ratio, area / (640 * 480) < 0.15 AS too_small FROM s""")
def warp_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quads(spark, sf_dir).select("image_id", I.order_points(F.col("pts")).alias("c"))
    width, height = I.warp_size(F.col("c"))
    share = I.area(F.col("c")) / (640 * 480)
    return made.select("image_id", width.alias("width"), height.alias("height"), rounded(share, 6).alias("area_ratio"), (share < 0.15).alias("too_small"))


SIZES = [(1, 1920, 1080), (2, 640, 480), (3, 800, 801), (4, 300, 200), (5, 641, 10)]


@query(f"SELECT id, {R('CASE WHEN greatest(w, h) > 640 THEN 640.0 / greatest(w, h) ELSE 1.0 END', 6)} AS page_scale, {R('CASE WHEN greatest(w, h) > 800 THEN 800.0 / greatest(w, h) ELSE 1.0 END', 6)} AS probe_scale FROM {values(SIZES, 'id, w, h')}")
def frame_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, SIZES, "id int, w int, h int")
    return own.select("id", rounded(I.scale_to(F.col("w"), F.col("h"), 640), 6).alias("page_scale"), rounded(I.scale_to(F.col("w"), F.col("h"), 800), 6).alias("probe_scale"))


@query("""WITH c AS (SELECT c_custkey // 12 AS image_id, c_custkey AS ord, (c_custkey * 7919) % 100000 AS area, 3 + c_custkey % 3 AS corners, c_custkey % 5 <> 0 AS convex, CAST(10 + (c_custkey * 31) % 300 AS DOUBLE) AS rw, CAST((c_custkey * 17) % 200 AS DOUBLE) AS rh FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, ord) AS rank FROM c)
SELECT image_id, arg_min(ord, rank) AS ord FROM r WHERE rank <= 8 AND area >= 10000 AND corners = 4 AND convex AND least(rw, rh) > 0 AND greatest(rw, rh) / least(rw, rh) BETWEEN 1.0 AND 2.8 GROUP BY image_id""")
def contour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    made = table(spark, sf_dir, "customer").select(
        F.floor(k / 12).cast("long").alias("image_id"),
        k.alias("ord"),
        ((k * 7919) % 100000).alias("area"),
        (k % 3 + 3).alias("corners"),
        (k % 5 != 0).alias("convex"),
        ((k * 31) % 300 + 10).cast("double").alias("rect_w"),
        ((k * 17) % 200).cast("double").alias("rect_h"),
        F.lit(100000.0).alias("img_area"),
    )
    return I.page_contours(made)
