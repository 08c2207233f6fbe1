"""Queries over filtered images, each filter beside its definition in SQL: lists for lines of pixels, joins for neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.functions import dims
from pagelight.operators import kernels as K
from pagelight.plans.images import GRAY, HEIGHT, WIDTH, _len_sql, _near_sql, pixels
from pagelight.plans.registry import query

BYTE = "CAST(greatest(0, least(255, round_even({}, 0))) AS BIGINT)"
REFLECT, EDGE = "({n} - 1) - abs(({n} - 1) - abs({j}))", "greatest(0, least({n} - 1, {j}))"


def _lines(source: str, along: str, other: str, value: str, out: str | None = None) -> str:
    """``value`` over ``line``, the list of pixels along an axis, at each place ``p`` of it (or ``out`` places)."""
    n = out or "len(line)"
    return f"SELECT image_id, p AS {along}, {other}, {value} AS v FROM (SELECT image_id, {other}, line, unnest(range(0, CAST({n} AS BIGINT))) AS p FROM (SELECT image_id, {other}, list(v ORDER BY {along}) AS line FROM {source} GROUP BY ALL))"


def _smooth(source: str, name: str, size: int, sigma: float, border: str) -> str:
    """Gaussian filter along columns, then rows; rounded to bytes."""
    r = size // 2
    bell = f"exp(-(k * k) / {2 * sigma * sigma!r}e0)"
    total = f"list_sum(list_transform(range({-r}, {r + 1}), lambda k: {bell}))"
    value = f"list_sum(list_transform(range({-r}, {r + 1}), lambda k: {bell} / {total.replace('k', 'z')} * line[{border.format(n='len(line)', j='(p + k)')} + 1]))"
    return f"{name}_y AS ({_lines(source, 'y', 'x', value)}), {name} AS (SELECT image_id, y, x, {BYTE.format('v')} AS v FROM ({_lines(f'{name}_y', 'x', 'y', value)}))"


def _sigma(size: int) -> float:
    return 0.3 * ((size - 1) * 0.5 - 1) + 0.8


def _illumination(source: str, name: str) -> str:
    top = "list_max(line[greatest(1, p - 19):least(len(line), p + 21)])"
    return f"""{name}_a AS ({_lines(source, "y", "x", top)}), {name}_b AS ({_lines(f"{name}_a", "x", "y", top)}), {_smooth(f"{name}_b", f"{name}_c", 41, _sigma(41), REFLECT)},
{name} AS (SELECT s.image_id, s.y, s.x, CAST(floor(greatest(0, least(255, s.v / (b.v + 1e0) * 255e0))) AS BIGINT) AS v FROM {source} s JOIN {name}_c b USING (image_id, y, x))"""


def _adaptive(source: str, name: str) -> str:
    return f"{_smooth(source, f'{name}_m', 25, _sigma(25), EDGE)}, {name} AS (SELECT s.image_id, s.y, s.x, CASE WHEN s.v > m.v - 10 THEN 255 ELSE 0 END AS v FROM {source} s JOIN {name}_m m USING (image_id, y, x))"


def _unsharp(source: str, name: str) -> str:
    return f"{_smooth(source, f'{name}_m', 7, 1.0, REFLECT)}, {name} AS (SELECT s.image_id, s.y, s.x, {BYTE.format('s.v * 2.2e0 - m.v * 1.2e0')} AS v FROM {source} s JOIN {name}_m m USING (image_id, y, x))"


def _bilateral(source: str, name: str) -> str:
    return f"""{name} AS (SELECT image_id, y, x, {BYTE.format("sum(w * near) / sum(w)")} AS v FROM (
SELECT s.image_id, s.y, s.x, t.v AS near, exp(-(dy * dy + dx * dx) / 3200e0 - (t.v - s.v) * (t.v - s.v) / 3200e0) AS w
FROM {source} s CROSS JOIN range(-2, 3) a(dy) CROSS JOIN range(-2, 3) b(dx)
JOIN {source} t ON t.image_id = s.image_id AND t.y = {REFLECT.format(n=HEIGHT, j="(s.y + dy)")} AND t.x = {REFLECT.format(n=WIDTH, j="(s.x + dx)")} WHERE dy * dy + dx * dx <= 4) GROUP BY image_id, y, x)"""


def _upscale(source: str, name: str) -> str:
    at = "((p + 0.5e0) / 1.5e0 - 0.5e0)"
    gap = f"abs({at} - (floor({at}) + k))"
    weight = f"CASE WHEN {gap} <= 1 THEN 1.25e0 * pow({gap}, 3) - 2.25e0 * pow({gap}, 2) + 1 ELSE -0.75e0 * pow({gap}, 3) + 3.75e0 * pow({gap}, 2) - 6e0 * {gap} + 3e0 END"
    value = f"list_sum(list_transform(range(-1, 3), lambda k: line[CAST({EDGE.format(n='len(line)', j=f'(floor({at}) + k)')} AS BIGINT) + 1] * ({weight})))"
    return f"{name}_y AS ({_lines(source, 'y', 'x', value, 'round(len(line) * 1.5)')}), {name} AS (SELECT image_id, y, x, {BYTE.format('v')} AS v FROM ({_lines(f'{name}_y', 'x', 'y', value, 'round(len(line) * 1.5)')}))"


def _clahe(source: str, name: str) -> str:
    """Eight by eight tiles; a level's surplus over the limit is dealt out evenly from level 0 on."""
    th, tw = HEIGHT // 8, WIDTH // 8
    size = th * tw
    limit = max(1, int(2.2 * size / 256))
    spot = lambda dy, dx: f"JOIN {name}_m m{dy}{dx} ON m{dy}{dx}.image_id = s.image_id AND m{dy}{dx}.level = s.v AND m{dy}{dx}.i = greatest(0, least(7, y0 + {dy})) AND m{dy}{dx}.j = greatest(0, least(7, x0 + {dx}))"
    return f"""{name}_h AS (SELECT image_id, y // {th} AS i, x // {tw} AS j, v AS level, count(*) AS n FROM {source} GROUP BY ALL),
{name}_o AS (SELECT image_id, i, j, CAST(sum(greatest(n - {limit}, 0)) AS BIGINT) AS over FROM {name}_h GROUP BY ALL),
{name}_f AS (SELECT o.image_id, o.i, o.j, l.level, least(coalesce(n, 0), {limit}) + over // 256 + CASE WHEN over % 256 > 0 AND l.level % greatest(256 // greatest(over % 256, 1), 1) = 0 AND l.level // greatest(256 // greatest(over % 256, 1), 1) < over % 256 THEN 1 ELSE 0 END AS n
FROM {name}_o o CROSS JOIN range(256) l(level) LEFT JOIN {name}_h h ON h.image_id = o.image_id AND h.i = o.i AND h.j = o.j AND h.level = l.level),
{name}_m AS (SELECT image_id, i, j, level, greatest(0, least(255, round_even(sum(n) OVER (PARTITION BY image_id, i, j ORDER BY level) * 255e0 / {size}, 0))) AS v FROM {name}_f),
{name}_s AS (SELECT *, floor(y / {th}e0 - 0.5e0) AS y0, floor(x / {tw}e0 - 0.5e0) AS x0, y / {th}e0 - 0.5e0 - floor(y / {th}e0 - 0.5e0) AS fy, x / {tw}e0 - 0.5e0 - floor(x / {tw}e0 - 0.5e0) AS fx FROM {source}),
{name} AS (SELECT s.image_id, s.y, s.x, {BYTE.format("(m00.v * (1 - fx) + m01.v * fx) * (1 - fy) + (m10.v * (1 - fx) + m11.v * fx) * fy")} AS v FROM {name}_s s {spot(0, 0)} {spot(0, 1)} {spot(1, 0)} {spot(1, 1)})"""


def _stretch(source: str, name: str) -> str:
    return f"""{name}_p AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM {source} GROUP BY image_id),
{name} AS (SELECT s.image_id, y, x, CASE WHEN hi > lo THEN CAST(floor(greatest(0e0, least(255e0, (v - lo) * (255e0 / (hi - lo))))) AS BIGINT) ELSE v END AS v FROM {source} s JOIN {name}_p p ON p.image_id = s.image_id)"""


def _otsu(source: str, name: str) -> str:
    return f"""{name}_1 AS (SELECT image_id, y, x, s + 2 * v AS v FROM ({_near_sql(source, "x", "y")})), {name}_2 AS (SELECT image_id, y, x, CAST(s + 2 * v + 8 AS BIGINT) >> 4 AS v FROM ({_near_sql(f"{name}_1", "y", "x")})),
{name}_h AS (SELECT image_id, v, count(*) AS n FROM {name}_2 GROUP BY ALL), {name}_w AS (SELECT image_id, sum(n) AS total, sum(n * v) AS moment FROM {name}_h GROUP BY image_id),
{name}_r AS (SELECT h.image_id, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS m0, total, moment FROM {name}_h h JOIN {name}_w t ON t.image_id = h.image_id WINDOW w AS (PARTITION BY h.image_id ORDER BY v)),
{name}_b AS (SELECT image_id, v AS level FROM {name}_r WHERE w0 < total QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY CAST(m0 * total - moment * w0 AS DOUBLE) * (m0 * total - moment * w0) / (CAST(w0 AS DOUBLE) * (total - w0)) DESC, v) = 1),
{name} AS (SELECT s.image_id, y, x, CASE WHEN s.v > coalesce(level, 0) THEN 255 ELSE 0 END AS v FROM {name}_2 s LEFT JOIN {name}_b b ON b.image_id = s.image_id)"""


def _kernel(name: str, run, sql) -> None:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.apply(pixels(spark, sf_dir), run)

    made.__name__ = f"kernel_{name}"
    made.__doc__ = f"Every image filtered by ``kernels.{run.__name__}``."
    query(f"WITH {GRAY}, {sql('px', 'made')} SELECT image_id, y, x, v FROM made")(made)


for _name, _run, _sql in (
    ("clahe", K.clahe, _clahe),
    ("illumination", K.normalize_illumination, _illumination),
    ("adaptive_gaussian", K.adaptive_gaussian, _adaptive),
    ("unsharp", K.unsharp, _unsharp),
    ("bilateral", K.bilateral, _bilateral),
    ("upscale", K.upscale, _upscale),
    ("otsu", K.otsu, _otsu),
):
    _kernel(_name, _run, _sql)

_SQL = {K.stretch: _stretch, K.clahe: _clahe, K.normalize_illumination: _illumination, K.otsu: _otsu, K.adaptive_gaussian: _adaptive, K.bilateral: _bilateral, K.unsharp: _unsharp, K.upscale: _upscale}


def _variants_sql(fast: bool) -> str:
    steps, parts = [], []
    for name, place, in_fast, _ in dims.VARIANTS:
        if in_fast or not fast:
            source, run = K.RECIPES.get(name, (None, None))
            if run:
                steps.append(_SQL[run]("px" if source == "original_gray" else f"v_{source}", f"v_{name}"))
            parts.append(f"SELECT image_id, {place} AS ord, '{name}' AS variant, max(x) + 1 AS width, max(y) + 1 AS height, CAST(sum(v * (1 + (y * 7 + x * 3) % 11)) AS BIGINT) AS total FROM {f'v_{name}' if run else 'px'} GROUP BY image_id")
    # the drawn pages are all below the size limit of the upscaled ones
    return f"WITH {GRAY}, {', '.join(steps)} {' UNION ALL '.join(parts)}"


def _weighted() -> Column:
    """Sum of an image's bytes, each weighed by its place."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col("content"), i + 1, F.lit(1))), 16, 10).cast("long")
    weight = lambda i: 1 + (F.floor(i / F.col("width")) * 7 + i % F.col("width") * 3) % 11
    return F.aggregate(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), F.lit(0).cast("long"), lambda a, i: a + byte(i) * weight(i))


def _variants(spark: SparkSession, sf_dir: str, fast: bool) -> DataFrame:
    made = K.make_variants(K.to_images(pixels(spark, sf_dir)), fast)
    return made.select("image_id", "ord", "variant", "width", "height", _weighted().alias("total"))


@query(_variants_sql(False))
def image_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten variants of each page, by size and a sum over every pixel."""
    return _variants(spark, sf_dir, False)


@query(_variants_sql(True))
def image_variants_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six of fast mode."""
    return _variants(spark, sf_dir, True)


# a page's corners by its number: none, too small a page, else a quadrilateral within the image
_QUAD = {"tl": ("3 + image_id % 4", "2"), "tr": ("66", "1 + image_id % 5"), "br": ("69", "60"), "bl": ("5", "61 - image_id % 3")}
_TINY = {"tl": ("10", "10"), "tr": ("40", "10"), "br": ("40", "40"), "bl": ("10", "40")}
_CORNER_SQL = ", ".join(f"struct_pack(x := CAST(CASE WHEN image_id % 4 = 1 THEN {_TINY[n][0]} ELSE {x} END AS DOUBLE), y := CAST(CASE WHEN image_id % 4 = 1 THEN {_TINY[n][1]} ELSE {y} END AS DOUBLE)) AS {n}" for n, (x, y) in _QUAD.items())


@query(f"""WITH {GRAY}, c AS (SELECT DISTINCT image_id, {_CORNER_SQL} FROM px), s AS (SELECT image_id, CAST(greatest({_len_sql("br", "bl")}, {_len_sql("tr", "tl")}) AS INT) AS w, CAST(greatest({_len_sql("tr", "br")}, {_len_sql("tl", "bl")}) AS INT) AS h FROM c),
t AS (SELECT image_id, sum(v) AS whole, sum(v) FILTER (y BETWEEN 3 AND 60 AND x BETWEEN 3 AND 68) AS inner_sum FROM px GROUP BY image_id)
SELECT s.image_id, s.image_id % 4 <> 0 AS was_warped, CASE s.image_id % 4 WHEN 0 THEN {WIDTH} - 6 WHEN 1 THEN {WIDTH} ELSE w END AS width, CASE s.image_id % 4 WHEN 0 THEN {HEIGHT} - 6 WHEN 1 THEN {HEIGHT} ELSE h END AS height,
CAST(CASE s.image_id % 4 WHEN 0 THEN inner_sum WHEN 1 THEN whole END AS BIGINT) AS total FROM s JOIN t ON t.image_id = s.image_id""")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page cut out of each image: rectified, left as it is, or without its margin; ``total`` of pixels that are not resampled."""
    images = K.to_images(pixels(spark, sf_dir))
    tiny = F.col("image_id") % 4 == 1
    names = ["br", "tl", "bl", "tr"]
    points = F.array(*[F.struct(*[F.when(tiny, F.expr(_TINY[n][a])).otherwise(F.expr(_QUAD[n][a])).cast("double").alias(c) for a, c in enumerate("xy")]) for n in names])
    made = K.page_regions(images.withColumn("corners", F.when(F.col("image_id") % 4 != 0, points)))
    byte = lambda i: F.conv(F.hex(F.substring(F.col("content"), i, F.lit(1))), 16, 10).cast("long")
    total = F.aggregate(F.sequence(F.lit(1), F.octet_length("content")), F.lit(0).cast("long"), lambda a, i: a + byte(i))
    return made.select("image_id", "was_warped", "width", "height", F.when(F.col("image_id") % 4 < 2, total).alias("total"))


@query(f"""WITH {GRAY}, b AS (SELECT image_id, string_agg(printf('%02x', v), '' ORDER BY y, x) AS hexed FROM px GROUP BY image_id)
SELECT image_id, 'page_' || image_id || '_orig.pgm' AS name, sha256(CAST('P5\\x0A{WIDTH} {HEIGHT}\\x0A255\\x0A' AS BLOB) || unhex(hexed)) AS content_sha256 FROM b""")
def artifact_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a graymap file, by name and digest."""
    made = K.to_images(pixels(spark, sf_dir))
    name = F.concat(F.lit("page_"), F.col("image_id").cast("string"), F.lit("_orig.pgm"))
    return made.select("image_id", name.alias("name"), F.sha2(K.graymap(F.col("width"), F.col("height"), F.col("content")), 256).alias("content_sha256"))
