"""Images as long tables of pixels (image_id, y, x, v) and quadrilaterals, on DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luminance in 14-bit fixed point."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def _near(df: DataFrame, axis: str, other: str) -> tuple[Column, Column]:
    """Neighbours along an axis; beyond the border the one on the other side stands in."""
    w = Window.partitionBy("image_id", other).orderBy(axis)
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    return F.coalesce(before, after, F.col("v")), F.coalesce(after, before, F.col("v"))


def laplacian(pixels: DataFrame) -> DataFrame:
    """Adds ``lap``: the four neighbours less four times the pixel."""
    left, right = _near(pixels, "x", "y")
    up, down = _near(pixels, "y", "x")
    wide = pixels.withColumns({"l": left, "r": right})
    return wide.withColumns({"u": up, "d": down}).withColumn("lap", F.col("l") + F.col("r") + F.col("u") + F.col("d") - 4 * F.col("v")).drop("l", "r", "u", "d")


def quality(pixels: DataFrame) -> DataFrame:
    """Brightness, contrast, clipping, sharpness and the status of each image. Variances come from integer sums."""
    n = F.count("*")
    var = lambda c: (n * F.sum(c * c) - F.sum(c) * F.sum(c)) / (n * n)
    v, lap = F.col("v").cast("long"), F.col("lap").cast("long")
    made = laplacian(pixels).groupBy("image_id").agg(
        (F.sum(v) / n).alias("mean_brightness"),
        F.sqrt(var(v)).alias("contrast_std"),
        (F.count(F.when(v >= 252, 1)) / n).alias("overexposed_ratio"),
        (F.count(F.when(v <= 15, 1)) / n).alias("underexposed_ratio"),
        var(lap).alias("blur_score"),
    )
    return made.withColumn("status", status()).withColumn("is_acceptable", F.col("status") == "OK")


def status(min_blur: float = 25.0, min_bright: float = 30.0, max_bright: float = 248.0, min_contrast: float = 12.0, max_under: float = 0.65) -> Column:
    return (
        F.when((F.col("mean_brightness") < min_bright) | (F.col("underexposed_ratio") > max_under), "IMAGE_TOO_DARK")
        .when((F.col("mean_brightness") > max_bright) & (F.col("contrast_std") < 15.0), "IMAGE_TOO_BRIGHT")
        .when(F.col("blur_score") < min_blur, "IMAGE_TOO_BLURRY")
        .when(F.col("contrast_std") < min_contrast, "IMAGE_LOW_CONTRAST")
        .otherwise("OK")
    )


def histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, v, n): 256 rows an image at most, whatever its size."""
    return pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def contrast_bounds(pixels: DataFrame) -> DataFrame:
    """(image_id, p1, p99): percentiles with linear interpolation, from the histogram."""
    return histogram(pixels).groupBy("image_id").agg(F.expr("percentile(v, array(0.01D, 0.99D), n)").alias("p")).select("image_id", F.col("p")[0].alias("p1"), F.col("p")[1].alias("p99"))


def stretch(pixels: DataFrame) -> DataFrame:
    """Pixels stretched so that percentiles 1 and 99 become 0 and 255; the bounds are joined per image."""
    near = pixels.join(contrast_bounds(pixels), "image_id")
    wide = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v") - F.col("p1")) * (255.0 / (F.col("p99") - F.col("p1")))))).cast("int")
    return near.withColumn("v", F.when(F.col("p99") > F.col("p1"), wide).otherwise(F.col("v"))).drop("p1", "p99")


def blur3(pixels: DataFrame) -> DataFrame:
    """3 x 3 binomial blur, rounded once."""
    left, right = _near(pixels, "x", "y")
    rows = pixels.withColumn("w", left + right + 2 * F.col("v")).select("image_id", "y", "x", F.col("w").alias("v"))
    up, down = _near(rows, "y", "x")
    return rows.withColumn("s", up + down + 2 * F.col("v")).select("image_id", "y", "x", F.shiftright(F.col("s") + 8, 4).alias("v"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold): the first level that maximises the variance between both sides."""
    hist = histogram(pixels)
    whole = hist.groupBy("image_id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("v")).alias("moment"))
    run = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    made = hist.withColumns({"w0": F.sum("n").over(run), "m0": F.sum(F.col("n") * F.col("v")).over(run)}).join(whole, "image_id").filter("w0 < total")
    gap = F.col("m0") * F.col("total") - F.col("moment") * F.col("w0")
    between = gap.cast("double") * gap / (F.col("w0").cast("double") * (F.col("total") - F.col("w0")))
    best = made.withColumn("between", between).groupBy("image_id").agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))
    return whole.select("image_id").join(best, "image_id", "left").fillna(0, ["threshold"])


def cells(pixels: DataFrame, width: int, height: int, columns: int, rows: int, *channels: str) -> DataFrame:
    """Mean of each cell of a grid that divides the image evenly, rounded to the nearest."""
    spots = pixels.withColumns({"cy": F.floor(F.col("y") * rows / height).cast("int"), "cx": F.floor(F.col("x") * columns / width).cast("int")})
    return spots.groupBy("image_id", "cy", "cx").agg(*[F.floor(F.sum(c) / F.count("*") + 0.5).cast("int").alias(c) for c in channels])


def dhash(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, image_hash) of colour pixels (b, g, r): 64 bits, one for each cell darker than its right neighbour, as 16 hex digits."""
    small = cells(pixels, width, height, 9, 8, "b", "g", "r").withColumn("v", gray(F.col("b"), F.col("g"), F.col("r")))
    right = F.lead("v").over(Window.partitionBy("image_id", "cy").orderBy("cx"))
    bits = small.withColumn("bit", (right > F.col("v")).cast("int")).filter("cx < 8")
    lines = bits.groupBy("image_id", "cy").agg(F.sum(F.col("bit") * F.expr("shiftleft(1, 7 - cx)")).alias("byte"))
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cy", "byte"))), lambda s: F.lower(F.lpad(F.hex(s.byte), 2, "0"))), "")
    return lines.groupBy("image_id").agg(packed.alias("image_hash"))


def safe_crop(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Without a margin of 5 % on each side."""
    my, mx = height * 5 // 100, width * 5 // 100
    return pixels.filter(F.col("y").between(my, height - my - 1) & F.col("x").between(mx, width - mx - 1)).withColumns({"y": F.col("y") - my, "x": F.col("x") - mx})


# quadrilaterals: arrays of four structs (x, y)


def _pick(points: Column, key, last: bool) -> Column:
    """The first point with the smallest, or with ``last`` the largest, key."""
    keyed = F.transform(points, lambda p, i: F.struct((-key(p) if last else key(p)).alias("k"), i.alias("i"), p.alias("p")))
    return F.array_min(keyed).p


def order_points(points: Column) -> Column:
    """Corners as top left, top right, bottom right, bottom left."""
    total, gap = (lambda p: p.x + p.y), (lambda p: p.y - p.x)
    return F.array(_pick(points, total, False), _pick(points, gap, False), _pick(points, total, True), _pick(points, gap, True))


def _length(p: Column, q: Column) -> Column:
    return F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))


def warp_size(corners: Column) -> tuple[Column, Column]:
    """Width and height of the rectified page: the longer of opposite sides, truncated; null where one is below 50, which leaves the image as it is."""
    tl, tr, br, bl = (corners[i] for i in range(4))
    longer = lambda a, b: F.greatest(F.floor(a), F.floor(b)).cast("int")
    width, height = longer(_length(br, bl), _length(tr, tl)), longer(_length(tr, br), _length(tl, bl))
    fits = (width >= 50) & (height >= 50)
    return F.when(fits, width), F.when(fits, height)


def area(corners: Column) -> Column:
    """Area of a polygon by its corners."""
    cross = lambda i: corners[i].x * corners[(i + 1) % 4].y - corners[(i + 1) % 4].x * corners[i].y
    return F.abs(cross(0) + cross(1) + cross(2) + cross(3)) / 2


def scale_to(width: Column, height: Column, longest: int) -> Column:
    """Factor that brings the longer side down to ``longest``."""
    return F.when(F.greatest(width, height) > longest, longest / F.greatest(width, height)).otherwise(1.0)


def page_contours(contours: DataFrame, top: int = 8) -> DataFrame:
    """Of contours (image_id, ord, area, corners, convex, rect_w, rect_h, img_area), the first page-like one among the largest."""
    by_area = Window.partitionBy("image_id").orderBy(F.desc("area"), "ord")
    ratio = F.greatest("rect_w", "rect_h") / F.least("rect_w", "rect_h")
    like = (F.col("area") >= F.col("img_area") * 0.10) & (F.col("corners") == 4) & F.col("convex") & (F.least("rect_w", "rect_h") > 0) & ratio.between(1.0, 2.8)
    return contours.withColumn("rank", F.row_number().over(by_area)).filter(F.col("rank") <= top).filter(like).groupBy("image_id").agg(F.min_by("ord", "rank").alias("ord"))
