"""Image filters that no column expression gives: NumPy over one image at a time, fed by Arrow.

Images travel as rows (image_id, width, height, content) with one byte a pixel, so a filter needs no shuffle.
An Arrow batch holds whole images: lower ``spark.sql.execution.arrow.maxRecordsPerBatch`` for large ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.functions import dims
from pagelight.operators import image


def _gaussian(size: int, sigma: float) -> np.ndarray:
    if sigma <= 0:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _filter(img: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Separable filter of rows and columns."""
    r = len(kernel) // 2
    out = img.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(out, pad, mode=mode if out.shape[axis] > r or mode == "edge" else "symmetric")
        out = sum(k * np.take(wide, np.arange(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def _to_byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gaussian_blur(img: np.ndarray, size: int = 0, sigma: float = 0.0) -> np.ndarray:
    size = size or (int(round(sigma * 6 + 1)) | 1)
    return _to_byte(_filter(img, _gaussian(size, sigma)))


def clahe(img: np.ndarray, clip: float = 2.2, grid: int = 8) -> np.ndarray:
    """Local histogram equalisation with clipped histograms, blended between tiles."""
    h, w = img.shape
    wide = np.pad(img, ((0, -h % grid), (0, -w % grid)), mode="reflect" if min(h, w) > grid else "symmetric")
    th, tw = wide.shape[0] // grid, wide.shape[1] // grid
    size = th * tw
    limit = max(1, int(clip * size / 256))
    maps = np.empty((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            hist = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // 256
            rest = over % 256
            if rest:
                hist[np.arange(rest) * max(256 // rest, 1) % 256] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(hist) * 255.0 / size), 0, 255)
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda i, j: maps[np.clip(i, 0, grid - 1)[:, None], np.clip(j, 0, grid - 1)[None], img]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return _to_byte(top * (1 - fy) + low * fy)


def normalize_illumination(img: np.ndarray, size: int = 41) -> np.ndarray:
    """The image divided by its blurred upper envelope."""
    r = size // 2
    top = img.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(top, pad, constant_values=0)
        top = np.max([np.take(wide, np.arange(i, i + img.shape[axis]), axis=axis) for i in range(size)], axis=0)
    back = _to_byte(_filter(top, _gaussian(size, 0)))
    return np.clip(img / (back.astype(float) + 1.0) * 255.0, 0, 255).astype(np.uint8)


def adaptive_gaussian(img: np.ndarray, block: int = 25, c: float = 10) -> np.ndarray:
    """White where the pixel exceeds the weighted mean around it less ``c``."""
    block += block % 2 == 0
    mean = _to_byte(_filter(img, _gaussian(block, 0), mode="edge"))
    return np.where(img.astype(int) > mean.astype(int) - c, 255, 0).astype(np.uint8)


def unsharp(img: np.ndarray, sigma: float = 1.0, strength: float = 1.2) -> np.ndarray:
    return _to_byte(img * (1.0 + strength) - gaussian_blur(img, sigma=sigma) * strength)


def bilateral(img: np.ndarray, d: int = 5, color: float = 40, space: float = 40) -> np.ndarray:
    r = d // 2
    wide = np.pad(img.astype(float), r, mode="reflect" if min(img.shape) > r else "symmetric")
    total, weight = np.zeros(img.shape), np.zeros(img.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx > r * r:
                continue
            near = wide[r + dy : r + dy + img.shape[0], r + dx : r + dx + img.shape[1]]
            w = np.exp(-(dy * dy + dx * dx) / (2 * space**2) - (near - img) ** 2 / (2 * color**2))
            total += w * near
            weight += w
    return _to_byte(total / weight)


def _cubic(n: int, scale: float, a: float = -0.75) -> tuple[np.ndarray, np.ndarray]:
    m = int(round(n * scale))
    at = (np.arange(m) + 0.5) / scale - 0.5
    base = np.floor(at).astype(int)
    t = np.abs(at[:, None] - (base[:, None] + np.arange(-1, 3)))
    w = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0))
    return np.clip(base[:, None] + np.arange(-1, 3), 0, n - 1), w


def upscale(img: np.ndarray, scale: float = 1.5) -> np.ndarray:
    """Bicubic resampling."""
    iy, wy = _cubic(img.shape[0], scale)
    ix, wx = _cubic(img.shape[1], scale)
    rows = (img.astype(float)[iy] * wy[:, :, None]).sum(axis=1)
    return _to_byte((rows[:, ix] * wx[None]).sum(axis=2))


def warp(img: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rectify the quadrilateral ``corners`` (top left first, clockwise) by bicubic resampling."""
    dst = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    rows, rhs = [], []
    for (u, v), (x, y) in zip(dst, np.asarray(corners, float), strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        rhs += [x, y]
    m = np.append(np.linalg.solve(np.array(rows), np.array(rhs)), 1.0).reshape(3, 3)
    v, u = np.mgrid[0:height, 0:width]
    x, y, z = np.tensordot(m, np.stack([u, v, np.ones_like(u)]), axes=1)
    x, y = x / z, y / z
    bx, by = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((height, width))
    a = -0.75
    kernel = lambda t: np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0))
    for j in range(-1, 3):
        for i in range(-1, 3):
            inside = (by + j >= 0) & (by + j < img.shape[0]) & (bx + i >= 0) & (bx + i < img.shape[1])
            value = np.where(inside, img[np.clip(by + j, 0, img.shape[0] - 1), np.clip(bx + i, 0, img.shape[1] - 1)], 0)
            out += kernel(np.abs(y - by - j)) * kernel(np.abs(x - bx - i)) * value
    return _to_byte(out)


def stretch(img: np.ndarray) -> np.ndarray:
    """Percentiles 1 and 99 become 0 and 255."""
    low, high = np.percentile(img, (1, 99))
    if high <= low:
        return img
    return np.clip((img - low) * (255.0 / (high - low)), 0, 255).astype(np.uint8)


def otsu(img: np.ndarray) -> np.ndarray:
    """Binomial 3 x 3 blur, then white above the first level that maximises the variance between both sides."""
    wide = np.pad(img.astype(np.int64), 1, mode="reflect")
    rows = wide[:-2] + 2 * wide[1:-1] + wide[2:]
    soft = rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]
    soft = (soft + 8) >> 4
    n = np.bincount(soft.ravel(), minlength=256)
    w0, m0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    gap = (m0 * w0[-1] - m0[-1] * w0).astype(float)
    both = (w0 > 0) & (w0 < w0[-1])
    between = np.where(both, gap * gap / np.where(both, w0.astype(float) * (w0[-1] - w0), 1.0), -1.0)
    return np.where(soft > (int(between.argmax()) if both.any() else 0), 255, 0).astype(np.uint8)


# Each variant by the one that it is made from and its filter.
RECIPES: dict[str, tuple[str, Callable[[np.ndarray], np.ndarray]]] = {
    "contrast_enhanced": ("original_gray", stretch),
    "clahe": ("original_gray", clahe),
    "illumination_corrected": ("original_gray", normalize_illumination),
    "otsu": ("clahe", otsu),
    "adaptive_gaussian": ("illumination_corrected", adaptive_gaussian),
    "mild_denoised": ("clahe", bilateral),
    "sharpened": ("illumination_corrected", unsharp),
    "upscaled_gray": ("clahe", upscale),
    "upscaled_threshold": ("upscaled_gray", otsu),
}


def variants(img: np.ndarray, fast: bool = False) -> dict[str, np.ndarray]:
    """Every recognition variant of an image that the catalogue makes for its size and mode, in order."""
    made = {}
    for name, _, in_fast, _ in dims.VARIANTS:
        if (in_fast or not fast) and (name not in dims.UPSCALED or max(img.shape) < dims.UPSCALE_LIMIT):
            source, run = RECIPES.get(name, (None, None))
            made[name] = run(made[source]) if run else img
    return made


def decoded(content: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    """The image of one byte a pixel; None where there is none or its bytes are not width times height."""
    if not content or not width or not height or len(content) != width * height:
        return None
    return np.frombuffer(content, np.uint8).reshape(height, width)


def to_images(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, content) of pixel rows (image_id, y, x, v)."""
    cell = F.struct("y", "x", F.lpad(F.hex("v"), 2, "0").alias("d"))
    packed = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c.d), ""))
    size = [(F.max(c) + 1).cast("int").alias(n) for c, n in (("x", "width"), ("y", "height"))]
    return pixels.groupBy("image_id").agg(*size, packed.alias("content"))


def _mapped(images: DataFrame, run: Callable[[dict], list[tuple]], schema: str, *columns: str) -> DataFrame:
    """One image at a time through ``run``; each gives the rows after image_id."""
    shape = images.sparkSession.createDataFrame([], f"image_id {dict(images.dtypes)['image_id']}, {schema}").schema
    kinds = images.sparkSession.createDataFrame([], shape).toArrow().schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                got = [(row["image_id"], *r) for r in run(row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), kinds, strict=True)], schema=kinds)

    return images.select("image_id", "width", "height", "content", *columns).mapInArrow(each, shape)


def make_variants(images: DataFrame, fast: bool = False) -> DataFrame:
    """(image_id, ord, variant, width, height, content, error): all variants of each image.

    An image that is null, empty or of the wrong length gives one row with ``error`` INVALID_IMAGE and nothing else.
    """
    order = {name: o for name, o, _, _ in dims.VARIANTS}

    def run(row: dict) -> list[tuple]:
        img = decoded(row["content"], row["width"], row["height"])
        if img is None:
            return [(None, None, None, None, None, "INVALID_IMAGE")]
        return [(order[name], name, v.shape[1], v.shape[0], v.tobytes(), None) for name, v in variants(img, fast).items()]

    return _mapped(images, run, "ord int, variant string, width int, height int, content binary, error string")


def page_regions(images: DataFrame) -> DataFrame:
    """(image_id, width, height, content, was_warped) of images with ``corners``, four points (x, y) in any order.

    The page is rectified to its longer sides; one with a side below 50 leaves the image as it is. Without corners,
    or where they span no quadrilateral, the image loses a margin of 5 % on each side. Invalid images give nulls.
    """
    ordered = images.withColumn("corners", F.when(F.size("corners") == 4, image.order_points(F.col("corners"))))
    width, height = image.warp_size(F.col("corners"))
    ordered = ordered.withColumns({"to_w": width, "to_h": height})

    def run(row: dict) -> list[tuple]:
        img = decoded(row["content"], row["width"], row["height"])
        if img is None:
            return [(None, None, None, None)]
        out, warped = img, row["corners"] is not None
        if row["to_w"] is not None:
            try:
                out = warp(img, np.array([[p["x"], p["y"]] for p in row["corners"]]), row["to_w"], row["to_h"])
            except np.linalg.LinAlgError:
                warped = False
        if not warped:
            my, mx = img.shape[0] * 5 // 100, img.shape[1] * 5 // 100
            out = img[my : img.shape[0] - my, mx : img.shape[1] - mx]
        return [(out.shape[1], out.shape[0], out.tobytes(), warped)]

    return _mapped(ordered, run, "width int, height int, content binary, was_warped boolean", "corners", "to_w", "to_h")


def graymap(width: Column, height: Column, content: Column) -> Column:
    """Bytes of a binary portable graymap, as ``sources.folders.raw_gray`` reads them."""
    head = F.concat(F.lit("P5\n"), width.cast("string"), F.lit(" "), height.cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "ISO-8859-1"), content)


def apply(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Run a filter over every image of a pixel table (image_id, y, x, v). A task holds one image at a time."""

    def run(row: dict) -> list[tuple]:
        out = kernel(decoded(row["content"], row["width"], row["height"]))
        y, x = np.indices(out.shape)
        return list(zip(y.ravel().tolist(), x.ravel().tolist(), out.ravel().tolist(), strict=True))

    return _mapped(to_images(pixels), run, "y int, x int, v int")
