"""Choice of embedded images worth transcribing, and quality of decoded ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import top

MIN_AREA, MIN_BYTES = 100 * 100, 1024


def chosen(images: DataFrame, caps: dict[str, int], order: list[str]) -> DataFrame:
    """Images large enough, each content once per document, then the first of each category up to its cap."""
    big = images.where((F.col("area") >= MIN_AREA) & (F.col("bytes") >= MIN_BYTES))
    once = top(big, ["document_id", "sha"], order, 1)
    ranked = top(once, ["document_id", "category"], [order[0], "sha"], max(caps.values()), "n")
    cap = F.lit(0)
    for category, n in caps.items():
        cap = F.when(F.col("category") == category, n).otherwise(cap)
    return ranked.where(F.col("n") <= cap).drop("n")


# Levels of dust, of dark and of light grey, shares and the grid that the verdicts rest on.
DUST, DARK, LIGHT, BACKGROUND = 100, 128, (200, 245), (180, 240)
NOISE_REJECT, NOISE_ENHANCE, STAIN_ENHANCE, SKEW_REJECT, SKEW_ENHANCE, SHORT_SIDE = 0.06, 0.003, 0.02, 8.0, 1.5, 500
GRID, MARK_SHARE, MARK_BLOCK, MARK_COVER, MARK_SPREAD, RED = 6, (0.03, 0.35), 0.05, 0.30, 2.0, 45
MEASURES = "dark_ratio double, noise_ratio double, stain_ratio double, light_ratio double, watermark_coverage double, watermark_spread double, red_ratio double, bg_level int"


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luminance of red, green and blue, in whole numbers."""
    r, g, b = (pixels[..., i].astype(np.int64) for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000 >> 16).astype(np.uint8)


def around(mask: np.ndarray, reach: int) -> np.ndarray:
    """How many of the pixels within `reach` of each are set; beyond the border its pixels go on."""
    wide = np.pad(mask.astype(np.int64), reach, mode="edge")
    sums = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * reach + 1
    return sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n]


def measures(pixels: np.ndarray) -> tuple:
    """The measures of one image: height x width of greys, or x 3 of colours."""
    level = grey(pixels) if pixels.ndim == 3 else pixels
    high, wide = level.shape
    dust, dark, light = level < DUST, level < DARK, (level >= LIGHT[0]) & (level < LIGHT[1])
    rows, columns = max(1, high // GRID), max(1, wide // GRID)
    shares = [light[y : y + rows, x : x + columns].mean() for y in range(0, min(GRID * rows, high), rows) for x in range(0, min(GRID * columns, wide), columns)]
    spread = max(shares) / max(min(shares), 1e-4) if max(shares) > 0 else 0.0
    red = 0.0
    if pixels.ndim == 3:
        r, g, b = (pixels[..., i].astype(int) for i in range(3))
        red = ((r - g > RED) & (r - b > RED)).mean()
    counts = np.bincount(level.ravel(), minlength=256).cumsum()
    return (dark.mean(), (dust & (around(dust, 1) <= 1)).mean(), (around(dark, 2) == 25).mean(), light.mean(), sum(s >= MARK_BLOCK for s in shares) / GRID**2, spread, red, int(np.searchsorted(counts, 0.8 * level.size)))


def measured(images: DataFrame) -> DataFrame:
    """`images` (width, height, pixels: bytes of greys or of red, green and blue, row by row) with MEASURES; null for an image
    whose bytes don't make its size. Decoding is the caller's."""
    kept = [c for c in images.columns if c != "pixels"]
    names = [c.split()[0] for c in MEASURES.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name in kept), MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for w, h, raw in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels"))):
                size = (w or 0) * (h or 0)
                shape = (h, w) if raw and len(raw) == size else (h, w, 3) if raw and len(raw) == 3 * size else None
                found.append(measures(np.frombuffer(raw, np.uint8).reshape(shape)) if shape and size else (None,) * len(names))
            types = [pa.float64()] * (len(names) - 1) + [pa.int32()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(zip(*found), types))] if found else [*(batch.column(c) for c in kept), *(pa.array([], t) for t in types)], names=[*kept, *names])

    return images.mapInArrow(run, schema)


def quality_verdict(uploaded: Column, skew: Column) -> Column:
    """reject_to_manual, enhance or pass for measured images; `skew` in degrees, the short side counts for uploaded ones only."""
    reject = (uploaded & (F.least("width", "height") < SHORT_SIDE)) | (F.col("noise_ratio") > NOISE_REJECT) | (F.abs(skew) > SKEW_REJECT)
    enhance = (F.col("noise_ratio") > NOISE_ENHANCE) | (F.col("stain_ratio") > STAIN_ENHANCE) | (F.abs(skew) > SKEW_ENHANCE) | F.col("bg_level").between(*BACKGROUND)
    return F.when(reject, "reject_to_manual").when(enhance, "enhance").otherwise("pass")


def watermarked() -> Column:
    """Light grey in a part of the page, in many blocks but not alike in all."""
    return F.col("light_ratio").between(*MARK_SHARE) & (F.col("watermark_coverage") >= MARK_COVER) & (F.col("watermark_spread") >= MARK_SPREAD)
