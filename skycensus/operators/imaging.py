"""Image kernels in Arrow batches: robust background, properties, islands, flood fill, injection trials."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROPERTIES = ("peak", "total_flux", "extent", "n_components")


def map_images(df: DataFrame, fn: Callable[[np.ndarray], tuple], names: dict[str, str], key: str = "idx") -> DataFrame:
    """(key, names...) by a function of one image (h x w); an image that fails gives nulls and its error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h, w, image in zip(b[key], b["h"], b["w"], b["image"], strict=True):
                try:
                    rows.append((k, *fn(np.asarray(image, np.float64).reshape(h, w)), None))
                except Exception as e:
                    rows.append((k, *(None,) * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    schema = ", ".join([f"{key} {kind}", *(f"{n} {t}" for n, t in names.items()), "error string"])
    return df.select(key, "h", "w", "image").mapInPandas(run, schema)


def background(image: np.ndarray, sigma: float = 3.0, rounds: int = 5) -> tuple[float, float]:
    """(level, noise) of the pixels left after clipping; median and deviation from it where clipping leaves no spread."""
    v = image[np.isfinite(image)]
    if not v.size:
        return np.nan, np.nan
    kept = v
    for _ in range(rounds):
        m, s = np.median(kept), kept.std()
        inside = kept[np.abs(kept - m) <= sigma * s]
        if inside.size == kept.size or not inside.size:
            break
        kept = inside
    level, noise = float(np.median(kept)), float(kept.std())
    if noise <= 0:
        level = float(np.median(v))
        noise = 1.4826 * float(np.median(np.abs(v - level)))
    return level, noise


def labels(mask: np.ndarray, corners: bool = False) -> np.ndarray:
    """Numbers from 1 of connected regions: each pixel takes the least number around it until nothing changes."""
    h, w = mask.shape
    big = h * w + 1
    out = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), big)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * corners
    while True:
        wide = np.pad(out, 1, constant_values=big)
        least = np.min([wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in steps], axis=0)
        new = np.where(mask, np.minimum(out, least), big)
        if (new == out).all():
            break
        out = new
    _, numbers = np.unique(out, return_inverse=True)
    numbers = numbers.reshape(h, w) + 1
    return np.where(mask, numbers, 0)


def properties(image: np.ndarray, nsigma: float = 5.0) -> tuple[float, float, float, int]:
    """Peak, background-subtracted flux, second-moment extent and islands of the pixels above ``nsigma``."""
    level, noise = background(image)
    top = float(np.nanmax(image)) if np.isfinite(image).any() else np.nan
    mask = np.isfinite(image) & (image > level + nsigma * noise)
    if not mask.any():
        return top, 0.0, 0.0, 0
    flux = image[mask] - level
    y, x = np.nonzero(mask)
    total = float(flux.sum())
    cx, cy = (x * flux).sum() / total, (y * flux).sum() / total
    spread = ((x - cx) ** 2 * flux).sum() / total + ((y - cy) ** 2 * flux).sum() / total
    return top, total, float(np.sqrt(spread)), int(labels(mask).max())


def flood_mask(image: np.ndarray, own: np.ndarray, foreign: np.ndarray, threshold: float) -> np.ndarray:
    """Pixels above a threshold or inside the own ellipses, outside foreign ones, in islands that touch an own ellipse."""
    mask = (np.nan_to_num(image, nan=-np.inf) > threshold) | own
    mask &= ~foreign
    found = labels(mask, corners=True)
    touched = np.unique(found[own & mask])
    return mask & np.isin(found, touched[touched > 0])


def widest(mask: np.ndarray) -> float:
    """Largest distance of two pixels; only the ends of each line can take part."""
    y, x = np.nonzero(mask)
    if len(y) < 2:
        return 0.0
    ends = np.array([(r, c) for r in np.unique(y) for c in (x[y == r].min(), x[y == r].max())], float)
    d = ends[:, None] - ends[None]
    return float(np.sqrt((d * d).sum(-1).max()))


def inject(df: DataFrame, trials: int = 5, seed: int = 7, sigma: float = 5.0, rms: tuple[float, float] = (0.05, 0.2), beam_px: float = 1.7) -> DataFrame:
    """(idx, trial, rms, mock_flux, peak, detectable): beam-correlated noise on each image, a generator for each (seed, idx, trial).

    Images are not carried along, and a trial's numbers do not depend on partitions or retries.
    """
    reach = 3
    t = np.arange(-reach, reach + 1)
    kernel = np.exp(-0.5 * (t / beam_px) ** 2)
    kernel /= np.sqrt((kernel**2).sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for idx, h, w, image in zip(b["idx"], b["h"], b["w"], b["image"], strict=True):
                m = np.asarray(image, np.float64).reshape(h, w)
                level = rms[0] + (rms[1] - rms[0]) * np.random.Generator(np.random.Philox([seed, int(idx)])).random()
                for k in range(trials):
                    noise = np.random.Generator(np.random.Philox([seed, int(idx) * trials + k + (1 << 40)])).standard_normal((h + 2 * reach, w + 2 * reach))
                    noise = sum(c * noise[i : i + h] for i, c in enumerate(kernel))
                    noise = sum(c * noise[:, i : i + w] for i, c in enumerate(kernel))
                    top = float(np.nanmax(m + level * noise))
                    rows.append((idx, k, level, float(np.nansum(np.maximum(m, 0))), top, top >= sigma * level))
            yield pd.DataFrame(rows, columns=["idx", "trial", "rms", "mock_flux", "peak", "detectable"])

    return df.select("idx", "h", "w", "image").mapInPandas(run, "idx long, trial int, rms double, mock_flux double, peak double, detectable boolean")


def pixels(df: DataFrame, key: str = "idx") -> DataFrame:
    """(key, y, x, v): the long form, for SQL on pixels."""
    return df.select(key, "w", F.posexplode("image").alias("p", "v")).select(key, F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
