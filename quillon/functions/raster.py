"""Image kernels over small grey arrays: degradations and forensics, in Arrow batches.

Kernels take a float image in 0..255 and a severity in 0..1 (and a generator where they draw).
They follow the operations' definitions in numpy; results aren't bit-equal to any codec or
imaging library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillon.operators.similarity import dct_matrix

Kernel = Callable[[np.ndarray, float, np.random.Generator], np.ndarray]


def _blur(x: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return x
    r = max(1, int(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        x = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, np.pad(x, pad, "edge"))
    return x


def _resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    ys, xs = (np.arange(h) + 0.5) * x.shape[0] / h - 0.5, (np.arange(w) + 0.5) * x.shape[1] / w - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, x.shape[0] - 1), np.clip(np.floor(xs).astype(int), 0, x.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def downscale_upscale(x, s, rng):
    f = 1 - 0.75 * s
    return _resize(_resize(x, max(1, round(x.shape[0] * f)), max(1, round(x.shape[1] * f))), *x.shape)


def nearest_decimate(x, s, rng):
    step = 1 + round(3 * s)
    return np.repeat(np.repeat(x[::step, ::step], step, 0), step, 1)[: x.shape[0], : x.shape[1]]


def gaussian_blur(x, s, rng):
    return _blur(x, 2.5 * s)


def motion_blur(x, s, rng):
    n = 1 + 2 * round(3 * s)
    k = np.ones(n) / n
    return np.apply_along_axis(lambda v: np.convolve(np.pad(v, n // 2, "edge"), k, "valid"), 1, x)


def sinc_ringing(x, s, rng):
    f = np.fft.fft2(x)
    fy, fx = np.fft.fftfreq(x.shape[0])[:, None], np.fft.fftfreq(x.shape[1])[None]
    return np.fft.ifft2(f * (np.hypot(fy, fx) <= 0.5 - 0.35 * s)).real


def gaussian_noise(x, s, rng):
    return x + rng.normal(0, 25 * s, x.shape)


def poisson_noise(x, s, rng):
    peak = 255 * (1 - s) + 8
    return rng.poisson(np.clip(x, 0, 255) / 255 * peak) * 255 / peak


def unsharp_halo(x, s, rng):
    return x + 2 * s * (x - _blur(x, 1.5))


def posterize(x, s, rng):
    shift = round(5 * s)
    return (np.clip(x, 0, 255).astype(np.uint8) >> shift << shift).astype(float)


def paper(x, s, rng):
    return x * (1 - 0.3 * s * _blur(rng.random(x.shape), 1.0))


def bleed_through(x, s, rng):
    return x * (1 - 0.25 * s * (255 - _blur(x[:, ::-1], 1.5)) / 255)


def ink_bleed(x, s, rng):
    p = np.pad(x, 1, "edge")
    least = np.min([p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)], 0)
    return (1 - s) * x + s * least


# The tables that JPEG's standard gives as examples.
LUMA_TABLE = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61],
        [12, 12, 14, 19, 26, 58, 60, 55],
        [14, 13, 16, 24, 40, 57, 69, 56],
        [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77],
        [24, 35, 55, 64, 81, 104, 113, 92],
        [49, 64, 78, 87, 103, 121, 120, 101],
        [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)
CHROMA_TABLE = np.array(
    [
        [17, 18, 24, 47, 99, 99, 99, 99],
        [18, 21, 26, 66, 99, 99, 99, 99],
        [24, 26, 56, 99, 99, 99, 99, 99],
        [47, 66, 99, 99, 99, 99, 99, 99],
        [99, 99, 99, 99, 99, 99, 99, 99],
        [99, 99, 99, 99, 99, 99, 99, 99],
        [99, 99, 99, 99, 99, 99, 99, 99],
        [99, 99, 99, 99, 99, 99, 99, 99],
    ]
)
_DCT = dct_matrix(8)


def blocks_kept(x: np.ndarray, table: np.ndarray, quality: float) -> np.ndarray:
    """8x8 blocks of the cosine transform, rounded to the table's steps at this quality."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = np.clip(np.floor((table * scale + 50) / 100), 1, 255)
    h, w = x.shape
    p = np.pad(np.clip(x, 0, 255), ((0, -h % 8), (0, -w % 8)), "edge") - 128
    blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    kept = np.rint(_DCT @ blocks @ _DCT.T / steps) * steps
    return np.clip(np.rint((_DCT.T @ kept @ _DCT).swapaxes(1, 2).reshape(p.shape)[:h, :w] + 128), 0, 255)


def quantised(x: np.ndarray, quality: float) -> np.ndarray:
    """What a JPEG of this quality keeps of a grey image."""
    return blocks_kept(x, LUMA_TABLE, quality)


def jpeg_cycle(x, s, rng):
    return quantised(x, 95 - 85 * s)


def jpeg_chain(x, s, rng):
    """Two to four passes, each with its own quality and block grid."""
    for _ in range(int(rng.integers(2, 5))):
        dy, dx = rng.integers(0, 8, 2)
        shifted = np.pad(x, ((dy, 0), (dx, 0)), "edge")
        x = quantised(shifted, float(np.clip(95 - 85 * s * rng.uniform(0.6, 1.1), 5, 95)))[dy:, dx:]
    return x


def web_upscale(x, s, rng):
    """A small JPEG, enlarged and sharpened."""
    f = 1 - 0.75 * s
    small = quantised(_resize(x, max(1, round(x.shape[0] * f)), max(1, round(x.shape[1] * f))), 90 - 60 * s)
    return unsharp_halo(_resize(small, *x.shape), 0.5 * s, rng)


def dither(x, s, rng):
    """A few levels taken from the image's own quantiles, errors spread to the right and below."""
    levels = np.unique(np.quantile(x, np.linspace(0, 1, max(2, round(16 * (1 - s))))))
    h, w = x.shape
    left = np.pad(x, ((0, 1), (1, 1)))
    out = np.empty_like(x)
    for i in range(h):
        for j in range(w):
            v = left[i, j + 1]
            out[i, j] = near = levels[np.abs(levels - v).argmin()]
            e = (v - near) / 16
            left[i, j + 2] += 7 * e
            left[i + 1, j : j + 3] += np.array([3, 5, 1]) * e
    return out


def halftone(x, s, rng):
    y, z = np.mgrid[: x.shape[0], : x.shape[1]]
    dots = (np.cos(np.pi * y / 2) * np.cos(np.pi * z / 2) + 1) / 2 * 255
    return (1 - s) * x + s * np.where(x > dots, 255, 0)


def illumination(x, s, rng):
    return x * (1 - 0.5 * s * np.linspace(0, 1, x.shape[1])[None])


def cast_shadow(x, s, rng):
    edge = rng.uniform(0.2, 0.8) * x.shape[1]
    return x * np.where(np.arange(x.shape[1])[None] > edge, 1 - 0.5 * s, 1)


def geometric_warp(x, s, rng, m: np.ndarray | None = None, nearest: bool = False):
    """Samples at the inverse of a small homography; nearest keeps labels whole."""
    h, w = x.shape
    m = np.eye(3) + s * rng.uniform(-0.05, 0.05, (3, 3)) * [[1, 1, w], [1, 1, h], [1 / w, 1 / h, 0]] if m is None else m
    y, z = np.mgrid[:h, :w]
    at = np.linalg.inv(m) @ np.stack([z.ravel(), y.ravel(), np.ones(h * w)])
    u, v = np.clip(at[0] / at[2], 0, w - 1), np.clip(at[1] / at[2], 0, h - 1)
    if nearest:
        return x[np.rint(v).astype(int), np.rint(u).astype(int)].reshape(h, w)
    u0, v0 = np.floor(u).astype(int), np.floor(v).astype(int)
    u1, v1 = np.minimum(u0 + 1, w - 1), np.minimum(v0 + 1, h - 1)
    fu, fv = u - u0, v - v0
    return ((x[v0, u0] * (1 - fu) + x[v0, u1] * fu) * (1 - fv) + (x[v1, u0] * (1 - fu) + x[v1, u1] * fu) * fv).reshape(h, w)


OPS: dict[str, Kernel] = {f.__name__: f for f in (jpeg_cycle, jpeg_chain, web_upscale, dither, downscale_upscale, nearest_decimate, gaussian_blur, motion_blur, sinc_ringing, gaussian_noise, poisson_noise, unsharp_halo, posterize, paper, bleed_through, ink_bleed, halftone, illumination, cast_shadow, geometric_warp)}


#: Names that older recipes use.
ALIASES = {"dither_palette_crush": "dither", "aniso_motion_blur": "motion_blur"}


def apply_op(name: str, x: np.ndarray, severity: float, seed: int) -> np.ndarray:
    """The same for the same image, operation, severity and seed."""
    name = ALIASES.get(name, name)
    out = OPS[name](x.astype(float), severity, np.random.default_rng([seed, *name.encode()]))
    return np.clip(out, 0, 255)


def noise_sigma(x: np.ndarray) -> float:
    """Median absolute deviation of the diagonal differences of neighbouring pixels (a quarter of
    each), over 0.6745. On white noise that is half its deviation: the differences are not
    scaled to be orthonormal."""
    if min(x.shape) < 2:
        return 0.0
    d = (x[:-1, :-1] - x[:-1, 1:] - x[1:, :-1] + x[1:, 1:]) / 4
    return float(np.median(np.abs(d - np.median(d))) / 0.6745)


def edge_ringing(x: np.ndarray) -> float:
    """Mean absolute high-pass (a blur of 1.5 taken away) beside the strongest edges, over the contrast.

    Strongest are the Laplacians above the 98th percentile; beside is within two pixels, the
    edges themselves left out. 0 without edges.
    """
    p = np.pad(x, 1, "reflect" if min(x.shape) > 1 else "edge")
    bend = np.abs(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x)
    edge = bend > np.percentile(bend, 98)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(edge, 2), (5, 5)).any((2, 3)) & ~edge
    if not near.any():
        return 0.0
    return float(np.abs(x - _blur(x, 1.5))[near].mean() / (x.std() + 1e-6))


def _images(f: pd.DataFrame, side: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, v in zip(f["vec_id"], f["embedding"]):
        yield i, np.clip(np.asarray(v, float).reshape(side, side) * 128 + 128, 0, 255)


def degraded(blocks: DataFrame, side: int, severity: float = 0.7, seed: int = 7) -> DataFrame:
    """(vec_id, op, mean_change): every operation on every block, seeded by the block's id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, op, float(np.abs(apply_op(op, x, severity, seed + int(i)) - x).mean())) for i, x in _images(f, side) for op in OPS]
            yield pd.DataFrame(rows, columns=["vec_id", "op", "mean_change"])

    return blocks.select("vec_id", "embedding").mapInPandas(run, "vec_id long, op string, mean_change double")


def forensics(blocks: DataFrame, side: int) -> DataFrame:
    """(vec_id, noise_sigma, edge_ringing)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, noise_sigma(x), edge_ringing(x)) for i, x in _images(f, side)], columns=["vec_id", "noise_sigma", "edge_ringing"])

    return blocks.select("vec_id", "embedding").mapInPandas(run, "vec_id long, noise_sigma double, edge_ringing double")
