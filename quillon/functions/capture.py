"""Degradations of a capture path on colour images, each from resolved parameters.

An operation takes an image (height x width x 3, values 0 to 255), its parameters and a
generator, and gives an image of whole numbers. The same image, parameters and generator
state give the same result. Codecs, resampling and filters follow their definitions in numpy
and aren't bit-equal to an imaging library; a WEBP pass is done with the JPEG transform.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.functions.raster import CHROMA_TABLE, LUMA_TABLE, blocks_kept

Image = np.ndarray


def whole(x: Image) -> Image:
    return np.floor(np.clip(x, 0, 255))


# --- resampling, filters


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1, np.where(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a, 0))


def _weights(n: int, m: int, kind: str) -> np.ndarray:
    """m x n matrix that resamples n values to m."""
    out = np.zeros((m, n))
    if kind == "nearest":
        out[np.arange(m), np.minimum(np.arange(m) * n // m, n - 1)] = 1
        return out
    if kind == "area" and m <= n:
        lo = np.arange(m)[:, None] * n / m
        at = np.arange(n)[None]
        out = np.clip(np.minimum(at + 1, lo + n / m) - np.maximum(at, lo), 0, None)
        return out / out.sum(1, keepdims=True)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    base = np.floor(centre).astype(int)
    taps = range(-1, 3) if kind == "bicubic" else range(2)
    for k in taps:
        w = _cubic(centre - base - k) if kind == "bicubic" else 1 - np.abs(centre - base - k)
        np.add.at(out, (np.arange(m), np.clip(base + k, 0, n - 1)), w)
    return out


def resize(x: Image, h: int, w: int, kind: str) -> Image:
    return np.einsum("ai,ijc,bj->abc", _weights(x.shape[0], h, kind), x, _weights(x.shape[1], w, kind), optimize=True)


def convolve(x: Image, kernel: np.ndarray) -> Image:
    """Correlation with an odd kernel; the image is mirrored at its border pixels."""
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = np.pad(x, ((r, r), (c, c), (0, 0)), "reflect" if min(x.shape[:2]) > max(r, c) else "symmetric")
    out = np.zeros(x.shape)
    for i, j in np.argwhere(kernel):
        out += kernel[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]]
    return out


def gaussian(x: Image, sigma: float) -> Image:
    r = max(3, int(sigma * 3) | 1) // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return convolve(convolve(x, k[:, None]), k[None])


def _spot(kind: str, p: dict) -> np.ndarray:
    """Kernel of a motion line, a defocus disc or a turned ellipse."""
    if kind == "motion":
        r = max(3, int(p["length"]) | 1) // 2
    elif kind == "defocus":
        r = max(1, int(p["radius"]))
    else:
        r = max(1, int(3 * max(p["sigma_x"], p["sigma_y"])))
    y, x = np.mgrid[-r : r + 1, -r : r + 1].astype(float)
    turn = np.deg2rad(p.get("angle", 0.0))
    along, across = x * np.cos(turn) + y * np.sin(turn), y * np.cos(turn) - x * np.sin(turn)
    if kind == "motion":
        out = np.clip(1 - np.abs(across), 0, 1) * (np.abs(along) <= r + 0.5)
    elif kind == "defocus":
        out = (x * x + y * y <= r * r).astype(float)
    else:
        out = np.exp(-((along / p["sigma_x"]) ** 2 + (across / p["sigma_y"]) ** 2) / 2)
    return out / out.sum() if out.sum() > 0 else np.ones((1, 1))


# --- codec

_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def codec(x: Image, quality: float, subsampling: int = 2) -> Image:
    """What a JPEG keeps; chroma is averaged over 1x1, 1x2 or 2x2 pixels for subsampling 0, 1, 2."""
    ycc = x @ _TO_YCC.T + [0, 128, 128]
    fy, fx = ((1, 1), (1, 2), (2, 2))[subsampling]
    h, w = x.shape[:2]
    out = [blocks_kept(ycc[..., 0], LUMA_TABLE, quality)]
    for c in (1, 2):
        p = np.pad(ycc[..., c], ((0, -h % fy), (0, -w % fx)), "edge")
        small = p.reshape(p.shape[0] // fy, fy, p.shape[1] // fx, fx).mean((1, 3))
        out.append(np.repeat(np.repeat(blocks_kept(small, CHROMA_TABLE, quality), fy, 0), fx, 1)[:h, :w])
    return np.clip(np.rint((np.stack(out, 2) - [0, 128, 128]) @ np.linalg.inv(_TO_YCC).T), 0, 255)


def jpeg_chain(x, p, rng):
    """Passes on grids that are shifted against each other."""
    for quality, sub, shift in zip(p["qualities"], p["subsampling"], p["grid_shifts"]):
        x = np.roll(codec(np.roll(x, (shift, shift), (0, 1)), quality, sub), (-shift, -shift), (0, 1))
    return x


def jpeg_cycle(x, p, rng):
    for _ in range(int(p.get("passes", 1))):
        x = codec(x, p["quality"], p.get("subsampling", 2))
    return x


def web_upscale(x, p, rng):
    """A small image, coded while small, perhaps with fewer colours, then enlarged and perhaps coded again."""
    side = int(p["small_size"])
    small = codec(whole(resize(x, side, side, "area")), p["small_quality"], p["small_subsampling"])
    if p.get("posterize_bits"):
        small = posterize(small, {"bits": p["posterize_bits"]}, rng)
    if p.get("dither_colours"):
        small = dither(small, {"n_colours": p["dither_colours"]}, rng)
    out = whole(resize(small, *x.shape[:2], p["interp"]))
    return codec(out, p["final_quality"], 2) if p.get("final_quality") else out


def downscale_upscale(x, p, rng):
    h, w = (max(4, round(n * p["factor"])) for n in x.shape[:2])
    return resize(whole(resize(x, h, w, p["down_filter"])), *x.shape[:2], p["up_filter"])


def nearest_decimate(x, p, rng):
    step = int(p["stride"])
    return resize(x[::step, ::step], *x.shape[:2], "nearest")


def gaussian_blur(x, p, rng):
    return gaussian(x, float(p["sigma"]))


def aniso_motion_blur(x, p, rng):
    return convolve(x, _spot(p["kind"], p))


def sinc_ringing(x, p, rng):
    """An ideal low-pass: only frequencies within this share of the highest one stay."""
    fy, fx = np.fft.fftfreq(x.shape[0])[:, None, None], np.fft.fftfreq(x.shape[1])[None, :, None]
    return np.fft.ifft2(np.fft.fft2(x, axes=(0, 1)) * (np.hypot(fy, fx) <= 0.5 * p["cutoff"]), axes=(0, 1)).real


def gaussian_noise(x, p, rng):
    return x + rng.normal(0, p["std"], (*x.shape[:2], 1 if p.get("gray") else 3))


def poisson_noise(x, p, rng):
    """Shot noise; a lower gain is a darker exposure. gray: the same noise in all channels."""
    light = x.mean(2, keepdims=True) if p.get("gray") else x
    return x + rng.poisson(np.clip(light, 0, None) * p["gain"]) / p["gain"] - light


def unsharp_halo(x, p, rng):
    return x + p["amount"] * (x - gaussian(x, p["radius"]))


def posterize(x, p, rng):
    """Levels of so many bits, each at the middle of its step."""
    step = 1 << (8 - min(8, max(1, round(p["bits"]))))
    return x // step * step + step // 2


def dither(x, p, rng):
    """An adaptive palette by median cut; every pixel takes the nearest colour."""
    colours = x.reshape(-1, 3)
    boxes = [np.unique(colours, axis=0, return_counts=True)]
    for _ in range(min(256, max(2, round(p["n_colours"]))) - 1):
        wide = [np.ptp(c, axis=0).max() * n.sum() for c, n in boxes]
        i = int(np.argmax(wide))
        if not wide[i]:
            break
        c, n = boxes.pop(i)
        order = np.argsort(c[:, np.ptp(c, axis=0).argmax()], kind="stable")
        c, n = c[order], n[order]
        cut = int(np.clip(np.searchsorted(np.cumsum(n), n.sum() / 2) + 1, 1, len(c) - 1))
        boxes += [(c[:cut], n[:cut]), (c[cut:], n[cut:])]
    palette = np.rint([np.average(c, axis=0, weights=n) for c, n in boxes])
    return palette[((colours[:, None] - palette[None]) ** 2).sum(2).argmin(1)].reshape(x.shape)


def paper(x, p, rng):
    """Ink over tinted paper with slow shade and fine fibre."""
    h, w = x.shape[:2]
    slow = resize(rng.normal(0, 1, (max(2, h // 32), max(2, w // 32), 1)), h, w, "bicubic")
    sheet = np.array(p["tint"], float) * (1 + p["shade"] * slow) + 255 * rng.normal(0, p["fibre"], (h, w, 1))
    return x * np.clip(sheet, 0, 255) / 255


def bleed_through(x, p, rng):
    """The mirrored front, blurred and displaced, as a faint shadow."""
    back = np.roll(whole(gaussian(x[:, ::-1], p["blur"])), (p["offset"], p["offset"]), (0, 1))
    return x * (1 - p["opacity"] * (255 - back) / 255)


def ink_bleed(x, p, rng):
    """The darkest (thicken) or lightest neighbour; then some pixels on edges are inverted."""
    k = max(1, int(p["ksize"]))
    pad = np.pad(x, ((k // 2, k - 1 - k // 2), (k // 2, k - 1 - k // 2), (0, 0)), "edge")
    near = np.lib.stride_tricks.sliding_window_view(pad, (k, k), (0, 1))
    out = near.min((3, 4)) if p["mode"] == "thicken" else near.max((3, 4))
    if p.get("flip", 0) > 0:
        grey = np.pad(out.mean(2), 1, "reflect" if min(x.shape[:2]) > 1 else "edge")
        bend = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
        hit = (np.abs(bend) > 8) & (rng.random(bend.shape) < p["flip"])
        out = np.where(hit[..., None], 255 - out, out)
    return out


def halftone(x, p, rng):
    """A turned dot screen for each channel, descreened by a blur and mixed with the image."""
    y, z = np.mgrid[: x.shape[0], : x.shape[1]].astype(float)
    turn = np.deg2rad(np.array(p["angles"], float))
    f = 2 * np.pi * p["lpi"] / max(x.shape[:2])
    u, v = z[..., None] * np.cos(turn) + y[..., None] * np.sin(turn), y[..., None] * np.cos(turn) - z[..., None] * np.sin(turn)
    dots = np.where(x / 255 > (np.sin(f * u) * np.sin(f * v) + 1) / 2, 255.0, 0.0)
    if p["descreen"] > 0:
        dots = gaussian(dots, p["descreen"])
    return x + (dots - x) * p.get("mix", 0.6)


def illumination(x, p, rng):
    """Light that changes along one direction, from minus to plus half the strength."""
    y, z = np.mgrid[: x.shape[0], : x.shape[1]]
    turn = np.deg2rad(p["angle"])
    g = z / x.shape[1] * np.cos(turn) + y / x.shape[0] * np.sin(turn)
    return x * (1 + p["strength"] * ((g - g.min()) / (np.ptp(g) + 1e-6) - 0.5))[..., None]


def cast_shadow(x, p, rng):
    """A darkened polygon with a soft edge."""
    y, z = np.mgrid[: x.shape[0], : x.shape[1]]
    corners, within = [tuple(c) for c in p["poly"]], np.zeros(x.shape[:2], bool)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if y0 != y1:
            within ^= ((y >= min(y0, y1)) & (y < max(y0, y1))) & (z < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return x * (1 - p["opacity"] * gaussian(within[..., None].astype(float), p["blur"]))


def warped(x: np.ndarray, m: np.ndarray, nearest: bool = False, fill: float | None = None) -> np.ndarray:
    """x (with or without channels) seen through the homography m; outside, the border or fill."""
    h, w = x.shape[:2]
    y, z = np.mgrid[:h, :w]
    at = np.linalg.inv(m) @ np.stack([z.ravel(), y.ravel(), np.ones(h * w)])
    u, v = at[0] / at[2], at[1] / at[2]
    out = (u < -0.5) | (v < -0.5) | (u > w - 0.5) | (v > h - 0.5)
    u, v = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    if nearest:
        got = x[np.rint(v).astype(int), np.rint(u).astype(int)]
    else:
        u0, v0 = np.floor(u).astype(int), np.floor(v).astype(int)
        u1, v1 = np.minimum(u0 + 1, w - 1), np.minimum(v0 + 1, h - 1)
        part = lambda t: (t).reshape(-1, *[1] * (x.ndim - 2))
        fu, fv = part(u - u0), part(v - v0)
        got = (x[v0, u0] * (1 - fu) + x[v0, u1] * fu) * (1 - fv) + (x[v1, u0] * (1 - fu) + x[v1, u1] * fu) * fv
    if fill is not None:
        got[out] = fill
    return got.reshape(x.shape)


def geometric_warp(x, p, rng):
    return warped(x, np.array(p["matrix"], float))


OPS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        jpeg_chain, jpeg_cycle, web_upscale, downscale_upscale, nearest_decimate, gaussian_blur, aniso_motion_blur, sinc_ringing, gaussian_noise, poisson_noise,
        unsharp_halo, posterize, dither, paper, bleed_through, ink_bleed, halftone, illumination, cast_shadow, geometric_warp,
    )
}


def replay(x: Image, ops: list[dict], seed: int | list[int]) -> tuple[Image, np.ndarray]:
    """(image, homography) after all steps; draws come from the seed, whatever drew the recipe."""
    rng, m = np.random.default_rng(seed), np.eye(3)
    x = np.asarray(x, float)
    for step in ops:
        x = whole(OPS[step["op"]](x, step["params"], rng))
        if step["op"] == "geometric_warp":
            m = np.array(step["params"]["matrix"], float) @ m
    return x, m


def warp_labels(labels: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Labels under the homography that replay() returned: nearest ones, 0 outside."""
    return warped(labels, m, nearest=True, fill=0)


def is_identity(m: np.ndarray, slack: float = 1e-6) -> bool:
    return bool(np.allclose(m, np.eye(3), atol=slack))


def captured(images: DataFrame, ops: list[dict], seed: int, id: str = "id", values: str = "rgb", side: int | None = None) -> DataFrame:
    """(id, values, homography): square colour images (row by row, r g b) after the steps.

    Draws depend on the seed and the id alone. Null images stay null, with no homography.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, turns = [], []
            for i, v in zip(b.column(id).to_pylist(), b.column(values)):
                if not v.is_valid:
                    out.append(None)
                    turns.append(None)
                    continue
                n = side or round((len(v) / 3) ** 0.5)
                x, m = replay(v.values.to_numpy(zero_copy_only=False).reshape(n, -1, 3), ops, [seed, abs(int(i or 0))])
                out.append(x.ravel().astype(np.int32))
                turns.append(m.ravel())
            yield pa.RecordBatch.from_arrays([b.column(id), pa.array(out, pa.list_(pa.int32())), pa.array(turns, pa.list_(pa.float64()))], [id, values, "homography"])

    return images.select(id, values).mapInArrow(run, f"{id} {images.schema[id].dataType.simpleString()}, {values} array<int>, homography array<double>")
