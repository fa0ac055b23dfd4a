"""Labels and palettes from pixels alone, and backgrounds that keep art visible."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Grid step, shares of all pixels, distances in RGB.
STEP = 32
DEFINITE_SHARE, LEAST_SHARE = 0.02, 0.003
MERGE, BLEND, NEAR_WHITE = 24.0, 25.0, 32.0
WHITE_SHARE, BACKGROUND_GAP, BACKGROUND_TRIES = 0.4, 60.0, 10
WHITE = np.full(3, 255.0)


def flats(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(colours, counts) of the coarse colours that cover enough, near ones added to the more frequent."""
    cells = rgb.reshape(-1, 3).astype(np.int64) // STEP
    code, n = np.unique(cells @ [64, 8, 1], return_counts=True)
    colours = np.stack([code // 64, code // 8 % 8, code % 8], 1) * STEP + STEP / 2
    keep = n >= max(1, int(len(cells) * LEAST_SHARE))
    order = np.argsort(-n[keep], kind="stable")
    colours, n = colours[keep][order], n[keep][order]
    near = np.linalg.norm(colours[:, None] - colours[None], axis=2) < MERGE
    lead = np.arange(len(n))
    for i in range(len(n)):  # at most 512 colours
        into = np.flatnonzero(near[i, :i] & (lead[:i] == np.arange(i)))
        lead[i] = into[0] if len(into) else i
    return colours[lead == np.arange(len(n))], np.bincount(lead, n, len(n))[lead == np.arange(len(n))]


def between(colours: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which colours lie near the line between two of the ends: anti-aliasing, not flats."""
    a, b = np.triu_indices(len(ends), 1)
    if not len(a) or not len(colours):
        return np.zeros(len(colours), bool)
    d = ends[b] - ends[a]
    t = np.clip(((colours[:, None] - ends[a]) * d).sum(2) / np.maximum((d * d).sum(1), 1e-9), 0, 1)
    return (np.linalg.norm(colours[:, None] - ends[a] - t[..., None] * d, axis=2) < BLEND).any(1)


def labels_from_pixels(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label of each pixel, palette): label 0 is white background, others the nearest flat."""
    colours, n = flats(rgb)
    ink = np.linalg.norm(colours - WHITE, axis=1) >= NEAR_WHITE
    colours, n = colours[ink], n[ink]
    sure = n >= int(rgb.shape[0] * rgb.shape[1] * DEFINITE_SHARE)
    doubtful = colours[~sure]
    palette = np.concatenate([WHITE[None], colours[sure], doubtful[~between(doubtful, np.concatenate([WHITE[None], colours[sure]]))]])
    d = np.linalg.norm(rgb.reshape(-1, 1, 3) - palette[None], axis=2)
    return d.argmin(1).reshape(rgb.shape[:2]), palette.astype(np.uint8)


def background(palette: np.ndarray, seed: int) -> tuple[int, int, int]:
    """White for two in five seeds, else a colour far from every ink, white if none is found."""
    rng = np.random.default_rng(seed)
    if rng.random() < WHITE_SHARE:
        return 255, 255, 255
    tries = rng.integers(0, 256, (BACKGROUND_TRIES, 3))
    ok = (np.linalg.norm(tries[:, None] - palette[1:].astype(float), axis=2) > BACKGROUND_GAP).all(1)
    return tuple(int(x) for x in tries[ok.argmax()]) if ok.any() else (255, 255, 255)


def labelled_images(images: DataFrame, id: str = "vec_id", values: str = "embedding", side: int = 8) -> DataFrame:
    """(id, n_palette, label_nonzero_frac, background) of square grey blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, v in zip(f[id], f[values]):
                grey = np.clip(np.asarray(v, float).reshape(side, side) * 128 + 128, 0, 255)
                label, palette = labels_from_pixels(np.repeat(grey[..., None], 3, 2))
                rows.append((i, len(palette), float((label > 0).mean()), list(background(palette, int(i) * 7919 + 17))))
            yield pd.DataFrame(rows, columns=[id, "n_palette", "label_nonzero_frac", "background"])

    return images.select(id, values).mapInPandas(run, f"{id} long, n_palette int, label_nonzero_frac double, background array<int>")
