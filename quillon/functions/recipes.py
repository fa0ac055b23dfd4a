"""Degradation recipes drawn from seeds that depend on the item alone."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillon.functions import capture

# Shares of the families, their steps with the chance of each, and ranges of parameters.
# ("by", a, b): from a at severity 0 to b at severity 1; ("any", a, b): uniform; ("whole", a, b): a whole
# number, b excluded; ("pick", values, chances); ("low", a, b, c): uniform from a to what goes from c to b.
SHARES = {"jpeg_chain": 0.20, "web_upscale": 0.22, "office_roundtrip": 0.18, "lowres_pdf": 0.14, "scan": 0.12, "phone_photo": 0.08, "mild": 0.06}
ZERO_SHARE, FINISH_SHARE, BETA = 0.12, 0.6, (2, 3)
FINISH = ("sinc_ringing", {"cutoff": ("by", 0.9, 0.4), "order_swapped": True})
MOTION = ("aniso_motion_blur", {"kind": "aniso", "sigma_x": ("by", 0.2, 1.2), "sigma_y": ("by", 0.2, 0.9), "angle": ("any", 0, 180)})
STEPS = {
    "jpeg_chain": [(0.3, *MOTION), (0.4, "downscale_upscale", {"factor": ("by", 1.0, 0.7), "down_filter": "area", "up_filter": "bilinear"}), (1, "jpeg_chain", {"passes": "passes"})],
    "web_upscale": [(1, "web_upscale", {"small_size": ("by int", 96, 16), "small_quality": ("low int", 30, 55, 80), "small_subsampling": 2, "interp": ("pick", ["nearest", "bicubic", "bilinear"], [0.4, 0.4, 0.2])})],
    "scan": [
        (1, "paper", {"tint": "tint", "shade": ("by", 0.02, 0.12), "fibre": ("by", 0.003, 0.02)}),
        (0.3, "bleed_through", {"blur": ("any", 1.0, 2.5), "offset": ("whole", -4, 5), "opacity": ("by", 0.05, 0.2)}),
        (0.6, "ink_bleed", {"mode": ("pick", ["thicken", "thin"], [0.5, 0.5]), "ksize": 3, "flip": ("by", 0.0, 0.05)}),
        (0.7, "halftone", {"lpi": ("any", 65, 185), "angles": "angles", "descreen": ("any", 0.6, 1.6), "mix": ("by", 0.3, 0.7)}),
        (1, "geometric_warp", {"matrix": ("turn", (0.5, 4.0), (0.0, 0.0))}),
        (0.5, "illumination", {"angle": ("any", 0, 360), "strength": ("by", 0.05, 0.3)}),
        (1, "gaussian_noise", {"std": ("by", 2, 10), "gray": False}),
        (1, "poisson_noise", {"gain": ("by", 0.5, 0.08), "gray": True}),
        (1, "jpeg_cycle", {"quality": ("by int", 92, 60), "subsampling": 2, "passes": 1}),
    ],
    "office_roundtrip": [
        (0.5, "downscale_upscale", {"factor": ("by", 1.0, 0.6), "down_filter": "bilinear", "up_filter": "bicubic"}),
        (0.3, "posterize", {"bits": ("by round", 7, 4)}),
        (0.3, "dither", {"n_colours": ("by round", 64, 8)}),
        (0.5, "jpeg_cycle", {"quality": ("by int", 92, 72), "subsampling": 2, "codec": "WEBP", "passes": 1}),
        (0.6, "jpeg_cycle", {"quality": ("by int", 92, 70), "subsampling": 2, "codec": "JPEG", "passes": 1}),
    ],
    "phone_photo": [
        (1, "paper", {"tint": "tint", "shade": ("by", 0.03, 0.15), "fibre": ("by", 0.002, 0.01)}),
        (1, "geometric_warp", {"matrix": ("turn", (1.0, 4.0), (0.0, 0.03))}),
        (1, "illumination", {"angle": ("any", 0, 360), "strength": ("by", 0.08, 0.35)}),
        (0.6, "cast_shadow", {"poly": "poly", "blur": ("any", 8, 25), "opacity": ("by", 0.1, 0.4)}),
        (1, "aniso_motion_blur", {"kind": ("pick", ["aniso", "defocus"], [0.5, 0.5]), "sigma_x": ("by", 0.3, 2.5), "sigma_y": ("by", 0.3, 1.5), "angle": ("any", 0, 180), "radius": ("by int", 1, 4)}),
        (1, "poisson_noise", {"gain": ("by", 0.4, 0.06), "gray": ("pick", [True, False], [0.4, 0.6])}),
        (1, "jpeg_cycle", {"quality": ("by int", 90, 55), "subsampling": 2, "passes": 1}),
    ],
    "lowres_pdf": [
        (1, "downscale_upscale", {"factor": ("by", 0.6, 0.2), "down_filter": "area", "up_filter": "bilinear"}),
        (1, "gaussian_blur", {"sigma": ("by", 0.4, 2.5)}),
        (0.5, "sinc_ringing", {"cutoff": ("by", 0.9, 0.35)}),
        (1, "jpeg_cycle", {"quality": ("by int", 85, 50), "subsampling": 2, "passes": 1}),
    ],
    "mild": [(0.5, "gaussian_blur", {"sigma": ("by", 0.3, 1.0)}), (0.4, "gaussian_noise", {"std": ("by", 1, 5), "gray": False}), (1, "jpeg_cycle", {"quality": ("by int", 95, 80), "subsampling": 0, "passes": 1})],
}
#: Steps of which a recipe has one at most, and the one that an otherwise empty recipe gets.
EITHER, OTHERWISE = {"office_roundtrip": ("posterize", "dither")}, {"office_roundtrip": "posterize"}
#: Chance of two and of four passes at severities 0 and 1 (three take the rest), of subsampled chroma and of WEBP in a pass, quality of a pass.
TWO_PASSES, FOUR_PASSES, PASS_CHROMA, PASS_WEBP, PASS_QUALITY = (0.7, 0.15), (0.1, 0.5), 0.7, 0.2, (30, 55, 95)
#: web_upscale: WEBP, a closing pass and its quality, fewer colours, by bits or by palette.
WEB_WEBP, WEB_FINAL, WEB_QUALITY, WEB_FEWER, WEB_BITS, WEB_COLOURS = 0.15, 0.5, (92, 70), 0.4, (6, 3), (48, 6)
#: Paper: level, warmth, darkest blue. Screen angles against the first draw.
TINT, WARMTH, LEAST_BLUE, SCREENS = (238, 253), (0, 8), 220, (15, 75, 0)
FAMILIES = SHARES


class _Draw:
    """Values of a recipe's parameters at one severity."""

    def __init__(self, rng: np.random.Generator, severity: float, size: int):
        self.rng, self.s, self.size = rng, severity, size

    def between(self, ends: tuple[float, float]) -> float:
        return ends[0] + (ends[1] - ends[0]) * self.s

    def low(self, floor: float, least: float, most: float) -> float:
        top = self.between((most, least))
        return float(self.rng.uniform(min(floor, top), max(floor, top)))

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def value(self, spec):
        if isinstance(spec, str) and hasattr(self, f"_{spec}"):
            return getattr(self, f"_{spec}")()
        if not isinstance(spec, tuple):
            return spec
        kind, *args = spec
        how, _, cut = kind.partition(" ")
        if how == "by":
            v = self.between(args)
        elif how == "low":
            v = self.low(*args)
        elif how == "any":
            v = float(self.rng.uniform(*args))
        elif how == "whole":
            v = int(self.rng.integers(*args))
        elif how == "pick":
            v = args[0][int(self.rng.choice(len(args[0]), p=args[1]))]
        else:
            v = self._homography(*args)
        return int(v) if cut == "int" else round(v) if cut == "round" else v

    def _tint(self) -> list[int]:
        level, warm = int(self.rng.integers(*TINT)), int(self.rng.integers(*WARMTH))
        return [level, level, max(LEAST_BLUE, level - warm)]

    def _angles(self) -> list[float]:
        first = float(self.rng.uniform(0, 90))
        return [first + a for a in SCREENS]

    def _poly(self) -> list[list[int]]:
        x = self.rng.uniform(0, self.size, 4).astype(int).tolist()
        return [[x[0], 0], [x[1], 0], [x[2], self.size], [x[3], self.size]]

    def _homography(self, degrees: tuple[float, float], shift: tuple[float, float]) -> list[list[float]]:
        """A turn about the middle, then corners moved by a share of the side."""
        most, far = self.between(degrees), self.between(shift)
        turn, c = np.deg2rad(self.rng.uniform(-most, most)), self.size / 2
        middle = np.array([[1, 0, c], [0, 1, c], [0, 0, 1.0]])
        m = middle @ np.array([[np.cos(turn), -np.sin(turn), 0], [np.sin(turn), np.cos(turn), 0], [0, 0, 1]]) @ np.linalg.inv(middle)
        if far > 0:
            corners = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]) * self.size
            m = projection(corners, corners + self.rng.uniform(-far, far, (4, 2)) * self.size) @ m
        return m.tolist()

    def passes(self) -> dict:
        two, four = self.between(TWO_PASSES), self.between(FOUR_PASSES)
        chances = np.array([two, max(0.0, 1 - two - four), four])
        n = int(self.rng.choice([2, 3, 4], p=chances / chances.sum()))
        return {
            "passes": n,
            "qualities": [int(self.low(*PASS_QUALITY)) for _ in range(n)],
            "subsampling": [2 if self.chance(PASS_CHROMA) else 0 for _ in range(n)],
            "codecs": ["WEBP" if self.chance(PASS_WEBP) else "JPEG" for _ in range(n)],
            "grid_shifts": [0, *self.rng.integers(0, 8, n - 1).tolist()],  # the first pass is aligned
        }

    def web(self) -> dict:
        out = {"small_codec": "WEBP" if self.chance(WEB_WEBP) else "JPEG", "final_quality": int(self.between(WEB_QUALITY)) if self.chance(WEB_FINAL) else None}
        if self.chance(WEB_FEWER):
            out |= {"posterize_bits": round(self.between(WEB_BITS))} if self.chance(0.5) else {"dither_colours": round(self.between(WEB_COLOURS))}
        return out


def projection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The homography that takes four points to four others."""
    rows = [r for (x, y), (u, v) in zip(a, b) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    return np.append(np.linalg.solve(np.array(rows, float), np.asarray(b, float).ravel()), 1).reshape(3, 3)


def steps_of(family: str, rng: np.random.Generator, severity: float, size: int = 256) -> list[dict]:
    """The steps of a family, in order, with resolved parameters."""
    draw, out = _Draw(rng, severity, size), []
    either, done = EITHER.get(family, ()), False
    for chance, op, params in STEPS[family]:
        if op in either:  # the second has what the first left of the common chance
            chance = 0 if done else chance if op == either[0] else chance / (1 - chance)
        if not draw.chance(chance):
            continue
        done = done or op in either
        own = {k: draw.value(v) for k, v in params.items() if v != "passes"}
        own |= draw.passes() if op == "jpeg_chain" else draw.web() if op == "web_upscale" else {}
        out.append({"op": op, "params": own})
    if not out:
        op = OTHERWISE[family]
        out.append({"op": op, "params": {k: draw.value(v) for _, name, p in STEPS[family] if name == op for k, v in p.items()}})
    return out


def sample_recipe(seed: int, size: int = 256) -> dict:
    """family, global_severity (an eighth is zero, else Beta(2, 3)) and ops with severities and parameters.

    At severity zero there are no ops. Unless the family is mild, a low-pass step is put before
    the last one with a probability of 0.6. Family, severity and steps come from separate
    streams of the seed; what is drawn when a recipe is applied comes from yet another seed.
    """
    family_rng, severity_rng, step_rng = (np.random.default_rng(s) for s in np.random.SeedSequence(seed).spawn(3))
    names = list(SHARES)
    family = names[int(family_rng.choice(len(names), p=[SHARES[n] for n in names]))]
    severity = 0.0 if severity_rng.random() < ZERO_SHARE else float(severity_rng.beta(*BETA))
    if not severity:
        return {"family": family, "global_severity": 0.0, "ops": []}
    ops = steps_of(family, step_rng, severity, size)
    if family != "mild" and step_rng.random() < FINISH_SHARE:
        draw = _Draw(step_rng, severity, size)
        ops.insert(len(ops) - 1, {"op": FINISH[0], "params": {k: draw.value(v) for k, v in FINISH[1].items()}})
    return {"family": family, "global_severity": round(severity, 4), "ops": [s | {"severity": round(severity, 4)} for s in ops]}


def replay(x: np.ndarray, recipe: dict, seed: int) -> np.ndarray:
    """The image after the recipe; a grey one comes back grey."""
    grey = x.ndim == 2
    out, _ = capture.replay(np.repeat(x[..., None], 3, 2) if grey else x, recipe["ops"], seed)
    return out.mean(2) if grey and recipe["ops"] else x.astype(float) if grey else out


def epoch_seed(seed: int, epoch: int, index: int, freeze: bool = False) -> int:
    """One seed for each (seed, epoch, index); frozen sets stay in epoch 0."""
    return int(np.random.SeedSequence([seed, 0 if freeze else epoch, index]).generate_state(1)[0])


def damaged(images: DataFrame, epoch: int, seed: int = 1000, freeze: bool = False, id: str = "vec_id", values: str = "embedding", side: int = 8) -> DataFrame:
    """(id, family, n_ops, damage): recipes drawn and applied on the fly, anew in each epoch.

    A row's damage depends on its id, the seed and the epoch alone; ids must not be negative.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, v in zip(f[id], f[values]):
                x = np.clip(np.asarray(v, float).reshape(side, side) * 128 + 128, 0, 255)
                own = epoch_seed(seed, epoch, int(i), freeze)
                recipe = sample_recipe(own, side)
                rows.append((i, recipe["family"], len(recipe["ops"]), replay(x, recipe, own).ravel().tolist()))
            yield pd.DataFrame(rows, columns=[id, "family", "n_ops", "damage"])

    return images.select(id, values).mapInPandas(run, f"{id} long, family string, n_ops int, damage array<double>")


def sampled(items: DataFrame, key: str, seed: int = 1000) -> DataFrame:
    """(key, family, global_severity, n_ops, ops as JSON): the same for the same key and seed."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, r["family"], r["global_severity"], len(r["ops"]), json.dumps(r["ops"])) for k in f[key] for r in (sample_recipe(int(k) * 100003 + seed),)]
            yield pd.DataFrame(rows, columns=[key, "family", "global_severity", "n_ops", "ops"])

    return items.select(key).mapInPandas(run, f"{key} long, family string, global_severity double, n_ops int, ops string")


# Fixed values of the tiers: number of steps, severities, share with a closing JPEG.
TIERS = {"light": ((1, 2), (0.10, 0.35), 0.7), "medium": ((2, 3), (0.30, 0.65), 0.85), "brutal": ((3, 4), (0.55, 0.95), 0.95)}
TIER_STEPS = ["downscale_upscale", "gaussian_blur", "unsharp_halo", "posterize", "dither_palette_crush", "gaussian_noise"]
IDENTITY_SHARE, BARELY_SHARE, BARELY = 0.12, 0.30, 0.3


def tier_recipe(seed: int, tier: str = "medium", curriculum: bool = False) -> list[dict]:
    """Steps with severities for a tier; in a fifth of those with JPEG it is the last but one.

    With a curriculum, 12 % of recipes are empty and the next 18 % barely damage.
    """
    (least, most), (low, high), share = TIERS[tier]
    rng = np.random.default_rng(seed)
    count, jpeg = int(rng.integers(least, most + 1)), bool(rng.random() < share)
    names = [str(x) for x in rng.permutation(TIER_STEPS)[: count - jpeg]]
    steps = [{"op": x, "severity": round(float(rng.uniform(low, high)), 3)} for x in names]
    if jpeg:
        at = len(steps) - (1 if steps and rng.random() < 0.2 else 0)
        steps.insert(at, {"op": "jpeg_cycle", "severity": round(float(rng.uniform(low, high)), 3)})
    if curriculum:
        draw = rng.random()
        if draw < IDENTITY_SHARE:
            return []
        if draw < BARELY_SHARE:
            return [s | {"severity": round(s["severity"] * BARELY, 4)} for s in steps]
    return steps


def tier_recipes(items: DataFrame, key: str, tier: str = "medium", curriculum: bool = True) -> DataFrame:
    """(key, n_ops, ops as JSON), by the item's key alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, len(r), json.dumps(r)) for k in f[key] for r in (tier_recipe(int(k) * 100003, tier, curriculum),)]
            yield pd.DataFrame(rows, columns=[key, "n_ops", "ops"])

    return items.select(key).mapInPandas(run, f"{key} long, n_ops int, ops string")
