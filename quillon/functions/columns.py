"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Largest difference from the background, by channel, that isn't ink.
BACKGROUND_SLACK = 6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact_hash(text) -> Column:
    return F.sha2(_c(text), 256)


def flat_pixels(grey) -> Column:
    """Aggregate over a pixel table: too flat to be told apart (deviation below 8, or ink on under 2 % or over 98 %)."""
    ink = F.avg(F.when(_c(grey) < 250, 1.0).otherwise(0.0))
    return (F.stddev_pop(_c(grey)) < 8) | (ink < 0.02) | (ink > 0.98)


def luma(r, g, b) -> Column:
    return 0.299 * _c(r) + 0.587 * _c(g) + 0.114 * _c(b)


def is_background(r, g, b, white: int = 255) -> Column:
    return ~is_ink(r, g, b, (white, white, white))


def is_ink(r, g, b, background: tuple[int, int, int] = (255, 255, 255)) -> Column:
    out = F.lit(False)
    for k, v in zip((r, g, b), background):
        out = out | (F.abs(_c(k) - v) > BACKGROUND_SLACK)
    return out


def over(colour: Column, under: Column, alpha: float) -> Column:
    return colour * alpha + under * (1 - alpha)


def decimals(token) -> Column:
    t = _c(token)
    return F.when(F.lower(t).contains("e"), 6).when(t.contains("."), F.length(t) - F.instr(t, ".")).otherwise(0)


def posterize(channel, bits: int) -> Column:
    return F.shiftleft(F.shiftright(_c(channel), 8 - bits), 8 - bits)


def item_seed(stem, seed: int) -> Column:
    return (F.crc32(_c(stem)) + seed).bitwiseAND(0x7FFFFFFF)


def variant_seed(seed, i: int) -> Column:
    return _c(seed) * 100003 + i


def background_seed(seed) -> Column:
    return _c(seed) * 7919 + 17


def scaled_rate(batch) -> Column:
    return 3e-4 * F.sqrt(_c(batch) / 8.0)


def palette_bucket(n) -> Column:
    n = _c(n)
    return F.when(n <= 2, "1-2").when(n <= 4, "3-4").when(n <= 9, "5-9").otherwise("10+")


def recipe_text(steps: Column) -> Column:
    """`op(0.25) + op(0.50)` of an array of structs with op and severity."""
    return F.array_join(F.transform(steps, lambda s: F.format_string("%s(%.2f)", s["op"], s["severity"].cast("double"))), " + ")


def nearest_colour(palette: list[tuple[int, int, int]], r="r", g="g", b="b") -> Column:
    """Index of the nearest colour, the lowest of equals; the palette is a short literal."""
    scored = [F.struct((F.pow(_c(r) - x, 2) + F.pow(_c(g) - y, 2) + F.pow(_c(b) - z, 2)).alias("d"), F.lit(i).alias("i")) for i, (x, y, z) in enumerate(palette)]
    return F.array_min(F.array(*scored))["i"]


def srgb_to_lab(r, g, b) -> Column:
    """struct l, a, b under D65."""
    lin = [F.when(_c(k) / 255.0 <= 0.04045, _c(k) / 255.0 / 12.92).otherwise(F.pow((_c(k) / 255.0 + 0.055) / 1.055, 2.4)) for k in (r, g, b)]
    rows = [(0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.072175, 1.0), (0.0193339, 0.119192, 0.9503041, 1.08883)]
    f = []
    for x, y, z, white in rows:
        t = (x * lin[0] + y * lin[1] + z * lin[2]) / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116))
    return F.struct((116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def delta_e(x: str, y: str) -> Column:
    return F.sqrt(F.pow(F.col(f"{x}.l") - F.col(f"{y}.l"), 2) + F.pow(F.col(f"{x}.a") - F.col(f"{y}.a"), 2) + F.pow(F.col(f"{x}.b") - F.col(f"{y}.b"), 2))


def palette_slots(pixels: DataFrame, image: str, entry: str, slots: int) -> DataFrame:
    """slot of each palette entry: entry 0 stays 0, others by luma, then colour; capped at slots - 1."""
    w = Window.partitionBy(image).orderBy(F.when(F.col(entry) == 0, 0).otherwise(1), F.round(luma("r", "g", "b"), 6), "r", "g", "b", entry)
    rank = F.when(F.col(entry) == 0, F.lit(0)).otherwise(F.row_number().over(w) - 1)
    return pixels.select(image, entry, F.least(rank, F.lit(slots - 1)).cast("long").alias("slot"))


def jpeg_quality(table) -> Column:
    """Quality from the mean of a 64-entry quantisation table, from 1 to 100; null for other sizes.

    A table is (base * scale + 50) / 100, so its mean gives the scale, and the scale the quality.
    57.625 is the mean of the standard luma table.
    """
    t = _c(table)
    mean = F.aggregate(t, F.lit(0.0), lambda a, v: a + v) / 64
    scale = F.greatest((100 * mean - 50) / 57.625, F.lit(1e-6))
    q = F.when(scale > 100, 5000 / scale).otherwise((200 - scale) / 2)
    return F.when(F.size(t) == 64, F.greatest(F.lit(1.0), F.least(F.lit(100.0), q)))
