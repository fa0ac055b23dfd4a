"""Label maps as pixel tables: shrinking by vote, and the palette that the labels come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Cells to either side in which an inked cell without a label looks for one.
REACH = 2
WHITE_SLACK = 6


def shrink(fine: DataFrame, ink: DataFrame, factor: int, image: str = "vec_id") -> DataFrame:
    """(image, y, x, label): the most frequent label of each block, the lowest of equals.

    fine: image, y, x, label; ink: image, y, x, ink, in cells of the result. Where the vote is
    background (0) but the cell is inked, the block's most frequent other label wins; without
    one, the nearest label within two cells, by distance, then row, then column. Cells that
    ink lacks, or with a null ink, count as not inked.
    """
    at = [image, "y", "x"]
    block = fine.select(image, F.floor(F.col("y") / factor).cast("long").alias("y"), F.floor(F.col("x") / factor).cast("long").alias("x"), "label")
    n = block.groupBy(*at, "label").agg(F.count("*").alias("n"))
    most = F.struct("n", (-F.col("label")).alias("l"))
    votes = n.groupBy(*at).agg((-F.max(most)["l"]).alias("all"), (-F.max(F.when(F.col("label") != 0, most))["l"]).alias("drawn"))
    cells = votes.join(ink.select(*at, "ink"), at, "left").withColumn("ink", F.coalesce("ink", F.lit(False)))
    cells = cells.withColumn("label", F.when((F.col("all") == 0) & F.col("ink"), F.coalesce("drawn", F.lit(0))).otherwise(F.col("all")))
    around = F.array(*[F.struct(F.lit(dy * dy + dx * dx).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-REACH, REACH + 1) for dx in range(-REACH, REACH + 1) if dy or dx])
    open_ = cells.where("label = 0 and ink").select(image, F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(around).alias("o"))
    open_ = open_.withColumns({"y": F.col("_y") + F.col("o.dy"), "x": F.col("_x") + F.col("o.dx")})
    near = open_.join(cells.where("label <> 0").select(*at, "label"), at).groupBy(image, "_y", "_x").agg(F.min(F.struct("o", "label"))["label"].alias("found"))
    out = cells.join(near.toDF(image, "y", "x", "found"), at, "left")
    return out.select(*at, F.coalesce("found", "label").cast("int").alias("label"))


def settled(pixels: DataFrame, image: str = "vec_id") -> DataFrame:
    """(image, label, number, r, g, b, n): the palette of an image's labels (label 0 is left out).

    pixels: image, y, x, label, r, g, b. A label's colour is the median over its pixels whose
    four neighbours have the same label, or over all of them if there are none. Labels whose
    colour is nearly white become background (number 0); the others are numbered from 1.
    """
    row, column = Window.partitionBy(image, "y").orderBy("x"), Window.partitionBy(image, "x").orderBy("y")
    same = lambda f, w: F.coalesce(f("label").over(w) == F.col("label"), F.lit(False))
    inner = same(F.lag, row) & same(F.lead, row) & same(F.lag, column) & same(F.lead, column)
    p = pixels.withColumn("_in", inner).where("label <> 0")
    middle = lambda k: F.bround(F.coalesce(F.percentile(F.when(F.col("_in"), F.col(k)), F.lit(0.5)), F.percentile(k, F.lit(0.5)))).cast("int")
    palette = p.groupBy(image, "label").agg(*[middle(k).alias(k) for k in "rgb"], F.count("*").alias("n"))
    drawn = F.least("r", "g", "b") < 255 - WHITE_SLACK
    number = F.when(drawn, F.sum(drawn.cast("int")).over(Window.partitionBy(image).orderBy("label"))).otherwise(0).cast("int")
    return palette.select(image, "label", number.alias("number"), "r", "g", "b", "n")
