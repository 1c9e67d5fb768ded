"""Line images in long form (img_id, y, x, v): profiles, bands, boxes, windows and quality metrics.

Gray values are 0 to 255, ink is dark on white. Windows are partitioned by image (and column or row), images are
at most a page wide, and all sums are of whole numbers, so nothing here depends on floating point rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds and pads in gray values and pixels.
INK_DARKNESS, DARK, BAND_PAD, BOX_PAD = 40, 200, 4, 4
# Darkness, gap, widths by characters and pad of a line that ends at a valley; the gray that strokes become at most.
LINE_DARKNESS, VALLEY_GAP, CHAR_LEAST, CHAR_MOST, LEAST_WIDTH, FEW_CHARS, STROKE = 50, 10, 18, 32, 36, 12, 40


def ink(v="v") -> Column:
    return (255 - F.col(v)) > INK_DARKNESS


def dark(v="v") -> Column:
    return F.col(v) < DARK


def whiten(v: Column) -> Column:
    return F.when(v > 160, 255).otherwise(v)


def invert_dark(pixels: DataFrame) -> DataFrame:
    """Images darker than 127 on average are inverted; light grays are whitened first."""
    w = Window.partitionBy("img_id")
    white = pixels.withColumn("v", whiten(F.col("v")))
    total = white.withColumn("s", F.sum("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return total.select("img_id", "y", "x", F.when(F.col("s") < 127 * F.col("n"), 255 - F.col("v")).otherwise(F.col("v")).alias("v"))


def row_profile(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id", "y").agg(F.count_if(ink()).alias("ink"))


def column_profile(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id", "x").agg(F.count_if(ink()).alias("ink"))


def smooth_profile(profile: DataFrame, axis: str = "y", reach: int = 2) -> DataFrame:
    """smooth5: the sum over 2 * reach + 1 places, missing ones zero (that many times the mean).

    Images with fewer places than the kernel get as many places as the kernel has: the middle of a full convolution is
    as long as its longer operand, and it is moved towards the start then.
    """
    size = 2 * reach + 1
    img = Window.partitionBy("img_id")
    p = profile.withColumn("last", F.max(axis).over(img))
    short = (F.col(axis) == F.col("last")) & (F.col("last") < size - 1)
    places = F.when(short, F.sequence(F.col(axis), F.lit(size - 1))).otherwise(F.array(axis))
    p = p.withColumn("at", F.explode(places)).withColumn("ink", F.when(F.col("at") == F.col(axis), F.col("ink")).otherwise(0))
    total = lambda shift: F.sum("ink").over(img.orderBy("at").rangeBetween(shift - size + 1, shift))
    moved = F.floor(F.col("last") / 2)
    summed = total(reach)
    for shift in range(reach):
        summed = F.when((F.col("last") < size - 1) & (moved == shift), total(shift)).otherwise(summed)
    return p.select("img_id", F.col("at").alias(axis), "ink", summed.alias("smooth5"))


def runs(profile: DataFrame, axis: str) -> DataFrame:
    """(img_id, run, b0, b1, mass): the stretches of a profile that are `on`, in order, with their ink."""
    by = Window.partitionBy("img_id").orderBy(axis)
    begun = F.when(F.col("on") & ~F.coalesce(F.lag("on").over(by), F.lit(False)), 1).otherwise(0)
    numbered = profile.withColumn("new", begun).withColumn("run", F.sum("new").over(by))
    return numbered.where("on").groupBy("img_id", "run").agg(F.min(axis).alias("b0"), F.max(axis).alias("b1"), F.sum("ink").alias("mass"))


def densest_band(pixels: DataFrame) -> DataFrame:
    """(img_id, y0, y1): rows of the densest line of each image, inclusive; the whole image if it has one line or little ink."""
    p = smooth_profile(row_profile(pixels))
    img = Window.partitionBy("img_id")
    p = p.withColumn("most", F.max("ink").over(img)).withColumn("top", F.max("smooth5").over(img))
    # smooth >= max(3, 0.15 max) on sums of five: at least 15, and 20 sums at least 3 of the largest
    on = p.withColumn("on", (F.col("smooth5") >= 15) & (20 * F.col("smooth5") >= 3 * F.col("top")))
    bands = runs(on, "y")
    best = bands.groupBy("img_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("mass", (-F.col("b0")).alias("first"), "b1")).alias("b"))
    size = pixels.groupBy("img_id").agg((F.max("y") + 1).alias("h"))
    most = p.groupBy("img_id").agg(F.max("ink").alias("most"))
    joined = size.join(most, "img_id").join(best, "img_id", "left")
    split = (F.col("most") >= 5) & (F.coalesce("n", F.lit(0)) > 1)
    return joined.select(
        "img_id",
        F.when(split, F.greatest(F.lit(0), -F.col("b.first") - BAND_PAD)).otherwise(0).cast("int").alias("y0"),
        F.when(split, F.least(F.col("h") - 1, F.col("b.b1") + BAND_PAD)).otherwise(F.col("h") - 1).cast("int").alias("y1"),
    )


def ink_bbox(pixels: DataFrame) -> DataFrame:
    """(img_id, x0, y0, x1, y1): box of dark pixels, ends exclusive; null for images without any."""
    at = lambda c: F.when(dark(), F.col(c))
    return pixels.groupBy("img_id").agg(
        F.min(at("x")).alias("x0"), F.min(at("y")).alias("y0"), (F.max(at("x")) + 1).alias("x1"), (F.max(at("y")) + 1).alias("y1")
    )


def crop_extent(pixels: DataFrame, pad: int = BOX_PAD) -> DataFrame:
    """(img_id, x0, y0, x1, y1): the ink's box with a pad, within the image; the whole image if it has no ink."""
    at = lambda c: F.when(ink(), F.col(c))
    a = pixels.groupBy("img_id").agg(
        F.min(at("x")).alias("a"), F.min(at("y")).alias("b"), F.max(at("x")).alias("c"), F.max(at("y")).alias("d"),
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"),
    )
    low = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.greatest(F.lit(0), F.col(c) - pad))
    high = lambda c, end: F.when(F.col(c).isNull(), F.col(end)).otherwise(F.least(F.col(end), F.col(c) + pad + 1))
    return a.select("img_id", low("a").alias("x0"), low("b").alias("y0"), high("c", "w").alias("x1"), high("d", "h").alias("y1"))


def densest_window(pixels: DataFrame, width: int) -> DataFrame:
    """(img_id, x0, x1): the leftmost of the windows of `width` columns with most ink; the centre if there is hardly any."""
    cols = column_profile(pixels)
    ahead = Window.partitionBy("img_id").orderBy("x").rowsBetween(0, width - 1)
    img = Window.partitionBy("img_id")
    s = cols.withColumn("score", F.sum("ink").over(ahead)).withColumn("w", F.max("x").over(img) + 1)
    best = s.where((F.col("x") <= F.col("w") - width) | (F.col("w") <= width)).groupBy("img_id", "w").agg(F.max(F.struct("score", (-F.col("x")).alias("left"))).alias("b"))
    x0 = F.when(F.col("w") <= width, 0).when(F.col("b.score") < 5, F.floor((F.col("w") - width) / 2)).otherwise(-F.col("b.left")).cast("int")
    return best.select("img_id", x0.alias("x0"), (x0 + F.least(F.col("w"), F.lit(width))).cast("int").alias("x1"))


def ink_metrics(pixels: DataFrame) -> DataFrame:
    """(img_id, w, n_pixels, n_ink, ink_w, n_left): what the quality rules need; n_left is ink in the left 15 percent."""
    width = Window.partitionBy("img_id")
    p = pixels.withColumn("w", F.max("x").over(width) + 1)
    left = F.greatest(F.lit(1), F.floor(F.col("w") * 15 / 100))
    at = F.when(dark(), F.col("x"))
    return p.groupBy("img_id", "w").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.count_if(dark()).alias("n_ink"),
        F.coalesce(F.max(at) - F.min(at) + 1, F.lit(0)).alias("ink_w"), F.count_if(dark() & (F.col("x") < left)).alias("n_left"),
    )


def valley_crop(pixels: DataFrame, chars: int, pad: int = BOX_PAD) -> DataFrame:
    """(img_id, x0, y0, x1, y1, total): the line of so many characters at the left of each image, ends exclusive, and its sum of grays.

    Dark images are inverted. The line goes from the first stretch of ink to the stretch before a gap that is long enough, once it is
    wide enough, and is no wider than its characters allow; images with hardly any ink stay whole.
    """
    img = Window.partitionBy("img_id")
    grays = pixels.withColumn("mean_low", F.sum("v").over(img) < 127 * F.count(F.lit(1)).over(img))
    grays = grays.select("img_id", "y", "x", F.when(F.col("mean_low"), 255 - F.col("v")).otherwise(F.col("v")).alias("v"))
    inked = 255 - F.col("v") > LINE_DARKNESS
    columns = grays.groupBy("img_id", "x").agg(F.count_if(inked).alias("ink"))
    p = smooth_profile(columns, "x", 3).withColumn("top", F.max("smooth5").over(img))
    # smooth > max(2, 0.15 max) on sums of seven
    on = p.withColumn("on", (F.col("smooth5") > 14) & (100 * F.col("smooth5") > 15 * F.col("top")))
    by = img.orderBy("b0")
    ordered = runs(on, "x").withColumn("start", F.min("b0").over(img)).withColumn("before", F.lag("b1").over(by))
    enough = F.col("before") - F.col("start") + 1 >= max(LEAST_WIDTH, CHAR_LEAST * chars)
    stop = (F.col("b0") - F.col("before") - 1 >= VALLEY_GAP) & enough
    ends = ordered.groupBy("img_id", "start").agg(F.coalesce(F.min(F.when(stop, F.col("before"))), F.max("b1")).alias("end"))
    size = columns.groupBy("img_id").agg((F.max("x") + 1).alias("w"), F.max("ink").alias("most"))
    line = size.join(ends, "img_id", "left")
    widest = F.least(F.col("w"), F.lit(CHAR_MOST * chars + 24)) if chars <= FEW_CHARS else F.col("w")
    whole = (F.col("most") < 2) | F.col("start").isNull()
    end = F.least(F.col("end"), F.col("start") + widest - 1)
    line = line.select(
        "img_id", whole.alias("whole"), F.when(whole, 0).otherwise(F.greatest(F.lit(0), F.col("start") - pad)).alias("x0"),
        F.when(whole, F.col("w")).otherwise(F.least(F.col("w"), end + pad + 1)).alias("x1"),
    )
    within = grays.join(line, "img_id").withColumn("h", F.max("y").over(img) + 1).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    at = F.when(inked & ~F.col("whole"), F.col("y"))
    top, bottom = F.min(at).over(img), F.max(at).over(img)
    within = within.withColumn("y0", F.coalesce(F.greatest(F.lit(0), top - pad), F.lit(0))).withColumn("y1", F.coalesce(F.least(F.col("h"), bottom + pad + 1), F.col("h")))
    return within.groupBy("img_id", "x0", "y0", "x1", "y1").agg(F.sum(F.when((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")), F.col("v"))).alias("total"))


def thicken(pixels: DataFrame) -> DataFrame:
    """pixels whose dark ones have grown by one to the right and down, and are STROKE at most."""
    row, column = Window.partitionBy("img_id", "y").orderBy("x"), Window.partitionBy("img_id", "x").orderBy("y")
    wide = pixels.withColumn("dark", dark()).withColumn("dark", F.col("dark") | F.coalesce(F.lag("dark").over(row), F.lit(False)))
    wide = wide.withColumn("dark", F.col("dark") | F.coalesce(F.lag("dark").over(column), F.lit(False)))
    return wide.select("img_id", "y", "x", F.when(F.col("dark"), F.least(F.col("v"), F.lit(STROKE))).otherwise(F.col("v")).alias("v"))


def laplacian(pixels: DataFrame) -> DataFrame:
    """(img_id, y, x, edge): |2 (corners) - 8 v|, with grays mirrored at the edges (the edge pixel itself in images of one row or column)."""
    row, column = Window.partitionBy("img_id", "y").orderBy("x"), Window.partitionBy("img_id", "x").orderBy("y")
    near = lambda c, w: (F.lag(c).over(w), F.lead(c).over(w))
    left, right = near("v", row)
    sides = pixels.withColumn("sides", F.coalesce(left, right, F.col("v")) + F.coalesce(right, left, F.col("v")))
    up, down = near("sides", column)
    corners = F.coalesce(up, down, F.col("sides")) + F.coalesce(down, up, F.col("sides"))
    return sides.withColumn("corners", corners).select("img_id", "y", "x", F.abs(2 * F.col("corners") - 8 * F.col("v")).alias("edge"))
