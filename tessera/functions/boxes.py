"""Column functions on boxes: geometry, bands, coordinate tokens, overlap.

A box is four double columns x0, y0, x1, y1 (or a struct of them); image sizes are columns w and h.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coordinate bins, the grid's thirds and the box shapes' bounds.
BINS = 1024
WIDE_ABOVE, TALL_BELOW = 1.5, 0.67
TOKEN_GROUP = r"<loc(\d{4})><loc(\d{4})><loc(\d{4})><loc(\d{4})>"


def corners(x: Column, y: Column, width: Column, height: Column, whole: bool = False) -> Column:
    """xywh to corners; whole: each edge is rounded half to even."""
    edges = [x, y, x + width, y + height]
    edges = [F.rint(e) if whole else e for e in edges]
    return F.struct(*(e.alias(n) for e, n in zip(edges, ("x0", "y0", "x1", "y1"), strict=True)))


def box_error(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, tolerance: float = 0.0) -> Column:
    """Why a box is invalid, or null. An empty box is reported before one outside the image."""
    outside = (x0 < -tolerance) | (y0 < -tolerance) | (x1 > w + tolerance) | (y1 > h + tolerance) | (x0 >= w) | (y0 >= h)
    return F.when(~((x0 < x1) & (y0 < y1)), "zero_area_or_inverted_bbox").when(outside, "bbox_outside_image")


def box_features(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> dict[str, Column]:
    width, height = x1 - x0, y1 - y0
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return {
        "bbox_width": width,
        "bbox_height": height,
        "center_x": cx,
        "center_y": cy,
        "bbox_area": width * height,
        "bbox_area_ratio": width * height / (w * h),
        "bbox_width_norm": width / w,
        "bbox_height_norm": height / h,
        "aspect_ratio": width / height,
        "center_x_norm": cx / w,
        "center_y_norm": cy / h,
    }


def third(position: Column, names: tuple[str, str, str]) -> Column:
    return F.when(position < 1 / 3, names[0]).when(position < 2 / 3, names[1]).otherwise(names[2])


def horizontal(cx_norm: Column) -> Column:
    return third(cx_norm, ("left", "center", "right"))


def vertical(cy_norm: Column) -> Column:
    return third(cy_norm, ("upper", "middle", "lower"))


def region(cx_norm: Column, cy_norm: Column) -> Column:
    return F.concat_ws("-", vertical(cy_norm), horizontal(cx_norm))


def band(value: Column, first: Column, second: Column, names: tuple[str, str, str] = ("low", "mid", "high")) -> Column:
    """Three-way banding with inclusive upper bounds."""
    return F.when(value <= first, names[0]).when(value <= second, names[1]).otherwise(names[2])


def size_band(ratio: Column, small_max: Column, medium_max: Column) -> Column:
    return band(ratio, small_max, medium_max, ("small", "medium", "large"))


def shape(aspect: Column) -> Column:
    return F.when(aspect > WIDE_ABOVE, "wide").when(aspect < TALL_BELOW, "tall").otherwise("compact")


def bin_of(value: Column, size: Column) -> Column:
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(float(BINS - 1)), value / size * BINS))).cast("int")


def tokens(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """The four coordinate tokens, y before x."""
    bins = [bin_of(y0, h), bin_of(x0, w), bin_of(y1, h), bin_of(x1, w)]
    return F.concat(*(part for b in bins for part in (F.lit("<loc"), F.lpad(b.cast("string"), 4, "0"), F.lit(">"))))  # bins have four digits at most


def target_text(parts: Column, eos: bool = True) -> Column:
    """Several token strings (an array) as one target; none leaves the end mark alone."""
    return F.concat(F.array_join(parts, " ; "), F.lit("<eos>" if eos else ""))


def decoded(text: Column, w: Column, h: Column, label: str | None = None) -> Column:
    """The boxes (array of structs) that a text states; label: only those followed by it."""
    pattern = TOKEN_GROUP + (rf"\s+({label})" if label else "")
    # one pattern finds a box; its tokens are of equal length, so the bins stand at fixed places
    pixel = lambda m, k, size: F.substring(m, 5 + 9 * k, 4).cast("double") / BINS * size
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(pixel(m, 1, w).alias("x0"), pixel(m, 0, h).alias("y0"), pixel(m, 3, w).alias("x1"), pixel(m, 2, h).alias("y1")))
    return F.coalesce(found, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))


def iou(a: dict[str, Column] | Column, b: dict[str, Column] | Column) -> Column:
    """Overlap over union; 0 where there is no union or a box is missing."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    inter = wide * high
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - inter
    present = a["x0"].isNotNull() & b["x0"].isNotNull()
    return F.when(present & (union > 0), F.try_divide(inter, union)).otherwise(F.lit(0.0))


def box(prefix: str = "") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in ("x0", "y0", "x1", "y1")}


def clip_box(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """The whole-pixel box inside the image, of at least one pixel each way."""
    left, top = F.least(F.greatest(F.floor(x0), F.lit(0)), w.cast("long") - 1), F.least(F.greatest(F.floor(y0), F.lit(0)), h.cast("long") - 1)
    right, bottom = F.least(F.ceil(x1), w.cast("long")), F.least(F.ceil(y1), h.cast("long"))
    return F.struct(left.alias("x0"), top.alias("y0"), F.greatest(right, left + 1).alias("x1"), F.greatest(bottom, top + 1).alias("y1"))


def millionths(value: Column) -> Column:
    """A real value as a whole number of millionths: sums of these are exact, whatever the order."""
    return F.floor(value * 1e6 + 0.5).cast("long")


def exact_mean(value: Column) -> Column:
    """Mean to the millionth, independent of the order of the rows."""
    return F.sum(millionths(value)) / (F.count(value) * 1e6)
