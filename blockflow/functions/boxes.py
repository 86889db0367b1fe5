"""Box arithmetic as Column expressions; a box is (x, y, w, h)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in "xywh")


def intersection(a, b) -> Column:
    """Shared area of two boxes."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def overlap_ratio(a, b) -> Column:
    """Shared area over the smaller area (not over the union)."""
    smaller = F.least(a[2] * a[3], b[2] * b[3])
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(0.0)


def union_ratio(a, b) -> Column:
    """Intersection over union."""
    shared = intersection(a, b)
    return shared / (a[2] * a[3] + b[2] * b[3] - shared + F.lit(1e-9))


def overlap_of(a: dict, b: dict) -> float:
    """The same ratio for two rows inside a fold."""
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    smaller = min(a["w"] * a["h"], b["w"] * b["h"])
    return w * h / smaller if w > 0 and h > 0 and smaller > 0 else 0.0


def union_ratio_of(a: dict, b: dict) -> float:
    """Intersection over union for two rows inside a fold."""
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    shared = w * h if w > 0 and h > 0 else 0.0
    return shared / (a["w"] * a["h"] + b["w"] * b["h"] - shared + 1e-9)
