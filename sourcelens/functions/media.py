"""Frame and frame-pair functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the configuration.
LIMITS = {"fps": (0.1, 30.0), "ring_size": (4, 600), "frame_width": (64, 1920), "jpeg_quality": (2, 31), "snapshot_timeout": (1, 300), "audio_chunk": (1.5, 30.0)}


def clamp(x: Column, name: str) -> Column:
    lo, hi = LIMITS[name]
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Of vectors of equal length; infinity where lengths differ or one is empty or missing, so that such a frame is a new one."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.coalesce(same, F.lit(False)), F.try_divide(total, F.size(a))).otherwise(float("inf"))


def bbox(changed: Column, width: int) -> Column:
    """left, top, right, bottom of the true places of a flat array."""
    at = F.filter(F.transform(changed, lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(at, lambda i: i % width), F.transform(at, lambda i: F.floor(i / width).cast("int"))
    return F.when(F.size(at) > 0, F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), (F.array_max(xs) + 1).alias("right"), (F.array_max(ys) + 1).alias("bottom")))


def bbox_ratio(b: Column, width: Column, height: Column) -> Column:
    """To four places."""
    share = ((b["right"] - b["left"]) * (b["bottom"] - b["top"])).cast("double") / F.greatest(width * height, F.lit(1))
    return F.floor(share * 10000 + F.lit(0.5)) / 10000


def zones(b: Column, width: Column, height: Column) -> Column:
    x, y = (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2
    across = F.when(x < width / 3, "left").when(x > width * 2 / 3, "right").otherwise("center")
    down = F.when(y < height / 3, "top").when(y > height * 2 / 3, "bottom").otherwise("middle")
    edges = [
        F.when(b["top"] <= height * F.lit(0.18), "top_bar"), F.when(b["bottom"] >= height * F.lit(0.82), "bottom_bar"),
        F.when(b["left"] <= width * F.lit(0.18), "left_rail"), F.when(b["right"] >= width * F.lit(0.82), "right_rail"),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(F.concat_ws("_", down, across), *edges))))


def classify_action(ratio: Column, zone: Column, text_changed: Column, diff: Column) -> Column:
    """(action, confidence)."""
    def pair(name, sure):
        return F.struct(F.lit(name).alias("action"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"))

    chrome = F.array_contains(zone, "top_bar") | F.array_contains(zone, "left_rail")
    return (
        F.when(ratio.isNull(), pair("no_visible_change", 0.8)).when(ratio >= 0.45, pair("screen_transition", F.when(text_changed, F.lit(0.82)).otherwise(F.lit(0.72))))
        .when(chrome, pair("navigation_or_tool_change", F.when(text_changed, F.lit(0.72)).otherwise(F.lit(0.62))))
        .when(text_changed & (ratio <= 0.12), pair("text_entry_or_selection", 0.74)).when(text_changed, pair("content_update", 0.76))
        .when(ratio <= 0.03, pair("pointer_or_selection_change", 0.5)).when(F.coalesce(diff, F.lit(0.0)) >= 60, pair("visual_cut", 0.58)).otherwise(pair("layout_change", 0.55))
    )
