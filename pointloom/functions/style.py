"""Derived styling columns of a clustered view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgba(color: Sequence[int]) -> Column:
    if len(color) != 4 or any(not 0 <= c <= 255 for c in color):
        raise ValueError(f"not four numbers from 0 to 255: {color}")
    return F.array(*[F.lit(int(c)) for c in color])


def fill_color(node_id: Column, primary, secondary, selected, focused_id=None, selected_id=None, in_focus: Column | None = None) -> Column:
    """Selected before focused (or below the focused cluster) before the rest."""
    out = F.when(node_id == F.lit(selected_id), rgba(selected)) if selected_id is not None else F.when(F.lit(False), rgba(selected))
    if focused_id is not None:
        below = in_focus if in_focus is not None else F.lit(False)
        out = out.when((node_id == F.lit(focused_id)) | below, rgba(secondary))
    return out.otherwise(rgba(primary))


def radius(point_count: Column, total: int, lowest: float | None = None, highest: float | None = None) -> Column:
    """4 + 50 * ln(count + 1) / ln(total + 1), at 32-bit precision; optional pixel limits."""
    share = F.ln(point_count + 1.0) / F.ln(F.lit(total + 1.0)) if total > 0 else F.lit(0.0)
    out = (F.lit(4.0) + share * 50.0).cast("float")
    out = F.greatest(out, F.lit(lowest).cast("float")) if lowest is not None else out
    return F.least(out, F.lit(highest).cast("float")) if highest is not None else out


def linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(fill: Column) -> Column:
    return 0.2126 * linear(fill[0]) + 0.7152 * linear(fill[1]) + 0.0722 * linear(fill[2])


def text_color(fill: Column, opacity: int = 255, threshold: float = 0.5) -> Column:
    """Black on light fills, white on dark ones."""
    if not 0 <= opacity <= 255:
        raise ValueError(f"opacity must be from 0 to 255: {opacity}")
    tone = F.when(luminance(fill) > threshold, 0).otherwise(255)
    return F.array(tone, tone, tone, F.lit(opacity))


def label(is_cluster: Column, point_count: Column) -> Column:
    return F.when(is_cluster, point_count.cast("string"))


def text_angle(zoom: float, globe: bool = False) -> int:
    return 180 if globe and zoom <= 12 else 0
