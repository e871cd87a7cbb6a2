"""CSS colours as shades of electronic ink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ink_gray(color: Column) -> Column:
    """0, 85, 170 or 255 for rgb()/rgba(): Rec. 709 luma over white by alpha, at the nearest level; 0 for what can't be read."""
    inner = F.regexp_extract(F.lower(F.trim(color)), r"^rgba?\(([^)]*)\)$", 1)
    parts = F.filter(F.split(F.trim(inner), r"[\s,/]+"), lambda x: x != "")
    value = lambda i, full: _component(F.try_element_at(parts, F.lit(i)), full)
    r, g, b = (value(i, 255.0) for i in (1, 2, 3))
    alpha = F.when(F.size(parts) >= 4, value(4, 1.0)).otherwise(F.lit(1.0))
    clamp = lambda x, top: F.greatest(F.lit(0.0), F.least(F.lit(top), x))
    a = clamp(alpha, 1.0)
    luma = 0.2126 * clamp(r, 255.0) + 0.7152 * clamp(g, 255.0) + 0.0722 * clamp(b, 255.0)
    seen = luma * a + 255.0 * (1 - a)
    level = (F.floor(seen / 85 + 0.5) * 85).cast("int")
    readable = r.isNotNull() & g.isNotNull() & b.isNotNull() & alpha.isNotNull()  # greatest() passes over nulls
    return F.when(readable, F.greatest(F.lit(0), F.least(F.lit(255), level))).otherwise(F.lit(0))


def _component(text: Column, full: float) -> Column:
    """A number, or a percentage of full; null if neither."""
    number = F.regexp_extract(text, r"^([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))%?$", 1)
    plain = F.nullif(number, F.lit("")).cast("double")
    return F.when(text.endswith("%"), plain * full / 100).otherwise(plain)
