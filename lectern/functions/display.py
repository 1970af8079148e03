"""Colours, gradients, patterns and plane transformations as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.reading import THEMES, js_round


def channels(colour: Column) -> list[Column]:
    """Red, green and blue of #rrggbb."""
    digits = F.replace(colour, F.lit("#"), F.lit(""))
    return [F.conv(F.substring(digits, at, 2), 16, 10).cast("int") for at in (1, 3, 5)]


def colour_of(*parts: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(js_round(p).cast("long"))), 2, "0") for p in parts])


def luminance(colour: Column) -> Column:
    linear = [F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))) for v in (c / 255 for c in channels(colour))]
    return linear[0] * 0.2126 + linear[1] * 0.7152 + linear[2] * 0.0722


def contrast(one: Column, other: Column) -> Column:
    """Ratio of the relative luminances, from 1 to 21."""
    a, b = luminance(one), luminance(other)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def meets_contrast(background: Column, text: Column, threshold: float = 4.5) -> Column:
    return contrast(background, text) >= threshold


def contrast_colour(colour: Column) -> Column:
    r, g, b = channels(colour)
    return F.when((r * 0.299 + g * 0.587 + b * 0.114) / 255 > 0.5, "#000000").otherwise("#FFFFFF")


def brightened(colour: Column, percent: Column | float) -> Column:
    return colour_of(*[F.least(F.lit(255.0), F.greatest(F.lit(0.0), c + c * percent / 100)) for c in channels(colour)])


def gloss(colour: Column) -> Column:
    return brightened(colour, 30)


def shadow(colour: Column, intensity: Column) -> Column:
    parts = [js_round(F.greatest(F.lit(0.0), c * 0.3)).cast("string") for c in channels(colour)]
    return F.concat(F.lit("rgba("), F.concat_ws(", ", *parts, (intensity / 100 * 0.8).cast("string")), F.lit(")"))


def theme_colours(theme: Column, custom: Column) -> tuple[Column, Column]:
    """Background and text colour of a theme; a custom background gets black or white text."""
    back, text = F.lit("#000000"), F.lit("#FFFFFF")
    for name, (b, t) in THEMES.items():
        back, text = F.when(theme == name, b).otherwise(back), F.when(theme == name, t).otherwise(text)
    return F.when(theme == "custom", custom).otherwise(back), F.when(theme == "custom", contrast_colour(custom)).otherwise(text)


def gradient_points(angle: Column) -> dict[str, Column]:
    """Ends of a gradient's line in per cent of the screen."""
    turn = angle * math.pi / 180
    return {"x1": F.cos(turn + math.pi) * 50 + 50, "y1": F.sin(turn + math.pi) * 50 + 50, "x2": F.cos(turn) * 50 + 50, "y2": F.sin(turn) * 50 + 50}


def gradient_stops(colours: Column) -> Column:
    return F.transform(colours, lambda c, i: F.struct((i / (F.size(colours) - 1) * 100).alias("offset"), c.alias("colour")))


def alpha_hex(opacity: Column) -> Column:
    return F.lpad(F.lower(F.hex(js_round(opacity * 255).cast("long"))), 2, "0")


def noise_points(size: Column) -> Column:
    """The 25 dots of the noise pattern at a scale in per cent: cx, cy, r, opacity."""
    unit = lambda x: (x + 1) / 2
    scaled = size * 8 / 100

    def dot(i: Column) -> Column:
        seed = i * 0.12345
        return F.struct((unit(F.sin(seed)) * scaled).alias("cx"), (unit(F.cos(seed * 1.3)) * scaled).alias("cy"), (unit(F.sin(seed * 2.1)) * 0.6 + 0.4).alias("r"), (unit(F.cos(seed * 3.7)) * 0.15 + 0.05).alias("opacity"))

    return F.transform(F.sequence(F.lit(0), F.lit(24)), dot)


#: A plane transformation is a struct of these: x' = a x + c y + e, y' = b x + d y + f.
MATRIX = ("a", "b", "c", "d", "e", "f")


def matrix(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(MATRIX, values, strict=True)])


def multiplied(m: Column, n: Column) -> Column:
    """First ``n``, then ``m``."""
    return matrix(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"], m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"], m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"]
    )


def inverted(m: Column) -> Column:
    """The inverse; null where there is none."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    det = F.when(F.abs(det) >= 2.220446049250313e-16, det)
    inverse = matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det)
    return F.when(det.isNotNull(), inverse)


def translated(m: Column, x: Column | float, y: Column | float) -> Column:
    return multiplied(m, matrix(1, 0, 0, 1, x, y))


def scaled(m: Column, x: Column | float, y: Column | float) -> Column:
    return multiplied(m, matrix(x, 0, 0, y, 0, 0))


def rotated(m: Column, degrees: Column | float) -> Column:
    turn = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    return multiplied(m, matrix(F.cos(turn), F.sin(turn), -F.sin(turn), F.cos(turn), 0, 0))


def skewed(m: Column, x: float = 0.0, y: float = 0.0) -> Column:
    return multiplied(m, matrix(1, math.tan(math.radians(y)), math.tan(math.radians(x)), 1, 0, 0))


def mapped_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def parsed_matrix(text: Column) -> Column:
    """matrix(a, b, c, d, e, f) as text; null if it is none."""
    numbers = F.transform(F.split(F.regexp_extract(text, r"^\s*matrix\(([^)]*)\)\s*$", 1), r"[,\s]+"), lambda x: x.try_cast("double"))
    return F.when(F.size(F.filter(numbers, lambda x: x.isNotNull())) == 6, matrix(*[F.get(numbers, F.lit(i)) for i in range(6)]))
