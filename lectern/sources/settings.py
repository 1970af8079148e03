"""Reader settings: JSON with any part missing, merged over defaults; four groups are merged within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default values, by group; the first group has no name.
DEFAULTS: dict[str, dict] = {
    "": {"wpm": 300, "chunkSize": 1, "fontFamily": "sans", "fontSize": 32, "backgroundTheme": "dark", "customBackgroundColor": "#000000", "customTextColor": "#FFFFFF", "orpStrength": 0.3},
    "threeD": {"defaultStyle": "cross", "depth": 80, "ghostAlpha": 0.3, "fusionGuide": False, "wordSpacing": 0},
    "background": {"type": "solid", "gradientType": "linear", "gradientColors": ["#1a1a2e", "#16213e"], "gradientAngle": 135, "patternType": "dots", "patternScale": 100, "patternOpacity": 30, "patternColor": "#4A9EFF", "customPatternUrl": ""},
    "pdf": {"perPageOcrFallback": True, "minCharsPerPage": 20, "ocrLanguage": "en", "ocrEnhanceText": True},
    "epub": {"skipNonLinear": True, "includeImageAlt": True, "respectAriaHidden": False},
}


def _type(value) -> str:
    return {bool: "boolean", int: "int", float: "double", str: "string", list: "array<string>"}[type(value)]


def schema() -> str:
    flat = [f"{k} {_type(v)}" for k, v in DEFAULTS[""].items()]
    return ", ".join([*flat, *[f"{g} struct<{', '.join(f'{k}: {_type(v)}' for k, v in fields.items())}>" for g, fields in DEFAULTS.items() if g]])


def _literal(value) -> Column:
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


def merged(stored: Column, over: Column | None = None) -> Column:
    """A settings struct: what ``stored`` (a struct of :func:`schema`) has, else what ``over`` has, else the defaults."""

    def pick(group: str, name: str, value) -> Column:
        at = lambda s: s[group][name] if group else s[name]
        return F.coalesce(at(stored), *([at(over)] if over is not None else []), _literal(value)).alias(name)

    groups = [F.struct(*[pick(g, k, v) for k, v in fields.items()]).alias(g) for g, fields in DEFAULTS.items() if g]
    return F.struct(*[pick("", k, v) for k, v in DEFAULTS[""].items()], *groups)


def parsed(json: Column) -> Column:
    """Settings from JSON text; unknown parts are ignored, malformed text gives the defaults."""
    return merged(F.from_json(json, schema()))


def load_settings(rows: DataFrame, json_col: str = "settings") -> DataFrame:
    return rows.withColumn(json_col, parsed(F.col(json_col)))


def saved(settings: Column) -> Column:
    return F.to_json(settings)


def reset() -> Column:
    """The defaults as they are stored."""
    return saved(parsed(F.lit("{}")))
