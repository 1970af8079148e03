"""Serial reading: chunks of words, recognition points, durations, playback positions, labels and settings limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.columns import fixed_1
from lectern.functions.text import once, word_count, words

#: Least, most and step of each numeric setting; an angle turns round instead.
LIMITS = {"wpm": (50, 1200, 50), "chunkSize": (1, 5, 1), "fontSize": (12, 48, 2), "orpStrength": (0.0, 1.0, 0.1), "depth": (20, 200, 10), "ghostAlpha": (0.0, 1.0, 0.1), "wordSpacing": (0, 50, 5), "patternScale": (50, 200, 10), "patternOpacity": (0, 100, 5)}
FONTS = {"serif": "serif", "mono": "monospace"}
#: Background and text colour of each theme.
THEMES = {"light": ("#FFFFFF", "#000000"), "dark": ("#000000", "#FFFFFF"), "sepia": ("#F4ECD8", "#5B4636"), "highContrast": ("#000000", "#FFFF00")}


def js_round(value: Column) -> Column:
    """Halves up, also below zero."""
    return F.floor(value + 0.5)


def clamp(value: Column, low, high) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_column(low), F.least(value, as_column(high)))


def reading_words(text: Column) -> Column:
    """The words to show: curly quotes straightened, white space gone."""
    return words(F.translate(F.coalesce(text, F.lit("")), "‘’“”", "''\"\""))


def chunks(all_words: Column, size: int) -> Column:
    """Array of arrays of ``size`` words; the last may be shorter, no words give no chunk."""

    def cut(ws: Column) -> Column:
        starts = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(ws, i + 1, size))

    return F.transform(all_words, lambda w: F.array(w)) if size == 1 else once(all_words, cut)


def chunk_count(text: Column, size: int) -> Column:
    """How many chunks :func:`chunks` cuts a text's words into; quotes, straight or curly, part no words."""
    return F.ceil(word_count(text) / size)


def recognition_point(chunk: Column) -> Column:
    """Where the eye rests in a chunk's middle word: about a third into its letters."""
    middle = F.when(F.size(chunk) == 1, 0).otherwise(F.floor(F.size(chunk) / 2).cast("int"))
    letters = F.length(F.regexp_replace(F.coalesce(F.get(chunk, middle), F.lit("")), "[^a-zA-Z]", ""))
    point = F.when(letters <= 2, 0).when(letters <= 4, 1).otherwise(clamp(F.floor(letters / 3).cast("int"), 1, letters - 1))
    return point.cast("int")


def duration_ms(n_words: Column, wpm: Column | float) -> Column:
    return F.lit(60000.0) / wpm * n_words


def longest_word(chunk: Column) -> Column:
    """The longest word, the first of equals; empty for no words."""
    return F.aggregate(chunk, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def orp_parts(chunk: Column, point: Column) -> dict[str, Column]:
    """The middle word before, at and behind its recognition point, whether that lies inside, and the pieces beside it."""
    word = F.coalesce(F.get(chunk, F.floor(F.size(chunk) / 2).cast("int")), F.lit(""))
    inside = point < F.length(word)
    first, last = F.coalesce(F.get(chunk, F.lit(0)), F.lit("")), F.coalesce(F.get(chunk, F.size(chunk) - 1), F.lit(""))
    part = lambda t, start, size: F.substring(t, start, size)
    return {
        "pre": F.when(inside, part(word, F.lit(1), point)).otherwise(""), "focus": F.when(inside, part(word, point + 1, F.lit(1))).otherwise(""), "post": F.when(inside, part(word, point + 2, F.length(word))).otherwise(""), "in_bounds": inside,
        "left_context": part(first, F.lit(1), F.floor(F.length(first) / 3).cast("int")), "right_context": part(last, F.floor(F.length(last) * 0.6).cast("int") + 1, F.length(last)),
    }


def letter_spacing(word_spacing: Column, font_size: Column) -> Column:
    return js_round((font_size * 0.015 + word_spacing / 50 * (font_size * 0.08)) * 10) / 10


def fitting_font(longest: Column, size: Column, half_width: Column, spacing: Column) -> Column:
    """The largest font, down to about a third of ``size``, in which a word fits: ten bisections."""

    def fit(n: Column) -> Column:
        start = F.struct((size * 0.35).cast("double").alias("lo"), size.cast("double").alias("hi"))

        def halve(range_: Column, _: Column) -> Column:
            middle = (range_["lo"] + range_["hi"]) / 2
            fits = n * (middle * 0.55 + spacing) <= half_width
            return F.struct(F.when(fits, middle).otherwise(range_["lo"]).alias("lo"), F.when(fits, range_["hi"]).otherwise(middle).alias("hi"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, halve)["lo"]
        wanted = F.when((n > 0) & (half_width > 0), found).otherwise(size.cast("double"))
        return F.greatest(size * 0.35, F.least(size.cast("double"), wanted))

    return once(F.length(longest), fit)


def playback_index(paused: Column, elapsed_ms: Column, wpm: Column | float, size: Column | int, n_chunks: Column) -> dict[str, Column]:
    """The chunk shown after some time of playing from ``paused``, and whether the end was reached."""
    target = paused + F.floor(elapsed_ms / (F.lit(60000.0) / wpm * size))
    return {"chunk_index": F.least(target, n_chunks - 1), "finished": target >= n_chunks}


def seek(index: Column, n_chunks: Column) -> Column:
    return F.greatest(F.lit(0), F.least(index, n_chunks - 1))


def scrubbed_index(x: Column, width: Column | float, n_chunks: Column) -> Column:
    """The chunk under a finger on the progress bar."""
    return js_round(clamp((x - 8) / width, 0.0, 1.0) * (n_chunks - 1))


def reader_progress(index: Column, n_chunks: Column) -> Column:
    return F.when(n_chunks > 0, F.try_divide(index.cast("double"), n_chunks.cast("double")) * 100).otherwise(0.0)


def library_progress(chunk_index: Column, n_words: Column) -> Column:
    """Whole per cent of words, though the index counts chunks; 0 without words."""
    return F.when(n_words == 0, 0).otherwise(clamp(js_round(F.try_divide(chunk_index.cast("double"), n_words.cast("double")) * 100), 0, 100)).cast("long")


def word_label(count: Column) -> Column:
    """999, 1.2K, 3.4M; one decimal, halves of the exact binary value up."""
    return F.when(count >= 1_000_000, F.concat(fixed_1(count, 1_000_000), F.lit("M"))).when(count >= 1_000, F.concat(fixed_1(count, 1_000), F.lit("K"))).otherwise(count.cast("string"))


def eta_label(n_words: Column, chunk_index: Column, wpm: int = 300) -> Column:
    """Time left at a fixed rate: N/A, <1 min, minutes, or hours and minutes."""
    minutes = F.ceil(F.greatest(n_words - chunk_index, F.lit(0)) / wpm)
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60)
    long = F.when(rest > 0, F.concat(hours, F.lit("h "), rest.cast("string"), F.lit("m"))).otherwise(F.concat(hours, F.lit("h")))
    return F.when(n_words == 0, "N/A").when(minutes < 1, "<1 min").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(long)


def gesture(dx: Column, dy: Column) -> Column:
    """tap, jump back or on by 5 chunks, slower or faster by 50 words a minute, or none."""
    across, along = F.abs(dx), F.abs(dy)
    return (
        F.when((across < 8) & (along < 8), "tap").when((across > along) & (across > 30), F.when(dx > 0, "jump-5").otherwise("jump+5")).when((along > across) & (along > 30), F.when(dy > 0, "wpm-50").otherwise("wpm+50")).otherwise("none")
    )


def adjusted(setting: str, value: Column, steps: int) -> Column:
    """A setting moved by steps and kept within its limits."""
    low, high, step = LIMITS[setting]
    return clamp(value + steps * step, low, high)


def turned(angle: Column, steps: int) -> Column:
    return F.pmod(angle + steps * 15, F.lit(360))


def font_family(name: Column) -> Column:
    out = F.lit("system")
    for key, value in FONTS.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def toggled_mode(mode: Column) -> Column:
    return F.when(mode == "2D", "3D").otherwise("2D")


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(" " + noun), F.when(count == 1, "").otherwise("s"))
