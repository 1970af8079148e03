"""Mixing sources to target weights: whole epochs first, then Efraimidis-Spirakis sampling to the rest of a budget.

A document with weight w gets the key -ln(u) / w, u being uniform and fixed by its id; taking documents by
ascending key is weighted sampling without replacement. Within each source the sizes are prefix-summed in that
order, and documents are taken until the budget that whole epochs left is spent.

A source may hold a third of all rows, so no window spans one: keys fall into bins by their logarithm, sums
of bins are prefix-summed first, and rows are ordered within a bin only. A weight shifts the logarithm of all keys alike, so
whatever the weights are, a bin holds about a thousandth of its source's rows at most. Rows that tie in everything the
order looks at are counted as one and numbered only where a budget ends among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import WORD, salted_join, written

WEIGHTS, SHARE, MOST_EPOCHS, BINS = (5, 2, 1), 1.5, 2, 256
#: Up to so many sources their budgets are broadcast.
FEW_SOURCES = 1000
#: What orders the rows of a source.
ORDER = ("key", "id", "size", "print")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size), one row per source.

    Sources in code-point order, null last, get ``weights`` in turn and share ``share`` of all sizes by
    weight. No target exceeds ``most`` times its source's size; the excess is shared again by weight. With sources
    sorted by size per weight the full ones are a prefix, and the first source that is not full has the level.
    One row per source passes through these windows, never the documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("w", weight.cast("long")).withColumn("full", F.col("source_size") * most)
    by_ratio = W.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("full").over(before), F.lit(0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    levels = weighed.withColumn("level", level).withColumn("open", F.col("level") < F.col("full") / F.col("w"))
    level_at = F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(all_rows)
    water = level_at["level"]
    target = F.when(F.col("open"), water * F.col("w")).otherwise(F.col("full").cast("double"))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def text_quality(text: Column) -> Column:
    """A weight from the text itself: the share of letters and white space among its characters, 0.05 at least."""
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[\p{L}\s]")).cast("double"), F.length(text).cast("double")), F.lit(0.05)))


def _keyed(docs: DataFrame, quality: DataFrame | Column | None, seed: str, with_text: bool = True) -> DataFrame:
    """``docs`` with __mix_key, __mix_id, __mix_size, __mix_print and __mix_bin. Labels are joined, after the text where it is not needed; a weight column needs no join.

    A row without an id has its key from its text, so such rows do not share one.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    docs = docs.withColumns({"__mix_size": size, "__mix_print": F.xxhash64("text"), "__mix_weight": F.lit(1.0) if quality is None or isinstance(quality, DataFrame) else quality})
    docs = docs.withColumn("__mix_name", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.col("__mix_print").cast("string"))))
    docs, weight = docs if with_text else docs.drop("text"), F.col("__mix_weight")
    if isinstance(quality, DataFrame):
        marks = quality.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("__mix_name")).agg(F.max("quality").alias("__mix_quality"))
        docs = docs.join(marks, "__mix_name", "left")
        weight = F.when(F.col("__mix_quality") >= 1, 2.0).when(F.col("__mix_quality") <= 0, 0.5).otherwise(1.0)
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("__mix_name"))), 1, 12), 16, 10).cast("long")
    key = -F.log((digits + F.lit(0.5)) / F.lit(float(2**48))) / weight
    bin_ = F.floor(F.log2("__mix_key") * BINS).cast("int")
    return docs.withColumns({"__mix_key": key, "__mix_id": F.col("doc_id")}).withColumn("__mix_bin", bin_).drop("__mix_name", "__mix_quality", "__mix_weight")


def _narrow(keyed: DataFrame) -> DataFrame:
    return keyed.select("source", *[F.col(f"__mix_{c}").alias(c) for c in (*ORDER, "bin")])


def _budgets(rows: DataFrame, weights, share, most) -> DataFrame:
    """A row for each source of ``rows`` (source, key, id, size, print, bin): _none, _source, source_size, target, epochs, and
    where the fractional epoch ends: last (the last rows taken, by ``ORDER``), of them held, and as many taken.

    What the fractional epoch takes of a source is a prefix of its order, so this tells for every row whether it is in.
    """
    tied = written(rows.groupBy("source", "bin", *ORDER).agg(F.count("*").alias("held")), "mix-ties")
    bins = written(tied.groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("held")).alias("bin_size")), "mix-bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = written(_by_source(targets), "mix-targets")
    earlier = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = _by_source(bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))).join(targets.select("_none", "_source", "rest"), ["_none", "_source"])
    # The budget ends in the last bin that begins before it; no other bin's rows need an order.
    ends = starts.filter("bin_start <= rest and rest > 0").groupBy("_none", "_source").agg(F.max(F.struct("bin", "bin_start", "rest")).alias("end"))
    near = starts.filter("bin_start <= rest and rest > 0").join(ends.select("_none", "_source", F.col("end.bin").alias("end_bin")), ["_none", "_source"])
    last_bins = near.filter(F.col("bin") == F.col("end_bin")).select("_none", "_source", "bin", "bin_start", "rest")
    inner = W.partitionBy("_none", "_source", "bin").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    ordered = _by_source(tied).join(last_bins, ["_none", "_source", "bin"]).withColumn("before", F.col("bin_start") + F.coalesce(F.sum(F.col("size") * F.col("held")).over(inner), F.lit(0)))
    # A row is taken if half of it or more lies before the end; the n-th of tied rows begins n sizes later.
    taken = F.floor((F.col("rest") - (F.col("before") + F.col("size") / 2.0)) / F.col("size")).cast("long") + 1
    taken = F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), F.least("held", taken))).otherwise(0)
    last = F.struct(*ORDER)
    cut = ordered.withColumn("taken", taken).filter("taken > 0").groupBy("_none", "_source").agg(F.max(F.struct(last.alias("last"), "held", "taken")).alias("cut"))
    # Where no row of the last bin is taken, all bins before it are.
    ends = ends.select("_none", "_source", F.col("end.bin").alias("end_bin"))
    return written(targets.join(ends, ["_none", "_source"], "left").join(cut, ["_none", "_source"], "left").select("_none", "_source", "source_size", "target", "epochs", "end_bin", "cut.last", "cut.held", "cut.taken"), "mix-budgets")


def _copied(keyed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``keyed`` with __mix_copies, __mix_source_size and __mix_target."""
    names = {"_none": "__mix_none", "_source": "__mix_source"} | {c: f"__mix_{c}" for c in ("source_size", "target", "epochs", "end_bin", "last", "held", "taken")}
    budgets = budgets.withColumnsRenamed(names)
    keyed = keyed.withColumns({"__mix_none": F.col("source").isNull(), "__mix_source": F.coalesce("source", F.lit(""))})
    source = ["__mix_none", "__mix_source"]
    # Rows may have their texts with them: budgets of few sources come to the rows, which then neither move nor are sorted.
    few = budgets.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    joined = keyed.join(F.broadcast(budgets), source) if few else salted_join(keyed, budgets, source, F.struct("__mix_key", "__mix_print"), "inner", salts=16)
    own = F.struct(*[F.col(f"__mix_{c}").alias(c) for c in ORDER])
    inside = (F.col("__mix_bin") < F.col("__mix_end_bin")) | (F.col("__mix_bin") == F.col("__mix_end_bin")) & (own < F.col("__mix_last"))
    edge = F.coalesce(own == F.col("__mix_last"), F.lit(False))
    joined = joined.withColumn("__mix_extra", F.when(F.coalesce(inside, F.lit(False)) | edge & (F.col("__mix_taken") == F.col("__mix_held")), 1).otherwise(0))
    # Tied rows of which some are taken: numbered by partition first, so that no task holds them all.
    split = edge & (F.col("__mix_taken") < F.col("__mix_held"))
    some = budgets.filter("__mix_taken < __mix_held")
    if not some.isEmpty():
        tied = written(joined.filter(split).withColumns({"__mix_part": F.spark_partition_id(), "__mix_row": F.monotonically_increasing_id()}), "mix-tied")
        parts = tied.groupBy("__mix_none", "__mix_source", "__mix_part").agg(F.count("*").alias("n"))
        earlier = W.partitionBy("__mix_none", "__mix_source").orderBy("__mix_part").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("__mix_start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
        number = F.row_number().over(W.partitionBy("__mix_none", "__mix_source", "__mix_part").orderBy("__mix_row")) + F.col("__mix_start")
        tied = tied.join(parts, ["__mix_none", "__mix_source", "__mix_part"]).withColumn("__mix_number", number)
        tied = tied.withColumn("__mix_extra", F.when(F.col("__mix_number") <= F.col("__mix_taken"), 1).otherwise(0))
        joined = joined.filter(~split).unionByName(tied.select(*joined.columns))
    return joined.withColumn("__mix_copies", F.when(F.col("__mix_size") > 0, F.col("__mix_epochs") + F.col("__mix_extra")).otherwise(0).cast("long"))


def _by_source(df: DataFrame) -> DataFrame:
    """A null source told apart from an empty one, so that plain equality joins it."""
    return df.withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit(""))).drop("source")


def mix(docs: DataFrame, quality: DataFrame | Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes.

    ``quality`` scales a document's chance in the fractional epoch: a table (doc_id, quality) where 1 doubles its weight,
    0 halves it, and without a label it is 1; or a column with the weight. Returns one row per row of ``docs``: doc_id, source, size,
    source_size, target, taken, copies. A document is taken whole, ``copies`` times; the one that reaches the end of the budget is
    taken if that brings the source nearer to its target.

    Edge cases: null and empty texts have size 0 and taken 0; a null source is a source of its own, sorted last; a row with
    a null id is placed by its text; repeated rows are each sampled, and of those that tie as many are taken as fit; very long texts count
    whole; of several labels the highest counts; an empty table gives an empty result; other columns are not read.
    """
    keyed = _keyed(docs.select("doc_id", "source", "text"), quality, seed, with_text=False)
    keyed = written(keyed, "mix-keys")
    budgets = _budgets(_narrow(keyed), weights, share, most)
    placed = _copied(keyed, budgets)
    size, copies = F.col("__mix_size").alias("size"), F.col("__mix_copies").alias("copies")
    return placed.select("doc_id", "source", size, F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"), copies)


def mixed_rows(docs: DataFrame, quality: DataFrame | Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with all columns. Rows without words go; edge cases are those of ``mix``.

    Texts are not joined with their counts: a source's budget tells for every row how often it is taken.
    """
    narrow = _keyed(docs.select("doc_id", "source", "text"), quality, seed, with_text=False)
    budgets = _budgets(written(_narrow(narrow), "mix-keys"), weights, share, most)
    kept = _copied(_keyed(docs, quality, seed), budgets).filter("__mix_copies > 0")
    return kept.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*docs.columns)
