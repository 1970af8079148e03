"""What several operators of this subpackage share: scratch tables, joins on hot keys, word patterns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.shipping import discard, passing_tables, scratch_path, ship, stored, written  # noqa: F401  (the operators take them from here)

#: A word in every contract of this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the filters of maybe_among().
FILTER_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 32) -> DataFrame:
    """Join ``rows`` with ``facts`` (one row per key) where one key may hold a third of ``rows``.

    Each row gets one of ``salts`` numbers from ``spread``; each fact is repeated for every number. No task
    then gets more than a ``salts``-th of a key's rows, whether or not adaptive execution splits it further. The repeated facts
    are never broadcast: Spark sizes them as if they stood once, so one under its limit would pass through the driver many times that size.
    """
    rows = rows.withColumn("__salt__", F.pmod(F.xxhash64(spread), F.lit(salts)))
    facts = facts.withColumn("__salt__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(facts.hint("merge"), [*keys, "__salt__"], how).drop("__salt__")


def maybe_among(rows: DataFrame, key: str, keys: DataFrame, name: str = "maybe") -> DataFrame:
    """``rows`` with a column ``name``: false where the long ``key`` is certainly in no row of ``keys``, so that the row need not be moved.

    The broadcast is a bitmap of ``FILTER_BITS`` bits, 8 MB at most for any input. As keys fill it, more rows pass; a
    join decides about those that do.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS).cast("long"))
    number, place = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    bits = keys.select(number.alias("__bit_part"), place.alias("__bit_at")).groupBy("__bit_part").agg(F.bitmap_construct_agg("__bit_at").alias("__bit_bits"))
    joined = rows.withColumns({"__bit_part": number, "__bit_at": place}).join(F.broadcast(bits), "__bit_part", "left")
    byte = F.conv(F.hex(F.substring("__bit_bits", F.shiftright("__bit_at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, F.col("__bit_at").bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return joined.withColumn(name, held).drop("__bit_part", "__bit_at", "__bit_bits")


def counted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column, count: str, hot: int = 1000, salts: int = 32) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per key), salted on hot keys only, for facts too wide or too many to be repeated.

    ``count`` is the facts' column with the number of their rows, or with a number that is not less. Rows that have it too say by
    themselves whether their key is hot. Otherwise keys of more than ``hot`` rows are known on both
    sides by the bitmap of ``maybe_among``; a key that only looks hot is salted on both sides as well.
    """
    if count in rows.columns:
        marked = [side.withColumn("__hot", F.col(count) > hot) for side in (rows, facts)]
        marked[0] = marked[0].drop(count)
    else:
        print_ = F.xxhash64(*keys)
        hot_keys = facts.filter(F.col(count) > hot).select(print_.alias("__hot_key"))
        marked = [maybe_among(side.withColumn("__hot_key", print_), "__hot_key", hot_keys, "__hot").drop("__hot_key") for side in (rows, facts)]
    last = F.when(F.col("__hot"), salts - 1).otherwise(0).cast("long")
    rows = marked[0].withColumn("__salt__", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("long")).drop("__hot")
    facts = marked[1].withColumn("__salt__", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__hot")
    return rows.join(facts.hint("merge"), [*keys, "__salt__"]).drop("__salt__")


def without_rows(docs: DataFrame, lost: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """``docs`` without the rows that ``lost`` (id, digest, same) names by id, null included, and ``digest`` of the text.

    Where ``same`` is 0 all such rows go; else they are copies of each other, and one of them stays. Rows that are certainly not
    named are not moved.
    """
    key = lambda id_, digest: F.concat_ws(":", digest, id_.cast("string"))
    keyed = docs.withColumn("__drop_key", key(F.col(id_col), digest))
    lost = lost.select(key(F.col("id"), F.col("digest")).alias("__drop_key"), F.col("same").alias("__drop_same"))
    keyed = maybe_among(keyed, "__drop_key", lost, "__drop_maybe")
    doubtful = salted_join(keyed.filter("__drop_maybe"), lost, ["__drop_key"], F.monotonically_increasing_id(), salts=8).filter("__drop_same is null or __drop_same > 0")
    # Of copies one stays; all other rows have a number of their own.
    number = F.when(F.col("__drop_same").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    doubtful = doubtful.withColumn("__drop_row", number).dropDuplicates(["__drop_key", "__drop_row"])
    return keyed.filter("not __drop_maybe").select(*docs.columns).unionByName(doubtful.select(*docs.columns))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` by a function of this package, which goes along to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def release_memory() -> None:
    """Give memory that this process no longer uses back to the system: Arrow's, and the C library's where it can be asked.

    Driver and Python workers live on while other stages need the memory.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 300, size: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a task holds the Python objects of few texts at a time: by rows, and by bytes of a column."""
    for whole in batches:
        ends, first = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy()), 0
        while first < len(whole):
            last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right"))
            last = min(max(last, first + 1), first + rows, len(whole))
            yield whole.slice(first, last - first)
            first = last
