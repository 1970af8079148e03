"""Hard negatives by norm-bucketed search: candidates sorted by norm, cut into buckets, buckets left out by Cauchy-Schwarz.

Vectors become whole numbers; a score is the inner product of two. Candidates are dealt by descending norm over as many
segments as the session has shuffle partitions, and each segment is cut into buckets of a bounded size, one row each. Anchors
are cut into blocks the same way. A block meets a segment only if the product of norms can reach what the block still looks for:
its best positives so far, or the lower limit of its windows. Within a task, a bucket, and an anchor within a bucket, is left
out as soon as its bound is below the running k-th score. Nothing is sampled, and each row is compared unless its bound says no.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, written

#: Doubles hold whole numbers up to this exactly.
EXACT = 2.0**53
#: Norms are rounded; bounds get this much more.
SLACK = 1 + 1e-9
NONE = -np.inf
PACKED = "segment int, place long, longest double, width int, ids binary, keys binary, labels binary, anchors binary, cells binary"


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, the window of a negative's score in percent of the positive's, and the sizes of buckets and blocks."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    bucket: int = 1024
    block: int = 256
    cells: int = 1 << 19  # numbers in a bucket or block at most


def _whole(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double, of any size."""
    scaled = x.cast("double") * scale
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)


def _vectors(rows: DataFrame, anchors: Column, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(key, id, label, anchor, cells, norm) of the rows that take part."""
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    named = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).filter(finite)
    cells = named.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.transform(vec_col, lambda x: _whole(x, scale)).alias("cells"))
    return cells.withColumn("norm", F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists as a matrix; short rows are filled up with zeros."""
    ends = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(ends.max(initial=0))
    if len(flat) == width * len(ends):
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width))
    out[np.arange(width) < ends[:, None]] = flat
    return out


def _encoded(m: np.ndarray) -> bytes:
    """Two bytes for a number where they do, else eight; the first byte says which."""
    return b"h" + m.astype("<i2").tobytes() if np.abs(m).max(initial=0) < 2**15 else b"d" + m.astype("<f8").tobytes()


def _decoded(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"h" else "<f8", offset=1).astype(np.float64).reshape(-1, width) if width else np.zeros((0, 0))


@dataclass
class _Rows:
    """A bucket or a block in memory: its rows by id, so that the first of equal scores has the least id."""

    ids: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    anchors: np.ndarray
    cells: np.ndarray

    @classmethod
    def read(cls, row: dict) -> _Rows:
        ids, keys, labels = (np.frombuffer(row[n], "<i8") for n in ("ids", "keys", "labels"))
        cells = _decoded(row["cells"], row["width"])
        return cls(ids, keys, labels, np.frombuffer(row["anchors"], np.uint8).astype(bool), cells if row["width"] else np.zeros((len(ids), 0)))

    def packed(self, segment: int, place: int) -> list:
        order = np.lexsort((self.keys, self.ids))
        longest = float(np.sqrt((self.cells * self.cells).sum(1)).max(initial=0))
        return [segment, place, longest, self.cells.shape[1], *(x[order].astype("<i8").tobytes() for x in (self.ids, self.keys, self.labels)), self.anchors[order].astype(np.uint8).tobytes(), _encoded(self.cells[order])]


def _batch(rows: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_PACKED = [("segment", pa.int32()), ("place", pa.int64()), ("longest", pa.float64()), ("width", pa.int32()), *((n, pa.binary()) for n in ("ids", "keys", "labels", "anchors", "cells"))]


def norm_buckets(vectors: DataFrame, mining: Mining) -> DataFrame:
    """``vectors`` by descending norm as buckets, a row each; equal norms are dealt by id, so no norm is one task's alone."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            width = int(pc.max(pc.list_value_length(batch.column("cells"))).as_py() or 1) if len(batch) else 1
            size = max(1, min(mining.bucket, mining.cells // max(1, width)))
            for first in range(0, len(batch), size):
                part = batch.slice(first, size)
                numbers = [part.column(n).to_numpy(zero_copy_only=False) for n in ("id", "key", "label", "anchor")]
                yield _batch([_Rows(*numbers, _matrix(part.column("cells"))).packed(segment, place)], _PACKED)
                place += 1

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("norm"), F.asc("id"), F.asc("key")]
    return map_arrow(vectors.repartitionByRange(n, *order).sortWithinPartitions(*order), pack, PACKED)


def anchor_blocks(buckets: DataFrame, mining: Mining) -> DataFrame:
    """The anchors among the rows of ``buckets`` as blocks of their own; ``place`` numbers them."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            nonlocal seen
            width = max(r.cells.shape[1] for r in held)
            cells = np.concatenate([np.pad(r.cells, ((0, 0), (0, width - r.cells.shape[1]))) for r in held])
            whole = _Rows(*(np.concatenate([getattr(r, n) for r in held]) for n in ("ids", "keys", "labels", "anchors")), cells)
            seen += 1
            held.clear()
            return _batch([whole.packed(0, part << 32 | seen)], _PACKED)

        for batch in batches:
            for row in batch.to_pylist():
                rows = _Rows.read(row)
                if not rows.anchors.any():
                    continue
                own = [getattr(rows, n)[rows.anchors] for n in ("ids", "keys", "labels", "anchors", "cells")]
                size = max(1, min(mining.block, mining.cells // max(1, own[4].shape[1])))
                for first in range(0, len(own[0]), size):
                    more = _Rows(*(x[first : first + size] for x in own))
                    if held and sum(len(r.ids) for r in held) + len(more.ids) > size:
                        yield block()
                    held.append(more)
        if held:
            yield block()

    return map_arrow(buckets, pick, PACKED)


class Best:
    """The best k of many columns for each row, fed bucket by bucket: higher scores first, of equals the smaller id, then key."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.keys = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def last(self) -> np.ndarray:
        """The running k-th score of each row."""
        return self.scores[:, -1]

    def feed(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """``scores`` of ``rows`` with columns in ascending order of id and key; minus infinity where there is nothing."""
        k, c = self.scores.shape[1], scores.shape[1]
        if c > k:
            top = np.abs(scores[scores > NONE]).max(initial=0)
            if (top + 1) * c < EXACT:  # one number for score and place
                both = np.where(scores > NONE, scores * c + (c - 1 - np.arange(c)), NONE)
                at = np.argpartition(-both, k - 1, axis=1)[:, :k]
            else:
                at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        else:
            at = np.broadcast_to(np.arange(c), scores.shape)
        all_scores = np.concatenate([self.scores[rows], np.take_along_axis(scores, at, 1)], 1)
        all_ids, all_keys = np.concatenate([self.ids[rows], ids[at]], 1), np.concatenate([self.keys[rows], keys[at]], 1)
        order = np.lexsort((all_keys, all_ids, -all_scores))[:, :k]
        for held, new in ((self.scores, all_scores), (self.ids, all_ids), (self.keys, all_keys)):
            held[rows] = np.take_along_axis(new, order, 1)


def _score(block: _Rows, rows: np.ndarray, bucket: _Rows) -> np.ndarray:
    width = min(block.cells.shape[1], bucket.cells.shape[1])
    return block.cells[rows][:, :width] @ bucket.cells[:, :width].T


FOUND = "block long, row int, slot int, id long, key long, score double"
_FOUND = [("block", pa.int64()), ("row", pa.int32()), ("slot", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())]


class _Search:
    """One block's search through the buckets of a segment. limits: for each row and slot, (lowest, highest) score of interest."""

    def __init__(self, block: _Rows, limits: np.ndarray, same: bool, k: int):
        self.block, self.limits, self.same = block, limits, same
        self.norms = np.sqrt((block.cells * block.cells).sum(1)) * SLACK
        self.best = [Best(len(block.ids), k) for _ in range(limits.shape[1])]

    def floor(self, slot: int) -> np.ndarray:
        return np.maximum(self.limits[:, slot, 0], self.best[slot].last())

    def meet(self, bucket: _Rows, longest: float) -> None:
        bound = self.norms * longest * SLACK
        floors = [self.floor(s) for s in range(len(self.best))]
        alive = [(bound >= f) & (f <= self.limits[:, s, 1]) for s, f in enumerate(floors)]
        rows = np.flatnonzero(np.logical_or.reduce(alive))
        if not len(rows):
            return
        scores = _score(self.block, rows, bucket)
        agree = (self.block.labels[rows][:, None] == bucket.labels) == self.same
        if self.same:
            agree &= self.block.keys[rows][:, None] != bucket.keys
        for slot, (live, floor) in enumerate(zip(alive, floors, strict=True)):
            fits = agree & (scores >= floor[rows][:, None]) & (scores <= self.limits[rows, slot, 1][:, None]) & live[rows][:, None]
            hit = np.flatnonzero(fits.any(1))
            if len(hit):
                columns = np.flatnonzero(fits[hit].any(0))
                kept = np.where(fits[np.ix_(hit, columns)], scores[np.ix_(hit, columns)], NONE)
                self.best[slot].feed(rows[hit], kept, bucket.ids[columns], bucket.keys[columns])

    def found(self, number: int) -> pa.RecordBatch:
        parts = []
        for slot, best in enumerate(self.best):
            row, at = np.nonzero(best.scores > NONE)
            parts.append((row, np.full(len(row), slot), best.ids[row, at], best.keys[row, at], best.scores[row, at]))
        row, slots, ids, keys, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), number, np.int64)), pa.array(row.astype(np.int32)), pa.array(slots.astype(np.int32)), pa.array(ids), pa.array(keys), pa.array(scores)], names=[n for n, _ in _FOUND])


def _searched(blocks: DataFrame, buckets: DataFrame, segments: Column, same: bool, k: int, slots: int) -> DataFrame:
    """The best k in each slot of every row of ``blocks``, for each segment of ``segments`` (an array).

    ``blocks`` has ``limits``: an array of (row, slot, low, high); a row or slot that is missing looks for nothing.
    """
    own = [F.col(n).alias(f"b_{n}") for n in ("place", "width", "ids", "keys", "labels", "anchors", "cells")]
    # A block stands here once for each segment: Spark sizes it as one and would broadcast it through the driver.
    left = blocks.select(*own, "limits", F.explode(segments).alias("segment")).hint("merge")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if at != (row["b_place"], row["segment"]):
                    if now:
                        yield now.found(at[0])
                    at, block = (row["b_place"], row["segment"]), _Rows.read({n.removeprefix("b_"): v for n, v in row.items() if n.startswith("b_")})
                    limits = np.full((len(block.ids), slots, 2), [np.inf, NONE])
                    if row["limits"]:
                        where = np.array([(x["row"], x["slot"]) for x in row["limits"]], np.int64)
                        limits[where[:, 0], where[:, 1]] = [(x["low"], x["high"]) for x in row["limits"]]
                    now = _Search(block, limits, same, k)
                now.meet(_Rows.read(row), row["longest"])
        if now:
            yield now.found(at[0])

    return map_arrow(left.join(buckets, "segment"), search, FOUND)


def _first(found: DataFrame, k: int, group: list[str]) -> DataFrame:
    """The best k of each group with ``rank`` from 1."""
    order = W.partitionBy(*group).orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_negatives(rows: DataFrame, anchors: Column, mining: Mining = Mining(), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first positives
    (other rows of its label) the first rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

    ``anchors`` is a condition over ``rows``. Components become floor(scale * x), a score is their inner product; higher scores
    come first, of equal ones the smaller id, of equal ids the row read first. Ids and labels are whole numbers. Rows without an
    id, a label or a vector, or with a null or non-finite component, take no part. A shorter vector counts as filled up with zeros.
    Rows that share an id are rows of their own: each is an anchor if the condition holds, and a copy of an anchor is
    another row. Scores are exact up to 2**53, beyond that rounded as doubles and cut to a long. No rows give no rows.
    """
    spark = rows.sparkSession
    buckets = written(norm_buckets(_vectors(rows, anchors, scale, id_col, vec_col, label_col), mining), "norm-buckets")
    blocks = written(anchor_blocks(buckets, mining), "anchor-blocks")
    # One number for each segment, as many as the session has shuffle partitions: bounded by configuration.
    known = {r["segment"]: r["longest"] for r in buckets.groupBy("segment").agg(F.max("longest").alias("longest")).collect()}
    names = sorted(known, key=lambda s: (-known[s], s))
    lengths = F.array(*[F.lit(known[s]) for s in names]).cast("array<double>")
    numbers = F.array(*map(F.lit, names)).cast("array<int>")

    def reaching(need: Column) -> Column:
        """The segments whose longest row can reach a score, by a block's least score for a norm of one."""
        return F.slice(numbers, 1, F.size(F.filter(lengths, lambda x: x * (SLACK * SLACK) >= need)))

    def limited(limits: DataFrame) -> DataFrame:
        """``blocks`` with limits (block, row, slot, low, high) and the least low of a norm of one."""
        per = limits.groupBy("block").agg(F.collect_list(F.struct("row", "slot", "low", "high")).alias("limits"), F.min(F.when(F.col("low") > 0, F.col("low") / F.col("norm")).otherwise(F.lit(NONE))).alias("need"))
        return blocks.join(per, blocks["place"] == per["block"]).drop("block")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Rows.read(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), row["place"], np.int64)), pa.array(np.arange(len(b.ids), dtype=np.int32)), pa.array(b.ids), pa.array(np.sqrt((b.cells * b.cells).sum(1)))], names=["block", "row", "anchor_id", "norm"])

    anchor = map_arrow(blocks, members, "block long, row int, anchor_id long, norm double")
    anything = anchor.select("block", "row", "norm", F.lit(0).alias("slot"), F.lit(NONE).alias("low"), F.lit(np.inf).alias("high"))
    # The longest rows first: their k-th score is the limit for all other segments.
    head = written(_searched(limited(anything), buckets, F.slice(numbers, 1, 1), True, mining.positives, 1), "first-positives")
    reached = head.groupBy("block", "row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    tail_limits = anything.join(reached, ["block", "row"], "left").withColumn("low", F.when(F.col("n") >= mining.positives, F.col("least")).otherwise(F.lit(NONE))).drop("n", "least")
    rest = _searched(limited(tail_limits), buckets, F.slice(reaching(F.col("need")), 2, 1 << 30), True, mining.positives, 1)
    positives = _first(head.unionByName(rest), mining.positives, ["block", "row"])
    positives = written(positives.join(anchor, ["block", "row"]).select("block", "row", "anchor_id", "norm", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low, high = (F.ceil(F.col("positive_score") * mining.low / 100).cast("double"), F.floor(F.col("positive_score") * mining.high / 100).cast("double"))
    whole = F.abs("positive_score") * max(mining.low, mining.high, 1) < EXACT
    windows = positives.withColumns({"low": F.when(whole, low).otherwise(F.col("positive_score") * mining.low / 100), "high": F.when(whole, high).otherwise(F.col("positive_score") * mining.high / 100)}).filter("low <= high")
    found = _searched(limited(windows), buckets, reaching(F.col("need")), False, mining.negatives, mining.positives)
    best = _first(found, mining.negatives, ["block", "row", "slot"])
    as_long = lambda c: F.greatest(F.least(F.col(c), F.lit(9.2e18)), F.lit(-9.2e18)).cast("long").alias(c)
    out = best.withColumnRenamed("score", "negative_score").join(positives, ["block", "row", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), as_long("positive_score"), as_long("negative_score"))
