"""Near duplicates among vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Very large groups of near copies cost no pairs. First, rounds of hashing gather vectors into balls: members lie within half the
threshold's angle of the centre, so any two of them link without a look. Then buckets name pairs of balls, a ball once in
a bucket; most pairs of balls are decided by the angle of their centres and their radii (all link, or none does). What is left is
compared vector by vector in double precision. Links are counted and never written one by one, except as pairs of balls.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, salted_join, written
from lectern.llm.components import components

#: Angles are sure to this many radians; nearer to a bound than this, vectors are compared themselves.
SURE = 1e-6
#: Pairs at the threshold that a simulation draws to choose the number of tables.
DRAWN = 2_000


@dataclass(frozen=True)
class Near:
    """threshold: least cosine of a link. strangers: vectors that should share a bucket by chance. recall: share of pairs at the
    threshold that the tables find (nearer pairs are found more often). probes: buckets of a table that a vector looks into.
    rounds: of gathering. leaders: balls that a bucket starts in a round. block: rows compared at once."""

    threshold: float = 0.9
    strangers: int = 64
    recall: float = 0.99
    probes: int = 6
    rounds: int = 3
    leaders: int = 64
    block: int = 2048

    @property
    def angle(self) -> float:
        return math.acos(self.threshold)

    def hashes(self, n: int, width: int) -> int:
        """How many cross-polytope hashes name a bucket, so that chance fills it with ``strangers`` of n vectors."""
        return max(1, math.ceil(math.log(max(2, n / self.strangers)) / math.log(2 * padded(width))))


def padded(width: int) -> int:
    return 1 << max(1, (max(1, width) - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, of length one again; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


@cache
def _signs(number: int, d: int) -> np.ndarray:
    return np.random.default_rng([number, d]).choice([-1.0, 1.0], (3, d))


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """Rows rotated by three rounds of random signs and Hadamard transforms; ``number`` names the rotation."""
    d = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for sign in _signs(number, d):
        x = hadamard(x * sign)
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buckets(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """(n, probes) bucket numbers of unit rows in a table: its own first, then those it would fall into after the least changes.

    A hash is the axis, with its sign, nearest to the rotated row. A probe takes the second or third nearest axis in one hash, or
    the second in two; probes are ordered by how much nearness they give up.
    """
    near, loss = [], []
    for h in range(hashes):
        turned = rotated(x, table * 64 + h)
        size = np.abs(turned)
        top = np.argpartition(-size, min(3, size.shape[1]) - 1, axis=1)[:, :3]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
        value = np.take_along_axis(turned, top, 1)
        near.append(top.astype(np.uint64) * np.uint64(2) + (value < 0).astype(np.uint64))
        loss.append(np.abs(value[:, :1]) - np.abs(value))
    choices = [(0,) * hashes]
    last = near[0].shape[1]
    choices += [tuple(c if i == h else 0 for i in range(hashes)) for h in range(hashes) for c in range(1, last)]
    choices += [tuple(int(i in (g, h)) for i in range(hashes)) for g in range(hashes) for h in range(g) if last > 1]
    cost = np.stack([sum((loss[h][:, c] ** 2 for h, c in enumerate(choice)), np.zeros(len(x))) for choice in choices], 1)
    names = []
    for choice in choices:
        name = np.full(len(x), np.uint64(table + 1) * np.uint64(0x9E3779B9) + np.uint64(x.shape[1]), np.uint64)
        for h, c in enumerate(choice):
            name = _mixed(name * np.uint64(0x100000001B3) + near[h][:, c] + np.uint64(1))
        names.append(name)
    order = np.argsort(cost, axis=1, kind="stable")[:, : min(probes, len(choices))]
    return np.take_along_axis(np.stack(names, 1), order, 1)


@cache
def tables_needed(near: Near, hashes: int, width: int) -> int:
    """The fewest tables that find ``recall`` of pairs of random directions just at the threshold, by simulation."""
    rng = np.random.default_rng(width)
    a, b = rng.standard_normal((2, DRAWN, max(2, width)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = near.threshold * a + math.sqrt(1 - near.threshold**2) * b
    found = np.zeros(DRAWN, bool)
    for table in range(1, 257):
        own, other = buckets(a, table, hashes, near.probes), buckets(b, table, hashes, near.probes)
        found |= (own[:, :1] == other).any(1) | (other[:, :1] == own).any(1)
        if found.mean() >= near.recall:
            return table
    return 256


# Vectors in batches


def unit_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each length among the lists of a column, in double precision."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
    out = []
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        out.append((at, normal(flat[(ends[at] - width)[:, None] + np.arange(width)])))
    return out


def normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between rows of two matrices; small ones exact to about 1e-8."""
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    return zip(edges[:-1], edges[1:], strict=True)


# Balls


class Leaders:
    """Balls of one bucket as its rows go by: a row joins the first ball with room for it, else it starts one while few have."""

    def __init__(self, most: float, count: int):
        self.most, self.count, self.ids, self.rows = most, count, [], None

    def place(self, ids: np.ndarray, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ball, angle to its centre) of rows that are balls of some radius themselves; a row without room is its own ball."""
        ball, angle, open_ = ids.copy(), np.zeros(len(ids)), np.ones(len(ids), bool)

        def join(centres: np.ndarray, names: np.ndarray) -> None:
            at = np.flatnonzero(open_)
            if not len(at):
                return
            far = angles(x[at], centres)
            fits = far + radius[at][:, None] <= self.most
            hit = fits.any(1)
            first = fits.argmax(1)[hit]
            ball[at[hit]], angle[at[hit]] = names[first], far[hit, first]
            open_[at[hit]] = False

        if self.rows is not None:
            join(self.rows, np.array(self.ids))
        while open_.any() and len(self.ids) < self.count:
            at = int(np.flatnonzero(open_)[0])
            self.ids.append(ids[at])
            self.rows = x[at : at + 1] if self.rows is None else np.concatenate([self.rows, x[at : at + 1]])
            open_[at] = False
            join(x[at : at + 1], ids[at : at + 1])
        return ball, angle


def _gather(rows: DataFrame, near: Near, number: int, hashes: int) -> DataFrame:
    """(id, ball, angle, vector) of ``rows`` (id, vector, radius): one round of balls within buckets.

    Rows are dealt by ranges of bucket and id, so a bucket with a third of all rows is many tasks'; each starts its own balls there,
    and a later round joins them.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.zeros(len(batch), np.int64)
            for at, x in unit_rows(batch.column(1)):
                bucket[at] = buckets(x, 1000 + number, hashes, 1)[:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=["id", "vector", "radius", "bucket"])

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, None
        for batch in batches:
            ids, key, radius = (batch.column(n).to_numpy() for n in ("id", "bucket", "radius"))
            ball, angle = ids.copy(), np.zeros(len(ids))
            sizes = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            units = np.zeros((len(ids), int(sizes.max(initial=0))))
            for at, x in unit_rows(batch.column("vector")):
                units[at, : x.shape[1]] = x
            for first, last in _runs(key):
                if now != key[first]:
                    now, leaders = key[first], Leaders(near.angle / 2 - SURE, near.leaders)
                width = int(sizes[first])
                ball[first:last], angle[first:last] = leaders.place(ids[first:last], units[first:last, :width], radius[first:last])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ball), pa.array(angle), batch.column("vector")], names=["id", "ball", "angle", "vector"])

    kind = dict(rows.dtypes)["vector"]
    keyed = map_arrow(rows.select("id", "vector", "radius"), hashed, f"id long, vector {kind}, radius double, bucket long")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, "bucket", "id").sortWithinPartitions("bucket", "id")
    return map_arrow(dealt, led, f"id long, ball long, angle double, vector {kind}")


def balls(vectors: DataFrame, near: Near, hashes: int) -> tuple[DataFrame, DataFrame]:
    """(members, centres) of ``vectors`` (id, vector): members (id, vector, ball), centres (ball, centre, radius, size).

    Every vector lies within ``radius`` of its centre, and no radius exceeds half the threshold's angle.
    """
    first = written(_gather(vectors.withColumn("radius", F.lit(0.0)), near, 0, hashes), "balls")
    radii = first.groupBy("ball").agg(F.max("angle").alias("radius"), F.count("*").alias("size"))
    level = written(first.filter("id = ball").select(F.col("ball").alias("id"), "vector").join(radii.withColumnRenamed("ball", "id"), "id"), "centres")
    path = None
    for number in range(1, near.rounds):
        moved = written(_gather(level, near, number, hashes), "balls")
        sums = moved.select("id", "ball", "angle").join(level.select("id", "radius", "size"), "id").groupBy("ball").agg(F.max(F.col("angle") + F.col("radius")).alias("radius"), F.sum("size").alias("size"))
        level = written(moved.filter("id = ball").select("id", "vector").join(sums.withColumnRenamed("ball", "id"), "id"), "centres")
        step = moved.filter("id <> ball").select("id", F.col("ball").alias("to"))
        if path is None:
            path = step
        else:  # what moved before may move on, and centres move for the first time
            on = path.join(step.select(F.col("id").alias("to"), F.col("to").alias("then")), "to", "left").select("id", F.coalesce("then", "to").alias("to"))
            path = on.unionByName(step)
        path = written(path, "moves")
    members = first.select("id", "vector", "ball")
    if path is not None:
        members = salted_join(members, path.select(F.col("id").alias("ball"), "to"), ["ball"], F.col("id")).select("id", "vector", F.coalesce("to", "ball").alias("ball"))
    return written(members, "members"), level.select(F.col("id").alias("ball"), F.col("vector").alias("centre"), "radius", "size")


# Pairs of balls


def _marks(members: DataFrame, near: Near, hashes: int) -> DataFrame:
    """(bucket, ball, own, radius, code) of ``members`` with their balls' centre and radius: the buckets of every member.

    ``own`` marks a vector's own bucket; two probes that meet say nothing. ``code`` is the centre in a byte a number, and ``radius`` holds its error.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 2_000):
                batch = whole.slice(first, 2_000)
                ball, radius = batch.column("ball").to_numpy(), batch.column("radius").to_numpy()
                centres = {w: (at, c) for at, c in unit_rows(batch.column("centre")) for w in [c.shape[1]]}
                for at, x in unit_rows(batch.column("vector")):
                    c = centres[x.shape[1]][1]
                    step = np.abs(c).max(1, keepdims=True) / 127
                    code = np.rint(c / step).astype(np.int8)
                    error = np.arccos(np.clip((normal(code.astype(np.float64)) * c).sum(1), -1, 1))
                    reach = radius[at] + error
                    for table in range(1, tables_needed(near, hashes, x.shape[1]) + 1):
                        names = buckets(x, table, hashes, near.probes)
                        n, p = names.shape
                        flat, own = names.ravel(), np.tile(np.arange(p) == 0, n)
                        owner = np.repeat(np.arange(n), p)
                        order = np.lexsort((~own, ball[at][owner], flat))
                        keep = order[np.concatenate([[True], (flat[order][1:] != flat[order][:-1]) | (ball[at][owner][order][1:] != ball[at][owner][order][:-1])])] if len(order) else order
                        codes = pa.array([code[i].tobytes() for i in owner[keep]], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(flat[keep].view(np.int64)), pa.array(ball[at][owner[keep]]), pa.array(own[keep]), pa.array(reach[owner[keep]]), codes], names=["bucket", "ball", "own", "radius", "code"])

    return map_arrow(members, mark, "bucket long, ball long, own boolean, radius double, code binary")


def _by_block(rows: DataFrame, keys: list[str], act: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``act`` on the rows of each group of ``keys``, groups of bounded size that stream by in sorted partitions."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            key = np.zeros(len(table), np.uint64)
            for k in keys:
                key = _mixed(key * np.uint64(31) + table.column(k).to_numpy().astype(np.int64).view(np.uint64) + np.uint64(7))
            runs = list(_runs(key))
            for first, last in runs[:-1]:
                yield from act(table.slice(first, last - first))
            held = table.slice(runs[-1][0]) if runs else table
        if held is not None and len(held):
            yield from act(held)

    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys), stream, schema)


def _halves(rows: DataFrame, spread: str, blocks: Column) -> DataFrame:
    """``rows`` once for each pair of blocks (i <= j) that their own block belongs to, with ``side``: rows of i, of j, or both (i = j)."""
    own = F.pmod(F.xxhash64(spread), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own <= other).alias("left"), (own >= other).alias("right")))
    return rows.withColumn("_b", F.explode(pairs)).select(*rows.columns, F.col("_b.i").alias("i"), F.col("_b.j").alias("j"), F.col("_b.left").alias("left"), F.col("_b.right").alias("right"))


def ball_pairs(members: DataFrame, centres: DataFrame, near: Near, hashes: int) -> DataFrame:
    """(a, b), a < b, of balls with members that share a bucket and that may hold a link by centre and radius."""
    inside = salted_join(members, centres.select("ball", "centre", "radius"), ["ball"], F.col("id"), "inner", salts=8)
    marks = _marks(inside, near, hashes)
    marks = written(marks, "marks")
    # Counts combine before the shuffle; buckets of one ball, or of probes only, name no pair.
    full = marks.groupBy("bucket").agg(F.count("*").alias("n"), F.min("ball").alias("least"), F.max("ball").alias("most"), F.max("own").alias("any_own")).filter("least < most and any_own").select("bucket", F.ceil(F.col("n") / near.block).cast("long").alias("blocks"))
    shared = marks.join(full, "bucket")

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ball, own, radius, left, right = (group.column(n).to_numpy() for n in ("ball", "own", "radius", "left", "right"))
        codes = normal(np.stack([np.frombuffer(c, np.int8) for c in group.column("code").to_pylist()]).astype(np.float64)).astype(np.float32)
        sides = []
        for side in (left, right):
            at = np.flatnonzero(side)
            order = at[np.lexsort((~own[at], ball[at]))]
            sides.append(order[np.concatenate([[True], ball[order][1:] != ball[order][:-1]])] if len(order) else order)
        a, b = sides
        if len(a) and len(b):
            far = np.arccos(np.clip(codes[a] @ codes[b].T, -1, 1))
            hit = (far <= near.angle + radius[a][:, None] + radius[b] + 2e-3) & (own[a][:, None] | own[b]) & (ball[a][:, None] != ball[b])
            x, y = np.nonzero(hit)
            if len(x):
                pairs = np.unique(np.sort(np.stack([ball[a[x]], ball[b[y]]], 1), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return _by_block(_halves(shared, "ball", F.col("blocks")), ["bucket", "i", "j"], compare, "a long, b long").distinct()


def decided(pairs: DataFrame, centres: DataFrame, near: Near) -> DataFrame:
    """``pairs`` with sizes and ``links``: 1 if all their members link, 0 if some may; pairs that cannot link are gone."""
    for side in ("a", "b"):
        pairs = pairs.join(centres.select(F.col("ball").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("centre", "radius", "size")]), side)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = np.full(len(batch), -1, np.int32)
            radius = batch.column("a_radius").to_numpy() + batch.column("b_radius").to_numpy()
            others = {x.shape[1]: (at, x) for at, x in unit_rows(batch.column("b_centre"))}
            for at, x in unit_rows(batch.column("a_centre")):
                cosine = (x * others[x.shape[1]][1]).sum(1)
                far = np.arccos(np.clip(cosine, -1, 1))
                some = far - radius[at] <= near.angle + SURE
                every = far + radius[at] <= near.angle - SURE
                lone = radius[at] == 0
                links[at] = np.where(lone, np.where(cosine >= near.threshold, 1, -1), np.where(every, 1, np.where(some, 0, -1)))
            keep = pa.array(links >= 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("a", "b", "a_size", "b_size")), pa.array(links)], names=["a", "b", "a_size", "b_size", "links"]).filter(keep)

    return written(map_arrow(pairs.select("a", "b", "a_size", "b_size", "a_radius", "b_radius", "a_centre", "b_centre"), decide, "a long, b long, a_size long, b_size long, links int"), "decided-pairs")


def member_links(pairs: DataFrame, members: DataFrame, near: Near) -> DataFrame:
    """(a, b, id, n) for members of undecided ``pairs``: how many of the other ball's they link with. Compared block by block."""
    cut = lambda size: F.ceil(F.col(size) / near.block).cast("long")
    pairs = pairs.withColumns({"a_cut": cut("a_size"), "b_cut": cut("b_size")})
    rows = members.select("id", "vector", "ball")
    sides = []
    for left, own, other in ((True, "a", "b"), (False, "b", "a")):
        met = salted_join(rows.withColumnRenamed("ball", own), pairs.select("a", "b", "a_cut", "b_cut"), [own], F.col("id"), "inner", salts=8)
        block = F.pmod(F.xxhash64("id"), F.col(f"{own}_cut"))
        spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_cut") - 1))
        sides.append(met.withColumn("_own", block).withColumn("_other", spread).select("a", "b", "id", "vector", F.lit(left).alias("left"), F.col("_own" if left else "_other").alias("i"), F.col("_other" if left else "_own").alias("j")))

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        left, ids = group.column("left").to_numpy(), group.column("id").to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        if len(a) and len(b):
            (_, x), = unit_rows(group.column("vector").combine_chunks())
            links = x[a] @ x[b].T >= near.threshold
            n = np.concatenate([links.sum(1), links.sum(0)])
            at = np.concatenate([a, b])[n > 0]
            where = [pa.array(np.full(len(at), group.column(c)[0].as_py(), np.int64)) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*where, pa.array(ids[at]), pa.array(n[n > 0].astype(np.int64))], names=["a", "b", "id", "n"])

    return _by_block(sides[0].unionByName(sides[1]), ["a", "b", "i", "j"], compare, "a long, b long, id long, n long")


def near_duplicates(rows: DataFrame, near: Near = Near(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: the other vectors it links with, the least id reachable, whether that is its own.

    Vectors link whose cosine in double precision is ``threshold`` at least. Pairs come from shared buckets, so a pair at the threshold is
    found with the stated recall and nearer ones with more; all links between the balls of a pair found are counted.
    Ids are whole numbers. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors
    of different lengths. Rows that share an id are vectors of their own; a component's id is the least id that is not null, null
    if none has one, and ``kept`` compares with nulls equal. No rows give no rows.
    """
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)
    base = written(rows.select(F.monotonically_increasing_id().alias("id"), F.col(id_col).cast("long").alias("vec_id"), F.when(usable, vec).alias("vector")), "vectors")
    size = base.filter("vector is not null").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    hashes = near.hashes(size["n"], size["width"] or 1)
    members, centres = balls(base.filter("vector is not null").select("id", "vector"), near, hashes)
    pairs = decided(ball_pairs(members, centres, near, hashes), centres, near)
    some = written(member_links(pairs.filter("links = 0"), members, near), "member-links")
    every = pairs.filter("links = 1")
    edges = every.select("a", "b").unionByName(some.select("a", "b").distinct())
    roots = components(edges).select(F.col("node").alias("ball"), "root")
    reached = every.select(F.col("a").alias("ball"), F.col("b_size").alias("n")).unionByName(every.select(F.col("b").alias("ball"), F.col("a_size").alias("n"))).groupBy("ball").agg(F.sum("n").alias("reached"))
    facts = centres.select("ball", "size").join(roots, "ball", "left").join(reached, "ball", "left").select("ball", F.coalesce("root", "ball").alias("root"), (F.col("size") - 1 + F.coalesce("reached", F.lit(0))).alias("sure"))
    own = members.select("id", "ball").join(some.groupBy("id").agg(F.sum("n").alias("more")), "id", "left")
    own = salted_join(own, facts, ["ball"], F.col("id")).select("id", "root", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_links"))
    whole = written(base.select("id", "vec_id").join(own, "id", "left").select("vec_id", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "near-vectors")
    least = whole.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = salted_join(whole, least, ["root"], F.col("vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
