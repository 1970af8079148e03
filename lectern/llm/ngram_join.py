"""N-gram Jaccard self-join by vertical partitioning.

The global order of shingles is that of their 64-bit hashes; it is cut into fragments, the same for all documents.

1. Filter. If two sets link, the larger has at most ``hi`` shingles and they differ in at most D = (1-t)/(1+t) * 2 hi; with
   more than D fragments at least one is equal in both. A set therefore announces the content of each of its
   fragments, and only sets that share an announced fragment are compared. A fragment is a combination of several
   shingles, so a passage that very many documents share makes no candidates, unless it is most of their text.
   There are spare fragments (see ``_plan``), so that linked sets have several equal ones: a set that shares fewer with all
   others together than a link needs is dropped, which leaves hardly any that share a passage only. Empty fragments
   are announced only by sets that have more of them than there are spares, so no link is lost.
2. Candidates form clusters, separately for each size class of the larger set. Within one, shingles are cut into fragments again, the partial overlaps of all its pairs are
   counted fragment by fragment (as products of membership matrices; rare shingles as lists of pairs), and summed per pair. Large clusters are compared in pairs of
   blocks of bounded size, by bands of set size, so no task holds a whole cluster and no pair becomes a row.
3. Links span components; of each block pair only a spanning forest and each set's number of links leave the task.

Equal sets are one set throughout; copies are not expanded into pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import counted_join, map_arrow, maybe_among, passing_tables, salted_join, scratch_path, sliced, stored, without_rows, written
from lectern.llm.components import components
from lectern.llm.shingles import shingle_sets
from lectern.llm.token_store import mixed_bits
from lectern.shipping import ship

#: Size classes grow by this factor; a block holds this many shingles and sets; shingles in one fragment of the counting; pairs of holders up to which a shingle is
#: rare; spare fragments for each that may differ; rounds that drop sets with too few shared fragments.
GROWTH, BLOCK_SHINGLES, BLOCK_SETS, COLUMNS, RARE_PAIRS, SPARE, PRUNINGS = 1.35, 500_000, 2048, 4096, 64, 0.3, 2


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words; two sets link when 100 * intersection >= ``percent`` * union."""

    words: int = 4
    percent: int = 85

    def size_class(self, n: int) -> int:
        """The smallest class whose upper size is at least n."""
        c = max(0, math.ceil(math.log(max(n, 1)) / math.log(GROWTH)) - 1)
        while self.upper(c) < n:
            c += 1
        return c

    def upper(self, c: int) -> int:
        return int(GROWTH**c)

    def differing(self, c: int) -> int:
        """In how many shingles two linked sets differ at most, if the larger is of class c."""
        return (100 - self.percent) * 2 * self.upper(c) // (100 + self.percent)

    def schemes(self, n: int) -> range:
        """The classes that the larger of two linked sets can have if the smaller, or the larger, has n shingles."""
        return range(self.size_class(n), self.size_class(n * 100 // self.percent) + 1)


def _plan(join: Join, c: int) -> tuple[int, int]:
    """(fragments, spares) of class c: of ``fragments`` at least ``spares`` + 1 are equal in two linked sets."""
    spare = 1 + int(SPARE * join.differing(c))
    return join.differing(c) + 1 + spare, spare


def announced(s: np.ndarray, join: Join) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each size class that matters to a sorted set of shingles: the class, a number, the fragments it announces.

    The set shares at least that number of announced fragments with any set of the class that it links with.

    Of two linked sets at least spares + 1 fragments are equal. If either set has no more empty fragments than there are
    spares, one of the equal ones has shingles in it and both announce it; else both announce the empty ones too.
    """
    for c in join.schemes(len(s)):
        if join.differing(c) == 0 or not len(s):
            continue
        k, spare = _plan(join, c)
        place = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        content = np.add.reduceat(mixed_bits(s), first)
        label = mixed_bits(content ^ mixed_bits(place[first] + np.uint64(c << 40)))
        out, weak = [label], k - len(first)
        if weak > spare:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), place[first])
            out.append(mixed_bits(mixed_bits(empty + np.uint64(c << 40)) ^ np.uint64(0x5EED)))
        yield c, max(1, spare + 1 - weak), np.concatenate(out)


def node_id(own: int, c: int) -> int:
    """A set within a size class, as a number of 55 bits."""
    return int(mixed_bits(np.array([own], np.int64).view(np.uint64) + np.uint64(c))[0] >> np.uint64(9))


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in sliced(batches):
        yield batch, batch.column(1).to_pylist()


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def document_sets(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, set): equal numbers mean equal sets; null for an empty set. digest is the text's SHA-256."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            sets = shingle_sets(texts, join.words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "digest", "n_shingles", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _digest(F.col(text_col)).alias("digest"))
    return map_arrow(rows, measure, "doc_id long, digest string, n_shingles long, set long")


def candidate_clusters(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, cluster) of all sets that share an announced fragment with another one, within a size class.

    Two linked sets are in one cluster of the class of the larger one.
    """

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _slices(batches):
            marks, owners = [], []
            for s in shingle_sets(texts, join.words):
                if len(s) and (own := set_id(s)) not in seen:
                    seen.add(own)
                    for c, need, found in announced(s, join):
                        marks.append(found)
                        owners.append(np.full(len(found), node_id(own, c) << 8 | min(need, 255), np.int64))
            if len(seen) > 1_000_000:  # copies beyond this are found by the grouping
                seen.clear()
            if marks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks).view(np.int64)), pa.array(np.concatenate(owners))], names=["mark", "node"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Both uses below read one shuffle of the marks: the filter is what the join would add on its side only.
    marks = map_arrow(rows, announce, "mark long, node long").filter("mark is not null and node is not null").repartition("mark")
    path = scratch_path(docs.sparkSession, "spokes")
    with passing_tables(docs.sparkSession):
        # Both sides come from one shuffle; the shared marks are few, so their side is hashed and the other streams by.
        # Each row keeps how many nodes its mark had, so that later joins know the marks of very many on either side.
        held = written(marks.join(_shared(marks, F.count("*")).hint("shuffle_hash"), "mark"), "shared-marks")
        for _ in range(PRUNINGS):
            enough = held.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= F.col("node").bitwiseAND(255)).select("node")
            held = held.join(enough, "node").drop("hub")
            # Marks are many and most have few nodes, so only those of very many are repeated.
            held = written(counted_join(held, _shared(held, F.max("n")), ["mark"], F.col("node"), "n"), "shared-marks")
        spokes = stored(held.filter("node <> hub").select(F.shiftright("node", 8).alias("a"), F.shiftright("hub", 8).alias("b")), path)
    return components(spokes).select("node", F.col("root").alias("cluster"))


def _shared(marks: DataFrame, most: Column) -> DataFrame:
    """(mark, hub, n) of the marks that two nodes or more have; hub is the least of them, n what ``most`` says of a mark's rows."""
    return marks.groupBy("mark").agg(F.min("node").alias("hub"), F.max("node").alias("other"), most.alias("n")).filter("hub < other").select("mark", "hub", "n")


def _nodes(sets: DataFrame, join: Join) -> DataFrame:
    """``sets`` (set, least_id, n) with a row for each size class: scheme, node."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(own, least, n, c, node_id(own, c)) for own, least, n in zip(*(x.to_pylist() for x in batch.columns), strict=True) for c in join.schemes(n) if join.differing(c)]
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["set", "least_id", "n", "scheme", "node"])

    return map_arrow(sets.select("set", "least_id", "n"), spread, "set long, least_id long, n long, scheme int, node long")


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``left`` link with which of ``right``: overlaps counted fragment by fragment and summed per pair."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    flats = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes, strict=True)]
    common = np.intersect1d(*flats)  # a shingle on one side only adds to no overlap
    overlap = np.zeros((len(left), len(right)), np.float32)
    places = [np.searchsorted(common, f) for f in flats]
    held = [(p < len(common)) & (common[np.minimum(p, len(common) - 1)] == f) if len(common) else np.zeros(len(f), bool) for p, f in zip(places, flats, strict=True)]
    rows, places = [r[h] for r, h in zip(rows, held, strict=True)], [p[h] for p, h in zip(places, held, strict=True)]
    order = [np.argsort(p, kind="stable") for p in places]
    rows, places = [r[o] for r, o in zip(rows, order, strict=True)], [p[o] for p, o in zip(places, order, strict=True)]
    ends = [np.searchsorted(p, np.arange(len(common) + 1)) for p in places]
    counts = [np.diff(e) for e in ends]
    rare = counts[0] * counts[1] <= RARE_PAIRS
    # Rare shingles: every pair of holders, one after the other.
    at = np.flatnonzero(rare)
    for first in range(0, len(at), 16 * COLUMNS):
        own = at[first : first + 16 * COLUMNS]
        pairs = counts[0][own] * counts[1][own]
        column = np.repeat(own, pairs)
        nth = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i = rows[0][ends[0][column] + nth // counts[1][column]]
        j = rows[1][ends[1][column] + nth % counts[1][column]]
        overlap += np.bincount(i * len(right) + j, minlength=overlap.size).reshape(overlap.shape)
    frequent = np.cumsum(~rare) - 1
    total = int((~rare).sum())
    for first in range(0, total, COLUMNS):
        parts = []
        for side in (0, 1):
            own = ~rare[places[side]] & (frequent[places[side]] >= first) & (frequent[places[side]] < first + COLUMNS)
            part = np.zeros((len(sizes[side]), min(COLUMNS, total - first)), np.float32)
            part[rows[side][own], frequent[places[side][own]] - first] = 1
            parts.append(part)
        overlap += parts[0] @ parts[1].T
    both = np.rint(overlap).astype(np.int64)
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links as pairs of set numbers."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(links)), strict=True):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(left[i]), int(right[j])))
    return out


def _blocks(sized: DataFrame, join: Join) -> DataFrame:
    """``sized`` (set, cluster, scheme, n) with ``task`` and ``side``: where a set is compared.

    A cluster that fits a block is one task, packed with others. A larger one is cut into bands by set size (linked
    sets are in one or neighbouring bands) and each band into blocks by hash; every two blocks that may hold a link
    are a task. A set goes to as many tasks as its bands have blocks.
    """
    totals = sized.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    fits = (F.col("sets") <= BLOCK_SETS) & (F.col("total") <= BLOCK_SHINGLES)
    large = totals.filter(~fits).select("cluster", F.lit(True).alias("large"))
    marked = written(salted_join(sized, large, ["cluster"], F.col("set")), "cluster-sizes")
    small = marked.filter("large is null")
    bins = 1 + (small.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES
    packed = small.select("set", "cluster", "scheme", F.concat(F.lit("p"), F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("string")).alias("task"), F.lit("x").alias("side"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / join.percent + 1e-9)).cast("int")
    banded = marked.filter("large").select("set", "cluster", "scheme", "n", band.alias("band"))
    counts = banded.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    around = counts
    for step in (-1, 1):
        near = counts.select("cluster", (F.col("band") - step).alias("band"), F.col("blocks").alias(f"near{step}"))
        around = around.join(near, ["cluster", "band"], "left")
    placed = salted_join(banded, around, ["cluster", "band"], F.col("set"), "inner").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    others = lambda b, n: F.when(F.col(n).isNotNull(), F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct((F.col("band") + b).alias("band"), k.alias("block")))).otherwise(F.array().cast("array<struct<band:int,block:int>>"))
    own = F.struct("band", "block")
    pairs = placed.withColumn("own", own).withColumn("other", F.explode(F.concat(others(-1, "near-1"), others(0, "blocks"), others(1, "near1"))))
    name = lambda x: F.concat_ws(".", x["band"], x["block"])
    first, second = F.least("own", "other"), F.greatest("own", "other")
    crossed = pairs.select("set", "cluster", "scheme", F.concat_ws("/", F.lit("c"), F.col("cluster"), name(first), name(second)).alias("task"), F.when(F.col("own") == F.col("other"), "x").when(F.col("own") < F.col("other"), "l").otherwise("r").alias("side"))
    return packed.unionByName(crossed)


def _compare(join: Join):
    def compare(task: pa.Table) -> pa.Table:
        nodes, others, links = [], [], []
        table = task.select(["set", "cluster", "scheme", "side", "shingles"]).to_pandas()
        for _, group in table.groupby("cluster", sort=False):
            group = group.drop_duplicates("set")
            values = [np.asarray(s, np.int64).view(np.uint64) for s in group["shingles"]]
            ids, side = group["set"].to_numpy(), group["side"].to_numpy()
            left = np.flatnonzero(side != "r")
            right = np.flatnonzero(side != "l")
            if not len(left) or not len(right):
                continue
            found = linked([values[i] for i in left], [values[i] for i in right], join.percent)
            # A pair counts in the class of its larger set, though both may meet in another one too.
            classes = np.array([join.size_class(len(v)) for v in values])
            found &= np.maximum(classes[left][:, None], classes[right][None, :]) == group["scheme"].iloc[0]
            if same := (side == "x").all():
                np.fill_diagonal(found, False)
            for at, degree in [(left, found.sum(1))] + ([] if same else [(right, found.sum(0))]):
                nodes += ids[at].tolist()
                others += [None] * len(at)
                links += degree.tolist()
            for a, b in _forest(np.triu(found) if same else found, ids[left], ids[right]):
                nodes.append(a)
                others.append(b)
                links.append(0)
        return pa.table({"set": pa.array(nodes, pa.int64()), "other": pa.array(others, pa.int64()), "links": pa.array(links, pa.int64())})

    return compare


def jaccard_components(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, links.

    component_id is the smallest doc_id reachable by links, itself included; links counts the different sets that the
    document's set links with, besides its own.

    Edge cases: null and empty texts, and texts without words, have no shingles and are alone; texts with fewer words
    than a shingle have one of them all; very long texts are whole; repeated rows and equal sets are one component; a
    null id counts for no component's smallest, and stands for itself; an empty table gives an empty result; other
    columns are not read; ids are whole numbers. Sets are told apart by 64-bit hashes of 64-bit shingles.
    """
    return _joined(docs, join, id_col, text_col).select("doc_id", "n_shingles", "component_id", "links")


def _joined(docs: DataFrame, join: Join, id_col: str, text_col: str) -> DataFrame:
    """What ``jaccard_components`` gives, with digest, the text's, and root, the least set of the component (null without shingles)."""
    members = written(document_sets(docs, join, id_col, text_col), "document-sets")
    sets = members.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"))
    clusters = written(candidate_clusters(docs, join, id_col, text_col), "clusters")
    sized = written(_nodes(sets, join).join(clusters, "node"), "cluster-members")

    def spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches):
            kept = {set_id(s): s for s in shingle_sets(texts, join.words) if len(s)}
            sizes = np.cumsum([0, *map(len, kept.values())])
            flat = np.concatenate([np.zeros(0, np.uint64), *kept.values()]).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], names=["set", "shingles"])

    wanted = maybe_among(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")), "_id", sized.select(F.col("least_id").alias("_id")))
    texts = wanted.filter("maybe").select("_id", "text")
    spelled = map_arrow(texts, spell_out, "set long, shingles array<long>").dropDuplicates(["set"])
    tasks = _blocks(sized.select("set", "cluster", "scheme", "n"), join).join(spelled, "set")
    ship(docs.sparkSession)
    found = written(tasks.groupBy("task").applyInArrow(_compare(join), "set long, other long, links long"), "links")
    degrees = found.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other is not null").select(F.col("set").alias("a"), F.col("other").alias("b")))
    rooted = sets.join(roots.withColumnRenamed("node", "set"), "set")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = salted_join(rooted.select("set", "root"), least, ["root"], F.col("set"), "inner").select("set", "root", "component_id")
    facts = sets.select("set", "least_id").join(named, "set", "left").join(degrees, "set", "left")
    facts = facts.select("set", F.coalesce("root", "set").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = salted_join(members, written(facts, "set-facts"), ["set"], F.col("doc_id"))
    return out.select("doc_id", "digest", "root", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drop_near_duplicates(docs: DataFrame, join: Join = Join(words=5, percent=80), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component, all columns kept: the one with the smallest id, null last, then the smallest digest of its text.

    Rows are told apart by id and text, so rows that share an id with a near copy stay. Edge cases: texts without words all stay; null
    ids take part like others; of repeated rows one stays; very long texts are whole; other columns may have any name; an
    empty table stays empty.
    """
    if docs.isEmpty():
        return docs
    path = scratch_path(docs.sparkSession, "near-lost")
    with passing_tables(docs.sparkSession):
        found = written(_joined(docs, join, id_col, text_col).filter("root is not null").select("doc_id", "digest", "root"), "near-found")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
        first = found.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first")
        placed = salted_join(found, first, ["root"], F.struct("doc_id", "digest"), "inner").withColumn("lost", F.col("first") != place)
        gone = placed.filter("lost").select(F.col("doc_id").alias("id"), "digest").distinct().withColumn("same", F.lit(0).cast("long"))
        tied = placed.filter("not lost").groupBy(F.col("doc_id").alias("id"), "digest").agg(F.count("*").alias("same")).filter("same > 1")
        lost = stored(gone.unionByName(tied), path)
    return without_rows(docs, lost, id_col, _digest(F.col(text_col)))
