"""Toxicity of texts by their nearest labelled examples.

Texts are TF-IDF vectors over all words of the examples. A word's weight is (1 + ln tf) * idf * rf**2: idf counts all documents, rf
is the relevance frequency log2(2 + r), r being how much more frequent the word is in toxic examples than in others. The
examples are held as an inverted index whose postings lie in blocks of examples with the largest weight of each word
in each block. A query's blocks are visited by their bounds, and those that cannot reach the k-th best cosine
are skipped; the neighbours found are exact. Votes weighted by similarity are calibrated by a logistic curve
that is fitted to the votes of the examples on each other, and the neighbours are the evidence.

The classifier is fitted on a bounded sample of the labelled rows (``Bounds.examples``, both labels at one rate, by a hash of the id).
Document frequencies are counted over all documents, and every document is scored. The index has a
size bound with the sample, so it is broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, release_memory, sliced, without_rows, written

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Bounds:
    """Labelled rows to learn from at most; neighbours that vote; examples in a block; share of examples from which a word is frequent, and
    how many are at most; rows of the mean rate that smooth a word's counts; weight of the mean rate in a vote."""

    examples: int = 4000
    neighbours: int = 15
    block: int = 32
    rare: float = 0.02
    frequent: int = 1024
    smoothing: float = 5.0
    shrink: float = 0.5


#: Results of equal texts that a task keeps; similarity from which an example does not vote on a copy of itself; queries at a time.
KEPT_RESULTS, SAME, QUERIES = 20_000, 0.95, 128


def word_counts(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one behind the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class BlockIndex:
    """Examples (id, toxic, word numbers, counts) as unit vectors in an inverted index of blocks of examples; ``nearest`` finds the exact k best cosines of many queries.

    Words that few examples have lie in posting lists and are summed for every example that has them. Words that many have
    lie in blocks (examples by words) with the largest weight of each word in each block: a query's sum over them and the largest
    rare sum in a block bound the block's cosines, and a block is multiplied with the queries only that it may serve.
    """

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weight: np.ndarray, bounds: Bounds):
        self.bounds, self.weight = bounds, weight
        use = np.bincount(np.concatenate([np.zeros(0, np.int64), *[e[2] for e in examples]]), minlength=len(weight))
        vectors = [(i, toxic, terms, self.unit(terms, counts)) for i, toxic, terms, counts in examples if len(terms)]
        # Like examples lie together, so that bounds of blocks are tight: by their commonest word, mostly of one language, then the strongest.
        vectors.sort(key=lambda e: (int(e[2][np.argmax(use[e[2]])]), int(e[2][np.argmax(e[3])]), e[0]))
        self.ids = [v[0] for v in vectors]
        self.labels = np.array([v[1] for v in vectors], np.float64)
        self.vectors = [(v[2], v[3]) for v in vectors]
        terms = np.concatenate([np.zeros(0, np.int64), *[v[2] for v in vectors]])
        owner = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])
        weights = np.concatenate([np.zeros(0), *[v[3] for v in vectors]])
        #: Number of a frequent word among those, -1 for others.
        frequent = np.argsort(-use, kind="stable")[: bounds.frequent]
        frequent = frequent[use[frequent] > len(vectors) * bounds.rare]
        self.column = np.full(len(weight), -1)
        self.column[frequent] = np.arange(len(frequent))
        own = self.column[terms] >= 0
        self.cells = (owner[own].astype(np.int32), self.column[terms[own]].astype(np.int32), weights[own])
        terms, owner, weights = terms[~own], owner[~own], weights[~own]
        order = np.lexsort((owner, terms))
        self.owner, self.weights = owner[order].astype(np.int32), weights[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.dense: np.ndarray | None = None
        self.most: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None, "most": None}

    def _spread(self) -> None:
        """The blocks, [block, example, word], and their largest weights, [word, block]; made once for each worker."""
        size, blocks = self.bounds.block, -(-len(self.ids) // self.bounds.block)
        flat = np.zeros((blocks * size, int(self.column.max(initial=-1)) + 1))
        flat[self.cells[0], self.cells[1]] = self.cells[2]
        self.dense = flat.reshape(blocks, size, -1)
        self.most = np.ascontiguousarray(self.dense.max(1, initial=0).T)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return w / math.sqrt(float(w @ w) or 1.0)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], below: float = math.inf) -> list[list[tuple[float, int]]]:
        """For each query (ascending words, their unit vector): (cosine, example) of the k nearest with a cosine above 0 (and under ``below``), best first, ties by example."""
        return [near for first in range(0, len(queries), QUERIES) for near in self._nearest(queries[first : first + QUERIES], below)]

    def _nearest(self, queries: list, below: float) -> list[list[tuple[float, int]]]:
        if not self.ids:
            return [[] for _ in queries]
        if self.dense is None:
            self._spread()
        (blocks, size, width), k, n = self.dense.shape, self.bounds.neighbours, len(queries)
        terms, weights = np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries])
        row, column = np.repeat(np.arange(n), [len(q[0]) for q in queries]), self.column[terms]
        common = column >= 0
        wide = np.zeros((n, width))
        wide[row[common], column[common]] = weights[common]
        terms, weights, row = terms[~common], weights[~common], row[~common]
        starts, ends = self.begin[terms], self.begin[terms + 1]
        at, times = _ranges(starts, ends), ends - starts
        sums = np.bincount(np.repeat(row, times) * (blocks * size) + self.owner[at], np.repeat(weights, times) * self.weights[at], n * blocks * size).astype(np.float64).reshape(n, blocks, size)
        limits = sums.max(2) + wide @ self.most
        visited = np.zeros((n, blocks), bool)

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                own = np.flatnonzero(wanted[:, b])
                sums[own, b] += wide[own] @ self.dense[b].T
            np.logical_or(visited, wanted, out=visited)

        first = np.zeros((n, blocks), bool)
        np.put_along_axis(first, np.argpartition(-limits, min(blocks, -(-2 * k // size)) - 1, 1)[:, : -(-2 * k // size)], True, 1)
        visit(first & (limits > 0))
        flat = sums.reshape(n, -1)
        scores = lambda: np.where(np.repeat(visited, size, 1) & (flat < below - 1e-9), flat, 0.0)
        least = np.partition(scores(), -k, 1)[:, -k] if flat.shape[1] >= k else np.zeros(n)
        visit(~visited & (limits > 0) & (limits + 1e-9 >= least[:, None]))
        final = np.round(scores(), 9)
        out = []
        for own in final:
            found = np.flatnonzero(own)
            if len(found) > k:
                found = found[own[found] >= np.partition(own[found], -k)[-k]]
            found = found[np.lexsort((found, -own[found]))][:k]
            out.append(list(zip(own[found].tolist(), found.tolist(), strict=True)))
        return out

    def vote(self, near: list[tuple[float, int]], base: float) -> float:
        """The share of toxic examples among the neighbours, weighted by similarity and shrunk towards ``base``, as log odds."""
        weight, toxic = sum(s for s, _ in near), sum(s * self.labels[i] for s, i in near)
        share = (toxic + self.bounds.shrink * base) / (weight + self.bounds.shrink)
        return math.log(share / (1 - share))


@dataclass
class Model:
    """The index (None where either label is missing), the rate of toxic rows, the curve from votes to scores."""

    index: BlockIndex | None
    base: float
    curve: tuple[float, float] = (0.0, 1.0)

    def score(self, vote: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.curve[0] + self.curve[1] * vote))))


def fitted_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on votes, drawn a little to (0, 1), the curve that changes nothing; by Newton steps."""
    x, curve = np.stack([np.ones(len(votes)), votes], 1), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (labels - p) - (curve - [0.0, 1.0]))
        curve = curve + step
        if np.abs(step).max() < 1e-10:
            break
    return float(curve[0]), float(max(curve[1], 0.0))


def examples_of(rows: DataFrame, labels: DataFrame, bounds: Bounds) -> DataFrame:
    """(doc_id, toxic, words, counts): at most ``bounds.examples`` labelled rows of ``rows``, the first by a hash of the id.

    Ids are chosen before texts move; the broadcast has ``bounds.examples`` rows at most.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(rows.select("doc_id").distinct(), "doc_id")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bounds.examples)
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("print"), "text"))["text"].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=2):
            found = [word_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "counts"])

    return map_arrow(texts, count, "doc_id long, toxic int, words array<string>, counts array<int>")


def document_frequencies(rows: DataFrame, words) -> np.ndarray:
    """In how many of all ``rows`` (text) each of ``words`` (a broadcast name and array) occurs; tasks count, Spark sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(words)
        found = np.zeros(len(numbers), np.int64)
        for batch in sliced(batches, column=0):
            own = [numbers[w] for t in batch.column(0).to_pylist() for w in set(WORD.findall((t or "").lower())) if w in numbers]
            found += np.bincount(np.array(own, np.int64), minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["word", "n"])
        _NUMBERS.clear()

    summed = map_arrow(rows.select("text"), count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words.value[1]), np.int64)
    out[summed.column("word").to_numpy()] = summed.column("n").to_numpy()
    return out


_NUMBERS: dict[str, dict[str, int]] = {}


def _numbers(words) -> dict[str, int]:
    """Numbers of the words of a broadcast (name, array); made once for each worker."""
    name, array = words.value
    if name not in _NUMBERS:
        _NUMBERS.clear()
        _NUMBERS[name] = {w: i for i, w in enumerate(array.to_pylist())}
    return _NUMBERS[name]


def learn_toxicity(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """What scores texts: (broadcast words, broadcast model), learned from ``labels`` (doc_id, toxic) and the documents' texts.

    Labels that are null, neither 0 nor 1, or without a document are not used; of several for one id the highest counts; of
    several rows with one id one is an example.
    """
    learned = _learned(docs, labels, bounds, id_col, text_col)
    release_memory()  # the driver's: sample and temporary arrays are gone by now
    return learned


def _learned(docs: DataFrame, labels: DataFrame, bounds: Bounds, id_col: str, text_col: str) -> tuple:
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The sample's size is bounded, so it may pass through the driver.
    found = written(examples_of(rows, labels, bounds), "toxic-examples").toArrow().sort_by("doc_id")
    toxic = found.column("toxic").to_numpy().astype(np.int64)
    total = len(toxic)
    base = (float(toxic.sum()) + 0.05) / (total + 1.0)
    lists = found.column("words").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    words = context.broadcast((uuid.uuid4().hex, coded.dictionary))
    terms, counts = coded.indices.to_numpy().astype(np.int64), found.column("counts").combine_chunks().flatten().to_numpy()
    if not 0 < toxic.sum() < total:
        return words, context.broadcast(Model(None, base))
    cuts = np.cumsum(lists.value_lengths().to_numpy())[:-1]
    n_docs, df = rows.count(), document_frequencies(rows, words)
    with_toxic = np.bincount(terms, np.repeat(toxic, lists.value_lengths().to_numpy()), len(df))
    with_other = np.bincount(terms, minlength=len(df)) - with_toxic
    rate = toxic.sum() / total
    ratio = (with_toxic + bounds.smoothing * rate) / (with_other + bounds.smoothing * (1 - rate)) * (1 - rate) / rate
    weight = (np.log((n_docs + 1) / (df + 1)) + 1e-3) * np.log2(2 + ratio) ** 2
    parts = []
    for doc, label, own, n in zip(found.column("doc_id").to_pylist(), toxic.tolist(), np.split(terms, cuts), np.split(counts, cuts), strict=True):
        order = np.argsort(own)
        parts.append((doc, label, own[order], n[order]))
    model = Model(BlockIndex(parts, weight, bounds), base)
    shared = context.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.index
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.vote(near, base) for near in index.nearest([index.vectors[i] for i in own], below=SAME)], pa.float64())], names=["at", "vote"])

    numbers = docs.sparkSession.range(0, len(model.index.ids), 1, max(1, min(64, len(model.index.ids) // 50))).select(F.col("id").alias("at"))
    cast = map_arrow(numbers, votes, "at long, vote double").toArrow().sort_by("at")
    shared.destroy()
    model.curve = fitted_curve(cast.column("vote").to_numpy(), model.index.labels)
    model.index.vectors = []
    return words, context.broadcast(model)


def _release(learned: tuple) -> None:
    """Drop what a task built from the broadcasts: workers live on idle while other stages need the memory."""
    _NUMBERS.clear()
    if (index := learned[1].value.index) is not None:
        index.dense = index.most = None
    release_memory()


def _scorer(learned: tuple) -> Callable[[list[str | None]], list[tuple[float, list[dict]]]]:
    """A function from texts to (score, evidence) for use in a task; equal texts are scored once."""
    words, shared = learned
    numbers, model, seen = _numbers(words), shared.value, {}
    index = model.index

    def query(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = sorted((numbers[w], n) for w, n in word_counts(text).items() if w in numbers)
        terms, counts = np.array(found, np.int64).reshape(-1, 2).T
        return terms, index.unit(terms, counts)

    def score(texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        if index is None:
            return [(model.base, [])] * len(texts)
        keys = [hashlib.blake2b((t or "").encode("utf-8", "replace"), digest_size=16).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}
        for key, near in zip(new, index.nearest([query(t) for t in new.values()]), strict=True):
            seen[key] = (model.score(index.vote(near, model.base)), [{"doc_id": index.ids[i], "toxic": int(index.labels[i]), "similarity": s} for s, i in near[:3]])
        out = [seen[k] for k in keys]
        if len(seen) > KEPT_RESULTS:
            seen.clear()
        return out

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, evidence) of every row of ``docs``, learned from ``labels`` (doc_id, toxic).

    evidence is the nearest examples: doc_id, toxic, similarity. Edge cases: null and empty texts, and texts without a word of
    the examples, have no neighbours and the score of the mean rate; without usable labels, or with one kind
    only, every score is the smoothed rate of toxic rows; very long texts are read whole; repeated rows and null ids are kept; ties among
    neighbours fall by the order of examples; an empty table gives an empty result; other columns are not read.
    """
    learned = learn_toxicity(docs, labels, bounds, id_col, text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(learned)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))
        for batch in sliced(batches):
            out = score(batch.column(1).to_pylist())
            scores = np.array([s for s, _ in out], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32()), pa.array([e for _, e in out], kind)], names=["doc_id", "score", "predicted", "evidence"])
        _release(learned)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, vote, "doc_id long, score double, predicted int, evidence array<struct<doc_id:bigint,toxic:int,similarity:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Every row is judged by its own text, so repeated ids, null ids and columns of any name are left as they are. Null and empty
    texts stay unless most labelled rows are toxic; repeated rows stay or go together; very long texts are read whole; an empty table
    gives an empty result.
    """
    learned = learn_toxicity(docs, labels, bounds, id_col, text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(learned)
        for batch in sliced(batches):
            hit = pa.array([s >= 0.5 for s, _ in score(batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["id", "digest"]).filter(hit)
        _release(learned)

    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest.alias("digest"))
    lost = written(map_arrow(rows, judge, f"id {dict(rows.dtypes)['id']}, digest string").distinct().withColumn("same", F.lit(0)), "toxic-rows")
    # The verdicts are in a table, so nothing needs the model any more, on the driver or elsewhere.
    for shared in learned:
        shared.destroy()
    return without_rows(docs, lost, id_col, digest)
