"""Language of texts and of spans within them.

The script of a word's letters narrows the candidate languages to those seen in that script. A word's score in a language is
the sum of log-probabilities of its character n-grams; the best path of a Viterbi search over the words, with a
penalty for each switch, labels spans. A document's language is the one with the most letters.

Counts are gathered by Spark over all labelled rows; the model is a table of fixed size for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, sliced
from lectern.llm.token_store import mixed_bits

BUCKETS, GRAMS, SWITCH, SMOOTHING, RARE = 1 << 16, (2, 3, 4), 12.0, 0.1, 0.002
#: First code points of script blocks, and the script from there on (0 Latin and all else).
SCRIPTS = ((0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x780, 0), (0x900, 6), (0x980, 7), (0xA00, 8), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 13), (0x3100, 14), (0x3130, 11), (0x3190, 14), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 14), (0xFB00, 0), (0x20000, 14))
N_SCRIPTS = 15
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters, one byte each; made once for each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000))
    return _LETTERS[0]


@dataclass
class Words:
    """The words of a batch of texts, and the n-grams of all words with the word each belongs to."""

    owner: np.ndarray  # text of each word
    letters: np.ndarray  # letters of each word
    script: np.ndarray  # script of each word
    starts: np.ndarray  # code point positions in the batch
    grams: list[tuple[np.ndarray, np.ndarray]]  # (word, bucket) for each length


def words_of(texts: list[str | None]) -> Words:
    """Words are runs of letters, lower-cased; n-grams run over a word with one blank on either side."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n\n".join(lower) + "\n\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = 1 + np.cumsum([0, *[len(t) + 2 for t in lower]])
    codes = np.where(_letters()[codes], codes, 0)
    edge = np.diff((codes != 0).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    owner = np.searchsorted(bounds, starts, "right") - 1
    where = np.fromiter((s for s, _ in SCRIPTS), np.int64)
    script = np.fromiter((s for _, s in SCRIPTS), np.int64)[np.searchsorted(where, codes[starts], "right") - 1]
    sizes = ends - starts
    grams, wide = [], codes.astype(np.uint64)
    for n in GRAMS:
        count = np.maximum(sizes + 3 - n, 0)  # windows from the blank before to the blank behind
        word = np.repeat(np.arange(len(starts)), count)
        first = np.repeat(starts - 1 - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        value = np.full(len(first), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + wide[first + k]
        grams.append((word, (mixed_bits(value) & np.uint64(BUCKETS - 1)).astype(np.int64)))
    return Words(owner, sizes, script, starts, grams)


@dataclass
class Model:
    """languages, log-probabilities [buckets, languages], candidates [scripts, languages], the most frequent language."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray
    commonest: int

    def word_scores(self, words: Words) -> np.ndarray:
        """[words, languages]; a language that is no candidate is far below the others, a word without candidates is neutral."""
        n, out = len(words.owner), np.zeros((len(words.owner), len(self.languages)), np.float32)
        for word, bucket in words.grams:
            if len(word):
                first = np.flatnonzero(np.diff(word, prepend=-1))
                out[word[first]] += np.add.reduceat(self.scores[bucket], first)
        allowed = self.candidates[words.script] if n else np.zeros((0, len(self.languages)), bool)
        known = allowed.any(1)
        out = np.where(allowed, out, -1e4)
        out[~known] = 0
        return out - out.max(1, keepdims=True, initial=-1e9) if n else out


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the path with the largest sum of scores less ``switch`` for each change.

    One language throughout is best if no run of words gains more than half a switch over it: a path leaves it and comes back for two
    switches at most a run, or one at an end, however many languages the run goes through. That is tested first, over the best
    word by word. Of equal paths the one that leaves a language later wins, and of equal languages the first.
    """
    best = int(scores.sum(0).argmax())
    # A run away from the best language, through any others, gains no more than its words' best scores do, and costs a switch at least.
    gained = np.cumsum(scores.max(1) - scores[:, best], dtype=np.float64)
    if not len(scores) or gained[-1] <= switch:
        return np.full(len(scores), best)
    gained = np.cumsum(scores - scores[:, best : best + 1], 0, dtype=np.float64)
    least = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gained[:-1]]), 0)
    if 2 * (gained - least).max() <= switch:
        return np.full(len(scores), best)
    leaders, since = _forward(scores.astype(np.float64), switch)
    path, end, k = np.empty(len(scores), np.int64), len(scores) - 1, int(leaders[-1])
    while end >= 0:  # back to where the language's path last came from the leader
        first = since[end, k]
        path[first : end + 1] = k
        end, k = first - 1, int(leaders[first - 1])
    return path


#: Words that a stretch under one leader tries at first.
STRETCH = 128


def _forward(rows: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """The language with the largest sum after each word, and for each word and language where that language's path was last entered.

    While one language leads, each other's distance behind it is a walk that falls no lower than ``switch`` (there its path is entered from
    the leader's): the sum of differences less its least so far. So a stretch under one leader is a few array operations.
    """
    n, every = len(rows), np.arange(rows.shape[1])
    leaders, entered = np.empty(n, np.int64), np.zeros(rows.shape, np.int64)
    lead, size, at = int(rows[0].argmax()), STRETCH, 1
    leaders[0], behind = lead, rows[0] - rows[0, lead]
    while at < n:
        part = rows[at : at + size]
        sums = np.cumsum(part - part[:, lead, None], 0)
        least = np.minimum.accumulate(np.vstack([-np.maximum(behind + switch, 0), sums]), 0)
        held = sums - least[:-1] - switch  # distances after each word
        before = np.vstack([behind, held[:-1]])
        over = (held > 0) | ((held == 0) & (every < lead))
        lost = over.any(1)
        took = int(lost.argmax()) + 1 if lost.any() else len(part)
        places = np.arange(at, at + took)
        entered[places] = np.where(before[:took] < -switch, places[:, None], 0)
        leaders[places] = lead
        behind, at, size = held[took - 1], at + took, size * 2
        if lost.any():
            lead, size = int(behind.argmax()), STRETCH
            leaders[at - 1], behind = lead, behind - behind[lead]
    return leaders, np.maximum.accumulate(entered, 0)


def held_out_of(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is held out of nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(rows: DataFrame) -> Model:
    """A model of ``rows`` (text, lang), all of them: n-gram and script counts for each language, summed by Spark.

    Null and empty texts count for no n-gram, repeated rows each count, no rows give a model without languages; other columns are not
    read. ``lang`` must not be null. Each task counts in fixed tables and gives what is not zero; the driver gets ``BUCKETS`` counts for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in sliced(batches, column=0, rows=500, size=1_000_000):
            words, langs = words_of(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                table = tables.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS + 1, np.int64))
                own = (langs == lang)[words.owner]
                for word, bucket in words.grams:
                    table[:BUCKETS] += np.bincount(bucket[own[word]], minlength=BUCKETS)
                table[BUCKETS:-1] += np.bincount(words.script[own], words.letters[own], N_SCRIPTS).astype(np.int64)
                table[-1] += int((langs == lang).sum())
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], names=["lang", "cell", "n"])

    counted = map_arrow(rows.select("text", "lang"), count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = counted.toArrow().to_pandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS + N_SCRIPTS + 1, len(languages)))
    counts[table["cell"], np.searchsorted(languages, table["lang"]) if languages else []] = table["n"]
    grams, scripts = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS:-1]
    share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
    return Model(languages, np.log(grams / grams.sum(0, keepdims=True)).astype(np.float32), share > RARE, int(counts[-1].argmax()) if languages else 0)


def label_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row of ``docs``.

    score is the share of the text's letters that the path gives to lang_pred; spans are (from word, words, lang) in text
    order. Edge cases: null texts and texts without letters are ``und`` with score 0 and no spans; letters of scripts
    that no language was learned in leave the most frequent language, with score 0; without any learned language all is ``und``;
    very long texts are labelled whole; repeated rows and null ids are kept; an empty table gives an empty result;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches, rows=500, size=1_000_000):
            words = words_of(batch.column(1).to_pylist())
            scores, bounds = own.word_scores(words), np.searchsorted(words.owner, np.arange(len(batch) + 1))
            rows = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b or not own.languages:
                    rows.append(("und", 0.0, []))
                    continue
                path, letters = best_path(scores[a:b], switch), words.letters[a:b]
                known = scores[a:b].min(1) < 0 if len(own.languages) > 1 else own.candidates[words.script[a:b], 0]
                weight = np.bincount(path[known], letters[known], len(own.languages))
                best = int(weight.argmax()) if weight.any() else own.commonest
                cuts = np.flatnonzero(np.diff(path, prepend=-1))
                spans = [{"first": int(i), "words": int(n), "lang": own.languages[path[i]]} for i, n in zip(cuts, np.diff(np.append(cuts, b - a)), strict=True)]
                rows.append((own.languages[best], float(weight[best] / letters.sum()), spans))
            lang, score, spans = zip(*rows, strict=True)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, label, "doc_id long, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>")
