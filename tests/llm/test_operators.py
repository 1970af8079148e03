"""The ten operators against brute force, and their edge cases: nulls, empty texts and tables, ties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries as registered
from lectern.llm.common import counted_join, maybe_among, salted_join, scratch_path, written
from lectern.llm.components import components
from lectern.llm.exact_dedup import block_identities, drop_exact_duplicates, exact_duplicates
from lectern.llm.html_main import Page, main_texts, site_templates
from lectern.llm.langid import best_path, held_out_of, label_languages, learn
from lectern.llm.mixing import mix, mixed_rows, source_targets
from lectern.llm.ngram_join import Join, announced, drop_near_duplicates, jaccard_components, linked
from lectern.llm.shingles import shingle_sets
from lectern.llm.telephony import adpcm_samples, alaw_table, encode_media, media_features, mulaw_table, resampled, wav_codes, wav_file, write_pcm
from lectern.llm.token_store import _crc_tables, chunk_ends, combined_crcs, merkle_root, mixed_bits, read_documents, read_index, streams_ends, verified_documents, write_store
from lectern.llm.toxicity import BlockIndex, Bounds, drop_toxic, score_toxicity
from lectern.llm.url_filter import PRIOR, PRIOR_BRANCHES, PRIOR_ROWS, judge_urls, template_purity
from lectern.llm.word_bpe import bpe_round_trip, loaded

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, **more):
    """Rows with ids from 0, and columns whose names operators use for their own."""
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)], SCHEMA)
    return df.withColumns({n: F.lit(1) for n in ("row", "n", "key", "size", "kept", "keep_id", "name", "level", "score", "taken", "copies", "set", "links", "_salt", "maybe", "label", "host", "page", "terms", "counts", "start")} | more)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tokenizer(name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(name)


LONG = " ".join(f"word{i % 977} x{i}" for i in range(20_000))
TEXTS = ["Hello world again", "hello WORLD again", None, "", "Éa", "éa", LONG, LONG, "x" * 9000, "x" * 9001, " ", "a  b \n\n c\td"]


# 1: token store


def test_token_store(spark, sf_dir):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [*TEXTS, "a<|endoftext|>b <|endoftext|>", "tabs\tand\r\nbreaks \n x", "don't we'll \u00a0x ½ Ⅷ", "ends \n"]
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    docs, folder = documents(spark, texts), scratch_path(spark, "test-store")
    write_store(docs, folder, path)
    start, got = 0, {r["doc_id"]: r for r in verified_documents(spark, folder).collect()}
    read = {r["doc_id"]: r["ids"] for r in read_documents(spark, folder).collect()}
    for i in range(len(texts)):
        crc = zlib.crc32(np.array(ids[i], "<u4").tobytes())
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["verified"]) == (start, len(ids[i]), crc, True)
        assert list(read[i]) == ids[i]
        start += len(ids[i])
    chunks = spark.read.parquet(f"{folder}/objects").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    nodes = spark.read.parquet(f"{folder}/manifest").collect()
    roots = [r["root"] for r in read_index(spark, folder).orderBy("place").collect()]
    assert [(n["documents"], n["tokens"], bytes(n["root"])) for n in nodes] == [(len(texts), start, merkle_root(list(map(bytes, roots))))]


def test_token_store_of_nothing(spark):
    folder = scratch_path(spark, "test-store")
    write_store(empty(spark), folder, tokenizer("byte_bpe_50k.json"))
    assert verified_documents(spark, folder).count() == 0


def test_token_store_repeated_and_null_ids(spark):
    folder = scratch_path(spark, "test-store")
    rows = spark.createDataFrame([(1, "b"), (1, "b"), (None, "a"), (1, "c")], "doc_id long, text string")
    write_store(rows, folder, tokenizer("byte_bpe_50k.json"))
    got = sorted((r["start"], r["doc_id"], r["verified"]) for r in verified_documents(spark, folder).collect())
    assert [g[0] for g in got] == [0, 2, 4, 6] and got[0][1] is None and all(g[2] for g in got)


@pytest.mark.parametrize("damage", ["chunk gone", "chunk altered", "index altered", "manifest gone", "manifest altered", "top altered"])
def test_token_store_detects_damage(spark, monkeypatch, tmp_path, damage):
    """Every document stays in the result; those that the damage touches are not verified."""
    from lectern.llm import token_store

    monkeypatch.setattr(token_store, "FAN", 3)
    texts = [f"text number {i} " * 40 for i in range(10)]
    folder = str(tmp_path / "store")
    write_store(documents(spark, texts), folder, tokenizer("byte_bpe_50k.json"))
    assert all(r["verified"] for r in verified_documents(spark, folder).collect())

    def rewrite(name, change, by=None):
        kept = str(tmp_path / f"new-{name}")
        change(spark.read.parquet(f"{folder}/{name}")).write.partitionBy(*([by] if by else [])).parquet(kept)
        (tmp_path / "store" / name).rename(tmp_path / f"old-{name}")
        (tmp_path / f"new-{name}").rename(tmp_path / "store" / name)

    first = bytes(read_index(spark, folder).filter("doc_id = 4").first()["recipe"])[:32]
    sharing = {r["doc_id"] for r in read_index(spark, folder).collect() if first in [bytes(r["recipe"])[k : k + 32] for k in range(0, len(r["recipe"]), 32)]}
    if damage == "chunk gone":
        rewrite("objects", lambda d: d.filter(F.col("key") != F.lit(first)), "kind")
        want = sharing
    elif damage == "chunk altered":
        rewrite("objects", lambda d: d.withColumn("data", F.when(F.col("key") == F.lit(first), F.unhex(F.concat(F.lit("0001"), F.substring(F.hex("data"), 5, 9999)))).otherwise(F.col("data"))), "kind")
        want = sharing
    elif damage == "index altered":
        rewrite("index", lambda d: d.withColumn("n_tokens", F.when(F.col("doc_id") == 4, 7).otherwise(F.col("n_tokens"))))
        want = {3, 4, 5}
    elif damage == "manifest gone":
        (tmp_path / "store" / "manifest").rename(tmp_path / "gone")
        want = set(range(10))
    elif damage == "manifest altered":
        rewrite("manifest", lambda d: d.withColumn("root", F.when((F.col("level") == 0) & (F.col("place") == 1), F.lit(b"x")).otherwise(F.col("root"))))
        want = {3, 4, 5}
    else:
        rewrite("manifest", lambda d: d.withColumn("tokens", F.when(F.col("level") == 2, 1).otherwise(F.col("tokens"))))
        want = set(range(10))
    got = verified_documents(spark, folder).collect()
    assert len(got) == 10 and {r["doc_id"] for r in got if not r["verified"]} == want
    read = {r["doc_id"]: r["ids"] for r in read_documents(spark, folder).collect()}
    assert len(read) == 10 and (damage != "chunk gone" or {i for i, x in read.items() if x is None} == want)


def test_chunks_and_checksums():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 30_000).astype(np.int32)
    ends = chunk_ends(ids)
    assert ends[-1] == len(ids) and ends == sorted(set(ends))
    moved = chunk_ends(np.concatenate([ids[:100], ids]))
    assert len({e - 100 for e in moved} & set(ends)) > 0.9 * len(ends)
    # Window by window, and many streams at once, of which some are empty, short or without a cut.
    g = [int(x) for x in mixed_bits(ids[:3000])]
    wanted = {i + 1 for i in range(3000) if sum(g[i - k] << 4 * k for k in range(min(16, i + 1))) % 2**64 >> 56 == 0}
    assert set(chunk_ends(ids[:3000])[:-1]) <= wanted
    streams = [ids[:0], ids[:10], ids[:64], ids[:65], ids[5:5000], np.full(5000, 7), ids[5:5000], ids[:1]]
    bounds = np.cumsum([0, *map(len, streams)])
    assert streams_ends(np.concatenate(streams), bounds) == [chunk_ends(s) for s in streams]
    parts = [rng.bytes(n) for n in (4, 400, 8, 1000, 64)]
    crcs, sizes = np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([len(p) for p in parts])
    assert combined_crcs(crcs, sizes, np.array([0, 2, 5]), _crc_tables()).tolist() == [zlib.crc32(b"".join(parts[:2])), zlib.crc32(b"".join(parts[2:]))]


# 2: telephony


def test_telephony_round_trip(spark, tmp_path):
    docs = documents(spark, TEXTS)
    rows = {}
    for codec in (None, "mulaw", "alaw", "ima_adpcm"):
        rows = {r["doc_id"]: r for r in media_features(encode_media(docs, codec=codec)).collect()}
        for i, t in enumerate(TEXTS):
            raw = (t or "").encode()
            payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert rows[i]["tail_crc32"] == zlib.crc32(payload[-64:])
        assert rows[2]["feature"] == rows[3]["feature"] and rows[6]["media_sha256"] == rows[7]["media_sha256"]
    assert media_features(encode_media(empty(spark))).count() == 0
    broken = spark.createDataFrame([(1, 0, bytearray(b"RIFF")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert {r["feature"] for r in media_features(broken).collect()} == {"unreadable"}
    write_pcm(encode_media(docs, codec="mulaw").unionByName(broken.select("doc_id", "n_bytes", "media")), str(tmp_path / "pcm"))
    stored = spark.read.parquet(str(tmp_path / "pcm"))
    assert stored.count() == len(TEXTS) + 2 and stored.filter("octet_length(pcm) = 64 * 2 * 2").count() >= 2


def test_g711_tables():
    mu, a = mulaw_table().astype(int), alaw_table().astype(int)
    assert (mu[0x80], mu[0x00], mu[0xFF], mu[0x7F]) == (32124, -32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu)) == 255 and len(set(a)) == 256


def test_adpcm_by_one_block_at_a_time():
    from lectern.llm.telephony import INDEX_MOVES, ima_steps

    def slow(block):
        value = int.from_bytes(block[:2], "little", signed=True)
        index, steps, out = min(block[2], 88), ima_steps().tolist(), [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = steps[index]
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value + (-diff if code & 8 else diff)))
                index = max(0, min(88, index + int(INDEX_MOVES[code & 7])))
                out.append(value)
        return out

    blocks = np.random.default_rng(2).integers(0, 256, (20, 64), np.uint8)
    assert adpcm_samples(blocks).tolist() == [slow(bytes(b)) for b in blocks]


def test_resampling_keeps_a_tone():
    t = np.arange(800)
    tone = np.rint(10_000 * np.sin(2 * np.pi * 200 * t / 8000)).astype(np.int16)
    up = resampled([tone, tone[:3], np.zeros(0, np.int16)], 2)
    assert [len(u) for u in up] == [1600, 6, 0]
    want = 10_000 * np.sin(2 * np.pi * 200 * np.arange(1600) / 16000)
    assert np.abs(up[0][20:-20] - want[20:-20]).max() < 150
    assert (up[0][::2] == tone).all()
    assert wav_codes(wav_file("alaw", b"abc"))[3] == b"abc"


# 3: n-gram join


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        ws = WORD.findall(lower(t))
        sets.append({tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else {tuple(ws)} if ws else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
            if sets[i] != sets[j]:
                links[i].add(frozenset(sets[j]))
                links[j].add(frozenset(sets[i]))
    return {i: (len(sets[i]), root(i), len(links[i])) for i in range(len(texts))}


def near_copies(seed, n=60):
    rng = random.Random(seed)
    passage = [f"common{i}" for i in range(40)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            ws = rng.choice(texts).split()
            for _ in range(rng.choice((0, 1, 1, 2, 4, 8))):
                k = rng.randrange(max(1, len(ws)))
                ws[k : k + 1] = rng.choice((([] if len(ws) > 1 else ws), [f"new{rng.randrange(99999)}"], [*ws[k : k + 1], f"new{rng.randrange(99999)}"]))
            texts.append(" ".join(ws) or "x")
        else:
            ws = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 5, 20, 60, 150, 400)))]
            texts.append(" ".join(ws + (passage if rng.random() < 0.5 else [])))
    return texts


@pytest.mark.parametrize("seed, words, percent", [(1, 4, 85), (2, 5, 80), (3, 4, 85), (4, 2, 60)])
def test_ngram_join(spark, seed, words, percent):
    texts = [*near_copies(seed), None, "", "a b", "A b", "  \n"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["links"]) for r in jaccard_components(documents(spark, texts), Join(words, percent)).collect()}
    assert got == brute_components(texts, words, percent)


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A large cluster, cut into many blocks, gives what one block gives."""
    from lectern.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 500)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        ws = base[:]
        for _ in range(rng.randrange(6)):
            ws[rng.randrange(len(ws))] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(ws))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["links"]) for r in jaccard_components(documents(spark, texts)).collect()}
    assert got == brute_components(texts, 4, 85)


def test_linked_sets_announce_a_common_fragment():
    rng, join = random.Random(7), Join(4, 85)
    for _ in range(300):
        n = rng.choice((8, 12, 20, 60, 200, 1000))
        one = [rng.getrandbits(64) for _ in range(n)]
        two = one[rng.randrange(0, max(1, n // 14) + 1) :] + [rng.getrandbits(64) for _ in range(rng.randrange(0, max(1, n // 14) + 1))]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (one, two))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both) or both == len(a) == len(b):
            continue
        large = join.size_class(max(len(a), len(b)))
        marks = [{c: (need, set(m.tolist())) for c, need, m in announced(s, join)} for s in (a, b)]
        shared = len(marks[0][large][1] & marks[1][large][1])
        assert shared >= max(marks[0][large][0], marks[1][large][0])


def test_linked_counts(monkeypatch):
    from lectern.llm import ngram_join

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, 40)).astype(np.uint64) for _ in range(30)]
    want = [[100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b)) for b in sets] for a in sets]
    for rare in (0, 64, 10**9):
        monkeypatch.setattr(ngram_join, "RARE_PAIRS", rare)
        assert linked(sets, sets, 60).tolist() == want


def test_near_duplicates_leave_one(spark):
    texts = near_copies(9)
    want = {v[1] for v in brute_components(texts, 5, 80).values()}
    kept = drop_near_duplicates(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and "keep_id" in kept.columns
    assert drop_near_duplicates(empty(spark)).count() == 0 and jaccard_components(empty(spark)).count() == 0


def test_near_duplicates_go_by_row(spark):
    """Ids that repeat or are null: rows are told apart by id and text."""
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base + " x", " ".join(f"o{i}" for i in range(60))
    rows = [(1, base), (3, near), (3, "a text of its own that stays as it is"), (7, other), (7, other + " y"), (None, other + " z"), (None, base + " v"), (None, None), (1, base), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"set": F.lit(1), "__x": F.lit(2)}).repartition(3)
    kept = drop_near_duplicates(docs)
    got = sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()]))
    sevens = min((other, other + " y"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert kept.columns == docs.columns and got == sorted(map(str, [(1, base), rows[2], (7, sevens), (None, None), (9, "")]))
    nulls = spark.createDataFrame([(None, base), (None, near), (None, base)], "doc_id long, text string")
    assert drop_near_duplicates(nulls).count() == 1


def test_shingles():
    sets = shingle_sets(["A b c d e", "a B c D", "a b", None, "é b c d"], 4)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 1] and sets[1][0] in sets[0] and sets[4][0] != sets[1][0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(30)]
    near = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(near[a], near[b])
            changed |= near[a] != m or near[b] != m
            near[a] = near[b] = m
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in near.items() if any(a != b for a, b in edges if n in (a, b))}


# 4: language identification


def test_languages(spark):
    from lectern.llm.langid import Model

    english = ["the weather is nice and the children are playing with their dog in the garden " * 3] * 6
    german = ["das wetter ist schön und die kinder spielen mit ihrem hund im garten hinter dem haus " * 3] * 6
    russian = ["погода хорошая и дети играют с собакой в саду за домом " * 3] * 6
    rows = [(t, lang) for texts, lang in ((english, "en"), (german, "de"), (russian, "ru")) for t in texts]
    model = learn(spark.createDataFrame(rows, "text string, lang string"))
    assert isinstance(model, Model) and model.languages == ["de", "en", "ru"]
    texts = ["the children play in the garden", "die kinder spielen im garten", "дети играют", None, "", "123 !!", "the weather is nice and the dog is playing in the garden with the children. das wetter ist schön und die kinder spielen mit dem hund", "漢字", english[0] * 200]
    got = {r["doc_id"]: r for r in label_languages(documents(spark, texts), model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["en", "de", "ru", "und", "und", "und"]
    assert [s["lang"] for s in got[6]["spans"]] == ["en", "de"] and 0 < got[6]["score"] < 1
    assert got[7]["lang_pred"] in model.languages and got[7]["score"] == 0 and got[8]["lang_pred"] == "en" and got[0]["score"] == 1
    assert label_languages(empty(spark), model).count() == 0
    nothing = learn(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in label_languages(documents(spark, ["abc"]), nothing).collect()} == {"und"}


def test_best_path_is_best():
    rng = np.random.default_rng(4)
    for _ in range(60):
        scores = (rng.normal(size=(7, 3)) * 3).astype(np.float32)
        value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        most = max(value(p) for p in itertools.product(range(3), repeat=7))
        assert abs(value(best_path(scores, 4.0).tolist()) - most) < 1e-3


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = registered.op4_language_id(spark, sf_dir).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


# 5: exact dedup


def test_exact_duplicates(spark):
    got = {r["doc_id"]: r for r in exact_duplicates(documents(spark, TEXTS), block_chars=64).collect()}
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(lower(t), []).append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = drop_exact_duplicates(documents(spark, TEXTS), block_chars=64)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(i) for i in groups.values()) and "taken" in kept.columns
    assert exact_duplicates(empty(spark)).count() == 0 and drop_exact_duplicates(empty(spark)).count() == 0


def test_exact_duplicates_of_a_hot_group(spark):
    """A group above the bound from which blocks and pairs are joined salted, over more partitions than it has blocks."""
    texts = ["abc" * 70 if i % 3 == 0 else f"{i}" * 40 + "abc" * 30 if i % 3 == 1 else f"{i // 6} tail" for i in range(6000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(21)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_duplicates(rows, block_chars=64).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(i)
    assert got == {i: (max(ids), len(ids)) for ids in groups.values() for i in ids}


def test_counted_join_spreads_hot_keys(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    facts = rows.groupBy("key").agg(F.count("*").alias("items"), F.max("id").alias("last"))
    got = counted_join(rows, facts, ["key"], F.col("id"), "items", hot=100)
    assert sorted(got.columns) == ["id", "items", "key", "last"]
    want = {i: (2000, 5997) if i % 3 == 0 else (1, i) for i in range(6000)}
    assert {r["id"]: (r["items"], r["last"]) for r in got.collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = counted_join(rows, facts, ["key"], F.col("id"), "items", hot=100)
        largest = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert largest < 2000


def test_exact_duplicates_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "B"), (2, "c")], "doc_id long, text string")
    got = exact_duplicates(rows)
    assert got.count() == 6 and got.filter("kept").count() == 5
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in drop_exact_duplicates(rows).collect()) == [(0, "b"), (1, "a"), (2, "c")]


def test_block_names_are_identities(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r["row"]: (r["level"], r["name"]) for r in block_identities(rows, block_chars=1).collect()}
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (got[i] == got[j]) == (texts[i] == texts[j])


# 6: mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing again and again, until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return {s: float(v) for s, v in full.items()}
        each = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if each[s] > most * sizes[s]]
        if not over:
            return {**{s: float(v) for s, v in full.items()}, **each}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1}, {"a": 0, "b": 7, None: 30, "d": 900}, {"x": 5}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), "en", None if i % 11 == 0 else f"s{i % 5}", 0) for i in range(400)] + [(400, None, "en", "s1", 0), (401, "", None, None, 0)]
    rows += [rows[5]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("size", "key", "bin", "target", "_none", "_copies", "copies")})
    quality = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    got = mix(docs, quality).collect()
    assert len(got) == len(rows)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
    again = {(r["doc_id"], r["taken"]) for r in mix(docs.repartition(7), quality).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    out = mixed_rows(docs, quality)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mix(empty(spark)).count() == 0 and mixed_rows(empty(spark)).count() == 0


@pytest.mark.parametrize("ids", ["null", "equal", "text"])
def test_tied_rows_keep_the_budget(spark, ids):
    """Rows that tie, by null ids or as copies, are taken one by one up to the target."""
    rows = [({"null": None, "equal": 7, "text": None}[ids], f"w {i} " * 10 if ids == "text" else "w " * 20, "en", "a", i) for i in range(400)]
    rows += [(1000 + i, "v " * 3, "en", "b", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, out = mix(docs).collect(), mixed_rows(docs).collect()
    for source, size in (("a", 20), ("b", 3)):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size
        assert sum(len(WORD.findall(r["text"])) for r in out if r["source"] == source) == sum(r["taken"] for r in own)


def test_bins_stay_small(spark):
    """Whatever the weights, no bin of keys holds much of a source."""
    from lectern.llm.mixing import _keyed

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("a").alias("source"))
    for weight in (0.05, 1.0, 2.0):
        keyed = _keyed(docs, F.lit(weight), "mix")
        assert keyed.groupBy("__mix_bin").count().agg(F.max("count")).first()[0] < 120


def test_quality_weights_count(spark):
    rows = [(i, "w " * 10, "en", "abc"[i % 3], 0) for i in range(6000)]
    quality = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(6000)], "doc_id long, quality int")
    got = [r for r in mix(spark.createDataFrame(rows, SCHEMA), quality).collect() if r["source"] == "c"]
    taken = [sum(r["copies"] for r in got if r["doc_id"] % 2 == q) for q in (0, 1)]
    assert taken[0] > 1.3 * taken[1] > 0  # five of six documents are taken in all


# 7: HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body><header>top</header><nav><ul><li>menu</ul></nav><div class="cookie-notice">cookies</div><aside>side</aside>
<article><h1>Head &amp; more</h1><p>One <b>bo</b>ld<br>line<p>Two &eacute; 1 &lt; 2<script>if (a<b) x("</p>")</script><form><input>send</form><ul><li>x<li>y</ul><div class="comments"><p>me too</p></div></article><footer>foot</footer>"""


def test_page():
    assert Page(PAGE).main_text() == "Head & more One bold line Two é 1 < 2 x y"
    assert Page("<p>no article<p>here").main_text() == "no article here"
    for broken in ("", "<", "<p", "<!-- x", "<script>", "</b></p>", "<a href='x>y</a>", "<article>" * 3000 + "deep", "&#xZZ; &#99999999;", "<td>a<tr>b"):
        Page(broken).main_text()
        Page(broken).templates()
    assert Page("<article>" * 3000 + "deep").main_text() == "deep"


def test_site_templates(spark):
    promo = "<section><h3>Read our paper</h3><p>Every day</p></section>"
    pages = [(i, "http://h.org/x", f"<body><article><p>Story {i}</p><p>Shared passage</p>{promo}</article></body>") for i in range(12)]
    pages += [(100 + i, "http://other.org/x", f"<body><article><p>Tale {i}</p>{promo if i < 2 else ''}</article></body>") for i in range(12)]
    pages += [(200 + i, "http://copy.org/", f"<body><article><p>Same</p>{promo}</article></body>") for i in range(30)]
    pages += [(300, None, None), (301, "x", ""), (302, "http://h.org/y", PAGE), (3, "http://h.org/x", pages[3][2]), (None, "http://h.org/x", pages[3][2])]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("host", "text", "page", "element", "elements", "_salt", "row", "subtree")})
    for most in (10**6, 0):  # templates broadcast, and joined
        rows = main_texts(docs, broadcast=most).collect()
        got = {r["page_id"]: r for r in rows}
        assert len(rows) == len(pages) and sum(r["text"] == "Story 3 Shared passage" for r in rows) == 3
        assert got[3]["text"] == "Story 3 Shared passage" and got[3]["n_chars"] == len(got[3]["text"]) and got[3]["removed"] == 1
        assert got[101]["text"] == "Tale 1 Read our paper Every day" and got[205]["text"] == "Same Read our paper Every day"
        assert (got[300]["text"], got[301]["text"], got[300]["n_chars"]) == ("", "", 0) and got[302]["text"].startswith("Head & more")
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def site(n=20):
    """Pages with neutral names: what is template shows by recurrence only. Menus, dates and teasers change from page to page."""
    rng = random.Random(1)
    words = lambda k: " ".join(f"w{rng.randrange(9999)}" for _ in range(k))
    for i in range(n):
        menu = "".join(f'<li><a href="/{rng.random()}">{words(1)}</a></li>' for _ in range(rng.randrange(3, 7)))
        story = "".join(f"<p>{words(rng.randrange(20, 60))}</p>" for _ in range(rng.randrange(2, 6)))
        yield i, f"http://n.org/{i}", f'<body><div class="x1"><ul>{menu}</ul></div><div class="x2"><h1>{words(4)}</h1>{story}<div><p>{words(9)}</p></div></div><div class="x3"><p>{words(6)}</p></div></body>'


def test_recurrence_alone_finds_templates(spark):
    pages = list(site())
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    for by_name in (True, False):
        for r in main_texts(rows, by_name=by_name).collect():
            middle = pages[r["page_id"]][2].split('<div class="x2">')[1].split('<div class="x3">')[0]
            assert r["text"] == " ".join(re.sub("<[^>]*>", " ", middle).split()) and r["removed"] == 3
    few = main_texts(rows.filter("page_id < 2")).collect()
    assert all(r["removed"] == 0 and len(r["text"].split()) > 40 for r in few)


def test_templates_by_brute_force(spark):
    """Digests counted by dictionaries over pages of different content, and Wilson's bound by its formula."""
    pages = [*site(12), *[(50 + i, f"http://m.org/{i}", f"<body><div>menu {i % 3}</div><article><p>text {i}</p><div>again</div></article></body>") for i in range(9)]]
    seen, total = {}, {}
    for _, url, source in pages:
        host, page = url.split("/")[2], Page(source)
        total.setdefault(host, set()).add(page.main_text())
        for _, k in page.keyed(host):
            seen.setdefault((host, k), set()).add(page.main_text())
    want = set()
    for (host, k), texts in seen.items():
        n, m = len(texts), len(total[host])
        p, z = n / m, 9 / m
        if n > 1 and (p + z / 2 - 3 * (p * (1 - p) / m + z / (4 * m)) ** 0.5) / (1 + z) >= 0.2:
            want.add(k)
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.regexp_extract("url", "://([^/]*)", 1))
    assert {r["subtree"] for r in site_templates(rows).collect()} == want and len(want) >= 4


def test_article_parts_are_not_templates(spark):
    parts = "<p>H<sub>2</sub>O <code>None</code></p><table><tr><td>Yes</td></tr></table><ul><li>One</li></ul>"
    pages = [(i, "http://h.org/x", f"<body><article><p>Story {i}</p>{parts}</article></body>") for i in range(12)]
    named = "".join(f'<p class="{c}">{c}</p>' for c in ("alert", "search-results", "related-work", "share-of-votes")) + '<div class="comments">gone</div>'
    pages += [(20, "http://i.org/", f"<body><article><p>Story</p>{named}</article></body>")]
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[5] == "Story 5 H2O None Yes One" and got[20] == "Story alert search-results related-work share-of-votes"


# 8: URL filter


def slow_rule(host, path):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    found = [(len(r), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(found)[1:] if found else (None, None)


def test_urls(spark):
    urls = ["http://A.Example.COM/en/1?x#y", "https://www.example.com/en/", "http://x.net/es/1", "http://x.net/de/1", "http://net", "http://net/fr/", "ftp://com/?q", "http://com?x", None, "no scheme", "a://b://c/d", "http://example.com/EN/", "http://ex.com", "http://notcom/x", "http://x.net/es/1"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({n: F.lit(1) for n in ("host", "path", "shape", "template", "pages", "good", "_salt")})
    got = {r["page_id"]: r for r in judge_urls(rows).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        m = re.match(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        rule, verdict = slow_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert judge_urls(rows.limit(0)).count() == 0


def test_templates_learn_from_rules(spark):
    urls = [f"http://shop.net/es/{i}" for i in range(30)] + [f"http://shop.net/de/{i}" for i in range(30)] + [f"http://m.org/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/p" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in judge_urls(rows).collect()}
    assert got[3]["verdict"] == "block" and got[3]["purity"] < 0.5
    assert got[33]["verdict"] == "allow" and got[33]["template"] == "/de/#"
    assert got[70]["template"] == "/*/p"
    bad = [("block", "net/es/"), ("block", "net/fr/")]
    mixed = [f"http://a.net/{lang}/{i}" for lang in ("es", "fr") for i in range(20)]
    rows = spark.createDataFrame(list(enumerate(mixed)), "page_id long, url string")
    assert {r["template"] for r in judge_urls(rows, rules=bad).collect()} == {"/*/#"}


def test_deep_templates_learn_from_rules(spark):
    langs = ["es", "fr", *"ab cd ef gh ij kl mn op qr st uv wx".split()]
    urls = [f"http://a.net/{langs[i % 2] if i < 20 else langs[2 + i % 12]}/a/b/c/d/slug{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == 40 and {r["template"] for r in got} == {"/*/a/b/c/d/*"} and {r["verdict"] for r in got} == {"block"}


def brute_purity(tree):
    """Purity of each (host, template) by recursion over prefixes, with every level looked at; ``tree`` is {(host, template): (good, bad)}."""
    def share(rows):
        good, bad = sum(g for g, _ in rows), sum(b for _, b in rows)
        return good / (good + bad) if good + bad else None

    def drawn(own, others, expected):
        others = [s for s in others if s is not None]
        return (sum(others) + PRIOR_BRANCHES * expected) / (len(others) + PRIOR_BRANCHES)

    out = {}
    for (host, template), own in tree.items():
        expected = PRIOR
        for depth in range(len(template)):
            siblings = {}
            for (h, t), labels in tree.items():
                if h == host and t[:depth] == template[:depth]:
                    siblings.setdefault(t[depth : depth + 1], []).append(labels)
            expected = drawn(None, [share(v) for k, v in siblings.items() if k != template[depth : depth + 1] and k], expected) if len(siblings) > 1 else expected
        if any(s not in ("*", "#") for s in template):
            expected = drawn(None, [share([v]) for (h, t), v in tree.items() if t == template and h != host], expected)
        out[host, template] = (own[0] + PRIOR_ROWS * expected) / (sum(own) + PRIOR_ROWS)
    return out


def test_purity_by_brute_force(spark):
    rng, tree = random.Random(5), {}
    for _ in range(120):
        template = tuple(rng.choice(["en", "de", "*", "#", "a"]) for _ in range(rng.randrange(1, 5)))
        tree[f"h{rng.randrange(6)}", template] = rng.choice([(0, 0), (0, 0), (3, 0), (0, 5), (2, 1)])
    rows = spark.createDataFrame([(h, list(t), g, b) for (h, t), (g, b) in tree.items()], "host string, template array<string>, good long, bad long").repartition(3)
    got = {(r["host"], tuple(r["template"])): r["purity"] for r in template_purity(rows).collect()}
    want = brute_purity(tree)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_labels_reach_other_hosts(spark):
    """Hosts without labels: a template that is blocked elsewhere is blocked, any other allowed; very long paths are compared whole."""
    urls = [f"http://h{h}.example.com/{lang}/{i}" for h in range(8) for lang in ("en", "de") for i in range(6)] + [f"http://free.org/{lang}/{i}" for lang in ("en", "de") for i in range(6)]
    urls += ["http://long.org/" + "/".join(["seg"] * 300) + end for end in ("/a", "/b")]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    verdicts = {(r["host"], r["path"].split("/")[1]): r["verdict"] for r in got}
    assert verdicts["free.org", "en"] == "block" and verdicts["free.org", "de"] == "allow" and verdicts["long.org", "seg"] == "allow"
    assert len({r["purity"] for r in got if r["host"] == "free.org"}) == 2


# 9: toxicity


def test_nearest_is_exact():
    rng = random.Random(2)
    weight = np.array([rng.uniform(0.1, 3) for _ in range(40)])
    examples = []
    for i in range(500):
        terms = np.array(sorted(rng.sample(range(40), rng.randrange(0, 6))), np.int64)
        examples.append((i, i % 2, terms, np.array([rng.randrange(1, 4) for _ in terms], np.int64)))
    for rare, _ in itertools.product((0.0, 0.06, 1.0), range(20)):
        index = BlockIndex(examples, weight, Bounds(block=16, neighbours=7, rare=rare))
        terms = np.array(sorted(rng.sample(range(40), rng.randrange(1, 6))), np.int64)
        unit = index.unit(terms, np.array([rng.randrange(1, 4) for _ in terms], np.int64))
        q = dict(zip(terms.tolist(), unit, strict=True))
        all_of = sorted((round(sum(q.get(t, 0) * w for t, w in zip(e[2].tolist(), index.unit(e[2], e[3]), strict=True)), 6) for e in examples if len(e[2])), reverse=True)
        found = index.nearest([(terms, unit)])[0]
        assert [round(s, 6) for s, _ in found] == [w for w in all_of[:7] if w > 0]
        assert found == sorted(found, key=lambda x: (-x[0], x[1]))
        assert [round(s, 6) for s, _ in index.nearest([(terms, unit)], below=0.8)[0]] == [w for w in all_of if 0 < w < 0.8][:7]


def brute_toxicity(texts, labels, bounds=Bounds()):
    """(log odds of the vote, ids of the neighbours) of each text by dictionaries over the whole vocabulary of the examples."""
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    tf = [{w: ws.count(w) for w in set(ws)} for ws in words]
    toxic, other = [[i for i, t in labels.items() if t == k] for k in (1, 0)]
    rate = len(toxic) / len(labels)
    weight = {}
    for w in {w for i in labels for w in tf[i]}:
        df, a, b = sum(w in x for x in tf), sum(w in tf[i] for i in toxic), sum(w in tf[i] for i in other)
        r = (a + bounds.smoothing * rate) / (b + bounds.smoothing * (1 - rate)) * (1 - rate) / rate
        weight[w] = (np.log((len(texts) + 1) / (df + 1)) + 1e-3) * np.log2(2 + r) ** 2

    def unit(x):
        v = {w: (1 + np.log(n)) * weight[w] for w, n in x.items() if w in weight}
        size = sum(c * c for c in v.values()) ** 0.5
        return {w: c / size for w, c in v.items()}

    base, units, out = (len(toxic) + 0.05) / (len(labels) + 1), [unit(x) for x in tf], []
    for u in units:
        near = sorted(((sum(c * units[i].get(w, 0) for w, c in u.items()), i) for i in labels), reverse=True)[: bounds.neighbours]
        total = sum(s for s, _ in near)
        share = (sum(s * labels[i] for s, i in near) + bounds.shrink * base) / (total + bounds.shrink)
        out.append((np.log(share / (1 - share)), [s for s, _ in near if s > 0]))
    return out


def toxic_texts(n=300):
    rng = random.Random(3)
    nice, bad = [f"nice{i}" for i in range(200)], ["idiotic", "moronic", "trashy"]
    texts, labels = [], {}
    for i in range(n):
        ws = rng.choices(nice, k=rng.randrange(8, 40))
        if i % 4 == 0:
            ws[3:5] = rng.sample(bad, 2)
        texts.append(" ".join(ws))
        if i % 5:
            labels[i] = int(i % 4 == 0)
    return texts, labels


def test_toxicity_by_brute_force(spark):
    """Votes over the whole vocabulary; the calibrated score is one rising curve over them, whatever the partitioning."""
    texts, labels = toxic_texts()
    texts += [None, "", "IDIOTIC moronic", "never seen", "nice1 " * 5000, texts[1], texts[1]]
    docs = documents(spark, texts).withColumn("embedding", F.lit("x"))
    known = spark.createDataFrame([(i, t, 1) for i, t in labels.items()] + [(None, 1, 1), (2, None, 1), (99999, 1, 1), (3, 7, 1), (4, 0, 1)], "doc_id long, toxic int, quality int")
    want, runs = brute_toxicity(texts, labels), []
    for parts in (1, 4, 8, 211):
        runs.append({r["doc_id"]: r for r in score_toxicity(docs.repartition(parts), known).collect()})
        assert [round(runs[-1][i]["score"], 9) for i in range(len(texts))] == [round(runs[0][i]["score"], 9) for i in range(len(texts))]
    got = runs[0]
    curve = [(got[i]["score"], w[0]) for i, w in enumerate(want)]
    odds = [np.log(s / (1 - s)) for s, _ in curve]
    slope, start = np.polyfit([w for _, w in curve], odds, 1)
    assert slope > 0 and max(abs(start + slope * w - o) for (_, w), o in zip(curve, odds, strict=True)) < 1e-5
    for i, (_, near) in enumerate(want):
        assert [e["similarity"] for e in got[i]["evidence"]] == pytest.approx([float(s) for s in near[:3]], abs=1e-8)
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(300)) and got[302]["predicted"] == 1
    assert got[300]["score"] == got[301]["score"] == got[303]["score"] < 0.5 and len({round(got[i]["score"], 9) for i in range(300)}) > 200


def test_toxicity_without_two_labels(spark):
    texts, labels = toxic_texts(40)
    docs = documents(spark, texts).repartition(4)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    for rows, rate in (([], 0.05), ([(i, 0) for i in labels], 0.05 / (len(labels) + 1)), ([(i, 1) for i in labels], (len(labels) + 0.05) / (len(labels) + 1))):
        assert {round(r["score"], 9) for r in score_toxicity(docs, frame(rows)).collect()} == {round(rate, 9)}
    assert score_toxicity(empty(spark), frame([(1, 1)])).count() == 0 and drop_toxic(empty(spark), frame([(1, 1)])).count() == 0
    some = score_toxicity(docs, frame(list(labels.items())), Bounds(examples=20)).collect()
    assert len(some) == 40


def test_drop_toxic_goes_by_row(spark):
    texts, labels = toxic_texts()
    rows = [*enumerate(texts), (None, "IDIOTIC moronic trashy"), (None, "nice1 nice2 nice3"), (1, "idiotic moronic trashy"), (1, texts[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(4)
    known = spark.createDataFrame([x for x in labels.items() if x[0] != 1], "doc_id long, toxic int")
    kept = drop_toxic(docs, known)
    assert kept.columns == docs.columns
    want = [r for r in rows if not ({"idiotic", "moronic", "trashy"} & set((r[1] or "").lower().split()))]
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(map(str, want))


def test_toxicity_held_out(spark, sf_dir):
    found = registered.op9_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("toxic = 0").collect()
    assert sum(r["predicted"] for r in found) <= 0.1 * len(found)


# 10: BPE


def test_word_bpe(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [*TEXTS, "ΑΣ Σ İstanbul", "foo<|endoftext|>bar <|startoftext|>", "a\x1cb c\x85d", "é x ́y", "don't I'LL", "日本語123４５½Ⅷ", "ab" * 5000, "😀😀 👍🏽"]
    got = {r["doc_id"]: r for r in bpe_round_trip(documents(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        want = plain.encode(t or "", add_special_tokens=False).ids
        assert list(got[i]["ids"]) == want
        assert got[i]["decoded"] == plain.decode(want, skip_special_tokens=False)
    assert bpe_round_trip(empty(spark), path).count() == 0


def test_word_bpe_classes():
    """Every code point is classed as the library does it, whatever Unicode version this interpreter has."""
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain, bpe = Tokenizer.from_file(path), loaded(path)
    points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    lines = [" ".join(f"{c}x7{c}!" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    for line, want in zip(lines, plain.encode_batch(lines, add_special_tokens=False), strict=True):
        assert bpe.encode_piece(line) == want.ids


def test_merges_agree():
    """The scan over ranks and the heap for long words give the same merges."""
    bpe, rng = loaded(tokenizer("word_bpe_49k.json")), random.Random(1)
    for _ in range(200):
        parts = [bpe.vocab[rng.choice("etaoinsh")] for _ in range(rng.randrange(2, 90))]
        assert bpe.merge(parts[:]) == bpe._merge_long(parts[:])


# What they share, and the registered queries


def test_salted_join_and_filter(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    facts = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert salted_join(rows, facts, ["k"], F.col("id"), salts=5).groupBy("v").count().collect().__len__() == 3
    assert maybe_among(rows, "id", facts.select(F.col("k").alias("id"))).filter("maybe").count() == 2


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    expected, df = con.sql(registered.oracle_sql()[name]), registered.queries()[name](spark, sf_dir)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_names():
    assert [re.match(r"op(\d+)_", n)[1] for n in registered.queries()] == [str(i) for i in range(1, 11)]
    assert json.dumps(sorted(registered.oracle_sql()))


def test_pipeline(spark, sf_dir):
    """Each stage against a brute-force version of it on the same input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, sf_dir)
        path = scratch_path(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name != "word_bpe":
            assert docs.columns == columns
        if name == "toxicity":  # the curve rises, so a cut in the brute-force votes parts what stays from what goes
            known = {}
            for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out_of(F.col("doc_id"), 5, 0)).collect():
                if r["doc_id"] is not None and r["toxic"] is not None:
                    known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["toxic"])
            before.sort(key=lambda r: r["doc_id"])
            place = {r["doc_id"]: i for i, r in enumerate(before)}
            votes = brute_toxicity([r["text"] for r in before], {place[i]: t for i, t in known.items() if i in place})
            stays = {r["doc_id"] for r in after}
            assert stays < set(place) and len(after) == len(stays)
            assert max(votes[place[i]][0] for i in stays) < min(votes[place[i]][0] for i in set(place) - stays)
        if name == "exact_dedup":
            last = {}
            for r in before:
                last[lower(r["text"])] = max(last.get(lower(r["text"]), -1), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(last.values())
        if name == "ngram_join":
            found = brute_components([r["text"] for r in sorted(before, key=lambda r: r["doc_id"])], 5, 80)
            ids = sorted(r["doc_id"] for r in before)
            assert sorted(r["doc_id"] for r in after) == sorted({ids[v[1]] for v in found.values()})
        if name == "source_mix":
            sizes = {}
            for r in before:
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
            want = water(sizes)
            for s in sizes:
                taken = sum(len(WORD.findall(r["text"])) for r in after if r["source"] == s)
                most = max(len(WORD.findall(r["text"] or "")) for r in before if r["source"] == s)
                assert abs(taken - want[s]) <= most
        if name == "word_bpe":
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
            want = [(r["doc_id"], plain.encode(r["text"] or "", add_special_tokens=False).ids) for r in before]
            assert sorted((r["doc_id"], list(r["ids"])) for r in after) == sorted(want) and all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_piece_table_is_bounded_by_bytes(monkeypatch):
    """Few pieces that are very long do not stay either, and pieces are found again as Arrow strings, the first of a text apart."""
    from lectern.llm import pieces

    monkeypatch.setattr(pieces, "HELD_BYTES", 10_000)
    asked = []

    def encode(new):
        asked.append(new.to_pylist())
        return np.array([len(p) for p in asked[-1]], np.int32), np.ones(len(new), np.int64)

    table = pieces.PieceTable(encode, limit=100)
    for texts in ([["ab", "c", "ab"], [], ["c"]], [["c", "ab"]], [["x" * 20_000]], [["ab"]]):
        ids, counts = table.lookup(pa.array(texts, pa.list_(pa.string())), mark=" ")
        assert counts.tolist() == [len(t) for t in texts] and ids.tolist() == [len(p) + (i == 0) for t in texts for i, p in enumerate(t)]
    assert asked == [[" ab", "c", "ab", " c"], [" " + "x" * 20_000], [" ab"]] and table.pieces.nbytes < 10_000


def test_word_bpe_merges_many_words_at_once():
    """Pieces of a batch as the library encodes each of them; words of every length as merged one by one."""
    from tokenizers import Tokenizer

    path, rng = tokenizer("word_bpe_49k.json"), random.Random(7)
    bpe, theirs = loaded(path), Tokenizer.from_file(path)
    signs = "eeeetttaoinshrdlu'’.,-0179éßΣσŉﬁ한語\u0301\u200b\t😀"
    pieces = ["".join(rng.choice(signs) for _ in range(rng.choice((0, 1, 2, 5, 9, 20, 40, 200)))) for _ in range(3000)] + ["<|endoftext|>", "a<|startoftext|>b!<|endoftext|>", "\u0301x", "ΑΣ"]
    ids, counts = bpe.encode_pieces(pa.array(pieces))
    ends = np.cumsum(counts)
    for piece, a, b in zip(pieces, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == theirs.encode(piece, add_special_tokens=False).ids, piece
    words = ["".join(rng.choice("etaoinsh") for _ in range(n)) for n in range(1, 130) for _ in range(5)]
    ids, counts = bpe.merge_words(pa.array(words))
    want = [bpe.merge([bpe.vocab[c] for c in w[:-1]] + [bpe.vocab[w[-1] + bpe.suffix]]) for w in words]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert bpe.encode_pieces(pa.array([""]))[1].tolist() == [0]


def test_counted_rows_need_no_bitmap(spark):
    """Rows that carry the count of their key say by themselves whether it is hot: no join with a bitmap, which makes a row for each of theirs."""
    ids = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 10).alias("key"))
    counts = ids.groupBy("key").agg(F.count("*").alias("n"))
    got = counted_join(ids.join(counts, "key"), counts.withColumn("last", F.col("key") * 2), ["key"], F.col("id"), "n", hot=500)
    assert sorted(got.columns) == ["id", "key", "last", "n"] and "__bit_part" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["key"], r["n"], r["last"]) for r in got.collect()) == sorted((i, k, 2100 if k == 0 else 100, 2 * k) for i in range(3000) for k in [0 if i < 2000 else i % 10])


def test_repeated_facts_are_not_broadcast(spark):
    """A side that is repeated for salts is many times the size Spark takes it for, so it must not go through the driver."""
    from lectern.llm.common import counted_join, salted_join

    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 10).alias("key"))
    facts = rows.groupBy("key").agg(F.count("*").alias("n"))
    joined = salted_join(rows, facts, ["key"], F.col("id"), "inner")
    counted = counted_join(rows, facts, ["key"], F.col("id"), "n")
    wide = lambda plan: [x for x in plan.splitlines() if "Join" in x and "__salt__" in x]
    for got in (joined, counted):
        found = wide(got._jdf.queryExecution().executedPlan().toString())
        assert found and all("SortMergeJoin" in x for x in found)
        assert got.count() == 3000


def test_blocks_of_anchors_are_not_broadcast(spark, monkeypatch):
    """A block of anchors stands once for each segment: its join with the buckets must not go through the driver."""
    from lectern.llm import negatives

    seen = []

    def watched(df, fn, schema):
        seen.append((schema, df._jdf.queryExecution().executedPlan().toString()))
        return map_arrow(df, fn, schema)

    map_arrow = negatives.map_arrow
    monkeypatch.setattr(negatives, "map_arrow", watched)
    rows = spark.range(200).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("label"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    assert negatives.mine_negatives(rows, F.col("vec_id") % 50 == 0).count() > 0
    searches = [plan for schema, plan in seen if schema == negatives.FOUND]
    assert searches and all([x for x in plan.splitlines() if "Join" in x and "segment" in x] and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "segment" in x] for plan in searches)


def test_ids_without_decoding(spark, sf_dir):
    """A caller that needs ids only does not pay for decoded texts; the ids are the same."""
    import public_tokenizers

    from lectern.llm.word_bpe import bpe_round_trip

    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")
    bare = bpe_round_trip(docs, path, decode=False)
    assert bare.columns == ["doc_id", "ids"]
    assert sorted(map(tuple, bare.collect())) == sorted((r["doc_id"], r["ids"]) for r in bpe_round_trip(docs, path).collect())


def test_word_bpe_holds_little(monkeypatch):
    """A task's memory beside the batch is bounded by its slices, and merges by symbols however long words are; nothing changes by it."""
    import tracemalloc

    from lectern.llm import word_bpe

    bpe, rng, cells = word_bpe.WordBpe(tokenizer("word_bpe_49k.json")), random.Random(2), []
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.choice((3, 7, 15, 30, 90)))) for _ in range(60_000)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, len(words), 30)]
    merge = bpe._merge_rows
    monkeypatch.setattr(bpe, "_merge_rows", lambda flat, starts, sizes: (cells.append(len(sizes) * int(sizes.max())), merge(flat, starts, sizes))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    got = sum((b.column("ids").value_lengths().to_pylist() for b in word_bpe.coded(bpe, iter([batch]), decode=False)), [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(cells) <= word_bpe.CELLS and peak < 20e6, (max(cells), peak)
    whole, counts = bpe.encode(batch.column(1))
    assert got == counts.tolist() and len(whole) == sum(got)


def test_best_path_by_stretches():
    """Stretches under one leader give the path of a search word by word, ties included, with fewer calls than there are words."""
    import sys

    def plain(scores, switch):
        total, back = scores[0].tolist(), []
        for row in scores[1:].tolist():
            at = total.index(max(total))
            came = [k if t >= total[at] - switch else at for k, t in enumerate(total)]
            total = [max(t, total[at] - switch) + r for t, r in zip(total, row, strict=True)]
            back.append(came)
        path = [total.index(max(total))]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]

    rng = np.random.default_rng(5)
    for i in range(300):
        n, k = int(rng.integers(1, 300)), int(rng.integers(1, 6))
        scores = rng.integers(-8, 1, (n, k)).astype(np.float32) / 2 + np.repeat(rng.integers(0, 5, (n // 20 + 1, k)), 20, 0)[:n].astype(np.float32)
        assert best_path(scores, float(i % 3 * 4 + 2)).tolist() == plain(scores, float(i % 3 * 4 + 2))
    scores = np.zeros((60_000, 4), np.float32)
    scores[np.arange(60_000), np.arange(60_000) // 1000 % 4] = 3
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    path = best_path(scores, 12.0)
    sys.setprofile(None)
    assert path.tolist() == plain(scores, 12.0)
    assert len(calls) < len(scores), len(calls)


def test_pipeline_decodes(spark, sf_dir):
    """The last stage decodes as the library does; it gave ids only."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Né İx <|endoftext|> 語!")], "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.localCheckpoint()
    want = [(r["doc_id"], hashlib.sha256(plain.decode(plain.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()) for r in docs.collect()]
    got = corpus_pipeline.word_bpe(spark, docs, sf_dir)
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in got.collect()) == sorted(want)


def test_pipeline_leaves_what_nothing_reads(spark, sf_dir, monkeypatch):
    """Shuffle files go when a table is written, tables when the next stage is; both stayed until the end."""
    from pathlib import Path

    import corpus_pipeline
    from lectern.shipping import checkpoint_folder

    tables = lambda: {p.name for p in Path(checkpoint_folder(spark).removeprefix("file:"), "lectern").glob("*")}
    rows = spark.range(20_000).select((F.col("id") % 5_000).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    cleaner = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"/shuffle_(\d+)_", cleaner.getAllFiles().mkString("|")))
    written(rows.repartition(3, "doc_id"), "warm")
    before, held = tables(), shuffles()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, docs, d: written(docs.repartition(5, "doc_id"), "own").dropDuplicates(["doc_id"])) for n in ("one", "two")])
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path, f=type(spark.read).parquet: rows if path.endswith("/documents.parquet") else f(self, path))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == 5_000
    assert [n.split("-")[:2] for n in tables() - before] == [["pipeline", "two"]]
    assert len(shuffles() - held) <= 1  # the count's


def test_near_duplicates_keep_one_table(spark):
    from pathlib import Path

    from lectern.shipping import checkpoint_folder

    tables = lambda: {p.name for p in Path(checkpoint_folder(spark).removeprefix("file:"), "lectern").glob("*")}
    words = [f"w{i}" for i in range(60)]
    rows = spark.createDataFrame([(i, " ".join(words[: 50 + i % 3])) for i in range(9)] + [(20, "x y z a b c d e f")], "doc_id long, text string")
    before = tables()
    left = drop_near_duplicates(rows)
    made = {n.rsplit("-", 1)[0] for n in tables() - before}
    assert made == {"near-lost"} and sorted(r["doc_id"] for r in left.collect()) == [0, 20]


def test_components_end_when_all_are_stars(spark, monkeypatch):
    """Stars need no round; chains, rings and edges in either direction end with the least node."""
    from lectern.llm import components as module

    rounds, star = [], module._star
    monkeypatch.setattr(module, "_star", lambda *a: (rounds.append(1), star(*a))[1])
    stars = spark.createDataFrame([(b, a) for a in (1, 50) for b in range(a + 1, a + 30)], "a long, b long")
    assert {(r["node"], r["root"]) for r in module.components(stars).collect()} == {(b, a) for a in (1, 50) for b in range(a, a + 30)} and not rounds
    edges = [(i, i + 1) for i in range(100, 140)] + [(211, 210), (212, 211), (210, 212), (5, 5)]
    got = {(r["node"], r["root"]) for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(100, 141)} | {(i, 210) for i in (210, 211, 212)} and rounds
    assert module.components(stars.limit(0)).count() == 0


def test_mix_moves_no_texts_for_few_sources(spark, monkeypatch):
    """Budgets of few sources are broadcast; of many they are joined, with the same rows."""
    from lectern.llm import mixing

    rows = spark.createDataFrame([(i, f"a word {i} " * (i % 7 + 1), ["x", "y", None, ""][i % 4]) for i in range(200)] + [(3, "a b", "x")] * 3, "doc_id long, text string, source string")
    few = mixing.mixed_rows(rows)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString() and "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    many = mixing.mixed_rows(rows)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
