"""Hard negatives, conversation repair and near vectors against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.conversations import ENDS, KEEP, NEXT, Repair, cost_table, costs_back, damaged, repair_conversations, repaired_report
from lectern.llm.near_vectors import Near, buckets, hadamard, near_duplicates, normal, rotated, tables_needed
from lectern.llm.negatives import Best, Mining, mine_negatives
from lectern.llm.queries import op12_conversation_repair, op13_near_vectors

CLASHING = ("key", "ids", "segment", "place", "norm", "ball", "id", "vector", "bucket", "root", "audit", "piece", "cost", "limits", "row", "slot")
VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(1) for n in CLASHING})


# 11: hard negatives


def negatives_by_force(rows, mining=Mining(), every=50):
    own = []
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        own.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vec], label))
    out = []
    for i, (a, av, al) in enumerate(own):
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(av, cv, strict=False)), c, j, cl) for j, (c, cv, cl) in enumerate(own) if j != i))
        for s, p, _, _ in [x for x in scored if x[3] == al][: mining.positives]:
            found = [x for x in scored if x[3] != al and mining.low * -s <= 100 * -x[0] <= mining.high * -s]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(found[: mining.negatives])]
    return sorted(out)


def mined(spark, rows, mining=Mining(), every=50):
    out = mine_negatives(vectors(spark, rows), F.col("vec_id") % every == 0, mining)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_negatives_by_brute_force(spark, spread):
    """Norms alike and norms far apart; small buckets and blocks, so that bounds and running scores act across many."""
    rng = np.random.default_rng(int(spread) + 5)
    base = rng.standard_normal((4, 6))
    rows = []
    for i in range(400):
        v = base[rng.integers(4)] * 0.5 + rng.standard_normal(6) * 0.4
        rows.append((i, [float(x) for x in v * math.exp(spread * rng.standard_normal())], int(rng.integers(3))))
    assert mined(spark, rows, Mining(bucket=16, block=3), 10) == negatives_by_force(rows, Mining(), 10)


def test_negatives_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (2, [0.9, 0.0], 1), (3, [0.9, 0.0], 1), (4, [0.6, 0.5, 3.0], 1), (5, [0.7], 1), (6, None, 1), (7, [None, 1.0], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (10, [1.0, 1.0], None), (50, [0.0, 0.0], 2), (100, [], 2), (150, [-1.0, 0.0], 3), (200, [1.0, 0.1], 3)]
    assert mined(spark, rows) == negatives_by_force(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    huge = [(0, [3e38, 1.0], 0), (1, [3e38, 0.0], 0), (2, [2e38, 0.0], 1)]
    assert [r[:4] for r in mined(spark, huge)] == [(0, 1, 1, 2)]


def test_best_keeps_the_first_of_ties():
    rng = random.Random(3)
    for _ in range(200):
        best, fed = Best(1, 3), []
        for b in range(rng.randint(1, 4)):
            ids = np.sort(np.array([rng.randint(0, 20) for _ in range(rng.randint(1, 8))]))
            scores = np.array([[float(rng.randint(0, 3)) * rng.choice([1, 2.0**50]) for _ in ids]])
            fed += [(-s, i, b * 100 + n) for n, (s, i) in enumerate(zip(scores[0], ids, strict=True))]
            best.feed(np.array([0]), scores, ids, np.arange(len(ids)) + b * 100)
        want = sorted(fed)[:3]
        assert [(-s, i, k) for s, i, k in zip(best.scores[0], best.ids[0], best.keys[0], strict=True)][: len(want)] == want


# 12: conversation repair


def repaired_by_force(rows):
    """Report of one conversation's rows (turn, role, text) in order, by recursion over strings."""
    repair, visible, seen, faults = Repair(), re.compile(r"[^\x20\x09-\x0D]"), set(), []
    for _, role, text in rows:
        found = visible.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    turn_of = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {"user": 2, "assistant": 3}

    @cache
    def best(i, state, put):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if put < 3:
            c, s, out = best(i, after[turn_of[state]], put + 1)
            options.append((c + repair.insert, "I" + s, (f"{turn_of[state]}:", *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, s, out = best(i + 1, state, 0)
            options.append((c + repair.delete, "D" + s, out))
            if faults[i] in ("", "truncated"):
                extra = 3 if faults[i] else 0
                c, s, out = best(i + 1, after[turn_of[state]], 0)
                options.append((c + repair.rerole + extra, "R" + s, (f"{turn_of[state]}:{text}", *out)))
                kept = 1 if state == 0 and role[:1] == "s" else after[turn_of[state]] if role[:1] == turn_of[state][0] else None
                if kept is not None:
                    c, s, out = best(i + 1, kept, 0)
                    options.append((c + extra, "K" + s, (f"{role}:{text}", *out)))
        return min(options, default=(10**9, "", ()))

    cost, audit, out = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def reports_by_force(rows, damage=False):
    shown = lambda x: " " if x is None else str(x)
    by: dict = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20 if damage else 9
        role, text = ("user" if kind == 4 else role), ("" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return sorted(((c, *repaired_by_force(sorted(own, key=key))) for c, own in by.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


def turns(spark, rows):
    return spark.createDataFrame(rows, TURNS).withColumns({n: F.lit(1) for n in CLASHING if n not in ("row",)})


def random_turns(seed, convs, most):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(["Yes.", "No", "", " \t", "Well!", "a b? ", "Éa.", None, f"t{t}."])))
    return rows


@pytest.mark.parametrize("piece", [4096, 3])
def test_repairs_by_brute_force(spark, piece):
    """Whole conversations in one range, and conversations cut into pieces of three rows."""
    rows = random_turns(7, 150, 9) + [(10**6, t, "user" if t % 3 else "assistant", f"text {t}" + "." * (t % 2)) for t in range(60)]
    got = repair_conversations(turns(spark, rows), Repair(piece=piece, held=40))
    assert [d[1] for d in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert sorted((tuple(r) for r in got.collect()), key=str) == reports_by_force(rows)


def test_damage_and_reports_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op12_conversation_repair(spark, sf_dir).collect()), key=str) == reports_by_force(rows, True)


def test_repair_edge_cases(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (5, None, None, None), (5, None, None, None), (6, 10**12, "system", "x"), (7, 0, "user", "long " * 50_000), (7, 0, "user", "long " * 50_000)] + [(c, 0, "user", "same.") for c in range(100, 160)]
    df = turns(spark, rows)
    assert sorted((tuple(r) for r in repaired_report(df, damaged(df)).collect()), key=str) == reports_by_force(rows, True)
    assert sorted((tuple(r) for r in repair_conversations(df).collect()), key=str) == reports_by_force(rows)
    none = spark.createDataFrame([], TURNS)
    assert repaired_report(none, damaged(none)).count() == 0
    lost = repaired_report(df, none).filter("conv_id = 7").first()
    assert tuple(lost)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_tables_of_pieces_compose():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(2, 12))
        codes, fault, cut = rng.integers(0, 4, n), rng.integers(0, 4, n), int(rng.integers(1, n))
        whole = costs_back(codes[:, None], fault[:, None], np.ones((n, 1), bool), ENDS[None], Repair())[0, 0]
        a, b = cost_table(codes[:cut], fault[:cut], Repair()), cost_table(codes[cut:], fault[cut:], Repair())
        end = ENDS.copy()
        for _ in range(3):
            end = np.minimum(end, 3 + end[NEXT])
        assert np.array_equal((a + (b + end).min(1)).min(1), whole)
    assert KEEP.shape == (4, 4)


# 13: near vectors


def near_by_force(rows, threshold=0.9):
    use = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: [] for i in range(len(rows))}
    for width in {len(rows[i][1]) for i in use}:
        at = [i for i in use if len(rows[i][1]) == width]
        x = normal(np.array([rows[i][1] for i in at], np.float32).astype(np.float64))
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[at[a]].append(at[b])
    root = list(range(len(rows)))
    for i in range(len(rows)):
        stack, seen = [i], {i}
        while stack:
            for k in links[stack.pop()]:
                if k not in seen:
                    seen.add(k)
                    stack.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        root[i] = min(ids, default=None)
    return sorted(((r[0], len(links[i]), root[i], r[0] == root[i]) for i, r in enumerate(rows)), key=str)


def neared(spark, rows, near=Near()):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in CLASHING})
    out = near_duplicates(df, near)
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    return sorted((tuple(r) for r in out.collect()), key=str)


def clouds(seed, groups, width, spread):
    """Groups of vectors around centres, tight ones and ones as wide as the threshold."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        centre = normal(rng.standard_normal((1, width)))[0]
        for _ in range(int(rng.integers(1, 25))):
            v = centre + rng.standard_normal(width) * spread[g % len(spread)] / math.sqrt(width)
            rows.append((len(rows), (v * rng.uniform(0.1, 9)).astype(np.float32)))
    return rows


@pytest.mark.parametrize("leaders", [64, 1])
def test_near_vectors_by_brute_force(spark, leaders):
    """Wide groups make undecided pairs of balls, which are compared vector by vector in blocks of eight."""
    rows = clouds(4, 40, 24, [0.02, 0.2, 0.35, 0.45])
    near = Near(recall=0.9999, leaders=leaders, block=8)
    assert neared(spark, rows, near) == near_by_force(rows)


def test_a_group_of_half_the_rows(spark):
    """Near copies gather into balls, so that the pairs of a group of 1,500 never exist; rows of all lengths of links come out."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + rng.standard_normal(32) * 0.05).astype(np.float32)) for i in range(1500)] + [(1500 + i, rng.standard_normal(32).astype(np.float32)) for i in range(500)]
    assert neared(spark, rows) == near_by_force(rows)


def test_near_vector_edge_cases(spark):
    rows = [(3, [1, 0]), (1, [2, 0]), (1, [2, 0]), (None, [5, 0]), (4, [1, 0, 0]), (5, [0, 0]), (6, None), (7, []), (8, [None, 1]), (9, [float("nan"), 1]), (10, [float("inf"), 1]), (None, [0, 1]), (12, [1e-30, 3e38]), (13, [1e-40, 0]), (14, [-1, 0]), (15, [3]), (16, [4])]
    assert neared(spark, rows, Near(recall=1.0)) == near_by_force(rows)
    assert neared(spark, []) == []
    assert neared(spark, [(1, None), (2, [0, 0])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_of_near_vectors_by_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in op13_near_vectors(spark, sf_dir).collect()), key=str) == near_by_force(rows)


def test_rotations_keep_angles_and_probes_come_first():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 24))
    turned = rotated(x, 3)
    assert np.allclose(turned @ turned.T, x @ x.T)
    assert np.allclose(hadamard(np.eye(8)) @ hadamard(np.eye(8)), np.eye(8))
    names = buckets(normal(x), 1, 2, 6)
    assert names.shape == (50, 6) and (buckets(normal(x), 1, 2, 1)[:, 0] == names[:, 0]).all()
    assert all(len(set(row)) == 6 for row in names.tolist())


def test_tables_reach_the_recall():
    """The simulated recall holds for other pairs at the threshold."""
    near, rng = Near(), np.random.default_rng(77)
    a = normal(rng.standard_normal((2000, 64)))
    b = rng.standard_normal((2000, 64))
    b = normal(b - (a * b).sum(1, keepdims=True) * a)
    b = 0.9 * a + math.sqrt(0.19) * b
    for hashes in (1, 2, 3):
        found = np.zeros(2000, bool)
        for table in range(1, tables_needed(near, hashes, 64) + 1):
            x, y = buckets(a, table, hashes, near.probes), buckets(b, table, hashes, near.probes)
            found |= (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
        assert found.mean() > 0.98
