"""Repair of conversation structure: the cheapest edits that make roles read ``(s?(ua)+)?``, by time-major tensor programming.

Rows are dealt by ranges of conversation and turn, so that a long conversation is several tasks' and texts are shuffled once.
Within a task, conversations are put together by length, and all of one length class are solved at once: costs of four states, turn
by turn backwards, then the edits forwards, both by numpy over the whole class. A conversation that may go on in another
range, or that is longer than a piece, is left ``open``: each of its pieces becomes a 4 x 4 table of least costs, the tables are
composed, and each piece is then traced from the state it is entered in and the costs behind its end.

States: 0 nothing yet, 1 after the system's turn, 2 after a user's (an assistant's must follow), 3 after an assistant's. A
conversation may end in 0 or 3.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, salted_join, written

FAR = 1 << 40
#: What a turn of one's own making leads to from each state, and the initial that each state asks for.
NEXT = np.array([2, 2, 3, 2])
#: A kept turn's next state by state and role: system, user, assistant, other. -1: it cannot be kept.
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
ENDS = np.array([0, FAR, FAR, 0], np.int64)
OK, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
_VISIBLE, _LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
LEGAL = {"su", "ua", "au"}
COUNTS = ("blank", "duplicate", "truncated", "illegal")


@dataclass(frozen=True)
class Repair:
    """Costs of edits; piece: rows of a conversation solved at once; held: rows of whole conversations
    solved together, ``characters`` of text counting as one more."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    piece: int = 4096
    held: int = 20_000
    characters: int = 400


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after damage by ``crc32(conv_id:turn) % 20``; nulls count as one space there, and in role and text.

    0 drops the row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes its role ``user``.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    hit = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text_now = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_now.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


# The program over many conversations at once


def costs_back(codes: np.ndarray, fault: np.ndarray, real: np.ndarray, end: np.ndarray, repair: Repair, tail: bool = True) -> np.ndarray:
    """(turns + 1, conversations, 4) least costs from each state before each turn to the end; inputs are (turns, conversations).

    ``end`` (conversations, 4) are the costs behind the last turn. Places that are not ``real`` cost nothing and change nothing;
    they lie behind a conversation's turns. With ``tail``, turns may be inserted behind the last one.
    """

    def inserted(v: np.ndarray) -> np.ndarray:
        for _ in range(3):
            v = np.minimum(v, repair.insert + v[:, NEXT])
        return v

    turns, n = codes.shape
    out = np.empty((turns + 1, n, 4), np.int64)
    out[turns] = inserted(end) if tail else end
    for t in range(turns - 1, -1, -1):
        ahead = out[t + 1]
        extra = np.where(fault[t] == TRUNCATED, repair.truncated, 0)[:, None]
        best = repair.delete + ahead
        made = repair.rerole + extra + ahead[:, NEXT]
        to = KEEP[:, codes[t]].T
        kept = np.where(to >= 0, np.take_along_axis(ahead, np.maximum(to, 0), 1) + extra, FAR)
        sound = ((fault[t] == OK) | (fault[t] == TRUNCATED))[:, None]
        best = np.minimum(best, np.where(sound, np.minimum(made, kept), FAR))
        out[t] = np.where(real[t][:, None], inserted(np.minimum(best, FAR)), ahead)
    return out


def traced(costs: np.ndarray, codes: np.ndarray, fault: np.ndarray, real: np.ndarray, start: np.ndarray, repair: Repair, tail: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, states, last): the ASCII-least cheapest edits from ``start``.

    letters (turns + 1, conversations, 4) bytes: up to three ``I`` and the turn's own edit, zeros else; states (turns + 1, conversations)
    before each turn's own edit, and behind the last turn's; last: the state behind the end. The order D, I, K, R at each step gives the least string.
    """
    turns, n = codes.shape
    letters, states, state = np.zeros((turns + 1, n, 4), np.uint8), np.zeros((turns + 1, n), np.int8), start.copy()
    who = np.arange(n)
    for t in range(turns + 1):
        live = real[t].copy() if t < turns else np.ones(n, bool)
        if t == turns:
            states[t] = state
            if not tail:
                break
        for step in range(4):
            now = costs[t][who, state]
            if t < turns:
                ahead, extra = costs[t + 1], np.where(fault[t] == TRUNCATED, repair.truncated, 0)
                gone = live & (now == repair.delete + ahead[who, state])
                letters[t, gone, step] = ord("D")
                states[t, gone] = state[gone]
                live &= ~gone
            more = live & (now == repair.insert + costs[t][who, NEXT[state]])
            letters[t, more, step] = ord("I")
            if t < turns:
                own = live & ~more
                sound = (fault[t] == OK) | (fault[t] == TRUNCATED)
                to = KEEP[state, codes[t]]
                kept = own & sound & (to >= 0) & (now == ahead[who, np.maximum(to, 0)] + extra)
                letters[t, own, step] = np.where(kept, ord("K"), ord("R"))[own]
                states[t, own] = state[own]
                state = np.where(own, np.where(kept, to, NEXT[state]), state)
            state = np.where(more, NEXT[state], state)
            live = more
            if not live.any():
                break
    return letters, states, state


def cost_table(codes: np.ndarray, fault: np.ndarray, repair: Repair) -> np.ndarray:
    """The 4 x 4 least costs of one piece, from each state before it to each state behind it, without inserts behind its end."""
    n = len(codes)
    end = np.full((4, 4), FAR, np.int64)
    end[np.arange(4), np.arange(4)] = 0
    tiled = lambda x: np.repeat(x[:, None], 4, 1)
    return np.minimum(costs_back(tiled(codes), tiled(fault), np.ones((n, 4), bool), end, repair, False)[0].T, FAR)


# Texts and roles of one batch


def role_codes(roles: list[str]) -> np.ndarray:
    known = {"s": 0, "u": 1, "a": 2}
    return np.array([known.get(r[:1], 3) for r in roles], np.int64)


def text_faults(texts: list[str]) -> np.ndarray:
    """BLANK, TRUNCATED or OK for each text alone."""
    return np.array([BLANK if not _VISIBLE.search(t) else OK if _LAST.search(t) else TRUNCATED for t in texts], np.int64)


def _edited(letters: bytes, state: int, role: str, text: str) -> Iterator[str]:
    """The repaired rows of one turn: those put in before it, and itself. ``state`` is the one before its own edit."""
    own = letters[-1:].replace(b"I", b"")
    before = state
    if put := letters.count(b"I"):
        # Walk back: of the inserted turns the last one led to ``state``; users and assistants alternate.
        last = {2: "user", 3: "assistant"}[before]
        roles = [last if (put - 1 - i) % 2 == 0 else ("assistant" if last == "user" else "user") for i in range(put)]
        yield from (f"{r}:" for r in roles)
    if own == b"K":
        yield f"{role}:{text}"
    elif own == b"R":
        yield f"{'assistant' if before == 2 else 'user'}:{text}"


def _tail(letters: bytes, state: int) -> Iterator[str]:
    for _ in letters:
        state = int(NEXT[state])
        yield "user:" if state == 2 else "assistant:"


_REPORT = "conv_id long, open boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OPEN = "piece long, at long, turn long, role string, text string, digest binary, code long, fault long"


def _solve(convs: list[dict], repair: Repair) -> Iterator[tuple]:
    """Report rows of whole conversations, class by class of length."""
    classes: dict[int, list[dict]] = {}
    for c in convs:
        classes.setdefault((len(c["codes"]) - 1).bit_length(), []).append(c)
    for members in classes.values():
        turns, n = max(len(c["codes"]) for c in members), len(members)
        codes, fault, real = np.full((turns, n), 3, np.int64), np.zeros((turns, n), np.int64), np.zeros((turns, n), bool)
        for i, c in enumerate(members):
            k = len(c["codes"])
            codes[:k, i], fault[:k, i], real[:k, i] = c["codes"], c["fault"], True
        costs = costs_back(codes, fault, real, np.broadcast_to(ENDS, (n, 4)), repair)
        letters, states, _ = traced(costs, codes, fault, real, np.zeros(n, np.int64), repair)
        for i, c in enumerate(members):
            k = len(c["codes"])
            own = [letters[t, i].tobytes().rstrip(b"\0") for t in range(k)]
            end = letters[turns, i].tobytes().rstrip(b"\0")
            rows = [x for t in range(k) for x in _edited(own[t], int(states[t, i]), c["roles"][t], c["texts"][t])]
            rows += _tail(end, int(states[turns, i]))
            yield _report(c, int(costs[0, i, 0]), (b"".join(own) + end).decode(), hashlib.sha256("\n".join(rows).encode()).hexdigest())


def _report(c: dict, cost: int, audit: str, digest: str) -> tuple:
    known = [t for t in c["turn"] if t is not None]
    initials = [r[:1] for r in c["roles"]]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    fault = c["fault"]
    return (c["conv"], False, min(known, default=None), max(known, default=None), len(set(known)), int((fault == BLANK).sum()), int((fault == DUPLICATE).sum()), int((fault == TRUNCATED).sum()), illegal, cost, audit, digest)


def _with_duplicates(fault: np.ndarray, digests: list[bytes]) -> np.ndarray:
    seen: set[bytes] = set()
    out = fault.copy()
    for i, d in enumerate(digests):
        if d in seen and out[i] != BLANK:
            out[i] = DUPLICATE
        seen.add(d)
    return out


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}


def _arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _parts(rows: DataFrame, repair: Repair) -> DataFrame:
    """Reports of conversations that one range holds, and the rows of the others (``open``), with the piece each belongs to."""
    blank = (None,) * 8
    schema = f"{_REPORT}, {_OPEN}"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, run, first, done, count, cut = TaskContext.get().partitionId(), 0, [], True, [], 0, 0
        now: object = None

        def opened() -> list[tuple]:
            codes, fault = role_codes([r[2] for r in run]), text_faults([r[3] for r in run])
            return [(r[0], True, *(None,) * 10, part << 24 | cut, r[5], r[1], r[2], r[3], r[4], int(c), int(f)) for r, c, f in zip(run, codes, fault, strict=True)]

        def finished() -> dict:
            roles, texts = [r[2] for r in run], [r[3] for r in run]
            return {"conv": run[0][0], "turn": [r[1] for r in run], "roles": roles, "texts": texts, "codes": role_codes(roles), "fault": _with_duplicates(text_faults(texts), [r[4] for r in run])}

        def solved() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if done:
                yield _arrow(schema, [(*r, *blank) for r in _solve(done, repair)])
                done.clear()
            count = 0

        broken = False  # the conversation at hand is open already
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and row[0] != now or len(run) >= repair.piece:
                    ended = row[0] != now
                    if first or broken or not ended:
                        yield _arrow(schema, opened())
                        cut += 1
                        broken = not ended
                    else:
                        done.append(finished())
                        count += len(run) + sum(len(t) for t in done[-1]["texts"]) // repair.characters
                        if count >= repair.held:
                            yield from solved()
                    first = first and not ended
                    run = []
                now = row[0]
                run.append((*row, at))
                at += 1
        yield from solved()
        if run:
            yield _arrow(schema, opened())

    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = rows.select("conv_id", "turn", "role", "text", digest.alias("digest"))
    order = ["conv_id", "turn", "role", "digest"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order), solve, schema)


# Conversations in several pieces


def _streamed(rows: DataFrame, keys: list[str], order: list[str], act, schema: str) -> DataFrame:
    """``act`` on the rows (a list of tuples) of each group of ``keys``; groups are pieces and bounded."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        k = len(keys)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:k] != held[0][:k]:
                    yield _arrow(schema, list(act(held)))
                    held = []
                held.append(row)
        if held:
            yield _arrow(schema, list(act(held)))

    columns = [*keys, *[c for c in rows.columns if c not in keys]]
    return map_arrow(rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order), stream, schema)


def _open_reports(rows: DataFrame, repair: Repair) -> DataFrame:
    """Reports of the open conversations. Only their digests at the end see a conversation as a whole, as a stream."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    rows = rows.withColumn("conv", key)
    # A duplicate is a row of a text with an earlier one; the least place combines before the shuffle.
    firsts = rows.groupBy("conv", "digest").agg(F.min(F.struct("piece", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first") < F.struct("piece", "at"), DUPLICATE).otherwise(F.col("fault")).cast("long")
    rows = written(salted_join(rows, firsts, ["conv", "digest"], F.col("at")).withColumn("fault", fault).drop("first"), "open-turns")
    narrow = rows.select("conv", "piece", "at", "code", "fault")
    n = 2

    def arrays(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r[n + 1] for r in held], np.int64), np.array([r[n + 2] for r in held], np.int64)

    def table(held: list[tuple]) -> Iterator[tuple]:
        yield (*held[0][:n], cost_table(*arrays(held), repair).astype("<i8").tobytes())

    tables = written(_streamed(narrow, ["conv", "piece"], ["at"], table, "conv string, piece long, costs binary"), "piece-costs")

    def backward(held: list[tuple]) -> Iterator[tuple]:
        end, final, out = ENDS.copy(), 1, []
        for conv, piece, raw in reversed(held):
            costs = np.frombuffer(raw, "<i8").reshape(4, 4)
            for _ in range(3 if final else 0):
                end = np.minimum(end, repair.insert + end[NEXT])
            out.append((conv, piece, end.astype("<i8").tobytes(), bool(final)))
            end, final = np.minimum((costs + end).min(1), FAR), 0
        yield from out

    ends = _streamed(tables, ["conv"], ["piece"], backward, "conv string, piece long, end binary, final boolean")
    ends = written(ends, "piece-ends")

    def trace(held: list[tuple]) -> Iterator[tuple]:
        """The edits from each of the four states the piece may be entered in."""
        codes, fault = arrays(held)
        end, final = np.frombuffer(held[0][n + 3], "<i8"), held[0][n + 4]
        tiled = lambda x: np.repeat(x[:, None], 4, 1)
        real = np.ones((len(codes), 4), bool)
        costs = costs_back(tiled(codes), tiled(fault), real, np.broadcast_to(end, (4, 4)), repair, False)
        letters, states, last = traced(costs, tiled(codes), tiled(fault), real, np.arange(4), repair, final)
        for i, row in enumerate(held):
            own = b"|".join(letters[i, s].tobytes().rstrip(b"\0") for s in range(4))
            tail = b"|".join(letters[len(held), s].tobytes().rstrip(b"\0") for s in range(4)) if i == len(held) - 1 else b"|||"
            yield (*row[:n], row[n], own.decode(), states[i].tobytes(), tail.decode(), last.astype(np.int8).tobytes(), costs[0, :, :].diagonal().astype("<i8").tobytes())

    known = narrow.join(ends, ["conv", "piece"])
    edits = written(_streamed(known, ["conv", "piece"], ["at"], trace, "conv string, piece long, at long, letters string, states binary, tail string, last binary, costs binary"), "piece-edits")

    def enter(held: list[tuple]) -> Iterator[tuple]:
        state = 0
        for conv, piece, last, costs in held:
            yield (conv, piece, state, int(np.frombuffer(costs, "<i8")[state]))
            state = last[state]

    ways = edits.groupBy("conv", "piece").agg(F.first("last").alias("last"), F.first("costs").alias("costs"))
    entered = _streamed(ways, ["conv"], ["piece"], enter, "conv string, piece long, entry long, cost long")
    mine = edits.select("conv", "piece", "at", "letters", "states", "tail").join(entered, ["conv", "piece"])
    chosen = rows.select("conv", "piece", "at", "conv_id", "turn", "role", "text", "fault").join(mine, ["conv", "piece", "at"])
    kind = "conv_id long, open boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One conversation after the other as a stream: a digest, counts and the edits' letters are all that is held."""
        now, c = None, None

        def out() -> pa.RecordBatch:
            return _arrow(kind, [(c["id"], False, c["low"], c["high"], c["turns"], c["n"][BLANK], c["n"][DUPLICATE], c["n"][TRUNCATED], c["illegal"], c["cost"], "".join(c["audit"]), c["sha"].hexdigest())])

        for batch in batches:
            for conv, _, _, conv_id, turn, role, text, fault, letters, states, tail, entry, cost in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if conv != now:
                    if c:
                        yield out()
                    now, c = conv, {"id": conv_id, "low": None, "high": None, "turns": 0, "n": [0, 0, 0, 0], "illegal": 0, "cost": cost, "audit": [], "sha": hashlib.sha256(), "any": False, "before": None}
                c["n"][fault] += 1
                if turn is not None and turn != c["high"]:
                    c["turns"] += 1
                    c["low"], c["high"] = turn if c["low"] is None else c["low"], turn
                if c["before"] is not None and c["before"] + role[:1] not in LEGAL:
                    c["illegal"] += 1
                c["before"] = role[:1]
                own, end = letters.split("|")[entry], tail.split("|")[entry]
                c["audit"] += [own, end]
                state = np.frombuffer(states, np.int8)[entry]
                after = {"K": lambda s: KEEP[s, role_codes([role])[0]], "R": lambda s: NEXT[s], "D": lambda s: s}[own[-1:]](state)
                for line in (*_edited(own.encode(), int(state), role, text), *_tail(end.encode(), int(after))):
                    c["sha"].update((("\n" if c["any"] else "") + line).encode())
                    c["any"] = True
        if c:
            yield out()

    columns = ["conv", "piece", "at", "conv_id", "turn", "role", "text", "fault", "letters", "states", "tail", "entry", "cost"]
    return map_arrow(chosen.select(*columns).repartition("conv").sortWithinPartitions("conv", "piece", "at"), report, kind)


def repair_conversations(rows: DataFrame, repair: Repair = Repair()) -> DataFrame:
    """A report on each conversation of ``rows`` (conv_id, turn, role, text): faults, the cheapest edits and what they give.

    Turns go in order, null first; turns that tie go by role and then by the SHA-256 of role and text. A row's first fault counts:
    blank (no visible character), duplicate (role and text were seen earlier in the conversation), truncated (the last visible
    character is not one of ``.!?``). Edits: keep, give another role (user or assistant), delete (needed for blank and duplicate rows),
    insert a row without text. Their letters are K, R, D and I, ``audit`` has them in order; of the cheapest the ASCII-least are
    taken. ``illegal`` counts neighbours whose roles' initials are not su, ua or au; ``gaps`` the turn numbers missing between least
    and greatest (0 if no turn has a number). ``repaired_sha256`` is over the repaired rows, ``role:text`` by lines. Null ids are one
    conversation; null roles and texts count as one space. Ids and turns are whole numbers. No rows give no rows.
    """
    shown = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role"), shown("text"))
    parts = written(_parts(rows, repair), "conversations")
    names = [f.split()[0] for f in _REPORT.split(", ")]
    whole = parts.filter("not open").select(*names)
    both = whole.unionByName(_open_reports(parts.filter("open").select("conv_id", *[f.split()[0] for f in _OPEN.split(", ")]), repair))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return both.select("conv_id", gaps.cast("long").alias("gaps"), *COUNTS, "cost", "audit", "repaired_sha256")


def repaired_report(original: DataFrame, rows: DataFrame, repair: Repair = Repair(), conv: Column | str = "conv_id") -> DataFrame:
    """:func:`repair_conversations` of ``rows`` for every conversation of ``original``; those without rows have zeros, no edits, and the digest of nothing."""
    every = original.select(F.col(conv).cast("long").alias("conv_id") if isinstance(conv, str) else conv.alias("conv_id")).distinct()
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    found = repair_conversations(rows, repair).withColumn("_key", key).drop("conv_id")
    joined = every.withColumn("_key", key).join(found, "_key", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
