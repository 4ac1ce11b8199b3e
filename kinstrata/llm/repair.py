"""Conversation structure repair: cheapest edits by a dynamic programme over tensors of many conversations, turn by turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, table

# States: nothing yet, after a system turn, after a user turn, after an assistant turn. A conversation may end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
NONE, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
RETYPE, DELETE, INSERT, OPEN = 3, 4, 3, 3
FAR = 1 << 28
# The state after a turn that stays, by its role and the state before; 4: not allowed there.
KEPT = np.array([[SYSTEM, 4, 4, 4], [USER, USER, 4, USER], [4, 4, ASSISTANT, 4], [4, 4, 4, 4]])
# The state after a turn of the role that is due, by the state before.
DUE = np.array([USER, USER, ASSISTANT, USER])
END = np.array([0, 2 * INSERT, INSERT, 0])
SEGMENT = 4096
_BLANK, _CUT = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def costs(role: np.ndarray, fault: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turns + 1, conversations, states): what it costs at least to repair what follows, all conversations at once, from the last turn back.

    role, fault: (turns, conversations); end: the costs after the last turn. An ABSENT turn pads a shorter conversation.
    """
    turns, n = role.shape
    out = np.empty((turns + 1, n, 4), np.int64)
    out[turns] = end
    for t in range(turns - 1, -1, -1):
        after, f = out[t + 1], fault[t][:, None]
        left = np.where(f == TRUNCATED, OPEN, 0)
        kept = np.take_along_axis(np.hstack([after, np.full((n, 1), FAR)]), KEPT[role[t]], 1) + left
        retyped = after[:, DUE] + RETYPE + left
        stays = np.where((f == BLANK) | (f == DUPLICATE), FAR, np.minimum(kept, retyped))
        best = np.minimum(after + DELETE, stays)
        # inserted turns lead from state to state at the same place; two in a row are the most that can pay
        user = np.minimum(best[:, USER], best[:, ASSISTANT] + INSERT)
        assistant = np.minimum(best[:, ASSISTANT], best[:, USER] + INSERT)
        best = np.stack([np.minimum(best[:, START], user + INSERT), np.minimum(best[:, SYSTEM], user + INSERT), user, assistant], 1)
        out[t] = np.where(f == ABSENT, after, best)
    return out


def _trace(role: np.ndarray, fault: np.ndarray, cost: np.ndarray, state: np.ndarray, last: bool, edits: list[np.ndarray]) -> np.ndarray:
    """Append a row of letters for each step of all conversations (0: none); the states after the last turn."""
    turns, n = role.shape
    at, every = np.zeros(n, np.int64), np.arange(n)
    while True:
        t = np.minimum(at, turns - 1) if turns else at
        more = at < turns
        go = more | (last & (END[state] > 0))
        if not go.any():
            return state
        f = fault[t, every] if turns else np.zeros(n, np.int64)
        now = cost[at, every, state]
        after = cost[np.minimum(at + 1, turns), every]
        due = DUE[state]
        skip = more & (f == ABSENT)
        real = more & ~skip
        left = np.where(f == TRUNCATED, OPEN, 0)
        to = KEPT[role[t, every], state] if turns else np.full(n, 4)
        delete = real & (after[every, state] + DELETE == now)
        insert = go & ~skip & ~delete & (cost[at, every, due] + INSERT == now)
        keep = real & ~delete & ~insert & (to < 4) & (f != BLANK) & (f != DUPLICATE) & (after[every, np.minimum(to, 3)] + left == now)
        retype = real & ~delete & ~insert & ~keep
        edits.append((delete * ord("D") + insert * ord("I") + keep * ord("K") + retype * ord("R")).astype(np.uint8))
        state = np.where(keep, to, np.where(insert | retype, due, state))
        at = at + (more & ~insert)


def cheapest(role: np.ndarray, fault: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, list[str]]:
    """(costs, edits): per conversation (a column) the least cost and the edits' initials, of equally cheap ones the least string.

    Costs of more turns than a segment has are kept at its beginning alone and worked out again on the way forward.
    """
    turns, n = role.shape
    cuts = list(range(0, turns, segment)) or [0]
    ends, end = [], np.broadcast_to(END, (n, 4))
    for lo in reversed(cuts):
        ends.append(end)
        whole = costs(role[lo : lo + segment], fault[lo : lo + segment], end)
        end = whole[0]
    state, edits = np.zeros(n, np.int64), []
    for k, lo in enumerate(cuts):
        some = slice(lo, lo + segment)
        cost = whole if len(cuts) == 1 else costs(role[some], fault[some], ends[len(cuts) - 1 - k])
        state = _trace(role[some], fault[some], cost, state, k == len(cuts) - 1, edits)
    letters = np.stack(edits, 1) if edits else np.zeros((n, 0), np.uint8)
    return end[:, START], [row[row > 0].tobytes().decode() for row in letters]


_PLAN = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_PLAN_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_CELLS = 1 << 20


def _per_conversation(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of values by conversation, some of which may be empty."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[starts + lengths] - sums[starts]


def _planned(convs: list, lengths: np.ndarray, turn: np.ndarray, known: np.ndarray, role: np.ndarray, fault: np.ndarray) -> pa.RecordBatch:
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    counts = [_per_conversation(fault == kind, starts, lengths) for kind in (BLANK, DUPLICATE, TRUNCATED)]
    legal = np.zeros((4, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True
    beside = owner[1:] == owner[:-1]
    illegal = np.zeros(len(role), bool)
    illegal[1:] = beside & ~legal[role[:-1], role[1:]]
    # turns come sorted, nulls first: a gap is a step of more than one
    step = np.zeros(len(turn), np.int64)
    step[1:] = np.where(beside & known[:-1] & known[1:], np.maximum(turn[1:] - turn[:-1] - 1, 0), 0)
    cost, audit = np.zeros(len(lengths), np.int64), [""] * len(lengths)
    size = np.array([int(x).bit_length() for x in lengths])
    for kind in np.unique(size[lengths > 0]):
        of_size = np.flatnonzero(size == kind)
        most = max(1, _CELLS >> int(kind))
        for lo in range(0, len(of_size), most):
            some = of_size[lo : lo + most]
            place = np.arange(int(lengths[some].max()))[:, None]
            inside = place < lengths[some]
            at = np.where(inside, starts[some] + place, 0)
            c, a = cheapest(np.where(inside, role[at], OTHER), np.where(inside, fault[at], ABSENT))
            cost[some] = c
            for i, text in zip(some.tolist(), a, strict=True):
                audit[i] = text
    sums = [_per_conversation(x, starts, lengths) for x in (step, illegal)]
    return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(sums[0]), *(pa.array(c) for c in counts), pa.array(sums[1]), pa.array(cost), pa.array(audit, pa.string())], schema=_PLAN)


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of features by conversation and turn; whole conversations of about _CELLS rows are planned together, a longer one alone."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if not held or (batch is not None and rows < _CELLS):
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.ones(len(t), bool)
        ids, none = t.column("conv_id").fill_null(0).to_numpy(), t.column("conv_id").is_null().to_numpy()
        new[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
        begins = np.flatnonzero(new)
        done = len(t) if batch is None else int(begins[-1])
        if done == 0:
            continue  # one conversation so far
        part, begins = t.slice(0, done), begins[begins < done]
        held, rows = t.slice(done).to_batches(), len(t) - done
        copies = part.column("copies").to_numpy()
        lengths = np.add.reduceat(copies, begins)
        first, kind = np.cumsum(copies) - copies, part.column("fault").to_numpy()
        fault = np.repeat(kind, copies)
        again = np.ones(len(fault), bool)
        again[first[copies > 0]] = False
        fault = np.where(again & (fault != BLANK), DUPLICATE, fault)  # copies stand beside their first
        known = np.repeat(part.column("turn").is_valid().to_numpy(), copies)
        turn = np.repeat(part.column("turn").fill_null(0).to_numpy(), copies)
        yield _planned(part.column("conv_id").take(pa.array(begins)).to_pylist(), lengths, turn, known, np.repeat(part.column("role").to_numpy(), copies), fault)


def repair_plans(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(plans, counted): per conversation gaps, faults, cost and audit; and its rows (conv_id, turn, role, text, copies), a row for all copies.

    rows: conv_id, turn, role, text, gone; a row with ``gone`` names a conversation and is no turn of it. Rows are in the order
    of turn (nulls first), then role and text. A null role or text is one space; a null conv_id is a conversation of its own.
    Faults: no visible character; role and text as in an earlier row; no sentence mark at the end. A row's first one counts.

    Copies are counted before anything is shuffled by conversation, and what makes a row a duplicate is a join of aggregates.
    Plans see a few bytes a row, not the texts: one conversation is one task, with one byte a turn and costs of a segment of
    turns in memory besides its audit. An empty table gives no rows.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "gone")
    rows = rows.withColumns({c: F.when(~F.col("gone"), F.col(c)) for c in ("turn", "role", "text")})
    counted = scratch.write(rows.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.count("*").alias("copies")), "counted")
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    kind = F.when(~F.col("text").rlike(_BLANK), BLANK).when(~F.col("text").rlike(_CUT), TRUNCATED).otherwise(NONE)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    small = counted.select("conv_id", "turn", F.when(F.col("gone"), 0).otherwise(F.col("copies")).alias("copies"), "gone", said.alias("said"), F.coalesce(kind, F.lit(NONE)).alias("kind"), code.alias("code"), "role")
    small = scratch.write(small, "small")
    # rows of one turn and role with different texts are rare: only they need their texts' order
    tied = small.where(~F.col("gone")).groupBy("conv_id", "turn", "role").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    tied = scratch.write(tied, "tied")
    order = counted.join(tied, same(counted, tied, ("conv_id", "turn", "role")), "left_semi")
    order = order.select("conv_id", "turn", said.alias("said"), F.row_number().over(Window.partitionBy("conv_id", "turn", "role").orderBy("text")).alias("place"))
    firsts = small.where(~F.col("gone")).groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("first"))
    firsts = scratch.write(firsts, "firsts")
    joined = small.join(firsts, same(small, firsts, ("conv_id", "said")), "left").select(small["*"], firsts["first"])
    joined = joined.join(order, same(joined, order, ("conv_id", "turn", "said")), "left").select(joined["*"], F.coalesce(order["place"], F.lit(0)).alias("place"))
    repeated = (F.col("first.later") != F.col("turn").isNotNull()) | (F.coalesce("first.turn", F.lit(0)) != F.coalesce("turn", F.lit(0)))
    fault = F.when(F.col("kind") == BLANK, BLANK).when(repeated, DUPLICATE).otherwise(F.col("kind"))
    features = joined.select("conv_id", "turn", "role", "place", F.col("code").alias("code"), F.coalesce(fault, F.lit(NONE)).alias("fault"), "copies")
    features = features.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "place")
    features = features.select("conv_id", "turn", F.col("code").cast("long").alias("role"), F.col("fault").cast("long").alias("fault"), "copies")
    return scratch.write(features.mapInArrow(_plans, _PLAN_DDL), "plans"), counted.where(~F.col("gone")).drop("gone")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, tuple[str, str, str] | None]]:
    """From each plan, followed by its conversation's rows: (plan, None), then (None, (edit, role, text)) for each turn of the repaired conversation."""
    plan, place, state = None, 0, START
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if plan is not None:
                    yield from _inserts(plan, place, state)
                plan, place, state = row, 0, START
                yield row, None
                continue
            for _ in range(row["copies"]):
                for turn in _inserts(plan, place, state):
                    yield turn
                    place, state = place + 1, DUE[state]
                edit = plan["audit"][place]
                place += 1
                if edit == "D":
                    continue
                role = row["role"] if edit == "K" else "user" if DUE[state] == USER else "assistant"
                state = KEPT[ROLES[role[0]], state]
                yield None, (edit, role, row["text"])
    if plan is not None:
        yield from _inserts(plan, place, state)


def _inserts(plan: dict, place: int, state: int) -> Iterator[tuple[None, tuple[str, str, str]]]:
    while plan["audit"][place : place + 1] == "I":
        place, state = place + 1, DUE[state]
        yield None, ("I", "user" if state == USER else "assistant", "")


_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, rows, size = None, [], 0
    place = 0
    for plan, turn in _edited(batches):
        if plan is not None:
            conv, place = plan["conv_id"], 0
            continue
        rows.append((conv, place, *turn))
        place, size = place + 1, size + len(turn[2])
        if len(rows) >= 1000 or size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TURNS, strict=True)], schema=_TURNS)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TURNS, strict=True)], schema=_TURNS)


_DIGEST = pa.schema([*(f for f in _PLAN), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, now, sha, some = [], None, hashlib.sha256(), False
    for plan, turn in _edited(batches):
        if plan is not None:
            if now is not None:
                out.append({c: now[c] for c in _PLAN.names} | {"repaired_sha256": sha.hexdigest()})
            now, sha, some = plan, hashlib.sha256(), False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
                out = []
            continue
        sha.update((("\n" if some else "") + f"{turn[1]}:{turn[2]}").encode())
        some = True
    if now is not None:
        out.append({c: now[c] for c in _PLAN.names} | {"repaired_sha256": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)


def _plans_and_rows(plans: DataFrame, counted: DataFrame) -> DataFrame:
    """Each plan before its conversation's rows, sorted by Spark, which spills; a task reads them as a stream."""
    kinds = {"turn": "long", "role": "string", "text": "string", "copies": "long"}
    a = plans.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()} | {"kind": F.lit(0)})
    b = counted.withColumns({f.name: F.lit(None).cast(f.dataType) for f in plans.schema if f.name != "conv_id"} | {"kind": F.lit(1)})
    return a.unionByName(b).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, with how each came about (Keep, Rerole, Insert)."""
    plans, counted = repair_plans(rows.withColumn("gone", F.lit(False)), Scratch(rows.sparkSession, "repair"))
    return _plans_and_rows(plans, counted).mapInArrow(_turns, "conv_id long, place long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays with ``gone``. Nulls are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(h == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), (h == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(h == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, counted = repair_plans(damaged(table(spark, sf_dir, "conversations")), Scratch(spark, "repair"))
    return _plans_and_rows(plans, counted).mapInArrow(_digests, _PLAN_DDL + ", repaired_sha256 string")
