"""Chat formatting with minimum-cost role repair.

A conversation is legal if it may open with one system turn and then alternates user and assistant, starting with the
user and ending with the assistant. A dynamic programme over that automaton finds the cheapest repair of the messages
in order: keep a message, relabel it, merge it into the turn before, or insert empty turns; ties go to fewer turns and
then to the first option in a fixed order. The repaired sequence is rendered turn by turn.

The programme is a product of (min, +) matrices over a handful of states, which is associative, so a conversation of any
length may lie over many partitions: messages are range-partitioned by conversation and place, each partition sends its
driver one small matrix for a conversation that crosses its border (two a partition at most), the driver chains them,
and each partition then replays its own messages between the states that it was told.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: Other names that roles go by.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "developer": "system"}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, MERGE_OTHER, INSERT = 3, 1, 5, 2
#: A cost is repair cost * TURNS + turns made, so that one number orders by both and yields the number of turns.
TURNS = 1 << 40
FAR = np.int64(1) << 60


def _fillers(state: int, role: int) -> list[int] | None:
    """The shortest run of empty turns that makes ``role`` legal after ``state``."""
    if role in LEGAL[state]:
        return []
    for middle in LEGAL[state]:
        if middle != SYSTEM and role in LEGAL[middle]:
            return [middle]
    for first in LEGAL[state]:
        for second in LEGAL[first]:
            if first != SYSTEM and role in LEGAL[second]:
                return [first, second]
    return None


def options(state: int, role: int | None) -> list[tuple[int, int, str, int, list[int]]]:
    """(cost, next state, action, role taken, empty turns before) for a message; role None is unknown or missing."""
    out = []
    for taken in (SYSTEM, USER, ASSISTANT):
        before = _fillers(state, taken)
        if before is not None:
            cost = (0 if taken == role else RELABEL) + INSERT * len(before)
            out.append((cost * TURNS + 1 + len(before), taken, "keep" if taken == role else "relabel", taken, before))
    if state != START:
        cost = MERGE if role == state else MERGE_OTHER
        out.append((cost * TURNS, state, "merge", state, []))
    return sorted(out, key=lambda o: (o[0], o[2], o[1]))


STEP = {role: [options(s, role) for s in range(4)] for role in (None, SYSTEM, USER, ASSISTANT)}
#: Ending cost of each state: an assistant turn must stand last.
END = np.array([2 * INSERT * TURNS + 2, 2 * INSERT * TURNS + 2, INSERT * TURNS + 1, 0], np.int64)
END_FILL = {START: [USER, ASSISTANT], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def _single(role: int | None) -> np.ndarray:
    m = np.full((4, 4), FAR)
    for s in range(4):
        for cost, to, *_ in STEP[role][s]:
            m[s, to] = min(m[s, to], cost)
    return m


SINGLE = {role: _single(role) for role in STEP}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


@lru_cache(maxsize=1024)
def code_of(role: str | None) -> int | None:
    name = str(role).strip().lower() if isinstance(role, str) else ""
    return ROLES.get(ALIASES.get(name, name))


def matrix(roles: list[int | None]) -> np.ndarray:
    """Cheapest costs from each state to each over a run of messages."""
    out = np.full((4, 4), FAR)
    np.fill_diagonal(out, 0)
    for role in roles:
        out = product(out, SINGLE[role])
    return out


def replay(roles: list[int | None], start: int, end: int | None) -> list[tuple[str, int, list[int]]]:
    """(action, role, empty turns before) of each message on the cheapest way; end None: whatever is cheapest to close."""
    best = np.full((len(roles) + 1, 4), FAR)
    best[len(roles)] = END if end is None else FAR
    if end is not None:
        best[len(roles), end] = 0
    for i in range(len(roles) - 1, -1, -1):
        for s in range(4):
            best[i, s] = min(int(cost + best[i + 1, to]) for cost, to, *_ in STEP[roles[i]][s])
    out, state = [], start
    for i, role in enumerate(roles):
        _, to, action, taken, before = min(STEP[role][state], key=lambda o: int(o[0] + best[i + 1, o[1]]))
        out.append((action, taken, before))
        state = to
    return out


def repair(roles: list[str | None]) -> tuple[list[tuple[str, int, list[int]]], int]:
    """A whole conversation's repair and its cost."""
    codes = [code_of(r) for r in roles]
    steps = replay(codes, START, None)
    total = int((matrix(codes)[START] + END).min())
    return steps, total // TURNS


def _runs(batch: pa.RecordBatch) -> list[tuple[int | None, int, int]]:
    """(conversation, first row, row after the last) where the conversation stays the same."""
    if not batch.num_rows:
        return []
    conv = batch.column("conv_id")
    ids, missing = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1])) + 1).tolist(), batch.num_rows]
    return [(None if missing[a] else int(ids[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the first and the last conversation of a partition: its matrix here."""
    found: list = []  # [conversation, matrix]: the first, and the last so far
    for batch in batches:
        runs, roles = _runs(batch), batch.column("role").to_pylist()
        for k, (conv, a, b) in enumerate(runs):
            goes_on = bool(found) and found[-1][0] == conv
            if not goes_on and found and k + 1 < len(runs):
                continue  # begins and ends inside
            m = matrix([code_of(r) for r in roles[a:b]])
            if goes_on:
                found[-1][1] = product(found[-1][1], m)
            else:
                found = [*found[:1], [conv, m]]
    pid = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_pydict({
        "pid": pa.array([pid] * len(found), pa.int32()), "nth": pa.array(range(len(found)), pa.int32()), "conv_id": pa.array([f[0] for f in found], pa.int64()), "m": pa.array([f[1].ravel().tolist() for f in found], pa.list_(pa.int64())),
    })


def plan_borders(borders: list) -> dict[tuple[int, object], tuple[int, int | None, int]]:
    """(partition, conversation) -> state on entry, state on exit (None: the end), turns made before."""
    spans: dict[object, list] = {}
    for b in sorted(borders, key=lambda b: (b[0], b[1])):
        spans.setdefault(b[2], []).append((b[0], np.array(b[3], np.int64).reshape(4, 4)))
    out = {}
    for conv, parts in spans.items():
        if len(parts) == 1:
            continue
        ahead = [END]
        for _, m in reversed(parts):
            ahead.append((m + ahead[-1][None, :]).min(axis=1))
        ahead.reverse()  # ahead[i]: cheapest way on from each state before part i
        state, done = START, 0
        for i, (pid, m) in enumerate(parts):
            last = i + 1 == len(parts)
            to = int((m[state] + ahead[i + 1]).argmin())
            out[pid, conv] = (state, None if last else to, done)
            done += int(m[state, to] % TURNS)
            state = to
    return out


def _render(header: str, footer: str, glue: str):
    turn = {role: header.format(role=name) for role, name in NAMES.items()}

    def run(conv: int | None, turns: list, texts: list, steps: list, made: int, ends: bool) -> Iterator[tuple]:
        state, is_open = START, made > 0
        for (action, role, before), turn_no, text in zip(steps, turns, texts):
            if action == "merge":
                yield conv, made - 1, NAMES[role], "merge", turn_no, glue + (text or "")
            else:
                for filler in before:
                    yield conv, made, NAMES[filler], "insert", None, (footer if is_open else "") + turn[filler]
                    made, is_open = made + 1, True
                yield conv, made, NAMES[role], action, turn_no, (footer if is_open else "") + turn[role] + (text or "")
                made, is_open = made + 1, True
            state = role
        if ends:
            for filler in END_FILL[state]:
                yield conv, made, NAMES[filler], "insert", None, footer + turn[filler]
                made += 1
            yield conv, made, "", "close", None, footer

    return run


#: Conversations of up to so many messages are replayed once for each sequence of roles (at most REPLAYS are kept).
SHORT, REPLAYS = 64, 20_000


@lru_cache(maxsize=REPLAYS)
def _replay(codes: tuple, start: int, end: int | None) -> list:
    return replay(list(codes), start, end)


def _formatter(shared, header: str, footer: str, glue: str):
    render = _render(header, footer, glue)
    names = ("conv_id", "turn_no", "role", "action", "source_turn", "piece", "piece_no")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, pid = shared.value, TaskContext.get().partitionId()
        made, number = [], pid << 33
        conv, open_run, roles, turns, texts = None, False, [], [], []

        def finish() -> None:
            start, end, done = plan.get((pid, conv), (START, None, 0))
            codes = tuple(map(code_of, roles))
            steps = _replay(codes, start, end) if len(codes) <= SHORT else replay(list(codes), start, end)
            made.extend(render(conv, turns, texts, steps, done, end is None))

        def flush() -> pa.RecordBatch:
            nonlocal number
            columns = list(zip(*made))
            out = [pa.array(c, t) for c, t in zip([*columns, range(number, number + len(made))], types)]
            number += len(made)
            made.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            own = [batch.column(c).to_pylist() for c in ("role", "turn", "text")]
            for this, a, b in _runs(batch):
                if open_run and this != conv:
                    finish()
                    roles, turns, texts = [], [], []
                conv, open_run = this, True
                roles += own[0][a:b]
                turns += own[1][a:b]
                texts += own[2][a:b]
            if made:
                yield flush()
        if open_run:
            finish()
            yield flush()

    return run


def format_chats(conversations: DataFrame, header: str = "<|{role}|>\n", footer: str = "<|end|>\n", glue: str = "\n\n") -> DataFrame:
    """Pieces of the repaired and rendered conversations.

    Columns: conv_id, turn_no (turn of the repaired conversation, from 0), role, action (keep, relabel, merge, insert,
    close), source_turn, piece, piece_no. A conversation's rendering is its pieces joined by piece_no; it is not joined
    here, as one conversation may hold a large share of all rows.

    Messages go by turn (null first), role and text. A null or unknown role costs a relabelling whatever it becomes; a
    null text is empty; a null conv_id is a conversation of its own. Repeated rows are messages of their own. An empty
    table gives an empty one; other columns are not read.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "text"]
    ranged = own.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    stored = durable(ranged.withColumn("pid", F.spark_partition_id()), "messages")
    rows = stored.repartitionById(parts, "pid") if hasattr(stored, "repartitionById") else None
    if rows is None:
        raise RuntimeError("repartitionById is needed (Spark 4.1)")
    rows = rows.sortWithinPartitions(*keys).drop("pid")
    found = rows.select("conv_id", "role").mapInArrow(_borders, "pid int, nth int, conv_id long, m array<long>").collect()  # two rows a partition at most
    plan = spark.sparkContext.broadcast(plan_borders([(r["pid"], r["nth"], r["conv_id"], r["m"]) for r in found]))
    schema = "conv_id long, turn_no long, role string, action string, source_turn long, piece string, piece_no long"
    return rows.mapInArrow(_formatter(plan, header, footer, glue), schema)
