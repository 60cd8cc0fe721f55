"""Chat formatting: conversations repaired at least cost into legal turns, then rendered."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, saved

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: The automaton: a new turn that may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of the repairs, and the state a conversation ends in.
MERGE, INSERT, RELABEL = 1, 2, 3
FINAL = ASSISTANT
FAR = 10**15


def moves(role: int, state: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, next state, action, inserted roles) for a turn of ``role``; START as a role is an unknown one."""
    out = []
    if state != START:
        out.append((MERGE + (0 if role == state else RELABEL), state, "merge" if role == state else "relabel+merge", ()))
    paths = [(state, ())] + [(s, (s,)) for s in NEXT[state]]
    for at, added in paths:
        for new in NEXT[at]:
            act = "keep" if new == role else "relabel"
            out.append((INSERT * len(added) + (0 if new == role else RELABEL), new, act, added))
    return out


@lru_cache
def table(role: int) -> tuple[tuple[tuple[int, str, tuple[int, ...]] | None, ...], ...]:
    """The cheapest move from each state to each state; ties by fewer insertions, then by name."""
    rows = []
    for state in range(4):
        best: list = [None] * 4
        for cost, new, act, added in moves(role, state):
            if best[new] is None or (cost, len(added), act, added) < (best[new][0], len(best[new][2]), best[new][1], best[new][2]):
                best[new] = (cost, act, added)
        rows.append(tuple(best))
    return tuple(rows)


def ending(state: int) -> int:
    """Cost of closing a conversation: an empty last turn unless it ends as it should."""
    return 0 if state in (FINAL, START) else INSERT if FINAL in NEXT[state] else 2 * INSERT


def role_code(role) -> int:
    name = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(name) if name in ROLES[1:] else START


def forward(codes: list[int], start: list[int]) -> list[list[int]]:
    """Least costs of each state before the first turn and after every turn."""
    out = [start]
    for code in codes:
        own, last, now = table(code), out[-1], [FAR] * 4
        for s in range(4):
            if last[s] < FAR:
                for t, move in enumerate(own[s]):
                    if move and last[s] + move[0] < now[t]:
                        now[t] = last[s] + move[0]
        out.append(now)
    return out


def only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def transfer(codes: list[int]) -> list[list[int]]:
    """Least costs from each state to each state over a run of turns; such tables join end to end."""
    return [forward(codes, only(s))[-1] for s in range(4)]


def walk(codes: list[int], start: int, end: int | None) -> tuple[list[tuple[int, int, str, tuple[int, ...]]], int]:
    """The cheapest moves (cost, state, action, inserted) from ``start`` to ``end`` (None: whatever closes best), and the end."""
    costs = forward(codes, only(start))
    state = end if end is not None else min(range(4), key=lambda s: (costs[-1][s] + ending(s), s))
    last, back = state, []
    for i in range(len(codes) - 1, -1, -1):
        own = table(codes[i])
        before = min(
            (s for s in range(4) if costs[i][s] < FAR and own[s][state] and costs[i][s] + own[s][state][0] == costs[i + 1][state]),
            key=lambda s: s,
        )
        cost, act, added = own[before][state]
        back.append((cost, state, act, added))
        state = before
    return back[::-1], last


def join_runs(runs: list[tuple[int, list[list[int]]]]) -> dict[int, tuple[int, int]]:
    """Entry and exit state of each part of one conversation, from the parts' transfer tables in order."""
    costs = [only(START)]
    for _, t in runs:
        costs.append([min(costs[-1][s] + t[s][e] for s in range(4)) for e in range(4)])
    state, out = min(range(4), key=lambda s: (costs[-1][s] + ending(s), s)), {}
    for i in range(len(runs) - 1, -1, -1):
        part, t = runs[i]
        before = next(s for s in range(4) if costs[i][s] < FAR and costs[i][s] + t[s][state] == costs[i + 1][state])
        out[part] = (before, state)
        state = before
    return out


def segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(part, conversation, rows) for each conversation's rows in a sorted partition."""
    held: list = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            key = (row.part, None if pd.isna(row.conv) else row.conv)
            if held and held[0] != key:
                yield *held[0], held[1]
                held = []
            if not held:
                held = [key, []]
            held[1].append(row)
    if held:
        yield *held[0], held[1]


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each input turn with its place in the least-cost legal conversation.

    Columns: conv, turn, role_in, role_out, action (keep, merge, relabel, relabel+merge), inserted (roles of empty
    turns put before it), closing (roles of empty turns after the last one), cost, rendered. The rendered pieces of
    a conversation, in order of (turn, key), are its whole text. Legal: an optional system turn, then user and
    assistant in turn, the assistant last.

    Turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over tasks; parts of
    a conversation that ranges cut are joined by their tables of costs between states, of which a partition has two
    at most. Null or unknown roles are relabelled; null texts are empty; equal turn numbers are ordered by the hash
    of role and text; a null conversation is one conversation. An empty table gives no rows. Conversation ids and turn
    numbers are whole numbers; others raise. Only the named columns are read.
    """
    spark = turns.sparkSession
    plain = turns.select(
        quoted(conv_col).cast("long").alias("conv"),
        quoted(turn_col).cast("long").alias("turn"),
        F.xxhash64(quoted(role_col), quoted(text_col)).alias("key"),
        quoted(role_col).cast("string").alias("role"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    )
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv", "turn", "key"]
    dealt = saved(plain.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for part, conv, rows in segments(batches):
            found = (part, conv, [role_code(r.role) for r in rows])
            first, last = first or found, found
        rows = [(p, c, [x for line in transfer(codes) for x in line]) for p, c, codes in ([first, last] if first and first is not last else [first] if first else [])]
        out = pd.DataFrame(rows, columns=["part", "conv", "costs"])
        yield out.astype({"part": "int32", "conv": "Int64"})

    cut: dict = {}
    for r in dealt.mapInPandas(edges, "part int, conv long, costs array<long>").collect():  # two rows a partition at most
        cut.setdefault(r.conv, []).append((r.part, [list(r.costs[4 * i : 4 * i + 4]) for i in range(4)]))
    states = {(c, p): (*e, p == max(runs)[0]) for c, runs in cut.items() if len(runs) > 1 for p, e in join_runs(sorted(runs)).items()}

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        names = ["conv", "turn", "key", "role_in", "role_out", "action", "inserted", "closing", "cost", "rendered"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv": "Int64", "turn": "Int64"})
        for part, conv, rows in segments(batches):
            start, end, final = states.get((conv, part), (START, None, True))
            steps, last = walk([role_code(r.role) for r in rows], start, end)
            close = list(path_to_end(last)) if final else []
            for i, (r, (cost, state, act, added)) in enumerate(zip(rows, steps)):
                open_before = not (i == 0 and start == START)
                text = ("\n" if act.endswith("merge") else "") + r.text
                if not act.endswith("merge"):
                    text = ("<|end|>\n" if open_before else "") + "".join(f"<|{ROLES[a]}|>\n<|end|>\n" for a in added) + f"<|{ROLES[state]}|>\n{text}"
                done = final and i == len(rows) - 1
                if done:
                    text += "<|end|>\n" + "".join(f"<|{ROLES[a]}|>\n<|end|>\n" for a in close)
                shut = close if done else []
                out.append((r.conv, r.turn, r.key, r.role, ROLES[state], act, [ROLES[a] for a in added], [ROLES[a] for a in shut], cost + INSERT * len(shut), text))
            if len(out) >= 5000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    kinds = "conv long, turn long, key long, role_in string, role_out string, action string, inserted array<string>, closing array<string>, cost long, rendered string"
    return dealt.mapInPandas(write, kinds)


def path_to_end(state: int) -> tuple[int, ...]:
    """Roles of the empty turns that close a conversation."""
    return () if state in (FINAL, START) else (FINAL,) if FINAL in NEXT[state] else (USER, FINAL)


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(turns).withColumnRenamed("conv", "conv_id")
