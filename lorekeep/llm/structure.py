"""Conversation structure repair: an error-correcting Earley parse of the roles, at least cost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_strip, quoted, saved, table
from .resampling import CRC32

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
OPEN, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Rows of one conversation that are parsed at a time; longer ones are joined from parts.
CHUNK = 4096
FAULTS = ("blank", "duplicate", "truncated")
FORCED = ("blank", "duplicate")


class Costs(NamedTuple):
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Production(NamedTuple):
    """``lhs -> left terminal``: a conversation that ends in ``lhs`` is one that ends in ``left`` and one turn more.

    The terminal is a turn that is kept if it begins with ``initial``, any turn given another role, any turn deleted,
    or nothing at all, for which a turn is inserted.
    """

    lhs: int
    left: int
    edit: str
    initial: str = ""


#: Legal: nothing, or an optional system turn and pairs of user and assistant.
GRAMMAR = [
    *[Production(n, n, DELETE) for n in (OPEN, SYSTEM, USER, ASSISTANT)],
    Production(SYSTEM, OPEN, KEEP, "s"),
    *[Production(USER, left, edit, "u") for left in (OPEN, SYSTEM, ASSISTANT) for edit in (KEEP, REROLE, INSERT)],
    *[Production(ASSISTANT, USER, edit, "a") for edit in (KEEP, REROLE, INSERT)],
]
ACCEPTED = (OPEN, ASSISTANT)
#: What the predictor adds once a symbol is complete: [lhs -> left . terminal]. Every item starts at row 0, as the grammar is left-linear.
PREDICTED = {n: [p for p in GRAMMAR if p.left == n] for n in (OPEN, SYSTEM, USER, ASSISTANT)}

#: A chart item: cost, rank of its audit up to the last row among those of its column, edits since then, and its symbol then.
Item = tuple[int, int, str, int]


def retain(column: dict[int, Item], symbol: int, item: Item) -> bool:
    """A symbol keeps its least (cost, audit): audits of one column differ before either ends, so ranks and edits order them."""
    if symbol in column and column[symbol] <= item:
        return False
    column[symbol] = item
    return True


def completed(base: dict[int, tuple[int, int]], costs: Costs) -> dict[int, Item]:
    """The column with insertions: a completed symbol completes those that follow it by an inserted turn, cheapest first."""
    column: dict[int, Item] = {n: (cost, rank, "", n) for n, (cost, rank) in base.items()}
    agenda = set(column)
    while agenda:
        n = min(agenda, key=column.__getitem__)
        agenda.remove(n)
        cost, rank, edits, since = column[n]
        for p in PREDICTED[n]:
            if p.edit == INSERT and retain(column, p.lhs, (cost + costs.insert, rank, edits + INSERT, since)):
                agenda.add(p.lhs)
    return column


def scanned(column: dict[int, Item], initial: str, fault: str | None, costs: Costs) -> dict[int, Item]:
    """The next column's items over one row."""
    out: dict[int, Item] = {}
    late = costs.truncated if fault == "truncated" else 0
    for n, (cost, rank, edits, since) in column.items():
        for p in PREDICTED[n]:
            if p.edit == DELETE:
                retain(out, p.lhs, (cost + costs.delete, rank, edits + DELETE, since))
            elif p.edit != INSERT and fault not in FORCED and (p.edit == REROLE or p.initial == initial):
                retain(out, p.lhs, (cost + late + (costs.rerole if p.edit == REROLE else 0), rank, edits + p.edit, since))
    return out


def ranked(column: dict[int, Item]) -> dict[int, tuple[int, int]]:
    """(cost, rank of the whole audit) of each symbol, once the column's row has been read."""
    order = sorted(column, key=lambda n: column[n][1:3])
    return {n: (column[n][0], k) for k, n in enumerate(order)}


def chart(rows: list[tuple[str, str | None]], start: int, costs: Costs) -> tuple[dict[int, tuple[int, int]], list[dict[int, Item]]]:
    """The last column's (cost, rank) of each symbol, and all columns' items, from which a repair is read back."""
    base, columns = {start: (0, 0)}, []
    for initial, fault in rows:
        columns.append(scanned(completed(base, costs), initial, fault, costs))
        base = ranked(columns[-1])
    return base, columns


def closing(base: dict[int, tuple[int, int]], costs: Costs) -> Item:
    column = completed(base, costs)
    return min(column[n] for n in ACCEPTED if n in column)


def edits_of(columns: list[dict[int, Item]], end: int) -> list[str]:
    """For each row the turns inserted before it and its own edit, on the way to ``end``."""
    out = []
    for column in reversed(columns):
        _, _, edits, end = column[end]
        out.append(edits)
    return out[::-1]


def joined(tables: list[list[dict[int, tuple[int, int]]]], costs: Costs) -> list[tuple[int, int]]:
    """Entry and exit symbol of each part of one conversation; ``tables[i][s]`` is the last column of a chart begun at s."""
    base, steps = {OPEN: (0, 0)}, []
    for t in tables:
        step: dict[int, tuple] = {}
        for s, (cost, rank) in base.items():
            for end, (more, place) in t[s].items():
                if end not in step or (cost + more, rank, place) < step[end][:3]:
                    step[end] = (cost + more, rank, place, s)
        order = sorted(step, key=lambda n: step[n][1:3])
        base = {n: (step[n][0], k) for k, n in enumerate(order)}
        steps.append(step)
    end, out = closing(base, costs)[3], []
    for step in reversed(steps):
        out.append((step[end][3], end))
        end = step[end][3]
    return out[::-1]


def follow(state: int, edits: str, initial: str) -> tuple[list[str], int]:
    """Roles of the inserted turns and the symbol after ``edits``."""
    added = []
    for e in edits:
        if e == KEEP:
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
        elif e != DELETE:
            state = ASSISTANT if state == USER else USER
        if e == INSERT:
            added.append(ROLES[state])
    return added, state


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, number of the chunk in this partition, rows) of a sorted partition."""
    held, key, n = [], None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv"] != key or len(held) == CHUNK):
                yield key, n, held
                held, n = [], n + 1 if row["conv"] == key else 0
            key = row["conv"]
            held.append(row)
    if held:
        yield key, n, held


def marked(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, digest, copy, fault), one row for each turn: what is wrong with it, the first fault only.

    Rows equal in all four columns are counted before they move, and then told apart by ``copy``, so any number of
    them spreads over tasks. Of equal role and text the first in order stays; only keys met at several turns are joined.
    """
    text_of = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    plain = turns.select(quoted(conv_col).alias("conv"), quoted(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    plain = plain.withColumn("digest", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = plain.groupBy("conv", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("NOT (first <=> last)")
    once = plain.groupBy("conv", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), F.col("first").alias("_first"))
    met = once.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    seen = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(at)
    each = met.withColumn("seen", seen).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    bare = ascii_strip(F.col("text"))
    fault = F.when(bare == "", FAULTS[0]).when(F.col("seen") | (F.col("copy") > 0), FAULTS[1]).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), FAULTS[2])
    return each.select("conv", "turn", "role", "text", "digest", "copy", fault.alias("fault"))


def repair_structure(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs()
) -> DataFrame:
    """One row for each turn with its fault and its edit in the cheapest legal conversation.

    Columns: conv, turn, at (orders the rows of a conversation), role, text, fault (blank, duplicate, truncated or null),
    edit (K keep, R rerole, D delete), role_out (null if deleted), inserted (roles of empty turns put before it),
    closing (roles of empty turns after the last one), cost. Legal: nothing, or an optional system turn and pairs of
    user and assistant turns, by their roles' first letters. Blank and duplicate turns must go. Of equally cheap repairs
    the one whose edits, I for an inserted turn, read first in ASCII order is taken.

    Turns come in order of turn, nulls first, then of role and of a digest of role and text. Null roles and texts are
    one space; other roles fit nothing and are given one or deleted. A null conversation is one conversation. Repeated
    rows are duplicates. An empty table gives no rows. Ids and turns may be of any type that sorts; other columns are
    not read. Turns are dealt by ranges of that order, so a conversation of any length spreads over tasks and is
    parsed ``CHUNK`` rows at a time; the tables of (cost, rank) from symbol to symbol of the chunks of a long or cut
    conversation, 32 numbers each, are joined on the driver.
    """
    spark = turns.sparkSession
    rows = marked(turns, conv_col, turn_col, role_col, text_col)
    order = ["conv", "turn", "role", "digest", "copy"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("digest", "copy")
    dealt = saved(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    conv, turn = dealt.schema["conv"].dataType.simpleString(), dealt.schema["turn"].dataType.simpleString()
    codes = lambda rows: [(r["role"][:1], r["fault"]) for r in rows]
    symbols = (OPEN, SYSTEM, USER, ASSISTANT)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tables of what the range may have cut, its first and last conversation, and of what is longer than a chunk."""
        out, own, first = [], [], True

        def told() -> None:
            for part, name, n, rows in own:
                ends = [chart(rows, s, costs)[0] for s in symbols]
                out.append((part, name, n, [x for t in ends for e in symbols for x in t.get(e, (-1, -1))]))

        for name, n, rows in chunks(batches):
            if n == 0 and own:
                if first or len(own) > 1:
                    told()
                own, first = [], False
            own.append((rows[0]["part"], name, n, codes(rows)))
        told()
        kinds = [pa.int32(), kind, pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["part", "conv", "chunk", "ends"])

    kind = pa_type(dealt, "conv")
    narrow = dealt.select("part", "conv", F.substring("role", 1, 1).alias("role"), "fault")
    found = narrow.mapInArrow(cuts, f"part int, conv {conv}, chunk int, ends array<long>").collect()
    parts: dict = {}
    for r in sorted(found, key=lambda r: (r.part, r.chunk)):
        pairs = [tuple(r.ends[i : i + 2]) for i in range(0, 32, 2)]
        ends = [{e: pairs[4 * s + e] for e in symbols if pairs[4 * s + e][0] >= 0} for s in symbols]
        parts.setdefault(r.conv, []).append(((r.part, r.chunk), ends))
    states = {(c, *key): (*e, key == own[-1][0]) for c, own in parts.items() if len(own) > 1 for (key, _), e in zip(own, joined([t for _, t in own], costs))}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, n, rows in chunks(batches):
            state, end, final = states.get((name, rows[0]["part"], n), (OPEN, None, True))
            base, columns = chart(codes(rows), state, costs)
            last = closing({end: (0, 0)} if end is not None else base, costs) if final else (0, 0, "", end)
            out = []
            for r, edits in zip(rows, edits_of(columns, last[3])):
                added, state = follow(state, edits, r["role"][:1])
                edit = edits[-1]
                cost = costs.insert * len(added) + (costs.delete if edit == DELETE else costs.rerole * (edit == REROLE) + costs.truncated * (r["fault"] == "truncated"))
                role = None if edit == DELETE else r["role"] if edit == KEEP else ROLES[state]
                out.append([name, r["turn"], r["at"], r["role"], r["text"], r["fault"], edit, role, added, [], cost])
            out[-1][9] = follow(state, last[2], "")[0]
            out[-1][10] += costs.insert * len(out[-1][9])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), out_kinds)], out_names)

    out_names = ["conv", "turn", "at", "role", "text", "fault", "edit", "role_out", "inserted", "closing", "cost"]
    text, texts = pa.string(), pa.list_(pa.string())
    out_kinds = [kind, pa_type(dealt, "turn"), pa.int64(), text, text, text, text, text, texts, texts, pa.int64()]
    schema = f"conv {conv}, turn {turn}, at long, role string, text string, fault string, edit string, role_out string, inserted array<string>, closing array<string>, cost long"
    return dealt.mapInArrow(write, schema)


def pa_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with every twentieth turn lost, emptied, cut short, repeated or given to the user, by its checksum."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn"))) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), act.alias("act"))
    text: Column = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "act").where("act <> 0")
    return rows.withColumn("copy", F.explode(F.expr("CASE WHEN act = 3 THEN array(0, 1) ELSE array(0) END"))).drop("act", "copy")


def summary(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each of ``conversations`` (conv): faults, cost, edits in order and the digest of the repaired text.

    A digest reads a conversation from end to end, so one task does; it holds one Arrow batch of rows at a time and the
    edits. Conversations without rows have zeros, no edits and the digest of nothing. Turns must be whole numbers.
    """
    kind = repaired.schema["conv"].dataType.simpleString()
    turn = F.col("turn").cast("long").alias("turn")
    names = ["conv", "at", turn, "role", "text", "fault", "edit", "role_out", "inserted", "closing", "cost"]
    rows = repaired.select(*names).unionByName(conversations.select("conv", F.lit(-1).cast("long").alias("at")).distinct(), allowMissingColumns=True)
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "at")
    arrow = pa_type(repaired, "conv")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, own in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["conv"]):
            counts, audit, sha, turns, illegal, cost, before, parts = dict.fromkeys(FAULTS, 0), [], hashlib.sha256(), [0, None, None, None], 0, 0, None, 0

            def add(piece: str) -> None:
                nonlocal parts
                sha.update((b"\n" if parts else b"") + piece.encode())
                parts += 1

            for r in own:
                if r["at"] < 0:
                    continue
                if r["turn"] is not None and r["turn"] != turns[3]:
                    turns = [turns[0] + 1, r["turn"] if turns[1] is None else turns[1], r["turn"], r["turn"]]
                if r["fault"]:
                    counts[r["fault"]] += 1
                illegal += before is not None and before + r["role"][:1] not in ("su", "ua", "au")
                before, cost = r["role"][:1], cost + r["cost"]
                audit.append(INSERT * len(r["inserted"]) + r["edit"] + INSERT * len(r["closing"]))
                for role in r["inserted"]:
                    add(f"{role}:")
                if r["role_out"] is not None:
                    add(f"{r['role_out']}:{r['text']}")
                for role in r["closing"]:
                    add(f"{role}:")
            gaps = turns[2] - turns[1] + 1 - turns[0] if turns[0] else 0
            values = [name, gaps, *counts.values(), illegal, cost, "".join(audit), sha.hexdigest()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [arrow, *[pa.int64()] * 6, pa.string(), pa.string()])], out)

    out = ["conv", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    return dealt.mapInArrow(digest, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = summary(repair_structure(damaged(turns)), turns.select(F.col("conv_id").alias("conv")))
    return found.withColumnRenamed("conv", "conv_id")


def sql() -> str:
    """The same by a recursion over turns: for each end of a conversation the least (cost, edits) and its pieces."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    more = lambda x, c, e, piece="[]::VARCHAR[]": f"{{'v': lpad((substr({x}.v, 1, 9)::INT + {c})::VARCHAR, 9, '0') || substr({x}.v, 10) || '{e}', 'r': list_concat({x}.r, {piece})}}"
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    far = "{'v': '900000000', 'r': []::VARCHAR[]}"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {far} END"
    late, free = "CASE fault WHEN 'truncated' THEN 3 ELSE 0 END", "fault NOT IN ('blank', 'duplicate')"
    keep = lambda x, i: when(f"{free} AND ini = '{i}'", more(x, late, "K", "[role || ':' || text]"))
    rerole = lambda x, role: when(free, more(x, f"3 + {late}", "R", f"['{role}:' || text]"))
    user = ", ".join(f(x, n) for x in ("o", "s", "a1") for f, n in ((keep, "u"), (rerole, "user")))
    opened = lambda: least("u", *[more(x, 3, "I", "['user:']") for x in ("o", "s", "a")])
    paired = least("a", more("u1", 3, "I", "['assistant:']"))
    crc = CRC32.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS act FROM conversations),
hurt AS (SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role,
  CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE act WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM src),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i, left(role, 1) AS ini FROM hurt),
turned AS MATERIALIZED (SELECT *, CASE WHEN trim(text, {space}) = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(rtrim(text, {space}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed),
walk AS (SELECT conv_id, 0::BIGINT AS i, {{'v': '000000000', 'r': []::VARCHAR[]}} AS o, {far} AS s, {far} AS u, {far} AS a FROM (SELECT DISTINCT conv_id FROM src)
  UNION ALL SELECT conv_id, i, {more("o", 4, "D")}, {least(more("s", 4, "D"), keep("o", "s"))},
    {least(more("u1", 4, "D"), user)}, {least(more("a1", 4, "D"), keep("u1", "a"), rerole("u1", "assistant"))}
  FROM (SELECT *, {paired} AS a1 FROM (SELECT t.*, o, s, u, a, {opened()} AS u1 FROM walk w JOIN turned t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1))),
ended AS (SELECT conv_id, {least("o", "a1")} AS x FROM (SELECT *, {paired} AS a1 FROM (SELECT *, {opened()} AS u1 FROM walk
  WHERE i = coalesce((SELECT max(t.i) FROM turned t WHERE t.conv_id IS NOT DISTINCT FROM walk.conv_id), 0)))),
told AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turned GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, substr(x.v, 1, 9)::BIGINT AS cost, substr(x.v, 10) AS audit, sha256(array_to_string(x.r, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN told t ON e.conv_id IS NOT DISTINCT FROM t.conv_id
"""


SQL = sql()
