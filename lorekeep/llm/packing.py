"""Best-fit packing: a configuration linear program over the histogram of piece lengths."""

from __future__ import annotations

import math
import os
import random
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, saved

#: Words whose ids a Python worker remembers, about 200 bytes each, and bytes of text it takes at a time.
CACHED_WORDS, BLOCK_BYTES = 800_000, 4 << 20
#: New words that the tokenizer gets at a time.
AT_ONCE = 4096
#: Marks at a word's end that the tokenizer always parts from a letter before them.
TAIL = b".,;:!?"
#: Partition ids stand above this many bits of monotonically_increasing_id().
ROW_BITS = 33
#: The lengths of a sequence's pieces, the longest first.
Pattern = tuple[int, ...]


@lru_cache(maxsize=4096)
def ends_in_letter(c: str) -> bool:
    """Whether a character still ends in a letter once composed and lower-cased; some turn into a letter and a mark."""
    return unicodedata.normalize("NFC", c).lower()[-1].isalpha()


class Ids:
    """Token ids of UTF-8 texts as little-endian 32-bit bytes.

    The tokenizer lower-cases and never joins across white space, so ids of words are remembered: A-Z lower-cased, and
    marks after a last letter on their own. Texts with ``<|``, where a special token's case counts, keep theirs.
    Tasks already use all cores, so the tokenizer's own threads are off.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens that close a word of the tokenizer, of which a run of letters is one.
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def recalled(self, words: set[bytes]) -> set[bytes]:
        """Those of ``words`` that the older half doesn't know either; the others are known from now on."""
        again = words & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        return words - again

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > CACHED_WORDS // 2:  # words that are not met again go with the older half
            self.older, self.known = self.known, {}
        known = self.known
        new = self.recalled(words - known.keys())
        parts = {}
        for w in new:
            body = w.rstrip(TAIL)
            if 0 < len(body) < len(w) and ends_in_letter(body.decode()[-1]):
                parts[w] = body, w[len(body) :]
        need = self.recalled({p for pair in parts.values() for p in pair}.union(new).difference(parts, known))
        letters = [w for w in need if w.decode().isalpha()]
        need.difference_update(letters)
        for i in range(0, len(letters), AT_ONCE):
            part = letters[i : i + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.is_end[ids]) + 1)
            if len(ends) != len(part):  # a letter that turns into two marks makes two words of one
                need.update(part)
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        need = list(need)
        for i in range(0, len(need), AT_ONCE):
            part = need[i : i + AT_ONCE]
            codes = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update((w, array("I", c.ids).tobytes()) for w, c in zip(part, codes))
        for w, (body, tail) in parts.items():
            known[w] = known[body] + known[tail]

    def __call__(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        block, size = [], 0
        for raw in texts:
            block.append((raw if b"<|" in raw else raw.lower()).split())
            size += len(raw)
            if size > BLOCK_BYTES:
                yield from self.block(block)
                block, size = [], 0
        yield from self.block(block)

    def block(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        self.learn(set().union(*texts))
        return (b"".join(map(self.known.__getitem__, words)) for words in texts)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def shared_ids(path: str) -> Ids:
    """One tokenizer and one memory of words for all tasks that a Python worker runs."""
    return Ids(path)


def pieces_of(docs: DataFrame, capacity: int, id_col: str, text_col: str, path: str | None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, step = shared_ids(path or tokenizer_path()), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for k, raw in enumerate(ids(batch.column("text").to_pylist())):
                raw += end
                rows += [(k, i // step, i // 4, len(raw[i : i + step]) // 4, zlib.crc32(raw[i : i + step])) for i in range(0, len(raw), step)]
            at, *columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [batch.column("doc_id").take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@lru_cache(maxsize=1)
def knapsack(value: bytes, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By the knapsack recursion the most value that fits into each room, and the piece that is put in last (0: none)."""
    best, last, room = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.empty(capacity)
    worth = np.frombuffer(value)[1:][::-1].copy()  # worth[capacity - l] is that of length l
    for c in range(1, capacity + 1):
        gain = np.add(best[:c], worth[capacity - c :], out=room[:c])  # entry i: length c - i on top of i
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], last[c] = gain[i], c - i
        else:
            best[c] = best[c - 1]
    return best, last


def best_pattern(value: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each length in the sequence of most value. ``value[l]`` is a piece's; 0: unused."""
    _, last = knapsack(np.asarray(value, float).tobytes(), capacity)
    out, c = np.zeros(capacity + 1, np.int64), capacity
    while c:
        out[last[c]] += 1
        c -= max(1, int(last[c]))
    out[0] = 0
    return out


def responses(prices: np.ndarray, there: np.ndarray, capacity: int, near: float) -> list[Pattern]:
    """For each length the best pattern that holds it, from one table, if it is worth at least 1 - ``near`` of the best; dearest pieces first."""
    best, last = knapsack(prices.tobytes(), capacity)
    own = np.flatnonzero(there)
    first = own[prices[own] + best[capacity - own] >= (1 - near) * best[capacity]]
    room, columns = capacity - first, [first]
    while room.any():
        columns.append(last[room])
        room = room - np.maximum(last[room], room > 0)
    rows = np.unique(np.sort(np.stack(columns, axis=1), axis=1)[:, ::-1], axis=0)
    rows = rows[np.argsort(-prices[rows].max(axis=1), kind="stable")]
    return [tuple(x for x in r if x) for r in rows.tolist()]


def sequences(plan: list[tuple[np.ndarray, int]]) -> int:
    return sum(times for _, times in plan)


@lru_cache(maxsize=1 << 16)
def lengths_of(pattern: Pattern) -> tuple[tuple[int, int], ...]:
    return tuple(Counter(pattern).items())


def take(left, pattern: Pattern, most: float = np.inf) -> float:
    """Uses ``pattern`` as often as what is left of its scarcest length allows, at most ``most`` times."""
    times, pieces = most, lengths_of(pattern)
    for l, k in pieces:
        times = min(times, left[l] / k)
    if times:
        for l, k in pieces:
            left[l] -= times * k
    return times


def fullest(room: int, left, order: list[int]) -> Pattern:
    """Pieces of what is left that fill ``room`` best; of equal fills the one with lengths early in ``order``.

    Sums within reach are the bits of one number. Few pieces are tried first, and four times as many until none is lacking.
    """
    some, able, mask = 32, [], (1 << room + 1) - 1
    there = (l for l in order if l <= room and left[l] > 1e-9 for _ in range(min(math.ceil(left[l] - 1e-9), room // l)))
    while True:
        able += islice(there, some - len(able))
        tried, reach = able[::-1], [1]
        for l in tried:
            reach.append((reach[-1] | reach[-1] << l) & mask)
        if reach[-1] >> room or some > len(able):
            break
        some *= 4
    c, out = reach[-1].bit_length() - 1, []
    for l, before in zip(reversed(tried), reversed(reach[:-1])):
        if c >= l and before >> c - l & 1:
            out.append(l)
            c -= l
    return tuple(out)


def covered(left: dict[int, float], prices, capacity: int, whole: bool = True) -> dict[Pattern, float]:
    """Everything that is left in the fullest patterns, each with the dearest length that is still there."""
    order, plan = sorted(left, key=lambda l: (-prices[l], -l)), Counter()
    for at, l in enumerate(order):
        while left[l] > 1e-9:
            left[l] -= 1
            pattern = tuple(sorted((l, *fullest(capacity - l, left, order[at:])), reverse=True))
            left[l] += 1
            most = min(left[x] // k for x, k in lengths_of(pattern)) if whole else np.inf
            plan[pattern] += take(left, pattern, most)
    return plan


def program(counts: np.ndarray, capacity: int, rounds: int | None, rate: float, near: float = 0.02) -> tuple[dict[Pattern, float], float, np.ndarray]:
    """The program's fractional solution by multiplicative weights, a lower bound from its dual, and the last prices.

    Prices start at the share of a sequence that a piece fills. A round prices patterns by one knapsack table and
    answers with all patterns near the best, none beyond the counts; the prices of what the answer covers are multiplied
    by exp(-rate * share covered), so the next answers turn to what was left out. The solution is the mean of all
    answers, scaled to the volume, cut where it covers too much and filled up where it covers too little, so it holds
    each length's count exactly. Prices divided by the value of their best pattern solve the dual, so what all pieces
    cost at them bounds the number of sequences from below. Rounds end when solution and bound are within one
    sequence or a thousandth, else after ln(lengths) / 0.23 ** 2 of them, the number that bounds the error of the mean.
    """
    lengths, there = np.arange(capacity + 1), counts > 0
    share = lengths / capacity
    prices, mean, seen = np.where(there, share, 0.0), Counter(), np.zeros(capacity + 1)
    bound = volume = float(share @ counts)
    rounds = rounds or int(np.ceil(np.log(max(2, there.sum())) / 0.23**2))
    solution: dict[Pattern, float] = {}
    for n in range(1, rounds + 1):
        if not there.any():
            break
        bound = max(bound, float(prices @ counts) / float(best_pattern(prices, capacity) @ prices))
        left = counts.astype(float)
        for pattern in responses(prices, there, capacity, near):
            mean[pattern] += take(left, pattern)
        share_covered = np.where(there, 1 - left / np.maximum(counts, 1), 0.0)
        seen += share_covered
        if n == rounds or not n & n - 1:  # the gap is taken after 1, 2, 4, 8... rounds
            scale, left, solution = volume / float((seen * share) @ counts), counts.astype(float), Counter()
            for pattern, x in sorted(mean.items(), key=lambda u: (-u[1], u[0])):
                solution[pattern] += take(left, pattern, scale * x)
            solution.update(covered({int(l): float(left[l]) for l in np.flatnonzero(left > 1e-9)}, prices, capacity, whole=False))
            if sum(solution.values()) <= bound + max(1, bound / 1000):
                break
        prices = prices * np.exp(-rate * share_covered)
        prices = prices / prices.max()
    return {p: x for p, x in solution.items() if x > 0}, bound, prices


def as_counts(pattern: Pattern, capacity: int) -> np.ndarray:
    return np.bincount(pattern, minlength=capacity + 1)


def solved(counts: np.ndarray, capacity: int, rounds: int | None, rate: float) -> tuple[list[tuple[np.ndarray, float]], float]:
    solution, bound, _ = program(counts, capacity, rounds, rate)
    return [(as_counts(p, capacity), x) for p, x in solution.items()], bound


def fractional(counts: np.ndarray, capacity: int, rounds: int | None, rate: float) -> list[tuple[np.ndarray, float]]:
    return solved(counts, capacity, rounds, rate)[0]


def capped_pattern(value: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """``best_pattern`` with no more of a length than ``counts`` has: lengths that run out leave, the room is priced again."""
    value, out, room = np.where(counts > 0, value, 0.0), np.zeros(capacity + 1, np.int64), capacity
    while room > 0 and value[: room + 1].any():
        more = best_pattern(value[: room + 1], room)
        if not more.any():
            break
        out[: room + 1] += np.minimum(more, (counts - out)[: room + 1])
        value[out >= counts] = 0.0
        room = capacity - int((out * np.arange(capacity + 1)).sum())
    return out


def improved(plan: dict[Pattern, int], prices, capacity: int, least: int, tries: int, some: int = 80) -> dict[Pattern, int]:
    """Opens the ``some`` emptiest sequences and as many others again and again, and packs them anew at slightly other prices.

    What is better stays: fewer sequences, or as many with room in fewer of them. At ``least`` sequences there is no
    better; ``tries`` without one sequence less are the end, too.
    """
    rng, total, idle = random.Random(1), sum(plan.values()), 0
    while total > least and idle < tries:
        idle += 1
        opened: Counter = Counter()
        for pattern in sorted((p for p in plan if sum(p) < capacity), key=lambda p: (sum(p), p)):
            opened[pattern] = min(plan[pattern], some - opened.total())
            if opened.total() >= some:
                break
        for pattern in rng.sample(sorted(plan), min(some, len(plan))):
            opened[pattern] += opened[pattern] < plan[pattern]
        pieces: Counter = Counter()
        for pattern, times in opened.items():
            for l in pattern:
                pieces[l] += times
        again = covered(dict(pieces), {l: prices[l] * rng.uniform(0.8, 1.25) for l in pieces}, capacity)
        full = lambda part: (-sum(part.values()), sum(sum(p) ** 2 * t for p, t in part.items()))
        if full(again) >= full(opened):
            if sum(again.values()) < opened.total():
                total, idle = total + int(sum(again.values())) - opened.total(), 0
            plan = Counter(plan)
            plan.subtract(opened)
            plan = +plan
            plan.update({p: int(t) for p, t in again.items()})
    return plan


def packed(counts: np.ndarray, capacity: int, rounds: int | None = None, rate: float = 0.02, tries: int = 100) -> dict[Pattern, int]:
    """Patterns and how often each is used; together they hold exactly ``counts`` pieces of each length.

    The program: fewest patterns that cover every length's count. Its fractional solution (see ``program``) is rounded
    to the nearest whole uses that the counts allow, what this leaves is packed in the fullest patterns by the last
    prices, and the rounding's loss is worked off (see ``improved``). All of it works on one count for each length,
    whatever the number of pieces.
    """
    counts = counts.astype(np.int64)
    solution, bound, prices = program(counts, capacity, rounds, rate)
    left = {int(l): int(counts[l]) for l in np.flatnonzero(counts)}
    plan: Counter = Counter()
    for pattern, x in sorted(solution.items(), key=lambda u: (-u[1], u[0])):
        times = min(int(x + 0.5), *(left[l] // k for l, k in Counter(pattern).items()))
        if times > 0:
            plan[pattern] += int(take(left, pattern, times))
    plan.update({p: int(t) for p, t in covered(left, prices, capacity).items()})
    return improved(plan, prices, capacity, int(np.ceil(bound - 1e-6)), tries)


def pack_histogram(counts: np.ndarray, capacity: int, rounds: int | None = None, rate: float = 0.02) -> list[tuple[np.ndarray, int]]:
    """``packed`` with patterns as counts of each length."""
    return [(as_counts(p, capacity), t) for p, t in packed(counts, capacity, rounds, rate).items()]


def places(plan: dict[Pattern, int]) -> dict[str, np.ndarray]:
    """Where the r-th piece in order of length goes: runs in that order, each with its first sequence and offset."""
    runs, at = [], 0
    for pattern, times in plan.items():
        offset = 0
        for length, each in Counter(pattern).items():
            runs.append((length, times * each, at, each, offset))
            offset += length * each
        at += times
    runs.sort(key=lambda r: r[0])
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return {"first": np.cumsum(columns[1]) - columns[1], "sequence": columns[2], "each": columns[3], "offset": columns[4]}


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str | None = None,
    rounds: int | None = None,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and a closing id 0; null and empty texts are the closing id alone. Sequences have
    no gaps and at most ``capacity`` ids. Pieces are dealt by ranges of their length, written, and numbered by their
    place in a range and the rows of the ranges before it, so any length may be frequent; only one count for each length
    and for each range reaches the driver, and the plan that goes back has a few runs for each length.
    Rows that share an id are packed each on their own; ids may be of any type; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = saved(pieces_of(docs, capacity, id_col, text_col, tokenizer_file))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    plan = places(packed(counts, capacity, rounds))
    ranges, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ["length", "uid"]
    dealt = pieces.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = saved(dealt.drop("uid").withColumn("at", F.monotonically_increasing_id()))
    sizes = dict(dealt.groupBy(F.shiftright("at", ROW_BITS)).count().collect())
    plan["before"] = np.zeros(max(sizes, default=0) + 1, np.int64)
    for k in range(1, len(plan["before"])):
        plan["before"][k] = plan["before"][k - 1] + sizes.get(k - 1, 0)
    sent = spark.sparkContext.broadcast(plan)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("at").to_numpy()
            whole = p["before"][at >> ROW_BITS] + (at & (1 << ROW_BITS) - 1)
            run = np.searchsorted(p["first"], whole, "right") - 1
            turn = whole - p["first"][run]
            sequence = p["sequence"][run] + turn // p["each"][run]
            offset = p["offset"][run] + turn % p["each"][run] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(put, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
