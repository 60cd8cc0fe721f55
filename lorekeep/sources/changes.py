"""A streaming source over a change log whose offset is the position of the last row handed out."""

from __future__ import annotations

import sys
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice, pairwise, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Before every row.
START = (-(2**63), -(2**63))
#: Keys of row groups that the driver's side keeps between batches, 17 bytes each.
HELD = 2_000_000


class ChangeSource(DataSource):
    """S-14, ST-02, ST-03: ``spark.readStream.format("changes")`` over a folder of parquet files that rows are added to.

    Rows have ``recorded_us`` (microseconds), ``id`` and, in a feed, ``resolved``: a resolved row promises that nothing
    before it is still to come. Options: ``path``; ``mode``, feed or poll; ``limit``, the most rows of a batch;
    ``parts``, the tasks of a batch; ``batches``, how many of them a trigger may take at once, one by default.

    A feed's batch ends at the last resolved row within ``limit`` rows, so what no promise covers is not handed out;
    if there is none within ``limit`` but one beyond, it ends at the limit. A poll's batch ends at the limit or the last
    row. Either way its offset is ``(recorded_us, id)``, not a file, so a restart goes on behind the last row that was
    committed, however files were compacted meanwhile.

    Spark's own work for a trigger takes far longer than the rows of a small batch. A stream that is behind can therefore
    take several batches in one trigger: they end where they would have ended one by one, each has tasks of its own, so
    that no task hands out more than ``limit`` rows, and they are committed together.

    A batch reads only the row groups that its range of positions overlaps, each once. A log whose files follow its
    instants, whatever their order inside, is so read a bounded number of times; where every file has rows of every
    instant, every batch reads them all.
    """

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self):
        return from_arrow_schema(ds.dataset(self.options["path"], format="parquet").schema)

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options, schema)


class Slice(InputPartition):
    def __init__(self, low: tuple[int, int], high: tuple[int, int], groups: list[tuple[str, int]], files):
        self.low, self.high, self.groups, self.files = low, high, groups, files


def after(low: tuple[int, int]):
    at, key = pc.field("recorded_us"), pc.field("id")
    return (at > low[0]) | ((at == low[0]) & (key > low[1]))


def until(high: tuple[int, int]):
    return ~after(high)


class Keys:
    """Positions of rows in order, and which of them are promises."""

    def __init__(self, at: np.ndarray, key: np.ndarray, resolved: np.ndarray):
        order = np.lexsort((key, at))
        self.at, self.key, self.resolved = at[order], key[order], resolved[order]

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> tuple[int, int]:
        return int(self.at[i]), int(self.key[i])

    def rank(self, low: tuple[int, int]) -> int:
        """How many are at ``low`` or before it."""
        first, last = (int(np.searchsorted(self.at, low[0], side)) for side in ("left", "right"))
        return first + int(np.searchsorted(self.key[first:last], low[1], "right"))

    def promise(self) -> tuple[int, int]:
        found = np.flatnonzero(self.resolved)
        return self[found[-1]] if len(found) else START


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.path, self.kinds = options["path"], to_arrow_schema(schema)
        self.feed, self.limit, self.parts = options.get("mode", "feed") == "feed", int(options.get("limit", 100_000)), int(options.get("parts", 8))
        self.batches = int(options.get("batches", 1))
        self.last: tuple[int, int] | None = None
        self.planned: tuple[tuple[int, int], ...] = (START,)
        self.known: dict[tuple, list[tuple[int, int, str, int]]] = {}
        self.promises: dict[tuple[str, int], tuple[int, int]] = {}
        self.held: OrderedDict[tuple[str, int], Keys] = OrderedDict()

    def initialOffset(self) -> dict:
        return {"recorded_us": START[0], "id": START[1]}

    def groups(self) -> list[tuple[int, int, str, int]]:
        """(first, last instant, file, row group) of all that is there; footers are read of new files only."""
        rows = ds.dataset(self.path, format="parquet")
        self.files, parts = rows.filesystem, {f.path: f for f in rows.get_fragments()}
        infos = {(i.path, i.size, i.mtime_ns): i.path for i in self.files.get_file_info(list(parts))}
        if infos.keys() != self.known.keys():
            gone = {path for key, path in infos.items() if key not in self.known} | {key[0] for key in self.known if key not in infos}
            for kept in (self.held, self.promises):
                for group in [g for g in kept if g[0] in gone]:
                    del kept[group]
            self.known = {key: self.known[key] if key in self.known else list(self.bounds(parts[path])) for key, path in infos.items()}
            self.all = sorted(g for own in self.known.values() for g in own)
        return self.all

    def bounds(self, file) -> Iterator[tuple[int, int, str, int]]:
        for group in file.row_groups:
            stated = (group.statistics or {}).get("recorded_us")
            if stated:
                yield stated["min"], stated["max"], file.path, group.id
            elif len(keys := self.keys((file.path, group.id))):
                yield keys[0][0], keys[-1][0], file.path, group.id

    def rows(self, groups: list[tuple[str, int]], files, kinds=None) -> ds.FileSystemDataset:
        form, numbers = ds.ParquetFileFormat(), {}
        for path, number in groups:
            numbers.setdefault(path, []).append(number)
        parts = [form.make_fragment(path, files, row_groups=own) for path, own in numbers.items()]
        return ds.FileSystemDataset(parts, kinds or parts[0].physical_schema, form, files)

    def keys(self, group: tuple[str, int]) -> Keys:
        """The keys of one row group, from memory if it was asked for lately."""
        if group in self.held:
            self.held.move_to_end(group)
            return self.held[group]
        names = ["recorded_us", "id", *(["resolved"] if self.feed else [])]
        table = self.rows([group], self.files).to_table(columns=names, filter=pc.field("recorded_us").is_valid() & pc.field("id").is_valid())
        flags = table["resolved"].fill_null(False).to_numpy() if self.feed else np.zeros(len(table), bool)
        keys = Keys(table["recorded_us"].to_numpy(), table["id"].to_numpy(), flags)
        self.held[group] = keys
        while sum(map(len, self.held.values())) > HELD:
            self.held.popitem(last=False)
        return keys

    def promised(self, end: tuple[int, int]) -> bool:
        """Whether a promise stands behind ``end``; of each row group the last one is looked up once."""
        for _, last, path, number in sorted(self.all, key=lambda g: -g[1]):
            if last < end[0]:
                return False
            if (path, number) not in self.promises:
                self.promises[path, number] = self.keys((path, number)).promise()
            if self.promises[path, number] > end:
                return True
        return False

    def end(self, low: tuple[int, int]) -> tuple[int, int]:
        """Where the batch behind ``low`` ends: ``low`` itself if there is nothing to hand out."""
        first = Keys(*(np.zeros(0, kind) for kind in ("int64", "int64", "bool")))  # the next ``limit`` keys
        for begin, last, path, number in self.all:
            if last < low[0]:
                continue
            if len(first) == self.limit and begin > first[-1][0]:
                break
            own = self.keys((path, number))
            cut = slice(own.rank(low), own.rank(low) + self.limit)
            first = Keys(*(np.concatenate([getattr(k, c)[s] for k, s in ((first, slice(None)), (own, cut))]) for c in ("at", "key", "resolved")))
            first.at, first.key, first.resolved = first.at[: self.limit], first.key[: self.limit], first.resolved[: self.limit]
        if not len(first):
            return low
        end = first[-1]
        if self.feed:
            within = first.promise()
            end = within if within > START else (end if self.promised(end) else low)
        return end

    def ends(self, low: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """The ends of the batches behind ``low``, one after the other."""
        while (end := self.end(low)) > low:
            yield end
            low = end

    def latestOffset(self) -> dict:
        self.groups()
        low = self.last or START
        self.planned = (low, *islice(self.ends(low), self.batches))
        at, key = self.planned[-1]
        return {"recorded_us": at, "id": key}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        low, high = ((o["recorded_us"], o["id"]) for o in (start, end))
        self.last = high
        if low == high:
            return []
        self.groups()
        if (self.planned[0], self.planned[-1]) != (low, high):  # planned before a restart
            self.planned = (low, *takewhile(lambda end: end < high, self.ends(low)), high)
        return [own for batch in pairwise(self.planned) for own in self.slices(*batch)]

    def slices(self, low: tuple[int, int], high: tuple[int, int]) -> list[Slice]:
        """The tasks of one batch."""
        met = [(path, number) for begin, last, path, number in self.all if begin <= high[0] and last >= low[0]]
        n = min(self.parts, len(met))
        return [Slice(low, high, met[len(met) * k // n : len(met) * (k + 1) // n], self.files) for k in range(n)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows = self.rows(partition.groups, partition.files, self.kinds)
        yield from (b for b in rows.to_batches(columns=self.kinds.names, filter=after(partition.low) & until(partition.high)) if len(b))

    def commit(self, end: dict) -> None:
        pass


def change_source(spark, path: str, mode: str = "feed", limit: int = 100_000, parts: int = 8, batches: int = 1):
    register_pickle_by_value(sys.modules[__name__])  # workers that read a source may lack the driver's path
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("changes").options(path=path.removeprefix("file:"), mode=mode, limit=limit, parts=parts, batches=batches).load()
