"""S-10: a spool of records in NDJSON files, kept within a number of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import bounded_tail
from ..session import exists


class Spool:
    """Records (place, line) in a folder of generations, each a whole state of the spool.

    A write adds its lines to the last whole generation, drops the oldest lines until the rest fits ``max_bytes``, a
    line break each, and writes the next generation. A generation without its mark of success is the rest of a writer
    that was lost and is not read; a torn record, as one in a file that was copied half, is skipped.
    """

    KINDS = "place long, line string"

    def __init__(self, spark: SparkSession, path: str, max_bytes: int):
        self.spark, self.path, self.max_bytes = spark, path, max_bytes

    def last(self) -> int:
        """The number of the last whole generation; 0 without one."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        if not exists(self.spark, self.path):
            return 0
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in folder.getFileSystem(conf).listStatus(folder)]
        found = [int(n.removeprefix("gen=")) for n in names if n.startswith("gen=")]
        return max((n for n in found if exists(self.spark, f"{self.path}/gen={n}/_SUCCESS")), default=0)

    def read(self) -> DataFrame:
        """(place, line) of all whole records."""
        n = self.last()
        if not n:
            return self.spark.createDataFrame([], self.KINDS)
        text = self.spark.read.text(f"{self.path}/gen={n}")
        record = F.from_json("value", self.KINDS, {"mode": "PERMISSIVE"})
        whole = F.try_parse_json("value").isNotNull() & F.col("r.place").isNotNull() & F.col("r.line").isNotNull()
        return text.select("value", record.alias("r")).where(whole).select("r.*")

    def write(self, lines: DataFrame) -> int:
        """Add ``lines`` (place, line) and return the new generation's number. Null lines are none."""
        n = self.last() + 1
        both = self.read().unionByName(lines.select(F.col("place").cast("long").alias("place"), "line").where("line is not null AND place is not null"))
        bounded_tail(both, "place", "line", self.max_bytes).select("place", "line").write.mode("overwrite").json(f"{self.path}/gen={n}")
        return n
