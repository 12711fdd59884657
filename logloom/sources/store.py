"""A durable key/value store on Parquet: log segments, sorted runs, and versioned manifests.

A manifest version is a folder of its own and a small file that names it. That file is created at
once with its content, or not at all where another writer was first; this is the commit, and
readers keep the version they have opened. Segments get their positions in the log the same way:
each claims a range behind the last claim, and its rows count from there. So the file system must
refuse to create a name twice, as HDFS (rename) and local disks (hard links) do.

Deletes are logged like puts. A key's newest record by (ts, seq) over unflushed segments and runs
answers a get, and a tombstone hides what is older.
"""

from __future__ import annotations

import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.runs import lookup_segment
from logloom.plans.logs import newest
from logloom.sources.config import StoreConfig

RECORD = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("op", T.IntegerType())])
MANIFEST = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("min_key", T.StringType()), T.StructField("max_key", T.StringType())]
    + [T.StructField(x, T.LongType()) for x in ("n_records", "n_tombstones", "created_seq", "next_seq")]
)


class Store:
    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or StoreConfig()
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("log", "runs", "manifest", "claims"):
            self._fs.mkdirs(self._at(d))

    # files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if not s.getPath().getName().startswith((".", "_")))

    def _create(self, name: str, content: str) -> bool:
        """A small file with its content, or False where the name is taken; of several writers one succeeds."""
        tmp = f"{name.rpartition('/')[0]}/_tmp-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(tmp))
        out.write(content.encode())
        out.close()
        if self._fs.getUri().getScheme() != "file":
            done = not self._fs.exists(self._at(name)) and self._fs.rename(self._at(tmp), self._at(name))
            if not done:
                self._fs.delete(self._at(tmp), False)
            return done
        nio, path = self.spark._jvm.java.nio.file, lambda x: self.spark._jvm.java.io.File(self._at(x).toUri().getPath()).toPath()
        try:
            nio.Files.createLink(path(name), path(tmp))
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getName() != "java.nio.file.FileAlreadyExistsException":
                raise
            return False
        finally:
            self._fs.delete(self._at(tmp), False)

    def _content(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> int:
        return max((int(n[1:]) for n in self._names("manifest") if n.startswith("v")), default=0)

    def manifest(self) -> DataFrame:
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{self._content(f'manifest/v{v:09d}')}")

    def _commit(self, rows: DataFrame, seen: int) -> None:
        """rows: the whole manifest, one row a run. Fails if another writer has committed since ``seen``."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(*MANIFEST.names).coalesce(1).write.parquet(f"{self.path}/manifest/{folder}")
        if not self._create(f"manifest/v{seen + 1:09d}", folder):
            self._fs.delete(self._at(f"manifest/{folder}"), True)
            raise RuntimeError("another writer has changed the manifest")

    def unflushed(self) -> list[str]:
        """Segments that no run was made of, in log order."""
        names = self._names("log")
        mine = self.manifest().select(F.explode("segments").alias("s")).join(F.broadcast(self.spark.createDataFrame([(n,) for n in names], "s string")), "s", "left_semi")
        done = {r["s"] for r in mine.collect()} if names else set()
        return [s for s in names if s not in done]

    def _segments(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], RECORD)
        rows = self.spark.read.schema(RECORD).parquet(*[f"{self.path}/log/{n}" for n in names])
        base = F.regexp_extract(F.col("_metadata.file_path"), r"/seg-(\d+)-[^/]*/[^/]*$", 1).cast("bigint")
        return rows.select("k", "v", "ts", (F.col("seq") + base).alias("seq"), "op")

    def _runs(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*[f"{self.path}/runs/{n}" for n in names])

    # writes

    def _claim(self, span: int) -> int:
        """The first of span positions in the log that no other segment has."""
        while True:
            last = max(self._names("claims"), default=None)
            base = int(self._content(f"claims/{last}")) if last else 0
            if self._create(f"claims/{base:020d}", str(base + span)):
                return base

    def write(self, rows: DataFrame) -> str:
        """Logs rows (k, v, op, and ts or the time of writing) as a segment; keys must not be empty."""
        ts = F.col("ts") if "ts" in rows.columns else F.lit(int(time.time()))
        name = uuid.uuid4().hex
        good = rows.select(F.col("k").cast("string"), F.when(F.col("op") == 0, F.col("v").cast("string")).alias("v"), ts.cast("bigint").alias("ts"), F.monotonically_increasing_id().alias("seq"), F.col("op").cast("int"))
        good.write.parquet(f"{self.path}/log/_{name}")
        own = self.spark.read.schema(RECORD).parquet(f"{self.path}/log/_{name}")
        bad, last = own.agg(F.count_if(F.expr("k is null or k = '' or op is null or (op = 0 and v is null)")), F.max("seq")).first()
        if bad:
            self._fs.delete(self._at(f"log/_{name}"), True)
            raise ValueError("a put needs a key and a value, a delete needs a key")
        final = f"seg-{self._claim((last or 0) + 1):020d}-{name[:8]}"
        if not self._fs.rename(self._at(f"log/_{name}"), self._at(f"log/{final}")):
            raise RuntimeError("the segment could not be published")
        if self.config.auto:
            self.maybe_flush()
        return final

    def put(self, rows: DataFrame) -> str:
        return self.write(rows.withColumn("op", F.lit(0)))

    def delete(self, keys: DataFrame) -> str:
        return self.write(keys.withColumn("op", F.lit(1)).withColumn("v", F.lit(None).cast("string")))

    def _write_run(self, records: DataFrame, level: int, segments: list[str]) -> DataFrame:
        """The manifest row of a new run; one without records tells that its segments are done."""
        name = f"run-{uuid.uuid4().hex}"
        path = f"{self.path}/runs/{name}"
        out = newest(records, "k").repartitionByRange("k").sortWithinPartitions("k").write
        out.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.fpp#k", str(self.config.bloom_fpr)).parquet(path)
        own = self._runs([name]).agg(F.min("k"), F.max("k"), F.count(F.lit(1)), F.coalesce(F.sum("op"), F.lit(0)).cast("bigint"), F.max("seq")).first()
        newest_seq = -1 if own[4] is None else own[4]
        return self.spark.createDataFrame([(name, level, segments, own[0], own[1], own[2], own[3], newest_seq, newest_seq + 1)], MANIFEST)

    def flush(self) -> bool:
        """Makes one run of all unflushed segments."""
        seen, names = self.version(), self.unflushed()
        if not names:
            return False
        self._commit(self.manifest().unionByName(self._write_run(self._segments(names), 0, names)), seen)
        if self.config.auto:
            level = 0
            while self.compact(level):
                level += 1
        return True

    def maybe_flush(self) -> bool:
        size = self._segments(self.unflushed()).agg(F.sum(9 + F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0)))).first()[0] or 0
        return bool(size >= self.config.flush_bytes and self.flush())

    def compact(self, level: int = 0) -> bool:
        """Merges the newest runs of a level into one of the next; tombstones go where no other run can hold their key."""
        seen, rows = self.version(), self.manifest()
        mine = rows.filter(F.col("level") == level).orderBy(F.desc("created_seq")).limit(self.config.fan_in).collect()
        if len(mine) < self.config.fan_in:
            return False
        names = [r["run"] for r in mine]
        rest = rows.filter(~F.col("run").isin(names))
        merged = newest(self._runs(names), "k")
        held = rest.filter("n_records > 0").select("min_key", "max_key")
        tombstones = merged.filter("op <> 0").join(held, (F.col("k") >= F.col("min_key")) & (F.col("k") <= F.col("max_key")), "left_semi")
        there = set(self._names("log"))  # segments that are gone need no mark
        run = self._write_run(merged.filter("op = 0").unionByName(tombstones), level + 1, sorted({s for r in mine for s in r["segments"]} & there))
        self._commit(rest.unionByName(run), seen)
        return True

    def gc(self, min_age: float | None = None) -> list[str]:
        """Removes runs that the manifest does not name, and segments that runs were made of, older than min_age seconds."""
        age = self.config.gc_min_age if min_age is None else min_age
        unflushed = set(self.unflushed())
        names = self._names("runs")
        known = self.manifest().select("run").join(F.broadcast(self.spark.createDataFrame([(n,) for n in names], "run string")), "run", "left_semi").collect() if names else []
        live = {r["run"] for r in known}
        gone = []
        for folder, dead in (("runs", lambda n: n not in live), ("log", lambda n: n.startswith("seg-") and n not in unflushed)):
            for status in self._fs.listStatus(self._at(folder)):
                name = status.getPath().getName()
                if dead(name) and time.time() - status.getModificationTime() / 1000 >= age:
                    self._fs.delete(status.getPath(), True)
                    gone.append(f"{folder}/{name}")
        for name in self._names("claims")[:-2]:
            self._fs.delete(self._at(f"claims/{name}"), False)
        return gone

    def start_gc(self, period: float | None = None, min_age: float | None = None) -> threading.Event:
        """Sweeps every period seconds (that of the settings) until the event that is returned is set."""
        stop = threading.Event()
        wait = self.config.gc_period if period is None else period

        def sweep() -> None:
            while not stop.wait(wait):
                self.gc(min_age)

        threading.Thread(target=sweep, daemon=True).start()
        return stop

    # reads

    def records(self) -> DataFrame:
        return self._segments(self.unflushed()).unionByName(self._runs([r["run"] for r in self.manifest().select("run").collect()]))

    def live(self) -> DataFrame:
        return newest(self.records(), "k").filter("op = 0").select("k", "v", "ts")

    def get_unflushed(self, keys: DataFrame) -> DataFrame:
        """k, found, v, ts, op of each key in the unflushed segments alone."""
        return lookup_segment(self._segments(self.unflushed()), keys.select("k"))

    def get(self, keys: DataFrame) -> DataFrame:
        """k and v of each key of ``keys``, v null where the store has none; only runs whose range meets the keys' are read."""
        ends = keys.agg(F.min("k"), F.max("k")).first()
        meets = (F.col("n_records") > 0) & (F.col("min_key") <= F.lit(ends[1])) & (F.col("max_key") >= F.lit(ends[0]))
        names = [r["run"] for r in self.manifest().filter(meets).select("run").collect()] if ends[0] is not None else []
        rows = self._segments(self.unflushed()).unionByName(self._runs(names)).join(keys.select("k").distinct(), "k", "left_semi")
        if ends[0] is not None and ends[0] == ends[1]:
            rows = rows.filter(F.col("k") == ends[0])  # reaches the Parquet scan: pages and Bloom filters
        return keys.join(newest(rows, "k").filter("op = 0").select("k", "v"), "k", "left")

    def get_one(self, key: str) -> str | None:
        row = self.get(self.spark.createDataFrame([(key,)], "k string")).first()
        return row["v"]

    def info(self) -> DataFrame:
        return self.manifest().groupBy("level").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_records").alias("n_records"), F.sum("n_tombstones").alias("n_tombstones"))
