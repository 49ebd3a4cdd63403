"""A findings store shared by concurrent writers.

Findings lie in folders of Parquet files, bucketed by their hash and never
changed; a version of the store is a small log entry that lists its folders.
A writer works from the version it has read and commits by putting the next
entry in place, which only one writer can (a hard link on a local disk, a rename
that does not overwrite elsewhere). Who comes second looks at what was added
meanwhile, drops what is there by now, and tries again. Readers take one
version: files of writers that have not committed are in no version.

* Joins by hash need no shuffle: a version's folders are registered as the
  partitions of one bucketed table, and a batch is staged in the same buckets
  (that is its only shuffle), so the anti join reads bucket against bucket.
* Rows are numbered by the version they were born in; a withdrawal is a folder
  of hashes with the version they died in, and hides what was born before.
* Every commit leaves its counts by scan, rule, category and severity as a
  delta, negative for withdrawals; statistics are sums of deltas, of a few rows a
  commit, and never read findings.
* Compaction writes the visible rows and the summed deltas anew, as a version
  like any other.

On object stores whose rename copies, writers need a lock of their own.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import store as ST
from tidemark.sources.tables import bucket_table, write_buckets

#: what a delta counts by
DELTA_KEYS = ["scan_id", "pattern", "category", "severity"]
#: folders of a version from which an append compacts
COMPACT_AT = 32
#: attempts at a commit before a writer gives up
ATTEMPTS = 50


@dataclass(frozen=True)
class Version:
    """One log entry: the folders it sees, and each stream's last batch."""

    number: int = 0
    columns: str = ""
    data: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()
    deltas: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    buckets: int = 0   # of all its folders; 0: no commit yet


class FindingsStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        """``buckets``: of a store that is made new, as many as make one of them a
        task's share of an append; a store that exists keeps its own."""
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.buckets = self.version().buckets or buckets

    # --- the log ---

    def _file(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}")
        return p, p.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        p, fs = self._file("")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """That version, or the latest; before the first commit an empty one."""
        if number is None:
            found = self.versions()
            number = found[-1] if found else 0
        if not number:
            return Version()
        p, fs = self._file(f"{number:020d}.json")
        stream = fs.open(p)
        try:
            entry = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry.items()})

    def put(self, entry: Version) -> bool:
        """Make the entry the next version; False if another writer has."""
        target, fs = self._file(f"{entry.number:020d}.json")
        temporary, _ = self._file(f"_{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(entry.__dict__).encode()))
        out.close()
        if target.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file":
            local = lambda p: self._jvm.java.nio.file.Path.of(self._jvm.java.net.URI.create(fs.makeQualified(p).toUri().toString()))
            try:
                self._jvm.java.nio.file.Files.createLink(local(target), local(temporary))
                return True
            except Exception as e:  # noqa: BLE001
                if "FileAlreadyExists" not in str(e):
                    raise
                return False
            finally:
                fs.delete(temporary, False)
        done = not fs.exists(target) and fs.rename(temporary, target)
        if not done:
            fs.delete(temporary, False)
        return done

    # --- folders ---

    def _write(self, df: DataFrame, kind: str, dealt: bool = False) -> str:
        name = uuid.uuid4().hex
        write_buckets(df, "finding_hash", self.buckets, f"{self.path}/{kind}/folder={name}", dealt)
        return name

    def _rows(self, columns: str, folders) -> DataFrame:
        return bucket_table(self.spark, f"{self.path}/data", columns, "finding_hash", self.buckets, folders).drop("folder")

    def _visible(self, at: Version, folders=None) -> DataFrame:
        rows = self._rows(at.columns, at.data if folders is None else folders)
        if not at.gone:
            return rows
        gone = bucket_table(self.spark, f"{self.path}/gone", "finding_hash STRING, died BIGINT", "finding_hash", self.buckets, at.gone)
        gone = gone.select(F.col("finding_hash").alias("_h"), "died")
        return rows.join(gone, (F.col("finding_hash") == F.col("_h")) & (F.col("born") < F.col("died")), "left_anti")

    def _delta(self, rows: DataFrame, sign: int) -> str:
        name = uuid.uuid4().hex
        counts = rows.groupBy(*DELTA_KEYS).agg((F.count(F.lit(1)) * sign).alias("n"))
        counts.coalesce(1).write.parquet(f"{self.path}/deltas/{name}")   # a row a rule and scan
        return name

    # --- reading ---

    def read(self, number: int | None = None) -> DataFrame:
        """The findings of a version (by default the latest)."""
        at = self.version(number)
        if not at.columns:
            raise AnalysisException("the store has no version yet")
        return self._visible(at).drop("born")

    def statistics(self, keys: list[str], number: int | None = None) -> DataFrame:
        """Counts of a version's findings by some of DELTA_KEYS, from deltas alone."""
        at = self.version(number)
        deltas = self.spark.read.schema("scan_id long, pattern string, category string, severity string, n long").parquet(
            *[f"{self.path}/deltas/{d}" for d in at.deltas])
        return deltas.groupBy(*keys).agg(F.sum("n").alias("count")).where("count > 0")

    # --- writing ---

    def begin(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> Pending:
        return Pending(self, new, self.version(), stream, batch)

    def append(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Add the findings whose hash the store lacks, the first of each; the
        version that has them. A stream's batch that is in already is skipped."""
        at = self.begin(new, stream, batch).commit()
        if len(self.version(at).data) >= COMPACT_AT:
            at = self.compact()
        return at

    def _retry(self, attempt) -> int:
        for n in range(ATTEMPTS):
            entry = attempt(self.version())
            if self.put(entry):
                return entry.number
            time.sleep(min(2.0, 0.05 * 2 ** min(n, 5)))
        raise RuntimeError(f"no commit in {ATTEMPTS} attempts")

    def withdraw(self, hashes: DataFrame) -> int:
        """Take the findings with these hashes out; they may be found again later."""
        wanted = hashes.select("finding_hash").distinct()

        def attempt(base: Version) -> Version:
            number = base.number + 1
            hit = self._visible(base).join(wanted, "finding_hash", "left_semi").withColumn("died", F.lit(number).cast("long"))
            gone = self._write(hit.select("finding_hash", "died"), "gone")
            held = bucket_table(self.spark, f"{self.path}/gone", "finding_hash STRING, died BIGINT", "finding_hash", self.buckets, [gone])
            delta = self._delta(self._visible(base).join(held.select("finding_hash"), "finding_hash", "left_semi"), -1)
            return replace(base, number=number, gone=(*base.gone, gone), deltas=(*base.deltas, delta))
        return self._retry(attempt)

    def compact(self) -> int:
        """Write the visible rows and the summed deltas into one folder each."""
        def attempt(base: Version) -> Version:
            data = self._write(self._visible(base), "data", dealt=True)
            delta = uuid.uuid4().hex
            counts = self.statistics(DELTA_KEYS, base.number).withColumnRenamed("count", "n")
            counts.coalesce(1).write.parquet(f"{self.path}/deltas/{delta}")
            return replace(base, number=base.number + 1, data=(data,), gone=(), deltas=(delta,))
        return self._retry(attempt)


class Pending:
    """An append begun from one version."""

    def __init__(self, store: FindingsStore, new: DataFrame, base: Version, stream: str | None, batch: int | None) -> None:
        self.store, self.base, self.stream, self.batch = store, base, stream, batch
        rows = ST.first_wins(ST.to_store_rows(new))
        self.columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", born BIGINT"
        self.staged = None
        if self._is_in(base):
            return
        if base.columns and base.columns != self.columns:
            raise AnalysisException(f"the store has the columns {base.columns}, the findings {self.columns}")
        staged = store._write(rows, "staged")
        table = bucket_table(store.spark, f"{store.path}/staged", self.columns.removesuffix(", born BIGINT"), "finding_hash", store.buckets, [staged])
        self.staged = table.drop("folder")
        self.mine = self.unseen(self.staged, store._visible(base)) if base.data else self.staged

    @staticmethod
    def unseen(rows: DataFrame, held: DataFrame) -> DataFrame:
        """Bucket against bucket: no shuffle on either side."""
        return rows.join(held.select("finding_hash"), "finding_hash", "left_anti")

    def _is_in(self, at: Version) -> bool:
        return self.stream is not None and at.batches.get(self.stream, -1) >= self.batch

    def commit(self) -> int:
        store, base = self.store, self.base
        if self.staged is None:
            return base.number
        for n in range(ATTEMPTS):
            number = base.number + 1
            data = store._write(self.mine.withColumn("born", F.lit(number).cast("long")), "data", dealt=True)
            written = store._rows(self.columns, [data])
            entry = replace(base, number=number, columns=self.columns, buckets=store.buckets, data=(*base.data, data), deltas=(*base.deltas, store._delta(written, 1)),
                            batches=base.batches | ({self.stream: self.batch} if self.stream is not None else {}))
            if store.put(entry):
                return number
            later = store.version()
            if self._is_in(later):
                return later.number
            if later.buckets != store.buckets:
                raise AnalysisException(f"the store has been made with {later.buckets} buckets, the findings lie in {store.buckets}")
            if later.gone == base.gone and set(base.data) <= set(later.data):   # only what was added since can hold more of them
                self.mine = self.unseen(written.drop("born"), store._visible(later, [f for f in later.data if f not in base.data]))
            else:
                self.mine = self.unseen(self.staged, store._visible(later))
            base = later
            time.sleep(min(2.0, 0.05 * 2 ** min(n, 5)))
        raise RuntimeError(f"no commit in {ATTEMPTS} attempts")
