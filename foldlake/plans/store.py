"""A durable store: snapshots, deltas and a manifest.

Layout below one folder: ``snapshot/<version>`` holds items in files by ranges of the key, ``delta/<batch>`` the folded
edits of one batch (deletes and open adds kept), ``manifest/<n>.json`` what makes up state n. A commit writes its data
first, claims state n by creating ``manifest/<n>.lock``, which fails if it is there, then writes the manifest under a
temporary name and renames it; readers trust the newest manifest alone, so a writer that dies leaves only unlisted files
(a claim that has not become a state after STALE seconds is taken over). What a state replaces is deleted ``grace`` states
later, so readers of the states before it are not cut off. Batches at or below the manifest's upper bound are ignored when
they come again.

A checkpoint folds all deltas into a new snapshot. A flush moves one key range down: the range of one snapshot file is
folded with the deltas' edits in it and only that file is replaced; the deltas note the range and show it no more. A
delete is gone once a checkpoint or flush has dropped it, so an add that comes later finds nothing below and stays an open
add, of the value it would have as a write. All file work goes through Spark or Hadoop's file systems, so the folder can
be in any store Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, replace

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.values import packed_size
from ..model import EDIT_SCHEMA, StoreOptions
from ..operators import read
from ..operators.ordered import place_in
from ..shared import cut
from .fold import decay, fold, union_tiers

COLUMNS = [f.name for f in EDIT_SCHEMA.fields]
STALE = 600


class Store:
    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self._state = spark, path.rstrip("/"), state
        self._buffer: list[tuple] = []

    # --- files

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, state: dict, gone: tuple[str, ...] = ()) -> None:
        """Makes ``state`` the newest one; ``gone`` is what it no longer refers to."""
        n, grace = state["n"], StoreOptions(**state["options"]).grace
        trash = [*state.get("trash", []), *([n, g] for g in gone)]
        due = [name for at, name in trash if at <= n - grace]
        state["trash"] = [x for x in trash if x[0] > n - grace]
        fs, tmp, lock, final = self._fs(), self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{n:020d}.lock"), self._path(f"manifest/{n:020d}.json")
        if not fs.exists(final) and fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > STALE:
            fs.delete(lock, False)
        try:
            fs.create(lock, False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer has committed state {n}") from e
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise RuntimeError(f"another writer has committed state {n}")
        self._state = state
        for name in due:
            fs.delete(self._path(name), True)

    @classmethod
    def create(cls, spark: SparkSession, path: str, options: StoreOptions | None = None, overwrite: bool = False) -> "Store":
        store = cls(spark, path, {})
        fs = store._fs()
        if fs.exists(store._path()):
            if not overwrite:
                raise FileExistsError(path)
            fs.delete(store._path(), True)
        fs.mkdirs(store._path("manifest"))
        store._commit({"n": 0, "options": asdict(options or StoreOptions()), "snapshot": None, "snapshots": [], "files": [], "upper": -1, "seq": -1, "deltas": [], "metrics": {"batches": 0, "checkpoints": 0, "edits": 0, "merges": 0, "duplicates": 0, "flushes": 0}})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Store":
        store = cls(spark, path, {})
        store.refresh()
        return store

    def refresh(self) -> None:
        fs = self._fs()
        if not fs.exists(self._path("manifest")):
            raise FileNotFoundError(f"{self.path} holds no store")
        names = sorted(s.getPath().getName() for s in fs.listStatus(self._path("manifest")) if s.getPath().getName().endswith(".json"))
        if not names:
            raise FileNotFoundError(f"{self.path} holds no store")
        at = fs.open(self._path(f"manifest/{names[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
        finally:
            at.close()
        self._state = json.loads(text)

    # --- options and state

    @property
    def options(self) -> StoreOptions:
        return StoreOptions(**self._state["options"])

    @property
    def chi(self) -> int:
        """Batches for each checkpoint."""
        return self.options.chi

    def set_chi(self, chi: int) -> None:
        """Takes effect with the next batch; a store past it is checkpointed now."""
        self._commit(self._state | {"n": self._state["n"] + 1, "options": asdict(replace(self.options, chi=chi))})
        self._checkpoint_if_due()

    def metrics(self) -> dict:
        s = self._state
        return s["metrics"] | {"deltas": len(s["deltas"]), "delta_rows": sum(d["rows"] for d in s["deltas"]), "snapshot_rows": sum(f["rows"] for f in s["files"]), "upper": s["upper"]}

    # --- writing

    def put(self, key: str, value: str, i32: int = 0) -> None:
        """An upsert, visible after flush()."""
        self._buffer.append((key, 2, i32, value))

    def remove(self, key: str) -> None:
        self._buffer.append((key, 0, 0, None))

    def add(self, key: str, amount: int) -> None:
        self._buffer.append((key, 3, amount, None))

    def flush(self) -> None:
        """Writes what put, remove and add have gathered as one batch."""
        if self._buffer:
            rows = [(k, self._state["seq"] + 1 + i, op, v, p) for i, (k, op, v, p) in enumerate(self._buffer)]
            self._buffer = []
            self.append(self.spark.createDataFrame(rows, EDIT_SCHEMA))

    def append(self, edits: DataFrame, batch_id: int | None = None) -> bool:
        """Folds one batch of edits into a delta; False if the store holds that batch already.

        ``seq`` must go up from batch to batch for a key.
        """
        s = self._state
        batch_id = s["upper"] + 1 if batch_id is None else batch_id
        if batch_id <= s["upper"]:
            s["metrics"]["duplicates"] += 1
            return False
        if "value" not in edits.columns:
            edits = edits.withColumn("value", F.lit(None).cast("string"))
        name = f"delta/{batch_id:012d}-{uuid.uuid4().hex[:8]}"
        rows, top = self._write(fold(edits.select(*COLUMNS)), name)
        deltas = [*s["deltas"], {"path": name, "level": 0, "rows": rows, "moved": []}]
        self._commit(s | {"n": s["n"] + 1, "upper": batch_id, "seq": max(s["seq"], top), "deltas": deltas, "pending": s.get("pending", 0) + 1, "metrics": s["metrics"] | {"batches": s["metrics"]["batches"] + 1, "edits": s["metrics"]["edits"] + rows}})
        if self.options.policy == "levelled" and self._state["pending"] < self.chi:  # else a checkpoint folds them all
            self._merge_levels()
        elif self.options.policy == "pivot":
            while self._state["snapshot"] and self.flush_fullest(self.options.min_flush):
                pass
        self._checkpoint_if_due()
        return True

    def _write(self, folded: DataFrame, name: str) -> tuple[int, int]:
        """(rows, largest seq) of what was written, sorted inside its files."""
        seen = Observation()
        self._writer(folded.select(*COLUMNS).observe(seen, F.count(F.lit(1)).alias("n"), F.max("seq").alias("top")).sortWithinPartitions("key")).parquet(f"{self.path}/{name}")
        n, top = seen.get["n"], seen.get["top"]
        return n, top if top is not None else -1

    def _writer(self, df: DataFrame):
        return df.write.option("parquet.bloom.filter.enabled#key", "true") if self.options.bloom else df.write

    def _parquet(self, *names: str) -> DataFrame:
        return self.spark.read.schema(EDIT_SCHEMA).parquet(*(f"{self.path}/{n}" for n in names))

    def _delta(self, d: dict) -> DataFrame:
        """A delta's edits without the ranges that have moved down."""
        out = self._parquet(d["path"])
        for low, high in d["moved"]:
            out = out.where((F.col("key") < low) | (F.lit(False) if high is None else F.col("key") >= high))
        return out

    def _snapshot(self, whole: DataFrame, rows: int, name: str) -> list[dict]:
        """Writes items in files by ranges of the key; a dict for each file: its path, its range and its rows."""
        files = max(1, -(-rows // self.options.max_records_per_file))
        whole = whole.select(*COLUMNS)
        # written before its ranges are sampled, so that it is computed once
        whole = cut(whole).repartitionByRange(files, "key") if files > 1 else whole.repartition(1)
        self._writer(whole.sortWithinPartitions("key")).parquet(f"{self.path}/{name}")
        found = self._parquet(name).groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("rows"))
        return [{"path": f"{name}/{r.f.rsplit('/', 1)[1]}", "lo": r.lo, "hi": r.hi, "rows": r.rows} for r in found.orderBy("lo").collect()]

    def _merge_levels(self) -> None:
        """Two deltas of one level become one of the next, as a binary counter carries."""
        while len(d := self._state["deltas"]) > 1 and d[-1]["level"] == d[-2]["level"]:
            a, b = d[-2:]
            name = f"delta/merge-{uuid.uuid4().hex}"
            rows, _ = self._write(fold(union_tiers(self._delta(a), self._delta(b))), name)
            s = self._state
            merged = {"path": name, "level": a["level"] + 1, "rows": rows, "moved": []}
            self._commit(s | {"n": s["n"] + 1, "deltas": [*d[:-2], merged], "metrics": s["metrics"] | {"merges": s["metrics"]["merges"] + 1}}, (a["path"], b["path"]))

    def _checkpoint_if_due(self) -> None:
        if self._state.get("pending", 0) >= self.chi:
            self.force_checkpoint()

    def force_checkpoint(self) -> None:
        """Folds base and deltas into a new snapshot, drops deletes, then lets go of what it replaced."""
        self.flush()
        s = self._state
        if not s["deltas"]:
            return
        name = f"snapshot/{s['n'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        files = self._snapshot(decay(fold(self.edits())), self.row_bound(), name)
        snapshots = [*s["snapshots"], sorted({f["path"].rsplit("/", 1)[0] for f in files} | {name})]
        old, snapshots = snapshots[: -self.options.retain], snapshots[-self.options.retain :]
        still = {folder for folders in snapshots for folder in folders}
        gone = (*(d["path"] for d in s["deltas"]), *sorted({folder for folders in old for folder in folders} - still))
        self._commit(s | {"n": s["n"] + 1, "snapshot": name, "snapshots": snapshots, "files": files, "deltas": [], "pending": 0, "metrics": s["metrics"] | {"checkpoints": s["metrics"]["checkpoints"] + 1}}, gone)

    # --- key ranges moved down one by one

    def ranges(self) -> list[tuple[str, str | None]]:
        """(low, high) of each snapshot file: from its first key to the next file's; the outer ones are open."""
        lows = ["", *(f["lo"] for f in self._state["files"][1:])]
        return list(zip(lows, [*lows[1:], None]))

    def waiting(self) -> DataFrame:
        """(pivot, bytes): the deltas' bytes for each of ``ranges``; those without any are not shown."""
        log = union_tiers(*(self._delta(d) for d in self._state["deltas"])) if self._state["deltas"] else self.spark.createDataFrame([], EDIT_SCHEMA)
        pivot = place_in([low for low, _ in self.ranges()], F.col("key")) - 1
        return log.groupBy(pivot.cast("int").alias("pivot")).agg(F.sum(packed_size(F.col("key"), F.coalesce("value", F.lit("")))).cast("long").alias("bytes"))

    def flush_fullest(self, min_flush: int = 1) -> tuple[str, str | None] | None:
        """Moves the range with the most waiting bytes down if it has ``min_flush``; returns it, or None."""
        s, top = self._state, self.waiting().orderBy(F.desc("bytes"), "pivot").first()
        if top is None and s["deltas"]:  # all of their ranges have moved
            self._commit(s | {"n": s["n"] + 1, "deltas": []}, tuple(d["path"] for d in s["deltas"]))
        if top is None or top.bytes < min_flush:
            return None
        self.flush_range(top.pivot)
        return tuple(self._state["flushed"])

    def flush_range(self, pivot: int) -> None:
        """Folds the deltas' edits of one of ``ranges`` into its file, which may become several or none, and no other."""
        s, (low, high) = self._state, self.ranges()[pivot]
        inside = F.col("key") >= low if high is None else (F.col("key") >= low) & (F.col("key") < high)
        old = s["files"][pivot : pivot + 1]
        log = union_tiers(*(self._parquet(f["path"]) for f in old), *(self._delta(d).where(inside) for d in s["deltas"]))
        name = f"snapshot/{s['n'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        files = self._snapshot(decay(fold(log)), sum(f["rows"] for f in old) + sum(d["rows"] for d in s["deltas"]), name)
        deltas = [d | {"moved": [*d["moved"], [low, high]]} for d in s["deltas"]]
        every = [*s["files"][:pivot], *files, *s["files"][pivot + 1 :]]
        newest = sorted({f["path"].rsplit("/", 1)[0] for f in every} | {name})
        left = set(s["snapshots"][-1]) - set(newest) - {folder for folders in s["snapshots"][:-1] for folder in folders}
        self._commit(s | {"n": s["n"] + 1, "snapshot": name, "snapshots": [*s["snapshots"][:-1], newest], "files": every, "deltas": deltas, "flushed": [low, high], "metrics": s["metrics"] | {"flushes": s["metrics"]["flushes"] + 1}}, (*(f["path"] for f in old), *sorted(left)))

    # --- reading

    def row_bound(self) -> int:
        """No more rows than this are in the store."""
        return sum(f["rows"] for f in self._state["files"]) + sum(d["rows"] for d in self._state["deltas"])

    def checkpoint_items(self) -> DataFrame:
        """The snapshot alone, without deltas."""
        files = [f["path"] for f in self._state["files"]]
        return self._parquet(*files) if files else self.spark.createDataFrame([], EDIT_SCHEMA)

    def edits(self) -> DataFrame:
        """Snapshot and deltas as one log."""
        return union_tiers(self.checkpoint_items(), *(self._delta(d) for d in self._state["deltas"]))

    def level(self, k: int, low: str = "", high: str | None = None) -> DataFrame:
        """The edits of one level of deltas in a range of keys, without what has moved down."""
        found = [self._delta(d) for d in self._state["deltas"] if d["level"] == k]
        log = union_tiers(*found) if found else self.spark.createDataFrame([], EDIT_SCHEMA)
        return log.where((F.col("key") >= low) & (F.lit(True) if high is None else F.col("key") < high))

    def cache(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """The items of this state, kept by the executors until ``unpersist()``; spark.memory.* bounds them."""
        return self.items().persist(level)

    def winners(self) -> DataFrame:
        """The fold of each key, deletes and open adds shown."""
        return fold(self.edits()) if self._state["deltas"] else self.checkpoint_items()

    def items(self) -> DataFrame:
        return decay(self.winners())

    def get(self, key: str):
        """The item's row, or None."""
        return read.get(self.items(), key).first()

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return read.multi_get(self.items(), probes)

    def scan(self, min_key: str, n: int) -> DataFrame:
        """The first n items from min_key. Only as many snapshot files are read as can hold them: deltas can delete no
        more items than they have rows."""
        need, high, files = n + sum(d["rows"] for d in self._state["deltas"]), None, []
        for f in self._state["files"]:
            if f["hi"] >= min_key:
                files.append(f["path"])
                need -= f["rows"] if f["lo"] >= min_key else 0
                if need <= 0:
                    high = f["hi"]
                    break
        base = self._parquet(*files) if files else self.spark.createDataFrame([], EDIT_SCHEMA)
        log = union_tiers(base, *(self._delta(d) for d in self._state["deltas"])).where(F.col("key") >= min_key)
        if high is not None:
            log = log.where(F.col("key") <= high)
        return decay(fold(log) if self._state["deltas"] else log).orderBy("key").limit(n)

    def scan_keys(self, min_key: str, n: int) -> DataFrame:
        return self.scan(min_key, n).select("key")

    def cursor(self, min_key: str = "", page: int = 1000) -> read.Cursor:
        return read.Cursor(self.items(), min_key, page)
