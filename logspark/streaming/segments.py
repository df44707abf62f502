"""T3-T6 tables: a log of segments with an atomic manifest.

Each micro-batch adds one segment that holds what the batch changed, so its writes follow the
batch and never the table. A manifest lists the live segments; a new one replaces it by one
rename, so readers always see a whole state. Whenever a level has ``FANOUT`` segments they are
merged into one of the next level, so that the number of segments grows with the logarithm of
the number of batches. A batch that is replayed finds itself in the manifest and adds nothing.

* ``keep_current`` (T3, T4): newest value of every key of a streaming aggregate.
* ``keep_repeat_groups`` (T5): repeat groups; segments add up.
* ``keep_newest`` (T6): the newest ``n`` rows; whole segments retire, the last is cut on reading.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators import navigation as NV
from logspark.operators import repeats as RP
from logspark.streaming import streams as ST

FANOUT, KEPT_MANIFESTS = 8, 3
ORDER = "_batch"  # the batch that a row's value is of


class SegmentLog:
    """Segments below ``path``; ``merge`` makes one segment's rows of those of several."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fanout: int = FANOUT):
        self.spark, self.path, self.merge, self.fanout = spark, path.rstrip("/"), merge, fanout
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -------------------------------------------------------------- manifest
    def _versions(self) -> list[int]:
        folder = self._paths(f"{self.path}/_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._paths(f"{self.path}/_manifest/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest state: ``batch`` is the last one added, ``segments`` those that are live."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else {"version": 0, "batch": -1, "segments": []}

    def _publish(self, state: dict) -> dict:
        """Make ``state`` the newest: written aside, then renamed to a name that must be free."""
        state = state | {"version": state["version"] + 1}
        folder = f"{self.path}/_manifest"
        aside, name = self._paths(f"{folder}/.{uuid.uuid4().hex}"), self._paths(f"{folder}/{state['version']:012d}.json")
        self._fs.mkdirs(self._paths(folder))
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            raise RuntimeError(f"another writer has changed {self.path}")
        return state

    # -------------------------------------------------------------- segments
    def _write(self, rows: DataFrame, batch_id: int, level: int, bounds: str | None) -> dict:
        name = f"seg-{level}-{batch_id}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{name}")
        low = high = None
        found = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")
        if bounds:
            low, high, count = found.agg(F.min(bounds), F.max(bounds), F.count(F.lit(1))).first()
        else:
            count = found.count()
        return {"name": name, "level": level, "batch": batch_id, "rows": count, "low": low, "high": high}

    def append(self, rows: DataFrame, batch_id: int, bounds: str | None = None, retire: Callable[[list[dict]], list[dict]] | None = None) -> None:
        """Add a batch's rows as a segment, let segments retire and merge full levels; a replayed batch changes nothing."""
        state = self.manifest()
        if state["batch"] >= batch_id:
            return
        segments = [*state["segments"], self._write(rows, batch_id, 0, bounds)]
        if retire:
            segments = retire(segments)
        state = self._publish(state | {"batch": batch_id, "segments": segments})
        while (level := self._full_level(segments)) is not None:
            old = [s for s in segments if s["level"] == level]
            merged = self._write(self.merge(self._rows(old)), batch_id, level + 1, bounds)
            segments = [s for s in segments if s["level"] != level] + [merged]
            state = self._publish(state | {"segments": segments})
        self._clean()

    def _full_level(self, segments: list[dict]) -> int | None:
        sizes = Counter(s["level"] for s in segments)
        return min((level for level, size in sizes.items() if size >= self.fanout), default=None)

    def _clean(self) -> None:
        """Remove old manifests, and segments that none of the kept ones lists; a slow reader has those to finish."""
        versions = self._versions()
        live = {s["name"] for v in versions[-KEPT_MANIFESTS:] for s in self._read(v)["segments"]}
        for v in versions[:-KEPT_MANIFESTS]:
            self._fs.delete(self._paths(f"{self.path}/_manifest/{v:012d}.json"), False)
        for s in self._fs.listStatus(self._paths(self.path)):
            name = s.getPath().getName()
            if name.startswith("seg-") and name not in live:
                self._fs.delete(s.getPath(), True)

    def _rows(self, segments: list[dict]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/{s['name']}") for s in segments))

    def read(self) -> DataFrame | None:
        """The merged rows of the newest state; None before the first batch."""
        segments = self.manifest()["segments"]
        return self.merge(self._rows(segments)) if segments else None


def _started(stream: DataFrame, per_batch, checkpoint_dir: str, mode: str = "append"):
    return (stream.writeStream.outputMode(mode).foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


# ------------------------------------------------------------------ T3 / T4
def newest_values(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge of rows of changed keys: for each key the values of its last batch."""
    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*keys, ORDER)]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values, ORDER), ORDER).alias("_now"))
        return newest.select(*keys, "_now.*")

    return merge


def keep_current(agg: DataFrame, path: str, checkpoint_dir: str, keys: list[str], fanout: int = FANOUT):
    """The current rows of a streaming aggregate; a batch writes the keys that it changed (update mode)."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        log = SegmentLog(batch.sparkSession, path, newest_values(keys), fanout)
        log.append(batch.withColumn(ORDER, F.lit(batch_id).cast("long")), batch_id)

    return _started(agg, per_batch, checkpoint_dir, "update")


def current_values(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What ``keep_current`` keeps, at the newest manifest."""
    return SegmentLog(spark, path, newest_values(keys)).read().drop(ORDER)


# ------------------------------------------------------------------ T5
def summed_groups(rows: DataFrame) -> DataFrame:
    """Merge of repeat groups: counts add up, the two newest ids are those of all."""
    return ST.merge_repeat_groups(rows.limit(0), rows).select(*ST.GROUP_COLUMNS)


def keep_repeat_groups(events: DataFrame, path: str, checkpoint_dir: str, fanout: int = FANOUT):
    """T5: running repeat groups; a batch writes its own groups, one row for each key that it holds."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        SegmentLog(batch.sparkSession, path, summed_groups, fanout).append(RP.repeat_groups(batch).select(*ST.GROUP_COLUMNS), batch_id)

    return _started(events, per_batch, checkpoint_dir)


def repeat_groups_now(spark: SparkSession, path: str) -> DataFrame:
    return SegmentLog(spark, path, summed_groups).read()


# ------------------------------------------------------------------ T6
def retired(segments: list[dict], n: int) -> list[dict]:
    """``segments`` without those of which every row has ``n`` or more newer rows in segments that lie wholly above it."""
    whole = [s for s in segments if s["rows"]]
    return [s for s in whole if sum(x["rows"] for x in whole if x["low"] > s["high"]) < n]


def keep_newest(events: DataFrame, n: int, path: str, checkpoint_dir: str, paused: bool = False, fanout: int = FANOUT):
    """Rows of which ``newest_rows`` reads the newest ``n`` by event id; a batch writes its own rows.

    While ``paused`` no segment retires, so every row that comes is kept; the first batch after
    resuming lets all go that have become too old.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        log = SegmentLog(batch.sparkSession, path, lambda rows: rows, fanout)
        log.append(batch, batch_id, bounds="event_id", retire=None if paused else lambda s: retired(s, max(int(n), 1)))

    return _started(events, per_batch, checkpoint_dir)


def newest_rows(spark: SparkSession, path: str, n: int | None = None) -> DataFrame | None:
    """The newest ``n`` rows kept, newest first; without ``n`` (a paused view) all of them."""
    rows = SegmentLog(spark, path, lambda rows: rows).read()
    return rows if rows is None or n is None else NV.keep_latest(rows, n)
