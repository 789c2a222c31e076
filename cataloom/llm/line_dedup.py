"""Reversible line deduplication: sharded cuckoo filters before exact reference counts.

The index keeps, for each line key, the number of documents that hold it and the smallest of them, and the postings
(key, document) those counts come from. Each shard of keys has a cuckoo filter. A batch's keys are put to their shard's
filter first: a key that it does not hold is new for certain and its counts are written as they are; only the rest
meet the stored counts in a join. Deleting documents takes their postings out, counts the touched keys anew and removes
keys that nobody holds any more from their filters, so an insertion can be undone exactly.

Each change writes only the rows it touches, as a segment of its own; the newest row of a key counts, and now and then all
segments are written into one. A manifest, written last, names the segments of a version: a job that fails, or an executor that
is lost, leaves the version before it in force, and the next attempt writes elsewhere. One driver changes an index at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.common import batches_of, materialize, small_side
from cataloom.llm.cuckoo import CuckooFilter

MIN_CHARS = 10
WHITE = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 200_000
#: Segments before all are written into one; repeated lines that are broadcast (some 40 MB) when texts are cleaned.
MOST_SEGMENTS, BROADCAST_KEYS = 8, 500_000
_SCHEMAS = {
    "refs": "k1 long, k2 long, refs long, first_doc long, version long",
    "postings": "k1 long, k2 long, doc_id long, held boolean, version long",
    "filters": "shard int, held long, blob binary, version long",
}
_FILTER = "shard int, held long, blob binary"
_KEY = ["k1", "k2"]


def line_key(line: str) -> bytes | None:
    """128 bits of the line, stripped of white space at both ends and with A-Z lower-cased; null under MIN_CHARS code points."""
    line = line.strip(WHITE)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= MIN_CHARS else None


def _postings(batches):
    for batch in batches:
        ids, found = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if doc_id is None or not text:
                continue
            keys = {k for k in map(line_key, text.split("\n")) if k}
            ids += [doc_id] * len(keys)
            found += keys
        k = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(ids, pa.int64())], ["k1", "k2", "doc_id"])


def postings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id), once for each line key of each document. Rows without an id or a text have none."""
    batches_of(docs.sparkSession)
    return docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_postings, "k1 long, k2 long, doc_id long").distinct()


def _rows_of(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return keys.column("k1").to_numpy(), keys.column("k2").to_numpy()


def _mixed(k1: np.ndarray) -> np.ndarray:
    return k1.view(np.uint64)


class LineIndex:
    """An index under one folder of the shared store; opening the folder again finds its last version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.state = 0, {"shards": 0, "refs": [], "postings": [], "filters": []}
        done = self._versions()
        if done:
            self.version = done[-1]
            self.state = json.loads(self.spark.read.text(f"{self.folder}/manifest/v{self.version}").first()["value"])

    # -- versions and segments

    def _versions(self) -> list[int]:
        """The committed ones."""
        at = self._path(f"{self.folder}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/manifest/{n}/_SUCCESS")))

    def _commit(self, state: dict) -> None:
        """Put a version in force; what only the versions before the last two name is removed."""
        manifest = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        manifest.write.mode("overwrite").text(f"{self.folder}/manifest/v{self.version + 1}")
        self.version, before, self.state = self.version + 1, self.state, state
        named = {x.rsplit("/", 2)[-2] for s in (before, state) for k in _SCHEMAS for x in s[k]}
        data = self._path(f"{self.folder}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = status.getPath().getName()
            if name not in named and int(name[1:].split("-")[0]) < self.version:
                self._fs.delete(status.getPath(), True)

    def _new_folder(self) -> str:
        return f"{self.folder}/data/v{self.version + 1}-{uuid.uuid4().hex}"

    def _written(self, rows: DataFrame, folder: str, name: str) -> DataFrame:
        schema = _SCHEMAS[name]
        rows.withColumn("version", F.lit(self.version + 1).cast("long")).select(*[x.split()[0] for x in schema.split(", ")]).write.parquet(f"{folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{folder}/{name}")

    def _rows(self, name: str, keys: list[str], only: DataFrame | None = None) -> DataFrame:
        """The newest row of each key in all segments, of those keys that only has."""
        paths = self.state[name]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        rows = self.spark.read.schema(_SCHEMAS[name]).parquet(*paths)
        if only is not None:
            rows = rows.join(only, only.columns, "left_semi")
        if len(paths) == 1:
            return rows
        others = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("r")).select(*keys, "r.*")

    def refs(self, only: DataFrame | None = None) -> DataFrame:
        """(k1, k2, refs, first_doc): the exact counts, of all keys or of those of only."""
        return self._rows("refs", _KEY, only).where("refs > 0").select("k1", "k2", "refs", "first_doc")

    def postings(self, only: DataFrame | None = None) -> DataFrame:
        """(k1, k2, doc_id), of all or of those that share only's columns."""
        return self._rows("postings", ["k1", "k2", "doc_id"], only).where("held").select("k1", "k2", "doc_id")

    def filters(self) -> DataFrame:
        """(shard, held, blob)."""
        return self._rows("filters", ["shard"]).select("shard", "held", "blob")

    def _shard(self, shards: int):
        return F.pmod(F.col("k2"), F.lit(shards)).cast("int").alias("shard")

    # -- filters

    def _probed(self, counted: DataFrame, shards: int) -> DataFrame:
        """counted (shard, k1, k2, refs, first_doc) with maybe: whether the shard's filter seems to hold the key."""

        def probe(key: tuple[pa.Scalar, ...], filters: pa.Table, table: pa.Table) -> pa.Table:
            keys = _mixed(_rows_of(table)[0])
            held = np.zeros(len(keys), bool)
            if filters.num_rows:
                held = CuckooFilter.loads(filters.column("blob")[0].as_py(), 0).contains(keys)
            return table.append_column("maybe", pa.array(held))

        found = self.filters().groupBy("shard").cogroup(counted.groupBy("shard")).applyInArrow(probe, "shard int, k1 long, k2 long, refs long, first_doc long, maybe boolean")
        return materialize(found, "probed")

    def _changed(self, keys: DataFrame, change, refs: DataFrame) -> DataFrame:
        """(shard, held, blob) of the shards of keys (shard, k1, k2) after change(filter, keys); a filter that is full is made anew, larger, from refs() and refs, those of this change."""

        def per_shard(key: tuple[pa.Scalar, ...], old: pa.Table, new: pa.Table) -> pa.Table:
            own = _mixed(_rows_of(new)[0])
            filt = CuckooFilter.loads(old.column("blob")[0].as_py(), old.column("held")[0].as_py()) if old.num_rows else CuckooFilter.for_keys(len(own))
            ok = not len(own) or change(filt, own)
            return pa.table({"shard": pa.array([key[0].as_py()] if len(own) else [], pa.int32()), "held": pa.array(([filt.held if ok else -1]) if len(own) else [], pa.int64()), "blob": pa.array([filt.dumps()] if len(own) else [], pa.binary())})

        changed = materialize(self.filters().groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(per_shard, _FILTER), "filters")
        full = materialize(changed.where("held < 0").select("shard"), "full")
        if full.isEmpty():
            return changed
        shards = self.state["shards"]
        every = self.refs().select("k1", "k2").unionByName(refs.where("refs > 0").select("k1", "k2")).distinct().select(self._shard(shards), "k1", "k2")
        return changed.where("held >= 0").unionByName(self._built(every.join(full, "shard", "left_semi")))

    def _built(self, keys: DataFrame) -> DataFrame:
        """(shard, held, blob) of filters made from keys (shard, k1, k2)."""

        def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            own, room = np.unique(_mixed(_rows_of(table)[0])), table.num_rows
            while not (filt := CuckooFilter.for_keys(room)).insert(own):
                room *= 2
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([filt.held], pa.int64()), "blob": pa.array([filt.dumps()], pa.binary())})

        return keys.groupBy("shard").applyInArrow(build, _FILTER)

    # -- operations

    def insert(self, docs: DataFrame, **columns: str) -> None:
        """Add documents; one that the index holds already is not counted twice. A batch without lines changes nothing."""
        folder = self._new_folder()
        new = materialize(postings(docs, **columns), "postings")
        if self.version:
            new = new.join(self.postings(new.select("doc_id").distinct()), ["k1", "k2", "doc_id"], "left_anti")
        new = self._written(new.withColumn("held", F.lit(True)), folder, "postings")
        counted = materialize(new.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc")), "counted")
        n = counted.count()
        if not n:
            return
        self.state = self.state | {"shards": self.state["shards"] or -(-n // KEYS_PER_SHARD)}
        shards = self.state["shards"]
        probed = self._probed(counted.select(self._shard(shards), "k1", "k2", "refs", "first_doc"), shards)
        maybe = probed.where("maybe")
        known = self.refs(maybe.select("k1", "k2")).select("k1", "k2", F.col("refs").alias("had"), F.col("first_doc").alias("had_first"))
        met = materialize(maybe.join(known, _KEY, "left"), "met")
        summed = met.select("k1", "k2", (F.col("refs") + F.coalesce("had", F.lit(0))).alias("refs"), F.least("first_doc", "had_first").alias("first_doc"))
        fresh = probed.where("not maybe")
        refs = self._written(summed.unionByName(fresh.select("k1", "k2", "refs", "first_doc")), folder, "refs")
        unheld = fresh.select("shard", "k1", "k2").unionByName(met.where("had is null").select("shard", "k1", "k2"))
        self._written(self._changed(unheld, lambda filt, keys: len(keys) <= filt.room() and filt.insert(np.unique(keys)), refs), folder, "filters")
        self._finish(folder)

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents (doc_id) out again; ids that the index does not hold change nothing."""
        folder = self._new_folder()
        gone = self.postings(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
        gone = self._written(gone.withColumn("held", F.lit(False)), folder, "postings")
        touched = materialize(gone.select("k1", "k2").distinct(), "touched")
        rest = self.postings(touched).join(gone.select("k1", "k2", "doc_id"), ["k1", "k2", "doc_id"], "left_anti")
        again = rest.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"))
        refs = self._written(touched.join(again, _KEY, "left").select("k1", "k2", F.coalesce("refs", F.lit(0)).alias("refs"), "first_doc"), folder, "refs")
        dead = refs.where("refs = 0").select(self._shard(max(1, self.state["shards"])), "k1", "k2")

        def drop(filt: CuckooFilter, keys: np.ndarray) -> bool:
            filt.remove(np.unique(keys))
            return True

        self._written(self._changed(dead, drop, refs), folder, "filters")
        self._finish(folder)

    def _finish(self, folder: str) -> None:
        state = {"shards": self.state["shards"]} | {k: [*self.state[k], f"{folder}/{k}"] for k in _SCHEMAS}
        self._commit(state)
        held = self.filters().agg(F.sum("held")).first()[0] or 0
        if len(state["refs"]) > MOST_SEGMENTS or held > 2 * KEYS_PER_SHARD * state["shards"]:
            self.compact()

    def compact(self) -> None:
        """Write all segments into one, with as many shards as the keys call for."""
        folder = self._new_folder()
        refs = self._written(self.refs(), folder, "refs")
        self._written(self.postings().withColumn("held", F.lit(True)), folder, "postings")
        shards = max(1, -(-refs.count() // KEYS_PER_SHARD))
        self._written(self._built(refs.select(self._shard(shards), "k1", "k2")), folder, "filters")
        self._commit({"shards": shards} | {k: [f"{folder}/{k}"] for k in _SCHEMAS})

    def dropped_keys(self) -> DataFrame:
        """(doc_id, keys array<binary>): for each document, the keys whose lines it loses to a smaller doc_id.

        Repeated lines are broadcast up to BROADCAST_KEYS, so that one that most documents hold is no hot key of a join.
        """
        repeated = materialize(self.refs().where("refs > 1").select("k1", "k2", "first_doc"), "repeated")
        lost = self.postings().join(small_side(repeated, BROADCAST_KEYS), _KEY).where("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))


def _clean(batches):
    for batch in batches:
        kept, counts, lost = [], [], []
        for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist()):
            lines = (text or "").split("\n")
            counts.append(len(lines))
            if keys:
                bad = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys}
                lines = [line for line in lines if line_key(line) not in bad]
            lost.append(counts[-1] - len(lines))
            kept.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def _digest(batches):
    for batch in _clean(batches):
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def cleaned(docs: DataFrame, index: LineIndex, *, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each row without the lines that a smaller doc_id of the index holds.

    With digest, kept_sha256 stands in for text. A line's keys are those of line_key(); shorter lines always stay. Ids are whole
    numbers: what can't be cast to one counts as no id. Null and empty texts are one empty line. Rows without an id keep their lines and take none from others. Repeated rows are
    one document. The join moves each text once; the lists beside them hold only keys to be dropped.
    """
    batches_of(docs.sparkSession)
    keys = index.dropped_keys()
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(keys, "doc_id", "left").select("doc_id", "text", "keys")
    last = "kept_sha256 string" if digest else "text string"
    return rows.mapInArrow(_digest if digest else _clean, f"doc_id long, n_lines long, n_dropped long, {last}")
