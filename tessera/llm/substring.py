"""Substring dedup over a log-structured index of window fingerprints.

The index keeps, for every content-defined anchor of the documents seen so far, the smallest and largest document that
has it. It is a log of immutable runs, each bucketed and sorted by fingerprint: a new batch is merge-joined with every
run, then becomes a run itself, and runs of like size are compacted into one. What shares no anchor shares no window, so
only windows around shared anchors are verified, by 128 bits made from a cryptographic digest of each of their words.

remove_repeats() takes a table through a log of its own; dedupe_batch() adds a batch to a log that is kept in a folder."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import windows as W
from .common import discard, durable, new_path, remove

#: Words of a window.
WINDOW = 50
#: Words of an anchor; one in about (WINDOW - ANCHOR) / 2 words starts one.
ANCHOR = 10
#: Windows that a task compares among themselves before the rest is dealt out.
LOCAL = 1 << 20
#: A run is merged with the next older one unless that is so many times larger.
TIER = 4
#: Marks a row that stands for a whole document.
WHOLE = 0xFFFFFFFF


def _tag(text: bytes) -> int:
    """Tells rows that share a doc_id apart."""
    return zlib.crc32(text)


def _tagged(tag: int, places: np.ndarray) -> np.ndarray:
    return (np.int64(tag) << np.int64(32)) | places.astype(np.int64)


def _untag(values: np.ndarray, tag: int) -> np.ndarray:
    """Places of the rows that carry the tag."""
    return values[(values >> np.int64(32)) & np.int64(WHOLE) == np.int64(tag)] & np.int64(WHOLE)


def _batches(doc: list, n: int) -> pa.Array:
    return pa.array(np.repeat(np.array(doc, dtype=np.int64), n))


def anchors(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, text) -> (hash, doc_id, place) of every anchor of every whole text; place carries the row's tag.

    Null ids and null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHashes()
        for batch in batches:
            hashes, docs_, places = [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if doc_id is None or len(words) < window:
                    continue
                at, grams = W.anchor_places(known.of(words)[0], window, k)
                hashes.append(grams.view(np.int64))
                places.append(_tagged(_tag(text.as_py()), at))
                docs_.append(np.full(len(at), doc_id, dtype=np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, docs_, places)], ["hash", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, POSTINGS)


POSTINGS = "hash long, doc_id long, place long"
RUN = "hash BIGINT, low BIGINT, high BIGINT"


class FingerprintLog:
    """Sorted immutable runs of (hash, low, high): the smallest and largest doc_id that has the fingerprint.

    With a folder (one that driver and executors share) the log outlives its session: after every batch a manifest names
    its runs and the postings (hash, doc_id, place) of all batches, and a log opened on the folder goes on from the last
    complete manifest. A batch that failed half-way is in no manifest; it can be taken again."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, folder: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str, int]] = []
        self.postings: list[str] = []
        self._retired: list[tuple[str, str, int]] = []
        self._version = 0
        if self.folder:
            self._reopen()

    def _reopen(self) -> None:
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-*/_SUCCESS")
        done = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        names = sorted(f.getPath().getParent().getName() for f in done)
        if not names:
            return
        state = json.loads(self.spark.read.text(f"{self.folder}/{names[-1]}").first()[0])
        self._version, self.buckets, self.postings = int(names[-1].split("-")[1]), state["buckets"], state["postings"]
        for path, n in state["runs"]:
            name = f"fingerprint_run_{uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.runs.append((name, path, n))

    def _save(self) -> None:
        """Names the runs in a new manifest, then deletes those that it names no more."""
        if self.folder:
            self._version += 1
            state = json.dumps({"buckets": self.buckets, "postings": self.postings, "runs": [r[1:] for r in self.runs]})
            self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self._version:08d}")
        for run in self._retired:
            self._drop(run)
        self._retired = []

    def path(self, tag: str) -> str:
        return f"{self.folder}/{tag}-{uuid4().hex}" if self.folder else new_path(self.spark, tag)

    def _write(self, rows: DataFrame) -> tuple[str, str, int]:
        name, path = f"fingerprint_run_{uuid4().hex}", self.path("run")
        (
            rows.repartition(self.buckets, "hash").write.option("compression", "zstd").option("path", path)
            .bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        )
        return name, path, self.spark.table(name).count()

    def _drop(self, run: tuple[str, str, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    def ingest(self, feed: DataFrame) -> DataFrame:
        """feed (hash, doc_id) of a new batch -> the hashes that it shares with another document, of the batch or of
        any run; then the batch is a run of the log."""
        batch = self._write(feed.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
        new = self.spark.table(batch[0])
        found = [new.where("low < high").select("hash")]
        for name, _, _ in self.runs:
            old = self.spark.table(name).select("hash", F.col("low").alias("l"), F.col("high").alias("h"))
            met = new.join(old.hint("merge"), "hash").where("low <> l OR high <> h OR l <> h")
            found.append(met.select("hash"))
        shared = durable(reduce(DataFrame.unionByName, found).distinct(), "shared")
        self.runs.append(batch)
        self.compact()
        self._save()
        return shared

    def compact(self) -> None:
        """Merges the newest run into the one before it while that is less than TIER times larger."""
        while len(self.runs) > 1 and self.runs[-2][2] < TIER * self.runs[-1][2]:
            a, b = self.runs[-2:]
            both = self.spark.table(a[0]).unionByName(self.spark.table(b[0]))
            merged = self._write(both.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")))
            self.runs[-2:] = [merged]
            self._retired += [a, b]

    def drop(self) -> None:
        for run in self.runs + self._retired:
            self._drop(run)
        self.runs, self._retired = [], []
        if self.folder:
            remove(self.spark, self.folder)


def _verify(window: int, k: int):
    """(doc_id, text, places) -> rows for the exact comparison: windows (h1, h2, doc_id, places), and what the task knows
    already as runs (doc_id, first place, length) with h1 null."""

    def settle(parts: list) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, place = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, doc, h2, h1))
        h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
        head = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        least = np.repeat(doc[head], np.diff(np.r_[head, len(doc)]))
        known = doc > least
        # a copy of a window of a smaller document in this task is settled here; only the smallest's are dealt out, as
        # one row for each hash however often the document repeats it
        d, p = doc[known], place[known]
        o = np.lexsort((p, d))
        d, p = d[o], p[o]
        if len(d):
            cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
            size = np.diff(np.r_[cut, len(d)])
            none = pa.nulls(len(cut), pa.int64())
            single = _lists(p[cut], np.arange(len(cut)))
            yield pa.RecordBatch.from_arrays([pa.array(d[cut]), none, none, pa.array(d[cut]), single, pa.array(size)], NAMES)
        h1, h2, doc, place = (x[~known] for x in (h1, h2, doc, place))
        head = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        key = pa.array(h1[head].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [key, key, pa.array(h2[head].view(np.int64)), pa.array(doc[head]), _lists(place, head), pa.array(np.ones(len(head), dtype=np.int64))], NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, known = [], 0, W.WordHashes()
        for batch in batches:
            for i, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()))):
                text = text.as_py()
                tag = _tag(text)
                own = _untag(batch["places"][i].values.to_numpy(zero_copy_only=False), tag)
                if not len(own) or (own == WHOLE).any():
                    continue
                first, second = known.of(text.split())
                at, _, _ = W.anchored_windows(first, window, k, np.sort(own))
                h1 = W.mix(W.grams(first, window, W.BASE)[at])
                h2 = W.mix(W.grams(second, window, W.BASE_B)[at])
                parts.append((h1, h2, np.full(len(at), doc_id, dtype=np.int64), _tagged(tag, at)))
                held += len(at)
                if held >= LOCAL:
                    yield from settle(parts)
                    parts, held = [], 0
        if parts:
            yield from settle(parts)

    return run


NAMES = ["deal", "h1", "h2", "doc_id", "places", "length"]
WINDOWS = "deal long, h1 long, h2 long, doc_id long, places array<long>, length long"
FLAGS = "doc_id long, place long, length long"


def _lists(values: np.ndarray, heads: np.ndarray) -> pa.ListArray:
    """Values as lists that start at the heads."""
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)).astype(np.int32)), pa.array(values))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h1, h2, doc_id: passes runs on, and the windows whose hash a smaller document has."""
    last = None
    for batch in batches:
        settled = batch["h1"].is_null().to_numpy(zero_copy_only=False)
        flagged = settled.copy()
        rows = np.flatnonzero(~settled)
        if len(rows):
            h1, h2, doc = (pa.array(batch[n]).take(pa.array(rows)).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "doc_id"))
            head = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            least = doc[head].copy()
            if last and last[:2] == (h1[0], h2[0]):
                least[0] = last[2]
            last = (h1[-1], h2[-1], least[-1])
            flagged[rows] = doc > np.repeat(least, np.diff(np.r_[head, len(doc)]))
        out = batch.filter(pa.array(flagged))
        if out.num_rows:
            n = pc.list_value_length(out["places"]).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(out["doc_id"].to_numpy(), n)), out["places"].flatten(), pa.array(np.repeat(out["length"].to_numpy(), n))], ["doc_id", "place", "length"]
            )


def _copies(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(m, tag, head): texts that several documents have and the smallest of them; (doc_id, place) of the others."""
    same = d.groupBy(F.md5("text").alias("m"), F.crc32(F.col("text").cast("binary")).alias("tag"))
    heads = same.agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail")
    heads = durable(heads.select("m", "tag", "head"), "sub-heads")
    later = d.select("doc_id", F.md5("text").alias("m")).join(heads, "m").where("doc_id > head")
    return heads, durable(later.select("doc_id", F.shiftleft("tag", 32).bitwiseOR(F.lit(WHOLE)).alias("place")).distinct(), "sub-copies")


def _flags(d: DataFrame, places: DataFrame, copies: DataFrame, window: int, k: int) -> DataFrame:
    """Texts, places of their shared anchors and whole copies -> flags of the windows that a smaller document has."""
    grouped = places.unionByName(copies).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    found = d.join(grouped, "doc_id").mapInArrow(_verify(window, k), WINDOWS)
    flags = found.repartition("deal").sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(_compare, FLAGS)
    whole = copies.select("doc_id", "place", F.lit(0).cast("long").alias("length"))
    return flags.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("place", "length")).alias("flags"))


def _usable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def repeated_windows(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, batches: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, flags): the windows whose word sequence also starts in a document with a smaller id,
    as an array of (place, length): tag and first window, number of windows in a row; length 0 stands for all windows.

    Documents enter the log in `batches` ranges of ids, smaller ids first; the result does not depend on the number.
    Whole copies of a smaller document are flagged at once and need no further look. A fingerprint that a third of all
    documents share is reduced to its smallest and largest document before the shuffle, the join back to its places is
    an equi-join that AQE splits, and copies of a window are settled inside the task that reads them, so that at most
    one row for each task and hot window is dealt out."""
    spark = docs.sparkSession
    d = _usable(docs)
    heads, copies = _copies(d)
    bounds = sorted(set(d.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    part = reduce(lambda c, b: c + (F.col("doc_id") > b).cast("int"), bounds, F.lit(0))
    feed = durable(anchors(d, window, k).withColumn("batch", part), "sub-anchors", "batch")
    log = FingerprintLog(spark)
    try:
        shared = [log.ingest(feed.where(F.col("batch") == i).select("hash", "doc_id")) for i in range(len(bounds) + 1)]
    finally:
        log.drop()
    hot = durable(reduce(DataFrame.unionByName, shared).distinct(), "sub-shared")
    flags = durable(_flags(d, feed.join(hot, "hash").select("doc_id", "place"), copies, window, k), "sub-flags")
    discard(heads, copies, feed, hot, *shared)
    return flags


def dedupe_batch(log: FingerprintLog, batch: DataFrame, earlier: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Adds a batch (doc_id, text) to a log and returns the flags of its documents, as repeated_windows() does: windows that
    also start in a document with a smaller id, of the batch or of any before it.

    earlier holds (doc_id, text) of the documents that went into the log before; only those that share an anchor with
    the batch are looked at. Batches with ascending ids together get the flags of one call on all of them; a document
    is never judged again when a later batch brings a smaller id. Null ids and texts are left out; an empty batch gets
    no flags."""
    spark = batch.sparkSession
    d = _usable(batch)
    path = log.path("postings")
    anchors(d, window, k).write.option("compression", "zstd").parquet(path)
    feed = spark.read.schema(POSTINGS).parquet(path)
    log.postings.append(path)
    shared = log.ingest(feed.select("hash", "doc_id"))
    places = spark.read.schema(POSTINGS).parquet(*log.postings).join(shared, "hash").select("doc_id", "place")
    heads, copies = _copies(d)
    flags = _flags(d.unionByName(_usable(earlier)), places, copies, window, k)
    out = durable(flags.join(d.select("doc_id").distinct(), "doc_id", "left_semi"), "sub-flags")
    discard(heads, copies, shared)
    return out


def _remove(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept = [], [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                text = text.as_py() or b""
                data = np.frombuffer(text, dtype=np.uint8)
                starts, _ = W.word_spans(data)
                n = len(starts)
                gone = np.zeros(n, dtype=bool)
                flags = batch["flags"][i]
                if n >= window and flags.is_valid:
                    place = flags.values.field("place").to_numpy(zero_copy_only=False)
                    length = flags.values.field("length").to_numpy(zero_copy_only=False)
                    own = (place >> np.int64(32)) & np.int64(WHOLE) == np.int64(_tag(text))
                    place, length = place[own] & np.int64(WHOLE), length[own]
                    if (length == 0).any():
                        gone[:] = True
                    elif len(place):
                        gone = W.covered(n, place, length + (window - 1))
                words = text.split() if not gone.all() else []
                stay = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(stay)).hexdigest())
                if keep_text:
                    if gone.any():
                        # a removed word goes with the blanks after it
                        cut = np.r_[starts[1:], len(data)]
                        byte = np.ones(len(data), dtype=bool)
                        byte &= ~W.covered(len(data), starts[gone], (cut - starts)[gone])
                        text = data[byte].tobytes()
                    kept.append(text.decode())
            out = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["n_words", "n_removed", "kept_sha256"]
            if keep_text:
                out.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            rest = [i for i, c in enumerate(batch.schema.names) if c != "flags"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + out, [batch.schema.names[i] for i in rest] + names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, batches: int = 3, keep_text: bool = True) -> DataFrame:
    """Adds n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with keep_text, kept_text (the
    text without the removed words and the blanks after them, otherwise as it was) to each row.

    Removed is each word that a window covers whose words also start in a document with a smaller id. Null texts count
    as empty; rows with a null id or fewer words than a window lose nothing; rows that repeat an id have the same id, not
    a smaller one. No rows give no rows. Columns of docs with a name of the results, or named flags, are replaced or left out."""
    docs = docs.drop("flags", "n_words", "n_removed", "kept_sha256", "kept_text")
    flags = repeated_windows(docs, window, k, batches)
    fields = [*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    if keep_text:
        fields.append(StructField("kept_text", StringType()))
    return docs.join(flags, "doc_id", "left").select(*docs.columns, "flags").mapInArrow(_remove(window, keep_text), StructType(fields))
