"""Binary snapshots: edges, features and labels, read by byte ranges through a Python data source.

A snapshot is one file, or a folder with header.bin and data files that in name order are the rest; tasks write such
folders in parallel, merge() makes one file of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Header layouts. Edges: bytes of an id, vertices, edges. Features: width. Labels: kinds.
HEADERS = {"edges": "<iIQ", "features": "<I", "labels": "<I"}
SPLIT = 64 << 20


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")




def read_header(path: str, kind: str) -> tuple:
    fs, p = _fs(path)
    folder = fs.get_file_info(p).type == pafs.FileType.Directory
    layout = HEADERS[kind]
    with fs.open_input_file(f"{p}/header.bin" if folder else p) as f:
        return struct.unpack(layout, f.read(struct.calcsize(layout)))


def _pieces(path: str, kind: str, record: int) -> list[tuple[str, int, int, int]]:
    """(file, offset, records, number of its first record), at most SPLIT bytes each."""
    fs, p = _fs(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        infos = sorted((i.path, i.size, 0) for i in fs.get_file_info(pafs.FileSelector(p)) if i.path.endswith(".bin") and not i.path.endswith("header.bin"))
    else:
        infos = [(p, fs.get_file_info(p).size, struct.calcsize(HEADERS[kind]))]
    out, first, step = [], 0, max(1, SPLIT // record)
    for file, size, skip in infos:
        n = (size - skip) // record
        for a in range(0, n, step):
            out.append((file, skip + a * record, min(step, n - a), first + a))
        first += n
    return out


class _Piece(InputPartition):
    def __init__(self, file: str, offset: int, n: int, first: int):
        self.file, self.offset, self.n, self.first = file, offset, n, first


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind
        self.width = read_header(path, kind)[0] if kind == "features" else 0
        self.record = {"edges": 8, "features": 4 * self.width, "labels": 4}[kind]

    def partitions(self):
        return [_Piece(*p) for p in _pieces(self.path, self.kind, self.record)] or [_Piece("", 0, 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        fs, _ = _fs(self.path)
        with fs.open_input_file(partition.file) as f:
            f.seek(partition.offset)
            data = f.read(partition.n * self.record)
        vid = pa.array(np.arange(partition.first, partition.first + partition.n, dtype=np.int64))
        if self.kind == "edges":
            pairs = np.frombuffer(data, dtype="<u4").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])
        elif self.kind == "labels":
            yield pa.RecordBatch.from_arrays([vid, pa.array(np.frombuffer(data, dtype="<u4").astype(np.int32))], ["vid", "label"])
        else:
            flat = np.frombuffer(data, dtype="<f4").astype(np.float64)
            at = np.arange(0, len(flat) + 1, self.width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([vid, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["vid", "feat"])


class SnapshotSource(DataSource):
    """spark.read.format("tessera_snapshot").option("kind", "edges" | "features" | "labels").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "tessera_snapshot"

    def schema(self) -> str:
        return {"edges": "src bigint, dst bigint", "features": "vid bigint, feat array<double>", "labels": "vid bigint, label int"}[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["kind"])


def read_snapshot(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("tessera_snapshot").option("kind", kind).load(path)


def _write(df: DataFrame, path: str, header: bytes, encode) -> None:
    """Each task writes the rows of its partition to one file, named by the partition; a repeated task writes the same
    file again."""
    fs, p = _fs(path)
    fs.create_dir(p, recursive=True)
    with fs.open_output_stream(f"{p}/header.bin", compression=None) as f:
        f.write(header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base = _fs(path)
        part, n = TaskContext.get().partitionId(), 0
        with out.open_output_stream(f"{base}/part-{part:06d}.bin", compression=None) as f:
            for batch in batches:
                f.write(encode(batch))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_edges(edges: DataFrame, n_vertices: int, path: str, undirected: bool = False) -> None:
    """Self edges are left out; undirected writes both directions."""
    e = edges.where("src <> dst").select("src", "dst")
    if undirected:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    n = e.count()
    _write(e, path, struct.pack(HEADERS["edges"], 4, n_vertices, n), lambda b: np.stack([b["src"].to_numpy(), b["dst"].to_numpy()], axis=1).astype("<u4").tobytes())


def write_features(x: DataFrame, width: int, path: str) -> None:
    _write(x.orderBy("vid").select("feat"), path, struct.pack(HEADERS["features"], width), lambda b: b["feat"].flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())


def write_labels(labels: DataFrame, kinds: int, path: str) -> None:
    _write(labels.orderBy("vid").select("label"), path, struct.pack(HEADERS["labels"], kinds), lambda b: b["label"].to_numpy().astype("<u4").tobytes())


def merge(path: str, out: str) -> None:
    """One file of a folder, streamed."""
    fs, p = _fs(path)
    to, q = _fs(out)
    names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(p)) if i.path.endswith(".bin") and not i.path.endswith("header.bin"))
    with to.open_output_stream(q, compression=None) as f:
        for name in [f"{p}/header.bin", *names]:
            with fs.open_input_stream(name, compression=None) as g:
                while block := g.read(1 << 20):
                    f.write(block)


def prepend_width(raw: str, width: int, out: str) -> None:
    """A raw matrix file becomes a feature snapshot: its width goes before it."""
    fs, p = _fs(raw)
    to, q = _fs(out)
    with fs.open_input_stream(p, compression=None) as g, to.open_output_stream(q, compression=None) as f:
        f.write(struct.pack(HEADERS["features"], width))
        while block := g.read(1 << 20):
            f.write(block)


def write_csc(rows: DataFrame, n: int, path: str) -> None:
    """Compressed columns in one file: u32 n, u64 offsets 1..n, u64 entries, u32 rows; rows (vid, rows) as csc_rows()
    gives them. Meant for export to one machine; entries are streamed by vertex."""
    counts = np.zeros(n, dtype="<u8")
    for r in rows.select("vid", F.size("rows").alias("k")).toLocalIterator():
        counts[r["vid"]] = r["k"]
    fs, p = _fs(path)
    with fs.open_output_stream(p, compression=None) as f:
        f.write(struct.pack("<I", n) + np.cumsum(counts).astype("<u8").tobytes() + struct.pack("<Q", int(counts.sum())))
        for r in rows.orderBy("vid").select("rows").toLocalIterator():
            f.write(np.array(r["rows"], dtype="<u4").tobytes())


def save_matrix(m: np.ndarray, path: str) -> None:
    fs, p = _fs(path)
    with fs.open_output_stream(p, compression=None) as f:
        f.write(struct.pack("<II", *m.shape) + m.astype("<f4").tobytes())


def load_matrix(path: str) -> np.ndarray:
    fs, p = _fs(path)
    with fs.open_input_file(p) as f:
        rows, cols = struct.unpack("<II", f.read(8))
        return np.frombuffer(f.read(), dtype="<f4").reshape(rows, cols).astype(np.float64)
