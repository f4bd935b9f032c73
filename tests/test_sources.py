"""Formats: what is written comes back, and bad lines are handled as asked."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.prefix import positions
from tessera.operators.construct import csc_rows
from tessera.operators.schedule import BACKWARD, Chunk, absolute_layer, chunks_of, is_last, may_run, next_gat, next_gcn
from tessera.operators.sampling import blocks, dropout
from tessera.plans.trainer import Run
from tessera.sources import binary, cache, generate, text
from tessera.streaming.edges import degree_stream, edge_stream


def test_text_edges(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("# c\n0 1\n\n% x\n2,3\n1 1\nbad\n4 5\n")
    got = lambda mode: sorted(tuple(r) for r in text.read_edges(spark, str(p), mode).collect())
    assert got("drop") == [(0, 1), (1, 1), (2, 3), (4, 5)]
    assert got("stop") == [(0, 1), (1, 1), (2, 3)]
    with pytest.raises(Exception, match="no edge"):
        got("fail")
    assert tuple(text.edge_summary(text.read_edges(spark, str(p), "drop")).first()) == (6, 3)


def test_numbered_lines_over_many_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("vid"), (F.col("id") * 3 % 7).alias("label"))
    text.write_ordered(df, "vid", "label", str(tmp_path / "l"))
    got = text.read_labels(spark, str(tmp_path / "l"))
    assert got.join(df.withColumnRenamed("label", "want"), "vid").where("label = want").count() == 1000


def test_features_text_keeps_negative_first_values(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("-1.5, 2\nhead\n3 4\n")
    assert [(r["vid"], r["feat"]) for r in text.read_features(spark, str(p)).orderBy("vid").collect()] == [(0, [-1.5, 2.0]), (1, [3.0, 4.0])]


def test_snapshots_round_trip_and_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "SPLIT", 64)
    e = spark.createDataFrame([(i, i * 7 % 50) for i in range(50)], "src long, dst long")
    binary.write_edges(e, 50, str(tmp_path / "e"))
    kept = sorted(tuple(r) for r in e.where("src <> dst").collect())
    assert sorted(tuple(r) for r in binary.read_snapshot(spark, str(tmp_path / "e"), "edges").collect()) == kept
    binary.merge(str(tmp_path / "e"), str(tmp_path / "one.bin"))
    raw = (tmp_path / "one.bin").read_bytes()
    assert struct.unpack("<iIQ", raw[:16]) == (4, 50, len(kept)) and len(raw) == 16 + 8 * len(kept)
    assert sorted(tuple(r) for r in binary.read_snapshot(spark, str(tmp_path / "one.bin"), "edges").collect()) == kept
    x = spark.range(30).select(F.col("id").alias("vid"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("feat"))
    binary.write_features(x, 2, str(tmp_path / "x"))
    assert [r["feat"] for r in binary.read_snapshot(spark, str(tmp_path / "x"), "features").orderBy("vid").collect()] == [[float(i), 0.5] for i in range(30)]
    (tmp_path / "raw").write_bytes(np.arange(6, dtype="<f4").tobytes())
    binary.prepend_width(str(tmp_path / "raw"), 3, str(tmp_path / "w.bin"))
    assert [r["feat"] for r in binary.read_snapshot(spark, str(tmp_path / "w.bin"), "features").orderBy("vid").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_csc_export_and_matrix_dump(spark, tmp_path):
    e = spark.createDataFrame([(2, 0), (1, 0), (1, 0), (0, 2)], "src long, dst long")
    binary.write_csc(csc_rows(e), 3, str(tmp_path / "m.csc"))
    raw = (tmp_path / "m.csc").read_bytes()
    assert struct.unpack("<IQQQQIII", raw[:4] + raw[4:28] + raw[28:36] + raw[36:]) == (3, 2, 2, 3, 3, 1, 2, 0)
    m = np.arange(6.0).reshape(2, 3)
    binary.save_matrix(m, str(tmp_path / "d.bin"))
    assert np.array_equal(binary.load_matrix(str(tmp_path / "d.bin")), m)


def test_layer_config(tmp_path):
    (tmp_path / "a").write_text("602\n128\n41\n")
    assert text.read_layers(str(tmp_path / "a")) == [602, 128, 41]
    (tmp_path / "b").write_text("602\n")
    with pytest.raises(ValueError):
        text.read_layers(str(tmp_path / "b"))


def test_cache_is_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(calls) == 1


def test_generators(spark):
    rows = generate.random_features(spark, 50, 12, seed=3).collect()
    filled = [sum(v != 0 for v in r["feat"]) for r in rows]
    assert min(filled) >= 4 and max(filled) <= 9 and all(-1 <= v < 1 for r in rows for v in r["feat"])
    labels = {r["label"] for r in generate.random_labels(spark, 500, 4).collect()}
    assert labels == {0, 1, 2, 3}
    g = generate.random_graph(spark, 100, 0.1)
    assert g.where("src = dst").count() == 0 and 700 < g.count() < 1300 and g.distinct().count() == g.count()


def test_positions_over_ranges(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("k"), (F.col("id") % 3).alias("g"))
    got = positions(df, "k", "pos", "g", width=16).collect()
    for g in range(3):
        mine = sorted((r["k"], r["pos"]) for r in got if r["g"] == g)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_chunks_and_successors():
    assert [(c.low, c.high) for c in chunks_of(10, 4)] == [(0, 3), (3, 6), (6, 9), (9, 10)]
    c, seen = Chunk(0, 0, 0, 3), []
    for _ in range(4):
        seen.append((c.layer, c.direction, c.epoch))
        c = next_gcn(c, 2)
    assert seen == [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)] and c == Chunk(0, 0, 0, 3, epoch=2)
    assert next_gat(Chunk(0, 0, 0, 3)).layer == 1 and absolute_layer(Chunk(0, 0, 0, 3, 1, BACKWARD), 2) == 2
    assert is_last(Chunk(0, 0, 0, 3, 0, BACKWARD)) and not is_last(Chunk(0, 0, 0, 3, 1, BACKWARD))
    assert sorted([Chunk(1, 0, 0, 1), Chunk(0, 0, 0, 1, direction=BACKWARD), Chunk(0, 0, 0, 1, epoch=2)], key=Chunk.priority)[0].chunk == 1
    assert may_run(3, 2, 1) and not may_run(4, 2, 1) and may_run(9, 0, None)


def test_blocks_reach_the_seeds(spark):
    e = spark.createDataFrame([(a, b) for b in range(20) for a in range(20) if a != b], "src long, dst long")
    outer, inner = blocks(e, spark.createDataFrame([(0,), (1,)], "vid long"), [4, 3], seed=5)
    assert all(r["count"] == 3 for r in inner.groupBy("dst").count().collect()) and inner.select("dst").distinct().count() == 2
    need = {r["src"] for r in inner.collect()} | {0, 1}
    assert {r["dst"] for r in outer.collect()} == need
    assert all(r["count"] == 4 for r in outer.groupBy("dst").count().collect())


def test_dropout_keeps_the_mean(spark):
    x = spark.range(2000).select("id", F.array(F.lit(1.0), F.lit(1.0)).alias("f"))
    got = x.select(dropout(F.col("f"), 0.25, 7, F.col("id")).alias("f")).select(F.explode("f").alias("v")).agg(F.avg("v")).first()[0]
    assert got == pytest.approx(1, abs=0.05)


def test_run_summary(tmp_path):
    text.write_run_summary(Run([], [{"epoch": 0, "acc": 0.5}]), str(tmp_path / "r.json"))
    assert "EARLY" in (tmp_path / "r.json").read_text()


def test_degree_stream(spark, tmp_path):
    spark.createDataFrame([(0, 1), (2, 1), (3, 3)], "src long, dst long").write.parquet(str(tmp_path / "in" / "a"))
    q = degree_stream(edge_stream(spark, str(tmp_path / "in" / "*"))).writeStream.outputMode("complete").format("memory").queryName("degrees").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("SELECT vid, deg FROM degrees").collect()] == [(1, 2)]
