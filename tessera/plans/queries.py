"""One query for each operator of the inventory that SQL can check, with that SQL; see README for the numbering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrays as A
from ..operators import construct as B, costs as L, dense as D, evaluate as G, layers as Y, sampling as K
from ..operators.gather import (
    attention_gather, attention_gather_backward, column_sum, edge_rows, expand_dot, expand_hadamard, gather, graph_convolution, neighbour_sum,
    outer_product_sum,
)
from ..operators.parameters import SGD, Adam, gcn_parameters, kaiming, xavier
from ..session import scratch_path
from ..sources import binary, cache, generate, text
from . import sage
from .graph import Graph, bipartite_edges, graph_from_tables, n_vertices, raw_edges, read_table
from .trainer import GatTrainer, GcnTrainer, Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SIZES = [64, 16, 10]
PARTS, CHUNKS = 4, 3
D_ = "CAST({} AS DOUBLE)"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def entries(df: DataFrame, feat: str = "feat", key: str = "vid") -> DataFrame:
    """Long form of an array column, rounded."""
    return df.select(key, F.posexplode(feat).alias("i", "v")).select(key, "i", r6("v").alias("val"))


def vector_sql(values) -> str:
    return ", ".join(f"({i}, CAST({float(v)!r} AS DOUBLE))" for i, v in enumerate(values))


def matrix_sql(m: np.ndarray) -> str:
    return ", ".join(f"({i}, {j}, CAST({float(m[i, j])!r} AS DOUBLE))" for i in range(m.shape[0]) for j in range(m.shape[1]))


W0, W1 = (p["w"] for p in gcn_parameters(SIZES))
A_VEC = xavier(16, 1)[:, 0]

_CTE = {
    "nn": "SELECT count(*) AS n FROM embeddings",
    "v": "SELECT vec_id AS vid, label, CAST(vec_id % 4 AS INTEGER) AS part FROM embeddings",
    "e0": "SELECT l_partkey % n AS src, l_orderkey % n AS dst FROM lineitem, nn",
    "e": "SELECT src, dst FROM e0 WHERE src <> dst",
    "x": "SELECT vec_id AS vid, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings",
    "deg": "SELECT v.vid, count(e.dst) AS deg FROM v LEFT JOIN e ON e.dst = v.vid GROUP BY v.vid",
    "odeg": "SELECT v.vid, count(e.src) AS deg FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid",
    "ne": "SELECT e.src, e.dst, 1 / sqrt(CAST(s.deg + 1 AS DOUBLE) * (d.deg + 1)) AS w FROM e JOIN deg s ON s.vid = e.src JOIN deg d ON d.vid = e.dst",
    "sn": "SELECT vid, 1 / CAST(deg + 1 AS DOUBLE) AS w FROM deg",
    "k": "SELECT e.src, e.dst, s.part AS psrc, d.part AS pdst, CASE WHEN s.part = d.part THEN 'L' ELSE 'R' END AS kind FROM e JOIN v s ON s.vid = e.src JOIN v d ON d.vid = e.dst",
    "w0": f"SELECT * FROM (VALUES {matrix_sql(W0)}) AS t(i, j, val)",
    "w1": f"SELECT * FROM (VALUES {matrix_sql(W1)}) AS t(i, j, val)",
    "av": f"SELECT * FROM (VALUES {vector_sql(A_VEC)}) AS t(i, val)",
    "ah": "SELECT vid, i, sum(val) AS val FROM (SELECT ne.dst AS vid, x.i, ne.w * x.val AS val FROM ne JOIN x ON x.vid = ne.src UNION ALL SELECT x.vid, x.i, sn.w * x.val FROM sn JOIN x ON x.vid = sn.vid) GROUP BY vid, i",
    "z0": "SELECT ah.vid, w0.j AS i, sum(ah.val * w0.val) AS val FROM ah JOIN w0 ON w0.i = ah.i GROUP BY ah.vid, w0.j",
    "h0": "SELECT vid, i, tanh(val) AS val FROM z0",
    "ah1": "SELECT vid, i, sum(val) AS val FROM (SELECT ne.dst AS vid, h0.i, ne.w * h0.val AS val FROM ne JOIN h0 ON h0.vid = ne.src UNION ALL SELECT h0.vid, h0.i, sn.w * h0.val FROM sn JOIN h0 ON h0.vid = sn.vid) GROUP BY vid, i",
    "z1": "SELECT ah1.vid, w1.j AS i, sum(ah1.val * w1.val) AS val FROM ah1 JOIN w1 ON w1.i = ah1.i GROUP BY ah1.vid, w1.j",
    "ex1": "SELECT vid, i, exp(val - max(val) OVER (PARTITION BY vid)) AS val FROM z1",
    "p1": "SELECT vid, i, val / (sum(val) OVER (PARTITION BY vid) + 1e-20) AS val FROM ex1",
    "sp": "SELECT vid, label, CASE WHEN pos < floor(n * CAST(0.66 AS DOUBLE)) THEN 'train' WHEN pos < floor(n * CAST(0.66 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT vid, label, row_number() OVER (ORDER BY vid) - 1 AS pos, count(*) OVER () AS n FROM v)",
    "d1": "SELECT p1.vid, p1.i, CASE WHEN sp.split = 'train' THEN (p1.val - CASE WHEN p1.i = sp.label THEN 1 ELSE 0 END) / (nn.n * CAST(0.66 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS val FROM p1 JOIN sp ON sp.vid = p1.vid, nn",
    "gr1": "SELECT d1.vid, w1.i AS i, sum(d1.val * w1.val) AS val FROM d1 JOIN w1 ON w1.j = d1.i GROUP BY d1.vid, w1.i",
    "atg": "SELECT vid, i, sum(val) AS val FROM (SELECT ne.src AS vid, gr1.i, ne.w * gr1.val AS val FROM ne JOIN gr1 ON gr1.vid = ne.dst UNION ALL SELECT gr1.vid, gr1.i, sn.w * gr1.val FROM sn JOIN gr1 ON gr1.vid = sn.vid) GROUP BY vid, i",
    "g0": "SELECT atg.vid, atg.i, atg.val * (1 - tanh(z0.val) * tanh(z0.val)) AS val FROM atg JOIN z0 ON z0.vid = atg.vid AND z0.i = atg.i",
    "zg": "SELECT x.vid, w0.j AS i, sum(x.val * w0.val) AS val FROM x JOIN w0 ON w0.i = x.i GROUP BY x.vid, w0.j",
    "azv": "SELECT zg.vid, sum(zg.val * av.val) AS az FROM zg JOIN av ON av.i = zg.i GROUP BY zg.vid",
    "sc": "SELECT e.src, e.dst, azv.az, CASE WHEN azv.az > 0 THEN azv.az ELSE azv.az * CAST(0.01 AS DOUBLE) END AS a, CASE WHEN azv.az > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END AS da FROM e JOIN azv ON azv.vid = e.dst",
    "gah": "SELECT vid, i, sum(val) AS val FROM (SELECT sc.dst AS vid, zg.i, sc.a * zg.val AS val FROM sc JOIN zg ON zg.vid = sc.src UNION ALL SELECT vid, i, val FROM zg) GROUP BY vid, i",
    "gex": "SELECT vid, i, exp(val - max(val) OVER (PARTITION BY vid)) AS val FROM gah",
    "gp": "SELECT gex.vid, gex.i, gex.val / (sum(gex.val) OVER (PARTITION BY gex.vid) + 1e-20) AS val FROM gex",
    "gg": "SELECT gp.vid, gp.i, gp.val - CASE WHEN gp.i = v.label THEN 1 ELSE 0 END AS val FROM gp JOIN v ON v.vid = gp.vid",
    "gav": "SELECT gg.vid, sum(gg.val * av.val) AS ga FROM gg JOIN av ON av.i = gg.i GROUP BY gg.vid",
    "gda": "SELECT sc.src, sc.dst, sc.da * gav.ga AS da FROM sc JOIN gav ON gav.vid = sc.dst",
    "gatg": "SELECT vid, i, sum(val) AS val FROM (SELECT vid, i, val FROM gg UNION ALL SELECT sc.src, gg.i, sc.a * gg.val FROM sc JOIN gg ON gg.vid = sc.dst UNION ALL SELECT gda.dst, zg.i, gda.da * zg.val FROM gda JOIN zg ON zg.vid = gda.src) GROUP BY vid, i",
    "sm": "SELECT vid, i, avg(val) AS val FROM (SELECT e.dst AS vid, x.i, x.val FROM e JOIN x ON x.vid = e.src UNION ALL SELECT vid, i, val FROM x) GROUP BY vid, i",
    "sh": "SELECT sm.vid, w0.j AS i, greatest(sum(sm.val * w0.val), 0) AS val FROM sm JOIN w0 ON w0.i = sm.i GROUP BY sm.vid, w0.j",
    "sm1": "SELECT vid, i, avg(val) AS val FROM (SELECT e.dst AS vid, sh.i, sh.val FROM e JOIN sh ON sh.vid = e.src UNION ALL SELECT vid, i, val FROM sh) GROUP BY vid, i",
    "sz": "SELECT sm1.vid, w1.j AS i, sum(sm1.val * w1.val) AS val FROM sm1 JOIN w1 ON w1.i = sm1.i GROUP BY sm1.vid, w1.j",
}


def sql(body: str) -> str:
    """body with the named subqueries that it uses, directly or not, before it."""
    import re

    order: list[str] = []

    def need(t: str) -> None:
        for n in _CTE:
            if n not in order and re.search(rf"(?:FROM|JOIN|,)\s+{n}\b", t):
                need(_CTE[n])
                if n not in order:
                    order.append(n)

    need(body)
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in order) + " " + body if order else body


def graph(spark: SparkSession, sf: str) -> Graph:
    return graph_from_tables(spark, sf, PARTS)


def normed(g: Graph) -> tuple[DataFrame, DataFrame]:
    return B.normalize(g.vertices, g.edges)


VAL = "round({}, 6) + 0.0"
LONG = "SELECT vid, CAST(i AS INTEGER) AS i, round(val, 6) + 0.0 AS val FROM {}"

# --- A: sources and sinks ----------------------------------------------------------------------------------------


@query("a01_edge_text_scan", sql("SELECT max(greatest(src, dst)) + 1 AS n_vertices, count(*) FILTER (src <> dst) AS n_edges FROM e0"))
def _(s, d):
    path = scratch_path(s, "edges")
    text.write_edges(raw_edges(s, d), path)
    return text.edge_summary(text.read_edges(s, path))


@query("a02_edges_undirected_snapshot", sql("SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS total FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY src"))
def _(s, d):
    path = scratch_path(s, "bsnap")
    binary.write_edges(raw_edges(s, d), n_vertices(s, d), path, undirected=True)
    return binary.read_snapshot(s, path, "edges").groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("total"))


@query("a03_edge_snapshot_scan", sql("SELECT dst, count(*) AS n, CAST(sum(src) AS BIGINT) AS total FROM e GROUP BY dst"))
def _(s, d):
    path = scratch_path(s, "bsnap")
    binary.write_edges(raw_edges(s, d), n_vertices(s, d), path)
    return binary.read_snapshot(s, path, "edges").groupBy("dst").agg(F.count("*").alias("n"), F.sum("src").alias("total"))


@query("a04_partition_scan", sql("SELECT vid, part, row_number() OVER (PARTITION BY part ORDER BY vid) - 1 AS lvid FROM v"))
def _(s, d):
    path = scratch_path(s, "parts")
    text.write_ordered(graph(s, d).vertices, "vid", "part", path)
    return B.local_ids(text.read_parts(s, path))


@query("a05_feature_text", sql(LONG.format("x")))
def _(s, d):
    path = scratch_path(s, "features")
    text.write_ordered(text.feature_lines(graph(s, d).features()), "vid", "line", path)
    return entries(text.read_features(s, path))


@query("a06_label_text", sql("SELECT vid, label FROM v"))
def _(s, d):
    path = scratch_path(s, "labels")
    text.write_ordered(graph(s, d).vertices, "vid", "label", path)
    return text.read_labels(s, path)


@query("a07_feature_snapshot", sql(LONG.format("x")))
def _(s, d):
    path = scratch_path(s, "features")
    binary.write_features(graph(s, d).features(), 64, path)
    return entries(binary.read_snapshot(s, path, "features"))


@query("a08_label_one_hot", sql("SELECT vid, CAST(i AS INTEGER) AS i, CASE WHEN i = label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS val FROM v, (SELECT unnest(range(10)) AS i)"))
def _(s, d):
    path = scratch_path(s, "labels")
    binary.write_labels(graph(s, d).vertices, 10, path)
    return entries(binary.read_snapshot(s, path, "labels").select("vid", A.one_hot(F.col("label"), 10).alias("feat")))


@query("a09_layer_config", "SELECT CAST(i AS INTEGER) AS layer, size FROM (VALUES (0, 64), (1, 16), (2, 10)) AS t(i, size)")
def _(s, d):
    import os
    import tempfile

    handle, path = tempfile.mkstemp()
    os.write(handle, "\n".join(map(str, SIZES)).encode())
    os.close(handle)
    sizes = text.read_layers(path)
    os.unlink(path)
    return s.createDataFrame(list(enumerate(sizes)), "layer int, size int")


@query("a10_preprocessed_dump", sql("SELECT src, dst, count(*) AS n, round(min(w), 6) + 0.0 AS w FROM ne GROUP BY src, dst"))
def _(s, d):
    g, path = graph(s, d), scratch_path(s, "graph")
    cache.dump_graph(B.preprocess(g.vertices, g.edges), path)
    return cache.load_graph(s, path, ["norm_edges"])["norm_edges"].groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.min("w")).alias("w"))


@query("a11_feature_cache", sql(LONG.format("x")))
def _(s, d):
    path = scratch_path(s, "cache")
    cache.cached(s, path, lambda: graph(s, d).features())
    return entries(cache.cached(s, path, lambda: 1 / 0))


@query("a12_csc_rows", sql("SELECT dst AS vid, array_to_string(list_sort(list(DISTINCT src)), ',') AS row_ids, CAST(sum(count(DISTINCT src)) OVER (ORDER BY dst) AS BIGINT) AS offset_end FROM e GROUP BY dst"))
def _(s, d):
    from ..functions.prefix import running_total

    rows = B.csc_rows(graph(s, d).edges).withColumn("n", F.size("rows"))
    rows = running_total(rows, "vid", "n", "before")
    return rows.select("vid", F.array_join("rows", ",").alias("row_ids"), (F.col("before") + F.col("n")).cast("long").alias("offset_end"))


@query("a13_random_features")
def _(s, d):
    return entries(generate.random_features(s, n_vertices(s, d), 64))


@query("a14_random_labels", sql("SELECT vec_id AS vid, CAST(floor(CAST(('0x' || substr(md5('0:l:' || vec_id), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) * 10) AS INTEGER) AS label FROM embeddings"))
def _(s, d):
    return generate.random_labels(s, n_vertices(s, d), 10)


@query("a15_random_graph")
def _(s, d):
    return generate.random_graph(s, 2000, 0.005)


@query("a16_snapshot_to_text", sql("SELECT vid, count(*) AS n, round(sum(val), 4) + 0.0 AS total FROM x GROUP BY vid"))
def _(s, d):
    a, b = scratch_path(s, "features"), scratch_path(s, "text")
    binary.write_features(graph(s, d).features(), 64, a)
    text.write_ordered(text.feature_lines(binary.read_snapshot(s, a, "features"), " "), "vid", "line", b)
    return text.read_features(s, b).select("vid", F.size("feat").cast("long").alias("n"), (F.round(A.total("feat"), 4) + F.lit(0.0)).alias("total"))


@query("a17_comparison_tables", sql("SELECT src_id, dst_id, CAST(1 AS DOUBLE) AS weight FROM (SELECT src AS src_id, dst AS dst_id FROM e UNION SELECT vid, vid FROM v)"))
def _(s, d):
    g, path = graph(s, d), scratch_path(s, "tables")
    text.write_tab(text.edge_table(g.edges, g.vertices), path)
    return s.read.schema("src_id long, dst_id long, weight double").option("sep", "\t").option("header", True).csv(path)


@query("a19_metrics_sink", "SELECT CAST(epoch AS INTEGER) AS epoch, n, acc, loss, ms FROM (VALUES (0, 50, CAST(0.5 AS DOUBLE), CAST(1.25 AS DOUBLE), CAST(10 AS DOUBLE)), (1, 50, CAST(0.75 AS DOUBLE), CAST(1 AS DOUBLE), CAST(8 AS DOUBLE))) AS t(epoch, n, acc, loss, ms)")
def _(s, d):
    path, schema = scratch_path(s, "metrics"), "epoch int, n long, acc double, loss double, ms double"
    text.write_metrics(s.createDataFrame([(0, 50, 0.5, 1.25, 10.0), (1, 50, 0.75, 1.0, 8.0)], schema), path)
    return s.read.schema(schema).json(path)


@query("a20_graph_metrics", sql("SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM k WHERE kind = 'L') AS n_local, (SELECT count(*) FROM k WHERE kind = 'R') AS n_remote"))
def _(s, d):
    g = graph(s, d)
    e = B.classify_edges(g.edges, g.vertices).agg(F.count("*").alias("n_edges"), F.count_if(F.col("kind") == "L").alias("n_local"), F.count_if(F.col("kind") == "R").alias("n_remote"))
    return g.vertices.agg(F.count("*").alias("n_vertices")).join(e)


@query("a21_signature", sql("SELECT round(sum(abs(val)), 4) + 0.0 AS abs_total FROM x"))
def _(s, d):
    return D.sum_all(D.to_long(graph(s, d).features())).select((F.round("abs_total", 4) + F.lit(0.0)).alias("abs_total"))


@query("a22_type_masks", sql("SELECT vid, label % 3 + 1 = 1 AS train, label % 3 + 1 = 2 AS val, label % 3 + 1 = 3 AS test FROM v"))
def _(s, d):
    return text.type_masks(graph(s, d).vertices.withColumn("node_type", F.col("label") % 3 + 1)).select("vid", "train", "val", "test")


@query("a24_weight_dump", f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(val, 6) + 0.0 AS val FROM (VALUES {matrix_sql(W1)}) AS t(i, j, val)")
def _(s, d):
    lines = s.createDataFrame([(i, " ".join(repr(float(x)) for x in row)) for i, row in enumerate(W1)], "i int, line string")
    return text.read_weight_dump(lines).select("i", "j", r6("val").alias("val"))


# --- B: construction ---------------------------------------------------------------------------------------------


@query("b01_drop_self_edges", sql("SELECT count(*) AS n FROM e"))
def _(s, d):
    return graph(s, d).edges.agg(F.count("*").alias("n"))


@query("b02_symmetrize", "WITH p AS (SELECT count(*) AS n FROM part), f AS (SELECT l_partkey AS src, l_suppkey + n AS dst FROM lineitem, p) SELECT src, count(*) AS n FROM (SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f) GROUP BY src")
def _(s, d):
    return B.symmetrize(bipartite_edges(s, d)).groupBy("src").agg(F.count("*").alias("n"))


@query("b03_edge_classes", sql("SELECT psrc, pdst, kind, count(*) AS n FROM k GROUP BY psrc, pdst, kind"))
def _(s, d):
    g = graph(s, d)
    return B.classify_edges(g.edges, g.vertices).groupBy("psrc", "pdst", "kind").agg(F.count("*").alias("n"))


@query("b04_boundary", sql("SELECT DISTINCT src AS vid FROM k WHERE kind = 'R'"))
def _(s, d):
    g = graph(s, d)
    return B.boundary_vertices(B.classify_edges(g.edges, g.vertices))


@query("b05_ghosts", sql("SELECT DISTINCT pdst AS part, src AS vid, 'in' AS direction FROM k WHERE kind = 'R' UNION ALL SELECT DISTINCT psrc, dst, 'out' FROM k WHERE kind = 'R'"))
def _(s, d):
    g = graph(s, d)
    k = B.classify_edges(g.edges, g.vertices)
    return B.ghosts(k, "in").withColumn("direction", F.lit("in")).unionByName(B.ghosts(k, "out").withColumn("direction", F.lit("out")))


@query("b06_ghost_slots", sql("SELECT g.part, g.vid, row_number() OVER (PARTITION BY g.part ORDER BY g.vid) - 1 + c.n AS slot FROM (SELECT DISTINCT pdst AS part, src AS vid FROM k WHERE kind = 'R') g JOIN (SELECT part, count(*) AS n FROM v GROUP BY part) c ON c.part = g.part"))
def _(s, d):
    g = graph(s, d)
    return B.ghost_slots(B.ghosts(B.classify_edges(g.edges, g.vertices)), g.vertices)


@query("b07_ghost_degrees", sql("SELECT g.part, g.vid, deg.deg FROM (SELECT DISTINCT pdst AS part, src AS vid FROM k WHERE kind = 'R') g JOIN deg ON deg.vid = g.vid"))
def _(s, d):
    g = graph(s, d)
    return B.ghosts(B.classify_edges(g.edges, g.vertices)).join(B.in_degree(g.vertices, g.edges), "vid").select("part", "vid", "deg")


@query("b08_in_degree", sql("SELECT vid, deg FROM deg"))
def _(s, d):
    g = graph(s, d)
    return B.in_degree(g.vertices, g.edges)


@query("b09_gcn_norm", sql("SELECT src, dst, count(*) AS n, round(min(w), 6) + 0.0 AS w FROM (SELECT src, dst, w FROM ne UNION ALL SELECT vid, vid, w FROM sn) GROUP BY src, dst"))
def _(s, d):
    e, own = normed(graph(s, d))
    both = e.unionByName(own.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.min("w")).alias("w"))


@query("b10_send_lists", sql("SELECT DISTINCT psrc AS part, pdst AS to_part, src AS vid, 'forward' AS direction FROM k WHERE kind = 'R' UNION ALL SELECT DISTINCT pdst, psrc, dst, 'backward' FROM k WHERE kind = 'R'"))
def _(s, d):
    g = graph(s, d)
    k = B.classify_edges(g.edges, g.vertices)
    return B.send_lists(k).withColumn("direction", F.lit("forward")).unionByName(B.send_lists(k, "backward").withColumn("direction", F.lit("backward")))


@query("b11_ghost_map", sql("SELECT src AS vid, array_to_string(list_sort(list(DISTINCT pdst)), ',') AS parts FROM k WHERE kind = 'R' GROUP BY src"))
def _(s, d):
    g = graph(s, d)
    return B.ghost_map(B.send_lists(B.classify_edges(g.edges, g.vertices))).select("vid", F.array_join("parts", ",").alias("parts"))


def _layout(deg: str) -> str:
    return sql(f"SELECT vid, CAST(coalesce(sum(deg) OVER (ORDER BY vid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", deg AS n FROM {deg}")


@query("b12_csc", _layout("deg"))
def _(s, d):
    g = graph(s, d)
    return B.csc(g.vertices, g.edges)


@query("b13_csr", _layout("odeg"))
def _(s, d):
    g = graph(s, d)
    return B.csr(g.vertices, g.edges)


@query("b14_membership", sql("SELECT v.vid, v.part, row_number() OVER (PARTITION BY part ORDER BY vid) - 1 AS lvid, EXISTS (SELECT 1 FROM k WHERE kind = 'R' AND k.src = v.vid AND k.pdst = 0) AS ghost_of_0 FROM v"))
def _(s, d):
    g = graph(s, d)
    far = B.ghosts(B.classify_edges(g.edges, g.vertices)).where("part = 0").select("vid", F.lit(True).alias("in0"))
    return B.local_ids(g.vertices).join(far, "vid", "left").select("vid", "part", "lvid", F.coalesce("in0", F.lit(False)).alias("ghost_of_0"))


@query("b15_endpoints", sql("WITH l AS (SELECT vid, part, row_number() OVER (PARTITION BY part ORDER BY vid) - 1 AS lvid FROM v) SELECT a.part AS psrc, a.lvid AS lsrc, b.part AS pdst, b.lvid AS ldst, count(*) AS n FROM e JOIN l a ON a.vid = e.src JOIN l b ON b.vid = e.dst GROUP BY ALL").replace(" WITH l AS", ", l AS", 1))
def _(s, d):
    g = graph(s, d)
    ids = B.local_ids(g.vertices)
    a = ids.select(F.col("vid").alias("src"), F.col("part").alias("psrc"), F.col("lvid").alias("lsrc"))
    b = ids.select(F.col("vid").alias("dst"), F.col("part").alias("pdst"), F.col("lvid").alias("ldst"))
    return g.edges.join(a, "src").join(b, "dst").groupBy("psrc", "lsrc", "pdst", "ldst").agg(F.count("*").alias("n"))


@query("b16_label_propagation")
def _(s, d):
    g = graph(s, d)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(scratch_path(s, "checkpoints"))
    return B.label_propagation(g.vertices, g.edges, PARTS)


@query("b17_edge_cut", sql("SELECT count(*) AS cut FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e) JOIN v s ON s.vid = a JOIN v d ON d.vid = b WHERE s.part <> d.part"))
def _(s, d):
    g = graph(s, d)
    return B.edge_cut(g.edges, g.vertices)


@query("b18_out_degree_norm", sql("SELECT q.src, q.dst, round(1 / sqrt(CAST(s.n + 1 AS DOUBLE) * (t.n + 1)), 6) + 0.0 AS w FROM (SELECT DISTINCT src, dst FROM e) q JOIN (SELECT src, count(DISTINCT dst) AS n FROM e GROUP BY src) s ON s.src = q.src JOIN (SELECT v.vid, count(DISTINCT e.dst) AS n FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid) t ON t.vid = q.dst"))
def _(s, d):
    g = graph(s, d)
    return B.normalize(g.vertices, g.edges, "out", dedup=True)[0].select("src", "dst", r6("w").alias("w"))


@query("b19_dense_variant", sql("SELECT q.src, q.dst, round(1 / sqrt(CAST(s.n + 1 AS DOUBLE) * (t.n + 1)), 6) + 0.0 AS w FROM (SELECT DISTINCT src, dst FROM e) q JOIN (SELECT v.vid, count(e0.dst) AS n FROM v LEFT JOIN e0 ON e0.dst = v.vid GROUP BY v.vid) s ON s.vid = q.src JOIN (SELECT v.vid, count(e0.dst) AS n FROM v LEFT JOIN e0 ON e0.dst = v.vid GROUP BY v.vid) t ON t.vid = q.dst"))
def _(s, d):
    return B.dense_variant(graph(s, d).vertices, raw_edges(s, d))[0].select("src", "dst", r6("w").alias("w"))


@query("b21_preprocess", sql("SELECT (SELECT count(*) FROM k WHERE kind = 'L') AS local_edges, (SELECT count(DISTINCT src) FROM k WHERE kind = 'R') AS boundary, (SELECT count(*) FROM (SELECT DISTINCT pdst, src FROM k WHERE kind = 'R')) AS in_ghosts, (SELECT count(*) FROM (SELECT DISTINCT psrc, dst FROM k WHERE kind = 'R')) AS out_ghosts"))
def _(s, d):
    g = graph(s, d)
    t = B.preprocess(g.vertices, g.edges)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(t["edges"].where("kind = 'L'"), "local_edges").join(one(t["boundary"], "boundary")).join(one(t["in_ghosts"], "in_ghosts")).join(one(t["out_ghosts"], "out_ghosts"))


# --- C: gather ---------------------------------------------------------------------------------------------------


@query("c01_gather_forward", sql(LONG.format("ah")))
def _(s, d):
    g = graph(s, d)
    e, own = normed(g)
    return entries(gather(e, g.features(), own, width=64))


@query("c02_gather_backward", sql("SELECT vid, CAST(i AS INTEGER) AS i, round(sum(val), 6) + 0.0 AS val FROM (SELECT ne.src AS vid, x.i, ne.w * x.val AS val FROM ne JOIN x ON x.vid = ne.dst UNION ALL SELECT x.vid, x.i, sn.w * x.val FROM sn JOIN x ON x.vid = sn.vid) GROUP BY vid, i"))
def _(s, d):
    g = graph(s, d)
    e, own = normed(g)
    return entries(gather(e, g.features(), own, backward=True, width=64))


@query("c03_gather_wide_form", sql(LONG.format("ah")))
def _(s, d):
    g = graph(s, d)
    e, own = normed(g)
    doubled = g.features().select("vid", F.concat("feat", "feat").alias("feat"))
    return entries(gather(e, doubled, own, width=128).select("vid", F.slice("feat", 1, 64).alias("feat")))


def _z(g: Graph) -> DataFrame:
    return D.matmul(g.features(), W0)


@query("c04_attention_gather", sql(LONG.format("gah")))
def _(s, d):
    g = graph(s, d)
    z = _z(g)
    return entries(attention_gather(Y.gat_scores(g.edges, z, A_VEC), z, 16))


@query("c05_attention_gather_backward", sql("SELECT vid, CAST(i AS INTEGER) AS i, round(sum(val), 6) + 0.0 AS val FROM (SELECT vid, i, val FROM zg UNION ALL SELECT sc.src, zg.i, sc.a * zg.val FROM sc JOIN zg ON zg.vid = sc.dst UNION ALL SELECT sc.dst, zg.i, sc.da * zg.val FROM sc JOIN zg ON zg.vid = sc.src) GROUP BY vid, i"))
def _(s, d):
    g = graph(s, d)
    z = _z(g)
    scored = Y.gat_scores(g.edges, z, A_VEC)
    return entries(attention_gather_backward(scored, z, scored.select("src", "dst", A.leaky_gradient(F.col("az")).alias("da")), z, 16))


@query("c07_edge_view_source", sql("SELECT e.src, e.dst, count(*) AS n, round(min(f.val), 6) + 0.0 AS val FROM e JOIN (SELECT vid, sum(val) AS val FROM x GROUP BY vid) f ON f.vid = e.src GROUP BY e.src, e.dst"))
def _(s, d):
    g = graph(s, d)
    return edge_rows(g.edges, g.features(), "src").groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.min(A.total("feat"))).alias("val"))


@query("c08_edge_view_destination", sql("SELECT e.src, e.dst, count(*) AS n, round(min(f.val), 6) + 0.0 AS val FROM e JOIN (SELECT vid, sum(val) AS val FROM x GROUP BY vid) f ON f.vid = e.dst GROUP BY e.src, e.dst"))
def _(s, d):
    g = graph(s, d)
    return edge_rows(g.edges, g.features(), "dst").groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.min(A.total("feat"))).alias("val"))


@query("c09_expand_dot", sql("SELECT src, dst, count(*) AS n, round(min(az), 6) + 0.0 AS score FROM sc GROUP BY src, dst"))
def _(s, d):
    g = graph(s, d)
    return expand_dot(g.edges, _z(g), list(A_VEC)).groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.min("score")).alias("score"))


@query("c10_expand_hadamard", sql("SELECT sc.src, CAST(zg.i AS INTEGER) AS i, round(sum(sc.a * zg.val), 6) + 0.0 AS val FROM sc JOIN zg ON zg.vid = sc.dst GROUP BY sc.src, zg.i"))
def _(s, d):
    g = graph(s, d)
    z = _z(g)
    rows = expand_hadamard(Y.gat_scores(g.edges, z, A_VEC), z, "a")
    return rows.select("src", F.posexplode("row").alias("i", "v")).groupBy("src", "i").agg(r6(F.sum("v")).alias("val"))


@query("c12_outer_product", sql("SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.val * b.val), 4) + 0.0 AS val FROM e JOIN zg a ON a.vid = e.src JOIN zg b ON b.vid = e.dst GROUP BY a.i, b.i"))
def _(s, d):
    g = graph(s, d)
    return outer_product_sum(g.edges, _z(g)).select("i", "j", (F.round("val", 4) + F.lit(0.0)).alias("val"))


@query("c13_column_sum", sql("SELECT CAST(i AS INTEGER) AS i, round(sum(val), 6) + 0.0 AS val FROM x GROUP BY i"))
def _(s, d):
    return column_sum(graph(s, d).features()).select("i", r6("val").alias("val"))


def _aggregate_query(how: str, fn: str) -> None:
    @query(f"c16_aggregate_{how}", sql(f"SELECT e.dst AS vid, CAST(x.i AS INTEGER) AS i, round({fn}(x.val), 6) + 0.0 AS val FROM e JOIN x ON x.vid = e.src GROUP BY e.dst, x.i"))
    def _(s, d):
        g = graph(s, d)
        return entries(gather(g.edges, g.features(), None, None, how, width=64))


for _how, _fn in (("add", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):
    _aggregate_query(_how, _fn)


def _convolution_query(norm: str, left: str, right: str) -> None:
    body = (
        f"SELECT v.vid, CAST(x.i AS INTEGER) AS i, round(coalesce(sum(y.val * {left}), 0) * {right}, 6) + 0.0 AS val FROM v JOIN x ON x.vid = v.vid "
        "LEFT JOIN e ON e.dst = v.vid LEFT JOIN x y ON y.vid = e.src AND y.i = x.i LEFT JOIN odeg ON odeg.vid = e.src JOIN deg ON deg.vid = v.vid GROUP BY v.vid, x.i, deg.deg"
    )

    @query(f"c18_convolution_{norm}", sql(body))
    def _(s, d):
        g = graph(s, d)
        return entries(graph_convolution(g.vertices, g.edges, g.features(), norm, 64))


_convolution_query("none", "1", "1")
_convolution_query("right", "1", "(1 / CAST(greatest(deg.deg, 1) AS DOUBLE))")
_convolution_query("both", "(1 / sqrt(CAST(greatest(odeg.deg, 1) AS DOUBLE)))", "(1 / sqrt(CAST(greatest(deg.deg, 1) AS DOUBLE)))")

# --- D, E: dense algebra and activations -------------------------------------------------------------------------


@query("d01_matmul", sql("SELECT vid, CAST(i AS INTEGER) AS i, round(2 * val, 6) + 0.0 AS val FROM zg"))
def _(s, d):
    return entries(D.matmul(graph(s, d).features(), W0, factor=2.0))


@query("d01_matmul_transposed", sql("SELECT zg.vid, CAST(w0.i AS INTEGER) AS i, round(sum(zg.val * w0.val), 6) + 0.0 AS val FROM zg JOIN w0 ON w0.j = zg.i GROUP BY zg.vid, w0.i"))
def _(s, d):
    return entries(D.matmul(_z(graph(s, d)), W0, transpose_w=True))


@query("d01_gram", sql("SELECT CAST(x.i AS INTEGER) AS i, CAST(zg.i AS INTEGER) AS j, round(sum(x.val * zg.val), 6) + 0.0 AS val FROM x JOIN zg ON zg.vid = x.vid GROUP BY x.i, zg.i"))
def _(s, d):
    f = graph(s, d).features()
    rows = f.join(D.matmul(f, W0).withColumnRenamed("feat", "z"), "vid")
    return D.gram(rows, "feat", "z").select("i", "j", r6("val").alias("val"))


@query("d01_gram_transposed", sql("SELECT CAST(x.i AS INTEGER) AS j, CAST(zg.i AS INTEGER) AS i, round(sum(x.val * zg.val), 6) + 0.0 AS val FROM x JOIN zg ON zg.vid = x.vid GROUP BY x.i, zg.i"))
def _(s, d):
    f = graph(s, d).features()
    rows = f.join(D.matmul(f, W0).withColumnRenamed("feat", "z"), "vid")
    return D.transpose(D.gram(rows, "feat", "z")).select("i", "j", r6("val").alias("val"))


_ROWWISE = {
    "d02_times_scalar": (lambda f: A.scale(f, 3.0), "val * 3"),
    "d02_over_scalar": (lambda f: A.divide(f, 4.0), "val / 4"),
    "d02_plus_scalar": (lambda f: A.shift(f, 1.5), "val + CAST(1.5 AS DOUBLE)"),
    "d02_minus_scalar": (lambda f: A.shift(f, -0.25), "val - CAST(0.25 AS DOUBLE)"),
    "d02_power": (lambda f: A.power(f, 2.0), "pow(val, 2)"),
    "d03_plus": (lambda f: A.add(f, A.scale(f, 2.0)), "val + 2 * val"),
    "d03_minus": (lambda f: A.subtract(f, A.scale(f, 3.0)), "val - 3 * val"),
    "d03_times": (lambda f: A.hadamard(f, A.shift(f, 1.0)), "val * (val + 1)"),
    "d03_over": (lambda f: A.quotient(f, A.shift(A.hadamard(f, f), 1.0)), "val / (val * val + 1)"),
    "e01_tanh": (A.tanh, "tanh(val)"),
    "e02_tanh_gradient": (A.tanh_gradient, "1 - tanh(val) * tanh(val)"),
    "e04_leaky_relu": (A.leaky_relu, "CASE WHEN val > 0 THEN val ELSE val * CAST(0.01 AS DOUBLE) END"),
    "e05_leaky_relu_gradient": (A.leaky_relu_gradient, "CASE WHEN val > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END"),
    "e07_relu": (A.relu, "greatest(val, 0)"),
    "e07_relu_gradient": (A.relu_gradient, "CASE WHEN val > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"),
    "e07_sigmoid": (A.sigmoid, "1 / (1 + exp(-val))"),
    "e07_sigmoid_gradient": (A.sigmoid_gradient, "exp(-val) / pow(1 + exp(-val), 2)"),
}


def _rowwise_query(name: str, fn, expression: str) -> None:
    @query(name, sql(f"SELECT vid, CAST(i AS INTEGER) AS i, round({expression}, 6) + 0.0 AS val FROM x"))
    def _(s, d):
        return entries(graph(s, d).vertices.select("vid", fn(F.col("feat")).alias("feat")))


for _name, (_f, _e) in _ROWWISE.items():
    _rowwise_query(_name, _f, _e)


@query("d05_checksums", sql("SELECT vid, round(sum(val), 6) + 0.0 AS total, round(sum(abs(val)), 6) + 0.0 AS abs_total FROM x GROUP BY vid"))
def _(s, d):
    return graph(s, d).vertices.select("vid", r6(A.total("feat")).alias("total"), r6(A.abs_sum("feat")).alias("abs_total"))


@query("d07_elements", sql("SELECT vid, round(max(val) FILTER (i = 3), 6) + 0.0 AS fourth, CAST(count(*) AS INTEGER) AS width FROM x GROUP BY vid"))
def _(s, d):
    return graph(s, d).vertices.select("vid", r6(F.get("feat", F.lit(3))).alias("fourth"), F.size("feat").alias("width"))


@query("e03_softmax_rows", sql("SELECT vid, CAST(i AS INTEGER) AS i, round(ex / (sum(ex) OVER (PARTITION BY vid) + 1e-20), 6) + 0.0 AS val FROM (SELECT vid, i, exp(val - max(val) OVER (PARTITION BY vid)) AS ex FROM x)"))
def _(s, d):
    return entries(graph(s, d).vertices.select("vid", A.softmax("feat").alias("feat")))


@query("e06_softmax_gradient", sql("SELECT vid, CAST(i AS INTEGER) AS i, round(p / (val * val + 1) - p, 6) + 0.0 AS val FROM (SELECT vid, i, val, ex / (sum(ex) OVER (PARTITION BY vid) + 1e-20) AS p FROM (SELECT vid, i, val, exp(val - max(val) OVER (PARTITION BY vid)) AS ex FROM x))"))
def _(s, d):
    rows = graph(s, d).vertices.select("vid", A.softmax("feat").alias("p"), A.shift(A.hadamard("feat", "feat"), 1.0).alias("q"))
    return entries(rows.select("vid", A.softmax_gradient("p", "q").alias("feat")))


@query("e09_argmax", sql("SELECT v.vid, CAST(min(x.i) FILTER (x.val = m.top) AS INTEGER) AS best, min(x.i) FILTER (x.val = m.top) = min(v.label) AS hit FROM v JOIN x ON x.vid = v.vid JOIN (SELECT vid, max(val) AS top FROM x GROUP BY vid) m ON m.vid = v.vid GROUP BY v.vid"))
def _(s, d):
    return graph(s, d).vertices.select("vid", A.argmax("feat").alias("best"), (A.argmax("feat") == F.col("label")).alias("hit"))


# --- F: model steps ----------------------------------------------------------------------------------------------


def _ah(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, own = normed(g)
    return e, own, gather(e, g.features(), own, width=64)


def _labels(g: Graph) -> DataFrame:
    split = G.split(G.chunk_positions(g.vertices.withColumn("part", F.lit(0))))
    return g.vertices.select("vid", "label").join(split.select("vid", "split"), "vid")


_SHARED: list[DataFrame] = []


def _shared(df: DataFrame) -> DataFrame:
    """Kept for a query that reads it in several places; let go when the next such query is described."""
    _SHARED.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def _release() -> None:
    while _SHARED:
        _SHARED.pop().unpersist()


def _output(g: Graph, n: int) -> DataFrame:
    """Rows of the last layer with the gathered features that its weights' gradient needs."""
    _release()
    e, own = normed(g)
    e, own = _shared(e), _shared(own)
    h = Y.gcn_hidden(gather(e, g.features(), own, width=64), W0).select("vid", F.col("h").alias("feat"))
    return Y.gcn_output(gather(e, h, own, width=16), _labels(g), W1, n)


def _narrow_output(g: Graph, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges, self weights, (vid, z) of the first layer and the last layer's rows; every product comes before its gather,
    so that 16 and 10 numbers cross an edge instead of 64 and 16."""
    _release()
    e, own = normed(g)
    e, own = _shared(e), _shared(own)
    z = _shared(gather(e, D.matmul(g.features(), W0), own, width=16).withColumnRenamed("feat", "z"))
    q = _shared(D.map_rows(z, lambda a: {"feat": np.tanh(a) @ W1}, ["z"], ["feat"], ["vid"]))
    return e, own, z, Y.gcn_output(gather(e, q, own, width=10), _labels(g), W1, n, multiplied=True)


@query("f01_gcn_hidden", sql(LONG.format("h0")))
def _(s, d):
    return entries(Y.gcn_hidden(_ah(graph(s, d))[2], W0), "h")


@query("f02_last_layer_fused", sql("SELECT 'p' AS name, vid, CAST(i AS INTEGER) AS i, round(val, 6) + 0.0 AS val FROM p1 UNION ALL SELECT 'grad', vid, CAST(i AS INTEGER), round(1000 * val, 6) + 0.0 FROM gr1"))
def _(s, d):
    out = _shared(_narrow_output(graph(s, d), n_vertices(s, d))[3])
    grad = out.select("vid", A.scale("grad", 1000.0).alias("grad"))
    return entries(out, "p").withColumn("name", F.lit("p")).unionByName(entries(grad, "grad").withColumn("name", F.lit("grad")))


@query("f02_last_layer_weights", sql("SELECT CAST(ah1.i AS INTEGER) AS i, CAST(d1.i AS INTEGER) AS j, round(sum(ah1.val * d1.val), 6) + 0.0 AS val FROM ah1 JOIN d1 ON d1.vid = ah1.vid GROUP BY ah1.i, d1.i"))
def _(s, d):
    out = _output(graph(s, d), n_vertices(s, d))
    return D.gram(out, "ah", "d").select("i", "j", r6("val").alias("val"))


@query("f03_hidden_backward", sql("SELECT CAST(ah.i AS INTEGER) AS i, CAST(g0.i AS INTEGER) AS j, round(sum(ah.val * g0.val), 6) + 0.0 AS val FROM ah JOIN g0 ON g0.vid = ah.vid GROUP BY ah.i, g0.i"))
def _(s, d):
    g = graph(s, d)
    e, own, z, out = _narrow_output(g, n_vertices(s, d))
    # a gather reads its rows twice, for the edges and for the vertex itself
    u = gather(e, _shared(out.select("vid", F.col("d").alias("feat"))), own, backward=True, width=10)
    atg = D.matmul(u, W1, transpose_w=True).withColumnRenamed("feat", "atg")
    rows = _shared(Y.gcn_hidden_backward(atg.join(z, "vid"), None).withColumnRenamed("g", "feat"))
    # (A X)' g = X' (A' g): the error goes over the edges instead of the features
    back = gather(e, rows, own, backward=True, width=16).withColumnRenamed("feat", "t")
    return D.gram(g.features().join(back, "vid"), "feat", "t").select("i", "j", r6("val").alias("val"))


@query("f04_gat_vertex_forward", sql(LONG.format("zg")))
def _(s, d):
    return entries(_z(graph(s, d)))


@query("f05_gat_edge_forward", sql("SELECT src, dst, count(*) AS n, round(min(az), 6) + 0.0 AS az, round(min(a), 6) + 0.0 AS a FROM sc GROUP BY src, dst"))
def _(s, d):
    g = graph(s, d)
    return Y.gat_scores(g.edges, _z(g), A_VEC).groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.min("az")).alias("az"), r6(F.min("a")).alias("a"))


def _gat(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    z = _z(g)
    scored, ah = Y.gat_forward(g.edges, z, A_VEC, 16)
    return z, scored, Y.gat_predict(ah, g.vertices.select("vid", "label"), 16)


@query("f06_gat_edge_backward", sql("SELECT src, dst, count(*) AS n, round(min(da), 6) + 0.0 AS da FROM gda GROUP BY src, dst"))
def _(s, d):
    g = graph(s, d)
    z, scored, out = _gat(g)
    return Y.gat_edge_backward(scored, out.select("vid", "feat"), A_VEC).groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.min("da")).alias("da"))


@query("f06_gat_attention_gradient", sql("WITH t AS (SELECT gg.i, sum(gg.val * sc.da) AS t FROM sc JOIN gg ON gg.vid = sc.dst GROUP BY gg.i), zz AS (SELECT a.i, b.i AS j, sum(a.val * b.val) AS v FROM zg a JOIN zg b ON b.vid = a.vid GROUP BY a.i, b.i) SELECT CAST(zz.i AS INTEGER) AS i, round(sum(zz.v * t.t), 4) + 0.0 AS val FROM zz JOIN t ON t.i = zz.j GROUP BY zz.i").replace(" WITH t AS", ", t AS", 1))
def _(s, d):
    g = graph(s, d)
    z, scored, out = _gat(g)
    da = Y.gat_attention_gradient(scored, out.select("vid", "feat"), z, 16)
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(da)], "i int, v double").select("i", (F.round("v", 4) + F.lit(0.0)).alias("val"))


@query("f07_gat_vertex_backward", sql("SELECT CAST(x.i AS INTEGER) AS i, CAST(gatg.i AS INTEGER) AS j, round(sum(x.val * gatg.val), 6) + 0.0 AS val FROM x JOIN gatg ON gatg.vid = x.vid GROUP BY x.i, gatg.i"))
def _(s, d):
    g = graph(s, d)
    _release()
    z = _shared(_z(g).withColumnRenamed("feat", "z"))
    edges = _shared(g.edges.select("src", "dst"))
    near = neighbour_sum(edges, z.select("vid", F.col("z").alias("feat")), 16, name="s")

    def predict(z, s, label):
        grad = Y._softmax(Y.gat_rows(z, s, A_VEC))
        grad[np.arange(len(grad)), label.astype(np.int64)] -= 1
        return {"grad": grad, "feat": Y.gat_push(z, grad, A_VEC)}

    out = _shared(D.map_rows(z.join(near, "vid").join(g.vertices.select("vid", "label"), "vid"), predict, ["z", "s", "label"], ["grad", "feat"], ["vid", "z", "s"]))
    back = neighbour_sum(edges, out.select("vid", "feat"), 16, backward=True, name="u")
    rows = out.drop("feat").join(back, "vid")
    atg = D.map_rows(rows, lambda z, s, grad, u: {"g": Y.gat_rows_backward(z, s, grad, u, A_VEC)}, ["z", "s", "grad", "u"], ["g"], ["vid"])
    return D.gram(g.features().join(atg, "vid"), "feat", "g").select("i", "j", r6("val").alias("val"))


@query("f08_gat_predict", sql(LONG.format("gg")))
def _(s, d):
    return entries(_gat(graph(s, d))[2])


@query("f09_train_mask", sql("SELECT p1.vid, CAST(p1.i AS INTEGER) AS i, round(CASE WHEN sp.split = 'train' THEN p1.val WHEN p1.i = sp.label THEN 1 ELSE 0 END, 6) + 0.0 AS val FROM p1 JOIN sp ON sp.vid = p1.vid"))
def _(s, d):
    out = _narrow_output(graph(s, d), n_vertices(s, d))[3].withColumn("y", A.one_hot(F.col("label"), 10))
    return entries(out.select("vid", G.masked_probabilities("p", "y", F.col("split") == "train").alias("feat")))


# --- G: evaluation -----------------------------------------------------------------------------------------------

_SPLIT_CHUNKED = (
    "SELECT vid, part, chunk, CASE WHEN at < floor(m * CAST(0.66 AS DOUBLE)) THEN 'train' WHEN at < floor(m * CAST(0.66 AS DOUBLE)) + floor(m * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split "
    "FROM (SELECT vid, part, CAST(pos // size AS INTEGER) AS chunk, pos % size AS at, least(size, n - (pos // size) * size) AS m FROM "
    "(SELECT vid, part, row_number() OVER (PARTITION BY part ORDER BY vid) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n, CAST(ceil(count(*) OVER (PARTITION BY part) / 3.0) AS BIGINT) AS size FROM v))"
).replace(" at <", " place <").replace("AS at,", "AS place,")


@query("g01_split_chunked", sql(_SPLIT_CHUNKED))
def _(s, d):
    return G.split(G.chunk_positions(graph(s, d).vertices, CHUNKS)).select("vid", "part", "chunk", "split")


@query("g02_validation", sql("SELECT count(*) AS n, round(avg(CASE WHEN b.best = sp.label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acc, round(avg(-ln(greatest(p1.val, 1e-38))), 6) + 0.0 AS loss FROM sp JOIN p1 ON p1.vid = sp.vid AND p1.i = sp.label JOIN (SELECT vid, min(i) FILTER (val = top) AS best FROM (SELECT vid, i, val, max(val) OVER (PARTITION BY vid) AS top FROM p1) GROUP BY vid) b ON b.vid = sp.vid WHERE sp.split = 'val'"))
def _(s, d):
    out = G.evaluation(G.score_rows(_narrow_output(graph(s, d), n_vertices(s, d))[3]))
    return out.select("n", r6("acc").alias("acc"), r6("loss").alias("loss"))


@query("g05_all_rows", sql("SELECT sp.split, count(*) AS n, round(avg(CASE WHEN b.best = sp.label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acc, round(avg(-ln(greatest(p1.val, 1e-38))), 6) + 0.0 AS loss FROM sp JOIN p1 ON p1.vid = sp.vid AND p1.i = sp.label JOIN (SELECT vid, min(i) FILTER (val = top) AS best FROM (SELECT vid, i, val, max(val) OVER (PARTITION BY vid) AS top FROM p1) GROUP BY vid) b ON b.vid = sp.vid GROUP BY sp.split"))
def _(s, d):
    out = G.evaluation(G.score_rows(_narrow_output(graph(s, d), n_vertices(s, d))[3]), None, ["split"])
    return out.select("split", "n", r6("acc").alias("acc"), r6("loss").alias("loss"))


@query("g11_losses", sql("SELECT v.vid, round(ln(t.total) - x.val, 6) + 0.0 AS ce, round(q.half, 6) + 0.0 AS mse FROM v JOIN (SELECT vid, sum(exp(val)) AS total FROM x GROUP BY vid) t ON t.vid = v.vid JOIN x ON x.vid = v.vid AND x.i = v.label JOIN (SELECT x.vid, sum((x.val - CASE WHEN x.i = v.label THEN 1 ELSE 0 END) * (x.val - CASE WHEN x.i = v.label THEN 1 ELSE 0 END)) / 2 AS half FROM x JOIN v ON v.vid = x.vid GROUP BY x.vid) q ON q.vid = v.vid"))
def _(s, d):
    rows = graph(s, d).vertices.select("vid", "label", F.col("feat").alias("x"), A.one_hot(F.col("label"), 64).alias("y"))
    diff = A.subtract("x", "y")
    return rows.select("vid", r6(A.log_softmax_loss("x", F.col("label"))).alias("ce"), r6(A.dot(diff, diff) / 2).alias("mse"))


@query("g12_one_hot", sql("SELECT vid, CAST(i AS INTEGER) AS i, CASE WHEN i = label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS val FROM (SELECT vid, label, unnest(range(10)) AS i FROM v)"))
def _(s, d):
    return entries(graph(s, d).vertices.select("vid", A.one_hot(F.col("label"), 10).alias("feat")))


_BLOCKS = "SELECT vid, CASE WHEN pos >= size * 60 THEN NULL WHEN pos % size < floor(size * CAST(0.66 AS DOUBLE)) THEN 'train' WHEN pos % size < floor(size * CAST(0.66 AS DOUBLE)) + floor(size * CAST(0.1 AS DOUBLE)) THEN 'val' WHEN pos % size < floor(size * CAST(0.66 AS DOUBLE)) + floor(size * CAST(0.1 AS DOUBLE)) + floor(size * CAST(0.24 AS DOUBLE)) THEN 'test' END AS split FROM (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS pos, count(*) OVER () // 60 AS size FROM v)"


@query("g14_block_masks", sql(_BLOCKS))
def _(s, d):
    return G.block_masks(graph(s, d).vertices)


@query("g15_ceil_split", sql("SELECT vid, CASE WHEN pos < ceil(n * CAST(0.66 AS DOUBLE)) THEN 'train' WHEN pos < ceil(n * CAST(0.66 AS DOUBLE)) + ceil(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS pos, count(*) OVER () AS n FROM v)"))
def _(s, d):
    return G.split(G.chunk_positions(graph(s, d).vertices.withColumn("part", F.lit(0))), "ceil").select("vid", "split")


# --- H, I: parameters and control --------------------------------------------------------------------------------


@query("h01_xavier", f"WITH RECURSIVE u AS (SELECT CAST(0 AS INTEGER) AS k, CAST(8888 AS BIGINT) * 16807 % 2147483647 AS x UNION ALL SELECT k + 1, x * 16807 % 2147483647 FROM u WHERE k < {16 * 10 - 1}) SELECT CAST(k // 10 AS INTEGER) AS i, CAST(k % 10 AS INTEGER) AS j, round((2 * ((x - 1) / CAST(2147483646 AS DOUBLE)) - 1) * sqrt(6 / CAST(26 AS DOUBLE)), 6) + 0.0 AS val FROM u")
def _(s, d):
    m = xavier(16, 10)
    return s.createDataFrame([(i, j, float(m[i, j])) for i in range(16) for j in range(10)], "i int, j int, v double").select("i", "j", r6("v").alias("val"))


@query("h02_kaiming")
def _(s, d):
    m = kaiming(64, 16)
    return s.createDataFrame([(i, j, float(m[i, j])) for i in range(64) for j in range(16)], "i int, j int, val double")


@query("h06_gradient_sum", sql("SELECT CAST(ah1.i AS INTEGER) AS i, CAST(d1.i AS INTEGER) AS j, round(sum(ah1.val * d1.val), 6) + 0.0 AS val FROM ah1 JOIN d1 ON d1.vid = ah1.vid GROUP BY ah1.i, d1.i"))
def _(s, d):
    # each partition's gradient is a part of the sum, as each chunk's would be
    g = graph(s, d)
    out = _shared(_output(g, n_vertices(s, d)).join(g.vertices.select("vid", "part"), "vid"))
    parts = [D.gram(out.where(F.col("part") == p), "ah", "d") for p in range(PARTS)]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("i", "j").agg(r6(F.sum("val")).alias("val"))


_ADAM = (
    "WITH RECURSIVE a AS (SELECT CAST(1 AS INTEGER) AS t, CAST(1 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v UNION ALL "
    "SELECT t + 1, w - CAST(0.01 AS DOUBLE) * sqrt(1 - pow(CAST(0.999 AS DOUBLE), t)) / (1 - pow(CAST(0.9 AS DOUBLE), t)) * (CAST(0.9 AS DOUBLE) * m + CAST(0.1 AS DOUBLE) * w) / (sqrt(CAST(0.999 AS DOUBLE) * v + CAST(0.001 AS DOUBLE) * w * w) + CAST(1e-7 AS DOUBLE)), "
    "CAST(0.9 AS DOUBLE) * m + CAST(0.1 AS DOUBLE) * w, CAST(0.999 AS DOUBLE) * v + CAST(0.001 AS DOUBLE) * w * w FROM a WHERE t <= 20) SELECT t, round(w, 6) + 0.0 AS w FROM a"
)


@query("h10_adam", _ADAM)
def _(s, d):
    opt, w, rows = Adam(0.01), np.array([1.0]), [(1, 1.0)]
    for t in range(2, 22):  # gradient of w^2 / 2
        w = opt.step("w", w, w)
        opt.end_step()
        rows.append((t, float(w[0])))
    return s.createDataFrame(rows, "t int, v double").select("t", r6("v").alias("w"))


@query("h16_sgd_momentum", "WITH RECURSIVE a AS (SELECT CAST(1 AS INTEGER) AS t, CAST(1 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS v UNION ALL SELECT t + 1, w - CAST(0.1 AS DOUBLE) * (CAST(0.5 AS DOUBLE) * v + w * CAST(1.01 AS DOUBLE)), CAST(0.5 AS DOUBLE) * v + w * CAST(1.01 AS DOUBLE) FROM a WHERE t <= 20) SELECT t, round(w, 6) + 0.0 AS w FROM a")
def _(s, d):
    opt, w, rows = SGD(0.1, momentum=0.5, decay=0.01), np.array([1.0]), [(1, 1.0)]
    for t in range(2, 22):
        w = opt.step("w", w, w)
        rows.append((t, float(w[0])))
    return s.createDataFrame(rows, "t int, v double").select("t", r6("v").alias("w"))


_STEP = "SELECT w1.i, w1.j, round({}, 6) + 0.0 AS val FROM w1 JOIN (SELECT ah1.i, d1.i AS j, sum(ah1.val * d1.val) AS g FROM ah1 JOIN d1 ON d1.vid = ah1.vid GROUP BY ah1.i, d1.i) t ON t.i = w1.i AND t.j = w1.j"


def _step_query(name: str, rule: str, make) -> None:
    """One step of an optimizer from the gradient over all training rows."""

    @query(name, sql(_STEP.format(rule)))
    def _(s, d):
        gradient = D.collect_matrix(D.gram(_output(graph(s, d), n_vertices(s, d)), "ah", "d"), W1.shape)
        m = make().step("w", W1, gradient)
        return s.createDataFrame([(i, j, float(m[i, j])) for i, j in np.ndindex(*m.shape)], "i int, j int, v double").select("i", "j", r6("v").alias("val"))


_ADAM_FIRST = "w1.val - CAST(0.01 AS DOUBLE) * sqrt(1 - CAST(0.999 AS DOUBLE)) / (1 - CAST(0.9 AS DOUBLE)) * (1 - CAST(0.9 AS DOUBLE)) * t.g / (sqrt((1 - CAST(0.999 AS DOUBLE)) * t.g * t.g) + CAST({} AS DOUBLE))"
for _name, _rule, _make in (
    ("h08_sgd_step", "w1.val - CAST(0.5 AS DOUBLE) * t.g", lambda: SGD(0.5)),
    ("h09_adam_step", _ADAM_FIRST.format("1e-7"), lambda: Adam(0.01)),
    ("h17_nesterov_step", "w1.val - CAST(0.5 AS DOUBLE) * (1 + CAST(0.9 AS DOUBLE)) * (t.g + CAST(0.01 AS DOUBLE) * w1.val)", lambda: SGD(0.5, momentum=0.9, decay=0.01, nesterov=True)),
    ("h17_adam_without_epsilon", _ADAM_FIRST.format("0"), lambda: Adam(0.01, epsilon=0.0)),
):
    _step_query(_name, _rule, _make)


@query("i01_chunks", sql("SELECT part, chunk, min(pos) AS low, max(pos) + 1 AS high FROM (SELECT part, pos, CAST(pos // CAST(ceil(n / 3.0) AS BIGINT) AS INTEGER) AS chunk FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vid) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n FROM v)) GROUP BY part, chunk"))
def _(s, d):
    p = G.chunk_positions(graph(s, d).vertices, CHUNKS)
    return p.groupBy("part", "chunk").agg(F.min("pos").alias("low"), (F.max("pos") + 1).alias("high"))


@query("i09_training_metrics")
def _(s, d):
    t = GcnTrainer(graph(s, d), Options(SIZES, epochs=2))
    run = t.fit()
    t.close()
    return run.frame(s)


@query("i09_attention_training_metrics")
def _(s, d):
    t = GatTrainer(graph(s, d), Options(SIZES, epochs=2))
    run = t.fit()
    t.close()
    return run.frame(s)


@query("i12_epoch_times", "SELECT avg(CASE WHEN epoch > 0 THEN ms END) AS sync_ms, sum(ms) / count(*) AS async_ms FROM (SELECT event_id // 100 AS epoch, CAST(count(*) AS DOUBLE) AS ms FROM events GROUP BY event_id // 100)")
def _(s, d):
    from ..operators.schedule import epoch_times

    m = read_table(s, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("epoch")).agg(F.count("*").cast("double").alias("ms"))
    return epoch_times(m)


# --- K: sampling -------------------------------------------------------------------------------------------------

_DRAW = "CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
_SAMPLE = f"SELECT src, dst, CAST(nth2 AS INTEGER) AS rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY {_DRAW.format(chr(39) + '0:' + chr(39) + ' || src || ' + chr(39) + ':' + chr(39) + ' || dst || ' + chr(39) + ':' + chr(39) + ' || nth')}, src, nth) AS nth2 FROM (SELECT src, dst, row_number() OVER (PARTITION BY src, dst) AS nth FROM e)) WHERE nth2 <= 5"


@query("k01_sample_neighbours", sql(_SAMPLE))
def _(s, d):
    return K.sample_neighbours(graph(s, d).edges, 5)


@query("k01_sample_with_replacement", sql(f"SELECT q.src, p.dst, CAST(p.t AS INTEGER) AS t FROM (SELECT dst, t, CAST(floor({_DRAW.format(chr(39) + '0:' + chr(39) + ' || dst || ' + chr(39) + ':' + chr(39) + ' || t')} * n) AS BIGINT) AS pos FROM (SELECT dst, count(*) AS n FROM e GROUP BY dst), (SELECT unnest(range(3)) AS t)) p JOIN (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS pos FROM e) q ON q.dst = p.dst AND q.pos = p.pos"))
def _(s, d):
    return K.sample_with_replacement(graph(s, d).edges, 3)


@query("k02_layerwise_inference", sql(LONG.format("sz")))
def _(s, d):
    return entries(sage.infer(graph(s, d), [W0, W1]))


@query("k12_embedding_export", sql(LONG.format("sz")))
def _(s, d):
    path = scratch_path(s, "embeddings")
    sage.export_embeddings(graph(s, d), [W0, W1], path)
    return entries(s.read.parquet(path))


@query("k13_sampled_training")
def _(s, d):
    t = sage.SageTrainer(graph(s, d), sage.SageOptions(SIZES, [5, 10], batch=400, dropout=0.1))
    run = t.fit()
    t.close()
    return run.frame(s)


@query("k03_sage_mean", sql("SELECT vid, CAST(i AS INTEGER) AS i, round(avg(val), 6) + 0.0 AS val FROM (SELECT e.dst AS vid, x.i, x.val FROM e JOIN x ON x.vid = e.src UNION ALL SELECT vid, i, val FROM x) GROUP BY vid, i"))
def _(s, d):
    g = graph(s, d)
    return entries(K.sage_layer(g.edges, g.features(), 64))


@query("k04_negative_edges", sql(f"SELECT c.src, c.dst, CAST(c.t AS INTEGER) AS t FROM (SELECT q.src, CAST(floor({_DRAW.format(chr(39) + '0:' + chr(39) + ' || q.src || ' + chr(39) + ':' + chr(39) + ' || q.dst || ' + chr(39) + ':0' + chr(39))} * nn.n) AS BIGINT) AS dst, 0 AS t FROM (SELECT DISTINCT src, dst FROM e) q, nn) c WHERE c.src <> c.dst AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.dst = c.dst)"))
def _(s, d):
    return K.negative_edges(graph(s, d).edges, n_vertices(s, d))


@query("k04_without_seed_edges", sql("SELECT src, dst, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM e t WHERE t.src < t.dst AND ((t.src = e.src AND t.dst = e.dst) OR (t.src = e.dst AND t.dst = e.src))) GROUP BY src, dst"))
def _(s, d):
    e = graph(s, d).edges
    return K.without_seed_edges(e, e.where("src < dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("k05_edge_scores", sql("SELECT src, dst, round(score, 6) + 0.0 AS score, round(greatest(score, 0) - score + ln(1 + exp(-abs(score))), 6) + 0.0 AS loss FROM (SELECT q.src, q.dst, sum(a.val * b.val) AS score FROM (SELECT DISTINCT src, dst FROM e) q JOIN x a ON a.vid = q.src JOIN x b ON b.vid = q.dst AND b.i = a.i GROUP BY q.src, q.dst)"))
def _(s, d):
    g = graph(s, d)
    scored = K.edge_scores(g.edges.distinct(), g.features())
    return scored.select("src", "dst", r6("score").alias("score"), r6(K.logit_loss(F.col("score"), F.lit(True))).alias("loss"))


@query("k06_standardized", sql("SELECT x.vid, CAST(x.i AS INTEGER) AS i, round((x.val - m) / sd, 6) + 0.0 AS val FROM x JOIN (SELECT i, avg(val) AS m, stddev_pop(val) AS sd FROM x GROUP BY i) t ON t.i = x.i"))
def _(s, d):
    return entries(K.standardized(graph(s, d).features(), 64))


@query("k06_linear_probe")
def _(s, d):
    g = graph(s, d)
    return K.linear_probe(g.features(), g.vertices.select("vid", "label"), _labels(g).where("split = 'train'"), 64)


@query("k09_ego_hops", sql("SELECT root, vid, CAST(min(hop) AS INTEGER) AS hop FROM (WITH t AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM (SELECT DISTINCT src, dst FROM e)) WHERE r <= 4) SELECT vid AS root, vid, 0 AS hop FROM v UNION ALL SELECT a.dst, a.src, 1 FROM t a UNION ALL SELECT a.dst, b.src, 2 FROM t a JOIN t b ON b.dst = a.src) GROUP BY root, vid"))
def _(s, d):
    g = graph(s, d)
    return K.ego_hops(g.edges, g.vertices, 2, 4)


@query("k14_fetch_rows", sql("SELECT v.vid, v.label, round(sum(x.val), 6) + 0.0 AS total FROM v JOIN x ON x.vid = v.vid WHERE v.vid IN (SELECT src FROM e) GROUP BY v.vid, v.label"))
def _(s, d):
    g = graph(s, d)
    want = g.edges.select(F.col("src").alias("vid")).distinct()
    return g.vertices.join(want, "vid", "left_semi").select("vid", "label", r6(A.total("feat")).alias("total"))


# --- L: logs and costs -------------------------------------------------------------------------------------------


def _log_lines(s, d) -> DataFrame:
    e = read_table(s, d, "events")
    ms = F.floor(F.abs("value") * 10).cast("long")
    return e.select(F.concat(F.lit("REPORT RequestId: "), F.col("event_id"), F.lit(" Billed Duration: "), F.coalesce(ms, F.lit(0)), F.lit(" ms Memory Size: 192 MB")).alias("line"))


@query("l01_function_cost", "SELECT CAST(sum(ms) AS BIGINT) AS total_ms, round(sum(ms) * (CAST(0.0000166667 AS DOUBLE) / (1024 / CAST(192 AS DOUBLE)) / 1000), 6) + 0.0 AS cost FROM (SELECT CAST(floor(coalesce(abs(value), 0) * 10) AS BIGINT) AS ms FROM events)")
def _(s, d):
    return L.function_cost(L.billed(_log_lines(s, d)), 192).select("total_ms", r6("cost").alias("cost"))


@query("l02_server_cost", "SELECT type, n, seconds, round(price * seconds * n / 3600, 6) + 0.0 AS cost FROM (VALUES ('c5.2xlarge', 2, CAST(1800 AS DOUBLE), CAST(0.34 AS DOUBLE)), ('c5.xlarge', 4, CAST(1800 AS DOUBLE), CAST(0.17 AS DOUBLE))) AS t(type, n, seconds, price)")
def _(s, d):
    return L.server_cost(s.createDataFrame([("c5.2xlarge", 2, 1800.0), ("c5.xlarge", 4, 1800.0)], "type string, n int, seconds double")).select("type", "n", "seconds", r6("cost").alias("cost"))


@query("l03_billed_summary", "SELECT count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM (SELECT CAST(floor(coalesce(abs(value), 0) * 10) AS BIGINT) AS ms FROM events) WHERE ms >= 100")
def _(s, d):
    return L.billed_summary(L.billed(_log_lines(s, d)), 100)


@query("l04_output_differences", "SELECT '# ' || (event_id // 100) AS section, count(*) AS n FROM events WHERE event_id % 7 = 0 AND event_id % 100 <> 0 GROUP BY event_id // 100")
def _(s, d):
    e = read_table(s, d, "events").select(F.col("event_id").alias("pos"))
    head = F.concat(F.lit("# "), F.floor(F.col("pos") / 100))
    a = e.select("pos", F.when(F.col("pos") % 100 == 0, head).otherwise(F.concat(F.lit("1 "), F.when(F.col("pos") % 7 == 0, "2.5").otherwise("2"))).alias("line"))
    b = e.select("pos", F.when(F.col("pos") % 100 == 0, head).otherwise(F.lit("1 2")).alias("line"))
    return L.output_differences(a, b)


@query("l05_stage_timers", "SELECT event_type AS name, count(*) AS n, round(sum(value), 4) + 0.0 AS total, round(avg(value), 4) + 0.0 AS avg, round(max(value), 4) + 0.0 AS max FROM events GROUP BY event_type")
def _(s, d):
    t = L.stage_timers(read_table(s, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("ms")))
    return t.select("name", "n", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("total", "avg", "max")))
