"""Graph construction: degrees, normalization, partitions, ghosts and sparse layouts, as joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.prefix import positions, running_total


def drop_self_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; repeated edges stay repeated."""
    return edges.unionByName(reverse(edges))


def in_degree(vertices: DataFrame, edges: DataFrame, name: str = "deg") -> DataFrame:
    """(vid, deg) for every vertex, repeated edges counted, 0 for isolated ones."""
    counts = edges.groupBy(F.col("dst").alias("vid")).agg(F.count("*").alias(name))
    return vertices.select("vid").join(counts, "vid", "left").select("vid", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def out_degree(vertices: DataFrame, edges: DataFrame, name: str = "deg") -> DataFrame:
    return in_degree(vertices, reverse(edges.select("src", "dst")), name)


def self_norm(degrees: DataFrame) -> DataFrame:
    """(vid, w): 1 / (degree + 1)."""
    return degrees.select("vid", (1 / (F.col("deg") + 1)).alias("w"))


def edge_norm(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(src, dst, w): 1 / sqrt((degree(src) + 1) (degree(dst) + 1))."""
    s = degrees.select(F.col("vid").alias("src"), F.col("deg").alias("ds"))
    d = degrees.select(F.col("vid").alias("dst"), F.col("deg").alias("dd"))
    w = 1 / F.sqrt((F.col("ds") + 1).cast("double") * (F.col("dd") + 1))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", w.alias("w"))


def normalize(vertices: DataFrame, edges: DataFrame, norm: str = "in", dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edge weights (src, dst, w), self weights (vid, w)) of the symmetric normalization.

    norm: degrees count incoming ("in") or outgoing ("out") edges; dedup: repeated edges count once. Degrees are one
    grouped count; the edges meet them by two equi-joins."""
    e = edges.select("src", "dst")
    if dedup:
        e = e.distinct()
    degrees = in_degree(vertices, e) if norm == "in" else out_degree(vertices, e)
    return edge_norm(e, degrees), self_norm(degrees)


def dense_variant(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated edges collapse but degrees count them, self edges too: the variant of the dense checker."""
    degrees = in_degree(vertices, edges)
    return edge_norm(drop_self_edges(edges.select("src", "dst")).distinct(), degrees), self_norm(degrees)


# --- partitions --------------------------------------------------------------------------------------------------


def hash_partition(vid: Column, parts: int) -> Column:
    return F.pmod(F.hash(vid), F.lit(parts)).cast("int")


def local_ids(vertices: DataFrame) -> DataFrame:
    """(vid, part, lvid): lvid counts the vertices of a partition from 0 by id."""
    return positions(vertices.select("vid", "part"), "vid", "lvid", "part")


def with_parts(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    p = vertices.select("vid", "part")
    s = p.select(F.col("vid").alias("src"), F.col("part").alias("psrc"))
    d = p.select(F.col("vid").alias("dst"), F.col("part").alias("pdst"))
    return edges.join(s, "src").join(d, "dst")


def classify_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, psrc, pdst, kind): L if both ends are in one partition, else R."""
    return with_parts(edges, vertices).withColumn("kind", F.when(F.col("psrc") == F.col("pdst"), "L").otherwise("R"))


def boundary_vertices(classified: DataFrame) -> DataFrame:
    """(vid): sources of edges that leave their partition."""
    return classified.where("kind = 'R'").select(F.col("src").alias("vid")).distinct()


def ghosts(classified: DataFrame, direction: str = "in") -> DataFrame:
    """(part, vid): vertices of other partitions that edges of this one come from (in) or go to (out)."""
    far = classified.where("kind = 'R'")
    pick = (F.col("pdst").alias("part"), F.col("src").alias("vid")) if direction == "in" else (F.col("psrc").alias("part"), F.col("dst").alias("vid"))
    return far.select(*pick).distinct()


def ghost_slots(ghost: DataFrame, vertices: DataFrame) -> DataFrame:
    """(part, vid, slot): ghosts are numbered behind the partition's own vertices, by id."""
    own = vertices.groupBy("part").agg(F.count("*").alias("n"))
    numbered = positions(ghost, "vid", "nth", "part")
    return numbered.join(F.broadcast(own), "part").select("part", "vid", (F.col("n") + F.col("nth")).cast("long").alias("slot"))  # one row a partition


def send_lists(classified: DataFrame, direction: str = "forward") -> DataFrame:
    """(part, to_part, vid): whom each partition sends a vertex's rows to, forward along out-edges or backward."""
    far = classified.where("kind = 'R'")
    if direction == "forward":
        return far.select(F.col("psrc").alias("part"), F.col("pdst").alias("to_part"), F.col("src").alias("vid")).distinct()
    return far.select(F.col("pdst").alias("part"), F.col("psrc").alias("to_part"), F.col("dst").alias("vid")).distinct()


def ghost_map(sends: DataFrame) -> DataFrame:
    """(vid, parts): the partitions that get a vertex, sorted; never more than there are partitions."""
    return sends.groupBy("vid").agg(F.sort_array(F.collect_set("to_part")).alias("parts"))


def edge_cut(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row (cut): distinct undirected edges whose ends are in two partitions."""
    once = drop_self_edges(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))).distinct()
    return with_parts(once, vertices).agg(F.count(F.when(F.col("psrc") != F.col("pdst"), 1)).alias("cut"))


def label_propagation(vertices: DataFrame, edges: DataFrame, parts: int, rounds: int = 5, slack: float = 1.1, salt: int = 0) -> DataFrame:
    """(vid, part): a balanced partition that cuts fewer edges than a hash.

    Each round a vertex prefers the part of most of its neighbours; a part admits as many movers, those with the largest
    gain first, as it has room for. Votes are grouped sums; what is admitted is cut by a histogram of gains (integers),
    so no part is sorted whole. Each round is checkpointed to the shared folder."""
    n = vertices.count()
    room = int(n / parts * slack) + 1
    both = symmetrize(drop_self_edges(edges.select("src", "dst"))).distinct()
    now = vertices.select("vid", hash_partition(F.col("vid") + salt, parts).alias("part"))
    for _ in range(rounds):
        votes = both.join(now.select(F.col("vid").alias("src"), "part"), "src").groupBy(F.col("dst").alias("vid"), "part").agg(F.count("*").alias("k"))
        best = votes.groupBy("vid").agg(F.max(F.struct("k", (-F.col("part")).alias("p"))).alias("m"))
        own = votes.join(now, ["vid", "part"]).select("vid", F.col("k").alias("own"))
        want = (
            best.join(now, "vid").join(own, "vid", "left")
            .select("vid", "part", (-F.col("m.p")).alias("to"), (F.col("m.k") - F.coalesce("own", F.lit(0))).alias("gain")).where("gain > 0")
        )
        sizes = {r["part"]: r["count"] for r in now.groupBy("part").count().collect()}  # one row a part
        levels = want.groupBy("to", "gain").count().orderBy("to", F.desc("gain")).collect()  # one row a part and gain
        least: dict[int, int] = {}
        free = {p: room - sizes.get(p, 0) for p in range(parts)}
        for r in levels:
            if free[r["to"]] >= r["count"] and least.get(r["to"], 1 << 60) > r["gain"] and not least.get(-1 - r["to"]):
                free[r["to"]] -= r["count"]
                least[r["to"]] = r["gain"]
            else:
                least[-1 - r["to"]] = 1
        admit = {p: g for p, g in least.items() if p >= 0}
        if not admit:
            break
        floor = F.element_at(F.create_map(*(F.lit(x) for kv in admit.items() for x in kv)), F.col("to"))
        moved = want.where(F.col("gain") >= floor).select("vid", F.col("to").alias("new"))
        now = now.join(moved, "vid", "left").select("vid", F.coalesce("new", "part").cast("int").alias("part")).checkpoint()
    return now


# --- sparse layouts ----------------------------------------------------------------------------------------------


def csc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, offset, n): where the incoming edges of each vertex start when edges lie ordered by destination."""
    return running_total(in_degree(vertices, edges, "n"), "vid", "n", "offset").select("vid", "offset", "n")


def csr(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return csc(vertices, reverse(edges.select("src", "dst")))


def csc_rows(edges: DataFrame) -> DataFrame:
    """(vid, rows): distinct sources of each destination, sorted; a list is one column of the exported matrix."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("vid")).agg(F.sort_array(F.collect_list("src")).alias("rows"))


def cluster(edges: DataFrame, by: str = "dst", partitions: int | None = None) -> DataFrame:
    """Edges laid out for repeated gathers: hash-partitioned and sorted by one end."""
    dealt = edges.repartition(partitions, by) if partitions else edges.repartition(by)
    return dealt.sortWithinPartitions(by)


def preprocess(vertices: DataFrame, edges: DataFrame, undirected: bool = False, norm: str = "in", dedup: bool = False) -> dict[str, DataFrame]:
    """All that a run needs from vertices (vid, part, ..) and edges: the same degrees serve every partition."""
    e = drop_self_edges(edges.select("src", "dst"))
    if undirected:
        e = symmetrize(e)
    kinds = classify_edges(e, vertices)
    norm_edges, self_weights = normalize(vertices, e, norm, dedup)
    return {
        "local_ids": local_ids(vertices), "edges": kinds, "boundary": boundary_vertices(kinds),
        "in_ghosts": ghost_slots(ghosts(kinds, "in"), vertices), "out_ghosts": ghost_slots(ghosts(kinds, "out"), vertices),
        "forward_sends": send_lists(kinds, "forward"), "backward_sends": send_lists(kinds, "backward"),
        "norm_edges": norm_edges, "self_norm": self_weights, "csc": csc(vertices, e), "csr": csr(vertices, e),
    }
