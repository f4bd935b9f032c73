"""SimHash near-dedup with an exact check: near copies by the Jaccard similarity of word shingles.

At a similarity of 0.8 fingerprints differ in about 15 of 100 bits, too many for the 64 of simhash.fingerprint(): shared
blocks of bits would be a few bits wide. Here fingerprints have 256 bits, the upper nodes of the Gray-order index are
patterns under so many random masks that two alike sets share a node almost surely, and each node prunes by accumulated
differences. What its links connect is a cluster of candidates, inside which sets are compared exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import windows as W
from .common import discard, durable
from .components import connected_components
from .simhash import LOWER, GrayIndex, bits_in

#: Words of a shingle and the similarity from which two documents are near copies.
WIDTH, SHARE = 5, 0.8
#: 64-bit words of a fingerprint.
WORDS = 4
#: Share of the bits in which sets of similarity 0.8 differ, and the bits of 256 beyond which a pair is no candidate: eight in
#: standard deviations of 5.7 bits above the mean of 39, and seven below that of unrelated sets.
DIFFER, LIMIT = 0.151, 78
#: Fingerprints that share an upper node by chance, and the expected nodes of a pair: it misses all with e**-EXPECT.
NODE, EXPECT = 128, 6
#: Fingerprints of one upper node beyond which further masks split it.
NODE_LIMIT = 100_000
#: Sets, and shingles in them, of a block; a task compares two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
#: Rows of the index that a task takes together, but for a node that is larger.
TOGETHER = 1 << 18

_SALT = W.mix(np.arange(1, WORDS + 1, dtype=W.U64) * W.U64(W.BASE))
FP = [f"f{i}" for i in range(WORDS)]
FP_TYPES = ", ".join(f"{f} long" for f in FP)


def shingles(text: bytes | None, known: W.WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text's lower-cased words; a shorter text is one shingle."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=W.U64)
    return np.unique(W.mix(W.grams(known.of(words)[0], min(width, len(words)), W.BASE_A)))


def key(members: np.ndarray) -> int:
    """One number for a set, as a signed long."""
    return int(W.mix(np.add.reduce(W.mix(members + W.U64(1)), keepdims=True)).view(np.int64)[0])


def fingerprint(members: np.ndarray) -> np.ndarray:
    """Bits that over half of the shingles have, under one hash for each word of the fingerprint."""
    out = np.zeros(WORDS, dtype=W.U64)
    for i, salt in enumerate(_SALT):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(members), 1 << 16):
            part = W.mix(members[at : at + (1 << 16)] ^ salt)
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * counts > len(members), bitorder="little").view("<u8")[0]
    return out


def masks(n: int, seed: int = 1, node: int = NODE) -> np.ndarray:
    """Random masks for n fingerprints: of so many bits that about `node` share a pattern, and so many of them that a pair
    which differs in DIFFER of its bits agrees under EXPECT masks on average. One empty mask if all fit in a node."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / node))))
    many = int(np.ceil(EXPECT / (1 - DIFFER) ** bits)) if bits else 1
    rng = np.random.default_rng(seed)
    out = np.zeros((many, 64 * WORDS), dtype=np.uint8)
    for row in out:
        row[rng.choice(64 * WORDS, bits, replace=False)] = 1
    return np.packbits(out, axis=1, bitorder="little").view("<u8").astype(W.U64)


def nodes(codes: np.ndarray, table: np.ndarray, salt: np.ndarray) -> Iterator[np.ndarray]:
    """For each mask the upper node of every code, a hash of its pattern, the mask and the salt."""
    for i, mask in enumerate(table):
        h = W.mix(salt + W.U64(i + 1))
        for j in range(WORDS):
            h = W.mix(h ^ (codes[:, j] & mask[j]))
        yield h.view(np.int64)


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[f].to_numpy(zero_copy_only=False) for f in FP], axis=1).view(W.U64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id, key of the set, its size and fingerprint."""
    known = W.WordHashes()
    for batch in batches:
        sets = (shingles(t.as_py(), known) for t in batch["text"].cast(pa.binary()))
        rows = [(key(m), len(m), *fingerprint(m).view(np.int64).tolist()) for m in sets]
        if rows:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in zip(*rows))], ["doc_id", "code", "size", *FP])


def _deal(table: np.ndarray):
    """(code, fingerprint, node, hot) -> the row under each of its nodes; rows that are not hot stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch["hot"].to_numpy(zero_copy_only=False).astype(bool)
            rest = batch.filter(pa.array(~hot))
            yield pa.RecordBatch.from_arrays([rest[c] for c in ("node", "code", *FP)], ["node", "code", *FP])
            batch = batch.filter(pa.array(hot))
            for h in nodes(_codes(batch), table, batch["node"].to_numpy(zero_copy_only=False).view(W.U64)) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(h), *(batch[c] for c in ("code", *FP))], ["node", "code", *FP])

    return run


def _together(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[pa.Table]:
    """Batches sorted by a column -> tables of at least `size` rows that no value of the column spans."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            table = pa.Table.from_batches(held)
            values = table[name].to_numpy()
            cut = int(np.searchsorted(values, values[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                n -= cut
    if held:
        yield pa.Table.from_batches(held)


def _links(limit: int):
    """(node, code, fingerprint) by node -> (a, b, far): of whatever is connected in a node, each code beside the hub, the
    code nearest to the majority of bits of all, and the bits between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, "node", TOGETHER):
            index = GrayIndex(table["node"].to_numpy(), _codes(table))
            code = table["code"].to_numpy()[index.order]
            root = index.link(limit)
            own = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
            if not len(own):
                continue
            own = own[np.argsort(root[own], kind="stable")]
            codes = index.codes[own]
            head = np.flatnonzero(np.r_[True, root[own][1:] != root[own][:-1]])
            size = np.diff(np.r_[head, len(own)])
            middle = np.zeros((len(head), WORDS), dtype=W.U64)
            for bit in range(64 * WORDS):
                ones = np.add.reduceat(((codes[:, bit // 64] >> W.U64(bit % 64)) & W.U64(1)).astype(np.int64), head)
                middle[:, bit // 64] |= (2 * ones > size).astype(W.U64) << W.U64(bit % 64)
            group = np.repeat(np.arange(len(head)), size)
            order = np.lexsort((code[own], bits_in(codes ^ middle[group]), group))
            hub = order[np.searchsorted(group[order], np.arange(len(head)))][group]
            rest = np.flatnonzero(hub != np.arange(len(own)))
            far = bits_in(codes[rest] ^ codes[hub[rest]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code[own][rest]), pa.array(code[own][hub[rest]]), pa.array(far)], ["a", "b", "far"])

    return run


def candidates(codes: DataFrame, limit: int = LIMIT, node: int = NODE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(code, fingerprint) of distinct sets -> (a, b, far): links that connect the candidates, each code beside the hubs of
    its nodes. Upper nodes of more than node_limit codes are split once more by masks of their own."""
    first = masks(codes.count(), 1, node)
    rows = "node long, code long, " + FP_TYPES
    start = codes.select(F.lit(0).cast("long").alias("node"), "code", *FP, F.lit(True).alias("hot"))
    dealt = start.mapInArrow(_deal(first), rows)
    hot = durable(dealt.groupBy("node").count().where(F.col("count") > node_limit).select("node", F.lit(True).alias("hot")), "near-hot")
    if not hot.isEmpty():
        marked = dealt.join(hot, "node", "left").select("node", "code", *FP, F.coalesce("hot", F.lit(False)).alias("hot"))
        dealt = marked.mapInArrow(_deal(masks(NODE << 8, 2)), rows)
    return dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_links(limit), "a long, b long, far long")


def _alike(share: float):
    """(a, b, x, y) -> the pairs whose sets x and y are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = (np.frombuffer(s.as_buffer(), dtype=W.U64) for s in (x, y))
                both = 0
                if len(x) and min(len(x), len(y)) >= share * max(len(x), len(y)) - 1e-9:
                    both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
                keep.append(both >= share * (len(x) + len(y) - both) - 1e-9)
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out["a"], out["b"]], ["a", "b"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The set of every code of wanted (code, doc_id), from the one document named there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHashes()
        for batch in batches:
            sets = [shingles(text.as_py(), known) for text in batch["text"].cast(pa.binary())]
            out = [pa.array([key(m) for m in sets], pa.int64()), pa.array([m.tobytes() for m in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["code", "members"])

    read = docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(run, "code long, members binary")
    # an id that repeats with other texts brings sets that nobody asked for
    return durable(read.join(wanted.select("code"), "code", "left_semi").dropDuplicates(["code"]), "near-sets")


def linked(sets: list[np.ndarray], label: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Sets and what each is known to belong to -> (places, smallest place connected) of links between alike sets. Only
    shingles of two sets and more count; their numbers in common are products of small blocks of a 0/1 matrix."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    row = np.repeat(np.arange(n), size.astype(np.int64))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column, row = (np.cumsum(often) - 1)[column[often[column]]], row[often[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        block = np.zeros((n, 4096), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        both += block @ block.T
    alike = both >= share * (size[:, None] + size[None, :] - both) - 1e-6
    _, known = np.unique(label, return_inverse=True)
    alike |= known[:, None] == known[None, :]
    root = np.arange(n)
    while True:
        least = np.where(alike, root[None, :], n).min(axis=1)
        if np.array_equal(least, root):
            break
        root = least
    far = np.flatnonzero(root != np.arange(n))
    return far, root[far]


def _cells(share: float):
    """(cell, code, label, members) by cell -> links (a, b) between codes that are alike, or known to belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, "cell", 1):
            cell = table["cell"].to_numpy()
            code, label = table["code"].to_numpy(), table["label"].to_numpy()
            members = table["members"].combine_chunks()
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                a, b = linked([np.frombuffer(members[i].as_buffer(), dtype=W.U64) for i in range(lo, hi)], label[lo:hi], share)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(code[lo:hi][a]), pa.array(code[lo:hi][b])], ["a", "b"])

    return run


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster, label, code, size) -> codes with their block (of, nth), and the cells of every block: every two blocks of a
    cluster, but not two of one label. A label that fills more than a block has blocks of its own, the others share some."""
    count = lambda n, s: F.ceil(F.greatest(F.sum(n) / BLOCK_SETS, F.sum(s) / BLOCK_SHINGLES)).cast("long")
    labels = durable(members.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "near-labels")
    own = labels.groupBy("cluster", "label").agg(count("n", "s").alias("own"))
    few = labels.where((F.col("n") <= BLOCK_SETS) & (F.col("s") <= BLOCK_SHINGLES))
    shared = few.groupBy("cluster").agg(count("n", "s").alias("shared"))
    big = F.col("own") > 1
    spread = F.when(big, F.pmod(F.xxhash64("code"), "own")).otherwise(F.pmod(F.xxhash64("label"), F.greatest("shared", F.lit(1))))
    of = F.when(big, F.col("label").cast("string")).otherwise("")
    placed = members.join(own, ["cluster", "label"]).join(shared, "cluster", "left")
    placed = durable(placed.select("cluster", "label", "code", of.alias("of"), spread.alias("nth")), "near-blocks")
    blocks = durable(placed.select("cluster", "of", "nth").distinct(), "near-cells")
    other = blocks.select("cluster", F.col("of").alias("of2"), F.col("nth").alias("nth2"))
    pairs = blocks.join(other, "cluster").join(blocks.groupBy("cluster").agg(F.count("*").alias("k")), "cluster")
    # two blocks are compared with what either has inside, so a block by itself is a cell only without a partner
    pairs = pairs.where("(of < of2 OR (of = of2 AND (nth < nth2 OR (nth = nth2 AND k = 1)))) AND (of = '' OR of2 = '' OR of <> of2)")
    cell = F.xxhash64("cluster", "of", "nth", "of2", "nth2").alias("cell")
    ends = F.array_distinct(F.array(F.struct("of", "nth"), F.struct(F.col("of2").alias("of"), F.col("nth2").alias("nth"))))
    return placed, pairs.select("cluster", F.explode(ends).alias("e"), cell).select("cluster", "e.of", "e.nth", "cell")


def components(docs: DataFrame, share: float = SHARE, limit: int = LIMIT, node: int = NODE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, component_id): the smallest doc_id reachable over pairs of documents whose
    shingle sets have a Jaccard similarity of share (0.8 or more) or above. Rows without an id are left out.

    Documents with equal sets are one. Candidates come from the index; each is first compared with its nearest hub, so a
    group of copies of one original is settled by as many comparisons as it has texts. Only clusters that are still in several
    parts are compared in blocks: rows grow with the cluster's size times its blocks, never with its pairs. A pair at the
    bound is missed if it agrees under no mask, e**-EXPECT on average; whatever is linked is exact."""
    docs = docs.where("doc_id IS NOT NULL")
    prints = durable(docs.select("doc_id", "text").mapInArrow(_prints, f"doc_id long, code long, size long, {FP_TYPES}"), "near-prints")
    codes = prints.groupBy("code").agg(F.min("doc_id").alias("doc_id"), *(F.min(c).alias(c) for c in ("size", *FP)))
    codes = durable(codes, "near-codes")
    found = candidates(codes, limit, node, node_limit).groupBy("a", "b").agg(F.min("far").alias("far"))
    found = durable(found, "near-found")
    clusters = connected_components(found).select(F.col("id").alias("code"), F.col("component").alias("cluster"))
    stars = found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    wanted = clusters.join(codes.select("code", "doc_id"), "code")
    sets = _sets(docs, durable(wanted.select("code", "doc_id"), "near-wanted"))
    both = stars.join(sets.select(F.col("code").alias("a"), F.col("members").alias("x")), "a")
    both = both.join(sets.select(F.col("code").alias("b"), F.col("members").alias("y")), "b")
    near = durable(both.select("a", "b", "x", "y").mapInArrow(_alike(share), "a long, b long"), "near-links")
    labels = connected_components(near).select(F.col("id").alias("code"), F.col("component").alias("label"))
    parts = clusters.join(labels, "code", "left").withColumn("label", F.coalesce("label", "code"))
    open_ = parts.groupBy("cluster").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("cluster")
    parts = durable(parts.join(open_, "cluster", "left_semi").join(codes.select("code", "size"), "code"), "near-parts")
    placed, cells = _blocks(parts)
    dealt = placed.join(cells, ["cluster", "of", "nth"]).join(sets, "code").select("cell", "code", "label", "members")
    more = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(share), "a long, b long")
    final = connected_components(near.unionByName(durable(more, "near-more")))
    named = codes.select("code", "doc_id").join(final.withColumnRenamed("id", "code"), "code", "left")
    named = durable(named.withColumn("component", F.coalesce("component", "code")), "near-named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = durable(named.join(least, "component").select("code", "component_id"), "near-ids")
    discard(found, sets)
    return prints.join(ids, "code").select("doc_id", "component_id")


def representatives(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near copies; columns as before.

    Rows that repeat a doc_id stay or go together; rows without an id have no group and stay."""
    gone = components(docs, share).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(durable(gone, "near-gone"), "doc_id", "left_anti").select(*docs.columns)
