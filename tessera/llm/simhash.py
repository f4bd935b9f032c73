"""SimHash near-dedup with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import durable
from .components import connected_components

#: A-Z to a-z on bytes; other bytes of UTF-8 stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Children of an index node.
FAN = 8
#: Node pairs that are compared at once.
BLOCK = 1 << 16
#: Fingerprints of one upper node beyond which it is split by further masks before it is dealt out.
NODE_LIMIT = 100_000


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64 bits set in over half of the XXH64 of the text's word shingles; 0 without words."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp), fp the fingerprint as a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_order(group: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Order by group, inside it by the Gray rank of codes of one or more words, the first word the most significant."""
    ranks, odd = [], np.uint64(0)
    for word in codes.T:
        ranks.append(gray_rank(word) ^ (np.uint64(0) - odd))
        odd = ranks[-1] & np.uint64(1)  # whether the bits so far are odd in number: then the rest runs backwards
    return np.lexsort((*ranks[::-1], group))


def bits_in(x: np.ndarray) -> np.ndarray:
    """Number of set bits of codes of several words."""
    return np.bitwise_count(x).sum(axis=1, dtype=np.int16)


class GrayIndex:
    """Sorted fingerprints, of 64 bits or some words of them, under nodes that factor out what their members share.

    Every node has a mask of the bits on which all fingerprints below it agree, and their pattern there. Fingerprints
    are in Gray order inside their upper node (group), so neighbours differ in few bits and masks stay wide. Two nodes
    differ at least in the bits of both masks where the patterns differ: beyond the limit the pair of groups is pruned
    whole. They differ at most there and in the bits outside the masks: within the limit the pair is linked whole by
    one link, so dense groups of copies are never expanded into their pairs."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        wide = codes.reshape(len(codes), -1)
        order = gray_order(group, wide)
        self.order, self.codes, self.group = order, codes[order], group[order]
        wide = wide[order]
        self.bits = 64 * wide.shape[1]
        n = len(codes)
        self.parent = np.arange(n)
        # levels[0] are the fingerprints; each entry: mask, pattern, first child, end of children, first fingerprint
        starts = np.arange(n)
        self.levels = [(np.full(wide.shape, ~np.uint64(0)), wide, starts, starts + 1, starts)]
        roots = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if n else starts
        edge = roots
        while n and len(self.levels[-1][0]) > len(roots):
            mask, pattern, _, _, first = self.levels[-1]
            within = np.arange(len(mask)) - np.repeat(edge, np.diff(np.r_[edge, len(mask)]))
            cut = np.flatnonzero(within % FAN == 0)
            end = np.r_[cut[1:], len(mask)]
            both = np.bitwise_and.reduceat(mask, cut, axis=0)
            same = ~(np.bitwise_or.reduceat(pattern, cut, axis=0) ^ np.bitwise_and.reduceat(pattern, cut, axis=0))
            m = both & same
            self.levels.append((m, pattern[cut] & m, cut, end, first[cut]))
            edge = np.searchsorted(cut, edge)

    def find(self) -> np.ndarray:
        """Root of every fingerprint, pointers halved until they rest."""
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                return p
            p = self.parent = q

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.find()
            x, y = p[a], p[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(p, hi, lo)

    def link(self, limit: int) -> np.ndarray:
        """Root (place of its smallest member in index order) of every fingerprint after linking all pairs of one group
        within limit bits."""
        top = len(self.levels) - 1
        own = np.arange(len(self.levels[top][0]))
        stack = [(top, own[i : i + BLOCK], own[i : i + BLOCK]) for i in range(0, len(own), BLOCK)]
        while stack:
            level, a, b = stack.pop()
            mask, pattern, first_child, end_child, first = self.levels[level]
            if level:
                shared = mask[a] & mask[b]
                least = bits_in((pattern[a] ^ pattern[b]) & shared)
                keep = least <= limit
                a, b, shared, least = a[keep], b[keep], shared[keep], least[keep]
                whole = least + (self.bits - bits_in(shared)) <= limit
            else:
                whole = np.ones(len(a), dtype=bool)
                keep = bits_in(pattern[a] ^ pattern[b]) <= limit
                a, b, whole = a[keep], b[keep], whole[keep]
            if whole.any():
                # every two fingerprints below the two nodes are within the limit: all of them are one component
                both = np.r_[a[whole], b[whole]]
                if level:
                    nodes = np.unique(both)
                    last = np.r_[first[1:], len(self.codes)][nodes]
                    size = last - first[nodes]
                    head = np.repeat(first[nodes], size)
                    self.union(head, head + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)))
                self.union(first[a[whole]], first[b[whole]])
            a, b = a[~whole], b[~whole]
            if not level or not len(a):
                continue
            p = self.find()
            low, high = np.minimum.reduceat(p, first), np.maximum.reduceat(p, first)
            # both nodes lie in one and the same component already
            done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            a, b = a[~done], b[~done]
            na, nb = end_child[a] - first_child[a], end_child[b] - first_child[b]
            size = na * nb
            at = np.repeat(np.arange(len(a)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            ca, cb = first_child[a][at] + k // nb[at], first_child[b][at] + k % nb[at]
            if level == 1:
                right = ca < cb
            else:
                right = ca <= cb
            ca, cb = ca[right], cb[right]
            for i in range(0, len(ca), BLOCK):
                stack.append((level - 1, ca[i : i + BLOCK], cb[i : i + BLOCK]))
        return self.find()


def _links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["node"].to_numpy(zero_copy_only=False), b["fp"].to_numpy(zero_copy_only=False)) for b in batches]
        if parts:
            node, fp = (np.concatenate(x) for x in zip(*parts))
            index = GrayIndex(node, fp.view(np.uint64))
            root = index.link(limit)
            far = np.flatnonzero(root != np.arange(len(root)))
            codes = index.codes.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes[far]), pa.array(codes[root[far]])], ["a", "b"])

    return run


def near_links(prints: DataFrame, limit: int = 3, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect whatever pairs within limit bits connect.

    The upper nodes of the index are masks over limit + 1 blocks of bits: two fingerprints within limit bits agree on
    all of at least one block (pigeonhole), hence share the upper node of its pattern. Upper nodes are dealt out by
    hash; each task sorts those it gets by Gray rank, builds their lower nodes and links. An upper node of more than
    node_limit fingerprints is first split by limit + 1 masks over its remaining bits, by the same argument. Links are
    a forest: fewer than the fingerprints of the node, never its pairs."""
    blocks = limit + 1
    wide = 64 // blocks

    def pattern(x, shift: int, bits: int):
        return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1))

    node = F.array(*(F.xxhash64(F.lit(i), pattern(F.col("fp"), i * wide, wide if i < blocks - 1 else 64 - i * wide)) for i in range(blocks)))
    top = prints.select("fp", F.posexplode(node).alias("block", "node"))
    hot = durable(top.groupBy("node").count().where(F.col("count") > node_limit).select("node", F.lit(True).alias("hot")), "sim-hot")
    if not hot.isEmpty():
        marked = top.join(hot, "node", "left")
        rest = 64 - wide
        # the bits outside the block, moved together
        low = F.col("block") * wide
        below = F.col("fp").bitwiseAND(F.expr(f"~shiftleft(-1L, block * {wide})"))
        above = F.when(low + wide >= 64, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(shiftrightunsigned(fp, block * {wide} + {wide}), block * {wide})"))
        bits = below.bitwiseOR(above)
        part = rest // blocks
        split = F.array(*(F.xxhash64("node", F.lit(i), pattern(bits, i * part, part if i < blocks - 1 else rest - i * part)) for i in range(blocks)))
        top = marked.select("fp", F.explode(F.when(F.col("hot"), split).otherwise(F.array("node"))).alias("node"))
    dealt = top.select("node", "fp").repartition("node")
    return dealt.mapInArrow(_links(limit), "a long, b long").distinct()


def components(prints: DataFrame, limit: int = 3, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(doc_id, fp) rows -> (doc_id, fp, component_id): the smallest doc_id reachable over links of at most limit
    differing bits.

    Copies share a fingerprint and are counted once before anything is compared. Null ids can't be the smallest; if a
    component has no other, its component_id is null. Repeated rows stay. No rows give no rows."""
    prints = durable(prints.select("doc_id", "fp"), "sim-prints")
    codes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "sim-codes")
    labels = connected_components(near_links(codes.select("fp"), limit, node_limit))
    named = codes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = durable(named, "sim-named")
    least = durable(named.groupBy("component").agg(F.min("least").alias("component_id")), "sim-least")
    ids = durable(named.join(least, "component").select("fp", "component_id"), "sim-ids")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, limit: int = 3, width: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near copies; columns as before.

    Rows that repeat a doc_id stay or go together; rows without an id have no group and stay."""
    found = components(fingerprints(docs, width), limit)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(durable(gone, "sim-gone"), "doc_id", "left_anti").select(*docs.columns)
