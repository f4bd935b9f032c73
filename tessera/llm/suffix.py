"""Suffix-array dedup of byte strings: induced sorting of shards, then permuted common prefixes.

Equal strings of LENGTH bytes hold an equal content-defined anchor at the same place, so whatever repeats meets in the
shard of its anchor. A shard is the text around anchors that occur more than once; its suffix array is induced, and
neighbours in it whose permuted common prefix reaches LENGTH are the repeats."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from . import windows as W
from .common import discard, durable

LENGTH, ANCHOR = 100, 32
#: Bytes of context that a task compares among themselves before they are dealt out, and that one suffix array holds.
LOCAL, SHARD = 32 << 20, 6 << 20
#: Occurrences of an anchor beyond which its windows are dealt out one by one, each a context of its own.
HOT = 50_000
#: Suffixes of a bucket, on average, from which induction takes stretches of a bucket at a time, else blocks of buckets.
PER_BUCKET = 200
#: Suffixes that a block of buckets has at least.
BLOCK = 1 << 14
WHOLE = 0xFFFFFFFF

_RANDOM = W.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(W.BASE))


# --- induced sorting ---------------------------------------------------------------------------------------------


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S), False for larger ones (L); the last, a sentinel, is S."""
    n = len(s)
    less, equal = s[:-1] < s[1:], s[:-1] == s[1:]
    turn = np.where(equal, n, np.arange(n - 1))
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    return np.append(less[turn], True)


def _induce_blocks(s: np.ndarray, small: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """As _induce(), a block of neighbouring buckets at a time: for many small buckets.

    A suffix's place follows from its bucket and the place of the suffix after it, which an earlier block has settled,
    or else the block itself: then its places are induced once more, until none of them moves."""
    n, end = len(s), np.cumsum(count)
    n_small = np.bincount(s[small], minlength=len(count))
    own = s[lms]
    n_own = np.bincount(own, minlength=len(count))
    first = np.cumsum(n_own) - n_own
    at = np.full(n + 1, -1, dtype=np.int64)
    at[lms] = end[own] - n_own[own] + np.arange(len(lms)) - first[own]
    sa = np.empty(n, dtype=np.int32)

    def place(members: np.ndarray, low: np.ndarray, size: np.ndarray, backwards: bool) -> None:
        """Suffixes of one type into their parts of the buckets, which begin at low."""
        if not len(members):
            return
        members = members[np.argsort(s[members], kind="stable")]
        done = np.cumsum(size)
        slots = np.arange(len(members)) + np.repeat(low - (done - size), size)
        cuts = np.unique(np.append(done[np.searchsorted(done, np.arange(BLOCK, len(members), BLOCK))], len(members)))
        blocks = list(zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist()))
        for lo, hi in reversed(blocks) if backwards else blocks:
            x, to = members[lo:hi], slots[lo:hi]
            bucket = s[x].astype(np.int64) * (n + 1)
            at[x] = to
            after = s[x + 1]
            inner = (small[x + 1] == backwards) & (after >= s[x[0]]) & (after <= s[x[-1]])
            rounds = inner.any()
            while True:
                order = np.argsort(bucket + at[x + 1])
                moved = x[order]
                at[moved] = to
                if not rounds or np.array_equal(moved, x):
                    break
                x = moved
            sa[to] = moved

    place(np.flatnonzero(~small), end - count, count - n_small, False)
    # the last suffix, a sentinel, stands first and is induced from nothing
    n_small[0] -= 1
    at[n - 1] = 0
    sa[0] = n - 1
    place(np.flatnonzero(small[:-1]), end - n_small, n_small, True)
    return sa


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Suffix array from the leftmost S suffixes (lms) in sorted order: L suffixes left to right, then S right to left.

    A bucket is taken in batches of what has been put into it so far, so each batch is a few array operations."""
    n, end = len(s), np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, dtype=np.int32)
    own = s[lms]
    n_own = np.bincount(own, minlength=len(count))
    first = np.cumsum(n_own) - n_own
    sa[end[own] - n_own[own] + np.arange(len(lms)) - first[own]] = lms

    head = start.copy()

    def to_left(batch: np.ndarray) -> None:
        j = batch[batch > 0] - 1
        j = j[~small[j]]
        if len(j):
            c = s[j]
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o].astype(np.int64)
            cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[cut, len(c)])
            sa[np.repeat(head[c[cut]] - cut, size) + np.arange(len(c))] = j
            head[c[cut]] += size

    used = np.flatnonzero(count)
    for c in used.tolist():
        done = start[c]
        while done < head[c]:
            batch, done = sa[done : head[c]], head[c]
            to_left(batch)
        if n_own[c]:
            to_left(sa[end[c] - n_own[c] : end[c]])

    tail = end.copy()

    def to_right(batch: np.ndarray) -> None:
        j = batch[batch > 0] - 1
        j = j[small[j]]
        if len(j):
            c = s[j]
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o].astype(np.int64)
            cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[cut, len(c)])
            sa[np.repeat(tail[c[cut]] - 1 + cut, size) - np.arange(len(c))] = j
            tail[c[cut]] -= size

    for c in used[::-1].tolist():
        if not c:
            continue
        done = end[c]
        while tail[c] < done:
            batch, done = sa[tail[c] : done][::-1], tail[c]
            to_right(batch)
        if head[c] > start[c]:
            to_right(sa[start[c] : head[c]][::-1])
    sa[0] = n - 1
    return sa


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-S substrings in text order, equal ones alike; order: their places sorted."""
    where = np.empty(len(s), dtype=np.int32)
    where[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.append(np.diff(lms) + 1, 1)
    rank = where[order]
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    length = size[rank]
    differ = length[:-1] != length[1:]
    active, t = np.flatnonzero(~differ), 0
    while len(active):
        unequal = s[a[active] + t] != s[b[active] + t]
        differ[active[unequal]] = True
        t += 1
        active = active[~unequal]
        active = active[length[active] > t]
    named = np.cumsum(np.append(False, differ))
    out = np.empty(len(lms), dtype=np.int64)
    out[rank] = named
    return out, int(named[-1]) + 1


def suffix_array(s: np.ndarray, levels: list[int] | None = None, per_bucket: int = PER_BUCKET) -> np.ndarray:
    """Suffix array of s, whose last element is 0 and the only 0, by induced sorting: the leftmost-S substrings are sorted by
    a first induction, the string of their names by recursion unless all differ, and the suffixes by a second induction.

    levels, if given, receives the length of the string at every level of the recursion."""
    n = len(s)
    if levels is not None:
        levels.append(n)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    small = suffix_types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    count = np.bincount(s)
    induce = _induce if n >= per_bucket * np.count_nonzero(count) else _induce_blocks
    rough = lms[np.argsort(s[lms], kind="stable")]
    sa = induce(s, small, rough, count)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    named, n_names = _names(s, lms, order)
    if n_names < len(lms):
        kind = np.uint16 if n_names <= 1 << 16 else np.int64
        order = lms[suffix_array(named.astype(kind), levels, per_bucket)]
    return induce(s, small, order, count)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, cap: int) -> np.ndarray:
    """PLCP: for each place the common prefix with the suffix before it in the array, counted up to cap.

    Where the characters before both agree, the value is one less than that of the place before; only the others, and
    the starts of contexts, are compared, eight bytes at a step."""
    n = len(s)
    phi = np.empty(n, dtype=np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    place = np.arange(n)
    before = np.maximum(phi, 0)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (phi[1:] <= 0) | (s[:-1] != s[np.maximum(before[1:] - 1, 0)]) | (phi[:-1] < 0)
    fresh[starts] = True
    wide = np.zeros(n + cap + 8, dtype=np.uint64)
    wide[:n] = s
    for bits, step in ((8, 1), (16, 2), (32, 4)):
        wide[:-step] |= wide[step:] << np.uint64(bits)
    out = np.zeros(n, dtype=np.int32)
    active = np.flatnonzero(fresh & (phi >= 0))
    a, b = active.astype(np.int64), phi[active].astype(np.int64)
    for at in range(0, cap, 8):
        x = wide[a + at] ^ wide[b + at]
        stop = x != 0
        low = x[stop] & (~x[stop] + np.uint64(1))
        out[active[stop]] = at + (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int32)
        active, a, b = active[~stop], a[~stop], b[~stop]
        if not len(active):
            break
    out[active] = cap
    base = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.maximum(out[base] - (place - base), 0).astype(np.int32)


def repeats_in(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, group) of every string of `length` bytes in the contexts; equal strings, equal groups."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    flat = np.frombuffer(b"\xff".join(contexts) + b"\xff", dtype=np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    kind = np.uint8 if not len(flat) or flat[flat != 0xFF].max(initial=0) < 0xFE else np.uint16
    s = np.empty(len(flat) + 1, dtype=kind)
    s[:-1] = flat.astype(kind) + kind(2)
    s[starts + sizes] = 1
    s[-1] = 0
    sa = suffix_array(s)
    reach = int(sizes.max(initial=0)) + length + 8
    plcp = permuted_prefixes(s, sa, starts, reach)
    group = np.cumsum(plcp[sa] < length)
    context = np.append(np.repeat(np.arange(len(starts)), sizes + 1), len(starts) - 1)[sa]
    offset = sa - starts[context]
    fine = (offset + length <= sizes[context]) & (sa < len(flat))
    return context[fine], offset[fine], group[fine]


# --- Spark -------------------------------------------------------------------------------------------------------


def _places(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, docs, places = [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary())):
                text = text.as_py()
                if doc_id is None or not text or len(text) < length:
                    continue
                at, grams = W.anchor_places(_RANDOM[np.frombuffer(text, dtype=np.uint8)], length, k)
                hashes.append(grams.view(np.int64))
                docs.append(np.full(len(at), doc_id, dtype=np.int64))
                places.append((np.int64(zlib.crc32(text)) << np.int64(32)) | at)
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, docs, places)], ["hash", "doc_id", "place"])

    return run


NAMES = ["deal", "doc_id", "place", "length", "context"]
ROWS = "deal long, doc_id long, place long, length long, context binary"
FLAGS = ["doc_id", "place", "length"]


def _rows(deal, doc, place, length, context=None) -> pa.RecordBatch:
    ints = [pa.array(x, pa.int64()) for x in (deal, doc, place, length)]
    return pa.RecordBatch.from_arrays([*ints, pa.array(context, pa.binary()) if context is not None else pa.nulls(len(deal), pa.binary())], NAMES)


def _contexts(length: int, k: int):
    """(doc_id, text, places) -> contexts of repeated anchors, and runs that are settled here (no context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int, int]] = {}
        settled: list[tuple[int, int, int]] = []
        twins: list[tuple[int, int, int, int, bytes]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if settled:
                d, p, n = zip(*settled)
                yield _rows(d, d, p, n)
            if seen:
                deal, doc, place, n = zip(*seen.values())
                yield _rows(deal, doc, place, n, list(seen))
            if twins:
                yield _rows(*zip(*twins))
            seen.clear()
            settled.clear()
            twins.clear()

        for batch in batches:
            for i, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()))):
                text = text.as_py()
                tag = zlib.crc32(text)
                marked = batch["places"][i].values
                place = marked.field("place").to_numpy(zero_copy_only=False)
                is_hot = marked.field("hot").to_numpy(zero_copy_only=False).astype(bool)
                own = (place >> np.int64(32)) & np.int64(WHOLE) == np.int64(tag)
                place, is_hot = place[own] & np.int64(WHOLE), is_hot[own]
                if not len(place) or (place == WHOLE).any():
                    continue
                order = np.argsort(place, kind="stable")
                place, is_hot = place[order], is_hot[order]
                tokens = _RANDOM[np.frombuffer(text, dtype=np.uint8)]
                starts, at, grams = W.anchored_windows(tokens, length, k, place)
                if not len(starts):
                    continue
                base = tag << 32 if tag < 1 << 31 else (tag << 32) - (1 << 64)
                # a context is a run of windows around one anchor; windows of a hot anchor stand alone, dealt by their own hash
                alone = is_hot[np.searchsorted(place, at)]
                deal = grams.view(np.int64)
                if alone.any():
                    deal = np.where(alone, W.mix(W.grams(tokens, length, W.BASE)[starts]).view(np.int64), deal)
                cut = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (at[1:] != at[:-1]) | alone[1:]])
                last = np.r_[cut[1:], len(starts)] - 1
                for lo, hi, to in zip(starts[cut].tolist(), starts[last].tolist(), deal[cut].tolist()):
                    context = text[lo : hi + length]
                    n = hi - lo + 1
                    old = seen.get(context)
                    if old is None:
                        seen[context] = (to, doc_id, base | lo, n)
                        held += len(context) + 200
                    elif (doc_id, lo) < (old[1], old[2] & WHOLE):
                        settled.append((old[1], old[2], n))
                        seen[context] = (to, doc_id, base | lo, n)
                    elif (doc_id, lo) != (old[1], old[2] & WHOLE):
                        settled.append((doc_id, base | lo, n))
                    elif base | lo != old[2]:
                        # another text of the same id, at the same place: not later, but not this row either
                        twins.append((to, doc_id, base | lo, n, context))
                        held += len(context) + 200
                if held >= LOCAL:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _runs(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Flagged windows as runs of neighbours."""
    o = np.lexsort((place, doc))
    doc, place = doc[o], place[o]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])] if len(doc) else np.zeros(0, dtype=bool)
    doc, place = doc[fresh], place[fresh]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)]) if len(doc) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[cut, len(doc)]) if len(doc) else cut
    return pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(place[cut]), pa.array(size.astype(np.int64))], FLAGS)


def _shards(length: int, shard: int):
    """Rows sorted by deal and doc_id -> flags; contexts gather until a shard is full and its anchor ends."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        # equal contexts are settled by comparing them whole; only anchors with different ones need an array
        first: dict[bytes, tuple[int, int, int]] = {}
        copies: list[tuple[int, int, int]] = []
        twins: list[tuple[int, int, int, bytes]] = []
        for deal, doc, place, context in rows:
            old = first.get(context)
            if old is None:
                first[context] = (deal, doc, place)
            elif (doc, place & WHOLE) < (old[1], old[2] & WHOLE):
                copies.append((old[1], old[2], len(context)))
                first[context] = (deal, doc, place)
            elif (doc, place & WHOLE) != (old[1], old[2] & WHOLE):
                copies.append((doc, place, len(context)))
            elif place != old[2]:
                twins.append((deal, doc, place, context))
        kinds = Counter(x[0] for x in first.values())
        left = [(doc, place, context) for context, (deal, doc, place) in first.items() if kinds[deal] > 1]
        left += [(doc, place, context) for deal, doc, place, context in twins if kinds[deal] > 1]
        doc_out, place_out = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if copies:
            d, p, n = (np.array(x, dtype=np.int64) for x in zip(*copies))
            n -= length - 1
            doc_out = np.repeat(d, n)
            place_out = np.repeat(p, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if left:
            docs = np.array([r[0] for r in left], dtype=np.int64)
            places = np.array([r[1] for r in left], dtype=np.int64)
            context, offset, group = repeats_in([r[2] for r in left], length)
            doc, place = docs[context], places[context] + offset
            order = np.lexsort((place & np.int64(WHOLE), doc, group))
            doc, place, group = doc[order], place[order], group[order]
            head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.r_[head, len(group)])
            d0, p0 = np.repeat(doc[head], size), np.repeat(place[head] & np.int64(WHOLE), size)
            later = (doc > d0) | ((doc == d0) & (place & np.int64(WHOLE) > p0))
            doc_out, place_out = np.r_[doc_out, doc[later]], np.r_[place_out, place[later]]
        return _runs(doc_out, place_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last_deal = [], 0, None
        for batch in batches:
            known = batch["context"].is_null()
            if known.true_count:
                yield pa.RecordBatch.from_arrays([batch[n].filter(known) for n in FLAGS], FLAGS)
            text = batch.filter(batch["context"].is_valid())
            for deal, doc, place, context in zip(*(text[n].to_pylist() for n in ("deal", "doc_id", "place", "context"))):
                if deal != last_deal and held >= shard:
                    yield solve(rows)
                    rows, held = [], 0
                last_deal = deal
                rows.append((deal, doc, place, context))
                held += len(context)
        if rows:
            yield solve(rows)

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(doc_id, text) -> (doc_id, flags): starts of the strings of `length` bytes that also start earlier, as an array of
    (place, length): tag and first start, number of starts in a row; length 0 stands for the whole text.

    An anchor that occurs more than `hot` times sends each of its windows, bytes and all, to the task of the window's own
    hash, so that no shard holds a group that grows with the input. Copies of a context, and of a hot window, are settled
    inside the task that reads them: at most one row for each task and text is dealt out."""
    d = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    same = d.groupBy(F.md5("text").alias("m"), F.crc32(F.col("text").cast("binary")).alias("tag"))
    heads = same.agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail")
    heads = durable(heads.select("m", "tag", "head"), "suf-heads")
    ids = d.select("doc_id", F.md5("text").alias("m"))
    copies = durable(
        ids.join(heads, "m").where("doc_id > head").select("doc_id", F.shiftleft("tag", 32).bitwiseOR(F.lit(WHOLE)).alias("place")).distinct(), "suf-copies"
    )
    feed = durable(d.mapInArrow(_places(length, k), "hash long, doc_id long, place long"), "suf-anchors")
    shared = feed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", (F.col("n") > hot).alias("hot"))
    shared = durable(shared, "suf-shared")
    places = feed.join(shared.hint("shuffle_hash"), "hash").select("doc_id", "place", "hot")
    places = places.unionByName(copies.withColumn("hot", F.lit(False)))
    grouped = durable(places.groupBy("doc_id").agg(F.collect_list(F.struct("place", "hot")).alias("places")), "suf-places")
    discard(feed, shared)
    found = d.join(grouped, "doc_id").mapInArrow(_contexts(length, k), ROWS)
    order = ["deal", "doc_id", F.col("place").bitwiseAND(F.lit(WHOLE))]
    flags = found.repartition("deal").sortWithinPartitions(*order).mapInArrow(_shards(length, shard), "doc_id long, place long, length long")
    whole = copies.select("doc_id", "place", F.lit(0).cast("long").alias("length"))
    flags = flags.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("place", "length")).alias("flags"))
    flags = durable(flags, "suf-flags")
    discard(heads, copies, grouped)
    return flags


def _cut(length: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, digests, kept = [], [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                text = text.as_py() or b""
                gone: list[tuple[int, int]] = []
                flags = batch["flags"][i]
                if len(text) >= length and flags.is_valid:
                    place = flags.values.field("place").to_numpy(zero_copy_only=False)
                    size = flags.values.field("length").to_numpy(zero_copy_only=False)
                    own = (place >> np.int64(32)) & np.int64(WHOLE) == np.int64(zlib.crc32(text))
                    place, size = place[own] & np.int64(WHOLE), size[own]
                    if (size == 0).any():
                        gone = [(0, len(text))]
                    elif len(place):
                        o = np.argsort(place, kind="stable")
                        first, last = place[o], np.maximum.accumulate((place + size + length - 1)[o])
                        fresh = np.r_[True, first[1:] > last[:-1]]
                        ends = last[np.r_[np.flatnonzero(fresh)[1:] - 1, len(last) - 1]]
                        gone = list(zip(first[fresh].tolist(), ends.tolist()))
                at, rest = 0, []
                for a, b in gone:
                    rest.append(text[at:a])
                    at = b
                left = b"".join([*rest, text[at:]])
                n_bytes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in gone])
                digests.append(hashlib.sha256(left).hexdigest())
                if keep:
                    kept.append(left)
            pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            out = [pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(digests, pa.string())]
            names = ["n_bytes", "spans", "kept_sha256"]
            if keep:
                out.append(pa.array(kept, pa.binary()))
                names.append("kept")
            own = [i for i, c in enumerate(batch.schema.names) if c != "flags"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in own] + out, [batch.schema.names[i] for i in own] + names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT, shard: int = SHARD, keep: bool = True) -> DataFrame:
    """Adds n_bytes, spans (removed byte ranges [start, end), maximal), kept_sha256 and, with keep, kept (the remaining
    bytes) to each row.

    Removed is each byte that a string of `length` bytes covers which also starts earlier: in a document with a smaller
    id, or before in the same. Null texts count as empty; rows with a null id, or shorter than `length`, lose nothing;
    rows that repeat an id are told apart by their text but count as the same document. No rows give no rows. Columns of
    docs with a name of the results, or named flags, are replaced or left out."""
    docs = docs.drop("flags", "n_bytes", "spans", "kept_sha256", "kept")
    flags = repeated_strings(docs, length, k, hot, shard)
    pair = StructType([StructField("start", LongType()), StructField("end", LongType())])
    fields = [*docs.schema.fields, StructField("n_bytes", LongType()), StructField("spans", ArrayType(pair)), StructField("kept_sha256", StringType())]
    if keep:
        fields.append(StructField("kept", BinaryType()))
    return docs.join(flags, "doc_id", "left").select(*docs.columns, "flags").mapInArrow(_cut(length, keep), StructType(fields))
