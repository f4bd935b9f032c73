"""Benchmark decontamination by template canonicalisation.

Numbers, quantities with units and names become typed placeholders; five-token windows of these templates are hash-joined
with those of the benchmark; the values behind the placeholders must map consistently, so that a question with other
numbers or names is caught while chance matches of templates are not.

Letter case is only a hint at a name, so every text is read three ways: with capitalised words inside sentences as names,
with those that open a sentence as names too, and without names. Tokens are lower-cased, so the third reading finds an
item in any letter case, with other numbers too, and the second one items whose sentences begin with names."""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import windows as W
from .common import durable

#: Tokens of a window and the share of an item's windows that makes a document contaminated.
WIDTH, SHARE = 5, 0.8
#: Benchmark windows up to which their hashes are broadcast to thin out the documents' windows before the join (8 bytes
#: each); a larger benchmark is joined without that.
BROADCAST_WINDOWS = 2_000_000
#: Word types that a task remembers.
CACHE = 250_000
#: Bytes of texts whose words are read as one array: a short text alone costs more calls than work.
TOGETHER = 1 << 18

# Words that are numbers, units that make a number a quantity, names that are known where a sentence opens.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNITS = frozenset(
    "mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers inch inches foot feet yard yards mile miles "
    "mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degrees celsius fahrenheit kph mph watt watts volt volts".split()
)
NAMES = frozenset(
    "alice bob carol dave eve john mary james anna peter paul sarah emma liam noah olivia david maria tom jane jack lucy "
    "michael susan robert linda william karen sam lisa mark laura kevin julia alex nina oscar ruth simon clara".split()
)

_NUMBER = re.compile(r"[$€£+-]*\d[\d,.]*%?")
_QUANTITY = re.compile(r"[$€£]\d[\d,.]*|\d[\d,.]*%|\d[\d,.]*([a-z]+)")
_STRIP = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")

NUM, QTY, NAME, UNIT, CAPITAL, END, EMPTY = 1, 2, 4, 8, 16, 32, 64
_HOLD = {k: np.uint64(xxhash.xxh64_intdigest(b"\0slot" + bytes([k]))) for k in (NUM, QTY, NAME)}


#: Characters that a word is freed of without a pattern; what remains odd goes the slow way.
_MARKS = ".,;:!?\"'()[]{}|#*&%$€£+-–—«»„“”…_/\\<>=~@^"


#: Longest word that is read without looking it up, and marks behind it.
SHORT, BEHIND = 64, 4


def _among(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[[ord(c) for c in chars if c.isascii()]] = 1
    return out


_UPPER, _LETTER, _MARK, _CLOSES, _ENDS = (_among(x) for x in (string.ascii_uppercase, string.ascii_letters, _MARKS, "\"')]", ".!?:;"))
_OTHER = _LETTER == 0
_LOWER = np.arange(256, dtype=np.uint8) + _UPPER * np.uint8(32)
_CUT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_M64 = (1 << 64) - 1


def _plain_hash(word: bytes) -> int:
    """Hash of a word of lower-case ASCII letters, eight at a time; _plain_hashes() has it for many."""
    h = len(word) * W.BASE & _M64
    for i in range(0, len(word), 8):
        h ^= int.from_bytes(word[i : i + 8], "little")
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _M64
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _M64
        h ^= h >> 31
    return h


def _plain_hashes(low: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the words of n > 0 bytes at the places `at` of low, behind which there are eight bytes more."""
    eight = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
    h = W.mix((n.astype(np.uint64) * np.uint64(W.BASE)) ^ (eight[at] & _CUT[np.minimum(n, 8)]))
    i, more = 8, np.flatnonzero(n > 8)
    while len(more):
        h[more] = W.mix(h[more] ^ (eight[at[more] + i] & _CUT[np.minimum(n[more] - i, 8)]))
        i += 8
        more = more[n[more] > i]
    return h


_known = {}
for _flag, _list in ((NUM, NUMBER_WORDS), (NAME, NAMES), (UNIT, UNITS)):
    for _word in _list:
        _known[_plain_hash(_word.encode())] = _known.get(_plain_hash(_word.encode()), 0) | _flag
_KNOWN = np.array(sorted(_known), dtype=np.uint64)
_FLAGS = np.array([_known[h] for h in sorted(_known)], dtype=np.uint8)
_MAYBE = np.zeros(1 << 16, dtype=bool)
_MAYBE[_KNOWN & np.uint64(0xFFFF)] = True


class _Words(dict):
    """Word -> number of its type; keeps hash, kind and surface of each type."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q")
        self.kinds = array("B")
        self.surface: list[str] = []

    def __missing__(self, key: bytes) -> int:
        word = key.decode()
        bare = word.strip(_MARKS)
        kind = 0
        if bare.isalpha():
            low = bare.lower()
            first = bare[0]
            if low in NUMBER_WORDS:
                kind |= NUM
            elif first != low[0]:
                kind |= NAME if low in NAMES else CAPITAL
        else:
            bare = _STRIP.sub("", word)
            low = bare.lower()
            quantity = _QUANTITY.fullmatch(low)
            if not low.strip("$€£+-_%"):
                kind |= EMPTY
            elif quantity and (quantity[1] is None or quantity[1] in UNITS):
                kind |= QTY
            elif _NUMBER.fullmatch(low):
                kind |= NUM
            elif bare[0].isupper():
                kind |= CAPITAL
        if low in UNITS:
            kind |= UNIT
        if word[-1] in _LAST and word.rstrip("\"')]»”").endswith((".", "!", "?", ":", ";")):
            kind |= END
        at = self[key] = len(self.kinds)
        self.hashes.append(_plain_hash(low.encode()) if low.isascii() and low.isalpha() else xxhash.xxh64_intdigest(low.encode()))
        self.kinds.append(kind)
        self.surface.append(low)
        return at


_LAST = frozenset(".!?:;\"')]»”")


def _before(x: np.ndarray, first) -> np.ndarray:
    """x moved on by one place."""
    out = np.empty_like(x)
    out[:1] = first
    out[1:] = x[:-1]
    return out


class Canonical:
    """Turns texts into template tokens; remembers word types."""

    def __init__(self):
        self.words = _Words()

    def read(self, texts: list[bytes]) -> "Reading":
        """The words of texts, one behind the other, that are not mere marks, with what each can be."""
        if len(self.words) > CACHE:
            self.words = _Words()
        whole = b"\n".join(texts) + b"\n" * 16
        data = np.frombuffer(whole, dtype=np.uint8)
        begin, stop = W.word_spans(data)
        start = np.r_[np.searchsorted(begin, np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])), len(begin)]
        hashes, kind, slow = self._letters(data, begin, stop)
        if len(slow):
            w = self.words
            words = [whole[a:b] for a, b in zip(begin[slow].tolist(), stop[slow].tolist())]
            ids = np.fromiter(map(w.__getitem__, words), dtype=np.int64, count=len(words))
            hashes[slow], kind[slow] = np.frombuffer(w.hashes, dtype=np.uint64)[ids], np.frombuffer(w.kinds, dtype=np.uint8)[ids]
        end = kind & END != 0
        opens = _before(end, True)
        empty = kind & EMPTY != 0
        if empty.any():
            # a word that is nothing but marks can still end a sentence
            has = np.flatnonzero(~empty)
            ends = _before(np.cumsum(end), 0)[has]
            opens = ends != _before(ends, -1)
            kind, hashes, begin, stop, start = kind[has], hashes[has], begin[has], stop[has], np.searchsorted(has, start)
        return Reading(self.words, whole, begin, stop, hashes, kind, opens, start)

    @staticmethod
    def _letters(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, kind, places of the others) of words that are ASCII letters between marks, as _Words has them but without
        a look at each: most words of a corpus are seen once or twice."""
        other = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(_OTHER[data], out=other[1:])
        lo, hi, last = begin + _MARK[data[begin]], stop, stop - 1
        for _ in range(BEHIND):
            hi = hi - _MARK[data[hi - 1]]
            last = last - _CLOSES[data[last]]
        n = hi - lo
        fast = (n > 0) & (n <= SHORT) & (other[hi] == other[lo])
        h = _plain_hashes(_LOWER[data], lo, np.where(fast, n, 1))
        kind = _UPPER[data[lo]] * np.uint8(CAPITAL)
        at = np.flatnonzero(_MAYBE[h & np.uint64(0xFFFF)])
        k = np.minimum(np.searchsorted(_KNOWN, h[at]), len(_KNOWN) - 1)
        there = _KNOWN[k] == h[at]
        at, flags = at[there], _FLAGS[k[there]]
        name = np.where(flags & NAME, NAME, CAPITAL).astype(np.uint8)
        kind[at] = np.where(flags & NUM, NUM, np.where(kind[at] != 0, name, 0)).astype(np.uint8) | (flags & UNIT)
        kind |= _ENDS[data[last]] * np.uint8(END)
        return h, kind, np.flatnonzero(~fast)


class Reading:
    """The words of texts and the three ways to read which of them are names. start: where each text begins, and the end."""

    def __init__(self, words: _Words, whole: bytes, begin: np.ndarray, stop: np.ndarray, hashes: np.ndarray, kind: np.ndarray, opens: np.ndarray, start: np.ndarray):
        self.words, self.whole, self.begin, self.stop, self.hashes, self.start = words, whole, begin, stop, hashes, start
        self.head = start[:-1][start[:-1] < start[1:]]
        opens[self.head] = True
        self.number = kind & NUM != 0
        self.unit = kind & UNIT != 0
        self.unit &= self._before(self.number)
        self.quantity = (kind & QTY != 0) | (self.number & _before(self.unit[::-1], False)[::-1])
        capital, known = (kind & CAPITAL != 0) & ~self.unit, (kind & NAME != 0) & ~self.unit
        self.names = [known | (capital & ~opens), known | capital, np.zeros(len(kind), dtype=bool)]

    def _before(self, x: np.ndarray) -> np.ndarray:
        """Whether x holds for the word before, in the same text."""
        out = _before(x, False)
        out[self.head] = False
        return out

    def windows(self, way: int, width: int, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word, word behind the last, whether it counts verbatim) of every `width` tokens of one text,
        read in one way; wanted tells which hashes of many to keep.

        A window with fewer than two words that aren't placeholders says little; it is hashed as it stands."""
        name = self.names[way]
        slot = np.zeros(len(name), dtype=np.uint8)
        slot[name] = NAME
        slot[self.number] = NUM
        slot[self.quantity] = QTY
        # units and further words of a name are part of the value of the token before
        named = slot == NAME
        at = np.flatnonzero(~(self.unit | (named & self._before(named))))
        if len(at) < width:
            none = np.empty(0, dtype=np.int64)
            return none.astype(np.uint64), none, none, none, none.astype(bool)
        raw, slot = self.hashes[at], slot[at]
        tokens = raw.copy()
        for k, h in _HOLD.items():
            tokens[slot == k] = h
        h = W.mix(W.grams(tokens, width, W.BASE_A) ^ np.uint64(width))
        plain = np.zeros(len(slot) + 1, dtype=np.int32)
        np.cumsum(slot == 0, out=plain[1:])
        verbatim = plain[width:] - plain[:-width] < 2
        v = np.flatnonzero(verbatim)
        if len(v):
            # the windows of the rows of `width` words each that begin with them
            rows = raw[v[:, None] + np.arange(width)].ravel()
            h[v] = W.mix(W.grams(rows, width, W.BASE_B)[::width] ^ np.uint64(width))
        keep = np.arange(len(h)) if wanted is None else wanted(h)
        edge = np.r_[at, len(self.hashes)]
        first, last = edge[keep], edge[keep + width]
        text = np.searchsorted(self.start, first, "right") - 1
        inside = last <= self.start[text + 1]
        return h[keep][inside], text[inside], first[inside], last[inside], verbatim[keep][inside]

    def surface(self, i: int) -> str:
        return self.words.surface[self.words[self.whole[self.begin[i] : self.stop[i]]]]

    def values(self, way: int, lo: int, hi: int) -> list[str]:
        """What stands behind the placeholders of a window."""
        out, name, was = [], self.names[way], False
        for i in range(lo, hi):
            if self.unit[i] or (name[i] and was):
                if out:
                    out[-1] += " " + self.surface(i)
            elif self.number[i] or self.quantity[i] or name[i]:
                out.append(self.surface(i))
            was = bool(name[i]) and not (self.number[i] or self.quantity[i])
        return out


WINDOWS = "hash long, id long, tag long, way int, width int, at int, place int, words int, slots array<string>"
_NAMES = [c.split()[0] for c in WINDOWS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> all windows under each reading; an item of fewer tokens than a window is one window."""
    canonical = Canonical()
    for batch in batches:
        rows = []
        for key, text in zip(batch["item_id"].to_pylist(), batch["text"].cast(pa.binary())):
            text = text.as_py()
            if key is None or not text:
                continue
            r = canonical.read([text])
            for way in range(3):
                for width in range(WIDTH, 0, -1):
                    h, _, first, last, verbatim = r.windows(way, width)
                    if len(h):
                        break
                for at, (x, lo, hi, v) in enumerate(zip(h.view(np.int64).tolist(), first.tolist(), last.tolist(), verbatim.tolist())):
                    rows.append((x, key, 0, way, width, at, lo, len(r.hashes), [] if v else r.values(way, lo, hi)))
        if rows:
            yield _batch(rows)


def _found_windows(widths: list[int], thin):
    """(doc_id, text) -> windows of the given widths; of a later reading only those that differ from the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = thin.value if thin else None
        if known is not None:
            bits = max(16, int(len(known) * 16 - 1).bit_length())
            bitmap = np.zeros(1 << bits, dtype=bool)
            low = np.uint64((1 << bits) - 1)
            bitmap[known & low] = True

        def wanted(h: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(bitmap[h & low])
            return at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]

        canonical = Canonical()
        for batch in batches:
            rows = []
            for keys, texts in _together(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                r = canonical.read(texts)
                tags = {}
                for way in range(3):
                    sums = np.r_[0, np.cumsum(r.names[way] != r.names[0])]
                    if way and not sums[-1]:
                        continue
                    for width in widths:
                        h, text, first, last, verbatim = r.windows(way, width, None if known is None else wanted)
                        if way:
                            at = np.flatnonzero(sums[last] > sums[first])
                            h, text, first, last, verbatim = h[at], text[at], first[at], last[at], verbatim[at]
                        place = first - r.start[text]
                        for x, i, lo, hi, p, v in zip(h.view(np.int64).tolist(), text.tolist(), first.tolist(), last.tolist(), place.tolist(), verbatim.tolist()):
                            if i not in tags:
                                tags[i] = zlib.crc32(texts[i])
                            rows.append((x, keys[i], tags[i], way, width, 0, p, 0, [] if v else r.values(way, lo, hi)))
            if rows:
                yield _batch(rows)

    return run


def _together(keys: list, texts: list) -> Iterator[tuple[list[int], list[bytes]]]:
    """Keys and texts, without null keys and null or empty texts, in groups of some TOGETHER bytes."""
    some, size = ([], []), 0
    for key, text in zip(keys, texts):
        if key is None or not text:
            continue
        some[0].append(key)
        some[1].append(text)
        size += len(text)
        if size >= TOGETHER:
            yield some
            some, size = ([], []), 0
    if some[0]:
        yield some


KEY = ["id", "tag", "item_id", "way", "stretch"]


def _judge(share: float):
    """Windows found by document, item, reading and stretch -> the items that are held there. A value of the item stands
    for the value it meets most often, and the other way round; windows that disagree don't count."""

    def settle(key: tuple, n: int, rows: list[tuple]) -> tuple | None:
        if len({at for at, _ in rows}) < share * n:
            return None
        met = Counter(p for _, pairs in rows for p in pairs)
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        for (b, d), _ in sorted(met.items(), key=lambda x: (-x[1], x[0])):
            there.setdefault(b, d)
            back.setdefault(d, b)
        rows = [(at, pairs) for at, pairs in rows if all(there[b] == d and back[d] == b for b, d in pairs)]
        coverage = len({at for at, _ in rows}) / n
        if coverage < share:
            return None
        return key[0], key[2], coverage, all(b == d for _, pairs in rows for b, d in pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, rows = None, 0, []

        def out(done: list) -> Iterator[pa.RecordBatch]:
            done = [x for x in done if x]
            if done:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["doc_id", "item_id", "coverage", "same"])

        for batch in batches:
            done = []
            for *key, size, at, slots, values in zip(*(batch[c].to_pylist() for c in (*KEY, "n", "at", "slots", "item_slots"))):
                if key != last:
                    if last:
                        done.append(settle(tuple(last), n, rows))
                    last, n, rows = key, size, []
                rows.append((at, list(zip(values, slots))))
            yield from out(done)
        if last:
            yield from out([settle(tuple(last), n, rows)])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> one row per document and item that it holds: doc_id, item_id,
    coverage (share of the item's windows found together), reparameterised (whether any value differs).

    An item is held if, in one of the three readings, at least `share` of its template windows lie within a stretch of the
    document of at most twice its length, counting only windows whose values fit the mapping of most: every value of the item
    for one value of the document and the other way round. An item of fewer than WIDTH tokens is one window. Windows with
    fewer than two plain words count verbatim only. Null ids and null or empty texts match nothing. Repeated items are
    told apart by nothing and count as one; rows that repeat a doc_id give one row at most.

    Documents are read once. While the benchmark has at most BROADCAST_WINDOWS windows, which is counted, its hashes
    thin out the documents' windows in the scan; the join is an equi-join on the hash either way, and everything grouped
    is bounded by the length of an item."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").mapInArrow(_item_windows, WINDOWS)
    items = durable(items.select("hash", F.col("id").alias("item_id"), "way", "width", "at", "words", F.col("slots").alias("item_slots")), "dec-items")
    sizes = items.groupBy("item_id", "way").agg(F.countDistinct("at").alias("n"))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # WIDTH of them at most
    thin = None
    if items.count() <= BROADCAST_WINDOWS:
        known = items.select("hash").distinct().toArrow()["hash"].to_numpy().view(np.uint64)
        thin = spark.sparkContext.broadcast(np.sort(known))
    found = docs.select("doc_id", "text").mapInArrow(_found_windows(widths, thin), WINDOWS)
    found = durable(found.select("hash", "id", "tag", "place", "slots"), "dec-found")
    met = found.join(items.drop("width"), "hash").join(sizes, ["item_id", "way"]).where(F.size("slots") == F.size("item_slots"))
    # stretches of twice the item's words, at two offsets: whatever fits in one length lies whole in one of them
    half = F.floor(F.col("place") / F.col("words"))
    met = met.withColumn("stretch", F.explode(F.array(half, half - 1)))
    met = met.select(*KEY, F.col("n").cast("int").alias("n"), "at", "slots", "item_slots").repartition(*KEY).sortWithinPartitions(*KEY)
    held = met.mapInArrow(_judge(share), "doc_id long, item_id long, coverage double, same boolean")
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "same")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.coverage").alias("coverage"), (~F.col("m.same")).alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of docs that hold no benchmark item; columns as before. Rows without an id stay."""
    bad = durable(contaminated(docs, benchmark, share).select("doc_id").distinct(), "dec-bad")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
