"""Toxicity: a counterfactual-regularised classifier on words, word beginnings and how densely they occur."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import durable

TOKEN = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")

# Identity terms that stand for one another in a counterfactual sentence, one group per line.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("she", "he"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("african", "american", "european", "mexican", "chinese", "indian", "arab"),
    ("old", "young"), ("disabled", "deaf", "blind"),
)


@dataclass(frozen=True)
class ToxicityParams:
    """max_rows bounds the labelled rows that the classifier is fitted on, and so the memory of the driver. Every feature that
    min_rows of them have gets a weight, and every counterfactual sentence in them counts. telling is the chi-square of a
    feature with the label at which its prior is a half."""

    max_rows: int = 10_000
    min_rows: int = 3
    l2: float = 2e-4
    telling: float = 15.0
    counterfactual: float = 1.0
    steps: int = 200
    rate: float = 0.1
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS


#: Lengths of word beginnings that are features of their own: stems survive inflection and compounding.
STEMS = (4, 6)
#: A feature that occurs twice and in at least one of so many words also counts as dense.
DENSE = 200
#: Words that a scoring task remembers the features of.
CACHE = 100_000


def word_features(word: str) -> list[str]:
    """The word itself and, marked by ^, its beginnings."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) >= k)]


def features(text: str | None) -> set[str]:
    """Features of a whole text; a + at the end marks a dense one."""
    counts = Counter(TOKEN.findall(text.lower())) if text else {}
    total: Counter[str] = Counter()
    for word, k in counts.items():
        for f in word_features(word):
            total[f] += k
    n = sum(counts.values())
    return {*total, *(f + "+" for f, k in total.items() if k >= 2 and k * DENSE >= n)}


@dataclass
class ToxicityModel:
    """Weights of features of a text, and a bias."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def scorer(self):
        """text -> score, the same as of features() but looking only at features that have a weight."""
        names = sorted({f.removesuffix("+") for f in self.weights})
        number = {f: i for i, f in enumerate(names)}
        here = np.array([self.weights.get(f, 0.0) for f in names])
        dense = np.array([self.weights.get(f + "+", 0.0) for f in names])
        cache: dict[str, np.ndarray] = {}
        bias = self.bias

        def score(text: str | None) -> float:
            counts = Counter(TOKEN.findall(text.lower())) if text else {}
            own, times = [], []
            for word, k in counts.items():
                ids = cache.get(word)
                if ids is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    ids = cache[word] = np.array([number[f] for f in word_features(word) if f in number], dtype=np.int32)
                if len(ids):
                    own.append(ids)
                    times.append(k)
            n, z = sum(counts.values()), bias
            if own:
                # ascending numbers: one order of summation, so that reruns agree to the last bit
                ids, at = np.unique(np.concatenate(own), return_inverse=True)
                total = np.bincount(at, np.repeat(times, [len(x) for x in own]))
                z += here[ids].sum() + dense[ids[(total >= 2) & (total * DENSE >= n)]].sum()
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return score


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Features that a task counts before it hands them over.
EMIT = 200_000


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word, k): in how many texts a feature is; counted in the task first."""
    every: Counter[str] = Counter()

    def take() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64())], ["word", "k"])
        every.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            every.update(features(text.as_py()))
            if len(every) >= EMIT:
                yield take()
    yield take()


def _rows(vocabulary, partner: dict[str, tuple[str, ...]]):
    """(doc_id, label, text) -> a row's features, or (label -1) those that only a sentence has and only its swapped form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            kind, key, a, b = [], [], [], []
            for doc_id, y, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "label", "text"))):
                kind.append(y)
                key.append(doc_id)
                a.append(sorted(number[t] for t in features(text) if t in number))
                b.append([])
                for sentence in SENTENCE.split(text or ""):
                    words = TOKEN.findall(sentence.lower())
                    for term in sorted(partner.keys() & set(words)):
                        own = features(sentence)
                        for other in partner[term]:
                            swapped = features(" ".join(other if w == term else w for w in words))
                            kind.append(-1)
                            key.append(None)
                            a.append(sorted(number[t] for t in own - swapped if t in number))
                            b.append(sorted(number[t] for t in swapped - own if t in number))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(a, ints), pa.array(b, ints)], ["kind", "doc_id", "a", "b"]
            )

    return run


@dataclass
class Lists:
    """Lists of numbers, one after another: those of list i are items[cut[i] : cut[i + 1]]."""

    cut: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Lists:
        size = np.concatenate([np.zeros(1, dtype=np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in column.chunks)])
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
        return cls(np.cumsum(size), np.concatenate(flat) if flat else np.empty(0, dtype=np.int32))

    def numbers(self) -> np.ndarray:
        """For every item the number of its list."""
        return np.repeat(np.arange(len(self.cut) - 1, dtype=np.int32), np.diff(self.cut))

    def turned(self, n: int) -> Lists:
        """For each of n numbers the lists that hold it."""
        order = np.argsort(self.items, kind="stable")
        return Lists(np.searchsorted(self.items[order], np.arange(n + 1)), self.numbers()[order])

    def stretches(self, size: int = 1 << 17) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Lists that are not empty, a stretch of about `size` items at a time: their numbers, items and starts."""
        full = np.flatnonzero(self.cut[1:] > self.cut[:-1])
        if not len(full):
            return []
        edge = np.flatnonzero(np.diff(self.cut[full] // size)) + 1
        return [(p, self.items[self.cut[p[0]] : self.cut[p[-1] + 1]], self.cut[p] - self.cut[p[0]]) for p in np.split(full, edge)]


def sums(stretches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, n: int) -> np.ndarray:
    """Sum of x over the items of each of n lists."""
    out = np.zeros(n)
    for part, items, start in stretches:
        out[part] = np.add.reduceat(x[items], start)
    return out


def fit_weights(rows: Lists, y: np.ndarray, a: Lists, b: Lists, times: np.ndarray, n: int, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Minimises mean log loss + l2 |w|^2 + counterfactual * mean (logit(s) - logit(s swapped))^2 by Adam.

    Pair i has the features a[i] on one side only and b[i] on the other, and stands for times[i] sentences. The penalty of a
    feature grows as it tells less of the labels, smoothly and without end, so that the many that tell nothing don't
    add up. Features of exactly the same rows are fitted as one of the same total and penalty."""
    holders = rows.turned(n)
    k = np.diff(holders.cut).astype(float)
    expected = y.mean() * k
    told = (sums(holders.stretches(), y, n) - expected) ** 2 / (expected + 1)
    prior = told**2 / (told**2 + p.telling**2) + 1e-4
    mark = np.random.default_rng(1).integers(1, 1 << 38, size=len(y)).astype(float)
    seen = sums(holders.stretches(), mark, n)  # whole numbers below 2**53: exact, one for each set of rows
    seen[k == 0] = -1 - np.flatnonzero(k == 0)  # features without rows stay apart
    del holders
    _, one, same, many = np.unique(seen, return_index=True, return_inverse=True, return_counts=True)
    scale, k = np.sqrt(many) * prior[one], len(one)
    part = np.sqrt(many) / prior[one]  # a feature's weight is w / part
    keep = np.zeros(n, dtype=bool)
    keep[one] = True
    chosen = keep[rows.items]
    rows = Lists(np.r_[0, np.cumsum(chosen)][rows.cut], same[rows.items[chosen]].astype(np.int32))
    by_row, by_feature = rows.stretches(), rows.turned(k).stretches()
    a, b = (Lists(x.cut, same[x.items].astype(np.int32)) for x in (a, b))
    on_a, on_b, share = a.numbers(), b.numbers(), times / max(times.sum(), 1)
    w, bias = np.zeros(k), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, p.steps + 1):
        z = sums(by_row, w * scale, len(y)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g = sums(by_feature, e, k) * scale + 2 * p.l2 * w
        each = w / part
        d = (np.bincount(on_a, each[a.items], len(times)) - np.bincount(on_b, each[b.items], len(times))) * share * (2 * p.counterfactual)
        g += (np.bincount(a.items, d[on_a], k) - np.bincount(b.items, d[on_b], k)) / part
        full = np.append(g, e.sum())
        m = 0.9 * m + 0.1 * full
        v = 0.999 * v + 0.001 * full * full
        step = p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        bias -= float(step[-1])
    return (w / part)[same], bias


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """docs (doc_id, text) and labels (doc_id, label 0/1) -> model.

    Fitted on at most max_rows labelled rows, those whose ids hash lowest. Rows with null ids or labels are not used;
    several labels of one document count as 1 if at least half are; of documents that repeat an id the least text is read.
    Without usable rows the model scores everything 0.5 less one part in a million, so it rejects nothing."""
    p, spark = params, docs.sparkSession
    ids = (
        labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    )
    ids = durable(ids, "tox-ids")  # at most max_rows rows of two numbers, whatever the input
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = durable(sample, "tox-sample")
    if sample.isEmpty():
        return ToxicityModel(bias=-4e-6)
    found = (
        sample.mapInArrow(_words, "word string, k long").groupBy("word").agg(F.sum("k").alias("k"))
        .where(F.col("k") >= p.min_rows).select("word").toArrow()["word"].to_pylist()
    )
    words = sorted({*found, *(t for g in p.groups for t in g)})
    vocabulary = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # features of the bounded sample
    partner = {t: tuple(o for o in g if o != t) for g in p.groups for t in g}
    got = durable(sample.mapInArrow(_rows(vocabulary, partner), "kind int, doc_id long, a array<int>, b array<int>"), "tox-rows")
    rows = got.where("kind >= 0").select("doc_id", "a", "kind").orderBy("doc_id").toArrow()
    swaps = got.where("kind < 0").groupBy("a", "b").agg(F.count("*").alias("times")).orderBy("a", "b").toArrow()
    # terms the sample lacks are tied to their group by the bare swap
    number = vocabulary.value
    bare = [(number[g[0]], number[t]) for g in p.groups for t in g[1:]]
    lists = pa.list_(pa.int32())
    a, b = (Lists.of(pa.chunked_array([*swaps[c].chunks, pa.array([[x[i]] for x in bare], lists)], lists)) for i, c in enumerate("ab"))
    times = np.r_[swaps["times"].to_numpy(), np.ones(len(bare))]
    y, own = rows["kind"].to_numpy().astype(float), Lists.of(rows["a"])
    del found, rows, swaps
    w, bias = fit_weights(own, y, a, b, times, len(words), p)
    return ToxicityModel({t: float(x) for t, x in zip(words, w) if x}, bias)


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """Adds to each row, as column name (replaced if docs has it), the toxicity of its whole text, 0 to 1; null and empty
    texts get the score of no words."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of features that min_rows of max_rows rows have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value.scorer()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = pa.array([one(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)
