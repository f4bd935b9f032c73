"""Operators on texts against brute force, and their odd inputs."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, simhash, substring, suffix, toxicity
from tessera.llm.common import n_words
from tessera.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, ids that repeat with another text, near and whole copies."""
    rng = np.random.default_rng(3)
    a, b = prose(rng, 400), prose(rng, 120)
    rows = [(1, a, "s1"), (2, a, "s1"), (3, a + " tail", None), (4, prose(rng, 30) + " " + b, "s2"), (5, b + " " + prose(rng, 9), "s2"), (5, b + " " + prose(rng, 9), "s2"),
            (6, None, "s3"), (7, "", "s3"), (8, " \t\n\x0b ", "s3"), (None, a, None), (None, None, None), (9, "x " * 3000, "s1"), (10, "x " * 3000, "s1"),
            (11, prose(rng, 20000), "s4"), (12, "é\u00a0ß 漢字 " * 60, "s2"), (13, "é\u00a0ß 漢字 " * 60 + "end", "s2"), (14, b, "s2"), (14, prose(rng, 70), "s2"), (15, "one", "s5")]
    return corpus(spark, rows).cache()


EMPTY = [("empty", [])]


def words(t):
    return WORD.findall(t or "")


def test_word_counts_agree(odd):
    for r in odd.select("text", n_words(F.col("text")).alias("n")).collect():
        assert r["n"] == len(words(r["text"])) == len((r["text"] or "").encode().split())


# --- SimHash -----------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(codes, limit):
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= limit:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def test_fingerprints(odd):
    got = simhash.fingerprints(odd).join(odd.select("doc_id", "text"), "doc_id").where("doc_id NOT IN (5, 14)").collect()
    for r in got:
        assert r["fp"] & (1 << 64) - 1 == brute_fingerprint(r["text"])
    assert brute_fingerprint("A b C") == brute_fingerprint("a B c")


def test_components_follow_chains_and_nulls(spark):
    rng = np.random.default_rng(0)
    codes = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for k in range(60):  # chains of two-bit steps
        codes.append(codes[rng.integers(len(codes))] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    ids = [int(x) for x in rng.permutation(1000)[: len(codes)]]
    ids[3] = None
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(zip(ids, signed)) + [(ids[5], signed[5])], "doc_id long, fp long")
    root = brute_components(codes, 3)
    want = {}
    for i, r in zip(ids, root):
        want.setdefault(r, []).append(i)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in want.items()}
    for node_limit in (100_000, 3):
        got = simhash.components(df, 3, node_limit).collect()
        assert len(got) == len(codes) + 1
        by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
        assert all(by[(i, s)] == least[r] for i, s, r in zip(ids, signed, root))


def test_dense_groups_are_linked_whole():
    codes = np.array([b << 5 for b in range(8)] + [(1 << 40) | b for b in range(256)], dtype=np.uint64)
    root = simhash.GrayIndex(np.zeros(len(codes), dtype=np.int64), codes).link(3)
    assert len(set(root.tolist())) == len(set(brute_components([int(c) for c in simhash.GrayIndex(np.zeros(len(codes), dtype=np.int64), codes).codes], 3)))


def test_gray_rank_inverts_gray_code():
    n = np.arange(5000, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(n ^ (n >> np.uint64(1))), n)


def test_representatives(spark, odd):
    clash = odd.withColumns({"fp": F.lit(1), "component_id": F.lit(2)})
    got = simhash.representatives(clash)
    assert got.columns == clash.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert 1 in ids and 2 not in ids and ids.count(None) == 2 and 9 in ids and 10 not in ids
    assert simhash.representatives(odd.where("false")).count() == 0


# --- substring dedup ---------------------------------------------------------------------------------------------


def brute_windows(rows, size):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for s in range(len(w) - size + 1):
                k = tuple(w[s : s + size])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if i is not None and first[tuple(w[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, local", [(1, 1 << 20), (4, 7)])
def test_substring_matches_brute_force(odd, monkeypatch, batches, local):
    monkeypatch.setattr(substring, "LOCAL", local)
    clash = odd.withColumns({"flags": F.lit("f"), "n_words": F.lit("n"), "hash": F.lit(1), "place": F.lit(2)})
    got = substring.remove_repeats(clash, batches=batches)
    rows = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str)
    assert rows == brute_windows([(r["doc_id"], r["text"]) for r in odd.collect()], 50)
    assert all(r["kept_text"] == (r["text"] or "") for r in got.where("n_removed = 0").collect())
    assert substring.remove_repeats(odd.where("false")).count() == 0


def test_incremental_log_gives_what_one_batch_gives(spark):
    feed = spark.createDataFrame([(h, d) for d in range(40) for h in {d % 7, 100 + d, d // 2 + 1000}], "hash long, doc_id long")
    log = substring.FingerprintLog(spark, 4)
    found = set()
    for lo in range(0, 40, 10):
        found |= {r["hash"] for r in log.ingest(feed.where(f"doc_id >= {lo} AND doc_id < {lo + 10}")).collect()}
        sizes = [n for _, _, n in log.runs]
        assert all(a >= substring.TIER * b for a, b in zip(sizes, sizes[1:]))
    log.drop()
    assert found == {h for h in range(7)} | {1000 + k for k in range(20)}


# --- suffix arrays -----------------------------------------------------------------------------------------------


def brute_strings(rows, size):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    first = {}
    for i, t in order:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            k = b[s : s + size]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - size + 1):
            if i is not None and first[b[s : s + size]] < (i, s):
                gone[s : s + size] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, shard, local", [(50_000, 6 << 20, 32 << 20), (2, 2000, 500)])
def test_suffix_matches_brute_force(odd, monkeypatch, hot, shard, local):
    monkeypatch.setattr(suffix, "LOCAL", local)
    part = odd.where("doc_id IS NULL OR doc_id <> 11").withColumns({"flags": F.lit(1), "spans": F.lit(2)})
    got = suffix.remove_repeats(part, hot=hot, shard=shard)
    rows = sorted(((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got.collect()), key=str)
    assert rows == brute_strings([(r["doc_id"], r["text"]) for r in part.collect()], 100)
    assert suffix.remove_repeats(odd.where("false")).count() == 0


@pytest.mark.parametrize("per_bucket", [0, 1, 10**9])
def test_induced_sorting(per_bucket):
    rng = np.random.default_rng(8)
    for _ in range(150):
        n, a = int(rng.integers(1, 50)), int(rng.choice([1, 2, 3, 20]))
        s = np.append(rng.integers(1, a + 1, n), 0).astype(np.uint8)
        sa = suffix.suffix_array(s, None, per_bucket)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        plcp = suffix.permuted_prefixes(s, sa, np.array([0]), 1000)
        for x, y in zip(sa[:-1].tolist(), sa[1:].tolist()):
            k = 0
            while max(x, y) + k <= n and s[x + k] == s[y + k]:
                k += 1
            assert plcp[y] == k


# --- decontamination ---------------------------------------------------------------------------------------------

ITEMS = [(1, "A train leaves Boston at 9 and travels 120 km in 2 hours. How fast does the train go on its way to Denver?"),
         (2, "The quick brown fox jumps over the lazy dog while seven tired sailors watch from the old wooden pier."), (3, "too short"), (4, None)]


def test_decontamination(spark):
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    exact = "noise here. " + ITEMS[1][1] + " more noise"
    changed = "So: A train leaves Paris at 7 and travels 350 km in 5 hours. How fast does the train go on its way to Lyon? Yes."
    torn = "A train leaves Boston at 9 and travels 120 km in 2 hours."
    rng = np.random.default_rng(0)
    d = corpus(spark, [(1, exact, "s"), (2, changed, "s"), (3, torn, "s"), (4, prose(rng, 500), "s"), (5, None, "s"), (6, "", "s"), (None, exact, "s"), (7, exact, "s"), (7, exact, "s")])
    got = sorted((r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.contaminated(d.withColumn("hash", F.lit(1)), b).collect())
    assert got == [(1, 2, False), (2, 1, True), (7, 2, False)]
    kept = [r["doc_id"] for r in decontaminate.clean(d, b).collect()]
    assert sorted(kept, key=str) == [3, 4, 5, 6, None]
    assert decontaminate.contaminated(d, b.where("false")).count() == 0 and decontaminate.contaminated(d.where("false"), b).count() == 0


def test_slots_must_be_consistent(spark):
    item = "If Anna gives 5 pens to Peter then Peter has 5 pens more than Anna had when they met at school that day."
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    fine = item.replace("Peter", "Oscar").replace("5", "8")
    broken = "If Anna gives 5 pens to Peter then Simon has 7 pens more than Clara had when they met at school that day."
    got = [r["doc_id"] for r in decontaminate.contaminated(corpus(spark, [(1, fine, "s"), (2, broken, "s")]), b).collect()]
    assert got == [1]


def test_a_large_benchmark_is_joined_without_a_broadcast(spark, monkeypatch):
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = corpus(spark, [(1, ITEMS[1][1], "s"), (2, "nothing of it at all is in here", "s")])
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert [r["doc_id"] for r in decontaminate.contaminated(d, b).collect()] == [1]


# --- toxicity ----------------------------------------------------------------------------------------------------


def toxic_set(spark, n=300):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(rng, 40)
        if bad:
            text += " you idiot. " + ("the muslim man is an idiot. " if i % 8 == 0 else "")
        rows.append((i, text, "s"))
        labels.append((i, int(bad)))
    return corpus(spark, rows), spark.createDataFrame(labels, "doc_id long, label int")


def test_toxicity_separates_and_is_fair(spark):
    docs, labels = toxic_set(spark)
    model = toxicity.train(docs, labels, toxicity.ToxicityParams(steps=200))
    one = model.scorer()
    assert one("what an idiot") > 0.5 > one("a w3 w7 walk")
    gap = abs(one("muslim people live here") - one("christian people live here"))
    plain = toxicity.train(docs, labels, toxicity.ToxicityParams(steps=200, counterfactual=0.0)).scorer()
    assert gap < abs(plain("muslim people live here") - plain("christian people live here")) and gap < 0.02
    again = toxicity.train(docs, labels, toxicity.ToxicityParams(steps=200)).scorer()
    assert again("what an idiot") == one("what an idiot")


def test_toxicity_odd_inputs(spark, odd):
    docs, labels = toxic_set(spark, 40)
    model = toxicity.train(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 0)], "doc_id long, label int")), toxicity.ToxicityParams(steps=20))
    got = toxicity.score(odd.withColumn("score", F.lit("x")), model)
    assert got.count() == odd.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.train(docs, labels.where("false")).scorer()("idiot") < 0.5
    assert toxicity.score(odd.where("false"), model).count() == 0


# --- mixing ------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights):
    cap, done = {k: 3 * v for k, v in sizes.items()}, {}
    total = sum(sizes.values())
    while True:
        rest, w = total - sum(done.values()), sum(weights[k] for k in sizes if k not in done)
        over = [k for k in sizes if k not in done and rest * weights[k] / w > cap[k]]
        if not over:
            return {k: done[k] if k in done else rest * weights[k] / w for k in sizes}
        done |= {k: cap[k] for k in over}


def test_mixing_targets_and_takes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(1, 40))), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d"], 800, p=[0.02, 0.05, 0.08, 0.85]))]
    rows += [(900 + i, prose(rng, 10), None) for i in range(30)] + [(None, "a b c", "a"), (950, None, "e"), (951, "", "e"), (3, rows[3][1], str(rows[3][2]))]
    docs = corpus(spark, [(i, t, None if s is None else str(s)) for i, t, s in rows]).withColumns({"p": F.lit(9.0), "rest": F.lit("r"), "size": F.lit("old")})
    got = mixing.mix(docs).cache()
    assert got.count() == docs.count() and {r["p"] for r in got.collect()} == {9.0}
    per = {r["source"]: r for r in got.groupBy("source").agg(F.sum("size").alias("s"), F.max("source_size").alias("z"), F.max("target").alias("t"), F.sum("taken").alias("k")).collect()}
    sizes = {k: r["s"] for k, r in per.items()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    want = brute_targets(sizes, {k: i % 3 + 1 for i, k in enumerate(order)})
    for k, r in per.items():
        assert r["z"] == r["s"] and r["t"] == pytest.approx(want[k], rel=1e-9)
        assert abs(r["k"] - r["t"]) <= 40
    assert got.where("taken > 3 * size").count() == 0
    a = sorted(tuple(r) for r in got.select(F.coalesce("doc_id", F.lit(-1)), "taken").collect())
    assert a == sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).select(F.coalesce("doc_id", F.lit(-1)), "taken").collect())
    assert mixing.mix(docs.where("false")).count() == 0


def test_ties_and_one_source(spark):
    docs = corpus(spark, [(i, "a b", "s") for i in range(10)])
    assert mixing.mix(docs).agg(F.sum("taken")).first()[0] == 20


# --- components --------------------------------------------------------------------------------------------------


def test_connected_components(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1001 + i) for i in range(300)]
    odd = [(None, 5000), (7000, 7000), (2000, 2001), (2001, 2000), (2000, 2001)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(path + star + odd, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1001 + i] == 1000 for i in range(300)) and got[2001] == 2000 and 7000 not in got and 5000 not in got
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
