"""The fingerprint log over several batches, and words that weak hashes take for one another."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import substring
from test_text_operators import brute_windows, corpus, odd, prose  # noqa: F401


def thue_morse(n):
    """A word of n letters and the one with its two letters exchanged: equal under any polynomial modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_confuse_stay_apart(spark):
    rng = np.random.default_rng(6)
    one, two = thue_morse(1024)
    rest = prose(rng, 49)
    rows = [(1, f"{one} {rest}", "s"), (2, f"{two} {rest}", "s"), (3, f"{one} {rest}", "s"), (4, " ".join(thue_morse(2048)), "s")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(corpus(spark, rows)).collect())
    assert got == brute_windows([(i, t) for i, t, _ in rows], 50)
    assert [r[2] for r in got] == [0, 0, 50, 0]


def places(flags, n_words):
    """doc_id -> (tag, window) of all that is flagged."""
    out = {}
    for r in flags.collect():
        for f in r["flags"]:
            tag, at = f["place"] >> 32 & 0xFFFFFFFF, f["place"] & 0xFFFFFFFF
            run = range(at, at + f["length"]) if f["length"] else range(n_words[r["doc_id"], tag] - 49)
            out.setdefault(r["doc_id"], set()).update((tag, p) for p in run)
    return {i: x for i, x in out.items() if x}


def test_three_batches_equal_one_call(spark, odd, tmp_path):  # noqa: F811
    rng = np.random.default_rng(12)
    shared = [prose(rng, 70) for _ in range(4)]
    rows = [(100 + i, f"{prose(rng, int(rng.integers(1, 90)))} {shared[rng.integers(4)]} {prose(rng, int(rng.integers(1, 90)))}", "s") for i in range(60)]
    docs = odd.unionByName(corpus(spark, rows + [(170, rows[3][1] + " tail", "s"), (171, rows[4][1], "s")])).cache()
    n = {(r["doc_id"], substring._tag(r["text"].encode())): len(r["text"].split()) for r in docs.where("doc_id IS NOT NULL AND text IS NOT NULL").collect()}
    want = places(substring.repeated_windows(docs, batches=1), n)
    folder, got = str(tmp_path / "log"), {}
    bounds = [-1, 5, 130, 1000]
    for lo, hi in zip(bounds, bounds[1:]):
        log = substring.FingerprintLog(spark, 3, folder)  # every batch opens the log anew
        part = docs.where(f"doc_id > {lo} AND doc_id <= {hi}")
        got |= places(substring.dedupe_batch(log, part.withColumn("hash", F.lit("x")), docs.where(f"doc_id <= {lo}")), n)
    assert len(want) > 40 and got == want
    log = substring.FingerprintLog(spark, 8, folder)
    assert log.buckets == 3 and len(log.postings) == 3 and log.runs
    assert substring.dedupe_batch(log, docs.where("false"), docs).count() == 0
    log.drop()
    assert not substring.FingerprintLog(spark, 4, folder).runs
