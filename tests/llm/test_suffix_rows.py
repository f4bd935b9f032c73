"""Suffix arrays on texts of a corpus, very long texts, and anchors that occur often."""

import numpy as np
import pytest

from tessera.llm import suffix
from test_text_operators import brute_strings, corpus, odd, prose  # noqa: F401


def test_corpus_text_is_sorted_by_recursion(spark, tiny):
    texts = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect()]
    flat = np.frombuffer("\n".join(texts).encode()[:60_000], dtype=np.uint8)
    s = np.append(flat.astype(np.uint16) + 1, 0).astype(np.uint16)
    levels = []
    sa = suffix.suffix_array(s, levels)
    assert len(levels) > 2 and levels[1] > 10_000 and all(2 * b <= a + 1 for a, b in zip(levels, levels[1:]))
    data = s.astype(">u2").tobytes()
    ranked = [data[2 * i : 2 * i + 4000] for i in sa.tolist()]
    assert sorted(sa.tolist()) == list(range(len(s))) and all(a <= b for a, b in zip(ranked, ranked[1:]))


@pytest.mark.parametrize("hot", [50_000, 3])
def test_long_texts_and_frequent_passages(spark, odd, hot):  # noqa: F811
    rng = np.random.default_rng(9)
    passage, line = prose(rng, 40), "a line that many texts have, with little else around it"
    rows = [(200 + i, f"{prose(rng, int(rng.integers(1, 40)))} {passage if i % 3 else line} {prose(rng, int(rng.integers(1, 40)))}", "s") for i in range(60)]
    rows += [(300, f"{passage} {prose(rng, 20000)} {passage} {line}", "s"), (301, "ab" * 30_000, "s")]
    docs = odd.unionByName(corpus(spark, rows))
    got = suffix.remove_repeats(docs, hot=hot).collect()
    mine = sorted(((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got), key=str)
    assert mine == brute_strings([(r["doc_id"], r["text"]) for r in docs.collect()], 100)
