"""The near-copy stage of the pipeline against exact similarities."""

import numpy as np

import corpus_pipeline
from tessera.llm import nearcopies
from test_text_operators import corpus, prose, words


def brute_sets(rows):
    out = {}
    for i, t, _ in rows:
        w = [x.lower() for x in words(t)]
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_gone(rows):
    sets = brute_sets(rows)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) != i}


def test_near_copies_of_similarity_0_8_go(spark, tiny):
    """Copies with words replaced up to and beyond the bound, of all sizes, chains of copies and short texts."""
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for size in (3, 6, 9, 14, 30, 47, 60, 90, 200, 700):
        for edits in range(5):
            text = prose(rng, size, 5000).split()
            for copy in range(4):
                rows.append((n, " ".join(text), "s"))
                n += 1
                if copy == 2:
                    text = text[: int(0.81 * len(text)) + 1]
                for at in rng.integers(len(text), size=max(1, edits * size // 180) if edits else 0):
                    text[at] = f"new{n}x{at}"
    rows += [(n, "", "s"), (n + 1, None, "s")]
    gone = brute_gone(rows)
    assert len(gone) > 50
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, corpus(spark, rows), tiny)
    assert {i for i, _, _ in rows} - {r["doc_id"] for r in out.collect()} == gone


def test_alike_sets_share_a_node():
    """At the bound, with as many masks as two hundred thousand and twenty million fingerprints get."""
    rng = np.random.default_rng(2)
    for n in (200_000, 20_000_000):
        table, salt = nearcopies.masks(n), np.zeros(2, dtype=np.uint64)
        met = near = 0
        for size in list(range(9, 60)) * 4 + [100, 300, 900] * 20:
            a = np.unique(rng.integers(1 << 63, size=size).astype(np.uint64))
            k = size // 9  # k of n replaced: similarity (n - k) / (n + k) of 0.8 or more
            b = np.unique(np.r_[rng.permutation(a)[k:], rng.integers(1 << 63, size=k).astype(np.uint64)])
            codes = np.stack([nearcopies.fingerprint(a), nearcopies.fingerprint(b)])
            near += np.bitwise_count(codes[0] ^ codes[1]).sum() <= nearcopies.LIMIT
            met += any(h[0] == h[1] for h in nearcopies.nodes(codes, table, salt))
        assert near == 264 and met >= 261


def test_clusters_of_several_blocks_and_split_nodes(spark, monkeypatch):
    """One original with many copies of it, of which some are too far off, through small nodes, blocks and batches."""
    rng = np.random.default_rng(5)
    base, rows = prose(rng, 120, 5000).split(), []
    for i in range(150):
        text = list(base)
        for at in rng.integers(len(text), size=int(rng.integers(7))):
            text[at] = f"new{i}x{at}"
        rows.append((i, " ".join(text), "s"))
    rows += [(200 + i, prose(rng, 120, 5000), "s") for i in range(150)]
    want = brute_gone(rows)
    assert 50 < len(want) < 149
    for name, small in (("BLOCK_SETS", 9), ("TOGETHER", 20), ("NODE", 16)):
        monkeypatch.setattr(nearcopies, name, small)
    for node, limit in ((16, 40), (128, 100_000)):
        got = nearcopies.components(corpus(spark, rows), node=node, node_limit=limit).collect()
        assert {r["doc_id"] for r in got if r["doc_id"] != r["component_id"]} == want


def test_rows_of_the_stage_stay_whole(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text, "s"), (1, text, "s"), (2, text.upper(), "s"), (2, "other words", "s"), (3, None, "s")]
    out = nearcopies.representatives(corpus(spark, rows))
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 3, None]
    assert nearcopies.representatives(corpus(spark, rows).where("false")).count() == 0
