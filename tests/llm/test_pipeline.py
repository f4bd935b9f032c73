"""The stages of the pipeline one after the other, each against brute force on what the one before it kept."""

import corpus_pipeline
from tessera.llm import toxicity
from test_near_copies import brute_gone
from test_text_operators import brute_windows, words


def test_stages_match_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    out = stages["toxicity"](spark, docs, tiny).cache()
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    seen = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").selectExpr("doc_id", "toxic AS label")
    model = toxicity.train(docs, seen).scorer()
    kept = {i: t for i, t in kept.items() if model(t) < 0.5}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(kept)
    out = stages["simhash"](spark, out, tiny).cache()
    gone = brute_gone([(i, t, None) for i, t in kept.items()])
    kept = {i: t for i, t in kept.items() if i not in gone}
    assert gone and out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(kept)
    out = stages["substring"](spark, out, tiny).cache()
    n_removed = {i: k for i, _, k, _ in brute_windows(sorted(kept.items()), 50)}
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and set(got) == set(kept)
    for i, t in kept.items():
        assert len(words(got[i]["text"])) == len(words(t)) - n_removed[i] and got[i]["n_chars"] == len(got[i]["text"])
        assert n_removed[i] or got[i]["text"] == t
    items = [words(r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    held = {i: grams(words(r["text"])) for i, r in got.items()}
    leaks = {i for i in got if any(len(grams(b) & held[i]) >= 0.8 * len(grams(b)) for b in items)}
    out = stages["decontamination"](spark, out, tiny).cache()
    assert leaks and out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(got) - leaks
    last = stages["mixing"](spark, out, tiny).collect()
    assert last and all(1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * len(words(r["text"])) for r in last)
