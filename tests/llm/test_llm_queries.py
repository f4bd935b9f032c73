"""The registered queries against their SQL, and the pipeline against plain Python stages."""

import pytest

import corpus_pipeline
from helpers import duck, spark_rows, sql_rows
from tessera.llm import toxicity
from tessera.llm.queries import ORACLE, QUERIES
from test_text_operators import brute_components, brute_fingerprint, brute_windows, words


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, tiny, name):
    assert spark_rows(QUERIES[name](spark, tiny)) == sql_rows(duck(tiny), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_held_out_accuracy(spark, tiny):
    d = tiny.replace("sf0.001", "sf0.1")
    got = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, d).where("held_out").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["doc_id"] in got]
    right = sum(got[i]["predicted"] == y for i, y in labels) / len(labels)
    assert right >= 0.97
    assert sum(got[i]["predicted"] for i, y in labels if y == 0) <= 0.01 * len(labels)


def test_pipeline_matches_plain_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "decontamination", "mixing"]
    out = stages["toxicity"](spark, docs, tiny)
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = toxicity.train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").selectExpr("doc_id", "toxic AS label")).scorer()
    kept = {i: t for i, t in rows.items() if model(t) < 0.5}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(kept)
    out = stages["simhash"](spark, out, tiny)
    ids = sorted(kept)
    root = brute_components([brute_fingerprint(kept[i]) for i in ids], 3)
    kept = {i: kept[i] for i, r in zip(ids, root) if ids[r] == i}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(kept)
    out = stages["substring"](spark, out, tiny)
    n_removed = {i: k for i, _, k, _ in brute_windows(sorted(kept.items()), 50)}
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and set(got) == set(kept)
    for i, t in kept.items():
        assert len(words(got[i]["text"])) == len(words(t)) - n_removed[i] and got[i]["n_chars"] == len(got[i]["text"])
        assert n_removed[i] or got[i]["text"] == t
    items = [words(r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    leaks = {i for i in got if any(len(grams(b) & grams(words(got[i]["text"]))) >= 0.8 * len(grams(b)) for b in items)}
    out = stages["decontamination"](spark, out, tiny)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(got) - leaks
    last = stages["mixing"](spark, out, tiny).collect()
    assert all(1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * len(words(r["text"])) for r in last)


def test_stages_take_odd_documents(spark, tiny):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, None), (2, "word " * 300, None, None, 5, "y"), (3, "word " * 300, "en", "a", None, "y"), (3, "other", "en", "a", 1, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, flags string",
    )
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, tiny)
            assert df.columns[:6] == docs.columns
        df.collect()


def test_runs_whole(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 50
