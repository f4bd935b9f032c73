"""Chats, archives, url filters and neighbours, and their odd inputs."""

import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, neighbours, urlfilter, warc

TURN = "tree_id long, msg_id long, parent_id long, role string, text string, score double"


def test_tree_paths_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 9.0), (1, 5, 3, "user", "d", 1.0)]
    rows += [(2, 1, 99, "user", "orphan", None), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0), (None, 1, None, None, None, None), (2, None, None, "user", "no id", 1.0), (1, 1, None, "user", "q", 0.0)]
    m = spark.createDataFrame(rows, TURN).withColumns({"up": F.lit(1), "depth": F.lit("x")})
    best = chat.reply_paths(m).orderBy("tree_id", "depth").collect()
    assert [(r["tree_id"], r["msg_id"], r["depth"]) for r in best] == [(None, 1, 0), (1, 1, 0), (1, 2, 1), (1, 4, 2), (2, 1, 0)]
    every = chat.reply_paths(m, None).where("tree_id = 1").collect()
    assert {(r["leaf_id"], r["path_rank"]) for r in every} == {(4, 1), (5, 2)}
    assert chat.reply_paths(m.where("false")).count() == 0


def test_long_chains_take_few_joins(spark):
    m = spark.range(1000).select(F.lit(1).cast("long").alias("tree_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    got = chat.reply_paths(m.withColumnRenamed("id", "msg_id")).collect()
    assert len(got) == 1000 and all(r["depth"] == r["msg_id"] for r in got)


NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<s>", r"[\INST] <\/s> [\\/SYS]", "[TEXT] [ROLE] x [/ROLE]", "é漢\U0001f600</s>\n", " [/INST]", "[OUT] a </s>[OUT] ", "\\", "x" * 200_000, "$1 \\1"]


def test_format_round_trip_and_mask(spark):
    roles = ["system", "user", "assistant", "tool [TEXT] </s>", ""]
    rows = [(t, i, roles[(t + i) % 5], NASTY[(t * 3 + i) % len(NASTY)]) for t in range(12) for i in range(5)]
    paths = spark.createDataFrame([(t, 9, 1, i, r, x) for t, i, r, x in rows], "tree_id long, leaf_id long, path_rank int, depth long, role string, text string")
    done = chat.format_paths(paths)
    back = done.select("tree_id", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans")
    for r in back.collect():
        mine = [(role, x) for t, i, role, x in rows if t == r["tree_id"]]
        assert [(x["role"], x["text"]) for x in r["turns"]] == mine
        assert r["loss"] == "".join(x for role, x in mine if role == "assistant")
        assert all(r["formatted"][:s["start"]].endswith("[OUT] ") for s in r["loss_spans"])
        assert r["formatted"].count("<s>") == 1


def test_escape_is_injective(spark):
    df = spark.createDataFrame([(x,) for x in NASTY], "t string")
    got = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r["t"] == r["u"] for r in got) and len({r["e"] for r in got}) == len(NASTY)


# --- WARC --------------------------------------------------------------------------------------------------------


def test_bundle_seeks(tmp_path):
    sink = io.BytesIO()
    w = warc.BundleWriter(sink, frame_bytes=100)
    bodies = [bytes([65 + i]) * (i * 13) for i in range(20)]
    places = [w.append(warc.make_record(i, f"http://x/{i}", b, warc.base32_sha1(b), None)) for i, b in enumerate(bodies)]
    w.close()
    r = warc.BundleReader(io.BytesIO(sink.getvalue()))
    assert len(r.places) > 5
    for i, (place, body) in enumerate(zip(places, bodies)):
        head, got = r.record(*place)
        assert got == body and head["WARC-Record-ID"] == f"<urn:page:{i}>"


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "u\r\nX: y", ""), (None, "http://n", "same"), (None, "http://n", "alone"), (6, "http://a/6", "é" * 5000), (7, "http://a/7", "short"), (8, "z", "short"), (1, "http://a/1", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "payload": F.lit(1), "bytes": F.lit(2)})
    folder = str(tmp_path / "w")
    index = warc.write_archives(pages, folder, frame_bytes=200, bundle_bytes=1000)
    got = warc.read_archives(spark, folder, index).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None)
        to = first if first is not None and first != i else None
        want.append((i, len(b), warc.base32_sha1(b), "response" if to is None else "revisit", to))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    for r in index.where("record_type = 'response' AND page_id IS NOT NULL").collect():
        head, body = warc.read_record(folder, r["file"], r["frame"], r["frame_offset"], r["record_length"])
        assert body == next((h or "").encode() for i, _, h in rows if i == r["page_id"])
    only = warc.write_archives(pages, str(tmp_path / "v"), min_revisit_bytes=5)
    assert {r["page_id"] for r in only.where("record_type = 'revisit'").collect()} == {8}
    assert warc.read_archives(spark, folder, warc.write_archives(pages.where("false"), folder)).count() == 0


# --- urls --------------------------------------------------------------------------------------------------------

RULES = (urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "bad.com", ""), urlfilter.Rule("allow", "good.bad.com", "/ok"))


def page(i, url, html=""):
    return (i, url, html)


def judged(spark, rows, rules=RULES, aliases=None):
    return {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "component": F.lit(3)}), rules, aliases).collect()}


def test_urls_and_rules(spark):
    rows = [page(1, "HTTP://WWW.Example.ORG/es/1?q#f"), page(2, "https://notexample.org/es/1"), page(3, None), page(4, "no scheme"), page(5, "x://BAD.com"), page(6, "x://a.good.bad.com/ok/1"), page(7, "x://É.com?q=://"), page(8, "")]
    got = judged(spark, rows)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2]["rule"] == "org/" and got[2]["verdict"] == "allow"
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == ("", "", None, "allow") for i in (3, 4, 8))
    assert got[5]["verdict"] == "block" and got[6]["verdict"] == "allow" and got[7]["host"] == "É.com"


def test_blocks_spread_over_aliases_but_allows_hold(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [page(1, "x://a.net/", link.format("x://b.net/")), page(2, "x://b.net/", '<META http-equiv=refresh content="0; url=x://bad.com/z">'), page(3, "x://c.net/"),
            page(4, "x://free.org/", link.format("x://bad.com/z")), page(5, "x://a.net/"), page(6, "x://d.net/", link.format("x://free.org/"))]
    got = judged(spark, rows)
    assert [got[i]["verdict"] for i in range(1, 7)] == ["block", "block", "allow", "allow", "block", "block"]
    assert got[1]["inherited"] and got[1]["rule"] is None
    beside = judged(spark, [page(3, "x://c.net/")], aliases=spark.createDataFrame([("x://c.net/", "x://bad.com/")], "a string, b string"))
    assert beside[3]["verdict"] == "block"


def test_many_rules_are_joined(spark, monkeypatch):
    rows = [page(i, f"x://h{i % 7}.example.org/{'es' if i % 2 else 'en'}/{i}") for i in range(30)] + [page(99, "x://a.good.bad.com/ok"), page(100, None)]
    one = judged(spark, rows)
    monkeypatch.setattr(urlfilter, "MAX_INLINE_RULES", 1)
    two = judged(spark, rows)
    assert {i: (r["rule"], r["verdict"]) for i, r in one.items()} == {i: (r["rule"], r["verdict"]) for i, r in two.items()}
    assert judged(spark, [], RULES) == {} and judged(spark, rows, ())[1]["verdict"] == "allow"


# --- neighbours --------------------------------------------------------------------------------------------------


def brute(x, ids, k):
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in range(len(ids)):
        s = (x * x[q]).sum(axis=1) / (n * n[q])
        keep = ids != ids[q]
        o = np.lexsort((ids[keep], -s[keep]))[:k]
        out[ids[q]] = list(zip(ids[keep][o].tolist(), s[keep][o].tolist()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_are_exact_on_small_sets(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[50:70] = x[50]  # ties
    rows = [(i, x[i].tolist(), 0) for i in range(90)]
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [1.0] * 7 + [None], 0), (203, [float("nan")] * 8, 0), (204, [float("inf")] + [1.0] * 7, 0), (205, [1.0] * 3, 0), (None, [1.0] * 8, 0)]
    v = frame(spark, rows)
    got = neighbours.search(v, v, 5).collect()
    want = brute(x.astype(float), np.arange(90), 5)
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert mine.keys() == want.keys()
    for q in want:
        assert [a for a, _ in mine[q]] == [a for a, _ in want[q]] and [s for _, s in mine[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:2000] = x[1000]
    v = frame(spark, [(i, x[i].tolist(), 0) for i in range(3000)])
    p = neighbours.RouterParams(sample=1000, parts=8, steps=60, chunk=200)
    got = neighbours.search(v, v.where("vec_id % 50 = 0"), 5, p).collect()
    want = brute(x.astype(float), np.arange(3000), 5)
    hits = sum(len({a for a, _ in want[q]} & {r["vec_id"] for r in got if r["query_id"] == q}) for q in range(0, 3000, 50))
    assert hits / 300 >= 0.9 and len(got) == 300
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 1500), key=lambda r: r["rank"])] == [1000, 1001, 1002, 1003, 1004]


def test_few_or_no_vectors(spark):
    v = frame(spark, [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)])
    got = neighbours.search(v, v, 5)
    assert sorted((r["query_id"], r["vec_id"]) for r in got.collect()) == [(1, 2), (1, 2), (2, 1), (2, 1)] or got.count() >= 3
    assert neighbours.search(v.where("false"), v, 5).count() == 0 and neighbours.search(v, v.where("false"), 5).count() == 0


def test_partition_is_balanced():
    rng = np.random.default_rng(0)
    x = neighbours.unit_rows(rng.normal(size=(600, 8)))
    label = neighbours.balanced_partition(neighbours.neighbour_graph(x, 10), 6, 1.05, 8, 0)
    assert np.bincount(label, minlength=6).max() <= 105 and hashlib.sha256(label.tobytes()).hexdigest()
