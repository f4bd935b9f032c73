"""Records that a strict reader takes, and a reader task for every bundle."""

import re

from tessera.llm import warc

FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Type", "Content-Length")


def test_records_are_strict(spark, tmp_path):
    rows = [(1, "http://a/1 x", "same"), (2, "http://a/2", "same"), (1, "http://a/1 x", "same"), (None, None, "same"), (3, None, None), (3, "", "é\r\n\r\n")]
    rows += [(10 + i, f"http://b/{i}", f"page {i} " * 40) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    index = warc.write_archives(pages.repartition(3), folder, frame_bytes=300, bundle_bytes=1500, date="2024-05-01T12:00:00Z")
    ids, by_page = [], {}
    for r in index.collect():
        head, body = warc.read_record(folder, r["file"], r["frame"], r["frame_offset"], r["record_length"])
        assert all(head.get(f) for f in FIELDS) and head["WARC-Date"] == "2024-05-01T12:00:00Z"
        assert re.fullmatch(r"<[a-z]+:\S+>", head["WARC-Record-ID"]) and re.fullmatch(r"[a-z]+:\S+", head["WARC-Target-URI"])
        assert head["Content-Type"] == "application/http;msgtype=response" and re.fullmatch(r"sha1:[A-Z2-7]{32}", head["WARC-Payload-Digest"])
        ids.append(head["WARC-Record-ID"])
        by_page.setdefault(r["page_id"], []).append((head["WARC-Type"], body.decode(), head.get("WARC-Refers-To-Target-URI")))
    assert len(set(ids)) == len(rows)
    assert by_page[2] == [("revisit", "", "http://a/1%20x")] and by_page[1] == [("response", "same", None)] * 2
    assert sorted(by_page[3]) == [("response", "", None), ("response", "é\r\n\r\n", None)]
    bundles = index.select("file").distinct().count()
    read = warc.read_archives(spark, folder, index)
    assert bundles > 3 and read.rdd.getNumPartitions() == bundles and read.count() == len(rows)
