"""Relative and repeated canonical links and refreshes."""

import pytest

from test_other_operators import judged, page
from tessera.llm import urlfilter

RULES = (urlfilter.Rule("block", "site.com", "/de/"), urlfilter.Rule("block", "bad.org", ""))


@pytest.mark.parametrize("ref", ["/de/1", "//bad.org/x", "../de/1", "../../../de/1", "/a/./../de/1?q=/../", "HTTP://BAD.org/"])
def test_targets_are_resolved(spark, ref):
    rows = [page(1, "http://site.com/fr/2?x=/y", f'<link rel=canonical href="{ref}">'), page(2, "http://site.com/fr/3", f'<meta http-equiv="refresh" content="0; url={ref}">'), page(3, "http://site.com/fr/4")]
    got = judged(spark, rows, RULES)
    assert [got[i]["verdict"] for i in (1, 2, 3)] == ["block", "block", "allow"]


def test_all_tags_count_and_urls_match(spark):
    links = '<link rel=canonical href="2"><link rel="canonical" href="//bad.org/x">'
    got = judged(spark, [page(1, "http://site.com/fr/1", links), page(2, "http://site.com/fr/2"), page(3, "http://site.com", '<link rel=canonical href="fr/2?a=1#b">'), page(4, "http://site.com/fr/2?a=1#b")], RULES)
    assert [got[i]["verdict"] for i in range(1, 5)] == ["block", "block", "allow", "allow"]
    assert [r["b"] for r in urlfilter.page_aliases(spark.createDataFrame([(3, "http://site.com", '<link rel=canonical href="fr/2?a=1#b">')], "page_id long, url string, html string")).collect()] == ["http://site.com/fr/2?a=1#b"]


def test_hosts_of_many_labels_keep_their_parents(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_INLINE_RULES", 1)
    got = judged(spark, [page(1, "x://" + "a." * 200 + "bad.org/"), page(2, "x://" + "a." * 200 + "good.org/")], RULES)
    assert [got[i]["verdict"] for i in (1, 2)] == ["block", "allow"]


def test_the_number_of_rules_changes_nothing(spark):
    host = ".".join(f"h{i}" for i in range(129)) + ".com"
    rows = [page(1, f"x://{host}/de/1"), page(2, "x://a.b.net/z"), page(3, "x://com/de/2"), page(4, "x://example.org/es/1"), page(5, "x://localhost/de/")]
    few = (urlfilter.Rule("block", "com", "/"), urlfilter.Rule("allow", "com", "/de/2"), urlfilter.Rule("block", "b.net", ""), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "h1.com", "/"))
    many = few + tuple(urlfilter.Rule("block", f"x{i}.y.z{i}.info", "/") for i in range(246))
    one, two = judged(spark, rows, few), judged(spark, rows, many)
    assert {i: (r["rule"], r["verdict"]) for i, r in one.items()} == {i: (r["rule"], r["verdict"]) for i, r in two.items()}
    assert one[1]["verdict"] == "block" and one[1]["rule"] == "com/" and one[3]["verdict"] == "allow"


def test_references_of_links_are_resolved(spark):
    rows = [page(1, "x://a.net/", '<link rel=canonical href="x:&#47;&#x2F;bad.com/?a=1&amp;b=2">'), page(2, "x://c.net/", '<link rel="canonical" href="x://d.net/?q=1&amp;amp;r">')]
    assert judged(spark, rows)[1]["verdict"] == "block"
    edges = urlfilter.page_aliases(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["b"] for r in edges} == {"x://bad.com/?a=1&b=2", "x://d.net/?q=1&amp;r"}
