"""URL filters with redirect equivalence; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import durable
from .components import connected_components

#: Most rules that are compiled into one expression; longer lists are joined by host.
MAX_INLINE_RULES = 200


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _tail(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(_tail(url), r"(?s)\A([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_tail(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, r: Rule) -> Column:
    return ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))


def longest_rule(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds rule and rule_verdict of the longest fitting rule to rows with host and path, else nulls.

    Equal lengths: the longer host first, then allow before block. Up to MAX_INLINE_RULES rules become one CASE that
    stays in generated code; more are joined on the host and all its parent domains, and
    reduced before any row is widened."""
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict))
    if len(rules) <= MAX_INLINE_RULES:
        pick = reduce(
            lambda c, r: c.when(_fits(F.col("host"), F.col("path"), r), F.struct(F.lit(r.text).alias("t"), F.lit(r.verdict).alias("v"))),
            ordered[1:],
            F.when(_fits(F.col("host"), F.col("path"), ordered[0]), F.struct(F.lit(ordered[0].text).alias("t"), F.lit(ordered[0].verdict).alias("v"))),
        )
        return df.withColumn("_pick", pick).withColumns({"rule": F.col("_pick.t"), "rule_verdict": F.col("_pick.v")}).drop("_pick")
    spark = df.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict, n) for n, r in enumerate(ordered)], "rh string, rp string, t string, v string, n int")
    places = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    # the parents of a host that can have a rule: those of as many labels as some rule's host
    depths = F.array(*(F.lit(n) for n in sorted({r.host.count(".") + 1 for r in rules})))
    parents = F.transform(
        F.filter(depths, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )
    best = (
        places.withColumn("rh", F.explode(parents)).join(table, "rh").where(F.startswith("path", "rp"))
        .groupBy("host", "path").agg(F.min(F.struct("n", "t", "v")).alias("m"))
        .select("host", "path", F.col("m.t").alias("rule"), F.col("m.v").alias("rule_verdict"))
    )
    return df.join(best, ["host", "path"], "left")


def resolve(base: Column, ref: Column) -> Column:
    """ref as an absolute url, read from the page at base; null where base has no ://. Dot segments are taken out."""
    part = lambda pattern: F.regexp_extract(base, pattern, 0)
    scheme, site = part(r"(?s)\A[^:/?#]*:"), part(r"(?s)\A[^:/?#]*://[^/?#]*")
    page, query = part(r"(?s)\A[^:/?#]*://[^/?#]*[^?#]*"), part(r"(?s)\A[^#]*")
    folder = F.regexp_extract(page, r"(?s)\A([^:/?#]*://[^/?#]*/(?:.*/)?)", 1)
    folder = F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder)
    whole = (
        F.when(ref.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(site, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(page, ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(query, ref))
        .otherwise(F.concat(folder, ref))
    )
    start = F.regexp_extract(whole, r"(?s)\A[^:/?#]*://[^/?#]*", 0)
    rest = F.substring(whole, F.length(start) + 1, F.length(whole))
    path = F.regexp_extract(rest, r"(?s)\A[^?#]*", 0)
    steps = F.split(path, "/")
    # a stack of the steps: .. takes the last one away, a dot step at the end leaves a slash
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda k, x: F.when(x == ".", k).when(x == "..", F.when(F.size(k) > 1, F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0)))).otherwise(k)).otherwise(F.concat(k, F.array(x))),
    )
    clean = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"(?s)/\.\.?\z"), "/").otherwise(""))
    dots = path.rlike(r"(?s)/\.\.?(/|\z)")
    out = F.when(dots, F.concat(start, clean, F.substring(rest, F.length(path) + 1, F.length(rest)))).otherwise(whole)
    return F.when((site != "") & (ref != "") & (start != ""), out)


# Character references of html that occur in urls; & itself last, so that nothing is read twice.
REFERENCES = (
    (r"(?i)&(?:lt|#0*60|#x0*3c);", "<"), (r"(?i)&(?:gt|#0*62|#x0*3e);", ">"), (r"(?i)&(?:quot|#0*34|#x0*22);", '"'),
    (r"(?i)&(?:apos|#0*39|#x0*27);", "'"), (r"(?i)&(?:sol|#0*47|#x0*2f);", "/"), (r"(?i)&(?:colon|#0*58|#x0*3a);", ":"),
    (r"(?i)&(?:amp|#0*38|#x0*26);", "&"),
)


def unescape_html(s: Column) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), REFERENCES, s)


def page_aliases(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between a page's url and what it says stands for it: all canonical links and refreshes of its html,
    relative ones read from the page's url, character references resolved. Absolute targets count for any url."""
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    links = tags(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>")
    metas = tags(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>")
    href = F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    to = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = pages.where("url IS NOT NULL AND html IS NOT NULL").select(F.col("url").alias("a"), F.explode(F.concat(href, to)).alias("r"))
    found = found.withColumn("r", unescape_html(F.col("r")))
    absolute = F.when(F.col("r").rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), F.col("r"))
    found = found.where("r <> ''").select("a", F.coalesce(resolve(F.col("a"), F.col("r")), absolute).alias("b"))
    return found.where(F.col("b").isNotNull() & (F.col("a") != F.col("b")))


def judge(pages: DataFrame, rules: Sequence[Rule], aliases: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, host, path, rule, verdict, inherited.

    A url that a rule fits has that rule's verdict: an explicit allow holds whatever its aliases are. Any other url is
    blocked if a url of its component over redirects and canonical links (those in the html, and aliases (a, b) given
    beside) is blocked by a rule, else allowed; inherited tells so. Null urls fit no rule, have no alias and are
    allowed. Repeated rows are judged alike and kept."""
    edges = page_aliases(pages)
    if aliases is not None:
        edges = edges.unionByName(aliases.select("a", "b"))
    comps = connected_components(edges)
    named = comps.select(F.col("id").alias("url"), "component").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    bad = longest_rule(named, rules).where("rule_verdict = 'block'").select("component").distinct()
    hit = durable(comps.join(bad, "component", "left_semi").select(F.col("id").alias("url"), F.lit(True).alias("inherited")), "url-blocked")
    out = pages.select("page_id", "url").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    out = longest_rule(out, rules).join(hit, "url", "left")
    inherited = F.col("rule").isNull() & F.coalesce("inherited", F.lit(False))
    verdict = F.coalesce("rule_verdict", F.when(inherited, "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), inherited.alias("inherited"))
