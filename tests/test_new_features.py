"""Audit store, sitemap files, exact and sketched quantiles, keyword clusters, element table and AMP rules."""

import collections
import random
import statistics
from datetime import datetime

import numpy as np
import pytest
from conftest import SMALL

from crawlsight.functions.elements import elements
from crawlsight.operators import amp, performance
from crawlsight.operators.tables import site
from crawlsight.plans import health, keywords, quantiles
from crawlsight.plans.clusters import _greedy, clusters, leaders_of
from crawlsight.sources import context, files, sitemaps
from crawlsight.sources.audits import AuditStore
from crawlsight.sources.pages import crawl_table

# --- audit store --------------------------------------------------------------------------


def page(url, words, **more):
    return {"url": url, "html": f"<title>{words}</title><p>{words}</p>", "status": "200", "crawl_status": "Success", "cache_control": "", **more}


def test_store_parses_only_what_is_new(spark, tmp_path):
    store = AuditStore(spark, f"file://{tmp_path}/audits")
    assert store.versions() == [] and store.history().count() == 0
    frame = lambda rows: spark.createDataFrame(rows, "url string, html string, status string, crawl_status string, cache_control string, crawl_time_s double")
    rows = lambda pages: [(p["url"], p["html"], p["status"], p["crawl_status"], p["cache_control"], p.get("crawl_time_s", 0.1)) for p in pages]
    one = [page("a", "one"), page("b", "two"), page("c", "three"), page("d", "four")]
    two = [page("a", "one", crawl_time_s=9.0), page("b", "two", cache_control="no-store"), page("c", "3 words now"), page("e", "five")]
    where = context.site_context(spark, "https://s.example/", "User-agent: *")
    assert store.add(frame(rows(one)), where) == 1 and store.add(frame(rows(two))) == 2 and store.add(frame(rows(two))) == 3
    assert {r.url: r.change for r in store.changes(1, 2).collect()} == {"a": "same", "b": "changed", "c": "changed", "d": "gone", "e": "added"}
    assert {r.url: r.parsed_in for r in store.index(3).collect()} == {"a": 1, "b": 2, "c": 2, "e": 2}
    assert [spark.read.parquet(f"file://{tmp_path}/audits/parsed/version={v}").count() for v in (1, 2, 3)] == [4, 3, 0]
    columns = [c for c in crawl_table(frame(rows(two))).columns if c not in ("h", "crawl_time_s")]
    want = crawl_table(frame(rows(two))).select(columns).toPandas().sort_values("url").to_dict("records")
    for version in (2, 3):
        assert store.crawl(version).select(columns).toPandas().sort_values("url").to_dict("records") == want
    assert store.site(1).context.first().robots_txt == "User-agent: *" and store.site(2).context.first().robots_txt is None
    for version, score in ((1, 50), (2, 60)):
        store.record(version, "s", score, datetime(2024, 1, version))
    assert sorted((r.audit_ts.day, r.change) for r in health.trend(store.history()).collect()) == [(1, None), (2, 10)]
    with pytest.raises(ValueError):
        store.changes(1, 9)


def test_store_without_pages_and_after_a_lost_attempt(spark, tmp_path):
    store = AuditStore(spark, f"file://{tmp_path}/audits")
    none = spark.createDataFrame([], "url string, html string")
    assert store.add(none) == 1 and store.crawl(1).count() == 0
    # An attempt that died before its index was written leaves no version, and its folders are overwritten.
    spark.range(3).write.parquet(f"file://{tmp_path}/audits/parsed/version=2")
    assert store.versions() == [1]
    assert store.add(spark.createDataFrame([("a", "<p>x</p>")], "url string, html string")) == 2
    assert store.crawl(2).count() == 1 and {r.change for r in store.changes(1, 2).collect()} == {"added"}


# --- sitemaps -----------------------------------------------------------------------------

HEAD = '<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:x="http://www.w3.org/1999/xhtml" xmlns:image="i">'
ENTRY = '<url>\n<loc> https://s.example/{0}?a=1&amp;b=2 </loc><x:link rel="alternate" hreflang="FR" href="https://s.example/f{0}"/></url>\n'
GOOD = {
    "plain": HEAD + "".join(ENTRY.format(i) for i in range(3)) + "</urlset>\n",
    "prefixed": '<s:urlset xmlns:s="n" xmlns:x="m"><s:url><s:loc>https://p.example/</s:loc><x:link rel="alternate" hreflang="de" href="/d"/></s:url></s:urlset>',
    "attributes": HEAD + '<url id="1"><loc>https://s.example/a</loc></url><url\n k="v"><loc><![CDATA[https://s.example/b?x&y]]></loc></url></urlset>',
    "comments": HEAD + "<!-- <a> --><note>n</note>" + ENTRY.format("c") + "<!-- end --></urlset>",
    "images": HEAD + "<url><loc>https://s.example/i</loc><image:image><image:loc>https://s.example/i.png</image:loc></image:image></url></urlset>",
    "index": "<sitemapindex><sitemap><loc>https://s.example/1.xml</loc></sitemap><sitemap><loc>https://s.example/2.xml</loc></sitemap></sitemapindex>",
    "none": HEAD + "</urlset>",
}
BAD = {
    "open-entry": HEAD + ENTRY.format(1) + "<url><loc>https://s.example/x</loc></urlset>",
    "no-end": HEAD + ENTRY.format(1),
    "cut": HEAD + ENTRY.format(1) + "<url><loc>https://s.exam",
    "ampersand": HEAD + "<url><loc>https://s.example/?a&b</loc></url></urlset>",
    "stray": HEAD + ENTRY.format(1) + "<open>" + ENTRY.format(2) + "</urlset>",
    "twice-closed": HEAD + ENTRY.format(1) + "</url></urlset>",
    "empty": "",
    "text": "not a sitemap",
}


def test_sitemap_files_against_a_whole_parse(spark, tmp_path):
    for name, text in (GOOD | BAD).items():
        (tmp_path / f"{name}.xml").write_text(text)
    found, urls, links = sitemaps.read_sitemaps(spark, f"file://{tmp_path}")
    state = {r.file.rsplit("/", 1)[-1].removesuffix(".xml"): r.valid for r in found.collect()}
    assert state == dict.fromkeys(GOOD, True) | dict.fromkeys(BAD.keys() - {"empty"}, False)
    want_urls, want_links = collections.Counter(), collections.Counter()
    for text in GOOD.values():
        locations, alternate = context.parse_sitemap(text)
        want_urls.update(locations)
        want_links.update(alternate)
    assert collections.Counter(r.url for r in urls.collect()) == want_urls
    assert collections.Counter(tuple(r) for r in links.collect()) == want_links


def test_one_large_sitemap_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "large.xml").write_text(HEAD + "".join(ENTRY.format(i) for i in range(50_000)) + "</urlset>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert sitemaps.records(spark, f"file://{tmp_path}").rdd.getNumPartitions() >= 5
        found, urls, links = sitemaps.read_sitemaps(spark, f"file://{tmp_path}")
        row = found.first()
        assert (row.entries, row.valid) == (50_000, True)
        assert urls.distinct().count() == urls.count() == links.distinct().count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- quantiles ----------------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, share):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-5, 5) / 2) for _ in range(400)] + [("one", 7.0), ("none", None), ("two", 1.0), ("two", 4.0)]
    rows += [("hot", 3.0)] * 500 + [("hot", 9.0)] * 3
    groups = collections.defaultdict(list)
    for key, value in rows:
        if value is not None:
            groups[key].append(value)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "g string, v double, _n int, _value int").repartition(6)
    found = {r.g: (r.q, r.n) for r in quantiles.exact_quantiles(frame, ["g"], "v", share, "q").collect()}
    assert {k: n for k, (_, n) in found.items()} == {k: len(v) for k, v in groups.items()}
    for key, (value, _) in found.items():
        assert value == pytest.approx(float(np.quantile(groups[key], share)))
    assert quantiles.exact_quantiles(frame.where("false"), ["g"], "v", share).count() == 0
    every = quantiles.exact_quantiles(frame, [], "v", share, "q").collect()
    assert [r.q for r in every] == [pytest.approx(float(np.quantile([v for vs in groups.values() for v in vs], share)))]


def test_exact_median_holds_no_group_in_one_task(spark):
    """One group with many values: every range of it is a task of its own."""
    frame = spark.range(40_000).selectExpr("0 AS g", "id * 7919 % 40009 AS v")
    # So few rows would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = frame.groupBy("g", "v").count().repartitionByRange("g", "v")
        assert max(len(p) for p in ranged.rdd.glom().collect()) < 40_000 / 4
        values = [i * 7919 % 40009 for i in range(40_000)]
        assert quantiles.exact_quantiles(frame, ["g"], "v", name="m").first().m == statistics.median(values)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sketches_merge(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=60_000)
    frame = spark.createDataFrame([(i % 3, i % 7, float(v)) for i, v in enumerate(values)] + [(0, 0, float("nan")), (0, 0, None), (9, 0, None)], "g long, day long, v double")
    daily = quantiles.sketches(frame, ["g", "day"], "v")
    found = {r.g: (r.q, r.n) for r in quantiles.sketch_quantiles(quantiles.merged_sketches(daily, ["g"]), ["g"], 0.75, "q").collect()}
    for g in range(3):
        own = np.sort(values[np.arange(60_000) % 3 == g])
        assert found[g][1] == 20_000 and abs(np.searchsorted(own, found[g][0]) / 20_000 - 0.75) <= quantiles.RANK_ERROR
    assert found[9] == (None, 0)


def test_vitals_flag_pages(spark):
    raw = spark.createDataFrame([("a", "<p>"), ("b", "<p>"), ("c", "<p>")], "url string, html string")
    measured = [("a", "LCP", v) for v in (1000.0, 2000.0, 2400.0, 9000.0)] + [("b", "CLS", v) for v in (0.0, 0.2, 0.2)] + [("b", "TTFB", 1.0), ("z", "LCP", 9e9)]
    own = site(crawl_table(raw), vitals=spark.createDataFrame(measured, "url string, metric string, value double"))
    assert [r.url for r in performance.poor_vitals(own).collect()] == ["b"]
    assert performance.poor_vitals(site(crawl_table(raw))).count() == 0


# --- clusters -----------------------------------------------------------------------------


def slow_clusters(listed, threshold=0.5):
    free, out = dict.fromkeys(listed), []
    for leader in sorted(listed):
        if leader not in free:
            continue
        del free[leader]
        near = [k for k in free if len(set(k) & set(leader)) >= threshold * len(set(k) | set(leader))]
        for k in near:
            del free[k]
        if near:
            out += [(leader, m, i) for i, m in enumerate([leader, *near])]
    return out


@pytest.mark.parametrize("batch, threshold", [(3, 0.5), (1000, 0.5), (8, 0.8), (5, 0.34)])
def test_clusters_are_the_greedy_ones(spark, batch, threshold):
    rng = random.Random(batch)
    listed = list(dict.fromkeys("".join(rng.choices("abcdefé€𝒳", k=rng.randint(1, 6))) for _ in range(160)))
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(listed)], "keyword string, place int").repartition(5)
    found = sorted(tuple(r) for r in clusters(frame, threshold, batch=batch).collect())
    assert found == sorted(slow_clusters(listed, threshold))
    assert leaders_of(frame.where("false")).count() == 0


def test_clusters_of_all_keywords_against_the_greedy_loop(spark):
    counts = keywords.counted(keywords.extracted(spark.read.parquet(f"{SMALL}/documents.parquet")), ["doc_id", "pos"])
    listed = [r.keyword for r in counts.orderBy(counts.frequency.desc(), "seen").select("keyword").collect()]
    found = leaders_of(counts).collect()
    want = {m: leader for leader, m, _ in slow_clusters(listed)}
    assert len(found) == len(listed) and all(r.leader == want.get(r.keyword, r.keyword) for r in found)


def test_a_batch_is_decided_in_order():
    assert _greedy(["a", "ab", "b", "bc"], ["a", "ab", "b", "bc"], 0.5) == [None, "a", None, "b"]


# --- elements and AMP rules ---------------------------------------------------------------


def test_elements_have_intervals():
    rows = elements("<html><body><p id=x><br><b>a</p>text<img src=y /></body><i>")
    tags = {r[4]: r for r in rows}
    assert [r[4] for r in rows] == ["html", "body", "p", "br", "b", "img", "i"]
    inside = lambda a, b: tags[b][0] < tags[a][0] and tags[a][1] < tags[b][1]
    assert inside("br", "p") and inside("b", "p") and inside("p", "body") and not inside("img", "p") and inside("i", "html") and not inside("i", "body")
    assert tags["p"][3] == tags["body"][0] and tags["html"][3] is None and tags["b"][2] == 3
    assert len({n for r in rows for n in r[:2]}) == 2 * len(rows) and elements("") == []


AMP_PAGE = (
    '<!doctype html><html ⚡><head><meta charset="utf-8"><meta name=viewport content=w><link rel=canonical href=/><script async src="https://cdn.ampproject.org/v0.js"></script>'
    "<style amp-boilerplate>b</style><style amp-custom>c</style></head><body><amp-img src=a></amp-img></body></html>"
)


def test_amp_rules(spark):
    cases = {
        "good": (AMP_PAGE, {}),
        "plain": ("<p>x", dict.fromkeys(["html-amp", "charset", "viewport", "runtime", "canonical", "boilerplate"], 1)),
        "images": (AMP_PAGE.replace("<amp-img", "<img src=x><noscript><div><img src=y></div></noscript><img src=z><amp-img"), {"no-img": 2}),
        "scripts": (AMP_PAGE.replace("<body>", '<body><script>x</script><script type="application/ld+json">{}</script>'), {"no-own-script": 1}),
        "moved": (AMP_PAGE.replace("<style amp-custom>c</style>", "").replace("<body>", "<body><style amp-custom>c</style><meta charset=utf-8>"), {"own-style-in-head": 1}),
        "charset": (AMP_PAGE.replace("utf-8", "latin-1"), {"charset": 1}),
        "twice": (AMP_PAGE.replace("</head>", "<style amp-custom>d</style><style amp-custom>e</style></head>"), {"one-own-style": 2}),
        "media": (AMP_PAGE.replace("<body>", "<body><source src=a><amp-video><source src=b><p><source src=c></p></amp-video>"), {"source-in-media": 2}),
        "handlers": (AMP_PAGE.replace("<body>", '<body><p onclick="x">a</p><a href="javascript:x" on="tap:y">b</a>'), {"no-handler": 1, "no-script-link": 1}),
        "fields": (AMP_PAGE.replace("<body>", "<body><fieldset></fieldset><form><div><fieldset></fieldset></div></form>"), {"field-in-form": 1}),
        "empty": ("", dict.fromkeys(["html-amp", "charset", "viewport", "runtime", "canonical", "boilerplate"], 1)),
    }
    frame = spark.createDataFrame([(k, html) for k, (html, _) in cases.items()], "url string, html string")
    found = collections.defaultdict(dict)
    for r in amp.broken_rules(frame).collect():
        found[r.url][r.rule] = r.places
    assert found == {k: v for k, (_, v) in cases.items() if v}
    crawl = site(crawl_table(frame))
    assert {r.url for r in health.flags(crawl, [c for c in health.checks(extra=True) if c.check_id == "C115"]).collect()} == set(cases) - {"good", "plain", "empty"}


def test_workbook_marks_long_cells(spark, tmp_path):
    cell = files._cell("x" * 40_000)
    assert "… [truncated]" in cell and len(cell) < 33_000 and "truncated" not in files._cell("x" * 32_767)
