"""SQL for the library's queries, in the dialect of the engine that checks them.

The checks run on the derived site of ``sources.demo``, whose pages' markup depends on
the row number alone. Here each check's affected rows are stated by that number, or by
plain SQL over the values that went into the page, without any HTML.
"""

from __future__ import annotations

from .operators.architecture import ANCHOR_STOP_WORDS
from .operators.crawlability import PAGINATION
from .operators.registry import CATEGORIES, CATEGORY_WEIGHT, SEVERITY_WEIGHTS
from .plans.health import EVALUATION_ORDER, checks
from .sources import demo
from .sources.demo import FEATURES as _F

_HOST = "CASE WHEN {0} % 19 = 18 AND {0} <> 0 THEN 'www.site.example' ELSE 'site.example' END"


def _has(feature: str) -> str:
    return f"({_F[feature]})"


def _piece(feature: str, text: str) -> str:
    return f"CASE WHEN {_has(feature)} THEN {text} END"


_TEXT = ",\n    ".join(
    [
        "nullif(title, '')",
        "nullif(h1, '')",
        _piece("two_h1", "'Second'"),
        _piece("skip", "'Deep'"),
        _piece("lost", "'Page not found'"),
        "trim(filler)",
        "CASE WHEN t1 < n THEN 'flowers here' END",
        "CASE WHEN t2 < n THEN 'garden tools' END",
        "'blue widgets'",
        _piece("many_links", "trim(repeat('many links ', 101))"),
        _piece("nofollow_link", "'quiet place'"),
        _piece("generic", "'Click here'"),
        _piece("outer", "'outer'"),
        _piece("insecure_outer", "'plain'"),
        _piece("affiliate", "'shop'"),
        _piece("script_link", "'menu'"),
        _piece("tracking", "'tracked'"),
        _piece("affluent", "trim(repeat('rich ', 5))"),
    ]
)

_STOP = ", ".join(f"'{w}'" for w in ANCHOR_STOP_WORDS)


def _words(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({_STOP})))"


#: Common tables: c (crawl rows), l (page links with a crawled or uncrawled target), h (hreflang), w (redirect walks), d (depths).
SITE_SQL = f"""
WITH RECURSIVE f AS ({demo.fetched_sql()}),
v AS (
  SELECT *, {_HOST.format("i")} AS host, CASE WHEN ok THEN {demo.title_sql()} ELSE '' END AS title,
    CASE WHEN ok THEN {demo.h1_sql()} ELSE '' END AS h1, CASE WHEN ok THEN trim({demo.description_sql()}) ELSE '' END AS description,
    CASE WHEN ok THEN {demo.canonical_sql()} ELSE '' END AS canonical, {demo.filler_sql()} AS filler FROM f
),
c AS (
  SELECT *, CASE WHEN txt = '' THEN 0 ELSE len(string_split(txt, ' ')) END AS wc FROM (
    SELECT *, CASE WHEN ok THEN concat_ws(' ', {_TEXT}) ELSE '' END AS txt FROM v
  ) q
),
l AS (
  SELECT s.i, s.url, s.host, k.t, k.words, k.thost, k.target, o.status AS tstatus, o.ok AS tok, o.title AS ttitle, o.h1 AS th1
  FROM (SELECT * FROM c WHERE ok) s, LATERAL (
    SELECT s.t1 AS t, 'flowers here' AS words WHERE s.t1 < s.n UNION ALL
    SELECT s.t2, 'garden tools' WHERE s.t2 < s.n UNION ALL SELECT s.t3, 'blue widgets') k0,
  LATERAL (SELECT k0.t AS t, k0.words AS words, {_HOST.format("k0.t")} AS thost, {demo.url_sql("k0.t")} AS target) k
  LEFT JOIN c o ON o.i = k.t
),
inner_ AS (SELECT * FROM l WHERE host = thost),
h AS (
  SELECT i, url, 'en' AS code, url AS href, 0 AS pos FROM c WHERE ok AND {_has("hreflang")} UNION ALL
  SELECT i, url, 'fr', {demo.url_sql("t1")}, 1 FROM c WHERE ok AND {_has("hreflang")} UNION ALL
  SELECT i, url, 'de', {demo.url_sql("t3")}, 2 FROM c WHERE ok AND {_has("hreflang")} UNION ALL
  SELECT i, url, 'english', 'https://other.example/en', 3 FROM c WHERE ok AND {_has("hreflang_bad")} UNION ALL
  SELECT i, url, 'x-default', 'https://other.example/', 4 FROM c WHERE ok AND {_has("hreflang_default")} UNION ALL
  SELECT i, url, 'x-default', 'https://other.example/2', 5 FROM c WHERE ok AND {_has("hreflang_twice")} UNION ALL
  SELECT i, url, 'de', 'https://other.example/de', 6 FROM c WHERE ok AND {_has("hreflang_twice")}
),
e AS (SELECT c.url, c.redirect_target AS target FROM c WHERE status = '301'),
w AS (
  SELECT url, target AS cur, [url] AS seen, 1 AS hops, target = url AS loop_ FROM e UNION ALL
  SELECT w.url, e.target, list_append(w.seen, w.cur), w.hops + 1, list_contains(list_append(w.seen, w.cur), e.target)
  FROM w JOIN e ON e.url = w.cur WHERE NOT w.loop_ AND w.hops < 20
),
d0 AS (SELECT 0 AS i, 0 AS depth UNION SELECT x.t, d0.depth + 1 FROM d0 JOIN inner_ x ON x.i = d0.i WHERE d0.depth < 40),
d AS (SELECT d0.i, c.url, min(depth) AS depth FROM d0 JOIN c ON c.i = d0.i GROUP BY ALL),
k AS (
  SELECT c.i, c.url, c.wc, c.ok, count(l.t) FILTER (l.host = l.thost) AS n_in, count(l.t) FILTER (l.host <> l.thost) AS n_out, count(l.t) AS n_l,
    count(DISTINCT l.target) FILTER (l.host = l.thost) AS d_in
  FROM c LEFT JOIN l ON l.i = c.i GROUP BY ALL
),
cluster AS (
  SELECT i, url, list_sort(list_distinct(list_append(coalesce(hrefs, []), url))) AS members, hrefs IS NOT NULL AS declares
  FROM (SELECT c.i, c.url, list(h.href) FILTER (h.href IS NOT NULL) AS hrefs FROM c LEFT JOIN h ON h.i = c.i GROUP BY c.i, c.url) g
)"""


def _rows(check_id: str, condition: str, table: str = "c") -> str:
    return f"SELECT '{check_id}' AS check_id, url FROM {table} WHERE {condition}"


def _on(feature: str) -> str:
    return f"ok AND {_has(feature)}"


_BROKEN = "regexp_matches({}, '^[45]')"
_SAME = "{0} IN (SELECT {0} FROM c WHERE trim({0}) <> '' GROUP BY {0} HAVING count(*) > 1)"
_N_REL = f"(CASE WHEN {_has('many_links')} THEN 101 ELSE 0 END + CASE WHEN {_has('nofollow_link')} THEN 1 ELSE 0 END + CASE WHEN {_has('generic')} THEN 1 ELSE 0 END + CASE WHEN {_has('tracking')} THEN 1 ELSE 0 END)"
_D_REL = f"(CASE WHEN {_has('many_links')} THEN 1 ELSE 0 END + CASE WHEN {_has('nofollow_link')} THEN 1 ELSE 0 END + CASE WHEN {_has('generic')} THEN 1 ELSE 0 END + CASE WHEN {_has('tracking')} THEN 1 ELSE 0 END)"
_N_EXT = f"(CASE WHEN {_has('outer')} THEN 1 ELSE 0 END + CASE WHEN {_has('insecure_outer')} THEN 1 ELSE 0 END + CASE WHEN {_has('affiliate')} THEN 1 ELSE 0 END + CASE WHEN {_has('affluent')} THEN 5 ELSE 0 END)"
_N_SCRIPT = f"(CASE WHEN {_has('script_link')} THEN 1 ELSE 0 END)"
_ALL, _NONE = "true", "false"
_TOPIC = "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || h1), '[a-z0-9]+'), lambda w: length(w) >= 4))), ' ')"
_TARGETS = "(SELECT h.i, h.url, o.status, o.canonical, o.url AS target FROM h JOIN c o ON o.url = h.href) j"

#: Per check: a condition on c, or a whole query.
CHECK_SQL: dict[str, str] = {
    "C001": _NONE,
    "C002": _ALL,
    "C003": _ALL,
    "C004": _ALL,
    "C005": _NONE,
    "C006": _ALL,
    "C007": f"i % 3 <> 1 AND {_BROKEN.format('status')}",
    "C008": "i % 3 <> 1 AND status = '301'",
    "C009": f"i % 3 <> 1 AND {_on('noindex')}",
    "C010": _ALL,
    "C012": _on("noindex"),
    "C013": _on("nofollow_meta"),
    "C014": "status = 'Error'",
    "C015": f"{_on('lost')} AND wc < 200",
    "C016": "ok AND i % 16 = 1",
    "C017": f"{_on('canonical_next')} AND canonical IN (SELECT url FROM c WHERE {_on('noindex')})",
    "C018": f"ok AND ({_has('canonical_out')} OR ({_has('canonical_next')} AND host <> {_HOST.format('t1')}))",
    "C019": "canonical <> '' AND canonical <> url AND canonical IN (SELECT url FROM c WHERE canonical <> '' AND canonical <> url)",
    "C020": f"i <> 0 AND i % 15 = 2 AND i % 41 <> 8 AND NOT (ok AND ({_has('rel_next')} OR {_has('canonical_self')}))",
    "C021": "url NOT LIKE 'https://%'",
    "C022": "EXISTS (SELECT 1 FROM c WHERE i % 3 <> 1 AND url LIKE 'http://%')",
    "C023": f"url LIKE 'https://%' AND ok AND ({_has('mixed')} OR ({_has('canonical_next')} AND t1 % 13 = 12) OR ({_has('hreflang')} AND (t1 % 13 = 12 OR t3 % 13 = 12)))",
    "C024": "url LIKE 'http://%' AND NOT (status = '301' AND redirect_target LIKE 'https://%')",
    "C025": "url LIKE 'https://%' AND NOT (ok AND i % 4 = 0)",
    "C026": _NONE,
    "C027": _ALL,
    "C028": _ALL,
    "C030": "NOT (ok AND (i % 5 = 0 OR i % 6 = 0 OR i % 7 = 0))",
    "C031": "status = '301'",
    "C032": "url IN (SELECT url FROM w WHERE loop_)",
    "C034": "url IN (SELECT url FROM inner_ WHERE tstatus = '301')",
    "C035": f"status = '301' AND redirect_target IN (SELECT url FROM c WHERE {_BROKEN.format('status')})",
    "C036": _on("refresh"),
    "C037": "url || '/' IN (SELECT url FROM c) OR (url LIKE '%/' AND url[:-2] IN (SELECT url FROM c))",
    "C038": "EXISTS (SELECT 1 FROM c WHERE host = 'www.site.example') AND EXISTS (SELECT 1 FROM c WHERE host = 'site.example')",
    "C039": """url IN (SELECT url FROM (SELECT url, arg_max(CASE WHEN loop_ THEN seen[-1] ELSE cur END, hops) AS final_,
      max(hops - loop_::INT) AS hops FROM w GROUP BY url) z WHERE url LIKE 'http://%' AND hops > 1 AND final_ LIKE 'https://%')""",
    "C041": "trim(title) = ''",
    "C042": "length(title) BETWEEN 1 AND 29",
    "C043": "length(title) > 60",
    "C044": _SAME.format("title"),
    "C045": "trim(description) = ''",
    "C046": "length(description) BETWEEN 1 AND 69",
    "C047": "length(description) > 160",
    "C048": _SAME.format("description"),
    "C049": "trim(h1) = ''",
    "C050": f"{_on('two_h1')} AND NOT {_has('no_h1')}",
    "C051": _SAME.format("h1"),
    "C052": "title <> '' AND title = h1",
    "C053": "wc < 300",
    "C054": _SAME.format("txt"),
    "C056": "canonical = ''",
    "C058": "html <> '' AND length(txt) / length(html) < 0.10",
    "C059": f"NOT ok OR {_has('no_lang')}",
    "C060": f"{_on('skip')} AND (h1 <> '' OR {_has('two_h1')})",
    "C061": "i <> 0 AND i % 41 = 8",
    "C062": "length(url) > 115",
    "C063": "i <> 0 AND i % 23 = 7",
    "C064": "contains(url, '_')",
    "C065": "regexp_matches(url, '[A-Z]')",
    "C066": "url NOT IN (SELECT target FROM l)",
    "C067": "url IN (SELECT url FROM d WHERE depth > 3)",
    "C068": "url IN (SELECT url FROM d WHERE depth > 5)",
    "C070": f"url IN (SELECT url FROM k WHERE ok AND n_in + {_N_REL} > 100)",
    "C071": f"url IN (SELECT url FROM inner_ WHERE {_BROKEN.format('tstatus')})",
    "C072": "url IN (SELECT url FROM inner_ WHERE tstatus = '301')",
    "C073": _on("nofollow_link"),
    "C074": _on("generic"),
    "C075": f"url IN (SELECT url FROM inner_ WHERE len({_words('ttitle || chr(32) || th1')}) > 0 AND len(list_intersect({_words('words')}, {_words('ttitle || chr(32) || th1')})) = 0)",
    "C076": f"url IN (SELECT url FROM k WHERE (CASE WHEN ok THEN d_in + {_D_REL} ELSE 0 END) <= 1)",
    "C077": f"url IN (SELECT url FROM (SELECT url, m, median(m) OVER () AS usual, count(*) OVER () AS pages FROM (SELECT url, CASE WHEN ok THEN n_in + {_N_REL} ELSE 0 END AS m FROM k) a) b WHERE pages >= 5 AND usual > 0 AND m < usual * 0.3)",
    "C078": f"url IN (SELECT url FROM d WHERE depth > 2) AND NOT ({_on('breadcrumb')})",
    "C079": f"{_on('rel_next')} AND NOT {_has('rel_first')}",
    "C081": f"{_on('outer')} AND i % 4 = 0",
    "C082": f"ok AND ({_has('insecure_outer')} OR url IN (SELECT url FROM l WHERE host <> thost AND target LIKE 'http://%'))",
    "C083": f"{_on('outer')} AND i % 4 = 2",
    "C084": f"{_on('outer')} AND i % 4 = 0",
    "C085": f"{_on('image')} AND host = 'site.example' AND url LIKE 'https://%' AND NOT {_has('image_out')} AND NOT {_has('image_png')}",
    "C086": f"{_on('image')} AND {_has('image_out')}",
    "C087": _ALL,
    "C088": f"canonical IN (SELECT url FROM c WHERE {_BROKEN.format('status')})",
    "C089": f"url IN (SELECT url FROM {_TARGETS} WHERE {_BROKEN.format('status')})",
    "C090": _on("tracking"),
    "C091": f"{_on('outer')} AND i % 4 = 0 AND (SELECT count(*) FROM c WHERE {_on('outer')} AND i % 4 = 0) >= 3",
    "C092": f"url IN (SELECT url FROM k WHERE ok AND wc > 0 AND n_out + {_N_EXT} >= 5 AND (n_out + {_N_EXT}) / wc > 0.02)",
    "C093": _on("affiliate"),
    "C094": _on("script_link"),
    "C095": f"{_on('form')} AND url LIKE 'https://%'",
    "C096": f"ok AND ({_has('hreflang_bad')} OR {_has('hreflang_twice')})",
    "C097": "url IN (SELECT h.url FROM h JOIN c o ON o.url = h.href WHERE h.href <> h.url AND NOT EXISTS (SELECT 1 FROM h b WHERE b.url = h.href AND b.href = h.url))",
    "C098": f"url IN (SELECT url FROM {_TARGETS} WHERE canonical <> '' AND canonical <> target)",
    "C099": f"url IN (SELECT url FROM {_TARGETS} WHERE status = '301')",
    "C100": f"url IN (SELECT url FROM {_TARGETS} WHERE {_BROKEN.format('status')})",
    "C101": _on("hreflang_twice"),
    "C102": f"{_on('hreflang')} AND NOT {_has('hreflang_default')}",
    "C103": "url IN (SELECT a.url FROM cluster a JOIN cluster b ON list_contains(a.members, b.url) WHERE a.declares AND a.members <> b.members)",
    "C104": f"{_on('hreflang')} AND {_has('lang_fr')} AND NOT {_has('no_lang')}",
    "C105": f"{_on('hreflang')} AND (i % 16 = 4 OR {_has('hreflang_bad')})",
    "C106": _on("hreflang_twice"),
    "C107": f"ok AND NOT {_has('no_lang')} AND {_has('lang_fr')} <> {_has('french')}",
    "C108": f"NOT ({_on('schema')})",
    "C109": _on("schema_bad"),
    "C110": f"{_on('schema')} AND NOT {_has('schema_full')}",
    "C111": f"{_on('schema')} AND NOT {_has('image')}",
    "C112": f"NOT ({_on('social')})",
    "C113": f"NOT ({_on('social')})",
    "C116": f"NOT ({_on('icon')})",
    "C117": f"NOT ({_on('viewport')})",
    "C118": "i % 27 = 0",
    "C119": "ok AND i % 3 <> 0",
    "C121": _NONE,
    "C122": _on("blocking"),
    "C123": f"{_on('image')} AND NOT {_has('image_sized')}",
    "C124": f"{_on('image')} AND {_has('image_png')}",
    "C125": _on("image_second"),
    "C127": _on("big"),
    "C128": "ok AND i % 8 <> 0",
    "C129": f"NOT ({_on('viewport')})",
    "C130": f"{_on('image')} AND NOT {_has('image_alt')}",
    "C131": f"{_on('image')} AND NOT {_has('image_alt')}",
    "C132": f"url IN (SELECT url FROM k WHERE ok AND n_l + {_N_REL} + {_N_EXT} + {_N_SCRIPT} >= 10 AND (n_l + {_N_REL} + {_N_EXT} + {_N_SCRIPT}) / wc * 100 > 8)",
    "C134": f"{_on('form')} AND NOT {_has('labelled')}",
    # Checks beyond the report's own.
    "C011": _ALL,
    "C033": _NONE,
    "C040": "status = '301' AND (SELECT avg((status = '301')::INT) FROM c) > 0.05",
    "C055": _NONE,
    "C057": f"{_TOPIC} <> '' AND {_TOPIC} IN (SELECT {_TOPIC} FROM c GROUP BY 1 HAVING count(*) > 1)",
    "C069": "i % 3 <> 1 AND url NOT IN (SELECT target FROM inner_ WHERE target <> url GROUP BY target HAVING count(DISTINCT url) >= 2)",
    "C080": _NONE,
    "C114": _NONE,
    "C115": _NONE,
    "C120": _NONE,
    "C126": "ok AND (" + " OR ".join(
        f"list_sort(list_transform([0, 11, 22, 33], lambda x: ((i * 7 + x) % 40 * {step})))[3] > {limit}" for step, limit in ((100, 2500), (8, 200), (0.005, 0.1))
    ) + ")",
    "C133": f"ok AND NOT {_has('viewport')}",
    "C135": "ok",
}


def flags_sql(ids: list[str]) -> str:
    """(check_id, url) of some checks, after SITE_SQL's common tables."""
    return "\nUNION ALL ".join(_rows(i, CHECK_SQL[i]) for i in ids)


def category_sql(category: str) -> str:
    return f"{SITE_SQL}\n{flags_sql([c.check_id for c in checks(category)])}"


def _catalog_sql() -> str:
    rows = ", ".join(
        f"('{c.check_id}', '{c.name}', '{c.category}', '{c.severity}', {SEVERITY_WEIGHTS[c.severity]}, {EVALUATION_ORDER.index(c.check_id)})"
        for c in checks()
    )
    return f"(VALUES {rows}) AS g(check_id, name, category, severity, weight, place)"


#: Adds findings to SITE_SQL's common tables.
FINDINGS_SQL = f"""{SITE_SQL},
flags AS ({flags_sql([c.check_id for c in checks()])}),
found AS (
  SELECT g.check_id, g.category, g.name AS "check", g.severity, count(DISTINCT url)::BIGINT AS affected_pages,
    round(count(DISTINCT url) / (SELECT count(*) FROM c) * any_value(weight), 4) AS deduction,
    (count(DISTINCT url) * any_value(weight))::BIGINT AS impact_score, any_value(g.place)::INTEGER AS place
  FROM flags JOIN {_catalog_sql()} USING (check_id) GROUP BY ALL
),
scores AS (
  SELECT b.category, b.weight, b.label, CASE WHEN count(f.check_id) = 0 THEN 100 ELSE
    trunc(greatest(0.0, least(100.0, round(100 - sum(f.deduction) / count(f.check_id) * 100, 1))))::INTEGER END AS score
  FROM (VALUES {", ".join(f"('{n}', {CATEGORY_WEIGHT}, '{v}')" for n, v in CATEGORIES.items())}) AS b(category, weight, label)
  LEFT JOIN found f ON f.category = b.category GROUP BY ALL
)"""

ORACLE_SQL: dict[str, str] = {f"checks_{label}": category_sql(name) for name, label in CATEGORIES.items()}

ORACLE_SQL["checks_extra"] = f"{SITE_SQL}\n{flags_sql([c.check_id for c in checks(extra=True) if c.extra])}"
ORACLE_SQL["health_findings"] = f"{FINDINGS_SQL}\nSELECT * FROM found"
ORACLE_SQL["health_categories"] = f"{FINDINGS_SQL}\nSELECT category, weight, score, label FROM scores"
_SCORE = "round_even(sum(score * weight)::DOUBLE / sum(weight), 0)::INTEGER"
ORACLE_SQL["health_score"] = f"""{FINDINGS_SQL}
SELECT health_score, CASE WHEN health_score >= 90 THEN 'A' WHEN health_score >= 75 THEN 'B' WHEN health_score >= 60 THEN 'C'
  WHEN health_score >= 40 THEN 'D' ELSE 'F' END AS grade, (SELECT count(*) FROM c)::BIGINT AS pages_crawled,
  (SELECT count(*) FROM found)::BIGINT AS issues_found FROM (SELECT {_SCORE} AS health_score FROM scores) s"""
ORACLE_SQL["health_quick_wins"] = f"""{FINDINGS_SQL}
SELECT "check" AS issue, impact_score AS impact, affected_pages, category,
  row_number() OVER (ORDER BY impact_score DESC, affected_pages DESC, place)::INTEGER AS priority FROM found"""
ORACLE_SQL["redirect_chains"] = f"""{SITE_SQL}
SELECT url, arg_max(hops, hops)::INTEGER AS hops, arg_max(cur, hops) AS final, arg_max(loop_, hops) AS is_loop FROM w GROUP BY url"""
ORACLE_SQL["click_depths"] = f"{SITE_SQL}\nSELECT url, depth::INTEGER AS depth FROM d"
_REACHED = """SELECT DISTINCT target AS url FROM inner_ WHERE target <> url"""
ORACLE_SQL["orphans_resolved"] = f"""{SITE_SQL}
SELECT DISTINCT url FROM c WHERE url NOT IN ({_REACHED})"""
ORACLE_SQL["low_inlinks"] = f"""{SITE_SQL}
SELECT c.url FROM c LEFT JOIN (SELECT target, count(DISTINCT url) AS m FROM inner_ WHERE target <> url GROUP BY target) q
  ON q.target = c.url WHERE coalesce(m, 0) <= 1"""
ORACLE_SQL["repeated_dead_link_pages"] = f"{SITE_SQL}\nSELECT url FROM c WHERE {CHECK_SQL['C091']}"
_ISSUES = f"""{SITE_SQL}, pages_of AS (
  SELECT 'Duplicate Titles' AS issue, url FROM c WHERE {CHECK_SQL['C044']} UNION ALL
  SELECT 'Duplicate Descriptions', url FROM c WHERE {CHECK_SQL['C048']} UNION ALL
  SELECT 'Duplicate H1s', url FROM c WHERE {CHECK_SQL['C051']} UNION ALL
  SELECT 'Duplicate Body Content', url FROM c WHERE {CHECK_SQL['C054']} UNION ALL
  SELECT 'Orphan Pages', url FROM c WHERE {CHECK_SQL['C066']}
), issues AS (SELECT issue, count(*)::BIGINT AS impact, count(DISTINCT url)::BIGINT AS affected_pages FROM pages_of GROUP BY issue)"""
ORACLE_SQL["site_audit_issues"] = f"{_ISSUES}\nSELECT * FROM issues"
ORACLE_SQL["site_audit_score"] = f"""{_ISSUES}
SELECT trunc(greatest(0.0, least(100.0, round(100 - coalesce(sum(impact), 0)::DOUBLE / greatest(1, count(*)), 1))))::INTEGER AS score FROM issues"""
_OUTER = " UNION ALL ".join(
    f"SELECT {href} AS url FROM c, range({times}) WHERE {_on(feature)}"
    for feature, href, times in (
        ("outer", "concat('https://out.example/', i % 4)", 1),
        ("insecure_outer", "'http://plain.example/'", 1),
        ("affiliate", "'https://amzn.to/x'", 1),
        ("affluent", "'https://rich.example/'", 5),
    )
)
ORACLE_SQL["site_inbound_links"] = f"""{SITE_SQL}
SELECT url, count(*)::BIGINT AS n FROM (SELECT target AS url FROM l UNION ALL {_OUTER}) q GROUP BY url"""
ORACLE_SQL["crawl_overview"] = f"""{SITE_SQL}
SELECT count(*)::BIGINT AS pages, count(*) FILTER (ok)::BIGINT AS successful, trunc(count(*) FILTER (ok) / count(*) * 100)::INTEGER AS successful_percent,
  count(*) FILTER (NOT ok)::BIGINT AS errors FROM c"""
_HEADINGS = f"(h1 <> '')::INT + (ok AND {_has('two_h1')})::INT + (ok AND {_has('skip')})::INT"
_IMAGES = f"(ok AND {_has('image')})::INT + (ok AND {_has('image_second')})::INT"
ORACLE_SQL["crawl_averages"] = f"""{SITE_SQL}
SELECT count(*)::BIGINT AS pages_crawled, trunc(avg(length(title)))::INTEGER AS avg_title_length,
  trunc(avg(length(description)))::INTEGER AS avg_description_length, trunc(avg(wc))::INTEGER AS avg_word_count,
  round(avg({_HEADINGS}), 1) AS avg_heading_count, round(avg({_IMAGES}), 1) AS avg_image_count,
  round(avg(crawl_time_s::DOUBLE), 2) AS avg_crawl_time_s FROM c"""
ORACLE_SQL["crawl_by_status"] = f"{SITE_SQL}\nSELECT status AS value, count(*)::BIGINT AS n FROM c GROUP BY status"
ORACLE_SQL["crawl_time_by_status"] = f"{SITE_SQL}\nSELECT status AS key, avg(crawl_time_s::DOUBLE) AS mean FROM c GROUP BY status"
ORACLE_SQL["crawl_content_types"] = f"""{SITE_SQL}
SELECT value, count(*)::BIGINT AS n FROM (SELECT CASE WHEN contains(url, '/news/') THEN 'Blog / Article' WHEN contains(url, '/shop/') THEN 'Product'
  ELSE 'Other' END AS value FROM c WHERE ok) q GROUP BY value"""

#: The visible text of a raw page: comments, scripts and styles out, tags to blanks, the four entities in use decoded.
_STRIPPED = r"regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs')"
_DECODED = f"replace(replace(replace(replace(regexp_replace({_STRIPPED}, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_TEXT_SQL = f"trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g'))"


def _tag_text(tag: str) -> str:
    inner = f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1, 's')"
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        inner = f"replace({inner}, '{a}', '{b}')"
    return f"trim({inner})"


ORACLE_SQL["page_columns"] = f"""
SELECT page_id, {_tag_text('title')} AS title, length({_tag_text('title')})::INTEGER AS title_length, {_tag_text('h1')} AS h1,
  CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INTEGER AS word_count,
  len(regexp_extract_all(html, '<h[1-6][ >]'))::INTEGER AS heading_count, len(regexp_extract_all(html, '<img'))::INTEGER AS image_count,
  'Blog / Article' AS content_type, len(regexp_extract_all(html, '<a href='))::INTEGER AS n_links, sha1(x) AS text_sha1
FROM (SELECT *, {_TEXT_SQL} AS t,
  (SELECT string_agg(p, ' ' ORDER BY k) FROM (SELECT trim(unnest(pieces)) AS p, generate_subscripts(pieces, 1) AS k) u WHERE p <> '') AS x
  FROM (SELECT *, list_transform(regexp_split_to_array({_STRIPPED}, '<[^>]*>'), lambda s:
    replace(replace(replace(replace(s, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) AS pieces FROM pages) q0) q"""
#: A page as checks see it: beyond 12,000 characters an excerpt and a mark.
_EXCERPT = "CASE WHEN length(html) > 12000 THEN html[:12000] || '… [truncated]' ELSE html END"
ORACLE_SQL["page_body_text"] = f"""
SELECT page_id, sha1(lower({_TEXT_SQL})) AS body_sha1, lower(trim(regexp_extract(html, '<html lang="([^"]*)"', 1))) AS lang
FROM (SELECT page_id, {_EXCERPT} AS html FROM pages) p"""
ORACLE_SQL["page_corpus"] = f"""
SELECT url, sha1(trim(concat_ws(' ', title, '', h1, body))) AS text_sha1 FROM (
  SELECT page_id, url, {_tag_text('title')} AS title, {_tag_text('h1')} AS h1 FROM pages) a
JOIN (SELECT page_id, {_TEXT_SQL} AS body FROM pages) b USING (page_id)"""
ORACLE_SQL["page_duplicate_titles"] = f"""
SELECT DISTINCT url, title AS value FROM (SELECT url, {_tag_text('title')} AS title FROM pages) p
WHERE title <> '' AND title IN (SELECT {_tag_text('title')} FROM pages GROUP BY 1 HAVING count(*) > 1)"""
_URL_SQL = {
    "host": "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))",
    "path": "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)",
    "query": "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)",
}
ORACLE_SQL["page_urls"] = f"""
SELECT page_id, {_URL_SQL['host']} AS host, {_URL_SQL['path']} AS path, {_URL_SQL['query']} AS query,
  len(list_distinct(list_transform(list_filter(string_split({_URL_SQL['query']}, '&'), lambda p: regexp_matches(p, '^[^=]*=.')), lambda p: split_part(p, '=', 1))))::BIGINT AS n_keys,
  trim(split_part(url, '#', 1)) AS normalised FROM pages"""
_SLUG = "split_part(regexp_replace(path, '/+$', ''), '/', -1)"
_RAW = {
    "C020": f"regexp_matches(url, '{PAGINATION}') AND NOT contains(html, '<link')",
    "C021": "url NOT LIKE 'https://%'",
    "C037": "bare IN (SELECT bare FROM q GROUP BY bare HAVING count(*) > 1)",
    "C038": "regexp_replace(host, '^www[.]', '') IN (SELECT host FROM q WHERE 'www.' || host IN (SELECT host FROM q))",
    "C041": "title = ''",
    "C042": "length(title) BETWEEN 1 AND 29",
    "C043": "length(title) > 60",
    "C044": "title <> '' AND title IN (SELECT title FROM q GROUP BY title HAVING count(*) > 1)",
    "C045": "NOT contains(html, 'name=\"description\"')",
    "C049": "h1 = ''",
    "C050": "len(list_filter(levels, lambda x: x = 1)) > 1",
    "C051": "h1 <> '' AND h1 IN (SELECT h1 FROM q GROUP BY h1 HAVING count(*) > 1)",
    "C052": "title <> '' AND title = h1",
    "C053": "CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END < 300",
    "C054": "t <> '' AND lower(t) IN (SELECT lower(t) FROM q GROUP BY 1 HAVING count(*) > 1)",
    "C056": "NOT contains(html, 'canonical')",
    "C058": "length(body) / length(short) < 0.10",
    "C059": "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) = ''",
    "C060": "len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > list_max(levels[1:i - 1]) + 1)) > 0",
    "C061": "keys > 3",
    "C062": "length(url) > 115",
    "C063": f"regexp_matches(lower({_SLUG}), '^([0-9]+|[0-9a-f]{{8,}})$')",
    "C064": "contains(url, '_')",
    "C065": "url <> lower(url)",
    "C108": "NOT contains(html, 'ld+json')",
    "C112": "NOT contains(html, 'og:title')",
    "C113": "NOT contains(html, 'twitter:')",
    "C116": "NOT contains(html, '<link')",
    "C117": "NOT contains(html, 'viewport')",
    "C129": "NOT contains(html, 'viewport')",
}
ORACLE_SQL["page_checks"] = f"""
WITH q AS (SELECT page_id, url, p.html, {_URL_SQL['host']} AS host, {_URL_SQL['path']} AS path, regexp_replace(url, '/$', '') AS bare,
    {_tag_text('title').replace('html', 'p.html')} AS title, {_tag_text('h1').replace('html', 'p.html')} AS h1, {_TEXT_SQL.replace('html', 'p.html')} AS t, b.html AS short,
    {_TEXT_SQL.replace('html', 'b.html')} AS body, list_transform(regexp_extract_all(b.html, '<h([1-6])[ >]', 1), lambda x: x::INTEGER) AS levels,
    len(list_distinct(list_transform(list_filter(string_split({_URL_SQL['query']}, '&'), lambda x: regexp_matches(x, '^[^=]*=.')), lambda x: split_part(x, '=', 1)))) AS keys
  FROM pages p JOIN (SELECT page_id, {_EXCERPT} AS html FROM pages) b USING (page_id))
{" UNION ALL ".join(f"SELECT '{i}' AS check_id, url FROM q WHERE {c}" for i, c in _RAW.items())}"""
_PATH_SQL = "regexp_replace(split_part(url, '#', 1), '^[a-z]+://[^/?]*', '')"
ORACLE_SQL["page_robots_gate"] = f"""
SELECT page_id, CASE WHEN contains(path, '?page=') THEN false WHEN regexp_matches(path, '[.]html$') THEN true WHEN starts_with(path, '/ab') THEN false
  WHEN contains(path, '?') OR starts_with(path, '/a') OR starts_with(path, '/s') THEN true ELSE false END AS blocked
FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages) q"""
ORACLE_SQL["page_robots_first_match"] = f"""
SELECT page_id, starts_with(path, '/a') OR starts_with(path, '/s') AS blocked FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages) q"""
ORACLE_SQL["page_sitemap"] = """
SELECT url, '' AS code, '' AS href FROM pages WHERE page_id % 7 <> 3 UNION ALL SELECT url, 'fr', url FROM pages WHERE page_id % 7 <> 3"""
#: What FixedAnswers says to the URLs of a table ``asked`` (kind, url).
_ANSWERS = """
SELECT kind, url, CASE WHEN length(url) % 3 = 1 THEN 200 WHEN length(url) % 5 = 4 THEN NULL WHEN length(url) % 2 = 1 THEN 200 ELSE 410 END::INTEGER AS status,
  CASE WHEN length(url) % 3 = 1 THEN contains(url, 'out') WHEN length(url) % 5 = 4 THEN false ELSE contains(url, 'e') END AS redirected,
  CASE WHEN kind = 'link' THEN length(root) % 2 = 1 AND regexp_matches(substr(url, length(root) + 1), '^/[a0]') END AS robots_blocked
FROM (SELECT kind, url, regexp_extract(url, '^[a-zA-Z]+:(//[^/?#]*)?') AS root FROM asked) q"""
#: Links of the derived site that are external to its seed: of pages on another host also those without a host.
_RELATIVE = " UNION ALL ".join(
    f"SELECT split_part(url, '/', 1) || '//' || host || '{path}' FROM c WHERE host <> 'site.example' AND {_on(feature)}"
    for feature, path in (("many_links", "/many"), ("nofollow_link", "/quiet"), ("generic", "/generic"), ("tracking", "/t?utm_source=a"))
)
ORACLE_SQL["crawl_probe_targets"] = f"""{SITE_SQL},
links AS (SELECT * FROM (SELECT DISTINCT url FROM (SELECT target AS url FROM l WHERE thost <> 'site.example' UNION ALL SELECT 'javascript:void(0)' FROM c WHERE {_on('script_link')}
  UNION ALL {_OUTER} UNION ALL {_RELATIVE}) a ORDER BY url LIMIT 50) b),
images AS (SELECT DISTINCT url FROM (
  SELECT CASE WHEN {_F['image_out']} THEN 'https://cdn.example' ELSE split_part(url, '/', 1) || '//' || host || '/img' END || '/a' || CASE WHEN {_F['image_png']} THEN '.PNG' ELSE '.webp' END AS url
  FROM c WHERE {_on('image')} UNION ALL
  SELECT split_part(url, '/', 1) || '//' || host || '/img/b.webp' FROM c WHERE {_on('image_second')}) a ORDER BY url LIMIT 30),
icon AS (SELECT split_part(url, '/', 1) || '//' || host || '/favicon.ico' AS url FROM c WHERE {_on('icon')} ORDER BY url <> 'https://site.example/', url LIMIT 1),
asked AS (SELECT 'link' AS kind, url FROM links UNION ALL SELECT 'image', url FROM images UNION ALL SELECT 'favicon', url FROM icon)
{_ANSWERS}"""
_PAGE_LINKS = f"""linked AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM pages)"""
ORACLE_SQL["page_probes"] = f"""WITH {_PAGE_LINKS},
asked AS (SELECT 'link' AS kind, url FROM linked UNION ALL SELECT 'favicon', 'https://seed.example/favicon.ico')
{_ANSWERS}"""
ORACLE_SQL["page_probe_flags"] = f"""WITH {_PAGE_LINKS}, asked AS (SELECT 'favicon' AS kind, 'https://seed.example/favicon.ico' AS url)
SELECT a.url AS favicon_url, a.status AS favicon_status, n > 50 AS external_links_truncated, false AS images_truncated,
  least(n, 50)::BIGINT AS links, 0::BIGINT AS images FROM (SELECT count(*) AS n FROM linked) q, ({_ANSWERS}) a"""
ORACLE_SQL["sitemap_files"] = """
WITH good AS (SELECT url FROM pages WHERE page_id % 23 NOT IN (SELECT page_id % 23 FROM pages WHERE page_id % 46 = 3) AND page_id % 23 % 10 <> 7)
SELECT url, '' AS code, '' AS href FROM good UNION ALL SELECT url, 'fr', url FROM good"""
ORACLE_SQL["crawl_hosts"] = f"""
WITH RECURSIVE hosts AS (SELECT DISTINCT {_URL_SQL['host']} AS host FROM pages),
r AS (SELECT 0 AS k, 0 AS depth UNION ALL
  SELECT t, depth + 1 FROM r, LATERAL (SELECT unnest(CASE WHEN k = 6 OR (k % 7 <> 3 AND k % 5 = 4) THEN [] WHEN k % 7 = 3 THEN [2 * k + 1]
    ELSE list_filter([2 * k + 1, 2 * k + 2], lambda x: x < 40) END) AS t) q),
taken AS (SELECT k, depth FROM r ORDER BY k LIMIT 12)
SELECT 'https://' || host || '/0' AS site, 'https://' || host || '/' || k AS url, depth,
  CASE WHEN k = 6 THEN 'Error' WHEN k % 7 = 3 THEN '301' WHEN k % 5 = 4 THEN '404' ELSE '200' END AS status,
  CASE WHEN k = 6 THEN 'Blocked by robots.txt' WHEN k % 7 = 3 THEN 'Redirect' WHEN k % 5 = 4 THEN 'HTTP Error' ELSE 'Success' END AS crawl_status,
  CASE WHEN k <> 6 AND k % 7 = 3 THEN 'https://' || host || '/' || (2 * k + 1) ELSE '' END AS redirect_target FROM hosts, taken"""
ORACLE_SQL["csv_round_trip"] = "SELECT doc_id, sha1(text) AS text_sha1, length(text)::INTEGER AS chars, lang FROM documents"
ORACLE_SQL["page_backfilled"] = """SELECT page_id, length(html)::INTEGER AS heading_count, 0::INTEGER AS image_count, 0.0::DOUBLE AS link_to_word_ratio,
  '' AS canonical_url, '' AS og_title, '' AS og_description FROM pages"""
ORACLE_SQL["organic_degenerate"] = "SELECT doc_id, 0::INTEGER AS terms, '' AS top_terms, 'unknown' AS top_term_intent FROM documents"
ORACLE_SQL["audit_changes"] = f"""
WITH words AS (SELECT page_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM (SELECT page_id, {_TEXT_SQL} AS t FROM pages) q)
SELECT url, CASE WHEN page_id % 5 = 0 THEN 'added' WHEN page_id % 4 = 1 THEN 'gone' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'same' END AS change,
  CASE WHEN page_id % 4 <> 1 THEN n + CASE WHEN page_id % 3 = 0 THEN 3 ELSE 0 END END::INTEGER AS word_count,
  CASE WHEN page_id % 4 <> 1 THEN CASE WHEN page_id % 5 = 0 OR page_id % 3 = 0 THEN 2 ELSE 1 END END::INTEGER AS parsed_in
FROM pages JOIN words USING (page_id) WHERE page_id % 5 <> 0 OR page_id % 4 <> 1"""
_AMP = {
    "viewport": ("page_id % 6 <> 1", "1"),
    "runtime": ("page_id % 2 <> 0", "1"),
    "canonical": ("page_id % 3 <> 0 AND page_id % 5 <> 0", "1"),
    "boilerplate": ("page_id % 4 <> 1", "1"),
    "no-img": ("page_id % 7 = 2", "2"),
    "no-own-script": ("contains(html, '<script')", "len(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script'))"),
    "no-handler": ("page_id % 9 = 4", "1"),
    "no-script-link": ("page_id % 10 = 5", "1"),
    "one-canonical": ("page_id % 15 = 0", "1"),
    "source-in-media": ("page_id % 8 = 3", "1"),
    "option-in-select": ("page_id % 11 = 6", "1"),
}
ORACLE_SQL["amp_rules"] = " UNION ALL ".join(f"SELECT page_id, '{r}' AS rule, ({n})::BIGINT AS places FROM pages WHERE {c}" for r, (c, n) in _AMP.items())
ORACLE_SQL["field_vitals"] = """
SELECT event_type, user_id % 3 AS metric, count(*)::BIGINT AS n, true AS within_error FROM events WHERE value IS NOT NULL GROUP BY ALL"""
ORACLE_SQL["audit_trend"] = """
SELECT *, health_score - previous_score AS change FROM (
  SELECT user_id AS site, event_id, (event_id * 37 % 101)::INTEGER AS health_score,
    lag((event_id * 37 % 101)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_score FROM events) e"""
ORACLE_SQL["page_hosts"] = f"""
SELECT {_URL_SQL['host']} AS host, count(*)::BIGINT AS pages, count(*) FILTER (url LIKE 'https://%')::BIGINT AS https_pages,
  sum(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END)::BIGINT AS words
FROM (SELECT *, {_TEXT_SQL} AS t FROM pages) q GROUP BY 1"""

from .functions import text as _T  # noqa: E402
from .operators import international as _I  # noqa: E402


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_WORDS = r"regexp_extract_all(clean, '[A-Za-z][A-Za-z''\-]+')"
_TOPICS = f"list_filter(list_transform({_WORDS}, lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ({_listed(_T.STOP_WORDS)}))"
_SYLLABLES = """list_sum(list_transform(ws, lambda w: CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1,
  len(regexp_extract_all(lower(w), '[aeiouy]+')) - (regexp_matches(lower(w), '(es|ed)$') AND len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1)::INT) END))"""
ORACLE_SQL["content_analysis"] = f"""
SELECT doc_id, n AS word_count, len(list_distinct(topics))::BIGINT AS unique_word_count, sentences AS sentence_count,
  (clean <> '')::BIGINT AS paragraph_count, CASE WHEN n > 0 THEN round(n / sentences, 1) ELSE 0.0 END::DOUBLE AS avg_sentence_length,
  syll AS syllable_count, coalesce(round(206.835::DOUBLE - 1.015::DOUBLE * (n / sentences) - 84.6::DOUBLE * (syll / nullif(n, 0)), 1), 0.0) AS flesch_reading_ease,
  greatest(1, round_even(n / 200, 0))::BIGINT AS reading_time_minutes, len(list_filter(ws, lambda w: lower(w) = 'the'))::BIGINT AS target_keyword_count
FROM (SELECT doc_id, clean, ws, topics, len(ws)::BIGINT AS n, coalesce({_SYLLABLES}, 0)::BIGINT AS syll,
    greatest(1, CASE WHEN clean = '' THEN 0 ELSE 1 + len(regexp_extract_all(clean, '[.!?] ')) END)::BIGINT AS sentences
  FROM (SELECT doc_id, clean, {_WORDS} AS ws, {_TOPICS} AS topics FROM (SELECT doc_id, {_CLEAN} AS clean FROM documents) a) b) c"""
ORACLE_SQL["content_paragraphs"] = r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: trim(p) <> ''))::BIGINT AS paragraphs FROM documents"""
ORACLE_SQL["content_top_keywords"] = f"""
SELECT * FROM (SELECT doc_id, keyword, frequency, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, seen)::INTEGER AS place FROM (
  SELECT doc_id, keyword, count(*)::BIGINT AS frequency, min(pos) AS seen FROM (
    SELECT doc_id, unnest(topics) AS keyword, generate_subscripts(topics, 1) AS pos FROM (
      SELECT doc_id, {_TOPICS} AS topics FROM (SELECT doc_id, {_CLEAN} AS clean FROM documents) a) b) c GROUP BY ALL) d) e WHERE place <= 10"""
_SHARES = ", ".join(
    f"{{'share': len(list_filter(ws, lambda w: w IN ({_listed(words.split())}))) / len(ws), 'rank': -{rank}, 'language': '{language}'}}"
    for rank, (language, words) in enumerate(_I.STOP_WORDS.items())
)
ORACLE_SQL["content_languages"] = f"""
SELECT lang, detected, count(*)::BIGINT AS documents FROM (
  SELECT lang, CASE WHEN len(ws) >= 20 AND best.share > 0 THEN best.language ELSE '' END AS detected FROM (
    SELECT lang, ws, list_sort([{_SHARES}], 'DESC')[1] AS best FROM (
      SELECT lang, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS ws FROM documents) a) b) c GROUP BY ALL"""
_KEYWORDS = f"""
keywords AS (SELECT doc_id, pos, keyword FROM (
  SELECT doc_id, unnest(ws) AS keyword, generate_subscripts(ws, 1) AS pos FROM (
    SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'),
      lambda w: length(w) >= 2 AND w NOT IN ({_listed(_T.KEYWORD_STOP_WORDS)})) AS ws FROM documents) a) b),
total AS (SELECT count(*)::BIGINT AS total FROM keywords)"""


def _top(n: int) -> str:
    return f"""
WITH {_KEYWORDS}, ranked AS (
  SELECT keyword, frequency, round(frequency / total * 100, 2) AS percentage, place, total FROM (
    SELECT keyword, frequency, row_number() OVER (ORDER BY frequency DESC, seen)::INTEGER AS place FROM (
      SELECT keyword, count(*)::BIGINT AS frequency, min(ROW(doc_id, pos)) AS seen FROM keywords GROUP BY keyword) x) y, total
  WHERE place <= {n})"""


def _intent_sql(column: str, lists: dict, otherwise: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({column}), '{'|'.join(t.replace('?', '[?]') for t in terms)}') THEN '{name}'" for name, terms in lists.items()
    )
    return f"CASE {whens} ELSE '{otherwise}' END"


_KEYWORD_INTENT = _intent_sql("keyword", _T.KEYWORD_INTENTS, "Mixed")
ORACLE_SQL["keyword_frequency"] = f"{_top(50)} SELECT * FROM ranked"
ORACLE_SQL["keyword_totals"] = f"WITH {_KEYWORDS} SELECT count(*)::BIGINT AS total_keywords, count(DISTINCT keyword)::BIGINT AS unique_keywords FROM keywords"
ORACLE_SQL["keyword_intents"] = f"{_top(500)} SELECT keyword, {_KEYWORD_INTENT} AS intent FROM ranked"
ORACLE_SQL["keyword_intent_summary"] = f"""{_top(500)}
SELECT intent, count(*)::BIGINT AS count, round(count(*) / sum(count(*)) OVER () * 100, 1) AS percentage FROM (SELECT {_KEYWORD_INTENT} AS intent FROM ranked) q GROUP BY intent"""
ORACLE_SQL["keyword_opportunities"] = f"""{_top(50)}
SELECT keyword, round(score, 1) AS opportunity_score, round(often, 1) AS frequency_component, round(long_, 1) AS length_component, 0 AS rank_penalty,
  CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS priority
FROM (SELECT *, greatest(0.0, least(100.0, often * 0.4::DOUBLE + long_ * 0.4::DOUBLE)) AS score FROM (
  SELECT keyword, least(100.0::DOUBLE, frequency / total * 100 * 2) AS often, 15.0::DOUBLE AS long_ FROM ranked) a) b"""
_LETTERS = "list_distinct(string_split({}, ''))"
_COMMON = f"len(list_intersect({_LETTERS.format('k')}, {_LETTERS.format('leader')}))"
ORACLE_SQL["keyword_clusters"] = f"""{_top(50).replace('WITH', 'WITH RECURSIVE', 1)}, g AS (
  SELECT list(keyword ORDER BY place) AS free, NULL::VARCHAR AS leader, []::VARCHAR[] AS near FROM ranked UNION ALL
  SELECT list_filter(others, lambda k: NOT list_contains(near, k)), leader, near FROM (
    SELECT others, leader, list_filter(others, lambda k: {_COMMON} >= 0.5 * (len({_LETTERS.format('k')}) + len({_LETTERS.format('leader')}) - {_COMMON})) AS near
    FROM (SELECT list_filter(free, lambda k: k <> list_min(free)) AS others, list_min(free) AS leader FROM g WHERE len(free) > 0) a) b
)
SELECT leader, leader AS member, 0::INTEGER AS ord FROM g WHERE len(near) > 0 UNION ALL
SELECT leader, unnest(near), generate_subscripts(near, 1)::INTEGER FROM g WHERE len(near) > 0"""
ORACLE_SQL["keyword_clusters_all"] = f"""
WITH RECURSIVE {_KEYWORDS}, counts AS (
  SELECT keyword, list_sort({_LETTERS.format('keyword')}) AS letters, count(*) AS frequency, min(ROW(doc_id, pos)) AS seen FROM keywords GROUP BY keyword),
alphabet AS (SELECT letter, row_number() OVER (ORDER BY letter) - 1 AS i FROM (SELECT DISTINCT unnest(letters) AS letter FROM counts) a),
sets AS (SELECT letters, min(name) AS name, bit_or(1::HUGEINT << i::INTEGER) AS mask FROM (
  SELECT letters, min(keyword) AS name, unnest(letters) AS letter FROM counts GROUP BY letters) a JOIN alphabet USING (letter) GROUP BY letters),
g AS (
  SELECT list({{'n': name, 'm': mask}} ORDER BY name) AS free, NULL::VARCHAR AS leader, []::VARCHAR[] AS near FROM sets UNION ALL
  SELECT list_filter(free, lambda k: bit_count(k.m & first.m) < 0.5 * bit_count(k.m | first.m)), first.n,
    list_transform(list_filter(free, lambda k: bit_count(k.m & first.m) >= 0.5 * bit_count(k.m | first.m)), lambda k: k.n)
  FROM (SELECT free, free[1] AS first FROM g WHERE len(free) > 0) a),
led AS (SELECT leader, keyword, frequency, seen FROM (SELECT leader, unnest(near) AS name FROM g WHERE leader IS NOT NULL) a JOIN sets USING (name) JOIN counts USING (letters))
SELECT leader, keyword AS member, (row_number() OVER (PARTITION BY leader ORDER BY keyword <> leader, frequency DESC, seen) - 1)::INTEGER AS ord
FROM led QUALIFY count(*) OVER (PARTITION BY leader) > 1"""
ORACLE_SQL["keyword_difficulties"] = f"""{_top(50)}
SELECT keyword, round(score, 1) AS difficulty_score, CASE WHEN score < 30 THEN 'Easy' WHEN score < 60 THEN 'Medium' ELSE 'Hard' END AS level,
  1 AS word_count, round(ratio, 4) AS frequency_ratio
FROM (SELECT keyword, frequency / total AS ratio, greatest(0.0, least(100.0, (1 - frequency / total) * 100 - 1)) AS score FROM ranked) a"""
ORACLE_SQL["keyword_variations"] = f"""{_top(20)}
SELECT keyword, pos::INTEGER AS pos, variation FROM (SELECT keyword, unnest(vs) AS variation, generate_subscripts(vs, 1) - 1 AS pos FROM (
  SELECT keyword, list_filter([keyword, CASE WHEN keyword LIKE '%s' THEN NULL ELSE keyword || 's' END, 'what is ' || keyword, 'how to ' || keyword, 'best ' || keyword,
    keyword || ' tips', keyword || ' guide', keyword || ' tutorial', keyword || ' tools'], lambda v: v IS NOT NULL) AS vs FROM ranked) a) b"""
_TFIDF = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_][\\p{{L}}\\p{{M}}\\p{{N}}_\\-]*[\\p{{L}}\\p{{M}}\\p{{N}}_]'),
    lambda t: t NOT IN ({_listed(_T.STOP_WORDS)})) AS ws FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(ws) AS term FROM w UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w) a GROUP BY ALL),
vocabulary AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1 AS idf FROM (
  SELECT term, sum(tf) AS corpus_tf, count(*) AS df FROM counted GROUP BY term ORDER BY corpus_tf DESC, term LIMIT 10000) a),
scored AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS score FROM counted JOIN vocabulary USING (term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, term) AS place FROM scored QUALIFY place <= 10)"""
_TERM_INTENT = _intent_sql("term", _T.TERM_INTENTS, "unknown")
ORACLE_SQL["organic_terms"] = f"{_TFIDF} SELECT doc_id, term, round(score, 6) AS score FROM ranked"
ORACLE_SQL["organic_intents"] = f"""{_TFIDF}
SELECT d.doc_id, coalesce(v.terms, 0)::BIGINT AS terms, coalesce(v.intent, 'unknown') AS top_term_intent FROM documents d LEFT JOIN (
  SELECT doc_id, sum(n) AS terms, arg_max(intent, ROW(n, -seen)) AS intent FROM (
    SELECT doc_id, {_TERM_INTENT} AS intent, count(*) AS n, min(place) AS seen FROM ranked GROUP BY ALL) a GROUP BY doc_id) v USING (doc_id)"""
ORACLE_SQL["organic_global"] = f"""{_TFIDF}
SELECT term, round(s, 4) AS aggregate_score FROM (SELECT term, sum(score) AS s FROM ranked GROUP BY term ORDER BY round(s, 10) DESC, term LIMIT 50) a"""
ORACLE_SQL["page_display"] = f"""
SELECT page_id, url, CASE WHEN length(x) > 400 THEN x[:400] || '… [truncated]' ELSE x END AS content_text
FROM (SELECT page_id, url, (SELECT string_agg(p, ' ' ORDER BY k) FROM (SELECT trim(unnest(pieces)) AS p, generate_subscripts(pieces, 1) AS k) u WHERE p <> '') AS x
  FROM (SELECT *, list_transform(regexp_split_to_array({_STRIPPED}, '<[^>]*>'), lambda s:
    replace(replace(replace(replace(s, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) AS pieces FROM pages) q0) q"""
ORACLE_SQL |= {
    "rel_semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "rel_anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "rel_broadcast_dimension": """SELECT r_name, count(*)::BIGINT AS customers, round(avg(c_acctbal), 4) AS avg_balance FROM customer
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "rel_top_per_group": """SELECT p_brand, p_partkey, p_retailprice, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) p WHERE place <= 3""",
    "rel_weighted_average": """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean_price, count(*)::BIGINT AS lines FROM lineitem GROUP BY ALL""",
    "rel_median": """SELECT event_type, median(value) AS median_value, count(DISTINCT user_id)::BIGINT AS users, arg_max(event_id, ROW(value, event_id)) AS top_event FROM events GROUP BY event_type""",
    "rel_quantiles": """SELECT o_orderpriority, o_orderstatus, quantile_cont(o_totalprice, 0.9) AS p90, count(*)::BIGINT AS n FROM orders GROUP BY ALL""",
    "rel_json": """SELECT event_type, sum(k)::BIGINT AS sum_k, min(k) AS min_k, max(k) AS max_k FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) e GROUP BY event_type""",
    "rel_running": """SELECT o_orderkey, max(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) AS highest, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS change
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "rel_set_operations": """SELECT nation, 'both' AS side FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) a UNION ALL
      SELECT nation, 'customer' FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier) b UNION ALL
      SELECT nation, 'supplier' FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer) c""",
    "rel_duplicates": """SELECT doc_id, sha1(lower(text)) AS value FROM documents WHERE sha1(lower(text)) IN (SELECT sha1(lower(text)) FROM documents GROUP BY 1 HAVING count(*) > 1)""",
    "rel_labels": """SELECT quality, toxic, count(*)::BIGINT AS documents, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
    "rel_benchmark_overlap": """SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) d
      JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) b USING (line) WHERE trim(line) <> ''""",
    "rel_turns": r"""SELECT role, count(*)::BIGINT AS turns, sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''\-]+')))::BIGINT AS words FROM conversations GROUP BY role""",
}
