"""SQL (DuckDB) for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .pii import IBAN_LENGTHS, SCHEMES

_ESCAPED = "replace({}, '\\', '\\\\')"
for _mark in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"

#: Words of a text: A-Z lowered, runs without ASCII white space.
_WORDS = r"""regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
#: The set of a list of words: its five-word runs, or the whole if it has fewer.
_SET = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END"""


def _seeded(*parts: str) -> str:
    """The number that the mix's seed and some values give."""
    return f"('0x' || substr(md5('0/' || {" || '/' || ".join(parts)}), 1, 15))::BIGINT"


#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _edited(path: str, cost: str, letter: str, said: str | None = None) -> str:
    """A path of the repair with one more edit; null stays null."""
    out = f"{path}.o" if said is None else f"list_append({path}.o, {said})"
    return f"CASE WHEN {path} IS NOT NULL THEN {{'c': {path}.c + {cost}, 'a': {path}.a || '{letter}', 'o': {out}}} END"


def _row_step(state: int) -> str:
    """The least path to a state over one row: delete it, keep it, or give it the role that the grammar takes next."""
    takes = {0: (), 1: ("x0",), 2: ("x0", "x1", "x3"), 3: ("x2",)}[state]
    initial, role = {0: ("", ""), 1: ("s", ""), 2: ("u", "user"), 3: ("a", "assistant")}[state]
    paths = [_edited(f"x{state}", "2", "D")]
    for path in takes:
        paths.append(f"CASE WHEN free AND initial = '{initial}' THEN {_edited(path, 'more', 'K', "role || ':' || text")} END")
        if role:
            paths.append(f"CASE WHEN free THEN {_edited(path, '(1 + more)', 'R', f"'{role}:' || text")} END")
    return f"list_min([{', '.join(paths)}])"


_INSERT_USER = ", ".join(_edited(f"y{i}", "5", "I", "'user:'") for i in (0, 1, 3))

#: Matches of an expression in a text, with their places: pieces between matches and matches take turns.
_MATCHES = """SELECT doc_id, {kind} AS k, {base} AS base, m[i] AS m,
    (list_sum(list_transform(s[:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[:i - 1], lambda v: length(v))), 0))::BIGINT AS a
  FROM (SELECT doc_id, regexp_extract_all(text, '{regex}') AS m, string_split_regex(text, '{regex}') AS s FROM d) x, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) u"""
_WIDE = "A-Za-z0-9\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}"
_IBANS = "|".join(f"{c}[0-9]{{2}}(?: ?[A-Za-z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())
_LOGIN = f"(?i:{'|'.join(SCHEMES)})://[A-Za-z0-9._~%!$&''()*+,;=:-]+@"
_SPANS = " UNION ALL ".join(
    _MATCHES.format(kind=kind, base=base, regex=regex)
    for kind, base, regex in (
        (0, "true", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        (1, "true", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        (2, "true", r"[0-9]([\x20-]?[0-9])+"),
        (3, "true", r"\+[0-9][\x20().0-9-]+[0-9]"),
        (0, "false", f"[{_WIDE}._%+-]+@[{_WIDE}-]+(\\.[{_WIDE}-]+)+"),
        (4, "false", f"{_LOGIN}[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*"),
        (5, "false", f"(?i:iban[ :.#=-]{{0,4}}(?:{_IBANS}))\\b"),
    )
)
#: Whether a match passes its kind's test; digits of a card by place from the right, an account's number in pieces.
_PASSES = """CASE WHEN k = 1 THEN list_bool_and(list_transform(string_split(m, '.'), lambda v: length(ltrim(v, '0')) <= 3 AND coalesce(try_cast(ltrim(v, '0') AS INTEGER), 0) <= 255))
  WHEN k = 2 THEN length(n) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(n) + 1),
    lambda i: CASE WHEN i % 2 = 1 THEN substr(n, -i, 1)::INTEGER ELSE 2 * substr(n, -i, 1)::INTEGER - CASE WHEN substr(n, -i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN k = 3 THEN length(n) BETWEEN 8 AND 15
  WHEN k = 5 THEN list_reduce([0::BIGINT] || list_transform(range(1, length(v) + 1), lambda i: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (v[5:] || v[:4])[i])::BIGINT - 1),
    lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
  ELSE true END"""

#: A count's probability, in billionths.
_P = "(1 + (1000000000::HUGEINT * ({} + 1)) // (total + v))"

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, LATERAL (SELECT unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i) u),
f AS (SELECT s, min(doc_id) AS first_ FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE first_ < doc_id),
run AS (SELECT doc_id, i, count(*) FILTER (before IS NULL OR i > before + 50) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, r, a, b, coalesce(lag(b) OVER o, 0) AS c, lead(a) OVER o IS NULL AS last_ FROM span WINDOW o AS (PARTITION BY doc_id ORDER BY r)),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
  string_agg(substr(h, 2 * c + 1, 2 * (a - c)) || CASE WHEN last_ THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY r) AS kept
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
""",
    "op5_minhash_dedup": f"""
WITH RECURSIVE s AS (SELECT doc_id, {_SET} AS s FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents) x),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b USING (t) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
label AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN label USING (doc_id)
""",
    "op6_mixing": f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    {_seeded("'place'", "coalesce(doc_id::VARCHAR, '')")} AS place FROM documents
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2::DOUBLE * sum(size) AS cap,
    ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM d GROUP BY source
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target, {_seeded("'source'", "coalesce('=' || source, '')")} AS tie,
    least(4096, greatest(1, ceil(source_size / 65536)))::BIGINT AS shards FROM leveled
), dealt AS (
  SELECT tie, count(*) AS blocks FROM (
    SELECT tie, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, tie, k) AS r
    FROM (SELECT *, unnest(range(0, (2 * source_size) // 8)) AS k FROM targets) q
  ) z WHERE r <= (SELECT round(sum(target) / 8) FROM targets) GROUP BY tie
), placed AS (
  SELECT doc_id, size, t.source_size, target, t.tie, place % shards AS shard, place >> 16 AS place
  FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
), shard AS (
  SELECT tie, shard, shard_size, {_seeded("'shard'", "tie::VARCHAR", "shard::VARCHAR")} AS own
  FROM (SELECT tie, shard, sum(size)::BIGINT AS shard_size FROM placed GROUP BY tie, shard) q
), won AS (
  SELECT own, count(*) AS won FROM (
    SELECT own, q.tie, row_number() OVER (PARTITION BY q.tie ORDER BY shard_size / (2 * k + 1) DESC, own, k) AS r, blocks
    FROM (SELECT *, unnest(range(0, (2 * shard_size) // 8)) AS k FROM shard) q JOIN dealt USING (tie)
  ) z WHERE r <= blocks GROUP BY own
), runs AS (
  SELECT tie, shard, shard_size, coalesce(won, 0) * 8 AS run,
    {_seeded("'start'", "own::VARCHAR")} % greatest(1, ceil(shard_size / 8))::BIGINT * 8 AS start
  FROM shard LEFT JOIN won USING (own)
), laid AS (
  SELECT p.*, run, start, shard_size, sum(size) OVER (PARTITION BY p.tie, p.shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a,
    CASE WHEN shard_size > 0 THEN run // shard_size ELSE 0 END AS passes
  FROM placed p JOIN runs USING (tie, shard)
)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(a + size, start + run - passes * shard_size) - greatest(a, start))
  + greatest(0, least(a + size, start + run - (passes + 1) * shard_size) - a))::BIGINT AS taken FROM laid
""",
    "op8_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) x),
s AS (SELECT doc_id, line, n, list_sort({_SET}) AS s FROM (SELECT *, {_WORDS.format("line")} AS w FROM l) x),
c AS (SELECT s, min(ROW(doc_id, n)) AS place, row_number() OVER () AS c FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT c, place, len(s) AS n, unnest(s) AS t FROM c),
echo AS (SELECT DISTINCT c FROM (SELECT a.c FROM t a JOIN t b USING (t) WHERE b.place < a.place
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))) x),
told AS (SELECT s.*, c.c IS NOT NULL AND (c.place < ROW(doc_id, n) OR echo.c IS NOT NULL) AS gone FROM s LEFT JOIN c USING (s) LEFT JOIN echo ON echo.c = c.c)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id
""",
    "op3_chat": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w IS DISTINCT FROM role AS opens
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format('text')}) + CASE WHEN opens
    THEN length('<|turn|>' || {_ESCAPED.format('role')} || '<|text|>') + length('<|end|>') + 1
    ELSE length('<|next|>') END)::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id
""",
    "op7_exact_dedup": r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY norm)
""",
    "op9_lm_scoring": r"""
WITH words AS (
  SELECT d.n, d.doc_id, u.w, u.i
  FROM (SELECT row_number() OVER () AS n, doc_id,
          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS ws FROM documents) d,
    LATERAL (SELECT unnest(d.ws) AS w, generate_subscripts(d.ws, 1) AS i) u
), grams AS (
  SELECT n, doc_id, i, w AS c, lag(w) OVER t AS b, lag(w, 2) OVER t AS a FROM words WINDOW t AS (PARTITION BY n ORDER BY i)
), one AS (SELECT n, c, count(*) AS n1, sum(count(*)) OVER (PARTITION BY c) - count(*) AS r1 FROM grams GROUP BY n, c),
two AS (SELECT n, b, c, sum(count(*)) OVER (PARTITION BY b, c) - count(*) AS r2 FROM grams WHERE b IS NOT NULL GROUP BY n, b, c),
three AS (SELECT n, a, b, c, sum(count(*)) OVER (PARTITION BY a, b, c) - count(*) AS r3 FROM grams WHERE a IS NOT NULL GROUP BY n, a, b, c),
total AS (SELECT n, sum(sum(n1)) OVER () - sum(n1) AS words FROM one GROUP BY n),
scored AS (
  SELECT g.n, ln(CASE WHEN r3 > 0 THEN r3 / p.r2
    WHEN q.r2 > 0 THEN CASE WHEN g.a IS NULL THEN 1 ELSE 0.4::DOUBLE END * q.r2 / o.r1
    ELSE CASE WHEN g.b IS NULL THEN 1 WHEN g.a IS NULL THEN 0.4::DOUBLE ELSE 0.4::DOUBLE * 0.4 END
      * CASE WHEN u.r1 > 0 THEN u.r1 ELSE 0.4::DOUBLE END / greatest(1, words) END) AS s
  FROM grams g JOIN one u ON u.n = g.n AND u.c = g.c JOIN total ON total.n = g.n
    LEFT JOIN one o ON o.n = g.n AND o.c = g.b LEFT JOIN two q ON q.n = g.n AND q.b = g.b AND q.c = g.c
    LEFT JOIN two p ON p.n = g.n AND p.b = g.a AND p.c = g.b LEFT JOIN three t ON t.n = g.n AND t.a = g.a AND t.b = g.b AND t.c = g.c
), summed AS (SELECT n, count(*) AS k, sum(s) AS s FROM scored GROUP BY n)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score
FROM (SELECT row_number() OVER () AS n, doc_id FROM documents) d LEFT JOIN summed USING (n)
""",
    "op10_top_k": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""",
    "op11_conversation_repair": f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
faulty AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format('key')} % 20 AS f FROM keyed),
hit AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(0, CASE WHEN f = 0 THEN 0 WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM faulty),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM hit),
judged AS (SELECT conv_id, turn, role, text, n, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
  NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM numbered),
r AS (SELECT *, NOT blank AND NOT seen AS free, CASE WHEN cut THEN 5 ELSE 0 END AS more,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM judged),
step AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS x0, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR[]) AS x1,
    {{'c': 5, 'a': 'I', 'o': ['user:']}} AS x2, {{'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']}} AS x3 FROM (SELECT DISTINCT conv_id FROM r) q
  UNION ALL
  SELECT conv_id, n, y0, y1, z2, list_min([y3, {_edited('z2', '5', 'I', "'assistant:'")}]) FROM (
    SELECT *, list_min([y2, {_INSERT_USER}]) AS z2 FROM (
      SELECT r.conv_id, r.n, {', '.join(f'{_row_step(i)} AS y{i}' for i in range(4))}
      FROM step JOIN r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.n = step.n + 1) a) b
),
best AS (SELECT conv_id, arg_max(list_min([x0, x3]), n) AS x FROM step GROUP BY conv_id),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut AND free) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(array_to_string(x.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
""",
    "op12_pii": f"""
WITH d AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, coalesce(text, '') AS text FROM documents),
raw AS ({_SPANS}),
cut AS (SELECT *, CASE WHEN k = 4 THEN strpos(m, '://') + 2 WHEN k = 5 THEN length(regexp_extract(m, '^.{{4}}[ :.#=-]{{0,4}}')) ELSE 0 END AS skip FROM raw),
span AS (SELECT doc_id, k, base, a + skip AS a, a + length(m) AS b, substr(m, skip + 1) AS m FROM cut),
passed AS (SELECT DISTINCT ON (doc_id, k, a, b) doc_id, k, base, a, b FROM (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS n, upper(replace(m, ' ', '')) AS v FROM span) x WHERE {_PASSES} ORDER BY doc_id, k, a, b, base DESC),
named AS (SELECT *, (['email', 'ip', 'card', 'phone', 'address', 'account'])[k + 1] || ':' || a || ':' || b AS s FROM passed)
SELECT d.id AS doc_id, {', '.join(f"count(*) FILTER (base AND k = {i})::BIGINT AS n_{n}" for i, n in enumerate(('email', 'ip', 'card', 'phone')))},
  sha256(coalesce(string_agg(s, ',' ORDER BY k, a, b) FILTER (base), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY k, a, b), '') AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY doc_id, d.id
""",
    "op13_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
language AS (SELECT lang, sum(c) AS total, count(*) AS v FROM kept GROUP BY lang),
q AS (SELECT lang, term, {_P.format('c')} AS q FROM kept JOIN language USING (lang)),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, {_P.format('n')} AS p FROM (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v FROM grid) x),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM part)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
