"""SQL equivalents of the operators that SQL can express."""

from __future__ import annotations

from tidemark.llm.license_digest import COPYRIGHT_LINE, KNOWN, KNOWN_DIGESTS, SPELLINGS

_HOST = "translate(regexp_extract({u}, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "regexp_extract({u}, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1)"


def _rule_case(rules, host: str, path: str, what) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{what((a, h, p))}'" for a, h, p in ranked) + " END"


def url_filter(rules) -> str:
    """Alias edges, their closure, and the verdicts; closure by recursion over distinct pairs."""
    action, rule = (lambda h, p: _rule_case(rules, h, p, lambda r: r[0])), (lambda h, p: _rule_case(rules, h, p, lambda r: r[1] + r[2]))
    tags = r"(?i)<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*>"
    link, jump = r"(?i)\bhref\s*=\s*[\"'']?([^\"''\s>]+)", r"(?i)\burl\s*=\s*([^\"''\s>]+)"
    ground = r"(?i)<base\b[^>]*?\bhref\s*=\s*[\"'']?([^\"''\s>]+)"
    clean = lambda x: f"replace(trim({x}), '&amp;', '&')"
    site, rest = (lambda u: f"regexp_extract({u}, '^[^:/?#]+://[^/?#]*')"), (lambda u: f"regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)")
    query = lambda u: f"regexp_extract({u}, '^[^?#]*([?][^#]*)', 1)"
    dots = lambda x: f"list_reduce(list_prepend('', string_split({x}, '/')[2:]), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN s = '.' THEN a ELSE a || '/' || s END) || CASE WHEN regexp_matches({x}, '/[.][.]?$') THEN '/' ELSE '' END"
    plain = lambda u: f"CASE WHEN regexp_matches({u}, '^[^:/?#]+://') THEN translate({site(u)}, '{_UPPER}', '{_LOWER}') || ({dots(f'CASE WHEN {rest(u)} = {chr(39) * 2} THEN {chr(39)}/{chr(39)} ELSE {rest(u)} END')}) || {query(u)} END"
    meet = lambda base, t: f"""CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {t} WHEN starts_with({t}, '//') THEN regexp_extract({base}, '^[^:]*:') || {t} WHEN starts_with({t}, '/') THEN {site(base)} || {t}
    WHEN starts_with({t}, '?') THEN {site(base)} || {rest(base)} || {t} WHEN {t} = '' OR starts_with({t}, '#') THEN NULL ELSE {site(base)} || regexp_replace('/' || ltrim(regexp_replace({rest(base)}, '[^/]*$', ''), '/'), '/*$', '/') || {t} END"""  # noqa: E731
    return f"""WITH RECURSIVE p AS (SELECT page_id, url, coalesce({_HOST.format(u='url')}, '') AS host, coalesce({_PATH.format(u='url')}, '') AS path FROM pages),
  based AS (SELECT url, html, {clean(f"regexp_extract(html, '{ground}', 1)")} AS b FROM pages),
  tag AS (SELECT url, CASE WHEN b = '' THEN url ELSE coalesce({meet('url', 'b')}, url) END AS base, unnest(regexp_extract_all(html, '{tags}')) AS t FROM based),
  raw AS (SELECT url, base, {clean(f"CASE WHEN regexp_extract(t, '{link}', 1) <> '' THEN regexp_extract(t, '{link}', 1) ELSE regexp_extract(t, '{jump}', 1) END")} AS t FROM tag),
  far AS (SELECT url, {meet('base', 't')} AS target FROM raw),
  edge AS (SELECT {plain('url')} AS a, {plain('target')} AS b FROM far),
  sides AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
  reach AS (SELECT a, b FROM sides UNION SELECT r.a, x.b FROM reach r JOIN sides x ON r.b = x.a),
  bad AS (SELECT DISTINCT a FROM reach WHERE {action(_HOST.format(u='b'), _PATH.format(u='b'))} = 'block')
  SELECT page_id, host, path, {rule('host', 'path')} AS rule, coalesce({action('host', 'path')}, CASE WHEN {plain('url')} IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM p"""


WARC = """WITH r AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
  x AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM r)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM x"""

SUFFIX = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
  b AS (SELECT doc_id, hx, unnest(range(0, CAST(length(hx) // 2 AS BIGINT))) AS p FROM d WHERE hx <> ''),
  w AS (SELECT doc_id, p, CASE WHEN 2 * p + 100 <= length(hx) THEN substr(hx, 2 * p + 1, 100) END AS s, substr(hx, 2 * p + 1, 2) AS byte FROM b),
  m AS (SELECT doc_id, p, byte, CASE WHEN s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN 1 ELSE 0 END AS f FROM w),
  g AS (SELECT doc_id, p, byte, max(f) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
  r AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g),
  a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone = 1) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (gone = 0), '') AS kept FROM r GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""

_WORDS = "list_filter(string_split_regex({t}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(31))) WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END"

JACCARD = f"""WITH RECURSIVE t AS (SELECT doc_id, list_distinct({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents)),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM t),
  pair AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 10 * count(*) >= 8 * (x.n + y.n - count(*))),
  reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a)
  SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM pair WHERE a = d.doc_id) AS n_links FROM documents d"""

LEAKS = f"""WITH i AS (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS.format(t="lower(coalesce(text, ''))")} AS w FROM benchmark)),
  ic AS (SELECT item_id, len(s) AS n, h, count(*) AS c FROM (SELECT item_id, s, unnest(s) AS h FROM i) GROUP BY item_id, len(s), h),
  ds AS (SELECT doc_id, s, len(s) AS m FROM (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS.format(t="lower(coalesce(text, ''))")} AS w FROM documents))),
  dp AS (SELECT doc_id, m, unnest(s) AS h, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS p FROM ds),
  hit AS (SELECT d.doc_id, d.m, d.p, d.h, ic.item_id, ic.n, ic.c FROM dp d JOIN ic ON d.h = ic.h),
  win AS (SELECT a.doc_id, a.item_id, a.p AS start, a.n, least(a.n, a.m - a.p) AS size, b.h, least(count(*), any_value(b.c)) AS common FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p AND b.p < a.p + a.n
    GROUP BY a.doc_id, a.item_id, a.p, a.n, a.m, b.h),
  sim AS (SELECT doc_id, item_id, start, CAST(sum(common) AS DOUBLE) / (n + size - sum(common)) AS similarity FROM win GROUP BY doc_id, item_id, start, n, size)
  SELECT doc_id, item_id, start, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM sim WHERE similarity >= 0.8) WHERE rn = 1"""

IMPORTANCE = f"""WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
  d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
  g AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
  dw AS (SELECT doc_id, unnest(words) AS w FROM d), gw AS (SELECT unnest(words) AS w FROM g),
  h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM gw)),
  b AS (SELECT w, list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS bytes FROM h),
  k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, tbl[1 + (xor(c, y) & 255)])), 4294967295) % 10000 AS bucket FROM b, crc),
  s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM gw JOIN k USING (w) GROUP BY bucket),
  gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * ((SELECT count(*) FROM gw) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
  own AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN k USING (w) JOIN gain ON gain.bucket = k.bucket GROUP BY doc_id),
  scored AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN own ON own.doc_id = d.doc_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
  SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

MIDDLE = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
  x AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
  c AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j FROM x),
  p AS (SELECT *, substr(text, 1, i) AS prefix, substr(text, i + 1, j - i) AS middle, substr(text, j + 1, n - j) AS suffix FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', chr(10), 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"list_filter(list_transform(string_split(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def license_digest() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    told = ", ".join(f"({quoted(n)}, '{d}')" for n, d in KNOWN_DIGESTS)
    return f"""WITH known AS (SELECT array_to_string({_canonical('t')}, ' ') AS form, min(n) AS license FROM (VALUES {values}) v(n, t) GROUP BY 1),
  whole AS (SELECT digest, min(license) AS license FROM (SELECT sha256(form) AS digest, license FROM known UNION ALL SELECT digest, license FROM (VALUES {told}) v(license, digest)) GROUP BY digest),
  d AS (SELECT doc_id, {_canonical('text')} AS lines FROM documents),
  named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, unnest(lines) AS line FROM d) x JOIN known ON known.form = x.line GROUP BY doc_id)
  SELECT d.doc_id, sha256(array_to_string(lines, ' ')) AS digest, whole.license, notices FROM d LEFT JOIN whole ON whole.digest = sha256(array_to_string(lines, ' ')) LEFT JOIN named ON named.doc_id = d.doc_id"""
