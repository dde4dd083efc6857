"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, s, s + 9) AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
o AS (SELECT doc_id, dw.s, dw.n, item_id FROM dw JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

SHARDING = """
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
        ('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, 'n')), 1, 15))::BIGINT AS word FROM documents),
l AS (SELECT doc_id, n_bytes, word, d, word >> (60 - d) AS p FROM r, (SELECT unnest(range(0, 61)) AS d)),
s AS (SELECT d, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY 1, 2),
f AS (SELECT doc_id, min(d) AS d FROM l JOIN s USING (d, p)
      WHERE shard_bytes <= 1048576 OR shard_rows = 1 GROUP BY 1)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(p), 64, '0'), d::INT) END AS shard,
    d::BIGINT AS shard_depth, shard_bytes, shard_rows
FROM f JOIN l USING (doc_id, d) JOIN s USING (d, p)"""

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _hashed(value: str) -> str:
    return f"('0x' || substr(md5({value}), 1, 8))::BIGINT"


URL_FILTER = f"""
WITH c AS (SELECT page_id, url, coalesce({_HOST}, '') AS host,
    list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS steps,
    1704067200 + {_hashed("page_id::VARCHAR")} % 31104000 AS fetched_at FROM pages),
k AS (SELECT DISTINCT page_id, fetched_at, key FROM (
    SELECT page_id, fetched_at, unnest(list_transform(range(1, greatest(1, len(string_split(host, '.')) - 1) + 1),
        lambda i: 'd:' || array_to_string(string_split(host, '.')[i:], '.'))) AS key FROM c WHERE host <> ''
    UNION ALL SELECT page_id, fetched_at, unnest(list_transform(range(1, len(steps) + 1),
        lambda i: 'p:' || host || '/' || array_to_string(steps[1:i], '/'))) FROM c WHERE host <> '')),
e AS (SELECT key, 'list' || ({_hashed("'l' || key")} % 3) AS list_name, CASE WHEN nth % 2 = 0 THEN 'add' ELSE 'remove'
        END AS action, 1704067200 + {_hashed("nth::VARCHAR || key")} % 31104000 AS ts
    FROM (SELECT key, unnest(range(0, {_hashed("'n' || key")} % 4 + 1)) AS nth
          FROM (SELECT DISTINCT key FROM k) WHERE {_hashed("'q' || key")} % 4 = 0)),
u AS (SELECT list_name, key, ts, max(action) AS action FROM e GROUP BY ALL),
g AS (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY list_name, key ORDER BY ts) AS before FROM u),
v AS (SELECT *, lead(ts) OVER (PARTITION BY list_name, key ORDER BY ts) AS valid_to FROM g WHERE action <> before),
m AS (SELECT page_id, count(*) AS n, arg_min({{'k': key, 'l': list_name, 's': ts}},
        {{'n': -length(key), 'k': key, 'l': list_name, 's': ts}}) AS best
    FROM k JOIN (SELECT * FROM v WHERE action = 'add') v USING (key)
    WHERE ts <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY 1)
SELECT page_id, host, fetched_at, coalesce(n, 0)::BIGINT AS n_active, n IS NOT NULL AS blocked,
    best.k AS decided_by, best.l AS decided_list, best.s AS listed_since
FROM c LEFT JOIN m USING (page_id)"""

WARC = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, strlen(coalesce(html, '')) >= 100 AND first <> page_id AS again
      FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))"""

_REACH = """r AS (SELECT {id} AS a, {id} AS b FROM {rows}
    UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)"""

NEAR_TEXT = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') || ' ' || least(len(w), 5) AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g)
    WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b
    WHERE 100 * shared >= 75 * (u.n + v.n - shared)),
""" + _REACH.format(id="doc_id", rows="documents") + """
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id"""

NEAR_VECTORS = """
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y USING (label) WHERE x.vec_id <> y.vec_id
    AND list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= 0.93),
""" + _REACH.format(id="vec_id", rows="embeddings") + """
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.a = vec_id"""


def _chosen(column: str, cases: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in cases) + " END"


_UP, _LOW, _NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = [("hex", _NUM + "abcdef"), ("hex_upper", _NUM + "ABCDEF"), ("base32", _UP + "234567"),
              ("base62", _UP + _LOW + _NUM), ("base64url", _UP + _LOW + _NUM + "-_"), ("base64", _UP + _LOW + _NUM + "+/")]
_PATTERNS = [("assign", "(?i:(?:password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+"),
             ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), ("random", "[A-Za-z0-9+/_-]+=*")]


def _tail(z: str) -> str:
    """Upper tail of the normal distribution, by the same rational approximation."""
    t = f"(1 / (1 + 0.3275911 * (abs({z}) / sqrt(2::DOUBLE))))"
    poly = "1.061405429"
    for c in ("-1.453152027", "1.421413741", "-0.284496736", "0.254829592"):
        poly = f"({poly} * {t} + {c})"
    half = f"({poly} * {t} * exp(-({z}) * ({z}) / 2) / 2)"
    return f"greatest(1e-30, CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, kind, unnest(list_zip(m, g[:len(m)])) AS x, generate_subscripts(m, 1) AS nth FROM (
    {" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d" for k, p in _PATTERNS)})
    WHERE len(m) > 0),
o AS (SELECT doc_id, kind, x[1] AS token, sum(length(x[2]) + length(x[1])) OVER (
    PARTITION BY doc_id, kind ORDER BY nth) AS stop FROM k),
a AS (SELECT doc_id, kind, token, (stop - length(token))::BIGINT AS start, stop::BIGINT AS stop FROM o),
base AS (SELECT doc_id, kind, start, stop FROM a WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(token, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8
    WHEN 'access' THEN length(token) >= 16 WHEN 'hex' THEN length(token) >= 32 ELSE false END),
t AS (SELECT *, CASE WHEN NOT regexp_matches(body, '[0-9]') OR NOT regexp_matches(body, '[A-Za-z]') THEN NULL
      WHEN regexp_full_match(body, '[0-9a-f]+') THEN 'hex' WHEN regexp_full_match(body, '[0-9A-F]+') THEN 'hex_upper'
      WHEN regexp_full_match(body, '[A-Z2-7]+') THEN 'base32' WHEN regexp_full_match(body, '[0-9A-Za-z]+') THEN 'base62'
      WHEN regexp_full_match(body, '[0-9A-Za-z_-]+') THEN 'base64url' ELSE 'base64' END AS encoding
    FROM (SELECT doc_id, body, start, start + length(body) + CASE WHEN length(token) - length(body) <= 2
              AND coalesce(behind > stop, true) THEN length(token) - length(body) ELSE 0 END AS stop
          FROM (SELECT *, regexp_replace(token, '=+$', '') AS body, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS behind
                FROM a WHERE kind = 'random') WHERE length(body) >= 20)),
v AS (SELECT doc_id, start, stop, encoding, length(body)::DOUBLE AS n, string_split(body, '') AS c,
      {_chosen("encoding", [(k, str(len(x))) for k, x in _ALPHABETS])}::DOUBLE AS k,
      list_transform(string_split(body, ''), lambda c: (instr({_chosen("encoding", [(k, f"'{x}'") for k, x in _ALPHABETS])}, c) - 1)::DOUBLE) AS v
    FROM t WHERE encoding IS NOT NULL),
w AS (SELECT *, list_sum(list_transform(list_distinct(c), lambda x: pow(len(list_filter(c, lambda y: y = x)), 2))) AS sq,
      list_transform(v, lambda x: (x >= k / 2)::INT) AS h, list_sum(v) / n AS mean FROM v),
u AS (SELECT *, (sq * k / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z_chi,
      2.0 * list_sum(h) * (n - list_sum(h)) AS twice,
      1 + list_sum(list_transform(range(1, len(h)), lambda i: (h[i] <> h[i + 1])::INT)) AS runs,
      list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) AS power,
      list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - mean) * (v[i + 1] - mean))) AS crossed FROM w),
y AS (SELECT *, twice * (twice - n) / (n * n * (n - 1)) AS spread FROM u),
z AS (SELECT *, CASE WHEN spread > 0 THEN abs((runs - 1 - twice / n) / sqrt(spread)) END AS z_runs,
      CASE WHEN power > 0 THEN abs((crossed / power + 1 / n) * sqrt(n)) END AS z_serial FROM y),
q AS (SELECT doc_id, start, stop, encoding, floor(2 * log2(n))::INT AS size_class, least(1.0::DOUBLE, 3 * least({_tail("z_chi")},
      CASE WHEN z_runs IS NULL THEN 1 ELSE least(1, 2 * {_tail("z_runs")}) END,
      CASE WHEN z_serial IS NULL THEN 1 ELSE least(1, 2 * {_tail("z_serial")}) END)) AS p FROM z),
b AS (SELECT *, least(300, floor(-10 * log10(p)))::INT AS decade FROM q),
cut AS (SELECT encoding, size_class, min(decade) AS cut FROM (
      SELECT encoding, size_class, decade, sum(m) OVER (PARTITION BY encoding, size_class ORDER BY decade DESC)
        / sum(m) OVER (PARTITION BY encoding, size_class) AS share
      FROM (SELECT encoding, size_class, decade, count(*) AS m FROM b GROUP BY 1, 2, 3))
    WHERE pow(10, -decade / 10.0) <= 0.05 * share GROUP BY 1, 2),
r AS (SELECT doc_id, 'random' AS kind, start, stop FROM b LEFT JOIN cut USING (encoding, size_class)
    WHERE NOT coalesce(decade >= cut, false)),
s AS (SELECT * FROM base UNION ALL SELECT * FROM r WHERE NOT EXISTS (
    SELECT 1 FROM base WHERE base.doc_id = r.doc_id AND base.start < r.stop AND r.start < base.stop)),
f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
      count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'random') AS n_random,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER (kind <> 'random') AS fixed,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans
    FROM (SELECT *, list_position(['assign', 'access', 'hex', 'random'], kind) AS nth FROM s) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(fixed, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN f USING (doc_id)"""

# CRC-32 byte by byte: a byte is mixed in, then eight steps (-1) divide by the polynomial.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({s}, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch), -1, -1, -1, -1, -1, -1, -1, -1]
      ELSE [192 + (unicode(ch) >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(ch) & 63), -1, -1, -1, -1, -1,
            -1, -1, -1] END))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
  4294967295)"""

# Near words of one length share a word with one place blanked; of two lengths, with one place left out.
SPELLING = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, count(*) AS k, {_CRC32.format(s="doc_id::VARCHAR || ':' || run")} AS h
      FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] ||
        run[h % length(run) + 2:] ELSE run END AS word FROM h) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
p AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
c AS (SELECT word, n, word[:i] || '_' || word[i + 2:] AS blank, word[:i] || word[i + 2:] AS cut FROM p),
e AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.blank = b.blank AND a.word <> b.word
      UNION SELECT a.word, a.n, b.word, b.n FROM c a JOIN w b ON a.cut = b.word
      UNION SELECT b.word, b.n, a.word, a.n FROM c a JOIN w b ON a.cut = b.word),
g AS (SELECT word, count(*) AS n_near, arg_min(near, {{'m': -near_n, 'w': encode(near)}}) AS near, max(near_n) AS near_n
      FROM e GROUP BY 1),
f AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
        CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN g USING (word)),
s AS (SELECT word, word AS root FROM f WHERE form IS NULL
      UNION ALL SELECT f.word, s.root FROM f JOIN s ON f.form = s.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN s USING (word)"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED_SEARCH = f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY 1),
c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
m AS (SELECT doc_id, 50 + (50 * n * big_n) // big_l AS m FROM d, c),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, big_n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""
