"""DuckDB SQL twins of the registered queries (the correctness oracle).

The driver registers the base tables as views; the history views are
inlined as CTEs here, written independently of the Spark code: SimHash is
computed with HUGEINT arithmetic, frequencies with GROUP BY, the centroid
with ORDER BY ... LIMIT 1 and the rank with the same formula.
"""

from __future__ import annotations

HISTORY = """history AS (
  SELECT e.event_id AS id, e.ts AS created_at,
    CASE e.event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method,
    p.url AS url,
    d.doc_id IS NOT NULL AS has_response,
    CAST(CASE e.event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN 201
         WHEN 'purchase' THEN 302 ELSE CASE WHEN e.user_id % 2 = 0 THEN 500 ELSE 404 END END AS INTEGER) AS status_code,
    CASE WHEN d.lang = 'en' THEN 'text/html; charset=UTF-8' WHEN d.lang = 'fr' THEN 'Application/JSON'
         WHEN d.lang = 'de' THEN CASE WHEN e.event_id % 2 = 0 THEN 'image/svg+xml' ELSE 'application/xhtml+xml; q=1' END
         ELSE NULL END AS content_type_header,
    CASE WHEN e.event_type = 'purchase' THEN p.url ELSE NULL END AS location,
    d.text AS body
  FROM events e LEFT JOIN documents d ON e.event_id = d.doc_id
  LEFT JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""

PAGES_HISTORY = """history AS (
  SELECT page_id AS id, 'GET' AS method, url, TRUE AS has_response, CAST(200 AS INTEGER) AS status_code,
    'text/html' AS content_type_header, CAST(NULL AS VARCHAR) AS location, html AS body FROM pages)"""

LABEL_LISTS = """main_ids AS (SELECT doc_id AS id, doc_id AS pos FROM labels WHERE quality = 1),
extra_ids AS (SELECT doc_id AS id, doc_id AS pos FROM labels WHERE toxic = 1)"""

MIME = ("CASE WHEN coalesce({h}, '') = '' THEN 'unknown' "
        "ELSE lower(trim(split_part({h}, ';', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) END")


def fnv_sql(t: str) -> str:
    return (f"list_reduce(list_prepend(14695981039346656037::HUGEINT, "
            f"list_transform(range(1, length({t}) + 1), lambda i: ascii(substr({t}, i, 1))::HUGEINT)), "
            f"lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)")


def hex_sql(fp: str) -> str:
    return f"lower(lpad(to_hex({fp}), 16, '0'))"


def simhash_ctes(src: str, keys: str, text: str, prefix: str = "") -> str:
    """CTEs {prefix}tk, {prefix}dic, {prefix}bits, {prefix}fps(keys..., fp UBIGINT)."""
    p = prefix
    return f"""{p}tk AS (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {src}),
{p}dic AS (SELECT t, {fnv_sql('t')} AS h FROM (SELECT DISTINCT t FROM {p}tk)),
{p}bits AS (SELECT {keys}, b, sum(((h >> b::HUGEINT) & 1::HUGEINT)::BIGINT) AS ones, count(*) AS n
    FROM {p}tk JOIN {p}dic USING (t), range(64) g(b) GROUP BY ALL),
{p}fps AS (SELECT {keys}, sum(CASE WHEN 2 * ones > n THEN (1::HUGEINT << b::HUGEINT) ELSE 0::HUGEINT END)::UBIGINT AS fp
    FROM {p}bits GROUP BY ALL)"""


def features_ctes(carry: str, keys: str) -> str:
    """r (responses), simhash CTEs, f (feature rows with fp)."""
    return f"""r AS (SELECT {carry}, coalesce(method, '') AS method, coalesce(url, '') AS url, location,
    coalesce(status_code, 0) AS status_code, CAST(coalesce(strlen(body), 0) AS BIGINT) AS content_length,
    {MIME.format(h='content_type_header')} AS content_type, body FROM hsrc WHERE has_response),
{simhash_ctes('r', keys, 'body')},
f AS (SELECT r.* EXCLUDE (body), coalesce(fps.fp, 0::UBIGINT) AS fp FROM r LEFT JOIN fps USING ({keys}))"""


def mode_cte(order_tuple: str, descending: bool) -> str:
    agg, tie = ("min", "DESC") if descending else ("max", "ASC")
    return (f"cen AS (SELECT fp AS cen, c AS cen_count FROM (SELECT fp, count(*) AS c, {agg}(({order_tuple})) AS l "
            f"FROM f GROUP BY fp) ORDER BY c DESC, l {tie} LIMIT 1)")


MAJORITY_CTE = """cen AS (SELECT sum(CASE WHEN 2 * ones > n THEN (1::HUGEINT << b::HUGEINT) ELSE 0::HUGEINT END)::UBIGINT AS cen
    FROM (SELECT b, sum(((fp::HUGEINT >> b::HUGEINT) & 1::HUGEINT)::BIGINT) AS ones, count(*) AS n
          FROM f, range(64) g(b) GROUP BY b))"""

STATS_CTE = """st AS (SELECT count(*) AS n, sum(content_length)::DOUBLE / count(*) AS mean,
    sqrt((count(*)::HUGEINT * sum(content_length::HUGEINT * content_length)
          - sum(content_length)::HUGEINT * sum(content_length)::HUGEINT)::DOUBLE) / count(*) AS sd0 FROM f),
sf AS (SELECT status_code, count(*) AS status_count FROM f GROUP BY status_code),
tf AS (SELECT content_type, count(*) AS type_count FROM f GROUP BY content_type),
x AS (SELECT f.*,
    least(abs(content_length - mean) / ((CASE WHEN sd0 = 0 THEN 1.0::DOUBLE ELSE sd0 END) * 3.0::DOUBLE), 1.0::DOUBLE) AS lo,
    1.0::DOUBLE - status_count / n::DOUBLE AS sr, 1.0::DOUBLE - type_count / n::DOUBLE AS tr,
    bit_count(xor(fp, cen)::BIT) AS hd
  FROM f JOIN sf USING (status_code) JOIN tf USING (content_type), st, cen),
ranked AS (SELECT *, CAST(round(((lo + sr + tr) / 3.0::DOUBLE * 0.5::DOUBLE
    + hd / 64.0::DOUBLE * 0.5::DOUBLE) * 100.0::DOUBLE) AS INTEGER) AS rank FROM x)"""

RESULT = "id, rank, method, url, status_code, content_length, content_type, location"


def scan_rank_ctes(centroid: str = "mode") -> str:
    cen = mode_cte("created_at, id", True) if centroid == "mode" else MAJORITY_CTE
    return (f"WITH {HISTORY},\nhsrc AS (SELECT * FROM history),\n"
            f"{features_ctes('id, created_at', 'id')},\n{cen},\n{STATS_CTE}\n")


SCAN_RANK = scan_rank_ctes()
# the same CTE list, open for more CTEs (", name AS (...)" follows)
SCAN_RANK_MORE = SCAN_RANK.rstrip("\n")

Q: dict[str, str] = {}

# ------------------------------------------------------------ scans / sources
Q["scan_recent"] = f"""WITH {HISTORY}
SELECT id, created_at, method, url, status_code FROM history ORDER BY created_at DESC, id DESC LIMIT 500"""

Q["scan_filtered"] = f"""WITH {HISTORY}
SELECT id, created_at, url, location FROM history WHERE method = 'POST' AND status_code = 302"""

Q["scan_limit"] = f"""WITH {HISTORY}
SELECT id, created_at, status_code FROM history WHERE status_code >= 400
ORDER BY created_at DESC, id DESC LIMIT 1000"""

Q["scan_body_filter"] = f"""WITH {HISTORY}
SELECT id, created_at, status_code FROM history WHERE coalesce(contains(body, 'the'), FALSE) AND has_response
ORDER BY created_at DESC, id DESC LIMIT 200"""

Q["keyset_page"] = f"""WITH {HISTORY},
first_page AS (SELECT created_at, id FROM history ORDER BY created_at DESC, id DESC LIMIT 1000),
cursor AS (SELECT min((created_at, id)) AS k FROM first_page)
SELECT id, created_at FROM history WHERE (created_at, id) < (SELECT k FROM cursor)
ORDER BY created_at DESC, id DESC LIMIT 1000"""

Q["selection_union"] = f"""WITH {LABEL_LISTS},
u AS (SELECT id, 0 AS src, pos FROM main_ids UNION ALL SELECT id, 1 AS src, pos FROM extra_ids),
v AS (SELECT * FROM u WHERE id IS NOT NULL AND CAST(id AS VARCHAR) <> ''),
g AS (SELECT id, min(src) AS s FROM v GROUP BY id)
SELECT v.id, CAST(g.s AS INTEGER) AS src, CAST(min(v.pos) AS BIGINT) AS pos
FROM v JOIN g ON v.id = g.id AND v.src = g.s GROUP BY v.id, g.s"""

_URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_HOST = r"^([^@]*@)?(\[[^\]]*\]|[^:]*)(:([0-9]*))?$"


def _host_sql(u: str) -> str:
    return f"nullif(lower(regexp_extract(regexp_extract({u}, '{_URI}', 4), '{_HOST}', 2)), '')"


Q["scope_filter"] = f"""WITH {HISTORY},
scope AS (SELECT DISTINCT {_host_sql('url')} AS host FROM pages WHERE starts_with(url, 'https://'))
SELECT id, url FROM history WHERE {_host_sql('url')} IN (SELECT host FROM scope WHERE host IS NOT NULL)"""

Q["url_parts"] = f"""SELECT page_id,
  nullif(lower(regexp_extract(url, '{_URI}', 2)), '') AS scheme,
  {_host_sql('url')} AS host,
  CASE WHEN regexp_extract(regexp_extract(url, '{_URI}', 4), '{_HOST}', 4) <> ''
       THEN CAST(regexp_extract(regexp_extract(url, '{_URI}', 4), '{_HOST}', 4) AS INTEGER)
       WHEN lower(regexp_extract(url, '{_URI}', 2)) = 'http' THEN 80
       WHEN lower(regexp_extract(url, '{_URI}', 2)) = 'https' THEN 443 END AS port,
  regexp_extract(url, '{_URI}', 5) AS path,
  CASE WHEN regexp_extract(url, '{_URI}', 6) = '' THEN NULL ELSE regexp_extract(url, '{_URI}', 7) END AS query,
  lower(regexp_extract(regexp_extract(url, '{_URI}', 5), '\\.([A-Za-z0-9]+)$', 1)) AS ext
FROM pages"""

# ------------------------------------------------- filters / functions
Q["drop_no_response"] = f"""WITH {HISTORY}
SELECT id, coalesce(method, '') AS method, coalesce(status_code, 0) AS status_code,
  CAST(coalesce(strlen(body), 0) AS BIGINT) AS content_length FROM history WHERE has_response"""

Q["mime_normalise"] = f"""WITH {HISTORY}
SELECT content_type_header, {MIME.format(h='content_type_header')} AS content_type, count(*) AS n
FROM history GROUP BY content_type_header"""

Q["tokens"] = """SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens,
  len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents"""

Q["fnv64"] = f"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
SELECT token, {hex_sql(f"CAST({fnv_sql('token')} AS UBIGINT)")} AS fnv FROM words"""

_DOC_FP = f"""WITH {simhash_ctes('documents', 'doc_id', 'text')}
SELECT d.doc_id, {hex_sql('coalesce(fps.fp, 0::UBIGINT)')} AS fingerprint
FROM documents d LEFT JOIN fps USING (doc_id)"""
Q["simhash_udf"] = _DOC_FP
Q["simhash_native"] = _DOC_FP

# ------------------------------------------------------------ aggregates
_RESP = f"""WITH {HISTORY},
f AS (SELECT coalesce(status_code, 0) AS status_code, CAST(coalesce(strlen(body), 0) AS BIGINT) AS content_length,
  {MIME.format(h='content_type_header')} AS content_type FROM history WHERE has_response)"""

Q["status_freq"] = _RESP + "\nSELECT status_code, count(*) AS status_count FROM f GROUP BY status_code"
Q["type_freq"] = _RESP + "\nSELECT content_type, count(*) AS type_count FROM f GROUP BY content_type"
Q["length_stats"] = _RESP + """,
m AS (SELECT count(*) AS n, sum(content_length)::HUGEINT AS s1, sum(content_length::HUGEINT * content_length) AS s2 FROM f),
v AS (SELECT n, s1, sqrt((n::HUGEINT * s2 - s1 * s1)::DOUBLE) / n AS sd0 FROM m)
SELECT n, CAST(s1 AS BIGINT) AS sum_length, s1::DOUBLE / n AS mean_length,
  CASE WHEN sd0 = 0 THEN 1.0::DOUBLE ELSE sd0 END AS sd_length FROM v"""

Q["centroid_mode"] = SCAN_RANK + f"SELECT {hex_sql('cen')} AS centroid, cen_count AS centroid_count FROM cen"
Q["centroid_majority"] = scan_rank_ctes("majority") + f"SELECT {hex_sql('cen')} AS centroid FROM cen"
Q["profile"] = SCAN_RANK + f"""SELECT n, mean AS mean_length, CASE WHEN sd0 = 0 THEN 1.0::DOUBLE ELSE sd0 END AS sd_length,
  {hex_sql('cen')} AS centroid FROM st, cen"""

# ------------------------------------------------------------ scoring parts
Q["hamming_to_centroid"] = SCAN_RANK + f"SELECT id, {hex_sql('fp')} AS fingerprint, CAST(hd AS INTEGER) AS hamming FROM ranked"
Q["length_outlier"] = SCAN_RANK + "SELECT id, lo AS length_outlier FROM ranked"
Q["rarity"] = SCAN_RANK + "SELECT id, sr AS status_rarity, tr AS type_rarity FROM ranked"

# ------------------------------------------------------------ rank (R1-R3)
Q["rank_scan"] = SCAN_RANK + f"SELECT {RESULT}, created_at FROM ranked"
Q["rank_topk"] = SCAN_RANK + f"SELECT {RESULT}, created_at FROM ranked ORDER BY rank DESC, created_at DESC, id DESC LIMIT 25"
Q["rank_majority"] = scan_rank_ctes("majority") + f"SELECT {RESULT}, created_at FROM ranked"
Q["rank_native"] = Q["rank_scan"]

Q["rank_pages"] = (f"WITH {PAGES_HISTORY},\nhsrc AS (SELECT * FROM history),\n"
                   f"{features_ctes('id', 'id')},\n{mode_cte('id', False)},\n{STATS_CTE}\n"
                   f"SELECT {RESULT} FROM ranked")

Q["rank_ids"] = (f"WITH {HISTORY},\n{LABEL_LISTS},\n"
                 f"ids AS (SELECT id, 0 AS src, pos FROM main_ids UNION ALL SELECT id, 1 AS src, pos FROM extra_ids),\n"
                 f"hsrc AS (SELECT h.* EXCLUDE (created_at), CAST(i.src AS INTEGER) AS src, i.pos FROM ids i JOIN history h ON h.id = i.id),\n"
                 f"{features_ctes('id, src, pos', 'src, pos')},\n{mode_cte('src, pos', False)},\n{STATS_CTE}\n"
                 f"SELECT {RESULT}, src, pos FROM ranked")

Q["rank_scan_limit"] = (
    f"WITH {HISTORY},\n"
    f"hsrc AS (SELECT * FROM history WHERE has_response AND method = 'GET' ORDER BY created_at DESC, id DESC LIMIT 300),\n"
    f"{features_ctes('id, created_at', 'id')},\n{mode_cte('created_at, id', True)},\n{STATS_CTE}\n"
    f"SELECT {RESULT}, created_at FROM ranked")

# ------------------------------------------------------------ result views
_CATEGORY = """CASE WHEN status_code >= 500 THEN 'red' WHEN status_code >= 400 THEN 'amber'
  WHEN status_code >= 300 THEN 'olive'
  WHEN status_code >= 200 AND (contains(lower(content_type), 'application/json') OR contains(lower(content_type), '+json')) THEN 'green'
  WHEN status_code >= 200 AND (contains(lower(content_type), 'application/xml') OR contains(lower(content_type), 'text/xml')
       OR contains(lower(content_type), '+xml')) AND NOT contains(lower(content_type), 'image/svg') THEN 'blue'
  WHEN status_code >= 200 AND (contains(lower(content_type), 'text/html') OR contains(lower(content_type), 'application/xhtml+xml')) THEN 'cyan'
  ELSE 'none' END"""
_COLOR = """CASE category WHEN 'red' THEN '#a32f2a' WHEN 'amber' THEN '#a06008' WHEN 'olive' THEN '#8a7a06'
  WHEN 'green' THEN '#157a37' WHEN 'blue' THEN '#0b4ea8' WHEN 'cyan' THEN '#1f7aa8' ELSE 'transparent' END"""

Q["row_category"] = SCAN_RANK_MORE + f""",
cat AS (SELECT id, rank, {_CATEGORY} AS category FROM ranked)
SELECT id, rank, category, {_COLOR} AS color, rank > 70 AS is_high FROM cat"""

Q["high_rank"] = SCAN_RANK + "SELECT rank > 70 AS is_high, count(*) AS n FROM ranked GROUP BY ALL"

Q["user_sort_page"] = SCAN_RANK + """SELECT id, content_length, rank FROM ranked
ORDER BY content_length ASC, rank DESC, created_at DESC, id DESC LIMIT 50 OFFSET 100"""

Q["targets_selected"] = SCAN_RANK.replace("WITH ", f"WITH {LABEL_LISTS},\n", 1) + \
    "SELECT id, rank FROM ranked WHERE id IN (SELECT id FROM main_ids)"

# ------------------------------------------------------------ sinks
Q["export_csv_projection"] = SCAN_RANK + """SELECT rank AS "Rank", method AS "Method", status_code AS "Status",
  content_length AS "Length", content_type AS "Type", url AS "URL" FROM ranked"""

Q["curl_lines"] = SCAN_RANK_MORE + f""",
raw AS (SELECT id, method || ' / HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || coalesce({_host_sql('url')}, '')
    || chr(13) || chr(10) || 'X-Id: ' || CAST(id AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || 'body' AS raw FROM history),
j AS (SELECT r.id, r.url, string_split(w.raw, chr(13) || chr(10)) AS lines FROM ranked r JOIN raw w USING (id)
      WHERE w.raw IS NOT NULL AND w.raw <> ''),
k AS (SELECT id, url, lines, list_position(lines, '') AS blank FROM j)
SELECT id, 'curl -X ' || split_part(lines[1], ' ', 1) || ' '
  || array_to_string(list_transform(lines[2:CASE WHEN blank > 0 THEN blank - 1 ELSE len(lines) END],
                                    lambda h: '-H "' || h || '"'), ' ')
  || ' "' || url || '"' AS curl FROM k"""

Q["url_list"] = SCAN_RANK + "SELECT id, url FROM ranked"
Q["wordlist"] = SCAN_RANK + "SELECT DISTINCT url FROM ranked WHERE url <> ''"

Q["run_summary"] = SCAN_RANK + """SELECT count(*) AS total_requests,
  CAST(sum(CASE WHEN rank > 70 THEN 1 ELSE 0 END) AS BIGINT) AS high_requests, max(rank) AS max_rank, 1.5::DOUBLE AS duration_ms FROM ranked"""

Q["stored_run"] = SCAN_RANK + """SELECT id, rank, status_code, count(*) OVER () AS total_requests,
  count(*) FILTER (rank > 70) OVER () AS high_requests, max(rank) OVER () AS max_rank FROM ranked"""

Q["scan_preset"] = f"""WITH {HISTORY}
SELECT id, status_code AS status, CAST(coalesce(strlen(body), 0) AS BIGINT) AS length FROM history
WHERE status_code >= 400 AND coalesce(strlen(body), 0) > 1000 AND created_at IS NOT NULL"""

Q["header_search"] = f"""WITH {HISTORY}
SELECT id, method, status_code FROM history WHERE has_response AND contains('Content-Type: ' || content_type_header, 'Content-Type: text/html')"""

Q["rank_requests"] = SCAN_RANK + f"SELECT {RESULT}, created_at FROM ranked"

Q["rank_prefix"] = (f"WITH {HISTORY},\nhsrc AS (SELECT * FROM history),\n"
                    f"{features_ctes('id, created_at', 'id').replace('lower(body)', 'lower(substr(body, 1, 1000))')},\n"
                    f"{mode_cte('created_at, id', True)},\n{STATS_CTE}\nSELECT {RESULT}, created_at FROM ranked")

Q["profile_grown"] = Q["profile"]

Q["body_search"] = "SELECT doc_id, lang FROM documents WHERE contains(text, 'the tion')"

Q["id_set_digest"] = f"""WITH {LABEL_LISTS},
u AS (SELECT id, 1 AS s FROM main_ids UNION ALL SELECT id, 1 FROM extra_ids UNION ALL SELECT id, -1 FROM main_ids WHERE id IN (SELECT id FROM extra_ids)),
h AS (SELECT s, sha256(CAST(id AS VARCHAR)) AS x FROM u),
l AS (SELECT sum(s)::BIGINT AS n, {", ".join(f"sum(s * CAST('0x' || substr(x, {16 * k + 1}, 16) AS UBIGINT)::HUGEINT)::HUGEINT AS l{k}" for k in range(4))} FROM h),
m AS (SELECT n, {", ".join(f"((l{k} % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS l{k}" for k in range(4))} FROM l)
SELECT 'ids:' || sha256(CAST(n AS VARCHAR) || ':' || {" || ':' || ".join(f"CAST(l{k} AS VARCHAR)" for k in range(4))}) AS run_key FROM m"""

Q["user_sort_text"] = SCAN_RANK + """SELECT id, location, rank FROM ranked
ORDER BY location COLLATE NOCASE ASC NULLS LAST, rank DESC, created_at DESC, id DESC LIMIT 200"""

Q["id_set_key"] = f"""WITH {LABEL_LISTS},
u AS (SELECT id FROM main_ids UNION ALL SELECT id FROM extra_ids),
h AS (SELECT CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15)) AS BIGINT) AS v FROM u)
SELECT 'ids:' || sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(CAST(sum(v::HUGEINT) AS HUGEINT) AS VARCHAR)
  || ':' || CAST(bit_xor(v) AS VARCHAR)) AS run_key FROM h"""

# ------------------------------------------------------------ grouped rank (E1)
_NS = "IS NOT DISTINCT FROM"
Q["rank_by_host"] = (
    f"WITH {HISTORY},\nhsrc AS (SELECT *, {_host_sql('url')} AS host FROM history),\n"
    f"{features_ctes('id, created_at, host', 'id')},\n"
    """cen AS (SELECT host, fp AS cen FROM (SELECT host, fp, count(*) AS c, min((created_at, id)) AS l FROM f GROUP BY host, fp)
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY c DESC, l DESC) = 1),
st AS (SELECT host, count(*) AS n, sum(content_length)::DOUBLE / count(*) AS mean,
    sqrt((count(*)::HUGEINT * sum(content_length::HUGEINT * content_length)
          - sum(content_length)::HUGEINT * sum(content_length)::HUGEINT)::DOUBLE) / count(*) AS sd0 FROM f GROUP BY host),
sf AS (SELECT host, status_code, count(*) AS status_count FROM f GROUP BY host, status_code),
tf AS (SELECT host, content_type, count(*) AS type_count FROM f GROUP BY host, content_type),
x AS (SELECT f.*,
    least(abs(content_length - mean) / ((CASE WHEN sd0 = 0 THEN 1.0::DOUBLE ELSE sd0 END) * 3.0::DOUBLE), 1.0::DOUBLE) AS lo,
    1.0::DOUBLE - status_count / n::DOUBLE AS sr, 1.0::DOUBLE - type_count / n::DOUBLE AS tr,
    bit_count(xor(fp, cen)::BIT) AS hd
  FROM f JOIN st ON f.host IS NOT DISTINCT FROM st.host
         JOIN cen ON f.host IS NOT DISTINCT FROM cen.host
         JOIN sf ON f.host IS NOT DISTINCT FROM sf.host AND f.status_code = sf.status_code
         JOIN tf ON f.host IS NOT DISTINCT FROM tf.host AND f.content_type = tf.content_type),
ranked AS (SELECT *, CAST(round(((lo + sr + tr) / 3.0::DOUBLE * 0.5::DOUBLE
    + hd / 64.0::DOUBLE * 0.5::DOUBLE) * 100.0::DOUBLE) AS INTEGER) AS rank FROM x)
"""
    f"SELECT host, {RESULT}, created_at FROM ranked")

ORACLE_SQL: dict[str, str] = dict(Q)
