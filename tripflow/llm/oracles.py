"""The SQL that DuckDB runs on the same tables.

What has none: op1, op4 and op9 (walks and compressed lengths), op3 (XXH64), op7 (a schedule laid out step by step), op8
(SHA-256 networks over matches that need look-around) and the pipeline built from them. Their tests compare them with
brute force, held-out labels or round trips.
"""

from tripflow.llm import graph, ranked, topk, urls, variants

_RULES = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
_FITS = "\n        ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}'"
    for host, path, _ in _RULES
)
_RULED = " ".join(f"WHEN '{host}{path}' THEN '{verdict}'" for host, path, verdict in _RULES)


# The last labels of a name that make a registered domain and its suffix.
_KNOWN = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
_LABELS = f"CASE WHEN array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') IN ({_KNOWN}) THEN 2 ELSE 1 END"


def _shrunk(groups: str, above: str, join: str, columns: str) -> str:
    """Posterior of each group by the prior of the level above; the same steps as in urls.py."""
    return f"""
    SELECT {columns}, (g.good + s.strength * a.mean) / (g.n + s.strength) AS mean, g.n + s.strength AS weight
    FROM {groups} g JOIN {above} a ON {join}
    CROSS JOIN (
        SELECT least(greatest(max(m * (1 - m)) / greatest(sum(n * (good / n - m) * (good / n - m)) / sum(n)
                - count(*) * max(m * (1 - m)) / sum(n), 1e-9) - 1, {urls.WEAKEST}), {urls.STRONGEST}) AS strength
        FROM (SELECT g.n::DOUBLE AS n, g.good::DOUBLE AS good, a.mean AS m FROM {groups} g JOIN {above} a ON {join})
    ) s"""


URL_REPUTATION = rf"""
WITH parsed AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), judged AS (
    SELECT *, CASE {_FITS} END AS rule,
        try_cast(nullif(regexp_extract(path, '.*/([0-9]{{1,18}})(?:[.]html)?/?$', 1), '') AS BIGINT) AS number,
        regexp_replace(host, '^[^/]*@|:[0-9]*\z|[.]+(:[0-9]*)?\z', '', 'g') AS name
    FROM parsed
), placed AS (
    SELECT *, regexp_matches(name, '^([0-9]+([.][0-9]+)*|\[[^/]*)\z') AS address, {_LABELS} AS labels
    FROM judged
), leveled AS (
    SELECT * EXCLUDE (labels),
        CASE WHEN address THEN name ELSE array_to_string(list_slice(string_split(name, '.'), -labels - 1, -1), '.') END AS domain,
        CASE WHEN address THEN '{urls.ADDRESSES}' ELSE array_to_string(list_slice(string_split(name, '.'), -labels, -1), '.') END AS suffix
    FROM placed
), known AS (
    SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id
), hosts AS (
    SELECT name, domain, suffix, count(*) AS n, sum(good) AS good
    FROM (SELECT DISTINCT page_id, name, domain, suffix, number FROM leveled) j JOIN known ON number = doc_id
    GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL
), whole AS (
    SELECT (coalesce(sum(good), 0) + {2 * urls.PRIOR_GOOD}) / (coalesce(sum(n), 0) + 2) AS mean,
        coalesce(sum(n), 0) + 2.0 AS weight
    FROM suffixes
), s AS ({_shrunk("suffixes", "whole", "true", "g.suffix")}
), d AS ({_shrunk("domains", "s", "g.suffix = a.suffix", "g.domain")}
), h AS ({_shrunk("hosts", "d", "g.domain = a.domain", "g.name")}
), estimated AS (
    SELECT j.*, coalesce(h.mean, d.mean, s.mean, w.mean)::DOUBLE AS mean,
        coalesce(h.weight, d.weight, s.weight, w.weight)::DOUBLE AS weight
    FROM leveled j CROSS JOIN whole w
    LEFT JOIN h ON h.name = j.name LEFT JOIN d ON d.domain = j.domain LEFT JOIN s ON s.suffix = j.suffix
)
SELECT page_id, host, path, rule, coalesce(CASE rule {_RULED} END,
    CASE WHEN mean + {urls.BOUND_SD} * sqrt(mean * (1 - mean) / (weight + 1)) < {urls.LEAST_GOOD}
        THEN 'block' ELSE 'allow' END) AS verdict
FROM estimated
"""

TOPK = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
    FROM v q JOIN v ON v.vec_id <> q.vec_id
    WHERE q.vec_id % {topk.QUERY_EVERY} = 0
)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
)
WHERE rank <= {topk.K}
"""

SUBSTRINGS = r"""
WITH words AS (
    SELECT row_id, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (
        SELECT row_number() OVER () AS row_id, doc_id,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    )
), starts AS (
    SELECT row_id, i, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n
    FROM words WINDOW w AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), twice AS (
    SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY run) AS times FROM starts WHERE n = 35)
    WHERE times > 1
), marked AS (
    SELECT w.row_id, w.word, w.i, max(t.i) OVER (PARTITION BY w.row_id ORDER BY w.i) AS last_start
    FROM words w LEFT JOIN twice t ON t.row_id = w.row_id AND t.i = w.i
), kept AS (
    SELECT row_id, count(*) AS n_words, count(*) FILTER (i - last_start < 35) AS n_removed,
        coalesce(string_agg(word, ' ' ORDER BY i) FILTER (last_start IS NULL OR i - last_start >= 35), '') AS kept
    FROM marked GROUP BY row_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents) d LEFT JOIN kept USING (row_id)
"""

REVISITS = r"""
WITH p AS (
    SELECT page_id AS n, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag,
        1700000000 + ((page_id % 1000 + 1000) % 1000) * 3600 AS t0,
        regexp_replace(regexp_replace(lower(regexp_replace(url, '#.*$', '')), '^https?://(www[0-9]*[.])?', ''),
            '^([^/?]*):(80|443)([/?]|$)', '\1\3') AS bare
    FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL
), c AS (
    SELECT *, regexp_replace(split_part(bare, '?', 1), '/+$', '') AS path,
        list_sort(list_filter(
            CASE WHEN contains(bare, '?') THEN string_split(regexp_replace(bare, '^[^?]*\?', ''), '&') ELSE [] END,
            lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[a-z]+|sid|sessionid|jsessionid|phpsessid)='))) AS args
    FROM p
), r AS (
    SELECT *, CASE WHEN len(args) > 0 THEN path || '?' || array_to_string(args, '&') ELSE path END AS canon,
        strftime(make_timestamp((t0 - 86400) * 1000000), '%Y-%m-%d %H:%M:%S') AS modified,
        n::VARCHAR || '-0' AS rid
    FROM c
), v AS (
    SELECT r.*, k AS visit, t0 + CASE k WHEN 1 THEN 86400 WHEN 2 THEN 172800 WHEN 3 THEN -3600 ELSE 7200 END AS t,
        CASE WHEN n % 5 <> 0 AND k = 1 THEN '"' || tag || CASE WHEN n % 7 = 0 THEN 'x' ELSE '' END || '"'
            WHEN n % 5 <> 0 AND k = 2 THEN 'W/"' || tag || '"' END AS etag,
        CASE WHEN n % 5 <> 0 AND k = 3 THEN modified
            WHEN n % 5 <> 0 AND k = 4 THEN modified || CASE WHEN n % 7 = 0 THEN 'x' ELSE '' END END AS lm
    FROM r CROSS JOIN (VALUES (1), (2), (3), (4)) AS x(k)
), found AS (
    SELECT v.n, v.visit, max({'t': r.t0, 'rid': r.rid}) AS best
    FROM v JOIN r ON r.canon = v.canon AND r.t0 <= v.t GROUP BY ALL
), j AS (
    SELECT v.*, f.best.rid AS refers_to, r.t0 AS r0, '"' || r.tag || '"' AS r_etag, r.modified AS r_lm, r.html AS r_html,
        CASE WHEN f.best IS NULL THEN 'missing'
            WHEN v.etag IS NOT NULL THEN
                CASE WHEN regexp_replace(v.etag, '^W/', '') = '"' || r.tag || '"' THEN 'resolved' ELSE 'mismatch' END
            WHEN v.lm IS NOT NULL THEN CASE WHEN v.lm = r.modified THEN 'resolved' ELSE 'mismatch' END
            ELSE 'unvalidated' END AS outcome
    FROM v LEFT JOIN found f ON f.n = v.n AND f.visit = v.visit LEFT JOIN r ON r.rid = f.best.rid
)
SELECT n AS page_id, visit, url, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS visited_at, outcome,
    refers_to, strftime(make_timestamp(r0 * 1000000), '%Y-%m-%d %H:%M:%S') AS refers_to_at,
    CASE WHEN outcome IN ('resolved', 'unvalidated') THEN
        'cache-control: max-age=3600' || chr(10) || 'content-length: ' || strlen(r_html)::VARCHAR || chr(10)
        || 'content-type: text/html; charset=utf-8' || chr(10) || 'etag: ' || coalesce(etag, r_etag) || chr(10)
        || 'last-modified: ' || coalesce(lm, r_lm) || chr(10) || 'x-visit: ' || visit::VARCHAR END AS headers,
    CASE WHEN outcome IN ('resolved', 'unvalidated') THEN md5(r_html) END AS body_md5
FROM j
"""

RANKED_SEARCH = rf"""
WITH terms AS (
    SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{variants.UPPER}', '{variants.LOWER}'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS row FROM documents)
), asked AS (
    SELECT item_id, term, count(*) AS q FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, '{variants.UPPER}', '{variants.LOWER}'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
    GROUP BY ALL
), lengths AS (SELECT row, doc_id, count(*) AS n FROM terms GROUP BY ALL
), whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), tfs AS (SELECT row, term, count(*) AS tf FROM terms GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2.0 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tfs, whole GROUP BY term, n_docs
), scored AS (
    SELECT item_id, doc_id, row,
        sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (row), whole
    WHERE doc_id IS NOT NULL GROUP BY ALL
), placed AS (
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM placed WHERE rank <= {ranked.K}
"""

# All pairs; the graph finds nearly all of them, and on tables as small as those of the comparison each.
NEAR_VECTORS = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0 AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {graph.NEAR}
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
JOIN (SELECT e.vec_id, count(b) AS n_links FROM embeddings e LEFT JOIN links ON a = e.vec_id GROUP BY ALL) USING (vec_id)
"""

SPELLING_VARIANTS = rf"""
WITH RECURSIVE byte_crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), runs AS (
    SELECT doc_id, translate(run, '{variants.UPPER}', '{variants.LOWER}') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
    WHERE length(run) >= {variants.MIN_LETTERS} GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(named)),
            lambda i: ('0x' || substr(hex(encode(named)), 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
    FROM (SELECT *, doc_id || ':' || run AS named FROM runs), byte_crc
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % {variants.DELETE_EVERY} = 0
            THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word
        FROM hashed)
    WHERE length(word) >= {variants.MIN_LETTERS} GROUP BY word HAVING sum(n) >= {variants.MIN_TIMES}
), cuts AS (
    SELECT word, n, place, left(word, place - 1) || substr(word, place + 1) AS cut
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)
), pairs AS (
    SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n
    FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.place = b.place AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), best AS (
    SELECT word, count(*) AS n_near, min(struct_pack(minus := -near_n, near := near)) AS best FROM pairs GROUP BY word
), known AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -best.minus >= {variants.RATIO} * w.n THEN best.near END AS form,
        CASE WHEN -best.minus >= {variants.RATIO} * w.n THEN -best.minus END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), chains AS (
    SELECT word, word AS root, 0 AS steps FROM known
    UNION ALL SELECT c.word, k.form, c.steps + 1 FROM chains c JOIN known k ON c.root = k.word WHERE k.form IS NOT NULL
)
SELECT k.word, form, root, k.n, n_near, form_n
FROM known k JOIN (SELECT word, max_by(root, steps) AS root FROM chains GROUP BY word) c ON k.word = c.word
"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_reputation": URL_REPUTATION,
    "op5_topk": TOPK,
    "op6_substrings": SUBSTRINGS,
    "op10_revisits": REVISITS,
    "op11_ranked": RANKED_SEARCH,
    "op12_near_vectors": NEAR_VECTORS,
    "op13_variants": SPELLING_VARIANTS,
}
