"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op2_line_dedup": r"""
        WITH parts AS (
            SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
        ), lines AS (
            SELECT doc_id, i, ls[i] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)
        ), words AS (
            SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
            FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
        ), runs AS (
            SELECT doc_id, pos, x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c FROM words
            WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
        ), later AS (
            SELECT doc_id, pos FROM (
                SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM runs WHERE c IS NOT NULL
            ) WHERE k > 1
        ), gone AS (
            SELECT DISTINCT w.doc_id, w.i FROM words w JOIN (
                SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM later
            ) r ON w.doc_id = r.doc_id AND w.pos = r.pos
        ), kept AS (
            SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS text
            FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id
        )
        SELECT p.doc_id,
               (SELECT count(*) FROM words w WHERE w.doc_id = p.doc_id)::BIGINT AS n_lines,
               (SELECT count(*) FROM gone g WHERE g.doc_id = p.doc_id)::BIGINT AS n_removed_lines,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM parts p LEFT JOIN kept k ON p.doc_id = k.doc_id
    """,
    "op8_substring_dedup": r"""
        WITH parts AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
        ), windows AS (
            SELECT doc_id, i, list_aggregate(ws[i:i + 19], 'string_agg', ' ') AS x
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM parts)
        ), later AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later
        ), words AS (
            SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM parts)
        ), kept AS (
            SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text, count(*) AS n
            FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id
        )
        SELECT p.doc_id, len(p.ws)::BIGINT AS n_words, (len(p.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM parts p LEFT JOIN kept k ON p.doc_id = k.doc_id
    """,
    "op11_source_divergence": r"""
        WITH base AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), terms AS (
            SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base
        ), kept AS (
            SELECT lang, term, count(*)::HUGEINT AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30
        ), counts AS (
            SELECT lang, source, term, count(*)::HUGEINT AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), langs AS (
            SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
        ), groups AS (
            SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce(c.total, 0) AS total
            FROM (SELECT DISTINCT lang, source FROM base) g LEFT JOIN langs l USING (lang)
            LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source) c USING (lang, source)
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
                   1 + (1000000000 * (k.n + 5)) // (g.lang_total + 5 * g.v) AS q
            FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
        ), apart AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ), found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.f, 0) AS f FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS k FROM found
        )
        SELECT lang, source, part, item, f::BIGINT AS value, k::INTEGER AS rank FROM ranked WHERE part = 'pair' OR k <= 50
    """,
    "op12_prefix_trie": r"""
        WITH named AS (
            SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), turns AS (
            SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM named
        ), bytes AS (
            SELECT DISTINCT c, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bs FROM named
        ), ids AS (
            SELECT c, c - c % 100 AS b, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bs), lambda r, x:
                list_reduce(list_concat([xor(r, x)], range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 6 AS h FROM bytes
        ), rebuilt AS (
            SELECT i.c, 0 AS part, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.c = i.b AND t.pos < i.h
            UNION ALL SELECT i.c, 1, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.c = i.c AND t.pos >= i.h
        ), paths AS (
            SELECT i.c, coalesce(list(struct_pack(role := u.role, text := u.text) ORDER BY u.part, u.pos) FILTER (u.role IS NOT NULL), []) AS path
            FROM ids i LEFT JOIN rebuilt u ON u.c = i.c GROUP BY i.c
        ), prefixes AS (
            SELECT c, d, list_slice(path, 1, d) AS k, d = len(path) AS last FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths)
        ), nodes AS (
            SELECT k, d, min(c) AS owner, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM prefixes GROUP BY k, d
        ), up AS (
            SELECT k, d, owner, n, ends, list_slice(k, 1, d - 1) AS above, coalesce(len(k[d].text), 0) AS chars FROM nodes
        ), kids AS (
            SELECT above AS k, count(*) AS n FROM up WHERE d > 0 GROUP BY above
        ), own AS (
            SELECT u.*, coalesce(c.n, 0) AS children, (u.n - 1) * u.chars AS saved FROM up u LEFT JOIN kids c ON c.k = u.k
        ), sums AS (
            SELECT a AS k, sum((children = 0)::BIGINT) AS leaves, sum(saved) AS saved
            FROM (SELECT children, saved, list_slice(k, 1, j) AS a FROM (SELECT children, saved, k, unnest(range(0, d + 1)) AS j FROM own)) GROUP BY a
        )
        SELECT o.owner AS conv_id, o.d::BIGINT AS depth, CASE WHEN o.d > 0 THEN p.owner END AS parent_conv_id, o.n::BIGINT AS n_convs, o.children::BIGINT AS n_children,
               s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
        FROM own o JOIN sums s ON s.k = o.k LEFT JOIN nodes p ON p.k = o.above
    """,
    "op13_secret_scan": r"""
        WITH rules(place, kind, rx) AS (VALUES
            (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
            (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'), (4, 'code_host', 'gh[oprsu]_[A-Za-z0-9]{36,}'),
            (5, 'chat', 'xox[abprs]-[A-Za-z0-9-]{10,}'), (6, 'api', 'AIza[0-9A-Za-z_-]{35}'),
            (7, 'web_token', 'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}'), (8, 'bearer', '[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}'),
            (9, 'address', '[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,64}@')
        ), split AS (
            SELECT doc_id, place, kind, rx, string_split_regex(t, rx) AS gaps, regexp_extract_all(t, rx) AS hits FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), rules
        ), each AS (
            SELECT doc_id, place, kind, rx, i, len(gaps[i]) AS gap, hits[i] AS hit FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM split)
        ), placed AS (
            SELECT *, sum(gap + len(hit)) OVER (PARTITION BY doc_id, place ORDER BY i) AS e FROM each
        ), good AS (
            SELECT doc_id, place, kind, e - len(hit) AS s, kind || ':' || (e - len(hit))::BIGINT || ':' || e::BIGINT AS said FROM placed
            WHERE CASE place WHEN 0 THEN len(regexp_extract(hit, rx, 2)) >= 8 WHEN 1 THEN len(hit) >= 16 WHEN 2 THEN len(hit) >= 32 ELSE true END
        ), told AS (
            SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
                   string_agg(said, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg(said, ',' ORDER BY s, place) AS spans
            FROM good GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN told t USING (doc_id)
    """,
}
