"""The SQL twins, for DuckDB, of those queries of this package that SQL can express.

Tokenizing, XXH64, keyed permutations, training and syncmers have none; tests hold those
queries against brute force or a round trip.
"""

from __future__ import annotations

from simjoin.llm.secret_scan import PARTS, SCOPE

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _crc32(text: str) -> str:
    """The CRC-32 of a short text's UTF-8 bytes, bit by bit."""
    shifted = "c"
    for _ in range(8):
        shifted = f"xor(({shifted}) >> 1, (({shifted}) & 1) * 3988292384)" if shifted == "c" else f"list_transform([{shifted}], lambda c: xor(c >> 1, (c & 1) * 3988292384))[1]"
    octets = f"list_transform(range(0, CAST(octet_length(encode({text})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda before, o: list_transform([xor(before, o)], lambda c: {shifted})[1], 4294967295), 4294967295)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(k: int) -> str:
    """The matches of one kind of part with their places."""
    part, pattern = PARTS[k], _quoted(PARTS[k].pattern)
    test = [f"regexp_matches(m, {_quoted(x)})" for x in part.also]
    if part.least:
        test.append(f"length(regexp_extract(m, {pattern}, {part.group})) >= {part.least}")
    return f"""
        SELECT doc_id, {k} AS k, start, start + length(m) AS stop, {part.weak} AS weak, {part.role == "identifier"} AS id, {part.role == "secret"} AS secret
        FROM (SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
              FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS ps, unnest(range(1, len(regexp_extract_all(text, {pattern})) + 1)) AS i FROM t))
        {"WHERE " + " AND ".join(test) if test else ""}
    """


_NAMES = "[" + ", ".join(f"'{p.kind}'" for p in PARTS) + "]"

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
        w AS (SELECT doc_id, s, substr(hx, 2 * s + 1, 200) AS win FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 99)) AS s FROM h)),
        again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
        marked AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g
                   FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
        spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM marked GROUP BY doc_id, g),
        cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
        kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS e, string_agg(substr(hx, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front FROM cut JOIN h USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(front, '') || substr(hx, 2 * coalesce(e, 0) + 1))) AS kept_sha256
        FROM h LEFT JOIN kept USING (doc_id)
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        h AS (SELECT payload_digest, max(page_id) AS holder FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
               CASE WHEN holder IS NOT NULL AND holder IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN holder IS DISTINCT FROM page_id THEN holder END AS refers_to
        FROM d LEFT JOIN h USING (payload_digest)
    """,
    "op6_secrets": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        s AS ({" UNION ALL ".join(_matches(k) for k in range(len(PARTS)))}),
        near AS (SELECT w.doc_id, w.k, w.start, w.stop, w.id, w.secret,
                        bool_or(o.id AND (NOT (w.id OR w.secret) OR NOT (o.start < w.stop AND w.start < o.stop))) AS by_id,
                        bool_or(o.secret AND (NOT (w.id OR w.secret) OR NOT (o.start < w.stop AND w.start < o.stop))) AS by_secret,
                        bool_or(NOT o.weak AND o.start < w.stop AND w.start < o.stop) AS inside
                 FROM s w JOIN s o ON w.doc_id = o.doc_id AND greatest(o.start - w.stop, w.start - o.stop) <= {SCOPE} WHERE w.weak AND (o.id OR o.secret) GROUP BY ALL),
        told AS (SELECT doc_id, k, start, stop FROM s WHERE NOT weak UNION ALL
                 SELECT doc_id, k, start, stop FROM near WHERE CASE WHEN id THEN by_secret AND NOT inside WHEN secret THEN by_id AND NOT inside ELSE by_id AND by_secret END),
        e AS (SELECT *, concat_ws(':', {_NAMES}[k + 1], start, stop) AS said FROM told),
        g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k > 2) AS n_weak,
                     string_agg(said, ',' ORDER BY start, k, stop) FILTER (k <= 2) AS base, string_agg(said, ',' ORDER BY start, k, stop) AS spans FROM e GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak
        FROM t LEFT JOIN g USING (doc_id)
    """,
    "op7_chat": r"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + 12 + 1 + 10 + 1) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(least(len(w), 1), len(w) - 9) + 1)) AS s FROM i)),
        sizes AS (SELECT DISTINCT n FROM win),
        own AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
        hit AS (SELECT doc_id, s, own.n, item_id FROM own JOIN win USING (phrase)),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_repair": f"""
        WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat_ws(':', coalesce(CAST(conv_id AS VARCHAR), ' '), coalesce(CAST(turn AS VARCHAR), ' ')) AS said FROM conversations),
        f AS (SELECT *, CAST({_crc32("said")} AS BIGINT) % 20 AS f FROM r),
        d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE f <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM d),
        x AS (SELECT *, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(core, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM n),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
                          count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM x GROUP BY conv_id),
        ins(a, b, more, letters, added) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
        way(a, b, goes) AS (VALUES (0, 0, 'd'), (1, 1, 'd'), (2, 2, 'd'), (3, 3, 'd'), (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
        p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, b AS st, CAST(more AS BIGINT) AS cost, letters AS audit, CAST(added AS VARCHAR[]) AS said FROM (SELECT DISTINCT conv_id FROM x), ins WHERE a = 0
              UNION ALL
              SELECT conv_id, i, st, cost, audit, said FROM (
                SELECT x.conv_id, x.i, ins.b AS st, p.cost + more + CASE WHEN goes = 'd' THEN 2 ELSE CAST(goes <> initial AS BIGINT) + CASE WHEN cut THEN 5 ELSE 0 END END AS cost,
                       p.audit || CASE WHEN goes = 'd' THEN 'D' WHEN goes = initial THEN 'K' ELSE 'R' END || letters AS audit,
                       list_concat(list_concat(p.said, CASE WHEN goes = 'd' THEN [] ELSE [CASE WHEN goes = initial THEN role WHEN goes = 'u' THEN 'user' ELSE 'assistant' END || ':' || text] END), added) AS said
                FROM p JOIN x ON x.conv_id = p.conv_id AND x.i = p.i + 1 JOIN way ON way.a = p.st JOIN ins ON ins.a = way.b WHERE goes = 'd' OR (NOT blank AND NOT again AND (goes <> 's' OR initial = 's')))
              QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
        best AS (SELECT p.conv_id, cost, audit, said FROM p JOIN counts ON p.conv_id = counts.conv_id AND p.i = counts.n WHERE st IN (0, 3) QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost, audit) = 1)
        SELECT o.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))}, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id)
    """,
    "op12_importance": f"""
        WITH w AS (SELECT doc_id, unnest({_WORDS}) AS f FROM documents),
        v AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
        b AS (SELECT f, CAST({_crc32("f")} AS BIGINT) % 10000 AS b FROM (SELECT f FROM w UNION SELECT f FROM v)),
        s AS (SELECT b, count(*) AS s FROM w JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM v JOIN b USING (f) GROUP BY b),
        n AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
        g AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b), n),
        weighed AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN b USING (f) JOIN g USING (b) GROUP BY doc_id),
        scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN weighed USING (doc_id)),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM r) // 100 THEN r END AS rank FROM scored LEFT JOIN r USING (doc_id)
    """,
    "op13_line_dedup": r"""
        WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                   FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
        f AS (SELECT key, min(doc_id) AS holder FROM l WHERE length(key) >= 10 GROUP BY key),
        m AS (SELECT doc_id, i, line, holder IS NOT NULL AND holder <> doc_id AS gone FROM l LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
    """,
}
