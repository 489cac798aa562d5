"""The SQL twins of ``simjoin.queries``, for DuckDB over the same tables."""

from __future__ import annotations

import numpy as np

from simjoin.functions import hashing
from simjoin.queries import CENTROIDS, CUTS, FITTED, REACH, SCALE, SHIFTS, TABLES, K

DIM = 64


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def _l2(x: str, y: str) -> str:
    """float32 differences, a float64 sum of squares, a float32 root."""
    d = "CAST(p[1] - p[2] AS DOUBLE)"
    return f"CAST(sqrt(list_sum(list_transform(list_zip({x}, {y}), lambda p: {d} * {d}))) AS FLOAT)"


def _pairs(where: str = "q.vec_id % 10 = 0") -> str:
    return f"SELECT q.vec_id AS query_id, q.label AS query_class, s.vec_id AS db_id, s.label AS db_class, {_l2('q.embedding', 's.embedding')} AS d FROM embeddings q, embeddings s WHERE {where}"


def _nearest(pairs: str, k: int = K) -> str:
    return f"""
        SELECT query_id, query_class, CAST(r AS INTEGER) AS rank, db_id, round(CAST(d AS DOUBLE), 5) AS distance, db_class
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, db_id) AS r FROM ({pairs})) WHERE r <= {k}
    """


NAIVE = _nearest(_pairs())

# --- pivots: the vectors of id 0, 25, 50, ... below 500, numbered in that order ----------
_PIVOTS = "pv AS (SELECT vec_id // 25 AS pno, embedding FROM embeddings WHERE vec_id % 25 = 0 AND vec_id < 500)"
_TO_PIVOTS = f"{_PIVOTS}, dp AS (SELECT e.vec_id, pno, {_l2('e.embedding', 'pv.embedding')} AS d FROM embeddings e, pv), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, pno) AS r FROM dp)"
_CELLS = f"{_TO_PIVOTS}, cells AS (SELECT vec_id, pno AS pivot_id, d, true AS is_database FROM ranked WHERE r = 1 UNION ALL SELECT vec_id, pno, d, false FROM ranked WHERE r = 1 AND vec_id % 10 = 0)"
_BETWEEN = f"pp AS (SELECT a.pno AS a, b.pno AS b, CAST({_l2('a.embedding', 'b.embedding')} AS DOUBLE) AS d FROM pv a, pv b)"
_STATIC = """
    s1 AS (SELECT 0 AS p),
    s2 AS (SELECT b AS p FROM pp WHERE a IN (SELECT p FROM s1) AND b NOT IN (SELECT p FROM s1) GROUP BY b ORDER BY sum(d) DESC, b LIMIT 1),
    t2 AS (FROM s1 UNION ALL FROM s2),
    s3 AS (SELECT b AS p FROM pp WHERE a IN (SELECT p FROM t2) AND b NOT IN (SELECT p FROM t2) GROUP BY b ORDER BY sum(d) DESC, b LIMIT 1),
    t3 AS (FROM t2 UNION ALL FROM s3),
    s4 AS (SELECT b AS p FROM pp WHERE a IN (SELECT p FROM t3) AND b NOT IN (SELECT p FROM t3) GROUP BY b ORDER BY sum(d) DESC, b LIMIT 1),
    t4 AS (FROM t3 UNION ALL FROM s4)
"""

# Four groups of cells: seeds far apart, then the lightest group takes its nearest free cell.
_GROUPS = f"""
    {_BETWEEN},
    m AS (SELECT list(r ORDER BY a) AS dist FROM (SELECT a, list(d ORDER BY b) AS r FROM pp GROUP BY a)),
    wt AS (SELECT list(coalesce(n, 0) * {DIM} ORDER BY pno) AS w FROM pv LEFT JOIN (SELECT pivot_id, count(*) AS n FROM cells WHERE NOT is_database GROUP BY 1) ON pivot_id = pno),
    sd AS (SELECT 1 AS n, [(SELECT a FROM pp GROUP BY a ORDER BY sum(d) DESC, a LIMIT 1)] AS seeds, list_transform(dist, lambda x: CAST(0 AS DOUBLE)) AS total FROM m
           UNION ALL
           SELECT n + 1, list_append(seeds, CAST(list_position(masked, list_max(masked)) - 1 AS BIGINT)), total
           FROM (SELECT n, seeds, total, list_transform(range(len(total)), lambda i: CASE WHEN list_contains(seeds, i) THEN -1 ELSE total[i + 1] END) AS masked
                 FROM (SELECT n, seeds, list_transform(range(len(dist)), lambda i: total[i + 1] + dist[seeds[n] + 1][i + 1]) AS total FROM sd, m WHERE n < 4))),
    gr AS (SELECT 4 AS n, list_transform(range(len(dist)), lambda i: coalesce(list_position(seeds, i), 0) - 1) AS grp, list_transform(seeds, lambda i: w[i + 1]) AS load FROM sd, m, wt WHERE n = 4
           UNION ALL
           SELECT n + 1, list_transform(range(len(grp)), lambda i: CASE WHEN i + 1 = p THEN g ELSE grp[i + 1] END), list_transform(range(4), lambda i: load[i + 1] + CASE WHEN i = g THEN w[p] ELSE 0 END)
           FROM (SELECT n, grp, load, w, g, list_position(sums, list_min(sums)) AS p
                 FROM (SELECT n, grp, load, w, g, list_transform(range(len(grp)), lambda i: CASE WHEN grp[i + 1] >= 0 THEN 1e300 ELSE list_sum(list_transform(range(len(grp)), lambda c: CASE WHEN grp[c + 1] = g THEN dist[i + 1][c + 1] ELSE 0 END)) END) AS sums
                       FROM (SELECT n, grp, load, w, dist, list_position(load, list_min(load)) - 1 AS g FROM gr, m, wt WHERE n < len(dist))))),
    gg AS (SELECT unnest(range(len(grp))) AS cell, unnest(grp) AS group_id FROM gr, m WHERE n = len(dist))
"""

# --- lineitem as vectors: the same statements over other vectors, pivots and queries ------
_ITEMS = """
    embeddings AS (SELECT (l_orderkey * 8 + l_linenumber) * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS vec_id, l_linenumber AS label,
                          [CAST(l_quantity / 50 AS FLOAT), CAST(l_extendedprice / 100000 AS FLOAT), CAST(l_discount * 10 AS FLOAT), CAST(l_tax * 12.5 AS FLOAT)] AS embedding FROM lineitem)
"""
_ITEM_PIVOTS = "pv AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pno, embedding FROM embeddings WHERE vec_id // 134217728 < 300 AND vec_id // 16777216 % 8 = 1)"


def _of_items(statement: str) -> str:
    return statement.replace(_PIVOTS, _ITEM_PIVOTS).replace("vec_id % 10 = 0", "vec_id // 134217728 % 20 = 0")


def _item(side: str, vec_id: str) -> str:
    return f"CAST({vec_id} // 134217728 AS INTEGER) AS {side}_order, CAST({vec_id} // 16777216 % 8 AS INTEGER) AS {side}_line, CAST({vec_id} % 16777216 AS INTEGER) AS {side}_cents"


# Of each query cell: the farthest query, and the bound on its neighbours' distances.
_BOUNDS = f"""
    held AS (SELECT pivot_id, CAST(d AS DOUBLE) AS d FROM (SELECT *, row_number() OVER (PARTITION BY pivot_id ORDER BY d, vec_id) AS r FROM cells WHERE is_database) WHERE r <= {K}),
    asked AS (SELECT pivot_id AS c, CAST(max(d) AS DOUBLE) AS far FROM cells WHERE NOT is_database GROUP BY 1),
    most AS (SELECT c, far, u FROM (SELECT c, far, far + pp.d + held.d AS u, row_number() OVER (PARTITION BY c ORDER BY far + pp.d + held.d) AS r FROM asked JOIN pp ON pp.a = c JOIN held ON held.pivot_id = pp.b) WHERE r = {K}),
    own AS (SELECT vec_id, pivot_id, CAST(d AS DOUBLE) AS d, group_id AS home FROM cells JOIN gg ON gg.cell = pivot_id WHERE is_database)
"""
_less, _more = (lambda x: f"({x} - 1e-5 * (1 + abs({x})))"), (lambda x: f"({x} + 1e-5 * (1 + abs({x})))")
_COPIES = _of_items(f"""
    WITH RECURSIVE {_ITEMS}, {_CELLS}, {_GROUPS}, {_STATIC}, {_BOUNDS},
    st AS (SELECT vec_id, list(CAST(d AS DOUBLE) ORDER BY pno) AS sd FROM dp WHERE pno IN (SELECT p FROM t4) GROUP BY 1),
    region AS (SELECT is_database, pivot_id, [min(sd[1]), min(sd[2]), min(sd[3]), min(sd[4])] AS lo, [max(sd[1]), max(sd[2]), max(sd[3]), max(sd[4])] AS hi, CAST(max(d) AS DOUBLE) AS far FROM cells JOIN st USING (vec_id) GROUP BY 1, 2),
    box AS (SELECT c, list_transform(lo, lambda x: {_less("(x - u)")}) AS lo, list_transform(hi, lambda x: {_more("(x + u)")}) AS hi FROM most JOIN region ON pivot_id = c AND NOT is_database),
    pairs AS (SELECT pp.b AS p, c, group_id, {_less("(pp.d - most.far - u)")} AS low FROM most JOIN pp ON pp.a = c JOIN gg ON gg.cell = c),
    bound AS (SELECT p, group_id, min(low) AS x FROM pairs GROUP BY 1, 2),
    hull AS (SELECT p, group_id, min(low) AS x, [min(box.lo[1]), min(box.lo[2]), min(box.lo[3]), min(box.lo[4])] AS lo, [max(box.hi[1]), max(box.hi[2]), max(box.hi[3]), max(box.hi[4])] AS hi
             FROM pairs JOIN box USING (c) JOIN region r ON r.pivot_id = p AND r.is_database
             WHERE low <= r.far AND box.lo[1] <= r.hi[1] AND box.lo[2] <= r.hi[2] AND box.lo[3] <= r.hi[3] AND box.lo[4] <= r.hi[4] AND box.hi[1] >= r.lo[1] AND box.hi[2] >= r.lo[2] AND box.hi[3] >= r.lo[3] AND box.hi[4] >= r.lo[4] GROUP BY 1, 2),
    b AS (SELECT g AS group_id, count(*) AS by_bound FROM own JOIN (SELECT DISTINCT group_id AS g FROM gg) ON true LEFT JOIN bound ON p = pivot_id AND group_id = g WHERE home = g OR d >= x GROUP BY 1),
    r AS (SELECT g AS group_id, count(*) AS by_region FROM own JOIN st USING (vec_id) JOIN (SELECT DISTINCT group_id AS g FROM gg) ON true LEFT JOIN hull ON p = pivot_id AND group_id = g
          WHERE home = g OR (d >= x AND sd[1] BETWEEN lo[1] AND hi[1] AND sd[2] BETWEEN lo[2] AND hi[2] AND sd[3] BETWEEN lo[3] AND hi[3] AND sd[4] BETWEEN lo[4] AND hi[4]) GROUP BY 1)
    SELECT CAST(group_id AS INTEGER) AS group_id, by_bound, by_region FROM b JOIN r USING (group_id)
""")
_EXCLUDED = _of_items(f"""
    WITH {_ITEMS}, {_CELLS}, {_BETWEEN},
    held AS (SELECT pivot_id, CAST(d AS DOUBLE) AS d FROM (SELECT *, row_number() OVER (PARTITION BY pivot_id ORDER BY d, vec_id) AS r FROM cells WHERE is_database) WHERE r <= {K}),
    q AS MATERIALIZED (SELECT vec_id, pno AS home, CAST(d AS DOUBLE) AS hd FROM ranked WHERE r = 1 AND vec_id % 10 = 0),
    own AS MATERIALIZED (SELECT q.vec_id, home, hd, pno, CAST(dp.d AS DOUBLE) AS d FROM q JOIN dp USING (vec_id)),
    reach AS MATERIALIZED (SELECT vec_id, min(own.d + held.d, {K})[{K}] AS u FROM own JOIN held ON pivot_id = pno GROUP BY 1),
    c AS (SELECT vec_id, pno, home, own.d, hd, pp.d AS b, u + 1e-5 * (1 + u) AS r FROM own JOIN reach USING (vec_id) JOIN pp ON pp.a = home AND pp.b = pno WHERE pno IN (SELECT pivot_id FROM held))
    SELECT {_item("query", "vec_id")}, count(*) AS cells, count(*) FILTER (pno <> home AND (d - hd) / 2 > r) AS by_difference, count(*) FILTER (pno <> home AND b > 0 AND (d * d - hd * hd) / (2 * b) > r) AS by_plane FROM c GROUP BY vec_id
""")
_ITEM_NEAREST = f"""
    WITH v AS (SELECT (l_orderkey * 8 + l_linenumber) * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS vec_id, CAST(l_quantity / 50 AS FLOAT) AS a, CAST(l_extendedprice / 100000 AS FLOAT) AS b, CAST(l_discount * 10 AS FLOAT) AS c, CAST(l_tax * 12.5 AS FLOAT) AS d FROM lineitem),
    near AS (SELECT q.vec_id AS query_id, min({{'d': CAST(sqrt(pow(CAST(q.a - s.a AS DOUBLE), 2) + pow(CAST(q.b - s.b AS DOUBLE), 2) + pow(CAST(q.c - s.c AS DOUBLE), 2) + pow(CAST(q.d - s.d AS DOUBLE), 2)) AS FLOAT), 'id': s.vec_id}}, {K}) AS best FROM v q, v s WHERE q.vec_id // 134217728 % 20 = 0 GROUP BY 1)
    SELECT {_item("query", "query_id")}, {_item("db", "best[i].id")}, CAST(i AS INTEGER) AS rank, round(CAST(best[i].d AS DOUBLE), 5) AS distance FROM (SELECT query_id, best, unnest(range(1, len(best) + 1)) AS i FROM near)
"""

# --- curves ------------------------------------------------------------------------------
_COORDS = "list_transform(list_zip(embedding, moved), lambda p: CAST(floor((CAST(p[1] AS DOUBLE) - low) * {scale}) AS BIGINT) + p[2])"
_ON_CURVES = f"""
    low AS (SELECT min(CAST(list_min(embedding) AS DOUBLE)) AS low FROM embeddings),
    shifts AS (SELECT unnest([{", ".join(f"{{'shift': {i}, 'moved': {s}}}" for i, s in enumerate(SHIFTS))}], recursive := true)),
    coords AS (SELECT vec_id, label, embedding, shift, {_COORDS.format(scale=SCALE)} AS c FROM embeddings, low, shifts),
    curve AS (SELECT *, array_to_string(list_transform(range(31, -1, -1), lambda b: array_to_string(list_transform(c, lambda x: CAST((x >> b) & 1 AS VARCHAR)), '')), '') AS z FROM coords)
"""


def _curve(distance: str) -> str:
    k = K * REACH
    return f"""
        WITH {_ON_CURVES},
        line AS (SELECT shift, vec_id, z, row_number() OVER (PARTITION BY shift ORDER BY z, vec_id) AS at, count(*) OVER (PARTITION BY shift) AS n FROM curve),
        q AS (SELECT a.shift, a.vec_id, any_value(a.n) AS n, count(b.vec_id) AS place FROM line a LEFT JOIN line b ON a.shift = b.shift AND b.z < a.z WHERE a.vec_id % 10 = 0 GROUP BY 1, 2),
        w AS (SELECT shift, vec_id, greatest(1, least(place - {k} + 1, n - {2 * k} + 1)) AS lo FROM q),
        cand AS (SELECT DISTINCT w.vec_id AS query_id, line.vec_id AS db_id FROM w JOIN line ON w.shift = line.shift AND line.at BETWEEN lo AND lo + {2 * k - 1}),
        plain AS (SELECT vec_id, label, embedding, c FROM coords WHERE shift = 0),
        d AS (SELECT query_id, a.label AS query_class, db_id, b.label AS db_class, {distance} AS d FROM cand JOIN plain a ON a.vec_id = query_id JOIN plain b ON b.vec_id = db_id)
        {_nearest("FROM d")}
    """


# A curve's ranges end at the places of the vectors CUTS; part: how many of these lie before.
_BUCKETS = f"""
    WITH {_ON_CURVES},
    parts AS (SELECT c.shift, c.vec_id, count(e.z) AS part FROM curve c LEFT JOIN (SELECT DISTINCT shift, z FROM curve WHERE vec_id IN {CUTS}) e ON e.shift = c.shift AND e.z < c.z GROUP BY 1, 2),
    cand AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS db_id FROM parts a JOIN parts b ON a.shift = b.shift AND abs(a.part - b.part) <= 1 WHERE a.vec_id % 10 = 0 AND a.shift < 3),
    d AS (SELECT query_id, a.label AS query_class, db_id, b.label AS db_class, {_l2("a.embedding", "b.embedding")} AS d FROM cand JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = db_id)
    {_nearest("FROM d")}
"""


# --- hash tables -------------------------------------------------------------------------
def _hash(t: int, f: int) -> str:
    terms = f"list_zip(embedding, {_list(TABLES.a[t, f])}, {_list(TABLES.mean)}, {_list(TABLES.std)})"
    return f"CAST(floor((list_sum(list_transform({terms}, lambda p: p[2] * ((CAST(p[1] AS DOUBLE) - p[3]) / p[4]))) + {float(TABLES.b[t, f])!r}) / {TABLES.w!r}) AS BIGINT)"


_SIGNED = "signed AS (" + " UNION ALL ".join(f"SELECT vec_id, label, embedding, {t} AS table_id, concat_ws(',', {', '.join(_hash(t, f) for f in range(TABLES.b.shape[1]))}) AS signature FROM embeddings" for t in range(len(TABLES.b))) + ")"
_LSH = f"SELECT DISTINCT q.vec_id AS query_id, q.label AS query_class, s.vec_id AS db_id, s.label AS db_class, {_l2('q.embedding', 's.embedding')} AS d FROM signed q JOIN signed s USING (table_id, signature) WHERE q.vec_id % 10 = 0"


def _fitted() -> str:
    """The hash functions of FITTED, on vectors scored by the table's own means and deviations."""
    made = hashing.generated(DIM, FITTED.tables, FITTED.functions, FITTED.w, np.zeros(DIM), np.ones(DIM), FITTED.seed)
    one = lambda t, f: f"CAST(floor((list_sum(list_transform(list_zip(z, {_list(made.a[t, f])}), lambda p: p[1] * p[2])) + {float(made.b[t, f])!r}) / {made.w!r}) AS BIGINT)"
    signed = " UNION ALL ".join(f"SELECT vec_id, label, embedding, {t} AS table_id, concat_ws(',', {', '.join(one(t, f) for f in range(FITTED.functions))}) AS signature FROM scored" for t in range(FITTED.tables))
    return f"""
        WITH dims AS (SELECT dim, avg(CAST(embedding[dim + 1] AS DOUBLE)) AS mean, stddev_pop(CAST(embedding[dim + 1] AS DOUBLE)) AS std FROM embeddings, (SELECT unnest(range({DIM})) AS dim) GROUP BY 1),
        stats AS (SELECT list(mean ORDER BY dim) AS mean, list(std ORDER BY dim) AS std FROM dims),
        scored AS (SELECT vec_id, label, embedding, list_transform(list_zip(embedding, mean, std), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) / p[3]) AS z FROM embeddings, stats),
        signed AS ({signed})
        {_nearest(_LSH)}
    """


_MEASURES = {"distance_diff": "dd", "precision": "pr", "distance_ratio": "ra", "effective_error": "ee", "avg_effective_error": "ae"}

# --- records of small whole numbers ------------------------------------------------------
_WHOLE = f"""
    whole AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(round(CAST(v AS DOUBLE) * 10) AS INTEGER)) AS v FROM embeddings),
    rec AS (SELECT vec_id, label, v, list_filter(range({DIM}), lambda i: v[i + 1] <> 0 OR i = {DIM - 1}) AS b FROM whole)
"""
_ROWS = f"SELECT l_suppkey AS id, (SELECT list_position(ds, list_min(ds)) - 1 FROM (SELECT [{', '.join('(' + ' + '.join(f'({c} - {float(v)!r}) * ({c} - {float(v)!r})' for c, v in zip(('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'), row, strict=True)) + ')' for row in np.asarray(CENTROIDS).tolist())}] AS ds)) AS cluster FROM lineitem"

ORACLES: dict[str, str] = {
    **dict.fromkeys(("knn_naive", "knn_pivot_exact", "knn_pivot_eps_1", "knn_pivot_approx_full", "knn_query_rep_full", "knn_curve_one_bucket"), NAIVE),
    "knn_self_join": _nearest(_pairs("true")),
    "nearest_pivots": f"WITH {_TO_PIVOTS} SELECT vec_id, CAST(r AS INTEGER) AS rank, CAST(pno AS INTEGER) AS pivot, round(CAST(d AS DOUBLE), 5) AS dist FROM ranked WHERE r <= 3",
    "voronoi_stats": f"""
        WITH {_CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY pivot_id, is_database ORDER BY d, vec_id) AS r FROM cells)
        SELECT CAST(pivot_id AS INTEGER) AS pivot_id, is_database, round(CAST(min(d) AS DOUBLE), 5) AS min_dist, round(CAST(max(d) AS DOUBLE), 5) AS max_dist, count(*) AS n,
               CAST(count(*) * {DIM} AS BIGINT) AS size, CAST(least(count(*), {K}) AS INTEGER) AS held, round(CAST(max(d) FILTER (r <= {K}) AS DOUBLE), 5) AS last_held
        FROM o GROUP BY pivot_id, is_database
    """,
    "cut_regions": f"""
        WITH {_CELLS}, {_BETWEEN}, {_STATIC}
        SELECT CAST(pivot_id AS INTEGER) AS pivot_id, is_database, CAST(dp.pno AS INTEGER) AS static_pivot, round(CAST(min(dp.d) AS DOUBLE), 5) AS min_dist, round(CAST(max(dp.d) AS DOUBLE), 5) AS max_dist
        FROM cells JOIN dp USING (vec_id) WHERE dp.pno IN (SELECT p FROM t4) GROUP BY 1, 2, 3
    """,
    "reverse_nearest_pivots": f"WITH {_PIVOTS}, {_BETWEEN} SELECT CAST(b AS INTEGER) AS pivot, CAST(a AS INTEGER) AS has_it_near FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM pp) WHERE r <= 3",
    "cell_groups": f"WITH RECURSIVE {_CELLS}, {_GROUPS} SELECT CAST(cell AS INTEGER) AS pivot, CAST(group_id AS INTEGER) AS group_id FROM gg",
    "pivot_copies": f"""
        WITH RECURSIVE {_CELLS}, {_GROUPS},
        held AS (SELECT pivot_id, CAST(d AS DOUBLE) AS d FROM (SELECT *, row_number() OVER (PARTITION BY pivot_id ORDER BY d, vec_id) AS r FROM cells WHERE is_database) WHERE r <= {K}),
        asked AS (SELECT pivot_id AS c, CAST(max(d) AS DOUBLE) AS far FROM cells WHERE NOT is_database GROUP BY 1),
        most AS (SELECT c, far, u FROM (SELECT c, far, far + pp.d + held.d AS u, row_number() OVER (PARTITION BY c ORDER BY far + pp.d + held.d) AS r FROM asked JOIN pp ON pp.a = c JOIN held ON held.pivot_id = pp.b) WHERE r = {K}),
        low AS (SELECT pp.b AS p, group_id, min(pp.d - far - u) AS x FROM most JOIN pp ON pp.a = c JOIN gg ON gg.cell = c GROUP BY 1, 2),
        own AS (SELECT vec_id, pivot_id, CAST(d AS DOUBLE) AS d, group_id AS home FROM cells JOIN gg ON gg.cell = pivot_id WHERE is_database)
        SELECT CAST(g AS INTEGER) AS group_id, count(*) AS n FROM own JOIN (SELECT DISTINCT group_id AS g FROM gg) ON true LEFT JOIN low ON low.p = pivot_id AND low.group_id = g
        WHERE home = g OR d >= x - 1e-5 * (1 + abs(x)) GROUP BY 1
    """,
    "items_exact": _ITEM_NEAREST,
    "items_index": _ITEM_NEAREST,
    "item_copies": _COPIES,
    "item_cells_excluded": _EXCLUDED,
    "query_upper_bounds": f"""
        WITH {_CELLS}, held AS (SELECT pivot_id, d FROM (SELECT *, row_number() OVER (PARTITION BY pivot_id ORDER BY d, vec_id) AS r FROM cells WHERE is_database) WHERE r <= {K}),
        reach AS (SELECT dp.vec_id, CAST(dp.d AS DOUBLE) + CAST(held.d AS DOUBLE) AS u FROM dp JOIN held ON held.pivot_id = dp.pno WHERE dp.vec_id % 10 = 0)
        SELECT vec_id AS query_id, round(u, 4) AS upper_bound FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY u) AS r FROM reach) WHERE r = {K}
    """,
    "zorder_values": f"""
        WITH {_ON_CURVES}
        SELECT vec_id, CAST(shift AS INTEGER) AS shift, md5(z) AS z_md5,
               md5(array_to_string(list_transform(range(0, length(z), 4), lambda i: substr('0123456789abcdef', CAST(8 * CAST(substr(z, i + 1, 1) AS INTEGER) + 4 * CAST(substr(z, i + 2, 1) AS INTEGER) + 2 * CAST(substr(z, i + 3, 1) AS INTEGER) + CAST(substr(z, i + 4, 1) AS INTEGER) + 1 AS BIGINT), 1)), '')) AS z_hex_md5,
               md5(array_to_string(c, ',')) AS coords_md5
        FROM curve
    """,
    "knn_curve_window": _curve(_l2("a.embedding", "b.embedding")),
    "knn_curve_z_only": _curve(f"CAST(sqrt(list_sum(list_transform(list_zip(a.c, b.c), lambda p: (CAST(p[1] - p[2] AS DOUBLE) / {SCALE}) * (CAST(p[1] - p[2] AS DOUBLE) / {SCALE})))) AS FLOAT)"),
    "knn_curve_buckets": _BUCKETS,
    "knn_lsh_fitted": _fitted(),
    "static_pivots": f"WITH {_TO_PIVOTS}, {_BETWEEN}, {_STATIC} SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS static, CAST(p AS INTEGER) AS pivot FROM t4",
    "eps_guarantee": f"SELECT query_id, rank, true AS holds FROM ({NAIVE})",
    "parameter_sweep": " UNION ALL ".join(
        f"SELECT stat, round(value, 4) AS value, method, {k} AS k, 30 AS max_rec_depth, CAST(1.0 AS DOUBLE) AS filter_ratio, 30 AS pivot_count, 4 AS reducers FROM (SELECT stat, value FROM (SELECT avg(CAST(d AS DOUBLE)) AS AVG, max(CAST(d AS DOUBLE)) AS MAX FROM (SELECT d, row_number() OVER (PARTITION BY query_id ORDER BY d, db_id) AS r FROM ({_pairs()})) WHERE r = {k}) UNPIVOT (value FOR stat IN (AVG, MAX))), (SELECT unnest(['EXACT', 'APPROX', 'QUERY_REP']) AS method)"
        for k in (5, 8)
    ),
    "kmeans_cost": f"SELECT round(sum(d) / count(*) / 1e6, 6) AS mean_error, count(*) AS n FROM ({_ROWS.replace('SELECT list_position(ds, list_min(ds)) - 1 FROM', 'SELECT list_min(ds) FROM').replace(') AS cluster FROM', ') AS d FROM')})",
    "lsh_signatures": f"WITH {_SIGNED} SELECT vec_id, CAST(table_id AS INTEGER) AS table_id, signature FROM signed",
    "knn_lsh": f"WITH {_SIGNED} {_nearest(_LSH, 5)}",
    "dimension_stats": f"""
        SELECT CAST(dim AS INTEGER) AS dim, round(avg(CAST(embedding[dim + 1] AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(embedding[dim + 1] AS DOUBLE)), 6) AS std, count(*) AS n
        FROM embeddings, (SELECT unnest(range({DIM})) AS dim) GROUP BY 1
    """,
    "precision_eval": f"""
        WITH {_SIGNED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, db_id) AS r FROM ({_pairs()}) QUALIFY r <= 5),
        c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, db_id) AS r FROM ({_LSH}) QUALIFY r <= 5),
        common AS (SELECT b.query_id, greatest(b.r, c.r) AS r, count(*) AS n FROM b JOIN c USING (query_id, db_id) GROUP BY 1, 2),
        e AS (SELECT b.query_id, b.r AS k, CAST(b.d AS DOUBLE) AS bd, CAST(c.d AS DOUBLE) AS cd, CASE WHEN b.d = 0 THEN CAST(c.d AS DOUBLE) + 1 ELSE CAST(c.d AS DOUBLE) / CAST(b.d AS DOUBLE) END AS ee FROM b JOIN c USING (query_id, r)),
        m AS (SELECT query_id, k, cd - bd AS dd, ee, avg(ee) OVER w AS ae, CASE WHEN sum(cd) OVER w = 0 THEN 1 ELSE sum(bd) OVER w / sum(cd) OVER w END AS ra,
                     coalesce((SELECT sum(n) FROM common WHERE common.query_id = e.query_id AND common.r <= e.k), 0) / CAST(k AS DOUBLE) AS pr
              FROM e WINDOW w AS (PARTITION BY query_id ORDER BY k)),
        t AS (SELECT CAST(greatest((SELECT count(DISTINCT query_id) FROM b), (SELECT count(DISTINCT query_id) FROM c)) AS DOUBLE) AS total)
        SELECT CAST(k AS INTEGER) AS k, {", ".join(f"round(min({c}), 4) AS {n}_min, round(max({c}), 4) AS {n}_max, round(sum({c}) / any_value(total), 4) AS {n}_avg" for n, c in _MEASURES.items())}
        FROM m, t GROUP BY k
    """,
    "eval_set_relations": """
        SELECT vec_id AS query_id, CASE WHEN vec_id % 10 = 0 THEN 'compare' ELSE 'base' END AS missing_in
        FROM embeddings WHERE (vec_id % 10 = 0) <> (vec_id % 15 = 0)
    """,
    "kth_distance_stats": f"SELECT round(avg(CAST(d AS DOUBLE)), 4) AS avg_dist, round(CAST(max(d) AS DOUBLE), 4) AS max_dist FROM (SELECT d, row_number() OVER (PARTITION BY query_id ORDER BY d, db_id) AS r FROM ({_pairs()})) WHERE r = {K}",
    "distance_histogram": f"""
        WITH d AS ({_pairs("q.vec_id > s.vec_id")}),
        r AS (SELECT CAST(min(d) AS DOUBLE) AS lo, (CAST(max(d) AS DOUBLE) - CAST(min(d) AS DOUBLE)) / 20 AS w FROM d)
        SELECT round(CAST(CAST(lo + bin * w AS FLOAT) AS DOUBLE), 4) AS step, count(*) AS count
        FROM (SELECT lo, w, least(19, CAST(floor((CAST(d AS DOUBLE) - lo) / w + 0.5) AS INTEGER)) AS bin FROM d, r) GROUP BY bin, lo, w
    """,
    "value_histogram": """
        WITH r AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem)
        SELECT bin, round(lo + bin * w, 4) AS start, count(*) AS count FROM (SELECT lo, w, CAST(floor((l_quantity - lo) / w) AS INTEGER) AS bin FROM lineitem, r) GROUP BY bin, lo, w
    """,
    "min_max": "SELECT round(CAST(min(list_min(embedding)) AS DOUBLE), 6) AS min_value, round(CAST(max(list_max(embedding)) AS DOUBLE), 6) AS max_value FROM embeddings",
    "sub_dimensions": f"""
        WITH {_WHOLE}, s AS (SELECT vec_id, v, list_filter(b, lambda i: i < 16) AS b FROM rec),
        t AS (SELECT vec_id, b, v, coalesce(list_max(b), -1) = 15 AS ends FROM s)
        SELECT vec_id, array_to_string(CASE WHEN ends THEN b ELSE list_append(b, 15) END, ',') AS bins,
               array_to_string(CASE WHEN ends THEN list_transform(b, lambda i: v[i + 1]) ELSE list_append(list_transform(b, lambda i: v[i + 1]), 0) END, ',') AS bin_values FROM t
    """,
    "feature_text_roundtrip": f"""
        WITH {_WHOLE}
        SELECT concat('0_', vec_id) AS id, label AS classification, CAST(len(b) AS INTEGER) AS n_bins, CAST({DIM - 1} AS INTEGER) AS last_bin, CAST(list_sum(v) AS INTEGER) AS total, CAST(0 AS INTEGER) AS other FROM rec
    """,
    "dense_vectors": f"WITH {_WHOLE} SELECT vec_id, array_to_string(v, ',') AS vector FROM rec",
    "sparse_distances": f"""
        WITH {_WHOLE} SELECT a.vec_id, round(CAST(CAST(sqrt(list_sum(list_transform(list_zip(a.v, o.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS FLOAT) AS DOUBLE), 5) AS distance
        FROM rec a, rec o WHERE o.vec_id = 0
    """,
    "knn_sparse": f"WITH {_WHOLE} {_nearest('SELECT q.vec_id AS query_id, q.label AS query_class, s.vec_id AS db_id, s.label AS db_class, CAST(sqrt(list_sum(list_transform(list_zip(q.v, s.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS FLOAT) AS d FROM rec q, rec s WHERE q.vec_id % 10 = 0')}",
    "knn_text_format": f"SELECT query_id, query_class, rank, db_id, CAST(rank AS DOUBLE) AS distance, db_class FROM ({_nearest(_pairs(), 4)})",
    "duplicate_vectors": """
        SELECT s.n AS db_count, q.n AS query_count, vector
        FROM (SELECT md5(text) AS vector, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) s
        JOIN (SELECT md5(text) AS vector, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) q USING (vector)
    """,
    "assign_centroid": f"SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n FROM ({_ROWS}) GROUP BY 1",
    "bow_histogram": f"""
        SELECT id, concat_ws(';', {", ".join(f"count(*) FILTER (cluster = {i})" for i in range(len(CENTROIDS)))}) AS histogram
        FROM ({_ROWS}) GROUP BY id
    """,
}
