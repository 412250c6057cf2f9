"""SQL of the kriging queries: systems of any size, solved by elimination over list columns in a recursive query.

A system is a list of rows, each with its right side at the end. One step of the recursion takes the row whose first entry is
largest as pivot, clears the first column of all other rows, and drops that column; when no row is left, each
pivot row has shrunk to one entry of the solution.
"""

from __future__ import annotations

SHAPES = {
    "Spherical": "CASE WHEN {h} / {a} < 1 THEN CAST(1.5 AS DOUBLE) * {h} / {a} - CAST(0.5 AS DOUBLE) * pow({h} / {a}, 3) ELSE 1 END",
    "Circular": "CASE WHEN {h} / {a} < 1 THEN 1 - 2 / pi() * acos(least({h} / {a}, 1)) + 2 / pi() * least({h} / {a}, 1)"
    " * sqrt(1 - least({h} / {a}, 1) * least({h} / {a}, 1)) ELSE 1 END",
    "Exponential": "1 - exp(-3 * {h} / {a})",
    "Gaussian": "1 - exp(-3 * ({h} / {a}) * ({h} / {a}))",
    "Linear": "least({h} / {a}, 1)",
}
DRIFTS = {"none": ("1",), "LinearDrift": ("1", "u.x", "u.y"), "QuadDrift": ("1", "u.x", "u.y", "u.x * u.x", "u.x * u.y", "u.y * u.y")}


def _shape(h: str) -> str:
    cases = " ".join(f"WHEN '{m}' THEN {e.format(h=h, a='a')}" for m, e in SHAPES.items())
    return f"CASE shape {cases} END"


def fit_ctes(bins: str, by: str = "") -> str:
    """``fits(lag, model, a, nugget, sill, misfit)`` from a query of bins: weighted least squares for every candidate range.

    ``by`` names a column of the bins whose values have fits of their own.
    """
    key = f"{by}, lag" if by else "lag"
    shaped = " UNION ALL ".join(
        f"SELECT {key}, '{m}' AS model, a, w, CAST({e.format(h='h', a='a')} AS DOUBLE) AS f, gamma AS y FROM cand" for m, e in SHAPES.items()
    )
    return f"""cand AS (SELECT b.*, n_pairs / (h * h) AS w, i * lag AS a FROM ({bins}) b, range(1, 13) t(i)),
        shaped AS ({shaped}),
        eq AS (SELECT {key}, model, a, sum(w) AS sw, sum(w * f) AS sf, sum(w * f * f) AS sff, sum(w * y) AS sy, sum(w * f * y) AS sfy
               FROM shaped GROUP BY {key}, model, a),
        free AS (SELECT *, CASE WHEN sw * sff - sf * sf > CAST(1e-9 AS DOUBLE) * sw * sff
                                THEN (sw * sfy - sf * sy) / (sw * sff - sf * sf) END AS c FROM eq),
        base AS (SELECT *, (sy - c * sf) / sw AS c0 FROM free),
        kept AS (SELECT {key}, model, a, sy / sw AS mean_y, CASE WHEN c0 < 0 THEN sfy / sff ELSE c END AS c, greatest(c0, 0) AS c0 FROM base),
        sol AS (SELECT {key}, model, a, mean_y, CASE WHEN c IS NULL OR c < 0 THEN mean_y ELSE c0 END AS nugget,
                       CASE WHEN c IS NULL OR c < 0 THEN 0 ELSE c END AS sill FROM kept),
        score AS (SELECT {key}, model, a, nugget, sill,
                         round(sum(w * pow(y - nugget - sill * f, 2)) / sum(w * pow(y - mean_y, 2)), 9) AS misfit
                  FROM shaped JOIN sol USING ({key}, model, a) GROUP BY ALL),
        fits AS MATERIALIZED (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY {key}, model ORDER BY misfit, a) = 1)"""


def krige_ctes(settings: str, near: str, bins: str, size: int | None = None) -> str:
    """``solved(run_id, cell_id, value, variance)``.

    ``settings``: a query of (run_id, model, lag, type, num_points, distance, f_pts); ``near``: a query of
    (cell_id, rnk, d, x, y, z), places relative to the cell. With ``size``, cells are numbered on through datasets of so many
    cells, and the bins have the number of the dataset as ``part``.
    """

    def terms(model: str) -> str:
        own = [f"CAST({t} AS DOUBLE)" for t in DRIFTS[model]]
        return f"[{', '.join(own)}]"

    drift = f"CASE model WHEN 'LinearDrift' THEN {terms('LinearDrift')} WHEN 'QuadDrift' THEN {terms('QuadDrift')} ELSE {terms('none')} END"
    gamma = f"CASE WHEN h > 0 THEN nu + (1 - nu) * {_shape('h')} ELSE 0 END"
    own = "" if size is None else f"AND f.part = c.cell_id // {size}"
    return f"""{fit_ctes(bins, '' if size is None else 'part')},
        settings AS MATERIALIZED ({settings}),
        near AS MATERIALIZED ({near}),
        places AS MATERIALIZED (SELECT cell_id, list({{'x': x, 'y': y, 'd': d, 'z': z}} ORDER BY rnk) AS nb FROM near GROUP BY cell_id),
        used AS MATERIALIZED (
            SELECT s.*, cell_id, CASE WHEN type = 'variable' THEN least(num_points, len(nb))
                   ELSE greatest(len(list_filter(nb, lambda v: v.d <= distance)), least(f_pts, len(nb))) END AS n
            FROM settings s, places),
        fitted AS MATERIALIZED (
            SELECT c.cell_id, c.model, c.lag, c.n, a, CASE WHEN c.model LIKE '%Drift' THEN 'Linear' ELSE c.model END AS shape,
                   CASE WHEN nugget + sill > 0 THEN nugget / (nugget + sill) ELSE 0 END AS nu, nugget + sill AS total
            FROM (SELECT DISTINCT cell_id, model, lag, n FROM used) c
            JOIN fits f ON f.lag = c.lag AND f.model = CASE WHEN c.model LIKE '%Drift' THEN 'Linear' ELSE c.model END {own}),
        scaled AS MATERIALIZED (
            SELECT f.*, list_transform(nb[:n], lambda v: {{'x': v.x / nb[n].d, 'y': v.y / nb[n].d, 'px': v.x, 'py': v.y, 'd': v.d, 'z': v.z}}) AS nb
            FROM fitted f JOIN places USING (cell_id)),
        parts AS MATERIALIZED (
            SELECT cell_id, model, lag, n, total, list_transform(nb, lambda u: u.z) AS z,
                   list_transform(list_transform(nb, lambda u: u.d), lambda h: {gamma}) AS g0,
                   list_transform(nb, lambda u: {drift}) AS f,
                   list_transform(nb, lambda p: list_transform(list_transform(nb,
                       lambda q: sqrt((p.px - q.px) * (p.px - q.px) + (p.py - q.py) * (p.py - q.py))), lambda h: {gamma})) AS g
            FROM scaled),
        systems_of AS MATERIALIZED (
            SELECT *, list_concat(
                list_transform(g, lambda r, i: list_concat(r, f[i], [g0[i]])),
                list_transform(range(1, len(f[1]) + 1), lambda t: list_concat(list_transform(f, lambda v: v[t]),
                    list_transform(f[1], lambda v: CAST(0 AS DOUBLE)), [CASE WHEN t = 1 THEN CAST(1 AS DOUBLE) ELSE 0 END]))) AS todo
            FROM parts),
        steps AS (
            SELECT cell_id, model, lag, n, todo, CAST([] AS DOUBLE[][]) AS done, CAST(1 AS DOUBLE) AS low FROM systems_of
            UNION ALL
            SELECT cell_id, model, lag, n,
                   list_transform(rest, lambda r: list_transform(p, lambda v, j: r[j + 1] - r[1] * v)),
                   list_append(list_transform(done, lambda r: list_transform(p, lambda v, j: r[j + 1] - r[1] * v)), p), low
            FROM (SELECT *, list_transform(pr[2:], lambda v: v / pr[1]) AS p FROM (
                SELECT cell_id, model, lag, n, done, least(low, abs(todo[pi][1])) AS low, todo[pi] AS pr, list_concat(todo[:pi - 1], todo[pi + 1:]) AS rest FROM (
                    SELECT *, list_position(list_transform(todo, lambda r: abs(r[1])),
                                            list_max(list_transform(todo, lambda r: abs(r[1])))) AS pi
                    FROM steps WHERE len(todo) > 0)))),
        weights AS MATERIALIZED (
            SELECT cell_id, model, lag, n, low, list_transform(done, lambda r: r[1]) AS w FROM steps WHERE len(todo) = 0),
        answers AS MATERIALIZED (
            SELECT s.cell_id, s.model, s.lag, s.n, list_inner_product(w[:s.n], z) AS value,
                   greatest(list_inner_product(w[:s.n], g0) + w[s.n + 1], 0) * total AS variance
            FROM parts s JOIN weights USING (cell_id, model, lag, n)
            -- too few places for the drift, or a singular system (entries are of the order of one)
            WHERE s.n >= len(f[1]) AND low > CAST(1e-12 AS DOUBLE) AND list_max(list_transform(w[:s.n], lambda v: abs(v))) < 1000000),
        solved AS MATERIALIZED (
            SELECT run_id, cell_id, value, variance FROM used JOIN answers USING (cell_id, model, lag, n))"""
