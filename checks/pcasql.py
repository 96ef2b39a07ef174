"""Comparison SQL of principal components: alternating least squares as recursive queries."""

from __future__ import annotations

from checks.sqltext import rnd
from lodestat.sources import testbed

COLUMNS = [f"{m}, {f}" for m in testbed.METALS.values() for f in ("Total", "Dissolved")]


def _scaled(row: str, keys: str) -> str:
    """Cells centred and divided by their column's sample SD; a constant column has none."""
    return f"""SELECT r, c, (v - avg(v) OVER (PARTITION BY c)) / nullif(stddev_samp(v) OVER (PARTITION BY c), 0) AS v
      FROM (SELECT {row} AS r, parameter AS c, avg(rvalue) AS v FROM storm GROUP BY {keys}
            HAVING avg(rvalue) IS NOT NULL)"""


SITE_CELLS = _scaled("stream", "stream, parameter")
YEARLY_CELLS = _scaled("stream || '/' || year", "stream, parameter, year")


SIZE = len(COLUMNS)


def _listed(table: str) -> str:
    """Rows as lists: x with 0 for a missing cell, s tells the others apart."""
    cell = "sum(v) FILTER (c = '{c}')"
    x = ", ".join(f"coalesce({cell.format(c=c)}, 0)" for c in COLUMNS)
    s = ", ".join(f"CAST({cell.format(c=c)} IS NOT NULL AS DOUBLE)" for c in COLUMNS)
    return f"SELECT g, r, [{x}] AS x, [{s}] AS s FROM {table} GROUP BY g, r"


def _score(p: str) -> str:
    return f"list_dot_product(x.x, {p}) / nullif(list_dot_product(x.s, list_transform({p}, lambda z: z * z)), 0)"


def _fit(n: int, rounds: int) -> list[str]:
    """Loadings of the first component of the rows pc_x<n> of each table g, as a list, after each round."""
    new = ", ".join(f"coalesce(sum(t * x[{j}]) / nullif(sum(t * t * s[{j}]), 0), 0)" for j in range(1, SIZE + 1))
    return [f"""pc_i{n} AS (SELECT DISTINCT g, 0 AS i, list_transform(range({SIZE}), lambda z: CAST(1 AS DOUBLE)) AS p FROM pc_x{n}
      UNION ALL SELECT g, i + 1, list_transform(q, lambda z: z / sqrt(list_dot_product(q, q))) FROM (
        SELECT g, i, [{new}] AS q FROM (SELECT x.g, i, x, s, {_score("p")} AS t
          FROM pc_i{n} JOIN pc_x{n} x USING (g) WHERE i < {rounds}) GROUP BY g, i))""",
            f"pc_p{n} AS MATERIALIZED (SELECT g, p FROM pc_i{n} WHERE i = {rounds})",
            f"pc_t{n} AS MATERIALIZED (SELECT x.g, r, x, s, p, {_score('p')} AS t FROM pc_x{n} x JOIN pc_p{n} USING (g))"]


def nipals_sql(cells: str, rounds) -> str:
    """Loadings of a component for each number of rounds; each is taken out of the cells before the next."""
    parts = [f"pc_c AS (SELECT 0 AS g, * FROM ({cells}) WHERE v IS NOT NULL)", f"pc_x1 AS MATERIALIZED ({_listed('pc_c')})"]
    for n, limit in enumerate(rounds, start=1):
        left = ", ".join(f"x[{j}] - t * p[{j}] * s[{j}]" for j in range(1, SIZE + 1))
        parts += [*_fit(n, limit), f"pc_x{n + 1} AS MATERIALIZED (SELECT g, r, [{left}] AS x, s FROM pc_t{n})"]
    names = ", ".join(f"'{c}'" for c in COLUMNS)
    found = " UNION ALL ".join(f"SELECT {n} AS component, unnest([{names}]) AS c, unnest(p) AS p FROM pc_p{n}"
                               for n in range(1, len(rounds) + 1))
    loading = rnd("p * sign(arg_max(p, abs(p)) OVER (PARTITION BY component))", "loading")
    return f'WITH {", ".join(parts)} SELECT c AS "column", CAST(component AS INTEGER) AS component, {loading} FROM ({found})'


def q2_sql(cells: str, folds: int, rounds: int = 600) -> str:
    """Cross-validated share of the first component; a cell's fold is taken from a hash of its place."""
    at = "CASE c " + " ".join(f"WHEN '{c}' THEN {j}" for j, c in enumerate(COLUMNS)) + " END"
    parts = [f"""pc_all AS MATERIALIZED (SELECT *, {at} AS j,
                 CAST('0x' || substr(md5(r || '/' || ({at})), 1, 8) AS BIGINT) % {folds} AS f
                 FROM ({cells}) WHERE v IS NOT NULL)""",
             f"pc_c AS (SELECT g, r, c, v FROM pc_all, range({folds}) a(g) WHERE f <> g)",
             f"pc_x1 AS MATERIALIZED ({_listed('pc_c')})", *_fit(1, rounds)]
    miss = "power(v - coalesce(t * p[j + 1], 0), 2)"
    return f"""WITH {", ".join(parts)} SELECT 'nipals' AS method, CAST(1 AS INTEGER) AS components,
      {rnd(f"1 - sum({miss}) / sum(v * v)", "q2")}
      FROM pc_all a LEFT JOIN pc_t1 t ON t.g = a.f AND t.r = a.r"""
