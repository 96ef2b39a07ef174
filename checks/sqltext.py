"""Common table expressions of the comparison SQL."""

from __future__ import annotations

from lodestat.functions.numbers import (
    CDF_DENOMINATOR,
    CDF_NUMERATOR,
    QUANTILE_CENTRE,
    QUANTILE_MIDDLE,
    QUANTILE_TAIL,
)
from lodestat.operators.criteria import CRITERIA


def nudge(digits: int) -> float:
    """Small shift before rounding, so that exact halves do not sit on a rounding boundary."""
    return 3.3 * 10.0 ** -(digits + 2)


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE) + {nudge(digits)!r}, {digits}) + 0.0 AS {name}"


def horner(coefficients, x: str) -> str:
    text = repr(float(coefficients[0]))
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def norm_cdf(z: str) -> str:
    a = f"abs({z})"
    near = f"exp(-{a}*{a}/2) * {horner(CDF_NUMERATOR, a)} / {horner(CDF_DENOMINATOR, a)}"
    frac = f"({a} + 0.65)"
    for step in ("4.0", "3.0", "2.0", "1.0"):
        frac = f"({a} + {step} / {frac})"
    far = f"exp(-{a}*{a}/2) / {frac} / sqrt(2*pi())"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_quantile(p: str) -> str:
    def fit(tables, x):
        return f"({horner(tables[0], x)} / {horner(tables[1], x)})"

    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    outer = (f"(CASE WHEN {r} <= 5 THEN {fit(QUANTILE_MIDDLE, f'({r} - 1.6)')} "
             f"ELSE {fit(QUANTILE_TAIL, f'({r} - 5.0)')} END)")
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * "
            f"{fit(QUANTILE_CENTRE, f'(0.180625 - {q}*{q})')} "
            f"WHEN {q} < 0 THEN -{outer} ELSE {outer} END)")


def criteria_values(rows=CRITERIA) -> str:
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)")
    return ("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
            + ") AS t(parameter, kind, c0, c1, m, b, fixed)")


HUMAN_TEST = [("Zinc, Total", "water", None, None, None, None, 20.0),
              ("Copper, Total", "water", None, None, None, None, 30.0),
              ("Lead, Dissolved", "acute", 1.46203, 0.145712, 1.273, -1.460, None)]

MEAS = """
SELECT 'L' || l_orderkey AS sample, CAST(l_shipdate AS DATE) AS date,
  CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
  CASE WHEN l_returnflag = 'R' THEN 'Routine' ELSE 'wet weather' END AS routine,
  s_name AS locator, n_name AS stream, 'P' || n_regionkey AS "position",
  CASE WHEN n_regionkey % 2 = 0 THEN 'FDL' ELSE 'Other' END AS loc_group, 'Metal' AS metal_org,
  metal || CASE WHEN l_linestatus = 'F' THEN ', Total' ELSE ', Dissolved' END AS parameter,
  metal || ', ICP' AS parmname, CASE WHEN l_quantity >= mdl THEN l_quantity END AS value,
  'ug/L' AS units,
  CASE WHEN l_quantity < mdl THEN '<MDL' WHEN l_quantity < 2 * mdl THEN '<RDL' END AS qual,
  mdl, 2 * mdl AS rdl, p_brand AS textvalue, l_extendedprice / 1000 AS hardness
FROM (SELECT *, CASE WHEN t <= 1 THEN 1.0::DOUBLE WHEN t <= 3 THEN 4.0 WHEN t <= 5 THEN 10.0
        WHEN t <= 7 THEN 20.0 ELSE 60.0 END AS mdl
      FROM (SELECT *, CAST(round(l_tax * 100) AS INTEGER) AS t FROM lineitem)) l
JOIN (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'Copper' WHEN 'SMALL' THEN 'Lead'
        WHEN 'MEDIUM' THEN 'Nickel' WHEN 'PROMO' THEN 'Zinc' WHEN 'STANDARD' THEN 'Iron'
        WHEN 'LARGE' THEN 'Cadmium' END AS metal FROM part) p ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""

OXYGEN = """
SELECT s_name AS locator, CAST(l_shipdate AS DATE) AS date, 4.0 + round(l_discount * 100) AS "do"
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1"""

CHEM = """
SELECT 'L' || l_orderkey AS sample, DATE '1999-01-01' AS date,
  CASE l_linenumber WHEN 1 THEN 'Calcium, Total' WHEN 2 THEN 'Magnesium, Total'
    WHEN 3 THEN 'Calcium, Dissolved' WHEN 4 THEN 'Magnesium, Dissolved' WHEN 5 THEN 'Hardness'
    ELSE 'Copper, Total' END AS parameter,
  CASE l_linenumber WHEN 5 THEN 'Hardness, Calc' ELSE '' END AS parmname,
  l_quantity * 1000 AS value FROM lineitem"""

REPS = """
SELECT date, year, month, routine, locator, stream, "position", loc_group, metal_org, parameter,
  parmname, units, CAST(count(*) AS VARCHAR) AS sample, avg(value) AS value,
  first(qual ORDER BY sample, textvalue, hardness, qual NULLS FIRST) AS qual,
  bool_and(coalesce(contains(qual, 'MDL'), false)) AS below_mdl,
  CASE WHEN min(mdl) = max(mdl) THEN min(mdl) ELSE round(avg(mdl), 12) END AS mdl,
  avg(rdl) AS rdl, avg(hardness) AS hardness,
  first(textvalue ORDER BY sample, textvalue, hardness, qual NULLS FIRST) AS textvalue
FROM meas GROUP BY date, year, month, routine, locator, stream, "position", loc_group, metal_org,
  parameter, parmname, units"""


def replaced_ctes(src: str, o: str) -> dict[str, str]:
    rep = "CASE WHEN is_low THEN r40 WHEN c + dn > 0 THEN (ds + r) / (c + dn) ELSE r40 END"
    cur_rep = ("CASE WHEN cur.is_low THEN cur.r40 WHEN cur.c + cur.dn > 0 "
               "THEN (cur.ds + cur.r) / (cur.c + cur.dn) ELSE cur.r40 END")
    return {
        f"{o}_d": f"""SELECT * FROM {src} WHERE parameter IN (
            SELECT parameter FROM {src} GROUP BY 1 HAVING NOT bool_and(below_mdl))""",
        f"{o}_lev": f"""SELECT stream, parameter, mdl, count(*) AS n,
            CAST(count_if(below_mdl) AS BIGINT) AS b FROM {o}_d
            WHERE mdl IS NOT NULL GROUP BY ALL""",
        f"{o}_lv": f"""SELECT l.stream, l.parameter, l.mdl, l.n, l.b,
            row_number() OVER (PARTITION BY l.stream, l.parameter ORDER BY l.mdl) AS k,
            CASE WHEN l.b::DOUBLE / l.n < 0.4 THEN l.mdl ELSE l.mdl / 2 END AS r40,
            l.mdl = low AS is_low, l.mdl <> low AND coalesce(l.mdl >= top, true) AS is_high,
            coalesce(dn, 0) AS dn, coalesce(ds, 0.0) AS ds
          FROM {o}_lev l
          JOIN (SELECT parameter, min(mdl) AS low FROM {o}_d GROUP BY 1) USING (parameter)
          JOIN (SELECT stream, parameter, max(value) AS top FROM {o}_d GROUP BY 1, 2)
            USING (stream, parameter)
          LEFT JOIN (SELECT l.stream, l.parameter, l.mdl, count(*) AS dn, sum(d.value) AS ds
            FROM {o}_lev l JOIN {o}_d d ON d.stream = l.stream AND d.parameter = l.parameter
              AND NOT d.below_mdl AND d.value < l.mdl AND d.mdl < l.mdl GROUP BY 1, 2, 3) s
            USING (stream, parameter, mdl)""",
        f"{o}_rec": f"""SELECT *, 0.0::DOUBLE AS r, 0::BIGINT AS c, 0::BIGINT AS seen FROM {o}_lv
            WHERE k = 1 UNION ALL
            SELECT nx.*, cur.r + CASE WHEN cur.is_high THEN 0.0 ELSE cur.b * ({cur_rep}) END,
              cur.c + CASE WHEN cur.is_high THEN 0 ELSE cur.b END, cur.seen + cur.n
            FROM (SELECT stream, parameter, k, n, b, r40, is_low, is_high, dn, ds, r, c, seen
                  FROM {o}_rec) cur
            JOIN {o}_lv nx ON nx.stream = cur.stream AND nx.parameter = cur.parameter
              AND nx.k = cur.k + 1""",
        o: f"""SELECT d.*, CASE WHEN d.below_mdl THEN v.rep END AS replacement,
              CASE WHEN d.below_mdl THEN v.rep ELSE d.value END AS rvalue,
              CASE WHEN d.below_mdl THEN v.q END AS rvqual
            FROM {o}_d d JOIN (SELECT stream, parameter, mdl,
                CASE WHEN is_high THEN NULL ELSE {rep} END AS rep,
                CASE WHEN is_high THEN 'HighNonDetect'
                  WHEN NOT is_low AND c + dn > 0 THEN 'LowerMean'
                  ELSE CASE WHEN is_low THEN 'LowestMDL' WHEN seen = 0 THEN 'NoLowerData'
                       ELSE 'LowerData>MDL' END ||
                       CASE WHEN r40 = mdl THEN ', <40%' ELSE ', >40%' END END AS q
              FROM {o}_rec) v USING (stream, parameter, mdl)""",
    }


CTES: dict[str, str] = {"meas": MEAS, "oxy": OXYGEN, "chem": CHEM, "reps": REPS}
CTES["meas2"] = """SELECT * REPLACE (stream || '/' || month AS sample, "position" AS locator) FROM meas"""
CTES["storm0"] = "SELECT * FROM reps WHERE routine = 'wet weather'"
CTES["base0"] = "SELECT * FROM reps WHERE routine = 'Routine'"
CTES.update(replaced_ctes("storm0", "storm"))
CTES.update(replaced_ctes("base0", "base"))
CTES["km_p"] = """SELECT stream, parameter, x, count_if(NOT below_mdl)::DOUBLE AS d,
  count_if(below_mdl)::DOUBLE AS c FROM (SELECT stream, parameter, below_mdl,
    CASE WHEN below_mdl THEN mdl ELSE value END AS x FROM storm)
  WHERE x IS NOT NULL GROUP BY stream, parameter, x"""


def km_sql(points: str, keys: str) -> str:
    """Mean, median, sd, counts from points (keys, x, d, c)."""
    return f"""SELECT {keys}, mean, CASE WHEN rest <= 0.5 + 1e-9 THEN med END AS median,
      sqrt(greatest(m2 + rest * lo * lo - mean * mean, 0)) AS sd, n, n_censored, n = n_censored AS all_censored
    FROM (SELECT {keys}, sum(x * cdf * d / r) + max(rest) * min(x) AS mean,
        sum(x * x * cdf * d / r) AS m2, max(rest) AS rest, min(x) AS lo,
        min(CASE WHEN d > 0 AND cdf >= 0.5 - 1e-9 THEN x END) AS med,
        CAST(sum(d) + sum(c) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS n_censored
      FROM (SELECT *, coalesce(product(1 - d / r) OVER (PARTITION BY {keys} ORDER BY x DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS cdf,
          product(1 - d / r) OVER (PARTITION BY {keys}) AS rest
        FROM (SELECT *, sum(d + c) OVER (PARTITION BY {keys} ORDER BY x) AS r FROM {points}))
      GROUP BY {keys})"""


CTES["km"] = km_sql("km_p", "stream, parameter")


def trend_ctes(o: str, src: str, x: str, value: str, keys: str) -> dict[str, str]:
    """Censored Kendall slope by listing the pairs of weighted points."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"i.{k} = j.{k}" for k in ks)
    ik = ", ".join(f"i.{k}" for k in ks)
    return {
        f"{o}_p": f"""SELECT {keys}, x, y, c, count(*) AS w FROM (SELECT {keys},
              CAST({x} AS DOUBLE) AS x, CASE WHEN below_mdl THEN mdl ELSE {value} END AS y,
              below_mdl AS c FROM {src}) WHERE x IS NOT NULL AND y IS NOT NULL
            GROUP BY {keys}, x, y, c""",
        f"{o}_b": f"""SELECT {ik}, (j.y - i.y) / (j.x - i.x) AS s,
              sum(i.w * j.w * CASE WHEN NOT i.c AND NOT j.c THEN 2 ELSE 1 END) AS fall,
              sum(i.w * j.w * CASE WHEN j.c THEN 0 ELSE 1 END) AS up,
              sum(i.w * j.w * CASE WHEN NOT i.c AND NOT j.c THEN sign(j.y - i.y)
                WHEN i.c AND j.y >= i.y THEN 1 WHEN j.c AND i.y >= j.y THEN -1 ELSE 0 END) AS zero
            FROM {o}_p i JOIN {o}_p j ON {same} AND i.x < j.x AND NOT (i.c AND j.c)
            GROUP BY ALL""",
        f"{o}_s": f"""SELECT {keys}, (max(CASE WHEN up_all - fallen + fall > 0 THEN s END)
              + min(CASE WHEN up_all - fallen < 0 THEN s END)) / 2 AS slope, max(z) AS s0
            FROM (SELECT *, sum(fall) OVER (PARTITION BY {keys} ORDER BY s) AS fallen,
              sum(up) OVER (PARTITION BY {keys}) AS up_all,
              sum(zero) OVER (PARTITION BY {keys}) AS z FROM {o}_b) GROUP BY {keys}""",
        f"{o}_t": f"""SELECT {keys}, sum(w)::DOUBLE AS n FROM {o}_p GROUP BY {keys}""",
        f"{o}_x": f"""SELECT {keys}, sum(t*(t-1)*(2*t+5)) AS v, sum(t*(t-1)*(t-2)) AS h,
              sum(t*(t-1)) AS u FROM (SELECT {keys}, x, sum(w)::DOUBLE AS t FROM {o}_p GROUP BY ALL)
            GROUP BY {keys}""",
        f"{o}_y": f"""SELECT {keys}, sum(t*(t-1)*(2*t+5)) AS v, sum(t*(t-1)*(t-2)) AS h,
              sum(t*(t-1)) AS u FROM (SELECT {keys}, CASE WHEN NOT c THEN y END AS yy,
                sum(w)::DOUBLE AS t FROM {o}_p GROUP BY ALL) GROUP BY {keys}""",
        f"{o}_r": f"""SELECT {keys}, r AS x, sum(CASE WHEN c THEN 0 ELSE w END)::DOUBLE AS d,
              sum(CASE WHEN c THEN w ELSE 0 END)::DOUBLE AS c FROM (
                SELECT {keys}, y - slope * x AS r, c, w FROM {o}_p JOIN {o}_s USING ({keys})
                WHERE slope IS NOT NULL) GROUP BY {keys}, r""",
        f"{o}_m": km_sql(f"{o}_r", keys),
        f"{o}_z": f"""SELECT {keys}, slope, n, coalesce(s0, 0) AS s0,
              greatest(abs(coalesce(s0, 0)) - 1, 0) / sqrt(nullif(greatest(
                (n*(n-1)*(2*n+5) - a.v - b.v) / 18
                + coalesce(a.h * b.h / nullif(9*n*(n-1)*(n-2), 0), 0)
                + coalesce(a.u * b.u / nullif(2*n*(n-1), 0), 0), 0), 0)) AS z
            FROM {o}_t LEFT JOIN {o}_s USING ({keys}) JOIN {o}_x a USING ({keys})
            JOIN {o}_y b USING ({keys})""",
        o: f"""SELECT {keys}, slope, median AS intercept, s0 / nullif(n*(n-1)/2, 0) AS tau,
              CASE WHEN z IS NOT NULL THEN least(2 * (1 - {norm_cdf('z')}), 1.0) END AS p, CAST(n AS BIGINT) AS n
            FROM {o}_z LEFT JOIN (SELECT {keys}, median FROM {o}_m) m USING ({keys})""",
    }


CTES.update(trend_ctes("trend", "storm", "year", "value", "parameter, stream"))
CTES.update(trend_ctes("pooled", "storm", "year", "value", "parameter"))
CTES["storm_oxy"] = 'SELECT s.*, o."do" FROM storm s LEFT JOIN oxy o USING (locator, date)'
CTES["storm_oxy_diss"] = """SELECT * FROM storm_oxy WHERE "do" IS NOT NULL
  AND contains(parameter, 'Dissolved') AND (parameter, stream) IN (
    SELECT (parameter, stream) FROM storm_oxy WHERE "do" IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)"""
CTES.update(trend_ctes("oxy_trend", "storm_oxy_diss", '"do"', "value", "parameter, stream"))
CTES["parts"] = """SELECT d.date, d.locator, d.stream, split_part(d.parameter, ',', 1) AS metal,
  d.value AS value_d, t.value AS value_t, d.rvalue AS rvalue_d, t.rvalue AS rvalue_t,
  100 * d.rvalue / t.rvalue AS pct_dissolved, d.below_mdl OR t.below_mdl AS below_mdl
  FROM storm d JOIN storm t ON d.date = t.date AND d.locator = t.locator AND d.stream = t.stream
    AND split_part(d.parameter, ',', 1) = split_part(t.parameter, ',', 1)
  WHERE contains(d.parameter, 'Dissolved') AND contains(t.parameter, 'Total')"""
CTES["oxy_parts"] = """SELECT p.* EXCLUDE (pct_dissolved), least(pct_dissolved, 100.0) AS pct_dissolved,
  o."do", NULL::DOUBLE AS mdl
  FROM (SELECT * FROM parts WHERE NOT below_mdl) p LEFT JOIN oxy o USING (locator, date)"""
CTES["oxy_parts3"] = """SELECT * FROM oxy_parts WHERE "do" IS NOT NULL AND metal IN (
  SELECT metal FROM oxy_parts WHERE "do" IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)"""
CTES.update(trend_ctes("part_trend", "oxy_parts3", '"do"', "pct_dissolved", "metal"))


def criteria_cte(values: str) -> str:
    """Limits by correlated lookup, independent of any pivoted coefficient table."""
    def one(kind):
        return (f"(SELECT coalesce(c.fixed, (c.c0 - c.c1 * ln(s.hardness)) * exp(c.m * ln(s.hardness)"
                f" + c.b)) FROM ({values}) c WHERE c.parameter = s.parameter AND c.kind = '{kind}')")
    return (f"SELECT *, rvalue / acute AS prop_acute, rvalue / chronic AS prop_chronic, "
            f"rvalue / water AS prop_water FROM (SELECT s.*, {one('acute')} AS acute, "
            f"{one('chronic')} AS chronic, {one('water')} AS water FROM storm s)")


CTES["crit"] = criteria_cte(criteria_values())
CTES["crit_h"] = criteria_cte(criteria_values(HUMAN_TEST))
CTES["al_s"] = """SELECT * FROM storm WHERE date >= (SELECT min(date) - INTERVAL 1 MONTH FROM base)
  AND date <= (SELECT max(date) + INTERVAL 1 MONTH FROM base)
  AND stream IN (SELECT stream FROM base) AND parameter IN (SELECT parameter FROM base)"""
CTES["aligned"] = """SELECT * FROM al_s UNION ALL BY NAME SELECT * FROM base
  WHERE stream IN (SELECT stream FROM al_s) AND parameter IN (SELECT parameter FROM al_s)"""
CTES["metals1"] = """SELECT * FROM aligned WHERE parameter NOT IN (
  SELECT parameter FROM aligned GROUP BY 1 HAVING bool_and(below_mdl))"""
CTES["metals"] = """SELECT * FROM metals1 WHERE stream NOT IN (
  SELECT stream FROM metals1 GROUP BY stream, routine HAVING count(DISTINCT date) < 3)"""


def gehan_ctes(o: str, keys: str) -> dict[str, str]:
    group = keys if "stream" in keys else keys + ", stream"
    return {
        f"{o}_r": f"""SELECT *, CASE WHEN below_mdl THEN mdl ELSE value END AS y,
            routine = 'wet weather' AS wet FROM metals WHERE ({group}) IN (SELECT ({group})
            FROM metals GROUP BY {group} HAVING count_if(routine = 'wet weather') >= 3
              AND count_if(routine = 'Routine') >= 3)""",
        f"{o}_u": f"""SELECT *, CASE WHEN below_mdl
              THEN -coalesce(sum(w1 + b1) OVER (PARTITION BY {keys} ORDER BY y DESC), 0)
              ELSE lower_all - higher END AS u FROM (
            SELECT *, coalesce(sum(w1 + b1) OVER (PARTITION BY {keys} ORDER BY y DESC
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS higher,
              coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY y
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0)
              + sum(w0 + b0) OVER (PARTITION BY {keys}, y) AS lower_all
            FROM (SELECT {keys}, y, below_mdl, count(*) AS n,
              CAST(count_if(wet) AS BIGINT) AS w, CAST(count_if(wet AND NOT below_mdl) AS BIGINT) AS w1,
              CAST(count_if(wet AND below_mdl) AS BIGINT) AS w0,
              CAST(count_if(NOT wet AND NOT below_mdl) AS BIGINT) AS b1,
              CAST(count_if(NOT wet AND below_mdl) AS BIGINT) AS b0
              FROM {o}_r GROUP BY ALL))""",
        f"{o}_s": f"""SELECT {keys}, sum(w * u)::DOUBLE / sqrt(nullif(sum(w)::DOUBLE * sum(n - w)
              * sum(n * u * u)::DOUBLE / (sum(n) * (sum(n) - 1.0)), 0)) AS gehan_stat
            FROM {o}_u GROUP BY {keys}""",
        o: f"""SELECT {keys}, mean_wet, mean_routine, gehan_stat, 1 - {norm_cdf('gehan_stat')} AS p,
              censored_wet, censored_routine FROM {o}_s JOIN (SELECT {keys},
              avg(CASE WHEN wet THEN rvalue END) AS mean_wet,
              avg(CASE WHEN NOT wet THEN rvalue END) AS mean_routine,
              100 * avg(CASE WHEN wet THEN below_mdl::INT END) AS censored_wet,
              100 * avg(CASE WHEN NOT wet THEN below_mdl::INT END) AS censored_routine
              FROM {o}_r GROUP BY {keys}) USING ({keys})""",
    }


CTES.update(gehan_ctes("gehan", "parameter"))
CTES.update(gehan_ctes("gehan2", "stream, parameter"))
CTES["means"] = """SELECT stream, parameter, avg(rvalue) AS grand_mean FROM storm GROUP BY ALL
  HAVING avg(rvalue) IS NOT NULL"""


def needed(text: str) -> list[str]:
    """Names of the common table expressions a text uses, in definition order."""
    import re
    found: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"[a-z_0-9]+", sql)):
            if word in CTES and word not in found:
                found.add(word)
                visit(CTES[word])

    visit(text)
    return [name for name in CTES if name in found]


def build(select: str) -> str:
    names = needed(select)
    if not names:
        return select
    shared = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    local = select.lstrip()
    if local.upper().startswith("WITH "):
        return f"{shared},\n{local[5:]}"
    return f"{shared}\n{select}"
