"""Every registered query with the SQL it is compared with, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import stages as S
from checks.pcasql import SITE_CELLS, YEARLY_CELLS, nipals_sql, q2_sql
from checks.sqltext import HUMAN_TEST, build, norm_cdf, norm_quantile, nudge, rnd
from lodestat import functions as fn
from lodestat.operators import (
    censor,
    compare,
    criteria,
    explore,
    fractions,
    ordered,
    pca,
    prep,
    relate,
    reshape,
    survival,
    trend,
)
from lodestat import plans
from lodestat.sources import files, schema, testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register a query under its function name; doubles are rounded for comparison."""
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(spark, sf_dir), digits)
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = build(sql)
        return f
    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`") + nudge(digits), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


CELL = ["stream", "parameter"]


# --- sources and sinks -----------------------------------------------------------------

MEAS_OUT = f"""sample, date, year, month, routine, locator, stream, parameter, qual, textvalue,
  {rnd('value', 'value')}, {rnd('mdl', 'mdl')}, {rnd('hardness', 'hardness', 6)}"""


@query(f"SELECT {MEAS_OUT} FROM meas", digits=6)
def csv_measurements(spark, sf_dir):
    """Typed CSV written with NA and read back with declared types."""
    path = S.scratch(spark, sf_dir, "csv_measurements")
    files.write_csv(testbed.measurements(spark, sf_dir).select(*schema.MEASUREMENT.names), path)
    back = files.read_measurements(spark, path, schema.MEASUREMENT)
    return back.select("sample", "date", "year", "month", "routine", "locator", "stream",
                       "parameter", "qual", "textvalue", "value", "mdl", "hardness")


@query("SELECT DISTINCT parmname, metal_org, parameter FROM meas")
def csv_lookup(spark, sf_dir):
    """CSV without a header, names supplied by the reader."""
    path = S.scratch(spark, sf_dir, "csv_lookup")
    relate.distinct_of(testbed.measurements(spark, sf_dir), *schema.PARAMETER_LOOKUP
                       ).write.option("nullValue", "NA").csv(path)
    return files.read_lookup(spark, path, schema.PARAMETER_LOOKUP)


@query(f"SELECT stream, parameter, {rnd('value', 'value')} FROM meas")
def drop_index(spark, sf_dir):
    df = testbed.measurements(spark, sf_dir).select(*CELL, "value")
    return files.drop_index(df.withColumn("X1", F.monotonically_increasing_id()))


BAD = [("L1", "Copper, Total"), ("L1", "Iron, Dissolved"), ("L2", "Lead, Total"),
       ("L7", "Zinc, Dissolved"), ("L47748-4", "Nickel, Dissolved")]


@query("""SELECT parameter, count(*) AS n FROM meas WHERE (sample, parameter) NOT IN (
  ('L1', 'Copper, Total'), ('L1', 'Iron, Dissolved'), ('L2', 'Lead, Total'),
  ('L7', 'Zinc, Dissolved'), ('L47748-4', 'Nickel, Dissolved')) GROUP BY ALL""")
def exclude_bad_rows(spark, sf_dir):
    bad = files.literal_table(spark, BAD, "sample string, parameter string")
    kept = relate.exclude(testbed.measurements(spark, sf_dir), bad)
    return kept.groupBy("parameter").agg(F.count(F.lit(1)).alias("n"))


# --- projections, filters, expressions ---------------------------------------------------

@query(f"""SELECT 'L' || l_orderkey AS sample, l_returnflag AS routine,
  CAST(l_shipdate AS DATE) AS date, {rnd('l_quantity', 'value')}, {rnd('l_tax', 'mdl')} FROM lineitem""")
def canonical_columns(spark, sf_dir):
    raw = testbed.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("L"), F.col("l_orderkey")).alias("LABSAMPLENUM"),
        F.col("l_returnflag").alias("Routine"), F.to_date("l_shipdate").alias("Date"),
        F.col("l_quantity").alias("NUMVALUE"), F.col("l_tax").alias("MDL"),
        F.col("l_suppkey").alias("SITE"))
    return prep.to_canonical(raw)


@query("""SELECT stream, year, count(*) AS n FROM meas WHERE routine = 'wet weather'
  AND metal_org = 'Metal' AND stream IS NOT NULL AND year BETWEEN 1996 AND 2000 GROUP BY ALL""")
def event_type_rows(spark, sf_dir):
    rows = censor.event_type(testbed.measurements(spark, sf_dir), "wet weather")
    return rows.filter(F.col("year").between(1996, 2000)).groupBy("stream", "year").agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT qual, count(*) AS n FROM meas WHERE coalesce(qual NOT IN ('<MDL'), true)
  AND stream NOT IN ('NATION_3', 'NATION_5') GROUP BY ALL""")
def literal_membership(spark, sf_dir):
    """Negated membership keeps missing qualifiers."""
    df = testbed.measurements(spark, sf_dir)
    kept = censor.drop_sparse_streams(df, ["NATION_3", "NATION_5"])
    return kept.filter(fn.r_not_isin(F.col("qual"), ["<MDL"])).groupBy("qual").agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (
    SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def computed_membership(spark, sf_dir):
    customer = testbed.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    kept = relate.semi(testbed.table(spark, sf_dir, "orders"),
                       customer.filter("c_acctbal > 0"), ["o_custkey"])
    return relate.anti(kept, customer.filter("c_mktsegment = 'MACHINERY'"), ["o_custkey"]).select(
        "o_orderkey", "o_orderstatus")


@query("""SELECT split_part(parameter, ',', 1) AS metal, count(*) AS n, count(value) AS valued FROM meas
  WHERE contains(parameter, 'Total') GROUP BY ALL""")
def pattern_rows(spark, sf_dir):
    df = testbed.measurements(spark, sf_dir)
    return df.filter(fn.detect(F.col("parameter"), "Total")).groupBy(
        fn.first_word(F.col("parameter")).alias("metal")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("valued"))


@query("""SELECT word, count(*) AS n FROM (
  SELECT regexp_extract(text, '[\\p{L}\\p{M}\\p{N}_]+') AS word FROM documents)
  WHERE word <> '' GROUP BY word""")
def first_words(spark, sf_dir):
    """First word of whole texts, Unicode letters included."""
    return testbed.table(spark, sf_dir, "documents").groupBy(
        fn.first_word(F.col("text")).alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("word").isNotNull())


@query(f"""SELECT sample, coalesce(qual, 'none') AS qual, {rnd('coalesce(value, mdl)', 'shown')},
  {rnd('CASE WHEN value > 40 THEN 40 ELSE value END', 'capped')}, {rnd('-value', 'negated')} FROM meas""")
def default_and_fallback(spark, sf_dir):
    df = testbed.measurements(spark, sf_dir)
    v = F.col("value")
    return df.select("sample", fn.default_to(F.col("qual"), "none").alias("qual"),
                     fn.fallback(v, F.col("mdl")).alias("shown"),
                     fn.clamp(v, 40.0).alias("capped"), (-v).alias("negated"))


@query("""SELECT user_id, count(*) AS n FROM events WHERE value > 100 OR event_type = 'error'
  GROUP BY ALL""")
def three_valued_or(spark, sf_dir):
    events = testbed.table(spark, sf_dir, "events")
    return events.filter(fn.any_condition(F.col("value") > 100, F.col("event_type") == "error")
                         ).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _supplier_sites(spark, sf_dir):
    """Location table: reporting group from the account balance, one group missing."""
    supplier = testbed.table(spark, sf_dir, "supplier")
    nation = testbed.table(spark, sf_dir, "nation")
    band = F.pmod(F.col("s_suppkey"), F.lit(5))
    group = (F.when(band == 0, "FDL").when(band == 1, "Area Other 1").when(band == 2, "OTHER 2")
             .when(band == 3, "Other 2"))
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_name").alias("LOCATOR"), F.col("n_name").alias("STREAM"),
        F.concat(F.lit("P"), F.col("n_regionkey")).alias("POSITION ON STREAM"),
        group.alias("Reporting Group"))


LOCATIONS = """SELECT DISTINCT s_name AS "LOCATOR", CASE s_suppkey % 5 WHEN 0 THEN n_name
    WHEN 1 THEN n_name || ' B' WHEN 2 THEN n_name || ' C' WHEN 3 THEN n_name || ' C' END AS "STREAM",
  'P' || n_regionkey AS "POSITION ON STREAM", CASE s_suppkey % 5 WHEN 0 THEN 'FDL'
    WHEN 1 THEN 'Area Other 1' WHEN 2 THEN 'OTHER 2' WHEN 3 THEN 'Other 2' END AS "Reporting Group"
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@query(LOCATIONS)
def location_lookup(spark, sf_dir):
    return prep.location_lookup(_supplier_sites(spark, sf_dir))


@query(f"""SELECT "STREAM" AS stream, metal AS parameter, o_orderstatus AS routine, count(*) AS n
  FROM lineitem LEFT JOIN ({LOCATIONS}) ON "LOCATOR" = 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
  LEFT JOIN (SELECT DISTINCT p_partkey, p_type AS metal FROM part) ON p_partkey = l_partkey
  LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_orderstatus FROM orders)
    ON d = CAST(l_shipdate AS DATE) GROUP BY ALL""")
def enrich_lookups(spark, sf_dir):
    """Three chained left lookups; a date with several types multiplies rows."""
    part = testbed.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("PARMNAME"), F.col("p_type").alias("parameter")).distinct()
    dates = testbed.table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("Date"), F.col("o_orderstatus").alias("routine")).distinct()
    raw = testbed.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("LOCATOR"),
        F.col("l_partkey").alias("PARMNAME"), F.to_date("l_shipdate").alias("Date"))
    merged = relate.enrich(raw, (prep.location_lookup(_supplier_sites(spark, sf_dir)), ["LOCATOR"]),
                           (part, ["PARMNAME"]), (dates, ["Date"]))
    return merged.groupBy(F.col("STREAM").alias("stream"), "parameter", "routine").agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT parameter, parmname, count(*) AS n FROM (
  SELECT DISTINCT p_type AS parameter, p_brand AS parmname FROM part
  UNION ALL SELECT DISTINCT NULL, p_name FROM part) GROUP BY ALL""")
def parameter_lookup(spark, sf_dir):
    """Distinct classes bound to an extra table that lacks a column."""
    part = testbed.table(spark, sf_dir, "part")
    extra = part.select(F.col("p_name").alias("parmname")).distinct()
    known = part.select(F.col("p_type").alias("parameter"), F.col("p_brand").alias("parmname")).distinct()
    return relate.bind_rows(extra, known).groupBy("parameter", "parmname").agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS parsed,
  CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
  make_date(year(l_shipdate), 7, 1) AS mid_year,
  CAST(CAST(l_shipdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS earlier FROM lineitem""")
def parsed_dates(spark, sf_dir):
    """Two- and four-digit years, with and without time of day."""
    line = testbed.table(spark, sf_dir, "lineitem")
    kind = F.pmod(F.col("l_linenumber"), F.lit(3))
    text = (F.when(kind == 0, F.date_format("l_shipdate", "M/d/yy"))
            .when(kind == 1, F.date_format("l_shipdate", "M/d/yyyy"))
            .otherwise(F.date_format("l_shipdate", "MM/dd/yyyy HH:mm")))
    parsed = line.select("l_orderkey", "l_linenumber", fn.parse_lab_date(text).alias("parsed"))
    return fn.add_year_month(parsed, "parsed").withColumns({
        "mid_year": F.make_date(F.col("year"), F.lit(7), F.lit(1)),
        "earlier": fn.shift_months(F.col("parsed"), -1)})


@query("""SELECT DISTINCT s_name AS locator, CASE WHEN right(stream, 1) IN ('B', 'C')
    THEN left(stream, 2) || right(stream, 1) ELSE left(stream, 2) END AS label FROM (
  SELECT s_name, n_name || CASE WHEN s_suppkey % 2 = 0 THEN ' B' ELSE '' END AS stream
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def stream_labels(spark, sf_dir):
    supplier, nation = testbed.table(spark, sf_dir, "supplier"), testbed.table(spark, sf_dir, "nation")
    named = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_name").alias("locator"),
        F.when(F.col("s_suppkey") % 2 == 0, fn.paste(F.col("n_name"), F.lit("B"), sep=" "))
        .otherwise(F.col("n_name")).alias("stream"))
    return named.select("locator", fn.stream_label(F.col("stream")).alias("label")).distinct()


@query(f"""SELECT event_id, {rnd('ln(nullif(value, 0))', 'ln_value', 9)},
  {rnd('log10(nullif(value, 0))', 'log_value', 9)}, {rnd('exp(-value / 100)', 'decay', 9)},
  {rnd('round_even(value, 1)', 'rounded', 9)}, {rnd('power(value, 0.5)', 'root', 9)},
  {rnd('value / nullif(user_id, 0)', 'ratio', 9)} FROM events""", digits=9)
def safe_arithmetic(spark, sf_dir):
    v = F.col("value")
    return testbed.table(spark, sf_dir, "events").select(
        "event_id", fn.safe_ln(v).alias("ln_value"), fn.safe_log10(v).alias("log_value"),
        F.exp(-v / 100).alias("decay"), fn.round_half_even(v, 1).alias("rounded"),
        F.pow(v, F.lit(0.5)).alias("root"), fn.ratio(v, F.col("user_id")).alias("ratio"))


@query(f"""SELECT l_orderkey, l_linenumber, {rnd(norm_cdf('((l_quantity - 25) / 10)'), 'cdf', 8)},
  {rnd(norm_quantile('(l_quantity / 51)'), 'quantile', 8)} FROM lineitem""", digits=8)
def normal_distribution(spark, sf_dir):
    line = testbed.table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber",
                       fn.norm_cdf((F.col("l_quantity") - 25) / 10).alias("cdf"),
                       fn.norm_quantile(F.col("l_quantity") / 51).alias("quantile"))


# --- aggregates, order, reshaping --------------------------------------------------------

@query(f"""SELECT stream, parameter, {rnd('avg(value)', 'grand_mean')} FROM meas GROUP BY ALL
  HAVING avg(value) IS NOT NULL""")
def group_means(spark, sf_dir):
    return reshape.group_mean(testbed.measurements(spark, sf_dir), CELL, "value")


@query("""SELECT parameter, year, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(DISTINCT stream) AS BIGINT) AS streams,
  CAST(count(DISTINCT qual) + max(CASE WHEN qual IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS quals
  FROM meas GROUP BY ALL HAVING count(*) > 100""")
def distinct_counts(spark, sf_dir):
    """Distinct counts with null as a value; groups kept by their size."""
    return testbed.measurements(spark, sf_dir).groupBy("parameter", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("stream").alias("streams"),
        fn.count_distinct_with_null(F.col("qual")).alias("quals")).filter(F.col("rows") > 100)


@query(f"""SELECT min(date) AS first_date, max(date) AS last_date, {rnd('max(value) * 1.05', 'top')},
  {rnd('sum(value)', 'total')}, {rnd('stddev_samp(value)', 'sd')} FROM meas""")
def global_bounds(spark, sf_dir):
    return testbed.measurements(spark, sf_dir).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.max("value") * 1.05).alias("top"), F.sum("value").alias("total"),
        F.stddev_samp("value").alias("sd"))


@query(f"""SELECT routine, parameter, {rnd('quantile_cont(hardness, 0.25)', 'q1', 9)},
  {rnd('quantile_cont(hardness, 0.5)', 'median', 9)}, {rnd('quantile_cont(hardness, 0.75)', 'q3', 9)}
  FROM meas GROUP BY ALL""", digits=9)
def exact_quartiles(spark, sf_dir):
    return ordered.exact_quantiles(testbed.measurements(spark, sf_dir), ["routine", "parameter"],
                                   "hardness", {"q1": 0.25, "median": 0.5, "q3": 0.75})


@query("""SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type
  ORDER BY value, event_id) AS BIGINT) AS position,
  CAST(count(*) OVER (PARTITION BY event_type) AS BIGINT) AS group_size FROM events""")
def ordinal_positions(spark, sf_dir):
    return ordered.ordinal_positions(
        testbed.table(spark, sf_dir, "events").select("event_id", "event_type", "value"),
        ["event_type"], "value", ["event_id"]).select(
        "event_id", "event_type", "position", "group_size")


@query(f"""SELECT o_custkey, {rnd('total', 'total')}, CAST(row_number() OVER (
    ORDER BY total DESC, o_custkey) AS BIGINT) AS rank
  FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1)""")
def category_ranks(spark, sf_dir):
    return ordered.rank_categories(testbed.table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


@query("""SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) AS rank
  FROM (SELECT DISTINCT c_name FROM customer)""")
def alphabetical_ranks(spark, sf_dir):
    return ordered.alphabetical_rank(testbed.table(spark, sf_dir, "customer"), "c_name")


@query(f"""SELECT parameter, {rnd('mdl', 'mdl')}, CAST(row_number() OVER (PARTITION BY parameter
  ORDER BY mdl) AS BIGINT) AS level FROM (SELECT DISTINCT parameter, mdl FROM meas)""")
def sorted_levels(spark, sf_dir):
    return ordered.sorted_levels(testbed.measurements(spark, sf_dir), ["parameter"], "mdl")


@query(f"""SELECT stream, parameter, date, {rnd('value', 'value')} FROM meas""")
def sorted_rows(spark, sf_dir):
    return relate.arrange(testbed.measurements(spark, sf_dir).select(*CELL, "date", "value"),
                          "parameter", "-value", "date", "stream")


PARAMETERS = [f"{m}, {f}" for m in testbed.METALS.values() for f in ("Total", "Dissolved")]


@query("SELECT stream, year, " + ", ".join(
    rnd(f"avg(CASE WHEN parameter = '{p}' THEN value END)", '"' + p + '"') for p in PARAMETERS)
    + " FROM meas GROUP BY stream, year")
def pivot_parameters(spark, sf_dir):
    return reshape.pivot_parameters(testbed.measurements(spark, sf_dir), ["stream", "year"],
                                    "parameter", "value", PARAMETERS, on_duplicate="mean")


@query(f"""SELECT stream, year, parameter, {rnd('avg(value) / 2', 'value')} FROM meas
  GROUP BY ALL HAVING avg(value) IS NOT NULL""")
def unpivot_parameters(spark, sf_dir):
    wide = reshape.pivot_parameters(testbed.measurements(spark, sf_dir), ["stream", "year"],
                                    "parameter", "value", PARAMETERS, on_duplicate="mean")
    halved = reshape.across(wide, PARAMETERS, lambda c: c / 2)
    return reshape.unpivot_parameters(halved, ["stream", "year"], PARAMETERS, drop_null=True)


# --- preparation ---------------------------------------------------------------------------

@query(f"""SELECT c.sample, c.parameter, {rnd('c.value', 'value')}, {rnd('h.hardness', 'hardness')}
  FROM chem c LEFT JOIN (SELECT sample, coalesce((ca * 2.497 + mg * 4.118) / 1000, lab) AS hardness
    FROM (SELECT sample, avg(CASE WHEN parameter = 'Calcium, Total' THEN value END) AS ca,
        avg(CASE WHEN parameter = 'Magnesium, Total' THEN value END) AS mg FROM chem
      WHERE contains(parameter, 'Calcium') OR contains(parameter, 'Magnesium') GROUP BY 1)
    FULL JOIN (SELECT sample, value AS lab FROM chem WHERE contains(parmname, 'Hardness'))
      USING (sample)) h USING (sample)""")
def derived_hardness(spark, sf_dir):
    return prep.derive_hardness(testbed.chemistry(spark, sf_dir), on_duplicate="mean").select(
        "sample", "parameter", "value", "hardness")


@query(f"""SELECT split_part(d.parameter, ',', 1) AS metal, d.stream, d.locator, d.date, d.sample,
  {rnd('d.value', 'dissolved')}, {rnd('t.value', 'total')},
  {rnd('100 * d.value / t.value', 'pct_dissolved')},
  coalesce(contains(d.qual, '<RDL') AND contains(t.qual, '<RDL'), false) AS both_below_rdl
  FROM meas2 d JOIN meas2 t ON d.date = t.date AND d.locator = t.locator AND d.stream = t.stream
    AND d.sample = t.sample AND split_part(d.parameter, ',', 1) = split_part(t.parameter, ',', 1)
  WHERE contains(d.parameter, 'Dissolved') AND contains(t.parameter, 'Total') AND d.value > t.value""")
def audit_fractions(spark, sf_dir):
    """Dissolved above total, on samples pooled by month so that fractions meet."""
    return prep.audit_dissolved_over_total(S.pooled_samples(spark, sf_dir)).select(
        "metal", "stream", "locator", "date", "sample", "dissolved", "total", "pct_dissolved",
        "both_below_rdl")


# --- censoring ----------------------------------------------------------------------------

@query(f"""SELECT date, locator, stream, parameter, routine, sample, qual, below_mdl, textvalue,
  {rnd('value', 'value', 7)}, {rnd('mdl', 'mdl', 7)}, {rnd('rdl', 'rdl', 7)}, {rnd('hardness', 'hardness', 7)}
  FROM reps""", digits=7)
def average_replicates(spark, sf_dir):
    return S.fresh_replicates(spark, sf_dir).select(
        "date", "locator", "stream", "parameter", "routine", "sample", "qual", "below_mdl",
        "textvalue", "value", "mdl", "rdl", "hardness")


@query(f"""SELECT parameter, routine, count(*) AS count,
  {rnd('100 * avg(below_mdl::INT)', 'percent_below_mdl')} FROM reps GROUP BY ALL""")
def percent_censored(spark, sf_dir):
    return censor.percent_censored(S.replicates(spark, sf_dir), ["parameter", "routine"])


REPLACED_OUT = f"""date, locator, stream, parameter, below_mdl, rvqual, {rnd('mdl', 'mdl')},
  {rnd('replacement', 'replacement')}, {rnd('rvalue', 'rvalue')}"""


@query(f"SELECT {REPLACED_OUT} FROM storm")
def replace_nondetects(spark, sf_dir):
    return censor.replace_nondetects(
        censor.event_type(S.replicates(spark, sf_dir), "wet weather")).select(
        "date", "locator", "stream", "parameter", "below_mdl", "rvqual", "mdl", "replacement", "rvalue")


@query(f"""SELECT parameter, rvqual, count(*) AS n, {rnd('sum(rvalue)', 'total')} FROM (
  SELECT parameter, CASE WHEN contains(parameter, 'Cadmium') THEN 'AllNonDetect' END AS rvqual,
    CASE WHEN contains(parameter, 'Cadmium') THEN mdl / 2 END AS rvalue FROM storm0) GROUP BY ALL""")
def all_nondetect_split(spark, sf_dir):
    """One metal is made fully censored; its rows get half the limit."""
    storm = censor.event_type(S.replicates(spark, sf_dir), "wet weather")
    hidden = fn.detect(F.col("parameter"), "Cadmium")
    storm = storm.withColumns({"below_mdl": F.col("below_mdl") | hidden,
                               "value": F.when(~hidden, F.col("value"))})
    kept, fully = censor.split_all_nondetect(storm)
    return relate.bind_rows(kept, fully).groupBy("parameter", "rvqual").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rvalue").alias("total"))


@query(f"""SELECT date, locator, s.stream, s.parameter, {rnd('s.mdl', 'mdl')},
  {rnd('CASE WHEN below_mdl THEN CASE WHEN f < 0.4 THEN s.mdl ELSE s.mdl / 2 END ELSE value END', 'rvalue')},
  CASE WHEN below_mdl THEN CASE WHEN f < 0.4 THEN 'LowestMDL, <40%' ELSE 'LowestMDL, >40%' END END AS rvqual
  FROM storm0 s JOIN (SELECT stream, parameter, mdl, avg(below_mdl::INT) AS f FROM storm0 GROUP BY ALL)
  USING (stream, parameter, mdl)""")
def forty_percent_rule(spark, sf_dir):
    storm = censor.event_type(S.replicates(spark, sf_dir), "wet weather")
    return censor.substitute_40pct(storm).select(
        "date", "locator", *CELL, "mdl", "rvalue", "rvqual")


@query(f"""SELECT date, locator, stream, s.parameter, NOT below_mdl AS event,
  {rnd('CASE WHEN below_mdl THEN mdl ELSE value END', 'cvalue')},
  {rnd('top + 10 - CASE WHEN below_mdl THEN mdl ELSE value END', 'flip_value')}
  FROM storm s JOIN (SELECT parameter, greatest(max(value), max(mdl)) AS top FROM storm GROUP BY 1)
  USING (parameter)""")
def flipped_values(spark, sf_dir):
    flipped = censor.flip_values(censor.censored_value(S.storm(spark, sf_dir)), ["parameter"])
    return flipped.select("date", "locator", *CELL, "event", "cvalue", "flip_value")


@query(f"""SELECT parameter, year, {rnd('min(mdl)', 'lowest')}, {rnd('max(mdl)', 'highest')},
  {rnd('median(mdl)', 'median')}, count(DISTINCT mdl) AS count FROM storm GROUP BY ALL""")
def mdl_by_year(spark, sf_dir):
    return censor.mdl_by_year(S.storm(spark, sf_dir))


RISING = "(CASE WHEN year % 3 = 0 THEN mdl * 2 ELSE mdl + year % 2 END)"


@query(f"""WITH y AS (SELECT parameter, year, min(m) AS lowest FROM (SELECT parameter, year,
    {RISING} AS m FROM storm) GROUP BY ALL),
  f AS (SELECT parameter, lowest, min(year) AS from_year FROM y GROUP BY ALL)
  SELECT parameter, {rnd('lowest', 'lowest')}, from_year, to_year FROM (SELECT a.parameter, a.lowest,
    a.from_year, coalesce((SELECT min(b.from_year) FROM f b WHERE b.parameter = a.parameter
      AND b.lowest < a.lowest), (SELECT max(year) FROM y WHERE y.parameter = a.parameter)) AS to_year
    FROM f a) WHERE to_year >= from_year""")
def mdl_year_ranges(spark, sf_dir):
    year, mdl = F.col("year"), F.col("mdl")
    changing = F.when(year % 3 == 0, mdl * 2).otherwise(mdl + year % 2)
    return censor.mdl_year_ranges(S.storm(spark, sf_dir).withColumn("mdl", changing))


@query("SELECT parameter, " + ", ".join(
    f"CAST(sum(CASE WHEN stream = 'NATION_{i}' THEN 1 END) AS DOUBLE) AS \"NATION_{i}\"" for i in range(25))
    + f", {rnd('mdl', 'mdl')} FROM storm GROUP BY parameter, mdl")
def censoring_crosstab(spark, sf_dir):
    """Samples by parameter and limit, one column per stream."""
    counts = censor.censoring_report(S.storm(spark, sf_dir))["stream_mdl"]
    wide = reshape.pivot_parameters(counts.withColumn("count", F.col("count").cast("double")),
                                    ["parameter", "mdl"], "stream", "count",
                                    [f"NATION_{i}" for i in range(25)])
    return wide


@query(f"""SELECT parameter, stream, {rnd('mdl', 'mdl')}, count(*) AS count,
  {rnd('100 * avg(below_mdl::INT)', 'percent_below_mdl')} FROM storm GROUP BY parameter, stream, mdl""")
def censoring_report(spark, sf_dir):
    return censor.censoring_report(S.storm(spark, sf_dir))["stream_mdl"].select(
        "parameter", "stream", "mdl", "count", "percent_below_mdl")


@query(f"""SELECT parameter, stream, date, locator, {rnd('value', 'value')} FROM storm
  WHERE value IS NOT NULL AND parameter IN (SELECT parameter FROM storm GROUP BY 1
    HAVING 100 * avg(below_mdl::INT) > 22)""")
def rare_detects(spark, sf_dir):
    return censor.rare_detects(S.storm(spark, sf_dir), above=22.0).select(
        "parameter", "stream", "date", "locator", "value")


@query(f"""SELECT parameter, year, CAST(sum(n) AS BIGINT) AS num_samples, count(*) AS num_streams,
  {rnd('median(n)', 'n_per_stream')} FROM (SELECT parameter, year, stream, count(*) AS n FROM meas
    GROUP BY ALL) GROUP BY ALL""")
def sampling_coverage(spark, sf_dir):
    return censor.sampling_coverage(testbed.measurements(spark, sf_dir))


# --- criteria ------------------------------------------------------------------------------

@query(f"""SELECT parameter, stream, date, locator, {rnd('acute', 'acute')}, {rnd('chronic', 'chronic')},
  {rnd('water', 'water')}, {rnd('prop_acute', 'prop_acute')}, {rnd('prop_chronic', 'prop_chronic')},
  {rnd('prop_water', 'prop_water')} FROM crit""")
def criteria_columns(spark, sf_dir):
    return S.judged(spark, sf_dir).select(
        "parameter", "stream", "date", "locator", *criteria.KINDS,
        *[f"prop_{k}" for k in criteria.KINDS])


OVER_OUT = f"parameter, date, stream, locator, {rnd('rvalue', 'rvalue')}"


@query(f"SELECT {OVER_OUT} FROM crit WHERE (prop_acute > 1 OR prop_chronic > 1) AND NOT below_mdl")
def aquatic_exceedances(spark, sf_dir):
    return criteria.exceedances(S.judged(spark, sf_dir), "aquatic").select(
        "parameter", "date", "stream", "locator", "rvalue")


@query(f"SELECT {OVER_OUT} FROM crit_h WHERE prop_water > 1 AND NOT below_mdl")
def human_exceedances(spark, sf_dir):
    """Human-health limits from a caller's table."""
    return criteria.exceedances(S.judged(spark, sf_dir, HUMAN_TEST), "human").select(
        "parameter", "date", "stream", "locator", "rvalue")


def _rates_sql(keys: str, source: str = "crit", digits: int = 6) -> str:
    cols = []
    for k in criteria.KINDS:
        n = f"CAST(count_if(mdl < {k} OR NOT below_mdl) AS BIGINT)"
        over = f"CAST(count_if(prop_{k} > 1 AND NOT below_mdl) AS BIGINT)"
        cols += [f"{n} AS {k}_n", f"{over} AS {k}_over",
                 rnd(f"100.0 * {over} / nullif({n}, 0)", f"{k}_pct", digits)]
    return (f"SELECT * FROM (SELECT {keys}, {', '.join(cols)} FROM {source} GROUP BY {keys}) "
            f"WHERE acute_over + chronic_over + water_over > 0")


@query(_rates_sql("parameter"))
def exceedance_rates(spark, sf_dir):
    return criteria.exceedance_rates(S.judged(spark, sf_dir))


@query(_rates_sql("parameter, stream", "crit_h"))
def exceedance_rates_by_stream(spark, sf_dir):
    return criteria.exceedance_rates(S.judged(spark, sf_dir, HUMAN_TEST), ["parameter", "stream"])


SUMMARY = [(f, k) for k in ("acute", "chronic") for f in ("min", "median", "mean", "max")]
HARD = ", ".join(f"'{p}'" for p in criteria.HARDNESS_DEPENDENT)


@query("SELECT parameter, " + ", ".join(
    rnd(f"{'avg' if f == 'mean' else f}({k})", f"{f}_{k}") for f, k in SUMMARY)
    + f" FROM crit WHERE (acute IS NOT NULL OR chronic IS NOT NULL) AND parameter IN ({HARD}) GROUP BY 1")
def criteria_summary(spark, sf_dir):
    return criteria.criteria_summary(S.judged(spark, sf_dir))


@query(f"""SELECT DISTINCT parameter, {rnd('acute', 'acute')}, {rnd('chronic', 'chronic')},
  {rnd('water', 'water')} FROM crit WHERE parameter NOT IN ({HARD})
  AND (acute IS NOT NULL OR chronic IS NOT NULL OR water IS NOT NULL)""")
def fixed_criteria(spark, sf_dir):
    return criteria.fixed_criteria(S.judged(spark, sf_dir))


@query(f"""WITH d AS (SELECT *, NOT below_mdl AND coalesce(rvalue / acute > 1 OR rvalue / chronic > 1, false)
    AS above_criteria FROM crit WHERE mdl < acute OR mdl < chronic OR NOT below_mdl),
  k AS (SELECT * FROM d WHERE (parameter, stream) IN (SELECT (parameter, stream) FROM d WHERE above_criteria))
  SELECT parameter, stream, date, locator, above_criteria, {rnd('acute', 'crit1')}, {rnd('chronic', 'crit2')},
    {rnd('rvalue', 'rvalue')}, {rnd('max(rvalue) OVER w * 1.1', 'y_max')},
    {rnd('least(min(rvalue) OVER w * 0.9, min(chronic) OVER w * 0.9)', 'y_min')}
  FROM k WINDOW w AS (PARTITION BY parameter)""")
def criteria_points(spark, sf_dir):
    return criteria.criteria_points(S.judged(spark, sf_dir), "aquatic").select(
        "parameter", "stream", "date", "locator", "above_criteria", "crit1", "crit2", "rvalue",
        "y_max", "y_min")


@query(f"""WITH d AS (SELECT *, NOT below_mdl AND coalesce(rvalue / water > 1, false) AS above_criteria
    FROM crit_h WHERE mdl < water OR NOT below_mdl)
  SELECT parameter, stream, date, locator, above_criteria, {rnd('water', 'crit1')}, {rnd('water', 'crit2')},
    {rnd('rvalue', 'rvalue')} FROM d
  WHERE (parameter, stream) IN (SELECT (parameter, stream) FROM d WHERE above_criteria)""")
def human_criteria_points(spark, sf_dir):
    return criteria.criteria_points(S.judged(spark, sf_dir, HUMAN_TEST), "human").select(
        "parameter", "stream", "date", "locator", "above_criteria", "crit1", "crit2", "rvalue")


@query("SELECT parameter, " + ", ".join(
    f"round_even({f}({k}), 2) + 0.0 AS {f}_{k}" for k in ("acute", "chronic")
    for f in ("min", "median", "max"))
    + f" FROM crit WHERE (acute IS NOT NULL OR chronic IS NOT NULL) AND parameter IN ({HARD}) GROUP BY 1")
def hardness_table(spark, sf_dir):
    return criteria.report_table("hardness", criteria.criteria_summary(S.judged(spark, sf_dir)))


@query("""SELECT DISTINCT parameter, round_even(acute, 3) + 0.0 AS acute, round_even(chronic, 3) + 0.0 AS chronic,
  round_even(water, 3) + 0.0 AS water FROM crit_h WHERE parameter NOT IN (%s)
  AND (acute IS NOT NULL OR chronic IS NOT NULL OR water IS NOT NULL)""" % HARD)
def fixed_table(spark, sf_dir):
    return criteria.report_table("fixed", criteria.fixed_criteria(S.judged(spark, sf_dir, HUMAN_TEST)))


@query(f"""SELECT parameter, acute_over, round_even(acute_pct, 1) AS acute_pct, chronic_over,
  round_even(chronic_pct, 1) AS chronic_pct FROM ({_rates_sql('parameter', digits=12)})
  WHERE acute_over + chronic_over > 0""")
def aquatic_table(spark, sf_dir):
    return criteria.report_table("aquatic", criteria.exceedance_rates(S.judged(spark, sf_dir)))


@query(f"""SELECT parameter, water_over, round_even(water_pct, 1) AS water_pct
  FROM ({_rates_sql('parameter', 'crit_h', 12)}) WHERE water_over > 0""")
def human_table(spark, sf_dir):
    return criteria.report_table("human", criteria.exceedance_rates(
        S.judged(spark, sf_dir, HUMAN_TEST)))


# --- Kaplan-Meier ---------------------------------------------------------------------------

@query(f"""SELECT stream, parameter, {rnd('mean', 'mean')}, {rnd('median', 'median')}, {rnd('sd', 'sd')},
  n, n_censored, all_censored FROM km""")
def km_summary(spark, sf_dir):
    return survival.km_summary(S.storm(spark, sf_dir))


@query(f"""SELECT stream, parameter, {rnd('CASE WHEN NOT all_censored THEN mean END', 'mean')},
  {rnd('log10(CASE WHEN NOT all_censored THEN mean END)', 'log_mean')}, all_censored FROM km""")
def km_table(spark, sf_dir):
    return survival.km_table(survival.km_summary(S.storm(spark, sf_dir))).select(
        *CELL, "mean", "log_mean", "all_censored")


@query(f"""SELECT stream, parameter, {rnd('grand_mean', 'grand_mean')}, {rnd('mean', 'mean')}
  FROM (SELECT stream, parameter, avg(mdl) AS grand_mean FROM storm GROUP BY ALL) FULL JOIN km
  USING (stream, parameter) WHERE mean <> 0 AND (mean < 0.9 * grand_mean OR mean > 1.1 * grand_mean)""")
def compare_means(spark, sf_dir):
    """Against means of the limits, so that differences are certain to occur."""
    storm = S.storm(spark, sf_dir)
    return survival.compare_means(survival.km_summary(storm),
                                  reshape.group_mean(storm, CELL, "mdl")).select(
        *CELL, "grand_mean", "mean")


# --- storm against base ----------------------------------------------------------------------

@query("SELECT routine, parameter, stream, count(*) AS n FROM aligned GROUP BY ALL")
def align_domains(spark, sf_dir):
    return compare.align_domains(S.storm(spark, sf_dir), S.base(spark, sf_dir)).groupBy(
        "routine", "parameter", "stream").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT routine, parameter, stream, count(*) AS n FROM metals GROUP BY ALL")
def prune_sparse(spark, sf_dir):
    return S.compared(spark, sf_dir).groupBy("routine", "parameter", "stream").agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT stream, parameter FROM metals GROUP BY ALL
  HAVING count_if(routine = 'wet weather') >= 60 AND count_if(routine = 'Routine') >= 40""")
def eligible_groups(spark, sf_dir):
    """Groups with enough rows in either class; the counts grow with the data."""
    both = S.compared(spark, sf_dir)
    storm = compare.eligible_groups(both, CELL, "routine", [compare.STORM], 60)
    base = compare.eligible_groups(both, CELL, "routine", [compare.BASE], 40)
    return relate.semi(storm, base, CELL)


GEHAN_OUT = f"""{rnd('mean_wet', 'mean_wet')}, {rnd('mean_routine', 'mean_routine')},
  {rnd('gehan_stat', 'gehan_stat')}, {rnd('p', 'p')}, {rnd('censored_wet', 'censored_wet')},
  {rnd('censored_routine', 'censored_routine')}"""


@query(f"""WITH l AS (SELECT 1 - power(0.95, 1.0 / count(*)) AS level FROM gehan WHERE mean_wet > mean_routine)
  SELECT parameter, {GEHAN_OUT}, coalesce(p < level, NULL) AND mean_wet > mean_routine AS sig,
    p < 0.05 AND mean_wet > mean_routine AS pseudosig FROM gehan, l""")
def gehan_test(spark, sf_dir):
    return S.gehan_overall(spark, sf_dir)


@query(f"""SELECT stream, parameter, {GEHAN_OUT},
  {rnd('mean_wet / mean_routine', 'storm_base_ratio')},
  CASE WHEN mean_wet / mean_routine > 10 THEN 4 WHEN mean_wet / mean_routine > 5 THEN 3
    WHEN mean_wet / mean_routine > 2 THEN 2 WHEN mean_wet / mean_routine > 1 THEN 1 END AS fill,
  {rnd('log10(mean_wet / mean_routine)', 'log_ratio')},
  p < 0.05 AND mean_wet > mean_routine AS pseudosig FROM gehan2""")
def gehan_by_stream(spark, sf_dir):
    tests = compare.gehan_by_stream(S.compared(spark, sf_dir), S.gehan_overall(spark, sf_dir))
    return compare.ratio_classes(tests).drop("sig")


@query(f"""SELECT count(*) AS tests, {rnd('1 - power(0.95, 1.0 / nullif(count(*), 0))', 'level', 8)}
  FROM gehan2 WHERE mean_wet > mean_routine""", digits=8)
def sidak_level(spark, sf_dir):
    tests = compare.gehan_test(S.compared(spark, sf_dir), CELL)
    return compare.sidak_level(tests, F.col("mean_wet") > F.col("mean_routine"))


@query(f"""SELECT parameter, stream, date, routine, below_mdl, {rnd('mdl', 'mdl')}, {rnd('rvalue', 'rvalue')},
  {rnd('1.05 * max(rvalue) OVER (PARTITION BY parameter)', 'y_max')} FROM metals""")
def baseline_points(spark, sf_dir):
    return compare.baseline_points(S.compared(spark, sf_dir))


# --- trends -----------------------------------------------------------------------------------

TREND_OUT = f"""{rnd('slope', 'slope')}, {rnd('intercept', 'intercept')}, {rnd('tau', 'tau')},
  {rnd('p', 'p')}, n"""


def _trend_columns(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, "slope", "intercept", "tau", "p", "n")


@query(f"SELECT parameter, stream, {TREND_OUT} FROM trend")
def censored_trend(spark, sf_dir):
    return _trend_columns(S.yearly_trend(spark, sf_dir), ["parameter", "stream"])


@query(f"SELECT parameter, {TREND_OUT} FROM pooled")
def pooled_trend(spark, sf_dir):
    """All streams lumped per parameter."""
    return _trend_columns(trend.censored_trend(S.storm(spark, sf_dir), "year", ["parameter"]),
                          ["parameter"])


@query(f"SELECT parameter, stream, {TREND_OUT} FROM oxy_trend")
def oxygen_trend(spark, sf_dir):
    return _trend_columns(S.oxygen_trend(spark, sf_dir), ["parameter", "stream"])


@query(f"SELECT metal, {TREND_OUT} FROM part_trend")
def dissolved_share_trend(spark, sf_dir):
    pairs = S.oxygen_pairs(spark, sf_dir).filter(F.col("do").isNotNull())
    rows = trend.eligible(pairs.withColumn("mdl", F.lit(None).cast("double")), ["metal"], "do",
                          distinct=False)
    return _trend_columns(trend.censored_trend(rows, "do", ["metal"], "pct_dissolved"), ["metal"])


@query("""SELECT parameter, stream, count(*) AS n FROM storm WHERE (parameter, stream) IN (
  SELECT (parameter, stream) FROM storm GROUP BY ALL HAVING count(DISTINCT year) >= 7) GROUP BY ALL""")
def eligible_years(spark, sf_dir):
    return trend.eligible(S.storm(spark, sf_dir), ["parameter", "stream"], "year", 7).groupBy(
        "parameter", "stream").agg(F.count(F.lit(1)).alias("n"))


CHANGE = "100 * 10 * slope / grand_mean"


@query(f"""SELECT parameter, stream, {rnd('slope', 'slope')}, {rnd('grand_mean', 'grand_mean')},
  {rnd(CHANGE, 'decadal_change')},
  CASE WHEN {CHANGE} < -100 THEN -4 WHEN {CHANGE} < -50 THEN -3 WHEN {CHANGE} < -10 THEN -2
    WHEN {CHANGE} < 0 THEN -1 WHEN {CHANGE} > 100 THEN 4 WHEN {CHANGE} > 50 THEN 3
    WHEN {CHANGE} > 10 THEN 2 WHEN {CHANGE} > 0 THEN 1 END AS fill,
  {rnd(f'sign(slope) * log10(nullif(abs({CHANGE}), 0))', 'log_change')}
  FROM trend LEFT JOIN means USING (parameter, stream) WHERE p < 0.5""")
def decadal_changes(spark, sf_dir):
    """Classes of change for trends below a wide level, so that all classes can occur."""
    kept = trend.significant_trends(S.yearly_trend(spark, sf_dir), alpha=0.5)
    changes = trend.decadal_change(kept, reshape.group_mean(S.storm(spark, sf_dir)))
    return trend.change_classes(changes).select(
        "parameter", "stream", "slope", "grand_mean", "decadal_change", "fill", "log_change")


@query(f"""SELECT parameter, stream, {rnd('slope', 'slope')}, {rnd('-slope / mean', 'pct_change')},
  {rnd('log10(nullif(-slope / mean, 0))', 'log_change')} FROM oxy_trend LEFT JOIN km USING (stream, parameter)
  WHERE p < 0.5 AND slope < 0""")
def proportional_changes(spark, sf_dir):
    falling = trend.significant_trends(S.oxygen_trend(spark, sf_dir), alpha=0.5, falling=True)
    km = survival.km_table(survival.km_summary(S.storm(spark, sf_dir)))
    return trend.proportional_change(falling, km).select(
        "parameter", "stream", "slope", "pct_change", "log_change")


@query(f"SELECT parameter, stream, {rnd('p', 'p', 6)} FROM trend WHERE slope < 0 AND p < 0.5 / 2", digits=6)
def bonferroni_trends(spark, sf_dir):
    return compare.bonferroni_filter(S.yearly_trend(spark, sf_dir), 2, alpha=0.5).select("parameter", "stream", "p")


FACETS = """FROM storm WHERE (parameter, stream) IN (SELECT (parameter, stream) FROM trend WHERE p < 0.5)"""


@query(f"""SELECT parameter, stream, year, locator, date, {rnd('rvalue', 'rvalue')},
  {rnd('min(year) OVER w', 'x_min')}, {rnd('max(year) OVER w', 'x_max')},
  {rnd('1.1 * max(rvalue) OVER w', 'y_max')} {FACETS} WINDOW w AS (PARTITION BY parameter)""")
def regression_facets(spark, sf_dir):
    kept = trend.significant_trends(S.yearly_trend(spark, sf_dir), alpha=0.5)
    return trend.regression_facets(S.storm(spark, sf_dir), kept, "year", "rvalue").select(
        "parameter", "stream", "year", "locator", "date", "rvalue", "x_min", "x_max", "y_max")


@query(f"""SELECT parameter, stream, {rnd('x_min + 0.1 * i', 'x')},
  {rnd('(x_min + 0.1 * i) * slope + intercept', 'y')} FROM (SELECT * FROM trend WHERE p < 0.5)
  JOIN (SELECT parameter, min(year)::DOUBLE AS x_min, max(year)::DOUBLE AS x_max {FACETS} GROUP BY 1)
  USING (parameter), range(0, 2000) r(i) WHERE i <= floor((x_max - x_min) / 0.1 + 1e-10)""")
def regression_grid(spark, sf_dir):
    kept = trend.significant_trends(S.yearly_trend(spark, sf_dir), alpha=0.5)
    bounds = trend.regression_facets(S.storm(spark, sf_dir), kept, "year", "rvalue").select(
        "parameter", "x_min", "x_max").distinct()
    return trend.regression_grid(kept, bounds)


@query(f"""WITH d AS (SELECT *, log10(nullif(hardness, 0)) AS lx, log10(nullif(rvalue, 0)) AS ly FROM storm
    WHERE hardness > 0 AND rvalue > 0),
  f AS (SELECT parameter, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept FROM d GROUP BY 1)
  SELECT d.parameter, stream, date, locator, {rnd('rvalue', 'rvalue')},
    {rnd('slope', 'slope')}, {rnd('intercept', 'intercept')},
    {rnd('power(10, intercept + slope * lx)', 'fit')} FROM d JOIN f USING (parameter)""")
def loglog_fit(spark, sf_dir):
    return trend.loglog_regression(S.storm(spark, sf_dir), "hardness", "rvalue", ["parameter"]).select(
        "parameter", "stream", "date", "locator", "rvalue", "slope", "intercept", "fit")


DENSITY = "c / 2 / sqrt(v) * power(1 + ({t}) * ({t}) / v, -(v + 1) / 2.0)"


@query(f"""WITH d AS (SELECT *, log10(nullif(hardness, 0)) AS lx, log10(nullif(rvalue, 0)) AS ly FROM storm
    WHERE hardness > 0 AND rvalue > 0),
  f AS (SELECT parameter, count(*) - 2 AS v, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept, avg(lx) AS mx,
    regr_sxx(ly, lx) AS sxx, regr_syy(ly, lx) AS syy, regr_sxy(ly, lx) AS sxy FROM d GROUP BY 1),
  -- Student quantile: the density integrated by Simpson's rule in steps of 1/10000, the last step by its Taylor series
  c AS (SELECT v::DOUBLE AS v, CASE WHEN v % 2 = 1 THEN 2 / pi() ELSE 1 END * exp(coalesce(list_sum(list_transform(
    range(1, (v - 1) // 2 + 1), lambda k: ln((2 * k + 1 - v % 2) / (2 * k - v % 2)::DOUBLE))), 0)) AS c FROM (SELECT DISTINCT v FROM f WHERE v > 0)),
  steps AS (SELECT v, k, {DENSITY.format(t='k / 10000.0')} AS f, ({DENSITY.format(t='k / 10000.0')} + 4 * {DENSITY.format(t='k / 10000.0 + 0.00005')}
    + {DENSITY.format(t='(k + 1) / 10000.0')}) / 60000 AS area FROM c, range(0, 80000) r(k)),
  sums AS (SELECT *, 0.45 - coalesce(sum(area) OVER (PARTITION BY v ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing FROM steps),
  q AS (SELECT v, max_by(k / 10000.0 + (missing + f * (v + 1) * (k / 10000.0) / (v + k * k / 1e8) * (missing / f) * (missing / f) / 2) / f, k) AS t
    FROM sums WHERE missing >= 0 GROUP BY v),
  e AS (SELECT d.*, intercept + slope * lx AS fit, t * sqrt(greatest(syy - sxy * sxy / sxx, 0) / f.v
    * (1.0 / (f.v + 2) + (lx - mx) * (lx - mx) / sxx)) AS half FROM d JOIN f USING (parameter) LEFT JOIN q ON q.v = f.v)
  SELECT parameter, stream, date, locator, {rnd('power(10, fit)', 'fit')}, {rnd('power(10, fit - half)', 'lower')},
    {rnd('power(10, fit + half)', 'upper')} FROM e""")
def loglog_band(spark, sf_dir):
    """The 90 % band of the log-log fit, against a quantile from the integrated density."""
    return trend.loglog_regression(S.storm(spark, sf_dir), "hardness", "rvalue", ["parameter"]).select(
        "parameter", "stream", "date", "locator", "fit", "lower", "upper")


SMOOTH = """WITH p AS (SELECT parameter, year::DOUBLE AS x, count(*) AS n, sum(rvalue) AS sy FROM storm
    WHERE rvalue IS NOT NULL GROUP BY ALL),
  b AS (SELECT parameter, min(x) AS lo, max(x) AS hi, sum(n) AS total FROM p GROUP BY 1),
  g AS (SELECT p.*, i, lo + (hi - lo) * i / 79 AS g, total, abs(x - (lo + (hi - lo) * i / 79)) AS d
    FROM p JOIN b USING (parameter), range(0, 80) r(i)),
  q AS (SELECT parameter, i, min(d) AS reach FROM (SELECT *, sum(n) OVER (PARTITION BY parameter, i
    ORDER BY d, x ROWS UNBOUNDED PRECEDING) AS seen FROM g) WHERE seen >= floor(total * 0.75 + 1e-5)
    GROUP BY ALL),
  w AS (SELECT *, (x - g) / reach AS u, power(1 - power(abs((x - g) / reach), 3), 3) AS k
    FROM g JOIN q USING (parameter, i) WHERE d < reach),
  m AS (SELECT parameter, i, g, sum(k*n) AS s0, sum(k*n*u) AS s1, sum(k*n*u*u) AS s2, sum(k*n*u*u*u) AS s3,
    sum(k*n*u*u*u*u) AS s4, sum(k*sy) AS t0, sum(k*sy*u) AS t1, sum(k*sy*u*u) AS t2 FROM w GROUP BY ALL)"""


@query(f"""{SMOOTH} SELECT parameter, {rnd('g', 'x')}, {rnd('''(t0*(s2*s4-s3*s3) - t1*(s1*s4-s2*s3)
  + t2*(s1*s3-s2*s2)) / (s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2))''', 'y')} FROM m""")
def local_smooth(spark, sf_dir):
    return trend.local_smooth(S.storm(spark, sf_dir), "year", "rvalue", ["parameter"], grid_points=80)


# --- fractions and oxygen -----------------------------------------------------------------------

@query(f"""SELECT date, locator, stream, metal, {rnd('rvalue_d', 'rvalue_d')}, {rnd('rvalue_t', 'rvalue_t')},
  {rnd('pct_dissolved', 'pct_dissolved')}, below_mdl FROM parts""")
def partition_fractions(spark, sf_dir):
    return fractions.partition_fractions(S.storm(spark, sf_dir)).select(
        "date", "locator", "stream", "metal", "rvalue_d", "rvalue_t", "pct_dissolved", "below_mdl")


@query(f"""SELECT date, locator, stream, metal, {rnd('pct_dissolved', 'pct_dissolved')}, {rnd('"do"', '"do"')}
  FROM oxy_parts""")
def oxygen_partition(spark, sf_dir):
    return S.oxygen_pairs(spark, sf_dir).select(
        "date", "locator", "stream", "metal", "pct_dissolved", "do")


@query(f"""SELECT date, locator, stream, parameter, left(stream, 2) AS label, {rnd('"do"', '"do"')},
  {rnd('rvalue', 'rvalue')} FROM storm_oxy""")
def oxygen_points(spark, sf_dir):
    return fractions.oxygen_points(S.storm(spark, sf_dir), testbed.oxygen(spark, sf_dir)).select(
        "date", "locator", "stream", "parameter", "label", "do", "rvalue")


# --- normalisation --------------------------------------------------------------------------------

METAL_TOTALS = "'" + "', '".join(reshape.IRON_CORRELATED) + "'"


@query(f"""WITH c AS (SELECT sample, date, stream, parameter, avg(value) AS v FROM meas2 GROUP BY ALL
    HAVING avg(value) IS NOT NULL)
  SELECT a.sample, a.date, a.stream, a.parameter, {rnd('a.v / b.v', 'ratio')} FROM c a JOIN c b
    ON a.sample = b.sample AND a.date = b.date AND a.stream = b.stream AND b.parameter = 'Iron, Total'
  WHERE a.parameter IN ({METAL_TOTALS})""")
def iron_ratio_by_sample(spark, sf_dir):
    return reshape.ratio_to_reference(S.pooled_samples(spark, sf_dir), "sample", on_duplicate="mean")


@query(f"""SELECT a.stream, a.parameter, {rnd('a.grand_mean / b.grand_mean', 'ratio')} FROM means a JOIN means b
  ON a.stream = b.stream AND b.parameter = 'Iron, Total' WHERE a.parameter IN ({METAL_TOTALS})""")
def iron_ratio_by_stream(spark, sf_dir):
    return reshape.ratio_to_reference(reshape.group_mean(S.storm(spark, sf_dir)), "stream")


@query(f"""SELECT a.stream, a.parameter, {rnd('CASE WHEN NOT a.all_censored THEN a.mean / b.mean END', 'mean')},
  a.all_censored, {rnd('log10(CASE WHEN NOT a.all_censored THEN a.mean / b.mean END)', 'log_mean')}
  FROM km a JOIN km b ON a.stream = b.stream AND b.parameter = 'Iron, Total'
  WHERE a.parameter IN ({METAL_TOTALS})""")
def iron_ratio_of_km(spark, sf_dir):
    return reshape.km_iron_ratio(survival.km_summary(S.storm(spark, sf_dir)))


@query(f"""WITH c AS (SELECT sample, date, stream, parameter, avg(value) AS v FROM meas2 GROUP BY ALL
    HAVING avg(value) IS NOT NULL)
  SELECT a.sample, a.date, a.stream, a.parameter, b.parameter AS norm, {rnd('b.v', 'x')}, {rnd('a.v', 'y')}
  FROM c a JOIN c b ON a.sample = b.sample AND a.date = b.date AND a.stream = b.stream
    AND b.parameter IN ('Iron, Dissolved', 'Iron, Total')
  WHERE a.parameter NOT IN ('Iron, Dissolved', 'Iron, Total')""")
def reference_pairs(spark, sf_dir):
    return reshape.reference_pairs(S.pooled_samples(spark, sf_dir), ["Iron, Dissolved", "Iron, Total"],
                                   on_duplicate="mean")


@query(f"""SELECT stream, parameter, {rnd('(grand_mean - avg(grand_mean) OVER w) / nullif(stddev_samp(grand_mean) OVER w, 0)', 'z')},
  {rnd('(grand_mean - min(grand_mean) OVER w) / (max(grand_mean) OVER w - min(grand_mean) OVER w)', 'unit')},
  {rnd('grand_mean / avg(grand_mean) OVER w', 'relative')} FROM means WINDOW w AS (PARTITION BY parameter)""")
def scaled_means(spark, sf_dir):
    means = reshape.group_mean(S.storm(spark, sf_dir))
    scaled = explore.minmax(explore.zscore(means, ["parameter"], "grand_mean", "z"),
                            ["parameter"], "grand_mean", "unit")
    return explore.ratio_to_group_mean(scaled, name="relative").select(*CELL, "z", "unit", "relative")


# --- report data --------------------------------------------------------------------------------------

@query(f"""WITH s AS (SELECT stream AS x, parameter AS y, (grand_mean - min(grand_mean) OVER w)
    / (max(grand_mean) OVER w - min(grand_mean) OVER w) AS value, round_even(grand_mean, 8) AS label
    FROM means WINDOW w AS (PARTITION BY parameter))
  SELECT x, y, {rnd('value', 'value')}, {rnd('label', 'label')}, false AS grey, x_rank, y_rank FROM s
  JOIN (SELECT x, CAST(row_number() OVER (ORDER BY sum(value) DESC, x) AS BIGINT) AS x_rank FROM s GROUP BY x)
    USING (x)
  JOIN (SELECT y, CAST(row_number() OVER (ORDER BY y) AS BIGINT) AS y_rank FROM (SELECT DISTINCT y FROM s))
    USING (y)""")
def heatmap_cells(spark, sf_dir):
    return explore.heatmap_cells(reshape.group_mean(S.storm(spark, sf_dir)), value="grand_mean",
                                 method="rescale", label="grand_mean", label_digits=8)


@query(f"""WITH s AS (SELECT stream AS x, parameter AS y, -CASE WHEN NOT all_censored THEN log10(mean) END AS value,
    all_censored AS grey FROM km)
  SELECT x, y, {rnd('value', 'value')}, CAST(NULL AS DOUBLE) AS label, grey, x_rank, y_rank FROM s
  JOIN (SELECT x, CAST(row_number() OVER (ORDER BY x) AS BIGINT) AS x_rank FROM s GROUP BY x) USING (x)
  JOIN (SELECT y, CAST(row_number() OVER (ORDER BY sum(value) DESC, y) AS BIGINT) AS y_rank FROM s GROUP BY y)
    USING (y)""")
def heatmap_plain(spark, sf_dir):
    """Unscaled, reversed sign, grey mask, other axis ranked."""
    km = survival.km_table(survival.km_summary(S.storm(spark, sf_dir)))
    return explore.heatmap_cells(km, value="log_mean", method="none", grey="all_censored",
                                 reverse=True, reorder_x=False, reorder_y=True)


@query(f"""SELECT stream, parameter, year, {rnd('avg(rvalue)', 'annual_mean')}, {rnd('max(mdl)', 'mdl')},
  count(*) = count_if(coalesce(contains(rvqual, 'HighNonDetect'), false)) AS high_non_detect,
  make_date(year, 7, 1) AS date FROM storm GROUP BY stream, parameter, year""")
def annual_summary(spark, sf_dir):
    return explore.annual_summary(S.storm(spark, sf_dir))


@query(f"""SELECT stream, year, {rnd('avg(rvalue)', 'annual_mean')}, {rnd('median(mdl)', 'mdl')},
  count(*) = count_if(coalesce(contains(rvqual, 'HighNonDetect'), false)) AS high_non_detect,
  make_date(year, 7, 1) AS date FROM storm GROUP BY stream, year""")
def annual_summary_by_stream(spark, sf_dir):
    return explore.annual_summary(S.storm(spark, sf_dir), ["stream"], mdl="median")


def _qq_sql(quantile: str) -> str:
    return f"""WITH r AS (SELECT parameter, stream, mean, CAST(row_number() OVER (PARTITION BY parameter
      ORDER BY mean, stream) AS BIGINT) AS position, count(*) OVER (PARTITION BY parameter) AS n FROM km
      WHERE NOT all_censored),
    p AS (SELECT *, (position - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END)
      / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) AS p FROM r)
    SELECT parameter, stream, left(stream, 2) AS label, position, {rnd('mean', 'sample')},
      {rnd(quantile, 'theoretical')} FROM p"""


@query(_qq_sql(norm_quantile("p")))
def qq_normal(spark, sf_dir):
    return explore.qq_points(survival.km_table(survival.km_summary(S.storm(spark, sf_dir))))


@query(_qq_sql(f"exp({norm_quantile('p')})"))
def qq_lognormal(spark, sf_dir):
    return explore.qq_points(survival.km_table(survival.km_summary(S.storm(spark, sf_dir))),
                             dist="lnorm")


@query(f"""SELECT parameter, {rnd('q1', 'q1')}, {rnd('q3', 'q3')}, {rnd('q3 + 1.5 * (q3 - q1)', 'fence')},
  {rnd('q3 + 3 * (q3 - q1)', 'far_fence')} FROM (SELECT parameter, quantile_cont(mean, 0.25) AS q1,
    quantile_cont(mean, 0.75) AS q3 FROM km GROUP BY 1)""")
def outlier_fences(spark, sf_dir):
    return explore.outlier_fences(survival.km_summary(S.storm(spark, sf_dir)))


BOX = """WITH q AS (SELECT metal, stream, quantile_cont(pct_dissolved, 0.25) AS q1,
    quantile_cont(pct_dissolved, 0.5) AS median, quantile_cont(pct_dissolved, 0.75) AS q3
    FROM parts WHERE NOT below_mdl GROUP BY ALL),
  d AS (SELECT p.*, q1, median, q3, pct_dissolved BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
    FROM parts p JOIN q USING (metal, stream) WHERE NOT below_mdl)"""


@query(f"""{BOX} SELECT metal, stream, count(*) AS n, {rnd('max(q1)', 'q1')}, {rnd('max(median)', 'median')},
  {rnd('max(q3)', 'q3')}, {rnd('min(CASE WHEN inside THEN pct_dissolved END)', 'lower')},
  {rnd('max(CASE WHEN inside THEN pct_dissolved END)', 'upper')},
  CAST(count_if(NOT inside) AS BIGINT) AS outliers FROM d GROUP BY ALL""")
def box_stats(spark, sf_dir):
    pairs = fractions.uncensored(fractions.partition_fractions(S.storm(spark, sf_dir)))
    return explore.box_stats(pairs, ["metal", "stream"], "pct_dissolved")


@query(f"{BOX} SELECT metal, stream, date, locator, {rnd('pct_dissolved', 'pct_dissolved')} FROM d WHERE NOT inside")
def box_outliers(spark, sf_dir):
    pairs = fractions.uncensored(fractions.partition_fractions(S.storm(spark, sf_dir)))
    return explore.box_outliers(pairs, ["metal", "stream"], "pct_dissolved").select(
        "metal", "stream", "date", "locator", "pct_dissolved")


@query(f"""SELECT routine, stream, parameter, date, locator, {rnd('rvalue', 'rvalue')} FROM (
  SELECT * FROM storm UNION ALL BY NAME SELECT * FROM base) WHERE loc_group <> 'FDL'""")
def other_locations(spark, sf_dir):
    return explore.other_locations(S.storm(spark, sf_dir), S.base(spark, sf_dir)).select(
        "routine", "stream", "parameter", "date", "locator", "rvalue")


@query(f"""SELECT stream, parameter, date, locator, {rnd('mdl', 'mdl')}, {rnd('replacement', 'replacement')}
  FROM storm WHERE contains(rvqual, 'LowerMean') AND mdl < 1000""")
def lower_mean_points(spark, sf_dir):
    return explore.lower_mean_points(S.storm(spark, sf_dir))


@query(f"""SELECT {rnd('0.001 + 0.01 * i', 'x')}, {rnd('0.001 + 0.01 * i', 'y')}, {rnd('(0.001 + 0.01 * i) / 2', 'half', 6)}
  FROM range(0, 100000) r(i), (SELECT max(mdl) AS top FROM storm WHERE contains(rvqual, 'LowerMean')
    AND mdl < 1000) WHERE i <= floor((top - 0.001) / 0.01 + 1e-10)""", digits=6)
def guide_lines(spark, sf_dir):
    return explore.guide_lines(explore.lower_mean_points(S.storm(spark, sf_dir)), by=0.01)


@query(f"SELECT parameter, {rnd('1.1 * max(rvalue)', 'y_max')} FROM storm GROUP BY 1")
def parameter_maxima(spark, sf_dir):
    return explore.parameter_maxima(S.storm(spark, sf_dir))


# --- principal components ---------------------------------------------------------------------------

def _site_matrix(spark, sf_dir):
    """Streams by parameters."""
    return pca.packed_rows(reshape.group_mean(S.storm(spark, sf_dir)), "stream", "parameter", "grand_mean", PARAMETERS)


def _yearly_matrix(spark, sf_dir):
    """Stream and year by parameters; a cell is missing where a year has no rows of a parameter."""
    means = reshape.group_mean(S.storm(spark, sf_dir), ["stream", "parameter", "year"]).withColumn(
        "row", F.concat_ws("/", "stream", "year"))
    return pca.packed_rows(means, "row", "parameter", "grand_mean", PARAMETERS)


def _pca(method: str, matrix, name: str, sql: str | None = None):
    def run(spark, sf_dir):
        return pca.pca_missing(matrix(spark, sf_dir), PARAMETERS, 5, method).loadings_table(spark)
    run.__name__ = name
    query(sql)(run)


_pca("nipals", _yearly_matrix, "pca_nipals", nipals_sql(YEARLY_CELLS, (400, 1000, 1500, 1000, 600)))
_pca("nipals", _site_matrix, "pca_nipals_sites", nipals_sql(SITE_CELLS, [400] * 5))
# Without missing cells all methods have the same axes.
_pca("svdImpute", _site_matrix, "pca_svdimpute", nipals_sql(SITE_CELLS, [400] * 5))
_pca("ppca", _site_matrix, "pca_ppca", nipals_sql(SITE_CELLS, [400] * 5))
# With missing cells these two have no SQL; tests compare them with the methods on whole rows.
_pca("svdImpute", _yearly_matrix, "pca_svdimpute_gaps")
_pca("ppca", _yearly_matrix, "pca_ppca_gaps")


@query()
def pca_embeddings(spark, sf_dir):
    """Scores of the wide vectors on two components."""
    vectors = testbed.table(spark, sf_dir, "embeddings")
    size = vectors.select(F.max(F.size("embedding")).alias("n")).first()["n"]
    packed = vectors.select(F.col("vec_id").alias("row"),
                            F.col("embedding").cast("array<double>").alias("cells"))
    fitted = pca.pca_missing(packed, [f"e{i}" for i in range(size)], 2, "svdImpute")
    return fitted.scores.select("row", *[F.col("scores")[c].alias(f"pc{c + 1}") for c in range(2)])


def _q2(spark, sf_dir, method: str, k: int, tolerance: float = 1e-8):
    shares = pca.pca_q2(_yearly_matrix(spark, sf_dir), PARAMETERS, k, method, folds=10, tolerance=tolerance)
    return [(method, i + 1, v) for i, v in enumerate(shares)]


@query()
def pca_q2(spark, sf_dir):
    rows = _q2(spark, sf_dir, "nipals", 2, 1e-5)
    return spark.createDataFrame(rows, "method string, components int, q2 double")


@query(q2_sql(YEARLY_CELLS, 10))
def pca_q2_first(spark, sf_dir):
    return spark.createDataFrame(_q2(spark, sf_dir, "nipals", 1), "method string, components int, q2 double")


# --- end-to-end flows -----------------------------------------------------------------------------

def _limits(spark, sf_dir):
    """Every step from measurements to replaced rows of both event types."""
    return plans.detection_limits(testbed.measurements(spark, sf_dir), ["sample", "textvalue", "hardness", "qual"])


FLOW_OUT = f"""routine, stream, parameter, date, locator, below_mdl, {rnd('mdl', 'mdl')}, {rnd('replacement', 'replacement')},
  {rnd('rvalue', 'rvalue')}, rvqual"""


@query(f"SELECT {FLOW_OUT} FROM (FROM storm UNION ALL BY NAME FROM base)")
def flow_detection_limits(spark, sf_dir):
    limits = _limits(spark, sf_dir)
    return limits.storm.unionByName(limits.base).select(
        "routine", "stream", "parameter", "date", "locator", "below_mdl", "mdl", "replacement", "rvalue", "rvqual")


@query(_rates_sql("parameter"))
def flow_criteria_report(spark, sf_dir):
    return plans.criteria_report(_limits(spark, sf_dir).storm)["rates"]


@query(f"""WITH l AS (SELECT 1 - power(0.95, 1.0 / count(*)) AS level FROM gehan WHERE mean_wet > mean_routine),
  s AS (SELECT 'all' AS stream, parameter, {GEHAN_OUT}, p < 0.05 AND mean_wet > mean_routine AS pseudosig,
    coalesce(p < level, NULL) AND mean_wet > mean_routine AS sig FROM gehan, l)
  SELECT * FROM s UNION ALL BY NAME SELECT stream, parameter, {GEHAN_OUT},
    p < 0.05 AND mean_wet > mean_routine AS pseudosig FROM gehan2""")
def flow_storm_against_base(spark, sf_dir):
    """Tests of all streams together ('all') and of each."""
    found = plans.storm_against_base(_limits(spark, sf_dir))
    shared = ["stream", "parameter", "mean_wet", "mean_routine", "gehan_stat", "p", "censored_wet", "censored_routine", "pseudosig"]
    overall = found["overall"].withColumn("stream", F.lit("all")).select(*shared, "sig")
    return overall.unionByName(found["by_stream"].select(*shared, F.lit(None).cast("boolean").alias("sig")))


@query(f"""SELECT parameter, stream, {rnd('slope', 'slope')}, {rnd('grand_mean', 'grand_mean')}, {rnd(CHANGE, 'decadal_change')},
  {rnd(f'sign(slope) * log10(nullif(abs({CHANGE}), 0))', 'log_change')} FROM trend LEFT JOIN means USING (parameter, stream)
  WHERE p < 0.5 AND (parameter, stream) IN (SELECT (parameter, stream) FROM storm GROUP BY parameter, stream
    HAVING count(DISTINCT year) + CAST(bool_or(year IS NULL) AS INTEGER) >= 3)""")
def flow_trend_report(spark, sf_dir):
    return plans.trend_report(_limits(spark, sf_dir).storm, alpha=0.5)["changes"].select(
        "parameter", "stream", "slope", "grand_mean", "decadal_change", "log_change")
