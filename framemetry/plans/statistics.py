"""Experiment statistics over arms (event types) and units (user mod 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framemetry.operators import checks, stats
from framemetry.plans.bindings import (
    K, OUTCOMES_SQL, PAIRED_COUNTS, PAIRED_DOUBLES, T_CRIT_SQL, big, outcomes, paired_sql, rounded,
    table,
)
from framemetry.plans.registry import query

METRICS = ["score", "spread"]
COMPARISONS = [
    ("click_minus_error", "click", "error"),
    ("view_minus_error", "view", "error"),
    ("view_minus_click", "view", "click"),
]


def _long(spark, sf):
    return stats.outcomes_long(outcomes(spark, sf), ["arm", "unit"], METRICS)


def _pairs(spark, sf):
    return stats.pair_arms(_long(spark, sf), ["unit"], COMPARISONS)


PAIRS_SQL = f"""{OUTCOMES_SQL},
cmp(comparison, a_arm, b_arm) AS (VALUES
  ('click_minus_error', 'click', 'error'), ('view_minus_error', 'view', 'error'),
  ('view_minus_click', 'view', 'click')),
pairs AS (
  SELECT comparison, metric, l.unit, l.value AS a, r.value AS b, l.value - r.value AS delta
  FROM cmp JOIN long l ON l.arm = a_arm
  JOIN long r USING (unit, metric) WHERE r.arm = b_arm)"""


@query("mean_sd_ci", f"""WITH {OUTCOMES_SQL},
g AS (SELECT arm, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std_sample
      FROM long GROUP BY arm, metric)
SELECT arm, metric, n::BIGINT AS n, round(mean, 6) AS mean, round(std_sample, 6) AS std_sample,
       round(mean - {T_CRIT_SQL} * std_sample / sqrt(n), 6) AS ci95_low,
       round(mean + {T_CRIT_SQL} * std_sample / sqrt(n), 6) AS ci95_high FROM g""")
def _mean_sd_ci(spark, sf):
    out = stats.mean_sd_ci(_long(spark, sf), ["arm", "metric"])
    return rounded(out, ["mean", "std_sample", "ci95_low", "ci95_high"], ["n"], ["arm", "metric"])


@query("critical_value_join", f"""WITH g AS (
  SELECT event_type AS arm, count(DISTINCT user_id % 6) AS n FROM events GROUP BY 1)
SELECT arm, n::BIGINT AS n, {T_CRIT_SQL}::DOUBLE AS t_critical FROM g""")
def _critical_value_join(spark, sf):
    from framemetry.functions.special import t_critical

    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(
        F.countDistinct(F.col("user_id") % 6).alias("n")
    )
    return n.select("arm", big("n"), t_critical(F.col("n")).alias("t_critical"))


@query("mean_sd_pop", f"""WITH {OUTCOMES_SQL}
SELECT arm, metric, count(value)::BIGINT AS n, round(avg(value), 6) AS mean,
       round(stddev_pop(value), 6) AS std_pop FROM long GROUP BY arm, metric""")
def _mean_sd_pop(spark, sf):
    out = stats.mean_sd_pop(_long(spark, sf), ["arm", "metric"])
    return rounded(out, ["mean", "std_pop"], ["n"], ["arm", "metric"])


@query("group_summary", f"""WITH {OUTCOMES_SQL}
SELECT arm, count(*)::BIGINT AS n, round(avg(score), 6) AS score_mean,
       round(stddev_samp(score), 6) AS score_sd, round(avg(spread), 6) AS spread_mean,
       round(stddev_samp(spread), 6) AS spread_sd FROM outcomes GROUP BY arm""")
def _group_summary(spark, sf):
    out = stats.group_summary(outcomes(spark, sf), "arm", METRICS)
    return rounded(
        out, ["score_mean", "score_sd", "spread_mean", "spread_sd"], ["n"], ["arm"]
    )


@query("group_summary_lineitem", f"""WITH u AS (
  SELECT l_returnflag AS arm, l_linenumber AS unit, avg(l_extendedprice) * {K} AS price,
         avg(l_quantity) * {K} AS quantity FROM lineitem GROUP BY 1, 2)
SELECT arm, count(*)::BIGINT AS n, round(avg(price), 6) AS price_mean,
       round(stddev_samp(price), 6) AS price_sd, round(avg(quantity), 6) AS quantity_mean,
       round(stddev_samp(quantity), 6) AS quantity_sd FROM u GROUP BY arm""")
def _group_summary_lineitem(spark, sf):
    units = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("unit")
    ).agg(
        (F.avg("l_extendedprice") * K).alias("price"), (F.avg("l_quantity") * K).alias("quantity")
    )
    out = stats.group_summary(units, "arm", ["price", "quantity"])
    return rounded(
        out, ["price_mean", "price_sd", "quantity_mean", "quantity_sd"], ["n"], ["arm"]
    )


@query("select_metric", f"""WITH {OUTCOMES_SQL}
SELECT arm, unit, metric, round(value, 6) AS value FROM long
WHERE metric IN (SELECT CASE WHEN max(value) > 1 THEN 'spread' ELSE 'score' END FROM events)""")
def _select_metric(spark, sf):
    wanted = table(spark, sf, "events").agg(
        F.when(F.max("value") > 1, "spread").otherwise("score").alias("metric")
    )
    out = stats.select_metric(outcomes(spark, sf), ["arm", "unit"], METRICS, wanted)
    return rounded(out, ["value"], keep=["arm", "unit", "metric"])


@query("pair_arms", f"""WITH {PAIRS_SQL}
SELECT comparison, metric, unit, round(a, 6) AS a, round(b, 6) AS b, round(delta, 6) AS delta
FROM pairs""")
def _pair_arms(spark, sf):
    return rounded(
        _pairs(spark, sf), ["a", "b", "delta"], keep=["comparison", "metric", "unit"]
    )


@query("sign_flip_p", f"""WITH {PAIRS_SQL}, s AS ({paired_sql('pairs', 'comparison, metric')
       .replace('numbered AS', 'WITH numbered AS', 1)})
SELECT comparison, metric, exact_sign_flip_p FROM s""")
def _sign_flip_p(spark, sf):
    out = stats.sign_flip_p(_pairs(spark, sf), ["comparison", "metric"])
    return rounded(out, ["exact_sign_flip_p"], keep=["comparison", "metric"])


@query("sign_cross", f"""WITH {PAIRS_SQL},
numbered AS (SELECT comparison, metric, delta,
  row_number() OVER (PARTITION BY comparison, metric ORDER BY delta) - 1 AS i FROM pairs),
sized AS (SELECT comparison, metric, count(*) AS n FROM pairs GROUP BY 1, 2),
masks AS (SELECT comparison, metric, n, unnest(generate_series(0, (1::BIGINT << (n - 1)::INT) - 1)) AS mask
          FROM sized),
sums AS (SELECT comparison, metric, mask,
           abs(sum(CASE WHEN i > 0 AND (mask >> (i - 1)::INT) & 1 = 1 THEN -delta ELSE delta END)) AS s
         FROM masks JOIN numbered USING (comparison, metric) GROUP BY 1, 2, 3)
SELECT comparison, metric, count(*)::BIGINT AS vectors, round(sum(s), 6) AS sum_abs,
       round(max(s), 6) AS max_abs FROM sums GROUP BY 1, 2""")
def _sign_cross(spark, sf):
    sums = stats.sign_cross(_pairs(spark, sf), ["comparison", "metric"])
    out = sums.groupBy("comparison", "metric").agg(
        F.count("s").alias("vectors"), F.sum(F.abs("s")).alias("sum_abs"),
        F.max(F.abs("s")).alias("max_abs"),
    )
    return rounded(out, ["sum_abs", "max_abs"], ["vectors"], ["comparison", "metric"])


@query("paired_summary", f"WITH {PAIRS_SQL}, {paired_sql('pairs', 'comparison, metric')}")
def _paired_summary(spark, sf):
    out = stats.paired_summary(_pairs(spark, sf), ["comparison", "metric"])
    return rounded(out, PAIRED_DOUBLES, PAIRED_COUNTS, ["comparison", "metric"])


@query("scope_rollup", f"""WITH {PAIRS_SQL},
scoped AS (
  SELECT 'all' AS scope, comparison, metric, delta FROM pairs
  UNION ALL
  SELECT CASE WHEN unit < 3 THEN 'carbon' ELSE 'wood' END, comparison, metric, delta FROM pairs),
{paired_sql('scoped', 'scope, comparison, metric')}""")
def _scope_rollup(spark, sf):
    pairs = _pairs(spark, sf).withColumn(
        "material", F.when(F.col("unit") < 3, "carbon").otherwise("wood")
    )
    keys = ["scope", "comparison", "metric"]
    out = stats.scope_rollup(pairs, "material", ["comparison", "metric"])
    return rounded(out, PAIRED_DOUBLES, PAIRED_COUNTS, keys)


@query("scope_filter", f"""WITH {PAIRS_SQL}
SELECT CASE WHEN g.s = 0 THEN 'all' WHEN unit < 3 THEN 'carbon' ELSE 'wood' END AS scope,
       comparison, metric, unit, round(delta, 6) AS delta
FROM pairs, (VALUES (0), (1)) AS g(s)""")
def _scope_filter(spark, sf):
    pairs = _pairs(spark, sf).withColumn(
        "material", F.when(F.col("unit") < 3, "carbon").otherwise("wood")
    )
    out = stats.scoped(pairs, "material")
    return rounded(out, ["delta"], keep=["scope", "comparison", "metric", "unit"])


def _effects(spark, sf):
    pairs = _pairs(spark, sf)
    one = pairs.filter(F.col("comparison") == "click_minus_error")
    two = pairs.filter(F.col("comparison") == "view_minus_error")
    return one, two


INTERACTION_SQL = f"""{PAIRS_SQL},
arms AS (SELECT unit, metric,
           max(delta) FILTER (comparison = 'click_minus_error') AS one,
           max(delta) FILTER (comparison = 'view_minus_error') AS two
         FROM pairs GROUP BY unit, metric),
effects AS (
  SELECT 'first' AS effect, unit, metric, one AS delta FROM arms
  UNION ALL SELECT 'second', unit, metric, two FROM arms
  UNION ALL SELECT 'interaction', unit, metric, two - one FROM arms)"""
EFFECT_NAMES = ("first", "second", "interaction")


@query("interaction_effect",
       f"WITH {INTERACTION_SQL}, {paired_sql('effects', 'effect, metric')}")
def _interaction_effect(spark, sf):
    out = stats.interaction_effect(*_effects(spark, sf), ["unit"], EFFECT_NAMES)
    return rounded(out, PAIRED_DOUBLES, PAIRED_COUNTS, ["effect", "metric"])


@query("effect_union", f"""WITH {INTERACTION_SQL}
SELECT effect, metric, unit, round(delta, 6) AS delta FROM effects WHERE effect <> 'interaction'""")
def _effect_union(spark, sf):
    one, two = _effects(spark, sf)
    out = stats.effect_union({"first": one, "second": two})
    return rounded(out, ["delta"], keep=["effect", "metric", "unit"])


# The p-value has a closed form for every df; the SQL uses the one for df = 5 (six units).
T_TEST_SQL = f"""WITH {PAIRS_SQL},
g AS (SELECT comparison, metric, count(*) AS n, avg(delta) AS m, stddev_samp(delta) AS s
      FROM pairs GROUP BY 1, 2),
t AS (SELECT *, m / s AS d, m / s * sqrt(n) AS t, atan(abs(m / s * sqrt(n)) / sqrt(5)) AS th FROM g)
SELECT comparison, metric, n::BIGINT AS n, round(m, 6) AS mean_delta, round(d, 6) AS cohens_d,
       round(t, 6) AS t, (n - 1)::BIGINT AS df,
       round(1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0 / 3 * power(cos(th), 3))), 6) AS p_two_sided
FROM t"""


@query("paired_t_test", T_TEST_SQL)
def _paired_t_test(spark, sf):
    out = stats.paired_t_test(_pairs(spark, sf), ["comparison", "metric"])
    return rounded(
        out, ["mean_delta", "cohens_d", "t", "p_two_sided"], ["n", "df"], ["comparison", "metric"]
    )


@query("baseline_delta", f"""WITH {OUTCOMES_SQL},
g AS (SELECT arm, avg(score) AS score FROM outcomes GROUP BY arm),
b AS (SELECT score AS baseline FROM g WHERE arm = 'error')
SELECT arm, round(score, 6) AS score, round(score - baseline, 6) AS delta,
       round((score - baseline) * 100 / baseline, 6) AS overhead_pct,
       round(score * 100, 6) AS score_pct FROM g, b""")
def _baseline_delta(spark, sf):
    g = outcomes(spark, sf).groupBy("arm").agg(F.avg("score").alias("score"))
    out = stats.baseline_delta(g, "arm", "error", "score")
    out = out.withColumn("score_pct", stats.to_percent("score"))
    return rounded(out, ["score", "delta", "overhead_pct", "score_pct"], keep=["arm"])


@query("selection_summary", f"""WITH log AS (
  SELECT event_type AS arm, user_id AS seed, day(ts)::BIGINT AS epoch, avg(value) * {K} AS f1,
         stddev_pop(value) * {K} AS acc FROM events GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY arm, seed ORDER BY f1 DESC, epoch) AS r FROM log)
SELECT arm, count(*)::BIGINT AS n_seeds, round(avg(f1), 6) AS f1_mean,
       round(stddev_pop(f1), 6) AS f1_std, round(avg(acc), 6) AS acc_mean,
       round(stddev_pop(acc), 6) AS acc_std FROM best WHERE r = 1 GROUP BY arm""")
def _selection_summary(spark, sf):
    e = table(spark, sf, "events")
    log = e.groupBy(
        F.col("event_type").alias("arm"), F.col("user_id").alias("seed"),
        F.dayofmonth("ts").alias("epoch"),
    ).agg((F.avg("value") * K).alias("f1"), (F.stddev_pop("value") * K).alias("acc"))
    out = stats.selection_summary(log, "arm", "seed", "epoch", "f1", ["f1", "acc"])
    return rounded(
        out, ["f1_mean", "f1_std", "acc_mean", "acc_std"], ["n_seeds"], ["arm"]
    )


# --- checks -------------------------------------------------------------------------------------------------


def _published(spark, sf):
    """A second computation of the arm means from sums, disturbed on one arm and cut by another."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("arm"))
        .agg(
            (F.sum("value") / F.count("value")).alias("mean"),
            F.count("value").alias("n"),
        )
        .withColumn("mean", F.col("mean") + F.when(F.col("arm") == "click", 0.5).otherwise(0.0))
        .withColumn("n", F.col("n") + F.when(F.col("arm") == "view", 1).otherwise(0))
        .filter(F.col("arm") != "error")
    )


def _recomputed(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(
        F.avg("value").alias("mean"), F.count("value").alias("n")
    )


RECONCILE_SQL = """
actual AS (SELECT event_type AS arm, avg(value) AS mean, count(value)::DOUBLE AS n FROM events GROUP BY 1),
published AS (
  SELECT event_type AS arm,
         sum(value) / count(value) + CASE WHEN event_type = 'click' THEN 0.5 ELSE 0 END AS mean,
         count(value)::DOUBLE + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS n
  FROM events WHERE event_type <> 'error' GROUP BY 1),
cells AS (
  SELECT arm, 'mean' AS "column", a.mean AS actual, p.mean AS published, p.arm IS NULL AS lonely
  FROM actual a LEFT JOIN published p USING (arm)
  UNION ALL
  SELECT arm, 'n', a.n, p.n, p.arm IS NULL FROM actual a LEFT JOIN published p USING (arm)),
apart AS (SELECT * FROM cells WHERE lonely OR abs(actual - published) > 2e-9)"""


@query("reconcile", f"""WITH {RECONCILE_SQL}
SELECT arm, "column", round(actual, 6) AS actual, round(published, 6) AS published FROM apart""")
def _reconcile(spark, sf):
    out = checks.reconcile(_recomputed(spark, sf), _published(spark, sf), ["arm"], ["mean", "n"])
    return rounded(out, ["actual", "published"], keep=["arm", "column"])


@query("expect_close", f"""WITH {RECONCILE_SQL}
SELECT 'arm_means' AS "check", arm || ':mean' AS "key" FROM apart WHERE "column" = 'mean'""")
def _expect_close(spark, sf):
    return checks.expect_close(
        _recomputed(spark, sf), _published(spark, sf), ["arm"], ["mean"], "arm_means"
    ).select("check", "key")


@query("expect_counts_equal", f"""WITH {RECONCILE_SQL}
SELECT 'arm_counts' AS "check", arm || ':n' AS "key" FROM apart WHERE "column" = 'n'""")
def _expect_counts_equal(spark, sf):
    return checks.expect_counts_equal(
        _recomputed(spark, sf), _published(spark, sf), ["arm"], ["n"], "arm_counts"
    ).select("check", "key")


@query("expect_row_count", """SELECT 'row_count' AS "check", 'orders' AS "key",
  (SELECT count(*) FROM orders)::VARCHAR || ' rows, expected 6' AS detail
WHERE (SELECT count(*) FROM orders) <> 6""")
def _expect_row_count(spark, sf):
    return checks.expect_row_count(table(spark, sf, "orders"), 6, "orders")


@query("expect_values", """SELECT 'values' AS "check", 'status' AS "key",
  o_orderstatus || ' x' || count(*) AS detail FROM orders
WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus""")
def _expect_values(spark, sf):
    return checks.expect_values(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"], "status")


def _positions(spark, sf):
    """Units of two effect tables with an explicit position: users per event type by total."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    n = e.groupBy("event_type", "user_id").agg(F.count("value").alias("place"))
    return [
        n.filter(F.col("event_type") == t).select(F.col("user_id").alias("unit"), "place")
        for t in ("click", "view")
    ]


ALIGN_SQL = """
n AS (SELECT event_type, user_id AS unit, count(value) AS place FROM events
      WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
diff AS (
  SELECT coalesce(a.unit, b.unit) AS unit,
         CASE WHEN a.unit IS NULL THEN 'missing in first' WHEN b.unit IS NULL THEN 'missing in second'
              ELSE 'position differs' END AS problem
  FROM (SELECT * FROM n WHERE event_type = 'click') a
  FULL JOIN (SELECT * FROM n WHERE event_type = 'view') b ON a.unit = b.unit
  WHERE a.place IS DISTINCT FROM b.place)"""


@query("align_units", f"WITH {ALIGN_SQL} SELECT unit, problem FROM diff")
def _align_units(spark, sf):
    return checks.align_units(*_positions(spark, sf), "unit", "place")


@query("expect_same_order", f"""WITH {ALIGN_SQL}
SELECT 'order' AS "check", unit::VARCHAR AS "key", problem AS detail FROM diff""")
def _expect_same_order(spark, sf):
    return checks.expect_same_order(*_positions(spark, sf), "unit", "place", "order")


@query("protocol_guard", """SELECT 'protocol' AS "check", o_orderpriority AS "key",
  min(o_orderstatus) || ' + ' || max(o_orderstatus) AS detail
FROM orders GROUP BY o_orderpriority HAVING min(o_orderstatus) <> max(o_orderstatus)""")
def _protocol_guard(spark, sf):
    return checks.protocol_guard(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("run_all_checks", f"""WITH {RECONCILE_SQL}, {ALIGN_SQL}
SELECT 'arm_means' AS "check", arm || ':mean' AS "key" FROM apart WHERE "column" = 'mean'
UNION ALL SELECT 'arm_counts', arm || ':n' FROM apart WHERE "column" = 'n'
UNION ALL SELECT 'order', unit::VARCHAR FROM diff
UNION ALL SELECT 'row_count', 'orders' WHERE (SELECT count(*) FROM orders) <> 6""")
def _run_all_checks(spark, sf):
    actual, published = _recomputed(spark, sf), _published(spark, sf)
    return checks.run_all_checks(
        [
            checks.expect_close(actual, published, ["arm"], ["mean"], "arm_means"),
            checks.expect_counts_equal(actual, published, ["arm"], ["n"], "arm_counts"),
            checks.expect_same_order(*_positions(spark, sf), "unit", "place", "order"),
            checks.expect_row_count(table(spark, sf, "orders"), 6, "orders"),
        ]
    ).select("check", "key")
