"""Queries registered for the driver, and the SQL of what they compute."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from origo import sources
from origo.functions import normal, uniform
from origo.operators import activity, backtest, calibration, cleaning, compare, hazard, leakage, metrics, model, selection, subscription
from origo.operators.windows import first_origin, origins_frame
from origo.operators.windows import rolling_origins as make_origins
from origo.plans import tables as t

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- panels by activity -------------------------------------------------------

ACT = (datetime(1996, 1, 1), 22, 90, 7, 30)
ACT_SQL = t.origins_sql("1996-01-01", 22, 90, 7, 30)
RFM = ["recency_days", "frequency", "monetary"]

PANEL_SQL = f"""WITH {t.TX}, {ACT_SQL},
f AS (SELECT customer_id, as_of, label_start, label_end, date_sub('day', max(invoice_date), as_of) AS recency_days,
  count(DISTINCT invoice) AS frequency, sum(revenue) AS monetary
  FROM o JOIN tx ON invoice_date < as_of GROUP BY customer_id, as_of, label_start, label_end HAVING max(invoice_date) >= as_of - INTERVAL 365 DAY),
panel AS (SELECT customer_id, as_of, recency_days, frequency, CAST(monetary AS DOUBLE) AS monetary,
  CAST(NOT EXISTS (SELECT 1 FROM tx WHERE tx.customer_id = f.customer_id AND invoice_date >= label_start AND invoice_date < label_end) AS INTEGER) AS churned FROM f)"""
NAIVE_SQL = f"""WITH {t.TX}, {ACT_SQL},
e AS (SELECT DISTINCT as_of, label_start, label_end, customer_id FROM o JOIN tx ON invoice_date >= as_of - INTERVAL 365 DAY AND invoice_date < as_of),
nf AS (SELECT customer_id, date_sub('day', max(invoice_date), (SELECT max(invoice_date) FROM tx)) AS recency_days, count(DISTINCT invoice) AS frequency,
  CAST(sum(revenue) AS DOUBLE) AS monetary FROM tx GROUP BY 1),
naive AS (SELECT customer_id, as_of, recency_days, frequency, monetary,
  CAST(NOT EXISTS (SELECT 1 FROM tx WHERE tx.customer_id = e.customer_id AND invoice_date >= label_start AND invoice_date < label_end) AS INTEGER) AS churned
  FROM e JOIN nf USING (customer_id))"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    panel = activity.build_asof_panel(t.activity(spark, d), t.windows(*ACT))
    return panel.withColumn("monetary", F.col("monetary").cast("double"))


def _naive(spark: SparkSession, d: str) -> DataFrame:
    return activity.build_naive_panel(t.activity(spark, d), t.windows(*ACT)).withColumn("monetary", F.col("monetary").cast("double"))


@query(PANEL_SQL + f" SELECT customer_id, {t.DAY}, recency_days, frequency, monetary, churned FROM panel")
def asof_rfm_panel(spark, d):
    return _panel(spark, d).select("customer_id", t.day(), *RFM, "churned")


@query(PANEL_SQL + f" SELECT {t.DAY}, count(*) AS n, round(avg(churned), 9) AS churn_rate FROM panel GROUP BY ALL")
def origin_prevalence(spark, d):
    return _panel(spark, d).groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("churned"), 9).alias("churn_rate")).select(t.day(), "n", "churn_rate")


@query(f"""WITH {t.TX}, {ACT_SQL} SELECT {t.DAY}, days, count(DISTINCT customer_id) AS n FROM o, (VALUES (60), (365)) v(days), tx
  WHERE invoice_date >= as_of - to_days(days) AND invoice_date < as_of GROUP BY ALL""")
def eligible_counts(spark, d):
    tx, w = t.activity(spark, d), t.windows(*ACT)
    both = [activity.eligible_customers(tx, w, n).withColumn("days", F.lit(n)) for n in (60, 365)]
    return both[0].unionByName(both[1]).groupBy("as_of", "days").agg(F.count(F.lit(1)).alias("n")).select(t.day(), "days", "n")


@query(NAIVE_SQL + f" SELECT customer_id, {t.DAY}, recency_days, frequency, monetary, churned FROM naive")
def naive_rfm_panel(spark, d):
    return _naive(spark, d).select("customer_id", t.day(), *RFM, "churned")


@query(PANEL_SQL + "," + NAIVE_SQL.split(f"{ACT_SQL},")[1] + """,
d AS (SELECT unnest(['recency_days', 'frequency', 'monetary']) AS feature,
  unnest([CAST(n.recency_days - p.recency_days AS DOUBLE), CAST(n.frequency - p.frequency AS DOUBLE), n.monetary - p.monetary]) AS d
  FROM naive n JOIN panel p USING (customer_id, as_of))
SELECT feature, round(avg(CAST(d <> 0 AS INTEGER)), 9) AS pct_differing, round(median(d), 4) AS median_delta, round(avg(d), 4) AS mean_delta FROM d GROUP BY 1""")
def naive_vs_asof_delta(spark, d):
    delta = leakage.feature_delta(_naive(spark, d), _panel(spark, d), RFM, ["customer_id", "as_of"])
    return delta.select("feature", F.round("pct_differing", 9).alias("pct_differing"), F.round("median_delta", 4).alias("median_delta"), F.round("mean_delta", 4).alias("mean_delta"))


@query(f"""WITH {t.TX} SELECT customer_id, CAST(max(invoice_date) < (SELECT max(invoice_date) FROM tx) - INTERVAL 90 DAY AS INTEGER) AS churned FROM tx GROUP BY 1""")
def tautological_label(spark, d):
    return activity.tautological_label(t.activity(spark, d), 90)


@query(PANEL_SQL + """, r AS (SELECT customer_id, idx, churned AS y FROM panel JOIN o USING (as_of)),
p AS (SELECT lag, a.idx, avg(CAST(a.y = b.y AS INTEGER)) AS a, avg(a.y) AS p, avg(b.y) AS q FROM (VALUES (1), (2), (3)) v(lag) JOIN r a ON true
  JOIN r b ON a.customer_id = b.customer_id AND b.idx = a.idx + lag GROUP BY ALL)
SELECT lag, round(avg(a), 9) AS agreement, round(avg(p * q + (1 - p) * (1 - q)), 9) AS independent FROM p GROUP BY 1""")
def label_agreement_lag(spark, d):
    found = leakage.label_agreement_by_lag(_panel(spark, d))
    return found.select("lag", F.round("agreement", 9).alias("agreement"), F.round("independent", 9).alias("independent"))


CUT = datetime(1999, 1, 1)


@query(PANEL_SQL + """, a AS (SELECT DISTINCT customer_id FROM panel WHERE as_of < '1999-01-01'), b AS (SELECT DISTINCT customer_id FROM panel WHERE as_of >= '1999-01-01')
SELECT (SELECT count(*) FROM a) AS n_train, (SELECT count(*) FROM b) AS n_test, (SELECT count(*) FROM a JOIN b USING (customer_id)) AS n_both,
  round((SELECT count(*) FROM a JOIN b USING (customer_id)) / (SELECT count(*) FROM b), 9) AS share_seen""")
def customer_overlap(spark, d):
    panel, cut = _panel(spark, d), F.lit(CUT).cast("timestamp_ntz")
    found = leakage.customer_overlap(panel.filter(F.col("as_of") < cut), panel.filter(F.col("as_of") >= cut))
    return found.withColumn("share_seen", F.round("share_seen", 9))


# --- cleaning -----------------------------------------------------------------


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stock_code, o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS as_of,
  CAST(CAST(l_quantity AS INTEGER) - 3 AS INTEGER) AS quantity, l_extendedprice AS price, round((CAST(l_quantity AS INTEGER) - 3) * l_extendedprice, 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P' AND l_partkey % 50 <> 0 AND o_custkey % 17 <> 0 AND l_quantity > 3 AND l_extendedprice > 0""")
def clean_transactions(spark, d):
    rows = cleaning.clean_retail(t.raw_retail(spark, d))
    return rows.select("invoice", "stock_code", "customer_id", t.day("invoice_date"), "quantity", "price", F.round("revenue", 2).alias("revenue"))


SUB_COLUMNS = "customer_id, payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid, is_auto_renew, transaction_date, membership_expire_date, is_cancel"


def _clean_sub(spark, d):
    rows = t.raw_subscription(spark, d)
    raw = rows.withColumnRenamed("customer_id", "msno").withColumns({c: F.date_format(c, "yyyyMMdd").cast("int") for c in ("transaction_date", "membership_expire_date")})
    return cleaning.clean_subscriptions(raw)


@query(f"WITH {t.RAW_SUB} SELECT DISTINCT * REPLACE (strftime(transaction_date, '%Y-%m-%d') AS transaction_date, strftime(membership_expire_date, '%Y-%m-%d') AS membership_expire_date) FROM raw WHERE membership_expire_date >= '2000-01-01' AND NOT (membership_expire_date < transaction_date AND is_cancel = 0)")
def clean_subscriptions(spark, d):
    return _clean_sub(spark, d).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("transaction_date", "membership_expire_date")})


@query(f"""WITH {t.RAW_SUB}, n AS (SELECT *, row_number() OVER (PARTITION BY {SUB_COLUMNS}) AS k FROM raw)
SELECT CASE WHEN k > 1 THEN 'duplicate' WHEN membership_expire_date < '2000-01-01' THEN 'sentinel_expiry'
  WHEN membership_expire_date < transaction_date AND is_cancel = 0 THEN 'inconsistent_expiry' ELSE 'kept' END AS reason, count(*) AS n FROM n GROUP BY 1""")
def drop_attribution(spark, d):
    return cleaning.drop_attribution(t.raw_subscription(spark, d))


@query(f"""WITH {t.RAW_SUB} SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate,
  count(*) FILTER (membership_expire_date < '2000-01-01') AS sentinel_expiry,
  count(*) FILTER (membership_expire_date < transaction_date AND is_cancel = 0) AS inconsistent_expiry FROM raw""")
def drop_counts(spark, d):
    return cleaning.drop_counts(t.raw_subscription(spark, d))


@query(f"WITH {t.SUB} SELECT payment_plan_days, count(*) AS n, round(count(*) / (SELECT count(*) FROM sub), 9) AS share FROM sub GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def plan_distribution(spark, d):
    rows = t.subscription(spark, d)
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_all")))  # one row
    counts = rows.groupBy("payment_plan_days").agg(F.count(F.lit(1)).alias("n")).join(total)
    return counts.select("payment_plan_days", "n", F.round(F.col("n") / F.col("_all"), 9).alias("share")).orderBy(F.desc("n"), "payment_plan_days").limit(8)


@query(f"""WITH {t.TX}, f AS (SELECT customer_id, min(invoice_date) AS d FROM tx GROUP BY 1)
SELECT CAST(round(quantile_cont(epoch(d), 0.8)) AS BIGINT) AS q80, count(*) AS n FROM f""")
def first_purchase_quantile(spark, d):
    first = t.activity(spark, d).groupBy("customer_id").agg(F.min("invoice_date").alias("d"))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("d"))
    return selection.quantiles(first.select(seconds.alias("s")), "s", {"q80": 0.8}).select(F.round("q80").cast("long").alias("q80"), "n")


# --- panels by subscription ---------------------------------------------------

SUBW = (datetime(1996, 1, 1), 60, 30, 7, 30)


def _sub_sql(gap: int, egap: int) -> str:
    return f"""WITH {t.SUB}, {t.origins_sql("1996-01-01", 60, 30, gap, 30, egap)},
u AS (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY customer_id, transaction_date ORDER BY membership_expire_date DESC, payment_method_id DESC,
  payment_plan_days DESC, plan_list_price DESC, actual_amount_paid DESC, is_auto_renew DESC, is_cancel DESC) = 1),
g AS (SELECT as_of, label_start, label_end, egap, customer_id, first FROM o, (SELECT customer_id, min(transaction_date) AS first FROM sub GROUP BY 1)),
m AS (SELECT g.as_of, label_start, label_end, g.customer_id, date_diff('day', g.as_of, membership_expire_date) AS days_until_expiry,
  date_diff('day', first, g.as_of) AS tenure_days, actual_amount_paid AS current_plan_price, is_auto_renew
  FROM g ASOF JOIN u ON g.customer_id = u.customer_id AND g.as_of > u.transaction_date
  WHERE membership_expire_date >= g.as_of - INTERVAL 45 DAY AND membership_expire_date < g.as_of + to_days(egap)),
l AS (SELECT as_of, customer_id, count(*) AS nt, count(*) FILTER (is_cancel = 1) AS nc FROM o JOIN sub ON transaction_date >= as_of - INTERVAL 180 DAY AND transaction_date < as_of GROUP BY ALL),
panel AS (SELECT customer_id, as_of, CAST(days_until_expiry AS INTEGER) AS days_until_expiry, CAST(tenure_days AS INTEGER) AS tenure_days, current_plan_price, is_auto_renew,
  coalesce(nt, 0) AS n_transactions_lookback, coalesce(nc, 0) AS n_cancellations_lookback,
  CAST(NOT EXISTS (SELECT 1 FROM sub WHERE sub.customer_id = m.customer_id AND is_cancel = 0 AND transaction_date >= label_start AND transaction_date < label_end) AS INTEGER) AS churned
  FROM m LEFT JOIN l USING (as_of, customer_id))"""


SUB_SQL = _sub_sql(7, 7)
FEATURES = list(subscription.FEATURES)


def _sub_panel(spark, d):
    return subscription.build_subscription_panel(t.subscription(spark, d), t.windows(*SUBW))


@query(SUB_SQL + f" SELECT {t.DAY}, customer_id, days_until_expiry, tenure_days, current_plan_price, is_auto_renew FROM panel")
def asof_membership_state(spark, d):
    return subscription.membership_state(t.subscription(spark, d), t.windows(*SUBW)).select(t.day(), "customer_id", *FEATURES[:4])


@query(SUB_SQL + f" SELECT {t.DAY}, customer_id, nt AS n_transactions_lookback, nc AS n_cancellations_lookback FROM l")
def lookback_counts(spark, d):
    return subscription.lookback_counts(t.subscription(spark, d), t.windows(*SUBW)).select(t.day(), "customer_id", *FEATURES[4:])


@query(SUB_SQL + f" SELECT {t.DAY}, customer_id, churned FROM panel")
def subscription_label(spark, d):
    tx, w = t.subscription(spark, d), t.windows(*SUBW)
    return subscription.with_label(subscription.membership_state(tx, w), tx, w).select(t.day(), "customer_id", "churned")


@query(SUB_SQL + f" SELECT customer_id, {t.DAY}, {', '.join(FEATURES)}, churned FROM panel")
def subscription_panel(spark, d):
    return _sub_panel(spark, d).select("customer_id", t.day(), *FEATURES, "churned")


@query(_sub_sql(0, 7) + f" SELECT customer_id, {t.DAY}, {', '.join(FEATURES)}, churned FROM panel")
def subscription_panel_pinned_gap(spark, d):
    w = t.windows(SUBW[0], SUBW[1], SUBW[2], 0, SUBW[4])
    return subscription.build_subscription_panel(t.subscription(spark, d), w, eligibility_gap_days=7).select("customer_id", t.day(), *FEATURES, "churned")


@query(SUB_SQL + """, x AS (SELECT panel.churned, CAST(EXISTS (SELECT 1 FROM sub WHERE sub.customer_id = panel.customer_id AND is_cancel = 0
  AND transaction_date >= panel.as_of AND transaction_date < panel.as_of + INTERVAL 7 DAY) AS INTEGER) AS renewed_in_gap FROM panel)
SELECT renewed_in_gap, count(*) AS n, round(avg(churned), 9) AS churn_rate, round(count(*) / (SELECT count(*) FROM x), 9) AS share FROM x GROUP BY 1""")
def gap_effect(spark, d):
    tx, w = t.subscription(spark, d), t.windows(*SUBW)
    found = subscription.gap_effect(tx, subscription.build_subscription_panel(tx, w), w)
    return found.select("renewed_in_gap", "n", F.round("churn_rate", 9).alias("churn_rate"), F.round("share", 9).alias("share"))


SUB_NAIVE = f"""nv AS (SELECT customer_id, CAST(date_diff('day', (SELECT max(transaction_date) FROM sub), membership_expire_date) AS INTEGER) AS days_until_expiry,
  CAST(date_diff('day', first, (SELECT max(transaction_date) FROM sub)) AS INTEGER) AS tenure_days, actual_amount_paid AS current_plan_price, is_auto_renew,
  nt AS n_transactions_lookback, nc AS n_cancellations_lookback
FROM (SELECT *, min(transaction_date) OVER (PARTITION BY customer_id) AS first, count(*) OVER (PARTITION BY customer_id) AS nt,
  count(*) FILTER (is_cancel = 1) OVER (PARTITION BY customer_id) AS nc FROM sub
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY transaction_date DESC, membership_expire_date DESC, payment_method_id DESC, payment_plan_days DESC,
    plan_list_price DESC, actual_amount_paid DESC, is_auto_renew DESC, is_cancel DESC) = 1))"""


@query(f"WITH {t.SUB}, {SUB_NAIVE} SELECT customer_id, {', '.join(FEATURES)} FROM nv")
def naive_subscription_features(spark, d):
    return subscription.naive_features(t.subscription(spark, d))


@query(SUB_SQL + f", {SUB_NAIVE} SELECT customer_id, {t.DAY}, {', '.join('nv.' + c for c in FEATURES)}, churned FROM panel JOIN nv USING (customer_id)")
def naive_subscription_panel(spark, d):
    tx = t.subscription(spark, d)
    return subscription.build_naive_panel(_sub_panel(spark, d), tx).select("customer_id", t.day(), *FEATURES, "churned")


# --- origins ------------------------------------------------------------------

PLAN = (datetime(1996, 1, 1), 22, 30, 7, 30)


def _plan_sql(extra: str) -> str:
    return f"""WITH {t.origins_sql("1996-01-01", 22, 30, 7, 30)} SELECT strftime(b.as_of, '%Y-%m-%d') AS test_as_of, count(*) AS n_train,
strftime(min(a.as_of), '%Y-%m-%d') AS first_train, strftime(max(a.as_of), '%Y-%m-%d') AS last_train FROM o b JOIN o a ON a.idx < b.idx AND b.idx >= 2 {extra} GROUP BY 1"""


def _plan(spark, **options):
    found = backtest.origin_plan(origins_frame(spark, t.windows(*PLAN)), min_training_origins=2, **options)
    return found.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c != "n_train" else F.col(c) for c in found.columns])


@query(_plan_sql("AND a.label_end <= b.as_of"))
def origin_plan_expanding(spark, d):
    return _plan(spark)


@query(_plan_sql("AND a.label_end <= b.as_of AND a.as_of >= b.as_of - INTERVAL 180 DAY"))
def origin_plan_sliding(spark, d):
    return _plan(spark, max_lookback_days=180)


@query(_plan_sql(""))
def origin_plan_unpurged(spark, d):
    return _plan(spark, purge=False)


# --- hazards ------------------------------------------------------------------

HAZ = (datetime(2024, 1, 5), 3, 5, 1, 9)
HAZ_SQL = t.origins_sql("2024-01-05", 3, 5, 1, 9)
HAZ_PANEL = f"""WITH {t.PURCHASES}, {HAZ_SQL}, f AS (SELECT as_of, label_start, customer_id, min(event_date) AS first FROM o JOIN ev ON event_date >= label_start AND event_date < label_end GROUP BY ALL),
fp AS (SELECT as_of, customer_id, CAST(date_sub('day', label_start, first) // 3 + 1 AS INTEGER) AS period FROM f),
pn AS (SELECT as_of, customer_id, count(*) AS n_before FROM o JOIN ev ON event_date < as_of GROUP BY ALL)"""


def _hazard_panel(spark, d):
    ev, w = t.purchases(spark, d), t.windows(*HAZ)
    return ev, w, activity.counts_before(ev, w, "n_before", time_col="event_date")


@query(HAZ_PANEL + f" SELECT {t.DAY}, customer_id, period FROM fp")
def first_event_period(spark, d):
    ev, w, _ = _hazard_panel(spark, d)
    return hazard.first_event_period(ev, w, time_col="event_date", period_days=3).select(t.day(), "customer_id", "period")


@query(HAZ_PANEL + f""", x AS (SELECT customer_id, as_of, n_before, fp.period AS e, unnest(range(1, coalesce(fp.period, 3) + 1)) AS period FROM pn LEFT JOIN fp USING (as_of, customer_id))
SELECT customer_id, {t.DAY}, CAST(period AS INTEGER) AS period, CAST(coalesce(period = e, false) AS INTEGER) AS event, n_before FROM x""")
def person_period_panel(spark, d):
    ev, w, panel = _hazard_panel(spark, d)
    rows = hazard.person_periods(ev, w, panel, ["n_before"], time_col="event_date", period_days=3)
    return rows.select("customer_id", t.day(), "period", "event", "n_before")


HAZARDS = HAZ_PANEL + ", h AS (SELECT as_of, customer_id, p AS period, ((n_before * 7 + p * 13) % 90) / 100.0 AS hazard FROM pn, (VALUES (1), (2), (3)) v(p))"


def _hazards(spark, d):
    _, _, panel = _hazard_panel(spark, d)
    return hazard.expand_periods(panel, 3).withColumn("hazard", ((F.col("n_before") * 7 + F.col("period") * 13) % 90) / 100)


@query(HAZARDS + f" SELECT {t.DAY}, customer_id, round(product(1 - hazard), 9) AS survival FROM h GROUP BY ALL")
def survival_product(spark, d):
    return hazard.survival(_hazards(spark, d)).select(t.day(), "customer_id", F.round("survival", 9).alias("survival"))


@query(HAZARDS + f" SELECT {t.DAY}, customer_id, period, round(product(1 - hazard) OVER (PARTITION BY as_of, customer_id ORDER BY period), 9) AS survival FROM h")
def survival_cumulative(spark, d):
    return hazard.cumulative_survival(_hazards(spark, d)).select(t.day(), "customer_id", "period", F.round("survival", 9).alias("survival"))


@query(HAZARDS + """, c AS (SELECT period, hazard, product(1 - hazard) OVER (PARTITION BY as_of, customer_id ORDER BY period) AS s FROM h),
m AS (SELECT period, avg(hazard) AS mean_hazard, avg(s) AS mean_survival FROM c GROUP BY 1)
SELECT period, round(mean_hazard, 9) AS mean_hazard, round(mean_survival, 9) AS mean_survival, round(-ln(mean_survival), 9) AS cumulative_hazard,
  round(lag(mean_survival, 1, 1.0) OVER (ORDER BY period) - mean_survival, 9) AS survival_drop FROM m""")
def hazard_period_summary(spark, d):
    found = hazard.period_summary(_hazards(spark, d))
    return found.select("period", *[F.round(c, 9).alias(c) for c in ("mean_hazard", "mean_survival", "cumulative_hazard", "survival_drop")])


@query(PANEL_SQL + """, c AS (SELECT customer_id FROM panel WHERE as_of = '1996-01-01' AND churned = 1),
e AS (SELECT label_end AS le FROM o WHERE as_of = '1996-01-01'),
b AS (SELECT customer_id, date_sub('day', (SELECT le FROM e), min(invoice_date)) AS d FROM tx JOIN c USING (customer_id) WHERE invoice_date >= (SELECT le FROM e) GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS n_churned, count(*) AS n_returned, count(*) FILTER (d <= 14) AS within_14, count(*) FILTER (d > 90) AS beyond_90,
  CAST(median(d) AS DOUBLE) AS median_days, (SELECT date_sub('day', (SELECT le FROM e), max(invoice_date)) FROM tx) AS tail_days FROM b""")
def late_returners(spark, d):
    return hazard.late_returners(t.activity(spark, d), _panel(spark, d), t.windows(*ACT)[0])


# --- metrics over a score that both sides compute -----------------------------

SCORED = PANEL_SQL + ", s AS (SELECT customer_id, panel.as_of, churned AS y, ((customer_id * 7919 + idx * 104729) % 1000) / 1000.0 AS p FROM panel JOIN o ON panel.as_of = o.as_of)"
BUNDLE = """round((sum(fp * (tpa + tp / 2.0))) / (sum(tp) * sum(fp)), 9) AS roc_auc, round(sum(tp * (tpa + tp) / CAST(na + n AS DOUBLE)) / sum(tp), 9) AS pr_auc"""


def _scored(spark, d):
    origins = F.broadcast(origins_frame(spark, t.windows(*ACT)).select("as_of", "idx"))  # a row for each origin
    p = ((F.col("customer_id") * 7919 + F.col("idx") * 104729) % 1000) / 1000
    return _panel(spark, d).join(origins, "as_of").select("customer_id", "as_of", F.col("churned").alias("y"), p.alias("p"))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(SCORED + f""", k AS (SELECT p, sum(y) AS tp, count(*) AS n, count(*) - sum(y) AS fp FROM s GROUP BY 1),
c AS (SELECT *, coalesce(sum(tp) OVER w, 0) AS tpa, coalesce(sum(n) OVER w, 0) AS na FROM k WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(tp) / sum(n), 9) AS prevalence, {BUNDLE}, (SELECT round(avg((p - y) * (p - y)), 9) FROM s) AS brier FROM c""")
def score_bundle(spark, d):
    return _rounded(metrics.score(_scored(spark, d)), "prevalence", "roc_auc", "pr_auc", "brier")


@query(SCORED + f""", k AS (SELECT as_of, p, sum(y) AS tp, count(*) AS n, count(*) - sum(y) AS fp FROM s GROUP BY ALL),
c AS (SELECT *, coalesce(sum(tp) OVER w, 0) AS tpa, coalesce(sum(n) OVER w, 0) AS na FROM k WINDOW w AS (PARTITION BY as_of ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT as_of, round(avg((p - y) * (p - y)), 9) AS brier FROM s GROUP BY 1)
SELECT {t.DAY}, CAST(sum(n) AS BIGINT) AS n, round(sum(tp) / sum(n), 9) AS prevalence, {BUNDLE}, any_value(brier) AS brier FROM c JOIN b USING (as_of) GROUP BY c.as_of""".replace("strftime(as_of", "strftime(c.as_of"))
def score_by_origin(spark, d):
    found = _rounded(metrics.score(_scored(spark, d), by=["as_of"]), "prevalence", "roc_auc", "pr_auc", "brier")
    return found.select(t.day(), "n", "prevalence", "roc_auc", "pr_auc", "brier")


@query(PANEL_SQL + """, l AS (SELECT unnest(['recency_days', 'frequency', 'monetary']) AS feature, unnest([CAST(recency_days AS DOUBLE), CAST(frequency AS DOUBLE), monetary]) AS v, churned AS y FROM panel),
k AS (SELECT feature, v, sum(y) AS tp, count(*) - sum(y) AS fp FROM l GROUP BY ALL),
c AS (SELECT *, coalesce(sum(tp) OVER (PARTITION BY feature ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tpa FROM k),
a AS (SELECT feature, sum(fp * (tpa + tp / 2.0)) / (sum(tp) * sum(fp)) AS auc FROM c GROUP BY 1) SELECT feature, round(greatest(auc, 1 - auc), 9) AS auc FROM a""")
def single_feature_auc(spark, d):
    return _rounded(leakage.single_feature_auc(_panel(spark, d), RFM), "auc")


BINS = "bins AS (SELECT CAST(greatest(len(list_filter([i / {n}.0 for i in range({n})], lambda e: e < p)) - 1, 0) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS obs FROM s GROUP BY 1)"


@query(SCORED + ", " + BINS.format(n=10) + """ SELECT bin, round(bin / 10.0, 9) AS bin_lower, round((bin + 1) / 10.0, 9) AS bin_upper, n, round(mp, 9) AS mean_predicted,
  round(obs, 9) AS observed_rate, round(obs - mp, 9) AS gap FROM bins""")
def reliability_table(spark, d):
    found = calibration.reliability_gap(calibration.reliability_table(_scored(spark, d)))
    return _rounded(found, "bin_lower", "bin_upper", "mean_predicted", "observed_rate", "gap")


def _brier_sql(n: int) -> str:
    return f"""SELECT {n} AS n_bins, round(rel, 9) AS reliability, round(res, 9) AS resolution, round(base * (1 - base), 9) AS uncertainty, round(base * (1 - base) - res + rel, 9) AS brier_binned
FROM (SELECT (SELECT avg(y) FROM s) AS base, sum(n * (mp - obs) ** 2) / sum(n) AS rel, sum(n * (obs - (SELECT avg(y) FROM s)) ** 2) / sum(n) AS res
  FROM (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS obs FROM s GROUP BY greatest(len(list_filter([i / {n}.0 for i in range({n})], lambda e: e < p)) - 1, 0)))"""


@query(SCORED + " " + " UNION ALL ".join(map(_brier_sql, (5, 10, 15, 20, 30))))
def brier_decomposition(spark, d):
    found = _rounded(calibration.bin_sensitivity(_scored(spark, d)), "reliability", "resolution", "uncertainty", "brier_binned")
    return found.select("n_bins", "reliability", "resolution", "uncertainty", "brier_binned")


OFFER = {"offer_cost": 2.5, "saved_margin": 16.0, "save_rate": 0.25}
THRESHOLDS = [i / 20 for i in range(1, 20)]


@query(SCORED + ", th AS (SELECT i / 20.0 AS threshold FROM range(1, 20) t(i)) SELECT threshold, count(*) FILTER (p >= threshold) AS n_targeted, CAST(4.0 * coalesce(sum(y) FILTER (p >= threshold), 0) - 2.5 * count(*) FILTER (p >= threshold) AS DOUBLE) AS expected_value FROM th, s GROUP BY 1")
def ev_sweep(spark, d):
    return metrics.sweep_expected_value(_scored(spark, d), THRESHOLDS, **OFFER)


@query(SCORED + " SELECT 0.625 AS threshold, count(*) FILTER (p >= 0.625) AS n_targeted, CAST(4.0 * coalesce(sum(y) FILTER (p >= 0.625), 0) - 2.5 * count(*) FILTER (p >= 0.625) AS DOUBLE) AS expected_value FROM s".replace("0.625 AS threshold", "CAST(0.625 AS DOUBLE) AS threshold"))
def ev_breakeven(spark, d):
    return metrics.sweep_expected_value(_scored(spark, d), [metrics.break_even_threshold(**OFFER)], **OFFER)


@query(SCORED + """, l AS (SELECT y, row_number() OVER (ORDER BY p DESC, customer_id) AS r FROM s WHERE as_of = (SELECT max(as_of) FROM s)), k AS (SELECT unnest([100, 200, 300, 500, 1000]) AS budget)
SELECT budget, count(*) FILTER (r <= budget) AS n_targeted, CAST(coalesce(sum(y) FILTER (r <= budget), 0) AS BIGINT) AS churners,
  CAST(4.0 * coalesce(sum(y) FILTER (r <= budget), 0) - 2.5 * count(*) FILTER (r <= budget) AS DOUBLE) AS expected_value FROM k, l GROUP BY 1""")
def budget_ev(spark, d):
    rows = _scored(spark, d)
    last = F.broadcast(rows.agg(F.max("as_of").alias("as_of")))  # one row
    return metrics.budget_value(rows.join(last, "as_of"), [100, 200, 300, 500, 1000], "customer_id", **OFFER)


@query(SCORED + " SELECT y AS actual, CAST(p >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM s GROUP BY ALL")
def confusion_matrix(spark, d):
    return metrics.confusion(_scored(spark, d))


@query(SCORED + """, k AS (SELECT p, sum(y) AS tp, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT p, sum(tp) OVER w AS tp, sum(n) OVER w AS n, sum(tp) OVER () AS pos, sum(n) OVER () AS total FROM k WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT CAST(p AS DOUBLE) AS threshold, round(CAST((n - tp) / (total - pos) AS DOUBLE), 9) AS fpr, round(CAST(tp / pos AS DOUBLE), 9) AS tpr, round(CAST(tp / n AS DOUBLE), 9) AS precision FROM c""")
def roc_points(spark, d):
    return _rounded(metrics.points(_scored(spark, d)), "fpr", "tpr", "precision")


@query(SCORED + """, th AS (SELECT i / 20.0 AS threshold FROM range(1, 20) t(i)), e AS (SELECT threshold, count(*) FILTER (p >= threshold) AS n_targeted,
  CAST(4.0 * coalesce(sum(y) FILTER (p >= threshold), 0) - 2.5 * count(*) FILTER (p >= threshold) AS DOUBLE) AS expected_value FROM th, s GROUP BY 1)
SELECT CAST(threshold AS DOUBLE) AS threshold, n_targeted, expected_value FROM e ORDER BY expected_value DESC, threshold LIMIT 1""")
def peeked_optimum(spark, d):
    return metrics.peeked_optimum(_scored(spark, d), THRESHOLDS, **OFFER)


@query(SCORED + f""" SELECT {t.DAY.replace("panel.as_of", "s.as_of")}, round(avg(p), 9) AS mean_predicted, round(avg(y), 9) AS prevalence, round(avg(p) - avg(y), 9) AS difference FROM s GROUP BY as_of""")
def mean_against_prevalence(spark, d):
    found = _rounded(metrics.mean_against_prevalence(_scored(spark, d), by=["as_of"]), "mean_predicted", "prevalence", "difference")
    return found.select(t.day(), "mean_predicted", "prevalence", "difference")


@query(PANEL_SQL + """ SELECT 'recency_days' AS a, 'frequency' AS b, round(corr(recency_days, frequency), 9) AS correlation FROM panel
UNION ALL SELECT 'recency_days', 'monetary', round(corr(recency_days, monetary), 9) FROM panel UNION ALL SELECT 'frequency', 'monetary', round(corr(frequency, monetary), 9) FROM panel""")
def feature_correlation(spark, d):
    return _rounded(leakage.correlation(_panel(spark, d), RFM), "correlation")


@query(PANEL_SQL + f""" SELECT {t.DAY.replace("panel.as_of", "as_of")}, count(*) FILTER (churned = 0) AS churned_0, count(*) FILTER (churned = 1) AS churned_1, count(*) AS total FROM panel GROUP BY as_of""")
def labels_pivoted(spark, d):
    return compare.pivoted(_panel(spark, d), "as_of", "churned", [0, 1], prefix="churned_").select(t.day(), "churned_0", "churned_1", "total")


@query(PANEL_SQL + """ SELECT customer_id, count(DISTINCT as_of) AS n_origins, array_to_string(list_sort(list(DISTINCT strftime(as_of, '%Y-%m-%d'))), ',') AS origins FROM panel GROUP BY 1""")
def origins_seen(spark, d):
    found = compare.origins_seen(_panel(spark, d))
    days = F.array_join(F.transform("origins", lambda x: F.date_format(x, "yyyy-MM-dd")), ",")
    return found.select("customer_id", F.size("origins").cast("long").alias("n_origins"), days.alias("origins"))


@query(SUB_SQL + " SELECT churned, 1 - churned AS has_event, count(*) AS n FROM panel GROUP BY 1")
def renewals_and_labels(spark, d):
    """Events of hazards against labels: one occurs just where the label is 0."""
    tx = t.subscription(spark, d)
    events = hazard.first_event_period(hazard.renewals(tx), t.windows(*SUBW), time_col="transaction_date", period_days=10)
    both = _sub_panel(spark, d).join(events.select("as_of", "customer_id", F.lit(1).alias("e")), ["as_of", "customer_id"], "left")
    return both.groupBy("churned", F.coalesce("e", F.lit(0)).alias("has_event")).agg(F.count(F.lit(1)).alias("n"))


# --- reproducible draws, fingerprints, maps -------------------------------------


def _draw_sql(ids: str, start: int = 1, n: int = 13) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {ids})), {start}, {n}) AS BIGINT)"


ROW_ID = "customer_id, strftime(panel.as_of, '%Y-%m-%d %H:%M:%S')"


@query(f"""SELECT c_custkey AS customer_id, round({_draw_sql("c_custkey, 'day', '42'")} / 4503599627370496.0 * 402, 9) AS event_day,
  {_draw_sql("c_custkey, 'split', '42'")} / 4503599627370496.0 >= 0.2 AS is_train,
  round(sqrt(-2 * ln(1 - {_draw_sql("c_custkey, 'jitter', '42'")} / 4503599627370496.0)) * cos(2 * pi() * ({_draw_sql("c_custkey, 'jitter', '42'", 14)} / 4503599627370496.0)), 6) AS jitter FROM customer""")
def seeded_noise(spark, d):
    """Points scattered over a span, a random split of them, and jitter."""
    key = F.col("c_custkey")
    return t.read(spark, d, "customer").select(
        key.alias("customer_id"), F.round(uniform(42, key, F.lit("day")) * 402, 9).alias("event_day"), (uniform(42, key, F.lit("split")) >= 0.2).alias("is_train"),
        F.round(normal(42, key, F.lit("jitter")), 6).alias("jitter"),
    )


@query(PANEL_SQL + f""", n AS (SELECT churned, count(*) AS n FROM panel GROUP BY 1)
SELECT customer_id, {t.DAY.replace("as_of,", "panel.as_of,")}, churned, row_number() OVER (PARTITION BY churned ORDER BY {_draw_sql(ROW_ID + ", '7'", 1, 15)}) <= floor(0.2 * n) AS is_test FROM panel JOIN n USING (churned)""")
def stratified_split(spark, d):
    return leakage.stratified_split(_panel(spark, d), "churned", ["customer_id", "as_of"], 0.2, 7).select("customer_id", t.day(), "churned", "is_test")


FINGERPRINT = "||".join(f"printf('%08x', CAST(sum({_draw_sql('r', 8 * i + 1, 8)}) % 4294967296 AS BIGINT))" for i in range(4))


@query(PANEL_SQL + f""", v AS (SELECT {t.DAY.replace("as_of,", "panel.as_of,")}, CAST(churned AS VARCHAR) AS churned, CAST(customer_id AS VARCHAR) AS customer_id, CAST(frequency AS VARCHAR) AS frequency, CAST(recency_days AS VARCHAR) AS recency_days FROM panel),
r AS (SELECT {" || '|' || ".join(f"'{c}=v' || length({c}) || ':' || {c}" for c in ("as_of", "churned", "customer_id", "frequency", "recency_days"))} AS r FROM v)
SELECT count(*) AS n, {FINGERPRINT} AS fingerprint, true AS reproduced FROM r""")
def panel_fingerprint(spark, d):
    """A panel and the same one made again from rows in another order."""
    columns = ["customer_id", t.day(), "recency_days", "frequency", "churned"]
    again = activity.build_asof_panel(t.activity(spark, d).repartition(7, "invoice"), t.windows(*ACT))
    one, two = (compare.fingerprint(x.select(*columns)) for x in (_panel(spark, d), again))
    return one.join(F.broadcast(two.select(F.col("fingerprint").alias("f"), F.col("n").alias("m")))).select("n", "fingerprint", ((F.col("n") == F.col("m")) & (F.col("fingerprint") == F.col("f"))).alias("reproduced"))


@query(SCORED + """, k AS (SELECT p, sum(y) AS s, count(*) AS w, row_number() OVER (ORDER BY p) AS i FROM s GROUP BY 1),
c AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM k),
m AS (SELECT a.i AS j, b.i, min((b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m FROM c a JOIN c b ON b.i >= a.i),
g AS (SELECT i, max(m) AS v FROM m GROUP BY 1) SELECT CAST(p AS DOUBLE) AS score, w AS n, round(v, 9) AS calibrated FROM k JOIN g USING (i)""")
def isotonic_map(spark, d):
    """The isotonic map at every score it was fitted on."""
    rows = _scored(spark, d)
    each = rows.groupBy(F.col("p").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return _rounded(calibration.Isotonic.fit(rows).transform(each, "score"), "calibrated").select("score", "n", "calibrated")


# --- origins, holdouts, members, tables of results ------------------------------


@query(f"""WITH {t.TX}, e AS (SELECT min(invoice_date) AS a, max(invoice_date) AS b FROM tx),
g AS (SELECT date_trunc('day', a) + INTERVAL 365 DAY + to_days(CAST(i * 45 AS INTEGER)) AS as_of, b FROM e, range(1000) r(i))
SELECT {t.DAY}, strftime(as_of + INTERVAL 7 DAY, '%Y-%m-%d') AS label_start, strftime(as_of + INTERVAL 37 DAY, '%Y-%m-%d') AS label_end FROM g WHERE as_of + INTERVAL 37 DAY <= b""")
def rolling_origins(spark, d):
    """Every origin from the first one with a whole lookback to the last one with a
    whole label window."""
    tx = t.activity(spark, d)
    first, last = first_origin(tx, "invoice_date", 365), tx.agg(F.max("invoice_date")).first()[0]
    found = origins_frame(spark, make_origins(first, last, gap_days=7, horizon_days=30, step_days=45))
    return found.select(t.day(), *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("label_start", "label_end")])


@query(PANEL_SQL + """, l AS (SELECT max(as_of) AS last FROM o), x AS (SELECT CASE WHEN panel.as_of = last THEN 'test' WHEN o.label_end <= last THEN 'train' END AS side, churned, 'purged' AS arm FROM panel JOIN o ON panel.as_of = o.as_of, l
UNION ALL SELECT CASE WHEN panel.as_of = last THEN 'test' ELSE 'train' END, churned, 'unpurged' FROM panel, l)
SELECT arm, side, count(*) AS n, round(avg(churned), 9) AS churn_rate FROM x WHERE side IS NOT NULL GROUP BY ALL""")
def holdout(spark, d):
    panel, w, out = _panel(spark, d), t.windows(*ACT), None
    for arm, purge in (("purged", True), ("unpurged", False)):
        for side, rows in zip(("train", "test"), backtest.holdout_after(panel, w, purge=purge)):
            part = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("churned"), 9).alias("churn_rate")).select(F.lit(arm).alias("arm"), F.lit(side).alias("side"), "n", "churn_rate")
            out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT round(avg(CAST(coalesce(bd NOT BETWEEN 1 AND 100, true) AS INTEGER)), 9) AS odd_age, round(avg(CAST(gender IS NULL AS INTEGER)), 9) AS no_gender
FROM (SELECT CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 127 - 9 END AS bd, CASE WHEN c_nationkey % 3 > 0 THEN 'x' END AS gender FROM customer)""")
def members_quality(spark, d):
    key = F.col("c_custkey")
    members = t.read(spark, d, "customer").select(F.when(key % 11 > 0, key % 127 - 9).alias("bd"), F.when(F.col("c_nationkey") % 3 > 0, "x").alias("gender"))
    return _rounded(sources.members_quality(members), "odd_age", "no_gender")


@query(PANEL_SQL + f" SELECT {t.DAY}, round(avg(monetary), 6) AS mean, round(stddev_samp(monetary), 6) AS std, round(min(monetary), 6) AS low, round(max(monetary), 6) AS high FROM panel GROUP BY as_of")
def monetary_summary(spark, d):
    found = compare.summary(_panel(spark, d), "monetary", ["as_of"])
    return found.select(t.day(), *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


BUDGETS = [100, 200, 300]
ARMS_SQL = SCORED + ", v AS (SELECT customer_id, as_of, y, 'a' AS variant, CAST(p AS DOUBLE) AS p FROM s UNION ALL SELECT customer_id, as_of, y, 'b', ((customer_id * 31) % 97) / 97.0 FROM s)"


def _arms(spark, d):
    """Two scores of the same rows."""
    rows = _scored(spark, d)
    return rows.withColumn("variant", F.lit("a")).unionByName(rows.withColumn("p", (F.col("customer_id") * 31 % 97) / 97).withColumn("variant", F.lit("b")))


@query(ARMS_SQL + """, r AS (SELECT variant, as_of, y, row_number() OVER (PARTITION BY variant, as_of ORDER BY p DESC, customer_id) AS r FROM v), k AS (SELECT unnest([100, 200, 300]) AS budget),
e AS (SELECT budget, variant, as_of, 4.0 * coalesce(sum(y) FILTER (r <= budget), 0) - 2.5 * count(*) FILTER (r <= budget) AS ev FROM k, r GROUP BY ALL)
SELECT budget, CAST(round(avg(ev) FILTER (variant = 'a'), 6) AS DOUBLE) AS variant_a, CAST(round(avg(ev) FILTER (variant = 'b'), 6) AS DOUBLE) AS variant_b FROM e GROUP BY 1""")
def budget_by_variant(spark, d):
    """Mean value over origins, a row for each budget and a column for each variant."""
    found = metrics.budget_value(_arms(spark, d), BUDGETS, "customer_id", by=["variant", "as_of"], **OFFER)
    wide = compare.pivoted_means(found, "budget", "variant", ["a", "b"], "expected_value", prefix="variant_")
    return wide.select("budget", *[F.round(c, 6).alias(c) for c in ("variant_a", "variant_b")])


def _reliability_by(n: int) -> str:
    return f"""SELECT {n} AS n_bins, variant, sum(n * (mp - obs) ** 2) / sum(n) AS rel FROM (SELECT variant, count(*) AS n, avg(p) AS mp, avg(y) AS obs FROM v
  GROUP BY variant, greatest(len(list_filter([CAST(i AS DOUBLE) / {n} for i in range({n})], lambda e: e < p)) - 1, 0)) GROUP BY 2"""


@query(ARMS_SQL + ", e AS (" + " UNION ALL ".join(map(_reliability_by, (5, 10, 15, 20, 30))) + """), w AS (SELECT n_bins, variant, rel, row_number() OVER (PARTITION BY n_bins ORDER BY rel, variant) AS k FROM e)
SELECT n_bins, variant AS winner, round(rel, 9) AS reliability FROM w WHERE k = 1""")
def winner_by_bins(spark, d):
    return _rounded(calibration.winner_by_bins(_arms(spark, d), "variant"), "reliability").select("n_bins", "winner", "reliability")


PARTS = ("reliability", "resolution", "uncertainty")


@query(SCORED + ", b AS (" + " UNION ALL ".join(map(_brier_sql, (5, 10))) + """), u AS (UNPIVOT b ON reliability, resolution, uncertainty INTO NAME part VALUE x)
SELECT part, round(sum(x) FILTER (n_bins = 5), 9) AS bins_5, round(sum(x) FILTER (n_bins = 10), 9) AS bins_10, round(sum(x), 9) AS both FROM u GROUP BY 1""")
def brier_transposed(spark, d):
    """Parts of the score as rows, numbers of bins as columns, with their sum."""
    found = _rounded(calibration.bin_sensitivity(_scored(spark, d), (5, 10)), *PARTS)
    wide = compare.transposed(found, "n_bins", list(PARTS), [5, 10], name="part", total="both")
    return wide.select("part", F.round("5", 9).alias("bins_5"), F.round("10", 9).alias("bins_10"), F.round("both", 9).alias("both"))


@query(PANEL_SQL + f" SELECT customer_id, {t.DAY.replace('as_of,', 'panel.as_of,')}, CASE WHEN idx < 10 THEN idx ELSE -1 END AS as_of_rank FROM panel JOIN o ON panel.as_of = o.as_of")
def origin_ranks(spark, d):
    """Each row's origin as its number, by a map of the first ten origins."""
    ranks = {w.as_of.strftime("%Y-%m-%d"): i for i, w in enumerate(t.windows(*ACT)[:10])}
    return compare.looked_up(_panel(spark, d).select("customer_id", t.day()), "as_of", ranks, "as_of_rank", -1)


# --- with a model in the loop: no SQL -----------------------------------------

def _modelled(spark, d):
    """The panel over all origins, kept while a query's models are fitted on it."""
    tx, w = t.activity(spark, d), t.windows(*ACT)
    return tx, w, _panel(spark, d).persist()


BINS_8 = ", ".join(f"quantile_cont({{c}}, {i / 8}) AS q{i}" for i in range(1, 8))
ONE_SPLIT = PANEL_SQL + """, q AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {j} AS f, {BINS_8.format(c=c)} FROM panel WHERE as_of = '1996-01-01'" for j, c in enumerate(RFM)) + """),
l AS (SELECT panel.as_of, idx, label_end, churned, u.f, u.v FROM panel JOIN o ON panel.as_of = o.as_of, unnest([{'f': 0, 'v': CAST(recency_days AS DOUBLE)}, {'f': 1, 'v': CAST(frequency AS DOUBLE)}, {'f': 2, 'v': monetary}]) t(u)),
b AS (SELECT as_of, idx, label_end, churned, l.f, (q1 < v)::INT + (q2 < v)::INT + (q3 < v)::INT + (q4 < v)::INT + (q5 < v)::INT + (q6 < v)::INT + (q7 < v)::INT AS b FROM l JOIN q ON l.f = q.f),
c AS (SELECT as_of, idx, label_end, f, b, count(*) AS n, sum(churned) AS s FROM b GROUP BY ALL),
m AS (SELECT o.as_of, f, b, sum(n) AS n, sum(s) AS s FROM c JOIN o ON c.idx < o.idx AND c.label_end <= o.as_of WHERE o.idx >= 2 GROUP BY ALL),
g AS (SELECT as_of, f, k.b AS cut, sum(n) FILTER (m.b <= k.b) AS nl, sum(s) FILTER (m.b <= k.b) AS sl, sum(n) AS n, sum(s) AS s FROM m, range(7) k(b) GROUP BY ALL),
x AS (SELECT *, CAST(s AS DOUBLE) / n AS p FROM g WHERE nl >= 20 AND n - nl >= 20),
y AS (SELECT *, (sl - nl * p) ** 2 / (nl * p * (1 - p)) + (s - sl - (n - nl) * p) ** 2 / ((n - nl) * p * (1 - p)) AS gain FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY round(gain, 6) DESC, f, cut) AS k FROM y)"""
SPLIT_P = "1 / (1 + exp(-(ln(p / (1 - p)) + 0.1 * ({s} - {n} * p) / ({n} * p * (1 - p)))))"


@query(ONE_SPLIT + f"""SELECT {t.DAY}, q.feature, CAST(cut AS INTEGER) AS cut, CAST(n AS BIGINT) AS n_train, round({SPLIT_P.format(s="sl", n="nl")}, 9) AS p_below, round({SPLIT_P.format(s="(s - sl)", n="(n - nl)")}, 9) AS p_above FROM z JOIN q USING (f) WHERE k = 1""")
def one_split_backtest(spark, d):
    """The model of each of all origins that a backtest would test, with a single
    split: which feature, where, and what it says on both sides."""
    _, w, panel = _modelled(spark, d)
    plan = backtest.training_plan(w, min_training_origins=2)
    first = panel.filter(F.col("as_of") == F.lit(w[0].as_of))
    models = model.fit_windows(panel, plan, RFM, edges=model.cut_points(first, RFM, 8), trees=1, depth=1)
    n = {r["as_of"]: r["n"] for r in panel.groupBy("as_of").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for at, fitted in models.items():
        tree = fitted.trees
        below, above = (float(x) for x in model._sigmoid(tree.base + tree.leaf[0]))
        rows.append((at.strftime("%Y-%m-%d"), RFM[tree.feature[0][0]], int(tree.cut[0][0]), sum(n[x] for x in plan[at]), round(below, 9), round(above, 9)))
    panel.unpersist()
    return spark.createDataFrame(rows, "as_of string, feature string, cut int, n_train long, p_below double, p_above double")


BOOST = {"trees": 10, "depth": 3}


@query()
def rolling_backtest(spark, d):
    _, w, panel = _modelled(spark, d)
    per_origin, _ = backtest.rolling_origin_backtest(panel, w, RFM, min_training_origins=2, **BOOST)
    return per_origin


@query()
def frozen_backtest(spark, d):
    _, w, panel = _modelled(spark, d)
    per_origin, _ = backtest.frozen_model_backtest(panel, w, RFM, min_training_origins=2, **BOOST)
    return per_origin


@query()
def hazard_backtest(spark, d):
    tx, w, panel = _modelled(spark, d)
    per_origin, _ = backtest.hazard_rolling_origin_backtest(panel, tx, w, RFM, time_col="invoice_date", period_days=10, min_training_origins=3, **BOOST)
    return per_origin


@query()
def calibration_compare(spark, d):
    """Scores of the last origin raw and calibrated on the one before."""
    _, w, panel = _modelled(spark, d)
    fitted, _ = backtest.fit_at_origin(panel, w, len(w) - 2, RFM, **BOOST)
    at = lambda i: model.predict(fitted, panel.filter(F.col("as_of") == F.lit(w[i].as_of)), RFM)
    known, new = at(-2), at(-1)
    scored = calibration.Isotonic.fit(known, "churned").transform(calibration.Platt.fit(known, "churned").transform(new, out_col="platt"), out_col="isotonic")
    rows = scored.select("churned", F.explode(F.create_map(F.lit("raw"), "p", F.lit("platt"), "platt", F.lit("isotonic"), "isotonic")).alias("variant", "q"))
    return metrics.score(rows, "churned", "q", ["variant"])


@query()
def adversarial_validation(spark, d):
    _, w, panel = _modelled(spark, d)
    naive = activity.build_naive_panel(t.activity(spark, d), w).persist()
    auc, names = leakage.adversarial_auc(panel, naive, RFM, seed=model.SEED, group_col="customer_id")
    return spark.createDataFrame([(auc, *[names[c] for c in RFM])], "auc double, recency_days double, frequency double, monetary double")


@query()
def ablation(spark, d):
    _, w, panel = _modelled(spark, d)
    last = F.lit(w[-1].as_of)
    found = leakage.ablation_auc(panel.filter(F.col("as_of") < last), panel.filter(F.col("as_of") == last), RFM, seed=model.SEED)
    return spark.createDataFrame(list(found.items()), "variant string, auc double")


@query()
def serving_skew(spark, d):
    """One origin, one population: a naive model on naive and on as-of features,
    and the as-of model."""
    tx, w, panel = _modelled(spark, d)
    naive = activity.build_naive_panel(tx, w).withColumn("monetary", F.col("monetary").cast("double")).cache()
    last = F.lit(w[-1].as_of)
    mature = [F.lit(x.as_of).cast("timestamp_ntz") for x in backtest.mature_origins(w, w[-1])]
    train, test = (lambda p: p.filter(F.col("as_of").isin(mature))), (lambda p: p.filter(F.col("as_of") == last))
    wrong, right = model.fit(train(naive), RFM, **BOOST), model.fit(train(panel), RFM, **BOOST)
    arms = {"naive on naive": (wrong, naive), "naive on as-of": (wrong, panel), "as-of on as-of": (right, panel)}
    out = None
    for name, (fitted, rows) in arms.items():
        counts = model.cells(test(rows), RFM, "churned", fitted.edges, [])
        part = model.predict_counts({0: fitted}, counts, F.lit(0), len(RFM)).select(F.lit(name).alias("arm"), "p", "n", "positive")
        out = part if out is None else out.unionByName(part)
    return metrics.score_counts(out, ["arm"])


@query()
def ablation_stability(spark, d):
    """How far the ablation depends on which fifth of the rows is the test."""
    panel = _naive(spark, d).persist()
    return compare.ablation_stability(panel, RFM, ["customer_id", "as_of"], [model.SEED + i for i in range(5)])


@query()
def hazard_at_origin(spark, d):
    """Chances to churn at the last origin, by the hazard model that is fitted there."""
    tx, w, panel = _modelled(spark, d)
    fitted, _ = backtest.fit_hazard_at_origin(panel, tx, w, len(w) - 1, RFM, time_col="invoice_date", period_days=10, **BOOST)
    last = panel.filter(F.col("as_of") == F.lit(w[-1].as_of))
    return backtest.predict_survival(fitted, last, RFM, 3).select("customer_id", t.day(), F.round("survival", 9).alias("survival"))


# --- samples and comparisons --------------------------------------------------


@query(PANEL_SQL + f" SELECT customer_id, {t.DAY}, churned FROM panel ORDER BY md5(concat_ws(':', customer_id, strftime(panel.as_of, '%Y-%m-%d %H:%M:%S'), '7')), customer_id, panel.as_of LIMIT 500")
def simple_sample(spark, d):
    return compare.simple_sample(_panel(spark, d), 500, ["customer_id", "as_of"], 7).select("customer_id", t.day(), "churned")


@query(PANEL_SQL + f" SELECT customer_id, {t.DAY}, churned FROM panel QUALIFY row_number() OVER (PARTITION BY churned ORDER BY md5(concat_ws(':', customer_id, strftime(panel.as_of, '%Y-%m-%d %H:%M:%S'), '7')), customer_id, panel.as_of) <= 40")
def sample_per_category(spark, d):
    return compare.sample_per_category(_panel(spark, d), "churned", 40, ["customer_id", "as_of"], 7).select("customer_id", t.day(), "churned")


@query(f"""WITH {t.TX}, f AS (SELECT customer_id, epoch(min(invoice_date)) AS s FROM tx GROUP BY 1)
SELECT customer_id, s < (SELECT quantile_cont(s, 0.8) FROM f) AS is_train FROM f""")
def cohort_split(spark, d):
    return compare.cohort_split(t.activity(spark, d))


@query(SCORED + """, r AS (SELECT row_number() OVER (ORDER BY p DESC, customer_id) AS a, row_number() OVER (ORDER BY (customer_id * 31 % 97) DESC, customer_id) AS b FROM s WHERE as_of = '1996-01-01')
SELECT count(*) FILTER (a <> b) AS moved, count(*) FILTER (a <= 200 AND b > 200) AS left_top FROM r""")
def rank_differences(spark, d):
    rows = _scored(spark, d).filter(F.col("as_of") == F.lit(ACT[0])).withColumn("q", F.col("customer_id") * 31 % 97)
    return compare.rank_differences(rows, "p", "q", "customer_id", 200)


@query(PANEL_SQL + " SELECT count(*) AS n, round(avg(CAST(churned = customer_id % 2 AS INTEGER)), 9) AS agreement FROM panel JOIN customer ON c_custkey = customer_id WHERE as_of = '1996-01-01' AND c_mktsegment <> 'BUILDING'")
def official_label_agreement(spark, d):
    panel = _panel(spark, d).filter(F.col("as_of") == F.lit(ACT[0]))
    official = t.read(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 2).alias("is_churn"))
    return _rounded(compare.label_agreement(panel, official), "agreement")


@query(SUB_SQL + ", " + t.origins_sql("1996-01-01", 60, 30, 0, 30, 7).replace("o AS (", "o2 AS (", 1) + """,
p2 AS (SELECT m.customer_id, m.as_of, CAST(NOT EXISTS (SELECT 1 FROM sub WHERE sub.customer_id = m.customer_id AND is_cancel = 0
  AND transaction_date >= o2.label_start AND transaction_date < o2.label_end) AS INTEGER) AS churned FROM m JOIN o2 ON m.as_of = o2.as_of)
SELECT a.churned AS label_a, b.churned AS label_b, count(*) AS n FROM panel a JOIN p2 b USING (customer_id, as_of) GROUP BY ALL""")
def label_shift(spark, d):
    tx = t.subscription(spark, d)
    pinned = subscription.build_subscription_panel(tx, t.windows(SUBW[0], SUBW[1], SUBW[2], 0, SUBW[4]), eligibility_gap_days=7)
    return compare.label_shift(_sub_panel(spark, d), pinned, ["customer_id", "as_of"])


@query(PANEL_SQL + "," + NAIVE_SQL.split(f"{ACT_SQL},")[1] + """
SELECT panel.churned, count(*) AS n, CAST(median(naive.recency_days - panel.recency_days) AS DOUBLE) AS median_delta FROM naive JOIN panel USING (customer_id, as_of) GROUP BY 1""")
def recency_delta_by_class(spark, d):
    return compare.delta_by_class(_naive(spark, d), _panel(spark, d), "recency_days", ["customer_id", "as_of"])


@query()
def frozen_minus_retrained(spark, d):
    _, w, panel = _modelled(spark, d)
    held = backtest.counted(panel, w, RFM)
    frozen, _ = backtest.frozen_model_backtest(panel, w, RFM, min_training_origins=2, held=held, **BOOST)
    retrained, _ = backtest.rolling_origin_backtest(panel, w, RFM, min_training_origins=2, held=held, **BOOST)
    return compare.frozen_minus_retrained(frozen, retrained)


@query()
def sliding_sweep(spark, d):
    _, w, panel = _modelled(spark, d)
    return compare.sliding_sweep(panel, w, RFM, [200, 400, 800], min_training_origins=3, **BOOST)


@query()
def leakage_table(spark, d):
    tx, w, panel = _modelled(spark, d)
    naive, last = activity.build_naive_panel(tx, w).withColumn("monetary", F.col("monetary").cast("double")).persist(), F.lit(w[-1].as_of)
    return compare.leakage_table(naive, panel, naive.filter(F.col("as_of") < last), naive.filter(F.col("as_of") == last), RFM, ["customer_id", "as_of"], seed=model.SEED)
