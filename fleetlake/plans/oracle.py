"""DuckDB SQL text for the correctness oracle.

Each query key's oracle is an independent SQL statement over the driver's
tables (pre-registered as views). Shared CTEs are assembled here; maps and
texts come from ``fixed_values`` so both engines use the same constants.
Doubles are written as ``0.65e0`` (a bare ``0.65`` is DECIMAL).
"""

from __future__ import annotations

from fleetlake.functions import fixed_values as fv
from fleetlake.sources.telemetry import FAILURE_CYCLE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else repr(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def clip(x: str, lo=None, hi=None) -> str:
    out = f"({x})"
    if hi is not None:
        out = f"(CASE WHEN ({x}) > {hi} THEN {hi} ELSE {out} END)"
    if lo is not None:
        out = f"(CASE WHEN ({x}) < {lo} THEN {lo} ELSE {out} END)"
    return out


def r1(x: str) -> str:
    return f"(round_even(({x}) * 10e0, 0) / 10e0)"


def safe_div(n: str, d: str) -> str:
    n, d = f"CAST({n} AS DOUBLE)", f"CAST({d} AS DOUBLE)"
    return (
        f"(CASE WHEN {n} IS NULL OR {d} IS NULL THEN NULL "
        f"WHEN {d} = 0 AND {n} > 0 THEN CAST('inf' AS DOUBLE) "
        f"WHEN {d} = 0 AND {n} < 0 THEN CAST('-inf' AS DOUBLE) "
        f"WHEN {d} = 0 THEN NULL ELSE {n} / {d} END)"
    )


def spaced(x: str) -> str:
    return f"replace({x}, '_', ' ')"


def mean_tenths(x: str) -> str:
    return f"(CAST(sum(CAST(round_even(({x}) * 10e0, 0) AS BIGINT)) AS DOUBLE) / (CAST(count({x}) AS DOUBLE) * 10e0))"


def mean_int(x: str) -> str:
    return f"avg({x})"


def rounded_mean(x: str) -> str:
    """Means are compared at six decimals: the last bits depend on the order of the sums."""
    return f"round(avg(CAST({x} AS DOUBLE)), 6)"


def num_text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


_cycle = ", ".join(q(c) for c in FAILURE_CYCLE)

TELEMETRY = f"""
li AS (
  SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey
), telemetry0 AS (
  SELECT
    CAST(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS TIMESTAMP) AS event_ts,
    strftime(o_orderdate, '%Y-%m-%d') AS partition_date,
    replace(lower(r_name), ' ', '_') || '-' || CAST(n_nationkey AS VARCHAR) AS customer_id,
    n_name AS customer_name,
    r_name AS region,
    CASE n_nationkey % 3 WHEN 0 THEN 'platinum' WHEN 1 THEN 'strategic' ELSE 'growth' END AS account_tier,
    'cluster-' || CAST(n_nationkey AS VARCHAR) AS cluster_name,
    o_orderpriority AS workload_name,
    'job-' || CAST(o_orderkey AS VARCHAR) AS job_id,
    CAST(60 + 10 * (o_orderkey % 4) AS BIGINT) AS sla_minutes,
    CASE WHEN o_orderstatus = 'P' THEN 'degraded'
         WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'failed'
         ELSE 'success' END AS status,
    CASE WHEN NOT (o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderkey % 5 = 0)) THEN 'none'
         ELSE list_extract([{_cycle}], CAST(o_orderkey % 6 AS INT) + 1) END AS failure_category,
    CAST(coalesce(qty, 0e0) AS DOUBLE) AS shuffle_gb,
    CAST(4 + coalesce(n, 0) AS BIGINT) AS input_rows_m,
    (o_orderkey * 31 % 120) / 10e0 AS spill_gb,
    CAST(50 + (o_orderkey * 7) % 50 AS BIGINT) AS memory_utilization_pct,
    CAST((o_orderkey * 13) % 16 AS BIGINT) AS queue_depth,
    CAST(o_orderkey % 8 AS BIGINT) AS failed_tasks,
    CAST(o_orderkey % 13 AS BIGINT) AS retried_tasks,
    CAST(20 + 10 * coalesce(n, 0) + o_orderkey % 17 AS BIGINT) AS duration_min,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cost_cents
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN li ON l_orderkey = o_orderkey
), telemetry AS (
  SELECT *,
    {case_map('failure_category', fv.USER_IMPACT_BY_CATEGORY)} AS user_impact,
    CASE WHEN failure_category = 'none' THEN customer_name || ' ' || workload_name || ' completed in-family.'
         ELSE customer_name || ' flagged ' || workload_name || ' for follow-up because of '
              || {spaced('failure_category')} || '.' END AS ticket_hint
  FROM telemetry0
)"""

_penalty = (
    "latency_over_sla_min * 0.65e0 + failed_tasks * 0.85e0 + retried_tasks * 0.28e0 "
    f"+ queue_depth * 1.1e0 + spill_gb * 0.95e0 + {clip('memory_utilization_pct - 70', lo=0)} * 0.42e0"
)
_status_pen = case_map("status", fv.STATUS_PENALTY, "0e0")

SILVER = f"""
scored0 AS (
  SELECT *,
    {clip('duration_min - sla_minutes', lo=0)} AS latency_over_sla_min,
    {r1(clip('memory_utilization_pct - 68', lo=0) + ' * 0.8e0 + spill_gb * 1.7e0')} AS memory_pressure_score,
    {r1(clip('queue_depth / 20 * 100', lo=0, hi=100))} AS queue_pressure_score,
    {r1(clip(safe_div('shuffle_gb', 'input_rows_m'), lo=0.4) + ' * 16e0')} AS shuffle_pressure_score
  FROM telemetry
), scored1 AS (
  SELECT *, {r1(clip(f'100 - (({_penalty}) + {_status_pen})', lo=8, hi=99))} AS reliability_score
  FROM scored0
), scored2 AS (
  SELECT *,
    CASE WHEN status = 'failed' OR reliability_score < 38 OR latency_over_sla_min > 40 OR queue_depth > 14 THEN 'high'
         WHEN status = 'degraded' OR reliability_score < 68 OR latency_over_sla_min > 15 THEN 'medium'
         ELSE 'low' END AS severity
  FROM scored1
), silver AS (
  SELECT *,
    CAST(coalesce({case_map('severity', fv.SEVERITY_RANK)}, {fv.SEVERITY_RANK_OTHER}) AS INTEGER) AS severity_rank,
    {case_map('failure_category', fv.ROOT_CAUSE_BY_CATEGORY)} AS root_cause_guess,
    {case_map('failure_category', fv.ACTION_BY_CATEGORY)} AS recommended_action,
    customer_name || ' ' || workload_name || ' is ' || status || ' because of ' || {spaced('failure_category')} || '.'
      AS customer_summary,
    'inc-' || split_part(customer_id, '-', 1) || '-' || strftime(event_ts, '%m%d') || '-'
      || printf('%04d', row_number() OVER (ORDER BY event_ts NULLS LAST, job_id NULLS LAST) - 1) AS incident_id
  FROM scored2
)"""


def recent(days: int, src: str = "silver") -> str:
    return f"""
recent AS (
  SELECT * FROM {src} WHERE event_ts >= (SELECT max(event_ts) FROM {src}) - INTERVAL {int(days)} DAY
)"""


_health_raw = (
    "100 - failed_jobs * 6 - degraded_jobs * 2.5e0 - open_incidents * 4 - avg_latency_over_sla_min * 0.4e0 "
    "- (100 - avg_reliability_score) * 0.35e0"
)

HEALTH_FROM_RECENT = f"""
grouped AS (
  SELECT customer_id, customer_name, region, account_tier, cluster_name,
    count(job_id) AS jobs_last_7d,
    count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
    count(*) FILTER (WHERE status = 'degraded') AS degraded_jobs,
    count(*) FILTER (WHERE severity = 'high') AS open_incidents,
    {mean_tenths('reliability_score')} AS avg_reliability_score,
    {mean_int('latency_over_sla_min')} AS avg_latency_over_sla_min,
    {mean_int('queue_depth')} AS avg_queue_depth,
    {mean_int('duration_min')} AS avg_duration_min,
    {r1("CAST(count(*) FILTER (WHERE status = 'success') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100")} AS success_rate_pct
  FROM recent
  WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL AND region IS NOT NULL
    AND account_tier IS NOT NULL AND cluster_name IS NOT NULL
  GROUP BY ALL
), worst AS (
  SELECT customer_id,
    first(workload_name ORDER BY reliability_score NULLS LAST, event_ts NULLS LAST, job_id NULLS LAST)
      FILTER (WHERE workload_name IS NOT NULL) AS at_risk_workload,
    first(failure_category ORDER BY reliability_score NULLS LAST, event_ts NULLS LAST, job_id NULLS LAST)
      FILTER (WHERE failure_category IS NOT NULL) AS dominant_failure
  FROM recent WHERE customer_id IS NOT NULL GROUP BY customer_id
), health0 AS (
  SELECT g.*, w.at_risk_workload, w.dominant_failure,
    {r1(clip(_health_raw, lo=25, hi=98))} AS customer_health_score
  FROM grouped g LEFT JOIN worst w USING (customer_id)
), health1 AS (
  SELECT *, CASE WHEN customer_health_score < 45 THEN 'critical'
                 WHEN customer_health_score < 72 THEN 'watch' ELSE 'healthy' END AS risk_band
  FROM health0
), customer_health AS (
  SELECT *, customer_name || ' is trending ' || risk_band || ' with ' || {num_text('open_incidents')}
    || ' high-severity incidents and ' || {num_text('success_rate_pct')} || '% recent success.' AS exec_summary
  FROM health1
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + body


def silver_sql(body: str) -> str:
    return with_ctes(TELEMETRY, SILVER, body=body)


def health_sql(days: int, body: str) -> str:
    return with_ctes(TELEMETRY, SILVER, recent(days), HEALTH_FROM_RECENT, body=body)


QUEUE_ORDER = "severity_rank ASC NULLS LAST, event_ts DESC NULLS LAST, incident_id ASC NULLS LAST"

INCIDENTS = f"""
incidents AS (
  SELECT *, (severity IS NOT DISTINCT FROM 'high') AS needs_customer_update,
    {spaced('failure_category')} || ' on ' || workload_name || ' for ' || customer_name
      || ' with reliability ' || {num_text('reliability_score')} || '.' AS summary_line
  FROM silver
  WHERE severity IN ('high', 'medium') OR status IS DISTINCT FROM 'success'
), queue AS (
  SELECT * FROM incidents ORDER BY {QUEUE_ORDER} LIMIT {fv.INCIDENT_QUEUE_SIZE}
)"""


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]::VARCHAR[]"


RUNBOOK = (
    "runbook AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"({q(k)}, {q(v['root_cause'])}, {sql_list(v['actions'])}, {sql_list(v['deployment'])})"
        for k, v in fv.RUNBOOK_LIBRARY.items()
    )
    + ") t(failure_category, rb_root_cause, rb_actions, rb_deployment))"
)

_no_text = "[]::VARCHAR[]"
def triage_ctes(src: str = "incidents") -> str:
    """Triage CTEs over ``src`` (incidents to triage = comparables pool)."""
    return f"""
ctx AS (
  SELECT i.*, h.customer_health_score, h.open_incidents AS customer_open_incidents,
    r.rb_root_cause AS root_cause, r.rb_actions, r.rb_deployment
  FROM {src} i JOIN customer_health h USING (customer_id) JOIN runbook r USING (failure_category)
), ordered_pool AS (
  SELECT failure_category, incident_id,
    row_number() OVER (PARTITION BY failure_category ORDER BY {QUEUE_ORDER}) AS rn
  FROM {src}
), comps AS (
  SELECT c.incident_id, list(p.incident_id ORDER BY p.rn) AS ids
  FROM ctx c JOIN ordered_pool p
    ON p.failure_category = c.failure_category AND p.incident_id <> c.incident_id
    -- exact: leaving out the incident itself, its first 3 others lie in the top 4
    AND p.rn <= 4
  GROUP BY c.incident_id
), tri AS (
  SELECT c.*,
    list_concat(list_concat(rb_actions,
        CASE WHEN queue_depth >= {fv.QUEUE_ACTION_THRESHOLD} THEN [{q(fv.QUEUE_ACTION)}] ELSE {_no_text} END),
        CASE WHEN memory_utilization_pct >= {fv.MEMORY_ACTION_THRESHOLD} THEN [{q(fv.MEMORY_ACTION)}] ELSE {_no_text} END)
      AS next_actions,
    list_concat(rb_deployment,
        CASE WHEN customer_open_incidents >= {fv.OPEN_INCIDENT_DEPLOY_THRESHOLD}
             THEN [{q(fv.OPEN_INCIDENT_DEPLOY_STEP)}] ELSE {_no_text} END) AS deployment_plan,
    coalesce(list_slice(m.ids, 1, {fv.COMPARABLE_LIMIT}), {_no_text}) AS comparable_ids
  FROM ctx c LEFT JOIN comps m USING (incident_id)
), report AS (
  SELECT *,
    'We identified the main issue behind ' || workload_name || ' for ' || customer_name || ': ' || root_cause
      || ' Current health for the account is ' || {num_text('customer_health_score')}
      || ' and the top remediation step is to ' || lower(next_actions[1]) || '.' AS customer_update,
    customer_name || ' needs a focused fix on ' || workload_name || '. The likely driver is '
      || {spaced('failure_category')} || ', and the fastest path is to ' || lower(next_actions[1]) AS executive_summary,
    ['Reliability score is ' || {num_text('reliability_score')} || '.',
     'Queue depth reached ' || {num_text('queue_depth')} || ' and memory utilization reached '
       || {num_text('memory_utilization_pct')} || '%.',
     'Latency ran ' || {num_text('latency_over_sla_min')} || ' minutes over SLA.',
     user_impact] AS evidence,
    len(comparable_ids) AS matches
  FROM tri
)"""


def triage_sql(body: str, src: str = "incidents") -> str:
    return with_ctes(TELEMETRY, SILVER, recent(7), HEALTH_FROM_RECENT, INCIDENTS, RUNBOOK, triage_ctes(src), body=body)


def incidents_sql(body: str, days: int = 7) -> str:
    return with_ctes(TELEMETRY, SILVER, recent(days), HEALTH_FROM_RECENT, INCIDENTS, body=body)


_st = fv.TRIAGE_STEPS
TRIAGE_STEPS_BODY = f"""
SELECT incident_id, 1 AS step_no, {q(_st[0][0])} AS stage, {q(_st[0][1])} AS title,
  customer_name || ' has a ' || severity || ' severity issue on ' || workload_name || ' with reliability '
    || {num_text('reliability_score')} || '.' AS detail,
  'latency_over_sla_min=' || {num_text('latency_over_sla_min')} || ';queue_depth=' || {num_text('queue_depth')} AS metrics_text
FROM report
UNION ALL
SELECT incident_id, 2, {q(_st[1][0])}, {q(_st[1][1])},
  'Account health is ' || {num_text('customer_health_score')} || ' with ' || {num_text('customer_open_incidents')}
    || ' open high-priority incidents.',
  'customer_health_score=' || {num_text('customer_health_score')} || ';open_incidents=' || {num_text('customer_open_incidents')}
FROM report
UNION ALL
SELECT incident_id, 3, {q(_st[2][0])}, {q(_st[2][1])},
  CASE WHEN matches > 0 THEN replace({q(fv.COMPARABLES_TEXT)}, '{{n}}', {num_text('matches')})
       ELSE {q(fv.NO_COMPARABLES_TEXT)} END,
  'matches=' || {num_text('matches')}
FROM report
UNION ALL
SELECT incident_id, 4, {q(_st[3][0])}, {q(_st[3][1])}, root_cause, 'top_action=' || next_actions[1]
FROM report
UNION ALL
SELECT incident_id, 5, {q(_st[4][0])}, {q(_st[4][1])}, customer_update, ''
FROM report"""
