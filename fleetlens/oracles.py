"""The same queries in plain SQL, for a second engine to check the results.

Written against the driver tables alone; nothing here is used by the package.
"""

from __future__ import annotations

UNIT = 21_600_000_000          # one rule minute in microseconds
SLIDE = 5 * UNIT
ORACLES: dict[str, str] = {}

# --- shared common table expressions ----------------------------------------

M = """
m AS (
  SELECT ts, epoch_us(ts) AS us, 'vm-' || lpad(user_id::VARCHAR, 5, '0') AS vm_id,
         'app-' || (user_id % 8) AS app, user_id % 8 AS app_no,
         CASE WHEN user_id % 2 = 0 THEN 'dc-east' ELSE 'dc-west' END AS site,
         event_type, props, value::FLOAT::DOUBLE AS v, (value / 10)::FLOAT::DOUBLE AS retrans,
         (props->>'$.k')::DOUBLE AS k,
         CASE WHEN event_type = 'error' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS err
  FROM events)"""

W = M + f""",
b AS (SELECT min(us) AS t0, max(us) AS t1 FROM m),
w AS (
  SELECT ao::DOUBLE AS "asof", t0, t1 - ao * {UNIT} AS e, t1 - (ao + 10) * {UNIT} AS r_lo,
         t1 - (ao + 30) * {UNIT} AS h_lo, least(t0 + 30 * {UNIT}, t1 - (ao + 10) * {UNIT}) AS b_hi
  FROM b, (VALUES (0), (15), (30), (45)) AS x(ao))"""

REC, HEAP, BASE = "us > r_lo AND us <= e", "us > h_lo AND us <= e", "us >= t0 AND us < b_hi"

F = W + f""",
f AS (
  SELECT "asof", e, vm_id,
    max(app) FILTER (WHERE {REC}) AS app_r, max(app) FILTER (WHERE {HEAP}) AS app_h,
    count(*) FILTER (WHERE {HEAP}) AS n_heap,
    nullif(regr_slope(v, (us - e) / {UNIT}.0) FILTER (WHERE {HEAP}), 'nan'::DOUBLE) AS slope,
    nullif(corr(v, (us - e) / {UNIT}.0) FILTER (WHERE {HEAP}), 'nan'::DOUBLE) AS r,
    arg_max(v, us) FILTER (WHERE {HEAP}) AS cur,
    count(*) FILTER (WHERE {REC}) AS n_rec, avg(v) FILTER (WHERE {REC}) AS v_rec,
    arg_max(k, us) FILTER (WHERE {REC}) AS iops, avg(retrans) FILTER (WHERE {REC}) AS retr,
    avg(err) FILTER (WHERE {REC}) AS err_rec, avg(k) FILTER (WHERE {REC}) AS gc,
    nullif(regr_slope(v, (us - e) / {UNIT}.0) FILTER (WHERE {REC}), 'nan'::DOUBLE) AS slope_rec,
    arg_max(v, us) FILTER (WHERE {REC}) AS cur_rec,
    count(*) FILTER (WHERE {BASE}) AS n_base, avg(v) FILTER (WHERE {BASE}) AS v_base,
    stddev_samp(v) FILTER (WHERE {BASE}) AS v_std, avg(err) FILTER (WHERE {BASE}) AS err_base
  FROM w JOIN m ON us <= e AND (us > h_lo OR us < b_hi)
  GROUP BY "asof", e, vm_id)"""

P = W + f""",
p AS (
  SELECT "asof", e, app, quantile_cont(v, 0.95) FILTER (WHERE {REC}) AS p_rec,
         quantile_cont(v, 0.95) FILTER (WHERE {BASE}) AS p_base
  FROM w JOIN m ON us <= e AND (us > r_lo OR us < b_hi)
  GROUP BY "asof", e, app)"""

# Rule predicates over f and p.
FIRES = {
    "heap_leak": "n_heap >= 8 AND slope > 0.5 AND r > 0.2 AND cur > 50 AND (100 - cur) / slope <= 120",
    "io_spike": "n_rec > 0 AND n_base > 0 AND v_std > 0.01 AND (v_rec - v_base) / v_std > 0.5",
    "net_retrans": "retr > 5",
    "apm_latency": "p_rec > 1.05 * p_base AND p_rec > 60",
    "error_storm": "n_rec > 0 AND n_base > 0 AND err_rec > 3 AND err_rec > 3 * greatest(err_base, 0.1)",
}
ACTION = {
    "heap_leak": "Capture heap dump; schedule rolling restart before ETA; check for unbounded cache/collection growth.",
    "io_spike": "Check storage backend / noisy neighbor; inspect slow queries and disk queue depth.",
    "net_retrans": "Check NIC/switch path, packet loss, and replication links; look for conn_reset events.",
    "apm_latency": "Correlate with downstream dependency alerts (DB/IO); check recent deploys and GC pauses.",
    "error_storm": "Check 5xx sources and upstream dependencies; consider circuit-breaking / rollback.",
}


def _rule(name: str, severity: str, app: str, headline: str, source: str = "f", vm: str = "vm_id") -> str:
    return (f"SELECT \"asof\", e, {severity} AS severity, '{name}' AS rule, {vm} AS vm_id, {app} AS app, "
            f"{headline} AS headline, '{ACTION[name]}' AS action FROM {source} WHERE {FIRES[name]}")


HEAP_SEV = "CASE WHEN (100 - cur) / slope <= 10 THEN 'P1' ELSE 'P2' END"
ERR_SEV = "CASE WHEN err_rec > 40 THEN 'P1' ELSE 'P2' END"
# The texts of the alerts, as SQL.
HEADLINE = {
    "heap_leak": "'Heap leak on ' || vm_id || ': +' || printf('%.0f', slope) || ' MB/min, OOM ETA ~' "
                 "|| printf('%.0f', (100 - cur) / slope) || ' min'",
    "io_spike": "'Disk IO saturation on ' || vm_id || ': await ' || printf('%.0f', v_rec) || 'ms (z=' "
                "|| printf('%.1f', (v_rec - v_base) / v_std) || ')'",
    "net_retrans": "'Network retransmits on ' || vm_id || ': ' || printf('%.1f', retr) || '% (> 5%)'",
    "apm_latency": "'Latency regression on ' || app || ': p95 ' || printf('%.0f', p_rec) || 'ms (>1x baseline ' "
                   "|| printf('%.0f', p_base) || 'ms)'",
    "error_storm": "'Error storm on ' || vm_id || ': ' || printf('%.1f', err_rec) || '% errors (' "
                   "|| printf('%.0f', err_rec / greatest(err_base, 0.1)) || 'x baseline)'",
}
SEVERITY = {"heap_leak": HEAP_SEV, "error_storm": ERR_SEV}
APP = {"heap_leak": "app_h", "apm_latency": "app"}
ALL_ALERTS = ",\na AS (" + "\nUNION ALL ".join(
    _rule(name, SEVERITY.get(name, "'P2'"), APP.get(name, "app_r"), HEADLINE[name],
          *(("p", "''") if name == "apm_latency" else ())) for name in HEADLINE) + ")"
A = F + P[len(W):] + ALL_ALERTS
RANK = "CASE severity WHEN 'P1' THEN 0 WHEN 'P2' THEN 1 WHEN 'P3' THEN 2 ELSE 9 END"

# --- windows and features ---------------------------------------------------

ORACLES["evaluation_windows"] = f"""
WITH {W} SELECT "asof", t0 AS start_us, e AS end_us, r_lo AS recent_lo_us, h_lo AS heap_lo_us, b_hi AS base_hi_us
FROM w"""

ORACLES["window_samples"] = f"""
WITH {W} SELECT "asof", app, count(*) FILTER (WHERE {REC}) AS n_recent, count(*) FILTER (WHERE {HEAP}) AS n_heap,
  count(*) FILTER (WHERE {BASE}) AS n_base
FROM w JOIN m ON us <= e AND (us > h_lo OR us < b_hi) GROUP BY "asof", app"""

ORACLES["vm_window_features"] = f"""
WITH {F} SELECT "asof", vm_id, coalesce(app_r, app_h) AS app, n_heap, round(slope, 6) AS heap_slope,
  round(r, 6) AS heap_corr, round(cur, 6) AS heap_now, n_rec AS n_recent, round(v_rec, 6) AS io_recent,
  round(iops, 6) AS iops_now, round(retr, 6) AS retrans_recent, round(err_rec, 6) AS err_recent,
  round(gc, 6) AS gc_recent, round(v_rec, 6) AS latency_recent, round(slope_rec, 6) AS heap_slope_recent,
  n_base, round(v_base, 6) AS io_base, round(v_std, 6) AS io_base_std, round(err_base, 6) AS err_base
FROM f"""

ORACLES["app_latency_p95"] = f"""
WITH {P} SELECT "asof", app, round(p_rec, 6) AS p95_recent, round(p_base, 6) AS p95_base FROM p"""

ORACLES["app_latency_p95_distributed"] = ORACLES["app_latency_p95"]

# --- detection --------------------------------------------------------------

ORACLES["heap_leak"] = f"""
WITH {F} SELECT {HEAP_SEV} AS severity, 'heap_leak' AS rule, vm_id, app_h AS app, round(r, 6) AS corr,
  round(cur, 6) AS cur_heap_mb, 100.0::DOUBLE AS heap_cap_mb, round((100 - cur) / slope, 6) AS oom_eta_min,
  round(slope, 6) AS slope_mb_min
FROM f WHERE "asof" = 0 AND {FIRES['heap_leak']}"""

ORACLES["io_spike"] = f"""
WITH {F} SELECT 'P2' AS severity, 'io_spike' AS rule, vm_id, app_r AS app, round(v_rec, 6) AS await_ms,
  round(v_base, 6) AS baseline_ms, round(iops, 6) AS cur_iops, round((v_rec - v_base) / v_std, 6) AS z
FROM f WHERE "asof" = 0 AND {FIRES['io_spike']}"""

ORACLES["net_retrans"] = f"""
WITH {F} SELECT 'P2' AS severity, 'net_retrans' AS rule, vm_id, app_r AS app, round(retr, 6) AS retrans_pct,
  5.0::DOUBLE AS threshold_pct
FROM f WHERE "asof" = 0 AND {FIRES['net_retrans']}"""

ORACLES["apm_latency"] = f"""
WITH {P} SELECT 'P2' AS severity, 'apm_latency' AS rule, '' AS vm_id, app, round(p_base, 6) AS baseline_p95_ms,
  round(p_rec / p_base, 6) AS factor_x, round(p_rec, 6) AS p95_ms
FROM p WHERE "asof" = 0 AND {FIRES['apm_latency']}"""

ORACLES["error_storm"] = f"""
WITH {F} SELECT {ERR_SEV} AS severity, 'error_storm' AS rule, vm_id, app_r AS app,
  round(err_base, 6) AS baseline_pct, round(err_rec, 6) AS error_rate_pct,
  round(err_rec / greatest(err_base, 0.1), 6) AS jump_x
FROM f WHERE "asof" = 0 AND {FIRES['error_storm']}"""

ORACLES["detect_alerts"] = f"""
WITH {A} SELECT e AS ts_us, severity, rule, vm_id, app, headline, action FROM a WHERE "asof" = 0"""

# What an alert is based on, by key: value and decimals.
EVIDENCE = {
    "heap_leak": ("f", "vm_id", "app_h", {
        "corr": "round_even(r, 3)", "cur_heap_mb": "round_even(cur, 1)", "heap_cap_mb": "100.0",
        "oom_eta_min": "round_even((100 - cur) / slope, 1)", "slope_mb_min": "round_even(slope, 2)"}),
    "io_spike": ("f", "vm_id", "app_r", {
        "await_ms": "round_even(v_rec, 1)", "baseline_ms": "round_even(v_base, 1)", "cur_iops": "round_even(iops, 0)",
        "z": "round_even((v_rec - v_base) / v_std, 2)"}),
    "net_retrans": ("f", "vm_id", "app_r", {"retrans_pct": "round_even(retr, 2)", "threshold_pct": "5.0"}),
    "apm_latency": ("p", "''", "app", {
        "baseline_p95_ms": "round_even(p_base, 1)", "factor_x": "round_even(p_rec / p_base, 2)",
        "p95_ms": "round_even(p_rec, 1)"}),
    "error_storm": ("f", "vm_id", "app_r", {
        "baseline_pct": "round_even(err_base, 2)", "error_rate_pct": "round_even(err_rec, 2)",
        "jump_x": "round_even(err_rec / greatest(err_base, 0.1), 1)"}),
}
ORACLES["alert_evidence"] = f"WITH {A} " + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, {vm} AS vm_id, {app} AS app, '{key}' AS evidence_key, CAST({value} AS DOUBLE) AS x "
    f"FROM {source} WHERE \"asof\" = 0 AND {FIRES[rule]}"
    for rule, (source, vm, app, keys) in EVIDENCE.items() for key, value in keys.items())
ORACLES["replay_alerts"] = f"""
WITH {A} SELECT "asof", e AS ts_us, severity, rule, vm_id, app FROM a"""

ORACLES["replay_rule_counts"] = f"""
WITH {A} SELECT "asof", rule, severity, count(*) AS n_alerts FROM a GROUP BY "asof", rule, severity"""

ORACLES["replay_eta_timeline"] = f"""
WITH {F}, h AS (SELECT "asof", vm_id, app_h AS app, {HEAP_SEV} AS severity, (100 - cur) / slope AS eta
  FROM f WHERE {FIRES['heap_leak']})
SELECT "asof", vm_id, app, severity, round(eta, 6) AS oom_eta_min,
  round(eta - lag(eta) OVER (PARTITION BY vm_id ORDER BY "asof" DESC), 6) AS eta_change FROM h"""

ORACLES["alerts_by_severity_and_app"] = f"""
WITH {A} SELECT severity, rule, vm_id, app, headline FROM a WHERE "asof" = 0 AND severity = 'P1' AND app = 'app-3'"""

SUMMARY = f""",
sev AS (SELECT app, severity, count(*) AS n FROM a WHERE "asof" = 0 GROUP BY app, severity),
rul AS (SELECT app, rule, min({RANK}) AS rk FROM a WHERE "asof" = 0 GROUP BY app, rule),
summary AS (
  SELECT app, alert_counts, alert_rules, leaking FROM
    (SELECT app, string_agg(n || 'x ' || severity, ', ' ORDER BY n DESC, {RANK}) AS alert_counts FROM sev GROUP BY app)
    JOIN (SELECT app, string_agg(rule, '; ' ORDER BY rk, rule) AS alert_rules,
            bool_or(rule = 'heap_leak') AS leaking FROM rul GROUP BY app) USING (app))"""

ORACLES["alert_summary_by_app"] = f"WITH {A}{SUMMARY} SELECT * FROM summary"

# --- graph ------------------------------------------------------------------

T = """
fleet AS (
  SELECT s_name AS vm_id, n_name AS app, r_name AS site FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tree AS (
  SELECT c.n_name AS app, p.n_name AS depends_on_app FROM nation c
  JOIN nation p ON p.n_nationkey = (c.n_nationkey - 1) // 2 WHERE c.n_nationkey >= 1),
topology AS (SELECT vm_id, app, site, depends_on_app FROM fleet JOIN tree USING (app)),
edges AS (SELECT DISTINCT app, depends_on_app FROM topology WHERE depends_on_app <> '')"""

ORACLES["topology_rows"] = f"WITH {T} SELECT vm_id, app, site, depends_on_app FROM topology"
ORACLES["dependency_edges"] = f"WITH {T} SELECT app, depends_on_app FROM edges"


def _walk(src: str, dst: str, where: str = "TRUE", limit: int = 100) -> str:
    return f"""
walk(root, app, depth) AS (
  SELECT {src}, {dst}, 1::BIGINT FROM edges WHERE {where}
  UNION
  SELECT root, edges.{dst}, depth + 1 FROM walk JOIN edges ON edges.{src} = walk.app WHERE depth < {limit})"""


DOWN, UP = ("depends_on_app", "app"), ("app", "depends_on_app")
ORACLES["downstream_apps"] = f"""
WITH RECURSIVE {T}, {_walk(*DOWN, "depends_on_app IN ('NATION_0', 'NATION_3')")} SELECT root, app, min(depth) AS depth FROM walk GROUP BY root, app"""
ORACLES["upstream_apps"] = f"""
WITH RECURSIVE {T}, {_walk(*UP, "app IN ('NATION_20', 'NATION_24')")} SELECT root, app, min(depth) AS depth FROM walk GROUP BY root, app"""
CYCLE = T.replace("edges AS (SELECT", "edges AS (SELECT 'NATION_0' AS app, 'NATION_20' AS depends_on_app UNION SELECT", 1)
ORACLES["cyclic_reach"] = f"""
WITH RECURSIVE {CYCLE}, {_walk(*DOWN, "depends_on_app IN ('NATION_2', 'NATION_20')", 30)}
SELECT root, app, min(depth) AS depth FROM walk WHERE app <> root GROUP BY root, app"""
ORACLES["cyclic_hops"] = f"""
WITH RECURSIVE {CYCLE}, walk(root, app, depth, used) AS (
  SELECT depends_on_app, app, 1::BIGINT, [depends_on_app || '>' || app] FROM edges
  WHERE depends_on_app IN ('NATION_2', 'NATION_20')
  UNION ALL
  SELECT root, edges.app, depth + 1, list_append(used, edges.depends_on_app || '>' || edges.app)
  FROM walk JOIN edges ON edges.depends_on_app = walk.app
  WHERE depth < 5 AND NOT list_contains(used, edges.depends_on_app || '>' || edges.app))
SELECT DISTINCT root, app, depth AS hops FROM walk"""
ORACLES["target_vms"] = f"""
WITH {T[:T.index('tree AS')].rstrip().rstrip(',')}
SELECT vm_id, app, site FROM (SELECT *, row_number() OVER (ORDER BY vm_id) AS n FROM fleet WHERE app = 'NATION_3') WHERE n <= 3
UNION ALL SELECT vm_id, app, site FROM fleet WHERE vm_id IN ('Supplier#000000001', 'Supplier#000000002')"""
ORACLES["blast_radius_hops"] = f"""
WITH RECURSIVE {T}, {_walk(*DOWN, "depends_on_app IN ('NATION_0', 'NATION_2')", 5)}
SELECT DISTINCT root, app, depth AS hops FROM walk"""
ORACLES["dependency_chain_hops"] = f"""
WITH RECURSIVE {T}, {_walk(*UP, "app IN ('NATION_20', 'NATION_24')", 5)}
SELECT DISTINCT root, app, depth AS hops FROM walk"""
ORACLES["fault_to_symptom_paths"] = f"""
WITH RECURSIVE {T}, route(app, path, hops) AS (
  SELECT 'NATION_0', 'NATION_0', 0::BIGINT
  UNION ALL
  SELECT edges.app, path || ' > ' || edges.app, hops + 1
  FROM route JOIN edges ON edges.depends_on_app = route.app WHERE hops < 100)
SELECT 'NATION_0' AS fault, 'NATION_20' AS symptom, path, hops FROM route WHERE app = 'NATION_20'"""
ORACLES["vms_in_blast_radius"] = f"""
WITH RECURSIVE {T}, {_walk(*DOWN, "depends_on_app = 'NATION_1'", 5)}
SELECT DISTINCT 'NATION_1' AS root, app, vm_id FROM walk JOIN fleet USING (app)"""

APP_EDGES = """,
edges AS (SELECT DISTINCT app, 'app-' || ((app_no - 1) // 2) AS depends_on_app FROM m WHERE app_no >= 1),
roots AS (SELECT app AS root FROM edges UNION SELECT depends_on_app FROM edges)"""
TRACE = f"""
down(root, app, depth) AS (
  SELECT depends_on_app, app, 1::BIGINT FROM edges
  UNION SELECT root, edges.app, depth + 1 FROM down JOIN edges ON edges.depends_on_app = down.app WHERE depth < 50),
up(root, app, depth) AS (
  SELECT app, depends_on_app, 1::BIGINT FROM edges
  UNION SELECT root, edges.depends_on_app, depth + 1 FROM up JOIN edges ON edges.app = up.app WHERE depth < 50),
both_ways AS (
  SELECT root, 'downstream' AS direction, min(depth) AS depth, app FROM down GROUP BY root, app
  UNION ALL SELECT root, 'upstream', min(depth), app FROM up GROUP BY root, app)"""
ORACLES["dependency_trace"] = f"""
WITH RECURSIVE {A}{APP_EDGES}, {TRACE},
tags AS (SELECT app, string_agg(tag, ', ' ORDER BY tag) AS tags
  FROM (SELECT DISTINCT app, severity || ':' || rule AS tag FROM a WHERE "asof" = 0) GROUP BY app)
SELECT root, direction, depth, app, coalesce(tags, '') AS tags FROM both_ways LEFT JOIN tags USING (app)"""

# --- root cause and questions -----------------------------------------------

ORACLES["slowest_app"] = f"""
WITH {P} SELECT app, round(p_rec, 6) AS p95 FROM p WHERE "asof" = 0 ORDER BY p_rec DESC, app LIMIT 1"""

WORST = """,
worst AS (
  SELECT * FROM (SELECT app_r AS app, vm_id, slope_rec, cur_rec, gc, v_rec,
    row_number() OVER (PARTITION BY app_r ORDER BY v_rec DESC, vm_id) AS place
    FROM f WHERE "asof" = 0 AND n_rec > 0) WHERE place <= 3)"""
ORACLES["worst_vms_by_app"] = f"""
WITH {F}{WORST} SELECT app, place, vm_id, round(slope_rec, 6) AS heap_slope, round(cur_rec, 6) AS heap_now,
  round(gc, 6) AS gc, round(v_rec, 6) AS io_await, round(v_rec, 6) AS latency FROM worst"""

FACTS = A + WORST + SUMMARY + """,
facts AS (
  SELECT p.app, p.e, coalesce(p_rec, 0) AS p95_now, coalesce(p_base, 0) AS p95_base, alert_counts, alert_rules,
         coalesce(leaking, FALSE) AS leaking, one.vm_id AS worst_vm, one.v_rec AS latency,
         -- a slope over one sample is NaN here, which would count as larger than any threshold
         CASE WHEN NOT isnan(one.slope_rec) THEN one.slope_rec END AS slope_rec, one.cur_rec,
         one.gc, (SELECT string_agg(vm_id, ',' ORDER BY place) FROM worst x WHERE x.app = p.app) AS worst_vms
  FROM p LEFT JOIN summary USING (app) LEFT JOIN (SELECT * FROM worst WHERE place = 1) one ON one.app = p.app
  WHERE "asof" = 0),
judged AS (
  SELECT *, p95_base > 0 AND p95_now > 1.02 * p95_base AS elevated, p95_now / p95_base AS factor,
    coalesce(slope_rec > 0.5 AND cur_rec > 60, FALSE) AS heap_climbing,
    CASE WHEN slope_rec > 0.5 AND cur_rec > 60 THEN (100 - cur_rec) / slope_rec END AS heap_eta,
    coalesce(gc > 50, FALSE) AS gc_high, coalesce(latency > 55, FALSE) AS io_high,
    CASE WHEN leaking THEN 'heap_leak' WHEN latency > 55 THEN 'io_saturation' ELSE 'none' END AS cause
  FROM facts)"""
ORACLES["rca_facts"] = f"""
WITH {FACTS} SELECT app, round(p95_now, 6) AS p95_now, round(p95_base, 6) AS p95_base, worst_vms, alert_counts,
  alert_rules, leaking FROM facts"""


def _number(value: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', {value}), 'nan')"


ORACLES["rca_facts_text"] = f"""
WITH {FACTS} SELECT app, 'latency' AS section, 0::BIGINT AS line_no, 'app: ' || app AS line FROM facts
UNION ALL SELECT app, 'latency', 1, 'app_latency_ms p95: now=' || printf('%.0f', p95_now) || ' ms, baseline='
  || printf('%.0f', p95_base) || ' ms' FROM facts
UNION ALL SELECT app, 'worst_vms', place - 1, vm_id || ' heap_slope=' || {_number("slope_rec", 2)} || ' heap_now='
  || {_number("cur_rec", 1)} || ' gc=' || {_number("gc", 1)} || ' io_await=' || {_number("v_rec", 1)} || ' latency='
  || {_number("v_rec", 1)} FROM worst
UNION ALL SELECT app, 'alerts', {RANK}, concat_ws(' ', severity, rule, vm_id, headline) FROM a WHERE "asof" = 0 AND app <> ''"""
ORACLES["rca_verdict"] = f"""
WITH {FACTS} SELECT app, elevated, round(factor, 6) AS factor, worst_vm, round(latency, 6) AS worst_latency,
  heap_climbing, round(heap_eta, 6) AS heap_eta, gc_high, io_high, cause FROM judged"""

NL = "chr(10)"
NARRATIVE = f"""SELECT app,
  '## ' || app || ': root-cause summary (as of ' || strftime(make_timestamp(e), '%H:%M:%S') || ')' || {NL} || {NL}
  || CASE WHEN elevated THEN '- **Latency is elevated**: p95 ' || printf('%.0f', p95_now) || ' ms vs baseline '
       || printf('%.0f', p95_base) || ' ms (' || printf('%.1f', factor) || 'x).'
     ELSE '- Latency p95 is ' || printf('%.0f', p95_now) || ' ms (baseline ' || printf('%.0f', p95_base)
       || ' ms) — near normal.' END
  || coalesce({NL} || '- **Worst VM ' || worst_vm || '**: latency ~' || printf('%.0f', latency) || ' ms — '
       || coalesce(nullif(concat_ws('; ',
            CASE WHEN heap_climbing THEN 'heap climbing +' || printf('%.0f', slope_rec) || ' MB/min (now '
              || printf('%.0f', cur_rec) || ' MB, OOM ETA ~' || printf('%.0f', heap_eta) || ' min)' END,
            CASE WHEN gc_high THEN 'GC pauses ~' || printf('%.0f', gc) || ' ms' END,
            CASE WHEN io_high THEN 'disk await ~' || printf('%.0f', latency) || ' ms' END), ''),
          'no single dominant metric') || '.', '')
  || {NL} || coalesce('- **Active alerts**: ' || alert_counts || ' — ' || alert_rules,
       '- No active alerts for this app.')
  || CASE cause
       WHEN 'heap_leak' THEN {NL} || {NL} || '**Likely cause:** a JVM heap leak driving GC pressure and latency toward an OOM. **Action:** capture a heap dump and schedule a rolling restart before the ETA.'
       WHEN 'io_saturation' THEN {NL} || {NL} || '**Likely cause:** downstream disk/IO saturation. **Action:** check the storage backend and slow queries.'
       ELSE '' END AS text
FROM judged"""
ORACLES["rca_narrative"] = f"WITH {FACTS} {NARRATIVE}"

_NAMED = {app: f"contains(lower(text), '{app}') OR contains(lower(text), '{app.replace('-', ' ')}')"
          for app in ("que-la", "une", "the", "app-1", "app-3")}
INTENT = ("CASE WHEN contains(lower(text), 'the ') OR contains(lower(text), 'que') "
          "THEN 'blast' ELSE 'rca' END")
TOP_APP = '(SELECT app FROM p WHERE "asof" = 0 ORDER BY p_rec DESC, app LIMIT 1)'
ORACLES["question_routing"] = f"""
WITH {P} SELECT conv_id, turn, CASE WHEN {_NAMED['que-la']} THEN 'que-la' WHEN {_NAMED['une']} THEN 'une'
  WHEN {_NAMED['the']} THEN 'the' ELSE {TOP_APP} END AS app, {INTENT} AS intent FROM conversations"""
ORACLES["question_answers"] = f"""
WITH RECURSIVE {FACTS}{APP_EDGES}, {TRACE},
q AS (SELECT conv_id, turn, CASE WHEN {_NAMED['app-1']} THEN 'app-1' WHEN {_NAMED['app-3']} THEN 'app-3'
  WHEN {_NAMED['une']} THEN 'une' ELSE {TOP_APP} END AS app, {INTENT} AS intent FROM conversations),
texts AS (
  {NARRATIVE}
  UNION ALL SELECT 'une', '## une: root-cause summary (as of ' || strftime(make_timestamp(max(e)), '%H:%M:%S') || ')' || {NL} || {NL}
    || '- Latency p95 is 0 ms (baseline 0 ms) — near normal.' || {NL} || '- No active alerts for this app.' FROM p WHERE "asof" = 0),
split AS (SELECT app, string_split(text, {NL}) AS parts FROM texts),
tags AS (SELECT app, string_agg(tag, ', ' ORDER BY tag) AS tags
  FROM (SELECT DISTINCT app, severity || ':' || rule AS tag FROM a WHERE "asof" = 0) GROUP BY app),
asked AS (SELECT DISTINCT app FROM q),
near AS (SELECT root, CASE direction WHEN 'downstream' THEN 4 ELSE 6 END AS block, depth,
    '  depth ' || depth || ': ' || app || coalesce('  ALERTS: ' || tags, '') AS line
  FROM both_ways LEFT JOIN tags USING (app)),
n AS (
  SELECT app, 'rca' AS intent, i - 1 AS line_no, parts[i] AS line
  FROM (SELECT app, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)
  UNION ALL SELECT root, 'blast', block * 1000000 + depth, line FROM near
  UNION ALL SELECT app, 'blast', block * 1000000, '  (none)' FROM asked, (VALUES (4), (6)) x(block)
    WHERE NOT EXISTS (SELECT 1 FROM near WHERE root = asked.app AND near.block = x.block)
  UNION ALL SELECT app, 'blast', block * 1000000, replace(line, '@', app) FROM asked, (VALUES
    (0, '## Blast radius: @'), (1, ''), (2, 'app: @'), (3, 'downstream (impacted if @ fails):'), (5, 'upstream (@ depends on):'),
    (7, ''), (8, '**Interpretation:** if @ degrades, every downstream app above loses its dependency; any already showing ALERTS is feeling it now. Trace the chain to connect a root-cause alert on @ to the user-facing symptoms upstream.')) x(block, line))
SELECT conv_id, turn, app, intent, line_no, line FROM q JOIN n USING (app, intent)"""

ORACLES["guarded_sql"] = f"""
WITH {M} SELECT vm_id, count(*) AS n, round(max(v)::FLOAT, 6) AS top_heap FROM m GROUP BY vm_id"""
ORACLES["guarded_sql_alerts"] = f"""
WITH {A} SELECT rule, severity, count(*) AS n FROM a WHERE "asof" = 0 GROUP BY rule, severity"""

# --- fleet health -----------------------------------------------------------

ORACLES["fleet_kpis"] = f"""
WITH {A} SELECT (SELECT count(DISTINCT vm_id) FROM m) AS n_vms, (SELECT count(DISTINCT app) FROM m) AS n_apps,
  (SELECT count(*) FROM m) AS n_samples, count(*) FILTER (WHERE severity = 'P1') AS n_p1,
  count(*) FILTER (WHERE severity = 'P2') AS n_p2 FROM a WHERE "asof" = 0"""
ORACLES["fleet_grid"] = f"""
WITH {A}, rk AS (SELECT vm_id, max(CASE severity WHEN 'P1' THEN 2 WHEN 'P2' THEN 1 ELSE 0 END) AS r
  FROM a WHERE "asof" = 0 AND vm_id <> '' GROUP BY vm_id)
SELECT vm_id, app, coalesce(r, 0)::BIGINT AS rank,
  CASE coalesce(r, 0) WHEN 2 THEN 'P1' WHEN 1 THEN 'P2' ELSE 'healthy' END AS status,
  row_number() OVER (PARTITION BY app ORDER BY vm_id) - 1 AS i
FROM (SELECT DISTINCT vm_id, app FROM m) LEFT JOIN rk USING (vm_id)"""
ORACLES["vm_heap_series"] = f"""
WITH {W} SELECT us AS ts_us, round(v, 6) AS heap_mb, CASE WHEN us <= e THEN 'known' ELSE 'after-now' END AS phase,
  100.0::DOUBLE AS heap_cap_mb FROM m, w WHERE "asof" = 45 AND vm_id = 'vm-00003'"""
ORACLES["alert_list"] = f"""WITH {A} SELECT severity, rule, vm_id, app, headline FROM a WHERE "asof" = 0"""
ORACLES["default_chart_vm"] = f"""
WITH {A} SELECT vm_id FROM (
  SELECT 0 AS c, {RANK} AS rk, vm_id FROM a WHERE "asof" = 0 AND rule = 'heap_leak'
  UNION ALL SELECT 1, 0, vm_id FROM m) ORDER BY c, rk, vm_id LIMIT 1"""

# --- quality and evaluation -------------------------------------------------

_CLIP = {"cpu_pct": "value", "heap_mb": "value", "gc_pause_ms": "k", "disk_io_await_ms": "value", "disk_iops": "k",
         "net_mbps": "k", "net_retrans_pct": "value / 10", "app_latency_ms": "value", "error_rate_pct": "err"}
ORACLES["clipped_metrics"] = f"""
WITH {M}, x AS (SELECT m.*, v AS value0 FROM m)
SELECT app, {", ".join(
    f"round(sum(greatest((({'retrans' if n == 'net_retrans_pct' else 'v' if e == 'value' else e})::FLOAT - 50)::FLOAT, 0)::DOUBLE), 6) AS {n}"
    for n, e in _CLIP.items())} FROM x GROUP BY app"""

_QUOTA = "greatest(1, round_even(n_app * {target} / total, 0))"
ORACLES["fleet_downsample"] = f"""
WITH {T}, s AS (SELECT *, count(*) OVER (PARTITION BY app) AS n_app, count(*) OVER () AS total,
  row_number() OVER (PARTITION BY app ORDER BY vm_id) AS place FROM fleet)
SELECT vm_id, app, site FROM s
WHERE place <= {_QUOTA.format(target='round_even(total / 3.0, 0)')}"""
ORACLES["fact_downsample"] = f"""
WITH {M}, s AS (SELECT *, count(*) OVER (PARTITION BY app) AS n_app, count(*) OVER () AS total,
  row_number() OVER (PARTITION BY app ORDER BY vm_id) AS place FROM (SELECT DISTINCT vm_id, app FROM m))
SELECT vm_id, count(*) AS n, round(sum(v), 6) AS heap FROM m
WHERE vm_id IN (SELECT vm_id FROM s WHERE total <= 40 OR place <= {_QUOTA.format(target='40.0')}) GROUP BY vm_id"""
ORACLES["first_vms_by_app_and_site"] = f"""
WITH {T} SELECT * FROM (SELECT vm_id, app, site,
  row_number() OVER (PARTITION BY app, site ORDER BY vm_id) AS place FROM fleet) WHERE place <= 2"""
ORACLES["incident_labels"] = f"""
WITH {M}, c AS (SELECT vm_id, min(us) AS s FROM m WHERE v >= 95 GROUP BY vm_id)
SELECT us AS ts_us, vm_id, 'high-heap' AS incident, round((us - s) / {UNIT}.0, 6) AS elapsed_min
FROM m JOIN c USING (vm_id) WHERE us >= s AND us < s + 10 * {UNIT}"""
ORACLES["first_cap_crossings"] = f"""
WITH {M} SELECT min(us) AS ts_us, vm_id, max(app) AS app, max(site) AS site, 'ERROR' AS level, 'oom_kill' AS event_type,
  'java.lang.OutOfMemoryError: Java heap space (cap 100MB)' AS message FROM m WHERE v >= 100 GROUP BY vm_id"""
ORACLES["thinned_samples"] = f"""
WITH {M} SELECT ts_us, vm_id FROM (SELECT us AS ts_us, vm_id,
  row_number() OVER (PARTITION BY vm_id ORDER BY us) - 1 AS i FROM m) WHERE i % 7 = 0"""
ORACLES["baseline_band_audit"] = f"WITH {M}, u AS (" + " UNION ALL ".join(
    f"SELECT app, '{n}' AS metric, {'retrans' if n == 'net_retrans_pct' else 'v' if e == 'value' else e} AS x, "
    f"{dict(net_retrans_pct=0.05, error_rate_pct=0.03, gc_pause_ms=1.0).get(n, 0.0)} AS floor_ FROM m"
    for n, e in _CLIP.items()) + """),
s AS (SELECT app, metric, avg(x) AS mean, greatest(0.08 * abs(avg(x)), max(floor_)) AS sigma FROM u GROUP BY app, metric)
SELECT app, metric, count(x) AS n_samples,
  count(*) FILTER (WHERE x < greatest(mean - 6 * sigma, 0) OR x > mean + 6 * sigma) AS n_outside
FROM u JOIN s USING (app, metric) GROUP BY app, metric"""
ORACLES["detector_scores"] = f"""
WITH {A}, found AS (SELECT DISTINCT rule, vm_id FROM a WHERE rule IN ('heap_leak', 'error_storm')),
truth AS (SELECT 'heap_leak' AS rule, vm_id FROM m GROUP BY vm_id HAVING max(v) >= 250
  UNION ALL SELECT 'error_storm', vm_id FROM m GROUP BY vm_id HAVING avg(err) > 25)
SELECT rule, count(*) FILTER (WHERE f_ AND t_) AS tp, count(*) FILTER (WHERE f_ AND t_ IS NULL) AS fp,
  count(*) FILTER (WHERE f_ IS NULL AND t_) AS fn
FROM (SELECT rule, vm_id, TRUE AS f_ FROM found) FULL JOIN (SELECT rule, vm_id, TRUE AS t_ FROM truth) USING (rule, vm_id)
GROUP BY rule"""
ORACLES["alert_lead_times"] = f"""
WITH {F}, c AS (SELECT vm_id, min(us) AS s FROM m WHERE v >= 150 GROUP BY vm_id),
h AS (SELECT vm_id, min(e) AS first_e FROM f WHERE {FIRES['heap_leak']} GROUP BY vm_id)
SELECT vm_id, first_e AS first_alert_us, s AS crossing_us, round((s - first_e) / {UNIT}.0, 6) AS lead_min
FROM h JOIN c USING (vm_id)"""

# --- ingest, sinks, streaming -----------------------------------------------

CHUNK = 12 * UNIT              # three days
ORACLES["chunk_slices"] = f"""
WITH {W} SELECT (us - t0) // {CHUNK} AS chunk, count(*) AS n FROM m, b GROUP BY ALL"""
ORACLES["ingested_days"] = f"""
WITH {M} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(v), 6) AS heap FROM m GROUP BY ALL"""
ORACLES["ingest_ledger"] = f"""
WITH {W} SELECT (us - t0) // {CHUNK} AS chunk, 'vm_metrics' AS "table", count(*) AS n FROM m, b GROUP BY ALL"""
ORACLES["mixed_ingest"] = f"""
WITH {M} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, (SELECT count(*) FROM m) AS ledger_rows,
  1::BIGINT AS empty_chunks FROM m GROUP BY ALL"""
ORACLES["mixed_columns"] = f"""
WITH {W}, c AS (SELECT t0 + (t1 - t0) * 1 // 3 AS c1, t0 + (t1 - t0) * 2 // 3 AS c2 FROM b)
SELECT vm_id, way, count(*) AS n, count(*) FILTER (WHERE us > c1) AS n_heap, count(*) FILTER (WHERE us > c2) AS n_cpu,
  0::BIGINT AS n_app FROM m, c, (VALUES ('raw'), ('files'), ('stream')) ways(way) GROUP BY vm_id, way"""
ORACLES["batch_history"] = f"""
WITH {W}, h AS (SELECT count(*) FILTER (WHERE us <= (t0 + t1) // 2) AS n0, count(*) AS n FROM m, b)
SELECT 'vm_metrics' AS "table", 0::BIGINT AS batch_id, 'append' AS operation, n0 AS added, 0::BIGINT AS previous_total,
  n0 AS total FROM h
UNION ALL SELECT 'vm_metrics', 1, 'append', n - n0, n0, n FROM h"""
ORACLES["lake_as_of_batch"] = f"""
WITH {W} SELECT app, count(*) AS n_now, nullif(count(*) FILTER (WHERE us <= (t0 + t1) // 2), 0) AS n_then
FROM m, b GROUP BY app"""
ORACLES["lake_detect"] = f"""WITH {A} SELECT severity, rule, vm_id, app FROM a WHERE "asof" = 0"""
ORACLES["catalog_load"] = f"""
WITH {A}, {T.strip()},
loaded AS (SELECT 'vm_metrics' AS "table", count(*) AS n FROM m UNION ALL SELECT 'app_events', count(*) FROM m
  UNION ALL SELECT 'topology', count(*) FROM topology UNION ALL SELECT 'alerts', count(*) FROM a WHERE "asof" = 0)
SELECT "table", n, (SELECT count(*) FROM a WHERE "asof" = 0 AND severity = 'P1') AS n_p1 FROM loaded"""
ORACLES["hourly_chunks"] = f"""
WITH {M} SELECT strftime(ts, '%Y-%m-%d') AS dt, hour(ts) AS hour, count(*) AS n FROM m GROUP BY ALL"""
ORACLES["app_event_counts"] = f"""
WITH {M} SELECT app, site, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'WARN' END AS level, event_type,
  count(*) AS n FROM m GROUP BY ALL"""
ORACLES["topology_overwrite"] = f"""
WITH {T} SELECT app, depends_on_app, count(*) AS n_vms FROM topology GROUP BY app, depends_on_app"""
ORACLES["alerts_json"] = f"""
WITH {A} SELECT strftime(make_timestamp(e), '%Y-%m-%d %H:%M:%S.') || rtrim(strftime(make_timestamp(e), '%f'), '0') AS ts,
  severity, rule, vm_id, app, headline, action,
  CASE rule WHEN 'heap_leak' THEN 5 WHEN 'io_spike' THEN 4 WHEN 'net_retrans' THEN 2 ELSE 3 END AS n_evidence
FROM a WHERE "asof" = 0"""
ORACLES["alerts_table"] = f"""WITH {A} SELECT rule, severity, count(*) AS n FROM a WHERE "asof" = 0 GROUP BY rule, severity"""
ORACLES["alert_digest"] = f"""
WITH {A}, o AS (SELECT *, row_number() OVER (ORDER BY {RANK}, rule, vm_id, app) - 1 AS at_ FROM a WHERE "asof" = 0)
SELECT at_ // 500 AS page, (SELECT count(*) FROM o) AS n_alerts, '#d00000' AS color,
  ':rotating_light: ' || (SELECT count(*) FROM o) || ' alert(s) (asof -0m)' AS headline,
  string_agg('[' || severity || '] ' || rule || ' — ' || headline, {NL} ORDER BY at_) AS text
FROM o GROUP BY at_ // 500"""

LIVE = W + f""",
ends AS (SELECT unnest(range(t0 // {SLIDE} * {SLIDE}, t1 + 30 * {UNIT}, {SLIDE})) AS e, t0, t1 FROM b),
closed AS (SELECT e, t0 FROM ends WHERE e <= (t1 - 1) // 1000 * 1000 - 60000000)"""
LIVE_BASE = """,
base AS (SELECT vm_id, avg(v) AS v_base, stddev_samp(v) AS v_std, avg(err) AS err_base, count(*) AS n_base
  FROM m, w WHERE "asof" = 0 AND us >= t0 AND us < b_hi GROUP BY vm_id)"""
LIVE_F = LIVE + LIVE_BASE + f""",
g AS (SELECT e, vm_id, max(app) FILTER (WHERE us > e - 10 * {UNIT}) AS app_r, max(app) AS app_h, count(*) AS n_heap,
    nullif(regr_slope(v, (us - e) / {UNIT}.0), 'nan'::DOUBLE) AS slope, nullif(corr(v, (us - e) / {UNIT}.0), 'nan'::DOUBLE) AS r,
    arg_max(v, us) AS cur, count(*) FILTER (WHERE us > e - 10 * {UNIT}) AS n_rec, avg(v) FILTER (WHERE us > e - 10 * {UNIT}) AS v_rec,
    arg_max(k, us) FILTER (WHERE us > e - 10 * {UNIT}) AS iops, avg(retrans) FILTER (WHERE us > e - 10 * {UNIT}) AS retr,
    avg(err) FILTER (WHERE us > e - 10 * {UNIT}) AS err_rec
  FROM closed JOIN m ON us > e - 30 * {UNIT} AND us <= e GROUP BY e, vm_id),
f AS (SELECT *, coalesce(base.n_base, 0) AS n_base FROM g LEFT JOIN base USING (vm_id))"""
LIVE_P = LIVE + f""",
stored AS (SELECT app, quantile_cont(v, 0.95) AS p_base FROM m, w WHERE "asof" = 0 AND us >= t0 AND us < b_hi GROUP BY app),
p AS (SELECT e, app, quantile_cont(v, 0.95) AS p_rec, any_value(p_base) AS p_base
  FROM closed JOIN m ON us > e - 10 * {UNIT} AND us <= e JOIN stored USING (app) GROUP BY e, app)"""


def _live(name: str) -> str:
    """Whole rows of one rule; evidence as `key=value` by key."""
    source, vm, app, values = EVIDENCE[name]
    evidence = " || ';' || ".join(f"'{key}=' || printf('%.3f', {value}::DOUBLE + 0.0::DOUBLE)" for key, value in sorted(values.items()))
    return (f"SELECT e AS ts_us, {SEVERITY.get(name, "'P2'")} AS severity, '{name}' AS rule, {vm} AS vm_id, {app} AS app, "
            f"{HEADLINE[name]} AS headline, {evidence} AS evidence, '{ACTION[name]}' AS action FROM {source} WHERE {FIRES[name]}")


ORACLES["live_recent_alerts"] = f"WITH {LIVE_F} " + "\nUNION ALL ".join(map(_live, ("io_spike", "net_retrans", "error_storm")))
ORACLES["live_heap_alerts"] = f"WITH {LIVE_F} " + _live("heap_leak")
ORACLES["live_vm_alerts"] = f"WITH {LIVE_F} " + "\nUNION ALL ".join(
    map(_live, ("heap_leak", "io_spike", "net_retrans", "error_storm")))
ORACLES["live_latency_alerts"] = f"WITH {LIVE_P} " + _live("apm_latency")
ORACLES["sweep_alerts"] = "WITH " + A.replace(
    "(VALUES (0), (15), (30), (45)) AS x(ao)", "(SELECT unnest(range(0, 440))::DOUBLE / 4 AS ao) AS x") + """
SELECT "asof", e::BIGINT AS ts_us, severity, rule, vm_id, app FROM a"""

# --- partials, sketches, intervals --------------------------------------------

ORACLES["lake_kpis"] = ORACLES["fleet_kpis"]
ORACLES["lake_grid"] = ORACLES["fleet_grid"]
ORACLES["lake_heap_series"] = ORACLES["vm_heap_series"]
ORACLES["vm_history"] = f"""
WITH {W}, c AS (SELECT min(us) AS lo, max(us) AS hi FROM m)
SELECT vm_id, app, count(*) AS n_samples, min(us) AS first_ts_us, max(us) AS last_ts_us,
  nullif(count(*) FILTER (WHERE us <= (lo + hi) // 2), 0) AS n_then FROM m, c GROUP BY vm_id, app"""
ORACLES["sketched_latency"] = f"""
WITH {M} SELECT app, count(*) AS n, TRUE AS rank_in_bound, TRUE AS vms_in_bound FROM m GROUP BY app"""
ORACLES["dense_incident_labels"] = f"""
WITH {M}, i AS (SELECT vm_id, us AS s, us + (1 + floor(v)::BIGINT % 7) * {UNIT // 2} AS t FROM m WHERE v > 60)
SELECT m.vm_id, count(*) AS n, round(max((us - s) / {UNIT}.0), 6) AS longest, sum(floor((us - s) / {UNIT}.0)) AS total
FROM m JOIN i ON m.vm_id = i.vm_id AND us >= s AND us < t GROUP BY m.vm_id"""

# --- closures, counts, versions, index ------------------------------------------

ORACLES["all_pairs_reach"] = f"""
WITH RECURSIVE {CYCLE}, {_walk(*DOWN, limit=30)} SELECT root AS src, app AS dst, min(depth) AS depth
FROM walk WHERE app <> root GROUP BY root, app"""
ORACLES["fault_to_symptom_counts"] = """
WITH RECURSIVE c(k, hops, n) AS (
  SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT
  UNION ALL
  SELECT k, hops + 1, sum(n)::BIGINT FROM (SELECT c.k + s AS k, hops, n FROM c, (VALUES (1), (2), (3)) x(s) WHERE c.k + s <= 24)
  GROUP BY k, hops)
SELECT hops, n AS n_paths FROM c WHERE k = (SELECT max(n_nationkey) FROM nation)"""
_KEY = "regexp_extract(app, '([0-9]+)$', 1)::INT"
ORACLES["topology_changes"] = f"""
WITH {T}, e AS (SELECT {_KEY} AS k FROM edges),
l AS (SELECT k, TRUE AS a, k % 2 = 0 OR k < 10 AS b, k < 20 AS c FROM e)
SELECT epoch_us(TIMESTAMP '2024-01-01') AS at_us, count(*) AS opened, 0::BIGINT AS closed FROM l
UNION ALL SELECT epoch_us(TIMESTAMP '2024-01-05'), count(*) FILTER (b AND NOT a), count(*) FILTER (a AND NOT b) FROM l
UNION ALL SELECT epoch_us(TIMESTAMP '2024-01-09'), count(*) FILTER (c AND NOT b), count(*) FILTER (b AND NOT c) FROM l"""
_THEN = T.replace("edges AS (", "every AS (") + f", edges AS (SELECT * FROM every WHERE {_KEY} % 2 = 0 OR {_KEY} < 10)"
ORACLES["trace_as_of_load"] = f"""
WITH RECURSIVE {_THEN}, {_walk(*DOWN, "depends_on_app IN ('NATION_0', 'NATION_3')")}
SELECT root, app, min(depth) AS depth FROM walk GROUP BY root, app"""
ORACLES["question_index_routing"] = f"""
WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
n AS (SELECT conv_id, turn, min(w) AS app FROM conversations JOIN d ON length(w) >= 9 AND contains(lower(text), w) GROUP BY ALL)
SELECT conv_id, turn, coalesce(n.app, 'none') AS app, {INTENT} AS intent FROM conversations LEFT JOIN n USING (conv_id, turn)"""

ORACLES["watched_ingest"] = ORACLES["ingested_days"]
ORACLES["lake_as_of_instant"] = ORACLES["lake_as_of_batch"]
ORACLES["ordered_downstream"] = f"""
WITH RECURSIVE {T}, {_walk(*DOWN, "depends_on_app IN ('NATION_0', 'NATION_3')")},
d AS (SELECT root, app, min(depth) AS depth FROM walk GROUP BY root, app)
SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, app) AS place FROM d"""
ORACLES["alerts_without_ids"] = f"""
WITH {W}, g AS (SELECT e, avg(retrans) AS retr FROM w JOIN m ON {REC} WHERE "asof" = 0 AND app = 'app-3' GROUP BY e)
SELECT e AS ts_us, 'P2' AS severity, 'net_retrans' AS rule, '' AS vm_id, 'app-3' AS app,
  'Network retransmits on : ' || printf('%.1f', retr) || '% (> 1%)' AS headline, '{ACTION['net_retrans']}' AS action
FROM g WHERE retr > 1"""
ORACLES["empty_tables_union"] = f"WITH {M} SELECT app, count(*) AS n, round(sum(v), 6) AS heap FROM m GROUP BY app"
