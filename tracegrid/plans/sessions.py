"""Queries over ordered series: a user is a session, clicks stand for licks, purchases for rewards, views for samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracegrid.operators import asof, series as sr
from tracegrid.operators.ordered import dealt, joined, positions, running
from tracegrid.plans.registry import DAY, EV, events, query, r6, series
from tracegrid.sources.sessions import pulse_delay

U = ["user_id"]


def kind():
    return F.col("event_type")


def _views(ev):
    return positions(ev.where(kind() == "view").select("user_id", "t", "event_id", "value"), U, "t", ["event_id"], "frame", DAY)


VIEWS = "v AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS frame FROM ev WHERE event_type = 'view')"
NEXT = "SELECT e.*, v.frame FROM ev e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.t < v.t"


@query(f"""WITH {EV}, {VIEWS}, h AS (SELECT e.user_id, e.event_type, coalesce(v.frame, (SELECT max(frame) FROM v WHERE v.user_id = e.user_id)) AS frame FROM ev e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.t < v.t WHERE e.event_type IN ('click', 'purchase')),
b AS (SELECT v.user_id, v.frame, v.t, v.value, count(*) FILTER (h.event_type = 'click') AS c, count(*) FILTER (h.event_type = 'purchase') AS p FROM v LEFT JOIN h USING (user_id, frame) GROUP BY ALL),
r AS (SELECT *, sum(p) OVER w AS pc, t - min(t) OVER (PARTITION BY user_id) AS el FROM b WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
n AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase FROM events GROUP BY user_id)
SELECT user_id, n_click, n_purchase, round(max(pc / CASE WHEN frame = 0 THEN 1.0 ELSE el END), 6) AS peak_rate, round(max(t), 6) AS last_t, arg_max(value, frame) AS last_value FROM r JOIN n USING (user_id) GROUP BY ALL""")
def q01_session_summary(spark, sf_dir):
    ev = events(spark, sf_dir)
    counts = {"click": kind() == "click", "purchase": kind() == "purchase"}
    traces = asof.binned(ev.where(kind().isin("click", "purchase")).drop("value"), _views(ev).drop("event_id"), U, "t", "t", "frame", counts, "keep", DAY)
    rates = sr.event_rates(traces.withColumn("dt", F.lit(1.0)), U, "frame", "t", "click", "purchase", "dt")
    best = rates.groupBy("user_id").agg(r6(F.max("rate"), "peak_rate"), r6(F.max("t"), "last_t"), F.max_by("value", "frame").alias("last_value"))
    n = ev.groupBy("user_id").agg(F.count_if(kind() == "click").alias("n_click"), F.count_if(kind() == "purchase").alias("n_purchase"))
    return n.join(best, U)


@query(f"""WITH {EV}, g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev WHERE event_type = 'signup')
SELECT user_id, round(min(t), 6) AS first_pulse, round(max(gap), 6) AS max_gap, count(*) AS n_pulses FROM g GROUP BY user_id""")
def q02_pulse_gap(spark, sf_dir):
    found = pulse_delay(events(spark, sf_dir), U, "t", kind() == "signup")
    return found.select("user_id", r6("first_pulse", "first_pulse"), r6("max_gap", "max_gap"), "n_pulses")


@query(f"""WITH {EV}, {VIEWS}, h AS (SELECT e.user_id, coalesce(v.frame, (SELECT max(frame) FROM v WHERE v.user_id = e.user_id)) AS frame FROM ev e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.t < v.t WHERE e.event_type = 'click')
SELECT user_id, frame, count(*) AS n FROM h WHERE frame IS NOT NULL GROUP BY ALL""")
def q03_bin_next_keep_trailing(spark, sf_dir):
    ev = events(spark, sf_dir)
    return asof.next_sample(ev.where(kind() == "click"), _views(ev), U, "t", "t", "frame", "keep", DAY).groupBy("user_id", "frame").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, {VIEWS}, h AS (SELECT e.user_id, v.frame FROM ev e ASOF JOIN v ON e.user_id = v.user_id AND e.t < v.t WHERE e.event_type = 'click')
SELECT user_id, frame, count(*) AS n FROM h GROUP BY ALL""")
def q04_bin_next_drop_trailing(spark, sf_dir):
    ev = events(spark, sf_dir)
    return asof.next_sample(ev.where(kind() == "click"), _views(ev), U, "t", "t", "frame", "drop", DAY).groupBy("user_id", "frame").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, {VIEWS} SELECT e.event_id, arg_min(v.frame, {{'d': abs(v.t - e.t), 'f': v.frame}}) AS frame FROM ev e JOIN v USING (user_id) WHERE e.event_type = 'click' GROUP BY e.event_id""")
def q05_nearest_sample(spark, sf_dir):
    ev = events(spark, sf_dir)
    found = asof.nearest(ev.where(kind() == "click").select("event_id", "user_id", "t"), _views(ev), U, "t", "t", ["frame"], DAY)
    return found.where("frame is not null").select("event_id", "frame")


@query(f"""WITH {EV} SELECT p.event_id AS anchor, c.event_id AS event, round(c.t - p.t, 6) AS lag FROM ev p JOIN ev c ON p.user_id = c.user_id AND c.t - p.t > -36000 AND c.t - p.t < 72000 WHERE p.event_type = 'purchase' AND c.event_type = 'click'""")
def q06_peri_event_window(spark, sf_dir):
    ev = events(spark, sf_dir)
    clicks = ev.where(kind() == "click").select("user_id", F.col("event_id").alias("event"), "t")
    anchors = ev.where(kind() == "purchase").select("user_id", F.col("event_id").alias("anchor"), F.col("t").alias("at"))
    return asof.around(clicks, anchors, U, "t", "at", -36000.0, 72000.0).select("anchor", "event", r6("lag", "lag"))


GRID = "g AS (SELECT user_id, unnest(range(0, 720)) * 3600.0::DOUBLE AS g FROM (SELECT DISTINCT user_id FROM events))"
BRACKETS = """b AS (SELECT g.user_id, g.g, p.t AS pt, p.value AS pv FROM g ASOF LEFT JOIN v p ON g.user_id = p.user_id AND g.g >= p.t),
c AS (SELECT b.*, n.t AS nt, n.value AS nv FROM b ASOF LEFT JOIN v n ON b.user_id = n.user_id AND b.g <= n.t)"""
LINE = "CASE WHEN nt > pt THEN pv + (nv - pv) * (g - pt) / (nt - pt) ELSE pv END"


def _grid(ev):
    users = ev.select("user_id").distinct()
    return dealt(users, 720 * users.count(), "user_id").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(719)))).withColumn("g", F.col("g") * 3600.0)


@query(f"WITH {EV}, {VIEWS}, {GRID}, {BRACKETS} SELECT user_id, g, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv ELSE {LINE} END, 6) AS value FROM c")
def q07_interp_clamped(spark, sf_dir):
    ev = events(spark, sf_dir)
    return asof.interpolated(_grid(ev), _views(ev), U, "g", "t", ["value"], "linear", "clamp", DAY).select("user_id", "g", r6("value", "value"))


@query(f"""WITH {EV}, {VIEWS}, {GRID}, {BRACKETS} SELECT user_id, g, round(CASE WHEN pt IS NULL AND nt IS NULL THEN NULL WHEN pt IS NULL OR nt IS NULL THEN 0 ELSE {LINE} END, 6) AS line,
round(CASE WHEN pt IS NULL AND nt IS NULL THEN NULL WHEN pt IS NULL OR nt IS NULL THEN 0 WHEN g - pt <= nt - g THEN pv ELSE nv END, 6) AS near FROM c""")
def q08_resample_zero_fill(spark, sf_dir):
    ev = events(spark, sf_dir)
    views = _views(ev).select("user_id", "t", F.col("value").alias("line"), F.col("value").alias("near"))
    out = asof.interpolated(_grid(ev), views, U, "g", "t", ["line", "near"], {"line": "linear", "near": "nearest"}, "zero", DAY)
    return out.select("user_id", "g", r6("line", "line"), r6("near", "near"))


def _weights(kind, sigma):
    return ", ".join(repr(x) for x in sr.taps(kind, sigma))


@query(f"""WITH {EV}, w AS (SELECT unnest([{_weights('plain', 2.0)}]) AS w, unnest(range(-6, 7)) AS d)
SELECT a.event_id, round(sum(b.value * w.w), 6) AS smooth FROM ev a, w, ev b WHERE b.user_id = a.user_id AND b.k = a.k + w.d GROUP BY a.event_id""")
def q09_gauss_fir(spark, sf_dir):
    return sr.smoothed(series(spark, sf_dir), U, "k", {"smooth": "value"}, 2.0).select("event_id", r6("smooth", "smooth"))


@query(f"""WITH {EV}, x AS (SELECT event_id, user_id, k, CASE WHEN event_type <> 'error' THEN value END AS y, max(k) OVER (PARTITION BY user_id) AS last, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id) AS n FROM ev),
w AS (SELECT unnest([{_weights('even', 3.0)}]) AS w, unnest(range(-12, 13)) AS d),
s AS (SELECT a.event_id, sum(coalesce(b.y, 0) * w.w) AS gy, sum((b.y IS NOT NULL)::INT * w.w) AS gm FROM x a, w, x b WHERE b.user_id = a.user_id AND b.k = least(greatest(a.k + w.d, 0), a.last) GROUP BY a.event_id)
SELECT x.event_id, round(CASE WHEN n < 3 THEN y ELSE y - CASE WHEN gm > 1e-6 THEN gy / gm ELSE 0 END END, 6) AS flat FROM x JOIN s USING (event_id)""")
def q10_detrend_masked(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("y", F.when(kind() != "error", F.col("value")))
    return sr.detrended(rows, U, "k", "y", "flat", 3.0).select("event_id", r6("flat", "flat"))


@query(f"""WITH {EV}, l AS (SELECT event_id, value AS y, lag(value) OVER w AS a, lead(value) OVER w AS b, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT event_id, round(1000 * CASE WHEN hs IS NULL THEN (b - y) / hd WHEN hd IS NULL THEN (y - a) / hs ELSE (hs * hs * b + (hd * hd - hs * hs) * y - hd * hd * a) / (hs * hd * (hd + hs)) END, 4) AS slope FROM l""")
def q11_gradient_nonuniform(spark, sf_dir):
    return sr.gradient(series(spark, sf_dir), U, "k", "value", "slope", "t").select("event_id", F.round(1000 * F.col("slope"), 4).alias("slope"))


@query(f"""WITH {EV}, r AS (SELECT *, sum((event_type = 'click')::INT) OVER w AS c, sum((event_type = 'purchase')::INT) OVER w AS p, CASE WHEN k = 0 THEN 1.0 ELSE t - min(t) OVER (PARTITION BY user_id) END AS el FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT event_id, CAST(c AS BIGINT) AS clicks, CAST(p AS BIGINT) AS purchases, round((c + 1e-5) / (p + 1e-5), 4) AS ratio, round(p / el, 6) AS rate FROM r""")
def q12_cumulative_rate(spark, sf_dir):
    rows = series(spark, sf_dir).withColumns({"click": (kind() == "click").cast("bigint"), "purchase": (kind() == "purchase").cast("bigint"), "dt": F.lit(1.0)})
    out = sr.event_rates(rows, U, "k", "t", "click", "purchase", "dt")
    return out.select("event_id", F.col("click_cum").alias("clicks"), F.col("purchase_cum").alias("purchases"), F.round("ratio", 4).alias("ratio"), r6("rate", "rate"))


@query(f"WITH {EV}, l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY k) AS p FROM ev) SELECT event_id FROM l WHERE value > 50 AND p <= 50")
def q13_rising_edges(spark, sf_dir):
    return sr.rising(series(spark, sf_dir), U, "k", "value", F.lit(50.0), "up").where("up").select("event_id")


@query(f"""WITH {EV}, f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY k)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS run FROM f)
SELECT user_id, event_type, CAST(run AS BIGINT) AS run, min(k) AS first, max(k) AS last, count(*) AS length FROM r GROUP BY ALL""")
def q14_runs(spark, sf_dir):
    return sr.runs(series(spark, sf_dir), U, "k", "event_type").withColumn("run", F.col("run").cast("bigint"))


@query(f"""WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id), p AS (SELECT user_id, k FROM ev JOIN n USING (user_id) WHERE event_type = 'purchase' AND k > 3 AND k + 5 < n),
r AS (SELECT unnest(range(-3, 5)) AS rel)
SELECT rel, round(avg(e.value), 6) AS mean, count(*) AS n FROM p, r, ev e WHERE e.user_id = p.user_id AND e.k = p.k + r.rel GROUP BY rel""")
def q15_event_triggered_average(spark, sf_dir):
    rows = series(spark, sf_dir)
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    found = sr.triggered(rows.select("user_id", "k", "value"), rows.where(kind() == "purchase").select("user_id", "k"), U, "k", 3, 5, n)
    return found.groupBy(F.col("rel").cast("bigint").alias("rel")).agg(r6(F.avg("value"), "mean"), F.count("*").alias("n"))


TURN = 2 * math.pi


@query(f"""WITH {EV}, a AS (SELECT *, value / 10 AS x, value / 10 - lag(value / 10) OVER (PARTITION BY user_id ORDER BY k) AS d FROM ev),
m AS (SELECT *, d + {math.pi!r} - {TURN!r} * floor((d + {math.pi!r}) / {TURN!r}) - {math.pi!r} AS m FROM a),
c AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < {math.pi!r} THEN 0 WHEN m = -{math.pi!r} AND d > 0 THEN {math.pi!r} - d ELSE m - d END AS c FROM m)
SELECT event_id, round(x + sum(c) OVER (PARTITION BY user_id ORDER BY k), 6) AS phase, round(abs(atan2(sin(d), cos(d))), 6) AS speed FROM c""")
def q16_unwrap_speed(spark, sf_dir):
    rows = series(spark, sf_dir).withColumns({"x": F.col("value") / 10, "zero": F.lit(0.0)})
    rows = sr.movement(sr.unwrapped(rows, U, "k", "x", "phase"), U, "k", "zero", "zero", "zero", "x")
    return rows.select("event_id", r6("phase", "phase"), r6(F.abs("d_phi"), "speed"))


@query(f"""WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) SELECT event_id, least(k // greatest(n // 5, 1), 4)::INT AS even_fold, least(k // greatest(CAST(ceil(n / 5) AS BIGINT), 1), 4)::INT AS long_fold FROM ev JOIN n USING (user_id)""")
def q23_folds_both_kinds(spark, sf_dir):
    from tracegrid.operators.decoding import fold_of

    rows = series(spark, sf_dir)
    rows = joined(rows, rows.groupBy("user_id").agg(F.count("*").alias("n")), U)
    return rows.select("event_id", fold_of("k", "n", 5, "floor").alias("even_fold"), fold_of("k", "n", 5, "ceil").alias("long_fold"))


@query(f"""WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) SELECT event_id, (k + user_id % n) % n AS moved FROM ev JOIN n USING (user_id)""")
def q41_circshift(spark, sf_dir):
    rows = series(spark, sf_dir)
    rows = joined(rows, rows.groupBy("user_id").agg(F.count("*").alias("n")), U)
    return sr.shifted(rows, U, "k", F.col("user_id") % F.col("n"), "n").select("event_id", F.col("k").alias("moved"))


@query(f"""WITH {EV}, b AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS day, value, event_type FROM ev),
x AS (SELECT user_id, day, avg(value) AS mean FROM b WHERE event_type = 'view' GROUP BY ALL), y AS (SELECT user_id, day, count(*) AS n FROM b WHERE event_type = 'click' GROUP BY ALL)
SELECT user_id, day, round(mean, 6) AS view_mean, n AS click_n FROM x JOIN y USING (user_id, day)""")
def q47_block_combine(spark, sf_dir):
    from tracegrid.operators.blocks import combined

    ev = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("bigint"))
    blocks = {
        "view": ev.where(kind() == "view").groupBy("user_id", "day").agg(r6(F.avg("value"), "mean")),
        "click": ev.where(kind() == "click").groupBy("user_id", "day").agg(F.count("*").alias("n")),
    }
    return combined(blocks, ["view", "click"], ["user_id", "day"])


@query(f"""WITH {EV}, s AS (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY k) AS total, value - first_value(value) OVER (PARTITION BY user_id ORDER BY k) AS rise FROM ev) SELECT event_id, round(total, 6) AS total, round(rise, 6) AS rise FROM s""")
def q51_running_and_rezeroed(spark, sf_dir):
    rows = running(series(spark, sf_dir), U, "k", {"total": F.col("value")})
    return sr.rezeroed(rows, U, "k", "value", "rise").select("event_id", r6("total", "total"), r6("rise", "rise"))


@query(f"""WITH {EV}, n AS (SELECT *, max(k) OVER (PARTITION BY user_id) AS last FROM ev),
m AS (SELECT a.event_id, list_sort(list(b.value)) AS l FROM n a, (SELECT unnest(range(-2, 3)) AS d) w, ev b WHERE b.user_id = a.user_id AND a.last >= 2
AND b.k = CASE WHEN a.k + w.d < 0 THEN -(a.k + w.d) - 1 WHEN a.k + w.d > a.last THEN 2 * a.last - (a.k + w.d) + 1 ELSE a.k + w.d END GROUP BY a.event_id)
SELECT event_id, l[3] AS middle FROM m""")
def q52_median_filter(spark, sf_dir):
    return sr.median_filtered(series(spark, sf_dir), U, "k", "value", "middle", 5).select("event_id", "middle")
