"""Edge cases and skewed inputs of the window, join, incident and graph operators."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loglantern import schemas
from loglantern.operators import asof, dashboard, feed, incidents, metrics, panes, related, similarity, summaries, throttle
from loglantern.operators.throttle import throttle_notifications
from loglantern.plans import jobs
from loglantern.sources import kafka, tables

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(sec):
    return T0 + timedelta(seconds=sec)


def logs(spark, rows):
    """rows: (ord, second, service, level, message, latency)"""
    data = [(o, at(s), at(s).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), svc, lvl, msg, lat, None) for o, s, svc, lvl, msg, lat in rows]
    return spark.createDataFrame(data, schemas.LOG)


def alerts(spark, rows):
    """rows: (ord, second, service)"""
    return spark.createDataFrame(
        [(o, at(s), str(s), svc, "latency", 0.7, "WARN", f"m{o}", "", "NEW") for o, s, svc in rows], schemas.ALERT
    )


def test_metrics_without_latency_and_with_many_ips(spark):
    rows = [(i, i * 0.1, "a", "warn", f"x ip=10.0.0.{i % 4} GET /p{i}", None) for i in range(10)]
    rows.append((10, 0.05, "a", "Error", "late by time, last by arrival", -5))
    (r,) = metrics.service_window_metrics(logs(spark, rows), 5, 5, 5).collect()
    assert (r["total_count"], r["error_count"], r["warn_count"]) == (11, 1, 10)
    assert (r["avg_latency_ms"], r["max_latency_ms"]) == (-5.0, 0)
    assert r["ts"].endswith("00.050000Z") and r["endpoint_hint"] == "/p9"
    # Last five occurrences are .1 .2 .3 .0 .1; the repeat is dropped.
    assert r["failed_ips"] == ["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.0"]


def test_folded_panes_against_a_plain_fold(spark):
    """Many small batches; a hot pane, null services, levels and latencies, arrivals out of order."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        sec = rng.choice([1, 2, rng.randrange(60)])
        message = rng.choice(["plain", f"GET /p{i % 7} 200", f"x ip=10.0.0.{i % 9}", f"POST /q{i % 3} ip=10.0.1.{i % 5}"])
        level = rng.choice(["ERROR", "error", "WARN", "INFO", None])
        rows.append((i * 37 % 400, sec, rng.choice(["a", "a", "b", None]), level, message, rng.choice([None, i - 200])))
    df = logs(spark, rows).withColumn("pane_start", panes.pane_start(F.col("event_ts"), 10))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = panes.metric_panes(df.repartition(3), 10)
        folded = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = {}
    for o, s, svc, lvl, msg, lat in rows:
        plain.setdefault((s // 10 * 10, svc), []).append((o, lvl, msg, lat, at(s).strftime("%Y-%m-%dT%H:%M:%S.%fZ")))
    found = {((r["pane_start"].replace(tzinfo=timezone.utc) if r["pane_start"].tzinfo is None else r["pane_start"]) - T0, r["service"]): r for r in folded}
    assert {(k[0].total_seconds(), k[1]) for k in found} == set(plain)
    for (start, svc), r in found.items():
        own = sorted(plain[start.total_seconds(), svc])
        known = [lat for _, _, _, lat, _ in own if lat is not None]
        assert (r["total"], r["first_ord"], tuple(r["last"])) == (len(own), own[0][0], (own[-1][0], own[-1][4]))
        assert (r["errors"], r["warns"]) == tuple(sum((x[1] or "").upper() == name for x in own) for name in ("ERROR", "WARN"))
        assert (r["latency_count"], r["latency_sum"] or 0, r["latency_max"]) == (len(known), sum(known), max(known, default=None))
        paths = [(o, m.split()[1]) for o, _, m, *_ in own if m.startswith(("GET", "POST"))]
        assert r["last_endpoint"] == (paths[-1] if paths else None)
        ips = [(o, m.split("ip=")[1]) for o, _, m, *_ in own if "ip=" in m]
        assert [tuple(x) for x in r["ips"]] == ips[::-1][:5]
    counts, tails = panes.counts_and_tails(df.repartition(3), 10, 4)
    assert sorted((r["total"], r["first_ord"]) for r in counts.collect()) == sorted((r["total"], r["first_ord"]) for r in found.values())
    by_pane: dict = {}
    for o, s, *_ in rows:
        by_pane.setdefault(s // 10, []).append(o)
    assert sorted(r["ord"] for r in tails.collect()) == sorted(o for os_ in by_pane.values() for o in sorted(os_)[-4:])


def test_null_latency_metric(spark):
    (r,) = metrics.service_window_metrics(logs(spark, [(1, 0, "a", "INFO", "m", None)]), 5, 5, 5).collect()
    assert (r["avg_latency_ms"], r["max_latency_ms"], r["endpoint_hint"], r["failed_ips"]) == (0.0, 0, None, [])


def test_window_bounds_are_half_open(spark):
    df = logs(spark, [(1, 0, "a", "INFO", "m", 1), (2, 5, "a", "INFO", "m", 1), (3, 4.999, "a", "INFO", "m", 1)])
    got = {(r["window_start"].second, r["window_sec"]): r["total_count"] for r in metrics.service_window_metrics(df, 5, 10, 5).collect()}
    assert got[(0, 5)] == 2 and got[(5, 5)] == 1 and got[(0, 10)] == 3


def test_rows_without_time_are_in_no_window(spark):
    df = logs(spark, [(1, 0, "a", "INFO", "m", 1)]).withColumn("event_ts", F.lit(None).cast("timestamp"))
    assert metrics.service_window_metrics(df).count() == 0 and summaries.window_aggregates(df).count() == 0


def test_top_three_ties_go_to_the_first_seen(spark):
    df = logs(spark, [(i, i, s, "INFO", "m", 1) for i, s in enumerate("dcba")])
    (r,) = summaries.window_aggregates(df, 30, 30).collect()
    assert r["services_top"] == ["d(1)", "c(1)", "b(1)"]


def test_sample_is_the_last_ten_in_order(spark):
    df = logs(spark, [(i, i, "a", "INFO", f"m{i}", 1) for i in range(25)])
    (r,) = summaries.window_payloads(df, 30, 30).collect()
    assert [x["message"] for x in r["sample_logs"]] == [f"m{i}" for i in range(15, 25)]


def test_near_alerts_is_strict_on_both_sides(spark):
    df = logs(spark, [(1, 100, "a", "INFO", "m", 1), (2, 100.001, "a", "INFO", "m", 1), (3, 220, "a", "INFO", "m", 1), (4, 219.999, "a", "INFO", "m", 1), (5, 160, "b", "INFO", "m", 1)])
    assert {r["ord"] for r in related.near_alerts(df, alerts(spark, [(1, 160, "a")])).collect()} == {2, 4}


def test_near_alerts_against_brute_force_with_a_hot_service(spark):
    rng = random.Random(3)
    service = lambda: "hot" if rng.random() < 0.5 else rng.choice("abc")
    ls = [(i, rng.randrange(20000) / 7, service(), "INFO", "m", 1) for i in range(1500)]
    al = [(i, rng.randrange(20000) / 7, service()) for i in range(60)]
    # The operator works on whole milliseconds of the stored (microsecond) times.
    ms = lambda s: int((at(s) - T0) / timedelta(milliseconds=1))
    want = {o for o, s, svc, *_ in ls if any(svc == v and abs(ms(s) - ms(t)) < 60000 for _, t, v in al)}
    assert {r["ord"] for r in related.near_alerts(logs(spark, ls), alerts(spark, al)).collect()} == want


def _seen(events, key, t, n):
    """Brute force: ord of the last ``n`` events of ``key`` at or before second ``t``, newest first."""
    return [o for _, o in sorted(((s, o) for o, s, k in events if k == key and s <= t), reverse=True)[:n]]


@pytest.mark.parametrize("ranges,fan_out", [(1, 256), (3, 256), (11, 2), (40, 3)])
def test_as_of_against_brute_force(spark, monkeypatch, ranges, fan_out):
    """Two sources; half of all events at one moment of one scope; ticks off any grid, repeated, null; several levels of ranges."""
    monkeypatch.setattr(asof, "FAN_OUT", fan_out)
    rng = random.Random(5)
    ev = [(i, 400 if rng.random() < 0.5 else rng.randrange(0, 30000) / 10, rng.choice("ab")) for i in range(400)]
    few = [(i, rng.randrange(0, 3000), rng.choice("abd")) for i in range(9)]
    ticks = [(k, at(t), i) for i, k in enumerate(["a", "b", "c", "d", "a", None]) for t in (-30, 0, 3.3, 9, 12.7, 399.9, 400, 400.1, 1200, 2999, 3000, 9000)]
    ticks += [("a", at(rng.randrange(0, 30000) / 10), 7) for _ in range(200)] + [("a", None, 8)]
    df = spark.createDataFrame(ticks, "service string, tick timestamp, k int")
    nothing = alerts(spark, [(1, 1, "a")]).withColumn("event_ts", F.lit(None).cast("timestamp"))
    sources = {
        "many": asof.Source(alerts(spark, ev).unionByName(nothing), 4, ["ord"]),
        "few": asof.Source(alerts(spark, few), 2, ["ord", "message"]),
        "none": asof.Source(alerts(spark, []), 3, ["ord"]),
    }
    got = asof.as_of_merge(df, sources, keys=["service"], ranges=ranges).collect()
    assert len(got) == len(ticks)
    for r in got:
        t = None if r["tick"] is None else (r["tick"] if r["tick"].tzinfo else r["tick"].replace(tzinfo=timezone.utc)) - T0
        sec = -1e9 if t is None else t.total_seconds()
        assert [x["ord"] for x in r["many"]] == _seen(ev, r["service"], sec, 4), r
        assert [(x["ord"], x["message"]) for x in r["few"]] == [(o, f"m{o}") for o in _seen(few, r["service"], sec, 2)]
        assert r["none"] == []


def test_as_of_orders_kafka_arrivals(spark):
    """Equal times are settled by (timestamp, partition, offset), as numbers."""
    rows = [(at(1), (at(5), 0, 9), "x"), (at(1), (at(5), 0, 10), "y"), (at(1), (at(4), 7, 99), "z")]
    ev = spark.createDataFrame(rows, "event_ts timestamp, ord struct<timestamp: timestamp, partition: int, offset: bigint>, name string")
    tick = spark.createDataFrame([(at(2),)], "tick timestamp")
    (r,) = asof.as_of_last(ev, tick, 3, ["name"], "seen").collect()
    assert [x["name"] for x in r["seen"]] == ["y", "x", "z"]


def test_as_of_of_one_burst(spark):
    """One scope and one moment, dealt over ranges by the tie alone; no window anywhere."""
    ev = spark.range(4000).select(F.col("id").alias("ord"), F.timestamp_seconds(F.lit(0)).alias("event_ts"))
    tick = spark.createDataFrame([(at(2),)], "tick timestamp")
    seen = asof.as_of_merge(tick, {"seen": asof.Source(ev, 3, ["ord"])}, ranges=4)
    assert "Window" not in seen._jdf.queryExecution().toString()
    assert [x["ord"] for x in seen.first()["seen"]] == [3999, 3998, 3997]


@pytest.mark.parametrize("salts", [None, 5])
def test_related_alerts_with_a_hot_service(spark, salts):
    """Without broadcasts, no task reads more than twice the median rows of the join."""
    ls = [(i, i, "hot" if i % 8 else "bcd"[i % 3], "INFO", "m", 1) for i in range(4000)]
    al = [(i, i * 7 % 100, s) for i, s in enumerate(["hot", "hot", "b", "c"] * 4)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = related.related_alerts(logs(spark, ls), alerts(spark, al), 3, salts).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(ls)
    for r in got:
        want = [o for _, o in sorted(((s, o) for o, s, k in al if k == r["service"]), reverse=True)[:3]]
        assert [a["ord"] for a in r["related"] or []] == want
    if salts is None:
        tasks = sorted(Counter(r["task"] for r in got).values())
        assert len(tasks) == 4 and tasks[-1] <= 2 * tasks[len(tasks) // 2]


def _nearest_plain(vecs, times, k, earlier):
    def cosine(a, b):
        n = min(len(a or []), len(b or []))
        a, b = np.array(a[:n] if n else [0.0]), np.array(b[:n] if n else [0.0])
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / size), 9) if size else 0.0

    out = {}
    for i, v in enumerate(vecs):
        pool = [j for j in range(len(vecs)) if not earlier or times[j] < times[i]]
        out[i] = sorted(pool, key=lambda j: (-cosine(v, vecs[j]), j))[:k]
    return out


def _nearest_got(spark, vecs, times, k, **options):
    df = spark.createDataFrame([(i, v, at(t)) for i, (v, t) in enumerate(zip(vecs, times))], "id bigint, vec array<double>, at timestamp")
    got: dict = {}
    for r in similarity.nearest(df.withColumnRenamed("id", "query_id"), df, k, **options).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


@pytest.mark.parametrize("earlier", [False, True])
@pytest.mark.parametrize("block_rows", [20, 1000])
def test_nearest_against_brute_force(spark, block_rows, earlier):
    """A third are copies of one vector; zero, null and shorter vectors; ties fall to the smaller id; equal times do not count as earlier."""
    rng = np.random.default_rng(1)
    vecs = [[1.0, 1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=4).tolist() for i in range(80)]
    vecs += [[0.0] * 4, None, [], [0.5, 0.1], [0.0] * 4, None, [-3.0, 1.0], [0.0] * 4]
    times = [i // 4 for i in range(len(vecs))]
    got = _nearest_got(spark, vecs, times, 5, earlier_only=earlier, block_rows=block_rows)
    want = _nearest_plain(vecs, times, 5, earlier)
    assert {i: got.get(i, []) for i in want} == want


def _pairs_sent(monkeypatch):
    """Row pairs that reach a comparison: counted from what each block is sent."""
    sent = []
    compared = similarity._compared

    def counting(q, s, keys, k, earlier_only):
        a, b = (df.groupBy(*keys).count() for df in (q, s))
        total = a.join(b.withColumnRenamed("count", "n"), keys).agg(F.sum(F.col("count") * F.col("n")), F.count("*")).first()
        sent.append((total[0] or 0, total[1]))
        return compared(q, s, keys, k, earlier_only)

    monkeypatch.setattr(similarity, "_compared", counting)
    return sent


def test_nearest_on_clusters_visits_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    vecs = [(centres[i % 20] + rng.normal(size=16) * 0.05).tolist() for i in range(1200)]
    sent = _pairs_sent(monkeypatch)
    got = _nearest_got(spark, vecs, [0] * 1200, 5, block_rows=60)
    # The plain block join compares all 1200 x 1200.
    assert sum(p for p, _ in sent) < 1200 * 1200 / 5
    assert max(n for _, n in sent) > 8
    full = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    scores = np.round(full @ full.T, 9)
    for i in range(1200):
        assert got[i] == sorted(range(1200), key=lambda j: (-scores[i, j], j))[:5]


def test_nearest_earlier_visits_half_of_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vecs = [(centres[i % 6] + rng.normal(size=8) * 0.2).tolist() for i in range(900)]
    sent = _pairs_sent(monkeypatch)
    got = _nearest_got(spark, vecs, list(range(900)), 3, earlier_only=True, block_rows=50)
    assert sum(p for p, _ in sent) <= 900 * 900 / 2
    full = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    scores = np.round(full @ full.T, 9)
    for i in range(900):
        assert got.get(i, []) == sorted(range(i), key=lambda j: (-scores[i, j], j))[:3]


def _summary(spark, rows):
    """rows: (end second, anomaly, category, severity, summary, signals)"""
    data = [(at(e - 30), at(e), 30, 5, 1, 1, ["a(3)", "b(2)"], an, sev, cat, text, sig, ["act"]) for e, an, cat, sev, text, sig in rows]
    return spark.createDataFrame(data, schemas.SUMMARY)


def test_incident_rules(spark):
    s = _summary(spark, [(30, True, "error_spike", "high", "s1", ["x", "x", "y"]), (60, True, "latency", "low", "s2", []), (90, False, "normal", "low", "s3", [])])
    replies = spark.createDataFrame(
        [(at(0), '{"title":" ","evidence":["y","e1","e2","e3","e4","e5","e6","e7"],"recommended_actions":["act","b"]}'), (at(30), "prose")],
        "window_start timestamp, reply string",
    )
    al = alerts(spark, [(i, i, "svc") for i in range(20)])
    got = jobs.build_incidents(s, al, replies).orderBy("event_ts").collect()
    assert len(got) == 2
    first, second = got
    assert first["title"] == "error spike incident" and first["impact"] == "Incident affects a(3), b(2)."
    assert first["evidence"] == ["x", "y", "e1", "e2", "e3", "e4", "e5", "e6", "e7", "svc: m19", "svc: m18", "svc: m17"][: len(first["evidence"])]
    assert len(first["evidence"]) == 12
    assert first["recommended_actions"] == ["act", "b"] and first["similar_incident_ids"] == []
    assert first["timeline"] == ["Window anomaly detected", "Category=error_spike, severity=high"]
    assert second["evidence"] == ["prose", "svc: m19", "svc: m18", "svc: m17"]
    assert second["similar_incident_ids"] == [first["id"]]
    # Everything is reported now: a second run, even of doubled input, adds nothing.
    store = spark.createDataFrame(got, schemas.INCIDENT)
    assert jobs.build_incidents(s.unionByName(s), al, replies, store).count() == 0
    again = jobs.build_incidents(s.unionByName(s), al, replies)
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in got)


def test_similar_to_text(spark):
    s = _summary(spark, [(30, True, "latency", "low", "database is slow", []), (60, True, "security", "low", "login abuse", [])])
    store = jobs.build_incidents(s, alerts(spark, []))
    hits = jobs.similar_to_text(store, "", 5).collect()
    assert [h["score"] for h in hits] == [0.0, 0.0]
    assert jobs.similar_to_text(store, "x", 1).count() == 1


def test_merge_and_bounded_store(spark):
    store = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "id string, title string, version bigint")
    batch = spark.createDataFrame([("a", "new", 3), ("c", "add", 4)], "id string, title string, version bigint")
    merged = {r["id"]: r["title"] for r in incidents.merge_incidents(store, batch).collect()}
    assert merged == {"a": "new", "b": "keep", "c": "add"}
    assert [r["id"] for r in incidents.newest_saved(store.unionByName(batch), 2).collect()] == ["c", "a"]


def test_retried_batch_leaves_one_version(spark, tmp_path):
    s = _summary(spark, [(30, True, "latency", "low", "x", [])])
    one = jobs.build_incidents(s, alerts(spark, []))
    for batch_id in (0, 0, 1):
        tables.write_incidents(one, f"{tmp_path}/i", batch_id)
    assert tables.read_incidents(spark, f"{tmp_path}/i").count() == 1
    assert tables.compact_incidents(spark, f"{tmp_path}/i", fan=2) == 1
    assert tables.read_incidents(spark, f"{tmp_path}/i").collect() == one.collect()


def _graph(spark, n_alerts, durations, request):
    s = _summary(spark, [(30, True, "latency", "high", "s", ["g"] * 7)])
    spans = spark.createDataFrame([(at(i), i, "t", "s", None, f"n{i}", "db", float(d), {}) for i, d in enumerate(durations)], schemas.SPAN)
    m = metrics.service_window_metrics(logs(spark, [(i, i, f"s{i}", "ERROR", "m", 1) for i in range(6)]), 5, 5, 5)
    reports = jobs.build_incidents(s, alerts(spark, []))
    req = spark.createDataFrame([("g", at(request))], "incident_id string, tick timestamp")
    return jobs.root_cause(s, alerts(spark, [(i, i, "a") for i in range(n_alerts)]), spans, m, reports, req)


def test_root_cause_full_graph(spark):
    g = _graph(spark, 9, [100, 5000, 700, 700, 50, 60, 70, 80], 40)
    (h,) = g.headers.collect()
    assert h["confidence"] == pytest.approx(0.95) and h["title"] == "Root cause hypothesis"
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert [nodes[f"trace-{i}"]["label"] for i in range(6)] == ["db:n1", "db:n3", "db:n2", "db:n0", "db:n7", "db:n6"]
    assert nodes["trace-0"]["weight"] == 1.0 and nodes["trace-3"]["weight"] == 0.15
    assert nodes["svc-1"]["weight"] == pytest.approx(0.87) and "sig-5" not in nodes and "alert-6" not in nodes
    assert nodes["report-0"]["type"] == "report" and g.edges.count() == len(nodes) - 1


def test_root_cause_without_summary(spark):
    g = _graph(spark, 3, [10], 20)
    (n,) = g.nodes.collect()
    assert (n["id"], n["type"], n["weight"]) == ("n0", "state", 0.2)
    assert g.headers.first()["confidence"] == 0.2 and g.edges.count() == 0


def test_kpis(spark):
    df = logs(spark, [(i, i, "a", "ERROR" if i < 3 else "error", "m", i + 1) for i in range(20)])
    al = alerts(spark, [(1, 1, "a")])
    r = dashboard.dashboard_kpis(df, al).first()
    assert (r["error_rate"], r["p95_latency_ms"], r["throughput"], r["active_alerts"]) == (15, 19, 1, 1)
    nulls = logs(spark, [(1, 1, "a", "INFO", "m", None)])
    assert dashboard.dashboard_kpis(nulls, al).first()["p95_latency_ms"] == 0
    assert dashboard.dashboard_kpis(df.where("false"), al.where("false")).first().asDict() == {
        "error_rate": 0, "p95_latency_ms": 0, "throughput": 0, "active_alerts": 0,
    }


def test_search(spark):
    df = logs(spark, [(i, i, "a", "INFO" if i % 2 else "info", f"Msg {i}", 1) for i in range(10)])
    assert [r["ord"] for r in dashboard.search_logs(df, level="INFO", recent=4).orderBy("ord").collect()] == [7, 9]
    assert dashboard.search_logs(df, query=" msg 3 ", recent=None).count() == 1


@pytest.mark.parametrize("times,keys,sent", [
    ([0, 500], "AA", [0]), ([0, 300, 600], "ABA", [0, 1, 2]), ([0, 1000], "AA", [0, 1]),
    ([0, 600, 1200, 1800], "AAAA", [0, 2]), ([0, 400, 800, 1200, 1600, 2400], "AAAAAA", [0, 3, 5]),
])
def test_throttle_cases(spark, times, keys, sent):
    rows = [(i, T0 + timedelta(milliseconds=t), k, "x", True) for i, (t, k) in enumerate(zip(times, keys))]
    df = spark.createDataFrame(rows, "i int, at timestamp, category string, severity string, is_anomaly boolean")
    got = throttle_notifications(df, at="at", tie=["i"])
    assert sorted(r["i"] for r in got.collect()) == sent


def _throttled_plain(rows, gap):
    """The sequential rule over (run, ms) rows."""
    last, out = None, []
    for run, ms in rows:
        out.append(last is None or last[0] != run or ms - last[1] >= gap)
        if out[-1]:
            last = run, ms
    return out


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("AAAAAAB"), st.sampled_from([0, 0, 1, 3, 4, 9, 30])), min_size=1, max_size=60),
    st.lists(st.integers(1, 59), max_size=6),
    st.integers(1, 12),
)
def test_ranges_compose_to_the_sequential_rule(steps, cuts, gap):
    """Each range as a function, composed in any grouping, hands on what the plain fold has; rows are decided from the entry alone."""
    rows, ms = [], 0
    for run, step in steps:
        ms += step
        rows.append((run, ms))
    sent = _throttled_plain(rows, gap)
    bounds = sorted({0, len(rows), *[c for c in cuts if c < len(rows)]})
    state, functions = None, []
    for a, b in zip(bounds, bounds[1:]):
        runs, at_ms = [r for r, _ in rows[a:b]], np.array([t for _, t in rows[a:b]])
        starts = np.array([0, *[i for i in range(1, len(runs)) if runs[i] != runs[i - 1]]])
        first = int(np.searchsorted(at_ms[: np.append(starts, len(at_ms))[1]], state[1] + gap)) if state and state[0] == runs[0] else 0
        assert throttle._sent(at_ms, starts, first, gap).tolist() == sent[a:b]
        functions.append(throttle.Function.of(runs[0], runs[-1] if len(starts) > 1 else None, at_ms[starts[-1] :], gap))
        state = functions[-1](state, gap)
        last = max(i for i in range(b) if sent[i])
        assert state == (rows[last][0], rows[last][1])
    whole = functions[0]
    for f in functions[1:]:
        whole = whole.then(f, gap)
    right = functions[-1]
    for f in functions[-2::-1]:
        right = f.then(right, gap)
    entries = [None, ("B", 0), *[("A", -x) for x in range(0, 14)]]
    for entry in entries:
        want = entry
        for f in functions:
            want = f(want, gap)
        assert whole(entry, gap) == right(entry, gap) == want


@pytest.mark.parametrize("ranges,fan_out", [(1, 64), (7, 64), (30, 3)])
def test_throttle_against_the_sequential_rule(spark, monkeypatch, ranges, fan_out):
    """One steady chain over all ranges, a busy scope, equal times, null scopes and times."""
    monkeypatch.setattr(throttle, "FAN_OUT", fan_out)
    rng = random.Random(2)
    rows, ms = [], 0
    for i in range(2000):
        ms += 300 if i < 900 else rng.choice([0, 300, 700, 900, 4000])
        rows.append((i, T0 + timedelta(milliseconds=ms), "A" if i < 900 else rng.choice("AAAAAAB"), "x", True, "s" if i < 1200 else rng.choice(["s", "t", None])))
    rows.append((5000, None, "A", "x", True, "s"))
    rows.append((5001, T0, "A", "x", False, "s"))
    df = spark.createDataFrame(rows, "i int, at timestamp, category string, severity string, is_anomaly boolean, scope string")
    for scope in ([], ["scope"]):
        want = set()
        for name in {r[5] for r in rows} if scope else {None}:
            own = [r for r in rows[:2000] if not scope or r[5] == name]
            decided = _throttled_plain([(r[2], (r[1] - T0) // timedelta(milliseconds=1)) for r in own], 10000)
            want |= {r[0] for r, ok in zip(own, decided) if ok}
        got = throttle_notifications(df, 10000, scope, "at", ["i"], ranges)
        assert sorted(r["i"] for r in got.collect()) == sorted(want)
    assert throttle_notifications(df.limit(0), 10000, ["scope"], "at", ["i"]).count() == 0


def test_feed_snapshot_is_oldest_to_newest(spark):
    import json

    df = logs(spark, [(i, i, "a", "INFO", f"m{i}", 1) for i in range(5)])
    row = feed.feed_snapshot(df, alerts(spark, [(1, 1, "a")]), _summary(spark, []), n_logs=3).first()
    data = json.loads(row["data"])
    assert [x["message"] for x in data["logs"]] == ["m2", "m3", "m4"] and data["summaries"] == [] and len(data["alerts"]) == 1


def test_blank_questions_are_dropped(spark):
    q = spark.createDataFrame([("  ", "log", None), ("why", "log", None)], "question string, mode string, log struct<ts:string,service:string,level:string,message:string,latency_ms:int,stacktrace:string>")
    got = jobs.ask_context(q, logs(spark, []), alerts(spark, []), _summary(spark, [])).collect()
    assert len(got) == 1 and got[0]["prompt"].splitlines()[3:] == ["Target log: null", "Related summary: null", "Related alerts: []"]


def test_kafka_shapes(spark):
    options = kafka.read_options("h:1", kafka.LOG_TOPIC, 10)
    assert options["startingOffsets"] == "earliest" and options["kafka.isolation.level"] == "read_committed"
    day = lambda days, ms=0: T0 + timedelta(days=days, milliseconds=ms)
    rows = [(b"june", 1, 5, day(150)), (b"january", 0, 1000, day(0)), (b"january, later", 0, 1001, day(0, 1)), (b"same time", 1, 4, day(0, 1))]
    frame = spark.createDataFrame([(bytearray(v), *r) for v, *r in rows], "value binary, partition int, offset bigint, timestamp timestamp")
    assert [r["raw"] for r in kafka.raw_lines(frame).orderBy("ord").collect()] == ["january", "january, later", "same time", "june"]
    sent = kafka.log_messages(logs(spark, [(1, 0, "a", "INFO", "m", 1600)])).first()
    assert sent["key"] is None and json.loads(sent["value"])["latencyMs"] == 1600 and "ord" not in json.loads(sent["value"])


def test_blank_nan_and_flags(spark):
    from loglantern.functions.text import blank
    from loglantern.operators import review

    texts = ["", " ", "\n", " \t", "\u2003", "x", " x\n", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(blank(F.col("t"))).collect()
    assert [r[0] for r in got] == [True] * 5 + [False, False, True]
    replies = ['{"is_anomaly":true,"score":"NaN"}', '{"is_anomaly":0.5,"score":0.9}', '{"is_anomaly":true,"score":0.9}', '{"is_anomaly":2,"score":0.9}']
    rows = logs(spark, [(i, 0, "a", "INFO", "m", None) for i in range(4)]).withColumn("raw", F.lit("{}"))
    rows = rows.withColumn("reply", F.element_at(F.array(*map(F.lit, replies)), (F.col("ord") + 1).cast("int")))
    assert [r["ord"] for r in review.to_alerts(review.review_logs(rows)).orderBy("ord").collect()] == [2, 3]


def test_nearest_with_unequal_lengths(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "query_id string, vec array<double>")
    store = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [2.0, 0.0, 5.0]), ("c", None)], "id string, vec array<double>")
    got = {(r["query_id"], r["id"]): round(r["score"], 6) for r in similarity.nearest(queries, store, 3).collect()}
    assert got == {("q", "b"): 1.0, ("q", "a"): 0.707107, ("q", "c"): 0.0, ("r", "a"): 0.0, ("r", "b"): 0.0, ("r", "c"): 0.0}


def test_plans_have_no_cross_join_and_limit_before_the_shuffle(spark, sf):
    from loglantern.checks.queries import QUERIES

    for name in ("service_metrics", "related_alerts", "logs_near_alerts", "latest_alerts", "window_payloads"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name
        if name in ("related_alerts", "window_payloads"):
            assert "Partial" in plan and "WindowGroupLimit" in plan, name
        if name == "service_metrics":
            # One read of the logs, folded by the tasks: neither a second scan nor a sort below the fold.
            below = plan[plan.index("MapInArrow"):]
            assert plan.count("Scan parquet") == 1 and "Sort" not in below and "Window" not in below and "Exchange" not in below
        if name == "latest_alerts":
            assert "TakeOrderedAndProject" in plan
