"""Hand-made edge cases of the parsing, review and text rules."""

import json

import pytest
from pyspark.sql import functions as F

from loglantern import fixed_values as V
from loglantern.functions import log_fields as L, replies as R, text as X, vectors as VEC
from loglantern.functions.embedding import embed, embed_texts
from loglantern.functions.net import normalize_ip
from loglantern.operators import review
from loglantern.plans import jobs

def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


def column(spark, values, build, kind="string"):
    """Results of ``build(col)`` for each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def parsed(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "ord bigint, raw string")
    return jobs.reviewed_logs(df, ingest_ts=now()).orderBy("ord").collect()


BASE = {"ts": "2024-01-01T00:00:00Z", "service": "api", "level": "error", "message": "m"}


def line(**changes):
    return json.dumps({k: v for k, v in (BASE | changes).items() if v is not ...})


PARSE_CASES = [
    # raw, tier, service, level, message (None: the raw line), latency
    ("[1,2]", 2, "unknown", "INFO", None, None),
    ("123", 2, "unknown", "INFO", None, None),
    ('"s"', 2, "unknown", "INFO", None, None),
    ("", 2, "unknown", "INFO", None, None),
    ("not json", 3, "unknown", "INFO", None, None),
    ('{"ts":"x","serv', 3, "unknown", "INFO", None, None),
    ("{'ts':'x'}", 3, "unknown", "INFO", None, None),
    (line(), 1, "api", "error", "m", None),
    (line(ts=None), 2, "api", "ERROR", "m", None),
    (line(service=..., app="a"), 1, "a", "error", "m", None),
    (line(service=..., serviceName="n", service_name="o"), 1, "n", "error", "m", None),
    (line(message=...), 2, "api", "ERROR", None, None),
    (line(message="[worker] started"), 1, "api", "error", "[worker] started", None),
    (line(message="{x}"), 1, "api", "error", "{x}", None),
    (line(message=["a"]), 2, "api", "ERROR", "", None),
    (line(message={"a": 1}), 2, "api", "ERROR", "", None),
    (line(message=5), 1, "api", "error", "5", None),
    (line(latencyMs=12), 1, "api", "error", "m", 12),
    (line(latencyMs=12.7), 1, "api", "error", "m", 12),
    (line(latency="15"), 1, "api", "error", "m", 15),
    (line(latency="12.7"), 2, "api", "ERROR", "m", 12),
    (line(latency="abc"), 2, "api", "ERROR", "m", 0),
    (line(latency_ms=None, responseTimeMs=7), 1, "api", "error", "m", 7),
    (line(latencyMs=""), 1, "api", "error", "m", None),
    (line() + " trailing", 1, "api", "error", "m", None),
]


def test_parse_cases(spark):
    for case, row in zip(PARSE_CASES, parsed(spark, [c[0] for c in PARSE_CASES])):
        raw, tier, service, level, message, latency = case
        got = (row["parse_tier"], row["service"], row["level"], row["message"], row["latency_ms"])
        assert got == (tier, service, level, raw if message is None else message, latency), raw


def test_missing_time_is_the_ingest_time(spark):
    rows = parsed(spark, ["x", line(ts=...), line(timestamp="2024-02-02T00:00:00Z", ts=...)])
    assert [r["ts"] for r in rows] == ["2030-01-01T00:00:00.000000Z"] * 2 + ["2024-02-02T00:00:00Z"]


@pytest.mark.parametrize("name", V.STACKTRACE_NAMES)
def test_stacktrace_names(spark, name):
    assert parsed(spark, [line(**{name: "at X"})])[0]["stacktrace"] == "at X"


def test_instants(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123456789Z", "2024-01-01T01:00:00+01:00", "2024-01-01", "1700", "2024-01-01 00:00:00", "x", None]
    got = column(spark, texts, lambda c: F.date_format(L.instant(c), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert got == ["2024-01-01 00:00:00.000000", "2024-01-01 00:00:00.123456", "2024-01-01 00:00:00.000000"] + [None] * 5


def test_addresses(spark):
    cases = {
        "203.0.113.9": "203.0.113.9", " 10.0.0.1 ": "10.0.0.1", "203.0.113.9,": None, "010.1.1.1": "10.1.1.1", "127.1": "127.0.0.1",
        "1.2.3.999": None, "::1": "0:0:0:0:0:0:0:1", "[2001:DB8::1]": "2001:db8:0:0:0:0:0:1", "::ffff:1.2.3.4": "1.2.3.4",
        "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8", "1:2:3": None, "1::2::3": None, "host": None, "": None,
    }
    assert column(spark, list(cases), normalize_ip) == list(cases.values())


REVIEW_CASES = [
    # raw, category, score; the scenarios first
    (line(level="INFO", message="GET /status/ready 204", latencyMs=20), "normal", 0.08),
    (line(level="ERROR", message="POST /cart 500 IllegalStateException", latencyMs=300), "error_spike", 0.85),
    (line(service="auth", level="WARN", message="gateway: failed login, account locked ip=198.51.100.7"), "security", 0.82),
    (line(service="db", level="WARN", message="slow query on table stock", latencyMs=900), "latency", 0.72),
    (line(service="worker", level="WARN", message="JVM heap at 80 percent after gc"), "resource", 0.76),
    (line(level="INFO", message="tick 1"), "normal", 0.08),
    (line(level="INFO", message="a 500 b"), "error_spike", 0.85),
    (line(level="INFO", message="ends with 500"), "normal", 0.08),
    (line(level="INFO", message="a room"), "resource", 0.76),
    (line(level="INFO", message="slow failed login"), "security", 0.82),
    (line(level="INFO", latencyMs=1499), "normal", 0.08),
    (line(level="INFO", latencyMs=1500), "latency", 0.72),
    (line(level="INFO", message=..., msg="slow"), "normal", 0.08),
    ("[1]", "normal", 0.08),
    ("", "normal", 0.08),
    ("an ERROR here", "other", 0.7),
    ("all fine", "normal", 0.1),
]


def test_review_cases(spark):
    for (raw, category, score), row in zip(REVIEW_CASES, parsed(spark, [c[0] for c in REVIEW_CASES])):
        r = row["review"]
        assert (r["category"], r["score"], r["is_anomaly"]) == (category, score, category != "normal"), raw
        suffix = V.NOTE_TEXT_SUFFIX if row["parse_tier"] == 3 else ""
        assert r["explanation"] == V.NOTE_NO_REVIEWER + suffix


def test_reviewer_sources(spark):
    """A reply, an unreadable reply and a failing call, per row."""

    def reviewer(lines):
        if any("bad call" in x for x in lines):
            raise ValueError("down")
        return ["no json" if "prose" in x else 'x {"is_anomaly":true,"score":0.6,"category":"other"} y' for x in lines]

    df = spark.createDataFrame([(1, line()), (2, line(message="prose")), (3, line(message="bad call"))], "ord bigint, raw string")
    rows = {r["ord"]: r["review"] for r in jobs.reviewed_logs(df, reviewer=reviewer).collect()}
    assert (rows[1]["category"], rows[1]["score"], rows[1]["explanation"]) == ("other", 0.6, "No explanation")
    assert rows[2]["explanation"] == V.NOTE_BAD_REPLY and rows[3]["explanation"] == V.NOTE_FAILED_CALL
    assert {r["ord"] for r in jobs.detect_alerts(df, reviewer=reviewer).collect()} == {1, 2, 3}


def test_parsed_review_option(spark):
    df = spark.createDataFrame([(1, line(message=..., msg="slow"))], "ord bigint, raw string")
    assert jobs.reviewed_logs(df, use_parsed=True).first()["review"]["category"] == "latency"


def test_object_in_text(spark):
    texts = ["none", "} {", "a {\"x\":1} b", "{\"a\":{\"b\":1}}", "{\n\"a\":1}"]
    assert column(spark, texts, R.json_object_in) == [None, None, '{"x":1}', '{"a":{"b":1}}', '{\n"a":1}']


def test_window_reply_defaults(spark):
    texts = ['{"is_anomaly":true}', '{"top_signals":["a",1,null],"recommended_actions":"x","summary":null}', '{"a":', "no"]
    a, b, c, d = column(spark, texts, R.window_reply)
    assert a.asDict() == dict(is_anomaly=True, severity="low", category="other", summary="", top_signals=[], recommended_actions=[])
    assert b["top_signals"] == ["a", "1", "null"] and b["recommended_actions"] == [] and b["summary"] == ""
    assert c is None and d is None


def test_two_objects_read_as_the_first(spark):
    (r,) = column(spark, ['{"category":"security"} and {"category":"latency"}'], R.log_reply)
    assert r["category"] == "security"


def test_draft_and_agent_fallbacks(spark):
    df = spark.createDataFrame([(1, None, False), (2, None, True), (3, "x" * 1000, False), (4, '{"title":"t"}', False)], "i int, reply string, reply_failed boolean")
    d = {r["i"]: r for r in review.structured_answers(review.answer_questions(review.draft_incidents(df))).collect()}
    assert d[1]["draft"]["impact"] == V.DRAFT_NO_REVIEWER_IMPACT and d[2]["draft"]["impact"] == V.DRAFT_FAILED_CALL_IMPACT
    assert d[3]["draft"]["evidence"] == ["x" * 1000] and d[4]["draft"]["title"] == "t"
    assert d[3]["agent"]["answer"] == "x" * 1000 and d[2]["answer"] == V.ANSWER_FAILED_CALL
    cut = review.structured_answers(review.draft_incidents(df, preview=200), preview=900).where("i = 3").first()
    assert cut["draft"]["evidence"] == ["x" * 200] and cut["agent"]["answer"] == "x" * 900


def test_envelope(spark):
    texts = ['{"choices":[{"message":{"content":"hi"}}]}', '{"choices":[]}', "{}", "oops"]
    assert column(spark, texts, R.envelope_content) == ["hi", "", "", None]


def _brute_embedding(text, dims=64):
    import math
    import re

    v = [0.0] * dims
    for i, t in enumerate([t for t in re.split("[^a-z0-9._/-]+", text.lower()) if t]):
        h = 0
        for c in t:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        v[((h ^ (31 * i)) & 0x7FFFFFFF) % dims] += 1 + min(len(t), 16) / 24
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def test_embedding_against_brute_force(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["", "!!", "é ü", None, "A_b-c/d.e"]
    got = column(spark, texts, embed)
    for text, v in zip(texts, got):
        assert max(abs(a - b) for a, b in zip(v, _brute_embedding(text or ""))) < 1e-12
    assert embed_texts([], 64).shape == (0, 64)


def test_vector_rules(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 9.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(VEC.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] == 0.0
    assert df.select(VEC.l2_normalize(F.col("a"))).collect()[1][0] == [0.0, 0.0]


def test_display_rules(spark):
    assert column(spark, ["abc", "abcd"], lambda c: X.truncate(c, 3)) == ["abc", "abc…"]
    assert column(spark, [0.5, 1.49, 2.5], X.round_half_up, "double") == [1, 1, 3]
