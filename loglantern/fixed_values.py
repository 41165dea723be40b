"""Texts, names and limits that results must carry exactly.

Nothing here is logic. Each value appears in output rows, so it is spelled out
as it is expected there.
"""

# Accepted JSON names per log field, in order of precedence.
TS_NAMES = ("ts", "timestamp")
SERVICE_NAMES = ("service", "app", "serviceName", "service_name")
LEVEL_NAMES = ("level", "severity")
MESSAGE_NAMES = ("message", "msg")
LATENCY_NAMES = ("latencyMs", "latency", "latency_ms", "responseTimeMs")
STACKTRACE_NAMES = (
    "stacktrace",
    "stackTrace",
    "stack_trace",
    "trace",
    "exception",
    "exceptionStackTrace",
    "exception_stack_trace",
    "traceback",
)
DEFAULT_SERVICE = "unknown"
DEFAULT_LEVEL = "INFO"

# Patterns read from the message text.
IP_PATTERN = r"\bip=([^\s]+)"
ENDPOINT_PATTERN = r"\b(GET|POST|PUT|DELETE|PATCH)\s+([^\s]+)"
TOKEN_SPLIT_PATTERN = "[^a-z0-9._/-]+"

# Rule-based review, words searched in the lower-cased message.
ERROR_WORDS = ("exception", " 500 ")
AUTH_WORDS = ("failed login", "bruteforce")
LATENCY_WORDS = ("slow", "latenc")
RESOURCE_WORDS = ("heap", "gc", "oom", "memory")
TEXT_WORDS = ("error", "exception", "failed login", "bruteforce")
AUTH_SERVICE = "auth"
SLOW_LATENCY_MS = 1500
CATEGORY_SCORES = {
    "normal": 0.08,
    "latency": 0.72,
    "resource": 0.76,
    "security": 0.82,
    "error_spike": 0.85,
}
TEXT_ANOMALY_SCORE = 0.7
TEXT_NORMAL_SCORE = 0.1
ALERT_THRESHOLD = 0.6
NEW_STATUS = "NEW"

# Explanations of the rule-based review.
NOTE_NO_REVIEWER = "No reviewer configured; rule-based review used."
NOTE_BAD_REPLY = "Rule-based review used (reply not readable)."
NOTE_FAILED_CALL = "Rule-based review used (reviewer call failed)."
NOTE_TEXT_SUFFIX = " (json-parse-fallback)"

# Defaults of a log reply.
LOG_REPLY_CATEGORY = "other"
LOG_REPLY_EXPLANATION = "No explanation"

# Window reviews used when there is no usable reply.
WINDOW_NO_REVIEWER_SUMMARY = "No reviewer configured; the window was not judged."
WINDOW_NO_REVIEWER_ACTIONS = ("Configure a reviewer to have windows judged.",)
WINDOW_BAD_REPLY_SUMMARY = "Model response didn't include valid JSON; using fallback."
WINDOW_FAILED_CALL_SUMMARY = "Reviewer call failed; the window was not judged."

# Window review used when the analysis itself failed.
WINDOW_FAILED_JOB_SUMMARY = "Window analysis failed; counts only."
WINDOW_FAILED_JOB_SIGNALS = ("Reviewer did not answer in time or failed",)
WINDOW_FAILED_JOB_ACTIONS = (
    "Try again",
    "Reduce sample size / increase timeout",
    "Check the reviewer's rate limits",
)

# Answers used when there is no usable reply.
ANSWER_NO_REVIEWER = "No reviewer configured."
ANSWER_NO_REVIEWER_CAUTION = "Nobody was asked: no reviewer is configured."
ANSWER_BLANK = "No answer."
ANSWER_FAILED_CALL = "AI request failed."
ANSWER_FAILED_CALL_CAUTION = "Exception during model call."
ANSWER_NOT_JSON = "Model response didn't include valid JSON; using fallback."
ANSWER_NOT_JSON_CAUTION = "Model output was not strict JSON."

# Incident drafts used when there is no usable reply.
DRAFT_TITLE = "Incident report fallback"
DRAFT_REPLY_TITLE = "Incident report"
DRAFT_NO_REVIEWER_IMPACT = "No reviewer configured."
DRAFT_NO_REVIEWER_TIMELINE = ("Window anomaly detected",)
DRAFT_NO_REVIEWER_EVIDENCE = ("No reviewer configured",)
DRAFT_NO_REVIEWER_ACTIONS = ("Configure a reviewer",)
DRAFT_BAD_REPLY_IMPACT = "Model output was not valid JSON."
DRAFT_BAD_REPLY_ACTIONS = ("Retry with smaller context",)
DRAFT_FAILED_CALL_IMPACT = "AI request failed."
DRAFT_FAILED_CALL_EVIDENCE = ("Exception during model call",)
DRAFT_FAILED_CALL_ACTIONS = ("Retry request",)
DEFAULT_TIMELINE_FIRST = "Window anomaly detected"

# Window lengths and list sizes.
SHORT_WINDOW_SEC = 5
LONG_WINDOW_SEC = 30
METRIC_SLIDE_SEC = 5
ANALYSIS_WINDOW_SEC = 30
ANALYSIS_SLIDE_SEC = 10
LAST_IPS = 5
TOP_SERVICES = 3
SAMPLE_LOGS = 10
REPORT_ALERTS = 10
CONTEXT_ALERTS = 8
EVIDENCE_ALERTS = 3
REPORT_SIMILAR = 3
SIMILAR_LIMIT = 5
FEED_LOGS = 500
FEED_ALERTS = 200
FEED_SUMMARIES = 60
EMBEDDING_DIMS = 64

# Root-cause graph.
GRAPH_TITLE = "Root cause hypothesis"
GRAPH_EMPTY_TITLE = "No active incident"
GRAPH_EMPTY_LABEL = "No anomaly summary available"
GRAPH_EMPTY_HYPOTHESIS = "Generate anomaly summaries first."
GRAPH_EMPTY_CONFIDENCE = 0.2
HYPOTHESES = {
    "latency": "Latency likely originated in a slow downstream dependency, overloaded database, or expensive query path.",
    "security": "Repeated authentication failures point to burst login abuse or credential stuffing from a small set of sources.",
    "resource": "Resource saturation signals suggest heap pressure, GC contention, or worker exhaustion.",
    "error_spike": "A deployment regression, dependency outage, or application bug likely triggered the error spike.",
}
HYPOTHESIS_OTHER = "Correlated stream, trace, and alert signals indicate an operational anomaly that needs triage."
GRAPH_ALERTS = 20
GRAPH_SPANS = 20
GRAPH_METRICS = 20
GRAPH_REPORTS = 5
GRAPH_SHOWN = 6
GRAPH_SIGNALS = 5

# Lines of a question context.
ASK_HEADER = ("You are an SRE assistant.", "Answer briefly and practically.")
ASK_OVERVIEW_LABELS = ("Question: ", "Latest summary: ", "Recent alerts: ", "Recent logs: ")
ASK_LOG_LABELS = ("Question: ", "Target log: ", "Related summary: ", "Related alerts: ")
