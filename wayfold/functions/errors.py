"""Failures of a remote service: kinds, waits and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the retry policy, and the words of messages by key.
MAX_RETRIES, FIRST_WAIT_MS, WAIT_FACTOR, MAX_WAIT_MS = 2, 2_000, 2, 30_000
RETRYABLE = ["timeout", "rate-limited", "busy", "network-unavailable"]
FAILURE_TITLES = {
    "timeout": "That took too long",
    "rate-limited": "Too many requests",
    "busy": "The map data service is busy",
    "network-unavailable": "No connection",
    "server-error": "The map data service is struggling",
    "request-error": "That search was refused",
    "malformed-response": "That answer made no sense",
}

FAILURE_DETAILS = {
    "timeout": "The map data service did not answer in time. It is free and shared, so it is sometimes busy.",
    "rate-limited": "The map data service has asked us to slow down. Give it a moment before asking again.",
    "busy": "It is free for everyone to use, and right now it has no capacity to spare. Trying again in a moment usually works.",
    "network-unavailable": "Nothing reached the map data service. Check your signal or your Wi-Fi.",
    "server-error": "It answered with an error instead of results, which is usually temporary.",
    "request-error": "The map data service turned the request down, and asking again the same way would not change its mind.",
    "malformed-response": "The map data service replied with something we could not read.",
}


class ServiceError(Exception):
    """A typed failure: kind, and status and Retry-After in milliseconds where known."""

    def __init__(self, kind: str, message: str = "", status: int | None = None, retry_after_ms: float | None = None):
        super().__init__(message or kind)
        self.kind, self.status, self.retry_after_ms = kind, status, retry_after_ms

    @property
    def retryable(self) -> bool:
        return self.kind in RETRYABLE or self.kind == "http-error" and (self.status or 0) >= 500


def kind_of_status(status: Column) -> Column:
    """Null for success."""
    return F.when(status.between(200, 299), F.lit(None).cast("string")).when(status == 429, "rate-limited").when(status == 504, "busy").otherwise("http-error")


def kind_of_remark(remark: Column) -> Column:
    """A remark means a partial answer, which is refused; null without one."""
    return F.when(F.coalesce(remark, F.lit("")) == "", F.lit(None).cast("string")).when(F.lower(remark).contains("timed out"), "timeout").otherwise("malformed-response")


def retryable(kind: Column, status: Column) -> Column:
    return kind.isin(*RETRYABLE) | ((kind == "http-error") & (F.coalesce(status, F.lit(0)) >= 500))


def failure_key(kind: Column, status: Column) -> Column:
    return F.when(kind != "http-error", kind).when(F.coalesce(status, F.lit(0)) >= 500, "server-error").otherwise("request-error")


def _said(key: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, text in texts.items():
        out = F.when(key == k, text).otherwise(out)
    return out


def failure_title(key: Column) -> Column:
    return _said(key, FAILURE_TITLES)


def failure_detail(key: Column) -> Column:
    """What stands below the title."""
    return _said(key, FAILURE_DETAILS)


def retry_after_ms(header: Column, now: Column) -> Column:
    """Whole seconds, or the time until an HTTP date (never negative); null if neither."""
    text = F.trim(header)
    at = F.try_to_timestamp(F.regexp_extract(text, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("double") * 1000).when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_millis(at) - F.unix_millis(now)).cast("double")))


def wait_before_retry_ms(kind: Column, retries: Column, after_ms: Column) -> Column:
    """Null: give up. Only throttling is retried, twice at most, and never beyond 30 s."""
    wait = F.coalesce(after_ms, F.lit(float(FIRST_WAIT_MS)) * F.pow(F.lit(float(WAIT_FACTOR)), retries))
    return F.when(kind.isin("rate-limited", "busy") & (retries < MAX_RETRIES) & (wait <= MAX_WAIT_MS), wait)


def is_gone(status: Column) -> Column:
    return status.isin(404, 410)
