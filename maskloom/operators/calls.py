"""Outcomes of calls: error kinds and bodies, results, degraded retries, access decisions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, HTTP status, error type, error code.
ERRORS = [
    ("Auth", 401, "authentication_error", "invalid_api_key"),
    ("Forbidden", 403, "permission_error", "permission_denied"),
    ("BadRequest", 400, "invalid_request_error", "invalid_request_error"),
    ("PayloadTooLarge", 413, "invalid_request_error", "request_too_large"),
    ("NotFound", 404, "invalid_request_error", "not_found"),
    ("RateLimited", 429, "rate_limit_error", "rate_limit_exceeded"),
    ("Upstream", 502, "server_error", "upstream_error"),
    ("UpstreamTimeout", 504, "server_error", "upstream_timeout"),
    ("Internal", 500, "server_error", "internal_error"),
]
# What an upstream says when it has no response_format, and the messages of its failures.
NO_RESPONSE_FORMAT = "response_format type is unavailable"
BAD_JSON, BAD_STATUS = "the provider's answer is no JSON", "the provider answered with an error"
DETAIL = 512


def error_fields(kind: Column) -> tuple[Column, Column, Column]:
    """(HTTP status, type, code) of an error kind; null of an unknown one."""

    def field(at: int) -> Column:
        return F.coalesce(*[F.when(kind == e[0], F.lit(e[at])) for e in ERRORS])

    return field(1), field(2), field(3)


def error_body(kind: Column, message: Column) -> Column:
    """The JSON body a client gets; details stay in the log."""
    _, type_, code = error_fields(kind)
    return F.to_json(F.struct(F.struct(message.alias("message"), type_.alias("type"), code.alias("code")).alias("error")))


def log_detail(text: Column, longest: int = DETAIL) -> Column:
    """The first ``longest`` characters."""
    return F.left(text, F.lit(longest))


def failure_kind(timed_out: Column) -> Column:
    """The kind of a call that got no answer: UpstreamTimeout after a time-out, else Upstream."""
    return F.when(F.coalesce(timed_out, F.lit(False)), "UpstreamTimeout").otherwise("Upstream")


def request_id(*key: Column) -> Column:
    """Eight of a-z and 0-9 from a hash of a row's key: the same when a task runs again."""
    h = F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in key]), 256)
    letters = F.lit("abcdefghijklmnopqrstuvwxyz0123456789")
    one = lambda i: F.substr(letters, (F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % 36 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), one), "")


def result(status: Column, body: Column) -> tuple[Column, Column]:
    """(body if it is JSON of a success, message of the failure otherwise)."""
    good = status.between(200, 299)
    json = F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))
    return F.when(good & json, body), F.when(~good, BAD_STATUS).when(~json, BAD_JSON)


def degradable(status: Column, request: Column, answer: Column) -> Column:
    """A 400 that names response_format as unavailable, for a request that has the field."""
    has = F.array_contains(F.json_object_keys(request), "response_format")
    return F.coalesce((status == 400) & has & answer.contains(NO_RESPONSE_FORMAT), F.lit(False))


def without_field(request: Column, name: str = "response_format") -> Column:
    """A JSON object without one of its top-level fields; the others keep their values."""
    parts = F.from_json(request, "map<string,variant>")
    return F.to_json(F.map_filter(parts, lambda k, _: k != name))


def access(token: Column, verified: Column | None = None, expected: str | None = None) -> Column:
    """A verifier's decision if there is one (none reached: refused), else equality with the expected token, else yes."""
    if verified is not None:
        return F.coalesce(verified, F.lit(False))
    return F.coalesce(token == expected, F.lit(False)) if expected is not None else F.lit(True)


def metrics(calls: DataFrame, auth_failed: Column, upstream_failed: Column, unresolved: Column, quasi_flagged: Column, *by: str) -> DataFrame:
    """Counters of requests, refused keys, upstream errors, unresolved sentinels and quasi-identifier flags."""
    total = F.coalesce(F.sum(unresolved), F.lit(0)).cast("long")
    return calls.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(auth_failed).alias("auth_failures"), F.count_if(upstream_failed).alias("upstream_errors"),
        total.alias("unresolved"), F.count_if(quasi_flagged).alias("quasi_flags"),
    )
