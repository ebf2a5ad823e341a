"""Expressions on log events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels from low to high.
LEVELS = ("debug", "info", "warn", "error", "critical")
FAILING = ("error", "critical")


# What a fingerprint doesn't tell apart.
MASKED = r"\d+|'[^']*'|\"[^\"]*\""


def fingerprint(account_id: Column, event: Column, error_type: Column, message: Column) -> Column:
    """32 hex digits of account, event, error type and the message without numbers and quoted parts."""
    masked = F.substring(F.regexp_replace(F.lower(message), MASKED, "#"), 1, 200)
    raw = F.concat_ws("|", F.coalesce(account_id, F.lit(0)).cast("string"), event, F.coalesce(error_type, F.lit("")), masked)
    return F.substring(F.sha2(raw.cast("binary"), 256), 1, 32)


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def decode_detail(detail: Column) -> Column:
    """JSON text as it is; other text under ``raw``; null and empty stay."""
    wrapped = F.to_json(F.struct(detail.alias("raw")))
    return F.when(detail.isNull() | (detail == "") | F.try_parse_json(detail).isNotNull(), detail).otherwise(wrapped)


def status_to_error(status: Column) -> tuple[Column, Column]:
    """Error class of an HTTP status, null below 400, and whether a retry may help."""
    kind = F.when(status == 429, "rate_limited").when(status.isin(404, 410), "account_unavailable").when(status.isin(401, 403, 405, 503), "blocked").when(status >= 400, "adapter_error")
    return kind, kind.isNotNull() & (kind != "account_unavailable")
