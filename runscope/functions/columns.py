"""Column expressions shared by the operators. All are built-in Catalyst expressions (codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference ---------------------------------------------------------
# USD per 1M tokens: input, output, cache read, cache write.
PRICE_PER_MTOK = {"input": "3.00", "output": "15.00", "cache_read": "0.30", "cache_write": "3.75"}
# Payload cap in characters and the marker appended after a cut.
MAX_PAYLOAD = 2000
# Severity -> issue priority; t-shirt size -> estimate points.
PRIORITY = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4}
ESTIMATE = {"XS": 1, "S": 2, "M": 3, "L": 5, "XL": 8}
# Substrings that mark an agent response as failed, per agent type.
TICKET_FAILURE_MARKERS = ["could not", "failed to", "unable to", "error", "api connection issue", "not configured"]
CODE_FIX_FAILURE_MARKERS = ["could not", "failed to", "unable to", "all retries", "retry exhausted",
                            "did not pass", "fix was not applied"]
# ----------------------------------------------------------------------------------------------------------


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag_equals(c, value: str) -> Column:
    """``CASE WHEN c = value THEN TRUE ELSE FALSE END``: NULL gives FALSE, never NULL."""
    return F.when(col_or(c) == F.lit(value), F.lit(True)).otherwise(F.lit(False))


def device_family(platform) -> Column:
    p = col_or(platform)
    return (F.when(p.isin("ios", "android"), F.lit("mobile"))
            .when(p == F.lit("web"), F.lit("desktop"))
            .otherwise(F.lit("unknown")))


def gross_gaming_revenue(outcome="outcome", wager="wager_amount", settled="settled_amount") -> Column:
    """House view: lost -> wager, won -> wager - settled, void -> 0.0, anything else (open) -> NULL."""
    o, w, s = col_or(outcome), col_or(wager), col_or(settled)
    return (F.when(o == F.lit("lost"), w)
            .when(o == F.lit("won"), w - s)
            .when(o == F.lit("void"), F.lit(0.0)))


def same_day_settled(placed="placed_at", settled="settled_at") -> Column:
    p, s = col_or(placed), col_or(settled)
    return F.when(s.isNotNull() & (F.to_date(p) == F.to_date(s)), F.lit(True)).otherwise(F.lit(False))


def run_status(success="success") -> Column:
    s = col_or(success)
    return F.when(s.isNull(), F.lit("running")).when(s == F.lit(1), F.lit("success")).otherwise(F.lit("error"))


def _price_units(price: str) -> int:
    """USD per 1M tokens -> integer units of 1e-8 USD per token (exact for prices with 2 decimals)."""
    from decimal import Decimal
    return int(Decimal(price) * 100)


def cost_units(input_tokens, output_tokens, cache_read, cache_write) -> Column:
    """Token cost as an exact integer in units of 1e-8 USD."""
    parts = [(input_tokens, "input"), (output_tokens, "output"), (cache_read, "cache_read"),
             (cache_write, "cache_write")]
    total = None
    for c, kind in parts:
        term = F.coalesce(col_or(c), F.lit(0)).cast("bigint") * F.lit(_price_units(PRICE_PER_MTOK[kind]))
        total = term if total is None else total + term
    return total


def micro_usd(units: Column) -> Column:
    """1e-8 USD units -> whole micro-dollars, rounded half-up (cost rounded to 6 places)."""
    return F.floor((units + F.lit(50)) / F.lit(100)).cast("bigint")


def estimated_cost_usd(input_tokens, output_tokens, cache_read, cache_write) -> Column:
    """Token cost in USD rounded half-up to 6 places; integer arithmetic, one final division."""
    return micro_usd(cost_units(input_tokens, output_tokens, cache_read, cache_write)).cast("double") / F.lit(1e6)


def truncate_payload(c, max_len: int = MAX_PAYLOAD) -> Column:
    s = col_or(c)
    n = F.char_length(s)
    return F.when(n > F.lit(max_len),
                  F.concat(F.substring(s, 1, max_len), F.lit("... ("), (n - F.lit(max_len)).cast("string"),
                           F.lit(" chars truncated)"))).otherwise(s)


def model_name(node_id) -> Column:
    """Model name = text after the last dot of a node id."""
    return F.substring_index(col_or(node_id), ".", -1)


def _lookup(c, table: dict[str, int]) -> Column:
    key = F.upper(col_or(c))
    expr = None
    for k, v in table.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr


def priority_of(severity) -> Column:
    return _lookup(severity, PRIORITY)


def estimate_of(size) -> Column:
    return _lookup(size, ESTIMATE)


def response_succeeded(text, agent_type: str = "ticket") -> Column:
    """Success iff none of the failure markers of that agent type occurs (case-insensitive)."""
    markers = TICKET_FAILURE_MARKERS if agent_type == "ticket" else CODE_FIX_FAILURE_MARKERS
    low = F.lower(col_or(text))
    hit = None
    for m in markers:
        h = F.contains(low, F.lit(m))
        hit = h if hit is None else (hit | h)
    return ~hit


def millis_between(start, end) -> Column:
    """(end - start) in seconds at millisecond precision, floored at 0; NULL if either side is NULL."""
    ms = F.floor(F.unix_micros(col_or(end)) / 1000) - F.floor(F.unix_micros(col_or(start)) / 1000)
    return F.greatest(F.lit(0.0), ms.cast("double") / F.lit(1000.0))


def money_sum(c) -> Column:
    """Exact sum of values with up to 8 decimals: decimal accumulation, double result (order-independent)."""
    return F.sum(col_or(c).cast("decimal(28,8)")).cast("double")
