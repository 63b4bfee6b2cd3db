"""Declared schemas. Raw tables are read with these, never inferred.

Warehouse INTEGER is 64-bit and FLOAT is a double, so both map to LongType / DoubleType.
"""

from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
NTZ, DATE, TS = T.TimestampNTZType(), T.DateType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


RAW_USERS = _struct(
    ("id", L, False), ("username", S, False), ("email", S, False), ("first_name", S, True),
    ("last_name", S, True), ("date_of_birth", DATE, True), ("country_code", S, True),
    ("currency_code", S, False), ("status", S, False), ("kyc_level", S, False),
    ("registration_platform", S, True), ("created_at", NTZ, False), ("updated_at", NTZ, False),
)

RAW_BETS = _struct(
    ("id", L, False), ("user_id", L, False), ("status", S, False), ("bet_type", S, False), ("sport", S, True),
    ("wager_amount", D, False), ("potential_payout", D, True), ("settled_amount", D, True), ("outcome", S, True),
    ("odds", D, False), ("currency_code", S, False), ("placed_at", NTZ, False), ("settled_at", NTZ, True),
)

RAW_TRANSACTIONS = _struct(
    ("id", L, False), ("user_id", L, False), ("bet_id", L, True), ("type", S, False), ("amount", D, False),
    ("balance_after", D, False), ("currency_code", S, False), ("processed_at", NTZ, False), ("reference", S, True),
)

RAW_SCHEMAS = {"users": RAW_USERS, "bets": RAW_BETS, "transactions": RAW_TRANSACTIONS}

# Column defaults declared on the raw tables (applied with coalesce when a loader leaves the column NULL).
RAW_DEFAULTS = {
    "users": {"currency_code": "GBP", "status": "active", "kyc_level": "none"},
    "bets": {"currency_code": "GBP"},
    "transactions": {"currency_code": "GBP"},
}

# Telemetry event log: one row per event; ``seq`` is the arrival order (the auto-increment id of the log).
EVENT = _struct(
    ("seq", L, False), ("run_id", S, False), ("type", S, False), ("agent", S, True),
    ("timestamp", S, False), ("data", S, True),
)

TOOL_METRICS = _struct(("call_count", L, True), ("success_count", L, True), ("error_count", L, True),
                       ("total_time_s", D, True))

METRICS = _struct(
    ("input_tokens", L, True), ("output_tokens", L, True), ("total_tokens", L, True),
    ("cache_read_tokens", L, True), ("cache_write_tokens", L, True), ("latency_ms", L, True),
    ("cycle_count", L, True), ("estimated_cost_usd", D, True),
    ("tools", T.MapType(S, TOOL_METRICS), True),
)

# Union of the payload keys of all event types; unknown keys stay in the raw ``data`` string.
PAYLOAD = _struct(
    ("agent_type", S, True), ("agent_name", S, True), ("success", B, True), ("duration_s", D, True),
    ("stop_reason", S, True), ("error", S, True), ("metrics", METRICS, True), ("tool_name", S, True),
    ("sub_agent_name", S, True), ("tool_use_id", S, True), ("input", S, True), ("status", S, True),
    ("result", S, True), ("text", S, True),
)

MANIFEST = _struct(
    ("run_id", S, True), ("command", S, True), ("exit_code", L, True), ("log_file", S, True),
    ("started_at", S, True), ("success", B, True),
)

# One JSON log line of the build tool: info{level,msg,ts,data?} and data{node_info{unique_id}}.
_NODE = _struct(("node_info", _struct(("unique_id", S, True)), True))
LOG_LINE = _struct(
    ("info", _struct(("level", S, True), ("msg", S, True), ("ts", S, True), ("data", _NODE, True)), True),
    ("data", _NODE, True),
)

LOG_ENTRY = _struct(("run_id", S, True), ("line_no", L, True), ("level", S, True), ("message", S, True),
                    ("node_id", S, True), ("timestamp", S, True))
