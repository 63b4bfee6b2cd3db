"""Bindings: derive the reference's inputs (raw betting tables, build logs, manifests, model SQL, telemetry
events) from the driver tables, so every operator runs at the driver's scale.

Each rule is a plain column expression over one driver table (plus the 25-row ``nation`` dimension), so
every binding is a narrow, pushdown-friendly projection; only the manifests and model-SQL tables group.
The same rules are restated in DuckDB SQL in ``runscope.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.functions.columns import estimated_cost_usd
from runscope.operators.sequences import running_sum
from runscope.sources.tables import conform_raw, read_table


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def _ntz(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with microseconds and a UTC offset, the format the telemetry emitter writes."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _k(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("bigint")


# ---- R: raw betting tables ---------------------------------------------------------------------------------

def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    # nation is the fixed 25-row TPC-H dimension: its size does not grow with the scale factor.
    n = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    k = F.col("c_custkey")
    created = _ntz("2020-01-01 00:00:00") + _hours(k % 1000)
    df = (c.join(n, c.c_nationkey == n.n_nationkey)
          .select(
              k.alias("id"),
              F.lower("c_name").alias("username"),
              F.concat("c_name", F.lit("@Example.COM")).alias("email"),
              F.when(k % 10 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("first_name"),
              F.concat(F.lit("Name"), k.cast("string")).alias("last_name"),
              F.date_add(F.lit("1960-01-01").cast("date"), (k % 15000).cast("int")).alias("date_of_birth"),
              F.when(F.col("n_nationkey") == 24, F.lit(None))
               .otherwise(F.concat(F.lit("c"), F.col("n_nationkey").cast("string"))).alias("country_code"),
              F.when(F.col("n_regionkey") == 0, "gbp").when(F.col("n_regionkey") == 1, "Usd")
               .when(F.col("n_regionkey") == 2, "EUR").when(F.col("n_regionkey") == 3, "jpy")
               .otherwise("chf").alias("currency_code"),
              F.when(F.col("c_acctbal") < 0, "SUSPENDED").otherwise("Active").alias("status"),
              F.when(k % 3 == 0, "FULL").when(k % 3 == 1, "partial").otherwise("None").alias("kyc_level"),
              F.when(k % 5 == 0, "WEB").when(k % 5 == 1, "iOS").when(k % 5 == 2, "Android")
               .when(k % 5 == 3, "kiosk").alias("registration_platform"),
              created.alias("created_at"),
              (created + _hours((k % 7) * 24)).alias("updated_at"),
          ))
    return conform_raw(df, "users")


def raw_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, st, pr = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    payout = F.col("o_totalprice") + ((k % 50) * 10).cast("double")
    placed = F.col("o_orderdate") + _hours(k % 24)
    df = o.select(
        k.alias("id"),
        # Every 50th customer's bets name a user that is not there.
        F.when(F.col("o_custkey") % 50 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("user_id"),
        F.when(st == "O", "Open").when(st == "F", "SETTLED").otherwise("void").alias("status"),
        F.when(pr == "1-URGENT", "ACCUMULATOR").otherwise("Single").alias("bet_type"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), "football").when(pr == "3-MEDIUM", "basketball")
         .when(pr == "4-NOT SPECIFIED", "tennis").alias("sport"),
        F.col("o_totalprice").alias("wager_amount"),
        payout.alias("potential_payout"),
        F.when((st == "F") & (k % 2 == 0), payout).when(st == "F", F.lit(0.0))
         .when(st == "P", F.col("o_totalprice")).alias("settled_amount"),
        F.when((st == "F") & (k % 2 == 0), "WON").when(st == "F", "lost").when(st == "P", "void").alias("outcome"),
        (F.lit(1.0) + (k % 400).cast("double") / F.lit(40.0)).alias("odds"),
        F.when(F.col("o_custkey") % 3 == 0, "gbp").when(F.col("o_custkey") % 3 == 1, "USD")
         .otherwise("Eur").alias("currency_code"),
        placed.alias("placed_at"),
        F.when(st == "O", F.lit(None)).otherwise(placed + _hours((k % 3) * 13)).alias("settled_at"),
    )
    return conform_raw(df, "bets")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows from ``events``; balance_after is the running balance per user, broken on purpose at every
    500th event so the ledger check (IN-3) has something to find."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    credit = et.isin("signup", "click", "view")
    df = e.select(
        F.col("event_id").alias("id"), "user_id",
        F.when(et.isin("signup", "error"), F.lit(None)).otherwise(F.col("event_id")).alias("bet_id"),
        F.when(et == "signup", "DEPOSIT").when(et == "purchase", "Bet").when(et == "click", "winnings")
         .when(et == "view", "refund").otherwise("withdrawal").alias("type"),
        F.when(credit, F.col("value")).otherwise(-F.col("value")).alias("amount"),
        F.lit("gbp").alias("currency_code"),
        F.col("ts").alias("processed_at"),
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("reference"),
    )
    df = running_sum(df, ["user_id"], F.unix_date(F.to_date("processed_at")), ["processed_at", "id"],
                     F.col("amount").cast("decimal(28,8)"), "_bal", chunk_width=1)
    df = df.withColumn("balance_after",
                       (F.col("_bal") + F.when(F.col("id") % 500 == 499, F.lit(1)).otherwise(F.lit(0)))
                       .cast("double")).drop("_bal")
    return conform_raw(df, "transactions")


# ---- L: build logs, manifests, model SQL -------------------------------------------------------------------

def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, line_no, value): one JSON log line per event; every 97th line is plain text, every 89th and 83rd damaged."""
    e = read_table(spark, sf_dir, "events")
    et, k = F.col("event_type"), _k()
    level = (F.when(et == "error", "error").when(et == "view", "warn").when(et == "signup", "debug")
             .otherwise("info"))
    node = (F.when(et.isin("error", "click"), F.concat(F.lit("model.shop.t_"), k.cast("string")))
            .when(et == "view", F.concat(F.lit("test.shop.not_null_t_"), k.cast("string"))))
    node_obj = F.when(node.isNotNull(), F.struct(F.struct(node.alias("unique_id")).alias("node_info")))
    msg = (F.when(et == "error", F.concat(F.lit("Database Error in model t_"), k.cast("string"),
                                          F.lit(": invalid value "), F.col("value").cast("string")))
           .otherwise(F.concat(et, F.lit(" event "), F.col("event_id").cast("string"))))
    top = F.col("event_id") % 2 == 0
    info = F.struct(level.alias("level"), msg.alias("msg"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
                    F.when(~top, node_obj).alias("data"))
    # The entry is built in a step of its own, and once: the damaged lines are made from it.
    built = e.select("event_id", "user_id", F.to_json(F.struct(info.alias("info"), F.when(top, node_obj).alias("data")))
                     .alias("entry"))
    entry, i = F.col("entry"), F.col("event_id")
    line = F.when(i % 97 == 0, F.concat(F.lit("Running with build tool, event "), i.cast("string")))
    # Damaged lines: text after the object, and quotes that are not JSON's.
    line = (line.when(i % 89 == 0, F.concat(entry, F.lit(" trailing")))
            .when(i % 83 == 0, F.replace(entry, F.lit('"'), F.lit("'"))).otherwise(entry))
    return built.select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
                        i.alias("line_no"), line.alias("value"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per run (user): finish time = last event; exit code from the user id."""
    e = read_table(spark, sf_dir, "events").select("user_id", "ts")
    ec = (F.col("user_id") + 1) % 3
    return (e.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
            .select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
                    F.lit("dbt build").alias("command"),
                    ec.alias("exit_code"),
                    F.concat(F.lit("logs/runs/run_"), F.col("user_id").cast("string"), F.lit(".log")).alias("log_file"),
                    F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"),
                    (ec == 0).alias("success")))


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, sql): model SQL files from ``part``; several files can share a model name (stem)."""
    p = read_table(spark, sf_dir, "part")
    name = F.concat(F.lit("t_"), (F.col("p_partkey") % 150).cast("string"))
    path = F.concat(F.lit("models/"), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("/p"),
                    F.col("p_partkey").cast("string"), F.lit("/"), name, F.lit(".sql"))
    sql = F.concat(F.lit("SELECT "), F.col("p_size").cast("string"), F.lit(" AS size, '"), F.col("p_type"),
                   F.lit("' AS kind FROM "), F.col("p_name"))
    return p.select(path.alias("path"), sql.alias("sql"))


# ---- E / T: telemetry events ---------------------------------------------------------------------------------

def telemetry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent telemetry from ``events``: seq = event_id, run = user; an unordered mix of starts and ends,
    so it exercises unmatched ends, repeated run_start and empty tool ids."""
    e = read_table(spark, sf_dir, "events")
    et, k, v = F.col("event_type"), _k(), F.col("value")
    agent = F.when(F.col("user_id") % 2 == 0, "ticket").otherwise("code-fix")
    etype = (F.when(et == "signup", "run_start").when(et == "click", "tool_start").when(et == "view", "tool_end")
             .when(et == "purchase", "invocation_end").otherwise("run_end"))
    tool_name = F.concat(F.lit("tool_"), (k % 5).cast("string"))
    tool_id = F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("tu_"), k.cast("string")))
    in_tok, out_tok = k * 100 + 7, k * 37 + F.col("event_id") % 1000
    cr, cw = k * 10, (k % 7) * 100
    metrics = F.struct(
        in_tok.alias("input_tokens"), out_tok.alias("output_tokens"), (in_tok + out_tok).alias("total_tokens"),
        cr.alias("cache_read_tokens"), cw.alias("cache_write_tokens"),
        (F.col("event_id") % 5000).alias("latency_ms"), (k % 5 + 1).alias("cycle_count"),
        estimated_cost_usd(in_tok, out_tok, cr, cw).alias("estimated_cost_usd"),
        F.create_map(tool_name, F.struct((k % 4 + 1).alias("call_count"), (k % 4 + 1 - k % 2).alias("success_count"),
                                         (k % 2).alias("error_count"), v.alias("total_time_s"))).alias("tools"))
    payload = (
        F.when(et == "signup", F.to_json(F.struct(agent.alias("agent_type"))))
        .when(et == "error", F.to_json(F.struct(agent.alias("agent_type"), (v >= 100).alias("success"),
                                                F.when(k % 4 != 0, v).alias("duration_s"))))
        .when(et == "purchase", F.to_json(F.struct(agent.alias("agent_name"), F.lit("end_turn").alias("stop_reason"),
                                                   F.when(k % 5 != 0, metrics).alias("metrics"))))
        .when(et == "click", F.to_json(F.struct(tool_name.alias("tool_name"), tool_id.alias("tool_use_id"),
                                                F.concat(F.lit('{"q": '), k.cast("string"), F.lit("}")).alias("input"))))
        .otherwise(F.to_json(F.struct(tool_name.alias("tool_name"), tool_id.alias("tool_use_id"),
                                      F.when(k % 3 != 0, v / F.lit(10.0)).alias("duration_s"),
                                      F.when(k % 7 == 0, "error").otherwise("success").alias("status"),
                                      F.when(k % 7 == 0, "tool raised").alias("error"),
                                      F.when(k % 7 != 0, F.concat(F.lit("rows="), k.cast("string"))).alias("result"))))
    )
    return e.select(F.col("event_id").alias("seq"),
                    F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
                    etype.alias("type"), agent.alias("agent"), iso_utc(F.col("ts")).alias("timestamp"),
                    payload.alias("data"))


def _step(j: int, etype: str, data: Column) -> Column:
    return F.struct(F.lit(j).alias("j"), F.lit(etype).alias("type"), data.alias("data"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-nested agent traces from ``conversations``: one run per conversation, one invocation per turn.

    system turn -> reasoning only; user turn -> invocation{llm{reasoning, token}, tool}; assistant turn ->
    invocation{llm{token}} with token metrics. Sequence numbers leave room for the run_start/run_end pair.
    """
    c = read_table(spark, sf_dir, "conversations")
    role, t, cid, txt = F.col("role"), F.col("turn"), F.col("conv_id"), F.col("text")
    n = F.char_length(txt)
    tool_id = F.concat(F.lit("tu-"), cid.cast("string"), F.lit("-"), t.cast("string"))
    inv_start = F.to_json(F.struct(F.lit("chat").alias("agent_name")))
    tok = F.to_json(F.struct(txt.alias("text")))
    metrics = F.struct(n.cast("bigint").alias("input_tokens"), (n % 97).cast("bigint").alias("output_tokens"),
                       (n + n % 97).cast("bigint").alias("total_tokens"), F.lit(0).cast("bigint").alias("cache_read_tokens"),
                       F.lit(0).cast("bigint").alias("cache_write_tokens"), (n * 3).cast("bigint").alias("latency_ms"),
                       F.lit(1).cast("bigint").alias("cycle_count"),
                       estimated_cost_usd(n, n % 97, F.lit(0), F.lit(0)).alias("estimated_cost_usd"))
    inv_end = F.to_json(F.struct(F.lit("chat").alias("agent_name"), F.lit("end_turn").alias("stop_reason"),
                                 metrics.alias("metrics")))
    steps = F.when(role == "system", F.array(_step(0, "reasoning", tok)))
    steps = steps.when(role == "user", F.array(
        _step(0, "invocation_start", inv_start),
        _step(1, "model_call_start", F.lit("{}")),
        _step(2, "reasoning", tok),
        _step(3, "token", tok),
        _step(4, "model_call_end", F.to_json(F.struct(F.lit("tool_use").alias("stop_reason")))),
        _step(5, "tool_start", F.to_json(F.struct(F.lit("lookup").alias("tool_name"), tool_id.alias("tool_use_id")))),
        _step(6, "tool_end", F.to_json(F.struct(F.lit("lookup").alias("tool_name"), tool_id.alias("tool_use_id"),
                                                F.when(n % 5 == 0, "error").otherwise("success").alias("status")))),
        _step(7, "invocation_end", F.to_json(F.struct(F.lit("chat").alias("agent_name")))),
    ))
    steps = steps.otherwise(F.array(
        _step(0, "invocation_start", inv_start),
        _step(1, "model_call_start", F.lit("{}")),
        _step(2, "token", tok),
        _step(3, "model_call_end", F.to_json(F.struct(F.lit("end_turn").alias("stop_reason")))),
        _step(4, "invocation_end", inv_end),
    ))
    base = _ntz("2024-03-01 00:00:00")
    ev = (c.select(cid.alias("conv_id"), t.alias("turn"), F.inline(steps))
          .select(F.col("conv_id"), (F.col("conv_id") * 100000 + 10 + F.col("turn") * 10 + F.col("j")).alias("seq"),
                  "type", "data"))
    runs = c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    bounds = runs.select("conv_id", F.inline(F.array(
        _step(0, "run_start", F.lit('{"agent_type":"chat"}')),
        _step(99999, "run_end", F.to_json(F.struct(F.lit(True).alias("success")))),
    ))).select("conv_id", (F.col("conv_id") * 100000 + F.col("j")).alias("seq"), "type", "data")
    allev = ev.unionByName(bounds)
    ts = base + _seconds(F.col("seq"))
    return allev.select("seq", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("run_id"), "type",
                        F.lit("chat").alias("agent"), iso_utc(ts).alias("timestamp"), "data")
