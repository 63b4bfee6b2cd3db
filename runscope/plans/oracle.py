"""DuckDB SQL restating the bindings and every registered query, for the side-by-side correctness check.

Written independently of the Spark code: plain SQL windows, ROW_NUMBER and GROUP BY over the driver tables.
Sums are exact decimals in both engines, so results are bit-equal (the data has up to three decimals); integer sums are cast to BIGINT.
"""

from __future__ import annotations

# ---- bindings -------------------------------------------------------------------------------------------------

RAW_USERS = """
raw_users AS (
  SELECT c_custkey AS id, lower(c_name) AS username, c_name || '@Example.COM' AS email,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS first_name,
         'Name' || CAST(c_custkey AS VARCHAR) AS last_name,
         CAST(DATE '1960-01-01' + CAST(c_custkey % 15000 AS INTEGER) AS DATE) AS date_of_birth,
         CASE WHEN n_nationkey = 24 THEN NULL ELSE 'c' || CAST(n_nationkey AS VARCHAR) END AS country_code,
         CASE n_regionkey WHEN 0 THEN 'gbp' WHEN 1 THEN 'Usd' WHEN 2 THEN 'EUR' WHEN 3 THEN 'jpy' ELSE 'chf' END
           AS currency_code,
         CASE WHEN c_acctbal < 0 THEN 'SUSPENDED' ELSE 'Active' END AS status,
         CASE c_custkey % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'partial' ELSE 'None' END AS kyc_level,
         CASE c_custkey % 5 WHEN 0 THEN 'WEB' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Android' WHEN 3 THEN 'kiosk' END
           AS registration_platform,
         TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(c_custkey % 1000 AS BIGINT)) AS created_at,
         TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(c_custkey % 1000 + (c_custkey % 7) * 24 AS BIGINT))
           AS updated_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""

RAW_BETS = """
raw_bets AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 50 = 0 THEN -1 - o_custkey ELSE o_custkey END AS user_id,
         CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'SETTLED' ELSE 'void' END AS status,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'ACCUMULATOR' ELSE 'Single' END AS bet_type,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'football'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'basketball'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'tennis' END AS sport,
         o_totalprice AS wager_amount,
         o_totalprice + CAST((o_orderkey % 50) * 10 AS DOUBLE) AS potential_payout,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN o_totalprice + CAST((o_orderkey % 50) * 10 AS DOUBLE)
              WHEN o_orderstatus = 'F' THEN CAST(0.0 AS DOUBLE)
              WHEN o_orderstatus = 'P' THEN o_totalprice END AS settled_amount,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'WON' WHEN o_orderstatus = 'F' THEN 'lost'
              WHEN o_orderstatus = 'P' THEN 'void' END AS outcome,
         CAST(1.0 AS DOUBLE) + CAST(o_orderkey % 400 AS DOUBLE) / CAST(40.0 AS DOUBLE) AS odds,
         CASE o_custkey % 3 WHEN 0 THEN 'gbp' WHEN 1 THEN 'USD' ELSE 'Eur' END AS currency_code,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS placed_at,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 + (o_orderkey % 3) * 13 AS BIGINT)) END AS settled_at
  FROM orders
)"""

RAW_TRANSACTIONS = """
tx0 AS (
  SELECT event_id AS id, user_id,
         CASE WHEN event_type IN ('signup', 'error') THEN NULL ELSE event_id END AS bet_id,
         CASE event_type WHEN 'signup' THEN 'DEPOSIT' WHEN 'purchase' THEN 'Bet' WHEN 'click' THEN 'winnings'
              WHEN 'view' THEN 'refund' ELSE 'withdrawal' END AS type,
         CASE WHEN event_type IN ('signup', 'click', 'view') THEN value ELSE -value END AS amount,
         'gbp' AS currency_code, ts AS processed_at, 'EV-' || CAST(event_id AS VARCHAR) AS reference
  FROM events
),
raw_transactions AS (
  SELECT id, user_id, bet_id, type, amount,
         CAST(SUM(CAST(amount AS DECIMAL(24,4))) OVER (PARTITION BY user_id ORDER BY processed_at, id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              + CASE WHEN id % 500 = 499 THEN 1 ELSE 0 END AS DOUBLE) AS balance_after,
         currency_code, processed_at, reference
  FROM tx0
)"""

STD_USER = """
std_user AS (
  SELECT id AS user_id, username, lower(email) AS email, first_name, last_name, date_of_birth,
         upper(country_code) AS country_code, upper(currency_code) AS currency_code, lower(status) AS status,
         lower(kyc_level) AS kyc_level, lower(registration_platform) AS registration_platform,
         created_at AS registered_at, updated_at
  FROM raw_users
)"""

STD_BET = """
std_bet AS (
  SELECT id AS bet_id, user_id, lower(status) AS status, lower(bet_type) AS bet_type, sport, wager_amount,
         potential_payout, settled_amount, lower(outcome) AS outcome, odds, upper(currency_code) AS currency_code,
         placed_at, settled_at
  FROM raw_bets
)"""

STD_TRANSACTION = """
std_transaction AS (
  SELECT id AS transaction_id, user_id, bet_id, lower(type) AS transaction_type, amount, balance_after,
         upper(currency_code) AS currency_code, processed_at, reference
  FROM raw_transactions
)"""

DIM_USER = """
dim_user AS (
  SELECT *, CASE WHEN kyc_level = 'full' THEN TRUE ELSE FALSE END AS is_kyc_verified,
         CASE WHEN status = 'active' THEN TRUE ELSE FALSE END AS is_active,
         CASE WHEN registration_platform IN ('ios', 'android') THEN 'mobile'
              WHEN registration_platform = 'web' THEN 'desktop' ELSE 'unknown' END AS registration_device
  FROM std_user
)"""

# Straight from the driver tables, not through the layers: an order's state, price and key say all about its bet.
FCT_BET = """
bet_orders AS (
  SELECT *, o_orderkey AS k, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS has_won,
         o_orderstatus = 'F' AND o_orderkey % 2 <> 0 AS has_lost, o_orderstatus = 'P' AS is_void,
         o_totalprice + CAST((o_orderkey % 50) * 10 AS DOUBLE) AS payout
  FROM orders
),
fct_bet AS (
  SELECT k AS bet_id, IF(o_custkey % 50 = 0, -1 - o_custkey, o_custkey) AS user_id,
         IF(c_nationkey = 24, NULL, 'C' || CAST(c_nationkey AS VARCHAR)) AS country_code,
         c_custkey % 3 = 0 AS is_kyc_verified, c_acctbal >= 0 AS is_user_active,
         list_extract(['open', 'settled', 'void'], list_position(['O', 'F', 'P'], o_orderstatus)) AS status,
         IF(starts_with(o_orderpriority, '1'), 'accumulator', 'single') AS bet_type,
         list_extract(['football', 'football', 'basketball', 'tennis', NULL],
                      CAST(left(o_orderpriority, 1) AS INTEGER)) AS sport,
         o_totalprice AS wager_amount, payout AS potential_payout,
         IF(has_won, payout, IF(has_lost, CAST(0 AS DOUBLE), IF(is_void, o_totalprice, NULL))) AS settled_amount,
         IF(has_won, 'won', IF(has_lost, 'lost', IF(is_void, 'void', NULL))) AS outcome,
         CAST(1.0 AS DOUBLE) + CAST(k % 400 AS DOUBLE) / CAST(40.0 AS DOUBLE) AS odds,
         list_extract(['GBP', 'USD', 'EUR'], CAST(o_custkey % 3 + 1 AS INTEGER)) AS currency_code,
         o_orderdate + to_hours(CAST(k % 24 AS BIGINT)) AS placed_at,
         IF(o_orderstatus = 'O', NULL, o_orderdate + to_hours(CAST(k % 24 + (k % 3) * 13 AS BIGINT))) AS settled_at,
         IF(has_lost, o_totalprice, IF(has_won, o_totalprice - payout, IF(is_void, CAST(0 AS DOUBLE), NULL)))
           AS gross_gaming_revenue,
         o_orderstatus <> 'O' AND k % 24 + (k % 3) * 13 < 24 AS is_same_day_settled
  FROM bet_orders LEFT JOIN customer ON c_custkey = o_custkey AND o_custkey % 50 <> 0
)"""

# The bets of each user first, then the users of each group.
MART = """
user_day AS (
  SELECT CAST(placed_at AS DATE) AS bet_date, sport, bet_type, currency_code, country_code, user_id,
         list(status) AS states, list(outcome) AS outcomes, count(odds) AS n_odds,
         sum(CAST(wager_amount AS DECIMAL(24,4))) AS wager, sum(CAST(settled_amount AS DECIMAL(24,4))) AS settled,
         sum(CAST(gross_gaming_revenue AS DECIMAL(24,4))) AS ggr, sum(CAST(odds AS DECIMAL(24,4))) AS odds
  FROM fct_bet GROUP BY ALL
),
mart_bet_daily AS (
  SELECT bet_date, sport, bet_type, currency_code, country_code,
         CAST(sum(len(states)) AS BIGINT) AS total_bets,
         CAST(sum(len(list_filter(states, lambda x: x = 'settled'))) AS BIGINT) AS settled_bets,
         CAST(sum(len(list_filter(states, lambda x: x = 'open'))) AS BIGINT) AS open_bets,
         CAST(sum(len(list_filter(outcomes, lambda x: x = 'won'))) AS BIGINT) AS winning_bets,
         CAST(sum(len(list_filter(outcomes, lambda x: x = 'lost'))) AS BIGINT) AS losing_bets,
         CAST(sum(wager) AS DOUBLE) AS total_wager, CAST(sum(settled) AS DOUBLE) AS total_settled_amount,
         CAST(sum(ggr) AS DOUBLE) AS total_ggr,
         CAST(sum(odds) AS DOUBLE) / CAST(sum(n_odds) AS DOUBLE) AS avg_odds,
         count(user_id) AS unique_bettors
  FROM user_day GROUP BY ALL
)"""

WAREHOUSE_CTES = [RAW_USERS, RAW_BETS, RAW_TRANSACTIONS, STD_USER, STD_BET, STD_TRANSACTION, DIM_USER, FCT_BET, MART]


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
