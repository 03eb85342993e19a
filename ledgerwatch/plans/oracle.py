"""The same queries in plain SQL, written independently of the Spark operators.

The features use range frames and pair tables where the operators use running
totals and counts, so agreement means something.
"""

from __future__ import annotations

import re

from ledgerwatch.schema import FEATURE_COLUMNS, HOME_COUNTRIES, MAX_AMOUNT, MODEL_NAME

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
FLAGGED_BY = "TIMESTAMP '2024-01-31 00:00:00'"
SPLIT_AT = "TIMESTAMP '2024-01-16 00:00:00'"

_WEIGHTS = {c: round((-1) ** i * (i + 1) / 10, 1) for i, c in enumerate(FEATURE_COLUMNS)}


def r(expr: str, places: int = 6) -> str:
    """Round half up in decimal arithmetic, as a double."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,12)), {places}) AS DOUBLE)"


_U = "CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / 4503599627370496e0"


def _uniform(key: str) -> str:
    return _U.format(key=key)


# A list of the fixed countries, as DuckDB writes lists.
_COUNTRIES = str(HOME_COUNTRIES)

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "txns": (
        (),
        f"""SELECT event_id, 'txn_' || event_id AS txn_id, uid AS user_id, value * 5 AS amount, 'INR' AS currency,
          'merchant_' || regexp_extract(props, '([0-9]+)', 1) AS merchant_id,
          CASE event_type WHEN 'click' THEN 'electronics' WHEN 'purchase' THEN 'crypto' WHEN 'view' THEN 'groceries'
               WHEN 'signup' THEN 'travel' ELSE 'gaming' END AS merchant_category,
          ts AS txn_timestamp,
          CASE WHEN event_id % 50 = 0 THEN 'dev_s' || (event_id % 2000) ELSE 'dev_' || uid END AS device_id,
          {_COUNTRIES}[(hi + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END) % 8 + 1] AS ip_country,
          CASE event_id % 4 WHEN 0 THEN 'card_present' WHEN 1 THEN 'card_not_present' WHEN 2 THEN 'upi'
               ELSE 'login' END AS channel,
          {_COUNTRIES}[hi + 1] AS home_country,
          epoch_us(ts) AS us
        FROM (SELECT *, 'user_' || user_id AS uid,
                (position(right(sha256('user_' || user_id), 1) IN '0123456789abcdef') - 1) % 8 AS hi FROM events)""",
    ),
    "scored_rule": (
        ("txns",),
        """SELECT *, least(CASE WHEN amount > 1000 OR (ip_country <> '' AND ip_country <> home_country) THEN 0.95e0
                 ELSE 0.01e0 END + CASE WHEN channel = 'card_not_present' THEN 0.05e0 ELSE 0e0 END
               + CASE WHEN merchant_category IN ('electronics', 'gift_cards', 'crypto') THEN 0.05e0 ELSE 0e0 END,
               0.98e0) AS score FROM txns""",
    ),
    "labs": (
        ("scored_rule",),
        """SELECT txn_id, (event_id * 7919 % 10000) / 10000e0 < score AS is_fraud,
          'simulated_chargeback' AS label_source, txn_timestamp + INTERVAL 2 HOUR AS confirmed_at,
          1 + (event_id % 71) / 10e0 AS delay_hours FROM scored_rule WHERE event_id % 3 <> 0""",
    ),
    "preds": (
        ("txns",),
        """SELECT txn_id, amount / (amount + 300e0) AS fraud_probability,
          amount / (amount + 300e0) >= 0.5e0 AS is_flagged,
          CASE WHEN event_id % 2 = 0 THEN '7' ELSE '8' END AS model_version,
          1 + (event_id * 37 % 2000) / 10e0 AS latency_ms,
          CASE WHEN event_id % 5 <> 0 THEN (event_id * 13 % 50) / 10e0 END AS inference_latency_ms,
          txn_timestamp + INTERVAL 1 SECOND AS scored_at FROM txns""",
    ),
    "scored": (
        ("preds", "labs"),
        "SELECT p.*, l.is_fraud FROM preds p JOIN labs l ON p.txn_id = l.txn_id",
    ),
    "registry": (
        ("scored",),
        f"""SELECT '{MODEL_NAME}' AS model_name, CAST(v AS VARCHAR) AS model_version,
          'models:/{MODEL_NAME}/' || v AS model_uri, v > 4 AS is_active, created_at,
          CASE WHEN v % 7 <> 0 THEN auc END AS auc, pr_auc,
          CASE WHEN v % 5 <> 0 THEN {r('0.3e0 + v / 100e0', 2)} END AS best_threshold
        FROM (SELECT day(scored_at) AS v, min(scored_at) AS created_at,
                {r('avg(CASE WHEN is_flagged = is_fraud THEN 1e0 ELSE 0e0 END)', 4)} AS auc,
                {r('avg(CASE WHEN is_flagged AND is_fraud THEN 1e0 ELSE 0e0 END)', 4)} AS pr_auc
              FROM scored GROUP BY 1)""",
    ),
    "posterior": (
        ("scored",),
        """SELECT model_version, count(*) FILTER (is_flagged AND is_fraud) + 1e0 AS a,
          count(*) FILTER (is_flagged <> is_fraud) + 1e0 AS b FROM scored GROUP BY 1""",
    ),
    "challenger": (
        ("registry",),
        f"""SELECT model_name, '9' AS model_version, 'models:/{MODEL_NAME}/retrained' AS model_uri, is_active, created_at,
          auc, pr_auc, best_threshold FROM registry WHERE model_version = '8'""",
    ),
    "retired": (
        ("registry",),
        """SELECT model_name, model_version, model_uri, is_active AND model_version IN (
            SELECT model_version FROM registry WHERE is_active ORDER BY auc DESC NULLS LAST, created_at DESC LIMIT 3
          ) AS is_active, created_at, auc, pr_auc, best_threshold FROM registry""",
    ),
    "drift_log": (
        ("preds",),
        f"""SELECT make_timestamp(CAST((slot + 1) * 21600000000 AS BIGINT)) AS checked_at, model_version,
          max_feature_psi, mean_feature_psi, max_feature_psi >= 0.45e0 AS drift_detected,
          max_feature_psi >= 0.45e0 AND slot % 2 = 0 AS retrain_triggered,
          CASE WHEN max_feature_psi >= 0.45e0 AND slot % 2 <> 0 THEN 'cooldown' END AS retrain_skipped_reason
        FROM (SELECT epoch_us(scored_at) // 21600000000 AS slot, max(model_version) AS model_version,
                {r('max(fraud_probability) - avg(fraud_probability)', 4)} AS max_feature_psi,
                {r('avg(fraud_probability)', 4)} AS mean_feature_psi FROM preds GROUP BY 1)""",
    ),
    "edges": (
        ("txns",),
        """SELECT user_id, etype, entity_id, min(us) AS first_seen, count(*) AS txns FROM (
            SELECT user_id, 'USED_DEVICE' AS etype, device_id AS entity_id, us FROM txns
            UNION ALL SELECT user_id, 'TRANSACTED_AT', merchant_id, us FROM txns
            UNION ALL SELECT user_id, 'FROM_COUNTRY', ip_country, us FROM txns) GROUP BY ALL""",
    ),
    "flagged_all": (
        ("labs", "txns"),
        """SELECT t.user_id, min(epoch_us(l.confirmed_at)) AS flagged_at FROM labs l
          JOIN txns t ON t.txn_id = l.txn_id WHERE l.is_fraud GROUP BY 1""",
    ),
    "flagged": (
        ("labs", "txns"),
        f"""SELECT t.user_id, min(epoch_us(l.confirmed_at)) AS flagged_at FROM labs l
          JOIN txns t ON t.txn_id = l.txn_id WHERE l.is_fraud AND l.confirmed_at <= {FLAGGED_BY} GROUP BY 1""",
    ),
    "device_pairs": (
        ("edges",),
        """SELECT a.user_id AS u, b.user_id AS o, min(greatest(a.first_seen, b.first_seen)) AS ready
          FROM edges a JOIN edges b ON a.entity_id = b.entity_id AND a.user_id <> b.user_id
          WHERE a.etype = 'USED_DEVICE' AND b.etype = 'USED_DEVICE' GROUP BY 1, 2""",
    ),
    "user_pairs": (
        ("edges",),
        """SELECT a.user_id AS u, b.user_id AS o, min(greatest(a.first_seen, b.first_seen)) AS ready
          FROM edges a JOIN edges b ON a.etype = b.etype AND a.entity_id = b.entity_id AND a.user_id <> b.user_id
          GROUP BY 1, 2""",
    ),
    "two_hops": (
        ("user_pairs", "flagged_all"),
        """SELECT u, min(greatest(ready, flagged_at)) AS at_us FROM user_pairs
          JOIN flagged_all f ON f.user_id = o GROUP BY 1""",
    ),
    "four_hops": (
        ("user_pairs", "flagged_all"),
        """SELECT a.u, min(greatest(a.ready, b.ready, flagged_at)) AS at_us FROM user_pairs a
          JOIN user_pairs b ON a.o = b.u JOIN flagged_all f ON f.user_id = b.o WHERE b.o <> a.u GROUP BY 1""",
    ),
    "exposure": (
        ("edges", "flagged_all"),
        """SELECT e.entity_id AS merchant_id, greatest(e.first_seen, f.flagged_at) AS at_us FROM edges e
          JOIN flagged_all f ON f.user_id = e.user_id WHERE e.etype = 'TRANSACTED_AT'""",
    ),
    "shifted_txns": (
        ("txns",),
        f"""SELECT * REPLACE (CASE WHEN txn_timestamp >= {SPLIT_AT} THEN amount * 3 ELSE amount END AS amount)
          FROM txns""",
    ),
}


def _behaviour_sql(source: str) -> str:
    return f"""SELECT *,
      n1 + 1 AS txn_velocity_1h, n24 + 1 AS txn_velocity_24h,
      {r('mean24')} AS amount_mean_24h, {r('std24')} AS amount_std_24h,
      CASE WHEN std24 > 0 THEN {r('(amount - mean24) / std24')} ELSE 0e0 END AS amount_zscore,
      len(list_distinct(list_append(coalesce(m1, []), merchant_id))) AS distinct_merchants_1h,
      len(list_distinct(list_append(coalesce(m24, []), merchant_id))) AS distinct_merchants_24h,
      CAST(CASE WHEN gap <= 86700 AND prev_country <> '' AND prev_country <> ip_country AND gap <= 3600
           THEN 1 ELSE 0 END AS BIGINT) AS impossible_travel_flag,
      CASE WHEN gap <= 86700 THEN {r('gap', 3)} ELSE -1e0 END AS seconds_since_last_txn
    FROM (SELECT *, count(*) OVER h1 AS n1, count(*) OVER h24 AS n24,
            coalesce(avg(amount) OVER h24, 0e0) AS mean24,
            CASE WHEN count(*) OVER h24 >= 2 THEN stddev_pop(amount) OVER h24 ELSE 0e0 END AS std24,
            list(merchant_id) OVER h1 AS m1, list(merchant_id) OVER h24 AS m24,
            (us - lag(us) OVER seq) / 1e6 AS gap, lag(ip_country) OVER seq AS prev_country
          FROM {source}
          WINDOW h1 AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING),
                 h24 AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING),
                 seq AS (PARTITION BY user_id ORDER BY us, txn_id))"""


def _snapshots_sql(source: str) -> str:
    return f"""SELECT txn_id, user_id, txn_timestamp, txn_velocity_1h, txn_velocity_24h, amount_mean_24h,
      amount_std_24h, amount_zscore, distinct_merchants_1h, distinct_merchants_24h, impossible_travel_flag,
      seconds_since_last_txn,
      (SELECT count(*) FROM device_pairs p WHERE p.u = b.user_id AND p.ready <= b.us) AS shared_device_count,
      (SELECT count(*) FROM exposure e WHERE e.merchant_id = b.merchant_id AND e.at_us <= b.us)
        AS shared_merchant_fraud_count,
      CAST(CASE WHEN h2.at_us <= b.us THEN 2 WHEN h4.at_us <= b.us THEN 4 ELSE 0 END AS BIGINT)
        AS hop_distance_to_fraud,
      CASE WHEN ip_country <> home_country THEN 1e0 ELSE 0e0 END AS is_foreign_ip,
      {r('ln(1 + amount)')} AS log_amount,
      CASE WHEN channel = 'card_not_present' THEN 1e0 ELSE 0e0 END AS is_card_not_present,
      CASE WHEN merchant_category IN ('electronics', 'gift_cards', 'crypto', 'jewelry', 'gaming') THEN 1e0
           ELSE 0e0 END AS is_high_risk_category
    FROM {source} b LEFT JOIN two_hops h2 ON h2.u = b.user_id LEFT JOIN four_hops h4 ON h4.u = b.user_id"""


_GRAPH = ("device_pairs", "exposure", "two_hops", "four_hops")
_CTES["beh"] = (("txns",), _behaviour_sql("txns"))
_CTES["shifted_beh"] = (("shifted_txns",), _behaviour_sql("shifted_txns"))
_CTES["one_user"] = (("txns",), "SELECT * REPLACE (user_id[1:5] AS user_id) FROM txns")
_CTES["one_user_beh"] = (("one_user",), _behaviour_sql("one_user"))
_CTES["snaps"] = (("beh", *_GRAPH), _snapshots_sql("beh"))
_CTES["shifted_snaps"] = (("shifted_beh", *_GRAPH), _snapshots_sql("shifted_beh"))

# The newest snapshot of the user at most 48 hours old, written a second after its transaction.
_CTES["asof_rows"] = (
    ("txns", "snaps"),
    """SELECT t.txn_id AS asked, s.*, coalesce(t.us - (epoch_us(s.txn_timestamp) + 1000000) <= 172800000000, false) AS matched
      FROM txns t ASOF LEFT JOIN snaps s
      ON t.user_id = s.user_id AND t.txn_timestamp >= s.txn_timestamp + INTERVAL 1 SECOND""",
)
_CTES["wire"] = (
    ("txns",),
    """SELECT event_id, CASE d WHEN 18 THEN '{"data":' || payload WHEN 19 THEN '{"payload":' || payload || '}'
          WHEN 17 THEN '{"data":"' || replace(payload, '"', '\\"') || '"}' ELSE '{"data":' || payload || '}' END AS value
      FROM (SELECT event_id, event_id % 40 AS d, CASE WHEN event_id % 40 = 14 THEN '{}' ELSE '{' || concat_ws(',',
          '"txn_id":"' || txn_id || '"',
          CASE WHEN event_id % 40 <> 1 THEN '"user_id":"' || user_id || '"' END,
          CASE event_id % 40 WHEN 2 THEN '"amount":"NOT_A_NUMBER"' WHEN 3 THEN '"amount":-100.5' WHEN 4 THEN NULL
               WHEN 15 THEN '"amount":"12.5"' ELSE '"amount":' || CAST(round(amount * 100) AS BIGINT) END,
          CASE event_id % 40 WHEN 5 THEN '"currency":12345' ELSE '"currency":"inr"' END,
          CASE event_id % 40 WHEN 6 THEN '"merchant_id":{"id":"m6"}' ELSE '"merchant_id":"' || merchant_id || '"' END,
          CASE WHEN event_id % 40 <> 7 THEN '"merchant_category":"' || merchant_category || '"' END,
          CASE event_id % 40 WHEN 8 THEN '"timestamp":"yesterday"' WHEN 9 THEN NULL
               WHEN 16 THEN '"timestamp":"2023-13-45T00:00:00Z"'
               ELSE '"timestamp":"' || strftime(txn_timestamp, '%Y-%m-%dT%H:%M:%S') || 'Z"' END,
          CASE event_id % 40 WHEN 10 THEN '"device_id":["d10"]' ELSE '"device_id":"' || device_id || '"' END,
          CASE event_id % 40 WHEN 11 THEN '"ip_country":404' ELSE '"ip_country":"' || ip_country || '"' END,
          CASE event_id % 40 WHEN 12 THEN '"channel":"telepathy"' WHEN 13 THEN NULL
               ELSE '"channel":"' || channel || '"' END) || '}' END AS payload FROM txns)""",
)
_CTES["decoded"] = (
    ("wire",),
    """SELECT event_id, value, CASE WHEN message IS NULL THEN 'undecodable'
          WHEN json_extract(message, '$.data') IS NULL THEN 'missing:data' ELSE NULL END AS err,
        CASE WHEN json_type(message, '$.data') = 'VARCHAR' THEN TRY_CAST(json_extract_string(message, '$.data') AS JSON)
             ELSE json_extract(message, '$.data') END AS data
      FROM (SELECT *, TRY_CAST(value AS JSON) AS message FROM wire)""",
)


def _text_rule(field: str) -> str:
    return (
        f"CASE WHEN json_type(data, '$.{field}') IS NULL THEN 'missing:{field}' "
        f"WHEN json_type(data, '$.{field}') <> 'VARCHAR' THEN 'type:{field}' END"
    )


_TS = "json_extract_string(data, '$.timestamp')"
_AMOUNT = "TRY_CAST(json_extract_string(data, '$.amount') AS DOUBLE)"
_RULES = [
    *[_text_rule(f) for f in ("txn_id", "user_id")],
    f"""CASE WHEN json_type(data, '$.amount') IS NULL THEN 'missing:amount' WHEN {_AMOUNT} IS NULL THEN 'type:amount'
         WHEN {_AMOUNT} < 0 OR {_AMOUNT} >= {MAX_AMOUNT} THEN 'range:amount' END""",
    *[_text_rule(f) for f in ("currency", "merchant_id", "merchant_category")],
    f"""CASE WHEN json_type(data, '$.timestamp') IS NULL THEN 'missing:timestamp'
         WHEN NOT regexp_full_match({_TS}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z')
           OR TRY_CAST({_TS} AS TIMESTAMPTZ) IS NULL THEN 'format:timestamp' END""",
    *[_text_rule(f) for f in ("device_id", "ip_country")],
    """CASE WHEN json_type(data, '$.channel') IS NULL THEN 'missing:channel'
         WHEN json_type(data, '$.channel') <> 'VARCHAR' THEN 'type:channel'
         WHEN json_extract_string(data, '$.channel') NOT IN ('card_present', 'card_not_present', 'upi', 'login')
         THEN 'enum:channel' END""",
]
_CTES["validated"] = (
    ("decoded",),
    f"""SELECT *, reasons = '' AS ok FROM (SELECT *, CASE WHEN err IS NOT NULL THEN err
        ELSE coalesce(concat_ws(',', {', '.join(_RULES)}), '') END AS reasons FROM decoded)""",
)
_CTES["dlq"] = (
    ("validated",),
    "SELECT value AS raw, reasons AS reason, event_id AS source_offset, 'input' AS stage FROM validated WHERE NOT ok",
)
# Valid messages as transactions, and the snapshots of these alone; times on the wire have no fractions.
_CTES["wire_txns"] = (
    ("validated", "txns"),
    f"""SELECT t.* REPLACE ({_AMOUNT} AS amount, date_trunc('second', t.txn_timestamp) AS txn_timestamp,
          epoch_us(date_trunc('second', t.txn_timestamp)) AS us)
        FROM txns t JOIN validated v ON v.event_id = t.event_id WHERE v.ok""",
)


def _again(prefix: str, *names: str) -> None:
    """The tables ``names``, which rest on the first of them, once more on its namesake with the prefix."""
    for name in names[1:]:
        needs, body = _CTES[name]
        _CTES[f"{prefix}_{name}"] = (
            tuple(f"{prefix}_{n}" if n in names else n for n in needs),
            re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", rf"\1 {prefix}_\2", body),
        )


_again("wire", "txns", "beh", "edges", "device_pairs", "user_pairs", "two_hops", "four_hops", "exposure", "snaps")
_CTES["busy_txns"] = (("txns",), "SELECT * REPLACE ('dev_' || (event_id % 7) AS device_id) FROM txns")
_again("busy", "txns", "edges", "device_pairs")

_CTES["backlog"] = (
    ("txns", "labs"),
    f"""SELECT t.* FROM txns t LEFT JOIN labs l ON l.txn_id = t.txn_id
      WHERE l.txn_id IS NULL AND t.txn_timestamp <= {NOW} - INTERVAL 1 HOUR""",
)
_CTES["matured"] = (
    ("backlog",),
    f"""SELECT * FROM (SELECT *, (epoch_us({NOW}) - us) / 3.6e9 AS age_hours,
          1e0 + 71e0 * ({_uniform("txn_id || 'delay'")}) AS delay_hours FROM backlog) WHERE age_hours >= delay_hours""",
)
_CTES["new_labels"] = (
    ("matured", "scored_rule"),
    f"""SELECT m.txn_id, {_uniform("m.txn_id || 'outcome'")} < s.score AS is_fraud,
          'simulated_chargeback' AS label_source, {NOW} AS confirmed_at, {r('m.delay_hours', 3)} AS delay_hours
        FROM matured m JOIN scored_rule s ON s.txn_id = m.txn_id""",
)
_CTES["base_long"] = (
    ("shifted_snaps",),
    f"""UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_COLUMNS)} FROM shifted_snaps
        WHERE txn_timestamp < {SPLIT_AT}) ON {', '.join(FEATURE_COLUMNS)} INTO NAME feature VALUE value""",
)
_CTES["live_long"] = (
    ("shifted_snaps",),
    f"""UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_COLUMNS)} FROM shifted_snaps
        WHERE txn_timestamp >= {SPLIT_AT}) ON {', '.join(FEATURE_COLUMNS)} INTO NAME feature VALUE value""",
)
_CTES["psi_edges"] = (
    ("base_long",),
    """SELECT feature, CASE WHEN len(q) = 1 THEN q ELSE q[2:len(q) - 1] END AS edges FROM (
        SELECT feature, list_sort(list_distinct(
          quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM base_long GROUP BY 1)""",
)


def _probs_sql(source: str) -> str:
    return f"""SELECT s.feature, s.bucket, greatest(coalesce(c.n, 0) / t.total, 1e-6) AS prob FROM (
        SELECT feature, unnest(range(0, len(edges) + 1)) AS bucket FROM psi_edges) s
      LEFT JOIN (SELECT v.feature, len(list_filter(edges, lambda e: e <= value)) AS bucket, count(*) * 1e0 AS n
                 FROM {source} v JOIN psi_edges e ON e.feature = v.feature GROUP BY 1, 2) c
        ON c.feature = s.feature AND c.bucket = s.bucket
      JOIN (SELECT feature, count(*) AS total FROM {source} GROUP BY 1) t ON t.feature = s.feature"""


_CTES["base_probs"] = (("psi_edges", "base_long"), _probs_sql("base_long"))
_CTES["live_probs"] = (("psi_edges", "live_long"), _probs_sql("live_long"))
_CTES["psi"] = (
    ("base_probs", "live_probs"),
    f"""SELECT b.feature, {r('sum((l.prob - b.prob) * ln(l.prob / b.prob))', 5)} AS psi FROM base_probs b
      JOIN live_probs l ON l.feature = b.feature AND l.bucket = b.bucket GROUP BY 1""",
)
# The same over the three days before the newest active model and the last six hours.
_CTES["created"] = (("registry",), "SELECT max(created_at) AS made FROM registry WHERE is_active")
for _part, _inside in {
    "base": "txn_timestamp >= made - INTERVAL 72 HOUR AND txn_timestamp < made",
    "live": f"txn_timestamp >= {NOW} - INTERVAL 6 HOUR AND txn_timestamp <= {NOW}",
}.items():
    _CTES[f"w_{_part}_long"] = (
        ("snaps", "created"),
        f"""UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_COLUMNS)} FROM snaps, created
        WHERE {_inside}) ON {', '.join(FEATURE_COLUMNS)} INTO NAME feature VALUE value""",
    )
for _name in ("psi_edges", "base_probs", "live_probs", "psi"):
    _sources = ("psi_edges", "base_long", "live_long", "base_probs", "live_probs")
    _needs, _body = _CTES[_name]
    for _source in _sources:
        _body = _body.replace(_source, f"w_{_source}")
    _CTES[f"w_{_name}"] = (tuple(f"w_{n}" for n in _needs), _body)
_CTES["ks"] = (
    ("preds",),
    f"""SELECT max(abs(ca / na - cb / nb)) AS ks FROM (
        SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (
          SELECT fraud_probability AS p, count(*) FILTER (scored_at < {SPLIT_AT}) * 1e0 AS a,
            count(*) FILTER (scored_at >= {SPLIT_AT}) * 1e0 AS b FROM preds GROUP BY 1)
        WINDOW w AS (ORDER BY p))""",
)
_CTES["w_ks"] = (
    ("preds", "created"),
    f"""SELECT max(abs(ca / na - cb / nb)) AS ks, max(na) AS na, max(nb) AS nb FROM (
        SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (
          SELECT fraud_probability AS p, count(*) FILTER (scored_at >= made - INTERVAL 72 HOUR AND scored_at < made) * 1e0 AS a,
            count(*) FILTER (scored_at >= {NOW} - INTERVAL 6 HOUR AND scored_at <= {NOW}) * 1e0 AS b FROM preds, created GROUP BY 1)
        WHERE a + b > 0 WINDOW w AS (ORDER BY p))""",
)
_CTES["phi"] = (
    ("snaps",),
    "SELECT txn_id, "
    + ", ".join(f"{w}e0 * ({c} - CAST(sum(CAST({c} AS DECIMAL(24, 6))) OVER () AS DOUBLE) / count({c}) OVER ()) AS phi_{c}, CAST({c} AS DOUBLE) AS {c}" for c, w in _WEIGHTS.items())
    + " FROM snaps",
)
_CTES["grid"] = (
    ("scored",),
    """SELECT k, sum(pos) OVER top AS tp, sum(n) OVER top AS flagged, sum(pos) OVER () * 1e0 AS all_pos, sum(n) OVER () * 1e0 AS total
      FROM (SELECT g.k, count(*) FILTER (s.is_fraud) AS pos, count(s.txn_id) AS n FROM range(0, 100) g(k)
            LEFT JOIN scored s ON least(CAST(floor(s.fraud_probability * 100 + 1e-9) AS BIGINT), 99) = g.k GROUP BY 1)
      WINDOW top AS (ORDER BY k DESC)""",
)
_CTES["sweep"] = (
    ("grid",),
    """SELECT k, k / 100e0 AS threshold, tp, flagged,
        CASE WHEN tp > 0 THEN 1.25e0 * (tp / flagged) * (tp / all_pos) / (0.25e0 * (tp / flagged) + tp / all_pos) ELSE 0e0 END AS f05,
        CASE WHEN tp > 0 THEN 2e0 * tp / (flagged + all_pos) ELSE 0e0 END AS f1,
        flagged / total >= 0.5 * all_pos / total AND flagged / total <= 3 * all_pos / total AS admissible
      FROM grid WHERE k >= 1""",
)
_CTES["arrived"] = (
    ("txns",),
    """SELECT *, (epoch_us(date_trunc('second', txn_timestamp)) // 1000000
        + CASE WHEN starts_with(device_id, 'dev_s') THEN 600 ELSE 0 END) // 60 AS minute FROM txns""",
)
_CTES["versions"] = (
    ("txns",),
    """SELECT txn_id, user_id, amount, txn_timestamp AS computed_at FROM txns
      UNION ALL SELECT txn_id, user_id, amount + 1, txn_timestamp + INTERVAL 1 HOUR FROM txns WHERE amount > 200""",
)
_CTES["purchases"] = (
    (),
    """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS txn_id, o_custkey AS user_id,
        l_extendedprice AS amount, l_suppkey AS merchant_id, epoch_us(l_shipdate) AS us, o_orderpriority AS ip_country
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
_CTES["purchase_beh"] = (("purchases",), _behaviour_sql("purchases"))
_CTES["device_hops"] = (
    ("device_pairs", "flagged"),
    """SELECT u.user_id,
        EXISTS (SELECT 1 FROM device_pairs p JOIN flagged f ON f.user_id = p.o WHERE p.u = u.user_id) AS h2,
        u.user_id IN (SELECT a.u FROM device_pairs a JOIN device_pairs b ON a.o = b.u AND b.o <> a.u
                      JOIN flagged f ON f.user_id = b.o) AS h4
      FROM (SELECT DISTINCT user_id FROM txns) u""",
)
_CTES["all_hops"] = (
    ("user_pairs", "flagged", "txns"),
    """SELECT u.user_id,
        EXISTS (SELECT 1 FROM user_pairs p JOIN flagged f ON f.user_id = p.o WHERE p.u = u.user_id) AS h2,
        u.user_id IN (SELECT a.u FROM user_pairs a JOIN user_pairs b ON a.o = b.u AND b.o <> a.u
                      JOIN flagged f ON f.user_id = b.o) AS h4
      FROM (SELECT DISTINCT user_id FROM txns) u""",
)


def _with(body: str, *needs: str) -> str:
    """Prefix the common table expressions a query needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in _CTES[name][0]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    ctes = ",\n".join(f"{name} AS ({_CTES[name][1]})" for name in order)
    return f"WITH {ctes}\n{body}" if order else body


_RECENT = f"scored_at >= {NOW} - INTERVAL 24 HOUR"
_INFER = "coalesce(inference_latency_ms, latency_ms)"
_HOPS = "CAST(CASE WHEN h2 THEN 2 WHEN h4 THEN 4 ELSE 0 END AS BIGINT) AS hop_distance_to_fraud"
_SNAP_COLUMNS = ", ".join(FEATURE_COLUMNS)
_DRIFT_REASON = "last retrain less than {} minutes ago"


def _rate(part: str, whole: str) -> str:
    return f"({part}) * 1e0 / nullif({whole}, 0)"


def _checked_event() -> str:
    """One drift check at the end of the data, from the log, the windowed PSI table and the windowed KS table."""
    resting = f"coalesce({NOW} - (SELECT max(checked_at) FROM drift_log WHERE retrain_triggered) < INTERVAL 60 MINUTE, false)"
    reason = _DRIFT_REASON.format(60)
    return f"""SELECT {NOW} AS checked_at, (SELECT arg_max(model_version, created_at) FROM registry WHERE is_active) AS model_version,
        string_agg(feature || ':' || CAST(CAST(psi AS DECIMAL(10,5)) AS VARCHAR), ',' ORDER BY feature) AS feature_psi,
        max(psi) AS max_feature_psi, {r('avg(psi)')} AS mean_feature_psi,
        (SELECT {r('ks')} FROM w_ks WHERE na >= 20 AND nb >= 20) AS prediction_ks_statistic,
        (SELECT {r('CASE WHEN x < 0.2e0 THEN 1e0 ELSE least(greatest(2 * s, 0e0), 1e0) END')} FROM (
          SELECT any_value(x) AS x, sum((CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * k * k * x * x)) AS s
          FROM (SELECT ks * sqrt(na * nb / (na + nb)) AS x FROM w_ks WHERE na >= 20 AND nb >= 20), range(1, 101) g(k)
          HAVING count(*) > 0)) AS prediction_ks_pvalue,
        max(psi) >= 0.25 OR avg(psi) >= 0.25 AS drift_detected,
        (max(psi) >= 0.25 OR avg(psi) >= 0.25) AND NOT {resting} AS retrain_triggered,
        CASE WHEN (max(psi) >= 0.25 OR avg(psi) >= 0.25) AND {resting} THEN '{reason}' END AS retrain_skipped_reason
      FROM w_psi HAVING (SELECT count(*) FROM w_live_long) >= 20 * {len(FEATURE_COLUMNS)}"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def put(name: str, body: str, *needs: str) -> None:
        out[name] = _with(body, *needs)

    # features
    put("feature_snapshots", f"SELECT txn_id, user_id, txn_timestamp, {_SNAP_COLUMNS} FROM snaps", "snaps")
    for name, columns in {
        "txn_velocity": "txn_velocity_1h, txn_velocity_24h",
        "amount_stats": "amount_mean_24h, amount_std_24h",
        "amount_zscore": "amount_zscore",
        "distinct_merchants": "distinct_merchants_1h, distinct_merchants_24h",
        "seconds_since_last": "seconds_since_last_txn",
        "impossible_travel": "impossible_travel_flag",
    }.items():
        put(name, f"SELECT txn_id, {columns} FROM beh", "beh")
    put(
        "one_user_features",
        """SELECT txn_id, txn_velocity_1h, txn_velocity_24h, amount_mean_24h, amount_std_24h, distinct_merchants_1h,
          distinct_merchants_24h, impossible_travel_flag, seconds_since_last_txn FROM one_user_beh""",
        "one_user_beh",
    )
    put(
        "purchase_behaviour",
        f"""SELECT user_id, count(*) AS purchases, CAST(sum(txn_velocity_24h) AS BIGINT) AS velocity,
          CAST(sum(distinct_merchants_24h) AS BIGINT) AS merchants, {r('sum(amount_mean_24h)')} AS means,
          {r('sum(amount_std_24h)')} AS spreads FROM purchase_beh GROUP BY 1""",
        "purchase_beh",
    )
    put(
        "direct_signals",
        f"""SELECT txn_id, CASE WHEN ip_country <> home_country THEN 1e0 ELSE 0e0 END AS is_foreign_ip,
          {r('ln(1 + amount)')} AS log_amount, CASE WHEN channel = 'card_not_present' THEN 1e0 ELSE 0e0 END AS is_card_not_present,
          CASE WHEN merchant_category IN ('electronics', 'gift_cards', 'crypto', 'jewelry', 'gaming') THEN 1e0 ELSE 0e0 END
            AS is_high_risk_category FROM txns""",
        "txns",
    )
    put("home_country", "SELECT DISTINCT user_id, home_country FROM txns", "txns")
    put(
        "dedup_latest",
        f"""SELECT txn_id, user_id, {r('amount')} AS amount, computed_at FROM (
          SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY computed_at DESC) AS rn FROM versions) WHERE rn = 1""",
        "versions",
    )
    put(
        "latest_features",
        f"""SELECT user_id, txn_id, txn_timestamp + INTERVAL 1 SECOND AS computed_at, txn_velocity_24h, amount_mean_24h,
          distinct_merchants_24h FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, txn_id DESC) AS rn
          FROM beh) WHERE rn = 1 AND txn_timestamp + INTERVAL 1 SECOND >= {NOW} - INTERVAL 48 HOUR""",
        "beh",
    )
    put(
        "asof_features",
        """SELECT asked AS txn_id, CASE WHEN matched THEN txn_id END AS snapshot_key,
          CASE WHEN matched THEN txn_velocity_24h END AS txn_velocity_24h,
          CASE WHEN matched THEN amount_mean_24h END AS amount_mean_24h, matched FROM asof_rows""",
        "asof_rows",
    )
    vector = ", ".join(f"CASE WHEN matched THEN CAST({c} AS DOUBLE) ELSE 0e0 END AS {c}" for c in FEATURE_COLUMNS)
    put("feature_vector", f"SELECT asked AS txn_id, {vector}, NOT matched AS is_cold_start FROM asof_rows", "asof_rows")
    number = "CAST(regexp_extract(txn_id, '([0-9]+)', 1) AS BIGINT)"
    put(
        "feature_contract",
        f"""SELECT * FROM (SELECT txn_id, concat_ws(',',
            CASE WHEN {number} % 97 = 0 THEN 'txn_velocity_1h' END, CASE WHEN {number} % 89 = 0 THEN 'amount_mean_24h' END,
            CASE WHEN {number} % 83 = 0 THEN 'impossible_travel_flag' END,
            CASE WHEN {number} % 73 = 0 THEN 'seconds_since_last_txn' END,
            CASE WHEN {number} % 79 = 0 THEN 'log_amount' END) AS failed FROM txns) WHERE failed <> ''""",
        "txns",
    )
    put(
        "window_scan",
        f"""SELECT txn_id, user_id, {r('amount')} AS amount, txn_timestamp FROM txns
          WHERE txn_timestamp >= TIMESTAMP '2024-01-10' AND txn_timestamp < TIMESTAMP '2024-01-12'""",
        "txns",
    )

    # validation
    put(
        "decode_envelope",
        """SELECT event_id AS "offset", coalesce(err, 'ok') AS status, json_extract_string(data, '$.txn_id') AS txn_id
          FROM decoded""",
        "decoded",
    )
    put(
        "txn_validation",
        f"""SELECT event_id AS "offset", reasons, CASE WHEN ok THEN json_extract_string(data, '$.txn_id') END AS txn_id,
          CASE WHEN ok THEN {_AMOUNT} END AS amount, CASE WHEN ok THEN upper(json_extract_string(data, '$.currency')) END AS currency,
          CASE WHEN ok THEN TRY_CAST(replace({_TS}, 'Z', '') AS TIMESTAMP) END AS txn_timestamp,
          CASE WHEN ok THEN json_extract_string(data, '$.channel') END AS channel FROM validated""",
        "validated",
    )
    put("valid_invalid_counts", "SELECT ok AS valid, count(*) AS rows FROM validated GROUP BY 1", "validated")
    put("dlq_rows", "SELECT * FROM dlq", "dlq")
    put(
        "dlq_by_reason",
        "SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(reason, ',')) AS reason FROM dlq) GROUP BY 1",
        "dlq",
    )
    put(
        "dlq_replay",
        f"""SELECT json_extract_string(data, '$.txn_id') AS txn_id, {_AMOUNT} AS amount, 'upi' AS channel
          FROM validated WHERE reasons = 'enum:channel'""",
        "validated",
    )
    put(
        "integrity_report",
        f"""WITH kept AS (SELECT * FROM txns WHERE txn_timestamp < TIMESTAMP '2024-01-29'),
          p AS (SELECT * REPLACE (CASE WHEN latency_ms > 190 THEN fraud_probability + 1 ELSE fraud_probability END AS fraud_probability) FROM preds),
          l AS (SELECT * FROM labs UNION ALL SELECT * FROM labs WHERE {r('delay_hours', 3)} > 7.5)
        SELECT 'transactions.amount' AS rule, count(*) FILTER (amount < 0) AS violations FROM kept
        UNION ALL SELECT 'transactions.channel', count(*) FILTER (channel NOT IN ('card_present', 'card_not_present', 'upi', 'login')) FROM kept
        UNION ALL SELECT 'transactions.user_id', count(*) FILTER (user_id IS NULL) FROM kept
        UNION ALL SELECT 'transactions.currency', count(*) FILTER (length(currency) <> 3) FROM kept
        UNION ALL SELECT 'transactions.ip_country', count(*) FILTER (length(ip_country) <> 2) FROM kept
        UNION ALL SELECT 'predictions.fraud_probability', count(*) FILTER (fraud_probability NOT BETWEEN 0 AND 1) FROM p
        UNION ALL SELECT 'predictions.latency_ms', count(*) FILTER (latency_ms < 0) FROM p
        UNION ALL SELECT 'predictions.model_version', count(*) FILTER (model_version IS NULL) FROM p
        UNION ALL SELECT 'labels.confirmed_at', count(*) FILTER (confirmed_at IS NULL) FROM l
        UNION ALL SELECT 'transactions.unique_txn_id', count(*) FROM (SELECT 1 FROM kept GROUP BY txn_id HAVING count(*) > 1)
        UNION ALL SELECT 'labels.unique_txn_id', count(*) FROM (SELECT 1 FROM l GROUP BY txn_id HAVING count(*) > 1)
        UNION ALL SELECT 'predictions.txn_exists', count(*) FROM p WHERE txn_id NOT IN (SELECT txn_id FROM kept)
        UNION ALL SELECT 'labels.txn_exists', count(*) FROM l WHERE txn_id NOT IN (SELECT txn_id FROM kept)""".replace(
            "WITH kept", ", kept", 1
        ),
        "txns", "preds", "labs",
    )

    # sinks
    put(
        "insert_ignore",
        f"SELECT txn_id, {r('amount')} AS amount, txn_timestamp FROM txns",
        "txns",
    )
    put(
        "log_predictions",
        f"""SELECT 'transactions' AS "table", count(*) AS rows, {r('sum(t.amount)')} AS total FROM txns t JOIN preds p ON p.txn_id = t.txn_id
            WHERE t.amount < 100 OR p.model_version = '8'
          UNION ALL SELECT 'predictions', count(*), {r('sum(fraud_probability)')} FROM preds""",
        "txns", "preds",
    )
    put(
        "backfill_attributions",
        """SELECT p.txn_id, p.is_flagged, CASE WHEN t.amount > 300 THEN 'log_amount:' || t.merchant_category END AS top_features
          FROM preds p JOIN txns t ON t.txn_id = p.txn_id""",
        "preds", "txns",
    )
    put(
        "stamp_label_time",
        """SELECT p.txn_id, p.model_version, l.confirmed_at AS label_confirmed_at FROM preds p
          LEFT JOIN labs l ON l.txn_id = p.txn_id""",
        "preds", "labs",
    )

    # labels
    put(
        "unlabeled_backlog",
        f"SELECT txn_id, user_id, {r('amount')} AS amount, txn_timestamp FROM backlog ORDER BY txn_timestamp, txn_id LIMIT 500",
        "backlog",
    )
    put("matured_txns", f"SELECT txn_id, {r('age_hours')} AS age_hours, {r('delay_hours')} AS delay_hours FROM matured", "matured")
    put("rule_score", f"SELECT txn_id, {r('score')} AS score FROM scored_rule", "scored_rule")
    put("rule_labels", "SELECT * FROM new_labels", "new_labels")
    put(
        "write_labels",
        """SELECT 'labels' AS "table", count(*) AS rows, count(*) FILTER (is_fraud) AS marked FROM (
            SELECT txn_id, is_fraud FROM labs UNION ALL SELECT txn_id, is_fraud FROM new_labels)
          UNION ALL SELECT 'predictions', (SELECT count(*) FROM preds),
            (SELECT count(*) FROM preds WHERE txn_id IN (SELECT txn_id FROM new_labels))""",
        "labs", "new_labels", "preds",
    )
    put(
        "label_interval_join",
        f"""SELECT t.txn_id, l.is_fraud, t.txn_timestamp, l.at AS confirmed_at FROM txns t JOIN (
            SELECT *, confirmed_at + to_microseconds(CAST(round({r('delay_hours', 3)} * 1200 * 1000000) AS BIGINT)) AS at FROM labs) l
          ON l.txn_id = t.txn_id AND l.at BETWEEN t.txn_timestamp + INTERVAL 1 HOUR AND t.txn_timestamp + INTERVAL 4 HOUR""",
        "txns", "labs",
    )

    # training and evaluation
    numbers = ", ".join(f"CAST(s.{c} AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)
    put(
        "training_frame",
        f"SELECT s.txn_id, {numbers}, l.is_fraud FROM snaps s JOIN labs l ON l.txn_id = s.txn_id",
        "snaps", "labs",
    )
    put(
        "class_balance",
        f"""SELECT rows, n_pos, rows - n_pos AS n_neg, {r('n_pos * 1e0 / rows')} AS fraud_rate,
          {r('(rows - n_pos) * 1e0 / greatest(n_pos, 1)')} AS positive_weight,
          CASE WHEN rows < 1000 THEN 'too_few_rows' WHEN n_pos = 0 OR n_pos = rows THEN 'single_class' ELSE 'ok' END AS verdict
          FROM (SELECT count(*) AS rows, count(*) FILTER (is_fraud) AS n_pos FROM labs)""",
        "labs",
    )
    put(
        "stratified_split",
        f"""SELECT d.txn_id, d.is_fraud, CASE WHEN u <= q[1] THEN 'test' WHEN u <= q[2] THEN 'val' ELSE 'train' END AS part
          FROM (SELECT txn_id, is_fraud, {_uniform("txn_id || '42'")} AS u FROM labs) d
          JOIN (SELECT is_fraud, quantile_cont({_uniform("txn_id || '42'")}, [0.1, 0.30000000000000004]) AS q FROM labs GROUP BY 1) c
          ON c.is_fraud = d.is_fraud""",
        "labs",
    )
    put(
        "threshold_sweep",
        f"""SELECT {r('threshold')} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(flagged AS BIGINT) AS flagged, {r('f05')} AS f05,
          {r('f1')} AS f1, admissible, threshold = coalesce((SELECT threshold FROM sweep WHERE admissible AND f05 > 0
            ORDER BY f05 DESC, k LIMIT 1), 0.5e0) AS chosen FROM sweep""",
        "sweep",
    )
    put(
        "auc",
        f"""SELECT model_version, {r('(sum(CASE WHEN is_fraud THEN rk END) - p * (p + 1) / 2e0) / (p * 1e0 * n)')} AS auc FROM (
            SELECT *, rank() OVER (PARTITION BY model_version ORDER BY fraud_probability)
              + (count(*) OVER (PARTITION BY model_version, fraud_probability) - 1) / 2e0 AS rk,
              count(*) FILTER (is_fraud) OVER (PARTITION BY model_version) AS p,
              count(*) FILTER (NOT is_fraud) OVER (PARTITION BY model_version) AS n FROM scored) GROUP BY model_version, p, n""",
        "scored",
    )
    put(
        "average_precision",
        f"""SELECT model_version, {r('sum(pos / all_pos * tp / flagged)')} AS average_precision FROM (
            SELECT model_version, pos * 1e0 AS pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged,
              sum(pos) OVER (PARTITION BY model_version) * 1e0 AS all_pos FROM (
                SELECT model_version, fraud_probability AS s, count(*) FILTER (is_fraud) AS pos, count(*) AS n FROM scored GROUP BY 1, 2)
            WINDOW w AS (PARTITION BY model_version ORDER BY s DESC)) GROUP BY 1""",
        "scored",
    )
    clipped = "least(greatest(fraud_probability, 1e-15), 1 - 1e-15)"
    put(
        "log_loss",
        f"SELECT {r(f'avg(-CASE WHEN is_fraud THEN ln({clipped}) ELSE ln(1 - {clipped}) END)')} AS log_loss FROM scored",
        "scored",
    )
    put(
        "classification_metrics",
        f"""SELECT tp, fp, fn, tn, coalesce({r('tp * 1e0 / nullif(tp + fp, 0)')}, 0) AS precision,
          coalesce({r('tp * 1e0 / nullif(tp + fn, 0)')}, 0) AS recall, coalesce({r('2e0 * tp / nullif(2 * tp + fp + fn, 0)')}, 0) AS f1
          FROM (SELECT count(*) FILTER (fraud_probability >= 0.5 AND is_fraud) AS tp,
            count(*) FILTER (fraud_probability >= 0.5 AND NOT is_fraud) AS fp,
            count(*) FILTER (fraud_probability < 0.5 AND is_fraud) AS fn,
            count(*) FILTER (fraud_probability < 0.5 AND NOT is_fraud) AS tn FROM scored)""",
        "scored",
    )
    put(
        "confusion_counts",
        """SELECT model_version, count(*) FILTER (is_flagged AND is_fraud) AS tp,
          count(*) FILTER (is_flagged AND NOT is_fraud) AS fp, count(*) FILTER (NOT is_flagged AND is_fraud) AS fn
          FROM scored GROUP BY 1""",
        "scored",
    )
    put(
        "flag_predictions",
        """SELECT p.txn_id, p.model_version, coalesce(g.best_threshold, 0.5e0) AS threshold,
          p.fraud_probability >= coalesce(g.best_threshold, 0.5e0) AS is_flagged
          FROM preds p LEFT JOIN registry g ON g.model_version = p.model_version""",
        "preds", "registry",
    )
    put(
        "shadow_scores",
        f"""SELECT txn_id, {r('fraud_probability')} AS fraud_probability, model_version FROM preds
          UNION ALL SELECT txn_id, {r('fraud_probability / 2')}, 'shadow_9' FROM preds""",
        "preds",
    )
    put(
        "attributions",
        "SELECT txn_id, " + ", ".join(f"{r(f'phi_{c}')} AS phi_{c}" for c in FEATURE_COLUMNS) + " FROM phi",
        "phi",
    )
    put(
        "attribution_summary",
        "UNPIVOT (SELECT " + ", ".join(f"{r(f'avg(abs(phi_{c}))')} AS {c}" for c in FEATURE_COLUMNS)
        + f" FROM phi) ON {_SNAP_COLUMNS} INTO NAME feature VALUE mean_abs_attribution",
        "phi",
    )
    entries = " UNION ALL ".join(
        f"SELECT txn_id, {i} AS pos, '{c}' AS feature, phi_{c} AS a, {c} AS v FROM phi" for i, c in enumerate(FEATURE_COLUMNS)
    )
    put(
        "topk_attributions",
        f"""SELECT txn_id, place, feature, {r('a')} AS attribution, {r('v')} AS feature_value FROM (
            SELECT e.*, row_number() OVER (PARTITION BY e.txn_id ORDER BY round(abs(a), 9) DESC, pos) - 1 AS place
            FROM ({entries}) e JOIN preds p ON p.txn_id = e.txn_id WHERE p.is_flagged) WHERE place < 5""",
        "phi", "preds",
    )

    # registry
    flat = "model_name, model_version, model_uri, is_active, created_at, auc, pr_auc, best_threshold"
    put("registry_upsert", f"SELECT {flat} FROM registry WHERE model_version <> '9' UNION ALL SELECT {flat} FROM challenger", "challenger")
    put("retire_models", f"SELECT {flat} FROM retired", "retired")
    put(
        "registry_update",
        f"""SELECT model_name, model_version, model_uri, CASE WHEN (SELECT bool_or(is_active) FROM challenger) THEN is_active
            ELSE (SELECT g.is_active FROM registry g WHERE g.model_version = retired.model_version) END AS is_active,
            created_at, auc, pr_auc, best_threshold FROM retired WHERE model_version <> '9'
          UNION ALL SELECT {flat} FROM challenger""",
        "retired", "challenger",
    )
    serving = "SELECT * FROM registry WHERE is_active ORDER BY auc DESC NULLS LAST, created_at DESC LIMIT 2"
    put(
        "serving_models",
        f"""SELECT {flat}, row_number() OVER (ORDER BY auc DESC NULLS LAST, created_at DESC) - 1 AS slot FROM ({serving})""",
        "registry",
    )
    put("active_model", "SELECT model_name, model_version, created_at FROM registry WHERE is_active ORDER BY created_at DESC LIMIT 1", "registry")
    put(
        "registry_delta",
        f"""SELECT model_version, 'load' AS action FROM ({serving}) WHERE model_version NOT IN ('7', '8')
          UNION ALL SELECT model_version, 'unload' FROM registry WHERE model_version IN ('7', '8')
            AND model_version NOT IN (SELECT model_version FROM ({serving}))""",
        "registry",
    )
    put(
        "promotion_decision",
        """SELECT c.model_version, coalesce(c.pr_auc, 0e0) AS challenger_pr_auc, g.pr_auc AS champion_pr_auc,
          g.pr_auc IS NULL OR c.pr_auc > g.pr_auc AS promote FROM challenger c LEFT JOIN (
            SELECT * FROM registry WHERE is_active ORDER BY created_at DESC LIMIT 1) g ON true""",
        "challenger", "registry",
    )

    # routing
    put(
        "bandit_posteriors",
        """SELECT g.model_version, CAST(CASE WHEN g.model_version = '8' THEN 0 ELSE 1 END AS BIGINT) AS slot,
          count(*) FILTER (s.is_flagged AND s.is_fraud) + 1e0 AS alpha,
          count(*) FILTER (s.is_flagged <> s.is_fraud) + 1e0 AS beta
          FROM registry g LEFT JOIN scored s ON s.model_version = g.model_version
          WHERE g.model_version IN ('7', '8', '9') GROUP BY 1""",
        "registry", "scored",
    )
    # P(X > Y) of two beta variables with whole parameters, as a sum over the first parameter of X.
    beta = "lgamma({0}) + lgamma({1}) - lgamma({0} + {1})"
    term = (
        f"exp({beta.format('(y.a + i)', '(x.b + y.b)')} - ln(x.b + i) "
        f"- ({beta.format('(1e0 + i)', 'x.b')}) - ({beta.format('y.a', 'y.b')}))"
    )
    routed = f"""SELECT txn_id, CASE WHEN {_uniform('txn_id')} < (
            SELECT sum({term}) FROM posterior x, posterior y, range(100000) g(i)
            WHERE x.model_version = '8' AND y.model_version = '7' AND i < x.a) THEN '8' ELSE '7' END AS model_version FROM txns"""
    put("thompson_route", routed, "txns", "posterior")
    put(
        "serving_modes",
        f"""SELECT txn_id, model_version, false AS is_shadow, 'ab_test' AS mode FROM ({routed})
          UNION ALL SELECT txn_id, '7', false, 'shadow' FROM txns
          UNION ALL SELECT txn_id, 'shadow_8', true, 'shadow' FROM txns""",
        "txns", "posterior",
    )
    put("ab_route", f"SELECT txn_id, CASE WHEN ({_uniform('txn_id')}) * 100 < 30 THEN '8' ELSE '7' END AS model_version FROM txns", "txns")

    # graph
    put("graph_edges", "SELECT user_id, etype, entity_id, first_seen, txns FROM edges", "edges")
    put("flagged_users", "SELECT user_id, flagged_at FROM flagged", "flagged")
    put(
        "shared_device_count",
        """SELECT u.user_id, count(p.o) AS shared_device_count FROM (SELECT DISTINCT user_id FROM txns) u
          LEFT JOIN device_pairs p ON p.u = u.user_id GROUP BY 1""",
        "txns", "device_pairs",
    )
    put(
        "shared_device_count_asof",
        """SELECT t.txn_id, (SELECT count(*) FROM device_pairs p WHERE p.u = t.user_id AND p.ready <= t.us) AS shared_device_count
          FROM txns t""",
        "txns", "device_pairs",
    )
    put(
        "busy_device_count",
        """SELECT u.user_id, count(p.o) AS shared_device_count FROM (SELECT DISTINCT user_id FROM busy_txns) u
          LEFT JOIN busy_device_pairs p ON p.u = u.user_id GROUP BY 1""",
        "busy_txns", "busy_device_pairs",
    )
    put(
        "busy_device_count_asof",
        """SELECT t.txn_id, count(p.o) AS shared_device_count
          FROM busy_txns t LEFT JOIN busy_device_pairs p ON p.u = t.user_id AND p.ready <= t.us GROUP BY 1""",
        "busy_txns", "busy_device_pairs",
    )
    put(
        "merchant_fraud_count",
        """SELECT e.entity_id AS merchant_id, count(DISTINCT f.user_id) AS shared_merchant_fraud_count FROM edges e
          LEFT JOIN flagged f ON f.user_id = e.user_id WHERE e.etype = 'TRANSACTED_AT' GROUP BY 1""",
        "edges", "flagged",
    )
    put("hop_distance", f"SELECT user_id, {_HOPS} FROM device_hops", "txns", "device_hops")
    put("hop_distance_all", f"SELECT user_id, {_HOPS} FROM all_hops", "all_hops")

    # drift
    put(
        "psi_edges",
        f"""SELECT feature, i - 1 AS place, {r('edges[i]')} AS edge FROM (
            SELECT feature, edges, unnest(range(1, len(edges) + 1)) AS i FROM psi_edges)""",
        "psi_edges",
    )
    put("psi_bucket_probs", f"SELECT feature, bucket, {r('prob')} AS prob FROM live_probs", "live_probs")
    band = "CASE WHEN {0} >= 0.25 THEN 'drift' WHEN {0} >= 0.1 THEN 'watch' ELSE 'stable' END AS band"
    put("feature_psi", f"SELECT feature, psi, {band.format('psi')} FROM psi", "psi")
    put("windowed_psi", f"SELECT feature, psi, {band.format('psi')} FROM w_psi", "w_psi")
    put(
        "drift_summary",
        f"""SELECT max(psi) AS max_feature_psi, {r('avg(psi)')} AS mean_feature_psi, {band.format('max(psi)')},
          max(psi) >= 0.25 OR avg(psi) >= 0.25 AS drift_detected FROM psi""",
        "psi",
    )
    put(
        "drift_baseline",
        f"""SELECT (SELECT arg_max(model_version, created_at) FROM registry WHERE is_active) AS model_version, b.feature AS feature_name,
          len(e.edges) AS edges, b.bucket, {r('b.prob')} AS prob
          FROM w_base_probs b JOIN w_psi_edges e ON e.feature = b.feature""",
        "w_base_probs", "w_psi_edges", "registry",
    )
    put(
        "baseline_scores",
        f"""SELECT (SELECT arg_max(model_version, created_at) FROM registry WHERE is_active) AS model_version,
          {r('fraud_probability')} AS score, count(*) AS n FROM preds, created
          WHERE scored_at >= made - INTERVAL 72 HOUR AND scored_at < made GROUP BY fraud_probability""",
        "preds", "created", "registry",
    )
    put(
        "baseline_store",
        """SELECT '8' AS model_version, feature AS feature_name, len(edges) + 1 AS buckets,
          (SELECT count(DISTINCT feature) = 16 FROM psi_edges) AS complete FROM psi_edges""",
        "psi_edges",
    )
    put("ks_statistic", f"SELECT {r('ks')} AS ks_statistic FROM ks", "ks")
    put(
        "ks_pvalue",
        f"""SELECT {r('ks')} AS ks_statistic, {r('least(greatest(2 * sum((CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * k * k * x * x)), 0e0), 1e0)')} AS ks_pvalue
          FROM (SELECT ks, ks * sqrt(na * nb * 1e0 / (na + nb)) AS x FROM ks, (
            SELECT count(*) FILTER (scored_at < {SPLIT_AT}) AS na, count(*) FILTER (scored_at >= {SPLIT_AT}) AS nb FROM preds)),
            range(1, 101) g(k) GROUP BY ks""",
        "ks", "preds",
    )
    put("last_retrain", "SELECT max(checked_at) AS last_retrain_at FROM drift_log WHERE retrain_triggered", "drift_log")
    resting = f"coalesce({NOW} - (SELECT max(checked_at) FROM drift_log WHERE retrain_triggered) < INTERVAL 2880 MINUTE, false)"
    put(
        "retrain_decision",
        f"""SELECT checked_at, model_version, drift_detected, drift_detected AND NOT {resting} AS retrain_triggered,
          CASE WHEN drift_detected AND {resting} THEN '{_DRIFT_REASON.format(2880)}' END AS retrain_skipped_reason FROM drift_log""",
        "drift_log",
    )
    put("drift_check", _checked_event(), "w_psi", "w_live_long", "w_ks", "drift_log", "registry")
    rest = "drift_detected, retrain_triggered, retrain_skipped_reason"
    put(
        "drift_event",
        f"""SELECT checked_at, model_version, CAST(NULL AS VARCHAR) AS feature_psi, max_feature_psi, mean_feature_psi,
            CAST(NULL AS DOUBLE) AS prediction_ks_statistic, CAST(NULL AS DOUBLE) AS prediction_ks_pvalue, {rest} FROM drift_log
          UNION ALL SELECT checked_at, model_version, feature_psi, max_feature_psi, mean_feature_psi, prediction_ks_statistic,
            prediction_ks_pvalue, {rest} FROM ({_checked_event()})
            WHERE (checked_at, model_version) NOT IN (SELECT (checked_at, model_version) FROM drift_log)""",
        "w_psi", "w_live_long", "w_ks", "drift_log", "registry",
    )

    # reports
    put(
        "stats_overview",
        f"""SELECT count(*) AS total_predictions, count(*) FILTER (is_flagged) AS total_flagged,
          {r('avg(latency_ms)', 2)} AS avg_latency_ms, {r('quantile_cont(latency_ms, 0.95)', 2)} AS p95_latency_ms,
          {r('quantile_cont(latency_ms, 0.99)', 2)} AS p99_latency_ms, {r(f'avg({_INFER})', 3)} AS avg_inference_ms,
          {r(f'quantile_cont({_INFER}, 0.99)', 3)} AS p99_inference_ms,
          {r('count(*) FILTER (latency_ms < 100) * 1e0 / nullif(count(*), 0) * 100')} AS sla_compliance_pct
          FROM preds WHERE {_RECENT}""",
        "preds",
    )
    trend = f"""SELECT date_trunc('minute', scored_at) AS minute, count(*) AS total, count(*) FILTER (is_flagged) AS flagged,
          {r('avg(fraud_probability)', 4)} AS avg_prob FROM preds WHERE {_RECENT} GROUP BY 1 ORDER BY 1 DESC LIMIT 60"""
    put("fraud_rate_trend", trend, "preds")
    put(
        "flag_rate_pct",
        f"SELECT minute, total, flagged, {r('flagged * 1e0 / greatest(total, 1) * 100')} AS fraud_rate_pct FROM ({trend})",
        "preds",
    )
    put(
        "latency_timeseries",
        f"""SELECT date_trunc('minute', scored_at) AS minute, {r('avg(latency_ms)', 2)} AS avg_ms,
          {r('quantile_cont(latency_ms, 0.95)', 2)} AS p95_ms, {r('quantile_cont(latency_ms, 0.99)', 2)} AS p99_ms,
          {r(f'avg({_INFER})', 3)} AS avg_inference_ms, {r(f'quantile_cont({_INFER}, 0.99)', 3)} AS p99_inference_ms
          FROM preds WHERE {_RECENT} GROUP BY 1 ORDER BY 1 DESC LIMIT 60""",
        "preds",
    )
    marks = ", ".join(f"{r(f'quantile_cont(latency_ms, {q})')} AS p{n}" for n, q in ((50, 0.5), (95, 0.95), (99, 0.99)))
    put("latency_percentiles", f"SELECT model_version, {marks} FROM preds GROUP BY 1", "preds")
    put(
        "latency_summary",
        f"""SELECT count(*) AS requests, {r('avg(latency_ms)')} AS mean, max(latency_ms) AS max, {marks},
          quantile_cont(latency_ms, 0.99) <= 100 AS within_sla FROM preds""",
        "preds",
    )
    put("latency_sla", "SELECT txn_id, latency_ms, latency_ms < 100 AS sla_met FROM preds ORDER BY txn_id DESC LIMIT 500", "preds")
    split = "SELECT model_version, count(*) AS count FROM (SELECT * FROM preds ORDER BY {} LIMIT {}) GROUP BY 1"
    put("traffic_split", split.format("scored_at DESC, txn_id DESC", 2000), "preds")
    put("traffic_split_by_id", split.format("txn_id DESC", 1000), "preds")
    put(
        "recent_flag_rate",
        f"""SELECT {r('avg(CASE WHEN is_flagged THEN 1e0 ELSE 0e0 END) * 100')} AS flag_rate_pct FROM (
          SELECT * FROM preds ORDER BY scored_at DESC, txn_id DESC LIMIT 1000)""",
        "preds",
    )
    put(
        "recent_predictions",
        f"""SELECT txn_id, {r('fraud_probability')} AS fraud_probability, is_flagged, model_version, latency_ms,
          inference_latency_ms, scored_at FROM preds ORDER BY scored_at DESC, txn_id DESC LIMIT 25""",
        "preds",
    )
    events = "checked_at, model_version, {}, drift_detected, retrain_triggered, retrain_skipped_reason"
    put("recent_drift_events", f"SELECT {events.format('max_feature_psi, mean_feature_psi')} FROM drift_log ORDER BY 1 DESC LIMIT 10", "drift_log")
    put("recent_models", f"SELECT {flat} FROM registry ORDER BY created_at DESC LIMIT 10", "registry")
    hit = "count(*) FILTER (is_flagged AND is_fraud)"
    put(
        "ab_metrics",
        f"""SELECT model_version, count(*) AS predictions, {r(_rate(hit, 'count(*) FILTER (is_flagged AND is_fraud IS NOT NULL)'))} AS precision,
          {r(_rate(hit, 'count(*) FILTER (is_fraud)'))} AS recall, {r('avg(latency_ms)', 2)} AS avg_latency_ms,
          {r(f'avg({_INFER})', 3)} AS avg_inference_ms, count(*) FILTER (is_fraud IS NULL) AS unlabelled_count
          FROM (SELECT p.*, l.is_fraud FROM preds p LEFT JOIN labs l ON l.txn_id = p.txn_id) WHERE {_RECENT} GROUP BY 1""",
        "preds", "labs",
    )
    put(
        "ab_compare",
        f"""SELECT model_version, count(*) AS total_predictions, {r('avg(latency_ms)')} AS avg_latency_ms,
          count(*) FILTER (is_flagged) AS predicted_positives, count(*) FILTER (is_fraud) AS actual_positives, {hit} AS true_positives,
          coalesce({r(_rate(hit, 'count(*) FILTER (is_flagged)'))}, 0) AS precision,
          coalesce({r(_rate(hit, 'count(*) FILTER (is_fraud)'))}, 0) AS recall FROM scored WHERE {_RECENT} GROUP BY 1""",
        "scored",
    )
    put(
        "ab_metrics_all",
        f"""SELECT model_version, count(*) AS count, {r(_rate(hit, 'count(*) FILTER (is_flagged)'))} AS precision,
          {r(_rate(hit, 'count(*) FILTER (is_fraud)'))} AS recall FROM scored GROUP BY 1""",
        "scored",
    )
    stats = f"""count(*) AS txns, {r('sum(amount)')} AS amount_sum, {r('avg(amount)')} AS amount_mean, {r('stddev_pop(amount)')} AS amount_std"""
    put(
        "tumbling_user_24h",
        f"""SELECT user_id, date_trunc('day', txn_timestamp) AS window_start, date_trunc('day', txn_timestamp) + INTERVAL 1 DAY AS window_end,
          {stats} FROM txns GROUP BY 1, 2, 3""",
        "txns",
    )
    put(
        "sliding_user_24h",
        f"""SELECT user_id, start AS window_start, start + INTERVAL 24 HOUR AS window_end, {stats} FROM (
            SELECT t.*, date_trunc('hour', txn_timestamp) - to_hours(CAST(h AS INTEGER)) AS start FROM txns t, range(0, 24) g(h))
          GROUP BY 1, 2, 3""",
        "txns",
    )

    # streaming
    put("src_stream", f"SELECT txn_id, user_id, {r('amount')} AS amount, txn_timestamp, channel FROM txns", "txns")
    put(
        "stream_features",
        """SELECT txn_id, user_id, txn_timestamp, txn_velocity_1h, txn_velocity_24h, amount_mean_24h, amount_std_24h,
          amount_zscore, distinct_merchants_1h, distinct_merchants_24h, impossible_travel_flag, seconds_since_last_txn
          FROM beh""",
        "beh",
    )
    put(
        "stream_labels",
        """SELECT n.txn_id, n.is_fraud, n.label_source, n.delay_hours,
          epoch_ms(CAST(ceil((m.us + m.delay_hours * 3.6e6 * 1e3) / 1000) AS BIGINT)) AS confirmed_at
          FROM new_labels n JOIN matured m ON m.txn_id = n.txn_id""",
        "new_labels", "matured",
    )
    put("stream_pipeline", f"SELECT txn_id, user_id, txn_timestamp, {_SNAP_COLUMNS} FROM wire_snaps", "wire_snaps")
    put(
        "stream_online",
        f"""SELECT txn_id, user_id, txn_timestamp, {_SNAP_COLUMNS} FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY txn_timestamp DESC, txn_id DESC) AS rn FROM wire_snaps)
          WHERE rn = 1 AND txn_timestamp <= {NOW} AND txn_timestamp >= {NOW} - INTERVAL 48 HOUR""",
        "wire_snaps",
    )
    put(
        "stream_quarantine",
        "SELECT raw, reason, '0:' || source_offset AS source_offset, stage FROM dlq",
        "dlq",
    )
    put(
        "late_events",
        """SELECT txn_id, txn_timestamp, minute FROM (SELECT a.*, m.seen FROM arrived a JOIN (
            SELECT minute, max(top) OVER (ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (
              SELECT minute, max(us) AS top FROM arrived GROUP BY 1)) m ON m.minute = a.minute) WHERE us < seen - 30000000""",
        "arrived",
    )
    return out
