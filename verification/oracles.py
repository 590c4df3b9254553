"""The SQL that gives each query's result on the same tables."""

from __future__ import annotations

from verification.stand_ins import DS, SPOILED_EVENTS_SQL


def _report(measures: str, rules: list[tuple[str, str, str, str, str, str]]) -> str:
    """One row per rule: name, type, column, observed, threshold and verdict over ``m``."""
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, '{kind}' AS rule_type, '{column}' AS \"column\","
        f" ({observed})::DOUBLE AS observed, {threshold}::DOUBLE AS threshold,"
        f" ({observed}) {verdict} {threshold} AS ok FROM m"
        for name, kind, column, observed, threshold, verdict in rules
    )
    return f"WITH e AS ({SPOILED_EVENTS_SQL}), m AS ({measures}) {rows}"


def _filled(column: str, minimum: str) -> tuple[str, str, str, str, str, str]:
    name = f"filled_ratio({column})>={minimum}"
    return name, "filled_ratio", column, f"n_{column}::DOUBLE / n", minimum, ">="


def _value(op: str) -> tuple[str, str, str, str, str, str]:
    name = f"value_ratio(score {op} 50.0)>=0.25"
    return name, "value_ratio", "score", f"n_{op}::DOUBLE / n", "0.25", ">="


def _percentile(column: str, p: str, maximum: str) -> str:
    table = "e" if column == "score" else "lineitem"
    name = f"max_percentile({column},p={p})<={maximum}"
    return f"""
        SELECT '{name}' AS rule, 'max_percentile' AS rule_type, '{column}' AS "column",
               quantile_disc({column}, {p})::DOUBLE AS observed,
               {maximum}::DOUBLE AS threshold,
               quantile_disc({column}, {p}) <= {maximum} AS ok
        FROM {table}"""


_POS = """
    SELECT o_orderkey::VARCHAR AS transaction_id, o_custkey::VARCHAR AS user_id,
           o_orderpriority AS store_id, o_totalprice AS amount, o_orderstatus AS currency
"""

_CRM = """
    SELECT c_custkey::VARCHAR AS user_id, c_name AS email, c_nationkey::VARCHAR AS country
"""

_WEB = """
    SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type,
           ts::DATE::VARCHAR AS ds, props FROM events
"""

_LANDED = """
    SELECT nullif(event_id, 0)::VARCHAR AS event_id, user_id::VARCHAR AS user_id,
           event_type, props, ts::DATE::VARCHAR AS ds FROM events
"""

_OVERWRITTEN = f"""
    WITH landed AS ({_LANDED})
    SELECT * FROM landed WHERE ds <> '2024-01-05'
    UNION ALL
    SELECT event_id, user_id, event_type, 'fresh' AS props, ds FROM landed
    WHERE ds = '2024-01-05' AND event_type <> 'error'
"""

_MERGED = f"""
    WITH landed AS ({_LANDED}),
    held AS (SELECT event_id, user_id, 'old' AS event_type, props, 'first' AS note
             FROM landed WHERE event_type <> 'signup'),
    source AS (SELECT event_id, user_id, event_type, props FROM landed
               WHERE event_type <> 'view')
    SELECT event_id, user_id, 'old' AS event_type, props, 'first' AS note,
           '2024-01-31' AS ds FROM landed
    UNION ALL
    SELECT held.event_id,
           CASE WHEN source.event_type IS NULL THEN held.user_id ELSE source.user_id END,
           coalesce(source.event_type, held.event_type),
           CASE WHEN source.event_type IS NULL THEN held.props ELSE source.props END,
           held.note, '{DS}'
    FROM held LEFT JOIN source ON held.event_id IS NOT DISTINCT FROM source.event_id
    UNION ALL
    SELECT event_id, user_id, event_type, props, NULL, '{DS}' FROM source
    WHERE NOT EXISTS (SELECT 1 FROM held
                      WHERE held.event_id IS NOT DISTINCT FROM source.event_id)
"""

ORACLES: dict[str, str] = {
    "web_events_transform": _WEB,
    "pos_transactions_transform": f"{_POS}, o_orderdate::DATE::VARCHAR AS ds FROM orders",
    "crm_users_transform": f"""{_CRM},
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '{DS}'
             ELSE '2024-01-15' END AS ds
        FROM customer""",
    "event_date_fallback": f"""
        SELECT event_id, coalesce(try_cast(
                   CASE event_type WHEN 'error' THEN '34' WHEN 'click' THEN ''
                        WHEN 'purchase' THEN '2024-02-30'
                        WHEN 'view' THEN ts::DATE::VARCHAR END AS DATE),
                   DATE '{DS}')::VARCHAR AS ds
        FROM events""",
    "ingestion_meta": f"""
        SELECT event_id, 'run-1' AS _run_id, '{DS}' AS ds, true AS has_ingest_ts
        FROM events""",
    "single_partition": f"SELECT * FROM ({_WEB}) WHERE ds = '2024-01-05'",
    "csv_roundtrip": """
        SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id,
               ts::VARCHAR AS ts, event_type, props
        FROM events""",
    "csv_by_position": """
        SELECT o_orderkey::VARCHAR AS transaction_id, o_custkey::VARCHAR AS user_id,
               o_orderpriority AS store_id,
               CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS amount,
               o_orderstatus AS currency, '2024-01-01' AS "timestamp"
        FROM orders""",
    "csv_missing_columns": """
        SELECT c_custkey::VARCHAR AS user_id,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'null'
                    WHEN c_mktsegment <> 'MACHINERY' THEN c_name END AS email,
               true AS country_is_null, true AS created_at_is_null
        FROM customer""",
    "dq_filled_ratio": _report(
        """SELECT count(*) AS n, count(event_id) AS n_event_id,
                  count(*) FILTER (WHERE length(trim(label)) > 0) AS n_label,
                  count(score) AS n_score, count(actor) AS n_actor FROM e""",
        [
            _filled("event_id", "0.999"),
            _filled("label", "0.75"),
            _filled("score", "0.5"),
            _filled("actor", "0.85"),
        ],
    ),
    "dq_value_ratio": _report(
        """SELECT count(*) AS n, count(*) FILTER (WHERE score > 50) AS n_gt,
                  count(*) FILTER (WHERE score >= 50) AS n_gte,
                  count(*) FILTER (WHERE score < 50) AS n_lt,
                  count(*) FILTER (WHERE score <= 50) AS n_lte,
                  count(*) FILTER (WHERE score = 50) AS n_eq,
                  count(*) FILTER (WHERE score <> 50) AS n_neq FROM e""",
        [_value(op) for op in ("gt", "gte", "lt", "lte", "eq", "neq")],
    ),
    "dq_max_percentile": f"WITH e AS ({SPOILED_EVENTS_SQL})"
    + " UNION ALL ".join(
        _percentile(*rule)
        for rule in (
            ("score", "0.5", "40.0"),
            ("score", "0.9", "40.0"),
            ("score", "0.999", "1000.0"),
            ("score", "1.0", "100.0"),
            ("l_extendedprice", "0.25", "50000.0"),
            ("l_extendedprice", "0.999", "50000.0"),
            ("l_linenumber", "0.75", "6.0"),
        )
    ),
    "dq_landed_percentiles": f"""
        WITH l AS (SELECT CASE WHEN ts::DATE = DATE '2024-01-05' THEN score + 1000 ELSE score END AS score,
                          actor::DOUBLE AS actor, ts::DATE AS d FROM ({SPOILED_EVENTS_SQL})),
        m AS (SELECT count(DISTINCT d)::INTEGER AS profiled, max((d = DATE '2024-01-05')::INTEGER) AS again FROM l)"""
    + " UNION ALL ".join(
        f"""
        SELECT 'max_percentile({column},p={p})<={shown}' AS rule, quantile_disc({column}, {p}) <= {top} AS ok,
               count({column}) AS numbers, quantile_disc({column}, {p})::DOUBLE AS observed,
               true AS bracketed, any_value(profiled) AS profiled, any_value(again) AS again
        FROM l, m"""
        for column, p, top, shown in (
            ("score", "0.5", "40", "40.0"),
            ("score", "0.9", "2000", "2000.0"),
            ("score", "0.25", "1", "1.0"),
            ("score", "1.0", "100", "100.0"),
            ("actor", "0.75", "1e9", "1.0E9"),
        )
    ),
    "dq_documents": """
        WITH d AS (SELECT length(text) AS length, lang, n_chars, text FROM documents),
        m AS (SELECT count(*)::DOUBLE AS n,
                     count(*) FILTER (WHERE lang <> 'de' AND length(trim(text, ' ')) > 0)
                         AS filled,
                     count(*) FILTER (WHERE length >= 100) AS long,
                     count(*) FILTER (WHERE lang <> 'fr' AND n_chars < 5000) AS short,
                     quantile_disc(length, 0.5)::DOUBLE AS half,
                     quantile_disc(length, 0.999)::DOUBLE AS top FROM d)
        SELECT 'filled_ratio(text)>=0.5' AS rule, 'filled_ratio' AS rule_type,
               'text' AS "column", filled / n AS observed, 0.5::DOUBLE AS threshold,
               filled / n >= 0.5 AS ok FROM m
        UNION ALL SELECT 'value_ratio(length gte 100.0)>=0.9', 'value_ratio', 'length',
               long / n, 0.9, long / n >= 0.9 FROM m
        UNION ALL SELECT 'value_ratio(n_chars lt 5000.0)>=0.25', 'value_ratio', 'n_chars',
               short / n, 0.25, short / n >= 0.25 FROM m
        UNION ALL SELECT 'max_percentile(length,p=0.5)<=1000.0', 'max_percentile', 'length',
               half, 1000, half <= 1000 FROM m
        UNION ALL SELECT 'max_percentile(length,p=0.999)<=1000000.0', 'max_percentile',
               'length', top, 1000000, top <= 1000000 FROM m""",
    "dq_report": """
        WITH c AS (SELECT count(*)::DOUBLE AS n,
                          count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS filled
                   FROM customer),
        o AS (SELECT count(*)::DOUBLE AS n,
                     count(*) FILTER (WHERE o_totalprice > 0 AND o_orderstatus <> 'F') AS good,
                     quantile_disc(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END, 0.999)
                         AS q
              FROM orders)
        SELECT 'crm_users' AS item, 'filled_ratio(user_id)>=0.999' AS rule,
               'filled_ratio' AS rule_type, 1.0::DOUBLE AS observed, true AS ok FROM c
        UNION ALL SELECT 'crm_users', 'filled_ratio(email)>=0.98', 'filled_ratio',
               filled / n, filled / n >= 0.98 FROM c
        UNION ALL SELECT 'pos_transactions', 'value_ratio(amount gt 0.0)>=0.98',
               'value_ratio', good / n, good / n >= 0.98 FROM o
        UNION ALL SELECT 'pos_transactions', 'max_percentile(amount,p=0.999)<=5000.0',
               'max_percentile', q, q <= 5000 FROM o
        UNION ALL SELECT 'web_events', 'filled_ratio(event_id)>=0.999', 'filled_ratio',
               count(event_id)::DOUBLE / count(*), count(event_id) >= 0.999 * count(*)
        FROM events""",
    "dq_gate": """
        SELECT * FROM (
            SELECT 'crm_users' AS item, 'filled_ratio(email)>=0.98' AS failed_rule,
                   count(*) FILTER (WHERE c_mktsegment <> 'BUILDING')::DOUBLE / count(*)
                       AS observed, false AS ok
            FROM customer) WHERE observed < 0.98
        UNION ALL SELECT * FROM (
            SELECT 'pos_transactions', 'value_ratio(amount gt 0.0)>=0.98',
                   count(*) FILTER (WHERE o_totalprice > 0 AND o_orderstatus <> 'F')::DOUBLE
                       / count(*) AS observed, false
            FROM orders) WHERE observed < 0.98
        UNION ALL SELECT * FROM (
            SELECT 'pos_transactions', 'max_percentile(amount,p=0.999)<=5000.0',
                   quantile_disc(o_totalprice, 0.999) AS observed, false
            FROM orders WHERE o_orderstatus <> 'F') WHERE observed > 5000""",
    "metadata_rules": """
        WITH items AS (SELECT event_type AS item, max(user_id)::VARCHAR AS top
                       FROM events GROUP BY event_type)
        SELECT 'analytics' AS domain, 'web' AS "groupName", item AS "itemName",
               'silver.' || item AS "outputTable", 'filled_ratio' AS "ruleType",
               'props' AS "column", '0.98' AS "min", NULL AS p, NULL AS "max" FROM items
        UNION ALL
        SELECT 'analytics', 'web', item, 'silver.' || item, 'max_percentile',
               'value', NULL, '1.0', top FROM items""",
    "dedupe_latest": """
        SELECT user_id, event_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id
                                   ORDER BY ts DESC, event_id DESC, event_type DESC) = 1""",
    "dedupe_composite": """
        SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM lineitem
        QUALIFY row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC
        ) = 1""",
    "dedupe_null_keys": f"""
        SELECT actor::VARCHAR AS actor, event_id, score FROM ({SPOILED_EVENTS_SQL})
        QUALIFY row_number() OVER (PARTITION BY actor
                                   ORDER BY score DESC NULLS LAST, event_id DESC) = 1""",
    "overwrite_one_partition": _OVERWRITTEN,
    "overwrite_catalog_partition": _OVERWRITTEN,
    "merge_path_partition": _MERGED,
    "merge_rerun": _MERGED,
    "merge_catalog_partition": _MERGED,
    "merge_bucketed": _MERGED,
    "merge_hot_key": f"""
        WITH e AS ({SPOILED_EVENTS_SQL})
        SELECT actor::VARCHAR AS actor, event_id::VARCHAR AS event_id, 'updated' AS label,
               'run' AS tag, '{DS}' AS ds FROM e
        UNION ALL
        SELECT DISTINCT (-actor - 1)::VARCHAR, NULL, 'added', 'run', '{DS}' FROM e
        WHERE actor IS NOT NULL""",
    "merge_few_corrections": f"""
        SELECT event_id, event_type,
               CASE WHEN ts::DATE = DATE '2024-01-05' THEN -value ELSE value END AS value,
               '{DS}' AS ds FROM events
        UNION ALL
        SELECT -event_id - 1, NULL, value, '{DS}' FROM events
        WHERE ts::DATE = DATE '2024-01-05'""",
    "csv_malformed": """
        WITH l AS (
            SELECT *, event_id::VARCHAR AS id, CASE WHEN event_type <> 'click' THEN user_id::VARCHAR END AS usr, ts::DATE::VARCHAR AS d
            FROM events),
        m AS (
            SELECT id AS event_id, usr AS user_id,
                   CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
                   CASE WHEN event_type <> 'error' THEN d END AS day,
                   CASE event_type WHEN 'error' THEN id || ',' || usr
                                   WHEN 'signup' THEN concat_ws(',', id, usr, event_type, d, 'surplus')
                                   WHEN 'click' THEN concat_ws(',', id, 'none', event_type, d) END AS line
            FROM l)
        SELECT *, count(line) OVER () / count(*) OVER ()::DOUBLE AS share,
               count(line) OVER () <= 0.01 * count(*) OVER () AS few_ok, true AS some_ok FROM m""",
    "merge_touched_files": f"""
        WITH hit AS (SELECT event_id FROM events WHERE ts::DATE = DATE '2024-01-05'),
        rewritten AS (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS files_rewritten FROM hit)
        SELECT event_id, event_type, CASE WHEN event_id IN (FROM hit) THEN -value ELSE value END AS value,
               '{DS}' AS ds, files_rewritten FROM events, rewritten
        UNION ALL
        SELECT -event_id - 1, NULL, value, '{DS}', files_rewritten FROM events, rewritten WHERE event_id IN (FROM hit)""",
    "overwrite_predicate": f"""
        WITH landed AS ({_LANDED}),
        hit AS (SELECT * FROM landed WHERE event_type = 'error' AND ds BETWEEN '2024-01-03' AND '2024-01-07')
        SELECT event_id, user_id, event_type, props, ds FROM landed
        WHERE NOT (event_type = 'error' AND ds BETWEEN '2024-01-03' AND '2024-01-07')
        UNION ALL
        SELECT min(event_id), user_id, 'error', 'fresh', min(ds) FROM hit GROUP BY user_id""",
    "merge_backfill": f"""
        WITH landed AS ({_LANDED})
        SELECT event_id, user_id,
               CASE WHEN ds BETWEEN '2024-01-03' AND '2024-01-07' AND event_type <> 'view' THEN event_type ELSE 'old' END AS event_type,
               props, 'first' AS note, ds FROM landed
        UNION ALL
        SELECT event_id, user_id, event_type, props, NULL, '2025-01-01' FROM landed WHERE ds = '2024-01-05'""",
    "web_events_job": f"""
        SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id,
               CASE WHEN first_only THEN event_type ELSE 'late' END AS event_type,
               '{DS}' AS ds, props, true AS _ingest_ts,
               CASE WHEN first_only THEN 'run-1' ELSE 'run-2' END AS _run_id
        FROM (SELECT *, props = '{{"k": 1}}' AND event_type <> 'signup' AS first_only FROM events)""",
    "pos_transactions_job": f"""{_POS.replace("o_orderstatus AS currency",
        "CASE WHEN o_orderstatus <> 'O' THEN 'EUR' ELSE 'O' END AS currency")},
        '{DS}' AS ds, true AS _ingest_ts,
        CASE WHEN o_orderstatus <> 'O' THEN 'run-2' ELSE 'run-1' END AS _run_id
        FROM orders""",
    "crm_users_job": f"""{_CRM}, '{DS}' AS ds, true AS _ingest_ts,
        CASE WHEN c_nationkey <> 5 THEN 'run-2' ELSE 'run-1' END AS _run_id
        FROM customer""",
    "crm_users_catalog_job": f"""{_CRM}, '{DS}' AS ds, true AS _ingest_ts,
        CASE WHEN c_nationkey <> 5 THEN 'run-2' ELSE 'run-1' END AS _run_id
        FROM customer""",
    "gate_shut_job": f"""{_CRM}, '{DS}' AS ds, true AS _ingest_ts, 'run-1' AS _run_id,
        'DQ failed: filled_ratio(email)>=0.98' AS message
        FROM customer""",
    "merge_composite": f"""
        WITH held AS (
            SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS line,
                   l_quantity AS quantity, l_shipdate::VARCHAR AS l_shipdate
            FROM lineitem),
        known AS (
            SELECT l_orderkey, line, max(-quantity) AS quantity
            FROM held WHERE quantity > 25 GROUP BY l_orderkey, line)
        SELECT h.l_orderkey, h.line::VARCHAR AS line, coalesce(k.quantity, h.quantity) AS quantity,
               l_shipdate, '{DS}' AS ds
        FROM held h LEFT JOIN known k
          ON k.l_orderkey = h.l_orderkey AND k.line IS NOT DISTINCT FROM h.line
        UNION ALL
        SELECT -l_orderkey - 1, line::VARCHAR, quantity, NULL, '{DS}' FROM known""",
}
