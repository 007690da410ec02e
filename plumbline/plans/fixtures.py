"""Inputs derived from the given tables, in SQL both engines read.

Every statement keeps all rows of its source. Faults are planted by rewriting
values, so that checks have something to find at any scale.
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {
    # differential nulls
    "ev_nulls": """SELECT event_id, ts, user_id, event_type, props,
        CASE WHEN event_id % 17 = 0 OR (event_type = 'purchase' AND event_id % 5 = 0) THEN NULL ELSE value END AS value
        FROM {events}""",
    # numeric sentinels
    "li_sent": """SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, l_discount,
        CASE WHEN l_orderkey % 50 = 0 THEN -999.0 WHEN l_orderkey % 70 = 1 THEN 999.0 ELSE l_quantity END AS l_quantity
        FROM {lineitem}""",
    # string sentinels
    "ord_sent": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
        CASE WHEN o_orderkey % 40 = 0 THEN 'NA' WHEN o_orderkey % 40 = 1 THEN '' WHEN o_orderkey % 40 = 2 THEN '.'
             ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    # date sentinels
    "ord_dates": """SELECT o_orderkey, o_orderstatus,
        CASE WHEN o_orderkey % 60 = 0 THEN DATE '1970-01-01' WHEN o_orderkey % 90 = 1 THEN DATE '9999-12-31'
             ELSE CAST(o_orderdate AS DATE) END AS o_day
        FROM {orders}""",
    # right side of a join where some keys never match
    "cust_miss": """SELECT CASE WHEN c_custkey % 11 = 0 OR (c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0)
             THEN c_custkey + 900000000 ELSE c_custkey END AS k, c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM {customer}""",
    # keys spoiled by formatting
    "cust_padded": """SELECT CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR(20)), 12, '0')
             ELSE CAST(c_custkey AS VARCHAR(20)) || ' ' END AS k, c_name FROM {customer}""",
    "ord_custkeys": "SELECT CAST(o_custkey AS VARCHAR(20)) AS k, o_orderkey FROM {orders}",
    # per-order counts and rates
    "ord_rates": """SELECT l_orderkey, count(*) AS n_lines,
        sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned,
        sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS n_disc,
        count(*) + l_orderkey % 17 AS n_items, sum(l_quantity) AS qty
        FROM {lineitem} GROUP BY l_orderkey""",
    "rates": """SELECT l_orderkey, CAST(n_lines AS DOUBLE) AS n_lines, CAST(n_items AS DOUBLE) AS n_items,
        CAST(n_returned AS DOUBLE) AS n_returned, CAST(n_disc AS DOUBLE) AS n_disc,
        n_returned / CAST(n_items AS DOUBLE) AS n_returned_rate, n_disc / CAST(n_items AS DOUBLE) AS n_disc_rate,
        qty, qty / (CAST(n_items AS DOUBLE) + 0.5) AS qty_per FROM {ord_rates}""",
    # user by day panel with staggered adoption
    "panel": """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS y,
        max(CASE WHEN user_id % 4 > 0 AND CAST(ts AS DATE) >= DATE '2024-01-08' + CAST(5 * (user_id % 4) AS INT)
            THEN 1 ELSE 0 END) AS treat, max(user_id % 5) AS site, max(CASE WHEN user_id % 5 < 2 THEN 1 ELSE 0 END) AS fixed
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    # two-arm assignment
    "arms": """SELECT event_id, ts, user_id, event_type, value, CAST(user_id % 2 AS INT) AS arm,
        CASE WHEN event_id % 10 < 4 THEN 1 ELSE 0 END AS arm_odd,
        CASE WHEN user_id % 2 = 1 AND event_id % 5 = 0 THEN NULL
             WHEN user_id % 2 = 0 AND event_id % 9 = 0 THEN NULL ELSE value END AS y,
        CASE WHEN (user_id % 2 = 1 AND event_id % 4 > 0) OR (user_id % 2 = 0 AND event_id % 10 = 0) THEN 1 ELSE 0 END AS took
        FROM {events}""",
    # sampled events with weights
    "ev_w": "SELECT event_id, ts, user_id, event_type, value, CAST(1 + event_id % 4 AS DOUBLE) AS w FROM {events}",
    # second coder
    "coders": """SELECT doc_id, quality AS c1,
        CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 1 - quality ELSE quality END AS c2,
        CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS c3, toxic
        FROM {labels}""",
    # planted slice
    "ev_fail": """SELECT event_id, ts, user_id, event_type, value, CAST(user_id % 7 AS INT) AS region,
        CAST(event_id % 3 AS INT) AS build, hour(ts) AS hr,
        CASE WHEN event_id % 10 = 0 OR (event_type = 'error' AND event_id % 4 = 0) THEN 1 ELSE 0 END AS fail
        FROM {events}""",
    # at-least-once delivery
    "ev_replay": """SELECT event_id, ts, user_id, event_type, value, 0 AS attempt FROM {events}
        UNION ALL SELECT event_id, ts, user_id, event_type, value, 1 AS attempt FROM {events} WHERE event_id % 20 = 0""",
    # a boolean flag saying whether a count was taken
    "ev_obs": """SELECT event_id, event_type, user_id, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE value END AS value,
        CASE WHEN event_id % 12 = 0 OR event_type = 'signup' AND event_id % 5 = 0 THEN 0 ELSE 1 END AS observed
        FROM {events}""",
    # documents read twice, with field-level faults in the second pass
    "second_read": """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'xx' ELSE lang END AS lang,
        CASE WHEN doc_id % 29 = 0 THEN NULL ELSE source END AS source, n_chars + CASE WHEN doc_id % 37 = 0 THEN 1 ELSE 0 END AS n_chars
        FROM {documents}""",
    # one catalogue entry per document, some of them malformed
    "catalogue": """SELECT doc_id, source AS folder,
        CASE WHEN doc_id % 11 = 0 THEN upper(source) WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN source || '-admin' ELSE source END AS name,
        CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN '<b>' || lang || '</b> texts' WHEN doc_id % 27 = 0 THEN text ELSE lang || ' texts' END AS description
        FROM {documents}""",
    # claims in prose about the same quantity, some out of date
    "claims": """SELECT o_orderkey AS doc_id, 'In this report the total for customer_' || CAST(o_custkey AS VARCHAR(20)) || ' is ' ||
        CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_custkey * 7 + 1 ELSE o_custkey * 7 END AS VARCHAR(20)) || ', as printed before.' AS text FROM {orders}""",
    # scale items per order
    "items": """SELECT l_orderkey, count(*) AS i1, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS i2,
        sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS i3, sum(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) AS i4 FROM {lineitem} GROUP BY l_orderkey""",
    # machine labels for every labelled document, gold for a quarter chosen by hash
    "surrogate": """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 1 - quality ELSE quality END AS machine,
        CASE WHEN substr(md5(CAST(doc_id AS VARCHAR(20))), 1, 1) < '4' THEN quality END AS gold, toxic, quality FROM {labels}""",
    # sampled orders with inclusion probability proportional to price
    "sampled": """SELECT o_orderkey, o_totalprice, 0.25 + 0.5 * (o_totalprice / 500000.0) AS pi FROM {orders}
        WHERE CAST(o_orderkey % 1000 AS DOUBLE) / 1000.0 < 0.25 + 0.5 * (o_totalprice / 500000.0)""",
    # customers' addresses and a suppression list in mixed case
    "addresses": "SELECT c_custkey, lower(replace(c_name, '#', '')) || '@example.org' AS address FROM {customer}",
    "suppression": """SELECT upper(replace(c_name, '#', '')) || '@Example.org' AS address, CASE WHEN c_custkey % 2 = 0 THEN 'hard_bounce' ELSE 'complaint' END AS reason,
        CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE NULL END AS expires_at
        FROM {customer} WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'""",
    # per-day timings of three arms taken from events of three kinds
    "timings": """SELECT CAST(ts AS DATE) AS round, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'a2' ELSE 'b' END AS arm, value AS seconds
        FROM {events} WHERE event_type IN ('click', 'view', 'purchase')""",
    # two spellings of the same parts; the second side is misspelt, partly re-blocked and partly null
    "link_left": """SELECT p_partkey AS lid, p_brand AS block, p_name || ' ' || substr(md5(CAST(p_partkey AS VARCHAR(20))), 1, 8) AS name,
        CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS size FROM {part}""",
    "link_right": """SELECT p_partkey + 5000000 AS rid, CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_brand = 'Brand#1' THEN 'Brand-1' ELSE p_brand END AS block,
        CASE WHEN p_partkey % 4 = 1 THEN replace(p_name, 'e', '') || ' ' || substr(md5(CAST(p_partkey AS VARCHAR(20))), 1, 8)
             WHEN p_partkey % 4 = 2 THEN p_name || ' ' || substr(md5(CAST(p_partkey AS VARCHAR(20))), 1, 7)
             WHEN p_partkey % 4 = 3 THEN p_name || ' ' || substr(md5(CAST(p_partkey AS VARCHAR(20))), 2, 7)
             ELSE p_name || ' ' || substr(md5(CAST(p_partkey AS VARCHAR(20))), 1, 8) END AS name,
        p_size AS size FROM {part}""",
    # per-nation results, and prose stating them
    "nat": """SELECT c_nationkey AS k, count(*) AS n_orders, CAST(sum(o_custkey) AS BIGINT) AS key_sum, CAST(max(o_orderkey) AS BIGINT) AS last_key
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey""",
    "paragraphs": """SELECT CAST(k AS BIGINT) AS para_id, CASE WHEN k % 9 = 4 THEN 'totals' WHEN k % 9 = 7 THEN 'coast/wrong' WHEN k % 2 = 0 THEN 'report/coast/nation_' || CAST(k AS VARCHAR(9))
          ELSE 'nation_' || CAST(k AS VARCHAR(9)) || '.txt' END AS cited_path,
        'By 1997 the keys had grown 8.75' || chr(92) || '% up to ' || CAST(CASE WHEN k % 5 = 1 THEN key_sum + CAST(floor(key_sum / 90.0) AS BIGINT) ELSE key_sum END AS VARCHAR(20))
          || ' over ' || CAST(n_orders AS VARCHAR(20)) || ' orders ' || chr(92) || 'ref' || chr(123) || 'tab:x12345' || chr(125)
          || CASE WHEN k % 7 = 3 THEN ', with ' || CAST(987654 + k AS VARCHAR(20)) || ' left' ELSE '' END || '.' AS text FROM {nat}""",
    # every document as a file, beside a file per folder whose name alone does not tell which; and manuscripts that restate
    # the documents with 7 turned into 8 and cite the files in several ways, some of which lead nowhere
    "files": """SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/d' || CAST(doc_id AS VARCHAR(20)) || '.tex' AS path, text AS body FROM {documents} WHERE text IS NOT NULL
        UNION ALL SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/notes.tex', 'texts ' || CAST(count(*) AS VARCHAR(20)) FROM {documents} GROUP BY coalesce(source, 'none'), coalesce(lang, 'xx')""",
    "manuscripts": """SELECT doc_id, 'As ' || chr(92) || CASE doc_id % 8 WHEN 0 THEN 'ref' || chr(123) || 'tab:' || name WHEN 1 THEN 'cref' || chr(123) || 'sec:x, tab:' || name
          WHEN 2 THEN 'input' || chr(123) || lang || '/' || name WHEN 3 THEN 'input' || chr(123) || './' || source || '//' || lang || '/' || name || '.tex' WHEN 4 THEN 'input' || chr(123) || 'report/' || source || '/' || lang || '/' || name
          WHEN 5 THEN 'input' || chr(123) || 'notes' WHEN 6 THEN 'ref' || chr(123) || 'tab:lost' || name ELSE 'input' || chr(123) || 'lost/' || name END || chr(125) || ' says, ' || body || chr(10) || chr(10)
          || chr(92) || 'begin' || chr(123) || 'table' || chr(125) || chr(92) || 'label' || chr(123) || 'tab:' || name || chr(125) || chr(92) || 'input' || chr(123) || source || '/' || lang || '/' || name || '.tex' || chr(125) || chr(92) || 'end' || chr(123) || 'table' || chr(125) AS text
        FROM (SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR(20)) AS name, coalesce(source, 'none') AS source, coalesce(lang, 'xx') AS lang,
            replace(replace(replace(replace(text, chr(92), ''), '%', ''), chr(96), ''), '7', '8') AS body FROM {documents} WHERE text IS NOT NULL) q""",
}
