"""SQL for DuckDB that computes what the queries compute.

Written independently of the operators: plain windows and joins, no splitting or salting.
"""

from __future__ import annotations

HOUR = 3_600_000
DAY = 86_400_000
PEER = 8
FIRST_DAY = 1_704_067_200_000

# The activity table as messages and connection events.
MESSAGES = """
act AS (
  SELECT event_id AS pos, epoch_us(ts) // 1000 AS ts_ms, user_id AS peer_id, event_type,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents,
         event_type IN ('view', 'click', 'purchase') AS is_msg
  FROM events),
named AS (
  SELECT *, CASE WHEN is_msg THEN event_type
                 WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'inbound' ELSE 'outbound' END
                 ELSE CASE k % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'inbound_evicted' ELSE 'misbehaving' END
            END AS kind
  FROM act),
m AS (
  SELECT pos, ts_ms, peer_id, 'ebpf' AS category,
         CASE WHEN is_msg THEN 'message' ELSE 'connection' END AS event_group, kind,
         CASE WHEN is_msg THEN kind ELSE 'connection ' || kind END AS label,
         CASE WHEN kind <> 'misbehaving'
              THEN '10.' || (peer_id % 4) || '.0.' || (peer_id % 251) || ':8333' END AS addr,
         CASE WHEN kind <> 'misbehaving' THEN
           CASE k % 5 WHEN 0 THEN 'inbound' WHEN 1 THEN 'outbound-full-relay'
                      WHEN 2 THEN 'block-relay-only' WHEN 3 THEN 'feeler' ELSE 'unknown' END END AS conn_type,
         CASE WHEN NOT is_msg AND kind <> 'misbehaving' THEN CAST(1 AS INTEGER) END AS network,
         CASE WHEN is_msg THEN k % 2 = 0 END AS inbound,
         CASE WHEN is_msg THEN cents END AS size,
         CASE WHEN kind IN ('closed', 'inbound_evicted') THEN ts_ms // 1000 - k * 60 END AS established_s,
         CASE WHEN kind IN ('inbound', 'outbound') THEN k END AS existing_connections,
         CASE WHEN kind = 'misbehaving' THEN 'k=' || k END AS misbehaviour, k
  FROM named)
"""

PEERS = """
p AS (
  SELECT peer_id,
    arg_max(addr, pos) FILTER (addr IS NOT NULL) AS addr,
    arg_max(conn_type, pos) FILTER (conn_type IS NOT NULL) AS conn_type,
    arg_max(network, pos) FILTER (network IS NOT NULL) AS network,
    min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, min(pos) AS first_pos,
    max(ts_ms) - min(ts_ms) AS duration_ms,
    count(*) FILTER (inbound) AS messages_in, count(*) FILTER (NOT inbound) AS messages_out,
    CAST(coalesce(sum(size) FILTER (inbound), 0) AS BIGINT) AS bytes_in,
    CAST(coalesce(sum(size) FILTER (NOT inbound), 0) AS BIGINT) AS bytes_out,
    count(*) FILTER (kind = 'inbound') AS n_inbound, count(*) FILTER (kind = 'outbound') AS n_outbound,
    count(*) FILTER (kind = 'closed') AS n_closed,
    count(*) FILTER (kind = 'inbound_evicted') AS n_inbound_evicted,
    count(*) FILTER (kind = 'misbehaving') AS n_misbehaving,
    count(*) FILTER (event_group = 'connection') AS lifecycle_events, count(*) AS events
  FROM m GROUP BY peer_id)
"""

LIFETIMES = """
life AS (
  SELECT *, greatest(ts_ms - established_s * 1000, 0) AS lifetime_ms
  FROM m WHERE kind IN ('closed', 'inbound_evicted'))
"""

GRID = """
span AS (
  SELECT min(ts_ms) - min(ts_ms) % 100 AS start_ms, max(ts_ms) AS high FROM m),
grid AS (
  SELECT start_ms, 100 * (1::BIGINT << greatest(length(bin((high - start_ms) // 100)) - 12, 0)) AS bin_ms, high
  FROM span),
g AS (SELECT start_ms, bin_ms, (high - start_ms) // bin_ms + 1 AS bins FROM grid)
"""


def _with(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + body


def _merged(n: int) -> str:
    return f"""
g2 AS (
  SELECT start_ms, bin_ms * CAST(ceil(bins / {n}) AS BIGINT) AS bin_ms,
         CAST(ceil(bins / ceil(bins / {n})) AS BIGINT) AS bins FROM g)
"""


# --- distributions ---


def _dist(source: str, by: str, ms: str, name: str = "d") -> str:
    """A distribution with estimated percentiles, from bucket counts and running sums."""
    keys = f"{by}," if by else ""
    part = f"PARTITION BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""

    def pct(p: float) -> str:
        q = round(p * 100)
        match = " AND ".join(f"r.{c.strip()} IS NOT DISTINCT FROM t.{c.strip()}" for c in by.split(",")) if by else "true"
        return f"""
  (SELECT least(greatest(lo + CAST(trunc(
             (CASE WHEN b = 31 THEN lo ELSE lo + 1 END)::DOUBLE
             * ((greatest(ceil(t.count::DOUBLE * {p}), 1) - (cum - n))::DOUBLE / n::DOUBLE)) AS BIGINT),
             t.min_ms), t.max_ms)
   FROM {name}_run r
   WHERE {match} AND cum >= greatest(ceil(t.count::DOUBLE * {p}), 1)
     AND cum - n < greatest(ceil(t.count::DOUBLE * {p}), 1)) AS p{q}_ms"""

    return f"""
{name}_b AS (
  SELECT {keys} least(length(bin({ms} + 1)) - 1, 31) AS b, count(*) AS n
  FROM {source} WHERE {ms} IS NOT NULL GROUP BY {keys} b),
{name}_run AS (
  SELECT *, (1::BIGINT << b) - 1 AS lo, CAST(sum(n) OVER ({part} ORDER BY b) AS BIGINT) AS cum FROM {name}_b),
{name}_t AS (
  SELECT {keys} count(*) AS count, CAST(sum({ms}) AS BIGINT) AS total_ms, min({ms}) AS min_ms,
         max({ms}) AS max_ms, CAST(sum({ms}) AS BIGINT)::DOUBLE / count(*)::DOUBLE AS mean_ms
  FROM {source} WHERE {ms} IS NOT NULL {group}),
{name}_k AS (
  SELECT {keys} array_to_string(list_transform(range(0, 32), lambda i:
         coalesce(list_sum(list_transform(list_filter(list({{'b': b, 'n': n}}), lambda x: x.b = i), lambda x: x.n)), 0)::BIGINT::VARCHAR), ',') AS buckets
  FROM {name}_b {group}),
{name} AS (
  SELECT t.*, buckets, {pct(0.5)}, {pct(0.9)}, {pct(0.99)}
  FROM {name}_t t JOIN {name}_k {join})
"""


PAGE = """peer_id, addr, conn_type, first_seen, last_seen, duration_ms, messages_in,
    messages_out, bytes_in, bytes_out, events, lifecycle_events"""

AGENTS = """
ag AS (
  SELECT DISTINCT m.peer_id, c.c_mktsegment AS user_agent FROM m JOIN customer c ON c.c_custkey = m.peer_id)
"""

RECENT = """
recent AS (
  SELECT peer_id, pos, row_number() OVER (PARTITION BY peer_id ORDER BY pos DESC) AS newness, ts_ms, kind,
         established_s * 1000 AS established_at,
         CASE WHEN kind IN ('closed', 'inbound_evicted')
              THEN greatest(ts_ms - established_s * 1000, 0) END AS lifetime_ms,
         existing_connections, misbehaviour AS message
  FROM m WHERE event_group = 'connection' QUALIFY newness <= 8)
"""

# --- pairing ---

ACTIVITY_RULES = """
rules AS (
  SELECT * FROM (VALUES
    (0, 'view', 'click', false, true, 43200000::BIGINT),
    (1, 'click', 'purchase', false, false, 86400000::BIGINT),
    (2, 'purchase', 'view', true, false, 172800000::BIGINT))
  t(rule, request, reply, multi, optional, window_ms))
"""

TIES = """
w AS (
  SELECT rule, multi, optional, window_ms, peer_id, inbound AS dir, pos, ts_ms, true AS asks
  FROM m JOIN rules ON kind = request
  UNION ALL
  SELECT rule, multi, optional, window_ms, peer_id, NOT inbound, pos, ts_ms, false
  FROM m JOIN rules ON kind = reply),
o AS (
  SELECT *,
    last_value(CASE WHEN asks THEN pos END IGNORE NULLS) OVER a AS rpos,
    last_value(CASE WHEN asks THEN ts_ms END IGNORE NULLS) OVER a AS rts,
    first_value(CASE WHEN asks THEN ts_ms END IGNORE NULLS) OVER b AS nts
  FROM w
  WINDOW a AS (PARTITION BY peer_id, rule, dir ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         b AS (PARTITION BY peer_id, rule, dir ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY peer_id, rule, dir, rpos ORDER BY pos) AS rn
  FROM o WHERE NOT asks AND rpos IS NOT NULL AND greatest(ts_ms - rts, 0) <= window_ms),
ties AS (
  SELECT rule, peer_id, dir, rpos AS request_pos, pos AS reply_pos,
         greatest(ts_ms - rts, 0) AS elapsed_ms, rn = 1 AS first_reply
  FROM hits WHERE multi OR rn = 1)
"""

# What messages name: the tens of k, the ones of an odd k, and nothing for every third.
NAMED = """
km AS (
  SELECT pos, ts_ms, peer_id, kind, inbound, CASE WHEN k % 3 = 0 THEN []
    WHEN k % 2 = 1 THEN ['t' || k // 10, 'u' || k % 10] ELSE ['t' || k // 10] END AS keys
  FROM m WHERE event_group = 'message'),
kw AS (
  SELECT rule, multi, window_ms, peer_id, inbound AS dir, pos, ts_ms, true AS asks, unnest(keys) AS key
  FROM km JOIN rules ON kind = request
  UNION ALL
  SELECT rule, multi, window_ms, peer_id, NOT inbound, pos, ts_ms, false, unnest(keys)
  FROM km JOIN rules ON kind = reply),
kg AS (
  SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER q > window_ms THEN 1 ELSE 0 END AS fresh
  FROM kw WINDOW q AS (PARTITION BY peer_id, rule, dir, key ORDER BY pos)),
kr AS (
  SELECT *, sum(fresh) OVER (PARTITION BY peer_id, rule, dir, key ORDER BY pos) AS run FROM kg),
kl AS (
  SELECT *, sum(CASE WHEN asks THEN 1 ELSE -1 END) OVER q AS level,
    count(*) FILTER (asks) OVER q AS a, count(*) FILTER (NOT asks) OVER q AS z
  FROM kr WINDOW q AS (PARTITION BY peer_id, rule, dir, key, run ORDER BY pos)),
kd AS (
  SELECT *, greatest(-min(level) OVER q, 0) AS strays
  FROM kl WINDOW q AS (PARTITION BY peer_id, rule, dir, key, run ORDER BY pos)),
kn AS (
  SELECT *, CASE WHEN asks THEN a WHEN strays = coalesce(lag(strays) OVER q, 0) THEN z - strays END AS nth
  FROM kd WINDOW q AS (PARTITION BY peer_id, rule, dir, key, run ORDER BY pos)),
kq AS (
  SELECT x.rule, x.multi, x.pos AS request_pos, x.ts_ms AS rts, y.pos AS reply_pos,
         greatest(y.ts_ms - x.ts_ms, 0) AS elapsed_ms
  FROM kn x JOIN kn y ON x.asks AND NOT y.asks AND x.nth = y.nth AND x.run = y.run AND x.peer_id = y.peer_id
    AND x.rule = y.rule AND x.dir = y.dir AND x.key = y.key
  WHERE greatest(y.ts_ms - x.ts_ms, 0) <= x.window_ms),
kb AS (
  SELECT * FROM kq QUALIFY row_number() OVER (PARTITION BY reply_pos ORDER BY rts, rule, request_pos) = 1),
kt AS (
  SELECT request_pos, reply_pos, CAST(rule AS INTEGER) AS rule, elapsed_ms FROM kb
  QUALIFY multi OR row_number() OVER (PARTITION BY request_pos, rule ORDER BY reply_pos) = 1)
"""

# The timing form for requests that name nothing and replies that no key ties.
REST = TIES.replace("FROM m JOIN rules ON kind = request", "FROM km JOIN rules ON kind = request AND len(keys) = 0")
REST = REST.replace(
    "FROM m JOIN rules ON kind = reply",
    "FROM km JOIN rules ON kind = reply AND pos NOT IN (SELECT reply_pos FROM kt)",
)
KEYED = """
pairs AS (
  SELECT request_pos, reply_pos, rule, true AS by_key, elapsed_ms FROM kt
  UNION ALL
  SELECT request_pos, reply_pos, CAST(rule AS INTEGER), false, elapsed_ms FROM ties)
"""

FATES = """
fates AS (
  SELECT o.rule, o.peer_id, o.dir, o.pos, o.ts_ms, coalesce(x.n, 0) AS replies,
    CASE WHEN x.n IS NOT NULL THEN 'answered'
         WHEN o.optional THEN 'undetermined'
         WHEN (nts IS NULL AND (SELECT max(ts_ms) FROM m) - o.ts_ms > window_ms)
           OR (nts IS NOT NULL AND NOT multi) OR (nts IS NOT NULL AND multi AND nts - o.ts_ms > window_ms)
         THEN CASE WHEN o.dir THEN 'unanswered_by_us' ELSE 'unanswered_by_peers' END
         ELSE 'undetermined' END AS fate
  FROM o LEFT JOIN (SELECT rule, peer_id, dir, request_pos, count(*) AS n FROM ties GROUP BY ALL) x
    ON x.rule = o.rule AND x.peer_id = o.peer_id AND x.dir = o.dir AND x.request_pos = o.pos
  WHERE asks)
"""

# Where a stream with an hour's patience stands: the first event of the last hour, and the time
# that no event still to come is older than.
EDGE = """
edge AS (
  SELECT edge_pos, least((SELECT max(ts_ms) FROM m) - 3600000,
    (SELECT min(ts_ms) FROM m WHERE pos >= edge_pos)) AS edge_ts
  FROM (SELECT min(pos) AS edge_pos FROM m WHERE ts_ms >= (SELECT max(ts_ms) FROM m) - 3600000))
"""

# view -> click (single, 12 h) against purchase -> click, view (multi, 48 h), on the same clicks.
CONTENDED = """
c AS (
  SELECT peer_id, inbound AS dir, pos, ts_ms, kind, true AS asks FROM m WHERE kind IN ('view', 'purchase')
  UNION ALL
  SELECT peer_id, NOT inbound, pos, ts_ms, kind, false FROM m WHERE kind IN ('click', 'view')),
cw AS (
  SELECT *,
    last_value(CASE WHEN asks AND kind = 'view' THEN pos END IGNORE NULLS) OVER a AS sp,
    last_value(CASE WHEN asks AND kind = 'view' THEN ts_ms END IGNORE NULLS) OVER a AS st,
    last_value(CASE WHEN asks AND kind = 'purchase' THEN pos END IGNORE NULLS) OVER a AS mp,
    last_value(CASE WHEN asks AND kind = 'purchase' THEN ts_ms END IGNORE NULLS) OVER a AS mt,
    first_value(CASE WHEN asks AND kind = 'view' THEN ts_ms END IGNORE NULLS) OVER b AS sn,
    first_value(CASE WHEN asks AND kind = 'purchase' THEN ts_ms END IGNORE NULLS) OVER b AS mn
  FROM c
  WINDOW a AS (PARTITION BY peer_id, dir ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         b AS (PARTITION BY peer_id, dir ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
cl AS (
  SELECT *, kind = 'click' AND st IS NOT NULL AND greatest(ts_ms - st, 0) <= 43200000 AS fs,
         mt IS NOT NULL AND greatest(ts_ms - mt, 0) <= 172800000 AS fm
  FROM cw WHERE NOT asks),
cp AS (
  SELECT *, fs AND (NOT fm OR st <= mt) AS prefers FROM cl),
ct AS (
  SELECT *, row_number() OVER (PARTITION BY peer_id, dir, sp, prefers ORDER BY pos) AS nth FROM cp),
cr AS (
  SELECT CASE WHEN prefers AND nth = 1 THEN 0 ELSE 1 END AS rule, peer_id, dir,
         CASE WHEN prefers AND nth = 1 THEN sp ELSE mp END AS request_pos, pos AS reply_pos,
         greatest(ts_ms - CASE WHEN prefers AND nth = 1 THEN st ELSE mt END, 0) AS elapsed_ms
  FROM ct WHERE (prefers AND nth = 1) OR fm),
cties AS (
  SELECT *, row_number() OVER (PARTITION BY peer_id, dir, rule, request_pos ORDER BY reply_pos) = 1 AS first_reply
  FROM cr)
"""

# --- relay ---

RACE = """
r AS (
  SELECT l_partkey AS item, l_suppkey AS peer_id, epoch_us(l_shipdate) // 1000 AS ts_ms,
         (epoch_us(l_shipdate) // 86400000000) * 8796093022208 + l_orderkey * 8 + l_linenumber AS pos,
         (l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 1024
           + CAST(l_quantity AS BIGINT) AS item_no,
         l_returnflag = 'R' AS delivery,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END AS size
  FROM lineitem),
q AS (
  SELECT *, row_number() OVER s AS n, first_value(ts_ms) OVER s AS fts,
         count(*) FILTER (delivery) OVER before AS pd, count(*) FILTER (NOT delivery) OVER before AS pa
  FROM r
  WINDOW s AS (PARTITION BY item ORDER BY pos, item_no),
         before AS (PARTITION BY item ORDER BY pos, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
race AS (
  SELECT item, peer_id, ts_ms, pos, item_no, delivery, size,
         NOT delivery AND n = 1 AS first, NOT delivery AND n > 1 AS late,
         CASE WHEN NOT delivery AND n > 1 THEN greatest(ts_ms - fts, 0) END AS lag_ms,
         delivery AND pd > 0 AS duplicate,
         CASE WHEN delivery AND pd = 0 AND pa > 0 THEN greatest(ts_ms - fts, 0) END AS held_ms
  FROM q)
"""

CARD = """
card AS (
  SELECT peer_id, count(*) FILTER (first) AS first, count(*) FILTER (late) AS late,
         count(*) FILTER (delivery) AS delivered, count(*) FILTER (duplicate) AS duplicate,
         CAST(coalesce(sum(size) FILTER (duplicate), 0) AS BIGINT) AS duplicate_bytes
  FROM race GROUP BY peer_id)
"""

# --- rasters ---


def _cells(start: str, end: str, columns: int, rows: str, value: str) -> str:
    return f"""
win AS (SELECT {start} AS a, {end} AS z FROM m),
chosen AS (SELECT peer_id FROM p, win WHERE last_seen >= a AND first_seen <= z {rows}),
cells AS (
  SELECT peer_id, CAST(least((ts_ms - a) * {columns} // (z - a), {columns - 1}) AS INTEGER) AS col, inbound,
         CAST({value} AS BIGINT) AS value
  FROM m, win WHERE event_group = 'message' AND ts_ms BETWEEN a AND z
    AND peer_id IN (SELECT peer_id FROM chosen)
  GROUP BY ALL HAVING value > 0)
"""


OWN = f"""
own AS (SELECT min(ts_ms) AS a, greatest(max(ts_ms) - min(ts_ms), 1) AS span, max(ts_ms) AS z FROM m WHERE peer_id = {PEER}),
busy AS (
  SELECT kind, count(*) AS total FROM m WHERE peer_id = {PEER} AND event_group = 'message'
  GROUP BY kind ORDER BY total DESC, kind LIMIT 2),
cells AS (
  SELECT kind, total, CAST(least((ts_ms - a) * 40 // span, 39) AS INTEGER) AS col, inbound, count(*) AS value
  FROM m JOIN busy USING (kind), own WHERE peer_id = {PEER} GROUP BY ALL)
"""

# --- networks ---

NETS = """
placed AS (
  SELECT p.*, CASE
      WHEN addr IS NULL THEN NULL
      WHEN addr LIKE '10.0.%' THEN 64500
      WHEN addr LIKE '10.1.0.%' AND CAST(split_part(split_part(addr, ':', 1), '.', 4) AS INTEGER) < 128 THEN 64511
      WHEN addr LIKE '10.1.%' THEN 64501 END::BIGINT AS asn,
    CASE WHEN addr IS NULL THEN 'address not seen'
         WHEN addr LIKE '10.2.%' OR addr LIKE '10.3.%' THEN 'unmapped IP' ELSE '' END AS network_label
  FROM p),
nets AS (
  SELECT asn, network_label, count(*) AS peers,
    CAST(sum(messages_in) AS BIGINT) AS messages_in, CAST(sum(messages_out) AS BIGINT) AS messages_out,
    CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
    CAST(sum(n_inbound) AS BIGINT) AS n_inbound, CAST(sum(n_outbound) AS BIGINT) AS n_outbound,
    CAST(sum(n_closed) AS BIGINT) AS n_closed, CAST(sum(n_inbound_evicted) AS BIGINT) AS n_inbound_evicted,
    CAST(sum(n_misbehaving) AS BIGINT) AS n_misbehaving,
    min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(events) AS BIGINT) AS events,
    CASE WHEN sum(n_inbound) > 0 THEN sum(n_inbound_evicted)::DOUBLE / sum(n_inbound)::DOUBLE END AS eviction_ratio
  FROM placed GROUP BY asn, network_label)
"""

# --- message bodies ---

INVENTORY = """
inv AS (
  SELECT pos, peer_id, size, k % 7 AS n,
    CASE kind WHEN 'view' THEN 'inv' WHEN 'click' THEN 'getdata' WHEN 'purchase' THEN 'notfound' ELSE kind END AS kind,
    event_group
  FROM m),
types AS (SELECT ['tx', 'wtx', 'witness tx', 'block', 'witness block', 'cmpctblock', 'unknown', 'malformed'] AS names),
items AS (
  SELECT pos, (size + i) % 8 AS t, md5(CAST((peer_id * 7 + i) % 50 AS VARCHAR)) AS hash
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM inv WHERE event_group = 'message'))
"""

LINES = """
e AS (
  SELECT event_id, 'node.main.' || strftime(date_trunc('hour', ts), '%Y%m%d-%H%M%S') || '-000.events.zst' AS file_name,
         epoch_us(date_trunc('hour', ts)) // 1000 AS file_ts, epoch_us(ts) // 1000 AS ts_ms, event_type,
         '{"record_no":' || event_id || ',"ts_ms":' || (epoch_us(ts) // 1000) || ',"command":"' || event_type || '"}' AS row,
         event_id % 97 = 0 AS damaged
  FROM events),
lines AS (SELECT *, CASE WHEN damaged THEN left(row, 20) ELSE row END AS text FROM e)
"""


def oracle_sql() -> dict[str, str]:
    m, p, life = MESSAGES, PEERS, LIFETIMES
    out = {}
    out["totals"] = _with(m, body="""
SELECT count(*) AS events, count(DISTINCT peer_id) AS peers, count(DISTINCT event_group || kind) AS kinds,
       min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, max(ts_ms) - min(ts_ms) AS duration_ms,
       CAST(0 AS BIGINT) AS decode_errors FROM m""")
    out["breakdown"] = _with(m, body="""
SELECT category, event_group, kind, label, count(*) AS cnt,
       count(*)::DOUBLE * 100.0::DOUBLE / (SELECT count(*) FROM m)::DOUBLE AS share
FROM m GROUP BY ALL""")
    out["category_rollup"] = _with(m, body="""
SELECT category, event_group, kind, count(*) AS cnt FROM m GROUP BY ROLLUP (category, event_group, kind)""")
    out["groups_present"] = _with(m, body=" SELECT event_group, count(*) AS cnt FROM m GROUP BY 1")
    out["timeline_kind"] = _with(m, GRID, body="""
SELECT start_ms + (ts_ms - start_ms) // bin_ms * bin_ms AS bin_start_ms, event_group, kind, count(*) AS cnt
FROM m, g GROUP BY ALL""")
    out["timeline_downsampled"] = _with(m, GRID, _merged(97), body="""
SELECT start_ms + (ts_ms - start_ms) // bin_ms * bin_ms AS bin_start_ms, event_group, kind, count(*) AS cnt
FROM m, g2 GROUP BY ALL""")
    out["timeline_groups"] = _with(m, GRID, _merged(120), body="""
, names AS (SELECT unnest(['message', 'connection', 'mempool', 'validation', 'rpc', 'p2p', 'log', 'ipc']) AS event_group,
                   unnest(range(0, 8))::INTEGER AS group_no),
counts AS (SELECT (ts_ms - start_ms) // bin_ms AS bin, event_group, count(*) AS cnt FROM m, g2 GROUP BY ALL)
SELECT start_ms + s.bin * bin_ms AS bin_start_ms, group_no, n.event_group, coalesce(cnt, 0) AS cnt
FROM (SELECT unnest(range(0, bins)) AS bin, start_ms, bin_ms FROM g2) s, names n
LEFT JOIN counts c ON c.bin = s.bin AND c.event_group = n.event_group""")
    out["timeline_group"] = _with(m, GRID, _merged(50), body="""
, f AS (SELECT ts_ms, kind || '_' || (k % 6) AS kind FROM m WHERE event_group = 'message'),
ranked AS (SELECT kind, row_number() OVER (ORDER BY count(*) DESC, kind) AS rk FROM f GROUP BY kind)
SELECT start_ms + (ts_ms - start_ms) // bin_ms * bin_ms AS bin_start_ms,
       CASE WHEN rk <= 8 THEN kind ELSE 'other (' || ((SELECT count(*) FROM ranked) - 8) || ')' END AS series,
       count(*) AS cnt
FROM f JOIN ranked USING (kind), g2 GROUP BY ALL""")

    out["lifetime_distribution"] = _with(m, life, _dist("life", "peer_id", "lifetime_ms"), body=" SELECT * FROM d")
    out["merged_distribution"] = _with(m, life, _dist("life", "kind", "lifetime_ms"), body=" SELECT * FROM d")
    out["lifetime_buckets"] = _with(m, life, body="""
SELECT CAST(least(length(bin(lifetime_ms + 1)) - 1, 31) AS INTEGER) AS bucket, kind, count(*) AS cnt,
       (1::BIGINT << bucket) - 1 AS low_ms, CASE WHEN bucket < 31 THEN (1::BIGINT << (bucket + 1)) - 1 END AS high_ms
FROM life GROUP BY bucket, kind""")
    out["exact_percentiles"] = _with(m, life, body="""
SELECT kind, quantile_cont(lifetime_ms::DOUBLE, 0.5) AS p50_ms, quantile_cont(lifetime_ms::DOUBLE, 0.9) AS p90_ms,
       quantile_cont(lifetime_ms::DOUBLE, 0.99) AS p99_ms FROM life GROUP BY kind""")

    out["peer_table"] = _with(m, p, body=" SELECT * FROM p")
    out["peers_page"] = _with(m, p, body=f" SELECT {PAGE} FROM p ORDER BY bytes_in DESC, peer_id LIMIT 20 OFFSET 5")
    out["command_mix"] = _with(m, body="""
SELECT peer_id, kind AS command, count(*) FILTER (inbound) AS inbound, count(*) FILTER (NOT inbound) AS outbound,
       CAST(coalesce(sum(size) FILTER (inbound), 0) AS BIGINT) AS inbound_bytes,
       CAST(coalesce(sum(size) FILTER (NOT inbound), 0) AS BIGINT) AS outbound_bytes, count(*) AS total
FROM m WHERE event_group = 'message' GROUP BY peer_id, kind""")
    out["lifecycle_counts"] = _with(m, p, body="""
SELECT peer_id, n_inbound, n_outbound, n_closed, n_inbound_evicted, n_misbehaving, lifecycle_events
FROM p WHERE lifecycle_events > 0""")
    out["recent_lifecycle"] = _with(m, RECENT, body=" SELECT * REPLACE (CAST(newness AS INTEGER) AS newness) FROM recent")
    ends = """
, ends AS (SELECT conn_type, count(*) FILTER (kind = 'closed') AS closed,
                  count(*) FILTER (kind = 'inbound_evicted') AS evicted FROM life GROUP BY 1)
SELECT d.*, closed, evicted FROM d JOIN ends USING (conn_type)"""
    out["connection_durations"] = _with(m, life, _dist("life", "conn_type", "lifetime_ms"), body=ends)
    out["connection_durations_evicted"] = _with(
        m, life, "gone AS (SELECT * FROM life WHERE kind = 'inbound_evicted')",
        _dist("gone", "conn_type", "lifetime_ms"), body=ends)
    out["agent_census"] = _with(m, p, AGENTS, body="""
SELECT user_agent, count(*) AS peers,
       count(*)::DOUBLE * 100.0::DOUBLE / (SELECT count(*) FROM p)::DOUBLE AS share
FROM p JOIN ag USING (peer_id) GROUP BY 1""")
    out["agent_totals"] = _with(m, p, AGENTS, body="""
SELECT count(DISTINCT user_agent) AS distinct_agents, count(user_agent) AS named,
       count(*) - count(user_agent) AS unknown, count(*) AS peers
FROM p LEFT JOIN ag USING (peer_id)""")
    out["peer_agents"] = _with(m, body="""
, g AS (SELECT *, CASE WHEN k % 4 = 3 THEN '' ELSE '/agent:' || (k % 4) || '/' END AS agent,
               event_group = 'connection' AND k % 3 = 0 AS poll FROM m),
known AS (SELECT peer_id, min(pos) AS first_pos FROM g WHERE NOT poll GROUP BY 1),
said AS (
  SELECT peer_id, 1 AS src, pos, agent FROM g
  WHERE event_group = 'message' AND kind = 'view' AND k < 20 AND inbound AND agent <> ''
  UNION ALL
  SELECT g.peer_id, 2, pos, agent FROM g JOIN known USING (peer_id) WHERE poll AND agent <> '' AND pos > first_pos)
SELECT peer_id, agent AS user_agent, CASE src WHEN 1 THEN 'version' ELSE 'getpeerinfo' END AS agent_source
FROM said QUALIFY row_number() OVER (PARTITION BY peer_id ORDER BY src, pos) = 1""")
    out["peer_detail"] = _with(m, p, AGENTS, RECENT, RACE, CARD, body=f"""
, mix AS (SELECT kind, count(*) AS total, count(*) FILTER (inbound) AS i, count(*) FILTER (NOT inbound) AS o,
                 coalesce(sum(size) FILTER (inbound), 0) AS bi, coalesce(sum(size) FILTER (NOT inbound), 0) AS bo
          FROM m WHERE event_group = 'message' AND peer_id = {PEER} GROUP BY kind)
SELECT {PAGE}, user_agent, CASE WHEN user_agent IS NOT NULL THEN 'version' END AS agent_source,
  (SELECT string_agg(kind || ':' || i || ':' || o || ':' || bi || ':' || bo, ',' ORDER BY total DESC, kind) FROM mix) AS commands,
  (SELECT string_agg(ts_ms || ':' || kind || ':' || coalesce(CAST(lifetime_ms AS VARCHAR), '-'), ',' ORDER BY pos)
   FROM recent WHERE peer_id = {PEER}) AS lifecycle,
  CAST(8 AS INTEGER) AS lifecycle_cap,
  card.first AS relay_first, card.late AS relay_late, card.duplicate_bytes AS relay_duplicate_bytes
FROM p LEFT JOIN ag USING (peer_id) LEFT JOIN card USING (peer_id) WHERE peer_id = {PEER}""")

    out["event_search"] = _with(m, body=f"""
SELECT * FROM m WHERE (kind = 'view' OR event_group = 'connection')
  AND ts_ms >= {FIRST_DAY + DAY} AND ts_ms <= {FIRST_DAY + 9 * DAY}""")
    out["event_search_text"] = _with(m, p, body="""
SELECT m.* FROM m JOIN p USING (peer_id) WHERE contains(lower(kind), '2.0.1') OR contains(lower(p.addr), '2.0.1')""")
    rows = """pos, ts_ms, category, event_group, kind, label, peer_id, inbound,
       coalesce(size, 0) AS size, p.addr"""
    out["event_rows"] = _with(m, p, body=f" SELECT {rows} FROM (SELECT * EXCLUDE (addr) FROM m) m JOIN p USING (peer_id)")
    out["event_page"] = _with(m, p, body=f"""
, f AS (SELECT * EXCLUDE (addr), row_number() OVER (ORDER BY pos) - 1 AS row_index FROM m WHERE event_group = 'message')
SELECT {rows}, row_index FROM f JOIN p USING (peer_id) WHERE row_index BETWEEN 300 AND 399""")
    out["event_seek"] = _with(m, body="""
, f AS (SELECT pos, kind, row_number() OVER (ORDER BY pos) - 1 AS row_index FROM m),
c AS (SELECT pos, kind, row_number() OVER (ORDER BY pos) - 1 AS row_index FROM m WHERE event_group = 'connection')
SELECT 0 AS page, * FROM f WHERE row_index BETWEEN 10 AND 49
UNION ALL SELECT 1, * FROM f WHERE row_index BETWEEN 700 AND 739
UNION ALL SELECT 2, * FROM c WHERE row_index BETWEEN 250 AND 289""")
    out["event_json"] = _with(m, body="""
SELECT pos, '{"pos":' || pos || ',"ts_ms":' || ts_ms || ',"kind":"' || kind || '","peer_id":' || peer_id
  || CASE WHEN inbound IS NULL THEN '' ELSE ',"inbound":' || CASE WHEN inbound THEN 'true' ELSE 'false' END END
  || CASE WHEN size IS NULL THEN '' ELSE ',"size":' || size END
  || CASE WHEN misbehaviour IS NULL THEN '' ELSE ',"misbehaviour":"' || misbehaviour || '"' END
  || ',"large":' || CASE WHEN ts_ms * 10000 + k * 200000000000000 > 9007199254740991
       THEN '"' || (ts_ms * 10000 + k * 200000000000000) || '"'
       ELSE CAST(ts_ms * 10000 + k * 200000000000000 AS VARCHAR) END
  || ',"raw":"' || lower(hex(label)) || '"}' AS json
FROM m""")
    out["carried_detail"] = _with(m, INVENTORY, body="""
, counted AS (SELECT pos, t, count(*) AS n FROM items GROUP BY ALL),
texts AS (SELECT pos, string_agg(n || 'x ' || names[t + 1], ', ' ORDER BY t) AS detail FROM counted, types GROUP BY pos)
SELECT pos, kind, CASE WHEN event_group = 'message' THEN coalesce(detail, 'empty') END AS detail
FROM inv LEFT JOIN texts USING (pos)""")
    out["carried_keys"] = _with(m, INVENTORY, body="""
, named_keys AS (SELECT pos, string_agg(DISTINCT hash, ',' ORDER BY hash) AS keys FROM items WHERE t <> 7 GROUP BY pos)
SELECT pos, kind, coalesce(keys, '') AS keys FROM inv LEFT JOIN named_keys USING (pos)""")
    out["strip_payloads"] = """
SELECT count(*) FILTER (strlen(text) > 0) AS stripped_events,
       CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS stripped_bytes FROM documents"""

    out["exchange_pairs"] = _with(m, ACTIVITY_RULES, TIES, body="""
SELECT CAST(rule AS INTEGER) AS rule, peer_id, NOT dir AS inbound, request_pos, reply_pos, elapsed_ms, first_reply FROM ties""")
    out["exchange_pairs_contended"] = _with(m, CONTENDED, body="""
SELECT CAST(rule AS INTEGER) AS rule, peer_id, NOT dir AS inbound, request_pos, reply_pos, elapsed_ms, first_reply FROM cties""")
    out["request_fate"] = _with(m, ACTIVITY_RULES, TIES, FATES, body="""
SELECT CAST(rule AS INTEGER) AS rule, peer_id, dir AS inbound, pos AS request_pos, ts_ms, replies, fate FROM fates""")
    out["request_fate_contended"] = _with(m, CONTENDED, body="""
, asked AS (SELECT CASE kind WHEN 'view' THEN 0 ELSE 1 END AS rule, * FROM cw WHERE asks),
got AS (SELECT rule, peer_id, dir, request_pos, count(*) AS n FROM cties GROUP BY ALL)
SELECT CAST(a.rule AS INTEGER) AS rule, a.peer_id, a.dir AS inbound, pos AS request_pos, ts_ms, coalesce(n, 0) AS replies,
  CASE WHEN n IS NOT NULL THEN 'answered'
       WHEN CASE WHEN a.rule = 0 THEN sn IS NOT NULL OR (SELECT max(ts_ms) FROM m) - ts_ms > 43200000
                 ELSE coalesce(mn, (SELECT max(ts_ms) FROM m)) - ts_ms > 172800000 END
       THEN CASE WHEN a.dir THEN 'unanswered_by_us' ELSE 'unanswered_by_peers' END
       ELSE 'undetermined' END AS fate
FROM asked a LEFT JOIN got ON got.rule = a.rule AND got.peer_id = a.peer_id AND got.dir = a.dir AND request_pos = pos""")
    out["exchange_report"] = _with(
        m, ACTIVITY_RULES, TIES, FATES,
        "theirs AS (SELECT * FROM ties WHERE NOT dir)", _dist("theirs", "rule", "elapsed_ms", "td"),
        "ours AS (SELECT * FROM ties WHERE dir)", _dist("ours", "rule", "elapsed_ms", "od"),
        body="""
, counts AS (
  SELECT rule, count(*) AS opened, count(*) FILTER (fate = 'answered') AS answered,
    count(*) FILTER (fate IN ('unanswered_by_peers', 'unanswered_by_us')) AS unanswered,
    count(*) FILTER (fate = 'unanswered_by_peers') AS unanswered_by_peers,
    count(*) FILTER (fate = 'unanswered_by_us') AS unanswered_by_us,
    count(*) FILTER (fate = 'undetermined') AS undetermined
  FROM fates GROUP BY rule)
SELECT CAST(c.rule AS INTEGER) AS rule, request, reply AS replies, optional, opened, answered, unanswered,
       unanswered_by_peers, unanswered_by_us, undetermined,
       coalesce(td.count, 0) AS peer_count, coalesce(od.count, 0) AS our_count,
       coalesce(td.mean_ms, 0) AS peer_mean_ms, coalesce(od.mean_ms, 0) AS our_mean_ms,
       td.p50_ms AS peer_p50_ms, td.p90_ms AS peer_p90_ms, od.p50_ms AS our_p50_ms, od.p90_ms AS our_p90_ms
FROM counts c JOIN rules USING (rule) LEFT JOIN td ON td.rule = c.rule LEFT JOIN od ON od.rule = c.rule""")
    out["replies_captured"] = _with(m, ACTIVITY_RULES, body="""
SELECT CAST(rule AS INTEGER) AS rule, request,
       reply IN (SELECT kind FROM m WHERE event_group = 'message') AS replies_captured FROM rules""")

    out["unanswered_meaningful"] = _with(m, ACTIVITY_RULES, TIES, FATES, body=f"""
, silent AS (SELECT DISTINCT rule FROM fates WHERE fate LIKE 'unanswered%')
SELECT NOT EXISTS (SELECT 1 FROM silent JOIN rules USING (rule)
         WHERE reply NOT IN (SELECT kind FROM m WHERE event_group = 'message')) AS unanswered_meaningful,
       'activity' AS rules
UNION ALL
SELECT NOT EXISTS (
  SELECT 1 FROM (SELECT ts_ms, lead(ts_ms) OVER (PARTITION BY peer_id, inbound ORDER BY pos) AS nts FROM m WHERE kind = 'view')
  WHERE nts IS NOT NULL OR (SELECT max(ts_ms) FROM m) - ts_ms > {HOUR}), 'unseen'""")
    out["peer_labels"] = _with(m, p, body="""
SELECT peer_id, conn_type, coalesce(['unroutable', 'ipv4', 'ipv6', 'onion', 'i2p', 'cjdns', 'internal'][peer_id % 9 + 1],
         'unknown') AS network,
       CASE WHEN messages_in + messages_out = 0 THEN 0.0
            ELSE messages_in::DOUBLE * 100.0 / (messages_in + messages_out)::DOUBLE END AS in_share FROM p""")
    out["classified"] = """
WITH e AS (
  SELECT event_id AS pos,
    ['ebpf.message', 'ebpf.connection', 'ebpf.mempool', 'ebpf.validation', 'rpc', 'p2p', 'log', 'ipc', 'ebpf.novel',
     NULL][event_id % 10 + 1] AS arm,
    ['closed', 'added', 'block_connected', 'uptime', 'ping_duration', 'block_tip', 'novel', NULL][event_id // 10 % 8 + 1] AS sub,
    CASE WHEN event_id % 30 <> 0 THEN event_type END AS command, event_id % 4 < 2 AS inbound FROM events),
g AS (
  SELECT *, CASE WHEN arm IS NULL OR arm = 'ebpf.novel' THEN 'message' ELSE replace(arm, 'ebpf.', '') END AS event_group FROM e),
h AS (
  SELECT *, CASE WHEN arm = 'ebpf.message' THEN coalesce(command, '(unknown)')
    WHEN (event_group, sub) IN (('connection', 'closed'), ('mempool', 'added'), ('validation', 'block_connected'),
      ('rpc', 'uptime'), ('p2p', 'ping_duration'), ('log', 'block_connected'), ('ipc', 'block_tip'))
    THEN sub ELSE '(unknown)' END AS kind FROM g)
SELECT pos, CASE WHEN event_group IN ('rpc', 'p2p', 'log', 'ipc') THEN event_group ELSE 'ebpf' END AS category, event_group, kind,
  CASE WHEN event_group = 'message' THEN kind ELSE event_group || ' ' || kind END AS label,
  CASE WHEN arm = 'ebpf.message' THEN inbound END AS inbound FROM h"""

    out["relay_race"] = _with(RACE, body="""
SELECT item, peer_id, ts_ms, pos, item_no, first, late, lag_ms FROM race WHERE NOT delivery""")
    wire = """
w AS (
  SELECT l_partkey, l_suppkey AS peer_id, epoch_us(l_shipdate) // 1000 AS ts_ms, l_returnflag = 'R' AS delivery,
         (epoch_us(l_shipdate) // 86400000000) * 8796093022208 + l_orderkey * 8 + l_linenumber AS pos
  FROM lineitem),
opened AS (
  SELECT l_partkey, min(pos) FILTER (NOT delivery) AS announced, min(pos) FILTER (delivery) AS delivered
  FROM w GROUP BY 1),
r AS (
  SELECT CASE WHEN l_partkey % 3 = 0 AND (NOT delivery OR coalesce(announced < delivered, false)) THEN 'w' ELSE 't' END
           || lpad(CAST(l_partkey AS VARCHAR), 40, '0') AS item,
         peer_id, ts_ms, pos, 0 AS item_no, delivery, NULL AS size
  FROM w JOIN opened USING (l_partkey)),
q AS""" + RACE.split("\nq AS")[1]
    out["wire_race"] = _with(wire, body="""
SELECT item, peer_id, ts_ms, pos, delivery, first, late, lag_ms, duplicate, held_ms FROM race""")
    out["relay_waste"] = _with(RACE, body="""
SELECT item, peer_id, ts_ms, pos, item_no, size, duplicate, CASE WHEN duplicate THEN size ELSE 0 END AS wasted, held_ms
FROM race WHERE delivery""")
    out["relay_scorecard"] = _with(
        RACE, CARD, _dist("race", "peer_id", "lag_ms", "lag"), _dist("race", "peer_id", "held_ms", "held"), body="""
SELECT card.*, CASE WHEN first + late > 0 THEN first::DOUBLE / (first + late)::DOUBLE END AS win_ratio,
       lag.p50_ms AS lag_p50_ms, lag.p90_ms AS lag_p90_ms, held.p50_ms AS held_p50_ms
FROM card LEFT JOIN lag USING (peer_id) LEFT JOIN held USING (peer_id)""")
    out["relay_totals"] = _with(RACE, body="""
SELECT count(DISTINCT item) AS items, count(*) FILTER (NOT delivery) AS announcements,
  count(*) FILTER (first) AS first_announcers, count(*) FILTER (late) AS late_announcements,
  count(*) FILTER (delivery) AS deliveries, count(*) FILTER (duplicate) AS duplicate_deliveries,
  CAST(sum(size) FILTER (delivery) AS BIGINT) AS delivered_bytes,
  CAST(sum(size) FILTER (duplicate) AS BIGINT) AS duplicate_bytes,
  sum(size) FILTER (duplicate)::DOUBLE / sum(size)::DOUBLE AS wasted_share,
  count(*) FILTER (delivery)::DOUBLE / count(*) FILTER (delivery AND NOT duplicate)::DOUBLE AS duplicate_factor
FROM race""")
    out["relay_distributions"] = _with(
        RACE, """
samples AS (
  SELECT 'lag' AS measure, lag_ms AS ms FROM race WHERE lag_ms IS NOT NULL
  UNION ALL SELECT 'heard_to_held', held_ms FROM race WHERE held_ms IS NOT NULL)""",
        _dist("samples", "measure", "ms"), body=" SELECT * FROM d")
    out["relay_items"] = _with(RACE, body="""
, ann AS (
  SELECT item + CASE WHEN peer_id % 3 = 0 THEN 1000000000 ELSE 0 END AS hash, min(pos) AS at
  FROM r WHERE NOT delivery GROUP BY 1),
d AS (
  SELECT r.*, a.at AS ta, b.at AS wa, min(pos) OVER (PARTITION BY item) AS d0
  FROM r LEFT JOIN ann a ON a.hash = item LEFT JOIN ann b ON b.hash = item + 1000000000 WHERE delivery),
k AS (
  SELECT *, coalesce(ta < pos, false)
      OR (NOT coalesce(ta < d0, false) AND NOT coalesce(wa < d0, false) AND d0 < pos) AS has_tx,
    coalesce(wa < pos, false) AS has_w
  FROM d)
SELECT pos, item_no, peer_id, CASE WHEN has_tx OR NOT has_w THEN item ELSE item + 1000000000 END AS item FROM k""")

    whole = ("min(ts_ms)", "max(ts_ms)")
    out["peer_activity"] = _with(
        m, p, _cells(*whole, 200, f"AND duration_ms >= {DAY} ORDER BY events DESC, peer_id LIMIT 50", "count(*)"),
        body=" SELECT * FROM cells")
    window = (f"min({FIRST_DAY + 2 * DAY}::BIGINT)", f"max({FIRST_DAY + 12 * DAY}::BIGINT)")
    out["peer_activity_bytes"] = _with(
        m, p, _cells(*window, 60, "ORDER BY first_seen, peer_id LIMIT 40", "sum(size)"),
        body="""
SELECT peer_id, inbound, string_agg(col || ',' || value, ',' ORDER BY col) AS cells FROM cells GROUP BY ALL""")
    out["activity_summary"] = _with(
        m, p, _cells(*whole, 200, f"AND duration_ms >= {DAY} ORDER BY first_seen, peer_id LIMIT 50", "count(*)"),
        body=f"""
SELECT a AS start_ms, z AS end_ms, CAST(200 AS INTEGER) AS columns, (z - a)::DOUBLE / 200 AS bin_ms,
  (SELECT count(*) FROM p WHERE duration_ms >= {DAY}) AS peers,
  least((SELECT count(*) FROM p WHERE duration_ms >= {DAY}), 50) AS shown,
  (SELECT max(value) FROM cells) AS peak FROM win""")
    out["peer_raster"] = _with(m, OWN, body=" SELECT * FROM cells")
    out["peer_raster_summary"] = _with(m, OWN, body=f"""
SELECT a AS start_ms, z AS end_ms, CAST(40 AS INTEGER) AS columns, span::DOUBLE / 40 AS bin_ms,
  (SELECT count(DISTINCT kind) FROM m WHERE peer_id = {PEER} AND event_group = 'message') AS commands,
  (SELECT count(*) FROM m WHERE peer_id = {PEER} AND inbound) AS messages_in,
  (SELECT count(*) FROM m WHERE peer_id = {PEER} AND NOT inbound) AS messages_out,
  (SELECT max(value) FROM cells) AS peak FROM own""")
    out["raster_marks"] = _with(m, body=f"""
SELECT peer_id, pos, CAST(least((ts_ms - {FIRST_DAY}) * 100 // {20 * DAY}, 99) AS INTEGER) AS col, kind, ts_ms,
       true AS complete
FROM m WHERE event_group = 'connection' AND ts_ms BETWEEN {FIRST_DAY} AND {FIRST_DAY + 20 * DAY}""")
    out["peer_activity_rows"] = _with(
        m, p, _cells(*window, 60, "ORDER BY first_seen, peer_id LIMIT 40", "count(*)"),
        body=f"""
SELECT CAST(row_number() OVER (ORDER BY first_seen, peer_id) AS INTEGER) AS rank, peer_id, addr, conn_type,
  first_seen, last_seen, events, messages_in, messages_out, bytes_in, bytes_out,
  coalesce((SELECT string_agg(col || ',' || value, ',' ORDER BY col) FROM cells c
            WHERE c.peer_id = p.peer_id AND c.inbound), '') AS cells_in,
  coalesce((SELECT string_agg(col || ',' || value, ',' ORDER BY col) FROM cells c
            WHERE c.peer_id = p.peer_id AND NOT c.inbound), '') AS cells_out,
  coalesce((SELECT string_agg(least((ts_ms - a) * 60 // (z - a), 59) || ' ' || kind, ',' ORDER BY pos)
            FROM m, win WHERE m.peer_id = p.peer_id AND event_group = 'connection'
              AND ts_ms BETWEEN a AND z), '') AS marks
FROM p WHERE peer_id IN (SELECT peer_id FROM chosen)""")
    out["peer_marks_last"] = _with(m, p, RECENT, OWN, body=f"""
SELECT peer_id, pos, CAST(least((ts_ms - a) * 40 // span, 39) AS INTEGER) AS col, kind, ts_ms,
       lifecycle_events <= 8 AS complete
FROM recent JOIN p USING (peer_id), own WHERE peer_id = {PEER}""")

    out["peer_marks"] = _with(m, OWN, body=f"""
SELECT peer_id, pos, CAST(least((ts_ms - a) * 40 // span, 39) AS INTEGER) AS col, kind, ts_ms, true AS complete
FROM m, own WHERE peer_id = {PEER} AND event_group = 'connection'""")

    keyed = [m, ACTIVITY_RULES, NAMED, REST, KEYED]
    out["keyed_pairs"] = _with(*keyed, body=" SELECT * FROM pairs")
    out["conversation"] = _with(*keyed, p, body="""
, f AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS place FROM m WHERE event_group = 'message'),
g AS MATERIALIZED (SELECT * FROM f WHERE place < 400)
SELECT g.pos, g.ts_ms, g.category, g.event_group, g.kind, g.label, g.peer_id, g.inbound,
  coalesce(g.size, 0) AS size, p.addr, CAST(NULL AS VARCHAR) AS detail, g.place AS row,
  t.request_pos, t.elapsed_ms, h.place AS request_row
FROM g JOIN p ON p.peer_id = g.peer_id LEFT JOIN pairs t ON t.reply_pos = g.pos
LEFT JOIN g h ON h.pos = t.request_pos""")

    out["peer_networks"] = _with(m, p, NETS, body=" SELECT peer_id, addr, asn, network_label FROM placed")
    out["networks"] = _with(m, p, NETS, body=" SELECT * FROM nets")
    out["networks_total"] = _with(m, p, NETS, body="""
SELECT count(*) AS total, CAST(sum(peers) AS BIGINT) AS peers_covered FROM nets""")
    out["network_peers"] = _with(m, p, NETS, body=f"""
SELECT {PAGE} FROM placed WHERE asn = 64511 ORDER BY events DESC, peer_id LIMIT 10""")
    out["as_names"] = _with(m, p, NETS, body="""
SELECT asn, network_label, peers, lower(n_name) AS handle, n_name AS description, left(n_name, 2) AS country
FROM nets LEFT JOIN nation ON n_nationkey * 11 + 64500 = asn""")

    out["address_networks"] = """
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey * 37 % 65536 AS BIGINT) AS low FROM customer)
SELECT k AS peer_id, CASE
    WHEN k % 4 = 0 THEN '[2001:db8:' || printf('%x', k % 7) || '::' || printf('%x', low) || ']:8333'
    WHEN k % 4 = 1 THEN '2001:DB8:ffff::' || printf('%x', low)
    WHEN k % 4 = 2 THEN printf('10.%d.%d.%d:8333', k % 5, k // 256 % 256, k % 256)
    WHEN k % 8 = 3 THEN printf('name%d.onion:8333', k) END AS addr,
  CAST(CASE
    WHEN k % 4 = 0 THEN CASE WHEN k % 7 < 6 THEN 65000 + k % 7 ELSE 64999 END
    WHEN k % 4 = 1 THEN CASE WHEN low < 32768 THEN 64998 ELSE 64997 END
    WHEN k % 4 = 2 AND k % 5 < 4 THEN 65100 + k % 5 END AS BIGINT) AS asn,
  CASE WHEN k % 8 = 7 THEN 'address not seen' WHEN k % 8 = 3 THEN 'Tor / I2P / CJDNS'
    WHEN k % 4 = 2 AND k % 5 = 4 THEN 'unmapped IP' ELSE '' END AS network_label
FROM c"""

    out["quarantine"] = _with(LINES, body=" SELECT file_name, text FROM lines WHERE damaged")
    out["file_summary"] = _with(LINES, body="""
SELECT file_name, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes, count(*) FILTER (NOT damaged) AS events,
       count(*) FILTER (damaged) AS decode_errors,
       CASE WHEN count(*) FILTER (NOT damaged) = 0 THEN 'no readable event' END AS error
FROM lines GROUP BY file_name""")
    out["archive_order"] = _with(LINES, body="""
SELECT file_name, file_ts, (dense_rank() OVER (ORDER BY file_ts, file_name) - 1) * 68719476736 + event_id AS pos,
       ts_ms, event_type AS command FROM lines WHERE NOT damaged""")
    out["stream_timeline"] = _with(m, body="""
SELECT ts_ms // 21600000 * 21600000 AS bin_start_ms, event_group, kind, count(*) AS cnt FROM m GROUP BY ALL""")
    out["stored_totals"], out["stored_breakdown"] = out["totals"], out["breakdown"]
    out["stored_timeline"], out["stored_peers"] = out["timeline_kind"], out["peer_table"]
    out["stored_durations"] = out["connection_durations_evicted"]
    out["stream_peers"] = out["peer_table"]
    out["stream_pairing"] = out["exchange_pairs"]
    # Released is what comes before the first event of the last hour.
    out["stream_request_fate"] = _with(m, ACTIVITY_RULES, TIES, FATES, EDGE, body="""
SELECT CAST(f.rule AS INTEGER) AS rule, f.peer_id, f.dir AS inbound, f.pos AS request_pos, fate
FROM fates f JOIN o ON o.asks AND o.rule = f.rule AND o.pos = f.pos, edge
WHERE o.pos < edge_pos AND ((fate = 'answered' AND EXISTS (
        SELECT 1 FROM ties t WHERE t.request_pos = f.pos AND t.rule = f.rule AND t.reply_pos < edge_pos))
  OR EXISTS (SELECT 1 FROM o n WHERE n.asks AND n.rule = o.rule AND n.peer_id = o.peer_id
        AND n.dir = o.dir AND n.pos > o.pos AND n.pos < edge_pos)
  OR edge_ts > o.ts_ms + o.window_ms)""")
    out["stream_keyed_pairs"] = out["keyed_pairs"]
    out["stream_archive"] = out["exchange_pairs"]
    out["stream_race"] = _with(RACE, body="""
SELECT * FROM race WHERE ts_ms < (SELECT max(ts_ms) FROM race) - 172800000""")
    out["stream_known_items"] = "SELECT DISTINCT l_partkey AS item FROM lineitem"
    out["files_read"] = """
SELECT count(*) AS events, CAST(0 AS BIGINT) AS decode_errors, CAST(0 AS BIGINT) AS broken_files,
       CAST(0 AS BIGINT) AS first_pos, arg_max(epoch_us(ts) // 1000, event_id) AS last_ts_ms,
       count(*) * (count(*) - 1) // 2 AS record_sum FROM events"""
    # Lines cut short name no number and stay with the sound files.
    out["damaged_files"] = """
SELECT NULL AS error, count(*) FILTER (event_id % 97 <> 0) AS events, count(*) FILTER (event_id % 97 = 0) AS decode_errors
FROM events WHERE event_id % 97 = 0 OR event_id % 3 <> 0
UNION ALL SELECT 'not readable to its end', 0, 0"""
    out["input_files"] = """
SELECT 'events.parquet' AS file_name, count(*) AS rows, count(*) - 1 AS last_record FROM events"""
    return out
