"""DuckDB SQL of the registered queries."""

from __future__ import annotations

ASSETS = """assets AS (
  SELECT o_orderkey AS asset_id, o_orderdate AS creation_date,
         CASE o_orderstatus WHEN 'F' THEN 'image' WHEN 'O' THEN 'video' WHEN 'P' THEN 'other' END AS media_type FROM orders)"""
LOG = """log AS (
  SELECT event_id AS seq, user_id AS asset_id, CASE event_type WHEN 'click' THEN 'keep' WHEN 'purchase' THEN 'mark'
         WHEN 'view' THEN 'spare' WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'forget' END AS op FROM events)"""
STATE = LOG + """, state AS (
  SELECT asset_id, coalesce(arg_max(op, seq) FILTER (op <> 'spare') IN ('keep', 'mark'), false) AS reviewed,
         coalesce(arg_max(op, seq) FILTER (op <> 'keep') = 'mark', false) AS marked
  FROM log WHERE asset_id IS NOT NULL GROUP BY asset_id)"""
SIZES = ASSETS + """, sizes AS (
  SELECT a.asset_id, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS bytes
  FROM assets a LEFT JOIN lineitem ON l_orderkey = a.asset_id GROUP BY a.asset_id)"""
NOT_REVIEWED = "asset_id NOT IN (SELECT asset_id FROM state WHERE reviewed)"
DECK_IDS = "(1, 5, 25, 125, 625, 3125, 999999999)"
PAIRS = """pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
  WHERE list_distance(x.embedding, y.embedding) < 1.1)"""
BURSTS = """members AS (SELECT doc_id AS asset_id, text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings)),
stars AS (SELECT text, min(asset_id) AS a FROM members GROUP BY text HAVING count(*) > 1),
bursts AS (SELECT a, asset_id AS b FROM members JOIN stars USING (text) WHERE asset_id <> a)"""
GROUPS = """both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT a AS node, a AS r FROM both_ways UNION SELECT reach.node, e.b FROM reach JOIN both_ways e ON reach.r = e.a),
comps AS (SELECT node, min(r) AS component FROM reach GROUP BY node),
grouped AS (
  SELECT list(vec_id ORDER BY vec_id) AS asset_ids, arg_min(vec_id, struct_pack(q := -label, v := vec_id)) AS keeper_id, CAST(count(*) AS INTEGER) AS n
  FROM comps JOIN embeddings ON vec_id = node GROUP BY component)"""
ALL_GROUPS = f"WITH RECURSIVE {PAIRS}, {BURSTS}, edges AS (SELECT * FROM pairs UNION SELECT * FROM bursts), {GROUPS}"
DELETES = """deletes AS (
  SELECT event_id AS seq, ts AS date, CAST(1 AS BIGINT) AS count, CAST(floor(value) AS BIGINT) AS bytes_freed FROM events WHERE event_type = 'purchase')"""

ORACLES = {
    "deck_chronological": f"""WITH {ASSETS}, {STATE} SELECT asset_id, creation_date FROM assets
        WHERE media_type = 'image' AND creation_date >= TIMESTAMP '1998-01-01' AND {NOT_REVIEWED} ORDER BY creation_date NULLS FIRST, asset_id""",
    "deck_largest_first": f"""WITH {SIZES}, {STATE} SELECT asset_id, creation_date, bytes FROM assets JOIN sizes USING (asset_id)
        WHERE {NOT_REVIEWED} ORDER BY bytes DESC, creation_date NULLS FIRST, asset_id""",
    "deck_videos": f"""WITH {ASSETS}, {STATE} SELECT asset_id, creation_date, media_type FROM assets WHERE media_type = 'video' AND {NOT_REVIEWED}""",
    "deck_album": f"""WITH {ASSETS}, {STATE} SELECT asset_id, creation_date, asset_id = 40 AS is_keeper FROM assets
        WHERE media_type = 'image' AND asset_id IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) AND {NOT_REVIEWED}""",
    "deck_duplicate_group": f"""WITH {ASSETS}, {STATE} SELECT asset_id, media_type FROM assets WHERE asset_id IN {DECK_IDS} AND {NOT_REVIEWED}""",
    "deck_card": f"""WITH {ASSETS}, {STATE} SELECT asset_id, creation_date FROM assets WHERE media_type = 'image' AND {NOT_REVIEWED}
        ORDER BY creation_date NULLS FIRST, asset_id LIMIT 1 OFFSET 10""",
    "lookup_by_ids": f"WITH {ASSETS} SELECT asset_id, creation_date FROM assets WHERE asset_id IN {DECK_IDS} ORDER BY creation_date NULLS FIRST, asset_id",
    "album_catalogue": "SELECT c_custkey AS album_id, c_name AS title FROM customer ORDER BY c_name NULLS FIRST, c_custkey",
    "asset_sizes": f"WITH {SIZES} SELECT asset_id, bytes FROM sizes",
    "total_size_marked": f"""WITH {STATE} SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS bytes FROM lineitem
        WHERE l_orderkey IN (SELECT asset_id FROM state WHERE marked)""",
    "size_cache_misses": f"WITH {ASSETS} SELECT asset_id FROM assets WHERE media_type <> 'image'",
    "size_cache_merge": f"""WITH {SIZES} SELECT asset_id, CASE WHEN media_type <> 'image' OR creation_date >= TIMESTAMP '1997-01-01' THEN bytes + 1 ELSE bytes END AS bytes
        FROM sizes JOIN assets USING (asset_id)""",
    "size_cache_store": f"WITH {SIZES} SELECT CAST(asset_id AS VARCHAR) AS asset_id, bytes FROM sizes",
    "stored_text": """SELECT event_id, '["' || event_id || '","' || event_type || '"]' AS ids, '{"' || event_type || '":' || event_id || '}' AS sizes,
        event_id || '/' || event_type AS decoded, CAST(0 AS INTEGER) AS corrupt, TIMESTAMP '2001-01-01' + to_seconds(event_id) AS at FROM events""",
    "day_sections": """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, list(event_id ORDER BY ts DESC, event_id) AS asset_ids, CAST(count(*) AS INTEGER) AS n
        FROM events WHERE ts IS NOT NULL AND event_type <> 'error' GROUP BY 1 ORDER BY 1 DESC""",
    "day_rows": "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, event_id AS asset_id FROM events WHERE ts IS NOT NULL AND event_type <> 'error'",
    "day_counts": "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL AND event_type <> 'error' GROUP BY 1 ORDER BY 1 DESC",
    "album_summaries": f"""WITH {ASSETS}, ranked AS (
          SELECT o_custkey AS album_id, asset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY creation_date DESC NULLS LAST, asset_id) AS rn,
                 count(*) OVER (PARTITION BY o_custkey) AS n FROM assets JOIN orders ON o_orderkey = asset_id WHERE media_type = 'image')
        SELECT album_id, coalesce(c_name, 'Untitled') AS title, n, asset_id AS cover_id FROM ranked JOIN customer ON c_custkey = album_id WHERE rn = 1""",
    "review_state": f"WITH {STATE} SELECT * FROM state",
    "review_state_stream": f"WITH {STATE} SELECT * FROM state",
    "review_state_batches": f"WITH {STATE} SELECT * FROM state",
    "stream_progress": "SELECT CAST(4 AS BIGINT) AS batches, count(*) AS rows FROM events",
    "review_state_after_reset": f"""WITH first AS (SELECT min(value) AS v FROM events WHERE event_type = 'error'),
        since AS (SELECT max(event_id) AS seq FROM events, first WHERE event_type = 'error' AND value = v), all_events AS (SELECT * FROM events),
        {STATE.replace("FROM events", "FROM all_events, since WHERE event_id > since.seq")} SELECT * FROM state""",
    "review_counts": f"WITH {STATE} SELECT count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (marked) AS marked FROM state",
    "toggle_ops": f"""WITH {ASSETS}, {STATE} SELECT asset_id, CASE WHEN coalesce(marked, false) THEN 'spare' ELSE 'mark' END AS op
        FROM assets LEFT JOIN state USING (asset_id)""",
    "undo_validity": f"""WITH {LOG}, b AS (SELECT seq, asset_id AS deck, op, lag(op) OVER (PARTITION BY asset_id ORDER BY seq) AS before FROM log WHERE op <> 'spare')
        SELECT seq, deck, coalesce(before IN ('keep', 'mark'), false) AS valid FROM b WHERE op = 'clear'""",
    "confirm_delete_survivors": f"WITH {ASSETS}, {STATE} SELECT asset_id FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM state WHERE marked)",
    "confirm_delete_record": f"""WITH {ASSETS}, {STATE}, ids AS (SELECT asset_id FROM state WHERE marked), live AS (SELECT asset_id FROM ids WHERE asset_id IN (SELECT asset_id FROM assets))
        SELECT (SELECT count(*) FROM ids) AS count, (SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) FROM lineitem WHERE l_orderkey IN (SELECT asset_id FROM live)) AS bytes_freed
        WHERE (SELECT count(*) FROM live) > 0""",
    "confirm_delete_state": f"WITH {STATE} SELECT asset_id, reviewed AND NOT marked AS reviewed, false AS marked FROM state",
    "confirm_delete_some_gone": """WITH ids AS (SELECT DISTINCT o_custkey AS id FROM orders), live AS (SELECT id FROM ids WHERE id IN (SELECT o_orderkey FROM orders))
        SELECT (SELECT count(*) FROM ids) AS count, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS bytes_freed FROM lineitem WHERE l_orderkey IN (SELECT id FROM live)""",
    "confirm_delete_all_gone": """SELECT 'assets' AS what, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT 'records', 0 UNION ALL SELECT 'decisions', 0""",
    "similar_pairs": f"WITH {PAIRS} SELECT a, b FROM pairs",
    "near_duplicate_groups": f"WITH RECURSIVE {PAIRS}, edges AS (SELECT * FROM pairs), {GROUPS} SELECT keeper_id AS group_id, asset_ids, keeper_id, n FROM grouped",
    "burst_edges": f"WITH {BURSTS} SELECT a, b FROM bursts",
    "duplicate_groups_all": f"{ALL_GROUPS} SELECT keeper_id AS group_id, asset_ids, keeper_id, n FROM grouped",
    "group_previews": f"{ALL_GROUPS} SELECT keeper_id AS group_id, list_concat([keeper_id], list_filter(asset_ids, lambda x: x <> keeper_id))[1:8] AS preview FROM grouped",
    "group_members": f"{ALL_GROUPS}, m AS (SELECT keeper_id, unnest(asset_ids) AS asset_id FROM grouped) SELECT keeper_id AS group_id, asset_id, asset_id = keeper_id AS is_keeper FROM m",
    "group_sizes": f"{ALL_GROUPS} SELECT keeper_id AS group_id, keeper_id, CAST(n AS BIGINT) AS n FROM grouped ORDER BY n DESC, group_id DESC",
    "sensitivity_distance": "SELECT range AS sensitivity, CASE WHEN range BETWEEN 1 AND 10 THEN range * CAST(0.05 AS DOUBLE) END AS distance FROM range(12)",
    "squared_distance": """SELECT x.vec_id AS age, list_reduce(list_transform(list_zip(x.embedding, y.embedding), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS FLOAT)),
        lambda a, b: CAST(a + b AS FLOAT)) AS distance FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
    "vector_decode": """SELECT vec_id AS age, CAST(CASE WHEN label <> 0 THEN len(embedding) ELSE 0 END AS INTEGER) AS n,
        CASE WHEN label <> 0 THEN CAST(embedding[1] AS FLOAT) END AS first FROM embeddings""",
    "index_upsert": """SELECT doc_id AS asset_id, CAST(-n_chars AS INTEGER) AS quality FROM documents
        UNION ALL SELECT doc_id, CAST(quality AS INTEGER) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "index_stream": "SELECT doc_id AS asset_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 500)",
    "index_point": "SELECT doc_id AS asset_id, quality FROM labels WHERE doc_id = 42",
    "index_exists": "SELECT count(*) > 0 AS has_index FROM labels",
    "index_exists_empty": "SELECT false AS has_index",
    "index_pending": "SELECT doc_id AS asset_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "index_indexed": "SELECT doc_id AS asset_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "index_purge": "SELECT doc_id AS asset_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 500)",
    "index_refresh": """SELECT doc_id AS asset_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars >= 500""",
    "index_row_count": "SELECT count(*) AS n FROM labels",
    "activity_totals": f"WITH {DELETES} SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS photos, CAST(coalesce(sum(bytes_freed), 0) AS BIGINT) AS bytes FROM deletes",
    "activity_log": f"WITH {DELETES} SELECT *, CAST(sum(bytes_freed) OVER (ORDER BY seq) AS BIGINT) AS total_bytes FROM deletes ORDER BY seq DESC",
    "stored_sizes": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS entries, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS bytes FROM events",
    "duration_badge": """SELECT event_id, CASE WHEN event_type = 'view' THEN
        printf('%d:%02d', CAST(floor(value + 0.5) AS BIGINT) // 60, CAST(floor(value + 0.5) AS BIGINT) % 60) ELSE '' END AS badge FROM events""",
    "date_label": """SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 10 = 0 OR o_orderdate IS NULL THEN 'Unknown date'
        ELSE CAST(day(o_orderdate) AS VARCHAR) || ' ' || monthname(o_orderdate) || ' ' || CAST(year(o_orderdate) AS VARCHAR) END AS label FROM orders""",
    "aspect": "SELECT p_partkey, CASE WHEN p_size > 0 AND p_partkey % 50 > 0 THEN CAST(p_size AS DOUBLE) / CAST(p_partkey % 50 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS aspect FROM part",
    "pixel_area": "SELECT p_partkey, CAST(p_size AS BIGINT) * 100000 * CAST(p_size AS BIGINT) * 99999 AS area FROM part",
    "byte_label": """WITH s AS (SELECT o_orderkey AS asset_id, o_orderkey * o_orderkey * o_orderkey AS w FROM orders)
        SELECT asset_id, CASE WHEN w = 1 THEN '1 byte' WHEN w < 1000 THEN w || ' bytes' WHEN w < 999500 THEN (w + 500) // 1000 || ' KB'
          WHEN w < 999950000 THEN (w + 50000) // 100000 // 10 || '.' || (w + 50000) // 100000 % 10 || ' MB'
          ELSE (w + 5000000) // 10000000 // 100 || '.' || lpad(CAST((w + 5000000) // 10000000 % 100 AS VARCHAR), 2, '0') || ' GB' END AS label FROM s""",
    "count_label": "SELECT o_orderkey AS asset_id, o_orderkey % 4 || CASE WHEN o_orderkey % 4 = 1 THEN ' photo' ELSE ' photos' END AS label FROM orders",
    "access_state": "SELECT event_id, CASE event_type WHEN 'click' THEN 'authorized' WHEN 'view' THEN 'undetermined' ELSE 'blocked' END AS state FROM events",
    "swipe_class": "SELECT event_id, CASE WHEN abs(event_id % 301 - 150) <= 120 THEN 'none' WHEN event_id % 301 > 150 THEN 'keep' ELSE 'delete' END AS action FROM events",
    "review_progress": f"WITH {STATE} SELECT CASE WHEN count(*) FILTER (reviewed) > 0 THEN CAST(count(*) FILTER (marked) AS DOUBLE) / count(*) FILTER (reviewed) ELSE CAST(0 AS DOUBLE) END AS progress FROM state",
}
