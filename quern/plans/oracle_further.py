"""DuckDB SQL for the queries of further.py, written apart from the Spark code to check it."""

from __future__ import annotations

from quern.plans.oracle import _TREE, BENCH, CONV, MIX, RANKERS, VEC, bm25, centroid, cosine, fused, grams, ranked, runner_up

_ANS = "ans_c AS (SELECT * FROM mix_c WHERE kind = 'Answer'), cla_c AS (SELECT * FROM mix_c WHERE kind = 'Clarification')"
_SEED = "seeded AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent_id, c_mktsegment || '-' || c_custkey AS name, c_custkey AS k, c_acctbal > 0 AS published, c_custkey % 7 <> 0 AS publishable FROM customer)"


def _rerank(c: str, p: str) -> str:
    return ", ".join([
        cosine(c, "mix_q", f"{p}s"), ranked(f"{p}ss", c, f"{p}s", 2), runner_up(f"{p}sr", f"{p}s", "1.0::DOUBLE"),
        centroid(c, f"{p}c"), cosine(f"{p}cc", "mix_q", f"{p}c"), ranked(f"{p}cs", c, f"{p}c", 2), runner_up(f"{p}cr", f"{p}c", "1.0::DOUBLE"),
        f"""{p} AS (SELECT question_id, CASE WHEN strategy = 'Centroid' THEN i2 ELSE i1 END AS item_id, strategy FROM (
  SELECT question_id, a.item_id AS i1, b.item_id AS i2, CASE WHEN a.item_id = b.item_id THEN 'Agreement' WHEN round(a.margin, 9) >= round(b.margin, 9) THEN 'Semantic' ELSE 'Centroid' END AS strategy FROM {p}s2 AS a JOIN {p}c2 AS b USING (question_id)))""",
    ])


def _in_pool(c: str, kind: str) -> str:
    return f"SELECT '{kind}' AS pool, * FROM (WITH {fused(c, 'mix_q')} SELECT question_id, item_id, place, strategies, round(rrf, 6) AS rrf FROM ev)"


_STATUS = " UNION ALL ".join(
    f"""SELECT 'n{k}' AS parent_id, count(*) AS total, count(*) FILTER (WHERE s) AS seeded, count(*) FILTER (WHERE s AND published) AS published, count(*) FILTER (WHERE s AND publishable) AS publishable,
coalesce((SELECT string_agg(name, ',' ORDER BY k) FROM (SELECT name, k FROM seeded WHERE parent_id = 'n{k}' AND starts_with(lower(name), 'building') ORDER BY k LIMIT 3)), '') AS samples
FROM (SELECT *, starts_with(lower(name), 'building') AS s FROM seeded WHERE parent_id = 'n{k}')"""
    for k in range(3)
)

_WALK = """walk AS (
  SELECT id, parent_id, sort_order, type, url, [{'s': sort_order, 'i': id}] AS steps FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.id, t.parent_id, t.sort_order, t.type, t.url, list_append(w.steps, {'s': t.sort_order, 'i': t.id}) FROM walk AS w JOIN tree AS t ON t.parent_id = w.id)"""

_FORMS = "CASE c_custkey % 6 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} ELSE {} END"

SQL: dict[str, str] = {
    "knowledge_scan": f"""WITH {_TREE}, base AS (SELECT n.id FROM tree AS n JOIN tree AS r ON r.id = n.parent_id WHERE n.type = 'nation' AND r.parent_id IS NULL ORDER BY r.sort_order, r.id, n.sort_order, n.id LIMIT 1)
      SELECT 'c' || c_custkey AS id, c_name AS question, c_mktsegment AS answer, c_mktsegment AS alternative_questions, CASE WHEN c_custkey % 2 = 0 THEN 'Clarification' ELSE 'Answer' END AS kind
      FROM customer WHERE 'n' || c_nationkey IN (SELECT id FROM base) AND c_custkey % 5 <> 0""",
    "point_lookup": f"WITH {_TREE} SELECT id, CASE WHEN type = 'customer' THEN url END AS url FROM tree WHERE level > 2 UNION ALL SELECT 'x', NULL",
    "relevance_verifier": f"""WITH {CONV}, {BENCH}, {bm25('conv_c', 'bench_q', 'x')}, {ranked('xs', 'conv_c', 'x', 3)},
      p AS (SELECT question_id, x.item_id, {grams("question")} AS a, {grams("c.text || chr(10) || c.kind")} AS b FROM xr AS x JOIN conv_c AS c ON c.item_id = x.item_id AND c.pos = x.pos JOIN bench_q USING (question_id)),
      s AS (SELECT question_id, item_id, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS score FROM p)
      SELECT question_id, item_id, round(score, 6) AS score FROM s WHERE score >= 0.2""",
    "retrieval_pools": f"WITH {MIX}, {_ANS} {_in_pool('ans_c', 'Answer')} UNION ALL {_in_pool('cla_c', 'Clarification')}",
    "answer_vs_clarification": f"WITH {MIX}, {_ANS}, {_rerank('ans_c', 'an')}, {_rerank('cla_c', 'cl')} SELECT q.question_id, an.item_id AS answer_item_id, an.strategy AS answer_strategy, cl.item_id AS clarification_item_id, cl.strategy AS clarification_strategy FROM mix_q AS q LEFT JOIN an USING (question_id) LEFT JOIN cl USING (question_id)",
    "answer_top3": f"WITH {MIX}, {_ANS}, {fused('ans_c', 'mix_q')} SELECT question_id, place AS position, item_id, {', '.join(f'{r}_rank, round({r}_score, 6) AS {r}_score' for r in RANKERS)}, round(rrf, 6) AS rrf FROM ev WHERE place <= 3",
    "answer_no_match_evidence": f"WITH {MIX}, {_ANS}, {fused('ans_c', 'mix_q')} SELECT question_id, item_id, semantic_rank, round(semantic_score, 6) AS semantic_score, round(coalesce(max(semantic_score) OVER (PARTITION BY question_id), 0), 6) AS best_score FROM ev",
    "paged_children": f"""WITH {_SEED}, p AS (SELECT id, name, row_number() OVER (ORDER BY k) - 1 AS i FROM seeded WHERE parent_id = 'n3')
      SELECT id, name, page FROM p JOIN (VALUES ('(0, 5)', 0, 5), ('(1, 5)', 5, 10), ('(0, 1000)', 0, 1000)) AS v(page, a, b) ON i >= a AND i < b WHERE lower(name) LIKE 'machinery%'""",
    "seed_status": f"WITH {_SEED} {_STATUS}",
    "seed_report": f"WITH {_SEED} SELECT count(*) FILTER (WHERE NOT published) AS created, count(*) FILTER (WHERE published) AS skipped FROM seeded",
    "guarded_cleanup": f"WITH {_SEED} SELECT 'c' || i AS id, 'p' || i AS parent_id FROM range(2, 4) AS r(i) UNION ALL SELECT id, parent_id FROM seeded",
    "stored_names": "SELECT p_partkey, p_partkey % 4 < 2 AS ok FROM part",
    "file_checks": "SELECT p_partkey, p_partkey % 6 = 0 AS pdf, p_size > 25 OR p_size <= 10 AS open FROM part",
    "form_definitions": "SELECT c_custkey, "
    + _FORMS.format("'job_interest_form'", "'contact_form'", "'product_demo_form'", "'consult_form'") + " AS form_name, "
    + _FORMS.format(40, 34, 34, 34) + "::INT AS main_meta_id, " + _FORMS.format(61, 129, 129, 129) + "::INT AS post_id, "
    + _FORMS.format("'d7c7277'", "'7f7b520'", "'7f7b520'", "'7f7b520'") + " AS element_id, " + _FORMS.format("'61'", "'129'", "'129'", "'129'") + " AS edit_post_id FROM customer",
    "submission_write": "WITH h AS (SELECT 1000 + row_number() OVER (ORDER BY c_custkey) AS id, c_name, c_mktsegment FROM customer) SELECT id, 'consult_form' AS form_name, 'fullname' AS key, c_name AS value FROM h UNION ALL SELECT id, 'consult_form', 'message', c_mktsegment FROM h",
    "change_feed": "SELECT user_id AS item_id, arg_max(event_type, event_id) AS op FROM events WHERE event_id % 16 NOT IN (0, 1) GROUP BY user_id",
    "response_memory": """WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY user_id, ts),
      n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
      r AS (SELECT user_id, k, event_id, ts, ts AS made, false AS hit FROM n WHERE k = 1
        UNION ALL SELECT n.user_id, n.k, n.event_id, n.ts, CASE WHEN n.ts < r.ts + INTERVAL 12 HOUR AND n.ts < r.made + INTERVAL 24 HOUR THEN r.made ELSE n.ts END, n.ts < r.ts + INTERVAL 12 HOUR AND n.ts < r.made + INTERVAL 24 HOUR
        FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
      SELECT event_id, hit FROM r""",
    "index_snapshot": f"WITH {CONV} SELECT item_id, text || CASE WHEN item_id::BIGINT % 4 = 0 THEN ' (new)' ELSE '' END AS text, kind FROM conv_c WHERE item_id::BIGINT % 4 <> 1",
    "latest_news": "SELECT 'o' || o_orderkey AS id, o_orderdate AS create_date FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) ORDER BY 2 DESC, 1 LIMIT 5",
    "home_products": f"WITH {_TREE} SELECT id, sort_order FROM tree WHERE type = 'customer' ORDER BY sort_order, id LIMIT 12",
    "first_settings": f"""WITH RECURSIVE {_TREE}, {_WALK}
      SELECT id, url FROM walk WHERE (type = 'nation' AND parent_id <> 'r0') OR (type = 'customer' AND sort_order % 3 = 1) ORDER BY steps LIMIT 1""",
    "document_order": f"""WITH RECURSIVE {_TREE}, {_WALK}, o AS (SELECT id, parent_id, (row_number() OVER (ORDER BY steps) - 1)::BIGINT AS place FROM walk),
      up AS (SELECT id, id AS above, place FROM o UNION ALL SELECT u.id, o.parent_id, u.place FROM up AS u JOIN o ON o.id = u.above WHERE o.parent_id IS NOT NULL),
      ends AS (SELECT above AS id, max(place)::BIGINT AS last FROM up GROUP BY above)
      SELECT id, place, last FROM o JOIN ends USING (id)""",
    "ancestor_rows": f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS above, 0 AS distance FROM tree WHERE type = 'customer' UNION ALL SELECT u.id, t.parent_id, u.distance + 1 FROM up AS u JOIN tree AS t ON t.id = u.above WHERE t.parent_id IS NOT NULL) SELECT * FROM up",
    "sitemap_lines": f"WITH {_TREE} SELECT '<url><loc>' || replace(url, '&', '&amp;') || '</loc><lastmod>' || strftime(made, '%Y-%m-%d') || '</lastmod><priority>' || CASE level WHEN 1 THEN '1.0' WHEN 2 THEN '0.8' ELSE '0.6' END || '</priority></url>' AS value FROM tree WHERE has_template AND url <> '#'",
    "sitemap_documents": f"""WITH RECURSIVE {_TREE}, {_WALK.replace("type, url", "type, url, level, has_template, made").replace("t.type, t.url", "t.type, t.url, t.level, t.has_template, t.made")},
      p AS (SELECT *, row_number() OVER (ORDER BY level, sort_order, steps) - 1 AS place FROM walk WHERE has_template AND url <> '#'),
      e AS (SELECT place, place // 5000 AS file, '  <url>' || chr(10) || '    <loc>https://x.example.com' || replace(url, '&', '&amp;') || '</loc>' || chr(10) || '    <lastmod>' || strftime(made, '%Y-%m-%d') || '</lastmod>' || chr(10)
        || '    <changefreq>weekly</changefreq>' || chr(10) || '    <priority>' || CASE level WHEN 1 THEN '1.0' WHEN 2 THEN '0.8' ELSE '0.6' END || '</priority>' || chr(10) || '  </url>' AS entry FROM p)
      SELECT file::BIGINT AS file, count(*)::INT AS entries, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg(entry, chr(10) ORDER BY place) || chr(10) || '</urlset>' || chr(10)) AS digest FROM e GROUP BY file""",
    "category_filter": "SELECT p_type AS category, count(*) AS n, 'all' AS selected FROM part GROUP BY p_type UNION ALL SELECT p_type, count(*), 'ECONOMY' FROM part WHERE p_type = 'ECONOMY' GROUP BY p_type",
    "portal_cards": """WITH v AS (SELECT n_nationkey AS pos, n_name, (row_number() OVER (ORDER BY n_nationkey))::INT AS k FROM nation WHERE n_nationkey % 3 <> 2)
      SELECT pos, CASE WHEN pos % 4 = 0 THEN 'Portal' ELSE n_name END AS title, 'Services' AS text, CASE WHEN pos % 2 = 0 THEN 'Go' ELSE 'View' END AS button, CASE WHEN pos % 5 = 0 THEN 'star' WHEN k <= 4 THEN (['user', 'box', 'chat', 'file'])[k] ELSE 'link' END AS icon FROM v""",
    "contact_items": "SELECT s_suppkey AS pos, s_name AS value FROM supplier WHERE s_suppkey % 3 <> 2 AND s_suppkey % 4 <> 0 UNION ALL SELECT -1, 'call us'",
    "field_texts": """WITH b AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS own FROM customer)
      SELECT c_custkey, coalesce(substr(own, 1, 12), 'none') AS trimmed, CASE c_custkey % 4 WHEN 0 THEN 'contact_form' WHEN 1 THEN 'job_interest_form' ELSE 'consult_form' END AS form, concat_ws(chr(10), own, c_mktsegment) AS joined,
        greatest(0.0, least(5000.0, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal ELSE 100.0 END))::DOUBLE AS clamped, coalesce(own, c_mktsegment) AS first, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'z' END AS icon,
        CASE WHEN contains(coalesce(own, c_mktsegment), 'Customer') THEN coalesce(own, c_mktsegment) ELSE coalesce(own, c_mktsegment) || ' | Customer' END AS title FROM b""",
    "media_urls": "SELECT page_id, CASE WHEN page_id % 3 = 1 AND length(trim(url)) > 0 THEN url ELSE '/a.mp4,/b.mp4' END AS urls FROM pages",
    "observed_calls": "SELECT CASE WHEN event_type IN ('click', 'error', 'purchase', 'view') THEN event_type END AS event_type, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS largest FROM events GROUP BY 1",
    "failed_build": f"WITH {CONV} SELECT item_id, pos, text, '[True, False, False] True False' AS built FROM conv_c",
    "no_limit_no_rows": f"WITH {VEC}, {cosine('vec_c', 'vec_q', 'x')}, {ranked('xs', 'vec_c', 'x', 1)} SELECT 1 AS k, question_id, rank, item_id, pos FROM xr",
    "feed_operations": f"""WITH {_TREE}, e AS (SELECT event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN CASE event_id % 5 WHEN 0 THEN 'n' || (user_id % 25) WHEN 1 THEN 'x' || user_id ELSE 'c' || (user_id % 100) END END AS item_id FROM events WHERE event_id % 16 NOT IN (0, 1)),
      o AS (SELECT seq, e.item_id, CASE WHEN type IS NULL THEN 'remove' WHEN type = 'customer' THEN 'refresh' WHEN type = 'nation' THEN 'rebuild' END AS op FROM e LEFT JOIN tree ON tree.id = e.item_id WHERE e.item_id IS NOT NULL)
      SELECT item_id, arg_max(op, seq) AS op FROM o WHERE op IS NOT NULL GROUP BY item_id""",
    "json_items": "SELECT 'c' || c_custkey AS id, c_name AS question, c_mktsegment AS answer, c_name || '|' || c_mktsegment AS alternative_questions, NULL::VARCHAR AS kind FROM customer",
    "missing_properties": "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN 'mobile' END, CASE WHEN c_custkey % 3 <> 0 THEN 'Message' END) AS missing FROM customer",
    "date_texts": "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders",
    "session_expiry": """WITH e AS (SELECT event_id, ts, user_id, event_id % 4 AS k, timezone('Asia/Tehran', timezone('UTC', ts)) + INTERVAL 2 HOUR AS ahead FROM events)
      SELECT event_id, CASE k WHEN 0 THEN '{"ExpireDateTime":"' || strftime(ahead, '%Y-%m-%d %H:%M:%S') || '","user":' || user_id || '}' WHEN 1 THEN '{"ExpireDateTime":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","user":' || user_id || '}'
        WHEN 2 THEN '{"ExpireDateTime":"soon","user":' || user_id || '}' ELSE '{"user":' || user_id || '}' END AS reply,
        CASE WHEN k = 0 THEN date_trunc('second', ts) + INTERVAL 2 HOUR ELSE ts + INTERVAL 30 MINUTE END AS expires FROM e""",
    "group_access": "SELECT c_custkey, c_custkey % 9 <> 0 AND (c_custkey % 10 = 0 OR lower(c_mktsegment) IN ('building', 'machinery')) AS allowed FROM customer",
    "metrics_difference": """WITH a AS (SELECT event_type, count(*) AS n, sum(value) AS total, max(value) AS largest, arg_min(value, {'t': ts, 'e': event_id}) AS f FROM events GROUP BY event_type),
      b AS (SELECT event_type, count(*) AS n, sum(value) AS total, arg_min(value, {'t': ts, 'e': event_id}) AS f FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'click' GROUP BY event_type)
      SELECT event_type, a.n - coalesce(b.n, 0) AS n, round(a.total - coalesce(b.total, 0), 6) AS total, round(a.largest, 6) AS largest, round(CASE WHEN coalesce(b.f, 0) = 0 THEN a.f ELSE 0 END, 6) AS first_value FROM a LEFT JOIN b USING (event_type)""",
}
