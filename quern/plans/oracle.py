"""DuckDB SQL for the queries of the catalogue, written apart from the Spark code to check it."""

from __future__ import annotations

from quern.functions.text import ARABIC_DIGITS, ASCII_DIGITS, PERSIAN_DIGITS, STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
RANKERS = ("semantic", "centroid", "lexical", "bm25")


def norm(t: str) -> str:
    return rf"trim(lower(regexp_replace(regexp_replace(strip_accents(coalesce({t}, '')), '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g')))"


def terms(t: str) -> str:
    return f"list_filter(string_split({norm(t)}, ' '), lambda w: w <> '' AND w NOT IN ({_STOPS}))"


def grams(t: str) -> str:
    each = "CASE WHEN length(w) <= 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END"
    return f"list_distinct(flatten(list_transform(list_filter(string_split({norm(t)}, ' '), lambda w: w <> ''), lambda w: {each})))"


CONV = """conv_c AS (SELECT conv_id::VARCHAR AS item_id, conv_id * 1048576 + turn AS pos, text, CASE WHEN role = 'user' THEN 'Answer' ELSE 'Clarification' END AS kind FROM conversations)"""
BENCH = "bench_q AS (SELECT item_id AS question_id, text AS question FROM benchmark)"
VEC = "vec_c AS (SELECT label::VARCHAR AS item_id, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings), vec_q AS (SELECT pos AS question_id, v FROM vec_c WHERE pos % 20 = 0)"
MIX = """mix_c AS (SELECT label::VARCHAR AS item_id, vec_id AS pos, text, CASE WHEN label % 2 = 0 THEN 'Answer' ELSE 'Clarification' END AS kind, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON vec_id = doc_id),
mix_q AS (SELECT pos AS question_id, text AS question, v FROM mix_c WHERE pos % 20 = 0 AND length(trim(text)) > 0)"""


def bm25(c: str, q: str, p: str) -> str:
    return f"""{p}t AS MATERIALIZED (SELECT item_id, pos, {terms("text")} AS ws FROM {c}),
{p}tf AS MATERIALIZED (SELECT item_id, pos, len(ws)::DOUBLE AS dl, w AS term, count(*)::DOUBLE AS tf FROM (SELECT item_id, pos, ws, unnest(ws) AS w FROM {p}t) GROUP BY item_id, pos, ws, w),
{p}st AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS avgdl FROM {p}t),
{p}df AS (SELECT term, count(*)::DOUBLE AS df FROM {p}tf GROUP BY term),
{p}qt AS (SELECT DISTINCT question_id, unnest({terms("question")}) AS term FROM {q}),
{p}s AS (SELECT question_id, item_id, pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {p}qt JOIN {p}tf USING (term) JOIN {p}df USING (term), {p}st GROUP BY question_id, item_id, pos)"""


def weighted(c: str, q: str, p: str) -> str:
    return f"""{p}g AS MATERIALIZED (SELECT item_id, pos, unnest({grams("text")}) AS gram FROM {c}),
{p}n AS (SELECT count(*)::DOUBLE AS n FROM {c}),
{p}i AS MATERIALIZED (SELECT gram, ln((any_value(n) + 1) / (count(*)::DOUBLE + 1)) + 1 AS w FROM {p}g, {p}n GROUP BY gram),
{p}o AS (SELECT item_id, pos, sum(w) AS own FROM {p}g JOIN {p}i USING (gram) GROUP BY item_id, pos),
{p}q AS MATERIALIZED (SELECT question_id, gram, coalesce(w, ln(n + 1) + 1) AS w FROM (SELECT question_id, unnest({grams("question")}) AS gram FROM {q}) LEFT JOIN {p}i USING (gram), {p}n),
{p}a AS (SELECT question_id, sum(w) AS asked FROM {p}q GROUP BY question_id),
{p}b AS (SELECT question_id, item_id, pos, sum(i.w) AS common FROM {p}q AS x JOIN {p}g AS y USING (gram) JOIN {p}i AS i USING (gram) GROUP BY question_id, item_id, pos),
{p}s AS (SELECT question_id, item_id, pos, 2 * common / (own + asked) AS score FROM {p}b JOIN {p}o USING (item_id, pos) JOIN {p}a USING (question_id))"""


def dice(c: str, q: str, p: str) -> str:
    return f"""{p}x AS (SELECT question_id, {grams("question")} AS qg FROM {q}),
{p}y AS (SELECT item_id, pos, {grams("text")} AS cg FROM {c}),
{p}s AS (SELECT question_id, item_id, pos, 2.0::DOUBLE * len(list_intersect(qg, cg)) / (len(qg) + len(cg)) AS score FROM {p}x, {p}y WHERE list_has_any(qg, cg))"""


def cosine(c: str, q: str, p: str) -> str:
    return f"{p}s AS (SELECT question_id, item_id, pos, list_cosine_similarity(q.v, c.v) AS score FROM {q} AS q, {c} AS c)"


def centroid(c: str, p: str) -> str:
    return f"""{p}e AS (SELECT item_id, pos, unnest(v) AS x, unnest(range(len(v))) AS i FROM {c}),
{p}m AS (SELECT item_id, i, avg(x) AS x FROM {p}e GROUP BY item_id, i),
{p}l AS (SELECT item_id, sqrt(sum(x * x)) AS l FROM {p}m GROUP BY item_id),
{p}u AS (SELECT item_id, i, x / l AS x FROM {p}m JOIN {p}l USING (item_id)),
{p}c AS (SELECT u.item_id, p.pos, u.v FROM (SELECT item_id, list(x ORDER BY i) AS v FROM {p}u GROUP BY item_id) AS u JOIN (SELECT item_id, min(pos) AS pos FROM {c} GROUP BY item_id) AS p USING (item_id))"""


def ranked(s: str, c: str, p: str, k: int | None) -> str:
    """Best phrasing, then rank, as p + 'r'."""
    cut = f"WHERE rank <= {k}" if k else ""
    return f"""{p}best AS (SELECT * FROM {s} QUALIFY row_number() OVER (PARTITION BY question_id, item_id ORDER BY round(score, 9) DESC, pos) = 1),
{p}first AS (SELECT item_id, min(pos) AS fp FROM {c} GROUP BY item_id),
{p}r AS (SELECT * FROM (SELECT question_id, item_id, pos, score, (row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, fp))::INT AS rank FROM {p}best JOIN {p}first USING (item_id)) {cut})"""


def runner_up(r: str, p: str, alone: str = "NULL") -> str:
    return f"""{p}w AS (SELECT question_id, item_id, pos, score, lead(item_id) OVER o AS second_item_id, lead(score) OVER o AS second_score, rank FROM {r} WHERE rank <= 2 WINDOW o AS (PARTITION BY question_id ORDER BY rank)),
{p}2 AS (SELECT question_id, item_id, pos, score, second_item_id, second_score, coalesce(score - second_score, {alone}) AS margin FROM {p}w WHERE rank = 1)"""


def four(c: str, q: str, k: int, t: str = "") -> str:
    """Four rankings; t sets their names apart from others in a statement."""
    return ", ".join([
        cosine(c, q, f"{t}se"), ranked(f"{t}ses", c, f"{t}se", k),
        centroid(c, f"{t}ce"), cosine(f"{t}cec", q, f"{t}ce"), ranked(f"{t}ces", c, f"{t}ce", k),
        weighted(c, q, f"{t}le"), f"{t}lep AS (SELECT * FROM {t}les WHERE score > 0)", ranked(f"{t}lep", c, f"{t}le", k),
        bm25(c, q, f"{t}bm"), ranked(f"{t}bms", c, f"{t}bm", k),
    ])


_PREFIX = dict(zip(RANKERS, ("se", "ce", "le", "bm"), strict=True))


def fused(c: str, q: str, k: int = 10, t: str = "") -> str:
    tagged = " UNION ALL ".join(f"SELECT question_id, item_id, '{n}' AS ranker, rank, score FROM {t}{p}r" for n, p in _PREFIX.items())
    ranks = ", ".join(f"max(CASE WHEN ranker = '{n}' THEN rank END) AS {n}_rank, max(CASE WHEN ranker = '{n}' THEN score END) AS {n}_score" for n in RANKERS)
    rrf = " + ".join(f"coalesce(1.0::DOUBLE / (60 + {n}_rank), 0)" for n in RANKERS)
    return f"""{four(c, q, k, t)}, tagged AS ({tagged}),
wide AS (SELECT question_id, item_id, {ranks}, count(*)::INT AS strategies, min(rank) AS best_rank FROM tagged GROUP BY question_id, item_id),
scored AS (SELECT *, {rrf} AS rrf FROM wide),
ev AS (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 12) DESC, strategies DESC, best_rank, item_id))::INT AS place FROM scored)"""


TOP = "SELECT question_id, rank, item_id, pos, round(score, 6) AS score FROM {}"
BEST = "SELECT question_id, item_id, pos, round(score, 6) AS score, second_item_id, round(second_score, 6) AS second_score, round(margin, 6) AS margin FROM {}"


def _blend(lexical: str) -> str:
    return "bls AS (SELECT question_id, item_id, pos, 0.85::DOUBLE * a.score + 0.15::DOUBLE * coalesce(b.score, 0) AS score FROM ses AS a LEFT JOIN " + lexical + " AS b USING (question_id, item_id, pos))"


_RERANK = ", ".join([
    cosine("mix_c", "mix_q", "se"), ranked("ses", "mix_c", "se", 2), runner_up("ser", "se", "1.0::DOUBLE"),
    centroid("mix_c", "ce"), cosine("cec", "mix_q", "ce"), ranked("ces", "mix_c", "ce", 2), runner_up("cer", "ce", "1.0::DOUBLE"),
])
_RERANK += """, rr AS (SELECT *, CASE WHEN strategy = 'Centroid' THEN centroid_item_id ELSE semantic_item_id END AS item_id FROM (
  SELECT question_id, a.item_id AS semantic_item_id, a.score AS semantic_score, a.margin AS semantic_margin, b.item_id AS centroid_item_id, b.score AS centroid_score, b.margin AS centroid_margin,
         CASE WHEN a.item_id = b.item_id THEN 'Agreement' WHEN round(a.margin, 9) >= round(b.margin, 9) THEN 'Semantic' ELSE 'Centroid' END AS strategy
  FROM se2 AS a JOIN ce2 AS b USING (question_id)))"""

_DISCRIMINATIVE = f"""own AS (SELECT DISTINCT item_id, unnest({terms("text")}) AS term FROM mix_c),
uniq AS (SELECT question_id, term, min(item_id) AS item_id FROM ev JOIN own USING (item_id) GROUP BY question_id, term HAVING count(*) = 1),
named AS (SELECT DISTINCT question_id, unnest({terms("question")}) AS term, true AS named FROM mix_q),
dt AS (SELECT question_id, item_id, count(*)::INT AS n_unique, coalesce(array_to_string(list_sort(list(term) FILTER (WHERE named)), ' '), '') AS matched, (count(*) FILTER (WHERE named))::INT AS n_matched
  FROM uniq LEFT JOIN named USING (question_id, term) GROUP BY question_id, item_id),
disc AS (SELECT question_id, item_id, coalesce(n_unique, 0)::INT AS n_unique, coalesce(matched, '') AS matched, coalesce(n_matched, 0)::INT AS n_matched FROM ev LEFT JOIN dt USING (question_id, item_id))"""

_ANSWERS = "ans_c AS (SELECT * FROM mix_c WHERE kind = 'Answer')"

_VALUES = """headers AS (SELECT o_orderkey AS id, o_orderdate AS created_at, lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS form_name FROM orders),
vals AS (
  SELECT o_orderkey AS submission_id, 'fullname' AS key, 'customer ' || o_custkey AS value FROM orders
  UNION ALL SELECT o_orderkey, 'mobile', '09' || right(lpad(o_custkey::VARCHAR, 9, '0'), 9) FROM orders
  UNION ALL SELECT o_orderkey, 'request_type', o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 'message', o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, 'resume_file', CASE WHEN o_orderkey % 3 = 0 THEN 'file' || o_orderkey END FROM orders)"""

_TREE = """tree AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, 1 AS level, r_regionkey::BIGINT AS sort_order, 'region' AS type, r_regionkey % 5 <> 0 AS has_template, TIMESTAMP '1970-01-01' AS made, '/' || lower(r_name) AS url FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, n_nationkey, 'nation', n_nationkey % 5 <> 0, TIMESTAMP '1970-01-01', '/a&b/' || lower(n_name) FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3, c_custkey, 'customer', c_custkey % 5 <> 0, TIMESTAMP '1970-01-01', CASE WHEN c_custkey % 4 = 0 THEN '#' ELSE '/c/' || c_custkey END FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 4, o_orderkey, 'order', o_orderkey % 5 <> 0, o_orderdate, '/o/' || o_orderkey FROM orders)"""

_WINDOW = "time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')"
_ITEMS = "{0}_items AS (SELECT item_id, arg_min(kind, pos) AS kind, arg_min(text, pos) AS label FROM {0}_c GROUP BY item_id)"
_PUNCT = norm("text")



def exact(c: str) -> str:
    return f"""read AS (SELECT item_id, pos, kind, {norm("text")} AS read FROM {c}),
known AS (SELECT kind, read, arg_min(item_id, pos) AS item_id, min(pos) AS pos FROM read WHERE read <> '' GROUP BY kind, read)"""


_ROUTE = f"""{MIX.split("mix_q AS")[0]}
asked AS (SELECT pos AS question_id, CASE WHEN pos % 60 = 0 THEN text ELSE 'unheard ' || text END AS question, v FROM mix_c WHERE pos % 20 = 0),
{exact("mix_c")},
found AS (SELECT question_id, question, v, a.item_id AS answer_item, b.item_id AS clarify_item
  FROM asked LEFT JOIN known AS a ON a.kind = 'Answer' AND a.read = {norm("question")} LEFT JOIN known AS b ON b.kind = 'Clarification' AND b.read = {norm("question")}
  WHERE length(trim(question)) > 0),
rest AS (SELECT question_id, question, v FROM found WHERE answer_item IS NULL AND clarify_item IS NULL),
ans_c AS (SELECT * FROM mix_c WHERE kind = 'Answer'),
{fused("ans_c", "rest")},
{_ITEMS.format("mix")},
inside AS (SELECT question_id FROM ev GROUP BY question_id HAVING round(coalesce(max(semantic_score), 0), 9) >= 0.5),
offer AS (SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY place) AS n FROM ev JOIN inside USING (question_id) JOIN mix_items USING (item_id) WHERE mix_items.kind = 'Answer'),
lists AS (SELECT question_id, string_agg(item_id, ',' ORDER BY n) AS s FROM offer WHERE n <= 3 GROUP BY question_id)
SELECT question_id, CASE WHEN answer_item IS NOT NULL THEN 'Answer' WHEN clarify_item IS NOT NULL THEN 'Clarification' WHEN s IS NOT NULL THEN 'Suggestions' ELSE 'Fallback' END AS response_type,
       coalesce(answer_item, clarify_item) AS reply_item, coalesce(s, '') AS suggestions
FROM found LEFT JOIN lists USING (question_id)"""

_PATH = "'/' || trim(regexp_replace(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/')"

SQL: dict[str, str] = {
    "text_normalize": f"SELECT conv_id, turn, {_PUNCT} AS normal FROM conversations",
    "text_tokens": f"SELECT conv_id, turn, len(ws)::INT AS n_terms, coalesce(array_to_string(ws, ' '), '') AS terms FROM (SELECT conv_id, turn, {terms('text')} AS ws FROM conversations)",
    "char_trigrams": f"SELECT conv_id, turn, len(g)::INT AS n_grams, array_to_string(list_sort(g), '|') AS grams FROM (SELECT conv_id, turn, {grams('text')} AS g FROM conversations)",
    "bm25_df": f"WITH {CONV}, {BENCH}, {bm25('conv_c', 'bench_q', 'x')} SELECT term, df::BIGINT AS df FROM xdf",
    "bm25_corpus": f"WITH {CONV}, {BENCH}, {bm25('conv_c', 'bench_q', 'x')} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM xst",
    "trigram_idf": f"WITH {CONV}, g AS (SELECT unnest({grams('text')}) AS gram FROM conv_c), n AS (SELECT count(*)::DOUBLE AS n FROM conv_c) SELECT gram, count(*) AS df, round(ln((any_value(n) + 1) / (count(*)::DOUBLE + 1)) + 1, 6) AS idf, round(ln(any_value(n) + 1) + 1, 6) AS unseen_idf FROM g, n GROUP BY gram",
    "bm25_topk": f"WITH {CONV}, {BENCH}, {bm25('conv_c', 'bench_q', 'x')}, {ranked('xs', 'conv_c', 'x', 5)} " + TOP.format("xr"),
    "bm25_topk_by_kind": f"WITH {CONV}, {BENCH}, k_c AS (SELECT * FROM conv_c WHERE kind = 'Answer'), {bm25('k_c', 'bench_q', 'x')}, {ranked('xs', 'k_c', 'x', 5)} " + TOP.format("xr"),
    "dice_similarity": f"WITH {CONV}, {BENCH}, {dice('conv_c', 'bench_q', 'x')}, {ranked('xs', 'conv_c', 'x', 5)} " + TOP.format("xr"),
    "weighted_lexical_topk": f"WITH {CONV}, {BENCH}, {weighted('conv_c', 'bench_q', 'x')}, {ranked('xs', 'conv_c', 'x', 5)} " + TOP.format("xr"),
    "pruned_cosine_topk": f"WITH {VEC}, {cosine('vec_c', 'vec_q', 'x')}, {ranked('xs', 'vec_c', 'x', 5)} " + TOP.format("xr"),
    "cosine_topk": f"WITH {VEC}, {cosine('vec_c', 'vec_q', 'x')}, {ranked('xs', 'vec_c', 'x', 5)} " + TOP.format("xr"),
    "centroids": f"WITH {VEC}, {centroid('vec_c', 'x')} SELECT item_id, i::INT AS i, round(x, 6) AS x FROM xu",
    "centroid_topk": f"WITH {VEC}, {centroid('vec_c', 'x')}, {cosine('xc', 'vec_q', 'x')}, {ranked('xs', 'vec_c', 'x', 5)} " + TOP.format("xr"),
    "semantic_best_margin": f"WITH {VEC}, {cosine('vec_c', 'vec_q', 'x')}, {ranked('xs', 'vec_c', 'x', 2)}, {runner_up('xr', 'x')} " + BEST.format("x2"),
    "candidate_expansion": "WITH m AS (SELECT conv_id, trim(text) AS text, min(turn) AS turn FROM conversations WHERE length(trim(text)) > 0 GROUP BY conv_id, trim(text)) SELECT conv_id::VARCHAR AS item_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS place, text FROM m",
    "hybrid_best": f"WITH {MIX}, {cosine('mix_c', 'mix_q', 'se')}, {dice('mix_c', 'mix_q', 'di')}, {_blend('dis')}, {ranked('bls', 'mix_c', 'bl', 2)}, {runner_up('blr', 'bl')} " + BEST.format("bl2"),
    "weighted_hybrid_best": f"WITH {MIX}, {cosine('mix_c', 'mix_q', 'se')}, {weighted('mix_c', 'mix_q', 'le')}, {_blend('les')}, {ranked('bls', 'mix_c', 'bl', 2)}, {runner_up('blr', 'bl')} " + BEST.format("bl2"),
    "rrf_fusion": f"WITH {MIX}, {fused('mix_c', 'mix_q')} SELECT question_id, item_id, {', '.join(f'{r}_rank' for r in RANKERS)}, strategies, best_rank, round(rrf, 6) AS rrf, place FROM ev",
    "margin_rerank": f"WITH {MIX}, {_RERANK} SELECT question_id, semantic_item_id, round(semantic_score, 6) AS semantic_score, round(semantic_margin, 6) AS semantic_margin, centroid_item_id, round(centroid_score, 6) AS centroid_score, round(centroid_margin, 6) AS centroid_margin, strategy, item_id FROM rr",
    "semantic_decision": f"WITH {VEC}, half_q AS (SELECT * FROM vec_q WHERE question_id % 40 = 0), {cosine('vec_c', 'half_q', 'x')}, {ranked('xs', 'vec_c', 'x', 2)}, {runner_up('xr', 'x')} SELECT q.question_id, item_id, round(score, 6) AS score, round(margin, 6) AS margin, CASE WHEN score IS NULL OR round(score, 9) < 0.88 THEN 'NoMatch' WHEN round(margin, 9) < 0.05 THEN 'Ambiguous' ELSE 'Confident' END AS decision FROM vec_q AS q LEFT JOIN x2 ON x2.question_id = q.question_id",
    "no_match_gate": f"WITH {MIX}, {fused('mix_c', 'mix_q')} SELECT question_id, round(coalesce(max(semantic_score), 0), 6) AS best_score, CASE WHEN round(coalesce(max(semantic_score), 0), 9) < 0.875 THEN 'NoMatch' ELSE 'InDomain' END AS decision FROM ev GROUP BY question_id",
    "ambiguity_evidence": f"WITH {MIX}, {four('mix_c', 'mix_q', 2)}, {', '.join(runner_up(p + 'r', p) for p in _PREFIX.values())}, t AS ("
    + " UNION ALL ".join(f"SELECT question_id, '{n}' AS ranker, item_id, margin FROM {p}2" for n, p in _PREFIX.items())
    + "), v AS (SELECT question_id, max(c)::INT AS agreement FROM (SELECT question_id, item_id, count(*) AS c FROM t GROUP BY question_id, item_id) GROUP BY question_id), w AS (SELECT question_id, "
    + ", ".join(f"max(CASE WHEN ranker = '{n}' THEN item_id END) AS {n}_item_id, round(max(CASE WHEN ranker = '{n}' THEN margin END), 6) AS {n}_margin" for n in RANKERS)
    + ", count(*)::INT AS active FROM t GROUP BY question_id) SELECT * FROM w JOIN v USING (question_id) WHERE semantic_item_id IS NOT NULL",
    "intent_sets": f"WITH {MIX}, {fused('mix_c', 'mix_q')}, s AS (SELECT question_id, item_id, place, best_rank, "
    + " + ".join(f"coalesce(({r}_rank = 1)::INT, 0)" for r in RANKERS) + " AS top1, " + " + ".join(f"coalesce(({r}_rank <= 2)::INT, 0)" for r in RANKERS)
    + " AS top2 FROM ev) SELECT question_id, item_id, top1, top2, best_rank, (row_number() OVER (PARTITION BY question_id ORDER BY top1 DESC, top2 DESC, best_rank, place))::INT AS intent_place FROM s WHERE top2 > 0",
    "intent_gap": f"WITH {MIX}, {fused('mix_c', 'mix_q')}, s AS (SELECT question_id, "
    + " + ".join(f"coalesce(({r}_rank = 1)::INT, 0)" for r in RANKERS) + " AS top1 FROM ev WHERE best_rank <= 2), l AS (SELECT question_id, list_reverse_sort(list(top1)) AS s FROM s GROUP BY question_id)"
    + " SELECT question_id, coalesce(len(s), 0)::INT AS n_intents, coalesce(s[1], 0)::INT AS max_support, coalesce(s[2], 0)::INT AS second_support, (coalesce(s[1], 0) - coalesce(s[2], 0))::INT AS gap FROM mix_q LEFT JOIN l USING (question_id)",
    "discriminative_terms": f"WITH {MIX}, {_ANSWERS}, {fused('ans_c', 'mix_q')}, {_DISCRIMINATIVE} SELECT * FROM disc",
    "winner_discriminative": f"WITH {MIX}, {_ANSWERS}, {_RERANK.replace('mix_c', 'ans_c')}, wn AS (SELECT question_id, item_id, strategy FROM rr), "
    + fused("ans_c", "mix_q", t="f_") + f", {_DISCRIMINATIVE} SELECT wn.question_id, wn.item_id, strategy, n_unique, matched, n_matched FROM wn LEFT JOIN disc USING (question_id, item_id)",
    "exact_match": f"WITH {CONV}, {exact('conv_c')} SELECT r.pos AS question_id, k.item_id, k.pos, k.kind FROM read AS r JOIN known AS k ON r.read = k.read",
    "message_routing": f"WITH {_ROUTE}",
    "suggestion_select": f"WITH {CONV}, {_ITEMS.format('conv')} SELECT b.item_id AS question_id, i.item_id, i.label FROM benchmark AS b JOIN conv_items AS i ON i.item_id = b.item_id::VARCHAR WHERE i.kind = 'Answer'",
    "index_upsert": f"WITH {CONV}, ch AS (SELECT item_id, pos, text || ' (new)' AS text, kind FROM conv_c WHERE item_id::BIGINT % 2 = 0) SELECT * FROM conv_c WHERE item_id NOT IN (SELECT item_id FROM ch) UNION ALL SELECT item_id, (SELECT max(pos) FROM conv_c) + 1 + pos - (SELECT min(pos) FROM ch), text, kind FROM ch",
    "index_delete": f"WITH {CONV} SELECT * FROM conv_c WHERE item_id::BIGINT % 3 <> 0",
    "eav_unpivot": f"WITH {_VALUES} SELECT * FROM vals",
    "eav_pivot_latest": f"WITH {_VALUES} SELECT h.id, h.created_at, coalesce(max(CASE WHEN key = 'fullname' THEN value END), '') AS fullname, coalesce(max(CASE WHEN key = 'mobile' THEN value END), '') AS mobile, coalesce(max(CASE WHEN key = 'request_type' THEN value END), '') AS request_type, max(CASE WHEN key = 'message' THEN value END) AS message, max(CASE WHEN key = 'resume_file' AND value IS NOT NULL THEN 1 ELSE 0 END) = 1 AS has_file FROM headers AS h LEFT JOIN vals ON submission_id = h.id WHERE form_name = 'urgent' GROUP BY h.id, h.created_at ORDER BY h.id DESC LIMIT 100",
    "eav_lookup": f"WITH {_VALUES} SELECT h.id, min(value) AS value FROM headers AS h JOIN vals ON submission_id = h.id WHERE key = 'resume_file' AND value IS NOT NULL GROUP BY h.id",
    "form_validation": """WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ' x ' ELSE right(c_name, 4) END AS name, '09' || substr(c_custkey::VARCHAR, 1, 3) || right(lpad(c_nationkey::VARCHAR, 6, '0'), 6) AS mobile, c_mktsegment AS seg, c_name AS msg,
        CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS form, c_acctbal > 0 AS has_file, CASE WHEN c_custkey % 2 = 0 THEN 'job_interest_form' WHEN c_custkey % 3 = 0 THEN 'product_demo_form' ELSE lower(trim(c_mktsegment)) END AS ff FROM customer)
      SELECT c_custkey, concat_ws(',', CASE WHEN length(trim(name)) < 2 OR length(trim(name)) > 100 THEN 'fullname' END, CASE WHEN NOT regexp_full_match(mobile, '09[0-9]{9}') THEN 'mobile' END,
        CASE WHEN length(trim(seg)) = 0 OR length(seg) > 60 THEN 'request_type' END, CASE WHEN length(msg) > 2000 THEN 'message' END, CASE WHEN length(trim(form)) = 0 OR length(form) > 80 THEN 'form' END) AS errors,
        CASE WHEN ff NOT IN ('contact_form', 'job_interest_form', 'product_demo_form', 'consult_form') THEN 'unknown_form' WHEN (ff = 'job_interest_form' AND NOT has_file) OR (ff <> 'job_interest_form' AND has_file) THEN 'file' ELSE 'ok' END AS file_rule FROM f""",
    "local_time": "SELECT event_id, strftime(timezone('Asia/Tehran', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS local FROM events",
    "json_expiry": "WITH e AS (SELECT event_id, ts, ts + to_minutes(CAST(props->>'k' AS BIGINT) - 40) AS s FROM events) SELECT event_id, CASE WHEN s > ts THEN s ELSE ts + INTERVAL 30 MINUTE END AS expires FROM e",
    "title_classify": "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'large' WHEN regexp_matches(lower(p_type), 'steel|tin|nickel|brass|copper') THEN 'metal' WHEN regexp_matches(lower(p_type), 'polished|brushed|plated') THEN 'finish' ELSE 'uncategorized' END AS class FROM part",
    "digit_fold": f"WITH p AS (SELECT c_custkey, translate(c_name, '{ASCII_DIGITS}', '{PERSIAN_DIGITS}') AS persian FROM customer) SELECT c_custkey, persian, translate(persian, '{PERSIAN_DIGITS}{ARABIC_DIGITS}', '{ASCII_DIGITS * 2}') AS ascii FROM p",
    "seed_anti_join": "WITH n AS (SELECT p_partkey, lower(p_name) || p_partkey AS name, p_size FROM part) SELECT * FROM n WHERE name NOT IN (SELECT name FROM n WHERE p_size > 10)",
    "fixed_window_limiter": f"WITH w AS (SELECT event_id, user_id, {_WINDOW} AS window_start, ts FROM events) SELECT event_id, user_id, window_start, (row_number() OVER o)::INT AS n, row_number() OVER o <= 3 AS allowed FROM w WINDOW o AS (PARTITION BY user_id, window_start ORDER BY ts, event_id)",
    "window_rejections": f"SELECT user_id, {_WINDOW} AS window_start, count(*) AS n, greatest(0, count(*) - 3) AS rejected FROM events GROUP BY user_id, window_start",
    "cache_key": f"SELECT conv_id, turn, '7:' || upper(sha256({_PUNCT})) AS key FROM conversations",
    "metrics_summary": "WITH m AS (SELECT event_type, count(*) AS n, sum(value) AS total, max(value) AS largest, arg_min(value, {'t': ts, 'e': event_id}) AS f FROM events GROUP BY event_type) SELECT event_type, n, round(total, 6) AS total, round(largest, 6) AS largest, round(f, 6) AS first_value, round(total / n, 6) AS mean, round(coalesce((total - f) / nullif(n - 1, 0), 0), 6) AS later_mean FROM m",
    "tree_descendants": f"WITH RECURSIVE {_TREE}, below AS (SELECT id, id AS root_id, 0 AS distance FROM tree WHERE level = 1 UNION ALL SELECT t.id, b.root_id, b.distance + 1 FROM below AS b JOIN tree AS t ON t.parent_id = b.id) SELECT root_id, distance, count(*) AS n FROM below WHERE distance > 0 GROUP BY root_id, distance",
    "latest_pages": f"WITH {_TREE} SELECT id, made AS create_date FROM tree WHERE type = 'order' ORDER BY made DESC, id LIMIT 12",
    "child_order": f"WITH {_TREE} SELECT id, parent_id, (row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, id))::INT AS place FROM tree WHERE type = 'nation'",
    "sitemap": f"WITH {_TREE} SELECT id, level, sort_order, replace(url, '&', '&amp;') AS loc, strftime(made, '%Y-%m-%d') AS lastmod, (CASE level WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END)::DOUBLE AS priority FROM tree WHERE has_template AND url <> '#'",
    "parent_urls": f"WITH {_TREE} SELECT t.id, coalesce(p.url, '/home') AS parent_url FROM tree AS t LEFT JOIN tree AS p ON p.id = t.parent_id",
    "ancestor_paths": f"WITH {_TREE}, a AS (SELECT c.id, {_PATH.format(chr(39) + 'https://shop.example.com' + chr(39) + ' || c.url')} AS path, r.url AS top FROM tree AS c JOIN tree AS n ON n.id = c.parent_id JOIN tree AS r ON r.id = n.parent_id WHERE c.level = 3) SELECT id, path, true AS active FROM a",
    "category_order": "WITH c AS (SELECT CASE WHEN n_nationkey = 7 THEN 'all' ELSE replace(replace(lower(trim(n_name)), ' ', '-'), '_', '-') END AS key, n_nationkey AS pos FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 3 = 1) SELECT key, (row_number() OVER (ORDER BY (key = 'all') DESC, pos))::INT AS place FROM c",
    "page_injection": f"""SELECT page_id, sha256(CASE WHEN contains(html, '<script src="/x.js"></script>') THEN html WHEN regexp_matches(html, '(?i)</body\\s*>') THEN regexp_replace(html, '(?is)^(.*)(</body\\s*>)', '\\1<script src="/x.js"></script>\\2') ELSE html || '<script src="/x.js"></script>' END) AS digest, {_PATH.format('url')} AS path FROM pages""",
}
