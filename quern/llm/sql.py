"""DuckDB SQL for the training-data queries that SQL can express; each is written apart from the Spark code."""

from __future__ import annotations

from quern.llm import licenses, quality

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep USING (doc_id)),
j AS (
  SELECT *, n_words < 50 AS a, 100 * n_repeat_words > 50 * n_words AS b, n_words > 1000000 AS c,
         word_chars < 2 * n_words OR word_chars > 15 * n_words AS d, n_symbols > 0.1::DOUBLE * n_words AS e,
         n_stop_words < 0.02::DOUBLE * n_words AS f, n_dup_lines > 0.5::DOUBLE * n_lines AS g
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a OR b AS base_failed,
       NOT (a OR b OR c OR d OR e OR f OR g) AS kept,
       concat_ws(',', CASE WHEN a THEN 'min_words' END, CASE WHEN b THEN 'repeat_words' END, CASE WHEN c THEN 'max_words' END,
                 CASE WHEN d THEN 'mean_word_chars' END, CASE WHEN e THEN 'symbol_ratio' END, CASE WHEN f THEN 'stop_words' END,
                 CASE WHEN g THEN 'dup_lines' END) AS failed_rules
FROM j
"""


def _regex(wording: str) -> str:
    """A template as a pattern over ' word word word '."""
    out, places = [], iter(licenses._TOKEN.findall(wording))
    for t in places:
        if t == "<<opt>>" or t == "<<":
            out.append("(?:")
        elif t == "<</opt>>":
            out.append(")?")
        elif t == ">>":
            out.append(")")
        elif t == "|":
            out.append("|")
        elif t.startswith("<<var:"):
            out.append(f"(?:[^ ]+ ){{0,{t[6:-2]}}}")
        else:
            out.append(f"{t} ")
    return " " + "".join(out)


def _op3() -> str:
    spots, labels, own = [], [], []
    for k, (label, wording) in enumerate(licenses.BASE):
        words = wording.split()
        literal = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        spots.append(f"list_filter(range(1, len(ws) - {len(words)} + 2), lambda i: ws[i:i + {len(words) - 1}] = {literal}) AS p{k}")
        own.append(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END")
    missed = [f"CASE WHEN len(p{k}) > 0 THEN {1 - licenses.BASE_WEIGHT}::DOUBLE ELSE 1::DOUBLE END" for k in range(len(licenses.BASE))]
    for label, weight, wording in licenses.TEMPLATES:
        hit = f"regexp_matches(norm, '{_regex(wording)}')"
        labels.append(f"CASE WHEN {hit} THEN '{label}' END")
        missed.append(f"CASE WHEN {hit} THEN (1::DOUBLE - {weight}::DOUBLE) ELSE 1::DOUBLE END")
    every = " || ".join(f"p{k}" for k in range(len(licenses.BASE)))
    tidy = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS norm, {", ".join(spots)} FROM w),
q AS (SELECT *, {every} AS ps FROM p)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ps)::BIGINT AS n_base, (list_min(ps) - 1)::BIGINT AS first_word, (list_max(ps) - 1)::BIGINT AS last_word,
       {tidy.format(", ".join(own))} AS base_labels, {tidy.format(", ".join([*own, *labels]))} AS labels,
       1 - {" * ".join(missed)} AS score
FROM q
"""


OP3 = _op3()

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.c) AS component_id
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""

#: Items and documents of five words and more.
OP6 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
ds AS (
  SELECT doc_id, nw, i, array_to_string(ws[i + 1:i + 5], ' ') AS gram
  FROM (SELECT doc_id, ws, len(ws) AS nw, unnest(range(0, len(ws) - 4)) AS i FROM dw WHERE len(ws) >= 5)),
bo AS (
  SELECT item_id, n, array_to_string(ws[i + 1:i + 5], ' ') AS gram
  FROM (SELECT item_id, ws, len(ws) AS n, unnest(range(0, len(ws) - 4)) AS i FROM bw WHERE len(ws) >= 5)),
bs AS (SELECT item_id, n, gram, count(*) AS c FROM bo GROUP BY item_id, n, gram),
pairs AS (
  SELECT ds.doc_id, bs.item_id, any_value(ds.nw) AS nw, any_value(bs.n) AS n
  FROM ds JOIN bs USING (gram) GROUP BY ds.doc_id, bs.item_id
  HAVING count(*) >= 0.8 * (any_value(bs.n) - 4)),
win AS (
  SELECT doc_id, item_id, n, least(n, nw) - 4 AS m, unnest(range(0, greatest(nw - n, 0) + 1)) AS first FROM pairs),
held AS (
  SELECT win.doc_id, win.item_id, win.n, win.m, win.first, ds.gram, count(*) AS c
  FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.i >= win.first AND ds.i < win.first + win.m
  GROUP BY win.doc_id, win.item_id, win.n, win.m, win.first, ds.gram),
scored AS (
  SELECT held.doc_id, held.item_id, held.n, held.m, held.first, sum(least(held.c, bs.c)) AS shared
  FROM held JOIN bs ON bs.item_id = held.item_id AND bs.gram = held.gram
  GROUP BY held.doc_id, held.item_id, held.n, held.m, held.first),
sim AS (SELECT *, shared::DOUBLE / (m + n - 4 - shared) AS similarity FROM scored)
SELECT doc_id, item_id, first::BIGINT AS first_word, (m + 4)::BIGINT AS n_words, similarity
FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first) = 1
"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
c AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS f FROM c),
i AS (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, k),
pc AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM sp),
r AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS c, max(b) AS e,
         string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept
  FROM pc JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


_SPACE = r"[\s\x0B\x{A0}]+"
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def _said(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '{_SPACE}', ' ', 'g'))"


OP9 = rf"""
WITH RECURSIVE m AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, coalesce(text, '')) = 1),
raw AS (
  SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS raw FROM (SELECT *, string_split(text, chr(10)) AS s FROM m WHERE regexp_matches(text, '(?m)^[ \t]*>'))),
marked AS (SELECT *, length(regexp_replace(regexp_extract(raw, '{_MARKS}', 1), '[ \t]', '', 'g')) AS depth, {_said(f"regexp_replace(raw, '{_MARKS}', '')")} AS words FROM raw),
seen AS (
  SELECT *, last_value(CASE WHEN words <> '' THEN depth END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next,
         (depth > 0 AND words <> '' AND (coalesce(lag(depth) OVER w, 0) <> depth OR coalesce(lag(words) OVER w = '', false)))::INT AS starts
  FROM marked WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
counted AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before, sum(starts) OVER (PARTITION BY conv_id, turn) AS quotes FROM seen),
lines AS (
  SELECT conv_id, turn, pos, raw, depth, words,
         CASE WHEN depth > 0 AND words <> '' THEN before - 1 WHEN depth > 0 THEN -1
              WHEN (coalesce(next, 0) > 0 AND regexp_matches(raw, '(?i)^\s*(?:on\s.{{1,200}}\s(?:wrote|said|writes)|.{{1,120}}\s(?:wrote|writes))\s*:?\s*$'))
                OR (before < quotes AND regexp_matches(raw, '(?i)^\s*-{{2,}}\s*original message\s*-{{2,}}\s*:?\s*$')) THEN before END AS place
  FROM counted),
quotes AS (
  SELECT conv_id, turn, place, any_value(depth) AS depth, count(*) AS n_lines, string_agg(words, ' ' ORDER BY pos) AS passage
  FROM lines WHERE depth > 0 AND place >= 0 GROUP BY conv_id, turn, place),
own AS (
  SELECT conv_id, turn, text FROM m WHERE NOT regexp_matches(text, '(?m)^[ \t]*>')
  UNION ALL SELECT conv_id, turn, string_agg(raw, chr(10) ORDER BY pos) FROM lines WHERE depth = 0 AND place IS NULL GROUP BY conv_id, turn),
spoken AS (
  SELECT conv_id, turn, words, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS k
  FROM (SELECT conv_id, turn, pos, {_said("line")} AS words FROM (SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS line FROM (SELECT *, string_split(text, chr(10)) AS s FROM own)))
  WHERE words <> ''),
said AS (
  SELECT DISTINCT * FROM (
    SELECT conv_id, turn, words AS passage FROM spoken
    UNION ALL SELECT conv_id, turn, {_said("p")} FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p FROM own)
    UNION ALL SELECT conv_id, turn, string_agg(words, ' ' ORDER BY k) FROM spoken GROUP BY conv_id, turn
    UNION ALL SELECT conv_id, turn, passage FROM (
      SELECT a.conv_id, a.turn, a.k, n, count(*) AS c, string_agg(b.words, ' ' ORDER BY b.k) AS passage
      FROM spoken AS a, (SELECT DISTINCT n_lines AS n FROM quotes WHERE n_lines > 1) JOIN spoken AS b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.k >= a.k AND b.k < a.k + n
      GROUP BY a.conv_id, a.turn, a.k, n) WHERE c = n)
  WHERE length(passage) >= 8),
near AS (SELECT q.conv_id, q.turn, q.place, max(s.turn) AS source FROM quotes AS q JOIN said AS s ON s.passage = q.passage AND s.conv_id = q.conv_id AND s.turn < q.turn GROUP BY q.conv_id, q.turn, q.place),
far AS (SELECT q.conv_id, q.turn, q.place, min({{'c': s.conv_id, 't': s.turn}}) AS source FROM quotes AS q JOIN said AS s ON s.passage = q.passage AND s.conv_id <> q.conv_id GROUP BY q.conv_id, q.turn, q.place),
links AS (
  SELECT q.conv_id, q.turn, q.place, q.depth, CASE WHEN n.source IS NOT NULL THEN q.conv_id ELSE f.source.c END AS cites_conv, coalesce(n.source, f.source.t) AS cites_turn
  FROM quotes AS q LEFT JOIN near AS n USING (conv_id, turn, place) LEFT JOIN far AS f USING (conv_id, turn, place)),
replies AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(cites_turn) AS n_linked,
         arg_min(cites_conv, {{'d': depth, 'p': place}}) FILTER (WHERE cites_turn IS NOT NULL) AS cites_conv, arg_min(cites_turn, {{'d': depth, 'p': place}}) FILTER (WHERE cites_turn IS NOT NULL) AS cites_turn,
         arg_min(cites_turn, {{'d': depth, 'p': place}}) FILTER (WHERE cites_conv = conv_id) AS parent
  FROM links GROUP BY conv_id, turn),
bodies AS (
  SELECT l.conv_id, l.turn, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE k.place IS NULL AND coalesce(l.place, 0) >= 0), '') AS body
  FROM lines AS l JOIN (SELECT DISTINCT conv_id, turn FROM links WHERE cites_turn IS NOT NULL) USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn, place FROM links WHERE cites_turn IS NOT NULL) AS k ON k.conv_id = l.conv_id AND k.turn = l.turn AND k.place = l.place
  GROUP BY l.conv_id, l.turn),
up AS (
  SELECT conv_id, turn, parent AS root FROM replies WHERE parent IS NOT NULL
  UNION ALL SELECT u.conv_id, u.turn, r.parent FROM up AS u JOIN replies AS r ON r.conv_id = u.conv_id AND r.turn = u.root WHERE r.parent IS NOT NULL),
roots AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY conv_id, turn),
done AS (
  SELECT m.conv_id, m.turn, coalesce(root, m.turn) AS thread, role,
         CASE WHEN body IS NULL THEN text ELSE regexp_replace(body, '^(?:[ \t\r\f\x0B]*\n)+|(?:\n[ \t\r\f\x0B]*)+$', '', 'g') END AS text,
         parent AS reply_to, cites_conv, cites_turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked
  FROM m LEFT JOIN replies USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn) LEFT JOIN bodies USING (conv_id, turn))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS place, turn, thread, role, text, reply_to, cites_conv, cites_turn, n_quotes, n_linked FROM done
"""

OP12 = r"""
WITH dt AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM documents),
it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM dt GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM n, c),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM it JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _crc_table() -> list[int]:
    """The 256 remainders of the checksum, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: Near words share themselves or a text with one code point deleted; no bigrams here.
OP13 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
t AS MATERIALIZED (SELECT {_crc_table()}::BIGINT[] AS t),
h AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8))) AS h
  FROM each, t),
words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
less AS (
  SELECT word, n, 0 AS i, word AS v FROM words
  UNION ALL SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (v)
  WHERE a.word <> b.word AND (a.i = 0 OR b.i = 0 OR a.i = b.i)),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS here, 0 AS steps FROM formed
  UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN formed f ON w.here = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
