"""DuckDB SQL for the queries whose rows SQL can give in reasonable time."""

from __future__ import annotations

from . import license_scan, mixing

#: Pairs to components: all that links reach from each node.
_REACH = """both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT id, id FROM ids UNION SELECT r.x, both_ways.b FROM r JOIN both_ways ON r.y = both_ways.a),
c AS (SELECT x AS id, min(y) AS component_id FROM r GROUP BY x)"""

COVER_TREE = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT p.id AS a, q.id AS b FROM ids p JOIN ids q ON p.id < q.id WHERE list_cosine_similarity(p.v, q.v) >= 0.95), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM both_ways WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM c"""

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id AS id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] END) AS s FROM w),
ids AS (SELECT id, len(s) AS n FROM s), e AS (SELECT id, unnest(s) AS x FROM s),
p AS (SELECT g.id AS a, h.id AS b, count(*) AS n FROM e g JOIN e h ON g.x = h.x AND g.id < h.id GROUP BY g.id, h.id),
l AS (SELECT a, b FROM p JOIN ids g ON g.id = a JOIN ids h ON h.id = b WHERE 100 * p.n >= 80 * (g.n + h.n - p.n)), {_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM c JOIN ids USING (id)"""

_Z = "list_sum(list_transform(v, lambda x: pow(x, {m})))"
_H = f"(ln({_Z}) - list_sum(list_transform(v, lambda x: pow(x, {{m}}) * ln(pow(x, {{m}})))) / {_Z}) / ln(len(v))"


def _entropy(m: str) -> str:
    return "(" + _H.replace("{m}", m) + ")"


MIXING = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS s, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) + 1 AS tokens,
  CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
n AS (SELECT s, sum(tokens)::BIGINT AS al, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM d) AS share FROM d GROUP BY s), v AS (SELECT list(share ORDER BY s) AS v FROM n),
b(step, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END FROM (SELECT step, low, high, {_entropy('(low + high) / 2')} >= {mixing.ENTROPY} AS ok FROM b, v) WHERE step < {mixing.STEPS}),
t AS (SELECT CASE WHEN len(v) < 2 OR {_entropy('1.0')} >= {mixing.ENTROPY} THEN 1.0 ELSE (SELECT low FROM b WHERE step = {mixing.STEPS}) END AS tau FROM v),
z AS (SELECT s, al, round(pow(share, tau) / (SELECT sum(pow(share, tau)) FROM n) * (SELECT sum(tokens) FROM d) / al, 9) AS passes FROM n, t),
o AS (SELECT *, (sum(tokens) OVER (PARTITION BY s ORDER BY k % {mixing.BUCKETS}, k ROWS UNBOUNDED PRECEDING) - tokens)::DOUBLE / al AS spot FROM d JOIN z USING (s)),
c AS (SELECT *, unnest(range(floor(passes)::BIGINT + CASE WHEN spot < passes - floor(passes) THEN 1 ELSE 0 END)) AS pass FROM o)
SELECT doc_id, source, tokens, pass, least(floor((pass + spot) / passes * {mixing.BLOCKS}), {mixing.BLOCKS - 1})::INT AS block FROM c"""


HARD_NEGATIVES = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""

_FLAT = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"
EXACT_DEDUP = f"""WITH d AS (SELECT doc_id, {_FLAT} AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op2_cover_tree": COVER_TREE, "op5_minhash_near_dedup": NEAR_DEDUP, "op6_license_scan": license_scan.oracle(), "op10_mixing": MIXING, "op12_hard_negatives": HARD_NEGATIVES, "op13_exact_dedup": EXACT_DEDUP}
