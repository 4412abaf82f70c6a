"""DuckDB SQL that gives the registered queries' rows on its own terms."""

from __future__ import annotations

from ..config import (
    CONTENT_TYPES,
    CORRECTION_PHRASES,
    EXCLUDED_SOURCES,
    FILLER_WORDS,
    HALF_LIFE_DAYS,
    HARD_CUTOFF_HOURS,
    IMPACT,
    IMPORTANCE,
    IMPORTANCE_BOOSTERS,
    INTENTS,
    LATEST_WINS,
    LEGACY,
    LEVELS,
    MILESTONE_KEYWORDS,
    MILESTONE_LABELS,
    MONTH_DAYS,
    MONTHS,
    OVERLAP_STOPWORDS,
    QUERY_STOPWORDS,
    REINGEST_SOURCES,
    SUPERSEDES,
    TAG_WORDS,
    TAXONOMY,
    TEMPORAL,
    TONES,
    WEEKDAYS,
    RankConfig,
)
from ..sources.views import SOURCES
from . import fixtures as X


def q(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool | int | float):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def listed(xs) -> str:  # noqa: ANN001
    return "[" + ", ".join(map(q, xs)) + "]"


def inside(xs) -> str:  # noqa: ANN001
    return "(" + ", ".join(map(q, xs)) + ")"


def values(rows, names: str) -> str:  # noqa: ANN001
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") v({names}))"


def case(pairs, default: str = "NULL") -> str:  # noqa: ANN001
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END"


AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
SUBS = case([(f"entity_type = {q(k)}", listed(v)) for k, v in TAXONOMY.items()])
MEM = f"""mem0 AS (
  SELECT doc_id, text, ({listed(SOURCES)})[CAST(substr(source, 4) AS INT) + 1] AS source, 'u' || ((doc_id // 20) % 10) AS user_id, 'p0' AS persona_id FROM documents),
mem1 AS (SELECT *, CASE WHEN source LIKE 'extracted\\_%' ESCAPE '\\' THEN upper(substr(source, 11)) END AS entity_type, source = 'extracted_milestone' AS is_milestone FROM mem0),
mem AS (SELECT *, ({SUBS})[((doc_id // 20) % len({SUBS})) + 1] AS entity_subtype, CASE WHEN is_milestone THEN 10 ELSE 1 + (doc_id // 3) % 10 END AS importance,
  {AS_OF} - to_hours(CAST((doc_id * 37) % 2160 AS INT)) AS ts, substr(sha256('s0:' || user_id || ':' || text), 1, 32) AS mem_id FROM mem1)"""
VEC = "vec AS (SELECT m.*, e.embedding FROM mem m JOIN embeddings e ON m.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id)"
ASK = "ask AS (SELECT e.vec_id AS qid, 'u' || ((e.vec_id // 20) % 10) AS quser, d.text AS qtext, e.embedding AS qvec FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 20 = 0)"
DIST = "round(power(list_distance(embedding::DOUBLE[], qvec::DOUBLE[]), 2), 6)"


def near(name: str, k: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS knn_rank FROM
      (SELECT qid, quser, qtext, v.* EXCLUDE (embedding), {DIST} AS distance FROM vec v, ask WHERE {where})) WHERE knn_rank <= {k})"""


PRE = f"WITH {MEM}, {VEC}, {ASK}"
TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower(qtext), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda w: NOT list_contains({listed(QUERY_STOPWORDS)}, w))"
SHARE = f"CASE WHEN len({TOKENS}) = 0 THEN 0.0 ELSE len(list_filter({TOKENS}, lambda w: contains(lower(text), w)))::DOUBLE / len({TOKENS}) END"
SECONDS = f"greatest(0, date_diff('second', ts, {AS_OF}))"
ECHO = f"source NOT IN {inside(EXCLUDED_SOURCES)} AND NOT (source = 'extracted_person' AND length(text) < 80)"


def decay(cfg: RankConfig) -> str:
    half = case([("is_milestone", cfg.milestone_half_life), *((f"source = {q(s)}", v) for s, v in cfg.half_life.items())], str(cfg.default_half_life))
    return f"power(0.5, ({SECONDS} // 86400)::DOUBLE / ({half}))"


def ranked(name: str, source: str, cfg: RankConfig, where: str = "true") -> str:
    sim, imp, kw = "least(1.0, greatest(0.0, 1 - distance / 2))", "least(importance / 10::DOUBLE, 1.0)", f"(({SHARE}) * {cfg.keyword})"
    fresh = f"CASE WHEN {SECONDS} < {cfg.fresh_hours * 3600} THEN {cfg.fresh} ELSE 0.0 END"
    score = f"least(1.0, {cfg.importance} * imp + {cfg.recency} * rec + {cfg.similarity} * sim + kw + fresh) + CASE WHEN is_milestone THEN {cfg.milestone} ELSE 0.0 END"
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, knn_rank) AS rank FROM (
      SELECT *, round(sim, 3) AS s_similarity, round(imp, 3) AS s_importance, round(rec, 3) AS s_recency, round(kw, 3) AS s_keyword, round({score}, 4) AS final_score FROM (
      SELECT *, ({sim})::DOUBLE AS sim, ({imp})::DOUBLE AS imp, ({decay(cfg)})::DOUBLE AS rec, ({kw})::DOUBLE AS kw, ({fresh})::DOUBLE AS fresh FROM {source} WHERE {where})))"""


CFG = RankConfig()
CUT = case([(f"source = {q(s)}", h) for s, h in HARD_CUTOFF_HOURS.items()])
YOUNG = f"(({CUT}) IS NULL OR ts IS NULL OR {SECONDS} / 3600.0 <= ({CUT}))"
POOL = f"{PRE}, {near('pool', 30)}, {ranked('ranked', 'pool', CFG, ECHO)}"
SCORES = "qid, doc_id, s_similarity, s_importance, s_recency, s_keyword, final_score, rank"
TOKS = f"list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')), lambda w: w <> '' AND NOT list_contains({listed(OVERLAP_STOPWORDS)}, w))"


def mmr(source: str, penalty: str = "0.8", n: int = 3, key: str = "qid") -> str:
    """CTEs m1 to mn, the choices one after the other."""
    over = "CASE WHEN len(a.tok) = 0 OR len(b.tok) = 0 THEN 0.0 ELSE len(list_intersect(a.tok, b.tok))::DOUBLE / greatest(len(a.tok), len(b.tok)) END"
    out = f"mt AS (SELECT *, {TOKS} AS tok FROM {source}), m1 AS (SELECT *, 1 AS pick FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rank) AS o FROM mt) WHERE o = 1)"
    for i in range(2, n + 1):
        chosen = " UNION ALL ".join(f"SELECT {key}, doc_id, tok FROM m{j}" for j in range(1, i))
        out += f""", c{i} AS ({chosen}), m{i} AS (SELECT * EXCLUDE (w), {i} AS pick FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY w DESC, rank) AS o FROM (
          SELECT a.*, round(a.final_score - {penalty} * (SELECT max({over}) FROM c{i} b WHERE b.{key} = a.{key}), 7) AS w FROM mt a
          WHERE NOT EXISTS (SELECT 1 FROM c{i} b WHERE b.{key} = a.{key} AND b.doc_id = a.doc_id))) WHERE o = 1)"""
    return out


def picks(n: int = 3, columns: str = "qid, doc_id, pick") -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM m{j}" for j in range(1, n + 1))


CLASS = f"""proto AS (SELECT t.entity_type, t.subs[(e.vec_id % len(t.subs)) + 1] AS entity_subtype, e.embedding FROM embeddings e JOIN (
   SELECT * FROM (VALUES {", ".join(f"({i}, {q(k)}, {listed(v)})" for i, (k, v) in enumerate(TAXONOMY.items()))}) v(label, entity_type, subs)) t USING (label)),
cparts AS (SELECT entity_type, entity_subtype, pos, avg(x::DOUBLE) AS value FROM (SELECT entity_type, entity_subtype, unnest(embedding) AS x, unnest(range(64)) AS pos FROM proto) GROUP BY ALL),
class AS MATERIALIZED (SELECT entity_type, entity_subtype, list(value ORDER BY pos) AS centroid FROM cparts GROUP BY ALL)"""


def any_of(text: str, phrases) -> str:  # noqa: ANN001
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


LIMIT = case(
    [
        *((f"entity_type = 'MILESTONE' AND entity_subtype = {q(s)} AND {any_of('lower(text)', ws)}", 0.30) for s, ws in MILESTONE_KEYWORDS.items()),
        ("entity_type = 'MILESTONE'", 0.40), ("entity_type = 'SHARED_THING'", 0.45),
    ], "0.3",
)
ENT = f"""{CLASS}, ent AS MATERIALIZED (SELECT doc_id, entity_type, entity_subtype, confidence FROM (
  SELECT v.doc_id, v.text, c.entity_type, c.entity_subtype, round(list_cosine_similarity(v.embedding::DOUBLE[], c.centroid), 3) AS confidence FROM vec v, class c WHERE length(v.text) >= 5)
  WHERE confidence >= ({LIMIT}) AND NOT (entity_type = 'MILESTONE' AND {any_of('lower(text)', CORRECTION_PHRASES)}))"""


def best(names: tuple[str, ...], default: str) -> str:
    own = case([(f"label % {len(names)} = {i}", q(x)) for i, x in enumerate(names)])
    return f"""{PRE}, lp AS (SELECT ordinal, name, pos, avg(x::DOUBLE) AS value FROM (SELECT label % {len(names)} AS ordinal, {own} AS name, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY ALL),
    lc AS (SELECT ordinal, name, list(value ORDER BY pos) AS centroid FROM lp GROUP BY ALL)
    SELECT doc_id, CASE WHEN score > 0.3 THEN name ELSE {q(default)} END AS label, score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS o FROM (SELECT v.doc_id, c.ordinal, c.name, round(list_cosine_similarity(v.embedding::DOUBLE[], c.centroid), 6) AS score FROM vec v, lc c)) WHERE o = 1"""


def top(where: str, n: int) -> str:
    return f"""{PRE}, {ENT} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, entity_type, entity_subtype) AS place FROM ent WHERE {where}) WHERE place <= {n}"""


def rules(table: dict, default: object) -> str:
    return case([(f"entity_type = {q(k)}", case([(f"entity_subtype = {q(s)}", q(v)) for s, v in own.items() if s != "_default"] or [("false", "NULL")], q(own["_default"]))) for k, own in table.items()], q(default))


BOOST = "least(3, " + " + ".join(f"CASE WHEN contains(lower(text), {q(w)}) THEN {v} ELSE 0 END" for w, v in IMPORTANCE_BOOSTERS.items()) + ")"
TAGS = "array_to_string(list_sort(list_distinct(list_filter([lower(entity_type), entity_subtype, " + ", ".join(f"CASE WHEN {any_of('lower(text)', ws)} THEN {q(t)} END" for t, ws in TAG_WORDS.items()) + "], lambda x: x IS NOT NULL))), ',')"
TOPIC = case([(f"entity_subtype = {q(s)}", q(t)) for s, t in SUPERSEDES.items()])
SHORT = "rtrim(substr(trim(text), 1, 80), '.,!? ')"


def synthesized(date: str = "NULL") -> str:
    label = case([(f"entity_subtype = {q(s)}", q(t)) for s, t in MILESTONE_LABELS.items()], "entity_subtype")
    head = "'[' || entity_type || ':' || entity_subtype || '] '"
    return case(
        [
            ("entity_type = 'MILESTONE'", f"{head} || {label} || ' — ' || {SHORT}"), (f"entity_type = 'DATE' AND {date} IS NOT NULL", f"{head} || {date} || ': ' || {SHORT}"),
            ("entity_type = 'SHARED_THING'", f"'[SHARED:' || entity_subtype || '] ' || {SHORT}"),
        ], f"{head} || {SHORT}",
    )


LATEST = f"""lw AS (SELECT * FROM mem WHERE (entity_type || ':' || entity_subtype) IS NULL OR (entity_type || ':' || entity_subtype) NOT IN {inside(f"{a}:{b}" for a, b in LATEST_WINS)}
  UNION ALL SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, persona_id, entity_type, entity_subtype ORDER BY ts DESC, doc_id DESC) AS o FROM mem
  WHERE (entity_type || ':' || entity_subtype) IN {inside(f"{a}:{b}" for a, b in LATEST_WINS)}) WHERE o = 1)"""
SES = f"ses AS (SELECT conv_id, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text AS content, {AS_OF} - to_hours(CAST((conv_id * 13) % 96 AS INT)) + to_minutes(CAST(turn AS INT)) AS ts, turn AS seq, 'u' || (conv_id % 10) AS user_id FROM conversations WHERE role <> 'system')"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
EVENTS = f"""ev AS (SELECT event_id, ts, user_id, floor(value) AS words, {K} % 4 AS entities, CASE WHEN event_type = 'error' THEN 'm' || ({K} % 5) END AS mood, CASE WHEN event_type = 'view' THEN 't' || ({K} % 7) END AS topic FROM events),
st AS (SELECT *, least(3, (words > 3)::INT + (words > 20)::INT + (entities >= 2)::INT + coalesce((date_diff('second', date_trunc('second', lag(ts) OVER u), date_trunc('second', ts)) / 3600.0 > 6)::INT, 0)) AS gained FROM ev WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
pr AS (SELECT *, CAST(sum(gained) OVER w AS BIGINT) AS xp, count(*) OVER w AS messages, last_value(mood IGNORE NULLS) OVER w AS lmood, last_value(topic IGNORE NULLS) OVER w AS ltopic FROM st WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
#: Messages with an entity, concerns and further XP, and the whole state after each.
MESSAGES = f"""ms AS (SELECT ev.*, gained, ({listed(TAXONOMY)})[event_id % {len(TAXONOMY)} + 1] AS t, ({listed(v[0] for v in TAXONOMY.values())})[event_id % {len(TAXONOMY)} + 1] AS sub,
  CASE WHEN event_id % 3 = 0 THEN 'c' || ((event_id // 3) % 9) END AS added, CASE WHEN event_id % 7 = 0 THEN 'c' || ((event_id // 7) % 9) END AS removed, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS bonus FROM ev JOIN (SELECT event_id, gained FROM st) USING (event_id)),
sx AS (SELECT user_id, event_id, ts, gained, CAST(sum(gained + bonus) OVER w AS BIGINT) AS xp, count(*) OVER w AS messages, last_value(mood IGNORE NULLS) OVER w AS mood, last_value(CASE WHEN mood IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS mood_since,
  last_value(CASE WHEN t = 'EMOTION' THEN sub END IGNORE NULLS) OVER w AS vibe, last_value(coalesce(topic, CASE WHEN t IN ('FACT', 'GOAL', 'DATE', 'MILESTONE') THEN t || ':' || sub END) IGNORE NULLS) OVER w AS topic
  FROM ms WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
#: The fold of concerns over each user's changes, one change a step of the list.
CONCERNS = """cl AS (SELECT user_id, list({'a': added, 'r': removed} ORDER BY ts, event_id) AS l FROM ms WHERE added IS NOT NULL OR removed IS NOT NULL GROUP BY user_id),
cf AS (SELECT user_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(l, lambda x: ['+' || coalesce(x.a, ''), '-' || coalesce(x.r, '')])), lambda k, x: list_filter(
  (CASE WHEN x[1] = '+' OR list_contains(k, x[1][2:]) THEN k ELSE list_append(k, x[1][2:]) END)[-5:], lambda c: c <> x[2][2:])) AS concerns FROM cl)"""
LEVEL = case([(f"xp >= {least}", n) for n, least in reversed(LEVELS)], "1")
EXPECT = "ex AS (SELECT a.vec_id AS qid, d.doc_id FROM embeddings a JOIN embeddings b USING (label) JOIN documents d ON d.doc_id % (SELECT count(*) FROM embeddings) = b.vec_id WHERE a.vec_id % 20 = 0)"


def hits(kind: str) -> str:
    return "(" + " + ".join(f"regexp_matches(lower(text), {q(p)})::INT" for p in CONTENT_TYPES[kind][2]) + ")"


KIND = case([(f"{hits(k)} > 0", q(k)) for k in CONTENT_TYPES], "'GENERAL'")
DENSITY = case([(f"{hits(k)} > 0", f"least(1.0, {v[1]} + {hits(k)} * 0.1)") for k, v in CONTENT_TYPES.items()], "0.3")
EST = "CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 4 + 1 END"
PRIORITY = case([(f"({KIND}) = {q(k)}", v[0]) for k, v in CONTENT_TYPES.items()], "3")
PLAIN = "regexp_replace(regexp_replace(text, '\\([^)]*\\)', '', 'g'), ',\\s*[^,]*,', ',', 'g')"
CALM = "text"
for _w in FILLER_WORDS:
    CALM = f"regexp_replace({CALM}, {q(chr(92) + 'b' + _w + chr(92) + 'b' + chr(92) + 's*')}, '', 'gi')"
CALM = f"trim(regexp_replace({CALM}, '\\s+', ' ', 'g'))"


def dots(x: str) -> str:
    return f"trim(substr({x}, 1, greatest(target - 3, 0))) || '...'"


PARTS = "string_split_regex(text, '[.!?]\\s+')"
CORE = f"""list_reduce(list_prepend({{'t': {PARTS}[1] || '.', 'go': true}}, list_transform({PARTS}[2:], lambda s: {{'t': s, 'go': true}})),
  lambda a, s: CASE WHEN a.go AND length(a.t) + length(s.t) + 2 <= target THEN {{'t': a.t || ' ' || s.t || '.', 'go': true}} ELSE {{'t': a.t, 'go': false}} END).t"""
TRIM = case(
    [
        ("length(text) <= target", "text"), (f"({KIND}) = 'CODE'", f"'[CODE TRUNCATED - ' || ({EST}) || ' tokens]'"), (f"({KIND}) = 'INSTRUCTION'", CORE),
        (f"({KIND}) = 'FACT'", f"CASE WHEN length({PLAIN}) <= target THEN trim({PLAIN}) ELSE {dots(PLAIN)} END"),
        (f"({KIND}) = 'EMOTIONAL'", f"CASE WHEN length({CALM}) <= target THEN {CALM} ELSE {dots(CALM)} END"),
    ], dots("text"),
)
FIT = f"""{POOL}, f1 AS (SELECT *, round(({PRIORITY}) * 0.4 + importance * 0.3 + final_score * 10 * 0.3, 6) AS priority FROM ranked WHERE rank <= 6),
f2 AS (SELECT *, row_number() OVER w AS place, sum(length(text)) OVER w AS used FROM f1 WINDOW w AS (PARTITION BY qid ORDER BY priority DESC, rank ROWS UNBOUNDED PRECEDING)),
f3 AS (SELECT *, min(CASE WHEN used > 9000 THEN place END) OVER (PARTITION BY qid) AS over_at, CAST(9000 - (used - length(text)) AS INT) AS target FROM f2),
f4 AS (SELECT *, {TRIM} AS short FROM f3),
fit AS (SELECT qid, doc_id, place, CASE WHEN over_at IS NULL OR place < over_at THEN text ELSE short END AS text, NOT (over_at IS NULL OR place < over_at) AS trimmed FROM f4
  WHERE over_at IS NULL OR place < over_at OR (place = over_at AND target >= 50 AND length(short) >= 30))"""
DOC = "(SELECT doc_id AS id, text FROM documents)"


def _dates() -> str:
    t, day = "lower(text)", "DATE '2024-01-31'"
    unit_of = "regexp_extract(lower(text), 'za (\\d+)\\s*(dni|dnia|dniu|tygodnie|tygodni|tyg|miesięcy|miesiąca|miesiące)', {})"
    count, unit = (unit_of.replace("{}", str(i)) for i in (1, 2))
    n = f"try_cast({count} AS INT)"

    def rolled(d: str, m: str) -> str:
        this, following = (f"try_cast(printf('%04d-%02d-%02d', {y}, try_cast({m} AS INT), try_cast({d} AS INT)) AS DATE)" for y in (2024, 2025))
        return f"CASE WHEN {this} < {day} THEN {following} ELSE {this} END"

    numbers = [f"regexp_extract({t}, '([0-9]{{1,2}})[./]([0-9]{{1,2}})', {i})" for i in (1, 2)]
    named = [f"regexp_extract({t}, '([0-9]{{1,2}})\\s+([a-ząćęłńóśźż]+)', {i})" for i in (1, 2)]
    month = case([(f"{named[1]} = {q(w)}", m) for w, m in MONTHS.items()])
    ends, mids = any_of(t, ("koniec", "końca", "końc")), any_of(t, ("połow", "środek"))
    parts = [
        f"CASE WHEN {unit} <> '' THEN {day} + {n} * CASE WHEN contains({unit}, 'tyg') THEN 7 WHEN contains({unit}, 'mies') THEN 30 ELSE 1 END END",
        f"CASE WHEN contains({t}, 'za tydzień') THEN {day} + 7 END", f"CASE WHEN contains({t}, 'za miesiąc') THEN {day} + 30 END",
        f"CASE WHEN contains({t}, 'jutro') THEN {day} + 1 END", f"CASE WHEN contains({t}, 'pojutrze') THEN {day} + 2 END",
        f"CASE WHEN {any_of(t, ('dzisiaj', 'dziś', 'today'))} THEN {day} END",
        *(f"CASE WHEN contains({t}, {q(w)}) THEN {day} + {((d - 2) % 7) or 7} END" for w, d in WEEKDAYS.items()),
        rolled(numbers[0], numbers[1]), rolled(named[0], f"({month})"),
        *(f"CASE WHEN contains({t}, {q(w)}) THEN CASE WHEN {ends} THEN DATE '2024-{m:02d}-{MONTH_DAYS[m - 1]}' WHEN {mids} THEN DATE '2024-{m:02d}-15' END END" for w, m in MONTHS.items()),
    ]
    return f"SELECT id, strftime(coalesce({', '.join(parts)}), '%Y-%m-%d') AS date_value FROM {DOC}"


CHANNELS = f"""{PRE}, {near('p1', 30, 'v.user_id = quser')}, {ranked('r1', 'p1', CFG, ECHO)}, own AS (SELECT * FROM r1 WHERE {YOUNG}), facts AS (SELECT * FROM own WHERE NOT is_milestone), {mmr('facts')},
great AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS o FROM own WHERE is_milestone),
{near('p0', 5, "source = 'character_core'")}, {ranked('r0', 'p0', CFG, 'distance < 1.0')}, {near('p2', 10, "source = 'md_import'")}, {ranked('r2', 'p2', CFG, 'distance < 1.3')},
every AS ({picks(3, 'qid, doc_id, text, final_score, 1 AS channel, pick AS place')} UNION ALL SELECT qid, doc_id, text, final_score, 1, 3 + o FROM great WHERE o <= 2
  UNION ALL SELECT qid, doc_id, text, final_score, 0, rank FROM r0 WHERE rank <= 2 UNION ALL SELECT qid, doc_id, text, final_score, 2, rank FROM r2 WHERE rank <= 1),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, left(text, 80) ORDER BY channel, place) AS d FROM every) WHERE d = 1)
SELECT qid, doc_id, channel, final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, channel, place) AS rank FROM once) WHERE rank <= 6"""


LEGACY_CHANNELS = f"""{PRE}, {near('p1', 20, 'v.user_id = quser')}, {ranked('own', 'p1', LEGACY, "source NOT IN ('user_message_raw', 'md_import')")}, {mmr('own', '0.4')},
{near('p0', 5, "source = 'character_core'")}, {ranked('r0', 'p0', LEGACY, 'distance < 1.0')}, {near('p2', 10, "source = 'md_import'")}, {ranked('r2', 'p2', LEGACY, 'distance < 1.3')},
every AS ({picks(3, 'qid, doc_id, text, final_score, 1 AS channel, pick AS place')} UNION ALL SELECT qid, doc_id, text, final_score, 0, rank FROM r0 WHERE rank <= 1 UNION ALL SELECT qid, doc_id, text, final_score, 2, rank FROM r2 WHERE rank <= 1),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, left(text, 80) ORDER BY channel, place) AS d FROM every) WHERE d = 1)
SELECT qid, doc_id, channel, final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, channel, place) AS rank FROM once) WHERE rank <= 5"""


def graded(asked: str, found: str) -> str:
    return f"""SELECT qid, n, status, confidence, avg_distance, status = 'NO_DATA' AS refuse_strict, confidence < 0.1 AS refuse_soft FROM (SELECT qid, n,
      CASE WHEN n = 0 THEN 'NO_DATA' WHEN n = 1 THEN CASE WHEN lo > 0.80 THEN 'NO_DATA' ELSE 'LOW_CONFIDENCE' END WHEN lo < 0.55 THEN 'GROUNDED' WHEN lo < 0.80 THEN 'LOW_CONFIDENCE' ELSE 'NO_DATA' END AS status,
      CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1 - lo / 2)), 3) END::DOUBLE AS confidence, CASE WHEN n = 0 THEN 'Infinity'::DOUBLE ELSE round(mean, 3) END AS avg_distance
      FROM (SELECT a.qid, count(f.distance) AS n, min(f.distance)::DOUBLE AS lo, avg(f.distance)::DOUBLE AS mean FROM {asked} a LEFT JOIN {found} f USING (qid) GROUP BY a.qid))"""


HITS = f"""asked AS (SELECT qid, {TOKENS} AS kw FROM ask), tops AS (SELECT qid, lower(string_agg(text, ' ')) AS t, max(final_score) AS top_score FROM ranked WHERE rank <= 3 GROUP BY qid),
hit AS (SELECT *, rate >= 0.5 AND top_score >= 0.4 AS passed FROM (SELECT qid, round(CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda w: contains(coalesce(t, ''), w)))::DOUBLE / len(kw) ELSE 1.0 END, 6) AS rate, coalesce(top_score, 0.0)::DOUBLE AS top_score FROM asked LEFT JOIN tops USING (qid)))"""
#: The label of an age in seconds, {s}.
AGE = """CASE WHEN {s} IS NULL THEN '' WHEN {s} // 86400 > 30 THEN '[' || ({s} // 86400) // 30 || ' mies. temu] ' WHEN {s} // 86400 > 0 THEN '[' || {s} // 86400 || ' dni temu] ' WHEN {s} % 86400 > 3600 THEN '[' || ({s} % 86400) // 3600 || ' godz. temu] '
 WHEN {s} % 86400 > 300 THEN '[' || ({s} % 86400) // 60 || ' min temu] ' ELSE '[przed chwilą] ' END"""
GRID = values([(i, *x) for i, x in enumerate(X.GRID)], "number, name, ws, wi, wr")
LABELS = "xc AS (SELECT qid, ex.doc_id FROM ex JOIN mem USING (doc_id) WHERE source = 'chat')"
#: Means and shares over queries q with found, hits, kept and bad.
MEASURES = """avg(CASE WHEN (SELECT count(*) FROM ex WHERE qid = q) = 0 THEN CASE WHEN coalesce(found, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(hits, 0)::DOUBLE / least(3, (SELECT count(*) FROM ex WHERE qid = q)) END) AS p,
  sum(coalesce(kept, 0))::DOUBLE / count(*) AS mi, CASE WHEN (SELECT count(*) FROM xc) = 0 THEN 0.0 ELSE sum(coalesce(bad, 0))::DOUBLE / (SELECT count(*) FROM xc) END AS v"""
SAID = f"len(list_filter(string_split(trim(regexp_replace({synthesized()}, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))"
TURNS = f"""WITH {SES}, turns AS MATERIALIZED (SELECT s.*, e.embedding FROM (SELECT conv_id * 1000 + seq AS doc_id, content AS text, ts FROM ses WHERE role = 'user') s JOIN embeddings e ON s.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id),
vec AS MATERIALIZED (SELECT * FROM turns WHERE length(text) >= 10 AND len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) >= 4), {ENT},
kept AS (SELECT v.text, v.ts, e.* EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type = 'MILESTONE' ORDER BY confidence DESC, entity_subtype) AS o FROM ent WHERE entity_type <> 'SHARED_THING' OR confidence >= 0.55) e
  JOIN vec v USING (doc_id) WHERE entity_type <> 'MILESTONE' OR o <= 2)"""
COUNTS = f"""cnt AS (SELECT count(*) AS total, count(*) FILTER (length(text) < 50) AS short, count(*) FILTER (len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) < 5) AS noise,
 count(*) FILTER (importance <= 3 AND ts < {AS_OF} - INTERVAL 14 DAY) AS stale, count(*) FILTER (is_milestone) AS milestones, count(*) FILTER (source = 'chat') AS sessions, count(*) FILTER (source = 'enriched') AS enriched,
 CAST((SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM mem GROUP BY md5(text))) AS BIGINT) AS extra FROM mem)"""

DECIDED = f"""{PRE}, {near('k', 25, 'v.user_id = quser AND v.doc_id % 20 <> 0')}, {ranked('kr', 'k', CFG)}, five AS (SELECT qid, doc_id AS other, rank, round(1 - distance / 2, 6) AS s, ({TOPIC}) AS their FROM kr WHERE rank <= 5),
      n AS (SELECT doc_id, ({TOPIC}) AS own FROM mem WHERE doc_id IN (SELECT qid FROM ask)),
      g AS (SELECT n.doc_id, own, min_by(other, rank) FILTER (s >= 0.85) AS first, coalesce(string_agg(other, ',' ORDER BY other) FILTER (s >= 0.70 AND their = own), '') AS archived FROM n LEFT JOIN five ON five.qid = n.doc_id GROUP BY n.doc_id, own),
      dec AS MATERIALIZED (SELECT doc_id, CASE WHEN own IS NOT NULL THEN 'supersede' WHEN first IS NOT NULL THEN 'merge' ELSE 'create' END AS action, CASE WHEN own IS NULL THEN first END AS target_id, archived FROM g)"""

ORACLES = {
    "knn_topk": f"{PRE}, {near('k', 6)} SELECT qid, doc_id, distance, knn_rank FROM k",
    "knn_index": f"{PRE}, {near('k', 6)} SELECT qid, doc_id, distance, knn_rank FROM k",
    "index_recall": "SELECT count(*) AS n, true AS enough FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 20 = 0",
    "tenant_isolation": f"{PRE}, {near('k', 5, 'v.user_id = quser')} SELECT qid, doc_id, distance, knn_rank FROM k",
    "rerank_scores": f"{POOL} SELECT {SCORES} FROM ranked WHERE rank <= 6",
    "rerank_legacy": f"{PRE}, {near('pool', 20)}, {ranked('ranked', 'pool', LEGACY, ECHO)} SELECT {SCORES} FROM ranked WHERE rank <= 5",
    "keyword_boost": f"{PRE}, {near('pool', 30)} SELECT qid, doc_id, round(({SHARE}) * 0.15, 6) AS boost FROM pool",
    "recency_decay": f"WITH {MEM} SELECT doc_id, source, round({decay(CFG)}, 6) AS recency FROM mem",
    "temporal_cutoff": f"WITH {MEM} SELECT source, count(*) AS n FROM mem WHERE {YOUNG} GROUP BY source",
    "mmr_select": f"{POOL}, {mmr('ranked')} {picks()}",
    "three_channel_search": CHANNELS,
    "legacy_search": LEGACY_CHANNELS,
    "grounding_status": f"{PRE}, {near('k', 2, 'v.user_id = quser')} " + graded("(SELECT qid FROM ask)", "(SELECT qid, distance FROM k WHERE distance <= 1.2)"),
    "grounding_search": f"""{PRE}, {near('k', 6)}, g AS ({graded('ask', 'k')}) SELECT qid, n, status, confidence, avg_distance, CASE status WHEN 'NO_DATA' THEN '[STRICT] no evidence: do not answer from memory'
      WHEN 'LOW_CONFIDENCE' THEN '[LOW] check that the memories concern the question (confidence ' || CAST(round(confidence * 100) AS INT) || '%)' ELSE '[GROUNDED] quote only what the memories say (confidence ' || CAST(round(confidence * 100) AS INT) || '%)' END AS directive FROM g""",
    "centroids": f"WITH {CLASS} SELECT entity_type, entity_subtype, pos, round(value, 6) AS value FROM cparts",
    "centroid_classify": f"{PRE}, {ENT} SELECT * FROM ent",
    "intent_argmax": best(INTENTS, "unknown"),
    "tone_argmax": best(TONES, "neutral"),
    "top2_milestones": top("entity_type = 'MILESTONE'", 2),
    "top5_entities": top("true", 5),
    "synthesize_text": f"WITH {MEM} SELECT doc_id, {synthesized('strftime(ts, ' + q('%Y-%m-%d') + ')')} AS memory FROM mem WHERE entity_type IS NOT NULL",
    "date_normalize": _dates(),
    "enrich_rules": f"""WITH {MEM}, e AS (SELECT *, {rules(IMPORTANCE, 5)} AS base_importance, {BOOST} AS boost, {TAGS} AS tags FROM (SELECT doc_id, text, entity_type, entity_subtype FROM mem WHERE entity_type IS NOT NULL))
      SELECT doc_id, base_importance, boost, least(10, base_importance + boost) AS importance, {rules(IMPACT, 'informational')} AS impact, {rules(TEMPORAL, 'long_term')} AS temporal_type, {TOPIC} AS supersedes, tags,
      CASE WHEN list_contains(string_split(tags, ','), 'work') OR (entity_type = 'DATE' AND entity_subtype = 'deadline') THEN least(10, base_importance + boost) ELSE 0 END AS business_value FROM e""",
    "importance_boost": f"SELECT id, {BOOST} AS boost, {TAGS} AS tags FROM (SELECT *, 'FACT' AS entity_type, 'health' AS entity_subtype FROM {DOC})",
    "strip_tags": """SELECT id, md5(clean) AS clean, len(list_filter(string_split(trim(regexp_replace(clean, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS words
      FROM (SELECT doc_id AS id, trim(text) AS clean FROM documents)""",
    "content_id_upsert": f"""WITH {MEM}, p AS (SELECT doc_id, user_id, importance, trim(regexp_replace(text, '\\[MEMORY\\].*?\\[/MEMORY\\]', '', 'gs')) AS text FROM mem WHERE length(trim(text)) >= 10),
      w AS (SELECT *, substr(sha256('s0:' || user_id || ':' || text), 1, 32) AS mem_id FROM p WHERE length(text) >= 10)
      SELECT mem_id, doc_id, importance, substr(sha256('s0:' || user_id), 1, 16) AS user_hash FROM (SELECT *, row_number() OVER (PARTITION BY mem_id ORDER BY doc_id DESC) AS o FROM w) WHERE o = 1""",
    "delete_superseded": f"WITH {MEM} SELECT source, count(*) AS n FROM mem WHERE NOT coalesce(entity_type = 'DATE' AND entity_subtype = 'deadline', false) GROUP BY source",
    "latest_wins": f"WITH {MEM}, {LATEST} SELECT doc_id, user_id, source, entity_subtype FROM lw",
    "consolidate_action": f"{DECIDED} SELECT * FROM dec",
    "consolidate_apply": f"""{DECIDED}, m AS (SELECT target_id AS doc_id, max(importance) AS imp, count(*) AS n, max(ts) AS t FROM dec JOIN mem USING (doc_id) WHERE action = 'merge' GROUP BY target_id),
      a AS (SELECT old AS doc_id, min(new) AS newer FROM (SELECT CAST(unnest(string_split(archived, ',')) AS BIGINT) AS old, doc_id AS new FROM dec WHERE archived <> '') GROUP BY old)
      SELECT mem.doc_id, greatest(importance, coalesce(imp, 0)) AS importance, coalesce(n, 0) + 1 AS mentions, greatest(ts, coalesce(t, ts)) AS last_mentioned, newer IS NULL AS is_active, CAST(newer AS VARCHAR) AS by
      FROM mem LEFT JOIN m USING (doc_id) LEFT JOIN a USING (doc_id) WHERE mem.doc_id % 20 <> 0 OR mem.doc_id IN (SELECT doc_id FROM dec WHERE action <> 'merge')""",
    "merge_fold": f"WITH {MEM} SELECT md5(text) AS digest, min(doc_id) AS first_id, max(importance) AS importance, count(*) AS mentions, max(ts) AS last_mentioned, string_agg(left(text, 100), ' | ' ORDER BY ts, doc_id) AS notes FROM mem GROUP BY md5(text) HAVING count(*) > 1",
    "consolidation_stats": f"WITH {MEM}, {LATEST} SELECT (SELECT count(*) FROM mem) AS total, count(*) AS active, (SELECT count(*) FROM mem) - count(*) AS archived FROM lw",
    "phrase_cleanup": f"WITH {SES} SELECT conv_id, seq, role FROM ses WHERE NOT (contains(lower(content), 'the th') OR contains(lower(content), 'tion'))",
    "copy_sessions": f"WITH {SES}, i AS (SELECT *, substr(sha256('s0:' || conv_id || ':' || role || ':' || content), 1, 32) AS mem_id FROM ses) SELECT DISTINCT mem_id FROM i WHERE mem_id NOT IN (SELECT mem_id FROM i WHERE conv_id % 3 = 0)",
    "conversation_pipeline": f"""{TURNS} SELECT doc_id, entity_type, entity_subtype, confidence, least(10, {rules(IMPORTANCE, 5)} + {BOOST}) AS importance, {rules(IMPACT, 'informational')} AS impact, md5({synthesized()}) AS digest FROM kept WHERE {SAID} >= 5""",
    "reingest": f"""{TURNS}, rw AS (SELECT 'u' || ((doc_id // 1000) % 10) AS user_id, {synthesized()} AS memory, {case([(f"entity_type = {q(k)}", q(v)) for k, v in REINGEST_SOURCES.items()], "'enriched'")} AS source, entity_type IN ('MILESTONE', 'SHARED_THING') AS milestone,
      least(10, {rules(IMPORTANCE, 5)} + {BOOST}) AS importance, entity_type, entity_subtype, ts, doc_id FROM kept WHERE length(text) >= 30 AND {SAID} >= 5),
      ids AS (SELECT *, substr(sha256('s0:' || user_id || ':' || trim(memory)), 1, 32) AS mem_id FROM rw WHERE length(trim(memory)) >= 10)
      SELECT mem_id, source, milestone, CASE WHEN milestone THEN 10 ELSE importance END AS importance, entity_subtype, ts FROM ids QUALIFY row_number() OVER (PARTITION BY mem_id ORDER BY doc_id DESC, entity_type DESC) = 1""",
    "session_upsert": f"""WITH {SES}, c AS (SELECT conv_id, role, trim(content) AS content, length(content) AS n, seq FROM ses WHERE trim(content) <> ''),
      k AS (SELECT *, substr(sha256('s0:' || conv_id || ':' || role || ':' || content), 1, 32) AS mem_id FROM c) SELECT mem_id, conv_id, role, 3 AS importance, least(n, 500) AS thought_chars, least(n, 200) AS hint_chars FROM k QUALIFY row_number() OVER (PARTITION BY mem_id ORDER BY seq DESC) = 1""",
    "session_last_n": f"WITH {SES}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, seq DESC) AS o FROM ses) WHERE o <= 10) SELECT conv_id, role, seq, row_number() OVER (PARTITION BY conv_id ORDER BY ts, seq) AS place FROM k",
    "raw_window_48h": f"WITH {SES} SELECT user_id, conv_id, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC, conv_id DESC) AS place FROM ses WHERE role = 'user' AND ts >= {AS_OF} - INTERVAL 48 HOUR) WHERE place <= 6",
    "relative_age": f"SELECT event_id, {AGE.replace('{s}', 's')} AS label FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-02-01' - ts)) AS BIGINT) AS s FROM events)",
    "newest_five": f"WITH {MEM} SELECT doc_id, ts, left(text, 80) AS beginning FROM mem WHERE source <> 'chat' ORDER BY ts DESC, doc_id LIMIT 5",
    "source_distribution": f"WITH {MEM} SELECT source, count(*) AS n, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM mem), 2) AS pct FROM mem GROUP BY source",
    "importance_histogram": f"WITH {MEM} SELECT i AS importance, (SELECT count(*) FROM mem WHERE importance = i) AS n FROM range(1, 11) r(i)",
    "exact_duplicates": f"WITH {MEM} SELECT md5(text) AS digest, count(*) AS n, count(*) - 1 AS extra FROM mem GROUP BY md5(text) HAVING count(*) > 1",
    "audit_counts": f"WITH {MEM}, {COUNTS} SELECT * FROM cnt",
    "health_score": f"""WITH {MEM}, {COUNTS} SELECT greatest(0, 10 - (CASE WHEN short / total::DOUBLE > 0.2 THEN 2 WHEN short / total::DOUBLE > 0.1 THEN 1 ELSE 0 END) - (CASE WHEN extra / total::DOUBLE > 0.1 THEN 2 WHEN extra / total::DOUBLE > 0.05 THEN 1 ELSE 0 END)
      - (CASE WHEN enriched = 0 OR sessions / enriched::DOUBLE > 10 THEN 2 WHEN sessions / enriched::DOUBLE > 5 THEN 1 ELSE 0 END) - (CASE WHEN milestones = 0 AND total > 50 THEN 1 ELSE 0 END) - (CASE WHEN stale / total::DOUBLE > 0.3 THEN 1 ELSE 0 END)) AS score,
      round(CASE WHEN enriched = 0 THEN 'Infinity'::DOUBLE ELSE sessions / enriched::DOUBLE END, 3) AS ratio FROM cnt""",
    "precision_at_3": f"""{POOL}, {EXPECT}, h AS (SELECT r.qid, count(ex.doc_id) AS hits, count(*) AS found FROM ranked r LEFT JOIN ex ON ex.qid = r.qid AND ex.doc_id = r.doc_id WHERE rank <= 3 GROUP BY r.qid), w AS (SELECT qid, count(*) AS wanted FROM ex GROUP BY qid)
      SELECT qid, coalesce(hits, 0) AS hits, round(CASE WHEN coalesce(wanted, 0) = 0 THEN CASE WHEN coalesce(found, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(hits, 0)::DOUBLE / least(3, wanted) END, 6)::DOUBLE AS precision FROM h FULL JOIN w USING (qid)""",
    "weight_grid": f"""{POOL}, {EXPECT}, z AS (SELECT number, name, qid, doc_id, source, knn_rank, round(ws::DOUBLE * round(greatest(0.0, 1 - distance / 2), 6) + wi::DOUBLE * (importance / 10::DOUBLE) + wr::DOUBLE * round(rec, 6), 6) AS w FROM ranked, {GRID} g),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number, qid ORDER BY w DESC, knn_rank) AS o FROM z) WHERE o <= 3), {LABELS},
      f AS (SELECT number, name, {MEASURES} FROM {GRID} g CROSS JOIN (SELECT qid AS q FROM ask)
        LEFT JOIN (SELECT number AS tn, qid AS tq, count(*) AS found, count(*) FILTER ((qid, doc_id) IN (SELECT qid, doc_id FROM ex)) AS hits, count(*) FILTER (doc_id = qid) AS kept, count(*) FILTER ((qid, doc_id) IN (SELECT qid, doc_id FROM xc)) AS bad FROM t GROUP BY number, qid) ON tn = number AND tq = q GROUP BY number, name),
      r AS (SELECT *, round(greatest(0.0, 5 * p + 3 * mi + 2 * (1 - v)), 6) AS score FROM f)
      SELECT name, round(p, 6) AS precision, round(mi, 6) AS include_rate, round(v, 6) AS violation_rate, score, row_number() OVER (ORDER BY score DESC, number) = 1 AS best FROM r""",
    "retrieval_score": f"""{POOL}, {EXPECT}, {LABELS}, t AS (SELECT * FROM ranked WHERE rank <= 3),
      f AS (SELECT {MEASURES} FROM (SELECT qid AS q FROM ask)
        LEFT JOIN (SELECT qid AS tq, count(*) AS found, count(*) FILTER ((qid, doc_id) IN (SELECT qid, doc_id FROM ex)) AS hits, count(*) FILTER (doc_id = qid) AS kept, count(*) FILTER ((qid, doc_id) IN (SELECT qid, doc_id FROM xc)) AS bad FROM t GROUP BY qid) ON tq = q)
      SELECT round(p, 6) AS precision, round(mi, 6) AS include_rate, round(1 - v, 6) AS exclude_rate, round(5 * p + 3 * mi + 2 * (1 - v), 6) AS score FROM f""",
    "recommendations": "@",
    "text_to_id": f"""{POOL}, t AS (SELECT qid || ':' || rank AS result_id, text FROM ranked WHERE rank <= 3), g AS (SELECT doc_id, text FROM documents)
      SELECT result_id, min(g.doc_id) AS doc_id FROM t JOIN g ON (g.text <> '' AND contains(t.text, left(g.text, 50))) OR (t.text <> '' AND contains(g.text, left(t.text, 50))) GROUP BY result_id""",
    "state_update": f"WITH {EVENTS}, {MESSAGES} SELECT user_id, event_id, gained, xp, {LEVEL} AS level, messages, mood, mood_since, vibe, topic FROM sx",
    "final_state": f"""WITH {EVENTS}, {MESSAGES}, {CONCERNS}, z AS (SELECT * FROM sx QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
      SELECT user_id, xp, {LEVEL} AS level, messages, mood, mood_since, vibe, topic, ts AS last_ts, coalesce(array_to_string(concerns, ','), '') AS concerns FROM z LEFT JOIN cf USING (user_id)""",
    "concern_fifo": f"WITH {EVENTS}, {MESSAGES}, {CONCERNS} SELECT user_id, array_to_string(concerns, ',') AS concerns FROM cf",
    "state_round_trip": f"""WITH {EVENTS} SELECT user_id, xp, {LEVEL} AS level, messages, lmood AS mood, NULL::VARCHAR AS vibe, 0 AS n_concerns FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS o FROM pr) WHERE o = 1""",
    "morning_message": f"""WITH {MEM}, m AS (SELECT user_id, bool_or(source = 'night_insight') AS has, first(md5(text) ORDER BY ts DESC, doc_id) AS d, CAST(substr(user_id, 2) AS INT) % 2 = 0 AS s FROM mem GROUP BY user_id)
      SELECT user_id, CASE WHEN has AND NOT s THEN d END AS message, s OR has AS shown FROM m""",
    "mmr_sweep": f"""{POOL}, sweep AS (SELECT r.*, pen, pen || ':' || qid AS key FROM ranked r, (SELECT unnest({listed(X.PENALTIES)})::DOUBLE AS pen)), {mmr('sweep', 'a.pen', 3, 'key')}, ch AS ({picks(3, 'pen, qid, source')}),
      g AS (SELECT pen, qid, count(DISTINCT source) AS got FROM ch GROUP BY pen, qid), al AS (SELECT qid, count(DISTINCT source) AS n FROM ranked GROUP BY qid)
      SELECT pen AS penalty, round(avg(got::DOUBLE / least(3, n)), 6) AS diversity FROM g JOIN al USING (qid) GROUP BY pen""",
    "calibration": """WITH p AS (SELECT a.label = b.label AS s, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND (a.vec_id % 20 <> 0 OR a.vec_id < b.vec_id) WHERE b.vec_id % 20 = 0),
      c AS (SELECT round(avg(d) FILTER (s), 4) AS mean_similar, round(max(d) FILTER (s), 4) AS max_similar, round(avg(d) FILTER (NOT s), 4) AS mean_different, round(min(d) FILTER (NOT s), 4) AS min_different, count(*) FILTER (s AND d >= 0.25) AS over_old FROM p),
      g AS (SELECT *, round((max_similar + min_different) / 2, 3) AS suggested, round(min_different - max_similar, 4) AS gap FROM c)
      SELECT *, CASE WHEN gap > 0.15 THEN 'clear' WHEN gap < 0.05 THEN 'weak' ELSE 'fair' END AS band FROM g""",
    "overall_score": "@",
    "content_type": f"SELECT id, {KIND} AS kind, round({DENSITY}, 6)::DOUBLE AS density, {EST} AS tokens FROM {DOC}",
    "trim": f"SELECT id, target, md5({TRIM}) AS short FROM {DOC}, (SELECT unnest([40, 200, 1000]) AS target)",
    "budget_fit": f"{FIT} SELECT qid, doc_id, place, trimmed, length(text) AS chars, md5(text) AS digest FROM fit",
    "context_build": f"{FIT} SELECT qid, n, length(c) AS chars, CASE WHEN length(c) = 0 THEN 0 ELSE length(c) // 4 + 1 END AS tokens, md5(c) AS digest FROM (SELECT qid, string_agg(text, chr(10) ORDER BY place) AS c, count(*) AS n FROM fit GROUP BY qid)",
    "xp_running": f"WITH {EVENTS} SELECT user_id, event_id, gained, xp, {LEVEL} AS level, messages FROM pr",
    "stream_xp": f"WITH {EVENTS} SELECT user_id, event_id, xp, {LEVEL} AS level FROM pr",
    "stream_state": f"""WITH {EVENTS}, {MESSAGES}, o AS (SELECT user_id, event_id, ts, date_trunc('second', ts) AS s, CASE WHEN event_id % 5 = 0 THEN 'g' || (event_id % 13) END AS left_behind, {{'a': CASE WHEN added IS NOT NULL OR removed IS NOT NULL THEN coalesce(added, '') END, 'r': coalesce(removed, '')}} AS change FROM ms),
      h AS (SELECT user_id, event_id, lag(left_behind) OVER w AS greeting, list(change) OVER (w ROWS UNBOUNDED PRECEDING) AS changes, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 172799999 PRECEDING AND CURRENT ROW) AS recent FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      f AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(changes, lambda x: x.a IS NOT NULL), lambda x: [x.a, x.r])), lambda k, x: list_filter((CASE WHEN x[1] = '' OR list_contains(k, x[1]) THEN k ELSE list_append(k, x[1]) END)[-5:], lambda c: c <> x[2])) AS c FROM h)
      SELECT user_id, event_id, gained, xp, {LEVEL} AS level, messages, mood, vibe, topic, array_to_string(c, ',') AS concerns, CAST(recent AS INTEGER) AS recent, greeting FROM sx JOIN f USING (user_id, event_id)""",
    "mood_last_value": f"WITH {EVENTS} SELECT user_id, event_id, lmood AS mood, ltopic AS topic FROM pr",
    "levels": f"WITH {EVENTS}, m AS (SELECT user_id, max(xp) AS xp FROM pr GROUP BY user_id) SELECT user_id, xp, {LEVEL} AS level FROM m",
    "nightly_window": f"""WITH {MEM}, t AS (SELECT *, CASE WHEN doc_id % 13 <> 0 THEN ts END AS told FROM mem), w AS (SELECT user_id, doc_id, told, source, text, row_number() OVER (PARTITION BY user_id ORDER BY told DESC NULLS LAST, doc_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM t
      WHERE source NOT IN {inside((*EXCLUDED_SOURCES, 'night_insight', 'project_knowledge'))} AND (told IS NULL OR told >= {AS_OF} - INTERVAL 7 DAY))
      SELECT user_id, doc_id, place, md5('[' || coalesce(strftime(told, '%Y-%m-%d %H:%M'), '?') || '] (' || source || ') ' || left(text, 200)) AS line FROM w WHERE n >= 3 AND place <= 50""",
    "state_at_message": f"""WITH {EVENTS}, {SES}, u AS (SELECT conv_id % 10 AS user_id, ts, conv_id, seq FROM ses), z AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
      SELECT conv_id, seq, event_id, xp, lmood AS mood FROM u ASOF LEFT JOIN z ON u.user_id = z.user_id AND u.ts >= z.ts""",
    "audit_incremental": f"WITH {MEM}, {COUNTS} SELECT total, short, noise, stale, milestones, sessions, enriched, true AS close FROM cnt",
    "insight_parse": """SELECT doc_id // 3 AS id, left(text, 40) AS text, (doc_id % 10) / 10.0::DOUBLE AS confidence, 6 - doc_id % 3 AS importance FROM documents WHERE doc_id % 10 >= 6 AND length(left(text, 40)) >= 10""",
    "llm_json_parse": """SELECT id, md5(CASE WHEN id % 4 = 3 OR trim(text) = '' THEN '…' ELSE trim(text) END) AS response, CASE WHEN id % 4 < 2 THEN 'a thought' ELSE '' END AS thought, '' AS hint, CASE WHEN id % 4 < 2 THEN role END AS mood, NULL::VARCHAR AS topic, id % 4 = 0 AS safe_haven
      FROM (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations)""",
    "keyword_hit_rate": f"{POOL}, {HITS} SELECT * FROM hit",
    "sanity_score": f"{POOL}, {HITS} SELECT passed, total, round(10 * passed::DOUBLE / greatest(total, 1), 2) AS score FROM (SELECT count(*) FILTER (top_score >= 0.5 AND rate >= 0.4) AS passed, count(*) AS total FROM hit)",
    "ingestion_rule": f"""{PRE}, {ENT} SELECT doc_id, EXISTS (SELECT 1 FROM ent e WHERE e.doc_id = m.doc_id AND e.entity_type IN (m.entity_type, 'GOAL')) AND EXISTS (SELECT 1 FROM ent e WHERE e.doc_id = m.doc_id AND e.entity_subtype IN (m.entity_subtype, 'project', 'career'))
      AND coalesce((SELECT max(confidence) FROM ent e WHERE e.doc_id = m.doc_id) >= 0.35, false) AS passed FROM mem m WHERE entity_type IS NOT NULL""",
    "readiness": "@",
    "memory_block": f"""{POOL} SELECT qid, md5(string_agg('- [' || source || ', type:' || coalesce(entity_type, '') || ', importance:' || importance || '] ' || {AGE.replace('{s}', f"date_diff('second', ts, {AS_OF})")} || text || ' (relevance: ' || printf('%.2f', round(final_score, 2)) || ')', chr(10) ORDER BY rank)) AS digest
      FROM ranked WHERE rank <= 6 GROUP BY qid""",
    "state_block": f"""WITH {EVENTS}, {MESSAGES}, {CONCERNS}, z AS (SELECT * FROM sx QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), h AS (SELECT *, date_diff('second', date_trunc('second', ts), {AS_OF}) / 3600.0 AS h, coalesce(concerns, []) AS c FROM z LEFT JOIN cf USING (user_id))
      SELECT user_id, md5('[STAN]' || chr(10) || 'Level: ' || ({LEVEL}) || chr(10) || 'XP: ' || xp || chr(10) || 'Mood: ' || coalesce(mood, '(brak)') || chr(10) || 'Temat: ' || coalesce(topic, '(brak)') || chr(10) || 'Wiadomości: ' || messages || chr(10) ||
        CASE WHEN h > 48 THEN 'Ostatnia rozmowa: ' || CAST(floor(h / 24) AS BIGINT) || ' dni temu' WHEN h > 1 THEN 'Ostatnia rozmowa: ' || CAST(floor(h) AS BIGINT) || ' godzin temu' ELSE 'Ostatnia rozmowa: w tej sesji' END || chr(10) ||
        'Aktywne sprawy:' || chr(10) || CASE WHEN len(c) = 0 THEN '  (brak)' ELSE array_to_string(list_transform(c, lambda x: '  - ' || x), chr(10)) END || chr(10) || '[/STAN]') AS block FROM h""",
    "raw_block": f"""WITH {SES}, w AS (SELECT user_id, content, date_diff('second', ts, {AS_OF}) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC, conv_id DESC) AS place FROM ses WHERE role = 'user' AND ts >= {AS_OF} - INTERVAL 48 HOUR)
      SELECT user_id, md5(string_agg('• ' || CASE WHEN s < 3600 THEN '[przed chwilą] ' WHEN s < 86400 THEN '[' || (s // 3600) || 'h temu] ' ELSE '[' || (s // 86400) || 'd temu] ' END || left(content, 200), chr(10) ORDER BY place DESC)) AS block FROM w WHERE place <= 6 GROUP BY user_id""",
    "since_label": f"""WITH {SES} SELECT user_id, CASE WHEN h > 48 THEN 'Ostatnia rozmowa: ' || CAST(floor(h / 24) AS BIGINT) || ' dni temu' WHEN h > 1 THEN 'Ostatnia rozmowa: ' || CAST(floor(h) AS BIGINT) || ' godzin temu' ELSE 'Ostatnia rozmowa: w tej sesji' END AS label
      FROM (SELECT user_id, date_diff('second', max(ts), {AS_OF}) / 3600.0 AS h FROM ses GROUP BY user_id)""",
    "insight_window": f"WITH {MEM} SELECT user_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, doc_id) AS place FROM mem WHERE source = 'night_insight' AND ts >= {AS_OF} - INTERVAL 480 HOUR) WHERE place <= 3",
    "soft_archive": f"WITH {MEM}, {LATEST} SELECT doc_id, doc_id IN (SELECT doc_id FROM lw) AS is_active, CASE WHEN doc_id NOT IN (SELECT doc_id FROM lw) THEN 'newer' END AS reason FROM mem",
    "insert_if_absent": f"WITH {MEM} SELECT mem_id, min(user_id) AS user_id FROM mem GROUP BY mem_id",
    "ascii_fold": """SELECT doc_id AS id, md5(regexp_replace(translate(lower(text), 'ąáàâäãåćçčęéèêëíìîïńñóòôöõśšúùûüýÿźżž', 'aaaaaaaccceeeeeiiiinnooooossuuuuyyzzz'), '[^\\x00-\\x7F]', '', 'g')) AS folded FROM documents""",
}


def _measured() -> str:
    """The five measures (name, score), from the queries that give them."""
    share = "SELECT {} AS name, round(10.0 * count(*) FILTER (passed) / greatest(count(*), 1), 6)::DOUBLE AS score FROM ({})"
    return f"""{share.format("'ingestion'", ORACLES['ingestion_rule'])} UNION ALL SELECT 'retrieval', score FROM ({ORACLES['retrieval_score']}) UNION ALL SELECT 'reranker', max(score) FROM ({ORACLES['weight_grid']})
      UNION ALL SELECT 'mmr', round(10 * max(diversity), 6) FROM ({ORACLES['mmr_sweep']}) UNION ALL {share.format("'e2e'", ORACLES['keyword_hit_rate'])}"""


ORACLES["overall_score"] = f"""SELECT score, CASE WHEN score >= 8 THEN 'EXCELLENT' WHEN score >= 7 THEN 'GOOD' WHEN score >= 6 THEN 'ACCEPTABLE' WHEN score >= 4 THEN 'NEEDS WORK' ELSE 'CRITICAL' END AS grade
  FROM (SELECT round(sum(score * CASE name WHEN 'ingestion' THEN 0.20 WHEN 'retrieval' THEN 0.30 WHEN 'reranker' THEN 0.15 WHEN 'mmr' THEN 0.10 ELSE 0.25 END), 2)::DOUBLE AS score FROM ({_measured()}))"""
ORACLES["recommendations"] = f"""WITH sc AS MATERIALIZED ({_measured()}), wg AS ({ORACLES['weight_grid']}), ms AS ({ORACLES['mmr_sweep']}), au AS ({ORACLES['audit_counts']}),
f(subject, measure, value, advice) AS (
  SELECT name, name, score, CASE name WHEN 'ingestion' THEN 'look at labels and thresholds of the extraction' WHEN 'retrieval' THEN 'try a greater keyword boost or pool, or a reranker' ELSE 'look for the gap in extraction or ranking' END FROM sc WHERE name IN ('ingestion', 'retrieval', 'e2e') AND score < 7
  UNION ALL SELECT 'reranker', 'weights_gain', max(score) - max(score) FILTER (name = '1'), 'take the best weight set' FROM wg HAVING max(score) > max(score) FILTER (name = '1')
  UNION ALL SELECT 'mmr', 'penalty_gain', max(diversity) - max(diversity) FILTER (penalty = 0.8), 'take the best diversity penalty' FROM ms HAVING max(diversity) > max(diversity) FILTER (penalty = 0.8)
  UNION ALL SELECT 'audit', 'duplicates', extra, 'remove exact duplicates' FROM au WHERE extra > 10
  UNION ALL SELECT 'audit', 'short_share', short::DOUBLE / total, 'drop very short memories' FROM au WHERE short::DOUBLE / total > 0.1
  UNION ALL SELECT 'audit', 'stale_share', stale::DOUBLE / total, 'archive old unimportant memories' FROM au WHERE stale::DOUBLE / total > 0.3
  UNION ALL SELECT 'audit', 'session_ratio', sessions::DOUBLE / enriched, 'enrich more of the sessions' FROM au WHERE sessions > 5 * enriched)
SELECT subject, measure, round(value, 6)::DOUBLE AS value, advice FROM f UNION ALL SELECT 'all', 'none', NULL, 'none' WHERE NOT EXISTS (SELECT 1 FROM f)"""
ORACLES["readiness"] = f"""SELECT score, CASE WHEN score >= 0.85 THEN 'ready' WHEN score >= 0.65 THEN 'nearly' ELSE 'not ready' END AS band FROM (SELECT round((
  (SELECT avg(passed::INT) FROM ({ORACLES['ingestion_rule']})) + (SELECT avg(precision) FROM ({ORACLES['precision_at_3']})) + (SELECT avg((status <> 'NO_DATA')::INT) FROM ({ORACLES['grounding_search']}))) / 3, 4)::DOUBLE AS score)"""
