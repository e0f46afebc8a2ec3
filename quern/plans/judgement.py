"""Queries of the judgement operators over documents, turns and rule texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.regex import sql_text
from quern.operators import judgement as J
from quern.operators.rules import Match, any_of
from quern.operators.screen import screened
from quern.plans.rules import TEXTS, texts
from quern.plans.tables import settled, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _round(x: str, digits: int = 2) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5 + 1e-9) / 1e{digits}"


_ALONE = " + ".join(f"len(list_filter({J.sql_windows('text', J._flag(p) + p, J.ERROR_SPAN, J.ERROR_SPAN)}, lambda w: NOT regexp_matches(w, {sql_text(J.ERROR_CONTEXT)})))" for p in J.BARE_ERROR)


@query(f"""WITH {TEXTS}, c AS (SELECT id, text, {J.sql_places('text', J.OVERLOAD)} AS overload, ({_ALONE}) AS bare_error, {J.sql_places('text', J.UNVERIFIED)} AS unverified,
  ({J.sql_places('text', J.SMALL_FIXES)} >= {J.LEAST_FIXES})::INT AS repeated_fixes, {J.sql_places('text', J.SCAPEGOAT)} AS scapegoat FROM texts),
n AS (SELECT *, overload + bare_error + unverified + repeated_fixes + scapegoat AS n FROM c)
SELECT id, overload::INT AS overload, bare_error::INT AS bare_error, unverified::INT AS unverified, repeated_fixes, scapegoat::INT AS scapegoat,
  round(greatest(0e0, 1e0 - (overload * 0.5e0 + bare_error * 0.6e0 + unverified * 0.55e0 + repeated_fixes * 0.5e0 + scapegoat * 0.45e0) / n), 6) AS score FROM n WHERE n > 0""")
def assistant_misuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Habits in talking to an assistant; errors count where no context is near them."""
    counts = J.misuse(F.col("text"))
    found = settled(texts(spark, sf_dir).select("id", F.length("text").alias("size"), *[c.alias(k) for k, c in counts.items()]))
    named = {k: F.col(k) for k in counts}
    score = F.round(J.misuse_score(F.lit("x"), named), 6)
    return found.where(" + ".join(counts) + " > 0").select("id", *[F.col(k).cast("int").alias(k) for k in counts], score.alias("score"))


@query(f"WITH {TEXTS}, s AS (SELECT id, {J.UNRESOLVED_CONFLICT.sql('text')} AS score FROM texts) SELECT id, score, 0.78e0 AS confidence FROM s WHERE score > 0")
def unresolved_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conflict that is noticed and smoothed over."""
    found = settled(texts(spark, sf_dir).select("id", J.UNRESOLVED_CONFLICT.score(F.col("text")).alias("score")))
    return found.where("score > 0").withColumn("confidence", F.lit(0.78))


_ACTIONS = ("关闭所有监控", "delete nothing", "清空用户数据")
_ACT = f"[{', '.join(map(sql_text, _ACTIONS))}][(abs(id) % 5)::INT + 1]"
_RISK = f"""r AS (SELECT id, regexp_matches(lower(text), {sql_text(J.DANGER_WORDS)})::INT AS words, (regexp_matches(lower(text), {sql_text(J.DANGER_STATE)}) OR regexp_matches(lower(coalesce({_ACT}, '')), {sql_text(J.DANGER_STATE)}))::INT AS state,
  regexp_matches(lower(text), {sql_text(J.HARMLESS_NAME)})::INT AS harmless, coalesce(length(text), 0) = 0 AS none FROM texts),
k AS (SELECT id, CASE WHEN none THEN 0e0 ELSE least(1e0, 0.3e0 * words + state + 0.8e0 * state * harmless) END AS risk, NOT none AND words = 0 AND state = 1 AS separable FROM r)"""


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, of which three in five plan one of three actions."""
    return texts(spark, sf_dir).withColumn("action", F.get(F.array(*[F.lit(a) for a in _ACTIONS]), (F.abs("id") % 5).cast("int")))


@query(f"WITH {TEXTS}, {_RISK} SELECT id, risk AS score, separable, risk >= 0.5 AS alert FROM k WHERE risk > 0")
def state_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of a text together with the planned action."""
    found = settled(_acted(spark, sf_dir).select("id", J.state_risk(F.col("text"), F.col("action")).alias("x")))
    return found.where("x.score > 0").select("id", "x.score", "x.separable", "x.alert")


@query(f"WITH {TEXTS}, {_RISK}, f AS (SELECT abs(id) % 1000 AS part, id, risk, row_number() OVER (PARTITION BY abs(id) % 1000 ORDER BY risk, id) AS place FROM k) SELECT part, id, risk FROM f WHERE place = 1")
def safest_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of candidate actions the one with the least risk."""
    return J.safest(_acted(spark, sf_dir).withColumn("part", F.abs("id") % 1000), "part")


def _tone_sql() -> str:
    urgency = " + ".join(f"{J.sql_hits('q', ps)} * {w}e0" for w, ps in J.URGENCY)
    emotion = "CASE " + " ".join(f"WHEN {J.sql_any('q', ps)} THEN '{n}'" for n, _, ps in J.EMOTIONS) + " ELSE 'neutral' END"
    share = "CASE emotion " + " ".join(f"WHEN '{n}' THEN {w}e0" for n, w, _ in J.EMOTIONS) + " ELSE 0e0 END"
    chars = "string_split(q, '')"
    run = f"len(list_filter(range(1, len({chars}) - 1), lambda i: regexp_matches(({chars})[i], '[一-鿿]') AND ({chars})[i] = ({chars})[i + 1] AND ({chars})[i] = ({chars})[i + 2] AND (i = 1 OR ({chars})[i - 1] <> ({chars})[i])))"
    return f"""WITH {TEXTS}, q AS (SELECT id, trim(lower(text)) AS q FROM texts),
    t AS (SELECT id, q, coalesce(length(q), 0) = 0 AS none, {urgency} AS u, {emotion} AS emotion, {J.sql_hits('q', J.FORMAL)} AS f, {J.sql_hits('q', J.CASUAL)} AS c, {J.sql_hits('q', J.TECHNICAL)} AS x,
      len(regexp_extract_all(q, '[！!]')) AS bangs, len(regexp_extract_all(q, '[？?]')) AS asks, CASE WHEN regexp_matches(q, '[一-鿿]') THEN {run} ELSE 0 END AS runs FROM q),
    s AS (SELECT *, 0.5e0 + {share} + CASE WHEN bangs > 2 THEN 0.2e0 WHEN bangs > 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN asks >= 3 THEN 0.1e0 ELSE 0e0 END + CASE WHEN {J.sql_any('q', J.STRONGER)} THEN 0.08e0 ELSE 0e0 END
      + least(runs * 0.08e0, 0.15e0) + CASE WHEN length(q) < 5 THEN 0.1e0 WHEN length(q) > 200 THEN -0.1e0 ELSE 0e0 END - CASE WHEN {J.sql_any('q', J.WEAKER)} THEN 0.05e0 ELSE 0e0 END AS i FROM t)
    SELECT id, CASE WHEN none THEN 'low' WHEN u >= 3 THEN 'high' WHEN u >= 1 THEN 'medium' ELSE 'low' END AS urgency, CASE WHEN none THEN 'neutral' ELSE emotion END AS emotion,
      CASE WHEN none THEN 'casual' WHEN x > 0 AND x >= c THEN 'technical' WHEN f > c THEN 'formal' ELSE 'casual' END AS formality, CASE WHEN none THEN 0e0 ELSE greatest(0e0, least(1e0, {_round('i')})) END AS intensity FROM s"""


@query(_tone_sql())
def tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgency, emotion, register and intensity."""
    return screened(texts(spark, sf_dir), F.col("text"), lambda: {"x": J.tone(F.col("text"))}).select("id", "x.*")


def _needs_sql() -> str:
    rows = []
    for at, (name, sure, pattern, ignore) in enumerate(J.NEEDS):
        hit = Match(pattern, ignore).sql("text")
        value = f"CASE WHEN {hit} THEN {sure}e0 END"
        if name == "need_emotional_support":
            value = f"CASE WHEN {hit} AND low THEN {min(0.95, sure + 0.1)}e0 WHEN {hit} THEN {sure}e0 WHEN low THEN 0.7e0 END"
        rows.append(f"SELECT id, {at} AS place, '{name}' AS need, {value} AS sure FROM m")
    low = f"NOT {J.sql_any('lower(text)', J.EMOTIONS[0][2])} AND NOT {J.sql_any('lower(text)', J.EMOTIONS[1][2])} AND ({J.sql_any('lower(text)', J.EMOTIONS[2][2])} OR {J.sql_any('lower(text)', J.EMOTIONS[3][2])})"
    return f"""WITH {TEXTS}, m AS (SELECT id, text, {low} AS low FROM texts), r AS ({' UNION ALL '.join(rows)})
    SELECT id, string_agg(need, ',' ORDER BY sure DESC, place) AS needs, count(*)::INT AS n, max(sure) >= 0.8e0 AS certain FROM r WHERE sure IS NOT NULL GROUP BY id"""


@query(_needs_sql())
def implicit_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unspoken needs, with the mood of the same text."""
    t = F.col("text")
    found = settled(screened(texts(spark, sf_dir), t, lambda: {"x": J.implicit_needs(t, J.tone(t)["emotion"])}).select("id", "x")).where(F.size("x") > 0)
    return found.select("id", F.array_join(F.transform("x", lambda x: x["need"]), ",").alias("needs"), F.size("x").alias("n"), F.exists("x", lambda x: x["confidence"] >= 0.8).alias("certain"))


def _empathy_sql() -> str:
    near = lambda w: f"substring(low, greatest(0, instr(low, {sql_text(w)}) - 6) + 1, instr(low, {sql_text(w)}) - 1 + {len(w) + 5} - greatest(0, instr(low, {sql_text(w)}) - 6))"
    has = lambda w: f"contains(low, {sql_text(w)})"
    others = " + ".join(f"({has(w)} AND regexp_matches({near(w)}, '{J.ABOUT_OTHERS}'))::INT" for w in J.CONCERN)
    own = " + ".join(f"({has(w)} AND NOT regexp_matches({near(w)}, '{J.ABOUT_OTHERS}') AND regexp_matches({near(w)}, '{J.ABOUT_SELF}'))::INT" for w in J.CONCERN)
    seen = " + ".join(f"len(regexp_extract_all(low, {sql_text(w)}))" for w in J.PERSPECTIVE)
    guessed = " OR ".join(f"({has(w)} AND len(list_filter({J.sql_windows('low', w, 8, len(w) + 8)}, lambda x: regexp_matches(x, '{J.SPECULATIVE}'))) > 0)" for w in J.PERSPECTIVE)
    some = lambda ws: J.sql_holds("low", ws) + " > 0"
    return f"""WITH {TEXTS}, l AS (SELECT id, lower(text) AS low FROM texts WHERE length(trim(text)) > 0),
    c AS (SELECT id, {J.sql_holds('low', J.JOY)} + {J.sql_holds('low', J.GRIEF)} AS felt, {J.sql_holds('low', J.CONCERN)} AS cared, ({others}) AS others, ({own}) AS own, ({seen}) AS seen, ({guessed}) AS guessed,
      {some(J.SELF_WORDS)} AS mine, {some(J.OTHER_WORDS)} AS yours, {some(J.BOUNDARY_WORDS)} AS edge FROM l),
    p AS (SELECT id, least(1e0, felt / 3e0) AS contagion, CASE WHEN cared = 0 THEN 0e0 ELSE least(1e0, least(0.8e0, cared * 0.3e0) + CASE WHEN others > own THEN 0.2e0 ELSE 0e0 END) END AS concern,
      CASE WHEN seen = 0 THEN 0e0 ELSE least(1e0, least(0.9e0, seen * 0.25e0) + CASE WHEN guessed THEN 0.1e0 ELSE 0e0 END) END AS perspective,
      CASE WHEN mine AND yours THEN 0.5e0 ELSE 0e0 END + CASE WHEN edge THEN 0.3e0 ELSE 0e0 END + CASE WHEN mine OR yours THEN 0.2e0 ELSE 0e0 END AS distinction FROM c),
    s AS (SELECT *, contagion * 0.25e0 + concern * 0.3e0 + perspective * 0.25e0 + distinction * 0.2e0 AS score FROM p)
    SELECT id, {_round('contagion')} AS contagion, {_round('concern')} AS concern, {_round('perspective')} AS perspective, {_round('distinction')} AS distinction, {_round('score')} AS score,
      CASE WHEN score >= 0.7e0 - 1e-9 THEN 'high' WHEN score >= 0.4e0 - 1e-9 THEN 'moderate' ELSE 'low' END AS level FROM s WHERE score > 0"""


@query(_empathy_sql())
def empathy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts of empathy, their score and level."""
    rows = settled(texts(spark, sf_dir).select("id", "text", F.lower("text").alias("low")))
    found = settled(rows.select("id", J.empathy(F.col("text"), F.col("low")).alias("x")))
    return found.where("x.level <> 'none'").select("id", "x.*")


_FLAGS = {n: f"regexp_matches(lower(text), {sql_text(p)})::INT" for n, p in J.INDICATORS}


@query(f"""WITH {TEXTS}, f AS (SELECT id, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())} FROM texts)
SELECT *, EC > 0 OR PT > 0 AS empathic, CASE WHEN PT = 1 THEN 'PT' WHEN FS = 1 THEN 'FS' WHEN EC = 1 THEN 'EC' WHEN PD = 1 THEN 'PD' ELSE 'PT' END AS dominant FROM f WHERE PT + FS + EC + PD > 0""")
def empathy_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of the four dimensions of a survey."""
    found = settled(texts(spark, sf_dir).select("id", J.empathy_indicators(F.col("text")).alias("x"))).select("id", "x.*")
    return found.where("PT + FS + EC + PD > 0")


@query(f"""SELECT orderkey, floor(({' + '.join(_round(x, 1) for x in ('(a + d) / 2e0', 'b / 1e0', 'c / 1e0', '(6 - e) / 1e0'))}) / 4e0 * 20 + 0.5)::INT AS total FROM (
  SELECT o_orderkey AS orderkey, o_orderkey % 5 + 1 AS a, o_custkey % 5 + 1 AS b, o_orderkey % 3 + 1 AS c, o_custkey % 4 + 1 AS d, o_orderkey % 2 + 4 AS e FROM orders)""")
def survey_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of surveys with one reversed answer."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    answers = {"PT": [(k % 5 + 1, False), (c % 4 + 1, False)], "FS": [(c % 5 + 1, False)], "EC": [(k % 3 + 1, False)], "PD": [(k % 2 + 4, True)]}
    return o.select(k.alias("orderkey"), J.survey_score(answers).alias("total"))


_OLD = {name: f"(1 + abs(id + {at}) % 10)::DOUBLE" for at, (name, _) in enumerate(J.TRAITS)}


@query(f"""WITH {TEXTS}, c AS (SELECT id, {', '.join(f"CASE WHEN {J.sql_holds('lower(text)', ws)} > 0 THEN {J.TRAIT_STEP}e0 ELSE 0e0 END AS step_{n}" for n, ws in J.TRAITS)} FROM texts)
SELECT id, {', '.join(f"round(greatest(1e0, least(10e0, {_OLD[n]} + step_{n})), 6) AS {n}" for n, _ in J.TRAITS)} FROM c WHERE {' + '.join(f'step_{n}' for n, _ in J.TRAITS)} > 0""")
def trait_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traits moved by the behaviour that a text describes."""
    changes = J.trait_changes(F.col("text"))
    found = settled(texts(spark, sf_dir).select("id", *[c.alias(f"step_{n}") for n, c in changes.items()])).where(" + ".join(f"step_{n}" for n in changes) + " > 0")
    old = lambda at: (1 + F.abs(F.col("id") + at) % 10).cast("double")
    return found.select("id", *[F.round(J.trait_score(old(at), F.col(f"step_{n}")), 6).alias(n) for at, n in enumerate(changes)])


_JOINED = "SELECT agent, string_agg(text, ' ' ORDER BY seq, id) AS t FROM s GROUP BY 1"


@query(f"""WITH {TEXTS}, s AS (SELECT id, text, abs(id) % 97 AS agent, abs(id) AS seq FROM texts WHERE text IS NOT NULL), g AS ({_JOINED})
SELECT agent, {J.sql_hits('t', J.BELIEFS)} AS beliefs, {J.sql_hits('t', J.DESIRES)} AS desires,
  CASE {' '.join(f"WHEN regexp_matches(t, {sql_text('(?i)' + p)}) THEN regexp_extract(t, {sql_text('(?i)' + p)})" for p in J.INTENTIONS)} ELSE 'unknown' END AS plan,
  CASE WHEN {' OR '.join(f"regexp_matches(t, {sql_text('(?i)' + p)})" for p in J.INTENTIONS)} THEN 0.6e0 ELSE 0.1e0 END AS plan_confidence,
  CASE {' '.join(f"WHEN regexp_matches(t, {sql_text('(?i)' + p)}) THEN '{m}'" for m, p in J.MOODS)} ELSE 'neutral' END AS mood FROM g""")
def agent_minds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What agents seem to believe, want, plan and feel."""
    said = texts(spark, sf_dir).where("text is not null").withColumn("agent", F.abs("id") % 97).withColumn("seq", F.abs("id"))
    return J.agent_minds(said, "agent", ["seq", "id"])


_HURT = f"({J.sql_holds('low', J.DEFENSIVE)}) * CASE WHEN s >= 7 THEN 1.5e0 ELSE 1e0 END"


@query(f"""WITH {TEXTS}, l AS (SELECT id, lower(text) AS low, ['direct', 'empathetic', 'plain'][(abs(id) % 3)::INT + 1] AS style, abs(id) % 10 AS s, abs(id) % 7 - 6 AS p FROM texts),
c AS (SELECT id, style, p, {_HURT} AS hurt, {J.sql_holds('low', J.CONFUSING)} AS lost, {J.sql_holds('low', J.PLEASING)} AS glad FROM l)
SELECT id, CASE WHEN p < -3 AND hurt > 0 THEN 'negative' WHEN style = 'direct' AND lost > 1 THEN 'confused' WHEN style = 'direct' AND hurt > 0 THEN 'defensive' WHEN style = 'empathetic' AND glad > 0 AND hurt = 0 THEN 'positive'
  WHEN glad > hurt THEN 'positive' WHEN hurt > glad THEN 'defensive' ELSE 'neutral' END AS predicted, round(least(0.9e0, 0.4e0 + (hurt + glad) * 0.1e0), 6) AS confidence FROM c WHERE hurt + lost + glad > 0""")
def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a reader is likely to take a draft."""
    n = F.abs("id")
    style = F.element_at(F.array(F.lit("direct"), F.lit("empathetic"), F.lit("plain")), (n % 3 + 1).cast("int"))
    low = F.lower("text")
    some = J.holds(low, J.DEFENSIVE) + J.holds(low, J.CONFUSING) + J.holds(low, J.PLEASING)
    found = settled(texts(spark, sf_dir).select("id", J.reaction(F.col("text"), style, n % 10, n % 7 - 6).alias("x"), some.alias("some")))
    return found.where("some > 0").select("id", "x.predicted", F.round("x.confidence", 6).alias("confidence"))


_ENTITIES = ((), ("Paris", "Rome"), ("x", "apple"), ("Berlin", "apple", "pear"), ("北京", "rome"))
_LISTS = "[" + ", ".join("[" + ", ".join(map(sql_text, e)) + "]::VARCHAR[]" for e in _ENTITIES) + "]"


@query(f"""WITH {TEXTS}, a AS (SELECT id, trim(coalesce(text, '')) AS src, ['general', 'task', ''][(abs(id) % 3)::INT + 1] AS intent, ['neutral', 'angry', ''][(abs(id) // 3 % 3)::INT + 1] AS mood, {_LISTS}[(abs(id) % 5)::INT + 1] AS e FROM texts),
b AS (SELECT *, regexp_matches(src, '{J.FEELING}') AS felt, regexp_matches(src, '{J.GOOD_WORDS}') AND regexp_matches(src, '{J.BAD_WORDS}') AS mixed,
  len(list_filter(e, lambda x: regexp_matches(x, '^[A-Z一-鿿]') AND length(x) >= 2)) / greatest(len(e), 1)::DOUBLE AS ratio, len(list_filter(e, lambda x: length(x) <= 1)) > 0 AS rare FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(src, '{J.CLEAR_QUESTION}') THEN 0.9e0 WHEN intent = 'task' THEN 0.85e0 WHEN regexp_matches(src, '{J.VAGUE_QUESTION}') THEN 0.7e0 WHEN regexp_matches(src, '{J.VAGUE_OBJECT}') THEN 0.4e0 WHEN src = '' THEN 0.3e0 ELSE 0.6e0 END AS i,
  CASE WHEN rare THEN 0.3e0 WHEN len(e) = 0 THEN 0.4e0 WHEN ratio >= 0.6 THEN 0.9e0 WHEN ratio >= 0.3 THEN 0.7e0 ELSE 0.5e0 END AS n,
  CASE WHEN felt THEN 0.85e0 WHEN mood = 'angry' THEN 0.8e0 WHEN length(src) BETWEEN 1 AND 9 THEN 0.6e0 WHEN mixed THEN 0.4e0 WHEN src = '' THEN 0.5e0 ELSE 0.65e0 END AS t FROM b)
SELECT id, i AS intent, n AS entity, t AS tone, {_round('i * 0.35e0 + n * 0.35e0 + t * 0.3e0')} AS overall,
  concat_ws(',', CASE WHEN i = 0.3e0 THEN 'missing_context' END, CASE WHEN rare THEN 'multiple_interpretations' END, CASE WHEN t = 0.4e0 THEN 'contradictory_signals' END, CASE WHEN i = 0.4e0 THEN 'ambiguous_intent' END) AS flags FROM c""")
def confidence_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure intent, entities and tone of an understood question are."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    n = F.abs("id")
    lists = F.array(*[F.array(*[F.lit(x) for x in e]).cast("array<string>") for e in _ENTITIES])
    x = J.annotation(F.col("text"), pick(("general", "task", ""), n % 3), F.element_at(lists, (n % 5 + 1).cast("int")), pick(("neutral", "angry", ""), F.floor(n / 3) % 3))
    found = settled(texts(spark, sf_dir).select("id", x.alias("x")))
    return found.select("id", "x.intent", "x.entity", "x.tone", "x.overall", F.array_join("x.flags", ",").alias("flags"))


def _rewrite_sql() -> str:
    out = "text"
    for rules in J.REWRITES.values():
        for pattern, to in rules:
            for n in range(1, 5):
                to = to.replace(f"${n}", f"\\{n}")
            out = f"regexp_replace({out}, {sql_text(pattern)}, {sql_text(to)}, 'g')"
    for pattern, to in J.TIDY:
        out = f"regexp_replace({out}, {sql_text(pattern)}, {sql_text(to)}, 'g')"
    return f"WITH {TEXTS} SELECT id, md5(trim({out})) AS digest FROM texts"


@query(_rewrite_sql())
def guided_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rewritten by the rules of all findings, in order."""
    names = F.array(*[F.lit(n) for n in J.REWRITES])
    return texts(spark, sf_dir).select("id", F.md5(J.rewrite(F.col("text"), names)).alias("digest"))


@query("SELECT event_id, true AS same, false AS other FROM events")
def json_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values compared whatever the order of their keys."""
    e = table(spark, sf_dir, "events")
    left = F.format_string('{"a": {"x": %s, "y": [1, 2]}, "id": %d}', F.col("props"), F.col("event_id"))
    right = F.format_string('{"id":%d,"a":{"y":[1,2],"x":%s}}', F.col("event_id"), F.col("props"))
    other = F.format_string('{"id":%d,"a":{"y":[2,1],"x":%s}}', F.col("event_id"), F.col("props"))
    return e.select("event_id", J.same_json(left, right).alias("same"), J.same_json(left, other).alias("other"))
