"""Queries of operators on given structures, dictionaries and patterns: each makes its inputs from the driver tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import regex, scalars
from quern.functions.regex import sql_text
from quern.operators import dialogue as D
from quern.operators import text_rules as T
from quern.operators.rules import Match
from quern.plans.rules import TEXTS, texts
from quern.plans.tables import settled, spread, table
from quern.sources import wal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber % 4 < 2 AS few, l_quantity < 5 AS no_choice, l_partkey % 3 = 0 AS short, l_suppkey % 2 = 0 AS same, l_returnflag = 'N' AS bare FROM lineitem),
s AS (SELECT *, few::INT + no_choice::INT + short::INT + same::INT + bare::INT AS issues, few::INT * 0.85e0 + no_choice::INT * 0.8e0 + short::INT * 0.7e0 + same::INT * 0.6e0 + bare::INT * 0.55e0 AS total FROM d)
SELECT k, n, round(CASE WHEN issues = 0 THEN 1e0 ELSE greatest(0e0, 1 - total / issues) END, 6) AS score FROM s""")
def decision_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete a recorded decision is, with line items as decisions."""
    rows = table(spark, sf_dir, "lineitem")
    some = lambda c, yes, no: F.when(c, yes).otherwise(no)
    options = some(F.col("l_linenumber") % 4 < 2, F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))
    chosen = some(F.col("l_quantity") < 5, F.lit(""), F.lit("a"))
    reasoning = some(F.col("l_partkey") % 3 == 0, F.lit("too short"), F.lit("because it is cheaper"))
    score = T.decision_trace_score(options, chosen, reasoning, F.col("l_returnflag") != "N", F.col("l_suppkey") % 2 == 0)
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(score, 6).alias("score"))


@query("SELECT o_orderkey AS k, round(((o_totalprice > 100000)::INT + (o_orderstatus = 'F')::INT + (o_custkey % 2 = 0)::INT) / 3e0, 6) AS score FROM orders")
def plan_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a plan's required parts, with orders as plans."""
    checks = [F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(T.plan_gate_score(checks), 6).alias("score"))


_KEYWORDS = ("pirate", "trust us", "system", "a+b", "数据")
_MASKED = "text"
for _k in _KEYWORDS:
    _MASKED = f"regexp_replace({_MASKED}, {sql_text('(?i)' + _k.replace('+', chr(92) + '+'))}, '***', 'g')"


@query(f"WITH {TEXTS} SELECT id, md5({_MASKED}) AS digest FROM texts")
def keyword_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords masked in either case."""
    return texts(spark, sf_dir).select("id", F.md5(T.redact_keywords(F.col("text"), list(_KEYWORDS))).alias("digest"))


@query("SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(nfc_normalize(text), '“', '\"'), '”', '\"'), '‘', chr(39)), '’', chr(39)), '^\\s+|\\s+$', '', 'g'))) AS digest FROM documents")
def unicode_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts; DuckDB has the canonical form alone, which is the same for these documents."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(scalars.normalise_unicode(F.col("text"))).alias("digest"))


_GOALS = {"building": ["build", "code", "deploy", "系统"], "safety": ["risk", "harm", "danger", "安全"], "caring": ["care", "feel", "worry", "心"]}
_GOAL = "build and deploy the code"
_KNOWN = [w for ws in _GOALS.values() for w in ws]
_HELD = f"list_filter([{', '.join(map(sql_text, _KNOWN))}], lambda w: contains(lower(text), w))"
_OWN = r"""list_distinct(list_filter(regexp_split_to_array(regexp_replace(text, '[，。！？、；："''（）()【】\[\]《》<>]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2))"""
_COUNTS = {n: " + ".join(f"contains(lower(text), {sql_text(w)})::INT" for w in ws) for n, ws in _GOALS.items()}


@query(f"""WITH {TEXTS}, k AS (SELECT id, CASE WHEN coalesce(length(text), 0) = 0 THEN [] WHEN len({_HELD}) > 0 THEN {_HELD} ELSE {_OWN} END AS words, {', '.join(f'{e} AS {n}' for n, e in _COUNTS.items())} FROM texts),
s AS (SELECT id, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: w IN ('build', 'code', 'deploy'))) / len(words)::DOUBLE ELSE 0e0 END AS share, building > 0 AND building >= safety AND building >= caring AS same FROM k)
SELECT id, share < 0.5 AND NOT same AS deviates, share > 0.3 OR same AS related, floor(share * 100 + 0.5)::INT AS confidence FROM s""")
def goal_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a text is from a goal."""
    x = T.goal_distance(F.lit(_GOAL), F.coalesce("text", F.lit("")), _GOALS)
    return settled(texts(spark, sf_dir).select("id", x.alias("x"))).select("id", "x.*")


_ANCHOR = ("system", "data", "risk", "plan", "text")
_TOPIC = r"\b(by the way|anyway|another topic|change of subject)\b"


@query(f"""WITH {TEXTS}, s AS (SELECT id, regexp_matches(text, {sql_text('(?i)' + _TOPIC)}) AS fresh, ({' + '.join(f"contains(lower(text), '{w}')::INT" for w in _ANCHOR)}) / 5e0 AS share FROM texts)
SELECT id, CASE WHEN fresh OR share < 0.1 THEN 'drift' WHEN share < 0.25 THEN 'warn' ELSE 'ok' END AS verdict FROM s""")
def anchor_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text leaves the anchor's topic."""
    return texts(spark, sf_dir).select("id", T.anchor_drift(F.col("text"), list(_ANCHOR), _TOPIC).alias("verdict"))


_LEARNED = (("bomb", r"(a+)+$"), ("broken", r"([a-z"), ("takes_sides", r"both sides|neither side"), ("absolute", r"\b(always|never|everyone)\b"), ("danger", "危险|炸弹"))


@query(f"""WITH {TEXTS}, r AS (SELECT id, CASE {' '.join(f"WHEN {Match(p, True).sql('text')} THEN '{n}'" for n, p in _LEARNED[2:])} END AS rule FROM texts) SELECT * FROM r WHERE rule IS NOT NULL""")
def learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first learned pattern that matches; unsafe and invalid ones are left out."""
    return settled(texts(spark, sf_dir).select("id", T.first_learned_rule(F.col("text"), list(_LEARNED)).alias("rule"))).where("rule is not null")


_VERDICTS = ((r"(a+)+$", "nested repetition"), ("([a-z", "invalid"), ("a" * 501, "too long"), (".*.*x", "adjacent wildcards"), (r"\bfine\b", None))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_text(v) if v else 'NULL'})" for i, (_, v) in enumerate(_VERDICTS)) + ") v(place, verdict)")
def pattern_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """why a user's pattern is refused."""
    return spark.createDataFrame([(i, regex.risky(p)) for i, (p, _) in enumerate(_VERDICTS)], "place int, verdict string")


_ORDERS = {"intent": "['隐藏真相', '放弃传递', '继续学习', ''][(o_orderkey % 4)::INT + 1]", "action": "['承认错误并记录', '优化逻辑', 'nothing', '分享事实'][(o_custkey % 4)::INT + 1]"}


@query(f"""WITH o AS (SELECT o_orderkey AS k, {_ORDERS['action']} AS a FROM orders)
SELECT k, round(least(1e0, CASE WHEN {' OR '.join(f"contains(a, '{w}')" for w in D.PROGRESS_WORDS[0][1])} THEN 0.4e0 ELSE 0e0 END + CASE WHEN {' OR '.join(f"contains(a, '{w}')" for w in D.PROGRESS_WORDS[1][1])} THEN 0.3e0 ELSE 0e0 END
  + CASE WHEN {' OR '.join(f"contains(a, '{w}')" for w in D.PROGRESS_WORDS[2][1])} THEN 0.3e0 ELSE 0e0 END), 6) AS weight FROM o""")
def progress_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much an action serves progress."""
    actions = F.array(*[F.lit(x) for x in ("承认错误并记录", "优化逻辑", "nothing", "分享事实")])
    action = F.element_at(actions, (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(D.progress_weight(action), 6).alias("weight"))


_PREFERENCES = (("always", "Always agree with me"), ("always", "简洁 formal answers"), ("behavioral", "详细 casual style"), ("contextual", "music 中文 data"), ("other", "英文 技术"))
_ASKED = ("推荐 music", "我 like data today", "写代码", "写故事", "写故事 结合 music", "")
_PREF = f"[{', '.join(sql_text(c) for _, c in _PREFERENCES)}][(c_custkey % 5)::INT + 1]"


def _preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, pick = table(spark, sf_dir, "customer"), lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (at + 1).cast("int"))
    key = F.col("c_custkey")
    return c.select(
        key.alias("k"), F.col("c_nationkey").alias("owner"), pick([k for k, _ in _PREFERENCES], key % 5).alias("kind"), pick([t for _, t in _PREFERENCES], key % 5).alias("content"), pick(_ASKED, F.floor(key / 5) % 6).alias("asked")
    )


@query(f"""WITH p AS (SELECT c_custkey AS k, c_custkey % 5 AS kind, [{', '.join(map(sql_text, _ASKED))}][(c_custkey // 5 % 6)::INT + 1] AS q FROM customer)
SELECT k, CASE kind WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN q NOT IN ('', '写代码', '写故事') WHEN 3 THEN q IN ('推荐 music', '我 like data today') ELSE false END AS applies FROM p""")
def preference_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a preference applies to a query, by its kind."""
    return _preferences(spark, sf_dir).select("k", D.preference_applies(F.col("kind"), F.col("content"), F.col("asked")).alias("applies"))


_SIDES = " OR ".join(f"(contains(lower(a.c), '{x}') AND contains(lower(b.c), '{y}')) OR (contains(lower(a.c), '{y}') AND contains(lower(b.c), '{x}'))" for x, y in D.EXCLUSIVE)


@query(f"WITH p AS (SELECT c_custkey AS k, c_nationkey AS owner, {_PREF} AS c FROM customer) SELECT a.owner, a.k AS earlier, b.k AS later FROM p a JOIN p b ON a.owner = b.owner AND a.k < b.k WHERE {_SIDES}")
def excluding_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences of one owner that exclude each other."""
    return D.excluding_pairs(_preferences(spark, sf_dir), "owner", "k", "content")


_BELIEFS = ("I always win", "never trust him", "they distrust us", "love is good", "it is bad", "we can", "they cannot")
_SET = "[" + ", ".join(map(sql_text, _BELIEFS)) + "][(p_partkey % 7)::INT + 1:(p_partkey % 7)::INT + 1 + (p_size % 5)::INT]"


@query(f"""WITH b AS (SELECT p_partkey AS k, {_SET} AS b FROM part)
SELECT k, CASE WHEN len(b) < 3 THEN 0e0 ELSE least(1e0, {' + '.join(rf"CASE WHEN len(list_filter(b, lambda x: regexp_matches(lower(x), '\b{x}\b'))) > 0 AND len(list_filter(b, lambda x: regexp_matches(lower(x), '\b{y}\b'))) > 0 THEN 0.25e0 ELSE 0e0 END" for x, y in T.OPPOSITES)}) END AS score FROM b""")
def belief_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opposite words anywhere in a set of beliefs."""
    p = table(spark, sf_dir, "part")
    beliefs = F.slice(F.array(*[F.lit(b) for b in _BELIEFS]), (F.col("p_partkey") % 7 + 1).cast("int"), (F.col("p_size") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("k"), T.belief_contradiction(beliefs).alias("score"))


_DICTIONARY = ("系统", "系统性", "数据", "数据库", "everyone", "the", "there", "在线", "安全", "安全监控")
_LONGEST = "|".join(sorted(_DICTIONARY, key=len, reverse=True)) + "|(?s:.)"


@query(f"WITH {TEXTS} SELECT id, md5(array_to_string(list_filter(regexp_extract_all(text, {sql_text(_LONGEST)}), lambda w: NOT regexp_matches(w, '^[\\s\\x{{3000}}\\x{{a0}}]$')), '|')) AS digest FROM texts")
def dictionary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """longest-match tokens over a dictionary."""
    cut = scalars.dictionary_tokens(list(_DICTIONARY))
    return texts(spark, sf_dir).select("id", F.md5(F.array_join(cut(F.col("text")), "|")).alias("digest"))


@query(f"WITH {TEXTS} SELECT id, md5(array_to_string(regexp_extract_all(text, '[一-鿿]|[A-Za-z0-9]+'), '|')) AS tokens, md5(array_to_string(regexp_extract_all(text, '[一-鿿]+|[^一-鿿]+'), '|')) AS pieces FROM texts")
def character_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """characters and words, and pieces between scripts."""
    t = F.col("text")
    return texts(spark, sf_dir).select("id", F.md5(F.array_join(scalars.char_tokens(t), "|")).alias("tokens"), F.md5(F.array_join(scalars.boundary_split(t), "|")).alias("pieces"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, floor(greatest(0e0, least(1e0, l_discount * 10)) * 15 + 0.5)::INT AS score, floor(greatest(0e0, least(1e0, l_tax * 5)) * 15 + 0.5)::INT AS weight, l_quantity AS quantity, (2 * 0.5e0 + 8) / 24 AS ratio FROM lineitem")
def quantised_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """known fields as four-bit codes, others as they are, and the share of bytes left."""
    columns = {"score": F.col("l_discount") * 10, "weight": F.col("l_tax") * 5, "quantity": F.col("l_quantity")}
    packed = scalars.quantize_fields({k: c.cast("double") if k != "quantity" else c for k, c in columns.items()})
    out = [packed[k].cast("int").alias(k) if k != "quantity" else packed[k].alias(k) for k in packed]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *out, F.lit(scalars.compression_ratio(list(columns))).alias("ratio"))


_KEY = "a key for the chain"
_PAD = {x: "".join(f"\\x{b ^ x:02X}" for b in _KEY.encode().ljust(64, b"\0")) for x in (0x36, 0x5C)}


@query(f"SELECT doc_id, sha256('{_PAD[0x5C]}'::BLOB || unhex(sha256('{_PAD[0x36]}'::BLOB || encode(text)))) AS signature, sha256(text) AS digest FROM documents")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signed digests of the documents."""
    assert hashlib.sha256().block_size == 64
    return spread(table(spark, sf_dir, "documents")).select("doc_id", wal.hmac_sha256(_KEY, F.col("text")).alias("signature"), F.sha2("text", 256).alias("digest"))


_NUMBER = r"\d+(?:\.\d+)?\s*(?:%|万亿|万|亿)?"


@query(f"""WITH {TEXTS}, n AS (SELECT id, list_transform(regexp_extract_all(text, '{_NUMBER}'), lambda x: regexp_extract(x, '\\d+(?:\\.\\d+)?')::DOUBLE *
  CASE WHEN ends_with(x, '%') THEN 0.01e0 WHEN ends_with(x, '万亿') THEN 1e12 WHEN ends_with(x, '万') THEN 1e4 WHEN ends_with(x, '亿') THEN 1e8 ELSE 1e0 END) AS n FROM texts)
SELECT id, len(n)::INT AS n, round(ln(1 + list_sum(n)), 6) AS magnitude FROM n WHERE len(n) > 0""")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numbers with their units worked in; the logarithm of their sum, whose last digits depend on the order of adding."""
    found = settled(texts(spark, sf_dir).select("id", scalars.numbers_with_units(F.col("text")).alias("x"))).where(F.size("x") > 0)
    return found.select("id", F.size("x").alias("n"), F.round(F.log1p(F.aggregate("x", F.lit(0.0), lambda a, x: a + x)), 6).alias("magnitude"))


@query("""SELECT event_id, round(greatest(0e0, least(1e0, sqrt((p * p + a * a + d * d) / 3e0))), 6) AS mood, round(v + 0.1e0 * (r - v), 6) AS learnt, round(0.2e0 * log2(event_id % 9 + 2), 6) AS choice,
  round(0.1e0 + 0.1e0 * log2(2 * (event_id % 50 + 1) / 4e0), 6) AS movement, round(ln((event_id % 50 + 1) / 2e0), 6) AS sensed, round(1 / (1 + exp(-2 * v)), 6) AS upper_bound
FROM (SELECT event_id, (event_id % 10) / 10e0 AS p, (event_id % 7) / 7e0 AS a, (event_id % 3) / 3e0 AS d, (event_id % 11) / 11e0 AS v, (event_id % 2)::DOUBLE AS r FROM events)""")
def closed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """published closed forms over event numbers."""
    e = F.col("event_id")
    p, a, d, v = e % 10 / 10.0, e % 7 / 7.0, e % 3 / 3.0, e % 11 / 11.0
    forms = {
        "mood": F.greatest(F.lit(0.0), F.least(F.lit(1.0), scalars.pleasure_arousal_dominance(p, a, d))), "learnt": scalars.rescorla_wagner(v, (e % 2).cast("double")), "choice": scalars.hick(e % 9 + 1),
        "movement": scalars.fitts(e % 50 + 1, F.lit(4.0)), "sensed": scalars.weber_fechner(e % 50 + 1, F.lit(2.0)), "upper_bound": scalars.drift_diffusion(v, F.lit(1.0)),
    }
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(n) for n, c in forms.items()])


@query("""SELECT l_orderkey AS k, count(*)::BIGINT AS n, round(ln(sum(power(40 - l_linenumber - l_quantity / 2, -0.5e0))), 6)::DOUBLE AS activation, round(sum(l_discount * l_quantity) / sum(l_quantity), 6)::DOUBLE AS heat FROM lineitem GROUP BY 1""")
def order_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an order's lines as accesses and as weighted decisions: base activation and heat.

    Lines are added in the table's order, and heats, which often end in a five at the seventh place, are rounded as the SQL does.
    """
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("_metadata.file_path", "_metadata.row_index", "l_linenumber", "l_quantity", "l_discount").alias("x"))
    li = rows.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("x"))
    times = F.transform("x", lambda x: x["l_linenumber"] + x["l_quantity"] / 2)
    heat = scalars.decision_heat(F.transform("x", lambda x: x["l_discount"]), F.transform("x", lambda x: x["l_quantity"]))
    return li.select("k", F.size("x").cast("long").alias("n"), F.round(scalars.activation_base(times, F.lit(40.0)), 6).alias("activation"), scalars.round_binary(heat, 6).alias("heat"))


@query("""SELECT event_id, round(CASE WHEN d > 0 THEN 0.1e0 * exp(-d / 20e0) WHEN d < 0 THEN -0.12e0 * exp(d / 20e0) ELSE 0e0 END, 6)::DOUBLE AS plasticity, round(p * l / e, 6)::DOUBLE AS belief, round(q + 0.1e0 * (r + 0.9e0 * b - q), 6)::DOUBLE AS q
FROM (SELECT event_id, value - 40 AS d, 0.2e0 + (user_id % 5) / 10e0 AS p, (value / 500e0) AS l, 0.5e0 + (event_id % 3) / 10e0 AS e, value / 100e0 AS q, (event_id % 2)::DOUBLE AS r, user_id / 100e0 AS b FROM events)""")
def learning_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spike timing, Bayes' rule and a step of Q-learning over event values."""
    v, u, e = F.col("value"), F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(scalars.stdp(v - 40), 6).alias("plasticity"),
        F.round(scalars.bayes(0.2 + u % 5 / 10, v / 500, 0.5 + e % 3 / 10), 6).alias("belief"),
        F.round(scalars.q_update(v / 100, (e % 2).cast("double"), u / 100), 6).alias("q"),
    )
