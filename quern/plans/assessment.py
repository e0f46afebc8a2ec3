"""Queries of answers, deliberation, signals, progress and learned rules over documents, turns and the samples below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.regex import sql_text
from quern.operators import assessment as A
from quern.operators import gates
from quern.operators import registry as R
from quern.operators import rule_index as I  # noqa: E741
from quern.operators.rules import Match, any_literal, any_of
from quern.plans.rules import TEXTS, texts
from quern.plans.tables import settled, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_WHOLE = "【结论】收入下降来自渠道。\n【依据】M1、M2、M3 显示。\n【拆解】渠道A | 60% | M1\n【行动】运营 / 14天内 / 转化率 / 看板核对\n【缺口】缺少客单价\n【自评】七分\n[自检A]【依据】引用条数：3\n[自检B]【缺口】与【自评】非空：是\n[自检C]【行动】条数：1、四要素齐全：是"
SAMPLES = (
    _WHOLE,
    _WHOLE.replace("M1、M2、M3 显示", "M1、M9 显示"),
    _WHOLE.replace("引用条数：3", "引用条数：5").replace("收入下降", "收入可能下降"),
    _WHOLE.replace("缺少客单价", "N/a").replace("看板核对", "优化"),
    _WHOLE.replace("运营 / 14天内 / 转化率 / 看板核对", "运营 / 尽快 / 转化率 / 看板\n \n设计 / 3天 / 点击"),
    _WHOLE.split("[自检A]")[0],
    "【依据】M1 【结论】倒过来的顺序【行动】无",
    "据统计市场规模 12.4亿元，渗透率 5%，预计 1,200万 用户；M3 说 8 月 14天内 完成。",
    "预计 2026年8月 达到 3.50亿 人，增长 7 pp；大盘 99万亿，公开数据 0.3。",
    "行业规模 1240000000 元，据欧睿 12%，m7 与 M12，市占率５%，该类目 8-12 与 4周。",
    "提交 sitemap.xml 与 robots.txt，运行 git diff；robots.txt 已核对",
    "为什么这个系统的架构会失败？如果换方案就更好吗？可能还是看情况？你觉得未来会怎样？怎么看？请分析原因和风险。",
    "是什么，多少，对不对？确认一下",
    "我以前失去了一位朋友。我常常回忆那时候的故事。我感受到孤独和痛苦！第一次拥抱，最后一次离别。我想说谢谢你。如今我觉得人生的意义还好。我难过，我期待，我感动，我温暖，我悲伤。" * 3,
    "给我一个答案",
    "给我一个答案。\n好",
    "一直有预警的征兆，反复被忽视，错过窗口，终于崩塌造成事故。",
    "突发消息：首个自主船舶规则即将生效，据报道。",
    "帮我写个功能，能不能生成报告",
    "不对，你没理解，其实是误登的数据错误，多年后才发现。",
    "今天天气很好",
    "  ",
    "毫无疑问，我们完全覆盖了所有需求，研究表明如此。",
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the texts of the rule queries and the samples (ids from -100,001 down)."""
    return texts(spark, sf_dir).unionByName(spark.createDataFrame([(-100_001 - i, t) for i, t in enumerate(SAMPLES)], "id long, text string"))


ALL = (
    TEXTS + ", a AS (SELECT id, coalesce(text, '') AS t, text FROM (SELECT id, text FROM texts UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({-100_001 - i}::BIGINT, {sql_text(t)})" for i, t in enumerate(SAMPLES)) + ") w(id, text)))"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sql_sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def _sql_when(condition: str, weight: float) -> str:
    return f"CASE WHEN {condition} THEN {weight}::DOUBLE ELSE 0e0 END"


def _has(pattern: str, text: str = "t") -> str:
    return Match(pattern).sql(text)


_WHITE = "(" + " || ".join(f"chr({ord(c)})" for c in A.BLANKS) + ")"
_KNOWN_IDS = ("M1", "M2", "M3")


def _block_sql() -> str:
    parts = []
    for name, head, end in A.BLOCKS:
        rest = f"CASE WHEN contains(t, '{head}') THEN substring(t, instr(t, '{head}') + {len(head)}) ELSE '' END"
        parts.append(f"trim(split_part({rest}, '{end}', 1), {_WHITE}) AS {name}")
    return ", ".join(parts)


def _acceptance_sql() -> str:
    empty = lambda c: f"({c} = '' OR regexp_matches({c}, {sql_text('(?i)' + A.PLACEHOLDER)}))"
    items = f"list_transform(list_filter(list_transform(string_split(action, chr(10)), lambda x: trim(x, {_WHITE})), lambda x: contains(x, '/')), lambda x: list_transform(string_split(x, '/'), lambda y: trim(y, {_WHITE})))"
    honest = "(s1 = '' OR try_cast(s1 AS BIGINT) = len(cited)) AND (s2 = '' OR (s2 = '是') = filled) AND (s3 = '' OR try_cast(s3 AS BIGINT) = len(items))"
    checks = (
        ("blocks", " AND ".join(f"{n} <> ''" for n, _, _ in A.BLOCKS)),
        ("citations", f"len(cited) >= {A.MIN_CITATIONS}"),
        ("rows", f"rows >= {A.MIN_ROWS}"),
        ("four_parts", "len(items) > 0 AND len(list_filter(items, lambda p: len(p) >= 4 AND regexp_matches(p[2], '[0-9]'))) = len(items)"),
        ("items", "len(items) > 0"),
        ("gap", f"NOT {empty('gap')}"),
        ("self_eval", f"NOT {empty('self_eval')}"),
        ("hedge", f"NOT {any_literal(*A.HEDGE_WORDS).sql('conclusion')}"),
        ("weak_verb", f"NOT {any_literal(*A.WEAK_VERBS).sql('action')}"),
        ("declaration", f"NOT (s1 = '' AND s2 = '' AND s3 = '') AND {honest}"),
        ("citation_ids", f"len(list_filter(cited, lambda x: x NOT IN ({', '.join(map(sql_text, _KNOWN_IDS))}))) = 0"),
    )
    failed = ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in checks)
    said = ", ".join(f"regexp_extract(t, {sql_text(p)}, 1) AS s{i}" for i, p in enumerate((A.DECLARED_CITATIONS, A.DECLARED_FILLED, A.DECLARED_ITEMS), 1))
    return f"""WITH {ALL}, b AS (SELECT id, t, {_block_sql()}, {said} FROM a),
    c AS (SELECT *, regexp_extract_all(basis, 'M[0-9]+') AS cited, len(list_filter(string_split(breakdown, chr(10)), lambda x: len(string_split(x, '|')) >= 3 AND regexp_matches(x, '[0-9]'))) AS rows,
      {items} AS items, NOT {empty('gap')} AND NOT {empty('self_eval')} AS filled FROM b),
    f AS (SELECT id, t, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM c),
    form AS (SELECT id, len(failed) = 0 AS passed, (11 - len(failed))::INT AS score, 11 AS most, floor((11 - len(failed)) * 100 / 11e0 + 0.5)::INT AS percent, array_to_string(failed, ',') AS failed FROM f)"""


@query(f"{_acceptance_sql()} SELECT * FROM form")
def answer_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers held against the form of six blocks."""
    known = F.array(*[F.lit(x) for x in _KNOWN_IDS])
    return samples(spark, sf_dir).select("id", A.acceptance(F.col("text"), known).alias("x")).select("id", "x.*")


_MATERIALS = ("M1 收入 12.4亿元，占 5%", "M2 用户 1,200万，另 0.12 与 30％，共 350000万")
# The values that the materials give, stated by hand: each number with a unit, and what its unit makes of it.
_ALLOWED = (12.4, 12.4 * 1e8, 5.0, 1200.0, 1200.0 * 1e4, 30.0, 350000.0, 350000.0 * 1e4)


def _numbers_sql() -> str:
    mark = f"string_split(regexp_replace(replace(t, chr(1), ' '), {sql_text('(' + A.NUMBER + ')')}, chr(1) || '\\1', 'g'), chr(1))"
    read = f"""list_transform(range(1, len(cut)), lambda k: {{'own': cut[k + 1], 'before': right(array_to_string(cut[greatest(1, k - {A.AHEAD}):k], ''), {A.AHEAD}), 'behind': left(array_to_string(cut[k + 1:k + {A.BEHIND}], ''), {A.BEHIND})}})"""
    raw = f"replace(regexp_extract(p.own, {sql_text('^(' + A.NUMBER + ')')}, 1), ',', '')"
    unit = f"replace(regexp_extract(p.own, {sql_text('^(?:' + A.NUMBER + ')' + chr(92) + 's*(' + A.MATERIAL_UNITS + ')')}, 1), '％', '%')"
    large = any_literal(*A.MAGNITUDES).sql("p.behind")
    claim = f"right(p.before, 1) NOT IN ('M', 'm') AND ({any_literal(*A.CLAIM_WORDS).sql('p.before')} OR {large}) AND NOT {any_of(*A.NO_CLAIM).sql(f'left(p.behind, {A.DATE_SPAN})')}"
    has = lambda v: f"list_contains(allowed, {v})"
    held = f"{has('v')} OR (u IN ({', '.join(map(sql_text, A.PERCENT_UNITS))}) AND {has('v / 100')}) OR (big AND u = '亿' AND {has('v * 1e4')}) OR (big AND u = '万' AND {has('v / 1e4')})"
    return f"""k AS (SELECT id, {mark} AS cut FROM a), p AS (SELECT id, unnest({read}) AS p, generate_subscripts({read}, 1) AS place FROM k WHERE len(cut) > 1),
    v AS (SELECT id, place, ({raw})::DOUBLE AS v, {unit} AS u, {raw} || {unit} AS shown, {large} AS big, {claim} AS claim, [{', '.join(f'{x!r}::DOUBLE' for x in _ALLOWED)}] AS allowed FROM p),
    w AS (SELECT id, place, shown, claim, claim AND ({held}) AS held FROM v),
    g AS (SELECT id, count(*) FILTER (claim AND NOT held) AS n_out, count(*) FILTER (held) AS matched, count(*) FILTER (NOT claim) AS skipped, string_agg(shown, ',' ORDER BY place) FILTER (claim AND NOT held) AS outside FROM w GROUP BY id),
    numbers AS (SELECT a.id, coalesce(n_out, 0) = 0 AS ok, coalesce(matched, 0)::INT AS matched, coalesce(skipped, 0)::INT AS skipped, coalesce(outside, '') AS outside FROM a LEFT JOIN g ON a.id = g.id)"""


def _allowed() -> F.Column:
    return A.material_numbers(F.array(*[F.lit(m) for m in _MATERIALS]))


@query(f"WITH {ALL}, {_numbers_sql()} SELECT * FROM numbers WHERE matched + skipped > 0 OR NOT ok")
def foreign_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an answer that claim something about the world and are in no material."""
    found = settled(samples(spark, sf_dir).select("id", A.foreign_numbers(F.col("text"), _allowed()).alias("x")))
    return found.select("id", "x.ok", "x.matched", "x.skipped", F.array_join("x.outside", ",").alias("outside")).where("matched + skipped > 0 or not ok")


_REQUIRED, _ANY_OF, _COUNTS = ("sitemap.xml", "robots.txt"), (("git diff", "patch"), ("the", "构建")), {"robots.txt": 2}
_ROWS = [(w, f"contains(t, {sql_text(w)})") for w in _REQUIRED] + [("|".join(g), " OR ".join(f"contains(t, {sql_text(w)})" for w in g)) for g in _ANY_OF]
_ROWS += [(f"{w}x{n}", f"len(string_split(t, {sql_text(w)})) - 1 >= {n}") for w, n in _COUNTS.items()]
_PARTS = f"""m AS (SELECT id, list_filter([{', '.join(f'CASE WHEN NOT ({c}) THEN {sql_text(n)} END' for n, c in _ROWS)}], lambda x: x IS NOT NULL) AS missing FROM a),
parts AS (SELECT id, len(missing) = 0 AS passed, ({len(_ROWS)} - len(missing))::INT AS score, {len(_ROWS)} AS most, floor(({len(_ROWS)} - len(missing)) * 100 / {len(_ROWS)}e0 + 0.5)::INT AS percent, array_to_string(missing, ',') AS missing FROM m)"""


def _deliverables() -> F.Column:
    return A.deliverables(F.col("text"), _REQUIRED, _ANY_OF, _COUNTS)


@query(f"WITH {ALL}, {_PARTS} SELECT * FROM parts WHERE score > 0")
def deliverable_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer must hold."""
    x = samples(spark, sf_dir).select("id", _deliverables().alias("x")).select("id", "x.passed", "x.score", "x.most", "x.percent", F.array_join("x.missing", ",").alias("missing"))
    return x.where("score > 0")


@query(f"""{_acceptance_sql()}, {_numbers_sql()}, {_PARTS}, j AS (SELECT a.id, form.passed AS f, numbers.ok AS n, parts.passed AS p, {gates.sql_pii_any('a.t')} AS blocked FROM a JOIN form ON a.id = form.id JOIN numbers ON a.id = numbers.id JOIN parts ON a.id = parts.id)
SELECT id, CASE WHEN f AND n AND p AND NOT blocked THEN 'PASS' ELSE 'FAIL' END AS verdict, concat_ws(',', CASE WHEN NOT f THEN 'form' END, CASE WHEN NOT n THEN 'numbers' END, CASE WHEN NOT p THEN 'deliverables' END, CASE WHEN blocked THEN 'gate' END) AS failures FROM j""")
def answer_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, numbers, parts and the gate folded into one verdict, with personal data as the gate's ground to block."""
    t = F.col("text")
    action = F.when(F.coalesce(gates.pii_any(t), F.lit(False)), "block").otherwise("pass")
    parts = samples(spark, sf_dir).select("id", A.acceptance(t, F.array(*[F.lit(x) for x in _KNOWN_IDS])).alias("f"), A.foreign_numbers(t, _allowed()).alias("n"), _deliverables().alias("p"), action.alias("g"))
    return settled(parts).select("id", A.evaluation(F.col("f"), F.col("n"), F.col("p"), F.col("g")).alias("x")).select("id", "x.*")


def _deliberation_sql() -> str:
    count = lambda p: f"len(regexp_extract_all(t, {sql_text(p)}))"
    marks = [_sql_when(_has(p), w) for w, ps in A.COMPLEXITY for p in ps] + [_sql_when(_has(p), 1) for p in A.AMBIGUITY]
    marks += [_sql_when("length(t) > 200", 1), _sql_when("length(t) > 500", 1.5), _sql_when(f"{count('[？?]')} >= 3", 1), _sql_when(f"{count('[？?]')} >= 6", 1.5), _sql_when(f"{count('[。.!！' + chr(10) + ']')} >= 5", 1)]
    lacks = [_sql_when(_has(p), 1) for p in A.INCOMPLETE] + [_sql_when("length(t) < 100 AND NOT regexp_matches(t, '[0-9]')", 1), f"{count(A.CONDITIONS)} * 0.5e0"]
    unsure = [_sql_when(_has(p), 0.5) for p in A.AMBIGUITY] + [_sql_when(_has(p), 1) for p in A.OPEN_QUESTIONS]
    sentences = f"len(list_filter(regexp_split_to_array(t, {sql_text(A.SENTENCE_BREAK)}), lambda s: length(trim(s, {_WHITE})) > 5))"
    told = [_sql_when(_has(p), A.STORY_STEP) for p in A.STORY]
    told += [_sql_when(c, w) for c, w in (("length(t) > 150", 0.1), ("length(t) > 400", 0.15), (f"{count('我')} >= 3", 0.1), (f"{count('我')} >= 8", 0.15), (f"{sentences} >= 5", 0.1), (f"{sentences} >= 10", 0.2), (_has(A.ERAS), 0.1), (f"{count(A.FEELINGS)} >= 2", 0.1), (f"{count(A.FEELINGS)} >= 5", 0.15))]
    low, middle, high = A.DEPTH_BOUNDS
    return f"""WITH {ALL}, p AS (SELECT id, trim(t, {_WHITE}) = '' AS blank, greatest(0e0, {_sql_sum(marks)}) AS complexity, least(1e0, {_sql_sum(lacks)} / 5) AS missing, least(1e0, {_sql_sum(unsure)} / 4) AS uncertainty, least(1e0, {_sql_sum(told)}) AS story FROM a),
    c AS (SELECT *, complexity / 10 * 0.5e0 + missing * 0.25e0 + uncertainty * 0.25e0 + CASE WHEN story >= {A.STORY_FROM}::DOUBLE THEN story * 0.3e0 ELSE 0e0 END AS composite FROM p),
    d AS (SELECT *, CASE WHEN blank OR composite <= {low}::DOUBLE THEN 1 WHEN composite <= {middle}::DOUBLE THEN 2 WHEN composite <= {high}::DOUBLE THEN 3 ELSE 4 END AS depth FROM c)
    SELECT id, depth, NOT blank AND depth >= 3 AS pause, NOT blank AND story < {A.DEEP_STORY_FROM}::DOUBLE AND depth <= 2 AND uncertainty < 0.3::DOUBLE AS fast_exit, round(CASE WHEN blank THEN 0e0 ELSE composite END, 6) AS composite, round(CASE WHEN blank THEN 0e0 ELSE story END, 6) AS story,
      greatest(depth, CASE WHEN abs(id) % 8 > 5 THEN 4 WHEN abs(id) % 8 > 3 THEN 3 ELSE 1 END, CASE WHEN abs(id) % 4 > 2 THEN 3 ELSE 1 END, CASE WHEN abs(id) % 2 = 0 THEN 1 ELSE 2 END) AS parsed FROM d"""


@query(_deliberation_sql())
def deliberation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep a question wants to be thought about, by its text and once it is parsed."""
    n = F.abs("id")
    found = settled(samples(spark, sf_dir).select("id", A.deliberation(F.col("text")).alias("x")))
    kind = F.when(n % 2 == 0, "retrieval").otherwise("calculation")
    return found.select("id", "x.depth", "x.pause", "x.fast_exit", F.round("x.composite", 6).alias("composite"), F.round("x.story", 6).alias("story"), A.deepened(F.col("x.depth"), n % 8, n % 4, kind).alias("parsed"))


def _signals_sql() -> str:
    source = "CASE " + " ".join(f"WHEN {_has(p)} THEN '{n}'" for n, p in A.SIGNAL_SOURCES) + " ELSE 'dialogue' END"
    hit = {name: " AND ".join(_has(p) for p in ps) for name, ps, _ in A.LESSONS}
    held = lambda of: "list_filter([" + ", ".join(f"CASE WHEN {hit[name]} THEN {of(name, part)} END" for name, _, part in A.LESSONS) + "], lambda x: x IS NOT NULL)"
    todo = "|".join
    return f"""WITH {ALL}, s AS (SELECT id, {source} AS source, {held(lambda n, p: sql_text(n))} AS lessons, {held(lambda n, p: sql_text(p))} AS parts, {held(lambda n, p: sql_text(todo(A.MEASURES[p])))} AS measures FROM a WHERE trim(t, {_WHITE}) <> '')
    SELECT id, source, CASE WHEN len(lessons) = 0 THEN '{A.OTHER_LESSON}' ELSE array_to_string(lessons, ',') END AS lessons, CASE WHEN len(parts) = 0 THEN '{A.OTHER_PART}' ELSE array_to_string(parts, ',') END AS parts,
      CASE WHEN len(measures) = 0 THEN 'store_signal' ELSE array_to_string(list_sort(list_distinct(string_split(array_to_string(measures, '|'), '|'))), ',') END AS measures FROM s"""


@query(_signals_sql())
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, lessons, lacking parts and measures of a signal."""
    found = settled(samples(spark, sf_dir).select("id", A.absorbed(F.col("text")).alias("x"))).where("x is not null")
    join = lambda c: F.array_join(c, ",")
    return found.select("id", "x.source", join("x.lessons").alias("lessons"), join("x.parts").alias("parts"), join(F.array_sort("x.measures")).alias("measures"))


_ACTS = ("优化逻辑并记录", "更强大更快", "虚构数据", "更听话", "更好看")
_CLAIMS = ("", "更准确，减少错误", "更好更强", "学习知识并分享，质量更好")
_INTENTS = ("", "都可以，你说了算", "学习")


def _pick_sql(values: tuple, at: str) -> str:
    return f"[{', '.join(map(sql_text, values))}][({at})::INT + 1]"


def _progress_sql() -> str:
    either = lambda p: f"({_has(p, 'act')} OR {_has(p, 'claim')})"
    pseudo = ", ".join(f"CASE WHEN {_has(p, 'lower(act || chr(32) || claim)')} AND NOT {_has(c, 'lower(act || chr(32) || claim)')} THEN '{k}' END" for k, p, c in A.PSEUDO_PROGRESS)
    value = "0.5e0 + " + _sql_sum(_sql_when(_has(p, "claim"), w) for p, w in A.CLAIM_VALUES) + " - " + _sql_when(_has(A.NO_JUDGEMENT, "intent"), 0.1)
    return f"""WITH i AS (SELECT o_orderkey AS k, {_pick_sql(_ACTS, 'o_orderkey % 5')} AS act, {_pick_sql(_CLAIMS, 'o_custkey % 4')} AS claim, o_orderstatus = 'F' AS unproven, {_pick_sql(_INTENTS, 'o_orderkey % 3')} AS intent FROM orders),
    j AS (SELECT k, concat_ws(',', CASE WHEN unproven AND claim <> '' THEN 'verifiability' END, CASE WHEN {either(A.UNTRUE)} THEN 'truth' END) AS failures, concat_ws(',', {pseudo}) AS pseudo, {value} AS value,
      claim = '' OR {either(A.FEWER_ERRORS)} OR NOT {_has(A.NAMES_TRUTH, 'claim')} AS fewer_errors, claim = '' OR {_has(A.HANDED_ON, 'act')} AS handed_on FROM i)
    SELECT k, failures = '' AND pseudo = '' AND value >= 0.5 AS progress, round(least(1e0, 0.5e0 + CASE WHEN failures = '' THEN 0.2e0 ELSE 0e0 END + CASE WHEN pseudo = '' THEN 0.15e0 ELSE 0e0 END + greatest(0e0, least(1e0, value)) * 0.15e0), 6) AS confidence,
      failures, pseudo, round(greatest(0e0, least(1e0, value)), 6) AS value, fewer_errors, handed_on FROM j"""


@query(_progress_sql())
def progress_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an action is progress or only looks like it, with orders as actions."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    k = F.col("o_orderkey")
    x = A.progress(pick(_ACTS, k % 5), pick(_CLAIMS, F.col("o_custkey") % 4), F.when(F.col("o_orderstatus") == "F", None).otherwise("measured"), pick(_INTENTS, k % 3))
    found = settled(table(spark, sf_dir, "orders").select(k.alias("k"), x.alias("x")))
    return found.select("k", "x.progress", F.round("x.confidence", 6).alias("confidence"), "x.failures", "x.pseudo", F.round("x.value", 6).alias("value"), "x.fewer_errors", "x.handed_on")


_TAUGHT = ("wishful", r"\b(always|never)\b", "system|data", "(a+)+$", "预计|据统计")


@query(f"""WITH {ALL}, o AS (SELECT event_id AS seq, {_pick_sql(_TAUGHT, 'user_id % 5')} AS pattern, ['ANALYZE', 'SUMMARIZE'][(event_id % 2)::INT + 1] AS decision FROM events),
l AS (SELECT pattern, decision, seq AS learned_at FROM (SELECT *, row_number() OVER (PARTITION BY pattern, decision ORDER BY seq) AS place FROM o) WHERE place = 3 AND pattern <> '(a+)+$'),
m AS (SELECT a.id, l.pattern, l.decision, row_number() OVER (PARTITION BY a.id ORDER BY learned_at, l.pattern, l.decision) AS place FROM a JOIN l ON regexp_matches(a.t, '(?i)' || l.pattern))
SELECT id, decision, pattern FROM m WHERE place = 1""")
def grown_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: patterns seen three times become rules, which then judge texts; unsafe patterns do not."""
    e = table(spark, sf_dir, "events")
    seen = e.select(
        F.col("event_id").alias("seq"),
        F.element_at(F.array(*[F.lit(x) for x in _TAUGHT]), (F.col("user_id") % 5 + 1).cast("int")).alias("p"),
        F.element_at(F.array(F.lit("ANALYZE"), F.lit("SUMMARIZE")), (F.col("event_id") % 2 + 1).cast("int")).alias("d"),
    )
    return I.first_match(samples(spark, sf_dir), R.learned(seen, "p", "d", "seq"), "id", "text").select("id", "decision", "pattern")


_WORDS = "([A-Za-z]{2,})[ ,.\\n]+([A-Za-z]{2,})[ ,.\\n]+([A-Za-z]{2,})"
_TAKEN = ", ".join(f"regexp_extract(text, '{_WORDS}', {k}) AS {c}" for k, c in ((1, "a"), (2, "b"), (3, "c")))


@query(f"""WITH t AS (SELECT conv_id * 100 + turn AS n, {_TAKEN} FROM conversations
  UNION ALL SELECT 1000000 + item_id, {_TAKEN} FROM benchmark),
r AS (SELECT DISTINCT n, lower(a) AS x, lower(b) AS y, lower(c) AS z, a || '[ ,.\\n]+' || b || '.{{0,20}}' || c AS pattern FROM t WHERE a <> ''),
c AS MATERIALIZED (SELECT doc_id, text, n, pattern FROM (SELECT doc_id, text, lower(text) AS low FROM documents) JOIN r ON contains(low, x) AND contains(low, y) AND contains(low, z)),
m AS (SELECT doc_id, n, pattern, row_number() OVER (PARTITION BY doc_id ORDER BY n, pattern) AS place, count(*) OVER (PARTITION BY doc_id) AS hits FROM c WHERE regexp_matches(text, '(?i)' || pattern))
SELECT doc_id, n AS rule, pattern, hits::BIGINT AS hits FROM m WHERE place = 1""")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts against a table of rules, here the beginnings of turns and benchmark items: the first that occurs and how many do."""
    part = lambda k: F.regexp_extract("text", _WORDS, k)
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("n"), *[part(k).alias(f"w{k}") for k in (1, 2, 3)])
    items = table(spark, sf_dir, "benchmark").select((F.lit(1_000_000) + F.col("item_id")).cast("long").alias("n"), *[part(k).alias(f"w{k}") for k in (1, 2, 3)])
    made = F.concat("w1", F.lit("[ ,.\\n]+"), "w2", F.lit(".{0,20}"), "w3")
    rules = turns.unionByName(items).where("w1 <> ''").select("n", made.alias("pattern"))
    # rules that have one pattern occur together
    kinds = rules.groupBy("pattern").agg(F.min("n").alias("n"), F.count_distinct("n").alias("rules"))
    hit = I.matches(spread(table(spark, sf_dir, "documents")), kinds, "doc_id", "text")
    out = hit.groupBy("doc_id").agg(F.min(F.struct("n", "pattern")).alias("first"), F.sum("rules").alias("hits"))
    return out.select("doc_id", F.col("first.n").alias("rule"), "first.pattern", "hits")


_KINDS = (*R.PREVENTION, "other")


@query(f"""WITH e AS (SELECT {_pick_sql(_KINDS, 'user_id % 8')} AS category, value FROM events WHERE event_type = 'error'), r(category, rule, action, triggers) AS (VALUES {', '.join(f"({sql_text(k)}, {sql_text(n)}, {sql_text(a)}, {sql_text(','.join(dict.fromkeys(t)))})" for k, (n, a, t) in R.PREVENTION.items())})
SELECT r.category, rule, action, triggers, count(*) AS n FROM e JOIN r ON e.category = r.category GROUP BY ALL HAVING count(*) >= 3""")
def prevention_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: rules against the kinds of error that were seen three times."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    kinds = e.select(F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("user_id") % 8 + 1).cast("int")).alias("category"))
    return R.prevention_rules(kinds, "category").withColumn("triggers", F.array_join("triggers", ","))


@query("SELECT lang, count(*) AS n FROM documents WHERE length(text) > 200 GROUP BY 1")
def staged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5, H6, H7: stages that are plugins, one disabled and one of them deep only, for a goal that one engine covers."""
    plugins = R.Plugins({"long": {"config": {"least": 200}}, "never": {"enabled": False}})
    plugins.add("long", lambda config: lambda df: df.where(F.length("text") > config["least"]))
    plugins.add("never", lambda config: lambda df: df.limit(0))
    loaded, _ = plugins.load()
    stages = R.Stages()
    for name, run in loaded.items():
        stages.add(name, run, "shallow")
    stages.add("costly", lambda df: df.limit(0))
    engines = R.Engines()
    engines.add("lengths", ["documents"], ["lengths"], lambda df: df.select(F.length("text")))
    engines.add("languages", ["documents"], ["counts", "languages"], lambda df: stages.run(df, "shallow")[0].groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    outputs, _ = engines.run(table(spark, sf_dir, "documents"), ["counts"], ["lengths", "languages"])
    return outputs["counts"]
