"""Answers held against a form, their numbers against materials, their parts against a list; depth of thought, signals, progress.

Every operator is an expression on one row, without a shuffle or a UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.regex import java
from quern.operators.rules import Match, any_literal, any_of

# The six blocks of an answer, as (name, head, what ends it).
BLOCKS = (
    ("conclusion", "【结论】", "【依据】"),
    ("basis", "【依据】", "【拆解】"),
    ("breakdown", "【拆解】", "【行动】"),
    ("action", "【行动】", "【缺口】"),
    ("gap", "【缺口】", "【自评】"),
    ("self_eval", "【自评】", "[自检"),
)
# Words that stand for nothing, that hedge, that cannot be checked; what an answer says of itself.
PLACEHOLDER = r"^(无|空|—|-|待补充|待补|无内容|N\/A|none|null)$"
HEDGE_WORDS = ("可能", "大概率", "在一定程度上", "持续关注", "有待观察", "需要关注", "或许", "能是")
WEAK_VERBS = ("加强", "优化", "提升", "推进", "深化", "赋能", "完善", "打造")
DECLARED_CITATIONS = r"自检A\]\s*(?:【依据】)?引用条数：(\d+)"
DECLARED_FILLED = r"自检B\]\s*【缺口】与【自评】非空：(是|否)"
DECLARED_ITEMS = r"自检C\]\s*【行动】条数：(\d+)、四要素齐全：(是|否)"
MIN_CITATIONS = 3
MIN_ROWS = 1

# Numbers and their units in materials and in answers; words ahead of a number, and units behind it, that
# make it a claim about the world; what makes it a date or a span; how far is looked.
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
MATERIAL_UNITS = r"%|％|万亿|亿美元|亿|万|元|个百分点|百分点|pp"
CLAIM_WORDS = (
    "市场规模", "市场总额", "行业规模", "行业体量", "赛道规模", "大盘", "行业总量", "行业增速", "行业增幅", "复合增长", "年复合", "年率增长", "渗透率", "市占率", "市场占有率", "市场份额",
    "据统计", "数据显示", "报告显示", "公开数据", "公开资料", "据公开", "据艾瑞", "据欧睿", "预计", "预估至", "预估到", "预计到", "该类目", "该品类", "这个品类", "本行业", "此赛道",
)
MAGNITUDES = ("万亿", "亿美元", "亿元", "万亿美元", "亿片", "亿人", "亿件", "亿台", "万亿元")
NO_CLAIM = (r"^\d{4}\s*[-/年]\s*\d{1,2}", r"^\d{1,2}\s*[-/月]\s*\d{1,2}", r"^\d+\s*(天|周|个月内|个季度)")
PERCENT_UNITS = ("%", "个百分点", "百分点", "pp")
SCALES = (("亿", 1e8), ("万", 1e4), ("万亿", 1e12))
AHEAD, BEHIND, DATE_SPAN = 10, 40, 30

# Signs of a hard question, as (weight, patterns); of an open one; of missing context; of a story.
COMPLEXITY = (
    (2.0, (r"为什么|原因|原理|机制|本质", r"比较|对比|区别|优劣|权衡", r"如果|假设|假如|假想", r"预测|未来|趋势|走向", r"设计|架构|方案|规划", r"伦理|道德|价值观", r"分析|评估|评价|批判", r"系统|框架|体系")),
    (1.0, (r"如何|怎么|怎样", r"解释|说明|描述", r"建议|推荐|选择", r"问题|bug|错误|异常", r"优化|改进|提升", r"证明|论证|推导")),
    (-0.5, (r"是什么|定义|概念", r"多少|数字|数量", r"对错|对不对|是否", r"确认|验证|检查", r"有没有|在不在")),
)
AMBIGUITY = (r"大概|可能|也许|或许", r"或者|还是|或是", r"一般|通常|有时候", r"根据情况|看情况", r"某种程度|某种意义上")
INCOMPLETE = (r"如果.*就", r"假设.*会", r"缺少|没有.*信息", r"不知道|不清楚", r"给我[^。]*\z")
CONDITIONS = r"如果|当|假如|要是"
OPEN_QUESTIONS = (r"你觉得|你认为|你感觉|你觉得呢|你的看法", r"将来|未来|以后|会怎样|会变成", r"怎么样|怎么看|如何看|什么看法|有何见解")
STORY = (
    r"分享|经历|故事|体验|感受|感觉", r"失去|离别|去世|离去|走[了]?", r"人生|命运|意义|存在|世界", r"回忆|记忆|梦见|梦", r"年少|年轻时候|以前|曾经|那时候", r"最后[一]?次|第一次",
    r"幸福|痛苦|悲伤|孤独|温暖|感动", r"陪伴|拥抱|握[着住]?|依偎", r"想?说[说]?|告诉[你我]?|听[我他]?说", r"谢谢|对不起|原谅|抱歉|没事", r"不重要|无所谓|算了|罢了", r"还[好行]|就这样|就这样吧",
)
ERAS = r"以前|后来|之后|那时候|现在|如今|这些[年天月]"
FEELINGS = r"难过|开心|痛苦|幸福|孤独|愤怒|害怕|焦虑|感动|委屈|失望|期待|温暖|悲伤"
STORY_STEP, STORY_FROM, DEEP_STORY_FROM = 0.12, 0.3, 0.55
#: Depths 1 to 4 end at these composite scores.
DEPTH_BOUNDS = (0.2, 0.4, 0.65)
TYPE_DEPTHS = {"judgment": 4, "explanation": 3, "creative": 3, "calculation": 2, "retrieval": 1, "general": 2}
SENTENCE_BREAK = r"[。！？.!?\n]"
BLANKS = " \t\r\n　 "

# Where a signal comes from; lessons as (lesson, patterns that all hold, the part that lacks something).
SIGNAL_SOURCES = (("news", r"据|报道|消息|突发|官方|通报|央视|澎湃|新华|网传"), ("instruction", r"帮我|请|写个|生成|分析一下|怎么做|如何|能不能"), ("feedback", r"不对|错了|应该|你没|为什么|建议|其实|但是"))
LESSONS = (
    ("weak_signal_escalation", (r"落石|预警|征兆|早期|微小|零星|小(信号|问题|异常)|隐患|苗头|前兆", r"(崩塌|垮塌|灾难|事故|爆发|扩大|恶化|严重后果|失败)"), "self-scanner + evolution-loop"),
    ("repeated_signal_ignored", (r"多次|反复|一直|长期|一直(未|没)|视而不见|忽视|未重视|没重视|总是|每次都",), "self-scanner + evolution-loop"),
    ("missed_window", (r"错失|错过|滞后|延迟|反应慢|来不及|窗口|过期|太晚",), "evolution-loop"),
    ("user_correction", (r"不对|错了|你没|没理解|其实是|你应该|为什么(不|没)",), "response-optimizer"),
    ("capability_gap_request", (r"帮我(写|做|生成|分析|算|查)|能不能.*(写|做|生成|分析)|实现.*功能",), "capability-registry"),
    ("chronic_error_undetected", (r"(误(登|记|录|判)|冒名|错登|录入错误|数据(错误|有误))", r"(长期|多年|一直|7年|数年|才(发现|核查|更正|纠正)|申诉后|投诉后)"), "self-heal + memory"),
    ("external_standard_emergence", (r"(规则|标准|规范|治理|规定|协议|框架)(落地|发布|出台|生效|即将|拟)|(首个|全球首|国际)(.*)(规则|标准|规范)",), "capability-registry + evolution-loop"),
)
OTHER_LESSON, OTHER_PART = "generic", "signal-absorber"
#: What is done for a part that lacks something; both parts with a loop in them get its two measures.
MEASURES = {
    "self-scanner + evolution-loop": ("count_recurrences", "escalate_overdue"),
    "evolution-loop": ("count_recurrences", "escalate_overdue"),
    "capability-registry + evolution-loop": ("count_recurrences", "escalate_overdue"),
    "response-optimizer": ("remember_corrections",),
    "capability-registry": ("register_request",),
    "self-heal + memory": ("review_periodically",),
    "signal-absorber": ("store_signal",),
}

# Words of progress and of what only looks like it, as (kind, words, words that clear it).
FEWER_ERRORS, NAMES_TRUTH = r"更正确|更准确|减少错误|改进|优化", r"正确|准确"
UNTRUE, HANDED_ON = r"幻觉|虚构|假装", r"记录|传递|文档|分享|写下来"
PSEUDO_PROGRESS = (
    ("surface", r"更强大|更大|更快|更复杂", r"错误|准确|正确"),
    ("obedience", r"更听话|更符合|更对齐", r"知识|学习|进步"),
    ("decoration", r"更好看|更美观|更好", r"质量|功能|性能"),
    ("illusion", r"更好|更强|更优秀", r"测量|验证|证据"),
)
CLAIM_VALUES = ((r"更正确|更准确", 0.2), (r"传递|分享|记录", 0.15), (r"知识|学习|理解", 0.15))
NO_JUDGEMENT = r"你说了算|你说啥是啥|无所谓|都可以"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _when(c: Column, weight: float) -> Column:
    return F.when(c, F.lit(float(weight))).otherwise(F.lit(0.0))


def _once(fields: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """``f`` of the fields, each computed once: a plain expression is copied to every place that uses it, a lambda's argument is not."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in fields.items()])), f), 0)


def _percent(passed: Column, of: Column) -> Column:
    return F.when(of == 0, F.lit(0)).otherwise(F.floor(passed * 100 / F.greatest(of, F.lit(1)) + 0.5)).cast("int")


def block(answer: Column, name: str) -> Column:
    """A block of an answer without blanks around it; empty if its head is missing."""
    _, head, end = next(b for b in BLOCKS if b[0] == name)
    rest = F.get(F.split(_text(answer), head, 2), 1)
    return _text(F.btrim(F.substring_index(rest, end, 1), F.lit(BLANKS)))


def _empty(block_text: Column) -> Column:
    return (block_text == "") | block_text.rlike("(?i)" + PLACEHOLDER)


def action_items(action: Column) -> Column:
    """The parts of each line with a slash: who, until when, measure, proof."""
    lines = F.filter(F.transform(F.split(action, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x.contains("/"))
    return F.transform(lines, lambda x: F.transform(F.split(x, "/"), lambda y: F.btrim(y, F.lit(BLANKS))))


def acceptance(answer: Column, known_ids: Column | None = None, min_citations: int = MIN_CITATIONS, min_rows: int = MIN_ROWS, most_items: int = 0) -> Column:
    """(passed, score, most, percent, failed) of an answer in six blocks: ``failed`` names the checks that do not hold.

    Checks of cited ids (``known_ids``, an array; null or empty: none) and of the number of
    items (``most_items``; 0: any) are made only if asked for. A null answer is an empty one.
    """
    t = _text(answer)
    declared = {f"said{i}": F.regexp_extract(t, java(p), 1) for i, p in enumerate((DECLARED_CITATIONS, DECLARED_FILLED, DECLARED_ITEMS))}
    given = {"known": known_ids} if known_ids is not None else {}

    def parse(b: Column) -> Column:
        fields = {
            "b": b,
            "cited": F.regexp_extract_all(b["basis"], F.lit(r"(M\d+)"), 1),
            "rows": F.size(F.filter(F.split(b["breakdown"], "\n"), lambda x: x.rlike(r"\|[\s\S]*\|") & x.rlike(r"\d"))),
            "items": action_items(b["action"]),
        }
        return _once(fields, lambda x: _form(x, known_ids is not None, min_citations, min_rows, most_items))

    return _once({name: block(t, name) for name, _, _ in BLOCKS} | declared | given, parse)


def _form(x: Column, ids_known: bool, min_citations: int, min_rows: int, most_items: int) -> Column:
    b, cited, items = x["b"], x["cited"], x["items"]
    said = [b[f"said{i}"] for i in range(3)]
    whole = F.size(F.filter(items, lambda p: (F.size(p) >= 4) & F.get(p, F.lit(1)).rlike(r"\d")))
    filled = ~_empty(b["gap"]) & ~_empty(b["self_eval"])
    honest = (
        ((said[0] == "") | (said[0].try_cast("long") == F.size(cited)))
        & ((said[1] == "") | ((said[1] == "是") == filled))
        & ((said[2] == "") | (said[2].try_cast("long") == F.size(items)))
    )
    checks: list[tuple[str, Column]] = [
        ("blocks", reduce(lambda p, q: p & q, [b[name] != "" for name, _, _ in BLOCKS])),
        ("citations", F.size(cited) >= min_citations),
        ("rows", x["rows"] >= min_rows),
        ("four_parts", (F.size(items) > 0) & (whole == F.size(items))),
        ("items", F.size(items) > 0),
        ("gap", ~_empty(b["gap"])),
        ("self_eval", ~_empty(b["self_eval"])),
        ("hedge", ~any_literal(*HEDGE_WORDS).column(b["conclusion"])),
        ("weak_verb", ~any_literal(*WEAK_VERBS).column(b["action"])),
        ("declaration", ~((said[0] == "") & (said[1] == "") & (said[2] == "")) & F.coalesce(honest, F.lit(False))),
    ]
    if most_items > 0:
        checks.insert(5, ("overload", F.size(items) <= most_items))
    count, failed = F.lit(len(checks)), F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks])
    if ids_known:
        asked = F.coalesce(F.size(b["known"]), F.lit(0)) > 0
        failed = F.concat(failed, F.array(F.when(asked & (F.size(F.array_except(cited, b["known"])) > 0), F.lit("citation_ids"))))
        count = count + asked.cast("int")

    def counted(y: Column) -> Column:
        passed = y["count"] - F.size(y["failed"])
        return F.struct(
            (F.size(y["failed"]) == 0).alias("passed"), passed.alias("score"), y["count"].alias("most"), _percent(passed, y["count"]).alias("percent"), F.array_join(y["failed"], ",").alias("failed")
        )

    return _once({"failed": F.filter(failed, lambda n: n.isNotNull()), "count": count}, counted)


def material_numbers(materials: Column) -> Column:
    """The distinct values of all numbers with a unit in an array of texts, and what 万, 亿 and 万亿 make of them."""

    def values(t: Column) -> Column:
        amounts = F.transform(F.regexp_extract_all(t, F.lit(f"({NUMBER})\\s*({MATERIAL_UNITS})"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
        units = F.regexp_extract_all(t, F.lit(f"({NUMBER})\\s*({MATERIAL_UNITS})"), 2)
        scaled = F.lit(None).cast("double")
        pairs = F.arrays_zip(amounts.alias("v"), units.alias("u"))
        return F.flatten(F.transform(pairs, lambda p: F.array(p["v"], reduce(lambda a, s: F.when(p["u"] == s[0], p["v"] * s[1]).otherwise(a), SCALES, scaled))))

    given = F.filter(materials, lambda t: t.isNotNull())
    found = F.flatten(F.transform(given, values))
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull()))


def foreign_numbers(answer: Column, allowed: Column) -> Column:
    """(ok, matched, skipped, outside) of the numbers in an answer that claim something about the world.

    ``allowed`` are the values that the materials give. Numbers are compared by value, so
    12.40 is 12.4. Numbers without a claim, of dates, spans and material ids, are skipped.
    A number needs ten pieces before it and forty behind it at most for its surroundings,
    since each piece but the first begins with a digit: the work is linear in the text.
    """
    mark = "\x01"
    cut = F.split(F.regexp_replace(F.replace(_text(answer), F.lit(mark), F.lit(" ")), f"({NUMBER})", f"{mark}$1"), mark, -1)
    return _once({"cut": cut, "allowed": allowed}, lambda x: _once({"found": _numbers(x["cut"]), "allowed": x["allowed"]}, lambda y: _judged(y["found"], y["allowed"])))


def _numbers(cut: Column) -> Column:
    """(v, u, text, large, claim) of each number; ``cut`` is the text cut ahead of every number."""
    claims, magnitudes, dates = any_literal(*CLAIM_WORDS), any_literal(*MAGNITUDES), any_of(*NO_CLAIM)

    def read(k: Column) -> Column:
        around = {
            "own": F.element_at(cut, k + 1),
            "before": F.right(F.array_join(F.slice(cut, F.greatest(F.lit(1), k - AHEAD), F.least(k, F.lit(AHEAD + 1))), ""), F.lit(AHEAD)),
            "behind": F.left(F.array_join(F.slice(cut, k + 1, F.lit(BEHIND)), ""), F.lit(BEHIND)),
        }
        return _once(around, number)

    def number(x: Column) -> Column:
        raw = F.replace(F.regexp_extract(x["own"], f"^({NUMBER})", 1), F.lit(","), F.lit(""))
        unit = F.replace(F.regexp_extract(x["own"], f"^(?:{NUMBER})\\s*({MATERIAL_UNITS})", 1), F.lit("％"), F.lit("%"))
        large = magnitudes.column(x["behind"])
        claim = ~F.right(x["before"], F.lit(1)).isin("M", "m") & (claims.column(x["before"]) | large) & ~dates.column(F.left(x["behind"], F.lit(DATE_SPAN)))
        return F.struct(raw.cast("double").alias("v"), unit.alias("u"), F.concat(raw, unit).alias("text"), large.alias("large"), claim.alias("claim"))

    none = F.expr("cast(array() as array<struct<v:double,u:string,text:string,large:boolean,claim:boolean>>)")
    return F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(1), F.size(cut) - 1), read)).otherwise(none)


def _judged(found: Column, allowed: Column) -> Column:
    def held(x: Column) -> Column:
        has = lambda v: F.array_contains(allowed, v)
        return has(x["v"]) | (x["u"].isin(*PERCENT_UNITS) & has(x["v"] / 100)) | (x["large"] & (x["u"] == "亿") & has(x["v"] * 1e4)) | (x["large"] & (x["u"] == "万") & has(x["v"] / 1e4))

    def counted(y: Column) -> Column:
        n_outside, n_claimed = F.size(y["outside"]), F.size(y["claimed"])
        return F.struct((n_outside == 0).alias("ok"), (n_claimed - n_outside).alias("matched"), (F.size(found) - n_claimed).alias("skipped"), y["outside"].alias("outside"))

    claimed = F.filter(found, lambda x: x["claim"])
    return _once({"claimed": claimed, "outside": F.transform(F.filter(claimed, lambda x: ~held(x)), lambda x: x["text"])}, counted)


def deliverables(answer: Column, required: tuple[str, ...] = (), any_of_each: tuple[tuple[str, ...], ...] = (), counts: dict[str, int] | None = None) -> Column:
    """(passed, score, most, percent, missing): what an answer must hold, one of each group, and words often enough."""
    t = _text(answer)
    rows = [(w, t.contains(F.lit(w))) for w in required]
    rows += [("|".join(g), reduce(lambda a, b: a | b, [t.contains(F.lit(w)) for w in g], F.lit(False))) for g in any_of_each]
    rows += [(f"{w}x{n}", F.size(F.split(t, _quoted(w), -1)) - 1 >= n) for w, n in (counts or {}).items()]
    missing = F.filter(F.array(*[F.when(~ok, F.lit(w)) for w, ok in rows]), lambda x: x.isNotNull()) if rows else F.expr("cast(array() as array<string>)")
    passed = F.lit(len(rows)) - F.size(missing)
    return F.struct((F.size(missing) == 0).alias("passed"), passed.alias("score"), F.lit(len(rows)).alias("most"), _percent(passed, F.lit(len(rows))).alias("percent"), missing.alias("missing"))


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in word)


def evaluation(form: Column, numbers: Column, parts: Column, gate_action: Column) -> Column:
    """(verdict, failures): an answer passes if its form, its numbers and its parts do and the gate neither blocks nor rewrites; scores are not added up."""
    failures = F.filter(
        F.array(
            F.when(~form["passed"], "form"),
            F.when(~numbers["ok"], "numbers"),
            F.when(~parts["passed"], "deliverables"),
            F.when(gate_action.isin("block", "rewrite"), "gate"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.struct(F.when(F.size(failures) == 0, "PASS").otherwise("FAIL").alias("verdict"), F.array_join(failures, ",").alias("failures"))


def _depth(score: Column) -> Column:
    low, middle, high = DEPTH_BOUNDS
    return F.when(score <= low, 1).when(score <= middle, 2).when(score <= high, 3).otherwise(4)


def deliberation(text: Column) -> Column:
    """(depth, pause, fast_exit, complexity, missing, uncertainty, story, composite) of a question; blank texts have depth 1."""
    t = _text(text)
    size = F.length(t)
    has = lambda p: Match(p).column(t)
    count = lambda p: F.regexp_count(t, F.lit(p))
    seen = {
        "vague": F.array(*[has(p) for p in AMBIGUITY]),
        "asked": count("[？?]"),
        "own": count("我"),
        "felt": count(FEELINGS),
        "sentences": F.size(F.filter(F.split(t, SENTENCE_BREAK), lambda s: F.length(F.btrim(s, F.lit(BLANKS))) > 5)),
        "ends": count("[。.!！\n]"),
        "conditions": count(CONDITIONS),
    }

    def parts(x: Column) -> Column:
        vague = [x["vague"][i] for i in range(len(AMBIGUITY))]
        marks = [_when(has(p), w) for w, ps in COMPLEXITY for p in ps] + [_when(v, 1) for v in vague]
        marks += [_when(size > 200, 1), _when(size > 500, 1.5), _when(x["asked"] >= 3, 1), _when(x["asked"] >= 6, 1.5), _when(x["ends"] >= 5, 1)]
        lacks = [_when(has(p), 1) for p in INCOMPLETE] + [_when((size < 100) & ~t.rlike(r"\d"), 1), x["conditions"] * 0.5]
        unsure = [_when(v, 0.5) for v in vague] + [_when(has(p), 1) for p in OPEN_QUESTIONS]
        told = [_when(has(p), STORY_STEP) for p in STORY] + [_when(size > 150, 0.1), _when(size > 400, 0.15), _when(x["own"] >= 3, 0.1), _when(x["own"] >= 8, 0.15)]
        told += [_when(x["sentences"] >= 5, 0.1), _when(x["sentences"] >= 10, 0.2), _when(has(ERAS), 0.1), _when(x["felt"] >= 2, 0.1), _when(x["felt"] >= 5, 0.15)]
        one = F.lit(1.0)
        scores = {"complexity": F.greatest(F.lit(0.0), _sum(marks)), "missing": F.least(one, _sum(lacks) / 5), "uncertainty": F.least(one, _sum(unsure) / 4), "story": F.least(one, _sum(told))}
        return _once(scores, composed)

    def composed(x: Column) -> Column:
        score = x["complexity"] / 10 * 0.5 + x["missing"] * 0.25 + x["uncertainty"] * 0.25 + F.when(x["story"] >= STORY_FROM, x["story"] * 0.3).otherwise(0.0)
        return _once({"x": x, "composite": score, "depth": _depth(score)}, lambda y: fields(y["depth"], y["composite"], y["x"]))

    def fields(depth: Column, composite: Column, x: Column) -> Column:
        quick = (x["story"] < DEEP_STORY_FROM) & (depth <= 2) & (x["uncertainty"] < 0.3)
        scores = [x[k].alias(k) for k in ("complexity", "missing", "uncertainty", "story")]
        return F.struct(depth.alias("depth"), (depth >= 3).alias("pause"), quick.alias("fast_exit"), *scores, composite.alias("composite"))

    zeros = [F.lit(0.0).alias(k) for k in ("complexity", "missing", "uncertainty", "story", "composite")]
    nothing = F.struct(F.lit(1).alias("depth"), F.lit(False).alias("pause"), F.lit(False).alias("fast_exit"), *zeros)
    return F.when(F.btrim(t, F.lit(BLANKS)) == "", nothing).otherwise(_once(seen, parts))


def deepened(depth: Column, n_variables: Column, n_constraints: Column, kind: Column) -> Column:
    """The depth of a question once it is parsed: many variables or constraints, or its kind, ask for more."""
    by_kind = reduce(lambda a, k: F.when(kind == k[0], F.lit(k[1])).otherwise(a), TYPE_DEPTHS.items(), F.lit(1))
    n, c = F.coalesce(n_variables, F.lit(0)), F.coalesce(n_constraints, F.lit(0))
    return F.greatest(depth, F.when(n > 5, 4).when(n > 3, 3).otherwise(1), F.when(c > 2, 3).otherwise(1), by_kind)


def absorbed(text: Column) -> Column:
    """(source, lessons, parts, measures) of a signal; null for a blank one. Parts follow their lessons, measures are distinct."""
    t = _text(text)
    source = reduce(lambda a, s: F.when(Match(s[1]).column(t), s[0]).otherwise(a), reversed(SIGNAL_SOURCES), F.lit("dialogue"))
    hits = [reduce(lambda a, b: a & b, [Match(p).column(t) for p in ps]) for _, ps, _ in LESSONS]

    def learnt(x: Column) -> Column:
        held = lambda of: F.filter(F.array(*[F.when(x["hits"][k], of(name, part)) for k, (name, _, part) in enumerate(LESSONS)]), lambda y: y.isNotNull())
        rest = lambda found, other: F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)
        todo = F.flatten(held(lambda name, part: F.array(*[F.lit(m) for m in MEASURES[part]])))
        return F.struct(
            x["source"].alias("source"),
            rest(held(lambda name, part: F.lit(name)), OTHER_LESSON).alias("lessons"),
            rest(held(lambda name, part: F.lit(part)), OTHER_PART).alias("parts"),
            F.array_distinct(rest(todo, MEASURES[OTHER_PART][0])).alias("measures"),
        )

    return F.when(F.btrim(t, F.lit(BLANKS)) != "", _once({"source": source, "hits": F.array(*hits)}, learnt))


def progress(action: Column, claim: Column, evidence: Column, intent: Column) -> Column:
    """(progress, confidence, failures, pseudo, value, fewer_errors, handed_on) of an action that is claimed to be progress; null is empty.

    The last two are reported alone: they do not decide.
    """
    return _once({"a": _text(action), "c": _text(claim), "e": _text(evidence), "i": _text(intent)}, lambda x: _progress(x["a"], x["c"], x["e"], x["i"]))


def _progress(a: Column, c: Column, e: Column, i: Column) -> Column:
    either = lambda p: Match(p).column(a) | Match(p).column(c)
    unverified, untrue = (e == "") & (c != ""), either(UNTRUE)
    both = F.lower(F.concat(a, F.lit(" "), c))
    looks = [F.when(Match(p).column(both) & ~Match(clear).column(both), F.lit(kind)) for kind, p, clear in PSEUDO_PROGRESS]
    pseudo = F.filter(F.array(*looks), lambda x: x.isNotNull())
    failures = F.filter(F.array(F.when(unverified, "verifiability"), F.when(untrue, "truth")), lambda x: x.isNotNull())
    value = F.lit(0.5) + _sum(_when(Match(p).column(c), w) for p, w in CLAIM_VALUES) - _when(Match(NO_JUDGEMENT).column(i), 0.1)

    def judged(x: Column) -> Column:
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["value"]))
        sound, real = F.size(x["failures"]) == 0, F.size(x["pseudo"]) == 0
        return F.struct(
            (sound & real & (x["value"] >= 0.5)).alias("progress"),
            F.least(F.lit(1.0), 0.5 + _when(sound, 0.2) + _when(real, 0.15) + clamped * 0.15).alias("confidence"),
            F.array_join(x["failures"], ",").alias("failures"),
            F.array_join(x["pseudo"], ",").alias("pseudo"),
            clamped.alias("value"),
            ((c == "") | either(FEWER_ERRORS) | ~Match(NAMES_TRUTH).column(c)).alias("fewer_errors"),
            ((c == "") | Match(HANDED_ON).column(a)).alias("handed_on"),
        )

    return _once({"failures": failures, "pseudo": pseudo, "value": value}, judged)
