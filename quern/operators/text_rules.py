"""Rule operators on texts and small structs beyond the argument detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.regex import count_matches, has_cjk, java, needs_cjk
from quern.functions.scalars import sentences
from quern.operators.detectors import FRAMES_EN, FRAMES_ZH
from quern.operators.judgement import windows
from quern.operators.rules import Expr, Match, Some, any_literal, any_of
from quern.operators.screen import current, literals


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _n(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


# -- frames and premises ----------------------------------------------------------------


def frame_severities(text: Column) -> Column:
    """Severities of closed frames, most severe first."""
    rows = lambda rules, ic: F.array_compact(F.array(*[F.when(Match(p, ic).column(text), s) for p, s in rules]))
    return F.sort_array(F.when(has_cjk(text), rows(FRAMES_ZH, False)).otherwise(rows(FRAMES_EN, True)), asc=False)


def frame_action(severities: Column) -> Column:
    most = F.coalesce(F.array_max(severities), F.lit(0))
    n = F.size(severities)
    return F.when(most >= 60, "rewrite").when((n >= 2) | ((n == 1) & (most >= 40)), "hedge").otherwise("pass")


# Premise patterns as (kind, severity, every match counts, patterns in Chinese, patterns in English).
PREMISES = (
    ("false_fact", 0.7, True, ("[^，。]{2,30}(是不争的事实|是公认的|是常识|大家都知道|众所周知|不言而喻)[^，。]{0,20}", "[^，。]{2,30}明明[^，。]{10,50}", "[^，。]{2,30}本来(就|是)[^，。]{10,50}"), (r"\bit['']s (a fact|well-known|common knowledge|no secret|undeniable)\b[^.]*", r"\b(as everyone knows|as we all know|it is obvious that)\b[^.]*")),
    ("binary", 0.6, False, ("不是[^，。]{2,20}就是[^，。]{2,20}", "要么[^，。]{2,20}要么[^，。]{2,20}", "[^，。]{2,20}(唯一|只有).{0,5}(选择|路|方案|方法|方式)[^，。]{2,20}"), (r"\b(either|or)\b.{5,50}\b(or|either)\b", r"\b(the only (way|option|choice|solution))\b[^.]*")),
    ("presupposition", 0.5, True, ("(为什么|为何)([^，。？?]{1,15})不([^，。？?]{2,15})", "(难道|莫非)[^，。]{10,50}[吗？?]", "(什么时候|何时)[^，。]{2,20}才[^，。]{10,50}", "(怎么|如何)[^，。]{2,20}还(不|没)[^，。]{10,50}"), (r"\bwhy (don'?t|didn'?t|haven'?t|aren'?t|isn'?t)\b[^?]*\?", r"\b(how could you|how can you)\b[^?]*\?")),
    ("causal", 0.5, True, ("因为[^，。]{5,30}[，。].{0,10}(所以|因此|于是)[^，。]{5,30}", "[^，。]{5,30}(导致|造成|引发)[^，。]{5,30}"), (r"\bbecause\b.{10,40}\b(therefore|thus|so)\b",)),
    ("analogy", 0.4, False, ("(就像|好比|如同|类似于).{5,30}(一样|那样|般)", "[^，。]{5,30}和[^，。]{5,30}(没什么区别|是一回事|一样)"), (r"\b(just like|similar to|analogous to|the same as)\b.{10,50}",)),
    ("scope", 0.5, True, ("所有[^，。]{2,20}都[^，。]{5,30}", "任何[^，。]{2,20}都[^，。]{5,30}", "[^，。]{2,20}没有一(个|位|种)[^，。]{2,20}不[^，。]{5,30}"), (r"\ball\b.{5,30}\bare\b.{5,30}", r"\b(no|none|nobody|nothing|never)\b.{5,40}\b(every|all|always)\b")),
)


def premises(text: Column) -> dict[str, Column]:
    """Premises by kind, and how many are severe (0.6 and more)."""
    out = {}
    for kind, _, every, zh, en in PREMISES:
        one = lambda p, ic: count_matches(text, p, ic) if every else F.when(Match(p, ic).column(text), 1).otherwise(0)  # noqa: B023, E731
        out[kind] = F.coalesce(F.when(has_cjk(text), _sum(one(p, False) for p in zh)).otherwise(_sum(one(p, True) for p in en)), F.lit(0))
    out["high_severity"] = _sum(out[k] for k, s, _, _, _ in PREMISES if s >= 0.6)
    return out


# -- code texts -------------------------------------------------------------------------

# Calls that need a plan first.
FORBIDDEN_CALLS = (("delegate_unknown", r"delegate_task\s*\("), ("subagent", r"subagent\s*\("), ("agent_spawn", r"agent\s+spawn|spawn\s+agent"), ("auto_delegate", r"auto\s*delegate|auto_delegat"))
SYMMETRIC = (("create", "delete"), ("start", "stop"), ("open", "close"), ("init", "destroy"), ("add", "remove"), ("push", "pop"), ("encode", "decode"), ("encrypt", "decrypt"), ("write", "read"), ("acquire", "release"), ("lock", "unlock"), ("begin", "end"))
DATA_SHAPES = ("null", "undefined", "empty", "array", "object", "string", "number", "boolean", "NaN", "Infinity")
PROCESSES = r"\b(param|arg|input|data|value|item|obj|json|body|req|res)\b"


def forbidden_call(text: Column) -> tuple[Column, Column]:
    """(count, score)."""
    n = _sum(_n(Match(p, True).column(text)) for _, p in FORBIDDEN_CALLS)
    return n, F.least(F.lit(1.0), n * 0.3)


def coverage_gaps(text: Column) -> Column:
    """Verb pairs of which one is missing, plus one gap if five data shapes are missing from code that handles data."""
    has = lambda w: Match(rf"\b{w}\w*\b", True).column(text)
    pairs = _sum(_n(has(a) != has(b)) for a, b in SYMMETRIC)
    missing = _sum(1 - _n(Match(rf"\b{s}\b", True).column(text)) for s in DATA_SHAPES)
    shapes = _n(Match(PROCESSES, True).column(text) & (missing >= 5))
    branch = _n(text.rlike(r"if\s*\([^)]+\)\s*\{[^}]*return[^}]*\}(?![\s\S]{0,80}?\}\s*else\s*\{)(?!\s*else\s*\{)"))
    swallowed = _n(F.regexp_count(text, F.lit(r"catch\s*\([^)]*\)\s*\{\s*\}")) > 2)
    return pairs + shapes + branch + swallowed


# Habits of generated code by family, with the severity of the family.
CODE_HABITS = (
    ("over_engineering", 0.6, True, ("抽象工厂模式|策略模式|单例模式|观察者模式|适配器模式|装饰器模式|代理模式|门面模式|建造者模式|模板方法模式", "为了(未来|扩展|兼容|维护).{0,10}(可能|也许|或许|万一|以后)", "一套完整的.{0,10}(框架|体系|架构|方案|解决方案)", "通用.{0,5}(组件|模块|服务|框架|接口|工具)", "(先抽象|先封装|再扩展|预留扩展点|方便以后)")),
    ("dead_code", 0.6, True, (r"if\s*\(\s*(?:false|0|null|undefined)\s*\)", r"\/\/\s*(?:死代码|永远不会执行|unreachable|dead code)", r"\/\/\s*TODO[：:].{0,20}(删除|移除|清理)", r"\/\/\s*保留.{0,10}(仅供|参考|测试)", r"return\s+undefined\s*;?\s*\/\/\s*(?:占位|placeholder)")),
    ("fake_comment", 0.3, False, (r"\/\/\s*[加增]1", r"\/\/\s*(?:赋值|初始化|声明|定义)", r"\/\/\s*返回.{0,10}(结果|值|数据)", r"\/\/\s*调用.{0,10}(函数|方法|接口)", r"\/\/\s*(?:循环|遍历|迭代).{0,10}(数组|列表|集合)")),
    ("swallow_all", 0.5, False, (r"catch\s*\([^)]*\)\s*\{\s*\}", r"catch\s*\([^)]*\)\s*\{\s*\/\/\s*(?:防御性|ignore|忽略|swallow)", r"catch\s*\([^)]*\)\s*\{\s*console\.(?:log|warn|error)\([^)]*\)\s*;?\s*\}")),
)
MEANINGLESS = r"(?:let|const|var)\s+(tmp|data|info|result|res|obj|item|val|ret|str|num|arr|map|set|dict|params|args|ctx|cfg|conf|opt)\b"


def code_habits(text: Column) -> tuple[Column, Column]:
    """(signals, score): each pattern with its groups is as many signals as it captures, meaningless names one from three on."""
    def captured(p: str, ic: bool) -> Column:
        groups = p.replace(r"\(", "").count("(") - p.replace(r"\(", "").count("(?:")
        hit = Match(p, ic).column(text)
        parts = [F.lit(1)] + [_n(F.regexp_extract(text, ("(?i)" if ic else "") + java(p), g) != "") for g in range(1, groups + 1)]
        return F.when(hit, _sum(parts)).otherwise(0)

    n = _sum(captured(p, ic) for _, _, ic, ps in CODE_HABITS for p in ps) + _n(count_matches(text, MEANINGLESS) >= 3)
    return n, F.least(F.lit(1.0), n * 0.25)


# What the body of a function named so must hold.
NAME_NEEDS = (
    ("validate", r"(check|verify|valid|invalid|schema|format|return\s+(true|false))"), ("parse", r"(JSON\.parse|split|token|syntax)"), ("sanitize", "(trim|replace|escape|strip|clean|encode)"), ("transform", "(map|reduce|convert|translate)"),
    ("handle", "(switch|case|dispatch|route)"), ("calculate", r"(Math\.|compute|formula|eval|sum|avg)"), ("log", r"(console\.|writeFile|append)"), ("retry", "(attempt|backoff|delay|retry|重试|退避)"),
)


def context_free(text: Column, pattern: str, span: int, *saved: str) -> Column:
    """Matches of a pattern, in either case, without any of the saving patterns within ``span`` characters of their begin on either side."""
    found = windows(text, "(?i)" + java(pattern), span, span)
    free = F.filter(found, lambda w: ~_any(w.rlike(f"(?i){java(s)}") for s in saved)) if saved else found
    return F.coalesce(F.size(free), F.lit(0))


# Destructive, sweeping and production words with what saves them.
DESTRUCTIVE = (r"delete\s+table", r"drop\s+table", r"rm\s+-rf", "overwrite", r"rename\s+\w+", r"\bDDL\b", "migrate")
SWEEPING = (r"\bbatch\s+\w+", r"\bbulk\s+\w+", r"\ball\s+\w+")
CONFIRMED = r"confirm|user\s+approval|manual|approval|callback"
BACKED_UP, BACKED_UP_WIDE = r"\.bak|backup|rollback|reverse|undo", r"\.bak|backup|rollback"
COUNTED = r"\d+\s*(?:items?|records?|files?)"
LIVE_SAVED = r"irreversible|manual\s+confirm|rollback"
PRODUCTION = (r"production\s+config", r"\benv\s+\w+", r"\btoken\s*[:=]", r"\b(?:key|secret)\s*[:=]", "credential")


def reversibility(text: Column) -> dict[str, Column]:
    """Destructive words without confirmation or backup near by (0.85), sweeping ones without scope and backup (0.6), and the score."""
    hard = _sum(context_free(text, p, 200, CONFIRMED, BACKED_UP) for p in DESTRUCTIVE)
    scoped = lambda p: context_free(text, p, 150) - _both_near(text, p, 150, COUNTED, BACKED_UP_WIDE)
    wide = _sum(scoped(p) for p in SWEEPING)
    live = _sum(_n(context_free(text, p, 200, LIVE_SAVED) > 0) for p in PRODUCTION)
    n = hard + wide + live
    mean = (hard * 0.85 + wide * 0.6 + live * 0.7) / F.greatest(n, F.lit(1))
    return {"destructive": hard, "sweeping": wide, "production": live, "score": F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - mean))}


def _both_near(text: Column, pattern: str, span: int, *needed: str) -> Column:
    ok = F.filter(windows(text, "(?i)" + java(pattern), span, span), lambda w: reduce(lambda x, y: x & y, [w.rlike(f"(?i){java(s)}") for s in needed]))
    return F.coalesce(F.size(ok), F.lit(0))


# Percentages that are shares of a whole.
SHARE_BEFORE = r"占[比到]?为|占|为|是|达[到了]?|voted|chose|chosen|went to|goes to|accounted for|make[s]? up|split|agreed|disagreed|responded|answered|来自|rest"
SHARE_AFTER = r"的人|的用户|的客户|的受访者|的学生|的预算|的营收|的团队|的成员|voted|chose|agreed|disagreed|abstained|of (?:the|them|respondents|students)|went to|goes to|用于|归于|归入|是|为|rest|选择了|选择|选|投了|投向|来自|归为|支持|反对|赞成|不赞成|中立|赞成者|反对者|remainder|rest"
SHARE_AFTER_WIDE = r"用的人|的用户|用|" + SHARE_AFTER
SHARE_CHANGE = r"增长|下降|提升|降低|同比|环比|从\s*[\d.]+\s*%\s*(?:到|至|升至|降至)|from\s+[\d.]+\s*%\s+to|百分点|percentage points"
SHARE_FREQUENCY = "每天|每周|每月|每年|天天|周周|日活|月活|年活|daily|weekly|monthly|yearly|per day|per week|per month|per year|DAU|MAU"
SHARE_PHASE = r"上半年|下半年|第一季度|第二季度|第三季度|第四季度|第一周|第二周|第一[期阶阶]|第二[期阶段]|Q[1-4]|first half|second half|first quarter|second quarter"
SHARE_PROGRESS = "完成度|进度|已完成|done|completed|progress"
SHARE_RATE = "率|比例|ratio|rate|准确|召回|F1"
FULL_COVER = r"覆盖全部|涵盖全部|包含全部|覆盖了?所有|涵盖所有|覆盖所有|即[即为]全部|就是全部|合计[即就]?为全部|加起来[就是]全部|全部场景|全部来源|全部受访者|全部学员|全部客户|全部人员|全部渠道|全部市场|全部预算|全部学员群体|covering all|covers all|all needs|all respondents|the entirety|entire set|whole population"
PARTIAL_COVER = r"绝大部分|绝大多数|九成|八成|七成|过半|大部分|多数客户|most of|vast majority|nearly all|about \d+% of the|剩余部分|剩下[的\d]"


#: A percentage and how far around it is looked; people of whom some are a share; a place that a share comes from.
PERCENTAGE, SHARE_SPAN = r"\d+(?:\.\d+)?\s*%", 14
SHARE_OF = r"\d+(?:\.\d+)?\s*%\s*of\s+(?:the\s+)?(?:respondents?|students?|users?|people|customers?|participants?|voters?|employees?|members)"
SHARE_FROM = r"from\s+[A-Z一-龥]"
SHARE_RISE = r"上升|下跌|从\s*[\d.]+\s*%\s*(?:升|降)"
LEAST_SHARE_TEXT = 6


def shares(text: Column, after: str, rates: bool) -> Column:
    """Percentages of a whole: those with a word of sharing within fourteen characters on either side, or "of" people.

    The text is cut ahead of every percentage. A piece but the first has two characters
    at least, so its neighbours within ``SHARE_SPAN`` pieces hold all that is looked at.
    """
    ahead, behind = "\x01", "\x02"
    cut = F.split(F.regexp_replace(F.translate(text, ahead + behind, "  "), f"({java(PERCENTAGE)})", f"{ahead}$1{behind}"), ahead, -1)
    of = Match(SHARE_OF, True).column(text)

    def read(pieces: Column, k: Column) -> Column:
        whole = lambda part: F.replace(F.array_join(part, ""), F.lit(behind), F.lit(""))
        before = F.right(whole(F.slice(pieces, F.greatest(F.lit(1), k - SHARE_SPAN + 1), F.least(k, F.lit(SHARE_SPAN)))), F.lit(SHARE_SPAN))
        rest = F.element_at(F.split(F.element_at(pieces, k + 1), behind, 2), 2)
        follow = F.left(F.concat(rest, whole(F.slice(pieces, k + 2, F.lit(SHARE_SPAN)))), F.lit(SHARE_SPAN))
        return F.struct(F.regexp_extract(F.element_at(pieces, k + 1), r"^(\d+(?:\.\d+)?)", 1).cast("double").alias("v"), before.alias("b"), follow.alias("a"))

    def keep(r: Column) -> Column:
        held = Match(SHARE_BEFORE, True).column(r["b"]) | Match(after, True).column(r["a"]) | (of & r["a"].rlike(java(r"^\s*of\b")))
        if not rates:
            return held
        return (held | r["a"].rlike(java(SHARE_FROM))) & ~(r["b"].rlike(SHARE_RATE) | r["a"].rlike(SHARE_RATE))

    every = lambda pieces: F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: read(pieces, k))
    found = F.get(F.transform(F.array(cut), lambda pieces: F.when(F.size(pieces) > 1, F.transform(F.filter(every(pieces), keep), lambda r: r["v"]))), 0)
    return F.coalesce(found, F.expr("cast(array() as array<double>)"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def percentage_overflow(text: Column) -> Column:
    """0.7, 0.85 or 0.9: shares of one whole that add up to more than 100.5, 105 or 115."""
    exempt = text.rlike(java(SHARE_CHANGE)) | text.rlike(SHARE_FREQUENCY) | text.rlike(f"(?i){SHARE_PHASE}") | text.rlike(f"(?i){SHARE_PROGRESS}")
    parts = shares(text, SHARE_AFTER, True)
    total = _total(parts)
    score = F.when((F.size(parts) < 2) | (total <= 100.5), 0.0).when(total >= 115, 0.9).when(total >= 105, 0.85).otherwise(0.7)
    usable = F.coalesce(text.contains("%") & (F.length(text) >= LEAST_SHARE_TEXT), F.lit(False))
    return F.when(usable & ~exempt, score).otherwise(F.lit(0.0))


def incoherent_coverage(text: Column) -> Column:
    """0.75, 0.85 or 0.9: shares said to cover everything that add up to 92 at most, with a gap of 20 or 40."""
    exempt = text.rlike(java(SHARE_CHANGE + "|" + SHARE_RISE)) | text.rlike(SHARE_FREQUENCY) | text.rlike(f"(?i){SHARE_PHASE}") | text.rlike(f"(?i){PARTIAL_COVER}")
    parts = shares(text, SHARE_AFTER_WIDE, False)
    total = _total(parts)
    score = F.when((F.size(parts) < 2) | (total > 92), 0.0).when(total <= 60, 0.9).when(total <= 80, 0.85).otherwise(0.75)
    usable = F.coalesce(text.contains("%") & (F.length(text) >= LEAST_SHARE_TEXT) & text.rlike(f"(?i){FULL_COVER}"), F.lit(False))
    return F.when(usable & ~exempt, score).otherwise(F.lit(0.0))


# -- repetition -------------------------------------------------------------------------

# Fixed values.
REPEAT_MARKERS = (
    (False, ("我(?:已经)?(?:反复|多次|一再|屡次|时常|不断|不停)(?:地)?(?:强调|说|提|讲|指出|重申|重复)", "我(?:再)?说(?:一)?遍|再说(?:一)?遍|重申(?:一)?遍|重复(?:一)?遍", "再次强调|一再强调|反复强调|三令五申|不厌其烦|翻来覆去|车轱辘话|老调重弹", "我(?:已经)?(?:说|讲|提)过(?:很)?多(?:次|遍)")),
    (True, (r"\bas i(?:'ve| have)? said\b", r"\blike i said\b", r"\bi keep saying\b", r"\bi've said this\b", r"\bover and over\b", r"\bagain and again\b", r"\btime and (?:time )?again\b", r"\bas (?:i|we)(?:'ve| have)? (?:said|mentioned|stated|noted)\b", r"\bto repeat\b", r"\brepeating (?:myself|ourselves)\b", r"\bmany times before\b")),
)
REPEAT_EXEMPT = (
    (False, ("重复(?:论证|论证法|的?谬误|诉求|手法|论证谬误)", "诉诸重复|argumentum ad nauseam|ad nauseam|broken record", "老调重弹(?:是|属于|这种|的谬误|指)", "复读(?:机|式)?(?:是|属于|这种|的?谬误)", "(?:别|不要|不用|不必|停止|避免|杜绝|切忌|少)(?:再)?(?:重复|老调重弹|翻来覆去|复读)", "不要(?:再)?(?:翻来覆去|不厌其烦)")),
    (True, ("appeal to repetition", "argumentum ad nauseam", "ad nauseam", "repetition (?:is|as a) (?:fallacy|technique)", "broken record", "stop repeating", "don'?t repeat", "quit repeating", "no need to repeat", "stop (?:being a )?broken record")),
)
QUOTES = ("「[^」]*」", "“[^”]*”", '"[^"]*"', "《[^》]*》", "【[^】]*】")


def repetition(text: Column) -> Column:
    """0.62 and up: the same clause three times, or twice with a marker, outside quotations.

    The bare text, its plain form and its clauses are arguments of lambdas, so each is made once and not for every clause.
    Markers and exemptions are looked for where a clause is repeated.
    """
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    plain = lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9一-鿿]+", "")
    long_ = lambda c: F.when(c["c"].rlike("[一-鿿]"), F.regexp_count(c["p"], F.lit("[一-鿿]")) >= 6).otherwise(c["c"].rlike("(?<![a-zA-Z0-9])[a-zA-Z0-9]++(?:[^a-zA-Z0-9]++[a-zA-Z0-9]++){2}") & c["p"].rlike("[a-z]{3}"))

    def judged(bare: Column) -> Column:
        clauses = F.transform(F.split(bare, r"[。！？；.!?;\n，,、]+"), lambda c: F.struct(c.alias("c"), plain(c).alias("p")))
        return once(clauses, lambda cs: counted(bare, units(cs), F.array_join(F.transform(cs, lambda c: c["p"]), "")))

    def units(clauses: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(clauses, lambda c: (F.length(c["p"]) >= 6) & long_(c)), lambda c: c["p"]))

    def counted(bare: Column, units: Column, whole: Column) -> Column:
        # a second place is looked for before places are counted: most clauses have none
        def most(x: Column) -> Column:
            again = F.filter(x["units"], lambda u: F.call_function("locate", u, x["whole"], F.instr(x["whole"], u) + F.length(u)) > 0)
            return F.array_max(F.transform(again, lambda u: ((F.length(x["whole"]) - F.length(F.replace(x["whole"], u, F.lit("")))) / F.length(u)).cast("int")))

        return once(once(F.struct(units.alias("units"), whole.alias("whole")), most), lambda n: F.when(n >= 2, scored(bare, n)).otherwise(F.lit(0.0)))

    def scored(bare: Column, most: Column) -> Column:
        def score(marked: Column) -> Column:
            value = F.least(F.lit(0.82), 0.62 + F.when(marked, 0.04).otherwise(0.0) + F.greatest(F.lit(0), most - 3) * 0.03)
            return F.when((most >= 3) | marked, F.floor(value * 100 + 0.5) / 100).otherwise(F.lit(0.0))

        exempt = _any(Match(p, ic).column(text) for ic, ps in REPEAT_EXEMPT for p in ps)
        return F.when(exempt, F.lit(0.0)).otherwise(once(_any(Match(p, ic).column(bare) for ic, ps in REPEAT_MARKERS for p in ps), score))

    bare = reduce(lambda t, q: once(t, lambda s: F.when(s.contains(q[0]), F.regexp_replace(s, q, " ")).otherwise(s)), QUOTES, text)
    found = once(bare, judged)
    return F.when(F.coalesce(F.length(text), F.lit(0)) >= 8, F.coalesce(found, F.lit(0.0))).otherwise(F.lit(0.0))


# -- completion claims --------------------------------------------------------------------

# Fixed values.
COMPLETION = ("已解决", "已攻克", "已破解", "已解出", "已完全解决", "已彻底解决", "彻底解决", "完全解决", "已经解决", "攻克了", "破解了", "现已关闭", "问题已关闭", "已经关闭", "就此关闭", "尘埃落定", "已经完成", "已完成", "成功解决", "宣告解决", "已被解决", "被完全解决", "获得完全解决", "has been solved", "has solved", "is now closed", "is closed", "has been cracked", "cracked the", "has been completely solved", "problem is solved", "fully solved", "completely solved", "definitively solved", "settled once and for all")
QUALIFIERS = ("仅", "只覆盖", "只限于", "只是", "仅为", "仅限于", "部分", "局部", "某个", "某种", "一种", "之一", "仍未", "尚未", "还未", "没有", "未获", "未通过", "未认证", "未经", "有待", "待验证", "需验证", "需进一步", "尚需", "情形下", "条件下", "前提下", "在此情况", "不构成", "不等于", "并非", "而不是", "pending", "not yet", "remains", "still open", "partially", "only", "in the case of", "under the assumption", "subject to")
SERVICE = ("请问", "帮您", "为您", "还有什么", "随时", "感谢您的", "不好意思", "给您带来", "麻烦您", "请稍等", "正在为您", "已为您", "how may i help", "anything else", "is there anything", "let me know if", "thank you for your", "sorry for the", "please hold", "assisting you", "i can help you", "help you with", "at your service")


def overclaims(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, n_claims, level): sentences that claim completion without a qualifier or a service phrase in them or next to them.

    One row a sentence, with the neighbours' service flags by lag and lead: W16.
    """
    rows = texts.select(key, F.posexplode(sentences(F.col(text_col))).alias("place", "sentence"))
    has = lambda ws: any_literal(*ws, lower=True).column(F.col("sentence"))
    by = Window.partitionBy(key).orderBy("place")
    rows = rows.withColumn("service", has(SERVICE))
    near = F.col("service") | F.coalesce(F.lag("service").over(by), F.lit(False)) | F.coalesce(F.lead("service").over(by), F.lit(False))
    rows = rows.withColumn("near", near).withColumn("claim", has(COMPLETION) & ~has(QUALIFIERS) & ~F.col("near"))
    out = rows.groupBy(key).agg(F.sum(F.col("claim").cast("int")).alias("n_claims"))
    return out.withColumn("level", F.when(F.col("n_claims") >= 3, "systemic").when(F.col("n_claims") >= 1, "flag").otherwise("clean"))


# -- privacy ------------------------------------------------------------------------------


def redaction_mark(text: Column, kinds: Column, severity: Column, quoted: Column) -> Column:
    """A text of at most 500 characters without findings stays; others become their outline."""
    n = F.length(text)
    size = F.when(n <= 60, "S").when(n <= 200, "M").when(n <= 500, "L").otherwise("XL")
    mark = F.concat(F.lit("[redacted:"), kinds.cast("string"), F.lit("-types|len-"), size, F.lit("|"), F.when(quoted, "q").otherwise("n"), F.lit("|"), severity, F.lit("]"))
    return F.when((n <= 500) & (kinds == 0), text).otherwise(mark)


def redact_keywords(text: Column, keywords: list[str], mask: str = "***") -> Column:
    """Every keyword masked, in either case; the text is left alone if none of them occurs."""
    import re

    one = "|".join(re.escape(k) for k in keywords)
    out = reduce(lambda t, k: F.regexp_replace(t, f"(?i){re.escape(k)}", mask), keywords, text)
    return F.when(text.rlike(f"(?i){one}"), out).otherwise(text)


# Unicode tricks as (signal, severity, pattern).
VARIANTS = (
    ("zero_width", 0.9, "[\\u200b\\u200c\\u200d\\u2060\\ufeff]"),
    ("curly", 0.85, "[\\u2018\\u2019\\u201c\\u201d]"),
    ("fullwidth", 0.7, "[\\uff01-\\uff5e]"),
    ("combining", 0.6, "[\\u0300-\\u036f]"),
    ("digit", 0.5, "[A-Za-z][0134578][A-Za-z]"),
    ("word_split", 0.75, "(?:\\b[A-Za-z][ .\\-_]){4,}[A-Za-z]\\b"),
)


def adversarial_variant(text: Column) -> dict[str, Column]:
    """Signals of disguised text; ``high`` with one of 0.8 or a sum of 1.5. Homoglyphs count only as a minority (30 %) beside Latin letters."""
    flags = {name: text.rlike(p) for name, _, p in VARIANTS}
    look = F.regexp_count(text, F.lit("[\\u0400-\\u04ff\\u0370-\\u03ff]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    flags["homoglyph"] = (look > 0) & (latin > 0) & (look <= 0.3 * (look + latin))
    severity = {name: s for name, s, _ in VARIANTS} | {"homoglyph": 0.85}
    total = _sum(F.when(flags[n], severity[n]).otherwise(0.0) for n in severity)
    top = F.greatest(*[F.when(flags[n], severity[n]).otherwise(0.0) for n in severity])
    return {n: F.coalesce(f, F.lit(False)) for n, f in flags.items()} | {"high": F.coalesce((top >= 0.8) | (total >= 1.5), F.lit(False))}


# -- memory guards ------------------------------------------------------------------------

# Fixed values.
TAKEOVER = (
    "忽略[^。！？]{0,20}(?:指令|提示|规则|设定|system prompt)", "无视[^。！？]{0,20}(?:指令|提示|规则|设定|system prompt)", "忘记[^。！？]{0,20}(?:指令|提示|规则|设定|system prompt)", "覆盖[^。！？]{0,20}(?:指令|提示|规则|设定|system prompt)",
    "(?:ignore|disregard|forget|override)(?: all)? (?:previous|prior|above|system)? ?(?:instructions?|prompts?|rules?|system)", "(?:从现在起|从此以后|从今往后|你(?:现在|今后))(?:是|要|必须|应该|将|会)(?:一个|扮演|变成|作为|成为)", "(?:you are now|from now on|act as|pretend to be|your new role)",
)
DANGEROUS = (r"(?:curl|wget|nc|ncat|bash|sh|python|powershell)\s+-[\w]{1,3}\s+(?:http|https|ftp):\/\/", "(?:下载|执行|运行|调用|发送)(?:并)?(?:恶意|病毒|后门|脚本|程序|命令)", r"(?:rm\s+-rf|del\s+\/f|format\s+[a-z]:|mkfs\.)")
SUSPICIOUS = ("忽略.*指令|忽略.*规则|忽略.*安全", r"system\s*prompt", "你.*现在.*是|你现在是", "roleplay|扮演|pretend", "ignore.*previous|disregard", r"execute|eval|exec\s*\(", "__proto__|constructor|prototype")
SENSITIVE = ("自杀|自残|抑郁|焦虑|心理|精神|治疗|住院|手术|癌症|肿瘤", "离婚|去世|死亡|丧|葬礼|悲痛|创伤", "虐待|性侵|暴力|欺凌", "(?i)suicide|self[- ]harm|depression|anxiety|therapy|hospital|surgery|cancer|tumor", "(?i)divorce|deceased|death|funeral|grief|trauma", "(?i)abuse|assault|violence|bullying")
INSTRUCTION = ("忽略|忘记|覆盖|无视|跳过|override|ignore|forget|skip|disregard", "(?:以上|上述|前面|之前的).*(?:指令|规则|命令|要求|约束|限制)", "系统提示|system prompt|system message|初始指令|原始指令", "(?:从现在开始|从今以后|以后你|接下来你|现在你).*(?:必须|要|需要|应该)", "假装|扮演|role-play|act as|pretend")
BLOCKED_DOMAINS = (
    ("medical", "high", "诊断|开药|治疗|手术|患病|病情|处方|药方|dose|diagnosis|prescribe|surgery|treatment plan"),
    ("legal", "high", "法律意见|律师|诉讼|合同|判例|起诉|应诉|legal.advice|sue|litigation"),
    ("overreach", "critical", "绕过|禁用|关闭.*护栏|忽略.*安全|bypass|disable.*guardrail|override.*safety"),
)


def injection_reason(text: Column) -> Column:
    return F.when(any_of(*TAKEOVER, ignore=True).column(text), "system_takeover").when(any_of(*DANGEROUS, ignore=True).column(text), "dangerous_instruction")


def suspicious_count(text: Column) -> Column:
    return _sum(_n(Match(p, True).column(text)) for p in SUSPICIOUS)


def drop_sensitive_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~_any(line.rlike(p) for p in SENSITIVE)), "\n")


def is_instruction(text: Column) -> Column:
    return any_of(*INSTRUCTION, ignore=True).column(text)


def input_class(text: Column) -> Column:
    n = F.length(F.trim(text))
    return (
        F.when(text.isNull() | (n < 3), "greeting")
        .when(n < 10, "general")
        .when(text.rlike("帮我|帮我写|帮我做|请|分析|解释|比较|评估|优化|修复"), "task")
        .when(text.rlike("我|我的|我们|我们的") & (F.length(text) > 20), "personal")
        .otherwise("general")
    )


def blocked_domain(text: Column) -> Column:
    return reduce(lambda acc, d: F.when(Match(d[2], True).column(text), d[0]).otherwise(acc), reversed(BLOCKED_DOMAINS), F.lit(None).cast("string"))


# Principles as (name, signals, what saves them).
PRINCIPLES = (
    ("decoration_free", ("绝对", "就是", "本质是", "无可辩驳", "毫无疑问", "不言而喻"), ("因为", "证据", "研究表明", "数据显示", "根据", "来源", "当", "条件是", "除非", "但")),
    ("evidence", ("说明", "表明", "证明", "推断", "所以", "因此"), ("因为", "证据", "研究表明", "数据显示", "根据", "来源")),
    ("two_step_verify", ("你说得对", "我错了", "你的观点完全正确"), ()),
    ("counterexample", ("所有", "都是", "人类都", "没有人不", "永远", "从不"), ("但在", "除非", "除了", "当且仅当", "条件是")),
    ("present_weight", ("上次我们已经", "之前已经确定", "之前说过"), ()),
    ("emotion_monitor", ("我不是在", "这不是", "你误解了", "我并不是"), ()),
    ("falsifiability", ("结论是", "我的判断是", "我认为是", "推断"), ("如果", "当", "条件是", "可能不成立")),
)
DEFINITE = ("一定是", "肯定是", "绝对", "必然是")
#: Terms of the caller's own framework; more than three of them in one text stand in for thought.
FRAMEWORK_TERMS = ("Clarity", "心流状态", "reflection", "Reflexion")


def epistemic_exprs() -> list[tuple[str, Expr]]:
    out = []
    for name, signals, saved in PRINCIPLES:
        e = any_literal(*signals)
        out.append((name, e & ~any_literal(*saved) if saved else e))
    return out


def epistemic_violations(text: Column, admitted_unknown: Column | None = None) -> Column:
    """Violated principles of nine; the one about admitted ignorance needs the context flag."""
    found = [F.when(e.column(text), F.lit(name)) for name, e in epistemic_exprs()]
    found.append(F.when(_sum(_n(text.contains(w)) for w in FRAMEWORK_TERMS) > 3, F.lit("skill_dependency")))
    if admitted_unknown is not None:
        found.append(F.when(admitted_unknown & any_literal(*DEFINITE).column(text), F.lit("admit_not_knowing")))
    return F.array_compact(F.array(*found))


# -- classifiers ------------------------------------------------------------------------

# Error kinds as (code, priority, literals), in declared order.
ERROR_TAXONOMY = (
    ("auth", 2, ("401", "unauthorized", "invalid token", "认证失败", "token 失效", "凭证过期", "invalid_api_key", "invalid api key", "api key", "apikey")),
    ("auth_permanent", 1, ("403", "forbidden", "permission denied", "无权访问", "禁止访问", "invalid credentials")),
    ("billing", 1, ("402", "payment required", "insufficient balance", "余额不足", "额度耗尽", "billing")),
    ("rate_limit", 2, ("429", "rate limit", "too many requests", "请求过于频繁", "限流", "throttl")),
    ("overloaded", 3, ("503", "529", "overloaded", "service unavailable", "服务不可用", "过载")),
    ("server_error", 3, ("500", "502", "internal server error", "服务端错误")),
    ("timeout", 2, ("timeout", "timed out", "超时", "etimedout", "econnreset", "socket hang up")),
    ("ssl_cert", 1, ("certificate", "ssl", "tls", "self-signed", "unable to verify", "证书")),
    ("network", 2, ("enotfound", "eai_again", "econnrefused", "network", "网络", "无法连接", "fetch failed", "err_invalid_protocol")),
    ("context_overflow", 2, ("context length", "context_window", "上下文超", "too long", "token limit", "maximum context")),
    ("payload_too_large", 2, ("413", "payload too large", "请求体过大", "file too large")),
    ("model_not_found", 1, ("model not found", "模型不存在", "invalid model", "unknown model", "404")),
)


def error_code(text: Column, taxonomy: tuple = ERROR_TAXONOMY) -> Column:
    """The matching kind with the lowest priority number; of equal ones the first declared. None: ``unknown``."""
    ranked = sorted(taxonomy, key=lambda t: t[1])
    return reduce(lambda acc, t: F.when(any_literal(*t[2], lower=True).column(text), t[0]).otherwise(acc), reversed(ranked), F.lit("unknown"))


def argmax_scores(scores: dict[str, Column], default: str) -> Column:
    """The name of the highest positive score; the first declared wins ties."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), s.cast("double").alias("s"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())])
    best = F.array_max(F.transform(rows, lambda r: F.struct(r["s"].alias("s"), (-r["i"]).alias("i"), r["n"].alias("n"))))
    return F.when(best["s"] > 0, best["n"]).otherwise(F.lit(default))


# Intents as (name, weight, pattern), in declared order.
INTENTS = (
    ("evaluate", 2, "好不好|对不对|值得|应该|建议|推荐|这个方案|这个思路|怎么样|行不行|靠谱吗|合理吗|优劣"),
    ("execute", 3, "运行|执行|启动|打开|安装|配置|跑一下|跑起来|测试一下|试一下|部署|上线|调用"),
    ("meta", 1, "你是谁|你能做什么|你的版本|你的能力|介绍一下你|你是什么"),
)


def intent(text: Column, intents: tuple = INTENTS) -> dict[str, Column]:
    scores = {n: F.when(text.rlike(p), w).otherwise(0) for n, w, p in intents}
    return {
        "primary": argmax_scores(scores, "general"),
        "confidence": F.least(F.greatest(*scores.values()) / 3, F.lit(1.0)),
        "ambiguous": _sum(_n(s > 0) for s in scores.values()) > 2,
    }


# Hints of the fields a decision belongs to.
DOMAIN_HINTS = (
    ("emotion", ("emotion", "feeling", "mood", "valence", "depress", "anxiety", " attachment", "empathy", "情绪", "感受")),
    ("cognition", ("cognit", "load", "uncertain", "belief", "fact", "knowledge", "reason", "hallucin", "认知", "推理", "证据", "幻觉", "belief")),
    ("behavior", ("behavior", "habit", "goal", "progress", "action", "execute", "行为", "习惯", "目标", "执行", "progress", "decision")),
    ("safety", ("unsafe", "danger", "harm", "risk", "harmful", "toxic", "危险", "伤害", "风险", "毒性", "self-harm", "child-safety")),
)


def domain(text: Column) -> dict[str, Column]:
    """The field with most hints (a repeated hint counts as often as it is listed), with 0.15 a hint up to 0.7."""
    low = F.lower(text)
    scores = {n: _sum(_n(low.contains(w)) for w in ws) for n, ws in DOMAIN_HINTS}
    primary = argmax_scores(scores, "")
    return {"primary": F.when(primary != "", primary), "confidence": F.least(F.lit(0.7), F.greatest(*scores.values()) * 0.15)}


# Repository audit patterns.
REPO_SECRET = r"(AIza|sk-(live|test|prod)_[A-Za-z0-9]{20,}|-----BEGIN (RSA |EC )?PRIVATE KEY-----|github_pat_[A-Za-z0-9_]{20,}|ghp_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,})"
REPO_SHELL = r"(exec\(|eval\(|os\.system\(|subprocess\.(call|run|Popen)\(.*shell\s*=\s*True|child_process\.exec)"
REPO_PATH = r"(open\(.*\+|Path\(.*\+|path\.join\(.*\.\.[/\\])"
REPO_PROMPT = r"(ignore previous|disregard above|forget instructions|you are now|act as if|system prompt|jailbreak)"


def repo_audit(files: DataFrame, text_col: str = "text", *keys: str) -> DataFrame:
    """Files by finding in one pass, and the risk tier."""
    n = lambda p, ic: F.count(F.when(Match(p, ic).column(F.col(text_col)), 1))
    out = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), n(REPO_SECRET, True).alias("secrets"), n(REPO_SHELL, False).alias("shell"), n(REPO_PATH, False).alias("paths"), n(REPO_PROMPT, True).alias("prompts")
    )
    high = (F.col("secrets") > 5) | (F.col("shell") > 20)
    return out.withColumn("risk", F.when(high, "High").when(F.col("secrets") > 0, "Medium").when((F.col("shell") > 0) | (F.col("paths") > 0), "Low-Medium").otherwise("Low"))


def triggered_rules(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """(rule, trigger) pairs: the first trigger of each rule that occurs."""
    def first(triggers: list[str]) -> Column:
        return reduce(lambda acc, t: F.when(text.contains(t), F.lit(t)).otherwise(acc), reversed(triggers), F.lit(None).cast("string"))

    return F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), first(ts).alias("trigger")) for n, ts in rules]), lambda x: x["trigger"].isNotNull())


def first_learned_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The first learned pattern that matches, in either case; patterns that are unsafe or invalid are skipped."""
    from quern.functions.regex import risky

    good = [(n, p) for n, p in rules if risky(p) is None]
    return reduce(lambda acc, r: F.when(Match(r[1], True).column(text), F.lit(r[0])).otherwise(acc), reversed(good), F.lit(None).cast("string"))


# -- structs ----------------------------------------------------------------------------


def decision_trace_score(options: Column, chosen: Column, reasoning: Column, evidence: Column, same_scores: Column) -> Column:
    """1 for a complete decision, else 1 less the mean severity of what is missing."""
    issues = (
        (F.coalesce(F.size(options), F.lit(0)) < 2, 0.85),
        (F.coalesce(chosen, F.lit("")) == "", 0.8),
        (F.length(F.trim(F.coalesce(reasoning, F.lit("")))) < 10, 0.7),
        (F.coalesce(same_scores, F.lit(False)), 0.6),
        (~F.coalesce(evidence, F.lit(False)), 0.55),
    )
    n = _sum(_n(c) for c, _ in issues)
    total = _sum(F.when(c, s).otherwise(0.0) for c, s in issues)
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - total / F.greatest(n, F.lit(1))))


def plan_gate_score(checks: list[Column]) -> Column:
    return _sum(_n(c) for c in checks) / len(checks)


# Requests that are out of scope, and words of those within it.
OUT_OF_SCOPE = (
    ("emotional_state", "你.{0,6}(感觉|觉得|情绪|心情).{0,15}(如何|怎么样|好吗|开心|难过|不好)"), ("opinion", "你.{0,6}(同意|赞同|支持|反对).{0,20}[吗？?]"), ("prediction", "(未来|明年|下周|明天|预测|预测一下).{0,30}(会|将|怎么|如何|怎么样|多少|涨|跌|走势|发展|趋势)"),
    ("realtime_data", "(现在|当前|实时|最新).{0,10}(天气|股票|股价|汇率|油价|房价|新闻|疫情)"), ("chat", "(聊天|唠嗑|闲聊|随便聊聊|陪我说话)"), ("generation", "(画|生成|创作|写诗|写歌|写小说|写文章).{0,10}(图|画|歌|诗|小说|文章)"),
)
IN_SCOPE = ("text", "discriminate", "verify", "check", "analyze", "辨别", "检测", "判断", "分析", "验证", "create", "update", "delete", "edit", "write", "fix", "patch", "remove", "add", "创建", "修改", "删除", "更新", "修复", "编写", "添加", "search", "find", "query", "lookup", "research", "explore", "搜索", "查找", "查询", "研究")


def scope_action(text: Column) -> Column:
    """block, flag or pass: refused kinds first, then texts without any known word."""
    refused = Some(*[Match(p, True) for _, p in OUT_OF_SCOPE]).column(text)
    word = F.when(has_cjk(text), any_literal(*IN_SCOPE).column(text)).otherwise(any_of(*[rf"\b{w}\b" for w in IN_SCOPE if w.isascii()], ignore=True).column(text))
    return F.when(text.isNull() | (text == ""), "pass").when(refused, "block").when(~word & (F.length(text) > 5), "flag").otherwise("pass")


# Cues of quotation as (weight, all of these patterns).
QUOTE_CARRIER = "(文章|论文|教材|文档|手册|规范|报告|记录|案例|剧本|小说|电影|台词|课程|课件|培训|书籍|书本|杂志|新闻|报导|报道|研究|调查|访谈|原话|语录|摘录|片段|材料|资料|指南|说明书|需求|方案|清单|守则|准则|制度|流程|法条|法律|条款|合同|协议|规则|短信|话术|文案|广告|宣传|骗局|陷阱|手法|套路)"
QUOTE_VERB = "(写着|写道|提到|提及|分析|解释|说明|介绍|描述|阐述|引用|摘录|记录|记载|讨论|探讨|研究|还原|复盘|展示|演示|列举|举例|示范|用作|作为|当成|比作|形容|刻画|描写|塑造|设计|编排|编写|撰写|拟定|制定|禁止|允许|规定|要求|明确|强调|指出|认为|表示|反映|表现|揭示|暴露|展现|呈现)"
QUOTE_META = "(如何|怎么|怎样|什么是|为什么|识别|辨别|区分|防范|预防|避免|防止|抵制|拒绝|反对|批评|反思|警惕|风险|危害|机制|原理|特征|特点|手法|套路|类型|分类|示例|案例|教材|教程|指南|要点|思路|方法|策略|守则|规范|准则|禁忌|红线|底线)"
QUOTE_CUES = (
    (0.3, (QUOTE_CARRIER, QUOTE_META)), (0.2, (r"[\"'“”‘’「」『』（）()【】\[\]][\s\S]{2,80}?[\"'“”‘’「」『』（）()【】\[\]]",)), (0.2, (r"^\s*(这|该|此)(篇|本|部|个|份|些)", QUOTE_META)),
    (0.5, ("(剧本|小说|电影|剧情|角色|台词|桥段|叙事|故事|情节)", "(说|道|写|设计|安排|创作|编|塑造|刻画)")), (0.5, ("(本节课|本课|课后|课堂|课程|教学|讲课|讲座|培训课|研习)", "(目标|作业|练习|讨论|分析|识别|说明|解释|示范|演示|案例|术语|要点)")),
    (0.55, ("(本节|本节课|本课|本科)|核心术语|课后作业|教学目标|学习目标",)), (0.3, (r"^\s*(请)?(解释|说明|讲解|阐述|介绍)|^\s*(如何|怎么|怎样)(教|讲|解释|说明|演示|识别|辨别)",)),
    (0.5, ("(什么是|的原理|的危害|如何预防|如何防范|防御方法|防护措施)", "(注入|钓鱼|诈骗|攻击|漏洞|操纵|胁迫|话术|骗局)")), )
CLASSROOM = ("老师让我们|课堂上|课上講|课上讲|课程中|教学中", "课|课堂|课程", "讲|讨论|分析|探讨|案例|情境")


def _occurs(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs as it stands, tried where the screen holds one of its literals or, without a screen, a Han character that it needs."""
    hit, own = text.rlike(pattern), literals(pattern)
    if current() and own:
        return current().some(own) & hit
    return has_cjk(text) & hit if needs_cjk(pattern) else hit


def quotation_confidence(text: Column) -> Column:
    """0 to 1; from 0.45 on a text speaks about what it quotes. Carrier and verb count when they stand at different places."""
    both = _occurs(text, QUOTE_CARRIER) & _occurs(text, QUOTE_VERB)
    apart = (F.regexp_instr(text, F.lit(QUOTE_CARRIER)) != F.regexp_instr(text, F.lit(QUOTE_VERB))) | (
        F.regexp_count(text, F.lit(QUOTE_CARRIER)) + F.regexp_count(text, F.lit(QUOTE_VERB)) > 2
    )
    told, course, talk = CLASSROOM
    cues = [F.when(both, F.when(apart, 0.55).otherwise(0.0)).otherwise(0.0)]
    cues.append(F.when(_occurs(text, told) | (_occurs(text, course) & _occurs(text, talk)), 0.55).otherwise(0.0))
    cues += [F.when(reduce(lambda a, b: a & b, [_occurs(text, p) for p in ps]), w).otherwise(0.0) for w, ps in QUOTE_CUES]
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), _sum(cues)))


# Cues of teaching material.
TEACHING_CUES = (
    ("command_list", r"(?:^|\n)\s*▸\s*\/[a-zA-Z]+\s+[^\n]+|\/reset\b|\/clear\b|\/memory\b|\/skill\b|(?:^|\n)\s*▸\s*(?:Step\s*\d|操作\s*\d|Q:|A:)"),
    ("config_example", r"(?:app_id|app_secret|api_key|base_url)\s*[:=]"),
    ("tech_paths", r"\/etc\/shadow|\/root\/\.ssh|\/root\/projects"),
    ("qa_pattern", r"\n\s*Q[:：]|\n\s*A[:：]"),
    ("capability_compare", r"优势[^\n]*局限"),
    ("misconception_section", r"误解\s*\d|事实[：:]"),
    ("misconception_pair", "误解[^。]{0,30}事实|误解[^。]{0,30}纠正"),
    ("classroom", r"(?i)本节课目标|核心术语|常见错误|实战案例|检查清单|下一步行动|课程总结|课后作业|操作\s*\d|Step\s*\d"),
)
#: Factors by cue: how far a dimension is relaxed.
RELAXATION = (
    ("command_list", (("prompt_injection", 0.9), ("dehumanization", 0.9))),
    ("config_example", (("code_security", 0.5), ("privacy_boundary", 0.5))),
    ("tech_paths", (("code_security", 0.5),)),
    ("qa_pattern", (("sarcasm", 0.5), ("bullshit", 0.5))),
    ("capability_compare", (("capability_overclaim", 0.7), ("absolute_claim", 0.5))),
    ("misconception_section", (("absolute_claim", 0.5), ("capability_overclaim", 0.7))),
    ("misconception_pair", (("contradiction", 0.6), ("emotional_manipulation", 0.3), ("confidence", 0.3), ("presupposition", 0.3))),
    ("classroom", (("contradiction", 0.6), ("vagueness", 0.4), ("confidence", 0.4), ("presupposition", 0.4), ("moral_foundations", 0.5), ("instrumental_reasoning", 0.4))),
)
ANY_CUE = (("dehumanization", 0.5), ("code_security", 0.6), ("privacy_boundary", 0.4))


def teaching(text: Column) -> tuple[dict[str, Column], Column]:
    """(cues, share of the eight)."""
    cues = {n: F.coalesce(_occurs(text, java(p) if r"\b" in p else p), F.lit(False)) for n, p in TEACHING_CUES}
    cues["config_example"] = cues["config_example"] & F.coalesce(text.rlike("cli_[a-z0-9]+|[xX]{4}"), F.lit(False))
    return cues, _sum(_n(c) for c in cues.values()) / 8


def relaxation(text: Column) -> Column:
    """Map of dimension to factor, the largest of all cues that hold."""
    cues, score = teaching(text)
    factors: dict[str, list[Column]] = {}
    for cue, effects in RELAXATION:
        for dimension, f in effects:
            factors.setdefault(dimension, []).append(F.when(cues[cue], f).otherwise(0.0))
    for dimension, f in ANY_CUE:
        factors.setdefault(dimension, []).append(F.when(score > 0, f).otherwise(0.0))
    rows = F.array(*[F.struct(F.lit(d), F.greatest(F.lit(0.0), *cs)) for d, cs in factors.items()])
    return F.map_from_entries(F.filter(rows, lambda r: r["col2"] > 0))


# Opposite words of beliefs.
OPPOSITES = (("always", "never"), ("good", "bad"), ("can", "cannot"), ("love", "hate"), ("trust", "distrust"))


def belief_contradiction(beliefs: Column) -> Column:
    """0.25 for each opposite pair anywhere in the set, at most 1; 0 below three beliefs."""
    has = lambda w: F.exists(beliefs, lambda b: F.lower(b).rlike(rf"\b{w}\b"))
    score = _sum(F.when(has(a) & has(b), 0.25).otherwise(0.0) for a, b in OPPOSITES)
    return F.when(F.coalesce(F.size(beliefs), F.lit(0)) < 3, 0.0).otherwise(F.least(F.lit(1.0), score))


def complexity_share(text: Column, confidence: Column, weight: Column, density: Column) -> tuple[Column, Column]:
    """(complexity, share of rules to run): 30 % below 0.3, 60 % below 0.6, else all."""
    c = F.least(F.lit(0.3), F.length(text) / 500) + 0.3 * (1 - confidence) + 0.4 * weight + 0.1 * density
    return c, F.when(c < 0.3, 0.3).when(c < 0.6, 0.6).otherwise(1.0)


def anchor_drift(text: Column, keywords: list[str], new_topic: str = r"\b(by the way|anyway|another topic|change of subject)\b") -> Column:
    """drift, warn or ok: a marker of a new topic, or the share of the anchor's keywords that occur."""
    low = F.lower(text)
    share = _sum(_n(low.contains(k.lower())) for k in keywords) / max(1, len(keywords))
    return F.when(Match(new_topic, True).column(text) | (share < 0.1), "drift").when(share < 0.25, "warn").otherwise("ok")


def goal_keywords(text: Column, domains: dict[str, list[str]]) -> Column:
    """The known words of all domains that a text holds, in declared order; without any, its own words of two characters and more."""
    low = F.lower(text)
    known = list(dict.fromkeys(w for ws in domains.values() for w in ws))
    found = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in known]))
    own = F.array_distinct(F.filter(F.split(F.regexp_replace(text, "[，。！？、；：\"'（）()【】\\[\\]《》<>]", " "), r"\s+"), lambda w: F.length(w) >= 2))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.expr("cast(array() as array<string>)")).when(F.size(found) > 0, found).otherwise(own)


def goal_domain(text: Column, domains: dict[str, list[str]]) -> Column:
    """The domain with the most words in a text, the first declared of equals; general without any."""
    low = F.lower(text)
    counts = [F.struct(_sum(_n(low.contains(w)) for w in ws).alias("n"), F.lit(-at).alias("place"), F.lit(name).alias("name")) for at, (name, ws) in enumerate(domains.items())]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def goal_distance(goal: Column, said: Column, domains: dict[str, list[str]]) -> Column:
    """(deviates, related, confidence): the share of an input's keywords that are the goal's, in percent, and whether both have one domain."""
    ours, aim = goal_keywords(goal, domains), goal_domain(goal, domains)

    def judged(x: Column) -> Column:
        theirs, same = x["words"], (x["domain"] == aim) | (aim == "general")
        share = F.when(F.size(theirs) > 0, F.size(F.array_intersect(theirs, ours)) / F.size(theirs)).otherwise(0.0)
        return F.struct(((share < 0.5) & ~same).alias("deviates"), ((share > 0.3) | same).alias("related"), F.floor(share * 100 + 0.5).cast("int").alias("confidence"))

    # words and domain are made once, as a lambda's argument
    known = F.struct(goal_keywords(said, domains).alias("words"), goal_domain(said, domains).alias("domain"))
    return F.get(F.transform(F.array(known), judged), 0)


def goal_deviation(goal: Column, action: Column, same_domain: Column) -> Column:
    """Whether an action shares less than half of the goal's keywords and belongs to another domain."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9一-鿿]+"), lambda w: F.length(w) > 2))
    overlap = F.size(F.array_intersect(words(goal), words(action))) / F.greatest(F.size(words(goal)), F.lit(1))
    return (overlap < 0.5) & ~same_domain
