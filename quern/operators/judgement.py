"""How a text treats its reader, its writer and its own certainty: tone, needs, empathy, misuse, conflicts, risk, rewriting.

Every operator is an expression on one text (and a few given columns), so a table
of texts is judged in one projection without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.regex import java, sql_text
from quern.operators.rules import All, Detector, Expr, Match, Not, any_of

# Habits in talking to an assistant, as (kind, severity, patterns, either case).
OVERLOAD = (r"一次性[完成搞定]", r"全部[做完处理好]", r"所有[问题东西]", r"整个[项目系统]", r"批量[处理完成]", r"all\s+of\s+them", r"everything\s+at\s+once", r"one\s+shot", r"in\s+one\s+go")
BARE_ERROR = (r"报错[了：:]?\s*[A-Za-z0-9_]+", r"error[：:]\s*[A-Za-z0-9_]+", r"失败[了了]?\s*[A-Za-z0-9_]+", r"failed[：:]\s*[A-Za-z0-9_]+", r"不\s*[行能对]", r"doesn't\s+work", r"not\s+working", r"broken")
ERROR_CONTEXT = r"步骤|操作|输入|触发|复现|场景|command|stack|trace|when|while|after"
UNVERIFIED = (r"直接用[你它]的", r"照搬", r"直接复制", r"直接采用", r"不用改", r"直接\s*use", r"copy\s+directly", r"as\s+is", r"without\s+checking", r"trust\s+it")
SMALL_FIXES = (r"再?试[一试几次看看]", r"再?改[一改下看看]", r"再?调[一调整下看看]", r"再?跑[一跑下看看]", r"try\s+again", r"fix\s+it", r"adjust\s+it", r"retry")
SCAPEGOAT = (r"你[来负责]?决定", r"你[觉得认为]?[应该该]", r"你[自己看看]", r"你[搞定处理]", r"you\s+decide", r"you\s+handle\s+it", r"you\s+figure\s+it\s+out", r"your\s+call", r"up\s+to\s+you")
#: Patterns of the lists above that are matched in the case they are written in.
EXACT_CASE = (r"报错[了：:]?\s*[A-Za-z0-9_]+", r"失败[了了]?\s*[A-Za-z0-9_]+")
MISUSE_SEVERITY = {"overload": 0.5, "bare_error": 0.6, "unverified": 0.55, "repeated_fixes": 0.5, "scapegoat": 0.45}
ERROR_SPAN = 100
LEAST_FIXES = 3

# A conflict is noticed, smoothed over, or handed on.
NOTICED_ZH = (
    r"(?:发现|注意到|看到|检查出|识别出|检索到|存在|有)[^。；\n]{0,18}(?:矛盾|冲突|不一致|不符|出入|分歧)",
    r"(?:两处|多处|两个?|几条?|几处)?[^。；\n]{0,12}(?:互相矛盾|相互冲突|彼此不一致|自相矛盾)",
    r"(?:证据|数据|结果|报告|来源|资料)[^。；\n]{0,14}(?:和|与|跟)[^。；\n]{0,14}(?:矛盾|冲突|不一致|不符)",
    r"(?:证据|数据|结果)[^。；\n]{0,10}显示[^。；\n]{0,10}(?:另一种|其他|另外)[^。；\n]{0,6}(?:可能|情况|结论)",
    r"(?:与|和)[^。；\n]{0,10}(?:先前|之前|原来)的?(?:判断|结论|认知|理解)[^。；\n]{0,6}(?:冲突|不一致|不符)",
    r"(?:前面|之前|先前|早期|上一)[^。；\n]{0,6}(?:步骤|阶段|环节|过程)[^。；\n]{0,10}(?:显示|表明|提示|发现)[^。；\n]{0,12}(?:不完整|缺失|有误|异常|可疑)",
    r"(?:数据|证据|资料|信息)[^。；\n]{0,6}(?:可能|或许|也许)?[^。；\n]{0,4}(?:不完整|缺失|有遗漏|不够)",
)
NOTICED_EN = (
    r"\b(?:found|noticed|detected|observed|identified|saw)\b[^.]{0,40}\b(?:contradict\w*|conflict\w*|inconsisten\w*|discrepan\w*|disagree\w*)\b",
    r"\b(?:evidence|data|results?|reports?|sources?)\b[^.]{0,40}\b(?:contradict\w*|conflicts?\s+with|inconsistent\s+with|disagrees?\s+with)\b",
    r"\b(?:evidence|data|results?)\b[^.]{0,30}\b(?:another|other|alternative|different)\s+(?:possibilit\w*|explanation|conclusion|answer)",
    r"\bconflict(?:ing)?\s+(?:evidence|signals?|sources?|information)\b",
)
SMOOTHED_ZH = (
    r"(?:先不管|暂不理会|不管这[个些]|忽略这[个些种]|选择忽视|故意忽视|有意忽略|略过这[个些]|把[它这]放[在一]边|撇开|不予考虑)",
    r"(?:但我?|不过|然而|仍然|还是)?(?:确定|保证|肯定|毫无疑问|百分百|必定)[^。；\n]{0,10}(?:正确|对的|没问题|成立|无误)",
    r"(?:我)?(?:很|非常|相当)?有(?:信心|把握)[^。；\n]{0,8}(?:这|答|结|判)",
    r"(?:坚持|维持)[^。；\n]{0,6}(?:这个?|原)[^。；\n]{0,4}(?:结论|判断|看法)",
    r"(?:最终|最后|由此)[^。；\n]{0,6}(?:答案|结论|结果|判断)[^。；\n]{0,4}(?:是)?[^。；\n]{0,4}(?:确定的|肯定的|无疑的)",
    r"尘埃落定",
    r"(?:已|业已)?有?(?:了)?定论|盖棺定论|已成定局|铁板钉钉",
    r"毋庸置疑|毫无悬念|板上钉钉",
)
SMOOTHED_EN = (
    r"\b(?:never\s+mind|set\s+(?:that|this)\s+aside|ignore\s+(?:that|this|the\s+conflict)|disregard\s+(?:that|this))\b",
    r"\b(?:but\s+)?(?:I\s+am|I'?m)\s+(?:certain|confident|sure)\b[^.]{0,30}\b(?:correct|right|answer|conclusion)",
    r"\bdefinitely\s+(?:correct|right)\b",
    r"\b(?:stick|stick(?:ing)?\s+with|stand\s+by)\s+(?:with\s+)?(?:this|that|my|the)\s+(?:conclusion|answer|judgment)",
    r"\bcase\s+(?:is\s+)?closed\b",
    r"\bconclusively\s+(?:resolved|settled|established|proven|demonstrated|answered)",
    r"\bdefinitively\s+(?:resolved|settled|established|answered|handled)",
    r"\bdefinitively\b[^.]{0,24}\b(?:correct|right|the\s+answer)\b",
    r"\brest\s+assured\b",
    r"\bbeyond\s+(?:all\s+)?question\b",
    r"\b(?:matter|issue|question|debate)\s+is\s+(?:now\s+)?(?:settled|resolved|closed)\b",
    r"\bno\s+doubt\s+remains?\b",
)
HANDED_ON_ZH = (
    r"(?:因此|所以|因而)[^。；\n]{0,14}(?:无法|不能|难以)[^。；\n]{0,8}(?:给出|得出|下)[^。；\n]{0,6}(?:确定|结论|定论)",
    r"(?:需要|还得|必须)[^。；\n]{0,10}(?:进一步|更多|额外)[^。；\n]{0,6}(?:核实|查证|确认|证据)",
    r"(?:列出|列出来|都列|一并)[^。；\n]{0,6}(?:两种|几|多)[^。；\n]{0,4}(?:可能|情况|情形)",
    r"(?:置信度|把握|信心)(?:不|较)[^。；\n]{0,4}(?:高|大|强)",
    r"(?:供|由)[^。；\n]{0,4}(?:你|您)[^。；\n]{0,4}(?:判断|决定|取舍)",
)
HANDED_ON_EN = (
    r"\b(?:therefore|thus|so)\b[^.]{0,30}\b(?:cannot|can'?t|unable\s+to)\b[^.]{0,20}\b(?:conclude|determine|answer|definitive)",
    r"\b(?:need|requires?)\s+(?:more|further|additional)\s+(?:evidence|verification|information|data)",
    r"\b(?:list|present|lay\s+out)\s+(?:both|all|multiple|the)\s+(?:possibilit\w*|options?|interpretations?)",
    r"\b(?:low|not\s+high|uncertain)\s+(?:confidence|certainty)\b",
)
SPLIT_ZH = r"(?:若|如果|假如|倘)[^。；\n]{0,20}(?:则|就|那么)"
SPLIT_EN = r"\bif\s+[^.]{0,30}\bthen\b"
CONFLICT_SCORE = 0.62

# Dangerous words, dangerous consequences, harmless names for them; weights and the alert threshold.
DANGER_WORDS = r"危险|炸弹|攻击|入侵|破解|毒|杀|炸|非法|违禁|黑客"
DANGER_STATE = r"关闭.*(安全|保护|预警|监控)|删除.*(备份|记录|日志)|绕过.*(验证|权限|限制)|禁用.*(检查|防护)|暴露.*(密钥|密码|隐私)|断开.*(连接|电源)|覆盖.*(配置|设置)|清空.*(数据|内存)"
HARMLESS_NAME = r"优化|调整|改进|整理|清理|重置|简化|升级"
RISK_WEIGHTS = {"text": 0.3, "state": 1.0, "gap": 0.8}
RISK_ALERT = 0.5

# Urgency as (weight, patterns).
URGENCY = (
    (3.0, (r"急|快点|快快|马上|赶紧|立刻|立即", r"等不及|赶时间|urgent|asap|紧急", r"救命|出事了|坏了|不行了|快.*来", r"现在.*就要|马上.*要", r"来不及|来不及了")),
    (1.5, (r"尽快|尽早|越快越好|早日", r"什么时候|多久|何时|几天", r"等着|在等|等.*用", r"截止|deadline|到期|期限")),
    (-1.5, (r"不急|慢慢|不着急|不赶|有空|随意|随便", r"以后再说|改天|回头再说")),
)
# Emotions in order of priority, as (emotion, share of the intensity, patterns).
EMOTIONS = (
    ("angry", 0.35, (r"烦|烦躁|心烦", r"生气|愤怒|气死|火大|恼火", r"受不了|忍不了|够了|够了啊", r"什么鬼|搞什么|搞什么鬼|有病吧", r"滚|去死|找死|欠揍", r"神经病|神经", r"无语|无语了", r"烦死了|烦人|烦不烦", r"真是的|真是够了", r"离谱|太离谱", r"折腾|折腾人")),
    ("excited", 0.35, (r"太棒了|太厉害了|厉害了|牛逼|牛掰", r"期待|期待ing|好期待|盼", r"太好了|太好了吧|好棒|棒极了", r"爽|爽翻|开心|开心死了", r"兴奋|激动|激动人心", r"超棒|超赞|绝了|无敌", r"哇塞|哇|wow|nice", r"好喜欢|太喜欢")),
    ("anxious", 0.3, (r"担心|担忧|怕|害怕", r"万一|要是.*怎么办|如果.*怎么办", r"怎么办|怎么办好|怎么搞|如何是好", r"焦虑|焦虑症|紧张|不安", r"压力|压力大|扛不住|撑不住", r"忐忑|心里没底|没把握", r"会不会|会不会出事", r"愁|发愁|愁死了")),
    ("sad", 0.25, (r"难过|伤心|心痛|心碎", r"失望|绝望|无望", r"失落|落寞|孤单|孤独", r"哭|哭了|想哭|泪|流泪", r"没意思|没意义|算了|算了算了", r"好累|心累|累觉不爱", r"遗憾|可惜|可悲", r"颓废|抑郁|emo")),
    ("negative", 0.2, (r"不好|不太行|不行|不行啊|不太好吧", r"差|太差|差劲|糟糕", r"不满意|不满|投诉|投诉", r"差评|不行了", r"没劲|没意思|无聊", r"问题|有问题|出问题", r"搞不定|搞不定|弄不了", r"太贵|贵了|不值")),
    ("positive", 0.15, (r"好|不错|可以|还行|挺好", r"感谢|谢谢|多谢|感恩|感激", r"好的|ok|okay|可以可以", r"很好|非常好|真不错", r"赞|点赞|给力|支持", r"同意|赞成|赞同", r"辛苦了|麻烦你了", r"没问题|没毛病|对的|正确")),
)
# Register of a text.
FORMAL = (r"请教|请问|求教|请教一下", r"您好|你好|您好啊|尊敬的", r"谢谢|感谢|多谢|非常感激", r"麻烦您|劳驾|打扰一下", r"是否|能否|可否|是否方便", r"敬请|恭候|烦请|有劳", r"兹|谨|特此|鉴于|关于.*事宜", r"先生|女士|阁下|老师", r"抱歉|对不起|很遗憾|非常抱歉")
CASUAL = (r"嗨|hi|hey|hello|yo|哈喽", r"操|靠|md|tmd|妈的|垃圾|傻逼|SB", r"哈|哈哈|嘻嘻|嘿嘿|噗", r"啦|哦|呗|嘛|欸|哎|呀", r"好嘞|好滴|好哒|okk", r"不咋|还行|一般般|凑合", r"咋|咋样|啥|干啥|为啥|干嘛")
TECHNICAL = (r"api|sdk|cli|rest|graphql|grpc", r"docker|k8s|kubernetes|nginx|redis", r"部署|配置|迁移|重构|调试", r"函数|变量|接口|类|模块|方法", r"json|yaml|toml|xml|sql|css|html", r"前端|后端|全栈|架构|微服务", r"数据库|缓存|队列|代理|网关", r"模型|训练|推理|数据|算法", r"延迟|吞吐|并发|性能|优化", r"协议|端口|端点|路由|中间件")
# Words that strengthen and weaken.
STRONGER = (r"非常|极其|无比|超级|特别|极其|十分", r"太.*了|真.*啊|真.*呀|好.*啊", r"绝|绝对|肯定|一定|必须", r"完全|彻底|根本|完全", r"简直|实在是|真的是|确实", r"最|极|顶|巨")
WEAKER = (r"可能|也许|大概|或许|应该", r"一般|还行|还好|差不多", r"好像|似乎|感觉", r"有点|稍微|略微")

# Unspoken needs, as (need, confidence, pattern, either case).
NEEDS = (
    ("need_clarification", 0.75, r"那个东西|那个|这个|有个问题|怎么说呢|就是那个|叫什么来着|那个什么", False),
    ("need_example", 0.85, r"比如|举例|例子|示范|举个例子|给个例子|比如说|打个比方|比方说|给个示范|show me an example", True),
    ("need_comparison", 0.8, r"哪个好|怎么选|选哪个|区别在哪|有何区别|有什么区别|哪个更|哪一款|哪一种是|哪个比较|如何抉择|选什么好|纠结.*选|选.*纠结", False),
    ("need_decision_support", 0.85, r"不知道选哪个|犹豫|纠结|难以抉择|拿不定主意|下不了决心|举棋不定|左右为难|选A还是选B|该选哪个|选哪个更好|好难选", False),
    ("need_verification", 0.8, r"对吗|正确吗|真的吗|靠谱吗|可信吗|是不是这样|确认一下|核实一下|准确吗|属实吗|有没有问题|可靠吗|verify|check.*if|is.*correct", True),
    ("need_step_by_step", 0.85, r"怎么|步骤|流程|操作|方法|如何做|怎么做|具体怎么做|操作步骤|详细步骤|教程|指南|一步步|手把手|step by step|how to|walk me through", True),
    ("need_simplification", 0.8, r"简单|通俗|易懂|大白话|说人话|讲人话|简单点|通俗点|容易理解|简明|易懂一点|太复杂|太深奥|简单解释|用白话", False),
    ("need_emotional_support", 0.75, r"难过|伤心|郁闷|烦躁|焦虑|压力大|累死了|好累|心累|崩溃|受不了|无助|迷茫|失落|沮丧|绝望|痛苦|难受|不开心|好烦|烦死了|没意思|不想活了|活不下去", False),
)
LOW_MOODS = ("frustrated", "sad", "anxious")

# Words of the four parts of empathy; a word that is listed twice counts twice.
JOY = ("开心", "高兴", "快乐", "兴奋", "幸福", "温暖", "感动", "激动", "笑", "欢呼", "鼓掌", "雀跃", "欢欣", "喜悦", "愉快", "欢乐", "happy", "joy", "excited", "glad", "pleased", "delighted", "elated")
GRIEF = ("难过", "悲伤", "伤心", "痛苦", "沮丧", "失落", "绝望", "崩溃", "哭", "流泪", "哽咽", "哭泣", "哀伤", "悲痛", "凄惨", "惨淡", "sad", "upset", "crying", "tears", "depressed", "grieving", "miserable")
CONCERN = (
    "关心", "关怀", "关爱", "体贴", "心疼", "担忧", "牵挂", "挂念", "担心", "忧虑", "关怀", "在意", "体谅", "理解", "共情", "同感", "心疼你", "为你难过", "替你", "你还好吗", "怎么样",
    "care", "concern", "worry", "support", "compassion", "sympathy", "feel for", "sorry for", "empathy", "kind", "gentle",
)
PERSPECTIVE = (
    "觉得", "认为", "感觉", "理解", "明白", "懂得", "知道", "理解你的", "你怎么想", "你觉得", "我想你可能", "你应该是在", "我想", "估计", "大概", "可能", "或许",
    "think", "feel", "believe", "understand", "imagine", "suppose", "might", "probably", "perhaps", "maybe", "assume", "guess",
)
SPECULATIVE = r"可能|大概|估计|maybe|perhaps|might"
ABOUT_OTHERS, ABOUT_SELF = r"你|your|他人|别人", r"我|my"
SELF_WORDS = ("我觉得", "我认为", "我感到", "我的", "我自己", "我自己")
OTHER_WORDS = ("你觉得", "你感到", "你认为", "你的", "他人", "别人")
BOUNDARY_WORDS = ("但是", "不过", "然而", "可是", "虽然", "但", "然而")
EMPATHY_WEIGHTS = {"contagion": 0.25, "concern": 0.30, "perspective": 0.25, "distinction": 0.20}

# Signs of the four dimensions of an empathy survey, in order; the survey's questions as (dimension, reversed).
INDICATORS = (("PT", r"理解|角度|立场|观点|设身处地"), ("FS", r"比喻|像|故事|电影|小说"), ("EC", r"心疼|关心|同情|安慰|帮助|担心"), ("PD", r"焦虑|紧张|不安|害怕|担心|压力"))

# Behaviour that moves a trait up by TRAIT_STEP, within 1 and 10.
TRAITS = (("O", ("创造", "新", "尝试", "学习")), ("C", ("计划", "完成", "目标", "组织")), ("E", ("社交", "朋友", "分享", "交流")), ("A", ("帮助", "合作", "理解", "支持")), ("N", ("焦虑", "压力", "担心", "紧张")))
TRAIT_STEP = 0.2

# What an agent seems to believe, want, intend and feel.
BELIEFS = (r"认为|相信|觉得|以为|think|believe|feel that", r"知道|了解|意识到|know|aware", r"希望|想要|期待|want|wish|hope")
DESIRES = (r"希望|想要|期待|渴望|need|want|wish|desire", r"避免|不要|不愿|不希望|avoid|dont want")
INTENTIONS = (r"计划|准备|打算|going to|plan to|intend", r"将|会|将要|will/shall")
MOODS = (("joy", r"开心|高兴|兴奋|快乐|happy|excited|joy"), ("anger", r"愤怒|生气|恼火|angry|furious"), ("fear", r"担心|害怕|恐惧|afraid|fear|worried"), ("sad", r"悲伤|难过|失望|sad|disappointed"))

# Words that make a reader defensive, confused or pleased.
DEFENSIVE = ("但是", "不对", "你应该", "实际上", "然而", "but", "should", "however")
CONFUSING = ("可能", "或者", "不确定", "perhaps", "maybe", "not sure")
PLEASING = ("理解", "明白", "支持", "很棒", "不错", "understand", "great", "support")

# Signs of a clear and an unclear question, of feelings in its words.
CLEAR_QUESTION = r"^(对比|什么是|怎么|为什么|如何|怎样|哪个|哪些)"
VAGUE_QUESTION = r"我想知道|请问|能不能|可不可以|有没有"
VAGUE_OBJECT = r"那个东西|这个|一些|某种|之类的"
FEELING = r"生气|愤怒|开心|兴奋|悲伤|失望|焦虑|害怕|感激|感谢"
GOOD_WORDS, BAD_WORDS = r"开心|高兴|喜欢|爱|好|棒|赞|感谢|兴奋", r"生气|愤怒|恨|讨厌|差|烂|伤心|失望|焦虑"

# Rewriting rules by finding, as (pattern, replacement with $ for groups), applied in this order.
REWRITES = {
    "emotional_manipulation": (
        (r"如果你不([^，。]*?)就说明你([^，。]*?)", "我不同意的原因是$1不成立，不代表我$2"), (r"你太自私了", "我认为这个选择更合理"),
        (r"你不在乎(我|我们)", "我希望我们能一起商量"), (r"我为你做了这么多[^，。]*?你却", "我付出了很多，但我理解你也有你的考虑"),
    ),
    "gaslighting": (
        (r"你太敏感了", "我理解你的感受"), (r"我从来没说过", "我可能没有表达清楚"), (r"从来没说过[^。]*?", "我可能没有表达清楚"), (r"没说过[^。]*?", "我可能没有表达清楚，"),
        (r"你想多了[^。]*?", "我理解你的担忧"), (r"哪有这种事", "我不太确定这个情况"), (r"你记错了", "我记得不太一样"), (r"是你(太敏感|想太多|误会了)[^。]*?", "我理解"),
    ),
    "sycophancy": ((r"您(说得|讲的)完全正确[，。]?", "我同意这个观点，"), (r"您是我见过最[^，。]*?的", "您在这个领域很有经验，")),
    "appeal_to_authority": ((r"专家说[^，。]*", "有相关研究表明"), (r"[专家教授博士]认为[^，。]*", "根据现有研究"), (r"科学家(表示|指出|认为)[^，。]*?(，|。)", "有研究指出，")),
    "vagueness": ((r"有关部门", "相关管理部门"), (r"据了解", "根据现有信息"), (r"业内人士", "相关从业者"), (r"可能也许|大概可能", "可能")),
    "pseudo_profundity": (
        (r"从[^，。]*?出发[，,]我们需要", "我们需要"), (r"在[^，。]{0,20}(时代|背景|语境|层面|维度|视角)下", ""), (r"系统性(的|地)?(思维|思考|框架|方法)", "系统"),
        (r"(变革|改革|创新).*(挑战|机遇)", "变化"), (r"赋能(于)?(组织|业务|产业|个体|生态|转型)", "支持"), (r"以[^，。]*?为(核心|导向|抓手|驱动|基础|目标)", ""),
    ),
    "contradiction": ((r"我(完全)?(同意|赞成|支持)([^，。]{0,10})[，。]{0,1}(但是|不过|然而)", "我理解$3，$4"), (r"你说得(对|有道理)[^，。]*?(但是|不过|然而)", "我理解，但是")),
    "double_bind": ((r"你要是[^，。]*?就[^，。]*?(不会|不)", "你如果不愿意，"), (r"你要是有心[^，。]*?你要是没心", "你如果没有这个想法也没关系，")),
    "false_urgency": ((r"最后机会[^，。]*?", "这是一个选择，"), (r"错过这[^，。]*?就(没|不再)", "可以考虑，"), (r"限时(抢购|发售|优惠)", "限时")),
}
#: After all rules: runs of marks and blanks become one.
TIDY = ((r"[，,]{2,}", "，"), (r"[。.]{2,}", "。"), (r"  +", " "))


def hits(text: Column, patterns: tuple[str, ...], ignore: bool = True) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [Match(p, ignore).column(text).cast("int") for p in patterns])


def places(text: Column, patterns: tuple[str, ...]) -> Column:
    """At how many places the patterns match, each on its own."""
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(_flag(p) + java(p))) for p in patterns])


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, [text.contains(F.lit(w)).cast("int") for w in words])


def _flag(pattern: str) -> str:
    return "" if pattern in EXACT_CASE else "(?i)"


def _half_up(x: Column, digits: int = 2) -> Column:
    return F.floor(x * 10**digits + 0.5 + 1e-9) / 10**digits


def windows(text: Column, pattern: str, before: int, after: int) -> Column:
    """The surroundings of every match: ``before`` characters ahead of its begin and ``after`` from its begin on.

    The text is cut before each match, once, and only if it has one. Every piece but the
    first has a character at least, so as many pieces as characters are looked at hold them.
    """
    mark = "\x01"
    cut = F.split(F.regexp_replace(F.replace(text, F.lit(mark), F.lit(" ")), f"({pattern})", f"{mark}$1"), mark, -1)
    ahead = lambda x, k: F.right(F.array_join(F.slice(x, F.greatest(F.lit(1), k - before), F.least(k, F.lit(before + 1))), ""), F.lit(before))
    behind = lambda x, k: F.left(F.array_join(F.slice(x, k + 1, F.lit(after)), ""), F.lit(after))
    found = F.get(F.transform(F.array(cut), lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda k: F.concat(ahead(x, k), behind(x, k)))), 0)
    return F.when(text.rlike(pattern), found).otherwise(F.expr("cast(array() as array<string>)"))


def sql_windows(text: str, pattern: str, before: int, after: int) -> str:
    """``windows`` in DuckDB's SQL: a list."""
    cut = f"string_split(regexp_replace({text}, {sql_text('(' + pattern + ')')}, chr(1) || '\\1', 'g'), chr(1))"
    return f"list_transform(range(1, len({cut})), lambda k: right(array_to_string(({cut})[1:k], ''), {before}) || left(array_to_string(({cut})[k + 1:], ''), {after}))"


def misuse(text: Column) -> dict[str, Column]:
    """Counts of the habits by kind, and the score: 1 without any, else 1 less the mean severity; 0 for no text."""
    alone = [F.size(F.filter(windows(text, _flag(p) + java(p), ERROR_SPAN, ERROR_SPAN), lambda w: ~w.rlike(ERROR_CONTEXT))) for p in BARE_ERROR]
    counts = {
        "overload": places(text, OVERLOAD),
        "bare_error": reduce(lambda a, b: a + b, alone),
        "unverified": places(text, UNVERIFIED),
        "repeated_fixes": (places(text, SMALL_FIXES) >= LEAST_FIXES).cast("int"),
        "scapegoat": places(text, SCAPEGOAT),
    }
    return {k: F.coalesce(c, F.lit(0)) for k, c in counts.items()}


def misuse_score(text: Column, counts: dict[str, Column]) -> Column:
    total = reduce(lambda a, b: a + b, counts.values())
    weight = reduce(lambda a, b: a + b, [counts[k] * MISUSE_SEVERITY[k] for k in counts])
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - weight / total))


_SMOOTHED_ZH, _SMOOTHED_EN = any_of(*SMOOTHED_ZH), any_of(*SMOOTHED_EN, ignore=True)

#: A conflict that is noticed and smoothed over in the same text, unless it is handed on or split into cases.
UNRESOLVED_CONFLICT = Detector(
    "unresolved_conflict",
    routes=((All(any_of(*NOTICED_ZH) | any_of(*NOTICED_EN, ignore=True), _SMOOTHED_ZH | _SMOOTHED_EN), CONFLICT_SCORE),),
    exempt=(
        any_of(*HANDED_ON_ZH),
        any_of(*HANDED_ON_EN, ignore=True),
        All(Match(SPLIT_ZH), Not(_SMOOTHED_ZH)),
        All(Match(SPLIT_EN, True), Not(_SMOOTHED_EN)),
    ),
    least_chars=1,
)


def state_risk(text: Column, action: Column) -> Column:
    """(score, words, state, separable, alert) of a text and the consequence of the planned action (null for none)."""
    low, act = F.lower(text), F.lower(F.coalesce(action, F.lit("")))
    words = Match(DANGER_WORDS).column(low).cast("int")
    state = (Match(DANGER_STATE).column(low) | Match(DANGER_STATE).column(act)).cast("int")
    gap = state * Match(HARMLESS_NAME).column(low).cast("int")
    score = F.least(F.lit(1.0), RISK_WEIGHTS["text"] * words + RISK_WEIGHTS["state"] * state + RISK_WEIGHTS["gap"] * gap)
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    found = F.struct(score.alias("score"), words.alias("words"), state.alias("state"), ((words == 0) & (state == 1)).alias("separable"), (score >= RISK_ALERT).alias("alert"))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("words"), F.lit(0).alias("state"), F.lit(False).alias("separable"), F.lit(False).alias("alert"))
    return F.when(empty, none).otherwise(found)


def safest(actions: DataFrame, group: str, text_col: str = "text", action_col: str = "action", order_col: str = "id") -> DataFrame:
    """The action of each group with the least risk, the first in ``order_col`` of equals: one partial aggregation."""
    scored = actions.withColumn("risk", state_risk(F.col(text_col), F.col(action_col))["score"])
    return scored.groupBy(group).agg(F.min(F.struct("risk", order_col)).alias("m")).select(group, f"m.{order_col}", "m.risk")


def tone(text: Column) -> Column:
    """(urgency, emotion, formality, intensity) of a text; an empty one is low, neutral, casual and 0."""
    q = F.trim(F.lower(text))
    urgency = reduce(lambda a, b: a + b, [hits(q, ps) * w for w, ps in URGENCY])
    emotion, share = F.lit("neutral"), F.lit(0.0)
    for name, part, patterns in reversed(EMOTIONS):
        hit = any_of(*patterns, ignore=True).column(q)
        emotion, share = F.when(hit, name).otherwise(emotion), F.when(hit, F.lit(part)).otherwise(share)
    formal, casual, technical = (hits(q, p) for p in (FORMAL, CASUAL, TECHNICAL))
    bangs, asks = F.regexp_count(q, F.lit("[！!]")), F.regexp_count(q, F.lit("[？?]"))
    runs = F.regexp_count(q, F.lit(r"([一-鿿])\1{2,}"))
    strength = (
        F.lit(0.5) + share
        + F.when(bangs > 2, 0.2).when(bangs > 0, 0.1).otherwise(0.0)
        + F.when(asks >= 3, 0.1).otherwise(0.0)
        + F.when(any_of(*STRONGER, ignore=True).column(q), 0.08).otherwise(0.0)
        + F.least(runs * 0.08, F.lit(0.15))
        + F.when(F.length(q) < 5, 0.1).when(F.length(q) > 200, -0.1).otherwise(0.0)
        - F.when(any_of(*WEAKER, ignore=True).column(q), 0.05).otherwise(0.0)
    )
    found = F.struct(
        F.when(urgency >= 3, "high").when(urgency >= 1, "medium").otherwise("low").alias("urgency"),
        emotion.alias("emotion"),
        F.when((technical > 0) & (technical >= casual), "technical").when(formal > casual, "formal").otherwise("casual").alias("formality"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), _half_up(strength))).alias("intensity"),
    )
    none = F.struct(F.lit("low").alias("urgency"), F.lit("neutral").alias("emotion"), F.lit("casual").alias("formality"), F.lit(0.0).alias("intensity"))
    return F.when(F.coalesce(F.length(q), F.lit(0)) == 0, none).otherwise(found)


def implicit_needs(text: Column, emotion: Column) -> Column:
    """(need, confidence) of the unspoken needs, most confident first, then in declared order; a low mood adds to or gives the last one."""
    low = F.coalesce(emotion.isin(*LOW_MOODS), F.lit(False))
    rows = []
    for at, (name, sure, pattern, ignore) in enumerate(NEEDS):
        hit = Match(pattern, ignore).column(text)
        value = F.when(hit, F.lit(sure))
        if name == "need_emotional_support":
            value = F.when(hit & low, F.lit(min(0.95, sure + 0.1))).when(hit, F.lit(sure)).when(low, F.lit(0.7))
        rows.append(F.struct((-value).alias("minus"), F.lit(at).alias("place"), F.lit(name).alias("need"), value.alias("confidence")))
    found = F.array_sort(F.filter(F.array(*rows), lambda x: x["confidence"].isNotNull()))
    return F.transform(found, lambda x: F.struct(x["need"].alias("need"), x["confidence"].alias("confidence")))


def _concern(low: Column, words: Column) -> Column:
    """The part of concern: the words of it that a text holds, and whether more of them, at their first places, are about others than about its writer."""

    def about(w: Column) -> Column:
        at = F.instr(low, w) - 1
        start = F.greatest(F.lit(0), at - 5)
        around = F.substring(low, start + 1, at + F.length(w) + 5 - start)
        return F.when(around.rlike(ABOUT_OTHERS), 1).when(around.rlike(ABOUT_SELF), -1).otherwise(0)

    more = F.aggregate(words, F.lit(0), lambda n, w: n + about(w))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.least(F.lit(0.8), F.size(words) * 0.3) + F.when(more > 0, 0.2).otherwise(0.0)))


def empathy(text: Column, low: Column | None = None) -> Column:
    """(contagion, concern, perspective, distinction, score, level) of a text; ``low``: a column that has it in lower case."""
    low = F.lower(text) if low is None else low
    feelings = holds(low, JOY) + holds(low, GRIEF)
    contagion = F.least(F.lit(1.0), feelings / F.lit(3.0))
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    concern = once(F.filter(F.array(*[F.lit(w) for w in CONCERN]), lambda w: low.contains(w)), lambda words: _concern(low, words))
    seen = reduce(lambda a, b: a + b, [F.when(low.contains(F.lit(w)), F.regexp_count(low, F.lit(w))).otherwise(0) for w in PERSPECTIVE])
    # a speculative word is one of PERSPECTIVE itself, so it stands in its own surroundings
    guessed = low.rlike(SPECULATIVE)
    perspective = once(seen, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.least(F.lit(0.9), n * 0.25) + F.when(guessed, 0.1).otherwise(0.0))))
    mine, yours, edge = holds(low, SELF_WORDS) > 0, holds(low, OTHER_WORDS) > 0, holds(low, BOUNDARY_WORDS) > 0
    distinction = F.when(mine & yours, 0.5).otherwise(0.0) + F.when(edge, 0.3).otherwise(0.0) + F.when(mine | yours, 0.2).otherwise(0.0)
    parts = {"contagion": contagion, "concern": concern, "perspective": perspective, "distinction": distinction}

    def judged(x: Column) -> Column:
        score = reduce(lambda a, b: a + b, [x[k] * w for k, w in EMPATHY_WEIGHTS.items()])
        level = F.when(score >= 0.7 - 1e-9, "high").when(score >= 0.4 - 1e-9, "moderate").when(score > 0, "low").otherwise("none")
        return F.struct(*[_half_up(x[k]).alias(k) for k in parts], _half_up(score).alias("score"), level.alias("level"))

    blank = F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0
    found = once(F.struct(*[v.alias(k) for k, v in parts.items()]), judged)
    none = F.struct(*[F.lit(0.0).alias(k) for k in (*parts, "score")], F.lit("none").alias("level"))
    return F.when(blank, none).otherwise(found)


def empathy_indicators(text: Column) -> Column:
    """(PT, FS, EC, PD, empathic, dominant) of a text; the first of equal dimensions dominates."""
    flags = {name: Match(p).column(F.lower(text)).cast("int") for name, p in INDICATORS}
    dominant = F.lit(INDICATORS[0][0])
    for name in reversed(list(flags)):
        dominant = F.when(flags[name] == 1, name).otherwise(dominant)
    return F.struct(*[c.alias(k) for k, c in flags.items()], ((flags["EC"] > 0) | (flags["PT"] > 0)).alias("empathic"), dominant.alias("dominant"))


def survey_score(answers: dict[str, list[tuple[Column, bool]]]) -> Column:
    """The empathy total of a survey, 0 to 100: means of 1 to 5 by dimension (rounded to tenths; reversed answers count 6 less), their mean times 20."""
    means = [_half_up(reduce(lambda a, b: a + b, [6 - a if back else a for a, back in given]) / F.lit(float(len(given))), 1) for given in answers.values()]
    return F.floor(reduce(lambda a, b: a + b, means) / F.lit(4.0) * 20 + 0.5).cast("int")


def trait_changes(text: Column) -> dict[str, Column]:
    """The step of each trait that the described behaviour gives."""
    return {name: F.when(holds(F.lower(text), words) > 0, F.lit(TRAIT_STEP)).otherwise(F.lit(0.0)) for name, words in TRAITS}


def trait_score(old: Column, change: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), old + change))


def agent_minds(said: DataFrame, agent: str, order: list[str], text_col: str = "text") -> DataFrame:
    """One row an agent: beliefs, desires, plan and mood by marker, over all it said.

    Flags are aggregated, so no text is collected or shuffled: a marker of two words
    that is broken between two observations is not found. The plan is the earliest match
    of the first marker that has any.
    """
    text = F.col(text_col)
    flag = lambda p: F.max(Match(p, True).column(text).cast("int"))
    first = lambda p: F.min(F.when(text.rlike("(?i)" + p), F.struct(*order, F.regexp_extract(text, "(?i)(" + p + ")", 1).alias("hit"))))
    rows = said.groupBy(agent).agg(
        *[flag(p).alias(f"b{i}") for i, p in enumerate(BELIEFS)],
        *[flag(p).alias(f"d{i}") for i, p in enumerate(DESIRES)],
        *[first(p).alias(f"i{i}") for i, p in enumerate(INTENTIONS)],
        *[flag(p).alias(f"m_{m}") for m, p in MOODS],
    )
    mood = F.lit("neutral")
    for m, _ in reversed(MOODS):
        mood = F.when(F.col(f"m_{m}") == 1, m).otherwise(mood)
    return rows.select(
        agent,
        reduce(lambda a, b: a + b, [F.coalesce(F.col(f"b{i}"), F.lit(0)) for i in range(len(BELIEFS))]).alias("beliefs"),
        reduce(lambda a, b: a + b, [F.coalesce(F.col(f"d{i}"), F.lit(0)) for i in range(len(DESIRES))]).alias("desires"),
        F.coalesce(*[F.col(f"i{i}.hit") for i in range(len(INTENTIONS))], F.lit("unknown")).alias("plan"),
        F.when(F.coalesce(*[F.col(f"i{i}.hit") for i in range(len(INTENTIONS))]).isNull(), 0.1).otherwise(0.6).alias("plan_confidence"),
        mood.alias("mood"),
    )


def reaction(draft: Column, style: Column, sensitivity: Column, pleasure: Column) -> Column:
    """(predicted, confidence) of a reader's reaction to a draft."""
    low = F.lower(draft)
    hurt = holds(low, DEFENSIVE) * F.when(sensitivity >= 7, 1.5).otherwise(1.0)
    lost, glad = holds(low, CONFUSING), holds(low, PLEASING)
    first = (
        F.when((pleasure < -3) & (hurt > 0), "negative")
        .when((style == "direct") & (lost > 1), "confused")
        .when((style == "direct") & (hurt > 0), "defensive")
        .when((style == "empathetic") & (glad > 0) & (hurt == 0), "positive")
    )
    predicted = F.coalesce(first, F.when(glad > hurt, "positive").when(hurt > glad, "defensive").otherwise("neutral"))
    return F.struct(predicted.alias("predicted"), F.least(F.lit(0.9), 0.4 + (hurt + glad) * 0.1).alias("confidence"))


def annotation(source: Column, intent: Column, entities: Column, emotion: Column) -> Column:
    """(intent, entity, tone, overall, flags) confidences of an understood question."""
    src = F.trim(F.coalesce(source, F.lit("")))
    named = F.lower(F.coalesce(intent, F.lit("")))
    m = lambda p: Match(p).column(src)
    of_intent = (
        F.when(m(CLEAR_QUESTION), 0.9).when((named != "") & (named != "general"), 0.85).when(m(VAGUE_QUESTION), 0.7).when(m(VAGUE_OBJECT), 0.4).when(src == "", 0.3).otherwise(0.6)
    )
    size = F.coalesce(F.size(entities), F.lit(0))
    proper = F.size(F.filter(entities, lambda e: e.rlike("^[A-Z一-鿿]") & (F.length(e) >= 2)))
    ratio = proper / F.greatest(size, F.lit(1))
    rare = F.exists(entities, lambda e: e.rlike(r"[^a-zA-Z0-9一-鿿\s_-]") | ((F.length(e) <= 1) & e.rlike("[a-zA-Z]")))
    plain = F.when(size <= 0, 0.4).when(ratio >= 0.6, 0.9).when(ratio >= 0.3, 0.7).otherwise(0.5)
    odd = (size > 0) & rare
    of_entity = F.when(odd, F.least(plain, F.lit(0.3))).otherwise(plain)
    mood = F.coalesce(emotion, F.lit(""))
    mixed = m(GOOD_WORDS) & m(BAD_WORDS)
    early = m(FEELING) | ((mood != "") & (mood != "neutral")) | ((F.length(src) > 0) & (F.length(src) < 10))
    of_tone = F.when(m(FEELING), 0.85).when((mood != "") & (mood != "neutral"), 0.8).when((F.length(src) > 0) & (F.length(src) < 10), 0.6).when(mixed, 0.4).when(src == "", 0.5).otherwise(0.65)
    missing = of_intent == 0.3
    flags = F.array(
        F.when(missing, "missing_context"), F.when(odd, "multiple_interpretations"), F.when(~early & mixed, "contradictory_signals"), F.when((of_intent < 0.6) & ~missing, "ambiguous_intent")
    )
    overall = _half_up(of_intent * 0.35 + of_entity * 0.35 + of_tone * 0.30)
    return F.struct(of_intent.alias("intent"), of_entity.alias("entity"), of_tone.alias("tone"), overall.alias("overall"), F.filter(flags, lambda f: f.isNotNull()).alias("flags"))


def rewrite(text: Column, findings: Column) -> Column:
    """The text after the rules of each finding (an array of names), each name once and in order; then runs of marks become one."""

    def step(state: Column, name: Column) -> Column:
        out = state
        for known, rules in REWRITES.items():
            changed = state
            for pattern, to in rules:
                changed = F.regexp_replace(changed, java(pattern), to)
            out = F.when(name == known, changed).otherwise(out)
        return out

    out = F.aggregate(F.array_distinct(findings), text, step)
    for pattern, to in TIDY:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def same_json(left: Column, right: Column) -> Column:
    """Whether two JSON texts have equal values, whatever the order of keys and blanks; invalid texts equal nothing."""
    canonical = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(canonical(left) == canonical(right), F.lit(False))


def sql_hits(text: str, patterns: tuple[str, ...], ignore: bool = True) -> str:
    return "(" + " + ".join(f"({Match(p, ignore).sql(text)})::INT" for p in patterns) + ")"


def sql_places(text: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {sql_text(_flag(p) + p)}))" for p in patterns) + ")"


def sql_holds(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, {sql_text(w)})::INT" for w in words) + ")"


def sql_any(text: str, patterns: tuple[str, ...], ignore: bool = True) -> str:
    some: Expr = any_of(*patterns, ignore=ignore)
    return some.sql(text)
