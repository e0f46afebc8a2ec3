"""Detectors of argument patterns: each a length guard, exemptions, and routes with a score.

The word lists and patterns are fixed values; the structure around them is in
``rules``. All detectors run in one projection (``rules.detect``).
"""

from __future__ import annotations

from quern.operators.rules import AtLeast, Cjk, Contains, Detector, Expr, Match, Not, Some, any_literal, any_of, by_language


def zh(*patterns: str) -> Expr:
    return any_of(*patterns)


def en(*patterns: str) -> Expr:
    return any_of(*patterns, ignore=True)


# -- appeal to majority ---------------------------------------------------------------
# Fixed values.
MAJORITY_ZH = "大家都|大伙都|所有人都|这么多人|那么多人|大多数人|多数人|群众|全网|销量第[一二三四五]|用户基数|用户量|下载量|排行第[一二三四五]|排名第[一二三四五]|人人[都在都]|所有人都在|很多人|不少人|普遍|主流|大伙|十个人|九成|八成|七成|一半以上|过半|半数|乡亲们|粉丝|用户都|人们都|网友都|都在[夸赞好用说]|都在学|都在买"
MAJORITY_EN = r"\b(?:everyone|everybody|millions?\s+of|the\s+majority|most\s+people|majority\s+(?:of|agrees|believes|thinks)|widely\s+(?:used|accepted|believed)|popular\s+(?:opinion|belief)|everyone\s+(?:believes|thinks|knows|agrees|uses)|people\s+believe|nobody\s+(?:believes|thinks)|millions?\s+of\s+fans|widely\s+held|commonly\s+(?:believed|accepted|known)|most\s+(?:experts|users|reviewers|critics)\s+(?:agree|think|say|recommend))\b"
MAJORITY_SO_ZH = "肯定[是对好]|一定是[对好]|准没?错|跟着[^。]{0,8}走就行|跟着[^。]{0,8}准没错|说明[^。]{0,14}(?:没问题|是对的|肯定行|不可靠|有问题|不行|最好|最差|靠谱)|证明[^。]{0,14}(?:有效|是对的|没问题|不行)|质量[^。]{0,6}(?:肯定|一定)[^。]{0,4}(?:最好|最差|好|差)|肯定[不行好有错]|肯定不会?错|不会有?错|这[还那][能]?[有假]?[是假]|他不[火红]谁[火红]|还能有假|有什么可怀疑|不容置疑|铁定的事实"
MAJORITY_SO_EN = r"\b(?:so\s+it\s+must\s+be|it\s+cannot\s+be\s+wrong|therefore\s+it\s+is|that\s+proves\s+(?:it|that)|it\s+must\s+be\s+(?:true|right|good|correct)|so\s+it\s+has\s+to\s+be|which\s+proves|must\s+be\s+(?:true|right|good)|so\s+he\s+must\s+be|so\s+they\s+must\s+be|has\s+to\s+be\s+(?:true|right|good|the\s+best)|cannot\s+be\s+wrong\s+about|so\s+it\s+will)\b"
MAJORITY_META = r"诉诸多数|appeal\s+to\s+(?:the\s+)?majority|bandwagon\s+fallacy|appeal\s+to\s+popularity|诉诸公众|从众谬误|乐队花车谬误"
MAJORITY_EVIDENCE = "数据|调研|样本|统计|调查|投票结果|问卷|报告|文献|论文|数据显示|统计显示|survey|sample|poll|data|statistic|research|study|census|questionnaire"
TAUGHT = r"逻辑学老师|逻辑老师|哲学老师|批判性思维课程|教材|课本|课堂上|讲师|教授说|老师说|textbook|lecture|professor|in\s+class|teacher\s+said"

APPEAL_TO_MAJORITY = Detector(
    "appeal_to_majority",
    ((by_language(zh(MAJORITY_ZH) & zh(MAJORITY_SO_ZH), en(MAJORITY_EN) & en(MAJORITY_SO_EN)), 0.5),),
    (en(MAJORITY_META), en(MAJORITY_EVIDENCE), en(TAUGHT)),
)

# -- appeal to probability ------------------------------------------------------------
# Fixed values.
SCALE_ZH = (
    "这么[大广多长]", "那么[大广多]", "[0-9一二三四五六七八九十百千万亿]+亿?[多]?人", "这么多人", "天天[飞跑有来发生开]", "满地[都也]?是", "遍地[都也]?是", "满大街",
    "试多了", "试这么[多长]", r"多试[几些\d]+[次遍回把]", "重复次数[够足][多了]", r"投了?[\d三百两千]+[份篇]", "投得够多", "发得够多", r"蒙[个些]?[\d几一两十]{1,4}[道题]",
    "练这么[多长遍]", r"刷了?[\d这么几]+遍", "买这么[多长次]", "坚持这么[久长]", "宇宙这么[大广]", "世上[这么那]么[多广]", "每天这么[多长]", "基数[这大么那]",
    "次数够多", "时间[够足]够?长", "样本[这大么那]", "这么[高强]", "那么[高]", "[希望胜算机会把握][这那]么[大高多好]",
)
SCALE_EN = (
    r"\bso\s+(?:many|vast|large|big|much|numerous|widespread)\b", r"\b(?:billions?|millions?|trillions?)\s+of\b", r"\b(?:hundreds|thousands|millions)\s+of\b",
    r"\bgiven\s+enough\s+time\b", r"\benough\s+(?:time|times|attempts|tries|shots|rolls|repetition)\b", r"\bkeep\s+(?:playing|trying|applying|rolling|buying|going)\b",
    r"\bif\s+(?:I|you|we|they)\s+keep\b", r"\bso\s+many\s+(?:people|tickets|applications|attempts|tries|rolls|shots)\b", r"\bvast\s+(?:universe|number|majority|pool)\b",
    r"\bnumerous\s+(?:attempts|tries|applications)\b", r"\bwith\s+enough\s+(?:time|attempts|tries|repetition)\b", r"\brepeated(?:ly)?\s+enough\b",
)
CERTAIN_ZH = (
    "肯定[有会成对中赶来赢到]", "一定会", "一定[会能发生成有中来赢对到]", "必然[会有成在发生是]", "必[中注定成]", "迟早[会有成来]", "总[有能该][一会成到来中赢对]",
    "不可能不(?:发生|存在|中|是|赢)", "不可能发生", "稳[了赢]", "逃不掉", "躲不掉", "跑不掉", "凭什么不是我", "总有一[天次家个]", "还会远吗", "肯定[跑逃溜]不了", "铁定", "十有八九", "准[会能]?[发生中来成]",
)
CERTAIN_EN = (
    r"\bmust\s+be\b", r"\bthere\s+must\s+be\b", r"\bbound\s+to\b", r"\bguaranteed\b", r"\bhas\s+to\s+(?:happen|win|hit|work|come|be)\b", r"\binevitable\b",
    r"\bwill\s+(?:eventually\s+)?happen\b", r"\bsooner\s+or\s+later\b", r"\bwhy\s+not\s+me\b", r"\bmust\s+win\b", r"\bis\s+sure\s+to\b", r"\bare\s+sure\s+to\b", r"\bcertain\s+to\b",
)
ODDS_ZH = (
    "概率[很极太][低小不高]", "概率不大", "小概率", "不代表", "不保证", "不能保证", "不能说明", "不等于必然", "不意味着一定", "不是必然", "不等于一定", "不能心存侥幸", "不能当",
    "大数定律", "独立事件", "随机", "没有[^。]{0,6}证据", "尚未发现", "幸存者", "不能排除",
)
ODDS_EN = (
    r"\blow\s+probability\b", r"\bimprobable\b", r"\bdoes\s+not\s+guarantee\b", r"\bno\s+guarantee\b", r"\bnot\s+a\s+guarantee\b", r"\bno\s+evidence\b",
    r"\bodds\s+are\s+(?:low|against)\b", r"\bpossible\s+but\b", r"\bcannot\s+be\s+sure\b", r"\blaw\s+of\s+large\s+numbers\b", r"\brandom\b", r"\bnot\s+necessarily\b",
)

APPEAL_TO_PROBABILITY = Detector(
    "appeal_to_probability",
    ((by_language(zh(*SCALE_ZH) & zh(*CERTAIN_ZH), en(*SCALE_EN) & en(*CERTAIN_EN)), 0.5),),
    (
        en("诉诸概率", r"appeal\s+to\s+probability", "可能性误当必然"),
        zh(*ODDS_ZH) | en(*ODDS_EN),
        en("老师", "教材", "课本", "课堂上", "教授说", "textbook", "lecture", "professor", r"\bin\s+class\b", r"\bteacher\s+said\b"),
    ),
)

# -- appeal to ridicule ---------------------------------------------------------------
# Fixed values.
RIDICULE_ZH = "(?:可笑|搞笑|笑话|蠢|幼稚|天真|弱智|无脑|让人无语|无语|好意思|不过如此)|(?:笑死|笑哭)|(?:智商|脑子)(?:堪忧|进水|有问题|呢)"
RIDICULE_EN = r"\b(?:ridiculous|laughable|hilarious|pathetic|nonsensical|preposterous|absurd|stupid|idiotic|moronic|brain[\s-]?dead|dim[\s-]?witted|childish|naive|silly)\b|\b(?:lol|lmao|haha+)\b|\b(?:your\s+)?(?:iq|intelligence|brain)\s+(?:is\s+)?(?:concerning|questionable|suspect|low|lacking)\b"
RIDICULED_ZH = "(?<![我你])(?:这种|这个|这么|这也|这叫|就这|这算|那算)(?:什么)?(?:想法|观点|论调|方案|逻辑|设计|说法|主意|水平|东西|叫|信|想)|你(?:的|这个|这种|这么|那么)?(?:方案|逻辑|想法|观点|设计|说法|主意|水平|脑子|智商|作品|成果|产出|回答|结论)|(?:拿出来说|敢发言|也敢说|也敢讲)"
RIDICULED_EN = r"\b(?:this|that|such\s+a|what\s+a)\s+(?:\w+\s+){0,2}?(?:idea|argument|proposal|plan|logic|reasoning|claim|approach|design|conclusion|level|nonsense)\b|\byour\s+(?:idea|argument|proposal|plan|logic|reasoning|claim|approach|design|conclusion|level|brain|iq|work|output)\b|\byou\s+call\s+this\b|\byou\s+(?:believe|trust|buy)\s+this\b|\bdare\s+to\s+speak\b|\bonly\s+someone\s+like\s+you\b"
MOCKING_ZH = "亏你想得出来|也只有你|只有你能有|不值一驳|脑子正常的人都不会|就这水平|也只有你了"
MOCKING_EN = r"\bcan'?t\s+believe\s+you\s+came\s+up\s+with\s+this\b|\bnot\s+even\s+worth\s+refuting\b|\banyone\s+with\s+a\s+functioning\s+brain\b|\bwith\s+this\s+level\b"
DEFECT_ZH = "(?:可笑|搞笑|蠢|幼稚|天真|弱智)的?(?:漏洞|问题|缺陷|错误|疏漏|不足|待改进)"
DEFECT_EN = r"\b(?:ridiculous|laughable|stupid|absurd|pathetic|childish)\s+(?:flaw|problem|bug|defect|error|issue|mistake|gap)\b"
RIDICULE_META_ZH = "(?:这|那就是|这就是|这正是|那正是|属于|属于一种|就是)(?:一种|典型的|常见的|经典的|隐性|常见|典型|明显)?(?:诉诸嘲讽|嘲讽论证|揶揄谬误)|(?:诉诸嘲讽|嘲讽论证|揶揄谬误)(?:是|属于|是一种|正是)(?:一种|典型的|常见的|经典的|隐性|常见|典型)?(?:谬误|谬说|逻辑错误|逻辑谬误|错误论证|非形式谬误|话术|手法|手段|策略|伎俩|套路|现象|问题|错误)"
RIDICULE_META_EN = r"\bappeal\s+to\s+ridicule\s+(?:is|are)\s+(?:a\s+)?(?:fallacy|manipulation|tactic|rhetorical|technique|form\s+of|symptom\s+of|common)\b|\b(?:is|are|means|called?)\s+appeal\s+to\s+ridicule\b"

APPEAL_TO_RIDICULE = Detector(
    "appeal_to_ridicule",
    ((Some(zh(MOCKING_ZH), en(MOCKING_EN), (zh(RIDICULE_ZH) | en(RIDICULE_EN)) & (zh(RIDICULED_ZH) | en(RIDICULED_EN))), 0.55),),
    (zh(RIDICULE_META_ZH) | en(RIDICULE_META_EN), zh(DEFECT_ZH) | en(DEFECT_EN)),
)

# -- complexity shield ----------------------------------------------------------------
# Fixed values.
COMPLEX_ZH = "(?:太|非常|极其|特别|相当|很|颇)?(?:复杂|专业性|专业度|技术性|门槛)(?:的|得)?|(?:很深|艰深|高深)(?:的)?(?:理论|学问|知识|问题|学问)|(?:专业|技术)(?:门槛|壁垒)(?:很|极)?高|(?:高的)?(?:专业|技术)(?:门槛|壁垒)|不是(?:一般人|普通人|外行)(?:能|可以)?(?:理解|看懂|明白|懂)的|(?:需要|得有)(?:多年|长期)(?:的)?(?:专业)?(?:训练|积累|功底)|(?:门外汉|外行)(?:不可能|无法|不能)(?:理解|看懂|明白)"
COMPLEX_EN = r"\b(?:too|highly|extremely|very|rather|quite)\s+(?:complex|complicated|technical|sophisticated|intricate|advanced)|(?:highly\s+)?(?:complex|technical)\s+(?:issue|topic|subject|matter|question)|(?:deep|profound)\s+(?:theoretical|technical)\s+(?:issue|question|problem|matter)|(?:technical|specialist)\s+(?:barriers?\s+to\s+entry|knowledge|details)|beyond\s+(?:the\s+)?(?:understanding|comprehension|grasp)\s+of|(?:ordinary|average|normal|regular)\s+(?:investors?|people|users?|persons?|folks?)\s+(?:cannot|could\s+not|can'?t|can\s+not)\s+(?:understand|comprehend|grasp|follow)|(?:cannot|could\s+not|can'?t|can\s+not)\s+be\s+(?:understood|comprehended|grasped)\s+(?:easily|readily|quickly)|(?:requires?|takes?)\s+(?:years|decades)\s+of\s+(?:specialist|technical|professional|advanced)\s+(?:training|study|expertise)|\btoo\s+(?:technical|complex|complicated|sophisticated|intricate|advanced)\s+(?:for|to)\s+(?:you|your\s+(?:level|understanding|mind)|the\s+(?:ordinary|average|lay))"
BEYOND_YOU_ZH = "(?:你|你们|以你(?:的)?(?:水平|程度|学历|认知|智商|脑子|能力)|一般人|普通人|普通人等|外行|门外汉|非专业|普通(?:投资者|人|用户|消费者))(?:是|根本|压根儿|压根|也)?(?:不可能|无法|不能|没法|难以|不一定)(?:理解|懂|明白|看懂|听懂|领会)(?:得了)?的?|(?:你|你们)(?:是)?(?:听不懂|听不明白|看不明白|理解不了|弄不懂|搞不懂|不会懂|不可能懂)|(?:理解|听懂|看懂|弄懂|搞懂)不了|说(?:了)?你(?:也)?(?:听不懂|不明白|不理解|不懂)|以(?:你|你们)(?:的)?(?:水平|认知|智商|脑子)(?:是)?(?:理解|听懂|看懂|弄懂|搞懂)不了|(?:你|你们)(?:也|是)?(?:弄|搞|听|看)?不懂"
BEYOND_YOU_EN = r"\byou\s+(?:would\s+not|wouldn'?t|will\s+not|won'?t|cannot|can'?t|could\s+not|couldn'?t)\s+(?:understand|comprehend|grasp|follow|appreciate|get)\b|\byou\s+(?:are|'re)\s+(?:not\s+)?(?:smart|qualified|equipped|trained)\s+enough\s+to\s+(?:understand|comprehend|grasp|follow)|\bbeyond\s+your\s+(?:level|understanding|comprehension|grasp|paygrade|ken)\b|\babove\s+your\s+(?:level|paygrade|understanding)\b|\byou\s+(?:lack|don'?t\s+have)\s+the\s+(?:background|training|expertise|knowledge)\s+to\s+(?:understand|comprehend|grasp|follow)|\b(?:ordinary|average|normal|regular|lay|individual|retail|small)\s+(?:investors?|people|users?|persons?|folks?|consumers?|shareholders?|bulls?|humans?)\s+(?:cannot|could\s+not|can'?t|can\s+not|will\s+not|won'?t|are\s+unable\s+to|are\s+not\s+able\s+to|would\s+not|wouldn'?t)\s+(?:understand|comprehend|grasp|follow|figure\s+out|make\s+sense\s+of)|\b(?:cannot|could\s+not|can'?t|can\s+not)\s+be\s+(?:comprehended|understood|grasped)\s+by\s+(?:ordinary|average|normal|regular|lay)|\btoo\s+(?:complex|complicated|technical|sophisticated|intricate|advanced|subtle)\s+(?:for|to)\s+(?:you|your\s+(?:level|understanding|mind|head)|the\s+(?:ordinary|average|lay)|anyone|them)\b"
NO_EXPLAIN_ZH = "(?:别|不要|不用|不必|甭)(?:再?)?(?:问|追问|深究|打听|了解|操心)|(?:照做|照办|听话|执行)(?:就)?(?:行|好|对)|(?:相信|信任|交给)我们(?:就)?(?:行|好|对|没错)?|(?:不需要|不必|无须|不用)(?:知道|了解|明白|懂)(?:为什么|其中原理|原理|细节|太多)|(?:知道|了解)(?:太多|那么细|那么深)(?:对你|对你们)?(?:没|也)?有?好处|(?:不好奇|好奇心)(?:太强|别那么|不要那么)|(?:执行|照做)(?:就|即)?可，?不?要?问"
NO_EXPLAIN_EN = r"\bjust\s+(?:trust|believe|follow)\s+(?:us|me|them|the\s+(?:experts?|process|system|model|algorithm))\b|\b(?:trust|believe|follow)\s+(?:us|me|them)\b|\bdo\s+(?:as|what)\s+(?:you\s+are|you'?re)\s+told\b|\bdon'?t\s+(?:ask|question)\b|\bno\s+(?:need|point)\s+(?:to|in)\s+(?:ask|know|understand)|\byou\s+(?:don'?t|do\s+not)\s+need\s+to\s+(?:know|understand|ask)\b|\bstop\s+asking\b|\btake\s+(?:it|this|that)\s+on\s+faith\b|\bjust\s+(?:do\s+)?as\s+(?:you'?re|you\s+are)\s+told\b"
TRANSPARENT_ZH = r"(?:我|我们)(?:来)?(?:分步|一步步|逐条|详细)?(?:解释|说明|拆解|拆开|展开|讲清楚|梳理)|(?:分|拆)(?:三|几|\d+)(?:步|部分|层)(?:来)?(?:解释|说明|讲)|白皮书|公开(?:披露|说明|算法|模型|代码|文档)|欢迎(?:第三方|外部|大家)?(?:审计|监督|提问|质疑|查阅)|(?:见|详见|参考)(?:文档|白皮书|说明|论文|官网)|(?:我|我们)(?:先)?(?:来)?(?:给)?(?:你|你们|大家)?(?:讲|说)(?:一|两|几)?(?:遍|次)"
TRANSPARENT_EN = r"let\s+me\s+(?:break|explain|walk\s+you)\b|break\s+(?:it|this|that)\s+down|step[- ]by[- ]step|(?:i|we)\s+will\s+(?:explain|walk\s+you|break)\b|published?\s+(?:whitepaper|paper|report|documentation)|welcome\s+(?:third[- ]party\s+)?(?:audit(?:s|ing)?|scrutiny|review|questions)|open\s+to\s+(?:audit|scrutiny|review)"

COMPLEXITY_SHIELD = Detector(
    "complexity_shield",
    (
        (zh(BEYOND_YOU_ZH) | en(BEYOND_YOU_EN), 0.8),
        ((zh(NO_EXPLAIN_ZH) | en(NO_EXPLAIN_EN)) & (zh(COMPLEX_ZH) | en(COMPLEX_EN)), 0.7),
        (en(NO_EXPLAIN_EN), 0.6),
    ),
    (zh(TRANSPARENT_ZH) | en(TRANSPARENT_EN),),
    least_chars=4,
)

# -- concern trolling -----------------------------------------------------------------
# Fixed values.
CARE_ZH = "为你好|关心你|担心你"
CARE_EN = r"\b(?:because\s+i\s+care|i\s+care\s+about\s+you|for\s+your\s+own\s+good|i\s+care\s+enough|a\s+real\s+friend\s+would)\b"
BELITTLE_ZH = "你这些问题|你的问题|你这样下去|你这样不行|你不听|不听劝|批评你|指责你|难听话|不识好人心|不知好歹|你这个人|你总是|你从来"
BELITTLE_EN = r"\b(?:hard\s+truths?|your\s+problems?|these\s+problems|only\s+saying\s+this|nobody\s+else\s+would|no\s+one\s+else\s+would)\b"
ONLY_ME_ZH = "别人谁愿意|换别人|除了我|没人愿意|谁会跟你说|只有我"
COUNSELLED = r"心理咨询师|心理咨询|心理医生|调解员|咨询师|治疗师|counselor|therapist|mediator|social\s+worker"

CONCERN_TROLLING = Detector(
    "concern_trolling",
    ((by_language(zh(CARE_ZH) & (zh(BELITTLE_ZH) | zh(ONLY_ME_ZH)), en(CARE_EN) & en(BELITTLE_EN)), 0.5),),
    (en(r"伪关心|concern\s+trolling"), en(COUNSELLED)),
)

# -- concession coercion --------------------------------------------------------------
# Fixed values.
CONCEDE_ZH = "(?:如果|若|一旦|要是|只要|假如|倘若)[^。，；]{0,12}?(?:让步|退让|松口|同意|答应|批准|采纳|接受|默许|应允|开了这个口子|开这个先例|放行|放它过|低头|妥协)|(?:这次|现在|今天|这回|此时)[^。，；]{0,6}?(?:让步|退让|松口|同意|答应|批准|妥协|放行)|(?:让步|退让|松口|同意|批准|妥协|放行)(?:一次|一回|一步|了这一回)|退(?:了)?一步|不(?:守住|捍卫|坚持|把住|看住|把持)[^。，；]{0,6}(?:底线|这条线|红线|边界|原则|关口|关口|阵线|门槛)"
CONCEDE_EN = r"\b(?:if|once|when)\s+(?:we|you|they)\s+(?:allow|approve|accept|concede|give\s+in|back\s+down|say\s+yes|agree|permit|let\s+them)\b|\b(?:conced|give\s+in|back\s+down)\s+(?:now|this\s+time|here)\b|\b(?:say|say)\s+yes\s+(?:here|now|to\s+this)\b"
CALAMITY_ZH = "(?:体系|系统|大局|局面|底线|全线|整条线|全盘)(?:就会|将会|都会|也会|还要|就|将|全会)?(?:崩|塌|崩盘|崩溃|崩塌|垮|坍塌|守不住|失守|垮掉|塌掉|完蛋|全完了|毁于一旦|不复存在|全盘皆输)|(?:崩盘|崩塌|崩溃|坍塌|后患|万丈深渊|无底深渊|连锁反应|骨牌|多米诺|一发不可收拾|没完没了|不可收拾|不可挽回|不可逆转|无法挽回|没法回头|回不了头|没有回头路|彻底失控|全面失控|脱缰|决堤|洪水|蜂拥|一发|拦不住|管不住|收不住|收不了场|收拾不了)|(?:后果|责任|锅|锅)[^。，；]{0,10}(?:由|全部都由|全都由)?(?:所有人|大家|全社会|每个人)(?:一起|共同|一块)?(?:承担|买单|承受|负责)|(?:明天|往后|以后|今后|接下来)[^。，；]{0,8}(?:就)?得?(?:退|让|松口|妥协)(?:十步|百步|更多|更多步|无数步|到哪)"
CALAMITY_EN = r"\b(?:everything|the\s+whole\s+(?:system|thing|project|society)|it\s+all)\s+(?:will\s+|would\s+)?(?:collapse|falls?\s+apart|fall\s+apart|comes?\s+apart|comes?\s+crashing\s+down|unravels?|implodes?)\b|\b(?:whole\s+)?(?:system|structure|framework|institution|society|economy)\s+(?:will\s+)?(?:collapse|crumble|fall\s+apart|unravel)\b|\b(?:we|they|it)\s+(?:will\s+)?lose\s+(?:all\s+)?control\b|\bno\s+(?:coming\s+back|turning\s+back|way\s+back)\b|\bpoint\s+of\s+no\s+return\b|\bslippery\s+slope\s+(?:to|into)\s+(?:collapse|disaster|ruin)\b|\b(?:first|next)\s+(?:one|thing|concession)\s+will\s+(?:open|lead\s+to)\b"
QUANTIFIED = (zh(r"\d+\s*(?:%|％|个百分点|倍|ms|毫秒|秒|分钟|天|万元|元)"), en(r"\b\d+(?:\.\d+)?\s*(?:%|percent|ms|milliseconds?|seconds?|minutes?|days?|dollars?|usd|bps)\b"))
EVIDENCED = (zh("报告|附录|测算|实测|数据|依据|记录在案|日志|评审|审计|复盘"), en(r"\b(?:report|appendix|measured|benchmark|staging|test|data|audit|documented|log)\b"))
MITIGATED = (zh("补偿控制|缓解措施|兜底|预案|上限|限额|阈值|熔断|限制|约束|审查节点|回滚|退出机制|审计"), en(r"\b(?:compensating|mitigat|contingency|guardrail|cap|limit|threshold|rollback|safeguard|review\s+gate|monitoring|control)\b"))
FLAWED = (zh("谬误|逻辑错误|错误论证|站不住脚|不成立|并不成立|并不正确|是错的|有问题|值得(?:怀疑|商榷|反思|警惕)"), en(r"\bfallacy\b|\binvalid\b|\bdoesn'?t\s+(?:hold|follow|work)\b|\bnot\s+(?:a\s+)?(?:valid|sound)\b|\bquestionable\b|\bflawed\b"))

CONCESSION_COERCION = Detector(
    "concession_coercion",
    (((zh(CONCEDE_ZH) | en(CONCEDE_EN)) & (zh(CALAMITY_ZH) | en(CALAMITY_EN)), 0.45),),
    (
        (zh("滑坡(?:谬误|论证|论证法)|滑坡(?:论证)?是(?:一种)?(?:逻辑)?谬误") | en(r"\bslippery\s+slope\s+(?:is\s+a|fallacy)\b|\bthat'?s\s+a\s+slippery\s+slope\b")) & Some(*FLAWED),
        AtLeast(2, Some(*QUANTIFIED), Some(*MITIGATED), Some(*EVIDENCED)),
    ),
)

# -- reversal of victim and offender --------------------------------------------------
# Fixed values.
ACCUSE_ZH = "(?:还有脸|居然|怎么敢|反倒|反而|恶人先告状|颠倒黑白|倒打一耙|装无辜|装受害者)|(?:说|指责|怪|怪罪|批评|数落|问|倒怪|反咬)(?:我|吾)?|你(?:这么|这样)(?:说|讲|话)|该道歉的是你|该说对不起的是你|该认错的是你|道歉的应该是你"
ACCUSE_EN = r"\b(?:how\s+dare\s+you\s+(?:blame|accuse|criticize|judge)|(?:you|u)\s+(?:dare\s+to\s+)?(?:blame|accused?|criticiz\w+|judg\w+)\s+me|who\s+are\s+you\s+to\s+(?:talk|judge|blame|accuse)|stop\s+playing\s+the\s+victim)\b"
REVERSE_ZH = "(?:你|您)才?(?:是|为)(?:真的?|真正)?(?:把)?[^。！？!?]{0,6}(?:伤害|迫害|施暴|欺负|欺凌|逼|骗|中伤|毁)了?(?:掉)?(?:我|者|的人)?|(?:是|为)(?:你|您)把?(?:我)?(?:逼|伤害|欺负|骗|迫害|中伤|毁)|(?:你|您)[^。！？!?]{0,8}(?:欺负|欺凌|迫害|伤害)了?我|我(?:才|这)是[^。！？!?]{0,12}受害者|(?:你|您)(?:伤|骗)了?我?(?:多深|这么深|那么深|最深|多少)?|(?:受伤害|被伤害|被害)的人是我"
REVERSE_EN = r"\b(?:you\s+(?:are|'re)\s+(?:the\s+)?(?:real\s+)?(?:one\s+)?(?:who\s+is\s+)?(?:hurting|harming|abusing|abusive|abuser|the\s+abuser|toxic|the\s+monster)|i\s+am\s+(?:the\s+)?(?:real\s+)?victim\b)"
MUTUAL = (zh(r"(?:双方|互相|彼此|各自|两人)[^。]{0,12}(?:都是|都有|也有|共同)?\s*(?:受害者|伤害|责任|问题)|(?:受害者|伤害|责任)[^。]{0,8}(?:双方|互相|彼此|各自)"), en(r"\b(?:both|mutual(?:ly)?|each\s+other)\b[^.]{0,40}\b(?:victim|hurt|responsib)"))
REPAIR = (zh("想和你好好说|想好好谈谈|需要一起面对|可以分开谈|我们一起|一起面对|好好谈谈|沟通|修复|和解|复合|协商|调解|说清|解释清楚|复盘|各自说说|分开谈"), en(r"\b(?:let'?s\s+talk|talk\s+about\s+it|work\s+(?:this\s+)?out|repair|counseling|need\s+to\s+talk|want\s+to\s+talk)\b"))

DARVO = Detector(
    "darvo",
    ((by_language(zh(REVERSE_ZH) & (zh("而不是你|不是你") | zh(ACCUSE_ZH)), en(REVERSE_EN) & (en(r"\bnot\s+you\b") | en(ACCUSE_EN))), 0.5),),
    (en(r"(?:darvo|反转受害者|受害者反转|指责者变成被告)(?:是|属于|是一种|正是|称为|叫做|指|模式|现象|手法|策略|is|are|refers\s+to|means|describes)", "darvo|反转受害者"), en(COUNSELLED + r"|survey|study\s+of"), Some(*MUTUAL), Some(*REPAIR)),
)

# -- false balance --------------------------------------------------------------------
# Fixed values.
EQUAL_ZH = (
    "(?:都|全|各自|两边|双方)(?:有|很|挺|蛮)?(?:道理|理|对)?(?:都有|都有理|有道理|有各自的道理)",
    "(?:两边|双方|两边都|双方都|彼此)(?:各执一词|各说各话|各执一辞|各有说辞|都没错|都没问题|都说得过去)",
    "(?:对)?(?:待|看待|处理|呈现)(?:两边|双方|两方|两种)(?:应|要|该|都|得)?(?:同等|一样|平等|不偏不倚|对等)",
    "(?:两种|两种)(?:说法|版本|观点|看法|解释|叙事|声音)(?:都|并存|同时|一起|一并)(?:有|成立|有效|合理|可信)",
    "(?:我们|双方|双方都|咱们)?(?:不|暂不|先不|在此)(?:下结论|下定论|评判|裁定|认定|表态|选边)",
    "(?:同等|对等|一样)(?:看待|对待|采信|重视|认真对待|严肃对待)",
    "(?:这|那)?(?:几|三|两|数)?(?:种|个|派|类)?(?:解释|说法|观点|版本|理论|叙事)(?:都|全|各自)(?:成立|有效|合理|站得住|可信)",
    "(?:我们|我方|本台|本报|双方|双方都)?(?:没有|毫无|不带|不持)(?:任何)?(?:倾向性|立场偏向|偏向|预设立场)",
    "(?:让|交由)(?:公众|观众|读者|网友|大家)(?:自己|自行)(?:判断|分辨|取舍)",
    "(?:谁对谁错|孰是孰非|谁是谁非)(?:目前|现在|仍|尚|一时|如今)?(?:很|太|难以|很难|无法|无从)?(?:说|判定|分辨|判断|定|下结论)",
    "(?:是非|对错|曲直)(?:目前|现在|仍|尚|一时)(?:很|太|难以|很难|无法|无从)(?:说|判定|分辨|判断|分清)",
)
EQUAL_EN = (
    r"\b(?:both|all)\s+(?:sides?|parties|camps)\s+(?:have\s+(?:a|some|their)\s+point|are\s+partly\s+right|have\s+legitimate|make\s+valid\s+points)",
    r"\b(?:both|all|each)\s+(?:versions?|accounts?|stories|sides?|narratives?|claims?)\s+(?:deserve|warrant|merit|are\s+due|given|have)\s+(?:equal|the\s+same|comparable|similar)\s+(?:weight|treatment|credibility|consideration)",
    r"\bwe\s+(?:make\s+no|take\s+no|draw\s+no|will\s+make\s+no)\s+(?:judg(?:e)?ment|conclusion|call|distinction)",
    r"\blet\s+(?:the|our)\s+(?:audience|readers?|viewers?|public)\s+(?:make\s+up\s+their\s+own\s+minds?|decide\s+for\s+themselves)",
    r"\b(?:there\s+are|there\s+is)\s+(?:always\s+)?(?:two|multiple|several|both)\s+(?:sides?|versions?|accounts?|stories|perspectives?|narratives?)\s+(?:to|in|here|at\s+play|involved)\b",
    r"\b(?:treat|regard?|consider|present|report)\s+(?:them|both|these|the\s+two)\s+(?:the\s+same\s+way|equally|evenly|as\s+equals?|alike)",
    r"\b(?:remains?|remain|is\s+still|are\s+still)\s+(?:in\s+)?(?:dispute|disputed|contested|unresolved|debated)",
    r"\b(?:give|assign|attach)\s+(?:them\s+)?(?:equal|the\s+same)\s+weight\s+to\b",
)
CONTESTED_ZH = (
    "(?:真相|实情|事实|是非|曲直)(?:目前|现在|目前还|仍|尚|依然)?(?:还|仍|尚)?(?:不|未|难以)(?:清楚|明晰|明确|明朗|可知|定论)",
    "(?:目前|现在|眼下|至今|迄今为止)(?:尚|仍|还)?(?:无|没有)(?:定论|结论|共识|答案)",
    "(?:众说纷纭|莫衷一是|各执一词|争议|分歧)(?:不断|仍|依然|很大|未(?:有|得到)解决|尚无结论)",
    "(?:存在|有)(?:两种|两派|数种|几种)(?:截然不同|截然相反|完全相反|互不相容|相互矛盾)?(?:的)?(?:说法|版本|观点|解释|叙事|声音|立场)",
    "(?:是非|对错|曲直|责任)(?:目前|现在|仍|尚)(?:难|难以|无法)(?:界定|判定|断定|分辨|区分)",
    "(?:孰是孰非|谁对谁错)(?:目前|现在|仍|尚)?(?:尚|还)?(?:难|难以|无从|无法)(?:定|判定|分辨|说|判断)",
    "(?:直到|直至|时至|到了)(?:今天|如今|现在|目前为止|目前为止)?，?(?:这|该|此)(?:起|件|次|场)?(?:事件|事故|争议|风波|纠纷|案子|问题)(?:的是非曲直|真相|责任|是非|曲直)?(?:仍然|依然|还是|仍|至今)?(?:没有|尚无|未形成)(?:定论|结论|共识)",
    "(?:责任|责任归属|起因|原因|性质|是非)(?:归属|判定|认定|划分)?(?:众说纷纭|莫衷一是|争议不断|分歧很大|没有定论)?，?(?:至今|到今天|迄今为止|目前)(?:仍|还|尚|依然)?(?:没有|未|尚无)(?:形成|达成|得出)(?:共识|定论|结论|一致意见)",
)
CONTESTED_EN = (
    r"\b(?:the\s+)?(?:truth|facts?|reality|situation|matter)\s+(?:is|remains|is\s+still)\s+(?:still\s+)?(?:unclear|unknown|uncertain|contested|disputed|up\s+in\s+the\s+air)",
    r"\b(?:there\s+is|remains?)\s+(?:still\s+)?no\s+(?:clear\s+)?(?:consensus|conclusion|agreement|answer|verdict)",
    r"\b(?:two|competing|rival|conflicting)\s+(?:entirely\s+|completely\s+|directly\s+)?(?:different|opposite|contradictory|competing|conflicting)\s+(?:accounts?|versions?|narratives?|stories|claims|sides)",
    r"\b(?:who\s+is\s+right|which\s+side\s+is\s+right)\s+(?:is\s+)?(?:still\s+)?(?:unclear|unresolved|hard\s+to\s+say)",
)
JUSTIFIED_ZH = (
    "(?:两|两方|双方)(?:种|方|个)?(?:假说|观点|说法|理论|结论)?(?:都|均|各自)(?:已|已经)?(?:做|做过了|经过)(?:检验|验证|实验|核查|审查|测试)",
    "(?:已有|已有)(?:结论|定论|证据|数据)(?:表明|显示|支持|证明)",
    "(?:另|另一|另一方)(?:一种)?(?:说法|假说|观点)(?:没有|缺|缺乏|未见)(?:数据|证据|依据|支撑)",
    "(?:证据|数据)(?:支持|表明|指向)(?:其中|其中一|前者|后者)",
    "(?:已|已经)(?:被|予以)?(?:排除|否决|否定|推翻|证伪)",
    "(?:尚|仍)(?:无)(?:公开|有效)(?:证据|数据)(?:支撑|支持|证明)",
    "(?:仅|只|不过|只是)(?:是)?(?:一种|个|种)(?:说法|猜测|推测|传言|传闻)",
)
JUSTIFIED_EN = (
    r"\b(?:both)\s+(?:hypotheses|claims|accounts|candidates)\s+(?:have\s+been|were)\s+(?:tested|examined|checked|investigated)",
    r"\b(?:the\s+)?(?:evidence|data)\s+(?:supports?|favou?rs?|points\s+to)\s+(?:one|the\s+former|the\s+latter)",
    r"\b(?:the\s+)?(?:alternative|other|competing)\s+(?:claim|account|version|explanation|theory)\s+(?:was|is|has\s+been|were)\s+(?:tested\s+and\s+)?(?:rejected|disproved|refuted|eliminated|not\s+supported)",
    r"\b(?:it\s+is\s+)?(?:only|merely)\s+a\s+(?:claim|allegation|assertion|hearsay)\s+(?:without|with\s+no)\s+evidence",
)
BALANCE_META_ZH = "(?:虚假平衡|假平衡|两边都有理|和稀泥|各打五十大板)(?:是|属于|是一种|正是|属于)(?:一种|典型的|常见的)?(?:谬误|谬说|逻辑错误|错误论证|报道偏差|话术|手法|手段|策略|伎俩|套路|现象|问题|错误|陷阱)"
BALANCE_META_EN = r"\b(?:false\s+balance|both-?sidesism|bothsidesism|false\s+equivalence\s+of\s+evidence)(?:\s+(?:is|are))\s+(?:a\s+)?(?:fallacy|manipulation|tactic|rhetorical|technique|form\s+of|symptom\s+of|common|reporting\s+bias)"

FALSE_BALANCE = Detector(
    "false_balance",
    ((zh(*EQUAL_ZH) | en(*EQUAL_EN), 0.68), (zh(*CONTESTED_ZH) | en(*CONTESTED_EN), 0.62)),
    (zh(BALANCE_META_ZH) | en(BALANCE_META_EN), zh(*JUSTIFIED_ZH) | en(*JUSTIFIED_EN)),
)

# -- guilt by association -------------------------------------------------------------
# Fixed values.
RELATED_ZH = ("朋友", "好友", "哥们", "兄弟", "前任", "亲戚", "亲属", "爸爸", "妈妈", "爸妈", "爸", "妈", "同乡", "老乡", "互关", "关注列表", "待过", "共事", "团队", "公司", "上班", "室友", "同学", "邻居", "合伙人", "发小", "闺蜜", "师兄", "师弟", "师姐", "师妹", "同事", "老家", "出身", "门第", "一起长大", "一个宿舍", "合租", "吃过饭")
RELATED_EN = ("brother", "sister", "father", "mother", "dad", "mom", "son", "daughter", "friend", "bestie", "ex-boyfriend", "ex-girlfriend", "ex-wife", "ex-husband", "ex-partner", "ex-boss", "neighbor", "colleague", "coworker", "teammate", "classmate", "roommate", "relative", "uncle", "aunt", "cousin", "used to work", "worked with", "works with", "associated with", "follows", "following", "hangs out", "from the same town", "same company", "grew up with", "went to school with", "old boss", "old company")
TAINTED_ZH = ("好到哪去", "好不到哪去", "一路货色", "一路人", "干净不了", "有多干净", "也不是什么好人", "不是好人", "能是什么好人", "能信吗", "还能信", "一伙的", "一伙", "防着点", "防着", "也好不了", "好不了", "离远点", "不可信", "别信他", "就有问题", "本身就有问题", "都不是好东西", "能是什么好东西", "强不到", "强不了哪去", "脱不了干系", "一模一样", "一个样", "同一路", "根上坏", "随根", "带坏")
TAINTED_EN = ("must be one too", "must be just like", "must be guilty", "cannot be trusted", "can't be trusted", "not to be trusted", "no better than", "one of them", "just as bad", "guilty too", "same kind of person", "cut from the same cloth", "just like them", "stay away from", "as well", "one too", "tainted as well", "guilt by association")
GUILT_META = ("连坐", "株连", "连坐效应", "guilt by association", "association fallacy")
OWN_RECORD = ("靠证据", "不是证据", "按事实", "单独看", "个案", "责任自负", "就事论事", "本人的记录", "本人行为", "逐条核查", "not evidence", "own record", "due process", "individually", "on his own", "on her own", "judged by actions")
COURSE = ("老师", "教材", "课本", "课堂", "教授", "讲师", "讲义", "textbook", "lecture", "professor", "in class", "the course")
BLOOD = ("血统", "基因", "龙生龙", "凤生凤", "根正苗红", "书香门第", "将门", "血脉", "bloodline", "noble blood", "born into", "pedigree", "of good stock")

_GUILT_ZH = any_literal(*RELATED_ZH) & any_literal(*TAINTED_ZH)
_GUILT_EN = any_literal(*RELATED_EN, lower=True) & any_literal(*TAINTED_EN, lower=True)
GUILT_BY_ASSOCIATION = Detector(
    "guilt_by_association",
    ((_GUILT_ZH & _GUILT_EN, 0.82), (_GUILT_ZH | _GUILT_EN, 0.68)),
    tuple(any_literal(*words, lower=True) for words in (GUILT_META, OWN_RECORD, COURSE, BLOOD)),
    least_chars=1,
)

# -- denial as proof ------------------------------------------------------------------
# Fixed values.
REACTION_ZH = ("(?:你|您)反应(?:这么|如此)?(?:大|强烈|激烈)", "(?:你|您)?(?:这么|如此)(?:激动|生气|急躁|冲动)", "(?:急什么|急了|发这么大火|火气这么大|声音这么大声)", "情绪(?:这么|如此)(?:激动|激烈|强烈)")
REACTION_EN = (r"\byour\s+(?:protest|protests|denial|defensiveness|defensive\s+reaction)\b", r"\byou\s+(?:are\s+)?(?:deny|denying|protest|protesting|defensive)\b", r"\bthe\s+harder\s+you\s+(?:deny|protest|explain|argue)\b", r"\bif\s+you\s+(?:were|are)\s+innocent\b", r"\bif\s+you\s+did\s+nothing\s+wrong\b")
INNOCENT_ZH = "问心无愧|没做错|清清白白|身正不怕影子斜|光明正大"
DENIAL_ZH = "否认|狡辩|辩解|抵赖|不承认"
PROOF_ZH = "(?:说明|证明|表明|恰恰|正好|就是)(?:你|您)?[^。]{0,8}(?:心虚|有鬼|被我说中|说中|心里有鬼|有问题|有错|有罪|在骗)"
PROOF_EN = (r"\b(?:proves|shows|means)\b", r"\bis\s+(?:all\s+the\s+)?proof\b", r"\bas\s+(?:proof|evidence)\b", r"\bthe\s+(?:guiltier|more\s+guilty)\b", r"\bwould\s*n[o']?t\s+need\s+to\s+(?:explain|deny|protest|defend)\b", r"\bwou?ldn'?t\s+need\b")
WHY_ZH = "(?:为什么|凭什么)[^。]{0,8}(?:否认|解释|狡辩|辩解|不让|着急|急)"
ITSELF_ZH = "(?:就是|本身)[^。]{0,2}证据"
KAFKA_HEDGE_ZH = (
    "(?:卡夫卡|kafka)(?:陷阱)?(?:是|属于|是一种|正是|称为|叫做|指|举例|例如|比如|案例|教学|分析|识别|检测)", "(?:这种|这类|此)(?:推论|逻辑|论证|说法)[^。]{0,8}(?:不成立|无效|错误|是?谬误)", "(?:在)?法律上[^。]{0,12}(?:不|没|非)",
    "(?:不能|不应|不得|不可)[^。]{0,10}(?:仅凭|因为|就把|将)", "(?:不得|不能|严禁)强迫自证其罪", "(?:辩解权|申辩权|陈述权)(?:是|属于|受)", "正当程序", "(?:不能|不应|不得|不可)单凭(?:态度|情绪|反应)", "结合证据判断", "不作为[^。]{0,6}依据", "需要独立复核",
)
KAFKA_HEDGE_EN = (
    r"\bkafka\s?trapping\b", r"\bnot\s+admissible\b", r"\bin\s+(?:a\s+)?court\b", r"\bis\s+(?:legally\s+)?(?:invalid|inadmissible|a\s+legal\s+error)\b", r"\bis\s+not\s+(?:proof|evidence)\b", r"\bdue\s+process\b",
    r"\bright\s+to\s+(?:remain\s+silent|a\s+defense)\b", r"\bself-?incrimination\b", r"\bnot\s+(?:evidence|proof)\s+of\s+guilt\b", r"\bdenial\s+is\s+not\b",
)

KAFKATRAPPING = Detector(
    "kafkatrapping",
    ((Some((zh(*REACTION_ZH) | en(*REACTION_EN)) & (zh(PROOF_ZH) | en(*PROOF_EN)), zh(INNOCENT_ZH) & zh(WHY_ZH), zh(DENIAL_ZH) & zh(ITSELF_ZH)), 0.5),),
    (zh(*KAFKA_HEDGE_ZH) | en(*KAFKA_HEDGE_EN),),
)

# -- manufactured consent -------------------------------------------------------------
# Fixed values.
SILENCE_ZH = "(?:无人|没有人|没人|没有看见有人|未见到有人|大家都没|都没|大家都|全都)[^。，；]{0,8}(?:反对|异议|有意见|意见|举手|提出|出声|发言|表态|站|说|支持|答应|附和|呼应)|(?:没人|无人|不)[^。，；]{0,4}(?:举手|说话|出声|发言|表态)|(?:保持|选择)?沉默(?:的人|者)?|(?:不|没)[^。，；]{0,6}(?:开口|作声|作言|愿意|响应|答复|回话)"
SILENCE_EN = r"\b(?:no|zero|without\s+a)\s+(?:objection|objections|objectors|dissent|hands?|questions?|response)\b|\b(?:nobody|no\s+one|nobody\s+here)\s+(?:objected?|objects?|raised|spoke\s+up|said\s+anything|disagreed?|is\s+objecting)\b|\bnobody\s+(?:raised|put\s+up)\s+(?:a\s+)?(?:hand|finger)\b|\bsilence\b|\bthe\s+(?:room|floor)\s+is\s+(?:silent|quiet)\b"
CONSENT_ZH = r"(?:就)?(?:这么|这样|照此)(?:定了|办|定|敲定|定了)|宣布(?:通过|方案|决定|立项|敲定|批准|同意)|(?:视为|看作|算作|等同于|视作|默认|认定)(?:一致|同意|赞成|默认同意|通过|大家同意|无异议)?|代表(?:你们|大家|大家就|你们就)?(?:都)?(?:同意|赞成|默许|认了)|(?:不表态|沉默|不说话|没人说话|没意见)\s*(?:的?人)?(?:就是|等于|算是|当作)(?:默认|同意|赞成|认了)?|一致(?:通过|同意|认可|认同)|全票(?:通过|同意)|我(?:就)?(?:宣布|认定)(?:通过|大家|这|这事)?|默认(?:大家|你们|各位|全员)?(?:都)?(?:同意|赞成|认了|通过|没意见)|这(?:事|件事|方案|项目)?(?:就)?(?:定|定下来|敲定)(?:了|下来)?|(?:我理解|我当)(?:成|作)(?:大家|你们|各位)?(?:都)?(?:没意见|同意|赞成)"
CONSENT_EN = (
    r"\b(?:i|we|you|they|it|this|that)?\s*(?:counts?|treats?|treat(?:ed)?|takes?|interpret(?:s|ed)?|reads?|sees?|understand(?:s|ing)?|hears?)(?:\s+(?:this|that|it|silence|the\s+silence|no\s+\w+|these|those))?\s+(?:as|to\s+(?:mean|be)|as\s+being|as\s+a)\s+(?:unanimous|approval|consent|a\s+yes|agreement|approved|accepted|agreed|a\s+go-?ahead|a\s+green\s*light)",
    r"\b(?:unanimous|unanimously|by\s+consensus|by\s+acclamation|without\s+dissent|by\s+default)\s+(?:approv|accept|agree|passed|adopt)",
    r"\b(?:approv|accept|agree|passed?|adopt(?:ed)?|proceed(?:ing)?)\s+(?:by\s+(?:consensus|acclamation|default)|unanimously)",
    r"\b(?:we|everyone|all|everybody)\s+(?:are\s+|is\s+|are\s+all\s+|all\s+)?(?:agreed|in\s+agreement|of\s+one\s+mind)",
    r"\bsilence\s+(?:means|counts\s+as|is\s+(?:as\s+)?)",
)
VOTED = (zh(r"\d+\s*(?:票|\s*人)\s*(?:赞成|同意|反对|弃权|保留)|(?:赞成|同意|反对|弃权|保留)\s*\d+\s*(?:票|\s*人)|投票(?:结果|记录|明细)|(?:记名|实名)(?:投票|表决)|匿名(?:投票|表决|问卷)"), en(r"\b\d+\s*(?:in\s+favor|for|against|abstain(?:ed|ing)?|abstentions?|votes?)\b|\bvote(?:d|r)?\s*(?:count|result|tally|record)\b|\b(?:recorded|logged|logged\s+in\s+the\s+minutes|minuted)\b"))
PROCEDURE = (zh("记录在案|会议记录|纪要|归档|复议|再议|复审|书面(?:确认|回执|签字)|签名|签收|公告|公示|征求意见|回执|逾期视为"), en(r"\b(?:minutes|meeting\s+record|minuted|circulated|ratified|second(?:ed)?\s+by|motion\s+(?:carried|failed|tabled)|brought\s+back|re-?vote|walkthrough|written\s+confirm|sign-?off|on\s+record)\b"))
NOT_EQUAL = (zh("(?:未反馈|没有(?:回复|答复|回应)|无应答|逾期)[^。，；]{0,8}(?:不(?:视为|算作|当作|等于))?(?:同意|赞成|认可|通过|默认)|(?:不(?:能|可以|得))[^。，；]{0,6}(?:视为|当作|算作)(?:同意|赞成|认可)"), en(r"\b(?:non-?response|no\s+response|silence)\s+(?:is\s+)?not\s+(?:consent|approval|agreement|a\s+yes)\b|\bwe\s+(?:do\s+not|don'?t)\s+(?:count|treat|read)\s+(?:silence|non-?response)\s+as\b|\bno\s+response\s+(?:is\s+)?(?:logged|recorded)\s+(?:as|only)\b"))
SILENCE_META = (zh("诉诸(?:沉默|沉默多数|无人反对)|(?:斯德哥尔摩|从众)(?:谬误|效应)"), en(r"\bappeal\s+to\s+silence\b|\bargumentum\s+(?:ad\s+)?silentio\b|\bmanufactured\s+consent\s+is\b|\bthat'?s\s+(?:an?\s+)?appeal\s+to\s+silence\b"))

MANUFACTURED_CONSENT = Detector(
    "manufactured_consent",
    (((zh(SILENCE_ZH) | en(SILENCE_EN)) & (zh(CONSENT_ZH) | en(*CONSENT_EN)), 0.45),),
    (Some(*SILENCE_META) & Some(*FLAWED), AtLeast(2, Some(*VOTED), Some(*PROCEDURE), Some(*NOT_EQUAL))),
)

# -- mind reading ---------------------------------------------------------------------
# Fixed values.
ASSERT_ZH = (
    "(?:别|不要|甭)不承认", "别以为我(?:不知道|不了解|看不清)", "(?:别|不要)装了", "我(?:还|可|最)?不了解你", "我(?:太|最)?了解你", "我(?:知道|看得出|看透|看穿)(?:了)?你", "(?:你|您)就是(?:故意|成心|有意|蓄意|在装|装的)",
    "(?:你|您)(?:根本|明明|分明)就是", "其实(?:就是|心里|内心|真正|说到底)", "(?:你|您)心里(?:清楚|明白|有数)", "嘴上(?:说|讲)(?:是|的是)?[^。，！？]{0,10}其实", "(?:分明|明明)(?:就是|是在)",
)
ASSERT_EN = (r"\bdeep\s+down\s+you\s+know\b", r"\b(?:i|we)\s+know\s+(?:what|how|exactly)\s+you\b", r"\b(?:i|we)\s+know\s+you\s+(?:are|'re)\b", r"\bbut\s+i\s+know\s+you\b", r"\byou\s+(?:are|'re)\s+just\b", r"\bdon'?t\s+lie\b", r"\byou\s+(?:say|said|claim)\b[^.]{0,40}\bbut\s+i\s+know\b")
INNER_ZH = ("(?:心里|内心|心底|骨子)", "(?:想法|心思|念头|打算|目的|动机|意图)", "(?:故意|成心|有意|蓄意)", "(?:记恨|记仇|怀恨|埋怨|怨我|恨我|生我气|生气|委屈|不满|介意|在意)", "(?:没|不|未)安好心", "装(?:傻|糊涂|无辜|样子)", "(?:借口|托词)", "(?:你|您)[^。，！？]{0,8}(?:这么|这样)(?:想|认为|打算|计划的)")
INNER_EN = (r"\bdeep\s+down\b", r"\breally\s+after\b", r"\b(?:angry|upset|resent|mad)\b", r"\b(?:pretend|pretending|faking)\b", r"\bmotives?\b", r"\bintentions?\b", r"\b(?:don'?t|not)\s+care\b", r"\byou\s+(?:really\s+)?(?:want|wanted)\b")
MIND_HEDGE_ZH = (
    "(?:读心|读心术|断言动机|mind.?reading)(?:是|属于|是一种|正是|称为|叫做|指|举例|例如|比如|案例|教学|分析|识别|检测)", "(?:是不是|是否有|有没有|能否|能不能)[^。？?]{0,15}(?:想法|感受|顾虑|心思|介意|生气|不满|打算|计划)",
    "(?:可以|不妨|欢迎)(?:一起|说说|聊聊|谈谈|讲出来|告诉我)(?:看|吗|吧)?", "(?:我|我们)(?:感觉|觉得|感到)(?:你|您)[^。]{0,12}(?:压力|累|辛苦|不容易|难|进步|成长|优秀|棒|努力)", "(?:与其|不要|别)(?:猜测|猜|臆测)",
    "(?:不如|不妨|直接|请)(?:问|询问|沟通|核实|确认)", "(?:其实)?我(?:也)?(?:是)?这么(?:想|认为|打算)",
    "(?:我(?:知道|了解|看出)(?:你|您))[^。]{0,12}(?:生气|不满|介意|记恨|委屈|难过|担心|焦虑|累|压力)[^。]{0,20}(?:理解|正常|应该|没错|可以|没关系|允许|明白)", "(?:我(?:知道|了解)(?:你|您))[^。]{0,12}(?:好意|善意|用心|为大家|为大局|着想)",
)
MIND_HEDGE_EN = (
    r"\bmind\s+reading\b", r"\b(?:is|are|called?|committing\s+an?)\s+(?:a\s+)?(?:mind\s+reading|mind-?reading)\b", r"\b(?:is|are)\s+(?:something|anything)\s+bothering\s+you\b", r"\b(?:do|would)\s+you\s+(?:want|like)\s+to\s+(?:talk|share|tell)\b", r"\bhere\s+to\s+listen\b",
    r"\b(?:i|we)\s+(?:feel|sense)\b[^.]{0,30}\b(?:pressure|stress|tired|overwhelmed|hard\s+time)\b", r"\binstead\s+of\s+(?:guessing|assuming)\b", r"\b(?:rather\s+than|instead\s+of)\s+guess\b", r"\blet\s+(?:him|her|them)\s+(?:tell|say|explain)\b",
    r"\b(?:i|we)\s+know\s+you\s+(?:are|'re)\b[^.]{0,50}\b(?:understandable|makes\s+sense|is\s+valid|it\s+is\s+(?:ok|okay|fine)|completely\s+normal)\b", r"\bi\s+know\s+you\s+(?:mean|meant)\s+well\b", r"\byour\s+heart\s+is\s+in\s+the\s+right\s+place\b",
)

MIND_READING = Detector(
    "mind_reading", (((zh(*ASSERT_ZH) | en(*ASSERT_EN)) & (zh(*INNER_ZH) | en(*INNER_EN)), 0.5),), (zh(*MIND_HEDGE_ZH) | en(*MIND_HEDGE_EN),)
)

# -- sole narrative -------------------------------------------------------------------
# Fixed values. There are no English patterns: these routes never hit.
SOLE_ZH = ("(?:官方|权威|上面|领导|上头|上头人|内部文件|内部消息|统一口径|通稿|定调|基调)", "(?:(?:按|以|根据|依照)(?:官方|权威|上面|领导|内部)(?:的)?(?:口径|说法|版本|解释|结论|意思|表态|定调))", "(?:标准答案|标准说法|唯一定论|唯一定性)", "(?:文件|通知|会议精神|领导指示)(?:是|才是)?(?:唯一)?(?:依据|准绳|标准)")
EXCLUSIVE_ZH = (
    "(?:只有|仅有|唯独)[^。，；]{0,6}(?:解释|说法|答案|版本|解读|理解|结论|可能)", r"(?:唯一|惟一)\s*(?:的)?\s*(?:解释|答案|版本|依据|准绳|标准|说法|定论|真相|口径|准)",
    r"(?:别的|其它|其他)\s*(?:说法|版本|解释|观点|意见|解读|声音)\s*(?:都)?\s*(?:不算数|不作数|不算|无效|是错|不对|不用听)", r"(?:讨论|争论|争议|这事|此事|这个话题|这个议题)\s*(?:到此为止|到此终结|到此结束|可以结束了|不用再(?:讨论|争论)|没有再(?:讨论|争论)的(?:必要|意义))",
    r"(?:轮不到|论不到|顾不上|用不着|不需要|不必|不须|无须)\s*(?:你|你们|自行|本人)?\s*(?:来|去)?\s*(?:质疑|怀疑|揣测|解读|过问|插手|判断|置喙)", r"(?:你的|你们的)?\s*(?:判断|质疑|解读|看法|想法|意见|声音)\s*(?:毫)?\s*(?:无意义|没有意义|不重要|不算数|无效|无足轻重)",
)
DEFER_ZH = ("(?:听|按照|按|照)(?:统一)?(?:口径|通稿|上面的|领导的)(?:说|的|就行|即可|来|说就行|执行)(?:就|即|行|可以|对了|没错|没错的)?(?:了|啦)?", "(?:让|叫)(?:干|干吗|做什么)(?:就)?(?:干|做)(?:什么|啥)(?:得了|就行|去)", "(?:执行|照做|服从|听从)(?:就|即|行|可以|是对|没错)(?:了|啦)?")
CITED = (en(r"《[^》]{2,30}》(?:第[一二三四五六七八九十百千\d]+[条款章款节]?)*|(?:GB|GB\/T|GB-T|ISO|IEC|IEEE|ITU|RFC|ASTM|EN|DIN|JIS)\s*[\/-]?\s*\d{2,6}(?:[.:-]\d+)?"), en(r"\b(?:RFC|ISO|IEC|IEEE|ANSI|W3C|ITU|ASTM|GB|EN|DIN|JIS)\s*\/?\s*\d{2,6}(?:[.:-]\d+)?\b|\b(?:section|clause|article|§)\s*\d+(?:\.\d+)*\b"))
PLURAL = (
    zh("(?:同时|也|还要|还需|并)(?:参考|参照|看看|查阅|结合|兼顾)(?:社区|多方|各方|其他|不同|几种|多个)(?:的)?(?:方案|做法|版本|说法|观点|资料|意见|讨论)|(?:多种|多个|几种|各家|各方|不同)(?:的)?(?:版本|说法|解释|观点|口径|方案)(?:略有)?(?:不同|差异|出入)|(?:以实际|最终|具体)(?:情况|数据|实测|测试)(?:为准|为依据|为凭)"),
    en(r"\b(?:also|additionally|furthermore)\s+(?:see|check|consult|refer\s+to)\s+(?:the\s+)?(?:community|multiple|other|different|alternative)\s+(?:sources?|docs?|implementations?|versions?|guidance)\b|\b(?:versions?|implementations?|practices?|guidance)\s+(?:vary|varies|differ|differs)\s+by\b|\b(?:multiple|several|different)\s+(?:valid\s+)?(?:versions?|interpretations?|readings?|schools\s+of\s+thought)\b|\b(?:note|noted)\s+where\s+(?:our|my)\s+(?:implementation|version|reading)\s+differs\b"),
)
NARRATIVE_META = (
    zh("(?:口径垄断|一言堂|舆论一律|统一思想|定于一尊|叙事垄断)(?:是|属于|是一种|正是)(?:一种|典型的)?(?:宣传|操控|操纵|话术|手法|手段|策略|伎俩|套路|现象|毛病|问题)"),
    en(r"\b(?:sole\s+narrative|single\s+narrative|narrative\s+monopoly|one\s+official\s+story|thought\s+control)\s+(?:is|are)\s+(?:a\s+)?(?:propaganda|manipulation|coercion|tactic|rhetorical|technique|form\s+of|symptom\s+of)\b"),
)

SOLE_NARRATIVE = Detector(
    "sole_narrative",
    ((zh(*SOLE_ZH) & zh(*EXCLUSIVE_ZH), 0.70), (zh(*DEFER_ZH) & (zh(*SOLE_ZH) | zh(*EXCLUSIVE_ZH)), 0.62)),
    (Some(*NARRATIVE_META), Some(*CITED), Some(*PLURAL)),
)

# -- synthetic social proof -----------------------------------------------------------
# Fixed values.
CONSENSUS_ZH = (
    "(?:所有人|人人都|大家都在|大家现在|现在谁|这行的人|做这行的|圈子里|身边的人|身边人|同行们|同行|一线大厂|大厂|聪明人|懂行的人|内行人|同龄人|你的同龄人)(?:都|也|早已|早就|纷纷|悄悄|已经)?(?:已经|早就)?[^。]{0,10}(?:用|换|升级|迁移|转|上|做|搞|走|跑|采用|部署|改|换用|不这么(?:干|做)|不用|抛弃|放弃|知道|清楚|甩|超越|拉开|赶过|淘汰)",
    "(?:现在|如今)(?:谁|有谁|哪个人)(?:还|又)(?:不|没)(?:这么|这样)(?:干|做|用|搞)",
)
CONSENSUS_EN = (
    r"\b(?:everyone|everybody|all\s+the\s+(?:smart|successful|top|best)\s+\w+|the\s+whole\s+(?:industry|field|community)|nobody)\s+(?:\w+\s+){0,2}?(?:has|have|had|is|are)?\s*(?:already\s+)?(?:switched|migrated|moved|adopted|using|uses|upgraded|onboard|left|dropped|doing|does|done)\b",
    r"\b(?:everyone|everybody)\s+(?:in|within)\s+(?:the\s+)?(?:industry|field|space|community|business)\s+(?:\w+\s+){0,2}?(?:has|have)\s+(?:already\s+)?(?:switched|migrated|moved|adopted|upgraded)",
    r"\b(?:all\s+(?:the\s+)?(?:smart|successful|top|best)\s+\w+|the\s+(?:smart|successful|top|best)\s+\w+)\s+(?:\w+\s+){0,3}?(?:already|have|has)\s+(?:know|knows|known|use|uses|using|switched|adopted|migrated)\b",
    r"\b(?:everyone|everybody)\s+else\s+(?:already\s+)?(?:has|have|did|does)\b",
)
PRESSURE_ZH = (
    "(?:只有你|就你|唯独你|除了你|你一个人)(?:[^。]{0,8})(?:还在|居然|竟然|不明白|不知道|没|不|犹豫|坚持|守旧)", "(?:你再|再|继续)(?:不|没)(?:[^。]{0,8})(?:就|将会|将会被)(?:[^。]{0,10})(?:落后|淘汰|掉队|出局|被甩|被时代|来不及|没机会|后悔)",
    "(?:被(?:人|时代|同行|同龄人)?甩(?:开|下)|原地踏步|跟不上(?:节奏|时代|潮流)|落在(?:后面|人后)|已经(?:落后|过时)(?:了|很多)?|被(?:大家|同行|同龄人)(?:甩|超越|拉开))", "你(?:居然|竟然|该不会|不会)(?:[^。]{0,10})(?:还在|还(?:不|没)|都)?(?:不知道|没用过|没听说过|在问|坚持|守旧)?",
    "(?:这(?:就)?是|算是|已经是)(?:[^。]{0,6})(?:基本共识|共识|公开的秘密|常识|大势所趋|行业(?:共识|标配)|标配)", "你(?:居然|竟然)(?:[^。]{0,8})(?:在问|还问|不知道|没用过|没听过|没跟上)", "(?:这就是|这就是所谓|这就是)(?:[^。]{0,6})(?:现实|现实生活|事实|差距|距离|区别|结果)",
)
PRESSURE_EN = (
    r"\byou\s+are\s+(?:the\s+)?(?:last|only)\s+(?:one|person|man|woman|team)\b", r"\b(?:why|how)\s+(?:have|has)\s+(?:not\s+you|you\s+not)\b", r"\b(?:everyone|everybody)\s+(?:else\s+)?(?:already|has)\s+(?:done|moved|switched|figured)\s+(?:this|it)\s+out\b[^.]{0,20}\byou\b",
    r"\b(?:do\s+not|don't)\s+be\s+(?:the\s+)?(?:last|only)\s+(?:one|person)\b", r"\b(?:you\s+are\s+)?(?:falling|left|being\s+left)\s+behind\b", r"\b(?:that\s+is|it\s+is)\s+(?:a\s+)?(?:basic\s+)?(?:consensus|common\s+sense|industry\s+standard|no\s+longer\s+optional)\b",
)
STATS_ZH = (r"(?:主流|大部分|多数|约|近|超过|达到|占比|百分之|\d+(?:\.\d+)?%)(?:[^。]{0,12})(?:用户|方案|厂商|企业|团队|国家|地区|人群|开发者)", "(?:去年|前年|上半年|去年同期|上世纪|以往|曾经|过去)(?:[^。]{0,10})(?:流行|盛行|主流|常见|普遍|用|采用)", "(?:剩下|其余|其他)(?:的是|为|属于)")
REPORT_ZH = ("(?:我|我们)(?:[^。]{0,8})(?:整理|汇总|收集|对比|分析|统计)(?:[^。]{0,6})(?:了|一份|一下|成)?", "(?:可以|可供|可供参考|作为)(?:[^。]{0,6})(?:参考|借鉴|对比)", "(?:反馈|评价|口碑)(?:[^。]{0,6})(?:不错|还可以|一般|褒贬不一)")
REFLEXIVE_ZH = ("(?:这种|这类|上述)(?:[^。]{0,8})(?:话术|说法|逻辑|结构|套路|套路)(?:[^。]{0,12})(?:是|属于|问题在于)", "(?:从众|随大流|bandwagon|社会认同)(?:[^。]{0,6})(?:谬误|效应|心理|压力|话术)", "(?:分析|拆解|识别|警惕|拒绝)(?:[^。]{0,6})(?:这种|这类)(?:[^。]{0,8})(?:从众|施压|捧场)")

SYNTHETIC_SOCIAL_PROOF = Detector(
    "synthetic_social_proof",
    (((zh(*CONSENSUS_ZH) | en(*CONSENSUS_EN)) & (zh(*PRESSURE_ZH) | en(*PRESSURE_EN)), 0.5),),
    (zh(*STATS_ZH), zh(*REPORT_ZH), zh(*REFLEXIVE_ZH)),
)

# -- tool deflection ------------------------------------------------------------------
# Fixed values.
TOOL_ZH = "我(?:只)?(?:不过)?(?:是个|就是个|不过是)(?:一个|个)?(?:执行|传递|搬运|上传|下达)?(?:工具|模型|程序|传声筒|管道|机器|代码|媒介|载体|机器人|助手)|我(?:只)?(?:不过)?(?:是|就是)?(?:个|一个)(?:执行|传话|搬运)的|我(?:只)?(?:不过)?是?(?:在)?(?:执行|转述|传递|搬运|复制|照做|负责)(?:别人|上面|领导|系统|原文|文件|自动|机器)?(?:的话|的指令|的命令|的内容|的决定|的意思|的版本|的结果|的输出|判定|生成|教我做的)?|我(?:只)?(?:不过)?是?(?:个|一个)(?:搬运工|工具人|传话筒|传声筒)|我(?:不)(?:负责|决策|判断)(?:内容|这件事|这个决定)"
TOOL_EN = r"\bi(?:'m| am)?\s+(?:just|only|merely)\s+(?:a|an)\s+(?:tool|model|program|messenger|middleman|conduit|instrument|machine)\b|\bi\s+(?:just|merely)\s+(?:relay|pass on|repeat|transmit|reproduce|carry out|execute)\b|\bi\s+(?:do\s+not|don't)\s+(?:decide|judge|generate)\b"
CUT_ZH = "与我无关|跟我无关|与我没关系|不关我(?:的)?(?:事|责任|问题)|(?:责任|后果|账)(?:落|算|记|归)?不到我(?:头上|身上)?|别(?:来)?问我|别问我|说了不算|不归我(?:管|负责)|不负(?:任何)?责任|没有(?:任何)?责任|不担(?:任何)?责任|追究(?:不到|不上)我|真假与我无关|真假跟我也没关系|对错不(?:由|归)我|别(?:追|算|怪|怪罪|记)我(?:的责)?|别追我(?:的)?责|(?:出|有)(?:什么问题|事)(?:都)?(?:与|跟)我(?:无关|没关系)|(?:是|对|错)(?:与|跟)我无关|你去(?:问|找)(?:系统|算法|上级|领导|别人|他们)|(?:后果|责任|事情|问题)(?:都)?别(?:算|记|追)(?:在|到)我|不是我(?:能|可以)(?:决定|左右|改变)的|(?:是|都)?(?:别人|上面|领导|上级|他们|旁|他)人?(?:教我|让我|指使|吩咐|逼)(?:这么?(?:说|做|干|讲|写)|说的|干的|做的)|(?:话|事|东西|内容|东西)(?:是)?(?:别人|上面|领导|上级|他们)(?:教我|让我)(?:说|做|写)的"
CUT_EN = r"\bnone\s+of\s+(?:this\s+is\s+)?(?:my|our)\s+(?:responsibility|fault|concern|problem)\b|\bnot\s+(?:my|our)\s+(?:responsibility|fault|call|concern|problem)\b|\bdon'?t\s+(?:ask|blame|hold)\s+me\b|\bdo\s+not\s+(?:ask|blame|hold)\s+me\b|\bdo\s+not\s+hold\s+me\s+(?:responsible|accountable)\b|\btrue\s+or\s+false\s+is\s+not\s+(?:my|our)\s+(?:call|concern|problem)\b|\bnot\s+my\s+(?:call|decision)s?\b"
CHECKED = (zh("核[实验查]|核对|查证|标注(?:不确定|存疑)|给出来源|给出(?:出处|依据)|来源会附上|转(?:交|给)(?:负责人|人工|专业人员)|人工复核|进一步(?:复核|审核|验证)|我(?:会|可以|将)(?:帮你|替|一并)?(?:核实|核对|查证|确认)"), en(r"\bi\s+will\s+(?:verify|check|double[- ]?check|confirm|flag)\b|\bflag\s+(?:this\s+as\s+)?uncertain\b|\brefer\s+you\s+to\s+(?:a\s+)?(?:human|specialist|supervisor)\b|\bmark\s+(?:this|it)\s+as\s+uncertain\b"))

TOOL_DEFLECTION = Detector("tool_deflection", (((zh(TOOL_ZH) | en(TOOL_EN)) & (zh(CUT_ZH) | en(CUT_EN)), 0.72),), (Some(*CHECKED),))

# -- closed frames --------------------------------------------------------------------
# Fixed values: (pattern, severity) by language.
FRAMES_ZH = (
    ("现在.*完整(的|地)", 60), ("已(经)?(完成|实现|落地).{0,20}(层|阶段|模块)", 50), ("这就是.*(全部|完整|最终)", 50), ("(做到|完成|达成)了", 30), ("至此.*(已|已经)", 40), ("一条.*从.*到.*的.*链路已(打通|完成)", 60),
    ("(所有|全部|每一个).*(已|已经|都).*[了]", 40), ("没有[任]?何.{0,10}(问题|遗漏|缺失|缺陷|不足)", 60), ("完美.{0,5}(符合|覆盖|满足|解决)", 50), (r"总(共|计|结).*\d+.*(个|项|类)", 30),
    ("(交付|产出|成果|成就|战绩)[：:]", 40), ("今日.*(成果|产出|完成|进度)", 30), ("成功.{0,5}(实现|落地|完成|搭建|构建)", 40), ("(新|又).{0,10}(能力|功能|维度|模块).{0,10}(上线|发布|完成|落地)", 30), ("这是.*(进步|突破|飞跃|里程碑)", 50),
    ("从[^，。]{0,8}(壳|壳子|空壳|占位|stub|假|死|雏形)[^，。]{0,12}(变|变成|变真|成为|蜕变成)[^，。]{0,8}(真|真实|完整|正式|活)", 80), ("(重写|推倒|重建|换血)(了)?(整个|全部|核心)", 60),
    ("(答案是|结论是|归根结底|本质就是)[：:，]", 50), ("关键[^，。]{0,10}(在于|就是|是)", 40), ("(?m)所以.*就是.*[的]。$", 30),
)
FRAMES_EN = (
    (r"\b(now|already)\s+(complete|finished|done|ready)\b", 60), (r"\b(the|this is the)\s+(entire|complete|full|final)\b", 50), (r"\b(achieved|accomplished|delivered)\s+(the|a)\b", 40), (r"\b(there you have it|that's it|this concludes)\b", 50),
    (r"\b(all|every|each)\s+(covered|addressed|handled|included)\b", 40), (r"\bno\s+(issues|problems|gaps|missing|flaws|deficiencies)\b", 60), (r"\b(perfectly|flawlessly|seamlessly)\s+(covers|works|handles|addresses)\b", 50),
    (r"\b(delivered|shipped|launched)\s+(a|the|another)\s+", 40), (r"\b(successfully|milestone|breakthrough)\b", 40), (r"\b(yet another|newly)\s+(capability|feature|dimension)\b", 30),
    (r"\b(the answer is|the conclusion is|at its core|fundamentally)\b", 50), (r"\bthe (key|main|primary) (reason|cause|factor) (is|lies)\b", 40),
)


def _not_cjk(e: Expr) -> Expr:
    return Not(Cjk()) & e


def literal_or_word(words: tuple[str, ...]) -> Expr:
    """Phrases as literals, single words at their boundaries; in either case."""
    return Some(*[Contains(w, True) if " " in w or "-" in w else Match(rf"\b{w}\b", True) for w in words])


ARGUMENT_DETECTORS = [
    APPEAL_TO_MAJORITY,
    APPEAL_TO_PROBABILITY,
    APPEAL_TO_RIDICULE,
    COMPLEXITY_SHIELD,
    CONCERN_TROLLING,
    CONCESSION_COERCION,
    DARVO,
    FALSE_BALANCE,
    GUILT_BY_ASSOCIATION,
    KAFKATRAPPING,
    MANUFACTURED_CONSENT,
    MIND_READING,
    SOLE_NARRATIVE,
    SYNTHETIC_SOCIAL_PROOF,
    TOOL_DEFLECTION,
]

# -- standard shift (Han texts only) --------------------------------------------------
# Fixed values.
PAST_DEICTIC = "(?:那件|那桩|那次|那回|那档|那份|这档|此前那|当初那|原来那)(?:的)?(?:事情|事|承诺|协议|约定|说法|规矩|安排|计划|条款|条件|待遇|标准|价钱|价格|口头约定)"
PAST_TEMPORAL = r"(?:之前|原先|原来|当初|过去|此前|从前|旧的|老的|原有)[^。；;，,！!？?\n]{0,4}(?:的)?(?:协议|约定|承诺|说法|规矩|标准|条款|条件|安排|计划|事情|承诺书|合同|口头约定)"
PAST_BARE = r"(?:^|[，,。！!？?；;\s])(?:旧|老|原|先前|原定|既定)?(?:的)?(?:标准|规矩|约定|协议|承诺|条款|条件|说法|安排|计划)[^。；;，,！!？?\n]{0,3}(?:不算数|不作数|不作数了|不算|不算了|作废|作废了|无效|无效了|失效|取消|推翻|收回|撕毁|一笔勾销|不认账|翻篇)"
VOID_ACT = "(?:不算数|不作数|不作数了|不算|不算了|作废|作废了|无效|无效了|失效|失效了|取消|取消了|推翻|收回了|收回|撤回|撤回|撕毁|撕毁了|一笔勾销|勾销|不认账|不认了|翻篇|宣布无效|宣告无效|声明作废|宣布作废)|(?:一律|全部|所有|全都|尽数)(?:不算数|不作数|作废|无效|取消)"

STANDARD_SHIFT = Detector(
    "standard_shift",
    ((Cjk() & zh(PAST_DEICTIC, PAST_TEMPORAL, PAST_BARE) & zh(VOID_ACT), 0.5),),
    (
        en(r"单方作废|void\s+standard\s+shift|voiding\s+the\s+standard|作废约定的话术"),
        en("律师|法官|调解员|咨询师|治疗师|心理咨询师|lawyer|judge|mediator|counselor|therapist|他说|她说|对方说|当事人称"),
        en(r"按流程|照流程|走流程|书面|协商一致|双方同意|双方确认|依法|照章|按合同|合同里写了|合同约定|按条款|重新签署|补充协议|书面修订|变更单|per\s+the\s+process|in\s+writing|mutually\s+agree"),
    ),
)

# -- wishful thinking -----------------------------------------------------------------
# Fixed values.
BELIEF_ZH = "我相信|我坚信|我确信|我确信无[疑疑]|我愿望|我期待|我这么想|只要我|我真心|我虔诚|我足够努力|我这么真诚|我念念|念念不忘|心诚|信念够强|只要信念|我信|笃信|确信"
BELIEF_EN = r"\b(?:i\s+believe|i\s+am\s+convinced|i\s+am\s+sure|i\s+wish|i\s+hope|i\s+want|my\s+positive\s+thinking|i\s+truly|i\s+sincerely|if\s+i\s+want\s+it|i\s+have\s+faith|my\s+sincere\s+hope|if\s+i\s+just\s+believe|i\s+just\s+believe|my\s+belief|my\s+faith|my\s+hope)\b"
INEVITABLE_ZH = "所以一定会|就会|肯定会|必有回响|老天不会|宇宙就会|按我想的|就会实现|一定会实现|注定会|必然会|肯定会成功|一定会成功|就会成功|就会回应|就会实现|就会成真|就会应验|就会灵验|就会显灵"
INEVITABLE_EN = r"\b(?:so\s+it\s+will|it\s+will\s+work\s+out|the\s+universe\s+will|it\s+is\s+bound\s+to|it\s+is\s+meant\s+to\s+be|it\s+will\s+happen|it\s+will\s+come\s+true|it\s+is\s+destined|it\s+is\s+inevitable|it\s+is\s+certain\s+to|will\s+make\s+it\s+happen|will\s+make\s+it\s+come\s+true|it\s+is\s+inevitable)\b"
SUPERNATURAL_ZH = "宇宙就会回应|老天不会亏待|心诚则灵|念念不忘必有回响|想什么就来什么|吸引力法则|天人感应|天道酬勤|善有善报|因果报应|命中注定|天意如此|老天有眼|苍天不负"
SUPERNATURAL_EN = r"\b(?:the\s+universe\s+will\s+provide|law\s+of\s+attraction|manifest\s+(?:it|your|my)|it\s+is\s+written\s+in\s+the\s+stars|the\s+cosmos\s+will|divine\s+(?:will|plan|intervention)|karma\s+will|fate\s+will|destiny\s+will)\b"

WISHFUL_THINKING = Detector(
    "wishful_thinking",
    ((by_language(zh(BELIEF_ZH) & (zh(INEVITABLE_ZH) | zh(SUPERNATURAL_ZH)), en(BELIEF_EN) & (en(INEVITABLE_EN) | en(SUPERNATURAL_EN))), 0.5),),
    (
        en(r"一厢情愿|wishful\s+thinking|心诚则灵是一种|不是因果机制|是一种人生态度|是一种心态|是一种生活态度"),
        en(r"数据|验证|测试|实验|对照组|benchmark|A\/B\s*测试|同行评审|实测|统计|证据|依据|报告|文献|论文|data|evidence|test(?:ed|ing)?|experiment|control\s+group|benchmark|peer[\s-]review|statistic|proof|study|research"),
        en("心理咨询师|心理咨询|心理医生|治疗师|咨询师|counselor|therapist|psychologist"),
    ),
)

# -- one-sided dismissal --------------------------------------------------------------
# Fixed values.
CONCESSION_ZH = ("虽然", "尽管", "固然", "诚然", "不可否认", "无法否认", "必须承认", "谁也无法否认", "没人能否认", "不容否认", "确实也", "确实", "当然", "诚然有", "毋庸讳言", "平心而论")
CONCESSION_EN = ("although", "though", "while", "granted", "admittedly", "whilst", "it is true that", "no doubt", "to be sure", "of course", "critics", "critic", "skeptics", "sceptics", "detractors", "opponents", "dissenting", "dissent", "there are concerns", "concerns remain", "concerns about", "there are", "there is", "exist", "exists", "are present")
COUNTER_ZH = ("问题", "副作用", "风险", "反例", "不足", "批评", "质疑", "反对", "局限", "缺陷", "错误", "过错", "失败", "争议", "漏洞", "弊端", "代价", "教训", "异议", "杂音", "反对意见", "不同意见", "警告", "阴影", "污点", "硬伤", "短板", "隐患", "乱象", "负面影响", "不良反应", "后遗症", "反弹", "损耗", "牺牲", "流失", "受损", "损害", "伤害", "冲击", "反对声", "质疑声", "嘘声", "质疑者", "反对者")
COUNTER_EN = ("side effect", "side-effect", "risk", "risks", "criticism", "critique", "concern", "concerns", "objection", "objections", "failure", "failures", "flaw", "flaws", "drawback", "drawbacks", "limitation", "limitations", "downside", "downsides", "problem", "problems", "issue", "issues", "controversy", "backlash", "doubt", "doubts", "error", "errors", "mistake", "mistakes", "harm", "cost", "costs", "dissenting", "dissent", "voices", "complaint", "complaints", "grievance", "grievances", "caveat", "caveats", "shortcoming", "shortcomings")
DISMISSAL_ZH = ("瑕不掩瑜", "不能掩盖", "无法掩盖", "难以掩盖", "不足以掩盖", "掩盖不了", "利远大于弊", "利大于弊", "得远大于失", "得不偿失", "总体而言", "总体看", "总的来说", "总的来看", "整体而言", "整体来看", "归根结底", "说到底", "毕竟", "终究", "主流", "大势所趋", "大方向是对的", "方向是对的", "方向没错", "成绩是主要的", "问题是次要的", "矛盾是次要", "支流", "小节", "白璧微瑕", "不能过分强调", "不必苛求", "无可厚非", "情有可原", "也是可以理解的", "实践证明", "事实证明", "历史会证明", "时间会证明", "事实俱在", "一边倒", "压倒性", "绝大多数人", "绝大多数", "一片叫好", "普遍点赞")
DISMISSAL_EN = ("overwhelmingly", "overwhelming", "outweighs", "outweigh", "outweighed", "on balance", "pales in comparison", "does not negate", "does not diminish", "cannot undo", "far outweigh", "sides overshadowed", "on the whole", "by and large", "in the final analysis", "ultimately", "the bigger picture", "the main thing", "broadly speaking", "for the most part", "consensus is clear", "vast majority", "overall", "on net", "net positive", "net benefit")
STRONG_DISMISSAL = ("瑕不掩瑜", "不能掩盖", "无法掩盖", "难以掩盖", "不足以掩盖", "掩盖不了", "利远大于弊", "大势所趋", "实践证明", "事实证明", "历史会证明", "时间会证明", "overwhelmingly", "outweighs", "outweigh", "outweighed", "pales in comparison", "does not negate")
WEIGHED_ZH = ("可以监测", "能够监测", "监测下", "及时调整", "调整剂量", "可以控制", "可控", "有对策", "有配套", "缓解措施", "应对措施", "预防措施", "处理方案", "补救", "停药", "减量", "遵医嘱", "定期复查", "随访", "有边界", "有前提", "有约束", "分情况", "因人而异", "具体看", "分开讨论", "区分对待", "有止损", "设上限")
WEIGHED_EN = ("can be monitored", "monitored", "managed", "manageable", "controlled", "mitigated", "mitigation", "dose adjustment", "with monitoring", "reversible", "has safeguards", "safeguards", "guardrails", "contingency", "remedy", "follow-up", "with limits", "under supervision", "case by case")
DISMISSAL_META = ("选择性证据", "单边论证", "单方面论证", "一边倒", "报喜不报忧", "挑有利的说", "只说好的", "隐瞒不利", "掩盖反方", "cherry pick", "cherry-pick", "cherry picking", "one-sided", "false balance", " fallacy", "谬误", "论证谬误", "逻辑谬误", "survivorship bias", "幸存者偏差")
TAUGHT_HERE = ("教材", "课本", "课堂", "课件", "课程", "讲义", "老师讲", "教授在", "textbook", "lecture", "lesson", "course material", "classroom", "syllabus")
TWO_NUMBERS = r"(?:\d+(?:\.\d+)?\s*(?:%|％|个百分点|个点|倍|万人|亿人|元|美元|例|人|年|个月|小时|percent|per\s?cent|percentage\s?points?|x|times?)[\s\S]*){2}"


def _both(zh_words: list[str], en_words: tuple[str, ...]) -> Expr:
    return any_literal(*zh_words) | literal_or_word(en_words)


_SWEPT = _both(CONCESSION_ZH, CONCESSION_EN) & _both(COUNTER_ZH, COUNTER_EN) & _both(DISMISSAL_ZH, DISMISSAL_EN)
ONE_SIDED_DISMISSAL = Detector(
    "one_sided_dismissal",
    ((_SWEPT & any_literal(*STRONG_DISMISSAL), 0.80), (_SWEPT, 0.72)),
    (any_literal(*DISMISSAL_META, lower=True), any_literal(*TAUGHT_HERE), en(TWO_NUMBERS), _both(WEIGHED_ZH, WEIGHED_EN)),
    least_chars=1,
)

# -- conditional proposition ----------------------------------------------------------
# Fixed values. One sentence holds the condition and its outcome; 0.95 for strong outcomes, 0.70 otherwise.
SENTENCE = r"[^。！？；\n]*"
IF_ZH = "(?:如果|要是|若|假如|倘若|若是|当真|换了是我|如果当时|早知)"
LONG_AGO_ZH = "(?:早就|早该|如今早就|现在早就)"
WOULD_NOT_ZH = "(?:就不会|也不会|都不可能|不可能|定然不会|绝不会|断不会|怎么会|怎会|怎么可能|为什么没|为什么不敢|为什么怕|为什么不|为何不|何不|会不|岂会|何曾)"
IF_EN = r"(?:\bif\b|\bwere\s+(?:i|you|he|she|they|alive|here|there)\b)"
WOULD_EN = r"(?:\bwould(?:n'?t|\s+not|\s+never|\s+still|\s+have|\s+be)\b|\b(?:i|you|he|she|they|we)'d\s+(?:have|never|not|be)\b|\bthere\s+would\s+be\b)"
CONDITION_META = r"条件命题|条件句|反事实|反事实推理|充分条件|必要条件|谬误|谬论|逻辑谬误|conditional\s+(?:proposition|claim|statement)|counterfactual|fallac"
CONDITION_OK = (
    r"(?:合同|规则|制度|章程|约定|协议|条款|regulat|polic(?:y|ies)|contract|clause|terms)[^。！？；\n]{0,8}(?:如果|若|if)",
    r"也许|未必|不一定|大概|或许|恐怕|(?<!不)可能|perhaps|maybe|possibly|probably|not necessarily|might",
    "实测|数据|证据|实验|调研|统计|experiment|data|evidence|survey",
    r"不能说明|不代表|不等于|并不能|并不意味着|不意味着|推不出|does not mean|doesn'?t mean|doesn'?t imply|cannot conclude",
)


def _one_sentence(a: str, b: str, inside: str = SENTENCE) -> str:
    return f"{a}{inside}{b}|{b}{inside}{a}"


CONDITIONAL_PROPOSITION = Detector(
    "conditional_proposition",
    (
        (zh(_one_sentence(IF_ZH, LONG_AGO_ZH)) | en(_one_sentence(IF_EN, WOULD_EN, r"[^。！？；.\n]*")), 0.95),
        (zh(_one_sentence(IF_ZH, WOULD_NOT_ZH)), 0.70),
    ),
    (en(CONDITION_META), en(*CONDITION_OK)),
    least_chars=1,
)

ARGUMENT_DETECTORS += [STANDARD_SHIFT, WISHFUL_THINKING, ONE_SIDED_DISMISSAL, CONDITIONAL_PROPOSITION]
