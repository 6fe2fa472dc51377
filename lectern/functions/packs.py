"""Lexicon packs: what the detectors look for is data.

``ZH`` holds the Chinese lists, ``LATIN`` our own small lists for Latin-script
corpora.  Dictionaries for the tokenizer are longer than a list here should be
and are a parameter of the operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pack:
    ends: str  # between sentences
    visible: str  # a character that counts
    closing: str  # what a whole text ends with
    lists: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)
    excludes: tuple = ()
    grades: dict = field(default_factory=dict)
    similes: tuple = ()
    patterns: tuple = ()
    placeholders: tuple = ()
    genres: dict = field(default_factory=dict)
    letters: str = "[一-鿿]"  # what information is measured by
    marks: str = "[“”！？。，]"
    quotes: str = "[“”]"
    verbs: tuple = ()
    senses: dict = field(default_factory=dict)
    sense_excludes: tuple = ()
    blocking: tuple = ()  # patterns of a line that block
    reactions: tuple = ()  # of bodies, which wear out like images
    soft: tuple = ()  # placeholders, from 1, that lines of dialogue may show
    title: str = "^第[一二三四五六七八九十百千万两0-9]+章"
    meta_2: str = "第[一二三四五六七八九十百千万两0-9]+章|本章|这一章|上一章|下一章|上章|下章|前一章|后一章|前文|后文|伏笔|读者|任务描述"


#: The Chinese word lists and patterns.
ZH = Pack(
    ends="[。！？!?…\n]+",
    visible="[一-鿿Ａ-ｚA-Za-z0-9]",
    closing="[。！？!?…\"'』」）)】\\]”’]",
    lists={
        "connectors": ("然而", "此外", "与此同时", "值得注意的是", "综上所述", "不可否认", "毋庸置疑", "总而言之", "换言之"),
        "emotion_direct": ("悲伤", "愤怒", "绝望", "心碎", "痛苦", "震惊", "恐惧", "哀伤", "悲凉", "凄凉", "心酸", "心寒", "胆寒", "震撼", "震怒", "狂怒", "悲愤", "哀怨", "忧伤", "惶恐", "惊恐", "惶惑", "焦灼", "焦躁"),
        "ban_a": ("意味着", "是因为", "这说明", "他发现", "他心里明白", "他在等", "他意识到", "显然", "可见", "看出规律", "异乎寻常"),
        "ban_b": ("觉得", "知道", "看来"),
        "imagery": ("阴影", "光斑", "碎片", "铜钱", "灰尘", "风铃", "钟表", "走针", "裂痕", "裂缝", "回声", "倒影", "水纹", "涟漪", "雾气", "余烬", "锈迹", "裂纹", "碎屑", "残影", "波纹", "寒意", "腥味", "霉味", "焦味", "铁锈味", "潮气", "湿气", "暮色", "晨光", "残阳", "冷月", "烛火", "灯影"),
        "transitions": ("首先", "其次", "最后", "与此同时", "在这个瞬间", "不禁", "不由得", "值得注意的是", "综上所述", "总而言之", "换言之", "不可否认", "毋庸置疑", "在这个过程中", "与此同时", "就在这时", "一时间", "刹那间", "须臾间"),
        "starts": ("然而", "不过", "与此同时", "于是"),
        "vague_time": ("不知过了多久", "片刻之后", "须臾间", "不知不觉", "不知何时", "转眼间", "霎时间"),
        "cliches": ("剑眉星目", "肤若凝脂", "一袭白衣", "倾国倾城", "眉目如画", "五官轮廓分明", "眼神深邃", "嘴角微扬", "肌肤胜雪", "明眸皓齿", "面如冠玉", "风度翩翩", "冰肌玉骨", "国色天香"),
        "breathy": ("低声道", "轻声说", "喃喃道", "低语", "呢喃", "沙哑着嗓子说", "低声说", "柔声说", "轻声道"),
        "reward": ("打脸", "翻盘", "碾压", "突破", "震惊", "反转", "秒杀", "吊打", "震撼", "倒吸凉气", "不敢置信"),
        "feeling": ("爽", "怒", "惊", "悲", "惧", "暖"),
        "plot": ("推进", "发现", "得知", "出发", "前往", "决定"),
        "character": ("回忆", "想起", "性格", "习惯", "口癖"),
        "foreshadow": ("伏笔", "暗示", "线索", "异常"),
        "hooks": ("？", "?", "悬念", "未知", "突然", "只见", "然而", "就在这时", "不料", "谁知", "下一步", "到底", "究竟"),
        "particles": ("啊", "呢", "吧", "嘛", "哦", "呀", "哩", "呗", "哈", "唉", "嗯", "哇", "哎", "喂"),
        "roles": ("长老", "将军", "帝王", "皇帝", "老师", "教授", "医生", "法师"),
        "meta_1": ("细纲", "情节点", "卷纲", "功能标签", "目标情绪", "字数目标", "章首钩子", "章尾钩子"),
    },
    categories={
        "爽": ("爽", "痛快", "畅快", "解气", "过瘾", "舒坦", "舒服", "满足", "得意", "痛快淋漓", "扬眉吐气", "酣畅", "尽兴", "快意", "快活", "惬意", "顺心", "如愿"),
        "燃": ("燃", "热血", "激昂", "振奋", "激动", "兴奋", "激荡", "澎湃", "汹涌", "沸腾", "燃烧", "冲锋", "拼搏", "战斗", "崛起", "爆发", "怒吼", "咆哮"),
        "虐": ("虐", "痛", "苦", "悲", "伤", "绝望", "痛苦", "悲伤", "心碎", "心酸", "心寒", "心死", "凄凉", "凄惨", "悲凉", "悲恸", "哀伤", "哀恸", "痛彻心扉", "撕心裂肺", "肝肠寸断"),
        "酸": ("酸", "感动", "心疼", "心软", "温暖", "温柔", "柔情", "怜惜", "不舍", "牵挂", "惦念", "想念", "思念", "怀念", "惆怅", "感伤", "鼻酸", "眼眶", "泪目", "哽咽"),
        "惧": ("惧", "怕", "恐惧", "害怕", "畏惧", "惊恐", "惶恐", "不安", "紧张", "焦虑", "慌张", "慌乱", "惊慌", "胆寒", "战栗", "颤抖", "发抖", "毛骨悚然", "不寒而栗"),
        "暖": ("暖", "安心", "放心", "踏实", "宁静", "平和", "安详", "欣慰", "释然", "轻松", "自在", "从容", "坦然", "幸福", "甜蜜", "温馨", "和睦", "安好"),
    },
    excludes=("头痛", "痛点", "痛风", "痛经", "刻苦", "苦力", "苦水", "苦心", "苦工", "苦于", "伤亡", "伤口", "伤害", "伤势", "伤员", "伤身", "哪怕", "怕生", "酸软", "酸痛", "暖和", "暖流"),
    grades={
        "S": ("破防", "破防了", "社死", "真香", "打工人", "干饭人", "佛系", "YYDS", "yyds", "绝绝子", "炸毛", "暴走", "凉凉", "麻了", "笑死", "哭哭", "就这"),
        "A": ("我裂开", "蚌埠住了", "冲鸭", "比心", "栓Q", "栓Q了", "芭比Q", "摆烂", "躺平", "内卷", "卷王", "摸鱼", "划水", "凡尔赛", "赢麻了", "带薪摸鱼"),
        "B": ("emo", "emo了", "破大防", "大无语事件", "小丑竟是我自己", "智商税", "割韭菜", "画大饼", "PUA", "CPU", "KTV", "PPT"),
        "C": ("赛博对账", "敬自己一杯", "泰裤辣", "遥遥领先", "硬控", "绝杀"),
    },
    similes=(
        "像[^\"\"」』\n]{1,20}一样",
        "像[^\"\"」』\n]{1,20}似的",
        "像[^\"\"」』\n]{1,15}(?:一般|般)",
        "仿佛[^\"\"」』\n]{2,25}",
        "如同[^\"\"」』\n]{2,25}",
        "宛若[^\"\"」』\n]{2,20}",
        "好似[^\"\"」』\n]{2,20}",
        "犹如[^\"\"」』\n]{2,20}",
    ),
    placeholders=(
        "作为(一个)?(AI|人工智能|大?语言模型|智能助手|聊天助手)(?=[，,。、；;：:！!？?\\s）)」』\"】]|我|无法|不能|没法|\\z)",
        "\ufffd",
        "^(Sure|Certainly|Here'?s|As an AI|I (?:cannot|can't|am unable|apologize))",
        "[（(](此处|以下|这里|下文|后续)?\\s*(省略|略)(去|过)?[^）)]{0,10}[）)]",
        "(未完待续|TODO|占位符|placeholder)",
        "我(无法|不能)(继续(写|创作|生成|下去)|生成(内容|文本|正文)?|创作|续写|完成(这个|本)?(章|篇|创作|请求))",
    ),
    genres={
        "都市": ("S", "A", "B"), "职场": ("S", "A", "B"), "系统": ("S", "A", "B"), "轻小说": ("S", "A", "B", "C"), "二次元": ("S", "A", "B", "C"),
        "玄幻": ("S", "A"), "修仙": ("S", "A"), "言情": ("S",), "悬疑": (), "恐怖": (), "历史": (), "严肃": (), "严肃文学": (), "武侠": ("S",), "科幻": ("S", "A"), "同人": ("S", "A", "B"),
    },
    soft=(1, 6),
    verbs=("走", "跑", "跳", "说", "看", "想", "拿", "放", "坐", "站", "转", "回", "伸", "握", "抬"),
    senses={
        "sight": ("看", "望", "瞥", "瞪", "盯", "瞄", "瞧", "瞅", "凝视", "注视", "俯瞰", "仰望", "环顾", "打量", "端详", "视线", "目光", "瞳孔", "眼神", "眺望"),
        "hearing": ("听", "响", "声", "嘶", "嚷", "喊", "叫", "咆哮", "低语", "呢喃", "轰鸣", "回响", "喧嚣", "嘈杂", "沉寂", "寂静", "呼啸", "嗡嗡", "滴答", "沙沙"),
        "smell": ("嗅", "腥", "香", "臭", "腐", "霉", "焦", "铁锈", "潮", "湿", "气味", "刺鼻", "腥味", "焦味", "霉味", "腐臭", "芳香"),
        "taste": ("尝", "舔", "甜", "苦", "辣", "咸", "涩", "酸", "鲜", "甘", "腥甜", "苦涩", "酸甜", "咸腥"),
        "touch": ("摸", "碰", "触", "热", "冷", "疼", "痛", "麻", "痒", "凉", "暖", "冰", "烫", "粗糙", "光滑", "湿润", "干燥", "颤抖", "僵硬", "酸软"),
    },
    sense_excludes=(
        "看待", "看重", "看法", "看不起", "看得起", "看作", "看做", "看透", "看开", "看破", "看病", "看穿", "看中", "看上", "期望", "绝望", "愿望", "欲望", "希望", "盼望", "渴望", "指望",
        "声明", "声张", "不动声色", "声势", "声誉", "声称", "声调", "声望", "响应", "影响", "叫做", "刻苦", "困苦", "苦笑", "苦心", "苦力", "苦水", "苦于", "辛酸", "酸楚", "酸痛",
        "冷静", "冷淡", "冷漠", "冷清", "冷酷", "冷落", "冷战", "热心", "热情", "热门", "热闹", "热切", "热衷", "头痛", "痛点", "痛风", "痛经", "麻烦", "麻利", "荒凉", "凄凉",
    ),
    reactions=("后脖颈", "发凉", "手心出汗", "喉结", "指节发白", "脊背", "头皮发麻", "太阳穴", "脉搏", "屏住呼吸", "瞳孔收缩", "嘴角抽搐", "眼皮跳", "牙关紧咬", "掌心湿润", "后背发凉", "膝盖发软", "手指发抖", "胃部痉挛", "胸口发闷"),
    blocking=(
        "不是[^，。！？\n]{2,40}(?:而是|只有|那是一种|唯有)",
        "(?:没有|不是|并非)[^，。；！？\n]{2,30}[，](?:没有|不是|并非)[^，。；！？\n]{2,30}[，]",
    ),
)

#: Terms measured in Latin-script corpora; counted as substrings.
LATIN = Pack(
    ends="[.!?…\n]+",
    visible="[\\p{L}\\p{N}]",
    closing="[.!?…\"')\\]]",
    lists={
        "connectors": ("and", "with", "der", "sich", "avec"),
        "emotion_direct": ("whst", "dans", "con", "por", "und"),
        "ban_a": ("idiot", "clown", "moron"),
        "ban_b": ("with", "from", "pour"),
        "imagery": ("thing", "tion", "ance", "chen", "elle", "rr"),
        "transitions": ("then", "and", "und", "avec", "con", "and"),
        "starts": ("The", "And", "Le", "De", "Der"),
        "vague_time": ("whst", "thin", "ouch"),
        "cliches": ("icense", "token ="),
        "breathy": ("###", "***", "%%%", "&&&"),
        "reward": ("###", "token =", "!!"),
        "feeling": ("whst", "dans", "con"),
        "plot": ("and", "und", "de"),
        "character": ("with", "sich", "avec"),
        "foreshadow": ("from", "por"),
        "hooks": ("!", "icense", "and", "con"),
        "particles": ("a", "y", "à"),
        "roles": ("the", "der"),
        "meta_1": ("token =", "icense"),
    },
    categories={"w": ("whst", "when", "what", "wh"), "d": ("dans", "des", "der"), "c": ("con", "como"), "p": ("por", "pour", "par"), "u": ("und", "un")},
    excludes=("contion", "wher", "unter"),
    grades={"S": ("###",), "A": ("***",), "B": ("token =",), "C": ("icense",)},
    similes=("like [^\"\n]{1,20} the", "as [^\"\n]{1,20} of"),
    placeholders=("token = \"", "(MIT|Apache) License", "^(Released|Licensed)"),
    genres={"en": ("S", "A", "B"), "fr": ("S", "A"), "de": ("S",), "es": ()},
    letters="[A-Za-z]",
    marks="[,.!?]",
    quotes='"',
    verbs=("go", "de", "la", "is"),
    senses={"w": ("whst", "wh"), "d": ("des", "der", "de"), "c": ("con", "co"), "p": ("por", "pour"), "u": ("und",)},
    sense_excludes=("contion", "unter", "dem"),
    reactions=("ould", "igh", "ous"),
    blocking=("not [^,.!?\n]{2,40} but", "(?:no|not|sin) [^,.;!?\n]{2,30},[^,.;!?\n]{2,30},"),
)
