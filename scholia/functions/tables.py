"""Character tables, word lists and aliases that results depend on."""

# Fixed values. Full-width forms U+FF01 to U+FF5E and their half-width twins.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

# Fixed values. Punctuation that fonts vary: each of the first string becomes its fellow of the second; the dots at the end vanish.
FOLD_FROM = "（）【】：，。；／·•"
FOLD_TO = "()[]:,.;/"

# Fixed values. Marks that a scope key leaves out.
SCOPE_MARKS = "《》〈〉()[]:,.;"

# Fixed values. Punctuation that grading ignores.
GRADING_MARKS = "[，。、；：！？.,;:!?\"'（）()“”‘’]"

# Fixed values. Labels of answer books, headings that only name a type (anywhere in a part), and such headings alone.
BOOK_LABELS = ["参考答案及解析", "答案及解析", "参考答案", "答案解析"]
TYPE_HEADINGS = ["单项选择", "单选题", "多项选择", "多选题", "判断题", "填空题", "简答题", "主观题", "案例分析题", "辨析题", "论述题"]
TYPE_HEADINGS_EXACT = ["选择题", "单选", "多选", "答案速查", "答案速查表"]

# Fixed values. Grams that are no evidence: those up to three characters that hold one of these, and any that hold one of those.
GENERIC_SHORT = [
    "根据", "规定", "教师", "学生", "教育", "案例", "问题", "应当", "可以", "具有", "基本", "要求", "简述", "课堂", "教学", "行为", "作用", "内容", "分析", "方式", "观点", "核心", "素养", "发展", "新课程",
]
GENERIC_WORDS = ["基本要求", "课堂教学", "简述", "教学观点", "新课程改革", "课堂", "教学", "提问", "口语", "基本", "要求", "老师", "提问的基本", "口语的基本"]

# Fixed values. Aliases of question types.
TYPE_ALIASES = {
    alias: kind
    for kind, aliases in {
        "single_choice": ["single", "single_choice", "singlechoice", "choice", "one_choice"],
        "multiple_choice": ["multiple", "multiple_choice", "multiplechoice", "multi_choice", "multichoice", "composite", "case_multiple_choice", "case_choice", "case_multiple"],
        "true_false": ["true_false", "trueorfalse", "true_or_false", "judge", "judgement", "judgment", "statement_or_true_false", "tf"],
        "fill_in_blank": ["fill", "fill_in", "fill_in_blank", "fill_in_the_blank", "fillblank", "fill_blank", "blank_filling", "blank"],
        "subjective": [
            "qa", "essay", "short_answer", "shortanswer", "subjective", "subjective_question", "case_analysis", "case", "analysis", "explain", "material", "material_analysis", "reading_comprehension", "简答题", "论述题", "辨析题", "案例分析题",
        ],
    }.items()
    for alias in aliases
}

# Fixed values. Review: days by number of reviews so far; what a result adds to mastery; weights of the priority.
LADDER = [1.0, 3.0, 7.0, 15.0, 30.0]
AGAIN_DAYS = 0.007
MASTERY_STEP = {"again": -20.0, "hard": -5.0, "good": 10.0, "easy": 15.0}
PRIORITY = {"wrong": 2.0, "overdue": 1.5, "difficulty": 0.5, "forgetting": 1.0, "mastery": 0.4}

# Fixed values. Boundary score of two neighbouring drafts, and what decides it.
BOUNDARY = {"base": 0.22, "same_batch": 0.10, "left_cut": 0.32, "right_goes_on": 0.32, "sub_question": 0.08, "warning": 0.08, "same_type": 0.05, "other_type": -0.16, "overlap": 0.10}
MERGE_AUTO, MERGE_REVIEW, NEW_QUESTION = 0.92, 0.70, 0.05

# Fixed values. An anchor's own number with an answer right after it: letters, a sign or a word; with any text. What opens an explanation.
EXPLICIT_ANSWER = r"^\s*(\d{1,4})\s*[\.．、:：\s]+((?:[A-Fa-f](?:\s*[、,，/\\+&]\s*)?){1,6}|[√✓✔×✕✗Xx]|正确|错误)"
FREE_ANSWER = r"^\s*(\d{1,4})\s*[\.．、:：\s]+(.+)$"
ANALYSIS_MARKERS = ["【解析】", "（解析）", "[解析]", "解析：", "解析:"]

# Fixed values. Lines that are only page numbers, lines that open a question, numbers printed in a margin, and what opens a new question in an upload.
PAGE_NUMBER = r"^\s*(?:第\s*\d+\s*页|[-—–]?\s*\d+\s*[-—–]?|Page\s*\d+)\s*$"
QUESTION_START = r"^\s*(?:(\d+)[\.、．]|第\s*\d+\s*题|[（(]\s*\d+\s*[）)])\s*"
PRINTED_MARKER = r"(?m)^\s*([0-9]{1,3})\s*(?:[.、,，]\s+|[.、,，]《|[《（(])"
NEW_QUESTION_MARK = r"^\s*(?:第\s*[0-9０-９]+\s*题|[0-9０-９]+\s*[\.、．）)]|[一二三四五六七八九十]+[、.．])"

# Fixed values. Warnings that say a stem begins or ends midway, words that mark material questions, and an answer in a user's reply: number, then answer.
START_WARNINGS = ["开头", "缺少题干"]
END_WARNINGS = ["截断", "缺少后续", "不完整"]
MATERIAL_WORDS = ["本案", "材料", "案例", "学校", "班主任", "家长", "承担责任"]
USER_ANSWER = r"(?:第\s*([0-9０-９]+)\s*题|[Qq]\s*([0-9０-９]+)|([0-9０-９]+)\s*[.、,，)）：:：]?)\s*(?:选|答案[是为]?|[:：])?\s*([A-Za-z√×✓✗○●对错正确错误无需TF]+)"

# Fixed values. Stages of an import run: progress at their start, and the share of the whole that each is.
RUN_STAGES = {"rendering": (0.0, 0.05), "catalog": (0.05, 0.30), "candidate_review": (0.0, 1.0), "linking": (0.90, 0.05), "validating": (0.95, 0.05)}

#: Section and number prefixes before a question's own text.
ANSWER_PREFIX = r"^(?:(?:第?[0-9一二三四五六七八九十百]+[题.．、)）:：]|[（(][0-9一二三四五六七八九十百]+[)）])\s*)+"

#: A numbered topic before a scope's own name, a sub-question's number, and what opens a stem midway.
TOPIC_PREFIX = "^专题[一二三四五六七八九十百千万0-9]+(.+)$"
SUB_QUESTION = "[（(][0-9０-９]+[）)]"
MID_START = "^(?:[，。；：、]|" + SUB_QUESTION + ")"

#: Letters whose capital is written with several letters, and their capital of one letter: a title-case one if there is any, else the letter itself; letters that got a capital with Unicode 16 only, which stay as they are.
_SEVERAL = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
_LATE = "ƛɤ\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
ONE_CAPITAL_FROM = "".join(_SEVERAL) + _LATE
ONE_CAPITAL_TO = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL) + _LATE
