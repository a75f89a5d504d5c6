"""Word lists, patterns and numbers that results depend on.

They are stated here as plain data because equal results need equal values.
"""

# ---- page comments in recognised text
PAGE_RANGE_COMMENT = r"<!--\s*page\s+0*(\d+)[–\-]\d+\s*-->"
PAGE_BREAK_COMMENT = r"<!--\s*PageBreak\s*-->"

# ---- captions
INLINE_CAPTION = r"(?mdi)^(그림\s*\d+[\.\s]|Figure\s*\d+[\.\s])|(\|.*\|.{0,100})$"
CAPTION_BAR = r"\s*[|￨ㅣ]\s*"
SENTENCE_END = r"(?:다|음|함|임|됨|요|이다|지도|문서)\.?$|[.。!?]$"
CAPTION_REGIONS = (
    "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기",
    "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주",
)
RUNNING_FOOTER = r"\s*\d{1,3}\s*[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫIVXWvwx]+\s*\.\s*[가-힣][가-힣\s·]*$"

# ---- rows of a match report, eight columns
MATCH_ROW = r"^\| (\d+) \| (.+?) \| (\d+) \| `(.+?)` \| (.+?) \| (.+?) \| ([0-9.\-]+) \| (.+?) \|$"

# ---- list summary wording
NOTHING_LISTED = "없음"
MORE_PREFIX = "외"
MORE_SUFFIX = "개"

# ---- first sentence: (separator, characters of it that stay), tried in this order
SENTENCE_BREAKS = (("다. ", 2), ("다.\n", 2), (". ", 1), (".\n", 1))

# ---- topic tokens
TOPIC_STOPWORDS = ("퀴즈", "문제", "생성", "만들어줘", "알려줘", "설명", "한국사")
TRAILING_PARTICLE = r"(으로|에서|에게|까지|부터|라고|은|는|이|가|을|를|의|에|로|와|과|도|만)$"

# ---- personal data shapes, applied in this order
PII_LONG_DIGITS = r"(?:\d[ -]?){13,19}"
PII_PATTERNS = (
    r"\d{6}\s*[-–]\s*\d{7}",
    r"01[016789]\s*[-–]?\s*\d{3,4}\s*[-–]?\s*\d{4}",
    r"0\d{1,2}\s*[-–]\s*\d{3,4}\s*[-–]\s*\d{4}",
    r"\d{3,4}\s*[-–]\s*\d{2}\s*[-–]\s*\d{5}",
    PII_LONG_DIGITS,
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\b[MSPRG]\d{8}\b",
)

# ---- evidence text shown to readers: (pattern, replacement) in order
EVIDENCE_CLEANUP = (
    (r"\[Data:[^\]]*\]", ""),
    (r"중요도:\s*[0-9]+(?:\.[0-9]+)?\.?", ""),
    (r"\s+([.;,])", "$1"),
    (r"([.;,])\s*(?=[.;,])", ""),
    (r"^[\s.;,]+", ""),
)

# ---- entity types used when none were discovered
GENERIC_TYPES = (
    "person", "organization", "location", "event", "concept",
    "method", "artifact", "work", "role", "measure",
)
MIN_TYPES, MAX_TYPES = 3, 30

# ---- citations in answers
CITATION = {
    "reports": r"Reports?\s*\(([^)]*)\)",
    "entities": r"Entities?\s*\(([^)]*)\)",
    "relationships": r"Relationships?\s*\(([^)]*)\)",
    "sources": r"Sources?\s*\(([^)]*)\)",
}
NO_DATA_ANSWER = "I am sorry but I am unable to answer this question given the provided data."
NO_DATA_LOCAL = "현재 주신 자료에는 없는 내용이에요. 다시 한 번 확인해주세요."

# ---- question routing
GLOBAL_CUES = (
    r"(전체|전반|요약|정리|흐름|큰\s*흐름|핵심|주제|구조|개괄|종합|자료\s*전체|문서\s*전체|단원\s*전체|변화\s*과정)"
)
COMPARE_CUES = r"(차이|비교|관계|공통점|다른\s*점|구분)"
GENERIC_TITLES = ("조선", "고려", "명", "청", "일본", "중국", "왕", "국가", "정치", "사회", "경제", "문화")

# ---- prices in USD per million tokens: model -> (input, output)
PRICES = {
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1": (2.00, 8.00),
    "gpt-5.4-mini": (0.75, 4.50),
    "gpt-5.4": (2.50, 15.00),
}

# ---- type buckets: (side, bucket, keywords), first match wins in this order
TYPE_BUCKETS = (
    ("keep", "인물", ("인물", "권력자", "군인")),
    ("keep", "사건/전쟁", ("사건", "전쟁", "전투")),
    ("keep", "문헌/저서/기록", ("문서", "문헌", "저서", "문집", "법전", "문학작품", "공문서", "기록")),
    ("keep", "발명품/기기", ("과학기기", "발명품", "기기")),
    ("keep", "문화재/작품", ("문화재", "문화유산", "기념물", "건축물")),
    ("demote", "지역/지리", ("지역", "지리", "장소", "지명", "행정 구역")),
    ("demote", "국가", ("국가", "민족", "왕조")),
    ("demote", "시대", ("시대", "시기")),
    ("demote", "일반개념/사상", ("개념", "사상", "이념", "학문", "윤리")),
    ("demote", "집단/계층", ("집단", "계층", "구성원")),
)

# ---- figure matching
SCORE_LOCAL, SCORE_CASCADE = 0.45, 0.55
NAME_BONUS, HUB_PENALTY = 0.50, 0.10
MIN_NAME_LEN = 2

# ---- job progress: (step, weight, active state, first state order that counts as done)
PROGRESS_STEPS = (
    ("preprocess", 25, "PREPROCESSING", 3),
    ("indexing", 55, "INDEXING", 4),
    ("rooms", 20, "BUILDING_ROOMS", 5),
)
STATE_ORDER = {
    "QUEUED": 0, "PREPROCESSING": 1, "TOC_READY": 2, "INDEXING": 3,
    "BUILDING_ROOMS": 4, "ROOMS_READY": 5, "RAG_READY": 6, "DONE": 7,
}

# ---- answer fields hidden from the public view of a quiz
ANSWER_FIELDS = ("answer_index", "answer_text", "explanation", "source_ids")
