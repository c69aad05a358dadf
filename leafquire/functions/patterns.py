"""Patterns and word lists that results depend on, and default limits."""

# Words of the keyword index, and question words that a query drops.
WORD = "[0-9A-Za-z가-힣]+"
STOPWORDS = (
    "얼마 얼마야 얼마인가 어떻게 어떡해 누가 언제 어디 어디야 왜 몇 몇년 뭐 무엇 인가 인가요 일까 할까 되나 되나요 해줘 알려줘 있어 있나 야 요 좀 최대 경우 하는 "
    "이 가 은 는 을 를 의 에 로 과 와 도 만 퍼센트"
).split()

# Table-of-contents lines.
DOTS = "·․‥…．.∙•"
LEADER = f"[{DOTS}]{{2,}}"
TERMINATOR = rf"(?U)[{DOTS}]{{2,}}\s*(\d{{1,3}})(?:\s|$)"
TOC_SKIP = ("CONTENTS", "목 차", "목  차", "목차")
DECOR = "^[◆◇■□▶●○※]"
CAPTION = r"(?U)^[<\[]\s*(?:표|그림)\s*[\d\-–~]+\s*[>\]]"
PAGE_NUMBER = r"(?U)^[/\\]?\s*\d{1,3}\s*[/\\]?$"

# Heading numbers, as rules (pattern, level).
LEADING_NUMBER = r"(?U)^(?:제\s*\d+\s*[장절]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\s*[.．]?|\d+\s*[.．]|\(\d+\)|[<\[]\s*(?:참고|부록|붙임|부칙)\s*\d*\s*[>\]]?)\s*"
CHAPTER = r"(?U)^제\s*(\d+)\s*장(?:\s|$)"
SECTION = r"(?U)^제\s*(\d+)\s*절(?:\s|$)"
ROMAN = r"(?U)^([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+)\s*[.．]?(?:\s|$)"
ARABIC = r"(?U)^(\d+)\s*[.．](?:\s|$)"
PAREN = r"(?U)^\((\d+)\)(?:\s|$)"
NOTE = r"(?U)^[<\[]?\s*(?:참고|붙임|부칙)\s*\d*\s*[>\]]?\s*[.:：]?"
APPENDIX = r"(?U)^[<\[]?\s*부록\s*\d*\s*[>\]]"
LEVELS = {
    "chapter_section": ((CHAPTER, 1), (APPENDIX, 1), (SECTION, 2), (ARABIC, 3), (PAREN, 4), (NOTE, 5)),
    "chapter": ((CHAPTER, 1), (APPENDIX, 1), (ARABIC, 2), (PAREN, 3), (NOTE, 4)),
    "roman": ((ROMAN, 1), (APPENDIX, 1), (ARABIC, 2), (PAREN, 3), (NOTE, 4)),
}

# Form catalogs.
COVER = r"(?U)^<\s*부록\s*(\d+)\s*>"
FORM_NO = r"(?U)^(제\s*\d+\s*호|별표\s*\d+|\d+\s*[.．])\s*"
DELETED = "삭제"
DECLARED = r"(?U)\(\s*(\d+)\s*종\s*\)"

# Law names, longest first, and the patterns of citations.
LAWS = (
    "국가연구개발혁신법 시행규칙", "국가연구개발혁신법 시행령", "국가연구개발혁신법", "국가연구개발사업 연구개발비 사용 기준", "과학기술기본법",
    "혁신법", "시행규칙", "시행령", "고시", "법",
)
LAW = "|".join(LAWS)
ALIASES = {
    "법": "국가연구개발혁신법", "혁신법": "국가연구개발혁신법", "시행령": "국가연구개발혁신법 시행령", "시행규칙": "국가연구개발혁신법 시행규칙",
}
ARTICLE = rf"(?U)(?:({LAW})\s*)?(제\s*\d+\s*조(?:\s*의\s*\d+)?(?:\s*제?\s*\d+\s*항)?(?:\s*제?\s*\d+\s*호)?)"
ATTACHMENT = rf"(?U)(?:({LAW})\s*)?[\[［]?\s*(별표|별지)\s*(?:제\s*)?(\d+)\s*(?:호)?\s*(?:서식)?\s*[\]］]?"

# Words of results.
FRONT = "머리말"
FORMS = "서식 목록"
FORM_RECORD = "서식명: %s\n근거: %s %s\n수록 위치: 본권 인쇄 p%d~%d"

# Limits of layout, chunks, search and context.
MARGIN = 60.0
FOOTER_SHARE = 0.92
TYPESET_OVER = 0.4
FUZZY_MIN = 0.72
CHUNK_CHARS = 700
TABLE_CHARS = 1800
LEAD_IN_CHARS = 60
CAPTION_GAP = 45.0
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
POOL = 100
FUSION_K, KEYWORD_WEIGHT, VECTOR_WEIGHT = 60, 2.0, 1.0
EVIDENCE_CHARS, EVIDENCE_SECTIONS, SECTION_CHARS, SNIPPET_CHARS = 2500, 6, 6000, 1200
CHARS_PER_TOKEN = 0.85
