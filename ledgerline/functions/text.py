"""Text Column functions: cleaning, tokens, regex extraction, skills.

Regexes use explicit character classes (``[\\p{L}\\p{N}_]`` for a word
character) so Java's engine and RE2 read them identically.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words removed by the tokenizer.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Words whose presence marks a text as English.
ENGLISH_MARKERS = ["the", "a", "an", "in", "on", "at", "of", "for", "with"]

# Fear words (0.3 each, capped at 1).
FEAR_WORDS = ["afraid", "scared", "terrified", "frightened", "fear", "worried", "anxious"]

# Skill library for job descriptions.
COMMON_SKILLS = [
    "Python", "Java", "JavaScript", "C++", "C#", "TypeScript",
    "React", "Angular", "Vue.js", "Node.js", "Django", "Flask",
    "SQL", "PostgreSQL", "MySQL", "MongoDB", "AWS", "Azure",
    "Docker", "Kubernetes", "Git", "Agile", "Scrum", "DevOps",
    "Machine Learning", "Data Science", "AI", "Deep Learning",
    "TensorFlow", "PyTorch", "NLP", "Computer Vision",
    "REST API", "GraphQL", "CI/CD", "Linux", "Windows", "MacOS",
    "HTML", "CSS", "SASS", "LESS", "Redux", "RxJS", "Spring Boot",
    ".NET", "ASP.NET", "PHP", "Laravel", "Ruby", "Ruby on Rails",
]

# Skill categories (anything else is "other").
SKILL_CATEGORIES = {
    "programming_languages": ["Python", "Java", "JavaScript", "C++", "C#", "TypeScript", "Ruby", "PHP"],
    "frameworks": ["React", "Angular", "Vue.js", "Django", "Flask", "Spring Boot", ".NET", "Laravel"],
    "databases": ["SQL", "PostgreSQL", "MySQL", "MongoDB"],
    "cloud": ["AWS", "Azure", "Google Cloud"],
    "tools": ["Docker", "Kubernetes", "Git", "Jenkins"],
    "methodologies": ["Agile", "Scrum", "DevOps", "CI/CD"],
}

# Number words one..twenty for experience phrases.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
                "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
                "eighteen", "nineteen", "twenty"]

_NW = "|".join(NUMBER_WORDS)
# Experience patterns (numeric, then word numbers).
EXPERIENCE_NUMERIC = [
    r"(\d+[\.\d]*)\+?\s*years?\s+(?:of\s+)?experience",
    r"experience\s*(?:of|:)?\s*(\d+[\.\d]*)\+?\s*years?",
    r"worked\s*(?:for)?\s*(\d+[\.\d]*)\+?\s*years?",
    r"(\d+[\.\d]*)\+?\s*years?\s+in\s+(?:the\s+)?industry",
]
EXPERIENCE_WORDS = [
    r"(" + _NW + r")\+?\s*years?\s+(?:of\s+)?experience",
    r"experience\s*(?:of|:)?\s*(" + _NW + r")\+?\s*years?",
    r"worked\s*(?:for)?\s*(" + _NW + r")\+?\s*years?",
]
# Contact patterns (email, then two phone forms in order).
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERNS = [
    r"\b\+?[0-9]{1,3}[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    r"\b\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
]
# Degree / institution patterns.
EDUCATION_PATTERNS = [
    r"(?:(?:Bachelor|Master|PhD|Doctorate|BSc|MSc|BA|MA|MBA|MD|BBA|BEng|MEng|B\.A\.|M\.A\.|B\.S\.|M\.S\.|Ph\.D\.)\s+(?:of|in|on)?\s+[A-Za-z\s]+)",
    r"(?:University|College|Institute|School)\s+of\s+[A-Za-z\s]+",
]

WORD = r"[\p{L}\p{N}_]"
WS = r"[ \t\n\x0B\f\r]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(col) -> Column:
    """Collapse whitespace runs to one space, drop characters other than
    word characters, whitespace, @ and the range ',-:' (, - . / digits :)
    plus ';', trim."""
    t = F.regexp_replace(_c(col), WS + "+", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_ \t\n\x0B\f\r@,-:;]", "")
    return F.trim(t)


def words(col) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(_c(col), F.lit(WORD + "+"), 0)


def tokens(col) -> Column:
    """Lower-case alphabetic tokens without stop words."""
    toks = F.regexp_extract_all(F.lower(_c(col)), F.lit(r"\p{L}+"), 0)
    return F.filter(toks, lambda t: ~t.isin(*STOP_WORDS))      # InSet: hashed lookup


def detect_language(col) -> Column:
    w = F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD + "+"), 0)
    marks = F.array(*[F.lit(x) for x in ENGLISH_MARKERS])
    return F.when(F.size(w) == 0, "unknown").when(F.arrays_overlap(w, marks), "en").otherwise("unknown")


def skill_regex(skill: str) -> str:
    """Whole-phrase, case-insensitive match with boundaries that also work
    for skills ending in '+', '#' or starting with '.'."""
    return r"(?i)(^|[^\p{L}\p{N}_])" + re.escape(skill).replace(r"\ ", " ") + r"([^\p{L}\p{N}_]|$)"


def extract_skills(col, skills=COMMON_SKILLS) -> Column:
    """Skills found in the text, in library order.  One literal regex per
    skill (compiled once per task), evaluated over the whole text."""
    t = _c(col)
    low = F.lower(t)
    # the substring test is a necessary condition for the regex and far
    # cheaper, so most (text, skill) pairs never reach the regex engine
    return F.array_compact(F.array(*[F.when(low.contains(s.lower()) & t.rlike(skill_regex(s)), F.lit(s))
                                     for s in skills]))


def skill_category(skill_col) -> Column:
    out = F.lit("other")
    for cat, names in reversed(list(SKILL_CATEGORIES.items())):
        out = F.when(_c(skill_col).isin(*names), F.lit(cat)).otherwise(out)
    return out


def experience_years(col) -> Column:
    """Largest number of years stated by any experience pattern; null if none."""
    t = _c(col)
    nums = [F.transform(F.regexp_extract_all(t, F.lit("(?i)" + p), 1), lambda x: x.try_cast("double"))
            for p in EXPERIENCE_NUMERIC]
    wmap = F.create_map(*[v for i, w in enumerate(NUMBER_WORDS) for v in (F.lit(w), F.lit(float(i + 1)))])
    wrds = [F.transform(F.regexp_extract_all(t, F.lit("(?i)" + p), 1), lambda x: wmap[F.lower(x)])
            for p in EXPERIENCE_WORDS]
    allv = F.filter(F.flatten(F.array(*nums, *wrds)), lambda x: x.isNotNull())
    # every pattern needs the word "year": skip the regexes otherwise
    return F.when(F.lower(t).contains("year") & (F.size(allv) > 0), F.array_max(allv))


def first_match(col, pattern: str) -> Column:
    m = F.regexp_extract(_c(col), pattern, 0)
    return F.when(m != "", m)


def email(col) -> Column:
    return first_match(col, EMAIL_PATTERN)


def phone(col) -> Column:
    return F.coalesce(*[first_match(col, p) for p in PHONE_PATTERNS])


def education(col) -> Column:
    t = _c(col)
    return F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), 0) for p in EDUCATION_PATTERNS]))


def emotions(text, polarity, subjectivity) -> dict[str, Column]:
    """joy / sadness / anger from polarity and subjectivity; surprise from
    '!' (0.2 each) overwritten by '?' (0.1 each) when present; fear 0.3 per
    fear word present, all capped at 1."""
    t, p, s = _c(text), _c(polarity), _c(subjectivity)
    low = F.lower(t)
    excl = F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))
    ques = F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))
    fear = sum((F.when(low.contains(w) & low.rlike(r"(^|[^\p{L}\p{N}_])" + w + r"([^\p{L}\p{N}_]|$)"), 0.3).otherwise(0.0)
                for w in FEAR_WORDS), F.lit(0.0))
    return {
        "joy": F.when(p > 0.3, F.least(F.lit(1.0), p * 1.5)).otherwise(0.0),
        "sadness": F.when((p <= 0.3) & (p < -0.3), F.least(F.lit(1.0), F.abs(p) * 1.2)).otherwise(0.0),
        "anger": F.when((p <= 0.3) & (p < -0.3), F.least(F.lit(1.0), F.abs(p) * s)).otherwise(0.0),
        "surprise": F.when(ques > 0, F.least(F.lit(1.0), ques * 0.1))
                     .when(excl > 0, F.least(F.lit(1.0), excl * 0.2)).otherwise(0.0),
        "fear": F.least(F.lit(1.0), fear),
    }
