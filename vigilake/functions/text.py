"""Text helpers as column expressions: contacts, keywords, names, languages, escaping, cutting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and word lists that decide what counts as a contact, an advert or a language.
URL = (
    r"(?iu)(?:https?://|www\.)\S+|\b[a-z0-9][a-z0-9-]{0,61}\.(?:com|net|org|xyz|top|club|site|online|ru|ir|info|link|live|me|cc|io|app|"
    r"shop|store|fun|vip|bio|page|space|website|pro|tv)\b(?:/\S*)?"
)
MENTION = r"@[A-Za-z][A-Za-z0-9_]{4,31}"
INVITE = r"(?i)(?:t\.me|telegram\.me|telegram\.dog|tg://)\S*"
KEYWORDS = [
    r"(?i)\bp[o0]rn(?:o|hub|star)?\b",
    r"(?i)\bx+x+x+\b",
    r"(?i)\bnudes?\b",
    r"(?i)\bsex[- ]?(?:chat|cam|shop|video|tape)\b",
    r"(?i)\bonly[- ]?fans\b",
    r"(?i)\bescort\b",
    r"(?i)\bcamgirl\b",
    r"(?i)\bhentai\b",
    r"(?i)\b18\+\s*(?:content|channel|group|videos?)\b",
    r"(?i)\badult\s*(?:content|channel|videos?)\b",
    r"سکس|سک+س|پورن|فیلم\s*سوپر|عکس\s*لخت|شماره\s*مجازی\s*سکس",
    r"سكس|إباحي|اباحي|أفلام\s*جنسية|جنس\s*ساخن",
    r"(?i)порн[оа]|секс[- ]?чат|интим\s*услуг|голы[ех]\s*фото",
]
#: A match of the pattern in the same place holds one of these in lower case, unless the text has a letter of ODD_CASE.
KEYWORD_ANCHORS = [
    ["porn", "p0rn"], ["xxx"], ["nude"], ["sex"], ["fans"], ["escort"], ["camgirl"], ["hentai"], ["18+"], ["adult"],
    ["سک", "پورن", "فیلم", "عکس", "شماره"], ["سكس", "باحي", "أفلام", "جنس"], ["порн", "секс", "интим", "голы"],
]
ODD_CASE = ["ſ", "K", "ı", "İ"]  # other letters whose capital or small one is ASCII
NAME_PATTERNS = {
    "invite link in name": r"(?i)(?:t\.me/|@[A-Za-z][A-Za-z0-9_]{4,})",
    "age marker in name": r"(?:\b18\s*\+|\+\s*18\b|🔞)",
    "call to action in name": r"(?i)(?:click|join|watch|subscribe|بزن|ببین|عکسمو|اضغط|شاهد|смотри|жми)\b",
    "pointer emoji in name": r"[👇👆👉👈⬆⬇]",
}
PERSIAN_WORDS = ["گروه", "کانال", "چت", "گپ", "ایران", "فارسی", "خبر", "بحث", "نظرات", "دیدگاه", "تبادل", "دوستان", "برنامه", "آموزش"]
ARABIC_WORDS = ["قناة", "مجموعة", "دردشة", "العربية", "أخبار", "تعليقات", "نقاش", "الأصدقاء", "مصر", "السعودية", "العراق"]
LATIN, CYRILLIC = r"[a-zA-Z]", r"[Ѐ-ԯ]"
ARABIC_SCRIPT = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
PERSIAN_LETTERS, ARABIC_LETTERS = r"[پچژگکی۰-۹]", r"[ةيكىإأؤئ٠-٩]"
LANGUAGES = {"fa": "fa", "pes": "fa", "prs": "fa", "tg": "fa", "ru": "ru", "ar": "ar"}
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
CLIP = 600


def _unicode(pattern: str) -> str:
    """Java needs to be told that case and word ends are those of Unicode."""
    return pattern.replace("(?i)", "(?iuU)") if pattern.startswith("(?i)") else f"(?U){pattern}"


def trim_space(c: Column) -> Column:
    """Trim all Unicode white space (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def escape_html(c: Column) -> Column:
    """F01."""
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def strip_html(c: Column) -> Column:
    """tags dropped (an open one takes the rest), a stray > dropped, five entities decoded, & first."""
    c = F.replace(F.regexp_replace(c, r"<[^>]*(?:>|$)", ""), F.lit(">"), F.lit(""))
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def truncate(c: Column, most: int) -> Column:
    """at most ``most`` characters, the last an ellipsis if cut."""
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def clip(c: Column, most: int = CLIP) -> Column:
    """the first ``most`` characters and an ellipsis if cut."""
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("…")))


def cache_key(c: Column) -> Column:
    """one blank between words, clipped, lower case."""
    return F.lower(clip(F.regexp_replace(trim_space(c), r"(?U)\s+", " ")))


def holds(c: Column, anchors: list[str]) -> Column:
    """Whether a text has one of the words: plain searches, far cheaper than a pattern."""
    out = F.contains(c, F.lit(anchors[0]))
    for a in anchors[1:]:
        out = out | F.contains(c, F.lit(a))
    return out


def _searched(c: Column, make) -> Column:
    """``make(text, its anchors' test)`` with the lower case and the odd letters looked up once."""
    c = F.coalesce(c, F.lit(""))
    seen = F.struct(c.alias("c"), F.lower(c).alias("low"), holds(c, ODD_CASE).alias("odd"))
    return F.transform(F.array(seen), lambda x: make(x["c"], lambda anchors: x["odd"] | holds(x["low"], anchors)))[0]


def contacts(c: Column) -> Column:
    """struct of invites, mentions and urls; urls that overlap an invite are left out."""
    c = F.coalesce(c, F.lit(""))
    invites = F.regexp_extract_all(c, F.lit(INVITE), F.lit(0))
    urls = F.filter(
        F.regexp_extract_all(c, F.lit(URL), F.lit(0)),
        lambda u: ~F.exists(invites, lambda t: F.contains(u, t) | F.contains(t, u)),
    )
    mentions = F.when(F.contains(c, F.lit("@")), F.regexp_extract_all(c, F.lit(MENTION), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.struct(invites.alias("invites"), mentions.alias("mentions"), urls.alias("urls"))


def has_contact(found: Column) -> Column:
    return (F.size(found["invites"]) + F.size(found["mentions"]) + F.size(found["urls"])) > 0


def contact_summary(found: Column, most: int) -> Column:
    """invites, mentions, urls; the first ``most``, each cut to 40 and escaped."""
    items = F.slice(F.concat(found["invites"], found["mentions"], found["urls"]), 1, most)
    return F.array_join(F.transform(items, lambda s: escape_html(truncate(s, 40))), ", ")


def keywords(c: Column) -> Column:
    """what the first three matching patterns match. A pattern is tried where its anchors are."""
    pairs = list(zip(KEYWORDS, KEYWORD_ANCHORS, strict=True))
    found = _searched(c, lambda t, there: F.array(*[F.when(there(a), F.regexp_extract(t, _unicode(p), 0)).otherwise("") for p, a in pairs]))
    return F.slice(F.filter(found, lambda s: s != ""), 1, 3)


def name_hits(c: Column) -> Column:
    """labels of the patterns that a display name shows."""
    labels = [F.when(F.coalesce(c, F.lit("")).rlike(_unicode(p)), F.lit(label)) for label, p in NAME_PATTERNS.items()]
    return F.filter(F.array(*labels), lambda s: s.isNotNull())


def script_counts(c: Column) -> Column:
    """AG17: letters by script and marks of Persian and Arabic; a listed word counts as three letters."""
    count = lambda p: F.regexp_count(c, F.lit(p))
    words = lambda ws: sum((F.contains(c, F.lit(w)).cast("int") * 3 for w in ws), F.lit(0))
    return F.struct(
        count(LATIN).alias("latin"),
        count(CYRILLIC).alias("cyrillic"),
        count(ARABIC_SCRIPT).alias("arabic_script"),
        (count(PERSIAN_LETTERS) + words(PERSIAN_WORDS)).alias("persian"),
        (count(ARABIC_LETTERS) + words(ARABIC_WORDS)).alias("arabic"),
    )


def detect_language(c: Column, fallback: str = "en") -> Column:
    """F16: by the script of most letters; Cyrillic before Arabic script before Latin on ties."""
    p = script_counts(F.coalesce(c, F.lit("")))
    most = F.greatest(p["latin"], p["cyrillic"], p["arabic_script"])
    return (
        F.when(most == 0, F.lit(fallback))
        .when(p["cyrillic"] == most, F.lit("ru"))
        .when(p["arabic_script"] == most, F.when(p["arabic"] > p["persian"], F.lit("ar")).otherwise(F.lit("fa")))
        .otherwise(F.lit("en"))
    )


def language_of_code(c: Column) -> Column:
    """the primary subtag of a client's language code."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.split(F.trim(c), "[-_]")[0])), F.lit("en"))


def duration(seconds: Column) -> Column:
    """days, hours and minutes without leading zeros."""
    s = F.greatest(seconds, F.lit(0))
    d, h, m = (x.cast("string") for x in (F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)))
    return (
        F.when(s >= 86400, F.concat(d, F.lit("d "), h, F.lit("h "), m, F.lit("m")))
        .when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m")))
        .otherwise(F.concat(m, F.lit("m")))
    )


def display_name(first: Column, last: Column) -> Column:
    """F10."""
    return F.concat_ws(" ", first, last)


def channel_label(username: Column, title: Column) -> Column:
    """F11."""
    return F.coalesce(F.concat(F.lit("@"), username), title, F.lit("private channel"))


def fill(template: Column, **values: Column) -> Column:
    """{name} by value, in the order given."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value)
    return template


def translate_key(own: Column, english: Column, key: Column) -> Column:
    """the language's template, else English, else the key in brackets."""
    return F.coalesce(own, english, F.concat(F.lit("⟦"), key, F.lit("⟧")))
