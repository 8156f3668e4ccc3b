"""Text functions on columns: two normalisers that must not be mixed, similarity, words, and time tags.

Everything is an expression of built-in functions, so it stays in generated code and is pushed into scans' projections.
"""

from __future__ import annotations

import string
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What the alignment normaliser makes of single characters.
TO_SPACE = "-_/\\—–‐‑“”„‟     、。，！？·•…"
TO_APOSTROPHE = "‘’‛´"
LATIN_OTHERS = {"Æ": "ae", "Ð": "d", "Ø": "o", "Þ": "th", "ß": "ss", "Đ": "d", "Ħ": "h", "ı": "i", "Ł": "l", "Ŋ": "n", "Œ": "oe", "Ŧ": "t"}
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщыэѐѕіїјћќўџ", "abvgdeezzijklmnoprstufhccssyeeziijccud", strict=True)) | {"ю": "yu", "я": "ya", "ђ": "dj", "љ": "lj", "њ": "nj"}
GREEK = dict(zip("αβγδεζηικλμνξοπρςστυφω", "abgdeziiklmnxoprsstyfo", strict=True)) | {"θ": "th", "χ": "ch", "ψ": "ps"}
HANGUL_FIRST = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "c", "k", "t", "p", "h"]
HANGUL_MIDDLE = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
HANGUL_LAST = ["", "k", "k", "gs", "n", "nj", "nh", "t", "l", "lk", "lm", "lb", "ls", "lt", "lp", "lh", "m", "p", "ps", "t", "t", "ng", "t", "t", "k", "t", "p", "h"]
HANGUL_SINGLE = dict(zip("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅈㅉㅊㅋㅌㅍㅎ", ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "j", "jj", "c", "k", "t", "p", "h"], strict=True))
#: The scoring normaliser's Russian letters; it knows no Serbian ones.
SCORE_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхцыэ", "abvgdezijklmnoprstufhcye", strict=True)) | {"ё": "yo", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}


def _latin() -> dict[str, str]:
    """Letters of Latin-1 and Latin Extended-A: the ASCII letters of their compatibility decomposition, or an exception."""
    out = {}
    for c in map(chr, range(0xC0, 0x180)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if x in string.ascii_letters).lower()
        out[c] = LATIN_OTHERS.get(c) or LATIN_OTHERS.get(c.upper() if len(c.upper()) == 1 else c) or base
    return {c: a for c, a in out.items() if a}


def transliteration() -> dict[str, str]:
    upper = {c.upper(): a for c, a in CYRILLIC.items()}
    return _latin() | CYRILLIC | upper | GREEK | HANGUL_SINGLE | dict(zip(map(chr, range(0x314F, 0x3164)), HANGUL_MIDDLE, strict=True)) | dict(zip(map(chr, range(0x1100, 0x1113)), HANGUL_FIRST, strict=True)) | dict(zip(map(chr, range(0x1161, 0x1176)), HANGUL_MIDDLE, strict=True))


_ALL = transliteration()
SINGLE_FROM = string.ascii_uppercase + TO_SPACE + TO_APOSTROPHE + "".join(c for c, a in _ALL.items() if len(a) == 1)
SINGLE_TO = string.ascii_lowercase + " " * len(TO_SPACE) + "'" * len(TO_APOSTROPHE) + "".join(a for a in _ALL.values() if len(a) == 1)
SEVERAL = {c: a for c, a in _ALL.items() if len(a) > 1}
#: What a text holds if the slower parts of the normaliser have work to do.
NEEDS_SEVERAL = "[" + "".join(SEVERAL) + "]"
NEEDS_HANGUL = "[가-힣]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def trim_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def strip_markdown(c: Column) -> Column:
    c = trim_blank(F.regexp_replace(c, r"^[#*]+", ""))
    return trim_blank(F.regexp_replace(F.regexp_replace(c, r"^\*+", ""), r"\*+\z", ""))


def _hangul(c: Column) -> Column:
    def one(x: Column) -> Column:
        s = F.ascii(x) - 0xAC00
        pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
        return F.when((s >= 0) & (s <= 0xD7A3 - 0xAC00), F.concat(pick(HANGUL_FIRST, F.floor(s / 588)), pick(HANGUL_MIDDLE, F.floor(s % 588 / 28)), pick(HANGUL_LAST, s % 28))).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def normalize(c: Column) -> Column:
    """The alignment normaliser: lower-case ASCII words, apostrophes kept, other scripts transliterated or dropped."""
    c = F.translate(strip_markdown(c), SINGLE_FROM, SINGLE_TO)
    c = F.when(c.rlike(NEEDS_SEVERAL), reduce(lambda s, ca: F.replace(s, F.lit(ca[0]), F.lit(ca[1])), SEVERAL.items(), c)).otherwise(c)
    c = F.when(c.rlike(NEEDS_HANGUL), _hangul(c)).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9' ]", ""), " +", " ")
    return F.regexp_replace(F.trim(c), "^' ", "")


def _score_folded(c: Column) -> Column:
    """Russian letters by sound, accents folded, in lower case."""
    single = {k: v for k, v in SCORE_CYRILLIC.items() if len(v) == 1}
    both = "".join(single) + "".join(single).upper()
    several = {k: v for k, v in SCORE_CYRILLIC.items() if len(v) != 1}
    several |= {k.upper(): v for k, v in several.items()}

    def folded(c: Column) -> Column:
        c = F.translate(c, both, "".join(single.values()) * 2)
        # an element of an array, so that it is computed once
        c = F.transform(F.array(c), lambda x: F.when(x.rlike("[" + "".join(several) + "]"), reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), several.items(), x)).otherwise(x))[0]
        return F.translate(c, ACCENTED, PLAIN)

    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), folded(c)).otherwise(c))


def score_normalize(c: Column) -> Column:
    """The scoring normaliser: Russian letters by sound, accents folded, every other run of characters a space."""
    return F.trim(F.regexp_replace(_score_folded(c), "[^a-z0-9]+", " "))


def score_word_list(c: Column) -> Column:
    """The words of `score_normalize`."""
    return F.filter(F.split(_score_folded(c), "[^a-z0-9]+"), lambda x: x != "")


def _accents() -> tuple[str, str]:
    """Characters of one base letter and accents; those of a longer decomposition are left to `score_normalize_exact`."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)))]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and d != c and d.isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _accents()


@F.pandas_udf(StringType())
def score_normalize_exact(texts: pd.Series) -> pd.Series:
    """`score_normalize` with the whole compatibility decomposition, for texts beyond the Latin blocks."""
    import re

    def one(t: str) -> str:
        t = unicodedata.normalize("NFKD", "".join(SCORE_CYRILLIC.get(x.lower(), x) for x in t or ""))
        return re.sub("[^a-z0-9]+", " ", "".join(x for x in t if not unicodedata.combining(x)).lower()).strip()

    return texts.map(one)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def space_words(c: Column) -> Column:
    return F.filter(F.split(c, " +"), lambda x: x != "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of normalised texts; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def repetition_key(c: Column) -> Column:
    return F.regexp_replace(ascii_lower(c), "[^a-z0-9]", "")


def is_special_token(c: Column) -> Column:
    return F.startswith(c, F.lit("[_"))


def is_word_boundary(c: Column) -> Column:
    return F.startswith(c, F.lit(" "))


def clean_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim_blank(c), "[\n\r\t]", " "), " +", " ")


def weight(c: Column) -> Column:
    """Bytes that are not spaces."""
    return F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def ends_sentence(c: Column) -> Column:
    return F.rtrim(c).rlike(r"[.!?…]\z")


def ends_clause(c: Column) -> Column:
    return F.rtrim(c).rlike(r"[.!?…;:]\z")


def starts_lower(c: Column) -> Column:
    return F.ltrim(c).rlike(r"^\p{Ll}")


def score_words(c: Column) -> Column:
    return F.size(space_words(score_normalize(c)))


def contains_words(hay: Column, needle: Column) -> Column:
    """Whether the words of a normalised text occur, side by side, in another."""
    return F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def format_lrc(ms: Column) -> Column:
    """mm:ss.xx, hundredths cut, minutes not wrapped."""
    t = ms.cast("long")
    return F.format_string("%02d:%02d.%02d", F.floor(t / 60000), F.floor(t % 60000 / 1000), F.floor(t % 1000 / 10))


LRC_TAG = r"^\[(\d+):(\d+(?:\.\d+)?)\]\s*(.*)\z"


def lrc_seconds(line: Column) -> Column:
    """The time of a line's first tag, null without one."""
    part = lambda k: F.regexp_extract(line, LRC_TAG, k)
    return F.when(line.rlike(LRC_TAG), part(1).try_cast("double") * 60 + part(2).try_cast("double"))


def lrc_text(line: Column) -> Column:
    return F.when(line.rlike(LRC_TAG), F.regexp_extract(line, LRC_TAG, 3))


def parse_time_ms(c: Column) -> Column:
    """HH:MM:SS,mmm or .mmm as milliseconds, else 0."""
    pattern = r"^(\d+):(\d+):(\d+)[,.](\d+)"
    part = lambda k: F.regexp_extract(c, pattern, k).try_cast("double")
    return F.when(c.rlike(pattern), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)).otherwise(F.lit(0.0))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.json\z", "")


def language_pair(spec: Column) -> tuple[Column, Column]:
    """The parts before and after the first plus; the second null without one."""
    parts = F.split(spec, r"\+", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))
