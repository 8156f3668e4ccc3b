"""The normalisers in DuckDB's dialect, from the same character tables."""

from __future__ import annotations

from ..functions import lexicon, text

WS = "(' ' || chr(9) || chr(13) || chr(10))"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def strip(e: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(trim(regexp_replace({e}, '^[#*]+', ''), {WS}), '^\*+', ''), '\*+$', ''), {WS})"


def normalize(e: str) -> str:
    e = f"translate({strip(e)}, {quoted(text.SINGLE_FROM)}, {quoted(text.SINGLE_TO)})"
    for c, a in text.SEVERAL.items():
        e = f"replace({e}, {quoted(c)}, {quoted(a)})"
    return rf"regexp_replace(trim(regexp_replace(regexp_replace({e}, '[^a-z0-9'' ]', '', 'g'), ' +', ' ', 'g')), '^'' ', '')"


def score_normalize(e: str) -> str:
    single = {k: v for k, v in text.SCORE_CYRILLIC.items() if len(v) == 1}
    e = f"translate({e}, {quoted(''.join(single) + ''.join(single).upper())}, {quoted(''.join(single.values()) * 2)})"
    for c, a in text.SCORE_CYRILLIC.items():
        if len(a) != 1:
            e = f"replace(replace({e}, {quoted(c)}, {quoted(a)}), {quoted(c.upper())}, {quoted(a)})"
    return f"trim(regexp_replace(lower(translate({e}, {quoted(text.ACCENTED)}, {quoted(text.PLAIN)})), '[^a-z0-9]+', ' ', 'g'))"


def repetition_key(e: str) -> str:
    return f"regexp_replace(translate({e}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]', '', 'g')"


def narration(e: str, phrases=lexicon.NARRATION) -> str:
    return f"len(list_filter({listed(phrases)}, lambda p: contains(' ' || {e} || ' ', ' ' || p || ' '))) > 0"


def format_lrc(ms: str) -> str:
    t = f"CAST(trunc({ms}) AS BIGINT)"
    return f"printf('%02d:%02d.%02d', {t} // 60000, {t} % 60000 // 1000, {t} % 1000 // 10)"
