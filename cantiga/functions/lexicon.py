"""Word and phrase lists, and what they say about words, segments and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, contains_words, normalize

# Fixed values, all as the alignment normaliser leaves them.
MARKERS = (
    "music", "applause", "laughing", "laughter", "applauding", "singing", "muzika", "muziku", "muzicki", "aplauz", "smijeh", "smijanje",
    "pjevanje", "pjeva", "ples", "subtitrating", "subtitrujuce", "subtitluje",
)
NARRATION = (
    "hvala sto pratite kanal", "hvala na svidanju", "hvala sto poslusate", "hvala na poslusanju", "hvala na pratnji", "hvala vam na pazi",
    "hvala sto gledate", "hvala sto dijelite", "molim vas da pretplatite", "pretplatite se na kanal", "thanks for watching",
    "thanks for listening", "thanks for watching this", "see you next time", "don't forget to", "for more videos", "all rights reserved",
    "credits titles", "subscribe to my", "kliknite na dugme", "pritisnite dugme", "ukljucite zvuk", "stavite na tacne", "pogledajte opis",
    "u opisu videa", "nastavak slijedi", "kraj emisije",
)
INTERJECTIONS = (
    "ha", "haha", "hahaha", "ah", "ahh", "eh", "hm", "hmm", "hmmm", "la", "lalala", "nana", "na", "nanana", "da", "dada", "ta", "tata",
    "oh", "ooh", "ooh ooh", "woo", "woohoo", "hey", "he", "heh", "ho", "mmm", "mm", "mhm", "huh", "yay", "yeah", "yay yeah",
)
PLACEHOLDERS = ("humming", "music", "muzika", "applause", "laughing", "smiling")
HUMMING = "[humming]"


def is_marker(norm: Column) -> Column:
    return norm.isin(*MARKERS)


def is_interjection(norm: Column) -> Column:
    return norm.isin(*INTERJECTIONS)


def is_placeholder(score_norm: Column) -> Column:
    return score_norm.isin(*PLACEHOLDERS)


def is_narration(norm: Column, phrases: tuple[str, ...] = NARRATION) -> Column:
    """Whether a phrase occurs as whole words in a normalised text."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: contains_words(norm, p))


def has_no_words(text_norm: Column, word_norms: Column) -> Column:
    """Narration, or nothing but markers and interjections; true without words."""
    return is_narration(text_norm) | F.forall(word_norms, lambda w: is_marker(w) | is_interjection(w))


def is_non_lyric(text_norm: Column, word_norms: Column) -> Column:
    """Narration, or nothing but markers; true without words."""
    return is_narration(text_norm) | F.forall(word_norms, is_marker)


def chorus_label(line: Column) -> Column:
    """The label of a chorus marker line, null for any other line."""
    low = ascii_lower(line)
    return (
        F.when(low.isin("ref.", "ref", "ref:"), "Ref.")
        .when(F.startswith(low, F.lit("[chorus")) | low.isin("[ref]", "[ref."), line)
        .when(F.contains(low, F.lit("refren")) | F.contains(low, F.lit("refrain")), "Ref.")
    )


def normalized_words(words: Column) -> Column:
    return F.transform(words, normalize)
