"""Comparison forms of vocalised Arabic text, and what its signs say about stopping, as column expressions.

Every function takes and gives columns of one word or one line; null gives null. All stay in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and signs of the script, as code points.
LETTER = r"\u0621-\u064A"
MARKS = r"\u064B-\u0655\u0670\u06D6-\u06ED\u0640"
DETECTOR_MARKS = r"\u064B-\u0670\u06D6-\u06ED\u0640"
SOUND_MARKS = r"\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED\u0640"
ANNOTATIONS = r"\u06D6-\u06ED"
ALEFS = "آأإٱ"
WEAK_ENDING = "[اويه]+$"
STOPPING_SIGNS = r"\u0610-\u061A\u06D6-\u06DC"
NEVER, ALWAYS, PAIRED, ALLOWED = r"[\u06D9\u06DC]", r"\u06D8", r"\u06DB", r"[\u06D6\u06D7\u06DA\u06DB]"
MAY_STOP, MUST_NOT = r"[\u06D6\u06D7\u06D8\u06DA\u06DB]\s*$", r"\u06D9\s*$"
DOUBLED_OPENING = r"^\u0671(?:\u0644)?[\u0621-\u064A][^\u0621-\u064A]*\u0651"
SHORT_VOWELS, TANWEEN = r"[\u064E\u064F\u0650]", r"[\u064B\u064C\u064D]"
HELD_AFTER_NOON, HELD_AFTER_MEEM = "[يومنبتثجدذزسشصضطظفقك]", "[مب]"
LONG_TAIL, MADDAH, HAMZA_HEAD = "[اآويى]", r"\u0653", "[ءآأإاى]"
DROPPED_AT_STOP = r"[\u064C\u064D\u064E\u064F\u0650]$"
RIGHT_TO_LEFT = r"\u0590-\u05FF\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB1D-\uFDFF\uFE70-\uFEFF"
CANNOT_END = "الذي التي الذين اللذان اللذين اللتان اللتين اللاتي اللائي اللواتي ان لكن لعل ليت لو لولا كي في من عن الي حتي مع لدي".split()
CALL = "يا"


def _without(text: Column, signs: str) -> Column:
    return F.regexp_replace(text, f"[{signs}]", "")


def _unless_empty(changed: Column, before: Column) -> Column:
    """The changed text, or the one before where nothing would be left."""
    return F.when(changed == "", before).otherwise(changed)


def _weak_ending_dropped(text: Column) -> Column:
    return _unless_empty(F.regexp_replace(text, WEAK_ENDING, ""), text)


def loose_form(text: Column) -> Column:
    """Without marks, letter variants as one, other scripts as spaces, blanks squeezed and trimmed."""
    folded = F.translate(_without(text, MARKS), "إأ\u0671آىؤئة", "اااايويه")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\u0600-\u06FF\s]", " "), r"\s+", " "))


def vocabulary_form(word: Column) -> Column:
    """Bare consonants: marks gone, alef variants as alef, alef maqsura as ya, letters only."""
    return F.regexp_replace(F.translate(_without(word, MARKS), ALEFS + "ى", "ااااي"), f"[^{LETTER}]", "")


def vocalised_form(word: Column) -> Column:
    """Vowels stay; annotation, tatweel, small alef and maddah go, a raised hamza joins the alef after it."""
    plain = _without(F.translate(word, "\u0671", "ا"), ANNOTATIONS + r"\u0640\u0670\u0653")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\u0654ا", "آ"), r"\u0654", ""), r"\s+", "")


def _consonants(base: Column) -> Column:
    """Hamza seats resolved, hamza and alef dropped unless nothing else is there, weak ending dropped."""
    seated = F.translate(base, "ؤئء", "وي")
    return _weak_ending_dropped(_unless_empty(F.translate(seated, "ا", ""), seated))


def detector_skeleton(word: Column) -> Column:
    """The form by which decoded text is found in the corpus."""
    marked = F.regexp_replace(word, r"\u06E7", "ي")
    folded = F.translate(_without(marked, DETECTOR_MARKS), ALEFS + "ىة", "اااايه")
    return _consonants(F.regexp_replace(folded, f"[^{LETTER}]", ""))


def aligner_skeleton(word: Column) -> Column:
    """As detector_skeleton, but alef maqsura under a small alef counts as alef."""
    long = F.regexp_replace(word, r"ى[\u064B-\u065F]*\u0670", "ا")
    return _consonants(F.translate(vocabulary_form(F.regexp_replace(long, r"\u06E7", "ي")), "ة", "ه"))


def evaluator_skeleton(word: Column) -> Column:
    """The vocabulary form without the difference of ta marbuta and without a weak ending."""
    return _weak_ending_dropped(F.translate(vocabulary_form(word), "ة", "ه"))


def sound_skeleton(composed: Column) -> Column:
    """Of NFC text: letters as sounds, lengthened sounds once, long vowels dropped."""
    letters = F.translate(_without(composed, SOUND_MARKS + " "), "أإآ\u0671ىةؤئء", "اااااهوي")
    return F.regexp_replace(F.regexp_replace(letters, r"(.)\1+", "$1"), "[اوي]", "")


def split_words(line: Column) -> Column:
    """Words of a line; signs that stand alone join the word before, or the first word where none is before."""
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit("").alias("leading"))

    def add(state: Column, token: Column) -> Column:
        words, leading = state["words"], state["leading"]
        spoken = token.rlike(f"[{LETTER}]")
        glued = F.concat(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(words, -1), token)))
        held = F.when(leading == "", token).otherwise(F.concat_ws(" ", leading, token))
        return (
            F.when(spoken, F.struct(F.concat(words, F.array(held)).alias("words"), F.lit("").alias("leading")))
            .when(F.size(words) > 0, F.struct(glued.alias("words"), leading.alias("leading")))
            .otherwise(F.struct(words.alias("words"), held.alias("leading")))
        )

    return F.aggregate(tokens, start, add, lambda s: F.when(s["leading"] == "", s["words"]).otherwise(F.concat(s["words"], F.array(s["leading"]))))


def calls_joined(tokens: Column) -> Column:
    """A vocative particle that stands alone is joined to the word it calls."""
    empty = F.array().cast("array<string>")

    def add(words: Column, token: Column) -> Column:
        last = F.element_at(words, -1)
        joins = (F.size(words) > 0) & (vocabulary_form(last) == CALL)
        return F.when(joins, F.concat(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.concat(last, token)))).otherwise(F.concat(words, F.array(token)))

    return F.aggregate(tokens, empty, add)


def carries_position(line: Column, tokens: int = 2, letters: int = 4) -> Column:
    """Whether a line holds enough to say where it stands: so many words with a skeleton, of so many letters together."""
    forms = F.filter(F.transform(F.split(line, r"\s+"), aligner_skeleton), lambda t: t != "")
    return (F.size(forms) >= tokens) & (F.length(F.array_join(forms, "")) >= letters)


def stop_licence(word: Column) -> Column:
    """never, always, paired, allowed or none: what the signs of a word say about stopping after it."""
    rules = [(NEVER, "never"), (ALWAYS, "always"), (PAIRED, "paired"), (ALLOWED, "allowed")]
    return reduce(lambda chain, rule: chain.when(word.rlike(rule[0]), rule[1]), rules, F.when(word.isNull(), None)).otherwise("none")


def stop_allowed(word: Column) -> Column:
    return F.trim(F.coalesce(word, F.lit(""))).rlike(MAY_STOP)


def held_nasal(first: Column, second: Column) -> Column:
    """Whether a nasal is held from the first word into the second."""
    last = F.regexp_extract(first, rf"([{LETTER}])[^{LETTER}]*$", 1)
    voweled = F.regexp_extract(first, rf"[{LETTER}]([^{LETTER}]*)$", 1).rlike(SHORT_VOWELS)
    head = F.regexp_extract(second, f"[{LETTER}]", 0)
    return (
        F.when((last == "") | (head == ""), False)
        .when(first.rlike(TANWEEN) | ((last == "ن") & ~voweled), head.rlike(HELD_AFTER_NOON))
        .when((last == "م") & ~voweled, head.rlike(HELD_AFTER_MEEM))
        .otherwise(False)
    )


def held_vowel(first: Column, second: Column) -> Column:
    """Whether a long vowel is held from the first word into the second."""
    last, head = F.regexp_extract(first, rf"([{LETTER}])[^{LETTER}]*$", 1), F.regexp_extract(second, f"[{LETTER}]", 0)
    return (last != "") & (head != "") & last.rlike(LONG_TAIL) & (head.rlike(HAMZA_HEAD) | first.rlike(MADDAH))


def breath_allowed(before: Column, after: Column) -> Column:
    """Whether a reader may have taken breath between two words that bear no stopping sign."""
    return ~(F.trim(before).rlike(MUST_NOT) | F.trim(after).rlike(DOUBLED_OPENING) | held_nasal(before, after))


def cannot_end_phrase(word: Column) -> Column:
    """Whether the word waits for what follows it."""
    return vocabulary_form(word).isin(CANNOT_END)


def drops_final_vowel(word: Column) -> Column:
    """Whether the word ends in a vowel that is not said when stopping."""
    return F.regexp_replace(word, r"[\u06D6-\u06DC\s]", "").rlike(DROPPED_AT_STOP)


def mostly_right_to_left(text: Column) -> Column:
    """Whether over half of the letters are of a script written right to left."""
    right = F.length(F.regexp_replace(text, f"[^{RIGHT_TO_LEFT}]", ""))
    return (right > 0) & (2 * right > F.length(F.regexp_replace(text, r"\P{L}", "")))


def bare_line(line: Column) -> Column:
    """The line without the stopping signs at the ends of its words."""
    return F.regexp_replace(line, rf"[{STOPPING_SIGNS}]+(?=\s|$)", "")


def detached_signs(line: Column) -> Column:
    """The stopping signs at the ends of words, each with the bare text before it."""
    signs = F.regexp_extract_all(line, F.lit(rf"([{STOPPING_SIGNS}]+)(?=\s|$)"), 1)
    pieces = F.split(line, rf"[{STOPPING_SIGNS}]+(?=\s|$)")
    return F.transform(signs, lambda sign, i: F.struct(sign.alias("sign"), F.array_join(F.slice(pieces, 1, i + 1), "").alias("before")))


def plain_text(html: Column) -> Column:
    """Without raised notes and tags (open ones included); quotes decoded, blanks before punctuation and doubled ones dropped."""
    out = F.regexp_replace(html, r"(?is)<sup\b[^>]*>.*?</sup>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>?", ""), "&quot;", '"')
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([,.;:!?])", "$1"), r"\s{2,}", " "))
