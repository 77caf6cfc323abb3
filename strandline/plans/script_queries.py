"""Queries of the script functions: lines written in the script's letters, from the benchmark table and by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import script
from strandline.functions.text import nfc
from strandline.runtime import ship_package, table

#: Latin letters of the tables stand for these letters and signs.
LATIN, LETTERS = "abcdefghijklmnopqrstuvwxyz", "ابٱدَفٓهِىكلمنوٰۖرّتُأؤءية"
#: Lines by hand: marks before, between and after words, calls, other scripts, markup, nothing at all.
LINES = [
    "۞ بِسْمِ ٱللَّهِ ٱلرَّحْمَـٰنِ ٱلرَّحِيمِ ۖ", "يَا أَيُّهَا ٱلَّذِينَ ءَامَنُوا۟ ۗ لَا ۙ مِن قَبْلِ", "هُدًى لِّلْمُتَّقِينَ ۛ فِيهِ ۛ رَيْبَ ۘ مَن",
    "وَمَأْوَىٰهُمْ جَهَنَّمُ", "مِنَ ٱلسَّمَآءِ إِلَىٰ أَجَلٍۢ مُّسَمًّى", "لَـَٔاخِرَةٌ رَحْمَةٌ شَىْءٍ ۜ", "مِمَّنِ ٱتَّبَعَ ٱلدِّينِ وَلَآ إِنَّكَ أَنْ", "بِكَلِمَـٰتٍ فَأَتَمَّهُنَّ لَكُم مِّنَ",
    "ۖ ۗ", "", "   ", "يا", "ا", "و", "English words, with ﷺ one sign", "السلام peace", "שלום עולם", "12 34", "النبۧن تآ شئ", "حتى الذين",
    'Praise<sup foot_note="3">1</sup> , all  of <i>it</i> &quot;here&quot; <b', "aؕ bۚ",
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line): the benchmark's texts in the script's letters, and the lines by hand under negative ids."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.translate(F.translate("text", LATIN.upper(), LATIN), LATIN, LETTERS).alias("line"))
    return texts.unionByName(spark.createDataFrame([(f"-{i}", t) for i, t in enumerate(LINES)], "id string, line string"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, place, word, next): the words of each line, with the word after."""
    each = lines(spark, sf_dir).select("id", F.posexplode(F.split("line", " ")).alias("place", "word"))
    return each.withColumn("next", F.lead("word").over(Window.partitionBy("id").orderBy("place")))


def _of_words(name: str, form: Callable[[Column], Column]) -> Callable:
    return lambda spark, sf_dir: words(spark, sf_dir).select("id", "place", form(F.col("word")).alias(name))


def _of_pairs(name: str, form: Callable[[Column, Column], Column]) -> Callable:
    return lambda spark, sf_dir: words(spark, sf_dir).where(F.col("next").isNotNull()).select("id", "place", form(F.col("word"), F.col("next")).alias(name))


def _of_lines(name: str, form: Callable[[Column], Column]) -> Callable:
    return lambda spark, sf_dir: lines(spark, sf_dir).select("id", form(F.col("line")).alias(name))


def sound_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return words(spark, sf_dir).select("id", "place", script.sound_skeleton(nfc("word")).alias("form"))


def verse_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each line as they are counted, one row each."""
    return lines(spark, sf_dir).select("id", F.posexplode(script.split_words(F.col("line"))).alias("place", "word"))


def called_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("id", F.posexplode(script.calls_joined(F.split("line", " "))).alias("place", "word"))


def detached_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).select("id", F.posexplode(script.detached_signs(F.col("line"))).alias("nth", "s"))
    return found.select("id", "nth", "s.sign", "s.before")


def compared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each skeleton of the aligner stands in how many spellings: what the forms are for."""
    formed = words(spark, sf_dir).select("word", script.aligner_skeleton(F.col("word")).alias("form")).where("form != ''")
    return formed.groupBy("form").agg(F.countDistinct("word").alias("spellings"), F.count("*").alias("n"))


QUERIES = {
    "loose_forms": _of_lines("form", script.loose_form),
    "vocabulary_forms": _of_words("form", script.vocabulary_form),
    "vocalised_forms": _of_words("form", script.vocalised_form),
    "detector_skeletons": _of_words("form", script.detector_skeleton),
    "aligner_skeletons": _of_words("form", script.aligner_skeleton),
    "evaluator_skeletons": _of_words("form", script.evaluator_skeleton),
    "sound_skeletons": sound_skeletons,
    "verse_words": verse_words,
    "called_words": called_words,
    "position_bearing": _of_lines("bears", script.carries_position),
    "stop_licences": _of_words("licence", script.stop_licence),
    "stops_allowed": _of_words("allowed", script.stop_allowed),
    "held_nasals": _of_pairs("held", script.held_nasal),
    "held_vowels": _of_pairs("held", script.held_vowel),
    "breaths_allowed": _of_pairs("allowed", script.breath_allowed),
    "hanging_words": _of_words("hangs", script.cannot_end_phrase),
    "dropped_vowels": _of_words("dropped", script.drops_final_vowel),
    "right_to_left": _of_lines("rtl", script.mostly_right_to_left),
    "bare_lines": _of_lines("bare", script.bare_line),
    "detached_signs": detached_signs,
    "plain_texts": _of_lines("plain", script.plain_text),
    "compared_words": compared_words,
}

# The SQL is written apart from the functions: signs as RE2 ranges, each rule on its own line.
_VALUES = ", ".join("('-{}', '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(LINES))
_L = f"l AS (SELECT CAST(item_id AS VARCHAR) AS id, translate(translate(text, '{LATIN.upper()}', '{LATIN}'), '{LATIN}', '{LETTERS}') AS line FROM benchmark UNION ALL SELECT * FROM (VALUES {_VALUES}) v(id, line))"
_W = _L + ", s AS (SELECT id, string_split(line, ' ') AS x FROM l), w AS (SELECT id, i - 1 AS place, x[i] AS word, x[i + 1] AS next FROM (SELECT id, x, unnest(range(1, len(x) + 1)) AS i FROM s))"
_MARKS = r"[\x{064B}-\x{0655}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
_ABC = r"[\x{0621}-\x{064A}]"


def _gone(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def _vocabulary(word: str) -> str:
    return _gone(_gone(_gone(_gone(word, _MARKS), "[آأإٱ]", "ا"), "ى", "ي"), r"[^\x{0621}-\x{064A}]")


def _kept(changed: str, before: str) -> str:
    return f"coalesce(nullif({changed}, ''), {before})"


def _skeleton(letters: str) -> str:
    seated = _gone(_gone(_gone(letters, "ؤ", "و"), "ئ", "ي"), "ء")
    rest = _kept(_gone(seated, "ا"), seated)
    return _kept(_gone(rest, "[اويه]+$"), rest)


_SMALL_YA = "replace(word, chr(1767), 'ي')"
_DETECTOR = _skeleton(_gone(_gone(_gone(_gone(_gone(_SMALL_YA, r"[\x{064B}-\x{0670}\x{06D6}-\x{06ED}\x{0640}]"), "[آأإٱ]", "ا"), "ى", "ي"), "ة", "ه"), r"[^\x{0621}-\x{064A}]"))


def _aligner(word: str) -> str:
    return _skeleton(_gone(_vocabulary(f"replace({_gone(word, 'ى[' + chr(92) + 'x{064B}-' + chr(92) + 'x{065F}]*' + chr(92) + 'x{0670}', 'ا')}, chr(1767), 'ي')"), "ة", "ه"))


_EVALUATOR = _gone(_vocabulary("word"), "ة", "ه")
_SOUND = _gone(_gone("nfc_normalize(word)", r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640} ]"), "[أإآٱى]", "ا")
_SOUND = _gone(_gone(_gone(_gone(_SOUND, "ة", "ه"), "ؤ", "و"), "ئ", "ي"), "ء")
# RE2 has no back references: equal neighbours are dropped from the list of characters
_SOUND = f"array_to_string(list_filter(string_split({_SOUND}, ''), lambda c, i: i = 1 OR c <> string_split({_SOUND}, '')[i - 1]), '')"
_LAST = r"regexp_extract(word, '([\x{0621}-\x{064A}])[^\x{0621}-\x{064A}]*$', 1)"
_TAIL = r"regexp_extract(word, '[\x{0621}-\x{064A}]([^\x{0621}-\x{064A}]*)$', 1)"
_HEAD = r"regexp_extract(next, '[\x{0621}-\x{064A}]')"
_NASAL = rf"""({_LAST} <> '' AND {_HEAD} <> '' AND CASE
  WHEN regexp_matches(word, '[\x{{064B}}-\x{{064D}}]') OR ({_LAST} = 'ن' AND NOT regexp_matches({_TAIL}, '[\x{{064E}}-\x{{0650}}]')) THEN contains('يومنبتثجدذزسشصضطظفقك', {_HEAD})
  WHEN {_LAST} = 'م' AND NOT regexp_matches({_TAIL}, '[\x{{064E}}-\x{{0650}}]') THEN contains('مب', {_HEAD}) ELSE false END)"""
_TOKENS = f"t AS (SELECT id, i - 1 AS n, x[i] AS token, regexp_matches(x[i], '{_ABC}') AS spoken FROM (SELECT id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT id, list_filter(regexp_split_to_array(line, '\\s+'), lambda z: z <> '') AS x FROM l)))"
_SIGNS = r"[\x{0610}-\x{061A}\x{06D6}-\x{06DC}]"
_CALLS = "c AS (SELECT id, place, word, coalesce(" + _vocabulary("word") + " = 'يا', false) AS calls FROM w)"

_VOCALISED = _gone("replace(word, chr(1649), chr(1575))", r"[\x{06D6}-\x{06ED}\x{0640}\x{0670}\x{0653}]")
_VOCALISED = f"replace(replace({_VOCALISED}, chr(1620) || chr(1575), chr(1570)), chr(1620), '')"

ORACLES = {
    "loose_forms": f"WITH {_L} SELECT id, trim({_gone(_gone(_gone(_gone(_gone(_gone(_gone(_gone('line', _MARKS), '[إأٱآ]', 'ا'), 'ى', 'ي'), 'ؤ', 'و'), 'ئ', 'ي'), 'ة', 'ه'), '[^' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}' + chr(92) + 's]', ' '), chr(92) + 's+', ' ')}) AS form FROM l",
    "vocabulary_forms": f"WITH {_W} SELECT id, place, {_vocabulary('word')} AS form FROM w",
    "vocalised_forms": f"WITH {_W} SELECT id, place, {_gone(_VOCALISED, chr(92) + 's+')} AS form FROM w",
    "detector_skeletons": f"WITH {_W} SELECT id, place, {_DETECTOR} AS form FROM w",
    "aligner_skeletons": f"WITH {_W} SELECT id, place, {_aligner('word')} AS form FROM w",
    "evaluator_skeletons": f"WITH {_W} SELECT id, place, {_kept(_gone(_EVALUATOR, '[اويه]+$'), _EVALUATOR)} AS form FROM w",
    "sound_skeletons": f"WITH {_W} SELECT id, place, {_gone(_SOUND, '[اوي]')} AS form FROM w",
    # a word begins at each spoken token; the first takes the tokens before it; with none spoken all are one word
    "verse_words": f"""WITH {_L}, {_TOKENS}, g AS (SELECT *, greatest(sum(CASE WHEN spoken THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n), 1) - 1 AS place FROM t)
      SELECT id, CAST(place AS BIGINT) AS place, string_agg(token, ' ' ORDER BY n) AS word FROM g GROUP BY id, place""",
    # a call takes the word after it, unless that call was itself taken by a call
    "called_words": f"""WITH {_W}, {_CALLS}, r AS (SELECT *, place - max(CASE WHEN NOT calls THEN place ELSE -1 END) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM c),
      b AS (SELECT *, CASE WHEN place > 0 AND coalesce(lag(calls) OVER (PARTITION BY id ORDER BY place), false) AND (coalesce(run, place + 1) - 1) % 2 = 1 THEN 0 ELSE 1 END AS begins FROM r),
      g AS (SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY place) - 1 AS nth FROM b) SELECT id, CAST(nth AS BIGINT) AS place, string_agg(word, '' ORDER BY place) AS word FROM g GROUP BY id, nth""",
    "position_bearing": f"WITH {_L}, x AS (SELECT id, unnest(regexp_split_to_array(line, '\\s+')) AS word FROM l), f AS (SELECT id, {_aligner('word')} AS form FROM x) SELECT id, sum(CASE WHEN form <> '' THEN 1 ELSE 0 END) >= 2 AND sum(length(form)) >= 4 AS bears FROM f GROUP BY id",
    "stop_licences": rf"WITH {_W} SELECT id, place, CASE WHEN regexp_matches(word, '[\x{{06D9}}\x{{06DC}}]') THEN 'never' WHEN contains(word, chr(1752)) THEN 'always' WHEN contains(word, chr(1755)) THEN 'paired' WHEN regexp_matches(word, '[\x{{06D6}}\x{{06D7}}\x{{06DA}}\x{{06DB}}]') THEN 'allowed' ELSE 'none' END AS licence FROM w",
    "stops_allowed": r"WITH " + _W + r" SELECT id, place, regexp_matches(trim(word), '[\x{06D6}\x{06D7}\x{06D8}\x{06DA}\x{06DB}]$') AS allowed FROM w",
    "held_nasals": f"WITH {_W} SELECT id, place, {_NASAL} AS held FROM w WHERE next IS NOT NULL",
    "held_vowels": f"WITH {_W} SELECT id, place, {_LAST} <> '' AND {_HEAD} <> '' AND contains('اآويى', {_LAST}) AND (contains('ءآأإاى', {_HEAD}) OR contains(word, chr(1619))) AS held FROM w WHERE next IS NOT NULL",
    "breaths_allowed": rf"WITH {_W} SELECT id, place, NOT regexp_matches(trim(word), '\x{{06D9}}$') AND NOT regexp_matches(trim(next), '^\x{{0671}}\x{{0644}}?[\x{{0621}}-\x{{064A}}][^\x{{0621}}-\x{{064A}}]*\x{{0651}}') AND NOT {_NASAL} AS allowed FROM w WHERE next IS NOT NULL",
    "hanging_words": f"WITH {_W} SELECT id, place, list_contains(string_split('{' '.join(script.CANNOT_END)}', ' '), {_vocabulary('word')}) AS hangs FROM w",
    "dropped_vowels": r"WITH " + _W + r" SELECT id, place, regexp_matches(regexp_replace(word, '[\x{06D6}-\x{06DC}\s]', '', 'g'), '[\x{064C}-\x{0650}]$') AS dropped FROM w",
    "right_to_left": r"WITH " + _L + r", n AS (SELECT id, len(regexp_extract_all(line, '[\x{0590}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]')) AS r, len(regexp_extract_all(line, '\p{L}')) AS a FROM l) SELECT id, r > 0 AND 2 * r > a AS rtl FROM n",
    "bare_lines": f"WITH {_L} SELECT id, regexp_replace(line, '{_SIGNS}+(\\s|$)', '\\1', 'g') AS bare FROM l",
    "detached_signs": f"""WITH {_L}, p AS (SELECT id, regexp_extract_all(line, '{_SIGNS}+(?:\\s|$)') AS signs, regexp_split_to_array(line || ' ', '{_SIGNS}+(?:\\s|$)') AS parts FROM l), e AS (SELECT id, i - 1 AS nth, signs, parts, i FROM (SELECT *, unnest(range(1, len(signs) + 1)) AS i FROM p))
      SELECT id, nth, trim(signs[i]) AS sign, array_to_string(parts[1:i], ' ') AS before FROM e""",
    "plain_texts": r"""WITH """ + _L + r""" SELECT id, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(line, '(?is)<sup\b[^>]*>.*?</sup>', '', 'g'), '<[^>]*>?', '', 'g'), '&quot;', '"'), '\s+([,.;:!?])', '\1', 'g'), '\s{2,}', ' ', 'g')) AS plain FROM l""",
    "compared_words": f"WITH {_W}, f AS (SELECT word, {_aligner('word')} AS form FROM w) SELECT form, count(DISTINCT word) AS spellings, count(*) AS n FROM f WHERE form <> '' GROUP BY form",
}
