"""Text columns: cleanup, quality verdicts, keys, sentences, tokens and the hashed embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence: up to its end marks, or to the end of the text.
SENTENCE = r"[^.!?\n]+(?:[.!?]+|\z)"
TOKEN = "[a-z0-9]+"
BUCKETS = 256


def clean(text: Column) -> Column:
    """Join words hyphenated at line ends, collapse white space, trim."""
    joined = F.regexp_replace(text, r"([A-Za-z])-[ ]*\n[ ]*([A-Za-z])", "$1$2")
    return F.trim(F.regexp_replace(joined, r"[ \t\r\n\f]+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+\z", "")


def quality(text: Column, least: int = 40, most_bad: float = 0.03) -> Column:
    """empty, poor (too many control or replacement characters) or good."""
    size = F.length(F.trim(text))
    bad = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]", ""))
    return F.when(size.isNull() | (size < least), "empty").when(bad > most_bad * F.length(text), "poor").otherwise("good")


def name_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def with_prefix(text: Column, prefix: str) -> Column:
    """The prefix once, however often this is applied."""
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), 0)


def token_bucket(token: Column) -> Column:
    """sha256(token) modulo 256, which is its last byte."""
    return F.conv(F.substring(F.sha2(token, 256), 63, 2), 16, 10).cast("int")


def signed_year(number: Column, era: Column) -> Column:
    """BCE years are negative; there is no year 0."""
    year = F.when(F.upper(era).isin("BC", "BCE"), -number).otherwise(number)
    return F.when(year != 0, year)


def shift_year(year: Column, by: int) -> Column:
    moved = year + by
    return F.when((year < 0) & (moved >= 0), moved + 1).when((year > 0) & (moved <= 0), moved - 1).otherwise(moved)


def roman_value(text: Column) -> Column:
    """The value of a canonical roman numeral from I to MMMCMXCIX, else null."""
    letters = F.split(F.upper(text), "")
    worth = F.create_map(*[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda a, c: F.struct((a["total"] + worth[c] - F.when(a["last"] < worth[c], 2 * a["last"]).otherwise(0)).alias("total"), worth[c].alias("last"))
    canonical = F.upper(text).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(text) > 0)
    return F.when(canonical, F.aggregate(letters, start, step)["total"])


#: Latin letters with marks and the letters below them; ligatures become two letters.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def folded(text: Column, gap: str = " ") -> Column:
    """Lower case with each marked letter as its base letter and `gap` in the place of the
    mark, which separates tokens; æ and œ are two letters."""
    low = F.replace(F.replace(F.lower(text), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    marked = F.regexp_replace(low, f"([{MARKED}])", f"$1{gap}") if gap else low
    return F.translate(marked, MARKED, PLAIN)


def folded_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), 0))


def surface_key(text: Column) -> Column:
    """Folded without gaps, spaces collapsed, one spelling of a first name."""
    return F.regexp_replace(F.trim(F.regexp_replace(folded(text, ""), r"\s+", " ")), r"\bcaius\b", "gaius")


def terms(text: Column, stop: list[str], synonyms: dict[str, str] | None = None) -> Column:
    """Words of three letters and more without stop words, synonyms folded to one term, in order."""
    words = F.filter(F.regexp_extract_all(folded(text), F.lit("[a-z][a-z']{2,}"), 0), lambda w: ~w.isin(*stop))
    if not synonyms:
        return words
    known = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def names(text: Column, first: int | None = None) -> Column:
    """Capitalised words of three letters and more, lower-cased and once; of the first words alone if so given."""
    head = F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, first), " ") if first else text
    return F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(r"\b[A-Z][A-Za-z']{2,}"), 0), F.lower))


def match_key(text: Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def distinct_words(text: Column) -> Column:
    """Words once, whatever their case, each as it is first written, in order."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    low = F.transform(words, F.lower)
    return F.array_join(F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), " ")


def name_forms(name: Column) -> Column:
    """The forms of a place's name: without a note in brackets at its end, parted at commas."""
    bare = F.regexp_replace(name, r"\s*\([^()]*\)\s*$", "")
    return F.array_distinct(F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != ""))


#: What ends a sentence, and abbreviations after whose full stop none ends.
BREAK = r"[.!?][\"'’”»)]*\s+"
ABBREVIATED = r"(?i)(?:\b(?:Mr|Mrs|Ms|Dr|cons|cos|ch|chap)\.|(?:\b[A-Z]\.)+|\b[IVXLCDM]+\.)\z"
