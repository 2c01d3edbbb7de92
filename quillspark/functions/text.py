"""Text cleaning and normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import ARABIC, DOMAIN, ENGLISH

#: White space in both Java's and RE2's regular expressions.
SPACE = r"[ \t\n\r\f]+"
MIN_LENGTH = 3
STOP = tuple(dict.fromkeys(ENGLISH + DOMAIN))
_MARKS = "ـً-ٰٟ"


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; nan, none and null become empty, like a null."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))
    return F.when(F.lower(plain).isin("nan", "none", "null"), "").otherwise(plain)


def has_text(c: Column) -> Column:
    return clean(c) != ""


def provenance(c: Column) -> Column:
    return F.when(has_text(c), "original").otherwise("missing")


def without_prefix(full: Column, prefix: Column) -> Column:
    """The rest of a cleaned text behind an exact prefix, else empty."""
    f, p = clean(full), clean(prefix)
    return F.when((f != "") & (p != "") & F.startswith(f, p), F.trim(F.substring(f, F.length(p) + 1, F.length(f)))).otherwise("")


def without_suffix(full: Column, suffix: Column) -> Column:
    """The part of a cleaned text before an exact suffix, else empty."""
    f, s = clean(full), clean(suffix)
    return F.when((f != "") & (s != "") & F.endswith(f, s), F.trim(F.substring(f, F.lit(1), F.length(f) - F.length(s)))).otherwise("")


def english_tokens(c: Column) -> Column:
    """Lower-case runs of a-z, in order; all other characters but white space vanish."""
    letters = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z \t\n\r\f]", "")
    return F.filter(F.split(letters, SPACE), lambda t: t != "")


def content_words(tokens: Column, stop: Iterable[str] = STOP, least: int = MIN_LENGTH) -> Column:
    """Tokens of some length that are no stop words."""
    stop = list(stop)
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(stop))


def english_words(c: Column) -> Column:
    return content_words(english_tokens(c))


def _letters(c: Column) -> Column:
    """Alef forms, alef maksura, teh marbuta and hamza carriers unified; tatweel dropped."""
    return F.replace(F.translate(c, "إأٱآاىةؤئ", "اااااي" + "ه" + "ءء"), F.lit("ـ"), F.lit(""))


def arabic_normal(c: Column) -> Column:
    """Arabic letters and white space only, letter variants unified, spaces collapsed."""
    return F.trim(F.regexp_replace(_letters(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^؀-ۿ\s]", " ")), r"\s+", " "))


def without_marks(c: Column) -> Column:
    """Diacritics dropped."""
    return F.regexp_replace(c, "[ً-ْٰ]", "")


def arabic_token(c: Column) -> Column:
    """Diacritics dropped, alef forms, alef maksura and hamza carriers unified."""
    return F.translate(without_marks(c), "إأٱآىؤئ", "ااااي" + "ءء")


def arabic_words(tokens: Column, stop: Iterable[str] = ARABIC) -> Column:
    stop = list(stop)
    return F.filter(F.transform(tokens, arabic_token), lambda t: (F.length(t) >= 2) & ~t.isin(stop))


def encoder_form(c: Column) -> Column:
    """Diacritics dropped and spaces collapsed: what encoders read."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[ً-ْٰ]", ""), r"\s+", " "))


def reranker_form(c: Column, most: int = 1200) -> Column:
    """Marks and tatweel dropped, alef wasla unified, spaces collapsed, cut at a length."""
    plain = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{_MARKS}]", ""), "ٱ", "ا")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, most)


def fold(c: Column) -> Column:
    """The form in which vocabulary is looked up: Arabic normalised, else lower-case letters."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.rlike("[؀-ۿ]"), arabic_normal(F.regexp_replace(low, f"[{_MARKS}]", ""))).otherwise(
        F.trim(F.regexp_replace(low, r"[^\p{L}]+", " "))
    )


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the alphanumeric words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def number_label(c: Column) -> Column:
    """Whole floats as integers; ranges and lists kept."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).when(F.lower(text).isin("nan", "none", "null"), "").otherwise(text)


#: What marks each grade in English and in Arabic.
GRADES = (("Sahih", r"\b(sahih|saheeh|authentic)\b", "صحيح"), ("Hasan", r"\b(hasan|good)\b", "حسن"), ("Da'if", r"\b(da[\W_]*if|daeef|weak)\b", "ضعيف"), ("Mawdu", r"\b(maw?du[\W_]*|fabricated|forged)\b", "موضوع"))


def grade_flags(c: Column) -> Column:
    """The grades that a free text names."""
    low = F.lower(clean(c))
    return F.array_compact(F.array(*[F.when(low.rlike("(?U)" + english) | F.contains(low, F.lit(arabic)), F.lit(name)) for name, english, arabic in GRADES]))


def normal_grade(*cs: Column) -> Column:
    """One grade from several texts: the only one named, Hasan for Sahih and Hasan, else Unknown."""
    flags = F.array_distinct(F.flatten(F.array(*[grade_flags(c) for c in cs])))
    both = (F.size(flags) == 2) & F.array_contains(flags, "Sahih") & F.array_contains(flags, "Hasan")
    return F.when(F.size(flags) == 1, F.get(flags, 0)).when(both, "Hasan").otherwise("Unknown")


def anchor(c: Column, kind: str, lang: Column) -> Column:
    """Training text with its prefix; Arabic in the encoder's form."""
    return F.concat(F.lit(f"{kind}: "), F.when(lang == "ar", encoder_form(c)).otherwise(F.coalesce(c, F.lit(""))))
