"""Text functions: Column in, Column out (ids of the blueprint in brackets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading words that a normalised name drops, plain forms of characters, characters that vanish.
ARTICLES = ("the", "a", "an")
PLAIN_FORMS = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("−", "-"), ("·", "-"), ("•", "-"), ("…", "..."), ("×", "x"))
VANISH = "\u200b\ufeff"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """[T7] int(words * 1.3)."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("int")


def sentences(text: Column) -> Column:
    """[T8] Split after . ! ? and white space; blank pieces are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column, least: int = 100) -> Column:
    """[T9] Blank-line paragraphs, trimmed, of at least `least` characters."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def tidy_whitespace(text: Column) -> Column:
    """[T4] Runs of blanks, runs of line feeds, trailing blanks, blank lines, other blanks; then trim. Multiline rules end at line feeds only."""
    out = F.regexp_replace(text, " {2,}", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?md) +$", "")
    out = F.regexp_replace(out, r"(?md)^\s+$", "")
    return trim_all(F.regexp_replace(out, r"[\t\r\f\x0B]", " "))


# What cleaning removes, by kind, in order.
HEADERS = (r"(?i)^.*?(proprietary|confidential|restricted|internal use only).*?$", r"(?i)^.*?(draft|preliminary|final).*?version.*?$", r"^.*?Page \d+ of \d+.*?$", r"^.*?Document \d+.*?$")
FOOTERS = (r"(?i)^.*?copyright.*?(\d{4}).*?$", r"(?i)^.*?all rights reserved.*?$", r"^.*?www\..*?\.com.*?$", r"^.*?revision.*?\d+.*?$")
PAGE_NUMBERS = (r"^\s*\d+\s*$", r"^\s*-\s*\d+\s*-\s*$", r"^Page \d+$", r"^\[\d+\]$")
WATERMARKS = (r"(?i)DRAFT", r"(?i)CONFIDENTIAL", r"(?i)PRELIMINARY", r"(?i)FOR REVIEW ONLY")
NOISE = (r"^[^\w\s]{3,}$", r"^\s*[|_-]{5,}\s*$", r"^\.{3,}$", r"^\s*\*{3,}\s*$")


def remove_boilerplate(text: Column) -> Column:
    """[T1] Headers, footers, page numbers, watermarks and noise, in this order."""
    for pattern in (*HEADERS, *FOOTERS, *PAGE_NUMBERS, *WATERMARKS, *NOISE):
        text = F.regexp_replace(text, "(?md)" + pattern, "")
    return text


def clean(text: Column) -> Column:
    """[T1, T3, T4] Removals, the word rule of OCR repair, white space; operators.cleaning.clean also protects and repairs numbers."""
    return tidy_whitespace(ocr_words(remove_boilerplate(text)))


def ocr_words(text: Column) -> Column:
    """[T3] rn read for m inside words."""
    return F.regexp_replace(text, r"(?<=\w)rn(?=\w)", "m")


def normalize(text: Column) -> Column:
    """[T5] Normalised form, for text whose characters have no compatibility forms (functions.udfs.normalize_terms has them, and protected terms)."""
    return F.lower(display_form(text))


def display_form(text: Column) -> Column:
    """[T5] Plain characters, other symbols to blanks, no blanks around + # /, blanks around -, no leading articles. C++ and C# are kept whole."""
    out = F.regexp_replace(trim_all(F.coalesce(text, F.lit(""))), r"(?i)\bC\+\+", "C__pp__")
    out = F.regexp_replace(out, r"(?i)\bC#", "C__sh__")
    out = F.translate(out, VANISH, "")
    for odd, plain in PLAIN_FORMS:
        out = F.replace(out, F.lit(odd), F.lit(plain))
    out = F.regexp_replace(out, r"(?U)[^\w\s+#\-/.:']", " ")
    out = F.regexp_replace(out, r"(?U)\s*([+#/])\s*", "$1")
    out = F.regexp_replace(out, r"(?U)\s*-\s*", " - ")
    out = trim_all(F.regexp_replace(out, r"(?U)\s+", " "))
    out = F.regexp_replace(out, r"(?i)^(?:(?:the|a|an) )+(?=\S)", "")
    return F.replace(F.replace(out, F.lit("__pp__"), F.lit("++")), F.lit("__sh__"), F.lit("#"))


def key_fragment(text: Column) -> Column:
    """[T6] Normalised, other characters to one underscore, trimmed of them."""
    return F.regexp_replace(F.regexp_replace(normalize(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def candidate_key(kind: Column, name: Column) -> Column:
    return F.concat(F.upper(kind), F.lit(":"), key_fragment(name))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """[T28] Name-based UUID: SHA-1 of namespace and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def jaccard(a: Column, b: Column) -> Column:
    """[W7] Of lower-cased white-space tokens; 0 if either has none."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def snippet(text: Column, start: Column, end: Column, around: int = 80) -> Column:
    """[W14] The text around a span, `around` characters on each side."""
    low = F.greatest(start - around, F.lit(0))
    return F.substr(text, low + 1, F.least(end + around, F.length(text)) - low)


def acronym_definitions(text: Column) -> Column:
    """[T14] Array of (acronym, expansion) from "Long Form (LF)" and "LF (Long Form)"."""
    long_first = r"\b((?:[A-Z][A-Za-z-]+ ){1,5}[A-Z][A-Za-z-]+) \(([A-Z]{2,8})\)"
    short_first = r"\b([A-Z]{2,8}) \(((?:[A-Z][A-Za-z-]+ ){1,5}[A-Z][A-Za-z-]+)\)"
    one = F.arrays_zip(F.regexp_extract_all(text, F.lit(long_first), F.lit(2)).alias("acronym"), F.regexp_extract_all(text, F.lit(long_first), F.lit(1)).alias("expansion"))
    two = F.arrays_zip(F.regexp_extract_all(text, F.lit(short_first), F.lit(1)).alias("acronym"), F.regexp_extract_all(text, F.lit(short_first), F.lit(2)).alias("expansion"))
    shape = lambda x: F.struct(x["acronym"].alias("acronym"), x["expansion"].alias("expansion"))
    return F.concat(F.transform(one, shape), F.transform(two, shape))


def numbers_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def acronyms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)))


def rewrite_verdict(before: Column, after: Column) -> Column:
    """[T22, U3] accepted, or rejected with what the rewrite lost."""
    lost_n = F.array_except(numbers_of(before), numbers_of(after))
    lost_a = F.array_except(acronyms_of(before), acronyms_of(after))
    return (
        F.when(F.size(lost_n) > 0, F.lit("rejected:missing_numbers"))
        .when(F.size(lost_a) > 0, F.lit("rejected:missing_acronyms"))
        .when((F.length(before) > 400) & (F.length(after) < F.lit(0.4) * F.length(before)), F.lit("rejected:too_short"))
        .otherwise(F.lit("accepted"))
    )


# Version and date forms in documents, first match wins.
VERSION_PATTERNS = (r"(?i)\bversion[:\s]+([0-9]+(?:\.[0-9]+)*)", r"(?i)\brevision[:\s]+([0-9A-Za-z.]+)", r"(?i)\brev\.?[:\s]+([0-9A-Za-z.]+)", r"\bv([0-9]+(?:\.[0-9]+)+)")
DATE_PATTERNS = ((r"\b(\d{4}-\d{2}-\d{2})\b", "yyyy-MM-dd"), (r"\b(\d{2}/\d{2}/\d{4})\b", "MM/dd/yyyy"))


def version_of(text: Column) -> Column:
    """[SRC7]"""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in VERSION_PATTERNS])


def date_of(text: Column) -> Column:
    """[SRC7] ISO date; a form that is no date gives way to the next one."""
    return F.coalesce(*[F.date_format(F.try_to_date(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), form), "yyyy-MM-dd") for p, form in DATE_PATTERNS])


def pdf_date(raw: Column) -> Column:
    """[SRC6] D:YYYYMMDD... to an ISO date."""
    return F.date_format(F.try_to_date(F.nullif(F.regexp_extract(raw, r"^D:(\d{8})", 1), F.lit("")), "yyyyMMdd"), "yyyy-MM-dd")
