"""Line-first quality rules (operator 6), in DataFrame functions only.

Every line that holds a word is judged by itself (a short line without a closing mark, navigation, boilerplate, symbols,
shouting); failing lines are taken out, and a document that loses too much of its text is rejected. Four statistics of
the whole text and a base test on them come first. What a kept document goes on with is its text without those lines.

The rules know no language but for the boilerplate phrases, which are those of six: marks that close a sentence or a
quotation are taken from many scripts, and a line of LONG_LINE characters need not end in one.

Defined cases: a null or empty text has no words, all statistics are 0 and the base test fails it; lines without a word
pass and stay; rows are judged one by one, so repeated rows get equal results and there are no ties; docs' columns travel
in a struct, so their names clash with nothing; a text of any length is one row's work; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space; characters that count as symbols; closing marks of many scripts; notices' phrases.
WORD = r"[^\x20\x09-\x0D]"
BLANK = r"[\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
CLOSERS = ".!?:;…\"'”’»›)]}。．｡！？：；」』）】》〉〕؟؛۔।॥։።፧፨៕၊။༎།"
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "accept cookies", "accept all cookies", "lorem ipsum", "subscribe to our newsletter", "enable javascript", "click here", "read more", "share this", "sign in", "sign up", "log in", "login",
    "alle rechte vorbehalten", "datenschutz", "cookies akzeptieren", "newsletter abonnieren", "hier klicken", "mehr lesen", "weiterlesen", "anmelden",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "cliquez ici", "lire la suite", "se connecter",
    "todos los derechos reservados", "política de privacidad", "aceptar cookies", "haga clic aquí", "leer más", "iniciar sesión",
    "tutti i diritti riservati", "informativa sulla privacy", "accetta i cookie", "clicca qui", "leggi tutto", "todos os direitos reservados", "aceitar cookies", "clique aqui", "leia mais",
)
BOILERPLATE = r"(?:^|[^\p{L}\p{N}])(" + "|".join(PHRASES) + r")(?:$|[^\p{L}\p{N}])"
NAVIGATION = r"\s[|>»•·/]\s"

LONG_LINE = 80  # characters; a shorter line has to end in a closing mark
SHORT_WORDS = 10  # a document of fewer words fails
NOTICE_CHARS = 200  # a line of more is no notice, whatever phrase it holds
REPEAT_PERCENT = 20  # of words in repeated 5-word windows
WINDOW = 5


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _windows(body: Column) -> Column:
    """Each window of WINDOW words, in order, words joined by single spaces; one pass of a possessive pattern."""
    flat = F.regexp_replace(body, BLANK + "+", " ")
    return F.regexp_extract_all(flat, F.lit(r"(?=((?:[^ ]++ ){%d}[^ ]++))[^ ]++" % (WINDOW - 1)), F.lit(1))


def _keyed(windows: Column) -> Column:
    """(hash, place) of each window, sorted, where any window repeats; else null."""
    pairs = F.array_sort(F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs)


def _repeated_places(keyed: Column) -> Column:
    """Places of the windows whose hash a neighbour in the sorted pairs has too, in order. keyed must be a stored column."""
    twice = F.filter(keyed, lambda x, i: (x["h"] == F.get(keyed, i - 1)["h"]) | (x["h"] == F.get(keyed, i + 1)["h"]))
    return F.coalesce(F.array_sort(F.transform(twice, lambda x: x["i"])), F.array().cast("array<int>"))


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns row (df's own, or those in keep), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; and _body, _lines."""
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or df.columns)]).alias("row")
    body = F.col("_body")
    staged = (
        df.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_body"))
        .withColumn("n_words", _count(body, WORD + "++"))
        .withColumn("_windows", _windows(body))
        .withColumn("_lines", F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)))
        .withColumn("_keyed", _keyed(F.col("_windows")))
        .withColumn("_at", _repeated_places(F.col("_keyed")))
    )
    gaps = F.transform(F.col("_at"), lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - x, F.lit(WINDOW))))
    return (
        staged.withColumn("word_chars", F.length(F.regexp_replace(body, BLANK + "+", "")).cast("long"))
        .withColumn("n_symbols", _count(body, SYMBOL))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("base_failed", (F.col("n_words") < SHORT_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
        .drop("_windows", "_keyed", "_at")
    )


def line_passes(line: Column) -> Column:
    """True for a line that reads as prose. Each rule looks at one line only; the cheapest come first."""
    last = F.regexp_extract(line, "(" + WORD + ")" + BLANK + r"*\z", 1)
    return (
        ((F.length(line) >= LONG_LINE) | F.lit(CLOSERS).contains(last))
        & (_count(line, NAVIGATION) < 2)
        & (5 * _count(line, SYMBOL) <= _count(line, BLANK) + 1)
        & (2 * F.length(F.regexp_replace(line, r"[^\p{Lu}]+", "")) <= F.length(line))
        & ~((F.length(line) < NOTICE_CHARS) & F.lower(line).rlike(BOILERPLATE))
    )


def judge(df: DataFrame, text: str = "text", max_lost: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Columns row, the statistics, n_bad_lines, line_chars, kept_chars (of lines that pass), kept and clean_text.

    kept is false where base_failed, else true if the failing lines hold at most max_lost of the characters in lines
    with a word. clean_text is the text without the failing lines; lines without a word stay.
    """
    every = F.split("_body", "\n", -1)
    staged = with_statistics(df, text, keep).withColumn("_good", F.filter(every, lambda x: ~x.rlike(WORD) | line_passes(x)))
    lines = F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    n_bad = F.size(every) - F.size("_good")
    lost = F.length("_body") - F.length("clean_text") - n_bad + F.when(F.size("_good") == 0, F.lit(1)).otherwise(F.lit(0))  # line feeds go with their lines
    return (
        staged.withColumn("clean_text", F.array_join("_good", "\n"))
        .withColumn("n_bad_lines", n_bad.cast("long"))
        .withColumn("line_chars", lines)
        .withColumn("kept_chars", (F.col("line_chars") - lost).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= (1 - max_lost) * F.col("line_chars")))
        .drop("_lines", "_good", "_body")
    )


def clean(df: DataFrame, text: str = "text", length: str | None = None, max_lost: float = 0.5) -> DataFrame:
    """The rows of df whose document is kept, with df's columns; text without its failing lines, and its length anew."""
    judged = judge(df, text, max_lost)
    # a filter on kept itself would be pushed below the projections and compute them anew for each use
    once = judged.select("row", F.explode(F.array(F.struct("kept", "clean_text"))).alias("_x")).filter("_x.kept")
    new = {text: F.col("_x.clean_text")} | ({length: F.length("_x.clean_text").cast(df.schema[length].dataType)} if length else {})
    return once.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns])
