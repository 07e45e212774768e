"""Line-first cleaning with DataFrame expressions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed; a document that loses too much of its text is rejected. All
work is inside the row: arrays of words and lines, no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Signs of boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "we use cookies", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "enable javascript", "javascript is disabled", "subscribe to our newsletter", "sign up for our newsletter", "click here to", "skip to content",
    "skip to main content", "powered by wordpress", "lorem ipsum", "copyright (c)", "share on facebook", "share this:",
)
#: Words that make up menus.
NAVIGATION = ("home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous", "back", "contact", "about", "about us", "contact us", "sitemap", "read more", "show more")
#: What a sentence ends with, closing quotes and brackets aside.
TERMINAL = r"[.!?…。！？:;,][\"'”’»)\]*_`]*$"
MAX_LOST = 0.5
MAX_SYMBOL_WORDS = 0.1
MAX_SHOUTING = 0.7


def words_of(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT, -1), lambda w: w != "")


def line_verdict(line: Column) -> Column:
    """True for a line that is kept. A line without words is kept (it holds no text)."""
    low = F.lower(F.trim(line))
    # code points of the line that aren't white space, without a pass by character
    words = F.size(F.split(F.trim(F.regexp_replace(line, WORD_SPLIT, " ")), " "))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>]{2,}|[|<>»]"))
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    upper = F.regexp_count(line, F.lit(r"\p{Lu}"))
    blank = low == ""
    punctuation = low.rlike(TERMINAL) | (words >= 6)  # a long line may be cut mid-sentence; a short one without an end is a heading or a menu entry
    navigation = low.isin(*NAVIGATION) | (symbols > MAX_SYMBOL_WORDS * words)
    shouting = (words >= 4) & (upper > MAX_SHOUTING * letters)
    boilerplate = F.lit(False)
    for sign in BOILERPLATE:
        boilerplate = boilerplate | F.contains(low, F.lit(sign))
    return blank | (punctuation & ~navigation & ~shouting & ~boilerplate)


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Base counts, the cleaned text and the verdict for every row of docs(doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lost (share of the words' characters in removed lines), clean_text,
    kept. A line equal to an earlier one is removed as well. Null text has no words
    and fails the base rules; its clean_text is null. A null doc_id stays null,
    repeated rows are judged each, an empty table gives no rows, other columns
    are ignored.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.split(text, "\n", -1))
    df = df.select("doc_id", "_text", "_lines", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    df = df.withColumn("_n", F.greatest(F.col("n_words"), F.lit(1))).withColumn("_room", F.expr("4611686018427387904 div _n"))

    def packed(i: Column, seed: int) -> Column:
        h = F.col("_h")
        return F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.lit(seed)), F.col("_room")) * F.col("_n") + i.cast("long")

    def agreeing(name: str) -> Column:
        """Places whose packed neighbour in the sorted array has the same hash."""
        p, n = F.col(name), F.col("_n")
        same = lambda x, j: F.coalesce(F.get(p, j) - F.pmod(F.get(p, j), n) == x - F.pmod(x, n), F.lit(False))
        return F.transform(F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: F.pmod(x, n).cast("int"))

    n3 = F.col("n_words") >= 3
    places = F.when(n3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_p", F.sort_array(F.transform(places, lambda i: packed(i, 1))))
    df = df.withColumn("_at", agreeing("_p"))
    df = df.withColumn("_p2", F.sort_array(F.transform("_at", lambda i: packed(i, 2))))
    df = df.withColumn("_at2", F.sort_array(agreeing("_p2")))
    # words covered: each window adds what lies beyond the window before it
    covered = F.aggregate(F.transform("_at2", lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(F.col("_at2"), i - 1), F.lit(-3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    line_words = F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("n_repeat_words", covered).withColumn("_full", line_words)
    df = df.withColumn("_once", F.array_distinct("_full"))
    df = df.withColumn("_good", F.filter("_once", line_verdict))
    solid = lambda c: F.length(F.regexp_replace(F.array_join(c, ""), WORD_SPLIT, ""))
    df = df.withColumn("lost", F.when(F.col("word_chars") > 0, F.lit(1.0) - solid("_good") / F.col("word_chars")).otherwise(F.lit(0.0)))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")))
    return df.select(
        "doc_id", "n_words", "word_chars",
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size("_once")).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "base_failed", "lost",
        F.when(F.col("_text").isNotNull(), F.array_join("_good", "\n")).alias("clean_text"),
        (~F.col("base_failed") & (F.col("lost") <= max_lost)).alias("kept"),
    )
