"""What each filter of a cleaning chain costs, under every order of the filters.

Direct relational replay: the flags of each document meet all orders of the filters
(n! rows, broadcast), each pair is exploded to its steps, the first failing step is
computed from the flags, and one aggregation counts per part, order and step. Partial
sums are made where the rows are, so the shuffle carries a row per group and task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space between words, as a class of patterns and as the characters.
SPACE, SPACES = r"[ \t-\r]+", " \t\n\x0b\x0c\r"
LETTERS = "ABCDE"
#: Fewest words, least percent of distinct words, most percent of capitals, forbidden characters.
MIN_WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
#: Filters whose orders are still a small table: 7! is 5040 rows.
MOST_FILTERS = 7


def words(text: Column) -> Column:
    """Maximal runs of what isn't white space."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def content_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_md5 and whether the text fails A to D, for every row of docs(doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", "text", words(F.col("text")).alias("words"))
    n = F.size("words").cast("long")
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return rows.select(
        "doc_id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_md5"), (n < MIN_WORDS).alias("A"), (100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT * n).alias("B"),
        (100 * capitals.cast("long") > CAPITALS * F.length("text").cast("long")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"),
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good and toxic of every row of docs(doc_id, text, lang), with labels(doc_id, quality, toxic).

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals > 10 *
    code points; D: any of #$%&*|; E: a smaller doc_id has the same text, told by MD5.
    Groups of copies never meet: the least id of each text is summed up map-side, and a
    row looks for itself, by id and text, among those. A row without an id has no smaller
    one and is nobody's; rows that share an id aren't smaller than each other. Of several
    labels of an id, any that says 1 counts.
    """
    rows = content_failures(docs)
    first = rows.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(first, ["doc_id", "text_md5"], "left").join(told, "doc_id", "left")
    return rows.select("part", *LETTERS[:4], (F.col("doc_id").isNotNull() & F.col("is_first").isNull()).alias("E"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replay(flags: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Counts of every order and step for flags(part, one boolean column a filter, good, toxic).

    filters: names of one character each, at most 7. One row per part, filter_order and
    step (from 1): kept (left after the step), removed (failing there first), redundant
    (failing it, gone before), unique_fails (failing it alone), good_lost and toxic_lost
    (removed and marked so), shapley (removed by the step's filter in all orders
    together). A part has all its rows, zeros included; without rows there are none. A
    null flag is no failure, a null part a part of its own.
    """
    if not filters or len(filters) > MOST_FILTERS or len(set(filters)) < len(filters) or any(len(f) != 1 for f in filters):
        raise ValueError(f"1 to {MOST_FILTERS} different names of one character")
    n, bit = len(filters), {f: 1 << i for i, f in enumerate(filters)}
    orders = flags.sparkSession.createDataFrame([("".join(p), [bit[f] for f in p]) for p in permutations(filters)], "filter_order string, bits array<int>")
    fails = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f), bit[f]).otherwise(0) for f in filters])
    docs = flags.select("part", fails.alias("fails"), "good", "toxic")
    # the orders are n! rows, whatever the table
    pairs = docs.crossJoin(F.broadcast(orders))
    first = reduce(lambda rest, i: F.when(F.col("fails").bitwiseAND(F.get("bits", F.lit(i))) != 0, i + 1).otherwise(rest), reversed(range(n)), F.lit(n + 1))
    steps = pairs.select("part", "filter_order", "fails", "good", "toxic", "bits", first.alias("first"), F.explode(F.array(*[F.lit(i + 1) for i in range(n)])).alias("step"))
    own = F.get("bits", F.col("step") - 1)
    out = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"), F.count_if(F.col("first") == F.col("step")).alias("removed"),
        F.count_if((F.col("first") < F.col("step")) & (F.col("fails").bitwiseAND(own) != 0)).alias("redundant"), F.count_if(F.col("fails") == own).alias("unique_fails"),
        F.count_if((F.col("first") == F.col("step")) & F.col("good")).alias("good_lost"), F.count_if((F.col("first") == F.col("step")) & F.col("toxic")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over docs(doc_id, text, lang), replayed in all 120 orders by lang (null: empty).

    Null and empty texts have no words, so they fail A alone, and E if a smaller id's text
    is empty as well. Repeated rows count each, other columns are ignored, an empty table
    gives no rows. Texts are read whole, of any length.
    """
    return replay(failures(docs, labels), LETTERS)
