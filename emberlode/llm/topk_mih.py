"""Exact top-k Hamming search by incremental multi-index hashing, as joins.

Codes are cut into segments, and a table has a row for each segment value of each
distinct code. Round r, from 0, joins the values at distance r from those of the queries
that are still open, verifies the codes that it meets within the join and keeps each
query's k best. After radius r of all m segments every code within m (r + 1) - 1 bits
has been seen, so a query is done as soon as its k-th verified distance is no more than
that. With k-th distance d, codes within d bits are at r or less in one of the first
d - m r + 1 segments or at r - 1 in another, so round r asks only those segments, and
only codes within d bits leave the join. Equal codes are one entry, so a vector that a
third of all rows share costs no more than any other. A query so far from all codes that
a segment has more values at the next radius than there are codes meets all codes
instead, which is exact as well.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textops import Rounds

K = 10
#: Bits of a code, and the most segments that it is cut into.
BITS, MOST_SEGMENTS = 64, 16


def sign_code(embedding: Column) -> Column:
    """64-bit code: bit i is set where coordinate i is positive. Null for null; more than 64 coordinates are an error."""
    bits = F.transform(embedding, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    code = F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(embedding) <= BITS, code).when(embedding.isNotNull(), F.raise_error(F.lit(f"a vector has more than {BITS} coordinates")).cast("long"))


def segments(n: int, bits: int | None = None, k: int = K) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment for n codes: as many as make the expected work of a query least.

    The k-th distance is taken as that among n random codes; a radius for each segment
    then follows, and the work is each value asked for and the codes that have it.
    """

    def cut(m: int) -> list[int]:
        return [BITS // m + (s < BITS % m) for s in range(m)]

    def work(m: int) -> float:
        radius = [(d + 1) // m - 1 + (s < (d + 1) % m) for s in range(m)]
        return sum(sum(math.comb(w, r) for r in range(t + 1)) * (1 + n / 2**w) for w, t in zip(cut(m), radius))

    d, seen = 0, 1
    while d < BITS and n * seen < k << BITS:
        d += 1
        seen += math.comb(BITS, d)
    m = -(-BITS // bits) if bits else min(range(2, MOST_SEGMENTS + 1), key=work)
    widths = cut(m)
    return [(sum(widths[:s]), w) for s, w in enumerate(widths)]


def _values(codes: DataFrame, cuts: list[tuple[int, int]], *more: str) -> DataFrame:
    """A row for each segment of each code: seg, width, value."""
    each = F.array(*[F.struct(F.lit(s).alias("seg"), F.lit(w).alias("width"), F.shiftrightunsigned("code", at).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for s, (at, w) in enumerate(cuts)])
    return codes.select("code", *more, F.explode(each).alias("s")).select("code", *more, "s.*")


def nearest(codes: DataFrame, queries: DataFrame, k: int = K, bits: int | None = None, told: list[dict[str, int]] | None = None) -> DataFrame:
    """The k rows of codes(id, code) nearest to each row of queries(id, code).

    Returns query_id, rank (from 1), id, distance; ties by the smaller id. Rows with a
    null id or code are left out. A query that is itself among the codes finds
    itself. Repeated rows with the same id and code count once; an id with several codes
    is a candidate, or a query, by each of them. Fewer than k codes give fewer rows, an
    empty table none. Other columns are ignored. bits: of a segment, in place of the
    width that follows from the number of codes. told: gets radius, open (queries) and
    met (pairs kept so far) of each round.
    """
    spark = codes.sparkSession
    rounds = Rounds(spark)
    c = codes.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).where("id is not null and code is not null").distinct()
    q = queries.select(F.col("id").cast("long").alias("query_id"), F.col("code").cast("long").alias("code")).where("query_id is not null and code is not null").distinct()
    some = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = rounds.put(c.withColumn("r", some).where(F.col("r") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = entries.count()
    cuts = segments(n, bits, k)
    light = entries.select("code", F.element_at("ids", 1).alias("first"), F.size("ids").alias("many"))
    table = rounds.put(_values(light, cuts, "first", "many"))
    open_ = rounds.put(q.select("code", F.lit(None).cast("int").alias("kth")).distinct())
    widest = max(w for _, w in cuts)
    best, r = None, 0
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
    # kth is null until a query has met k rows; what is farther isn't let out of the join
    near = F.col("kth").isNull() | (distance <= F.col("kth"))
    while n and not open_.isEmpty():
        if math.comb(widest, r) > n:
            last = True
            pairs = open_.select(F.col("code").alias("q"), "kth").join(light, near)
        else:
            last = r == widest
            masks = spark.createDataFrame([(w, sum(1 << i for i in c)) for w in sorted({w for _, w in cuts}) for c in combinations(range(w), r)], "width int, mask long")
            asked = _values(open_, cuts, "kth").where(F.col("kth").isNull() | (F.col("seg") <= F.col("kth") - len(cuts) * r))
            # no more masks than there are codes
            probes = asked.join(F.broadcast(masks), "width").select(F.col("code").alias("q"), "kth", F.col("seg").alias("_seg"), F.col("value").bitwiseXOR(F.col("mask")).alias("_value"))
            pairs = probes.join(table, (F.col("_seg") == F.col("seg")) & (F.col("_value") == F.col("value")) & near)
        met = pairs.select("q", "code", "first", "many", distance.alias("distance")).distinct()
        place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "first"))
        every = met if best is None else best.unionByName(met).distinct()
        now = rounds.put(every.withColumn("r", place).where(F.col("r") <= k).drop("r"))
        have = F.sum("many").over(Window.partitionBy("q").orderBy("distance", "first"))
        proven = now.withColumn("have", have).groupBy("q").agg(F.count(F.lit(1)).alias("found"), F.min(F.when(F.col("have") >= k, F.col("distance"))).alias("kth"))
        proven = proven.select(F.col("q").alias("code"), "kth", F.coalesce((F.col("kth") <= len(cuts) * (r + 1) - 1) | (F.col("found") == n), F.lit(False)).alias("done"))
        left = open_.where("false") if last else rounds.put(open_.drop("kth").join(proven, "code", "left").where("done is null or not done").select("code", F.col("kth").cast("int").alias("kth")))
        if told is not None:
            told.append({"radius": r, "open": open_.count(), "met": now.count()})
        old, best, was, open_ = best, now, open_, left
        rounds.drop(old, was)
        r += 1
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance int")
    near = best.join(entries, "code").select(F.col("q").alias("code"), F.explode("ids").alias("id"), F.col("distance").cast("int").alias("distance"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return q.join(near, "code").select("query_id", "rank", "id", "distance")
