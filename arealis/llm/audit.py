"""How filters share the documents that they remove: orders, overlaps and Shapley values from one count of failures.

A document's failures are a set of filters, its mask. With each filter i applied to a share x_i of what it would
remove, the number removed is a polynomial with one degree in each x_i, the multilinear extension of the game whose
players are the filters:

    R(x) = sum over masks of count * (1 - product over i in mask of (1 - x_i))

Its corners are the numbers that sets of filters remove. The Shapley value of i is the integral of R's derivative in
x_i along the diagonal from 0 to 1: a term c * x_i * ... of degree d gives c / d. All sums are whole numbers over the
common denominator k!, so times k! (over all orders of k filters) they are whole numbers without rounding.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ends of words: ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> tuple[Column, Column, Column, Column]:
    """Failures that a text has by itself: few words, repeated words, capitals, signs."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return n < 50, 100 * different.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail, bits 0 to 4 for A to E.

    E, identical to the text of a smaller id anywhere in the table, is told from SHA-256 digests. Rows of one digest are
    first summed up by part and labels, each sum with its smallest id, so a text that a third of all rows hold comes
    as one row for each task, and as one for each part and label where the smallest id of all is looked for. A null text
    is empty, a null part the empty string. Rows that repeat an id each count; a row without an id has no smaller one.
    Labels of an id that come more than once hold if any of their rows says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(f"f{i}") for i, c in enumerate(text_failures(text))])
    known = known.select("id", "part", "digest", sum((F.col(f"f{i}").cast("int") * (1 << i) for i in range(4)), F.lit(0)).alias("mask"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = known.join(said, "id", "left").groupBy("id", "part", "digest", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))
    same = rows.groupBy("digest", "part", "mask", "good", "toxic", F.col("id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("low"))
    same = same.withColumn("first", F.min("low.id").over(Window.partitionBy("digest")))
    fresh = F.when(F.col("nameless"), F.col("n")).when(F.col("low.id") == F.col("first"), F.col("low.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("m"), fresh.alias("k")), F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - fresh).alias("k")))
    split = same.select("part", "good", "toxic", F.inline(both)).where("k > 0")
    return split.groupBy("part", F.col("m").alias("mask")).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("good"), F.col("k")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("k")).otherwise(0)).alias("toxic"))


def removal_polynomials(counts: DataFrame, k: int) -> DataFrame:
    """(part, total, terms) from (part, mask, n, good, toxic): a removal polynomial for each of the three counts.

    terms holds (set, n, good, toxic), the coefficients of the product of the variables in a set: expanding
    1 - product(1 - x_i) gives each non-empty set within a mask the sign (-1) ** (size + 1). At most 2 ** k - 1 of them.
    """
    inside = F.filter(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda s: s.bitwiseAND(F.bitwise_not(F.col("mask"))) == 0)
    sets = counts.select("part", *COUNTS, F.explode(inside).alias("set"))
    sign = F.when(F.bit_count("set") % 2 == 1, 1).otherwise(-1)
    terms = sets.groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return terms.groupBy("part").agg(F.max(F.when(F.col("set") == 0, F.col("n"))).alias("total"), F.collect_list(F.when(F.col("set") > 0, F.struct("set", *[(F.col(c) * sign).alias(c) for c in COUNTS]))).alias("terms"))


def interaction_audit(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """For each part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    counts is what failure_counts() gives; letters names the filters by bit. One row of polynomials for a part is turned
    into the values at all corners, and the rows of all orders are read off them. An empty table gives no rows.
    """
    k = len(letters)
    parts = removal_polynomials(counts, k)
    total = lambda c, where: F.aggregate(F.filter("terms", where), F.lit(0).cast("long"), lambda a, t: a + t[c])
    corner = F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda s: F.struct(*[total(c, lambda t: t["set"].bitwiseAND(F.bitwise_not(s)) == 0).alias(c) for c in COUNTS]))
    # the integral of the derivative in x_i: each term that holds x_i over its degree, in units of 1 / k!
    share = F.array(*[F.lit(factorial(k) // d) for d in range(1, k + 1)])
    holding = lambda bit: F.filter("terms", lambda t: t["set"].bitwiseAND(F.lit(bit)) != 0)
    slope = F.array(*[F.aggregate(holding(1 << i), F.lit(0).cast("long"), lambda a, t: a + t["n"] * F.element_at(share, F.bit_count(t["set"]))) for i in range(k)])
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    rows = parts.select("part", "total", corner.alias("corner"), slope.alias("slope")).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = lambda i: F.instr(F.lit(letters), F.substring("filter_order", i, F.lit(1))) - 1
    upto = lambda last: F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(k)), F.lit(1), last), F.lit(0), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), place(i))))
    rows = rows.withColumns({"_i": place(F.col("step")), "_before": upto(F.col("step") - 1), "_after": upto(F.col("step"))})
    bit = F.call_function("shiftleft", F.lit(1), F.col("_i"))
    at = lambda s, c: F.element_at("corner", s + 1)[c]
    removed = at(F.col("_after"), "n") - at(F.col("_before"), "n")
    every = (1 << k) - 1
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - at(F.col("_after"), "n")).alias("kept"), removed.alias("removed"), (at(bit, "n") - removed).alias("redundant"),
        (at(F.lit(every), "n") - at(F.lit(every) - bit, "n")).alias("unique_fails"), (at(F.col("_after"), "good") - at(F.col("_before"), "good")).alias("good_lost"),
        (at(F.col("_after"), "toxic") - at(F.col("_before"), "toxic")).alias("toxic_lost"), F.element_at("slope", F.col("_i") + 1).alias("shapley"),
    )
