"""Filter interaction audit: what each filter removes at each step of every order.

A document's failures are bits of a mask. Equal masks of a part are counted as one cell, and each
cell is unpivoted against the steps of all orders of the filters: a running bit-or over the earlier
steps of an order tells whether an earlier filter took the cell, conditional sums over the cells give
the counts of a step, and a total over all steps of a filter its Shapley sum.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpoint

#: Fixed values of the query's conditions.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 3, r"[#$%&*|]"
#: The filter that compares texts instead of looking at one.
REPEATED = "E"
#: Orders grow as the factorial of the filters.
MOST_FILTERS = 7


def count(x: Column) -> Column:
    return F.size(x).cast("long")


#: A filter's failure from the text (null: empty) and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda t, w: count(w) < MIN_WORDS,
    "B": lambda t, w: 100 * count(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * count(w),
    "C": lambda t, w: 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > MAX_UPPER_PERCENT * F.length(t),
    "D": lambda t, w: t.rlike(SYMBOLS),
}


def masks(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n) of docs(doc_id, text, part, ...): bit i of mask is set if filter i fails, the filters
    in the order of filters, REPEATED after them; n is the number of equal rows.

    A text fails REPEATED if any row with a smaller doc_id has the same text. Texts are known by their
    SHA-256 here, a null one as the empty text. A null doc_id is neither smaller nor greater than
    another. A null part is the empty string. Texts of any length are read whole.
    """
    filters = FILTERS if filters is None else filters
    t = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t"), F.array_remove(F.split(t, SPACE), "").alias("w"))
    bits = [F.when(fails(F.col("t"), F.col("w")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = sum(bits, F.lit(0)).cast("long")
    rows = checkpoint(own.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest")))
    # A group of copies, of any size, sends one row of each task.
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    repeated = F.when(F.col("is_first").isNull() & F.col("doc_id").isNotNull(), 1 << len(filters)).otherwise(0)
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(repeated.cast("long")).alias("mask"), "n")


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the rows of masks() with equal part and mask, those labelled quality 1 and toxic 1
    by any row of labels(doc_id, quality, toxic, ...)."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(one("quality"), one("toxic"))
    own = masked.join(marked, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias("good" if c == "quality" else c)
    return own.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality"), total("toxic"))


def interactions(counted: DataFrame, names: list[str]) -> DataFrame:
    """The audit of cells(part, mask, n, good, toxic), bit i of mask being the failure of names[i].

    One row for each part, order of the names (joined) and step from 1: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley, all longs. There are as many rows of a part and
    a mask as there are orders and steps, however many documents.
    """
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    orders = F.array(*(F.array(*map(F.lit, order)) for order in permutations(range(len(names)))))
    letters = F.array(*map(F.lit, names))
    long = counted.select("*", F.explode(orders).alias("order")).select("*", F.posexplode("order").alias("at", "filter"))
    long = long.withColumn("fails", F.expr("mask & shiftleft(1L, filter)"))
    earlier = Window.partitionBy("part", "mask", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("taken", F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)))
    fails, here = F.col("fails") != 0, (F.col("fails") != 0) & (F.col("taken") == 0)
    total = lambda name, c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    steps = long.groupBy("part", "order", "at", "filter").agg(
        total("kept", "n", ~fails & (F.col("taken") == 0)),
        total("removed", "n", here),
        total("redundant", "n", fails & (F.col("taken") != 0)),
        total("unique_fails", "n", F.col("mask") == F.expr("shiftleft(1L, filter)")),
        total("good_lost", "good", here),
        total("toxic_lost", "toxic", here),
    )
    steps = steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    order = F.array_join(F.transform("order", lambda i: F.get(letters, i)), "")
    return steps.select("part", order.alias("filter_order"), (F.col("at") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, part: str = "lang") -> DataFrame:
    """interactions() of docs(doc_id, text, part, ...) by filters, FILTERS unless given, and REPEATED.

    Nulls, long texts and ties are treated as masks() says; repeated rows count as often as they
    come; an empty table has no part and so no row; without labels nothing counts as lost; other columns
    are ignored.
    """
    filters = FILTERS if filters is None else filters
    return interactions(cells(masks(docs, filters, part), labels), [*filters, REPEATED])


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
f AS (
  SELECT doc_id, part,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d),
m AS (
  SELECT part, fails, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND toxic = 1) AS toxic FROM f),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT part, p, k, p[k] AS i, n, good, toxic, fails, fails[p[k]] AS own,
         len(list_filter(p[1:k - 1], lambda j: fails[j])) > 0 AS before
  FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (
  SELECT part, p, k, i, coalesce(sum(n) FILTER (NOT own AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT before), 0) AS removed,
         coalesce(sum(n) FILTER (own AND before), 0) AS redundant,
         coalesce(sum(n) FILTER (own AND len(list_filter(fails, lambda y: y)) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (own AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT before), 0) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, array_to_string(list_transform(p, lambda j: 'ABCDE'[j]), '') AS filter_order, k::INT AS step, kept::BIGINT AS kept,
       removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM r
"""
