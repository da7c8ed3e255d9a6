"""Interaction audit of document filters by multilinear extensions.

A document that fails a set m of filters is removed by every set of filters that meets m. So the number of documents that a
set removes is, with one variable in [0, 1] for each filter, the polynomial

    f(x) = sum over m of count(m) * (1 - product over i in m of (1 - x_i)),

which is linear in every variable. ``polynomials`` forms its coefficients for each part of the corpus from the counts of masks:
at most 2 ** k numbers, whatever the part's size. Its value at a corner is what the filters of that corner remove together
(``corners``), and the integral of its i-th partial derivative along the diagonal is the Shapley value of filter i
(``shapley``), an exact fraction that is scaled by k! to a whole number: what the filter removes, summed over all orders.

Documents are counted by Spark, with sums taken before the shuffle; all that follows has a row per part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .mixing import WORD

#: Filters that an audit may have: k! orders and 2 ** k masks are listed for each part.
MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that look at a text alone, by letter. Null counts as an empty text; an empty text has no words.

    A: fewer than 50 words. B: fewer than 65 % of the words are distinct (case counts). C: more than 5 % of the code
    points are A-Z. D: holds one of #$%&*|.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, by_text: dict[str, Column] | None = None, repeated: str = "E", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic): a row per document; bit i of ``mask`` is set if it fails the i-th filter.

    The filters are those of ``by_text`` (default: ``text_failures``) and, last, ``repeated``: identical to the text of any smaller
    doc_id of the table. Rows that repeat a doc_id with its text are documents of their own and do not make each other fail; null
    doc_ids have no order, so they neither fail that filter nor make others fail it, and have no labels. Labels may repeat
    a doc_id: it is good (toxic) if some row says so. Null parts are the empty part. Other columns are ignored, whatever their names.

    Texts are read once and reduced to a digest; a document is then looked up by its own id among the smallest ids of
    all digests, so many copies of a text never meet in one task.
    """
    by_text = text_failures(F.col("text")) if by_text is None else by_text
    if len(by_text) + 1 > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(by_text.values())]
    mask = F.lit(0)
    for b in bits:
        mask = mask.bitwiseOR(b)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    slim = materialise(docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), mask.cast("int").alias("mask"), digest.alias("digest")))
    named = slim.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).cast("long").alias("good" if c == "quality" else c)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    looked = named.join(first, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
    last = F.when(F.col("first").isNull(), 1 << len(by_text)).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = looked.select("part", F.col("mask").bitwiseOR(last).alias("mask"), zero("good"), zero("toxic"))
    return out.unionByName(slim.where("doc_id is null").select("part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")))


def mask_counts(failed: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) from ``failures``: at most 2 ** k rows for each part."""
    return failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def polynomials(counts: DataFrame, k: int, measures: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """(part, all_<measure>..., p_<measure>...): the whole count of each part and the coefficients of its removal polynomials.

    Entry T of an array is the coefficient of the product of the variables in T: plus or minus the documents that fail all of T,
    by whether T's size is odd or even; the empty product has none.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("by_mask"), *[F.sum(m).alias(f"all_{m}") for m in measures])
    coefficient = (
        f"transform(sequence(0, {2**k - 1}), t -> if(t = 0, 0L, if(bit_count(t) % 2 = 1, 1L, -1L)"
        " * aggregate(by_mask, 0L, (a, x) -> a + if((x.mask & t) = t, x.{0}, 0L))))"
    )
    return parts.select("part", *[f"all_{m}" for m in measures], *[F.expr(coefficient.replace("{0}", m)).alias(f"p_{m}") for m in measures])


def corners(polynomial: str, k: int) -> Column:
    """The polynomial's value at every corner: entry S is what the filters of S remove together."""
    every = f"sequence(0, {2**k - 1})"
    return F.expr(f"transform({every}, s -> aggregate({every}, 0L, (a, t) -> a + if((t & s) = t, {polynomial}[t], 0L)))")


def shapley(polynomial: str, k: int) -> Column:
    """k! times the Shapley value of each filter.

    On the diagonal the i-th partial derivative is the polynomial in t whose coefficient of t ** (d - 1) is the sum over all
    products of d variables that hold i; its integral over [0, 1] is the sum of coefficient / d. Fractions are held as
    numerators over the least common multiple of 1..k, so nothing is rounded.
    """
    below = lcm(*range(1, k + 1))
    of_size = f"aggregate(sequence(0, {2**k - 1}), 0L, (b, t) -> b + if((t & shiftleft(1, i)) <> 0 and bit_count(t) = d, {polynomial}[t], 0L))"
    numerator = f"aggregate(sequence(1, {k}), 0L, (a, d) -> a + ({below}L div d) * {of_size})"
    return F.expr(f"transform(sequence(0, {k - 1}), i -> ({numerator}) * {factorial(k)}L div {below}L)")


def report(counts: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step of that order, from ``mask_counts``.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): documents kept after the step, removed in it,
    failing its filter but removed before, failing its filter alone, good and toxic ones removed in it, and what its filter
    removes summed over all orders. Parts without rows have none; counts that do not occur are 0.
    """
    k = len(letters)
    if not 0 < k <= MOST_FILTERS or len(set(letters)) < k:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different letters")
    parts = materialise(polynomials(counts, k))  # a row per part; the optimizer would form the coefficients anew for each corner
    parts = parts.select("part", "all_n", shapley("p_n", k).alias("worth"), *[corners(f"p_{m}", k).alias(f"v_{m}") for m in ("n", "good", "toxic")])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit = f"shiftleft(1, instr('{letters}', substr(filter_order, {{0}}, 1)) - 1)"
    before = F.expr(f"aggregate(if(step = 1, array(), sequence(1, step - 1)), 0, (a, j) -> a | {bit.replace('{0}', 'j')})")
    placed = steps.withColumn("before", before).withColumn("own", F.expr(bit.replace("{0}", "step"))).withColumn("after", F.expr("before | own"))
    gain = lambda m: F.expr(f"v_{m}[after] - v_{m}[before]")
    return placed.select(
        "part", "filter_order", "step", F.expr("all_n - v_n[after]").alias("kept"), gain("n").alias("removed"), F.expr("v_n[own] - (v_n[after] - v_n[before])").alias("redundant"),
        F.expr(f"v_n[{2**k - 1}] - v_n[{2**k - 1} ^ own]").alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        F.expr(f"worth[instr('{letters}', substr(filter_order, step, 1)) - 1]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``report`` of the five filters A to E (see ``failures``) over whole documents, for each source."""
    return report(mask_counts(failures(docs, labels)), "ABCDE")
