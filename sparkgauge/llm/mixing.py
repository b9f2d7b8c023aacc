"""Mixing sources to target weights by entropy balancing.

The mix gives each document d a rate r(d), the number of times it is taken.  Among all
rates between 0 and ``MAX_COPIES`` whose tokens add up to the target of a source, those nearest to 1 in entropy (the sum over
documents of r log r - r) have the form ``min(MAX_COPIES, exp(a size))``: they are tilted exponentially along the
document's tokens.  A source that must grow takes more of its long documents, one that must shrink fewer.
The multiplier ``a`` of each source solves a convex dual; Newton steps for all
sources at once run over the whole table.  They go on the logarithms of the tokens taken and of x, where a = log(target / size) / x: x lies between
the source's shortest and longest document, a bracket that only narrows.  Tokens are first added up by (source, size), which loses nothing.

Rates are then rounded to whole copies: a document gets the floor of its rate, and those
whose fixed random number is lowest against their fraction get one more, up to the exact
place where the source's target is reached.  What is left below the target there is filled by
the largest documents that fit, until none does; where the document at that place comes nearer to the target, it is taken instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, word_count

#: No document is taken more often; a source's target stops at this many times its size.
MAX_COPIES = 3
#: Weights of sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A step that does not halve the miss is followed by one that halves the bracket, so that so many are enough for any table.
NEWTON_STEPS = 250
TOLERANCE = 1e-9
#: Cells of the random number in which the border of rounding is searched.
CELLS = 4096


def source_key(source: Column) -> Column:
    """A key whose order is that of code points, null last."""
    return F.concat(F.when(source.isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(source, F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``k, source_size`` -> with ``target``: shares of all sizes by weight, none above ``most`` sizes.

    With sources ordered by room per weight, those that stop are a prefix, and the level
    (target per weight of the others) is the largest that any prefix gives.  One row a source.
    """
    by_key = Window.orderBy("k")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("room", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("room") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("room").over(before), zero)) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero)
    )
    return (
        rows.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least("room", F.col("w") * F.col("level")))
        .select("k", "source_size", "target")
    )


def solve_dual(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``k, source_size, target, a``: the multiplier of each source.

    ``cells``: ``k, size, n`` (documents of that size).  ``targets``: ``k, source_size, target``.
    A source whose target is ``MAX_COPIES`` sizes has no multiplier (null): all its rates are that.
    """
    tokens, size = F.col("n") * F.col("size").cast("double"), F.col("size").cast("double")
    ends = cells.filter("size > 0").groupBy("k").agg(F.min("size").alias("least"), F.max("size").alias("longest"), F.sum(tokens * size).alias("square"))
    full = F.col("target") >= MAX_COPIES * F.col("source_size").cast("double")
    slope = F.log(F.col("target") / F.col("source_size"))
    state = materialise(
        targets.join(ends, "k").filter(~full).select(
            "k", "source_size", "target", slope.alias("slope"),
            # no rate is above target / size if x is the shortest size, none below if x is the longest
            F.log(F.col("least").cast("double")).alias("low"), F.log(F.col("longest").cast("double")).alias("high"),
            # where x is if the multiplier is small
            F.log(F.col("square") / F.col("source_size")).alias("t"), F.lit(None).cast("double").alias("miss"), F.lit(False).alias("done"),
        ),
        "dual-0",
    )
    multiplier = F.col("slope") * F.exp(-F.col("t"))
    for step in range(1, NEWTON_STEPS + 1):
        rate = F.exp(multiplier * size)
        sums = (
            cells.join(state.filter(~F.col("done")), "k")
            .groupBy("k")
            .agg(F.sum(tokens * F.least(F.lit(float(MAX_COPIES)), rate)).alias("s"), F.sum(F.when(rate < MAX_COPIES, tokens * size * rate)).alias("h"))
        )
        off = F.col("s") - F.col("target")
        near = F.coalesce(F.abs(off) <= TOLERANCE * F.col("source_size"), F.col("done"))
        # rates come nearer to 1 with larger x
        further = (off < 0) == (F.col("slope") < 0)
        low, high = F.when(further, F.col("t")).otherwise(F.col("low")), F.when(further, F.col("high")).otherwise(F.col("t"))
        newton = F.col("t") + F.try_divide(F.col("s") * F.log(F.col("s") / F.col("target")), F.col("h") * multiplier)
        miss = F.abs(F.log(F.col("s") / F.col("target")))
        inside = (newton > low) & (newton < high) & F.coalesce(miss < F.col("miss") / 2, F.lit(True))
        move = F.when(inside, newton).otherwise((low + high) / 2)
        state = materialise(
            state.join(sums, "k", "left").select(
                "k", "source_size", "target", "slope",
                F.when(near, F.col("low")).otherwise(low).alias("low"), F.when(near, F.col("high")).otherwise(high).alias("high"),
                F.when(near, F.col("t")).otherwise(move).alias("t"), miss.alias("miss"), near.alias("done"),
            ),
            f"dual-{step}",
        )
        if state.filter(~F.col("done")).isEmpty():
            return targets.join(state.select("k", multiplier.alias("a")), "k", "left")
    raise ArithmeticError(f"multipliers not settled after {NEWTON_STEPS} steps")


def _with_rounding(rows: DataFrame) -> DataFrame:
    """``rate``, whole copies ``base``, and ``v``: one more copy goes to the lowest ``v``."""
    most = F.lit(float(MAX_COPIES))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("a").isNull(), most).otherwise(F.least(most, F.exp(F.col("a") * F.col("size"))))
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9))
    # no further copy where the rate is whole
    return rows.withColumn("v", F.when(F.col("rate") - F.col("base") > 1e-9, F.col("u") - (F.col("rate") - F.col("base"))))


def fill(free: pd.DataFrame) -> pd.DataFrame:
    """Of one source's ``size, again, gap`` the largest that fit: per size, the highest ``again`` taken and the tokens."""
    out, gap = [], float(free["gap"].iloc[0])
    size, again = free["size"].to_numpy(), free["again"].to_numpy()
    order = np.lexsort((again, -size))
    size, again = size[order], again[order]
    for at, end in zip(*(lambda b: (b, np.append(b[1:], len(size))))(np.flatnonzero(np.append(True, size[1:] != size[:-1]))), strict=True):
        # rows that are equal in their random number go together
        own, times = np.unique(again[at:end], return_counts=True)
        n = int(np.searchsorted(np.cumsum(times) * size[at], gap, side="right"))
        if n:
            out.append((free["k"].iloc[0], size[at], own[n - 1], int(times[:n].sum() * size[at])))
            gap -= out[-1][3]
    return pd.DataFrame(out, columns=["k", "size", "top", "tokens"])


def _numbered(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as one, so that no name can clash), ``k``, ``size``, and two fixed random numbers in [0, 1): ``u``, ``again``."""
    size = F.coalesce(word_count(F.col("text")), F.lit(0).cast("long"))
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), source_key(F.col("source").cast("string")).alias("k"), size.alias("size")
    )
    for name in ("u", "again"):
        mark = F.xxhash64(F.col("id"), F.col("k"), F.col("size"), F.lit(name))
        out = out.withColumn(name, F.shiftrightunsigned(mark, 11).cast("double") / float(1 << 53))
    return out.drop("id")


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """One row a source, all that decides how often a document is taken: ``k, source_size, target, a, cut, past, fills``.

    A document takes one more copy if ``v < cut`` (or ``v = cut`` where ``past``), or its ``again`` is at most the ``top`` that ``fills`` has for its size.
    """
    slim = materialise(_numbered(docs).select("k", "size", "u", "again"), "mix-sizes")
    cells = materialise(slim.groupBy("k", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    totals = cells.groupBy("k").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = materialise(solve_dual(cells, materialise(source_targets(totals, weights), "mix-targets")), "mix-rates")

    placed = _with_rounding(slim.join(solved, "k"))
    whole = placed.groupBy("k").agg(F.sum(F.col("base") * F.col("size")).alias("whole"))
    cell = F.floor((F.col("v") + 1.0) * (CELLS // 2))
    by_cell = placed.filter(F.col("v").isNotNull()).groupBy("k", cell.alias("cell")).agg(F.sum("size").alias("tokens"))
    need = F.col("target") - F.col("whole")
    upto = Window.partitionBy("k").orderBy("cell")
    # the first cell that passes the target; a source has CELLS rows at most here
    border = materialise(
        by_cell.join(solved.select("k", "target"), "k")
        .join(whole, "k")
        .withColumn("sum", F.sum("tokens").over(upto))
        .filter(F.col("sum") > need)
        .groupBy("k")
        .agg(F.min_by(F.struct("cell", (F.col("sum") - F.col("tokens")).alias("before"), need.alias("need")), "cell").alias("at"))
        .select("k", "at.*"),
        "mix-border",
    )
    # within that cell, the first document that passes it: it and those after get no more
    inside = (
        placed.join(border.withColumnRenamed("cell", "at_cell"), "k")
        .filter(cell == F.col("at_cell"))
        .withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("k").orderBy("v")))
    )
    cut = inside.groupBy("k").agg(
        F.min(F.when(F.col("sum") > F.col("need"), F.col("v"))).alias("cut"),
        F.max(F.when(F.col("sum") <= F.col("need"), F.col("sum"))).alias("got"),
        F.min(F.when(F.col("sum") > F.col("need"), F.col("sum") - F.col("need"))).alias("over"),
    )
    plan = materialise(
        solved.join(border, "k", "left").join(cut, "k", "left").select(
            "k", "source_size", "target", "a",
            # without a border every fraction is taken
            F.coalesce("cut", F.lit(2.0)).alias("cut"),
            F.coalesce(F.col("need") - F.coalesce("got", "before"), F.lit(0.0)).alias("gap"), "over",
        ),
        "mix-plan",
    )
    # the gap is below the size of the document at the border; of a size no more than gap / size documents can fill it, so
    # those with the lowest numbers, some more than that, are all that is looked at: gap x log(gap) rows a source at most
    free = _with_rounding(slim.join(plan, "k")).filter((F.col("v") >= F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    most = F.col("gap") / F.col("size")
    counts = free.groupBy("k", "size").agg(F.count(F.lit(1)).alias("n"))
    few = free.join(counts, ["k", "size"]).filter(F.col("again") * F.col("n") <= most + 6 * F.sqrt(most) + 12)
    filled = few.select("k", "size", "again", "gap").groupBy("k").applyInPandas(fill, "k string, size long, top double, tokens long")
    fills = filled.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("size", "top"))).alias("fills"), F.sum("tokens").alias("filled"))
    past = F.coalesce(F.col("over") < F.col("gap") - F.coalesce("filled", F.lit(0)), F.lit(False))
    plan = plan.join(fills, "k", "left").withColumn("past", past)
    return materialise(plan.select("k", "source_size", "target", "a", "cut", "past", F.when(~F.col("past"), F.col("fills")).alias("fills")), "mix-plan-filled")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, plan: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with ``size, source_size, target, rate, copies, taken``.

    Size is a text's number of words (null: 0), however long the text.  Sources by code point, null last, weigh
    ``weights`` in turn; targets share all sizes by weight, stopped at 3 sizes of a source.
    A null source is a source of its own.  Rows equal in doc_id, source and size are treated alike, so reruns
    agree and repeated rows are taken equally often (a tie that doesn't fit the target as a whole is left out); empty texts
    have rate 1 and take 0 words.  An empty table gives no rows.
    Further columns pass through, whatever their names; those named like one of the new columns give way to it.
    """
    plan = plan_mix(docs, weights) if plan is None else plan
    new = ("size", "source_size", "target", "rate", "copies", "taken")
    own = [c for c in docs.columns if c.lower() not in new]
    # the plan has a row a source; Spark broadcasts it if its written size is small, and splits hot sources if not
    rows = _with_rounding(_numbered(docs).join(plan, "k"))
    top = F.try_element_at("fills", F.col("size"))
    more = (F.col("v") < F.col("cut")) | F.col("past") & (F.col("v") == F.col("cut")) | F.coalesce(F.col("again") <= top, F.lit(False)) & (F.col("v") >= F.col("cut"))
    more = F.coalesce(more, F.lit(False))
    copies = (F.col("base") + more.cast("long")).cast("long")
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in own], "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, all its columns as they are.

    Nulls, empty and long texts, ties, repeated rows, empty tables and other columns as in ``mix``; a row of rate 0 goes.
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    taken = mix(whole, weights).filter(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
