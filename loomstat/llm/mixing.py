"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Each document gets a rate r >= 0, how often the mix takes it. Among all rates that meet the token constraints
sum(r * size) = target, one for each source, balancing takes those of least relative entropy sum(r ln r - r + 1) to the unweighted corpus. The
dual is convex with one multiplier for each constraint, and its solution tilts the documents exponentially: r = exp(lambda * size), held to the box
[0, most]. Newton steps for lambda each take one distributed aggregate, the gradient and the curvature of every source, over the table of
(source, size) counts; a bracket holds the steps, as the box leaves corners. Rates are then rounded into whole copies.

Targets: sources by code point, null last, weigh `weights` in turn and share all tokens; a target above `most` times its
source's size stays there, and the others share the excess by weight.

Rounding: within a source, documents stand in a fixed order, long ones first, and a document gets as many copies as whole numbers
lie in its stretch of the running sum of rates (whole numbers of 2^-24, so that sums are exact in any order). The copies of any
run of documents are within one of their rates' sum; as similar sizes stand together, the words taken are off by one long document at most. Some
documents of each size, a bounded number for each source, then take one copy more or less, the longest that fit first, until no more of the difference can go.

Running sums come from cells (source, size class, salt): sums of cells are summed up over the small table of cells, and only the rows of a cell are
sorted together, so that a source with a third of all rows is dealt over many tasks. Salts follow the number of rows.

Defined results: null and empty texts have size 0 and take 0; a source without words has target 0; a null source is one
source; rows with equal ids and texts are separate documents. docs is read more than once and must give the same rows. Other columns stay
unread; those of `keep` may not be named like the result's columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, stored

WEIGHTS, MOST, SALTS, ROWS, STEPS, TOLERANCE, PHASE = (1, 2, 3), 3, 16, 2_000_000, 80, 1e-11, 0.41421356
UNIT, AT_ONCE, FEW = 24, 4, 100_000
RESULT = ("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also target. A row for each source: windows over it hold sums, not documents.

    A source is at its bound when the rate by weight is above it; in the order of bound over weight those are a prefix."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1).cast("long"))
    weighed = weighed.withColumn("bound", F.col("source_size") * most)
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    weighed = weighed.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    weighed = weighed.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    capped = F.col("bound") * F.col("left_weight") < F.col("left") * F.col("weight")
    weighed = weighed.withColumn("capped", capped)
    # what the others share: the state of the first source that isn't capped
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source", "left", "left_weight"))).over(every)
    weighed = weighed.withColumn("first", first)
    target = F.when(F.col("capped"), F.col("bound").cast("double")).otherwise(F.col("weight") * F.col("first.left").cast("double") / F.col("first.left_weight"))
    return weighed.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def balanced_rates(sizes: DataFrame, targets: DataFrame, steps: int = STEPS, most: int = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds tilt, the lambda of each source's token constraint (null where nothing is taken). sizes: source, size, docs, a row for each size of a source.

    The taken words grow with lambda: at 0 they are the source's size, at ln(most) a document of one word and all longer ones reach the box, and at
    ln(target / size) they are below the target. That brackets the root; a Newton step that leaves the bracket becomes its middle."""
    size, target, most_log = F.col("source_size").cast("double"), F.col("target"), F.lit(math.log(most))
    state = targets.where((size > 0) & (target > 0)).select(
        F.col("source").alias("s"), target, F.when(target < size, F.log(target / size)).otherwise(0.0).alias("lo"), F.when(target < size, F.lit(0.0)).otherwise(most_log).alias("hi"),
        F.when(target >= size * (most * (1 - 1e-12)), most_log).otherwise(0.0).alias("tilt"), F.lit(1.0).alias("off"),
    )
    state, words = stored(state, "tilts"), F.col("docs") * F.col("size").cast("double")
    for _ in range(-(-steps // AT_ONCE)):
        now = state
        for _ in range(AT_ONCE):
            rate = F.exp(F.col("tilt") * F.col("size"))
            boxed = rate >= most
            grown = sizes.join(now, F.col("source").eqNullSafe(F.col("s"))).groupBy("s", "target", "lo", "hi", "tilt")
            grown = grown.agg(F.sum(words * F.least(rate, F.lit(float(most)))).alias("taken"), F.sum(F.when(boxed, 0.0).otherwise(words * F.col("size") * rate)).alias("slope"))
            over = F.col("taken") - target
            lo, hi = F.when(over < 0, F.greatest("lo", "tilt")).otherwise(F.col("lo")), F.when(over > 0, F.least("hi", "tilt")).otherwise(F.col("hi"))
            grown = grown.select("s", "target", lo.alias("lo"), hi.alias("hi"), "tilt", over.alias("over"), "slope", (F.abs(over) / target).alias("off"))
            newton = F.col("tilt") - F.try_divide(F.col("over"), F.col("slope"))
            middle = (F.col("lo") + F.col("hi")) / 2
            inside = (newton > F.col("lo")) & (newton < F.col("hi"))
            now = grown.select("s", "target", "lo", "hi", F.when(F.col("off") <= tolerance, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"), "off")
        before, state = state, stored(now, "tilts")
        discard(before)
        # sums of doubles may end otherwise in another order, hence the tolerance; corners are found by the bracket's width
        left = state.where((F.col("off") > tolerance) & (F.col("hi") - F.col("lo") > 1e-15)).limit(1).count()
        if not left:
            break
    # digits that the order of a sum can change are cut off, so that reruns agree
    found = state.select("s", F.round("tilt", 13).alias("tilt"))
    return targets.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mixed(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, most: int = MOST, salts: int = SALTS, named_source: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for each row; keep: more columns of docs; named_source: source too."""
    if clash := {c.lower() for c in keep} & set(RESULT):
        raise ValueError(f"columns to keep are named like the result's: {sorted(clash)}")
    # four leading bits of the size: classes an eighth of an octave wide
    measured = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark"), *keep)
    measured = measured.withColumn("bits", F.length(F.bin("size")).cast("int")).withColumn("class", F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))"))
    sized = stored(measured.select("source", "size", "bits", "class", "mark"), "sizes")
    rows = sized.count()
    salt = F.pmod("mark", F.lit(max(salts, -(-rows // ROWS)))).cast("int")
    counted = sized.groupBy("source", "size", "bits", "class", salt.alias("salt")).agg(F.count(F.lit(1)).alias("docs"))
    counted = stored(counted, "counts")
    discard(sized)
    sizes = stored(counted.where("size > 0").groupBy("source", "size").agg(F.sum("docs").alias("docs")), "counts")
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    rates = stored(balanced_rates(sizes, stored(source_targets(totals, weights, most), "targets"), most=most), "rates")
    rate = F.when(F.col("tilt").isNull() | (F.col("size") == 0), F.lit(0.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size"))))
    units = F.round(rate * (1 << UNIT)).cast("long")
    named = rates.select(F.col("source").alias("s"), "source_size", "target", "tilt")
    cell = ["source", "bits", "class", "salt"]
    below = Window.partitionBy("source").orderBy(F.desc("bits"), F.desc("class"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.join(named, F.col("source").eqNullSafe(F.col("s"))).groupBy(*cell, "source_size", "target", "tilt").agg(F.sum(F.col("docs") * units).alias("units"))
    cells = cells.select(*[F.col(c).alias(f"c_{c}") for c in cell], "source_size", "target", "tilt", F.coalesce(F.sum("units").over(below), F.lit(0)).alias("before"))
    mine = Window.partitionBy(*cell).orderBy(F.desc("size"), F.col("doc_id").asc_nulls_first(), "mark")
    placed = measured.withColumn("salt", salt).withColumn("place", F.row_number().over(mine))
    placed = placed.join(cells, [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in cell]).withColumn("rate", rate).withColumn("units", units)
    upto = F.col("before") + F.sum("units").over(mine.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(int(PHASE * (1 << UNIT)))
    copies = F.shiftright(upto, UNIT) - F.shiftright(upto - F.col("units"), UNIT)
    placed = placed.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(most), copies)).cast("long"))
    placed = stored(placed.select("doc_id", *keep, *cell, "place", "size", "source_size", "target", "rate", "copies"), "placed")
    changed = _changes(placed, cell, most)
    changed = F.broadcast(changed) if changed.count() <= FEW else changed
    out = placed.join(changed, [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in cell] + [F.col("place") == F.col("x_place")], "left")
    out = out.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", *keep, *(["source"] if named_source else []), "size", "source_size", "target", "rate", "copies").withColumn("taken", F.col("size") * F.col("copies"))


def _changes(placed: DataFrame, cell: list[str], most: int) -> DataFrame:
    """x_source.., x_place, more: the rows whose copies change by one so that their source's words come closer to its target.

    Two rows of each size class in sixteen salts may change, so a source's list is bounded by the number of size classes. It is gone through from the
    longest on, and each row that still fits into the difference is taken."""
    off = placed.groupBy("source").agg(F.round(F.first("target") - F.sum(F.col("size") * F.col("copies"))).cast("long").alias("off")).where("off <> 0")
    off = off.select(F.col("source").alias("s"), "off")
    few = placed.where("size > 0 AND place <= 2 AND salt < 16 AND rate > 0").select(*cell, "place", "size", "copies").join(off, F.col("source").eqNullSafe(F.col("s")))
    few = few.where(((F.col("off") > 0) & (F.col("copies") < most)) | ((F.col("off") < 0) & (F.col("copies") > 0)))
    lists = few.groupBy("source", "off").agg(F.sort_array(F.collect_list(F.struct("size", "bits", "class", "salt", "place")), asc=False).alias("rows"))
    none = F.filter("rows", lambda x: F.lit(False))

    def take(state: Column, x: Column) -> Column:
        fits = x["size"] <= state["left"]
        return F.struct(F.when(fits, state["left"] - x["size"]).otherwise(state["left"]).alias("left"), F.when(fits, F.concat(state["picked"], F.array(x))).otherwise(state["picked"]).alias("picked"))

    start = F.struct(F.abs("off").alias("left"), none.alias("picked"))
    picked = lists.select("source", F.signum("off").cast("long").alias("more"), F.explode(F.aggregate("rows", start, take)["picked"]).alias("x"))
    picked = picked.select(F.col("source").alias("x_source"), *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("bits", "class", "salt", "place")], "more")
    return stored(picked, "changes")
