"""Mixing sources to target weights by entropy balancing, and rounding rates into copies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.session import written

#: Most copies of a document, and the largest multiple of a source's size its target may be.
MOST = 3
#: Rows of one source and size are dealt over so many buckets.
BUCKETS = 64
#: Fractions of a copy are whole numbers of this part, so that sums do not depend on their order.
PART = 1 << 20
#: Newton steps, and the relative miss at which they end.
STEPS, CLOSE = 80, 1e-7

UNIT = ["__mix_source", "__mix_size", "__mix_bucket"]


def words(text: str) -> Column:
    """Runs of other than ASCII white space in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """``__mix_target`` words of each source: its weight's share of all words, at most 3 times its size.

    ``sources`` has one row for each ``__mix_source`` with ``source`` and ``__mix_source_size`` and must be
    a table. Sources take the weights in turn, by code point, null last. What the limit cuts off
    goes to the others by weight, until none is above: a source is at its limit if the level, the
    words for one unit of weight, would lift it there, and the level only rises from round to
    round. Only the level and sums come to the driver.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = sources.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    placed = written(placed, "sources")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").count()
    offsets = offsets.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    turn = F.col("__offset") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    ranked = placed.join(F.broadcast(offsets), "__part").withColumn("__weight", weight)
    ranked = written(ranked.drop("__part", "__offset"), "weights")
    limit = F.col("__mix_source_size") * MOST
    level = 0.0
    while True:
        full = limit < F.lit(level) * F.col("__weight")
        sums = ranked.agg(
            F.sum("__mix_source_size").alias("all"),
            F.sum(F.when(full, limit)).alias("full"),
            F.sum(F.when(~full, F.col("__weight"))).alias("open"),
        ).first()
        if not sums["all"] or not sums["open"]:
            break
        new = (sums["all"] - (sums["full"] or 0)) / sums["open"]
        if new <= level:
            break
        level = new
    return ranked.withColumn("__mix_target", F.least(limit.cast("double"), F.lit(level) * F.col("__weight"))).drop("__weight")


def tilts(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """``__mix_source``, ``mean`` and ``tilt``: rates are exp(tilt size / mean), at most ``MOST``.

    ``sizes`` counts documents ``n`` by ``__mix_source`` and ``__mix_size``; ``aims`` has the
    targets. Of all rates up to ``MOST`` that give a source its words, these are the nearest in
    entropy to one copy each. The dual has one unknown for each source; a Newton step is one sum
    over counts by size, combined before the shuffle, and one that leaves the bounds known so
    far is replaced by their middle. Sums are of whole numbers, so that they do not depend on
    their order and reruns agree. A source without words has no tilt.
    """
    totals = sizes.groupBy("__mix_source").agg(F.sum("n").alias("docs"))
    state = aims.join(totals, "__mix_source").filter("__mix_source_size > 0").select(
        "__mix_source",
        (F.col("__mix_source_size") / F.col("docs")).alias("mean"),
        F.col("__mix_target").alias("aim"),
        F.lit(0.0).alias("tilt"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
    )
    state = written(state, "dual")
    x = F.col("__mix_size") / F.col("mean")
    power = F.col("tilt") * x
    free = power < math.log(MOST)
    words = F.col("n") * F.col("__mix_size") * F.when(free, F.exp(power)).otherwise(F.lit(float(MOST)))
    whole = lambda c: F.sum(F.round(c * 1024).cast("decimal(38,0)")).cast("double") / 1024
    for _ in range(STEPS):
        sums = (
            sizes.join(state, "__mix_source")
            .select("__mix_source", words.alias("w"), F.when(free, words * x).otherwise(0.0).alias("d"))
            .groupBy("__mix_source").agg(whole(F.col("w")).alias("w"), whole(F.col("d")).alias("d"))
        )
        miss = F.col("w") - F.col("aim")
        found = state.join(sums, "__mix_source").withColumns(
            {
                "low": F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")),
                "high": F.when(miss >= 0, F.col("tilt")).otherwise(F.col("high")),
                "done": F.abs(miss) <= CLOSE * F.col("aim"),
                "newton": F.when(F.col("d") > 0, F.col("tilt") - miss / F.col("d")),
            }
        )
        # Where one bound is not known yet, steps away from it double.
        away = F.greatest(F.lit(1.0), F.abs("tilt"))
        middle = (
            F.when(F.col("high") == float("inf"), F.col("low") + away)
            .when(F.col("low") == float("-inf"), F.col("high") - away)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (F.col("newton") > F.greatest("low", F.col("tilt") - 4 * away)) & (
            F.col("newton") < F.least("high", F.col("tilt") + 4 * away)
        )
        following = F.when(F.col("done"), F.col("tilt")).when(inside, F.col("newton")).otherwise(middle)
        # Bounds that have met say that sums of this precision come no nearer.
        met = F.col("high") - F.col("low") <= 1e-12 * away
        state = found.select(
            "__mix_source", "mean", "aim", following.alias("tilt"), "low", "high", (F.col("done") | met).alias("done")
        )
        state = written(state, "dual")
        if state.filter(~F.col("done")).isEmpty():
            break
        state = state.drop("done")
    return state.select("__mix_source", "mean", "tilt")


def quotas(units: DataFrame, aims: DataFrame, corrections: int = 6) -> DataFrame:
    """Copies by unit: each document of a unit gets ``__mix_base``, and ``__mix_extra`` of them one more.

    Rates are rounded along each source's units in order of size: running sums of the fractions
    are rounded, so no run of units is off by more than half a document. The sums run over bins
    of sizes, then within a bin. What a source then still misses in words is made good by one
    document of about that size, again and again, at most ``corrections`` times or until every
    source is within a thousandth of its target.
    """
    sizes = written(units.groupBy("__mix_source", "__mix_size").agg(F.sum("n").alias("n")), "sizes")
    dual = tilts(sizes, aims)
    rate = F.exp(F.least(F.col("tilt") * (F.col("__mix_size") / F.col("mean")), F.lit(math.log(MOST))))
    # A source without words has no tilt; its documents stay as they are.
    parts = F.least(F.round(F.coalesce(rate, F.lit(1.0)) * PART), F.lit(MOST * PART)).cast("long")
    rated = units.join(dual, "__mix_source", "left").select(
        *UNIT, "n",
        F.floor(F.log2(F.col("__mix_size") + 1) * 16).alias("__bin"),
        F.floor(parts / PART).cast("long").alias("__mix_base"),
        (F.col("n") * (parts % PART)).alias("__parts"),
    )
    rated = written(rated, "rates")
    upto = Window.partitionBy("__mix_source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rated.groupBy("__mix_source", "__bin").agg(F.sum("__parts").alias("__sum"))
    bins = bins.select("__mix_source", "__bin", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__mix_source", "__bin").orderBy("__mix_size", "__mix_bucket")
    running = F.col("__before") + F.sum("__parts").over(within)
    half = PART // 2
    whole = lambda x: F.floor((x + half) / PART)
    extra = (whole(running) - whole(running - F.col("__parts"))).cast("long")
    done = rated.join(bins, ["__mix_source", "__bin"]).select(*UNIT, "n", "__mix_base", extra.alias("__mix_extra"))
    done = written(done, "quotas")
    for _ in range(corrections):
        took = done.groupBy("__mix_source").agg(
            F.sum(F.col("__mix_size") * (F.col("n") * F.col("__mix_base") + F.col("__mix_extra"))).alias("__took")
        )
        missing = aims.join(took, "__mix_source").select(
            "__mix_source", (F.col("__mix_target") - F.col("__took")).alias("__missing"), "__mix_target"
        )
        missing = written(missing, "missing")
        if missing.filter(F.abs("__missing") > 0.001 * F.col("__mix_target")).isEmpty():
            break
        done = written(_corrected(done, missing), "quotas")
    return done


def _corrected(done: DataFrame, missing: DataFrame) -> DataFrame:
    """Quotas with one document taken once more or less in each source that then misses fewer words."""
    gap = F.abs(F.abs("__missing") - F.col("__mix_size"))
    up = F.col("__missing") > 0
    most, none = F.col("__mix_base") >= MOST, (F.col("__mix_base") == 0) & (F.col("__mix_extra") == 0)
    better = done.join(missing, "__mix_source").filter(~F.when(up, most).otherwise(none) & (gap < F.abs("__missing")))
    fix = F.struct(gap.alias("gap"), "__mix_size", "__mix_bucket", F.when(up, 1).otherwise(-1).alias("by"))
    chosen = better.groupBy("__mix_source").agg(F.min(fix).alias("__fix"))
    fixes = chosen.select("__mix_source", "__fix.__mix_size", "__fix.__mix_bucket", "__fix.by")
    extra = F.col("__mix_extra") + F.coalesce("by", F.lit(0))
    # A unit whose documents all have one more has a higher base; one that has none to give lends from it.
    base = F.col("__mix_base") + F.when(extra >= F.col("n"), 1).when(extra < 0, -1).otherwise(0)
    extra = F.when(extra >= F.col("n"), extra - F.col("n")).when(extra < 0, extra + F.col("n")).otherwise(extra)
    return done.join(fixes, UNIT, "left").withColumns({"__mix_base": base, "__mix_extra": extra}).drop("by")


def _dealt(frame: DataFrame, keys: Sequence[str], text: str, source: str) -> DataFrame:
    """The frame with what the mix says of each row, in columns whose names begin with ``__mix_``."""
    hashed = F.xxhash64(*keys)
    sized = frame.withColumns(
        {
            "__mix_size": words(text),
            # A null source must not meet an empty one.
            "__mix_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
            "__mix_bucket": F.pmod(hashed, F.lit(BUCKETS)).cast("int"),
            "__mix_hash": hashed,
        }
    )
    units = written(sized.groupBy(*UNIT).agg(F.count("*").alias("n"), F.first(source).alias("source")), "units")
    sources = units.groupBy("__mix_source").agg(
        F.first("source").alias("source"), F.sum(F.col("__mix_size") * F.col("n")).alias("__mix_source_size")
    )
    aims = written(targets(written(sources, "sources")), "targets").drop("source")
    quota = quotas(units.drop("source"), aims).drop("n")
    dealt = sized.join(quota.hint("shuffle_hash"), UNIT)
    place = F.row_number().over(Window.partitionBy(*UNIT).orderBy("__mix_hash", *keys))
    copies = (F.col("__mix_base") + (place <= F.col("__mix_extra")).cast("long")).alias("__mix_copies")
    counted = dealt.select(*frame.columns, "__mix_source", "__mix_size", copies)
    return counted.join(aims, "__mix_source")


def mixed(frame: DataFrame, keys: Sequence[str], text: str = "text", source: str = "source") -> DataFrame:
    """The frame with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``copies`` (0 to 3) is how often the mix takes a document, ``taken`` its words times that.
    ``keys`` name the columns that tell rows apart; rows equal in them may change places. Rows
    are shuffled once, by source, size and a bucket of their keys, so a hot source or thousands
    of equal documents are spread. Null texts have size 0, a null source is a source of its own,
    an empty table has an empty mix. Columns of these names, in any letter case, are replaced;
    names that begin with ``__mix_`` are kept for this. The frame is read twice and must give the
    same rows both times.
    """
    fresh = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in frame.columns if c.lower() not in fresh]
    made = {name: F.col(f"__mix_{name}") for name in fresh[:-1]}
    made["taken"] = F.col("__mix_copies") * F.col("__mix_size")
    return _dealt(frame, keys, text, source).select(*kept, *(c.alias(name) for name, c in made.items()))


def repeated(frame: DataFrame, keys: Sequence[str], text: str = "text", source: str = "source") -> DataFrame:
    """The rows of a frame as often as the mix takes them, with all of their own columns as they are."""
    mix = _dealt(frame, keys, text, source)
    times = F.array_repeat(F.lit(0), F.col("__mix_copies").cast("int"))
    return mix.withColumn("__mix_copy", F.explode(times)).select(*frame.columns)
