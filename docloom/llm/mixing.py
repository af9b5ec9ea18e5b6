"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Newton stops when every source is within this part of its target; the steps between two looks; the most looks.
TOLERANCE, STEPS, LOOKS = 1e-7, 4, 25
#: Rows that one task ranks among documents of the same source and size.
BUCKET_ROWS = 500
#: Pairs of source and size up to which they are broadcast; more are dealt out SALTS times each.
BROADCAST_PAIRS, SALTS = 200_000, 32
REPAIRS = 8


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def token_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (key, source, source_size) with ``target``: ``share`` of all tokens dealt out by weight.

    Weights repeat along the sources by code point, null last. No target is above ``most`` times its
    source; what is over is dealt out again until nothing is. The level of that filling comes from one
    pass along the sources by size for a unit of weight: one row for each source in one task.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("w", w).withColumn("top", most * F.col("source_size").cast("double"))
    fills = Window.orderBy(F.col("top") / F.col("w"), "place")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0.0))
    s = s.withColumn("level", (share * F.sum("source_size").over(whole) - gone("top")) / (F.sum("w").over(whole) - gone("w"))).withColumn("order", F.row_number().over(fills))
    s = s.withColumn("full", F.col("top") <= F.col("w") * F.col("level"))
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct("order", "level"))).over(whole)["level"])
    return s.select("key", "source", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.least("top", F.col("w") * F.col("level"))).alias("target"))


def _rate(most: int) -> Column:
    return F.when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("scale"))))


def solve_dual(hist: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``targets`` with the multiplier ``tilt`` of each source, its ``scale`` and ``full`` (rate ``most`` throughout).

    Of all rates r in [0, ``most``] that meet sum(size * r) = target, those closest in relative entropy
    to one copy of every document are min(most, exp(tilt * size / scale)). ``tilt`` is the root of the
    gradient of the convex dual. Each Newton step is one join and one pre-aggregated sum over the counts of
    documents by source and size; a bracket that provably holds the root takes over where the step leaves it.
    """
    scale = hist.groupBy("key").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = targets.join(scale, "key").withColumn("full", F.col("target") >= most * F.col("source_size").cast("double") * (1 - 1e-12))
    lowest = F.when(F.col("full"), 0.0).otherwise(F.least(F.lit(0.0), F.col("scale") * F.log(F.col("target") / F.col("source_size"))))
    state = cut(state.select("*", F.lit(0.0).alias("tilt"), lowest.alias("low"), (F.col("scale") * math.log(most)).alias("high"), F.lit(1.0).alias("off")))
    for _ in range(LOOKS):
        for _ in range(STEPS):
            r, x = _rate(most), F.col("size") / F.col("scale")
            met = hist.join(state.select("key", "tilt", "scale", "full"), "key").groupBy("key").agg(
                F.sum(F.col("n") * F.col("size") * r).alias("f"),
                F.sum(F.when(r < most, F.col("n") * F.col("size") * r * x).otherwise(0.0)).alias("slope"),
            )
            at = state.join(met, "key").withColumn("off", F.when(F.col("full"), 0.0).otherwise(F.abs(F.col("f") / F.col("target") - 1)))
            at = at.withColumn("low", F.when(F.col("f") < F.col("target"), F.greatest("low", "tilt")).otherwise(F.col("low")))
            at = at.withColumn("high", F.when(F.col("f") > F.col("target"), F.least("high", "tilt")).otherwise(F.col("high")))
            step = F.col("tilt") - (F.col("f") - F.col("target")) / F.nullif("slope", F.lit(0.0))
            step = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
            state = at.withColumn("tilt", F.when(F.col("full") | (F.col("off") < TOLERANCE), F.col("tilt")).otherwise(step)).select(state.columns)
        state = cut(state)
        if not state.where(F.col("off") >= TOLERANCE).head(1):
            break
    # the last bits of a sum follow the order in which tasks end; no rate may
    return state.select("key", "source", "source_size", "target", F.round("tilt", 9).alias("tilt"), "scale", "full")


def round_rates(hist: DataFrame, dual: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(key, size, n, base, extra): all n documents get ``base`` copies and ``extra`` of them one more.

    Fractions carry along the sizes of a source, largest first; what is then left of the target goes to
    the largest sizes that fit it, a few times over. Rows here are source and size pairs, whose number is
    bounded by the sources times the longest document, not by the documents.
    """
    own = Window.partitionBy("key")
    falls = own.orderBy(F.desc("size"))
    h = hist.join(dual, "key").withColumn("rate", _rate(most)).withColumn("base", F.floor("rate"))
    h = h.withColumn("run", F.sum(F.col("n") * (F.col("rate") - F.col("base"))).over(falls.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("c", F.least(most * F.col("n"), F.col("n") * F.col("base") + F.floor(F.col("run") + 0.5) - F.floor(F.coalesce(F.lag("run").over(falls), F.lit(0.0)) + 0.5)))
    for _ in range(REPAIRS):
        h = h.withColumn("left", F.col("target") - F.sum(F.col("c") * F.col("size")).over(own))
        room = F.when(F.col("left") > 0, most * F.col("n") - F.col("c")).otherwise(F.col("c"))
        h = h.withColumn("pick", F.max(F.when((room > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("left")), F.col("size"))).over(own))
        some = F.least(room, F.floor(F.abs("left") / F.col("size")))
        h = h.withColumn("c", F.col("c") + F.when(F.col("size") == F.col("pick"), F.signum("left").cast("long") * some).otherwise(0))
    base = F.floor(F.col("c") / F.col("n"))
    return h.select("key", "size", "n", "source_size", "target", "rate", base.alias("base"), (F.col("c") - F.col("n") * base).alias("extra"))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """How many copies of each document the mix takes.

    One row for each distinct (id, source, text): id, key, source, text_hash, rows (how many such rows
    there are), size (words of one of them), source_size, target, rate and copies (0 to ``most``, for
    each of those rows). Sources get ``share`` of all words by ``weights`` (see token_targets). Rates solve the
    entropy balancing dual; documents of one source and size differ only in a hash of id and text, by
    which the copies that the rounding allows are given, so reruns agree.

    Null and empty texts have size 0 and count for nothing (they keep the copies their rate gives); null
    sources are one source, the last; null ids are ids like any other; an empty table gives none.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("key"),
        F.col(source_col).alias("source"),
        F.xxhash64(text_col).alias("text_hash"),
        size_of(F.col(text_col)).alias("words"),
    )
    units = cut(rows.groupBy("id", "key", "source", "text_hash", "words").agg(F.count("*").alias("rows")).withColumn("size", F.col("words") * F.col("rows")))
    hist = cut(units.groupBy("key", "size").agg(F.count("*").alias("n")))
    sizes = units.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    dual = solve_dual(hist, token_targets(sizes, weights, share, most), most)
    chosen = round_rates(hist, dual, most)
    u = units.withColumn("draw", F.shiftrightunsigned(F.xxhash64("id", "text_hash", "size"), 1))
    if hist.count() <= BROADCAST_PAIRS:
        u = u.join(F.broadcast(chosen), ["key", "size"])
    else:  # a source and size that many documents share is met in SALTS tasks
        salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        u = u.withColumn("salt", (F.col("draw") % SALTS).cast("int")).join(salted, ["key", "size", "salt"]).drop("salt")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    u = u.withColumn("bucket", F.least(buckets - 1, F.floor(F.col("draw") / float(2**63) * buckets)).cast("long"))
    along = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = u.where(F.col("n") > BUCKET_ROWS).groupBy("key", "size", "bucket").agg(F.count("*").alias("here"))
    ahead = ahead.select("key", "size", "bucket", F.coalesce(F.sum("here").over(along), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("draw", "id", "text_hash"))
    u = u.withColumn("place", place).join(ahead, ["key", "size", "bucket"], "left")
    more = (F.col("place") + F.coalesce("ahead", F.lit(0)) <= F.col("extra")).cast("long")
    return u.select("id", "key", "source", "text_hash", "rows", F.col("words").alias("size"), "source_size", "target", "rate", (F.col("base") + more).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as mixed: each row as often as mixing_plan says, or not at all."""
    plan = mixing_plan(docs, id_col, source_col, text_col, **options)
    plan = plan.where(F.col("copies") > 0).select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), F.col("copies").alias("__copies"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (key == F.col("__key")) & (F.xxhash64(text_col) == F.col("__hash"))
    out = docs.join(plan.hint("shuffle_hash"), on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    each = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate")
