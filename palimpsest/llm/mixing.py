"""Mixing sources to target weights along a training run, with weights that change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .sharding import positions

#: Rows that share a bucket of a source, and buckets that share a group of them, on average; running sums are within each.
PER_BUCKET, PER_GROUP = 2_000, 1_000
WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources(key, source_size) with w, target and slope.

    Targets share the total by weight, none above `most` times its source: sources that the level of the rest would lift
    over their cap are capped, which raises the level, until none is left. Each round is an aggregate over the sources.
    """
    turn = F.pmod("__position", F.lit(len(weights))).cast("int")
    ranked = positions(sources.select("key", "source_size"), ["key"]).withColumn("turn", turn).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1))
    ranked = cut(ranked.select("key", "source_size", "turn", "w", (F.col("source_size") * most).alias("cap")), "sources")
    whole = ranked.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w")).first()
    total, free, capped = whole["total"] or 0, whole["w"] or 0, 0
    level = total / free if free else 0.0
    while free:
        over = ranked.where(F.col("cap").cast("double") / F.col("w") < level).agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).first()
        if (over["cap"] or 0) == capped:
            break
        capped, free = over["cap"], whole["w"] - over["w"]
        level = (total - capped) / free if free else level
    slope = (F.col("turn") - F.lit((len(weights) - 1) / 2)) / F.lit(max(1, len(weights) - 1))
    return ranked.select("key", "source_size", "w", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"), slope.cast("double").alias("slope"))


def moment(demand: Column, slope: Column) -> Column:
    """When a source has met this share of its demand: t with t + slope * (t * t - t) = demand.

    The weight of a source at time t in [0, 1) is its mean weight times 1 + slope * (2t - 1), whose integral that is.
    """
    b = 1 - slope
    return F.when(slope == 0, demand).otherwise((F.sqrt(b * b + 4 * slope * demand) - b) / (2 * slope)) + F.lit(0.0)


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs with __size, __source_size, __target, __take (the source's words in the mix), __before, __taken and __slope.

    A source's documents stand in the order of the MD5 of their ids; the mix takes that stream again and again up to
    the target, so a document is taken as often as the stream passes it, at the end in part. Running sums are split by
    the first bits of the MD5, so a source of any share is summed by many tasks; sums of buckets, and of groups of buckets,
    are summed in turn.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    buckets = max(1, docs.count() // PER_BUCKET)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumns({"__size": size, "__key": _key(F.col("source").cast("string")), "__order": order})
    rows = rows.withColumn("__bucket", F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    sums = cut(rows.groupBy(F.col("__key").alias("key"), F.col("__bucket").alias("bucket")).agg(F.sum("__size").alias("size")), "buckets")
    goal = cut(targets(sums.groupBy("key").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    before = Window.unboundedPreceding, -1
    sums = sums.withColumn("group", F.floor(F.col("bucket") / PER_GROUP).cast("int"))
    groups = sums.groupBy("key", "group").agg(F.sum("size").alias("all"))
    groups = groups.select("key", "group", F.coalesce(F.sum("all").over(Window.partitionBy("key").orderBy("group").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("key", "group").orderBy("bucket").rowsBetween(*before)), F.lit(0))
    sums = sums.withColumn("inside", inside).join(groups, ["key", "group"]).withColumn("ahead", F.col("base") + F.col("inside"))
    starts = cut(sums.join(goal, "key").select("key", "bucket", "ahead", "source_size", "target", "slope"), "starts")
    within = Window.partitionBy("__key", "__bucket").orderBy("__order", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    rows = rows.join(starts.toDF("__key", "__bucket", "__ahead", "__source_size", "__target", "__slope"), ["__key", "__bucket"])
    rows = rows.withColumn("__before", F.col("__ahead") + F.col("__within")).withColumn("__take", F.round("__target").cast("long"))
    whole = F.expr("case when __source_size > 0 then __take div __source_size else 0 end")
    rest = F.col("__take") - whole * F.col("__source_size")
    taken = whole * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__before")))
    return rows.withColumn("__taken", taken.cast("long")).drop("__key", "__bucket", "__order", "__within", "__ahead")


def schedule(docs: DataFrame, **args: object) -> DataFrame:
    """doc_id, size, source_size, target, taken, position and passes for each row of docs, range-sorted by position.

    position is the time in [0, 1) at which the mix first takes the document: its source's schedule is integrated, and
    its place in the source's demand inverted; null where nothing is taken. passes is how often it is begun.

    Null text: size 0, nothing taken. Null source: a source of its own. Null doc_ids stand together in the order.
    Repeated rows are documents of their own. Other columns are ignored; an empty table gives an empty result.
    """
    p = plan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), **args)
    at = F.when(F.col("__taken") > 0, moment(F.col("__before") / F.col("__take"), F.col("__slope")))
    out = p.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"), at.alias("position"), F.expr("case when __taken > 0 then ceil(__taken / __size) else 0 end").cast("long").alias("passes"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed(docs: DataFrame, **args: object) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, in the order of the positions; where the stream of its
    source ends within a document, the last copy ends after the words that are taken, its white space as it was.

    Null or wordless texts have no words to take and are left out; null sources, null ids, ties and repeated rows as in
    schedule. Texts of any length are taken whole but for that last copy. An empty table gives an empty result.
    """
    names = docs.columns
    p = plan(docs, **args).where("__taken > 0")
    p = p.withColumn("__pass", F.explode(F.expr("sequence(0L, (__taken - 1) div __size)")))
    p = p.withColumn("__at", moment((F.col("__before") + F.col("__pass") * F.col("__source_size")) / F.col("__take"), F.col("__slope")))
    words = F.least(F.col("__size"), F.col("__taken") - F.col("__pass") * F.col("__size"))
    text = F.col("text").cast("string")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), words.cast("int")), "")
    new = {"text": F.when(words < F.col("__size"), first).otherwise(text)}
    if "n_chars" in names:
        new["n_chars"] = F.when(words < F.col("__size"), F.length(first).cast("long")).otherwise(F.col("n_chars"))
    return p.repartitionByRange("__at", "doc_id").sortWithinPartitions("__at", "doc_id").withColumns(new).select(names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))
