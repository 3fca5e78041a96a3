"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document gets a virtual finish time: the tokens of its source up to and including it, in a shuffled order,
divided by the source's target. All documents then stand in one global order of finish times, cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, fresh, stored

#: A document is taken so many times at most.
MAX_REPEATS = 3
#: Weights of the sorted sources, repeating, unless the caller gives a table.
WEIGHT_CYCLE = (1, 2, 3)
#: Running sums are made in two steps, inside buckets and over buckets. Buckets are prefixes of the shuffle hash, so
#: their number changes no result: 16 ** digits of them, each with at most about this many rows.
BUCKET_ROWS, LEAST_DIGITS = 100_000, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to rows with ``weight`` and ``source_size``: shares of all sizes, none above cap x source_size.

    Resharing the excess until no source is above its cap comes to one level: with the sources in order of size /
    weight, those whose capacity lies below level x weight stop there and all later ones get level x weight.
    """
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    rows = sources.withColumn("_cap", F.col("source_size") * cap)
    rows = rows.withColumn("_left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_weight", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_open", F.col("_cap") * F.col("_weight") > F.col("_left") * F.col("weight"))
    level = F.first(F.when(F.col("_open"), F.struct("_left", "_weight")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_level", level)
    share = (F.col("weight") * F.col("_level._left")).cast("double") / F.col("_level._weight")
    return rows.withColumn("target", F.when(F.col("_open"), share).otherwise(F.col("_cap").cast("double"))).select(*sources.columns, "target")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row, 0 to ``repeats``).

    ``weights``: (source, weight), positive integers; a source it lacks gets nothing. Without it the sources, by code
    point and null last, weigh as WEIGHT_CYCLE says. ``size``: tokens of a row, by default its words.

    The order inside a source is by md5 of seed and id, so reruns agree. The mix ends before the first row that would
    take it over the total; all rows are taken whole.

    Edge cases: null text has size 0, and rows of size 0 are taken where their place lies inside the mix; a null
    source is a source of its own; null ids share one place in the shuffle, told apart by size; repeated rows count
    each, and which of several like rows the cut spares is open; an empty table gives an empty one; columns named
    like the four results are replaced, others pass through.
    """
    spark = docs.sparkSession
    results = ("size", "source_size", "target", "copies")
    measured = word_count(F.col(text_col)) if size is None else size.cast("long")
    own = [c for c in docs.columns if c.lower() not in results]
    src, order, bucket, run, finish, begin, id_ = fresh(docs, "_src", "_order", "_bucket", "_run", "_finish", "_begin", "_id")
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  never null, so that joins are plain equi-joins
    rows = docs.select(*own, measured.alias("size"), key(F.col(source_col)).alias(src), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(id_))
    # Sizes and places are worked out once; every later step reads them from this table.
    rows = stored(rows.withColumn(order, F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_)))), "mix-rows")
    digits, n_rows = LEAST_DIGITS, rows.count()
    while 16**digits * BUCKET_ROWS < n_rows:
        digits += 1
    rows = rows.withColumn(bucket, F.substring(order, 1, digits))

    # Sources x buckets and sources: small tables, combined before they shuffle.
    sums = rows.groupBy(F.col(src).alias("src"), F.col(bucket).alias("bucket")).agg(F.sum("size").alias("n"))
    sources = sums.groupBy("src").agg(F.sum("n").alias("source_size"))
    if weights is None:
        place = F.row_number().over(Window.orderBy(F.col("src") == "", "src")) - 1
        sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHT_CYCLE)), (place % len(WEIGHT_CYCLE) + 1).cast("int")).cast("long"))
    else:
        sources = sources.join(weights.select(key(F.col("source")).alias("src"), F.col("weight").cast("long").alias("weight")), "src")
    starts = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sums.select("src", "bucket", starts.alias(begin)).join(source_targets(sources, repeats).drop("weight"), "src", "left")
    places = places.withColumnsRenamed({"src": src, "bucket": bucket})

    # Virtual finish times, one for each time a document may be taken.
    rows = rows.withColumn(run, F.sum("size").over(Window.partitionBy(src, bucket).orderBy(order, id_, "size").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(places, [src, bucket]).withColumn("target", F.coalesce("target", F.lit(0.0)))
    passes = F.least(F.lit(repeats), F.ceil(F.col("target") / F.col("source_size"))).cast("int")
    times = F.transform(F.sequence(F.lit(0), passes - 1), lambda p: (p * F.col("source_size") + F.col(begin) + F.col(run)) / F.col("target"))
    rows = rows.withColumn(finish, F.when(passes > 0, times).otherwise(F.array().cast("array<double>")))

    # The global order in ranges of finish times: whole ranges before the budget's, and the rows of that range sorted.
    ranges = 4 * 16**digits
    queue = rows.select("size", src, order, id_, F.posexplode(finish).alias("pass", "t"))
    queue = queue.withColumn("range", F.least(F.floor(F.col("t") * ranges), F.lit(2 * ranges)).cast("long"))
    held = queue.groupBy("range").agg(F.sum("size").alias("n"))
    held = held.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    last = held.filter((F.col("before") <= budget) & (F.col("before") + F.col("n") > budget)).orderBy("range").first()
    place = lambda t, p: F.struct(t.alias("t"), F.col(src), p.alias("pass"), F.col(order), F.col(id_), F.col("size"))
    if last is None:
        taken = F.size(finish)
    else:
        inside = queue.filter(F.col("range") == last["range"]).withColumn("place", place(F.col("t"), F.col("pass")))
        inside = inside.withColumn("sum", F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
        end = inside.filter(F.col("sum") + last["before"] <= budget).agg(F.max("place").alias("end")).first()["end"]
        before = lambda t: F.least(F.floor(t * ranges), F.lit(2 * ranges)) < last["range"]
        if end is None:
            taken = F.size(F.filter(finish, before))
        else:
            bound = F.struct(F.lit(end["t"]).alias("t"), F.lit(end[1]).alias(src), F.lit(end["pass"]).alias("pass"), F.lit(end[3]).alias(order), F.lit(end[4]).alias(id_), F.lit(end["size"]).cast("long").alias("size"))
            taken = F.size(F.filter(F.transform(finish, lambda t, p: place(t, p)), lambda x: before(x["t"]) | (x <= bound)))
    return rows.select(*own, "size", "source_size", "target", taken.cast("long").alias("copies"))
