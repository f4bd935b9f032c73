"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable, fresh, n_words

#: Hex digits of the MD5 that make the uniform number; 13 digits are 52 bits, exact in a double.
DIGITS = 13
#: First hex digits, by which ranks are summed up before the exact cut.
BUCKET_DIGITS = 3


def source_targets(sized: DataFrame, share: float = 1.0, max_epochs: float = 3.0, cycle: int = 3) -> DataFrame:
    """(source, size) rows -> one row per source: source, source_size, target.

    Sources in code point order, null last, weigh 1, 2, .., cycle and again. The budget is share of all sizes; a target
    stops at max_epochs times its source's size and the excess goes to the others by weight until none is above. The
    water level of that is found in closed form: with sources ordered by cap/weight, those below the level are capped.
    Works on one row per source, after the documents are summed up."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", ((F.row_number().over(by) - 1) % cycle + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    ranked = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = ranked.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("at", F.row_number().over(ranked))
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))),
    )
    # in order of ratio, sources are capped as long as the level that those before them leave is at or above their
    # own ratio; the first that is not fixes the level of all that follow
    free = F.when(F.col("level") < F.col("ratio"), F.struct("at", "level"))
    s = s.withColumn("water", F.min(free).over(every)["level"])
    level = F.coalesce(F.col("water"), F.lit(float("inf")))
    return s.select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.col("weight") * level)).alias("target"),
    )


def _ranked(docs: DataFrame, seed: str) -> DataFrame:
    """Adds certain (whole copies), p (the fraction left), odds (the rank) and slot (the rank's bucket)."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = (F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    d = docs.withColumn("certain", F.floor(due)).withColumn("p", due - F.floor(due))
    d = d.withColumn("odds", (u / (1 - u)) / F.when(F.col("p") > 0, F.col("p") / (1 - F.col("p"))))
    # the ranks mapped to 0..1, so that buckets are of like size
    return d.withColumn("slot", F.floor(F.col("odds") / (1 + F.col("odds")) * 16**BUCKET_DIGITS).cast("int"))


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(2**63 - 1))


def pareto_cut(docs: DataFrame, seed: str = "tessera") -> DataFrame:
    """Rows (doc_id, source, size, source_size, target) -> one row per source: source, rest (words left after certain
    copies), edge_slot (the bucket of ranks in which they run out) and the last rank and id that are taken in it.

    Ranks are summed into buckets first, at most 16**BUCKET_DIGITS for a source; only the rows of one bucket per source
    are put in order, so no source is sorted whole."""
    d = _ranked(docs.select("doc_id", "source", "size", "source_size", "target"), seed)
    sums = d.groupBy("source", "slot").agg(
        F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).alias("slot_size"),
        F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("t"),
    )
    whole = Window.partitionBy("source")
    before = whole.orderBy(F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    cut = durable(
        sums.withColumn("before", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
        .withColumn("rest", F.col("t") - F.sum("sure").over(whole))
        .select("source", "slot", "before", "slot_size", "rest"),
        "mix-slots",
    )
    edge = F.when((F.col("before") < F.col("rest")) & (F.col("before") + F.col("slot_size") >= F.col("rest")), F.struct("slot", "before"))
    marks = cut.groupBy("source").agg(F.max("rest").alias("rest"), F.min(edge).alias("e"))
    marks = durable(marks.select("source", "rest", F.col("e.slot").alias("edge_slot"), F.col("e.before").alias("before")), "mix-marks")
    own = marks.withColumnRenamed("source", "m_source")
    inside = d.join(own, F.col("source").eqNullSafe(F.col("m_source")) & (F.col("slot") == F.col("edge_slot")))
    inside = durable(inside.select("source", "size", "odds", _id().alias("id"), "before", "rest"), "mix-edge")
    order = Window.partitionBy("source").orderBy("odds", "id").rowsBetween(Window.unboundedPreceding, 0)
    run, rest = F.col("run"), F.col("rest")
    # the row on which the words run out is taken if that leaves the sum nearer
    last = (
        inside.withColumn("run", F.col("before") + F.sum("size").over(order))
        .where((run <= rest) | (run - rest <= rest - (run - F.col("size"))))
        .groupBy(F.col("source").alias("l_source")).agg(F.max(F.struct("odds", "id")).alias("last"))
    )
    out = marks.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
    return durable(out.select("source", "rest", "edge_slot", "last"), "mix-cut")


def pareto_take(docs: DataFrame, cut: DataFrame, seed: str = "tessera") -> DataFrame:
    """Adds copies and taken (copies * size) to rows with doc_id, source, size, source_size, target, by pareto_cut().

    Each document is due e = target / source_size copies. floor(e) copies are certain; for the fraction p the document
    is ranked by Pareto's odds ratio u/(1-u) / (p/(1-p)), u from a seeded MD5 of doc_id, and the smallest ranks are
    taken until the source's remaining words are nearest to spent. Ties in rank go to the smaller doc_id, null last;
    rows that repeat an id are taken or left together; a null source is a source; reruns agree. The cut has one row per
    source and is joined without moving the documents where Spark finds it small enough."""
    c = cut.select(F.col("source").alias("c_source"), "rest", "edge_slot", "last")
    # the rows ride along whole, so that no column of theirs clashes with those of the ranks
    d = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "size", "source_size", "target")
    d = _ranked(d, seed).join(c, F.col("source").eqNullSafe(F.col("c_source")), "left")
    extra = (
        F.when(F.col("p") <= 0, 0)
        .when(F.col("edge_slot").isNull(), F.when(F.col("rest") > 0, 1).otherwise(0))
        .when(F.col("slot") < F.col("edge_slot"), 1)
        .when((F.col("slot") == F.col("edge_slot")) & (F.struct("odds", _id().alias("id")) <= F.col("last")), 1)
        .otherwise(0)
    )
    d = d.withColumn("copies", (F.col("certain") + F.coalesce(extra, F.lit(0))).cast("long"))
    return d.select("row.*", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, max_epochs: float = 3.0, cycle: int = 3, seed: str = "tessera") -> DataFrame:
    """Adds size, source_size, target, copies and taken to rows with doc_id, source and text. Sizes are counted once for
    the sums; the documents themselves are neither shuffled nor sorted. Columns of those names in docs are replaced."""
    slim = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = durable(source_targets(slim, 1.0, max_epochs, cycle), "mix-targets")
    plain = docs.drop("size", "source_size", "target", "copies", "taken")
    key = fresh("t_source", plain.columns)
    t = targets.withColumnRenamed("source", key)

    def due(df: DataFrame) -> DataFrame:
        return df.join(t, F.col("source").eqNullSafe(F.col(key))).drop(key)

    cut = pareto_cut(due(slim), seed)
    return pareto_take(due(plain.withColumn("size", n_words(F.col("text")))), cut, seed)
