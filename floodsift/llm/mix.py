"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies. Its whole part is taken for certain; the fraction
is the document's inclusion probability in a fixed-size sample: documents are ranked by the odds of
a random number divided by the odds of inclusion, and the source's missing words are filled in that
order. No document is handled on its own by the driver or gathered by source: the place where the
order is cut is found by summing words in ever finer ranges of the ranking variable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodsift.llm.words import let, words
from floodsift.session import stage

CAP = 3  # copies of a document, and words of a source against its size
CLASSES = 16  # of lexical variety
KEY_BITS = 52
LEVEL_BITS = 16  # ranges a level of the search for the cut
SEED = "pareto"


def sized(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add _source (never null), _size in words, _class of variety and the random number _u."""
    text = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("d")
        ),
    )
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return (
        docs.withColumn("_n", text)
        .withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("z")))
        .withColumn("_size", F.col("_n.n"))
        .withColumn(
            "_class",
            F.when(F.col("_size") == 0, 0)
            .otherwise(F.expr(f"least({CLASSES - 1}, {CLASSES} * _n.d div _n.n)"))
            .cast("int"),
        )
        .withColumn("_u", F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint"))
        .drop("_n")
    )


def targets(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(_source, source_size, target): weighted shares of all words, none above CAP times its source.

    ``sources`` has one row a source, (_source, source_size). Sources in the order of their code
    points take the weights in turn. Raising the water line over the weights, sources are capped in
    the order of CAP * size / weight; the first that is not capped tells the line.
    """
    order = Window.orderBy("_source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "_source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.lit(CAP) * F.col("source_size")
    return (
        sources.withColumn("w", F.get(F.array(*map(F.lit, weights)), turn).cast("bigint"))
        .withColumn("left", F.sum("source_size").over(everything)
                    - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("line", F.col("left").cast("double") / F.col("open"))
        .withColumn("rank", F.row_number().over(by_cap))
        .withColumn(
            "line",
            F.min_by("line", F.when(capped > F.col("line") * F.col("w"), F.col("rank"))).over(everything),
        )
        .select(
            "_source",
            "source_size",
            F.least(capped.cast("double"), F.coalesce(F.col("line") * F.col("w"), capped.cast("double"))).alias("target"),
        )
    )


def copies_by_class(classes: DataFrame) -> DataFrame:
    """Add the expected ``copies`` of a document of each class, at most CAP, to reach the target.

    A document of class c weighs 1 + c / CLASSES: varied texts are taken up to twice as often as
    monotonous ones. The heaviest classes reach the cap first.
    """
    gain = F.lit(CLASSES) + F.col("_class")
    down = Window.partitionBy("_source").orderBy(F.desc("_class"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_source")
    weighed = F.col("words") * gain
    return (
        classes.withColumn("left", F.col("target")
                           - CAP * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("open", F.sum(weighed).over(whole) - F.coalesce(F.sum(weighed).over(before), F.lit(0)))
        .withColumn("rate", F.when(F.col("open") > 0, F.col("left") / F.col("open")))
        .withColumn("rate", F.max_by("rate", F.when(F.col("rate") * gain <= CAP, F.col("_class"))).over(whole))
        .withColumn("copies", F.least(F.lit(float(CAP)), F.coalesce(F.col("rate") * gain, F.lit(float(CAP)))))
        .drop("left", "open", "rate")
    )


def _key(u: Column, p: Column) -> Column:
    """The ranking variable, odds of u by odds of p, mapped in order to KEY_BITS bits."""
    x = (u.cast("double") + 0.5) / float(1 << KEY_BITS)
    ratio = (x / (1.0 - x)) / (p / (1.0 - p))
    return F.when(p > 0, F.floor(ratio / (1.0 + ratio) * float(1 << KEY_BITS)).cast("bigint"))


def _cut(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """(_source, last): documents with keys up to ``last`` are taken.

    Level by level only the range that holds the cut is summed again, finer. Documents with equal
    keys are taken together or not at all.
    """
    found = missing.select("_source", "missing", F.lit(0).cast("bigint").alias("base"), F.lit(-1).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("prefix"))
    shift = KEY_BITS
    while shift > 0:
        above, shift = shift, max(0, shift - LEVEL_BITS)
        inside = rows.join(found.select("_source", "prefix"), "_source").where(
            F.shiftright("_key", above) == F.col("prefix")
        )
        sums = inside.groupBy("_source", F.shiftright("_key", shift).alias("bin")).agg(
            F.sum("_size").alias("words")
        )
        upto = Window.partitionBy("_source").orderBy("bin")
        bins = sums.join(found, "_source").withColumn(
            "upto", F.col("base") + F.sum("words").over(upto)
        )
        if shift:
            full = F.col("upto") <= F.col("missing")
        else:  # single keys: the one that comes nearest is the last
            full = F.col("upto") * 2 - F.col("words") <= F.col("missing") * 2
        end = F.shiftleft(F.col("bin") + 1, shift) - 1
        step = bins.groupBy("_source").agg(
            F.max(F.when(full, end)).alias("step_last"),
            F.max(F.when(full, F.col("upto"))).alias("step_base"),
            F.min(F.when(~full, F.col("bin"))).alias("step_prefix"),
        )
        found = stage(
            found.join(step, "_source", "left").select(
                "_source",
                "missing",
                F.coalesce("step_base", "base").alias("base"),
                F.coalesce("step_last", "last").alias("last"),
                F.coalesce("step_prefix", F.lit(-1)).cast("bigint").alias("prefix"),
            )
        )
    return found.select("_source", "last")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    id_col: str = "doc_id",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` with _size, source_size, target and _copies (0 to CAP) added.

    Null texts have no words; null sources are one source, the last. Rows of one id share the
    random number and, with equal texts, the decision. An empty table gives an empty table.
    Columns of ``docs`` named like an added one are replaced. With ``keep`` only these columns are
    returned; if they are narrow, that saves reading the texts a second time.
    """
    added = ["_size", "source_size", "target", "_copies"]
    held = [c for c in (docs.columns if keep is None else keep) if c not in added]
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(held)])
    given = sized(docs.select(id_col, "text", "source", row.alias("_row")), id_col).drop(id_col, "text", "source")
    if keep is not None:
        given = stage(given)
        narrow = given
    else:
        narrow = stage(given.select("_source", "_size", "_class", "_u"))
    classes = narrow.groupBy("_source", "_class").agg(F.sum("_size").alias("words"))
    totals = targets(classes.groupBy("_source").agg(F.sum("words").alias("source_size")), weights)
    expected = stage(copies_by_class(classes.join(totals, "_source")).select(
        "_source", "_class", "words", "source_size", "target",
        F.floor("copies").cast("bigint").alias("whole"),
        (F.col("copies") - F.floor("copies")).alias("p"),
    ))
    missing = expected.groupBy("_source").agg(
        (F.first("target") - F.sum(F.col("words") * F.col("whole"))).alias("missing")
    )
    keyed = narrow.join(expected.select("_source", "_class", "p"), ["_source", "_class"]).select(
        "_source", "_size", _key(F.col("_u"), F.col("p")).alias("_key")
    )
    last = _cut(stage(keyed.where(F.col("_key").isNotNull() & (F.col("_size") > 0))), missing)
    plan = stage(expected.join(last, "_source").drop("words"))
    sampled = F.coalesce(_key(F.col("_u"), F.col("p")) <= F.col("last"), F.lit(False))
    return (
        given.join(plan, ["_source", "_class"])
        .withColumn("_copies", F.col("whole") + sampled.cast("bigint"))
        .select(*[F.col("_row").getField(f"c{k}").alias(c) for k, c in enumerate(held)], *added)
    )


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    copies = F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_docs"))
    return mix(rows, weights).select("_docs", copies).select("_docs.*")
