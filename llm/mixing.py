"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken target / source size times, at most twice.
The whole part is certain; the fraction is rounded by pairing documents: of two
fractional copy counts, mass (counted in words) moves from one to the other by chance,
in the direction and measure that keep each count's expectation, until one of them is
whole.  Blocks of documents leave at most one fractional count each; these meet in the
blocks of the next level, and so on, until one is left in a source, which is drawn.
A source's words thus differ from its target by less than one document.

Only DataFrame expressions: a block is folded by ``aggregate`` over its sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, Scratch, table

SHARE = 1.5
MOST = 2.0
WEIGHTS = (5, 2, 1)
#: Documents of a block, on average; blocks are dealt by a hash and split beyond twice that.
BLOCK = 64


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target of (source, source_size), by water filling.

    Sources in code point order, null last, take ``weights`` in turn.  Together they get
    ``share`` times all words; what exceeds ``most`` times a source's size goes to the
    others by weight until none is above.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    all_ = Window.partitionBy(F.lit(1))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(all_) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    # The level rises with each full source; the first that its share doesn't fill sets it for the rest.
    s = s.withColumn("turn", F.row_number().over(fill))
    below = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("turn", "level"))
    s = s.withColumn("water", F.min(below).over(all_)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(seed: int, *cols) -> Column:
    """A number in (0, 1) that is a function of the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))


EPS = 1e-9


def unit_of() -> Column:
    """The unit of a document: a digest of id, text and source, nulls apart from every value."""
    told = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))
    return F.sha1(F.concat_ws("|", told(F.col("doc_id").cast("string")), F.xxhash64("text").cast("string"), told(F.col("source"))))


def _fold(items: Column, seed: int) -> Column:
    """Fold of an array of (unit, size, p): the one left fractional and who gets a copy.

    The state is (unit, size, p, won): (unit, size, p) is fractional or null at first.
    """
    start = F.struct(F.lit(None).cast("string").alias("unit"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("p"), F.array().cast("array<string>").alias("won"))

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["size"].cast("double"), x["size"].cast("double")
        # In words: how much may move from x to acc, and from acc to x.
        into = F.least((1 - acc["p"]) * a, x["p"] * b)
        out = F.least(acc["p"] * a, (1 - x["p"]) * b)
        up = _uniform(seed, acc["unit"], x["unit"]) * (into + out) < out
        move = F.when(up, into).otherwise(-out)
        p1, p2 = acc["p"] + move / a, x["p"] - move / b
        first_done = (p1 < EPS) | (p1 > 1 - EPS)
        won = F.filter(F.array(F.when(p1 > 1 - EPS, acc["unit"]), F.when(p2 > 1 - EPS, x["unit"])), lambda u: u.isNotNull())
        second_done = (p2 < EPS) | (p2 > 1 - EPS)
        rest = F.when(first_done & second_done, F.struct(F.lit(None).cast("string").alias("unit"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("p"))).when(
            first_done, F.struct(x["unit"].alias("unit"), x["size"].alias("size"), p2.alias("p"))
        ).otherwise(F.struct(acc["unit"].alias("unit"), acc["size"].alias("size"), p1.alias("p")))
        paired = F.struct(rest["unit"].alias("unit"), rest["size"].alias("size"), rest["p"].alias("p"), F.concat(acc["won"], won).alias("won"))
        alone = F.struct(x["unit"].alias("unit"), x["size"].alias("size"), x["p"].alias("p"), acc["won"].alias("won"))
        return F.when(acc["unit"].isNull(), alone).otherwise(paired)

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    * null and empty texts have size 0 and are taken 0 times; a source without words
      has target 0; null is a source of its own, last in order;
    * ties and repeated rows: rows alike in id, source and text are one unit, taken alike,
      counted with all their words; the same input gives the same mix;
    * a very long text is one document of that size; the mix may miss a target by it;
    * an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    base = scratch.keep(docs.select("doc_id", "source", size.alias("size"), unit_of().alias("unit")))
    goal = scratch.keep(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + EPS)).withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    goal = goal.withColumnRenamed("source", "goal_source")
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    open_ = base.where("size > 0").join(goal, same).where(F.col("p") > EPS)
    level = open_.groupBy("source", "unit").agg(F.sum("size").alias("size"), F.first("p").alias("p"))
    won = None
    n = 0
    level = scratch.keep(level)
    while True:
        n += 1
        counts = level.groupBy("source").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("source", "of")
        most_left = counts.agg(F.max("m")).first()[0]
        if not most_left:
            break
        block = F.pmod(F.xxhash64(F.lit(seed + n), "unit"), F.ceil(F.col("m") / BLOCK))
        dealt = level.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block)
        # Large documents pair first: what is left over in the end is a small one.
        folded = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), F.xxhash64(F.lit(seed), "unit").alias("turn"), "unit", "size", "p"))).alias("items")).withColumn("out", _fold(F.col("items"), seed + n))
        folded = scratch.keep(folded.select("source", "out"))
        now = folded.select("source", F.explode("out.won").alias("unit"))
        won = now if won is None else won.unionByName(now)
        level = folded.where("out.unit is not null").select("source", "out.unit", "out.size", "out.p")
        if most_left <= 1:
            last = level.where(_uniform(seed + 1000, F.col("unit")) < F.col("p")).select("source", "unit")
            won = won.unionByName(last)
            break
    out = base.join(goal, same)
    if won is not None:
        won = won.select(F.col("unit").alias("won_unit")).distinct()
        out = out.join(won, F.col("unit") == F.col("won_unit"), "left")
    else:
        out = out.withColumn("won_unit", F.lit(None).cast("string"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("won_unit").isNotNull(), 1).otherwise(0)).otherwise(0).cast("long")
    out = scratch.keep(out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "unit"))
    scratch.drop(but=1)
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
