"""Mixing sources to target weights along a curriculum.

Source s shall give the share p(s) of all tokens T. Its weight changes over training time t in [0, 1] as
w(s, t) = p(s) * (1 + a(s) * (2 t - 1)); the slopes a(s) are shifted so that the weights sum to 1 at every t.
Integrated, the source's demand up to t is D(s) * (t + a(s) * (t * t - t)) with D(s) = p(s) * T. A document that begins at
token c of its source is due where that demand equals c, a quadratic with one root in [0, 1]. Passes
follow each other within a source; no document is used more than ``max_passes`` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.llm.tokens import VOCABULARY, count_tokens


def demands(sizes: DataFrame, targets: DataFrame, steepness: float = 0.5) -> DataFrame:
    """Per source of ``targets``: tokens held, tokens wanted, passes allowed, slope. One small row each.

    Of repeated source rows the largest values hold; a null share or pass count counts as 0, a null source is ignored.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_passes"), F.lit(0)).alias("max_passes"))
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = held.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rough = steepness * (1 - 2 * F.col("target_share") / F.max("target_share").over(everything))
    centre = F.try_divide(F.sum(F.col("target_share") * F.col("rough")).over(everything), F.sum("target_share").over(everything))
    sloped = wanted.withColumn("rough", F.coalesce(rough, F.lit(0.0))).withColumn("slope", F.greatest(F.lit(-0.95), F.least(F.lit(0.95), F.col("rough") - F.coalesce(centre, F.lit(0.0)))))
    joined = sloped.join(held, "source", "left")
    return joined.select("source", "target_share", "max_passes", "slope", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("target_share") * total).alias("demand"))


def assign(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 42, buckets: int = 4096, steepness: float = 0.5) -> DataFrame:
    """(source, key, pass, n_tokens, position): every use of every document that the mix takes.

    ``sizes``: (key, source, n_tokens). Documents of a source are taken in the order of a seeded hash until the demand is met, so a source
    exceeds its demand by less than one document, or falls short only when it is used up. Running sums are taken in
    two levels, over hash buckets and within a bucket, so that no task holds a whole source. Documents whose source is null or
    without target take no part.
    """
    plan = demands(sizes, targets, steepness)
    mixed = F.xxhash64(F.lit(seed), F.col(key))
    spread = sizes.where("source is not null").select("source", key, "n_tokens", mixed.alias("__order"), F.pmod(mixed, F.lit(buckets)).alias("__bucket"))
    sums = spread.groupBy("source", "__bucket").agg(F.sum("n_tokens").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("source", "__bucket").orderBy("__order", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("__inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["source", "__bucket"])
    # one row for each source that has a target
    begun = placed.join(F.broadcast(plan), "source").withColumn("__begin", F.col("__offset") + F.col("__inner"))
    uses = F.least(F.col("max_passes").cast("bigint"), F.ceil(F.try_divide(F.col("demand") - F.col("__begin"), F.greatest(F.col("tokens"), F.lit(1)))))
    used = begun.withColumn("__uses", uses).where("__uses > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__uses")))).where(F.col("__begin") + (F.col("pass") - 1) * F.col("tokens") < F.col("demand"))
    c = (F.col("__begin") + (F.col("pass") - 1) * F.col("tokens")) / F.col("demand")
    rise = 1 - F.col("slope")
    position = 2 * c / (rise + F.sqrt(rise * rise + 4 * F.col("slope") * c))
    return used.select("source", key, F.col("pass").cast("int").alias("pass"), "n_tokens", position.alias("position"))


def report(assigned: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, demand, reached, actual_share, full): what the mix holds of each source."""
    reached = assigned.groupBy("source").agg(F.sum("n_tokens").alias("reached"))
    joined = plan.join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    mix = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.try_divide(F.col("reached").cast("double"), F.sum("reached").over(mix))
    return joined.select("source", "target_share", "max_passes", "demand", "reached", share.alias("actual_share"), (F.col("reached") >= F.col("demand")).alias("full"))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """The whole mix in training order."""
    sizes = count_tokens(documents.select(key, "source", text), text, vocabulary)
    return assign(sizes, targets, key, **options).orderBy("position", "source", key, "pass")
