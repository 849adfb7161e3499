"""Concatenating, sampling, mixing by ratio, splitting, sharding and batching of manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.operators.ranking import group_row_numbers, row_numbers, seeded, seeded_bottom

#: Default shares of the first training stage's sources.
STAGE1 = {"golos": 0.35, "cv": 0.25, "ruls": 0.15, "podlodka": 0.10, "telephony": 0.10, "nonspeech": 0.05}


def concat_tagged(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of all sources, tagged with their source where ``dataset`` is null or absent; src_no keeps the order of sources."""
    tagged = []
    for k, (name, df) in enumerate(sources.items()):
        tag = F.coalesce(F.col("dataset"), F.lit(name)) if "dataset" in df.columns else F.lit(name)
        tagged.append(df.withColumn("dataset", tag).withColumn("src_no", F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def normalize_ratios(ratios: dict[str, float]) -> dict[str, float]:
    total = sum(ratios.values())
    if total <= 0:
        raise ValueError("ratios must add up to more than 0")
    return {k: v / total for k, v in ratios.items()}


def parse_ratios(items: list[str]) -> dict[str, float]:
    """name=value items as shares that add up to 1."""
    return normalize_ratios({k.strip(): float(v) for k, v in (x.split("=", 1) for x in items)})


def mix_plan(ratios: dict[str, float], target: int) -> dict[str, int]:
    """Rows of each source: half-even rounding, repaired by one for the first sources until the plan adds up."""
    shares = normalize_ratios(ratios)
    plan = {k: round(v * target) for k, v in shares.items()}
    names, rest = list(plan), target - sum(plan.values())
    step, k = (1 if rest > 0 else -1), 0
    while rest:
        name = names[k % len(names)]
        if plan[name] + step >= 0:
            plan[name] += step
            rest -= step
        k += 1
    return plan


def stage1_ratios(names: list[str]) -> dict[str, float]:
    """The default shares of the sources that are there, renormalized."""
    missing = [k for k in names if k not in STAGE1]
    if missing:
        raise ValueError(f"no default share for {missing}")
    return normalize_ratios({k: STAGE1[k] for k in STAGE1 if k in names})


def ratio_mix(rows: DataFrame, source: str, ratios: dict[str, float], target: int, key: str, seed: int = 42) -> DataFrame:
    """A reproducible sample of each source by its planned rows; a short source gives what it has."""
    missing = [k for k in ratios if ratios[k] < 0]
    if missing:
        raise ValueError(f"negative ratios: {missing}")
    plan = rows.sparkSession.createDataFrame(list(mix_plan(ratios, target).items()), "_group string, planned int")
    return seeded_bottom(rows, plan, source, seed, [key], [source, key])


def temperature_ratios(counts: dict[str, int], tau: float = 0.5) -> dict[str, float]:
    """Shares by count to the power tau. (Described in the domain's methodology, an extension.)"""
    return normalize_ratios({k: float(n) ** tau for k, n in counts.items()})


def temperature_shares(counts: DataFrame, count: str, tau: float = 0.5) -> DataFrame:
    """counts with share, as temperature_ratios has it, of any number of sources: only the sum meets the driver. (Described in the domain's methodology, an extension.)"""
    total = counts.agg(F.sum(F.pow(F.col(count).cast("double"), F.lit(tau)))).first()[0]
    return counts.withColumn("share", F.pow(F.col(count).cast("double"), F.lit(tau)) / F.lit(total))


def reservoir_sample(rows: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly k rows, uniformly and reproducibly; a small k is a top-k, without a full sort."""
    return rows.orderBy(seeded(seed, key), key).limit(k)


def random_split(rows: DataFrame, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """rows with split ``val`` for half-even round(n * ratio) of them and ``train`` for the rest."""
    k = round(rows.count() * ratio)
    return row_numbers(rows, [seeded(seed, key), F.col(key)]).withColumn("split", F.when(F.col("rn") <= k, "val").otherwise("train")).drop("rn")


def stratified_split(rows: DataFrame, group: str, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """random_split within each group."""
    ranked = group_row_numbers(rows, [group], [seeded(seed, key), F.col(key)])
    return ranked.withColumn("split", F.when(F.col("rn") <= F.bround(F.col("n_group") * F.lit(ratio), 0), "val").otherwise("train")).drop("rn", "n_group")


def round_robin(rows: DataFrame, shards: int, order: str) -> DataFrame:
    return row_numbers(rows, [F.col(order)]).withColumn("shard", F.pmod(F.col("rn") - 1, F.lit(shards)).cast("int")).drop("rn")


def batch_ids(rows: DataFrame, size: int, order: str) -> DataFrame:
    return row_numbers(rows, [F.col(order)]).withColumn("batch_id", F.floor((F.col("rn") - 1) / size)).drop("rn")


def shard_merge(shards: DataFrame) -> DataFrame:
    """(utt_id, hyp) of the last shard that has the key. shards: (shard_idx, utt_id, hyp)."""
    return shards.groupBy("utt_id").agg(F.max_by("hyp", "shard_idx").alias("hyp"))


def dedup_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with ``first_at``, where the key first stood. Only a maximum and a minimum are kept for a key, whatever its rows."""
    columns = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row"), F.min(order).alias("first_at"))
    return best.select(key, "_row.*", "first_at")


def dedup_normalized(rows: DataFrame, normalized, key: str) -> DataFrame:
    """One row, that with the smallest key, of each normalized text. (Described in the domain's methodology, an extension.)"""
    return rows.withColumn("_t", normalized).groupBy("_t").agg(F.min_by(F.struct(*rows.columns), key).alias("_r")).select("_r.*")


def limit_rows(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(order).limit(n)


def duration_buckets(rows: DataFrame, seconds: float, order: list) -> DataFrame:
    """Batches of about so many seconds each, in this order. (Described in the domain's methodology, an extension.)"""
    from speechlake.operators.ranking import running_sums

    return running_sums(rows, order, F.coalesce("duration", F.lit(0.0)), "_b").withColumn("bucket", F.floor(F.col("_b") / seconds)).drop("_b")


def profile(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Rows and hours by every combination of dimensions. (Described in the domain's guides, an extension.)"""
    return rows.cube(*dims).agg(F.count("*").alias("rows"), F.round(F.sum("duration") / 3600, 6).alias("hours"), F.grouping_id().alias("level"))
