"""The domain's tables derived from the test tables: utterances, predictions of three models, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions.vectors import cosine

#: Which token positions a model deletes, alters, and follows with a filler.
MODELS = {"m1": (11, 13, 17), "m2": (7, 9, 12), "m3": (19, 23, 29)}
#: Words of an utterance, and utterances that a document's numbers leave room for.
WORDS, PLACES = 24, 1 << 20
WEIGHTS = {"the": 0.5, "and": 0.5, "uh": 0.25, "de": 2.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, ref, dataset, lang, duration): each document as one recording, all its words in one text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt_id"), F.array_join(words, " ").alias("ref"), F.col("source").alias("dataset"), "lang", (F.col("n_chars") / 15.0).alias("duration"))
    return spread(rows, "utt_id")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, ref, dataset, lang, duration): each document's words in utterances of WORDS, the last one shorter; none is lost.

    Utterance k of document d is d * PLACES + k; a document without words is one empty utterance. Durations are
    sixteenths of a second, which doubles add up exactly in any order.
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - 1) / WORDS)).cast("int"))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("dataset"), "lang"), "doc_id").withColumn("w", words)
    each = rows.select("doc_id", "dataset", "lang", F.posexplode(F.transform(cuts, lambda k: F.array_join(F.slice("w", k * WORDS + 1, WORDS), " "))).alias("k", "ref"))
    return each.select((F.col("doc_id") * PLACES + F.col("k")).alias("utt_id"), "ref", "dataset", "lang", (F.length("ref") / 16.0).alias("duration"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows on as many tasks as a shuffle has; dealt anew, which writes all texts once more, only where the files give fewer and less than two a core."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows if rows.rdd.getNumPartitions() >= min(n, 2 * rows.sparkSession.sparkContext.defaultParallelism) else rows.repartition(n, key)


def predictions(utt: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(model_id, utt_id, hyp): references edited by rules; m3 has none for every tenth utterance. models: those whose predictions are made, all if not given."""
    d, words = F.col("utt_id"), F.array_remove(F.split("ref", " "), "")

    def edited(a: int, b: int, c: int):
        def edit(t, i):
            at = i + 1
            kept = F.when((d + at) % a == 0, None).when((3 * d + at) % b == 0, F.concat(t, F.lit("x"))).otherwise(t)
            filled = (d + 2 * at) % c == 0
            # null where nothing is left, which the text then doesn't have
            return F.when(filled, F.concat_ws(" ", kept, F.lit("uh"))).otherwise(kept)

        return F.array_join(F.transform(words, edit), " ")

    found = [F.struct(F.lit(name).alias("model_id"), edited(*MODELS[name]).alias("hyp")) for name in models or MODELS]
    each = utt.select("utt_id", F.explode(F.array(*found)).alias("p")).select("p.model_id", "utt_id", "p.hyp")
    return each.where(~((F.col("model_id") == "m3") & (F.col("utt_id") % 10 == 0)))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, sim): the cosine of vector k with vector k + 1, for the first utterance of document k."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select((F.col("vec_id") * PLACES).alias("utt_id"), F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


def manifest(utt: DataFrame) -> DataFrame:
    """(utt_id, audio_filepath, text, dataset, duration): a path for each utterance; some durations are unknown and some texts blank."""
    d = F.col("utt_id")
    path = F.concat(F.lit("data/"), "dataset", F.lit("/clip"), (d % 50).cast("string"), F.when(d % 3 == 0, ".wav").when(d % 3 == 1, ".flac").otherwise(".mp3"))
    return utt.select("utt_id", path.alias("audio_filepath"), F.when(d % 17 == 0, " ").otherwise(F.col("ref")).alias("text"), "dataset", "lang", F.when(d % 13 == 0, None).otherwise(F.col("duration") / 10).alias("duration"))
