"""Error analysis: per-utterance scores and everything that is aggregated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.functions import alignment, text, vectors
from speechlake.session import ship_code


def pair_with_models(refs: DataFrame, preds: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Every reference for every model, its hypothesis empty where the model has none. refs: (utt_id, ref, ...); preds: (model_id, utt_id, hyp), a row a model and key as readers.read_predictions gives; rows that repeat both are scored each.

    References and hypotheses meet by key alone, so that a reference is shuffled once, not once for each model, and a
    key's hypotheses, which are much alike, lie together in the shuffle. The first hypothesis of a key brings what other models lack.
    """
    names = list(dict.fromkeys(models)) if models is not None else sorted(r[0] for r in preds.select("model_id").distinct().collect())
    every, key = F.array(*[F.lit(m) for m in names]).cast("array<string>"), Window.partitionBy("utt_id").orderBy("model_id")
    more = [c for c in preds.columns if c not in ("model_id", "utt_id")]
    held = preds.where(F.col("utt_id").isNotNull() & F.col("model_id").isin(names)).select(
        "utt_id", F.struct("model_id", *more).alias("_own"), (F.row_number().over(key) == 1).alias("_first"), F.collect_set("model_id").over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_have")
    )
    own = F.array_compact(F.array("_own"))
    none = [F.lit(None).cast(preds.schema[c].dataType).alias(c) for c in more]
    lacking = F.when(F.coalesce("_first", F.lit(True)), F.transform(F.array_except(every, F.coalesce("_have", F.array().cast("array<string>"))), lambda m: F.struct(m.alias("model_id"), *none))).otherwise(F.array())
    each = refs.join(held, "utt_id", "left").select("utt_id", *[c for c in refs.columns if c != "utt_id"], F.explode(F.concat(own, lacking)).alias("_p"))
    return each.select("_p.model_id", *[c for c in each.columns if c != "_p"], *[F.coalesce("_p.hyp", F.lit("")).alias(c) if c == "hyp" else F.col(f"_p.{c}").alias(c) for c in more])


def matched_pairs(refs: DataFrame, preds: DataFrame) -> DataFrame:
    """References that have a hypothesis."""
    return refs.join(preds, "utt_id")


def key_intersection(refs: DataFrame, preds: DataFrame, models: list[str]) -> DataFrame:
    """Keys of references that every model has."""
    full = preds.where(F.col("model_id").isin(models)).groupBy("utt_id").agg(F.count_distinct("model_id").alias("n")).where(F.col("n") == len(models))
    return refs.select("utt_id").distinct().join(full.select("utt_id"), "utt_id", "left_semi")


def metrics(counts: Column, ref: Column, hyp: Column) -> dict[str, Column]:
    """Error rates of a pair: words, characters, and whether it is wrong at all."""
    edits = counts["sub"] + counts["ins"] + counts["del"]
    return {
        "wer": F.round(edits / F.greatest(F.lit(1), counts["n_ref"]), 6),
        "cer": F.round(alignment.char_distance(ref, hyp) / F.greatest(F.lit(1), F.length(ref)), 6),
        "ser": F.when(F.trim(ref) == F.trim(hyp), 0.0).otherwise(1.0),
    }


def segment_metrics(pairs: DataFrame) -> DataFrame:
    """pairs with wer and cer after lower-casing and dropping ASCII punctuation alone, as segments for fine-tuning are scored. pairs: (ref, hyp, ...)."""
    ship_code(pairs.sparkSession)
    p = pairs.withColumns({"_r": text.normalize_basic(F.col("ref")), "_h": text.normalize_basic(F.col("hyp"))})
    m = metrics(F.col("_c"), F.col("_r"), F.col("_h"))
    scored = p.withColumn("_c", alignment.edit_counts(text.tokens(F.col("_r")), text.tokens(F.col("_h"))))
    return scored.select(*pairs.columns, m["wer"].alias("wer"), m["cer"].alias("cer"))


def per_utterance(pairs: DataFrame, sim: DataFrame | None = None, with_ops: bool = False) -> DataFrame:
    """Scores of every pair (utt_id, model_id, ref, hyp, ...): normalized texts, counts, rates, class; with_ops: categories and confusions too. sim: (utt_id, sim) or with model_id."""
    ship_code(pairs.sparkSession)
    normal = pairs.withColumn("ref_norm", text.normalize_advanced(F.col("ref"))).withColumn("hyp_norm", text.normalize_advanced(F.col("hyp")))
    r, h = text.tokens(F.col("ref_norm")), text.tokens(F.col("hyp_norm"))
    if with_ops:
        done = normal.withColumn("_ops", alignment.edit_ops(r, h))
        count = lambda op: F.size(F.filter("_ops", lambda o: o["op"] == op)).cast("long")
        done = done.withColumn("_c", F.struct(count("sub").alias("sub"), count("ins").alias("ins"), count("del").alias("del"), count("correct").alias("correct")))
        done = done.withColumn("_c", F.struct("_c.*", (F.col("_c.sub") + F.col("_c.del") + F.col("_c.correct")).alias("n_ref")))
    else:
        done = normal.withColumn("_c", alignment.edit_counts(r, h))
    out = done.withColumns(metrics(F.col("_c"), F.col("ref_norm"), F.col("hyp_norm")))
    out = out.withColumns({"ops_sub": F.col("_c.sub"), "ops_ins": F.col("_c.ins"), "ops_del": F.col("_c.del"), "ops_correct": F.col("_c.correct"), "n_ref": F.col("_c.n_ref")})
    if with_ops:
        kinds = F.transform("_ops", lambda o: text.token_category(F.coalesce(o["ref"], o["hyp"])))
        out = out.withColumn("_k", kinds)
        out = out.withColumns({f"cat_{k}": _count_equal("_k", k) for k in ("number", "abbr", "latin", "word")})
        out = out.withColumn("confusions", alignment.substitutions(F.col("_ops"))).drop("_k")
    if sim is not None:
        out = out.join(sim, [c for c in ("utt_id", "model_id") if c in sim.columns], "left")
    else:
        out = out.withColumn("sim", F.lit(None).cast("double"))
    out = out.withColumn("sim", F.round("sim", 6))
    return out.withColumn("class", text.classify_utterance(F.col("wer"), F.col("sim"))).drop("_c", "_ops")


def _count_equal(column: str, value: str) -> Column:
    return F.size(F.filter(column, lambda x: x == value)).cast("long")


def leaderboard(scores: DataFrame, null_aware: bool = False) -> DataFrame:
    """Means of each model over its utterances, lowest wer first, of bert_score too where there is one; a null counts as 0 unless null_aware."""
    mean = lambda c: F.round(F.avg(c) if null_aware else F.sum(F.coalesce(F.col(c), F.lit(0.0))) / F.count("*"), 6).alias(c)
    names = ["wer", "cer", "ser", "sim"] + ["bert_score"] * ("bert_score" in scores.columns)
    return scores.groupBy("model_id").agg(F.count("*").alias("count"), *map(mean, names)).orderBy("wer", "model_id")


def baseline_deltas(models: DataFrame) -> DataFrame:
    """Each model against the unweighted mean of all: cosine of the rate vectors, differences of the rates."""
    names = ["wer", "cer", "ser", "sim"]
    every = Window.partitionBy(F.lit(0))  # a row for each model
    both = models.withColumns({f"_{c}": F.avg(c).over(every) for c in names})
    cos = vectors.guarded_cosine([F.col(c) for c in names], [F.col(f"_{c}") for c in names])
    out = both.withColumn("baseline_cosine", F.round(cos, 6))
    return out.withColumns({f"delta_{c}": F.round(F.col(c) - F.col(f"_{c}"), 6) for c in names[:3]}).drop(*[f"_{c}" for c in names])


def top_confusions(scores: DataFrame, k: int = 100) -> DataFrame:
    """Substituted pairs by how often they occur."""
    pairs = scores.select(F.explode("confusions").alias("p")).select("p.ref", "p.hyp")
    return pairs.groupBy("ref", "hyp").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "ref", "hyp").limit(k)


def taxonomy_totals(scores: DataFrame) -> DataFrame:
    names = ["ops_sub", "ops_ins", "ops_del", "ops_correct", "cat_number", "cat_abbr", "cat_latin", "cat_word"]
    return scores.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])


def taxonomy_share(totals: DataFrame) -> DataFrame:
    """Shares of substitutions, insertions and deletions among all operations."""
    n = F.greatest(F.col("ops_sub") + F.col("ops_ins") + F.col("ops_del") + F.col("ops_correct"), F.lit(1))
    return totals.select(*[F.round(F.col(f"ops_{c}") / n, 6).alias(c) for c in ("sub", "ins", "del")])


def disagreement(scores: DataFrame) -> DataFrame:
    """Spread of the error rate over models, for each utterance."""
    return scores.groupBy("utt_id").agg(F.round(F.stddev_pop("wer"), 6).alias("std_wer"), F.count("*").alias("models"), F.count_distinct(F.struct("model_id", "wer")).alias("distinct_scores"))


def error_overlap(scores: DataFrame, models: list[str] | None = None) -> DataFrame:
    """For every two models the utterances that both get wrong, zeros kept; an utterance's models meet in one row, so no self-join is needed."""
    names = models or sorted(r[0] for r in scores.select("model_id").distinct().collect())
    wrong = scores.where("wer > 0").groupBy("utt_id").agg(F.collect_set("model_id").alias("m"))
    grid = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b")) for a in names for b in names])
    each = wrong.select(F.explode(F.filter(grid, lambda p: F.array_contains("m", p["model_a"]) & F.array_contains("m", p["model_b"]))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    every = scores.sparkSession.range(1).select(F.explode(grid).alias("q"))
    return every.join(each, F.col("q") == F.col("p"), "left").select("q.model_a", "q.model_b", F.coalesce("n", F.lit(0)).alias("n_both"))


def overlap_matrix(overlap: DataFrame, models: list[str]) -> DataFrame:
    return overlap.groupBy("model_a").pivot("model_b", models).agg(F.first("n_both"))


def class_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model_id", "class").agg(F.count("*").alias("count"))


def corpus_scores(pairs: DataFrame, normalize=text.normalize_basic) -> DataFrame:
    """Micro-averaged rates of each model and its S, I and D totals. pairs: (model_id, ref, hyp)."""
    ship_code(pairs.sparkSession)
    x = pairs.select("model_id", normalize(F.col("ref")).alias("r"), normalize(F.col("hyp")).alias("h"))
    x = x.withColumn("c", alignment.edit_counts(text.tokens(F.col("r")), text.tokens(F.col("h")))).withColumn("wrong", alignment.char_distance(F.col("r"), F.col("h")))
    total = lambda e: F.sum(e).cast("long")
    sums = x.groupBy("model_id").agg(
        total(F.col("c.sub")).alias("substitutions"), total(F.col("c.ins")).alias("insertions"), total(F.col("c.del")).alias("deletions"),
        total(F.col("c.n_ref")).alias("n_ref"), total(F.col("wrong")).alias("chars_wrong"), total(F.length("r")).alias("chars"),
        F.round(F.avg(F.when(F.col("r") != F.col("h"), 1.0).otherwise(0.0)), 6).alias("ser"), F.count("*").alias("pairs"),
    )
    return sums.withColumn("wer", F.round((F.col("substitutions") + F.col("insertions") + F.col("deletions")) / F.greatest("n_ref", F.lit(1)), 6)).withColumn("cer", F.round(F.col("chars_wrong") / F.greatest("chars", F.lit(1)), 6))


def weighted_wer(pairs: DataFrame, weights: dict[str, float], default: float = 1.0, normalize=text.normalize_basic) -> DataFrame:
    """Error rate where a wrong word costs its weight: the reference's for substitutions and deletions, the hypothesis' for insertions."""
    ship_code(pairs.sparkSession)
    book = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    cost = lambda t: F.coalesce(F.try_element_at(book, t), F.lit(float(default)))
    x = pairs.select("model_id", alignment.edit_ops(text.tokens(normalize(F.col("ref"))), text.tokens(normalize(F.col("hyp")))).alias("ops"))
    add = lambda ops: F.aggregate(ops, F.lit(0.0), lambda s, o: s + cost(F.coalesce(o["ref"], o["hyp"])))
    x = x.select("model_id", add(F.filter("ops", lambda o: o["op"] != "correct")).alias("wrong"), add(F.filter("ops", lambda o: o["op"] != "ins")).alias("all"))
    return x.groupBy("model_id").agg(F.round(F.sum("wrong") / F.greatest(F.sum("all"), F.lit(1.0)), 6).alias("werd"))
