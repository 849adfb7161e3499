"""Whole workloads: error analysis, corpus scoring, selection of hard examples, the first training stage's mix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from speechlake.operators import errors, manifests, mixing, selection


@dataclass
class ErrorAnalysis:
    """Everything an analysis of several models' errors gives; all lazy, over one cached score table."""

    scores: DataFrame
    models: DataFrame
    confusions: DataFrame
    totals: DataFrame
    shares: DataFrame
    disagreement: DataFrame
    baseline: DataFrame
    overlap: DataFrame


def analyze_errors(refs: DataFrame, preds: DataFrame, models: list[str], sim: DataFrame | None = None, sample: int | None = None, seed: int = 42) -> ErrorAnalysis:
    """refs: (utt_id, ref); preds: (model_id, utt_id, hyp). sample: so many utterances that every model has."""
    if sample is not None:
        keys = selection.seeded_sample(errors.key_intersection(refs, preds, models), sample, seed, "utt_id")
        if keys.isEmpty():
            raise ValueError("no utterance is in the references and in every model's predictions")
        refs = refs.join(keys, "utt_id", "left_semi")
    scores = errors.per_utterance(errors.pair_with_models(refs, preds, models), sim, with_ops=True).cache()
    board, totals = errors.leaderboard(scores), errors.taxonomy_totals(scores)
    return ErrorAnalysis(scores, board, errors.top_confusions(scores), totals, errors.taxonomy_share(totals), errors.disagreement(scores), errors.baseline_deltas(board), errors.error_overlap(scores, models))


def score_corpus(refs: DataFrame, preds: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Micro-averaged rates of each model over what it has; with weights also the weighted rate."""
    pairs = errors.matched_pairs(refs, preds)
    if pairs.isEmpty():
        raise ValueError("no matching keys")
    out = errors.corpus_scores(pairs)
    return out if weights is None else out.join(errors.weighted_wer(pairs, weights), "model_id")


def stage1_mix(manifests_by_source: dict[str, DataFrame], preds: DataFrame, target: int, ratios: dict[str, float] | None = None, seed: int = 42, **limits: float) -> DataFrame:
    """Filter every source's manifest by quality, then mix by ratio. Non-speech is not filtered."""
    kept = {}
    for name, df in manifests_by_source.items():
        kept[name] = df if name == "nonspeech" else manifests.quality_filter(df, preds, **limits)
    shares = ratios or mixing.stage1_ratios(list(kept))
    missing = set(kept) - set(shares)
    if missing:
        raise ValueError(f"no ratio for {sorted(missing)}")
    rows = mixing.concat_tagged(kept)
    return mixing.ratio_mix(rows, "dataset", shares, target, "audio_filepath", seed)
