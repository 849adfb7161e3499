"""A stream of hypotheses scored as they come: an addition to the batch operators, on the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.operators import errors


def score_stream(hypotheses: DataFrame, refs: DataFrame) -> DataFrame:
    """Per-utterance scores of a streaming (model_id, utt_id, hyp) against static references; stateless."""
    return errors.per_utterance(hypotheses.join(refs, "utt_id"))


def rolling_leaderboard(scores: DataFrame, ts: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean error rate of each model by event-time window; rows later than ``late`` drop."""
    w = scores.withWatermark(ts, late).groupBy(F.window(ts, window), "model_id")
    return w.agg(F.count("*").alias("count"), F.avg("wer").alias("wer"), F.avg("cer").alias("cer"))
