"""Commands over files: python -m speechlake.cli COMMAND ... (JSONL and CSV outputs are folders of part files)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.operators import errors, inference, manifests, mixing, selection
from speechlake.plans import workloads
from speechlake.session import local_session
from speechlake.sources import readers, writers


def _refs(spark: SparkSession, path: str, analyzer: bool = False, strings_only: bool = False) -> DataFrame:
    return readers.read_references(spark, path, analyzer, strings_only).withColumnRenamed("text", "ref")


def _manifest(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """A manifest's rows that have a key, with all their fields."""
    return readers.read_manifest(spark, path, fields).where("audio_filepath is not null")


def analyze(spark, a):
    preds = readers.parse_inputs(a.pred)
    run = workloads.analyze_errors(_refs(spark, a.reference, analyzer=True), readers.read_predictions(spark, preds), list(preds), sample=a.sample or None, seed=a.seed)
    out = a.outdir.rstrip("/")
    scores = run.scores.drop("ref", "hyp") if a.no_ner else inference.recognize_names(run.scores, "hyp").withColumn("ner_count", F.size("entities")).drop("ref", "hyp", "entities")
    from speechlake.functions.text import flatten_confusions

    writers.write_csv(scores.withColumn("confusions", flatten_confusions(F.col("confusions"))), f"{out}/per_utterance")
    for name, df in (("models", run.models), ("top_confusions", run.confusions), ("disagreement", run.disagreement), ("models_with_baseline", run.baseline), ("error_overlap", run.overlap)):
        writers.write_csv(df, f"{out}/{name}")
    writers.write_report(out, run.models, run.confusions, run.shares)
    writers.heatmap(errors.overlap_matrix(run.overlap, list(preds)), f"{out}/overlap.png")
    print(writers.console(run.models))


def evaluate(spark, a):
    preds = readers.parse_inputs(a.predictions)
    weights = None
    if a.weights:
        with open(a.weights, encoding="utf-8") as f:
            given = json.load(f)
        weights = given if isinstance(given, dict) else {k: v for x in given for k, v in x.items()}
    print(writers.console(workloads.score_corpus(_refs(spark, a.references), readers.read_predictions(spark, preds), weights if weights is not None else {} if a.werd else None)))


def finetune(spark, a):
    """Worst segments within a budget of hours. durations: JSON map from keys to seconds; without it headers of audio files are read."""
    pairs = errors.matched_pairs(_refs(spark, a.references), readers.read_predictions(spark, {"m": a.predictions}))
    scores = errors.segment_metrics(pairs).select("utt_id", "wer", "cer", "ref", "hyp")
    if a.durations:
        seconds = readers.read_json_map(spark, a.durations, "utt_id", "duration").withColumn("duration", F.expr("try_cast(duration as double)"))
    else:
        seconds = inference.named_durations(readers.audio_paths(spark, a.audio_dir)).select(F.col("audio_filepath").alias("utt_id"), "duration")
    taken = selection.hours_budget(scores.join(seconds, "utt_id", "left"), a.hours)
    writers.write_jsonl(taken.select(F.col("utt_id").alias("audio"), F.col("ref").alias("reference"), F.col("hyp").alias("prediction"), "wer", "cer", "duration"), a.output)
    print(writers.console(selection.total_hours(taken)))


def hardest(spark, a):
    refs = _refs(spark, a.ref, strings_only=True)
    if a.scores:
        scores = readers.read_scores(spark, a.scores, a.model_id)
    else:
        scores = errors.per_utterance(errors.pair_with_models(refs, readers.read_predictions(spark, {a.model_id: a.pred}), [a.model_id])).select("utt_id", "model_id", "wer", "cer", "sim")
    group = None
    if a.group_key:
        group = "_group"  # whatever the field's name, it can't clash with a score's
        named = _manifest(spark, a.ref, a.group_key).select(F.col("audio_filepath").alias("utt_id"), F.col(f"`{a.group_key}`").alias(group), "ord")
        scores = scores.join(mixing.dedup_last(named, "utt_id", "ord").select("utt_id", group), "utt_id", "left")
    noise = _manifest(spark, a.nonspeech) if a.nonspeech else None
    out = selection.selection(scores, refs.select("utt_id", F.col("utt_id").alias("audio_filepath"), F.col("ref").alias("text")), a.bottom_q, a.easy_ratio, None if noise is None else noise.select("audio_filepath", "text"), a.nonspeech_ratio, group, a.seed)
    # the rows' other fields come back from where they were
    whole = [mixing.dedup_last(rows.select(F.col("audio_filepath").alias("_key"), "raw", "ord"), "_key", "ord").select("_key", "raw", F.lit(kind).alias("_noise")) for rows, kind in ((_manifest(spark, a.ref) if a.ref.endswith(".jsonl") else None, False), (noise, True)) if rows is not None]
    if not whole:
        out = out.withColumn("raw", F.lit(None).cast("string"))
    else:
        known = whole[0] if len(whole) == 1 else whole[0].unionByName(whole[1])
        out = out.join(known, (F.col("audio_filepath") == F.col("_key")) & ((F.col("difficulty") == "nospeech") == F.col("_noise")), "left")
    print(writers.write_rows(out, a.out, ("audio_filepath", "text", "difficulty", "wer", "cer")), "rows")


def build(spark, a):
    rows = readers.read_splits(spark, a.data_dir, a.split)
    keep = [c for c in ("duration",) if c in rows.columns]
    if a.audio_col and a.text_col:
        out = manifests.map_custom(rows, a.audio_col, a.text_col, keep)
    else:
        out = manifests.choose_mapper(a.data_dir, a.mapper)(rows, keep)
    if a.drop_empty:
        out = manifests.drop_empty(out)
    if a.min_sec is not None or a.max_sec is not None:
        out = manifests.duration_filter(out if "duration" in out.columns else out.withColumn("duration", F.lit(None).cast("double")), a.min_sec, a.max_sec)
    if a.max_rows:
        out = mixing.limit_rows(out, a.max_rows, "audio_filepath")
    print(writers.write_jsonl(out, a.out), "rows")


def cache(spark, a):
    rows = readers.read_arrow_shards(spark, a.dataset_dir).cache()
    for r in rows.groupBy("split").count().collect():
        writers.write_jsonl(rows.where(F.col("split") == r["split"]).drop("split"), f"{a.out_dir}/{r['split']}.jsonl")
        print(r["split"], r["count"])


def mix(spark, a):
    sources = {k: readers.read_manifest(spark, p) for k, p in readers.parse_inputs(a.inputs).items()}
    rows = mixing.concat_tagged(sources)
    if a.target_size:
        ratios = mixing.parse_ratios(a.ratios.split(",")) if a.ratios else mixing.stage1_ratios(list(sources)) if a.stage1 else None
        if ratios is None or set(sources) - set(ratios):
            raise SystemExit("every source needs a ratio")
        numbered = {name: k for k, name in enumerate(sources)}
        names = F.create_map(*[F.lit(x) for name, k in numbered.items() for x in (k, name)])
        rows = mixing.ratio_mix(rows.withColumn("_from", names[F.col("src_no")]), "_from", ratios, a.target_size, "audio_filepath", a.seed).drop("rn", "_from")
    else:
        rows = rows.orderBy("src_no", "ord")
    print(writers.write_rows(rows, a.out, ("dataset",)), "rows")


def split(spark, a):
    rows = readers.read_manifest(spark, a.inp, (a.group_key,) if a.group_key else ())
    if a.group_key:
        rows = rows.withColumn(a.group_key, F.coalesce(F.col(f"`{a.group_key}`"), F.lit("")))
    done = (mixing.stratified_split(rows, a.group_key, a.val_ratio, "audio_filepath", a.seed) if a.group_key else mixing.random_split(rows, a.val_ratio, "audio_filepath", a.seed)).cache()
    for name, path in (("train", a.train), ("val", a.val)):
        print(name, writers.write_rows(done.where(F.col("split") == name), path))


def filter_(spark, a):
    preds = readers.read_json_map(spark, a.pred, "audio_filepath", "pred_text")
    kept = manifests.quality_filter(_manifest(spark, a.manifest), preds, a.max_wer, a.min_dur, a.max_dur)
    print(writers.write_rows(kept, a.out, ("wer",)), "rows")


def pack(spark, a):
    """The renaming plan and the manifest that follows it; copying files is left to the store's own tools."""
    out = a.out_dir.rstrip("/")
    named = manifests.pack_rename(_manifest(spark, a.input), "ord", readers.file_names(spark, out))
    writers.write_csv(named.select("audio_filepath", "packed_name"), f"{out}/plan")
    print(writers.write_rows(named.withColumn("audio_filepath", F.concat(F.lit(out + "/"), "packed_name")), f"{out}/manifest.jsonl", ("audio_filepath",), ("audio",)), "rows")


def cuts(spark, a):
    rows = _manifest(spark, a.manifest)
    print(writers.write_cuts(manifests.cut_manifest(rows.where("duration is not null"), "ord", a.base), a.out), "cuts")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="speechlake", description=__doc__)
    subs = top.add_subparsers(required=True)

    def command(name, run, *args):
        p = subs.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for flags, options in args:
            p.add_argument(*flags.split(), **options)
        p.set_defaults(run=run)

    many, on, seed = {"action": "append", "default": []}, {"action": "store_true"}, ("--seed", {"type": int, "default": 42})
    need, num = {"required": True}, lambda v: {"type": float, "default": v}
    command("analyze-errors", analyze, ("reference", {}), ("--pred", many), ("--outdir", {"default": "analysis"}), ("--sample", {"type": int, "default": 0}), ("--no_ner", on), seed)
    command("evaluate", evaluate, ("references", {}), ("predictions", {"nargs": "+"}), ("--werd", on), ("--weights", {}))
    command("select-finetune", finetune, ("references", {}), ("predictions", {}), ("--hours", num(1.0)), ("--output", need), ("--durations", {}), ("--audio_dir", {"default": "."}))
    command("select-hardest", hardest, ("--ref", need), ("--pred", {}), ("--scores", {}), ("--out", need), ("--model_id", {"default": "canary"}), ("--bottom_q", num(0.25)), ("--easy_ratio", num(0.15)), ("--nonspeech", {}), ("--nonspeech_ratio", num(0.03)), ("--group_key", {}), seed)
    command("build-manifest", build, ("--data_dir", need), ("--split", {"default": "train"}), ("--out", need), ("--audio_col", {}), ("--text_col", {}), ("--mapper", {"choices": ["generic", "common_voice"]}), ("--drop_empty", on), ("--min-sec", {"type": float}), ("--max-sec", {"type": float}), ("--max-rows", {"type": int}))
    command("cache-to-manifest", cache, ("--dataset_dir", need), ("--out_dir", {"default": "data"}))
    command("mix", mix, ("--in", {"dest": "inputs", "action": "append", "required": True}), ("--out", need), ("--target_size", {"type": int}), ("--ratios", {}), ("--stage1", on), seed)
    command("split", split, ("--in", {"dest": "inp", "required": True}), ("--train", need), ("--val", need), ("--val_ratio", num(0.1)), ("--group_key", {}), seed)
    command("filter", filter_, ("--manifest", need), ("--pred", need), ("--out", need), ("--max_wer", num(0.15)), ("--min_dur", num(1.0)), ("--max_dur", num(35.0)))
    command("pack", pack, ("--input", need), ("--out_dir", {"default": "packed"}))
    command("cuts", cuts, ("--manifest", need), ("--out", need), ("--base", {"default": ""}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    own = spark or SparkSession.getActiveSession() or local_session()
    a.run(own, a)


if __name__ == "__main__":
    main()
