"""The registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake import sql as S
from speechlake.functions import alignment, text
from speechlake.operators import errors, inference, manifests, mixing, ranking, selection
from speechlake.plans import harness, workloads
from speechlake.session import ship_code
from speechlake.sources import readers
from speechlake.streaming import scoring

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
MODELS = list(harness.MODELS)


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _utt(spark: SparkSession, d: str) -> DataFrame:
    return harness.utterances(spark, d)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    utt = _utt(spark, d)
    return errors.pair_with_models(utt, harness.predictions(utt), MODELS)


def _scores(spark: SparkSession, d: str, with_ops: bool = False) -> DataFrame:
    return errors.per_utterance(_pairs(spark, d), harness.similarity(spark, d), with_ops)


def _matched(spark: SparkSession, d: str) -> DataFrame:
    utt = _utt(spark, d)
    return errors.matched_pairs(utt, harness.predictions(utt))


def _m1(spark: SparkSession, d: str) -> DataFrame:
    """Scores of one model, what selection works on."""
    utt = _utt(spark, d)
    one = errors.pair_with_models(utt, harness.predictions(utt).where("model_id = 'm1'"), ["m1"])
    return errors.per_utterance(one, harness.similarity(spark, d)).select("utt_id", "model_id", "dataset", "lang", "duration", "wer", "cer", "sim")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return harness.manifest(_utt(spark, d))


_ALL = (S.UTT, S.PREDS, S.PAIRS, S.SIM, S.SCORES)
_OPS = (S.UTT, S.PREDS, S.PAIRS, S.OPS, S.ops())
_CLASSED = f"classed AS (SELECT *, {S.CLASS} AS class FROM scores)"
_M1 = f"""m1 AS (SELECT utt_id, model_id, dataset, lang, duration, wer, cer, sim FROM scores WHERE model_id = 'm1')"""
_SEL = (S.UTT, S.PREDS, S.PAIRS, S.SIM, S.SCORES, _M1)
_HARD_ORDER = "wer DESC, cer DESC, coalesce(sim, 0.0) ASC, utt_id ASC"


# ------------------------------------------------------------------ harness views


@query(S.with_(S.UTT) + "SELECT utt_id, ref, dataset, lang, round(duration, 6) AS duration FROM utt")
def utt_view(spark, d):
    return _utt(spark, d).withColumn("duration", F.round("duration", 6))


@query(S.with_(S.UTT, S.PREDS) + "SELECT model_id, utt_id, hyp FROM preds")
def preds_view(spark, d):
    return harness.predictions(_utt(spark, d))


# ------------------------------------------------------------------ sources


def _lines(spark, d):
    """The utterances as manifest lines, a mark before the first; every 40th line is malformed."""
    utt = _utt(spark, d)
    row = F.to_json(F.struct(F.concat(F.lit("a/"), F.col("utt_id").cast("string")).alias("audio"), F.col("ref").alias("text"), "dataset"))
    value = F.when(F.col("utt_id") % 40 == 7, F.concat(row, F.lit("}}{"))).otherwise(row)
    return utt.select(F.when(F.col("utt_id") == 0, F.concat(F.lit("﻿"), value)).otherwise(value).alias("value"), F.col("utt_id").alias("line_no"))


@query(S.with_(S.UTT) + "SELECT utt_id AS line_no, 'a/' || CAST(utt_id AS VARCHAR) AS key, ref AS text, dataset FROM utt WHERE utt_id % 40 <> 7")
def scan_manifest(spark, d):
    lines = _lines(spark, d).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    rows = readers.parse_jsonl(lines, strict=False)
    return rows.select("line_no", manifests.manifest_key(rows).alias("key"), "text", "dataset")


@query(S.with_(S.UTT) + "SELECT dataset AS key, arg_max(ref, utt_id) AS text, min(utt_id) AS first_at FROM utt GROUP BY dataset")
def dedup_last_wins(spark, d):
    rows = _utt(spark, d).select(F.col("dataset").alias("key"), F.col("ref").alias("text"), F.col("utt_id").alias("line_no"))
    return mixing.dedup_last(rows, "key", "line_no").select("key", "text", "first_at")


@query(S.with_(*_ALL) + "SELECT CAST(utt_id AS VARCHAR) AS utt_id, model_id, CASE WHEN utt_id % 9 = 0 THEN 0.0 ELSE wer END AS wer, cer, CASE WHEN utt_id % 6 = 0 THEN NULL ELSE sim END AS sim FROM scores WHERE model_id = 'm2' AND utt_id % 14 <> 3")
def scan_scores(spark, d):
    k = F.col("utt_id")
    scores = errors.per_utterance(_pairs(spark, d).where("model_id = 'm2'"), harness.similarity(spark, d))  # what isn't read isn't scored
    raw = scores.select(
        k.cast("string").alias("utt_id"), F.concat(F.lit(" "), "model_id").alias("model_id"), F.when(k % 14 == 3, "n/a").when(k % 9 == 0, "").otherwise(F.col("wer").cast("string")).alias("wer"),
        F.col("cer").cast("string").alias("cer"), F.when(k % 12 == 0, "None").when(k % 6 == 0, "").otherwise(F.col("sim").cast("string")).alias("sim"),
    )
    return readers.typed_scores(raw, "m2")


@query("SELECT lang, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents) GROUP BY lang")
def scan_union_splits(spark, d):
    return readers.read_splits(spark, d, "documents+documents").groupBy("lang").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


_PATHS = "'cache/' || CASE utt_id % 6 WHEN 0 THEN 'default/train-00000' WHEN 1 THEN 'dev/x' WHEN 2 THEN 'latest/x' WHEN 3 THEN 'a/b' WHEN 4 THEN 'train/validation' ELSE 'Test/part' END || '.arrow'"


@query(S.with_(S.UTT) + f"SELECT utt_id, {_PATHS} AS path, CASE utt_id % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' WHEN 3 THEN NULL WHEN 4 THEN 'validation' ELSE 'test' END AS split FROM utt")
def guess_split(spark, d):
    k = F.col("utt_id") % 6
    part = F.when(k == 0, "default/train-00000").when(k == 1, "dev/x").when(k == 2, "latest/x").when(k == 3, "a/b").when(k == 4, "train/validation").otherwise("Test/part")
    return _utt(spark, d).select("utt_id", F.concat(F.lit("cache/"), part, F.lit(".arrow")).alias("path")).withColumn("split", manifests.guess_split(F.col("path")))


@query(S.with_(S.UTT, S.MANIFEST) + "SELECT utt_id, CASE WHEN utt_id % 4 = 0 THEN '/abs/' || audio_filepath ELSE '/base/dir/' || audio_filepath END AS path FROM manifest")
def resolve_paths(spark, d):
    given = F.when(F.col("utt_id") % 4 == 0, F.concat(F.lit("/abs/"), "audio_filepath")).otherwise(F.col("audio_filepath"))
    return _manifest(spark, d).select("utt_id", manifests.resolve_path(given, "/base/dir/").alias("path"))


# ------------------------------------------------------------------ projections and filters


def _mixed(spark, d):
    """A manifest whose path and text lie in differing columns."""
    k = F.col("utt_id")
    return _manifest(spark, d).select(
        "utt_id", F.struct(F.when(k % 3 == 0, F.col("audio_filepath")).otherwise(F.lit("")).alias("path"), F.lit(16000).alias("sampling_rate")).alias("audio"),
        F.when(k % 3 == 1, F.col("audio_filepath")).alias("file"), F.when(k % 4 == 0, F.col("text")).otherwise(F.lit("  ")).alias("sentence"), F.when(k % 4 == 1, F.concat(F.lit(" "), "text")).alias("transcript"),
    )


_MIXED = "mixed AS (SELECT utt_id, CASE WHEN utt_id % 3 IN (0, 1) THEN audio_filepath END AS audio_filepath, CASE WHEN utt_id % 4 IN (0, 1) THEN trim(text) ELSE '' END AS text FROM manifest)"


@query(S.with_(S.UTT, S.MANIFEST, _MIXED) + "SELECT utt_id, audio_filepath, text FROM mixed")
def coalesce_fields(spark, d):
    rows = _mixed(spark, d)
    return rows.select("utt_id", manifests.audio_path(rows).alias("audio_filepath"), manifests.transcript(rows).alias("text"))


@query(S.with_(S.UTT, S.MANIFEST, _MIXED) + "SELECT utt_id, audio_filepath, text FROM mixed WHERE audio_filepath IS NOT NULL")
def map_generic(spark, d):
    return manifests.map_generic(_mixed(spark, d), ["utt_id"])


@query(S.with_(S.UTT) + "SELECT 0 AS src_no, utt_id, 'main' AS dataset FROM utt WHERE lang = 'en' UNION ALL SELECT 1, utt_id, coalesce(CASE WHEN utt_id % 2 = 0 THEN dataset END, 'other') FROM utt WHERE lang = 'de'")
def concat_tagged(spark, d):
    utt = _utt(spark, d)
    main = utt.where("lang = 'en'").select("utt_id")
    other = utt.where("lang = 'de'").select("utt_id", F.when(F.col("utt_id") % 2 == 0, F.col("dataset")).alias("dataset"))
    return mixing.concat_tagged({"main": main, "other": other}).select("src_no", "utt_id", "dataset")


@query(S.with_(S.UTT, S.MANIFEST) + "SELECT utt_id, text FROM manifest WHERE trim(text) <> ''")
def drop_empty(spark, d):
    return manifests.drop_empty(_manifest(spark, d)).select("utt_id", "text")


@query(S.with_(S.UTT, S.MANIFEST) + "SELECT utt_id, round(duration, 6) AS duration FROM manifest WHERE duration IS NULL OR (duration >= 5 AND duration <= 20)")
def duration_filter(spark, d):
    return manifests.duration_filter(_manifest(spark, d), 5, 20).select("utt_id", F.round("duration", 6).alias("duration"))


@query(S.with_(S.UTT, S.MANIFEST) + "SELECT count(*) FILTER (WHERE NOT e AND NOT o) AS written, count(*) FILTER (WHERE e) AS skipped_empty, count(*) FILTER (WHERE o) AS skipped_dur FROM (SELECT trim(text) = '' AS e, trim(text) <> '' AND duration IS NOT NULL AND NOT duration BETWEEN 5 AND 20 AS o FROM manifest)")
def build_counters(spark, d):
    return manifests.build_counters(_manifest(spark, d), 5, 20)


def _clips(spark, d):
    """A manifest with a path for each utterance, and m1's predictions by path."""
    utt = _utt(spark, d)
    rows = harness.manifest(utt).withColumn("audio_filepath", F.concat(F.lit("c/"), F.col("utt_id").cast("string")))
    preds = harness.predictions(utt).where("model_id = 'm1'").select(F.concat(F.lit("c/"), F.col("utt_id").cast("string")).alias("audio_filepath"), F.when(F.col("utt_id") % 8 == 0, "").otherwise(F.col("hyp")).alias("pred_text"))
    return rows, preds


_FILTERED = f"""filtered AS (SELECT utt_id, dataset, text, duration, pred_text, round((e // 1000000000000) / greatest(1, len(r)), 6) AS wer FROM (
  SELECT *, {S.edits('r', 'h')} AS e FROM (SELECT m.utt_id, m.dataset, m.text, m.duration, p.hyp AS pred_text, {S.tokens('m.text')} AS r, {S.tokens('p.hyp')} AS h
    FROM manifest m JOIN preds p ON p.utt_id = m.utt_id AND p.model_id = 'm1' WHERE m.duration BETWEEN 1 AND 35 AND m.text <> '' AND p.hyp <> '' AND m.utt_id % 8 <> 0)))"""


@query(S.with_(S.UTT, S.PREDS, S.MANIFEST, _FILTERED) + "SELECT utt_id, text, pred_text, wer FROM filtered WHERE wer <= 0.18")
def quality_filter(spark, d):
    rows, preds = _clips(spark, d)
    return manifests.quality_filter(rows, preds, 0.18).select("utt_id", "text", "pred_text", "wer")


@query(S.with_(S.UTT, S.MANIFEST) + "SELECT utt_id, audio_filepath FROM manifest WHERE CAST(substr(dataset, 4) AS INTEGER) % 3 = 1")
def missing_audio(spark, d):
    rows = _manifest(spark, d)
    listed = rows.where(F.substring("dataset", 4, 9).cast("int") % 3 != 1).select(F.col("audio_filepath").alias("path")).distinct()
    written = rows.withColumn("audio_filepath", F.when(F.col("utt_id") % 5 == 0, F.replace("audio_filepath", F.lit("/"), F.lit("\\"))).otherwise(F.col("audio_filepath")))
    return manifests.missing_audio(written, listed).select("utt_id", F.replace("audio_filepath", F.lit("\\"), F.lit("/")).alias("audio_filepath"))


# ------------------------------------------------------------------ joins


@query(S.with_(S.UTT, S.PREDS, S.PAIRS) + "SELECT utt_id, model_id, ref, hyp FROM pairs")
def left_join_missing(spark, d):
    return _pairs(spark, d).select("utt_id", "model_id", "ref", "hyp")


@query(S.with_(S.UTT, S.PREDS) + "SELECT utt.utt_id, model_id, ref, hyp FROM utt JOIN preds USING (utt_id)")
def inner_join_scored(spark, d):
    return _matched(spark, d).select("utt_id", "model_id", "ref", "hyp")


@query(S.with_(S.UTT, S.PREDS) + "SELECT utt_id FROM preds GROUP BY utt_id HAVING count(DISTINCT model_id) = 3")
def key_intersection(spark, d):
    utt = _utt(spark, d)
    return errors.key_intersection(utt, harness.predictions(utt), MODELS)


@query(S.with_(S.UTT, S.PREDS) + "SELECT utt_id, arg_max(hyp, CASE model_id WHEN 'm1' THEN 0 WHEN 'm2' THEN 1 ELSE 2 END) AS hyp FROM preds GROUP BY utt_id")
def shard_merge(spark, d):
    shard = F.when(F.col("model_id") == "m1", 0).when(F.col("model_id") == "m2", 1).otherwise(2)
    return mixing.shard_merge(harness.predictions(_utt(spark, d)).withColumn("shard_idx", shard))


# ------------------------------------------------------------------ text functions


@query(S.with_(S.UTT) + f"SELECT utt_id, {S.basic('ref')} AS norm FROM utt")
def normalize_basic(spark, d):
    return _utt(spark, d).select("utt_id", text.normalize_basic(F.col("ref")).alias("norm"))


@query(S.with_(S.UTT) + f"SELECT utt_id, {S.advanced('ref')} AS norm FROM utt")
def normalize_advanced(spark, d):
    return _utt(spark, d).select("utt_id", text.normalize_advanced(F.col("ref")).alias("norm"))


@query(S.with_(S.UTT) + f"SELECT utt_id, CAST(len({S.tokens('ref')}) AS INTEGER) AS n FROM utt")
def token_counts(spark, d):
    return _utt(spark, d).select("utt_id", F.size(text.tokens(F.col("ref"))).alias("n"))


_CATEGORY = r"CASE WHEN regexp_full_match(t, '[+-]?\d+[\d\s,.]*') THEN 'number' WHEN regexp_full_match(t, '\p{L}+\.?') AND t = upper(t) AND t <> lower(t) THEN 'abbr' WHEN regexp_matches(t, '[A-Za-z]') THEN 'latin' ELSE 'word' END"


@query(rf"SELECT category, count(*) AS n, count(DISTINCT t) AS distinct_tokens FROM (SELECT t, {_CATEGORY} AS category FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS t FROM documents UNION ALL SELECT unnest(['12', '+7', '3,5', 'NASA.', 'nasa', 'covid19', 'дом', 'США']) AS t)) GROUP BY category")
def token_category(spark, d):
    docs = harness.table(spark, d, "documents").select(F.explode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("t"))
    extra = spark.createDataFrame([(x,) for x in ("12", "+7", "3,5", "NASA.", "nasa", "covid19", "дом", "США")], "t string")
    distinct = docs.union(extra).groupBy("t").agg(F.count("*").alias("n"))  # patterns are matched once for each distinct token
    return distinct.withColumn("category", text.token_category(F.col("t"))).groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_tokens"))


@query(S.with_(*_ALL, _CLASSED) + "SELECT utt_id, model_id, wer, sim, class FROM classed")
def classify_utt(spark, d):
    return _scores(spark, d).select("utt_id", "model_id", "wer", "sim", "class")


_NER = r"list_filter(list_filter(string_split(hyp, ' '), lambda t: t <> ''), lambda t: left(t, 1) <> lower(left(t, 1)) AND t <> upper(t))"


@query(S.with_(S.UTT, S.PREDS) + f"SELECT utt_id, model_id, CAST(len({_NER}) AS INTEGER) AS ner_count, array_to_string({_NER}, ' ') AS names FROM preds")
def ner_heuristic(spark, d):
    found = inference.recognize_names(harness.predictions(_utt(spark, d)), "hyp")
    return found.select("utt_id", "model_id", F.size("entities").alias("ner_count"), F.array_join(F.col("entities.text"), " ").alias("names"))


@query(S.with_(*_ALL) + "SELECT utt_id, model_id, ops_sub, ops_ins, ops_del, ops_correct, n_ref FROM scores")
def align_counts(spark, d):
    return _scores(spark, d).select("utt_id", "model_id", "ops_sub", "ops_ins", "ops_del", "ops_correct", "n_ref")


@query(S.with_(*_ALL) + "SELECT utt_id, model_id, CAST(ops_sub + ops_ins + ops_del AS BIGINT) AS distance FROM scores")
def native_word_distance(spark, d):
    p = _pairs(spark, d)
    r, h = (text.tokens(text.normalize_advanced(F.col(c))) for c in ("ref", "hyp"))
    return p.select("utt_id", "model_id", alignment.native_distance(r, h).alias("distance"))


@query(S.with_(*_OPS) + "SELECT utt_id, model_id, string_agg(op || ':' || coalesce(ref, '') || '>' || coalesce(hyp, ''), ' ' ORDER BY k) AS ops FROM (SELECT utt_id, model_id, CASE substr(p, k, 1) WHEN 'c' THEN 'correct' WHEN 's' THEN 'sub' WHEN 'd' THEN 'del' ELSE 'ins' END AS op, k, CASE WHEN substr(p, k, 1) <> 'i' THEN r[length(replace(left(p, k), 'i', ''))] END AS ref, CASE WHEN substr(p, k, 1) <> 'd' THEN h[length(replace(left(p, k), 'd', ''))] END AS hyp FROM (SELECT *, unnest(range(1, length(p) + 1)) AS k FROM paths)) GROUP BY utt_id, model_id")
def align_ops(spark, d):
    ship_code(spark)
    p = _pairs(spark, d)
    ops = alignment.edit_ops(*(text.tokens(text.normalize_advanced(F.col(c))) for c in ("ref", "hyp")))
    one = F.transform(ops, lambda o: F.concat(o["op"], F.lit(":"), F.coalesce(o["ref"], F.lit("")), F.lit(">"), F.coalesce(o["hyp"], F.lit(""))))
    return p.select("utt_id", "model_id", F.array_join(one, " ").alias("ops")).where("ops <> ''")


@query(S.with_(*_ALL) + "SELECT utt_id, model_id, cer FROM scores")
def per_utt_cer(spark, d):
    return _scores(spark, d).select("utt_id", "model_id", "cer")


@query(S.with_(*_ALL) + "SELECT utt_id, model_id, wer, cer, CAST(ser AS DOUBLE) AS ser FROM scores")
def per_utt_metrics(spark, d):
    return _scores(spark, d).select("utt_id", "model_id", "wer", "cer", "ser")


@query(S.with_(*_OPS) + "SELECT model_id, utt_id, string_agg(ref || '->' || hyp, ';' ORDER BY k) AS confusions FROM (SELECT model_id, utt_id, k, substr(p, k, 1) AS op, r[length(replace(left(p, k), 'i', ''))] AS ref, h[length(replace(left(p, k), 'd', ''))] AS hyp FROM (SELECT *, unnest(range(1, length(p) + 1)) AS k FROM paths)) WHERE op = 's' GROUP BY model_id, utt_id")
def per_utt_flat(spark, d):
    s = _scores(spark, d, with_ops=True)
    return s.where(F.size("confusions") > 0).select("model_id", "utt_id", text.flatten_confusions(F.col("confusions")).alias("confusions"))


_N1 = f"n1 AS (SELECT p.model_id, u.utt_id, {S.basic('u.ref')} AS rn, {S.basic('p.hyp')} AS hn FROM utt u JOIN preds p ON p.utt_id = u.utt_id)"
_C1 = f"c1 AS MATERIALIZED (SELECT *, CASE WHEN r = h THEN 0 ELSE {S.edits('r', 'h')} END AS e, {S.char_distance('rn', 'hn')} AS cd FROM (SELECT *, {S.tokens('rn')} AS r, {S.tokens('hn')} AS h FROM n1))"
_CORPUS = (S.UTT, S.PREDS, _N1, _C1)


@query(S.with_(*_CORPUS) + "SELECT utt_id, model_id, round((e // 1000000000000) / greatest(1, len(r)), 6) AS wer, round(cd / greatest(1, length(rn)), 6) AS cer FROM c1")
def segment_metrics(spark, d):
    return errors.segment_metrics(_matched(spark, d)).select("utt_id", "model_id", "wer", "cer")


@query(S.with_(S.SIM) + "SELECT utt_id, sim FROM sims")
def pair_cosine(spark, d):
    return harness.similarity(spark, d)


# ------------------------------------------------------------------ whole recordings: alignment of long texts, too slow in SQL, tested by brute force


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    whole = harness.recordings(spark, d)
    return errors.pair_with_models(whole, harness.predictions(whole), MODELS)


@query()
def recording_view(spark, d):
    return harness.recordings(spark, d).withColumn("duration", F.round("duration", 6))


@query()
def recording_align_counts(spark, d):
    return errors.per_utterance(_recordings(spark, d)).select("utt_id", "model_id", "ops_sub", "ops_ins", "ops_del", "ops_correct", "n_ref")


@query()
def recording_metrics(spark, d):
    return errors.per_utterance(_recordings(spark, d)).select("utt_id", "model_id", "wer", "cer", "ser")


@query()
def recording_corpus_scores(spark, d):
    whole = harness.recordings(spark, d)
    return errors.corpus_scores(errors.matched_pairs(whole, harness.predictions(whole)))


# ------------------------------------------------------------------ corpus scores


@query(S.with_(*_CORPUS) + "SELECT model_id, round(sum(e // 1000000000000) / greatest(sum(len(r)), 1), 6) AS wer FROM c1 GROUP BY model_id")
def corpus_wer(spark, d):
    return errors.corpus_scores(_matched(spark, d)).select("model_id", "wer")


@query(S.with_(*_CORPUS) + "SELECT model_id, round(sum(cd) / greatest(sum(length(rn)), 1), 6) AS cer FROM c1 GROUP BY model_id")
def corpus_cer(spark, d):
    return errors.corpus_scores(_matched(spark, d)).select("model_id", "cer")


@query(S.with_(*_CORPUS) + "SELECT model_id, round(avg(CASE WHEN rn <> hn THEN 1.0 ELSE 0.0 END), 6) AS ser FROM c1 GROUP BY model_id")
def corpus_ser(spark, d):
    return errors.corpus_scores(_matched(spark, d)).select("model_id", "ser")


@query(S.with_(*_CORPUS) + "SELECT model_id, CAST(sum((e // 100000000) % 10000) AS BIGINT) AS substitutions, CAST(sum(e % 10000) AS BIGINT) AS insertions, CAST(sum((e // 10000) % 10000) AS BIGINT) AS deletions FROM c1 GROUP BY model_id")
def corpus_sid(spark, d):
    return errors.corpus_scores(_matched(spark, d)).select("model_id", "substitutions", "insertions", "deletions")


_WEIGHT = "CASE coalesce(ref, hyp) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in harness.WEIGHTS.items()) + " ELSE 1.0 END"
_PATH1 = f"path1 AS MATERIALIZED (SELECT model_id, utt_id, r, h, CASE WHEN r = h THEN repeat('c', len(r)) ELSE substr({S.path('r', 'h')}, 5) END AS p FROM (SELECT *, {S.tokens('rn')} AS r, {S.tokens('hn')} AS h FROM n1))"


@query(S.with_(S.UTT, S.PREDS, _N1, _PATH1, S.ops("path1")) + f"SELECT model_id, round(sum(CASE WHEN op <> 'c' THEN {_WEIGHT} ELSE 0.0 END) / greatest(sum(CASE WHEN op <> 'i' THEN {_WEIGHT} ELSE 0.0 END), 1.0), 6) AS werd FROM ops GROUP BY model_id")
def weighted_wer(spark, d):
    return errors.weighted_wer(_matched(spark, d), harness.WEIGHTS)


@query(S.with_(S.SIM) + "SELECT round(avg(sim), 6) AS similarity, count(*) AS pairs FROM sims")
def mean_cosine(spark, d):
    return harness.similarity(spark, d).agg(F.round(F.avg("sim"), 6).alias("similarity"), F.count("*").alias("pairs"))


# ------------------------------------------------------------------ error analysis

_BOARD = "board AS (SELECT model_id, count(*) AS count, round(sum(wer) / count(*), 6) AS wer, round(sum(cer) / count(*), 6) AS cer, round(CAST(sum(ser) AS DOUBLE) / count(*), 6) AS ser, round(sum(coalesce(sim, 0.0)) / count(*), 6) AS sim FROM scores GROUP BY model_id)"


@query(S.with_(*_ALL, _BOARD) + "SELECT * FROM board")
def model_leaderboard(spark, d):
    return errors.leaderboard(_scores(spark, d))


@query(
    S.with_(*_ALL, _BOARD, "base AS (SELECT avg(wer) AS w, avg(cer) AS c, avg(ser) AS s, avg(sim) AS m FROM board)")
    + """SELECT board.*, round(CASE WHEN sqrt(wer * wer + cer * cer + ser * ser + sim * sim) * sqrt(w * w + c * c + s * s + m * m) = 0 THEN 1.0
  ELSE (wer * w + cer * c + ser * s + sim * m) / (sqrt(wer * wer + cer * cer + ser * ser + sim * sim) * sqrt(w * w + c * c + s * s + m * m)) END, 6) AS baseline_cosine,
  round(wer - w, 6) AS delta_wer, round(cer - c, 6) AS delta_cer, round(ser - s, 6) AS delta_ser FROM board CROSS JOIN base"""
)
def baseline_delta(spark, d):
    return errors.baseline_deltas(errors.leaderboard(_scores(spark, d)))


@query(S.with_(*_OPS) + "SELECT ref, hyp, count(*) AS count FROM ops WHERE op = 's' GROUP BY ref, hyp ORDER BY count DESC, ref, hyp LIMIT 100")
def confusions_topk(spark, d):
    return errors.top_confusions(_scores(spark, d, with_ops=True), 100)


_TOTALS = f"""totals AS (SELECT CAST(count(*) FILTER (WHERE op = 's') AS BIGINT) AS ops_sub, count(*) FILTER (WHERE op = 'i') AS ops_ins, count(*) FILTER (WHERE op = 'd') AS ops_del, count(*) FILTER (WHERE op = 'c') AS ops_correct,
  count(*) FILTER (WHERE category = 'number') AS cat_number, count(*) FILTER (WHERE category = 'abbr') AS cat_abbr, count(*) FILTER (WHERE category = 'latin') AS cat_latin, count(*) FILTER (WHERE category = 'word') AS cat_word
  FROM (SELECT op, {_CATEGORY} AS category FROM (SELECT op, coalesce(ref, hyp) AS t FROM ops)))"""


@query(S.with_(*_OPS, _TOTALS) + "SELECT * FROM totals")
def taxonomy_totals(spark, d):
    return errors.taxonomy_totals(_scores(spark, d, with_ops=True))


@query(S.with_(*_OPS, _TOTALS) + "SELECT round(ops_sub / greatest(ops_sub + ops_ins + ops_del + ops_correct, 1), 6) AS sub, round(ops_ins / greatest(ops_sub + ops_ins + ops_del + ops_correct, 1), 6) AS ins, round(ops_del / greatest(ops_sub + ops_ins + ops_del + ops_correct, 1), 6) AS del FROM totals")
def taxonomy_share(spark, d):
    return errors.taxonomy_share(errors.taxonomy_totals(_scores(spark, d, with_ops=True)))


@query(S.with_(*_ALL) + "SELECT utt_id, round(stddev_pop(wer), 6) AS std_wer, count(*) AS models, count(DISTINCT (model_id, wer)) AS distinct_scores FROM scores GROUP BY utt_id")
def disagreement(spark, d):
    return errors.disagreement(_scores(spark, d))


_WRONG = "wrong AS (SELECT utt_id, model_id FROM scores WHERE wer > 0), names AS (SELECT unnest(['m1', 'm2', 'm3']) AS m)"
_BOTH = "SELECT a.m AS model_a, b.m AS model_b, count(y.utt_id) AS n_both FROM names a CROSS JOIN names b LEFT JOIN wrong x ON x.model_id = a.m LEFT JOIN wrong y ON y.model_id = b.m AND y.utt_id = x.utt_id GROUP BY a.m, b.m"


@query(S.with_(*_ALL, _WRONG) + _BOTH)
def error_overlap(spark, d):
    return errors.error_overlap(_scores(spark, d), MODELS)


@query(S.with_(*_ALL, _WRONG, f"o AS ({_BOTH})") + "SELECT model_a, max(n_both) FILTER (WHERE model_b = 'm1') AS m1, max(n_both) FILTER (WHERE model_b = 'm2') AS m2, max(n_both) FILTER (WHERE model_b = 'm3') AS m3 FROM o GROUP BY model_a")
def overlap_matrix(spark, d):
    return errors.overlap_matrix(errors.error_overlap(_scores(spark, d), MODELS), MODELS)


@query(S.with_(*_ALL, _CLASSED) + "SELECT model_id, class, count(*) AS count FROM classed GROUP BY model_id, class")
def class_counts(spark, d):
    return errors.class_counts(_scores(spark, d))


_KEYS3 = "keys AS (SELECT utt_id FROM preds GROUP BY utt_id HAVING count(DISTINCT model_id) = 3)"


@query(S.with_(S.UTT, S.PREDS, _KEYS3) + "SELECT utt_id FROM keys ORDER BY md5('42|' || CAST(utt_id AS VARCHAR)), utt_id LIMIT 100")
def sample_intersection(spark, d):
    utt = _utt(spark, d)
    return selection.seeded_sample(errors.key_intersection(utt, harness.predictions(utt), MODELS), 100, 42, "utt_id")


# ------------------------------------------------------------------ selection

_HARD = f"hard AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_HARD_ORDER}) AS rn, count(*) OVER () AS n FROM m1) WHERE rn <= ceil(n * 0.2))"


@query(S.with_(*_SEL, _HARD) + "SELECT utt_id, wer, cer, sim FROM hard")
def hardest_global(spark, d):
    return selection.hardest(_m1(spark, d), 0.2).select("utt_id", "wer", "cer", "sim")


@query(S.with_(*_SEL) + f"SELECT dataset, utt_id, wer, cer FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_HARD_ORDER}) AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM m1) WHERE rn <= ceil(n * 0.25)")
def hardest_stratified(spark, d):
    return selection.hardest(_m1(spark, d), 0.25, "dataset").select("dataset", "utt_id", "wer", "cer")


_EASY = "easy AS (SELECT utt_id, wer, cer FROM (SELECT *, row_number() OVER (ORDER BY wer, cer, coalesce(-sim, 0.0), utt_id) AS rn FROM m1 WHERE utt_id NOT IN (SELECT utt_id FROM hard)) WHERE rn <= round_even((SELECT count(*) FROM hard) * 0.5, 0))"


@query(S.with_(*_SEL, _HARD, _EASY) + "SELECT * FROM easy")
def easy_pool(spark, d):
    scores = _m1(spark, d)
    return selection.easy_pool(scores, selection.hardest(scores, 0.2), 0.5).select("utt_id", "wer", "cer")


_PICK = """noise AS (SELECT 'p/' || CAST(page_id AS VARCHAR) AS audio_filepath FROM pages),
quiet AS (SELECT audio_filepath FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || audio_filepath), audio_filepath) AS rn FROM noise) WHERE rn <= round_even(((SELECT count(*) FROM hard) + (SELECT count(*) FROM easy)) * 0.1, 0))"""


@query(
    S.with_(*_SEL, _HARD, _EASY, _PICK)
    + """SELECT s.utt_id, 'f/' || CAST(s.utt_id AS VARCHAR) AS audio_filepath, u.ref AS text, s.difficulty, s.wer, s.cer
FROM (SELECT utt_id, wer, cer, 'hard' AS difficulty FROM hard UNION ALL SELECT utt_id, wer, cer, 'easy' FROM easy) s JOIN utt u ON u.utt_id = s.utt_id
UNION ALL SELECT NULL, audio_filepath, '', 'nospeech', NULL, NULL FROM quiet"""
)
def select_hardest(spark, d):
    refs = _utt(spark, d).select("utt_id", F.concat(F.lit("f/"), F.col("utt_id").cast("string")).alias("audio_filepath"), F.col("ref").alias("text"))
    noise = harness.table(spark, d, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("audio_filepath"), F.lit(None).cast("string").alias("text"))
    return selection.selection(_m1(spark, d), refs, 0.2, 0.5, noise, 0.1)


_SEGMENTS = "segments AS (SELECT utt_id, wer, CASE WHEN utt_id % 13 = 0 THEN NULL ELSE duration END AS duration FROM m1)"
_BUDGET = "budget AS (SELECT * FROM (SELECT *, coalesce(sum(coalesce(duration, 0.0)) OVER (ORDER BY wer DESC, utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM segments) WHERE before < 7200)"


def _segments(spark, d):
    return _m1(spark, d).select("utt_id", "wer", F.when(F.col("utt_id") % 13 == 0, None).otherwise(F.col("duration")).alias("duration"))


@query(S.with_(*_SEL, _SEGMENTS, _BUDGET) + "SELECT utt_id, wer, round(duration, 6) AS duration, round(before, 3) AS seconds_before FROM budget")
def hours_budget(spark, d):
    taken = selection.hours_budget(_segments(spark, d), 2.0)
    return taken.select("utt_id", "wer", F.round("duration", 6).alias("duration"), F.round("seconds_before", 3).alias("seconds_before"))


@query(S.with_(*_SEL, _SEGMENTS, _BUDGET) + "SELECT count(*) AS segments, round(coalesce(sum(duration), 0.0) / 3600, 6) AS hours FROM budget")
def selected_hours(spark, d):
    return selection.total_hours(selection.hours_budget(_segments(spark, d), 2.0))


# ------------------------------------------------------------------ mixing, splitting, sharding


@query(S.with_(S.UTT) + "SELECT utt_id, dataset, CASE WHEN rn <= round_even(n * 0.15, 0) THEN 'val' ELSE 'train' END AS split FROM (SELECT utt_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || CAST(utt_id AS VARCHAR)), utt_id) AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM utt)")
def stratified_split(spark, d):
    return mixing.stratified_split(_utt(spark, d).select("utt_id", "dataset"), "dataset", 0.15, "utt_id")


@query(S.with_(S.UTT) + "SELECT utt_id, CASE WHEN rn <= round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM (SELECT utt_id, row_number() OVER (ORDER BY md5('42|' || CAST(utt_id AS VARCHAR)), utt_id) AS rn, count(*) OVER () AS n FROM utt)")
def random_split(spark, d):
    return mixing.random_split(_utt(spark, d).select("utt_id"), 0.1, "utt_id")


@query(S.with_(S.UTT) + "SELECT utt_id, CAST((row_number() OVER (ORDER BY utt_id) - 1) % 4 AS INTEGER) AS shard FROM utt")
def round_robin_shard(spark, d):
    return mixing.round_robin(_utt(spark, d).select("utt_id"), 4, "utt_id")


@query(S.with_(S.UTT) + "SELECT utt_id, (row_number() OVER (ORDER BY utt_id) - 1) // 24 AS batch_id FROM utt")
def batch_ids(spark, d):
    return mixing.batch_ids(_utt(spark, d).select("utt_id"), 24, "utt_id")


@query(S.with_(S.UTT) + "SELECT utt_id, CAST(idx AS INTEGER) AS idx, CAST(idx * 14 AS DOUBLE) AS start, round(least(idx * 14 + 15, duration), 6) AS end FROM (SELECT utt_id, duration, unnest(range(0, CAST(greatest(ceil(duration / 14), 1) AS BIGINT))) AS idx FROM utt WHERE duration > 0)")
def sliding_chunks(spark, d):
    c = manifests.sliding_chunks(_utt(spark, d).select("utt_id", "duration"))
    return c.select("utt_id", "idx", F.col("start").cast("double").alias("start"), F.round("end", 6).alias("end"))


_MIX = {"en": 0.5, "de": 0.3, "fr": 0.2}


@query(
    """WITH c AS (SELECT lang AS dataset, count(*) AS available, row_number() OVER (ORDER BY lang) AS i FROM documents WHERE lang IS NOT NULL GROUP BY lang), t AS (SELECT sum(available) // 2 AS target FROM c),
p AS (SELECT *, CAST(round_even(sqrt(available) / (SELECT sum(sqrt(available)) FROM c) * target, 0) AS BIGINT) AS k FROM c JOIN t ON TRUE), d AS (SELECT any_value(target) - sum(k) AS rest FROM p)
SELECT dataset, available, CAST(k + CASE WHEN i <= abs(rest) THEN sign(rest) ELSE 0 END AS BIGINT) AS planned FROM p JOIN d ON TRUE"""
)
def mix_plan(spark, d):
    """Rows planned of each language for a mix of half the documents, by the roots of their counts."""
    counts = harness.table(spark, d, "documents").where("lang is not null").groupBy("lang").count()
    known = {r["lang"]: r["count"] for r in counts.orderBy("lang").collect()}  # a row for each name that a plan has
    plan = mixing.mix_plan(mixing.temperature_ratios(known), sum(known.values()) // 2) if known else {}
    return spark.createDataFrame([(k, known[k], n) for k, n in plan.items()], "dataset string, available long, planned long")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def limit_rows(spark, d):
    return mixing.limit_rows(harness.table(spark, d, "documents").select("doc_id", "lang"), 50, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 64")
def reservoir_sample(spark, d):
    return mixing.reservoir_sample(harness.table(spark, d, "documents").select("doc_id"), 64, "doc_id")


@query(S.with_(S.UTT) + "SELECT utt_id, lang FROM (SELECT utt_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || lang || '|' || CAST(utt_id AS VARCHAR)), utt_id) AS rn FROM utt) JOIN (VALUES ('en', 150), ('de', 90), ('fr', 60)) plan(lang, k) USING (lang) WHERE rn <= k")
def ratio_mix(spark, d):
    return mixing.ratio_mix(_utt(spark, d).select("utt_id", "lang"), "lang", _MIX, 300, "utt_id").select("utt_id", "lang")


_STAGE = {"en": "golos", "de": "cv", "fr": "ruls", "es": "nonspeech"}
_SHARES = mixing.stage1_ratios(list(_STAGE.values()))
_PLANNED = mixing.mix_plan(_SHARES, 200)
_STAGE_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE.items()) + " END"


@query(
    S.with_(S.UTT, S.PREDS, S.MANIFEST, _FILTERED, f"""kept AS (SELECT m.utt_id, {_STAGE_SQL} AS source FROM manifest m WHERE {_STAGE_SQL} = 'nonspeech' OR m.utt_id IN (SELECT utt_id FROM filtered WHERE wer <= 0.3))""")
    + "SELECT utt_id, source AS dataset FROM (SELECT utt_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || source || '|c/' || CAST(utt_id AS VARCHAR)), 'c/' || CAST(utt_id AS VARCHAR)) AS rn FROM kept) JOIN (VALUES "
    + ", ".join(f"('{k}', {n})" for k, n in _PLANNED.items())
    + ") plan(source, k) USING (source) WHERE rn <= k"
)
def stage1_mix(spark, d):
    rows, preds = _clips(spark, d)
    sources = {name: rows.where(F.col("lang") == lang).drop("dataset") for lang, name in _STAGE.items()}
    return workloads.stage1_mix(sources, preds, 200, max_wer=0.3).select("utt_id", "dataset")


@query(
    S.with_(S.UTT, S.MANIFEST, r"""files AS (SELECT utt_id, regexp_extract(audio_filepath, '([^/]+)\.[^.]+$', 1) AS stem, regexp_extract(audio_filepath, '(\.[^.]+)$', 1) AS ext FROM manifest)""")
    + "SELECT utt_id, stem || CASE WHEN n = 0 THEN '' ELSE '_' || lpad(CAST(n AS VARCHAR), 4, '0') END || ext AS packed_name FROM (SELECT *, row_number() OVER (PARTITION BY stem, ext ORDER BY utt_id) - 1 AS n FROM files)"
)
def pack_rename(spark, d):
    return manifests.pack_rename(_manifest(spark, d), "utt_id").select("utt_id", "packed_name")


@query(S.with_(S.UTT, S.MANIFEST) + "SELECT utt_id, rec AS recording_id, '/corpus/' || audio_filepath AS audio_filepath, rec || '-0' AS supervision_id, text, 'ru' AS language, 'yes' AS pnc FROM (SELECT *, 'r' || lpad(CAST(row_number() OVER (ORDER BY utt_id) AS VARCHAR), 8, '0') AS rec FROM manifest)")
def cut_manifest(spark, d):
    rows = _manifest(spark, d)
    cuts = manifests.cut_manifest(rows.withColumn("text", F.col("text")), "utt_id", "/corpus")
    named = ranking.row_numbers(rows.select("utt_id"), [F.col("utt_id")]).select("utt_id", F.format_string("r%08d", "rn").alias("recording_id"))
    return cuts.join(named, "recording_id").select("utt_id", "recording_id", "audio_filepath", F.col("supervision.id").alias("supervision_id"), F.col("supervision.text").alias("text"), F.col("supervision.language").alias("language"), F.col("supervision.custom.pnc").alias("pnc"))


# ------------------------------------------------------------------ model contract, extensions, streaming


@query(S.with_(S.UTT) + "SELECT CAST(utt_id AS VARCHAR) AS audio_filepath, reverse(ref) AS hyp FROM utt")
def speech_contract(spark, d):
    """A stand-in model (backwards) through the batch contract."""
    audio = _utt(spark, d).select(F.col("utt_id").cast("string").alias("audio_filepath"), F.col("ref").alias("content"))
    return inference.recognize_speech(audio, lambda: lambda batch: [x[::-1] for x in batch])


@query(S.with_(S.UTT) + f"SELECT min(utt_id) AS utt_id, {S.advanced('ref')} AS norm FROM utt GROUP BY norm")
def dedup_normalized(spark, d):
    rows = _utt(spark, d).select("utt_id", "ref")
    return mixing.dedup_normalized(rows, text.normalize_advanced(F.col("ref")), "utt_id").select("utt_id", text.normalize_advanced(F.col("ref")).alias("norm"))


@query(S.with_(S.UTT) + "SELECT dataset, lang, count(*) AS rows, round(sum(duration) / 3600, 6) AS hours, CAST(grouping_id(dataset, lang) AS BIGINT) AS level FROM utt GROUP BY CUBE (dataset, lang)")
def corpus_profile(spark, d):
    return mixing.profile(_utt(spark, d), ["dataset", "lang"])


@query(S.with_(S.UTT) + "SELECT utt_id, dataset FROM (SELECT utt_id, dataset, sum(duration) OVER (PARTITION BY dataset ORDER BY utt_id) AS s FROM utt) WHERE s <= 3600")
def speaker_cap(spark, d):
    return selection.speaker_cap(_utt(spark, d), "dataset", 3600, [F.col("utt_id").asc()]).select("utt_id", "dataset")


@query(S.with_(S.UTT) + "SELECT utt_id, CAST(floor(coalesce(sum(duration) OVER (ORDER BY utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / 180) AS BIGINT) AS bucket FROM utt")
def duration_buckets(spark, d):
    return mixing.duration_buckets(_utt(spark, d).select("utt_id", "duration"), 180, [F.col("utt_id").asc()]).select("utt_id", "bucket")


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS count, round(avg(value), 6) AS wer FROM events GROUP BY 1")
def rolling_leaderboard(spark, d):
    """The streaming leaderboard's windows over a bounded table: every event is one model's score."""
    events = harness.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("m").alias("model_id"), F.col("value").alias("wer"), F.col("value").alias("cer"))
    out = scoring.rolling_leaderboard(events, "ts", "1 hour")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "count", F.round("wer", 6).alias("wer"))
