"""Pieces of the DuckDB twins of the registered queries."""

from __future__ import annotations

import string

_PUNCT = string.punctuation.replace("'", "''")
#: Accented letters of the test texts, each to a capital, which lower-cased texts don't have: byte distance is then character distance.
_ACCENTS = "àâäáçéèêëíîïñóôöùúûüß"
_CAPITALS = string.ascii_uppercase[: len(_ACCENTS)]

UTT = r"""utt AS (SELECT utt_id, ref, dataset, lang, length(ref) / 16.0 AS duration FROM (
  SELECT doc_id * 1048576 + k AS utt_id, array_to_string(list_slice(toks, k * 24 + 1, k * 24 + 24), ' ') AS ref, dataset, lang FROM (
    SELECT doc_id, toks, dataset, lang, unnest(range(0, greatest(1, CAST(ceil(len(toks) / 24) AS BIGINT)))) AS k FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '') AS toks, source AS dataset, lang FROM documents))))"""
PREDS = r"""rules(model_id, a, b, c) AS (VALUES ('m1', 11, 13, 17), ('m2', 7, 9, 12), ('m3', 19, 23, 29)),
preds AS (SELECT model_id, utt_id, array_to_string(flatten(list_transform(list_filter(string_split(ref, ' '), lambda t: t <> ''), lambda t, i: list_concat(
    CASE WHEN (utt_id + i) % a = 0 THEN CAST([] AS VARCHAR[]) WHEN (3 * utt_id + i) % b = 0 THEN [t || 'x'] ELSE [t] END,
    CASE WHEN (utt_id + 2 * i) % c = 0 THEN ['uh'] ELSE CAST([] AS VARCHAR[]) END))), ' ') AS hyp
  FROM utt CROSS JOIN rules WHERE NOT (model_id = 'm3' AND utt_id % 10 = 0))"""
SIM = """sims AS (SELECT a.vec_id * 1048576 AS utt_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) + 1e-8), 6) AS sim
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
MANIFEST = """manifest AS (SELECT utt_id, 'data/' || dataset || '/clip' || CAST(utt_id % 50 AS VARCHAR) || CASE utt_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.flac' ELSE '.mp3' END AS audio_filepath,
  CASE WHEN utt_id % 17 = 0 THEN ' ' ELSE ref END AS text, dataset, lang, CASE WHEN utt_id % 13 = 0 THEN NULL ELSE duration / 10 END AS duration FROM utt)"""


def basic(x: str) -> str:
    return f"translate(lower({x}), '{_PUNCT}', '')"


def advanced(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(translate(coalesce({x}, ''), 'ёЁ', 'еЕ')), '\p{{P}}', '', 'g'), '\s\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def char_distance(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{_ACCENTS}', '{_CAPITALS}'), translate({b}, '{_ACCENTS}', '{_CAPITALS}'))"


def edits(r: str, h: str) -> str:
    """cost * 1e12 + substitutions * 1e8 + deletions * 1e4 + insertions of two lists; ties: diagonal, deletion, insertion."""
    p, sub, dele, ins = 10**12, 10**12 + 10**8, 10**12 + 10**4, 10**12 + 1
    d, e, f = f"acc[y[1]] + CASE WHEN {r}[x[1]] = {h}[y[1]] THEN 0 ELSE {sub} END", f"acc[y[1] + 1] + {dele}", f"line[-1] + {ins}"
    best = f"CASE WHEN ({d}) // {p} <= ({e}) // {p} AND ({d}) // {p} <= ({f}) // {p} THEN {d} WHEN ({e}) // {p} <= ({f}) // {p} THEN {e} ELSE {f} END"
    line = f"list_reduce(list_concat([[acc[1] + {dele}]], list_transform(range(1, len({h}) + 1), lambda j: [j])), lambda line, y: list_append(line, {best}))"
    return f"list_reduce(list_concat([list_transform(range(0, len({h}) + 1), lambda j: j * {ins})], list_transform(range(1, len({r}) + 1), lambda i: [i])), lambda acc, x: {line})[-1]"


def path(r: str, h: str) -> str:
    """Four digits of cost, then a letter for each operation: c, s, d, i."""
    step = lambda cell, op: f"printf('%04d', CAST(left({cell}, 4) AS INTEGER) + 1) || substr({cell}, 5) || '{op}'"
    same = f"{r}[CAST(x[1] AS INTEGER)] = {h}[CAST(y[1] AS INTEGER)]"
    diag, up, left = "acc[CAST(y[1] AS INTEGER)]", "acc[CAST(y[1] AS INTEGER) + 1]", "line[-1]"
    cd = f"(CAST(left({diag}, 4) AS INTEGER) + CASE WHEN {same} THEN 0 ELSE 1 END)"
    cu, cl = f"(CAST(left({up}, 4) AS INTEGER) + 1)", f"(CAST(left({left}, 4) AS INTEGER) + 1)"
    best = f"CASE WHEN {cd} <= {cu} AND {cd} <= {cl} THEN CASE WHEN {same} THEN {diag} || 'c' ELSE {step(diag, 's')} END WHEN {cu} <= {cl} THEN {step(up, 'd')} ELSE {step(left, 'i')} END"
    line = f"list_reduce(list_concat([[{step('acc[1]', 'd')}]], list_transform(range(1, len({h}) + 1), lambda j: [CAST(j AS VARCHAR)])), lambda line, y: list_append(line, {best}))"
    return f"list_reduce(list_concat([list_transform(range(0, len({h}) + 1), lambda j: printf('%04d', j) || repeat('i', j))], list_transform(range(1, len({r}) + 1), lambda i: [CAST(i AS VARCHAR)])), lambda acc, x: {line})[-1]"


PAIRS = "pairs AS (SELECT u.*, m.model_id, coalesce(p.hyp, '') AS hyp FROM utt u CROSS JOIN (SELECT unnest(['m1', 'm2', 'm3']) AS model_id) m LEFT JOIN preds p ON p.model_id = m.model_id AND p.utt_id = u.utt_id)"
CLASS = "CASE WHEN wer >= 0.4 AND (sim IS NULL OR sim <= 0.6) THEN 'full_misunderstanding' WHEN wer >= 0.15 THEN 'partial' ELSE 'local' END"
SCORES = f"""nrm AS (SELECT *, {advanced('ref')} AS ref_norm, {advanced('hyp')} AS hyp_norm FROM pairs),
toks AS (SELECT *, {tokens('ref_norm')} AS r, {tokens('hyp_norm')} AS h FROM nrm),
packed AS MATERIALIZED (SELECT *, CASE WHEN r = h THEN 0 ELSE {edits('r', 'h')} END AS e FROM toks),
counted AS (SELECT *, CAST((e // 100000000) % 10000 AS BIGINT) AS ops_sub, CAST((e // 10000) % 10000 AS BIGINT) AS ops_del, CAST(e % 10000 AS BIGINT) AS ops_ins, CAST(len(r) AS BIGINT) AS n_ref FROM packed),
scores AS (SELECT c.*, n_ref - ops_sub - ops_del AS ops_correct, round((ops_sub + ops_ins + ops_del) / greatest(1, n_ref), 6) AS wer,
  round({char_distance('ref_norm', 'hyp_norm')} / greatest(1, length(ref_norm)), 6) AS cer, CASE WHEN trim(ref_norm) = trim(hyp_norm) THEN 0.0 ELSE 1.0 END AS ser, s.sim
  FROM counted c LEFT JOIN sims s ON s.utt_id = c.utt_id)"""
OPS = f"""nrm AS (SELECT *, {advanced('ref')} AS ref_norm, {advanced('hyp')} AS hyp_norm FROM pairs),
toks AS (SELECT *, {tokens('ref_norm')} AS r, {tokens('hyp_norm')} AS h FROM nrm),
paths AS MATERIALIZED (SELECT *, CASE WHEN r = h THEN repeat('c', len(r)) ELSE substr({path('r', 'h')}, 5) END AS p FROM toks)"""


def ops(of: str = "paths", keep: str = "model_id, utt_id") -> str:
    """A row for each operation: op, ref, hyp."""
    return f"""ops AS (SELECT {keep}, substr(p, k, 1) AS op, CASE WHEN substr(p, k, 1) <> 'i' THEN r[length(replace(left(p, k), 'i', ''))] END AS ref, CASE WHEN substr(p, k, 1) <> 'd' THEN h[length(replace(left(p, k), 'd', ''))] END AS hyp
  FROM (SELECT *, unnest(range(1, length(p) + 1)) AS k FROM {of}))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
