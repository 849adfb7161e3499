"""The engine's queries see whole texts."""

import random

import pytest
from test_alignment import plain

from speechlake import queries
from speechlake.plans import harness

DATA = "/root/testdata/sf0.001"


def edited(words, d, a, b, c):
    out = []
    for at, w in enumerate(words, 1):
        out += [] if (d + at) % a == 0 else [w + "x"] if (3 * d + at) % b == 0 else [w]
        out += ["uh"] if (d + 2 * at) % c == 0 else []
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(5), tmp_path_factory.mktemp("whole")
    texts = [[rng.choice(["one", "two", "drei", "vier", "cinq"]) for _ in range(rng.choice((3, 24, 25, 90)))] for _ in range(20)]
    rows = [(k, " \n".join(t), "s", "en", len(" ".join(t))) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{d}/documents.parquet")
    (d / "embeddings.parquet").symlink_to(f"{DATA}/embeddings.parquet")
    return texts, str(d)


def test_scores_of_whole_texts(spark, folder):
    texts, d = folder
    assert {r.utt_id: r.ref for r in queries.QUERIES["recording_view"](spark, d).collect()} == {k: " ".join(t) for k, t in enumerate(texts)}
    found = queries.QUERIES["recording_metrics"](spark, d).collect()
    counts = {(r.utt_id, r.model_id): r for r in queries.QUERIES["recording_align_counts"](spark, d).collect()}
    assert len(found) == len(counts) == 3 * len(texts)
    sums = {m: [0] * 6 for m in harness.MODELS}
    for r in found:
        ref = texts[r.utt_id]
        hyp = [] if r.model_id == "m3" and r.utt_id % 10 == 0 else edited(ref, r.utt_id, *harness.MODELS[r.model_id])
        ops = [o[0] for o in plain(ref, hyp)]
        wrong = sum(o[0] != "correct" for o in plain(" ".join(ref), " ".join(hyp)))
        assert (r.wer, r.cer) == (round(sum(o != "correct" for o in ops) / len(ref), 6), round(wrong / len(" ".join(ref)), 6))
        c = counts[r.utt_id, r.model_id]
        assert (c.ops_sub, c.ops_ins, c.ops_del, c.ops_correct) == tuple(ops.count(x) for x in ("sub", "ins", "del", "correct")) and c.n_ref == len(ref)
        if not (r.model_id == "m3" and r.utt_id % 10 == 0):
            for k, x in enumerate((ops.count("sub"), ops.count("ins"), ops.count("del"), len(ref), wrong, len(" ".join(ref)))):
                sums[r.model_id][k] += x
    for r in queries.QUERIES["recording_corpus_scores"](spark, d).collect():
        assert [r.substitutions, r.insertions, r.deletions, r.n_ref, r.chars_wrong, r.chars] == sums[r.model_id]
        assert r.wer == round(sum(sums[r.model_id][:3]) / r.n_ref, 6) and r.cer == round(r.chars_wrong / r.chars, 6)


def test_utterances_lose_no_word(spark, folder):
    texts, d = folder
    rows = queries.QUERIES["utt_view"](spark, d).orderBy("utt_id").collect()
    for k, t in enumerate(texts):
        parts = [r.ref for r in rows if r.utt_id // harness.PLACES == k]
        assert " ".join(parts).split() == t
        assert [len(p.split()) for p in parts[:-1]] == [harness.WORDS] * (len(parts) - 1)


def test_scores_of_utterances(spark, folder):
    texts, d = folder
    refs = {k * harness.PLACES + i // harness.WORDS: t[i : i + harness.WORDS] for k, t in enumerate(texts) for i in range(0, len(t), harness.WORDS)}
    found = queries.QUERIES["per_utt_metrics"](spark, d).collect()
    assert len(found) == 3 * len(refs)
    for r in found:
        ref = refs[r.utt_id]
        hyp = [] if r.model_id == "m3" and r.utt_id % 10 == 0 else edited(ref, r.utt_id, *harness.MODELS[r.model_id])
        wrong = sum(o[0] != "correct" for o in plain(" ".join(ref), " ".join(hyp)))
        assert (r.wer, r.cer) == (round(sum(o[0] != "correct" for o in plain(ref, hyp)) / len(ref), 6), round(wrong / len(" ".join(ref)), 6))


def test_texts_without_words(spark, tmp_path):
    rows = [(0, None, "s", "en", 0), (1, " \n", "s", "en", 2), (2, "a b", None, None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.utt_id // harness.PLACES, r.ref) for r in queries.QUERIES["utt_view"](spark, str(tmp_path)).collect()} == {(0, ""), (1, ""), (2, "a b")}
