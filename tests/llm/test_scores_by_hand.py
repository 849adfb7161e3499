"""op2 and op3 against plain computation, and the pipeline stage by stage against brute force."""

import hashlib
import math
import re
import string

import duckdb
import numpy as np
import pytest
import zstandard

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_quality_scores_are_the_curve_over_plain_sizes(spark):
    from speechlake.llm import quality as q

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = q.train(docs, q.training_labels(labels))
    found = {r.doc_id: r for r in q.op3_quality(spark, DATA).collect()}
    make = lambda d: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
    good, bad = make(model.good), make(model.bad)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(found) == len(texts)
    for i, t in texts.items():
        blocks = [t[a : a + 2048] for a in range(0, len(t), 2048)]
        x = [len(good.compress(b)) for b in blocks]
        y = [len(bad.compress(b)) for b in blocks]
        if t:
            of = [k for k, b in enumerate(blocks) if k == 0 or len(b) >= 512]
            f = [(sum(y) - sum(x)) / (sum(x) + sum(y)), min([1.0] + [(y[k] - x[k]) / (y[k] + x[k]) for k in of]), math.log((sum(x) + 16) / (len(t) + 16)), min([0.0] + [math.log((x[k] + 16) / (len(blocks[k]) + 16)) for k in of]), math.log(len(t))]
        else:
            f = [0.0] * 5
        z = sum((a - m) / s * w for a, m, s, w in zip(f, model.mean, model.scale, model.weights)) + model.weights[-1]
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))), abs=1e-9)


def test_scores_are_calibrated(spark):
    from speechlake.llm.quality import op3_quality

    data = DATA.replace("0.001", "0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality is not None}
    held = [(r.score, truth[r.doc_id]) for r in op3_quality(spark, data).collect() if r.held_out and r.doc_id in truth]
    base = sum(k for _, k in held) / len(held)
    assert len(held) > 100 and sum((p - k) ** 2 for p, k in held) / len(held) < 0.25 * base * (1 - base)  # Brier score: a quarter of that of the share alone
    sure = [k for p, k in held if p >= 0.9]
    assert sum(sure) >= 0.97 * len(sure)


def test_curve_is_where_the_gradient_vanishes():
    from speechlake.llm.quality import _curve

    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3))
    y = (x @ [1.5, -1, 0.2] + 0.5 * rng.standard_normal(300) > 0.3).astype(float)
    w = _curve(x, y)
    a = np.concatenate([x, np.ones((300, 1))], 1)
    assert np.abs(a.T @ (1 / (1 + np.exp(-a @ w)) - y) + 1e-2 * w).max() < 1e-5


def test_document_languages_are_the_best_paths(spark):
    from speechlake.llm import language as m
    from speechlake.llm.common import cut_pieces

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.where("lang is not null and text is not null").collect()]
    model = m.train(rows[: len(rows) // 2])
    some = [t for _, t in rows[::9]]
    texts = [*some, some[0][:400] + " " + some[3][:60] + " " + some[1][:300], some[2][:30] + " " + some[5][:30], "123 !?", "", "Ωμέγα слово " + some[0][:50], (some[4] + " ") * 3]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(t) for t in raw])
    got = m.SpanLabeller(model)(offs, np.frombuffer(b"".join(raw), np.uint8))
    mixed = 0
    for t, (k, score, spans) in zip(raw, got, strict=True):
        if not t:
            assert (k, score, spans) == (-1, 0.0, [])
            continue
        cuts, words, index, _ = cut_pieces(np.array([0, len(t)]), np.frombuffer(t, np.uint8))
        s, size = model.score([w.decode().strip() for w in words.to_pylist()])
        s, size = s[index], size[index]
        if not size.sum():
            assert k == -1
            continue
        best, back = s[0].copy(), []  # every path, plainly
        for row in s[1:]:
            step = best[:, None] - m.SWITCH * (1 - np.eye(len(row)))
            back.append(step.argmax(0))
            best = step.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        value = lambda p: sum(s[j, x] for j, x in enumerate(p)) - m.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        mine = [x for x, a, z in spans for _ in range(z - a)]
        assert len(mine) == len(path) and value(mine) == pytest.approx(value(path), abs=1e-3)
        share = np.bincount(mine, weights=size, minlength=s.shape[1])
        assert share[k] == share.max()
        mixed += len(spans) > 1
    assert mixed >= 1


def test_many_languages_take_bounded_tables():
    from speechlake.llm import language as m

    rng = np.random.default_rng(0)
    rows = [(f"l{k:03}", " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(30))) for k in range(300)]
    label = m.SpanLabeller(m.train(rows))
    assert label.most * 4 * 300 <= m.TABLE_BYTES
    text = " ".join(t for _, t in rows).encode()
    (k, _, spans), = label(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
    assert k >= 0 and spans[0][1] == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as p
    from test_corpus_operators import _components

    from speechlake.llm.decontaminate import OP4_SQL
    from speechlake.llm.packing import CAPACITY
    from speechlake.llm.quality import op3_quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = {r.doc_id: r.asDict() for r in docs.collect()}
    wanted = {r.doc_id for r in op3_quality(spark, DATA).collect() if r.score >= 0.5}
    for name, stage in p.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name == "packing":
            words = {i: len([w for w in re.split(r"[ \t-\r]+", r["text"] or "") if w]) for i, r in held.items()}
            sums, bins = dict.fromkeys(held, 0), {}
            for r in rows:
                sums[r.doc_id] += r.n_words
                bins.setdefault((r.pack_group, r.bin), []).append((r.bin_start, r.n_words))
            assert sums == words
            for b in bins.values():
                at = 0
                for start, n in sorted(b):
                    assert start == at
                    at += n
                assert at <= CAPACITY
            break
        found = {r.doc_id: r.asDict() for r in rows}
        assert len(found) == len(rows)
        if name == "near_duplicates":
            wanted = {i for i, (_, c) in _components([(i, r["text"]) for i, r in held.items()]).items() if c == i}
        elif name == "decontaminate":
            import pandas as pd

            con = duckdb.connect()
            con.register("documents", pd.DataFrame([{"doc_id": i, "text": r["text"]} for i, r in held.items()]))
            con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
            at = con.sql(OP4_SQL)
            wanted = {r[at.columns.index("doc_id")] for r in at.fetchall() if not r[at.columns.index("contaminated")]}
        if name == "exact_repeats":
            seen, want = set(), {}
            for i in sorted(held):
                b = (held[i]["text"] or "").encode()
                gone = bytearray(len(b))
                for k in range(len(b) - 99):
                    h = hashlib.blake2b(b[k : k + 100], digest_size=16).digest()
                    if h in seen:
                        gone[k : k + 100] = b"\1" * 100
                    seen.add(h)
                if not any(gone):
                    want[i] = held[i]["text"]
                elif left := bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore"):
                    want[i] = left
            assert {i: r["text"] for i, r in found.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for i, r in found.items() if r["text"] != held[i]["text"])
        else:
            assert set(found) == wanted
            assert all(found[i] == held[i] for i in found)  # what stays, stays whole
        held = found


def test_rows_without_an_id_are_packed(spark):
    from speechlake.llm.packing import pack_documents

    rows = [(None, f"a{k} b c", "s") for k in range(300)] + [(1, "x y", "t"), (1, "x y", "t"), (2, None, "t"), (None, None, None)]
    found = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=12, per_source=2, group_docs=50).collect()
    assert sum(r.n_words for r in found if r.doc_id is None) == 900 and sum(r.n_words for r in found if r.doc_id == 1) == 4
    assert max(sum(r.pack_group == g for r in found) for g in range(10)) < 120
