"""Operators that SQL can't express, against plain brute force."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, runs, short and empty texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(60), make(150)
    out = [make(rng.randint(1, 250)) for _ in range(60)]
    out += [f"{make(30)} {passage} {make(20)}" for _ in range(12)] + [base] * 5
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += ["", None, "   \n", "one two", "One  two", "a" * 350, "ab" * 200, "x" + "ab" * 100, "ñ" * 120, "ñ" * 130, make(3000)]
    rng.shuffle(out)
    return [(3 * k + 7, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, blob string, b int").repartition(5)


def test_repeats_against_brute_force(docs, texts):
    from speechlake.llm.exact_substring import remove_repeats, removed_bytes

    seen, want, left = set(), {}, {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        if not any(gone):
            left[i] = t
        elif text := kept.decode(errors="ignore"):
            left[i] = text
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_bytes(docs).collect()}
    assert got == want
    cleaned = remove_repeats(docs)
    assert cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == left


def test_crowded_anchors_give_the_same(docs, monkeypatch):
    from speechlake.llm import exact_substring as m

    before = sorted(m.removed_bytes(docs).collect())
    monkeypatch.setattr(m, "CROWD", 2)
    assert sorted(m.removed_bytes(docs).collect()) == before


def _components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_similar_documents_against_brute_force(docs, texts, monkeypatch):
    from speechlake.llm import ngram_join as m

    want = _components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in m.shingle_components(docs).collect()} == want
    kept = m.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}
    monkeypatch.setattr(m, "GROUP_BLOCK", 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in m.shingle_components(docs).collect()} == want


def test_pigeonhole_and_sketch_bounds():
    from speechlake.llm import ngram_join as m

    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, (2, m.COUNTERS)).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, max(1, n // 9 + 1)))):
            b[rng.integers(n)] = rng.integers(0, 1 << 63, dtype=np.uint64)
        a, b = np.unique(a), np.unique(b)
        if not m.similar(a, b):
            continue
        edge = np.array([0, len(a), len(a) + len(b)])
        keys, docs = m.chunk_keys(np.concatenate([a, b]), edge, counts)
        assert set(keys[docs == 0].tolist()) & set(keys[docs == 1].tolist())
        x, y = m.sketches(np.concatenate([a, b]), edge)
        width = min(len(x), len(y))
        apart = int(np.bitwise_count(m.fold_sketch(x, width) ^ m.fold_sketch(y, width)).sum())
        assert apart <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) / 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab\0", max_size=70)), min_size=1, max_size=40))
def test_deep_shallow_sort(rows):
    from speechlake.llm.suffix_sort import deep_shallow_sort

    strings = [s.encode() for _, s in rows]
    lens, group = np.array([len(s) for s in strings]), np.array([g for g, _ in rows])
    m = np.zeros((len(rows), max(1, lens.max())), np.uint8)
    for k, s in enumerate(strings):
        m[k, : len(s)] = np.frombuffer(s, np.uint8)
    order, lcp = deep_shallow_sort(m, lens, group)
    got = [(int(group[k]), strings[k]) for k in order]
    assert got == sorted(got)
    for k in range(1, len(got)):
        (g, x), (h, y) = got[k - 1], got[k]
        common = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert lcp[k] == (-1 if g != h else common)


def test_deep_groups_use_tries():
    from speechlake.llm.suffix_sort import BlindTrie

    rng = random.Random(1)
    strings = [b"q" * rng.randint(0, 30) + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    assert [strings[k] for k in BlindTrie(strings).order()] == sorted(strings)


def _best_fit(items, capacity, per_source):
    bins, out = [], []
    for n, s, c in items:
        fits = [(left, k) for k, (left, held) in enumerate(bins) if left >= n and sum(x == s for x, _ in held) < per_source and all(y != c for _, y in held)]
        if not fits:
            bins.append((capacity, []))
            fits = [(capacity, len(bins) - 1)]
        left, k = min(fits)
        bins[k] = (left - n, bins[k][1] + [(s, c)])
        out.append(k)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 6)), max_size=60), st.integers(1, 3))
def test_best_fit_against_brute_force(items, per_source):
    from speechlake.llm.packing import pack_items

    items = sorted(items, key=lambda x: (-x[0], x[2], x[1]))
    assert pack_items(*[[x[k] for x in items] for k in range(3)], 20, per_source) == _best_fit(items, 20, per_source)


def test_packing_places_every_word_once(docs, texts):
    from speechlake.llm.packing import pack_documents

    rows = pack_documents(docs, capacity=64, per_source=2, group_docs=40).collect()
    words, source = {i: len((t or "").split()) for i, t in texts}, {i: f"s{i % 3}" if i % 5 else None for i, _ in texts}
    got, bins = {}, {}
    for r in rows:
        assert r.first_word == r.piece * 64
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
        bins.setdefault((r.pack_group, r.bin), []).append(r)
    assert got == {i: n for i, n in words.items() if n}
    text = dict(texts)
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.n_words
        assert at <= 64
        assert len({text[r.doc_id] for r in held}) == len(held)
        for s in {source[r.doc_id] for r in held}:
            assert sum(source[r.doc_id] == s for r in held) <= 2


def test_embeddings_against_brute_force(spark):
    from speechlake.llm.embedding_dedup import embedding_components

    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 16))
    x[100:160] = x[100] + 0.02 * rng.standard_normal((60, 16))
    x[160:200] = x[160] + 0.12 * rng.standard_normal((40, 16))
    x[200:203] = x[200]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] + [None] * 15), (904, []), (905, [1.0, 2.0]), (906, [1e300] * 16), (907, [2e300] * 16)]
    got = {r.vec_id: r for r in embedding_components(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) + len(odd)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    ones = np.ones(16) / 4
    far = (u @ ones >= 0.9).sum()
    assert far == 0
    label = np.arange(500)
    for _ in range(60):
        label = np.minimum(label, np.where(near, label[None, :], 10**6).min(1))
    links = np.array([got[k].n_links for k in range(500)])
    assert np.minimum(links, near.sum(1)).sum() >= 0.9 * near.sum() and (links <= near.sum(1)).all()
    assert np.mean([got[k].component_id == label[k] for k in range(500)]) >= 0.99
    for k in (900, 901, 902, 903, 904, 905):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[906].n_links == got[907].n_links == 1 and got[907].component_id == 906


def test_tokens_come_back(spark, docs, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from speechlake.llm import token_ids as m

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, at, want = Tokenizer.from_file(vocabulary), 0, {}
    odd = [(10_000 + k, t) for k, t in enumerate(["<|endoftext|> x", "DON'T I'll", "Ο ΟΔΟΣ É́ é", "½ ² ．。日本", "a b c"])]
    for i, t in sorted(texts + odd):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    every = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    m.write_token_files(every, vocabulary, str(tmp_path / "t"), image_tokens=500)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in m.read_token_files(spark, str(tmp_path / "t")).collect()} == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1200), st.sampled_from([4, 8, 12]))
def test_every_token_is_addressable(ids, bits):
    from speechlake.llm.token_ids import DacImage

    x = np.array(ids, np.uint32)
    image = DacImage(DacImage.build(np.array([4]), np.array([len(x)]), x, bits))
    assert image.decode().tolist() == ids
    assert [image[k] for k in range(0, len(ids), 7)] == ids[::7]


def test_patience_is_an_alignment():
    from speechlake.llm.licenses import LicenseScanner, patience

    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(30))]
        b = [rng.randrange(12) for _ in range(rng.randrange(30))]
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert patience(a, a) == [(k, k) for k in range(len(a))]
    scan = LicenseScanner([("L", "alpha beta gamma delta epsilon zeta eta theta")])
    raw = b"x alpha beta gamma NEW delta epsilon zeta eta theta y. alpha beta only"
    assert scan(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)) == {0: [("L", 1.0, 1, 10)]}


def test_licenses_are_found_wherever_every_window_finds_them(spark):
    from speechlake.llm import licenses as m

    rng = random.Random(4)
    filler = ["lorem", "ipsum", "license", "the", "under", "version", "rights"]
    rows, planted = [], {}
    for i in range(80):
        t = [rng.choice(filler) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            name, text = rng.choice(m.TEMPLATES)
            at = rng.randrange(len(t) + 1)
            t[at:at] = text.split()
            planted[i] = name
        rows.append((i, " ".join(t)))
    got = {r.doc_id: {h.license for h in r.hits} for r in m.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # filler has no word that names a license, so that each planted notice is found as itself and nothing else is
    assert got == {i: {planted[i]} if i in planted else set() for i, _ in rows}


def test_viterbi_against_all_paths():
    import itertools

    from speechlake.llm.language import viterbi

    rng = random.Random(3)
    for _ in range(200):
        rows = [[float(rng.randrange(-6, 1)) for _ in range(3)] for _ in range(rng.randrange(1, 6))]
        value = lambda p, rows=rows: sum(r[k] for r, k in zip(rows, p, strict=True)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        assert value(viterbi(rows, 2.0)) == max(map(value, itertools.product(range(3), repeat=len(rows))))


def test_languages_mixed_texts_take_the_best_path():
    from speechlake.llm.language import SpanLabeller, letters, train, viterbi

    rng = random.Random(6)
    own = {"aa": ["bado", "kimu", "sole"], "bb": ["treng", "stolk", "vurt"], "cc": ["ñuño", "çéla", "öld"]}
    model = train([(k, " ".join(rng.choice(v) for _ in range(40))) for k, v in own.items() for _ in range(8)])
    label, rows = SpanLabeller(model), []
    for _ in range(120):
        parts = [rng.choice(own[rng.choice(list(own))]) for _ in range(rng.randrange(0, 4))]
        a, b = rng.choice(list(own)), rng.choice(list(own))
        rows.append(" ".join([rng.choice(own[a]) for _ in range(rng.randrange(12))] + parts + [rng.choice(own[b]) for _ in range(rng.randrange(12))]))
    raw = [r.encode() for r in rows]
    found = label(np.concatenate([[0], np.cumsum([len(r) for r in raw])]), np.frombuffer(b"".join(raw), np.uint8))
    for text, (k, _, spans) in zip(rows, found, strict=True):
        words = text.split()
        assert (k < 0) == (not letters(text))
        if words:
            scores = model.score(words)[0]
            path = [s for s, a, z in spans for _ in range(a, z)]
            value = lambda p, scores=scores: sum(scores[i, x] for i, x in enumerate(p)) - 12.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            assert value(path) == pytest.approx(value(viterbi(scores.tolist())), abs=1e-3)


def test_components_against_union_find(spark):
    from speechlake.llm.components import connected_components

    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(400, 500)] + [(600, k) for k in range(601, 700)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
