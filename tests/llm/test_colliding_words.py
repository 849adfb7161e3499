"""Two words of 1,024 letters that a polynomial hash modulo 2^64 can't tell apart, whatever its base, in every operator that tells words."""

import numpy as np
import pytest

A = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
B = A.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, A, "s"), (2, B, "s"), (3, A, "s")], "doc_id long, text string, source string")


def test_the_words_collide_in_range_hashes():
    from speechlake.llm.common import RangeHash, digest64, word_hashes

    data = np.frombuffer((A + B).encode(), np.uint8)
    starts, ends = np.array([0, 1024]), np.array([1024, 2048])
    h = RangeHash(data)(starts, ends)
    assert h[0] == h[1]
    assert len(set(word_hashes(data, starts, ends))) == 2 == len(set(digest64([A.encode(), B.encode()])))


def test_op6_writes_each_words_ids():
    import sys

    sys.path.insert(0, "/opt/tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    from speechlake.llm.token_ids import PieceEncoder

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    raw = f"{A} {B} {A}".encode()
    ids, lens = PieceEncoder(path)(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    assert ids.tolist() == Tokenizer.from_file(path).encode(raw.decode(), add_special_tokens=False).ids and lens.tolist() == [len(ids)]


def test_op10_links_equal_texts_only(spark, pair):
    from speechlake.llm.ngram_join import shingle_components

    assert {r.doc_id: r.component_id for r in shingle_components(pair.select("doc_id", "text")).collect()} == {1: 1, 2: 2, 3: 1}


def test_op8_clusters_are_equal_texts(spark, pair):
    from speechlake.llm.packing import pack_documents

    bins = {r.doc_id: (r.pack_group, r.bin) for r in pack_documents(pair, capacity=8, per_source=8, group_docs=10).collect()}
    assert bins[1] == bins[2] != bins[3] or bins[2] == bins[3] != bins[1]


def test_op2_scores_each_word_by_itself():
    from speechlake.llm.common import HashIndex, cut_pieces

    raw = f"{A} {B} short {A}".encode()
    _, words, index, keys = cut_pieces(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    known = HashIndex()
    assert (known.find(keys) == -1).all()
    known.add(keys)
    assert sorted(known.find(keys)) == list(range(len(keys))) and len(keys) == len(words) == 4
    assert known.size == 4


def test_op1_takes_a_template_word_for_itself_only():
    from speechlake.llm.licenses import LicenseScanner

    scan = LicenseScanner([("L", f"under the {A} terms")])
    for word, hits in ((A, 1), (B, 0)):
        raw = f"under the {word} terms".encode()
        found = scan(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        assert sum(x[1] == 1.0 for x in found.get(0, ())) == hits
