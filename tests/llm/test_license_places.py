"""op1: notices that stand close together count each."""

import numpy as np

from speechlake.llm.licenses import TEMPLATES, LicenseScanner


def scan(text, templates=TEMPLATES):
    raw = text.encode()
    return LicenseScanner(templates)(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).get(0, [])


def test_repeated_notices_count_each():
    for name, notice in TEMPLATES:
        for times in (1, 2, 3, 40):
            for text in (" ".join([notice] * times), "one two three " + "\n".join([notice] * times) + " four five six"):
                found = scan(text, [(name, notice)])
                assert [(x[0], x[1]) for x in found] == [(name, 1.0)] * times
                ends = [y for x in found for y in x[2:]]
                assert ends == sorted(ends)


def test_notices_a_few_words_apart():
    text = "see here. Released under the MIT License. and then Released under the MIT License. All rights reserved. All rights reserved. the end"
    assert [x[0] for x in scan(text)] == ["MIT", "MIT", "reserved", "reserved"]


def test_a_repeat_inside_a_notice_is_one_place():
    template = [("L", "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    assert scan("alpha beta gamma delta epsilon zeta alpha beta gamma eta theta iota kappa", template) == [("L", 1.0, 0, 13)]
    assert scan("alpha beta gamma alpha beta gamma delta epsilon zeta eta theta iota kappa", template) == [("L", 1.0, 3, 13)]
