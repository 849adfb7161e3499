"""op1: look-alike notices are labelled as what they are or not at all; texts of a template's words in any order are cheap."""

import random
import time

import numpy as np
import pytest

from speechlake.llm import licenses as m

SCAN = m.LicenseScanner(m.TEMPLATES)


def scan(text):
    raw = text.encode()
    return SCAN(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).get(0, [])


@pytest.mark.parametrize("k", range(len(m.TEMPLATES)))
def test_every_notice_is_itself_alone(k):
    name, text = m.TEMPLATES[k]
    found = scan(f"see {text} and so on")
    assert [(x[0], x[1]) for x in found] == [(name, 1.0)]


@pytest.mark.parametrize("text", [
    "Released under the XYZ License.", "Released under the Foo License.", "Licensed under the Foo License, Version 2.0.", "Licensed under the Apache License, Version 1.1.",
    "This work is licensed under a Creative Commons Attribution 2.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 International License.",
    "Licensed under CC BY 5.0.", "This work is licensed under the GNU Free Documentation License, version 3.", "This work is licensed under the GNU Library General Public License, version 2.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 3.0",
])
def test_look_alikes_are_nothing(text):
    assert scan(text) == []


def test_changed_words_that_name_nothing_still_match():
    assert [x[0] for x in scan("Released under a MIT License.")] == ["MIT"]
    assert [x[0] for x in scan("This library is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.")] == ["GPL-3.0"]
    assert [x[0] for x in scan("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions hold")] == ["BSD"]


def test_places_of_several_licenses():
    text = " and ".join(t for _, t in m.TEMPLATES)
    assert [x[0] for x in scan(text)] == [n for n, _ in m.TEMPLATES]


def test_bound_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(20))], [rng.randrange(6) for _ in range(rng.randrange(1, 20))]
        bits = {x: sum(1 << q for q, y in enumerate(b) if y == x) for x in set(b)}
        row, want = [0] * (len(b) + 1), []
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
            want.append(row[-1])
        assert list(m.common_bound(a, bits, len(b))) == want


def test_shuffled_words_of_a_template_take_little_time():
    words = max(m.TEMPLATES, key=lambda t: len(t[1]))[1].split()
    rng, text = random.Random(3), []
    while len(text) < 32_000:
        text += rng.sample(words, len(words))
    began = time.process_time()
    scan(" ".join(text))
    assert time.process_time() - began < 3  # a second where nothing else runs
