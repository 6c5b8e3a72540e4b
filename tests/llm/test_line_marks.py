"""Pairs of lines that are told apart by their marks are never alike."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from axisweave.llm import linededup


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_marks_lose_no_pair(similarity):
    rnd = random.Random(5)
    make = lambda n: "".join(rnd.choices("abcdeé日😀 ", k=n))
    x = ["", "abc", "same", "a" * 300, "ab" * 40] + [make(rnd.randint(1, 400)) for _ in range(1500)]
    y = ["", "abd", "same", "a" * 7, "ba" * 90]
    for t in x[5:]:
        t = list(t)
        for _ in range(rnd.choice([0, 1, 2, 4, 8, 30])):
            t[rnd.randrange(len(t))] = rnd.choice("abcxyz")
        y.append("".join(t) if rnd.random() < 0.8 else make(200))
    y[200:400] = [y[200]] * 200  # a leader with many members
    a, b = pa.array(x, pa.string()), pa.array(y, pa.string())
    alike = linededup.line_jaccard(a, b) >= similarity
    may = linededup.may_be_alike(a, b, similarity)
    assert alike.sum() > 50 and may[alike].all() and may.sum() < len(x) * 0.9
    assert not len(linededup.may_be_alike(a.slice(0, 0), b.slice(0, 0), similarity)) and (linededup.may_be_alike(a.slice(3, 50), b.slice(3, 50), similarity) == may[3:53]).all()
    assert np.array_equal(linededup.may_be_alike(a, a, similarity), np.ones(len(x), bool))
