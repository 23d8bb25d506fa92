"""Kernels against plain definitions on random texts."""

import random

import numpy as np
import pytest

from glyphgrid.operators import kernels as K

TOY = "tgcaacgt" * 5
#: fixed values of the toy text: for each block size the grammar text size, its BWT runs, and its alphabet
TOY_PARAMS = {1: (41, 11, 5), 2: (22, 9, 8), 3: (16, 6, 6), 4: (12, 6, 5), 5: (11, 4, 3), 6: (11, 5, 5), 7: (11, 5, 5), 8: (7, 4, 4)}


def random_texts(n=150):
    rnd = random.Random(7)
    out = ["", "a", "aa", "ab", "ba", "aaaa", TOY, "é漢😀é漢😀é"]
    for _ in range(n):
        letters = "abcdéf😀h"[: rnd.choice([1, 2, 3, 4, 8])]
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60)))
        if rnd.random() < 0.4:
            text = (text[: rnd.randint(1, 9)] * 60)[: len(text)]
        out.append(text)
    return out


def plain_types(text):
    kinds = [""] * len(text)
    for i in range(len(text) - 1, -1, -1):
        if i + 1 == len(text) or text[i] > text[i + 1]:
            kinds[i] = "L"
        elif text[i] < text[i + 1]:
            kinds[i] = "S"
        else:
            kinds[i] = kinds[i + 1]
    return kinds


def plain_blocks(text, lam):
    kinds, starts = plain_types(text), [0] if text else []
    starts += [i for i in range(1, len(text)) if kinds[i] == "S" and kinds[i - 1] == "L"]
    return [k for a, b in zip(starts, [*starts[1:], len(text)], strict=False) for k in range(a, b, lam)]


@pytest.mark.parametrize("text", random_texts())
def test_kernels(text):
    cp = K.code_points(text)
    assert ["S" if s else "L" for s in K.s_types(cp)] == plain_types(text)
    for lam in range(1, 9):
        assert K.block_starts(cp, lam).tolist() == plain_blocks(text, lam)
    order = K.suffix_array(cp).tolist()
    assert order == sorted(range(len(text) + 1), key=lambda p: text[p:])
    lcp = K.lcp_of(cp, np.array(order))
    for row in range(1, len(order)):
        a, b = text[order[row - 1] :], text[order[row] :]
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert lcp[row] == k
    assert K.chars(K.bwt_of(cp, np.array(order))) == [text[p - 1] if p else "" for p in order]


@pytest.mark.parametrize("text", random_texts(60))
def test_lz77_decodes(text):
    start, source, size = K.lz77(K.code_points(text))
    out = []
    for a, s, n in zip(start.tolist(), source.tolist(), size.tolist(), strict=True):
        assert a == len(out)
        for k in range(n):
            out.append(text[a] if s < 0 else out[s + k])
    assert "".join(out) == text
    for a, s, n in zip(start.tolist(), source.tolist(), size.tolist(), strict=True):
        best = max((k for k in range(1, len(text) - a + 1) if text.find(text[a : a + k]) < a), default=0)
        assert (n if s >= 0 else 0) == best


@pytest.mark.parametrize("lam", range(1, 9))
def test_toy_parameters(lam):
    starts = K.block_starts(K.code_points(TOY), lam).tolist()
    blocks = [TOY[a:b] for a, b in zip(starts, [*starts[1:], len(TOY)], strict=False)]
    ids = np.array([sorted(set(blocks)).index(b) for b in blocks])
    runs = K.run_count(K.bwt_of(ids, K.suffix_array(ids)))
    assert (len(blocks) + 1, runs, len(set(blocks)) + 1) == TOY_PARAMS[lam]


def test_fibonacci_codes_decode(spark):
    from pyspark.sql import functions as F

    from glyphgrid.functions import coders

    numbers = [1, 2]
    while len(numbers) < 60:
        numbers.append(numbers[-1] + numbers[-2])
    for r in spark.range(1, 3000).select("id", coders.fibonacci(F.col("id")).alias("code")).collect():
        assert r.code.endswith("11") and "11" not in r.code[:-1]
        assert sum(n for n, d in zip(numbers, r.code[:-1], strict=False) if d == "1") == r.id
