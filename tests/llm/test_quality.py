"""Features and scores of the additive model against plain loops."""

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from pairtide.llm.quality import FEATURES, AdditiveModel, QualitySpec, describe, train_quality

TEXTS = [
    None, "", " ", "\n\n", "word", "Two words.", "the the the cat", "a\tb\nc  d\r\n", "ÄÖ ü – “quoted” 漢字 漢字", "1234 5678, (9)", "x" * 5000,
    "same same " * 700 + "END", " lead and trail ", "A-B-C; d?", "\x00\x7f<>{}",
]


def plain(text) -> list[float]:
    b = (text or "").encode()
    if not b:
        return [0.0] * len(FEATURES)
    share = lambda test: sum(map(test, b)) / len(b)
    letter = lambda c: chr(c).isascii() and chr(c).isalpha() or c >= 128
    space, stop = (lambda c: c in b"\t\n\x0b\x0c\r "), (lambda c: c in b".,;:?'\"()-")
    digit = lambda c: c in b"0123456789"
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, times = len(words), Counter(words)
    letters = share(letter)
    return [
        letters, share(digit), share(space), share(stop), share(lambda c: not (letter(c) or digit(c) or space(c) or stop(c))),
        share(lambda c: 65 <= c <= 90) / max(letters, 1e-9), sum(map(len, words)) / n if n else 0.0, len(times) / n if n else 0.0,
        max(times.values()) / n if n else 0.0, math.log1p(n), share(lambda c: c == 10),
        sum(v == w for v, w in zip(words, words[1:])) / n if n else 0.0,
        # a word counts with the space behind it
        math.log1p(max(map(len, re.findall(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+", b)))),
    ]


def test_features(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.features for r in describe(docs).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == pytest.approx(plain(text), abs=1e-9), (i, text)


def test_score_is_the_sum_of_looked_up_bins():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    x[:, 3] = rng.integers(0, 2, 600)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)  # only a pair tells
    model = AdditiveModel(QualitySpec(rounds=20, pairs=3)).fit(x, y)
    fresh = np.concatenate([rng.normal(size=(200, 4)), [[-1e9] * 4, [1e9] * 4, [c[0] for c in model.cuts]]])
    want = []
    for row in fresh:
        bins = [bisect_right(list(cuts), v) for cuts, v in zip(model.cuts, row)]
        total = model.level + sum(table[b] for table, b in zip(model.tables, bins))
        for j, k, table in model.pairs:
            side = lambda f: min(bins[f] * 8 // len(model.tables[f]), 7)
            total += table[side(j)][side(k)]
        want.append(1 / (1 + math.exp(-total)))
    assert model.score(fresh) == pytest.approx(want, abs=1e-12)
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_repeated_rows_of_a_labelled_id_count_once(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, "bad")] + [(1, "good text here")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = train_quality(describe(docs.dropDuplicates()), labels)
    assert train_quality(describe(docs), labels).level == once.level == 0.0
