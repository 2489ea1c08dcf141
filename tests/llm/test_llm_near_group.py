"""One large group of near copies, most of which link with the group's middle or with nothing."""

import random

import numpy as np
import pytest

from millrace.llm import jaccard_join
from test_llm_free import frame
from test_llm_near_rule import brute

MEMBERS = 240


def group(rng, edits):
    """Copies of one text with a few words replaced, and some copies of these with one more."""
    base = [f"w{i}" for i in rng.sample(range(10**6), 150)]
    out = []
    for _ in range(MEMBERS):
        words = list(rng.choice(out)) if out and rng.random() < 0.2 else list(base)
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        out.append(words)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("size, percent, edits", [(5, 80, (2, 6)), (3, 90, (1, 4))])
def test_pairs_of_a_large_group(spark, monkeypatch, size, percent, edits):
    texts, passed, real = group(random.Random(size), edits), [], jaccard_join._verified

    def spy(pairs, *rest):
        passed.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", spy)
    got = jaccard_join.join_components(frame(spark, texts, nulls=False), rule=jaccard_join.Rule(size, percent)).collect()
    roots = brute(texts, size, percent)
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == roots
    assert len(set(roots)) > MEMBERS / 10  # so the second round has work
    assert passed[1] <= 5 * MEMBERS


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, cut in ((1, 1), (40, 3), (146, 20), (3000, 500)):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)]))
        differ = sum(int(a ^ b).bit_count() for a, b in zip(jaccard_join.bitmap(x), jaccard_join.bitmap(y), strict=True))
        assert differ <= len(np.setxor1d(x, y))
        assert not any(jaccard_join.bitmap(x) ^ jaccard_join.bitmap(x[::-1]))
