import random

import numpy as np
import pytest

from tessera.llm import bwt


def lay(strings):
    text = np.frombuffer(b"".join(strings), np.uint8)
    left = np.concatenate([np.arange(len(s), 0, -1) for s in strings]) if strings else np.zeros(0, np.int64)
    return text, left


@pytest.mark.parametrize("seed", range(8))
def test_order_and_boundaries(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab\x00\xff") for _ in range(200))
    strings = [base[i : i + rng.randrange(1, 60)] for i in [rng.randrange(150) for _ in range(30)]] + [b"a" * 40, b"a" * 40, b"b"]
    text, left = lay(strings)
    suffixes = [(k, s[i:]) for k, s in enumerate(strings) for i in range(len(s))]
    want = sorted(range(len(suffixes)), key=lambda j: ([c + 1 for c in suffixes[j][1]] + [0], suffixes[j][0]))
    order = bwt.suffix_order(text, left)
    assert order.tolist() == want

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    lcp = [0] + [common(suffixes[a][1], suffixes[b][1]) for a, b in zip(want, want[1:])]
    for least in (1, 2, 3, 7, 25):
        split = bwt.boundaries(text, left, order, least)
        assert split.tolist() == [True] + [x < least for x in lcp[1:]]


