"""Fillings of any number of parts."""

from itertools import combinations_with_replacement

import numpy as np

from cairn.llm.packing import complete_bins, fillings


def test_many_parts():
    counts = {1032: 1000, 254: 4000, 341: 6000}
    assert sum(t for _, t in complete_bins(counts, 2048)) == 2000


def test_all_undominated():
    left = np.zeros(31, np.int64)
    left[[1, 2, 3, 5, 7, 11, 13]] = [1, 2, 6, 3, 1, 2, 1]
    room = 17
    have = left[: room + 1].copy()
    have[13] -= 1
    want = set()
    for k in range(room + 1):
        for f in combinations_with_replacement([n for n in range(room, 0, -1) if have[n] > 0], k):
            waste = room - sum(f)
            if waste < 0 or any(f.count(n) > have[n] for n in f):
                continue
            if not any(n < m <= n + waste and have[m] > f.count(m) for n in {0, *f} for m in range(1, room + 1)):
                want.add(f)
    got = list(fillings(left, 13, 30, 30))
    assert set(got) == want and len(got) == len(want)
