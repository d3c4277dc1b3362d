"""Block-max pruning where the blocks scored first hold exactly k matches."""

import numpy as np

from quarry.llm import toxicity


def test_exactly_k_matches_in_the_first_blocks():
    held = {0: (0, 2), 1: (1, 2), 64: (0, 1), 128: (0, 1), 192: (0,)}  # terms by example; the others hold the third alone
    pairs = [(i, c) for i in range(256) for c in held.get(i, (2,))]
    row, code = np.array(pairs).T
    index = toxicity.Index.build(toxicity.Vocabulary(np.arange(3, dtype=np.uint64)), np.ones(3), np.arange(256), np.zeros(256, int), np.ones(256), 0.5, row, code, np.ones(len(row)))
    best, cosine = index.nearest(np.array([0, 1]), np.full(2, 0.5**0.5), 4)
    assert best.tolist() == [64, 128, 192, 0] and np.allclose(cosine, [1, 1, 0.5**0.5, 0.5])
