"""The communication matrix: exact margins beyond a thousand million rows, exact laws on tiny cases."""

import math
from collections import Counter

import numpy as np

from plainledger.llm import sharding


def test_margins_of_five_thousand_million_rows():
    blocks = [1_250_000_007, 1_249_999_993, 2_000_000_000, 499_999_999, 1]
    matrix = sharding.communication(blocks, 7, 3)
    assert matrix.sum(axis=1).tolist() == blocks and matrix.sum(axis=0).tolist() == sharding.shard_sizes(sum(blocks), 7).tolist()
    # Each cell is near its mean, within some standard deviations.
    share = np.array(blocks)[:, None] / 7
    assert (np.abs(matrix - share) <= 8 * np.sqrt(share + 1)).all() and matrix.min() >= 0


def test_the_law_of_a_draw():
    dice = np.random.default_rng(1)
    for good, bad, drawn in ((5, 7, 6), (1, 9, 4), (3, 3, 6), (20, 4, 10), (4, 0, 2), (0, 4, 2)):
        seen = Counter(sharding.hypergeometric(dice, good, bad, drawn) for _ in range(6000))
        for x in range(drawn + 1):
            p = math.comb(good, x) * math.comb(bad, drawn - x) / math.comb(good + bad, drawn)
            assert abs(seen[x] / 6000 - p) <= 5 * math.sqrt(p * (1 - p) / 6000) + 1e-12


def test_large_draws_have_the_right_spread():
    dice = np.random.default_rng(2)
    good, bad, drawn = 200_000_000, 4_800_000_000, 1_000_000
    seen = np.array([sharding.hypergeometric(dice, good, bad, drawn) for _ in range(400)])
    p = good / (good + bad)
    sigma = math.sqrt(drawn * p * (1 - p))
    assert abs(seen.mean() - drawn * p) < 5 * sigma / 20 and 0.85 < seen.std() / sigma < 1.15


def test_every_deal_of_a_tiny_table_is_as_likely():
    """Rows 0 to 3 in blocks of 2, two shards of 2: all six deals of rows come alike."""
    deals = Counter()
    for seed in range(6000):
        matrix = sharding.communication([2, 2], 2, seed)
        deals[int(matrix[0, 0])] += 1
    # One deal each puts both or no rows of a block into a shard, four put one.
    assert abs(deals[0] / 6000 - 1 / 6) < 0.03 and abs(deals[2] / 6000 - 1 / 6) < 0.03 and abs(deals[1] / 6000 - 4 / 6) < 0.03
