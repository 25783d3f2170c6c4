"""Near copies against brute-force Jaccard similarity."""

import itertools
import random

import numpy as np

from plainledger.llm import nearcopies, simhash


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def family(seed, n, edits):
    """A text of n words and copies of it with ever more words replaced."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10 ** 9)}" for _ in range(n)]
    out = [" ".join(base)]
    for k in edits:
        words = list(base)
        for at in draw.sample(range(n), k):
            words[at] = f"x{draw.randrange(10 ** 9)}"
        out.append(" ".join(words))
    return out


def test_deduplicate_equals_brute_force_jaccard(spark):
    texts = [t for seed in range(40) for t in family(seed, 60 + 12 * seed, range(1, 14))]
    texts += ["", None, " \n", "one two", "One  TWO", "one two three"]
    rows = [(k * 7919 % 10_007, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[5])]
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    want = sorted(least.values())
    assert 60 < len(want) < len(texts) - 60
    found = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in found) == 0


def test_deduplicate_knows_rows_by_id_and_text(spark):
    one, two, three, four = (family(seed, 80, [])[0] for seed in range(100, 104))
    rows = [(1, one), (1, two), (1, two), (None, three), (None, three), (None, three), (7, four), (None, four)]
    found = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(found.collect(), key=str) == sorted([(1, one), (1, two), (None, three), (7, four)], key=str)


def test_band_recall_at_the_limit():
    """Random sets of similarity 0.8 share a band."""
    draw = np.random.default_rng(1)
    for n in (45, 450, 4500):
        for _ in range(150):
            both = draw.integers(1 << 63, size=n, dtype=np.uint64)
            edge = n // 10
            a, b = np.unique(both[edge:]), np.unique(both[:-edge])
            assert nearcopies.similar(a, b) and (nearcopies.bands(a) == nearcopies.bands(b)).any()


def test_family_larger_than_a_block(spark):
    """A chain in which only neighbours are near copies, over many blocks, and a family around one text."""
    draw = random.Random(3)
    words = [f"c{draw.randrange(10 ** 9)}" for _ in range(1_200)]
    chain = [(k, " ".join(words[k * 4: k * 4 + 60])) for k in range(280)]
    star = [(1000 + k, t) for k, t in enumerate(family(9, 300, [1] * 400))]
    found = simhash.deduplicate(spark.createDataFrame(chain + star, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 1000]
