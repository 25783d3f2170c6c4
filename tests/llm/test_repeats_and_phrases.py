"""Phrases, periodic runs and repeated byte strings against brute force, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plainledger.llm import induced, periodic, phrases, queries, suffixes
from tests.llm.test_queries import ODD, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with odd rows, periodic rows and columns whose names clash."""
    out = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None if i is None else i + 1_000_000, t, "en", s, None) for i, t, s in ODD]
    rows += [(2_000_001, "x y " * 30, None, "a", None), (2_000_002, "P q. P q, p Q\tr " * 300, None, "a", None),
             (2_000_003, "P q. P q, p Q\tr " * 300, "und", "a", None)]
    clash = ("rank", "shard", "data", "marks", "single", "_doc", "first", "n", "size", "phrase", "runs", "_row")
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: F.lit("clash") for c in clash}).write.parquet(
        f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


# --- phrases ---------------------------------------------------------------------------

def best_phrases(rows, threshold, longest=5, limit=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= threshold}
    inside = {(lang, p[i:i + m]) for (lang, p), v in found.items() for m in range(2, len(p))
              for i in range(len(p) - m + 1) if v >= found[lang, p[i:i + m]]}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, kept = Counter(), []
    for row in out:
        rank[row[0]] += 1
        if rank[row[0]] <= limit:
            kept.append((row[0], rank[row[0]], *row[1:]))
    return kept


def test_phrases(spark, folder, docs):
    got = queries.op11_phrases(spark, folder)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [(lang, text) for _, text, lang in docs]
    want = best_phrases(rows, 100)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {"und", "en"} <= {r[0] for r in want}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for threshold, limit in ((7, 2000), (3, 25)):
        got = sorted(map(tuple, phrases.collocations(table, threshold, limit=limit).collect()))
        assert got == sorted(best_phrases(rows, threshold, limit=limit))


def test_phrases_of_empty_tables(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    assert phrases.collocations(table.limit(0)).count() == 0
    assert phrases.collocations(table.filter("text IS NULL")).count() == 0


def batches(texts):
    return [pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])]


def test_summaries_lose_no_frequent_phrase(monkeypatch):
    """Small capacities and buffers: every n-gram at the threshold survives, and long texts are cut nowhere."""
    monkeypatch.setattr(phrases, "BUFFER", 300)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 900))) for _ in range(20)]
    texts.append("z" * 5000 + " a b c d e " * 200)
    exact = Counter()
    for text in texts:
        words = text.split()
        for m in range(1, 6):
            exact.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    monkeypatch.setattr(phrases, "TASK_COUNTERS", 500)
    parts = 3
    summaries = [r for b in phrases.task_summaries(parts, 5)(batches(texts)) for r in b.to_pylist()]
    assert sum(r["mass"] for r in summaries) == sum(exact.values()) and len(summaries) > parts
    whole = Counter()
    for r in summaries:
        whole[r["part"]] += r["mass"]
    rows = sorted(({**r, "whole": whole[r["part"]]} for r in summaries), key=lambda r: r["part"])
    table = pa.Table.from_pylist(rows).to_batches(max_chunksize=3)
    threshold = 40
    keys = np.concatenate([b.column("key").to_numpy().view(np.uint64) for b in phrases.merged_survivors(threshold, 1)(table)])
    assert len(keys) < len(exact)

    class Marks:
        value = b"\xff" * (phrases.LEAST_BITS // 8)

    counted = Counter()
    for b in phrases.exact_counts(parts, 5, phrases.LEAST_BITS, Marks)(batches(texts)):
        for r in b.to_pylist():
            if r["size"]:
                counted[tuple(r["phrase"].split())] += r["f"]
    assert counted == exact
    stretch = phrases.Stretch("en", [(" ".join(p).encode().split(), 0) for p in exact])
    for size in range(1, 6):
        at, before = np.arange(len(stretch.ids)), None
        for m in range(1, size + 1):
            at, before = stretch.grams(m, before, at)
        alive = set(keys.tolist())
        for i, key in zip(at.tolist(), phrases.place(before, parts).tolist()):
            if exact[tuple(stretch.words[k].decode() for k in stretch.ids[i:i + size])] >= threshold:
                assert key in alive


def test_merge_bounds_what_is_lost():
    rnd = np.random.default_rng(5)
    have, exact, mass = (np.zeros(0, np.uint32), np.zeros(0, np.int64), 0), Counter(), 0
    for _ in range(30):
        keys, counts = np.unique(rnd.zipf(1.3, 400).clip(max=100_000).astype(np.uint32), return_counts=True)
        exact.update(dict(zip(keys.tolist(), counts.tolist())))
        mass += int(counts.sum())
        have = phrases.merge(have, keys, counts.astype(np.int64), 0, 50)
    assert len(have[0]) <= 50 and have[2] <= mass / 51
    kept = dict(zip(have[0].tolist(), have[1].tolist()))
    assert all(kept.get(k, 0) <= n <= kept.get(k, 0) + have[2] for k, n in exact.items())


# --- periodic runs ---------------------------------------------------------------------

def plain_runs(words, exponent, length):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_texts():
    rnd = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            n, k = rnd.choice([0, 1, 3, 8, 30, 80]), rnd.choice([1, 2, 3, 5])
            words = [rnd.randrange(k) for _ in range(n)]
            if n > 10 and rnd.random() < 0.6:
                a, p = rnd.randrange(n), rnd.randint(1, 6)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)] + [rnd.randrange(k)]
            texts.append(words)
        exponent, length = rnd.choice([2, 3, 4]), rnd.choice([1, 2, 6])
        ids = np.array([w for words in texts for w in words], dtype=np.int64)
        got = periodic.text_runs(ids, [len(words) for words in texts], exponent, length)
        assert got == [plain_runs(words, exponent, length) for words in texts]


def repeated(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_periods(spark, folder, docs):
    got = queries.op12_periods(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = []
    for doc_id, text, _ in docs:
        words = repeated(doc_id, text)
        runs = plain_runs(words, 4, 6) if len(words) < 3000 else [(0, len(words), 1)]
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert sum(w[1] > 0 for w in want) > 10


def test_collapse(spark):
    rows = [(1, "a b a b a b a b c", "x"), (2, "plain  text\n", "y"), (3, None, "z"), (4, "", None), (4, "t " * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = Counter(map(tuple, periodic.collapse(df).collect()))
    assert got == Counter([(1, "a b c", "x"), (2, "plain  text\n", "y"), (3, None, "z"), (4, "", None), (4, "t", None)])
    assert periodic.collapse(df.limit(0)).count() == 0 and periodic.find_runs(df.limit(0)).count() == 0


# --- repeated byte strings ---------------------------------------------------------------

def test_induced_order_and_common_prefixes(monkeypatch):
    """Any block size, memory (zero puts every tuple on disk) and depth of recursion gives the same order."""
    rnd = random.Random(5)
    for _ in range(600):
        n, k = rnd.choice([1, 2, 3, 5, 10, 40, 120]), rnd.choice([1, 2, 3, 8])
        x = [rnd.randrange(k) for _ in range(n)] * rnd.choice([1, 1, 3])
        cap = rnd.choice([0, 3, 50])
        monkeypatch.setattr(induced, "BLOCK", rnd.choice([1, 2, 5, 1 << 18]))
        text = np.array(x, dtype=np.uint8) if rnd.random() < 0.7 else np.array(x, dtype=np.int64) * 5
        places, lcps = [], []
        for at, lcp in induced.descending(text, cap, rnd.choice([0, 40, 1 << 20]), rnd.choice([1, 2, 1 << 20])):
            places += at.tolist()
            lcps += lcp.tolist() if cap else []
        assert places == sorted(range(len(x)), key=lambda i: x[i:], reverse=True)
        for a, b, n in zip(places, places[1:], lcps[1:]):
            same = 0
            while same < cap and max(a, b) + same < len(x) and x[a + same] == x[b + same]:
                same += 1
            assert n == same


def test_induced_order_of_bytes_with_the_largest(monkeypatch):
    """Texts without a zero byte are named eight bytes at a time; the largest byte ends stretches."""
    rnd = random.Random(7)
    monkeypatch.setattr(induced, "BLOCK", 16)
    for _ in range(150):
        x = [255 if rnd.random() < 0.15 else 1 + rnd.randrange(rnd.choice([2, 3, 255])) for _ in range(rnd.choice([20, 200]))] * rnd.choice([1, 2])
        found = list(induced.descending(np.array(x, dtype=np.uint8), 50, 1 << 20, rnd.choice([1, 1 << 20])))
        places, lcps = (np.concatenate([f[k] for f in found]).tolist() for k in (0, 1))
        assert places == sorted(range(len(x)), key=lambda i: x[i:], reverse=True)
        for a, b, n in zip(places, places[1:], lcps[1:]):
            assert x[a:a + n] == x[b:b + n] and (n == 50 or x[a + n:a + n + 1] != x[b + n:b + n + 1])


def test_stretches_without_a_partner_are_not_sorted(monkeypatch):
    """A stretch with a window of another one is sorted, any other is its first document's; the answer is that of a plain search."""
    rnd = random.Random(3)
    word = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    whole, cut = word(400), word(400)
    # `whole` lies in both documents from their start, `cut` between other bytes, and the short ones are no window.
    short = [word(30) for _ in range(20)]
    texts = [whole + word(60) + cut[:200] + word(80) + b"".join(s + word(60) for s in short) for _ in range(2)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, 3]), pa.array([t.decode() for t in texts]), pa.array([None, None], pa.list_(pa.int32()))], names=["_doc", "text", "single"])
    sent = list(suffixes._stretch_tables(50, np.zeros(0, dtype=np.int64), 1)(iter([batch])))
    held = []
    real = suffixes.first_windows
    monkeypatch.setattr(suffixes, "first_windows", lambda owners, parts, *a: held.extend(parts) or real(owners, parts, *a))
    got = pa.Table.from_batches(list(suffixes._shard_rows(50, 1 << 20, 1 << 20)(iter(sent)))).to_pylist()
    windows = Counter(p[i:i + 50] for p in held for i in range(len(p) - 49))
    assert held and not any(p in whole for p in held) and all(any(windows[p[i:i + 50]] > 1 for i in range(len(p) - 49)) for p in held)
    runs = suffixes.Windows(texts, 50)
    _, own = suffixes.cut_runs(runs, [np.zeros(0, dtype=np.int32)] * 2, np.zeros(0, dtype=np.int64))
    first = {7: set(), 3: set()}
    for r in got:
        k = 0 if r["_of"] == 7 else 1
        at = int(runs.first[own[k][r["rank"]]]) - int(runs.start[k])
        first[r["_of"]] |= {at + i for i in range(63) if r["marks"] >> i & 1}
    for k, doc in enumerate((7, 3)):
        windows = [texts[k][i:i + 50] for i in range(len(texts[k]) - 49)]
        assert first[doc] == {i for i, x in enumerate(windows) if doc == 3 or x not in texts[1]}


def plain_repeats(docs, length):
    """Result of every row: a string is a repeat if an earlier document has it."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    order = sorted(set(texts), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    first: dict[bytes, int] = {}
    out = {}
    for k, (_, text) in enumerate(order):
        for p in range(len(text) - length + 1):
            first.setdefault(text[p:p + length], k)
    for k, (doc_id, text) in enumerate(order):
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p:p + length]] < k:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(text, gone) if not x)
        out[doc_id, text] = (doc_id, len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return Counter(out[d] for d in texts)


def test_suffixes(spark, folder, docs):
    got = queries.op13_suffixes(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = plain_repeats([(i, t) for i, t, _ in docs], 50)
    assert Counter(map(tuple, got.collect())) == want and sum(r[2] for r in want) > 10_000


def test_hot_anchors_and_disk_change_nothing(spark, folder, docs, monkeypatch):
    """Anchors of two documents on go out window by window, tuples to disk, names into the recursion."""
    monkeypatch.setattr(suffixes, "HOT_LEAST", 2)
    small = [(i, (t or "")[:4000]) for i, t, _ in docs if i is None or i < 60 or i >= 1_000_000]
    df = spark.createDataFrame(small, "doc_id long, text string")
    got = suffixes.repeats(df, 50, memory=1000, base=50, hot_share=0.0).drop("spans")
    assert Counter(map(tuple, got.collect())) == plain_repeats(small, 50)


def test_repeats_out_of_texts(spark):
    line = "the same fifty bytes and some more of them, again and again"
    rows = [(2, "ä" + line + "ö end", 1), (1, line, 2), (3, None, 3), (3, "", 4), (4, "short", 5), (1, line, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = Counter(map(tuple, suffixes.remove_repeats(df).collect()))
    assert got == Counter([(2, "äö end", 1), (1, line, 2), (3, None, 3), (3, "", 4), (4, "short", 5), (1, line, 2)])
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.repeats(df.filter("doc_id < 3")).collect()}
    assert spans == {1: [], 2: [(2, 2 + len(line))]}
    assert suffixes.repeats(df.limit(0)).count() == 0 and suffixes.remove_repeats(df.limit(0)).count() == 0
