"""Every query of the subpackage against a brute-force version on small tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plainledger.llm import mixing, queries, urlfilter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

BASE = " ".join(f"w{i}" for i in range(120))
ODD = [
    (0, None, None), (1, "", "a"), (2, " \n\t ", "a"), (3, "one", None), (4, "one two", "a"),
    (5, BASE, "a"), (6, BASE, "b"), (7, "x " * 45 + BASE + " tail of it", "a"), (7, "another text with the same id", "a"),
    (8, "Ünï çødé Wörter ÄÖ\u3000wide\u00a0space " * 9, "a"), (9, "a " * 6000, "a"), (9, "a " * 6000, "a"),
    (None, "no id here", "a"), (None, BASE, "a"), (12, "line one\nline one\n\n#$% |<>&*\nLine  ONE", "b"),
    (13, BASE.replace("w50", "zz"), "a"), (14, "<|endoftext|> x  y\n z\r\n ", "c"), (15, "y" * 300_000, "c"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with odd rows added to documents and pages."""
    out = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None if i is None else i + 1_000_000, t, "en", s, None) for i, t, s in ODD], docs.schema)
    docs.unionByName(odd).withColumn("kept", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn(
        "host", F.lit("x")).write.parquet(f"{out}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    long = "<p>" + "ä\r\n\r\nWARC/1.0\r\n" * 90_000
    extra = [
        (900_001, None, None), (900_002, "no scheme", ""), (900_003, "http://EXAMPLE.net/en/A?x", "s" * 100),
        (900_004, "ftp://a.Example.com/de/x#y", "s" * 100), (900_005, "x://net", "short"), (900_006, "x://net/", "short"),
        (900_007, "https://a.org/fr/", long), (900_008, "https://b.example.net", long), (900_009, "http://u/", "ends\r\n" * 40),
        (900_009, "http://u/", "ends\r\n" * 40),
    ]
    pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumn("verdict", F.lit("clash")).write.parquet(f"{out}/pages.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def rows(spark, folder, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def many(items):
    return Counter(map(repr, items))


def test_simhash(spark, folder, docs):
    prints = []
    for _, text, _ in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles)))
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[top(i)] = top(j)
    least = defaultdict(list)
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[top(i)].append(d[0])
    want = [(d[0], f"{p:016x}", min(least[top(i)], default=None)) for i, (d, p) in enumerate(zip(docs, prints))]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, folder, "op2_simhash")]
    assert many(got) == many(want)


def test_tokens(spark, folder, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    got = rows(spark, folder, "op3_tokens")
    want = Counter()
    for doc_id, text, _ in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want[(doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_decontamination(spark, folder, docs):
    cut = re.compile(r"[^\W_]+")

    def shingles(text):
        words = cut.findall(text.lower())
        return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}

    held = defaultdict(set)
    for doc_id, text, _ in docs:
        if doc_id is not None:
            held[doc_id] |= shingles(text)
    want = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        own = shingles(r["text"] or "")
        want |= {(d, r["item_id"]) for d, h in held.items() if own and len(own & h) >= 0.8 * len(own)}
    got = [(r["doc_id"], r["item_id"]) for r in rows(spark, folder, "op4_decontamination")]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_substring(spark, folder, docs):
    first, order = {}, []
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0)):
        order.append(k)
    seen_rows = {}
    want = {}
    for k in order:
        doc_id, text, _ = docs[k]
        if (doc_id, text) in seen_rows:  # equal rows are one document
            want[k] = want[seen_rows[(doc_id, text)]]
            continue
        seen_rows[(doc_id, text)] = k
        words = WORD.findall(text)
        gone = set()
        for i in range(len(words) - 19):
            key = tuple(words[i:i + 20])
            if key in first:
                gone.update(range(i, i + 20))
            else:
                first[key] = (doc_id, i)
        kept = " ".join(x for i, x in enumerate(words) if i not in gone)
        want[k] = (doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, folder, "op6_substring")]
    # Rows of one id with different texts are ordered by the texts' hashes: none of them overlap here but by null ids.
    assert many(got) == many(want.values())
    assert any(r[2] for r in got)


def test_sharding(spark, folder, docs):
    got = rows(spark, folder, "op7_sharding")
    want = Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t, _ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_url_filter(spark, folder):
    got = {r["page_id"]: r for r in rows(spark, folder, "op8_url_filter")}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert sum(1 for _ in got) == len({r["page_id"] for r in pages})
    for r in pages:
        url = r["url"] or ""
        rest = url.partition("://")[2]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match("[^/?#]*", rest).group())
        path = re.match("[^/?#]*([^?#]*)", rest).group(1)
        fits = [(len(t), t, v) for v, t in queries.URL_RULES
                if ("." + host).endswith("." + t.partition("/")[0]) and path.startswith("/" + t.partition("/")[2])]
        own = got[r["page_id"]]
        assert (own["host"], own["path"]) == (host, path)
        assert own["rule"] == (max(fits)[1] if fits else None)
        assert own["verdict"] == max(fits)[2] if fits else own["verdict"] in ("allow", "block")


def test_quality(spark, folder, docs):
    want = []
    for doc_id, text, _ in docs:
        words = WORD.findall(text)
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        hit = {k for i, x in enumerate(windows) if counts[x] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n = len(words)
        want.append((doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                     len(hit), n < 50 or 100 * len(hit) > 50 * n))
    got = rows(spark, folder, "op9_quality")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert many(tuple(r[n] for n in names) for r in got) == many(want)
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)


def test_warc(spark, folder):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    first = {}
    for page_id, body in sorted(pages):
        first.setdefault(body, page_id)
    want = []
    for page_id, body in pages:
        again = len(body) >= 100 and first[body] != page_id
        want.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                     first[body] if again else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
           for r in rows(spark, folder, "op10_warc")]
    assert many(got) == many(want)


def test_toxicity(spark, folder, docs):
    got = rows(spark, folder, "op5_toxicity")
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _, _ in docs)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == out


def test_mixing(spark, folder, docs):
    got = rows(spark, folder, "op1_mixing")
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((d, len(WORD.findall(t))) for d, t, _ in docs)
    for r in got:
        assert abs(sum(r["posterior"]) - 1) < 1e-9 and r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, make in queries.QUERIES.items():
        assert make(spark, str(tmp_path)).count() == 0, name


def test_mixing_words_are_those_between_blanks_without_signs(spark):
    texts = [None, "", " \t\n#!", "Ab-c #x\x0b\x0cdon't  !!! ab\rC", "##", "\u00c0\u00e9 abc abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in mixing.with_buckets(rows, ["doc_id"]).collect()}
    for n, text in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        plain = {w.translate({ord(c): None for c in mixing.SIGNS}) for w in words} - {""}
        assert got[n]["n_tokens"] == len(words)
        assert len(got[n]["buckets"]) == len(plain) + 3  # three of the text's shape


def test_url_model_equals_brute_force(spark, folder):
    """Scores and verdicts against models counted character by character."""
    got = urlfilter.judge(spark.read.parquet(f"{folder}/pages.parquet"), queries.URL_RULES).collect()
    own = dict(queries.URL_RULES[k][::-1] for k in range(len(queries.URL_RULES)))
    size, edge = urlfilter.KINDS, urlfilter.KINDS - 1

    def coded(r):
        text = re.sub("[0-9]", "0", (r["host"] + r["path"]).lower())
        return [edge, edge] + [urlfilter.LETTERS.find(c) if c in urlfilter.LETTERS else edge - 1 for c in text] + [edge]

    def fold(r):
        signed = xxhash.xxh64_intdigest(r["path"].encode(), xxhash.xxh64_intdigest(r["host"].encode(), 42))
        return signed % urlfilter.HOLD_OUT

    seen = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for r in got:
        if r["rule"] and fold(r):
            code = coded(r)
            for i in range(2, len(code)):
                for order in (0, 1, 2):
                    seen[own[r["rule"]]][tuple(code[i - order:i])][code[i]] += 1

    def chance(table, context, c):
        low = chance(table, context[1:], c) if context else 1 / size
        after = table.get(context)
        return (after[c] + len(after) * low) / (sum(after.values()) + len(after)) if after else low

    def ratio(r):
        code = coded(r)
        parts = [np.log(chance(seen["allow"], tuple(code[i - 2:i]), code[i]) / chance(seen["block"], tuple(code[i - 2:i]), code[i]))
                 for i in range(2, len(code))]
        return sum(parts) / len(parts)

    assert all(r["score"] == pytest.approx(ratio(r), abs=1e-5) for r in got)
    bins = Counter((int(np.clip(np.floor(r["score"] / urlfilter.BIN), -1000, 1000)), own[r["rule"]]) for r in got if r["rule"] and not fold(r))
    whole = {v: max(1, sum(n for (_, w), n in bins.items() if w == v)) for v in seen}

    def gain(k):
        return (sum(n for (b, v), n in bins.items() if v == "allow" and b >= k) / whole["allow"]
                + sum(n for (b, v), n in bins.items() if v == "block" and b < k) / whole["block"])

    limit = max(((gain(k), -abs(k), k) for k, _ in bins), default=(0, 0, 0))[2] * urlfilter.BIN
    for r in got:
        assert r["verdict"] == (own[r["rule"]] if r["rule"] else "allow" if r["score"] >= limit else "block")
