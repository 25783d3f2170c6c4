"""Columns with clashing names, rows without or with repeated ids, and words that a plain polynomial hash confuses."""

import pytest
from pyspark.sql import functions as F

from plainledger.llm import contamination, mixing, quality, sharding, simhash, substring, words

# Names that the operators use inside, and some of their results.
NAMES = ("p", "buckets", "_rate", "copied", "single", "first", "_doc", "_of", "_gone", "_id", "_host", "_s", "_keep", "_found",
         "_place", "_block", "_rank", "_hash", "_own", "carried_1", "Shard", "copies", "text_hash", "shingle", "drawn")


@pytest.fixture(scope="module")
def docs(spark):
    line = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{line} own{k} " + " ".join(f"t{k}x{j}" for j in range(60)), "host") for k in range(8)] + [(None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in NAMES:
        plain = plain.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return plain


def same_extras(found, docs, gone=()):
    shown = [c for c in docs.columns if c.lower() not in gone]
    assert found.columns[:len(shown)] == shown
    for r in found.collect():
        end = "-" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[name] == name + end for name in NAMES if name.lower() not in gone)


def test_extra_columns_keep_names_and_values(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "no such item is in any of the texts at all")], "item_id long, text string")
    same_extras(mixing.mix(docs, labels), docs, ("copies", "rate"))
    same_extras(mixing.draw(docs, labels, max_rate=1), docs)
    same_extras(substring.remove_repeats(docs), docs)
    same_extras(quality.clean(docs), docs)
    same_extras(sharding.shard(docs, 3), docs, ("shard", "slot"))
    same_extras(sharding.shard(docs.limit(0), 3), docs, ("shard", "slot"))
    same_extras(simhash.deduplicate(docs), docs)
    kept = contamination.decontaminate(docs, items)
    same_extras(kept, docs)
    assert kept.count() == 9


def test_test_items_go_whatever_their_ids(spark):
    item = "what is the name of the seventh moon of the planet"
    rows = [(None, f"before {item} after"), (1, f"once more {item}"), (1, "a clean text under the same id as the other"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, None)], "item_id long, text string")
    assert sorted(contamination.decontaminate(docs, items).collect(), key=str) == sorted([rows[2], rows[3]], key=str)


def mirrored(doublings):
    one = "a"
    for _ in range(doublings):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_in_thue_morse_order_differ(spark):
    for doublings in range(1, 14):
        one, two = words.hashes(" ".join(mirrored(doublings)).encode())
        assert one != two
    one, two = mirrored(11)
    rest = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.parse(docs).collect()} == {1: 0, 2: 0, 3: 20}
