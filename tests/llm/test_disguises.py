"""Literal disguises through the reader of toxicity scores."""

from collections import Counter

import numpy as np
import pytest

from plainledger.llm import toxicity

PLAIN = "what an idiot and moron he is a loser and a clown of a stupid scum they are trash or ass and dumb " * 200


@pytest.fixture(scope="module")
def reader():
    k = toxicity._byte_kinds()[np.frombuffer(PLAIN.encode(), dtype=np.uint8)]
    return toxicity.Reader(toxicity.Decoder(Counter(((k[:-2] * toxicity._KINDS + k[1:-1]) * toxicity._KINDS + k[2:]).tolist())))


@pytest.mark.parametrize("text, word", [
    ("i d i o t.", "idiot"), ("s c u m.", "scum"), ("(i d i o t)", "idiot"), ("m.o.r.o.n!", "moron"), ('"m o r o n"', "moron"),
    ("a l o s e r", "loser"), ("u r a l o s e r,", "loser"), ("cl.own", "clown"), ("idi-ot", "idiot"), ("st_upid", "stupid"),
    ("tras#", "trash"), ("a$$", "ass"), ("stuupid", "stupid"), ("(st_upid)!", "stupid"), ('"tras#"', "trash"),
    ("x-" * 40 + " id10t", "idiot"), ("/".join(["deadbeef0123"] * 9) + "/" + "st_upid", "stupid"), ("i d i o t", "idiot"),
])
def test_disguise_is_read(reader, text, word):
    for around in ("{}", "he said {} again"):
        assert word in reader.words(around.format(text))


def test_long_token_is_read_whole(reader):
    words = reader.words("q7" * 50_000 + "/st_upid")
    assert "stupid" in words


def test_a_token_is_looked_into_once(monkeypatch):
    looked, pattern = [], toxicity._DISGUISED

    class Counting:
        def search(self, text):
            looked.append(text)
            return pattern.search(text)

    monkeypatch.setattr(toxicity, "_DISGUISED", Counting())
    words = toxicity.Reader(toxicity.Decoder({})).words("plain words " * 500 + "h3llo, " * 500)
    assert words.count("plain") == 500 and len(words) > 1500
    assert len(looked) < 20
