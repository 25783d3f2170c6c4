"""Ids of texts against the tokenizer itself, and what an encoder keeps."""

import random

import numpy as np
import public_tokenizers

from plainledger.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "B", " ", "  ", "\n", "'s", "'", "it's", "é", "日本", "1", "23", "-", "...", "<|", "|>", "<|endoftext|>", "Ġ", "\t", "ª", "_", "x", "ß", ""]


def test_ids_are_those_of_whole_texts():
    r, own = random.Random(3), tokens.Encoder(PATH, 50)
    texts = ["".join(r.choice(BITS) for _ in range(r.randrange(40))) for _ in range(1500)]
    texts += [" ".join(r.choice(BITS).strip() + r.choice("xyz.,") for _ in range(r.randrange(20))) for _ in range(1500)]
    texts.append(" ".join(f"w{k}," for k in range(3 * tokens.WORDS_AT_ONCE)))
    for at in range(0, len(texts), 700):
        some = texts[at: at + 700]
        whole = own.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        assert own.encode(some, 2) == [np.array([*x.ids, 2], dtype=own.width).tobytes() for x in whole]


def test_words_are_not_kept():
    own = tokens.Encoder(PATH)
    own.encode([" ".join(f"word{k}" for k in range(5000))], 2)
    assert sum(len(held) for held in vars(own).values() if isinstance(held, dict)) < 100
