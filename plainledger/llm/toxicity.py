"""Toxicity scores of texts after noisy-channel deobfuscation.

A character trigram model is counted over all texts (a table bounded by the alphabet).
Every token with a sign, an inner separator, a digit beside a letter or a doubled
letter, however long, is decoded by the Viterbi algorithm over a lattice: a look-alike
sign stands for any of its letters, a repeated letter may be one or two typed longer,
separators vanish, and paths are weighed by the language model and a cost per
correction. Spaced-out single letters are first joined to one token, and read again
without the one-letter words they begin with; quotes, brackets and end signs around a
token are read with it and without. Readings are added to the words as they stand.

The score is learned from labelled rows (at most FIT_ROWS, taken by a hash of their id;
copies of a text count once): words and word beginnings whose share of toxic texts
is significantly high are kept with that share, smoothed. A text's score is the noisy-or of the entries it holds, with the toxic share of texts that hold none as the
floor. The list is bounded by ENTRIES and is the only thing tasks get besides texts.

Defined results: null and empty texts hold no entry and get the floor; without labels
the floor is 0 and so is every score; a null doc_id is not held out and never
learned from; repeated rows get one result each; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainledger.llm.common import per_batch, utf8
from plainledger.session import cut

FIT_ROWS = 40_000
ENTRIES = 20_000
STARTS = (4, 5, 6)
MIN_TOXIC = 6
Z = 6.5
MIN_SHARE = 0.5
DECISION = 0.3
HELD_OUT = 2

# Look-alikes and the letters they may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h", "%": "o",
}
_SEPARATORS = ".-_*~"
_CORRECTION = -1.0  # log cost of a look-alike read as a letter
_KEEP = -6.0  # log cost of leaving a sign in a word
_REPEAT = -0.5  # log cost of a repeated letter typed for one
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_KINDS = len(_LETTERS) + 2  # other letters, word border
_OTHER, _BORDER = _KINDS - 2, _KINDS - 1
_LOOK_KINDS = {c: [(x, _LETTERS.index(x)) for x in letters] for c, letters in LOOKS.items()}

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
# Single letters or look-alikes parted by one separator or blank, four at least.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!+])(?:[ ._\-*~](?:[^\W_]|[@$!+])){3,}(?![^\W_])")
# A look-alike sign beside another or a letter or digit, a digit beside a letter, a
# separator between letters, or a doubled letter.
_DISGUISED = re.compile(
    r"[@$!|+(€*#%][@$!|+(€*#%]|[^\W_][@$!|+(€*#%]|[@$!|+(€*#%][^\W_]|\d[^\W\d_]|[^\W\d_]\d"
    r"|[^\W_][.\-_*~]+[^\W_]|([^\W\d_])\1")
_LEADING = "aiour"  # words of one letter before a spaced-out word
_POINTS = ".,;:?"
_EDGES = _POINTS + "!\"'`()[]{}<>…“”„‘’«»"


@lru_cache(maxsize=1)
def _byte_kinds() -> np.ndarray:
    table = np.full(256, _BORDER, dtype=np.int64)
    table[128:] = _OTHER
    for k, c in enumerate(_LETTERS):
        table[ord(c)] = table[ord(c.upper())] = k
    return table


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(cell, n) of byte-class trigrams over all texts."""

    def count(batches):
        total = np.zeros(_KINDS ** 3, dtype=np.int64)
        for batch in batches:
            for text in utf8(batch, "text"):
                for at in range(0, len(text), 1 << 20):
                    k = _byte_kinds()[np.frombuffer(text[at: at + (1 << 20) + 2], dtype=np.uint8)]
                    if len(k) > 2:
                        total += np.bincount((k[:-2] * _KINDS + k[1:-1]) * _KINDS + k[2:], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    return docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class Decoder:
    """Viterbi decoder of one token under a character trigram model."""

    def __init__(self, counts: dict[int, int]):
        table = np.full(_KINDS ** 3, 0.1)
        for cell, n in counts.items():
            table[cell] += n
        table = table.reshape(_KINDS, _KINDS, _KINDS)
        self.logp = np.log(table / table.sum(axis=2, keepdims=True)).tolist()

    @staticmethod
    def kind(c: str) -> int:
        at = _LETTERS.find(c)
        return at if at >= 0 else _OTHER if c.isalpha() else _BORDER

    def read(self, token: str) -> str:
        """The likeliest plain reading of a lower-case token."""
        # State: the last two read characters; value: log probability, the reading as a
        # chain from its end, so that time grows with the token's length only, and the
        # kinds of the two characters.
        paths: dict = {("", ""): (0.0, None, _BORDER, _BORDER)}
        for c in token:
            found: dict = {}
            get = found.get
            letter, own = c.isalpha(), self.kind(c)
            for (a, b), (value, text, kind_a, kind_b) in paths.items():
                logp = self.logp[kind_a][kind_b]
                if letter:  # most characters by far
                    new = value + logp[own]
                    have = get((b, c))
                    if have is None or have[0] < new:
                        found[b, c] = new, (text, c), kind_b, own
                    if c != b:
                        continue
                    offers = [((a, b), value + _REPEAT, text, kind_a, kind_b)]
                else:
                    offers = []
                    for x, kind in _LOOK_KINDS.get(c, ()):
                        offers.append(((b, x), value + _CORRECTION + logp[kind], (text, x), kind_b, kind))
                        if x == b:
                            offers.append(((a, b), value + _CORRECTION + _REPEAT, text, kind_a, kind_b))
                    if c in _SEPARATORS:
                        offers.append(((a, b), value + _CORRECTION, text, kind_a, kind_b))
                    offers.append(((b, c), value + _KEEP, (text, c), kind_b, own))
                for state, new, chain, first, second in offers:
                    have = get(state)
                    if have is None or have[0] < new:
                        found[state] = new, chain, first, second
            # The number of states is bounded by the look-alikes of two characters.
            paths = found
        ends = [(value + self.logp[kind_a][kind_b][_BORDER], text) for value, text, kind_a, kind_b in paths.values()]
        top = max(value for value, _ in ends)
        return max(self._spell(text) for value, text in ends if value == top)

    @staticmethod
    def _spell(text) -> str:
        out = []
        while text is not None:
            text, c = text
            out.append(c)
        return "".join(reversed(out))


class Reader:
    """Lower-case words of a text, disguised ones restored."""

    def __init__(self, decoder: Decoder, limit: int = 300_000):
        self.decoder, self.limit, self.seen, self.tokens = decoder, limit, {}, {}

    def _restore(self, token: str) -> str:
        if len(token) > 64:  # too rare and long to remember
            return self.decoder.read(token)
        if token not in self.seen:
            if len(self.seen) >= self.limit:
                self.seen = {}
            self.seen[token] = self.decoder.read(token)
        return self.seen[token]

    def _readings(self, token: str) -> tuple[str, ...]:
        """Words of the readings of a token as it stands in a text; none if it is not disguised."""
        if not _DISGUISED.search(token):
            return ()
        parts = {token.strip(_POINTS), token.strip(_EDGES)}
        return tuple(w for part in parts if _DISGUISED.search(part) for w in _WORD.findall(self._restore(part)))

    def words(self, text: str) -> list[str]:
        text = text.lower()
        found = _WORD.findall(text)
        for match in _SPACED.finditer(text):
            letters = re.sub(r"[ ._\-*~]", "", match.group())
            if len(set(letters)) > 1:
                readings = {letters, letters.rstrip("!+")}
                while len(letters) > 3 and letters[0] in _LEADING:
                    letters = letters[1:]
                    readings |= {letters, letters.rstrip("!+")}
                for letters in sorted(readings):
                    found.extend(_WORD.findall(self._restore(letters)))
        if _DISGUISED.search(text):
            if len(self.tokens) >= self.limit:
                self.tokens = {}
            known = self.tokens
            for token in _TOKEN.findall(text):
                more = known.get(token)
                if more is None:
                    more = self._readings(token)
                    if len(token) <= 64:
                        known[token] = more
                found.extend(more)
        return found

    def entries(self, text: str) -> set[str]:
        """Distinct words, and beginnings of words marked by a hyphen."""
        words = set(self.words(text))
        found = set(words)
        for n in STARTS:
            found.update([w[:n] + "-" for w in words if len(w) > n])
        return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Trigram counts of all texts, and the share of toxic texts per telling entry."""
    counts = {r["cell"]: r["n"] for r in trigram_counts(docs).collect()}
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, rows / max(1, known.count()))
    sample = cut(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
                 .groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").cast("int").alias("toxic")))
    texts = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("of"))
    decoder = Decoder(counts)

    def entries(batches):
        reader = Reader(decoder)
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            names, owners = [], []
            for text, label in zip(utf8(batch, "text"), toxic):
                own = reader.entries(text.decode("utf-8", "replace"))
                own.add("")  # counts the text itself
                names.extend(own)
                owners.extend([label] * len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(owners, pa.int32())], names=["entry", "toxic"])

    once = texts.groupBy(F.xxhash64("text").alias("same")).agg(
        F.any_value("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    per_entry = cut(
        once.mapInArrow(entries, "entry string, toxic int").groupBy("entry")
        .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("bad") >= MIN_TOXIC) | (F.col("entry") == "")))
    whole = per_entry.filter(F.col("entry") == "").first()
    if whole is None or not whole["bad"]:
        return {"counts": counts, "entries": {}, "floor": 0.0}
    base = whole["bad"] / whole["n"]
    rate = F.col("bad") / F.col("n")
    error = F.sqrt(F.lit(base * (1 - base)) / F.col("n"))
    smooth = (F.col("bad") + base) / (F.col("n") + 1)
    top = (
        per_entry.filter((F.col("entry") != "") & (smooth >= MIN_SHARE) & ((rate - base) / error > Z))
        .select("entry", smooth.alias("share"), ((rate - base) / error).alias("z"))
        .orderBy(F.desc("z"), "entry").limit(ENTRIES).collect())
    known_entries = {r["entry"]: r["share"] for r in top}
    found = once.mapInArrow(_scorer(decoder, known_entries, 0.0), "score double, toxic int")
    rest = found.filter(F.col("score") == 0).agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    floor = (rest["bad"] or 0) / max(1, rest["n"])
    return {"counts": counts, "entries": known_entries, "floor": float(floor)}


def text_score(reader: Reader, text: str, known: dict[str, float], floor: float) -> float:
    left = 1.0 - floor
    for entry in reader.entries(text):
        share = known.get(entry)
        if share is not None:
            left *= 1.0 - share
    return 1.0 - left


def _scorer(decoder: Decoder, known: dict[str, float], floor: float):
    def run(batches):
        reader = Reader(decoder)
        for batch in batches:
            scores = [text_score(reader, t.decode("utf-8", "replace"), known, floor) for t in utf8(batch, "text")]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(scores, pa.float64()), *(batch.column(n) for n in rest)], names=["score", *rest])

    return run


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("text", "doc_id").mapInArrow(
        _scorer(Decoder(model["counts"]), model["entries"], model["floor"]), f"score double, doc_id {kind}")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
