"""Token ids as flat unsigned integer files with 64-bit document offsets.

A range partition of the documents, in id order, becomes one pair of files in a shared
folder: `<shard>.bin`, the ids of its documents end to end as little-endian unsigned
16- or 32-bit integers (16 where the vocabulary allows), and `<shard>.idx`, 64-bit
offsets (documents + 1) counted in ids from the shard's start. Both can be memory
mapped. `manifest` lists shard, documents, ids and `base`, the ids of all shards before
it: a prefix sum over one row per shard. A document starts at base + offset.

Files are written under a name of the task's attempt and moved in place when whole, so
a lost or repeated task leaves no half file; only shards of the manifest are read.

For a byte-level BPE, texts are cut at single blanks, line breaks and where letters
meet signs before they are encoded. The pre-tokeniser always starts a new piece there,
so the ids are those of the whole text. Words after single blanks are parted by Arrow, and
each distinct one of a bounded amount of text is encoded once; the other pieces are looked
up in what was seen before, which is cleared at a fixed number of entries.

Defined results: null and empty texts hold the end id alone; rows that share a doc_id
are ordered by their text's hash; a null doc_id sorts first; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plainledger.session import cut, run_dir

CACHE_PIECES = 100_000
SHARD_BYTES = 128 << 20
READ_IDS = 1 << 22
# Characters of text whose distinct words are encoded together, and words in one such text.
GROUP_CHARS = 16 << 20
WORDS_AT_ONCE = 4096

_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARK = r"!-&(-/:-@\[-`{-~"  # ASCII signs but the apostrophe, which may begin a contraction
# Places where a byte-level pre-tokeniser always starts a new piece: a single blank or
# line break between words, and where letters meet signs.
_CUT = re.compile(
    r"(?<=\S)(?=[ ]\S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)"
    f"|(?<=[{_LETTER}])(?=[{_MARK}])|(?<=[{_MARK}])(?=[{_LETTER}])")
# Blanks other than space and line break.
_ODD = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def pieces(text: str) -> list[str]:
    """The text in parts that the pre-tokeniser never joins."""
    return [text] if "<|" in text else _CUT.split(text)


def is_loose(text: str) -> bool:
    """Has a blank next to another blank or at an end, or a sign pair that may begin a special token."""
    return (
        text[:1] == " " or text[-1:] == " " or "  " in text or "\n " in text or " \n" in text or "<|" in text
        or _ODD.search(text) is not None)


def byte_letters() -> str:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


class Encoder:
    """Encodes distinct words of the texts once, other pieces with a bounded lookup of those seen before.

    Tokenizers other than plain byte-level BPE encode whole texts.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.limit = limit
        self.seen: dict[str, bytes] = {}
        self.letters = byte_letters()
        # Ids that begin with a blank: among words parted by single blanks these are the words' first ones.
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        self.opens[[n for token, n in vocabulary.items() if token[:1] == self.letters[0x20]]] = True
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.by_piece = (
            kind["model"]["type"] == "BPE" and not kind["model"].get("dropout") and not kind.get("normalizer")
            and not kind.get("post_processor") and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space"))

    def _learn(self, missing: list[str]) -> None:
        """Encode pieces that are not in the lookup; a run of letters needs the merges only."""
        merge, letters, kind = self.tokenizer.model.tokenize, self.letters, "H" if self.width.itemsize == 2 else "I"
        rest = []
        for piece in missing:
            if piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):
                spelt = codecs.charmap_decode(piece.encode(), "strict", letters)[0]
                ids = [t.id for t in merge(spelt)]
                self.seen[piece] = struct.pack(f"<{len(ids)}{kind}", *ids)
            else:
                rest.append(piece)
        for at in range(0, len(rest), 1 << 14):
            some = rest[at: at + (1 << 14)]
            for piece, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                ids = found.ids
                self.seen[piece] = struct.pack(f"<{len(ids)}{kind}", *ids)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that stand after a blank, end to end, and how many each has."""
        ids, counts = [np.zeros(0, self.width)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), WORDS_AT_ONCE):  # an encoding holds far more than its ids
            part = words[at: at + WORDS_AT_ONCE]
            found = self.tokenizer.encode_batch_fast([f" {' '.join(part)}"], add_special_tokens=False)[0]
            own = np.array(found.ids, dtype=self.width)
            first = np.flatnonzero(self.opens[own])
            if len(first) == len(part):
                ids.append(own)
                counts.append(np.diff(first, append=len(own)))
            else:  # a vocabulary whose ids do not tell where words begin
                alone = [x.ids for x in self.tokenizer.encode_batch_fast([f" {w}" for w in part], add_special_tokens=False)]
                ids.append(np.array([i for x in alone for i in x], dtype=self.width))
                counts.append(np.array(list(map(len, alone))))
        return np.concatenate(ids), np.concatenate(counts)

    def _tails(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of words after single blanks, but for the first word of each."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        sizes = np.diff(split.offsets.to_numpy()) - 1
        mask = np.ones(len(split.values), dtype=bool)
        mask[split.offsets.to_numpy()[:-1]] = False
        coded = split.values.filter(pa.array(mask)).dictionary_encode()
        ids, counts = self._word_ids(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        n = counts[index]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(counts) - counts)[index] - (ends - n), n)
        place += np.arange(len(place))
        data = ids[place].tobytes()
        cuts = (np.append(0, ends)[np.append(0, np.cumsum(sizes))] * self.width.itemsize).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """The ids of each text and the end id, as bytes of `width`."""
        end = np.array([end_id], dtype=self.width).tobytes()
        if not self.by_piece:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(x.ids, dtype=self.width).tobytes() + end for x in found]
        if len(self.seen) > self.limit:
            self.seen = {}
        seen = self.seen
        loose = [is_loose(t) for t in texts]
        heads = [pieces(t if own else t.partition(" ")[0]) for t, own in zip(texts, loose)]
        self._learn(list({p for some in heads for p in some}.difference(seen)))
        tails = iter(self._tails([t for t, own in zip(texts, loose) if not own]))
        return [b"".join([seen[p] for p in head]) + (b"" if own else next(tails)) + end for head, own in zip(heads, loose)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between tasks with what it has seen."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(texts: list[str], size: int = GROUP_CHARS):
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write the files and return the manifest as a table."""
    spark = docs.sparkSession
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{context.partitionId():06d}"
        attempt = f"{name}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        own = encoder(tokenizer)
        fs, root = pafs.FileSystem.from_uri(folder)
        sizes: list[np.ndarray] = []
        ids: list[pa.Array] = []
        out = None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if out is None:
                out = fs.open_output_stream(f"{root}/{attempt}.bin.tmp")
            for some in _slices(texts):
                encoded = own.encode(some, end_id)
                sizes.append(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // own.width.itemsize)
                out.write(b"".join(encoded))
            ids.append(batch.column("doc_id"))
        if out is None:
            return
        out.close()
        lengths = np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        with fs.open_output_stream(f"{root}/{attempt}.idx.tmp") as index:
            index.write(offsets.tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{root}/{attempt}.{kind}.tmp", f"{root}/{attempt}.{kind}")
        doc_ids = pa.chunked_array(ids).combine_chunks()
        keys = pa.array([attempt]), pa.array([context.partitionId()], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array([len(lengths)], pa.int64()), pa.array([int(offsets[-1])], pa.int64()),
             pa.array([own.width.itemsize], pa.int32()), pa.array([doc_ids], pa.list_(doc_ids.type))],
            names=["shard", "number", "n_docs", "n_ids", "width", "doc_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    ordered = (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie"))
    # The manifest is written as the tasks end: what it names is what is read.
    written = cut(ordered.mapInArrow(
        write, f"shard string, number long, n_docs long, n_ids long, width int, doc_ids array<{kind}>"))
    sums = written.select("shard", "number", "n_ids").withColumn(
        "base", F.coalesce(F.sum("n_ids").over(
            Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One short row per file, so this side is as small as the list of files.
    return written.join(F.broadcast(sums.select("shard", "base")), "shard")


def read_tokens(manifest: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: E731, B023
                name, base = get("shard").as_py(), get("base").as_py()
                if local:
                    ids = np.memmap(f"{root}/{name}.bin", dtype=f"<u{get('width').as_py()}", mode="r")
                    offsets = np.memmap(f"{root}/{name}.idx", dtype="<u8", mode="r").astype(np.int64)
                else:
                    with fs.open_input_file(f"{root}/{name}.bin") as f:
                        ids = np.frombuffer(f.read_buffer(), dtype=f"<u{get('width').as_py()}")
                    with fs.open_input_file(f"{root}/{name}.idx") as f:
                        offsets = np.frombuffer(f.read_buffer(), dtype="<u8").astype(np.int64)
                sums = [_crc(ids, a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [get("doc_ids").values, pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("shard", "width", "base", "doc_ids")
    # One task per file pair, whatever folder the manifest came from.
    return shards.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").mapInArrow(
        read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _crc(ids: np.ndarray, a: int, b: int) -> int:
    value = 0
    for at in range(a, b, READ_IDS):
        value = zlib.crc32(ids[at: min(b, at + READ_IDS)].astype("<u4").tobytes(), value)
    return value


def token_files(docs: DataFrame, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write the token files in the shared folder and read every document back."""
    spark: SparkSession = docs.sparkSession
    folder = run_dir(spark, "tokens")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, shards), folder, kind)
