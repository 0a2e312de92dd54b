"""Operator 10: token ids in directly addressable codes.

A block's ids are split into 8-bit chunks. Level k holds the k-th chunk of every
id that has one, a bitmap of the ids that go on to the next level, and a
directory of the bitmap's rank at every 512th bit. Any id is read from a few
bytes at each level, without decoding the block. Blocks of whole documents are
rows of Parquet files, range-partitioned and sorted by document, so the files
can lie in any store that Spark writes.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_small_batches, scratch_path, table
from .textarrays import _LOWER, _SPACE, chunks, kept, trimmed, utf8

MAGIC = b"DAC8"
EVERY = 512
#: A block is closed when it has so many ids; a document is never split.
BLOCK_IDS = 1 << 20
#: Bytes of text whose different words are encoded together.
RUN = 1 << 20
#: Words and pieces kept in each of the two generations of a worker's memory.
WORDS = 150_000


def pack(ids: np.ndarray) -> bytes:
    """A block of ids: header, then for each level its size, rank directory, bitmap, chunks."""
    rest, levels = ids.astype(np.uint32), []
    while len(rest) or not levels:
        more = rest > 255
        words = np.packbits(more, bitorder="little")
        words = np.append(words, np.zeros(-len(words) % (EVERY // 8), np.uint8))
        ones = np.bitwise_count(words.reshape(-1, EVERY // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones))).astype("<u4")
        levels.append(struct.pack("<QI", len(rest), len(ranks)) + ranks.tobytes() + words.tobytes() + rest.astype(np.uint8).tobytes())
        rest = rest[more] >> np.uint32(8)
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


def _levels(payload: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of directly addressable codes")
    at = 5
    for _ in range(payload[4]):
        n, r = struct.unpack_from("<QI", payload, at)
        at += 12
        ranks = np.frombuffer(payload, "<u4", r, at)
        at += 4 * r
        bits = np.frombuffer(payload, np.uint8, (r - 1) * EVERY // 8, at)
        at += len(bits)
        yield ranks, bits, np.frombuffer(payload, np.uint8, n, at)
        at += n


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a block."""
    levels, below = list(_levels(payload)), np.zeros(0, np.uint32)
    for _, bits, chunk in reversed(levels):
        out = chunk.astype(np.uint32)
        if len(below):
            out[np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little"))] |= below << np.uint32(8)
        below = out
    return below


def token_at(payload: bytes, i: int) -> int:
    """The i-th id alone: one chunk, one bit and one rank a level."""
    value = shift = 0
    for ranks, bits, chunk in _levels(payload):
        value |= int(chunk[i]) << shift
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        from_byte = (i // EVERY) * (EVERY // 8)
        before = int(np.bitwise_count(bits[from_byte : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        i, shift = int(ranks[i // EVERY]) + before, shift + 8
    raise IndexError(i)


#: Kinds of bytes: white space, the three that the tokenizer's pattern tells apart, bytes
#: of texts that are cut at white space only, first bytes of U+0080 to U+00FF, all others.
SPACE, LETTER, NUMBER, OTHER, ODD, LEAD, REST = range(7)
#: Characters that are their own NFC form, lower-case one by one, and are no white space
#: but in ASCII.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")


def _kind(c: str) -> int:
    if c in " \t\n\v\f\r":
        return SPACE
    return ODD if not _PLAIN.fullmatch(c) else LETTER if c.isalpha() else NUMBER if c.isnumeric() else OTHER


_KIND = np.array([_kind(chr(i)) for i in range(128)] + [REST] * 64 + [ODD] * 2 + [LEAD] * 2 + [ODD] * 60, dtype=np.uint8)
_KIND_128 = np.array([_kind(chr(i)) for i in range(128, 256)], dtype=np.uint8)
_LOWER_128 = np.array([chr(i).lower().encode()[1] for i in range(128, 256)], dtype=np.uint8)
#: The steps before the model for which words can be handled on their own.
_STEPS = [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]


def _byte_letters() -> dict[int, str]:
    """The character for each byte in a byte-level vocabulary: itself where it prints,
    else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that the ids of a text
    are those of its words at ASCII white space, one after the other. Texts of plain
    characters alone are lower-cased and cut into the pieces of the tokenizer's pattern
    at once, other texts into words. Each different piece or word is encoded once while
    it stays in memory; pieces skip the library's normaliser and go to the model."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        steps = [[x["type"] for x in config["normalizer"]["normalizers"]], [x["type"] for x in config["pre_tokenizer"]["pretokenizers"]]]
        if steps != _STEPS:
            raise ValueError("the tokenizer doesn't work word by word")
        self.model = self.tokenizer.model
        self.pieces = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = _byte_letters()
        self.special = [x["content"] for x in config["added_tokens"]]
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, raw: bytes) -> bytes:
        """The ids of a word, or a piece of one, as little-endian 32-bit integers; none for white space."""
        if (ids := self.new.get(raw)) is None:
            if (ids := self.old.get(raw)) is None:
                ids = self.word(raw)
            if len(self.new) >= WORDS:
                self.old, self.new = self.new, {}
            self.new[raw] = ids
        return ids

    def word(self, raw: bytes) -> bytes:
        if raw.isspace():
            return b""
        text = raw.decode()
        if raw.isalpha() and raw.islower():  # of bytes: ASCII letters alone
            return self.piece(text)
        if not _PLAIN.fullmatch(text) or ("<" in text and any(x[:2] in text for x in self.special)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = self.pieces(text.lower())
        return self.piece(pieces[0]) if len(pieces) == 1 else b"".join([self.ids(p.encode()) for p in pieces])

    def piece(self, text: str) -> bytes:
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The texts between the offsets, cut into white space, pieces and words without a
        gap, and each text's first part."""
        at, data = offsets - offsets[0], _LOWER[raw[offsets[0] : offsets[-1]]]
        n, kind = len(data), _KIND[data]
        lead = np.flatnonzero(kind == LEAD)
        if len(lead):
            code = (data[lead] & 1) << 6 | data[lead + 1] & 63
            data[lead + 1] = _LOWER_128[code]
            kind[lead] = kind[lead + 1] = _KIND_128[code]
        odd, text = [np.flatnonzero(kind == ODD)], data.tobytes()
        for x in {x[:2].lower().encode() for x in self.special}:
            odd.append(np.array([m.start() for m in re.finditer(re.escape(x), text)], dtype=np.int64))
        for i in np.unique(np.searchsorted(at, np.concatenate(odd), "right")) - 1:
            whole = slice(at[i], at[i + 1])
            data[whole] = raw[offsets[i] : offsets[i + 1]]
            kind[whole] = np.where(_SPACE[data[whole]], SPACE, ODD)
        opens = np.zeros(n + 1, dtype=bool)
        opens[at] = True
        cut = kind == NUMBER
        cut |= opens[:n]
        cut[1:] |= kind[1:] != kind[:-1]
        cut[lead + 1] = False
        mark = np.flatnonzero((data == 39) & cut & (kind == OTHER))  # 's|'t|'re|'ve|'m|'ll|'d
        mark = mark[~opens[mark + 1]]
        short = mark[np.isin(data[mark + 1], np.frombuffer(b"stmd", np.uint8))]
        mark = mark[~opens[mark + 2]] if len(mark) and mark[-1] + 2 <= n else mark[:-1][~opens[mark[:-1] + 2]]
        pair = data[mark + 1].astype(int) << 8 | data[mark + 2]
        long = mark[np.isin(pair, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])]
        cut[short + 1] = cut[long + 1] = False
        after = np.concatenate((short + 2, long + 3))
        cut[after[after < n]] = True
        start = np.flatnonzero(cut).astype(np.int32)  # a run has less than 2 GB
        parts = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, np.int32(n))), pa.py_buffer(data)])
        return parts, np.searchsorted(start, at.astype(np.int32))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts between the offsets, one text after the other, and each one's count."""
        if offsets[0] == offsets[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        parts, first = self.cuts(raw, offsets)
        coded, get = parts.dictionary_encode(), self.new.get
        _, ends, data = coded.dictionary.buffers()
        ends, data = np.frombuffer(ends, np.int32, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
        different = [self.ids(x) if (ids := get(x := data[i:j])) is None else ids for i, j in zip(ends, ends[1:], strict=False)]
        flat = pa.array(different, pa.large_binary()).take(coded.indices)
        _, ends, data = flat.buffers()
        ends = np.frombuffer(ends, np.int64, len(flat) + 1)
        return np.frombuffer(data, "<u4", ends[-1] // 4), np.diff(ends[first] // 4)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all whole texts to ``path`` in ascending order of document
    (null ids first, equal ids by a hash of the text). Null texts are empty: they
    have the end id alone. Other columns are ignored; an empty table gives no blocks."""
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc(), F.xxhash64("text").asc()).sortWithinPartitions("doc_id", F.xxhash64("text"))
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        purpose = f"tokens by {tokenizer}"
        trimmed(purpose)
        encoder = kept.get(purpose) or kept.setdefault(purpose, WordEncoder(tokenizer))
        part, block, ids, ends, found, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            data = np.concatenate(found)
            arrays = [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([pack(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "n_ids", "doc_ids", "ends", "codes"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            raw, offsets = utf8(batch.column(1))
            for first, last in chunks(offsets, RUN):
                data, count = encoder.encode(raw, offsets[first : last + 1])
                stop = np.cumsum(count)
                found.append(np.insert(data, stop, end_id).astype("<u4"))
                ends += (stop + np.arange(1, len(stop) + 1) + n).tolist()
                ids += keys[first:last]
                n += len(found[-1])
                if n >= BLOCK_IDS:  # a run of texts is never split, so neither is a document
                    yield row()
                    block, ids, ends, found, n = block + 1, [], [], [], 0
        if ids:
            yield row()
        trimmed(purpose)

    rows.mapInArrow(blocks, "part bigint, block bigint, n_ids bigint, doc_ids array<bigint>, ends array<bigint>, codes binary").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    in_small_batches(spark)
    files = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, keys, ends, codes in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "doc_ids", "ends", "codes")), strict=True):
                ids = unpack(codes).astype("<u4")
                bounds = [0, *ends]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, ends, strict=False)]
                arrays = [pa.array([part] * len(keys), pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = files.select("part", "block", "doc_ids", "ends", "codes").mapInArrow(decode, "part bigint, block bigint, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = files.select("part", "block", "n_ids")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("part_start"))  # a row for each partition written
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "block", inside.alias("block_start")).join(parts, "part")
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_tokens(spark, path)
