"""Token ids as directly addressable codes.

Each document's ids are one binary value. An id is cut into chunks of 8 bits, the lowest first. Level i holds chunk i of every
id that has one, in order; a bitmap of the level says for each whether a chunk follows in the next. A rank directory holds the
set bits before every ``BLOCK`` bits of the bitmap, so the chunk of token t in the next level is found by one directory entry
and the bits of one block: any token is read without decoding the others.

Layout (little-endian): tokens u32, levels u32; for each level its length u32, then all chunks (u8), the bitmap (padded to
whole bytes) and the directory (u32 each). The last level has no bitmap.

Defined results: a null text gives a null value and null tokens; an empty text 0 tokens; any length is encoded whole; repeated
rows each give a row; a null doc_id is kept as null; an empty table gives no rows; other columns are ignored. Strings that
name special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from docquery.llm.common import batch_texts, map_texts, large_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK = 512
#: Pieces whose ids a worker keeps.
KNOWN = 100_000
#: A space next to white space of any kind.
BESIDE = r" [\t-\r\x{85}\p{Z}]|[\t-\r\x{85}\p{Z}] "


def encode_ids(ids: np.ndarray) -> bytes:
    """The directly addressable code of a document's ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    levels, maps = [], []
    while len(ids) or not levels:
        levels.append((ids & np.uint64(0xFF)).astype(np.uint8))
        more = ids > np.uint64(0xFF)
        if not more.any():
            break
        maps.append(more)
        ids = ids[more] >> np.uint64(8)
    parts = [np.array([len(levels[0]), len(levels), *(len(x) for x in levels)], dtype="<u4").tobytes()]
    for i, chunks in enumerate(levels):
        parts.append(chunks.tobytes())
        if i < len(maps):
            bits = maps[i]
            parts.append(np.packbits(bits, bitorder="little").tobytes())
            sums = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64)
            parts.append(np.r_[0, np.cumsum(sums)[:-1]].astype("<u4").tobytes())
    return b"".join(parts)


class Codes:
    """Reads a value of ``encode_ids``."""

    def __init__(self, value: bytes):
        self.value = value
        head = np.frombuffer(value, "<u4", 2)
        self.n, levels = int(head[0]), int(head[1])
        self.sizes = np.frombuffer(value, "<u4", levels, 8).tolist()
        self.at, place = [], 8 + 4 * levels
        for i, size in enumerate(self.sizes):
            chunks = place
            bitmap = place = place + size
            if i + 1 < levels:
                place += -(-size // 8)
            directory = place
            if i + 1 < levels:
                place += 4 * -(-size // BLOCK)
            self.at.append((chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, t: int) -> int:
        if not 0 <= t < self.n:
            raise IndexError(t)
        out = 0
        for i, (chunks, bitmap, directory) in enumerate(self.at):
            out |= self.value[chunks + t] << (8 * i)
            if i + 1 == len(self.at) or not self.value[bitmap + t // 8] >> (t % 8) & 1:
                break
            block = t // BLOCK
            rank = int.from_bytes(self.value[directory + 4 * block : directory + 4 * block + 4], "little")
            first = bitmap + block * (BLOCK // 8)
            bits = int.from_bytes(self.value[first : bitmap + t // 8 + 1], "little") & ((1 << (t - block * BLOCK)) - 1)
            t = rank + bits.bit_count()
        return out

    def all(self) -> np.ndarray:
        """Every id, by levels."""
        ids = np.zeros(0, np.uint64)
        for i in range(len(self.at) - 1, -1, -1):
            chunks, bitmap, _ = self.at[i]
            mine = np.frombuffer(self.value, np.uint8, self.sizes[i], chunks).astype(np.uint64)
            if i + 1 < len(self.at):
                bits = np.unpackbits(np.frombuffer(self.value, np.uint8, -(-self.sizes[i] // 8), bitmap), count=self.sizes[i], bitorder="little").astype(bool)
                mine[bits] |= ids << np.uint64(8)
            ids = mine
        return ids


class Tokenizer:
    """A byte-level vocabulary. What single spaces part is encoded once for each batch and put together again."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _of(self, piece: str) -> bytes:
        """A piece's ids, 4 bytes each: a list of integers takes several times as much."""
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= KNOWN:  # memory stays bounded
                self.known.clear()
            found = array("I", self.encoding.encode_ordinary(piece)).tobytes()
            if len(piece) <= 32:
                self.known[piece] = found
        return found

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Which texts are to be encoded whole; the ids of each distinct piece of the others; the pieces in order; where each text's start.

        A pretoken has a space only at its start, unless white space is next to white space. So a text where no space
        is next to white space can be cut before each space; any other is encoded as it is.
        """
        beside = np.asarray(pc.match_substring_regex(texts, BESIDE))
        lists = pc.split_pattern(pc.if_else(pa.array(beside), "", texts), " ")
        starts = np.asarray(lists.offsets, dtype=np.int64)
        starts = starts - starts[0]
        flat = lists.flatten().dictionary_encode()
        # a piece at the start of a text has no space before it
        code = np.asarray(flat.indices, dtype=np.int64) * 2 + 1
        code[starts[:-1]] -= 1
        there = np.flatnonzero(np.bincount(code, minlength=2 * len(flat.dictionary)))
        place = np.zeros(2 * len(flat.dictionary), np.int64)
        place[there] = np.arange(len(there))
        words = flat.dictionary.take(pa.array(there // 2)).to_pylist()
        return beside, [self._of(" " + w if c & 1 else w) for w, c in zip(words, there.tolist())], place[code], starts

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        beside, ids, code, starts = self._pieces(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.r_[0, np.cumsum(size[code])]
        n = ends[starts[1:]] - ends[starts[:-1]]
        for i in np.flatnonzero(beside):
            n[i] = len(self.encoding.encode_ordinary(texts[int(i)].as_py()))
        return n

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        beside, ids, code, starts = self._pieces(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.r_[0, np.cumsum(size)]
        n = size[code]
        ends = np.cumsum(n)
        out = pool[np.repeat(begin[code] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        ends = np.r_[0, ends][starts]
        got = [out[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for i in np.flatnonzero(beside):
            got[i] = np.array(self.encoding.encode_ordinary(texts[int(i)].as_py()), dtype=np.uint32)
        return got


def tokenizer_for(spark: SparkSession, vocabulary: str) -> Callable[[], Tokenizer]:
    """Makes the tokenizer once in each Python worker. The driver reads the vocabulary and sends it: executors need no such file."""
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a file of a public vocabulary, of some megabytes at most
    made: list[Tokenizer] = []

    def make() -> Tokenizer:
        if not made:
            made.append(Tokenizer(sent.value))
        return made[0]

    return make


def encoded(batches: Iterator[pa.RecordBatch], make: Callable[[], Tokenizer], limit: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens and codes of batches of doc_id and text, about ``limit`` bytes of text at a time."""
    for batch in large_batches(batches, "text", limit):
        missing = np.asarray(pc.is_null(batch.column("text")))
        ids = make().encode(batch_texts(batch.column("text")))
        codes = pa.array([None if gone else encode_ids(i) for i, gone in zip(ids, missing)], pa.binary())
        n = pa.array([None if gone else len(i) for i, gone in zip(ids, missing)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, codes], names=["doc_id", "n_tokens", "codes"])


def token_codes(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 8_000_000) -> DataFrame:
    """doc_id, n_tokens, codes: each document's ids as directly addressable codes.

    A worker takes about ``limit`` bytes of text at a time: more is less work, and needs some 20 times as much memory.
    """
    make = tokenizer_for(docs.sparkSession, vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), lambda batches: encoded(batches, make, limit), f"doc_id {kind}, n_tokens bigint, codes binary")
