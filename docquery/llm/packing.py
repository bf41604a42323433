"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

An item goes where the sum over gaps of (open bins with that gap) squared becomes smallest: into an open bin whose gap
it fits, or into a new bin. Ties go to the smallest gap left. A document longer than a bin fills whole bins first; its
remainder is an item. Lengths are token ids of the vocabulary, so a bin never holds more ids than its capacity.

Every row gets a number when its length is written out, and rows are dealt to shards by a hash of that number, not of their
content, so rows of one id (null, or the epochs of a document) spread evenly. Shards hold about ``tokens_a_shard`` tokens and
are packed independently: work grows in proportion to the input, and each shard leaves at most a few bins part-filled.

``pack`` gives the places of the pieces and moves only numbers; ``sequences`` moves the ids and gives whole sequences.

Defined results: a null or empty text has no tokens and is not packed; repeated rows are packed once for each row, told apart
by ``row``; a null doc_id is packed and kept as null; an empty table gives no rows; other columns are ignored, whatever their
names. In a shard, items are packed in order of doc_id (null first), then tokens, then row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import batch_texts, map_texts, materialise, shards_for, large_batches
from docquery.llm.tokenids import VOCABULARY, Codes, encode_ids, token_codes, tokenizer_for

CAPACITY = 2048
TOKENS_A_SHARD = 4_000_000
#: Bytes of text that a worker of ``sequences`` encodes at a time.
TEXTS = 2_000_000


def sum_of_squares(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, none above ``capacity``, in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; full bins don't count
    bins_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, made = [], 0
    for size in sizes:
        # change of the sum: a bin moves from gap g to g - size
        gaps = np.arange(size, capacity)
        change = np.full(capacity - size + 1, np.iinfo(np.int64).max)
        left = count[: capacity - size + 1].copy()
        left[0] = -1  # gap 0 counts for nothing: 2 * -1 + 1 below must give 0
        gain = 2 * left + 1
        gain[0] = 0
        if len(gaps):
            there = count[size:capacity]
            change[:-1] = np.where(there > 0, gain[:-1] - 2 * there + 1, change[:-1])
        change[-1] = gain[-1]  # a new bin of gap ``capacity``
        to = int(np.argmin(change))
        gap = to + size
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = bins_of[gap].pop()
            count[gap] -= 1
        if to:
            bins_of[to].append(at)
            count[to] += 1
        placed.append((at, capacity - gap))
    return placed


def places(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of the documents of one shard, in order: item (its row in ``pdf``), piece, bin, offset, length."""
    rows, made = [], 0
    n = pdf["n_tokens"].to_numpy()
    whole, rest = n // capacity, n % capacity
    packed = iter(sum_of_squares([int(x) for x in rest if x], capacity))
    spare = int(whole.sum())  # whole bins first, then those that sum_of_squares makes
    for i in range(len(n)):
        for piece in range(int(whole[i])):
            rows.append((i, piece, made, 0, capacity))
            made += 1
        if rest[i]:
            at, offset = next(packed)
            rows.append((i, int(whole[i]), spare + at, offset, int(rest[i])))
    return pd.DataFrame(rows, columns=["item", "piece", "bin", "offset", "length"]).astype("int32")


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["doc_id", "n_tokens", "row"], na_position="first", kind="stable").reset_index(drop=True)


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """shard, doc_id, row, piece, bin, offset, length of one shard."""
    pdf = _in_order(pdf)
    out = places(pdf, capacity)
    item = out.pop("item").to_numpy()
    for name in ("row", "doc_id", "shard"):
        out.insert(0, name, pdf[name].array.take(item))
    return out


def _dealt(numbered: DataFrame, tokens_a_shard: int) -> DataFrame:
    """Rows with their shard, a task's worth of whole shards each."""
    total = numbered.agg(F.sum("n_tokens")).first()[0] or 0
    shards = shards_for(total, tokens_a_shard)
    return numbered.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).repartition(shards, "shard")


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row."""
    make = tokenizer_for(docs.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large_batches(batches, "text"):
            n = make().count(batch_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), count, f"doc_id {kind}, n_tokens bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokens_a_shard: int = TOKENS_A_SHARD, vocabulary: str = VOCABULARY) -> DataFrame:
    """shard, doc_id, row, piece, bin, offset, length: where each piece of each document lies; bins are numbered in each shard."""
    sized = lengths(docs, vocabulary).where(F.col("n_tokens") > 0)
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _dealt(sized, tokens_a_shard).groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity), f"shard int, doc_id {kind}, row bigint, piece int, bin int, offset int, length int")


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokens_a_shard: int = TOKENS_A_SHARD, vocabulary: str = VOCABULARY) -> DataFrame:
    """shard, bin, n_tokens, pieces and codes: each training sequence, its ids as directly addressable codes.

    ``pieces`` lists, in order, of which documents the ids are: doc_id, row (each row of ``docs`` has its own), piece,
    offset in the sequence and length.
    """
    coded = token_codes(docs, vocabulary, TEXTS).where(F.col("n_tokens") > 0)
    coded = materialise(coded.withColumn("row", F.monotonically_increasing_id()))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        where = places(pdf, capacity).sort_values(["bin", "offset"], kind="stable")
        ids = [Codes(bytes(c)).all().astype(np.uint32) for c in pdf["codes"]]
        ident = [None if pd.isna(d) else d for d in pdf["doc_id"]]
        row = pdf["row"].tolist()
        out, shard = [], int(pdf["shard"].iloc[0])
        for number, part in where.groupby("bin", sort=True):
            pieces, held = [], []
            for i, piece, offset, length in zip(part["item"], part["piece"], part["offset"], part["length"]):
                begin = piece * capacity
                held.append(ids[i][begin : begin + length])
                pieces.append({"doc_id": ident[i], "row": row[i], "piece": piece, "offset": offset, "length": length})
            out.append((shard, number, sum(map(len, held)), pieces, encode_ids(np.concatenate(held))))
        return pd.DataFrame(out, columns=["shard", "bin", "n_tokens", "pieces", "codes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    form = f"shard int, bin int, n_tokens int, pieces array<struct<doc_id:{kind},row:bigint,piece:int,offset:int,length:int>>, codes binary"
    return _dealt(coded, tokens_a_shard).groupBy("shard").applyInPandas(build, form)
