"""Suffix-array dedup: passages of at least ``LENGTH`` words that occur more than once, by merging Burrows-Wheeler transforms.

Words are what white space separates, as written. Of every window of ``LENGTH`` words the smallest hash of its runs of
``SEED`` words is its anchor, so equal windows have equal anchors. Anchors that occur once in the corpus are dropped. Each
other occurrence becomes a snippet: the words of the neighbouring windows that have this anchor. Each window lies in one
snippet, and snippets that share a window share an anchor, so a shuffle on the anchor brings all equal windows together.

In a partition, equal snippets are one (their windows are repeats). The rest form shards; each shard's rotations are sorted
and give its Burrows-Wheeler transform. The transforms are merged by refining an interleave of their rows: each round sorts
the rows by one symbol more, by a stable sort on the transform's symbols, and never compares suffixes again. Two neighbours
that the first ``LENGTH`` rounds don't part have a common prefix of that length; such runs are the repeated intervals.

Defined results: a null text and a text of fewer words have no spans; any length is searched whole; rows equal in doc_id and
text count as one document; a null doc_id is kept as null and differs from every other; a passage repeated within one document counts; an empty table
gives no rows; other columns are ignored. Spans that overlap or touch are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import batch_texts, doc_key, map_texts, materialise, mix, shards_for, small_batches, split_words

LENGTH = 50
SEED = 20
SHARD_WORDS = 100_000
SNIPPETS_A_PARTITION = 40_000


def windows(words: np.ndarray, doc: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window that lies in one document: where it starts, where its anchor starts, and the anchor."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    run = words.copy()
    done = 1
    while done < seed:  # hashes of runs of ``done`` words, doubled or joined to the length wanted
        step = min(done, seed - done)
        run = mix(run[: len(run) - step] * np.uint64(3) + mix(run[step:], done), step)
        done += step
    # the leading bits of the hash, then the place: ties go to the left
    low = run >> np.uint64(31) << np.uint64(31) | np.arange(len(run), dtype=np.uint64)
    wide, span = 1, length - seed + 1
    while wide < span:
        step = min(wide, span - wide)
        low = np.minimum(low[: len(low) - step], low[step:])
        wide += step
    at = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
    start = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    return start, at[start], run[at[start]]


def _anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """key (of the row), anchor: every anchor of every document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words, doc, _ = split_words(batch_texts(batch.column("text")), None)
            start, at, anchor = windows(words, doc, length, seed)
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            keys = batch.column("key").take(pa.array(doc[start[new]]))
            for i in range(0, len(new), 100_000):
                yield pa.RecordBatch.from_arrays([keys[i : i + 100_000], pa.array(anchor[new[i : i + 100_000]].view(np.int64))], names=["key", "anchor"])

    return map_texts(docs, find, "key binary, anchor bigint")


def rotations(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of ``text`` in the order of the rotations, each of its own string; ``starts`` has each string's start and the end."""
    size = np.diff(starts)
    first = np.repeat(starts[:-1], size)
    place, size = np.arange(len(text)) - first, np.repeat(size, size)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, longest = 1, int(size.max())
    while True:
        if step >= longest:
            return np.argsort(rank, kind="stable")
        pair = rank * (int(rank.max()) + 1) + rank[first + (place + step) % size]
        after = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        if after.max() == len(text) - 1:
            return np.argsort(after)
        rank, step = after, step * 2


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all shards in the order of their first ``depth`` symbols, and the run of each: rows of one run agree in them.

    A shard is its transform's symbols and, for each row, the row of the rotation that starts one symbol earlier.
    """
    offset = np.r_[0, np.cumsum([len(s) for s, _ in shards])]
    symbols = np.concatenate([s for s, _ in shards]).astype(np.uint64) << np.uint64(32)
    earlier = np.concatenate([e + o for (_, e), o in zip(shards, offset)])
    order = np.arange(len(symbols))
    run = np.zeros(len(symbols), np.int64)
    place = np.arange(len(symbols), dtype=np.uint64)
    for _ in range(depth):
        by = np.sort(symbols[order] | place)
        at = (by & np.uint64(0xFFFFFFFF)).astype(np.int64)
        after = earlier[order[at]]
        sym, old = by >> np.uint64(32), run[at]
        now = np.r_[0, np.cumsum((sym[1:] != sym[:-1]) | (old[1:] != old[:-1]))] if len(at) else run
        if np.array_equal(after, order) and np.array_equal(now, run):
            break
        order, run = after, now
    return order, run


def repeated(snippets: list[np.ndarray], length: int, shard_words: int = SHARD_WORDS) -> list[np.ndarray]:
    """For each of the distinct snippets, which of its windows (by start) occur in another snippet, or twice in it."""
    sizes = np.array([len(s) for s in snippets], dtype=np.int64)
    flat = np.unique(np.concatenate(snippets), return_inverse=True)[1].astype(np.int64) + 1  # 0 ends each string
    starts = np.r_[0, np.cumsum(sizes)]
    shard_of = starts[:-1] // shard_words
    shards, rows = [], []
    for shard in np.unique(shard_of):
        own = np.flatnonzero(shard_of == shard)
        a, b = own[0], own[-1] + 1
        size = sizes[a:b] + 1
        begin = np.r_[0, np.cumsum(size)]
        text = np.zeros(begin[-1], np.int64)
        inside = np.ones(begin[-1], bool)
        inside[begin[1:] - 1] = False
        text[inside] = flat[starts[a] : starts[b]]
        order = rotations(text, begin)
        back = np.arange(len(text)) - 1
        back[begin[:-1]] = begin[1:] - 1
        row_of = np.empty(len(text), np.int64)
        row_of[order] = np.arange(len(text))
        shards.append((text[back[order]], row_of[back[order]]))
        string = np.repeat(np.arange(a, b), size)[order]
        rows.append((string, order - begin[string - a]))
    order, run = merge(shards, length)
    string, place = (np.concatenate(x)[order] for x in zip(*rows))
    fits = place + length <= sizes[string]
    string, place, run = string[fits], place[fits], run[fits]
    many = np.bincount(run)[run] > 1
    out = [np.zeros(max(0, s - length + 1), bool) for s in sizes]
    for s, p in zip(string[many].tolist(), place[many].tolist()):
        out[s][p] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


SNIPPET = "anchor bigint, words binary, key binary, start int"


def _snippets(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        words, doc, starts = split_words(batch_texts(batch.column("text")), None)
        start, at, anchor = windows(words, doc, length, seed)
        if not len(start):
            continue
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
        last = np.r_[new[1:], len(start)] - 1
        wanted = [np.sort(np.asarray(x, dtype=np.int64)) for x in batch.column("anchors").to_pylist()]
        sizes = [len(x) for x in wanted]
        of = doc[start[new]]
        # an anchor is wanted if its document's list has it
        mine = anchor[new].view(np.int64)
        pairs = mix(mine.view(np.uint64), 5) ^ mix(of.astype(np.uint64), 6)
        lists = mix(np.concatenate(wanted).view(np.uint64), 5) ^ mix(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes), 6)
        take = np.flatnonzero(np.isin(pairs, lists))
        short = mix(words, 7).astype(np.uint32)
        cut = [short[start[new[i]] : start[last[i]] + length].tobytes() for i in take]
        yield pa.RecordBatch.from_arrays(
            [pa.array(mine[take]), pa.array(cut, pa.binary()), batch.column("key").take(pa.array(of[take])), pa.array((start[new[take]] - starts[of[take]]).astype(np.int32))],
            names=["anchor", "words", "key", "start"],
        )


def _repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """key, start, end of the repeated stretches of a partition's snippets; it holds all snippets of its anchors."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("anchor", pa.int64()), ("words", pa.binary()), ("key", pa.binary()), ("start", pa.int32())]))])
    if not table.num_rows:
        return
    doc = np.asarray(table.column("key").combine_chunks().dictionary_encode().indices, dtype=np.int64)
    table = table.take(pa.array(np.unique(doc << 32 | np.asarray(table.column("start")), return_index=True)[1]))  # rows of documents that are there twice
    coded = table.column("words").combine_chunks().dictionary_encode()
    code = np.asarray(coded.indices, dtype=np.int64)
    count = np.bincount(code, minlength=len(coded.dictionary))
    anchor = np.asarray(table.column("anchor"))
    of = np.empty(len(coded.dictionary), np.int64)
    of[code] = anchor
    kinds = np.unique(of, return_inverse=True, return_counts=True)
    distinct = np.flatnonzero(kinds[2][kinds[1]] > 1)  # snippets whose anchor has others
    texts = [np.frombuffer(b.as_py(), dtype=np.uint32) for b in coded.dictionary.take(pa.array(distinct))] if len(distinct) else []
    runs: list[list[tuple[int, int]]] = [[] for _ in count]
    if texts:
        for i, flags in zip(distinct, repeated(texts, length)):
            runs[i] = _runs(flags)
    for i in np.flatnonzero(count > 1):
        runs[i] = [(0, len(coded.dictionary[int(i)].as_py()) // 4 - length + 1)]
    start = np.asarray(table.column("start"))
    out = [(r, int(start[r]) + a, int(start[r]) + b - 1 + length) for r in range(len(code)) for a, b in runs[code[r]]]
    if out:
        keys = table.column("key").take(pa.array([o[0] for o in out])).combine_chunks()
        yield pa.RecordBatch.from_arrays([keys, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=["key", "start", "end"])


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words: the stretches of each document made of windows that occur more than once."""
    spark = docs.sparkSession
    base = docs.where(F.length("text") >= 2 * length - 1).select("doc_id", doc_key(docs).alias("key"), "text")
    anchors = materialise(_anchors(base.select("key", "text"), length, seed))
    shared = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("all")).where("all > 1").select("anchor")
    several = anchors.join(shared, "anchor")
    several = materialise(several.groupBy("key").agg(F.collect_set("anchor").alias("anchors"), F.count(F.lit(1)).cast("int").alias("n")))
    total = several.agg(F.sum("n")).first()[0] or 0
    parts = max(shards_for(total, SNIPPETS_A_PARTITION), int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = base.select("key", "text").join(several, "key").select("key", "text", "anchors")
    snippets = map_texts(texts, lambda b: _snippets(b, length, seed), SNIPPET).repartition(parts, "anchor")
    found = snippets.mapInArrow(lambda b: _repeats(b, length), "key binary, start int, end int").distinct()
    order = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("fresh", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(order))
    spans = islands.groupBy("key", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    ids = base.select("key", "doc_id").join(several.select("key"), "key", "left_semi").distinct()
    return spans.join(ids, "key").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
