"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's features are its distinct words (lower case, letters and digits only). It gets ``TABLES`` independent SimHash
fingerprints of ``BITS`` bits. Every fingerprint emits all variants within half the radius, that is itself and each single
bit flipped; two fingerprints within the radius of 2 share a variant, so a shuffle on (table, variant) finds all such pairs.
Colliding pairs are deduplicated and verified: the fingerprints of all tables together must differ in at most ``SHARE`` of
their bits, which is an angle between the word sets. Documents that verified pairs connect form a group.

Equal fingerprints are one node, so copies cost nothing more. In a bucket, every node is paired with the smallest one. Only
where such a pair fails verification is the bucket searched in full: it is dealt in blocks of at most ``BLOCK`` nodes, pairs of
blocks are compared inside tasks, and only links that connect more are given out. So the groups are those of all pairs, no
task holds an unbounded bucket, and pairs aren't written. The comparisons of such a bucket grow with its square.

A row is known by 128 bits of its doc_id and text, in which null differs from every value. Groups are never gathered: their
first document and their size are aggregates.

Defined results: a text without words joins only documents of the very same text; a null text joins none, and all rows with one stay; the document that
stays is the one with the smallest doc_id (null last), then hash of its text; of rows equal in doc_id and text one stays; an empty
table gives no rows; texts of any length are read whole; other columns are kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import batch_texts, doc_key, fresh, map_texts, materialise, mix, shards_for, small_batches, split_words

TABLES = 8
BITS = 40
SHARE = 0.16
ROWS_A_PARTITION = 2_000_000
BLOCK = 1024


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """TABLES fingerprints of each text as uint64 (0 where it has no words), and its number of distinct words."""
    words, doc, _ = split_words(texts)
    n = len(texts)
    if not len(words):
        return np.zeros((n, TABLES), np.uint64), np.zeros(n, np.int64)
    uniq, code = np.unique(words, return_inverse=True)
    pair = np.unique(doc * len(uniq) + code)
    doc, code = pair // len(uniq), pair % len(uniq)
    raw = np.stack([mix(uniq, t + 1) for t in range(-(-TABLES * BITS // 64))], axis=1)
    sign = np.unpackbits(raw.view(np.uint8), axis=1)[:, : TABLES * BITS].astype(np.int8) * 2 - 1
    count = np.bincount(doc, minlength=n)
    total = np.zeros((n, TABLES * BITS), np.int32)
    starts = np.r_[0, np.cumsum(count)]
    at = 0
    while at < n:  # as many documents at a time as keep the gathered rows in the cache
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 20_000, side="right")) - 1)
        some = np.flatnonzero(count[at:to]) + at
        if len(some):
            rows = sign[code[starts[at] : starts[to]]]
            total[some] = np.add.reduceat(rows, starts[some] - starts[at], axis=0, dtype=np.int32)
        at = to
    bits = (total > 0).reshape(n, TABLES, BITS)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    return (bits * weights).sum(axis=2, dtype=np.uint64), count


F_NAMES = [f"f{t}" for t in range(TABLES)]


def sign_documents(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), node and f0..: a row for each row of ``docs`` whose text isn't null. Rows of one node are copies."""
    base = docs.where(F.col("text").isNotNull()).select("doc_id", doc_key(docs).alias("key"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = batch_texts(batch.column("text"))
            f, n = fingerprints(texts)
            node = [b"f" + xxhash.xxh3_128_digest(row) for row in map(bytes, np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1))]
            for i in np.flatnonzero(n == 0):
                node[i] = b"t" + xxhash.xxh3_128_digest(texts[int(i)].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(node, pa.binary()), pa.array(n.astype(np.int32)), *(pa.array(f[:, t].view(np.int64)) for t in range(TABLES))], names=["doc_id", "key", "node", "words", *F_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(base, sign, f"doc_id {kind}, key binary, node binary, words int, {', '.join(f'{f} bigint' for f in F_NAMES)}")


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket (table and variant) and node, for each variant within half the radius."""
    flips = F.array(*(F.lit(m) for m in [0, *(1 << i for i in range(BITS))]))
    tables = F.array(*(F.struct(F.lit(t << BITS).alias("table"), F.col(f).alias("f")) for t, f in enumerate(F_NAMES)))
    each = nodes.select("node", F.explode(tables).alias("t")).select("node", F.col("t.f").bitwiseOR(F.col("t.table")).alias("print"))
    return each.select("node", F.col("print"), F.explode(flips).alias("flip")).select(F.col("print").bitwiseXOR(F.col("flip")).alias("bucket"), "node")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a partition, which holds whole buckets, those whose bucket has several nodes, with its smallest node."""
    held = [(np.asarray(b.column("bucket")), np.asarray(b.column("node"))) for b in batches if b.num_rows]
    if not held:
        return
    bucket, node = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(bucket)
    bucket, node = bucket[order], node[order]
    new = np.r_[True, bucket[1:] != bucket[:-1]]
    several = ~(new & np.r_[new[1:], True])
    bucket, node, new = bucket[several], node[several], new[several]
    if not len(bucket):
        return
    starts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(node, starts), np.diff(np.r_[starts, len(node)]))
    for i in range(0, len(bucket), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[s]), pa.array(least[s]), pa.array(node[s])], names=["bucket", "a", "b"])


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b with whether their fingerprints are close enough."""
    left = nodes.select(F.col("node").alias("a"), *(F.col(f).alias(f"a_{f}") for f in F_NAMES))
    right = nodes.select(F.col("node").alias("b"), *F_NAMES)
    apart = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f))) for f in F_NAMES), F.lit(0))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (apart <= int(SHARE * TABLES * BITS)).alias("near"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between near nodes of each pair of blocks in a partition, which holds whole ones: enough to connect all near nodes of it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    bucket, one, other, chunk, node = (np.asarray(table.column(c)) for c in ("bucket", "one", "other", "chunk", "b"))
    prints = np.stack([np.asarray(table.column(f)).view(np.uint64) for f in F_NAMES], axis=1)
    order = np.lexsort((node, other, one, bucket))
    bucket, one, other, chunk, node, prints = (x[order] for x in (bucket, one, other, chunk, node, prints))
    new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (other[1:] != other[:-1])])
    left, right = [], []
    for a, b in zip(new, np.r_[new[1:], len(bucket)]):
        part, own = prints[a:b], node[a:b]
        across = chunk[a:b] if one[a] != other[a] else None  # nodes of one block meet in that block's own turn
        root = np.arange(b - a)
        for i in range(b - a - 1):
            near = np.flatnonzero(np.bitwise_count(part[i + 1 :] ^ part[i]).sum(axis=1) <= int(SHARE * TABLES * BITS)) + i + 1
            if across is not None:
                near = near[across[near] != across[i]]
            for j in near:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    left.append(own[i])
                    right.append(own[j])
    for i in range(0, len(left), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x[i : i + 100_000], np.int64)) for x in (left, right)], names=["a", "b"])


def _inside(shared: DataFrame, mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links between the nodes of buckets in which some pair failed."""
    inside = materialise(shared.join(mixed, "bucket", "left_semi").select("bucket", "b").distinct())
    blocks = inside.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = inside.join(blocks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("bucket", "b", "chunk", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("other"))
    whole = each.join(nodes.withColumnRenamed("node", "b"), "b")
    parts = max(shards_for(inside.count(), ROWS_A_PARTITION // 8), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return whole.repartition(parts, "bucket", "one", "other").mapInArrow(_linked, "a bigint, b bigint").distinct()


def near_pairs(nodes: DataFrame) -> DataFrame:
    """Verified pairs of nodes, enough of them to connect all that verified pairs connect."""
    rows = nodes.count() * TABLES * (BITS + 1)
    parts = max(shards_for(rows, ROWS_A_PARTITION), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = materialise(_buckets(nodes).repartition(parts, "bucket").mapInArrow(_shared, "bucket bigint, a bigint, b bigint"))
    star = materialise(_verified(shared.where("a <> b").select("a", "b").distinct(), nodes))
    failed = star.where(~F.col("near")).select("a", "b")
    mixed = shared.join(failed, ["a", "b"], "left_semi").select("bucket").distinct()
    return star.where("near").select("a", "b").union(_inside(shared, mixed, nodes))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the smallest node that edges connect it to.

    Each round links every neighbour, and the node, to the smallest neighbour (large star, small star), so the rounds grow
    with the logarithm of the longest path. The edges are written out each round, until a round changes none.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        before = now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = materialise(small.where("u <> v").distinct())
        if now.count() == before.count() and now.join(before, ["u", "v"], "left_anti").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, key, copies (rows equal in doc_id and text), members and best (unknown, doc_id, key) of its group, of every distinct row in a group of several rows."""
    signed = materialise(sign_documents(docs))
    nodes = signed.where("words > 0").groupBy(F.col("node").alias("print")).agg(*(F.first(f).alias(f) for f in F_NAMES))
    # numbers in order of the rows share most of their bytes with their neighbours, so the variants' shuffle packs them well
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = components(near_pairs(nodes)).join(nodes, "node").select(F.col("print").alias("node"), "root")
    grouped = signed.select("doc_id", "key", "node").join(materialise(roots), "node", "left")
    grouped = grouped.select("doc_id", "key", F.when(F.col("root").isNull(), F.col("node")).alias("alone"), "root")
    each = materialise(grouped.groupBy("root", "alone", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies")))
    ident = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    sums = each.groupBy("root", "alone").agg(F.sum("copies").alias("members"), F.min(ident).alias("best")).where("members > 1")
    sums = sums.withColumnsRenamed({"root": "g_root", "alone": "g_alone"})
    return each.join(sums, F.col("root").eqNullSafe(F.col("g_root")) & F.col("alone").eqNullSafe(F.col("g_alone"))).select("doc_id", "key", "copies", "members", "best")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, kept_id, members: every document that has a near copy, the document that stays of its group, and the group's rows."""
    return _grouped(docs).select("doc_id", F.col("best.doc_id").alias("kept_id"), F.col("members").cast("bigint").alias("members"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies, and of each group the one that stays."""
    ranked = materialise(_grouped(docs).select("key", (F.col("key") == F.col("best.key")).alias("stays"), "copies"))
    (key,) = fresh(docs, "row_key")
    keyed = docs.withColumn(key, doc_key(docs))
    gone = ranked.where("NOT stays OR copies > 1").select(F.col("key").alias(key))
    out = keyed.join(gone, key, "left_anti")  # by size, Spark sends the keys or shuffles the texts
    again = ranked.where("stays AND copies > 1").select(F.col("key").alias(key))
    if not again.isEmpty():  # rows equal in doc_id and text: one of them comes back
        out = out.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
