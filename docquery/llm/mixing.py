"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / w: u is uniform, taken from a digest of its id, and w its quality weight. Within a
source, documents in order of their keys are a weighted sample without replacement; a prefix sum of their tokens is cut
at the source's budget. A budget above the source's own tokens is met by complete epochs first; only the rest is sampled.

The prefix sum is exact and never puts a source into one task: documents are sorted by source and key into ranges of about
as many rows each, tokens are summed by (source, range), and only the range in which a budget runs out is walked through.
Texts are never shuffled: the decision for a row compares its key with the cut of its source.

Defined results: a null or empty text has no tokens and is never selected; null is a source of its own; equal keys are
ordered by doc_id (null first), then tokens; rows that are equal in these are taken or left together; a document is taken if
the prefix sum before it (and its equals) is below the budget, so a source goes over its budget by less than one document and
its equals; negative weights aren't meant, and weights that are all 0 take nothing; an empty table gives no rows; other columns are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import fresh, materialise, shards_for

WORD = "[^ \\t\\n\\r]+"
ROWS_A_PART = 200_000


def tokens(text: F.Column | str = "text") -> F.Column:
    """Words that white space separates; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(seed: int) -> F.Column:
    """A number in (0, 1) from 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def quality_weight() -> F.Column:
    """Between 0.05 and 1: the share of letters among all characters but white space, squared."""
    dark = F.length(F.regexp_replace("text", "[ \\t\\n\\r]+", ""))
    letters = dark - F.length(F.regexp_replace("text", "[ \\t\\n\\r\\p{L}]+", ""))
    share = letters.cast("double") / F.greatest(dark, F.lit(1)).cast("double")
    return F.greatest(share * share, F.lit(0.05))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """source, doc_id, n_tokens and key of every document that has tokens."""
    base = docs.select("source", "doc_id", tokens().alias("n_tokens"), (-F.log(uniform(seed)) / quality_weight()).alias("key"))
    return base.where(F.col("n_tokens") > 0)


def _at(key: str, doc_id: str, n: str) -> F.Column:
    """Where a document stands in its source."""
    return F.struct(F.col(key).alias("key"), F.col(doc_id).isNotNull().alias("known"), F.col(doc_id).alias("doc_id"), F.col(n).alias("n_tokens"))


def _place(keyed: DataFrame, weights: dict[str | None, float] | None, alpha: float, budget_ratio: float, rows_a_part: int) -> DataFrame:
    """plan_source, epochs, last: by source its complete epochs and the last place that the rest of its budget takes.

    Equal places are one row with their count. All rows are sorted by (source, place) into ranges that Spark samples to hold
    about as many rows each, whatever the sources' sizes or the keys' distribution; the tokens of each (range, source) are
    summed, and only the range in which a source's budget runs out is walked through.
    """
    spark = keyed.sparkSession
    ties = keyed.groupBy("source", _at("key", "doc_id", "n_tokens").alias("at")).agg(F.count(F.lit(1)).alias("times"))
    ties = materialise(ties.withColumn("tokens", F.col("times") * F.col("at.n_tokens")))
    parts = shards_for(ties.count(), rows_a_part)
    part = materialise(ties.repartitionByRange(parts, "source", "at").withColumn("part", F.spark_partition_id()))
    sums = materialise(part.groupBy("source", "part").agg(F.sum("tokens").alias("tokens")))
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("total"))
    if weights is None:
        by_source = by_source.withColumn("weight", F.pow(F.col("total").cast("double"), F.lit(alpha)))
    else:
        given = spark.createDataFrame(list(weights.items()), "given string, weight double")
        by_source = by_source.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select("source", "total", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = by_source.agg(F.sum("total").alias("all_tokens"), F.sum("weight").alias("all_weight"))
    budget = F.round(F.col("all_tokens") * F.lit(budget_ratio) * F.col("weight") / F.nullif("all_weight", F.lit(0.0))).cast("bigint")
    plan = by_source.crossJoin(F.broadcast(whole)).withColumn("budget", F.coalesce(budget, F.lit(0).cast("bigint")))  # whole is one row
    plan = plan.select(F.col("source").alias("plan_source"), F.floor(F.col("budget") / F.col("total")).cast("int").alias("epochs"), (F.col("budget") % F.col("total")).alias("rest"))
    plan = materialise(plan)
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("part")) - F.col("tokens")
    cut = sums.withColumn("before", before).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    cut = cut.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
    cut = materialise(cut.select(F.col("source").alias("cut_source"), F.col("part").alias("cut_part"), (F.col("rest") - F.col("before")).alias("left")))
    inside = part.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("part") == F.col("cut_part")))
    prefix = F.sum("tokens").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    last = inside.withColumn("prefix", prefix).where(F.col("prefix") < F.col("left")).groupBy("cut_source").agg(F.max("at").alias("last"))
    return materialise(plan.join(last, F.col("plan_source").eqNullSafe(F.col("cut_source")), "left").select("plan_source", "epochs", "last"))


def _times(plan: dict[str, str], at: F.Column) -> F.Column:
    """How often the plan takes a document."""
    return F.col(plan["epochs"]) + F.when(F.col(plan["last"]).isNotNull() & (at <= F.col(plan["last"])), F.lit(1)).otherwise(F.lit(0))


def sample(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, budget_ratio: float = 1.0, seed: int = 17, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """doc_id, source, n_tokens and copies of every document that is taken.

    The budget is ``budget_ratio`` times all tokens. It is shared by ``weights``; without them in proportion to the
    tokens of each source to the power ``alpha``. A source that ``weights`` lacks gets nothing; None names the null source.
    """
    keyed = materialise(_keyed(docs, seed))
    plan = _place(keyed, weights, alpha, budget_ratio, rows_a_part)
    out = keyed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    out = out.select("doc_id", "source", "n_tokens", _times({"epochs": "epochs", "last": "last"}, _at("key", "doc_id", "n_tokens")).alias("copies"))
    return out.where(F.col("copies") > 0)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, budget_ratio: float = 1.0, seed: int = 17, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The documents that ``sample`` takes, each as often as it takes them, with the columns of ``docs``.

    Each document is written once with its key and tokens, so its text is read through once.
    """
    key, n, again, *others = fresh(docs, "mix_key", "mix_tokens", "mix_copy", "mix_source", "mix_epochs", "mix_last")
    held = materialise(docs.withColumns({key: -F.log(uniform(seed)) / quality_weight(), n: tokens()}).where(F.col(n) > 0))
    names = dict(zip(("plan_source", "epochs", "last"), others))
    plan = _place(held.select("source", "doc_id", F.col(n).alias("n_tokens"), F.col(key).alias("key")), weights, alpha, budget_ratio, rows_a_part).withColumnsRenamed(names)
    out = held.join(plan, F.col("source").eqNullSafe(F.col(names["plan_source"])))
    times = _times(names, _at(key, "doc_id", n))
    return out.withColumn(again, F.explode(F.array_repeat(F.lit(1), times))).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS n_tokens,
    (CAST(('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u,
    length(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS dark,
    length(regexp_replace(text, '[ \\t\\n\\r\\p{{L}}]+', '', 'g')) AS other
  FROM documents),
keyed AS (
  SELECT doc_id, source, n_tokens, -ln(u) / greatest(pow(CAST(dark - other AS DOUBLE) / CAST(greatest(dark, 1) AS DOUBLE), 2), 0.05) AS key
  FROM base WHERE n_tokens > 0),
by_source AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS total, pow(CAST(sum(n_tokens) AS DOUBLE), 0.7) AS weight FROM keyed GROUP BY source),
plan AS (
  SELECT source, total, CAST(round((SELECT sum(total) FROM by_source) * 1.0::DOUBLE * weight / (SELECT sum(weight) FROM by_source)) AS BIGINT) AS budget FROM by_source),
prefixed AS (
  SELECT k.*, p.total, p.budget, CAST(sum(n_tokens) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_tokens AS before
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source),
counted AS (
  SELECT doc_id, source, n_tokens, CAST(budget // total + CASE WHEN before < budget % total THEN 1 ELSE 0 END AS INTEGER) AS copies FROM prefixed)
SELECT doc_id, source, n_tokens, copies FROM counted WHERE copies > 0
"""
