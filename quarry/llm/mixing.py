"""Mixing sources to target weights by Poisson replication.

Each source's target share of the output gives its rows a mean repetition rate; every document's count is the inverse
of that Poisson distribution at a uniform number made from a hash of seed, document id and text, so counts are
reproducible and independent of partitioning. Documents are exploded by their counts and shuffled globally: rows go to
partitions by a hash of (seed, id, text, copy) and are sorted by it there.

Target weights default to tempered sizes (rows ** 0.7), which lifts small sources. Rates come from one aggregation by
source with map-side combining; the table of sources is broadcast up to ``BROADCAST_SOURCES`` rows and else joined
with salted keys, so a source with a third of all rows does not land in one task.

Defined results: a null source is a source of its own; sources without a weight (or weight 0) get rate 0; null and empty
texts are replicated like others; rows that share an id, or have none, draw by their texts, rows that repeat both get
equal counts; an empty table gives an empty result. All columns are kept as they are; of the added columns
``repetition_rate``, ``copies`` and ``copy_no`` one whose name is taken gets ``q_mix_`` before it (again, until it is free),
which ``added_columns`` tells; columns named like the helper columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

SEED = 17
TEMPER = 0.7
BROADCAST_SOURCES = 20_000
SALTS = 16
NULL_SOURCE = "\x00null"


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a row draws by: its id and its text's digest."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def uniform(key: Column, seed: int) -> Column:
    """52 bits of md5(seed:key) as a number in (0, 1)."""
    text = F.concat(F.lit(f"{seed}:"), key)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def added_columns(columns: list[str]) -> tuple[str, str, str]:
    """Names of the rate, the number of copies and the copy's number beside ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("repetition_rate", "copies", "copy_no"):
        while name in taken:
            name = f"q_mix_{name}"
        taken.add(name)
        out.append(name)
    return tuple(out)


def rates(documents: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, temper: float = TEMPER) -> DataFrame:
    """``q_mix_source``, ``repetition_rate`` and the cumulative Poisson probabilities of every source."""
    name = F.coalesce(F.col("source"), F.lit(NULL_SOURCE))
    sizes = documents.groupBy(name.alias("q_mix_source")).agg(F.count("*").alias("q_mix_rows"))
    if weights is None:
        weighted = sizes.withColumn("q_mix_weight", F.pow(F.col("q_mix_rows").cast("double"), F.lit(temper)))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (NULL_SOURCE if k is None else k, float(v))]
        weighted = sizes.withColumn("q_mix_weight", F.coalesce(F.element_at(F.create_map(*pairs), F.col("q_mix_source")), F.lit(0.0)) if pairs else F.lit(0.0))
    sums = weighted.agg(F.sum("q_mix_weight").alias("q_mix_all"), F.sum("q_mix_rows").alias("q_mix_total"))
    goal = F.lit(total) if total is not None else F.col("q_mix_total")
    share = F.when(F.col("q_mix_all") > 0, F.col("q_mix_weight") / F.col("q_mix_all")).otherwise(0.0)
    rated = weighted.crossJoin(F.broadcast(sums)).withColumn("repetition_rate", share * goal / F.col("q_mix_rows"))  # one row of sums
    rate = F.col("repetition_rate")
    # up to here the tail is below 2**-53; log terms avoid underflow for large rates
    last = (F.ceil(rate + 12 * F.sqrt(rate)) + 30).cast("int")
    steps = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k == 0, -rate).otherwise(F.log(rate) - F.log(k.cast("double"))))
    sums = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("all")),
        lambda acc, d: F.struct((acc["t"] + d).alias("t"), (acc["c"] + F.exp(acc["t"] + d)).alias("c"), F.concat(acc["all"], F.array(acc["c"] + F.exp(acc["t"] + d))).alias("all")),
        lambda acc: acc["all"],
    )
    return rated.select("q_mix_source", "repetition_rate", F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0))).alias("q_mix_cdf"))


def replicate(documents: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED, temper: float = TEMPER, partitions: int | None = None) -> DataFrame:
    """All columns of ``documents`` plus those of ``added_columns``, globally shuffled; the copies' numbers begin with 0."""
    spark = documents.sparkSession
    common.prepare(spark)
    by_source = common.saved(rates(documents, weights, total, temper), "rates")
    names = added_columns(documents.columns)
    # the row travels as one struct, so no name of its columns can meet a helper's
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(row.alias("q_row"), F.coalesce(F.col("source"), F.lit(NULL_SOURCE)).alias("q_mix_source"), draw_key(F.col("doc_id"), F.col("text")).alias("q_mix_key"))
    if by_source.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(by_source), "q_mix_source")
    else:
        salted = by_source.withColumn("q_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("q_mix_salt", F.pmod(F.xxhash64("q_mix_key"), F.lit(SALTS)).cast("int")).join(salted, ["q_mix_source", "q_mix_salt"])
    drawn = uniform(F.col("q_mix_key"), seed)
    counted = joined.withColumn("q_mix_copies", F.size(F.filter("q_mix_cdf", lambda c: c < drawn))).where("q_mix_copies > 0")
    out = counted.select("q_row", "q_mix_key", "repetition_rate", "q_mix_copies", F.explode(F.sequence(F.lit(0), F.col("q_mix_copies") - 1)).alias("q_mix_no"))
    out = out.withColumn("q_mix_order", F.xxhash64(F.lit(seed), "q_mix_key", "q_mix_no")).drop("q_mix_key")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.repartition(n, "q_mix_order").sortWithinPartitions("q_mix_order")
    own = [F.col("q_row").getField(c).alias(c) for c in documents.columns]
    return dealt.select(*own, *[F.col(c).alias(name) for c, name in zip(("repetition_rate", "q_mix_copies", "q_mix_no"), names, strict=True)])


def oracle(seed: int = SEED, temper: float = TEMPER) -> str:
    """DuckDB SQL of the ids, rates and copies of ``replicate``; the order of a table is no part of it."""
    return f"""
    WITH sizes AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {temper}) AS w FROM documents GROUP BY source),
    rated AS (SELECT source, w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
    ks AS (SELECT source, rate, k, CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(CAST(k AS DOUBLE)) END AS step
           FROM rated, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate)) AS BIGINT) + 31)) AS k)),
    terms AS (SELECT source, rate, k, exp(sum(step) OVER (PARTITION BY source ORDER BY k)) AS p FROM ks),
    cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
    drawn AS (SELECT doc_id, source, text, (CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
    counted AS (SELECT d.doc_id, d.source, d.text, r.rate, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c < d.u) AS copies
                FROM drawn d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, source, round(rate, 9) AS repetition_rate, CAST(copies AS INTEGER) AS copies, CAST(copy_no AS INTEGER) AS copy_no, text
    FROM counted, LATERAL (SELECT unnest(range(0, copies)) AS copy_no)
    """
