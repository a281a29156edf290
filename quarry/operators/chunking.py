"""Chunks: items of sections, overlapping windows, contextual headers, quality and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.sources import shared


def valid_items(items: Column) -> Column:
    """Trimmed, without nulls and empty ones."""
    return F.filter(F.transform(items, text.strip), lambda x: x.isNotNull() & (x != ""))


def overlapping(items: Column, size: int = 3, overlap: int = 1) -> Column:
    """Windows of ``size`` items, each ``overlap`` items into the one before; the last reaches the end."""
    n = F.size(items)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda i: (i == 0) | (i + overlap < n))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(items, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def good_chunk(c: Column) -> Column:
    """At least three words, and a sentence mark or 30 characters."""
    return text.text(c).rlike(r"(?U)\S\s++\S++\s++\S") & (text.text(c).rlike("[.!?]") | (F.length(c) >= 30))


def header(title: Column) -> Column:
    """The title's parts without those that repeat the one before."""
    parts = F.transform(F.split(text.text(title), " - "), text.trim)
    return F.array_join(F.filter(parts, lambda p, i: (i == 0) | (p != F.element_at(parts, F.greatest(i, F.lit(1))))), " - ")


def under(made: Column, c: Column) -> Column:
    """A text under a header that was made before."""
    return F.concat(made, F.lit("\n\n"), c)


def with_header(title: Column, c: Column) -> Column:
    return under(header(title), c)


def first_of_equals(chunks: DataFrame, c: str = "text", order: str = "chunk_idx", scope: tuple[str, ...] = ()) -> DataFrame:
    """Of chunks that are equal but for case and outer white space, the first; only its digest is shuffled as key."""
    key = F.sha2(text.strip(F.lower(text.text(c))), 256)
    w = Window.partitionBy(*scope, key).orderBy(order)
    return chunks.withColumn("q_place", F.row_number().over(w)).where("q_place = 1").drop("q_place")


def sections(pages: DataFrame, max_depth: int = 100) -> DataFrame:
    """Flatten section trees: ``page_url``, ``path`` (order), ``title`` and items of every section, parents first.

    ``pages`` (page_title, page_url, tree): tree is the JSON text of a page's sections. The recursion is a recursive
    common table expression over VARIANT, one step a level; its row limit is lifted for large inputs (for the session, as
    the query runs later). A tree that is no JSON has no sections; a missing title leaves its part of the path out.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    pages.select("page_title", "page_url", F.expr("try_parse_json(tree)").alias("tree")).createOrReplaceTempView("q_section_pages")
    return spark.sql(
        f"""
        WITH RECURSIVE walk(page_url, depth, path, title, url, node) MAX RECURSION LEVEL {max_depth} AS (
          SELECT page_url, 1, array(pos), concat_ws(' - ', page_title, variant_get(v, '$.title', 'string')),
                 coalesce(variant_get(v, '$.page_url', 'string'), page_url), v
          FROM q_section_pages LATERAL VIEW posexplode(variant_get(tree, '$', 'array<variant>')) t AS pos, v
          UNION ALL
          SELECT page_url, depth + 1, concat(path, array(pos)), concat_ws(' - ', title, variant_get(v, '$.title', 'string')),
                 coalesce(variant_get(v, '$.page_url', 'string'), url), v
          FROM walk LATERAL VIEW posexplode(variant_get(node, '$.subsections', 'array<variant>')) t AS pos, v
        )
        SELECT page_url, path, title, url, variant_get(node, '$.text', 'array<string>') AS text,
               variant_get(node, '$.lists', 'array<array<string>>') AS lists FROM walk
        """
    )


def chunk_sections(found: DataFrame, size: int | None = None, overlap: int = 1) -> DataFrame:
    """Chunks of sections: every item its own, or windows of ``size`` items; with headers, only good ones."""
    items = valid_items(F.coalesce("text", F.array().cast("array<string>")))
    lists = F.transform(F.coalesce("lists", F.array().cast("array<array<string>>")), valid_items)
    pieces = F.concat(items, F.flatten(lists)) if size is None else F.concat(overlapping(items, size, overlap), F.flatten(F.transform(lists, lambda x: overlapping(x, size, overlap))))
    each = found.select("page_url", "path", "title", "url", F.posexplode(pieces).alias("pos", "item")).where(good_chunk(F.col("item")))
    return each.withColumn("text", with_header(F.col("title"), F.col("item")))


def number(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Dense ``chunk_idx`` from 0 in the given order: a range sort, then offsets of its partitions; no single-task window.

    The sorted table is written once, since its partitions must not change between counting and numbering them.
    """
    spark = chunks.sparkSession
    ordered = chunks.orderBy(*order).withColumn("q_part", F.spark_partition_id()).withColumn("q_id", F.monotonically_increasing_id())
    ordered = shared.saved(ordered, "numbered")
    counts = sorted((r["q_part"], r["n"]) for r in ordered.groupBy("q_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "q_part int, q_offset long"))
    inside = F.col("q_id").bitwiseAND((1 << 33) - 1)
    return ordered.join(table, "q_part").withColumn("chunk_idx", F.col("q_offset") + inside).drop("q_part", "q_id", "q_offset")


def tier_counts(chunks: DataFrame, tier: str = "tier") -> DataFrame:
    """Rows of each tier 0 to 4, zeros included; a missing tier counts as 4."""
    tiers = chunks.sparkSession.range(5).select(F.col("id").cast("int").alias("tier"))
    counts = chunks.groupBy(F.coalesce(F.col(tier), F.lit(4)).cast("int").alias("tier")).agg(F.count("*").alias("n"))
    return tiers.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n_chunks"))
