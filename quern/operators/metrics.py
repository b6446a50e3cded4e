"""Operational metrics: update history, query log, audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import checkpointed


def update_metrics(history: DataFrame, *by: str) -> DataFrame:
    """Count, mean duration, summed file and chunk changes, success and error rates; zeros where there is nothing.

    Any status other than ``success`` is an error. Input: duration_ms, files, chunks, status.
    """
    ok = F.col("status") == "success"
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = (
        F.count("status").alias("n_updates"),
        F.round(zero(F.avg("duration_ms")), 6).alias("avg_duration_ms"),
        F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"),
        F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"),
        F.round(zero(F.avg(F.when(ok, 1.0).when(F.col("status").isNotNull(), 0.0))), 6).alias("success_rate"),
        F.round(zero(F.avg(F.when(ok, 0.0).when(F.col("status").isNotNull(), 1.0))), 6).alias("error_rate"),
    )
    return history.groupBy(*by).agg(*aggs)


def with_all(keys: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """History rows with one empty row for each key that has none, so that it keeps its zero line."""
    return keys.select(key).distinct().join(history, key, "left")


def since(history: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the last days before ``as_of``, bounds included."""
    end = F.to_timestamp_ntz(F.lit(as_of))
    return history.where((F.col("ts") >= end - F.expr(f"interval {days} days")) & (F.col("ts") <= end))


def query_metrics(log: DataFrame, types: list[str]) -> DataFrame:
    """Per query type: count, mean, least and greatest duration, cache-hit rate, mean results, errors; a line of zeros for types not seen.

    Input: query_type, duration, hit, results, failed.
    """
    wanted = log.sparkSession.createDataFrame([(t,) for t in types], "query_type string")
    seen = log.groupBy("query_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration").alias("a"), F.min("duration").alias("lo"), F.max("duration").alias("hi"), F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("h"),
        F.avg("results").alias("r"), F.count_if("failed").alias("e"),
    )
    z = lambda c, d: F.round(F.coalesce(c, F.lit(0.0)), d)
    return wanted.join(seen, "query_type", "left").select(
        "query_type", F.coalesce("n", F.lit(0)).alias("n"), z(F.col("a"), 4).alias("avg_duration"), z(F.col("lo"), 4).alias("min_duration"), z(F.col("hi"), 4).alias("max_duration"), z(F.col("h"), 6).alias("hit_rate"),
        z(F.col("r"), 4).alias("avg_results"), F.coalesce("e", F.lit(0)).alias("n_errors"),
    )


def query_trend(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(day, n, avg_duration) of the queries of the last days; days without any have no line. Input: ts, duration."""
    return since(log, as_of, days).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 4).alias("avg_duration"))


def last_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The newest n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


#: Pieces into which a key's values are cut for ranking.
PIECES = 64


def latency_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median (middle two averaged), nearest-rank p95 and p99, population deviation.

    Ranks are exact, but no key is sorted in one task: a sketch of each key's quantiles cuts its values into
    pieces, the counts of the pieces tell in which one a wanted rank lies, and only those pieces, equal values
    folded, are ranked.
    """
    d = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v")).where(F.col(value).isNotNull())
    stats = d.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("_v"), 4).alias("mean"), F.round(F.stddev_pop("_v"), 4).alias("stddev"),
        F.percentile_approx("_v", [i / PIECES for i in range(1, PIECES)], 10_000).alias("_cuts"),
    )
    stats = checkpointed(stats)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    ranks = F.array_distinct(F.array(low, high, F.ceil(F.col("n") * 95 / 100), F.ceil(F.col("n") * 99 / 100)))
    own = stats.select(F.col("_key").alias("_k2"), "_cuts")
    placed = checkpointed(
        d.join(own, F.col("_key").eqNullSafe(F.col("_k2"))).select("_key", "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_piece"))
        .groupBy("_key", "_piece", "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    sizes = placed.groupBy("_key", "_piece").agg(F.sum("_n").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("_key").orderBy("_piece")) - F.col("_size"))
    wanted = stats.select(F.col("_key").alias("_k2"), F.explode(ranks).alias("_rank"))
    where = before.join(wanted, F.col("_key").eqNullSafe(F.col("_k2"))).where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_size"))).select("_key", "_piece", "_before", "_rank")
    pieces = where.select(F.col("_key").alias("_k2"), F.col("_piece").alias("_p2"), "_before").distinct()
    ranked = (
        placed.join(pieces, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_piece") == F.col("_p2")))
        .select("_k2", "_p2", "_v", "_n", (F.col("_before") + F.sum("_n").over(Window.partitionBy("_k2", "_p2").orderBy("_v"))).alias("_upto"))
    )
    hit = (
        where.drop("_before").join(ranked, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_piece") == F.col("_p2")))
        .where((F.col("_upto") - F.col("_n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))).select(F.col("_key").alias("_k3"), "_rank", "_v")
    )
    at = hit.groupBy("_k3").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # four ranks at most
    pick = lambda r: F.element_at("_at", r)
    return stats.join(at, F.col("_key").eqNullSafe(F.col("_k3"))).select(
        F.col("_key").alias(key), "n", "mean", F.round((pick(low) + pick(high)) / 2, 4).alias("median"), pick(F.ceil(F.col("n") * 95 / 100)).alias("p95"), pick(F.ceil(F.col("n") * 99 / 100)).alias("p99"), "stddev"
    )


def rolling_count(df: DataFrame, keys: list[str], span_us: int, name: str = "n_last") -> DataFrame:
    """Rows with the number of rows of the same keys in the span before each, itself and both ends included.

    A row stands in the bucket of its span and, to be taken off again, in the next one at the time it leaves the
    span; so a key's rows are ordered bucket by bucket and never all in one task. Input has ``ts``.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    both = F.array(F.struct(F.floor(us / span_us).alias("_b"), us.alias("_s"), F.lit(1).alias("_in")), F.struct((F.floor(us / span_us) + 1).alias("_b"), (us + span_us).alias("_s"), F.lit(0).alias("_in")))
    rows = df.withColumn("_x", F.explode(both)).withColumns({"_b": F.col("_x._b"), "_s": F.col("_x._s"), "_in": F.col("_x._in")}).drop("_x")
    w = Window.partitionBy(*keys, "_b")
    came = F.sum("_in").over(w.orderBy("_s").rangeBetween(Window.unboundedPreceding, 0))
    left = F.sum(1 - F.col("_in")).over(w.orderBy("_s").rangeBetween(Window.unboundedPreceding, -1))
    counted = rows.withColumn(name, came + F.sum(1 - F.col("_in")).over(w) - F.coalesce(left, F.lit(0)))
    return counted.where("_in = 1").drop("_b", "_s", "_in")


def grouped_counters(items: DataFrame, by: str) -> DataFrame:
    """(by, n_files, n_chunks, n_failed) of a batch's items (by, chunks, failed): what one run reports for each folder."""
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("n_chunks"), F.count_if("failed").alias("n_failed"))


def table_listing(chunks: DataFrame, keys: list[str], order: str, *first: str) -> DataFrame:
    """(keys, first, n_chunks): pieces of tables gathered by file and table, with what the first piece says."""
    best = F.min(F.struct(order, *first)).alias("_f")
    return chunks.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("n_chunks")).select(*keys, *[F.col(f"_f.{c}") for c in first], "n_chunks")


def table_confidence(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence): the share of a table's cells (keys, aligned) that stand in a column, with two decimals; 0 without cells."""
    return cells.groupBy(*keys).agg(F.round(F.count_if("aligned") / F.count(F.lit(1)), 2).alias("confidence"))


def page(df: DataFrame, condition: Column, order: str, offset: int, limit: int) -> DataFrame:
    """A page of the matching rows in order, each with the total and whether more follow.

    The total is one aggregated row joined by value, the page itself an ordered offset and limit.
    """
    hits = df.where(condition)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy(order).offset(offset).limit(limit).join(F.broadcast(total)).withColumn("has_more", F.col("total") > F.lit(offset + limit))


def status_rule(eligible: Column, added_modified: Column, deleted: Column, chunks: Column, errors: Column) -> Column:
    """Status of an update run, in the order of the rules."""
    files = added_modified + deleted
    return (
        F.when((eligible > 0) & (files == 0) & (errors == 0), "incomplete")
        .when((added_modified > 0) & (chunks == 0) & (errors > 0), "incomplete")
        .when(errors == 0, "success")
        .when((files == 0) | (errors >= files), "failed")
        .otherwise("partial")
    )


def recovery_choice(local_folder: Column, hours: Column, commit: Column, path: Column) -> Column:
    """What to do about an interrupted update."""
    return (
        F.when(local_folder, "resume").when(hours > 24, "full_reindex").when(commit.isNull(), "full_reindex").when(path.isNull(), "manual").otherwise("resume")
    )
