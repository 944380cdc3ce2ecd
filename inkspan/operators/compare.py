"""Comparing providers page by page: who has which page, distances around the ring of providers, seconds,
word counts, limits, quartiles and the matrix of all metrics.

A page's texts come together in one shuffle: ``side_by_side`` gives a row for each page with every provider's
text, and all metrics are expressions over that row, so no text is shuffled twice and none is joined to itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.tables import numbered, stored
from inkspan.functions.text import error_rate, word_count
from inkspan.operators.distance import with_distances


def chosen(pages: DataFrame, providers: list[str]) -> DataFrame:
    """The rows of some providers; none is an error."""
    if not providers:
        raise ValueError("no provider was chosen")
    return pages.where(F.col("provider").isin(providers))


def dealt(pages: DataFrame) -> DataFrame:
    """Rows by page over a fixed number of partitions, the one shuffle of a comparison.

    Distances cost time by the square of a text's length, so partitions that are small in bytes must not be
    put together; pages are unique, so there is nothing to add up before the shuffle.
    """
    spark = pages.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return pages.repartition(n, "ptr")


def side_by_side(pages: DataFrame, providers: list[str], complete: bool = True) -> DataFrame:
    """ptr and, for each provider, struct(txt, millis); of several rows of a page and provider the slowest
    counts. complete: only pages that all providers have."""
    cell = lambda p: F.max(F.when(F.col("provider") == p, F.struct("millis", "txt"))).alias(p)
    wide = dealt(chosen(pages, providers)).groupBy("ptr").agg(*[cell(p) for p in providers])
    return wide.where(reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in providers])) if complete else wide


def common_pages(pages: DataFrame, providers: list[str]) -> DataFrame:
    """(ptr) of the pages that all providers have."""
    return chosen(pages, providers).groupBy("ptr").agg(F.count_distinct("provider").alias("n")).where(F.col("n") == len(providers)).select("ptr")


def ring(providers: list[str]) -> list[tuple[str, str]]:
    """Each provider, in byte order, with the next one and the last with the first; two make one pair."""
    p = sorted(providers)
    pairs = [(a, p[(i + 1) % len(p)]) for i, a in enumerate(p)]
    return pairs[: len(p) - 1] if len(p) < 3 else pairs


def pair_distances(wide: DataFrame, providers: list[str], truth: str | None = None) -> DataFrame:
    """(ptr, pair_ix, metric, dist, truth_bytes, cer): the ring, and the first provider against the column ``truth``.

    The second text of a pair is the truth of its error rate.
    """
    pairs = [(f"{a.upper()} vs {b.upper()}", F.col(a)["txt"], F.col(b)["txt"]) for a, b in ring(providers)]
    if truth:
        first = min(providers)
        pairs.append((f"{first.upper()} vs PDF", F.col(first)["txt"], F.col(truth)))
    cells = [F.struct(F.lit(i).alias("pair_ix"), F.lit(name).alias("metric"), a.alias("a"), b.alias("b"), F.octet_length(b).alias("truth_bytes")) for i, (name, a, b) in enumerate(pairs)]
    rows = with_distances(wide.select("ptr", F.inline(F.array(*cells))), ["ptr", "pair_ix"])
    return rows.select("ptr", "pair_ix", "metric", "dist", "truth_bytes", error_rate(F.col("dist"), F.col("truth_bytes")).alias("cer"))


def seconds(wide: DataFrame, providers: list[str]) -> DataFrame:
    """(ptr, metric, value) of the time that each provider took."""
    cells = [F.struct(F.lit(f"{p.upper()} Seconds").alias("metric"), (F.col(p)["millis"] / F.lit(1000.0)).alias("value")) for p in sorted(providers)]
    return wide.select("ptr", F.inline(F.array(*cells)))


def pdf_word_counts(wide: DataFrame, truth: str) -> DataFrame:
    return wide.select("ptr", F.lit("PDF Word Count").alias("metric"), word_count(F.col(truth)).alias("value"))


def limits(rows: DataFrame, value: str, empty: float | None = None) -> DataFrame:
    """(lowest, highest) over all rows; ``empty`` for both where there are none, else null."""
    low, high = F.min(value), F.max(value)
    if empty is not None:
        low, high = F.coalesce(low, F.lit(empty)), F.coalesce(high, F.lit(empty))
    return rows.agg(low.alias("lowest"), high.alias("highest"))


def pass_fail(pages: DataFrame, providers: DataFrame, total: int | Column) -> DataFrame:
    """(provider, passed, failed) for every provider of the list, also one without pages."""
    passed = pages.groupBy("provider").agg(F.count_distinct("ptr").alias("passed"))
    rows = providers.join(passed, "provider", "left").withColumn("passed", F.coalesce("passed", F.lit(0)))
    total = F.lit(total) if isinstance(total, int) else total
    return rows.select("provider", "passed", (total - F.col("passed")).alias("failed"))


def summary(passed: DataFrame, col: str = "passed") -> DataFrame:
    """One line, "provider: n" for each provider in order."""
    each = F.array_sort(F.collect_list(F.concat_ws(": ", "provider", F.col(col).cast("string"))))
    return passed.agg(F.array_join(each, ", ").alias("summary"))


def metric_matrix(wide: DataFrame, providers: list[str], truth: str) -> DataFrame:
    """(metric_ix, metric, ptr, value): distances, seconds and word counts of every page, as doubles.

    One pass over the wide rows for all but the distances of long texts, which are dealt out by pair.
    """
    pairs = [(f"{a.upper()} vs {b.upper()}", F.col(a)["txt"], F.col(b)["txt"]) for a, b in ring(providers)]
    first = min(providers)
    pairs.append((f"{first.upper()} vs PDF", F.col(first)["txt"], F.col(truth)))
    times = [(f"{p.upper()} Seconds", F.col(p)["millis"] / F.lit(1000.0)) for p in sorted(providers)]
    none = F.lit(None).cast("string")
    every = [(name, a, b, F.lit(None).cast("double")) for name, a, b in pairs] + [(name, none, none, value.cast("double")) for name, value in [*times, ("PDF Word Count", word_count(F.col(truth)))]]
    cells = [F.struct(F.lit(i).alias("metric_ix"), F.lit(name).alias("metric"), a.alias("a"), b.alias("b"), value.alias("value")) for i, (name, a, b, value) in enumerate(every)]
    rows = with_distances(wide.select("ptr", F.inline(F.array(*cells))), ["ptr", "metric_ix"])
    return rows.select("metric_ix", "metric", "ptr", F.coalesce("value", F.col("dist").cast("double")).alias("value"))


def metric_names(providers: list[str]) -> list[str]:
    return [f"{a.upper()} vs {b.upper()}" for a, b in ring(providers)] + [f"{min(providers).upper()} vs PDF"] + [f"{p.upper()} Seconds" for p in sorted(providers)] + ["PDF Word Count"]


def by_page(matrix: DataFrame, metrics: list[str]) -> DataFrame:
    """ptr and a column for each metric."""
    return matrix.groupBy("ptr").pivot("metric", metrics).agg(F.first("value"))


def by_metric(matrix: DataFrame, doc: Column, place: Column) -> DataFrame:
    """The transposed form, for each document: (doc, metric_ix, metric, values), its pages' values in order.

    The header row is metric ptr with index -1. A row holds one document's pages, not the corpus'.
    """
    rows = matrix.select(doc.alias("doc"), place.alias("place"), "metric_ix", "metric", "ptr", F.format_string("%s", F.col("value")).alias("value"))
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c]), ",")
    body = rows.groupBy("doc", "metric_ix", "metric").agg(line("value").alias("values"))
    head = rows.where("metric_ix = 0").groupBy("doc").agg(line("ptr").alias("values")).select("doc", F.lit(-1).alias("metric_ix"), F.lit("ptr").alias("metric"), "values")
    return head.unionByName(body)


def tiles(matrix: DataFrame, columns: int = 1_000) -> DataFrame:
    """(tile, place, line): the transposed matrix of a whole corpus, cut into tiles of so many pages, a line for each metric.

    Side by side in order the tiles are the transposed matrix, whose rows no one task could hold. Pages go by ptr; line -1 names
    them; a page without a metric has an empty cell.
    """
    pages = numbered(matrix.select("ptr").distinct(), ["ptr"], "at")
    at = pages.select("ptr", F.expr(f"at div {columns}").alias("tile"), (F.col("at") % columns).cast("int").alias("column"))
    rows = matrix.select("metric_ix", "metric", "ptr", F.format_string("%s", F.col("value")).alias("value")).where(F.col("value").isNotNull())
    head = at.select("tile", "column", F.lit(-1).alias("metric_ix"), F.lit("ptr").alias("metric"), F.col("ptr").alias("value"))
    cells = rows.join(at, "ptr").select("tile", "column", "metric_ix", "metric", "value").unionByName(head)
    sizes = at.groupBy("tile").agg(F.max("column").alias("last"))
    lines = cells.groupBy("tile", "metric_ix", "metric").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("of")).join(sizes, "tile")
    every = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("of", i), F.lit("")))
    return lines.select("tile", F.col("metric_ix").alias("place"), F.concat_ws(",", "metric", F.array_join(every, ",")).alias("line"))


def matrix_lines(transposed: DataFrame) -> DataFrame:
    """(doc, place, line) for ``sinks.matrix``."""
    return transposed.select("doc", F.col("metric_ix").alias("place"), F.concat_ws(",", "metric", "values").alias("line"))


def transpose(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Rows and columns of a long table exchanged: long tables have neither, so only the names change."""
    return cells.select(F.col(column).alias(row), F.col(row).alias(column), value)


def quantiles(rows: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), cells: int = 256) -> DataFrame:
    """(keys, quantiles): exact, with linear interpolation, for groups of any size.

    Equal values are counted before the shuffle. A sketch of each group proposes ``cells`` cuts; cells' sums
    tell in which cells the wanted ranks lie, and only these cells' values are ordered, each cell by itself.
    The cuts decide how the work is dealt out, not the result. Nulls are left out. Counts are stored, so ``rows`` are
    worked out once.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counted = stored(counted)
    share = [i / cells for i in range(1, cells)]
    cuts = counted.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("v", share, 10_000)).alias("cuts"))
    # groups and their cuts are few, but a broadcast of them has no bound, so AQE decides
    placed = counted.join(cuts, keys).withColumn("cell", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = placed.groupBy(*keys, "cell").agg(F.sum("n").alias("size"))
    line = Window.partitionBy(*keys).orderBy("cell")
    sums = sums.withColumn("first", F.sum("size").over(line) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy(*keys)))
    rank = lambda q: F.lit(q) * (F.col("total") - 1)
    ends = [f(rank(q)).cast("long") for q in at for f in (F.floor, F.ceil)]
    wanted = F.filter(F.array_distinct(F.array(*ends)), lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("size")))
    sums = sums.withColumn("ranks", wanted).where(F.size("ranks") > 0)
    inside = placed.join(sums, [*keys, "cell"])
    upto = F.sum("n").over(Window.partitionBy(*keys, "cell").orderBy("v")) + F.col("first")
    inside = inside.withColumn("upto", upto)
    hits = inside.select(*keys, "total", "v", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
    found = hits.groupBy(*keys).agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    one = lambda q: _between(F.element_at("at", F.floor(rank(q)).cast("long")), F.element_at("at", F.ceil(rank(q)).cast("long")), rank(q) - F.floor(rank(q)))
    return found.select(*keys, F.array(*[one(q) for q in at]).alias("quantiles"))


def _between(low: Column, high: Column, part: Column) -> Column:
    return low + (high - low) * part


def paired_metrics(matrix: DataFrame, first: str, second: str) -> DataFrame:
    """(name, place, x, y): two metrics of the names that have both, from (label, place, value)."""
    def of(metric: str, col: str) -> DataFrame:
        rows = matrix.where(F.contains(F.lower("label"), F.lit(metric)))
        return rows.select(F.split_part("label", F.lit(" "), F.lit(1)).alias("name"), "place", F.col("value").cast("double").alias(col))

    return of(first, "x").join(of(second, "y"), ["name", "place"])


def join_on_first(tables: list[DataFrame], key: str) -> DataFrame:
    """Tables joined one after another on their first column; only keys that all have."""
    return reduce(lambda a, b: a.join(b, key), tables)


__all__ = ["by_metric", "by_page", "common_pages", "join_on_first", "limits", "metric_matrix", "pair_distances", "pass_fail", "quantiles", "ring", "side_by_side"]
