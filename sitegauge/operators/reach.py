"""Breadth-first reach over the link graph, all sites at once."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions import urls as U
from sitegauge.functions.skew import number_in_order
from sitegauge.operators.robots import robots_allowed
from sitegauge.session import stage, stage_steps

#: Levels of the first jobs; the last entry holds for all that follow.
LEVELS = (4, 8)
#: Written tables of visited pages that are merged to one.
MERGE_AFTER = 8
#: Levels after which a page's path is replaced by its rank.
RANK_AFTER = 64

_LEVELS_A_STATEMENT = 4
_LINK_DIGITS = 6
_RANK_DIGITS = 12

def adjacency(link_edges: DataFrame, rules: DataFrame | None, max_pages: int | None = None) -> DataFrame:
    """Per page its distinct allowed internal targets, in link order.

    A page is named by its clean URL; of pages that share one, that of the least raw
    URL counts. With ``max_pages`` only so many targets of a page are kept: a page's
    k-th target is queued after its k-1 earlier ones, so later ones are never reached.
    """
    internal = link_edges.where("is_internal").select(
        "site", U.clean_url(F.col("src_url")).alias("src"), "src_url", F.col("dst_clean").alias("url"), "pos")
    first = internal.groupBy("site", "src").agg(F.min("src_url").alias("src_url"))
    edges = internal.join(first, ["site", "src", "src_url"]).groupBy("site", "src", "url").agg(F.min("pos").alias("pos"))
    if rules is not None:
        edges = robots_allowed(edges, rules)
    nth = F.row_number().over(Window.partitionBy("site", "src").orderBy("pos"))
    ranked = edges.withColumn("nth", nth)
    return ranked.select("site", "src", "url", "nth") if max_pages is None else ranked.where(
        F.col("nth") <= max_pages).select("site", "src", "url", "nth")


def _digits(number: Column, width: int) -> Column:
    """A number as text of fixed width, so that texts sort as numbers do."""
    return F.lpad(F.hex(number), width, "0")


#: The pages before and those that the fresh ones link to, each with the least of its
#: (level, key), without those known before: one shuffle by page. The text is the same at
#: every level, and so is the code that Spark compiles for it.
_NEXT_LEVEL = f"""
  SELECT f.site, f.url, f.place.level AS level, f.place.key AS key, NOT f.old AS fresh
  FROM (SELECT site, page.url AS url, min(struct(page.level, page.key)) AS place, max(page.old) AS old
        FROM (SELECT r.site, explode(concat(
                array(struct(r.url AS url, r.level AS level, r.key AS key, true AS old)),
                transform(if(r.fresh, coalesce(t.targets, array()), array()), x -> struct(
                  x.url AS url, r.level + 1 AS level,
                  concat(r.key, lpad(hex(x.nth), {_LINK_DIGITS}, '0')) AS key, false AS old)))) AS page
              FROM <before> r LEFT JOIN {{targets}} t ON r.site = t.site AND r.url = t.url)
        GROUP BY site, page.url) f
  LEFT ANTI JOIN {{known}} k ON f.site = k.site AND f.url = k.url"""


def _next_levels(frontier: DataFrame, targets: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """Pages of the next ``count`` levels, as one plan written in statements of four levels.

    The frontier itself is known, but is what the first step begins with.
    """
    reached = frontier
    for done in range(0, count, _LEVELS_A_STATEMENT):
        names = ["{reached}", *[f"level_{i}" for i in range(done + 1, min(done + _LEVELS_A_STATEMENT, count) + 1)]]
        steps = ", ".join(f"{name} AS ({_NEXT_LEVEL.replace('<before>', before)})"
                          for before, name in zip(names, names[1:]))
        reached = frontier.sparkSession.sql(f"WITH {steps} SELECT * FROM {names[-1]}",
                                            reached=reached, targets=targets, known=known)
    return reached


def _merged(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def link_reach(start_urls: DataFrame, link_edges: DataFrame, rules: DataFrame | None = None,
               max_pages: int | None = None) -> DataFrame:
    """Pages in visiting order: (site, visit_no, url, level).

    ``start_urls`` has (site, start_url). All sites advance together, ``LEVELS`` levels
    per job and then as many as the last entry says, until no site finds a new page; a
    level is one shuffle by page. First-in first-out order is that of the level and, in
    it, of the least path of link ranks from the start, so pages carry that path as
    their key and are numbered once, at the end, in range chunks. Keys that grow long are
    replaced by the page's rank in its level. ``max_pages`` stops a site that has so many
    pages; the numbers cut it exactly. Every job's pages are a written table, merged with
    the earlier ones every ``MERGE_AFTER`` jobs, so lost executors cost a re-read and no
    site must fit into a task.
    """
    starts = start_urls.select("site", F.col("start_url").alias("url")).distinct()
    if rules is not None:
        starts = robots_allowed(starts, rules)
    first = starts.select("site", U.clean_url(F.col("url")).alias("url"), F.lit(0).alias("level"),
                          F.lit("").alias("key")).distinct().withColumn("fresh", F.lit(True))
    visited = [stage(first, "reach")]
    targets = (adjacency(link_edges, rules, max_pages).groupBy("site", F.col("src"))
               .agg(F.sort_array(F.collect_list(F.struct("nth", "url"))).alias("targets"))
               .withColumnRenamed("src", "url"))
    width = int(link_edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    targets = targets.repartition(width, "site", "url").persist(StorageLevel.DISK_ONLY)
    frontier, level, path, jobs = visited[0], 0, 0, 0
    try:
        while not frontier.isEmpty():
            count = LEVELS[min(jobs, len(LEVELS) - 1)]
            known = _merged(visited).select("site", "url")
            visited.append(stage_steps(_next_levels(frontier, targets, known, count), "reach"))
            level, path, jobs = level + count, path + count, jobs + 1
            if len(visited) > MERGE_AFTER:
                visited = [stage(_merged(visited), "reach")]
            frontier = visited[-1].where((F.col("level") == level) & F.col("fresh"))
            if max_pages is not None:
                full = _merged(visited).groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") >= max_pages)
                frontier = frontier.join(full.select("site"), "site", "left_anti")
            if path >= RANK_AFTER:
                ranked = number_in_order(frontier, ["site"], ["key", "url"], "rank")
                frontier = stage(ranked.withColumn("key", _digits(F.col("rank"), _RANK_DIGITS)).drop("rank"), "reach")
                path = 0
    finally:
        targets.unpersist()
    numbered = number_in_order(_merged(visited), ["site"], ["level", "key", "url"], "visit_no")
    if max_pages is not None:
        numbered = numbered.where(F.col("visit_no") <= max_pages)
    return numbered.select("site", F.col("visit_no").cast("int").alias("visit_no"), "url", "level")
