"""Windows: keeping, capping and ordering rows within groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; the limit reaches below the sort."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", place).where(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fair_share(df: DataFrame, group: str, source: str, order: list, per_source: int, total: int) -> DataFrame:
    """Round-robin over the sources of a group: first rows of all, then second ones, up to both limits."""
    rows = numbered(df, [group, source], order, "_own").where(F.col("_own") <= per_source)
    return first_per(rows, [group], ["_own", source], total).drop("_own")


def budgeted(df: DataFrame, group: str, order: list, size: Column, per_row: int, total: int) -> DataFrame:
    """Characters of each row's content under a cap per row and a running total per group; 0 when it is spent."""
    capped = F.least(size, F.lit(per_row))
    before = F.sum("_c").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_c", capped)
    return rows.withColumn("allowed", F.greatest(F.lit(0), F.least("_c", total - F.coalesce(before, F.lit(0))))).drop("_c")


def walked(rows: DataFrame, key: str, order: list, walk, schema: str) -> DataFrame:
    """Rows of each key in ``order`` through a walk that may depend on all earlier ones, as a stream.

    ``walk()`` makes the state of one key: ``see(row)`` takes a row and may give output rows, ``result()`` gives those of the
    end. Only that state is held, whatever the number of the key's rows; the sort spills.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        now = state = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if state is None or getattr(row, key) != now:
                    out += state.result() if state is not None else []
                    now, state = getattr(row, key), walk()
                out += state.see(row) or []
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(state.result(), columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Edition:
    """The picks of one edition."""

    def __init__(self, most: int, per_category: int):
        self.most, self.per_category = most, per_category
        self.chosen, self.seen, self.count, self.best = [], set(), {}, None

    def see(self, row) -> None:
        if self.best is None and row.category == "economy":
            self.best = row
        if len(self.chosen) >= self.most:
            return
        families = set(row.families)
        if self.count.get(row.category, 0) >= self.per_category or families & self.seen and row.sources < 3:
            return
        self.chosen.append(row)
        self.seen |= families
        self.count[row.category] = self.count.get(row.category, 0) + 1

    def result(self) -> list[tuple]:
        chosen, best = self.chosen, self.best
        if best is not None and all(r.id != best.id for r in chosen):
            if len(chosen) < self.most:
                chosen.append(best)
            else:
                at = next((k for k in reversed(range(len(chosen))) if chosen[k].category != "economy"), None)
                if at is not None:
                    chosen[at] = best
        return [(r.edition, r.id, k + 1) for k, r in enumerate(chosen)]


def diverse_select(ranked: DataFrame, most: int = 12, per_category: int = 3) -> DataFrame:
    """A finite, varied edition from ``ranked(edition, place, id, category, families, sources)``.

    Down the ranking of an edition: at most ``per_category`` of a category; a candidate that repeats a named
    family of an earlier pick needs three sources. Where no economy card came in, the best one is added or
    takes the last place of another category. The choice depends on earlier ones, so an edition's
    candidates, all of them, pass by in order.
    """
    kinds = dict(ranked.dtypes)
    schema = f"edition {kinds['edition']}, id {kinds['id']}, slot int"
    return walked(ranked, "edition", ["place", "id"], lambda: Edition(most, per_category), schema)


class Related:
    """The related articles of one card."""

    def __init__(self, per_publisher: int, per_cluster: int, total: int):
        self.limits, self.by, self.clusters, self.keep = (per_publisher, per_cluster, total), {}, {}, []

    def see(self, row) -> None:
        per_publisher, per_cluster, total = self.limits
        by, within = self.by.get(row.source, 0), self.clusters.get(row.cluster, 0)
        if len(self.keep) < total and by < per_publisher and within < per_cluster:
            self.by[row.source], self.clusters[row.cluster] = by + 1, within + 1
            self.keep.append((row.card, row.id, len(self.keep) + 1))

    def result(self) -> list[tuple]:
        return self.keep


def capped_related(related: DataFrame, per_publisher: int = 4, per_cluster: int = 2, total: int = 20) -> DataFrame:
    """Related articles of a card under two caps that act on each other, walked in order of similarity.

    A card's rows of one publisher and cluster beyond the first ``per_cluster`` can never be kept and are left out before.
    """
    order = [F.desc("similarity"), F.desc("shared"), "id"]
    first = first_per(related, ["card", "source", "cluster"], order, per_cluster)
    kinds = dict(related.dtypes)
    schema = f"card {kinds['card']}, id {kinds['id']}, place int"
    return walked(first, "card", order, lambda: Related(per_publisher, per_cluster, total), schema)


def bucket(rank: Column) -> Column:
    return F.when(rank <= 1, "lead").when(rank <= 4, "topline").when(rank <= 8, "secondary").otherwise("tail")


def prominence(rank: Column, rss: Column) -> Column:
    """Score of a place in a channel: an RSS feed is ranked by its editors, a sitemap is not."""
    score = lambda a, b, c, e: F.when(rank <= 1, a).when(rank <= 4, b).when(rank <= 8, c).otherwise(e)
    return F.when(rss, score(24, 18, 10, 4)).otherwise(score(18, 13, 7, 2))


def body_status(body: Column, headline: Column) -> Column:
    """``full`` from 600 characters on, ``summary`` if longer than the headline, else ``headline_only``."""
    return F.when(F.length(body) >= 600, "full").when(F.length(body) > F.length(headline), "summary").otherwise("headline_only")
