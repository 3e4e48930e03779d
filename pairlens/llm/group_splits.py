"""Problem 3: splits in given proportions that never part records which share an entity.

Components come from parallel hooking and shortcutting over a table of parents; the split of each component from a
subset-sum over the sizes of components and their multiplicities.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.keys import known_block, patch_number
from pairlens.operators.skew import lookup_join, ranked_within, salted_join
from pairlens.session import materialize, small_or_not
from pairlens.sources.tables import table

#: Shares of the splits (train takes what the others leave).
SHARES = (("dev", 0.1), ("test", 0.1))
SEED = "42"


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of the undirected ``edges`` (``u``, ``v`` BIGINT); the component is its least node.

    Self-loops, repeated edges and both directions are allowed; edges with a null end are left out. Each round hooks every
    root to its least neighbour, halves the paths to the roots until they are flat, and contracts the edges, so at least half
    of the roots vanish. All steps are joins of tables; only counts reach the driver.
    """
    e = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    labels = materialize(e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("component", F.col("node")), "labels")
    e = materialize(e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while e.count() > 0:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("root"), F.least("u", "m").alias("parent")), "parents")
        while True:
            up = parents.select(F.col("root").alias("parent"), F.col("parent").alias("grand"))  # a hub is many roots' parent
            jumped = materialize(lookup_join(parents, up, ["parent"], F.col("root")).select("root", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "parents")
            parents = jumped.select("root", "parent")
            if jumped.filter("moved").isEmpty():
                break
        to = lambda c: parents.select(F.col("root").alias(c), F.col("parent").alias(f"{c}_to"))
        # Components that are whole have no row among the parents any more.
        moving = lookup_join(labels, to("component"), ["component"], F.col("node")).select("node", F.col("component_to").alias("component"))
        labels = materialize(moving.unionByName(labels.join(small_or_not(parents.select(F.col("root").alias("component"))), "component", "left_anti").select("node", "component")), "labels")
        moved = lookup_join(lookup_join(e, to("u"), ["u"], F.col("v")), to("v"), ["v"], F.col("u")).filter("u_to <> v_to")
        e = materialize(moved.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct(), "edges")
    return labels


def linked_blocks(rows: DataFrame) -> DataFrame:
    """Components of blocks that rows of one patch tie together; ``rows`` needs ``patch`` and ``block`` (null: none known).

    Only a patch that names several blocks makes links: from its least block to each other one.
    """
    named = rows.filter(F.col("patch").isNotNull() & F.col("block").isNotNull()).select("patch", F.col("block").cast("long").alias("block"))
    several = materialize(named.groupBy("patch").agg(F.min("block").alias("u"), F.max("block").alias("w")).filter("u < w").select("patch", "u"), "several")
    links = salted_join(named, several, ["patch"], F.col("block")).filter("u <> block").select("u", F.col("block").alias("v"))
    return connected_components(links)


def _with_shifted(low: np.ndarray, high: np.ndarray, by: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs [low, high] of set bits of a bitset together with the same moved up by ``by``, up to ``most``."""
    inside = low <= most - by
    a, b = np.concatenate([low, low[inside] + by]), np.concatenate([high, np.minimum(high[inside] + by, most)])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.concatenate([[True], a[1:] > b[:-1] + 1])
    last = np.concatenate([first[1:], [True]])
    return a[first], b[last]


def _reached(low: np.ndarray, high: np.ndarray, total: int) -> bool:
    k = int(np.searchsorted(low, total, "right")) - 1
    return k >= 0 and bool(high[k] >= total)


def choose_sizes(sizes: Sequence[tuple[int, int]], wanted: Sequence[tuple[str, int]]) -> dict[str, dict[int, int]]:
    """For each named split how many units of each size it gets, so that its total is as near to the wanted one as can be.

    ``sizes``: (size, how many units have it). Splits are filled in the order given, each from what is left; ties go to the smaller
    total. Sums are exact at every size. The smallest sizes of which each is at most one more than all smaller units together
    reach every total up to their own. Above them a bitset has a bit for each total, up to twice the wanted one, that some subset of the
    larger units reaches with them; multiplicities enter as powers of two, until the wanted total is reached. The bitset is kept
    as its runs of set bits, each as long as the small units' total at least, and smaller sizes come first, so that runs grow together early.
    """
    left = {s: m for s, m in sizes if s > 0 and m > 0}
    chosen: dict[str, dict[int, int]] = {}
    for name, want in wanted:
        picked: dict[int, int] = {}
        small: list[tuple[int, int]] = []
        filled = 0
        for s, m in sorted((s, m) for s, m in left.items() if m > 0):
            if s > filled + 1:
                break
            small.append((s, m))
            filled += s * m
        low, high = np.array([0], np.int64), np.array([min(filled, 2 * want)], np.int64)
        steps: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for s, m in sorted((s, m) for s, m in left.items() if m > 0 and s > filled + 1):
            k = 1
            while m > 0 and s * min(k, m) <= 2 * want and not _reached(low, high, want):
                take = min(k, m)
                steps.append((s, take, low, high))
                low, high = _with_shifted(low, high, s * take, 2 * want)
                m, k = m - take, k * 2
        at = int(np.searchsorted(low, want, "right")) - 1
        total = min(int(high[at]), want)
        if total < want and at + 1 < len(low) and int(low[at + 1]) - want < want - total:
            total = int(low[at + 1])
        # What could be reached before a step needs none of it.
        for s, take, low, high in reversed(steps):
            if not _reached(low, high, total):
                picked[s] = picked.get(s, 0) + take
                total -= s * take
        for s, m in reversed(small):
            if n := min(m, total // s):
                picked[s] = n
                total -= s * n
        chosen[name] = picked
        for s, n in picked.items():
            left[s] -= n
    return chosen


def split_targets(sizes: Sequence[tuple[int, int]], shares: Sequence[tuple[str, float]] = SHARES) -> dict[str, tuple[int, int]]:
    """(rows by the share, rows that are tried for) of each split.

    The two differ only where the units that are no larger than the largest split's share can't fill all splits: then the splits
    share these units' rows in their proportions.
    """
    total = sum(s * n for s, n in sizes)
    asked = {name: int(total * share + 0.5) for name, share in shares}
    fit = sum(s * n for s, n in sizes if s <= max(asked.values(), default=0))
    if fit >= sum(asked.values()):
        return {k: (v, v) for k, v in asked.items()}
    return {name: (v, fit * v // sum(asked.values())) for name, v in asked.items()}


def _sizes(units: DataFrame) -> list[tuple[int, int]]:
    return [(r["size"], r["n"]) for r in units.groupBy(F.col("size").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()]


def grouped_split(units: DataFrame, shares: Sequence[tuple[str, float]] = SHARES, rest: str = "train", seed: str = SEED) -> DataFrame:
    """(``unit``, ``size``, ``split``) for ``units`` (``unit``, ``size``): whole units, totals as near to the shares as can be.

    Splits are filled in the order given; where one unit holds so much that the others can't fill them, they get the others in proportion.
    The driver sees only how many units have each size: distinct sizes grow as the square root of the rows at most.
    """
    units = units.select("unit", F.col("size").cast("long").alias("size"))
    rows = _sizes(units)
    chosen = choose_sizes(rows, [(k, v) for k, (_, v) in split_targets(rows, shares).items()])
    cuts, used = [], {}
    for name, _ in shares:
        for s, n in chosen[name].items():
            cuts.append((s, used.get(s, 0), used.get(s, 0) + n, name))
            used[s] = used.get(s, 0) + n
    table_of = units.sparkSession.createDataFrame(cuts or [(-1, 0, 0, rest)], "size long, above long, upto long, split string")
    ranked = ranked_within(units, ["size"], [F.md5(F.concat(F.col("unit"), F.lit(seed))), F.col("unit")], F.concat(F.col("unit"), F.lit(seed)), name="place")
    joined = ranked.join(table_of, (ranked["size"] == table_of["size"]) & (F.col("place") > F.col("above")) & (F.col("place") <= F.col("upto")), "left")
    return joined.select("unit", ranked["size"], F.coalesce("split", F.lit(rest)).alias("split"))


def _rows(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "train_patches").select("rec_id", patch_number(F.col("patch_id")).alias("patch"), known_block(F.col("block_id")).cast("long").alias("block"))


def split_units(rows: DataFrame, components: DataFrame) -> DataFrame:
    """(``rec_id``, ``unit``) of each row: the component of its patch's blocks, else its patch, else the row itself.

    Units are found for patches first, and rows then look theirs up; a patch that holds very many rows is split for that.
    """
    r = rows.select("rec_id", "patch", F.col("block").cast("long").alias("block"))
    linked = small_or_not(components.withColumnRenamed("node", "block"))
    of_block = F.concat(F.lit("block "), F.coalesce("component", "block"))
    patches = r.filter(F.col("patch").isNotNull()).groupBy("patch").agg(F.min("block").alias("block")).join(linked, "block", "left")
    patches = patches.select("patch", F.coalesce(of_block, F.concat(F.lit("patch "), F.col("patch"))).alias("unit"))
    named = salted_join(r.filter(F.col("patch").isNotNull()).select("rec_id", "patch"), patches, ["patch"], F.col("rec_id")).select("rec_id", "unit")
    other = r.filter(F.col("patch").isNull()).join(linked, "block", "left").select("rec_id", F.coalesce(of_block, F.concat(F.lit("row "), F.col("rec_id"))).alias("unit"))
    return named.unionByName(other)


def _assigned(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(``rec_id``, ``unit``, ``split``) of each row, and the units (``unit``, ``size``)."""
    rows = _rows(spark, data_dir)
    of_row = materialize(split_units(rows, linked_blocks(rows)), "units")
    units = materialize(of_row.groupBy("unit").agg(F.count(F.lit(1)).alias("size")), "sizes")
    return salted_join(of_row, grouped_split(units).select("unit", "split"), ["unit"], F.col("rec_id")).select("rec_id", "unit", "split"), units


def p3_assign(spark: SparkSession, data_dir: str) -> DataFrame:
    """The split of each row of train_patches; rows with one block or one patch stay together.

    A row without a known patch and block is a unit of its own. An empty table gives no rows.
    """
    return _assigned(spark, data_dir)[0]


def _report(spark: SparkSession, data_dir: str) -> DataFrame:
    units = _assigned(spark, data_dir)[1]
    got = grouped_split(units).groupBy("split").agg(F.sum("size").alias("n_rows"), F.count(F.lit(1)).alias("n_units"))
    sizes = _sizes(units)
    total = sum(s * n for s, n in sizes)
    asked = split_targets(sizes)
    lines = [*((k, a, w) for k, (a, w) in asked.items()), ("train", total - sum(a for a, _ in asked.values()), total - sum(w for _, w in asked.values()))]
    targets = spark.createDataFrame(lines, "split string, asked long, wanted long")
    share = F.round(F.col("n_rows") / F.nullif(F.lit(total), F.lit(0)), 6)
    return F.broadcast(targets).join(got, "split", "left").select("split", "asked", "wanted", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_units")]).withColumn("share", share)


def p3_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each split's rows by its share (``asked``), those tried for (``wanted``: less where large units leave too few rows), rows, units and share reached."""
    return _report(spark, data_dir)


def p3_totals(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows asked for and reached by each split, and how many patches and blocks stand in several splits (none may)."""
    rows = _rows(spark, data_dir)
    where = p3_assign(spark, data_dir).select("rec_id", "split")
    placed = materialize(rows.join(where, "rec_id"), "placed")
    several = lambda c: placed.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").agg(F.count(F.lit(1)).alias(f"parted_{c}"))
    got = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return got.join(F.broadcast(several("patch"))).join(F.broadcast(several("block")))


def p3_classes(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each block that is tied to others: its component (the least block) and how many blocks this has."""
    c = linked_blocks(_rows(spark, data_dir))
    sizes = materialize(c.groupBy("component").agg(F.count(F.lit(1)).alias("n_blocks")), "sizes")
    return lookup_join(c, sizes, ["component"], F.col("node")).select(F.col("node").alias("block"), "component", "n_blocks")


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs of blocks that must stay in one split."""
    c = linked_blocks(_rows(spark, data_dir))
    a = c.select(F.col("component"), F.col("node").alias("block_a"))
    b = c.select(F.col("component"), F.col("node").alias("block_b"))
    pairs = salted_join(b, a, ["component"], F.col("block_b"))
    return pairs.filter("block_a < block_b").select(F.col("block_a").cast("int").alias("block_a"), F.col("block_b").cast("int").alias("block_b"))


QUERIES = {"p3_found": p3_found, "p3_assign": p3_assign, "p3_report": p3_report, "p3_totals": p3_totals, "p3_classes": p3_classes}
_REACH = """
with recursive named as (
  select distinct regexp_extract(patch_id, '(\\d+)', 1)::bigint as p, block_id as b from train_patches where block_id is not null and block_id <> -1),
e as (select distinct x.b as u, y.b as v from named x join named y using (p) where x.b <> y.b),
reach(u, v) as (select u, v from e union select r.u, e.v from reach r join e on r.v = e.u)"""
SQL = {
    "p3_found": _REACH + " select u as block_a, v as block_b from reach where u < v",
    "p3_classes": _REACH + " select u::bigint as block, min(v)::bigint as component, count(*) as n_blocks from reach group by u",
    "p3_totals": """with n as (select count(*) as n from train_patches), s(split, n_rows) as (
  select 'dev', floor(n * 0.1 + 0.5)::bigint from n union all select 'test', floor(n * 0.1 + 0.5)::bigint from n union all select 'train', n - 2 * floor(n * 0.1 + 0.5)::bigint from n)
select split, n_rows, 0::bigint as parted_patch, 0::bigint as parted_block from s""",
}
