"""Sharding by best-fit decreasing: groups of equal texts, largest first, enter the tightest bin that holds them.

Open bins stand in an AVL tree by remaining capacity. Groups of one size are placed together: best fit puts them
into the tightest bin until it is full and then goes on to the next, so a run of equal groups over a run of equal
bins is one step. The driver holds a histogram of group sizes only; sizes that occur are at most
2 * sqrt(total bytes), whatever the number of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RANK_ROWS, ranked, salted, stage, table


class RemainingTree:
    """An AVL tree from remaining capacity to a list of (first bin, number of bins)."""

    class _Node:
        __slots__ = ("key", "bins", "left", "right", "height")

        def __init__(self, key: int, bins: list):
            self.key, self.bins, self.left, self.right, self.height = key, bins, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(node) -> int:
        return node.height if node else 0

    def _fit(self, node) -> None:
        node.height = 1 + max(self._height(node.left), self._height(node.right))

    def _turn(self, node, left: bool):
        up = node.right if left else node.left
        if left:
            node.right, up.left = up.left, node
        else:
            node.left, up.right = up.right, node
        self._fit(node)
        self._fit(up)
        return up

    def _balance(self, node):
        self._fit(node)
        lean = self._height(node.left) - self._height(node.right)
        if lean > 1:
            if self._height(node.left.left) < self._height(node.left.right):
                node.left = self._turn(node.left, True)
            return self._turn(node, False)
        if lean < -1:
            if self._height(node.right.right) < self._height(node.right.left):
                node.right = self._turn(node.right, False)
            return self._turn(node, True)
        return node

    def add(self, key: int, first: int, count: int) -> None:
        def into(node):
            if node is None:
                return self._Node(key, [(first, count)])
            if key == node.key:
                node.bins.append((first, count))
                return node
            if key < node.key:
                node.left = into(node.left)
            else:
                node.right = into(node.right)
            return self._balance(node)

        self.root = into(self.root)

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity that holds size."""
        node, best = self.root, None
        while node:
            if node.key >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    def take(self, key: int) -> tuple[int, int]:
        """Remove and return a run of bins with this remaining capacity, the first-added one."""
        node = self.root
        while node.key != key:
            node = node.left if key < node.key else node.right
        run = node.bins.pop(0)
        if not node.bins:
            self.root = self._without(self.root, key)
        return run

    def _without(self, node, key: int):
        if key < node.key:
            node.left = self._without(node.left, key)
        elif key > node.key:
            node.right = self._without(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            least = node.right
            while least.left:
                least = least.left
            node.key, node.bins = least.key, least.bins
            node.right = self._without(node.right, least.key)
        return self._balance(node)


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Bins used, and runs (size, first rank, count, first bin, groups a bin): of the groups of a size, those ranked
    from first rank on, count of them, fill bins from first bin on, so many each. histogram: (size, count), sizes differ."""
    tree, used, runs = RemainingTree(), 0, []
    for size, left in sorted(histogram, reverse=True):
        if size > capacity:
            raise ValueError(f"a group of {size} exceeds the capacity {capacity}")
        rank = 0
        while left:
            key = tree.tightest(size)
            if key is None:
                key, each = capacity, capacity // size
                first, bins = used, -(-left // each)
                used += bins
            else:
                each = key // size
                first, bins = tree.take(key)
            full = min(bins, left // each)
            if full:
                runs.append((size, rank, full * each, first, each))
                if key - each * size:
                    tree.add(key - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins and left:
                runs.append((size, rank, left, first + full, left))
                if key - left * size:
                    tree.add(key - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < bins:
                tree.add(key, first + full, bins - full)
    return used, runs


def level(histogram: list[tuple[int, int]], shards: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Runs for at most ``shards`` bins whose fills are as equal as best fit makes them: the least capacity that
    does. A group as large as an equal share of what is left gets a shard to itself first."""
    rest, runs, first = dict(histogram), [], 0
    while rest and shards - first > 1 and max(rest) * (shards - first) >= sum(s * n for s, n in rest.items()):
        size = max(rest)
        done = sum(r[2] for r in runs if r[0] == size)
        runs.append((size, done, 1, first, 1))
        first, rest[size] = first + 1, rest[size] - 1
        if not rest[size]:
            del rest[size]
    if not rest:
        return first, runs
    items, bins = list(rest.items()), shards - first
    total = sum(s * n for s, n in items)
    low = max(-(-total // bins), max(rest))
    high, found = low, None  # with many small groups, the least that could do does
    while found is None:
        used, got = best_fit_decreasing(items, high)
        if used <= bins:
            found = used, got
        else:
            low, high = high + 1, high + max(rest)
    while low < high:
        half = (low + high) // 2
        used, got = best_fit_decreasing(items, half)
        if used <= bins:
            high, found = half, (used, got)
        else:
            low = half + 1
    begun = {r[0]: sum(x[2] for x in runs if x[0] == r[0]) for r in runs}
    return first + found[0], runs + [(s, k + begun.get(s, 0), n, b + first, e) for s, k, n, b, e in found[1]]


def shard_groups(rows: DataFrame, size: str, group: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Add ``shard`` (int): rows with the same ``group`` share one. Pass ``capacity`` for the fewest shards of a
    fixed capacity, or ``shards`` for that many of nearly equal size. Sizes must be positive. rows is read
    twice; pass a staged one. A null group is one group of its own; no rows give no rows. A group beyond the
    capacity is an error, as it can't be divided."""
    spark = rows.sparkSession
    groups = salted(rows.groupBy(F.col(group).alias("_group")).agg(F.sum(size).cast("long").alias("_weight")))
    groups = ranked(groups, ["_weight"], "_place", max(16, groups.count() // RANK_ROWS), small=False)
    counted = groups.groupBy("_weight").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = [(r["_weight"], r["n"]) for r in counted]
    _, runs = level(histogram, shards) if shards else best_fit_decreasing(histogram, capacity)
    plan = spark.createDataFrame(runs, "_weight long, _first long, _count long, _bin long, _each long")
    placed = groups.join(plan, (groups["_weight"] == plan["_weight"]) & groups["_place"].between(F.col("_first"), F.col("_first") + F.col("_count") - 1))
    placed = placed.select("_group", (F.col("_bin") + F.expr("(_place - _first) div _each")).cast("int").alias("shard"))
    return rows.join(placed, rows[group].eqNullSafe(placed["_group"])).drop("_group")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Equal texts share a shard. A null text counts as an empty one: size 1, crc 0, and the same group. Repeated rows
    and doc_ids keep a row and a slot each. Columns but doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )
    placed = salted(shard_groups(base, "size", "digest", shards=shards).drop("digest"))
    slots = ranked(placed, ["shard"], "slot", max(256, base.count() // RANK_ROWS), small=True)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
