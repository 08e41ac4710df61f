"""Search by inner product over a table of vectors: a permutation index and exact MaxScore.

The query set is stated (here: ids divisible by 20) and meets all rows in blocks: rows and queries are packed into blocks
of bounded size, every pair of a row block and a query block meets in some task, and the task keeps the
best of each query while it goes through its row blocks. Blocks are dealt evenly, whatever the vectors' values, so no
vector, cell or list that is common makes a task large. Only the pivots are ever sent to the driver.

Rows could instead be dealt by pivot, so that a query meets only rows that are posted under its own pivots. Where vectors
have no clusters that saves nothing: README has the figures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stage, table

ROW_BLOCK, QUERY_BLOCK = 4096, 2048
#: Tasks among which the row blocks of a query block are divided.
SPREAD = 8
PIVOTS, PREFIX, RERANK = 256, 32, 0.3
#: Rows of a range that are ranked again at least: in few rows, orders tell less.
LEAST_RERANKED = 1024
#: Rows are ranked by angle among such as have norms within this factor.
NORM_STEP = 1.1


def valid_vectors(df: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>, or array<float> where they are such) of vectors without null or non-finite components; zero: all-zero ones stay. Empty vectors, null
    vectors and rows with a null vec_id go."""
    v = F.col("embedding")
    if dict(df.dtypes)["embedding"] != "array<float>":
        v = v.cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def _small(rows: np.ndarray) -> str:
    """The smallest type that holds these numbers as they are."""
    if len(rows) and (rows == np.floor(rows)).all():
        most = np.abs(rows).max()
        return "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    with np.errstate(over="ignore"):
        return "<f4" if (rows.astype("<f4") == rows).all() else "<f8"


def _held(kind: str, data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(count, -1)


def blocks(rows: DataFrame, count: int, size: int, extra: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None, large: float | None = None) -> DataFrame:
    """(block long, dims int, kind string, ids binary, data binary, and a binary column for each of extra) of up to ``size`` vectors of one
    dimension, of count rows. data: the numbers in the smallest type that holds them. Rows with a number beyond ``large`` have
    blocks of their own. Partitions are cut as they are, small ones together; block numbers are unique."""
    names = sorted(extra(np.zeros((1, 1)))) if extra else []
    bound = float("inf") if large is None else large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[tuple[int, bool], tuple[list, list]] = {}

        def block(key: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal number
            ids, data = np.concatenate(held[key][0]), np.concatenate(held[key][1])
            held[key] = ([ids[size:]], [data[size:]])
            ids, data = ids[:size], data[:size]
            more = extra(data) if extra else {}
            number += 1
            kind = _small(data)
            columns = [pa.array([number], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([kind]), pa.array([ids.tobytes()], pa.binary()), pa.array([data.astype(kind).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([more[n].tobytes()], pa.binary()) for n in names)], names=["block", "dims", "kind", "ids", "data", *names])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            widths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(widths)
            for dims in np.unique(widths).tolist():
                at = np.flatnonzero(widths == dims)
                data = values.reshape(-1, dims) if len(at) == len(ids) else np.stack([values[ends[i] - dims : ends[i]] for i in at])
                beyond = np.abs(data).max(axis=1) > bound
                for key in {(dims, x) for x in beyond.tolist()}:
                    kept = held.setdefault(key, ([], []))
                    kept[0].append(ids[at][beyond == key[1]])
                    kept[1].append(data[beyond == key[1]])
                    while sum(map(len, held[key][0])) >= size:
                        yield block(key)
        for key in sorted(held):
            if sum(map(len, held[key][0])):
                yield block(key)

    few = rows.coalesce(max(1, -(-count // size)))
    return few.mapInArrow(run, "block long, dims int, kind string, ids binary, data binary" + "".join(f", {n} binary" for n in names))


class Best:
    """The best k rows of every query of a block so far: highest score first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, kind: type):
        self.ids, self.k = ids, k
        self.score = [np.zeros(0, kind) for _ in ids]
        self.row = [np.zeros(0, np.int64) for _ in ids]

    def threshold(self, i: int):
        """The k-th best score, or None while fewer are held."""
        return self.score[i][-1] if len(self.score[i]) >= self.k else None

    def add(self, i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        other = rows != self.ids[i]
        scores, rows = np.concatenate([self.score[i], scores[other]]), np.concatenate([self.row[i], rows[other]])
        order = np.lexsort((rows, -scores))[: self.k]
        self.score[i], self.row[i] = scores[order], rows[order]


def search(rows: DataFrame, queries: DataFrame, score: Callable, k: int, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score): rows and queries are blocks; score(row block, its ids and data, the queries' data, best) puts
    what it finds into best. Only blocks of the same dimension meet."""
    names = rows.columns
    queries = stage(queries)
    # A row block goes once to each query block (their numbers are 12 bytes for 2,048 queries), a query block once to each part:
    # the join holds one query block at a time while row blocks stream past it, in the order of the query blocks.
    numbers = queries.select(F.col("block").alias("asked"), "dims")
    asked = queries.select(F.col("block").alias("asked"), *(F.col(c).alias(f"query_{c}") for c in ("kind", "ids", "data")))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    sent = rows.withColumn("part", F.pmod(F.hash("block"), F.lit(SPREAD))).join(numbers, "dims")
    grid = sent.join(asked.hint("merge"), ["asked", "part"])
    number = np.int64 if kind == "long" else np.float64
    fields = [*names, "asked", "query_kind", "query_ids", "query_data"]
    out_type = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, data = None, None, None

        def result() -> pa.RecordBatch:
            n = [len(r) for r in best.row]
            arrays = [pa.array(np.repeat(best.ids, n), pa.int64()), pa.array(np.concatenate(best.row), pa.int64()), pa.array(np.concatenate(best.score), out_type)]
            return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(c)[i].as_py() for c, n in enumerate(fields)}
                if row["asked"] != held:
                    if best is not None:
                        yield result()
                    held, best = row["asked"], Best(np.frombuffer(row["query_ids"], "<i8"), k, number)
                    data = _held(row["query_kind"], row["query_data"], len(best.ids)).astype(np.float64)
                ids = np.frombuffer(row["ids"], "<i8")
                score(row, ids, _held(row["kind"], row["data"], len(ids)), data, best)
        if best is not None:
            yield result()

    found = grid.select(fields).mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# ---- Permutation index


def norms(data: np.ndarray) -> np.ndarray:
    largest = np.abs(data).max(axis=1, initial=0.0)
    scale = np.where(largest > 0, largest, 1.0)
    return largest * np.sqrt(((data / scale[:, None]) ** 2).sum(axis=1))


def directions(data: np.ndarray) -> np.ndarray:
    """The rows at norm 1: the nearest by angle to a query has the largest inner product with it among rows of one norm."""
    largest = np.abs(data).max(axis=1, initial=0.0, keepdims=True)
    data = data / np.where(largest > 0, largest, 1.0)
    size = np.sqrt((data * data).sum(axis=1, keepdims=True))
    return data / np.where(size > 0, size, 1.0)


def norm_ranges(sizes: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(largest norm, rows) of the rows whose norms lie within a factor NORM_STEP, the largest norms first; 1 is amid a range."""
    number = np.floor(np.log(np.maximum(sizes, 1e-300)) / np.log(NORM_STEP) + 0.5)
    order = np.argsort(-number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    return [(float(sizes[rows].max()), rows) for rows in np.split(order, cuts) if len(rows)]


def prefixes(points: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(n, prefix): every point's nearest pivots, nearest first, ties to the lower number."""
    near = points @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype("<u2")


def inverted(orders: np.ndarray, pivots: int) -> np.ndarray:
    """(pivots, n) inverted files: a pivot's list has, for each row, how far its place in the row's order is from the prefix's end, and 0 where
    the row isn't posted. In a block of some thousand rows bytes for all of them cost less than numbers for some."""
    n, prefix = orders.shape
    out = np.zeros((pivots, n), np.uint8)
    out[orders, np.arange(n)[:, None]] = prefix - np.arange(prefix)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of largest inner product that the index finds for each query, not itself.

    Both are (vec_id, v) as valid_vectors gives them. ``pivots`` vectors (those of the smallest id hashes: a bounded sample) order
    every row by its ``prefix`` nearest pivots. A row block's inverted files post its rows under their pivots; a query's
    lists add up the footrule distance to its own order. Orders tell angles only, so of every range of norms in the block the
    ``rerank`` share that is nearest by it, and never fewer than LEAST_RERANKED or 4 k rows, is ranked again by inner products in
    double precision; a range is left out where its norms can't lift a row to the k-th best score. Repeated ids are rows of
    their own. A query of another dimension than a row doesn't find it.
    """
    if prefix > 255:
        raise ValueError("places must fit in a byte")
    spark = vectors.sparkSession
    ship(spark)
    vectors, queries = stage(vectors), stage(queries)
    count, asked = vectors.count(), queries.count()
    sample = vectors.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(pivots).select("v").collect()
    by_dims: dict[int, np.ndarray] = {}
    for dims in {len(r["v"]) for r in sample}:
        by_dims[dims] = directions(np.array([r["v"] for r in sample if len(r["v"]) == dims]))

    def indexed(data: np.ndarray) -> dict[str, np.ndarray]:
        own = by_dims.get(data.shape[1])
        return {"orders": np.zeros((len(data), 0), "<u2") if own is None else prefixes(directions(data), own, prefix)}

    def score(row: dict, ids: np.ndarray, data: np.ndarray, asked_data: np.ndarray, best: Best) -> None:
        own = by_dims.get(data.shape[1])
        data = data.astype(np.float64)
        ranges = norm_ranges(norms(data))
        keeps = [len(rows) if own is None else min(len(rows), max(LEAST_RERANKED, 4 * k, int(np.ceil(rerank * len(rows))))) for _, rows in ranges]
        lengths = norms(asked_data)
        if own is not None:
            posted = inverted(np.frombuffer(row["orders"], "<u2").reshape(len(ids), -1), len(own))
            own_prefix = min(prefix, len(own))
            orders = prefixes(directions(asked_data), own, own_prefix)
            left = (own_prefix - np.arange(own_prefix)).astype(np.uint8)[:, None]
        for i, q in enumerate(asked_data):
            held, near = best.threshold(i), np.arange(len(ids))
            reach = [n for n, (norm, _) in enumerate(ranges) if held is None or norm * lengths[i] * (1 + 1e-9) >= held]
            if not reach:
                continue
            if any(keeps[n] < len(ranges[n][1]) for n in reach):
                # A shared pivot saves twice the lesser distance to the prefix's end of the footrule distance that sharing none has.
                saved = np.minimum(posted[orders[i]], left).sum(axis=0, dtype=np.int32)
                near = np.concatenate([rows if keep == len(rows) else rows[np.argpartition(-saved[rows], keep - 1)[:keep]] for (_, rows), keep in ((ranges[n], keeps[n]) for n in reach)])
            elif len(reach) < len(ranges):
                near = np.concatenate([ranges[n][1] for n in reach])
            candidates = np.take(data, near, axis=0)
            rough = candidates @ q
            least = np.partition(rough, -k - 1)[-k - 1] if len(rough) > k + 1 else -np.inf
            if held is not None:
                least = max(least, held)
            chosen = np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least) if np.isfinite(least) else 1.0))
            if len(chosen):
                best.add(i, ids[near[chosen]], (candidates[chosen] * q).sum(axis=1))  # the same sum for equal vectors, wherever they stand

    return search(blocks(vectors, count, ROW_BLOCK, indexed), blocks(queries, asked, QUERY_BLOCK), score, k, "double")


# ---- MaxScore


def whole_components(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): floor(64 x) of every component, a whole number of any size."""

    def whole(x: Column) -> Column:
        x = F.greatest(F.least(x * F.lit(64.0), F.lit(np.finfo(float).max)), F.lit(np.finfo(float).min))
        return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)

    return vectors.select("vec_id", F.transform("v", whole).alias("v"))


#: Components above this are scored one by one: products of any two up to it, added up over 2**13 dimensions, are exact in doubles.
LARGE = 2.0**20
#: A share of non-essential terms below which traversing the postings for many queries at once costs less than leaving them out for each,
#: and how many; and a share of competitive rows above which probing them one by one costs more than traversing the other postings.
MANY, STEP, CROWDED = 0.95, 256, 0.03
#: Rows that are probed in all their other terms at once.
FEW_ROWS = 128
MOST_LONG = (1 << 63) - 1


def exact_scores(data: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size; one beyond a long is the largest long, or that below zero."""
    with np.errstate(all="ignore"):
        sure = np.abs(data) @ np.abs(q) < 2.0**62  # not so where it overflows to nan
        out = data.astype(np.int64) @ q.astype(np.int64)
    for i in np.flatnonzero(~sure).tolist():
        total = sum(int(a) * int(b) for a, b in zip(data[i].tolist(), q.tolist(), strict=True) if a and b)
        out[i] = max(-MOST_LONG, min(MOST_LONG, total))
    return out


def top_scores(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the highest integer inner product, exactly, not itself; ties to
    the smaller id. Both are (vec_id, v array<double>) of whole numbers. A score beyond a long counts as the largest
    long, or as that below zero.

    MaxScore on every row block: a dimension is a query term, its postings the block's components, and a term adds between its
    least and its greatest product in the block. Terms are split by score bounds: while the bounds of the least
    ones add up to less than what is missing to the k-th best score, they are non-essential. The essential terms'
    postings are traversed; rows that stay competitive are probed in the others, the largest bounds first, and
    dropped as soon as the terms left can't lift them to the k-th best. Blocks' results are merged by score. Rows or queries
    with components beyond ``LARGE`` have no such bounds; all their terms are essential.
    """
    ship(vectors.sparkSession)
    vectors, queries = stage(vectors), stage(queries)
    count, asked = vectors.count(), queries.count()
    probe = 8

    def bounds(data: np.ndarray) -> dict[str, np.ndarray]:
        return {"least": data.min(axis=0).astype("<f8"), "most": data.max(axis=0).astype("<f8")}

    def score(row: dict, ids: np.ndarray, data: np.ndarray, asked_data: np.ndarray, best: Best) -> None:
        least, most = np.frombuffer(row["least"], "<f8"), np.frombuffer(row["most"], "<f8")
        reach, widest = float(max(np.abs(least).max(), np.abs(most).max())), np.abs(asked_data).max(axis=1, initial=0.0)
        usual = widest <= LARGE if reach <= LARGE and data.shape[1] <= 1 << 13 else np.zeros(len(widest), bool)
        small = reach * widest.max(where=usual, initial=0.0) * data.shape[1] < 2**24
        kind = np.float32 if small else np.float64  # sums of these sizes are exact
        postings = np.ascontiguousarray(data.T.astype(kind)) if usual.any() else None
        together: list[tuple[int, np.ndarray, np.ndarray]] = []

        def probed(i: int, rows: np.ndarray, sums: np.ndarray, others: np.ndarray, ends: np.ndarray) -> None:
            """Add to the best of query i what stays competitive among the rows, whose sums lack the terms of others."""
            held, query, above = best.threshold(i), asked_data[i].astype(kind), float(ends[1][others].sum())
            while len(others):
                kept = np.flatnonzero(sums + above >= held)
                rows, sums = rows[kept], sums[kept]
                if not len(rows):
                    return
                some = len(others) if len(rows) <= FEW_ROWS else probe
                take, others = others[-some:], others[:-some]
                above -= float(ends[1][take].sum())
                sums = sums + query[take] @ postings[np.ix_(take, rows)]
            best.add(i, *best_of(ids[rows], sums, held))

        def traversed(some: list[tuple[int, np.ndarray, np.ndarray]], essential: bool) -> np.ndarray:
            """(queries, rows): sums of the essential terms, or of the others. Postings are read once for many queries; a term that is left
            out weighs nothing."""
            weights = asked_data[[i for i, _, _ in some]].astype(kind)
            for own, (_, others, _) in zip(weights, some, strict=True):
                own[others if essential else np.setdiff1d(np.arange(len(own)), others)] = 0
            return weights @ postings

        every = np.arange(len(ids))
        for i, q in enumerate(asked_data):
            held = best.threshold(i)
            if not usual[i]:
                best.add(i, *best_of(ids, exact_scores(data.astype(np.float64), q), held))
                continue
            ends = np.sort(np.stack([q * least, q * most]), axis=0)
            missing = -1.0 if held is None else float(held) - ends[0].sum()
            span = ends[1] - ends[0]  # a term's bound above its least product
            order = np.argsort(span, kind="stable")
            split = int(np.searchsorted(np.cumsum(span[order]), missing, side="left")) if missing > 0 else 0  # bounds of the terms up to this one
            if split == len(q):
                continue  # not even all terms lift a row to the k-th best
            if split < MANY * len(q):
                together.append((i, order[:split], ends))
            else:
                essential = order[split:]
                probed(i, every, q.astype(kind)[essential] @ postings[essential], order[:split], ends)
        for a in range(0, len(together), STEP):
            crowded = []
            for sums, (i, others, ends) in zip(traversed(together[a : a + STEP], True), together[a : a + STEP], strict=True):
                alive = np.flatnonzero(sums + float(ends[1][others].sum()) >= best.threshold(i)) if len(others) else every
                if len(others) and len(alive) > CROWDED * len(ids):
                    crowded.append(((i, others, ends), alive, sums))
                else:
                    probed(i, alive, sums[alive], others, ends)
            if crowded:  # so many rows stay competitive that their other terms are traversed as well
                for rest, ((i, _, _), alive, sums) in zip(traversed([c[0] for c in crowded], False), crowded, strict=True):
                    best.add(i, *best_of(ids[alive], (sums + rest)[alive], best.threshold(i)))

    def best_of(ids: np.ndarray, sums: np.ndarray, held) -> tuple[np.ndarray, np.ndarray]:
        """The rows among which the k best are, itself perhaps one more."""
        if held is None and len(sums) > k + 1:
            held = np.partition(sums, -k - 1)[-k - 1]
        at = np.arange(len(sums)) if held is None else np.flatnonzero(sums >= held)
        return ids[at], sums[at].astype(np.int64)

    return search(blocks(vectors, count, ROW_BLOCK, bounds, LARGE), blocks(queries, asked, QUERY_BLOCK), score, k, "long")


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"), zero=False)
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_components(valid_vectors(table(spark, sf_dir, "embeddings"), zero=True))
    return top_scores(vectors, vectors.where("vec_id % 20 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
