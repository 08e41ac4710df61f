"""SimHash near-duplicates: BK-trees over shards of fingerprints, joined into components.

A fingerprint has a bit where over half of the features' hashes have it. Fingerprints that share a band of bits share a
shard; the shard's BK-tree keeps children by their integer Hamming distance to the parent, and a search follows
only edges within the radius. Trees over all fingerprints would grow with the corpus and may not be broadcast, so
each shard's tree is built in the task that the shard's rows are dealt to. A shard above ``SHARD_ROWS`` is divided, which bounds
every tree whatever the data: by more bits where that is exact, else into blocks of which each two meet in some task.
No task gets a large group of copies whole, and no two rows of a shard miss each other.
A shard gives a spanning forest of its links, not all pairs; that leaves the components as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, hidden, ship, stage, table

#: Fingerprints in a shard; a larger shard is divided.
SHARD_ROWS = 1024
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D, A-Z in lower case."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words joined by spaces, repeats included; fewer words are one run."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    spans = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - size + 1)


def widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words) hashes of 64 bits from n; the first column is what was given if there is one column only."""
    if words == 1:
        return hashes.reshape(-1, 1)
    with np.errstate(over="ignore"):
        z = hashes.reshape(-1, 1) + _MIX[0] * np.arange(1, words + 1, dtype=np.uint64)
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the (n, words) hashes have each bit; long lists are first added up bit by bit in parallel."""
    width = rows.shape[1] * 64
    total = np.zeros(width, np.int64)
    pending, weight = [rows], 1
    while pending:
        carried = []
        for block in pending:
            while len(block) > 48:
                third = len(block) // 3
                a, b, c = block[:third], block[third : 2 * third], block[2 * third : 3 * third]
                either = a ^ b
                carried.append((a & b) | (c & either))
                block = np.concatenate([either ^ c, block[3 * third :]])
            if len(block):
                bits = np.unpackbits(np.ascontiguousarray(block).view(np.uint8).reshape(len(block), -1), axis=1, bitorder="little")
                total += weight * bits.sum(axis=0, dtype=np.int64)
        pending = [np.concatenate(carried)] if carried else []
        weight *= 2
    return total


def simhash(hashes: np.ndarray, words: int = 1) -> bytes:
    """The fingerprint, highest bit first: a bit is 1 if set in over half of the hashes; none: zero."""
    if not len(hashes):
        return bytes(8 * words)
    counts = bit_counts(widen(hashes, words))
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()[::-1]


class BKTree:
    """Fingerprints as integers; a node's children are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Put value in; the numbers of the values before it that are within radius."""
        number = len(self.values)
        self.values.append(value)
        self.children.append({})
        if not number:
            return []
        values, children, found, todo = self.values, self.children, [], [0]
        at = 0
        while True:  # its place
            edge = (values[at] ^ value).bit_count()
            below = children[at].get(edge)
            if below is None:
                children[at][edge] = number
                break
            at = below
        while todo:  # what is near it
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius and at != number:
                found.append(at)
            todo += [child for edge, child in children[at].items() if -radius <= edge - distance <= radius and child != number]
        return found


def forest(nodes: list[int], prints: list[bytes], radius: int) -> list[tuple[int, int]]:
    """Links (node, node) that join what a shard's links join, the shortest ones: a minimum spanning forest."""
    tree, root, close = BKTree(), list(range(len(nodes))), []
    values = [int.from_bytes(p, "big") for p in prints]
    for i, value in enumerate(values):
        close += [((value ^ values[j]).bit_count(), i, j) for j in tree.add(value, radius)]
    close.sort()

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for _, i, j in close:
        a, b = top(i), top(j)
        if a != b:
            root[a] = b
            out.append((nodes[i], nodes[j]))
    return out


class Bands:
    """Shard keys of fingerprints. exact: the bits not yet used are cut into radius + 1 parts, of which fingerprints
    within the radius share one. Otherwise ``count`` bands of ``width`` bits, which nothing divides further: a near copy may share one
    band in five only, so each band that two share must let them meet."""

    def __init__(self, bits: int, radius: int, count: int = 0, width: int = 0):
        self.bits, self.radius, self.count, self.width = bits, radius, count, width
        self.cuts: dict[tuple, list] = {}

    def below(self, path: tuple[int, ...]) -> list[tuple[int, list[int]]]:
        """(number, bit positions) of the parts that divide what shares the parts of path."""
        if path not in self.cuts:
            free = list(range(self.bits))
            for k in path:
                cut = self._cut(free)
                free = [p for i, part in enumerate(cut) if i != k for p in part]
            self.cuts[path] = [(k, part) for k, part in enumerate(self._cut(free)) if part]
        return self.cuts[path]

    def _cut(self, free: list[int]) -> list[list[int]]:
        parts = self.radius + 1
        at = [len(free) * k // parts for k in range(parts + 1)]
        return [free[a:b] for a, b in zip(at, at[1:], strict=False)]


def _value(number: int, positions: list[int]) -> int:
    low, size = positions[0], len(positions)
    if positions[-1] - low == size - 1:
        return number >> low & (1 << size) - 1
    return sum((number >> p & 1) << k for k, p in enumerate(positions))


def _keyed(rows: DataFrame, bands: Bands) -> DataFrame:
    """(shard, path, node, key, print): each row under every part that divides its path's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            old, path, node, key, print_ = (batch.column(i).to_pylist() for i in range(5))
            out: list = [[], [], [], [], []]
            for i, k in enumerate(key):
                number = int.from_bytes(k, "big")
                for part, positions in bands.below(tuple(path[i])):
                    shard = xxhash.xxh64_intdigest(b"%d,%d,%d" % (old[i], part, _value(number, positions)))
                    for column, value in zip(out, (shard - (shard >> 63 << 64), [*path[i], part], node[i], k, print_[i]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    names = ["shard", "path", "node", "key", "print"]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
    return rows.select(names).mapInArrow(run, "shard long, path array<int>, node long, key binary, print binary")


def shards_of(keys: np.ndarray, bands: Bands) -> np.ndarray:
    """(n, count) shards of (n, bytes) keys, highest bit first: one for each band."""
    bits = np.unpackbits(keys, axis=1)[:, ::-1][:, : bands.count * bands.width].reshape(len(keys), bands.count, bands.width)
    values = bits @ (np.uint64(1) << np.arange(bands.width, dtype=np.uint64))
    return widen((values + (np.arange(bands.count, dtype=np.uint64) << np.uint64(bands.width))).ravel(), 2)[:, 1].reshape(values.shape).view(np.int64)


def _banded(nodes: DataFrame, bands: Bands, columns: list[str]) -> DataFrame:
    """(shard, columns): each node under the shard of each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), bands.count))
                yield pa.RecordBatch.from_arrays([pa.array(shards_of(keys, bands).ravel()), *(c.take(rows) for c in batch.columns[1:])], names=["shard", *columns])

    kinds = dict(nodes.dtypes)
    return nodes.select("key", *columns).mapInArrow(run, ", ".join(["shard long", *(f"{c} {kinds[c]}" for c in columns)]))


def _met(rows: DataFrame, large: DataFrame, shard_rows: int) -> DataFrame:
    """rows under new shards: one for each two blocks of half ``shard_rows`` rows that a large shard (shard, count) is cut into."""
    blocks = F.ceil(F.col("count") / F.lit(max(1, shard_rows // 2))).cast("long")
    cut = rows.join(large, "shard").withColumn("_of", blocks).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_of")))
    both = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1))).where("_own <> _other")
    return both.withColumn("shard", F.xxhash64("shard", F.least("_own", "_other"), F.greatest("_own", "_other"))).select(rows.columns)


def links(nodes: DataFrame, bands: Bands, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) that span every shard's links. nodes: (node long, key binary, print binary), staged;
    keys choose the shards and prints are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shard, held_nodes, held_prints = None, [], []
        names = ["a", "b"]

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=names)

        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(shards):
                continue
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            out: list = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if shards[a] != held_shard:
                    if len(held_nodes) > 1:
                        out += forest(held_nodes, held_prints, radius)
                    held_shard, held_nodes, held_prints = shards[a], [], []
                    if b - a == 1 and b < len(shards):
                        continue
                held_nodes += batch.column(1).slice(a, b - a).to_pylist()
                held_prints += batch.column(2).slice(a, b - a).to_pylist()
            yield batch_of(out)
        if len(held_nodes) > 1:
            yield batch_of(forest(held_nodes, held_prints, radius))

    spark = nodes.sparkSession
    ship(spark)
    found = []
    if bands.count:
        sizes = _banded(nodes, bands, []).groupBy("shard").count()
        large = stage(sizes.where(F.col("count") > shard_rows))
        rows = _banded(nodes, bands, ["node", "print"])
        found.append(rows.join(large, "shard", "left_anti"))
        if not large.isEmpty():
            found.append(_met(rows, large, shard_rows))
    else:
        rows = nodes.select(F.lit(0).cast("long").alias("shard"), F.array().cast("array<int>").alias("path"), "node", "key", "print")
        while True:
            rows = _keyed(rows, bands)
            large = stage(rows.groupBy("shard").count().where(F.col("count") > shard_rows))
            if large.isEmpty():
                found.append(rows)
                break
            rows = stage(rows)
            found.append(rows.join(large, "shard", "left_anti"))
            rows = rows.join(large, "shard", "left_semi")
    edges = None
    for part in found:
        each = part.select("shard", "node", "print").repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "a long, b long")
        edges = each if edges is None else edges.unionByName(each)
    return edges


def labelled(prints: DataFrame, bands: Bands, radius: int, shard_rows: int = SHARD_ROWS, check: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """prints (doc_id, key, print, staged), component_id, the smallest doc_id that links reach (null doc_ids count last), and group, a
    number that tells components apart where doc_ids repeat. Rows of one print are one node; with a column ``same``, those of one ``same``, and equal prints link like any others.
    check(edges, nodes): edges that hold, of pairs that edges join."""
    prints = prints if "same" in prints.columns else prints.withColumn("same", F.col("print"))
    others = [c for c in prints.columns if c not in ("key", "print", "same")]
    nodes = prints.groupBy("same").agg(F.min("key").alias("key"), F.min("print").alias("print"), F.min("doc_id").alias("first"), F.min(F.struct(*others)).alias("who"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()))
    edges = links(nodes, bands, radius, shard_rows)
    parts = components(check(edges, nodes) if check else edges)
    joined = stage(nodes.join(parts, "node").select("same", "first", "component"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = joined.join(least, "component").select("same", "component_id", "component")
    names = nodes.select("same", "first", "node").join(linked, "same", "left")
    names = names.select("same", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("component", "node").alias("group"))
    return prints.join(names, "same").drop("same")


#: Texts, and bytes of their sets, in a block of a component whose texts are compared; a task holds two blocks.
MEET_ROWS, MEET_BYTES = 256, 1 << 23


def alike_pairs(sets: list[np.ndarray], parts: list[int], sides: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of this Jaccard similarity at least that join different parts, enough to join all that such pairs join: of
    side 0 with side 1, or where there is no side 1, of all."""
    label, sizes, side = np.unique(parts, return_inverse=True)[1], np.array([len(x) for x in sets]), np.array(sides)
    wanted = side == 1 if side.any() else np.ones(len(sets), bool)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    row = row[order]
    starts = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0)) if len(flat) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(flat)))
    code = np.empty(len(flat), np.int64)
    code[order] = np.repeat(np.arange(len(starts)), counts)
    ends, out = np.cumsum(sizes), []
    for i in np.flatnonzero(side == 0).tolist():
        other = wanted & (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        if not other.any():
            continue
        codes = code[ends[i] - sizes[i] : ends[i]]
        codes = codes[counts[codes] > 1]
        both, at = np.zeros(len(sets), np.int64), 0
        total = np.cumsum(counts[codes])
        while at < len(codes):  # the lists of about a million places at once
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
            n = counts[codes[at:to]]
            places = np.repeat(starts[codes[at:to]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both += np.bincount(row[places], minlength=len(sets))
            at = to
        for j in np.flatnonzero(other & (both >= similarity * (sizes + sizes[i] - both))).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def left_apart(edges: DataFrame, sure: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of this similarity between nodes that edges join but sure leaves apart: every such pair is compared, whether it is an
    edge or not. Blocks of a component meet in bounded tasks, and those of one part of sure don't meet. held: (node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pair, group = None, []

        def result() -> pa.RecordBatch:
            found = alike_pairs([np.frombuffer(x[3], np.uint64) for x in group], [x[1] for x in group], [x[0] for x in group], similarity) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([group[x[k]][2] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for pair, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pair != held_pair:
                    yield result()
                    held_pair, group = pair, []
                group.append(rest)
        yield result()

    groups, parts = components(edges), components(sure).withColumnRenamed("component", "part")
    rows = groups.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    rows = stage(rows.join(held.select("node", F.octet_length("set").alias("bytes")), "node"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")]
    cuts = F.ceil(F.greatest(F.col("n") / F.lit(MEET_ROWS), F.col("bytes") / F.lit(MEET_BYTES), F.lit(1.0))).cast("long")
    apart = rows.groupBy("component").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("component")
    sizes = stage(rows.join(apart, "component", "left_semi").groupBy("component", "part").agg(*sums).withColumn("cuts", cuts))
    pools = sizes.where("cuts = 1").groupBy("component").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("component", cuts.alias("pool"))
    dealt = rows.join(sizes.select("component", "part", "cuts"), ["component", "part"]).join(pools, "component", "left")
    own = F.when(F.col("cuts") > 1, F.col("part"))  # a large part has blocks to itself, small ones share some
    block = F.when(F.col("cuts") > 1, F.xxhash64("part", F.pmod(F.xxhash64("node"), F.col("cuts")))).otherwise(F.pmod(F.xxhash64("part"), F.col("pool")))
    dealt = stage(dealt.select("component", "node", "part", own.alias("own"), block.alias("block")))
    blocks = dealt.select("component", "block", "own").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, F.col("x.component") == F.col("y.component")).where("x.block <= y.block and not coalesce(x.own = y.own, false)")
    pairs = stage(pairs.select("x.component", F.col("x.block").alias("first"), F.col("y.block").alias("second")).withColumn("pair", F.monotonically_increasing_id()))
    sides = pairs.select("component", F.col("first").alias("block"), "pair", F.lit(0).alias("side")).unionByName(pairs.where("first <> second").select("component", F.col("second").alias("block"), "pair", F.lit(1).alias("side")))
    met = dealt.join(sides, ["component", "block"]).join(held, "node").select("pair", "side", "part", "node", "set")
    return met.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long")


def similar(edges: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges that join what pairs of this Jaccard similarity at least of their texts' sets of shingles join, exactly, of all pairs of nodes
    that edges join over any number of steps. docs: (doc_id, _digest, text); a node's text is that of its ``who``.

    The edges are checked first; a pair may be alike though the edges on the way between its nodes aren't, so then every
    pair that the edges that hold leave apart is compared as well."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.unique(shingle_hashes(words_of((t.as_py() or "").encode()), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "set"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    used = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    used = used.join(nodes.select("node", F.col("who.doc_id").alias("_id"), F.col("who._digest").alias("_who")), "node")
    texts = docs.join(used, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_who"))).dropDuplicates(["node"])
    held = stage(texts.select("node", "text").mapInArrow(sets, "node long, set binary"))
    pairs = edges.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    sure = stage(pairs.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"))
    return sure.unionByName(left_apart(edges, sure, held, similarity))


def fingerprints(docs: DataFrame, columns: list[str], shingle: int, words: int, key_words: int = 0) -> DataFrame:
    """columns of docs, key and print of every whole text. key_words: the key is a fingerprint of the distinct words, so
    many times 64 bits wide, the print is one of the distinct shingles, and ``same`` is a digest of their set; 0: the key
    is the print, of shingles with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, same = [], [], []
            for text in batch.column(batch.num_columns - 1):
                split = words_of((text.as_py() or "").encode())
                hashes = shingle_hashes(split, shingle)
                if key_words:
                    hashes = np.unique(hashes)
                    same.append(hashlib.md5(hashes.tobytes()).digest())
                prints.append(simhash(hashes, words))
                keys.append(simhash(shingle_hashes_distinct(split), key_words) if key_words else prints[-1])
            more = [pa.array(x, pa.binary()) for x in ([keys, prints, same] if key_words else [keys, prints])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*columns, *["key", "print", "same"][: len(more)]])

    chosen = docs.select(*columns, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, key binary, print binary" + (", same binary" if key_words else ""))


def shingle_hashes_distinct(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, 42) for w in sorted(set(words))], np.uint64)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    64-bit fingerprints of whole texts link at ``radius`` or fewer differing bits. Null, empty and blank texts have the
    fingerprint zero and link like any other. Repeated rows keep a row each. Columns but doc_id and text are not read.
    """
    ship(docs.sparkSession)
    prints = stage(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], shingle, 1))
    return labelled(prints, Bands(64, radius), radius).select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


#: For deduplication: bits of the print, and of the key in bands. Two sets of Jaccard similarity s have an angle
#: arccos(2s / (1 + s)) and differ in that share of pi of the bits.
PRINT_WORDS, KEY_WORDS, BAND_COUNT, BAND_WIDTH = 8, 8, 25, 20


def radius_of(similarity: float, bits: int) -> int:
    """Bits that differ at this Jaccard similarity, and three standard deviations: one pair in 700 of just this similarity differs in more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + 3 * np.sqrt(bits * share * (1 - share)))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, _digest (of the text), component_id and group of every row of docs: the smallest doc_id of its group of near-duplicates, and
    the group's number.

    Texts count as near-duplicates where their sets of five-word shingles have a Jaccard similarity of ``similarity`` at
    least. Texts of one set are one candidate; others differ in no more bits of a 512-bit SimHash of the distinct shingles than such
    texts do; shards come from bands of a SimHash of the distinct words, which changes far less between near copies than one of
    shingles. Spanning forests of the shards join candidates into groups; within a group every pair is decided on the sets
    themselves, but for such as are known to be joined. Null and blank texts are copies of each other."""
    ship(docs.sparkSession)
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("_digest"), "text")
    prints = stage(fingerprints(rows, ["doc_id", "_digest"], shingle, PRINT_WORDS, KEY_WORDS))
    bands = Bands(64 * KEY_WORDS, 0, BAND_COUNT, BAND_WIDTH)
    return labelled(prints, bands, radius_of(similarity, 64 * PRINT_WORDS), check=lambda edges, nodes: similar(edges, nodes, rows, shingle, similarity))


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one document, that of the smallest doc_id, of each group of near-duplicates as ``near_groups`` finds them.

    Rows that repeat doc_id and text count as one document: the one stays whose columns come first as JSON text. All columns
    are kept."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "_digest"))
    chosen = near_groups(docs, shingle, similarity).groupBy("group").agg(first.alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k._digest").alias("_chosen"))
    full, names = hidden(docs)
    own, same_text = F.col(names["doc_id"]).cast("long"), F.unhex(F.md5(F.coalesce(F.col(names["text"]), F.lit(""))))
    found = full.join(chosen, own.eqNullSafe(F.col("_id")) & (same_text == F.col("_chosen")), "left_semi")
    twins = docs.groupBy("doc_id").count().where("count > 1")
    if not twins.isEmpty():
        row = F.struct(*found.columns)
        found = found.groupBy(own, same_text).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return found.select(*(F.col(new).alias(old) for old, new in names.items()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
