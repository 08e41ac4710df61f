"""Best-fit packing of token pieces into sequences, improved by swaps between underfull bins.

Lengths run from 1 to the sequence's capacity, so the pieces of a whole corpus are one histogram. The driver packs that
histogram: a *pattern* is the multiset of lengths in a bin, kept once with the number of bins that have it.
Best fit decreasing gives the first patterns. A local search then exchanges one-for-one, two-for-one or moves
a piece between two underfull patterns, on as many pairs of bins as there are at once; each step raises the sum of
squared fills, so bins empty and the search ends. Its work depends on the capacity, not on the number of pieces.
Every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RANK_ROWS, ranked, salted, ship, table

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def fill(pattern: Pattern) -> int:
    return sum(s * n for s, n in pattern)


def changed(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    held = Counter(dict(pattern))
    held.subtract(out)
    held.update(into)
    return tuple(sorted(((s, n) for s, n in held.items() if n), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Bins by pattern after best fit decreasing."""
    done: Counter = Counter()
    open_: dict[int, list[tuple[Pattern, int]]] = {}

    def put(pattern: Pattern, count: int) -> None:
        rest = capacity - fill(pattern)
        if not rest:
            done[pattern] += count
        else:
            open_.setdefault(rest, []).append((pattern, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            rest = min((r for r in open_ if r >= size), default=None)
            if rest is None:
                each = capacity // size
                pattern, bins = (), -(-left // each)
            else:
                pattern, bins = open_[rest].pop(0)
                if not open_[rest]:
                    del open_[rest]
                each = rest // size
            full = min(bins, left // each)
            left -= full * each
            if full:
                put(changed(pattern, (), (size,) * each), full)
            if full < bins and left:
                put(changed(pattern, (), (size,) * left), 1)
                full, left = full + 1, 0
            if full < bins:
                put(pattern, bins - full)
    for kept in open_.values():
        for pattern, count in kept:
            done[pattern] += count
    return done


def step(a: Pattern, b: Pattern, capacity: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What a, the fuller one, gives and takes so that it becomes as full as one step makes it, or None.

    The squared fills grow by every such step, since a gains what b, no fuller than a, loses."""
    slack = capacity - fill(a)
    best, found = 0, None
    mine, theirs = [s for s, _ in a], [s for s, _ in b]
    twos = sorted({x + y for i, x in enumerate(theirs) for y in theirs[i:] if x != y or dict(b)[x] > 1})
    pairs = {x + y: (x, y) for i, x in enumerate(theirs) for y in theirs[i:] if x != y or dict(b)[x] > 1}
    own = {x + y: (x, y) for i, x in enumerate(mine) for y in mine[i:] if x != y or dict(a)[x] > 1}
    for x in theirs:  # moves
        if best < x <= slack:
            best, found = x, ((), (x,))
    for x in theirs:  # one for one, and one of theirs for two of mine
        for y in mine:
            if best < x - y <= slack:
                best, found = x - y, ((y,), (x,))
        for total, two in own.items():
            if best < x - total <= slack:
                best, found = x - total, (two, (x,))
    for y in mine:  # two of theirs for one of mine
        for total in twos:
            if best < total - y <= slack:
                best, found = total - y, ((y,), pairs[total])
    return found


def local_search(bins: Counter, capacity: int, least: int) -> Counter:
    """Improve bins until no step helps, or the least possible number of bins is reached."""
    bins = Counter({p: n for p, n in bins.items() if p and n})
    stuck: set[tuple[Pattern, Pattern]] = set()
    while sum(bins.values()) > least:
        open_ = sorted((p for p in bins if fill(p) < capacity), key=lambda p: (fill(p), p))
        moved = False
        for b in open_:  # empty the emptiest into the fullest
            for a in reversed(open_):
                if fill(a) < fill(b) or (a, b) in stuck or (a == b and bins[a] < 2):
                    continue
                found = step(a, b, capacity)
                if not found:
                    stuck.add((a, b))
                    continue
                count = bins[a] // 2 if a == b else min(bins[a], bins[b])
                for old, new in ((a, changed(a, *found)), (b, changed(b, found[1], found[0]))):
                    bins[old] -= count
                    if new:
                        bins[new] += count
                bins = +bins
                moved = True
                break
            if moved:
                break
        if not moved:
            break
    return bins


def pack(histogram: dict[int, int], capacity: int) -> Counter:
    """Bins by pattern for the pieces of a histogram (length -> how many)."""
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    return local_search(best_fit(histogram, capacity), capacity, least)


def places(bins: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, pieces a sequence, offset): where the pieces of a length go."""
    runs, begun, first = [], Counter(), 0
    for pattern, count in sorted(bins.items(), reverse=True):
        offset = 0
        for size, each in pattern:
            runs.append((size, begun[size], count * each, first, each, offset))
            begun[size] += count * each
            offset += size * each
        first += count
    return runs


#: A text within these letters and signs is split alike by both tokenizer libraries.
PLAIN = re.compile(r"[^\t\n\r -~¡-ɏΑ-Ωα-ωА-я–—‘-„•…€、。ぁ-んァ-ヶ一-龥가-힣]")


class Encoder:
    """Ids as the tokenizers library gives them. Plain texts go through the same vocabulary and merges in tiktoken, four times
    as fast; other texts, and those that spell a special token, through tokenizers itself."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = [x["content"] for x in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        merges = model["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        in_order = all(model["model"]["vocab"][m] == 256 + i for i, m in enumerate(joined))
        self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or PLAIN.search(text) or self.special.search(text):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False)


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only one longer than capacity is cut, and its first piece takes what remains."""
    first = len(ids) % capacity or min(len(ids), capacity)
    return [(0, first)] * bool(len(ids)) + [(s, capacity) for s in range(first, len(ids), capacity)]


def tokenized(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every text, whole; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encoder = Encoder(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end))
                out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(pieces_of(ids, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id. Repeated rows are packed each for itself. Full pieces
    make a sequence of their own with a negative id; the others have ids from 0. No documents give no rows.
    """
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    rows = salted(tokenized(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity, end))
    whole = rows.where(F.col("length") == capacity).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = rows.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}  # fewer rows than capacity
    runs = spark.createDataFrame(places(pack(histogram, capacity)), "length long, _first long, _count long, _sequence long, _each long, _offset long")
    buckets = F.array(*(F.lit(max(8, histogram.get(length, 0) // RANK_ROWS)) for length in range(capacity)))  # a common length has more
    part = ranked(part, ["length"], "_place", F.get(buckets, F.col("length").cast("int")), small=True)
    # The runs are as many as lengths in patterns: bounded by the capacity, not by the corpus.
    at = F.col("_place") - F.col("_first")
    part = part.join(F.broadcast(runs), "length").where((at >= 0) & (at < F.col("_count")))
    part = part.withColumn("sequence_id", F.col("_sequence") + F.expr("(_place - _first) div _each")).withColumn("offset", F.col("_offset") + F.col("length") * F.pmod(at, F.col("_each")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return part.select(columns).unionByName(whole.select(columns))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
