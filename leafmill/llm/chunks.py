"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; where it is small the next word begins a chunk. A boundary depends on
the sixteen bytes before it only, so an insertion moves no boundary but its own. What is compared are windows: neighbouring chunks
that just add up to ``min_words`` words, by a 96-bit digest of their sequence. The first occurrence of a window (smallest
doc_id, then the row's key, then place) stays, later ones are cut out; how rows are dealt to tasks changes nothing. So a passage is cut only where the same sequence of chunks stands in one place
before, and phrases that stand here and there stay.

Texts are cut once, and their chunks' digests are written to a scratch table; windows are made from it on the way. A task
deduplicates blocks of a million windows by itself first. So a window, however common, leaves a block once, and what
meets by digest is spread evenly, over as many tasks as the table's bytes ask for; it travels in packed arrays, with a document's
number once for all its windows that go to one task and places as differences. What a block knows of its documents travels along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, scratch, ship, stage, table, unstage

#: Mean bytes between boundaries; bytes without a word's end after which a boundary falls inside a word; words that a passage
#: must repeat to be cut out.
MEAN_BYTES, LONGEST_WORD, MIN_WORDS = 20, 256, 20
BLOCK_CHUNKS, BUCKET_CHUNKS = 1 << 20, 1 << 19


def gear(seed: int = 0x5EED) -> np.ndarray:
    """A random number for each byte value."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(48)).astype(np.uint16)


GEAR = gear()


def rolled(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash h = 2 h + gear[byte] at every byte; sixteen shifts push a byte out. Computed by doubling."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint16(shift) if len(h) > shift else 0
    return h


def boundaries(text: bytes, mean: int = MEAN_BYTES) -> list[int]:
    """Chunk starts and the text's end: 0, and each word's start that follows a small hash with no other word's start between; in a
    long stretch without white space, the character's start that follows."""
    if not text:
        return [0]
    data = np.frombuffer(text, np.uint8)
    hits = np.flatnonzero(rolled(data) < 65536 // mean)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    after = np.append(starts, len(data))[np.searchsorted(starts, hits, side="right")]
    far = after - hits > LONGEST_WORD
    if far.any():
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.append(begin, len(data))[np.searchsorted(begin, hits[far], side="right")]
        after[far] = chars
    return np.unique(np.concatenate([[0], after, [len(data)]])).tolist()


def digests(text: bytes, cuts: list[int]) -> np.ndarray:
    """The 64-bit digest of each chunk without the white space around it."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(text[a:b].strip()) for a, b in zip(cuts, cuts[1:], strict=False)), np.uint64, len(cuts) - 1)


def windows(text: bytes, cuts: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first chunks, ends) in order: from each chunk, and up to each chunk, the fewest chunks that have min_words words. Every longer
    passage is covered by windows within it. A text of fewer words is one window."""
    return windows_of(words_before(text, cuts), min_words)


def words_before(text: bytes, cuts: list[int]) -> np.ndarray:
    """The number of words that begin before each boundary."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~space & np.append(True, space[:-1])[: len(data)])
    return np.searchsorted(begins, cuts)


def windows_of(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` from the words before each boundary."""
    n = len(words) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if words[-1] < min_words:
        return np.array([0]), np.array([n])
    end = np.searchsorted(words, words[:-1] + min_words)
    begin = np.searchsorted(words, words[1:] - min_words, side="right") - 1
    first, last = np.flatnonzero(end <= n), np.flatnonzero(begin >= 0)
    both = np.unique(np.concatenate([first * (n + 1) + end[first], begin[last] * (n + 1) + last + 1]))
    return both // (n + 1), both % (n + 1)


#: Odd bases of the polynomials; the second one's upper half checks the first.
BASES = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def window_digests(chunks: np.ndarray, first: np.ndarray, end: np.ndarray, of: int = BASES[0]) -> np.ndarray:
    """The 64-bit digest of each window's sequence of chunk digests: a polynomial modulo 2**64, from sums up to every chunk."""
    with np.errstate(over="ignore"):
        base = np.full(len(chunks), of, np.uint64)
        inverse = np.full(len(chunks) + 1, pow(of, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chunks * np.cumprod(base), dtype=np.uint64)])
        z = (sums[end] - sums[first]) * np.cumprod(inverse)[first]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(31))


def _row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows with the same doc_id apart; rows that repeat doc_id and text are one document. 128 bits, so that no two others meet."""
    spelled = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(spelled, F.lit("\n"), F.coalesce(F.col(text), F.lit("")))))


def packed(values: np.ndarray) -> bytes:
    """Differences of neighbours, the lowest bytes of all first: of numbers that grow by little most bytes are zero, and compress away."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(steps), steps.itemsize).T.tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(kind).ravel(), dtype=kind)


def chunk_digests(docs: DataFrame, mean: int) -> DataFrame:
    """(doc_id, row_key, chunks, words): the digests of a text's chunks and the words before each boundary, packed.
    docs: (doc_id, row_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, words = [], []
            for text in batch.column(2):
                data = text.as_py().encode()
                cuts = boundaries(data, mean)
                chunks.append(digests(data, cuts).astype("<u8").tobytes())
                words.append(packed(words_before(data, cuts).astype("<u4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(chunks, pa.binary()), pa.array(words, pa.binary())], names=["doc_id", "row_key", "chunks", "words"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key binary, chunks binary, words binary")


SCHEMA = "bucket int, block long, digests binary, checks binary, docs binary, ties binary, counts binary, indexes binary, row_key binary, start int, places binary, firsts binary, origins binary"
KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 7, pa.int32(), *[pa.binary()] * 3]


def _rows(columns: list[list], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def blocks_of_chunks(chunks: DataFrame, buckets: int, min_words: int) -> DataFrame:
    """Two sorts of rows, from blocks of up to BLOCK_CHUNKS windows (and a document), numbered in the order of doc_id, key and place:
    the digests of a bucket, each at its first place in the block, with the documents that they stand in and how many of them do in each;
    and, with a row_key and any bucket, a document's first number in the block and its windows that stand before in the block, and where.
    chunks: as ``chunk_digests`` makes them, from files, so that a task that runs again finds the same blocks."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bytes, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block
            block += 1
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            ids = np.array([-(1 << 63) if x[0] is None else x[0] for x in held], np.int64)
            ties = np.array([int.from_bytes(x[1][:4], "big") for x in held], "<u4")
            sizes = np.array([len(x[2]) for x in held])
            starts = np.cumsum(sizes) - sizes
            found, checks, doc = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(found, kind="stable")
            new, other = changes(found[order]), changes(checks[order])
            if (other & ~new).any():  # two windows have one digest
                order = np.lexsort((checks, found))
                new = changes(found[order]) | changes(checks[order])
            first = order[new][np.cumsum(new) - 1]  # of each, where its digest stands first
            out: list[list] = [[] for _ in names]

            def add(*values) -> None:
                for column, value in zip(out, values, strict=True):
                    column.append(value)

            once = np.sort(order[new])
            bucket = (found[once] >> np.uint64(32)) % np.uint64(buckets)
            once = once[np.argsort(bucket, kind="stable")]
            cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1)).tolist()
            for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if x < y:
                    at = once[x:y]
                    begin = np.flatnonzero(changes(doc[at]))
                    of, counts = doc[at[begin]], np.diff(np.append(begin, y - x)).astype("<u4")
                    add(b, block, found[at].tobytes(), checks[at].tobytes(), packed(ids[of].view("<u8")), ties[of].tobytes(), packed(counts), packed(at.astype("<u4")), *[None] * 5)
            again = order[~new]
            by = np.argsort(again)
            again, origin = again[by], first[~new][by]
            where = ids[doc[origin]]
            cuts = np.searchsorted(again, np.append(starts, len(found))).tolist()
            for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                # Any bucket will do; its task only hands this on.
                add((block + i) % buckets, block, *[None] * 6, held[i][1], starts[i], (again[x:y] - starts[i]).astype("<i4").tobytes(), where[x:y].tobytes(), origin[x:y].astype("<i4").tobytes())
            held.clear()
            return _rows(out, KINDS, names)

        for batch in batches:
            for doc_id, row_key, own, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, spans_ = np.frombuffer(own, "<u8"), windows_of(unpacked(words, "<u4").astype(np.int64), min_words)
                held.append((doc_id, row_key, window_digests(own, *spans_), (window_digests(own, *spans_, BASES[1]) >> np.uint64(32)).astype("<u4")))
                size += len(held[-1][2])
                if size >= BLOCK_CHUNKS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return chunks.select("doc_id", "row_key", "chunks", "words").mapInArrow(run, SCHEMA)


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that follow each other with the same first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _numbers(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


#: What goes back to a block: of a bucket's windows, their numbers in the block and where they stand first; and its own rows, with a row_key.
BACK = "block long, a binary, firsts binary, origins binary, row_key binary, start int"


def meet_by_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BACK: of a bucket's digests that several blocks have, all places but the first; a block's own rows as they are."""
    names = [x.split()[0] for x in BACK.split(", ")]
    kinds = [pa.int64(), *[pa.binary()] * 4, pa.int32()]
    for group in _groups(batches):
        if own := [r for r in group if r[8] is not None]:
            yield _rows([[r[k] for r in own] for k in (1, 10, 11, 12, 8, 9)], kinds, names)
        rows = [r for r in group if r[8] is None]
        if not rows:
            continue
        found, checks = (_numbers([r[k] for r in rows], kind) for k, kind in ((2, "<u8"), (3, "<u4")))
        counts = np.concatenate([unpacked(r[6], "<u4") for r in rows])
        doc, tie = np.repeat(np.concatenate([unpacked(r[4], "<u8") for r in rows]).view("<i8"), counts), np.repeat(_numbers([r[5] for r in rows], "<u4"), counts)
        index = np.concatenate([unpacked(r[7], "<u4") for r in rows]).view("<i4")
        block = np.repeat(np.array([r[1] for r in rows]), [len(r[3]) // 4 for r in rows])
        order = np.argsort(found, kind="stable")
        new = changes(found[order])
        at = order[~new | ~np.append(new[1:], True)]
        at = at[np.lexsort((index[at], block[at], tie[at], doc[at], checks[at], found[at]))]
        new = changes(found[at]) | changes(checks[at])
        first = doc[at[new]][np.cumsum(new) - 1] if len(at) else doc[at]
        later, where = at[~new], first[~new]
        by = np.argsort(block[later], kind="stable")
        later, where = later[by], where[by]
        numbers, cuts = np.unique(block[later], return_index=True)
        ends = [*cuts.tolist(), len(later)]
        parts = [(index[later[x:y]].tobytes(), where[x:y].tobytes()) for x, y in zip(ends, ends[1:], strict=False)]
        yield _rows([numbers.tolist(), [p[0] for p in parts], [p[1] for p in parts], *[[None] * len(parts)] * 3], kinds, names)


def back_to_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, n, places, firsts) of each of a block's documents, also of those without repeated windows."""
    for rows in _groups(batches):
        far = [r for r in rows if r[4] is None]
        docs = sorted((r for r in rows if r[4] is not None), key=lambda r: r[5])
        index, where = _numbers([r[1] for r in far], "<i4"), _numbers([r[2] for r in far], "<i8")
        by = np.argsort(index)
        index, where = index[by], where[by]
        cuts = [*np.searchsorted(index, [r[5] for r in docs]).tolist(), len(index)]
        out: list[list] = [[], [], [], []]
        for r, x, y in zip(docs, cuts, cuts[1:], strict=False):
            own, origins = _numbers([r[2]], "<i8").copy(), _numbers([r[3]], "<i4")
            if len(index):  # what stands first in the block may stand before in another
                at = np.minimum(np.searchsorted(index, origins), len(index) - 1)
                own = np.where(index[at] == origins, where[at], own)
            places, firsts = np.concatenate([_numbers([r[1]], "<i4"), index[x:y] - r[5]]), np.concatenate([own, where[x:y]])
            by = np.argsort(places)
            for column, value in zip(out, (r[4], len(places), places[by].astype("<i4").tobytes(), firsts[by].tobytes()), strict=True):
                column.append(value)
        yield _rows(out, [pa.binary(), pa.int64(), pa.binary(), pa.binary()], ["row_key", "n", "places", "firsts"])


def repeated_windows(docs: DataFrame, mean: int = MEAN_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """A staged table of (row_key, places, firsts): packed numbers of a document's windows that stand before it elsewhere, and doc_ids where they do.
    docs: (doc_id, row_key, text), texts not empty. Null doc_ids come first. Rows of one row_key are one document: of their results the
    one with the fewest repeats holds."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, blocks = max(8, total // mean // BUCKET_CHUNKS), max(8, total // mean // BLOCK_CHUNKS)
    path = scratch(spark)
    rows = blocks_of_chunks(stage(chunk_digests(docs, mean), path), buckets, min_words)
    # A bucket is a task's whole input, and the number of buckets and blocks grows with the table, so tasks don't.
    both = rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet_by_digest, BACK)
    found = both.repartition(2 * blocks, "block").sortWithinPartitions("block").mapInArrow(back_to_documents, "row_key binary, n long, places binary, firsts binary")
    found = stage(found.groupBy("row_key").agg(F.min(F.struct("n", "places", "firsts")).alias("found")).where("found.n > 0").select("row_key", "found.places", "found.firsts"))
    unstage(spark, path)
    return found


def spans(text: bytes, cuts: list[int], repeated: dict[int, int], min_words: int) -> list[tuple[int, int, list[int]]]:
    """(begin, end, doc_ids where its windows stand) in bytes of each run of chunks that repeated windows cover."""
    first, end = windows(text, cuts, min_words)
    out: list[tuple[int, int, set[int]]] = []
    for place in sorted(repeated):
        a, b = cuts[first[place]], cuts[end[place]]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] | {repeated[place]})
        else:
            out.append((a, b, {repeated[place]}))
    return [(a, b, sorted(ids - {-(1 << 63)})) for a, b, ids in out]


def cut_repeats(docs: DataFrame, mean: int = MEAN_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with ``text`` less its repeated passages, n_removed (code points) and removed, an array of (begin, end, first_doc_ids)
    in code points of the text before.

    A passage counts where neighbouring chunks of ``min_words`` words stand in the same sequence in another document, or further up,
    before; and a whole text of fewer words that is another's whole text, or a window of it. Rows that repeat doc_id and text keep a row each with the same result. A null text stays null and an
    empty one empty; a text of white space only is a chunk like any other. The other columns are kept, but for such as are
    named n_removed or removed.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), "text").where("text is not null and text <> ''")
    found = repeated_windows(keyed, mean, min_words)
    full, names = hidden(docs)
    joined = full.withColumn("_key", _row_key(names["doc_id"], names["text"])).join(found, F.col("_key") == found["row_key"], "left")
    others = [c for c in full.columns if c != names["text"]]
    packed = joined.select(names["text"], "places", "firsts", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, places, firsts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text, places = text.as_py(), places.as_py()
                cut: list = []
                if text and places:
                    data = text.encode()
                    stands = dict(zip(_numbers([places], "<i4").tolist(), _numbers([firsts.as_py()], "<i8").tolist(), strict=True))
                    cut = spans(data, boundaries(data, mean), stands, min_words)
                if not cut:
                    texts.append(text)
                    counts.append(0)
                    removed.append([])
                    continue
                kept, shown, at, chars = [], [], 0, 0
                for begin, end, where in cut:
                    piece = data[at:begin].decode()
                    kept.append(piece)
                    chars += len(piece)
                    size = len(data[begin:end].decode())
                    shown.append({"begin": chars, "end": chars + size, "first_doc_ids": where})
                    chars, at = chars + size, end
                kept.append(data[at:].decode())
                texts.append("".join(kept))
                counts.append(len(text) - len(texts[-1]))
                removed.append(shown)
            arrays = [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, kind)]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[3:]], names=[names["text"], "n_removed", "removed", *others])

    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("first_doc_ids", pa.list_(pa.int64()))]))
    rest = "".join(f", {f.name} {f.dataType.simpleString()}" for f in packed.schema.fields[3:])
    result = packed.mapInArrow(run, f"{names['text']} string, n_removed long, removed array<struct<begin: long, end: long, first_doc_ids: array<long>>>" + rest)
    return result.select(*(F.col(new).alias(old) for old, new in names.items() if old not in ("n_removed", "removed")), "n_removed", "removed")


def op5_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text without repeated passages, n_removed, removed."""
    return cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
