"""SentencePiece encoding and decoding that keeps the original byte span of every piece.

The model file gives the pieces and the compiled character map, a double-array trie of prefixes with their
replacements. Normalisation takes the longest prefix in the map at each place and records, for every normalised byte, the
original byte that it stands for; so every piece projects to original bytes. Merging by scores runs on stretches
that no piece crosses: a piece never has a word-boundary sign behind another character. Their segmentations are
kept, so a word is merged once.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches whose segmentation is kept, per worker; the store is emptied when full.
KEPT = 800_000
#: Characters of a stretch above which its segmentation isn't kept.
LONGEST_KEPT = 64
NO_PAIR = 1 << 40


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


def shared(path: str) -> "Model":
    """The model of this path; a worker that runs several tasks keeps it."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


_MODELS: dict = {}


class CharacterMap:
    """The compiled map: its trie finds the longest prefix of a text; the replacement ends at a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.replacements = blob[4 + size :] if size else b""
        #: For each byte, whether a prefix in the map begins with it.
        self.begins = np.array([bool(self.units) and self._step(self._offset(self.units[0]), b) is not None for b in range(256)])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, place: int, byte: int) -> int | None:
        """The place of the trie's node below, or None."""
        place ^= byte
        return place if self.units[place] & 0x800000FF == byte else None

    def matches(self, data: bytes) -> list[tuple[int, int, bytes]]:
        """(place, bytes consumed, replacement) of the longest prefixes, from left to right. Only places with a byte that begins one are
        looked at, and one within a match isn't."""
        out, after = [], 0
        for at in np.flatnonzero(self.begins[np.frombuffer(data, np.uint8)]).tolist() if self.units else ():
            if at >= after and (found := self.longest(data, at)):
                out.append((at, *found))
                after = at + found[0]
        return out

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest prefix in the map."""
        if not self.units:
            return None
        units, found = self.units, None
        place: int | None = self._offset(units[0])
        for i in range(at, len(data)):
            place = self._step(place, data[i])
            if place is None:
                break
            unit = units[place]
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("a BPE model is needed")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix, self.trims, self.escapes = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.end = self.pieces.index("</s>")
        whole = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER_DEFINED]
        if whole or UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not provided for")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a word boundary")
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.kept: dict[str, bytes] = {}
        self.by_rank = np.array(sorted(self.ids.values(), key=lambda i: (-self.scores[i], i)), np.int64)
        rank = {self.pieces[i]: k for k, i in enumerate(self.by_rank.tolist())}
        self.characters = np.full(0x110000, -1, np.int64)
        pairs = []
        for p, i in self.ids.items():
            if len(p) == 1:
                self.characters[ord(p)] = i
            pairs += [(self.ids[p[:k]] * len(self.pieces) + self.ids[p[k:]], rank[p]) for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        pairs.sort()
        self.pairs, self.ranks = np.array([x for x, _ in pairs], np.int64), np.array([x for _, x in pairs], np.int64)
        self.sizes, self.spelled = np.array([len(p.encode()) for p in self.pieces], np.int64), np.full(len(self.pieces), -1, np.int64)
        self.spelled[list(self.bytes.values())] = list(self.bytes.keys())
        self.plain = {i: p.replace(SPACE, " ") for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.parts: dict[str, list] = {}

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for every byte of it and its end, the original byte that it stands for. The longest prefix in the
        character map is replaced at each place; what no prefix begins stands for itself."""
        data = text.encode()
        found = self.map.matches(data)
        if not found and not self.trims and self.escapes:  # spaces become signs, and a sign is put before the text
            wide = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            normal, source = text.replace(" ", SPACE), np.append(np.repeat(np.arange(len(data)), wide), len(data))
            return (SPACE + normal, np.append([0, 0, 0], source)) if self.prefix and text else (normal, source)
        chunks, at = [], 0
        for place, size, what in [*found, (len(data), 0, b"")]:
            while at < place:
                wide = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                chunks.append((at, data[at : at + wide]))
                at += wide
            if size:
                chunks.append((place, what))
                at = place + size
        out, source = bytearray(), []
        if self.trims:
            while chunks and chunks[0][1].strip(b" ") == b"":
                chunks.pop(0)
        sign = SPACE.encode() if self.escapes else b" "
        end = len(data)

        def put(what: bytes, where: int) -> None:
            out.extend(what)
            source.extend([where] * len(what))

        if not chunks:
            return "", np.zeros(1, np.int64)
        if self.prefix:
            put(sign, chunks[0][0])
        blank = self.trims
        for where, what in chunks:
            if blank:
                what = what.lstrip(b" ")
            for i in range(len(what)):
                put(sign if what[i] == 32 else what[i : i + 1], where)
            if what:
                blank = self.trims and what.endswith(b" ")
        if self.trims:
            while out.endswith(sign) and len(out) >= len(sign):
                end = source[len(out) - len(sign)]
                del out[-len(sign) :], source[-len(sign) :]
        return out.decode(), np.array([*source, end])

    def merge(self, stretch: str) -> list[tuple[str, int]]:
        """(piece, id) of a stretch: the pair of the highest score merges first, the leftmost of equals.

        A merged symbol is a piece, so no merge crosses two characters that are neighbours in no piece: the stretch is
        cut there first, and a cut part that was met before isn't merged again."""
        out, begin, parts, joints = [], 0, self.parts, self.joints
        for at in range(1, len(stretch) + 1):
            if at == len(stretch) or stretch[at - 1 : at + 1] not in joints:
                part = stretch[begin:at]
                found = parts.get(part)
                if found is None:
                    found = self._merge_part(part)
                    if len(part) <= 32:
                        if len(parts) >= KEPT:
                            parts.clear()
                        parts[part] = found
                out += found
                begin = at
        return out

    def _merge_part(self, part: str) -> list[tuple[str, int]]:
        symbols, ids, scores = list(part), self.ids, self.scores
        if len(symbols) <= 24:
            none = float("-inf")
            pairs = [scores[i] if (i := ids.get(a + b)) is not None else none for a, b in zip(symbols, symbols[1:], strict=False)]
            while pairs:
                best = max(pairs)
                if best == none:
                    break
                k = pairs.index(best)
                symbols[k : k + 2] = [joined := symbols[k] + symbols[k + 1]]
                del pairs[k]
                if k:
                    pairs[k - 1] = scores[i] if (i := ids.get(symbols[k - 1] + joined)) is not None else none
                if k < len(pairs):
                    pairs[k] = scores[i] if (i := ids.get(joined + symbols[k + 1])) is not None else none
        else:
            symbols = self._merge_long(symbols)
        out = []
        for s in symbols:
            i = ids.get(s)
            out += [(s, i)] if i is not None else [(s, self.bytes[b]) for b in s.encode()] if self.bytes else [(s, self.unknown)]
        return out

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap, for parts of any length."""
        ids, scores = self.ids, self.scores
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := ids.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-scores[i], a, b, symbols[a] + symbols[b]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]

    def encode(self, text: str, end: bool = False) -> list[int]:
        return self.encode_many([text], end)[0][0].tolist()

    def encode_many(self, texts: list[str], end: bool = True) -> list[tuple[np.ndarray, np.ndarray, str]]:
        """Of each text: its ids, (n, 2) begins and ends of its pieces in bytes of the original text, and the decoded ids. The end id, if
        wanted, stands at the text's end. Each byte of a character that is spelled in bytes has the span of the character.

        Segmentation goes by stretches: no piece and no character's bytes lie in two. Those not met before are merged together."""
        normal = [self.normalize(t) for t in texts]
        split = [self.stretch.findall(t) for t, _ in normal]
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = list(set().union(*split) - self.kept.keys()) if self.bytes else []
        if new:
            self.segment_many(new)
        get, out = self.kept.__getitem__, []
        for stretches, (_, source) in zip(split, normal, strict=True):
            if self.bytes:
                ids = np.frombuffer(b"".join(map(get, stretches)), "<i4")
                sizes, steps = self.walked(ids)
            else:
                ids, sizes = self.with_unknown(stretches)
                steps = sizes
            begin = np.cumsum(steps) - steps
            text = self._decode(ids.tolist())
            spans = np.stack([source[begin], source[begin + sizes]], axis=1)
            if end:
                ids, spans = np.append(ids, np.int32(self.end)), np.append(spans, np.full((1, 2), source[-1]), axis=0)
            if stretches and (self.prefix or self.trims) and stretches[0].startswith(SPACE):
                text = text[1:]  # the sign put before the text
            out.append((ids, spans, text))
        for stretch in new:
            if len(stretch) > LONGEST_KEPT:
                del self.kept[stretch]
        return out

    def walked(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece, the normalised bytes that it covers, and those from its begin to the next piece's. The pieces that spell a
        character in bytes cover all of it, and the last of them leads on."""
        sizes = self.sizes[ids]
        at = np.flatnonzero(self.spelled[ids] >= 0)
        if not len(at):
            return sizes, sizes
        steps, value, place = sizes.copy(), self.spelled[ids[at]], np.arange(len(at))
        first = np.maximum.accumulate(np.where((value & 0xC0) != 0x80, place, 0))
        wide = np.select([value < 0x80, value < 0xE0, value < 0xF0], [1, 2, 3], 4)[first]
        sizes[at], steps[at] = wide, np.where(place - first == wide - 1, wide, 0)
        return sizes, steps

    def with_unknown(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bytes that they cover) of a model without byte pieces: neighbouring unknown characters are one piece."""
        merged = [x for s in stretches for x in self.merge(s)]
        ids, sizes = np.array([i for _, i in merged], np.int32), np.array([len(p.encode()) for p, _ in merged], np.int64)
        if not len(ids):
            return ids, sizes
        starts = np.flatnonzero((ids != self.unknown) | np.append(True, ids[:-1] != self.unknown))
        return ids[starts], np.add.reduceat(sizes, starts)

    def segment_many(self, stretches: list[str]) -> None:
        """Put the stretches' packed ids into the store. Those of up to 20 known characters are merged in step, a row each: the best pair
        of every row merges, its neighbours are looked up anew, until no row has a pair."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        symbols = self.characters[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        known = np.minimum.reduceat(symbols, starts) >= 0
        low = 0
        for high in (8, 12, 20):
            at = np.flatnonzero(known & (sizes > low) & (sizes <= high))
            low = high
            columns = np.arange(high)
            held = columns < sizes[at, None]
            rows = np.full((len(at), high), -1, np.int64)
            rows[held] = symbols[(starts[at, None] + columns)[held]]
            ranks = self.pair_ranks(rows[:, :-1], rows[:, 1:])
            alive = np.arange(len(at))
            while len(alive):
                r = ranks[alive]
                j = r.argmin(axis=1)
                best = r[np.arange(len(alive)), j]
                some = best < NO_PAIR
                alive, j, best, r = alive[some], j[some], best[some], r[some]
                if not len(alive):
                    break
                i = np.arange(len(alive))
                s = np.take_along_axis(rows[alive], np.minimum(columns + (columns > j[:, None]), high - 1), axis=1)
                s[:, -1] = -1
                s[i, j] = self.by_rank[best]
                r = np.take_along_axis(r, np.minimum(columns[:-1] + (columns[:-1] >= j[:, None]), high - 2), axis=1)
                r[:, -1] = NO_PAIR
                r[i, j] = self.pair_ranks(s[i, j], s[i, j + 1])
                k = np.flatnonzero(j)
                r[k, j[k] - 1] = self.pair_ranks(s[k, j[k] - 1], s[k, j[k]])
                rows[alive], ranks[alive] = s, r
            held = rows >= 0  # a row's pieces stand at its left
            packed, ends = rows[held].astype("<i4").tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()
            for n, x, y in zip(at.tolist(), [0, *ends], ends, strict=False):
                self.kept[stretches[n]] = packed[x:y]
        for n in np.flatnonzero(~known | (sizes > low)).tolist():
            self.kept[stretches[n]] = np.array([i for _, i in self.merge(stretches[n])], "<i4").tobytes()

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that two pieces join to, the highest score first; NO_PAIR if they don't, or one is -1."""
        wanted = a * len(self.pieces) + b
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where((self.pairs[at] == wanted) & (a >= 0) & (b >= 0), self.ranks[at], NO_PAIR)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of every piece in bytes of the original text."""
        ids, spans, _ = self.encode_many([text], end=False)[0]
        return [(i, *s) for i, s in zip(ids.tolist(), spans.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, byte pieces join to characters (a bad byte gives U+FFFD), the sign put before the
        text goes."""
        text = self._decode(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        cut = first is not None and self.kinds[first] == NORMAL and (self.prefix or self.trims) and self.pieces[first].startswith(SPACE)
        return text[1:] if cut else text

    def _decode(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except KeyError:
            pass  # there are pieces other than normal ones
        out, held = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_bytes_to_text(bytes(held)))
                held.clear()
            if kind != CONTROL:
                out.append(self.unk_surface if kind == UNKNOWN else self.pieces[i].replace(SPACE, " "))
        if held:
            out.append(_bytes_to_text(bytes(held)))
        return "".join(out)


def _bytes_to_text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids array<int> with the end id, spans and decoded, the text that the ids stand for. spans: the begin
    and end of every id's piece in bytes of the text, packed as little-endian unsigned 32-bit numbers.

    A null text counts as an empty one, whose only id is the end. Repeated rows keep a row each; other columns are not read; no
    documents give no rows."""
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(path)
        for batch in batches:
            found = model.encode_many([t or "" for t in batch.column(1).to_pylist()])
            starts = np.cumsum([0, *(len(ids) for ids, _, _ in found)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _, _ in found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
            spans = pa.array([x.astype("<u4").tobytes() for _, x, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, spans, pa.array([t for _, _, t in found], pa.string())], names=["doc_id", "ids", "spans", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, spans binary, decoded string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, and, as a further column, that of the packed spans."""
    rows = encode_documents(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))
