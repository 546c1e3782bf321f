"""SentencePiece BPE encoding with source offsets, and decoding.

The model file is parsed here; the text is normalised by longest-prefix lookup in
the model's compiled character map, and every normalised byte remembers the source
byte it came from.  BPE merges run on the normalised text, and each piece is
projected back to a span ``[begin, end)`` of bytes of the original text.

Pieces never contain a space mark after another character in models trained with
``split_by_whitespace``, so a merge cannot cross such a boundary; text is cut there
and the encoding of each distinct segment is kept in a bounded table.  A model whose
pieces do cross such boundaries is encoded whole.
"""

from __future__ import annotations

import bisect
import gc
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_TABLES, int_lists, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments whose encoding a worker keeps.
CACHE_ENTRIES = 150_000
_NEVER = 1 << 60
#: Longest segment merged in bulk, and how many segments one bulk holds.
BULK_LENGTH, BULK_SEGMENTS = 32, 16_384
_NO_PAIR = 1 << 30


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at, end = 0, len(data)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, i
            shift += 7

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class CharsMap:
    """The compiled character map: a double-array trie and the replacements."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data[at:]`` starts with, and its replacement."""
        units, best = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class PairTable:
    """Pairs of symbols that merge, as an open hash table that numpy can probe.

    Symbols are the pieces and the characters of pieces, numbered; the last number
    stands for every other character, which merges with nothing.
    """

    def __init__(self, ids: dict[str, int], rank: dict[str, int]):
        symbols = sorted({*ids, *(c for p in ids for c in p)})
        number = {s: i for i, s in enumerate(symbols)}
        self.other = len(symbols)
        self.id_of = np.array([ids.get(s, -1) for s in symbols] + [-1], np.int32)
        self.size_of = np.array([len(s.encode()) for s in symbols] + [0], np.int32)
        self.rank_of = np.array([rank.get(s, 0) for s in symbols] + [0], np.int32)
        self.char = np.full(0x110000, self.other, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        pairs = {}
        for p in ids:
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = number[p]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slots = self._slot(keys) if len(keys) else keys
        while len(keys):
            # of the keys at one free slot the last written stays, the others move on
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, or -1."""
        keys = a.astype(np.int64) << 20 | b
        slots = self._slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[todo]]
            same = there == keys[todo]
            out[todo[same]] = self.values[slots[todo[same]]]
            todo = todo[~same & (there >= 0)]
        return out

    def merge_all(self, segments: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, alive), each [position, segment], after all merges.

        Every step merges in each segment the pair of the lowest rank, the leftmost
        among equals, as one segment after the other would be merged.
        """
        n = len(segments)
        points = np.frombuffer("".join([s.ljust(width, "\0") for s in segments]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = np.ascontiguousarray(self.char[points].reshape(n, width).T)
        alive = np.arange(width)[:, None] < np.array([len(s) for s in segments])[None, :]
        sym[~alive] = self.other
        # one more position at the end, which nothing merges with, closes every chain
        sym = np.concatenate([sym, np.full((1, n), self.other, np.int32)]).reshape(-1)
        alive = np.concatenate([alive, np.zeros((1, n), bool)]).reshape(-1)
        after = np.repeat(np.minimum(np.arange(1, width + 2, dtype=np.int32), width), n)
        before = np.repeat(np.arange(-1, width, dtype=np.int32), n)
        into = np.full((width + 1) * n, -1, np.int32)
        into[: width * n] = self.merged(sym[: width * n], sym[n:])
        order = np.full((width + 1) * n, _NO_PAIR, np.int32)
        some = np.flatnonzero(into >= 0)
        order[some] = self.rank_of[into[some]] * 64 + some // n

        def renew(at: np.ndarray, pos: np.ndarray, right: np.ndarray) -> None:
            found = self.merged(sym[at], sym[right])
            into[at] = found
            order[at] = np.where(found >= 0, self.rank_of[found] * 64 + pos, _NO_PAIR)

        while True:
            best = order.reshape(width + 1, n).min(axis=0)
            col = np.flatnonzero(best < _NO_PAIR)
            if not len(col):
                return sym.reshape(width + 1, n), alive.reshape(width + 1, n)
            pos = best[col] & 63
            at = pos * n + col
            gone = after[at] * n + col
            sym[at] = into[at]
            alive[gone] = False
            order[gone] = _NO_PAIR
            follow = after[gone]
            after[at] = follow
            right = follow * n + col
            before[right] = pos
            renew(at, pos, right)
            has = before[at] >= 0
            left = before[at][has]
            renew(left * n + col[has], left, at[has])


class PieceModel:
    """A parsed BPE model: pieces, scores, normalisation and the two codecs."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        charsmap = b""
        self.dummy_prefix, self.trim, self.escape = True, True, True
        unk_surface, kind, self.byte_fallback, suffix = " ⁇ ", 1, False, 0
        for field, value in _fields(data):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0])
                self.types.append(d.get(3, NORMAL))
            elif field == 2:
                d = dict(_fields(value))
                kind, self.byte_fallback = d.get(3, 1), bool(d.get(35, 0))
                unk_surface, suffix = d.get(44, unk_surface.encode()).decode(), d.get(24, 0)
            elif field == 3:
                d = dict(_fields(value))
                charsmap = d.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(d.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or UNUSED in self.types or suffix or not self.escape:
            raise ValueError("only BPE models with escaped, leading space marks and without unused pieces")
        self.charsmap = CharsMap(charsmap) if charsmap else None
        self.unk = self.types.index(UNKNOWN)
        self.unk_surface = unk_surface
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER_DEFINED)}
        # a lower rank merges earlier; equal scores rank equal
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[scores[i]] for p, i in self.ids.items()}
        self.reserved = {p: i for i, p in enumerate(self.pieces) if self.types[i] not in (NORMAL, USER_DEFINED)}
        self.bytes_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        user = sorted((p for p, i in self.ids.items() if self.types[i] == USER_DEFINED), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        longer = [p for p in self.ids if len(p) > 1]
        crossing = any(SPACE in p.lstrip(SPACE) for p in longer)
        alone = "" if "\n" in {c for p in longer for c in p} else "\n"
        self.cut = None if crossing or user else re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + "|\n" * bool(alone))
        self.cache: dict[str, tuple[bytes, bytes, str]] = {}
        self.old = self.cache
        self.pairs = PairTable(self.ids, self.rank) if self.cut else None

    # -- normalisation ---------------------------------------------------------
    def normalize(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text, and for each of its bytes (and its end) the source byte.

        The second is None where bytes map one to one but for spaces, which grow
        from one byte to three.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        if self.charsmap is None and not self.trim and self.user is None:
            return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE), None
        data, out, align = text.encode(), bytearray(), []
        at, mark = 0, SPACE.encode()

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        def step(i: int) -> tuple[int, bytes]:
            if self.user:
                m = self.user.match(data[i:].decode())
                if m:
                    piece = m[0].encode()
                    return len(piece), piece
            hit = self.charsmap.longest(data, i) if self.charsmap else None
            if hit:
                return hit
            n = 1 if data[i] < 128 else 2 if data[i] < 224 else 3 if data[i] < 240 else 4
            return n, data[i : i + n]

        while self.trim and at < len(data):
            n, piece = step(at)
            if piece.strip(b" "):
                break
            at += n
        if at == len(data):
            return "", np.array([at])
        if self.dummy_prefix:
            put(mark, at)
        spaced = self.trim
        while at < len(data):
            n, piece = step(at)
            while spaced and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for byte in re.findall(rb" |[^ ]+", piece):
                    put(mark if byte == b" " else byte, at)
                spaced = self.trim and piece.endswith(b" ")
            at += n
        align.append(len(data))
        while self.trim and out.endswith(mark):
            align[len(out) - 3 :] = [align[len(out) - 3]]
            del out[-3:]
        return out.decode(), np.array(align)

    # -- encoding --------------------------------------------------------------
    def merge(self, symbols: list[str]) -> list[str]:
        """BPE merges in order of score, the leftmost first among equals."""
        if len(symbols) > 64:
            return self._merge_long(symbols)
        get = self.rank.get
        ranks = [get(x + y, _NEVER) for x, y in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            symbols[i] = pair = symbols[i] + symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(pair + symbols[i + 1], _NEVER)
            if i:
                ranks[i - 1] = get(symbols[i - 1] + pair, _NEVER)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and linked neighbours, for long runs."""
        rank = self.rank
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], alive[j] = pair, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := pair + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + pair) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def segment(self, seg: str) -> tuple[bytes, bytes, str]:
        """Ids and byte lengths (int32) of a segment's pieces, and what they decode to."""
        if self.user:
            at, pieces = 0, []
            for m in self.user.finditer(seg):
                pieces += [*self.merge(list(seg[at : m.start()])), m[0]]
                at = m.end()
            pieces += self.merge(list(seg[at:]))
        else:
            pieces = self.merge(list(seg))
        try:
            ids = [self.ids[p] for p in pieces]
            return array("i", ids).tobytes(), array("i", [len(p.encode()) for p in pieces]).tobytes(), seg.replace(SPACE, " ")
        except KeyError:
            ids, sizes = [], []
        for p in pieces:
            i = self.reserved.get(p, self.ids.get(p, self.unk))
            raw = p.encode()
            if i == self.unk and self.byte_fallback:
                # the bytes of one character share its span: all but the last are empty
                ids += [self.byte_id[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            else:
                ids.append(i)
                sizes.append(len(raw))
        return array("i", ids).tobytes(), array("i", sizes).tobytes(), self.pieces_text(ids)

    def _found(self, seg: str) -> tuple[bytes, bytes, str]:
        """A segment that isn't in the young table: from the old one, or encoded now."""
        hit = self.old.get(seg) or self.segment(seg)
        if len(seg) < 200:
            self._keep({seg: hit})
        return hit

    def _keep(self, found: dict[str, tuple[bytes, bytes, str]]) -> None:
        if len(self.cache) >= CACHE_ENTRIES:
            self.old, self.cache = self.cache, {}
        self.cache.update(found)

    def learn(self, segments: set[str]) -> None:
        """Encode the short segments that no table has, many at a time."""
        new = segments.difference(self.cache)
        known = new.intersection(self.old)
        old = self.old
        self._keep({seg: old[seg] for seg in known})
        todo = sorted((seg for seg in new.difference(known) if len(seg) <= BULK_LENGTH), key=len)
        for a in range(0, len(todo), BULK_SEGMENTS):
            part = todo[a : a + BULK_SEGMENTS]
            start = 0
            while start < len(part):
                # neighbours of about equal length share one matrix
                width = min(BULK_LENGTH, -(-len(part[start]) // 4) * 4)
                end = bisect.bisect_right(part, width, start, key=len)
                self._keep(self._bulk(part[start:end], width))
                start = end

    def _bulk(self, segments: list[str], width: int) -> dict[str, tuple[bytes, bytes, str]]:
        table = self.pairs
        sym, alive = table.merge_all(segments, width)
        on = alive.T
        left = sym.T[on]
        ids = table.id_of[left]
        ends = np.cumsum(on.sum(axis=1))
        odd = set(np.searchsorted(ends, np.flatnonzero(ids < 0), side="right").tolist())
        raw, sizes, at, out = ids.tobytes(), table.size_of[left].tobytes(), 0, {}
        for i, (seg, end) in enumerate(zip(segments, (ends * 4).tolist(), strict=True)):
            # characters without a piece of their own take the plain path
            out[seg] = self.segment(seg) if i in odd else (raw[at:end], sizes[at:end], seg.replace(SPACE, " "))
            at = end
        return out

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """:meth:`encode` of every text; segments new to the tables are merged together."""
        if not self.cut:
            return [self.encode(t) for t in texts]
        normal = [self.normalize(t or "") for t in texts]
        parts = [self.cut.findall(norm) for norm, _ in normal]
        self.learn(set().union(*parts))
        return [self._assemble(t, *n, p) for t, n, p in zip(texts, normal, parts, strict=True)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """(ids, begins, ends, decoded text); begins and ends are source bytes."""
        norm, align = self.normalize(text or "")
        return self._assemble(text, norm, align, self.cut.findall(norm) if self.cut else [norm] if norm else [])

    def _assemble(self, text: str | None, norm: str, align: np.ndarray | None, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        get, make = self.cache.get, self._found
        found = [get(seg) or make(seg) for seg in segments]
        ids = np.frombuffer(b"".join([h[0] for h in found]), np.int32)
        ends = np.cumsum(np.frombuffer(b"".join([h[1] for h in found]), np.int32), dtype=np.int64)
        begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
        if align is None:
            begins, ends = self._unescape(norm, text, begins), self._unescape(norm, text, ends)
        elif len(ids):
            begins, ends = align[begins], align[ends]
        out = "".join([h[2] for h in found])
        return ids, begins.astype(np.int32), ends.astype(np.int32), self._lead(out, ids)

    def _unescape(self, norm: str, text: str, at: np.ndarray) -> np.ndarray:
        """Source bytes of normalised bytes where only spaces have been replaced."""
        raw = np.frombuffer((" " if self.dummy_prefix else "").encode() + text.encode(), np.uint8)
        ends = np.cumsum(np.where(raw == 32, 3, 1))
        source = np.searchsorted(ends, at, side="left") + (at > 0)
        return np.maximum(source - self.dummy_prefix, 0)

    # -- decoding --------------------------------------------------------------
    def pieces_text(self, ids) -> str:
        """Text of ids; runs of byte pieces are read as UTF-8, a bad byte as U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            while run:
                n = 1 if run[0] < 128 else 2 if run[0] < 224 else 3 if run[0] < 240 else 4
                try:
                    out.append(bytes(run[:n]).decode())
                except UnicodeDecodeError:
                    n = 1
                    out.append("�")
                del run[:n]

        for i in map(int, ids):
            kind = self.types[i]
            if kind == BYTE:
                run.append(self.bytes_of[i])
                continue
            flush()
            if kind == UNKNOWN:
                out.append(self.unk_surface)
            elif kind != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def _lead(self, out: str, ids) -> str:
        if not len(ids) or self.types[int(ids[0])] in (BYTE, UNKNOWN):
            return out
        if self.trim:
            return out.lstrip(" ") if self.pieces[int(ids[0])].startswith(SPACE) else out
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out

    def decode(self, ids) -> str:
        """What the library's ``decode`` gives for the ids."""
        return self._lead(self.pieces_text(ids), ids)


_models: dict[str, PieceModel] = WORKER_TABLES.setdefault("sentencepiece", {})


def load_model(path: str) -> PieceModel:
    """The parsed model; one per process, so its segment table is kept over batches."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text: key, ids, begins, ends (source byte spans), decoded.

    A null or empty text has no ids and decodes to the empty text.  Rows keep their
    multiplicity, a null key is kept, other columns are left out.  ``model_path`` is
    a vocabulary file that every machine has; it is a parameter.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    fields = "ids array<int>, begins array<int>, ends array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        gc.disable()  # the tables hold no cycles, and walking them costs more than the work
        try:
            for piece in slices(batches, limit=1 << 20, keep="sentencepiece"):
                done = model.encode_all(piece.column("text").to_pylist())
                columns = [int_lists([d[i] for d in done]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([piece.column("key"), *columns, pa.array([d[3] for d in done], pa.string())], ["key", "ids", "begins", "ends", "decoded"])
        finally:
            gc.enable()  # the worker goes on to other tasks

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {fields}")
    return out.withColumnRenamed("key", key)
