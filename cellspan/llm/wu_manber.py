"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words: each distinct word of the test strings has a number, any
other word is 0.  All patterns of one length form a group with a shift table over
blocks of two words (one word in the group of length one): the entry says how far
the window may move when it ends in that block.  Where it is zero, the patterns in
the bucket of that block (the suffix hash) are compared with the text directly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, durable, slices

WINDOW = 8
#: Words of a passage of one item that make a leak.
MIN_RUN = 13
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 20
#: Lower-cases A-Z, keeps digits, letters and all non-ASCII bytes, blanks the rest.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Distinct windows of an item: runs of ``window`` words, or all words if fewer."""
    w = words_of(text)
    return list(dict.fromkeys(tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1)))) if w else []


class WuManber:
    """Search for the windows of (item key, text) pairs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = defaultdict(list)
        self.keys: list[str] = []
        self.sizes: list[int] = []
        self.lengths: list[int] = []
        #: the windows of an item in order, as word numbers
        self.order: list[list[tuple[int, ...]]] = []
        self.window = window
        for key, text in items:
            found = item_windows(text, window)
            for w in found:
                owners[tuple(self.number.setdefault(x, len(self.number) + 1) for x in w)].append(len(self.keys))
            self.keys.append(key)
            self.sizes.append(len(found))
            self.order.append(self._sequence(words_of(text), window))
            self.lengths.append(len(words_of(text)))
        self.base = len(self.number) + 1
        self.groups = []
        for length in sorted({len(p) for p in owners}):
            block = min(2, length)
            shift: dict[int, int] = {}
            bucket: dict[int, list[tuple[tuple[int, ...], list[int]]]] = defaultdict(list)
            for pattern, own in owners.items():
                if len(pattern) != length:
                    continue
                for end in range(block, length + 1):
                    code = self._code(pattern[end - block : end])
                    shift[code] = min(shift.get(code, length), length - end)
                bucket[self._code(pattern[length - block :])].append((pattern, own))
            self.groups.append((length, block, shift, dict(bucket)))

    def _sequence(self, words: list[bytes], window: int) -> list[tuple[int, ...]]:
        ids = [self.number[w] for w in words]
        return [tuple(ids[i : i + window]) for i in range(max(1, len(ids) - window + 1))] if ids else []

    def runs(self, at: dict[int, tuple[int, ...]], hit: dict[int, set[tuple[int, ...]]]) -> dict[int, int]:
        """By item the words of the longest passage that text and item have in common.

        ``at``: windows hit by word position.  A passage goes on where the next window
        of the item starts at the next word of the text.
        """
        out: dict[int, int] = {}
        for item in hit:
            places: dict[tuple[int, ...], list[int]] = defaultdict(list)
            for i, pattern in enumerate(self.order[item]):
                places[pattern].append(i)
            best, last, before = 0, -2, {}
            for start in sorted(at):
                here = {i: (before.get(i - 1, 0) if start == last + 1 else 0) + 1 for i in places.get(at[start], ())}
                best = max([best, *here.values()])
                before, last = here, start
            length = min(self.window, self.lengths[item])
            out[item] = best + length - 1 if best else 0
        return out

    def _code(self, words) -> int:
        code = 0
        for w in words:
            code = code * self.base + w
        return code

    def numbers(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; long texts are split piece by piece."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
        get, parts, at = self.number.get, [], 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            while end < len(data) and data[end] != 32:
                end += 1
            words = data[at:end].split()
            parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], dict[int, int], dict[int, int]]:
        """(words, merged hit spans of word positions, distinct windows hit and longest common passage by item)."""
        ids = self.numbers(text)
        n, spans = len(ids), []
        hit: dict[int, set[tuple[int, ...]]] = defaultdict(set)
        passages: dict[int, int] = {}
        for length, block, shift, bucket in self.groups:
            if n < length:
                continue
            codes = (ids if block == 1 else ids[:-1] * self.base + ids[1:]).tolist()
            # codes[j] is the block that ends at word j + block - 1
            last, j, far = len(codes), length - block, length - block + 1
            get, listed = shift.get, ids.tolist()
            at: dict[int, tuple[int, ...]] = {}
            found: dict[int, set[tuple[int, ...]]] = defaultdict(set)
            while j < last:
                move = get(codes[j], far)
                if move:
                    j += move
                    continue
                start = j + block - length
                view = tuple(listed[start : start + length])
                for pattern, own in bucket[codes[j]]:
                    if pattern == view:
                        spans.append((start, start + length))
                        at[start] = pattern
                        for item in own:
                            found[item].add(pattern)
                        break
                j += 1
            # all windows of an item have one length
            passages |= self.runs(at, found)
            hit |= found
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(merged[-1][1], b)
            else:
                merged.append((a, b))
        return n, merged, {k: len(v) for k, v in hit.items()}, passages


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_ITEMS = pa.list_(pa.struct([("item", pa.string()), ("hit", pa.int32()), ("windows", pa.int32()), ("words", pa.int32()), ("run", pa.int32())]))
_SCHEMA = "n_words long, spans array<struct<begin:int,end:int>>, items array<struct<item:string,hit:int,windows:int,words:int,run:int>>"


def _pass(rows: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(WuManber(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for piece in slices(batches):
            n, spans, found = [], [], []
            for text in piece.column("text").to_pylist():
                words, merged, hit, passages = search.search(text)
                n.append(words)
                spans.append([{"begin": a, "end": b} for a, b in merged])
                found.append([{"item": search.keys[i], "hit": c, "windows": search.sizes[i], "words": search.lengths[i], "run": passages[i]} for i, c in sorted(hit.items())])
            yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(found, _ITEMS)], ["key", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {_SCHEMA}")


def find_contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BROADCAST_BYTES // 8
) -> DataFrame:
    """Occurrences of test-set windows in whole documents.

    Returns one row per input row: key, n_words, ``spans`` (maximal runs of word
    positions inside occurrences), ``items`` (item key as text, distinct windows hit,
    windows of the item, words of the item, words of the longest passage in common).  Null or empty texts have no words; items without words
    match nothing; items of fewer than ``window`` words are one window; repeated
    items are kept by key, repeated documents give repeated rows.

    The test set is sent to the tasks in blocks of at most ``block_bytes`` of text.
    Several blocks mean several passes over the documents, each joined to the others
    by a row number that a written table fixes; nothing is left out.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    blocks: list[list[tuple[str, str | None]]] = [[]]
    held, result = 0, None
    wanted = items.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).cast("string").alias("t")).where("t is not null").dropDuplicates()
    done = []

    def flush(base: DataFrame) -> None:
        done.append(durable(_pass(base, blocks[-1], window), "occurrences"))
        blocks[-1] = []

    several = None
    for r in wanted.toLocalIterator(prefetchPartitions=False):
        size = len(r["t"].encode("utf-8", "surrogatepass"))
        if blocks[-1] and held + size > block_bytes:
            if several is None:
                numbered = rows.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("key").alias("id")).alias("key"), "text")
                several = durable(numbered, "numbered")
            flush(several)
            held = 0
        blocks[-1].append((r["k"] if r["k"] is not None else "", r["t"]))
        held += size
    if several is None:
        return _pass(rows, blocks[-1], window).withColumnRenamed("key", key)
    flush(several)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    merged = result.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    union = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<begin:int,end:int>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["begin"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    # an item repeated under one key may sit in two blocks: its windows are not added up
    return merged.select(F.col("key.id").alias(key), "n_words", union.alias("spans"), "items")


def contamination_verdict(found: DataFrame, min_run: int = MIN_RUN, min_words: int = WINDOW) -> DataFrame:
    """Add n_hit, item_keys (sorted, distinct), n_items, cover and leaked.

    ``cover`` is the largest share of an item's windows that occur.  A document is
    ``leaked`` with a passage of ``min_run`` words of one item, with the whole of an item
    of at least ``min_words``, or with windows of two such items: however long the item,
    and never for items of fewer words alone.
    """
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    keys = F.array_sort(F.array_distinct(F.transform("items", lambda i: i["item"])))
    cover = F.coalesce(F.array_max(F.transform("items", lambda i: i["hit"] / i["windows"])), F.lit(0.0))
    long = F.filter("items", lambda i: i["words"] >= min_words)
    several = F.size(F.array_distinct(F.transform(long, lambda i: i["item"]))) >= 2
    passage = F.exists(long, lambda i: (i["run"] >= min_run) | (i["run"] >= i["words"]))
    out = found.withColumns({"n_hit": hits, "item_keys": keys, "n_items": F.size(keys).cast("long"), "cover": cover})
    return out.withColumn("leaked", several | passage)
