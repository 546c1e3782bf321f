"""Exact Jaccard join of documents on word n-grams by T-occurrence search.

A set of shingles is a sorted array of 64-bit numbers.  Equal sets are one class from
the start.  Of the first n - ceil(t n) + l shingles of both sets, in any common order,
two classes that link share l or more.  So a class of whose first shingles fewer than
that are found in other classes links to nothing; the others form candidate groups by
sharing one, and no link leaves its group.  With l in proportion to n, passages that
documents share bring nobody together; the most common shingles come last in the order.

Inside a group, T-occurrence search finds the links: the inverted lists of a query's
shingles are split as DivideSkip does, the short ones are merged, and what occurs often
enough is probed for in the long ones by binary search.  Only components matter, so
pairs that are already connected are not searched for, and groups too large for a task
are cut into blocks: first each block with itself, then the classes outside the
group's largest component against the blocks that share enough of their lists.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, give_back, settle, slices
from .components import connected_components, join_hubs

#: Bits of the table that says which classes are in a candidate group (2 MB).
BITS = 1 << 24
#: Shingles that count as common at most, those of most sampled documents first.
COMMON = 1 << 17
SAMPLE_ONE_IN = 32
#: Classes that a task searches together, and their shingles.
BLOCK_CLASSES = 2000
BLOCK_SHINGLES = 2_000_000
#: Groups cut into blocks that are broadcast at most (16 bytes each).
CUT_GROUPS = 1 << 20
PIVOTS = 4
#: Long lists that are probed before hopeless candidates are dropped.
PROBES = 128
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_words: dict[bytes, int] = {}
_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _word_number(w: bytes) -> int:
    if len(_words) > 150_000:
        _words.clear()
    n = _words[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return n


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit numbers of the ``k``-word shingles of a whole text.

    A-Z is lower-cased, words are runs of non-space; a text of fewer words is one
    shingle, one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    get = _words.get
    ids = np.fromiter((get(w) or _word_number(w) for w in words), np.uint64, len(words))
    n = max(1, len(ids) - k + 1)
    h = np.full(n, len(ids) if len(ids) < k else k, np.uint64)
    for j in range(min(k, len(ids))):
        h = _mix(h * np.uint64(_M[j % len(_M)]) + ids[j : j + n])
    return np.unique(h)


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def need(n: int, num: int, den: int) -> int:
    """Smallest overlap that a set of n elements needs with any set it links to."""
    return -(-num * n // den)


def extra(n: int, num: int, den: int) -> int:
    """First shingles that a set shares with every larger set it links to."""
    return 1 + (den - num) * n // (2 * den)


def first_shingles(s: np.ndarray, common: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of which linked sets share some: rare ones by number, then common."""
    if not len(s):
        return s
    keep = len(s) - need(len(s), num, den) + extra(len(s), num, den)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        order = np.where(common[at] == s, rank[at] + 1, 0)
        s = s[np.lexsort((s, order))]
    return s[:keep]


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class OccurrenceIndex:
    """Inverted lists over sets; ``search`` is T-occurrence search by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], mu: float = 0.02):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.keys, start = np.unique(flat[order], return_index=True)
        self.lists = owner[order]
        self.bounds = np.append(start, len(flat))
        #: list number and owner in one sorted array: what binary probes search in
        self.places = np.repeat(np.arange(len(self.keys)), np.diff(self.bounds)) * len(sets) + self.lists
        self.mu = mu

    def search(self, query: np.ndarray, num: int, den: int, omit=None) -> np.ndarray:
        """Indices of all sets whose Jaccard similarity with the query is num/den or more,
        but for those that ``omit`` (an array of indices to flags) takes out."""
        n = len(query)
        if not n or not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        least = need(n, num, den)
        if len(at) < least:
            return np.zeros(0, np.int64)
        lengths = self.bounds[at + 1] - self.bounds[at]
        at = at[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        # the long lists: as many as pay off, but fewer than the overlap that is asked for
        split = min(least - 1, int(least / (self.mu * math.log2(longest + 1) + 1)))
        short, long = at[: len(at) - split], at[len(at) - split :]
        begin, count = self.bounds[short], self.bounds[short + 1] - self.bounds[short]
        spread = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        found, counts = np.unique(self.lists[spread], return_counts=True)
        size = self.sizes[found]
        # den * overlap >= num * union, with union = n + size - overlap
        asked = -(-num * (n + size) // (num + den))
        ok = (counts >= asked - len(long)) & (size * den >= num * n) & (n * den >= num * size)
        if omit is not None:
            ok &= ~omit(found)
        found, counts, asked = found[ok], counts[ok], asked[ok]
        for i in range(0, len(long), PROBES):
            if not len(found):
                break
            # binary probes of all candidates in a run of long lists
            part = long[i : i + PROBES]
            probe = part[:, None] * len(self.sizes) + found[None, :]
            at_probe = np.minimum(np.searchsorted(self.places, probe), len(self.places) - 1)
            counts = counts + (self.places[at_probe] == probe).sum(axis=0)
            ok = counts >= asked - (len(long) - i - len(part))
            found, counts, asked = found[ok], counts[ok], asked[ok]
        return found[counts >= asked]


def search_block(sets: list[np.ndarray], num: int, den: int, tied: UnionFind | None = None, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect everything in the block that links connect (a forest).

    Pivots first: each is searched for once, and ties together what it links to.  Then
    every set outside the largest component asks the whole index; two sets of different
    components are both inside it never.
    """
    n = len(sets)
    tied = tied or UnionFind(n)
    index = OccurrenceIndex(sets)
    out = []

    def ask(i: int) -> None:
        own = tied.find(i)
        known = lambda found: np.fromiter((tied.find(j) == own for j in found.tolist()), bool, len(found))
        for j in index.search(sets[i], num, den, known).tolist():
            if i != j and tied.join(i, j):
                out.append((i, j))

    asked = set()
    if queries is None:
        for _ in range(PIVOTS):
            heads: dict[int, int] = {}
            for i in range(n):
                heads[tied.find(i)] = heads.get(tied.find(i), 0) + 1
            left = [i for i in range(n) if i not in asked and heads[tied.find(i)] == 1]
            if not left:
                break
            asked.add(left[0])
            ask(left[0])
        heads = {}
        for i in range(n):
            heads[tied.find(i)] = heads.get(tied.find(i), 0) + 1
        main = max(heads, key=lambda h: (heads[h], -h)) if heads else -1
        queries = [i for i in range(n) if tied.find(i) != main and i not in asked]
    for i in queries:
        ask(i)
    return out


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100, block: int = BLOCK_CLASSES) -> DataFrame:
    """Components of documents whose shingle sets have Jaccard similarity >= num/den.

    Returns per row: key, n_shingles (long), component (the smallest key that links
    reach, itself included).  Texts without words have no shingles and link to nothing;
    null keys take part in links and are never the smallest; a row whose component has
    only null keys keeps a null component.  Repeated rows are copies of each other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    common, rank = _common_shingles(rows, k)
    shared = spark.sparkContext.broadcast((common, rank))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        for piece in slices(batches, limit=1 << 20):
            sets = [shingle_set(t, k) for t in piece.column("text").to_pylist()]
            first = [first_shingles(s, common, rank, num, den) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.array([f.tobytes() for f in first], pa.binary())], ["key", "n_shingles", "sig", "first"]
            )

    wide = durable(rows.mapInArrow(cut, f"key {kind}, n_shingles long, sig binary, first binary"), "shingles")
    marked = durable(wide.drop("first"), "signatures")
    shared_lists = _shared_lists(wide, num, den)
    drop_durable(wide)
    groups = durable(connected_components(_stars(shared_lists), "groups").withColumnsRenamed({"node": "cid", "comp": "grp"}), "candidate-groups")
    sets = _candidate_sets(rows, groups, k)
    settle(spark)  # each of the many short rounds leaves plans and generated classes
    links = _links(sets, shared_lists, num, den, block)
    drop_durable(sets)
    drop_durable(shared_lists)
    found = connected_components(links, "links").select(F.col("node").alias("sig"), "comp")
    classes = marked.where("n_shingles > 0").groupBy("sig").agg(F.min("key").alias("least"))
    named = durable(classes.join(found, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "class-components")
    components = named.groupBy("comp").agg(F.min("least").alias("component"), F.count("*").alias("degree"))
    named = join_hubs(named, components, "comp", "component", named.count()).select("sig", "component")
    out = marked.select("key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sig")).alias("sig")).join(named, "sig", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))


def _class_number(sig: bytes) -> int:
    """Number of a class in candidate lists; two classes of one number share a group."""
    return int.from_bytes(sig[:8], "little", signed=True)


def _shared_entries(entries: DataFrame) -> DataFrame:
    """h, cid, least, leader: entries of lists with two classes or more, each with the
    list's first class.  Lists are streamed in order; a list is never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (h, cid, least, leader, whether others share the list)
        for b in batches:
            h, c, m = (b.column(x).to_numpy(zero_copy_only=False) for x in ("h", "cid", "least"))
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            if last and len(h) and (h[0], c[0]) == last[:2]:
                keep[0] = False
            h, c, m = h[keep], c[keep], m[keep]
            if not len(h):
                continue
            if last:
                h, c, m = np.append(last[0], h), np.append(last[1], c), np.append(last[2], m)
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            leader = c[start]
            shared = ~new
            shared[:-1] |= ~new[1:]
            if last and last[4]:
                same = start == 0
                leader[same], shared[same] = last[3], True
            end = len(h) - 1
            emit = shared.copy()
            emit[end] = False
            if emit.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[emit]) for x in (h, c, m, leader)], ["h", "cid", "least", "leader"])
            last = h[end], c[end], m[end], leader[end], bool(shared[end])
        if last and last[4]:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last[:4]], ["h", "cid", "least", "leader"])
        give_back()

    return entries.repartition("h").sortWithinPartitions("h", "cid").mapInArrow(run, "h long, cid long, least int, leader long")


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): classes tied to the first class of a list, never the pairs of a list."""
    return shared.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()


def _shared_lists(marked: DataFrame, num: int, den: int) -> DataFrame:
    """Entries of the lists of two classes or more, where both may have links.

    Classes without enough shared entries are dropped, twice, as dropping some takes
    shared entries from others.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in slices(batches, "first", 1 << 20):
            first, cids, sizes, least = [], [], [], []
            for sig, f, n in zip(piece.column("sig").to_pylist(), piece.column("first").to_pylist(), piece.column("n_shingles").to_pylist(), strict=True):
                cid = _class_number(sig)
                if cid in seen or not n:
                    continue
                if len(seen) < 100_000:
                    seen.add(cid)
                first.append(np.frombuffer(f, np.int64))
                cids.append(cid)
                sizes.append(len(f) // 8)
                least.append(extra(need(n, num, den), num, den))
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.repeat(np.array(cids, np.int64), sizes)), pa.array(np.repeat(np.array(least, np.int32), sizes))], ["h", "cid", "least"])

    entries = marked.select("sig", "first", "n_shingles").mapInArrow(spread, "h long, cid long, least int")
    shared = durable(_shared_entries(entries), "shared-entries")
    for _ in range(2):
        able = shared.groupBy("cid", "least").agg(F.count("*").alias("c")).where("c >= least").select("cid")
        again = durable(_shared_entries(shared.join(able, "cid", "left_semi").select("h", "cid", "least")), "shared-entries")
        drop_durable(shared)
        shared = again
    return shared


def _common_shingles(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen twice or more in a hashed sample of texts, sorted, with their rank.

    They only set the order of shingles, which is right whatever it is; the sample is a
    share of the texts, the table is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for piece in slices(batches):
            held += [shingle_set(t, k) for t in piece.column("text").to_pylist()]
            if sum(map(len, held)) > 1_000_000:
                yield flush()
        yield flush()

    sample = rows.where(F.pmod(F.xxhash64("text", F.col("key").cast("string")), F.lit(SAMPLE_ONE_IN)) == 0).select("text")
    counts = sample.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c >= 2")
    top = counts.orderBy(F.desc("c"), "h").limit(COMMON).select("h").toArrow()
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    # the rarest comes first
    return h[order], (len(h) - np.arange(len(h)))[order]


def _candidate_sets(rows: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """sig, grp, n, shingles of one document of every class in a candidate group.

    Texts are cut again where a bit table says that their class may be in a group; the
    join then drops those that only share a bit.
    """
    spark = rows.sparkSession
    slot = F.pmod("cid", F.lit(BITS)) + 1
    found = groups.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    width = 4096
    table = bytearray(BITS // 8 + width)
    for r in found:
        table[(r["b"] - 1) * width : r["b"] * width] = r["bits"]
    bits = spark.sparkContext.broadcast(bytes(table))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = bits.value, set()
        for piece in slices(batches, limit=1 << 20):
            sigs, cids, sets = [], [], []
            for t in piece.column("text").to_pylist():
                found = shingle_set(t, k)
                sig = signature(found)
                cid = _class_number(sig)
                at = cid % BITS
                if len(found) and have[at >> 3] >> (at & 7) & 1 and cid not in seen:
                    if len(seen) < 100_000:
                        seen.add(cid)
                    sigs.append(sig)
                    cids.append(cid)
                    sets.append(found.tobytes())
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], ["sig", "cid", "shingles"])

    some = rows.select("text").mapInArrow(cut, "sig binary, cid long, shingles binary")
    return durable(some.join(groups, "cid").groupBy("cid", "grp", "sig").agg(F.first("shingles").alias("shingles")), "candidate-sets")


def _kin(sized: DataFrame, entries: DataFrame, block: int) -> DataFrame:
    """(cid, kin): classes of one kin go into one block, so that few must visit others.

    The kin of a class is the leader of most of its lists.  Kin above an eighth of a
    block have no row: their classes are dealt one by one.
    """
    shares = entries.groupBy("cid", "leader").agg(F.count("*").alias("c"))
    most = shares.groupBy("cid").agg(F.max_by("leader", F.struct("c", "leader")).alias("kin"))
    near = durable(most.join(sized.select("cid", "n"), "cid"), "kin")
    large = (F.count("*") > F.lit(block / 8)) | (F.sum("n") > F.lit(BLOCK_SHINGLES / 8))
    heavy = durable(near.groupBy("kin").agg(large.alias("large")).where("large").select("kin"), "heavy-kin")
    return near.join(heavy, "kin", "left_anti").select("cid", "kin")


def _with_parts(sets: DataFrame, cut: DataFrame) -> DataFrame:
    """``sets`` with the parts of their group, 1 where ``cut`` (grp, parts) has no row.

    A cut group holds a block of classes and more, so there are few.  They are broadcast
    as long as their counted number allows it; beyond, both sides are dealt over salts,
    so that a giant group is no single task.
    """
    if cut.count() <= CUT_GROUPS:
        out = sets.join(F.broadcast(cut), "grp", "left")
    else:
        wide = cut.agg(F.least(F.max("parts"), F.lit(1024))).first()[0]
        salted = cut.select("grp", "parts", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("salt"))
        out = sets.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(wide)).cast("int")).join(salted, ["grp", "salt"], "left").drop("salt")
    return out.withColumn("parts", F.coalesce("parts", F.lit(1)))


def _links(sets: DataFrame, entries: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(a, b): links between classes that connect all that links connect.

    Who meets whom is found on narrow tables of class numbers; the sets are joined to the
    finished tasks only, once for the blocks and once for the visits between them.
    """
    sized = sets.select("cid", "sig", "grp", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    groups = sized.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("mass"))
    parts = F.ceil(F.greatest(F.col("members") / F.lit(float(block)), F.col("mass") / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    groups = durable(groups.select("grp", parts.alias("parts")), "group-sizes")
    place = _with_parts(sized, groups.where("parts > 1")).join(_kin(sized, entries, block), "cid", "left")
    place = durable(place.select("cid", "sig", "grp", "parts", F.pmod(F.xxhash64(F.coalesce("kin", "cid")), F.col("parts")).cast("int").alias("part")), "places")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; a task's sets are searched when the next begins."""
        task, sigs, got, ask = None, [], [], []

        def done() -> pa.RecordBatch:
            position: dict[bytes, int] = {}
            uniq, own = [], []
            for s, g, q in zip(sigs, got, ask, strict=True):
                if s not in position:
                    position[s] = len(uniq)
                    uniq.append(g)
                    own.append(q)
                elif q:
                    own[position[s]] = True
            names = list(position)
            queries = None if task["other"] < 0 else [i for i, q in enumerate(own) if q]
            links = search_block(uniq, num, den, queries=queries)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in links], pa.binary()), pa.array([names[j] for _, j in links], pa.binary())], ["a", "b"])

        for b in batches:
            for t, s, g, q in zip(b.column("task").to_pylist(), b.column("sig").to_pylist(), b.column("shingles").to_pylist(), b.column("query").to_pylist(), strict=True):
                if t != task:
                    if task is not None:
                        yield done()
                    task, sigs, got, ask = t, [], [], []
                sigs.append(s)
                got.append(np.frombuffer(g, np.uint64))
                ask.append(q)
        if task is not None:
            yield done()
        sigs, got, ask = [], [], []
        give_back()

    def run(tasks: DataFrame) -> DataFrame:
        """Links found by tasks (task, cid, sig, query).  Two classes of one number have
        one place each, so the signature is part of the join."""
        dealt = tasks.join(sets.select("cid", "sig", "shingles"), ["cid", "sig"]).drop("cid").repartition("task").sortWithinPartitions("task", "sig")
        return dealt.select("task", "sig", "shingles", "query").mapInArrow(search, "a binary, b binary")

    within = place.select(F.struct("grp", "part", F.lit(-1).alias("other")).alias("task"), "cid", "sig", F.lit(False).alias("query"))
    links = durable(run(within), "links-within")
    comp = connected_components(links, "links-first")
    big = place.where("parts > 1")
    tagged = durable(big.join(comp, big["sig"] == comp["node"], "left").select("cid", "grp", "part", "sig", F.coalesce("comp", "sig").alias("comp")), "blocks")
    weight = tagged.groupBy("grp", "comp").agg(F.count("*").alias("w"))
    main = weight.groupBy("grp").agg(F.max_by("comp", F.struct("w", "comp")).alias("main"))
    # classes outside the largest component ask the other blocks of which the lists meet
    # as many of their entries as a link needs; a block takes its visitors in shards
    asking = tagged.join(F.broadcast(main) if main.count() <= CUT_GROUPS else main, "grp").where("comp <> main").select("cid")
    ours = durable(entries.join(place, "cid").select("h", "grp", "cid", "part", "least", "parts"), "placed-entries")
    lists = ours.where("parts > 1").select("h", "grp", F.col("part").alias("to")).distinct()
    asks = ours.where("parts > 1").join(asking, "cid", "left_semi").select("h", "grp", "cid", "part", "least")
    met = asks.join(lists, ["h", "grp"]).where("to <> part").groupBy("grp", "to", "cid", "least").agg(F.count("*").alias("c"))
    met = durable(met.where("c >= least").select("grp", "to", "cid"), "visits")
    drop_durable(ours)
    visited = met.groupBy("grp", "to").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("shards"))
    visits = met.join(visited, ["grp", "to"]).withColumn("shard", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("shards")).cast("int"))
    visits = visits.select("grp", "to", "shard", "cid").join(tagged.select("cid", "sig"), "cid").withColumn("query", F.lit(True))
    homes = tagged.select("grp", F.col("part").alias("to"), "cid", "sig").join(visited, ["grp", "to"])
    homes = homes.select("grp", "to", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "cid", "sig", F.lit(False).alias("query"))
    across = visits.unionByName(homes)
    across = across.select(F.struct("grp", F.col("to").alias("part"), F.col("shard").alias("other")).alias("task"), "cid", "sig", "query")
    across = durable(run(across), "links-across")
    for done in (tagged, met, place):
        drop_durable(done)
    return links.unionByName(across)
