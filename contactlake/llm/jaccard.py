"""Near copies: Jaccard join on word shingles with count vectors in an R-tree.

1. Every set of shingles gets an identity (size and hash), so copies are one set from here on.
2. Shingles that stand in many sets are counted; a set's rarest shingles are its prefix, and two
   sets that link share one of them.  Lists of sets that share a prefix shingle are split where
   sizes are too far apart, and equal lists are kept once.
3. Each list's hub, the set that stands in most lists, is verified against all its sets; that joins
   most true groups, since the least changed copy of a group shares its lists with all it links to.
4. In lists that still hold several components an R-tree over count vectors (shingles hashed
   into groups) finds the pairs of different components whose overlap bound, the summed
   coordinate minima, allows a link; these are verified as well.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.components import components
from contactlake.llm.tables import highest, log_level, on_workers, stage, task_count
from contactlake.llm.textarrays import SHINGLE_BITS, Sets, blocks, mix, shingle_sets, string_block, words

# A shingle this frequent in one task is counted over all; the most frequent ones close a set's order.
LOCAL_COUNT = 4
FREQUENT = 24
FREQUENT_MOST = 1 << 20
# A list this long is split into pairs of parts.
LIST_SETS = 8_192
# Lists up to this size have all their pairs verified at once.
SMALL_LIST = 4
LEAF, FAN = 32, 32
# Bytes of text whose sets one task holds at once, and shingles it counts beside.
BLOCK = 2 << 20
COUNTED = 1 << 19
_HEAVY = np.uint64(1 << SHINGLE_BITS)


def _needed(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int):
    """Smallest overlap with which sets of n and m shingles link."""
    return -(-num * (n + m) // (num + den))


def set_ids(s: Sets) -> np.ndarray:
    """64-bit identity of each set; 0 for the empty one."""
    total = np.zeros(len(s.member) + 1, np.uint64)
    np.cumsum(mix(s.member), out=total[1:])
    n = np.diff(s.first).astype(np.uint64)
    out = mix(total[s.first[1:]] - total[s.first[:-1]] + n * np.uint64(0x9E3779B97F4A7C15))
    out[n == 0] = 0
    return out


def group_count(n: int) -> int:
    """Coordinates of a set's count vector: a power of two of about three quarters of its size."""
    return min(8192, max(16, 1 << (int(n) // 2).bit_length()))


def count_vector(members: np.ndarray) -> np.ndarray:
    """Shingles of each group, one byte a group unless one needs two."""
    v = np.bincount((members & np.uint64(group_count(len(members)) - 1)).astype(np.int64), minlength=group_count(len(members)))
    return v.astype(np.uint8 if v.max() < 256 else np.uint16)


def read_vector(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == group_count(n) else np.uint16)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    """The count vector over fewer groups."""
    return (vector if len(vector) == groups else vector.reshape(-1, groups).sum(axis=0)).astype(np.uint16)


class CountTree:
    """Packed R-tree over count vectors; a box keeps its upper corner, smallest size and its component if it is one."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        spread = vectors.var(axis=0).argsort()[::-1]
        one = vectors[:, spread[0]].argsort(kind="stable")
        tile = max(LEAF, LEAF * int(np.ceil(np.sqrt(len(vectors) / LEAF))))
        key = np.empty(len(vectors), np.int64)
        key[one] = np.arange(len(vectors)) // tile
        # parts of one component lie together, so that whole boxes can be passed over
        self.order = np.lexsort((vectors[:, spread[-1 if len(spread) == 1 else 1]], key, component))
        self.levels = [(vectors[self.order], sizes[self.order], component[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            v, n, c = self.levels[-1]
            at = np.arange(0, len(v), LEAF if len(self.levels) == 1 else FAN)
            low, high = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            self.levels.append((np.maximum.reduceat(v, at, axis=0), np.minimum.reduceat(n, at),
                                np.where(low == high, low, -1)))

    def matches(self, vector: np.ndarray, size: int, component: int, num: int, den: int) -> np.ndarray:
        """Rows of other components whose overlap bound with the given set allows a link."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, n, c = self.levels[depth]
            at = at[c[at] != component]
            bound = np.minimum(v[at], vector).sum(axis=1, dtype=np.int64)
            at = at[bound >= _needed(n[at].astype(np.int64), size, num, den)]
            if depth:
                step = LEAF if depth == 1 else FAN
                at = (at[:, None] * step + np.arange(step)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        n = self.levels[0][1][at].astype(np.int64)
        return self.order[at[(den * np.minimum(n, size) >= num * np.maximum(n, size))]]


def list_pairs(sids: np.ndarray, sizes: np.ndarray, component: np.ndarray, vectors: list[np.ndarray],
               num: int, den: int) -> np.ndarray:
    """Pairs of one list, of different components, that the tree cannot rule out."""
    groups = min(map(len, vectors))
    v = np.stack([fold(x, groups) for x in vectors])
    tree = CountTree(v, sizes, component)
    out = []
    for i in range(len(sids)):
        m = tree.matches(v[i], int(sizes[i]), int(component[i]), num, den)
        m = m[sids[m] > sids[i]]
        out.append(np.stack([np.full(len(m), sids[i]), sids[m]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _pack(members: np.ndarray) -> bytes:
    """Six bytes a shingle."""
    return members.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


class _Frequent:
    """Place of frequent shingles in the global order, behind all others."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray):
        by_count = np.lexsort((shingle, count))
        place = np.empty(len(shingle), np.uint64)
        place[by_count] = np.arange(len(shingle), dtype=np.uint64)
        order = np.argsort(shingle)
        self.shingle, self.place, self.count = shingle[order], place[order], count[by_count]
        self._seen = np.zeros(1 << 22, bool)
        self._seen[shingle >> np.uint64(SHINGLE_BITS - 22)] = True

    def keys(self, member: np.ndarray) -> np.ndarray:
        """Order of each shingle: its hash, or its place behind all hashes."""
        key = member.copy()
        if len(self.shingle):
            maybe = np.flatnonzero(self._seen[member >> np.uint64(SHINGLE_BITS - 22)])
            at = np.minimum(np.searchsorted(self.shingle, member[maybe]), len(self.shingle) - 1)
            hit = self.shingle[at] == member[maybe]
            key[maybe[hit]] = _HEAVY | self.place[at[hit]]
        return key


class IdFilter:
    """Bitmap of hashed ids, of fixed size: no given id fails it, few others pass while it is sparse.

    It spares rows work and moves; what passes by chance meets no partner later.
    """

    BITS = 26

    def __init__(self, ids: DataFrame, column: str):
        def words_of(batches):
            for b in batches:
                word, bit = self._place(b.column(column).to_numpy())
                names, at = np.unique(word, return_inverse=True)
                bits = np.zeros(len(names), np.uint64)
                np.bitwise_or.at(bits, at, np.uint64(1) << bit)
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

        # at most 2^20 rows of two numbers
        rows = (ids.select(column).mapInArrow(words_of, "word INT, bits LONG").groupBy("word")
                .agg(F.bit_or("bits").alias("bits")).toPandas())
        self.words = np.zeros(1 << (self.BITS - 6), np.uint64)
        self.words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)

    @classmethod
    def _place(cls, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bit = mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - cls.BITS)
        return (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        word, bit = self._place(ids)
        return (self.words[word] >> bit & np.uint64(1)).astype(bool)


def prefixes(s: Sets, frequent: _Frequent, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Set and order key of the rarest shingles of each set, as many as a link cannot all miss."""
    n = np.diff(s.first)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = doc << np.uint64(SHINGLE_BITS + 1) | frequent.keys(s.member)
    key.sort()
    take = n - -(-num * n // den) + 1
    place = np.arange(len(key)) - np.repeat(s.first[:-1], n)
    key = key[place < np.repeat(take, n)]
    return (key >> np.uint64(SHINGLE_BITS + 1)).astype(np.int64), key & np.uint64((1 << (SHINGLE_BITS + 1)) - 1)


def _list_keys(key: np.ndarray, sid: np.ndarray, frequent: _Frequent, list_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists each posting goes to, and its posting; one, or one for each other part of a list too long."""
    row = np.arange(len(key))
    parts = np.ones(len(key), np.int64)
    heavy = np.flatnonzero(key >= _HEAVY)
    parts[heavy] = -(-frequent.count[(key[heavy] ^ _HEAVY).astype(np.int64)] // list_sets)
    row = np.repeat(row, parts)
    k = parts[row]
    mine = (mix(sid[row]) % k.astype(np.uint64)).astype(np.int64)
    other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    pair = np.minimum(mine, other) * k + np.maximum(mine, other)
    return mix(key[row] + pair.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), row


def split_lists(lists: np.ndarray, sid: np.ndarray, n: np.ndarray, num: int, den: int):
    """Lists as (identity, sets, sizes): two sets at least, neighbours in size close enough to link, equal lists once."""
    order = np.lexsort((sid, n, lists))
    lists, sid, n = lists[order], sid[order], n[order].astype(np.int64)
    keep = np.r_[True, (lists[1:] != lists[:-1]) | (sid[1:] != sid[:-1])] if len(lists) else np.zeros(0, bool)
    lists, sid, n = lists[keep], sid[keep], n[keep]
    if len(lists) < 2:
        return
    cut = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]) | (den * n[:-1] < num * n[1:])])
    size = np.diff(np.r_[cut, len(lists)])
    total = np.r_[np.uint64(0), np.cumsum(mix(sid))]
    identity = mix(total[cut + size] - total[cut] + size.astype(np.uint64))
    many = np.flatnonzero(size > 1)
    many = many[np.unique(identity[many], return_index=True)[1]]
    for k in many.tolist():
        part = slice(cut[k], cut[k] + size[k])
        yield identity[k], sid[part], n[part]


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id",
                       text_col: str = "text", list_sets: int = LIST_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id of every row.

    A row's set holds its distinct runs of ``width`` words (white space as in textarrays, A-Z
    lowered); a shorter text is one run.  Rows link when den * overlap >= num * union; components
    are named by their smallest id.  The result is complete: lists of any length are worked on,
    in parts, and every pair that the bound leaves open is verified on whole sets.

    Null or empty texts, and texts of white space, have an empty set and link with nothing.
    Ids are integers and may repeat; rows with a null id are left out, as they cannot be named.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = on_workers(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null")
    tasks = task_count(spark)

    def sets_of(batches, wanted: IdFilter | None = None):
        for batch in batches:
            batch = batch if wanted is None else batch.filter(pa.array(wanted(batch.column("doc_id").to_numpy())))
            for b in blocks(batch, "text", BLOCK):
                s = shingle_sets(words(*string_block(b.column("text"))), width)
                yield b, s, set_ids(s)

    # 1. identities, and shingles frequent within a task
    def profile(batches):
        names = ["kind", "a", "b", "n"]
        seen, often, times = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge(more: np.ndarray, weight: np.ndarray) -> None:
            nonlocal often, times
            both, at = np.unique(np.r_[often, more], return_inverse=True)
            times = np.bincount(at, np.r_[times, weight], len(both)).astype(np.int64)
            often = both
            if len(often) > COUNTED:    # a guide to the order only, so the rare ones may go
                often, times = often[times > 1], times[times > 1]

        for b, s, ids in sets_of(batches):
            n = np.diff(s.first)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), b.column("doc_id"),
                                              pa.array(ids.view(np.int64)), pa.array(n.astype(np.int32))], names=names)
            fresh = np.zeros(len(n), bool)
            fresh[np.unique(ids, return_index=True)[1]] = True
            fresh &= ~np.isin(ids, seen)
            seen = np.r_[seen, ids[fresh]]
            merge(*np.unique(s.member[np.repeat(fresh, n)], return_counts=True))
        pick = times >= LOCAL_COUNT
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(pick.sum(), np.int8)), pa.array(often[pick].view(np.int64)),
                                          pa.array(times[pick]), pa.array(np.zeros(pick.sum(), np.int32))], names=names)

    profiled = stage(texts.mapInArrow(profile, "kind BYTE, a LONG, b LONG, n INT"))
    rows = profiled.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sid"), "n")
    # at most FREQUENT_MOST rows of two numbers
    counted = stage(profiled.where("kind = 1").groupBy("a").agg(F.sum("b").alias("times")).where(F.col("times") >= FREQUENT))
    table = highest(counted, log_level(F.col("times")), FREQUENT_MOST).toPandas()
    frequent = _Frequent(table["a"].to_numpy(np.int64).view(np.uint64), table["times"].to_numpy(np.int64))

    # 2. postings of prefix shingles, packed by task and bucket, and the lists they make
    def postings(batches):
        for _, s, ids in sets_of(batches):
            n = np.diff(s.first)
            doc, key = prefixes(s, frequent, num, den)
            new = np.zeros(len(n), bool)
            new[np.unique(ids, return_index=True)[1]] = True
            keep = new[doc]
            lists, row = _list_keys(key[keep], ids[doc[keep]], frequent, list_sets)
            doc = doc[keep][row]
            order = np.argsort(lists)
            lists, doc = lists[order], doc[order]
            bucket = ((lists >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(tasks + 1, dtype=np.uint64))
            have = np.flatnonzero(np.diff(cut)).tolist()
            sid, size = ids[doc], n[doc].astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(have, pa.int32()), *(pa.array([x[cut[k]:cut[k + 1]].tobytes() for k in have], pa.binary())
                                               for x in (lists, sid, size))], names=["bucket", "lists", "sids", "sizes"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b"".join(pdf[c]), t) for c, t in (("lists", np.uint64), ("sids", np.uint64), ("sizes", np.uint32))]
        found = list(split_lists(*parts, num, den))
        return pd.DataFrame({"list": [int(np.uint64(i).view(np.int64)) for i, _, _ in found],
                             "sids": [s.view(np.int64) for _, s, _ in found]})

    lists = stage(texts.select("text").mapInArrow(postings, "bucket INT, lists BINARY, sids BINARY, sizes BINARY")
                  .groupBy("bucket").applyInPandas(gather, "list LONG, sids ARRAY<LONG>").dropDuplicates(["list"]))

    # 3. count vectors of the sets that stand in a list, from one document each
    firsts = stage(rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")))
    listed = stage(lists.select(F.explode("sids").alias("sid")).distinct().join(firsts, "sid"))
    in_list = IdFilter(listed, "first")

    def gather_vectors(batches):
        for _, s, ids in sets_of(batches, in_list):
            vectors = [count_vector(s.member[a:b]).tobytes() for a, b in zip(s.first, s.first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(np.diff(s.first).astype(np.int32)),
                                              pa.array(vectors, pa.binary())], names=["sid", "n", "vector"])

    vectors = stage(texts.mapInArrow(gather_vectors, "sid LONG, n INT, vector BINARY"))

    def allowed(batches):
        for b in batches:
            ok = []
            for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("va", "vb", "na", "nb"))):
                x, y = read_vector(x, n), read_vector(y, m)
                g = min(len(x), len(y))
                ok.append(int(np.minimum(fold(x, g), fold(y, g)).sum(dtype=np.int64)) >= _needed(n, m, num, den))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def linked(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("ma").to_pylist(), b.column("mb").to_pylist()):
                x, y = _unpack(x), _unpack(y)
                same = np.sort(np.concatenate([x, y]))
                overlap = int((same[1:] == same[:-1]).sum())
                ok.append(den * overlap >= num * (len(x) + len(y) - overlap))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def beside(pairs: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
        """Pairs with a column of each of their two sets, named by side."""
        for k in ("b", "a"):
            pairs = pairs.join(table.select(F.col("sid").alias(k), F.col(column).alias(name + k)), k)
        return pairs

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs of sets that link: sizes first, then the bound, then whole sets, read for what is left."""
        sized = beside(pairs, listed, "n", "n").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
        left = stage(beside(sized, vectors, "vector", "v").mapInArrow(allowed, "a LONG, b LONG").distinct())
        needed = left.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(listed, "sid")
        in_pair = IdFilter(needed, "first")

        def gather_members(batches):
            for _, s, ids in sets_of(batches, in_pair):
                members = [_pack(s.member[a:b]) for a, b in zip(s.first, s.first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(members, pa.binary())],
                                                 names=["sid", "members"])

        members = stage(texts.mapInArrow(gather_members, "sid LONG, members BINARY"))
        return stage(beside(left, members, "members", "m").mapInArrow(linked, "a LONG, b LONG").distinct())

    # the hub of a list and one set more against all, every pair of a small one
    standing = lists.select("list", F.explode("sids").alias("sid"))
    degree = standing.groupBy("sid").agg(F.count("*").alias("lists"))
    hubs = stage(standing.join(degree, "sid").groupBy("list").agg(
        F.max_by("sid", F.struct("lists", F.xxhash64("sid"))).alias("hub"), F.min_by("sid", F.xxhash64("sid")).alias("other")))
    centre = F.when(F.size("sids") <= SMALL_LIST, F.col("sids")).otherwise(F.array("hub", "other"))
    seeds = stage(lists.join(hubs, "list").select(F.explode(centre).alias("x"), "sids").select("x", F.explode("sids").alias("y"))
                  .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = verify(seeds)
    home = stage(components(links))

    # 4. lists that still hold several components
    entries = (lists.where(F.size("sids") > SMALL_LIST).select("list", F.explode("sids").alias("sid"))
               .join(home.withColumnRenamed("node", "sid"), "sid", "left")
               .select("list", "sid", F.coalesce("root", "sid").alias("root")))
    mixed = (entries.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list"))
    # lists of one hub overlap much, so they share a few buckets, where a pair is kept once
    open_ = (entries.join(mixed.join(hubs, "list"), "list").join(vectors, "sid")
             .withColumn("bucket", F.pmod(F.xxhash64("hub", F.pmod("list", F.lit(8))), F.lit(16 * tasks))))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found, waiting = np.zeros((0, 2), np.int64), []
        for _, g in pdf.groupby("list", sort=False):
            component = np.unique(g["root"], return_inverse=True)[1]
            waiting.append(list_pairs(g["sid"].to_numpy(), g["n"].to_numpy(), component,
                                      [read_vector(v, n) for v, n in zip(g["vector"], g["n"])], num, den))
            if sum(map(len, waiting)) > 1 << 20:
                found, waiting = np.unique(np.concatenate([found, *waiting]), axis=0), []
        return pd.DataFrame(np.unique(np.concatenate([found, *waiting]), axis=0), columns=["a", "b"])

    rest = stage(open_.groupBy("bucket").applyInPandas(search, "a LONG, b LONG").distinct().join(seeds, ["a", "b"], "left_anti"))
    more = verify(rest)

    # components of components, named by the smallest id
    def at_home(t: DataFrame, c: str) -> DataFrame:
        return (t.join(home.select(F.col("node").alias(c), F.col("root").alias("_root")), c, "left")
                .withColumn(c, F.coalesce("_root", c)).drop("_root"))

    top = stage(components(at_home(at_home(more, "a"), "b")))
    roots = (firsts.join(home.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
             .join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
             .select("sid", "first", F.coalesce("top", "root").alias("top")))
    roots = stage(roots)
    named = roots.join(roots.groupBy("top").agg(F.min("first").alias("component_id")), "top").select("sid", "component_id")
    return (rows.join(named, "sid", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), F.col("sid").alias("set_id")))
