"""N-gram Jaccard join by T-occurrence search (DivideSkip) in blocks that lose no link.

1. Every document becomes its set of word shingles, as 64-bit hashes. Documents with equal sets form a class; only the
   smallest doc_id of a class goes on.
2. Blocks. Two sets x, y of similarity t differ in at most (|x| + |y|)(1 - t) / (1 + t) shingles. Dealing the shingles
   over more segments than that, by hash, leaves at least one segment in which linked sets agree fully, so linked
   documents share a hash of (size class, segment, its content). Set sizes fall into classes in ratio CLASS_RATIO; a
   document also gives the segments of the class below while a smaller partner can lie there. Empty segments would be
   shared by strangers: with SPARE segments more, linked sets agree in one that is not empty, unless both have more than
   SPARE empty ones, and only such sets give theirs. Passages that many documents share make strangers agree in a segment
   too, so pairs are tested first: a set's parity bits (bit h mod width flipped by every hash h) differ from another's in
   no more places than the sets do, which bounds the overlap from above. Every document is tested against the first one of
   each of its segments; where a segment's documents are then still apart, they are tested among each other (segments of
   the same documents once, crowded ones in pairs of parts). Components of pairs that pass are the blocks; documents
   alone in theirs have no partner and end here.
3. In a block, T-occurrence search: inverted lists from shingle to documents; a query's lists are divided into the L
   longest and the rest; the short ones are merged with a heap that skips ahead by binary search (by one sort of arrays
   where they hold over HEAP_POSTINGS entries), and documents met T - L times are probed for in the long ones by binary
   search, all at once, for as long as they can reach their overlap, which is then exact. Documents of the query's own
   component are left out: links are wanted for reachability, so a block of near copies costs about one probe a document.
4. A block above BLOCK_DOCS documents or BLOCK_SHINGLES shingles is dealt over parts, which are searched each on its own
   with the block's PIVOTS in all of them; if that leaves more than one component, all pairs of its parts are searched,
   again without pairs already connected. No partner or candidate is ever capped.

Shingles are equal when their 64-bit hashes are: for n documents of s shingles a false link needs many collisions at once,
a wrong set size one, of chance below n * s^2 / 2^65. Null or wordless text: no shingles, linked with nothing. With fewer
words than a shingle has, the whole sequence is one. Null doc_ids take part in classes only, and name no component.
Repeated rows are members of one class; rows of one doc_id with different texts are one document with the links of all. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fellscan.llm.common import BROADCAST_ROWS, LOWER, UPPER, beside, landed
from fellscan.llm.graph import components

WORDS, PERCENT = 3, 90
CLASS_RATIO, SPARE = 1.4, 2
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS, HEAP_POSTINGS = 2_000, 3_000_000, 4, 512
#: Parity bits a shingle, and bounds of a set's width (powers of two). Strangers differ in so many places that one bit a
#: shingle tells them apart; more would be shuffled with every pair.
BITS_EACH, BITS_LEAST, BITS_MOST = 1, 256, 65_536
#: Documents of a segment that are tested in one part, and rows of many segments that one call tests.
SEGMENT_DOCS, TEST_ROWS = 4_096, 20_000
#: DivideSkip's share of long lists: L = T / (MU * log M + 1), M the longest list.
MU = 0.0085
REMEMBERED = 300_000
_SPACE, _LOWER = re.compile("[\x20\x09-\x0d]+"), str.maketrans(UPPER, LOWER)
#: What str.split() takes for blank beyond the contract's separators.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_words: dict[str, int] = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hash of the lower-case form of each word."""

    def __missing__(self, w: str) -> int:
        value = self[w] = xxh3_64_intdigest(w.lower() if w.isascii() else w.translate(_LOWER))
        return value


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different shingle hashes of a text."""
    global _words
    if len(_words) > REMEMBERED or not isinstance(_words, _Hashes):
        _words = _Hashes()
    text = text or ""
    seq = [w for w in _SPACE.split(text) if w] if _OTHER_SPACE.search(text) else text.split()
    if not seq:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, seq), np.uint64, len(seq))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _class_of(n: int) -> int:
    i = max(0, int(math.log(n) / math.log(CLASS_RATIO)) - 1)
    while _class_from(i + 1) <= n:
        i += 1
    return i


def _class_from(i: int) -> int:
    """Smallest set size of a class."""
    return i + 1 if i < 4 else max(i + 1, math.ceil(CLASS_RATIO ** (i + 1)))


def _segments(i: int, percent: int) -> int:
    """Segments of a class: its largest difference of linked sets whose smaller is in it, and one, and the spare ones."""
    size = _class_from(i + 1) - 1
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent) + 1 + SPARE


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes that any two linked sets have at least one of in common."""
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    out, i = [], _class_of(n)
    while True:
        g = _segments(i, percent)
        at = (_mix(s ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(g)).astype(np.int64)
        sums = np.zeros(g, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, at, _mix(s))
            full = np.bincount(at, minlength=g) > 0
            if g - int(full.sum()) > SPARE:
                full[:] = True
            names = np.flatnonzero(full)
            out.append(_mix(_mix(sums[names]) + names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1) * np.uint64(0xC2B2AE3D27D4EB4F)))
        if i == 0 or (_class_from(i) - 1) * 100 < n * percent:
            return np.concatenate(out).view(np.int64)
        i -= 1


def parity(s: np.ndarray) -> bytes:
    """Parity bits of a set: sets that differ in d members differ in d bits at most."""
    width = min(max(1 << (BITS_EACH * len(s) - 1).bit_length(), BITS_LEAST), BITS_MOST) if len(s) else BITS_LEAST
    at = (_mix(s ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The parity bits at a smaller width: places meet again modulo the width."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def may_link(n: np.ndarray, bits: list[bytes], comp: list, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect, with the components known, what any pairs that the parity bits allow connect."""
    order = np.lexsort((np.arange(len(n)), n))
    n, size = n[order], min(map(len, bits))
    rows = np.stack([_folded(bits[i], size) for i in order])
    roots, side = np.unique(np.array([comp[i] for i in order]), return_inverse=True)[1], None if side is None else side[order]
    links = []
    for q in range(1, len(n)):
        first = int(np.searchsorted(n, -(-n[q] * percent // 100)))
        open_ = roots[first:q] != roots[q]
        if side is not None:
            open_ &= side[first:q] != side[q]
        near = first + np.flatnonzero(open_)
        if not len(near):
            continue
        both = n[near] + n[q]
        apart = np.bitwise_count(rows[near] ^ rows[q]).sum(axis=1, dtype=np.int64)
        for j in near[(both - apart) // 2 >= -(-percent * both // (100 + percent))].tolist():
            if roots[j] != roots[q]:
                links.append((int(order[j]), int(order[q])))
                roots[roots == roots[j]] = roots[q]
    return links


def _needed(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def merge_short(lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(member, count) of what occurs in at least ``least`` of the sorted lists: heap merge that skips ahead."""
    heap = [(int(x[0]), k, 0) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            found.append((top, len(popped)))
            target = top + 1
        else:  # of the next lists, as many as could still be missed move on to where the following one stands
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(heap[0][0], top + 1)
        for _, k, at in popped:
            at = bisect.bisect_left(lists[k], target, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (int(lists[k][at]), k, at))
    return found


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)
        self.n = n

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.n -= 1
        return True


def search(sets: list[np.ndarray], percent: int = PERCENT, known: list[int] | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that, with the components already known, connect what the sets' links connect.

    ``side`` limits the search to pairs of different sides.
    """
    n = len(sets)
    order = sorted(range(n), key=lambda i: (len(sets[i]), i))
    sets = [sets[i] for i in order]
    side = None if side is None else side[order]
    sizes = np.array([len(s) for s in sets])
    forest, links = Forest(n), []
    if known is not None:
        first: dict = {}
        for at, i in enumerate(order):
            forest.join(first.setdefault(known[i], at), at)
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    by_set = np.split(ids, np.cumsum(sizes)[:-1])
    posting = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[posting]
    starts = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(tokens)))))
    roots = np.array([forest.root(i) for i in range(n)])

    def linked(i: int, j: int) -> bool:
        need = _needed(sizes[i], sizes[j], percent)
        return len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need

    def connect(i: int, j: int) -> None:
        if forest.join(i, j):
            links.append((order[i], order[j]))
            a, b = roots[i], roots[j]
            roots[roots == max(a, b)] = min(a, b)

    largest = 0
    for q in range(n):
        least_size = -(-sizes[q] * percent // 100)
        first = int(np.searchsorted(sizes, least_size))  # smaller sets cannot be linked with this one
        if first >= q:
            continue
        if roots[q] != roots[largest] and largest < q and sizes[largest] >= least_size and (side is None or side[largest] != side[q]) and linked(q, largest):
            connect(q, largest)
        open_ = roots[first:q] != roots[q]
        if side is not None:
            open_ &= side[first:q] != side[q]
        if not open_.any():
            largest = q if forest.n < n and roots[q] == roots[largest] else largest
            continue
        lists = []
        for t in by_set[q]:
            x = owner[starts[t] : starts[t + 1]]
            x = x[np.searchsorted(x, first) : np.searchsorted(x, q)]
            if len(x) and len(x := x[open_[x - first]]):
                lists.append(x)
        need = _needed(int(sizes[q]), int(least_size), percent)
        if len(lists) < need:
            continue
        lists.sort(key=len)
        n_long = min(need - 1, int(need / (MU * math.log(len(lists[-1])) + 1)))
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :][::-1]
        if sum(map(len, short)) <= HEAP_POSTINGS:
            met = merge_short(short, need - n_long)
            found, count = np.array([c for c, _ in met], np.int64), np.array([k for _, k in met], np.int64)
        else:  # the same merge, as one sort of arrays
            found, count = np.unique(np.concatenate(short), return_counts=True)
            found, count = found[count >= need - n_long], count[count >= need - n_long]
        must = -(-percent * (sizes[q] + sizes[found]) // (100 + percent))
        for left, x in zip(range(len(long_) - 1, -1, -1), long_):  # binary search of all that may still reach their overlap
            at = np.minimum(np.searchsorted(x, found), len(x) - 1)
            count = count + (x[at] == found)
            if (may := count + left >= must).all():
                continue
            found, count, must = found[may], count[may], must[may]
            if not len(found):
                break
        for c in found[count >= must].tolist():
            if roots[c] != roots[q]:
                connect(q, c)
    return links


def describe(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes of hash of the whole set), block signatures and parity bits of each document."""

    def make(batches):
        for pdf in batches:
            ns, ids, sigs, bits = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, words)
                ns.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signatures(s, percent))
                bits.append(parity(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": ns, "set_id": ids, "sigs": sigs, "bits": bits})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(make, f"doc_id {kind}, n_shingles bigint, set_id binary, sigs array<bigint>, bits binary")


def _tested_stars(stars: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of (rep, pivot) whose parity bits allow a link."""

    def run(batches):
        for pdf in batches:
            keep = []
            for n, bits, m, other in zip(pdf["n"], pdf["bits"], pdf["p_n"], pdf["p_bits"]):
                size = min(len(bits), len(other))
                apart = int(np.bitwise_count(_folded(bits, size) ^ _folded(other, size)).sum(dtype=np.int64))
                keep.append((n + m - apart) // 2 >= _needed(n, m, percent))
            yield pdf.loc[keep, ["rep", "pivot"]]

    # sizes alone bound the overlap as well, and need no bits
    sized = stars.join(marks.select(F.col("rep").alias("pivot"), F.col("n").alias("p_n")), "pivot").join(marks, "rep")
    sized = sized.where(F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent)
    pairs = sized.join(marks.select(F.col("rep").alias("pivot"), F.col("bits").alias("p_bits")), "pivot")
    return pairs.mapInPandas(run, "rep bigint, pivot bigint")


def _tested_segments(members: DataFrame, known: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(rep, pivot) that connect what is still apart among the documents of each segment and may be linked."""
    comp = F.coalesce("root", "rep").alias("comp")
    named = members.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", comp)
    half = lambda seed: F.sum(F.shiftrightunsigned(F.xxhash64("rep", F.lit(seed)), 32))
    same = [F.count(F.lit(1)).alias("m"), F.min("rep").alias("first"), F.max("rep").alias("last"), half(1).alias("x"), half(2).alias("y")]
    apart = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *same).where("lo < hi")
    apart = landed(apart.groupBy("m", "first", "last", "x", "y").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("m") / SEGMENT_DOCS).cast("int").alias("parts")), "join-apart")
    dealt = beside(named, apart, apart.count(), ["sig"], limit=2 * BROADCAST_ROWS).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("sig", "rep", "comp", "part", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"))
    calls = max(1, -(-dealt.count() // TEST_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, p1, p2), g in pdf.groupby(["sig", "p1", "p2"], sort=False):
            if len(g) > 1:
                ids, side = g["rep"].tolist(), g["part"].to_numpy() if p1 < p2 else None
                found += [(ids[i], ids[j]) for i, j in may_link(g["n"].to_numpy(), g["bits"].tolist(), g["comp"].tolist(), side, percent)]
        return pd.DataFrame(found, columns=["rep", "pivot"], dtype="int64")

    call = F.pmod(F.xxhash64("sig", "p1", "p2"), F.lit(calls)).alias("call")
    return dealt.join(marks, "rep").select(call, "sig", "p1", "p2", "part", "rep", "comp", "n", "bits").groupBy("call").applyInPandas(run, "rep bigint, pivot bigint")


def _search_groups(members: DataFrame, keys: list[str], words: int, percent: int) -> DataFrame:
    """For each group of (doc_id, text, comp, side), (a, b) of every document b that the links found join to a smaller a.

    Each set of linked documents comes as a star around its smallest, which is all that reachability needs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "text"])
        ids = pdf["doc_id"].tolist()
        side = None if pdf["side"].nunique() < 2 else pdf["side"].to_numpy()
        found = search([shingles(t, words) for t in pdf["text"]], percent, pdf["comp"].tolist(), side) if len(ids) > 1 else []
        forest = Forest(len(ids))
        for i, j in found:
            forest.join(i, j)
        members: dict[int, list] = {}
        for i in {i for link in found for i in link}:
            members.setdefault(forest.root(i), []).append(ids[i])
        stars = [(min(m), x) for m in members.values() for x in set(m) if x != min(m)]
        return pd.DataFrame({"a": [a for a, _ in stars], "b": [b for _, b in stars]}, dtype="int64")

    return members.groupBy(*keys).applyInPandas(run, "a bigint, b bigint")


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = landed(describe(rows, words, percent), "join-sets")
    classes = landed(described.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "join-classes")
    # signatures are shuffled once, with their ids: what two classes share is found where they meet, and joined there
    firsts = classes.select(F.col("rep").alias("doc_id"), "set_id")
    sigs = beside(described.select("doc_id", "set_id", "sigs"), firsts, firsts.count(), ["doc_id", "set_id"]).select(F.explode("sigs").alias("sig"), F.col("doc_id").alias("rep"))
    met = sigs.repartition("sig")
    shared = met.groupBy("sig").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("sig", "pivot")
    members = landed(met.join(shared.hint("shuffle_hash"), "sig").select("sig", "rep", "pivot"), "join-members")
    marks = beside(described.select("doc_id", "set_id", F.col("n_shingles").alias("n"), "bits"), firsts, firsts.count(), ["doc_id", "set_id"]).select(F.col("doc_id").alias("rep"), "n", "bits")
    marks = landed(marks.join(members.select("rep").distinct(), "rep", "left_semi").distinct(), "join-marks")
    stars = landed(_tested_stars(members.where("rep > pivot").select("rep", "pivot").distinct(), marks, percent), "join-stars")
    more = landed(_tested_segments(members, components(stars, "pivot", "rep"), marks, percent), "join-tested")
    blocks = components(stars.unionByName(more), "pivot", "rep").select(F.col("node").alias("rep"), F.col("root").alias("block"))
    blocks = blocks.join(classes.groupBy("rep").agg(F.sum("n").alias("n")), "rep")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("r"))).alias("p"))
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("w") / BLOCK_SHINGLES))).cast("int")
    blocks = landed(blocks.join(sizes.select("block", parts.alias("parts")), "block").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int")), "join-blocks")
    n_members = blocks.count()
    texts = landed(beside(rows.where("doc_id IS NOT NULL"), blocks.withColumnRenamed("rep", "doc_id"), n_members, ["doc_id"]).select("doc_id", "text", "block", "parts", "part"), "join-texts")

    # searches within parts; the smallest-hashed documents of a block stand in all of its parts
    several = texts.where("parts > 1")
    pivots = blocks.where("parts > 1").select("block", "parts", "rep", F.xxhash64("rep").alias("h"))
    nearest = pivots.groupBy("block", "parts").agg(F.min(F.struct("h", "rep")).alias("p0"), *[F.min(F.when(F.pmod("h", F.lit(PIVOTS)) == k, F.struct("h", "rep"))).alias(f"p{k + 1}") for k in range(PIVOTS)])
    nearest = nearest.select("block", F.explode(F.array(*[F.col(f"p{k}.rep") for k in range(PIVOTS + 1)])).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    everywhere = several.join(nearest, ["block", "doc_id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = texts.unionByName(everywhere.select(texts.columns)).withColumn("comp", F.col("doc_id")).withColumn("side", F.lit(0))
    links = landed(_search_groups(first, ["block", "part"], words, percent), "join-links")
    found = landed(components(links), "join-found")

    # blocks in several parts and still in several components: all pairs of their parts
    state = several.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")
    open_ = state.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("block")
    state = state.join(open_, "block")
    pairs = state.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part")
    pairs = pairs.select("block", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"), "doc_id", "text", "comp", (F.col("part") < F.col("other")).cast("int").alias("side"))
    more = landed(_search_groups(pairs, ["block", "p1", "p2"], words, percent), "join-more-links")
    found = found if more.isEmpty() else landed(components(links.unionByName(more)), "join-all-found")

    named = classes.select("set_id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("root", "rep").alias("comp"))
    out = described.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents of smallest doc_id in their component, with their columns. Rows that share an id share its fate.

    Documents without words, linked with nothing, and those without an id all stay.
    """
    gone = landed(similar_components(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "join-gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, docs["doc_id"] == gone["gone_id"], "left_anti")
