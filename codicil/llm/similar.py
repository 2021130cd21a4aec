"""Shingles, MinHash bands, block-wise verification and connected components.

Units (documents or paragraphs) are first brought together by equal shingle sets, so a group of copies is
one unit whatever its size.  Band keys bring similar units into buckets.  A bucket larger than a block is
dealt as pairs of blocks, so a task holds two blocks at most, and what a block yields is a forest of edges
and counts, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.llm.common import dealt_anew, discard, written

WORDS_PER_SHINGLE = 5
THRESHOLD = 0.8
ID_BYTES = 12
#: Bytes of text whose words are hashed in one go.
SLICE_BYTES = 1 << 16

_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last byte of each word; words are runs of other than ASCII white space, as bytes.split() has them."""
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~_BLANK[b]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2] - 1


def hashed_words(b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: of the sum of what a hash makes of its bytes and their places, some bytes at a time."""
    out, lo = np.empty(len(first), np.uint64), 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + SLICE_BYTES)))
        part, starts = b[first[lo] : last[hi - 1] + 1], first[lo:hi] - first[lo]
        place = np.arange(len(part)) - np.repeat(starts, np.diff(starts, append=len(part)))
        x = mixed(((place << 8) | part).astype(np.uint64) * _PLACES[6] + _PLACES[7])
        x[_BLANK[part]] = 0
        out[lo:hi] = mixed(np.add.reduceat(x, starts))
        lo = hi
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return hashed_words(b, *word_bounds(b))


def shingles(hashes: np.ndarray, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Hashes of the n-word runs in order; of fewer words than n, one of all of them."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * _PLACES[k]
    return mixed(out)


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles of a text, sorted."""
    s = shingles(word_hashes(text))
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def shingle_sets(column):
    """shingle_set() of each text of an Arrow column, in turn; some texts are hashed in one go."""
    texts, total = [], 0
    for i, text in enumerate(column):
        texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
        total += len(texts[-1])
        if total >= SLICE_BYTES or i == len(column) - 1:
            b = np.frombuffer(b"\n".join(texts), np.uint8)
            first, last = word_bounds(b)
            hashes = hashed_words(b, first, last)
            ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts])).tolist()
            every = shingles(hashes) if len(hashes) >= WORDS_PER_SHINGLE else hashes[:0]
            for lo, hi in zip([0, *ends], ends, strict=False):
                s = np.sort(every[lo : hi - WORDS_PER_SHINGLE + 1] if hi - lo >= WORDS_PER_SHINGLE else shingles(hashes[lo:hi]))
                again = s[1:] == s[:-1]
                yield s[np.concatenate([[True], ~again])] if again.any() else s
            texts, total = [], 0


def set_id(sorted_shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_shingles.tobytes(), digest_size=ID_BYTES).digest()


@lru_cache
def _factors(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**32, k, np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, np.uint32)


def minhash(hashes: np.ndarray, k: int, starts: np.ndarray | None = None) -> np.ndarray:
    """(k, units) minima in 32 bits of the shingles, a unit being a run of shingles that begins at one of `starts`.

    One hash function after the other goes over all shingles in one buffer, so memory grows with those alone.
    """
    a, b = _factors(k)
    starts = np.zeros(1, np.int64) if starts is None else starts
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    hashed, out = np.empty_like(x), np.empty((k, len(starts)), np.uint32)
    for i in range(k):
        np.multiply(x, a[i], out=hashed)
        np.add(hashed, b[i], out=hashed)
        np.minimum.reduceat(hashed, starts, out=out[i])
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(units, bands) keys from (k, units) minima; a band's number is part of its key."""
    of = minima[: bands * rows].reshape(bands, rows, -1).astype(np.uint64)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], of.shape[2], axis=1)
    for i in range(rows):
        keys = mixed(keys * _PLACES[0] + of[:, i])
    return np.ascontiguousarray(keys.T).view(np.int64)


def tuned_bands(threshold: float = THRESHOLD, recall: float = 0.996, unlike: float = 0.1, false: float = 0.07) -> tuple[int, int]:
    """(bands, rows): the fewest hashes so that pairs at the threshold share a band with probability `recall`
    at least, and pairs at similarity `unlike` with probability `false` at most."""
    found = []
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - unlike**rows) ** bands <= false:
            found.append((bands * rows, bands, rows))
    return min(found)[1:]


def list_array(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(matrix.ravel(), kind))


def shared_buckets(units: DataFrame) -> DataFrame:
    """(bucket, id, size) of buckets that at least two of the units (id, bands) are in."""
    dealt = units.select(F.explode("bands").alias("bucket"), "id")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return dealt.join(sizes.select(dealt_anew("bucket", "long"), "size"), "bucket")


def in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """members (group, id, ...) as rows of pairs of blocks: columns bi <= bj, and mine, the row's own.

    blocks: how many the row's group is split into, by a hash of the id.  A group of one block is the pair
    (0, 0); a row of a larger one goes to as many pairs as there are blocks.
    """
    n = F.greatest(F.lit(1), blocks).cast("int")
    d = members.withColumn("_n", n).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("_n").cast("long")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.withColumn("bi", F.least("mine", "_other")).withColumn("bj", F.greatest("mine", "_other")).drop("_other", "_n")


def together(blocks: DataFrame, group: str) -> DataFrame:
    """Rows of in_blocks(), each pair of blocks side by side in one task."""
    return blocks.repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", "id")


class Forest:
    """Which trees positions are in, as labels, so that many are looked up at once."""

    def __init__(self, n: int):
        self.tree = np.arange(n)

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that are in other trees than i."""
        return others[self.tree[others] != self.tree[i]]

    def join(self, i: int, j: int) -> bool:
        a, b = self.tree[i], self.tree[j]
        if a == b:
            return False
        self.tree[self.tree == max(a, b)] = min(a, b)
        return True


def block_groups(batches, keys: int, last=None):
    """Rows, as tuples, of each run of equal first `keys` columns, however runs and batches fall.

    last: what becomes of the last column's values, in turn, before the run's next row is looked at.
    """

    def rows():
        for b in batches:
            columns = [c.to_pylist() for c in (b.columns[:-1] if last else b.columns)]
            if last:
                columns.append(last(b.column(b.num_columns - 1)))
            yield from zip(*columns, strict=True)

    for _, run in groupby(rows(), key=lambda r: r[:keys]):
        yield list(run)


def pairs_to_check(group: list[tuple], bi: int, bj: int, mine: int) -> list[np.ndarray]:
    """For each row, the later rows that it is to be compared with: all in a block by itself, else those across.

    bi, bj, mine: places of these columns in the rows.
    """
    n = len(group)
    if group[0][bi] == group[0][bj]:
        return [np.arange(i + 1, n) for i in range(n)]
    side = np.array([r[mine] for r in group])
    return [i + 1 + np.flatnonzero(side[i + 1 :] != side[i]) for i in range(n)]


@lru_cache
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest equal MinHash values out of `compared` with which a pair stays.

    With a uniform prior, the probability that the similarity reaches the threshold after m of n matches is
    that of at most m successes in n + 1 trials of the threshold; below the tolerance the pair is dropped.
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared + 1


def still_likely(signatures: np.ndarray, i: int, others: np.ndarray, threshold: float, tolerance: float, step: int = 16) -> np.ndarray:
    """Those of `others` that stay likely to be similar to row i, comparing `step` values at a time."""
    matches = np.zeros(len(others), np.int64)
    for lo in range(0, signatures.shape[1], step):
        if not len(others):
            break
        matches += (signatures[others, lo : lo + step] == signatures[i, lo : lo + step]).sum(axis=1)
        stay = matches >= least_matches(min(lo + step, signatures.shape[1]), threshold, tolerance)
        others, matches = others[stay], matches[stay]
    return others


class ExactJaccard:
    """Exact similarities of one row's set with others', by marks over the sets' joint values."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        values, self.places = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.array([]), np.array([], int))
        self.ends = np.cumsum(self.n)
        self.marks = np.zeros(len(values), bool)

    def _own(self, i: int) -> np.ndarray:
        return self.places[self.ends[i] - self.n[i] : self.ends[i]]

    def with_(self, i: int, others: np.ndarray) -> np.ndarray:
        self.marks[self._own(i)] = True
        if len(others) * 4 < len(self.n):
            shared = np.array([np.count_nonzero(self.marks[self._own(j)]) for j in others], np.int64)
        else:
            counted = np.concatenate([[0], np.cumsum(self.marks[self.places])])
            shared = (counted[self.ends] - counted[self.ends - self.n])[others]
        self.marks[self._own(i)] = False
        return shared / np.maximum(1, self.n[i] + self.n[others] - shared)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, root) of all ids in the edges (a, b): root is the least id of the component.

    Large-star and small-star steps in turn: each links an id's neighbours to the least of them, so trees
    flatten while components stay, and the edges never grow in number.  Every round is written to the
    shared folder, and the one before removed.  It ends when a round changes nothing, and raises if none of
    `rounds` does (they grow with the logarithm of the ids).  An id with very many neighbours is joined by a
    shuffle of its own, which Spark splits.
    """
    spark = edges.sparkSession

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("_least")).withColumn("_least", F.least("a", "_least"))
        near = near.join(least.select(dealt_anew("a"), "_least"), "a")
        if large:
            return near.filter("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b")).distinct()
        own = least.select("a", F.col("_least").alias("b"))
        return near.filter("b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b")).unionByName(own).filter("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e, path = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(e)
    for _ in range(rounds if before[0] else 0):
        e, new = written(stars(stars(e, True), False), "edges")
        discard(spark, path)
        path, now = new, state(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components not found in {rounds} rounds")
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
