"""Substring dedup: paragraphs by MinHash bands and rare shingles, exact Jaccard, and components.

A text is a run of words, line ends being blanks like others, and is cut into paragraphs of LEAST_WORDS words at
least: around each sentence of so many words, between shorter sentences, and inside very long ones, where a hash
of the words around says so.  Every cut depends on words nearby alone, so that a passage is cut alike wherever
it stands, and every word of a text that is long enough is in one paragraph.  Equal paragraphs
share an id; those that may be similar to others meet in buckets of MinHash bands.  Among them, similar ones share
one of their rarest 5-word shingles, are verified by exact Jaccard similarity of these, and are clustered by
connected components.  In each cluster the first occurrence stays and the others are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm import similar as S
from codicil.llm.common import cut, dealt_anew, documents
from codicil.llm.ngram_join import row_key

LEAST_WORDS = 12
#: About so many shingles of paragraphs are in a block that is compared at once.
BLOCK_SHINGLES, BLOCK = 20_000, 512
#: Paragraphs are brought together by so many common shingles at most, more than one only where very many share one.
LEVELS = 3
#: Ids that a task remembers so that it sends the bands of a repeated paragraph about once.
MEMO_IDS = 300_000
#: Bytes of several texts that are cut up in one go.
BATCH_BYTES = 1 << 16

_IS_STOP, _IS_CLOSER = (np.isin(np.arange(256), list(x)) for x in (b".!?", b"\"')]"))


def unit_edges(hashes: np.ndarray, stops: np.ndarray, least_words: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the words at which paragraphs start, and the end, for texts one after the other.

    starts: the first words of the texts, which have `least_words` at least.  Sentences of that length are cut
    off; fewer words before one go with it, and those at a text's end with what is before.  Other stretches and
    sentences of twice that length are cut where the hash of the words around is the least nearby, ends of
    sentences coming first.
    """
    n, least = len(hashes), max(2, least_words)
    starts = np.zeros(1, np.int64) if starts is None else starts
    of_text = np.zeros(n + 1, bool)
    of_text[starts] = True
    of_text[n] = True
    at_end = np.zeros(n + 1, bool)
    at_end[1:] = stops
    ends = np.flatnonzero(at_end | of_text)
    long = np.flatnonzero(np.diff(ends) >= least)
    edge = of_text.copy()
    edge[ends[long]] = edge[ends[long + 1]] = True
    edges = np.flatnonzero(edge)
    # a short stretch goes with what follows, or at a text's end with what is before
    short, closes = np.diff(edges) < least, of_text[edges[1:]]
    opens = of_text[edges[:-1]]
    drop = np.zeros(len(edges), bool)
    drop[1:] |= short & ~closes
    drop[:-1] |= short & closes & ~opens
    edges = edges[~drop]
    sizes = np.diff(edges)
    if not (sizes >= 2 * least).any():
        return edges
    # keys[g]: of the gap before word g, the largest value where no cut may be
    place, sizes = np.arange(n) - np.repeat(edges[:-1], sizes), np.repeat(sizes, sizes)
    reach = least - 1
    keys = np.full(n + 2 * reach, np.uint64(2**64 - 1))
    at = np.flatnonzero((place >= least) & (place <= sizes - least))
    keys[at + reach] = (S.mixed(hashes[at - 1] * S._PLACES[0] + hashes[at] * S._PLACES[1]) >> np.uint64(1)) | np.where(stops[at - 1], np.uint64(0), np.uint64(2**63))
    best = at
    for k in range(1, reach + 1):
        own = keys[best + reach]
        best = best[(own < keys[best + reach - k]) & (own <= keys[best + reach + k])]
    edge = np.zeros(n + 1, bool)
    edge[edges] = edge[best] = True
    return np.flatnonzero(edge)


class Units:
    """The paragraphs of some texts: of which text, start and end in code points, words, id, and their shingles."""

    def __init__(self, texts: list[bytes], least_words: int):
        b = np.frombuffer(b"\n".join(texts), np.uint8)
        first, last = S.word_bounds(b)
        text_at = np.cumsum([0] + [len(t) + 1 for t in texts])
        n = np.diff(np.searchsorted(first, text_at))
        use = n >= max(1, least_words)
        if not use.all():
            first, last = first[np.repeat(use, n)], last[np.repeat(use, n)]
        hashes, starts, use = S.hashed_words(b, first, last), np.cumsum(n[use]) - n[use], np.flatnonzero(use)
        stops = _IS_STOP[b[last]] | (_IS_CLOSER[b[last]] & _IS_STOP[b[np.maximum(last - 1, first)]])
        edges = unit_edges(hashes, stops, least_words, starts) if len(use) else np.zeros(1, np.int64)
        a, e = edges[:-1], edges[1:]
        self.text, self.words = use[np.searchsorted(starts, a, side="right") - 1] if len(use) else use, e - a
        self.start, self.end = first[a], last[e - 1]
        if (b >= 128).any():
            points = np.cumsum((b & 0xC0) != 0x80, dtype=np.int32).astype(np.int64) - 1
            before = points[text_at[self.text]]
            self.start, self.end = points[self.start] - before, points[self.end] - before
        else:
            self.start, self.end = self.start - text_at[self.text], self.end - text_at[self.text]
        self.end = self.end + 1
        self.id = self._ids(hashes, a, self.words)
        # the shingles of all paragraphs, and where each one's begin
        width = np.minimum(S.WORDS_PER_SHINGLE, self.words)
        m = self.words - width + 1
        self.begin = np.cumsum(m) - m
        if least_words >= S.WORDS_PER_SHINGLE:
            at = np.arange(int(m.sum())) + np.repeat(a - self.begin, m)
            self.shingles = S.shingles(hashes)[at] if len(at) else hashes[:0]
        else:
            self.shingles = np.concatenate([S.shingles(hashes[i:j]) for i, j in zip(a, e, strict=True)] or [hashes[:0]])

    @staticmethod
    def _ids(hashes: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Two 64-bit sums over each run of words of what a hash makes of a word and its place."""
        place = (np.arange(len(hashes)) - np.repeat(a, n)).astype(np.uint64) if len(a) else hashes[:0]
        sums = np.empty((len(a), 2), np.uint64)
        for k in range(2 if len(a) else 0):
            sums[:, k] = np.add.reduceat(S.mixed(hashes * S._PLACES[2 + k] + (place + np.uint64(1)) * S._PLACES[4 + k]), a)
        return sums


def paragraphs(text: str | None, least_words: int = LEAST_WORDS) -> list[tuple[int, int, str, int]]:
    """(start, end, text, words) of the paragraphs, in code points, without white space around; shorter texts have none."""
    u = Units([(text or "").encode("utf-8", "surrogatepass")], least_words)
    return [(s, e, text[s:e], n) for s, e, n in zip(u.start.tolist(), u.end.tolist(), u.words.tolist(), strict=True)]


def in_batches(batches, column: int):
    """Some rows at a time, and the texts in their column as bytes; a text is never split."""
    for b in batches:
        at, texts, total = 0, [], 0
        for i, text in enumerate(b.column(column)):
            texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
            total += len(texts[-1])
            if total >= BATCH_BYTES or i == b.num_rows - 1:
                yield b.slice(at, len(texts)), texts
                at, texts, total = i + 1, [], 0


def occurrences(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, row, key, start, end, words, id): a row for each paragraph of each row (doc_id, row, key, text).

    Equal runs of words have equal ids.
    """

    def rows(batches):
        for b, texts in in_batches(batches, 3):
            u = Units(texts, least_words)
            ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(u.id), [None, pa.py_buffer(u.id.astype(">u8").tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(u.text)) for c in b.columns[:3]), pa.array(u.start), pa.array(u.end), pa.array(u.words), ids], names=["doc_id", "row", "key", "start", "end", "words", "id"])

    return docs.select("doc_id", "row", "key", "text").mapInArrow(rows, "doc_id long, row long, key long, start long, end long, words long, id binary")


def banded(docs: DataFrame, least_words: int, bands: int, per_band: int) -> DataFrame:
    """(bucket, key): the bands of each paragraph, those of a repeated one about once per task; key: half of its id."""

    def rows(batches):
        seen: set[int] = set()
        for _, texts in in_batches(batches, 0):
            u = Units(texts, least_words)
            lane, new = u.id[:, 0].tolist(), np.zeros(len(u.id), bool)
            for i, x in enumerate(lane):
                if x not in seen:
                    if len(seen) >= MEMO_IDS:
                        seen.clear()
                    seen.add(x)
                    new[i] = True
            if new.any():
                buckets = S.band_keys(S.minhash(u.shingles, bands * per_band, u.begin), bands, per_band)[new]
                yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(np.repeat(u.id[new, 0].view(np.int64), bands))], names=["bucket", "key"])

    return docs.select("text").mapInArrow(rows, "bucket long, key long")


def collisions(dealt: DataFrame) -> DataFrame:
    """(key): the keys in buckets with two different keys at least, from rows (bucket, key) sorted by both.

    The rows stream through; only the bucket's first key waits for a second one.  A key comes once a bucket.
    """

    def rows(batches):
        bucket = first = last = None
        shared = False
        for b in batches:
            buckets, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            # a row matters if its bucket is the same as that of the row before or after
            same = buckets[1:] == buckets[:-1]
            near = np.concatenate([[True], same]) | np.concatenate([same, [True]])
            out = []
            for k, x in zip(buckets[near].tolist(), keys[near].tolist(), strict=True):
                if k != bucket:
                    bucket, first, last, shared = k, x, x, False
                elif x != last:
                    last = x
                    if not shared:
                        out.append(first)
                        shared = True
                    out.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["key"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(rows, "key long")


def shingled(texts: DataFrame) -> DataFrame:
    """(id, set, shingles) of texts (id, text): the different shingles, and an id of them."""

    def rows(batches):
        for b in batches:
            sets = list(S.shingle_sets(b.column(1)))
            ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(S.set_id, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "set", "shingles"])

    return texts.select("id", "text").mapInArrow(rows, "id binary, set binary, shingles array<long>")


def ranked(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, least, room, rare) of those sets (id, shingles) that may be similar to another one.

    n: shingles; least: how many of them a similar set has at least; rare: those that other sets have too, rarest
    first.  Of `n - least + k` shingles in one order of all, similar sets have k in common, if they have as many at
    all; n - size(rare) of them, which come first, are in no other set, so that the first room + k of rare are left.
    """
    n = F.size("shingles")
    each = sets.select("id", n.alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    own = each.join(often.select(dealt_anew("s", "long"), "f"), "s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s")))["s"].alias("rare"))
    least = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    return own.withColumn("least", least).withColumn("room", F.size("rare") - F.col("least")).filter("room >= 0").select("id", "n", "least", "room", "rare")


def sharing(units: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, id, blocks) of the groups of units of ranked() in which all similar ones meet, and of those of several blocks.

    Units meet by a shingle; where more than a block share it, by it and another one that similar ones must share
    too, and so on.  Of groups with the same members one is looked at.
    """
    now = units.select("id", "n", F.explode(F.slice("rare", 1, F.col("room") + 1)).alias("s")).select("id", "n", F.array("s").alias("by"))
    members = [F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit("x"), "id")).alias("xor")]
    small = None
    for level in range(2, LEVELS + 2):
        now = now.withColumn("bucket", F.xxhash64("by"))
        sizes = now.groupBy("bucket").agg(*members, F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")).filter("size > 1")
        sizes = sizes.groupBy("size", "sum", "xor").agg(F.min("bucket").alias("bucket"), F.first("blocks").alias("blocks"))
        now = cut(now.join(sizes.select(dealt_anew("bucket", "long"), "blocks"), "bucket"), "sharing")
        one, large = now.filter("blocks = 1").select("bucket", "id", "blocks"), now.filter("blocks > 1")
        small = one if small is None else small.unionByName(one)
        if large.isEmpty():
            return small, None
        if level > LEVELS:
            break
        again = large.join(units.select(dealt_anew("id"), "least", "room", "rare"), "id")
        more = again.select("id", "n", "by", F.explode(F.array_except(F.slice("rare", 1, F.col("room") + level), F.col("by"))).alias("s"))
        more = more.select("id", "n", F.array_sort(F.concat("by", F.array("s"))).alias("by")).distinct()
        # sets of fewer shingles than that are similar to others by fewer
        now = more.unionByName(again.filter(F.col("least") < level).select("id", "n", "by"))
    return small, large.select("bucket", "id", "blocks")


def linked(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, root) of the sets (id, set, shingles) that are linked to others: those of equal sets, and of similar ones.

    A group of several blocks first has each block by itself and with the first one, which links those that are all
    alike.  Then what is not in the group's largest component is compared with all of the group, so that rows
    grow with the square of a group's size only if its sets share LEVELS rare shingles and yet are not linked.
    """
    firsts = cut(sets.groupBy("set").agg(F.min("id").alias("id"), F.first("shingles").alias("shingles"), F.count("*").alias("copies")), "sets")
    equal = sets.join(firsts.filter("copies > 1").select(dealt_anew("set"), F.col("id").alias("b")), "set").select(F.col("id").alias("a"), "b")
    units = cut(ranked(firsts, threshold), "ranked")
    small, large = sharing(units)
    shingles = firsts.join(units.select("id"), "id", "left_semi").select(dealt_anew("id"), "shingles")
    found = lambda placed: verified_edges(S.together(placed.join(shingles, "id"), "bucket"), threshold)
    one = small.select("bucket", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("mine"), "id")
    if large is None:
        return S.components(found(one).unionByName(equal))
    d = large.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    first = d.withColumn("other", F.explode(F.when(F.col("mine") == 0, F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array(F.lit(0), F.col("mine")))))
    first = first.select("bucket", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine", "id")
    roots = cut(S.components(found(one.unionByName(first)).unionByName(equal)), "roots")
    d = large.join(roots.select(dealt_anew("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    parts = cut(d.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.first("blocks").alias("blocks")), "parts")
    main = parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.first("blocks").alias("blocks")).filter("n > main.n")
    if main.isEmpty():
        return roots
    # blocks of what is apart come first, those of the largest component after them
    of = lambda n: F.ceil(F.col("blocks") * n / F.col("n")).cast("int")
    main = main.select(dealt_anew("bucket", "long"), F.col("main.root").alias("main"), of(F.col("n") - F.col("main.n")).alias("apart"), of(F.col("main.n")).alias("within"))
    d = d.select("bucket", "id", "root").join(main, "bucket").withColumn("inside", F.col("root") == F.col("main"))
    d = d.withColumn("mine", F.when(F.col("inside"), F.col("apart") + F.pmod(F.xxhash64("id"), F.col("within").cast("long"))).otherwise(F.pmod(F.xxhash64("id"), F.col("apart").cast("long"))).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("apart") + F.when(F.col("inside"), 0).otherwise(F.col("within")) - 1)))
    rest = d.select("bucket", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine", "id")
    return S.components(found(rest).unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))


def verified_edges(blocks: DataFrame, threshold: float) -> DataFrame:
    """A forest of the pairs whose Jaccard similarity reaches the threshold, from (bucket, bi, bj, mine, id, shingles)."""

    def arrays(column):
        values, ends = column.values.to_numpy(), column.offsets.to_numpy().tolist()
        for lo, hi in zip(ends, ends[1:], strict=False):
            yield values[lo:hi]

    def rows(batches):
        a, b = [], []
        for group in S.block_groups(batches, 3, arrays):
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
            sets = [r[5] for r in group]
            if len(group) == 2:  # most are
                shared = len(np.intersect1d(*sets, assume_unique=True))
                if shared >= threshold * (len(sets[0]) + len(sets[1]) - shared):
                    a.append(group[0][4])
                    b.append(group[1][4])
                continue
            exact, forest, n = S.ExactJaccard(sets), S.Forest(len(group)), np.array([len(s) for s in sets])
            for i, others in enumerate(S.pairs_to_check(group, 1, 2, 3)):
                others = forest.apart(i, others)
                others = others[(n[others] >= threshold * n[i]) & (n[i] >= threshold * n[others])]
                if not len(others):
                    continue
                for j in others[exact.with_(i, others) >= threshold]:
                    if forest.join(i, int(j)):
                        a.append(group[i][4])
                        b.append(group[j][4])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return blocks.select("bucket", "bi", "bj", "mine", "id", "shingles").mapInArrow(rows, "a binary, b binary")


def duplicate_paragraphs(docs: DataFrame, threshold: float = S.THRESHOLD, least_words: int = LEAST_WORDS, recall: float = 0.996) -> DataFrame:
    """A row for each occurrence of a paragraph that has another occurrence like it, in any row of docs.

    doc_id, start, end (code points of the text, end exclusive), words, class_doc_id and class_start (the
    cluster's first occurrence by doc_id, then start), n_occurrences of the cluster, removed (false for the
    first occurrence alone) and text_key, which is the same for equal rows of docs.  Null and empty texts and those
    of fewer words give no rows, documents without repeated paragraphs none either.  Repeated rows of docs are
    occurrences of their own: where the first occurrence ties with those of equal rows, one of them stays and
    the others are removed.  Different texts may have one doc_id, or none; a null doc_id comes first.  Very long
    texts are read whole.  An empty table gives no rows.  Only doc_id and text are read, so other columns'
    names do not matter.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), row_key().alias("key"), "text")
    bands, per_band = S.tuned_bands(threshold, recall)
    # half an id will do to find candidates: different ids with one half are all taken for it
    met = cut(collisions(banded(d, least_words, bands, per_band)), "collisions")
    found = cut(occurrences(d, least_words), "paragraphs")  # rows have their numbers from here on
    half = F.conv(F.hex(F.substring("id", 1, 8)), 16, -10).cast("long")
    sets = found.groupBy("id").agg(F.count("*").alias("n")).withColumn("key", half)
    sets = sets.join(met.distinct().select(dealt_anew("key", "long"), F.lit(True).alias("met")), "key", "left").filter("n > 1 OR met")
    sets = cut(sets.select("id", "n", F.coalesce("met", F.lit(False)).alias("met")), "paragraph-sets")
    held = cut(found.join(sets.select("id"), "id"), "paragraphs-held")
    # whose text: one occurrence of each colliding paragraph, taken out of its row's text
    wanted = held.join(sets.filter("met").select(dealt_anew("id")), "id").groupBy("id").agg(F.min(F.struct("key", "start", "end")).alias("at"))
    of_row = wanted.groupBy(F.col("at.key").alias("_key")).agg(F.collect_list(F.struct("id", "at.start", "at.end")).alias("of"))
    texts = docs.select(row_key().alias("key"), "text").join(of_row.select(dealt_anew("_key", "long"), "of"), F.col("key") == F.col("_key"))
    texts = texts.select("text", F.explode("of").alias("o")).select("o.id", F.expr("substring(text, cast(o.start as int) + 1, cast(o.end - o.start as int))").alias("text"))
    roots = linked(cut(shingled(texts.groupBy("id").agg(F.min("text").alias("text"))), "paragraphs-wanted"), threshold)
    clustered = sets.join(roots, "id", "left").filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "id"))
    clusters = clustered.groupBy("root").agg(F.sum("n").alias("n_occurrences")).filter("n_occurrences > 1")
    named = cut(clustered.select("id", "root").join(clusters.select(dealt_anew("root"), "n_occurrences"), "root"), "clusters")
    out = held.join(named, "id")
    kept = cut(out.groupBy("root").agg(F.min(F.struct("doc_id", "start", "end", "row")).alias("kept")), "kept")
    named = named.join(kept, "root").select("id", "n_occurrences", "kept")
    return held.join(named.select(dealt_anew("id"), "n_occurrences", "kept"), "id").select(
        "doc_id", "start", "end", "words", F.col("kept.doc_id").alias("class_doc_id"), F.col("kept.start").alias("class_start"), "n_occurrences",
        ((F.col("kept.row") != F.col("row")) | (F.col("kept.start") != F.col("start"))).alias("removed"), F.col("key").alias("text_key"),
    )


def without_duplicates(docs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """docs with removed paragraphs taken out of `text`; other columns and rows stay as they are.

    duplicates: of duplicate_paragraphs(docs).  Of equal rows, one keeps what any of them keeps.  Null and empty
    texts stay.  Column names of docs may be any; an empty table gives none.
    """
    spans = duplicates.groupBy("text_key", "start", "end").agg(F.min("removed").alias("always"), F.max("removed").alias("ever")).filter("ever")
    spans = spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "always"))).alias("spans"))
    held = cut(docs.select(row_key().alias("key"), F.monotonically_increasing_id().alias("number"), F.struct(*docs.columns).alias("row")), "rows")  # rows have their numbers from here on
    stays = held.join(spans.select("text_key"), F.col("key") == F.col("text_key"), "left_semi").groupBy("key").agg(F.min("number").alias("first"))
    held = held.join(spans.join(stays, F.col("key") == F.col("text_key")).select(dealt_anew("text_key", "long"), "first", "spans"), F.col("key") == F.col("text_key"), "left")
    text = F.col("row.text")
    piece = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
    end = F.struct(F.length(text).cast("long").alias("start"), F.length(text).cast("long").alias("end"), F.lit(True).alias("always"))
    taken = F.filter("spans", lambda s: s["always"] | (F.col("number") != F.col("first")))
    kept = F.aggregate(
        F.concat(taken, F.array(end)),
        F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["t"], piece(acc["at"], s["start"])).alias("t"), s["end"].alias("at")),
        lambda acc: acc["t"],
    )
    return held.select(*[F.when(F.col("spans").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_paragraphs(documents(spark, sf_dir))
