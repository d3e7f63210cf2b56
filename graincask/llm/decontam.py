"""Benchmark decontamination with an FM-index per training shard.

A shard is about a MB of documents. All its words are indexed: a wavelet matrix over the Burrows-Wheeler transform of the texts, each ended by a separator of its own, with ranks over packed bits, and the suffix positions at
samples only. All windows of all items are searched backwards at once; occurrences are located by walking to a sampled position, whose place among the samples is a rank too, and their spans merge per document.
The index takes about 8 bytes a word (FMIndex.size); a shard's index is dropped before the next is built.

The items are searched in blocks of at most BLOCK_BYTES of text, which is what the driver holds and sends to all tasks at a time. With one block, documents are read once. A larger benchmark takes a pass per block, whose
hits alone are kept, before a last pass in place (see inplace) merges them; documents are never moved.

Defined results: a null text has no words, and neither hits nor is hit. An item of fewer words than a window is one window; one without words is never found. Items
that share a window are all found by it; repeated item ids count once. Repeated documents give repeated rows, a null doc_id stays null. Item ids are sorted as strings; a null
item id is ignored. An empty benchmark hits nothing. Columns of documents pass through remove() whatever their names; search() refuses to keep one that is named as a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm import inplace
from graincask.llm.common import settle, table
from graincask.llm.words import NOT_ALNUM, Splitter, chunks, string_bytes

WINDOW = 10
SHARD_BYTES, BLOCK_BYTES = 1 << 20, 4 << 20
#: Every so many positions of a shard a suffix position is kept.
SAMPLE = 16


class Ranks:
    """Bits, packed, with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.total = int(self.before[-1])

    def at(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0

    @property
    def size(self) -> int:
        return self.words.nbytes + self.before.nbytes


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order. 0 is a separator: smaller than all others, and each unlike any other, by place.

    The first keys are as many symbols as fit 62 bits; then only suffixes that still tie are sorted again, by twice the width each time.
    """
    n = len(symbols)
    gaps = np.flatnonzero(symbols == 0)
    value = symbols.astype(np.int64) + len(gaps) + 1
    value[gaps] = np.arange(1, len(gaps) + 1)
    bits = int(value.max()).bit_length()
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= value[k:]
    order = np.argsort(key)

    def heads(places: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places of the order, in runs that begin where fresh: the place where each one's run begins, and which runs are longer than one."""
        begins = np.flatnonzero(fresh)
        length = np.diff(np.append(begins, len(places)))
        return np.repeat(places[begins], length), np.repeat(length > 1, length)

    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first, tied = heads(np.arange(n), fresh)
    rank[order] = first
    open_ = np.flatnonzero(tied)
    while len(open_):
        some = order[open_]
        one, two = rank[some], rank[np.minimum(some + width, n)]
        by = np.lexsort((two, one))
        some, one, two = some[by], one[by], two[by]
        order[open_] = some
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first, tied = heads(open_, fresh)
        rank[some] = first
        open_ = open_[tied]
        width *= 2
    return order


class FMIndex:
    """Index of a sequence of symbols; 0 is a separator that no pattern holds, and each separator is unlike any other. The last symbol must be one."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = self.n = len(symbols)
        order = sorted_suffixes(symbols)
        previous = symbols[order - 1]
        previous[order == 0] = 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))  # suffixes that start with a smaller symbol
        # samples: each SAMPLE-th position and each start of a text, so that a walk never meets a separator
        sampled = (order % SAMPLE == 0) | (previous == 0)
        self.sampled, self.positions = Ranks(sampled), order[sampled].astype(np.int32)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Ranks, int]] = []
        level = previous.astype(np.uint16 if sigma <= 1 << 16 else np.uint32)
        for b in range(self.bits - 1, -1, -1):
            bit = (level & level.dtype.type(1 << b)).astype(bool)
            ranks = Ranks(bit)
            self.levels.append((ranks, n - ranks.total))
            level = np.concatenate((level[~bit], level[bit]))
        self.origin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    @property
    def size(self) -> int:
        """Bytes of all that is kept."""
        return self.first.nbytes + self.origin.nbytes + self.positions.nbytes + self.sampled.size + sum(r.size for r, _ in self.levels)

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, (ranks, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = ranks.at(at)
            at = np.where((symbols >> b) & 1, zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the suffixes that start with each symbol before those at each place begin."""
        return self.first[symbols] + self._down(symbols, at) - self.origin[symbols]

    def before(self, at: np.ndarray) -> np.ndarray:
        """The symbol before the suffix at each place."""
        out = np.zeros(len(at), np.int64)
        for ranks, zeros in self.levels:
            bit = ranks.get(at)
            ones = ranks.at(at)
            out = out * 2 + bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern numbers and positions of all occurrences; patterns: a row each, all of one length."""
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        alive = np.flatnonzero(low < high)
        low, high = low[alive], high[alive]
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[alive, k]
            both = self.step(np.concatenate((c, c)), np.concatenate((low, high)))
            low, high = both[: len(c)], both[len(c) :]
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                return alive, alive
        count = high - low
        which = np.repeat(alive, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        walked, walking = np.zeros(len(at), np.int64), np.flatnonzero(~self.sampled.get(at))
        while len(walking):
            at[walking] = self.step(self.before(at[walking]), at[walking])
            walked[walking] += 1
            walking = walking[~self.sampled.get(at[walking])]
        return which, self.positions[self.sampled.at(at)] + walked


class Patterns:
    """Windows of a block of items: vocabulary, and by length the windows as places in the vocabulary with the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        split = Splitter(NOT_ALNUM, lower=True)
        data, offsets = string_bytes(pa.array([t or "" for _, t in items], pa.string()))
        _, _, hashes, firsts = split.words(data, offsets)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        lengths = np.minimum(window, np.diff(firsts))
        self.groups: list[tuple[int, np.ndarray, list[list[str]]]] = []
        for size in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == size)
            count = np.diff(firsts)[own] - size + 1
            starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(firsts[own], count)
            windows, which = np.unique(ids[starts[:, None] + np.arange(size)], axis=0, return_inverse=True)
            found: list[set[str]] = [set() for _ in windows]
            for w, item in zip(which.ravel().tolist(), np.repeat(own, count).tolist(), strict=True):
                found[w].add(items[item][0])
            self.groups.append((size, windows, [sorted(x) for x in found]))

    def occurrences(self, hashes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[list[str]]]]:
        """Per length of window: window numbers and word positions of the occurrences in a shard, the length, the windows' items."""
        if not self.groups or not len(hashes):
            return
        ids, words = pd.factorize(hashes)
        texts = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        symbols = np.zeros(len(hashes) + len(firsts) - 1, np.int64)
        symbols[np.arange(len(hashes)) + texts] = ids + 1
        index = FMIndex(symbols, len(words) + 1)
        by = np.argsort(words)
        at = np.minimum(np.searchsorted(words[by], self.vocabulary), len(words) - 1)
        here = np.where(words[by][at] == self.vocabulary, by[at] + 1, 0)  # symbols of the items' words, 0 where the shard has none
        for size, windows, items in self.groups:
            patterns = here[windows]
            some = np.flatnonzero((patterns > 0).all(axis=1))
            if not len(some):
                continue
            which, place = index.find(patterns[some])
            if len(which):
                # a separator stands after each text before the place
                text = np.searchsorted(firsts[1:] + np.arange(1, len(firsts)), place, "right")
                yield some[which], place - text, size, items


def _found(own: Patterns, split: Splitter, batch: pa.RecordBatch) -> tuple[list[int], list[list[int]], list[list[int]], list[list[str]]]:
    """Of each row: words, starts and ends of the merged spans of hit words, and sorted items."""
    counts, starts, ends, found = [], [], [], []
    for first, end, data, offsets in chunks(batch, "text", SHARD_BYTES):
        _, _, hashes, firsts = split.words(data, offsets)
        cover = np.zeros(len(hashes) + 1, np.int32)
        of: dict[int, set[str]] = defaultdict(set)
        for which, at, size, items in own.occurrences(hashes, firsts):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            docs = np.searchsorted(firsts, at, "right") - 1
            for d, w in np.unique(np.stack((docs, which), 1), axis=0).tolist():
                of[d].update(items[w])
        hit = np.cumsum(cover[:-1]) > 0
        for i in range(end - first):
            a, b = int(firsts[i]), int(firsts[i + 1])
            counts.append(b - a)
            flags = np.diff(hit[a:b].astype(np.int8), prepend=0, append=0) if i in of else np.empty(0)
            starts.append(np.flatnonzero(flags == 1).tolist())
            ends.append(np.flatnonzero(flags == -1).tolist())
            found.append(sorted(of[i]) if i in of else [])
    return counts, starts, ends, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as few as possible, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[tuple[str, str | None]], int]]:
    """Items in blocks of about so many bytes, one block at a time on the driver, and the number of blocks."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        block = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in block.collect()], n


_HITS = "part int, key long, starts array<int>, ends array<int>, items array<string>"
_SPANS = pa.list_(pa.int32())


def located(rows: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Callable]:
    """rows (with text, never null) or the same rows pinned, and a function that gives a function of a batch of them: words, starts, ends and items of each row."""
    context, hits, given = rows.sparkSession.sparkContext, [], None
    for items, n in _blocks(benchmark, item_col, item_text_col, block_bytes):
        patterns = context.broadcast(Patterns(items, window))
        if n == 1:

            def start() -> Callable:
                split, own = Splitter(NOT_ALNUM, lower=True), patterns.value
                return lambda batch: _found(own, split, batch)

            return rows, start
        given = given or inplace.pinned(rows.withColumn("key", F.xxhash64("text")))

        def search_block(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            split, own = Splitter(NOT_ALNUM, lower=True), patterns.value
            for batch in batches:
                _, starts, ends, found = _found(own, split, batch)
                some = pa.array([i for i, x in enumerate(found) if x], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, _SPANS), pa.array(ends, _SPANS), pa.array(found, pa.list_(pa.string()))], names=["part", "key", "starts", "ends", "items"]).take(some)

        hits.append(settle(given.rows.select("part", "key", "text").mapInArrow(search_block, _HITS)))
        patterns.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    filed = inplace.file_away(every.groupBy("part", "key").agg(F.collect_list(F.struct("starts", "ends", "items")).alias("hits")))

    def look() -> Callable:
        split, known = Splitter(NOT_ALNUM, lower=True), {}

        def of(batch: pa.RecordBatch) -> tuple[list[int], list[list[int]], list[list[int]], list[list[str]]]:
            counts = []
            for _, _, data, offsets in chunks(batch, "text", SHARD_BYTES):
                counts += np.diff(split.words(data, offsets, hashed=False)[3]).tolist()
            part = batch.column(batch.schema.get_field_index("part"))[0].as_py()
            if part not in known:
                known.clear()
                known[part] = inplace.Told(filed, part, "key")
            at = known[part].find(batch.column(batch.schema.get_field_index("key")).to_numpy())
            starts, ends, found = ([[] for _ in counts] for _ in range(3))
            for i in np.flatnonzero(at >= 0).tolist():
                some = known[part].table.column("hits")[int(at[i])].as_py()
                spans = merged([x for h in some for x in zip(h["starts"], h["ends"], strict=True)])
                starts[i], ends[i] = [a for a, _ in spans], [b for _, b in spans]
                found[i] = sorted({x for h in some for x in h["items"]})
            return counts, starts, ends, found

        return of

    return given.rows, look


def _parts(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.schema.get_field_index("part") >= 0:
            yield from (b for _, b in inplace.by_part([batch], most))
        else:
            yield from (batch.slice(s, most) for s in range(0, batch.num_rows, most))


_RESULTS = ("n_words", "starts", "ends", "items")


def search(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", **options) -> DataFrame:
    """Kept columns, n_words, merged spans of hit words (starts, ends) and sorted item ids, of every document. options: see located()."""
    if clash := set(keep) & set(_RESULTS):
        raise ValueError(f"columns named as results can't be kept: {sorted(clash)}")
    row = docs.select(*keep)
    source = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, begin = located(source, benchmark, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = begin()
        for batch in _parts(batches):
            counts, starts, ends, found = find(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("row")), pa.array(counts, pa.int64()), pa.array(starts, _SPANS), pa.array(ends, _SPANS), pa.array(found, pa.list_(pa.string()))], names=["row", *_RESULTS])

    return rows.mapInArrow(run, f"row {row.schema.simpleString()}, n_words long, starts array<int>, ends array<int>, items array<string>").select("row.*", *_RESULTS)


def _without(split: Splitter, text: str, starts: list[int], ends: list[int]) -> tuple[str, bool]:
    """A text without spans of words, a line break for each, and whether a word is left."""
    raw = text.encode("utf-8", "surrogatepass")
    w_start, w_end, _, _ = split.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), hashed=False)
    parts, at, left = [], 0, len(w_start)
    for a, b in zip(starts, ends, strict=True):
        parts.append(raw[at : w_start[a]])
        at, left = w_end[b - 1], left - (b - a)
    return b"\n".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass"), left > 0


def _removed(docs: DataFrame, benchmark: DataFrame, text_col: str, **options) -> DataFrame:
    """row, text, cut: the documents' rows, their texts without hit words and whether there were any; those of which no word is left go."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, begin = located(source, benchmark, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, split = begin(), Splitter(NOT_ALNUM, lower=True)
        for batch in _parts(batches):
            _, starts, ends, _ = find(batch)
            texts = batch.column(batch.schema.get_field_index("text"))
            cut = np.array([bool(x) for x in starts], bool)
            keep = np.ones(len(cut), bool)
            if cut.any():
                new = texts.to_pylist()
                for i in np.flatnonzero(cut).tolist():
                    new[i], keep[i] = _without(split, new[i], starts[i], ends[i])
                texts = pa.array(new, pa.string())
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), texts, pa.array(cut)], names=["row", "text", "cut"])
            yield out if keep.all() else out.filter(pa.array(keep))

    return rows.mapInArrow(run, f"row {docs.schema.simpleString()}, text string, cut boolean")


def remove(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents with all columns, hit words cut from their texts (a line break stands for each span); those of which no word is left go.

    A document without a hit keeps its text to the byte, empty or null ones too.
    """
    done = _removed(docs, benchmark, text_col, **options)
    return done.select(*[F.when(F.col("cut"), F.col("text")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the benchmark's passages; n_chars follows where a text was cut."""
    done = _removed(docs, table(spark, sf_dir, "benchmark"), "text")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[F.when(F.col("cut"), new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x).cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL_OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) x WHERE len(w) > 0),
p AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b) x),
o AS (SELECT doc_id, i, e.n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) s WHERE len(w) >= n) x) e JOIN p USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM o) x GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
