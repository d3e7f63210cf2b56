"""Lexical retrieval packing: documents fill sequences of a fixed number of tokens together with their lexical neighbours.

Tokens of the vocabulary are the terms. Document frequencies cover the whole corpus (a table as large as the vocabulary, summed by task and then by term). Every document gets a route, its terms of the highest BM25 weight among
those that a fifth, a fiftieth, and two of all documents have, and documents are dealt out in the order of their routes over the whole corpus, so that lexical neighbours meet wherever they stood; a route that many documents share is divided between tasks. The inverted index is sharded:
a shard is a run of that order with SHARD_TOKENS tokens, or one longer document, so memory doesn't follow the input. Within a shard, an unused document seeds a
sequence; BM25 over all its terms ranks the unused neighbours, which fill the window one after another. The one that doesn't fit is cut, and
what is left of it seeds the next sequence. Documents over a window give whole windows first. The last tokens of a shard go to sequences of powers of two, so nothing is padded.

Tokenizing keeps a bounded table of words met so far per Python worker: a word's tokens don't depend on its neighbours, for this tokenizer cuts at white space.

Defined results: a null or empty text is the end token alone. Repeated rows are documents of their own. A null id stays null. An empty table gives no sequence. Columns other than id and text are not read.
Sequence ids are unique, not consecutive. The tokens are settled first and have a number each that orders ties, so a lost executor repeats the same packing.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm import exchange as X
from graincask.llm import inplace
from graincask.llm.common import settle, table
from graincask.llm.words import WHITESPACE, Splitter, chunks, string_bytes, trim

WINDOW, END = 2048, 1
#: Tokens of a shard of the index, and BM25's two parameters.
SHARD_TOKENS, K1, B = 1 << 20, 1.2, 0.75
#: Words whose ids a Python worker remembers, at about 20 bytes each.
REMEMBERED = 1_500_000
#: The terms of a route: the parts of all documents that must have each (two documents at least).
ROUTE = (1 / 5, 1 / 50, 0.0)
SLOTS = 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered:
    """Ids of words by their hashes, as sorted tables of which each is at least twice as long as the next; beyond the bound the oldest is forgotten."""

    def __init__(self, most: int):
        self.most, self.tables = most, []
        self.ids, self.used = np.empty(1 << 16, np.uint16), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in self.ids, or -1, and how many there are."""
        at, size = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        open_ = np.arange(len(hashes))
        for names, begin, length in self.tables:
            place = np.minimum(np.searchsorted(names, hashes[open_]), len(names) - 1)
            same = names[place] == hashes[open_]
            at[open_[same]], size[open_[same]] = begin[place[same]], length[place[same]]
            open_ = open_[~same]
            if not len(open_):
                break
        return at, size

    def put(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """hashes: sorted, none of them known."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(size.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(max(len(flat), self.used), np.uint16)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.tables.append((hashes, (self.used + np.cumsum(size) - size).astype(np.uint32), size.astype(np.uint16)))
        self.used += len(flat)
        while len(self.tables) > 1 and len(self.tables[-2][0]) < 2 * len(self.tables[-1][0]):
            one, two = self.tables.pop(), self.tables.pop()
            both = [np.concatenate(x) for x in zip(one, two, strict=True)]
            order = np.argsort(both[0])
            self.tables.append(tuple(x[order] for x in both))
        if sum(len(t[0]) for t in self.tables) > self.most:
            self.tables = self.tables[1:]
            left = [(self.ids[b : b + n]) for _, begin, length in self.tables for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            self.ids, self.used, tables = np.concatenate([np.empty(0, np.uint16), *left]), 0, []
            for names, _, length in self.tables:
                end = np.cumsum(length.astype(np.int64))
                tables.append((names, (self.used + end - length).astype(np.uint32), length))
                self.used += int(end[-1])
            self.tables = tables


#: Bytes as the characters that a byte-level vocabulary writes for them.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: b for b in _PLAIN} | {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _PLAIN)}
#: Latin letters below U+0180 but the dotted capital I, whose lower case is two characters.
_SIMPLE = re.compile("[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+").fullmatch


class WordTokenizer:
    """Token ids of texts by way of their white-space separated words; the words' ids are remembered within a bound.

    ASCII punctuation that follows a Latin letter or a digit is a word of its own, for the tokenizer cuts there too. A word of Latin letters below U+0180
    is lower-cased and goes to the model alone; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        store = sys.modules.setdefault("_graincask_remembered", types.ModuleType("_graincask_remembered"))  # outlives the task in its worker
        if getattr(store, "path", None) != path:
            store.path, store.known, store.tokenizer = path, Remembered(REMEMBERED), Tokenizer.from_file(path)
        self.store, self.split, self.exact = store, Splitter(WHITESPACE, lower=True), Splitter(WHITESPACE)
        self.whole, self.model = store.tokenizer.encode, store.tokenizer.model.tokenize
        self.mark, self.plain = np.zeros(256, bool), np.zeros(256, bool)
        self.mark[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
        self.plain[[b for b in range(0x80) if chr(b).isalnum()]] = True

    def ids_of(self, word: str) -> list[int]:
        if not _SIMPLE(word):
            return self.whole(word, add_special_tokens=False).ids
        word = word.lower()
        return [t.id for t in self.model(word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN))]

    def _letters_end(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each word's trailing punctuation begins, if it follows a Latin letter or a digit; else the word's end."""
        at, going = ends.copy(), np.arange(len(ends))
        while len(going):
            going = going[(at[going] > starts[going]) & self.mark[data[at[going] - 1]]]
            at[going] -= 1
        last, before = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
        two = (at - starts >= 2) & (last >= 0x80) & (last < 0xC0) & ((before == 0xC4) | (before == 0xC5) | (before == 0xC3) & (last != 0x97) & (last != 0xB7))
        special = (ends - at >= 2) & (data[np.minimum(at, len(data) - 1)] == ord("|")) & (data[np.minimum(at + 1, len(data) - 1)] == ord(">"))  # may end a special token
        return np.where((at > starts) & (self.plain[last] | two) & ~special, at, ends)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint16) of all texts of a chunk, each followed by the end token, and the offsets of the texts in them."""
        # special tokens, which differ by case, begin with <|
        split = self.exact if ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any() else self.split
        starts, ends, _, firsts = split.words(data, offsets, hashed=False)
        lengths, flat = np.zeros(len(starts), np.int64), None
        begin = lengths
        if len(starts):
            letters = self._letters_end(data, starts, ends)
            cut = letters < ends
            order = np.argsort(np.concatenate((starts, letters[cut])), kind="stable")
            ends = np.concatenate((letters, ends[cut]))[order]
            starts = np.concatenate((starts, letters[cut]))[order]
            firsts = np.searchsorted(starts, offsets)
            inverse, unique = pd.factorize(split.hashes(data, starts))
            known = self.store.known
            begin, size = known.find(unique)
            new = np.flatnonzero(begin < 0)
            if len(new):
                first = np.empty(len(unique), np.int64)
                first[inverse[::-1]] = np.arange(len(inverse))[::-1]
                new = new[np.argsort(unique[new])]
                raw, at = data.tobytes(), first[new]
                known.put(unique[new], [self.ids_of(raw[s:e].decode("utf-8", "replace")) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                begin, size = known.find(unique)
            flat = known.ids
            lengths, begin = size[inverse], begin[inverse]
        # one slot more per text, for the end token
        before = np.concatenate(([0], np.cumsum(lengths)))
        text_at = before[firsts] + np.arange(len(firsts))
        total = int(before[-1]) + len(firsts) - 1
        out = np.full(total, END, np.uint16)
        if before[-1]:
            source = np.arange(before[-1]) - np.repeat(before[:-1], lengths) + np.repeat(begin, lengths)
            text = np.repeat(np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)), lengths)
            out[np.arange(before[-1]) + text] = flat[source]
        return out, text_at


def tokenized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (packed uint16, with the end token), row (a number of its own), settled."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(path)
        for batch in batches:
            for first, end, data, offsets in chunks(batch, "text", 1 << 20):
                ids, at = coder.encode(data, offsets)
                blob = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), blob], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return settle(rows.mapInArrow(run, "doc_id long, ids binary").withColumn("row", F.monotonically_increasing_id()))


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each token, documents and tokens in all; a row per token at most comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = np.zeros(SLOTS, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, of = _flat(batch.column(1).slice(at, 512))
                held += np.bincount(pd.unique(of * SLOTS + ids) % SLOTS, minlength=SLOTS)
                docs, size = docs + len(batch.column(1).slice(at, 512)), size + len(ids)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int32()), pa.array([*held[some].tolist(), docs, size], pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in tokens.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    held = np.zeros(SLOTS, np.int64)
    for t, n in sums.items():
        if t >= 0:
            held[t] = n
    return held, sums.get(-1, 0), sums.get(-2, 0)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_bytes(column)
    ids = np.frombuffer(data.tobytes(), np.uint16).astype(np.int64)
    return ids, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // 2)


def weights(ids: np.ndarray, of: np.ndarray, n: int, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, term and BM25 weight of the distinct terms of n documents, by document and then in no order."""
    lengths = np.bincount(of, minlength=n)
    place, key = pd.factorize(of * SLOTS + ids)
    tf = np.bincount(place, minlength=len(key))
    del place
    doc, term = (key // SLOTS).astype(np.int32), (key % SLOTS).astype(np.int32)
    del key
    return doc, term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))


class ShardIndex:
    """Inverted index of one shard, with BM25 weights from the corpus' statistics. Terms of many documents have a dense row, the others a posting list."""

    def __init__(self, ids: np.ndarray, of: np.ndarray, n: int, idf: np.ndarray, mean: float):
        doc, term, weight = weights(ids, of, n, idf, mean)
        held = np.bincount(term, minlength=SLOTS)
        # a term that one document has ranks no other
        some = held[term] > 1
        doc, term, weight = doc[some], term[some], weight[some].astype(np.float32)
        self.query, self.query_at = term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.posting, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(SLOTS + 1))
        often = np.flatnonzero(held * 8 > n)
        self.row = np.full(SLOTS, -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        dense = self.row[term] >= 0
        self.dense[self.row[term[dense]], doc[dense]] = weight[dense]
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents of the shard for all distinct terms of the seed, each once."""
        terms = self.query[self.query_at[seed] : self.query_at[seed + 1]]
        row = self.row[terms]
        out = self.dense[row[row >= 0]].sum(axis=0)
        rare = terms[row < 0]
        if len(rare):
            begin = self.at[rare]
            size = self.at[rare + 1] - begin
            take = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            out = out + np.bincount(self.posting[take], self.weight[take], self.n)
        return out

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first; ties by place."""
        score = np.where(unused, self.scores(seed), 0)
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def routed(tokens: DataFrame, given) -> DataFrame:
    """doc_id, ids, row and route: for each of ROUTE the term with the highest weight among those common enough, packed. given: broadcast idf, mean length, and how many of ROUTE each term is common enough for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, common = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, of = _flat(part.column(1))
                doc, term, weight = weights(ids, of, part.num_rows, idf, mean)
                order = np.argsort(doc, kind="stable")
                doc, term, weight = doc[order], term[order], weight[order]
                begin = np.searchsorted(doc, np.arange(part.num_rows))  # each document has the end token at least
                route = np.zeros(part.num_rows, np.int64)
                for k in range(len(ROUTE)):
                    own = np.where(common[term] >= len(ROUTE) - k, weight, 0.0)
                    best = np.maximum.reduceat(own, begin)
                    top = np.where((own == best[doc]) & (own > 0), term + 1, 0)
                    route = route * SLOTS + np.maximum.reduceat(top, begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(route)], names=["doc_id", "ids", "row", "route"])

    return tokens.mapInArrow(run, "doc_id long, ids binary, row long, route long")


def pack_shard(lengths: np.ndarray, index: ShardIndex, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of the shard once."""
    n = len(lengths)
    start = np.zeros(n, np.int64)
    for d in np.flatnonzero(lengths >= window).tolist():
        while lengths[d] - start[d] >= window:
            yield [(d, int(start[d]), window)]
            start[d] += window
    unused = lengths > start
    following, cut = 0, -1
    sequence: list[tuple[int, int, int]] = []
    room = window
    while True:
        if cut >= 0:
            seed = cut
        else:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                break
            seed = following
        # the seed, then its neighbours, then whatever comes next
        cut, queue, k, plain = -1, None, 0, following
        d = seed
        while d >= 0:
            size = min(room, int(lengths[d] - start[d]))
            sequence.append((d, int(start[d]), size))
            start[d] += size
            room -= size
            unused[d] = start[d] < lengths[d]
            if not room:
                cut = d if unused[d] else -1
                break
            if queue is None:
                queue = index.neighbours(seed, unused)
            if k < len(queue):
                d, k = int(queue[k]), k + 1
                continue
            while plain < n and not unused[plain]:
                plain += 1
            d = plain if plain < n else -1
        if room:
            break
        yield sequence
        sequence, room = [], window
    # what doesn't fill a window: powers of two, largest first
    left = window - room
    while left:
        size = 1 << (left.bit_length() - 1)
        part, need = [], size
        while need:
            d, s, m = sequence.pop(0)
            part.append((d, s, min(m, need)))
            if m > need:
                sequence.insert(0, (d, s + need, m - need))
            need -= min(m, need)
        left -= size
        yield part


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves where asked for."""
    tokens = tokenized(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer)
    held, n_docs, n_tokens = frequencies(tokens)
    idf = np.log1p((n_docs - held + 0.5) / (held + 0.5))
    given = docs.sparkSession.sparkContext.broadcast((idf, max(1.0, n_tokens / max(1, n_docs)), sum((held >= max(2.0, x * n_docs)).astype(np.int8) for x in ROUTE)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        idf, mean, _ = given.value

        def shard(doc_ids: pa.Array, blobs: pa.Array, sequence: int) -> tuple[pa.RecordBatch, int]:
            ids, of = _flat(blobs)
            n = len(blobs)
            lengths = np.bincount(of, minlength=n)
            at = np.cumsum(lengths) - lengths
            words = ids.astype("<u4")
            cols: list[list[int]] = [[], [], [], [], [], []]
            for pieces in pack_shard(lengths, ShardIndex(ids, of, n, idf, mean), window):
                offset = 0
                for d, s, m in pieces:
                    for c, v in zip(cols, (d, s, m, zlib.crc32(words[at[d] + s : at[d] + s + m].tobytes()), sequence, offset), strict=True):
                        c.append(v)
                    offset += m
                sequence += 1
            d, s, m, crc, q, o = (np.array(c, np.int64) for c in cols)
            arrays = [doc_ids.take(pa.array(d)), pa.array(s), pa.array(m), pa.array(crc), pa.array(lengths[d].astype(np.int64)), pa.array(q), pa.array(o)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                bounds = np.concatenate(([0], np.cumsum(m))).astype(np.int32)
                flat = np.concatenate([words[at[x] + y : at[x] + y + z] for x, y, z in zip(d.tolist(), s.tolist(), m.tolist(), strict=True)] or [words[:0]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names), sequence

        waiting: list[pa.RecordBatch] = []
        held = 0

        def flush(sequence: int) -> tuple[pa.RecordBatch, int]:
            one = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            out = shard(one.column(0), one.column(1), sequence)
            trim()
            return out

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) // 2)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + shard_tokens - held, "right")))
                waiting.append(batch.slice(at, end - at))
                held += int(ends[end - 1]) - before
                at = end
                if at < batch.num_rows or held >= shard_tokens:
                    out, sequence = flush(sequence)
                    yield out
                    waiting, held = [], 0
        if waiting:
            yield flush(sequence)[0]

    near = routed(tokens, given).repartitionByRange(X.n_buckets(tokens, inplace.parts_of(tokens)), "route", "row").sortWithinPartitions("route", "row")
    return near.select("doc_id", "ids").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_ids=False)
