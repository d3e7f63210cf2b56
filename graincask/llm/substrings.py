"""Substring deduplication by difference-cover anchors.

A window is 50 words. A set of 6 residues modulo 31 meets every difference, so that two equal windows, wherever they start, have anchors (windows of
20 words whose start is in the set modulo 31) at the same distance from their starts. Four passes over the same partitions, each of which is told what the one before found (see inplace):

1. Whole texts: by 96 bits of hash and the id, a text that a smaller id has too is a copy and takes no further part.
2. Anchors of the other texts are exchanged; those that two different texts share are told to their texts.
3. Shared anchors are extended: every 50-word window that holds one is hashed (64 bits and a check of 32 more, by another polynomial) and exchanged; a window that a text with a smaller id has is told to its text.
   The extension is by hash and not word by word along pairs, for a passage that one third of all texts hold would make pairs quadratic; here it costs one entry per batch.
4. The told windows are cut.

Only hashes are moved, at every size; texts stay where they are read.

Defined results: a null or empty text has no words. A text of fewer words than a window loses none. Equal ids aren't smaller than each other: windows that only rows of one id have stay, whether the rows' texts are
equal or not. A null id is larger than all others, and null ids are equal. Columns other than id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm import exchange as X
from graincask.llm import inplace
from graincask.llm.common import table
from graincask.llm.words import WHITESPACE, Splitter, chunks, mix, valid_windows

WINDOW, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
LAST = (1 << 63) - 1


def covers(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> bool:
    """Whether every difference modulo the period is one of two cover positions."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _pinned(docs: DataFrame, id_col: str, text_col: str) -> inplace.Pinned:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return inplace.pinned(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("label"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2"), text.alias("text")))


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def copies(docs: inplace.Pinned) -> DataFrame:
    """part, key, label, spots of the texts that a smaller label has too."""
    n = X.n_buckets(docs.rows, docs.parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, batch in X.batches_of(batches, "label", "key", "key2"):
            keys, second, labels = _numbers(batch, "key", "key2", "label")
            yield X.table_row(n, number, keys, labels)
            each = np.arange(len(keys))
            yield from X.ask_earlier(n, number, mix(keys.view(np.uint64)), second.view(np.uint64).astype(np.uint32), each, np.zeros(len(keys), np.uint32), labels)

    return X.answer(docs.rows.select("part", "label", "key", "key2").mapInArrow(ask, X.ROWS), X.earlier, n)


def _once(batches: Iterator[pa.RecordBatch], whole: str) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The batches without the copies of whole texts."""
    at, known = None, None
    for number, part, batch in X.batches_of(batches, "label", "key", "key2"):
        if part != at:
            at, known = part, inplace.Told(whole, part, "key", "label")
        yield number, part, batch.take(pa.array(np.flatnonzero(known.find(*_numbers(batch, "key", "label")) < 0)))


def shared_anchors(docs: inplace.Pinned, whole: str) -> DataFrame:
    """part, key, label, spots: places of the anchors that another text has too, of texts that are no copies (whole: where copies are filed)."""
    n = X.n_buckets(docs.rows, docs.parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, in_cover = Splitter(WHITESPACE), np.isin(np.arange(PERIOD), COVER)
        for number, _, batch in _once(batches, whole):
            if not batch.num_rows:
                continue
            yield X.table_row(n, number, *_numbers(batch, "key", "label"))
            parts = []
            for first, _, data, offsets in chunks(batch, "text"):
                _, _, hashes, firsts = split.words(data, offsets)
                lengths = np.diff(firsts)
                place = np.arange(firsts[-1]) - np.repeat(firsts[:-1], lengths)
                ok = valid_windows(firsts, ANCHOR)
                ok = ok[in_cover[place[ok] % PERIOD]]
                parts.append((split.windows(hashes, ANCHOR)[ok], np.repeat(np.arange(first, first + len(lengths)), lengths)[ok], place[ok]))
            yield from X.ask_shared(n, number, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return X.answer(docs.rows.mapInArrow(ask, X.ROWS), X.shared, n)


def repeated_windows(docs: inplace.Pinned, whole: str, anchors: str) -> DataFrame:
    """part, key, label, spots: starts of the windows that a text with a smaller label has too. Whole and anchors: where copies and shared anchors are filed."""
    n = X.n_buckets(docs.rows, docs.parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, places = Splitter(WHITESPACE), None, None
        for number, part, batch in _once(batches, whole):
            if part != at:
                at, places = part, inplace.Told(anchors, part, "key", "label")
            found = places.find(*_numbers(batch, "key", "label"))
            batch, found = batch.take(pa.array(np.flatnonzero(found >= 0))), found[found >= 0]
            if not batch.num_rows:
                continue
            keys, labels = _numbers(batch, "key", "label")
            yield X.table_row(n, number, keys, labels)
            spots = places.table.column("spots")
            parts = []
            for first, end, data, offsets in chunks(batch, "text"):
                _, _, hashes, firsts = split.words(data, offsets)
                lengths = np.diff(firsts)
                near = np.zeros(firsts[-1] + 1, np.int32)
                for i in range(first, end):
                    p = np.unique(np.frombuffer(spots[int(found[i])].as_py(), np.uint32)).astype(np.int64)
                    base = firsts[i - first]
                    np.add.at(near, base + np.maximum(p - (PERIOD - 1), 0), 1)
                    np.add.at(near, base + p + 1, -1)
                ok = valid_windows(firsts, WINDOW)
                ok = ok[np.cumsum(near)[ok] > 0]
                place = np.arange(firsts[-1]) - np.repeat(firsts[:-1], lengths)
                check = split.windows(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)
                parts.append((split.windows(hashes, WINDOW)[ok], check[ok].astype(np.uint32), np.repeat(np.arange(first, end), lengths)[ok], place[ok]))
            hashes, checks, owners, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from X.ask_earlier(n, number, hashes, checks, owners, starts, labels[owners])

    return X.answer(docs.rows.mapInArrow(ask, X.ROWS), X.earlier, n)


def removals(docs: inplace.Pinned) -> tuple[str, str]:
    """Where copies of whole texts and the starts of repeated windows are filed."""
    whole = inplace.file_away(copies(docs))
    anchors = inplace.file_away(shared_anchors(docs, whole))
    windows = inplace.file_away(repeated_windows(docs, whole, anchors))
    inplace.delete(anchors)
    return whole, windows


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless asked for: the kept words joined by one space) of every document."""
    rows = _pinned(docs, id_col, text_col)
    whole, windows = removals(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, gone, told = Splitter(WHITESPACE), None, None, None
        for part, batch in inplace.by_part(batches):
            if part != at:
                at, gone, told = part, inplace.Told(whole, part, "key", "label"), inplace.Told(windows, part, "key", "label")
            keys, labels = _numbers(batch, "key", "label")
            copy, starts = gone.find(keys, labels) >= 0, told.find(keys, labels)
            out: list[tuple] = []
            for first, end, data, offsets in chunks(batch, "text"):
                w_start, w_end, _, firsts = split.words(data, offsets, hashed=False)
                raw = data.tobytes()
                for i in range(first, end):
                    a, b = firsts[i - first], firsts[i - first + 1]
                    n, lost = int(b - a), 0
                    if copy[i] and n >= WINDOW:
                        kept, lost = b"", n
                    elif starts[i] >= 0:
                        p = np.unique(np.frombuffer(told.table.column("spots")[int(starts[i])].as_py(), np.uint32)).astype(np.int64)
                        edges = np.zeros(n + WINDOW + 1, np.int32)
                        edges[p] += 1
                        edges[p + WINDOW] -= 1
                        stay = np.flatnonzero(np.cumsum(edges)[:n] == 0)
                        lost = n - len(stay)
                        kept = b" ".join([raw[s:e] for s, e in zip(w_start[a:b][stay].tolist(), w_end[a:b][stay].tolist(), strict=True)])
                    else:
                        kept = b" ".join(raw[offsets[i - first] : offsets[i - first + 1]].split())
                    out.append((int(labels[i]), n, lost, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary()).cast(pa.string())], names=["label", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = rows.rows.mapInArrow(cut, "label long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.when(F.col("label") != LAST, F.col("label")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


SQL_OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}) x),
m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS gone FROM g),
r AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM m WHERE gone) y GROUP BY doc_id),
k AS (SELECT doc_id, count(*) FILTER (WHERE kept) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE kept) AS t
  FROM (SELECT d.doc_id, p, w[p] AS word, r.doc_id IS NULL OR NOT list_contains(ps, p) AS kept FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN r USING (doc_id)) z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
