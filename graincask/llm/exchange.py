"""Packed exchanges: hashes of many texts go to buckets as a few binary columns per batch instead of a row each.

An entry is a hash (with a check of 32 more bits where wrong matches would change a result), the text's number within its batch and a place; who the text is stays in one table per batch, which the
answers meet again by the part that holds the batch (see inplace). An entry's size so doesn't depend on the number of buckets. A batch that holds a hash more than once settles what it can by itself and sends one entry, so that a hash
that occurs in one third of all texts costs a bucket one entry per batch, not one per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincask.llm.common import n_tasks
from graincask.llm.inplace import by_part
from graincask.llm.words import trim

#: Kinds of rows: entries that ask, entries whose answer is known, and a batch's table of keys (marks) and labels (hashes).
ASK, KNOWN, TABLE = 0, 1, 2
ROWS = "bucket int, batch long, kind int, ordinals binary, marks binary, hashes binary, checks binary, spots binary"
_NAMES = ("bucket", "batch", "kind", "ordinals", "marks", "hashes", "checks", "spots")
_ROWS = pa.schema([(c, t) for c, t in zip(_NAMES, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)])
REPLIES = "part int, key long, label long, spots binary"
#: Rows of a batch at most, the number that stands for texts whose answer is known, and the bits of a batch's number within its part.
BATCH_ROWS, TOLD, PART_BITS = 32_768, 65_535, 24


def n_buckets(df: DataFrame, parts: int = 1) -> int:
    """Follows the input: at least one bucket per part and per shuffle partition."""
    return max(n_tasks(df), parts)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def runs(*arrays: np.ndarray) -> np.ndarray:
    """Starts of the runs in which all arrays are constant, and the end."""
    n = len(arrays[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n - 1, bool)
    for a in arrays:
        change |= a[1:] != a[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [n]))


def batches_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """A number, the part and the rows of each batch: of rows equal in all keys one, and at most BATCH_ROWS."""
    seen: dict[int, int] = {}
    for part, rows in by_part(batches, BATCH_ROWS):
        cols = [rows.column(rows.schema.get_field_index(key)).to_numpy(zero_copy_only=False) for key in keys]
        order = np.lexsort(cols)  # stable: of equal rows the first is kept
        at = runs(*(c[order] for c in cols))
        seen[part] = k = seen.get(part, -1) + 1
        yield (part << PART_BITS) + k, part, rows.take(pa.array(np.sort(order[at[:-1]])))


def _row(n: int, batch: int, kind: int, **columns: bytes) -> pa.RecordBatch:
    part = batch >> PART_BITS
    return pa.RecordBatch.from_pydict({"bucket": [part % n], "batch": [batch], "kind": [kind]} | {c: [columns.get(c, b"")] for c in _NAMES[3:]}, _ROWS)


def table_row(n: int, batch: int, keys: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    return _row(n, batch, TABLE, marks=keys.astype(np.int64).tobytes(), hashes=labels.astype(np.int64).tobytes())


def known_row(n: int, batch: int, ordinals: np.ndarray, spots: np.ndarray) -> pa.RecordBatch:
    return _row(n, batch, KNOWN, ordinals=ordinals.astype(np.uint16).tobytes(), spots=spots.astype(np.uint32).tobytes())


def ask_rows(n: int, batch: int, hashes: np.ndarray, ordinals: np.ndarray, spots: np.ndarray, marks: np.ndarray | None = None, checks: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket. marks: a number per entry that the bucket needs."""
    b = bucket_of(hashes, n)
    order = np.argsort(b, kind="stable")
    at = runs(b[order])
    cut = lambda a: pa.array([a[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
    rows = len(at) - 1
    blank = pa.array([b""] * rows, pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array(b[order][at[:-1]], pa.int32()), pa.array(np.full(rows, batch)), pa.array(np.full(rows, ASK, np.int32)), cut(ordinals.astype(np.uint16)[order]),
        blank if marks is None else cut(marks.astype(np.int64)[order]), cut(hashes[order]), blank if checks is None else cut(checks.astype(np.uint32)[order]), cut(spots.astype(np.uint32)[order])], schema=_ROWS)


class Entries:
    """Entries of a bucket: batch, ordinal, hash, spot and, where sent, mark and check of each."""

    def __init__(self, table: pa.Table):
        whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        self.ordinals, self.hashes, self.checks, self.spots, self.marks = whole("ordinals", np.uint16), whole("hashes", np.uint64), whole("checks", np.uint32), whole("spots", np.uint32), whole("marks", np.int64)
        sizes = np.array([len(x) // 2 for x in table.column("ordinals").to_pylist()], np.int64)
        self.batches = np.repeat(table.column("batch").to_numpy(), sizes) if len(sizes) else np.empty(0, np.int64)


def answer(rows: DataFrame, reduce, n: int) -> DataFrame:
    """part, key, label, spots (packed): the entries for which reduce(Entries) gives True, and the known ones, by text. A text that several batches of a part hold may have several rows."""

    def of(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        passed = t.take(pa.array(np.flatnonzero(kind != ASK)))
        e = Entries(t.take(pa.array(np.flatnonzero(kind == ASK))))
        hit = reduce(e)
        order = np.argsort(e.batches[hit], kind="stable")
        b, o, s = e.batches[hit][order], e.ordinals[hit][order], e.spots[hit][order]
        out = [pa.Table.from_batches([known_row(n, int(b[x]), o[x:y], s[x:y])]) for x, y in zip(runs(b)[:-1], runs(b)[1:], strict=True)]
        done = pa.concat_tables([passed.cast(_ROWS), *out])
        del e, t, passed, out
        trim()
        return done

    def by_text(t: pa.Table) -> pa.Table:
        kinds, batches = t.column("kind").to_numpy(), t.column("batch").to_numpy()
        cols: tuple[list, list, list] = ([], [], [])
        for batch in np.unique(batches[kinds == KNOWN]):
            mine = batches == batch
            tables = t.take(pa.array(np.flatnonzero(mine & (kinds == TABLE))[:1]))
            keys, labels = (np.frombuffer(tables.column(c)[0].as_py(), np.int64) for c in ("marks", "hashes"))
            told = t.take(pa.array(np.flatnonzero(mine & (kinds == KNOWN))))
            ordinals = np.frombuffer(b"".join(told.column("ordinals").to_pylist()), np.uint16)
            spots = np.frombuffer(b"".join(told.column("spots").to_pylist()), np.uint32)
            order = np.argsort(ordinals, kind="stable")
            ordinals, spots = ordinals[order], spots[order]
            at = runs(ordinals)
            who = ordinals[at[:-1]]
            cols[0].append(keys[who])
            cols[1].append(labels[who])
            cols[2].extend(spots[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True))
        part = t.column("part")[0].as_py()
        trim()
        long = lambda c: pa.array(np.concatenate([*c, np.empty(0, np.int64)]).astype(np.int64), pa.int64())
        return pa.table({"part": pa.array(np.full(len(cols[2]), part, np.int32)), "key": long(cols[0]), "label": long(cols[1]), "spots": pa.array(cols[2], pa.binary())})

    known = rows.groupBy("bucket").applyInArrow(of, ROWS)
    return known.withColumn("part", F.shiftright("batch", PART_BITS).cast("int")).groupBy("part").applyInArrow(by_text, REPLIES)


def ask_shared(n: int, batch: int, hashes: np.ndarray, ordinals: np.ndarray, spots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Asks which hashes another text has too. What the batch knows itself is sent as known, with one entry that tells the others."""
    if not len(hashes):
        return
    order = np.argsort(hashes, kind="stable")
    o, at = ordinals[order], runs(hashes[order])
    several = np.minimum.reduceat(o, at[:-1]) != np.maximum.reduceat(o, at[:-1])
    many = np.zeros(len(hashes), bool)
    many[order] = np.repeat(several, np.diff(at))
    if many.any():
        yield known_row(n, batch, ordinals[many], spots[many])
        told = order[at[:-1][several]]
        yield ask_rows(n, batch, hashes[told], np.full(len(told), TOLD), spots[told])
    if not many.all():
        yield ask_rows(n, batch, hashes[~many], ordinals[~many], spots[~many])


def shared(e: Entries) -> np.ndarray:
    """For answer(): the entries whose hash another batch has too, or texts that it knows of."""
    out = np.zeros(len(e.hashes), bool)
    if len(out):
        order = np.argsort(e.hashes, kind="stable")
        b, o, at = e.batches[order], e.ordinals[order], runs(e.hashes[order])
        several = (np.minimum.reduceat(b, at[:-1]) != np.maximum.reduceat(b, at[:-1])) | (np.maximum.reduceat(o, at[:-1]) == TOLD)
        out[order] = np.repeat(several, np.diff(at))
        out &= e.ordinals != TOLD
    return out


def _least(hashes: np.ndarray, checks: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each entry the smallest mark of those with its hash and check."""
    out = np.empty(len(hashes), np.int64)
    if len(out):
        order = np.lexsort((checks, hashes))
        at = runs(hashes[order], checks[order])
        out[order] = np.repeat(np.minimum.reduceat(marks[order], at[:-1]), np.diff(at))
    return out


def ask_earlier(n: int, batch: int, hashes: np.ndarray, checks: np.ndarray, ordinals: np.ndarray, spots: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Asks which hashes, checks included, an entry with a smaller mark has too. What the batch knows itself is sent as known."""
    if not len(hashes):
        return
    gone = marks > _least(hashes, checks, marks)
    if gone.any():
        yield known_row(n, batch, ordinals[gone], spots[gone])
    yield ask_rows(n, batch, hashes[~gone], ordinals[~gone], spots[~gone], marks[~gone], checks[~gone])


def earlier(e: Entries) -> np.ndarray:
    """For answer(): the entries whose hash and check an entry with a smaller mark has too."""
    return e.marks > _least(e.hashes, e.checks, e.marks)
