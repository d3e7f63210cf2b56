"""Set-similarity join on 5-word shingles: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

1. Texts with equal shingle sets are one class; the rest works on one text per class.
2. A cheap first look: with shingles in hash order, two linked sets share a known number of elements of slightly longer prefixes. Classes that share too few with
   anyone have no link. This exchange holds about a third of all shingles, 8 bytes each.
3. For the classes left, every shingle's document frequency is counted exactly and told to those that have it; shingles of one class only can't be shared,
   and a class with too few shared ones goes.
4. Prefixes in rare-first order are indexed by shingle. In each posting list, every member is paired with the list's first class; pairs that pass the length, positional
   and suffix filters are verified, and verified links give components. Then every member is paired with one of its list and of another component that passes the filters, drawn by hash: lists draw different ones, so
   that near copies of each other, of which some pairs aren't links, meet many of their kind. These rounds verify a number of pairs that is linear in the postings, also where thousands are near copies.
5. Lists that still hold more than one component yield their other pairs across components, under the same filters. Pairs within a component can't change it. Long lists
   are cut into blocks that are dealt out anew. What an earlier round has verified is taken out, so that no pair is verified twice.

The suffix filter bounds the overlap of two sets by their counts of shared elements in eight ranges of hashes, for all members of a list at once.
Texts are read in place (see inplace): what is moved is hashes and the sets of classes that passed step 2.

Defined results: words are lower-cased in A-Z. A text with fewer than five words has one shingle, all its words; a null or empty text has none and is linked with nothing.
Repeated rows are linked with each other where they have words. A null id is larger than all ids and comes out as null. Columns that aren't named in the call are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm import exchange as X
from graincask.llm import inplace
from graincask.llm.common import NOT_SEPARATOR, n_tasks, settle, table
from graincask.llm.components import components
from graincask.llm.words import WHITESPACE, Splitter, chunks, mix, valid_windows

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members of a posting list that are paired at once, and rows whose sets are told frequencies together.
BLOCK, SET_ROWS, SET_BITS = 2048, 2000, 5
#: Rounds in which members are paired with one drawn from their list.
DRAWN = 2


def least_overlap(n, percent: int = PERCENT):
    """Overlap that a set of n elements has at least with any set that it is linked with."""
    return (percent * n + 99) // 100


def extra(n, percent: int = PERCENT):
    """Elements that prefixes in hash order are longer by, plus one: a tenth of the least overlap."""
    return np.maximum(1, (least_overlap(n, percent) + 9) // 10)


def text_sets(split: Splitter, data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a chunk, sorted within each text, and their text numbers."""
    _, _, hashes, firsts = split.words(data, offsets)
    lengths = np.diff(firsts)
    of = np.repeat(np.arange(len(lengths)), lengths)
    ok = valid_windows(firsts, shingle)
    found, owner = [split.windows(hashes, shingle)[ok]], [of[ok]]
    for k in range(1, shingle):  # texts of fewer words
        short = np.flatnonzero(lengths == k)
        if len(short):
            found.append(mix(split.windows(hashes, k)[firsts[short]] + np.uint64(k)))
            owner.append(short)
    h, o = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[first], o[first]


def _pinned(docs: DataFrame, id_col: str, text_col: str, *more) -> inplace.Pinned:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return inplace.pinned(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text"), *more))


def measured(docs: inplace.Pinned, shingle: int = SHINGLE) -> DataFrame:
    """part, id, row_key, and of the shingle set its size n and two keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(WHITESPACE, lower=True)
        for batch in batches:
            sizes, one, two = (np.zeros(batch.num_rows, d) for d in (np.int64, np.uint64, np.uint64))
            for first, end, data, offsets in chunks(batch, "text"):
                h, o = text_sets(split, data, offsets, shingle)
                at = X.runs(o)
                if len(h):
                    who = first + o[at[:-1]]
                    sizes[who] = np.diff(at)
                    one[who], two[who] = np.add.reduceat(mix(h + np.uint64(1)), at[:-1]), np.add.reduceat(mix(h + np.uint64(2)), at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sizes)], names=["part", "id", "row_key", "key", "key2", "n"])

    return docs.rows.select("part", "id", "row_key", "text").mapInArrow(run, "part int, id long, row_key long, key long, key2 long, n long")


def _first_of_each(batches: Iterator[pa.RecordBatch], filed: str) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray]]:
    """Batch number, part, and of each class that is filed for the part one row, with the class' node."""
    at, classes, done = None, None, None
    for number, part, batch in X.batches_of(batches, "row_key"):
        if part != at:
            at, classes = part, inplace.Told(filed, part, "key")
            done = np.zeros(len(classes.names), bool)
            nodes = classes.table.column("node").to_numpy() if classes.table is not None else np.empty(0, np.int64)
        found = classes.find(batch.column(batch.schema.get_field_index("row_key")).to_numpy())
        rows = np.flatnonzero(found >= 0)
        rows = rows[~done[found[rows]]]
        done[found[rows]] = True
        yield number, part, batch.take(pa.array(rows)), nodes[found[rows]]


def likely(docs: inplace.Pinned, filed: str, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """part, key (node) of the classes that share enough elements of their prefixes in hash order with other sets; filed: where one row_key and node per class is."""
    n_buckets = X.n_buckets(docs.rows, docs.parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(WHITESPACE, lower=True)
        for number, _, batch, nodes in _first_of_each(batches, filed):
            sizes = np.zeros(batch.num_rows, np.int64)
            parts = []
            for first, _, data, offsets in chunks(batch, "text"):
                h, o = text_sets(split, data, offsets, shingle)
                if not len(h):
                    continue
                at = X.runs(o)
                size = np.diff(at)
                sizes[first + o[at[:-1]]] = size
                rank, n = np.arange(len(h)) - np.repeat(at[:-1], size), np.repeat(size, size)
                kept = rank < n - least_overlap(n, percent) + extra(n, percent)
                parts.append((h[kept], first + o[kept]))
            if not parts:
                continue
            h, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield X.table_row(n_buckets, number, nodes, sizes)
            yield from X.ask_shared(n_buckets, number, h, owner, np.zeros(len(h), np.uint32))

    told = X.answer(docs.rows.select("part", "row_key", "text").mapInArrow(ask, X.ROWS), X.shared, n_buckets)
    m = f"(({percent} * label + 99) div 100)"  # the smallest partner's size
    need = F.expr(f"greatest(1, ((({percent} * {m} + 99) div 100) + 9) div 10)")
    return told.filter(F.floor(F.octet_length("spots") / 4) >= need).select("part", "key")


_SETS = "gid long, label long, n long, elements binary"


def sets_of(docs: inplace.Pinned, filed: str, near: str, shingle: int = SHINGLE) -> DataFrame:
    """gid, label (node), n, elements (packed, sorted) of the classes whose node near has; gid groups some thousand neighbouring rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, some = Splitter(WHITESPACE, lower=True), None, None
        for number, part, every, names in _first_of_each(batches, filed):
            if part != at:
                at, some = part, inplace.Told(near, part, "key")
            rows = np.flatnonzero(some.find(names) >= 0)
            whole, nodes = every.take(pa.array(rows)), names[rows]
            for s in range(0, whole.num_rows, SET_ROWS):
                batch, labels = whole.slice(s, SET_ROWS), nodes[s : s + SET_ROWS]
                sizes, blobs = np.zeros(len(labels), np.int64), [b""] * len(labels)
                for first, _, data, offsets in chunks(batch, "text"):
                    h, o = text_sets(split, data, offsets, shingle)
                    edges = X.runs(o)
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        i = first + int(o[a])
                        sizes[i], blobs[i] = b - a, h[a:b].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(labels), (number << SET_BITS) + s // SET_ROWS)), pa.array(labels), pa.array(sizes), pa.array(blobs, pa.binary())], names=["gid", "label", "n", "elements"])

    return docs.rows.select("part", "row_key", "text").mapInArrow(run, _SETS)


def _frequencies(sets: DataFrame, parts: int) -> DataFrame:
    """gid, hashes, counts: document frequencies over 1 of the elements that rows of the gid have."""
    n_buckets = X.n_buckets(sets, parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids = batch.column(0).to_numpy(zero_copy_only=False)
            for g in np.unique(gids):
                h = np.frombuffer(b"".join(batch.column(3).take(pa.array(np.flatnonzero(gids == g))).to_pylist()), np.uint64)
                u, c = np.unique(h, return_counts=True)
                if len(u):
                    yield X.ask_rows(n_buckets, int(g), u, np.zeros(len(u)), c)

    def total(t: pa.Table) -> pa.Table:
        e = X.Entries(t)
        gids, hashes, counts = e.batches, e.hashes, e.spots
        u, inv = np.unique(hashes, return_inverse=True)
        df = np.bincount(inv, counts, len(u)).astype(np.uint32)[inv]
        keep = df > 1
        order = np.argsort(gids[keep], kind="stable")
        g, h, d = gids[keep][order], hashes[keep][order], df[keep][order]
        at = X.runs(g)
        cut = lambda a: pa.array([a[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return pa.table({"gid": pa.array(g[at[:-1]], pa.int64()), "hashes": cut(h), "counts": cut(d)})

    return sets.mapInArrow(ask, X.ROWS).groupBy("bucket").applyInArrow(total, "gid long, hashes binary, counts binary")


_RANKED = "label long, n long, elements binary, prefix binary, start long, quarters binary"


def ranked(sets: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """Classes that share enough elements: shared elements, rare-first prefix (from position start on, before it are elements of this class only) and counts of shared elements by hash range."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(told.column("hashes").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(told.column("counts").to_pylist()), np.uint32)
        h, at = np.unique(h, return_index=True)
        c = c[at]
        out: dict[str, list] = {k: [] for k in ("label", "n", "elements", "prefix", "start", "quarters")}
        seen = set()
        for label, n, blob in zip(own.column("label").to_pylist(), own.column("n").to_pylist(), own.column("elements").to_pylist(), strict=True):
            if label in seen or not n or not len(h):
                continue
            seen.add(label)
            e = np.frombuffer(blob, np.uint64)
            at = np.minimum(np.searchsorted(h, e), len(h) - 1)
            common = h[at] == e
            e, df = e[common], c[at[common]]
            if len(e) < least_overlap(n, percent):
                continue
            start, stop = n - len(e), n - least_overlap(n, percent) + 1
            rare = e[np.lexsort((e, df))][: stop - start]
            for k, v in (("label", label), ("n", n), ("elements", e.tobytes()), ("prefix", rare.tobytes()), ("start", start), ("quarters", np.bincount((e >> np.uint64(61)).astype(np.int64), minlength=8).astype(np.uint32).tobytes())):
                out[k].append(v)
        return pa.table({k: pa.array(v, pa.binary() if k in ("elements", "prefix", "quarters") else pa.int64()) for k, v in out.items()})

    return sets.groupBy("gid").cogroup(_frequencies(sets, parts).groupBy("gid")).applyInArrow(run, _RANKED)


_MEMBER = np.dtype([("label", "<i8"), ("group", "<i8"), ("n", "<u4"), ("at", "<u4"), ("quarters", "<u4", 8)])
_PAIRS = "a long, b long, left binary, right binary"


def passing(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of members of one posting list pass the length, positional and suffix filters; x and y broadcast."""
    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
    need = (percent * (nx + ny) + 99 + percent) // (100 + percent)  # overlap of a link: o >= percent / (100 + percent) * (nx + ny)
    ok = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(nx - x["at"], ny - y["at"]) >= need)
    # what lies in each range of hashes can't overlap by more than the smaller count
    return ok & (np.minimum(x["quarters"], y["quarters"]).sum(axis=-1) >= need)


def _postings(rows: DataFrame, parts: int) -> DataFrame:
    """rows: label, grp, n, prefix, start, quarters -> packed posting entries by bucket."""
    n_buckets = X.n_buckets(rows, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            num = lambda i: batch.column(i).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            prefixes = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            sizes = np.array([len(p) for p in prefixes])
            members = np.zeros(batch.num_rows, _MEMBER)
            members["label"], members["group"], members["n"] = num(0), num(1), num(2)
            members["quarters"] = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32).reshape(-1, 8)
            each = np.repeat(members, sizes)
            each["at"] = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(num(4), sizes)
            hashes = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
            b = X.bucket_of(hashes, n_buckets)
            order = np.argsort(b, kind="stable")
            at = X.runs(b[order])
            cut = lambda a: pa.array([a[order[s:e]].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(b[order][at[:-1]], pa.int32()), cut(hashes), cut(each)], names=["bucket", "hashes", "members"])

    return rows.select("label", "grp", "n", "prefix", "start", "quarters").mapInArrow(run, "bucket int, hashes binary, members binary")


def _pair_table(a: list[np.ndarray], b: list[np.ndarray], left: list[bytes], right: list[bytes]) -> pa.Table:
    x = np.concatenate(a) if a else np.empty(0, np.int64)
    y = np.concatenate(b) if b else np.empty(0, np.int64)
    if len(x):
        x, y = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0).T
    blank = [None] * len(x)
    return pa.table({"a": pa.array([*x.tolist(), *[None] * len(left)], pa.int64()), "b": pa.array([*y.tolist(), *[None] * len(left)], pa.int64()), "left": pa.array([*blank, *left], pa.binary()), "right": pa.array([*blank, *right], pa.binary())})


def candidates(rows: DataFrame, parts: int, percent: int = PERCENT, *, pivot: str = "first") -> DataFrame:
    """Pairs a < b of members of different groups: every member with the first of its list, with one drawn from those of its list that pass, or (pivot: none) all, but those with the first."""
    across = pivot == "none"

    def run(t: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64)
        members = np.frombuffer(b"".join(t.column("members").to_pylist()), _MEMBER)
        order = np.lexsort((members["label"], hashes))
        hashes, members = hashes[order], members[order]
        at = X.runs(hashes)
        a, b, left, right = [], [], [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            m = members[s:e]
            if pivot == "first":
                ok = passing(m[:1], m, percent) & (m["group"] != m["group"][0])
                a.append(np.full(int(ok.sum()), m["label"][0]))
                b.append(m["label"][ok])
                continue
            if pivot == "drawn":
                if (m["group"] != m["group"][0]).any():
                    m = m[np.argsort(m["n"], kind="stable")]
                    for k in range(0, len(m), BLOCK):
                        x, y = _drawn(m[k : k + BLOCK], hashes[s], percent)
                        a.append(x)
                        b.append(y)
                continue
            rest = m[1:]
            if len(rest) < 2 or (rest["group"] == rest["group"][0]).all():
                continue
            if len(rest) <= BLOCK:
                x, y = _across(rest, rest, percent)
                a.append(x)
                b.append(y)
            else:
                rest = rest[np.argsort(rest["n"], kind="stable")]
                parts = [rest[k : k + BLOCK] for k in range(0, len(rest), BLOCK)]
                for i, p in enumerate(parts):
                    for q in parts[i:]:
                        if 100 * int(p["n"][-1]) >= percent * int(q["n"][0]) and len(np.unique(np.concatenate((p["group"], q["group"])))) > 1:
                            left.append(p.tobytes())
                            right.append(q.tobytes())
        return _pair_table(a, b, left, right)

    found = _postings(rows, parts).groupBy("bucket").applyInArrow(run, _PAIRS)
    if not across:
        return found.select("a", "b").distinct()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = _across(np.frombuffer(p, _MEMBER), np.frombuffer(q, _MEMBER), percent)
                yield from _pair_table([x], [y], [], []).select(["a", "b"]).to_batches()

    found = settle(found)
    blocks = found.filter("a IS NULL").select("left", "right").repartition(n_tasks(found)).mapInArrow(expand, "a long, b long")
    return found.filter("a IS NOT NULL").select("a", "b").union(blocks).distinct()


def _drawn(x: np.ndarray, seed: np.uint64, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member with one of another group, if any passes."""
    a, b, draw = [], [], mix(x["label"].astype(np.uint64) ^ seed)
    for i in range(len(x)):
        ok = np.flatnonzero((x["group"] != x["group"][i]) & passing(x[i : i + 1], x, percent))
        if len(ok):
            a.append(x["label"][i])
            b.append(x["label"][ok[int(draw[i] % np.uint64(len(ok)))]])
    return np.array(a, np.int64), np.array(b, np.int64)


def _across(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = [], []
    for i in range(len(x)):
        ok = (y["group"] != x["group"][i]) & passing(x[i : i + 1], y, percent)
        if ok.any():
            b.append(y["label"][ok])
            a.append(np.full(len(b[-1]), x["label"][i]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def verified(pairs: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs with linked: whether they are, by their shared elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ea, eb = (c.to_pylist() for c in batch.columns)
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                both = np.concatenate((np.frombuffer(ea[i], np.uint64), np.frombuffer(eb[i], np.uint64)))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * shared >= percent * (na[i] + nb[i] - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"])

    one = rows.select(F.col("label").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    two = rows.select(F.col("label").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ea", "eb").mapInArrow(run, "a long, b long, linked boolean")


class Groups(NamedTuple):
    """Settled frames: rows (part, id, row_key, key, key2, n), classes of equal sets (key, key2, m rows, and no_id, id, row_key, node, part of the smallest row) and the classes that links join (key, key2, root, best: the smallest row under the root)."""

    rows: DataFrame
    classes: DataFrame
    linked: DataFrame


_ROW = ("no_id", "id", "row_key", "node", "part")


def groups(docs: inplace.Pinned, percent: int = PERCENT, shingle: int = SHINGLE) -> Groups:
    rows = settle(measured(docs, shingle).withColumn("node", F.monotonically_increasing_id()))
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key", "node", "part")
    by_set = rows.filter("n > 0").groupBy("key", "key2").agg(F.min(row).alias("r"), F.count(F.lit(1)).alias("m"))
    classes = settle(by_set.select("key", "key2", "m", "r.*"))
    filed = inplace.file_away(classes.select("part", F.col("row_key").alias("key"), "node"))
    near = inplace.file_away(likely(docs, filed, percent, shingle))
    sets = settle(sets_of(docs, filed, near, shingle))
    inplace.delete(filed, near)
    rank = settle(ranked(sets, docs.parts, percent))
    done = settle(verified(candidates(rank.withColumn("grp", F.col("label")), docs.parts, percent), rank, percent))
    final = components(done.filter("linked").select("a", "b"))
    for pivot in (*["drawn"] * DRAWN, "none"):
        grouped = rank.join(final.select(F.col("a").alias("label"), F.col("b").alias("c")), "label", "left").withColumn("grp", F.coalesce("c", "label"))
        new = candidates(grouped, docs.parts, percent, pivot=pivot).join(done.select("a", "b"), ["a", "b"], "left_anti")
        checked = settle(verified(new, rank, percent))
        links = checked.filter("linked").select("a", "b")
        if links.limit(1).count():
            final = components(final.union(links))
        done = done.union(checked)
    members = final.select(F.col("a").alias("node"), F.col("b").alias("root")).union(final.select("b", F.col("b").alias("root")).distinct())
    joined = settle(classes.join(members, "node").select("key", "key2", "root", F.struct(*_ROW).alias("r")))
    best = joined.groupBy("root").agg(F.min("r").alias("best"))
    return Groups(rows, classes, settle(joined.select("key", "key2", "root").join(best, "root")))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    found = groups(_pinned(docs, id_col, text_col), percent, shingle)
    # a class of one text without links needs no look-up; a set without elements has a key of its own: no hot key, no match
    told = found.classes.select("key", "key2", "m", "id").join(found.linked, ["key", "key2"], "left").filter("m > 1 OR root IS NOT NULL")
    # settled, so that Spark may split the join below where copies of one text are many
    told = settle(told.select("key", "key2", F.lit(True).alias("told"), F.when(F.col("root").isNotNull(), F.col("best.id")).otherwise(F.col("id")).alias("component")))
    some = F.col("n") > 0
    mine = found.rows.select("id", "n", F.when(some, F.col("key")).otherwise(F.col("node")).alias("key"), F.when(some, F.col("key2")).otherwise(F.lit(-1).cast("long")).alias("key2"))
    out = mine.join(told, ["key", "key2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("told"), F.col("component")).otherwise(F.col("id")).alias("component_id"))


def distinct_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id (of several rows with that id, one); all that have no words, for they are linked with nothing. Columns as they were, whatever their names."""
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(NOT_SEPARATOR)
    whole = _pinned(docs, id_col, text_col, has_words.alias("words"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = groups(whole, percent)
    alone = found.classes.join(found.linked.select("key", "key2"), ["key", "key2"], "left_anti").select(*_ROW)
    kept = alone.union(found.linked.select("root", "best").distinct().select("best.*"))
    filed = inplace.file_away(kept.select("part", F.col("row_key").alias("key"), F.coalesce("id", F.lit(0)).alias("id"), F.col("no_id").cast("long").alias("no_id")))
    kind = docs.schema.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told, done = None, None, None
        for part, batch in inplace.by_part(batches):
            if part != at:
                at, told = part, inplace.Told(filed, part, "key", "id", "no_id")
                done = np.zeros(len(told.names), bool)
            ids = batch.column(batch.schema.get_field_index("id"))
            keys = batch.column(batch.schema.get_field_index("row_key")).to_numpy()
            at_row = told.find(keys, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
            stay = ~batch.column(batch.schema.get_field_index("words")).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero((at_row >= 0) & ~stay)
            _, first = np.unique(at_row[rows], return_index=True)
            rows = rows[first][~done[at_row[rows[first]]]]
            done[at_row[rows]] = True
            stay[rows] = True
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")).filter(pa.array(stay))], names=["row"])

    return whole.rows.select("part", "id", "row_key", "words", "row").mapInArrow(keep, f"row {kind}").select("row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL_OP7 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)) l),
d AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS v, a AS c FROM d UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.v WHERE d.b > r.c)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = w.doc_id"""
