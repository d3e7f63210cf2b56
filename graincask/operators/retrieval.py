"""BM25 localisation of files by problem statements, and cosine search over embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graincask.functions import text as T

K1, B = 1.5, 0.75
#: Vectors of a block in a join of all with all.
BLOCK = 2048
TOP_K = 10
#: Of a search: rows of a side of a tile, tiles that vectors are at least cut into where there are enough, and what is multiplied at once.
SIDE, TILES, STEP = 1 << 17, 32, (256, 4096)


def term_frequencies(files: DataFrame, *, key: str = "path") -> DataFrame:
    """key, term, tf."""
    return files.select(key, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(files: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl over files with at least one token."""
    sizes = files.select(F.size(T.tokens(F.col("text"))).alias("dl")).filter("dl > 0")
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl").cast("double") / F.count(F.lit(1))).alias("avgdl"))


def localize(files: DataFrame, queries: DataFrame, *, top_k: int | None = TOP_K, boost: bool = True) -> DataFrame:
    """query_id, rank, path, symbol, score of the files that match each query best.

    files: path, text; queries: query_id, statement. Tokens of files are first cut to those that any query names
    (a broadcast where the query terms are few), so that the only shuffle by path carries matches.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("statement")))).alias("term"))
    named = queries.select("query_id", F.array_distinct(F.filter(T.identifiers(F.col("statement")), lambda x: F.length(x) > 2)).alias("named"))
    analysed = files.select("path", T.tokens(F.col("text")).alias("toks")).withColumn("dl", F.size("toks")).filter("dl > 0")
    stats = analysed.agg(F.count(F.lit(1)).alias("n"), (F.sum("dl").cast("double") / F.count(F.lit(1))).alias("avgdl"))
    terms = asked.select("term").distinct()
    tf = (
        analysed.select("path", "dl", F.explode("toks").alias("term")).join(terms, "term", "left_semi")
        .groupBy("path", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = (
        tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))  # stats is one row
        .groupBy("query_id", "path").agg(F.sum(part).alias("base"))
        .join(files.select("path", T.definitions(F.col("text")).alias("defs")), "path").join(named, "query_id")
    )
    hits = F.array_intersect("defs", "named")
    score = F.col("base") * (1 + 0.5 * F.size(hits)) if boost else F.col("base")
    out = scored.select("query_id", "path", F.when(F.size(hits) > 0, F.array_min(hits)).alias("symbol"), score.alias("raw")).filter("raw > 0")
    out = out.select("query_id", "path", "symbol", F.round("raw", 4).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    ranked = out.withColumn("rank", rank)
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


def localize_json(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, result of every query: the candidates as JSON in rank order, absent symbols as null, or the text that says there are none."""
    item = F.struct("rank", F.struct("path", "symbol", "score").alias("c"))
    listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("cs"))
    return queries.select("query_id").join(listed, "query_id", "left").select("query_id", F.when(F.col("cs").isNull(), "no candidates found").otherwise(F.to_json("cs", {"ignoreNullFields": "false"})).alias("result"))


def _dot(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of two matrices, summed from left to right as SQL does."""
    out = np.zeros(len(p))
    for k in range(p.shape[1]):
        out += p[:, k].astype(np.float64) * q[:, k]
    return out


def _matrix(lists: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows, absent elements as 0, and where there are elements."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = pa.chunked_array([c.flatten() for c in lists.chunks], lists.type.value_type)
    there = np.arange(width) < n[:, None]
    x = np.zeros(there.shape, np.float32 if pa.types.is_float32(lists.type.value_type) else np.float64)
    x[there] = pc.fill_null(flat, 0).to_numpy()
    there[there] = pc.is_valid(flat).to_numpy()
    return x, there


def _within(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by all keys, and each place's rank among those equal in all but the last."""
    at = np.lexsort(by[::-1])
    new = np.ones(len(at), bool)
    new[1:] = np.logical_or.reduce([k[at][1:] != k[at][:-1] for k in by[:-1]])
    return at, np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))


def _foremost(x: np.ndarray, there: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the first k for some query: of equal vectors the smallest ids count, and a query leaves out those of its own id."""
    _, same = np.unique(np.hstack([x.view(np.uint8), there.view(np.uint8)]).view(f"V{x.dtype.itemsize * x.shape[1] + x.shape[1]}").ravel(), return_inverse=True)
    at, rank = _within(same, ids, np.arange(len(ids)))
    at = at[rank < k]
    by, rank = _within(same[at], ids[at])
    return np.sort(at[by][rank < 2 * k])


def _best(p: np.ndarray, ids: np.ndarray, c: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each p by cosine in 6 digits and id: NaN first, null last. One that may round either way stays besides."""
    with np.errstate(invalid="ignore"):
        low, r = np.floor(c * 1e6 + 0.499999), np.floor(c * 1e6 + 0.500001)
    either = np.flatnonzero((low != r) & ~np.isnan(c) & ~null)
    sure = np.setdiff1d(np.arange(len(p)), either, assume_unique=True)
    kind = np.where(null, 2, np.where(np.isnan(c), 0, 1))[sure]
    keys = (p[sure], kind, np.where(kind == 1, -r[sure], 0.0), ids[sure])
    at = np.lexsort(keys[::-1])
    q = keys[0][at]
    first = np.searchsorted(q, q)
    return np.concatenate([sure[at[np.arange(len(at)) - first < k]], either])


def _nearest(one: pa.Table, two: pa.Table, k: int, dims: int | None, step: tuple[int, int]) -> pa.Table:
    """query_id, vec_id, c of the vectors in two that can be among the first k of a query in one.

    A product in single precision leaves out those that are below the k-th best by more than its error; what stays is summed again in double precision, in order.
    """
    width = max(pc.max(pc.list_value_length(t.column(n))).as_py() or 0 for t, n in ((one, "q"), (two, "embedding"))) or 1
    (x, mx), (y, my) = _matrix(one.column("q"), width), _matrix(two.column("embedding"), width)
    a, b = one.column("query_id").to_numpy(), two.column("vec_id").to_numpy()
    keep = _foremost(y, my, b, k)
    y, my, b = y[keep], my[keep], b[keep]
    with np.errstate(all="ignore"):
        xx, yy = _dot(x, x), _dot(y, y)
    x, mx, y, my = x[:, :dims], mx[:, :dims], y[:, :dims], my[:, :dims]
    plain_x, plain_y = ((n > 1e-150) & (n < 1e150) for n in (xx, yy))
    scaled = lambda m, n, plain: np.divide(m, np.sqrt(n)[:, None], out=np.zeros(m.shape), where=plain[:, None]).astype(np.float32)
    u, v = scaled(x, xx, plain_x), scaled(y, yy, plain_y)
    gaps_x, gaps_y = ~mx.all(axis=1), ~my.all(axis=1)
    holes = gaps_x.any() or gaps_y.any()
    margin = np.float32(2 * (x.shape[1] + 8) * 2.0**-24 + 2e-6)
    own = np.sort(b)
    spare = k + int((np.searchsorted(own, a, "right") - np.searchsorted(own, a)).max())  # its own rows may be among the best
    out = []
    for s in range(0, len(a), step[0]):
        rows = slice(s, s + step[0])
        best, found = np.full((len(a[rows]), spare), -np.inf, np.float32), []
        for t in range(0, len(b), step[1]):
            cols = slice(t, t + step[1])
            near = u[rows] @ v[cols].T
            near[:, ~plain_y[cols]] = -np.inf
            if gaps_x[rows].any() and gaps_y[cols].any():
                near[(mx[rows].astype(np.float32) @ my[cols].T.astype(np.float32)) == 0] = -np.inf
            p, q = np.nonzero(near > best.min(axis=1)[:, None])
            if len(p) > 64 * len(near):
                more = np.partition(near, max(0, near.shape[1] - spare), axis=1)[:, -spare:]
            else:
                nth = np.arange(len(p)) - np.searchsorted(p, p)
                more = np.full((len(near), int(nth.max(initial=0)) + 1), -np.inf, np.float32)
                more[p, nth] = near[p, q]
            best = np.partition(np.hstack([best, more]), more.shape[1], axis=1)[:, -spare:]
            may = near >= (best.min(axis=1) - margin)[:, None]
            may[:, ~plain_y[cols]] = True
            may[~plain_x[rows]] = True
            p, q = np.nonzero(may)
            p, q = p + s, q + t
            p, q = p[a[p] != b[q]], q[a[p] != b[q]]
            with np.errstate(all="ignore"):
                c = np.zeros(len(p))
                for i in range(x.shape[1]):
                    more = x[p, i].astype(np.float64) * y[q, i]
                    c += np.where(mx[p, i] & my[q, i], more, 0) if holes else more
                c /= np.sqrt(xx[p] * yy[q])
            null = np.zeros(len(p), bool)
            partial = np.flatnonzero(gaps_x[p] & gaps_y[q] | ~mx.any(axis=1)[p] | ~my.any(axis=1)[q])
            for part in np.array_split(partial, len(partial) // 65536 + 1):
                null[part] = ~(mx[p[part]] & my[q[part]]).any(axis=1)
            at = _best(p, b[q], c, null, k)
            found.append((p[at], b[q[at]], c[at], null[at]))
        p, ids, c, null = (np.concatenate(z) for z in zip(*found, strict=True))
        at = _best(p, ids, c, null, k)
        out.append((a[p[at]], ids[at], c[at], null[at]))
    p, ids, c, null = (np.concatenate(z) for z in zip(*out, strict=True))
    return pa.table({"query_id": p, "vec_id": ids, "c": pa.array(c, mask=null)})


def embedding_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, dims: int | None = None, side: int = SIDE, step: tuple[int, int] = STEP) -> DataFrame:
    """query_id, vec_id, cosine, rank of the nearest vectors for every query (query_id, q), all vectors searched.

    Queries and vectors are hashed to blocks of at most about `side` rows and each pair of blocks is a task's group; a block's best meet in a window. Absent elements count as in SQL's sums: not at all,
    and a pair without common ones has no cosine. dims: only so many leading elements are multiplied, while lengths are those of whole vectors.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    asked = queries.filter(F.col("query_id").isNotNull()).select("query_id", "q")
    n, m = rows.count(), asked.count()
    down = -(-m // side) or 1
    across = max(-(-n // side), min(TILES, -(-n // step[1]))) or 1
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.withColumn("i", F.pmod(F.xxhash64("query_id", "q"), F.lit(down)).cast("int")).withColumn("j", every(across))
    right = rows.withColumn("j", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(across)).cast("int")).withColumn("i", every(down))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        if not len(one) or not len(two):
            return pa.table({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "c": np.empty(0)})
        return _nearest(one, two, k, dims, step)

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "query_id long, vec_id long, c double").select("query_id", "vec_id", F.round("c", 6).alias("cosine"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def near_vectors(vectors: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, cosine of every two vectors of different ids whose cosine, rounded to 6 digits, is at least that; either is the query of the other.

    Ids are hashed to blocks and each pair of blocks is a task's group, so that every two vectors meet once. Vectors of other lengths or with nulls have no cosine.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select("vec_id", F.col("embedding").alias("v"), F.size("embedding").alias("d"))
    last = (rows.count() - 1) // block
    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, last + 1))).cast("int"))
    left = placed.select("d", F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(max(0, last)).cast("int"))).alias("j"), "vec_id", "v")
    right = placed.select("d", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), "vec_id", "v")

    def meet(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        d, i, j = (k.as_py() for k in key)
        a, b = (t.column("vec_id").to_numpy() for t in (one, two))
        x, y = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) for t in (one, two))

        def dot(p: np.ndarray, q: np.ndarray) -> np.ndarray:  # in the order of cosine()
            out = np.zeros(len(p))
            for k in range(d):
                out += p[:, k] * q[:, k]
            return out

        xx, yy = dot(x, x), dot(y, y)
        parts = [(a[:0], b[:0], np.empty(0))]
        for s in range(0, len(a) if len(b) else 0, 256):
            length = np.sqrt(np.outer(xx[s : s + 256], yy))
            # candidates by a product whose sums may differ in the last digits; their cosines are summed again in order
            p, q = np.nonzero((x[s : s + 256] @ y.T >= (least - 1e-5) * length) & (length > 0))
            p += s
            apart = a[p] < b[q] if i == j else a[p] != b[q]
            p, q = p[apart], q[apart]
            parts.append((a[p], b[q], dot(x[p], y[q]) / np.sqrt(xx[p] * yy[q])))
        return pa.table(dict(zip(("a", "b", "c"), (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True)))

    met = left.groupBy("d", "i", "j").cogroup(right.groupBy("d", "i", "j")).applyInArrow(meet, "a long, b long, c double").select("a", "b", F.round("c", 6).alias("cosine")).filter(F.col("cosine") >= least)
    ways = F.explode(F.array(F.struct(F.col("a").alias("query_id"), F.col("b").alias("vec_id")), F.struct(F.col("b").alias("query_id"), F.col("a").alias("vec_id"))))
    return met.select(ways.alias("w"), "cosine").select("w.query_id", "w.vec_id", "cosine")
