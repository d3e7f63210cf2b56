"""Toxicity scores by non-negative positive-unlabelled learning.

Training takes confirmed toxic examples and rows taken as unlabelled, which hold toxic ones too, and minimises the class-prior-corrected risk
prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1)) of a linear model over hashed words and word beginnings, with numpy on the driver. The prior is the toxic share of all labels that may be learned from.
Both sides are bounded samples of the labelled rows, drawn by the hash of the id, so that they don't depend on how the data are laid out; of the unlabelled side no label is looked at. Which features the model has is decided by
how many documents of the whole corpus, labelled or not, hold each: these counts cover every text. Scoring is a map over whole texts.

Defined results: a null or empty text has no features and gets the score of the intercept alone. A document that several labels confirm counts once. Rows with a null id or label teach nothing. Without any
confirmed example every score is 0. Repeated rows give repeated rows; an empty table gives an empty one. Scores never see labels, ids or other columns. score() refuses to keep a column that is named as a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm.common import table
from graincask.llm.words import NOT_ALNUM, Splitter, chunks, mix

#: Most confirmed rows, and most labelled rows taken as unlabelled, that a model is trained on.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Hashed feature space; word beginnings of so many bytes are features beside the words.
SPACE, BEGINNINGS = 1 << 20, (4, 5, 6)
#: A feature needs so many confirmed documents and such a part of them, so many standard errors more of them than of the corpus, and such a toxic share by the prior.
LEAST_DOCS, LEAST_PART, LEAST_Z, LEAST_SHARE = 3, 0.005, 3.5, 0.4
#: Weight of the squared weights in the risk.
DECAY = 3e-4
FOLDS = 5


def features(split: Splitter, data: np.ndarray, offsets: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text of a chunk and their text numbers; among: which of the feature space are wanted."""
    starts, ends, hashes, firsts = split.words(data, offsets)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    found, owner = [], []

    def add(h: np.ndarray, o: np.ndarray) -> None:
        number = (h & np.uint64(SPACE - 1)).astype(np.int64)
        some = slice(None) if among is None else among[number]
        found.append(number[some])
        owner.append(o[some])

    add(hashes, of)
    part = np.zeros(len(starts), np.uint64)
    for k in range(max(BEGINNINGS)):
        inside = starts + k < ends
        part = part * np.uint64(0x100000001B3)
        part[inside] += split.value[data[starts[inside] + k]]
        if k + 1 in BEGINNINGS:
            add(mix(part[inside] + np.uint64(k)), of[inside])
    key = np.unique(np.concatenate(owner) * SPACE + np.concatenate(found))
    return key % SPACE, key // SPACE


def document_counts(docs: DataFrame, wanted: np.ndarray, text_col: str) -> tuple[np.ndarray, int]:
    """How many of all documents hold each wanted feature, and how many there are. At most a row per wanted feature and task is summed."""
    context = docs.sparkSession.sparkContext
    mask = np.zeros(SPACE, bool)
    mask[wanted] = True
    given = context.broadcast(np.packbits(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, among, held, n = Splitter(NOT_ALNUM, lower=True), np.unpackbits(given.value).astype(bool), np.zeros(SPACE, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in chunks(batch, "text"):
                held += np.bincount(features(split, data, offsets, among)[0], minlength=SPACE)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*held[some].tolist(), n], pa.int64())], names=["feature", "n"])

    sums = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    held, n = np.zeros(SPACE, np.int64), 0
    for r in sums:
        if r["feature"] < 0:
            n = r["n"]
        else:
            held[r["feature"]] = r["n"]
    return held, n


def candidates(positive: list[np.ndarray]) -> np.ndarray:
    """Features of enough confirmed documents."""
    p, n = np.bincount(np.concatenate(positive), minlength=SPACE), len(positive)
    return np.flatnonzero(p >= min(max(LEAST_DOCS, LEAST_PART * n), n))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, held: np.ndarray, n_docs: int, *, epochs: int = 250, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, their weights and the intercept. held, n_docs: documents of the corpus that hold each candidate, and in all."""
    p, n_p, n_u = np.bincount(np.concatenate(positive), minlength=SPACE), len(positive), max(1, len(unlabelled))
    rate_p, rate_all = p / n_p, held / max(1, n_docs)
    spread = np.sqrt(np.maximum(rate_all * (1 - rate_all), 1 / max(1, n_docs)) * (1 / n_p + 1 / max(1, n_docs)))
    some = candidates(positive)
    kept = some[(rate_p[some] - rate_all[some] > LEAST_Z * spread[some]) & (prior * rate_p[some] >= LEAST_SHARE * (held[some] + 0.5) / max(1, n_docs))]
    place = np.full(SPACE, -1)
    place[kept] = np.arange(len(kept))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [place[r][place[r] >= 0] for r in rows]
        return np.concatenate([*cols, np.empty(0, np.int64)]).astype(np.int64), np.cumsum([0, *map(len, cols)])

    data = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(kept)), -2.0
    moment, second, t = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0
    rng = np.random.default_rng(seed)

    def margin(x, rows):
        cols, at = x
        take = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows]) if len(rows) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), at[rows + 1] - at[rows])
        return np.bincount(owner, w[cols[take]], len(rows)) + b, cols[take], owner

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    steps = max(1, -(-n_u // 1024))
    for _ in range(epochs):
        order_p, order_u = rng.permutation(n_p), rng.permutation(len(unlabelled))
        for rows_p, rows_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps), strict=True):
            if not len(rows_p):
                rows_p = rng.integers(0, n_p, 1)
            zp, cp, op = margin(data[0], rows_p)
            zu, cu, ou = margin(data[1], rows_u)
            # logistic loss: slope of the loss for +1 is sigmoid(z) - 1, for -1 sigmoid(z)
            negative = (np.log1p(np.exp(np.clip(zu, -40, 40))).mean() if len(zu) else 0.0) - prior * np.log1p(np.exp(np.clip(zp, -40, 40))).mean()
            slope_p = prior * (sigmoid(zp) - 1) / len(zp)
            slope_u = np.zeros(len(zu))
            if negative >= 0:
                slope_p = slope_p - prior * sigmoid(zp) / len(zp)
                slope_u = sigmoid(zu) / max(1, len(zu))
            g = np.zeros(len(kept) + 1)
            g[:-1] = np.bincount(cp, slope_p[op], len(kept)) + np.bincount(cu, slope_u[ou], len(kept)) + DECAY * w
            g[-1] = slope_p.sum() + slope_u.sum()
            t += 1
            moment = 0.9 * moment + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            step = rate * (moment / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return kept, w, float(b)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """The model, from labels of rows that aren't held out and texts of such rows."""
    confirmed = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    total = confirmed.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    if not total["p"]:
        return None
    by_hash = lambda df, n: df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(8), id_col).alias("h")).orderBy("h", "id").limit(n).select("id")
    positives = by_hash(confirmed.filter("y = 1"), POSITIVES).withColumn("kind", F.lit(1))
    wanted = positives.union(by_hash(confirmed, UNLABELLED).withColumn("kind", F.lit(0)))  # bounded by the two parameters
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id").select("id", "kind", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(NOT_ALNUM, lower=True)
        for batch in batches:
            blobs = [b""] * batch.num_rows
            for first, _, data, offsets in chunks(batch, "text"):
                f, o = features(split, data, offsets)
                for i in np.unique(o).tolist():
                    blobs[first + i] = f[np.searchsorted(o, i) : np.searchsorted(o, i, "right")].astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(blobs, pa.binary())], names=["id", "kind", "features"])

    seen: dict[tuple, np.ndarray] = {}
    for r in rows.mapInArrow(run, "id long, kind int, features binary").toLocalIterator(prefetchPartitions=True):
        seen.setdefault((r["kind"], r["id"], bytes(r["features"])), np.frombuffer(bytes(r["features"]), np.uint32).astype(np.int64))
    some = [seen[k] for k in sorted(seen)]
    kinds = [k[0] for k in sorted(seen)]
    positive = [f for f, k in zip(some, kinds, strict=True) if k == 1]
    if not positive:
        return None
    held, n_docs = document_counts(docs, candidates(positive), text_col)
    kept, w, b = train(positive, [f for f, k in zip(some, kinds, strict=True) if k == 0], total["p"] / total["n"], held, n_docs)
    return {"features": kept, "weights": w, "intercept": b, "prior": total["p"] / total["n"]}


def score(docs: DataFrame, model: dict | None, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Kept columns, score and predicted of every row."""
    if clash := set(keep) & {"score", "predicted"}:
        raise ValueError(f"columns named as results can't be kept: {sorted(clash)}")
    source = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(None if model is None else (model["features"], model["weights"], model["intercept"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, weight, intercept = Splitter(NOT_ALNUM, lower=True), np.zeros(SPACE), -np.inf
        if given.value is not None:
            weight[given.value[0]], intercept = given.value[1], given.value[2]
        among = weight != 0
        for batch in batches:
            z = np.full(batch.num_rows, intercept)
            for first, end, data, offsets in chunks(batch, "text"):
                f, o = features(split, data, offsets, among)
                z[first:end] += np.bincount(o, weight[f], end - first)
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            s[np.isneginf(z)] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    return source.mapInArrow(run, f"row {docs.select(*keep).schema.simpleString()}, score double, predicted int").select("row.*", "score", "predicted")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
