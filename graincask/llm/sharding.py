"""Vector bin packing of documents into shards that balance bytes, tokens and rows jointly.

Equal texts form a group and stay in one shard. Each group goes, largest first, to the shard with room for it whose residual capacity has the highest dot product with the group's size vector.
A group that alone holds over 1 / (shards * HEAVY) of any total, of which there are at most 3 * shards * HEAVY, is placed on the driver first. What capacity is left is shared out to cells of about CELL_ROWS rows, by hash of the group;
each cell packs its own groups one by one into its part of every shard's capacity, so the whole is as balanced as its cells, no list of groups is gathered anywhere, and a task's group is of one size however many rows there are.
A group larger than a shard's fair share can't stay whole without breaking the balance: it is cut into equal parts. Rows of heavy groups are dealt to the cells like any others, so no task has a hot group.

Tokens are counted by a fixed rule instead of a tokenizer's run over all texts: an ASCII letter run counts one per six letters begun, other ASCII marks and digits one each, other characters one per two begun.

Defined results: a null text is none, of size 1 and checksum 0, and equal to the empty text. Repeated rows are rows of one group, each with its own
slot. A null id is placed like any other. An empty table gives an empty result. Columns that aren't named in the call are not read.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graincask.llm.common import settle, table

#: The part of a shard's fair share above which a group is heavy, and the parts of a share that a group which must be cut is cut into.
HEAVY, PARTS = 64, 8
#: Rows per cell on average, by hash.
CELL_ROWS = 10_000
SIZES = ("bytes", "tokens", "n_rows")
TOKEN = r"[A-Za-z]{1,6}|[^\x00-\x7F]{1,2}|[\x21-\x40\x5B-\x60\x7B-\x7E]"


def place(units: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Shard of each unit; units: a row of bytes, tokens, rows each; left: the same capacities per shard, which are taken from. Greedy by dot product with the residual capacity.

    The first column is held to: among the shards that a unit fits, the dot product decides; if it fits none, the shard with most room for bytes takes it.
    """
    scale = np.maximum(left.sum(axis=0) / len(left), 1e-9)  # 1: a shard's fair part
    share, room = units / scale, left / scale
    out = np.zeros(len(units), np.int32)
    for i in np.lexsort((np.arange(len(units)), -share.max(axis=1, initial=0))).tolist():
        mine, bytes_left = share[i], room[:, 0]
        k = int(bytes_left.argmax())
        if bytes_left[k] >= mine[0]:
            k = int(np.where(bytes_left >= mine[0], room @ mine, -np.inf).argmax())
        out[i] = k
        room[k] -= mine
    left[:] = room * scale
    return out


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, tokens, crc, group digest and a number of its own. Settled, without texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.monotonically_increasing_id().alias("row"),
    )
    return settle(rows)


_PLACED = "doc_id long, size long, text_crc32 long, cell int, shard int, rank long"


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    rows = measure(docs, id_col=id_col, text_col=text_col)
    sums = (F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(*sums).first()
    if not total["n_rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    left = np.array([[total[c] / shards for c in SIZES]] * shards, float)
    over = F.greatest(F.lit(0.0), *[F.col(c) * shards / F.lit(total[c]) for c in SIZES if total[c]])  # in shares of a shard
    heavy = rows.groupBy("digest").agg(*sums).withColumn("over", over).filter(F.col("over") * HEAVY > 1)
    groups = [(bytes(r["digest"]), 1 if r["over"] <= 1 else int(np.ceil(r["over"] * PARTS))) for r in heavy.select("digest", "over").collect()]
    plan = spark.createDataFrame(pa.table({"digest": pa.array([d for d, _ in groups], pa.binary()), "heavy": pa.array(range(len(groups)), pa.int32()), "parts": pa.array([n for _, n in groups], pa.int32())}))
    marked = rows.join(F.broadcast(plan), "digest", "left").withColumn("cut", F.pmod("row", "parts").cast("int"))
    units = marked.filter("heavy IS NOT NULL").groupBy("heavy", "cut").agg(*sums).orderBy("heavy", "cut").toPandas()
    units["given"] = place(units[list(SIZES)].to_numpy(float), left)
    given = spark.createDataFrame(pa.table({c: pa.array(units[c].to_numpy(np.int32)) for c in ("heavy", "cut", "given")}))
    cells = max(1, total["n_rows"] // CELL_ROWS)
    cell = F.pmod(F.when(F.col("heavy").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("row")), F.lit(cells)).cast("int")
    dealt = marked.join(F.broadcast(given), ["heavy", "cut"], "left").select("doc_id", "size", "tokens", "text_crc32", "digest", "given", cell.alias("cell"))
    residual = np.maximum(left, 0)
    residual /= np.maximum(residual.sum(axis=0), 1e-9)

    def pack(t: pa.Table) -> pa.Table:
        given = t.column("given").combine_chunks()
        out = given.fill_null(-1).to_numpy().copy()
        light = np.flatnonzero(out < 0)
        if len(light):
            group, names = pd.factorize(t.column("digest").take(pa.array(light)).to_pandas())
            size, tokens = (t.column(c).to_numpy()[light] for c in ("size", "tokens"))
            vectors = np.stack([np.bincount(group, x, len(names)) for x in (size, tokens, np.ones(len(light)))], 1)
            out[light] = place(vectors, residual * vectors.sum(axis=0))[group]
        order = np.argsort(out, kind="stable")
        rank = np.empty(len(out), np.int64)
        rank[order] = np.arange(len(out)) - np.searchsorted(out[order], out[order])
        return t.select(["doc_id", "size", "text_crc32", "cell"]).append_column("shard", pa.array(out, pa.int32())).append_column("rank", pa.array(rank))

    placed = settle(dealt.groupBy("cell").applyInArrow(pack, _PLACED))
    counts = placed.groupBy("cell", "shard").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("cell", "shard", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    return placed.join(offsets, ["cell", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
