"""Curation of training data: decontamination with manifests, exact and near duplicates, licences, curriculum, mixing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graincask.functions import text as T

NGRAM = 13
SHORT, MIDDLE, LONG = 4096, 8192, 32768
#: Words of a shingle, MinHash functions, bands of them, and the similarity from which texts are near duplicates, in hundredths.
SHINGLE, HASHES, BANDS, PERCENT = 5, 64, 16, 75
#: Rows of a block: a bucket's pairs are dealt to tasks by pairs of its blocks.
BLOCK = 512
#: Sets of a side of a tile in which pairs are verified: of many small groups together, and of a larger group that is cut.
NODES, CUT = 1024, 256
PRIME = (1 << 31) - 1
# Phrases that show a licence, the first that is found counts.
LICENCES = (("Apache License", "apache-2.0"), ("MIT License", "mit"), ("GNU General Public License", "gpl-3.0"), ("CC BY-NC", "cc-by-nc-4.0"))
PERMISSIVE = ("apache-2.0", "mit")
_WORD = re.compile(T.WORD.encode())
#: Sets of shingles as numbers from a column.
Reader = Callable[[pa.Array], Iterator[np.ndarray]]


def hash_parameters(n: int = HASHES) -> list[tuple[int, int]]:
    """Multiplier and increment of each MinHash function, by rule."""
    return [(48271 * (k + 1) % PRIME, 69621 * (k + 7) % PRIME) for k in range(n)]


def licence_of(text: Column) -> Column:
    out = F.lit("unknown")
    for phrase, name in reversed(LICENCES):
        out = F.when(text.contains(phrase), name).otherwise(out)
    return out


def blocked_by_repo(tasks: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Tasks whose repository isn't on the list; the list's size decides whether it is broadcast."""
    return tasks.join(blocklist.select("repo").distinct(), "repo", "left_anti")


def gram_hits(tasks: DataFrame, evals: DataFrame, n: int = NGRAM) -> DataFrame:
    """instance_id of the tasks that share an n-gram of words with an evaluation statement. Only hashes meet; a hit is exact but for 64-bit collisions."""
    mine = tasks.select("instance_id", F.explode(T.ngram_hashes(T.words(F.col("problem_statement")), n)).alias("g"))
    theirs = evals.select(F.explode(T.ngram_hashes(T.words(F.col("problem_statement")), n)).alias("g")).distinct()
    return mine.join(theirs, "g", "left_semi").select("instance_id").distinct()


def decontaminate(tasks: DataFrame, blocklist: DataFrame, evals: DataFrame, n: int = NGRAM) -> DataFrame:
    """Adds reason: repo, ngram or keep, in that order of precedence."""
    blocked = blocklist.select("repo").distinct().withColumn("b", F.lit(True))
    hits = gram_hits(tasks, evals, n).withColumn("h", F.lit(True))
    both = tasks.join(blocked, "repo", "left").join(hits, "instance_id", "left")
    return both.withColumn("reason", F.when(F.col("b"), "repo").when(F.col("h"), "ngram").otherwise("keep")).drop("b", "h")


def manifest(judged: DataFrame, snapshot: str) -> DataFrame:
    """Per source: counts in, dropped by reason and out."""
    c = lambda r: F.count_if(F.col("reason") == r)
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_in"), c("repo").alias("n_dropped_repo"), c("ngram").alias("n_dropped_ngram"), c("keep").alias("n_out"), F.lit(snapshot).alias("pro_verified_snapshot"))


def dedup_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The smallest id of each text; a copied text is one row per task before the shuffle."""
    return docs.groupBy(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id (the smallest of each set of shingles), shingles as sorted distinct 28-bit hashes... of texts with at least one shingle."""
    grams = T.ngrams(T.words(F.coalesce(F.col("text"), F.lit(""))), SHINGLE)
    sets = docs.select("doc_id", F.array_sort(F.array_distinct(grams)).alias("shingles")).filter(F.size("shingles") > 0)
    return sets.groupBy(F.md5(F.array_join("shingles", "\n")).alias("set_id")).agg(F.min("doc_id").alias("doc_id"), F.first("shingles").alias("shingles"))


def _text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each lower-cased text: its distinct shingles as sorted 64-bit numbers, the first digits of their MD5."""
    for text in texts.cast(pa.binary()):
        w = _WORD.findall(text.as_py())
        yield _numbers([b" ".join(g) for g in set(zip(*(w[k:] for k in range(SHINGLE)), strict=False))])


def _given_sets(sets: pa.Array) -> Iterator[np.ndarray]:
    """The same of each array of strings."""
    for grams in sets:
        yield _numbers([g.encode() for g in grams.as_py()])


def _numbers(grams: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join([hashlib.md5(g, usedforsecurity=False).digest() for g in grams]), ">u8")[::2].astype(np.uint64))


def _signature(numbers: np.ndarray) -> bytes:
    """HASHES minima, 4 bytes each; a function's input is the first 28 bits."""
    a, b = (np.array(c, np.int64)[:, None] for c in zip(*hash_parameters(), strict=True))
    out = np.full(HASHES, PRIME, np.int64)
    for k in range(0, len(numbers), 8192):
        x = a * (numbers[k : k + 8192] >> np.uint64(36)).astype(np.int64) + b
        x = (x & PRIME) + (x >> 31)  # modulo PRIME but for one subtraction
        out = np.minimum(out, np.where(x >= PRIME, x - PRIME, x).min(axis=1))
    return out.astype(">u4").tobytes()


def _set_id(numbers: np.ndarray) -> bytes:
    return hashlib.md5(numbers.tobytes(), usedforsecurity=False).digest()


def _settled(df: DataFrame) -> DataFrame:
    """Computed once: in the folder that all executors share, where it is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir() and (where := sc.getConf().get("spark.checkpoint.dir")):
        sc.setCheckpointDir(where)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


def _signed(rows: DataFrame, read: Reader) -> DataFrame:
    """doc_id, set_id (null without a shingle), n, sig of rows of doc_id and value. No shingle leaves its task."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_set_id(x), len(x), _signature(x)) if len(x) else (None, 0, None) for x in read(batch.column("value"))]
            ids, n, sig = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], ["doc_id", "set_id", "n", "sig"])

    return _settled(rows.select("doc_id", "value").mapInArrow(sign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, set_id binary, n int, sig binary"))


def _classes(signed: DataFrame) -> DataFrame:
    """The smallest doc_id of each set; what else a set has is the same in all its rows."""
    return signed.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))


def _candidates(classes: DataFrame) -> DataFrame:
    """Pairs of nodes a and b (structs of doc_id and key) that share a band and whose sizes allow the similarity, a with the smaller doc_id.

    A bucket is cut in blocks and each pair of blocks is a key of the join, so a large one spreads. Buckets of one row end before the join.
    """
    width = 4 * HASHES // BANDS
    node = F.struct("doc_id", F.xxhash64("set_id").alias("key")).alias("node")
    banded = classes.filter(F.col("doc_id").isNotNull()).select(node, "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring(F.col("sig"), k * width + 1, F.lit(width)))).alias("band", "value"))
    bucket = W.partitionBy("band", "value")
    placed = banded.withColumns({"block": F.floor((F.row_number().over(bucket.orderBy("node")) - 1) / BLOCK), "size": F.count(F.lit(1)).over(bucket)}).filter("size > 1").withColumn("last", F.floor((F.col("size") - 1) / BLOCK))
    left = placed.select("band", "value", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.col("node").alias("a"), F.col("n").alias("p"))
    right = placed.select("band", "value", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("node").alias("b"), F.col("n").alias("q"))
    alike = 100 * F.least("p", "q") >= PERCENT * F.greatest("p", "q")
    return left.join(right, ["band", "value", "i", "j"]).filter(F.expr("a.doc_id < b.doc_id") & alike).select("a", "b").distinct()


def _tiles(pairs: DataFrame) -> DataFrame:
    """Adds i and j, the blocks of a and b: nodes with the same smallest partner stand together, CUT of them at most, so that a set is sent to few tiles and a large group spreads."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.min("e.to").alias("label"))
    several = max(1, -(-nodes.count() // NODES))
    of = W.partitionBy("label")
    blocks = nodes.select("node", F.when(F.count(F.lit(1)).over(of) > CUT, F.xxhash64("label", F.floor((F.row_number().over(of.orderBy("node")) - 1) / CUT))).otherwise(F.pmod(F.xxhash64("label"), F.lit(several))).alias("block"))
    one, two = (blocks.select(F.col("node").alias(n), F.col("block").alias(k)) for n, k in (("a", "i"), ("b", "j")))
    return pairs.join(one, "a").join(two, "b").select("i", "j", "a", "b")


def _shared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """a, b, shared, both of each pair of a tile: shingles in common, and those of a and b added up."""
    at = {(x["doc_id"], x["key"]): k for k, x in enumerate(sets.column("node").to_pylist())}
    each = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.column("shingles")]
    sizes = np.array([len(x) for x in each])
    names, codes = np.unique(np.concatenate(each), return_inverse=True)
    each = np.split(codes, np.cumsum(sizes)[:-1])
    a, b = (np.array([at[x["doc_id"], x["key"]] for x in pairs.column(n).to_pylist()]) for n in ("a", "b"))
    order = np.argsort(a, kind="stable")
    shared, mark = np.zeros(len(a), np.int64), np.zeros(len(names), bool)
    for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        mark[each[a[part[0]]]] = True
        for some in np.array_split(part, len(part) // NODES + 1):
            starts = np.cumsum(sizes[b[some]]) - sizes[b[some]]
            shared[some] = np.add.reduceat(mark[np.concatenate([each[k] for k in b[some]])], starts, dtype=np.int64)
        mark[each[a[part[0]]]] = False
    ids = [pc.struct_field(pairs.column(n), "doc_id") for n in ("a", "b")]
    return pa.table([*ids, shared, sizes[a] + sizes[b]], ["a", "b", "shared", "both"])


def _links(rows: DataFrame, read: Reader, signed: DataFrame) -> DataFrame:
    """a, b, jaccard of the linked classes. Candidates are found by signatures; only the rows of candidates are read for their shingles again, and a set goes once to each tile that has pairs of it."""
    pairs = _settled(_candidates(_classes(signed)))
    tiles = _settled(_tiles(pairs))
    ends = tiles.select("i", "j", F.explode(F.array("a.doc_id", "b.doc_id")).alias("doc_id"))
    wanted = ends.groupBy("doc_id").agg(F.collect_set(F.struct("i", "j")).alias("tiles"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(read(batch.column("value")))
            yield pa.record_batch([batch.column("doc_id"), pa.array([_set_id(x) for x in sets], pa.binary()), batch.column("tiles"), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "set_id", "tiles", "shingles"])

    packed = rows.select("doc_id", "value").join(wanted, "doc_id").mapInArrow(pack, f"doc_id {kind}, set_id binary, tiles array<struct<i: bigint, j: bigint>>, shingles binary")
    sets = packed.select(F.explode("tiles").alias("t"), F.struct("doc_id", F.xxhash64("set_id").alias("key")).alias("node"), "shingles").select("t.i", "t.j", "node", "shingles")

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        return _shared(one, two) if len(one) else pa.table([one.column("i").cast(two.column("node").type[0].type), *[pa.array([], pa.int64())] * 3], ["a", "b", "shared", "both"])

    sized = tiles.groupBy("i", "j").cogroup(sets.groupBy("i", "j")).applyInArrow(meet, f"a {kind}, b {kind}, shared long, both long")
    return sized.filter(100 * F.col("shared") >= PERCENT * (F.col("both") - F.col("shared"))).select("a", "b", F.round(F.col("shared") / (F.col("both") - F.col("shared")), 6).alias("jaccard"))


def minhash_links(sets: DataFrame) -> DataFrame:
    """Pairs a < b of classes with a Jaccard similarity of at least PERCENT, found by banded MinHash; sets: doc_id, shingles as strings."""
    rows = sets.select("doc_id", F.col("shingles").alias("value"))
    return _links(rows, _given_sets, _signed(rows, _given_sets))


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("value"))


def near_links(docs: DataFrame) -> DataFrame:
    """minhash_links of documents' shingles, of which only candidates' are moved."""
    rows = _lowered(docs)
    return _links(rows, _text_sets, _signed(rows, _text_sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id with the same shingles), duplicate_of (the smallest linked class that is smaller, else null) of every document."""
    rows = _lowered(docs)
    signed = _signed(rows, _text_sets)
    first = _links(rows, _text_sets, signed).groupBy("b").agg(F.min("a").alias("duplicate_of"))
    keyed = signed.select("doc_id", F.coalesce("set_id", F.concat(F.lit("none:"), F.col("doc_id").cast("string")).cast("binary")).alias("set_id"))
    classes = _classes(signed).select("set_id", F.col("doc_id").alias("class_id"))
    return keyed.join(classes, "set_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")).join(first, F.col("class_id") == F.col("b"), "left").select("doc_id", "class_id", "duplicate_of")


def curriculum(length: Column) -> Column:
    """1: below 4,096; 2: to 8,192; 3: to 32,768; 0: longer."""
    return F.when(length < SHORT, 1).when(length <= MIDDLE, 2).when(length <= LONG, 3).otherwise(0)


def capped(rows: DataFrame, is_extra: Column, key: str, share: float) -> DataFrame:
    """Main rows, and the extra ones whose rank by hash is within share of the main count."""
    main, extra = rows.filter(~is_extra), rows.filter(is_extra)
    limit = main.agg(F.floor(F.count(F.lit(1)) * share).alias("most"))
    # ranks by hash without one global sort of rows: buckets of the hash, their counts, then ranks within
    h = T.md5_number(F.col(key).cast("string"))
    placed = extra.withColumns({"__h": h, "__b": F.floor(h / (1 << 18))})
    before = placed.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(W.orderBy("__b")) - F.col("n"))  # at most 1,024 rows
    rank = F.col("before") + F.row_number().over(W.partitionBy("__b").orderBy("__h", key))
    kept = placed.join(F.broadcast(before), "__b").withColumn("__rank", rank).crossJoin(F.broadcast(limit)).filter("__rank <= most")
    return main.unionByName(kept.select(*rows.columns))


def fim(text: Column, key: Column) -> Column:
    """struct of prefix, middle and suffix, cut at two places that follow from the key."""
    n = F.length(text) + 1
    p, q = T.md5_number(F.concat(key.cast("string"), F.lit(":a"))) % n, T.md5_number(F.concat(key.cast("string"), F.lit(":b"))) % n
    lo, hi = F.least(p, q).cast("int"), F.greatest(p, q).cast("int")
    return F.struct(F.substring(text, F.lit(1), lo).alias("prefix"), F.substring(text, lo + 1, hi - lo).alias("middle"), F.substring(text, hi + 1, F.length(text)).alias("suffix"))
