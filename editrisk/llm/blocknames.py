"""Exact deduplication by deterministic block naming.

A normalised text (white space deleted) is cut into blocks of a fixed number of bytes.
All blocks of the corpus are sorted and get their position among the distinct
blocks as an integer name.  Adjacent names are then paired, the pairs sorted and
named in the same way, until every document has one name.  Two documents have the
same (number of blocks, name) exactly if their texts are equal: names come from
comparing contents, never from digests alone.

Sorting is one range partitioning by (64-bit hash, row, position).  Copies of one
block have one hash but many rows, so a block that a third of all rows hold spreads
over many partitions; sampled range keys are three integers, never contents.
Within a partition rows are sorted by (hash, content) and ranked as a stream; the
partitions' first and last blocks tell whether neighbours continue the same block.
If two different blocks of one hash meet at a partition's edge, the naming
is repeated with another hash, so names stay free of collisions.

Defined results: null counts as empty, all empty texts are equal; of equal texts the
longest original stays, then the smallest id (null ids last), then the first row, so of
repeated rows one stays; an empty table gives an empty result.  Only the id and the
text are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editrisk.llm.common import SPACE_BYTES, discard, shuffle_width, store

BLOCK_BYTES = 4096
#: Blocks handed to Spark at a time.
BATCH_BLOCKS = 2048


def cut_blocks(docs: DataFrame, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """One row per block: ``row`` (unique per input row), ``idx``, ``n_blocks``, ``block``;
    the first also has the id, the original's code points and the digest."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("idx", T.IntegerType()),
        T.StructField("n_blocks", T.IntegerType()), T.StructField("block", T.BinaryType()),
        T.StructField("id", ids.schema["id"].dataType), T.StructField("n_chars", T.LongType()),
        T.StructField("text_sha256", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            id_type = batch.schema.field("id").type
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), id_type, pa.int64(), pa.string()]
            pending: list[tuple] = []

            def flush() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*pending), types)]
                pending.clear()
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for key, value in zip(batch.column("id"), batch.column("text")):
                text = value.as_py() or ""
                data = text.encode().translate(None, SPACE_BYTES)
                n = max(1, -(-len(data) // block_bytes))
                digest = hashlib.sha256(data).hexdigest()
                for i in range(n):
                    block = data[i * block_bytes:(i + 1) * block_bytes]
                    first = (key.as_py(), len(text), digest) if i == 0 else (None, None, None)
                    pending.append((row, i, n, block, *first))
                    if len(pending) >= BATCH_BLOCKS:
                        yield flush()
                row += 1
            if pending:
                yield flush()

    return ids.mapInArrow(cut, schema)


RANKED = ("part int, row long, idx int, n_blocks int, rank long, "
          "first_hash long, first_block binary, first_n int, last_hash long, last_block binary, last_n int")


def rank_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense ranks of sorted (hash, block) rows, and one last row about the edges:
    first and last block, and how many distinct blocks share their hashes."""
    part = TaskContext.get().partitionId()
    names = [f.split()[0] for f in RANKED.split(", ")]
    rank, hash_, block = -1, None, None
    first, run = None, 0  # run: distinct blocks of the present hash
    first_n = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hashes, blocks = batch.column("hash"), batch.column("block")
        head = rank < 0 or blocks[0].as_py() != block
        new = pa.concat_arrays([pa.array([head]), pc.not_equal(blocks[1:], blocks[:-1])])
        ranks = pc.add(pc.cumulative_sum(pc.cast(new, pa.int64())), rank)
        for i in pc.indices_nonzero(new).to_pylist():
            h = hashes[i].as_py()
            run = run + 1 if h == hash_ else 1
            hash_ = h
            if first is None:
                first = (h, blocks[i].as_py())
            if h == first[0]:
                first_n = run
        block, rank = blocks[n - 1].as_py(), ranks[n - 1].as_py()
        none = lambda t: pa.nulls(n, t)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), batch.column("row"), batch.column("idx"),
             batch.column("n_blocks"), ranks, none(pa.int64()), none(pa.binary()), none(pa.int32()),
             none(pa.int64()), none(pa.binary()), none(pa.int32())], names=names)
    if first is not None:
        edge = [part, None, None, None, rank + 1, first[0], first[1], first_n, hash_, block, run]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(),
                 pa.int32(), pa.int64(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(edge, types)], names=names)


def name_blocks(rows: DataFrame, max_seeds: int = 8) -> DataFrame:
    """``row, idx, n_blocks, name`` of ``row, idx, n_blocks, block``; stored."""
    spark = rows.sparkSession
    for seed in range(max_seeds):
        hashed = rows.select("row", "idx", "n_blocks", "block",
                             F.xxhash64(F.lit(seed), "block").alias("hash"))
        ranked = store(
            hashed.repartitionByRange(shuffle_width(spark), "hash", "row", "idx")
            .sortWithinPartitions("hash", "block").mapInArrow(rank_partition, RANKED), "names")
        order = Window.orderBy("part")  # one row per partition
        edges = (ranked.where(F.col("row").isNull())
                 .withColumns({"p_hash": F.lag("last_hash").over(order),
                               "p_block": F.lag("last_block").over(order),
                               "p_n": F.lag("last_n").over(order)}))
        same = F.coalesce(F.col("first_hash") == F.col("p_hash"), F.lit(False))
        clash = same & ((F.col("first_block") != F.col("p_block")) | (F.col("first_n") > 1) | (F.col("p_n") > 1))
        edges = edges.select("part", F.col("rank").alias("n_names"), same.alias("goes_on"),
                             clash.alias("clash")).toPandas().sort_values("part")
        if not edges["clash"].any():
            break
        discard(ranked)
    else:
        raise RuntimeError("block hashes clash under every seed")
    # a partition that goes on with its neighbour's last block shares that name
    goes_on = edges["goes_on"].astype("int64")
    start = (edges["n_names"] - goes_on).cumsum().shift(fill_value=0) - goes_on
    if edges.empty:
        return ranked.select("row", "idx", "n_blocks", F.col("rank").alias("name"))
    offsets = spark.createDataFrame([(int(p), int(s)) for p, s in zip(edges["part"], start)],
                                    "part int, start long")  # one row per partition
    named = (ranked.where(F.col("row").isNotNull()).join(F.broadcast(offsets), "part")
             .select("row", "idx", "n_blocks", (F.col("rank") + F.col("start")).alias("name")))
    return named


def document_names(blocks: DataFrame) -> DataFrame:
    """``row, n_blocks, name``: names paired until each row has one."""
    levels = blocks.agg(F.max("n_blocks")).first()[0] or 1
    length, done = 1, []
    level = name_blocks(blocks.select("row", "idx", "n_blocks", "block"))
    hex8 = lambda c: F.lpad(F.hex(c), 16, "0")
    while True:
        # after a level with pairs spanning ``length`` blocks, shorter documents are done
        span = F.col("n_blocks") <= length
        if length > 1:
            span = span & (F.col("n_blocks") > length // 2)
        done.append(level.where(span).select("row", "n_blocks", "name"))
        if length >= levels:
            break
        pairs = (level.where(F.col("n_blocks") > length)
                 .groupBy("row", F.floor(F.col("idx") / 2).cast("int").alias("at"))
                 .agg(F.max("n_blocks").alias("n_blocks"),
                      F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
                      F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b")))
        block = F.unhex(F.concat(hex8(F.col("a")), F.coalesce(hex8(F.col("b")), F.lit("f" * 16))))
        level = name_blocks(pairs.select("row", F.col("at").alias("idx"), "n_blocks", block.alias("block")))
        length *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, ``keep_id, group_size, kept, text_sha256``."""
    blocks = store(cut_blocks(docs, block_bytes, id_col, text_col), "blocks")
    names = document_names(blocks)
    about = blocks.where(F.col("idx") == 0).select("row", "id", "n_chars", "text_sha256")
    found = store(about.join(names, "row"), "identities")
    discard(blocks)
    best = F.struct((-F.col("n_chars")).alias("a"), F.col("id").isNull().alias("b"), "id", "row")
    groups = found.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
    out = found.join(groups, ["n_blocks", "name"])
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
                      (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
