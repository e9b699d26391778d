"""Token counts by overlap resynchronisation.

Texts of up to ``chunk`` characters are counted as they are. A longer text is
cut into chunks that overlap; the chunks are dealt over the cluster and encoded
with offsets, and neighbours are spliced where both have a boundary between
pre-tokens. Such a boundary is proven stable: a byte-level tokenizer without a
normaliser cuts from left to right, what it does from a boundary on depends
only on what follows, and it looks at most ``MARGIN`` characters ahead, which
the left chunk still has. From the first common boundary on both chunks
therefore agree with the encoding of the whole text. Neighbours without a
common boundary are widened into one piece from the last proven boundary to the
next one, which is encoded again, whole.

Equal long texts are encoded once. Tokenizers for which the proof doesn't hold
(a normaliser, sentencepiece models) encode every text whole.

Rows: a null text counts as the empty one, with 0 bytes and 0 tokens; texts of any
length are counted whole; repeated rows each get their row; an empty table gives
an empty result; further columns pass through unchanged, whatever their names,
but for the texts and for columns named n_bytes or n_tokens, which are replaced.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coastline.llm.common import cut as cut_off
from coastline.llm.common import shuffle_partitions

CHUNK = 65_536
OVERLAP = 1_024
#: Characters that a pre-token's end may depend on beyond itself, added tokens included.
MARGIN = 64
#: Characters that are encoded at a time.
BATCH = 500_000
#: Pieces of a text that are handed on at a time.
PIECES = 16


@cache
def encoder(path: str):
    """(count of each text, encoding with offsets or None if long texts can't be spliced)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def counts(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return counts, (lambda text: tokenizer.encode(text, add_special_tokens=False)) if spliceable(path) else None


@cache
def spliceable(path: str) -> bool:
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    added = made.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer") and not made.get("post_processor")
    return bool(plain) and all(len(x["content"]) + 8 <= MARGIN and not (x["single_word"] or x["lstrip"] or x["rstrip"]) for x in added)


def boundaries(encoding, length: int) -> dict[int, int]:
    """Offsets between pre-tokens -> tokens before them; both ends included."""
    out, last = {0: 0}, None
    for k, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last:
            out[start] = k
        last = word
    out[length] = len(encoding.ids)
    return out


def _in_batches(texts: list[str], counts) -> list[int]:
    out, at = [], 0
    while at < len(texts):
        n = size = 0
        while at + n < len(texts) and (not n or size + len(texts[at + n]) <= BATCH):
            size += len(texts[at + n])
            n += 1
        out += counts(texts[at : at + n])
        at += n
    return out


def _long_counts(long_rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(digest, n_tokens) of the long texts (digest, text)."""
    texts = cut_off(long_rows.groupBy("digest").agg(F.first("text").alias("text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                n = -(-len(text) // chunk)
                for a in range(0, n, PIECES):
                    yield pa.RecordBatch.from_pylist([{"digest": digest, "i": i, "last": (i + 1) * chunk >= len(text), "piece": text[i * chunk : (i + 1) * chunk + overlap]} for i in range(a, min(n, a + PIECES))])

    pieces = texts.select("digest", "text").mapInArrow(cut, "digest string, i bigint, last boolean, piece string")
    pieces = pieces.repartition(shuffle_partitions(long_rows.sparkSession), "digest", "i")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoding = encoder(path)
        kind = pa.map_(pa.int64(), pa.int64())
        for batch in batches:
            for row in batch.to_pylist():
                first, piece = row["i"] * chunk, row["piece"]
                at = boundaries(encoding(piece), len(piece))
                head = [(first + p, n) for p, n in at.items() if p < overlap]
                tail = [(first + p, n) for p, n in at.items() if chunk <= p <= len(piece) - MARGIN and not row["last"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["digest"]]), pa.array([row["i"]], pa.int64()), pa.array([at[len(piece)]], pa.int64()), pa.array([head], kind), pa.array([tail], kind)],
                    names=["digest", "i", "total", "head", "tail"],
                )

    done = pieces.mapInArrow(encode, "digest string, i bigint, total bigint, head map<bigint,bigint>, tail map<bigint,bigint>")
    order = Window.partitionBy("digest").orderBy("i")
    following = F.lead("head").over(order)
    done = done.withColumn("right", F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys(following))))
    done = done.withColumns({"left": F.lag("right").over(order), "final": F.lead("i").over(order).isNull()})
    starts = (F.col("i") == 0) | F.col("left").isNotNull()
    done = done.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    within = F.when(F.col("final"), F.col("total")).otherwise(F.element_at("tail", F.col("right"))) - F.coalesce(F.element_at("head", F.col("left")), F.lit(0))
    runs = done.groupBy("digest", "run").agg(
        F.count(F.lit(1)).alias("n"), F.max(within).alias("within"), F.coalesce(F.max(F.when(starts, F.col("left"))), F.lit(0)).alias("a"), F.max(F.when(~F.col("final"), F.col("right"))).alias("b")
    )
    spliced = runs.where("n = 1").select("digest", F.col("within").alias("n_tokens"))
    failed = runs.where("n > 1").select(F.col("digest").alias("d"), "a", "b").join(texts, F.col("d") == F.col("digest")).select("digest", "a", "b", "text")

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoding = encoder(path)
        for batch in batches:
            for row in batch.to_pylist():
                a, b = row["a"], row["b"]
                piece = row["text"][a:] if b is None else row["text"][a : b + MARGIN]
                n = boundaries(encoding(piece), len(piece))[len(piece) if b is None else b - a]
                yield pa.RecordBatch.from_arrays([pa.array([row["digest"]]), pa.array([n], pa.int64())], names=["digest", "n_tokens"])

    return spliced.unionByName(failed.mapInArrow(widen, "digest string, n_tokens bigint")).groupBy("digest").agg(F.sum("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without its texts, with n_bytes and n_tokens of each."""
    kept = [f.name for f in docs.schema.fields if f.name not in (text_col, "n_bytes", "n_tokens")]
    # the caller's columns travel as one, so that their names can't clash with those in here
    rows = docs.select(F.struct(F.lit(0).alias("n_tokens"), *[F.col(f"`{x}`") for x in kept]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.col("n_bytes") > chunk if spliceable(path) else F.lit(False)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, _ = encoder(path)
        for batch in batches:
            n = _in_batches(batch.column(1).to_pylist(), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["row", "n_bytes", "n_tokens"])

    schema = StructType([rows.schema["row"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    out = rows.where(~is_long).mapInArrow(each, schema)
    if spliceable(path):
        long_rows = rows.where(is_long).withColumn("digest", F.sha2(F.col("text"), 256))
        counted = _long_counts(long_rows.select("digest", "text"), path, chunk, overlap)
        out = out.unionByName(long_rows.drop("text").join(counted, "digest").select("row", "n_bytes", "n_tokens"))
    return out.select(*[F.col("row").getField(x).alias(x) for x in kept], "n_bytes", "n_tokens")
