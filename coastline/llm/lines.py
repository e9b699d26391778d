"""Line dedup: lines that many documents share stay in one of them.

Texts are cut at line feeds. A line's key is the line without ASCII white space
at its ends and with A-Z lower-cased. Each document's distinct keys of
``least_chars`` code points or more are exploded as digests of 128 bits; a digest
that ``least_docs`` documents or more have is frequent, and stays only in the
document of the largest id. The other documents get the digests they have to
drop; the lines that are left are put together again in their places.

At scale: only digests and ids are shuffled for the counts, first by (digest,
document), then, added up in each task, by digest, so that a line of a third of all
documents is a few partial counts. What a document has to drop is at most its own
lines. The joins are plain ones of two shuffles, of which Spark splits hot keys.

Rows: a null or empty text is one empty line, which is too short to go. Documents
are told apart by their ids: rows that share an id count as one document, and each
of them is treated alike. A row without an id counts for nothing and stays whole. An
empty table gives an empty result. Further columns pass through, but those named
like a new column, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastline.llm.common import ascii_lower, cut, fresh

LEAST_CHARS = 20
LEAST_DOCS = 3
_SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_SPACE)))


def digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _line_digests(text: Column, least_chars: int) -> Column:
    """A digest for each line, null for one that is too short to go."""
    return F.transform(lines_of(text), lambda line: F.when(F.char_length(line_key(line)) >= least_chars, digest(line_key(line))))


def frequent_lines(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(line, n_docs, keeper) of the lines that many documents have; found: (doc, line)."""
    each = found.groupBy("line", "doc").agg(F.count(F.lit(1)).alias("times"))
    return each.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= least_docs)


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with lines_n (lines before), lines_dropped and lines_text (the lines that stay)."""
    doc, version, gone = fresh(3)
    named = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).where("doc is not null")
    kinds = F.array_distinct(F.filter(_line_digests(F.col("text"), least_chars), lambda d: d.isNotNull()))
    found = cut(named.select("doc", "version", F.explode(kinds).alias("line")))
    frequent = cut(frequent_lines(found, least_docs))
    # rows that share an id and differ in their texts have lists of their own, so that none grows beyond one text's lines
    drops = found.join(frequent.select("line", "keeper"), "line").where("doc != keeper").groupBy("doc", "version").agg(F.collect_set("line").alias("gone"))
    drops = cut(drops).select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("gone").alias(gone))
    both = docs.join(drops, (F.col(id_col) == F.col(doc)) & (F.xxhash64(text_col) == F.col(version)), "left").drop(doc, version)
    return _reassembled(both, text_col, gone, least_chars)


def _reassembled(rows: DataFrame, text_col: str, gone: str, least_chars: int) -> DataFrame:
    """The rows with what is left of their texts when the lines of the digests in ``gone`` go."""
    added = [("lines_n", "bigint", pa.int64()), ("lines_dropped", "bigint", pa.int64()), ("lines_text", "string", pa.string())]
    kept = [f for f in rows.schema.fields if f.name not in {gone, *(n for n, _, _ in added)}]

    def stays(line: bytes, lost: set[bytes]) -> bool:
        key = line.strip(_SPACE.encode()).lower()  # of bytes: A-Z only
        return len(key) < least_chars or hashlib.md5(key, usedforsecurity=False).digest() not in lost

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index
            counts, dropped, texts = [], [], []
            for text, lost in zip(batch.column(place(text_col)), batch.column(place(gone)), strict=True):
                text = (text.as_py() or "").encode()
                lines = text.split(b"\n")
                counts.append(len(lines))
                if lost.is_valid:
                    digests = set(lost.as_py())
                    lines = [line for line in lines if stays(line, digests)]
                    text = b"\n".join(lines)
                dropped.append(counts[-1] - len(lines))
                texts.append(text.decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(place(f.name)) for f in kept), *(pa.array(c, t) for c, (_, _, t) in zip((counts, dropped, texts), added, strict=True))], names=[*(f.name for f in kept), *(n for n, _, _ in added)])

    return rows.mapInArrow(each, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {t}" for n, t, _ in added)]))
