"""Operator 4: token ids as Parquet lists, written in id order and read selectively.

Documents are range-partitioned and sorted by id, so file k holds only smaller ids than file
k+1 and each file is written once, by Spark's committed writer, wherever the session's
file system is. In a file, `ids` is a dictionary-encoded list column; `doc_id`, `n_tokens`,
`local_start` and `part` are delta-encoded. Row groups and pages have set sizes and
page indexes (column and offset index) are on, so a reader that wants a few documents or
only the metadata columns reads only their pages.

`local_start` counts ids before a document *in its file*; global starts come from a manifest
of one row per file, built from the metadata columns alone.

Cases: a null text counts as empty (only the end id is written); null ids come first;
repeated rows are written again; an empty table gives files without rows; other columns of
the input are not written.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.bpe import PieceEncoder, int_lists
from weftgraph.llm.common import bounded_batches, fresh, steps

#: Writer settings: version 2 pages give delta encoding where no dictionary is kept.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.columnindex.truncate.length": "64",
}

#: Pieces a generation of a worker's cache holds (results do not depend on it).
CACHE_PIECES = 400_000
#: Pieces that the library encodes in one text.
JOINT_PIECES = 200
#: Parts pieces in such a text; a byte that UTF-8 never has, and a character that stands for no byte.
GAP_BYTE, GAP = b"\xff", "\n"
#: Stored bytes of input for each token file at most, about.
FILE_BYTES = 128 << 20


def byte_letters() -> np.ndarray:
    """Code point of the character that stands for each byte in byte-level tokens, GAP for GAP_BYTE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.arange(256, dtype="<u4")
    out[np.setdiff1d(np.arange(256), shown)] = 256 + np.arange(256 - len(shown))
    out[ord(GAP_BYTE)] = ord(GAP)
    return out


class LibraryEncoder:
    """Ids as the tokenizers library gives them.

    The library's pre-tokenizer cuts a text into the pieces that `pretokenize` finds and
    encodes each alone, so each distinct piece is encoded by the library once per worker. A
    text with one of its special strings is encoded by the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.joint = Tokenizer(self.library.model)  # for pieces that are written as byte letters already
        self.joint.pre_tokenizer = CharDelimiterSplit(GAP)
        self.letters = byte_letters()
        vocabulary = self.library.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))  # a byte is one character of a token
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache = PieceEncoder(self._pieces, CACHE_PIECES)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces, number of each).

        Many are encoded in one text, which the library cuts at GAP only; where the pieces' bytes
        don't end with tokens (a vocabulary without some bytes), each alone.
        """
        raw = list(map(str.encode, new))
        blocks = [np.frombuffer(GAP_BYTE.join(raw[at : at + JOINT_PIECES]), np.uint8) for at in range(0, len(raw), JOINT_PIECES)]
        found = self.joint.encode_batch_fast([self.letters[x].tobytes().decode("utf-32-le") for x in blocks], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        until = np.cumsum(self.size[ids])
        if len(ids) and until[-1] == ends[-1]:
            at = np.searchsorted(until, ends)
            if (until[at] == ends).all():
                return ids, np.diff(at, prepend=-1)
        single = self._whole(new)
        counts = np.fromiter(map(len, single), np.int64, len(single))
        return np.fromiter(chain.from_iterable(single), np.int32, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        ids, per = self.cache.encode(texts if not odd else ["" if i in set(odd) else t for i, t in enumerate(texts)])
        if odd:
            parts = np.split(ids, np.cumsum(per)[:-1])
            for i, got in zip(odd, self._whole([texts[i] for i in odd])):
                parts[i] = np.array(got, np.int32)
            ids, per = np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        return ids, per


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def tokenised(df: DataFrame, tokenizer: str, end_id: int, files: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in id order over `files` partitions: part, doc_id, local_start, n_tokens, ids."""
    ordered = df.select(df[id].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, code = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in steps([len(x) for x in texts]):
                ids, per = code.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(per), end_id)
                per = per + 1
                until = before + np.cumsum(per)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part, np.int32)), batch.column("doc_id").slice(a, b - a), pa.array(until - per), pa.array(per), int_lists(ids, per)],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                before = int(until[-1])

    return ordered.mapInArrow(run, "part int, doc_id long, local_start long, n_tokens long, ids array<int>")


def planned_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size, for files the bytes that are stored."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size > 1 << 60 else size  # what is not known counts as the largest size


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None, id: str = "doc_id", text: str = "text") -> None:
    """Writes the token files of `df` to the folder `path` (replaced).

    Without `files`, their number is the session's shuffle partitions, or more if the plan's size needs it.
    """
    files = files or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(planned_bytes(df) / FILE_BYTES))
    tokenised(df, tokenizer, end_id, files, id, text).write.mode("overwrite").options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids. Filters on doc_id reach the page indexes.

    The broadcast manifest has one row per file, so its size is the writer's `files`.
    """
    data = spark.read.schema("part int, doc_id long, local_start long, n_tokens long, ids array<int>").parquet(path)
    totals = data.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    manifest = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    rows = data.join(F.broadcast(manifest), "part")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def ids_crc32(df: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """`keep` and ids_crc32: unsigned crc32 of the ids as little-endian 32-bit integers; null ids count as none."""
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    source = fresh(df, "ids")
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(source)
            values = np.asarray(column.flatten()).astype("<i4", copy=False)
            ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]).tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    return df.select(*keep, df[ids].alias(source)).mapInArrow(run, f"{fields}, ids_crc32 long")
