"""What the text operators share: word rules as columns, shared-folder tables, numpy tokenising."""

from __future__ import annotations

import re
import string
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def word_array(col: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD), F.lit(0))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in one process, as in tests, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed_rows(docs: DataFrame, **needed: Column) -> DataFrame:
    """The needed columns beside `row`, which holds all columns of docs whatever their names."""
    return docs.select(*[c.alias(k) for k, c in needed.items()], F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))


def unpacked_rows(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- numpy tokenising, for Arrow workers -------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Tokens:
    """Word hashes of a run of texts, in order: `hashes`, and for text k the slice starts[k]:starts[k + 1]."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray):
        self.hashes, self.starts = hashes, starts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


_INV = pow(_BASE, -1, 1 << 64)


def tokenise(texts: list[bytes], lower: bool = True) -> Tokens:
    """64-bit hashes of the words of whole texts, without a Python step per word.

    A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, then scrambled. Sums run over
    chunks of about 1 MB of whole texts, so that memory stays small; a longer text is a chunk of its own.
    """
    hashes, counts = [], []
    chunk: list[bytes] = []
    held = 0
    longest = max(1 << 20, max(map(len, texts), default=0) + 1) + (1 << 20)
    longest = min(longest, sum(map(len, texts)) + len(texts)) + 2
    power, inverse = _powers(longest, _BASE), _powers(longest, _INV)

    def flush() -> None:
        nonlocal chunk, held
        if not chunk:
            return
        joined = b"\n".join(chunk) + b"\n"
        raw = np.frombuffer(joined, dtype=np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        data = (_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)
        n = len(raw)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(data * power[:n], out=total[1:])
        word = (total[end] - total[begin]) * inverse[begin]
        hashes.append(mix64(word ^ ((end - begin).astype(np.uint64) << np.uint64(56))))
        ends = np.cumsum([len(x) + 1 for x in chunk])
        counts.append(np.diff(np.concatenate(([0], np.searchsorted(begin, ends, side="left")))))
        chunk, held = [], 0

    for x in texts:
        chunk.append(x)
        held += len(x) + 1
        if held >= 1 << 20:
            flush()
    flush()
    all_counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return Tokens(np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.concatenate(([0], np.cumsum(all_counts))).astype(np.int64))


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
