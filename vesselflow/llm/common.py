"""Helpers that several operators of this folder share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.session import ensure_checkpoint_dir, ship_package

WHITE = " \t\n\x0b\x0c\r"
# Rows of an id list that may be broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
# Bytes of text that one numpy step handles at a time.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back: cuts the
    lineage, survives a lost executor, and lets later plans prune columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has at most ``limit`` rows; else unchanged,
    and its join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_bytes(df: DataFrame, size, limit: int = 32 << 20) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if ``size`` (a column: bytes of a row) sums to at most ``limit``;
    else unchanged, and its join shuffles."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]
    return F.broadcast(df) if total <= limit else df


def workers(spark: SparkSession) -> None:
    """Make this package importable in Python workers and keep their Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component), component being the
    smallest node reached; nodes without an edge are absent.  Each round hooks every node to its
    smallest neighbour and contracts the edges, so a hub costs one pre-aggregated minimum."""
    both = edges.select("a", "b").where("a <> b")
    live = materialise(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while True:
        hook = materialise(live.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")))
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            labels = labels.join(hook, labels.component == hook.a, "left").select(
                "node", F.coalesce("to", "component").alias("component"))
        labels = materialise(labels)
        left = live.join(hook, "a").select(F.col("to").alias("x"), "b")
        ha = hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        live = materialise(left.join(ha, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
                           .distinct())
        if live.isEmpty():
            return labels


# ---- word hashing in numpy -------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    flag = np.empty(len(buf) + 2, bool)
    flag[0] = flag[-1] = True
    flag[1:-1] = _SPACE[buf]
    turn = np.flatnonzero(flag[1:] != flag[:-1])
    return turn[0::2], turn[1::2]


def _hash(buf: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e = _words(buf)
    if not len(s):
        return np.empty(0, np.uint64), s, e
    size = e - s
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)      # of a byte in its word
    power = np.multiply.accumulate(np.full(int(size.max()), _BASE, np.uint64))
    byte = (_FOLD if fold else _BYTE)[buf[place + np.repeat(s, size)]]
    byte *= power[place]
    return mix(np.add.reduceat(byte, first) + size.astype(np.uint64)), s, e


def _pieces(text: bytes) -> list[bytes]:
    """Cuts of a long text at white space, each about CHUNK bytes."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        cut = next((i for i in range(at + CHUNK, len(text)) if _SPACE[text[i]]), len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def word_hashes(texts: list[bytes | None], fold: bool = False):
    """Yield, for each text in turn, the 64-bit hashes of its words.  ``fold`` lower-cases A-Z.
    Texts are handled about CHUNK bytes at a time, long ones in pieces."""
    group: list[bytes] = []
    held = 0

    def flush():
        joined = np.frombuffer(b"\n".join(group), np.uint8)
        h, s, _ = _hash(joined, fold)
        ends = np.cumsum([len(t) + 1 for t in group])
        cut = np.searchsorted(s, ends)
        return np.split(h, cut[:-1])

    for t in texts:
        t = t or b""
        if len(t) > CHUNK:
            if group:
                yield from flush()
                group, held = [], 0
            yield np.concatenate([_hash(np.frombuffer(p, np.uint8), fold)[0] for p in _pieces(t)])
            continue
        if held + len(t) > CHUNK and group:
            yield from flush()
            group, held = [], 0
        group.append(t)
        held += len(t) + 1
    if group:
        yield from flush()


_STEP = [np.uint64(int(x)) for x in mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words (``len(words) - k + 1`` of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i:i + n] * _STEP[i]
    return mix(out)


def byte_texts(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
