"""Best-fit packing with vector capacities.

Documents are tokenised where they are read (no text is shuffled) and cut into pieces of at most
``tokens`` ids.  Pieces, a few numbers each, are dealt over shards of about ``per_shard`` and each shard
is packed best-fit decreasing: a bin has residual tokens, documents and attention cost (sum of squared lengths);
among the open bins that satisfy all three, the piece goes to the one with the least weighted residual norm
after it (or, ``score="dot"``, the greatest weighted dot product of demand and residual).  A shard
wastes about one bin, so the count stays within ``1 / shard bins`` of one global packing.

Defined results: a null text counts as empty; an empty text is the end id alone; repeated rows are packed once
each; rows with a null id are packed too; an empty table gives an empty result; other columns are not read.
Texts of any length are handled in pieces cut where the tokenizer starts a new word anyway.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow.llm.common import materialise, workers

SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# A single space between two other characters that are no white space always starts a word of this vocabulary.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 1 << 20


class Encoder:
    """Ids of the byte-level vocabulary ``name``.json, by the faster library over the same vocabulary (``name``.tiktoken);
    texts that hold the special token's string go through the original library."""

    def __init__(self, name: str):
        import public_tokenizers as P
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}
        self.json, self.slow = P.path(f"{name}.json"), None
        self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.json)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.whole(text), "<u4")
        if len(text) <= _LONG:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + _LONG)
            end = cut.start() if cut else len(text)
            parts.append(np.array(self.fast.encode_ordinary(text[at:end]), "<u4"))
            at = end
        return np.concatenate(parts)


def cut(ids: np.ndarray, tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one if it fits, else whole ones with a shorter first."""
    n = len(ids)
    first = n % tokens or min(n, tokens)
    return [(0, first), *[(s, tokens) for s in range(first, n, tokens)]]


def pieces(docs: DataFrame, tokens: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                rows += [(doc, i, s, n, zlib.crc32(ids[s:s + n].tobytes())) for i, (s, n) in enumerate(cut(ids, tokens))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                   *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights=(1.0, 0.01, 0.01),
             score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length under the three capacities."""
    cap = np.array([tokens, documents, attention], float)
    if len(lengths) and (lengths.max() > tokens or float(lengths.max()) ** 2 > attention or documents < 1):
        raise ValueError("a piece exceeds the capacities of an empty bin")
    wt = np.array(weights, float)[:, None]
    bins, offs = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = float(lengths.min()) if len(lengths) else 0.0
    res, ids, n, total = np.empty((3, 1024)), np.empty(1024, np.int64), 0, 0
    for k in order:
        size = float(lengths[k])
        need = np.array([size, 1.0, size * size])
        spot = -1
        if n:
            fit = np.flatnonzero((res[0, :n] >= size) & (res[1, :n] >= 1) & (res[2, :n] >= need[2]))
            if len(fit):
                left = res[:, fit]
                if score == "norm":
                    value = (wt * ((left - need[:, None]) / cap[:, None]) ** 2).sum(0)
                else:
                    value = -(wt * left * need[:, None] / (cap * cap)[:, None]).sum(0)
                spot = int(fit[value.argmin()])
        if spot < 0:
            if n == res.shape[1]:
                res, ids = np.concatenate([res, np.empty_like(res)], 1), np.concatenate([ids, np.empty_like(ids)])
            res[:, n], ids[n] = cap, total
            spot, n, total = n, n + 1, total + 1
        bins[k], offs[k] = ids[spot], int(cap[0] - res[0, spot])
        res[:, spot] -= need
        if res[0, spot] < least or res[1, spot] < 1 or res[2, spot] < least * least:    # full: swap it out
            n -= 1
            res[:, spot], ids[spot] = res[:, n], ids[n]
    return bins, offs


def pack(docs: DataFrame, tokens: int = 2048, documents: int = 2048, attention: int = 2048 * 2048, score: str = "norm",
         vocabulary: str = "byte_bpe_50k", per_shard: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    workers(docs.sparkSession)
    flat = materialise(pieces(docs, tokens, vocabulary, id_col, text_col))
    shards = max(1, math.ceil(flat.count() / per_shard))
    # Numbered rows of a written table: the same in every attempt, and equal rows spread as well.
    dealt = flat.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        b, o = best_fit(pdf["length"].to_numpy(np.int64), tokens, documents, attention, score=score)
        return pdf.drop(columns="shard").assign(sequence_id=pdf["shard"].iloc[0] * (1 << 32) + b, offset=o)

    return dealt.groupBy("shard").applyInPandas(run, PIECES + ", sequence_id long, offset long")
