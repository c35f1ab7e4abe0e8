"""Language ID by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (orders 3 and 4 of the lower-cased text,
ends padded); a linear softmax over that average gives the language.  Both layers are trained by
stochastic gradient descent in numpy on a bounded sample: ``per_lang`` documents of each of the ``most_langs`` most
frequent languages, about ``most_rows`` in all, ``grams`` n-grams drawn over the whole of each.  A part of the sample is set aside; it calibrates the temperature and
the threshold under which a prediction is rejected.  At prediction the two layers fold into one
table of n-gram scores, so a whole text costs one lookup per n-gram.

Only text and language of documents whose crc32(id as text) mod 4 is not 2 are learned from.

Defined results: a null text or one without a letter (digits, fractions and marks are none) is "und" with score 0 and rejected; a null language is not learned
from; a null id is not held out; repeated rows are predicted alike; an empty table gives an empty result; without any
labelled row everything is "und"; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselflow.llm.common import CHUNK, workers

ORDERS = (3, 4)
BUCKETS = 1 << 16
OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray       # (BUCKETS, langs): what one n-gram adds to each language
    bias: np.ndarray
    temperature: float
    threshold: float


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 4 == 2, F.lit(False))


def _grams(text: bytes, order: int) -> np.ndarray:
    """Buckets of the n-grams of one order (bytes in, one bucket per place)."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    n = len(b) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, order, np.uint32)
    for i in range(order):
        h = h * np.uint32(0x01000193) ^ b[i:i + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


def _padded(text: str) -> bytes:
    return b"\n" + text.lower().encode() + b"\n"


def _sample(docs: DataFrame, per_lang: int, most_langs: int, most_rows: int, grams: int, seed: int, id_col: str, text_col: str, lang_col: str):
    """[(language, n-gram buckets)] of a bounded sample; the sums it needs are grouped by language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = known.groupBy(F.col(lang_col).cast("string").alias("lang")).count()
    # The most frequent languages, a few rows: the window sees them only.
    each = F.least(F.lit(float(per_lang)), F.lit(float(most_rows)) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    rate = F.broadcast(counts.orderBy(F.desc("count"), "lang").limit(most_langs).select(
        F.col("lang").alias("__l"), (each / F.col("count")).alias("__rate")))
    place = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) / 1_000_000)
    picked = (known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                           F.col(text_col).cast("string").alias("text"), place.alias("place"))
              .join(rate, F.col("lang") == F.col("__l")).where("place < __rate").select("id", "lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, ids = [], []
            for i, lang, text in zip(*[c.to_pylist() for c in b.columns]):
                if not any(map(str.isalpha, text)):
                    continue
                g = np.concatenate([_grams(_padded(text), o) for o in ORDERS])
                if len(g) > grams:
                    g = g[np.random.default_rng(abs(i)).integers(0, len(g), grams)]
                langs.append(lang)
                ids.append(g.astype(np.uint16).tobytes())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(ids, pa.binary())], names=["lang", "grams"])

    rows = picked.mapInArrow(run, "lang string, grams binary").toPandas()
    rows = rows.assign(key=rows["grams"].map(bytes)).sort_values(["lang", "key"])      # the same order in every run
    return [(a, np.frombuffer(g, np.uint16).astype(np.int64)) for a, g in zip(rows["lang"], rows["key"])]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray]], dim: int = 16, steps: int = 1000, rate: float = 2.0, seed: int = 5,
          reject: float = 0.001, least: float = 0.4) -> Model | None:
    """Fit on (language, buckets).  A fifth calibrates: the temperature by likelihood, the threshold as the ``reject`` quantile of
    the scores of right predictions, at most ``least``."""
    if not sample:
        return None
    langs = sorted({a for a, _ in sample})
    y = np.array([langs.index(a) for a, _ in sample])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    held = order[: len(sample) // 5] if len(sample) >= 50 else order
    learn = order[len(sample) // 5:] if len(sample) >= 50 else order
    E = rng.uniform(-1, 1, (BUCKETS, dim)) / dim
    W, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    epochs = -(-steps // max(1, len(learn) // 16))          # as many steps on a small sample as on a large one
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // 16)):
            parts = [sample[k][1] for k in batch]
            size = np.array([len(p) for p in parts])
            at, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
            mean = np.zeros((len(parts), dim))
            np.add.at(mean, row, E[at])
            mean /= size[:, None]
            g = _softmax(mean @ W + bias)
            g[np.arange(len(parts)), y[batch]] -= 1
            back = (g @ W.T) / size[:, None]
            W -= step * mean.T @ g / len(parts)
            bias -= step * g.mean(0)
            np.subtract.at(E, at, step * back[row])
    table = E @ W
    z = np.array([table[sample[k][1]].mean(0) for k in held]) + bias
    best = min(np.geomspace(0.05, 5, 40), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    p = _softmax(z / best)
    right = p.max(1)[p.argmax(1) == y[held]]
    return Model(langs, table, bias, float(best), float(min(np.quantile(right, reject), least)) if len(right) else 0.0)


def scores(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, score, rejected) of each whole text."""
    out = []
    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0, True))
            continue
        whole, total, n = _padded(text), np.zeros(len(model.langs)), 0
        for o in ORDERS:
            for at in range(0, max(1, len(whole) - o + 1), CHUNK):         # pieces overlap by order - 1 bytes
                g = _grams(whole[at:at + CHUNK + o - 1], o)
                hit = np.bincount(g, minlength=BUCKETS) if len(g) > BUCKETS else None
                total += hit @ model.table if hit is not None else model.table[g].sum(0)
                n += len(g)
        p = _softmax(((total / max(n, 1) + model.bias) / model.temperature)[None])[0]
        k = int(p.argmax())
        out.append((model.langs[k], float(p[k]), bool(p[k] < model.threshold)))
    return out


def fit(docs: DataFrame, per_lang: int = 1000, most_langs: int = 1000, most_rows: int = 200_000, grams: int = 1024, seed: int = 5, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", **options) -> Model | None:
    workers(docs.sparkSession)
    return train(_sample(docs, per_lang, most_langs, most_rows, grams, seed, id_col, text_col, lang_col), seed=seed, **options)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            got = scores(model, texts) if model else [("und", 0.0, True)] * len(texts)
            lang, score, bad = zip(*got) if got else ([], [], [])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())],
                                  names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT)


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged; texts are judged where they are read."""
    workers(docs.sparkSession)
    schema, names = docs.schema, docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            bad = [r for _, _, r in scores(model, texts)] if model else [True] * len(texts)
            yield b.filter(pa.array([not r for r in bad], pa.bool_()))

    return docs.mapInArrow(run, schema)
