"""Exact dedup with a heavy-hitter split (native DataFrame operations only).

Misra-Gries counters over the digests of normalised texts name the digests that may hold more than
``support`` of all rows (at most ``1 / support`` of them).  A second, exact pass verifies them and finds
each one's winner.  Those few winners are broadcast, so rows of hot digests are decided where they are
read; the other digests take the ordinary shuffle, in which no group holds more than ``support`` of
the rows.

Defined results: a null text counts as empty; empty texts form one group.  Ties in length go to the
smallest id; a null id loses to any other.  Rows that repeat the winner's id with an equal text are the
same document and share its decision.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow.llm.common import WHITE, materialise


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """Decision per row: (doc_id, keep_id, group_size, kept, text_sha256)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialise(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).alias("chars"),
        F.unhex(F.sha2(F.translate(text, WHITE, ""), 256)).alias("digest"))
        .withColumn("mark", F.xxhash64("digest")))
    # The largest (chars, ~doc_id) is the longest text, then the smallest id; ~x cannot overflow.
    rank = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("rev"))).alias("best")
    decided = [rank, F.count(F.lit(1)).alias("group_size")]

    suspects = slim.stat.freqItems(["mark"], support).select(F.explode("mark_freqItems").alias("mark"))
    heavy = materialise(slim.join(F.broadcast(suspects), "mark", "left_semi").groupBy("digest").agg(*decided))

    marked = slim.join(F.broadcast(heavy), "digest", "left")       # at most 1 / support rows
    hot = marked.where("best is not null")
    rest = slim.join(F.broadcast(heavy), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*decided), "digest")
    out = hot.unionByName(cold).select(
        "doc_id", F.bitwise_not("best.rev").alias("keep_id"), "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def kept_documents(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document stays, all columns unchanged."""
    keep = decisions.where("kept").select(F.col("doc_id").alias("__keep"))
    return docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("__keep")), "left_semi")


SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 from documents),
g as (select text_sha256, count(*) group_size, max(chars) top from t group by 1),
w as (select t.text_sha256, min(doc_id) keep_id, any_value(group_size) group_size
      from t join g on t.text_sha256 = g.text_sha256 and t.chars = g.top group by 1)
select t.doc_id, w.keep_id, w.group_size, t.doc_id = w.keep_id kept, t.text_sha256
from t join w on t.text_sha256 = w.text_sha256
"""
