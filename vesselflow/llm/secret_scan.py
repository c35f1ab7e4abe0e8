"""Secret scans over an incremental blob ledger (native DataFrame operations only).

Every version of every path is content-addressed (SHA-256 of its text).  The ledger holds one row per
(blob, rule, rule version) already scanned with the spans found; only unseen pairs are scanned, each
blob once however many paths hold it.  Findings are joined back to all paths by blob.

A rule is (kind, version, pattern, group, least): leftmost non-overlapping matches of ``pattern`` whose
``group`` has at least ``least`` characters; failing matches are dropped after they have consumed
their text.  Starts come from splitting the text by the pattern: the pieces between matches and
the matches alternate, so running lengths give code-point offsets without leaving the JVM.

Defined results: a null text counts as empty and has no spans; a path with a null id keeps its row;
repeated rows give repeated rows; an empty table gives empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow.llm.common import materialise


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str          # a cheaper pattern that every text with a match has


# The three base kinds, in the order in which they are listed.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
LEDGER = "blob binary, kind string, version int, spans array<struct<start:long,end:long>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in a text: array of (start, end) in code points."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    rows = F.arrays_zip(F.transform(whole, F.char_length).alias("w"), F.transform(part, F.char_length).alias("p"),
                        F.slice(gaps, 1, F.size(whole)).alias("g"))
    zero = F.struct(F.lit(0).cast("long").alias("at"),
                    F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + x["w"]
        hit = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["p"] >= rule.least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(rows, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast("array<struct<start:long,end:long>>"))


def address(paths: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, text): every version under its content address."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return paths.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan_unseen(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows (LEDGER columns): each blob of ``paths`` scanned once under each (kind, version) that
    ``ledger`` lacks.  Append them to the ledger."""
    found = address(paths, path_col, text_col)
    # One path stands for each blob: ids travel through the aggregation, texts only once per blob.
    one = found.select("blob", "path").groupBy("blob").agg(F.min("path").alias("path"))
    due = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        pairs = one.select("blob", "path", F.explode(due).alias("r")).select("blob", "path", "r.*")
        one = (pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
               .groupBy("blob", "path").agg(F.collect_set(F.struct("kind", "version")).alias("due")))
    else:
        one = one.withColumn("due", due)
    # A path with several versions matches by its blob as well; repeated rows collapse in the aggregation.
    texts = found.join(one.select(F.col("blob").alias("b"), F.col("path").alias("p"), "due"),
                       (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")), "inner")
    spans = [F.when(F.array_contains("due", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
                    _spans(F.col("text"), r)).alias(f"s{i}") for i, r in enumerate(rules)]
    wide = texts.select("blob", *spans).dropDuplicates(["blob"])
    rows = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(f"s{i}").alias("spans"))
                     for i, r in enumerate(rules)])
    return wide.select("blob", F.explode(rows).alias("r")).select("blob", "r.*").where("spans is not null")


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES,
             path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every path version with its spans under ``rules``: (path, blob, spans array of (start, ord, kind, end))."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("ord"))
                        for i, r in enumerate(rules)])
    wanted = F.filter(current, lambda c: (c["kind"] == F.col("kind")) & (c["version"] == F.col("version")))
    hits = (ledger.where(F.size("spans") > 0).withColumn("w", F.get(wanted, F.lit(0))).where("w is not null")
            .select("blob", F.transform("spans", lambda s: F.struct(
                s["start"].alias("start"), F.col("w.ord").alias("ord"), F.col("kind").alias("kind"), s["end"].alias("end"))).alias("s"))
            .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans")))    # one list a rule
    return address(paths, path_col, text_col).select("path", "blob").join(hits, "blob", "left")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``findings``."""
    none = F.array().cast("array<struct<start:long,ord:int,kind:string,end:long>>")
    s = F.coalesce(F.col("spans"), none)
    text = F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(i):
        return F.size(F.filter(s, lambda x: x["ord"] == i)).cast("long").alias(f"n_{RULES[i].kind}")

    return found.select(F.col("path").alias("doc_id"), *map(count, range(len(RULES))), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """All rules over all documents, starting from an empty ledger."""
    ledger = materialise(scan_unseen(docs))
    return digest(findings(docs, ledger))


_KW = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
SQL = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
m as (
  select doc_id, 0 ord, 'assign' kind, 6 least, string_split_regex(t, '{_KW}[A-Za-z0-9+/_.=-]+') g,
         regexp_extract_all(t, '{_KW}[A-Za-z0-9+/_.=-]+') w, regexp_extract_all(t, '{_KW}([A-Za-z0-9+/_.=-]+)', 1) p from d
  union all
  select doc_id, 1, 'access', 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'),
         regexp_extract_all(t, 'AKIA[A-Z0-9]+') from d
  union all
  select doc_id, 2, 'hex', 24, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'),
         regexp_extract_all(t, '[0-9a-f]+') from d),
e as (select doc_id, ord, kind, least, unnest(w) w, unnest(p) p, unnest(g[:len(w)]) g, generate_subscripts(w, 1) i from m),
s as (select *, sum(length(g) + length(w)) over (partition by doc_id, ord order by i) fin from e),
k as (select doc_id, ord, kind, (fin - length(w))::bigint start, fin::bigint fin from s where length(p) >= least),
a as (select doc_id, count(*) filter (ord = 0) n_assign, count(*) filter (ord = 1) n_access, count(*) filter (ord = 2) n_hex,
             string_agg(kind || ':' || start || ':' || fin, ',' order by start, ord) spans from k group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
       sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans from d left join a using (doc_id)
"""
