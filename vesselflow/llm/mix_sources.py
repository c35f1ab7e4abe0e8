"""Mixing sources to target weights by hierarchical budgeting (native DataFrame operations only).

A token budget flows down the tree domain, language, source.  Each parent shares its budget among its
children by weight; a child cannot take more than its subtree holds (its tokens times
``max_epochs``), and what it cannot take goes to its siblings.  A parent's own budget never exceeds
its subtree, so a shortage is made good among siblings first and only then among the ancestors'
siblings.  Shares are whole tokens, rounded down (a parent may leave fewer tokens than it has children).

A leaf with target T and A tokens takes every document ``T // A`` times, then, in the next epoch's seeded
order, the longest prefix of documents whose tokens fit the rest.  The prefix needs no global sort:
documents fall into about ``rows / 512`` ranges of their order key per leaf, range sums locate the
one range in which the prefix ends, and only that range is ordered.  The result is a threshold per leaf,
against which every document is compared where it is read.

Defined results: a null or empty text has no tokens; a null domain, language or source is the child
"(none)"; a weight that is not listed is 1, and a child of weight 0 gets nothing; a leaf without tokens
takes nothing; rows that agree in id and token count stand at one place and go together; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselflow.llm.common import materialise, small

LEVELS = ("domain", "lang", "source")
# Production parameters of the registered query and the pipeline.
WEIGHTS = {"domain": {"a": 3, "b": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {}}
MAX_EPOCHS = 4
SEED = 17
PER_RANGE = 512
_D = "decimal(20,0)"


def _weight(level: str, weights: dict) -> Column:
    given = weights.get(level) or {}
    pairs = [F.lit(x) for k, v in given.items() for x in (k, int(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(1)) if pairs else F.lit(1)


def _paths(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The tree path, the id and the order key's ingredients of every document.  The documents have no domain:
    the first hex digit of the source's md5 stands for it."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("(none)"))
    domain = F.when(F.col("source").isNull(), "(none)").when(F.substring(F.md5(source), 1, 1) < "8", "a").otherwise("b")
    return [F.col(id_col).cast("long").alias("doc_id"), domain.alias("domain"),
            F.coalesce(F.col("lang").cast("string"), F.lit("(none)")).alias("lang"), source.alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens")]


def _share(nodes: DataFrame, parents: list[str], level: str, weights: dict) -> DataFrame:
    """Children (cap) with their parent's budget -> their own budget."""
    kids = nodes.withColumn("w", _weight(level, weights).cast("decimal(10,0)")).withColumn("cap", F.col("cap").cast(_D))
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy((F.col("w") == 0), (F.col("cap").cast("double") / F.greatest("w", F.lit(1)).cast("double")), level)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    kids = (kids.withColumn("before", (F.sum("cap").over(upto) - F.col("cap")).cast(_D))
            .withColumn("w_from", F.sum("w").over(after).cast("decimal(17,0)"))
            .withColumn("full", F.expr("w > 0 and cap * w_from <= cast(budget - before as decimal(20,0)) * w"))
            .withColumn("used", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)).cast(_D))
            .withColumn("w_open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0)).cast("decimal(17,0)")))
    got = F.expr("case when w = 0 then 0 when full then cap else cast(budget - used as decimal(20,0)) * w div w_open end")
    return kids.select(*parents, level, got.cast("long").alias("budget"))


def budgets(leaves: DataFrame, weights: dict, budget: int | None, max_epochs: int) -> DataFrame:
    """Leaf targets: ``leaves`` (path, tokens, docs) plus ``target``."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(_D))
    have, most = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long"), F.coalesce(F.sum("cap"), F.lit(0)).cast("long")).first()
    share = None
    for i, level in enumerate(LEVELS):
        nodes = leaves.groupBy(*LEVELS[:i + 1]).agg(F.sum("cap").alias("cap"))
        # The root is one number; deeper levels join on the parent's path.
        nodes = nodes.join(share, list(LEVELS[:i])) if i else nodes.withColumn(
            "budget", F.lit(min(have if budget is None else int(budget), most)).cast(_D))
        share = _share(nodes, list(LEVELS[:i]), level, weights)
        if i < len(LEVELS) - 1:
            share = small(materialise(share))
    return leaves.drop("cap").join(share.withColumnRenamed("budget", "target"), list(LEVELS))


def plan(docs: DataFrame, weights: dict = WEIGHTS, budget: int | None = None, max_epochs: int = MAX_EPOCHS,
         seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, leaf_target, copies) for every document.  ``budget`` None: as many
    tokens as there are."""
    paths = materialise(docs.select(*_paths(docs, id_col, text_col)))
    return _decide(paths, _limits(paths, weights, budget, max_epochs, seed), seed)


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _limits(paths: DataFrame, weights: dict, budget: int | None, max_epochs: int, seed: int) -> DataFrame:
    leaves = materialise(paths.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    plan_ = budgets(leaves, weights, budget, max_epochs)
    plan_ = materialise(plan_.select(
        *LEVELS, "target", F.expr("case when tokens > 0 then target div tokens else 0 end").alias("epochs"),
        F.expr("case when tokens > 0 then target % tokens else 0 end").alias("rest"),
        F.ceil(F.col("docs") / PER_RANGE).alias("ranges")))
    hot = small(plan_)
    keyed = (paths.join(hot, list(LEVELS)).where("rest > 0").withColumn("key", _key(seed))
             .withColumn("range", F.expr("shiftright(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * ranges, 32)")))
    sums = keyed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("t").over(run))
    # The first range that overruns the rest holds the end of the prefix (rest < tokens, so there is one).
    edge = sums.where(F.expr("end > rest")).groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("end") - F.col("t")).alias("base"))).alias("e"))
    edge = small(materialise(edge.select(*LEVELS, F.col("e.range").alias("range"), F.col("e.base").alias("base"))))
    inside = keyed.join(edge, [*LEVELS, "range"])
    run = Window.partitionBy(*LEVELS).orderBy("key", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (inside.withColumn("end", F.sum("n_tokens").over(run) + F.col("base")).where(F.expr("end <= rest"))
            .groupBy(*LEVELS).agg(F.max(F.struct("key", "n_tokens")).alias("last")))
    return small(materialise(plan_.join(edge, list(LEVELS), "left").join(last, list(LEVELS), "left").select(
        *LEVELS, "target", "epochs", "ranges", "range", "last")))


def _decide(paths: DataFrame, limits: DataFrame, seed: int) -> DataFrame:
    at = F.expr("shiftright(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * ranges, 32)")
    more = F.col("range").isNotNull() & ((at < F.col("range")) | F.coalesce(F.struct("key", "n_tokens") <= F.col("last"), F.lit(False)))
    out = paths.join(limits, list(LEVELS)).withColumn("key", _key(seed)).withColumn("copies", F.col("epochs") + more.cast("long"))
    kept = [c for c in paths.columns if c not in ("doc_id", *LEVELS, "n_tokens")]
    return out.select("doc_id", *LEVELS, "n_tokens", F.col("target").alias("leaf_target"), "copies", *kept)


def mix_documents(docs: DataFrame, weights: dict = WEIGHTS, budget: int | None = None, max_epochs: int = MAX_EPOCHS,
                  seed: int = SEED) -> DataFrame:
    """The mixed documents with the columns of ``docs``: each as often as its leaf takes it."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    paths = docs.select(*_paths(docs, "doc_id", "text"))
    limits = _limits(materialise(paths), weights, budget, max_epochs, seed)
    full = docs.select(*_paths(docs, "doc_id", "text"), row)
    chosen = _decide(full, limits, seed).where("copies > 0")
    return chosen.select(F.explode(F.array_repeat("__row", F.col("copies").cast("int"))).alias("r")).select("r.*")


def _sql_level(i: int) -> str:
    path, up = ", ".join(LEVELS[:i + 1]), ", ".join(LEVELS[:i])
    case = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS[LEVELS[i]].items())
    w = f"case {LEVELS[i]} {case} else 1 end" if case else "1"
    part = f"partition by {up}" if up else ""
    join = f"join b{i - 1} using ({up})" if i else "cross join root"
    return f"""n{i} as (select {path}, any_value(budget) budget, sum(cap)::hugeint cap, ({w})::hugeint w from leaves {join} group by {path}),
p{i} as (select *, sum(cap) over (z rows unbounded preceding) - cap before, sum(w) over (z rows between current row and unbounded following) w_from
        from n{i} window z as ({part} order by cap::double / w, {LEVELS[i]})),
f{i} as (select *, cap * w_from <= (budget - before) * w is_full from p{i}),
b{i} as (select {path}, (case when is_full then cap else (budget - coalesce(sum(case when is_full then cap end) over ({part}), 0)::hugeint) * w
        // sum(case when not is_full then w end) over ({part})::hugeint end)::hugeint budget from f{i})"""


SQL = f"""
with d as (select doc_id, case when source is null then '(none)' when substr(md5(source), 1, 1) < '8' then 'a' else 'b' end domain,
                  coalesce(lang, '(none)') lang, coalesce(source, '(none)') source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::hugeint tokens, (sum(n_tokens) * {MAX_EPOCHS})::hugeint cap from d group by all),
root as (select least(sum(tokens), sum(cap))::hugeint budget from leaves),
{", ".join(map(_sql_level, range(3)))},
x as (select l.*, budget::bigint leaf_target, (case when tokens > 0 then budget // tokens else 0 end)::bigint epochs,
             (case when tokens > 0 then budget % tokens else 0 end)::bigint rest
      from leaves l join b2 using (domain, lang, source)),
r as (select d.*, leaf_target, epochs, rest, md5('{SEED}:' || epochs || ':' || doc_id) k from d join x using (domain, lang, source)),
o as (select *, sum(n_tokens) over (partition by domain, lang, source order by k, n_tokens range unbounded preceding) fin from r)
select doc_id, domain, lang, source, n_tokens::bigint n_tokens, leaf_target,
       (epochs + case when rest > 0 and fin <= rest then 1 else 0 end)::bigint copies from o
"""
