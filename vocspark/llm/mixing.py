"""Mixing sources to target weights: budgets flow down a domain-language-source tree, documents follow in seeded epochs.

A token budget is divided at every node among its children by their weights.  A child can hold at most its tokens times
``max_epochs``; what it cannot take goes to its siblings by weight, and only what a whole subtree cannot take goes to
the next ancestor's other children, because every node is first cut to the capacity below it.

A leaf takes its documents in epochs.  Epoch e orders them by md5(seed-e-doc_id); whole epochs take all, the last one
takes the documents that begin before the rest of the budget is used up, so a leaf ends less than one document above
its budget.  A token is a word of the documented rule.

Null ids, domains, languages and sources count as the empty string, null texts as empty; rows with one doc_id in one leaf stay
together; empty tables give an empty result.  Other columns are carried; columns named like the added ones (domain,
n_tokens, epoch, leaf_target) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import carrying, SPACE_CLASS, materialise, table
from vocspark.llm.registry import query

LEAF = ["_domain", "_lang", "_source"]
# Rounds of the search for a leaf's cut look at ever longer prefixes of the ordering hash.
DESCENT = (3, 6)
# A cut table of at most this many leaves is broadcast; a larger one is joined by shuffle.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """Targets; unnamed domains, languages and sources have weight 1. ``share`` is the budget in hundredths of all tokens."""
    domain_of: dict[str, str] = field(default_factory=dict)
    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    share: int = 90
    max_epochs: int = 3
    seed: int = 17
    other: str = "other"

    def __post_init__(self):
        weights = [*self.domains.values(), *self.languages.values(), *self.sources.values(), self.share, self.max_epochs]
        if any(not isinstance(w, int) or not 1 <= w <= 1_000_000 for w in weights):
            raise ValueError("weights, share and max_epochs are integers from 1 to 1,000,000")


PRODUCTION = Mix(
    domain_of={f"src{i}": ("web", "forum", "news", "books")[i // 5] for i in range(20)},
    domains={"web": 4, "forum": 2, "news": 3, "books": 3, "other": 1},
    languages={"en": 5, "de": 2, "fr": 2, "es": 2})


def _lookup(key: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for name, value in sorted(values.items(), reverse=True):
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def _divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to children with ``cap``, ``w`` and their parent's ``given``: fill the tightest first."""
    keys = ", ".join(parent) or "0"
    order = f"(PARTITION BY {keys} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    nodes = nodes.withColumns({
        "c0": F.expr(f"coalesce(sum(cap) OVER {order}, 0L)"),
        "wr": F.expr(f"sum(w) OVER (PARTITION BY {keys}) - coalesce(sum(w) OVER {order}, 0L)")})
    big = "cast({} as decimal(19,0))".format
    nodes = nodes.withColumn("full", F.expr(f"{big('cap')} * {big('wr')} <= {big('w')} * {big('given - c0')}"))
    nodes = nodes.withColumns({
        "cs": F.expr(f"sum(CASE WHEN full THEN cap ELSE 0L END) OVER (PARTITION BY {keys})"),
        "wu": F.expr(f"sum(CASE WHEN full THEN 0L ELSE w END) OVER (PARTITION BY {keys})")})
    return nodes.withColumn("budget", F.expr(
        f"CASE WHEN full THEN cap ELSE {big('w')} * {big('given - cs')} div {big('wu')} END")).drop(
        "c0", "wr", "full", "cs", "wu")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (_domain, _lang, _source, tokens) with their ``budget``: one row each, all in windows over small tables."""
    weighted = leaves.withColumns({"cap": F.col("tokens") * mix.max_epochs})
    langs = weighted.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("_domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.coalesce(F.expr(f"sum(tokens) * {mix.share}L div 100L"), F.lit(0).cast("long")).alias("total"),
                       F.coalesce(F.sum("tokens") * mix.max_epochs, F.lit(0).cast("long")).alias("most"))
    given = total.select(F.least("total", "most").alias("given"), F.lit(1).alias("one"))
    one = domains.withColumns({"w": _lookup(F.col("_domain"), mix.domains, 1).cast("long"), "one": F.lit(1)})
    one = _divide(one.join(given, "one"), [], "_domain").select("_domain", F.col("budget").alias("given"))
    two = langs.withColumn("w", _lookup(F.col("_lang"), mix.languages, 1).cast("long")).join(one, "_domain")
    two = _divide(two, ["_domain"], "_lang").select("_domain", "_lang", F.col("budget").alias("given"))
    three = weighted.withColumn("w", _lookup(F.col("_source"), mix.sources, 1).cast("long")).join(two, ["_domain", "_lang"])
    return _divide(three, ["_domain", "_lang"], "_source").select(*LEAF, "tokens", "budget")


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _cuts(keyed: DataFrame, budgets: DataFrame, mix: Mix) -> DataFrame:
    """Leaves with ``epochs`` taken whole and ``cut``, the last ordering hash taken of the next epoch (null: none)."""
    plan = budgets.withColumns({"epochs": F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0L END"),
                                "rest": F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0L END")})
    plan = materialise(plan.withColumns({"base": F.lit(0).cast("long"), "prefix": F.lit("")}), "mix-plan")
    bounded = F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan
    rows = keyed.join(bounded.where("rest > 0").select(*LEAF, "epochs"), LEAF)
    rows = materialise(rows.select(*LEAF, _order_key(mix.seed, F.col("epochs"), F.col("_id")).alias("h"), "n"), "mix-order")
    for size in (*DESCENT, 32):
        bounds = plan.where("rest > 0").select(*LEAF, "rest", "base", "prefix")
        bounds = F.broadcast(bounds) if size and plan.count() <= BROADCAST_LEAVES else bounds
        inside = rows.join(bounds, LEAF).where(F.expr("startswith(h, prefix)"))
        sums = inside.groupBy(*LEAF, F.substring("h", 1, size).alias("p")).agg(
            F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        sums = sums.withColumn("begin", F.expr(f"base + sum(n) OVER (PARTITION BY {', '.join(LEAF)} ORDER BY p) - n"))
        last = sums.where("begin < rest").groupBy(*LEAF).agg(F.max(F.struct("p", "begin")).alias("m"))
        last = last.select(*LEAF, F.col("m.p").alias("prefix"), F.col("m.begin").alias("base"))
        plan = materialise(plan.drop("base", "prefix").join(last, LEAF, "left"), "mix-plan")
    return plan.select(*LEAF, "epochs", F.col("prefix").alias("cut"), F.col("budget").alias("leaf_target"))


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION, text: str = "text") -> DataFrame:
    """Rows of ``docs`` once for each epoch that takes them, with domain, n_tokens, epoch and leaf_target.

    Texts are read twice and never shuffled: the cuts are found on a narrow table of keys, and every row then
    decides by its own leaf and hash.
    """
    def blank(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    tokens = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+"), "")).cast("long")
    staged = docs.withColumns({"_domain": _lookup(blank("source"), mix.domain_of, mix.other), "_lang": blank("lang"),
                               "_source": blank("source")})
    keyed = materialise(staged.select(*LEAF, F.col("doc_id").alias("_id"), tokens.alias("n")), "mix-keys")
    leaves = materialise(keyed.groupBy(*LEAF).agg(F.sum("n").alias("tokens")), "mix-leaves")
    cuts = materialise(_cuts(keyed, leaf_budgets(leaves, mix), mix), "mix-cuts")
    small = F.broadcast(cuts) if cuts.count() <= BROADCAST_LEAVES else cuts
    joined = staged.join(small, LEAF)
    partial = F.col("cut").isNotNull() & (_order_key(mix.seed, F.col("epochs"), F.col("doc_id")) <= F.col("cut"))
    times = F.col("epochs") + F.when(partial, 1).otherwise(0)
    out = joined.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
    return out.withColumns({"domain": F.col("_domain"), "n_tokens": tokens}).drop(*LEAF, "epochs", "cut")


@carrying
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the mixture of the documents given; a document taken in two epochs stands there twice."""
    return mix_documents(docs).select(*docs.columns)


def _case(key: str, values: dict, other) -> str:
    quoted = (lambda v: f"'{v}'") if isinstance(other, str) else str
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {quoted(other)} END"


def _divide_sql(out: str, source: str, parent: str, name: str) -> str:
    order = f"(PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{out}_a AS (SELECT *, coalesce(sum(cap) OVER {order}, 0)::HUGEINT AS c0,
  (sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER {order}, 0))::HUGEINT AS wr FROM {source}),
{out}_b AS (SELECT *, cap * wr <= w * (given - c0) AS sat FROM {out}_a),
{out} AS (SELECT *, CASE WHEN sat THEN cap ELSE w * (given - (sum(CASE WHEN sat THEN cap ELSE 0 END) OVER (PARTITION BY {parent}))::HUGEINT)
  // (sum(CASE WHEN sat THEN 0 ELSE w END) OVER (PARTITION BY {parent}))::HUGEINT END AS budget FROM {out}_b)"""


def mix_sql(source: str, mix: Mix = PRODUCTION, prefix: str = "x_") -> str:
    """CTEs that end in ``{prefix}mixed``: the rows of ``source`` once for each epoch that takes them."""
    x = prefix
    return f"""{x}d AS (SELECT *, {_case("coalesce(source, '')", mix.domain_of, mix.other)} AS domain_, coalesce(lang, '') AS lang_, coalesce(source, '') AS source_,
  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{SPACE_CLASS}+'), lambda w: w <> '')) AS BIGINT) AS n_tokens_ FROM {source}),
{x}leaf AS (SELECT domain_, lang_, source_, sum(n_tokens_)::HUGEINT AS tokens, (sum(n_tokens_) * {mix.max_epochs})::HUGEINT AS cap,
  {_case('source_', mix.sources, 1) if mix.sources else '1'}::HUGEINT AS w FROM {x}d GROUP BY ALL),
{x}lang AS (SELECT domain_, lang_, sum(cap)::HUGEINT AS cap, {_case('lang_', mix.languages, 1)}::HUGEINT AS w FROM {x}leaf GROUP BY ALL),
{x}dom AS (SELECT domain_, sum(cap)::HUGEINT AS cap, {_case('domain_', mix.domains, 1)}::HUGEINT AS w,
  (SELECT least(sum(tokens)::HUGEINT * {mix.share} // 100, sum(cap)::HUGEINT) FROM {x}leaf) AS given FROM {x}lang GROUP BY ALL),
{_divide_sql(x + 'b1', x + 'dom', '0', 'domain_')},
{x}lang2 AS (SELECT l.*, b.budget AS given FROM {x}lang l JOIN {x}b1 b USING (domain_)),
{_divide_sql(x + 'b2', x + 'lang2', 'domain_', 'lang_')},
{x}leaf2 AS (SELECT l.*, b.budget AS given FROM {x}leaf l JOIN {x}b2 b USING (domain_, lang_)),
{_divide_sql(x + 'b3', x + 'leaf2', 'domain_, lang_', 'source_')},
{x}plan AS (SELECT domain_, lang_, source_, budget AS leaf_target_, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM {x}b3),
{x}rows AS (SELECT d.*, epochs, rest, leaf_target_, md5('{mix.seed}-' || epochs || '-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM {x}d d JOIN {x}plan p USING (domain_, lang_, source_)),
{x}grp AS (SELECT domain_, lang_, source_, h, any_value(rest) AS rest, sum(n_tokens_) AS n FROM {x}rows GROUP BY ALL),
{x}pick AS (SELECT domain_, lang_, source_, h, sum(n) OVER (PARTITION BY domain_, lang_, source_ ORDER BY h) - n < rest AS taken FROM {x}grp),
{x}mixed AS (SELECT r.*, CAST(unnest(range(CAST(epochs AS BIGINT) + CASE WHEN taken THEN 1 ELSE 0 END)) AS BIGINT) AS epoch_
  FROM {x}rows r JOIN {x}pick USING (domain_, lang_, source_, h))"""


@query("op2_mix_sources", f"""WITH {mix_sql('documents')} SELECT doc_id, epoch_ AS epoch, domain_ AS domain, lang, source,
  n_tokens_ AS n_tokens, CAST(leaf_target_ AS BIGINT) AS leaf_target FROM x_mixed""")
def mix_sources(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mix_documents(docs).select("doc_id", "epoch", "domain", "lang", "source", "n_tokens", "leaf_target")
