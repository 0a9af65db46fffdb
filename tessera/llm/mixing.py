"""Mixing sources to target weights over a tree of domains, languages and sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import release, settle, table

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
#: Documents of one ordered piece of a leaf, on average.
PIECE_ROWS = 4_000
#: A token is a run of anything but space and the control characters 9 to 13.
TOKEN = "[^ \\t-\\r]+"


@dataclass(frozen=True)
class Recipe:
    """Whole-number weights of the nodes by level and name (1 where not named); how often a document may recur."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    max_epochs: int = 2
    budget_num: int = 1
    budget_den: int = 2
    seed: int = 0

    def weight(self, level: str) -> Column:
        named = self.weights.get(level, {})
        return F.coalesce(*[F.when(F.col(level) == k, F.lit(int(v))) for k, v in named.items()], F.lit(1)).cast("long")


def share(nodes: DataFrame, parents: Sequence[str], level: str) -> DataFrame:
    """Add ``alloc``: of the parent's ``budget``, in proportion to ``w`` and at most ``cap``.

    What a short node leaves goes to its siblings by their weights, again and again, which is one
    pass in the order of cap / w: a node is full if, with all before it full, its share of the rest
    is no less than its cap. Shares are rounded down.
    """
    by = Window.partitionBy(*parents, "budget") if parents else Window.partitionBy("budget")
    upto = by.orderBy((F.col("cap").cast("double") / F.col("w")).asc(), F.col(level).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.col("cap") * (F.col("all_w") - F.col("w_upto") + F.col("w")) <= F.col("w") * (F.col("budget") - F.col("cap_upto") + F.col("cap"))
    marked = nodes.select("*", F.sum("cap").over(upto).alias("cap_upto"), F.sum("w").over(upto).alias("w_upto"), F.sum("w").over(by).alias("all_w")).withColumn("full", full)
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)
    free = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by)
    part = F.expr("(w * rest) div free")
    return marked.select("*", rest.alias("rest"), free.alias("free")).select(*nodes.columns, F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long").alias("alloc"))


def allocate(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, docs, tokens, alloc) from the totals of the leaves (without alloc).

    A node can take what its leaves can, ``tokens * max_epochs``. Budgets go down the tree; since a
    node's cap is that of all below it, what a leaf is short of goes first to its siblings, and only
    what they cannot take to the siblings of an ancestor.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * recipe.max_epochs)
    parents, given = [], None
    for level in LEVELS:
        path = [*parents, level]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("held")).withColumn("w", recipe.weight(level))
        if given is None:
            # A row for each domain: the one window over all of them that the tree needs.
            nodes = nodes.withColumn("budget", F.expr(f"(sum(held) OVER (PARTITION BY 1) * {recipe.budget_num}) div {recipe.budget_den}"))
        else:
            nodes = nodes.join(given, parents)
        given = share(nodes, parents, level).select(*path, F.col("alloc").alias("budget"))
        parents = path
    return leaves.drop("cap").join(given, list(LEVELS)).withColumnRenamed("budget", "alloc")


def _measured(docs: DataFrame, domain: Column) -> tuple[Column, ...]:
    """What a document is placed by: its leaf, id, tokens and the CRC of its text."""
    own = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.col("doc_id").alias("id"), own(domain).alias("domain"), own(F.col("lang")).alias("lang"), own(F.col("source")).alias("source"),
        F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"), F.crc32(text).alias("crc"),
    )


def _key(recipe: Recipe) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(recipe.seed)), F.col("full").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))


PLACE = ("key", "id", "tokens", "crc")


def cuts(rows: DataFrame, plan: DataFrame, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, last, nth, ties): the last place of each leaf's token-prefix.

    ``last`` is the place (key, id, tokens, crc) of the last document that fits, ``nth`` how many
    documents of that very place fit and ``ties`` how many there are. A leaf of whose started epoch
    nothing fits has no row.
    """
    started = rows.join(plan, list(LEVELS)).where("part > 0").withColumn("key", _key(recipe))
    started = started.withColumn("piece", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("pieces"), 32))
    sums = started.groupBy(*LEVELS, "piece").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")
    places = sums.select(*LEVELS, "piece", before.alias("before"))
    ordered = Window.partitionBy(*LEVELS, "piece").orderBy(*PLACE)
    upto = F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nth = F.row_number().over(ordered) - F.rank().over(ordered) + 1
    ties = F.count("*").over(Window.partitionBy(*LEVELS, "piece", *PLACE))
    fitting = started.select("*", upto.alias("upto"), nth.alias("nth"), ties.alias("ties")).join(places, [*LEVELS, "piece"]).where("before + upto <= part")
    last = fitting.groupBy(*LEVELS).agg(F.max(F.struct(F.struct(*PLACE).alias("last"), "nth", "ties")).alias("cut"))
    return last.select(*LEVELS, "cut.last", "cut.nth", "cut.ties")


def mix(docs: DataFrame, domain: Column, recipe: Recipe, keep: Sequence[str]) -> DataFrame:
    """The chosen documents, a row for each epoch they are read in.

    Returns (doc, domain, epoch, tokens); ``doc`` is a struct of the columns ``keep`` of ``docs``
    (doc_id, text, lang, source, any others), so no name of theirs can clash. The budget is ``budget_num / budget_den`` of all tokens. A leaf
    is read whole while its allocation lasts; of the epoch after that its token-prefix is taken: in
    the order of the MD5 of seed, epoch and doc_id (ties: doc_id, tokens, CRC of the text) all
    documents up to the last that fits. Null domains, languages and sources are leaves of their own;
    null texts have no tokens, and a leaf without tokens gives nothing. No rows give none. Totals are
    summed before they are moved; a leaf is ordered in pieces by hash, so none lands in one task.

    Texts are read twice and never moved: once to measure them, once to take those up to the last
    place of their leaf. Only where that place is shared by documents of which some do not fit
    (repeated rows) are these numbered, any of them being as good as the others.
    """
    rows = settle(docs.select(*_measured(docs, domain)), "measured")
    leaves = rows.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    given = settle(allocate(leaves.where("tokens > 0"), recipe), "budgets")
    plan = given.select(*LEVELS, F.expr("alloc div tokens").cast("int").alias("full"), F.expr("alloc % tokens").alias("part"), (F.expr(f"docs div {PIECE_ROWS}") + 1).alias("pieces"))
    # The plan comes from a written file: Spark broadcasts it only below the session's threshold.
    plan = settle(plan.join(cuts(rows, plan, recipe), list(LEVELS), "left").drop("pieces").where("full > 0 or last IS NOT NULL"), "cuts")
    release(rows, given)
    placed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("doc"), *_measured(docs, domain)).join(plan, list(LEVELS))
    place = F.struct(_key(recipe).alias("key"), "id", "tokens", "crc")
    # A null last place (nothing of the started epoch fits) compares as null, which counts as no.
    fits = F.coalesce((place < F.col("last")) | ((place == F.col("last")) & (F.col("nth") == F.col("ties"))), F.lit(False))
    copies = F.col("full") + fits.cast("int")
    out = placed.select("doc", "domain", "tokens", copies.alias("copies")).where("copies > 0").select("doc", "domain", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"), "tokens")
    if plan.where("nth < ties").isEmpty():
        return out
    shared = placed.where(F.col("nth") < F.col("ties")).where(place == F.col("last"))
    shared = shared.withColumn("n", F.row_number().over(Window.partitionBy(*LEVELS).orderBy("crc"))).where("n <= nth")
    return out.unionByName(shared.select("doc", "domain", F.col("full").alias("epoch"), "tokens"))


#: The domains and the recipe of the query and of the pipeline.
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4"), "news": ("src5", "src6", "src7", "src8", "src9"), "books": ("src10", "src11", "src12", "src13", "src14")}
OTHER = "reference"
RECIPE = Recipe({"domain": {"web": 4, "news": 3, "books": 2, "reference": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}})


def domain_of(source: Column) -> Column:
    out = F.when(source.isNull(), F.lit(None))
    for name, own in DOMAINS.items():
        out = out.when(source.isin(*own), F.lit(name))
    return out.otherwise(F.lit(OTHER))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, domain_of(F.col("source")), RECIPE, ["doc_id", "lang", "source"])
    return out.select("doc.*", "domain", "epoch", "tokens")


def op4_sql() -> str:
    case = " ".join(f"WHEN source IN ({', '.join(map(repr, own))}) THEN '{name}'" for name, own in DOMAINS.items())
    weight = {level: "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RECIPE.weights[level].items()) + " ELSE 1 END" if RECIPE.weights.get(level) else "1" for level in LEVELS}

    def level(i: int) -> str:
        path, parents = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i])
        name = LEVELS[i]
        over = f"PARTITION BY {parents}" if i else ""
        source = f"SELECT {path}, sum(cap) AS cap FROM leaves GROUP BY {path}"
        budget = f"JOIN given{i - 1} USING ({parents})" if i else "CROSS JOIN total"
        upto = f"OVER ({over} ORDER BY CAST(cap AS DOUBLE) / w, {name} ROWS UNBOUNDED PRECEDING)"
        return f"""
nodes{i} AS (SELECT n.*, {weight[name]} AS w, budget FROM ({source}) n {budget}),
sums{i} AS (SELECT *, sum(cap) {upto} AS cu, sum(w) {upto} AS wu, sum(w) OVER ({over}) AS wa FROM nodes{i}),
marks{i} AS (SELECT *, cap * (wa - wu + w) <= w * (budget - cu + cap) AS isfull FROM sums{i}),
given{i} AS (SELECT {path}, CASE WHEN isfull THEN cap ELSE (w * (budget - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({over}))) // sum(CASE WHEN isfull THEN 0 ELSE w END) OVER ({over}) END AS budget FROM marks{i})"""

    return f"""
WITH rows AS (
  SELECT doc_id, lang AS l, source AS s, CASE WHEN source IS NULL THEN '{NONE}' {case} ELSE '{OTHER}' END AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {RECIPE.max_epochs} AS cap FROM rows GROUP BY ALL HAVING sum(tokens) > 0),
total AS (SELECT (sum(tokens) * {RECIPE.budget_num}) // {RECIPE.budget_den} AS budget FROM leaves),
{",".join(level(i) for i in range(len(LEVELS)))},
plan AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS part FROM leaves JOIN given2 USING (domain, lang, source)),
keyed AS (SELECT r.*, whole, part, md5('{RECIPE.seed}:' || whole || ':' || doc_id) AS key FROM rows r JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, l AS lang, s AS source, domain, CAST(unnest(range(CAST(whole AS BIGINT))) AS INTEGER) AS epoch, CAST(tokens AS BIGINT) AS tokens FROM keyed
UNION ALL
SELECT doc_id, l, s, domain, CAST(whole AS INTEGER), CAST(tokens AS BIGINT) FROM run WHERE part > 0 AND upto <= part"""
