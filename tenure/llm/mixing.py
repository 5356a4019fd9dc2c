"""Mixing sources to target weights: hierarchical budgets over a domain - language - source tree.

The token budget is split from the root down. At each node children get shares by
weight, but none more than its subtree can give (tokens x ``max_epochs``); what a
child cannot use goes to its siblings by weight, and only what all of them cannot use was withheld
from their parent by the parent's own limit and so went to the parent's siblings. The split among
siblings is closed-form: in order of limit / weight, a child is full if its limit is no more
than its share of what the fuller ones left. Shares are whole tokens, rounded down.

A leaf with quota q and t tokens takes floor(q / t) whole epochs of its rows and, in the
next epoch, the prefix of the rows in that epoch's seeded order whose running token count stays within
the rest. The order is by the MD5 of seed, epoch and id, then by token count, then by a hash of the whole row; rows
equal in all of these come all or none. Where the prefix ends is found without texts and without sorting a leaf: tokens
are summed by the first digits of the order, then by further digits within the range in which the quota ends, and so on
down to the row hash (``_keys``), so neither a hot leaf nor one id of very many rows is ordered in one task.

Everything is DataFrame operations. Defined cases: null domain, language or source labels are
the label "(none)"; labels without a weight have the weight ``Weights.other``; null and empty texts count 0
tokens and go along with any epoch of their leaf; repeated rows count repeatedly; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.tables import free_name, staged

SEED = 11
MAX_EPOCHS = 3
BUCKETS = 4096  # three hex digits of the order at a time
OTHER = 5
# Target weights of the queries (whole numbers). Domains are given by source; sources share their language's budget equally.
DOMAIN_OF = {f"src{i}": d for d, r in (("web", range(0, 8)), ("books", range(8, 13)), ("forum", range(13, 17)), ("reference", range(17, 20))) for i in r}
DOMAIN_WEIGHTS = {"web": 45, "books": 25, "forum": 10, "reference": 20}
LANGUAGE_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}
BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Weights:
    """Target weights: the domain of each source, the weights of domains and languages; ``other`` for those not named."""

    domain_of: Mapping[str, str] = field(default_factory=lambda: DOMAIN_OF)
    domains: Mapping[str, int] = field(default_factory=lambda: DOMAIN_WEIGHTS)
    languages: Mapping[str, int] = field(default_factory=lambda: LANGUAGE_WEIGHTS)
    other: int = OTHER

    def __post_init__(self) -> None:
        if min([self.other, *self.domains.values(), *self.languages.values()]) < 1:
            raise ValueError("weights are whole numbers from 1")


def _lookup(column: Column, values: Mapping, default) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Words (runs other than ASCII white space) of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def leaf_columns(source: Column, lang: Column, weights: Weights) -> list[Column]:
    """domain, lang, source of a row."""
    return [
        F.coalesce(_lookup(source, weights.domain_of, "(none)"), F.lit("(none)")).alias("domain"),
        F.coalesce(lang, F.lit("(none)")).alias("lang"),
        F.coalesce(source, F.lit("(none)")).alias("source"),
    ]


def fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split ``budget`` of each parent among its children (columns limit, weight): adds ``quota``."""
    among = Window.partitionBy(*parent)
    order = among.orderBy(F.col("limit") / F.col("weight"), child)
    limit, weight, budget = (F.col(c).cast(BIG) for c in ("limit", "weight", "budget"))
    before = F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(BIG)).cast(BIG)
    left = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)).cast(BIG)
    rows = children.withColumn("full", (limit * left).cast(BIG) <= ((budget - before).cast(BIG) * weight).cast(BIG))
    used = F.coalesce(F.sum(F.when(F.col("full"), limit)).over(among), F.lit(0).cast(BIG)).cast(BIG)
    rest = F.sum(F.when(~F.col("full"), weight)).over(among).cast("long")
    rows = rows.withColumn("used", used.cast("long")).withColumn("rest", rest)
    share = F.expr("(cast(budget as bigint) - used) * cast(weight as bigint) div rest")
    return rows.withColumn("quota", F.when(F.col("full"), F.col("limit")).otherwise(share)).drop("full", "used", "rest")


def quotas(leaves: DataFrame, budget_percent: int = 100, max_epochs: int = MAX_EPOCHS, weights: Weights = Weights()) -> DataFrame:
    """(domain, lang, source, tokens, quota) from (domain, lang, source, tokens): budget in percent of all tokens."""
    leaves = leaves.withColumn("limit", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * budget_percent / 100).cast("long").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("limit").alias("limit")).crossJoin(F.broadcast(total))  # one row
    domains = fill(domains.withColumn("weight", _lookup(F.col("domain"), weights.domains, weights.other)).withColumn("root", F.lit(0)), ["root"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("limit").alias("limit")).join(domains.select("domain", F.col("quota").alias("budget")), "domain")
    langs = fill(langs.withColumn("weight", _lookup(F.col("lang"), weights.languages, weights.other)), ["domain"], "lang")
    rows = leaves.join(langs.select("domain", "lang", F.col("quota").alias("budget")), ["domain", "lang"])
    return fill(rows.withColumn("weight", F.lit(1)), ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "quota")


def _order(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _keys(doc_id: Column, epoch: Column, n: Column, row_hash: Column, seed: int, buckets: int) -> list[Column]:
    """The seeded order as keys from coarse to fine; equal in all of them are only rows that are equal throughout."""
    place = _order(doc_id, epoch, seed)
    digits = [F.conv(F.substring(place, 1, 3 * k), 16, 10).cast("long") * F.lit(buckets**k) for k in (1, 2)]
    ranges = [F.shiftright(d, 12 * k) for k, d in enumerate(digits, 1)]
    return [*ranges, F.struct(place.alias("place"), n.alias("n")), F.shiftrightunsigned(row_hash, 48), row_hash]


def _ends(small: DataFrame, plan: DataFrame, leaf: list[str], seed: int, buckets: int) -> DataFrame:
    """``plan`` with the keys end_0, end_1, ... of the first row that the rest of its leaf has no room for (null: no rest)."""
    plan = plan.withColumn("before", F.lit(0).cast("long"))
    keys = _keys(F.col("doc_id"), F.col("whole") + 1, F.col("n"), F.col("row_hash"), seed, buckets)
    ahead = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    for level, key in enumerate(keys):
        within = functools.reduce(Column.__and__, [k == F.col(f"end_{i}") for i, k in enumerate(keys[:level])], F.col("rest") > 0)
        groups = small.join(plan, leaf).filter(within).groupBy(*leaf, "rest", "before", key.alias("key")).agg(F.sum("n").alias("n"))
        groups = groups.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        over = groups.filter(F.col("before") + F.col("n") > F.col("rest")).groupBy(*leaf).agg(F.min(F.struct("key", "before")).alias("e"))
        plan = staged(plan.drop("before").join(over.select(*leaf, F.col("e.key").alias(f"end_{level}"), F.col("e.before").alias("before")), leaf, "left"), "plan")
    return plan.drop("before")


def mix(
    docs: DataFrame, budget_percent: int = 100, max_epochs: int = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS, weights: Weights = Weights(),
) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with three columns added (see ``mixed_names``).

    ``buckets`` (at most 4096) is the number of ranges that tokens are summed by at a time; the result does not depend on it.
    """
    leaf = ["domain", "lang", "source"]
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_hash")
    derived = [*leaf_columns(F.col("source"), F.col("lang"), weights), n_tokens(F.col("text")).alias("n"), row_hash]
    small = staged(docs.select("doc_id", *derived), "mixing")
    plan = quotas(small.groupBy(*leaf).agg(F.sum("n").alias("tokens")), budget_percent, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.least(F.lit(1), F.lit(max_epochs))).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)))
    plan = _ends(small, staged(plan.select(*leaf, "whole", "rest"), "quotas"), leaf, seed, buckets)
    plan = plan.withColumnsRenamed({c: f"plan_{c}" for c in leaf})
    row, names = free_name(docs, "row"), mixed_names(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *derived)
    rows = rows.join(plan, [F.col(c) == F.col(f"plan_{c}") for c in leaf])
    keys = _keys(F.col(f"{row}.doc_id"), F.col("whole") + 1, F.col("n"), F.col("row_hash"), seed, buckets)
    ahead = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]) < F.struct(*[F.col(f"end_{i}").alias(f"k{i}") for i in range(len(keys))])
    times = F.col("whole") + ((F.col("rest") > 0) & ahead).cast("int")
    taken = rows.withColumn("times", times).filter("times > 0")
    taken = taken.select(F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"), row, "domain", "n")
    return taken.select(f"{row}.*", F.col("domain").alias(names[0]), F.col("epoch").alias(names[1]), F.col("n").alias(names[2]))


def mixed_names(docs: DataFrame) -> list[str]:
    """Names of the columns that ``mix`` adds: domain, epoch, token count."""
    return [free_name(docs, c) for c in ("domain", "epoch", "tokens")]
