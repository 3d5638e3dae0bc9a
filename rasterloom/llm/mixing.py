"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source s with mass m_s (characters) and target weight w_s gets the mean repetition rate
lambda_s = rate * M * w_s / m_s (weights normalised over the sources present, M the mass of all).
Each document's count inverts the Poisson distribution at a uniform number that its id and the seed
fix: the count is the number of cumulative probabilities at or under it.  Up to a rate of ``TABLE``
a source's cumulative probabilities from 0 on are a column of its row; over it they are added up
beside each document over the counts within ``SIGMAS`` deviations of the rate, in proportion to their
sum, so that neither exp(-rate) nor a number of terms bounds the rate.  Copies are exploded and dealt by a hash of (seed, id, copy), which is a global shuffle that a rerun repeats exactly.

The rates are one row a source and are written first, so that Spark knows their size: it broadcasts
them up to its threshold, without a shuffle by source, and otherwise splits a hot source's rows.

Defined cases: documents without a source are the source ''; null or empty texts have mass 0 and
are replicated like others of their source; a source of mass 0 or weight 0 has rate 0; a null doc_id
counts as the empty string; repeated rows get equal counts; very long texts count with all their
characters; a rate may be of any size, whether it follows from weights or from masses; other columns go
along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Largest rate whose probabilities are listed from 0 on; after TERMS of them the rest is under 1e-16.
TABLE, TERMS = 64.0, 160
#: Deviations on each side of a larger rate; the rest is under 1e-20.
SIGMAS = 12.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, rate: float = 1.0) -> DataFrame:
    """source, mass, rate, cdf, low, high, total for every source; without weights a source's weight is
    mass ** power.  cdf serves rates up to TABLE, the counts from low to high and their total the others."""
    mass = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("mass"))
    if weights is None:
        weight = F.pow(F.col("mass").cast("double"), F.lit(power))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    weighed = mass.withColumn("weight", F.when(F.col("mass") > 0, weight).otherwise(0.0))
    totals = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("mass").cast("double").alias("all_mass"))
    share = F.when((F.col("mass") > 0) & (F.col("all_weight") > 0), F.lit(rate) * F.col("all_mass") * (F.col("weight") / F.col("all_weight")) / F.col("mass")).otherwise(0.0)
    rated = weighed.join(F.broadcast(totals)).withColumn("rate", share)  # totals is one row
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-F.col("rate")).alias("p"), F.array(F.exp(-F.col("rate"))).alias("cdf")),
        lambda acc, j: F.struct((acc["p"] * F.col("rate") / j).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("rate") / j)).alias("cdf")),
    )
    spread = F.lit(SIGMAS) * F.sqrt("rate")
    spanned = rated.withColumns({"cdf": F.when(F.col("rate") <= TABLE, step["cdf"]), "low": F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("int"), "high": F.ceil(F.col("rate") + spread).cast("int")})
    total = F.when(F.col("rate") > TABLE, _upward(F.col("rate"), F.col("low"), F.col("high"), F.lit(float("inf")))["sum"])
    return spanned.withColumn("total", total).select("source", "mass", "rate", "cdf", "low", "high", "total")


def _upward(rate: Column, low: Column, high: Column, limit: Column) -> Column:
    """n, the counts from low to high whose running sums of probabilities (1 at low) are at or under the
    limit, and sum, the last of these sums."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), (limit >= 1.0).cast("int").alias("n"), limit.alias("limit"))

    def add(acc: Column, j: Column) -> Column:
        p = acc["p"] * rate / j
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), (acc["n"] + (acc["sum"] + p <= acc["limit"]).cast("int")).alias("n"), acc["limit"].alias("limit"))

    return F.aggregate(F.sequence(low + 1, high), start, add)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores behind it as make it differ from the taken ones (in any case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, rate: float = 1.0, seed: int = 1) -> DataFrame:
    """The columns of docs and copy (from 1), each row as often as its count says, in random order.  If docs
    has a column copy already, the new one is copy_ (and so on)."""
    # the row travels as one struct, so no column of docs can meet the operator's own
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rates = Workspace(docs.sparkSession, "mixing").keep(source_rates(docs.select("source", "text"), weights, power, rate), "rates")
    at = uniform(seed, F.col("row.doc_id"))
    # the uniform number goes in as the start of the fold, so that it is computed once a row
    inverse = F.aggregate("cdf", F.struct(at.alias("u"), F.lit(0).alias("n")), lambda acc, c: F.struct(acc["u"].alias("u"), (acc["n"] + (c <= acc["u"]).cast("int")).alias("n")))
    beyond = F.col("low") + _upward(F.col("rate"), F.col("low"), F.col("high"), at * F.col("total"))["n"]
    count = F.when(F.col("cdf").isNotNull(), inverse["n"]).otherwise(beyond)
    counted = row.join(rates, F.coalesce("row.source", F.lit("")) == F.col("source")).select("row", count.alias("n"))
    copies = counted.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    dealt = copies.withColumn("key", key).repartition("key").sortWithinPartitions("key")
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("copy").alias(free_name("copy", docs.columns)))
