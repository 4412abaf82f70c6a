"""Mixing sources to target weights by temperature.

Token shares of sources are raised to an exponent and normalised. The exponent
is found by bisection over SQL aggregates of the (source, tokens) table: the
greatest that reaches a target entropy, or the least that keeps every source
within a repetition limit. The weights are realised under a token budget: each
source gets whole passes and part of a last pass over a hash permutation of its
documents, and every copy a block, so that each block has about the mixture.

A small source may have to repeat very often. Copies are dealt out in two steps, a
root of their number of parts that move to other tasks and are taken apart there,
so no task makes all copies of a document.

Cumulative tokens of a source are taken in two steps, within ``BUCKETS`` hash
ranges of its permutation and over the ranges, so that a source with a third of
all rows is spread over as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1024
#: Steps of the bisection: the exponent is known to 2**-STEPS.
STEPS = 30
#: Targets of the registered query: share of the greatest entropy, blocks.
ENTROPY, BLOCKS = 0.9, 256
#: Copies of a document that are made where it stands; more are dealt out.
PART = 1000
#: The least repetition limit for which the pipeline keeps every document.
MAX_REPEATS = 2.0


def token_count(text: Column) -> Column:
    """Words divided by spaces, tabs and line ends, and one more for the end."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    flat = F.trim(flat)
    return (F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + F.when(flat == "", 0).otherwise(1) + 1).cast("long")


def _entropy_share(sources: DataFrame, exponent: float) -> float:
    """Entropy of the tempered weights as a share of the greatest possible."""
    p = F.pow(F.col("share"), F.lit(exponent))
    z = sources.agg(F.sum(p).alias("z"), F.sum(p * F.log(p)).alias("s"), F.count("*").alias("n"))
    return z.select(F.when(F.col("n") > 1, (F.log("z") - F.col("s") / F.col("z")) / F.log("n")).otherwise(1.0)).first()[0]


def exponent_for_entropy(sources: DataFrame, target: float, steps: int = STEPS) -> float:
    """The greatest exponent in [0, 1] whose entropy share is ``target`` or more."""
    if _entropy_share(sources, 1.0) >= target:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if _entropy_share(sources, mid) >= target else (low, mid)
    return low


def exponent_for_repeats(sources: DataFrame, limit: float, steps: int = STEPS) -> float:
    """The least exponent in [0, 1] at which, when the source drawn least goes
    once, no source repeats more than ``limit`` times."""
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        r = F.pow(F.col("share"), F.lit(mid - 1.0))
        fits = sources.agg(F.coalesce(F.max(r) <= limit * F.min(r), F.lit(True))).first()[0]
        low, high = (low, mid) if fits else (mid, high)
    return high


def _tempered(sources: DataFrame, entropy: float | None, repeats: float | None) -> DataFrame:
    """(__s, docs, tokens, share, exponent, weight, passes) from (__s, docs, tokens)."""
    total = sources.agg(F.sum("tokens").alias("total"))
    sources = stored(sources.join(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("total")))
    tau = exponent_for_entropy(sources, entropy) if repeats is None else exponent_for_repeats(sources, repeats)
    p = F.pow(F.col("share"), F.lit(tau))
    z = sources.agg(F.sum(p).alias("z"))
    out = sources.join(F.broadcast(z)).withColumn("weight", p / F.col("z")).withColumn("exponent", F.lit(tau))
    if repeats is None:
        passes = F.col("weight") * F.col("total") / F.col("tokens")
    else:
        least = out.agg(F.min(F.col("weight") / F.col("tokens")).alias("least"))
        out, passes = out.join(F.broadcast(least)), F.col("weight") / F.col("tokens") / F.col("least")
    # Rounded, so that one whole pass is exactly 1.
    return out.withColumn("passes", F.round(passes, 9)).select("__s", "docs", "tokens", "share", "exponent", "weight", "passes")


def _source_key(column: str = "source") -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def source_weights(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = None) -> DataFrame:
    """(source, docs, tokens, share, exponent, weight, passes) for each source;
    ``passes`` is how often its documents are used. A null source is one of its
    own. With ``entropy`` the budget is the corpus's tokens. With ``repeats``
    it is the least that uses every document at least once."""
    sources = docs.groupBy(_source_key().alias("__s")).agg(F.count("*").alias("docs"), F.sum(token_count(F.col("text"))).alias("tokens"))
    out = _tempered(sources, entropy, repeats)
    return out.select(F.when(F.col("__s") != "n", F.substring("__s", 2, 2**31 - 1)).alias("source"), *out.columns[1:])


def _copied(rows: DataFrame) -> DataFrame:
    """The rows, each ``__copies`` times where it stands, with ``pass`` from 0."""
    return rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))


def _dealt_in_parts(rows: DataFrame) -> DataFrame:
    """As :func:`_copied`, but copies are made in parts that move to other tasks."""
    size = F.greatest(F.lit(PART), F.ceil(F.sqrt("__copies"))).cast("long")
    parts = rows.withColumn("__size", size)
    parts = parts.withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.col("__size"))))
    parts = parts.repartition(F.col("__s"), F.col("__key"), F.col("__first"))
    last = F.least(F.col("__first") + F.col("__size"), F.col("__copies")) - 1
    return parts.withColumn("pass", F.explode(F.sequence(F.col("__first"), last))).drop("__size", "__first")


def mixed(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = None, blocks: int = BLOCKS, names: tuple[str, str, str] = ("tokens", "pass", "block")) -> DataFrame:
    """The rows of ``docs``, once for each copy, with the columns of ``names``:
    tokens, pass (from 0) and block.

    With ``entropy`` the rows are as many as the budget's tokens allow: a source
    of one short document may come out as often as its weight times the corpus's
    tokens. With ``repeats`` a document has at most that many copies, and one more.

    A copy in a whole pass is always there. In the last, partial pass a
    document is there if it begins before the budget in the source's hash
    order. A source with fewer tokens than its part of the budget repeats, one
    with more is cut to it. Null and empty texts count one token. Repeated rows
    are documents of their own, one after the other. An empty table gives an
    empty result. Columns named as one of ``names`` are replaced.
    """
    kept = docs.drop(*names).columns
    # Columns are numbered, so that no name of theirs is one of these.
    own = {c: f"c{i}" for i, c in enumerate(kept)}
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(own["doc_id"]).cast("string"), F.lit("")), F.coalesce(own["text"], F.lit(""))))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    rows = docs.select(*kept).toDF(*own.values())
    rows = rows.withColumns({"tokens": token_count(F.col(own["text"])), "__s": _source_key(own["source"]), "__key": key})
    rows = rows.withColumn("__b", F.pmod(F.col("__key"), F.lit(BUCKETS)).cast("int"))

    # Documents and tokens of each hash range of a source, and tokens before it.
    ranged = stored(rows.groupBy("__s", "__b").agg(F.count("*").alias("docs"), F.sum("tokens").alias("t")))
    sources = ranged.groupBy("__s").agg(F.sum("docs").alias("docs"), F.sum("t").alias("tokens"))
    weights = _tempered(sources, entropy, repeats).select("__s", F.col("tokens").alias("__all"), "passes")
    along = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    plan = ranged.select("__s", "__b", F.coalesce(F.sum("t").over(along), F.lit(0)).alias("__before")).join(weights, "__s")

    # Where each document begins in its source, from a window within a hash range.
    inside = Window.partitionBy("__s", "__b").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__own", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(plan, ["__s", "__b"])
    placed = placed.withColumn("__at", (F.col("__before") + F.col("__own")) / F.col("__all"))
    whole = F.floor("passes").cast("long")
    copies = whole + F.when(F.col("__at") < F.col("passes") - whole, 1).otherwise(0)
    dealt = placed.withColumn("__copies", copies).where("__copies > 0")
    if repeats is not None and repeats < PART:  # no document has more copies, and the rows are sorted once
        dealt = _copied(dealt)
    else:
        dealt = _copied(dealt.where(F.col("__copies") <= PART)).unionByName(_dealt_in_parts(dealt.where(F.col("__copies") > PART)))
    block = F.least(F.floor((F.col("pass") + F.col("__at")) / F.col("passes") * blocks), F.lit(blocks - 1)).cast("int")
    return dealt.select(*own.values(), "tokens", "pass", block.alias("block")).toDF(*kept, *names)
