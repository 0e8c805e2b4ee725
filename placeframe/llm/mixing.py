"""Temperature mixing of sources: weights by an exponent that is bisected, realised as block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeframe.llm.columns import words
from placeframe.llm.scratch import table

#: Tokens of a block, and of the epochs that the rarest source may be read at most.
BLOCK_TOKENS, REPETITION = 200_000, 2.0
#: Points tried in each round of the search for the exponent, and rounds: 256**-4 wide at the end.
POINTS, ROUNDS = 256, 4
#: Blocks whose sums one task adds up in order.
FAN_IN = 4096


def source_tokens(docs: DataFrame) -> DataFrame:
    """host, tokens: the words and ends of each source's documents; null source is the source ''."""
    return docs.groupBy("host").agg(F.sum("n_tokens").alias("tokens"))


def exponent(sources: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent a in [0, 1] nearest to 1 for which shares to the power a have at least the entropy (bits), or need
    no more than `repetition` epochs of any source when each is read once at least.

    Both grow worse with a, so the interval is cut again and again; a round tries POINTS exponents in one pass over the
    sources, so that the sources, however many, stay where they are.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    lo, hi = 0.0, 1.0
    if not total:
        return 1.0
    share = sources.select((F.col("tokens") / F.lit(float(total))).alias("p")).where("p > 0")
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)]
        tried = share.withColumn("a", F.explode(F.array(*map(F.lit, grid)))).withColumn("w", F.pow("p", "a"))
        made = tried.groupBy("a").agg(
            F.sum("w").alias("z"),
            F.sum(F.col("w") * F.col("a") * F.log2("p")).alias("s"),
            F.max(F.col("w") / F.col("p")).alias("most"),
            F.min(F.col("w") / F.col("p")).alias("least"),
        )

        def holds(r) -> bool:
            if entropy is not None:
                return math.log2(r["z"]) - r["s"] / r["z"] >= entropy - 1e-12
            return r["most"] / r["least"] <= repetition * (1 + 1e-12)

        good = {r["a"]: holds(r) for r in made.collect()}
        if entropy is not None:  # entropy falls as a grows: the largest that holds
            i = max((i for i, a in enumerate(grid) if good[a]), default=0)
            lo, hi = grid[i], grid[min(i + 1, POINTS)]
        else:  # repetition falls as a grows: the smallest that holds
            i = min((i for i, a in enumerate(grid) if good[a]), default=POINTS)
            lo, hi = grid[max(i - 1, 0)], grid[i]
    return lo if entropy is not None else hi


def mix(
    docs: DataFrame,
    entropy: float | None = None,
    repetition: float | None = REPETITION,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
) -> DataFrame:
    """docs with n_tokens, copy, block and place (long): the mixture's rows.

    A source's weight is its share of tokens to a power, normalised. Its budget is its weight times `budget` tokens; by
    default the budget at which the source of the lowest ratio is read exactly once, so that no document is lost. Each
    copy of a source is a permutation by a seeded hash, dealt out in blocks of about `block_tokens`; the last copy ends
    where the source's budget does: a document is in if it starts before. `block` numbers a source's blocks over its
    copies; `place` orders the mixture: tokens before the document as a share of its source's budget, in billionths, so
    that any stretch of the mixture holds the sources by weight.

    Each row is a document, also repeated ones; equal rows are dealt in one order, any. Null text has one token, its end;
    null source is the source ''. Columns of docs named as the result's own give way; all others pass, of whatever names.
    Sums run over groups of blocks, over the blocks of a group and inside a block, so a source that holds most rows is many
    groups. A very long text is a row as any other. An empty table gives an empty result.
    """
    made = ("n_tokens", "copy", "block", "place")
    names = [c for c in docs.columns if c not in made]
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    # the row goes along whole, so that none of its columns can clash with a name made here
    own = docs.select(
        F.struct(*names).alias("row"),
        F.coalesce(source, F.lit("")).alias("host"),
        (F.size(words(F.coalesce(text, F.lit("")))) + 1).cast("long").alias("n_tokens"),
        F.xxhash64("doc_id", text).alias("h"),
    )
    sources = table(source_tokens(own), "sources")
    a = exponent(sources, entropy, None if entropy is not None else repetition)
    weighed = sources.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(a)))
    z, cover = weighed.agg(F.sum("w"), F.max(F.col("tokens") / F.col("w"))).first()
    if z is None:
        z, cover = 1.0, 1.0
    scale = float(cover) if budget is None else budget / z
    # the ends of floating-point sums are rounded off, so that a whole number of epochs is one
    limits = weighed.select("host", "tokens", F.round(F.col("w") * F.lit(scale), 3).alias("limit"))
    limits = limits.withColumns({"copies": F.ceil(F.col("limit") / F.col("tokens")), "blocks": F.ceil(F.col("tokens") / F.lit(block_tokens))})
    rows = own.join(limits, "host").where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "copy", "h"))
    rows = rows.withColumn("b", F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("blocks")).cast("long"), F.col("blocks") - 1))
    before = tokens_before(rows)
    inner = W.partitionBy("host", "copy", "b").orderBy("key", "h").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    placed = placed.join(before, ["host", "copy", "b"]).withColumn("start", F.col("before") + F.col("inside"))
    kept = placed.where(F.col("start") < F.col("limit"))
    return kept.select(
        *(F.col("row").getField(c).alias(c) for c in names),
        "n_tokens",
        "copy",
        (F.col("copy") * F.col("blocks") + F.col("b")).alias("block"),
        F.floor(F.col("start") / F.col("limit") * 1_000_000_000).cast("long").alias("place"),
    )


def tokens_before(rows: DataFrame) -> DataFrame:
    """host, copy, b, before: tokens of the source's mixture ahead of each block; sums of FAN_IN blocks first."""
    sums = table(rows.groupBy("host", "copy", "b").agg(F.sum("n_tokens").alias("n")), "blocks").withColumn("g", F.floor(F.col("b") / FAN_IN))
    wide = W.partitionBy("host").orderBy("copy", "g").rowsBetween(W.unboundedPreceding, -1)
    groups = sums.groupBy("host", "copy", "g").agg(F.sum("n").alias("of")).withColumn("ahead", F.coalesce(F.sum("of").over(wide), F.lit(0))).drop("of")
    order = W.partitionBy("host", "copy", "g").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    own = sums.withColumn("own", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return own.join(groups, ["host", "copy", "g"]).select("host", "copy", "b", (F.col("ahead") + F.col("own")).alias("before"))


def mixed(docs: DataFrame, repetition: float = REPETITION) -> DataFrame:
    """The mixture with the columns of docs: a document stands once for each copy, at its place.

    Blocks are dealt at random to partitions, whose rows are in the order of their place: so each partition, and each
    file written from one, is a mixture by weight, and the texts are shuffled once.
    """
    # the row goes along whole: a column of docs may be named place
    out = mix(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source"), repetition=repetition)
    return out.sortWithinPartitions("place").select("row.*")
