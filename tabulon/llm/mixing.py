"""Temperature mixing of sources, realised as budgeted block permutations, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, key_of, quoted, ranked, rows_of

#: Distinct sources whose totals the driver may hold.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Mixture:
    """exponent: on the source shares; budget: tokens in all; epochs: passes over each source, by key."""

    exponent: float
    budget: int
    weights: dict[str, float]
    quotas: dict[str, int]


def shares(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised powers of the sources' token shares; sources without tokens get none."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0} if total else {}
    norm = math.fsum(raised.values())
    return {s: x / norm for s, x in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    """In bits."""
    return -math.fsum(w * math.log2(w) for w in weights.values() if w > 0)


def repetition(tokens: dict[str, int], weights: dict[str, float]) -> float:
    """Passes over the most repeated source for one over the least repeated."""
    passes = [w / tokens[s] for s, w in weights.items()]
    return max(passes) / min(passes) if passes else 1.0


def bisect_exponent(tokens: dict[str, int], target_entropy: float | None = None, repeat_limit: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1] that meets the entropy or stays within the repetition limit.

    Entropy falls and repetition falls as the exponent grows, so both are found by bisection:
    the largest exponent with at least `target_entropy`, or the smallest with at most `repeat_limit`. A
    target out of reach gives the nearest end.
    """
    low, high = 0.0, 1.0

    def flat_enough(x: float) -> bool:
        return entropy(shares(tokens, x)) >= target_entropy

    def sparse_enough(x: float) -> bool:
        return repetition(tokens, shares(tokens, x)) <= repeat_limit * (1 + 1e-12)

    if target_entropy is not None:
        if flat_enough(high):
            return high
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if flat_enough(mid) else (low, mid)
        return low
    if repeat_limit is None or sparse_enough(low):
        return low if repeat_limit is not None else high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if sparse_enough(mid) else (mid, high)
    return high


def plan_mixture(tokens: dict[str, int], target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None) -> Mixture:
    """Weights and token quotas of the sources.

    Without a budget it is the least with which every source is used once in full; the most
    repeated source is then passed `repeat_limit` times at most.
    """
    exponent = bisect_exponent(tokens, target_entropy, repeat_limit)
    weights = shares(tokens, exponent)
    if budget is None:
        budget = max((math.ceil(tokens[s] / w) for s, w in weights.items()), default=0)
    quotas = {s: max(0, round(budget * w)) for s, w in weights.items()}
    full = {s: tokens[s] for s in quotas if abs(quotas[s] - tokens[s]) <= 1}  # a whole pass isn't cut by rounding
    return Mixture(exponent, budget, weights, quotas | full)


def word_count(text: Column) -> Column:
    """Words of the text, split at ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mixed(docs: DataFrame, source: str = "source", tokens: str | None = None, tie: tuple[str, ...] = ("doc_id",), target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None, seed: int = 5) -> DataFrame:
    """Realise the mixture: docs plus mix_block, mix_place (long) and mix_weight (of the row's source).

    Each source's quota of tokens is dealt in blocks: block b is the source in the seeded order of
    that block, whole blocks first, then a last one that ends with the row that meets the quota. mix_place is
    the place in the block. Rows of all blocks together are the mixture.

    tokens: a column of token counts; without it the words of `text` count. Null sources are a source
    of their own; texts without tokens are in every whole block, and in a source without any tokens all
    rows stand once, in block 0; an empty table gives an empty result. Repeated rows are rows of their own. Columns
    of the added names are replaced, others keep their names and values, whatever these are.

    Per source only sums go to the driver (checked to be at most MOST_SOURCES); ranks and running
    sums never gather a source in one task (common.ranked).
    """
    kept = [c for c in docs.columns if c.lower() not in ("mix_block", "mix_place", "mix_weight")]
    count = F.coalesce(quoted(tokens).cast("long"), F.lit(0)) if tokens else word_count(F.col("text"))
    ties = [quoted(c).alias(f"tie{i}") for i, c in enumerate(tie)]
    base = rows_of(docs.select(*map(quoted, kept)), key_of(source).alias("key"), count.alias("tokens"), *ties)
    rows, quotas = _quotas(base, target_entropy, repeat_limit, budget)
    dealt, _ = _dealt(base, rows, quotas, [F.col(f"tie{i}") for i in range(len(tie))], seed)
    return dealt.select(*(F.col("row").getField(c).alias(c) for c in kept), "mix_block", F.col("rank").alias("mix_place"), "mix_weight")


def _quotas(base: DataFrame, target_entropy: float | None, repeat_limit: float | None, budget: int | None) -> tuple[int, DataFrame]:
    """Of base (key, tokens): an upper bound of its blocks' rows, and per source whole blocks, rest and weight."""
    sums = base.groupBy("key").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals = {r["key"]: r["t"] for r in sums}
    plan = plan_mixture(totals, target_entropy, repeat_limit, budget)
    table = []
    for s, total in totals.items():
        whole, rest = divmod(plan.quotas.get(s, 0), total) if total else (1, 0)
        table.append((s, int(whole), int(rest), plan.weights.get(s, 0.0)))
    rows = sum(r["n"] for r in sums) * max((w + (r > 0) for _, w, r, _ in table), default=1)
    return rows, base.sparkSession.createDataFrame(table, "key string, whole long, rest long, mix_weight double")


def _dealt(base: DataFrame, rows: int, quotas: DataFrame, tie: list[Column], seed: int) -> tuple[DataFrame, DataFrame]:
    """The uses of all rows with their place in their block, and those of the cut last blocks only."""
    blocks = base.join(F.broadcast(quotas), "key").withColumn("mix_block", F.explode(F.expr("if(whole + rest > 0, sequence(0L, whole + if(rest > 0, 0L, -1L)), array())")))
    blocks = blocks.withColumn("source", F.col("key")).withColumn("key", F.concat_ws("\u0001", "mix_block", "key"))
    order = [F.col("mix_block"), *tie]
    dealt = ranked(blocks, rows, order, seed, "tokens")
    last = F.col("mix_block") == F.col("whole")
    return dealt.where(~last | (F.col("before") < F.col("rest"))), ranked(blocks.where(last), rows, order, seed, "tokens").where(F.col("before") < F.col("rest"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """A row for each use of a document: doc_id, source, tokens (words), mix_block, mix_place, mix_weight; texts aren't shuffled.

    The narrow table of ids and word counts is written once, so that the words are counted once.
    """
    narrow = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("tokens")))
    return mixed(narrow, tokens="tokens", tie=("doc_id", "tokens"))


def mixed_documents(docs: DataFrame, source: str = "source", target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None, seed: int = 5) -> DataFrame:
    """docs with each row as often as `mixed` uses it, columns as before and without shuffling texts.

    A cut last block is a prefix of its seeded order, so one bound per source (found on ids and
    token counts alone) tells which rows are in it. Rows equal in doc_id and token count are used alike. Columns keep their names, whatever these are.
    """
    base = cut(docs.select(key_of(source).alias("key"), word_count(F.col("text")).alias("tokens"), quoted("doc_id").alias("id")))
    rows, quotas = _quotas(base, target_entropy, repeat_limit, budget)
    tie = [F.col("id"), F.col("tokens")]
    _, cut_blocks = _dealt(base, rows, quotas, tie, seed)
    at = F.struct(F.pmod("hash", F.lit(buckets_for(rows))).alias("bucket"), "hash", "id", "tokens")
    bounds = cut_blocks.groupBy(F.col("source").alias("key")).agg(F.max(at).alias("bound"))
    bounds = quotas.join(bounds, "key", "left")  # at most MOST_SOURCES rows
    # words are counted again only where a last block is cut: that is cheaper than joining the counts to the texts
    full = rows_of(docs, key_of(source).alias("key"), quoted("doc_id").alias("id")).join(F.broadcast(bounds), "key")
    full = full.withColumn("tokens", F.when(F.col("bound").isNotNull(), word_count(F.col("row").getField("text"))).otherwise(F.lit(0)).cast("long"))
    full = full.withColumn("hash", F.xxhash64(F.lit(seed), F.col("whole"), F.col("id"), F.col("tokens")))
    more = F.when(F.col("bound").isNotNull() & (at <= F.col("bound")), 1).otherwise(0)
    full = full.withColumn("use", F.explode(F.array_repeat(F.lit(0), (F.col("whole") + more).cast("int"))))
    return full.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
