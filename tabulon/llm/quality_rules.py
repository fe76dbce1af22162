"""Document statistics and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, in_batches, key_of
from .kernels import chunks, mix, text_buffer, windows, word_hashes, words

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
LETTERS = np.zeros(256, np.int64)  # first bytes of code points
LETTERS[[b for b in range(256) if b & 0xC0 != 0x80]] = 1
WINDOW = 8
#: Dimensions of the transformed vector.
DIMENSIONS = 5
#: Share of a group that the minimum covariance determinant is fitted on.
CORE = 0.75
#: Starts of the search: one from medians and quartiles, the others from about DRAWN rows each, drawn by hash.
STARTS = 5
DRAWN = 24
#: Concentration steps after which only the two best starts of a group go on, and at most; steps end when no determinant falls by that share.
FIRST_STEPS = 2
MOST_STEPS = 25
FALL = 0.01
#: A group of fewer documents is judged with its language's estimate, a smaller language with that of all.
LEAST_ROWS = 60
#: Quantiles of chi-squared: of squared distances that count in the last, reweighted estimate, and beyond which a document is rejected.
REWEIGHTED = 0.975
REJECTED = 0.9999
#: What the spread along a dimension counts for at least, where a group's core has less: a statistic that is constant there has none.
LEAST_SPREAD = (0.2, 0.06, 0.35, 0.6, 0.6)
#: Bins of the logarithm of squared distances; the bin in which the core ends counts in part.
BINS_PER_UNIT = 16


def chi_squared(x: float, degrees: int = DIMENSIONS) -> float:
    """Distribution function for an odd number of degrees of freedom."""
    value, term = math.erf(math.sqrt(x / 2)), math.sqrt(x / 2) * math.exp(-x / 2) / math.gamma(1.5)
    for k in range(1, degrees, 2):
        value -= term
        term *= (x / 2) / (k / 2 + 1)
    return value


def chi_squared_quantile(share: float, degrees: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, degrees) < share else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the `share` of a normal distribution nearest to its centre has to be multiplied with."""
    return share / chi_squared(chi_squared_quantile(share), DIMENSIONS + 2)


def _totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over each text."""
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def repeated_words(hashes: np.ndarray, ranges: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """For each text its words that stand in a k-word window found twice or more in that text."""
    value, inside = windows(hashes, ranges, k)
    at = np.flatnonzero(inside)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        text = np.repeat(np.arange(len(ranges) - 1, dtype=np.uint64), np.diff(ranges))[at]
        own = mix(value[at] + mix(text + np.uint64(0x51)))
        order = np.argsort(own, kind="stable")
        ordered = own[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + k, -1)
    return _totals(np.cumsum(covered)[:-1] > 0, ranges)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text its lines with a word that equal an earlier line."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lines = bytes(data[a:b]).split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            worded = [x for x in lines if x.translate(None, b" \t\n\v\f\r")]
            out[i] = len(worded) - len(set(worded))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text"):
            data, offsets = text_buffer(part.column("text"))
            starts, ends, ranges = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            solid = np.cumsum(inside)[:-1]
            found = [np.diff(ranges), _totals(LETTERS[data] * solid, offsets), _totals(SYMBOLS[data], offsets), duplicate_lines(data, offsets), repeated_words(hashes, ranges)]
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in found)], [*kept, *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of each whole text; a null text has zeros."""
    rows = docs.select("doc_id", "lang", "source", "text")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    return in_batches(rows, _measure, schema + "".join(f", {c} long" for c in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: log length, word length, and log rates of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c: F.log1p(F.lit(100.0) * F.col(c) / n)
    return [F.log1p(n), F.log1p(F.col("word_chars") / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]


NAMES = [f"x{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
LEVELS = ["level2", "level1", "level0"]
ESTIMATE = "group string, start int, det double" + "".join(f", m{i} double" for i in range(DIMENSIONS)) + "".join(f", p{i}{j} double" for i, j in PAIRS)


def floored(matrix: np.ndarray) -> np.ndarray:
    """Covariances with at least LEAST_SPREAD in every direction, so that none is degenerate."""
    scale = np.outer(LEAST_SPREAD, LEAST_SPREAD)
    values, vectors = np.linalg.eigh(matrix / scale)
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * scale


def _estimate(group: str, start: int, mean: np.ndarray, matrix: np.ndarray, factor: float) -> list:
    matrix = floored(matrix * factor)
    inverse = np.linalg.inv(matrix)
    return [group, start, float(np.linalg.det(matrix)), *mean.tolist(), *(float(inverse[i, j]) for i, j in PAIRS)]


def _refit(keep: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """An estimate from the moments of a group by bins of distance: of its nearest CORE share, or of those within REWEIGHTED."""
    limit = chi_squared_quantile(REWEIGHTED)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        count = frame["k"].to_numpy(float)
        if keep == "core":
            wanted = math.ceil(CORE * count.sum())
            weight = np.clip((wanted - (np.cumsum(count) - count)) / count, 0, 1)
            factor = consistency(CORE)
        else:
            weight = (np.exp((frame["bin"].to_numpy(float) + 0.5) / BINS_PER_UNIT) <= limit).astype(float)
            factor = consistency(REWEIGHTED)
        n = max((weight * count).sum(), 1e-9)
        shift = np.array([(weight * frame[f"s{i}"]).sum() / n for i in range(DIMENSIONS)])
        matrix = np.zeros((DIMENSIONS, DIMENSIONS))
        for i, j in PAIRS:
            matrix[i, j] = matrix[j, i] = (weight * frame[f"s{i}{j}"]).sum() / n - shift[i] * shift[j]
        mean = np.array([frame[f"m{i}"].iloc[0] for i in range(DIMENSIONS)]) + shift
        row = _estimate(frame["group"].iloc[0], int(frame["start"].iloc[0]), mean, matrix, factor)
        return pd.DataFrame([row], columns=[c.split()[0] for c in ESTIMATE.split(", ")])

    return run


def _first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Starts from medians and quartiles, or from the moments of drawn rows."""
    for frame in frames:
        rows = []
        for r in frame.to_dict("records"):
            matrix = np.zeros((DIMENSIONS, DIMENSIONS))
            for i, j in PAIRS:
                matrix[i, j] = matrix[j, i] = r[f"c{i}{j}"] or 0.0
            rows.append(_estimate(r["group"], r["start"], np.array([r[f"m{i}"] for i in range(DIMENSIONS)]), matrix, 1.0))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ESTIMATE.split(", ")])


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. under the joined estimate."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}")) * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _with(rows: DataFrame, estimate: DataFrame, on: str = "group") -> DataFrame:
    """Join by group: broadcast when a count shows few groups, else a join that splits large groups."""
    small = estimate.limit(BROADCAST_ROWS // 20 + 1).count() <= BROADCAST_ROWS // 20
    return rows.join(F.broadcast(estimate) if small else estimate.hint("merge"), on)


def _step(rows: DataFrame, estimate: DataFrame, keep: str) -> DataFrame:
    """One concentration step for every group and start: a single aggregation that combines before its shuffle.

    What is gathered for a group are the moments of its bins, whose number doesn't grow with its rows.
    """
    placed = _with(rows, estimate.drop("det")).withColumn("bin", F.floor(F.log(_distance() + 1e-6) * BINS_PER_UNIT).cast("int"))
    near = lambda i: F.col(f"x{i}") - F.col(f"m{i}")
    sums = [F.count(F.lit(1)).alias("k"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(DIMENSIONS)), *(F.sum(near(i)).alias(f"s{i}") for i in range(DIMENSIONS)), *(F.sum(near(i) * near(j)).alias(f"s{i}{j}") for i, j in PAIRS)]
    bins = placed.groupBy("group", "start", "bin").agg(*sums)
    return cut(bins.groupBy("group", "start").applyInPandas(_refit(keep), ESTIMATE))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant of each group of rows (group, drawn, x0..): a row per group with means and inverse covariances.

    From STARTS starts concentration steps go on until no determinant falls any more (MOST_STEPS at most, far more than they need): the
    CORE share of smallest distances under the estimate gives the next one. After FIRST_STEPS only the two best starts of a group
    go on, and the one of least determinant is kept. One reweighted estimate, of all rows within the REWEIGHTED
    quantile, follows. `drawn` is the start that a row was drawn for (null: none).
    """
    d = range(DIMENSIONS)
    middle = [F.percentile_approx(n, 0.5, 1_000).alias(f"m{i}") for i, n in enumerate(NAMES)]
    spread = [F.percentile_approx(n, [0.25, 0.75], 1_000).alias(f"q{i}") for i, n in enumerate(NAMES)]
    quartiles = [(F.pow((F.col(f"q{i}")[1] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    still = rows.groupBy("group").agg(*middle, *spread).select("group", F.lit(0).alias("start"), *(f"m{i}" for i in d), *quartiles)
    moments = [F.avg(f"x{i}").alias(f"m{i}") for i in d] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in PAIRS]
    drawn = rows.where("drawn is not null").groupBy("group", F.col("drawn").alias("start")).agg(*moments)
    estimate = cut(still.unionByName(drawn).mapInPandas(_first, ESTIMATE))
    for step in range(MOST_STEPS):
        last, estimate = estimate, _step(rows, estimate, "core")
        if step + 1 == FIRST_STEPS:
            best = Window.partitionBy("group").orderBy("det", "start")
            estimate = cut(estimate.withColumn("place", F.row_number().over(best)).where("place <= 2").drop("place"))
        elif step:
            before = last.select("group", "start", F.col("det").alias("before"))
            if estimate.join(before, ["group", "start"]).where(F.col("det") < (1 - FALL) * F.col("before")).isEmpty():
                break
    least = Window.partitionBy("group").orderBy("det", "start")
    estimate = cut(estimate.withColumn("place", F.row_number().over(least)).where("place = 1").drop("place"))
    return _step(rows, estimate, "near")


def quality_rules(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Base rules and robust outliers by language and source: doc_id, the statistics, base_failed, kept, distance.

    The minimum covariance determinant of each (lang, source) is fitted on all its documents that pass the base rules
    (robust_estimates); no group is gathered, whatever its size. Groups of under `least_rows` documents use their
    language's estimate, such languages that of all; with under `least_rows` documents in all nothing is rejected by
    distance. A document is kept if it passes the base rules and its squared distance is within the REJECTED quantile of chi-squared.

    Null texts count as empty (they fail the base rules); null lang or source is a value of its own; repeated
    rows each count; very long texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    rows = statistics(docs).withColumn("base_failed", base_failed())
    names = [x.alias(n) for x, n in zip(vector(), NAMES, strict=True)]
    levels = [F.concat_ws("\u0001", F.lit("2"), key_of("lang"), key_of("source")).alias("level2"), F.concat_ws("\u0001", F.lit("1"), key_of("lang")).alias("level1"), F.lit("0").alias("level0")]
    rows = cut(rows.select("doc_id", *STATISTICS, "base_failed", *names, *levels, F.xxhash64(F.lit(11), "doc_id", *STATISTICS).alias("hash")))
    sizes = rows.where(~F.col("base_failed")).groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n2"))
    groups = rows.select(*LEVELS).distinct().join(sizes, LEVELS, "left").fillna(0, "n2")
    groups = groups.withColumn("n1", F.sum("n2").over(Window.partitionBy("level1")))
    groups = cut(groups.join(F.broadcast(sizes.agg(F.coalesce(F.sum("n2"), F.lit(0)).alias("n0"), F.lit("0").alias("level0"))), "level0"))  # one row
    enough = [F.col(f"n{i}") >= least_rows for i in (2, 1, 0)]
    own = F.when(enough[0], F.col("level2")).when(enough[1], F.col("level1")).when(enough[2], F.col("level0"))
    # every group feeds its own estimate, and those of the levels above that some group needs
    needed = groups.select(own.alias("group")).where("group is not null").distinct()
    feeds = groups.select("level2", F.explode(F.array(F.struct(F.col("level2").alias("group"), F.col("n2").alias("n")), F.struct(F.col("level1").alias("group"), F.col("n1").alias("n")), F.struct(F.col("level0").alias("group"), F.col("n0").alias("n")))).alias("f"))
    feeds = cut(feeds.select("level2", "f.group", "f.n").join(needed, "group", "left_semi"))
    usable = _with(rows.where(~F.col("base_failed")).select("level2", "hash", *NAMES), feeds, "level2")
    turn = F.pmod(F.xxhash64("hash", "group"), F.greatest(F.floor(F.col("n") / DRAWN), F.lit(STARTS - 1)))
    usable = cut(usable.select("group", *NAMES, F.when(turn < STARTS - 1, (turn + 1).cast("int")).alias("drawn")))
    estimate = robust_estimates(usable)
    final = cut(groups.select("level2", own.alias("group")).join(estimate.drop("start", "det"), "group", "left").drop("group"))
    judged = _with(rows, final, "level2").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_squared_quantile(REJECTED))
    return judged.select("doc_id", *STATISTICS, "base_failed", kept.alias("kept"), "distance")
