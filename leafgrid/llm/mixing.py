"""Mixing to target weights by soft domain membership, in DataFrame operations.

A classifier learned from a labelled table gives each document its posterior
over domains: naive Bayes over its words, whose weights are a broadcast table
of ``BUCKETS`` hash buckets; a task sums its own documents' weights before the
shuffle.  Document rates r >= 0 are then fitted by projected-gradient least
squares so that the expected tokens of each domain, sum of r * tokens *
posterior, match the targets.  The gradient needs only one number a domain, so
a step is one aggregate over (tokens, posterior); a document's rate is a fixed
expression of its posterior and the steps so far, and no state is shuffled or
collected.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, labelled_sample, only

#: Labelled documents and gradient steps at most, hash buckets of words, words
#: whose evidence a document's posterior takes at most, its decimals, the
#: relative error at which fitting ends and the one up to which a target counts
#: as met.
SAMPLE, STEPS, BUCKETS, EVIDENCE, GRAIN, CLOSE, MET = 3000, 40, 1 << 14, 20, 3, 1e-6, 1e-3
#: Production targets.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
_BLANKS = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """Lower-cased runs of anything but ASCII white space."""
    whole = F.btrim(F.coalesce(F.lower(text), F.lit("")), F.lit(_BLANKS))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "[\\x20\\x09-\\x0D]+"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def word_weights(labelled: DataFrame, domains: list[str]) -> DataFrame:
    """(bucket, w0, w1, ...): the weight of a word of (text, label) rows for
    each domain, the logarithm of its smoothed share of the domain's words less
    the domains' mean."""
    k = range(len(domains))
    each = labelled.select("label", F.explode(_words(F.col("text"))).alias("word")).select("label", _bucket(F.col("word")).alias("bucket"))
    counts = each.groupBy("bucket").agg(*(F.count(F.when(F.col("label") == d, 1)).alias(f"n{j}") for j, d in enumerate(domains)))
    totals = counts.agg(*(F.coalesce(F.sum(f"n{j}"), F.lit(0)) for j in k)).first()
    logs = [F.log((F.col(f"n{j}") + 0.5) / F.lit(totals[j] + 0.5 * BUCKETS)) for j in k]
    mean = sum(logs, F.lit(0.0)) / len(domains)
    return counts.select("bucket", *(F.round(x - mean, 6).alias(f"w{j}") for j, x in enumerate(logs)))


def posteriors(rows: DataFrame, weights: DataFrame, width: int) -> DataFrame:
    """(row, n, p0, p1, ...) and other columns for each of (row, text, ...): its
    words, and its share of each of ``width`` domains, the softmax of the sums of its words' weights.
    A long text has those of ``EVIDENCE`` words (its mean weight that often), as
    neighbouring words are not independent."""
    k, more = range(width), [c for c in rows.columns if c not in ("row", "text")]
    words = rows.select("row", *more, _words(F.col("text")).alias("words"))
    # a text without words keeps a row; BUCKETS weights at most are broadcast
    each = words.select("row", *more, F.size("words").cast("long").alias("n"), F.explode_outer("words").alias("word")).withColumn("bucket", _bucket(F.col("word")))
    sums = each.join(F.broadcast(weights), "bucket", "left").groupBy("row").agg(*(F.first(c).alias(c) for c in (*more, "n")), *(F.coalesce(F.sum(f"w{j}"), F.lit(0.0)).alias(f"s{j}") for j in k))
    share = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest("n", F.lit(1)))
    sums = sums.select("row", *more, "n", F.array(*(F.col(f"s{j}") * share for j in k)).alias("s")).withColumn("top", F.array_max("s"))
    odds = sums.select("row", *more, "n", F.transform("s", lambda x: F.exp(x - F.col("top"))).alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda t, x: t + x)
    near = odds.select("row", *more, "n", F.transform("e", lambda x: F.round(x / whole, GRAIN)).alias("p"))
    # the largest share takes what rounding leaves, so that all sum to 1
    top = F.array_position("p", F.array_max("p")) - 1
    rest = F.aggregate("p", F.lit(1.0), lambda t, x: t - x)
    return near.select("row", *more, "n", *(F.round(F.get("p", F.lit(j)) + F.when(top == j, rest).otherwise(0.0), GRAIN).alias(f"p{j}") for j in k))


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination for a few unknowns."""
    n = len(right)
    rows = [[*line, b] for line, b in zip(matrix, right, strict=True)]
    for i in range(n):
        top = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for j in range(n):
            if j != i:
                by = rows[j][i] / rows[i][i]
                rows[j] = [x - by * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def fit_rates(table: DataFrame, targets: list[float], min_rate: float, steps: int = STEPS, keep_all: bool = False) -> tuple[Column, list[float], list[float]]:
    """The rate of a row of (n, p0, p1, ...) as an expression, the expected
    tokens by domain and the target tokens.

    The target total is the tokens there are; with ``keep_all`` it is the least
    total at which no domain has to shrink.  The squares are weighted by the
    inverse of the domains' second moments, in which metric one full step is
    the whole way as long as no rate meets ``min_rate``.
    """
    k = range(len(targets))
    p = [F.col(f"p{j}") for j in k]
    n = F.col("n").cast("double")
    sums = table.agg(*(F.coalesce(F.sum(n * p[j]), F.lit(0.0)) for j in k), *(F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)) for i in k for j in k)).first()
    have, moments = list(sums[: len(targets)]), sums[len(targets) :]
    total = sum(have)
    if keep_all:
        total = max([total, *(h / t for h, t in zip(have, targets, strict=True) if t > 0 and h > 0)])
    want = [total * t for t in targets]
    ridge = 1e-9 * (sum(have) + 1)
    gram = [[moments[i * len(targets) + j] + (ridge if i == j else 0.0) for j in k] for i in k]
    rate, now = F.lit(1.0), have
    for _ in range(steps):
        if max(abs(a - b) for a, b in zip(now, want, strict=True)) <= CLOSE * (total + 1):
            break
        slope = _solve(gram, [a - b for a, b in zip(now, want, strict=True)])
        rate = F.greatest(F.lit(float(min_rate)), rate - sum((p[j] * F.lit(slope[j]) for j in k), F.lit(0.0)))
        now = list(table.select("n", *p, rate.alias("r")).agg(*(F.coalesce(F.sum(n * F.col("r") * p[j]), F.lit(0.0)) for j in k)).first())
    return rate, now, want


def _fitted(rows: DataFrame, docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str, text_col: str, min_rate: float, keep_all: bool, sample: int, tables: Tables) -> tuple[DataFrame, bool]:
    """(row, n, p0, ..., rate) and other columns for each of ``rows`` (row,
    text, ...), from a table, and whether all targets are met."""
    domains = sorted(targets)
    whole = float(sum(targets.values()))
    chosen = labelled_sample(docs, labelled, id_col, text_col, "label", sample, tables).filter(F.col("label").isin(domains))
    weights = tables.keep(word_weights(chosen.select("text", "label"), domains))
    table = tables.result(posteriors(rows, weights, len(domains)))
    # a rate depends on the posterior alone, so rows of equal ones fit as one
    shares = [f"p{j}" for j in range(len(domains))]
    cells = tables.keep(table.groupBy(*shares).agg(F.sum("n").alias("n")))
    rate, now, want = fit_rates(cells, [targets[d] / whole for d in domains], min_rate, keep_all=keep_all)
    met = all(abs(a - b) <= MET * (sum(want) + 1) for a, b in zip(now, want, strict=True))
    if not met:
        told = ", ".join(f"{d} {a:.0f} of {b:.0f}" for d, a, b in zip(domains, now, want, strict=True))
        warnings.warn(f"targets are not met; expected tokens: {told}", stacklevel=3)
    return table.withColumn("rate", F.round(rate, 6)), met


def _chance(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", min_rate: float = 0.0, keep_all: bool = False, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_tokens, p_<domain>, ...,
    rate, copies, met).

    ``labelled`` has ``id_col`` and ``label``, a domain; ``targets`` gives the
    domains' weights, which are scaled to sum to 1.  Tokens are runs of
    anything but ASCII white space.  ``copies`` is the rate rounded up or down
    by a hash of the row, so that its mean is the rate.  The classifier learns
    from ``sample`` rows at most and has ``BUCKETS`` weights a domain; words
    that share a bucket share a weight.

    Null and empty texts have no tokens and equal posteriors; their rate
    follows from those.  Labels outside ``targets`` and labels of held-out rows
    are not used; without usable labels all posteriors are equal.  If ``STEPS``
    steps do not meet the targets, or nothing can (a domain that no document
    has), the nearest rates so far are given, ``met`` is false in every row and
    a warning states the expected tokens.  Repeated rows get equal results,
    other rows that share an id each their own.  Other columns are ignored.  An
    empty table gives an empty result.
    """
    with Tables(docs.sparkSession) as tables:
        # equal rows have equal chances
        source = only(docs, id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), "id", "text", _chance("id", "text").alias("chance"))
        made, met = _fitted(source, docs, labelled, targets, id_col, text_col, min_rate, keep_all, sample, tables)
    shares = [F.col(f"p{j}").alias(f"p_{d}") for j, d in enumerate(sorted(targets))]
    return made.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), *shares, "rate", F.floor(F.col("rate") + F.col("chance")).cast("int").alias("copies"), F.lit(met).alias("met"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", min_rate: float = 1.0, keep_all: bool = True, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` says.  With
    the given defaults no row is dropped: scarce domains are repeated.  Rows are
    joined with their copies by a number of their own, not by id."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    with Tables(docs.sparkSession) as tables:
        source = tables.result(plain.withColumn("row", F.monotonically_increasing_id()))
        table, _ = _fitted(source.select("row", F.col(text).alias("text")), docs, labelled, targets, id_col, text_col, min_rate, keep_all, sample, tables)
    many = source.join(table.select("row", "rate"), "row").withColumn("_times", F.floor(F.col("rate") + _chance(key, text)).cast("int"))
    many = many.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return many.select(*(f"c{k}" for k in range(len(names)))).toDF(*names)
