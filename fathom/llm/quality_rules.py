"""Quality rules by document and by host.

Each document gets counts and, by the base rules, a base verdict. Failures are counted by host and rule. For each rule the
hosts' rates are shrunk towards the mean by a beta prior, which is fitted to the hosts by moments weighted with their
sizes, binomial noise taken out: hosts that differ by chance alone shrink to the mean. Prior and counts give the posterior
of each host's rate, and a verdict asks how much of it lies beyond a limit, so it hangs on the number of a host's
documents and on the prior's weight, not on the raw rate alone. Host verdicts are joined back:

* A host is rejected, with all its documents, if it is sure (sure_rejected) that most of them fail a base rule.
* A host is watched for a further rule if it is sure (sure_watched) that its rate of it is above the mean. Documents that
  fail this rule go on a watched host; on others a single failure is let pass.

Edge cases: a null or empty text has no words and so fails; a null host is a host of its own; repeated rows are judged
and counted one by one; a host alone has the mean rate and is not watched; a rule that all or no documents fail rejects
and watches no host; texts of any length are counted whole, in memory that is a small multiple of a text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, same, staged

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """min_words and max_repeat make the base verdict; max_symbols (a word) and max_dup_lines (of the lines) are the further
    rules. A host is rejected if its posterior has sure_rejected of its mass above most_failing, and watched if it has
    sure_watched above the mean."""

    min_words: int = 50
    max_repeat: float = 0.5
    max_symbols: float = 1.0
    max_dup_lines: float = 0.5
    most_failing: float = 0.5
    sure_rejected: float = 0.95
    sure_watched: float = 0.9

    def rules(self) -> dict[str, Column]:
        """Each rule by name: whether a document fails it. The base rules come first."""
        c = F.col
        return {
            "short": c("n_words") < self.min_words,
            "repeats": 100 * c("n_repeat_words") > F.lit(100 * self.max_repeat) * c("n_words"),
            "symbols": c("n_symbols") > F.lit(self.max_symbols) * c("n_words"),
            "dup_lines": c("n_dup_lines") > F.lit(self.max_dup_lines) * c("n_lines"),
        }


BASE_RULES, FURTHER_RULES = ("short", "repeats"), ("symbols", "dup_lines")


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = 0
    if len(words) > 2:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        _, at, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeats = int(covered.sum())
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeats


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every document."""

    def worker():
        names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
        return lambda texts: dict(zip(names, zip(*map(count_text, texts)))) if texts else {n: [] for n in names}

    schema = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    return computed(docs.select("doc_id", F.col(host).cast("string").alias("host"), "text"), ["doc_id", "host"], ["text"], schema, worker)


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """mean and weight (in documents) of each rule's beta prior, from one row per host: n and its failures by rule.

    The variance between hosts is what the weighted spread of their rates has beyond binomial noise; if nothing is left,
    the prior weighs as much as all documents.
    """
    names = BASE_RULES + FURTHER_RULES
    c = F.col
    sums = hosts.agg(F.sum("n").alias("n"), F.sum(c("n") * c("n")).alias("nn"), F.count("*").alias("hosts"), *(F.sum(k).alias(k) for k in names)).first()
    total = sums["n"] or 0
    means = {k: (sums[k] or 0) / total if total else 0.0 for k in names}
    spread = hosts.agg(*(F.sum(c("n") * (c(k) / c("n") - means[k]) * (c(k) / c("n") - means[k])).alias(k) for k in names)).first()
    out = {}
    for k in names:
        noise, m = means[k] * (1 - means[k]), means[k]
        room = total - sums["nn"] / total if total else 0.0
        between = (spread[k] - (sums["hosts"] - 1) * noise) / room if room > 0 else 0.0
        out[k] = m, min(max(noise / between - 1, 1.0), float(total)) if between > 0 and noise > 0 else float(max(total, 1))
    return out


def quantile(share: float) -> float:
    """The standard normal value below which a share of the mass lies, as verdicts compare it."""
    return round(NormalDist().inv_cdf(share), 9)


def above(n: Column, k: Column, mean: float, weight: float, limit: float) -> Column:
    """How far the posterior of a rate lies above limit, in deviations of its logit, after k failures of n under a beta prior
    of that mean and weight: the logit of Beta(a, b) is taken as normal around ln(a / b) with variance 1 / a + 1 / b."""
    if not 0 < mean < 1:
        return F.lit(None).cast("double")
    a, b = k + F.lit(mean * weight), n - k + F.lit((1 - mean) * weight)
    return F.round((F.log(a / b) - F.lit(log(limit / (1 - limit)))) / F.sqrt(1 / a + 1 / b), 9)


def host_verdicts(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, host_failed and, for each rule, rate_<rule> (shrunk); watch_<rule> for the further rules. A row for each host;
    its failures are counted before the shuffle."""
    fails = limits.rules()
    hosts = staged(measured.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(f).alias(k) for k, f in fails.items())), "hosts")
    fitted = priors(hosts)
    rates = {k: F.round((F.col(k) + F.lit(m * w)) / (F.col("n") + F.lit(w)), 9) for k, (m, w) in fitted.items()}
    sure = lambda k, limit, share: F.coalesce(above(F.col("n"), F.col(k), *fitted[k], limit) >= quantile(share), F.lit(False))
    beyond = [sure(k, limits.most_failing, limits.sure_rejected) for k in BASE_RULES]
    watched = [sure(k, fitted[k][0], limits.sure_watched).alias(f"watch_{k}") for k in FURTHER_RULES]
    return hosts.select("host", (beyond[0] | beyond[1]).alias("host_failed"), *watched, *(r.alias(f"rate_{k}") for k, r in rates.items()))


def judge(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The counts of every document with base_failed, what is known of its host, and kept."""
    fails, c = limits.rules(), F.col
    measured = staged(measure(docs, host), "measured")
    hosts = host_verdicts(measured, limits).withColumnRenamed("host", "of")
    joined = measured.join(hosts, same(measured["host"], hosts["of"]), "left").withColumn("base_failed", fails["short"] | fails["repeats"])
    gone = c("base_failed") | c("host_failed")
    for k in FURTHER_RULES:
        gone = gone | (c(f"watch_{k}") & fails[k])
    return joined.withColumn("kept", ~gone)
