"""URL filter: host and path rules, then a character language-model ratio.

Two variable-order Markov models of characters, one of URLs that rules allow and one of URLs that rules block, are
smoothed by interpolating each order with the next lower one (Witten-Bell weights). A URL without a rule is judged by its
log-likelihood difference divided by its length, against a threshold calibrated on URLs kept out of the counts.

Rules read host and path; the models read the whole URL, scheme, query and fragment included, its host lower-cased. Defined cases: a URL without "://"
has an empty host and path and no rule, and the models read it as it is; a null or empty one has score 0 and verdict allow (nothing speaks
against it). A score equal to the threshold means allow. If either class has no URL to learn from, every score is 0 and the verdict is allow. The models learn
from at most MAX_TRAIN different rows (id, URL) a class, none longer than MAX_URL characters, picked by a hash; every URL is
scored whole. Null ids, repeated ids and repeated rows are judged each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from catalpa.llm.common import bounded_sample, col, with_made

#: (rule, verdict); a rule is a host and, from its first slash, the start of a path.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
MAX_TRAIN = 4000
MAX_URL = 2048
ORDER = 5
ALPHABET = 256


class MarkovModel:
    """Characters given at most `order` before them."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[str, dict[str, int]] = {}
        self.totals: dict[str, int] = {}

    def fit(self, texts: Iterable[str]) -> MarkovModel:
        for text in texts:
            padded = "\x02" + text + "\x03"
            for i in range(1, len(padded)):
                for n in range(min(self.order, i) + 1):
                    after = self.counts.setdefault(padded[i - n : i], {})
                    after[padded[i]] = after.get(padded[i], 0) + 1
        self.totals = {context: sum(after.values()) for context, after in self.counts.items()}
        return self

    def log_prob(self, text: str) -> float:
        padded, total = "\x02" + text + "\x03", 0.0
        counts, totals = self.counts, self.totals
        for i in range(1, len(padded)):
            p, c = 1.0 / ALPHABET, padded[i]
            for n in range(min(self.order, i) + 1):
                context = padded[i - n : i]
                after = counts.get(context)
                if after is None:
                    break
                kinds = len(after)
                p = (after.get(c, 0) + kinds * p) / (totals[context] + kinds)
            total += math.log(p)
        return total


def ratio(allow: MarkovModel, block: MarkovModel, text: str) -> float:
    """Log-likelihood difference for each character, above 0 where the allow model fits better."""
    return (allow.log_prob(text) - block.log_prob(text)) / (len(text) + 1) if text else 0.0


def calibrate(allowed: list[float], blocked: list[float]) -> float:
    """The threshold with the best balanced accuracy, midway between the two scores that enclose it."""
    scores = np.array(allowed + blocked)
    if not allowed or not blocked:
        return 0.0
    order = np.argsort(scores, kind="stable")
    is_allowed = np.array([1] * len(allowed) + [0] * len(blocked))[order]
    ranked = scores[order]
    below_block = np.concatenate([[0], np.cumsum(1 - is_allowed)]) / len(blocked)
    above_allow = 1 - np.concatenate([[0], np.cumsum(is_allowed)]) / len(allowed)
    best = int(np.argmax(below_block + above_allow))
    low = ranked[best - 1] if best else ranked[0] - 1e-6
    high = ranked[best] if best < len(ranked) else ranked[-1] + 1e-6
    return float((low + high) / 2)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, with A-Z lower-cased, path, and the whole URL with that host; of a URL without "://" only the whole isn't empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return host, path, F.when(url.contains("://"), F.concat(scheme, host, after)).otherwise(url)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/") if "/" in rule else len(rule)
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Judge every url: id, host, path, rule, verdict, score (length-normalised log ratio) and threshold."""
    host, path, whole = url_parts(col(url_col))
    parts = pages.select(col(id_col), host.alias("host"), path.alias("path"), whole.alias("whole"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select(col(id_col), "host", "path", "whole", rule.alias("rule"), verdict.alias("by_rule"))
    short = ruled.where(F.length("whole") <= MAX_URL)
    seen = {says: sorted_rows(bounded_sample(short.where(F.col("by_rule") == says).select(col(id_col).cast("string").alias("id"), "whole"), MAX_TRAIN)) for says in ("allow", "block")}
    allow, block = (MarkovModel().fit(seen[says][::2]) for says in ("allow", "block"))
    ready = bool(seen["allow"]) and bool(seen["block"])
    threshold = calibrate(*([ratio(allow, block, u) for u in seen[says][1::2]] for says in ("allow", "block"))) if ready else 0.0
    models = pages.sparkSession.sparkContext.broadcast((allow, block) if ready else None)

    def judge(texts: list[str], given: list[str | None]) -> dict[str, list]:
        scores = [ratio(*models.value, u) for u in texts] if models.value else [0.0] * len(texts)
        own = ["allow" if not u or s >= threshold else "block" for u, s in zip(texts, scores)]
        return {"verdict": [v if r is None else r for r, v in zip(given, own)], "score": scores, "threshold": [threshold] * len(texts)}

    return with_made(ruled, [id_col, "host", "path", "rule"], ["whole", "by_rule"], judge, {"verdict": StringType(), "score": DoubleType(), "threshold": DoubleType()})


def sorted_rows(sample: DataFrame) -> list[str]:
    """The URLs of (id, whole), in the order of a hash, the same on each run."""
    rows = sample.withColumn("h", F.xxhash64("id", "whole")).collect()
    return [r["whole"] for r in sorted(rows, key=lambda r: (r["h"], r["whole"]))]
