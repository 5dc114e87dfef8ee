"""Quality rules by weak supervision.

Each rule looks at a document's counts and votes good (+1), bad (-1) or abstains (0). The counts of
vote patterns over all documents (at most 3**rules rows, whatever the corpus) feed an expectation-
maximisation that estimates how often each rule votes rightly in either class, and the posterior
probability of "good" replaces the usual all-must-pass filter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, map_arrow, slices

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: 1 for ASCII letters and digits and for the first byte of any other character.
ALNUM = np.array([chr(b).isalnum() if b < 128 else b >= 0xC0 for b in range(256)], dtype=np.int64)

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_alnum long, n_upper long, n_lines long, n_distinct long, n_plain long"
)


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words inside windows that occur at least twice; exact, by doubling ranks 1, 2, 4, ... words."""
    n = ids.size - window + 1
    if n < 2:
        return 0
    rank, width = ids, 1
    while width < window:
        step = min(width, window - width)
        m = rank.size - step
        pair = rank[:m].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    hit = np.bincount(rank)[rank] > 1
    if not hit.any():
        return 0
    edge = np.zeros(ids.size + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_text(raw: bytes) -> tuple:
    """The counts of FEATURES for one text (UTF-8)."""
    text = raw.decode("utf-8", "replace")
    words = raw.split()
    if not words:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    order: dict[bytes, int] = {}
    ids = np.fromiter((order.setdefault(w, len(order)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    own, low = np.frombuffer(raw, np.uint8), np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    alnum = int(ALNUM[own].sum())
    n_upper = int((own != low).sum()) if own.size == low.size else sum(map(str.isupper, text))
    plain = sum(w.isalpha() for w in text.split())
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, SPACE))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids) if len(order) < len(words) else 0,
        alnum,
        n_upper,
        len(lines),
        len(order),
        plain,
    )


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each document; a null text counts as empty."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [count_text(x) for x in as_bytes(part.column("text"))]
                yield {"id": part.column("id")} | dict(zip(NAMES, zip(*rows, strict=True), strict=True))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, f"id {kind}, {FEATURES}", run).withColumnRenamed("id", id_col)


def rules(c) -> dict[str, tuple]:
    """(votes good, votes bad) of each rule; every one of them may abstain, and bad goes before good.

    c maps the counts to Spark columns or to numpy arrays; n, lines, alnum and chars are the counts, 1 at least.
    """
    n, lines, alnum, chars = c["n"], c["lines"], c["alnum"], c["chars"]
    return {
        "v_length": (c["n_words"] >= 50, c["n_words"] < 20),
        "v_word_length": ((c["word_chars"] >= 3 * n) & (c["word_chars"] <= 7 * n), (c["word_chars"] < 2 * n) | (c["word_chars"] > 12 * n)),
        "v_symbols": (c["n_symbols"] * 20 < n, c["n_symbols"] * 5 > n),
        "v_lines": (c["n_dup_lines"] * 10 < lines, (c["n_dup_lines"] * 10 > 3 * lines) & (c["n_dup_lines"] > 2)),
        "v_repeats": (c["n_repeat_words"] * 10 < n, c["n_repeat_words"] * 10 > 3 * n),
        "v_upper": (c["n_upper"] * 10 < alnum, c["n_upper"] * 10 > 3 * alnum),
        "v_variety": (c["n_distinct"] * 3 > n, c["n_distinct"] * 5 < n),
        "v_plain": (c["n_plain"] * 4 > 3 * n, c["n_plain"] * 10 < 6 * n),
        "v_alnum": (c["n_alnum"] * 20 > 19 * chars, c["n_alnum"] * 20 < 17 * chars),
    }


#: The counts' names in FEATURES, and those that rules() wants as 1 at least.
NAMES = tuple(x.split()[0] for x in FEATURES.split(", "))
AT_LEAST_1 = {"n": "n_words", "lines": "n_lines", "alnum": "n_alnum", "chars": "word_chars"}


def with_votes(counts: DataFrame) -> DataFrame:
    c = {k: F.col(k) for k in NAMES} | {k: F.greatest(F.col(v), F.lit(1)) for k, v in AT_LEAST_1.items()}
    return counts.select("*", *(F.when(bad, -1).when(good, 1).otherwise(0).alias(k) for k, (good, bad) in rules(c).items()))


def fit_rules(voted: DataFrame) -> dict:
    """The accuracies from all rows' vote patterns, of which there are at most 3 to the number of rules."""
    names = [c for c in voted.columns if c.startswith("v_")]
    seen = sorted(voted.groupBy(*names).count().collect())  # so that sums do not depend on the order in which tasks end
    patterns = np.array([[r[k] for k in names] for r in seen], dtype=np.int64).reshape(len(seen), len(names))
    return fit_accuracies(patterns, np.array([r["count"] for r in seen], dtype=float)) | {"names": names}


def fit_accuracies(patterns: np.ndarray, weights: np.ndarray, prior: float = 0.8, rounds: int = 200) -> dict:
    """Expectation-maximisation over vote patterns (rows x rules of -1, 0, 1) with row weights.

    Returns the log-odds of the class prior and of each vote. Accuracies have Beta(19, 1) and Beta(5, 5) priors,
    which also fix which class is "good"; abstentions carry no evidence. With no rows the prior alone remains.
    """
    rules = patterns.shape[1]
    hit = np.full(rules, 0.95)  # P(vote good | good, votes): a good text seldom looks bad to any rule
    reject = np.full(rules, 0.5)  # P(vote bad | bad, votes): a bad text looks bad to some rules
    good, bad = patterns == 1, patterns == -1
    share = max(weights.sum() / 1000.0, 1.0)  # prior strength follows the corpus, so that no size behaves differently
    for _ in range(rounds):
        score = math.log(prior / (1 - prior)) + good @ np.log(hit / (1 - reject)) + bad @ np.log((1 - hit) / reject)
        post = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        a, b = weights * post, weights * (1 - post)
        new_hit = (good.T @ a + 19 * share) / ((good | bad).T @ a + 20 * share)
        new_reject = (bad.T @ b + 5 * share) / ((good | bad).T @ b + 10 * share)
        new_prior = (a.sum() + 8 * share) / (weights.sum() + 10 * share)
        moved = max(np.abs(new_hit - hit).max(), np.abs(new_reject - reject).max(), abs(new_prior - prior))
        hit, reject, prior = new_hit, new_reject, new_prior
        if moved < 1e-9:
            break
    return {
        "prior": math.log(prior / (1 - prior)),
        "good": np.log(hit / (1 - reject)).tolist(),
        "bad": np.log((1 - hit) / reject).tolist(),
        "accuracy_good": hit.tolist(),
        "accuracy_bad": reject.tolist(),
        "p_good": prior,
    }


def score_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.1,
    min_words: int = 20, max_repeat_percent: int = 30,
) -> DataFrame:
    """Counts, votes, posterior `p_good` and verdict `kept` for each document.

    Null and empty texts have no words and fail the base rule; repeated ids give one row each; an empty
    table gives an empty result; other columns of docs are ignored, so their names cannot clash.
    A document is kept if it passes the base rule (at least `min_words` words and at most `max_repeat_percent`
    per cent of them inside repeated 8-word windows) and its posterior is at least `threshold`: it goes only where the
    rules make "bad" nine times as likely as "good", as losing a clean document costs more than keeping a poor one.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    counts = ws.store(text_counts(docs, id_col, text_col), "counts")
    voted = with_votes(counts)
    model = fit_rules(voted)
    score = F.lit(model["prior"])
    for k, good, bad in zip(model["names"], model["good"], model["bad"], strict=True):
        score = score + F.when(F.col(k) > 0, good).when(F.col(k) < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("p_good", F.round(1 / (1 + F.exp(-score)), 9))
        .withColumn("kept", ~failed & (F.col("p_good") >= threshold))
    )


def keep_good(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.1, min_words: int = 20, max_repeat_percent: int = 30
) -> DataFrame:
    """The rows of docs whose document score_quality keeps; columns as in docs.

    The texts are counted once for the vote patterns and once more to filter: neither pass moves them.
    """
    model = fit_rules(with_votes(text_counts(docs, id_col, text_col)))
    good, bad = np.array(model["good"]), np.array(model["bad"])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, 4 << 20):
                rows = np.array([count_text(x) for x in as_bytes(part.column(at).cast("string"))], dtype=np.int64)
                c = dict(zip(NAMES, rows.T, strict=True))
                c |= {k: np.maximum(c[v], 1) for k, v in AT_LEAST_1.items()}
                score = np.full(len(rows), model["prior"])
                for (g, b), w_good, w_bad in zip(rules(c).values(), good, bad, strict=True):
                    score += np.where(b, w_bad, np.where(g, w_good, 0.0))
                fine = (c["n_words"] >= min_words) & (c["n_repeat_words"] * 100 <= c["n_words"] * max_repeat_percent)
                p_good = np.round(1 / (1 + np.exp(-score)), 9)
                yield part.filter(pa.array(fine & (p_good >= threshold)))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
