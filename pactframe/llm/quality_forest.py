"""Quality rules over word and line statistics, judged by an isolation forest.

Every document gets the statistics of a few writing rules.  Trees of random
splits are grown over a small sample of distinct statistics, as the method
prescribes; documents that such splits isolate after few steps are unusual.
The score above which a document goes is set from labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pactframe.llm.common import extended, map_batches, raw, without
from pactframe.sources.tables import stored

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no character
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_adjacent")
WINDOW = 5
# Rate of each rule that any text may have, and the rate from which it counts fully.
ALLOWANCE = {
    "symbols": (0.1, 0.5), "marks": (0.3, 1.0), "lines": (0.3, 0.9), "repeats": (0.2, 0.9),
    "upper": (0.3, 0.8), "digits": (0.25, 0.8), "adjacent": (0.1, 0.5),
}
TREES = 128
SAMPLE = 256  # rows per tree
SCORE_STEPS = 2000


# ------------------------------------------------------------ statistics


def repeated_words(codes: np.ndarray, kinds: int) -> int:
    """Words inside a run of WINDOW words that occurs at least twice."""
    n = len(codes) - WINDOW + 1
    if n < 2 or kinds == len(codes):
        return 0
    if kinds ** WINDOW < 2**63:
        runs = codes[:n].copy()
        for k in range(1, WINDOW):
            runs = runs * kinds + codes[k : k + n]
    else:
        pairs = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)[1]
        fours = np.unique(pairs[:-2] * len(codes) + pairs[2:], return_inverse=True)[1]
        runs = fours[:n] * kinds + codes[WINDOW - 1 :]
    order = np.sort(runs)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(runs, twice)
    covered = np.zeros(len(codes), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= again
    return int(covered.sum())


def text_statistics(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS and EXTRA for one UTF-8 text."""
    words = text.split()
    n = len(words)
    points = len(text.translate(None, CONTINUATION))
    space = len(text) - len(text.translate(None, b" \t\n\v\f\r"))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if not line.strip():
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
    names = dict.fromkeys(words)
    names = dict(zip(names, range(len(names))))
    codes = np.fromiter(map(names.__getitem__, words), np.int64, n)
    adjacent = int((codes[1:] == codes[:-1]).sum()) if n > 1 else 0

    def among(chars: bytes) -> int:
        return len(text) - len(text.translate(None, chars))

    return (
        n, points - space, among(SYMBOLS), dup, repeated_words(codes, len(names)),
        lines, among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among(b"0123456789"), among(b"!?"), adjacent,
    )


def rule_statistics(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with the statistics of their text; same-named input columns are replaced.

    A null or empty text has zero everywhere.  No shuffle.
    """
    names = COUNTS + EXTRA
    rows = docs.withColumn("__raw", raw(text))
    kept = without(rows, *names, "__raw", *([] if keep_text else [text]))
    fields = kept.schema.names

    def start():
        def step(batch):
            values = [text_statistics(t) for t in batch.column("__raw").to_pylist()]
            columns = [batch.column(c) for c in fields]
            columns += [pa.array(list(v), pa.int64()) for v in zip(*values)]
            return pa.RecordBatch.from_arrays(columns, names=[*fields, *names])

        return step

    return map_batches(rows.select("__raw", *fields), start, extended(kept, **dict.fromkeys(names, "long")))


# ---------------------------------------------------------------- forest


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """How far a text exceeds each rule's allowance, from 0 to 1.

    None depends on the length or the language; short texts are drawn towards
    zero by the constant in each divisor.  Within the allowances every text is
    the same point, so ordinary variation isolates nobody.
    """
    c = {k: v.astype(float) for k, v in counts.items()}
    words, chars = c["n_words"] + 10, c["word_chars"] + 50
    rates = {
        "symbols": c["n_symbols"] / words,
        "marks": c["n_marks"] / words,
        "lines": c["n_dup_lines"] / (c["n_lines"] + 4),
        "repeats": c["n_repeat_words"] / words,
        "upper": c["n_upper"] / chars,
        "digits": c["n_digits"] / chars,
        "adjacent": c["n_adjacent"] / words,
    }
    return np.stack([np.clip((rates[r] - low) / (high - low), 0, 1) for r, (low, high) in ALLOWANCE.items()], axis=1)


def usual_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """One tree as arrays: feature (-1 at a leaf), cut, left, right, path length at a leaf."""
    feature, cut, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        feature.append(-1), cut.append(0.0), left.append(at), right.append(at), depth.append(0.0)
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(open_):
            depth[at] = level + usual_depth(len(rows))
            return at
        f = int(rng.choice(open_))
        x = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] < x
        if not below.any():
            below = rows[:, f] <= low[f]
        feature[at], cut[at] = f, x
        left[at] = node(rows[below], level + 1)
        right[at] = node(rows[~below], level + 1)
        return at

    node(points, 0)
    return tuple(np.array(a) for a in (feature, cut, left, right, depth))


def grow_forest(points: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> tuple[list, int]:
    """Trees over random subsets of the given rows, and the size of those; none without rows."""
    if not len(points):
        return [], 0
    rng = np.random.default_rng(seed)
    size = min(sample, len(points))
    limit = int(np.ceil(np.log2(max(size, 2))))
    return [grow(points[rng.choice(len(points), size, replace=False)], rng, limit) for _ in range(trees)], size


def anomaly_scores(forest, points: np.ndarray) -> np.ndarray:
    """Between 0 and 1; close to 1 for points that are isolated early."""
    trees, size = forest
    if not trees or not len(points):
        return np.zeros(len(points))
    total = np.zeros(len(points))
    rows = np.arange(len(points))
    for feature, cut, left, right, depth in trees:
        at = np.zeros(len(points), np.int64)
        while True:
            f = feature[at]
            if (f < 0).all():
                break
            at = np.where(f < 0, at, np.where(points[rows, f] < cut[at], left[at], right[at]))
        total += depth[at]
    return 2.0 ** (-total / len(trees) / max(usual_depth(size), 1e-9))


def fit_forest(statistics: DataFrame, trees: int = TREES, sample: int = SAMPLE):
    """A forest over at most ``trees * sample`` distinct statistics, chosen by hash.

    Copies of a text have one statistic, so a large group of copies cannot
    make its own kind usual.  The bound is the method's own subsample.
    """
    names = COUNTS + EXTRA
    most = trees * sample
    kinds = stored(statistics.select(*names).distinct().withColumn("place", F.xxhash64(*names) / F.lit(2.0**64) + 0.5), "statistic-kinds")
    # the first places of all; the bound on the place lets each task send a share of them only
    part = 2 * most / max(kinds.count(), 1)
    rows = kinds.where(F.col("place") < part).orderBy("place", *names).limit(most).toPandas()
    return grow_forest(features({c: rows[c].to_numpy() for c in names}), trees, sample)


def add_scores(statistics: DataFrame, forest) -> DataFrame:
    kept = without(statistics, "score")
    fields = kept.schema.names
    names = COUNTS + EXTRA

    def start():
        def step(batch):
            counts = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            score = anomaly_scores(forest, features(counts))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(score)], names=[*fields, "score"])

        return step

    return map_batches(kept, start, extended(kept, score="double"))


def calibrate(scored: DataFrame, labels: DataFrame, key: str, max_good_lost: float) -> float:
    """The lowest score above which documents go, from all labelled rows that pass the base rules.

    At most ``max_good_lost`` of the good rows lie above it, and among the rows
    in every step above it the bad ones are in the majority.  Without bad or
    good rows nothing goes.  Scores are compared in steps of 1/SCORE_STEPS.
    """
    marks = labels.where("quality in (0, 1)").groupBy(key).agg(F.min("quality").alias("quality"))
    steps = (
        scored.where("not base_failed").select(key, F.floor(F.col("score") * SCORE_STEPS).cast("int").alias("step"))
        .join(marks, key).groupBy("step").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        .orderBy(F.desc("step")).collect()
    )
    good = sum(r.good for r in steps)
    if not good or not sum(r.bad for r in steps):
        return float("inf")
    lost = caught = 0
    limit = float("inf")
    for r in steps:
        lost += r.good
        caught += r.bad
        if lost > max_good_lost * good or lost > caught:
            break
        if r.bad:
            limit = r.step / SCORE_STEPS
    return limit


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_good_lost: float = 0.003,
          trees: int = TREES, sample: int = SAMPLE, keep_text: bool = True) -> DataFrame:
    """The rows with their rule statistics, anomaly score, base rule and verdict.

    ``base_failed``: under ten words, or over a fifth of the words in repeated
    five-word runs.  ``kept``: neither that nor a score at or above the limit.
    ``labels`` has ``key`` and quality 1 (good) or 0.  Null and empty texts
    fail the base rule; repeated rows are judged alike; an empty table gives an
    empty result.  Same-named input columns are replaced.
    """
    rows = stored(rule_statistics(without(docs, "score", "base_failed", "kept"), text, keep_text), "rule-statistics")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    scored = add_scores(rows, fit_forest(rows.where("not base_failed"), trees, sample))
    limit = calibrate(scored, labels, key, max_good_lost)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(limit)))
