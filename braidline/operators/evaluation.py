"""How well labelled sequences agree with a ground truth, by local alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import local_paths, score_matrix

#: The kinds of sequence compared: as given, labelled by slice modes and by section modes,
#: and the two label sequences themselves.
KINDS = ("original", "slice_modes", "section_modes", "slice_labels", "section_labels")


def aligned_shares(truth: list, seq: list) -> tuple[float, float]:
    """Length of the best local path over that of the truth and of the sequence."""
    if not len(truth) or not len(seq):
        return 0.0, 0.0
    found = local_paths(truth, seq, least=1, most=1)
    n = len(found[0]) if found else 0
    return n / len(truth), n / len(seq)


def alignment_shares(seqs: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """``seqs`` (key, kind, s) with ground and seq shares against ``truth`` (key, s): a row
    a sequence, so that each is a step of its own wherever it lies."""

    def run(batches):
        for pdf in batches:
            shares = [aligned_shares(list(a), list(b)) for a, b in zip(pdf.truth, pdf.s)]
            yield pd.DataFrame({key: pdf[key], "kind": pdf.kind, "ground": [g for g, _ in shares], "seq": [q for _, q in shares]})

    both = seqs.select(key, "kind", "s").join(truth.select(key, F.col("s").alias("truth")), key)
    return both.mapInPandas(run, f"{key} long, kind string, ground double, seq double")


def evaluation_means(seqs: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """key and ten means: ground and seq shares of each of the KINDS."""
    shares = alignment_shares(seqs, truth, key)
    means = [F.avg(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in KINDS for c in ("ground", "seq")]
    return shares.groupBy(key).agg(*means)


def overall(means: DataFrame, key: str) -> DataFrame:
    """One row: the number of keys, and each column's mean over them."""
    return means.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means.columns if c != key])


def self_alignment(symbols: list, *, least: int = 2, most: int | None = None) -> list[tuple[int, int]]:
    """Cells (i < j) of a label sequence's diagonal runs of equal labels, at least
    ``least`` long, the longest first up to ``most`` of them: a segment matrix."""
    runs = []
    for shift in range(1, len(symbols)):
        run: list = []
        for i in range(len(symbols) - shift + 1):
            if i + shift < len(symbols) and symbols[i] == symbols[i + shift]:
                run.append((i, i + shift))
            else:
                if len(run) >= least:
                    runs.append(run)
                run = []
    runs.sort(key=lambda r: (-len(r), r[0]))
    return sorted(c for r in runs[:most] for c in r)


def coherent_subset(patterns: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Patterns left when, one by one, the one goes without which the rest is most
    coherent, while that helps: distinct positions of the poorer side times correlation."""
    import numpy as np

    def coherence(some):
        x, y = np.array([c for p in some for c in p], float).T
        r = float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 1.0
        return min(len(set(x)), len(set(y))) * r

    held = list(patterns)
    value = coherence(held) if held else 0.0
    while len(held) > 1:
        rest = [held[:i] + held[i + 1 :] for i in range(len(held))]
        best = max(rest, key=coherence)
        if coherence(best) <= value:
            break
        held, value = best, coherence(best)
    return held


def best_score(a, b) -> float:
    """The best local alignment's score."""
    return float(score_matrix(a, b).max())
