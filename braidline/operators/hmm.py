"""Profile hidden Markov models for multiple alignment of symbol sequences."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ProfileOptions:
    """Transition and training parameters; the defaults are the best published ones."""

    match_match: float = 0.999
    delete_insert: float = 0.01
    iterations: int = 1
    edge_inertia: float = 0.8
    emission_inertia: float = 0.8
    pseudocount: float = 0.2
    length: str = "median"
    flanked: bool = False


class ProfileModel:
    """Match states 1..L, insert states 0..L and silent delete states 1..L.

    From position k a match, insert or delete state goes to the insert of k, or the
    match or delete of k + 1. A start is shared evenly among the first three."""

    def __init__(self, length: int, symbols: int, options: ProfileOptions):
        import numpy as np

        self.n, self.symbols, self.options = length, symbols, options
        p, q = options.match_match, options.delete_insert
        #: transitions[k, from, to] with 0 match, 1 insert, 2 delete
        row = np.array([[p, (1 - p) / 2, (1 - p) / 2], [1 / 3, 1 / 3, 1 / 3], [(1 - q) / 2, q, (1 - q) / 2]])
        self.transitions = np.repeat(row[None], length + 1, 0)
        self.transitions[0] = 1 / 3
        last = self.transitions[length]
        last[:, 0], last[:, 2] = 0.0, 0.0
        last[:, 1] = [1 / 3, 1 / 3, 1 / 3]  # what remains is the end
        if options.flanked:
            # symbols before and after the profile cost little, so that a part may align
            self.transitions[0, :, 1], self.transitions[0, :, 0], self.transitions[0, :, 2] = 0.9, 0.05, 0.05
            last[:, 1] = 0.9
        self.emit = np.full((length + 1, symbols), 1 / symbols)
        self.insert = np.full((length + 1, symbols), 1 / symbols)

    def _log(self):
        import numpy as np

        with np.errstate(divide="ignore"):
            return np.log(self.transitions), np.log(self.emit), np.log(self.insert), np.log(np.maximum(1 - self.transitions[self.n].sum(1), 0))

    def viterbi(self, seq) -> tuple[list[int | None], float]:
        """Match position (1-based) or None of each symbol, and the log probability.
        Rows over the sequence are vectors over positions, but for deletes, which chain."""
        import numpy as np

        t, e, ins, end = self._log()
        n, length = self.n, len(seq)
        low = -1e30
        m, i, d = (np.full((length + 1, n + 1), low) for _ in range(3))
        back = np.zeros((3, length + 1, n + 1), "i1")
        m[0, 0] = 0.0
        for r in range(length + 1):
            if r:
                x = seq[r - 1]
                from_i = np.stack([m[r - 1] + t[:, 0, 1], i[r - 1] + t[:, 1, 1], d[r - 1] + t[:, 2, 1]])
                back[1, r] = from_i.argmax(0)
                i[r] = from_i.max(0) + ins[:, x]
                from_m = np.stack([m[r - 1, :-1] + t[:-1, 0, 0], i[r - 1, :-1] + t[:-1, 1, 0], d[r - 1, :-1] + t[:-1, 2, 0]])
                back[0, r, 1:] = from_m.argmax(0)
                m[r, 1:] = from_m.max(0) + e[1:, x]
            for k in range(1, n + 1):
                best = (m[r, k - 1] + t[k - 1, 0, 2], i[r, k - 1] + t[k - 1, 1, 2], d[r, k - 1] + t[k - 1, 2, 2])
                back[2, r, k] = max(range(3), key=best.__getitem__)
                d[r, k] = max(best)
        final = (m[length, n] + end[0], i[length, n] + end[1], d[length, n] + end[2])
        state, r, k = max(range(3), key=final.__getitem__), length, n
        out: list[int | None] = [None] * length
        while r > 0 or k > 0:
            if state == 0 and (r == 0 or k == 0):
                break
            before = int(back[state, r, k])
            if state == 0:
                out[r - 1] = k
                r, k = r - 1, k - 1
            elif state == 1:
                r -= 1
            else:
                k -= 1
            state = before
        return out, float(max(final))

    def expected(self, seqs):
        """Log likelihood, and expected counts of transitions (position, from, to; ``to`` 3
        is the end) and of matched and inserted symbols: forward and backward in log
        space, all sequences at once."""
        import numpy as np

        t, e, ins, end = self._log()
        n, lengths, add, low = self.n, np.array([len(s) for s in seqs]), np.logaddexp, -1e30
        top = int(lengths.max())
        x = np.zeros((top + 2, len(seqs)), int)
        for v, s in enumerate(seqs):
            x[1 : len(s) + 1, v] = s
        # state (match, insert, delete), symbols read, sequence, position
        f = np.full((3, top + 1, len(seqs), n + 1), low)
        f[0, 0, :, 0] = 0.0
        for r in range(top + 1):
            if r:
                p = f[:, r - 1]
                f[1, r] = add(add(p[0] + t[:, 0, 1], p[1] + t[:, 1, 1]), p[2] + t[:, 2, 1]) + ins[:, x[r]].T
                f[0, r, :, 1:] = add(add(p[0, :, :-1] + t[:-1, 0, 0], p[1, :, :-1] + t[:-1, 1, 0]), p[2, :, :-1] + t[:-1, 2, 0]) + e[1:, x[r]].T
            for k in range(1, n + 1):
                f[2, r, :, k] = add(add(f[0, r, :, k - 1] + t[k - 1, 0, 2], f[1, r, :, k - 1] + t[k - 1, 1, 2]), f[2, r, :, k - 1] + t[k - 1, 2, 2])
        at_end = f[:, lengths, np.arange(len(seqs)), n] + end[:, None]
        total = add(add(at_end[0], at_end[1]), at_end[2])
        moves, emit, inserted = np.zeros((n + 1, 3, 4)), np.zeros(self.emit.shape), np.zeros(self.insert.shape)
        moves[n, :, 3] = np.exp(at_end - total).sum(1)
        later = np.full((3, len(seqs), n + 1), low)
        for r in range(top, -1, -1):
            now, more = np.full((3, len(seqs), n + 1), low), (r < lengths)[:, None]
            to_match = np.full((len(seqs), n + 1), low)
            to_match[:, :-1] = np.where(more, e[1:, x[r + 1]].T + later[0, :, 1:], low)
            to_insert = np.where(more, ins[:, x[r + 1]].T + later[1], low)
            for s in range(3):
                now[s] = add(t[:, s, 0] + to_match, t[:, s, 1] + to_insert)
                now[s, r == lengths, n] = add(now[s, r == lengths, n], end[s])
            for k in range(n - 1, -1, -1):
                for s in (2, 0, 1):
                    now[s, :, k] = add(now[s, :, k], t[k, s, 2] + now[2, :, k + 1])
            alive = (r <= lengths)[:, None]
            for s in range(3):
                here = np.where(alive, f[s, r] - total[:, None], low)
                moves[:, s, 0] += np.exp(here + t[:, s, 0] + to_match).sum(0)
                moves[:, s, 1] += np.exp(here + t[:, s, 1] + to_insert).sum(0)
                moves[:-1, s, 2] += np.exp(here[:, :-1] + t[:-1, s, 2] + now[2, :, 1:]).sum(0)
                if r and s < 2:
                    share = np.where(alive, np.exp(here + now[s]), 0.0)
                    np.add.at((emit, inserted)[s].T, x[r], share)
            later = now
        return float(total.sum()), moves, emit, inserted

    def fit(self, seqs, *, at_once: int = 64) -> "ProfileModel":
        """Expectation maximisation of transitions and emissions, with pseudocounts and
        inertia towards what was. Empty sequences teach nothing."""
        import numpy as np

        o, seqs = self.options, [s for s in seqs if len(s)]
        for _ in range(o.iterations if seqs else 0):
            parts = [self.expected(seqs[i : i + at_once]) for i in range(0, len(seqs), at_once)]
            moves, emit, inserted = (sum(p[i] for p in parts) for i in (1, 2, 3))
            old = np.concatenate([self.transitions, 1 - self.transitions.sum(2, keepdims=True)], 2)
            old[np.abs(old) < 1e-12] = 0.0
            moves = moves + o.pseudocount * (old > 0)
            sums = moves.sum(2, keepdims=True)
            new = np.where(sums > 0, moves / np.where(sums > 0, sums, 1), old)
            self.transitions = (o.edge_inertia * old + (1 - o.edge_inertia) * new)[:, :, :3]
            for name, counts in (("emit", emit), ("insert", inserted)):
                counts = counts + o.pseudocount
                sums = counts.sum(1, keepdims=True)
                new = np.where(sums > 0, counts / np.where(sums > 0, sums, 1), 1 / self.symbols)
                setattr(self, name, o.emission_inertia * getattr(self, name) + (1 - o.emission_inertia) * new)
        return self


def profile_length(lengths: list[int], how: str = "median") -> int:
    import numpy as np

    x = np.array(sorted(lengths))
    target = {"median": np.median(x), "mean": x.mean(), "min": x.min(), "max": x.max()}.get(how)
    if target is None:
        target = np.quantile(x, float(how))
    return int(x[np.abs(x - target).argmin()])


def align_versions(seq: DataFrame, options: ProfileOptions = ProfileOptions(), *, key: str = "collection") -> DataFrame:
    """key, version, time, state (match position or null), logp: one model a collection,
    a task each; the symbols' codes are by first appearance within it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["version", "time"])
        codes, _ = pd.factorize(pdf.symbol)
        pdf = pdf.assign(code=codes)
        seqs = {v: g.code.tolist() for v, g in pdf.groupby("version")}
        model = ProfileModel(profile_length([len(s) for s in seqs.values()], options.length), int(codes.max()) + 1, options).fit(seqs.values())
        rows = []
        for v, g in pdf.groupby("version"):
            states, logp = model.viterbi(seqs[v])
            rows += [(pdf[key].iloc[0], v, t, s, logp) for t, s in zip(g.time, states)]
        out = pd.DataFrame(rows, columns=[key, "version", "time", "state", "logp"])
        return out.assign(state=out.state.astype("Int64"))

    return seq.select(key, "version", "time", "symbol").groupBy(key).applyInPandas(run, f"{key} long, version long, time long, state long, logp double")


def states_to_slices(msa: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version, slice, time: a state's first position in each version."""
    return msa.where("state IS NOT NULL").groupBy(*keys, "version", (F.col("state") - 1).alias("slice")).agg(F.min("time").alias("time"))


def slice_edges(part: DataFrame, keys: list[str]) -> DataFrame:
    """Links between all versions in a slice, as edges to the smallest node and on: the
    star's connection counts, not every pair, grow with the slice."""
    w = Window.partitionBy(*keys, "slice").orderBy("version")
    n = part.withColumns({"node": F.concat_ws(".", "version", "time"), "prev": F.lag(F.concat_ws(".", "version", "time")).over(w)})
    return n.where("prev IS NOT NULL").select(*keys, F.col("prev").alias("src"), F.col("node").alias("dst"))


def msa_stats(msa: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matched (share of match states), states_in_most (states that over half of
    the versions reach)."""
    versions = msa.groupBy(*keys).agg(F.countDistinct("version").alias("v"), F.avg(F.col("state").isNotNull().cast("double")).alias("matched"))
    per_state = msa.where("state IS NOT NULL").groupBy(*keys, "state").agg(F.countDistinct("version").alias("n"))
    most = per_state.join(versions, keys).where("n > 0.5 * v").groupBy(*keys).agg(F.count("*").alias("states_in_most"))
    return versions.join(most, keys, "left").select(*keys, F.round("matched", 6).alias("matched"), F.coalesce("states_in_most", F.lit(0)).cast("long").alias("states_in_most"))
