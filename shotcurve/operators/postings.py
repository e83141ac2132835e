"""Impact-ordered posting lists of a block of examples, and exact best matches from bounds.

An example e is a sparse row of gram counts. Its length depends on the case only
through the grams both have, which weigh less ("inside") than others ("outside"); with
all grams inside it is shortest, so with u = count * inside / shortest length and
q = count * inside / length of the case,

    cosine(case, e) <= sum over shared grams of q * u.

A gram's postings are sorted by u. A search reads them from the top, level by level:
at level r all postings with u >= r * q. An example then has a sum A of what was read,
and what was not is at most r * (the case's rest) and, by Cauchy-Schwarz, at most
sqrt(the case's rest * the example's rest). Examples whose bound stays below the k-th
best score known are never scored; the others are scored exactly on their sparse rows.
"""

import sys

import numpy as np
from pyspark import cloudpickle

# searches run in tasks; they travel by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVELS = (1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05, 0.0)
# bounds and scores that differ by less count as equal
MARGIN = 1e-9
# of a dense table of examples
CELLS = 1 << 19


def spans(starts, stops):
    """The whole numbers of all ranges [start, stop), and the length of each range."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes), sizes


class Rows:
    """Examples as sparse rows: bounds (n + 1) into gram codes and counts; pos: their order.

    codes (sorted) and df: the grams of the block and how many of the task's n_examples
    hold them."""

    def __init__(self, bounds, grams, counts, pos, codes, df, n_examples: int):
        self.bounds, self.pos, self.codes, self.n_examples = bounds, pos, codes, n_examples
        self.counts = counts.astype(float)
        self.column = np.searchsorted(codes, grams)
        self.inside, outside = weights(df, n_examples)
        self.num_grams = np.diff(bounds)
        self.row = np.repeat(np.arange(len(pos)), self.num_grams)
        squares = self.counts ** 2
        self.outside_sq = np.bincount(self.row, squares * outside[self.column] ** 2, len(pos))
        self.inside_sq = np.bincount(self.row, squares * self.inside[self.column] ** 2, len(pos))
        self.change = self.inside ** 2 - outside ** 2

    def inside_of(self, grams):
        """What grams of a case weigh, in the block or not."""
        place = np.searchsorted(self.codes, grams)
        known = place < len(self.codes)
        known[known] = self.codes[place[known]] == grams[known]
        out = np.full(len(grams), weights(np.zeros(1), self.n_examples)[0][0])
        out[known] = self.inside[place[known]]
        return out

    def products(self, grams: list, counts: list):
        """(examples x cases) of the dot products with cases, given by grams and counts, and of
        the changes of the examples' squared lengths: products of dense matrices over the
        grams that cases and block share."""
        n, k = len(self.pos), len(grams)
        dot, change = np.zeros((2, n, k))
        if not n or not k:
            return dot, change
        case = np.repeat(np.arange(k), [len(g) for g in grams])
        grams, counts = np.concatenate(grams), np.concatenate(counts)
        column = np.searchsorted(self.codes, grams)
        known = column < len(self.codes)
        known[known] = self.codes[column[known]] == grams[known]
        used, place = np.unique(column[known], return_inverse=True)
        if not len(used):
            return dot, change
        weight, has = np.zeros((2, len(used), k))
        weight[place, case[known]] = counts[known] * self.inside[used[place]] ** 2
        has[place, case[known]] = self.change[used[place]]
        slot = np.full(len(self.codes), -1)
        slot[used] = np.arange(len(used))
        step = max(1, CELLS // len(used))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            own = slice(self.bounds[lo], self.bounds[hi])
            at = slot[self.column[own]]
            met = at >= 0
            table = np.zeros((hi - lo, len(used)))
            table[self.row[own][met] - lo, at[met]] = self.counts[own][met]
            dot[lo:hi] = table @ weight
            change[lo:hi] = np.square(table, out=table) @ has
        return dot, change


class Block(Rows):
    """Rows with posting lists, for a single case at a time."""

    def __init__(self, bounds, grams, counts, pos, codes, df, n_examples: int):
        super().__init__(bounds, grams, counts, pos, codes, df, n_examples)
        row, shortest = self.row, np.sqrt(self.inside_sq)
        u = self.counts * self.inside[self.column] / np.where(shortest > 0, shortest, 1)[row]
        # by gram, then by falling u
        key = self.column + (1 - u) / 2
        order = np.argsort(key)
        self.example, self.u, self.key = row[order], u[order], key[order]
        self.lists = np.searchsorted(self.key, np.arange(len(codes) + 1))
        self.weight, self.shared = np.zeros(len(codes)), np.zeros(len(codes))
        self.scored = 0

    def scores(self, examples):
        """Exact cosines of examples with the case whose weights are set."""
        self.scored += len(examples)
        at, sizes = spans(self.bounds[examples], self.bounds[examples + 1])
        column, counts = self.column[at], self.counts[at]
        row = np.repeat(np.arange(len(examples)), sizes)
        dot = np.bincount(row, counts * self.weight[column], len(examples))
        length = self.outside_sq[examples] + np.bincount(
            row, counts ** 2 * self.change[column] * self.shared[column], len(examples))
        return np.where(dot > 0, dot / np.sqrt(np.where(dot > 0, length, 1)), 0.0)

    def best(self, grams, counts, length_sq: float, k: int):
        """(positions, cosines) of the k best examples, the last on ties: grams and counts of
        a case, and the square of its length."""
        n = len(self.pos)
        column = np.searchsorted(self.codes, grams)
        known = column < len(self.codes)
        known[known] = self.codes[column[known]] == grams[known]
        column, q = column[known], counts[known] * self.inside[column[known]] / np.sqrt(length_sq or 1)
        self.weight[column], self.shared[column] = q * self.inside[column], 1
        read, read_q, read_u = np.zeros((3, n))
        found, values = np.zeros(n, bool), np.full(n, -1.0)
        done, stops, floor = self.lists[column], self.lists[column + 1], 0.0

        def score(examples):
            nonlocal floor
            values[examples] = self.scores(examples)
            found[examples] = True
            if np.count_nonzero(found) >= k:
                floor = np.partition(values[found], -k)[-k]
        for level in LEVELS:
            cut = stops if not level else np.clip(
                np.searchsorted(self.key, column + (1 - np.minimum(level * q, 1)) / 2, "right"), done, stops)
            at, sizes = spans(done, cut)
            example, u, weight = self.example[at], self.u[at], np.repeat(q, sizes)
            read += np.bincount(example, weight * u, n)
            read_q += np.bincount(example, weight ** 2, n)
            read_u += np.bincount(example, u ** 2, n)
            done = cut
            rest = np.maximum(np.sum(q ** 2) - read_q, 0)
            bound = read + np.minimum(level * rest, np.sqrt(rest * np.maximum(1 - read_u, 0)))
            open_ = np.flatnonzero(~found & (bound + MARGIN >= floor) & (read > 0))
            ahead = open_[np.argsort(-read[open_], kind="stable")[:k]]
            score(ahead)
            open_ = np.flatnonzero(~found & (bound + MARGIN >= floor))
            if not level or len(open_) <= k:
                break
        nothing = read[open_] == 0 if not level else np.zeros(len(open_), bool)
        score(open_[~nothing])
        # examples without a shared gram: the last ones stand for all
        none = open_[nothing]
        none = none[np.argsort(-self.pos[none])[:k]]
        values[none], found[none] = 0.0, True
        self.weight[column] = self.shared[column] = 0
        chosen = np.flatnonzero(found)
        return chosen, values[chosen]


def weights(df, n_examples):
    """Weights of grams that df of the examples hold, if the case has them and if not."""
    return (np.log((2 + n_examples) / (2 + df)) + 1, np.log((2 + n_examples) / (1 + df)) + 1)
