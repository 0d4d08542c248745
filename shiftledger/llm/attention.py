"""A small causal self-attention language model in numpy.

Ids are ranked by frequency; every id has a rank, an embedding and counts of its own, and belongs to a class. The model gives
``p(next) = p(class | context) * p(next | class, previous)``: the second factor is smoothed counts over all training text, the first
is a softmax over classes whose scores are the counted log odds after the previous rank plus what one head of masked
self-attention with relative positions adds. Without attention this is a bigram model.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

RANKS = 1024  # ranks worked on at a time where a table has a line for each
CLASSES = 128
OWN_CLASS = 96  # the most frequent ranks are classes by themselves
WIDTH = 16
WINDOW = 32  # positions that attention sees at once
STRIDE = 16  # of which so many are scored, the others are context scored before
_AT_ONCE = 32  # windows worked on in one go
PROJECTED = 32  # dimensions in which ranks are clustered
_CEILING = 40
_LITTLE = 0.01
_SHORT = 6  # rows of one key that are added one after the other
_DEEP = 256  # rows multiplied at a time where many are summed up: as deep as matrix products stay fast
_F = np.float32
_TABLES = ("query", "key", "value", "gate")  # weights with a row per rank


def _runs(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, those with most rows first, and the sums of the rows of each: by sorted runs, several times faster than numpy's add.at."""
    if not len(keys):
        return keys, rows
    # Short keys sort by radix.
    order = np.argsort(keys.astype(np.uint16) if keys.max() < 1 << 16 else keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    lengths = np.diff(np.append(starts, len(keys)))
    longest = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[longest], lengths[longest]
    longer = np.searchsorted(-lengths, -np.arange(1, _SHORT + 1)).tolist()  # how many runs have more than 1, 2, ... rows
    total = np.take(rows, order[starts], axis=0)
    for depth, many in enumerate(longer[:-1], 1):
        total[:many] += np.take(rows, order[starts[:many] + depth], axis=0)
    if many := longer[-1]:
        rest = lengths[:many] - _SHORT
        begins = np.cumsum(rest) - rest
        at = np.repeat(starts[:many] + _SHORT - begins, rest) + np.arange(rest.sum())
        # Two numbers added at a time: a run costs a call per column, whatever its length, which is why short ones are not added so.
        pairs = np.take(rows, order[at], axis=0).view(np.result_type(rows.dtype, np.complex64))
        total[:many] += np.add.reduceat(pairs, begins, axis=0).view(rows.dtype)
    return keys[starts], total


def projected(previous: np.ndarray, after: np.ndarray, counts: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a part of the distinct pairs: the ranks that follow, and for each what these pairs add to its place among the others."""
    draw = np.random.default_rng(0).normal(size=(ranks, PROJECTED))
    return _runs(after, (np.sqrt(counts + _LITTLE) - np.sqrt(_LITTLE))[:, None] * draw[previous])


def cluster(sums: np.ndarray, single: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A class for every rank: the frequent ones by themselves, the others by the ranks they follow (k-means on a projection, by frequency).

    ``sums`` is what all pairs add up to in ``projected``, ``single`` how often each rank occurs.
    """
    n = len(single)
    own = min(OWN_CLASS, n)
    classes = np.arange(n)
    if own == n:
        return classes
    constant = np.sqrt(_LITTLE) * np.random.default_rng(0).normal(size=(n, PROJECTED)).sum(axis=0)
    points = ((sums + constant) / np.sqrt(single + _LITTLE * n)[:, None])[own:]
    weight = single[own:].astype(float)
    seen = np.flatnonzero(weight)
    many = max(1, min(CLASSES - own, len(seen)))
    centers = points[seen[np.linspace(0, len(seen) - 1, many).astype(int)]] if len(seen) else points[:1]
    for turn in range(rounds + 1):
        near = ((points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)).argmin(axis=1)
        for c in range(many if turn < rounds else 0):
            if weight[near == c].any():
                centers[c] = np.average(points[near == c], axis=0, weights=weight[near == c])
    classes[own:] = own + near
    return classes


@dataclass
class Inside:
    """Natural log probability of a rank given its class and the rank before, asked like a matrix: ``inside[previous, next]``.

    ``pairs`` are codes ``previous * ranks + next``, sorted where it is asked like a matrix; a pair that is not among them was never counted.
    """

    pairs: np.ndarray
    counts: np.ndarray
    share: np.ndarray  # of a rank in its class
    classes: np.ndarray
    by_class: np.ndarray  # [previous, class]: counts

    def __getitem__(self, asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        previous, after = (np.asarray(a).astype(np.int64) for a in asked)
        n = np.zeros(previous.shape)
        if len(self.pairs):
            code = previous * len(self.share) + after
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            n = np.where(self.pairs[at] == code, self.counts[at], 0)
        return self.given(previous, after, n)

    def given(self, previous: np.ndarray, after: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same where it is known how often each pair was counted."""
        return np.log((counts + 2 * self.share[after]) / (self.by_class[previous, self.classes[after]] + 2)).astype(_F)


@dataclass
class Counted:
    """What the model takes from counts; ``inside`` and ``classes_after[previous, class]`` are natural logarithms, ``chances_after`` are what the latter are of."""

    classes: np.ndarray
    inside: Inside
    chance: np.ndarray  # of each class

    def _after(self, of_chances) -> np.ndarray:
        by_class = self.inside.by_class
        found = np.empty(by_class.shape, dtype=_F)
        for i in range(0, len(by_class), RANKS):
            own = by_class[i:i + RANKS].astype(float)
            found[i:i + RANKS] = of_chances((own + 4 * self.chance) / (own.sum(axis=1, keepdims=True) + 4))
        return found

    # Training needs the one, scoring the other.
    @cached_property
    def classes_after(self) -> np.ndarray:
        return self._after(np.log)

    @cached_property
    def chances_after(self) -> np.ndarray:
        return self._after(np.asarray)

    @classmethod
    def of_classes(cls, classes: np.ndarray, single: np.ndarray, by_class: np.ndarray, little: np.ndarray | float = 0.1) -> Counted:
        """From how often each rank occurs, ``little`` added, and how often a class follows it; ``inside`` holds no pair yet."""
        single = single + little
        total = np.bincount(classes, single)
        none = np.empty(0, dtype=np.int64)
        return cls(classes, Inside(none, none, single / total[classes], classes, by_class.astype(_F)), total / total.sum())

    def __reduce__(self) -> tuple:
        """Sent without its zeros and logarithms: a few counts per rank instead of two numbers per rank and class."""
        cells = np.flatnonzero(self.inside.by_class)
        counts, small = self.inside.by_class.ravel()[cells], np.uint32 if self.inside.by_class.size < 1 << 32 else np.int64
        return _unpacked, (self.classes.astype(np.uint8), self.inside.share, self.chance, cells.astype(small), counts)

    @classmethod
    def of(cls, pairs: np.ndarray) -> Counted:
        """``pairs[previous, next]``: how often one rank follows another, for few ranks."""
        n, single = len(pairs), pairs.sum(axis=0)
        previous, after = np.nonzero(pairs)
        sums = np.zeros((n, PROJECTED))
        follow, own = projected(previous, after, pairs[previous, after], n)
        sums[follow] = own
        classes = cluster(sums, single)
        member = np.zeros((n, classes.max() + 1))
        member[np.arange(n), classes] = 1
        counted = cls.of_classes(classes, single, pairs @ member)
        counted.inside.pairs, counted.inside.counts = previous * n + after, pairs[previous, after]
        return counted


def _unpacked(classes: np.ndarray, share: np.ndarray, chance: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> Counted:
    by_class, none = np.zeros((len(classes), len(chance)), dtype=_F), np.empty(0, dtype=np.int64)
    by_class.ravel()[cells] = counts
    classes = classes.astype(np.int64)
    return Counted(classes, Inside(none, none, share, classes, by_class), chance)


def fresh_weights(ranks: int, classes: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(1)
    return {
        "query": draw.normal(0, 0.3, (ranks, WIDTH)).astype(_F), "key": draw.normal(0, 0.3, (ranks, WIDTH)).astype(_F),
        "value": draw.normal(0, 0.3, (ranks, WIDTH)).astype(_F), "gate": np.full((ranks, WIDTH), 0.3, dtype=_F),
        "near": (-0.1 * np.arange(WINDOW)).astype(_F), "out": np.zeros((WIDTH, classes), dtype=_F),
    }


_BACK = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_MASK = np.where(_BACK >= 0, 0, -1e9).astype(_F)


def _packed(w: dict[str, np.ndarray]) -> np.ndarray:
    """The weights with a row per rank side by side, so that a rank's are read and written in one go."""
    return np.concatenate([w[name] for name in _TABLES], axis=1)


def _capped(x: np.ndarray) -> np.ndarray:
    """x with a ceiling, in place. It hardly ever applies, and to look costs a fraction of applying it."""
    if not x.max(initial=-np.inf) <= _CEILING:
        np.minimum(x, _F(_CEILING), out=x)
    return x


def _attend(table: np.ndarray, near: np.ndarray, x: np.ndarray, context: int = 0) -> tuple:
    """For windows of ranks (n x WINDOW): what attention makes of each position but the first ``context``, and what backward needs.

    Of the attention that is its odds and their sums, not the quotients, which no step needs at full length. Sums come once for each dimension,
    so that what is divided by them is as long.
    """
    rows = np.take(table, x, axis=0)
    k, v = rows[:, :, WIDTH:2 * WIDTH], rows[:, :, 2 * WIDTH:3 * WIDTH]
    q, gate = rows[:, context:, :WIDTH], rows[:, context:, 3 * WIDTH:]
    s = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
    s *= _F(WIDTH**-0.5)
    s += (near[np.maximum(_BACK, 0)] + _MASK)[context:]
    # A ceiling instead of the row's maximum, which costs more than all the rest; odds that high do not occur.
    np.exp(_capped(s), out=s)
    o = np.matmul(s, v)
    sums = np.matmul(s.reshape(-1, WINDOW), np.ones((WINDOW, WIDTH), dtype=s.dtype)).reshape(o.shape)
    o /= sums
    h = o + gate
    np.maximum(h, 0, out=h)
    return h, (q, k, v, s, sums, o)


def forward(w: dict[str, np.ndarray], counted: Counted, x: np.ndarray) -> tuple:
    """For windows of ranks (n x WINDOW): log odds of the classes that may follow each position, and what backward needs."""
    h, needed = _attend(_packed(w), w["near"], x)
    return _log_odds(h, w["out"], counted, x), (*needed, h)


def _log_odds(h: np.ndarray, out: np.ndarray, counted: Counted, x: np.ndarray) -> np.ndarray:
    z = np.matmul(h.reshape(-1, WIDTH), out)
    z += np.take(counted.classes_after, x.ravel(), axis=0)
    return z.reshape(*x.shape, -1)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, as a matrix product: several times faster than a reduction of short rows."""
    return np.matmul(x, np.ones(x.shape[-1], dtype=x.dtype))


def log_classes(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of class y at every position; changes z."""
    _capped(z)
    own = z.reshape(-1)[np.arange(y.size) * z.shape[-1] + y.ravel()].reshape(y.shape)
    np.exp(z, out=z)
    return own - np.log(_sums(z))


def _log_chances(h: np.ndarray, out: np.ndarray, most: np.ndarray, counted: Counted, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``log_classes`` of ``_log_odds``. Counted chances are multiplied by odds, not their logarithms added: a pass over all classes less.

    ``most`` are the largest weights of ``out`` by dimension, zero at least: as h is never negative, they bound the odds.
    """
    h = h.reshape(-1, WIDTH)
    if not (h @ most).max(initial=-np.inf) <= _CEILING:
        return log_classes(_log_odds(h, out, counted, x), y)
    odds = np.matmul(h, out)
    chances = np.take(counted.chances_after, x.ravel(), axis=0)
    own = np.arange(y.size) * out.shape[1] + y.ravel()
    log = odds.reshape(-1)[own] + np.log(chances.reshape(-1)[own])
    np.exp(odds, out=odds)
    return (log - np.log(np.einsum("ij,ij->i", odds, chances))).reshape(y.shape)


def gradients(w: dict[str, np.ndarray], counted: Counted, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the positions that count, and its gradient. ``y`` are classes."""
    table = _packed(w)
    loss, used, rows, near, out = _gradients(table, w["near"], w["out"], counted, x, y, counts)
    full = np.zeros_like(table)
    full[used] = rows
    return loss, {**dict(zip(_TABLES, np.split(full, len(_TABLES), axis=1))), "near": near, "out": out}


def _gradients(table: np.ndarray, near: np.ndarray, out: np.ndarray, counted: Counted, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple:
    """The loss, the ranks that occur, the gradient of their rows of the table, and those of ``near`` and ``out``.

    A few windows at a time, so that what is worked on stays near the processor.
    """
    weight = (counts / max(1, int(counts.sum()))).astype(table.dtype)
    rows = np.empty((*x.shape, 4 * WIDTH), dtype=table.dtype)
    loss, d_s, d_out = 0.0, 0, 0
    for i in range(0, len(x), _AT_ONCE):
        own = slice(i, i + _AT_ONCE)
        part = _part_gradients(table, near, out, counted, x[own], y[own], weight[own], rows[own])
        loss, d_s, d_out = loss + part[0], d_s + part[1], d_out + part[2]
    d_near = np.bincount(np.maximum(_BACK, 0).ravel(), weights=(d_s * (_BACK >= 0)).ravel(), minlength=WINDOW)
    used, rows = _runs(x.ravel(), rows.reshape(-1, 4 * WIDTH))
    rows[:, :2 * WIDTH] *= _F(WIDTH**-0.5)  # of queries and keys
    return loss, used, rows, d_near.astype(near.dtype), d_out


def _part_gradients(
    table: np.ndarray, near: np.ndarray, out: np.ndarray, counted: Counted, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """What some windows add to the loss and to the gradients by distance and of ``out``; fills ``rows`` with those of every position's row of the table."""
    h, (q, k, v, s, sums, o) = _attend(table, near, x)
    z = _log_odds(h, out, counted, x)
    flat, weight = _capped(z.reshape(-1, z.shape[2])), weight.ravel()
    own = np.arange(len(flat)) * flat.shape[1] + y.ravel()
    odds = z.reshape(-1)[own]
    np.exp(flat, out=flat)
    total = _sums(flat)
    loss = float(np.dot(np.log(total) - odds, weight))
    # Gradients of z are (flat / total - 1 at the own class) * weight; the factors go where rows are shorter.
    z.reshape(-1)[own] -= total
    weight = (weight / total)[:, None]
    d_out = _summed_products(h.reshape(-1, WIDTH) * weight, flat)
    d_o = flat @ out.T
    d_o *= weight
    d_o = d_o.reshape(h.shape)
    d_o *= h > 0
    rows[:, :, 3 * WIDTH:] = d_o
    # From here on divided by the sums of the attention, which its odds are still to be divided by.
    d_o /= sums
    d_s = np.matmul(d_o, np.ascontiguousarray(v.transpose(0, 2, 1)))
    d_s -= _sums(d_o * o)[..., None]
    d_s *= s
    np.matmul(d_s, k, out=rows[:, :, :WIDTH])
    np.matmul(d_s.transpose(0, 2, 1), q, out=rows[:, :, WIDTH:2 * WIDTH])
    np.matmul(s.transpose(0, 2, 1), d_o, out=rows[:, :, 2 * WIDTH:3 * WIDTH])
    return loss, d_s.sum(axis=0), d_out


def _summed_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left.T @ right`` of many rows."""
    deep = len(left) // _DEEP * _DEEP
    out = left[deep:].T @ right[deep:]
    if deep:
        out += np.matmul(left[:deep].reshape(-1, _DEEP, left.shape[1]).transpose(0, 2, 1), right[:deep].reshape(-1, _DEEP, right.shape[1])).sum(axis=0)
    return out


def _places(begins: np.ndarray, n: int, step: int, context: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin: with each text, and every ``step`` ranks from there, so that none sees two texts.

    With the end of each window's text, and whether it is the text's first window. The texts hold n successors in all.
    """
    ends = np.append(begins[1:], n)
    many = np.maximum(1, -(-(ends - begins - context) // step))
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(begins, many) + nth * step, np.repeat(ends, many), nth == 0


_ONE_TEXT = np.zeros(1, dtype=np.int64)


def windows(ranks: np.ndarray, begins: np.ndarray = _ONE_TEXT) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW + 1 ranks back to back in each text, and which positions have a successor: each of ranks[1:] is one just once.

    ``begins`` are the places of the marks that texts follow. What is behind a text's end is padded with end marks.
    """
    starts, ends, _ = _places(begins, len(ranks) - 1, WINDOW)
    at = starts[:, None] + np.arange(WINDOW + 1)
    inside = at <= ends[:, None]
    return np.where(inside, ranks[np.minimum(at, len(ranks) - 1)], 0).astype("<u4"), inside[:, 1:]


def train(w: dict[str, np.ndarray], counted: Counted, windows: np.ndarray, valid: np.ndarray, rate: float, batch: int = 64, seed: int = 0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One pass of Adam over windows of WINDOW + 1 ranks, in an order shuffled by their content; ``valid`` marks positions with a successor.

    A rank's rows change in the steps that it occurs in. Returns the weights and in how many steps each rank occurred.
    """
    # Weights and Adam's two means, each of one piece: from a part of wider rows, numpy would copy the whole table before it takes some.
    # Weights without a rank fill more rows, which change in every step.
    ranks, many, rest = len(counted.classes), len(w["near"]), np.append(w["near"], w["out"])
    lines = -(-len(rest) // (4 * WIDTH))
    table = np.concatenate([_packed(w), np.zeros((lines, 4 * WIDTH), dtype=_F)])
    first, second = np.zeros_like(table), np.zeros_like(table)
    near, out = np.split(table[ranks:].reshape(-1)[:len(rest)], [many])
    near[:], out[:] = w["near"], w["out"].ravel()
    out = out.reshape(w["out"].shape)
    d_rest = np.zeros(lines * 4 * WIDTH, dtype=_F)
    steps = np.zeros(ranks, dtype=np.int64)
    content = np.zeros(len(windows), dtype=np.uint64)
    for column in windows.T:
        content = content * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64)
    order = np.argsort(content, kind="stable")[np.random.default_rng(seed).permutation(len(windows))]
    for t, i in enumerate(range(0, len(order), batch), 1):
        rows = windows[order[i:i + batch]].astype(np.int64)
        _, used, d_rows, d_rest[:many], d_out = _gradients(table, near, out, counted, rows[:, :-1], counted.classes[rows[:, 1:]], valid[order[i:i + batch]])
        steps[used] += 1
        d_rest[many:len(rest)] = d_out.ravel()
        used = np.append(used, np.arange(ranks, len(table)))
        own = [np.take(a, used, axis=0) for a in (table, first, second)]
        _adam(*own, np.concatenate([d_rows, d_rest.reshape(lines, -1)]), rate, t)
        table[used], first[used], second[used] = own
    return {**dict(zip(_TABLES, np.split(table[:ranks], len(_TABLES), axis=1))), "near": near, "out": out}, steps


def _adam(w: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, rate: float, t: int) -> None:
    """Step t, in place. ``first`` and ``second`` are the means of the gradient and its square, but for constant factors that go where they cost least."""
    first *= _F(0.9)
    first += g
    g *= g
    second *= _F(0.98)
    second += g
    scale = (0.02 / (1 - 0.98**t)) ** 0.5
    root = np.sqrt(second)
    root += _F(1e-8 / scale)
    np.divide(first, root, out=root)
    root *= _F(0.1 * rate / (1 - 0.9**t) / scale)
    w -= root


def score(w: dict[str, np.ndarray], counted: Counted, ranks: np.ndarray, begins: np.ndarray = _ONE_TEXT, which: np.ndarray | None = None, batch: int = 2 * _AT_ONCE) -> np.ndarray:
    """Natural log probability of ranks[1:], each scored once: windows overlap, and all but a text's first score their last STRIDE positions only.

    ``ranks`` holds several texts end on end, each begun by the end mark (rank 0) of the one before; ``begins`` are the places of these marks.
    Windows begin with a text and attention looks back only, so no score depends on another text. ``which`` says which of the counted pairs
    each of ranks[1:] makes with the one before, where these are the pairs that occur, in any order.
    """
    n = len(ranks) - 1
    if n <= 0:
        return np.empty(0, dtype=_F)
    # What depends on two ranks alone is worked out once for all their places.
    size = len(counted.classes)
    if which is None:
        pairs, which = np.unique(ranks[:-1] * size + ranks[1:], return_inverse=True)
        found = counted.inside[pairs // size, pairs % size][which]
    else:
        pairs = counted.inside.pairs
        found = counted.inside.given(pairs // size, pairs % size, counted.inside.counts)[which]
    classes = counted.classes[ranks[1:]]
    context = WINDOW - STRIDE
    starts, ends, first = _places(begins, n, STRIDE, context)
    table, near, out = _packed(w), w["near"], w["out"]
    most = np.maximum(out.max(axis=1), 0)
    for skipped, own in ((0, np.flatnonzero(first)), (context, np.flatnonzero(~first))):
        for i in range(0, len(own), batch):
            some = own[i:i + batch]
            places = starts[some, None] + np.arange(WINDOW)
            x = ranks[np.minimum(places, n - 1)]
            h, _ = _attend(table, near, x, skipped)
            places = places[:, skipped:]
            log = _log_chances(h, out, most, counted, x[:, skipped:], classes[np.minimum(places, n - 1)])
            fresh = places < ends[some, None]
            if fresh.all():
                found[places] += log
            else:
                found[places[fresh]] += log[fresh]
    return found
