"""Prediction by partial matching over bytes: counts, frozen tables, code lengths.

Texts are byte streams closed by ``END``, a byte that UTF-8 never holds. A context is
the ``order`` bytes before a symbol, or as many of their last bytes as were seen in
training. The escape estimate is method C: a context seen ``n`` times before ``d``
different symbols gives a seen symbol ``count / (n + d)`` and leaves ``d / (n + d)`` to
the next shorter context, which excludes all symbols already judged. Below the empty
context, bytes never seen share what is left evenly.

With frozen counts each (context, symbol) pair has one probability, so the trie is
flattened into a table that a stream of bytes indexes: contexts of up to three bytes
through an array, longer ones through a hash table for each length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

END = 0xFF
ORDER = 3
#: Lengths of context that an array addresses.
DENSE = 3
#: Positions worked on at once.
SLICE = 1 << 18


def stream(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array, where each begins, and how many symbols it codes (its bytes and the end)."""
    gap = bytes([END]) * order
    data = np.frombuffer(gap + b"".join([t + gap for t in texts]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = order + np.concatenate(([0], np.cumsum(sizes + order)[:-1])) if len(texts) else np.zeros(0, np.int64)
    return data, starts, sizes + 1


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    totals = np.zeros(len(codes), np.int64)
    np.add.at(totals, at, np.concatenate([p[1] for p in parts]))
    return codes, totals


_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lookup:
    """Numbers by code: open addressing in a table at most a quarter full."""

    keys: np.ndarray
    values: np.ndarray
    shift: int

    @classmethod
    def of(cls, codes: np.ndarray, values: np.ndarray) -> Lookup:
        bits = max(4, int(4 * len(codes) - 1).bit_length())
        table = cls(np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 64 - bits)
        left, spot = np.arange(len(codes)), table.home(codes)
        while len(left):
            free = table.keys[spot] < 0
            _, first = np.unique(np.where(free, spot, -1 - np.arange(len(spot))), return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            table.keys[spot[won]], table.values[spot[won]] = codes[left[won]], values[left[won]]
            left, spot = left[~won], (spot[~won] + 1) & (len(table.keys) - 1)
        return table

    def home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * _ODD) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, codes: np.ndarray, default: np.ndarray) -> np.ndarray:
        spot = self.home(codes)
        held = self.keys[spot]
        out = np.where(held == codes, self.values[spot], default)
        left = np.flatnonzero((held != codes) & (held >= 0))
        spot = spot[left]
        while len(left):
            spot = (spot + 1) & (len(self.keys) - 1)
            held = self.keys[spot]
            hit = held == codes[left]
            out[left[hit]] = self.values[spot[hit]]
            on = ~hit & (held >= 0)
            left, spot = left[on], spot[on]
        return out


@dataclass
class Frozen:
    """``costs[context * symbols + symbol]``: code lengths in nats, one column per model.

    ``context_of`` numbers contexts of up to ``DENSE`` symbols by their code, ``deep``
    those of each greater length.
    """

    classes: np.ndarray
    context_of: np.ndarray
    costs: np.ndarray
    order: int
    deep: tuple[Lookup, ...] = ()

    @property
    def symbols(self) -> int:
        return int(self.classes.max()) + 1


def levels_of(codes: np.ndarray, counts: np.ndarray, order: int = ORDER, max_contexts: int = 1 << 15) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of (context, symbol) codes for each context length, at most ``max_contexts`` contexts of each, by count."""
    out = []
    for length in range(order + 1):
        low, at = np.unique(codes % (1 << 8 * (length + 1)), return_inverse=True)
        n = np.bincount(at, counts, len(low)) if len(low) else np.zeros(0)
        contexts, of = np.unique(low >> 8, return_inverse=True)
        if len(contexts) > max_contexts:
            kept = np.zeros(len(contexts), bool)
            kept[np.lexsort((contexts, -np.bincount(of, n)))[:max_contexts]] = True
            low, n = low[kept[of]], n[kept[of]]
        out.append((low, n))
    return out


def freeze(levels: list[tuple[np.ndarray, np.ndarray]], seen: np.ndarray, order: int = ORDER) -> Frozen:
    """The table of one model.

    ``levels``: for each context length, codes of context bytes and a symbol, with
    counts. ``seen``: the byte values that get a symbol of their own; one more symbol
    stands for each of the others. A context that has no counts of its own is coded by
    its longest suffix that has.
    """
    unseen = len(seen)
    classes = np.full(256, unseen, np.int64)
    classes[seen] = np.arange(unseen)
    width = unseen + 1
    total = np.bincount(classes[levels[0][0]], levels[0][1], width) if len(levels[0][0]) else np.zeros(width)
    held, n = total > 0, total.sum()
    d = held.sum()
    left = 256 - int(d)
    # escapes[c, s]: how the contexts shorter than c share what c leaves to symbols it has not seen
    escapes = np.where(held, 0.0, 1.0 / max(1, left))[None, :]
    out = d if left else 0
    def cost(probability: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(probability, 1e-300)).astype(np.float32).reshape(-1, width)

    table = [cost(np.where(held, total / max(1, n + out), out / (n + out) * escapes if n else escapes))]
    tally, names = total[None, :], np.zeros(1, np.int64)
    dense = min(order, DENSE)
    context_of = np.zeros(width**dense, np.int32)
    deep = []
    offset = 1
    for length in range(1, order + 1):
        codes, counts = levels[length]
        key = np.zeros(len(codes), np.int64)
        for back in range(length, 0, -1):
            key = key * width + classes[(codes >> (8 * back)) & 255]
        symbol = classes[codes & 255]
        short = key % width ** (length - 1)
        spot = np.minimum(np.searchsorted(names, short), max(0, len(names) - 1))
        known = names[spot] == short if len(names) else np.zeros(len(key), bool)
        key, symbol, counts = key[known], symbol[known], counts[known]
        found, at = np.unique(key, return_inverse=True)
        here = np.bincount(at * width + symbol, counts, len(found) * width).reshape(len(found), width)
        parent = np.searchsorted(names, found % width ** (length - 1))
        held, n = here > 0, here.sum(axis=1, keepdims=True)
        d = held.sum(axis=1, keepdims=True)
        rest = np.where(held, 0.0, tally[parent])
        n2 = rest.sum(axis=1, keepdims=True)
        d2 = (rest > 0).sum(axis=1, keepdims=True)
        share = np.divide(d2, n2 + d2, out=np.ones_like(n2), where=n2 > 0)
        shorter = escapes[parent]
        shorter *= share
        np.divide(rest, np.maximum(n2 + d2, 1), out=shorter, where=rest > 0)
        shorter[held] = 0.0
        escapes = shorter
        del rest
        table.append(cost(np.where(held, here / np.maximum(n + d, 1), d / np.maximum(n + d, 1) * escapes)))
        tally, names = here, found
        numbers = offset + np.arange(len(found), dtype=np.int32)
        if length <= dense:
            context_of.reshape(-1, width**length)[:, found] = numbers
        else:
            deep.append(Lookup.of(found, numbers))
        offset += len(found)
    return Frozen(classes, context_of, np.concatenate(table).reshape(-1, 1), order, tuple(deep))


def combined(models: list[Frozen]) -> Frozen:
    """Several models of the same symbols, and of at most ``DENSE`` order, as one table with a column each."""
    width = models[0].symbols
    joint = np.zeros(len(models[0].context_of), np.int64)
    firsts = np.zeros(1, np.int64)
    for model in models:
        pair = joint * (int(model.context_of.max()) + 1) + model.context_of
        _, firsts, joint = np.unique(pair, return_index=True, return_inverse=True)
    columns = [m.costs.reshape(-1, width)[m.context_of[firsts]] for m in models]
    costs = np.stack(columns, axis=-1).reshape(-1, len(models))
    return Frozen(models[0].classes, joint.astype(np.int32), costs, models[0].order)


def code_lengths(model: Frozen, texts: list[bytes]) -> np.ndarray:
    """Nats that each model needs for each text, its end included: (texts, models)."""
    if not texts:
        return np.zeros((0, model.costs.shape[1]))
    data, starts, sizes = stream(texts, model.order)
    symbols, width, order = model.classes[data], model.symbols, model.order
    ends = starts + sizes
    out = np.zeros((len(texts), model.costs.shape[1]))
    for at in range(order, len(data), SLICE):
        stop = min(at + SLICE, len(data))
        dense = min(order, DENSE)
        code = symbols[at - dense:stop - dense].astype(np.int64)
        for back in range(dense - 1, 0, -1):
            code = code * width + symbols[at - back:stop - back]
        context = model.context_of[code]
        for length, table in enumerate(model.deep, dense + 1):
            code += symbols[at - length:stop - length] * width ** (length - 1)
            context = table.find(code, context)
        index = context.astype(np.int64) * width + symbols[at:stop]
        first = int(np.searchsorted(ends, at, side="right"))
        last = int(np.searchsorted(starts, stop, side="left"))
        if first >= last:
            continue
        low = np.clip(starts[first:last], at, stop) - at
        high = np.clip(ends[first:last], at, stop) - at
        bounds = np.stack([low, high], axis=1).reshape(-1)
        for column in range(model.costs.shape[1]):
            cost = np.append(model.costs[index, column], np.float32(0)).astype(np.float64)
            sums = np.add.reduceat(cost, bounds)[::2]
            out[first:last, column] += np.where(high > low, sums, 0.0)
    return out


def gram_counts(chunks: Iterator[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all texts of a task, merged as they come."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for texts in chunks:
        data, starts, sizes = stream(texts, order)
        word = np.uint32 if order <= 3 else np.uint64
        code = np.zeros(len(data) - order, word)
        for back in range(order, -1, -1):
            code = (code << word(8)) | data[order - back:len(data) - back]
        # Symbols are the bytes of a text and the first END behind it.
        coded = np.ones(len(code), bool)
        for pad in range(1, order):
            coded[(starts + sizes - 1 + pad - order)[starts + sizes - 1 + pad - order < len(code)]] = False
        parts.append(np.unique(code[coded], return_counts=True))
        if len(parts) > 16:
            parts = [merged(parts)]
    return merged(parts) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
