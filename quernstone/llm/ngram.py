"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a character model of order ``ORDER`` with interpolated Kneser-Ney smoothing, over counts of all n-grams of
all texts. Symbols are the code points of the lower-cased text, each its own; 0 stands before a text, 1 ends it, and the
characters U+0000 and U+0001 are symbols behind all code points. An n-gram of symbols below ``SYMBOLS`` is one integer of
``BITS`` bits a symbol (narrow); one with a higher symbol is a string of ``BYTES`` bytes a symbol (wide). A model is wide as a
whole where any of its n-grams is. Its alphabet has ``SYMBOLS`` symbols if narrow, else ``ALL``; a symbol that no text of
the corpus has is unseen, never another's.

Level k of the trie holds all k-grams in the order of their symbols. A node's children are a range of the next level;
the ranges' starts are the monotone pointers, kept in Elias-Fano form. A node's symbols become monotone over the whole
level by adding the last value of the range before; the level's symbols are kept in Elias-Fano form too, and a child is
found by searching the successor of its symbol, relative to its context, with select over the zeros of the high bits.
Log probabilities and back-off weights are 8-bit codes into a table of quantiles for each level. Every array is a file of
the shared folder that executors map into memory.

Counting is combined within a task, and again by range of a hash; the model is put together on the driver, which holds
the distinct n-grams once, several times that while sorting. A scoring task remembers the n-grams that it has looked up.

Defined results: a null or empty text is scored as its end alone (1 symbol); very long texts are counted and scored whole; repeated
rows count as often as they occur and get equal scores, as do equal texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import checkpointed, code_points, map_rows, shared_files, text_groups

ORDER, SYMBOLS, BITS = 5, 4096, 12
#: All code points and the two characters whose code points have another meaning; bytes of a symbol of a wide n-gram.
ALL, BYTES = 0x110002, 3
_MASK = np.uint64((1 << (BITS * ORDER)) - 1)


# ---- Elias-Fano sequences ----


class EliasFano:
    """A non-decreasing sequence of n integers below ``universe``: l low bits each, and the high parts in unary.

    The high bits come with the number of ones before each block of 8 words, and with the block of every 512th zero: an eighth
    and less of their size. A search reads a few places of these files, never a whole one.
    """

    WORDS, SAMPLE = 8, 512

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.rank, self.zeros = n, low_bits, low, high, rank, zeros

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        l = max(0, (universe // max(n, 1)).bit_length() - 1)  # noqa: E741
        low = np.zeros((n * l + 63) // 64 + 2, np.uint64)
        if l and n:
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, shift, x = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63), v & np.uint64((1 << l) - 1)
            np.bitwise_or.at(low, word, x << shift)
            over = (shift + np.uint64(l)) > 64
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
        block = 64 * EliasFano.WORDS
        size = n + int(universe >> l) + 2
        bits = np.zeros(-(-size // block) * block, np.uint8)
        bits[(v >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, EliasFano.WORDS).sum(1, dtype=np.int64))])
        before = np.arange(len(rank), dtype=np.int64) * block - rank
        zeros = np.searchsorted(before, np.arange(0, before[-1], EliasFano.SAMPLE), "right") - 1
        return EliasFano(n, l, low, high, rank, np.concatenate([zeros, [len(rank) - 2]]))

    def save(self, path: str) -> None:
        np.save(f"{path}.meta.npy", np.array([self.n, self.l]))
        for name in ("low", "high", "rank", "zeros"):
            np.save(f"{path}.{name}.npy", getattr(self, name))

    @staticmethod
    def load(path: str) -> EliasFano:
        n, l = np.load(f"{path}.meta.npy").tolist()  # noqa: E741
        return EliasFano(n, l, *(np.load(f"{path}.{x}.npy", mmap_mode="r") for x in ("low", "high", "rank", "zeros")))

    @staticmethod
    def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Position of the one number ``rank`` of each word, by halving."""
        at = np.zeros(len(word), np.int64)
        rank = rank.astype(np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = word >> at.astype(np.uint64) & np.uint64((1 << width) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            up = rank >= count
            rank -= np.where(up, count, 0)
            at += np.where(up, width, 0)
        return at

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        x |= np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, 1)), 0).astype(np.uint64)
        return (x & np.uint64((1 << self.l) - 1)).astype(np.int64)

    def _select(self, block: np.ndarray, nth: np.ndarray, flip: bool) -> np.ndarray:
        """Positions of one (or, flipped, zero) number ``nth`` of each block."""
        words = self.high[block[:, None] * self.WORDS + np.arange(self.WORDS)]
        words = ~words if flip else words
        until = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (until <= nth[:, None]).sum(1)
        rows = np.arange(len(block))
        before = np.where(word > 0, until[rows, np.maximum(word - 1, 0)], 0)
        return (block * self.WORDS + word) * 64 + self._in_word(words[rows, word], nth - before)

    def access(self, i: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.rank, i, "right") - 1
        at = self._select(block, i - self.rank[block], False)
        return (at - i) << self.l | self._lows(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of zero number k of the high bits."""
        size = 64 * self.WORDS
        low, high = self.zeros[k // self.SAMPLE].astype(np.int64), self.zeros[k // self.SAMPLE + 1].astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            right = mid * size - self.rank[mid] <= k
            low, high = np.where(right, mid, low), np.where(right, high, mid - 1)
        return self._select(low, k - (low * size - self.rank[low]), True)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value of at least x in [begin, end) (end if none) and the value there."""
        h, low = x >> self.l, x & ((1 << self.l) - 1)
        first = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)  # how many values have a smaller high part
        last = self._zero(h) - h
        i = np.clip(first, begin, end)
        stop = np.minimum(last, end)
        going = np.flatnonzero(i < stop)
        while len(going):
            going = going[self._lows(i[going]) < low[going]]
            i[going] += 1
            going = going[i[going] < stop[going]]
        value = np.full(len(x), -1, np.int64)
        ok = i < end
        value[ok] = self.access(i[ok])
        return i, value


# ---- counts ----


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each ended by 1, and the text of each."""
    codes, doc = code_points([t.lower() if t else "" for t in texts])
    ends = np.flatnonzero(np.diff(doc, append=len(texts)))
    s = np.where(codes < 2, codes + np.uint32(ALL - 2), codes).astype(np.uint64)
    s[ends] = 1
    return s, doc


def _windows(s: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
    """The symbols themselves, those one back in the same text, and so on; 0 before a text."""
    yield s
    for back in range(1, ORDER):
        before = np.zeros_like(s)
        before[back:] = np.where(doc[back:] == doc[:-back], s[:-back], np.uint64(0)) if len(s) > back else 0
        yield before


def _narrow_keys(s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    key = np.zeros_like(s)
    for back, x in enumerate(_windows(s, doc)):
        key |= x << np.uint64(BITS * back)
    return key


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """Wide n-grams of their symbols, first symbol first; they sort like the symbols."""
    out = np.empty((len(columns[0]), BYTES * len(columns)), np.uint8)
    for k, x in enumerate(columns):
        for byte in range(BYTES):
            out[:, BYTES * k + byte] = x >> np.uint64(8 * (BYTES - 1 - byte)) & np.uint64(255)
    return out.view(f"S{out.shape[1]}").ravel()


def widened(keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Narrow n-grams as wide ones, in the same order."""
    return _packed([keys >> np.uint64(BITS * (order - 1 - k)) & np.uint64(SYMBOLS - 1) for k in range(order)])


def gram_keys(texts: list, wide: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts the n-gram that it ends (the first symbol highest), and its text; narrow only where all symbols are."""
    s, doc = symbols(texts)
    if wide is None:
        wide = bool((s >= SYMBOLS).any())
    return (_packed([*_windows(s, doc)][::-1]) if wide else _narrow_keys(s, doc)), doc


def split_keys(texts: list) -> list[np.ndarray]:
    """The n-grams of the texts: those of low symbols narrow, and if there are others, those wide."""
    s, doc = symbols(texts)
    high = s >= SYMBOLS
    if not high.any():
        return [_narrow_keys(s, doc)]
    near = high.copy()
    for back in range(1, ORDER):
        near[back:] |= high[:-back] & (doc[back:] == doc[:-back])
    return [_narrow_keys(s, doc)[~near], _packed([x[near] for x in _windows(s, doc)][::-1])]


def _first(keys: np.ndarray, order: int, k: int) -> np.ndarray:
    """The first k symbols of n-grams of ``order`` symbols."""
    if keys.dtype == np.uint64:
        return keys >> np.uint64(BITS * (order - k))
    return _bytes(keys, 0, BYTES * k)


def _last(keys: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols of n-grams."""
    if keys.dtype == np.uint64:
        return keys & np.uint64((1 << (BITS * k)) - 1)
    return _bytes(keys, keys.dtype.itemsize - BYTES * k, keys.dtype.itemsize)


def _bytes(keys: np.ndarray, begin: int, end: int) -> np.ndarray:
    if begin == end:
        return np.zeros(len(keys), np.uint64)
    own = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), keys.dtype.itemsize)[:, begin:end]
    return np.ascontiguousarray(own).view(f"S{end - begin}").ravel()


def _symbol(keys: np.ndarray) -> np.ndarray:
    """The last symbol of n-grams."""
    if keys.dtype == np.uint64:
        return (keys & np.uint64(SYMBOLS - 1)).astype(np.int64)
    own = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), keys.dtype.itemsize)[:, -BYTES:].astype(np.int64)
    return own[:, 0] << 16 | own[:, 1] << 8 | own[:, 2]


def _mixed(keys: np.ndarray) -> np.ndarray:
    """64 bits of each n-gram; different n-grams may share them if wide."""
    if keys.dtype == np.uint64:
        return keys
    own = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), keys.dtype.itemsize)
    out = np.zeros(len(keys), np.uint64)
    for k in range(own.shape[1] // BYTES):
        x = own[:, BYTES * k : BYTES * k + BYTES].astype(np.uint64)
        out = (out ^ (x[:, 0] << np.uint64(16) | x[:, 1] << np.uint64(8) | x[:, 2])) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mixed(keys) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _from(keys: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(keys, f"S{BYTES * ORDER}" if wide else np.uint64)


def counts(docs: DataFrame) -> DataFrame:
    """(bucket, wide, keys, counts): the counts of all n-grams, sorted arrays in binary, each n-gram in one row of one bucket."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for f in frames:
            texts = [t if isinstance(t, str) else "" for t in f["text"]]
            for a, b in text_groups(texts):
                for parts, keys in zip(both, split_keys(texts[a:b])):
                    keys = np.sort(keys)
                    starts = _runs(keys)
                    parts.append((keys[starts], np.diff(starts, append=len(keys))))
                    if sum(len(k) for k, _ in parts[1:]) > max(2_000_000, len(parts[0][0])):
                        parts[:] = [_merge(parts)]
        for wide, parts in enumerate(both):
            if not parts:
                continue
            keys, n = _merge(parts)
            bucket = _spread(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[k] : cuts[k + 1]]
                yield pd.DataFrame({"bucket": [int(k)], "wide": [bool(wide)], "keys": [keys[at].tobytes()], "counts": [n[at].astype(np.int64).tobytes()]})

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        for f in frames:
            for k, wide, keys, n in f.itertuples(index=False):
                parts = held.setdefault((k, wide), [])
                parts.append((_from(keys, wide), np.frombuffer(n, np.int64)))
                if len(parts) > 16:
                    held[k, wide] = [_merge(parts)]
        for (k, wide), parts in held.items():
            keys, n = _merge(parts)
            yield pd.DataFrame({"bucket": [k], "wide": [wide], "keys": [keys.tobytes()], "counts": [n.tobytes()]})

    schema = "bucket int, wide boolean, keys binary, counts binary"
    return docs.select("text").mapInPandas(count, schema).repartition("bucket").mapInPandas(total, schema)


# ---- model ----


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and the table of the mean of each of up to 256 quantile bins."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 257)[1:-1], method="nearest"))
    code = np.searchsorted(edges, x, "left")
    n = np.bincount(code, minlength=len(edges) + 1)
    table = np.bincount(code, x, len(edges) + 1) / np.maximum(n, 1)
    return code.astype(np.uint8), table.astype(np.float32)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def alphabet(keys: np.ndarray) -> int:
    return SYMBOLS if keys.dtype == np.uint64 else ALL


def smoothed(keys: np.ndarray, n: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """The log back-off weight of the empty context, and for each order from 1: (sorted k-grams, log probability, k-grams that are contexts, their log back-off weights)."""
    grams: list[np.ndarray] = [keys[:0]] * (ORDER + 1)
    used: list[np.ndarray] = [np.zeros(0)] * (ORDER + 1)
    grams[ORDER], used[ORDER] = keys, n.astype(np.float64)
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols stand before
        suffix = np.sort(_last(grams[k + 1], k))
        starts = _runs(suffix)
        grams[k], used[k] = suffix[starts], np.diff(starts, append=len(suffix)).astype(np.float64)
    out = []
    lower = np.zeros(0)
    for k in range(1, ORDER + 1):
        g, c = grams[k], used[k]
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = _first(g, k, k - 1)
        starts = _runs(context)
        sums, kinds = np.add.reduceat(c, starts), np.diff(starts, append=len(g))
        which = np.repeat(np.arange(len(starts)), kinds)
        weight = discount * kinds / sums
        below = np.full(len(g), 1 / alphabet(keys)) if k == 1 else lower[np.searchsorted(grams[k - 1], _last(g, k - 1))]
        p = np.maximum(c - discount, 0) / sums[which] + weight[which] * below
        out.append((g, np.log(p), context[starts], np.log(weight)))
        lower = p
    return float(out[0][3][0]), [(g, p, *out[k + 1][2:]) if k + 1 < len(out) else (g, p, g[:0], np.zeros(0)) for k, (g, p, _, _) in enumerate(out)]


def write_model(keys: np.ndarray, n: np.ndarray, path: str) -> None:
    """Trie files for sorted distinct ORDER-grams and their counts."""
    root, levels = smoothed(keys, n)
    size = alphabet(keys)
    np.save(f"{path}/root.npy", np.array(root))
    np.save(f"{path}/alphabet.npy", np.array(size))
    # A context of nothing but starts ends no n-gram; as a node it has no probability of its own.
    nodes = []
    for k, (g, p, ctx, w) in enumerate(levels, 1):
        own = np.unique(np.concatenate([g, np.zeros(1, g.dtype)])) if k < ORDER else g
        logp = np.zeros(len(own))
        logp[np.searchsorted(own, g)] = p
        backoff = np.zeros(len(own))
        if len(ctx):
            backoff[np.searchsorted(own, ctx)] = w
        nodes.append((own, logp, backoff))
    for k, (g, logp, backoff) in enumerate(nodes, 1):
        parent = _first(g, k, k - 1)
        owner = np.searchsorted(nodes[k - 2][0], parent) if k > 1 else np.zeros(len(g), np.int64)
        owners = len(nodes[k - 2][0]) if k > 1 else 1
        begin = np.searchsorted(owner, np.arange(owners + 1))
        symbol = _symbol(g)
        # Adding the last value of the range before makes the level monotone.
        full = np.flatnonzero(np.diff(begin))
        last = symbol[begin[full + 1] - 1]
        base = np.zeros(owners, np.int64)
        base[full] = np.concatenate([[0], np.cumsum(last)[:-1]])
        value = symbol + base[owner]
        EliasFano.build(value, int(value[-1]) + size + 1 if len(value) else 1).save(f"{path}/symbols{k}")
        EliasFano.build(begin, len(g) + 1).save(f"{path}/pointers{k}")
        for name, x in (("probability", logp), ("backoff", backoff)):
            code, table = quantise(x)
            np.save(f"{path}/{name}{k}.npy", code)
            np.save(f"{path}/{name}{k}.table.npy", table)


class Trie:
    """The memory-mapped levels."""

    def __init__(self, path: str):
        load = lambda x: np.load(f"{path}/{x}.npy", mmap_mode="r")
        levels = range(1, ORDER + 1)
        self.root = float(np.load(f"{path}/root.npy"))
        self.alphabet = int(np.load(f"{path}/alphabet.npy"))
        self.symbols = [EliasFano.load(f"{path}/symbols{k}") for k in levels]
        self.pointers = [EliasFano.load(f"{path}/pointers{k}") for k in levels]
        self.values = {x: [(load(f"{x}{k}"), load(f"{x}{k}.table")) for k in levels] for x in ("probability", "backoff")}

    def _value(self, name: str, level: int, node: np.ndarray) -> np.ndarray:
        code, table = self.values[name][level]
        return table[code[node]]

    def _child(self, level: int, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The node of ``level`` for a symbol below ``node`` of the level above, -1 if there is none."""
        pointers, seq = self.pointers[level], self.symbols[level]
        begin, end = pointers.access(node), pointers.access(node + 1)
        base = np.where(begin > 0, seq.access(np.maximum(begin - 1, 0)), 0)
        known = np.minimum(symbol, self.alphabet - 1)  # a symbol beyond a narrow model's alphabet has no node
        at, value = seq.successor(base + known, begin, end)
        return np.where((at < end) & (value == base + symbol) & (known == symbol), at, -1)

    def find(self, keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of sorted distinct k-grams and of their contexts, -1 where there are none; shared prefixes are walked once."""
        node, place = np.zeros(1, np.int64), np.zeros(len(keys), np.int64)
        context = np.zeros(len(keys), np.int64)
        for k in range(order):
            prefix = _first(keys, order, k + 1)
            starts = _runs(prefix)
            above = node[place[starts]]
            found = np.full(len(starts), -1, np.int64)
            ok = np.flatnonzero(above >= 0)
            found[ok] = self._child(k, above[ok], _symbol(prefix[starts[ok]]))
            context = node[place]
            node, place = found, np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
        return node[place], context

    def log_probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probabilities of the last symbols of k-grams; those without a node back off to their k-1 last symbols."""
        if not order:
            return np.full(len(keys), np.log(1 / self.alphabet))
        distinct, back = np.unique(keys, return_inverse=True)
        node, context = self.find(distinct, order)
        out = np.empty(len(distinct))
        hit = node >= 0
        out[hit] = self._value("probability", order - 1, node[hit])
        miss = np.flatnonzero(~hit)
        if len(miss):
            weight = np.full(len(miss), self.root if order == 1 else 0.0)
            if order > 1:
                known = context[miss] >= 0
                weight[known] = self._value("backoff", order - 2, context[miss][known])
            out[miss] = weight + self.log_probability(_last(distinct[miss], order - 1), order - 1)
        return out[back]


def fit(docs: DataFrame) -> str:
    """Counts all n-grams, writes the trie to the shared folder and returns its path."""
    path = shared_files(docs.sparkSession, "ngrams")
    rows = checkpointed(counts(docs))
    wide = bool(rows.where("wide").take(1))
    parts = []
    for r in rows.toLocalIterator():
        keys = _from(r["keys"], r["wide"])
        parts.append((widened(keys) if wide and not r["wide"] else keys, np.frombuffer(r["counts"], np.int64)))
    keys, n = _merge(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(keys):
        keys, n = np.array([1], np.uint64), np.array([1])
    write_model(keys, n, path)
    return path


class Scorer:
    """Log probabilities of texts, with a table of the n-grams looked up last by slot."""

    SLOTS = 1 << 21

    def __init__(self, path: str):
        self.trie = Trie(path)
        self.tables: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log probabilities and numbers of symbols."""
        total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b in text_groups(texts):
            key, doc = gram_keys(texts[a:b], True if self.trie.alphabet == ALL else None)
            wide = key.dtype != np.uint64
            if wide not in self.tables:
                none = np.full(BYTES * ORDER, 255, np.uint8).tobytes() if wide else np.uint64(2**64 - 1)
                self.tables[wide] = np.full(self.SLOTS, none, key.dtype), np.zeros(self.SLOTS, np.float32)
            keys, values = self.tables[wide]
            slot = ((_mixed(key) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
            value = values[slot]
            miss = np.flatnonzero(keys[slot] != key)
            if len(miss):
                value[miss] = self.trie.log_probability(key[miss])
                keys[slot[miss]], values[slot[miss]] = key[miss], value[miss]
            total[a:b] = np.bincount(doc, value, b - a)
            size[a:b] = np.bincount(doc, minlength=b - a)
        return total, size


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, symbols, log_probability, bits_per_symbol)."""
    path = path or fit(docs)
    assert os.path.isdir(path), path

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(path)
        for f in frames:
            total, size = scorer([t if isinstance(t, str) else "" for t in f["text"]])
            yield pd.DataFrame({"doc_id": f["doc_id"], "symbols": size, "log_probability": total.round(4), "bits_per_symbol": (-total / np.log(2) / size).round(6)})

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, symbols long, log_probability double, bits_per_symbol double")
