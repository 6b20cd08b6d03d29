"""Elias-Fano n-gram trie: successors of every context as monotone sequences, with quantised probabilities.

Level 1 has the frequent words (ids 0..H-1), level 2 their frequent bigrams, level 3 their frequent trigrams. A node's
children are a range of the next level, found by monotone pointers. Children are told by ids relative to their context: the
word's id after a word, and after two words the place of the word among the successors of the second one. The ids of a
range are laid after the largest id of the ranges before, which makes a whole level one increasing sequence; a child is
found by the successor search for its id in that sequence. Probabilities and back-off weights are 16-bit logarithms.

All arrays lie in one block of bytes and are viewed in place, in a memory-mapped file (`Trie.open`) or in a broadcast one.
"""

import json

import numpy as np

# Base-10 logarithms from 0 down to LOWEST in steps of LOWEST / 65535.
LOWEST = -12.0


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log10, LOWEST, 0.0) * (65535 / LOWEST)).astype("<u2")


def logarithm(code: np.ndarray) -> np.ndarray:
    return code * (LOWEST / 65535)


class Monotone:
    """Elias-Fano code of an increasing sequence: low bits packed, high bits in unary."""

    @staticmethod
    def arrays(values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        words = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, low << shift)
        spill = shift + np.uint64(bits) > 64
        np.bitwise_or.at(words, word[spill] + 1, low[spill] >> (np.uint64(64) - shift[spill]))
        high = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros((int(high[-1]) if n else 0) + n + 1, bool)
        unary[high + np.arange(n)] = True
        return {"meta": np.array([n, bits, len(unary)], np.int64), "low": words,
                "high": np.packbits(unary, bitorder="little")}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits, size = (int(x) for x in arrays["meta"])
        self.low_words = arrays["low"]
        ones = np.flatnonzero(np.unpackbits(arrays["high"], count=size, bitorder="little"))
        self.high = (ones - np.arange(self.n)).astype(np.int32)
        # How many values lie below each step of the high part: the directory of the successor search.
        self.below = np.r_[0, np.cumsum(np.bincount(self.high, minlength=1))].astype(np.int32)

    def low(self, i: np.ndarray) -> np.ndarray:
        if self.bits == 0:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low_words[word] >> shift
        spill = np.flatnonzero(shift + np.uint64(self.bits) > 64)
        value[spill] |= self.low_words[word[spill] + 1] << (np.uint64(64) - shift[spill])
        return value & np.uint64((1 << self.bits) - 1)

    def value(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i].astype(np.int64) << self.bits) | self.low(i).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that isn't below x."""
        step = x >> self.bits
        last = len(self.below) - 2
        inside = step <= last
        step = np.minimum(step, last)
        a = np.where(inside, self.below[step], self.n).astype(np.int64)
        b = np.where(inside, self.below[step + 1], self.n).astype(np.int64)
        want = (x & ((1 << self.bits) - 1)).astype(np.uint64)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            middle = (a[open_] + b[open_]) >> 1
            less = self.low(middle) < want[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)


class Level:
    """Children of all nodes of the level above: pointers and context-relative ids."""

    @staticmethod
    def arrays(parent: np.ndarray, child: np.ndarray, parents: int) -> dict[str, np.ndarray]:
        """From (parent, child id), sorted."""
        sizes = np.bincount(parent, minlength=parents)
        starts = np.r_[0, np.cumsum(sizes)]
        full = np.flatnonzero(sizes)
        width = np.zeros(parents, np.int64)
        width[full] = child[starts[1:][full] - 1] + 1
        base = np.cumsum(width) - width
        ids, pointers = Monotone.arrays(base[parent] + child), Monotone.arrays(starts)
        return {**{f"ids/{k}": v for k, v in ids.items()}, **{f"pointers/{k}": v for k, v in pointers.items()}}

    def __init__(self, arrays: dict[str, np.ndarray]):
        part = lambda name: {k.split("/")[1]: v for k, v in arrays.items() if k.startswith(name)}
        self.ids, self.pointers = Monotone(part("ids")), Monotone(part("pointers"))

    def first(self, parent: np.ndarray) -> np.ndarray:
        return self.pointers.value(parent)

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Node of each (parent, child id), -1 where there is none."""
        out = np.full(len(parent), -1, np.int64)
        start, end = self.pointers.value(parent), self.pointers.value(parent + 1)
        some = np.flatnonzero(start < end)
        if not len(some):
            return out
        start, end, child = start[some], end[some], child[some]
        before = np.where(start > 0, self.ids.value(np.maximum(start - 1, 0)) + 1, 0)
        at = self.ids.successor(before + child)
        here = at < end
        here[here] = self.ids.value(at[here]) == (before + child)[here]
        out[some[here]] = at[here]
        return out


class Trie:
    """Model of one to three words: log10 probabilities of frequent n-grams, back-off weights of their contexts."""

    def __init__(self, data):
        size = int(np.frombuffer(data, "<u8", 1)[0])
        head = json.loads(bytes(data[8:8 + size]))
        arrays = {k: np.frombuffer(data, dtype, n, 8 + size + at) for k, (dtype, n, at) in head.items()}
        level = lambda name: Level({k.removeprefix(name): v for k, v in arrays.items() if k.startswith(name)})
        self.two, self.three = level("two/"), level("three/")
        self.single = arrays["single"]
        self.weight1, self.weight2 = arrays["weight1"], arrays["weight2"]
        self.prob2, self.prob3 = arrays["prob2"], arrays["prob3"]

    @classmethod
    def open(cls, path: str) -> "Trie":
        return cls(np.memmap(path, np.uint8, "r"))

    @staticmethod
    def build(single: np.ndarray, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, discount: float,
              rest: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
        """Block of bytes from the log10 unigram probability and the count of each frequent word, rows (u, w, count) and
        (u, v, w, count). For every triple the pairs (u, v) and (v, w) must be there.

        Absolute discounting, interpolated: p(w | u) = (c(uw) - d) / c(u) + rest(u) p(w), where rest(u) is what the kept
        successors leave, and the same one word further. A part of a larger model brings `rest`, of its words and of its
        pairs in order, since it doesn't hold all successors.
        """
        if not rest:
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        u, w, c = pairs.T
        share = (c - discount) / words[u]
        rest1 = rest[0] if rest else np.maximum(1 - np.bincount(u, weights=share, minlength=len(words)), 1e-12)
        prob2 = share + rest1[u] * 10.0 ** single[w]
        code = u.astype(np.int64) << 32 | w.astype(np.int64)
        node = lambda a, b: np.searchsorted(code, a.astype(np.int64) << 32 | b.astype(np.int64))
        first, second = node(triples[:, 0], triples[:, 1]), node(triples[:, 1], triples[:, 2])
        relative = second - np.searchsorted(u, triples[:, 1])
        order = np.lexsort((relative, first))
        first, second, relative, c3 = first[order], second[order], relative[order], triples[order, 3]
        share3 = (c3 - discount) / c[first]
        rest2 = rest[1] if rest else np.maximum(1 - np.bincount(first, weights=share3, minlength=len(pairs)), 1e-12)
        prob3 = share3 + rest2[first] * prob2[second]
        arrays = {"single": single.astype("<f8"), "weight1": quantised(np.log10(rest1)), "weight2": quantised(np.log10(rest2)),
                  "prob2": quantised(np.log10(prob2)), "prob3": quantised(np.log10(prob3)),
                  **{f"two/{k}": v for k, v in Level.arrays(u, w, len(words)).items()},
                  **{f"three/{k}": v for k, v in Level.arrays(first, relative, len(pairs)).items()}}
        head, parts, at = {}, [], 0
        for name, a in arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            head[name] = (a.dtype.str, len(a), at)
            parts.append(raw + b"\0" * (-len(raw) % 8))
            at += len(parts[-1])
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        return b"".join([np.array([len(text)], "<u8").tobytes(), text, *parts])

    def gains(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What the trie adds to the log10 unigram probability of every token.

        `ids` are word ids of documents laid end to end (-1: not a frequent word), `starts` marks each document's first
        token, which has no context; its second token has one word.
        """
        n = len(ids)
        before = np.r_[-1, ids[:-1]]
        before[starts] = -1
        pair = np.full(n, -1, np.int64)
        both = np.flatnonzero((before >= 0) & (ids >= 0))
        distinct, which = np.unique(before[both].astype(np.int64) << 32 | ids[both], return_inverse=True)
        pair[both] = self.two.find(distinct >> 32, distinct & 0xFFFFFFFF)[which]
        context = np.r_[-1, pair[:-1]]
        context[starts] = -1
        gain = np.zeros(n)
        known = np.flatnonzero(before >= 0)
        gain[known] = logarithm(self.weight1[before[known]])
        hit = np.flatnonzero(pair >= 0)
        gain[hit] = logarithm(self.prob2[pair[hit]]) - self.single[ids[hit]]
        wide = np.flatnonzero(context >= 0)
        gain[wide] += logarithm(self.weight2[context[wide]])
        longer = np.flatnonzero((context >= 0) & (pair >= 0))
        distinct, which = np.unique(context[longer] << 32 | (pair[longer] - self.two.first(before[longer])), return_inverse=True)
        triple = self.three.find(distinct >> 32, distinct & 0xFFFFFFFF)[which]
        hit = triple >= 0
        longer, triple = longer[hit], triple[hit]
        gain[longer] = logarithm(self.prob3[triple]) - self.single[ids[longer]]
        return gain
