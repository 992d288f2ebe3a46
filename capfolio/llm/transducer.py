"""Count transducers: acyclic automata that read a phrase word by word and give its weight.

A transducer is kept as arrays in sorted order. ``words`` are the distinct labels, ascending bytewise; state ``i`` of level
``n`` is reached from state ``parent[i]`` of level ``n - 1`` by the label ``label[i]``, and ``weight[i]`` is the number
of times its phrase was counted. States of a level ascend by (parent, label), so the phrases of a level ascend too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Level = tuple[np.ndarray, np.ndarray, np.ndarray]
NOTHING = np.empty(0, np.int64)


def sorted_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in order, and the place there of each of ``words``."""
    encoded = words.dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    return encoded.dictionary.take(pa.array(order)), place[codes] if len(codes) else NOTHING


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the weight of each, and the place there of each of ``keys``."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    new = np.empty(len(found), bool)
    if len(new):
        new[0] = True
        np.not_equal(found[1:], found[:-1], out=new[1:])
    first = np.flatnonzero(new)
    place = np.empty(len(found), np.int64)
    place[order] = np.cumsum(new) - 1
    if weights is None:
        total = np.diff(np.append(first, len(found)))
    else:
        total = np.add.reduceat(weights[order], first) if len(first) else NOTHING
    return found[first], total, place


def level_of(keys: np.ndarray, base: int, weight: np.ndarray) -> Level:
    return (keys // base).astype(np.int32), (keys % base).astype(np.int32), weight


class CountTransducer:
    def __init__(self, words: pa.Array, levels: Sequence[Level]):
        self.words = words
        self.levels = list(levels)

    def __len__(self) -> int:
        return sum(len(weight) for _, _, weight in self.levels)

    @classmethod
    def of_sequence(cls, codes: np.ndarray, piece: np.ndarray, words: pa.Array, longest: int) -> CountTransducer:
        """All phrases up to ``longest`` words of a text of word ``codes``; phrases lie within one ``piece``."""
        base = max(1, len(words))
        states, levels = np.zeros(len(codes), np.int64), []
        starts = np.arange(len(codes))
        for n in range(longest):
            inside = starts + n < len(codes)
            starts, states = starts[inside], states[inside]
            whole = piece[starts] == piece[starts + n]
            starts, states = starts[whole], states[whole]
            keys, weight, states = counted(states * base + codes[starts + n])
            levels.append(level_of(keys, base, weight))
        return cls(words, levels)

    @classmethod
    def union(cls, parts: Sequence[CountTransducer]) -> CountTransducer:
        """One transducer that gives the sum of the weights that ``parts`` give."""
        if len(parts) == 1:
            return parts[0]
        words, place = sorted_words(pa.concat_arrays([p.words for p in parts]))
        base = max(1, len(words))
        edges = np.cumsum([0] + [len(p.words) for p in parts])
        labels = [place[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        states = [np.zeros(1, np.int64) for _ in parts]
        levels = []
        for n in range(max(len(p.levels) for p in parts)):
            own = [p.levels[n] for p in parts]
            keys = [s[parent] * base + to[label] for s, to, (parent, label, _) in zip(states, labels, own, strict=True)]
            found, weight, at = counted(np.concatenate(keys), np.concatenate([w for _, _, w in own]))
            states = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
            levels.append(level_of(found, base, weight))
        return cls(words, levels)

    def kept(self, least: int) -> CountTransducer:
        """The states of at least that weight, and those on the way to them."""
        stays = [weight >= least for _, _, weight in self.levels]
        for n in range(len(self.levels) - 1, 0, -1):
            stays[n - 1][self.levels[n][0][stays[n]]] = True
        levels, moved = [], np.zeros(1, np.int64)
        for (parent, label, weight), stay in zip(self.levels, stays, strict=True):
            levels.append((moved[parent[stay]], label[stay], weight[stay]))
            moved = np.cumsum(stay) - 1
        return CountTransducer(self.words, levels).narrowed()

    def narrowed(self) -> CountTransducer:
        """The same without words that label nothing."""
        used = np.zeros(len(self.words), bool)
        for _, label, _ in self.levels:
            used[label] = True
        place = np.cumsum(used) - 1
        levels = [(parent, place[label] if len(label) else label, weight) for parent, label, weight in self.levels]
        return CountTransducer(self.words.filter(pa.array(used)), levels)

    def cut(self, cuts: Sequence[tuple[bytes, bytes]]) -> Iterator[CountTransducer]:
        """Parts, one at a time, by ranges of the first two words; ``cuts`` are the least prefixes of all ranges but the first.

        A phrase of one word goes where that word and an empty second one go. A state above a part's first phrase that
        belongs to an earlier part is repeated without weight.
        """
        lower = [self.lower(first, second) for first, second in cuts]
        ends = [tuple(len(w) for _, _, w in self.levels)]
        for begin, end in zip([(0,) * len(self.levels), *lower], [*lower, *ends], strict=True):
            levels, shift = [], 0
            for n, (parent, label, weight) in enumerate(self.levels):
                a, b = begin[n], end[n]
                own = weight[a:b]
                if n == 0 and len(self.levels) > 1 and begin[1] < end[1] and self.levels[1][0][begin[1]] < a:
                    a -= 1
                    own = np.concatenate((np.zeros(1, weight.dtype), own))
                levels.append((parent[a:b] - shift, label[a:b], own))
                shift = a
            yield CountTransducer(self.words, levels).narrowed()

    def lower(self, first: bytes, second: bytes) -> tuple[int, ...]:
        """At each level, how many states have a phrase below that prefix."""
        place, known = self.place(first)
        labels = self.levels[0][1]
        at = [int(np.searchsorted(labels, place + (1 if known and second else 0)))]
        if len(self.levels) > 1:
            parent, label, _ = self.levels[1]
            above = int(np.searchsorted(labels, place))
            a = int(np.searchsorted(parent, above))
            if known and second and above < len(labels) and labels[above] == place:
                b = int(np.searchsorted(parent, above + 1))
                a += int(np.searchsorted(label[a:b], self.place(second)[0]))
            at.append(a)
        for parent, _, _ in self.levels[2:]:
            at.append(int(np.searchsorted(parent, at[-1])))
        return tuple(at)

    def place(self, word: bytes) -> tuple[int, bool]:
        """How many words are below ``word``, and whether it is one of them."""
        low, high = 0, len(self.words)
        while low < high:
            middle = (low + high) // 2
            if self.words[middle].as_py() < word:
                low = middle + 1
            else:
                high = middle
        return low, low < len(self.words) and self.words[low].as_py() == word

    def compose(self, phrases: Sequence[pa.Array]) -> np.ndarray:
        """The weights of ``phrases``, given as one array per word position with NULL after the last; 0 for none.

        All phrases are read at once: the states reached after ``n`` words are matched with those of level ``n + 1``.
        """
        states, found = None, np.zeros(len(phrases[0]), np.int64)
        base = max(1, len(self.words))
        for (parent, label, weight), words in zip(self.levels, phrases, strict=False):
            going = words.is_valid().to_numpy(zero_copy_only=False)
            codes = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            above = np.zeros(len(found), np.int64) if states is None else states
            reached = np.full(len(found), -1, np.int64)
            known = going & (codes >= 0) & (above >= 0)
            if known.any() and len(weight):
                have = parent.astype(np.int64) * base + label
                want = above[known] * base + codes[known]
                at = np.searchsorted(have, want).clip(max=len(have) - 1)
                reached[known] = np.where(have[at] == want, at, -1)
            found = np.where(going, np.where(reached >= 0, weight[reached] if len(weight) else 0, 0), found)
            states = reached
        return found

    def phrases(self) -> list[list[bytes]]:
        """The words of each state's phrase, joined by spaces, level by level."""
        words, levels = self.words.to_pylist(), []
        for n, (parent, label, _) in enumerate(self.levels):
            own = [words[i] for i in label.tolist()]
            levels.append(own if n == 0 else [b"%b %b" % (levels[-1][p], w) for p, w in zip(parent.tolist(), own, strict=True)])
        return levels

    def to_bytes(self) -> bytes:
        offsets = np.concatenate(([0], np.cumsum(pc.binary_length(self.words).to_numpy(zero_copy_only=False))))
        text = b"".join(self.words.to_pylist())
        arrays = [np.array([len(self.words), *[len(w) for _, _, w in self.levels]], np.int64), offsets.astype(np.int64)]
        for parent, label, weight in self.levels:
            arrays += [np.diff(parent, prepend=0).astype(np.uint32), label.astype(np.uint32), weight.astype(np.int64)]
        body = b"".join(a.tobytes() for a in arrays) + text
        header = np.array([len(self.levels), len(body)], np.int64).tobytes()
        return header + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountTransducer:
        longest, size = np.frombuffer(data, np.int64, 2).tolist()
        body = pa.decompress(data[16:], size, codec="zstd", asbytes=True)
        at = 0

        def taken(count: int, kind: type) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(body, kind, count, at)
            at += found.nbytes
            return found

        n_words, *sizes = taken(longest + 1, np.int64).tolist()
        offsets = taken(n_words + 1, np.int64)
        levels = []
        for count in sizes:
            steps, label, weight = taken(count, np.uint32), taken(count, np.uint32), taken(count, np.int64)
            levels.append((np.cumsum(steps.astype(np.int32)), label.astype(np.int32), weight))
        text = pa.py_buffer(body[at:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(offsets.tobytes()), text])
        return cls(words, levels)
