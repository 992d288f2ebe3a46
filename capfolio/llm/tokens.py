"""Token ids of many texts with a public word-piece tokenizer, inside tasks."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from capfolio.llm.words import Words

CACHE_WORDS = 600_000
PORTION = 4096  # strings that the tokenizer gets at a time
#: The file's own splitting pattern; fixed values.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[!-~¡-įı-ſ]+")
#: Latin letters that the pattern above allows, with one sign after them at most.
SIMPLE = "^[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+[.,;:!?]?$"


class Runs:
    """Numbers by string: ``values[starts[i]:starts[i] + counts[i]]`` belong to ``keys[i]``."""

    def __init__(self):
        self.keys = pa.array([], pa.large_string())
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.values = np.empty(0, np.uint32)

    def find(self, keys: pa.Array) -> np.ndarray:
        """The place of each key, -1 for none."""
        return pc.fill_null(pc.index_in(keys, self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, keys: pa.Array, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The places that the new keys get."""
        places = np.arange(len(self.keys), len(self.keys) + len(keys))
        self.keys = pa.concat_arrays([self.keys, keys])
        self.starts = np.concatenate((self.starts, len(self.values) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.values = np.concatenate((self.values, values))
        return places

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many numbers each place has, and all of them in order."""
        counts = self.counts[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return counts, self.values[np.repeat(self.starts[places] - (ends - counts), counts) + np.arange(total)]


class WordTokenizer:
    """Ids of whole texts, looked up word by word.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its words in
    order; equal words are encoded once. Words of plain Latin letters, digits and ASCII signs are lower-cased and
    split by the file's own pattern first, so that pieces are shared by more words; other words go to the
    tokenizer whole. Both caches are emptied when they hold ``CACHE_WORDS``, which bounds memory.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = Runs(), Runs()

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each string has, and all ids in order. The tokenizer's answers take much memory: a few at a time."""
        counts, ids = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for start in range(0, len(strings), PORTION):
            portion = strings.slice(start, PORTION).to_pylist()
            found = [e.ids for e in self.tokenizer.encode_batch_fast(portion, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(ids)

    def piece_places(self, pieces: pa.Array) -> np.ndarray:
        """Places of ``pieces`` in the cache, which learns those it lacks."""
        if len(self.pieces.keys) > CACHE_WORDS:
            self.pieces = Runs()
        encoded = pieces.dictionary_encode()
        places = self.pieces.find(encoded.dictionary)
        new = places < 0
        missing = encoded.dictionary.filter(pa.array(new))
        places[new] = self.pieces.add(missing, *self.encode(missing))
        return places[encoded.indices.to_numpy(zero_copy_only=False)] if len(pieces) else places

    def learn(self, new: pa.Array) -> np.ndarray:
        """Add the ids of words that are not in the cache; gives their places."""
        simple = pc.match_substring_regex(new, SIMPLE)
        words = new.filter(simple)
        signs = pc.replace_substring_regex(words, r"[^.,;:!?]+", "")
        signed = pc.not_equal(signs, "").to_numpy(zero_copy_only=False)
        cores = pc.utf8_lower(pc.replace_substring_regex(words, r"[.,;:!?]$", ""))
        is_simple = simple.to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~is_simple)
        parts, whole = {}, {}
        for at, word in zip(others.tolist(), new.filter(pc.invert(simple)).to_pylist(), strict=True):
            if PLAIN.fullmatch(word) and "<|" not in word:
                parts[at] = SPLIT.findall(word.lower())
            else:
                whole[at] = word
        kind = new.type
        split = pa.array([p for found in parts.values() for p in found], kind)
        places = self.piece_places(pa.concat_arrays([cores, signs.filter(pa.array(signed)), split]))

        # Simple words are a core and perhaps a sign, the others any number of pieces.
        n_words, n_signs = len(words), int(signed.sum())
        sizes = np.concatenate((1 + signed, [len(found) for found in parts.values()])).astype(np.int64)
        ordered = np.empty(len(places), np.int64)
        begins = np.cumsum(sizes) - sizes
        ordered[begins[:n_words]] = places[:n_words]
        ordered[begins[:n_words][signed] + 1] = places[n_words : n_words + n_signs]
        ordered[len(places) - len(split) :] = places[n_words + n_signs :]
        counts, ids = self.pieces.take(ordered)
        edges = np.concatenate(([0], np.cumsum(counts)))
        learnt = np.concatenate((np.flatnonzero(is_simple), np.array(list(parts), np.int64)))
        found = np.empty(len(new), np.int64)
        found[learnt] = self.words.add(new.take(pa.array(learnt)), edges[begins + sizes] - edges[begins], ids)
        wholes = pa.array(list(whole.values()), kind)
        found[list(whole)] = self.words.add(wholes, *self.encode(wholes))
        return found

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and where each text's ids begin (one entry more than texts)."""
        words = Words(texts, lower=False)
        distinct = words.dictionary.cast(pa.large_string())
        places = self.words.find(distinct)
        new = places < 0
        if len(self.words.keys) + int(new.sum()) > CACHE_WORDS:
            self.words, new = Runs(), np.ones(len(distinct), bool)
        if new.any():
            places[new] = self.learn(distinct.filter(pa.array(new)))
        counts, found = self.words.take(places[words.codes] if len(words.codes) else words.codes)
        return found, np.concatenate(([0], np.cumsum(counts)))[words.starts]


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker; its caches live as long as the worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
