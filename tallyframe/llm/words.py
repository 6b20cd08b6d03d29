"""Token ids of whole texts, word by word: texts are cut where no token can cross, and every distinct word of a block of texts
is encoded once. Nothing is kept between blocks but the vocabulary.
"""

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

from tallyframe.llm.common import worker_state

# Text that is cut into words at a time.
BLOCK_BYTES = 8 << 20
# Distinct words whose ids are Python lists at a time; after that they lie in arrays.
LISTED_WORDS = 1 << 14

# White space, a space, white space or the end: the run that such a space stands in can't be cut there.
_INSIDE_RUN = r"[\s\v\x1c-\x1f\x85\pZ] (?:[\s\v\x1c-\x1f\x85\pZ]|\z)"
# Characters that every Unicode version and normal form treats alike.
_PLAIN = re.compile("[\t\n\r -~À-įı-ſ]*")
_CUT = "\x01"


def byte_words(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Parts of each text between which byte-level patterns always break, and which texts can only be taken whole."""
    whole = pc.or_(pc.match_substring(texts, _CUT), pc.match_substring_regex(texts, _INSIDE_RUN))
    marked = pc.replace_substring(pc.if_else(whole, "", texts), " ", _CUT + " ")
    return pc.split_pattern(marked, _CUT), whole.to_numpy(zero_copy_only=False)


def space_words(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Parts of each text for tokenizers that drop white space; no text has to be taken whole."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), np.zeros(len(texts), bool)


class WordIds:
    """Ids of texts. `cut` gives the words of an array of texts, `resolve` the ids of each of a list of words."""

    def __init__(self, cut: Callable, resolve: Callable):
        self.cut, self.resolve = cut, resolve

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts (no nulls): ids of their distinct words one after the other, the number of ids of each, the words of all
        texts as places in these, and where each text's words start and the last ones end. `gathered` gives the texts' ids."""
        words, whole = self.cut(texts)
        offsets = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        del words
        names, flat = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        del coded
        if whole.any():
            flat = flat.copy()
            flat[offsets[:-1][whole]] = np.arange(len(names), len(names) + whole.sum())
            names += texts.filter(pa.array(whole)).to_pylist()
        return *self.resolve(names), flat, offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (no nulls) one after the other, and where each text's ids start and the last ones end."""
        return gathered(*self.coded(texts))


def gathered(ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that are the words offsets[i]..offsets[i + 1] of `flat`, from the ids of the words one after the other."""
    starts, sizes = np.cumsum(lengths) - lengths, lengths[flat]
    ends = np.r_[0, np.cumsum(sizes)]
    at = np.repeat((starts[flat] - ends[:-1]).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], ends[offsets]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# Stands for the end of a word in the merges of vocabularies that mark it; no byte of UTF-8.
_WORD_END = b"\xff"


class LibraryWords:
    """Ids of distinct words as the tokenizers library gives them.

    The merges run in tiktoken's core, by rank of the token that a pair makes. That gives the library's ids if every token
    comes from one merge, tokens come in the order of their merges (checked here), and the library itself makes each token's
    text that one token (tested for the vocabularies used). Words with other than plain characters, and vocabularies of
    another kind, go through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = spec["normalizer"] is not None
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.pattern = regex.compile(own[0] if own else BYTE_PATTERN)
        self.cut = space_words if self.lower else byte_words
        self.end = _WORD_END if spec["model"]["end_of_word_suffix"] else b""
        self.core, self.of_rank = self._core(spec["model"])

    def _core(self, model: dict):
        """tiktoken's core with ranks in the order of the merges, and the id of each rank; None if the vocabulary doesn't fit."""
        bytes_of, suffix = {c: bytes([b]) for b, c in _byte_letters().items()}, model["end_of_word_suffix"] or ""

        def raw(token):
            ended = suffix and token.endswith(suffix)
            return b"".join(bytes_of[c] for c in (token[:-len(suffix)] if ended else token)) + (_WORD_END if ended else b"")

        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [a.removesuffix(suffix) + b if suffix else a + b for a, b in merges]
        if len(set(made)) != len(made) or model["dropout"] or model["ignore_merges"] or any(a.endswith(suffix) for a, _ in merges if suffix):
            return None, None
        single = [c for c in bytes_of if not suffix or c != bytes_of_end(bytes_of)]
        # The end of a word joins its last byte before anything else.
        order = [*single, *(c + suffix for c in single if suffix), *made]
        ranks = {raw(t): r for r, t in enumerate(order)}
        if suffix:
            ranks[_WORD_END] = len(ranks)
        if len(ranks) != len(order) + bool(suffix) or any(t not in vocab for t in order):
            return None, None
        core = tiktoken.Encoding("words", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        return core, np.array([*(vocab[t] for t in order), *([-1] if suffix else [])], np.int32)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each."""
        parts = [self._listed(words[i:i + LISTED_WORDS]) for i in range(0, max(1, len(words)), LISTED_WORDS)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([lengths for _, lengths in parts])

    def _listed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.core is None:
            found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int32, lengths.sum()), lengths
        whole, piece, end, plain, foreign = self.core.encode_ordinary, self.core.encode_single_piece, self.end, _PLAIN.fullmatch, {}
        found = []
        for i, w in enumerate(words):
            if w.isascii() and w[1:].isalpha() and (w[0].isalpha() or w[0] == " " and not self.lower):
                found.append(piece((w.lower() if self.lower else w).encode() + end))
            elif plain(w) is None:
                foreign[i] = self.tokenizer.encode(w, add_special_tokens=False).ids
                found.append(foreign[i])
            elif self.lower:
                found.append([x for part in self.pattern.findall(w.lower()) for x in piece(part.encode() + end)])
            else:
                found.append(whole(w))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, lengths.sum())
        ids, starts = self.of_rank[np.minimum(flat, len(self.of_rank) - 1)], np.cumsum(lengths) - lengths
        for i, own in foreign.items():  # those are ids already
            ids[starts[i]:starts[i] + lengths[i]] = own
        return ids, lengths


def bytes_of_end(bytes_of: dict[str, bytes]) -> str:
    """The letter whose byte marks the end of a word."""
    return next(c for c, b in bytes_of.items() if b == _WORD_END)


BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def library_ids(path: str) -> WordIds:
    """This worker's encoder for a vocabulary file of the tokenizers library (special tokens are ordinary text)."""
    def make():
        words = LibraryWords(path)
        return WordIds(words.cut, words)
    return worker_state(("library", path), make)


def text_blocks(texts: pa.Array, most_bytes: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """The texts in order, in slices of bounded size (a longer text is alone); nulls as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield texts.slice(at, to - at)
        at = to


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` after the ids of each text."""
    n = len(bounds) - 1
    out, bounds = np.empty(len(ids) + n, np.int32), bounds + np.arange(n + 1)
    ends = np.zeros(len(out), bool)
    ends[bounds[1:] - 1] = True
    out[ends], out[~ends] = end_id, ids
    return out, bounds


def id_blocks(encoder: WordIds, texts: pa.Array, end_id: int | None = None, most_bytes: int = BLOCK_BYTES,
              most_words: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids of the texts (null: none) block by block: the place of the block's first text, all ids, and the texts' bounds in them.

    With `most_words` the ids of a block come for some texts at a time, of about so many words (a longer text is alone): the
    block's distinct words are still encoded once, but its ids never lie in memory together.
    """
    at = 0
    for block in text_blocks(texts, most_bytes):
        ids, lengths, flat, offsets = encoder.coded(block)
        a = 0
        while a < len(block):
            z = len(block) if most_words is None else max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_words, "right")) - 1)
            own, bounds = gathered(ids, lengths, flat[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
            yield at + a, *((own, bounds) if end_id is None else with_end(own, bounds, end_id))
            a = z
        at += len(block)


def id_lists(encoder: WordIds, texts: pa.Array) -> pa.ListArray:
    return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())) for _, ids, bounds in id_blocks(encoder, texts))])


def rank_file(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank on each line), at the place of their rank."""
    tokens = []
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            assert int(rank) == len(tokens)
            tokens.append(base64.b64decode(token))
    return tokens
