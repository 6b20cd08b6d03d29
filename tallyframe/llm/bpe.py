"""Byte-level BPE: merges replayed over the distinct words of a corpus.

Documents are coded chunk by chunk as numbers of the chunk's distinct words. The words are one corpus for the replay: an inverted
index leads from the rank of a token pair to the positions where the pair stands, the lowest rank is merged next in all words
that have it, and only the pairs that touch a merged position are looked up again. Within a word positions merge from the
left, and no further than to the first one whose merge makes a pair of a lower rank, which is what an encoder does that
takes the word alone.

By default a chunk is such a corpus. With `corpus_wide` the words of all chunks are made distinct once more by a grouped
aggregate, so that a word of the whole table is merged once, in one place, and its ids are joined back to the chunks; that
writes several times the text to disk.
"""

import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_batches, documents, stored, worker_state
from tallyframe.llm.registry import query
from tallyframe.llm.words import byte_words, gathered, rank_file, text_blocks
from tallyframe.session import quoted

# Positions whose pairs are looked up at a time before the first merge.
FIRST_LOOK = 1 << 18
# Text of a chunk, words that are merged together and their bytes, codes that are spelled at a time.
CHUNK_BYTES = 16 << 20
REPLAY_WORDS = 1 << 17
REPLAY_BYTES = 4 << 20
SPELL_CODES = 1 << 19
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


class Merges:
    """Which pairs of tokens join, and into which: every way to cut a token into two tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: r for r, t in enumerate(tokens)}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, r) for t, r in self.rank.items() for i in range(1, len(t))
                 if (a := self.rank.get(t[:i])) is not None and (b := self.rank.get(t[i:])) is not None]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.joined = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int32)
        # Tokens that are part of a pair of a lower rank than their own: merging such a token can open a merge that goes first.
        least = np.full(len(tokens), len(tokens), np.int64)
        np.minimum.at(least, pairs[:, 0] >> 32, pairs[:, 1])
        np.minimum.at(least, pairs[:, 0] & 0xFFFFFFFF, pairs[:, 1])
        self.opens = least < np.arange(len(tokens))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, -1 where it makes none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        n = int(sizes.sum())
        if not n:
            return np.zeros(0, np.int32), sizes
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = n
        before[np.r_[0, ends[:-1]]] = -1
        there = np.ones(n, bool)
        pair = np.full(n, -1, np.int32)  # rank of the pair that starts here
        index, ranks = {}, []

        def look(at):
            pair[at] = -1
            at = at[after[at] < n]
            pair[at] = made = self.join(ids[at], ids[after[at]])
            at, made = at[made >= 0], made[made >= 0]
            if not len(at):
                return
            order = np.argsort(made, kind="stable")
            at, made = at[order], made[order]
            cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
            for r, part in zip(made[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(ranks, r)

        for part in np.array_split(np.arange(n, dtype=np.int32), n // FIRST_LOOK + 1):
            look(part)
        while ranks:
            r = heapq.heappop(ranks)
            at = index.pop(r)
            at = np.unique(np.concatenate(at))
            at = at[pair[at] == r]
            if not len(at):
                continue
            at = at[_alternate(at, after)]
            if self.opens[r]:
                last = self._before_lower(r, at, ids, word, after, before, n)
                if not last.all():
                    index[r] = [at[~last]]
                    heapq.heappush(ranks, r)
                    at = at[last]
            gone = after[at]
            ids[at] = r
            there[gone] = False
            pair[gone] = -1
            after[at] = following = after[gone]
            inside = following < n
            before[following[inside]] = at[inside]
            left = before[at]
            look(np.unique(np.concatenate([left[left >= 0], at])))
        return ids[there], np.bincount(word[there], minlength=len(words))

    def _before_lower(self, r: int, at, ids, word, after, before, n: int) -> np.ndarray:
        """Which of the positions `at` a word merges before a pair of a lower rank than r comes up, the one that makes it included."""
        left, right = before[at], after[after[at]]
        beside = np.r_[False, left[1:] == after[at[:-1]]]  # the position before it has been merged by then
        new = np.full((2, len(at)), -1, np.int64)
        here = left >= 0
        new[0, here] = self.join(np.where(beside, r, ids[left])[here], np.full(here.sum(), r))
        here = right < n
        new[1, here] = self.join(np.full(here.sum(), r), ids[right[here]])
        lower = ((new >= 0) & (new < r)).any(0)
        first = np.r_[True, word[at[1:]] != word[at[:-1]]]
        seen = np.cumsum(lower) - lower  # up to each position, in all words
        return seen == seen[first][np.cumsum(first) - 1]


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the ascending positions merge if each takes its right neighbour away: every second one of a run."""
    first = np.r_[True, at[1:] != after[at[:-1]]]
    place = np.arange(len(at))
    return (place - place[first][np.cumsum(first) - 1]) % 2 == 0


class ReplayedWords:
    """Ids of distinct words: their distinct matches of the split pattern are one corpus for the replay."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.pattern = merges, regex.compile(pattern)
        self.letters_join = pattern == public_tokenizers.PATTERN  # letters, with a space before them, are one match

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number, rows = {}, []
        for w in words:
            if self.letters_join and w.isascii() and w[1:].isalpha() and (w[0] == " " or w[0].isalpha()):
                rows.append([number.setdefault(w, len(number))])
            else:
                rows.append([number.setdefault(p, len(number)) for p in self.pattern.findall(w)])
        pieces = [p.encode() for p in number]
        ids, lengths = self._pieces(pieces)
        starts = np.cumsum(lengths) - lengths
        counts = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((i for r in rows for i in r), np.int64, counts.sum())
        sizes = lengths[flat]
        first = np.cumsum(sizes) - sizes
        out = ids[np.arange(sizes.sum()) + np.repeat(starts[flat] - first, sizes)]
        of_word = np.repeat(np.arange(len(words)), counts)
        return out, np.bincount(of_word, weights=sizes, minlength=len(words)).astype(np.int64)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A piece that is a token stays whole; the others are merged."""
        whole = np.array([self.merges.rank.get(p, -1) for p in pieces], np.int64)
        ids, lengths = self.merges.replay([p for p, r in zip(pieces, whole) if r < 0])
        sizes = np.ones(len(pieces), np.int64)
        sizes[whole < 0] = lengths
        out = np.repeat(whole, sizes)
        out[out < 0] = ids
        return out, sizes


def _joined(batches, text: int):
    """Batches put together until they hold CHUNK_BYTES of text."""
    waiting, size = [], 0
    for b in batches:
        if b.num_rows:
            waiting.append(b)
            size += b.column(text).nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _chunks(batches, text: int):
    """Chunks: the rows, the distinct words of their texts, the texts as numbers of these, and each text's bounds in them."""
    for table in _joined(batches, text):
        at = 0
        for block in text_blocks(table.column(text).combine_chunks(), CHUNK_BYTES):  # a very long text is a chunk of its own
            words, whole = byte_words(block)
            offsets, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
            names, flat = coded.dictionary, coded.indices.to_numpy()
            if whole.any():
                flat = flat.copy()
                flat[offsets[:-1][whole]] = np.arange(len(names), len(names) + whole.sum())
                names = pa.concat_arrays([names.cast(pa.large_string()), block.filter(pa.array(whole))])
            yield table.slice(at, len(block)).combine_chunks(), names, flat, offsets
            at += len(block)


def _coded(keys: int):
    """Rows (keys, chunk, codes, words): the words of a text as numbers in the list `words`, which the chunk's first row has."""
    def run(batches):
        for seq, (own, names, flat, offsets) in enumerate(_chunks(batches, keys)):
            n = own.num_rows
            chunk = TaskContext.get().partitionId() << 32 | seq
            codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            first = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.string()))
            lists = pa.concat_arrays([first, pa.nulls(n - 1, first.type)])
            yield pa.RecordBatch.from_arrays(
                [*[own.column(i).combine_chunks() for i in range(keys)], pa.array(np.full(n, chunk)), codes, lists],
                names=[*own.column_names[:keys], "chunk", "codes", "words"])
    return run


def _slices(ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray, ends: np.ndarray):
    """(first text, lists of ids) of texts that are the words ends[i]..ends[i + 1] of `flat`, SPELL_CODES words at a time."""
    at = 0
    while at + 1 < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SPELL_CODES, "right")) - 1)
        found, bounds = gathered(ids, lengths, flat[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
        yield at, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
        at = to


def _encoded(keys: int, path: str, pattern: str):
    """Rows (keys, ids), chunk by chunk."""
    def run(batches):
        resolve = _resolver(path, pattern)
        for own, names, flat, offsets in _chunks(batches, keys):
            ids, lengths = resolve(names.to_pylist())
            for at, lists in _slices(ids, lengths, flat, offsets):
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(i).slice(at, len(lists)).combine_chunks() for i in range(keys)], lists], names=[*own.column_names[:keys], "ids"])
    return run


def _resolver(path: str, pattern: str) -> ReplayedWords:
    return worker_state(("replay", path, pattern), lambda: ReplayedWords(Merges(rank_file(path)), pattern))


def _replayed(path: str, pattern: str):
    def run(batches):
        resolve, waiting, size = _resolver(path, pattern), [], 0

        def flush():
            ids, lengths = resolve(pa.concat_arrays(waiting).to_pylist())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(waiting), pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(ids, pa.int32()))], names=["word", "ids"])

        for b in batches:
            if b.num_rows:
                waiting.append(b.column(0))
                size += b.column(0).nbytes
            if size >= REPLAY_BYTES or sum(map(len, waiting)) >= REPLAY_WORDS:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()
    return run


def _spelled(keys: int):
    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("i").to_numpy()
        lists = words.column("ids").combine_chunks()
        order = np.argsort(place)
        lengths = np.diff(lists.offsets.to_numpy())
        ids, _ = gathered(lists.flatten().to_numpy(), lengths, order, np.zeros(1, np.int64))
        codes = rows.column("codes").combine_chunks()
        out = [lists for _, lists in _slices(ids, lengths[order], codes.flatten().to_numpy(), codes.offsets.to_numpy() - codes.offsets[0].as_py())]
        ids = pa.chunked_array(out, pa.list_(pa.int32()))
        return pa.Table.from_arrays([*rows.columns[:keys], ids], names=[*rows.column_names[:keys], "ids"])
    return run


def encode(df: DataFrame, keys: list[str], text: str, path: str = RANKS,
           pattern: str = public_tokenizers.PATTERN, corpus_wide: bool = False) -> DataFrame:
    """(keys, ids: array<int>) with the ids of the whole text of every row; a null or empty text has none.

    Keys may be null or repeated; other columns are not read, whatever their names. A word without a space to cut at, however
    long, is merged in time that grows with its length times the logarithm of it.
    """
    names = [f"key{i}" for i in range(len(keys))]
    own = bounded_batches(df).select(*[quoted(k).alias(n) for k, n in zip(keys, names)], quoted(text).alias("text"))
    kinds = "".join(f"{n} {t}, " for n, t in own.dtypes[:-1])
    if not corpus_wide:
        found = own.mapInArrow(_encoded(len(keys), path, pattern), f"{kinds}ids array<int>")
        return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "ids")
    coded = stored(own.mapInArrow(_coded(len(keys)), f"{kinds}chunk long, codes array<int>, words array<string>"))
    places = coded.where("words IS NOT NULL").select("chunk", F.posexplode("words").alias("i", "word"))
    spelled = places.select("word").distinct().mapInArrow(_replayed(path, pattern), "word string, ids array<int>")
    # With an alias, since both sides of the cogroup stem from one table.
    back = places.join(spelled, "word").select(F.col("chunk").alias("chunk"), "i", "ids")
    found = coded.select(*names, "chunk", "codes").groupBy("chunk").cogroup(back.groupBy("chunk")) \
        .applyInArrow(_spelled(len(keys)), f"{kinds}ids array<int>")
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "ids")


def decode(df: DataFrame, ids: str, data: str, path: str = RANKS) -> DataFrame:
    """Add (or replace) binary column `data`: the bytes the ids stand for, looked up in the vocabulary as a constant array.

    Null ids give null. An id outside the vocabulary is an error.
    """
    digits = F.split(F.lit(",".join(t.hex() for t in rank_file(path))), ",")  # folded into a constant by the optimizer
    # As strings, since only those are joined; joining takes the bytes as they are.
    joined = F.array_join(F.transform(ids, lambda i: F.unhex(F.element_at(digits, i + 1)).cast("string")), "")
    return df.withColumn(data, joined.cast("binary"))


@query()
def op2_byte_bpe(spark, folder):
    back = decode(encode(documents(spark, folder), ["doc_id"], "text"), "ids", "decoded")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
