"""Language-model scores of whole texts, from word counts of all training documents and an n-gram trie.

1. Documents are coded in chunks of some Arrow batches: the chunk's distinct words and the texts as numbers of these.
2. Counts of the distinct words of all chunks are summed per word and go back to the chunks.
3. Every chunk gets the unigram score of its documents, exact for all words, and the ids of the words that stand at least
   LEAST times in training documents.
4. Every chunk asks the shards of the model about its distinct pairs and triples of such words. A shard holds all n-grams
   whose context has its hash; it adds up their counts, keeps what stands LEAST times, and answers with the counts and with
   what the kept successors of each context add up to. Contexts of very frequent words are spread by their successors.
5. With the answers a chunk builds its part of the trie and adds what it knows to the unigram scores.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_batches, documents, numbered, sized, stored
from tallyframe.llm.ngrams import Trie
from tallyframe.llm.registry import query

# An n-gram is kept if it stands so often, and at least this share of the training tokens (0: whatever the input's size).
LEAST = 2
SHARE = 0.0
DISCOUNT = 0.75
# Text of a chunk.
CHUNK_BYTES = 24 << 20
# Tokens for each shard of the model. A word that stands so often, and is at least a MOST_HOT-th of all, is hot.
SHARD_TOKENS = 1 << 21
MOST_HOT = 1024
# Tokens that the trie is asked about at a time.
SLICE_TOKENS = 1 << 19
# The end of a document as a word; no word holds white space.
END = "\n"


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.astype("<i4").tobytes())


def _unpacked(data) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), "<i4")


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, most frequent first, the texts as their numbers one after the other, tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
    del lists
    names, flat = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    del coded
    end = len(names)
    names.append(END)
    keep = flat != (names.index("") if "" in names else -1)
    ends = np.r_[0, np.cumsum(keep, dtype=np.int32)][offsets]
    flat = np.insert(flat[keep], ends[1:], end)
    times = np.bincount(flat, minlength=len(names))
    order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    place = np.zeros(len(names), np.int32)
    place[order] = np.arange(len(order))
    return [names[i] for i in order], place[flat], np.diff(ends) + 1


def _joined(batches):
    """Batches put together until they hold CHUNK_BYTES of text."""
    waiting, size = [], 0
    for b in itertools.chain(batches, [None]):
        if b is not None and b.num_rows:
            waiting.append(b)
            size += b.column(2).nbytes
        if waiting and (b is None or size >= CHUNK_BYTES):
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0


def _coded(batches):
    """Chunks from batches (id, held out, text)."""
    for seq, b in enumerate(_joined(batches)):
        names, flat, sizes = _words(b.column(2))
        held = b.column(1).to_numpy(zero_copy_only=False)
        seen = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(names))
        row = {"chunk": TaskContext.get().partitionId() << 32 | seq, "ids": b.column(0).to_pylist(), "held": held.tolist(),
               "sizes": sizes.tolist(), "tokens": _packed(flat), "words": names, "seen": seen.tolist()}
        yield pa.RecordBatch.from_pylist([row], schema=_CHUNK)


_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                    ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.list_(pa.string())),
                    ("seen", pa.list_(pa.int64()))])
_SCORED = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                     ("sizes", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())),
                     ("tokens", pa.binary()), ("heads", pa.binary()), ("counts", pa.binary())])


def _with_unigrams(n: int, v: int):
    def run(chunks: pa.Table, counts: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return _SCORED.empty_table()
        place = counts.column("i").to_numpy()
        count, head = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], head[place] = counts.column("c").to_numpy(), counts.column("head").to_numpy()
        flat = _unpacked(chunks.column("tokens")[0])
        sizes = np.array(chunks.column("sizes")[0].as_py(), np.int64)
        starts = np.cumsum(sizes) - sizes
        score = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        known = np.flatnonzero(head >= 0)
        known = known[np.argsort(head[known])]
        local = np.full(len(head), -1, np.int32)
        local[known] = np.arange(len(known))
        row = {"chunk": chunks.column("chunk")[0].as_py(), "ids": chunks.column("ids")[0].as_py(),
               "held": chunks.column("held")[0].as_py(), "sizes": sizes.tolist(),
               "known": np.add.reduceat((count > 0)[flat].astype(np.int64), starts).tolist(),
               "base": np.add.reduceat(score[flat], starts).tolist(), "tokens": _packed(local[flat]),
               "heads": _planes(head[known]), "counts": _planes(count[known])}
        return pa.Table.from_pylist([row], schema=_SCORED)
    return run


def _slices(sizes: np.ndarray):
    """Ranges of whole documents of about SLICE_TOKENS tokens; a longer document is alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        done = ends[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(ends, done + SLICE_TOKENS, "right")))
        yield a, z, int(done), int(ends[z - 1])
        a = z


def _mixed(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (a ^ a >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(24)


def _is_hot(level: int, contexts: np.ndarray, hot: np.ndarray) -> np.ndarray:
    found = np.isin(contexts & 0xFFFFFFFF, hot)
    return found & np.isin(contexts >> 32, hot) if level == 3 else found


class _Asked:
    """Distinct n-grams of a level in a chunk, in order: `place` of the context, `child` (-1: a context without any), and `n`,
    how often they train.

    Words are places in `heads`, the chunk's frequent words. A context is a word `last` (level 2) after another one, `before`
    (level 3); `contexts` has their numbers in the whole model. `order` puts the n-grams by shard, and those of shard s lie in
    bounds[s]..bounds[s + 1]: the shard follows from the context, or from context and child if the context is hot.
    """

    def __init__(self, level: int, tokens: np.ndarray, starts: np.ndarray, train: np.ndarray, heads: np.ndarray, hot: np.ndarray,
                 shards: int, key_bits: int = 63):
        known = np.r_[False, (tokens >= 0)[:-1]]
        known[starts] = False
        if level == 3:
            known[1:] &= known[:-1].copy()
            known[:1] = False
            # A document's second token has one word before it.
            known[starts[starts + 1 < len(tokens)] + 1] = False
        at = np.flatnonzero(known)
        bits = (len(heads) + 1).bit_length()
        key, table, low = tokens[at - 1].astype(np.int64), None, (1 << bits) - 1
        if level == 3:
            key |= tokens[at - 2].astype(np.int64) << bits
        if level * bits + 1 > key_bits:
            table, key = np.unique(key, return_inverse=True)
        key <<= bits
        key |= tokens[at] + 1
        key <<= 1
        key |= train[at]
        del at, known
        key.sort()
        new = np.flatnonzero(np.diff(key >> 1, prepend=-1))
        self.n = np.add.reduceat(key & 1, new) if len(new) else np.zeros(0, np.int64)
        key = key[new] >> 1
        self.child = (key & low) - 1
        key >>= bits
        first = np.diff(key, prepend=-1) != 0
        self.place = np.cumsum(first) - 1
        key = key[first] if table is None else table[key[first]]
        self.last, self.before = key & low, key >> bits
        self.contexts = heads[self.last]
        if level == 3:
            self.contexts |= heads[self.before] << 32
        self.hot = _is_hot(level, self.contexts, hot)
        mixed = _mixed(self.contexts)[self.place]
        split = np.flatnonzero(self.hot[self.place])
        mixed[split] = _mixed(mixed[split] + _named(self.child[split], heads).astype(np.uint64))
        shard = (mixed % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
        del mixed
        self.order = np.argsort(shard, kind="stable").astype(np.int32)
        self.bounds = np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]


def _named(words: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.where(words >= 0, heads[words], -1) if len(heads) else words


def _planes(a: np.ndarray) -> bytes:
    """Compressed 64-bit numbers, byte by byte of all of them, since most bytes are zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(data, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)


def _questions(levels, hot: np.ndarray, shards: int):
    """Rows (level, shard, chunk, contexts, children, n): the n-grams of the chunks for each shard of the model."""
    def run(batches):
        pa.default_memory_pool().release_unused()  # workers come here from the texts
        for b in batches:
            for i in range(b.num_rows):
                tokens, starts, held, sizes = _tokens_of(b, i)
                train, heads = np.repeat(~held, sizes), _from_planes(b.column("heads")[i])
                for level in levels:
                    asked, rows = _Asked(level, tokens, starts, train, heads, hot, shards), []
                    for s in np.flatnonzero(np.diff(asked.bounds)):
                        at = asked.order[asked.bounds[s]:asked.bounds[s + 1]]
                        context = asked.contexts[asked.place[at]]
                        rows.append({"level": level, "shard": int(s), "chunk": b.column("chunk")[i].as_py(),
                                     "contexts": _planes(np.diff(context, prepend=0)), "children": _planes(_named(asked.child[at], heads)),
                                     "n": _planes(asked.n[at])})
                    del asked
                    yield pa.RecordBatch.from_pylist(rows, schema=_ASKED)
    return run


_ASKED = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("contexts", pa.binary()),
                    ("children", pa.binary()), ("n", pa.binary())])
_ANSWERED = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()),
                       ("mass", pa.binary()), ("contexts", pa.binary())])


def _answers(hot: np.ndarray, least: int, discount: float):
    """A shard of the model: counts over all chunks, sent back to each of them for its n-grams (0: not kept) with the
    discounted counts of the kept children of each of its contexts; those of hot contexts are parts, sent to chunk -1."""
    def run(asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _ANSWERED.empty_table()
        level, shard = asked.column("level")[0].as_py(), asked.column("shard")[0].as_py()
        parts = [np.cumsum(_from_planes(x)) for x in asked.column("contexts")]
        ends = np.cumsum([len(x) for x in parts])
        contexts, place = np.unique(np.concatenate(parts), return_inverse=True)
        del parts
        key = place << 32 | (np.concatenate([_from_planes(x) for x in asked.column("children")]) + 1)
        key, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([_from_planes(x) for x in asked.column("n")]), minlength=len(key))
        count = np.where((count >= least) & (key & 0xFFFFFFFF > 0), count, 0).astype(np.int64)
        kept = np.flatnonzero(count)
        mass = np.bincount(key[kept] >> 32, weights=count[kept] - discount, minlength=len(contexts))
        rows, a = [], 0
        for chunk, z in zip(asked.column("chunk").to_pylist(), ends):
            own = place[a:z]
            rows.append({"level": level, "shard": shard, "chunk": chunk, "counts": _planes(count[back[a:z]]),
                         "mass": _planes(mass[own[np.diff(own, prepend=-1) != 0]]), "contexts": None})
            a = z
        split = np.flatnonzero(_is_hot(level, contexts, hot) & (mass > 0))
        if len(split):
            rows.append({"level": level, "shard": shard, "chunk": -1, "counts": None, "mass": _planes(mass[split]),
                         "contexts": _planes(contexts[split])})
        return pa.Table.from_pylist(rows, schema=_ANSWERED)
    return run


def _parts(batches):
    for b in batches:
        for level, contexts, mass in zip(b.column("level").to_pylist(), b.column("contexts"), b.column("mass")):
            contexts = _from_planes(contexts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(contexts), level, np.int32)), pa.array(contexts),
                                              pa.array(_from_planes(mass, np.float64))], names=["level", "context", "mass"])


def _told(asked: _Asked, answers: pa.Table, level: int, hot_mass: tuple[np.ndarray, np.ndarray]):
    """(count of every n-gram asked for, mass of every context)."""
    count, mass = np.zeros(len(asked.child), np.int64), np.zeros(len(asked.contexts))
    for i in np.flatnonzero(answers.column("level").to_numpy() == level):
        s = answers.column("shard")[int(i)].as_py()
        at = asked.order[asked.bounds[s]:asked.bounds[s + 1]]
        count[at] = _from_planes(answers.column("counts")[int(i)])
        own = asked.place[at]
        mass[own[np.diff(own, prepend=-1) != 0]] = _from_planes(answers.column("mass")[int(i)], np.float64)
    contexts, whole = hot_mass
    split = np.flatnonzero(asked.hot)
    mass[split] = 0
    if len(contexts):
        at = np.minimum(np.searchsorted(contexts, asked.contexts[split]), len(contexts) - 1)
        mass[split] = np.where(contexts[at] == asked.contexts[split], whole[at], 0)
    return count, mass


def _tokens_of(b, i: int):
    """(places of frequent words in the chunk's list or -1, first token of each document, held out, tokens of each)."""
    sizes = np.array(b.column("sizes")[i].as_py(), np.int64)
    return _unpacked(b.column("tokens")[i]), np.cumsum(sizes) - sizes, np.array(b.column("held")[i].as_py(), bool), sizes


def _part_of_trie(tokens, starts, heads, words, answers: pa.Table, hot, shards: int, n: int, v: int, discount: float) -> bytes:
    """The trie of all kept n-grams that stand in a chunk."""
    none = np.zeros(len(tokens), bool)
    names, hot_mass = hot
    two = _Asked(2, tokens, starts, none, heads, names, shards)
    count, mass = _told(two, answers, 2, hot_mass[2])
    rest1 = np.ones(len(heads))
    rest1[two.last] = np.maximum(1 - mass / words[two.last], 1e-12)
    kept = np.flatnonzero(count)
    pairs = np.stack([two.last[two.place[kept]], two.child[kept], count[kept]], 1)
    del two
    three = _Asked(3, tokens, starts, none, heads, names, shards)
    count, mass = _told(three, answers, 3, hot_mass[3])
    rest2, pair = np.ones(len(pairs)), pairs[:, 0] << 32 | pairs[:, 1]
    if len(pair):
        context = three.before << 32 | three.last
        at = np.minimum(np.searchsorted(pair, context), len(pair) - 1)
        here = pair[at] == context
        rest2[at[here]] = np.maximum(1 - mass[here] / pairs[at[here], 2], 1e-12)
    kept = np.flatnonzero(count)
    context = three.place[kept]
    triples = np.stack([three.before[context], three.last[context], three.child[kept], count[kept]], 1)
    del three, context, pair
    single = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))
    return Trie.build(single, words, pairs, triples, discount, (rest1, rest2))


def score_texts(df: DataFrame, key: str, text: str, held_out, share: float = SHARE, discount: float = DISCOUNT,
                shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `df`.

    `held_out` is a column; where it is null the row trains. Words end at ASCII white space, A-Z are lower-cased, a null or
    empty text is one end token. Repeated rows count, and are scored, as often as they stand; without training rows all
    words are equally unknown; an empty table stays empty. Numbers that reach the driver: N, V, and words and pairs of words
    that are at least MOST_HOT-ths of all tokens.
    """
    spark = df.sparkSession
    coded = stored(bounded_batches(df).select(F.col(key).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"),
                             F.col(text).alias("text"))
                   .mapInArrow(_coded, "chunk long, ids array<long>, held array<boolean>, sizes array<long>, tokens binary, "
                                       "words array<string>, seen array<long>"))
    added = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    total, tokens = (x or 0 for x in coded.agg(added("seen"), added("sizes")).first())
    least = max(LEAST, math.ceil(share * total))
    distinct = coded.select("chunk", F.posexplode(F.arrays_zip("words", "seen")).alias("i", "w")).select(
        "chunk", "i", "w.words", "w.seen")
    same = Window.partitionBy("words")
    counted = stored(distinct.withColumn("c", F.sum("seen").over(same))
                     .withColumn("one", F.row_number().over(same.orderBy("chunk")) == 1)
                     .select("chunk", "i", "c", "one", F.when(F.col("c") >= least, F.col("words")).alias("word")))
    kinds = counted.agg(F.count_if(F.col("one") & (F.col("c") > 0)).alias("v"),
                        F.count_if(F.col("one") & F.col("word").isNotNull()).alias("heads")).first()
    heads = numbered(counted.where("one AND word IS NOT NULL").select(F.lit(0).alias("g"), "word", "c"), ["g"], ["word"], "head",
                     kinds["heads"])
    heads = stored(heads.select("word", "c", "head"))
    back = counted.where("word IS NOT NULL").join(sized(heads.select("word", "head")), "word") \
        .select("chunk", "i", "c", F.col("head").cast("long").alias("head")) \
        .unionByName(counted.where("word IS NULL").select("chunk", "i", "c", F.lit(-1).cast("long").alias("head")))
    scored = stored(coded.select("chunk", "ids", "held", "sizes", "tokens").groupBy("chunk").cogroup(back.groupBy("chunk"))
                    .applyInArrow(_with_unigrams(total, kinds["v"]),
                                  "chunk long, ids array<long>, held array<boolean>, sizes array<long>, known array<long>, "
                                  "base array<double>, tokens binary, heads binary, counts binary"))
    n, v, shards = total, kinds["v"], max(1, math.ceil(tokens / shard_tokens))
    much = max(shard_tokens, total / MOST_HOT)
    hot = np.sort(np.array([r["head"] for r in heads.where(F.col("c") >= much).collect()], np.int64))
    asked = scored.select("chunk", "held", "sizes", "tokens", "heads").mapInArrow(
        _questions((2, 3), hot, shards), "level int, shard int, chunk long, contexts binary, children binary, n binary")
    answers = stored(asked.groupBy("level", "shard").applyInArrow(
        _answers(hot, least, discount), "level int, shard int, chunk long, counts binary, mass binary, contexts binary"))
    hot_mass = {level: (np.zeros(0, np.int64), np.zeros(0)) for level in (2, 3)}
    if len(hot):
        sums = answers.where("chunk < 0").mapInArrow(_parts, "level int, context long, mass double") \
            .groupBy("level", "context").agg(F.sum("mass").alias("mass")).toArrow().sort_by("context")
        for level in hot_mass:
            own = sums.filter(pc.equal(sums.column("level"), level))
            hot_mass[level] = own.column("context").to_numpy(), own.column("mass").to_numpy()
    shared = spark.sparkContext.broadcast((hot, hot_mass))

    def finish(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return _RESULT.empty_table()
        tokens, starts, held, sizes = _tokens_of(chunks, 0)
        heads, words = _from_planes(chunks.column("heads")[0]), _from_planes(chunks.column("counts")[0])
        model = Trie(_part_of_trie(tokens, starts, heads, words, answers, shared.value, shards, n, v, discount))
        del answers
        base = np.array(chunks.column("base")[0].as_py())
        gain = np.concatenate([
            np.add.reduceat(model.gains(tokens[first:end].astype(np.int64), starts[a:z] - first), starts[a:z] - first)
            for a, z, first, end in _slices(sizes)])
        return pa.Table.from_arrays(
            [chunks.column("ids")[0].values, pa.array(held), pa.array(sizes), chunks.column("known")[0].values, pa.array(base),
             pa.array(base + gain)], schema=_RESULT)

    out = scored.groupBy("chunk").cogroup(answers.where("chunk >= 0").select("level", "shard", "chunk", "counts", "mass").groupBy("chunk")) \
        .applyInArrow(finish, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      "base_score", "score")


_RESULT = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


@query()
def op4_lm_scoring(spark, folder):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score_texts(documents(spark, folder).select("doc_id", "text"), "doc_id", "text", held_out)
