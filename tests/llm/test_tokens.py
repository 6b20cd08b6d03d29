import functools
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyframe.llm import bpe, packing, token_files, words
from tallyframe.llm.common import documents

PARTS = list("aaaabcdeforthein  \n\n\t'srtvl.,!?09 é ß中😀\x1c\x85_\x01") + [
    "  ", "   ", " the", "'ll", "<|endoftext|>", "\n ", "　", "İ", "Σ", " Σ", "́"]


def fuzz(n):
    rnd = random.Random(n)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 50))) for _ in range(n)]
    return [*texts, "", " ", "  ", "a" * 700, "ab" * 300, "\n \n", None]


@functools.cache
def library(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@functools.cache
def rank_encoding():
    ranks = {t: r for r, t in enumerate(words.rank_file(bpe.RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_ranks(text):
    return rank_encoding().encode_ordinary(text)


@pytest.mark.parametrize("core", [True, False])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_by_word_equals_the_library(name, core):
    own = words.LibraryWords(public_tokenizers.path(name))
    assert own.core is not None
    if not core:
        own.core = None
    coder, plain = words.WordIds(own.cut, own), library(name)
    for texts in (fuzz(1500), fuzz(300)):
        assert words.id_lists(coder, pa.array(texts)).to_pylist() == [plain(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_the_library_makes_every_token_of_its_own_text(name):
    """What merging by rank relies on: a token's text alone becomes that token, and ranks follow the merges."""
    own = words.LibraryWords(public_tokenizers.path(name))
    vocab = own.tokenizer.get_vocab(with_added_tokens=False)
    marked = {t.removesuffix("</w>") + ("</w>" if t.endswith("</w>") else "") for t in vocab}
    assert len(marked) == len(vocab)
    for token, i in vocab.items():
        if own.end and not token.endswith("</w>") or token.startswith("<|"):
            continue  # the library ends every word; such tokens stand inside words, see below
        assert [t.id for t in own.tokenizer.model.tokenize(token.removesuffix("</w>") if own.end else token)] == [i], token
    if own.end:  # inside a word: the token before each letter that can end one gives the token or crosses its border
        inside = [t for t in vocab if not t.endswith("</w>") and not t.startswith("<|") and t != "ÿ"]  # no text has byte 255
        letters = words._byte_letters()
        back = {c: bytes([b]) for b, c in letters.items()}
        rnd = random.Random(3)
        for token in rnd.sample(inside, 8000):
            for last in rnd.choices("aeinstz.!9", k=3):
                raw = b"".join(back[c] for c in token + last) + own.end
                ids = own.of_rank[own.core.encode_single_piece(raw)].tolist()
                assert ids == [t.id for t in own.tokenizer.model.tokenize(token + last)], token


def test_words_of_random_letters_equal_the_library():
    rnd = random.Random(8)
    made = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(1, 30))) for _ in range(4000)]
    made += ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéàßÉ'.,-=_09", k=rnd.randint(1, 40))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, plain = words.LibraryWords(public_tokenizers.path(name)), library(name)
        ids, lengths = own(made + [f" {w}" for w in made if not own.end])
        got = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        assert got == [plain(w) for w in made + [f" {w}" for w in made if not own.end]]


@functools.cache
def replay():
    return bpe.ReplayedWords(bpe.Merges(words.rank_file(bpe.RANKS)), public_tokenizers.PATTERN)


def replayed(texts):
    ids, lengths = replay()(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


@pytest.mark.parametrize("texts", [[""], ["NULL"], [" one", " two", ""], ["null id text one two three"], ["a", "b"]])
def test_replay_without_anything_to_merge(texts):
    assert replayed(texts) == [by_ranks(t) for t in texts]


@pytest.mark.parametrize("made", ["x", "ab", "abcabd", "=", "the", "aab", "é", "Ĳ", "lolol", "0", "\u2003"])
def test_replay_of_long_words(made):
    """Whatever repeats, the time grows in proportion; checked against the library on a length that it can take."""
    replay()
    start = time.perf_counter()
    long = replayed([made * (300_000 // len(made))])[0]
    assert time.perf_counter() - start < 8
    assert rank_encoding().decode(long) == made * (300_000 // len(made))
    short = [made * k for k in (1, 2, 3, 5, 64, 333, 1500)]
    assert replayed(short) == [by_ranks(t) for t in short]


def test_replay_of_random_long_words():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(letters, k=3000)) for letters in ("ab", "etaoinshrdlu", "xyz", "=-", "abcdefghijklmnopqrstuvwxyzABC") for _ in range(4)]
    assert replayed(texts) == [by_ranks(t) for t in texts]


def test_replay_equals_one_word_at_a_time():
    coder = words.WordIds(words.byte_words, bpe.ReplayedWords(bpe.Merges(words.rank_file(bpe.RANKS)), public_tokenizers.PATTERN))
    texts = fuzz(1500)
    ranks = {t: r for r, t in enumerate(words.rank_file(bpe.RANKS))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert words.id_lists(coder, pa.array(texts)).to_pylist() == [plain.encode_ordinary(t or "") for t in texts]


def test_replay_when_a_merge_opens_a_lower_rank():
    """(ab, c) joins into a token of a lower rank than ab itself."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"aab", b"bc"]
    ranks = {t: r for r, t in enumerate(tokens)}
    plain = tiktoken.Encoding("toy", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    pieces = ["".join(rnd.choices("aabbc", k=rnd.randint(1, 12))) for _ in range(400)]
    ids, sizes = bpe.ReplayedWords(bpe.Merges(tokens), r"(?s).+")(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain.encode_ordinary(p) for p in pieces]


def test_bpe_query(spark, folder, docs):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for d, t in docs:
        ids = by_ranks(t or "") if len(t or "") < 20_000 else library("byte_bpe_50k.json")(t)
        expected[d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    rows = bpe.op2_byte_bpe(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected


def test_corpus_wide_replay_equals_the_replay_by_chunks(spark, folder, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 30_000)
    monkeypatch.setattr(bpe, "SPELL_CODES", 500)
    every = lambda df: Counter((r.doc_id, tuple(r.ids)) for r in df.collect())
    docs = documents(spark, folder)
    assert every(bpe.encode(docs, ["doc_id"], "text")) == every(bpe.encode(docs, ["doc_id"], "text", corpus_wide=True))


def test_containers_query(spark, folder, docs):
    plain = library("word_bpe_49k.json")
    rows = sorted(token_files.op9_token_id_output(spark, folder).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    expected = Counter()
    for d, t in docs:
        ids = np.array(plain(t) + [2], "<u4")
        expected[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected


def test_container_round_trip_and_dictionary_hash():
    rng = np.random.default_rng(0)
    lists = [rng.zipf(1.3, n).clip(max=49_000).astype(np.uint16) for n in (5, 0, 300, 4000, *[80] * 40)]
    dictionary = token_files.train_dictionary([x.tobytes() for x in lists])
    assert dictionary
    import zstandard
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True).compress
    keys = [None, *range(len(lists) - 1)]
    box = token_files.Container(
        token_files.write_container([(k, len(x), pack(x.tobytes())) for k, x in zip(keys, lists)], dictionary, 2), dictionary)
    assert [box.key(i) for i in range(len(box))] == keys
    assert all((box.ids(i) == x).all() for i, x in enumerate(lists))
    with pytest.raises(ValueError):
        token_files.Container(bytes(box.data), b"another")


def test_long_documents_get_containers_of_their_own(spark, folder, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CONTAINER_BYTES", 2000)
    target = str(tmp_path / "ids")
    token_files.write_ids(documents(spark, folder), "doc_id", "text", target)
    assert spark.read.parquet(f"{target}/containers").where("part > 0").count() > 0
    rows = sorted(token_files.read_ids(spark, target).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) // 4 for r in rows])[:-1].tolist()]


@pytest.mark.parametrize("lengths", [[2048] * 9 + [5] * 3, [1] * 5000, [1025] * 7, [], [700, 700, 648, 2000, 40, 8]])
def test_plan_places_every_piece_once(lengths):
    check_plan(Counter(lengths))


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, rng.lognormal(6, 1.2, 30_000).astype(int) + 1)
    used = check_plan(Counter(lengths.tolist()))
    assert used <= 1.002 * lengths.sum() / 2048 + 1


def check_plan(histogram):
    sequences = defaultdict(list)
    for length, first, end, sequence, offset in packing.plan(dict(histogram)):
        for rank in range(first, end):
            sequences[sequence + rank - first].append((offset, length))
    assert Counter(n for s in sequences.values() for _, n in s) == histogram
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 2048
    return len(sequences)


def test_least_squares_fit_takes_what_fits():
    rows = packing.patterns(np.array([1000, 1048, 2048, 600, 848]), 2048)
    assert {tuple(r) for r in rows.tolist()} == {(2048, 0, 0), (1048, 1000, 0), (848, 600, 600)}
    histogram = np.zeros(2049)
    histogram[[1000, 1048, 2048, 600, 848]] = [30, 30, 7, 40, 20]
    counts = dict(zip(map(tuple, rows.tolist()), packing.fit(rows, histogram, 2000)))
    assert counts == pytest.approx({(2048, 0, 0): 7, (1048, 1000, 0): 30, (848, 600, 600): 20}, abs=0.01)


def packed_documents(rows, docs):
    """Check the pieces and places in `rows` against ids of (doc_id, text)."""
    plain = library("byte_bpe_50k.json")
    expected = Counter()
    for d, t in docs:
        ids = np.array(plain(t) + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
            expected[d, p, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 2048
    return len(sequences)


def test_packing_query(spark, folder, docs):
    rows = packing.op10_best_fit_packing(spark, folder).collect()
    assert packed_documents(rows, docs) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_sequences_hold_the_ids(spark, folder):
    pieces = packing.pieces(documents(spark, folder).where("doc_id < 40"), ["doc_id"], "text")
    packed = packing.pack(pieces, "length", ["doc_id", "piece"])
    every = lambda rows: Counter(i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist())
    rows = packing.sequences(packed).collect()
    assert every(rows) == every(pieces.collect()) and max(len(r.ids) for r in rows) <= 4 * 2048


def test_empty(spark, empty):
    for query in (bpe.op2_byte_bpe, token_files.op9_token_id_output, packing.op10_best_fit_packing):
        assert query(spark, empty).count() == 0


def test_smaller_blocks_of_texts_give_the_same_ids():
    texts = pa.array(["some words here", None, "", "and a longer text of words " * 20, "end"])
    whole = list(words.id_blocks(packing.library_ids(packing.BYTES), texts, 0))
    cut = list(words.id_blocks(packing.library_ids(packing.BYTES), texts, 0, 30))
    assert len(whole) == 1 and len(cut) > 2 and packing.BLOCK_BYTES < words.BLOCK_BYTES
    assert np.concatenate([ids for _, ids, _ in cut]).tolist() == whole[0][1].tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_slices_of_a_block_give_the_same_ids(name):
    texts = pa.array(["some words here", None, "", "and a longer text of words " * 20, *fuzz(300), "end"])
    coder = words.library_ids(public_tokenizers.path(name))
    (_, ids, bounds), = words.id_blocks(coder, texts, 7)
    parts = list(words.id_blocks(coder, texts, 7, most_words=40))
    assert len(parts) > 5 and [at for at, _, _ in parts] == np.cumsum([0, *[len(b) - 1 for _, _, b in parts]])[:-1].tolist()
    assert np.concatenate([i for _, i, _ in parts]).tolist() == ids.tolist()
    assert np.concatenate([np.diff(b) for _, _, b in parts]).tolist() == np.diff(bounds).tolist()


def test_ids_of_a_block_are_laid_out_in_slices():
    """The 8 MB of a block give millions of ids; the worker holds those of a slice."""
    texts = pa.array(["some words of a text " * 400] * 800)
    sizes = [len(ids) for _, ids, _ in words.id_blocks(words.library_ids(token_files.WORDS), texts, 2)]
    sliced = [sum(n) for _, n, _ in token_files._serials(token_files.WORDS, texts, 2, 2)]
    assert sum(sliced) == sum(sizes) and max(sizes) > 1_000_000 and max(sliced) < 200_000


def test_ids_of_words_are_listed_for_some_words_at_a_time(monkeypatch):
    own = words.LibraryWords(token_files.WORDS)
    names = [f"w{i} É"[:2 + i % 4] for i in range(500)]
    ids, lengths = own(names)
    seen, listed = [], own._listed
    monkeypatch.setattr(words, "LISTED_WORDS", 64)
    monkeypatch.setattr(own, "_listed", lambda some: seen.append(len(some)) or listed(some))
    again = own(names)
    assert seen == [64] * 7 + [52] and again[0].tolist() == ids.tolist() and again[1].tolist() == lengths.tolist()
    assert [x.tolist() for x in own([])] == [[], []]


def test_a_row_group_of_containers_is_bounded(spark, tmp_path, monkeypatch):
    """A row is a whole container, so a file of some of them must not be one page of one row group."""
    import pyarrow.parquet as pq
    monkeypatch.setattr(token_files, "CONTAINER_BYTES", 20_000)
    monkeypatch.setitem(token_files.CONTAINER_FILES, "parquet.block.size", 100_000)
    rnd = np.random.default_rng(1)
    rows = [(i, " ".join(map(str, rnd.integers(0, 10 ** 9, 1000).tolist()))) for i in range(200)]
    target = str(tmp_path / "ids")
    token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", target)
    groups = []
    for f in (tmp_path / "ids" / "containers").glob("*.parquet"):
        about = pq.ParquetFile(f).metadata
        groups += [about.row_group(g) for g in range(about.num_row_groups)]
    assert len(groups) > 2 and sum(g.num_rows for g in groups) > 10
    assert all(g.num_rows == 1 or g.total_byte_size < 200_000 for g in groups)
    assert {g.column(3).compression for g in groups} == {"UNCOMPRESSED"}
    found = {r.key: r.ids for r in token_files.read_ids(spark, target).collect()}
    plain = library("word_bpe_49k.json")
    assert len(found) == len(rows) and all(found[i] == np.array(plain(t) + [2], "<u4").tobytes() for i, t in rows[::100])
