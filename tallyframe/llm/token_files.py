"""Token ids in binary containers: a shared zstandard dictionary, every document compressed on its own, an offset index.

A container is one row of a Parquet table (cell, part, data), so Spark's committer makes it whole or not at all:

    magic  4s | version, id bytes: u16 | documents u32 | hash of the dictionary 32s
    per document: key i64 | has key u8 | ids u32 | offset of its frame u64;  then the end of the last frame u64
    frames

The dictionary is a table of its own beside the containers. All numbers are little-endian.
"""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_batches, documents, forget_worker_state, ordered_cells, sampled, shared_folder, sized
from tallyframe.llm.registry import query
from tallyframe.llm.words import id_blocks, library_ids

WORDS = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
# The dictionary is trained on about so many documents, of each at most so many bytes from a place that follows its hash.
TRAIN_DOCS = 1000
TRAIN_BYTES = 16 << 10
# It holds so many bytes.
DICTIONARY_BYTES = 64 << 10
CONTAINER_BYTES = 32 << 20
LEVEL = 3
# Ids of so many words are laid out at a time: a worker's memory grows with them, beside a JVM that has reached its full heap.
SLICE_WORDS = 1 << 17
# Frames are compressed, and a row is a whole container: Parquet looks at its sizes after each row instead of 100, so writers
# and readers hold a row group of about 8 MB (a larger container is alone), whatever a file holds.
CONTAINER_FILES = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": 8 << 20,
                   "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
                   "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
_HEAD = "<4sHHI32s"
_ENTRY = np.dtype([("key", "<i8"), ("keyed", "u1"), ("ids", "<u4"), ("offset", "<u8")])


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary, or none where the samples are too few or too short to train one."""
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_container(docs: list[tuple], dictionary: bytes, id_bytes: int) -> bytes:
    """Bytes of a container from (key, number of ids, frame) in order."""
    entries = np.zeros(len(docs), _ENTRY)
    offset = 0
    for i, (key, n, frame) in enumerate(docs):
        entries[i] = (key or 0, key is not None, n, offset)
        offset += len(frame)
    head = struct.pack(_HEAD, b"TIDS", 1, id_bytes, len(docs), hashlib.sha256(dictionary).digest())
    return b"".join([head, entries.tobytes(), struct.pack("<Q", offset), *[f for _, _, f in docs]])


class Container:
    """Random access to the documents of one container; refuses a dictionary other than the one it was written with."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.id_bytes, n, mark = struct.unpack_from(_HEAD, data)
        if magic != b"TIDS" or version != 1:
            raise ValueError("not a token container")
        if mark != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        self.data, at = data, struct.calcsize(_HEAD)
        self.entries = np.frombuffer(data, _ENTRY, n, at)
        at += n * _ENTRY.itemsize
        self.ends = np.r_[self.entries["offset"], np.frombuffer(data, "<u8", 1, at)].astype(np.int64)
        self.frames = at + 8
        self.reader = zstandard.ZstdDecompressor(dict_data=_compression(dictionary))

    def __len__(self):
        return len(self.entries)

    def key(self, i: int) -> int | None:
        return int(self.entries["key"][i]) if self.entries["keyed"][i] else None

    def ids(self, i: int) -> np.ndarray:
        """Ids of document i; only its own frame is read."""
        frame = self.data[self.frames + self.ends[i]:self.frames + self.ends[i + 1]]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.id_bytes}").astype("<u4")


def _compression(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _serial(ids: np.ndarray, id_bytes: int) -> bytes:
    return ids.astype(f"<u{id_bytes}").tobytes()


def _serials(path: str, texts: pa.Array, end_id: int, id_bytes: int):
    """Per slice of the texts: the place of its first one, numbers of ids, and the ids of each text as bytes."""
    for at, ids, bounds in id_blocks(library_ids(path), texts, end_id, most_words=SLICE_WORDS):
        data, cuts = memoryview(_serial(ids, id_bytes)), (bounds * id_bytes).tolist()
        yield at, np.diff(bounds), [data[a:z] for a, z in zip(cuts, cuts[1:])]


def write_ids(df: DataFrame, key: str, text: str, folder: str, path: str = WORDS, end_id: int = END_ID,
              id_bytes: int = 2, train_docs: int = TRAIN_DOCS) -> None:
    """Write the ids of all texts, each document ended by `end_id`, to `folder` in ascending order of `key`.

    A null text is empty, a null key comes first, rows of one key follow a hash of their text. Cells of neighbouring keys
    are written by one task each; a cell is cut into containers of about CONTAINER_BYTES, and a longer document is alone
    in one. An empty table gives no containers. Ids must be below 256 ** id_bytes. Other columns of `df` are not read.
    """
    spark = df.sparkSession
    docs = bounded_batches(df).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    mark = F.xxhash64("text")

    def samples(batches):
        for b in batches:
            for _, _, serials in _serials(path, b.column(0), end_id, id_bytes):
                starts = [zlib.crc32(d) % (len(d) // id_bytes) * id_bytes if len(d) > TRAIN_BYTES else 0 for d in serials]
                yield pa.RecordBatch.from_arrays([pa.array(
                    [bytes(d[min(a, max(0, len(d) - TRAIN_BYTES)):][:TRAIN_BYTES]) for a, d in zip(starts, serials)], pa.binary())], names=["ids"])

    # Equal texts are sampled together, so they are made one first; the limit holds where hashes fall unevenly.
    few = sampled(docs.select("text"), "text", train_docs).distinct().mapInArrow(samples, "ids binary").limit(2 * train_docs)
    dictionary = train_dictionary([r["ids"] for r in few.collect()])
    spark.createDataFrame([(dictionary,)], "dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    cell, _ = ordered_cells(docs, "key")

    def compress(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_compression(dictionary), write_content_size=True).compress
        for b in batches:
            for at, n, serials in _serials(path, b.column(3), end_id, id_bytes):
                frames = pa.array([pack(ids) for ids in serials], pa.binary())
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(n)) for c in b.columns[:3]], pa.array(n, pa.int64()), frames],
                                                 names=["cell", "key", "mark", "n", "frame"])

    def assemble(batches):
        forget_worker_state()  # workers come here from the texts
        waiting, size, at, part = [], 0, None, 0

        def flush():
            return pa.RecordBatch.from_pylist([{
                "cell": at, "part": part, "n_ids": sum(n for _, n, _ in waiting),
                "data": write_container(waiting, dictionary, id_bytes)}],
                schema=pa.schema([("cell", pa.int64()), ("part", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]))

        for b in batches:
            for c, k, n, frame in zip(*(b.column(i).to_pylist() for i in range(4))):
                if waiting and (c != at or size > CONTAINER_BYTES):
                    yield flush()
                    waiting, size, part = [], 0, part + 1 if c == at else 0
                at = c
                waiting.append((k, n, frame))
                size += len(frame)
        if waiting:
            yield flush()

    frames = docs.select(cell.alias("cell"), "key", mark.alias("mark"), "text") \
        .mapInArrow(compress, "cell long, key long, mark long, n long, frame binary")
    frames.repartition("cell").sortWithinPartitions("cell", "key", "mark").select("cell", "key", "n", "frame") \
        .mapInArrow(assemble, "cell long, part long, n_ids long, data binary").write.options(**CONTAINER_FILES).parquet(f"{folder}/containers")


def read_ids(spark, folder: str) -> DataFrame:
    """Documents of the containers below `folder`: key, start (ids of all documents before it), ids (binary, 32-bit)."""
    dictionary = spark.read.schema("dictionary binary").parquet(f"{folder}/dictionary").first()["dictionary"]
    files = spark.read.schema("cell long, part long, n_ids long, data binary").parquet(f"{folder}/containers")
    # At most MAX_CELLS sums meet in one task; the parts of a cell are added up on their own.
    cells = files.groupBy("cell").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("cell", "part", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before")) \
        .join(cells, "cell").select("cell", "part", (F.col("before") + F.col("base")).alias("first"))

    def run(batches):
        forget_worker_state()  # workers may come here from the texts
        for b in batches:
            for cell, part, data in zip(*(b.column(i) for i in range(3))):
                box = Container(data.as_buffer().to_pybytes(), dictionary)
                step = max(1, (2 << 20) // max(1, int(box.entries["ids"].mean())))
                at = np.r_[0, np.cumsum(box.entries["ids"].astype(np.int64))]
                for a in range(0, len(box), step):
                    rows = range(a, min(a + step, len(box)))
                    ids = [box.ids(i).tobytes() for i in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell.as_py()] * len(rows), pa.int64()), pa.array([part.as_py()] * len(rows), pa.int64()),
                         pa.array([box.key(i) for i in rows], pa.int64()), pa.array(at[rows.start:rows.stop], pa.int64()),
                         pa.array(ids, pa.binary())], names=["cell", "part", "key", "own", "ids"])

    docs = files.select("cell", "part", "data").mapInArrow(run, "cell long, part long, key long, own long, ids binary")
    return docs.join(sized(starts), ["cell", "part"]).select("key", (F.col("own") + F.col("first")).alias("start"), "ids")


@query()
def op9_token_id_output(spark, folder):
    target = shared_folder(spark)
    write_ids(documents(spark, folder), "doc_id", "text", target)
    back = read_ids(spark, target)
    return back.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
