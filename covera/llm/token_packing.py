"""Token ids in fixed-width bit-packed blocks.

Writing: documents are range-partitioned and sorted by doc_id, every partition
tokenises its texts in Arrow batches and packs the ids into blocks of whole
documents, about ``BLOCK`` ids each, with the least number of bits that holds
every id of the vocabulary.  A block is one binary value:

    bytes 0-3    magic ``TPK1``
    bytes 4-7    bits per id            (unsigned little-endian)
    bytes 8-15   documents in the block
    bytes 16-    documents + 1 offsets: ids before each document, in this block
    then         the ids, bit i of id k at stream bit k * bits + i

so document j of a block is read without touching the others, and the whole
block unpacks in numpy.  Blocks are rows of a Parquet table with their
partition and block numbers and the doc_ids; Spark writes and reads it, on
any store.  Reading adds the ids of earlier partitions and blocks to the
offsets, which gives every document's place in the whole sequence.

Words are looked up in a bounded cache per worker: the tokenizer drops white
space and no token crosses it, so a text's ids are those of its words.

Defined cases: a null text is an empty one and has the end id only; a null
doc_id comes first; equal doc_ids follow by the hash of their text; repeated
rows are written each; no rows give an empty table.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covera.session import ensure_checkpoint_dir

MAGIC = b"TPK1"
BLOCK = 65_536
#: Words that a worker remembers; beyond it, it forgets all and starts again.
CACHE_WORDS = 800_000
#: Bytes of text turned into ids at once.
AT_ONCE = 16_000_000
_SCHEMA = "part int, block long, doc_ids array<bigint>, n_ids long, payload binary"


# --- the format ------------------------------------------------------------

def width(vocabulary: int) -> int:
    """Least bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data, bits: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` - 1 of the stream; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        step = bits // 8
        return np.frombuffer(data, f"<u{step}", last - first, first * step).astype("<u4")
    lead = first * bits // 8
    raw = np.frombuffer(data, np.uint8, (last * bits + 7) // 8 - lead, lead)
    skip = first * bits - lead * 8
    flags = np.unpackbits(raw, bitorder="little")[skip:skip + (last - first) * bits].reshape(-1, bits)
    wide = np.zeros((last - first, 32), np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def pack_block(counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    return MAGIC + struct.pack("<IQ", bits, len(counts)) + offsets.tobytes() + pack_bits(ids, bits)


def block_offsets(payload) -> tuple[int, np.ndarray, memoryview]:
    """(bits, offsets, packed ids) of a block."""
    if bytes(payload[:4]) != MAGIC:
        raise ValueError("not a token block")
    bits, docs = struct.unpack_from("<IQ", payload, 4)
    offsets = np.frombuffer(payload, "<u8", docs + 1, 16).astype(np.int64)
    return bits, offsets, memoryview(payload)[16 + 8 * (docs + 1):]


def document_ids(payload, j: int) -> np.ndarray:
    """Random access: the ids of document ``j`` of a block."""
    bits, offsets, data = block_offsets(payload)
    return unpack_bits(data, bits, int(offsets[j]), int(offsets[j + 1]))


# --- tokenising ------------------------------------------------------------

class WordIds:
    """Ids of words, through the tokenizer once per remembered word.

    The tokenizer's words are runs of letters, single digits and runs of other
    characters, so letters with ASCII marks after them are the ids of the
    letters and of the marks (a mark that may begin with a contraction's
    apostrophe is left to the tokenizer).  Words of letters alone are joined by
    spaces and told apart by the ends of words among the ids.
    """

    JOIN = 500
    MARKED = re.compile(r"([a-z]+)([!-&(-/:-@\[-`{-~]+)")

    def __init__(self, tokenizer_json: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.end_id = Tokenizer.from_str(tokenizer_json), end_id
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self):
        # Slot 0 is the end of a document, slot 1 the empty word.
        self.slot = {"": 1}
        self.flat, self.start, self.count = np.array([self.end_id], np.uint32), np.array([0, 1]), np.array([1, 0])

    def _add(self, words, counts, ids):
        at, base = len(self.start), len(self.flat)
        self.slot.update(zip(words, range(at, at + len(words))))
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.start = np.concatenate([self.start, base + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add_asked(self, words: list[str]):
        if words:
            lists = self._ask(words)
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            self._add(words, counts, np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum())))

    def learn(self, words: list[str]):
        """Give every unknown word a slot."""
        known, marked, letters, rest = self.slot, [], {}, {}
        split = self.MARKED.fullmatch
        for w in words:
            if w in known:
                continue
            if m := split(w):
                stem, mark = m.groups()
                marked.append((w, stem, mark))
                if stem not in known:
                    letters[stem] = None
                if mark not in known:
                    rest[mark] = None
            elif w.isalpha():
                letters[w] = None
            else:
                rest[w] = None
        names = list(letters)
        parts = [names[i:i + self.JOIN] for i in range(0, len(names), self.JOIN)]
        told = []
        for part, ids in zip(parts, self._ask([" ".join(p) for p in parts])):
            ids = np.array(ids, np.uint32)
            ends = np.nonzero(self.is_end[ids])[0] + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                told.append((part, np.diff(ends, prepend=0), ids))
            else:  # lower case made marks of some letter
                self._add_asked(part)
        if told:
            self._add([w for part, _, _ in told for w in part], *(np.concatenate([t[k] for t in told]) for k in (1, 2)))
        self._add_asked(list(rest))
        if marked:
            slots = np.array([(known[stem], known[mark]) for _, stem, mark in marked]).ravel()
            self._add([w for w, _, _ in marked], self.count[slots].reshape(-1, 2).sum(axis=1), self._ids(slots))

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        count = self.count[slots]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, len(self.flat)) < 1 << 31 else np.int64
        at = np.repeat((self.start[slots] - ends + count).astype(small), count)
        at += np.arange(total, dtype=small)
        return self.flat[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids), the end id after every text."""
        texts = pc.fill_null(texts, "")
        # The tokenizer lowers case itself; a marker such as <|...|> is looked for before that.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        if len(self.slot) > CACHE_WORDS:
            self.forget()
        names = words.dictionary.to_pylist()
        self.learn(names)
        of_name = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.cumsum(sizes + 1) - 1
        slots = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
        inside = np.ones(len(slots), bool)
        inside[last] = False
        slots[inside] = of_name[words.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(self.count[slots])[last] if len(last) else np.empty(0, np.int64)
        return np.diff(ends, prepend=0), self._ids(slots)


_WORKER: dict[tuple, WordIds] = {}


def _tokens(json: str, end_id: int) -> WordIds:
    key = (hash(json), end_id)
    if key not in _WORKER:
        _WORKER[key] = WordIds(json, end_id)
    return _WORKER[key]


# --- Spark -----------------------------------------------------------------

def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write the ids of all texts, in ascending doc_id order, as packed blocks."""
    from tokenizers import Tokenizer
    with open(tokenizer_path, encoding="utf-8") as f:
        json = f.read()
    bits = width(max(Tokenizer.from_str(json).get_vocab_size(with_added_tokens=True), end_id + 1))
    sent = docs.sparkSession.sparkContext.broadcast(json)

    def run(batches):
        tokens, part, block = _tokens(sent.value, end_id), TaskContext.get().partitionId(), 0
        keys, counts, held, size = [], [], [], 0

        def rows():
            payload = pack_block(np.array(counts), np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([size], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "block", "doc_ids", "n_ids", "payload"])

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                # About AT_ONCE bytes, or one text.
                done = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + AT_ONCE)))
                lens, got = tokens.encode(texts.slice(at, to - at))
                begin = 0
                for key, n in zip(ids[at:to], lens.tolist()):
                    keys.append(key)
                    counts.append(n)
                    held.append(got[begin:begin + n])
                    begin, size = begin + n, size + n
                    if size >= BLOCK:
                        yield rows()
                        keys, counts, held, size, block = [], [], [], 0, block + 1
                at = to
        if keys:
            yield rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(run, _SCHEMA).write.mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written blocks."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)

    def run(batches):
        for b in batches:
            starts, counts, crcs, docs = [], [], [], []
            for payload in b.column("payload"):
                bits, offsets, data = block_offsets(payload.as_buffer())
                ids = unpack_bits(data, bits, 0, int(offsets[-1]))
                crcs += [zlib.crc32(ids[s:e]) for s, e in pairwise(offsets.tolist())]
                starts.append(offsets[:-1])
                counts.append(np.diff(offsets))
                docs.append(len(offsets) - 1)
            part, block = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), docs) for c in ("part", "block"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(block, pa.int64()), b.column("doc_ids").flatten(),
                 pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(counts), pa.int64()),
                 pa.array(crcs, pa.int64())], names=["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = blocks.mapInArrow(run, "part int, block long, doc_id long, start long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", "block", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written partition: the window runs over that many.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "block", (F.col("_inside") + F.col("_before")).alias("_shift"))
    return docs.join(shift, ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("_shift")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the tokens to a new table in the checkpoint folder and read them back."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(spark, path)
