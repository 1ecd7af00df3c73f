"""Target-distribution importance resampling over hashed n-grams, by prefix CRCs.

A text's words, joined by single spaces, are scanned once with a running
CRC-32, kept at every word's start and end.  For two prefixes A and AB

    crc(AB) = shift(crc(A), |B|) xor crc(B)

where ``shift`` multiplies by x^(8 |B|) in GF(2)[x] modulo the CRC polynomial
(the effect of |B| zero bytes).  So the CRC of any n-gram B comes from the two
prefixes at its ends: no n-gram is ever put together or scanned again.  The
shift is applied to whole arrays, one set of four byte tables per binary digit
of the length.  A batch of texts shares one running CRC; n-grams that would
cross from one text into the next are left out.

1. Counts: every task adds its texts' n-grams up in one array of buckets; the
   arrays' non-zero entries are summed per bucket (at most ``BUCKETS`` rows a
   task), for the documents and for the target.
2. Gains: one number per bucket.  The table has ``BUCKETS`` rows whatever the
   input, so it goes to the driver and with the tasks.
3. Weights: a second pass adds up each text's gains; a Gumbel number that
   depends on the id alone makes the draw one without replacement, weighted by
   the ratio of the two distributions; the highest scores are numbered by a
   range-partitioned scan.

Defined cases: a null text has no words; a text without words has no features
and weight 0; a null id draws the number of an empty id and is last among
ties; rows equal in score and id take neighbouring ranks; without documents
there are no rows, without target texts all counts of the target are 0; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covera.llm.common import ordered_scan
from covera.session import cut_lineage

BUCKETS, ORDERS = 10_000, 3
#: Bytes of text that are scanned at once; a longer text is scanned in pieces that share the words at the seam.
PIECE = 2 << 20
#: Reflected form of the CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320
_SPACE, _END = 32, 10


def _byte_classes() -> bytes:
    """A-Z in lower case; every other ASCII byte that is no letter or digit becomes a space."""
    ascii_word = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
    lower = bytes(range(256)).lower()
    return bytes(c if c >= 0x80 or c in ascii_word else _SPACE for c in lower)


CLASSES = _byte_classes()


@lru_cache(maxsize=None)
def shift_tables(digit: int) -> np.ndarray:
    """Four tables of 256 entries: a CRC's bytes after 2 ** digit zero bytes."""
    if digit == 0:
        column = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            column = np.where(column & 1, (column >> 1) ^ np.uint32(POLYNOMIAL), column >> 1).astype(np.uint32)
        tables = [column] + [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(3)]
        return np.stack(tables)
    half = shift_tables(digit - 1)
    singles = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    return np.stack([_through(half, _through(half, s)) for s in singles])


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24])


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Every CRC after ``length`` zero bytes."""
    crc = crc.copy()
    for digit in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero((length >> digit) & 1)
        crc[some] = _through(shift_tables(digit), crc[some])
    return crc


def ngram_crcs(words: list[bytes], text_of: np.ndarray, orders: int = ORDERS, fresh: int = 0):
    """For n = 1..orders: (CRCs, their texts) of all runs of n words of one text that end at word ``fresh`` or later."""
    crc32, running, starts, ends = zlib.crc32, 0, [], []
    for w in words:
        starts.append(running)
        running = crc32(w, running)
        ends.append(running)
        running = crc32(b" ", running)
    starts, ends = np.array(starts, np.uint32), np.array(ends, np.uint32)
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    for n in range(1, orders + 1):
        if len(words) < n:
            return
        first = np.arange(len(words) - n + 1)
        last = first + n - 1
        whole = (text_of[first] == text_of[last]) & (last >= fresh)
        first, last = first[whole], last[whole]
        yield ends[last] ^ shift(starts[first], begin[last + 1] - 1 - begin[first]), text_of[first]


def _scan(texts: list[bytes | None], orders: int = ORDERS):
    """(CRCs, their texts, n) over all texts, and (None, texts of the words, 0), in pieces of bounded size."""
    words, owner, room = [], [], 0

    def flush():
        if words:
            of = np.array(owner, np.int64)
            yield None, of, 0
            for n, (crc, text) in enumerate(ngram_crcs(words, of, orders), 1):
                yield crc, text, n

    for i, text in enumerate(texts):
        if text and len(text) > PIECE:
            yield from _scan_long(text, i, orders)
            continue
        mine = text.translate(CLASSES).split() if text else []
        words += mine
        owner += [i] * len(mine)
        room += len(text or b"")
        if room > PIECE:
            yield from flush()
            words, owner, room = [], [], 0
    yield from flush()


def _scan_long(text: bytes, i: int, orders: int):
    """A text beyond a piece: pieces end between words, and the last words of one go before the next."""
    kept, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        # The cut moves on to the end of the word it falls into.
        while end < len(text) and CLASSES[text[end]] != _SPACE:
            end += 1
        new = text[at:end].translate(CLASSES).split()
        at = end
        words = kept + new
        yield None, np.full(len(new), i), 0
        for n, (crc, of) in enumerate(ngram_crcs(words, np.full(len(words), i), orders, fresh=len(kept)), 1):
            yield crc, of, n
        kept = words[-(orders - 1):] if orders > 1 else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("_text").cast(pa.binary()).to_pylist()


def _text(docs: DataFrame) -> Column:
    return F.col("text").cast("string").alias("_text")


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """(bucket, n) of all n-grams of all texts, repeats included; buckets without any are absent."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for crc, _, n in _scan(_texts(batch), orders):
                if n:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select(_text(docs)).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket, add-one smoothed."""
    def dense(counts):
        out = [0] * buckets
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = dense(source), dense(target)
    big_s, big_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((t[i] + 1) * (big_s + buckets) / ((s[i] + 1) * (big_t + buckets))))
                     for i in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", orders: int = ORDERS) -> DataFrame:
    """``key``, n_words, n_features and weight (sum of gains) of every row."""
    rows = docs.select(key, _text(docs))
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            n_words, n_features, weight = (np.zeros(count, np.int64) for _ in range(3))
            for crc, of, n in _scan(_texts(batch), orders):
                if not n:
                    n_words += np.bincount(of, minlength=count)
                    continue
                n_features += np.bincount(of, minlength=count)
                np.add.at(weight, of, gain[crc % np.uint32(buckets)])
            yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, (n_words, n_features, weight))],
                                             names=[key, "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = 42) -> Column:
    """floor(1000 g) for a Gumbel number g that depends on the seed and the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42,
             buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``.

    Drawn are floor(percent * N / 100) of the N texts of at least ``least`` words: the highest scores.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = cut_lineage(scored)
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    placed = ordered_scan(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], index="_place")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    columns = ("doc_id", "n_features", "weight", "score")
    return placed.select(*columns, rank.alias("rank")).unionByName(
        scored.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank")))
