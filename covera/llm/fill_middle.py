"""Fill-in-middle transformation with a sparse exception index.

Texts stay UTF-8 bytes.  For the bytes of an Arrow batch the index records
only the characters of more than one byte: where they start and how many
bytes beyond one they take.  A cut given in code points is that number plus
the excess of the exceptions before it, found by ``searchsorted``; a byte cut
goes back the same way.  Spans of ASCII need no entry: there both counts move
in step.  One index serves all texts of a batch, because a text's start is a
byte cut like any other.

``fill_middle`` cuts every text at two code points and writes it plain, as
prefix-suffix-middle or suffix-prefix-middle; ``restore`` finds the marks in
the output, puts the text back together and converts its byte cuts to code
points again.  Both run batch by batch: nothing is shuffled.

Defined cases: a null text is an empty one; empty texts and texts that hold a
mark stay plain, and their cuts are null; a null id is hashed as no digits;
repeated rows get equal outputs; no rows give no rows; columns not named are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are indexed at once, unless one text alone has more.
PIECE = 16 << 20


class ExceptionIndex:
    """Code points against bytes of a buffer, by its multibyte characters alone."""

    def __init__(self, data: np.ndarray):
        starts = np.flatnonzero(data >= 0xC0)
        lead = data[starts]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.byte_starts = starts
        self.point_starts = starts - self.before[:-1]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte cut (a cut between characters)."""
        return at - self.before[np.searchsorted(self.byte_starts, at, side="left")]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return at + self.before[np.searchsorted(self.point_starts, at, side="left")]


def _pieces(column: pa.Array):
    """(first row, offsets, bytes) of slices of a text column, of about ``PIECE`` bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1
        end = min(len(column), max(first + 1, end))
        yield first, offsets[first:end + 1] - offsets[first], data[offsets[first]:offsets[end]]
        first = end


def _texts(parts: list[list], sizes: np.ndarray) -> pa.Array:
    """A text array whose rows are the joined parts."""
    data = b"".join([p for row in parts for p in row])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of the hex SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, key: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """``key``, n, form, prefix_chars, middle_chars and output of every row.

    ``rate`` per cent of the texts are cut, ``spm`` per cent of these are
    written suffix first; the choices follow from ``seed`` and the key.
    """
    rows = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
                       *[d.alias(f"_h{i}") for i, d in enumerate(draws(F.col(key), seed), 1)])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.large_string())])

    def cut(batch: pa.RecordBatch, first: int, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        count = len(offsets) - 1
        h1, h2, h3, h4 = (batch.column(f"_h{i}").slice(first, count).to_numpy() for i in range(1, 5))
        index = ExceptionIndex(data)
        point = index.to_points(offsets)
        n = np.diff(point)
        a, b = h1 % (n + 1), h2 % (n + 1)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        at, to = index.to_bytes(point[:-1] + lo), index.to_bytes(point[:-1] + hi)
        view = data.tobytes()
        plain = (n == 0) | (h3 % 100 >= rate)
        first_suffix = h4 % 100 < spm
        forms, parts = [], []
        for i, (s, x, y, e) in enumerate(zip(offsets[:-1].tolist(), at.tolist(), to.tolist(), offsets[1:].tolist())):
            plain[i] = plain[i] or any(view.find(m, s, e) >= 0 for m in marks)
            if plain[i]:
                forms.append("plain")
                parts.append([view[s:e]])
            elif first_suffix[i]:
                forms.append("spm")
                parts.append([marks[1], view[y:e], marks[0], view[s:x], marks[2], view[x:y]])
            else:
                forms.append("psm")
                parts.append([marks[0], view[s:x], marks[1], view[y:e], marks[2], view[x:y]])
        added = np.where(plain, 0, sum(map(len, marks)))
        return pa.RecordBatch.from_arrays(
            [pa.array(n), pa.array(forms, pa.string()), pa.array(lo, mask=plain), pa.array(hi - lo, mask=plain),
             _texts(parts, np.diff(offsets) + added)], schema=schema)

    def run(batches):
        for batch in batches:
            for first, offsets, data in _pieces(batch.column("_text")):
                out = cut(batch, first, offsets, data)
                keys = batch.column(key).slice(first, out.num_rows)
                yield pa.RecordBatch.from_arrays([keys, *out.columns], names=[key, *schema.names])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, n long, form string, prefix_chars long, "
                                "middle_chars long, output string")


def restore(formatted: DataFrame) -> DataFrame:
    """``formatted`` (columns form and output among others) with text, and the cuts found in the output:
    cut_prefix and cut_middle in code points (null if plain)."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def put_back(forms, offsets, data):
        view = data.tobytes()
        parts, sizes, cuts = [], np.zeros(len(forms), np.int64), np.zeros((len(forms), 4), np.int64)
        for i, (form, a, e) in enumerate(zip(forms, offsets[:-1].tolist(), offsets[1:].tolist())):
            if form == "plain":
                parts.append([view[a:e]])
                sizes[i] = e - a
                continue
            # No mark can begin in one span and end in the next: each is found where it was written.
            second = view.find(s if form == "psm" else p, a, e)
            third = view.find(m, a, e)
            one, two = (a + len(p), second), (second + len(s), third)
            prefix, suffix = (one, two) if form == "psm" else (two, one)
            middle = (third + len(m), e)
            parts.append([view[x:y] for x, y in (prefix, middle, suffix)])
            sizes[i] = sum(y - x for x, y in (prefix, middle, suffix))
            cuts[i] = (*prefix, *middle)
        points = ExceptionIndex(data).to_points(cuts.ravel()).reshape(-1, 4)
        plain = np.array([f == "plain" for f in forms], bool)
        return [_texts(parts, sizes), pa.array(points[:, 1] - points[:, 0], mask=plain),
                pa.array(points[:, 3] - points[:, 2], mask=plain)]

    names = formatted.columns
    added = ["text", "cut_prefix", "cut_middle"]

    def run(batches):
        for batch in batches:
            for first, offsets, data in _pieces(batch.column("output")):
                piece = batch.slice(first, len(offsets) - 1)
                new = put_back(piece.column("form").to_pylist(), offsets, data)
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*names, *added])

    types = dict(formatted.dtypes)
    return formatted.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names)
                                + ", text string, cut_prefix long, cut_middle long")


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    back = restore(fill_middle(docs, "doc_id", seed).select("doc_id", "n", "form", "output"))
    return back.select("doc_id", "n", "form", F.col("cut_prefix").alias("prefix_chars"),
                       F.col("cut_middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("text", 256).alias("restored_sha256"))
