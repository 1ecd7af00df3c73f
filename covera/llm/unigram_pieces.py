"""SentencePiece encoding and decoding with a unigram model.

Encoding finds the segmentation of a text into pieces with the greatest sum
of log scores (Viterbi).  Pieces lie in a double-array trie over UTF-8 bytes
(``base`` and ``check``); a step reads one byte.  Many chunks of equal length
are walked side by side as numpy columns.  A character that no piece covers
costs ten below the least score and becomes its UTF-8 bytes (byte fallback).

White space: a space is the piece marker U+2581; one space is put before a
text and taken away again by decoding.  A U+2581 in the text itself goes
through byte fallback, so decoding gives back every text exactly.

No piece of the model crosses from a non-space to a space or a newline
(checked when the model is read), so a text is cut there and equal chunks are
solved once per worker; the cache is bounded.

Defined cases: a null or empty text has no pieces and decodes to the empty
text; lone surrogates cannot occur in UTF-8 columns; repeated rows are
encoded each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks that a worker remembers, chunk length that is solved in columns, texts' characters solved at once.
CACHE_CHUNKS, LONG, AT_ONCE = 600_000, 256, 2_000_000
UNKNOWN = -2


@dataclass
class Pieces:
    """A unigram model: the trie and what each id decodes to."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray      # piece id at a trie state, or -1
    score: np.ndarray      # by piece id
    byte_id: np.ndarray    # by byte; -1 without byte fallback
    bytes_of: list         # by piece id
    unknown_id: int
    unknown_score: float


def double_array(words: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value of the trie; state 0 is the root, the child of s by byte b is base[s] + b + 1."""
    children: list[dict[int, int]] = [{}]
    held = {}
    for word, v in zip(words, values):
        at = 0
        for b in word:
            nxt = children[at].get(b)
            if nxt is None:
                nxt = len(children)
                children.append({})
                children[at][b] = nxt
            at = nxt
        held[at] = v
    size = 4 * len(children) + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], todo = 0, [(0, 0)]
    # Nodes with one child take the first free place; those with more search on
    # from where earlier searches have found the array nearly full.
    free, crowded = 258, 258  # beyond any code, so that every place will do
    while todo:
        node, state = todo.pop()
        value[state] = held.get(node, -1)
        codes = sorted(b + 1 for b in children[node])
        if not codes:
            continue
        while check[free] >= 0:
            free += 1
        place, taken = max(free, crowded if len(codes) > 1 else 0), 0
        first = place
        while True:
            if place + 258 >= len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
            if check[place] >= 0:
                taken += 1
            elif all(check[place - codes[0] + c] < 0 for c in codes):
                break
            place += 1
        if len(codes) > 1 and place - first > 64 and (taken > 0.9 * (place - first) or place - first > 2_000):
            crowded = place
        start = place - codes[0]
        base[state] = start
        for c in codes:
            check[start + c] = state
        todo += [(children[node][c - 1], start + c) for c in codes]
    return tuple(np.array(x + [fill] * 258, np.int32) for x, fill in ((base, 0), (check, -1), (value, -1)))


def read_pieces(path: str) -> Pieces:
    """The pieces and scores of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor
    file = SentencePieceProcessor(model_file=path)
    pieces, scores, byte_id, known = [], [], np.full(256, -1, np.int64), []
    for i in range(file.vocab_size()):
        piece, plain = file.id_to_piece(i), b""
        if file.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            plain = bytes([int(piece[3:5], 16)])
        elif not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i)):
            plain = piece.replace(MARK, " ").encode()
            known.append(i)
        pieces.append(plain)
        scores.append(file.get_score(i))
    return build_pieces(pieces, scores, known, byte_id, file.unk_id())


def build_pieces(pieces: list[bytes], scores: list[float], known: list[int], byte_id, unknown_id: int) -> Pieces:
    for i in known:
        if re.search(rb"[^ ] |.\n|\n.", pieces[i], re.S):
            raise ValueError(f"piece {i} crosses a chunk boundary")
    usual = [scores[i] for i in known if scores[i] > -1e8]  # far lower scores only ban a piece
    base, check, value = double_array([pieces[i] for i in known], known)
    return Pieces(base, check, value, np.array(scores, np.float64), np.asarray(byte_id, np.int64), list(pieces),
                  unknown_id, (min(usual) if usual else 0.0) - 10)


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


def solve(model: Pieces, text: np.ndarray) -> np.ndarray:
    """Piece ids of many chunks of equal length (rows of bytes): an id at each piece's last byte, else -1."""
    n, length = text.shape
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
    for i in range(length):
        rows = np.nonzero(best[:, i] > -np.inf)[0]
        if not len(rows):
            continue
        chars = _char_bytes(text[rows, i])
        lone = np.ones(len(rows), bool)  # no piece is exactly the one character
        live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
        for j in range(i, length):
            nxt = model.base[state] + text[rows[live], j] + 1
            ok = model.check[nxt] == state
            live, state = live[ok], nxt[ok]
            if not len(live):
                break
            ids = model.value[state]
            hit = ids >= 0
            if hit.any():
                at, got = live[hit], ids[hit]
                lone[at[chars[at] == j + 1 - i]] = False
                _better(best, back, piece, rows[at], i, j + 1, model.score[got], got)
        left = np.nonzero(lone)[0]
        for size in (1, 2, 3, 4):
            r = rows[left[chars[left] == size]]
            if len(r) and i + size <= length:
                _better(best, back, piece, r, i, i + size, model.unknown_score, UNKNOWN)
    out = np.full((n, length), -1, np.int64)
    at = np.full(n, length)
    while (rows := np.nonzero(at > 0)[0]).size:
        end = at[rows]
        start, ids = back[rows, end], piece[rows, end]
        known = ids != UNKNOWN
        out[rows[known], end[known] - 1] = ids[known]
        for r, s, e in zip(rows[~known], start[~known], end[~known]):
            if (model.byte_id[text[r, s:e]] >= 0).all():
                out[r, s:e] = model.byte_id[text[r, s:e]]
            else:
                out[r, e - 1] = model.unknown_id
        at[rows] = start
    return out


def _better(best, back, piece, rows, start, end, gain, ids):
    score = best[rows, start] + gain
    more = score > best[rows, end]
    r = rows[more]
    best[r, end], back[r, end] = score[more], start
    piece[r, end] = ids if np.isscalar(ids) else ids[more]


def solve_long(model: Pieces, text: bytes) -> list[int]:
    """Piece ids of one long chunk."""
    n, base, check, value = len(text), model.base, model.check, model.value
    best, back, piece = [0.0] + [float("-inf")] * n, [0] * (n + 1), [UNKNOWN] * (n + 1)
    for i in range(n):
        if best[i] == float("-inf"):
            continue
        lead = text[i]
        char, lone, state = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), True, 0
        for j in range(i, n):
            nxt = int(base[state]) + text[j] + 1
            if check[nxt] != state:
                break
            state, got = nxt, int(value[nxt])
            if got >= 0:
                lone = lone and j + 1 - i != char
                if best[i] + model.score[got] > best[j + 1]:
                    best[j + 1], back[j + 1], piece[j + 1] = best[i] + float(model.score[got]), i, got
        if lone and i + char <= n and best[i] + model.unknown_score > best[i + char]:
            best[i + char], back[i + char], piece[i + char] = best[i] + model.unknown_score, i, UNKNOWN
    out, at = [], n
    while at > 0:
        if piece[at] == UNKNOWN:
            raw = [int(model.byte_id[b]) for b in text[back[at]:at]]
            out += raw[::-1] if min(raw) >= 0 else [model.unknown_id]
        else:
            out.append(piece[at])
        at = back[at]
    return out[::-1]


class Encoder:
    """Encodes texts; equal chunks are solved once while they are remembered."""

    CHUNK = re.compile(r" *[^ \n]+| +|\n")

    def __init__(self, model: Pieces):
        self.model = model
        self.forget()

    def forget(self):
        self.slot, self.flat = {}, np.empty(0, np.int32)
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, chunks: list[str], counts: np.ndarray, ids: np.ndarray):
        at = len(self.start)
        self.slot.update(zip(chunks, range(at, at + len(chunks))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def learn(self, chunks: set[str]):
        by_length: dict[int, tuple[list, list]] = {}
        for c in chunks:
            if c not in self.slot:
                data = c.encode("utf-8", "replace")
                names, raws = by_length.setdefault(len(data), ([], []))
                names.append(c)
                raws.append(data)
        for length, (names, raws) in by_length.items():
            if length > LONG:
                for name, raw in zip(names, raws):
                    ids = np.array(solve_long(self.model, raw))
                    self._add([name], np.array([len(ids)]), ids)
                continue
            step = max(1, 1_000_000 // length)
            for at in range(0, len(names), step):
                text = np.frombuffer(b"".join(raws[at:at + step]), np.uint8).reshape(-1, length)
                out = solve(self.model, text.astype(np.int32))
                self._add(names[at:at + step], (out >= 0).sum(axis=1), out[out >= 0])

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids)."""
        split = [self.CHUNK.findall(" " + t) if t else [] for t in texts]
        if len(self.slot) > CACHE_CHUNKS:
            self.forget()
        new = set()
        for chunks in split:
            new.update(chunks)
        self.learn(new)
        find = self.slot.__getitem__
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        slots = np.fromiter((find(c) for chunks in split for c in chunks), np.int64, int(sizes.sum()))
        count = self.count[slots]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.start[slots] - ends[:-1], count) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
        return np.diff(bounds), ids


def decode(model: Pieces, ids) -> str:
    """The text of the ids, without the space put before it."""
    raw = b"".join([model.bytes_of[i] for i in ids])
    return raw[raw[:1] == b" ":].decode("utf-8", "replace")


_WORKER: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, model: Pieces, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, ids, n_ids, n_chars and ``exact``: does decoding give the text back?"""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = Encoder(sent.value)
        encoder = _WORKER[name]
        for b in batches:
            texts, at = b.column("_text").to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < AT_ONCE):
                    chars += len(texts[to] or "")
                    to += 1
                part = [t or "" for t in texts[at:to]]
                counts, ids = encoder.encode(part)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                pieces = ids.tolist()
                exact = [decode(encoder.model, pieces[s:e]) == t for s, e, t in zip(offsets[:-1], offsets[1:], part)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(at, to - at) for c in columns], lists, pa.array(counts, pa.int64()),
                     pa.array([len(t) for t in part], pa.int64()), pa.array(exact, pa.bool_())],
                    names=[*columns, "ids", "n_ids", "n_chars", "exact"])
                at = to

    rows = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
    return rows.mapInArrow(run, f"{schema}, ids array<int>, n_ids long, n_chars long, exact boolean")
