"""Quality classifier: an interpolated modified Kneser-Ney model of characters, by count joins.

The model is trained on all trusted text (documents labelled good and not
toxic).  Its n-grams are runs of three characters of any alphabet; nothing about
it is bounded by a fixed symbol set, so its tables grow with the corpus and
stay tables, sharded by n-gram.

1. Every task counts the n-grams of its trusted texts; the counts are summed
   over the shuffle.
2. Continuation counts, discounts (from the counts of counts, per order),
   context totals and back-off weights are groupings of these count tables by
   n-gram and by context.
3. Documents are dealt to blocks, whole parts of a file of about ``PART`` bytes
   of text.  A block asks for its distinct n-grams, about one for every thousand
   characters, so the join of the asked n-grams with the count tables (highest
   order first, backing off by suffix) moves far less than the text.
4. Every block meets its priced n-grams, and each of its documents is the sum
   over its own characters.  A document's perplexity is compared with a quantile
   of the trusted documents of its language, taken from all of them.

A short text says little: before the comparison every document is given
``PRIOR`` further symbols of its language's mean surprise.

Defined cases: a null or empty text has no symbols, hence its language's mean
perplexity, and is kept; characters are told apart by the low 16 bits of their
code points, and a text begins with two marks of its own; a language (null is
one) with fewer than ``FEW`` trusted documents takes the quantile of all
trusted documents; without any trusted document all are kept; repeated rows
count as often as they occur; a doc_id with several labels is trusted if all of
them agree; no rows give no rows; further columns play no part, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covera.operators.joins import checked_broadcast
from covera.operators.quantiles import value_ranks
from covera.session import cut_lineage

BITS, ORDER = 16, 3
SYMBOLS = 1 << BITS
PRIOR, FEW = 200, 20
#: Trusted documents beyond this share of their language are rejected as well.
QUANTILE = 0.998
#: Bytes of text that share one list of n-grams, and n-grams that a task holds before it passes them on.
PART, HELD = 32 << 20, 1 << 22
#: Surprise is added up in whole millionths of a bit: sums do not depend on their order.
UNIT = 1_000_000


def grams(text: str | None) -> np.ndarray:
    """The n-gram that ends at every character, as one number of 16 bits a character."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32) & np.uint32(SYMBOLS - 1)
    marked = np.zeros(len(points) + ORDER - 1, np.uint64)
    # Zero is the mark before a text.
    marked[ORDER - 1:] = np.where(points == 0, SYMBOLS - 1, points)
    out = np.zeros(len(points), np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(BITS)) | marked[i:len(marked) - (ORDER - 1) + i]
    return out


def _pieces(texts, held: int = HELD):
    """The n-grams of texts, joined to arrays of at least ``held`` of them, but for the last."""
    waiting, size = [], 0
    for t in texts:
        waiting.append(grams(t))
        size += len(waiting[-1])
        if size >= held:
            yield np.concatenate(waiting)
            waiting, size = [], 0
    if size:
        yield np.concatenate(waiting)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, c): n-gram counts of all texts; each task adds up its own, some millions of characters at a time."""

    def run(batches):
        texts = (t for b in batches for t in b.column("text").to_pylist())
        for piece in _pieces(texts):
            gram, c = np.unique(piece, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(c)], names=["gram", "c"])

    part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, c long")
    return part.groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; 0.5, 1, 1.5 where they are undefined."""
    n1, n2, n3, n4 = n
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    ds = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(ds, 1))


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def _shares(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of one order: (gram, share) with the discount taken off, and (context, back)."""
    tally = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    d1, d2, d3 = discounts([tally.get(k, 0) for k in (1, 2, 3, 4)])
    off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    rows = counts.select("gram", F.shiftrightunsigned("gram", BITS).alias("context"), "c", F.least("c", off).alias("off"))
    contexts = cut_lineage(rows.groupBy("context").agg(F.sum("c").alias("all"), F.sum("off").alias("off_all")))
    shares = rows.join(contexts.select("context", "all"), "context").select("gram", ((F.col("c") - F.col("off")) / F.col("all")).alias("share"))
    return cut_lineage(shares), contexts.select("context", (F.col("off_all") / F.col("all")).alias("back"))


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(shares, backs) of the orders 1 to ``ORDER``."""
    found, at = [], cut_lineage(counts)
    for order in range(ORDER, 0, -1):
        found.append(_shares(at))
        # Continuation counts: in how many contexts does the shorter n-gram occur?
        if order > 1:
            at = cut_lineage(at.groupBy(_suffix(F.col("gram"), order - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    return found[::-1]


def priced(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, p) of distinct n-grams of the highest order: shares, and back-off weight times the suffix's p."""
    first = model[0][1].first()
    # What is left of order 0 is shared by all symbols.
    even = (1.0 if first is None else first["back"]) / SYMBOLS
    p = None
    for order, (shares, backs) in enumerate(model, 1):
        mine = asked if order == ORDER else asked.select(_suffix(F.col("gram"), order).alias("gram")).distinct()
        rows = mine.join(shares, "gram", "left")
        if order == 1:
            p = rows.select("gram", (F.coalesce("share", F.lit(0.0)) + F.lit(even)).alias("p"))
            continue
        rows = rows.withColumn("context", F.shiftrightunsigned("gram", BITS)).join(backs, "context", "left")
        lower = p.select(F.col("gram").alias("_low"), F.col("p").alias("_p"))
        p = rows.join(lower, _suffix(F.col("gram"), order - 1) == F.col("_low")).select(
            "gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("_p")).alias("p"))
    return p


def surprise(p: Column) -> Column:
    """-log2 p in whole units."""
    return F.round(-F.log2(F.greatest(p, F.lit(1e-30))) * UNIT).cast("long")


# --- labels ---------------------------------------------------------------------------------------

def trusted_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose labels all say good and not toxic.

    The trusted ids are broadcast while their counted rows are within the
    bound of :func:`checked_broadcast`; beyond it both sides are shuffled.
    """
    good = cut_lineage(labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("_good")).where("_good = 1").select("_id"))
    return docs.join(checked_broadcast(good, good.count()), docs["doc_id"] == good["_id"], "left_semi")


def train(docs: DataFrame, labels: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    return kneser_ney(gram_counts(trusted_docs(docs.select("doc_id", "text"), labels)))


# --- scoring --------------------------------------------------------------------------------------

def blocks(docs: DataFrame, part: int = PART) -> Column:
    """The block of a row: its file, and a share of it by the row's hash if the file is large.

    Rows that do not come from a file are dealt by their hash alone.  The same
    row has the same block in every scan, however its file is split.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    files = max(1, len(docs.inputFiles()))
    name = F.input_file_name()
    shares = F.when(name == "", -(-size // part) + 1).otherwise(-(-size // (part * files)) + 0)
    row = F.xxhash64("doc_id", F.col("text").cast("string"))
    return F.xxhash64(name, F.pmod(row, F.greatest(shares, F.lit(1)).cast("long")))


def asked_grams(docs: DataFrame) -> DataFrame:
    """(block, gram) for ``docs`` (block, text): the distinct n-grams of a task's rows of every block."""

    def run(batches):
        held: dict = {}
        sizes: dict = {}

        def give(block):
            gram = np.unique(np.concatenate(held.pop(block)))
            sizes.pop(block)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), block)), pa.array(gram.view(np.int64))],
                                              names=["block", "gram"])

        for b in batches:
            block, texts = b.column("block").to_numpy(), b.column("text")
            for number in np.unique(block).tolist():
                for piece in _pieces(texts.filter(pa.array(block == number)).to_pylist()):
                    held.setdefault(number, []).append(np.unique(piece))
                    sizes[number] = sizes.get(number, 0) + len(held[number][-1])
            for number in [n for n, parts in held.items() if len(parts) > 1]:
                held[number] = [np.unique(np.concatenate(held[number]))]
                sizes[number] = len(held[number][0])
            while sum(sizes.values()) > HELD:
                yield give(max(sizes, key=sizes.get))
        for block in list(held):
            yield give(block)

    return docs.mapInArrow(run, "block long, gram long")


def with_surprise(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], carry: list[Column]) -> DataFrame:
    """``carry`` columns, ``_n`` (symbols) and ``_bits`` (their summed surprise) of every row of ``docs``."""
    block = blocks(docs).alias("block")
    text = F.col("text").cast("string").alias("text")
    asked = cut_lineage(asked_grams(docs.select(block, text)))
    prices = priced(asked.select("gram").distinct(), model).select(F.col("gram").alias("_g"), surprise(F.col("p")).alias("bits"))
    replies = asked.join(prices.hint("merge"), F.col("gram") == F.col("_g")).select("block", "gram", "bits")
    # The block is taken in the scan, before anything moves the rows.
    rows = docs.select(block, text, *carry)
    names = [c for c in rows.columns if c not in ("block", "text")]
    types = dict(rows.dtypes)

    def score(mine: pa.Table, known: pa.Table) -> pa.Table:
        gram = known.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(gram)
        gram, bits = gram[order], known.column("bits").to_numpy()[order]
        sizes, total = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
        at = 0
        for chunk in mine.column("text").chunks:
            for value in chunk:
                own = grams(value.as_py())
                place = np.searchsorted(gram, own)
                if len(own) and not np.array_equal(gram[np.minimum(place, len(gram) - 1)], own):
                    raise RuntimeError("a block lacks n-grams that it asked for")
                sizes[at], total[at] = len(own), bits[place].sum()
                at += 1
        return pa.table([*[mine.column(c) for c in names], pa.array(sizes), pa.array(total)], names=[*names, "_n", "_bits"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", _n long, _bits long"
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema).withColumn(
        "_bits", F.col("_bits") / F.lit(float(UNIT)))


# --- the verdict ----------------------------------------------------------------------------------

def language(lang: Column) -> Column:
    """A key of a language that is never null."""
    return F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang.cast("string")))


def smoothed(scored: DataFrame, mean) -> DataFrame:
    return scored.withColumn("_level", (F.col("_bits") + PRIOR * mean) / (F.col("_n") + PRIOR))


def _limits(level: DataFrame, groups: list[str], quantile: float) -> DataFrame:
    """(groups, _limit): the least level that the share ``quantile`` of a group's rows does not exceed."""
    ranks = cut_lineage(value_ranks(level, "_level", groups))
    sizes = ranks.groupBy(*groups).agg(F.sum("cnt").alias("_all"))
    need = F.ceil(F.col("_all") * quantile)
    return ranks.join(sizes, groups).where(F.col("below") + F.col("cnt") >= need).groupBy(*groups).agg(
        F.min("_level").alias("_limit"))


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, dict]:
    """Per language the mean surprise and the quantile, and the same of all trusted rows.

    ``scored`` has doc_id, lang, _n, _bits and no text.
    """
    trusted = cut_lineage(trusted_docs(scored, labels).withColumn("_lang", language(F.col("lang")))
                          .withColumn("_units", F.round(F.col("_bits") * UNIT).cast("long")))
    mean = F.sum("_units") / F.greatest(F.sum("_n"), F.lit(1)) / F.lit(float(UNIT))
    whole = trusted.agg(F.count(F.lit(1)).alias("docs"), mean.alias("mean")).first()
    base = float(whole["mean"] or 0.0)
    means = trusted.groupBy("_lang").agg(F.count(F.lit(1)).alias("_docs"), mean.alias("_mean"))
    means = cut_lineage(means.withColumn("_mean", F.when(F.col("_docs") >= FEW, F.col("_mean")).otherwise(base)))
    level = cut_lineage(smoothed(trusted.join(means, "_lang"), F.col("_mean")).select("_lang", "_level", F.lit(0).alias("_every")))
    per, every = _limits(level, ["_lang"], quantile), _limits(level, ["_every"], quantile).first()
    whole_limit = None if every is None else every["_limit"]
    rows = means.join(per, "_lang").withColumn(
        "_limit", F.when(F.col("_docs") >= FEW, F.col("_limit")).otherwise(F.lit(whole_limit).cast("double")))
    return cut_lineage(rows.select("_lang", "_mean", "_limit")), {"mean": base, "limit": whole_limit, "docs": whole["docs"]}


def judged(scored: DataFrame, limits: DataFrame, whole: dict) -> DataFrame:
    """``scored`` with perplexity, threshold (null: none) and keep."""
    rows = scored.join(limits, language(F.col("lang")) == F.col("_lang"), "left")
    rows = smoothed(rows, F.coalesce("_mean", F.lit(whole["mean"])))
    limit = F.coalesce("_limit", F.lit(whole["limit"]).cast("double"))
    return rows.select(*[c for c in scored.columns if c not in ("_n", "_bits")],
                       F.col("_n").alias("n_symbols"),
                       F.pow(F.lit(2.0), F.when(F.col("_n") > 0, F.col("_bits") / F.col("_n"))).alias("perplexity"),
                       F.pow(F.lit(2.0), "_level").alias("level"), F.pow(F.lit(2.0), limit).alias("threshold"),
                       F.coalesce(F.col("_level") <= limit, F.lit(True)).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, level, threshold, keep for every row."""
    scored = cut_lineage(with_surprise(docs, train(docs, labels), [F.col("doc_id"), F.col("lang")]))
    return judged(scored, *thresholds(scored, labels, quantile))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = cut_lineage(with_surprise(docs, train(docs, labels), [row, F.col("doc_id"), F.col("lang")]))
    limits, whole = thresholds(scored.drop("_row"), labels, quantile)
    return judged(scored, limits, whole).where("keep").select("_row.*")
