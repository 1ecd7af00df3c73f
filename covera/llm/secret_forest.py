"""Secret scans with a random forest that removes false positives.

Candidates are runs of at least ``LEAST`` key characters with a digit or of
the form of an issued token, and, after the name of a credential that is
assigned to, values of ``SHORT`` characters or more, digits or not.  In
``name=value`` the name is context of the value.  Each is described by its length, its character transitions (how often neighbouring
characters change between lower case, upper case, digits and other, and
between vowel and consonant), its coverage by dictionary words, whether it
stands in a path, address or host name, and the words next to it.  A random
forest trained on labelled findings gives the probability of a secret.

The dictionary are the words that occur at least once in ``DICTIONARY``
documents on average, counted over all of them.  Labelled findings are a table (candidate, left,
right, label); :func:`rule_findings` makes one from the documents themselves
where no reviewed findings exist: a token of a known form and a value that a
credential's name is assigned are secrets; numbers, ids, paths, addresses,
host names and digests named as such are not; all others have no label, do not
train the forest and are judged by it.  Equal findings count once, and at most ``TRAIN`` of each label (least hashes first) train the
forest, with the same total weight for both labels; all others are only judged.

Everything is DataFrame functions and MLlib on the JVM.

Defined cases: a null or empty text has no candidates; repeated rows give
their findings each; without labelled findings of both kinds every candidate
of the scan is reported as no secret with a null probability; no rows give no
rows; other columns are ignored, and kept by :func:`redact`.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covera.operators.joins import checked_broadcast
from covera.session import cut_lineage

LEAST, SIDE, SHORT = 16, 48, 4
TRAIN = 20_000
#: A word is in the dictionary if it occurs at least once in so many documents, on average.
DICTIONARY = 1_000
KEY, PLAIN = r"A-Za-z0-9_+/=.\-", r"A-Za-z0-9_+/.\-"
#: Words that name a credential (not "author", "tokens", "secretary").
_NAMES = (r"(?:token(?!s\b|iz)|secret(?!ar)|passw(?:or)?d|passphrase|pwd|api[ _-]?key|access[ _-]?key|auth(?!or(?!i[sz]))"
          r"|bearer|credential|private[ _-]?key)")
CREDENTIAL = "(?i)" + _NAMES
#: From a credential's name to its value; a lookbehind needs bounds.
_ASSIGN = (rf"(?i:{_NAMES})[\w\-]{{0,32}}[\"'`]?[ \t]{{0,4}}(?::=|=>|={{1,3}}|:)[ \t]{{0,4}}"
           r"(?:(?i:bearer|basic)[ \t]{1,4})?")
#: Values of a credential's name, short or without digits as well: quoted, bare, or after the word bearer.
_NAMED = "|".join([
    *[rf"(?<={q})(?<={_ASSIGN}{q})[^{q}\r\n]{{{SHORT},}}+(?={q})" for q in "\"'`"],
    rf"(?<=[:=> \t\"'`])(?<=(?:[:=>]|[cCrR][ \t])[ \t]{{0,4}}[\"'`]?)(?<={_ASSIGN}[\"'`]?)(?!(?i:bearer|basic)[ \t])"
    rf"(?![:=>])[^\s\"'`,;&<>()\[\]{{}}|]{{{SHORT},}}(?<![.!?:])",
    rf"(?<=[ \t])(?<=(?i:bearer)[ \t]{{1,4}})(?=[{KEY}]{{0,256}}[0-9]|[{KEY}]{{{LEAST}}})[{KEY}]{{{SHORT},}}(?<![.])"])
#: Fixed forms of issued tokens.
TOKEN_FORM = (r"(?:A(?:KI|SI)A[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|xox[abprs]-[\w\-]{10,}"
              r"|[sr]k_(?:live|test)_[0-9a-zA-Z]{16,}|AIza[\w\-]{35}|npm_[A-Za-z0-9]{36}|eyJ[\w\-]{8,}\.eyJ[\w\-]+\.[\w\-]+)")
#: A run of key characters, long enough, with a digit in it or of a known form.  What stands before the run's
#: first '=' is apart from what follows, unless that is padding.
_RUN = (rf"(?<![{KEY}])(?=[A-Za-z_+/.\-]*[0-9]|{TOKEN_FORM})[{PLAIN}]{{{LEAST},}}+(?:=+(?![{KEY}]))?"
        rf"|(?<==)(?!=)(?=[A-Za-z_+/=.\-]*[0-9]|{TOKEN_FORM})[{KEY}]{{{LEAST},}}")
CANDIDATE = rf"(?:{_NAMED}|{_RUN})"
#: A name and what assigns to it, up to the value.
ASSIGNED = CREDENTIAL + r"[\w-]*[\"'`]?\s*(:=|=>|={1,3}|:)\s*((bearer|basic)\s+)?[\"'`]?$"
#: Values known to be harmless by their form: no letters, uuid, host or file name, path; values that stand for others.
_NO_SECRET = (r"^[^A-Za-z]*$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^([A-Za-z0-9_-]+\.)+[a-z]{2,6}$"
              r"|^[~.]{0,2}(/[\w.\-]+){2,}/?$")
_STAND_IN = r"(?i)^(true|false|null|none|nil|undefined|required|optional|string|x+|\*+|\.+|\$.*|%\w+%|your[_-].*)$"
#: Words that name a harmless digest or id.
HARMLESS = r"(?i)(commit|sha\d*|md5|checksum|digest|uuid|guid|hash|version|isbn|order|invoice)"
FEATURES = ["length", "digits", "uppers", "marks", "class_changes", "vowel_changes", "distinct", "hex", "coverage",
            "slashes", "dots", "after_at", "in_url", "quoted", "assigned", "credential", "harmless", "known_form",
            "left_word", "right_word"]


def pieces(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and the stretches between them (one more)."""
    safe = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(safe, F.lit(CANDIDATE), F.lit(0)), F.split(safe, CANDIDATE, -1)


def scan(docs: DataFrame, key: list[str]) -> DataFrame:
    """(key, nth, candidate, left, right, skipped): all candidates; ``skipped`` is the length of the stretch before."""
    found, between = pieces(F.col("text").cast("string"))
    rows = docs.select(*key, found.alias("_found"), between.alias("_between")).where(F.size("_found") > 0)
    # Only the ends of the stretches go on, not the stretches.
    ends = F.transform("_between", lambda g: F.struct(F.right(g, F.lit(SIDE)).alias("last"), F.left(g, F.lit(SIDE)).alias("first"),
                                                      F.length(g).alias("n")))
    rows = rows.select(*key, "_found", ends.alias("_ends"))
    # A candidate that is the name of the next one ("name=value") belongs to the next one's context.
    joint = r"^[\"'`]?\s{0,4}(:=|=>|={1,3}|:)\s{0,4}[\"'`]?$"

    def left(i):
        last = F.get("_ends", i)["last"]
        named = (i > 0) & last.rlike(joint)
        return F.when(named, F.right(F.concat(F.get("_found", i - 1), last), F.lit(SIDE))).otherwise(last)

    each = F.transform("_found", lambda c, i: F.struct(
        c.alias("candidate"), left(i).alias("left"), F.get("_ends", i + 1)["first"].alias("right"),
        F.get("_ends", i)["n"].alias("skipped")))
    return rows.select(*key, F.posexplode(each).alias("nth", "c")).select(*key, "nth", "c.*")


def frequent_words(docs: DataFrame, every: int = DICTIONARY) -> DataFrame:
    """(word): the alphabetic words of three or more letters that occur at least once in ``every`` documents on average.

    There are at most ``every`` times as many as a document has words on average, whatever the number of documents.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    words = texts.select(F.explode(F.split(F.lower("text"), r"[^a-zß-ɏ]+")).alias("word"))
    words = words.where((F.length("word") >= 3) & (F.length("word") <= 24))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counts.where(F.col("n") * every >= texts.count()).select("word"))


def _share(count: Column, of: Column) -> Column:
    return count / F.greatest(of, F.lit(1))


def describe(findings: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (candidate, left, right) with the FEATURES."""
    c, left, right = F.col("candidate"), F.col("left"), F.col("right")
    count = lambda p, of=c: F.regexp_count(of, F.lit(p))
    n = F.length(c)
    changes = count(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"
                    r"|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    vowels = count(r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])")
    one = lambda cond: cond.cast("double")
    rows = findings.select("candidate", "left", "right").distinct()
    rows = cut_lineage(rows.select(
        "*", n.cast("double").alias("length"), _share(count("[0-9]"), n).alias("digits"), _share(count("[A-Z]"), n).alias("uppers"),
        _share(count("[^A-Za-z0-9]"), n).alias("marks"), _share(changes, n - 1).alias("class_changes"),
        _share(vowels, n - 1).alias("vowel_changes"),
        _share(F.size(F.array_distinct(F.split(F.lower(c), ""))), F.least(n, F.lit(36))).alias("distinct"),
        one(c.rlike("^[0-9a-fA-F]+$")).alias("hex"), count("/").cast("double").alias("slashes"),
        count(r"\.").cast("double").alias("dots"), one(left.endswith("@") | c.contains("@")).alias("after_at"),
        one(left.rlike(r"(https?:/{0,2}|www\.|[/\\])$") | right.rlike(r"^[/\\:@]")).alias("in_url"),
        one(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")).alias("quoted"),
        one(left.rlike("([:=]>?\\s*|[:=\\s](?i:bearer|basic)\\s+|^(?i:bearer)\\s+)[\"'`]?$")).alias("assigned"),
        one(c.rlike(rf"^{TOKEN_FORM}[.]?$")).alias("known_form"),
        one(F.regexp_extract(left, r"(\S+\s+)?\S+\W*$", 0).rlike(CREDENTIAL)).alias("credential"),
        one(F.regexp_extract(left, r"(\S+\s+)?\S+\W*$", 0).rlike(HARMLESS)).alias("harmless"),
        F.lower(F.regexp_extract(left, r"([A-Za-zÀ-ɏ]+)[^A-Za-zÀ-ɏ]*$", 1)).alias("_lw"),
        F.lower(F.regexp_extract(right, r"^[^A-Za-zÀ-ɏ]*([A-Za-zÀ-ɏ]+)", 1)).alias("_rw")))
    known = checked_broadcast(words.withColumn("_known", F.lit(1.0)), words.count())

    def in_words(df, column, name):
        side = known.select(F.col("word").alias(f"_w_{name}"), F.col("_known").alias(name))
        return df.join(side, F.col(column) == F.col(f"_w_{name}"), "left").withColumn(name, F.coalesce(name, F.lit(0.0)))

    rows = in_words(in_words(rows, "_lw", "left_word"), "_rw", "right_word")
    # Letters of the candidate that lie in dictionary words.
    runs = rows.select("candidate").distinct().select(
        "candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("_run"))
    covered = runs.join(known, F.col("_run") == F.col("word")).groupBy("candidate").agg(
        F.sum(F.length("_run")).alias("_covered")).withColumnRenamed("candidate", "_c")
    return rows.join(covered, F.col("candidate") == F.col("_c"), "left").select(
        "candidate", "left", "right", *[f for f in FEATURES if f != "coverage"],
        _share(F.coalesce("_covered", F.lit(0)), F.length("candidate")).alias("coverage"))


def rule_findings(findings: DataFrame) -> DataFrame:
    """(candidate, left, right, label): 1 for a credential, 0 for what is known to be none, null where neither is known.

    A credential is a token of a known form, or what a credential's name is
    assigned; a bare word or short number there (prose, a count) is unknown.
    """
    c, left, right = F.col("candidate"), F.col("left"), F.col("right")
    named = left.rlike(ASSIGNED) | left.rlike(r"(?i)bearer\s+$")
    number = c.rlike("^[0-9.,+-]*$") & (F.length(c) < LEAST)
    word = ~c.rlike("[0-9]") & (F.length(c) < LEAST) & ~left.rlike("([\"'`]|\\S=)$")
    code = ~c.rlike("[0-9]") & right.rlike(r"^[(\[{]")
    harmless = (left.rlike(HARMLESS + r"\w{0,8}\W{0,4}$") | left.rlike(r"(@|https?:/{0,2}|www\.)$") | right.startswith("@")
                | c.rlike(_NO_SECRET))
    label = (F.when(c.rlike(rf"^{TOKEN_FORM}[.]?$"), 1.0).when(named & (c.rlike(_STAND_IN) | code), 0.0)
             .when(named & (number | word), None).when(named, 1.0).when(harmless, 0.0))
    return findings.select("candidate", "left", "right", label.cast("double").alias("label")).distinct()


def train(labelled: DataFrame, features: DataFrame, most: int = TRAIN, trees: int = 20, depth: int = 6,
          seed: int = 13, names: list[str] = FEATURES) -> RandomForestClassificationModel | None:
    """The forest on the features ``names``, from at most ``most`` findings of each label; None unless both labels occur in ``labelled``.

    Both labels weigh the same in total, so that few secrets among many other findings still count.
    """
    label = cut_lineage(labelled.where("label IS NOT NULL").groupBy("candidate", "left", "right").agg(F.max("label").alias("label")))
    totals = {r["label"]: r["n"] for r in label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not {0.0, 1.0} <= set(totals):
        return None
    taken = {k: min(totals[k], most) for k in (0.0, 1.0)}
    order = F.xxhash64(F.lit(seed), "candidate", "left", "right")
    # Bounded rows of each label, least hashes first: a share of the hashes is taken before the rows are sorted,
    # so that the one task that cuts the list reads about as many as it keeps.
    spread = F.pmod(order, F.lit(1 << 30))

    def least(k):
        some = label.where(F.col("label") == k).withColumn("weight", F.lit(sum(taken.values()) / (2 * taken[k])))
        share = min(1.0, (most + 8 * most ** 0.5) / totals[k])
        return some.where(spread < int(share * (1 << 30))).orderBy(spread, "candidate", "left", "right").limit(most)

    first, second = least(0.0), least(1.0)
    rows = features.join(first.unionByName(second), ["candidate", "left", "right"])
    # The limit cuts nothing: it brings the bounded sample into one partition, in the same order in every run.
    rows = cut_lineage(rows.orderBy(order, "candidate", "left", "right").limit(2 * most).select("label", "weight", *names))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label",
                                    weightCol="weight")
    return forest.fit(_vectors(rows, names).select("label", "weight", "features"))


def _vectors(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def judge(features: DataFrame, model: RandomForestClassificationModel | None, names: list[str] = FEATURES) -> DataFrame:
    """(candidate, left, right, probability, is_secret)."""
    if model is None:
        return features.select("candidate", "left", "right", F.lit(None).cast("double").alias("probability"),
                               F.lit(False).alias("is_secret"))
    p = vector_to_array("probability")[1]
    return model.transform(_vectors(features, names)).select("candidate", "left", "right", p.alias("probability"),
                                                      (p >= 0.5).alias("is_secret"))


def judged_findings(docs: DataFrame, key: list[str], labelled: DataFrame | None = None) -> DataFrame:
    """All findings of ``docs`` (key, nth, candidate, left, right, skipped) with probability and is_secret."""
    findings = cut_lineage(scan(docs, key))
    words = frequent_words(docs)
    features = cut_lineage(describe(findings, words))
    if labelled is None:
        model = train(rule_findings(findings), features)
    else:
        model = train(labelled, cut_lineage(describe(labelled, words)))
    verdicts = cut_lineage(judge(features, model))
    return findings.join(verdicts, ["candidate", "left", "right"])


def secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, nth, start, length, value_sha256, probability, is_secret of every candidate; start is a code point offset."""
    # A row of the input is told apart by its number in the scan, kept in the findings table.
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    found = judged_findings(rows, ["doc_id", "_row"], labelled)
    before = Window.partitionBy("_row").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("skipped") + F.length("candidate")).over(before), F.lit(0)) + F.col("skipped")
    return found.select("doc_id", "nth", start.cast("long").alias("start"), F.length("candidate").alias("length"),
                        F.sha2("candidate", 256).alias("value_sha256"), "probability", "is_secret")


def redact(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``, and n_chars to match where the column exists."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), "doc_id", "text", F.xxhash64(row).alias("_hash"))
    found = judged_findings(rows.select("doc_id", "_hash", "text"), ["doc_id", "_hash"], labelled)
    # Rows equal in all columns share a key, and so their decisions.
    flags = found.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "nth").agg(F.max("is_secret").alias("is_secret"))
    flags = flags.groupBy("_id", "_h").agg(F.max("is_secret").alias("any"),
                                           F.sort_array(F.collect_list(F.struct("nth", "is_secret"))).alias("flags")).where("any")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    joined = rows.select("_row", "doc_id", "text", "_hash").join(flags, same, "left")
    found, between = pieces(F.col("text").cast("string"))
    shown = F.zip_with(found, F.col("flags"), lambda c, f: F.when(f["is_secret"], F.lit(mark)).otherwise(c))
    clean = F.array_join(F.zip_with(between, shown, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")
    text = F.when(F.col("flags").isNull(), F.col("text")).otherwise(clean)
    joined = joined.select("_row", text.alias("_text"))
    fixed = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return joined.select(*[fixed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
