"""Secret scans with a random forest against false positives, in DataFrame functions and Spark ML alone.

``candidates`` finds long runs of letters, digits and ``+ / _ -`` in whole texts and describes each by its length, its
character transitions (digit to letter, lower to upper, ...), its spread of characters, the share of it that dictionary
words cover, its path (how rich in candidates the source is) and its neighbouring words: what stands before it, and how
strongly labelled findings with that word before them are secrets. A random forest, fitted on labelled findings (at
most ``FINDINGS`` of each label, by a hash of the row), gives each candidate the probability of being a secret. While it
learns, a finding's neighbouring words are weighed by the other half of the findings, so that no label describes itself.

``weak_labels`` labels findings where no hand-made labels are given: known key prefixes and assignments to a secret's
name are secrets, bare numbers and bare words are not, and everything else stays unlabelled.

Defined results: null and empty texts have no candidates. A candidate that occurs several times in a text is one row
with ``n_found``; rows that repeat a doc_id are scanned one by one. A null source is a path of its own. Without labelled
findings of both labels every probability is the share of label 1 (0 without labels). Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import keep

#: Labelled findings of each label that the forest learns from, at most.
FINDINGS = 10_000
TREES, DEPTH = 24, 7
CANDIDATE = r"[0-9A-Za-z+/_-]{16,}"
#: What counts as a candidate besides its shape: a digit, or this many characters.
LONG = 20
FEATURES = ("length", "runs", "digit_letter", "letter_digit", "lower_upper", "upper_lower", "digits", "uppers", "hex", "distinct", "coverage", "path_rate", "assigned", "quoted", "word_weight", "next_weight")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, source, candidate, start (from 0), n_found and the words round it."""
    text = F.col("text")
    hits = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda c: c.rlike("[0-9]") | (F.length(c) >= LONG)))

    rows = docs.select("doc_id", "source", "text", F.explode(hits).alias("candidate")).withColumn("start", F.expr("locate(candidate, text) - 1"))
    left = F.expr("substring(text, greatest(start - 39, 1), least(start, 40))")
    right = F.expr("substring(text, start + length(candidate) + 1, 24)")
    times = (F.length("text") - F.length(F.expr("replace(text, candidate, '')"))) / F.length("candidate")
    return rows.select("doc_id", "source", "candidate", F.col("start").cast("long").alias("start"), times.cast("long").alias("n_found"), left.alias("left"), right.alias("right"))


def _coverage(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds the share of each candidate's characters that lies in letter runs which are dictionary words."""
    parts = rows.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    words = dictionary.select(F.lower("word").alias("word")).where("word is not null").distinct()
    covered = parts.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    return rows.join(covered, "candidate", "left").withColumn("coverage", F.coalesce(F.col("covered"), F.lit(0)) / F.length("candidate")).drop("covered")


def candidates(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates of ``docs`` (doc_id, text, source) with all features that need no labels.

    ``dictionary``: a column ``word``.
    """
    rows = keep(found(docs), "candidates")
    per_path = docs.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n_docs"))
    held = rows.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n_hits"))
    rate = per_path.join(held, per_path["path"].eqNullSafe(held["path"]), "left").select(per_path["path"], (F.coalesce("n_hits", F.lit(0)) / F.col("n_docs")).alias("path_rate"))
    rows = _coverage(rows, dictionary)
    rows = rows.join(rate, rows["source"].eqNullSafe(rate["path"])).drop("path")
    c, before = F.col("candidate"), F.regexp_extract("left", r"([^A-Za-z0-9]*)$", 1)
    return rows.select(
        "doc_id", "source", "candidate", "start", "n_found", "left", "path_rate", "coverage",
        F.lower(F.regexp_extract("left", r"([A-Za-z_]+)[^A-Za-z0-9]*$", 1)).alias("word"),
        F.lower(F.regexp_extract("right", r"^[^A-Za-z0-9]*([A-Za-z_]+)", 1)).alias("next"),
        F.length("candidate").cast("double").alias("length"),
        (F.size(F.regexp_extract_all(c, F.lit("[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+"), F.lit(0))) / F.length(c)).alias("runs"),
        _share(c, "[0-9](?=[A-Za-z])").alias("digit_letter"), _share(c, "[A-Za-z](?=[0-9])").alias("letter_digit"),
        _share(c, "[a-z](?=[A-Z])").alias("lower_upper"), _share(c, "[A-Z](?=[a-z])").alias("upper_lower"),
        _share(c, "[0-9]").alias("digits"), _share(c, "[A-Z]").alias("uppers"), _share(c, "[0-9a-f]").alias("hex"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.length(c)).alias("distinct"),
        F.rlike(before, F.lit("[=:]")).cast("double").alias("assigned"), F.rlike(before, F.lit("[\"'`]$")).cast("double").alias("quoted"),
    )


def weak_labels(rows: DataFrame) -> DataFrame:
    """``rows`` of ``candidates`` with ``label``: 1, 0 or null, by rules of high precision."""
    secret = F.col("left").rlike(r"(?i)(token|secret|passw(or)?d|pwd|api_?key|credential)\W{0,4}[=:]\W{0,2}$") | F.col("candidate").rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^xox[abp]-|^sk_live_")
    plain = F.col("candidate").rlike("^[0-9]+$|^[A-Z]?[a-z]+$|^[A-Z]+$")
    return rows.withColumn("label", F.when(secret, 1).when(plain, 0))


def _weights(findings: DataFrame, column: str, *by: str) -> DataFrame:
    """Log odds of label 1 by the word in ``column``, smoothed; as many rows as words of the bounded findings."""
    pos, neg = F.sum("label"), F.sum(1 - F.col("label"))
    return findings.groupBy(column, *by).agg(F.log((pos + 0.5) / (neg + 0.5)).alias(f"{column}_weight"))


def scan(docs: DataFrame, dictionary: DataFrame, findings: DataFrame | None = None, per_label: int = FINDINGS, seed: int = 5) -> DataFrame:
    """Every candidate of ``docs`` (doc_id, text, source) with its probability of being a secret.

    ``findings``: doc_id, candidate and label (0 or 1) of findings to learn from; without it, ``weak_labels`` of the
    candidates. Returns doc_id, source, candidate, start, n_found, probability.
    """
    rows = keep(candidates(docs, dictionary), "described")
    if findings is None:
        known = weak_labels(rows).where("label is not null")
    else:
        given = findings.where("label in (0, 1)").groupBy("doc_id", "candidate").agg(F.max("label").alias("label"))
        known = rows.join(given, ["doc_id", "candidate"])
    chosen = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", "candidate"), "doc_id", "start").limit(per_label) for y in (0, 1)]
    half = F.pmod(F.xxhash64("candidate"), F.lit(2)).alias("half")
    known = keep(chosen[0].unionByName(chosen[1]).select("*", half), "findings")
    n = {int(y): c for y, c in known.groupBy("label").count().collect()}
    if len(n) < 2:
        share = float(n.get(1, 0) > 0)
        return rows.select("doc_id", "source", "candidate", "start", "n_found", F.lit(share).alias("probability"))
    # at most 2 * per_label rows each
    other = known.withColumn("half", 1 - F.col("half"))

    def complete(df: DataFrame, findings: DataFrame, *by: str) -> DataFrame:
        for c in ("word", "next"):
            df = df.join(F.broadcast(_weights(findings, c, *by)), [c, *by], "left").withColumn(f"{c}_weight", F.coalesce(f"{c}_weight", F.lit(0.0)))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt")
    model = forest.fit(complete(known, other, "half").withColumn("label", F.col("label").cast("double")))
    scored = model.transform(complete(rows, known))
    return scored.select("doc_id", "source", "candidate", "start", "n_found", vector_to_array("probability")[1].alias("probability"))


def dictionary_of(texts: Column, table: DataFrame) -> DataFrame:
    """Distinct lower-case words of three ASCII letters or more: a dictionary (word)."""
    return table.select(F.explode(F.split(F.lower(texts), "[^a-z]+")).alias("word")).where(F.length("word") >= 3).distinct()
