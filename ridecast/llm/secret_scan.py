"""Secret scans: candidates from a pattern, false positives removed by a random forest.

A candidate is a long run of key-like characters with a digit.  Its features are its length, its character classes and the
transitions between them, the share of it that dictionary words cover, the names on its path (what stands before ``=`` or
``:``, and the document's source) and the words around it.  The forest learns from labelled findings; the dictionary is
counted over all texts and bounded by word shares.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import fields
from ridecast.session import cut_lineage

#: A candidate, which may start after any character that it can't hold; what ends before it; what begins after it.
CANDIDATE = "(?<![A-Za-z0-9+/_@.\\-])(?=[A-Za-z+/_@.\\-]*+[0-9])[A-Za-z0-9+/_@.\\-]{12,}+"
LEFT = "(\\S*?)[ \\t]*(?:([A-Za-z_][A-Za-z0-9_.\\-]{1,63})[\"']?[ \\t]?[=:][ \\t]?)?[\"'(\\[{<]*$"
RIGHT = "^[\"')\\]}>,;]*+[ \\t]*+(\\S*+)"
AROUND = 256
CLASSES = ("lower", "upper", "digit", "other")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, seq, before, name, candidate, after): every candidate of every text, numbered in its text.

    A candidate is a whole run of at least 12 letters, digits and ``+/_@.-`` with a digit among them, wherever it stands.
    name: what is assigned to it by ``=`` or ``:``; before and after: the rest of the word it stands in, or the next word on the
    line, all within AROUND characters.  Null and empty texts have none."""
    rows = (fields(docs, "doc_id", "source", "text").where("text is not null")
            .select("doc_id", "source", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("runs"),
                    F.split("text", CANDIDATE, -1).alias("gaps")).where(F.size("runs") > 0))
    run = lambda i: F.coalesce(F.get("runs", i), F.lit(""))                              # noqa: E731
    found = F.transform("runs", lambda x, i: F.struct(
        x.alias("candidate"), F.substring(F.concat(run(i - 1), F.get("gaps", i)), -AROUND, AROUND).alias("left"),
        F.substring(F.concat(F.get("gaps", i + 1), run(i + 1)), 1, AROUND).alias("right")))
    return (rows.select("doc_id", "source", F.posexplode(found).alias("seq", "x"))
            .select("doc_id", "source", "seq", F.regexp_extract("x.left", LEFT, 1).alias("before"),
                    F.regexp_extract("x.left", LEFT, 2).alias("name"), "x.candidate",
                    F.regexp_extract("x.right", RIGHT, 1).alias("after")))


def dictionary(docs: DataFrame, share: float = 2.0 ** -15) -> DataFrame:
    """(word): lower-case letter words of at least three letters that make up ``share`` of all words; 1 / share at most."""
    words = (fields(docs, "text").where("text is not null")
             .select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).groupBy("word").count())
    words = cut_lineage(words.where(F.length("word") >= 3))
    total = words.agg(F.sum("count")).first()[0] or 0
    return words.where(F.col("count") >= max(2, math.ceil(total * share))).select("word")


def _class(c: Column) -> Column:
    return (F.when(c.rlike("^[a-z]$"), 0).when(c.rlike("^[A-Z]$"), 1).when(c.rlike("^[0-9]$"), 2).otherwise(3))


def _is(value: int):
    return lambda x: x == value


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the numeric and word features of each candidate."""
    chars = F.split("candidate", "")
    f = found.withColumn("_k", F.transform(chars, _class)).withColumn("n", F.length("candidate").cast("double"))
    pairs = F.zip_with(F.slice("_k", 1, F.greatest(F.size("_k") - 1, F.lit(1))),
                       F.slice("_k", 2, F.greatest(F.size("_k") - 1, F.lit(1))), lambda a, b: a * 4 + F.coalesce(b, a))
    f = f.withColumn("_p", pairs)
    for i, name in enumerate(CLASSES):
        f = f.withColumn(f"is_{name}", F.size(F.filter("_k", _is(i))) / F.col("n"))
    for i, a in enumerate(CLASSES):
        for j, b in enumerate(CLASSES):
            f = f.withColumn(f"{a}_{b}", F.size(F.filter("_p", _is(4 * i + j))) / F.col("n"))
    f = f.withColumn("distinct", F.size(F.array_distinct(chars)) / F.col("n"))
    # dictionary coverage: letters in runs that are words
    parts = (f.select("doc_id", "seq", F.explode(F.array_distinct(F.filter(
        F.split(F.lower("candidate"), "[^\\p{L}]+"), lambda w: F.length(w) >= 3))).alias("word"))
        .join(F.broadcast(words), "word").groupBy("doc_id", "seq").agg(F.sum(F.length("word")).alias("_letters")))
    f = f.join(parts, ["doc_id", "seq"], "left").withColumn("covered", F.coalesce("_letters", F.lit(0)) / F.col("n"))
    tags = F.filter(F.array(F.concat(F.lit("before:"), F.lower("before")), F.concat(F.lit("name:"), F.lower("name")),
                            F.concat(F.lit("after:"), F.lower("after")), F.concat(F.lit("source:"), F.col("source"))),
                    lambda t: t.isNotNull() & ~t.endswith(":"))
    return f.withColumn("tags", tags).drop("_k", "_p", "_letters")


NUMERIC = ["n", *[f"is_{c}" for c in CLASSES], *[f"{a}_{b}" for a in CLASSES for b in CLASSES], "distinct", "covered"]


def fit(labelled: DataFrame, sample: int = 20000, trees: int = 40, depth: int = 8, seed: int = 7) -> PipelineModel | None:
    """A forest from feature rows with ``label`` 0 or 1: at most ``sample`` of them, chosen by a hash of doc_id and seq.

    None if there aren't both labels."""
    part = (labelled.where("label is not null").select("doc_id", "seq", "label", "tags", *NUMERIC)
            .orderBy(F.xxhash64("doc_id", "seq"), "doc_id", "seq").limit(sample))
    part = cut_lineage(part.withColumn("label", F.col("label").cast("double"))).coalesce(1)
    if part.select("label").distinct().count() < 2:
        return None
    return Pipeline(stages=[
        HashingTF(inputCol="tags", outputCol="_tags", numFeatures=64, binary=True),
        VectorAssembler(inputCols=[*NUMERIC, "_tags"], outputCol="_x"),
        RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed,
                               featureSubsetStrategy="sqrt")]).fit(part)


def score(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``rows`` with ``score``, the forest's probability that the candidate is a secret (null without a model), and
    ``secret``: score at least 0.5; without a model, all that isn't labelled 0."""
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn(
            "secret", F.coalesce(F.col("label") == 1, F.lit(True)))
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("secret", F.col("score") >= 0.5).drop("_tags", "_x", "rawPrediction", "probability", "prediction")


#: Formats whose findings label themselves.
SECRET_FORMS = "^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{10,}\\..+)$"
SECRET_NAMES = "(?i)^(?:.*[._-])?(?:password|passwd|pwd|secret|token|api_?key|access_?key)$"
HARMLESS_FORMS = ("^(?:[^@]+@[^@]+\\.[A-Za-z]{2,}\\.?|[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\.?|[0-9.+/_-]+"
                  "|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$")


def label_findings(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label``: 1 for known key formats and for values assigned to a secret's name, 0 for addresses,
    numbers and universal ids, null for what only the forest can tell (``scheme://user:password@host`` is no address)."""
    c = F.col("candidate")
    return rows.withColumn("label", F.when(c.rlike(HARMLESS_FORMS) & ~F.col("before").endswith("://"), 0).when(
        c.rlike(SECRET_FORMS) | F.coalesce(F.col("name").rlike(SECRET_NAMES), F.lit(False)), 1))


def scan(docs: DataFrame, labelled: DataFrame | None = None, share: float = 2.0 ** -15, **forest) -> DataFrame:
    """One row per candidate of ``docs`` (doc_id, source, text): doc_id, seq, name, candidate, label, score, secret.

    labelled: (doc_id, seq, label) of reviewed findings; without it, findings label themselves by their format where it
    is plain.  Training takes labelled findings of documents whose crc32(doc_id as text) mod 4 is not 2."""
    rows = cut_lineage(features(cut_lineage(candidates(docs)), dictionary(docs, share)))
    rows = label_findings(rows) if labelled is None else rows.join(fields(labelled, "doc_id", "seq", "label"),
                                                                   ["doc_id", "seq"], "left")
    away = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    model = fit(rows.where(~away), **forest)
    return score(rows, model).select("doc_id", "seq", "name", "candidate", F.col("label").cast("int").alias("label"),
                                     "score", "secret", away.alias("held_out"))
