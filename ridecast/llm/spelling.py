"""Spelling variants by permuterm rotations.

Every rotation of a word and its end mark is sorted by its key: the whole rotation, or the rotation without its last
character, which is the edited one.  Two words that differ in one replaced character share the key that begins behind it;
a word with one character more shares the key that skips it with the whole rotation of the other.  So the rows of one key
are near words, and as a key fixes all characters but one, there are at most as many as the alphabet has characters, and
one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import fields
from ridecast.session import cut_lineage

MARK = "\x00"       # the end of a word in its rotations; words hold no NUL


def word_counts(words: DataFrame, column: str = "word", least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) for the words of at least ``least_length`` code points that occur ``least_count`` times or more; null is
    no word.  Counted before the shuffle, so a word that holds any share of the rows is one row of each task."""
    return (fields(words, column).toDF("word").where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def rotations(counts: DataFrame) -> DataFrame:
    """(key, edited, n): per word and place the rotation without the character there, which is ``edited``, and per word and
    place (the end too) the whole rotation, with ``edited`` null.  Key and character give the word back."""
    word, size = F.col("word"), F.length("word")

    def key(i: Column, skip: int) -> Column:
        return F.concat(F.substring(word, i + 1 + skip, size), F.lit(MARK), F.substring(word, F.lit(1), i))

    cut = F.transform(F.sequence(F.lit(0), size - 1),
                      lambda i: F.struct(key(i, 1).alias("key"), F.substring(word, i + 1, F.lit(1)).alias("edited")))
    whole = F.transform(F.sequence(F.lit(0), size),
                        lambda i: F.struct(key(i, 0).alias("key"), F.lit(None).cast("string").alias("edited")))
    return counts.select("n", F.explode(F.concat(cut, whole)).alias("r")).select("r.key", "r.edited", "n")


def near_links(counts: DataFrame) -> DataFrame:
    """(word, n, near, best): per key with near words and per word of it, how many of them are near by that key alone, and
    struct(-n, word) of the largest.  Summed over keys each near word counts once: a replaced character has one place, and
    of equal characters side by side only the first counts as the one left out."""
    from pyspark.sql import Window
    # one sort of the rotations by key; keys of one row leave before rows are gathered
    shared = (rotations(counts).withColumn("rows", F.count("*").over(Window.partitionBy("key")))
              .where("rows > 1").groupBy("key").agg(F.collect_list(F.struct("edited", "n")).alias("rows")))
    tail, head = F.substring_index("key", MARK, 1), F.substring_index("key", MARK, -1)
    rows = F.transform("rows", lambda r: F.struct(
        r["n"].alias("n"), F.concat(head, F.coalesce(r["edited"], F.lit("")), tail).alias("word"), r["edited"].alias("edited"),
        (r["edited"].isNotNull() & ~head.endswith(r["edited"])).alias("first")))

    def near(a: Column, b: Column) -> Column:
        replaced = a["edited"].isNotNull() & b["edited"].isNotNull() & (a["edited"] != b["edited"])
        return replaced | (a["edited"].isNull() & b["first"]) | (b["edited"].isNull() & a["first"])

    each = shared.select(rows.alias("rows")).select(F.explode("rows").alias("row"), "rows")
    others = F.filter("rows", lambda r: near(F.col("row"), r))
    links = each.select(F.col("row.word").alias("word"), F.col("row.n").alias("n"), others.alias("others"))
    return links.where(F.size("others") > 0).select(
        "word", "n", F.size("others").cast("long").alias("near"),
        F.array_min(F.transform("others", lambda r: F.struct((-r["n"]).alias("n"), r["word"].alias("word")))).alias("best"))


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n, n_near, best): the number of near words of each word, and struct(-n, word) of the one of largest n (ties:
    the smallest in code-point order), or null."""
    none = F.lit(None).cast("struct<n:long,word:string>")
    links = near_links(counts).unionByName(counts.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best")))
    return links.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form), null forms left out: the end of the chain of forms.  Each step doubles the
    length that a chain has been followed; as n grows along a chain by a factor, there are few steps."""
    chain = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not chain.where("moved").isEmpty():
        ahead = chain.select(F.col("word").alias("at"), F.col("root").alias("next"))
        chain = cut_lineage(chain.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return chain.select("word", "root")


def variants(counts: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the distinct words and counts (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one of the other.  ``form`` is the near word
    of largest n (ties: smallest in code-point order) if that is at least ``factor`` times the word's n, else null with
    ``form_n``; ``root`` is where following forms ends, the word itself without one.  ``factor`` is 2 at least, so that
    chains end.  An empty table gives an empty one.  Words must be distinct, not null, and hold no NUL."""
    if factor < 2:
        raise ValueError("factor must be 2 at least, or forms could run in a circle")
    counts = cut_lineage(counts.select("word", F.col("n").cast("long").alias("n")))
    is_form = -F.col("best.n") >= factor * F.col("n")
    found = cut_lineage(near_words(counts).select(
        "word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"),
        F.when(is_form, -F.col("best.n")).alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs_of_letters(docs: DataFrame, least_length: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, run): each maximal run of Latin letters of at least ``least_length``, A to Z lower-cased, as often as it
    occurs.  Null texts have none; repeated rows and null keys stay; other columns are left out, whatever their names."""
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-zÀ-ÿ]{%d,})" % least_length), F.lit(1))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (fields(docs, key, column).toDF("key", "text").select("key", F.explode(found).alias("run"))
            .select(F.col("key").alias(key), lower.alias("run")))
