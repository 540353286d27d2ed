"""One query per operator over its whole table, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.llm import (brown_lm, byte_bpe, chat_format, decontaminate, exact_dedup, jaccard_join, lang_id, line_dedup,
                          packing, periodic_runs, secret_scan, spelling, substring_dedup)
from ridecast.llm.common import held_out
from ridecast.session import cut_lineage
from ridecast.sources.tables import load


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    away = held_out(F.col("doc_id"), 7)
    model = brown_lm.fit(docs.where(~away))
    return brown_lm.score(docs, model).select(
        "doc_id", away.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = cut_lineage(packing.token_pieces(docs, tokenizer_path(), 2048))
    return packing.pack(pieces, packing.sequence(2048)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = r"\### Assistant: </turn> ok"
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(
        [(-7, 0, "user", trial), (-7, 1, "assistant", trial)], "conv_id long, turn long, role string, text string"))
    turns = chat_format.canonical_turns(chat_format.records_of_turns(rows))
    return chat_format.digest(chat_format.render(turns))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return substring_dedup.cut_repeats(docs, window=50).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(load(spark, sf_dir, "documents").select("doc_id", "text"), edits="characters")


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_groups(docs, size=4, percent=85, complete=True)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontaminate.find_leaks(docs, load(spark, sf_dir, "benchmark").select("item_id", "text"), window=10)
    hit = decontaminate.n_hit(F.col("spans"))
    return leaks.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    away = held_out(F.col("doc_id"), 4)
    filters = lang_id.fit(docs.where(~away))
    return lang_id.predict(docs.select("doc_id", "text"), filters).select(
        "doc_id", away.alias("held_out"), "lang_pred", "score")


def vocabulary() -> bytes:
    """The rank file (0.8 MB), which the driver sends along with the tasks."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digest(docs, vocabulary(), public_tokenizers.PATTERN)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The texts of op12: where crc32 of the id ends in 0, the words from one on repeat."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = F.col("text").isNotNull() & (F.col("h") % 10 == 0)
    g, n = F.floor(F.col("h") / 10), F.size("words")
    made = docs.withColumn("h", h).withColumn("words", F.when(chosen, words)) \
        .withColumn("a", F.when(n > 0, g % n).cast("int")) \
        .withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
        "words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return made.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.runs_of(_made_periodic(docs), least=6, times=4)
    # runs come by start, then period: of equal exponents the first one stays
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    # one run in 31 loses a code point, chosen by a hash: the misspellings to find
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h = F.crc32(F.encode(named, "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    runs = spelling.runs_of_letters(docs, least_length=7).withColumn("h", h)
    words = runs.select(F.when(F.col("h") % 31 == 0, damaged).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.word_counts(words, least_length=7, least_count=2), factor=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_brown_lm, op2_best_fit, op3_chat_format, op4_substring_dedup, op5_fuzzy_lines, op6_secret_forest, op7_exact_dedup,
    op8_jaccard_join, op9_decontaminate, op10_lang_id, op11_byte_bpe, op12_periodic_runs, op13_spelling_variants,
    pipeline)}

ORACLE = {
    "op3_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
            SELECT *, 23 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
                + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS n FROM rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(n)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op4_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        win AS (
            SELECT doc_id, p, sha256(array_to_string(list_slice(w, p, p + 49), ' ')) AS h
            FROM d, unnest(generate_series(1, len(w) - 49)) AS t(p)),
        firsts AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
        hits AS (SELECT DISTINCT doc_id, p FROM win JOIN firsts USING (h) WHERE lo < doc_id),
        gone AS (SELECT DISTINCT doc_id, p + k AS i FROM hits, unnest(generate_series(0, 49)) AS t(k)),
        words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(generate_series(1, len(w))) AS t(i)),
        kept AS (
            SELECT doc_id, count(gone.i) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL), '') AS text
            FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
    "op9_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS s
            FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(p) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT m FROM bw),
        dw AS (
            SELECT doc_id, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS s
            FROM d, sizes, unnest(generate_series(1, len(w) - m + 1)) AS t(p)),
        hits AS (SELECT DISTINCT doc_id, p, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
        gone AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM hits, unnest(generate_series(0, m - 1)) AS t(k) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(gone.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_periodic_runs": r"""
        WITH RECURSIVE
        crc_table AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
                    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
        raw AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM documents, crc_table),
        planned AS (
            SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
        d AS (
            SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i
                ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w
            FROM planned),
        words AS (SELECT doc_id, n, i, w[i + 1] AS word FROM d, unnest(range(n)) AS t(i)),
        -- the next place of the same 2^k words, where it is at most 2^k and more than 2^(k-1) words on, may be a period
        grams AS (
            SELECT 0 AS k, doc_id, n, i, hash(word) AS x FROM words
            UNION ALL
            SELECT k + 1, doc_id, n, i, y FROM (
                SELECT k, doc_id, n, i, hash(x, lead(x, 1 << k) OVER (PARTITION BY doc_id ORDER BY i)) AS y, lead(i, 1 << k) OVER (PARTITION BY doc_id ORDER BY i) AS z
                FROM grams WHERE 4 << k < n) WHERE z IS NOT NULL),
        periods AS (
            SELECT DISTINCT doc_id, q FROM (
                SELECT doc_id, k, lead(i) OVER (PARTITION BY k, doc_id, x ORDER BY i) - i AS q FROM grams)
            WHERE q <= 1 << k AND 2 * q > 1 << k),
        pairs AS (
            SELECT a.doc_id, q, a.i FROM periods AS p JOIN words AS a USING (doc_id) JOIN words AS b
                ON b.doc_id = a.doc_id AND b.i = a.i + q AND b.word = a.word),
        stretches AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
                SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
            GROUP BY doc_id, q, island),
        runs AS (
            SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
            HAVING length >= greatest(6, 4 * min(q))),
        sums AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
            FROM runs GROUP BY doc_id),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS k FROM runs),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS text
            FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period,
            (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
            sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (doc_id)
            LEFT JOIN kept USING (doc_id)""",
    "op13_spelling_variants": r"""
        WITH RECURSIVE
        crc_table AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
                    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
        runs AS (
            SELECT doc_id::VARCHAR || ':' || run AS named, run FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
            WHERE length(run) >= 7),
        hashed AS (
            SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(named)) // 2),
                    lambda i: ('0x' || substr(hex(named), 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM runs, crc_table),
        words AS (
            SELECT word, count(*) AS n FROM (
                SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
                FROM hashed)
            WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
        cuts AS (
            SELECT word, n, i, substr(word, 1, i) || '?' || substr(word, i + 2) AS gap, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM words, unnest(range(length(word))) AS t(i)),
        near AS (
            SELECT a.word, b.word AS other, b.n AS m FROM cuts AS a JOIN cuts AS b ON a.gap = b.gap AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cuts AS a JOIN words AS b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cuts AS a JOIN words AS b ON a.rest = b.word),
        ranked AS (
            SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k
            FROM near),
        forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
            FROM words LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (word)),
        walk AS (
            SELECT word, word AS at, form AS next FROM forms
            UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next)
        SELECT word, form, walk.at AS root, n, n_near::BIGINT AS n_near, form_n
        FROM forms JOIN walk USING (word) WHERE walk.next IS NULL""",
}
