"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio.

Every text is a bag of word unigrams and bigrams hashed into a fixed number of
buckets. Two multinomials over the buckets, one of the trusted texts and one of all
texts, give each bucket a weight ln(p_trusted / p_raw); a text's score is the mean
weight of its n-grams, compared with a threshold. Built-in functions and joins only, no
Python in tasks. All trusted texts count: bitmaps of bounded size, broadcast as rows of
64 bits, tell which they are in the task that reads them, and an ordinary join settles the
few that the bitmaps leave open. A text is read and split once: its base columns and the
array of its n-grams' buckets are stored without it. Of these arrays, bucket counts (``buckets``
rows) leave the tasks, and the weights reach the rows as one constant array.

Weights are whole millionths, so sums do not depend on order.

Defined cases: a null or blank text has no words, fails the base rules and is not
kept. Without any trusted text there is no verdict and the base rules alone decide.
Rows are judged one by one, so repeated rows and ids each keep their row; columns of
the input other than the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.common import COUNT_BITS, table
from vinculum.llm.registry import query
from vinculum.session import write_through, write_through_groups

BUCKETS = 1 << 14
THRESHOLD = -0.05  # mean log-likelihood ratio a kept text must reach
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
UNIT = 1_000_000
GROUP_BYTES = 8 << 20  # of buckets that are stored, and read back, together

BLANKS = " \t\n\v\f\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for a null or blank text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def _neighbours(array: str, gap: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of each element and the one ``gap`` places behind it."""
    n = F.greatest(F.size(array) - gap, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(1 + gap), n), combine)


def _crc(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def repeated_words(windows: Column) -> Column:
    """Positions covered by windows found twice or more, from the windows' hashes in order.

    Windows are sorted by hash with their positions; neighbours with the same hash
    give the repeated positions, whose gaps (8 at most) add up to the words covered.
    """
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(  # a let-binding: the sorted windows are computed once
        F.array(by_hash),
        F.lit(0).cast("bigint"),
        lambda _, s: _covered(
            F.sort_array(
                F.array_distinct(
                    F.flatten(
                        F.filter(
                            F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
                            lambda p: p.isNotNull(),
                        )
                    )
                )
            )
        ),
    )


def _covered(positions: Column) -> Column:
    return F.aggregate(
        positions,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p + WINDOW - F.greatest(acc["last"] + WINDOW, p), F.lit(WINDOW))).alias("n")),
        lambda acc: acc["n"],
    )


def with_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the base columns and ``buckets``, of each word and of each pair of neighbours."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.withColumn("words", words_of(F.col(text)))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": F.coalesce(F.length(text) - F.length(F.regexp_replace(F.col(text), F.lit("[#*$%&|<>]+"), F.lit(""))), F.lit(0)).cast("bigint"),
            "lines": lines,
            "pairs": _neighbours("words", 1, lambda a, b: _crc(F.concat(a, F.lit(" "), b))),
        }
    )
    bucket = lambda crc: (crc % buckets).cast("int")
    rows = rows.withColumns(
        {
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
            "buckets": F.concat(F.transform("words", lambda w: bucket(_crc(w))), F.transform("pairs", bucket)),
            "fours": _neighbours("pairs", 2, lambda a, b: F.shiftleft(a, 32).bitwiseOR(b)),
        }
    )
    # A window found twice repeats its ``WINDOW - 3`` runs of four words. Few texts repeat as many, and only theirs
    # are hashed window by window.
    may_repeat = F.size("fours") - F.size(F.array_distinct("fours")) >= WINDOW - 3
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.when(may_repeat, repeated_words(windows)).otherwise(F.lit(0).cast("bigint")))
    return rows.drop("words", "lines", "pairs", "fours")


def _marked_trusted(docs: DataFrame, trusted_ids: DataFrame, key: str, value: str) -> DataFrame:
    """(value, trusted) of every row.

    A bitmap of the trusted ids' hashes tells most rows where they lie: one outside it is not
    trusted. The other ids of ``docs`` that it lets through by chance are found by a join of ids
    alone, and have a bitmap of their own. Only the values in both meet the ids in a join, so
    hardly any value is shuffled. Rows without an id are not trusted.
    """
    hashed = lambda column: F.xxhash64(column).alias("_hash")
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("_trusted")).where("_trusted is not null").distinct()
    ids = write_through(ids.select("_trusted", hashed("_trusted")), "trusted")
    may_be = _bitmap(ids, "_found1")
    named = docs.select(key, hashed(key)).where(F.col(key).isNotNull())
    passed = _looked_up(named, may_be, "_found1").where("_in_found1").select(key, "_hash").distinct()
    wrong = _bitmap(passed.join(ids.select("_trusted"), F.col(key) == F.col("_trusted"), "left_anti"), "_found2")
    rows = _looked_up(_looked_up(docs.select(key, value, hashed(key)), may_be, "_found1"), wrong, "_found2")
    rows = rows.withColumn("_in_found1", F.col("_in_found1") & F.col(key).isNotNull())
    clear = rows.where("not (_in_found1 and _in_found2)").select(value, F.col("_in_found1").alias("trusted"))
    doubtful = rows.where("_in_found1 and _in_found2").join(ids.select("_trusted"), F.col(key) == F.col("_trusted"), "left")
    return clear.unionByName(doubtful.select(value, F.col("_trusted").isNotNull().alias("trusted")))


def _bitmap(ids: DataFrame, name: str) -> DataFrame:
    """The 64-bit words of a bitmap of ``COUNT_BITS`` that the ids' hashes mark, stored: (at, bits), both named
    after ``name``. It has as many rows as ids at the most, and never more than ``COUNT_BITS`` / 64."""
    words = ids.select(_word_of("_hash").alias(f"{name}_at"), _mark_of("_hash").alias("_mark"))
    return write_through(words.groupBy(f"{name}_at").agg(F.bit_or("_mark").alias(name)), "bitmap")


def _looked_up(rows: DataFrame, bitmap: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``_in<name>``: whether the bitmap holds their hash. As its size is bounded, it goes to all tasks."""
    found = rows.join(F.broadcast(bitmap), _word_of("_hash") == F.col(f"{name}_at"), "left")
    inside = F.coalesce(F.col(name).bitwiseAND(_mark_of("_hash")) != 0, F.lit(False))
    return found.select(*rows.columns, inside.alias(f"_in{name}"))


def _word_of(hash_: str) -> Column:
    return F.shiftright(F.pmod(F.col(hash_), F.lit(COUNT_BITS)), 6)


def _mark_of(hash_: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod({hash_}, 64) as int))")


def bucket_weights(rows: DataFrame, trusted_ids: DataFrame, key: str, grams: str, buckets: int) -> DataFrame:
    """One row: ``weights`` array of ln(p_trusted / p_raw) in millionths, null without trusted texts.

    ``grams``: the array of a row's buckets. Both multinomials are smoothed by one count a bucket.
    """
    spark = rows.sparkSession
    grams = _marked_trusted(rows, trusted_ids, key, grams).select("trusted", F.explode(grams).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("own"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    every = every.select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("own", F.lit(0)).alias("own"))
    gathered = every.agg(
        F.sum("raw").alias("n_raw"), F.sum("own").alias("n_own"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "own"))).alias("rows")
    )
    weight = lambda r: F.round(
        F.log(((r["own"] + 1) / (F.col("n_own") + buckets)) / ((r["raw"] + 1) / (F.col("n_raw") + buckets))) * UNIT
    ).cast("bigint")
    return gathered.select(F.when(F.col("n_own") > 0, F.transform("rows", weight)).alias("weights"))


def as_constant(weights: list[int] | None) -> Column:
    """The ``buckets`` weights as a constant array (null for None); parsed once, when the plan is made."""
    text = F.lit(None if weights is None else ",".join(map(str, weights))).cast("string")
    return F.split(text, ",").cast("array<bigint>")


def trusted_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """All ids labelled good."""
    return labels.where(F.col("quality") == 1).select(key).where(F.col(key).isNotNull()).distinct()


def quality_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    repeat_percent: int = REPEAT_PERCENT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Key, base columns, ``base_failed``, ``kept`` and the sum of weights of each row.

    Columns named in ``keep`` are returned in front instead of the key.
    """
    keep = keep or (key,)
    docs = docs.select(*(F.col(c).alias(f"_kept{i}") for i, c in enumerate(keep)), F.col(key).alias("_key"), F.col(text).alias("_text"))
    key, text = "_key", "_text"
    counted = with_counts(docs, text, buckets).drop(text)
    # Large groups of rows would be read back as large batches of arrays.
    rows = write_through_groups(counted, "counted", GROUP_BYTES)
    weights = as_constant(bucket_weights(rows, trusted_ids, key, "buckets", buckets).first()["weights"])
    limit = round(threshold * UNIT)
    rows = rows.withColumns(
        {
            "n_grams": F.size("buckets").cast("bigint"),  # multiplied with the limit below, which an int holds for 42,949 only
            "total": F.aggregate("buckets", F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(weights, b)),
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")),
        }
    )
    judged = rows.select(
        *(F.col(f"_kept{i}").alias(c) for i, c in enumerate(keep)),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("total") >= limit * F.col("n_grams"), F.lit(True))).alias("kept"),
        F.col("total").alias("llr_total"),
        F.spark_partition_id().alias("_task"),
    )
    # A filter on these columns must not move below the projections: it would add up the weights twice. A column that is not deterministic holds it back.
    return judged.where("_task >= 0").drop("_task")


# DuckDB has no crc32: bytes are folded with the table of the polynomial 0xEDB88320, made by its rule.
SQL = rf"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts)
), repeated AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id
), grams AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM texts
), hashed AS (
  SELECT gram, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(gram), 2), lambda i: ('0x' || substr(hex(encode(gram)), i, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT gram FROM grams), crc
), trusted AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL
), counts AS (
  SELECT bucket, count(*) AS raw, count(trusted.doc_id) AS own
  FROM grams JOIN hashed USING (gram) LEFT JOIN trusted USING (doc_id) GROUP BY bucket
), weights AS (
  SELECT bucket, CAST(round(ln(((own + 1) / (sum(own) OVER () + {BUCKETS})) / ((raw + 1) / (sum(raw) OVER () + {BUCKETS}))) * {UNIT}) AS BIGINT) AS weight FROM counts
), scores AS (
  SELECT doc_id, count(*) AS n, sum(weight) AS total FROM grams JOIN hashed USING (gram) JOIN weights USING (bucket) GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN repeated USING (doc_id)
)
SELECT *, NOT base_failed AND coalesce(total >= {round(THRESHOLD * UNIT)} * n, true) AS kept, CAST(coalesce(total, 0) AS BIGINT) AS llr_total FROM (
  SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, n, total FROM base LEFT JOIN scores USING (doc_id))
"""
SQL = f"SELECT * EXCLUDE (n, total) FROM ({SQL})"


@query("op1_quality_rules", SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted_labels(table(spark, sf_dir, "labels")))
