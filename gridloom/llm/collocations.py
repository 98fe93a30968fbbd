"""Operator 13: collocations, by Apriori passes over the levels of phrase length.

Pass k counts phrases of k words. A phrase can only be frequent if the two phrases of k-1 words that overlap in it are, so
each pass gets the frequent ones of the passes before, as bitmaps of a bounded size, and emits nothing else. A bitmap never
misses a member and sometimes has too much; counts decide, so results are exact however full it is. Counts are added up by
array within a run of texts, then by key in the cluster. Scores come from joins with the tables of the levels alone.

Texts are lower-cased (A-Z), split into pieces at ``BREAKS``, and those into words at spaces and tabs. Everything is by
language. A null text has no words, a null language is ``und``. Repeated rows count each time; a language without
candidates has no row, an empty table gives an empty table, and other columns are not read. A text of any length is
read whole. Equal scores and counts are ranked by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import read_table, slices
from gridloom.llm.word_arrays import Bitmap, bitmap, chained, hashes, kinds, words_of
from gridloom.plans.scratch import Scratch

BREAKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
LONGEST, LEAST, TOP = 3, 10, 2000
#: A phrase within a longer one goes if that has so many hundredths of its occurrences.
WITHIN = 50
#: Text that is counted together, in bytes.
RUN_BYTES = 2 << 20


def _language(column: pa.Array) -> pa.Array:
    return column.cast(pa.string()).fill_null("und")


def _levels(batch: pa.RecordBatch, level: int, frequent: list[Bitmap]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Languages, phrases and counts of ``level`` words of a run of texts; at level 1 also all words, as phrase null."""
    words = words_of(batch.column(1), kinds(BLANKS, BREAKS))
    size = len(words.code)
    if not size:
        return
    langs = _language(batch.column(0)).dictionary_encode()
    lang = langs.indices.to_numpy().astype(np.int64)[words.row]
    lang_hash = hashes(langs.dictionary.cast(pa.large_binary()))
    word_hash = hashes(words.dictionary)
    if level == 1:
        n = np.bincount(lang, minlength=len(langs.dictionary))
        some = np.flatnonzero(n)
        yield langs.dictionary.take(pa.array(some)), pa.nulls(len(some), pa.large_binary()), n[some]
    wide = len(words.dictionary)
    # gram: a number for each different phrase that starts at a place of ``at``; hash: by that number
    at, key = np.arange(size), lang * wide + words.code
    for k in range(1, level + 1):
        if k > 1:
            # both overlapping phrases of k-1 words have to be there and frequent
            begins = np.flatnonzero(passed)
            place = np.full(size + 1, -1, np.int64)
            place[at[begins]] = begins
            here, there = place[:-1], place[1:]
            at = np.flatnonzero((here >= 0) & (there >= 0) & words.follows)
            key = gram[here[at]] * wide + words.code[at + k - 1]
            before = hashed[gram[here[at]]]
        if k == level:
            _, first, count = np.unique(key, return_index=True, return_counts=True)
        else:
            _, first, gram = np.unique(key, return_index=True, return_inverse=True)
            begin = lang_hash[lang[at[first]]] if k == 1 else before[first]
            hashed = chained(begin, word_hash[words.code[at[first] + k - 1]])
            passed = frequent[k - 1].has(hashed)[gram]
    places = at[first]
    parts = [words.dictionary.take(pa.array(words.code[places + j])) for j in range(level)]
    phrase = parts[0] if level == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
    yield langs.dictionary.take(pa.array(lang[places])), phrase, count


def _counted(docs: DataFrame, level: int, frequent: list, text: str, lang: str, least: int) -> DataFrame:
    """``(lang, phrase, f)`` of the phrases of ``level`` words that occur often enough; at level 1 also (lang, null, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [b.value for b in frequent]
        for batch in batches:
            for part in slices(batch, RUN_BYTES):
                for langs, phrases, counts in _levels(part, level, maps):
                    for begin in range(0, len(counts), 1 << 16):
                        own = slice(begin, begin + (1 << 16))
                        yield pa.RecordBatch.from_arrays(
                            [langs[own], phrases[own].cast(pa.large_string()).cast(pa.string()), pa.array(counts[own], pa.int64())], names=["lang", "phrase", "f"]
                        )

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(f"f >= {least} OR phrase IS NULL")


def _members(batch: pa.RecordBatch) -> np.ndarray:
    """64 bits of each row's language and phrase, as a pass has them."""
    out = hashes(batch.column(0).cast(pa.large_binary()))
    words = pc.split_pattern(batch.column(1).cast(pa.large_string()), " ")
    lists = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    width = len(lists.flatten()) // max(1, len(lists))
    flat = hashes(lists.flatten().cast(pa.large_binary())).reshape(len(lists), width)
    for j in range(width):
        out = chained(out, flat[:, j])
    return out


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """Written tables ``(lang, phrase, f)`` of the frequent phrases of 1 to ``longest`` words; the first also holds
    ``(lang, null, n)``, all words of a language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    levels, frequent = [], []
    for level in range(1, longest + 1):
        table = scratch.save(_counted(docs, level, frequent, text, lang, least), f"level{level}")
        levels.append(table)
        if level < longest:
            own = table.where("phrase IS NOT NULL")
            frequent.append(spark.sparkContext.broadcast(bitmap(own.select("lang", "phrase"), _members, own.count())))
    return levels


def scored(levels: list[DataFrame]) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of each frequent phrase of two or more words, at its lowest-scoring cut."""
    known = levels[0].where("phrase IS NOT NULL")
    for table in levels[1:-1]:
        known = known.unionByName(table)
    grams = levels[1]
    for table in levels[2:]:
        grams = grams.unionByName(table)
    side = lambda part, n: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(n))
    words = grams.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = words.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " "))
    both = cuts.drop("w").join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    a, wide = F.col("a").cast("decimal(15,0)"), "decimal(19,0)"
    top = (F.lit(1_000_000).cast("decimal(7,0)") * a * a).cast("decimal(38,0)")
    below = (F.col("l").cast(wide) * F.col("r").cast(wide)).cast("decimal(38,0)")
    # the quotient's floor is within 64 bits: neither part is rarer than the phrase
    both = both.withColumn("_top", top).withColumn("_below", below).withColumn("score", F.expr("_top div _below"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def not_within_longer(grams: DataFrame, levels: list[DataFrame], within: int = WITHIN) -> DataFrame:
    """Without the phrases that a longer frequent one holds in ``within`` hundredths of their occurrences or more."""
    parts = None
    for size, table in enumerate(levels[2:], start=3):
        words = table.select("lang", "f", F.split("phrase", " ").alias("w"))
        for k in range(2, size):
            own = words.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.lit(size - k + 1)), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))).alias("phrase"))  # noqa: B023
            parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        return grams
    longer = parts.groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    return grams.join(longer, ["lang", "phrase"], "left").where(f"_f IS NULL OR 100 * _f < {within} * a").drop("_f")


def ranked(grams: DataFrame, top: int = TOP) -> DataFrame:
    """``rank`` within the language, and the first ``top`` rows of each, whatever share of the rows a language has.

    Rows are dealt by ranges of the order, so a partition has as many as another; how many of a language stand in the
    partitions before gives a row's rank.
    """
    spark = grams.sparkSession
    scratch = Scratch(spark, "ranks")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = scratch.save(grams, "grams")
    placed = scratch.save(whole.repartitionByRange(parts, "lang", *order).withColumn("_p", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("lang", "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("lang").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("lang", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")).where(F.col("_begin") < top)
    own = F.row_number().over(Window.partitionBy("_p", "lang").orderBy(*order))
    return placed.join(begins, ["lang", "_p"]).withColumn("rank", (F.col("_begin") + own).cast("long")).where(F.col("rank") <= top).drop("_p", "_begin")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, within: int = WITHIN, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best phrases of 2 to ``longest`` words."""
    if longest < 2:
        raise ValueError("phrases have two words at least")
    levels = phrase_counts(docs, longest, least, text, lang)
    best = ranked(not_within_longer(scored(levels), levels, within), top)
    all_words = levels[0].where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    return best.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language of ``documents``."""
    return collocations(read_table(spark, sf_dir, "documents"))


_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM lists, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM c),
sides AS (SELECT cuts.lang, cuts.size, cuts.phrase, a, cuts.k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts
    JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cuts.k], ' ') AND x.k = cuts.k
    JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cuts.k + 1:], ' ') AND y.k = size - cuts.k),
lowest AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS f FROM c WHERE size = 3),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 50 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLE_SQL = {"op13_collocations": _SQL}
