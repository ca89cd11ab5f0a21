"""Quality rules by cross-document line frequency.

Every line is normalised (lower case, white space collapsed) and hashed; for each host the
distinct documents that contain a line are counted; a line in more documents than the limits
allow is boilerplate of that host and is removed from all of its documents but the first (the
smallest doc_id), and a document that loses too large a part of its text is rejected.

Limits: a line is boilerplate if it stands in more than ``min_docs`` distinct documents of a host and
besides in more than ``share`` of the host's documents or, however large the host, in more than
``most_docs``. Copies are documents of their own, so text that many documents of a host share is
boilerplate whether or not the rest of them differs; with ``one_per_text`` documents of one host with
equal texts count as one. A document is depleted if less than ``min_left`` of its word characters stay.

Base rules besides: fewer than 50 words, or more than half of the words in repeated 3-word windows.

Defined cases: a null text is empty (no words: base_failed); a null host is a host of its own; a
null doc_id never counts as the first document (rows without one are told apart by their texts);
repeated rows are one document for the counts and give one result row each; an empty table gives no rows; other columns, whatever their
names, are ignored by :func:`assess` and kept by :func:`clean`.

Everything is a DataFrame expression. One scan of the texts writes a slim table of numbers and line
hashes; what is shuffled are line hashes, pre-aggregated, and never texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, let, materialise, read, text_of, total, unpacked, whole, with_text, without_separators, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, SHARE, MOST_DOCS, MIN_LEFT = 10, 0.05, 1000, 0.3
SYMBOLS = "#*$%&|<>"
#: Most boilerplate lines (24 bytes each) that are broadcast.
BROADCAST_LINES = 100_000


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SEPARATORS)) != "")


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SEPARATORS)), "[ \\x09-\\x0D]+", " "))


def repeated_words(array: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Windows are first sorted as (32-bit hash, position) packed into longs; only those whose hash
    meets a neighbour's are compared as strings, so equal hashes of different windows do no harm.
    """

    def exact(w: Column, positions: Column) -> Column:
        windows = F.array_sort(F.transform(positions, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i"))))

        def starts(sorted_windows: Column) -> Column:
            twins = F.filter(sorted_windows, lambda x, k: (F.get(sorted_windows, k - 1)["s"] == x["s"]) | (F.get(sorted_windows, k + 1)["s"] == x["s"]))
            return F.sort_array(F.transform(twins, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            gaps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))).cast("long"))
            return total(gaps)

        return let(let(windows, starts), covered)

    def of(w: Column) -> Column:
        packed = F.sort_array(F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.shiftleft(F.hash(x, F.get(w, i + 1), F.get(w, i + 2)).cast("long"), 32).bitwiseOR(i.cast("long"))))

        def candidates(p: Column) -> Column:
            twins = F.filter(p, lambda v, k: (F.shiftright(F.get(p, k - 1), 32) == F.shiftright(v, 32)) | (F.shiftright(F.get(p, k + 1), 32) == F.shiftright(v, 32)))
            return F.transform(twins, lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))

        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(let(packed, candidates), lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(exact(w, c))))

    return let(array, of)


def _digests(docs: DataFrame, host: str) -> DataFrame:
    """One slim row for each input row: base counts, and (hash, word characters) of each line."""
    text = F.col("_text")
    rows = docs.select("doc_id", F.col(host).alias("_host"), text_of("text").alias("_text"))
    rows = rows.withColumn("_words", words(text)).withColumn("_lines", lines_with_words(text))
    rows = rows.select(
        "doc_id",
        "_host",
        F.xxhash64(text).alias("_content"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(without_separators(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.col("_lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.length(without_separators(x)).cast("long").alias("c"))).alias("_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return materialise(rows.withColumn("base_failed", failed).withColumn("_row", F.monotonically_increasing_id()), "line-digests")


@dataclass(frozen=True)
class Limits:
    """See the head of the module."""

    min_docs: int = MIN_DOCS
    share: float = SHARE
    most_docs: int = MOST_DOCS
    min_left: float = MIN_LEFT
    one_per_text: bool = False


def _boilerplate(digests: DataFrame, limits: Limits) -> DataFrame:
    """_of (host), _line, _first (document) of the lines above the limits."""
    own = ["_host", "_content"] if limits.one_per_text else ["_host", "_content", "doc_id"]
    # What repeats a document is told from slim rows, so that lines are counted, and combined on the map
    # side, in one step: a line that a third of all documents share reaches its reducer as one row a task.
    docs = digests.groupBy(*own).agg(F.count("*").alias("_n"), F.min("_row").alias("_keep"), F.min("doc_id").alias("_id"))
    docs = materialise(docs, "line-docs")
    hosts = docs.groupBy(F.col("_host").alias("_of")).agg(F.count("*").alias("_docs"))
    several = docs.where("_n > 1")
    same = [digests[c].eqNullSafe(several[c]) for c in own]
    again = digests.join(several, same).select(digests["_row"].alias("_again"), "_keep").where(F.col("_again") != F.col("_keep"))
    once = digests.join(again, digests["_row"] == again["_again"], "left_anti")
    counts = once.select("_host", "doc_id", F.explode(F.array_distinct("_lines.h")).alias("h")).groupBy("_host", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("_first"))
    frequent = counts.where(F.col("n") > limits.min_docs).join(hosts, F.col("_host").eqNullSafe(F.col("_of")))
    return frequent.where((F.col("n") > limits.share * F.col("_docs")) | (F.col("n") > limits.most_docs)).select("_of", F.col("h").alias("_line"), "_first")


def _hits(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The lines (_host, doc_id, h) that are boilerplate, but for those of their first document."""
    on = lines["_host"].eqNullSafe(found["_of"]) & (lines["h"] == found["_line"])
    return lines.join(F.broadcast(found) if found.count() <= BROADCAST_LINES else found, on).where(~F.col("doc_id").eqNullSafe(F.col("_first")))


def _verdicts(digests: DataFrame, limits: Limits) -> DataFrame:
    """digests with the removed lines' hashes, what they hold, and kept."""
    lines = digests.select("_row", "_host", "doc_id", F.explode("_lines").alias("_l")).select("_row", "_host", "doc_id", "_l.h", "_l.c")
    hits = _hits(lines, materialise(_boilerplate(digests, limits), "boilerplate"))
    lost = hits.groupBy("_row").agg(F.sum("c").alias("removed_chars"), F.count("*").alias("n_removed_lines"))
    out = digests.drop("_lines").join(lost, "_row", "left").fillna(0, ["removed_chars", "n_removed_lines"])
    depleted = F.col("word_chars") - F.col("removed_chars") < limits.min_left * F.col("word_chars")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def assess(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Counts and verdict of every row."""
    out = _verdicts(_digests(docs, host), limits)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "removed_chars")


def clean(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows that are kept, with boilerplate lines removed from text and n_chars (if there) set anew.

    The same rules as in :func:`assess`. If the counted boilerplate lines are at most BROADCAST_LINES
    their table is broadcast and texts don't move. Beyond that it meets the texts by a shuffle on the
    documents that hold such lines.
    """
    slim = docs.select("doc_id", F.col(host).alias("_host"), text_of("text").alias("_text"))
    slim = slim.select("doc_id", "_host", F.xxhash64("_text").alias("_content"), F.transform(lines_with_words(F.col("_text")), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"))).alias("_lines"))
    slim = materialise(slim.withColumn("_row", F.monotonically_increasing_id()), "line-hashes")
    found = materialise(_boilerplate(slim, limits), "boilerplate")
    rows = docs.select(whole(docs), F.col(host).alias("_host"), F.col("doc_id").alias("_id"), text_of("text").alias("_text"))
    if found.count() <= BROADCAST_LINES:
        by_host = found.groupBy("_of").agg(F.collect_list(F.struct("_line", "_first")).alias("_bad"))
        rows = rows.join(F.broadcast(by_host), rows["_host"].eqNullSafe(by_host["_of"]), "left")
        bad = F.transform(F.filter("_bad", lambda b: ~F.col("_id").eqNullSafe(b["_first"])), lambda b: b["_line"])
    else:
        hits = _hits(slim.select("doc_id", "_host", F.explode("_lines.h").alias("h")).distinct(), found)
        hits = hits.groupBy(F.struct("doc_id", "_host").alias("_key")).agg(F.collect_set("h").alias("_bad"))
        rows = rows.join(hits, F.struct(F.col("_id").alias("doc_id"), F.col("_host")).eqNullSafe(F.col("_key")), "left")
        bad = F.col("_bad")
    text = F.col("_text")
    split = F.split(text, "\n", -1)
    # A line without words is never boilerplate: its normal form is empty and was not counted.
    stays = F.when(F.coalesce(F.size("_bad"), F.lit(0)) <= 0, text).otherwise(let(bad, lambda b: F.array_join(F.filter(split, lambda x: ~F.array_contains(b, F.xxhash64(normal_line(x)))), "\n")))
    rows = rows.withColumns({"_stays": stays, "_words": words(text)})
    n = F.size("_words")
    failed = (n < MIN_WORDS) | (100 * repeated_words(F.col("_words")) > MAX_REPEAT_PERCENT * n)
    depleted = F.length(without_separators(F.col("_stays"))) < limits.min_left * F.length(without_separators(text))
    return unpacked(rows.where(~failed & ~depleted).select(with_text(docs, F.col("_stays"))), docs)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read(spark, sf_dir, "documents"))


QUERIES = {"op1_quality_rules": op1_quality_rules}

_SEP = "[ \\x09-\\x0D]"
ORACLE_SQL = {
    "op1_quality_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{_SEP}+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SEP}+', '', 'g') <> '') AS l FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twin AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(3, coalesce(j - i, 3))) AS n FROM twin GROUP BY rid),
base AS (SELECT d.rid, doc_id, source, t, len(w) AS n_words, length(regexp_replace(t, '{_SEP}+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
li AS (SELECT rid, doc_id, source, t, lower(trim(regexp_replace(x, '{_SEP}+', ' ', 'g'))) AS h, length(regexp_replace(x, '{_SEP}+', '', 'g')) AS c
  FROM (SELECT d.rid, doc_id, source, t, unnest(l) AS x FROM d JOIN w USING (rid))),
freq AS (SELECT source, h, count(*) AS n, min(doc_id) AS first FROM (SELECT DISTINCT source, h, doc_id, t FROM li) GROUP BY source, h),
hosts AS (SELECT source, count(*) AS docs FROM (SELECT DISTINCT source, doc_id, t FROM d) GROUP BY source),
bad AS (SELECT f.* FROM freq f JOIN hosts o ON f.source IS NOT DISTINCT FROM o.source WHERE n > {MIN_DOCS} AND (n > {SHARE}::DOUBLE * docs OR n > {MOST_DOCS})),
lost AS (SELECT rid, sum(c) AS removed, count(*) AS n_lines FROM li JOIN bad ON li.source IS NOT DISTINCT FROM bad.source AND li.h = bad.h
  WHERE li.doc_id IS DISTINCT FROM bad.first GROUP BY rid),
v AS (SELECT b.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, coalesce(removed, 0) AS removed_chars, coalesce(n_lines, 0) AS n_removed_lines
  FROM base b LEFT JOIN lost USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT (word_chars - removed_chars < {MIN_LEFT}::DOUBLE * word_chars) AS kept,
  CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(removed_chars AS BIGINT) AS removed_chars
FROM v
"""
}
