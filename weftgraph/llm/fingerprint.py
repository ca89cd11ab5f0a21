"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph is hashed by SHAKE-256 to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors. The sum does not depend on the order of paragraphs, and a paragraph is inserted or
deleted by adding or subtracting its vector. Two parts make up the vector: WIDE lanes modulo 2**32 that
every paragraph fills (equality), and LEVELS times BINS lanes modulo 2**8 for likeness. For these a
paragraph falls into pieces: its sentences, cut further to runs of RUN words, so that a text of one
paragraph, too, is like its own edit. A piece fills the one bin that its hash picks in level 0, and the same in
each further level with half the chance of the level before, so that level l holds about one in 2**l of the
pieces. Likeness reads the first level whose bins are not crowded: the share of pieces of either document
that both have, from how many bins are filled and how many differ. It does not sink with the length of
documents until the last level is crowded, at about 2**(LEVELS - 1) * BINS pieces.

A paragraph is a line with a character besides white space, without white space at its ends.

Defined cases: a null text is empty; the empty multiset has the zero vector, like itself (1.0) and
unlike others; documents whose paragraphs are the same in another order have equal fingerprints; a
null doc_id sorts first; repeated rows are neighbours in the order of (doc_id, text) and give one row
each; the only row of a table is its own successor; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import borders, range_of, read, text_of

WIDE, BINS, LEVELS = 32, 64, 14
LANES = WIDE + BINS * LEVELS
RUN = 8
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: A word of more than 64 characters (a text without spaces) counts as several.
WORDS = re.compile(rf"\S{{1,64}}(?:\s+\S{{1,64}}){{0,{RUN - 1}}}")
#: A level with more filled bins than this is crowded.
CROWDED = 40
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Characters of text, and lanes, that are handled at a time.
BATCH_CHARS = 1_000_000
#: Bytes of text in a range.
RANGE_BYTES = 16 << 20


def paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, text.split("\n")) if p]


def runs(paragraph: str) -> list[str]:
    """The pieces of a paragraph."""
    return [run for sentence in SENTENCE.split(paragraph) for run in WORDS.findall(sentence)]


def vector(paragraph: str) -> np.ndarray:
    """The wide vector of one paragraph."""
    return sums([[paragraph]])[0]


def reduced(lanes: np.ndarray) -> np.ndarray:
    """Lanes modulo their powers: 2**32 (of themselves) and, of likeness, 2**8."""
    out = lanes.astype(np.uint32)
    out[..., WIDE:] &= np.uint32(0xFF)
    return out


def written(fingerprint: np.ndarray) -> str:
    """Hex digits of the WIDE lanes in four bytes each and the others in one."""
    return (fingerprint[:WIDE].astype("<u4").tobytes() + fingerprint[WIDE:].astype(np.uint8).tobytes()).hex()


def _levels(lane: np.ndarray) -> np.ndarray:
    """How many levels hold each piece: one more than the zeros that end the part of its lane above the bin."""
    rest = (lane // BINS) | np.uint32(1 << (LEVELS - 1))
    return np.log2(rest & -rest).astype(np.int64) + 1


def sums(lists: list[list[str]]) -> np.ndarray:
    """The sum of the vectors of each list; all lists' paragraphs are handled together."""
    out = np.zeros((len(lists), LANES), np.uint32)
    raw = b"".join(hashlib.shake_256(p.encode("utf-8", "surrogatepass")).digest(4 * WIDE) for ps in lists for p in ps)
    lanes = np.frombuffer(raw, "<u4").reshape(-1, WIDE)
    sizes = np.array([len(ps) for ps in lists], dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    out[full, :WIDE] = np.add.reduceat(lanes, starts, axis=0, dtype=np.uint32)
    cut = [[r for p in ps for r in runs(p)] for ps in lists]
    owner = np.repeat(np.arange(len(lists)), [len(rs) for rs in cut])
    pairs = np.frombuffer(b"".join(hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=8).digest() for rs in cut for r in rs), "<u4").reshape(-1, 2)
    levels = _levels(pairs[:, 0])
    flat = out.reshape(-1)
    for level in range(int(levels.max(initial=0))):
        held = np.flatnonzero(levels > level)
        np.add.at(flat, owner[held] * LANES + WIDE + level * BINS + pairs[held, 0] % BINS, pairs[held, 1])
    return reduced(out)


def insert(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return reduced(fingerprint + vector(paragraph))


def delete(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return reduced(fingerprint - vector(paragraph))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of fingerprints: the estimated share of pieces of either that both have; 1 if they are equal.

    With n pieces in m bins a bin stays empty with chance (1 - 1/m)**n, and agrees with the other's if
    none of the pieces that differ falls in it; so each count is the logarithm of a share of bins.
    """
    x, y = (v[:, WIDE:].reshape(-1, LEVELS, BINS) for v in (a, b))
    filled = ((x != 0) | (y != 0)).sum(axis=2)
    level = np.where((filled <= CROWDED).any(axis=1), (filled <= CROWDED).argmax(axis=1), LEVELS - 1)
    row = np.arange(len(a))
    either, differ = filled[row, level], (x[row, level] != y[row, level]).sum(axis=1)
    # Half a bin stands in for none, where all are filled or differ.
    held, changed = (-np.log(np.maximum(BINS - n, 0.5) / BINS) for n in (either, differ))
    share = np.where(differ >= either, 0.0, 1 - changed / np.where(held > 0, held, 1.0))
    return np.where((a == b).all(axis=1), 1.0, np.clip(share, 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of the following text (or all of it)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results of ids, whose successors' texts follow: texts has one more."""
    both = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own = sums([paragraphs(t) for t in texts])
    # The edit leaves the paragraphs before the cut as they are: take the changed ones out, put the new ones in.
    out_of, into = [], []
    for a, e in zip(texts, both):
        cut = a.rfind("\n", 0, len(a) - len(a) // 4) + 1
        out_of.append(paragraphs(a[cut:]))
        into.append(paragraphs(e[cut:]))
    new = reduced(own[:-1] - sums(out_of) + sums(into))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in both], pa.string()),
            pa.array([written(r) for r in own[:-1]], pa.string()),
            pa.array([written(r) for r in new], pa.string()),
            pa.array(likeness(own[:-1], new), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, halo, doc_id, text) in order. Halo rows stand in as successors only."""
    ids, texts, size, open_part, closed = [], [], 0, None, None
    for batch in batches:
        for part, halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != open_part:
                ids, texts, size, open_part, closed = [], [], 0, part, False
            if closed:
                continue  # the halo's repeated rows
            ids.append(doc_id)
            texts.append(text)
            size += len(text) + LANES
            if halo or size >= BATCH_CHARS and len(ids) > 1:
                if len(ids) > 1:
                    yield _rows(ids[:-1], texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
                closed = bool(halo)


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of SCHEMA for every row.

    Texts move once, to ranges of doc_id, and are sorted there; a task streams through its ranges.
    The first document of a range is also sent to the range before it (the first of all to the last),
    as the successor of that range's last row: one more row a range.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.octet_length(text_of("text")).cast("long").alias("bytes"))
    size = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = borders(slim, "doc_id", max(least, -(-size["b"] // range_bytes)), size["n"])
    part = range_of(F.col("doc_id"), cuts)
    rows = docs.select("doc_id", text_of("text").alias("text"))
    # Of each range the smallest id, null before all others: at most MAX_RANGES rows.
    firsts = slim.groupBy(part.alias("part")).agg(F.min(F.struct("doc_id")).alias("first")).orderBy("part").collect()
    firsts = [(r["part"], r["first"]["doc_id"]) for r in firsts]
    halo = [(doc_id, firsts[i - 1][0]) for i, (_, doc_id) in enumerate(firsts)]
    to = F.broadcast(spark.createDataFrame(halo, "_id long, part int"))
    extra = rows.join(to, rows["doc_id"].eqNullSafe(to["_id"])).select("part", F.lit(1).alias("halo"), "doc_id", "text")
    dealt = rows.select(part.alias("part"), F.lit(0).alias("halo"), "doc_id", "text").union(extra)
    n = max(1, len(cuts) + 1)
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "halo", "doc_id", "text")
    return dealt.mapInArrow(_streamed, SCHEMA)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
