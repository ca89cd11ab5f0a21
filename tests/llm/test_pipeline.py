"""The pipeline's stages, each on its own input, against plain statements; and awkward tables through all of them."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import mixing, pieces, private_data

from .helpers import AWKWARD
from .test_operators import WORD, plain_groups, plain_repeats
from .test_spans import plain_spans

NAMES = ("_row", "_text", "_host", "_id", "_s", "_k", "_hash", "_part", "_source", "_twin", "position", "slot")


def table():
    rng = random.Random(51)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(40):
        w = [word() for _ in range(120)]
        for j in range(rng.choice((1, 1, 2, 4))):
            v = list(w)
            v[rng.randrange(120)] = word()
            extra = rng.choice(("", "\nHome  About\tContact", "\nwrite to me@host.org or 10.0.0.1", '\ntoken = "0123456789abcdef0123456789abcdef"'))
            rows.append((len(rows), " ".join(v) + extra, f"src{i % 3}" if i % 5 else None))
    rows += [(200 + i, "spam spam " * 60, "src1") for i in range(3)] + [(300, "word " * 10, "src2")]
    return rows + [(1000 + (d or 0) if d else None, t, s) for d, t, s in AWKWARD]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), "doc_id long, text string, source string").withColumns({"n_chars": F.length("text").cast("long"), **{n: F.lit(1) for n in NAMES}})


def told(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_quality_rules(spark, docs):
    rows = table()
    normal = lambda x: " ".join(WORD.findall(x)).lower()
    holds, hosts = {}, {}
    for d, t, s in set(rows):
        hosts.setdefault(s, set()).add((d, t or ""))
        for line in {normal(x) for x in (t or "").split("\n") if WORD.search(x)}:
            holds.setdefault((s, line), set()).add((d, t))
    first = {k: min((d for d, _ in v if d is not None), default=None) for k, v in holds.items()}
    bad = {k for k, v in holds.items() if len(v) > 10 and (len(v) > 0.05 * len(hosts[k[0]]) or len(v) > 1000)}
    assert bad
    want = []
    for d, t, s in rows:
        w = WORD.findall(t or "")
        stays = "\n".join(x for x in (t or "").split("\n") if (s, normal(x)) not in bad or d is not None and d == first[s, normal(x)])
        count = lambda x: len(re.sub(r"[\x20\x09-\x0D]", "", x))
        if len(w) >= 50 and 100 * plain_repeats(w) <= 50 * len(w) and count(stays) >= 0.3 * count(t):
            want.append((d, stays, s))
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert got.columns == docs.columns and told(got) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_near_duplicates(spark, docs):
    rows = table()
    group = plain_groups([r for r in rows if r[0] is not None], 5, 80)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    kept = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert got.columns == docs.columns and kept == sorted({top for _, top in group.values()})


def test_private_spans(spark, docs):
    model, thresholds = private_data.model_for(spark)
    want = []
    for d, t, s in table():
        found = sorted((int(a), int(b), private_data.KINDS.index(k)) for k, a, b in (x.split(":") for x in plain_spans(t or "", model, thresholds).split(",") if x))
        out, at = [], 0
        for a, b, k in found:
            if a >= at:
                out += [(t or "")[at:a], f"<{private_data.KINDS[k].upper()}>"]
            at = max(at, b)
        want.append((d, "".join(out) + t[at:] if found else t, s))
    got = corpus_pipeline.private_spans(spark, docs, "")
    assert got.columns == docs.columns and told(got) == sorted(want, key=str)


def test_mixed_sources(spark, docs):
    """Every source's rows in the order of their hashes, dealt in blocks of 64 by plain earliest deadline first."""
    rows = table() + [(5000 + i, f"text {i}", "src0" if i % 3 else "src1") for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    number = lambda b: int(hashlib.md5(b).hexdigest()[:15], 16)

    def key(r):
        twin = number((r[1] or "").encode())
        return number(f"{mixing.SEED}:{'' if r[0] is None else r[0]}:{twin}".encode())

    weights, left = {**mixing.WEIGHTS, "*": mixing.OTHER}, {}
    for r in sorted(rows, key=key):
        left.setdefault(r[2] if r[2] in mixing.WEIGHTS else "*", []).append(r)
    left = {s: [q[i : i + 64] for i in range(0, len(q), 64)] for s, q in left.items()}
    want, alive = [], None
    while any(left.values()):
        alive = alive or {s: 0 for s in left if left[s]}
        total, slot = sum(weights[s] for s in alive), sum(alive.values())
        ready = [s for s in alive if alive[s] * total // weights[s] <= slot]
        best = min(ready, key=lambda s: (-(-(alive[s] + 1) * total // weights[s]), -(-(alive[s] + 2) * total // weights[s]), s))
        if not left[best]:
            alive = None
            continue
        alive[best] += 1
        want += left[best].pop(0)
    assert [(r.doc_id, r.text, r.source) for r in corpus_pipeline.mixed_sources(spark, many, "").collect()] == want
    mixed = corpus_pipeline.mixed_sources(spark, docs, "")
    assert mixed.columns == docs.columns and told(mixed) == told(docs)


def test_encoded(spark, docs):
    with open(pieces.MODEL, "rb") as f:
        v = pieces._vocabulary(f.read())
    got = sorted((str(r.doc_id), pieces.decode(v, __import__("numpy").array(r.tokens)) if r.tokens else "") for r in corpus_pipeline.encoded(spark, docs, "").collect())
    assert got == sorted((str(d), t or "") for d, t, _ in table())


def test_all_stages_on_awkward_and_empty_tables(spark, docs, tmp_path):
    for name, df in (("some", docs), ("none", docs.limit(0))):
        df.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert all(r.lossless for r in got) and bool(got) == (name == "some")
        assert 0 in {r.doc_id for r in got} or name == "none"
