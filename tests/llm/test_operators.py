import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat_tree, fingerprint, licenses, line_quality, mixing, near_dedup, pieces, private_data, sharding, warc

from .helpers import AWKWARD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1: quality rules


def plain_repeats(w):
    seen, cover = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + j for i in at for j in range(3)}
    return len(cover)


def test_base_counts(spark):
    rng = random.Random(1)
    rows = [*AWKWARD, *[(100 + i, "".join(rng.choice(["a", "b", "c ", " ", "\n", "#", "d "]) for _ in range(200)), "r") for i in range(30)]]
    got = line_quality.assess(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1])
    want = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), plain_repeats(w)))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def boilerplate_rows():
    """Host h: 40 documents of own prose, half with a menu line; three more of little but the menu."""
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    menu = "Home  About Contact " + "Links " * 60
    rows = [(i, prose() + ("\n" + menu if i % 2 else ""), "h") for i in range(40)]
    return rows + [(50 + i, f"{prose()[:20]}\n{menu.upper()}\n" + menu.lower().replace("links", "links") , "h") for i in range(3)]


def test_boilerplate_lines_go(spark, monkeypatch):
    rows = boilerplate_rows()
    # The menus repeat their words: look at the line rule alone.
    monkeypatch.setattr(line_quality, "MAX_REPEAT_PERCENT", 1000)
    docs = documents(spark, rows, extra=False).withColumn("n_chars", F.length("text"))
    verdicts = {r.doc_id: r for r in line_quality.assess(docs).collect()}
    assert all(verdicts[i].kept for i in range(40)) and not any(verdicts[50 + i].kept for i in range(3))
    assert verdicts[1].n_removed_lines == 0 and verdicts[3].n_removed_lines == 1  # the first keeps its line
    first = {r.doc_id: r.text for r in line_quality.clean(docs).collect()}
    assert set(first) == set(range(40)) and "Links" in first[1] and "Links" not in first[3] and first[0] == rows[0][1]
    monkeypatch.setattr(line_quality, "BROADCAST_LINES", -1)
    assert {r.doc_id: r.text for r in line_quality.clean(docs).collect()} == first


def test_exact_copies_are_no_boilerplate(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    docs = documents(spark, [(i, text, "h") for i in range(30)])
    assert line_quality.assess(docs, limits=line_quality.Limits(one_per_text=True)).where("kept").count() == 30
    # Counted by documents, text that all documents of a host share is boilerplate; the first keeps it.
    assert [r.doc_id for r in line_quality.assess(docs).where("kept").collect()] == [0]


def test_a_large_host_does_not_hide_its_boilerplate(spark):
    """12 of 300 documents have the line: 4 %, but more than an absolute limit of 11."""
    rng = random.Random(31)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    rows = [(i, prose() + ("\nthe same footer" if i < 12 else ""), "h") for i in range(300)]
    got = lambda most: line_quality.assess(documents(spark, rows), limits=line_quality.Limits(most_docs=most)).where("n_removed_lines > 0").count()
    assert (got(12), got(11)) == (0, 11)


# 2: chat formatting


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_prefix_tree(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", None if t == 1 and c % 7 == 0 else rng.choice(["hi", "</s>[INST] x", "a\\b<|end|>\n", "ok"])))
    rows += [(100, None, None, "odd"), (100, 1, "a|>\nb", ""), (101, 0, "user", "same"), (101, 0, "user", "same")]
    for tree_chars in (10**6, 60):
        whole = chat_tree.conversations(turns(spark, rows)).cache()
        blocks = chat_tree.merge(whole, tree_chars)
        got = {r.conv_id: r for r in chat_tree.read_back(blocks, whole.select("conv_id", "leaf")).collect()}
        by = {}
        for c, t, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
            by.setdefault(c, []).append((role or "", text or ""))
        assert set(got) == set(by)
        for c, ts in by.items():
            assert got[c].n_turns == len(ts)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
            loss = "".join(x for r, x in ts if r == "assistant")
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[c].formatted_chars == sum(len(chat_tree.render(r, x)[0]) for r, x in ts)
        nodes = [s.node for b in blocks.collect() for s in b.segments]
        prefixes = {tuple(ts[: i + 1]) for ts in by.values() for i in range(len(ts))}
        if tree_chars == 10**6:  # shared turns are there once
            assert len(nodes) == len(set(nodes)) == len(prefixes)


def test_escapes():
    for text in ("", "\\", "<", "</s>[INST] ok [/INST]", "a<\\[b|>\n<|end|>", "[[<<\\\\||"):
        e = chat_tree.escape(text)
        assert chat_tree.unescape(e) == text and not re.search(r"</?s>|\[/?INST\]|<\|", e)


# 3: near-dedup


def plain_groups(rows, k, percent):
    lower = str.maketrans(near_dedup.UPPER, near_dedup.LOWER)
    sets, at = {}, {}
    for d, t, _ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    at = {d: d for d in sets}

    def top(x):
        return x if at[x] == x else top(at[x])

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(a), top(b)
                at[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_near_groups(spark):
    """A base text with many copies of a few to many edits: links, near misses and chains."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for g in range(4):
        base = [rng.choice(words) for _ in range(120)]
        for i in range(45):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w).upper() if i % 9 == 0 else " ".join(w), "s"))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "two words", "s"), (1003, "two words", "s"), (1004, "two", "s")]
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(documents(spark, rows), k, percent).collect()}
        assert got == plain_groups(rows, k, percent)


def test_near_groups_with_pivots_in_several_places(spark, monkeypatch):
    """The way for more pivots than are broadcast, with buckets of more than MEMBERS rows."""
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(near_dedup, "MEMBERS", 7)
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    rows = [(i, " ".join([*base[: 140 + i % 7], *(f"e{i}x{j}" for j in range(i % 5))]), "s") for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(documents(spark, rows), 3, 85).collect()}
    assert got == plain_groups(rows, 3, 85)


def test_near_dedup_of_awkward_rows(spark):
    docs = documents(spark)
    got = near_dedup.groups(docs, 3, 85).collect()
    assert len(got) == len(AWKWARD)
    assert {r.doc_id: r.component_id for r in got}[2] == 1 and {r.component_id for r in got if r.doc_id is None} == {None}
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, None, 6, 7, 8, 9]))
    assert near_dedup.groups(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    y = np.concatenate((x[:200], rng.integers(-(2**63), 2**63 - 1, 100)))
    both = near_dedup.signatures(np.concatenate((x, y)), np.array([0, 300, 600]), 1024)
    assert abs((both[0] == both[1]).mean() - 200 / 400) < 0.06


# 4: fingerprints


def plain_fingerprint(text):
    """Sums of integers, lane by lane, and their digits."""
    wide, bins = [0] * fingerprint.WIDE, [0] * (fingerprint.LEVELS * fingerprint.BINS)
    for line in text.split("\n"):
        p = line.strip()
        if not p:
            continue
        raw = hashlib.shake_256(p.encode()).digest(4 * fingerprint.WIDE)
        wide = [w + int.from_bytes(raw[4 * i : 4 * i + 4], "little") for i, w in enumerate(wide)]
        for sentence in re.split(r"(?<=[.!?])\s+", p):
            words = [w[i : i + 64] for w in sentence.split() for i in range(0, len(w), 64)]
            if all(len(w) <= 64 for w in sentence.split()):
                pieces_ = [re.search(r"\s+".join(map(re.escape, words[i : i + 8])), sentence).group() for i in range(0, len(words), 8)]
            else:
                pieces_ = fingerprint.runs(sentence)
            for piece in pieces_:
                at, value = (int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest()[i : i + 4], "little") for i in (0, 4))
                rest, level = at // 64, 0
                while True:
                    bins[level * 64 + at % 64] += value
                    if level + 1 == fingerprint.LEVELS or rest >> level & 1:
                        break
                    level += 1
    return b"".join([(w % 2**32).to_bytes(4, "little") for w in wide] + [bytes([b % 256]) for b in bins]).hex()


def test_one_paragraph_is_like_its_edit():
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(rng.randint(150, 600))) for _ in range(60)]
    own = fingerprint.sums([[t] for t in texts])
    new = fingerprint.sums([[fingerprint.edited(t, o)] for t, o in zip(texts, texts[1:] + texts[:1])])
    got = fingerprint.likeness(own, new)
    assert abs(got.mean() - 0.6) < 0.06 and got.min() > 0.25, (got.mean(), got.min())
    assert fingerprint.likeness(own[:-1], own[1:]).max() < 0.1


def test_fingerprints(spark):
    docs = documents(spark)
    rows = sorted(((d, t or "") for d, t, _ in AWKWARD), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    got = {}
    for r in fingerprint.fingerprints(docs, range_bytes=2000).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        e = fingerprint.edited(t, following)
        own, new, after = (fingerprint.sums([fingerprint.paragraphs(x)]) for x in (t, e, following))
        want = (d, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_fingerprint(t), plain_fingerprint(e), fingerprint.likeness(own, new)[0], fingerprint.likeness(own, after)[0])
        assert want in [tuple(r) for r in got[d]]
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_are_homomorphic():
    texts = ["alpha", "beta", "gamma", "beta"]
    whole = fingerprint.sums([texts])[0]
    assert (whole == fingerprint.sums([texts[::-1]])[0]).all()
    assert (fingerprint.delete(fingerprint.insert(whole, "new"), "new") == whole).all()
    assert (fingerprint.delete(whole, "beta") == fingerprint.sums([["alpha", "beta", "gamma"]])[0]).all()
    assert (fingerprint.sums([["alpha"]]) != fingerprint.sums([["beta"]])).any() and not fingerprint.sums([[]]).any()


# 5: pieces


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces._vocabulary(f.read())


TEXTS = ["", "a", " ", "  a  b", "日本語 你好", "x▁y ▁", "😀\n\n\tz", "ab" * 600 + " the " + "q" * 300, *(t or "" for _, t, _ in AWKWARD)]


def test_pieces_equal_the_library_without_dropout(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [t for t in TEXTS if "▁" not in t]
    assert [p.tolist() for p in pieces.encode(vocabulary, plain, [0] * len(plain), 0.0)] == library.encode(plain)


def test_dropout_is_lossless_seeded_and_varied(vocabulary, monkeypatch):
    keys = [pieces.document_key(i, 1) for i in range(len(TEXTS))]
    a = pieces.encode(vocabulary, TEXTS, keys, 0.3)
    assert [pieces.decode(vocabulary, p) for p in a] == TEXTS
    assert all((x == y).all() for x, y in zip(a, pieces.encode(vocabulary, TEXTS, keys, 0.3)))
    other = pieces.encode(vocabulary, TEXTS, [pieces.document_key(i, 2) for i in range(len(TEXTS))], 0.3)
    assert any(x.tolist() != y.tolist() for x, y in zip(a, other))
    characters = pieces.encode(vocabulary, ["the word"], [5], 1.0)[0]
    assert len(characters) == len(" the word")
    monkeypatch.setattr(pieces, "LONG", 2)  # all chunks by the heap
    monkeypatch.setattr(pieces, "WINDOW", 64)
    assert all(x.tolist() == y.tolist() for x, y in zip(a, pieces.encode(vocabulary, TEXTS, keys, 0.3)))


def plain_agenda(library, text, key, limit):
    """Of all candidates that escape the dropout the best score, the leftmost at ties, merges; until there is none."""
    mask = 2**64 - 1

    def kept(a, m, e):
        h = key ^ ((a * int(pieces._M1) + m * int(pieces._M2) + e * int(pieces._M3)) & mask)
        h = (h ^ h >> 31) * int(pieces._M4) & mask
        h = (h ^ h >> 29) * int(pieces._M1) & mask
        return (h ^ h >> 32) >= limit

    marked = ("▁" + text.replace(" ", "▁")) if text else ""
    known = lambda s: not library.is_unknown(library.piece_to_id(s))
    parts = [(i, i + 1) for i in range(len(marked))]
    while True:
        best = None
        for (a, m), (_, e) in zip(parts, parts[1:]):
            whole = marked[a:e]
            # A space mark stands at a piece's start only, and pieces are made of known characters.
            if "▁" in whole.lstrip("▁") or not all(known(c) for c in whole) or not known(whole) or not kept(a, m, e):
                continue
            rank = (-library.get_score(library.piece_to_id(whole)), a)
            if best is None or rank < best[0]:
                best = (rank, a, m, e)
        if best is None:
            break
        _, a, m, e = best
        at = parts.index((a, m))
        parts[at : at + 2] = [(a, e)]
    out = []
    for a, e in parts:
        s = marked[a:e]
        out += [library.piece_to_id(s)] if known(s) else [library.piece_to_id(f"<0x{b:02X}>") for b in s.encode()]
    return out


def test_dropout_matches_a_plain_agenda(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["the words of a merge dropout agenda", "  two  spaces and tab\there", "日本 naïve café", "", "aaaaaaaaab bananas bananas", "Unbelievable, internationalisation!"]
    for rate in (0.1, 0.4):
        keys = [pieces.document_key(i, 3) for i in range(len(texts))]
        limit = min(int(rate * 2.0**64), 2**64 - 1)
        got = [p.tolist() for p in pieces.encode(vocabulary, texts, keys, rate)]
        assert got == [plain_agenda(library, t, k, limit) for t, k in zip(texts, keys)]


def test_pairs_of_large_vocabularies():
    """Beyond 65,536 pieces a pair's key takes more than 32 bits."""
    v = object.__new__(pieces.Vocabulary)
    v.size = 200_000
    rng = np.random.default_rng(9)
    left, right = rng.integers(0, v.size, 3000), rng.integers(0, v.size, 3000)
    pairs = {int(a) * v.size + int(b): i for i, (a, b) in enumerate(zip(left, right))}
    v._build(pairs)
    assert v.ranks(left.astype(np.int32), right.astype(np.int32)).tolist() == [pairs[int(a) * v.size + int(b)] for a, b in zip(left, right)]
    assert (v.ranks(right.astype(np.int32), left.astype(np.int32)) == pieces.NONE).mean() > 0.99


def test_encoded_documents(spark):
    rows = pieces.encode_documents(documents(spark)).collect()
    assert len(rows) == len(AWKWARD) and all(r.lossless and r.n_tokens == len(r.tokens) for r in rows)


# 6: WARC


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, "small"), (4, "http://c/", "small"), (5, "u", None), (9, "http://d/\r\nX: y", big), (None, "n", big), (9, "again", big), (7, "v", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    outs = []
    for name in ("one", "two"):
        uri = f"file://{tmp_path}/{name}"
        warc.write(pages.repartition(2), uri, roll_bytes=500, shard_bytes=1500)
        outs.append({p.name: p.read_bytes() for p in (tmp_path / name).iterdir() if p.is_file() and p.suffix == ".gz"})
        assert not [p for p in (tmp_path / name).iterdir() if p.name.startswith(".tmp")]
        listed = {r.file: r for r in warc.manifest(spark, uri).collect()}
        assert set(listed) == set(outs[-1]) and all(hashlib.sha1(b).hexdigest() == listed[n].sha1 and len(b) == listed[n].bytes for n, b in outs[-1].items())
    assert outs[0] == outs[1] and len(outs[0]) > 2
    records = [m for b in outs[0].values() for m in gzip.decompress(b).split(b"WARC/1.1\r\n")[1:]]
    ids = [re.search(rb"WARC-Record-ID: (.*)\r", r)[1] for r in records]
    assert len(ids) == len(set(ids)) == len(rows) + len(outs[0]) and sum(b"WARC-Type: warcinfo" in r for r in records) == len(outs[0])
    assert any(n.split("-")[2] != "00000.warc.gz" for n in outs[0])  # a shard rolled
    got = sorted(map(tuple, warc.read_back(spark, uri).collect()), key=str)
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        again = html == big and page_id != 9
        want.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=str)
    empty = f"file://{tmp_path}/empty"
    warc.write(pages.limit(0), empty)
    assert warc.read_back(spark, empty).count() == 0


# 7: mixing


def test_pfair_deviation():
    units, have = {"a": 5, "b": 3, "c": 1, "d": 1}, {"a": 500, "b": 300, "c": 100, "d": 100}
    order = mixing.period(units, slots=1000)
    total, seen = sum(units.values()), dict.fromkeys(units, 0)
    for slot, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - slot * units[x] / total) < 1 for x in units)
    assert seen == have
    pieces_ = mixing.phases(units, {"a": 7, "b": 300, "c": 2})
    slots = sorted(mixing._slot_of(pieces_, s, b) for s, n in {"a": 7, "b": 300, "c": 2}.items() for b in range(n))
    assert slots == list(range(309))


def test_mix_keeps_every_row(spark):
    rows = [*AWKWARD, *[(100 + i, f"t{i}", ("big", "s0", "s1", "zz")[min(i % 7, 3)]) for i in range(600)], (None, None, None), (None, None, None)]
    docs = documents(spark, rows)
    got = mixing.schedule(docs, {"s0": 2, "s1": 1, "big": 0.5}, other=1, block_docs=8)
    positions = sorted(r.position for r in got.collect())
    assert positions == list(range(len(rows)))
    mixed = mixing.mix(docs, {"s0": 2, "s1": 1, "big": 0.5}, other=1, block_docs=8)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    order = [r.source for r in mixed.collect()]
    weights = {"s0": 2, "s1": 1, "big": 0.5, "*": 1}
    counts, total = {}, sum(weights.values())
    for i, s in enumerate(order[:8 * 10], 1):
        s = s if s in weights else "*"
        counts[s] = counts.get(s, 0) + 1
        if i % 8 == 0:  # whole blocks only, while every source has some left
            if all(counts.get(x, 0) <= i * w / total + 8 for x, w in weights.items()):
                continue
            raise AssertionError((i, counts))
    assert mixing.schedule(docs.limit(0), {"a": 1}).count() == 0
    assert mixing.mix(docs.limit(0), {"a": 1}).count() == 0


def test_weights_are_exact():
    assert mixing.whole_units({"a": 1e-7, "b": 1}) == {"a": 1, "b": 10**7}
    assert mixing.whole_units({"a": 0.1, "b": 0.2, "c": 0.7}) == {"a": 1, "b": 2, "c": 7}
    few = mixing.phases({"a": 1, "b": 10**7}, {"a": 3, "b": 500})  # fewer blocks than a period has slots
    assert sorted(mixing._slot_of(few, s, j) for s, n in (("a", 3), ("b", 500)) for j in range(n)) == list(range(503))
    with pytest.raises(ValueError):
        mixing.phases({"a": 1, "b": 10**7}, {"a": 3, "b": 10**9})


def test_shards_of_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "doc_id long, text string").withColumns({n: F.lit(9) for n in ("_key", "_spot", "_row", "slot")})
    got = sharding.shard(docs, "doc_id", 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)] and sorted(r.text for r in got) == list("abcde") and {r["_key"] for r in got} == {9}


# 8: sharding


def test_permutation_is_a_bijection_and_inverts():
    for n in (1, 2, 3, 5, 17, 100, 1000):
        there = [sharding.permute(x, n, 42) for x in range(n)]
        assert sorted(there) == list(range(n)) and [sharding.invert(y, n, 42) for y in there] == list(range(n))


def test_shards(spark):
    rows = sharding.assign(documents(spark), 4).collect()
    n = len(AWKWARD)
    order = sorted(((-1 if d is None else d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in AWKWARD))
    want = sorted((*row, sharding.permute(i, n, 42) % 4, sharding.permute(i, n, 42) // 4) for i, row in enumerate(order))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows) == want
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(4))
    assert sharding.assign(documents(spark).limit(0)).count() == 0


# 9: licenses


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Prose here.\nReleased under the MIT License.\nMore.", [("MIT", "exact")]),
        ("Licensed under CC BY-NC 4.0.", [("CC-BY-NC-4.0", "exact")]),
        ("Licensed under CC BY 4.0.", [("CC-BY-4.0", "exact")]),
        ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", [("Apache-2.0", "exact")]),
        ("This work is licensed under the GNU General Public License, version 3.", [("GPL-3.0", "exact")]),
        ("This work is licensed under the GNU General Public License, version 9.", []),
        ("This fine work is licensed under the GNU General Public License, version 3.", [("GPL-3.0", "variant")]),
        ("He had a driving license and no copyright at all.", []),
        ("", []),
    ],
)
def test_licenses(text, want):
    assert [(f["license"], f["verdict"]) for f in licenses.scan(text)] == want


def test_license_scan(spark):
    rows = [*AWKWARD, (20, "a\n" * 3000 + "Released under the MIT License.\n" + "b " * 3000, "s")]
    got = {r.doc_id: r for r in licenses.scan_documents(documents(spark, rows)).collect()}
    assert got[20].licenses == "MIT" and sum(r.n_findings for r in got.values()) == 1


# 10: private data


def plain_base(t):
    out = []
    for kind, p in private_data.PLAIN.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_private_data(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "x.y@z-1.co.uk", "a@b.c._d@e.f", "@", "1.2.3.4", "999.2.3.4.5.6.7.8", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "12 34", "+1 (555) 010-9999", "+49.30.1234567 ", "+1", ".", "-", " ", "é", "7", "0", "\n", "😀"]
    rows = [*AWKWARD, *[(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))), "r") for i in range(400)], (99, "9" * 4000, "r"), (98, "a" * 50_000 + "@b", "r")]
    got = private_data.find(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    text_of = {d: t or "" for d, t, _ in rows}
    for r in got:
        base = plain_base(text_of[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text_of[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_model_on_held_out_rows(spark):
    model, thresholds = private_data.model_for(spark)
    rows = private_data._synthetic(600, 99)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, s int, e int")
    found = {r.doc_id: r.spans for r in private_data.find(df).collect()}
    hits = misses = false = 0
    for i, (text, s, e) in enumerate(rows):
        spans = [tuple(map(int, x.split(":")[1:])) for x in found[i].split(",") if x]
        hit = any(a <= s and e <= b for a, b in spans)
        hits, misses, false = hits + (s >= 0 and hit), misses + (s >= 0 and not hit), false + (s < 0 and bool(spans))
    assert hits / (hits + misses) > 0.9 and false / max(1, hits + false) < 0.06


def test_redaction(spark):
    docs = spark.createDataFrame([(1, 'mail me@x.org or token = "0123456789abcdef0123456789abcdef01234567" now', 10), (2, None, 0), (3, "clean 12 text", 13)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in private_data.redact(docs).collect()}
    assert got[1].text == 'mail <EMAIL> or token = "<SECRET>" now' and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean 12 text"
