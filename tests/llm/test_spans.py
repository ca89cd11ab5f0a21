"""Added spans of private data: a plain model of candidates, features and choice, and forms the sample does not make."""

import random

import numpy as np
import pytest
import regex

from weftgraph.llm import private_data as P

from .helpers import AWKWARD


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def plain_candidates(t):
    found = []
    for kind, pattern in P.GENERATORS:
        if pattern in P.GATES and not regex.search(P.GATES[pattern], t, regex.ASCII):
            continue
        ms = [m.span() for m in regex.finditer(pattern, t, regex.ASCII)]
        for i, (a, b) in enumerate(ms):
            left, right = t[ms[i - 1][1] if i else 0 : a], t[b : ms[i + 1][0] if i + 1 < len(ms) else len(t)]
            one = (P.KINDS.index(kind), a, b, t[a:b], left[-P.CONTEXT :], right[: P.CONTEXT])
            if one not in found:
                found.append(one)
    return found


def plain_features(c):
    kind, _, _, v, left, right = c
    d = regex.sub("[^0-9]", "", v)
    near = lambda p: float(bool(regex.search(f"(?i){p}", left, regex.ASCII)))
    return [
        float(kind), float(len(v)), len(d) / len(v), float(luhn(d)) if d else 0.0,
        sum(x in "0123456789abcdef" for x in v.lower()) / len(v), sum("A" <= x <= "Z" for x in v) / len(v),
        sum(x in " .-()[]" for x in v) / len(v), len(set(v)) / len(v),
        len(regex.findall("[a-z](?=[A-Z0-9])", v)) / len(v),
        near(r"(token|secret|passw|pwd|api.?key|auth|bearer|credential)"), near(r"[:=]\s*[\"']?$"),
        near(r"(phone|tel\b|call|mobile|fax|contact)"), near(r"(card|visa|account|iban|ssn|social|pay)"),
        near(r"(order|version|isbn|commit|sha|id|no\.?|part|build|page)\W*$"),
        float(bool(regex.search(r"[0-9A-Za-z]$", left))) + float(bool(regex.search(r"^[0-9A-Za-z]", right))),
    ]


def plain_spans(t, model, thresholds):
    from .test_operators import plain_base

    base = [(P.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in plain_base(t))]
    made = plain_candidates(t)
    p = model.probability(np.array([plain_features(c) for c in made])) if made else []
    likely = [(c[0], c[1], c[2], q) for c, q in zip(made, p) if q >= thresholds[c[0]]]

    def part(a, b):
        return a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2] and a[2] - a[1] < b[2] - b[1]

    def beats(o, s):
        rank = lambda x: (x[3], x[2] - x[1], -x[1], -x[0])
        return o[1] < s[2] and s[1] < o[2] and (part(s, o) or not part(o, s) and rank(o) > rank(s))

    added = {s[:3] for s in likely if not any(b[1] < s[2] and s[1] < b[2] for b in base) and not any(beats(o, s) for o in likely)}
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in sorted([*base, *added]))


def test_spans_match_a_plain_model(spark):
    model, thresholds = P.model_for(spark)
    rng = random.Random(21)
    texts = [t for t, _, _ in P._synthetic(250, 22)]
    bits = ["token = ", "password: ", '"secret": "', "key=", "A9f" * 7, "0123456789abcdef0123", "4111111111111111", "1234567890123", "555-010-1234", "call ", "a [at] b [dot] com", "x(at)y.org", "123-45-6789", "DE44 5001 0517 5407 3249 31", " ", ", ", '"', "=", "hunter2!Q", "+49 30 123456", "me@x.org", "é", "\n"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(2, 12))) for _ in range(250)]
    texts += [" ".join(rng.sample(texts, 6)) for _ in range(60)] + [t or "" for _, t, _ in AWKWARD]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_spans) for r in P.find(rows).collect()}
    added = 0
    for i, t in enumerate(texts):
        want = plain_spans(t, model, thresholds)
        assert got[i] == (want, want.count(":") // 2), t[:300]
        added += sum(not x.startswith(("ip", "phone")) for x in want.split(",") if x)
    assert added > 200


#: (text with the personal part between two bars, whether it is personal): forms that the sample does not make.
HELD = [
    ("curl -H 'X-Api-Key: |9f8e7d6c5b4a39281706f5e4d3c2b1a0|' https://host/v1", True),
    ("login with password=|Tr0ub4dor&3x| tonight", True),
    ("{'client_secret': '|Zk3LmQ8vTt0pWq7RrYx2Bn5C|', 'port': 80}", True),
    ("jdbc:mysql://db/app?user=root&password=|s3cr3tPassw0rd9|&ssl=1", True),
    ("config.auth_token = |ghx4f9aa0277c1e8bb63d5f0917ac2| ;", True),
    ("my phone is |(555) 010-4477|, thanks", True),
    ("you can call |555-010-8899| any time", True),
    ("charge it to visa |4556737586899855| please", True),
    ("reach j.doe at |j.doe (at) example (dot) org| soon", True),
    ("his social security number is |536-22-8714| he said", True),
    ("send money to IBAN |FR14 2004 1010 0505 0001 3026 06| now", True),
    ("the wire goes to account |GB29NWBK60161331926819| today", True),
    ("see commit |e83c5163316f89bfbde7d9ab23ca2e25604af290| for more", False),
    ("the key: |importance-of-words| in this text", False),
    ("password = |os.environ| is read later", False),
    ("token: |identifier_node| in the parser", False),
    ("ticket no. |1234567890128| was closed", False),
    ("model part |555-010-2233| fits", False),
    ("order |123-45-6780| was shipped", False),
    ("a rule of |-----------------------------------1| ends it", False),
    ("page id |550e8400-e29b-41d4-a716-446655440000| not found", False),
    ("read chapter |the-end-of-all-things-part-12| again", False),
]


@pytest.fixture(scope="module")
def held(spark):
    rows = [(i, t.replace("|", "")) for i, (t, _) in enumerate(HELD)]
    return {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_forms_that_the_sample_does_not_make(held):
    wrong = []
    for i, (t, personal) in enumerate(HELD):
        a = t.index("|")
        b = t.index("|", a + 1) - 1
        caught = any(x < b and a < y for x, y in held[i])
        if caught != personal:
            wrong.append(t)
    assert len(wrong) <= 2, wrong


def test_thresholds_come_from_data(spark):
    _, thresholds = P.model_for(spark)
    used = [thresholds[P.KINDS.index(k)] for k in ("secret", "card", "phone", "email", "ssn", "iban")]
    assert len(set(used)) >= 4 and all(0 < t < 1 for t in used), used


def test_written_out_addresses_of_any_length(spark):
    texts = ["a [at] b [dot] com", "x" * 70 + " (at) " + "y" * 70 + " (dot) org", "k(at)mail.example.org and so on"]
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[0], got[1], got[2]] == [f"email:0:{len(texts[0])}", f"email:0:{len(texts[1])}", f"email:0:{len('k(at)mail.example.org')}"]
