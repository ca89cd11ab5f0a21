import random

from weftgraph.llm import private_data


def test_secrets_in_assignments_of_any_length(spark):
    rng = random.Random(13)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    base64 = letters + "0123456789+/"
    values = ["".join(rng.choice(base64) for _ in range(n)) + "a7Q" for n in (197, 200, 300, 5000)]
    values += ["".join(rng.choice(letters) for _ in range(n)) + "Qx" for n in (14, 30)] + ["hUnter2!xQ", "k3Y-9Tz_w"]
    rows = [(i, f'before {name} = "{v}" after this', v) for i, (name, v) in enumerate((n, v) for n in ("token", "password") for v in values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v string")
    found = {r.doc_id: r.spans for r in private_data.find(docs).collect()}
    assert [found[i] for i, _, _ in rows] == [f"secret:{t.index(v)}:{t.index(v) + len(v)}" for _, t, v in rows]
    clean = [(i, t) for i, t in enumerate(["The password: required for all.", "secret = getting_there", "token: another word", "key: important"])]
    assert not any(r.spans for r in private_data.find(spark.createDataFrame(clean, "doc_id long, text string")).collect())
    redacted = private_data.redact(docs.select("doc_id", "text")).collect()
    assert all(r.text.endswith('= "<SECRET>" after this') for r in redacted)
