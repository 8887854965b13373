"""Many patterns in many texts against brute force; ground truth without a join of all pairs."""

import random


from tessera.operators import evaluate, patterns


def test_patterns_by_brute_force(spark, monkeypatch):
    r = random.Random(6)
    make = lambda n: "".join(r.choice("abé\n🎉") for _ in range(n))
    texts = [make(r.randint(0, 40)) for _ in range(80)] + [None, "", "aaaa" * 5000]
    wanted = {make(r.randint(1, 4)) for _ in range(60)} | {"", "aaaa", "aa", "b" * 50}
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "id long, pattern_ int, text string")
    asked = spark.createDataFrame([(p,) for p in [*sorted(wanted), None, "aa"]], "pattern string")
    want = sorted((i, p) for i, t in enumerate(texts) if t is not None for p in wanted if p in t)
    assert sorted(map(tuple, patterns.contained(rows, ["id"], "text", asked).collect())) == want
    monkeypatch.setattr(patterns, "BLOCK_BYTES", 50)
    assert sorted(map(tuple, patterns.contained(rows, ["id"], "text", asked).collect())) == want
    assert patterns.contained(rows, ["id"], "text", asked.limit(0)).count() == 0 == patterns.contained(rows.limit(0), ["id"], "text", asked).count()


def test_ground_truth_by_brute_force(spark):
    r = random.Random(7)
    word = lambda: r.choice(["Raft", "os", "PAGING", "log", "x.md", "é"])
    chunks = [(f"c{i}", " ".join(word() for _ in range(r.randint(0, 4))), r.choice([None, "/d/" + word() + ".md"]), r.choice([None, word()])) for i in range(60)]
    samples = [(q, [f"c{q}"] if q % 3 == 0 else [], [word() for _ in range(r.randint(0, 2))] + ([""] if q == 5 else []), r.choice([None, [], [word()], [word(), "none"], [""]])) for q in range(25)]
    table = spark.createDataFrame(chunks, "chunk_id string, content string, source string, filename string")
    asked = spark.createDataFrame(samples, "query_id long, relevant_chunk_ids array<string>, relevant_doc_names array<string>, relevant_keywords array<string>")
    want = set()
    for q, ids, names, keywords in samples:
        want |= {(q, i) for i in ids}
        for c, content, source, filename in chunks:
            if any(n.lower() in (source or "").lower() or n.lower() in (filename or "").lower() for n in names) and (not keywords or any(k.lower() in content.lower() for k in keywords)):
                want.add((q, c))
    truth = evaluate.ground_truth(asked, table)
    assert {tuple(x) for x in truth.collect()} == want
    assert "NestedLoop" not in truth._jdf.queryExecution().toString() and "Cartesian" not in truth._jdf.queryExecution().toString()
    short = spark.createDataFrame([(0, "os"), (1, "log é"), (2, "never")], "query_id long, text string")
    got = evaluate.containing(short, table)
    assert {tuple(x) for x in got.collect()} == {(q, c[0]) for q, t in enumerate(["os", "log é", "never"]) for c in chunks if t in c[1]}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
