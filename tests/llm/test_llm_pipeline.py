"""The pipeline's stages against brute force, each on what the one before kept, and on awkward and empty tables."""

import random

import pytest
from test_llm_cases import LONG, removed_words

import corpus_pipeline
from pixelstrata.llm.tables import scratch, staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, k=5):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: clean texts, near copies, passages that several texts share, benchmark items, insults."""
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    base = [[word() for _ in range(rng.randrange(30, 160))] for _ in range(40)]
    passages, items = ([[word() for _ in range(n)] for _ in range(4)] for n in (70, 25))
    rows = []
    for i in range(160):
        kind, words = rng.choice(["clean", "near", "passage", "leak", "toxic"]), list(rng.choice(base))
        if kind == "clean":
            words = [word() for _ in range(rng.randrange(1, 120))]
        if kind == "near":
            words[rng.randrange(len(words))] = "changed"
        if kind == "passage":
            at = rng.randrange(len(words))
            words = words[:at] + rng.choice(passages) + words[at:]
        if kind == "leak":
            words = [word() for _ in range(60)] + rng.choice(items) + [word() for _ in range(20)]
        if kind == "toxic":
            words = [word() for _ in range(30)] + ["idiot", "idiot", "scum"]
        rows.append((rng.randrange(10_000) if rng.random() < 0.95 else None, " ".join(words), "en", rng.choice(["a", "b", None]), 0, kind))
    ids = [r[0] for r in rows]
    rows += [
        (next(i for i in ids if i is not None), "another text of this id", "en", "a", 0, "clean"), (7, None, None, None, None, "clean"),
        (8, "", "en", "c", 0, "clean")
    ]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([r[:5] for r in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(
        [(r[0], 1, int(r[5] == "toxic"), "x") for r in rows], "doc_id long, quality int, toxic int, text string"
    ).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(
        [(i, " ".join(w), "y") for i, w in enumerate(items)], "item_id int, text string, source string"
    ).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def stages(spark, sf_dir):
    """(name, rows before, rows after) of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, sf_dir))
        yield name, docs.collect(), after.collect()
        docs = after


def test_stages_equal_brute_force(spark, corpus):
    made = {name: (before, after) for name, before, after in stages(spark, corpus)}
    before, after = made["quality classifier"]
    assert not any("idiot" in (r.text or "") for r in after) and len(after) > 0.7 * len(before)

    before, after = made["minhash near-dedup"]
    shingles = [sets(r.text) for r in before]
    group = list(range(len(before)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if before[i].text == before[j].text and before[i].doc_id == before[j].doc_id is not None or shingles[i] and shingles[j] and 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j]):
                group[root(i)] = root(j)
    members = {}
    for i, r in enumerate(before):
        members.setdefault(root(i), []).append(r)
    assert len(after) == len(members)
    kept = sorted(map(str, after))
    for rows in members.values():
        own = [r for r in rows if str(r) in kept]
        assert own
        named = [r.doc_id for r in rows if r.doc_id is not None]
        assert len({str(r) for r in own}) == 1 and (own[0].doc_id == min(named) if len(named) == len(set(named)) and named else True)

    before, after = made["substring dedup"]
    named = [r for r in before if r.doc_id is not None]
    assert len({r.doc_id for r in named}) > 20
    single = {r.doc_id for r in named if sum(x.doc_id == r.doc_id for x in named) == 1}
    numbered = [(r.doc_id if r.doc_id in single else 1 << 40, r.text) for r in before]
    want = {i: (n, kept) for i, _, n, kept in removed_words(numbered, 50) if i in single}
    got = {r.doc_id: r for r in after}
    texts = dict(numbered)
    assert len(after) == len(before) and sum(n for n, _ in want.values()) > 0
    for i, (n, kept_text) in want.items():
        assert got[i].text == (kept_text if n else texts[i]) and (not n or got[i].n_chars == len(kept_text))

    before, after = made["benchmark decontamination"]
    items = [sets(r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    clean = [r for r in before if not any(100 * len(sets(r.text) & s) >= 75 * len(s) for s in items)]
    assert sorted(map(str, after)) == sorted(map(str, clean)) and len(clean) < len(before)

    before, after = made["mixing to target weights"]
    size = lambda r: len((r.text or "").split())
    total = sum(map(size, before))
    taken, held = {}, {}
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + size(r)
    for r in before:
        held[r.source] = held.get(r.source, 0) + size(r)
    assert abs(sum(taken.values()) - 1.5 * total) < 4 * 230 and all(taken[s] <= 2 * held[s] + 230 for s in taken)
    copies = {}
    for r in after:
        copies.setdefault((r.doc_id, r.text, r.source), []).append(r.copy)
    assert all(c in ([1], [1, 2]) or len(c) > 2 for c in map(sorted, copies.values()))


def test_run_repeats_and_leaves_little(spark, corpus):
    import os

    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: {d for d in os.listdir(at) if d.startswith("staged-")}
    before = held()
    with scratch(spark):
        rows = sorted(map(str, corpus_pipeline.run(spark, corpus).drop("text").collect()))
        assert len(held() - before) <= 5
    assert held() == before
    with scratch(spark):
        assert sorted(map(str, corpus_pipeline.run(spark, corpus).drop("text").collect())) == rows and rows


def test_awkward_and_empty_tables(spark, corpus, tmp_path):
    odd = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7),
        (4, "other", "en", None, 5), (None, "one two", "en", "b", 7), (None, None, None, None, None), (6, LONG, "en", "b", 1),
        (9, LONG + " end", "en", "c", 1)
    ]
    for name, rows in (("odd", odd), ("none", [])):
        at = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, SCHEMA).selectExpr(
            "*", "1 as n", "2 as row", "3 as doc", "4 as entries", "5 as copy", "6 as mark", "7 as class", "8 as family"
        )
        docs.write.parquet(f"{at}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{corpus}/{table}.parquet").filter("false").write.parquet(f"{at}/{table}.parquet")
        counts = {step: len(after) for step, _, after in stages(spark, at)}
        assert list(counts.values())[:4] == ([9, 6, 6, 6] if rows else [0] * 4)
        assert corpus_pipeline.run(spark, at).columns == [c for c in docs.columns if c != "copy"] + ["copy"]
