"""The registered queries against their SQL, and against brute force where SQL cannot state them."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same_rows

from pixelstrata.llm import queries as corpus

QUERIES, SQL = corpus.queries(), corpus.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, name):
    same_rows(spark, QUERIES[name], SQL[name])


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = documents(spark)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    assert got == {i: (*x, x[1] > 512) for i, x in want.items()}


def test_license_scan(spark):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r.doc_id: r for r in QUERIES["op4_license_scans"](spark, SF).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hits = 0
    for i, text in documents(spark).items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        places = [(at, label) for p, label in phrases.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        hits += len(places)
        at, labels = [a for a, _ in places], sorted({x for _, x in places})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(places), min(at, default=None), max(at, default=None), ",".join(labels)
        )
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert len(got) == len(documents(spark))


def test_suffix_dedup(spark):
    texts = {i: t.encode() for i, t in documents(spark).items()}
    count = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_array_dedup"](spark, SF).collect()}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                gone[j : j + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        assert got[i] == (len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest())


def test_nearest_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in QUERIES["op10_approximate_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q] / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        score[q] = -2
        best = np.lexsort((ids, -score))[:5]
        found = got[ids[q]]
        assert sorted(found) == [1, 2, 3, 4, 5]
        hits += len({v for v, _ in found.values()} & set(ids[best].tolist()))
        total += 5
        assert all(abs(s - score[ids == v][0]) < 1e-12 for v, s in found.values())
    assert hits / total >= 0.9


def test_quality_separates_held_out_labels(spark):
    from pyspark.sql import functions as F

    from pixelstrata.llm.quality import graded, trained

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = trained(docs.filter("doc_id % 4 <> 0"), labels)
    held = graded(docs.filter("doc_id % 4 = 0"), model).join(labels, "doc_id")
    kept = {r.good: r.k for r in held.groupBy((F.col("quality") == 1).alias("good")).agg(F.avg(F.col("p_top")).alias("k")).collect()}
    assert kept[True] - kept[False] > 0.3
    assert (np.diff(model.thresholds) > 0).all()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        from pixelstrata.llm.tables import staged

        after = staged(stage(spark, docs, SF))
        last = i + 1 == len(corpus_pipeline.STAGES)
        assert after.columns == docs.columns + ["copy"] * last, name
        assert 0 < after.count() <= docs.count() * (2 if last else 1)
        assert last or after.count() == after.select("doc_id").distinct().count()
        docs = after
