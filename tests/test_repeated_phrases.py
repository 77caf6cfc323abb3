"""Repeated phrases against a plain count, and the one shuffle they need."""

import re
from collections import Counter, defaultdict

from strandline.plans import catalog

TEXTS = [(1, "a b c a b c a b"), (1, "a b c, d"), (2, "x a b C a b c"), (3, "c a b"), (4, "no no no no no"), (5, "no no no"), (6, None), (7, ""), (8, "one two"), (None, "b c a"), (None, "b c a no no no"), (9, "A1B2\nd e f"), (10, "d  e\tf")]


def test_repeated_phrases_count_texts_and_documents(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, many = defaultdict(set), Counter()
    for doc, text in TEXTS:
        w = re.findall("[a-z]+", text or "")
        for i in range(len(w) - 2):
            phrase = " ".join(w[i : i + 3])
            many[phrase] += 1
            docs[phrase] |= {doc} - {None}
    found = catalog.repeated_phrases(spark, str(tmp_path))
    got = {r.phrase: (r.n_docs, r.n) for r in found.collect()}
    assert got == {p: (len(docs[p]), many[p]) for p in many if len(docs[p]) > 1}
    plan = catalog.repeated_phrases(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
