import random

from pyspark.sql import functions as F

from sluiceway.llm.components import components
from sluiceway.llm.jaccard_join import similar_components
from tests.llm.helpers import DOCS, ODD, documents, edited, prose, shingle_set


def brute(texts):
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_copies_chains_and_shared_passages(spark):
    base = prose(1, 200)
    texts = [*ODD, base, *(edited(base, s, every) for s in range(12) for every in (40, 60, 90, 150))]
    chain = prose(2, 120).split(" ")
    texts += [" ".join(chain[k : k + 80]) for k in range(0, 40, 4)]  # neighbours link, ends do not
    passage = prose(3, 60)
    texts += [prose(s, 90) + " " + passage + " " + prose(-s, 70) for s in range(10, 40)]
    texts += [" ".join(prose(77, 30).split(" ")[: 20 + k]) for k in range(10)]
    random.Random(1).shuffle(texts)
    docs = documents(spark, texts).withColumns({"id": F.lit(1), "digest": F.lit("x"), "component": F.lit(2)})
    assert found(similar_components(docs.repartition(5))) == brute(texts)


def test_large_group_of_near_copies(spark):
    base = prose(9, 60)
    texts = [edited(base, s, 61) for s in range(700)] + [base] * 100
    assert found(similar_components(documents(spark, texts).repartition(6))) == brute(texts)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (None, None)]
    out = similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(
        map(str, [(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 0, 7), (None, 0, None)])
    )
    assert similar_components(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, k) for k in range(400, 460)] + [(900, 901), (901, 900), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {k: 400 for k in [*range(400, 460), 500]} | {900: 900, 901: 900}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
