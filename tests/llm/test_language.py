import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sluiceway.llm.language import GRAMS, LANGUAGES, TEMPER, document_items, fit, identify, page_items, trigrams
from tests.llm.helpers import DOCS, ODD, documents

SPOKEN = {
    "de": "der hund und die katze schlafen nicht weil sie zusammen spielen wollen ",
    "en": "the dog and the cat do not sleep because they would like to play together ",
    "es": "el perro y el gato no duermen porque quieren jugar juntos todos los dias ",
    "fr": "le chien et le chat ne dorment pas parce qu'ils veulent jouer ensemble toujours ",
}


def labelled(spark):
    rows = [(k, text * 4, lang) for k, (lang, text) in enumerate(SPOKEN.items())] + [(9, None, "en"), (10, "xyz", "tlh")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain(items, table):
    """The same posterior in plain Python: (language, confidence, by text alone, kept)."""
    size, weight = len(LANGUAGES), 10.0
    logs = [table[trigrams(t)].sum(axis=0) / TEMPER if len(trigrams(t)) else np.zeros(size) for t, *_ in items]
    alone = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs]
    totals = sum(alone, np.zeros(size)) + 1
    prior = totals / totals.sum()

    def sums(values):
        out = defaultdict(lambda: [0, np.zeros(size)])
        for v, p in zip(values, alone):
            if v:
                out[v][0] += 1
                out[v][1] = out[v][1] + p
        return out

    domain = [".".join(h.split(".")[-2:]) if h else None for *_, h in items]
    kinds = {k: sums([x[k] for x in items]) for k in (1, 2, 3)}
    domains = sums(domain)
    out = []
    for i, item in enumerate(items):
        score = logs[i].copy()
        for k in (1, 2):
            if item[k]:
                n, s = kinds[k][item[k]]
                score += np.log((s + weight * n / totals.sum()) / (totals + weight))
        if item[3]:
            n, s = kinds[3][item[3]]
            dn, ds = domains[domain[i]]
            score += np.log((s - alone[i] + weight * (ds + weight * prior) / (dn + weight)) / (n - 1 + weight))
        else:
            score += np.log(prior)
        post = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        best, grams = int(post.argmax()), len(trigrams(item[0]))
        kept = grams > 0 and logs[i][best] > -math.log(GRAMS) / TEMPER * grams and post[best] >= 0.5
        out.append((LANGUAGES[best], round(float(post[best]), 9), LANGUAGES[int(alone[i].argmax())], kept))
    return out


def test_fusion_equals_plain_python(spark):
    items = []
    for k in range(60):
        lang = LANGUAGES[k % 4]
        text = SPOKEN[lang][: 5 + 3 * (k % 20)] if k % 7 else [None, "", "12 34 !!"][k % 3]
        items.append((text, [lang, None, "en"][k % 3], ["de", "com", None][k % 3], [f"a.{lang}.org", "hot.host.com", None][k % 3]))
    table = fit(labelled(spark))
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "id long, text string, declared string, suffix string, host string")
    frame = frame.withColumns({"items": F.lit(1), "alone": F.lit("x"), "sums": F.lit(2)}).repartition(4)
    rows = sorted(identify(frame, table, keys=["id"]).collect())
    got = [(r.language, round(r.confidence, 9), r.text_language, r.kept) for r in rows]
    assert got == plain(items, table)


def test_texts_are_told_apart_and_noise_is_rejected(spark):
    texts = [SPOKEN[x] for x in LANGUAGES] + ODD[:3] + ["1 2 3 $$$ ???", "qxzjvkwq xqzvjkqx zzxqjv" * 3]
    docs = documents(spark, texts).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    rows = sorted(identify(document_items(docs), fit(labelled(spark)), keys=["doc_id"]).collect())
    assert [r.language for r in rows[:4]] == list(LANGUAGES)
    assert [r.kept for r in rows] == [True] * 4 + [False] * 5


def test_trigram_counts_cover_all_labelled_texts(spark):
    table = fit(labelled(spark))
    for k, lang in enumerate(LANGUAGES):
        counts = np.bincount(trigrams(SPOKEN[lang] * 4), minlength=GRAMS) + 0.5
        assert np.allclose(table[:, k], np.log(counts / counts.sum()))


def test_evidence_of_pages(spark):
    html = '<!DOCTYPE html><HTML  dir="ltr" lang="fr-CA"><script>var x="<p>no</p>"</script><p>bonjour&nbsp;toi<!-- nein --></p>'
    rows = [(1, "https://Www.Example.FR:80/a?b", html), (2, None, None), (3, "odd", "<html lang=de>x")]
    first, null, odd = page_items(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert (first.declared, first.suffix, first.host, first.text.split()) == ("fr-CA", "fr", "www.example.fr", ["bonjour", "toi"])
    assert null.text is None and null.host is None
    assert (odd.declared, odd.host) == ("de", "")


def test_empty_tables_and_repeated_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    table = fit(empty)
    assert np.allclose(table, -math.log(GRAMS))
    assert identify(document_items(empty), table, keys=["doc_id"]).collect() == []
    twice = documents(spark, [SPOKEN["en"]]).unionAll(documents(spark, [SPOKEN["en"]]))
    a, b = identify(document_items(twice), fit(labelled(spark)), keys=["doc_id"]).collect()
    assert a == b
