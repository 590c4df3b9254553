import re

from pyspark.sql import functions as F

from sluiceway.llm.licenses import TEMPLATES, license_notices
from tests.llm.helpers import DOCS, ODD, documents, prose


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def sets(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(text):
    """Templates of which some run of words as long as their window holds 80 per cent."""
    w = plain_words(text)
    out = set()
    for name, template in TEMPLATES.items():
        held = sets(plain_words(template))
        long = len(held) + 4
        for k in range(max(1, len(w) - long + 1)):
            if len(sets(w[k : k + long]) & held) * 100 >= 80 * len(held):
                out.add(name)
                break
    return out


def test_every_template_is_found_wherever_it_stands(spark):
    texts = list(ODD)
    for k, template in enumerate(TEMPLATES.values()):
        texts += [template, template.upper().replace(" ", "\n"), prose(k, 37 * k) + " " + template + " " + prose(-k, 50)]
        cut = template.split(" ")
        texts += [" ".join(cut[: len(cut) * 6 // 10]), " ".join(cut[1:]), prose(k, 17_000) + " " + template]
    docs = documents(spark, texts).withColumns({"start": F.lit(1), "template": F.lit("x")}).repartition(4)
    found = {}
    for r in license_notices(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.template)
        assert r.containment >= 0.8 and r.license == r.template.split("/")[0]
        assert 0 <= r.start < r.end <= len(plain_words(texts[r.doc_id]))
    for i, text in enumerate(texts):
        assert brute(text) == found.get(i, set()), text[:200]


def test_two_notices_of_one_kind_and_repeated_rows(spark):
    line = TEMPLATES["MIT/line"]
    rows = [(1, line + " " + prose(1, 40) + " " + line), (1, line + " x"), (None, line), (2, None)]
    out = license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.start, r.end) for r in out) == [(0, 0, 5), (1, 0, 5), (1, 0, 5), (1, 45, 50)]


def test_adjacent_notices_are_given_each(spark):
    texts, want = [], []
    for name, template in TEMPLATES.items():
        long = len(plain_words(template))
        cut = template.split(" ")
        less = " ".join(["x", *cut[1:]]) if len(sets(plain_words(template))) > 5 else template
        skip = int(less != template)
        for k, row in enumerate([template] * 9, start=1):
            if k in (2, 9):
                texts.append(" ".join([row] * k))
                want.append((name, [(i * long, (i + 1) * long) for i in range(k)]))
        # The first lacks a word, which the second has.
        texts.append(f"{less} {template}")
        want.append((name, [(skip, long), (long, 2 * long)]))
    found = {}
    for r in license_notices(documents(spark, texts).repartition(4)).collect():
        found.setdefault((r.doc_id, r.template), []).append((r.start, r.end))
    for i, (name, places) in enumerate(want):
        assert sorted(found[i, name]) == places, (name, texts[i][:100])


def test_a_template_that_repeats_itself_and_parts_in_another_order(spark):
    chorus = "one two three four five six one two three four five six seven eight nine ten"
    halves = [prose(1, 30), prose(2, 30)]
    templates = {"chorus": chorus, "halves": " ".join(halves)}
    third, rest = " ".join(halves[0].split(" ")[:20]), " ".join(halves[0].split(" ")[20:])
    # The last has no 80 per cent between repeats, but over the whole of it.
    texts = [chorus, f"{chorus} {chorus}", " ".join(halves[::-1]), f"{halves[1]} {third} {third} {rest}"]
    found = license_notices(documents(spark, texts), templates).collect()
    assert sorted((r.doc_id, r.template, r.start, r.end) for r in found) == [
        (0, "chorus", 0, 16), (1, "chorus", 0, 16), (1, "chorus", 16, 32), (2, "halves", 0, 60), (3, "halves", 0, 80)
    ]


def test_empty_table_and_no_templates(spark):
    assert license_notices(spark.createDataFrame([], DOCS)).collect() == []
    assert license_notices(documents(spark, ODD), {"none": " "}).collect() == []
