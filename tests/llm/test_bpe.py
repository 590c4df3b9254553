import json
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.llm.bpe import ByteBpe, decoded, encoded, ids_digest
from sluiceway.llm.queries import tokenizer
from tests.llm.helpers import DOCS, ODD, documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_str(tokenizer())


def texts():
    rnd = random.Random(3)
    made = ["".join(rnd.choice("abc !'<|>entdofx\n 1é日🎉") for _ in range(rnd.randrange(80))) for _ in range(500)]
    return [*ODD, "a<|endoftext|>b", "<|endoftext|>", "!" * 5000, " " * 3000, "don't I'll\r\n\t x1y2 ", *made]


def test_ids_and_texts_match_the_library(spark, reference):
    docs = documents(spark, texts()).withColumns({"ids": F.lit("clash"), "__coded": F.lit(1)}).repartition(3)
    both = encoded(docs, tokenizer(), again="again").withColumn("digest", ids_digest(F.col("ids")))
    for row in decoded(both, tokenizer()).collect():
        want = reference.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want
        assert row.decoded == row.again == reference.decode(want, skip_special_tokens=False) == (row.text or "")


def test_merges_are_leftmost_of_the_lowest_rank():
    vocab = {c: i for i, c in enumerate([chr(b) for b in range(33, 127)] + [chr(256 + k) for k in range(68)] + [chr(b) for b in [*range(161, 173), *range(174, 256)]])}
    for merged in ("aa", "ab", "aab"):
        vocab[merged] = len(vocab)
    model = ByteBpe(json.dumps({"model": {"vocab": vocab, "merges": ["a a", "a b", "aa b"]}}))
    spelled = {i: t for t, i in vocab.items()}
    assert [spelled[i] for i in model.encode("aaab").tolist()] == ["aa", "ab"]
    assert [spelled[i] for i in model.encode("aaaaab").tolist()] == ["aa", "aa", "ab"]
    assert [spelled[i] for i in model.encode("aab").tolist()] == ["aab"]


def test_bytes_that_are_no_text_are_replaced(reference):
    model = ByteBpe(tokenizer())
    ids = reference.encode("日本", add_special_tokens=False).ids[:-1]
    assert model.decode(ids) == reference.decode(ids, skip_special_tokens=False)
    assert model.decode(None) == model.decode([]) == ""
    with pytest.raises(KeyError):
        model.decode([10**6])


def test_empty_table(spark):
    assert encoded(spark.createDataFrame([], DOCS), tokenizer()).collect() == []
