"""The operators' queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.bpe import encoded, ids_digest
from sluiceway.llm.exact_dedup import exact_groups
from sluiceway.llm.hard_negatives import hard_negatives
from sluiceway.llm.jaccard_join import similar_components
from sluiceway.llm.language import document_items, fit, identify, page_items
from sluiceway.llm.licenses import license_notices
from sluiceway.llm.mixing import drawn
from sluiceway.llm.nearest import nearest_neighbours
from sluiceway.llm.packing import pack
from sluiceway.llm.recurrent import score
from sluiceway.llm.runs import periodic_runs
from sluiceway.llm.substrings import repeated_passages
from sluiceway.llm.url_filter import Rule, host_and_path, judge_urls

Query = Callable[[SparkSession, str], DataFrame]
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table. Python workers are told where this package is."""
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The definition of a public tokenizer."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document with its language; the texts' labels are the documents'.

    Rows of documents have a doc_id and those of pages a page_id; the other is null.
    """
    docs = given(spark, sf_dir, "documents")
    items = document_items(docs).unionByName(page_items(given(spark, sf_dir, "pages")), allowMissingColumns=True)
    return identify(items, fit(docs), keys=("doc_id", "page_id"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of identical texts."""
    return exact_groups(given(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that repeats an earlier one."""
    return repeated_passages(given(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    return pack(given(spark, sf_dir, "documents"), tokenizer())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of texts that are alike in their shingles."""
    return similar_components(given(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the recurrent model's log-probability, and the words' alone."""
    return score(given(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, judged; a page is labelled as the document its path ends in the number of."""
    pages = given(spark, sf_dir, "pages").select("page_id", "url")
    labels = given(spark, sf_dir, "labels")
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"/([0-9]{1,18})(\.html|/)?$", 1)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    numbered = pages.select("page_id", number.try_cast("bigint").alias("doc_id"))
    known = numbered.join(labels.select("doc_id", bad.alias("bad")), "doc_id").drop("doc_id")
    return judge_urls(pages, RULES, known, branches=None, depth=None)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return nearest_neighbours(given(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).drop("query_row")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, tokenizer(), again="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in every document."""
    return license_notices(given(spark, sf_dir, "documents"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words of it that the mix takes."""
    rows = drawn(given(spark, sf_dir, "documents"), keep=["doc_id"])
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", taken, "copies")


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, where about every tenth text goes round in circles from some word on.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10): if h % 10 = 0, word i >= a is word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, cast(g % n as int), null)"))
    rows = rows.withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) as int)"))
    turns = "flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int)))"
    looped = F.expr(f"array_join(concat(slice(w, 1, a), slice({turns}, 1, n - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its runs, after some have been made to repeat themselves."""
    found = periodic_runs(with_loops(given(spark, sf_dir, "documents")))
    # Exponents are compared as fractions.
    best = F.expr(
        "array_sort(runs, (x, y) -> case when x.length * y.period <> y.length * x.period"
        " then if(x.length * y.period > y.length * x.period, -1, 1)"
        " when x.start <> y.start then if(x.start < y.start, -1, 1)"
        " when x.period <> y.period then if(x.period < y.period, -1, 1) else 0 end)[0]"
    )
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector's positives; labels of every seventh are moved on by one."""
    vectors = given(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_lm_score": op6_lm_score,
    "op7_url_filter": op7_url_filter,
    "op8_nearest": op8_nearest,
    "op9_bpe": op9_bpe,
    "op10_license_scan": op10_license_scan,
    "op11_mix_sources": op11_mix_sources,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
