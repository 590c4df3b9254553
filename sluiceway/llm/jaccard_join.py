"""Which documents' sets of word shingles have a Jaccard similarity of at least 0.8.

1. Every text becomes the set of its shingles, read once. Kept of it: its size, a digest, a
   bitmap of at least four bits per shingle (a power of two, so a larger one folds onto a
   smaller), and ``BANDS`` keys of two min-hashes each. Documents with equal sets form a class,
   which its smallest document stands for from here on.
2. Two sets at the threshold share a key with a probability of 1 - 0.36^BANDS, all but 1e-9.
   Each key's classes are first paired with one of them only, chosen by hash.
3. Bitmaps judge a pair: a differing bit needs a differing shingle, so the similarity is at
   most (a + b - x) / (a + b + x), x the differing bits. Of the pairs that may reach the
   threshold, each class's best is verified first, on the exact sorted sets, and then those
   of the others that still join different components.
4. Keys whose classes are still in different components are compared in full, in tiles of a
   size band and a block: only classes of like size meet, and of these only pairs in
   different components that the bitmaps let through come out, to be verified as before.

So near copies of one document, however many, cost a few pairs each, and no two texts that
are linked end in different components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.components import components
from sluiceway.llm.tables import each_group, likely, look_up, saved
from sluiceway.llm.words import mix, shingle_set, signed, word_hashes

SIMILAR = 80  # per cent
BANDS = 20
ROWS = 2
BLOCK = 512
_PART = 1 << 12
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_PAIR = "a long, b long, n_a long, n_b long, bits_a binary, bits_b binary"


def _signature(held: np.ndarray) -> tuple[list[int], bytes]:
    """Keys and bitmap of a set that is not empty."""
    parts = [mix(held[None, k : k + _PART] ^ _SEEDS[:, None]).min(axis=1) for k in range(0, len(held), _PART)]
    least = np.min(parts, axis=0).reshape(BANDS, ROWS)
    keys = mix(mix(least[:, 0] + np.arange(BANDS, dtype=np.uint64)) + least[:, 1])
    width = max(64, 1 << (4 * len(held) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(held % np.uint64(width)).astype(np.int64)] = True
    return signed(keys).tolist(), np.packbits(bits).tobytes()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, digest, keys, bits; the last three null for n = 0."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, words in zip(frame["doc_id"].astype(object), word_hashes(frame["text"]), strict=True):
                held = shingle_set(words)
                if len(held):
                    rows.append((doc_id, len(held), hashlib.blake2b(held.tobytes(), digest_size=16).hexdigest(), *_signature(held)))
                else:
                    rows.append((doc_id, 0, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "digest", "keys", "bits"], dtype=object)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        sets, "doc_id long, n long, digest string, keys array<long>, bits binary"
    )


def _exact_sets(docs: DataFrame) -> DataFrame:
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [signed(shingle_set(words)) for words in word_hashes(frame["text"])]
            yield pd.DataFrame({"id": frame["doc_id"], "held": held})

    return docs.select("doc_id", "text").mapInPandas(sets, "id long, held array<long>")


def _most(n_a: int, n_b: int, bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Per cent that the similarity of sets can reach; bitmaps as uint64 along the last axis."""
    while bits_a.shape[-1] != bits_b.shape[-1]:
        if bits_a.shape[-1] > bits_b.shape[-1]:
            bits_a = _folded(bits_a)
        else:
            bits_b = _folded(bits_b)
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64)
    return 100 * (n_a + n_b - differ) / (n_a + n_b + differ)


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def _words(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, np.uint64)


def _possible(pairs: DataFrame, least: int) -> DataFrame:
    """The pairs that the bitmaps let through: a, b, most."""

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            most = np.array(
                [_most(*x, _words(p), _words(q)) for *x, p, q in zip(f["n_a"], f["n_b"], f["bits_a"], f["bits_b"], strict=True)],
                float,
            )
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "most": most})[most >= least]

    return pairs.mapInPandas(bounded, "a long, b long, most double")


def _verified(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose exact sets are similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    exact = saved(_exact_sets(likely(docs, ids, "doc_id")).join(ids, "id", "left_semi"), "sets")

    def similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for p, q in zip(f["held_a"], f["held_b"], strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= least * (len(p) + len(q) - both))
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    left = exact.select(F.col("id").alias("a"), F.col("held").alias("held_a"))
    right = exact.select(F.col("id").alias("b"), F.col("held").alias("held_b"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(similar, "a long, b long")


def _with_components(pairs: DataFrame, found: DataFrame | None) -> DataFrame:
    """Pairs with the components ca and cb of their ends, where these differ."""
    if found is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    left = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = {"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}
    return pairs.join(left, "a", "left").join(right, "b", "left").withColumns(ends).filter("ca <> cb")


def _settle(
    pairs: DataFrame, links: DataFrame, found: DataFrame | None, docs: DataFrame, least: int
) -> tuple[DataFrame, DataFrame | None]:
    """Verify the pairs that join different components; the links, and the components.

    First each end's best pair is verified. Those of the others that then still join different
    components are verified all.
    """
    pairs = saved(_with_components(pairs, found).select("a", "b", "most"), "pairs")
    both = pairs.select(F.explode(F.array("a", "b")).alias("end"), "a", "b", "most")
    best = both.groupBy("end").agg(F.max_by(F.struct("a", "b"), F.struct("most", "a", "b")).alias("pair"))
    now = saved(best.select("pair.a", "pair.b").distinct(), "chosen")
    for _ in range(2):
        if now.isEmpty():
            break
        links = saved(links.unionByName(_verified(now, docs, least)), "links")
        found = saved(components(links), "components")
        rest = _with_components(pairs.join(now, ["a", "b"], "left_anti"), found)
        now = saved(rest.select("a", "b"), "chosen")
    return links, found


def _tiles(keys: DataFrame, classes: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Pairs within a key that are in different components and may be similar: a, b, most."""
    named = keys.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    mixed = named.groupBy("key").agg(F.count("*").alias("ids"), F.min("component").alias("c"), F.max("component").alias("d"))
    mixed = mixed.filter("c <> d").withColumn("blocks", F.ceil(F.col("ids") / BLOCK)).select("key", "blocks")
    # A set meets its own band, and as a guest the next: sizes at the threshold are no farther apart.
    band = F.floor(F.log("n") / math.log(101 / least))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    placed = (
        named.join(mixed, "key")
        .join(classes.select("id", "n", "bits", "keys"), "id")
        .withColumn("place", F.array_position("keys", F.col("key")).cast("int") - 1)
        .withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("band", (band + F.col("guest")).cast("int"))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )

    names = ["key", "band", "low", "high"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for tile in each_group(frames, names):
            found += _tile(tile, least)
        yield pd.DataFrame(found, columns=["a", "b", "most"])

    return (
        placed.repartition(*names)
        .sortWithinPartitions(*names)
        .mapInPandas(compare, "a long, b long, most double")
        .groupBy("a", "b")
        .agg(F.max("most").alias("most"))
    )


def _tile(f: dict[str, np.ndarray], least: int) -> list[tuple[int, int, float]]:
    """The pairs of one tile that may be similar."""
    host, n, block, component, name = f["guest"] == 0, f["n"], f["block"], f["component"], f["id"]
    if not host.any() or (component == component[0]).all():
        return []
    earlier = np.stack(f["keys"])[:, : f["place"][0]]
    bits = [_words(b) for b in f["bits"]]
    across = f["low"][0] != f["high"][0]
    widths: dict[int, list[int]] = {}
    for i, b in enumerate(bits):
        widths.setdefault(len(b), []).append(i)
    stacks = [(np.array(rows), np.stack([bits[i] for i in rows])) for rows in widths.values()]
    out = []
    for i in np.flatnonzero(host):
        for rows, held in stacks:
            ok = (component[rows] != component[i]) & ((name[rows] > name[i]) | ~host[rows])
            ok &= 100 * np.minimum(n[rows], n[i]) >= least * np.maximum(n[rows], n[i])
            if across:
                ok &= block[rows] != block[i]
            # A pair that shares several keys is compared under the first of them only.
            ok[ok] &= (earlier[rows[ok]] != earlier[i]).all(axis=1)
            if not ok.any():
                continue
            most = _most(n[i], n[rows[ok]], bits[i], held[ok])
            good = most >= least
            out += [(min(name[i], b), max(name[i], b), m) for b, m in zip(name[rows[ok]][good], most[good], strict=True)]
    return out


def similar_components(docs: DataFrame, *, least: int = SIMILAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when ``100 * intersection >= least * union`` of their shingle sets;
    ``component_id`` is the smallest doc_id reachable by links, itself included.
    A text without words, empty or null, has no shingles and links
    with nothing. Repeated rows are equal texts, and so linked; a row without a doc_id takes
    the component of an equal text that has one, else null. One id with several texts is one
    document that has the links of all. An empty table gives no rows; other columns are ignored.
    """
    sets = saved(shingle_sets(docs), "signatures")
    filled = sets.filter("n > 0")
    classes = saved(
        filled.groupBy("digest").agg(
            F.min("doc_id").alias("id"),
            F.count("*").alias("rows"),
            F.min_by(F.struct("n", "keys", "bits"), "doc_id").alias("s"),
        ).select("digest", "id", "rows", "s.*"),
        "classes",
    )
    known = classes.filter("id is not null")
    keyed = known.select("id", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(
        F.count("*").alias("ids"), F.min(F.struct(F.xxhash64("id", "key"), "id")).alias("leader")
    )
    keys = saved(keyed.join(leaders.filter("ids > 1").select("key", F.col("leader.id").alias("leader")), "key"), "keys")
    size = known.select("id", "n", "bits")
    stars = (
        keys.filter("id <> leader")
        .select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
        .distinct()
        .join(size.toDF("a", "n_a", "bits_a"), "a")
        .join(size.toDF("b", "n_b", "bits_b"), "b")
        .filter(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
        .select([x.split()[0] for x in _PAIR.split(", ")])
    )
    none = keys.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    links, found = _settle(_possible(stars, least), none, None, texts, least)
    found = components(none) if found is None else found
    _, found = _settle(_tiles(keys.select("id", "key"), known, found, least), links, found, texts, least)
    classes = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "digest", "rows", F.coalesce("component", "id").alias("component_id")
    )
    return look_up(sets.select("doc_id", "n", "digest"), saved(classes, "components"), "digest", "rows").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
