"""Judge URLs by rules and, where none fits, by the templates of their host's paths.

A host's paths form a tree of segments. Level by level, from the root, down to ``depth`` levels
or, without that limit, until no path has segments left:

* a segment with a digit becomes a wildcard; so does every segment of a node with over
  ``branches`` different children, where such a limit is given;
* of the remaining children, those whose share of bad labels does not differ from the rest of
  the node's by a two-proportion test (|z| < ``alike``) merge into the wildcard.

A path's template is the way it takes through that tree. A template's purity is the share of
bad labels among its labelled pages, drawn towards its host's and, further up, towards all
pages' by ``weight`` pseudo-counts each; templates at ``reject`` or above are blocked.

Everything is aggregation and equi-join on (host, node): a host with a third of all pages is
combined in the map tasks first, and its few templates come back in joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.tables import look_up, saved

BRANCHES = 32
ALIKE = 2.58
WEIGHT = 5.0
REJECT = 0.5
DEPTH = 4


class Rule(NamedTuple):
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path, of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return host, path


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    labels: DataFrame,
    *,
    branches: int | None = BRANCHES,
    depth: int | None = DEPTH,
    alike: float = ALIKE,
    weight: float = WEIGHT,
    reject: float = REJECT,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    ``pages`` has page_id and url, ``labels`` page_id and bad (boolean). The longest rule that
    fits decides and is named; else ``rule`` is null and the template's purity decides.
    ``depth`` None follows paths to their ends, and ``branches`` None keeps all children that differ, however many siblings they have.
    Repeated pages are judged alike and count each; a page labelled both ways is bad; null
    labels and labels of other pages are ignored; a page with a null id has no label. A null
    or odd URL has an empty host and path, which make a template like any other. Without any
    label all purities are 0. Empty tables give no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("shape", F.regexp_replace("path", r"[^/]*[0-9][^/]*", "*"))
    parsed = parsed.withColumn("key", F.sha2(F.concat("host", F.lit(" "), "shape"), 256))
    known = (
        labels.filter("page_id is not null and bad is not null")
        .groupBy(F.col("page_id").alias("labelled_id"))
        .agg(F.max(F.col("bad").cast("int")).alias("bad"))
    )
    shapes = saved(
        parsed.join(known, parsed["page_id"] == known["labelled_id"], "left")
        .groupBy("key", "host", "shape")
        .agg(
            F.count("*").alias("pages"),
            F.count("bad").alias("labelled"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        ),
        "url-shapes",
    )
    templates = saved(_purities(_templates(shapes, branches, depth, alike), weight), "url-templates")
    ruled = parsed.withColumn("rule", _rule(rules, F.col("host"), F.col("path")))
    judged = look_up(ruled, templates, "key", "pages")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("rule.text").alias("rule"),
        F.coalesce(
            "rule.verdict", F.when(F.col("purity") >= reject, "block").otherwise("allow")
        ).alias("verdict"),
        "template",
        "purity",
    )


def _rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest fitting rule as struct<text,verdict>, else null."""
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: (-len(r.text), r))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<text:string,verdict:string>"))


def _templates(shapes: DataFrame, branches: int | None, depth: int | None, alike: float) -> DataFrame:
    """Each shape with its template, found level by level."""
    counts = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    few = F.lit(True) if branches is None else F.col("children") <= branches
    at = shapes.withColumn("node", F.lit("")).withColumn("left", F.split("shape", "/"))
    done, level = [], 0
    while depth is None or level < depth:
        at = at.withColumn("part", F.get("left", F.lit(level)))
        children = at.groupBy("host", "node", "part").agg(*counts)
        nodes = children.groupBy("host", "node").agg(
            F.count("*").alias("children"),
            F.sum("labelled").alias("all_labelled"),
            F.sum("bad").alias("all_bad"),
        )
        others = F.col("all_labelled") - F.col("labelled")
        share = F.try_divide("all_bad", "all_labelled")
        gap = F.try_divide("bad", "labelled") - F.try_divide(F.col("all_bad") - F.col("bad"), others)
        noise = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), "labelled") + F.try_divide(F.lit(1.0), others)))
        differs = F.coalesce(F.abs(F.try_divide(gap, noise)) >= alike, F.lit(False))
        kept = (
            children.join(nodes, ["host", "node"])
            .filter((F.col("children") == 1) | (few & differs))
            .filter("part <> '*'")
            .select("host", "node", "part", F.col("part").alias("kept"))
        )
        step = F.concat("node", F.lit("/" if level else ""), F.coalesce("kept", F.when(F.col("part") == "", "").otherwise("*")))
        at = at.join(kept, ["host", "node", "part"], "left").withColumn("node", step).drop("kept", "part")
        level += 1
        at = saved(at, "url-level")
        done.append(at.filter(F.size("left") <= level))
        at = at.filter(F.size("left") > level)
        if depth is None:
            # The only shape of a node is its own template from there on, whatever its length.
            lone = at.groupBy("host", "node").agg(F.count("*").alias("shapes")).filter("shapes = 1")
            at = saved(at.join(lone, ["host", "node"], "left"), "url-lone")
            rest = F.array_join(F.slice("left", level + 1, F.size("left") - level), "/")
            done.append(at.filter("shapes = 1").withColumn("node", F.concat("node", F.lit("/"), rest)).drop("shapes"))
            at = at.filter("shapes is null").drop("shapes")
            if at.isEmpty():
                break
    at = at.withColumn("node", F.concat("node", F.lit("/**")))
    for some in done:
        at = at.unionByName(some)
    return at.withColumn("template", F.col("node")).drop("node", "left")


def _purities(shapes: DataFrame, weight: float) -> DataFrame:
    """Per shape: key, pages, template, purity."""
    counts = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    every = shapes.agg(*counts).first()
    prior = every["bad"] / every["labelled"] if every["labelled"] else 0.0

    def drawn(bad: str, labelled: str, towards: Column) -> Column:
        return (F.col(bad) + weight * towards) / (F.col(labelled) + weight)

    hosts = shapes.groupBy("host").agg(*counts)
    hosts = hosts.select("host", drawn("bad", "labelled", F.lit(prior)).alias("host_purity"))
    purities = (
        shapes.groupBy("host", "template")
        .agg(*counts)
        .join(hosts, "host")
        .select("host", "template", drawn("bad", "labelled", F.col("host_purity")).alias("purity"))
    )
    return shapes.join(purities, ["host", "template"]).select("key", "pages", "template", "purity")

