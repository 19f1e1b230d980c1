"""URL filtering: rules first, gradient-boosted trees for the rest.

Everything is DataFrame expressions. Features are computed from the URL text;
trees are grown level by level from histograms that one aggregation per level
brings back (nodes x features x bins, whatever the number of rows); the fitted
model is an expression again.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import Scratch

# Fixed by the contract of the query.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
SAMPLE = 20_000  # labelled URLs that the trees are fitted on, at most about so many
TREES, DEPTH, BINS, RATE, SMOOTH = 10, 3, 16, 0.3, 1.0
SUFFIX_PRIOR = 5.0

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "upper_ratio",
    "hyphens", "entropy", "parameters", "fragment", "tld_rate", "domain_rate", "section_rate",
    "tld_count", "domain_count", "section_count",
)


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise("")
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(F.col("_rest"), F.length("_host") + 1), "^[^?#]*", 0)
    return (
        urls.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("_host", host)
        .withColumn("path", path)
        .withColumn("host", F.translate("_host", string.ascii_uppercase, string.ascii_lowercase))
        .drop("_rest", "_host")
    )


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict: those of the longest rule that fits."""
    rule, verdict = None, None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = text.partition("/")
        own = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits = own & F.startswith("path", F.lit("/" + path))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return urls.withColumn("rule", none if rule is None else rule).withColumn(
        "rule_verdict", none if verdict is None else verdict
    )


def _count(text: str, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(F.col(text), F.lit(what), F.lit("")))).cast("double")


def _ratio(text: str, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def _entropy(text: str) -> Column:
    n = F.length(text).cast("double")

    def part(c: Column) -> Column:
        p = (n - F.length(F.replace(F.col(text), c, F.lit("")))) / n
        return -p * F.log2(p)

    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a + part(c))


def with_lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone."""
    query = F.when(F.instr("_url", "?") > 0, F.substring_index(F.col("_url"), "?", -1)).otherwise("")
    out = urls.withColumn("_url", F.coalesce("url", F.lit(""))).withColumn("_query", query)
    return (
        out.withColumn("url_length", F.length("_url").cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("depth", _count("path", "/"))
        .withColumn("labels", _count("host", "."))
        .withColumn("digit_ratio", _ratio("_url", "[0-9]"))
        .withColumn("upper_ratio", _ratio("_url", "[A-Z]"))
        .withColumn("hyphens", _count("host", "-"))
        .withColumn("entropy", _entropy("_url"))
        .withColumn("parameters", F.when(F.length("_query") > 0, _count("_query", "&") + 1).otherwise(0.0))
        .withColumn("fragment", (F.instr("_url", "#") > 0).cast("double"))
        .withColumn("tld", F.regexp_extract("host", r"[^.]*$", 0))
        .withColumn("domain", F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0))
        .withColumn("section", F.regexp_extract("path", r"^/([^/]*)", 1))
        .drop("_url", "_query")
    )


@dataclass
class Model:
    base: float
    prior: float
    trees: list[dict]  # node (1 is the root, 2n and 2n+1 below n) to ("split", feature, edge) or ("leaf", value)
    suffixes: dict[str, DataFrame]  # host suffixes and first path part: rate and count in the sample

    def margin(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _tree(tree)
        return total


def _tree(tree: dict, node: int = 1) -> Column:
    what = tree[node]
    if what[0] == "leaf":
        return F.lit(what[1])
    left, right = _tree(tree, 2 * node), _tree(tree, 2 * node + 1)
    return F.when(F.col(what[1]) <= what[2], left).otherwise(right)


def with_suffixes(urls: DataFrame, suffixes: dict[str, DataFrame], prior: float) -> DataFrame:
    """Adds the suffix statistics. They come from the bounded sample, so they
    have at most SAMPLE rows and are broadcast."""
    for name, stats in suffixes.items():
        urls = urls.join(F.broadcast(stats), name, "left")
        urls = urls.fillna({f"{name}_rate": prior, f"{name}_count": 0.0})
    return urls


def _labelled_sample(urls: DataFrame, label: str) -> DataFrame:
    labelled = urls.filter(F.col(label).isNotNull())
    n = labelled.count()
    share = min(1.0, SAMPLE / max(n, 1))
    return labelled.filter(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)


def _split(rows: list, depth: int) -> dict:
    """The best split or the leaf of every node from its histogram."""
    nodes: dict[int, dict[str, list]] = {}
    for r in rows:
        nodes.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
    found = {}
    for node, by_feature in nodes.items():
        g = sum(x[1] for x in next(iter(by_feature.values())))
        h = sum(x[2] for x in next(iter(by_feature.values())))
        best = (1e-6, None, None)
        for feature in FEATURES:
            gl = hl = 0.0
            for b, gb, hb in sorted(by_feature.get(feature, []))[:-1]:
                gl, hl = gl + gb, hl + hb
                gain = gl**2 / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH) - g**2 / (h + SMOOTH)
                if round(gain, 6) > best[0]:
                    best = (round(gain, 6), feature, b)
        leaf = ("leaf", RATE * g / (h + SMOOTH))
        found[node] = leaf if best[1] is None or depth == DEPTH else ("split", best[1], best[2])
    return found


def train(urls: DataFrame, label: str = "rule_verdict") -> Model:
    """Fits the trees on the labelled rows of ``urls`` (url, host, path and a
    label that is allow, block or null). A label of one kind only, or none,
    gives a model without trees."""
    scratch = Scratch(urls.sparkSession)
    chosen = _labelled_sample(urls.select("url", "host", "path", label), label)
    plain = scratch.write(with_lexical(chosen).withColumn("y", (F.col(label) == "block").cast("double")))
    n, blocked = plain.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = (blocked + 1.0) / (n + 2.0)
    suffixes = {
        name: scratch.write(
            plain.groupBy(name).agg(
                ((F.sum("y") + SUFFIX_PRIOR * prior) / (F.count("*") + SUFFIX_PRIOR)).alias(f"{name}_rate"),
                F.log1p(F.count("*").cast("double")).alias(f"{name}_count"),
            )
        )
        for name in ("tld", "domain", "section")
    }
    model = Model(math.log(prior / (1 - prior)), prior, [], suffixes)
    if not 0 < blocked < n:
        return model
    rows = with_suffixes(plain, suffixes, prior)
    cuts = [(i + 1) / BINS for i in range(BINS - 1)]
    first = rows.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(first[f])) for f in FEATURES}
    # equal rows count once: what the trees see is bins, label and number
    binned = rows.select(
        *[sum((F.col(f) > e).cast("int") for e in edges[f]).alias(f) for f in FEATURES], "y"
    )
    binned = binned.groupBy(*FEATURES, "y").agg(F.count("*").cast("double").alias("n"))
    binned = scratch.write(binned.withColumn("margin", F.lit(model.base)).coalesce(4))
    for _ in range(TREES):
        tree: dict = {}
        for depth in range(DEPTH + 1):
            node = _node(tree)
            p = 1 / (1 + F.exp(-F.col("margin")))
            bins = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES]))
            level = binned.select(node.alias("node"), "n", "y", p.alias("p"), bins.alias("x")).filter("node > 0")
            found = level.groupBy("node", "x.feature", "x.bin").agg(
                F.sum(F.col("n") * (F.col("y") - F.col("p"))).alias("g"),
                F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"),
            )
            tree |= _split(found.collect(), depth)  # bounded: nodes x features x bins
            if all(what[0] == "leaf" for what in tree.values()):
                break
        after = scratch.write(binned.withColumn("margin", F.col("margin") + _tree(tree)).coalesce(4))
        scratch.drop(binned)
        binned = after
        model.trees.append(
            {k: ("split", w[1], edges[w[1]][w[2]]) if w[0] == "split" else w for k, w in tree.items()}
        )
    return model


def _node(tree: dict, node: int = 1) -> Column:
    """The unfinished node that a row falls into, or 0."""
    if node not in tree:
        return F.lit(node)
    what = tree[node]
    if what[0] == "leaf":
        return F.lit(0)
    return F.when(F.col(what[1]) <= what[2], _node(tree, 2 * node)).otherwise(_node(tree, 2 * node + 1))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict and score for every page.

    The trees learn from the URLs that a rule judges and judge the others:
    block above probability one half. Null and empty URLs and those without
    ``://`` have an empty host and path and are judged by the trees as well.
    Repeated rows get the same verdict; other columns are ignored; an empty
    table gives no rows."""
    ruled = with_rule(with_parts(pages.select("page_id", "url")), rules)
    model = train(ruled)
    scored = with_suffixes(with_lexical(ruled), model.suffixes, model.prior)
    score = 1 / (1 + F.exp(-model.margin()))
    return scored.withColumn("score", score).select(
        "page_id",
        "url",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
