"""URL filters: the longest rule that fits decides, and boosted trees on lexical features decide where no rule does.

Columns only, and gradient-boosted trees of Spark's own ML library, which run inside the JVM. A model sees nothing but the
URL: lengths, depths, ratios, entropies, counts of parameters, and how often URLs of its suffix were blocked among the
labelled ones. It is fitted on a bounded sample of labelled URLs; every URL is then judged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiqal.functions.graph import written

c = F.col
ALLOW, BLOCK = "allow", "block"
#: Parts of the hash of a URL.
PARTS = 1 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIGNS = LOWER + "0123456789-._~%/"
#: Labelled URLs of each label that a model is fitted on, those of the smallest hash; fewer if there are fewer.
SAMPLE = 8192
#: Trees, their depth, and what a suffix counts at first: PRIOR URLs with the share of blocked ones among all.
TREES, DEPTH, PRIOR = 16, 3, 8.0
#: Words whose presence in a host, between dots and hyphens, labels a URL as one to block. The model never sees them.
JUNK = "adult ads adserver bet bets betting casino cheap coupon escort free jackpot loan loans pharma pills poker porn promo sex slots spam spammer track tracker viagra win winner xxx".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased) and path (from there up to `?`, `#` or the end).

    Null or no `://`: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest (verdict, rule) that fits, else null; of rules of one length, the one given first.

    A rule is a host and a path, as in `example.net/en/`: it fits that host and its subdomains, if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        name = name.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per sign of the signs of SIGNS in a text; 0 if there are none."""
    counts = F.transform(F.array(*map(F.lit, SIGNS)), lambda s: (F.char_length(text) - F.char_length(F.replace(text, s, F.lit("")))).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))).otherwise(0.0)


def _share(text: Column, signs: str) -> Column:
    """The share of a text's characters that are among signs; 0 for an empty text."""
    n = F.char_length(text)
    return F.when(n > 0, (n - F.char_length(F.translate(text, signs, ""))) / n).otherwise(0.0)


def _count(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features by name, all doubles; none is null, whatever the URL."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    names = F.transform(labels, lambda x: F.char_length(x))
    found = {
        "length": F.char_length(text),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "longest_label": F.array_max(names),
        "host_depth": _count(host, "."),
        "path_depth": _count(path, "/"),
        "hyphens": _count(host, "-"),
        "digits": _share(text, "0123456789"),
        "host_digits": _share(host, "0123456789"),
        "host_vowels": _share(host, "aeiou"),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "query_length": F.char_length(query),
        "fragment": F.contains(text, F.lit("#")).cast("int"),
        "secure": F.startswith(F.translate(text, UPPER, LOWER), F.lit("https://")).cast("int"),
        "escapes": _count(text, "%"),
    }
    return {k: v.cast("double") for k, v in found.items()}


def _suffix(host: Column) -> Column:
    """A hash of the host's last label."""
    return F.xxhash64(F.element_at(F.split(host, r"\."), -1))


def junk_label(host: Column) -> Column:
    """Labels by name: 1 where a word of JUNK stands in the host between dots and hyphens, 0 for other hosts, null for an empty one."""
    words = F.split(host, r"[.\-]")
    return F.when(host != "", F.arrays_overlap(words, F.array(*map(F.lit, JUNK))).cast("int"))


@dataclass
class Model:
    """A fitted filter. trees is None where the labelled URLs had one label only, or none: then every URL gets `only`."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None  #: suffix, blocked, n: a row for each suffix of the sample, which holds 2 * SAMPLE URLs at most
    share: float
    only: str


def _rate(blocked: Column, n: Column, share: float) -> Column:
    return ((F.coalesce(blocked, F.lit(0)) + PRIOR * share) / (F.coalesce(n, F.lit(0)) + PRIOR)).alias("suffix_rate")


def _vectors(df: DataFrame) -> DataFrame:
    names = [*features(F.lit(""), F.lit(""), F.lit("")), "suffix_rate"]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def _share_of(n: int, sample: int) -> int:
    """Below which part twice as many of n distinct URLs are expected as the sample takes, so that no more than these are ever sorted in one place."""
    return PARTS if n <= 2 * sample else math.ceil(2 * sample / n * PARTS)


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample: int = SAMPLE) -> Model:
    """Trees for labelled URLs (label 1: block, 0: allow); rows without a URL or label take no part. Reruns agree.

    Fitted on the `sample` distinct URLs of each label with the smallest hash. A URL with both labels counts as one to block.
    The suffix rate of a URL that is fitted on leaves out the URL itself.
    """
    rows = labelled.select(labelled[url_col].cast("string").alias("url"), labelled[label_col].cast("int").alias("label")).where("url is not null and label in (0, 1)")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}  # two rows
    part = F.pmod(F.xxhash64("url"), F.lit(PARTS))
    few = rows.where(F.when(c("label") == 1, part < _share_of(sizes.get(1, 0), sample)).otherwise(part < _share_of(sizes.get(0, 0), sample)))
    few = few.groupBy("url").agg(F.max("label").alias("label"))
    some = [few.where(c("label") == k).orderBy(part, F.xxhash64("url", F.lit(1)), "url").limit(sample) for k in (0, 1)]
    host, path = host_and_path(c("url"))
    made = {k: v.alias(k) for k, v in features(c("url"), c("host"), c("path")).items()}
    split = some[0].unionByName(some[1]).select("url", "label", host.alias("host"), path.alias("path"))
    kept = written(split.select("label", F.xxhash64("url").alias("h"), _suffix(c("host")).alias("suffix"), *made.values()).repartition(1).sortWithinPartitions("h", "label"), "labelled-urls")
    n, blocked = kept.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < blocked < n:
        return Model(None, None, 0.0, BLOCK if blocked else ALLOW)
    share = blocked / n
    suffixes = kept.groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    own = kept.join(F.broadcast(suffixes), "suffix")  # 2 * sample rows at most
    own = own.select("label", "h", *made, _rate(c("blocked") - c("label"), c("n") - 1, share))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1).fit(_vectors(own).select("label", "features"))
    return Model(trees, written(suffixes, "suffixes"), share, ALLOW)


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = (), url_col: str = "url") -> DataFrame:
    """row (the untouched input row), host, path, rule, verdict, probability: one row per row of pages.

    verdict: that of the longest rule that fits, else block where the trees give blocking more than one half. probability: the
    trees' (null without trees). A null or empty URL has an empty host and path and is judged by its features like any other.
    """
    url = pages[url_col].cast("string")
    rows = pages.select(F.struct(*[pages[x] for x in pages.columns]).alias("row"), url.alias("url"))
    host, path = host_and_path(c("url"))
    rows = rows.select("row", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("row", "url", "host", "path", rule_of(c("host"), c("path"), rules).alias("found"))
    own: Column = F.lit(model.only)
    probability: Column = F.lit(None).cast("double")
    if model.trees is not None:
        rows = rows.select("*", _suffix(c("host")).alias("suffix"), *[v.alias(k) for k, v in features(c("url"), c("host"), c("path")).items()])
        rows = rows.join(F.broadcast(model.suffixes), "suffix", "left").select("*", _rate(c("blocked"), c("n"), model.share))
        rows = model.trees.setProbabilityCol("chance").transform(_vectors(rows))
        own = F.when(c("prediction") > 0.5, BLOCK).otherwise(ALLOW)
        probability = vector_to_array("chance")[1]
    return rows.select("row", "host", "path", c("found.rule").alias("rule"), F.coalesce(c("found.verdict"), own).alias("verdict"), probability.alias("probability"))


#: The rules of the query.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))


def digest(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, probability for pages whose hosts label the URLs to learn from (junk_label)."""
    host, _ = host_and_path(pages["url"])
    model = fit(pages.select("url", junk_label(host).alias("label")))
    return judge(pages.select("page_id", "url"), model, rules).select("row.page_id", "host", "path", "rule", "verdict", "probability")
