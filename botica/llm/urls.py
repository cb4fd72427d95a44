"""Verdicts on URLs: rules by host and path, and boosted trees for all others.

The URLs that a rule judges are the labelled ones. The trees learn from their wording
alone: length, depth, shares of classes of characters, entropy of characters, parameters, and how often
labelled URLs of like endings and words were blocked. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botica.llm.staging import numbered, written

# (host and path, verdict); a rule fits its host and all subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NUMBERS = (
    "url_length host_length path_length depth labels vowels consonants digits steps signs entropy "
    "parameters pairs longest fragment secure"
).split()
# Stretches of the URL whose record among the labelled URLs is a feature.
PARTS = ("top", "domain", "first", "ending")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; then up to ``?``, ``#`` or the end."""
    rest = F.when(url.contains("://"), F.substring_index(url, "#", 1))
    after = F.expr("substring(url, locate('://', url) + 3)")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    known = F.coalesce(rest.isNotNull(), F.lit(False))
    return (
        F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""),
        F.when(known, path).otherwise(""),
    )


def ruled(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds rule and ruling of the longest rule that fits, null where none does."""
    fits = []
    for rule, verdict in rules:
        host, _, path = rule.partition("/")
        on_host = (F.col("host") == host) | F.col("host").endswith("." + host)
        fit = on_host & F.col("path").startswith("/" + path)
        fits.append(
            F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("v")))
        )
    longest = F.greatest(*fits) if len(fits) > 1 else fits[0]
    return (
        urls.withColumn("fit", longest)
        .withColumn("rule", F.col("fit.rule"))
        .withColumn("ruling", F.col("fit.v"))
        .drop("fit")
    )


def _numbers(urls: DataFrame) -> DataFrame:
    """The lexical features and the parts; a null URL counts as empty."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    # Sorted characters stand in runs, one for each distinct one.
    ordered = F.array_join(F.sort_array(F.split(url, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    entropy = F.aggregate(
        F.transform(runs, lambda run: F.length(run) / n), F.lit(0.0), lambda bits, s: bits - s * F.log2(s)
    )
    kinds = [r"[aeiouAEIOU]", r"[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]", r"[0-9]", r"[/.]", r"[^A-Za-z0-9/.]"]
    vowels, consonants, digits, steps, signs = (F.regexp_count(url, F.lit(k)) / n for k in kinds)
    words = F.split(F.col("path"), "/")
    values = {
        "url_length": F.log1p(n),
        "host_length": F.log1p(F.length("host")),
        "path_length": F.log1p(F.length("path")),
        "depth": F.regexp_count("path", F.lit("/")),
        "labels": F.regexp_count("host", F.lit(r"\.")),
        "vowels": vowels,
        "consonants": consonants,
        "digits": digits,
        "steps": steps,
        "signs": signs,
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "pairs": F.regexp_count(query, F.lit("=")),
        "longest": F.array_max(F.transform(words, F.length)),
        "fragment": url.contains("#").cast("int"),
        "secure": url.startswith("https").cast("int"),
    }
    parts = {
        "top": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
        "first": F.coalesce(F.get(words, F.lit(1)), F.lit("")),
        "ending": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/)$", 1),
    }
    return urls.withColumns(
        {name: F.coalesce(v.cast("double"), F.lit(0.0)) for name, v in values.items()} | parts
    )


def _records(labelled: DataFrame) -> DataFrame:
    """kind, part, blocked, seen: what rules said of the URLs with each part."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("kind"), F.col(p).alias("part")) for p in PARTS)))
    rows = labelled.select((F.col("ruling") == "block").cast("double").alias("blocked"), each.alias("of"))
    return rows.groupBy("of.kind", "of.part").agg(F.sum("blocked").alias("blocked"), F.count("*").alias("seen"))


def _with_records(urls: DataFrame, records: DataFrame, base: float, strength: float) -> DataFrame:
    """Adds a smoothed share of blocks for each part, without the URL's own ruling."""
    own = F.when(F.col("ruling") == "block", 1.0).when(F.col("ruling") == "allow", 0.0)
    for part in PARTS:
        one = records.where(F.col("kind") == part).select(F.col("part").alias(part), "blocked", "seen")
        seen = F.coalesce("seen", F.lit(0)) - F.when(own.isNotNull(), 1).otherwise(0)
        blocked = F.coalesce("blocked", F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
        share = (blocked + strength * base) / (seen + strength)
        urls = urls.join(one, part, "left").withColumn(f"share_{part}", share).drop("blocked", "seen")
    return urls


def url_verdicts(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    training_rows: int = 200_000,
    trees: int = 12,
    depth: int = 4,
    strength: float = 20.0,
) -> DataFrame:
    """One row per page: id, url, host, path, rule, verdict, score (of block, 0 to 1).

    A rule's verdict stands; other URLs are blocked where the trees give 0.5 or more.
    The trees are fitted on at most about ``training_rows`` ruled URLs, picked by hash;
    the counts behind the shares cover all of them. A null URL has empty host and path.
    Where rules give one verdict only, or none, the others get that one, or allow.
    Repeated and null ids are rows like others; an empty table gives an empty result.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = numbered(ruled(urls.withColumn("host", host).withColumn("path", path), rules), "urls")
    counts = dict(urls.where("ruling is not null").groupBy("ruling").count().collect())
    blocked, allowed = counts.get("block", 0), counts.get("allow", 0)
    if not blocked or not allowed:
        score = F.lit(1.0 if blocked else 0.0)
        others = urls.select("id", "url", "host", "path", "rule", "ruling", score.alias("score"))
    else:
        measured = _numbers(urls)
        labelled = measured.where("ruling is not null")
        records = written(_records(labelled), "url-records")
        base = blocked / (blocked + allowed)
        rows = written(_with_records(measured, records, base, strength), "url-features")
        inputs = [*NUMBERS, *(f"share_{p}" for p in PARTS)]
        vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
        kept = F.lit(training_rows / (blocked + allowed))
        pick = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < kept * (1 << 30)
        sample = vectors.where(F.col("ruling").isNotNull() & pick)
        sample = sample.select("features", (F.col("ruling") == "block").cast("double").alias("label"))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=7).fit(sample)
        others = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return others.select(
        "id", "url", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "score"
    )
