"""Languages of web pages by Bayesian evidence fusion.

Four pieces of evidence make one posterior: the likelihood of the visible text under
byte trigrams of each language, the language that the markup declares, the suffix of
the address, and the host. The last two are priors: a host's counts are smoothed by
its suffix's, and those by the counts of all pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.llm.staging import numbered, ship_code, widened, written
from botica.llm.urls import host_and_path
from botica.llm.words import SPAN, as_bytes

BUCKETS = 1 << 13

_letter = np.full(256, 32, dtype=np.int64)
_letter[97:123] = np.arange(97, 123)
_letter[65:91] = np.arange(97, 123)
_letter[128:] = np.arange(128, 256)

# What opens something hidden, and what ends it: a comment, an element with its content, a tag.
_OPENS = re.compile(rb"(?i)<(?:(!--)|(script|style|nav)\b)?")
_ENDS = {
    b"!--": re.compile(rb"-->"),
    b"": re.compile(rb">"),
    **{name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style", b"nav")},
}
_HTML_TAG = re.compile(rb"(?i)<html\b")
_LANG = re.compile(rb"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,8})")


def trigrams(text: bytes) -> np.ndarray:
    """How often each bucket of byte trigrams occurs; signs and digits are blanks, run together."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(text), SPAN):
        # Two bytes of the next span complete the trigrams of this one.
        x = _letter[np.frombuffer(text[at : at + SPAN + 2], dtype=np.uint8)]
        x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
        if len(x) > 2:
            code = (x[:-2] * 65536 + x[1:-1] * 256 + x[2:]) * 2654435761 % 4294967296
            counts += np.bincount(code >> (32 - 13), minlength=BUCKETS)
    return counts


def _without_markup(html: bytes) -> bytes:
    """Comments, scripts, styles, navigation and tags become a blank, in one pass.

    The next end of each kind is looked for once and remembered, so that openings
    without ends cost nothing more; such an opening is text, or the start of a tag.
    """
    kept: list[bytes] = []
    known: dict[bytes, re.Match | None] = {}
    text = at = 0
    while True:
        opening = _OPENS.search(html, at)
        if opening is None:
            break
        kind = (opening[1] or opening[2] or b"").lower()
        for name in dict.fromkeys((kind, b"")):
            start = opening.end() if name else opening.start() + 1
            if name not in known or (known[name] is not None and known[name].start() < start):
                known[name] = _ENDS[name].search(html, start)
            end = known[name]
            if end is not None:
                kept += [html[text : opening.start()], b" "]
                text = at = end.end()
                break
        else:
            at = opening.start() + 1
    return b"".join([*kept, html[text:]])


def visible(html: bytes) -> bytes:
    """The text of a page: without comments, scripts, styles, navigation and tags."""
    text = _without_markup(html).decode("utf-8", "replace")
    # Numbers of characters that nobody has are not read as numbers: they may be very long.
    text = re.sub(r"&#[0-9]{8,};?", "\ufffd", re.sub(r"&#0+(?=[0-9])", "&#", text))
    return unescape(text).encode("utf-8", "replace")


def declared_language(html: bytes) -> str | None:
    """The first part of the language that the html tag declares, in lower case."""
    at = 0
    while (tag := _HTML_TAG.search(html, at)) is not None:
        end = html.find(b">", tag.end())
        end = len(html) if end < 0 else end
        found = _LANG.search(html, tag.end(), end)
        if found:
            return found[1].lower().decode()
        at = end
    return None


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in parts:
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
            totals[lang] = totals.get(lang, 0) + trigrams(text)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.string()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.int64()))],
        ["lang", "counts"],
    )


def language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Log probabilities of the trigram buckets for each language of the documents.

    The driver gets one number for each language and bucket. Rows without a language
    are left out.
    """
    ship_code(docs.sparkSession)
    slim = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).where("lang is not null")
    counted = slim.mapInArrow(_counted, "lang string, counts array<long>")
    cells = counted.select("lang", F.posexplode("counts").alias("bucket", "n"))
    found: dict[str, np.ndarray] = {}
    for lang, bucket, n in cells.groupBy("lang", "bucket").agg(F.sum("n")).collect():
        found.setdefault(lang, np.zeros(BUCKETS))[bucket] = n
    return {k: np.log((v + 0.5) / (v.sum() + 0.5 * BUCKETS)) for k, v in sorted(found.items())}


def page_languages(
    pages: DataFrame,
    model: dict[str, np.ndarray],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    text_weight: int = 60,
    strength: float = 10.0,
) -> DataFrame:
    """One row per page: id, lang, score, text_lang, declared, host, suffix.

    ``score`` is the posterior of ``lang``. Trigrams of a text hang together, so that a
    text counts as one of at most ``text_weight`` of them. How often a language is
    declared as which, and the priors, come from all pages by their text's language,
    less the page's own vote; ``strength`` is the votes that a prior is worth. Null
    pages and addresses are empty and say nothing; a page that says nothing gets the
    most frequent language. A model without languages gives null. Repeated and null ids
    are rows like others; an empty table gives an empty result.
    """
    ship_code(pages.sparkSession)
    langs = list(model)
    host, _ = host_and_path(F.col("url"))
    slim = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    slim = slim.withColumn("host", host).select("id", "host", F.substring_index("host", ".", -1).alias("suffix"), "html")
    if not langs:
        nothing = {"lang": "string", "score": "double", "text_lang": "string", "declared": "string"}
        return slim.select("id", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), "host", "suffix")
    weights = pages.sparkSession.sparkContext.broadcast(np.array([model[k] for k in langs]))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            scores, declared = [], []
            for html in as_bytes(batch.column("html")):
                counts = trigrams(visible(html))
                n = counts.sum()
                scores.append((weights.value @ counts * (min(n, text_weight) / max(1, n))).tolist())
                declared.append(declared_language(html))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(scores, pa.list_(pa.float64())), pa.array(declared, pa.string())],
                ["id", "host", "suffix", "likelihoods", "declared"],
            )

    schema = widened(slim.drop("html"), "likelihoods array<double>, declared string")
    rows = numbered(slim.mapInArrow(read, schema), "page-languages")
    best = F.array_position("likelihoods", F.array_max("likelihoods")).cast("int")
    says = F.array_max("likelihoods") != F.array_min("likelihoods")
    rows = rows.withColumn("vote", F.when(says | F.lit(len(langs) == 1), best).otherwise(0))
    votes = F.array(*(F.sum((F.col("vote") == k + 1).cast("double")) for k in range(len(langs))))

    def lifted(df: DataFrame, key: str, name: str) -> DataFrame:
        """Each key's votes by language, beside its rows."""
        counts = written(rows.groupBy(key).agg(votes.alias(name)), "language-votes")
        return df.join(counts, key)

    # One number for each language goes to the driver.
    everyone = rows.agg(votes).first()[0] or [0.0] * len(langs)
    n_all = F.array(*(F.lit(float(n or 0)) for n in everyone))
    rows = rows.withColumn("n_all", n_all).withColumn("said", F.coalesce("declared", F.lit("")))
    for key, name in (("suffix", "n_suffix"), ("host", "n_host"), ("said", "n_said")):
        rows = lifted(rows, key, name)
    fused = []
    for k in range(len(langs)):
        own = (F.col("vote") == k + 1).cast("double")
        voted = (F.col("vote") > 0).cast("double")
        whole = lambda name: F.aggregate(name, F.lit(0.0), lambda x, y: x + y) - voted  # noqa: B023, E731
        share = lambda name, prior: (F.get(name, F.lit(k)) - own + strength * prior) / (whole(name) + strength)  # noqa: B023, E731
        of_all = share("n_all", F.lit(1 / len(langs)))
        of_host = share("n_host", share("n_suffix", of_all))
        # How much likelier the declaration is under this language than on the whole.
        of_said = share("n_said", of_all) / of_all
        fused.append(
            F.get("likelihoods", F.lit(k)) + F.log(of_host) + F.when(F.col("said") == "", 0.0).otherwise(F.log(of_said))
        )
    rows = rows.withColumn("fused", F.array(*fused))
    top = F.array_max("fused")
    name = F.array(*map(F.lit, langs))
    return rows.select(
        "id",
        F.get(name, (F.array_position("fused", top) - 1).cast("int")).alias("lang"),
        (1 / F.aggregate("fused", F.lit(0.0), lambda x, y: x + F.exp(y - top))).alias("score"),
        F.when(F.col("vote") > 0, F.get(name, F.col("vote") - 1)).alias("text_lang"),
        "declared",
        "host",
        "suffix",
    )
