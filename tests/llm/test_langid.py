from __future__ import annotations

import re
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from botica.llm import langid
from botica.llm.langid import BUCKETS, declared_language, language_model, page_languages, trigrams, visible

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language_model(spark.read.parquet(f"{SF}/documents.parquet"))


def test_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = page_languages(pages, model).collect()
    assert len(found) == pages.count()
    assert all(0 < r.score <= 1 + 1e-9 for r in found)
    assert np.mean([r.lang == r.declared for r in found]) > 0.97


def test_priors_decide_where_the_text_says_nothing(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 900").collect()}
    rows = [(k, f"http://a.example.fr/{k}", f"<p>{docs['fr']}</p>") for k in range(30)]
    rows += [(100 + k, f"http://b.example.com/{k}", f"<p>{docs['de']}</p>") for k in range(40)]
    rows += [
        (200, "http://a.example.fr/x", ""),
        (201, "http://c.example.fr/x", None),
        (202, "http://b.example.com/", "<html></html>"),
        (203, None, None),
        (None, "http://b.example.com/", "<p>"),
        (204, "http://a.example.fr/y", f"<html lang=de><p>{docs['es']}"),
    ]
    found = page_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    langs = {r.id: r.lang for r in found}
    assert len(found) == len(rows)
    assert (langs[200], langs[201], langs[202], langs[None]) == ("fr", "fr", "de", "de")
    assert langs[203] in ("de", "fr") and langs[204] == "es"
    assert {r.text_lang for r in found if r.id in (200, 203)} == {None}


def test_markup():
    html = b"<!-- <html lang=xx> --><HTML class='a' LANG = 'Pt-BR'><script>en</script><style>x</style><nav>n</nav>a&eacute;<b>c"
    assert visible(html).split() == ["aé".encode(), b"c"]
    assert declared_language(html.split(b"-->")[1]) == "pt"
    assert declared_language(b"<p lang=en>") is None


def test_trigrams_do_not_depend_on_spans(monkeypatch):
    from botica.llm import langid

    text = b"some words that are long enough to be cut in several places " * 5
    whole = trigrams(text)
    assert whole.sum() == len(text) - 2 and len(whole) == BUCKETS
    monkeypatch.setattr(langid, "SPAN", 16)
    assert (trigrams(text) == whole).all()


def test_nothing(spark, model, nothing):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_languages(empty, model).count() == 0
    assert language_model(nothing) == {}
    one = spark.createDataFrame([(1, "http://a.b/", "x")], "page_id long, url string, html string")
    assert page_languages(one, {}).collect()[0].lang is None


_SAME = re.compile(rb"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>")
_SAME_LANG = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,8})")
_PARTS = st.sampled_from([b"<", b">", b"<!--", b"-->", b"<script", b"</script", b"<NAV ", b"</nav>", b"<style>", b"</STYLE ",
                          b" ", b"a", b"<html", b" lang=", b"en", b"'", b"--", b"scripts"])


@given(st.lists(_PARTS, max_size=25))
def test_markup_is_cut_as_by_the_plain_expression(parts):
    html = b"".join(parts)
    assert langid._without_markup(html) == _SAME.sub(b" ", html)
    found = _SAME_LANG.search(html)
    assert langid.declared_language(html) == (found[1].lower().decode() if found else None)


@pytest.mark.parametrize(
    "piece", [b"<!--", b"<script ", b"<", b"<html ", b"<nav></na", b"&#9", b"<html lang", b"</script  ", b"<style>-->"]
)
def test_hostile_pages_take_seconds(piece):
    html = piece * (5_000_000 // len(piece))
    start = time.perf_counter()
    langid.visible(html)
    langid.declared_language(html)
    assert time.perf_counter() - start < 20


def test_character_numbers_of_any_length():
    assert langid.visible(b"&#0000000000065;&#" + b"9" * 10_000 + b";b") == "A\ufffdb".encode()
