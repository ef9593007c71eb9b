"""Languages without a cut by rank."""

import random

import pytest

from tidemark.llm import language


@pytest.mark.parametrize("block", [64, 7])
def test_rare_languages_are_told_apart(spark, monkeypatch, block):
    """With 90 declared languages, the rarest ones are found in texts that declare nothing."""
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(6)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(25)] for k in range(90)}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(80))
    rows = [(100 * k + i, text(lang), lang, None) for k, lang in enumerate(words) for i in range(4 if k < 70 else 2)]
    rows += [(100_000 + k, text(lang), None, None) for k, lang in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(language.from_documents(docs)).collect()}
    assert len(got) == len(rows)
    for k, lang in enumerate(words):
        assert got[100 * k].lang == got[100_000 + k].lang == got[100_000 + k].text_lang == lang and got[100_000 + k].accepted
