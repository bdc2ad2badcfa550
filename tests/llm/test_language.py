import os

import numpy as np
import pytest

from symbolmill.llm.language import BITS, LANGUAGES, fit, grams, label_of, languages, paragraphs, prose, scores

TEXTS = {
    "en": "There is no need to restart the server after this change because nobody remembers the old one.",
    "de": "Der Fehler trat nur auf, wenn zwei Pfade gleich lang waren und niemand etwas davon wusste.",
    "fr": "Personne ne sait pourquoi cette fonction existe, mais il ne faut pas la supprimer pour le moment.",
    "es": "Nadie recuerda por qué se añadió esta función, pero no hace falta reiniciar el servidor.",
    "pt": "Não é preciso reiniciar o servidor depois desta mudança, mas ninguém sabe o porquê disso.",
    "it": "Nessuno ricorda perché è stata aggiunta questa funzione, ma non serve riavviare il servizio.",
    "nl": "Niemand weet waarom deze functie is toegevoegd, maar de server hoeft niet opnieuw gestart te worden.",
    "ru": "Никто не помнит, зачем добавили эту функцию, но перезапускать сервер не нужно.",
    "zh": "没有人记得为什么要加入这个函数，但是修改之后不需要重新启动服务器。",
}


def test_labels_and_prose():
    assert [label_of(x) for x in ("en_GB", "Deutsch", "fra", "French", " ZH-cn", None, "", "und", "UNKNOWN", "ja")] == ["en", "?", "fr", "fr", "zh", None, None, None, None, "?"]
    text = "a\n\n \t\nb\nc\r\n\r\n```py\nx = 1\n\ny = 2\n```\n\nend"
    assert list(paragraphs(text)) == [(1, "a"), (2, "b\nc"), (3, "\n"), (4, "\n"), (5, "end")]
    assert prose("See `foo bar` in src/a_b.py: loadQueue works, v1.2!")[0] == "see in works"
    assert prose("索引为空") == ("索引为空", 12)
    assert prose("    at foo (a/b.js:1:2)\n[10:11:12] x.y(z.ts:3)\nfoo_bar 12 ab12 0.1")[1] == 0


def test_scores_are_the_kernel_machine():
    w = np.random.default_rng(0).normal(size=(1 << BITS, 9)).astype(np.float32)
    texts = ["abab", "", "xyz zzz", "中文"]
    got = scores(w, texts)
    for t, row in zip(texts, got):
        flat, cuts = grams([t])
        assert len(set(flat)) == len(flat)
        assert np.allclose(row, w[flat].sum(axis=0) / np.sqrt(max(len(flat), 1)), atol=1e-4)


def test_held_out():
    docs = [(k, s) for k, t in TEXTS.items() for s in (t.lower(), t.lower()[: len(t) // 2])]
    w = fit([s for _, s in docs], [k for k, _ in docs])
    halves = [t.lower()[len(t) // 2 :] for t in TEXTS.values()]
    assert [LANGUAGES[i] for i in scores(w, halves).argmax(axis=1)] == list(TEXTS)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_documents(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [(10_000_000 + i, t, "xx") for i, t in enumerate(TEXTS.values())]
    rows += [(20_000_000, TEXTS["de"] + "\n\n" + TEXTS["de"] + "\n\n" + TEXTS["fr"], "DE"), (20_000_001, None, "de"), (20_000_002, "", None), (20_000_003, "```\nx\n```", "en"), (20_000_004, " \n ", None), (20_000_005, TEXTS["en"], None)]
    df = base.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).selectExpr("*", "1 as segment", "2 as letters")
    got = [r for r in languages(df, cases_only=True).collect()]
    mine = sorted((r["doc_id"], r["segment"], r["lang"]) for r in got if r["doc_id"] >= 10_000_000)
    assert mine == [(10_000_000 + i, 0, k) for i, k in enumerate(TEXTS)] + [(20_000_000, 3, "fr"), (20_000_005, 0, "en")]
    assert all(0 < r["confidence"] <= 1 for r in got)
    assert languages(df.filter("false")).count() == 0
