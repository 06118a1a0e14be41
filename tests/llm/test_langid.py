import os

import numpy as np
import pytest

from gridloom.llm import langid as G
from gridloom.llm.prose import prose, sentences

SAMPLES = "/root/testdata/sf0.01/lang_samples.parquet"
EN = "the meter stops after the reset and the log shows nothing useful to me at all today. "
DE = "der Zähler bleibt nach dem Neustart stehen und im Protokoll steht leider gar nichts dazu. "


def test_labels():
    for s in ("de", "DE", "de-AT", "de_DE", "deu", "German", " ger ", "de\tAT", "\tGerman\n"):
        assert G.label_code(s) == "de"
    for s in (None, "", "und", "unknown", "xx"):
        assert G.label_code(s) is None


def slow_bits(samples, text, order):
    """Code length by definition: from the longest known context down, byte by byte."""
    langs = sorted({a for a, _ in samples})
    out = []
    for lang in langs:
        texts = [G.normal(t) for a, t in samples if a == lang]
        data = b" " + b" ".join(v.encode() for v in dict.fromkeys([*texts, *(G.without_accents(t) for t in texts)])) + b" "
        count = {}
        for k in range(order + 1):
            for i in range(k, len(data)):
                ctx = count.setdefault(data[i - k : i], {})
                ctx[data[i]] = ctx.get(data[i], 0) + 1
        total, b = 0.0, b" " + G.normal(text).encode()
        for i in range(1, len(b)):
            for k in range(min(order, i), -1, -1):
                seen = count.get(b[i - k : i], {})
                n = sum(seen.values())
                if b[i] in seen:
                    total -= np.log2((2 * seen[b[i]] - 1) / (2 * n))
                    break
                if n:
                    total -= np.log2(len(seen) / (2 * n))
            else:
                total += 8.0
        out.append(total)
    return out


@pytest.mark.parametrize("text", ["the reset", "Zähler", "ж я", "", "quite other words 123"])
def test_code_lengths_are_those_of_the_definition(text):
    samples = [("en", EN), ("de", DE), ("en", "a meter")]
    for order in (0, 2, 4):
        got = G.FrozenPPM(samples, order).code_lengths([text, "x", text])
        assert G.FrozenPPM(samples, order).code_lengths([text]).shape == (1, 2)
        assert got[0] == pytest.approx(slow_bits(samples, text, order), abs=1e-3) and got[2] == pytest.approx(got[0], abs=1e-3)
        after = G.FrozenPPM(samples, order).code_lengths([EN, "n", text])
        assert after[2] == pytest.approx(got[0], abs=1e-3)  # no context reaches into another text


def test_prose_only():
    text = "Hello there, my friend.\n```\nselect the one and only\n```\nSee https://a.b/c?x=1 for it! <pre><code>\nnot this\n</code></pre>\n    indented words stay out\nx_y = f(z)\nLast line"
    assert [text[a:b].strip() for a, b in sentences(text)] == ["Hello there, my friend.", "See https://a.b/c?x=1 for it!", "Last line"]
    clean, spans = prose(text)
    assert len(clean) == len(text) and "http" not in clean and not any("http" in clean[a:b] for a, b in spans)
    assert sentences(None) == sentences("") == sentences(" \n ") == [] and sentences("a_b(c)\n") == []


@pytest.mark.skipif(not os.path.exists(SAMPLES), reason="checked samples not here")
def test_held_out_accuracy():
    import pandas as pd

    s = pd.read_parquet(SAMPLES)
    train, test = s[s.sample_id % 3 > 0], s[s.sample_id % 3 == 0]
    model = G.FrozenPPM(list(zip(train.lang, train.text)))
    best = [model.langs[k] for k in model.code_lengths(test.text.tolist()).argmin(axis=1)]
    assert np.mean([a == b for a, b in zip(best, test.lang)]) >= 0.97


def test_segments_and_found(spark):
    samples = spark.createDataFrame([("en", EN * 3), ("de", DE * 3), ("xx", "zzz"), (None, "a")], "lang string, text string")
    rows = [(1, EN + EN, "en", 0), (2, EN + "\n\n" + DE + DE, "English", 0), (3, DE, "en", 0), (4, DE + EN, None, 0), (5, None, "en", 0), (6, " ", "", 0), (7, "```\ncode only\n```", "und", 0), (8, EN + DE[:30], "en-GB", 0), (1, EN, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, words bigint")
    model = G.train(samples)
    segments = G.language_segments(docs, model, lang="lang")
    got = {(r["doc_id"], r["segment"]): r for r in segments.collect()}
    assert got[2, 0]["language"] == "en" and got[2, 1]["language"] == "de" and got[2, 1]["confidence"] > 0.9
    assert all(d not in (5, 6, 7) for d, _ in got)
    found = {(r["doc_id"], r["found_lang"]) for r in G.unnamed_languages(segments).collect()}
    assert found == {(2, "de"), (3, "de"), (4, "de"), (4, "en")}
    assert {r["doc_id"]: r["language"] for r in G.document_languages(segments).collect()}[2] == "de"
    empty = docs.limit(0)
    assert G.language_segments(empty, model).count() == 0 and G.unnamed_languages(G.language_segments(empty, model)).count() == 0
    assert {r["found_lang"] for r in G.unnamed_languages(G.language_segments(docs.filter("doc_id = 1"), model)).collect()} == {"en"}  # no label column names nothing
    none = G.train(samples.limit(0), docs)
    assert none.langs == [] and G.language_segments(docs, none, lang="lang").count() == 0
    again = G.train(samples, docs)
    assert again.langs == ["de", "en"]


def test_look_up():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**48, 5000).astype(np.uint64))
    wanted = np.concatenate([keys[::3], rng.integers(0, 2**48, 3000).astype(np.uint64), np.arange(300, dtype=np.uint64)])
    place = {int(k): i for i, k in enumerate(keys)}
    assert G._Slots(keys).find(wanted).tolist() == [place.get(int(k), -1) for k in wanted]


@pytest.mark.skipif(not os.path.exists(SAMPLES), reason="checked samples not here")
def test_links_are_no_words_and_sentences_are_divided(spark):
    samples = spark.read.parquet(SAMPLES)
    model = G.train(samples)
    link = " https://example.org/sv/det/var/en/gang?och=inte&som=den "
    de = "Leider bleibt der Zähler nach dem Neustart stehen" + link * 6
    en22 = "the pump in the cellar has stopped again although I replaced the fuse and the cable last week and checked every valve twice"
    de22 = "deshalb habe ich heute noch einmal alle Leitungen geprüft und dabei gesehen dass die Sicherung im Keller schon wieder durchgebrannt ist"
    short = "the pump in the cellar has stopped again although der Zähler steht still I replaced the fuse and the cable last week"
    rows = [(1, de, "de"), (2, f"{en22}, {de22}.", "de"), (3, f"{en22}, {de22}.", None), (4, short, "en"), (5, f"\u00b4{en22}\u200b {de22} \u00a8", "de")]
    segments = G.language_segments(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model, lang="lang")
    assert {(r["doc_id"], r["found_lang"]) for r in G.unnamed_languages(segments).collect()} == {(2, "en"), (3, "en"), (3, "de"), (5, "en")}
    by = {}
    for r in segments.orderBy("doc_id", "segment").collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["words"] == 8
    text = rows[1][1]
    assert [(r["language"], text[r["start"] : r["stop"]].strip(" ,.")) for r in by[2]] == [("en", en22), ("de", de22)]
