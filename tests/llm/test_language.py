import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import groupby, product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import language
from headway.llm.language import Model, best_labels, language_spans, predict, read_words, train

FOLDER = "/root/testdata/sf0.01"


def cost(labels, scores, switch):
    return sum(s[k] for s, k in zip(scores, labels, strict=True)) - switch * sum(a != b for a, b in zip(labels, labels[1:], strict=False))


def test_labels_are_the_best_of_all(monkeypatch):
    monkeypatch.setattr(language, "CHUNK", 3)
    rng = np.random.default_rng(1)
    sizes = [0, 1, 7, 3, 6, 0, 5]
    scores = rng.normal(0, 2, (sum(sizes), 3))
    labels, at = best_labels(scores, np.array(sizes), 1.5), 0
    for n in sizes:
        own = scores[at : at + n]
        best = max((cost(p, own, 1.5) for p in product(range(3), repeat=n)), default=0)
        assert cost(labels[at : at + n].tolist(), own, 1.5) == pytest.approx(best)
        at += n


def test_words_and_their_places():
    texts = ["Ab  cd.", None, "", "1 2", "é-ß", "x" * 10]
    words = read_words(texts)
    assert words.per_text.tolist() == [2, 0, 0, 0, 2, 1]
    got = [texts[t][a:b] for t, a, b in zip(np.repeat(np.arange(6), words.per_text), words.start, words.end, strict=True)]
    assert got == ["Ab", "cd", "é", "ß", "x" * 10] and len(words.trigrams) == sum(map(len, got))
    # A word's trigrams depend neither on its case nor on its neighbours.
    again = read_words(["zz AB"])
    assert again.trigrams[2:].tolist() == words.trigrams[:2].tolist()


def test_scripts_narrow_candidates_and_spans_follow_languages(documents):
    greek, latin, cyrillic = "αυτό είναι ένα κείμενο", "this is a text of words", "это простой текст слов"
    rows = [(i, t, n) for i, (t, n) in enumerate([(greek, "el"), (latin, "en"), (cyrillic, "ru")] * 20)]
    model = train(documents(rows))
    assert model.languages == ["el", "en", "ru"]
    mixed = f"{latin}, {greek}; {cyrillic} 漢字"
    spans = language_spans(documents([(1, mixed), (2, None), (3, "12")]), model).orderBy("start").collect()
    assert [mixed[s["start"] : s["start"] + s["length"]] for s in spans[:2]] == [latin, greek]
    assert [s["lang"] for s in spans[:3]] == ["en", "el", "ru"]
    words = read_words([greek])
    assert (model.word_scores(words)[:, [1, 2]] < -1e5).all()


def test_messy_rows_and_no_rows(messy, documents):
    model = train(documents([(0, "the words", "en"), (1, "les mots", "fr"), (3, None, "de"), (4, "x", None)] * 3))
    assert set(model.languages) <= {"en", "fr"}
    rows = predict(messy, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert {by_id[i]["lang_pred"] for i in (2, 3, 4)} == {"und"} and by_id[2]["score"] == 0
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert predict(documents([(1, "\u0301 \u0302")]), model).first()["lang_pred"] == "und"  # marks, but no letter
    nothing = train(documents([]))
    assert nothing.languages == [] and {r["lang_pred"] for r in predict(messy, nothing).collect()} == {"und"}
    assert predict(documents([]), model).count() == 0


def test_held_out_rows_and_other_columns_do_not_teach(documents):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert train(documents([(held, "abc", "xx")])).languages == []


def plain_words(text):
    """(word, lower case) runs of letters and marks."""
    for inside, run in groupby(text or "", key=lambda c: unicodedata.category(c)[0] in "LM"):
        if inside:
            yield "".join(run).lower()


def plain_trigrams(word):
    bounded = f"\n{word}\n"
    return [bounded[i : i + 3] for i in range(len(word))]


def plain_script(letter):
    return next((n for n, a, b in language.SCRIPTS if a <= ord(letter) <= b), "other")


def plain_predict(taught, texts):
    """(language, score) of each text by plain counts of trigrams and the Viterbi recursion word by word."""
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for text, lang in taught:
        for word in plain_words(text):
            counts[lang].update(plain_trigrams(word))
            scripts[lang][plain_script(word[0])] += len(word)
    langs = sorted(counts)
    uses = {x: {s for s, n in scripts[x].items() if n >= language.SCRIPT_SHARE * scripts[x].total()} for x in langs}

    def score(word, lang):
        whole = counts[lang].total() + language.SMOOTHING * language.BUCKETS
        return sum(math.log((counts[lang][t] + language.SMOOTHING) / whole) for t in plain_trigrams(word))

    found = []
    for text in texts:
        words = list(plain_words(text))
        best = {x: (0.0, ()) for x in langs}
        for word in words:
            allowed = [x for x in langs if plain_script(word[0]) in uses[x]] or langs
            before, best = best, {}
            for x in allowed:
                total, path = max((t - language.SWITCH * (bool(p) and p[-1] != x), p) for t, p in before.values())
                best[x] = total + score(word, x), (*path, x)
        letters = Counter()
        for word, lang in zip(words, max(best.values())[1] if words else (), strict=True):
            letters[lang] += len(word)
        most = max(letters, key=lambda x: (letters[x], -langs.index(x)), default=language.UNKNOWN)
        found.append((most, letters[most] / letters.total() if letters else 0.0))
    return found


def test_training_and_prediction_against_plain_python(documents):
    """Languages and scores, with mixed texts, scripts that rule languages out, and words of no known script."""
    samples = {
        "en": ["the cat sat on the mat and looked at the moon", "there was a house near the old river", "We thank them"],
        "fr": ["le chat dort sur la table et regarde la lune", "il y avait une maison près de la rivière", "Merci à tous"],
        "el": ["αυτό είναι ένα κείμενο", "η γάτα κοιτάζει το φεγγάρι"],
        "ru": ["кошка смотрит на луну", "это простой текст"],
    }
    rng = np.random.default_rng(8)
    vocabulary = {x: " ".join(own).split() for x, own in samples.items()}
    rows = []
    for i in range(160):
        langs = rng.choice(sorted(vocabulary), rng.integers(1, 4))
        parts = [" ".join(rng.choice(vocabulary[x], rng.integers(1, 12))) for x in langs]
        rows.append((i, "; ".join(parts), str(langs[0]) if len(langs) == 1 else None))
    rows += [(200, "漢字 the cat", None), (201, "漢字", None), (202, "12 34", None), (203, None, None)]
    table = documents(rows)
    taught = [(t, x) for i, t, x in rows if t and x and zlib.crc32(str(i).encode()) % 4 != 2]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(table, train(table)).collect()}
    for (i, _, _), (lang, score) in zip(rows, plain_predict(taught, [t for _, t, _ in rows]), strict=True):
        assert got[i] == (lang, pytest.approx(score)), i


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not there")
def test_held_out_accuracy(spark, documents):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = predict(table, train(table)).where("held_out").join(table.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_one_long_text_is_labelled_whole():
    model = Model(["a", "b"], np.zeros((language.BUCKETS, 2), dtype=np.float32), np.ones((2, len(language.SCRIPT_NAMES)), dtype=bool))
    words = read_words(["ab " * 100_000])
    assert len(best_labels(model.word_scores(words), words.per_text)) == 100_000
