import random
import textwrap

from weftgraph.llm import licenses


def prose(rng, n):
    text = ""
    while len(text) < n:
        text += "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) + " "
    return text


def test_sentences_inside_prose_lines():
    rng = random.Random(12)
    for name, texts in licenses.TEMPLATES.items():
        for template in texts:
            for n in (50, 100, 300):
                text = prose(rng, n) + template + " " + prose(rng, n)
                found = [f for f in licenses.scan(text) if f["license"] == name]
                assert [(text[f["start"] : f["end"]], f["verdict"]) for f in found] == [(template, "exact")], (n, template)


def test_every_match_of_a_line():
    text = "Code: Released under the MIT License. Texts: Licensed under CC BY 4.0. Maps: Licensed under CC BY-NC 4.0. Old code: Released under the MIT License."
    assert [f["license"] for f in licenses.scan(text)] == ["MIT", "CC-BY-4.0", "CC-BY-NC-4.0", "MIT"]


def test_wrapped_notices():
    for name, texts in licenses.TEMPLATES.items():
        for template in texts:
            for width in (40, 60, 78):
                for mark in ("", " * ", "# "):
                    text = "First prose.\n" + "\n".join(mark + x for x in textwrap.wrap(template, width)) + "\nMore prose.\n"
                    found = licenses.scan(text)
                    assert (name, "exact") in [(f["license"], f["verdict"]) for f in found] and {f["license"] for f in found} == {name}, (template, width)


def test_a_sentence_amid_repeated_words_and_in_a_long_block():
    for head in ("haesst " * 200, "Copyright of the text. " * 300):
        assert [f["license"] for f in licenses.scan(head + "\nReleased under the MIT License.\n" + head)] == ["MIT"]


def looked_for(monkeypatch, text, least=licenses.LEAST_REDUCTION):
    """The findings of a text, and how many templates were looked for by their words in its blocks."""
    seen, places = [], licenses.places
    with monkeypatch.context() as m:
        m.setattr(licenses, "LEAST_REDUCTION", least)
        m.setattr(licenses, "places", lambda template, *rest: seen.append(template) or places(template, *rest))
        licenses.judge.cache_clear()
        found = licenses.scan(text)
    licenses.judge.cache_clear()
    return found, len(seen)


def test_compression_chooses_the_templates_that_are_looked_for(monkeypatch):
    rng = random.Random(5)
    every = sum(map(len, licenses.TEMPLATES.values()))
    for text in ("He had a driving license and no copyright at all.", prose(rng, 900) + "copyright " + prose(rng, 900), "cc by", "spdx"):
        assert looked_for(monkeypatch, text) == ([], 0)
        assert looked_for(monkeypatch, text, least=-99) == ([], every)
    found, n = looked_for(monkeypatch, prose(rng, 300) + "Released under the MIT License. " + prose(rng, 300))
    assert [f["license"] for f in found] == ["MIT"] and 0 < n < every / 2


def changed(rng, words, most):
    """The words with as many differences as a variant may have."""
    words = list(words)
    for _ in range(most):
        at = rng.choice([i for i, w in enumerate(words) if w not in licenses.TELLING and 0 < i < len(words) - 1])
        if rng.random() < 0.6:
            del words[at]
        else:
            words.insert(at, "".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 9, 400)))))
    return words


def test_compression_loses_no_variant(monkeypatch):
    rng = random.Random(6)
    variants = 0
    for texts in licenses.TEMPLATES.values():
        for template in texts:
            words = licenses.words_of(template)
            for n in (0, 800):
                other = licenses.words_of(rng.choice(rng.choice(list(licenses.TEMPLATES.values()))))
                text = prose(rng, n) + " ".join([*other, *changed(rng, words, int(licenses.MOST_DIFFERENT * len(words)))]) + " " + prose(rng, n)
                found, _ = looked_for(monkeypatch, text)
                assert found == looked_for(monkeypatch, text, least=-99)[0], text
                variants += any(f["verdict"] == "variant" for f in found)
    assert variants > 30


def test_long_words_between_a_licenses_words():
    rng = random.Random(7)
    words = licenses.TEMPLATES["MIT"][-1].split()
    for i in range(60, 0, -6):
        words.insert(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(600)))
    for far in ("", " " + "x" * 20_000_000):
        found = licenses.scan(" ".join(words) + far)
        assert [(f["license"], f["verdict"], f["differences"]) for f in found] == [("MIT", "variant", 10)]
