"""Garbled text: every transformation is applied to known clean texts, and must be found and undone."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import garble as g

SENTENCES = {
    "fr": "Où la première propriété détermine déjà la régulière équation à {n} près . D'après ce qui précède , la fréquence était très élevée .",
    "de": "Außerdem erklärt die größere Fläche den Körper {n} während der Abkühlung . Schließlich wählen wir die mögliche Lösung für Übergänge .",
    "pl": "Jeśli gęstość źródła jest większa , rozwiązanie łączy ciągła całka {n} z przejściem . Każda średnia gdyż określa właściwość .",
    "ru": "Пусть уравнение определяет плотность {n} . Заметим , что решение ограничивает поле при всех шагах . Каждое описывает новое случайное явление .",
    "pt": "Então a equação não é única : a função {n} está em SÃO PAULO . A CONCLUSÃO das MEDIÇÕES é só uma aproximação mínima .",
    "en": "The naïve façade — “quoted” ‘words’ cost €{n} ± 3 °C → done ✓ 🎉 … 波動 ½ isn’t it ? Ångström , Øresund and Žižvar agree .",
}
READS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251")]
PAIRS = {"fr": [("cp1252", "cp1251")], "de": [("cp1252", "cp1251")], "pl": [("iso8859-2", "latin-1"), ("cp1250", "cp1252")], "ru": [("cp1251", "latin-1"), ("koi8-r", "cp1251")], "pt": [], "en": []}


def misread(text, written, read):
    """Bytes of `written` read as `read`; None if not every character can be written."""
    try:
        data = text.encode(written)
    except UnicodeEncodeError:
        return None
    back = {b: c for c, b in g.reading(read).items()}
    return "".join(back.get(b, chr(b)) for b in data)


def clean_text(lang, n, rng):
    words = SENTENCES[lang].format(n=n).split(" ")
    return f"\\section{{Part {n}}}\n" + " ".join(words[: rng.randint(12, len(words))]) + f"\nplain tail number {n} of this text\n"


def corpus():
    rng = random.Random(4)
    docs, bad, originals = [], set(), {}
    for i in range(300):
        lang = list(SENTENCES)[i % len(SENTENCES)]
        docs.append((i, clean_text(lang, i, rng)))
    i = 1000
    for lang in SENTENCES:
        for written, read in READS + PAIRS[lang]:
            for _ in range(2):
                whole = clean_text(lang, i, rng)
                lines = whole.split("\n")
                text = misread(lines[1], written, read)
                if text is not None and text != lines[1]:
                    docs.append((i, "\n".join([lines[0], text, lines[2]])))
                    originals[i] = "\n".join(lines[:3])
                    bad.add(i)
                i += 1
    twice = misread(misread(SENTENCES["fr"], "utf-8", "cp1252"), "utf-8", "cp1252")
    docs += [(2000, twice), (2001, "fun��o"), (2002, "x\x93y\x94"), (2003, None), (2004, ""), (2005, "plain"), (2006, "ÂGE ÇÃ É” Рёбра «Группа В» m³ 5µm ¿Qué?")]
    return docs, bad | {2000, 2001, 2002}, originals | {2000: SENTENCES["fr"]}


@pytest.fixture(scope="module")
def found(spark):
    docs, bad, originals = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("cell", F.lit("clash")).withColumn("fixes", F.lit(1))
    got = g.garbled(df).persist()
    return df, got, docs, bad, originals


def test_found_and_nothing_else(found):
    _, got, _, bad, _ = found
    assert {r["doc_id"] for r in got.collect()} == bad


def test_restored(found):
    df, got, _, _, originals = found
    texts = {r["doc_id"]: r["text"] for r in g.restore(df, got).collect()}
    right = sum(texts.get(i, "").rstrip("\n") == t.rstrip("\n") for i, t in originals.items())
    assert right >= 0.8 * len(originals)
    assert texts[2001] == "fun��o"


def test_empty_and_repeats(spark):
    assert g.garbled(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a�b"), (1, "a�b"), (2, "clean é")], "doc_id long, text string")
    assert [r["doc_id"] for r in g.garbled(twice).collect()] == [1]


def test_many_copies_of_a_garbled_text(spark):
    rng = random.Random(9)
    clean = [(i, clean_text("ru", i, rng)) for i in range(12)]
    bad = misread(SENTENCES["ru"].format(n=5), "koi8-r", "cp1251")
    rows = clean + [(100 + i, bad) for i in range(60)]
    got = g.garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {100 + i for i in range(60)}


VARIANTS = {
    ("koi8-r", "cp1251"): ("ru", "кошка видит старую лампу возле широкого окна"),
    ("cp1251", "latin-1"): ("ru", "кошка видит старую лампу возле широкого окна"),
    ("cp1250", "cp1252"): ("pl", "mała żółta łódź płynęła całą długą wąską rzeką"),
    ("cp1252", "cp1251"): ("fr", "l'été dernier mon frère aîné a préféré la forêt"),
}


@pytest.mark.parametrize(("written", "read"), list(VARIANTS))
def test_variants_of_one_text_do_not_outvote_its_clean_words(spark, written, read):
    """A group of near-copies (revised, reflowed, cut) shares a garbled passage; a few clean texts have its words."""
    rng = random.Random(5)
    lang, passage = VARIANTS[written, read]
    words = passage.split()
    clean = []
    for i in range(8):
        rng.shuffle(words)
        clean.append((i, f"{clean_text(lang, i, rng)}\n{' '.join(words)}, text {i}"))
    rest = clean_text(lang, 77, rng).split() + "some plain words that follow the passage in all of the copies".split()
    group = []
    for i in range(80):
        own = list(rest)
        own[rng.randrange(len(own))] = f"revised{i}"
        own = own[: rng.randint(len(own) - 6, len(own))]
        bad = misread(passage, written, read).split()
        if i % 2:
            bad[rng.randrange(len(bad))] = f"changed{i}"
        text = own[:9] + bad + own[9:]
        width = rng.randint(5, 12)
        group.append((100 + i, "\n".join(" ".join(text[k : k + width]) for k in range(0, len(text), width))))
    df = spark.createDataFrame(clean + group, "doc_id long, text string")
    got = g.garbled(df).persist()
    assert {r["doc_id"] for r in got.collect()} == {i for i, _ in group}
    texts = [r["text"].split() for r in g.restore(df, got).collect()]
    kept = [len(set(passage.split()) & set(t)) for t in texts]
    assert min(kept) >= len(passage.split()) - 3


def test_undo_and_infer():
    assert g.undo("Ã©tÃ©", "cp1252", "utf-8") == ("été", 2, 0)
    assert g.undo("“Ã©", "cp1252", "utf-8") == ("“é", 1, 1)
    assert g.undo("SÃO", "cp1252", "utf-8") is None
    assert g.undo("РТЙ", "cp1251", "koi8-r") == ("при", 3, 0)
    assert ("cp1252", "utf-8") in g.infer("ÃƒÂ©", "é") and ("cp1251", "cp1252") in g.infer("aprиs", "après")
    assert [g.strange(x) for x in ("пример", "Пример", "РТЙНЕТ", "рТЙНЕТ", "ïðèìåð", "d’État", "s³aba", "naïve")] == [0, 0, 1, 2, 2, 0, 2, 0]
    assert g.odd("aprиs") and g.odd("s³aba") and not g.odd("naïve") and not g.odd("“word”") and not g.odd("теорема")


def test_align():
    assert g.align("aprиs dйjа", "après déjà") == [("и", "è"), ("й", "é"), ("а", "à")]
    assert g.align("Ã©tÃ©â€”x", "été—x") == [("Ã©", "é"), ("Ã©", "é"), ("â€”", "—")]
    assert g.align("ÃƒÂ©", "é") == [("ÃƒÂ©", "é")] and g.align("aé", "éa") is None and g.align("éèà", "éè") is None


def test_a_transformation_outside_the_list_is_learned_from_twins(spark):
    sign = str.maketrans({"é": "§", "è": "¶"})
    rng = random.Random(8)
    clean = [(i, clean_text("fr", i, rng)) for i in range(60)]
    twins = [(100 + i, clean[i][1].translate(sign)) for i in range(8)]
    alone = {200 + i: clean_text("fr", 200 + i, rng) for i in range(8)}
    df = spark.createDataFrame(clean + twins + [(i, t.translate(sign)) for i, t in alone.items()], "doc_id long, text string")
    for twins_only in (True, False):
        got = g.garbled(df, twins_only=twins_only).persist()
        assert {r["doc_id"] for r in got.collect()} == {100 + i for i in range(8)} | set(alone)
    texts = {r["doc_id"]: r["text"] for r in g.restore(df, got).collect()}
    assert all(texts[i] == t for i, t in alone.items())
