import random

import pandas as pd
import pytest

from waymill.llm import spam
from waymill.session import Scratch

PHRASES = ["truck map", "download map", "cheap fuel card", "truck gps", "mod pack free", "new map update", "convoy server"]


def sentence(r):
    place = lambda: r.choice(["Nor", "Sel", "Gar", "Bel", "Tor"]) + r.choice(["wick", "ham", "ville", "by", "mouth"])
    return r.choice(
        [
            f"The road from {place()} to {place()} runs {r.randint(2, 400)} km and passes a depot near {place()}.",
            f"My co-driver told us that the bridge in {place()} had no light for {r.randint(2, 90)} days.",
            f"If you reach {place()} before noon, keep left at the mill and turn after the second gate.",
            f"Has anyone found the old way behind the yard in {place()}?",
        ]
    )


def pages(seed=1):
    r = random.Random(seed)
    good = [" ".join(sentence(r) for _ in range(r.randint(3, 30))) for _ in range(300)]
    bad = {
        "phrases": ", ".join(r.choice(PHRASES) for _ in range(60)),
        "soup": " ".join(r.choice(PHRASES).split()[0] for _ in range(150)),
        "links": "\n".join(f"https://a{i}.example/mod/{r.randint(1, 999)}" for i in range(40)),
        "anchors": "\n".join(f'<a href="https://a{i}.example/p">{r.choice(PHRASES)}</a>' for i in range(40)),
        "tags": " ".join("#" + r.choice(PHRASES).replace(" ", "") for _ in range(60)),
        "products": "\n".join(f"Norwick Mills {r.choice(PHRASES)} SKU{r.randint(100, 9999)} {r.randint(1, 300)}.50 EUR" for _ in range(30)),
        "mostly": sentence(r) + "\n" + ", ".join(r.choice(PHRASES) for _ in range(60)),
    }
    fine = {
        "timetable": "Norwick exits\n" + "\n".join(f"{r.randint(0, 23):02}:{r.randint(0, 59):02}  Norwick - Selham  {r.randint(20, 600)} min" for _ in range(30)),
        "definition": "SiiNunit\n{\n" + "\n".join(f'ferry_data : ferry.x{i} {{\n ferry_name: "X{i}"\n transit: {i}\n}}' for i in range(20)) + "\n}",
        "linked": "\n".join(f"[Gate {i}](https://atlas.example/{i}): {sentence(r)} {sentence(r)}" for i in range(20)),
        "few": " ".join(sentence(r) for _ in range(30)) + "\nTags: truck map, Norwick",
        "tiny": "ok",
    }
    return good, bad, fine


def test_pages(spark):
    good, bad, fine = pages()
    rows, names = [], {}
    for name, text in [*((f"good{i}", t) for i, t in enumerate(good)), *bad.items(), *fine.items()]:
        names[len(rows)] = name
        rows.append((len(rows), text, "en"))
    rows += [(len(rows), None, None), (len(rows) + 1, "", "xx"), (None, bad["soup"], "en")]
    found = spam.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).filter("spam_words * 2 > words").collect()
    assert {names[r.doc_id] for r in found} == set(bad)


#: Ordinary texts in languages that the corpus doesn't hold.
UNLISTED = {
    "tr": "Bu yol eski köprünün yanından geçer ve nehre kadar uzanır. Sürücüler akşam saatlerinde burada durmayı sever. Kasabanın girişinde küçük bir fırın vardır. Yağmur yağdığında tünelin önünde uzun bir kuyruk oluşur. Depo sabah altıda açılır, ama kapıda kimse beklemez.",
    "fi": "Tie kulkee vanhan sillan ohi ja jatkuu joelle asti. Kuljettajat pysähtyvät mielellään täällä iltaisin. Kylän laidalla on pieni leipomo, joka avataan aikaisin. Sateella tunnelin eteen syntyy pitkä jono. Varasto avataan kuudelta, mutta kukaan ei odota portilla.",
    "nl": "De weg loopt langs de oude brug en gaat verder tot aan de rivier. Chauffeurs stoppen hier graag in de avond. Aan de rand van het dorp staat een kleine bakkerij. Als het regent ontstaat er voor de tunnel een lange rij. Het depot gaat om zes uur open, maar niemand wacht bij de poort.",
    "it": "La strada passa accanto al vecchio ponte e arriva fino al fiume. Gli autisti si fermano volentieri qui di sera. Ai margini del paese si trova un piccolo forno. Quando piove si forma una lunga coda davanti alla galleria. Il deposito apre alle sei, ma nessuno aspetta al cancello.",
    "pt": "A estrada passa junto da ponte velha e segue até ao rio. Os motoristas gostam de parar aqui ao fim da tarde. À entrada da aldeia fica uma pequena padaria. Quando chove forma-se uma longa fila diante do túnel. O armazém abre às seis, mas ninguém espera ao portão.",
    "sv": "Vägen går förbi den gamla bron och fortsätter ända till floden. Förarna stannar gärna här på kvällen. I utkanten av byn ligger ett litet bageri. När det regnar bildas en lång kö framför tunneln. Lagret öppnar klockan sex, men ingen väntar vid grinden.",
}


def test_ordinary_pages_in_other_languages(spark):
    """They aren't flagged whatever `lang` says, and stuffed pages in them are."""
    good, _, _ = pages(3)
    rows = [(i, t, "en") for i, t in enumerate(good)]
    rows += [(1000 + 10 * i + j, f"{text} {text[:90]}" if j else text, named) for i, (code, text) in enumerate(UNLISTED.items()) for j, named in enumerate((code, None, "en"))]
    rows.append((2000, " ".join(["nakliye yazılımı ucuz", "ücretsiz harita indir", "tır oyunu modları"][k * 7 % 3] for k in range(60)), "tr"))
    out = spam.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {r.doc_id for r in out if r.spam_words * 2 > r.words} == {2000}
    assert sum(r.other_words for r in out if 1000 <= r.doc_id < 2000) > 0


def test_function_words_are_learned(spark):
    good, bad, _ = pages(4)
    rows = [(i, t, ["en", " EN ", "en-GB"][i % 3]) for i, t in enumerate(good)]
    rows += [(900 + i, bad["soup"], "en") for i in range(len(good) // 2)]  # a third of all rows are copies of one page
    rows += [(2000 + i, "un deux trois", "fr") for i in range(5)] + [(3000, None, "en"), (3001, "x y.", None), (3002, "", "und")]
    known = spam.function_words(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), Scratch(spark, "words"))
    assert set(known) == {"en"}  # five documents are no language
    assert {"the", "to", "and", "at", "from"} <= known["en"]
    assert not known["en"] & {"truck", "download", "cheap", "mod", "pack", "free", "gps"}


def test_very_long_text_is_linear():
    r = random.Random(2)
    text = " ".join(sentence(r) for _ in range(5000))
    rows = spam.measured_lot([spam.plain(text)], spam.Vocabulary({"en": frozenset({"the", "a", "to"})}))
    assert len(rows) == 5000
    assert rows["n"].sum() > 50_000


def test_lots_dont_matter():
    """A page's measures are the same alone and among others."""
    good, bad, fine = pages(5)
    known = {"en": frozenset("the a to of and at for has in if you".split()), "de": frozenset({"der", "und"})}
    every = [spam.plain(t) for t in [*good[:20], *bad.values(), *fine.values(), "", "…", "der Zug und der Bus"]]
    whole = spam.measured_lot(every, spam.Vocabulary(known))
    for i, page in enumerate(every):
        alone = spam.measured_lot([page], spam.Vocabulary(known)).drop(columns="page")
        pd.testing.assert_frame_equal(alone.reset_index(drop=True), whole[whole["page"] == i].drop(columns="page").reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize(("text", "want"), [("der Zug ist nicht da", "de"), ("the train is not there", "en"), ("xyz", spam.ANY), ("Qua quo qui quae quod.", spam.OTHER)])
def test_language(text, want):
    known = {"en": frozenset({"the", "is", "not", "there"}), "de": frozenset({"der", "ist", "nicht", "da"})}
    assert spam.measured_lot([spam.plain(text)], spam.Vocabulary(known))["lang"][0] == want


@pytest.mark.parametrize(("lang", "want"), [("en", "en"), (" EN-us ", "en"), ("und", ""), (None, ""), ("english", ""), ("", ""), ("pl_PL", "pl")])
def test_names_of_languages(lang, want):
    assert spam.named(lang) == want
