"""Garbling that is planted in clean texts must be found and undone; true accents and symbols must stay."""

import pytest

from cohortloom.llm import mojibake

CLEAN = [
    "Die Führung läuft über den Kühlkörper, während die größere Hülse schließt.",
    "La cámara está más fría; el señor llegó mañana con su niño pequeño.",
    "L’élément moulé coopère déjà avec la tête à l’extrémité côté amont.",
    "The “free” end tilts by 5 °C – as shown – within ±3 µm.",
    "Указанный подшипник охватывает рычаг во время работы.",
    "O câmara de pressão não é magnético; a ação é rápida.",
]
DECOYS = ["The marks Â, Ã and ã denote frames.", "Åström–Ñuble type joint", "Series «36» ¦ lot ¬3", "Cost: about € 77", "Cœur, nœud et œillet", "1 ∩ 2 ≠ ∞ ∂ ∑", "ŁĄCZNIK ŻELIWNY", "pure ASCII", "", None, "   "]
PAIRS = [("utf_8", "cp1252"), ("utf_8", "latin_1"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("utf_8", "cp437"), ("utf_8", "mac_roman")]


def garble(text, written, decoded):
    return text.encode(written, "ignore").decode(decoded, "ignore")


@pytest.fixture(scope="module")
def corpus(spark):
    rows, bad = [], {}
    for k in range(900):
        rows.append((k, f"{k} " + CLEAN[k % len(CLEAN)] + f" {k}", "x"))
    for k, t in enumerate(DECOYS):
        rows.append((2000 + k, t, "x"))
    n = 3000
    for w, d in PAIRS:
        for t in CLEAN[:3]:
            for _ in range(2):
                g = garble(t, w, d)
                if g != t and g.encode(d).decode(w) == t:
                    rows.append((n, f"{n} " + g, "x"))
                    bad[n] = f"{n} " + t
                    n += 1
    return spark.createDataFrame([*rows, rows[0], rows[-1]], "doc_id bigint, text string, units string"), bad, n


def test_found_and_restored(corpus):
    df, bad, _ = corpus
    found = [r["doc_id"] for r in mojibake.found(df).collect()]
    assert len(found) == len(set(found))
    assert not {f for f in found if f < 3000}
    assert len(set(found) & set(bad)) >= 0.95 * len(bad)
    fixed = {r["doc_id"]: r["restored_text"] for r in mojibake.restore(df).collect()}
    assert sum(fixed.get(k) == v for k, v in bad.items()) >= 0.8 * len(bad)


def test_lost_characters_are_marked(spark):
    df = spark.createDataFrame([(1, "na�ve user"), (2, "naïve user"), (3, "an \x93odd\x94 one")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in mojibake.found(df).collect()) == [1, 3]


def test_empty(spark, corpus):
    assert mojibake.found(corpus[0].limit(0)).collect() == []


def test_long_text(spark):
    df = spark.createDataFrame([(1, "é" * 100_000 + " x"), (2, "Ã©" * 50_000)], "doc_id bigint, text string")
    mojibake.found(df).collect()


def test_aligned_and_undo():
    assert mojibake.aligned("fÃ¼r MaÃŸ", "für Maß") == [("Ã¼", "ü"), ("ÃŸ", "ß")]
    assert mojibake.aligned("für", "fur") == []
    assert mojibake.undo(mojibake.raw_bytes("fÃ¼r", "cp1252"), "utf_8") == "für"
    assert mojibake.undo(mojibake.raw_bytes("für", "cp1252"), "utf_8") is None


def test_short_units_are_learned_from(spark):
    units = spark.createDataFrame([("0 ░C", 2), ("0 °C", 500), ("▒0", 2), ("±0", 500)], "unit string, n bigint")
    assert ("cp437", "cp1252") in mojibake.learn(units, mojibake.pair_counts(units))


def test_a_unit_of_many_parts_is_restored():

    unit = "中".join(garble(c, "utf_8", "cp1252") for c in "äöüäöüäöüäöü")
    forms = mojibake.restored_forms(unit, {"cp1252": ["utf_8"]}, set("äöü中"), True)
    assert ("中".join("äöüäöüäöüäöü"), "cp1252", "utf_8") in forms


def test_more_than_three_rounds():
    unit = "ä"
    for _ in range(5):
        unit = garble(unit, "utf_8", "latin_1")
    assert "ä" in {v for v, _, _ in mojibake.restored_forms(unit, {"latin_1": ["utf_8"]}, set("ä"), True)}


def test_a_character_of_one_document_counts(spark):
    units = spark.createDataFrame([("Ωx", 1), ("äb", 40)], "unit string, n bigint")
    use = mojibake.pair_counts(units)
    assert {"Ω", "ä"} <= use.known and use.usual("Ωx") > use.usual("Ωx", True)


def test_units_are_replaced_as_wholes():
    units = [{"unit": "Ã©", "restored": "é"}, {"unit": "0 Â°C", "restored": "0 °C"}, {"unit": "0Ã©", "restored": "0é"}]
    assert mojibake._apply("Ã©, hÃ©x; 12 Â°C, 34Ã©", units) == ("é, hÃ©x; 12 °C, 34é", True)


@pytest.mark.parametrize("text", ["x12 °C between 7", "für 100µm", "naïve; 5× 10 ±0,5 %", "中文，12:3", "“a” – b", "é" * 50])
def test_units_of_python_and_of_the_cluster(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = set(mojibake.doc_units(df).first()["units"])
    assert got == {u for _, _, u in mojibake.unit_spans(text)}


def test_mappings_come_from_twins_alone(spark):
    words = ["gr{}n", "f{}r alle", "T{}r", "m{}de", "k{}hl"]
    rows = [(w.format("ü"), 50) for w in words] + [(w.format("QÜ".replace("Q", "Ã")), 2) for w in words] + [("café", 50), ("cafè", 2)]
    pairs = mojibake.twins(spark.createDataFrame(rows, "unit string, n bigint")).select("unit", "twin")
    assert mojibake.learn_maps(pairs) == {"ÃÜ": "ü"}
    assert mojibake.mapped_form("TÃÜr", {"ÃÜ": "ü"}, 2) == "Tür" and mojibake.mapped_form("Tær", {"ÃÜ": "ü"}, 2) == "Tær"


def test_garbled_units_that_are_too_many_to_broadcast(spark, corpus):
    by_doc = mojibake.doc_units(corpus[0])
    bad = mojibake.garbled_units(by_doc)
    units = by_doc.selectExpr("doc_id", "explode(units) AS unit")
    a = sorted(map(str, mojibake.with_garbled(units, bad).collect()))
    assert a == sorted(map(str, units.join(bad, "unit").collect())) and a
