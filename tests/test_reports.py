import pytest
from pyspark.sql import functions as F

from lectern.operators import compare, quality

GOOD = "FINDINGS\nA 12 mm nodule in the right upper lobe. Heart size is normal.\n\nIMPRESSION\nRight upper lobe nodule, 12 mm.\n\n*Draft for radiologist review. Not final.*"


def codes(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(quality.issues(F.col("t")).alias("i")).first()
    return [x["code"] for x in row["i"]]


def test_good_report_is_silent(spark):
    assert codes(spark, GOOD) == []


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("", "empty_report"),
        (None, "empty_report"),
        ("IMPRESSION\nNormal study of the chest.", "missing_findings"),
        ("FINDINGS\nNormal heart and lungs throughout.", "missing_impression"),
        ("FINDINGS\n-\n\nIMPRESSION\nNormal heart and lungs.", "empty_findings"),
        ("FINDINGS\nNormal heart and lungs.\nIMPRESSION\n-", "empty_impression"),
        (GOOD.replace("Heart", "TODO heart"), "placeholder_text"),
        (GOOD.replace("A 12 mm nodule", "A 12 mm nodule measuring 8 in"), "measurement_without_unit"),
        (GOOD.replace("Heart size is normal", "This is possibly likely benign"), "stacked_hedging"),
        (GOOD.replace("Right upper lobe nodule", "Left upper lobe nodule"), "laterality_mismatch"),
        (GOOD.replace("nodule, 12 mm", "nodule, 14 mm"), "impression_measurement_not_in_findings"),
        (GOOD.replace("nodule, 12 mm", "nodule, 12 mm, metastasis"), "impression_introduces_term"),
        (GOOD.replace("Heart size is normal", "The heart is enlarged"), "unquantified_size"),
    ],
)
def test_each_rule_fires(spark, text, code):
    assert code in codes(spark, text)


def test_lines_and_order(spark):
    text = GOOD.replace("Heart size is normal", "TODO possibly likely") + "\nTBD here"
    row = spark.createDataFrame([(text,)], "t string").select(quality.issues(F.col("t")).alias("i")).first()
    found = [(x["code"], x["line"]) for x in row["i"]]
    assert found.index(("placeholder_text", 2)) < found.index(("placeholder_text", 8)) < found.index(("stacked_hedging", 2))


def test_pairs():
    f = compare.facts("Nodule of 8 mm in the right upper lobe.", "Nodule of 9 mm in the right upper lobe.")
    assert [(p["delta_mm"], p["comparable"]) for p in f["pairs"]] == [(1.0, True)]
    f = compare.facts("Liver cyst of 8 mm.", "Lung nodule measures 9 mm.")
    assert f["pairs"] == [] and [m["raw"] for m in f["prior_only"] + f["current_only"]] == ["8 mm", "9 mm"]
    f = compare.facts("Right lobe nodule 1.2 cm.", "Right lobe nodule 13 mm.")
    assert f["pairs"][0]["delta_mm"] == 1.0 and len(f["warnings"]) == 1
    f = compare.facts("Height loss 50 percent.", "Height loss 60%.")
    assert f["pairs"][0]["comparable"] and f["pairs"][0]["delta_mm"] is None
    f = compare.facts("Height loss 50%.", "Height loss 5 mm.")
    assert not f["pairs"][0]["comparable"]
    # plural units are known to the pattern and not to the conversion
    f = compare.facts("Nodule 8 millimetres.", "Nodule 9 mm.")
    assert not f["pairs"][0]["comparable"]


def test_a_decimal_point_ends_no_sentence():
    m = compare.extract("Old text. Nodule of 1.2 cm in the lobe; more")[0]
    assert (m["value"], m["unit"], m["sentence"], m["line"]) == (1.2, "cm", "Nodule of 1.2 cm in the lobe", 1)
    assert compare.extract(None) == []


def test_values_agree_with_extraction(spark):
    text = "A 3 mm, 4.5CM and 50 percent; 20% of 7 millimetres"
    row = spark.createDataFrame([(text,)], "t string").select(compare.values(F.col("t")).alias("v")).first()
    assert [(v["value"], v["unit"]) for v in row["v"]] == [(m["value"], m["unit"]) for m in compare.extract(text)]


def test_compare_rows(spark):
    rows = spark.createDataFrame([(1, "Nodule 8 mm.", "Nodule 9 mm."), (2, None, None)], "id int, prior string, current string")
    got = {r["id"]: r for r in compare.compare(rows, ["id"]).collect()}
    assert got[1]["pairs"][0]["delta_mm"] == 1.0 and got[2]["pairs"] == []


def test_other_studies_are_told_first(spark):
    spine, chest = "Lumbar vertebra alignment preserved, sacral disc height maintained.", "Lungs clear, pleura normal, cardiac silhouette unremarkable, ribs intact."
    rows = spark.createDataFrame([(1, spine, chest), (2, spine + " Disc 8 mm.", chest), (3, "Nodule 8 mm.", "Nodule 8 mm."), (4, "Mass 1 cm.", "Mass 1.25 cm, effusion 3 mm."), (5, "", None)], "id int, prior string, current string")
    done = compare.compare(rows, ["id"])
    got = {r["id"]: r for r in done.select("*", compare.render_facts(F.struct(*done.columns)).alias("told")).collect()}
    assert got[1]["mismatch"] and got[1]["warnings"] == [got[1]["mismatch"]] and got[1]["pairs"] == []
    assert got[1]["told"].startswith("SAY FIRST") and "0%" in got[1]["told"] and "MEASUREMENTS" not in got[1]["told"]
    assert "  - 8 mm in the earlier report alone: Disc 8 mm\n" in got[2]["told"]
    assert got[3]["told"].splitlines()[1:4] == ["  - earlier 8 mm, now 8 mm: the same value", "      earlier: Nodule 8 mm", "      now: Nodule 8 mm"]
    assert "earlier 1 cm, now 1.25 cm: 2.5 mm more as printed" in got[4]["told"] and "3 mm in the current report alone" in got[4]["told"]
    assert got[5]["told"] == "" == got[5]["mismatch"]
