from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators.units import conversion, convert, read_number, read_unit, split_label, value_milli


@pytest.mark.parametrize(
    ("text", "mark", "want"),
    [
        ("12,345", ".", 12345), ("12,345", ",", "12.345"), ("1.576.000", ",", 1576000), ("159'800", ",", 159800), ("13 700", ".", 13700), ("13\xa0700,5", ",", "13700.5"), ("< 9,9", ",", "9.9"), ("≤.5", ".", "0.5"),
        ("4,83 x 10^2", ",", 483), ("1.57·10^-2", ".", "0.0157"), ("5.45E2", ".", 545), ("2.21e+04", ".", 22100), ("-3", ".", -3), ("−3", ".", -3),
    ],
)
def test_numbers(text, mark, want):
    assert read_number(text, mark)[0] == Fraction(str(want))


@pytest.mark.parametrize("text", ["", " ", "5 - 7", "5-7", "1.5.2", "trace", "++", "n/a", "1:40", "12,34,5", "x" * 10_000])
def test_no_number(text):
    assert convert(text, ".", ["mg/L"], "mg/L", None) is None


UNITS = {
    "mg/L": ["mg/l", "MG/L", "мг/л", "mg·L-1", "mg per litre", "mg·L⁻¹", "[mg/L]", "(mg/L)", "unit: mg/L", "in mg/L", "mg/L (calc.)", "µg/mL", "mcg/mL"],
    "mmol/L": ["mM", "MMOL/L", "millimol/L", "ммоль/л", "mmol per litre", "µmol/mL"],
    "U/L": ["u/l", "units/L", "U per L", "Ед/л", "mU/mL", "мЕд/мл"],
    "10*9/L": ["G/L", "x10^9/L", "×10⁹/L", "10E9/L", "10^9/L", "10*3/uL", "K/uL", "thou/uL", "x1000/µL", "10⁹/л", "10*6/mL"],
    "10*12/L": ["T/L", "x10E12/L", "M/uL", "mill/mm3", "10⁶/µL"],
    "mg/dL": ["mg%", "mg/100mL", "mg / dL", "мг/дл"],
    "%": ["percent", "pct", "проц.", " % "], "s": ["sec", "sec.", "seconds", "сек"], "Cel": ["°C", "℃", "deg C", "Celsius", "C"],
}


@pytest.mark.parametrize(("unit", "other"), [(u, o) for u, os in UNITS.items() for o in os])
def test_same_unit(unit, other):
    assert conversion(other, unit, None) == (1, 0)


def test_conversions():
    assert conversion("nkat/L", "U/L", None)[0] == Fraction(6, 100)
    assert conversion("‰", "%", None)[0] == Fraction(1, 10) and conversion("L/L", "%", None)[0] == 100
    assert conversion("cells/µL", "10*9/L", None)[0] == Fraction(1, 1000) and conversion("/mm3", "10*9/L", None)[0] == Fraction(1, 1000)
    assert conversion("mg/dL", "mmol/L", 180.0)[0] == Fraction(1, 18) and conversion("mmol/L", "mg/dL", 180.0)[0] == 18
    assert conversion("mg/dL", "mmol/L", None) is None
    scale, offset = conversion("°F", "Cel", None)
    assert 98 * scale + offset == Fraction(110, 3)
    assert conversion("K", "Cel", None) == (1, Fraction(-27315, 100))
    for no in ["g", "AU", "score", "-", "", "index", "titre", "K", "x" * 500, "mg//L", "mg/"]:
        assert conversion(no, "%" if no == "K" else "mg/L", 100.0) is None
    assert read_unit("G/L")[0] != read_unit("G/L")[1]


@given(st.decimals("0.001", "999999", places=3), st.sampled_from(["mg/L", "g/L", "ng/mL", "mg/dL", "µg/L"]), st.sampled_from(["mg/L", "g/L", "ng/mL", "mg/dL"]))
def test_there_and_back(x, unit, target):
    there = convert(str(x), ".", [unit], target, None)
    assert there / conversion(unit, target, None)[0] == Fraction(Decimal(x))


def test_labels():
    assert split_label("Quaspoine, beta in ng/mL") == ("Quaspoine, beta", "ng/mL")
    assert split_label("SPN [10*9/L]") == ("SPN", "10*9/L") and split_label("Drehi, bound") == ("Drehi, bound", None) and split_label("") == ("", None)


def test_in_spark(spark):
    rows = [("5,0", ",", "mg/dL", "mg/L", None), ("5.0 g/L", ".", None, "mg/L", None), ("9.46 H", ".", "mg/L", "mg/L", None), ("0.21 (L)", ".", "mg/L", "mg/L", None), ("7", None, "mg/L", "mg/L", None), ("7", ".", "U/L", "mg/L", None), (None, ".", "mg/L", "mg/L", None), ("7", ".", "mg/L", None, None), ("7", ".", None, "mg/L", None), ("7.1 mmol/L", ".", "U/L", "mg/L", 100.0), ("7" * 190, ".", "mg/L", "mg/L", None)]
    df = spark.createDataFrame(rows * 2, "v string, m string, u string, t string, mass double")
    out = df.select(value_milli(F.col("v"), F.col("m"), F.col("t"), F.col("mass"), F.col("u")).alias("x"))
    assert [r.x for r in out.collect()] == [50_000, 5_000_000, 9460, 210, 7000, None, None, None, None, 710_000, None] * 2
    assert df.limit(0).select(value_milli(F.col("v"), F.col("m"), F.col("t"), F.col("mass"), F.col("u"))).count() == 0


def test_texts_of_any_length():
    """Blanks, long numbers and long labels are read whole and end quickly."""
    assert read_unit("mg/L" + " " * 500) == read_unit("mg/L") and read_unit("mg" * 30_000) == () and read_unit("m" + "9" * 5000) == ()
    assert read_number("0." + "0" * 7000 + "1", ".")[0] > 0 and read_number("1" * 6000 + " mg", ".")[1].strip() == "mg"
    assert split_label("name " * 400 + "[mg/L]")[1] == "mg/L" and split_label("x" * 100_000)[1] is None
