from fractions import Fraction

import pytest

from waybill.operators.units import amount_of, item_amount, measure, normalise_quantities, number, order_amount, segment

KG, G, L = 10**9, 10**6, 10**6


@pytest.mark.parametrize(
    ("text", "dim", "size"),
    [("Kg.", "mass", KG), ("KGM", "mass", KG), ("kilo", "mass", KG), ("gr.", "mass", G), ("M/T", "mass", 10**12), ("mt", "mass", 10**12), ("ton (metric)", "mass", 10**12), ("mcg", "mass", 1), ("µg", "mass", 1), ("mL", "volume", 1000), ("cl", "volume", 10_000), ("cc", "volume", 1000), ("LTRS", "volume", L), ("pounds", "mass", 453_592_370), ("millilitre", "volume", 1000),
     ("m³", "volume", 10**9), ("m^3", "volume", 10**9), ("cubic metre", "volume", 10**9), ("cu m", "volume", 10**9), ("cbm", "volume", 10**9), ("ccm", "volume", 1000), ("dm3", "volume", L), ("cubic centimetres", "volume", 1000), ("cu. in.", "volume", Fraction(254, 10_000) ** 3 * 10**9),
     ("gal", "volume", Fraction(3_785_411_784, 1000)), ("imp. gal", "volume", 4_546_090), ("qt", "volume", Fraction(946_352_946, 1000)), ("fl oz", "volume", Fraction(3_785_411_784, 128_000)), ("cwt", "mass", 112 * 453_592_370), ("grains", "mass", Fraction(453_592_370, 7000)), ("dag", "mass", 10 * G), ("Mg", "mass", 1000), ("MG", "mass", 1000)],
)
def test_units(text, dim, size):
    assert segment(text) == (dim, Fraction(size))


@pytest.mark.parametrize("text", ["", "drums", "vials", "x", "kgg g", "k" * 100, "m", "sq m", "ft", "k" * 100_000])
def test_no_units(text):
    assert segment(text) is None


def test_priors_of_the_field_decide_what_a_text_alone_does_not():
    assert measure("mt") == ("mass", Fraction(10**12)) and measure("mt", "length") == ("length", Fraction(1))
    assert measure("Mg") == ("mass", Fraction(1000)) and measure("Mg", "bulk") == ("mass", Fraction(10**12))
    assert measure("mg", "bulk") == ("mass", Fraction(1000))
    assert measure("cm2") == ("area", Fraction(1, 10_000))


@pytest.mark.parametrize(
    ("text", "decimal", "value"),
    [("1,234.5", ".", "1234.5"), ("1.234,5", ",", "1234.5"), ("75,000", ".", "75000"), ("75,000", ",", "75"), ("75.000", ",", "75000"), ("5.000.000", ".", "5000000"), ("5,00,000.00", ".", "500000"), ("1'000", ".", "1000"), ("0.125", ",", "0.125"), ("1 803.92", ".", "1803.92")],
)
def test_numbers(text, decimal, value):
    assert number(text, decimal) == Fraction(value)


@pytest.mark.parametrize(
    ("text", "amount"),
    [
        ("5 DRUMS OF 25 kg NET EACH", 125 * KG), ("PACKED IN 10 DRUMS OF 191782 G NET", 1_917_820 * G), ("1250 GRAMS * 2 bags", 2500 * G), ("2×100g", 200 * G), ("50 boxes, each 40 gm", 2000 * G),
        ("2 Kg. 310 grams", 2310 * G), ("1 1/2 ton (metric)", 1500 * KG), ("½ t", 500 * KG), ("TWENTY FIVE KG.", 25 * KG), ("ONE THOUSAND mg.", G), ("5000E3 gr.", 5_000_000 * G), ("kg 250", 250 * KG), ("approx. 300 LBS", 300 * 453_592_370),
    ],
)
def test_sentences(text, amount):
    assert amount_of(text, ".") == ("mass", amount)


def test_sentences_of_volumes_and_long_texts():
    assert amount_of("2 drums of 3 cubic metres", ".") == ("volume", 6 * 10**9)
    assert amount_of("4 m3", ".") == ("volume", 4 * 10**9)
    assert amount_of("10 fl. oz", ".") == ("volume", 295_735)
    assert amount_of(" " * 2000 + "5 kg" + " " * 2000, ".") == ("mass", 5 * KG)


@pytest.mark.parametrize("text", ["4 BOX", "AS PER PACKING LIST", "-", "kg", "0 kg", "5 kg of 2 L"])
def test_no_amounts(text):
    assert amount_of(text, ".") is None


def test_orders_and_items():
    assert order_amount(40.0, "BOX (25 kg each)", None, ".") == ("mass", 1000 * KG)
    assert order_amount(12.0, "200KGM/bag", None, ".") == ("mass", 2400 * KG)
    assert order_amount(3.0, "?", "Salt - quantity in MG", ".") == ("mass", 3000)
    assert order_amount(3.0, None, "Salt, packed in 25 kg drums", ".") is None
    assert order_amount(40.0, "DRUMS", "Salt, qty stated in kg", ".") is None
    assert item_amount(5.0, "DRUMS", "5 DRUMS OF 25 t", ".") == ("mass", 125_000 * KG)
    assert item_amount(None, None, None, ".") is None
    assert order_amount(float("nan"), "kg", None, ".") is None


def test_operator_nulls_ties_and_clashes(spark):
    schema = "field string, value double, unit string, text string, description string, decimal_mark string, amount string"
    rows = [("quantity", 2.0, "kg", None, None, None, "x"), ("quantity", 2.0, "kg", None, None, None, "x"), (None, None, None, None, None, None, None), ("net_weight_text", None, None, "9" * 100_000 + " kg", None, ".", ""), ("quantity", 0.0, "kg", "", "", ",", "")]
    got = [(r["dim"], r["amount"]) for r in normalise_quantities(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("mass", 2 * KG), ("mass", 2 * KG), (None, None), (None, None), (None, None)]
    assert normalise_quantities(spark.createDataFrame([], schema)).count() == 0
