from pyspark.sql import functions as F

from loamworks.functions import text


def value(spark, build, *args):
    names = [f"a{i}" for i in range(len(args))]
    df = spark.createDataFrame([args], ", ".join(f"{n} {'array<string>' if isinstance(a, list) else 'string'}" for n, a in zip(names, args, strict=True)))
    return df.select(build(*[F.col(n) for n in names]).alias("x")).first()[0]


def test_numbers(spark):
    for said, want in (("0.17%", 0.17), ("< 0.05 %", 0.05), ("ND", None), ("1,234.5", 1234.5), ("+81", 81.0), ("Nominal 5", None), ("n/a", None), (None, None), ("", None)):
        assert value(spark, text.number, said) == want, said


def test_limits(spark):
    for said, want in (("NMT 0.25%", ("max", None, 0.25)), ("NLT 2.5", ("min", 2.5, None)), ("0.9 - 1.5", ("range", 0.9, 1.5)), ("-1.5 to 1.5", ("range", 1.5, 1.5)), ("report", None), (None, None)):
        got = value(spark, text.limit, said)
        assert (tuple(got) if got else None) == want, said


def test_inline(spark):
    df = spark.createDataFrame([("1.8\n(NMT 6.0)",), ("3.0\n(0.9 -1.5)",), ("plain",), (None,)], "c string")
    v, lim = text.inline(F.col("c"))
    got = [r[0] for r in df.select(text.satisfies(v, lim)).collect()]
    assert got == [True, False, None, None]


def test_sections_and_ranks(spark):
    assert value(spark, text.ctd_section, "see 3.2. S.4.3 validation") == "3.2.S.4.3"
    assert value(spark, text.ctd_section, None) == "unknown"
    assert value(spark, lambda c: text.describe_section(c), "3.2.P.7") == "CTD 3.2.P.7 (drug product)"
    assert value(spark, lambda c: text.plausible_number(c), "6920.93") is False
    assert value(spark, lambda c: text.plausible_number(c), "1.4.2") is True
    assert value(spark, text.table_number, "see Table 16.") == "16"
    assert value(spark, text.page_label, "Page 3 of 54") == "3"


def test_summary_and_json(spark):
    assert value(spark, text.summary, "One. Two\nmore. Three. Four.") == "One. Two more. Three."
    assert value(spark, text.summary, "").startswith("Address")
    assert value(spark, text.json_blob, 'so:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert value(spark, text.json_blob, 'well {"a": {"b": 2}} ok') == '{"a": {"b": 2}}'


def test_collapse_and_columns(spark):
    df = spark.createDataFrame([([8.72, 8.721, 22.727, 8.72, 100.0, 100.9],)], "v array<double>")
    assert df.select(text.collapse_near(F.col("v"))).first()[0] == [8.72, 22.727, 100.0]
    assert value(spark, lambda c: text.column_like(c, ("limit", "spec")), ["Compound", None, "Spec. Limit"]) == 2
    assert value(spark, lambda c: text.column_like(c, ("limit",)), ["a"]) is None
    assert value(spark, text.markdown_row, ["a|b", "c\nd", None]) == "| a\\|b | c d |  |"
