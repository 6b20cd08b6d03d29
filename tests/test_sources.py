import pytest

from tallyframe.sources import tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_headerless_lines(spark, tmp_path):
    names = tables.read_column_names(spark, write(tmp_path / "names", "age\n\n  class of worker \nveteran's admin\n"))
    assert names == ["age", "class of worker", "veteran's admin"]
    data = write(tmp_path / "data", '73, Not in "universe",1\n\n  \t\n58, Self,\nx, a\n 9,b,c,d \n')
    df = tables.read_headerless(spark, data, names, {"age": "long"})
    assert [tuple(r) for r in df.collect()] == [
        (73, ' Not in "universe"', "1", None), (58, " Self", "", None), (None, " a", None, "x, a"), (9, "b", "c", "9,b,c,d")]


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="column list"):
        tables.read_column_names(spark, str(tmp_path / "absent"))
    with pytest.raises(FileNotFoundError, match="data file"):
        tables.read_headerless(spark, str(tmp_path / "absent"), ["a"])


def test_conversion_and_typed_reading(spark, tmp_path):
    names = write(tmp_path / "names", "n\nx\ns\nempty\n")
    data = write(tmp_path / "data", "1,0.5, a b,\n2,NA,?,\n3,7, ?,\n")
    out = str(tmp_path / "out")
    assert tuple(tables.convert_headerless(spark, names, data, out).first()) == (3, 4, 0)
    df = tables.read_table(spark, out)
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("s", "string"), ("empty", "double")]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 0.5, " a b", None), (2, None, "?", None), (3, 7.0, " ?", None)]
    given = tables.read_table(spark, out, schema="n int, x string", null_tokens=("",))
    assert sorted(tuple(r) for r in given.collect()) == [(1, "0.5"), (2, "NA"), (3, "7")]
    tables.write_table(df, str(tmp_path / "parquet"))
    assert tables.read_table(spark, str(tmp_path / "parquet"), "parquet").count() == 3
