import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.operators.rejects import accepted, diagnose, parse_block, parse_price_lines, rejected, split_strict

KNOWN = frozenset(("SPY", "^VIX"))
GOOD = "2024-01-02,SPY,1,2,3,4.5,6,7"


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (GOOD, None), (GOOD + "\r", None), ('"2024-01-02","spy","1","2","3"," 4.5 ","6","7,000"', None), ("2024-01-02, vix ,,,,+4e1,,", None), ("2024-01-02,SPY,1,2,3,.5,6,7", None),
        ('2024-01-02,SPY,"a""b",2,3,4,6,7', None), ("2024-01-02,SPY,1,2,3,5.,,\t", None),
        ('2024-01-02,"SPY,1,2,3,4.5,6,7', "quoting"), ('2024-01-02,SP"Y,1,2,3,4.5,6,7', "quoting"), ('2024-01-02,"SPY"x,1,2,3,4.5,6,7', "quoting"), ('2024-01-02,SPY,1,2,3,4.5,6,"7', "quoting"),
        ('2024-01-02, "SPY",1,2,3,4.5,6,7', "quoting"), ('x,"SPY"",1', "quoting"),
        ("", "column_count"), (None, "column_count"), ("2024-01-02,SPY", "column_count"), (GOOD + ",", "column_count"), (GOOD.replace(",", ";"), "column_count"),
        ("2024-02-30,SPY,1,2,3,4.5,6,7", "date"), ("date,symbol,open,high,low,close,adj_close,volume", "date"), ("0000-01-01,SPY,1,2,3,4,6,7", "date"), ("２０２４-01-02,SPY,1,2,3,4,6,7", "date"),
        ("2024-01-02,SPYY,1,2,3,4.5,6,7", "symbol"), ("2024-01-02,,1,2,3,4.5,6,7", "symbol"),
        *((f"2024-01-02,SPY,1,2,3,{c},6,7", "close") for c in ("", "0", "0.0", "-1", "nan", "inf", "1e999", "1_0", "4%", "4..5", "0x1", "１")),
    ],
)
def test_reasons(line, reason):
    assert diagnose(line, KNOWN)[0] == reason


LINES = st.lists(
    st.one_of(st.just(GOOD), st.none(), st.text(alphabet='2024-01,"SPY.e+\r\n\t é', max_size=40), st.sampled_from([GOOD + "\r", GOOD.replace("SPY", "vix"), GOOD.replace("4.5", "1e999"), GOOD.replace("4.5", "4.5\r"), GOOD + "\n" + GOOD, GOOD.replace("01-02", "1-2")])),
    max_size=60,
)


@settings(max_examples=200, deadline=None)
@given(LINES)
def test_blocks_agree_with_the_strict_reader(lines):
    got = parse_block(pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string()), KNOWN)
    assert list(zip(*(got[c].to_pylist() for c in ("reason", "date", "symbol", "close")))) == [diagnose(x, KNOWN) for x in lines]
    assert got["line_id"].to_pylist() == list(range(len(lines)))


def test_bulk_path_takes_clean_blocks():
    lines = [GOOD] * 1000 + ["bad"] + [GOOD] * 1000
    assert [r for r in parse_block(pa.array(range(2001)), pa.array(lines), KNOWN)["reason"].to_pylist() if r] == ["column_count"]


def test_split():
    assert split_strict('a,"b,c",') == ["a", "b,c", ""]
    assert split_strict("") == [""]


def test_operator(spark):
    symbols = spark.createDataFrame([("SPY", "x"), (None, "y"), ("SPY", "z")], "symbol string, kind string")
    rows = spark.createDataFrame([(1, GOOD), (2, GOOD), (3, "bad"), (4, None), (5, "x" * 200_000)], "line_id long, line string").selectExpr("*", "'q' as reason", "'d' as date")
    out = parse_price_lines(rows, symbols)
    assert sorted(map(tuple, rejected(out).collect())) == [(3, "column_count"), (4, "column_count"), (5, "column_count")]
    assert sorted(r.line_id for r in accepted(out).collect()) == [1, 2]
    assert parse_price_lines(rows.limit(0), symbols).count() == 0
    assert {r.reason for r in parse_price_lines(rows, symbols.limit(0)).collect()} == {"symbol", "column_count"}
    with pytest.raises(ValueError):
        parse_price_lines(rows, spark.createDataFrame([("A",), ("B",)], "s string"), max_symbols=1)
