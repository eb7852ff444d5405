import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revlens.functions import month_label, months_apart, pg_initcap, quarter_label, round_ratio, text


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("o'neil-smith co.uk", "O'Neil-Smith Co.Uk"),
        ("mid-market", "Mid-Market"),
        ("SMB", "Smb"),
        ("EMEA", "Emea"),
        ("customer#000000048", "Customer#000000048"),
        ("NATION_16", "Nation_16"),
        ("MIDDLE EAST", "Middle East"),
        ("7up 7UP", "7up 7up"),
        ("élan vital-ÉCOLE", "Élan Vital-École"),
        ("a  b", "A  B"),
        ("hello\tworld", "Hello\tWorld"),
        ("", ""),
        (None, None),
    ],
)
def test_pg_initcap(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(pg_initcap("x").alias("y")).first().y == expected


def test_pg_initcap_cuts_only_text_that_sparks_initcap_may_cap_otherwise(spark, monkeypatch):
    df = spark.createDataFrame([("AMERICA / UNITED STATES",), ("customer#000000048",), ("7up a1b",), ("SMB.",)], "x string")
    cut = spark.createDataFrame([("mid-market",), ("élan",), ("a -b",), ("x\ty",)], "x string")
    monkeypatch.setattr(text, "_capped_runs", lambda c: F.raise_error(c).cast("string"))
    plain = [r.y for r in df.select(pg_initcap("x").alias("y")).collect()]
    assert plain == ["America / United States", "Customer#000000048", "7up A1b", "Smb."]
    for (x,) in cut.collect():
        with pytest.raises(Exception, match=x.split()[0]):
            cut.where(F.col("x") == x).select(pg_initcap("x")).collect()


def test_pg_initcap_is_the_same_by_both_paths(spark):
    letters = "aZ1 -#/\t\n_é"
    words = [("".join(w),) for n in range(4) for w in itertools.product(letters, repeat=n)]
    df = spark.createDataFrame(words, "x string")
    both = df.select("x", pg_initcap("x").alias("y"), text._capped_runs(F.col("x")).alias("z"))
    assert both.where(~F.col("y").eqNullSafe(F.col("z"))).collect() == []


def _ratio(spark, num, den, digits=2, mult=1):
    df = spark.createDataFrame([(Decimal(num) if num is not None else None, den)], "n decimal(22,2), d long")
    return df.select(round_ratio("n", "d", digits, mult).alias("r")).first().r


def test_round_ratio_half_away_from_zero(spark):
    assert _ratio(spark, "24.71", 2) == Decimal("12.36")  # 12.355 -> 12.36 (AVG would round twice)
    assert _ratio(spark, "-24.71", 2) == Decimal("-12.36")
    assert _ratio(spark, "0.01", 3) == Decimal("0.00")
    assert _ratio(spark, "0.02", 3) == Decimal("0.01")
    assert _ratio(spark, "1.00", 3, digits=4) == Decimal("0.3333")
    assert _ratio(spark, "1.00", 8, digits=2, mult=100) == Decimal("12.50")
    assert _ratio(spark, "0.00", 5) == Decimal("0.00")


def test_round_ratio_null_and_zero_denominator(spark):
    assert _ratio(spark, "5.00", 0) is None
    assert _ratio(spark, None, 3) is None


def test_round_ratio_tiny_margin_above_tie(spark):
    # 1/200000 * 100 = 0.0005 exactly -> 0.00 at 2 dp, 0.001 at 3 dp (tie rounds up)
    df = spark.createDataFrame([(1, 200000)], "n long, d long")
    r = df.select(round_ratio("n", "d", 3, 100).alias("r")).first().r
    assert r == Decimal("0.001")


def test_calendar_labels(spark):
    df = spark.createDataFrame([("2023-05-01", "2021-11-01")], "a string, b string").select(
        F.to_date("a").alias("a"), F.to_date("b").alias("b")
    )
    r = df.select(
        month_label("a").alias("m"),
        month_label("a", pad=False).alias("m2"),
        quarter_label(F.trunc("a", "quarter")).alias("q"),
        months_apart("a", "b").alias("d"),
    ).first()
    assert r.m == "May       2023"
    assert r.m2 == "May 2023"
    assert r.q == "2023 Q2"
    assert r.d == 18


@pytest.mark.parametrize("digits, mult", [(0, 1), (1, 100), (2, 1), (2, 100), (4, 1)])
def test_round_ratio_matches_exact_rational_rounding(spark, digits, mult):
    import math
    import random
    from fractions import Fraction

    rnd = random.Random(digits * 1000 + mult)
    rows = []
    for _ in range(2000):
        scale = rnd.choice([10**2, 10**6, 10**12, 10**15])
        n = Decimal(rnd.randrange(-scale, scale)) / 100
        d = rnd.choice([1, 2, 3, 7, 8, 200, 10**6 + 3, rnd.randrange(1, 10**12)]) * rnd.choice([1, -1])
        rows.append((n, d))
    df = spark.createDataFrame(rows, "n decimal(22,2), d long")
    got = [r.r for r in df.select(round_ratio("n", "d", digits, mult).alias("r")).collect()]

    def expected(n, d):
        x = Fraction(n) * mult / d * 10**digits
        q = math.floor(abs(x) + Fraction(1, 2))
        return Decimal(q if x >= 0 else -q).scaleb(-digits)

    for (n, d), g in zip(rows, got):
        assert g == expected(n, d), (n, d, g)


@pytest.mark.parametrize("digits, mult", [(0, 1), (1, 100), (2, 100), (4, 1)])
def test_oracle_ratio_sql_is_exact_too(digits, mult):
    import math
    import random
    from fractions import Fraction

    import duckdb

    from revlens.plans.oracle import _r

    rnd = random.Random(digits * 7 + mult)
    rows = [
        (Decimal(rnd.randrange(-10**15, 10**15)) / 100, rnd.randrange(1, 10**12) * rnd.choice([1, -1]))
        for _ in range(2000)
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, n DECIMAL(22,2), d BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, n, d) for i, (n, d) in enumerate(rows)])
    got = dict(con.execute(f"SELECT i, {_r('n', 'd', digits, mult, 2, 0)} FROM t").fetchall())
    for i, (n, d) in enumerate(rows):
        x = Fraction(n) * mult / d * 10**digits
        q = math.floor(abs(x) + Fraction(1, 2))
        assert got[i] == float(Decimal(q if x >= 0 else -q).scaleb(-digits)), (n, d, got[i])


def test_pg_initcap_matches_postgres_rule_on_random_text(spark):
    import random

    def pg(s):  # PostgreSQL: a letter after a non-alphanumeric is upper-cased, every other letter lower-cased
        out, prev_alnum = [], False
        for ch in s:
            out.append(ch.lower() if prev_alnum else ch.upper())
            prev_alnum = ch.isalnum()
        return "".join(out)

    rnd = random.Random(5)
    alphabet = "abcXYZ019 -_'./#&éÖñÆ\t"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 25))) for _ in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r.y for r in df.select(pg_initcap("x").alias("y")).collect()]
    assert got == [pg(t) for t in texts]


def test_oracle_initcap_matches_postgres_rule_on_random_text():
    import random

    import duckdb

    from revlens.plans.oracle import _initcap

    def pg(s):
        out, prev_alnum = [], False
        for ch in s:
            out.append(ch.lower() if prev_alnum else ch.upper())
            prev_alnum = ch.isalnum()
        return "".join(out)

    rnd = random.Random(9)
    alphabet = "abcXYZ019 -_'./#&éÖñÆ\t"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 25))) for _ in range(1000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = dict(con.execute(f"SELECT i, {_initcap('x')} FROM t").fetchall())
    assert [got[i] for i in range(len(texts))] == [pg(t.strip(" ")) for t in texts]
