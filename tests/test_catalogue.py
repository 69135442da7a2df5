import pytest

from smileforge.plans.catalogue import ORACLE_SQL, QUERIES

from .util import assert_same, connect


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], connect(sf_dir))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["number_labels", "axis_ticks"])
def test_every_event_is_put_out(spark, sf_dir, name):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    assert QUERIES[name](spark, sf_dir).select("event_id").exceptAll(events).isEmpty() and events.exceptAll(QUERIES[name](spark, sf_dir).select("event_id")).isEmpty()


def test_every_event_is_a_center(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = QUERIES["trade_windows_many"](spark, sf_dir).where("time_offset = 0").select("event_id").distinct()
    assert own.count() == events.select("event_id").distinct().count()


def slow_vol(price, f, k, t):
    """The solver's documented rules, one row at a time."""
    from math import exp, log, pi, sqrt
    from statistics import NormalDist

    from smileforge.functions import black76 as b

    def call(v):
        d = (log(f / k) + v * v * t / 2) / (v * sqrt(t))
        return f * NormalDist().cdf(d) - k * NormalDist().cdf(d - v * sqrt(t)), f * exp(-d * d / 2) / sqrt(2 * pi) * sqrt(t)

    if price <= 0 or price < 0.99 * max(f - k, 0):
        return None
    v = seed = min(max(sqrt(2 * pi / t) * price / f, 0.05), 2)
    for _ in range(b.NEWTON_ROUNDS):
        value, vega = call(v)
        if abs(value - price) < b.NEWTON_TOLERANCE:
            return v
        if vega > 1e-10:
            v = min(max(v - (value - price) / vega, 0.01), 5)
    return v if abs(call(v)[0] - price) / price < 0.01 and abs(v - seed) > 0.02 else None


def test_every_expiry_has_its_points(spark, sf_dir):
    from smileforge.plans.catalogue import _all_quotes

    quotes, forwards = _all_quotes(spark, sf_dir)
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate > TIMESTAMP_NTZ '1995-01-01'").select("l_shipdate").distinct().count()
    curve = {r["expiry"].strftime("%y%m%d"): (r["forward_price"], r["ms"]) for r in forwards.selectExpr("expiry", "forward_price", "unix_millis(expiry) AS ms").collect()}
    rows = quotes.collect()
    assert len(curve) == days and len(rows) == 7 * days
    want = {}
    for r in rows:
        day, strike = r["symbol"].split("-")[2:4]
        f, ms = curve[day]
        want[day, int(strike)] = slow_vol(r["mid_price"] * f, f, int(strike), (ms - 788918400000) / 86_400_000 / 365.25)
    got = {(r["expiry"].strftime("%y%m%d"), r["strike"]): r["implied_vol"] for r in QUERIES["iv_points_every"](spark, sf_dir).collect()}
    assert set(got) == {k for k, v in want.items() if v is not None}
    assert all(abs(v - want[k]) < 1.1e-4 for k, v in got.items())


def test_entry_imports(spark, sf_dir):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_without_the_text_subpackage(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    repo = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "smileforge", tmp_path / "smileforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(QUERIES)
