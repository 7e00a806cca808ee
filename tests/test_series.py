import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newstape.operators import blocks, scans, series
from newstape.operators.blocks import over_blocks


def make_prices(sizes=(1, 5, 63, 64, 65, 400), seed=3):
    rng = np.random.default_rng(seed)
    frames = []
    for t, n in enumerate(sizes):
        day = pd.date_range("1999-11-20", periods=3 * n, freq="D")[np.sort(rng.choice(3 * n, n, replace=False))]
        close = 50 + np.cumsum(rng.normal(0, 1, n))
        frames.append(
            pd.DataFrame(
                {
                    "ticker": f"T{t}",
                    "date": day.date,
                    "open": close + rng.normal(0, 0.3, n),
                    "high": close + 1.0,
                    "low": close - 1.0,
                    "close": close,
                    "volume": rng.integers(1, 90, n),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def prices():
    return make_prices()


@pytest.fixture(scope="module")
def bars(spark, prices):
    return spark.createDataFrame(prices).repartition(3, F.rand(1))


def got(df, cols):
    out = df.select("ticker", "date", *cols).toPandas().sort_values(["ticker", "date"])
    return out.reset_index(drop=True)


def expect(prices, fn):
    parts = [fn(g.reset_index(drop=True)) for _, g in prices.sort_values(["ticker", "date"]).groupby("ticker")]
    return pd.concat(parts, ignore_index=True)


def check(actual, expected, cols, rtol=1e-9, atol=1e-9):
    assert len(actual) == len(expected)
    for c in cols:
        np.testing.assert_allclose(
            actual[c].astype(float).to_numpy(), expected[c].astype(float).to_numpy(), rtol=rtol, atol=atol, err_msg=c
        )


def test_row_index_and_first(bars, prices):
    out = blocks.row_index(bars, first=["close"])
    exp = expect(prices, lambda g: pd.DataFrame({"row_idx": range(len(g)), "row_cnt": len(g), "_first_close": g.close[0]}))
    check(got(out, ["row_idx", "row_cnt", "_first_close"]), exp, ["row_idx", "row_cnt", "_first_close"])


@pytest.mark.parametrize("size", [4, 7, 4096])
def test_rolling(bars, prices, size):
    out = series.sma(bars, (3, 20), size=size)
    exp = expect(prices, lambda g: pd.DataFrame({"sma3": g.close.rolling(3).mean(), "sma20": g.close.rolling(20).mean()}))
    check(got(out, ["sma3", "sma20"]), exp, ["sma3", "sma20"])
    out = series.bollinger(bars, size=size)
    exp = expect(
        prices,
        lambda g: pd.DataFrame(
            {
                "bb_middle": g.close.rolling(20).mean(),
                "bb_std": g.close.rolling(20).std(),
                "bb_upper": g.close.rolling(20).mean() + 2 * g.close.rolling(20).std(),
            }
        ),
    )
    check(got(out, ["bb_middle", "bb_std", "bb_upper"]), exp, ["bb_middle", "bb_std", "bb_upper"])
    out = series.rolling_mean(bars, {"m5": "close"}, 5, size=size)
    check(got(out, ["m5"]), expect(prices, lambda g: pd.DataFrame({"m5": g.close.rolling(5, min_periods=1).mean()})), ["m5"])


def pandas_rsi(close, n=14):
    d = close.diff()
    gain = d.where(d > 0, 0).rolling(n).mean()
    loss = -d.where(d < 0, 0).rolling(n).mean()
    return 100 - 100 / (1 + gain / loss)


@pytest.mark.parametrize("size", [5, 4096])
def test_rsi(bars, prices, size):
    out = got(series.rsi(bars, size=size), ["rsi14"])
    check(out, expect(prices, lambda g: pd.DataFrame({"rsi14": pandas_rsi(g.close)})), ["rsi14"])
    assert out.rsi14.dropna().between(0, 100).all()


def test_rsi_golden(spark):
    xs = [10, 11, 10.5, 11.5, 12, 11, 11, 12, 13, 12.5, 13.5, 14, 13, 14, 15, 14.5]
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(xs)]
    out = got(series.rsi(spark.createDataFrame(rows, "ticker string, date date, close double")), ["rsi14"]).rsi14
    assert out[:13].isna().all()
    np.testing.assert_allclose(out[13:].to_numpy(), [70.0, 72.727273, 66.666667], atol=1e-6)


def test_rsi_flat_and_rising(spark):
    rows = []
    for i in range(20):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        rows += [("flat", day, 5.0), ("up", day, 5.0 + i)]
    out = got(series.rsi(spark.createDataFrame(rows, "ticker string, date date, close double")), ["rsi14"])
    assert out[out.ticker == "flat"].rsi14.isna().all()
    assert (out[out.ticker == "up"].rsi14.dropna() == 100.0).all()


@pytest.mark.parametrize("size,sub", [(8, 4), (64, 8), (4096, 256)])
@pytest.mark.parametrize("span", [1, 2, 9, 26, 200])
def test_ema(bars, prices, size, sub, span):
    out = scans.ema(bars, {"e": ("close", span)}, size=size, sub=sub)
    exp = expect(prices, lambda g: pd.DataFrame({"e": g.close.ewm(span=span, adjust=False).mean()}))
    check(got(out, ["e"]), exp, ["e"], rtol=1e-12)


def test_ema_golden_and_nulls(spark):
    rows = [("A", dt.date(2024, 1, d), x) for d, x in [(1, 1.0), (2, None), (3, 2.0), (4, 3.0)]]
    out = got(scans.ema(spark.createDataFrame(rows, "ticker string, date date, close double"), {"e": ("close", 3)}), ["e"])
    assert out.e[0] == 1 and np.isnan(out.e[1]) and out.e[2] == 1.5 and out.e[3] == 2.25


@pytest.mark.parametrize("size", [256, 4096])
def test_macd(bars, prices, size):
    def one(g):
        m = g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()
        s = m.ewm(span=9, adjust=False).mean()
        return pd.DataFrame({"macd": m, "macd_signal": s, "macd_hist": m - s})

    cols = ["macd", "macd_signal", "macd_hist"]
    check(got(series.macd(bars, size=size), cols), expect(prices, one), cols, rtol=0, atol=1e-11)


def test_all_indicators(bars, prices):
    out = series.add_technical_indicators(bars)
    assert set(out.columns) - set(bars.columns) == {
        "sma20", "sma50", "rsi14", "macd", "macd_signal", "macd_hist", "bb_middle", "bb_std", "bb_upper", "bb_lower",
    }
    exp = expect(prices, lambda g: pd.DataFrame({"sma50": g.close.rolling(50).mean(), "rsi14": pandas_rsi(g.close)}))
    check(got(out, ["sma50", "rsi14"]), exp, ["sma50", "rsi14"])
    assert series.add_technical_indicators(bars, ["SMA20"]).columns == [*bars.columns, "sma20"]


def test_changes_and_labels(bars, prices):
    exp = expect(prices, lambda g: pd.DataFrame({"p": g.close.pct_change(), "d": g.close.diff(2), "s": g.close.shift(-3)}))
    check(got(series.pct_change(bars, name="p", size=4), ["p"]), exp, ["p"])
    check(got(series.diff(bars, n=2, name="d", size=4), ["d"]), exp, ["d"])
    check(got(series.shift(bars, "close", -3, "s", size=4), ["s"]), exp, ["s"])
    kept = got(series.label_next_move(bars, keep_last=True, size=4), ["target"])
    check(kept, expect(prices, lambda g: pd.DataFrame({"target": (g.close.shift(-1) - g.close > 0).astype(int)})), ["target"])
    dropped = series.label_next_move(bars, n=2, size=4)
    assert dropped.count() == sum(max(len(g) - 2, 0) for _, g in prices.groupby("ticker"))


def test_pct_change_fills_and_zero_base(spark):
    rows = [("A", dt.date(2024, 1, i + 1), x) for i, x in enumerate([0.0, 1.0, 0.0, 0.0])]
    rows += [("B", dt.date(2023 + i, 1, 1), x) for i, x in enumerate([2.0, None, 3.0])]
    out = got(series.pct_change(spark.createDataFrame(rows, "ticker string, date date, close double"), name="p"), ["p"])
    a, b = out[out.ticker == "A"].p.tolist(), out[out.ticker == "B"].p.tolist()
    assert np.isnan(a[0]) and np.isnan(a[1]) and a[2] == -1 and np.isnan(a[3])
    assert np.isnan(b[0]) and b[1] == 0 and b[2] == 0.5


@pytest.mark.parametrize("size", [3, 4096])
def test_cumulative_and_drawdown(bars, prices, size):
    rated = blocks.row_index(series.pct_change(bars, name="r"))
    out = scans.compounded(rated, {"eq": "r"}, 10000.0, size=size)

    def one(g):
        v = (1 + g.close.pct_change()).cumprod() * 10000
        return pd.DataFrame({"eq_cumulative": v, "eq_peak": v.cummax(), "eq_drawdown": (v - v.cummax()) / v.cummax()})

    cols = ["eq_cumulative", "eq_peak", "eq_drawdown"]
    check(got(out, cols), expect(prices, one), cols)
    peaks = got(scans.running_max(bars, "close", "peak", size=size), ["peak"])
    check(peaks, expect(prices, lambda g: pd.DataFrame({"peak": g.close.cummax()})), ["peak"])


def test_product_with_negative_growth(spark):
    rates = [0.5, -2.5, -0.2, 0.1, -3.0, 0.4]
    rows = [("A", dt.date(2024, 1, i + 1), r) for i, r in enumerate(rates)]
    df = blocks.row_index(spark.createDataFrame(rows, "ticker string, date date, r double"))
    out = got(scans.compounded(df, {"eq": "r"}, 1.0, size=2), ["eq_cumulative", "eq_peak"])
    v = (1 + pd.Series(rates)).cumprod()
    np.testing.assert_allclose(out.eq_cumulative, v)
    np.testing.assert_allclose(out.eq_peak, v.cummax())


def test_gaps_spine_and_bounds(spark, bars, prices):
    out = series.trading_day_gaps(bars).toPandas()
    total = 0
    for _, g in prices.groupby("ticker"):
        total += len(set(pd.date_range(min(g.date), max(g.date), freq="B").date) - set(g.date))
    assert len(out) == total
    news = spark.createDataFrame([("A", dt.date(2024, 3, 1)), ("A", dt.date(2024, 3, 9))], "ticker string, date date")
    row = series.news_window_bounds(news).first()
    assert row.range_start == dt.date(2023, 12, 2) and row.range_end == dt.date(2024, 3, 14)
    spine = series.date_spine(series.news_window_bounds(news), "range_start", "range_end")
    assert spine.count() == 104


def test_one_ticker_does_not_change_with_others(bars):
    alone = got(series.add_technical_indicators(bars.where("ticker = 'T5'")), ["rsi14", "macd_hist", "bb_upper"])
    among = got(series.add_technical_indicators(bars).where("ticker = 'T5'"), ["rsi14", "macd_hist", "bb_upper"])
    pd.testing.assert_frame_equal(alone, among)


def test_rows_are_kept_once(bars):
    out = over_blocks(bars, lambda x, w: x, back=9, ahead=5, size=3)
    assert out.count() == bars.count() and out.columns == bars.columns


def test_rows_without_a_ticker_are_a_series_of_their_own(spark):
    rows = [(t, dt.date(2024, 1, d), float(p)) for t in ("A", None) for d, p in ((1, 2), (2, 4), (3, 3))]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    changes = {(r.ticker, r.date.day): r.close_pct for r in series.pct_change(df).collect()}
    assert changes == {(t, d): c for t in ("A", None) for d, c in ((1, None), (2, 1.0), (3, -0.25))}
    averages = scans.ema(df, {"e": ("close", 3)})
    assert {(r.ticker, r.date.day): r.e for r in averages.collect()} == {(t, d): e for t in ("A", None) for d, e in ((1, 2.0), (2, 3.0), (3, 3.0))}
    peaks = series.drawdown(df, "close")
    assert {(r.ticker, r.date.day): r.peak for r in peaks.collect()} == {(t, d): p for t in ("A", None) for d, p in ((1, 2.0), (2, 4.0), (3, 4.0))}
    numbered = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1.0), (None, dt.date(2024, 1, 1), 1.0)], "ticker int, date date, close double")
    with pytest.raises(Exception, match="series key ticker is NULL"):
        series.pct_change(numbered).collect()


@pytest.mark.parametrize("spans", [(9, 26, 9), (12, 9, 9), (9, 26, 9.1)])
def test_macd_of_equal_spans(spark, spans):
    close = [100 + 10 * math.sin(i / 3) + i % 7 for i in range(80)]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), c) for i, c in enumerate(close)], "ticker string, date date, close double")
    got = series.macd(df, *spans).orderBy("date").collect()
    prices = pd.Series(close)
    line = prices.ewm(span=spans[0], adjust=False).mean() - prices.ewm(span=spans[1], adjust=False).mean()
    signal = line.ewm(span=spans[2], adjust=False).mean()
    assert [r.macd_signal for r in got] == pytest.approx(signal.tolist(), abs=1e-9)
