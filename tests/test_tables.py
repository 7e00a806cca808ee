import datetime as dt

from pyspark.sql import functions as F

from newstape.functions.sql import register
from newstape.plans import catalog
from newstape.plans.jobs import JobConfig, run_daily_job
from newstape.sources import tables, views


def test_ticker_files_and_headers(spark, tmp_path):
    (tmp_path / "abc_stock_data.csv").write_text(
        "date,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,10\n,ABC,ABC,ABC,ABC,ABC\n2024-01-03,1,2,0.5,1.6,20\n"
    )
    text = "ticker string, date string, open string, high string, low string, close string, volume string"
    raw = tables.read_ticker_files(spark, str(tmp_path), text)
    out = tables.drop_header_rows(raw).orderBy("date").collect()
    assert [(r.ticker, r.date, r.close, r.volume) for r in out] == [
        ("ABC", dt.date(2024, 1, 2), 1.5, 10), ("ABC", dt.date(2024, 1, 3), 1.6, 20),
    ]


def test_tickers_are_written_by_several_tasks(spark, sf_dir):
    option = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(option, "false")
    try:
        back = catalog.read_ticker_csv(spark, sf_dir)
    finally:
        spark.conf.unset(option)
    assert len(back.inputFiles()) > len(views.PRIORITIES)
    bars = views.bars(spark, sf_dir).select(back.columns)
    assert back.count() == bars.count() and bars.exceptAll(back).count() == 0


def test_csv_round_trip(spark, sf_dir, tmp_path):
    bars = views.bars(spark, sf_dir)
    tables.write_table(bars, str(tmp_path / "csv"), partition_by=(), fmt="csv")
    back = tables.read_bars(spark, str(tmp_path / "csv"), fmt="csv")
    assert back.count() == bars.count() and back.schema["date"].dataType.simpleString() == "date"
    assert bars.select(back.columns).exceptAll(back).count() == 0


def test_predicates_reach_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "bars")
    tables.write_table(views.bars(spark, sf_dir), path)
    df = tables.read_bars(spark, path, ["1-URGENT"], dt.date(1995, 2, 1), dt.date(1996, 1, 1)).select("close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan and "GreaterThanOrEqual(date" in plan
    assert "open" not in plan.split("ReadSchema")[1]


def test_catalog_choices(spark):
    a = spark.createDataFrame([("A", 1)], "ticker string, x int")
    b = spark.createDataFrame([("a", 2), ("A", 3), ("B", 4)], "ticker string, x int")
    assert [r.ticker for r in tables.list_datasets(b, a).collect()] == ["A"]
    assert sorted((r.ticker, r.x) for r in tables.first_available(a, b).collect()) == [("A", 1), ("B", 4), ("a", 2)]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql(
        "select clean_text('AAPL Beats — see https://x.co/a now!\\t') a, clean_text(null) b,"
        " clean_text_light(' A \\n b ') c, sentiment_category(0.05) d, sentiment_category(-0.2) e"
    ).first()
    assert tuple(row) == ("aapl beats see now!", "", "A b", "Positive", "Negative")


def test_texts_are_dealt_out_where_the_session_asks(spark, sf_dir):
    asked = int(spark.conf.get("spark.newstape.textTasks"))
    assert views.texts(spark, sf_dir).rdd.getNumPartitions() == asked
    spark.conf.unset("spark.newstape.textTasks")
    try:
        assert "Exchange" not in views.texts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.newstape.textTasks", str(asked))


def test_daily_job_writes_every_table(spark, sf_dir, tmp_path):
    config = JobConfig(str(tmp_path), dt.date(1999, 1, 1), views.WORD_VALENCES, finance=False, light=True)
    bars, news = views.bars(spark, sf_dir), views.news(spark, sf_dir)
    paths = run_daily_job(spark, bars, news, config, views.gazetteer(spark))
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    assert read["scored_news"].count() == news.count()
    assert read["features"].count() == read["bars"].count() == bars.count()
    assert read["daily_sentiment"].agg(F.sum("headline_count")).first()[0] == news.count()
    assert {"entity", "entity_type", "ticker", "date"} <= set(read["entities"].columns)
