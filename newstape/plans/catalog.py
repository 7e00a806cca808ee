"""Named queries over the benchmark tables, each next to the SQL that must give the same rows.

``QUERIES`` maps a name to ``f(spark, sf_dir) -> DataFrame``; ``ORACLES`` maps it to SQL text for an
engine that has the tables registered under their own names. Queries without SQL train models or
read HTML; the tests check those in other ways.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newstape.functions import dates, display, text
from newstape.functions.lexicon import BOOST, BOOSTERS, DAMPENERS, FINANCE_TERMS, NEGATIONS, STOP_WORDS
from newstape.functions.sql import register
from newstape.operators import (
    backtest,
    daily,
    entities,
    joins,
    modeling,
    network,
    ordering,
    profile,
    scans,
    sentiment,
    series,
    tagger,
)
from newstape.operators.blocks import over_blocks
from newstape.plans import reports
from newstape.plans.jobs import JobConfig, process_news, run_daily_job
from newstape.session import cut_lineage, shared_dir
from newstape.sources import models, pages, tables, views
from newstape.streaming import ema as stream_ema
from newstape.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REF = dt.date(1999, 6, 15)
START, END = dt.date(1995, 2, 1), dt.date(1996, 6, 30)
RANGE = f"date between date '{START}' and date '{END}'"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, special.get(c, digits)) for c in doubles}) if doubles else df


def sci(df: DataFrame, *columns: str) -> DataFrame:
    """Seven significant digits as text, for values that grow without bound."""
    return df.withColumns({c: F.format_string("%.6e", F.col(c)) for c in columns})


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


PUNCT_SQL = "'" + text.PUNCTUATION.replace("'", "''") + "'"
STRICT_SQL = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(headline, '')),"
    r" '(http|www)\S+', '', 'g'), '[^a-zA-Z0-9\s.,!?-]', '', 'g'), '\s+', ' ', 'g'))"
)
LIGHT_SQL = r"trim(regexp_replace(coalesce(headline, ''), '\s+', ' ', 'g'))"



def scored_sql(light: bool = False) -> str:
    """The scoring rules, step by step over one row per word. ``light`` keeps case and symbols."""
    boost = sql_list(BOOSTERS)
    damp = sql_list(DAMPENERS)
    negate = sql_list(NEGATIONS)
    known = "(select term from lexicon)"

    def step(into: str, frm: str, value: str, at: int, weight: float, special: str) -> str:
        word, caps = f"l{at}", f"u{at}"
        push = f"""(case when {word} in {boost} then {BOOST}::double when {word} in {damp} then -{BOOST}::double end
                    * sign({value}) + case when {caps} and some_caps then case when {value} > 0 then 0.733::double
                                      else -0.733::double end else 0 end) * {weight}::double"""
        return f"""{into} as (select *, case when pos > {at} and {word} not in {known} then
            ({value} + coalesce({push}, 0)) * case {special}
             when {word} in {negate} or contains({word}, 'n''t') then -0.74::double else 1 end else {value} end as {into}_v from {frm})"""

    two = "when l2 = 'never' and l1 in ('so', 'this') then 1.25::double when l2 = 'without' and l1 = 'doubt' then 1"
    three = """when (l3 = 'never' and l2 in ('so', 'this')) or l1 in ('so', 'this') then 1.25::double
               when l3 = 'without' and (l2 = 'doubt' or l1 = 'doubt') then 1"""
    return f"""
cleaned as (select *, {LIGHT_SQL if light else STRICT_SQL} as cleaned_text from news),
split as (select doc_id, string_split(cleaned_text, ' ') as l from cleaned where cleaned_text <> ''),
raw as (select doc_id, unnest(l) as w, unnest(range(1, len(l) + 1)) as pos from split),
bare as (select doc_id, pos, case when length(trim(w, {PUNCT_SQL})) <= 2 then w else trim(w, {PUNCT_SQL}) end as w from raw),
cased as (select doc_id, pos, lower(w) as low, w = upper(w) and w <> lower(w) as caps from bare),
near as (select b.*, l.valence as v, coalesce(lead(low) over p, '') as nx,
                coalesce(lag(low, 1) over p, '') as l1, coalesce(lag(low, 2) over p, '') as l2, coalesce(lag(low, 3) over p, '') as l3,
                lag(caps, 1) over p as u1, lag(caps, 2) over p as u2, lag(caps, 3) over p as u3
         from cased b left join lexicon l on l.term = b.low
         window p as (partition by doc_id order by pos)),
facts as (select doc_id, count(*) as n, min(pos) filter (low = 'but') as but,
                 count(*) filter (caps) between 1 and count(*) - 1 as some_caps from near group by 1),
h0 as (select near.*, some_caps, but, low in {boost} or low in {damp} or (low = 'kind' and nx = 'of') as zero,
              v + case when caps and some_caps then case when v > 0 then 0.733::double else -0.733::double end else 0 end as h0_v
       from near join facts using (doc_id) where v is not null),
{step("h1", "h0", "h0_v", 1, 1.0, "when false then 1")},
{step("h2", "h1", "h1_v", 2, 0.95, two)},
{step("h3", "h2", "h2_v", 3, 0.9, three)},
h4 as (select doc_id, pos, but, case when zero then 0 when l1 = 'least' and l1 not in {known}
                                and l2 not in ('at', 'very') then h3_v * -0.74::double else h3_v end as d from h3),
h5 as (select doc_id, d * case when but is null or pos = but then 1::double when pos < but then 0.5::double
                               else 1.5::double end as d from h4),
sums as (select doc_id, sum(d) as s, coalesce(sum(d + 1) filter (d > 0), 0) as p,
                coalesce(sum(d - 1) filter (d < 0), 0) as m, count(*) filter (d <> 0) as k from h5 group by 1),
marks as (select doc_id, least(length(cleaned_text) - length(replace(cleaned_text, '!', '')), 4) * 0.292::double
             + case when q <= 1 then 0 when q <= 3 then q * 0.18::double else 0.96::double end as e
          from (select *, length(cleaned_text) - length(replace(cleaned_text, '?', '')) as q from cleaned)),
parts as (select f.doc_id, coalesce(s, 0) + sign(coalesce(s, 0)) * e as s,
                 coalesce(p, 0) + case when coalesce(p, 0) > abs(coalesce(m, 0)) then e else 0 end as p,
                 coalesce(m, 0) - case when coalesce(p, 0) < abs(coalesce(m, 0)) then e else 0 end as m,
                 n - coalesce(k, 0) as u
          from facts f left join sums using (doc_id) join marks using (doc_id)),
scored as (select c.*, coalesce(round(s / sqrt(s * s + 15), 4), 0) as sentiment_compound,
                  coalesce(round(p / (p + abs(m) + u), 3), 0) as sentiment_positive,
                  coalesce(round(u / (p + abs(m) + u), 3), {0 if light else 1}) as sentiment_neutral,
                  coalesce(round(abs(m) / (p + abs(m) + u), 3), 0) as sentiment_negative
           from cleaned c left join parts using (doc_id))
"""


SCORED_SQL = scored_sql()
CATEGORY_SQL = "case when {0} >= 0.05 then 'Positive' when {0} <= -0.05 then 'Negative' else 'Neutral' end"
DAILY_SQL = f"""
daily as (select ticker, date, avg(sentiment_compound) as sentiment_score,
                 avg(sentiment_positive) as sentiment_positive, avg(sentiment_neutral) as sentiment_neutral,
                 avg(sentiment_negative) as sentiment_negative, stddev_samp(sentiment_compound) as sentiment_std,
                 count(headline) as headline_count,
                 {CATEGORY_SQL.format("avg(sentiment_compound)")} as sentiment_category
          from scored group by 1, 2)
"""
JOINED_SQL = """
joined as (select b.*, coalesce(d.sentiment_score, 0) as sentiment_score,
                  coalesce(d.headline_count, 0) as headline_count
           from bars b left join daily d using (ticker, date))
"""
CHANGES_SQL = """
changes as (select *, close / nullif(lag(close) over (partition by ticker order by date), 0) - 1 as price_change
            from joined)
"""
POINTS_SQL = "points as (select * from changes where price_change is not null)"
VIEWS = {
    "bars": f"bars as ({views.BARS_SQL})",
    "news": f"news as ({views.NEWS_SQL})",
    "lexicon": f"lexicon as ({views.LEXICON_SQL})",
    "entities": f"entities as ({views.ENTITIES_SQL})",
    "ticks": f"ticks as ({views.TICKS_SQL})",
    "scored": SCORED_SQL,
    "daily": DAILY_SQL,
    "joined": JOINED_SQL,
    "changes": CHANGES_SQL,
    "points": POINTS_SQL,
}
NEEDS = {
    "scored": ("news", "lexicon"),
    "daily": ("scored",),
    "joined": ("bars", "daily"),
    "changes": ("joined",),
    "points": ("changes",),
}


def sql(body: str, *names: str, recursive: bool = False, extra: str = "") -> str:
    """SQL text with the named views (and what they need) in front."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    ctes = [VIEWS[n].strip() for n in ordered] + ([extra.strip()] if extra else [])
    head = "with " + ("recursive " if recursive else "")
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


def scored(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.score_news(views.texts(spark, d), views.WORD_VALENCES, finance=False)


def day_scores(spark: SparkSession, d: str) -> DataFrame:
    return daily.daily_sentiment(scored(spark, d))


def joined(spark: SparkSession, d: str) -> DataFrame:
    scores = day_scores(spark, d).select("ticker", "date", "sentiment_score", "headline_count")
    return joins.join_sentiment(views.bars(spark, d), scores)


def changes(spark: SparkSession, d: str) -> DataFrame:
    return series.pct_change(joined(spark, d), "close", "price_change")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for a query that writes."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources --------------------------------------------------------------------------------------

BAR_COLUMNS = "ticker, date, open, high, low, close, volume"


@query("bars_scan", sql(f"select {BAR_COLUMNS} from bars", "bars"))
def bars_scan(spark, d):
    return views.bars(spark, d)


@query(
    "bars_selected",
    sql(f"select {BAR_COLUMNS} from bars where ticker in ('1-URGENT', '5-LOW') and {RANGE}", "bars"),
)
def bars_selected(spark, d):
    return tables.select_bars(views.bars(spark, d), ["1-URGENT", "5-LOW"], START, END)


@query("news_scan", sql("select doc_id, ticker, date, headline, source from news", "news"))
def news_scan(spark, d):
    return views.news(spark, d)


@query("write_and_read_bars", sql(f"select {BAR_COLUMNS} from bars", "bars"))
def write_and_read_bars(spark, d):
    path = scratch(spark, "bars")
    tables.write_table(views.bars(spark, d), path)
    return tables.read_bars(spark, path).select(*BAR_COLUMNS.split(", "))


@query("read_bars_csv", sql(f"select {BAR_COLUMNS} from bars", "bars"))
def read_bars_csv(spark, d):
    path = scratch(spark, "bars-csv")
    tables.write_table(views.bars(spark, d), path, partition_by=(), fmt="csv")
    return tables.read_bars(spark, path, fmt="csv").select(*BAR_COLUMNS.split(", "))


@query("read_ticker_csv", sql(f"select {BAR_COLUMNS} from bars", "bars"))
def read_ticker_csv(spark, d):
    """CSV files of each ticker, named like it, without a ticker column: one from each task that has rows of it."""
    path = scratch(spark, "ticker-csv")
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    views.bars(spark, d).write.partitionBy("ticker").option("header", True).csv(f"{path}/parts")
    store.mkdirs(hadoop.Path(f"{path}/files"))
    for ticker in views.PRIORITIES:
        part = hadoop.Path(f"{path}/parts/ticker={ticker}")
        written = [f.getPath() for f in store.listStatus(part)] if store.exists(part) else []
        for number, file in enumerate(f for f in written if f.getName().startswith("part-")):
            store.rename(file, hadoop.Path(f"{path}/files/{ticker}_stock_data_{number}.csv"))
    return tables.read_ticker_files(spark, f"{path}/files").select(*BAR_COLUMNS.split(", "))


@query("header_rows", sql("select ticker, date, close, volume from bars where volume > 0", "bars"))
def header_rows(spark, d):
    bars = views.bars(spark, d).select("ticker", "date", "close", "volume")
    typed = bars.select([F.col(c).cast("string") for c in bars.columns])
    header = typed.groupBy("ticker").agg(
        F.lit("date").alias("date"), F.first("ticker").alias("close"), F.lit("volume").alias("volume")
    )
    shape = "ticker string, date date, close double, volume bigint"
    return tables.drop_header_rows(typed.unionByName(header), shape)


@query(
    "normalize_columns",
    sql("select ticker, date, close, volume, sentiment_score from joined", "joined").replace(
        "sentiment_score from joined", "round(sentiment_score, 6) as sentiment_score from joined"
    ),
)
def normalize(spark, d):
    from newstape.schema import normalize_columns

    odd = joined(spark, d).select(
        F.col("ticker").alias("Ticker"),
        F.col("date").alias("Timestamp"),
        F.col("close").alias("Close_ABC"),
        F.col("volume").alias("Vol"),
        F.col("sentiment_score").alias("Compound"),
    )
    return rounded(normalize_columns(odd, ticker="ABC"), sentiment_score=6, close=2)


@query(
    "list_datasets",
    sql(
        "select distinct upper(ticker) as ticker from bars where ticker in (select ticker from news)",
        "bars",
        "news",
    ),
)
def list_datasets(spark, d):
    return tables.list_datasets(views.bars(spark, d), views.news(spark, d))


@query(
    "first_available",
    sql(
        f"""select {BAR_COLUMNS} from bars where ticker < '3' union all
            select ticker, date, open, high, low, close + 1, volume from bars where ticker >= '3'""",
        "bars",
    ),
)
def first_available(spark, d):
    bars = views.bars(spark, d)
    return tables.first_available(bars.where("ticker < '3'"), bars.withColumn("close", F.col("close") + 1))


# --- functions ------------------------------------------------------------------------------------


@query("clean_text", sql(f"select doc_id, {STRICT_SQL} as cleaned_text from news", "news"))
def clean_strict(spark, d):
    return views.texts(spark, d).select("doc_id", text.clean_text("headline").alias("cleaned_text"))


@query("clean_text_light", sql(f"select doc_id, {LIGHT_SQL} as cleaned_text from news", "news"))
def clean_light(spark, d):
    return views.texts(spark, d).select("doc_id", text.clean_text_light("headline").alias("cleaned_text"))


@query("truncate_text", sql("select doc_id, substring(headline, 1, 1000) as shortened from news", "news"))
def truncate(spark, d):
    return views.news(spark, d).select("doc_id", text.truncate_text("headline").alias("shortened"))


@query("sql_functions", sql(f"select doc_id, {STRICT_SQL} as strict, {LIGHT_SQL} as light from news", "news"))
def sql_functions(spark, d):
    register(spark)
    return views.texts(spark, d).selectExpr(
        "doc_id", "clean_text(headline) as strict", "clean_text_light(headline) as light"
    )


# Date cells in every spelling, derived from the headlines' dates.
CELLS_SQL = """
cells as (select doc_id, ticker, date,
                 case when doc_id % 7 = 0 then 'Today' when doc_id % 7 = 1 then 'Yesterday'
                      when doc_id % 7 = 2 then strftime(date, '%b-%d-%y') when doc_id % 7 = 3 then strftime(date, '%b-%d')
                      when doc_id % 7 = 4 then strftime(date, '%b-%d-%Y') when doc_id % 7 = 5 then strftime(date, '%Y-%m-%d')
                      else 'n/a' end as cell
          from news)
"""


def date_cells(spark, d):
    kind = F.col("doc_id") % 7
    return views.news(spark, d).select(
        "doc_id",
        "ticker",
        "date",
        F.when(kind == 0, "Today")
        .when(kind == 1, "Yesterday")
        .when(kind == 2, F.date_format("date", "MMM-dd-yy"))
        .when(kind == 3, F.date_format("date", "MMM-dd"))
        .when(kind == 4, F.date_format("date", "MMM-dd-yyyy"))
        .when(kind == 5, F.date_format("date", "yyyy-MM-dd"))
        .otherwise("n/a")
        .alias("cell"),
    )


@query(
    "news_date_parse",
    sql(
        f"""select doc_id, cell, case doc_id % 7 when 0 then date '{REF}' when 1 then date '{REF}' - 1
                when 2 then date when 3 then make_date(1999, month(date), day(date)) end::date as parsed from cells""",
        "news",
        extra=CELLS_SQL,
    ),
)
def news_date_parse(spark, d):
    cells = date_cells(spark, d)
    return cells.select("doc_id", "cell", dates.parse_news_date("cell", REF).alias("parsed"))


@query(
    "fix_dates",
    sql(
        f"""select doc_id, cell, case when doc_id % 7 = 1 then date '{REF}' - 1
                when doc_id % 7 in (2, 4, 5) then date else date '{REF}' end::date as fixed from cells""",
        "news",
        extra=CELLS_SQL,
    ),
)
def fix_dates(spark, d):
    cells = date_cells(spark, d)
    return cells.select("doc_id", "cell", dates.fix_dates("cell", REF).alias("fixed"))


@query(
    "split_datetime_cell",
    sql(
        """select doc_id, case when doc_id % 3 > 0 then strftime(date, '%b-%d-%y') end as date_text,
                  '09:30AM' as time_text,
                  case when doc_id % 3 > 0 then strftime(date, '%b-%d-%y') else '09:30AM' end as page_date,
                  case when doc_id % 3 > 0 then '09:30AM' else 'N/A' end as page_time,
                  case when doc_id % 3 > 0 then date end as clock_date, '09:30' as clock_time
           from news""",
        "news",
    ),
)
def split_cell(spark, d):
    cell = F.when(
        F.col("doc_id") % 3 > 0, F.concat(F.date_format("date", "MMM-dd-yy"), F.lit(" 09:30AM"))
    ).otherwise("09:30AM")
    cells = views.news(spark, d).select("doc_id", cell.alias("cell"))
    parts = cells.select(
        "doc_id",
        dates.split_datetime_cell("cell").alias("t"),
        dates.split_datetime_cell("cell", "page").alias("p"),
        dates.parse_cell_time("cell", REF).alias("c"),
    )
    return parts.select(
        "doc_id",
        "t.date_text",
        "t.time_text",
        F.col("p.date_text").alias("page_date"),
        F.col("p.time_text").alias("page_time"),
        F.col("c.date").alias("clock_date"),
        F.col("c.time").alias("clock_time"),
    )


@query(
    "parse_date_input",
    sql(
        "select o_orderkey, cast(o_orderdate as date) as parsed, null::date as wrong from orders"
    ),
)
def parse_date_input(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return views.table(spark, d, "orders").select(
        "o_orderkey",
        dates.parse_date_input(iso).alias("parsed"),
        dates.parse_date_input(F.concat(F.lit("x"), iso)).alias("wrong"),
    )


@query("date_range", sql(f"select {BAR_COLUMNS} from bars where {RANGE}", "bars"))
def date_range(spark, d):
    return views.bars(spark, d).where(dates.in_date_range("date", START, END))


@query(
    "drop_invalid_dates",
    sql("select doc_id, ticker, date from cells where doc_id % 7 = 5", "news", extra=CELLS_SQL),
)
def drop_invalid_dates(spark, d):
    cells = date_cells(spark, d).select("doc_id", "ticker", F.col("cell").alias("date"))
    return tables.drop_invalid_dates(cells)


@query(
    "display_bars",
    sql(
        """select ticker, strftime(date, '%Y-%m-%d') as date, '$' || printf('%.2f', round(open, 2)) as open,
                  '$' || printf('%.2f', round(high, 2)) as high, '$' || printf('%.2f', round(low, 2)) as low,
                  '$' || printf('%.2f', round(close, 2)) as close, format('{:,}', volume) as volume from bars""",
        "bars",
    ),
)
def display_bars(spark, d):
    return display.display_bars(views.bars(spark, d))


RATIOS_SQL = """(high - low) / nullif(open, 0) as high_low_ratio, (close - open) / nullif(open, 0) as close_to_open,
                volume * close as volume_price_ratio"""


@query(
    "ohlc_ratios",
    sql(
        """select ticker, date, round((high - low) / nullif(open, 0), 6) as high_low_ratio,
                  round((close - open) / nullif(open, 0), 6) as close_to_open,
                  round(volume * close, 2) as volume_price_ratio from bars""",
        "bars",
    ),
)
def ohlc(spark, d):
    out = series.ohlc_ratios(views.bars(spark, d))
    return rounded(
        out.select("ticker", "date", "high_low_ratio", "close_to_open", "volume_price_ratio"), volume_price_ratio=2
    )


@query(
    "polarity_fallback",
    sql(
        "select doc_id, round(sentiment_positive - sentiment_negative, 6) as polarity from scored",
        "scored",
    ),
)
def polarity(spark, d):
    out = scored(spark, d)
    return rounded(
        out.select("doc_id", profile.polarity_fallback("sentiment_positive", "sentiment_negative").alias("polarity"))
    )


# --- text analytics -------------------------------------------------------------------------------

SCORE_COLUMNS = "sentiment_compound, sentiment_positive, sentiment_neutral, sentiment_negative"
UNIGRAM_SQL = f"""
cleaned as (select *, {STRICT_SQL} as cleaned_text from news),
split as (select doc_id, string_split(cleaned_text, ' ') as l from cleaned where cleaned_text <> ''),
raw as (select doc_id, unnest(l) as w from split),
bare as (select doc_id, case when length(trim(w, {PUNCT_SQL})) <= 2 then w else trim(w, {PUNCT_SQL}) end as low from raw),
sums as (select doc_id, coalesce(sum(valence), 0) as s, coalesce(sum(valence + 1) filter (valence > 0), 0) as p,
                coalesce(sum(1 - valence) filter (valence < 0), 0) as m,
                count(*) filter (valence is null or valence = 0) as u
         from bare left join lexicon on term = low group by 1)
"""
UNIGRAM_BODY = """
select doc_id, coalesce(round(s / sqrt(s * s + 15), 4), 0) as sentiment_compound,
       coalesce(round(p / (p + m + u), 3), 0) as sentiment_positive,
       coalesce(round(u / (p + m + u), 3), 1) as sentiment_neutral,
       coalesce(round(m / (p + m + u), 3), 0) as sentiment_negative
from cleaned left join sums using (doc_id)
"""


@query("lexicon_unigram", sql(UNIGRAM_BODY, "news", "lexicon", extra=UNIGRAM_SQL))
def lexicon_unigram(spark, d):
    out = sentiment.score_news(views.texts(spark, d), views.WORD_VALENCES, finance=False, rules=False)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


@query("lexicon_table", sql(UNIGRAM_BODY, "news", "lexicon", extra=UNIGRAM_SQL))
def lexicon_table(spark, d):
    cleaned = views.texts(spark, d).select("doc_id", text.clean_text("headline").alias("cleaned_text"))
    out = sentiment.lexicon_score_table(cleaned, views.lexicon(spark), rules=False, empty_neutral=1.0)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


@query("lexicon_table_join", sql(UNIGRAM_BODY, "news", "lexicon", extra=UNIGRAM_SQL))
def lexicon_table_join(spark, d):
    """The lexicon as a stored table."""
    cleaned = views.texts(spark, d).select("doc_id", text.clean_text("headline").alias("cleaned_text"))
    path = scratch(spark, "lexicon")
    views.lexicon(spark).write.parquet(path)
    stored = spark.read.parquet(path)
    out = sentiment.lexicon_score_table(cleaned, stored, rules=False, empty_neutral=1.0)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


# Other spellings and weaker repetitions of the same terms.
MIXED_TERMS = [(t.title(), v) for t, v in views.WORD_VALENCES.items()] + [(t.upper(), v / 2) for t, v in views.WORD_VALENCES.items()]


@query("lexicon_mixed_case", sql(UNIGRAM_BODY, "news", "lexicon", extra=UNIGRAM_SQL))
def lexicon_mixed_case(spark, d):
    """A table with capitals and repeated terms scores like the plain list."""
    lexicon = spark.createDataFrame(MIXED_TERMS, "term string, valence double")
    cleaned = views.texts(spark, d).select("doc_id", text.clean_text("headline").alias("cleaned_text"))
    out = sentiment.lexicon_score_table(cleaned, lexicon, rules=False, empty_neutral=1.0)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


@query("lexicon_mixed_case_list", sql(UNIGRAM_BODY, "news", "lexicon", extra=UNIGRAM_SQL))
def lexicon_mixed_case_list(spark, d):
    out = sentiment.score_news(views.texts(spark, d), dict(MIXED_TERMS), finance=False, rules=False)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


PHRASES = {"of the": 1.5, "in the": -2.0, "the": 0.5, "que la": -1.0, "der": 1.0}
PHRASE_SQL = (
    "lexicon as (select * from (values "
    + ", ".join(f"('{t}', cast({v} as double))" for t, v in PHRASES.items())
    + ") as t(term, valence)),"
    + UNIGRAM_SQL.replace("unnest(l) as w from split", "unnest(l) as w, unnest(range(len(l))) as pos from split")
    .replace("select doc_id, case when", "select doc_id, pos, case when")
    .replace(
        "sums as (",
        """pairs as (select doc_id, low, low || ' ' || lead(low) over (partition by doc_id order by pos) as pair from bare),
valued as (select doc_id, coalesce(p.valence, l.valence) as valence
           from pairs left join lexicon p on p.term = pair left join lexicon l on l.term = low),
sums as (""",
    )
    .replace("from bare left join lexicon on term = low group by 1", "from valued group by 1")
)


@query("lexicon_phrases", sql(UNIGRAM_BODY, "news", extra=PHRASE_SQL))
def lexicon_phrases(spark, d):
    lexicon = spark.createDataFrame(list(PHRASES.items()), "term string, valence double")
    cleaned = views.texts(spark, d).select("doc_id", text.clean_text("headline").alias("cleaned_text"))
    out = sentiment.lexicon_score_table(cleaned, lexicon, rules=False, empty_neutral=1.0, match_phrases=True)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


@query("lexicon_phrases_list", sql(UNIGRAM_BODY, "news", extra=PHRASE_SQL))
def lexicon_phrases_list(spark, d):
    out = sentiment.score_news(views.texts(spark, d), PHRASES, finance=False, rules=False, match_phrases=True)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


@query(
    "lexicon_large",
    sql(
        UNIGRAM_BODY,
        "news",
        extra=r"""lexicon as (
            select w as term, (length(w) % 9 - 4) * 0.5::double as valence
            from (select distinct unnest(string_split_regex(lower(headline), '[^\p{L}\p{N}_]+')) as w from news)
            where regexp_full_match(w, '[a-z]{3,}')),"""
        + UNIGRAM_SQL,
    ),
)
def lexicon_large(spark, d):
    """A lexicon with a valence for every plain word of the texts (tens of thousands of terms)."""
    news = views.texts(spark, d)
    words = news.select(F.explode(text.plain_words("headline")).alias("term")).where(F.col("term").rlike("^[a-z]{3,}$")).distinct()
    lexicon = words.select("term", ((F.length("term") % 9 - 4) * 0.5).alias("valence"))
    cleaned = news.select("doc_id", text.clean_text("headline").alias("cleaned_text"))
    out = sentiment.lexicon_score_table(cleaned, lexicon, rules=False, empty_neutral=1.0)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


@query(
    "score_news",
    sql(
        f"""select doc_id, ticker, date, {SCORE_COLUMNS},
                   {CATEGORY_SQL.format("sentiment_compound")} as sentiment_category from scored""",
        "scored",
    ),
)
def score_news(spark, d):
    return scored(spark, d).select("doc_id", "ticker", "date", *SCORE_COLUMNS.split(", "), "sentiment_category")


FINANCE_SQL = "lexicon as (select * from (values " + ", ".join(
    f"('{t}', cast({v} as double))" for t, v in FINANCE_TERMS.items()
) + ") as t(term, valence))"


@query(
    "score_news_finance",
    sql(
        UNIGRAM_BODY.replace("sentiment_neutral", "sentiment_neutral").replace(", 3), 1)", ", 3), 0)"),
        "news",
        extra=FINANCE_SQL + "," + UNIGRAM_SQL,
    ),
)
def score_news_finance(spark, d):
    out = sentiment.score_news(views.texts(spark, d), finance=True, rules=False)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


@query(
    "score_news_finance_words",
    sql(UNIGRAM_BODY.replace(", 3), 1)", ", 3), 0)"), "news", "lexicon", extra=UNIGRAM_SQL),
)
def score_news_finance_words(spark, d):
    """The finance terms laid over a lexicon of words that occur (the finance terms do not)."""
    out = sentiment.score_news(views.texts(spark, d), views.WORD_VALENCES, finance=True, rules=False)
    return out.select("doc_id", *SCORE_COLUMNS.split(", "))


@query(
    "score_news_light",
    sql(
        f"""select doc_id, ticker, date, {SCORE_COLUMNS},
                   {CATEGORY_SQL.format("sentiment_compound")} as sentiment_category from scored""",
        "news",
        "lexicon",
        extra=scored_sql(light=True),
    ),
)
def score_news_light(spark, d):
    out = sentiment.score_news_light(views.texts(spark, d), views.WORD_VALENCES)
    return out.select("doc_id", "ticker", "date", *SCORE_COLUMNS.split(", "), "sentiment_category")


@query(
    "finance_lexicon",
    sql(
        """select w as term, count(*) as uses from (select unnest(string_split_regex(lower(headline), '[^\\p{L}\\p{N}_]+')) as w from news)
           where w in (select term from lexicon) group by 1""",
        "news",
        extra="lexicon as ("
        + views.LEXICON_SQL
        + " where term not in "
        + sql_list(FINANCE_TERMS)
        + " union all select * from (values "
        + ", ".join(f"('{t}', cast({v} as double))" for t, v in FINANCE_TERMS.items())
        + ") as f(term, valence))",
    ),
)
def finance_lexicon(spark, d):
    from newstape.functions.lexicon import finance_lexicon as merged

    words = views.texts(spark, d).select(F.explode(text.plain_words("headline")).alias("term"))
    uses = words.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(merged(spark, views.lexicon(spark)).select("term"), "term", "left_semi")


@query(
    "category_summary",
    sql(
        f"""select sentiment_category, count(*) as headlines, round(avg(sentiment_compound), 6) as avg_compound
            from (select *, {CATEGORY_SQL.format("sentiment_compound")} as sentiment_category from scored) group by 1""",
        "scored",
    ),
)
def category_summary(spark, d):
    return rounded(sentiment.category_summary(scored(spark, d)))


WORDS_SQL = r"""
words as (select doc_id, ticker, unnest(l) as word, unnest(range(len(l))) as pos
          from (select *, string_split_regex(lower(headline), '[^\p{L}\p{N}_]+') as l from news)),
""" + f"""
topics as (select ticker, doc_id, pos, word from words
           where regexp_full_match(word, '[a-z]{{3,}}') and word not in {sql_list(STOP_WORDS)})
"""


@query(
    "topics_top10",
    sql(
        """select word, count(*) as occurrences from topics group by word
           order by count(*) desc, min(doc_id * 1000000 + pos) limit 10""",
        "news",
        extra=WORDS_SQL,
    ),
)
def topics_top10(spark, d):
    return sentiment.extract_topics(views.texts(spark, d), 10)


@query(
    "topics_by_ticker",
    sql(
        """select * from (select ticker, word, count(*) as occurrences,
                  cast(row_number() over (partition by ticker order by count(*) desc, min(doc_id * 1000000 + pos)) as int) as rank
           from topics group by 1, 2) where rank <= 5""",
        "news",
        extra=WORDS_SQL,
    ),
)
def topics_by_ticker(spark, d):
    return sentiment.extract_topics_by(views.texts(spark, d), ["ticker"], 5)


ENTITY_SQL = (
    "found as ("
    + " union all ".join(
        f"select doc_id, unnest(regexp_extract_all(t, '{p}')) as entity, '{k}' as entity_type, {i} as o from light"
        for i, (k, p) in enumerate(entities.PATTERNS.items())
    )
    + " union all select doc_id, g.entity, g.entity_type, 3 from grams join gaz g on g.entity = grams.gram)"
)
EXTRACT_SQL = (
    f"""
light as (select doc_id, ticker, date, {LIGHT_SQL} as t from news),
pieces as (select doc_id, string_split_regex(trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}&'' -]+', ' ', 'g')), ' +') as l from light),
gwords as (select doc_id, unnest(l) as w, unnest(range(len(l))) as pos from pieces),
lagged as (select doc_id, w, lead(w, 1) over p as w1, lead(w, 2) over p as w2 from gwords
           window p as (partition by doc_id order by pos)),
grams as (select doc_id, w as gram from lagged union all select doc_id, w || ' ' || w1 from lagged where w1 is not null
          union all select doc_id, w || ' ' || w1 || ' ' || w2 from lagged where w2 is not null),
gaz as (select * from (values """
    + ", ".join(f"('{e}', '{k}')" for e, k in views.GAZETTEER.items())
    + ") as t(entity, entity_type)),\n"
    + ENTITY_SQL
    + """,
ents as (select doc_id, entity, entity_type from (
           select *, row_number() over (partition by doc_id, entity order by o desc, entity_type desc) as r
           from found where length(entity) >= 2) where r = 1)
"""
)


@query(
    "extract_entities",
    sql("select doc_id, ticker, date, entity, entity_type from ents join light using (doc_id)", "news", extra=EXTRACT_SQL),
)
def extract_entities(spark, d):
    return entities.extract_entities(
        views.texts(spark, d), gazetteer=views.gazetteer(spark), keep=("ticker", "date")
    )


# Names of one to six words: the first words of the benchmark's items, which some documents hold.
LONG_NAMES_SQL = r"""
gaz as (select distinct array_to_string(l[1:1 + item_id % 6], ' ') as entity,
               case item_id % 3 when 0 then 'ORG' when 1 then 'PERSON' else 'GPE' end as entity_type
        from (select item_id, string_split_regex(trim(regexp_replace(text, '[^\p{L}\p{N}&'' -]+', ' ', 'g')), ' +') as l from benchmark)),
light as (select doc_id, ticker, date, trim(regexp_replace(coalesce(headline, ''), '\s+', ' ', 'g')) as t,
                 ' ' || array_to_string(string_split_regex(trim(regexp_replace(headline, '[^\p{L}\p{N}&'' -]+', ' ', 'g')), ' +'), ' ') || ' ' as plain
          from news),
found as (""" + " union all ".join(
    f"select doc_id, ticker, date, unnest(regexp_extract_all(t, '{p}')) as entity, '{k}' as entity_type, {i} as o from light"
    for i, (k, p) in enumerate(entities.PATTERNS.items())
) + """ union all select doc_id, ticker, date, entity, entity_type, 3 from light join gaz on contains(plain, ' ' || entity || ' '))
"""


@query(
    "extract_entities_long_names",
    sql(
        """select doc_id, ticker, date, entity, entity_type from (
             select *, row_number() over (partition by doc_id, entity order by o desc, entity_type desc) as r
             from found where length(entity) >= 2) where r = 1""",
        "news",
        extra=LONG_NAMES_SQL,
    ),
)
def extract_entities_long_names(spark, d):
    plain = F.regexp_replace("text", r"[^\p{L}\p{N}&' -]+", " ")
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    kind = F.get(F.array(F.lit("ORG"), F.lit("PERSON"), F.lit("GPE")), (F.col("item_id") % 3).cast("int"))
    size = (F.col("item_id") % 6 + 1).cast("int")
    names = views.table(spark, d, "benchmark").select(F.array_join(F.slice(words, F.lit(1), size), " ").alias("entity"), kind.alias("entity_type"))
    return entities.extract_entities(views.texts(spark, d), gazetteer=names.distinct(), keep=("ticker", "date"))


# The same names as they stand in the items, with all their marks, and pieces of them that overlap.
MARKED_SQL = LONG_NAMES_SQL.replace(
    LONG_NAMES_SQL[: LONG_NAMES_SQL.index("light as")],
    r"""
raws as (select item_id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as l from benchmark),
gaz as (select distinct entity, entity_type, trim(regexp_replace(entity, '[^\p{L}\p{N}&''-]+', ' ', 'g')) as form from (
          select array_to_string(l[1:1 + item_id % 6], ' ') as entity, 'ORG' as entity_type from raws union all
          select array_to_string(l[2:4], ' ') || '.', 'GPE' from raws union all
          select '"' || array_to_string(l[3:5], ' ') || '!"', 'PERSON' from raws)),
""",
).replace("contains(plain, ' ' || entity || ' ')", "form <> '' and contains(plain, ' ' || form || ' ')")


@query(
    "extract_entities_with_marks",
    sql(
        """select doc_id, ticker, date, entity, entity_type from (
             select *, row_number() over (partition by doc_id, entity order by o desc, entity_type desc) as r
             from found where length(entity) >= 2) where r = 1""",
        "news",
        extra=MARKED_SQL,
    ),
)
def extract_entities_with_marks(spark, d):
    """Names with dots, quotes and other marks, nested and overlapping."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    items = views.table(spark, d, "benchmark").select("item_id", words.alias("l"))

    def part(entity, kind):
        return items.select(entity.alias("entity"), F.lit(kind).alias("entity_type"))

    def piece(start, size):
        return F.array_join(F.slice("l", F.lit(start), size), " ")

    names = part(piece(1, (F.col("item_id") % 6 + 1).cast("int")), "ORG")
    names = names.union(part(F.concat(piece(2, F.lit(3)), F.lit(".")), "GPE"))
    names = names.union(part(F.concat(F.lit('"'), piece(3, F.lit(3)), F.lit('!"')), "PERSON"))
    return entities.extract_entities(views.texts(spark, d), gazetteer=names.distinct(), keep=("ticker", "date"))


@query(
    "entity_type_counts",
    sql("select entity_type, count(*) as occurrences from ents group by 1", "news", extra=EXTRACT_SQL),
)
def entity_type_counts(spark, d):
    return entities.entity_type_counts(extract_entities(spark, d))


@query(
    "entities_by_model",
    sql(
        """select ticker, count(*) as entities from (
             select distinct ticker, doc_id, unnest(regexp_extract_all(headline, '[A-Z][a-z]{2,}')) from news) group by 1""",
        "news",
    ),
)
def entities_by_model(spark, d):
    """Model mode with a small stand-in: capitalised words are taken for organisations."""

    def load():
        import re

        word = re.compile(r"[A-Z][a-z]{2,}")
        return lambda body: [(w, "ORG") for w in word.findall(body)]

    found = entities.extract_entities(views.texts(spark, d), load_model=load, keep=("ticker",))
    return found.groupBy("ticker").agg(F.count(F.lit(1)).alias("entities"))


@query("entities_by_tagger")
def entities_by_tagger(spark, d):
    """Entities of all whole texts by a tagger that has learnt from gazetteer hits."""
    learnt = tagger.train_tagger(views.texts(spark, d), views.gazetteer(spark))
    return entities.extract_entities(views.texts(spark, d), load_model=lambda: learnt, keep=("ticker", "date"))


@query(
    "entity_top",
    sql(
        """select entity, count(*) as occurrences from entities
           where entity_type = (select min(entity_type) from entities)
           group by entity order by count(*) desc, min(row_id), entity limit 5""",
        "entities",
    ),
)
def entity_top(spark, d):
    ents = views.entities(spark, d)
    kind = views.table(spark, d, "part").agg(F.min("p_type")).first()[0]
    return entities.top_entities(ents, kind, 5)


# --- series ---------------------------------------------------------------------------------------


def frame(n: int) -> str:
    return f"(partition by ticker order by date rows between {n - 1} preceding and current row)"


def sma_sql(n: int, name: str, source: str = "close") -> str:
    return f"case when count({source}) over {frame(n)} = {n} then round(avg({source}) over {frame(n)}, 4) end as {name}"


@query(
    "sma20_50",
    sql(f"select ticker, date, close, {sma_sql(20, 'sma20')}, {sma_sql(50, 'sma50')} from bars", "bars"),
)
def sma20_50(spark, d):
    out = series.sma(views.bars(spark, d).select("ticker", "date", "close"))
    return rounded(out, 4, close=2)


@query(
    "rolling_mean5",
    sql(f"select ticker, date, round(avg(close) over {frame(5)}, 3) as mean5 from bars", "bars"),
)
def rolling_mean5(spark, d):
    out = series.rolling_mean(views.bars(spark, d), {"mean5": "close"}, 5)
    return rounded(out.select("ticker", "date", "mean5"), 3)


STD20 = f"case when count(close) over {frame(20)} = 20 then stddev_samp(close) over {frame(20)} end"


@query("rolling_std20", sql(f"select ticker, date, round({STD20}, 3) as std20 from bars", "bars"))
def rolling_std20(spark, d):
    return rounded(series.rolling_std(views.bars(spark, d)).select("ticker", "date", "std20"), 3)


@query(
    "bollinger",
    sql(
        """select ticker, date, round(m, 4) as bb_middle, round(s, 3) as bb_std, round(m + 2 * s, 3) as bb_upper,
                  round(m - 2 * s, 3) as bb_lower from b""",
        "bars",
        extra=f"""b as (select *, case when count(close) over {frame(20)} = 20 then avg(close) over {frame(20)} end as m,
                  {STD20} as s from bars)""",
    ),
)
def bollinger(spark, d):
    out = series.bollinger(views.bars(spark, d))
    return rounded(out.select("ticker", "date", "bb_middle", "bb_std", "bb_upper", "bb_lower"), 3, bb_middle=4)


RSI_SQL = f"""
delta as (select ticker, date, coalesce(close - lag(close) over (partition by ticker order by date), 0) as dd from bars),
gl as (select ticker, date, count(*) over {frame(14)} as n, avg(greatest(dd, 0)) over {frame(14)} as g,
              avg(greatest(-dd, 0)) over {frame(14)} as l from delta)
"""
RSI_VALUE = "case when n < 14 or (g = 0 and l = 0) then null when l = 0 then 100 else 100 - 100 / (1 + g / l) end"


@query("rsi14", sql(f"select ticker, date, round({RSI_VALUE}, 5) as rsi14 from gl", "bars", extra=RSI_SQL))
def rsi14(spark, d):
    return rounded(series.rsi(views.bars(spark, d)).select("ticker", "date", "rsi14"), 5)


EMA_SQL = """
s as (select ticker, date, close, row_number() over (partition by ticker order by date) as i from bars),
e as (select ticker, i, close as e12, close as e26, 0::double as sig from s where i = 1
      union all
      select s.ticker, s.i, s.close * (2::double / 13) + e.e12 * (11::double / 13),
             s.close * (2::double / 27) + e.e26 * (25::double / 27),
             (s.close * (2::double / 13) + e.e12 * (11::double / 13)
              - s.close * (2::double / 27) - e.e26 * (25::double / 27)) * 0.2::double + e.sig * 0.8::double
      from e join s on s.ticker = e.ticker and s.i = e.i + 1)
"""


@query(
    "ema12",
    sql(
        "select ticker, date, round(e12, 3) as ema12, round(e26, 3) as ema26 from e join s using (ticker, i)",
        "bars",
        recursive=True,
        extra=EMA_SQL,
    ),
)
def ema12(spark, d):
    out = scans.ema(views.bars(spark, d), {"ema12": ("close", 12), "ema26": ("close", 26)})
    return rounded(out.select("ticker", "date", "ema12", "ema26"), 3)


@query(
    "macd",
    sql(
        """select ticker, date, round(e12 - e26, 2) as macd, round(sig, 2) as macd_signal,
                  round(e12 - e26 - sig, 2) as macd_hist from e join s using (ticker, i)""",
        "bars",
        recursive=True,
        extra=EMA_SQL,
    ),
)
def macd(spark, d):
    out = series.macd(views.bars(spark, d))
    return rounded(out.select("ticker", "date", "macd", "macd_signal", "macd_hist"), 2)


@query(
    "macd_equal_spans",
    sql(
        """select ticker, date, round(e12 - e26, 2) as macd, round(sig, 2) as macd_signal,
                  round(e12 - e26 - sig, 2) as macd_hist from e join s using (ticker, i)""",
        "bars",
        recursive=True,
        extra=EMA_SQL.replace("(2::double / 13)", "(2::double / 10)").replace("(11::double / 13)", "(8::double / 10)"),
    ),
)
def macd_equal_spans(spark, d):
    """The fast span equals the signal's."""
    out = series.macd(views.bars(spark, d), fast=9)
    return rounded(out.select("ticker", "date", "macd", "macd_signal", "macd_hist"), 2)


# Bars of which one ticker is unknown.
UNKNOWN_SQL = "unknown as (select * replace (nullif(ticker, '5-LOW') as ticker) from bars)"


def bars_unknown(spark, d):
    return views.bars(spark, d).withColumn("ticker", F.nullif("ticker", F.lit("5-LOW")))


@query(
    "null_ticker_changes",
    sql(
        """select ticker, date, round(close / nullif(lag(close) over w, 0) - 1, 6) as close_pct,
                  case when row_number() over w - 1 < floor(count(*) over (partition by ticker) * (1 - 0.2::double)) then 'train' else 'test' end as role
           from unknown window w as (partition by ticker order by date)""",
        "bars",
        extra=UNKNOWN_SQL,
    ),
)
def null_ticker_changes(spark, d):
    """Rows without a ticker are a series of their own."""
    rows = ordering.time_split(series.pct_change(bars_unknown(spark, d)))
    return rounded(rows.select("ticker", "date", "close_pct", "role"))


@query(
    "null_ticker_ema",
    sql(
        "select ticker, date, round(e12, 3) as ema12, round(e26, 3) as ema26 from e join s on s.ticker is not distinct from e.ticker and s.i = e.i".replace(
            "select ticker", "select s.ticker"
        ),
        "bars",
        recursive=True,
        extra=UNKNOWN_SQL + "," + EMA_SQL.replace("from bars)", "from unknown)").replace("s.ticker = e.ticker", "s.ticker is not distinct from e.ticker"),
    ),
)
def null_ticker_ema(spark, d):
    out = scans.ema(bars_unknown(spark, d), {"ema12": ("close", 12), "ema26": ("close", 26)})
    return rounded(out.select("ticker", "date", "ema12", "ema26"), 3)


@query(
    "technical_indicators",
    sql(
        f"""select s.ticker, s.date, {sma_sql(20, 'sma20')}, {sma_sql(50, 'sma50')},
                   round({RSI_VALUE}, 5) as rsi14, round(e12 - e26, 2) as macd,
                   round(e12 - e26 - sig, 2) as macd_hist, round({STD20}, 3) as bb_std
            from s join e using (ticker, i) join gl using (ticker, date)""".replace("order by date", "order by s.date").replace(
            "partition by ticker", "partition by s.ticker"
        ),
        "bars",
        recursive=True,
        extra=EMA_SQL + "," + RSI_SQL,
    ),
)
def technical_indicators(spark, d):
    out = series.add_technical_indicators(views.bars(spark, d))
    columns = ("sma20", "sma50", "rsi14", "macd", "macd_hist", "bb_std")
    return rounded(out.select("ticker", "date", *columns), 3, rsi14=5, sma20=4, sma50=4, macd=2, macd_hist=2)


@query(
    "pct_change",
    sql(
        """select ticker, date, round(close / nullif(lag(close) over w, 0) - 1, 6) as close_pct from bars
           window w as (partition by ticker order by date)""",
        "bars",
    ),
)
def pct_change(spark, d):
    return rounded(series.pct_change(views.bars(spark, d)).select("ticker", "date", "close_pct"))


@query(
    "diff_and_shift",
    sql(
        """select ticker, date, round(close - lag(close, 2) over w, 2) as diff2, lead(volume, 3) over w as ahead3 from bars
           window w as (partition by ticker order by date)""",
        "bars",
    ),
)
def diff_and_shift(spark, d):
    out = series.shift(series.diff(views.bars(spark, d), n=2, name="diff2"), "volume", -3, "ahead3")
    return rounded(out.select("ticker", "date", "diff2", "ahead3"), 2)


LABEL = "lead(close) over (partition by ticker order by date) - close"


@query(
    "label_next",
    sql(
        f"""select ticker, date, round(price_change, 2) as price_change, cast(price_change > 0 as int) as target
            from (select *, {LABEL} as price_change from bars) where price_change is not null""",
        "bars",
    ),
)
def label_next(spark, d):
    out = series.label_next_move(views.bars(spark, d))
    return rounded(out.select("ticker", "date", "price_change", "target"), 2)


@query(
    "label_keep_last",
    sql(f"select ticker, date, coalesce(cast({LABEL} > 0 as int), 0) as target from bars", "bars"),
)
def label_keep_last(spark, d):
    return series.label_next_move(views.bars(spark, d), keep_last=True).select("ticker", "date", "target")


FEATURES_SQL = f"""
feats as (select ticker, date, close, open,
                 close / nullif(lag(close) over w, 0) - 1 as daily_return, {RATIOS_SQL},
                 volume / nullif(lag(volume) over w, 0) - 1 as volume_volatility,
                 sentiment_score as sentiment_score_raw,
                 avg(sentiment_score) over (w rows between 1 preceding and current row) as sentiment_ma2,
                 coalesce(cast(lead(close) over w - close > 0 as int), 0) as target
          from joined window w as (partition by ticker order by date))
"""
FEATURES_BODY = """
select ticker, date, round(daily_return, 6) as daily_return, round(high_low_ratio, 6) as high_low_ratio,
       round(close_to_open, 6) as close_to_open, round(volume_price_ratio, 2) as volume_price_ratio,
       round(volume_volatility, 6) as volume_volatility, round(sentiment_score_raw, 6) as sentiment_score_raw,
       round(sentiment_ma2, 6) as sentiment_ma2, target from feats
"""


@query("features", sql(FEATURES_BODY, "joined", extra=FEATURES_SQL))
def features(spark, d):
    out = series.create_features(joined(spark, d), label=True)
    return rounded(out.select("ticker", "date", *series.FEATURES, "target"), volume_price_ratio=2)


GAPS_SQL = """
ext as (select ticker, min(date) as a, max(date) as b from bars group by 1),
days as (select ticker, cast(unnest(generate_series(a::timestamp, b::timestamp, interval 1 day)) as date) as date from ext),
gaps as (select * from days where isodow(date) < 6 and (ticker, date) not in (select (ticker, date) from bars))
"""


@query("gaps", sql("select ticker, date from gaps", "bars", extra=GAPS_SQL))
def gaps(spark, d):
    return series.trading_day_gaps(views.bars(spark, d))


@query(
    "gap_summary",
    sql(
        """select ticker, count(*) as missing_days, string_agg(date::varchar, ',' order by date) filter (r <= 5) as first_missing
           from (select *, row_number() over (partition by ticker order by date) as r from gaps) group by 1""",
        "bars",
        extra=GAPS_SQL,
    ),
)
def gap_summary(spark, d):
    return series.gap_summary(views.bars(spark, d))


@query("date_spine", sql("select ticker, date from days", "bars", extra=GAPS_SQL))
def date_spine(spark, d):
    extent = views.bars(spark, d).groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return series.date_spine(extent, "a", "b").select("ticker", "date")


@query(
    "news_window",
    sql(
        f"""select {BAR_COLUMNS} from bars join (select ticker, min(date) - 90 as a, max(date) + 5 as b from news group by 1)
            using (ticker) where date between a and b""",
        "bars",
        "news",
    ),
)
def news_window(spark, d):
    return series.bars_in_news_window(views.bars(spark, d), views.news(spark, d))


RATES_SQL = """
r as (select ticker, date, close / nullif(lag(close) over (partition by ticker order by date), 0) - 1 as rate from bars),
c as (select *, case when rate is not null then product(1 + rate) over (partition by ticker order by date) * 10000 end as v from r)
"""


@query(
    "cumulative_return",
    sql(
        """select ticker, date, printf('%.6e', v) as equity_cumulative, printf('%.6e', p) as equity_peak,
                  round((v - p) / nullif(p, 0), 6) as equity_drawdown
           from (select *, case when v is not null then max(v) over (partition by ticker order by date) end as p from c)""",
        "bars",
        extra=RATES_SQL,
    ),
)
def cumulative_return(spark, d):
    rated = series.pct_change(views.bars(spark, d), name="rate")
    out = series.cumulative_return(rated, "rate").select(
        "ticker", "date", "equity_cumulative", "equity_peak", "equity_drawdown"
    )
    return sci_or_null(rounded(out, 6, equity_cumulative=15, equity_peak=15), "equity_cumulative", "equity_peak")


def sci_or_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.6e", F.col(c))) for c in columns})


@query(
    "drawdown",
    sql(
        """select ticker, date, p as peak, round((close - p) / nullif(p, 0), 6) as drawdown
           from (select *, max(close) over (partition by ticker order by date) as p from bars)""",
        "bars",
    ),
)
def drawdown(spark, d):
    out = series.drawdown(views.bars(spark, d), "close").select("ticker", "date", "peak", "drawdown")
    return rounded(out, 6)


TICK_BARS = """
select ticker, strftime(time_bucket(interval '{0}', ts), '%Y-%m-%d %H:%M:%S') as bar_start,
       arg_min(price, event_id) as open, max(price) as high, min(price) as low,
       arg_max(price, event_id) as close, count(*) as volume
from (select ticker, ts, price, row_number() over (order by ts, event_id) as event_id from ticks) group by 1, 2
"""


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


@query("tick_bars", sql(TICK_BARS.format("1 day"), "ticks"))
def tick_bars(spark, d):
    return stamped(series.bars_from_ticks(views.ticks(spark, d)), "bar_start")


@query("tick_bars_minute", sql(TICK_BARS.format("1 minute"), "ticks"))
def tick_bars_minute(spark, d):
    return stamped(series.bars_from_ticks(views.ticks(spark, d), "1 minute"), "bar_start")


@query(
    "tick_moves",
    sql(
        """select ticker, event_id, row_number() over w - 1 as row_idx, count(*) over (partition by ticker) as row_cnt,
                  round(price - lag(price) over w, 6) as move,
                  round(avg(price) over (partition by ticker order by ts, event_id rows 4 preceding), 6) as mean5
           from ticks window w as (partition by ticker order by ts, event_id)""",
        "ticks",
    ),
)
def tick_moves(spark, d):
    """Ticks numbered in their own order, with frames over them."""

    def body(x, w):
        return x.withColumns({"move": F.col("price") - F.lag("price").over(w), "mean5": F.avg("price").over(w.rowsBetween(-4, 0))})

    moved = over_blocks(views.ticks(spark, d), body, back=4, order=["ts", "event_id"], keep_index=True)
    return rounded(moved.select("ticker", "event_id", "row_idx", "row_cnt", "move", "mean5"))


# --- joins ----------------------------------------------------------------------------------------

JOIN_COLUMNS = "ticker, date, close, round(sentiment_score, 6) as sentiment_score, headline_count"


@query("join_sentiment", sql(f"select {JOIN_COLUMNS} from joined", "joined"))
def join_sentiment(spark, d):
    return rounded(joined(spark, d).select("ticker", "date", "close", "sentiment_score", "headline_count"), close=2)


@query(
    "bars_news_counts",
    sql(
        """select ticker, date, close, coalesce(n, 0) as headline_count
           from bars left join (select ticker, date, count(*) as n from news group by 1, 2) using (ticker, date)""",
        "bars",
        "news",
    ),
)
def bars_news_counts(spark, d):
    counts = views.news(spark, d).groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("headline_count"))
    return joins.join_sentiment(views.bars(spark, d).select("ticker", "date", "close"), counts)


@query(
    "semi_range",
    sql(
        """select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in
           (select o_orderkey from orders where cast(o_orderdate as date) between date '1995-02-01' and date '1996-06-30')"""
    ),
)
def semi_range(spark, d):
    lines = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("date")
    )
    return joins.entities_in_range(lines, orders, dates.in_date_range("date", START, END), "l_orderkey")


@query(
    "asof_sentiment",
    sql(
        """select b.ticker, b.date, d.date as sentiment_date, round(d.sentiment_score, 6) as sentiment_score
           from bars b asof left join daily d on b.ticker = d.ticker and b.date >= d.date""",
        "bars",
        "daily",
    ),
)
def asof_sentiment(spark, d):
    out = joins.carry_sentiment_asof(views.bars(spark, d), day_scores(spark, d))
    return rounded(out.select("ticker", "date", "sentiment_date", "sentiment_score"))


@query(
    "sentiment_on_next_bar",
    sql(
        """select b.ticker, b.date, round(coalesce(s, 0), 6) as sentiment_score, coalesce(n, 0) as headline_count
           from bars b left join moved m on m.ticker = b.ticker and m.bar_date = b.date""",
        "bars",
        "daily",
        extra="""moved as (select ticker, bar_date, sum(sentiment_score * headline_count) / sum(headline_count) as s,
                    cast(sum(headline_count) as bigint) as n
                 from (select d.*, (select min(b.date) from bars b where b.ticker = d.ticker and b.date >= d.date) as bar_date
                       from daily d) where bar_date is not null group by 1, 2)""",
    ),
)
def sentiment_on_next_bar(spark, d):
    scores = day_scores(spark, d).select("ticker", "date", "sentiment_score", "headline_count")
    out = joins.sentiment_on_next_bar(views.bars(spark, d), scores)
    return rounded(out.select("ticker", "date", "sentiment_score", "headline_count"))


@query(
    "fill_and_drop",
    sql(
        """select ticker, date, round(coalesce(sentiment_score, 0), 6) as sentiment_score,
                  coalesce(sentiment_category, 'Neutral') as sentiment_category,
                  coalesce(headline_count, 0) as headline_count, round(pct, 6) as pct
           from (select b.ticker, b.date, d.sentiment_score, d.sentiment_category, d.headline_count,
                        close / nullif(lag(close) over (partition by b.ticker order by b.date), 0) - 1 as pct
                 from bars b left join daily d on d.ticker = b.ticker and d.date = b.date) where pct is not null""",
        "bars",
        "daily",
    ),
)
def fill_and_drop(spark, d):
    scores = day_scores(spark, d).select(
        "ticker", "date", "sentiment_score", "sentiment_category", "headline_count"
    )
    raw = joins.join_sentiment(views.bars(spark, d), scores, fill=False)
    filled = joins.fill_sentiment(series.pct_change(raw, name="pct"))
    out = joins.drop_nulls(filled, ["pct"])
    return rounded(
        out.select("ticker", "date", "sentiment_score", "sentiment_category", "headline_count", "pct")
    )


@query(
    "duplicate_keys",
    sql("select ticker, date, count(*) as rows from news group by 1, 2 having count(*) > 1", "news"),
)
def duplicate_keys(spark, d):
    return joins.duplicate_keys(views.news(spark, d))


# --- aggregations ---------------------------------------------------------------------------------

DAILY_BODY = """
select ticker, date, round(sentiment_score, 6) as sentiment_score, round(sentiment_positive, 6) as sentiment_positive,
       round(sentiment_neutral, 6) as sentiment_neutral, round(sentiment_negative, 6) as sentiment_negative,
       round(sentiment_std, 6) as sentiment_std, headline_count, sentiment_category from daily
"""


@query("daily_sentiment", sql(DAILY_BODY, "daily"))
def daily_sentiment(spark, d):
    return rounded(day_scores(spark, d))


@query(
    "daily_numeric",
    sql(
        f"""select ticker, case when doc_id % 7 = 1 then date '{REF}' - 1
                   when doc_id % 7 in (2, 4, 5) then date else date '{REF}' end::date as date,
                   round(avg(doc_id), 6) as doc_id, round(avg(sentiment_compound), 6) as sentiment_score,
                   round(avg(sentiment_positive), 6) as sentiment_positive, count(headline) as headline_count
            from scored group by 1, 2""",
        "scored",
    ),
)
def daily_numeric(spark, d):
    cells = date_cells(spark, d).select("doc_id", "cell")
    rows = scored(spark, d).drop("date").join(cells, "doc_id").withColumnRenamed("cell", "date")
    rows = rows.select("ticker", "date", "doc_id", "headline", "sentiment_compound", "sentiment_positive")
    columns = ["doc_id", "sentiment_compound", "sentiment_positive"]
    return rounded(daily.daily_sentiment_numeric(rows, REF, columns=columns))


@query(
    "daily_numeric_all",
    sql(
        f"""select ticker, case when doc_id % 7 = 1 then date '{REF}' - 1
                   when doc_id % 7 in (2, 4, 5) then date else date '{REF}' end::date as date,
                   round(avg(doc_id), 6) as doc_id, round(avg(sentiment_compound), 6) as sentiment_score,
                   round(avg(sentiment_positive), 6) as sentiment_positive, count(headline) as headline_count
            from scored group by 1, 2""",
        "scored",
    ),
)
def daily_numeric_all(spark, d):
    cells = date_cells(spark, d).select("doc_id", "cell")
    rows = scored(spark, d).drop("date").join(cells, "doc_id").withColumnRenamed("cell", "date")
    rows = rows.select("ticker", "date", "doc_id", "headline", "sentiment_compound", "sentiment_positive")
    return rounded(daily.daily_sentiment_numeric(rows, REF))


@query(
    "daily_short",
    sql(
        """select ticker, date, round(avg(sentiment_compound), 6) as compound_score,
                  round(avg(sentiment_positive), 6) as positive_score, round(avg(sentiment_neutral), 6) as neutral_score,
                  round(avg(sentiment_negative), 6) as negative_score, count(*) as headline_count from scored group by 1, 2""",
        "scored",
    ),
)
def daily_short(spark, d):
    return rounded(daily.daily_sentiment_short(scored(spark, d)))


@query(
    "daily_stats",
    sql(
        """select ticker, date, round(sentiment_score, 6) as sentiment_score, headline_count as news_count,
                  round(sentiment_std, 6) as sentiment_std from daily""",
        "daily",
    ),
)
def daily_stats(spark, d):
    return rounded(daily.daily_sentiment_stats(scored(spark, d)))


@query(
    "ensure_daily",
    sql(
        """select ticker, date, round(sentiment_score, 6) as sentiment_score, headline_count, sentiment_category from daily""",
        "daily",
    ),
)
def ensure_daily(spark, d):
    once = daily.ensure_daily(scored(spark, d))
    return rounded(
        daily.ensure_daily(once).select("ticker", "date", "sentiment_score", "headline_count", "sentiment_category")
    )


CORR_SQL = "case when isnan({0}) or isinf({0}) then null else round({0}, 6) end"
CORR = CORR_SQL.format("corr(price_change, sentiment_score)")


@query(
    "corr_ticker",
    sql(f"select ticker, count(*) as points, {CORR} as correlation from points group by 1", "points"),
)
def corr_ticker(spark, d):
    return rounded(profile.correlation(changes(spark, d), "sentiment_score", "price_change"))


@query(
    "ols_trend",
    sql(
        f"""select ticker, count(*) as points,
                   {CORR_SQL.format("regr_slope(price_change, sentiment_score)")} as slope,
                   {CORR_SQL.format("regr_intercept(price_change, sentiment_score)")} as intercept,
                   {CORR_SQL.format("regr_r2(price_change, sentiment_score)")} as r_squared
            from points group by 1""",
        "points",
    ),
)
def ols_trend(spark, d):
    return rounded(profile.ols_trend(changes(spark, d), "sentiment_score", "price_change"))


def histogram_sql(column: str, table: str) -> str:
    return f"""
b as (select ticker, case when min({column}) = max({column}) then min({column}) - 0.5 else min({column}) end as lo,
             case when min({column}) = max({column}) then max({column}) + 0.5 else max({column}) end as hi from {table} group by 1),
f as (select ticker, cast(least(floor(({column} - lo) / ((hi - lo) / 20)), 19) as int) as bin, count(*) as n
      from {table} join b using (ticker) group by 1, 2)
"""


HISTOGRAM_BODY = """
select ticker, g.bin, round(lo + (hi - lo) / 20 * g.bin, {0}) as bin_start, coalesce(n, 0) as frequency
from b cross join (select cast(unnest(range(20)) as int) as bin) g left join f using (ticker, bin)
"""


@query(
    "histogram20",
    sql(HISTOGRAM_BODY.format(6), "daily", extra=histogram_sql("sentiment_score", "daily")),
)
def histogram20(spark, d):
    return rounded(profile.histogram(day_scores(spark, d), "sentiment_score"))


@query(
    "describe",
    sql(
        """select ticker, count(close) as count, round(avg(close), 3) as mean, round(stddev_samp(close), 3) as std,
                  min(close) as min, max(close) as max, round(quantile_cont(close, 0.25), 4) as p25,
                  round(quantile_cont(close, 0.5), 4) as p50, round(quantile_cont(close, 0.75), 4) as p75
           from bars group by 1""",
        "bars",
    ),
)
def describe(spark, d):
    return rounded(profile.describe(views.bars(spark, d), "close"), 3, min=6, max=6, p25=4, p50=4, p75=4)


@query(
    "null_profile",
    sql(
        """select b.ticker, count(*) filter (close is null) as close, count(*) filter (sentiment_score is null) as sentiment_score,
                  count(*) filter (sentiment_std is null) as sentiment_std
           from bars b left join daily using (ticker, date) group by 1""",
        "bars",
        "daily",
    ),
)
def null_profile(spark, d):
    raw = joins.join_sentiment(views.bars(spark, d), day_scores(spark, d), fill=False)
    return profile.null_profile(raw, ["close", "sentiment_score", "sentiment_std"], ["ticker"])


@query(
    "news_quality",
    sql(
        """select ticker, min(date) as first_date, max(date) as last_date, count(*) as articles,
                  round(count(*) / count(distinct date), 6) as articles_per_day, count(distinct date) as unique_dates
           from news group by 1""",
        "news",
    ),
)
def news_quality(spark, d):
    return rounded(profile.news_quality(views.news(spark, d)))


@query("date_extent", sql("select min(date) as min_date, max(date) as max_date from bars", "bars"))
def date_extent(spark, d):
    return profile.date_extent(views.bars(spark, d), REF)


LABELLED_SQL = f"labelled as (select *, coalesce(cast({LABEL} > 0 as int), 0) as target from bars)"


@query(
    "class_dist",
    sql(
        """select ticker, target, count(*) as rows, round(count(*) / sum(count(*)) over (partition by ticker), 6) as share
           from labelled group by 1, 2""",
        "bars",
        extra=LABELLED_SQL,
    ),
)
def class_dist(spark, d):
    labelled = series.label_next_move(views.bars(spark, d), keep_last=True)
    return rounded(profile.class_distribution(labelled, keys=["ticker"]))


SPLIT_SQL = (
    LABELLED_SQL
    + """,
numbered as (select *, row_number() over (partition by ticker order by date) - 1 as i, count(*) over (partition by ticker) as n
             from labelled),
split as (select *, case when i < floor(n * (1 - 0.2::double)) then 'train' else 'test' end as role from numbered)
"""
)


@query("time_split", sql("select ticker, date, role from split", "bars", extra=SPLIT_SQL))
def time_split(spark, d):
    return ordering.time_split(views.bars(spark, d)).select("ticker", "date", "role")


@query(
    "majority",
    sql(
        """select ticker, m as majority_class, round(avg(cast(target = m as int)), 6) as baseline_accuracy
           from split join (select ticker, case when sum(target) > count(*) - sum(target) then 1 else 0 end as m
                            from split where role = 'train' group by 1) using (ticker)
           where role = 'test' group by 1, 2""",
        "bars",
        extra=SPLIT_SQL,
    ),
)
def majority(spark, d):
    labelled = series.label_next_move(views.bars(spark, d), keep_last=True)
    split = ordering.time_split(labelled)
    return rounded(profile.majority_class(split.where("role = 'train'"), split.where("role = 'test'")))


AVG_SQL = f"""
m as (select ticker, avg(sentiment_score) as a, count(*) as rows_in_range from daily where {RANGE} group by 1),
k as (select ticker, case when abs(a) < 0.00005 then 0 else a end as a, rows_in_range from m),
card as (select *, case when a > 0.1 then 'positive' when a < -0.1 then 'negative' else 'neutral' end as sentiment_class from k)
"""


@query(
    "avg_sentiment",
    sql(
        "select ticker, round(a, 6) as avg_sentiment, sentiment_class, rows_in_range from card",
        "daily",
        extra=AVG_SQL,
    ),
)
def avg_sentiment(spark, d):
    return rounded(profile.avg_sentiment(day_scores(spark, d), dates.in_date_range("date", START, END)))


@query(
    "value_counts",
    sql("select entity, count(*) as occurrences from entities group by 1", "entities"),
)
def value_counts(spark, d):
    return profile.value_counts(views.entities(spark, d), "entity", "row_id")


# --- order, duplicates, splits --------------------------------------------------------------------


@query(
    "recent10",
    sql(
        f"""select {BAR_COLUMNS} from (select *, row_number() over (partition by ticker order by date desc) as r from bars)
            where r <= 10""",
        "bars",
    ),
)
def recent10(spark, d):
    return ordering.recent(views.bars(spark, d), 10)


@query("sort_recent", sql("select doc_id, ticker, date from news", "news"))
def sort_recent(spark, d):
    return ordering.sort_recent(views.news(spark, d).select("doc_id", "ticker", "date"), ["date"], ["doc_id"])


@query(
    "dedup_headlines",
    sql("select ticker, headline, min(doc_id) as doc_id from news group by 1, 2", "news"),
)
def dedup_headlines(spark, d):
    return ordering.dedup_headlines(views.news(spark, d).select("ticker", "headline", "doc_id"), ["doc_id"])


@query(
    "combine_sources",
    sql(
        """select ticker, headline, arg_min(doc_id, k) as doc_id, arg_min(date, k) as date, arg_min(part, k) as source_rank
           from (select *, cast(case when source < 'src3' then 0 else 1 end as int) as part,
                        case when source < 'src3' then 0 else 1 end * 1000000000 + doc_id as k from news) group by 1, 2""",
        "news",
    ),
)
def combine_sources(spark, d):
    rows = views.news(spark, d).select("doc_id", "ticker", "date", "headline", "source")
    first = rows.where("source < 'src3'").drop("source")
    second = rows.where("source >= 'src3'").drop("source")
    return ordering.combine_sources([first, second], ties="doc_id")


FOLDS_SQL = (
    SPLIT_SQL
    + """,
sized as (select *, least(5, greatest(2, n // 10)) as k from numbered),
sized2 as (select *, n // (k + 1) as t from sized),
folds as (select s.*, f.fold, case when i < n - (k - fold) * t then 'train' else 'test' end as role
          from sized2 s join (select unnest(range(5)) as fold) f on f.fold < s.k
          where i < n - (k - fold) * t + t)
"""
)


@query("folds", sql("select ticker, date, fold, role from folds", "bars", extra=FOLDS_SQL))
def folds(spark, d):
    return ordering.time_series_folds(views.bars(spark, d)).select("ticker", "date", "fold", "role")


@query(
    "fold_baselines",
    sql(
        """select ticker, fold, m as majority_class, round(avg(cast(target = m as int)), 6) as baseline_accuracy
           from folds join (select ticker, fold, case when sum(target) > count(*) - sum(target) then 1 else 0 end as m
                            from folds where role = 'train' group by 1, 2) using (ticker, fold)
           where role = 'test' group by 1, 2, 3""",
        "bars",
        extra=FOLDS_SQL,
    ),
)
def fold_baselines(spark, d):
    labelled = series.label_next_move(views.bars(spark, d), keep_last=True)
    long = ordering.time_series_folds(labelled)
    return rounded(
        profile.majority_class(long.where("role = 'train'"), long.where("role = 'test'"), keys=["ticker", "fold"])
    )


CARRY_SQL = """
pg as (select doc_id // 20 as page_id, doc_id as row_idx, case when doc_id % 4 = 1 then date end as date from news)
"""


@query(
    "carry_forward",
    sql(
        """select page_id, row_idx, date from (select page_id, row_idx, last_value(date ignore nulls)
              over (partition by page_id order by row_idx rows between unbounded preceding and current row) as date from pg)
           where date is not null""",
        "news",
        extra=CARRY_SQL,
    ),
)
def carry_forward(spark, d):
    rows = views.news(spark, d).select(
        F.floor(F.col("doc_id") / 20).alias("page_id"),
        F.col("doc_id").alias("row_idx"),
        F.when(F.col("doc_id") % 4 == 1, F.col("date")).alias("date"),
    )
    return ordering.carry_forward_date(rows)


@query(
    "best_ticker_score",
    sql(
        f"""select ticker, points, correlation from (
              select ticker, count(*) as points, {CORR} as correlation from points group by 1)
            order by correlation desc nulls last, ticker limit 1""",
        "points",
    ),
)
def best_ticker_score(spark, d):
    return rounded(ordering.best_model(corr_ticker(spark, d), "correlation", "ticker"))


# --- network --------------------------------------------------------------------------------------

COUNTS_SQL = """
counts as (select entity, count(*) as size, arg_min(entity_type, {row: row_id, kind: entity_type}) as entity_type,
                  min({row: row_id, kind: entity_type}) as first_seen from entities group by 1),
lim as (select greatest(1, least({0}, coalesce((select size from counts order by size desc limit 1 offset 4), 1))) as threshold),
freq as (select * from counts where size >= (select threshold from lim))
""".replace("{row: row_id, kind: entity_type}", "struct_pack(r := row_id, k := entity_type)")
EDGES_SQL = """
pt as (select doc, entity, count(*) as c from entities where entity in (select entity from freq) group by 1, 2),
edges as (select a.entity as entity1, b.entity as entity2, cast(sum(a.c * b.c) as bigint) as weight
          from pt a join pt b on a.doc = b.doc and a.entity < b.entity group by 1, 2
          union all
          select entity, entity, cast(sum(c * (c - 1) // 2) as bigint) from pt where c > 1 group by 1)
"""
NODES_SQL = """
nodes as (select entity, size, entity_type from freq order by size desc, first_seen limit {0})
"""
MANY = 1_000_000


@query("entity_counts", sql("select entity, size, entity_type from counts", "entities", extra=COUNTS_SQL.replace("{0}", "2")))
def entity_counts(spark, d):
    return network.entity_counts(views.entities(spark, d)).drop("first_seen")


@query(
    "entity_threshold",
    sql("select cast(threshold as bigint) as threshold from lim", "entities", extra=COUNTS_SQL.replace("{0}", str(MANY))),
)
def entity_threshold(spark, d):
    return network.effective_threshold(network.entity_counts(views.entities(spark, d)), MANY)


@query(
    "entity_nodes",
    sql("select * from nodes", "entities", extra=COUNTS_SQL.replace("{0}", "2") + "," + NODES_SQL.format(10)),
)
def entity_nodes(spark, d):
    return network.entity_nodes(network.entity_counts(views.entities(spark, d)), 2, 10)


@query(
    "entity_edges",
    sql("select * from edges", "entities", extra=COUNTS_SQL.replace("{0}", "2") + "," + EDGES_SQL),
)
def entity_edges(spark, d):
    ents = views.entities(spark, d)
    return network.entity_edges(ents, network.frequent(network.entity_counts(ents), 2))


@query(
    "frequent_filter",
    sql(
        "select doc, entity, row_id from entities where entity in (select entity from freq)",
        "entities",
        extra=COUNTS_SQL.replace("{0}", str(MANY)),
    ),
)
def frequent_filter(spark, d):
    ents = views.entities(spark, d)
    allowed = network.frequent(network.entity_counts(ents), MANY)
    return joins.semi_on(ents, allowed, "entity").select("doc", "entity", "row_id")


@query(
    "implicit_nodes",
    sql(
        """select distinct entity, cast(1 as bigint) as size, 'MISC' as entity_type
           from (select entity1 as entity from edges union all select entity2 from edges)
           where entity not in (select entity from nodes)""",
        "entities",
        extra=COUNTS_SQL.replace("{0}", "2") + "," + NODES_SQL.format(10) + "," + EDGES_SQL,
    ),
)
def implicit_nodes(spark, d):
    ents = views.entities(spark, d)
    counts = network.entity_counts(ents)
    edges = network.entity_edges(ents, network.frequent(counts, 2))
    return network.implicit_nodes(edges, network.entity_nodes(counts, 2, 10))


@query(
    "network_status",
    sql(
        "select count(*) as entities, case when count(*) < 2 then 'not enough entities' else 'ok' end as status from freq",
        "entities",
        extra=COUNTS_SQL.replace("{0}", "2"),
    ),
)
def network_status(spark, d):
    return network.network_status(network.entity_counts(views.entities(spark, d)), 2)


@query(
    "network_thresholds",
    " union all ".join(
        "(" + sql(f"select {n} as requested, count(*) as entities, case when count(*) < 2 then 'not enough entities' else 'ok' end as status from freq",
                  "entities", extra=COUNTS_SQL.replace("{0}", str(n))) + ")"
        for n in (1, 3, 5)
    ),
)
def network_thresholds(spark, d):
    counts = network.entity_counts(views.entities(spark, d))
    parts = [network.network_status(counts, n).withColumn("requested", F.lit(n)) for n in (1, 3, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("requested", "entities", "status")


ONE_ENTITY_SQL = COUNTS_SQL.replace("{0}", "2").replace("from entities", "from entities where entity = (select min(entity) from entities)")


@query(
    "network_not_enough",
    sql(
        "select count(*) as entities, case when count(*) < 2 then 'not enough entities' else 'ok' end as status, 0::bigint as nodes, 0::bigint as edges from freq",
        "entities",
        extra=ONE_ENTITY_SQL,
    ),
)
def network_not_enough(spark, d):
    """One entity makes no network: no nodes, no edges."""
    ents = views.entities(spark, d)
    first = ents.agg(F.min("entity").alias("entity"))
    found = network.entity_network(ents.join(first, "entity", "left_semi"))
    status = found.status.select("entities", "status")
    count = [part.agg(F.count(F.lit(1)).alias(name)) for part, name in ((found.nodes, "nodes"), (found.edges, "edges"))]
    return status.join(count[0]).join(count[1])


@query(
    "network_strict_top",
    sql(
        "select * from edges where entity1 in (select entity from nodes) and entity2 in (select entity from nodes)",
        "entities",
        extra=COUNTS_SQL.replace("{0}", "2") + "," + NODES_SQL.format(5) + "," + EDGES_SQL,
    ),
)
def network_strict_top(spark, d):
    """Edges between the five largest nodes only."""
    return network.entity_network(views.entities(spark, d), top=5, strict_top_n=True).edges


RANGE_NETWORK = COUNTS_SQL.replace("{0}", "2").replace("from entities", "from ranged") + "," + EDGES_SQL.replace(
    "from entities", "from ranged"
)


@query(
    "network_in_range",
    sql(
        "select * from edges",
        "entities",
        extra=f"""ranged as (select * from entities where doc in
                    (select o_orderkey from orders where cast(o_orderdate as date) between date '{START}' and date '{END}')),"""
        + RANGE_NETWORK,
    ),
)
def network_in_range(spark, d):
    orders = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc"), F.col("o_orderdate").cast("date").alias("date")
    )
    in_range = dates.in_date_range("date", START, END)
    return network.network_in_range(views.entities(spark, d), orders, in_range, 2, link="doc").edges


@query(
    "max_edge_weight",
    sql("select max(weight) as max_weight from edges", "entities", extra=COUNTS_SQL.replace("{0}", "2") + "," + EDGES_SQL),
)
def max_edge_weight(spark, d):
    return network.max_weight(entity_edges(spark, d))


@query(
    "type_legend",
    sql(
        "select distinct entity_type from nodes",
        "entities",
        extra=COUNTS_SQL.replace("{0}", "2") + "," + NODES_SQL.format(50),
    ),
)
def type_legend(spark, d):
    ents = views.entities(spark, d)
    return network.type_legend(network.entity_nodes(network.entity_counts(ents), 2))


#: Bars, daily scores and headlines of the last ticker without it.
NO_TICKER_SQL = "{0} as (select * replace (case when ticker = '5-LOW' then null else ticker end as ticker) from {1})"


def without_ticker(df: DataFrame) -> DataFrame:
    return df.withColumn("ticker", F.nullif("ticker", F.lit("5-LOW")))


@query(
    "null_ticker_sentiment",
    sql("select ticker, date, close, round(sentiment_score, 6) as sentiment_score, headline_count from unknown", "joined",
        extra=NO_TICKER_SQL.format("unknown", "joined")),
)
def null_ticker_sentiment(spark, d):
    out = joins.join_sentiment(without_ticker(views.bars(spark, d)), without_ticker(day_scores(spark, d)))
    return rounded(out.select("ticker", "date", "close", "sentiment_score", "headline_count"), close=2)


@query(
    "null_ticker_gaps",
    sql("select nullif(ticker, '5-LOW') as ticker, date from gaps", "bars", extra=GAPS_SQL),
)
def null_ticker_gaps(spark, d):
    return series.trading_day_gaps(without_ticker(views.bars(spark, d)))


@query(
    "null_ticker_window",
    sql(
        """select nullif(ticker, '5-LOW') as ticker, date, close from bars
           join (select ticker, min(date) - 90 as a, max(date) + 5 as b from news group by 1) using (ticker) where date between a and b""",
        "bars",
        "news",
    ),
)
def null_ticker_window(spark, d):
    out = series.bars_in_news_window(without_ticker(views.bars(spark, d)), without_ticker(views.news(spark, d)))
    return out.select("ticker", "date", "close")


@query("null_ticker_histogram", sql(HISTOGRAM_BODY.format(6).replace("select ticker, g.bin", "select nullif(ticker, '5-LOW') as ticker, g.bin"),
                                    "daily", extra=histogram_sql("sentiment_score", "daily")))
def null_ticker_histogram(spark, d):
    return rounded(profile.histogram(without_ticker(day_scores(spark, d)), "sentiment_score"))


DESCRIBE_SQL = """count(close) as count, round(avg(close), 3) as mean, round(stddev_samp(close), 3) as std,
                  min(close) as min, max(close) as max, round(quantile_cont(close, 0.25), 4) as p25,
                  round(quantile_cont(close, 0.5), 4) as p50, round(quantile_cont(close, 0.75), 4) as p75"""


@query("null_ticker_describe", sql(f"select nullif(ticker, '5-LOW') as ticker, {DESCRIBE_SQL} from bars group by 1", "bars"))
def null_ticker_describe(spark, d):
    return rounded(profile.describe(without_ticker(views.bars(spark, d)), "close"), 3, min=6, max=6, p25=4, p50=4, p75=4)


@query("describe_all", sql(f"select {DESCRIBE_SQL} from bars", "bars"))
def describe_all(spark, d):
    """All tickers as one series."""
    return rounded(profile.describe(views.bars(spark, d), "close", keys=()), 3, min=6, max=6, p25=4, p50=4, p75=4)


@query(
    "null_ticker_first_available",
    sql(
        """select nullif(ticker, '5-LOW') as ticker, date, close from bars where ticker > '3' union all
           select nullif(ticker, '5-LOW'), date, close + 1 from bars where ticker <= '3'""",
        "bars",
    ),
)
def null_ticker_first_available(spark, d):
    bars = without_ticker(views.bars(spark, d))
    out = tables.first_available(bars.where("ticker > '3' or ticker is null"), bars.withColumn("close", F.col("close") + 1))
    return out.select("ticker", "date", "close")


# --- models ---------------------------------------------------------------------------------------

MODEL_FEATURES = ("open", "high", "low", "close", "volume")


def z_sql(column: str) -> str:
    part = f"(partition by ticker)"
    mean = f"avg({column}) filter (role = 'train') over {part}"
    spread = f"stddev_pop({column}) filter (role = 'train') over {part}"
    return f"round(({column} - {mean}) / case when {spread} = 0 then 1 else {spread} end, 6) as {column}"


@query(
    "standardize",
    sql(
        "select ticker, date, " + ", ".join(z_sql(c) for c in MODEL_FEATURES) + " from split",
        "bars",
        extra=SPLIT_SQL,
    ),
)
def standardize(spark, d):
    split = ordering.time_split(views.bars(spark, d))
    out = modeling.standardize(split, MODEL_FEATURES, fit_on=F.col("role") == "train")
    return rounded(out.select("ticker", "date", *MODEL_FEATURES))


@query(
    "null_ticker_standardize",
    sql(
        "select nullif(ticker, '5-LOW') as ticker, date, " + ", ".join(z_sql(c) for c in MODEL_FEATURES) + " from split",
        "bars",
        extra=SPLIT_SQL,
    ),
)
def null_ticker_standardize(spark, d):
    split = ordering.time_split(without_ticker(views.bars(spark, d)))
    out = modeling.standardize(split, MODEL_FEATURES, fit_on=F.col("role") == "train")
    return rounded(out.select("ticker", "date", *MODEL_FEATURES))


@query(
    "prepare_data",
    sql(
        """select ticker, date, role, target, price, round((sentiment_score - avg(sentiment_score) over p)
                  / case when stddev_pop(sentiment_score) over p = 0 then 1 else stddev_pop(sentiment_score) over p end, 6) as sentiment_score,
                  round((close - avg(close) over p) / stddev_pop(close) over p, 6) as close
           from (select ticker, date, close, close as price, sentiment_score, cast(chg > 0 as int) as target,
                        case when row_number() over (partition by ticker order by date) - 1
                                  < floor(count(*) over (partition by ticker) * (1 - 0.2::double)) then 'train' else 'test' end as role
                 from (select *, lead(close) over (partition by ticker order by date) - close as chg from joined) where chg is not null)
           window p as (partition by ticker)""",
        "joined",
    ),
)
def prepare_data(spark, d):
    rows, _ = modeling.prepare_data(views.bars(spark, d), day_scores(spark, d).drop("sentiment_std"), fit_scope="all")
    return rounded(rows.select("ticker", "date", "role", "target", "price", "sentiment_score", "close"))


GUESS_SQL = f"""
guess as (select ticker, cast(close > open as int) as prediction, cast(chg > 0 as int) as target
          from (select *, {LABEL} as chg from bars) where chg is not null),
cm as (select ticker, count(*) filter (prediction = 1 and target = 1) as tp, count(*) filter (prediction = 1 and target = 0) as fp,
              count(*) filter (prediction = 0 and target = 0) as tn, count(*) filter (prediction = 0 and target = 1) as fn
       from guess group by 1),
pr as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r,
              (tp + tn) / (tp + tn + fp + fn) as a from cm)
"""


def guesses(spark, d):
    labelled = series.label_next_move(views.bars(spark, d))
    return labelled.withColumn("prediction", (F.col("close") > F.col("open")).cast("int"))


@query(
    "eval_metrics",
    sql(
        """select ticker, tn, fp, fn, tp, round(a, 6) as accuracy, round(p, 6) as precision, round(r, 6) as recall,
                  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from pr""",
        "bars",
        extra=GUESS_SQL,
    ),
)
def eval_metrics(spark, d):
    out = modeling.evaluate_predictions(guesses(spark, d), keys=["ticker"])
    matrix = F.col("confusion_matrix")
    cells = {"tn": matrix[0][0], "fp": matrix[0][1], "fn": matrix[1][0], "tp": matrix[1][1]}
    return rounded(
        out.select(
            "ticker", *[c.alias(n) for n, c in cells.items()], "accuracy", "precision", "recall", "f1"
        )
    )


@query(
    "class_report",
    sql(
        """select t.c as class, round(coalesce(h / nullif(said, 0), 0), 6) as precision, round(h / support, 6) as recall,
                  round(coalesce(2 * (h / nullif(said, 0)) * (h / support) / nullif(h / nullif(said, 0) + h / support, 0), 0), 6) as f1, support
           from (select target as c, count(*) as support, cast(count(*) filter (prediction = target) as bigint) as h from guess group by 1) t
           join (select prediction as c, count(*) as said from guess group by 1) s using (c)""",
        "bars",
        extra=GUESS_SQL,
    ),
)
def class_report(spark, d):
    return rounded(modeling.class_report(guesses(spark, d)))


def prepared(spark, d):
    rows, names = modeling.prepare_data(views.bars(spark, d), day_scores(spark, d))
    rows = cut_lineage(rows)
    return rows.where("role = 'train'"), rows.where("role = 'test'"), names


# Fitted values differ between engines; what any right fit has in common does not: the rows it saw, a vanishing
# gradient or the number of trees, and metrics that follow from the confusion matrix.
PREPARED_SQL = """
labelled as (select *, lead(close) over (partition by ticker order by date) - close as chg from joined),
prep as (select ticker, date, close as price, cast(chg > 0 as int) as target,
                case when row_number() over (partition by ticker order by date) - 1
                          < floor(count(*) over (partition by ticker) * (1 - 0.2::double)) then 'train' else 'test' end as role
         from labelled where chg is not null),
sizes as (select count(*) filter (role = 'train') as train_rows, count(*) filter (role = 'train' and target = 1) as train_ups,
                 count(*) filter (role = 'test') as test_rows, count(*) filter (role = 'test' and target = 1) as test_ups from prep)
"""
FIT_SQL = "select '{}' as model_name, *, {} as size, true as fitted, true as consistent from sizes"


def ups(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.count_if(F.col("target") == 1)).first()
    return row[0], row[1]


def consistent(quality) -> bool:
    """Whether accuracy, precision, recall and F1 follow from the confusion matrix."""
    (tn, fp), (fn, tp) = quality.confusion_matrix
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    pairs = ((quality.accuracy, (tp + tn) / (tn + fp + fn + tp)), (quality.precision, precision), (quality.recall, recall), (quality.f1, f1))
    return all(abs(a - b) < 1e-9 for a, b in pairs)


def fit_facts(spark, train, test, model, name: str, size: int, fitted: bool) -> DataFrame:
    quality = modeling.evaluate_model(model, test, name).first()
    (tn, fp), (fn, tp) = quality.confusion_matrix
    row = (name, *ups(train), tn + fp + fn + tp, fn + tp, size, fitted, consistent(quality))
    shape = "model_name string, train_rows bigint, train_ups bigint, test_rows bigint, test_ups bigint, size int, fitted boolean, consistent boolean"
    return spark.createDataFrame([row], shape)


def gradient_vanishes(model, train: DataFrame, names, c: float = 1.0) -> bool:
    """Whether the mean gradient of the penalised loss is near zero in every direction."""
    weights = model.stages[-1].coefficients.toArray()
    scored_rows = modeling.predict(model, train)
    off = F.col("probability") - F.col("target")
    row = scored_rows.agg(F.count(F.lit(1)), F.avg(off), *[F.avg(off * F.col(n)) for n in names]).first()
    slopes = [abs(row[1])] + [abs(g + w / (c * row[0])) for g, w in zip(row[2:], weights)]
    return bool(max(slopes) < 1e-3)


def accuracy_on(model, rows: DataFrame) -> float:
    return modeling.evaluate_model(model, rows).first().accuracy


@query("train_lr", sql(FIT_SQL.format("logistic_regression", "9"), "joined", extra=PREPARED_SQL))
def train_lr(spark, d):
    train, test, names = prepared(spark, d)
    model = modeling.train_logistic_regression(train, names)
    size = len(model.stages[-1].coefficients.toArray())
    return fit_facts(spark, train, test, model, "logistic_regression", size, gradient_vanishes(model, train, names))


@query("train_rf", sql(FIT_SQL.format("random_forest", "100"), "joined", extra=PREPARED_SQL))
def train_rf(spark, d):
    """A hundred trees of any depth: better on the training rows than their majority."""
    train, test, names = prepared(spark, d)
    model = modeling.train_random_forest(train, names)
    rows, positive = ups(train)
    fitted = accuracy_on(model, train) > max(positive, rows - positive) / rows
    return fit_facts(spark, train, test, model, "random_forest", len(model.trees), fitted)


@query("train_gbt", sql(FIT_SQL.format("boosted_trees", "100"), "joined", extra=PREPARED_SQL))
def train_gbt(spark, d):
    """A hundred rounds: better on the training rows than their majority."""
    train, test, names = prepared(spark, d)
    model = modeling.train_boosted_trees(train, names)
    rows, positive = ups(train)
    fitted = accuracy_on(model, train) > max(positive, rows - positive) / rows
    return fit_facts(spark, train, test, model, "boosted_trees", len(model.trees), fitted)


@query(
    "predict",
    sql("select ticker, date, target, true as in_range, true as fits from prep where role = 'test'", "joined", extra=PREPARED_SQL),
)
def predict(spark, d):
    train, test, names = prepared(spark, d)
    scored_rows = modeling.predict(modeling.train_logistic_regression(train, names), test)
    fits = F.col("prediction") == (F.col("probability") > 0.5).cast("int")
    return scored_rows.select("ticker", "date", "target", F.col("probability").between(0, 1).alias("in_range"), fits.alias("fits"))


@query(
    "compare_models",
    sql(
        """select name as model_name, test_rows, test_ups, train_rows, true as consistent, true as best_has_highest_f1
           from sizes cross join (values ('logistic_regression'), ('random_forest'), ('boosted_trees')) as t(name)""",
        "joined",
        extra=PREPARED_SQL,
    ),
)
def compare_models(spark, d):
    path = scratch(spark, "best-model")
    out = modeling.compare_models(views.bars(spark, d), day_scores(spark, d), model_path=path)
    _, metadata = models.load_model(path)
    found = out["results"].collect()  # one row per model
    highest = max(r.f1 for r in found)
    best = next(r.f1 for r in found if r.model_name == metadata["model_name"]) == highest
    rows = []
    for r in found:
        (tn, fp), (fn, tp) = r.confusion_matrix
        rows.append((r.model_name, tn + fp + fn + tp, fn + tp, metadata["train_samples"], consistent(r), best))
    return spark.createDataFrame(
        rows, "model_name string, test_rows bigint, test_ups bigint, train_rows bigint, consistent boolean, best_has_highest_f1 boolean"
    )


CV_SQL = FEATURES_SQL + """,
complete as (select ticker, date, target from feats
             where daily_return is not null and high_low_ratio is not null and close_to_open is not null and volume_price_ratio is not null
               and volume_volatility is not null and sentiment_score_raw is not null and sentiment_ma2 is not null),
counted as (select *, row_number() over (partition by ticker order by date) - 1 as i, count(*) over (partition by ticker) as n from complete),
cut as (select *, least(5, greatest(2, n // 10)) as k, n // (least(5, greatest(2, n // 10)) + 1) as t from counted),
long as (select c.*, f.fold, case when i < n - (k - fold) * t then 'train' else 'test' end as role
         from cut c join (select unnest(range(5)) as fold) f on f.fold < c.k where i < n - (k - fold) * t + t),
fold_sizes as (select fold, count(*) filter (role = 'train') as train_rows, count(*) filter (role = 'test') as test_rows,
                      count(*) filter (role = 'train' and target = 1) as ups, count(*) filter (role = 'test' and target = 1) as test_ups
               from long group by 1),
rated as (select fold, train_rows, test_rows, cast(ups > train_rows - ups as int) as majority_class,
                 case when ups > train_rows - ups then test_ups else test_rows - test_ups end / test_rows as baseline from fold_sizes)
"""


@query(
    "crossval",
    sql("select fold, train_rows, test_rows, majority_class, round(baseline, 6) as baseline, true as in_range from rated", "joined", extra=CV_SQL),
)
def crossval(spark, d):
    folds = modeling.cross_validate(views.bars(spark, d), day_scores(spark, d))["folds"]
    in_range = F.col("accuracy").between(0, 1).alias("in_range")
    return folds.select("fold", "train_rows", "test_rows", "majority_class", F.round("baseline", 6).alias("baseline"), in_range)


@query(
    "crossval_summary",
    sql("select round(avg(baseline), 6) as avg_baseline, true as improvement_fits from rated", "joined", extra=CV_SQL),
)
def crossval_summary(spark, d):
    """Mean accuracy, mean baseline and their difference, the result that validation prints."""
    summary = modeling.cross_validate(views.bars(spark, d), day_scores(spark, d))["summary"]
    fits = F.abs(F.col("avg_accuracy") - F.col("avg_baseline") - F.col("improvement")) < 1e-12
    return summary.select(F.round("avg_baseline", 6).alias("avg_baseline"), fits.alias("improvement_fits"))


@query(
    "feature_importance",
    "select feature, true as finite from (values " + ", ".join(f"('{f}')" for f in series.FEATURES) + ") as t(feature)",
)
def feature_importance(spark, d):
    found = modeling.cross_validate(views.bars(spark, d), day_scores(spark, d))["importance"]
    value = next(c for c in found.columns if c != "feature")
    return found.select("feature", (F.abs(value) < float("inf")).alias("finite"))


@query(
    "backtest_model",
    sql(
        """select ticker, count(*) as trading_days, count(*) filter (target = 1) as actual_ups, true as consistent
           from prep where role = 'test' group by 1""",
        "joined",
        extra=PREPARED_SQL,
    ),
)
def backtest_model(spark, d):
    train, test, names = prepared(spark, d)
    scored_rows = modeling.predict(modeling.train_logistic_regression(train, names), test)
    report = backtest.backtest_model(scored_rows, price="price")[1]
    total = F.col("true_positives") + F.col("false_positives") + F.col("true_negatives") + F.col("false_negatives")
    right = F.abs(F.col("accuracy") - (F.col("true_positives") + F.col("true_negatives")) / total) < 1e-9
    value = F.abs(F.col("final_value") / F.col("initial_capital") - 1 - F.col("total_return")) < 1e-9
    drawn = F.col("max_drawdown").between(-1, 0)
    return report.select(
        "ticker",
        "trading_days",
        (F.col("true_positives") + F.col("false_negatives")).alias("actual_ups"),
        (right & value & drawn & (total == F.col("trading_days"))).alias("consistent"),
    )


@query(
    "eval_by_ticker",
    sql(
        """select ticker, count(*) as test_rows, count(*) filter (target = 1) as test_ups, true as in_range
           from prep where role = 'test' group by 1""",
        "joined",
        extra=PREPARED_SQL,
    ),
)
def eval_by_ticker(spark, d):
    """The model rated one ticker at a time."""
    train, test, names = prepared(spark, d)
    scored_rows = modeling.predict(modeling.train_logistic_regression(train, names), test)
    rated = modeling.evaluate_predictions(scored_rows, "logistic_regression", ["ticker"])
    m = F.col("confusion_matrix")
    in_range = F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)
    return rated.select("ticker", (m[0][0] + m[0][1] + m[1][0] + m[1][1]).alias("test_rows"), (m[1][0] + m[1][1]).alias("test_ups"), in_range.alias("in_range"))


# --- backtest -------------------------------------------------------------------------------------

POSITIONS_SQL = """
marked as (select ticker, date, close, cast(sentiment_score > 0.05 as int) as position,
                  lead(close) over (partition by ticker order by date) - close as chg from joined),
pos as (select *, cast(chg > 0 as int) as actual from marked where chg is not null)
"""
RETURNS_SQL = (
    POSITIONS_SQL
    + """,
ret as (select *, close / nullif(lag(close) over w, 0) - 1 as ar, lag(position) over w as held from pos
        window w as (partition by ticker order by date)),
ret2 as (select *, coalesce(held * ar, 0) as sr from ret),
cum as (select *, case when ar is not null then product(1 + ar) over w * 10000 end as ac, product(1 + sr) over w * 10000 as sc
        from ret2 window w as (partition by ticker order by date)),
eq as (select *, case when ac is not null then max(ac) over w end as ap, max(sc) over w as sp from cum
       window w as (partition by ticker order by date)),
perf as (select ticker, arg_max(sc, date) as final_value, min((sc - sp) / nullif(sp, 0)) as max_drawdown,
                avg(sr - (pow(1.02::double, 1::double / 252) - 1)) as me, stddev_samp(sr - (pow(1.02::double, 1::double / 252) - 1)) as sd,
                count(*) filter (sr > 0) as wins, count(*) filter (sr < 0) as losses, count(*) as trading_days from eq group by 1),
conf as (select ticker, count(*) filter (position = 1 and actual = 1) as true_positives,
                count(*) filter (position = 1 and actual = 0) as false_positives,
                count(*) filter (position = 0 and actual = 0) as true_negatives,
                count(*) filter (position = 0 and actual = 1) as false_negatives from pos group by 1)
"""
)
PERFORMANCE = """
printf('%.6e', final_value) as final_value, printf('%.6e', final_value / 10000 - 1) as total_return,
round(pow(final_value / 10000, 252::double / trading_days) - 1, 6) as annualized_return, round(max_drawdown, 6) as max_drawdown,
round(sqrt(252) * me / nullif(sd, 0), 6) as sharpe_ratio, round(coalesce(wins / nullif(wins + losses, 0), 0), 6) as win_rate, trading_days
"""


@query("positions", sql("select ticker, date, position, actual, round(chg, 2) as price_change from pos", "joined", extra=POSITIONS_SQL))
def positions(spark, d):
    out = backtest.sentiment_positions(views.bars(spark, d), day_scores(spark, d))
    return rounded(out.select("ticker", "date", "position", "actual", "price_change"), 2)


@query(
    "returns",
    sql(
        """select ticker, date, position, round(ar, 6) as asset_returns, round(sr, 6) as strategy_returns,
                  printf('%.6e', ac) as asset_cumulative, printf('%.6e', sc) as strategy_cumulative,
                  round((ac - ap) / nullif(ap, 0), 6) as asset_drawdown, round((sc - sp) / nullif(sp, 0), 6) as strategy_drawdown
           from eq""",
        "joined",
        extra=RETURNS_SQL,
    ),
)
def returns(spark, d):
    placed = backtest.sentiment_positions(views.bars(spark, d), day_scores(spark, d))
    out = backtest.calculate_returns(placed).select("ticker", "date", "position", *backtest.SERIES)
    out = out.drop("asset_peak", "strategy_peak")
    big = {"asset_cumulative": 15, "strategy_cumulative": 15}
    return sci_or_null(rounded(out, 6, **big), *big)


def metric_text(df: DataFrame) -> DataFrame:
    big = {"final_value": 15, "total_return": 15}
    return sci_or_null(rounded(df.drop("initial_capital"), 6, **big), *big)


@query("performance", sql(f"select ticker, {PERFORMANCE} from perf", "joined", extra=RETURNS_SQL))
def performance(spark, d):
    rows = backtest.sentiment_returns(views.bars(spark, d), day_scores(spark, d))
    return metric_text(backtest.performance_metrics(rows))


CONFUSION = """
true_positives, false_positives, true_negatives, false_negatives,
round((true_positives + true_negatives) / (true_positives + false_positives + true_negatives + false_negatives), 6) as accuracy,
round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) as precision,
round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) as recall,
round(coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) as f1_score
"""


@query("confusion", sql(f"select ticker, {CONFUSION} from conf", "joined", extra=RETURNS_SQL))
def confusion(spark, d):
    return rounded(backtest.signal_confusion(backtest.sentiment_positions(views.bars(spark, d), day_scores(spark, d))))


@query(
    "backtest_sentiment",
    sql(f"select ticker, {PERFORMANCE}, {CONFUSION} from perf join conf using (ticker)", "joined", extra=RETURNS_SQL),
)
def backtest_sentiment(spark, d):
    return metric_text(backtest.backtest_sentiment_strategy(views.bars(spark, d), day_scores(spark, d))[1])


# --- reports --------------------------------------------------------------------------------------


@query(
    "price_sentiment",
    sql(
        f"""select {BAR_COLUMNS}, round(sentiment_score, 6) as sentiment_score, headline_count from joined where {RANGE}""",
        "joined",
    ),
)
def price_sentiment(spark, d):
    out = reports.price_sentiment_series(views.bars(spark, d), day_scores(spark, d), START, END)
    return out.withColumn("sentiment_score", F.round("sentiment_score", 6))


RANGED_POINTS = f"""
rj as (select * from joined where {RANGE}),
rp as (select * from (select *, close / nullif(lag(close) over (partition by ticker order by date), 0) - 1 as price_change from rj)
       where price_change is not null)
"""


@query(
    "corr_points",
    sql(
        "select ticker, date, round(sentiment_score, 6) as sentiment_score, round(price_change, 6) as price_change from rp",
        "joined",
        extra=RANGED_POINTS,
    ),
)
def corr_points(spark, d):
    return rounded(reports.correlation_points(views.bars(spark, d), day_scores(spark, d), START, END))


@query(
    "corr_summary",
    sql(
        f"""select ticker, count(*) as points, {CORR} as correlation,
                   {CORR_SQL.format("regr_slope(price_change, sentiment_score)")} as slope,
                   {CORR_SQL.format("regr_intercept(price_change, sentiment_score)")} as intercept,
                   {CORR_SQL.format("regr_r2(price_change, sentiment_score)")} as r_squared from rp group by 1""",
        "joined",
        extra=RANGED_POINTS,
    ),
)
def corr_summary(spark, d):
    points = reports.correlation_points(views.bars(spark, d), day_scores(spark, d), START, END)
    return rounded(reports.correlation_summary(points))


@query(
    "recent_bars",
    sql(
        """select ticker, strftime(date, '%Y-%m-%d') as date, '$' || printf('%.2f', round(open, 2)) as open,
                  '$' || printf('%.2f', round(high, 2)) as high, '$' || printf('%.2f', round(low, 2)) as low,
                  '$' || printf('%.2f', round(close, 2)) as close, format('{:,}', volume) as volume
           from (select *, row_number() over (partition by ticker order by date desc) as r from bars) where r <= 10""",
        "bars",
    ),
)
def recent_bars(spark, d):
    return reports.recent_bars(views.bars(spark, d))


def score_text_sql(column: str) -> str:
    return (
        f"case when {column} is null then 'N/A' else printf('%.4f', round(case when abs({column}) < 0.00005"
        f" then 0 else {column} end, 4)) end as {column}"
    )


@query(
    "recent_sentiment",
    sql(
        f"""select ticker, strftime(date, '%Y-%m-%d') as date, {score_text_sql("sentiment_score")},
                   {score_text_sql("sentiment_positive")}, {score_text_sql("sentiment_std")},
                   format('{{:,}}', headline_count) as headline_count, sentiment_category
            from (select *, row_number() over (partition by ticker order by date desc) as r from daily) where r <= 10""",
        "daily",
    ),
)
def recent_sentiment(spark, d):
    scores = day_scores(spark, d).drop("sentiment_neutral", "sentiment_negative")
    return reports.recent_sentiment(scores)


@query(
    "summary_card",
    sql(
        """select ticker, 'Feb 01, 1995 - Jun 30, 1996' as date_range,
                  case when a is null then 'N/A' else printf('%.4f', round(a, 4)) end as avg_sentiment,
                  coalesce(sentiment_class, 'neutral') as sentiment_class, coalesce(rows_in_range, 0) as rows_in_range
           from (select distinct ticker from daily) left join card using (ticker)""",
        "daily",
        extra=AVG_SQL,
    ),
)
def summary_card(spark, d):
    return reports.summary_card(day_scores(spark, d), views.bars(spark, d), REF, START, END)


@query(
    "rolling_overview",
    sql(
        f"""select ticker, date, round(avg(sentiment_score) over {frame(5)}, 6) as sentiment_rolling,
                   round(avg(close) over {frame(5)}, 3) as close_rolling from joined""",
        "joined",
    ),
)
def rolling_overview(spark, d):
    return rounded(reports.rolling_overview(views.bars(spark, d), day_scores(spark, d)), 6, close_rolling=3)


@query(
    "sentiment_histogram",
    sql(HISTOGRAM_BODY.format(9), "joined", extra=histogram_sql("sentiment_score", "joined")),
)
def sentiment_histogram(spark, d):
    return rounded(reports.daily_sentiment_histogram(views.bars(spark, d), day_scores(spark, d)), 9)


# --- pages ----------------------------------------------------------------------------------------


def shown_pages(news_rows: DataFrame, per_page: int = 20) -> DataFrame:
    """Input of the page queries, as no given page has a news table: pages that show the given headlines (``row_idx``, ``date``, ``headline``).

    A page holds ``per_page`` rows; only the first row of a day shows its date, as on real pages.
    """
    paged = news_rows.withColumn("page_id", F.floor(F.col("row_idx") / F.lit(per_page)))
    above = F.lag("date").over(Window.partitionBy("page_id").orderBy("row_idx"))
    clock = F.lit("12:45PM")
    stamp = F.when(F.col("date").eqNullSafe(above), clock).otherwise(
        F.concat(F.date_format("date", "MMM-dd-yy"), F.lit(" "), clock)
    )
    escaped = F.col("headline")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    line = F.concat(
        F.lit("<tr><td>"), stamp, F.lit("</td><td><a href='#'>"), escaped, F.lit("</a></td></tr>")
    )
    lines = F.array_sort(F.collect_list(F.struct("row_idx", F.col("_line").alias("line"))))
    return (
        paged.withColumn("_line", line)
        .groupBy("page_id")
        .agg(lines.alias("_lines"))
        .select(
            "page_id",
            F.concat(
                F.lit(f'<table id="{pages.TABLE_ID}">'),
                F.array_join(F.transform("_lines", lambda r: r["line"]), ""),
                F.lit("</table>"),
            ).alias("html"),
        )
    )


@query(
    "news_table_pages",
    sql(
        """select doc_id // 20 as page_id, cast(row_number() over (partition by doc_id // 20 order by doc_id) - 1 as int) as row_idx,
                  date, '12:45PM' as time, trim(headline, ' \t\n\r') as headline, 'table' as source from news""",
        "news",
    ),
)
def news_table_pages(spark, d):
    """Headlines shown on news-table pages and read back from them."""
    shown = views.news(spark, d).withColumn("row_idx", F.col("doc_id"))
    return pages.news_from_pages(shown_pages(shown), REF)


@query(
    "rows_per_page",
    sql(
        """select doc_id // 20 as page_id, count(*) as rows from (
              select doc_id, row_number() over (partition by doc_id // 20 order by doc_id) - 1 as i from news) where i < 5 group by 1""",
        "news",
    ),
)
def rows_per_page(spark, d):
    shown = views.news(spark, d).withColumn("row_idx", F.col("doc_id"))
    rows = pages.limit_rows_per_page(pages.extract_news_rows(shown_pages(shown)), 5)
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("rows"))


# HTML lets these four references end without a semicolon.
HEADING_SQL = """
h1 as (select page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) as h from pages),
named as (select page_id, regexp_replace(regexp_replace(regexp_replace(h, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
                 '&quot;?', '"', 'g') as h from h1),
heads as (select page_id, trim(regexp_replace(h, '&amp;?', '&', 'g'), ' \t\n\r') as headline from named)
"""


@query(
    "html_rows",
    sql("select page_id, cast(0 as int) as row_idx, headline from heads", extra=HEADING_SQL),
)
def html_rows(spark, d):
    return pages.extract_headings(views.pages(spark, d), "h1")


@query(
    "article_cards",
    sql(
        f"select page_id, cast(0 as int) as row_idx, date '{REF}' as date, '00:00' as time, headline from heads",
        extra=HEADING_SQL,
    ),
)
def article_cards(spark, d):
    """Page headings shown as article cards and read back."""
    heads = pages.extract_headings(views.pages(spark, d), "h1")
    safe = F.replace(F.replace("headline", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    card = F.concat(
        F.lit('<div class="collection__elements"><div class="element--article"><h3 class="article__headline"><a href="#">'),
        safe,
        F.lit("</a></h3><span>now</span></div></div>"),
    )
    return pages.extract_article_cards(heads.select("page_id", card.alias("html")), REF)


#: Where the given pages hold lists of links and articles.
LINK_ROWS = pages.RowLayout(row="nav ul li", link="a", second="a@href")
ARTICLES = pages.CardLayout(card="article", headline="h1")
LINKS_SQL = """
menus as (select page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>.*?</li>') as items from pages),
links as (select page_id, cast(unnest(range(len(items))) as int) as row_idx, unnest(items) as item from menus),
named_links as (select page_id, row_idx, regexp_extract(item, 'href="([^"]*)"', 1) as target,
                       regexp_replace(regexp_extract(item, '(?s)<a [^>]*>(.*?)</a>', 1), '&lt;?', '<', 'g') as h from links),
shown_links as (select page_id, row_idx, target, trim(regexp_replace(regexp_replace(regexp_replace(h, '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), ' \t\n\r') as headline
                from named_links)
"""


@query("page_links", sql("select page_id, row_idx, headline, target, true as has_link from shown_links", extra=LINKS_SQL))
def page_links(spark, d):
    """Rows of links of the given pages, text and target, by selectors."""
    rows = pages.extract_news_rows(views.pages(spark, d), LINK_ROWS)
    return rows.select("page_id", "row_idx", "headline", F.col("second_cell").alias("target"), "has_link")


@query(
    "page_links_limited",
    sql("select page_id, count(*) as links, max(headline) as last_headline from shown_links where row_idx < 4 group by 1", extra=LINKS_SQL),
)
def page_links_limited(spark, d):
    """The first four rows of every given page, its feature being that limit."""
    rows = pages.limit_rows_per_page(pages.extract_news_rows(views.pages(spark, d), LINK_ROWS), 4)
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.max("headline").alias("last_headline"))


@query(
    "page_articles",
    sql(f"select page_id, cast(0 as int) as row_idx, date '{REF}' as date, '00:00' as time, headline from heads", extra=HEADING_SQL),
)
def page_articles(spark, d):
    """Articles of the given pages as cards, by selectors."""
    return pages.extract_article_cards(views.pages(spark, d), REF, ARTICLES)


# --- streams --------------------------------------------------------------------------------------

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tick_stream(spark, d):
    raw = streams.stream_ticks(spark, streams.table_glob(d, "events.parquet"), EVENTS_SCHEMA)
    return raw.select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").alias("price"),
    )


def news_stream(spark, d):
    cores = spark.sparkContext.defaultParallelism
    raw = streams.stream_news(spark, streams.table_glob(d, "documents.parquet"), DOCUMENTS_SCHEMA, spread=cores)
    ticker, day = views.news_columns(F.col("doc_id"))
    return raw.select(
        "doc_id",
        ticker.alias("ticker"),
        day.alias("date"),
        day.cast("timestamp").alias("ts"),
        F.col("text").alias("headline"),
        "source",
    )


@query("stream_ticks", sql("select ticker, event_id, price from ticks", "ticks"))
def stream_ticks(spark, d):
    return streams.run_once(tick_stream(spark, d).select("ticker", "event_id", "price"), scratch(spark, "ticks"))


@query(
    "stream_scores",
    sql(f"select doc_id, {SCORE_COLUMNS} from scored", "scored"),
)
def stream_scores(spark, d):
    rows = streams.stream_scores(news_stream(spark, d), views.WORD_VALENCES, finance=False)
    return streams.run_once(rows.select("doc_id", *SCORE_COLUMNS.split(", ")), scratch(spark, "scores"))


@query("stream_dedup", sql("select distinct ticker, date, headline from news", "news"))
def stream_dedup(spark, d):
    rows = streams.stream_dedup(news_stream(spark, d), ["ticker", "date", "headline"])
    return streams.run_once(rows.select("ticker", "date", "headline"), scratch(spark, "dedup"))


@query(
    "stream_daily",
    sql(
        """select ticker, date, round(sentiment_score, 6) as sentiment_score, headline_count, sentiment_category from daily""",
        "daily",
    ),
)
def stream_daily(spark, d):
    rows = streams.stream_scores(news_stream(spark, d), views.WORD_VALENCES, finance=False)
    scores = streams.stream_daily_sentiment(rows)
    return rounded(streams.run_once(scores, scratch(spark, "daily"), "update", ["ticker", "date"]))


WEEK_SQL = sql(
    """select ticker, cast(d as date) as date, round(avg(sentiment_compound), 6) as sentiment_score, count(headline) as headline_count
       from scored, (select unnest(range(7)) as k) join_days, lateral (select scored.date - cast(k as int) as d) group by 1, 2""",
    "scored",
)


@query("stream_week", WEEK_SQL)
def stream_week(spark, d):
    """Seven days that slide by one, from stored day panes."""
    rows = streams.stream_scores(news_stream(spark, d), views.WORD_VALENCES, finance=False)
    return rounded(streams.stream_window_sentiment(rows, scratch(spark, "week"), 7))


@query("window_sentiment", WEEK_SQL)
def window_sentiment(spark, d):
    """The same windows as a batch report."""
    return rounded(streams.window_sentiment(scored(spark, d), 7))


ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query(
    "stream_join_streams",
    sql(
        """select o_orderpriority as ticker, o_orderkey, round(o_totalprice, 2) as close, cast(o_orderdate as date) as date,
                  round(coalesce(sentiment_score, 0), 6) as sentiment_score, coalesce(headline_count, 0) as headline_count
           from orders left join daily on daily.ticker = o_orderpriority and daily.date = cast(o_orderdate as date)
           where cast(o_orderdate as date) + interval 1 day
                 <= least((select max(o_orderdate) from orders), (select max(date)::timestamp from news)) - interval 36 hours""",
        "daily",
    ),
)
def stream_join_streams(spark, d):
    """Every streamed order price with the streamed headlines of its day, as far as the watermark has come."""
    raw = streams.stream_files(spark, streams.table_glob(d, "orders.parquet"), ORDERS_SCHEMA)
    prices = raw.select(
        F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("close")
    )
    rows = streams.stream_scores(news_stream(spark, d), views.WORD_VALENCES, finance=False)
    joined_rows = streams.stream_join_streams(prices, rows.select("ticker", "ts", "headline", "sentiment_compound"), "36 hours")
    out = streams.run_once(joined_rows, scratch(spark, "joined-streams"))
    return rounded(out.select("ticker", "o_orderkey", "close", "date", "sentiment_score", "headline_count"), close=2)


@query("stream_bars", sql(TICK_BARS.format("1 day"), "ticks"))
def stream_bars(spark, d):
    out = streams.run_once(
        streams.stream_bars(tick_stream(spark, d)), scratch(spark, "bars"), "update", ["ticker", "bar_start"]
    )
    return stamped(out, "bar_start")


@query(
    "stream_join_bars",
    sql(
        """select d.ticker, d.date, round(sentiment_score, 6) as sentiment_score, headline_count, close
           from daily d left join bars b using (ticker, date)""",
        "daily",
        "bars",
    ),
)
def stream_join_bars(spark, d):
    rows = streams.stream_scores(news_stream(spark, d), views.WORD_VALENCES, finance=False)
    scores = streams.stream_daily_sentiment(rows).drop("sentiment_category")
    both = streams.stream_join_bars(scores, views.bars(spark, d).select("ticker", "date", "close"))
    out = streams.run_once(both, scratch(spark, "joined"), "update", ["ticker", "date"])
    return rounded(out, close=2)


@query(
    "stream_ema",
    sql(
        "select ticker, event_id, round(e, 6) as ema12 from e join s using (ticker, i)",
        "ticks",
        recursive=True,
        extra="""s as (select ticker, event_id, price, row_number() over (partition by ticker order by ts, event_id) as i from ticks),
                 e as (select ticker, i, price as e from s where i = 1 union all
                       select s.ticker, s.i, s.price * (2::double / 13) + e.e * (11::double / 13)
                       from e join s on s.ticker = e.ticker and s.i = e.i + 1)""",
    ),
)
def stream_ema_query(spark, d):
    out = stream_ema.stream_ema(tick_stream(spark, d), scratch(spark, "ema"), {"ema12": 12})
    return rounded(out.select("ticker", "event_id", "ema12"))


@query(
    "stream_ema_state",
    sql(
        """select ticker, event_id, round(e, 6) as ema12 from e join s using (ticker, i)
           where time_bucket(interval 6 hours, ts) + interval 6 hours <= (select max(ts) from ticks) - interval 1 hour""",
        "ticks",
        recursive=True,
        extra="""s as (select ticker, event_id, ts, price, row_number() over (partition by ticker order by ts, event_id) as i from ticks),
                 e as (select ticker, i, price as e from s where i = 1 union all
                       select s.ticker, s.i, s.price * (2::double / 13) + e.e * (11::double / 13)
                       from e join s on s.ticker = e.ticker and s.i = e.i + 1)""",
    ),
)
def stream_ema_state(spark, d):
    """Averages carried in the state store, as far as the watermark has come."""
    spans = {"ema12": 12}
    carries = stream_ema.stream_carries(tick_stream(spark, d), scratch(spark, "carries"), spans, slot="6 hours")
    rows = views.ticks(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(stream_ema.averages_of_slots(rows, carries, spans, slot="6 hours").select("ticker", "event_id", "ema12"))


SESSIONS_SQL = """
g as (select ticker, ts, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as fresh from ticks
      window w as (partition by ticker order by ts)),
n as (select ticker, ts, sum(fresh) over (partition by ticker order by ts rows unbounded preceding) as burst from g)
"""
SESSIONS_BODY = """
select ticker, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start,
       strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as session_end, count(*) as events from n group by ticker, burst
"""


@query("burst_sessions", sql(SESSIONS_BODY, "ticks", extra=SESSIONS_SQL))
def burst_sessions(spark, d):
    return stamped(streams.burst_sessions(views.ticks(spark, d)), "session_start", "session_end")


@query("stream_sessions", sql(SESSIONS_BODY, "ticks", extra=SESSIONS_SQL))
def stream_sessions(spark, d):
    """All bursts of the stream, those still open at its end included."""
    out = streams.stream_bursts(tick_stream(spark, d), scratch(spark, "sessions"))
    return stamped(out, "session_start", "session_end")


# --- jobs -----------------------------------------------------------------------------------------


@query(
    "process_news",
    sql(
        """select ticker, date, round(sentiment_score, 6) as sentiment_score, headline_count, sentiment_category from daily""",
        "daily",
    ),
)
def process_news_query(spark, d):
    config = JobConfig(scratch(spark, "news"), REF, views.WORD_VALENCES, finance=False)
    out = process_news(views.texts(spark, d), config)
    return rounded(out.select("ticker", "date", "sentiment_score", "headline_count", "sentiment_category"))


@query("daily_job", sql(FEATURES_BODY, "joined", extra=FEATURES_SQL))
def daily_job(spark, d):
    config = JobConfig(scratch(spark, "job"), REF, views.WORD_VALENCES, finance=False)
    paths = run_daily_job(spark, views.bars(spark, d), views.texts(spark, d), config, views.gazetteer(spark))
    out = spark.read.parquet(paths["features"])
    return rounded(out.select("ticker", "date", *series.FEATURES, "target"), volume_price_ratio=2)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Score, aggregate per day, join the bars, take changes, correlate per ticker."""
    return corr_ticker(spark, d)
