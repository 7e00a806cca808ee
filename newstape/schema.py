"""Table shapes and the one place where input column names are settled."""

from __future__ import annotations

from pyspark.sql import DataFrame

BARS = (
    "ticker string, date date, open double, high double, low double, close double, volume bigint"
)
NEWS = "ticker string, date date, time string, headline string, source string"
SCORED = NEWS + (
    ", cleaned_text string, sentiment_compound double, sentiment_positive double,"
    " sentiment_neutral double, sentiment_negative double, sentiment_category string"
)
DAILY = (
    "ticker string, date date, sentiment_score double, sentiment_positive double,"
    " sentiment_neutral double, sentiment_negative double, sentiment_std double,"
    " headline_count bigint, sentiment_category string"
)
ENTITIES = "ticker string, date date, entity string, entity_type string, source_text string"
TICKS = "ticker string, ts timestamp, event_id bigint, price double"
PAGES = "page_id bigint, url string, html string"

# Candidate names per role, first hit wins (fixed values).
TEXT_COLUMNS = ("text", "headline", "title", "content")
ENTITY_TEXT_COLUMNS = ("headline", "text", "title", "content")
DATE_COLUMNS = ("Date", "date", "Timestamp", "timestamp")
SCORE_COLUMNS = ("sentiment_score", "sentiment_compound")

# Canonical name -> other spellings met in input files (compared in lower case).
ALIASES = {
    "date": ("timestamp", "datetime"),
    "close": ("price", "last"),
    "volume": ("vol",),
    "sentiment_score": ("sentiment_compound", "compound"),
    "sentiment_positive": ("pos", "positive"),
    "sentiment_neutral": ("neu", "neutral"),
    "sentiment_negative": ("neg", "negative"),
    "headline_count": ("news_count",),
}


def normalize_columns(
    df: DataFrame,
    aliases: dict[str, tuple[str, ...]] | None = None,
    ticker: str | None = None,
) -> DataFrame:
    """Lower-case names, drop a ``_<ticker>`` suffix, apply the alias map. Schema only."""
    aliases = ALIASES if aliases is None else aliases
    canonical = {other: name for name, others in aliases.items() for other in others}
    suffix = f"_{ticker.lower()}" if ticker else None
    renames: dict[str, str] = {}
    taken: set[str] = set()
    for column in df.columns:
        name = column.strip().lower().replace(" ", "_")
        if suffix and name.endswith(suffix):
            name = name[: -len(suffix)]
        renames[column] = name
        taken.add(name)
    for column, name in list(renames.items()):
        target = canonical.get(name)
        if target and target not in taken:
            renames[column] = target
            taken.add(target)
    return df.withColumnsRenamed({old: new for old, new in renames.items() if old != new})


def pick_column(df: DataFrame, candidates: tuple[str, ...], preferred: str | None = None) -> str:
    """First candidate the frame has; looks at the schema only."""
    wanted = ((preferred,) if preferred else ()) + tuple(candidates)
    for name in wanted:
        if name in df.columns:
            return name
    raise ValueError(f"none of {wanted} among the columns {df.columns}")
