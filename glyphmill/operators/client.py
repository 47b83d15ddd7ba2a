"""Client-side state as DataFrame operators: bookmarks, history, tabs, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY, BAR, RELATED, RELATED_IDS = 100, 5, 3, 5


def toggle_bookmark(bookmarks: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows that are there go, rows that are not are appended."""
    return bookmarks.join(rows, id_col, "left_anti").unionByName(rows.join(bookmarks, id_col, "left_anti"))


def bookmarked(docs: DataFrame, bookmarks: DataFrame, id_col: str = "id") -> DataFrame:
    return docs.join(bookmarks, id_col, "left_semi")


def not_bookmarked(docs: DataFrame, bookmarks: DataFrame, id_col: str = "id") -> DataFrame:
    return docs.join(bookmarks, id_col, "left_anti")


def newest(history: DataFrame, time_col: str, tie_col: str, n: int = HISTORY, incognito: Column | None = None) -> DataFrame:
    kept = history if incognito is None else history.where(~incognito)
    return kept.orderBy(F.col(time_col).desc(), F.col(tie_col).desc()).limit(n)


def panel_search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.lower(c).contains(text.lower())
    return rows.where(hit)


def in_category(results: DataFrame, text: str, category_col: str = "category") -> DataFrame:
    return results.where(F.lower(category_col).contains(text.lower())) if text else results


def at_level(logs: DataFrame, level: str, level_col: str = "level") -> DataFrame:
    return logs if level == "all" else logs.where(F.col(level_col) == level)


def related(pages: DataFrame, current: int, id_col: str = "id") -> DataFrame:
    """The first three of the pages 1 to 5 that aren't the current one."""
    return pages.where(F.col(id_col).between(1, RELATED_IDS) & (F.col(id_col) != current)).orderBy(id_col).limit(RELATED)


def bookmarks_bar(bookmarks: DataFrame, order_col: str) -> DataFrame:
    return bookmarks.orderBy(order_col).limit(BAR)


def asks_for_suggestions(text: str, place: str = "search") -> bool:
    """Whether a box asks for suggestions: two characters in the search bar, one
    on the new-tab page and in the omnibox."""
    return len(text.strip()) >= (2 if place == "search" else 1)


def wants_suggestions(text: Column, place: str = "search") -> Column:
    """``asks_for_suggestions`` for a column of inputs."""
    return F.char_length(F.trim(F.coalesce(text, F.lit("")))) >= (2 if place == "search" else 1)


def route(address: Column) -> Column:
    """Where an address-bar input leads: (kind, value)."""
    text = F.trim(address)
    page = F.regexp_extract(text, r"page/([0-9]+)", 1)
    query = F.regexp_extract(text, r"search\?(?:[^ ]*&)?q=([^& ]*)", 1)
    kind = F.when(query != "", "search").when(page != "", "page").when(text.contains("bookmarks"), "bookmarks").when(text.contains("admin"), "admin").otherwise("search")
    return F.struct(kind.alias("kind"), F.when(query != "", F.url_decode(query)).when(page != "", page).when(kind == "search", text).otherwise("").alias("value"))


def open_tab(tabs: DataFrame, tab: DataFrame) -> DataFrame:
    return tabs.unionByName(tab)


def update_tab(tabs: DataFrame, id_: str, **changes: object) -> DataFrame:
    return tabs.select(*(F.when(F.col("id") == id_, F.lit(changes[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in tabs.columns))


def close_tab(tabs: DataFrame, id_: str) -> DataFrame:
    """Without the tab, unless it is the last one."""
    count = tabs.groupBy().agg(F.count("*").alias("_n"))
    return tabs.crossJoin(F.broadcast(count)).where((F.col("id") != id_) | (F.col("_n") <= 1)).drop("_n")
