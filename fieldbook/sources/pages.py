"""Extraction of tables and headers from a table of raw pages ``(page_id, url, html)``.

Every step works inside one page, so pages are extracted where they were read: no shuffle, and no
Python process. Block, row and cell tags are parameters because sites differ in them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.text import capture, cell_text, cell_texts
from fieldbook.schema import BOARD_COLUMNS


@dataclass(frozen=True)
class Markup:
    """Tags (and optionally a class of the block) that make up a table on a page."""

    block: str = "tbody"
    row: str = "tr"
    cell: str = "td"
    block_class: str | None = None

    def block_pattern(self) -> str:
        if self.block_class is None:
            return rf"(?is)<{self.block}\b[^>]*>(.*?)</{self.block}>"
        return rf"(?is)<{self.block}\b[^>]*\bclass\s*=\s*[\"'][^\"']*\b{self.block_class}\b[^>]*>(.*?)</{self.block}>"


def _inner(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def _outer(html: Column, tag: str) -> Column:
    """Whole elements, so that attributes of the row itself stay visible."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), F.lit(0))


def page_rows(pages: DataFrame, markup: Markup = Markup(), pick: str = "largest", keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, block_no, row_no, cells): rows of the block with most rows (the first such), or of all blocks; ``keep`` names columns of the page to carry along."""
    blocks = F.regexp_extract_all("html", F.lit(markup.block_pattern()), F.lit(1))
    rows_of = F.transform(blocks, lambda b: _outer(b, markup.row))
    numbered = F.transform(rows_of, lambda rows, i: F.struct(F.size(rows).alias("n"), (-i).alias("place"), rows.alias("rows")))
    if pick == "largest":
        chosen = F.array_compact(F.array(F.array_max(numbered)))
    elif pick == "all":
        chosen = numbered
    else:
        raise ValueError(f"pick must be 'largest' or 'all', not {pick!r}")
    per_block = pages.select("page_id", *keep, F.explode(chosen).alias("b"))
    # Cells are read before the rows are spread out, so that a later filter on them does not read them again.
    cells = F.transform("b.rows", lambda row: cell_texts(_inner(row, markup.cell)))
    return per_block.select("page_id", *keep, (-F.col("b.place")).alias("block_no"), F.posexplode(cells).alias("row_no", "cells"))


def extract_cells(
    pages: DataFrame, places: dict[str, int], *, min_cells: int, markup: Markup = Markup(), pick: str = "largest", keep: Sequence[str] = ()
) -> DataFrame:
    """One column per named cell place (from 0); rows with too few cells are left out, absent trailing cells are null."""
    rows = page_rows(pages, markup, pick, keep).filter(F.size("cells") >= min_cells)
    return rows.select("page_id", *keep, "row_no", *[F.get("cells", F.lit(i)).alias(name) for name, i in places.items()])


def extract_boards(pages: DataFrame, *, markup: Markup = Markup(), pick: str = "largest", min_cells: int = 8, keep: Sequence[str] = ()) -> DataFrame:
    """Result boards: cells 1 to 10 of every row, the same meaning in both page layouts."""
    return extract_cells(pages, {c: i for i, c in enumerate(BOARD_COLUMNS, start=1)}, min_cells=min_cells, markup=markup, pick=pick, keep=keep)


def _class_pattern(tag: str, name: str) -> str:
    """The first element with exactly this class among its classes."""
    return rf"(?is)<{tag}\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</{tag}>"


def extract_schedule(
    pages: DataFrame,
    *,
    id_pattern: str = r"tournamentId=(\d+)",
    place_class: str = "eventAndLocation__tournamentLocation",
    name_class: str = "eventAndLocation__tournamentLink",
    date_classes: Sequence[str] = ("dateAndTickets__col", "dateRange__col"),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(page_id, tournament_id, location, Name, Date) of every row that has all of them, and the columns of the page named by ``keep``."""
    patterns = [
        rf"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*{id_pattern}",
        _class_pattern(r"(?:div|span|p)", place_class),
        _class_pattern("a", name_class),
        _class_pattern(r"(?:div|span|p)", name_class),
        *[_class_pattern("td", c) for c in date_classes],
    ]
    # Each step reads the one before as a value, and a filter stays behind the explode: no pattern is searched twice in a row.
    found = F.transform(_outer(F.col("html"), "tr"), lambda row: F.array(*[F.regexp_extract(row, p, 1) for p in patterns]))
    texts = F.transform(found, lambda cells: cell_texts(F.transform(cells, lambda c: F.when(c != "", c))))
    rows = pages.select("page_id", *keep, F.explode(F.arrays_zip(found.alias("found"), texts.alias("texts"))).alias("row"))
    text = [F.col("row.texts")[i] for i in range(len(patterns))]
    named = rows.select(
        "page_id", *keep, F.nullif(F.col("row.found")[0], F.lit("")).alias("tournament_id"), text[1].alias("location"),
        F.coalesce(text[2], text[3]).alias("Name"), F.coalesce(*text[4:]).alias("Date"),
    )
    return named.na.drop(subset=["tournament_id", "location", "Name", "Date"])


def extract_event(
    pages: DataFrame,
    *,
    title: str = r"<h1\b[^>]*>(.*?)</h1>",
    date: str = r"<span\b[^>]*Leaderboard__Event__Date[^>]*>(.*?)</span>",
    places: Sequence[str] = (
        r"<div\b[^>]*Leaderboard__Course__Location[^>]*clr-gray-05[^>]*>(.*?)</div>",
        r"<div\b[^>]*Leaderboard__Course__Location[^>]*clr-gray-04[^>]*>(.*?)</div>",
    ),
) -> DataFrame:
    """(page_id, Tournament, Date, Location) from the head of each page; alternatives are tried in order."""
    html = F.col("html")
    return pages.select(
        "page_id",
        cell_text(capture(html, f"(?is){title}")).alias("Tournament"),
        cell_text(capture(html, f"(?is){date}")).alias("Date"),
        F.coalesce(*[cell_text(capture(html, f"(?is){p}")) for p in places]).alias("Location"),
    )


def extract_field(pages: DataFrame, *, markup: Markup = Markup(), player_cell: int = 1) -> DataFrame:
    """(page_id, Player): entrants of an event still to come, from the largest table."""
    return extract_cells(pages, {"Player": player_cell}, min_cells=player_cell + 1, markup=markup).select("page_id", "Player")
