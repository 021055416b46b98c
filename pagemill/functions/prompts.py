"""Requests to models, as column expressions: what is asked, then the page's or table's own facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGIONS = "List the regions of page %d (%d by %d pixels) in reading order as JSON: type, box in fractions of the page, confidence, a short description."
TABLE = "Describe the table in this image as JSON: numbers of rows and columns, header rows, cells with row, column, spans and confidence."
TEXT = "Read the text of these regions and give JSON with one entry per region, in order: %s."
CONDITION = "Judge the condition of this scan (%d by %d pixels, %s): turned, skewed, faint, blurred or noisy; give evidence, severity and steps as JSON."
CONTENT = "Read this table and give JSON: its headers, and for each row its header with a value per column, a single value, or notes. A marked option is a row's value; the other options are notes."
TRIPLETS = "Name entities and the relations between them in this table as JSON, with evidence from the rows. Type: %s. Rows:\n%s"
INSIGHTS = "This is a table as cells with row, column and text. Row 0 holds column headers. State what each marked crossing and each section says, as JSON:\n%s"
CLASSIFY = "Which of these is the document: %s? Answer with one name.\n%s"


def regions(page: Column, width: Column, height: Column) -> Column:
    return F.format_string(REGIONS, page, width, height)


def table() -> Column:
    return F.lit(TABLE)


def region_text(ids: Column) -> Column:
    return F.format_string(TEXT, F.array_join(ids, ", "))


def condition(width: Column, height: Column, mode: Column) -> Column:
    return F.format_string(CONDITION, width, height, mode)


def content() -> Column:
    return F.lit(CONTENT)


def triplets(kind: Column, lines: Column) -> Column:
    """lines: the row previews of a table, in order."""
    return F.format_string(TRIPLETS, kind, F.array_join(lines, "\n"))


def insights(cells: Column) -> Column:
    return F.format_string(INSIGHTS, F.to_json(cells))


def classify(classes: tuple[str, ...], text: Column, reach: int = 4000) -> Column:
    return F.format_string(CLASSIFY, F.lit(", ".join(classes)), F.substring(text, 1, reach))
