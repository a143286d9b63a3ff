"""Wide spreadsheet exports into rows of the long table."""

import datetime as dt
import io
import re
import zipfile
from functools import reduce
from urllib.parse import quote
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from wattline.functions.naming import clean_header, clean_name
from wattline.operators.changes import change_filter, has_changed, with_previous_row
from wattline.sources.files import file_system

# A cell behind its comma: it ends at a comma outside double quotes; a quote left open runs to the
# line's end. Every character is looked at once.
_CELL = r',((?:[^",]++|"[^"]*+(?:"|$))*+)'
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# Order of the lines of a file, and days of a file that a task puts in order at a time: exports have few rows a
# day, so a month of them is still a small piece.
_LINE_ORDER, _LINE_DAYS = ("timestamp", "block", "line_no"), 30

# Fixed value: day 0 of spreadsheet dates, 1899-12-30, in days before 1970.
_SHEET_EPOCH_DAYS = 25_569
# Day 0 of both calendars of workbooks, and the built-in number formats that show a date.
_EPOCHS = {False: dt.datetime(1899, 12, 30), True: dt.datetime(1904, 1, 1)}
_DATE_FORMATS = {*range(14, 18), 22, *range(27, 37), *range(50, 59)}
_LAST_DAY = 2_958_465
# What stands in the name of a file for rows without a value, as in Spark's folders.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


# Fixed value: the most bytes of a CSV file that is read as one row, so that its header is there with its lines.
WHOLE_FILE = 1 << 22
_MARK = "\ufeff"


def _cells(line):
    unquoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1)), lambda c: F.regexp_replace(F.trim(c), r'^"([\s\S]*)"$', "$1")
    )
    quoted = F.transform(unquoted, lambda c: F.replace(c, F.lit('""'), F.lit('"')))
    # Without quotes every comma ends a cell.
    plain = F.transform(F.split(line, ","), lambda c: F.trim(c))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def _header(cells):
    return F.transform(cells, lambda c: clean_header(F.coalesce(c, F.lit(""))))


def _once(**columns):
    """Columns behind a generator: what it gives is not worked out again for each filter and use above it."""
    return F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()])))


def read_export_lines(spark, path):
    """The lines of CSV exports with their file and place, title lines included.

    A file of up to ``WHOLE_FILE`` bytes is read as one row, so its lines also bring its ``header`` (null if it
    has none), and no join is needed for that; ``whole`` marks them. Larger files are cut into ranges.
    """
    small = F.col("_metadata.file_size") <= WHOLE_FILE
    file = F.col("_metadata.file_path").alias("file")
    ranges = spark.read.text(path).filter(~small).select(
        file,
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        _cells(F.regexp_replace("value", f"^{_MARK}|\r$", "")).alias("cells"),
        F.contains("value", F.lit("Time")).alias("titled"),
        F.lit(None).cast("array<string>").alias("header"),
        F.lit(False).alias("whole"),
    )
    text = spark.read.text(path, wholetext=True).filter(small).select(file, _unmarked(F.col("value")).alias("text"))
    # The text behind the last line end is a line only if there is any.
    ended = F.replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    texts = text.select("file", _once(all=F.split(ended, "\n"))).select("file", F.when(
        F.element_at("all", -1) == "", F.slice("all", 1, F.size("all") - 1)).otherwise(F.col("all")).alias("texts"))
    titles = F.transform(F.filter("texts", lambda x: F.contains(x, F.lit("Time"))), lambda x: _cells(_unmarked(x)))
    header = _header(F.get(F.filter(titles, lambda c: F.array_contains(c, "Time")), F.lit(0)))
    lines = texts.select("file", _once(header=header, texts=F.col("texts"))).select(
        "file", "header", F.posexplode_outer("texts").alias("line_no", "line")).filter("line IS NOT NULL")
    whole = lines.select(
        "file", "header", "line_no", F.contains("line", F.lit("Time")).alias("titled"),
        _once(cells=_cells(_unmarked(F.col("line")))))
    return ranges.unionByName(whole.select(
        "file", F.lit(0).cast("long").alias("block"), F.col("line_no").cast("long").alias("line_no"), "cells",
        "titled", "header", F.lit(True).alias("whole")))


def _unmarked(line):
    return F.when(F.startswith(line, F.lit(_MARK)), F.substring(line, 2, 2**31 - 1)).otherwise(line)


def read_xlsx_lines(spark, path, heads=False):
    """The same from the first sheet of ``.xlsx`` files; an unreadable file gives one line only. With
    ``heads`` a file is read as far as its header, the first line with a cell ``Time``.

    A sheet holds at most 1,048,576 rows, so a file is the unit of work, and files are spread
    over the tasks. Numbers whose format shows a date come as text of that date, by the workbook's own
    calendar (days since 1900 or 1904).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    lines = files.select("path", "content").mapInPandas(
        _sheet_heads if heads else _sheet_lines, "file string, line_no long, cells array<string>"
    )
    return lines.select("file", F.lit(0).cast("long").alias("block"), "line_no", "cells")


SHEET_LINES = 10_000


def _sheet_heads(batches):
    return _sheet_lines(batches, heads=True)


def _sheet_lines(batches, heads=False):
    for pdf in batches:
        for file, content in zip(pdf["path"], pdf["content"]):
            start, part = 0, []
            try:
                for row in sheet_rows(content):
                    part.append(row)
                    if heads and "Time" in row:
                        break
                    if len(part) == SHEET_LINES:
                        yield _as_lines(file, start, part)
                        start, part = start + SHEET_LINES, []
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                part.append([f"unreadable: {error}"])
            if part:
                yield _as_lines(file, start, part)


def _as_lines(file, start, part):
    return pd.DataFrame({"file": file, "line_no": range(start, start + len(part)), "cells": part})


def _first_sheet(book):
    """Name of the first sheet's part: the workbook names sheets by relations. Without that list it
    has the usual name."""
    if "xl/workbook.xml" not in book.namelist():
        return "xl/worksheets/sheet1.xml"
    sheet = next(ElementTree.parse(book.open("xl/workbook.xml")).iter(f"{_SHEET}sheet"), None)
    if sheet is None:
        raise KeyError("workbook without a sheet")
    for relation in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot():
        if relation.get("Id") == sheet.get(f"{_RELATION}id"):
            target = relation.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise KeyError("first sheet without a part")


def _elements(book, part, tag):
    """Elements of a part one by one, each dropped after use."""
    with book.open(part) as file:
        events = ElementTree.iterparse(file, events=("start", "end"))
        parents = []
        for event, element in events:
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if element.tag == f"{_SHEET}{tag}":
                yield element
                if parents:
                    parents[-1].remove(element)


def sheet_rows(content):
    """Cells of the first sheet of a workbook row by row, as text; None where a cell is empty."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in _elements(book, "xl/sharedStrings.xml", "si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
    dates, epoch = _date_styles(book), _EPOCHS[_counts_from_1904(book)]
    for row in _sheet_cells(book, _first_sheet(book)):
        cells = []
        for known, value, texts in row:
            place = _place(known["r"]) if "r" in known else 0
            place = place or len(cells) + 1
            cells += [None] * (place - len(cells))
            if known.get("t") == "inlineStr":
                cells[place - 1] = "".join(texts)
            elif value is not None:
                text = "".join(value) or None
                cells[place - 1] = shared[int(text)] if known.get("t") == "s" else text
                if known.get("t", "n") == "n" and int(known.get("s", 0)) in dates:
                    cells[place - 1] = _date_text(text, epoch)
        yield cells


def _place(reference):
    """Number of a cell's column, 0 if its reference names none."""
    return reduce(lambda n, c: n * 26 + ord(c) - 64, re.match("[A-Z]*", reference)[0], 0)


# Bytes of a sheet that are parsed at a time.
_SHEET_PART = 1 << 14


def _sheet_cells(book, part):
    """Rows of a sheet one by one: lists of (attributes, pieces of the value or None, texts) of their cells."""
    row_tag, cell_tag, value_tag, text_tag = (f"{_SHEET[1:]}{x}" for x in ("row", "c", "v", "t"))
    ready, open_cells, heard = [], [], [None]
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True

    def start(tag, attributes):
        heard[0] = None
        if tag == cell_tag:
            open_cells.append((attributes, None, []))
        elif tag == value_tag and open_cells and open_cells[-1][1] is None:
            heard[0] = []
            open_cells[-1] = (open_cells[-1][0], heard[0], open_cells[-1][2])
        elif tag == text_tag and open_cells:
            heard[0] = open_cells[-1][2]
        elif tag == row_tag:
            open_cells.clear()

    def end(tag):
        heard[0] = None
        if tag == row_tag:
            ready.append(open_cells.copy())
            open_cells.clear()

    def text(data):
        if heard[0] is not None:
            heard[0].append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    with book.open(part) as file:
        more = True
        while more:
            data = file.read(_SHEET_PART)
            more, fault = bool(data), None
            try:
                parser.Parse(data, not more)
            except expat.ExpatError as error:
                fault = ElementTree.ParseError(str(error))
            yield from ready
            ready.clear()
            if fault:
                raise fault


def _date_styles(book):
    """Numbers of the cell styles whose number format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_SHEET}numFmt")}
    dates = _DATE_FORMATS - set(own) | {n for n, code in own.items() if _shows_a_date(code)}
    used = styles.find(f"{_SHEET}cellXfs")
    return {i for i, x in enumerate(used if used is not None else ()) if int(x.get("numFmtId", 0)) in dates}


def _shows_a_date(code):
    """Whether a number format has a year or a day: outside of quotes, brackets and escapes, in its part for
    positive numbers."""
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code).split(";")[0].lower()
    return "general" not in plain and any(c in plain for c in "yd")


def _counts_from_1904(book):
    if "xl/workbook.xml" not in book.namelist():
        return False
    settings = next(ElementTree.parse(book.open("xl/workbook.xml")).iter(f"{_SHEET}workbookPr"), None)
    return settings is not None and settings.get("date1904", "0") in ("1", "true")


def _date_text(days, epoch):
    """Date and time of a number of days, to the millisecond; what is no date stays as it is."""
    if not re.match(_NUMBER, days) or not 0 <= float(days) <= _LAST_DAY:
        return days
    time = epoch + dt.timedelta(milliseconds=round(float(days) * 86_400_000))
    return time.isoformat(" ", "milliseconds" if time.microsecond else "seconds")


def write_exports(lines, path, file, text, titles=()):
    """Writes one CSV file ``<file>=<value>.csv`` for each value of the column ``file``: the title lines, then the
    column ``text`` of its rows. Returns (file, n_rows) once all are written.

    A file is made in one task, which writes it as rows come, and a task that runs again writes the same file
    again. There is one folder for all files, so that listing them takes one call.
    """
    spark = lines.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    head = "".join(f"{title}\n" for title in titles).encode()
    found = lines.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text"))

    def write(batches):
        system, at = file_system(path)
        out, name, count = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values, texts = batch.column("file"), batch.column("text").fill_null("")
            begins = np.ones(batch.num_rows, bool)
            same = pc.equal(values[1:], values[:-1]).fill_null(False)
            none = pc.and_(pc.is_null(values[1:]), pc.is_null(values[:-1]))
            begins[1:] = ~pc.or_(same, none).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(begins)
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            parts = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), "\n")
            done = []
            for value, part, n in zip(values.take(pa.array(starts)).to_pylist(), parts, np.diff(offsets).tolist()):
                if out is None or value != name:
                    if out is not None:
                        out.close()
                        done.append((name, count))
                    label = _NO_VALUE if value is None else quote(value, safe="")
                    out, name, count = system.open_output_stream(f"{at}/{file}={label}.csv"), value, 0
                    out.write(head)
                out.write(part.as_buffer())
                out.write(b"\n")
                count += n
            yield _written_files(done)
        if out is not None:
            out.close()
            yield _written_files([(name, count)])

    return found.repartition("file").sortWithinPartitions("file").mapInArrow(write, "file string, n_rows long")


def _written_files(done):
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "n_rows"])


def write_workbooks(rows, path, file, time, cells, from_1904=None):
    """Writes one ``.xlsx`` file for each value of column ``file`` (a long): two title lines, the names, then
    the rows. Returns (file, n_rows) once all are written.

    ``time`` is a timestamp column, written as a date; null is left blank. ``cells`` are the other columns by
    their headers. ``from_1904`` is a boolean column, one value a file. A file is made in one task, so the
    caller cuts its rows to what a sheet can hold. A task that runs again writes the same file again.
    """
    headers = list(cells)

    def write(pdf):
        number = int(pdf["file"].iloc[0])
        first = bool(pdf["from_1904"].iloc[0])
        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{number}.xlsx") as out:
            out.write(_workbook(pdf, headers, first))
        return pd.DataFrame({"file": [number], "n_rows": [len(pdf)]})

    named = {f"c{i}": column for i, column in enumerate(cells.values())}
    inputs = rows.select(
        F.col(file).cast("long").alias("file"), F.unix_millis(time).alias("time"),
        F.lit(False).alias("from_1904") if from_1904 is None else F.coalesce(from_1904, F.lit(False)).alias("from_1904"),
        *[c.cast("string").alias(n) for n, c in named.items()],
    )
    return inputs.groupBy("file").applyInPandas(write, "file long, n_rows long")


def _workbook(pdf, headers, from_1904):
    """Bytes of a workbook: numbers as numbers, other texts in place, times by the second of two styles."""
    space = f'xmlns="{_SHEET[1:-1]}"'
    day0 = (_EPOCHS[from_1904] - dt.datetime(1970, 1, 1)).days

    def cell(text):
        if text is None:
            return "<c/>"
        kind = f"<v>{text}</v>" if re.match(_NUMBER, text) else None
        return f"<c>{kind}</c>" if kind else f'<c t="inlineStr"><is><t>{escape(text)}</t></is></c>'

    lines = [["Report"], [], ["Time", *headers]]
    body = ["".join(map(cell, line)) for line in lines]
    columns = [pdf[f"c{i}"] for i in range(len(headers))]
    for time, *values in zip(pdf["time"], *columns, strict=True):
        at = "<c/>" if pd.isna(time) else f'<c s="1"><v>{time / 86_400_000 - day0!r}</v></c>'
        body.append(at + "".join(cell(None if v is None else v) for v in values))
    sheet = "".join(f'<row r="{i}">{x}</row>' for i, x in enumerate(body, 1))
    parts = {
        "xl/workbook.xml": f'<workbook {space} xmlns:r="{_RELATION[1:-1]}"><workbookPr date1904="{int(from_1904)}"/>'
        '<sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {space}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData>{sheet}</sheetData></worksheet>",
    }
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in parts.items():
            out.writestr(name, text)
    return book.getvalue()


def export_headers(lines):
    """One row per file: its cleaned header, the first line with a cell ``Time``."""
    # A cell "Time" stands in its line's text, so that other lines need not be cut into cells here.
    heads = lines.filter("titled") if "titled" in lines.columns else lines
    heads = heads.filter(F.array_contains("cells", "Time"))
    # Files that are read whole are told apart, so that ``wide_rows`` can leave their headers out.
    keys = [c for c in ("file", "whole") if c in lines.columns]
    return heads.groupBy(*keys).agg(F.min_by(_header(F.col("cells")), F.struct("block", "line_no")).alias("header"))


def bad_exports(lines):
    """Files without a header line; the import leaves them out."""
    files = lines.groupBy("file").agg(
        F.max(F.coalesce(F.array_contains("cells", "Time"), F.lit(False))).alias("has_header")
    )
    return files.filter(~F.col("has_header")).select("file")


def read_wide_exports(spark, path, xlsx=False):
    """Rows of all exports of a folder: file, place, Time and cells (register_name, raw).

    Every file brings its own header, so files with different columns are read in one plan.
    """
    lines = read_xlsx_lines(spark, path) if xlsx else read_export_lines(spark, path)
    return wide_rows(lines, export_headers(read_xlsx_lines(spark, path, heads=True) if xlsx else lines))


def wide_rows(lines, headers):
    """Rows of files from their lines; lines that bring no header get that of their file from ``headers``."""
    if "whole" in lines.columns:
        found = lines.filter("whole AND header IS NOT NULL").drop("whole")
        ranges = lines.filter("NOT whole").drop("whole", "header")
        named = ranges.join(headers.filter("NOT whole").drop("whole"), "file").unionByName(found)
    else:
        named = lines.join(headers, "file")
    time = F.get("cells", F.array_position("header", "Time").cast("int") - 1)
    pairs = F.arrays_zip(F.col("header").alias("register_name"), F.col("cells").alias("raw"))
    # The header and what stands above it hold no time and go with the other unreadable rows.
    return named.filter(time != "Time").select(
        "file", "block", "line_no", time.alias("Time"),
        F.filter(pairs, lambda p: p["register_name"] != "Time").alias("cells"),
    )


def numeric(raw):
    """Number in a cell, NULL if it is none."""
    return F.when(raw.rlike(_NUMBER), raw.try_cast("double"))


def time_of(text):
    """Time of a row: a date in text, or a spreadsheet's number of days; NULL if unreadable."""
    dashed = F.translate(text, "/", "-")
    days = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    seconds = F.round((days - _SHEET_EPOCH_DAYS) * 86_400, 3)
    sheet = F.when(days.between(1, 2_958_465), F.timestamp_millis((seconds * 1000).cast("long")))
    return F.when(F.contains(dashed, F.lit("-")), F.try_to_timestamp(dashed)).otherwise(sheet)


def unpivot_rows(rows, known):
    """Long rows of the known registers, NULLs included, with the time also as a timestamp.

    Rows without a time or without any non-zero value go first, as they do in ``unpivot_table``.
    """
    kept = F.filter("cells", lambda c: c["register_name"].isin(list(known)))
    values = F.transform(
        kept, lambda c: F.struct(c["register_name"].alias("register_name"), numeric(c["raw"]).alias("value"))
    )
    cleaned = rows.filter(F.trim("Time") != "").select("file", "block", "line_no", "Time", _once(cells=values))
    return cleaned.filter(F.exists("cells", lambda c: c["value"] != 0)).select(
        "file", "block", "line_no", "Time", time_of(F.col("Time")).alias("timestamp"), F.inline("cells")
    )


def unpivot_table(df, known, time="Time", file="file", line_no="line_no", previous=False):
    """The same from a wide table whose columns are known when the query is written.

    Plain columns instead of arrays of cells keep this in generated code. With ``previous`` rows also have the
    register's value in the line before (``previous``), for ``import_long``: lines are put in order before they
    become a row for each register. Lines without a file or a readable time have no place in that order and are
    left out.
    """
    texts = dict(df.dtypes)
    named = {c: clean_name(c) for c in df.columns if c not in (time, file, line_no)}
    kept = {c: name for c, name in named.items() if name in known}
    # Columns of one name are one series, in which a line has several rows; these get in order as long rows.
    previous = previous and len(set(kept.values())) == len(kept)
    numbers = {
        c: numeric(F.col(f"`{c}`")) if texts[c] == "string" else F.col(f"`{c}`").cast("double") for c in kept
    }
    rows = df.select(
        F.col(file).alias("file"), F.lit(0).cast("long").alias("block"),
        F.col(line_no).cast("long").alias("line_no"), F.col(time).cast("string").alias("Time"),
        *[value.alias(f"c{i}") for i, value in enumerate(numbers.values())],
    ).filter(F.trim("Time") != "")
    place = ["file", "block", "line_no", "Time"]
    columns = [F.col(f"c{i}") for i in range(len(kept))]
    if previous:
        # What a generator gives is not worked out again for filters, nor for both uses of the lines in order.
        # The values travel as one array, so there is one window function however many registers there are.
        read = F.struct(time_of(F.col("Time")).alias("timestamp"), F.array(*columns).cast("array<double>").alias("v"))
        rows = rows.select(*place, F.inline(F.array(read))).filter("timestamp IS NOT NULL AND file IS NOT NULL")
        columns = [F.get("v", F.lit(i)) for i in range(len(kept))]
    nonzero = [F.coalesce(c != 0, F.lit(False)) for c in columns]
    lines = rows.filter(reduce(lambda a, b: a | b, nonzero, F.lit(False)))
    if previous:
        lines = with_previous_row(lines, ["file"], _LINE_ORDER, ["v"], days=_LINE_DAYS)
    else:
        # The time of a line is read here, not in the rows that it becomes.
        lines = lines.withColumn("timestamp", time_of(F.col("Time")))
    cells = F.array(*[
        F.struct(F.lit(name).alias("register_name"), columns[i].alias("value"),
                 *([F.get("prev_v", F.lit(i)).alias("previous")] if previous else []))
        for i, name in enumerate(kept.values())
    ])
    if not kept:
        more = ", previous: double" if previous else ""
        cells = cells.cast(f"array<struct<register_name: string, value: double{more}>>")
    return lines.select(*place, "timestamp", F.inline(cells))


def import_wide(rows, known, device_id=1):
    """Long rows of an import from the rows of its files."""
    return import_long(unpivot_rows(rows, known), device_id)


def import_long(long_rows, device_id=1):
    """The readings to store: changes only within each file, no NULLs or zeros.

    Zeros and NULLs go after the change filter, so a value that returns after one is kept. A row
    with an unreadable time is left out; ``unreadable_times`` lists those. Rows that bring the value
    before them (``previous``) need not be put in order here.
    """
    timed = long_rows.drop("Time").filter(
        "timestamp IS NOT NULL AND file IS NOT NULL AND register_name IS NOT NULL"
    )
    if "previous" in long_rows.columns:
        changed = timed.filter(has_changed(F.col("value"), F.col("previous")))
    else:
        changed = change_filter(timed, ["file", "register_name"], order=_LINE_ORDER, days=_LINE_DAYS)
    return changed.filter("value <> 0").select(
        F.unix_timestamp("timestamp").alias("id"),
        F.lit(device_id).cast("int").alias("device_id"),
        "timestamp", "register_name", "value", "file",
    )


def unreadable_times(long_rows):
    """Places of the rows that an import leaves out because their time cannot be read."""
    return long_rows.filter("timestamp IS NULL").select("file", "block", "line_no", "Time").distinct()


def missing_columns(headers, known):
    """Per file, the known registers it has no column for."""
    wanted = F.array(*[F.lit(k) for k in known])
    return headers.select("file", F.explode(F.array_except(wanted, "header")).alias("register_name"))
