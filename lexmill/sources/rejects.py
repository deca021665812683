"""Problem 4: loading weighted corpus lines and setting apart those that cannot be loaded.

A line has three TAB-separated fields: text, weight, meta. Every Arrow batch of lines goes
through DuckDB's CSV reader on the worker, typed and with its reject tables on; the line-level
errors are joined to the raw records, and their kinds, columns and positions are the reasons. One
raw line is one record, so line breaks inside it are escaped before, a last field is added (the
reader overlooks empty fields too many at the end), and a record whose quotes could swallow its
neighbours gets a file of its own.

The reader differs from the format in four points, for which what it says isn't taken as it is: it
lets a blank follow a closing quote, takes a quote after a blank for an opening one, and gives
neither row nor error for a file that ends inside a quote (so records with such quotes are scanned
exactly, unless it rejects a quote that begins its field); and it reads signs, blanks and decimals
as a weight (so the raw weight of a loaded row is looked at).
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOADED = "raw_id bigint, text string, weight bigint, meta string, reason string, detail string, raw_line string"
MOST_WEIGHT = 2**63 - 1
#: Fields that are empty, quoted as they should be, or without any quote.
PLAIN = re.compile(r'(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*')
#: A field that begins with a quote, up to its closing quote; and what may not follow that.
QUOTED = re.compile(r'"(?:[^"]|"")*"')
BLANK_BEFORE = re.compile(r'(?:^|\t)[^\S\t]+"')
WEIGHT = re.compile(r"[0-9]+")
LONGEST = 64 << 20
#: A private-use character that stands before an escaped line break.
MARK = "\ue000"


def escaped(line: str) -> str:
    return line.replace(MARK, MARK + "0").replace("\n", MARK + "1").replace("\r", MARK + "2")


def restored(field: str) -> str:
    if MARK not in field:
        return field
    return re.sub(MARK + "([012])", lambda m: {"0": MARK, "1": "\n", "2": "\r"}[m[1]], field)


#: Kinds of the reader's errors, in the order of the checks, with the reason each stands for.
KINDS = {"UNQUOTED VALUE": "quoting", "MISSING COLUMNS": "columns", "TOO MANY COLUMNS": "columns", "CAST": "invalid_value"}


def scan(line: str) -> tuple[list[str], str]:
    """The fields of a line and '', or what it has of them and what is wrong with a quote."""
    fields, at = [], 0
    while True:
        if line.startswith('"', at):
            m = QUOTED.match(line, at)
            if not m:
                return fields, "no closing quote"
            if m.end() < len(line) and line[m.end()] != "\t":
                return fields, "text after a closing quote"
            fields.append(m[0][1:-1].replace('""', '"'))
            at = m.end()
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            return fields, ""
        at += 1


def in_range(digits: str) -> bool:
    digits = digits.lstrip("0")
    return 0 < len(digits) <= 19 and int(digits) <= MOST_WEIGHT


@dataclass
class Read:
    """What the reader made of the lines of a batch, by line number."""

    rows: dict[int, tuple[str, int | None, str]]
    errors: dict[int, tuple[str, str]]


def _read(con, folder: str, lines: list[str | None]) -> Read:
    single = [i for i, x in enumerate(lines) if x is not None and not PLAIN.fullmatch(x)]
    alone = set(single)
    bulk = [i for i, x in enumerate(lines) if x is not None and i not in alone]
    files, numbers = [], []
    for own in ([bulk] if bulk else []) + [[i] for i in single]:
        path = os.path.join(folder, f"{len(files)}.tsv")
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.writelines(f"{i}\t{escaped(lines[i])}\t.\n" for i in own)
        files.append(path)
        numbers.append(own)
    if not files:
        return Read({}, {})
    columns = {"n": "BIGINT", "text": "VARCHAR", "weight": "BIGINT", "meta": "VARCHAR", "last": "VARCHAR"}
    con.execute("drop table if exists reject_errors")
    con.execute("drop table if exists reject_scans")
    rows = con.execute(
        "select n, coalesce(text, ''), weight, coalesce(meta, '') from read_csv($1, delim='\t', quote='\"', escape='\"', header=false, auto_detect=false, "
        f"columns={columns}, store_rejects=true, rejects_limit=0, null_padding=false, new_line='\\n', strict_mode=true, parallel=false, max_line_size={LONGEST})",
        [files],
    ).fetchall()
    read = Read({n: (restored(text), weight, restored(meta)) for n, text, weight, meta in rows}, {})
    place = {os.path.basename(p): own for p, own in zip(files, numbers)}
    order = list(KINDS)
    found = con.execute(
        "select f.file_path, e.line, e.error_type::varchar, e.column_name, e.byte_position - e.line_byte_position from reject_errors e join reject_scans f using (scan_id, file_id)"
    ).fetchall()
    rank = lambda kind: order.index(kind) if kind in order else len(order)
    for path, line, kind, column, at in sorted(found, key=lambda x: rank(x[2]), reverse=True):  # the first failing check last, so that it stays
        own = place[os.path.basename(path)]
        i = own[min(int(line), len(own)) - 1]
        at = None if at is None else at - len(str(i)) - 1
        read.errors[i] = kind, f"{kind.lower()} in {column}" + (f" at byte {at}" if at is not None and at >= 0 else "")
    for p in files:
        os.unlink(p)
    return read


def judged(line: str | None, row: tuple[str, int | None, str] | None, error: tuple[str, str] | None) -> tuple[str | None, int | None, str | None, str | None, str | None]:
    """text, weight, meta, reason, detail of one line, given the reader's row and its error, if any."""
    refused = lambda reason, detail: (None, None, None, reason, detail)
    if line is None:
        return refused("columns", "no line")
    if PLAIN.fullmatch(line):
        if error:
            if error[0] not in KINDS:
                raise ValueError(f"the reader rejects a line for {error[1]}")
            return refused(KINDS[error[0]], error[1])
        if row is None:
            raise ValueError("the reader gives neither a row nor an error for a line")
        text, weight, meta = row
        raw = line.split("\t")[1] if '"' not in line else scan(line)[0][1]
    else:
        if error and KINDS.get(error[0]) == "quoting" and not BLANK_BEFORE.search(line):
            return refused("quoting", error[1])
        fields, wrong = scan(line)  # the reader is laxer than the format about quotes
        if wrong:
            return refused("quoting", wrong)
        if len(fields) != 3:
            return refused("columns", f"{len(fields)} columns")
        text, raw, meta = fields
        weight = int(raw) if WEIGHT.fullmatch(raw) and in_range(raw) else None
    if not text.strip():
        return refused("invalid_value", "blank text")
    if weight is None or weight < 1 or not WEIGHT.fullmatch(raw):  # the reader takes signs, blanks and decimals too
        return refused("invalid_value", "weight is not a number" if not WEIGHT.fullmatch(raw) else "weight out of range")
    return text, weight, meta, None, None


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    with tempfile.TemporaryDirectory(prefix="lines-") as folder:
        for b in batches:
            lines = b.column(1).to_pylist()
            read = _read(con, folder, lines)
            rows = [judged(x, read.rows.get(i), read.errors.get(i)) for i, x in enumerate(lines)]
            rows = [(*row, line if row[3] else None) for row, line in zip(rows, lines)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[f.split()[0] for f in LOADED.split(", ")])
    con.close()


def load_lines(df: DataFrame, key: str = "raw_id", line: str = "raw_line") -> DataFrame:
    """One typed row for each line: ``raw_id, text, weight, meta`` where it loads, else ``reason, detail, raw_line``.

    Reasons, first failing check first: 'quoting' (a quoted field without closing quote, or with
    anything but TAB or the end after it), 'columns' (not three fields), 'invalid_value' (text
    without a non-blank character; weight not of ASCII digits or not from 1 to 2^63-1). A null
    line counts as 'columns'; the empty line has one field. Repeated lines stay repeated, other
    columns are ignored, an empty table gives an empty table.
    """
    return df.select(F.col(key).alias("raw_id"), F.col(line).alias("raw_line")).mapInArrow(_loaded, LOADED)
