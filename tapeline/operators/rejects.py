"""Price lines: valid rows and, apart from them, each failing line with its reason.

A block of lines goes through a bulk columnar parse first, plain lines and properly quoted ones each by a reader of
their kind. Where a block can't be parsed, it is halved again and again until the bad records stand alone. What is
parsed is checked by whole columns. Only lines that fall out of the shape, the parse or a check are read by the
strict, character-by-character reader, which alone decides about a failure and its reason.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("date", "symbol", "open", "high", "low", "close", "adj_close", "volume")
REASONS = ("quoting", "column_count", "date", "symbol", "close")
#: Blocks of so few lines are read strictly: another bulk parse would cost more.
LEAF = 8
_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
#: The whole shape of a line with quoted fields, and values that the bulk checks take for valid; others are read strictly.
_QUOTED_LINE = r'^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*)){7}$'
_PLAIN_DAY, _PLAIN_CLOSE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,2})?$"
_READ = pacsv.ReadOptions(column_names=list(COLUMNS), use_threads=False, block_size=1 << 24)
_PARSE = {quoted: pacsv.ParseOptions(quote_char='"' if quoted else False, double_quote=quoted, escape_char=False, newlines_in_values=False, ignore_empty_lines=False) for quoted in (False, True)}
_CONVERT = pacsv.ConvertOptions(column_types=dict.fromkeys(COLUMNS, pa.string()), include_columns=["date", "symbol", "close"], strings_can_be_null=False, quoted_strings_can_be_null=False, check_utf8=False)
_OUT = pa.schema([("line_id", pa.int64()), ("reason", pa.string()), ("date", pa.date32()), ("symbol", pa.string()), ("close", pa.float64())])


def split_strict(line: str) -> list[str] | None:
    """The fields of a line, quotes taken off; None where the quoting is broken."""
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return None
                if line.startswith('""', end):
                    end += 2
                    continue
                break
            if end + 1 < n and line[end + 1] != ",":
                return None
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = line.find(",", at)
            field = line[at:] if end < 0 else line[at:end]
            if '"' in field:
                return None
            fields.append(field)
            at += len(field)
        if at >= n:
            return fields
        at += 1


def diagnose(line: str | None, symbols: frozenset[str]) -> tuple[str | None, date | None, str | None, float | None]:
    """(reason, date, symbol, close) of one line: a reason, or the values. A null line has no columns."""
    if line is None:
        return "column_count", None, None, None
    fields = split_strict(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return "quoting", None, None, None
    if len(fields) != len(COLUMNS):
        return "column_count", None, None, None
    day, symbol, close = fields[0].strip(), fields[1].strip().upper(), fields[5].strip()
    try:
        when = date.fromisoformat(day) if _DAY.fullmatch(day) else None
    except ValueError:
        when = None
    if when is None:
        return "date", None, None, None
    symbol = "^VIX" if symbol == "VIX" else symbol
    if symbol not in symbols:
        return "symbol", None, None, None
    value = float(close) if _DECIMAL.fullmatch(close) else 0.0
    if not 0 < value < math.inf:  # 1e999 is not finite as a double
        return "close", None, None, None
    return None, when, symbol, value


def _bulk(lines: pa.Array, quoted: bool) -> list[tuple[int, int, pa.Table | None]]:
    """(from, to, date, symbol and close as text) of the lines in order; no table where LEAF lines or fewer can't be parsed."""
    out, waiting = [], [(0, len(lines))]
    while waiting:
        a, b = waiting.pop()
        table = None
        try:
            some = lines.slice(a, b - a)
            block = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_buffer()
            table = pacsv.read_csv(pa.BufferReader(block), _READ, _PARSE[quoted], _CONVERT)
        except pa.ArrowInvalid:
            pass
        if table is not None and table.num_rows == b - a:
            out.append((a, b, table))
        elif b - a <= LEAF:
            out.append((a, b, None))
        else:
            mid = (a + b) // 2
            waiting += [(mid, b), (a, mid)]
    return out


def _days(text: pa.ChunkedArray, shaped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days, which of them exist) of ISO days; those not `shaped` so don't."""
    iso = pc.if_else(pa.array(shaped), text, "0001-01-01")
    y, m, d = (pc.cast(pc.utf8_slice_codeunits(iso, a, b), pa.int64()).to_numpy() for a, b in ((0, 4), (5, 7), (8, 10)))
    inside = shaped & (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = ((y - 1970) * 12 + np.where(inside, m, 1) - 1).astype("datetime64[M]")
    length = ((month + 1).astype("datetime64[D]") - month.astype("datetime64[D]")).astype(np.int64)
    return month.astype("datetime64[D]") + (d - 1), inside & (d <= length)


def _checked(table: pa.Table, symbols: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(valid, dates, symbols, closes) of parsed columns."""
    day, close = pc.utf8_trim_whitespace(table["date"]), pc.utf8_trim_whitespace(table["close"])
    name = pc.utf8_upper(pc.utf8_trim_whitespace(table["symbol"]))
    name = pc.if_else(pc.equal(name, "VIX"), "^VIX", name)
    days, real = _days(day, pc.match_substring_regex(day, _PLAIN_DAY).to_numpy())
    number = pc.match_substring_regex(close, _PLAIN_CLOSE)
    value = pc.cast(pc.if_else(number, close, "0"), pa.float64()).to_numpy()
    valid = real & pc.is_in(name, value_set=symbols).to_numpy() & (value > 0) & np.isfinite(value)
    return valid, days, name.to_numpy(), value


def parse_block(ids: pa.Array, lines: pa.Array, symbols: frozenset[str]) -> pa.Table:
    """One row per line, in order: the reason of the failure, or date, symbol and close."""
    n, known = len(lines), pa.array(sorted(symbols), pa.string())
    if not n:
        return _OUT.empty_table()
    reason, day, name, close = np.full(n, None, object), np.full(n, "NaT", "datetime64[D]"), np.full(n, None, object), np.zeros(n)
    good = np.zeros(n, bool)
    body = pc.replace_substring_regex(lines, "\r$", "")
    flag = lambda x: x.fill_null(False).to_numpy(zero_copy_only=False)
    one_line = flag(pc.invert(pc.match_substring_regex(body, "[\r\n]")))
    has_quote = flag(pc.match_substring(body, '"'))
    eight = flag(pc.equal(pc.count_substring(body, ","), len(COLUMNS) - 1))
    shaped = {False: one_line & ~has_quote & eight, True: one_line & has_quote}
    if shaped[True].any():
        at = np.flatnonzero(shaped[True])
        shaped[True][at] = flag(pc.match_substring_regex(body.take(pa.array(at)), _QUOTED_LINE))
    for quoted, mask in shaped.items():
        at = np.flatnonzero(mask)
        for a, b, table in _bulk(body.take(pa.array(at)), quoted) if len(at) else ():
            if table is not None:
                here = at[a:b]
                good[here], day[here], name[here], close[here] = _checked(table, known)
    rest = np.flatnonzero(~good)
    for i, line in zip(rest.tolist(), lines.take(pa.array(rest)).to_pylist()):
        why, when, symbol, value = diagnose(line, symbols)
        reason[i], name[i] = why, symbol
        day[i], close[i], good[i] = (np.datetime64("NaT") if when is None else np.datetime64(when)), value or 0.0, why is None
    columns = pa.array(reason, pa.string()), pa.array(day, pa.date32(), mask=~good), pa.array(name, pa.string(), mask=~good), pa.array(close, pa.float64(), mask=~good)
    return pa.table([ids, *columns], schema=_OUT)


def parse_price_lines(lines: DataFrame, symbols: DataFrame, id_column: str = "line_id", line_column: str = "line", max_symbols: int = 1_000_000) -> DataFrame:
    """(line_id, reason, date, symbol, close) of every line, in one narrow pass without a shuffle.

    `symbols` has the valid ones in its first column; the list goes to every task and may hold `max_symbols`
    at most, more is an error. A null line counts as no columns, an empty one too; very long lines are read
    whole. Repeated lines stay repeated, an empty table gives an empty result; no other column is read.
    """
    names = [r[0] for r in symbols.select(F.upper(F.trim(F.col(symbols.columns[0])))).distinct().limit(max_symbols + 1).collect()]
    if len(names) > max_symbols:
        raise ValueError(f"more than {max_symbols} symbols")
    known = frozenset(x for x in names if x)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from parse_block(batch.column(0), batch.column(1).cast(pa.string()), known).combine_chunks().to_batches()

    return lines.select(F.col(f"`{id_column}`").cast("bigint").alias("line_id"), F.col(f"`{line_column}`").cast("string").alias("line")).mapInArrow(blocks, "line_id bigint, reason string, date date, symbol string, close double")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "reason")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select("line_id", "date", "symbol", "close")
