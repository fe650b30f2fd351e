"""Several values packed in one field: one value per row, with its place.

The scan works on the Arrow string buffer of a whole batch. Masks over the
bytes mark quotes and delimiters; the parity of a running count of quotes says
which delimiters lie inside quotes; the delimiters left give the item offsets,
from which an Arrow list array is built and flattened with the ordinals of its
parents. No row is visited by itself, but for the few items that hold escapes.

What separates depends on the kind of field (``KINDS``):

* the record separator ``<SEP>`` (any case, also HTML-escaped) separates
  everywhere, outside JSON arrays;
* a bracketed field is read as an array of quoted strings, with either quote
  and with backslash escapes;
* ``terms`` also takes comma, semicolon, bar, tab, line end, and a slash or
  middle dot between spaces; a comma between digits belongs to a number;
* ``ids`` also takes white space;
* ``prose`` takes line ends and a double bar; comma and semicolon separate
  only between a closing and an opening quote, as in ``"A.","B."``.

Defined results
---------------
* Null, empty and blank fields have no values. Empty items are dropped and do
  not count; repeated items are kept, each at its place, counting from 1.
* Items are trimmed, freed of enclosing quotes, with ``""``, backslash and
  HTML escapes undone; case is kept.
* In a segment with an odd number of quotes, quotes are ordinary characters.
* Very long fields are scanned whole. Only the named columns are read, so
  further columns may have any names.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweir.functions.arrow_text import bytes_and_bounds, gather

KINDS = ("terms", "ids", "prose")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SEP_MARKS = (b"<sep>", b"<|sep|>", b"&lt;sep&gt;", b"&lt;|sep|&gt;")


def _near(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, the last non-space byte before it and the first after it
    in the same row; 0 at the row's edge. A no-break space counts as space."""
    n = len(raw)
    blank = SPACE[raw].copy()
    nbsp = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] == 0xA0)) if n > 1 else np.zeros(0, int)
    blank[nbsp] = blank[nbsp + 1] = True
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(blank, -1, at))
    before = np.concatenate([[-1], last[:-1]])
    first = np.minimum.accumulate(np.where(blank, n, at)[::-1])[::-1]
    after = np.concatenate([first[1:], [n]])
    prev = np.where((before >= bounds[rows]), raw[np.maximum(before, 0)], 0)
    following = np.where((after < bounds[rows + 1]), raw[np.minimum(after, n - 1)], 0)
    return prev, following


def _marks(raw: np.ndarray, lower: np.ndarray, mark: bytes) -> np.ndarray:
    """Starts of ``mark`` in the bytes, without regard to case."""
    n, m = len(raw), len(mark)
    if n < m:
        return np.zeros(0, int)
    at = np.flatnonzero(lower[: n - m + 1] == mark[0])
    for k in range(1, m):
        at = at[lower[at + k] == mark[k]]
    return at


def split_buffer(raw: np.ndarray, bounds: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end of every non-empty item in buffer order, untrimmed of
    quotes, and whether its row is a bracketed array."""
    n, rows_n = len(raw), len(bounds) - 1
    empty = np.zeros(0, np.int64)
    if n == 0:
        return empty, empty, empty, np.zeros(0, bool)
    lengths = np.diff(bounds)
    rows = np.repeat(np.arange(rows_n), lengths)
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    prev, following = _near(raw, bounds)
    solid = ~SPACE[raw]
    first = np.full(rows_n, -1)
    last = np.full(rows_n, -1)
    at = np.flatnonzero(solid)
    first[rows[at][::-1]] = at[::-1]
    last[rows[at]] = at
    some = first >= 0
    array = np.zeros(rows_n, bool)
    array[some] = (raw[first[some]] == ord("[")) & (raw[last[some]] == ord("]")) & (first[some] < last[some])
    in_array = array[rows]

    # record separators end a segment wherever they stand; quotes are counted anew in each segment
    width = np.zeros(n, np.int64)  # bytes that a delimiter starting here takes
    for mark in SEP_MARKS:
        found = _marks(raw, lower, mark)
        found = found[~in_array[found] & (rows[found] == rows[np.minimum(found + len(mark) - 1, n - 1)])]
        width[found] = np.maximum(width[found], len(mark))
    hard = width > 0
    segment = np.cumsum(hard) + rows
    double = raw == ord('"')
    single = raw == ord("'")

    # outside arrays: parity of the double quotes before each byte of its segment
    plain_quote = double & ~in_array
    count = np.cumsum(plain_quote)
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    number = np.cumsum(np.concatenate([[0], (segment[1:] != segment[:-1])])).astype(np.int64)
    base = (count - plain_quote)[starts]
    total = np.concatenate([count[starts[1:] - 1], [count[-1]]]) - base
    odd = (total % 2 == 1)[number]
    inside = ((count - base[number]) % 2 == 1) & ~odd & ~in_array

    # in arrays: a quote opens after [ or , and closes before , or ]; escaped ones do neither
    back = raw == ord("\\")
    if in_array.any():
        run_start = np.maximum.accumulate(np.where(~back, np.arange(n), -1))
        run = np.concatenate([[0], (np.arange(n) - run_start)[:-1]])
        escaped = run % 2 == 1
        quote = (double | single) & in_array & ~escaped
        opens = quote & ((prev == ord("[")) | (prev == ord(",")))
        closes = quote & ((following == ord(",")) | (following == ord("]"))) & ~(opens & (following != ord(",")) & (following != ord("]")))
        # between an opening and the next closing quote of the same kind everything is inside
        event = np.flatnonzero(opens | closes)
        state = np.zeros(n, np.int64)
        kept, open_by, row_of = [], 0, -1
        for e in event.tolist():  # quotes of bracketed rows only
            if rows[e] != row_of:
                open_by, row_of = 0, rows[e]
            if not open_by and opens[e]:
                open_by = raw[e]
                kept.append((e, 1))
            elif open_by == raw[e] and closes[e]:
                open_by = 0
                kept.append((e, -1))
        if kept:
            where, change = np.array(kept).T
            state[where] = change
        depth = np.cumsum(state)
        row_base = np.where(bounds[:-1] > 0, depth[np.maximum(bounds[:-1] - 1, 0)], 0)
        inside |= in_array & ((depth - row_base[rows]) > 0)

    free = ~inside & ~hard
    comma, semicolon = raw == ord(","), raw == ord(";")
    entity = np.zeros(n, bool)  # the semicolon that ends an HTML entity
    for name in (b"&amp;", b"&quot;", b"&apos;", b"&#39;", b"&lt;", b"&gt;"):
        found = _marks(raw, lower, name)
        entity[found + len(name) - 1] = True
    one = np.zeros(n, bool)
    one |= in_array & comma
    outer = ~in_array
    if kind == "prose":
        listed = (prev == ord('"')) & (following == ord('"'))
        one |= outer & listed & (comma | semicolon)
        one |= outer & ((raw == 10) | (raw == 13))
        bar = raw == ord("|")
        pair = bar & np.concatenate([bar[1:], [False]])
        one |= outer & (pair | (bar & np.concatenate([[False], pair[:-1]])))
    else:
        left = np.concatenate([[0], raw[:-1]])
        right = np.concatenate([raw[1:], [0]])
        number_comma = comma & DIGIT[left] & DIGIT[right]
        one |= outer & ((comma & ~number_comma) | (semicolon & ~entity) | (raw == ord("|")) | (raw == 9) | (raw == 10) | (raw == 13))
        if kind == "ids":
            one |= outer & SPACE[raw]
        else:
            one |= outer & (raw == ord("/")) & SPACE[left] & SPACE[right]
            dot = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] == 0xB7)) if n > 1 else empty
            dot = dot[free[dot] & outer[dot]]
            edge_left = (dot == bounds[rows[dot]]) | SPACE[left[dot]]
            edge_right = (dot + 2 >= bounds[rows[dot] + 1]) | SPACE[raw[np.minimum(dot + 2, n - 1)]]
            width[dot[edge_left & edge_right]] = 2
    width[one & free] = 1
    if array.any():  # the brackets themselves
        width[first[array]] = 1
        width[last[array]] = 1

    cuts = np.flatnonzero(width)
    ends_of_cuts = cuts + width[cuts]
    item_start = np.concatenate([bounds[:-1], ends_of_cuts])
    item_end_key = np.concatenate([cuts, bounds[1:]])
    item_start.sort()
    item_end_key.sort()
    # every start has the next end as its partner: both lists hold one entry per row and one per cut
    starts_, ends_ = item_start, item_end_key
    # trim spaces and no-break spaces
    blank = SPACE[raw].copy()
    nbsp = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] == 0xA0)) if n > 1 else empty
    blank[nbsp] = blank[nbsp + 1] = True
    positions = np.arange(n)
    next_solid = np.minimum.accumulate(np.where(blank, n, positions)[::-1])[::-1]
    last_solid = np.maximum.accumulate(np.where(blank, -1, positions))
    begins = np.where(starts_ < ends_, next_solid[np.minimum(starts_, n - 1)], ends_)
    stops = np.where(starts_ < ends_, last_solid[np.maximum(ends_ - 1, 0)] + 1, starts_)
    keep = (starts_ < ends_) & (begins < stops) & (begins < ends_)
    begins, stops = begins[keep], stops[keep]
    row = rows[begins] if len(begins) else empty
    return row, begins, stops, array[row] if len(row) else np.zeros(0, bool)


_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(text: str, array: bool) -> str:
    if array and "\\" in text:
        try:
            text = json.loads(f'"{text}"')
        except ValueError:
            text = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)
    return html.unescape(text) if "&" in text and ";" in text else text


def split_column(column: pa.Array, kind: str) -> pa.ListArray:
    """The values of each row of a string array, as a list array."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    raw, bounds = bytes_and_bounds(column)
    row, start, end, array = split_buffer(raw, bounds, kind)
    rows_n = len(bounds) - 1
    if len(row):
        head, tail = raw[start], raw[end - 1]
        quoted = (end - start >= 2) & (head == tail) & ((head == ord('"')) | ((head == ord("'")) & array))
        if quoted.any():  # a quote pair encloses only if each quote between is escaped
            lone = _lone_quotes(raw, start, end, quoted, array)
            quoted &= ~lone
        items = gather(raw, start + quoted, end - quoted)
        doubled = pc.and_(pa.array(quoted & ~array), pc.match_substring(items, '""'))
        if pc.any(doubled).as_py():
            items = pc.if_else(doubled, pc.replace_substring(items, '""', '"'), items)
        odd = np.asarray(pc.or_(pc.and_(pa.array(array), pc.match_substring(items, "\\")), pc.match_substring(items, "&")))
        if odd.any():
            values = items.to_pylist()
            for k in np.flatnonzero(odd).tolist():
                values[k] = _unescape(values[k], bool(array[k]))
            items = pa.array(values, items.type)
        trimmed = pc.utf8_trim_whitespace(items)
        full = np.asarray(pc.greater(pc.binary_length(trimmed), 0))
        items, row = trimmed.filter(pa.array(full)), row[full]
    else:
        items = pa.array([], pa.string())
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows_n))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items.cast(pa.string()))


def _lone_quotes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, quoted: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Items whose inner bytes hold a double quote that is not doubled."""
    double = (raw == ord('"')).astype(np.int64)
    count = np.concatenate([[0], np.cumsum(double)])
    pair = np.concatenate([(double[:-1] & double[1:]), [0]]) if len(double) else double
    lone = np.zeros(len(start), bool)
    inner = np.flatnonzero(quoted & ~array)
    some = inner[count[np.maximum(end[inner] - 1, start[inner] + 1)] - count[start[inner] + 1] > 0]
    del pair
    for k in some.tolist():  # only items that hold quotes between their quotes
        text = raw[start[k] + 1 : end[k] - 1].tobytes()
        lone[k] = b'"' in text.replace(b'""', b"")
    return lone


def unpack(df: DataFrame, keys: list[str], fields: dict[str, str], field: str = "field", pos: str = "pos", item: str = "item", least: int = 1) -> DataFrame:
    """One row per value of the packed ``fields`` (name -> kind) of ``df``.

    Columns: the ``keys``, the name of the field, the place and the value.
    Only fields with at least ``least`` values are returned. A narrow map:
    no shuffle, whatever the skew of the keys.
    """
    names = list(fields)
    source = df.select(*[F.col(k) for k in keys], *[F.col(f).cast("string").alias(f"__field_{n}") for n, f in enumerate(names)])
    schema = T.StructType([source.schema[n] for n in range(len(keys))] + [T.StructField(field, T.StringType()), T.StructField(pos, T.IntegerType()), T.StructField(item, T.StringType())])
    kinds = [fields[f] for f in names]
    k_n = len(keys)
    out_names = [*keys, field, pos, item]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, kind in enumerate(kinds):
                lists = split_column(batch.column(k_n + n), kind)
                sizes = np.diff(np.asarray(lists.offsets))
                if least > 1:
                    lists = lists.filter(pa.array(sizes >= least))
                ordinal = np.flatnonzero(sizes >= least)
                sizes = sizes[ordinal]
                if not len(ordinal):
                    continue
                parent = pa.array(np.repeat(ordinal, sizes))
                firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                places = np.arange(sizes.sum()) - np.repeat(firsts, sizes) + 1
                columns = [batch.column(k).take(parent) for k in range(k_n)]
                columns += [pa.array([names[n]]).take(pa.array(np.zeros(len(places), np.int64))), pa.array(places.astype(np.int32)), lists.flatten()]
                yield pa.RecordBatch.from_arrays(columns, out_names)

    return source.mapInArrow(scan, schema)
