"""Vectorised accounting-log parse for ``mapInArrow``.

Same rules as the expression engine in :mod:`.parse`, computed over a
whole Arrow batch at once with numpy and Arrow compute kernels (no Python
loop over lines):

* split: a space splits when the rest of its line holds an even number of
  quotes - a prefix count of quote bytes over the batch buffer gives that
  for every byte; dropping the splitting spaces leaves the fields contiguous
  in one buffer, so the fields become one Arrow string array;
* fold: one vectorised step per group (10 for a finished-job record);
* fields and arrays: ``take`` at the folded positions.

Spark still owns the work: input splits, scheduling, retries and everything
after the parse. Bytes 0x20 and 0x22 never occur inside a multi-byte UTF-8
sequence, so splitting raw UTF-8 bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.numeric import FLOAT_PATTERN
from ..templates import UNSUPPORTED_TYPES, Template

_INT_RE = r"^\s*[+-]?[0-9]+\s*$"
#: Largest digits of a 64-bit integer without and with a minus.
_INT_MAX, _INT_MIN = str((1 << 63) - 1), str(1 << 63)
#: Bytes of text parsed at once, however many lines a batch has.
_SLICE_BYTES = 1 << 20


def arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
            "array": pa.list_(pa.string())}[kind]


def _to_int(s: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """String array -> (int64 values, valid mask); text that is no integer or
    lies outside 64 bits is invalid."""
    s = pc.utf8_trim_whitespace(pc.fill_null(s, ""))
    negative = pc.starts_with(s, "-")
    digits = pc.utf8_ltrim(pc.utf8_ltrim(s, "+-"), "0")
    size = pc.utf8_length(digits)
    limit = pc.if_else(negative, pa.scalar(_INT_MIN), pa.scalar(_INT_MAX))
    fits = pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(digits, limit)))
    ok = pc.and_(pc.match_substring_regex(s, _INT_RE), fits)
    clean = pc.binary_join_element_wise(pc.if_else(negative, "-", ""), pc.if_else(pc.equal(size, 0), "0", digits), "")
    vals = pc.cast(pc.if_else(ok, clean, pa.scalar("0")), pa.int64())
    return vals.to_numpy(zero_copy_only=False), ok.to_numpy(zero_copy_only=False)


def _to_float(s: pa.Array) -> pa.Array:
    s = pc.fill_null(s, "")
    ok = pc.match_substring_regex(s, FLOAT_PATTERN)
    vals = pc.cast(pc.if_else(ok, pc.utf8_trim_whitespace(s), pa.scalar("0")), pa.float64())
    return pc.if_else(ok, vals, pa.scalar(None, pa.float64()))


def _unquote(t: pa.Array) -> pa.Array:
    return pc.if_else(pc.starts_with(t, '"'), pc.utf8_trim(t, '"'), t)


def _strip_repair(lines: pa.Array) -> pa.Array:
    s = pc.utf8_trim_whitespace(pc.fill_null(lines, ""))
    quoted = pc.or_(pc.starts_with(s, '"'), pc.equal(pc.utf8_length(s), 0))
    return pc.if_else(quoted, s, pc.binary_join_element_wise('"', s, ""))


def split_fields(lines: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Split every line on spaces outside quotes.

    Returns (fields as one string array, per-line field offsets, per-line
    "has an empty field" flags).
    """
    lines = pa.array(lines, pa.string()) if not isinstance(lines, pa.StringArray) else lines
    n = len(lines)
    bufs = lines.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int32)[lines.offset: lines.offset + n + 1].astype(np.int64)
    lo, hi = int(offs[0]), int(offs[-1])
    data = (np.frombuffer(bufs[2], dtype=np.uint8)[lo:hi] if bufs[2] is not None
            else np.zeros(0, np.uint8))
    offs = offs - lo
    quotes = np.flatnonzero(data == 34)
    spaces = np.flatnonzero(data == 32)
    q_at_line = np.searchsorted(quotes, offs)          # quotes before each line start
    total = np.diff(q_at_line)                          # quotes per line
    sp_line = np.searchsorted(offs, spaces, side="right") - 1
    rest = total[sp_line] - (np.searchsorted(quotes, spaces) - q_at_line[sp_line])
    keep = rest % 2 == 0
    pos = spaces[keep]
    split = np.zeros(len(data), bool)
    split[pos] = True
    nsplit = np.bincount(sp_line[keep], minlength=n)
    ntok = nsplit + 1
    starts = np.sort(np.concatenate([offs[:-1], pos + 1]))
    ends = np.sort(np.concatenate([offs[1:], pos]))
    tlen = ends - starts
    tok_data = data[~split]
    tok_offs = np.concatenate([[0], np.cumsum(tlen)]).astype(np.int32)
    fields = pa.StringArray.from_buffers(len(tlen), pa.py_buffer(tok_offs.tobytes()),
                                         pa.py_buffer(tok_data.tobytes()))
    line_offs = np.concatenate([[0], np.cumsum(ntok)]).astype(np.int64)
    tok_line = np.repeat(np.arange(n), ntok)
    empty = np.bincount(tok_line, weights=(tlen == 0), minlength=n) > 0
    return fields, line_offs, empty


def parse_batch(lines: pa.Array, tpl: Template, record_type: str, known: list[str],
                keep_line: bool, wanted: list[str] | None = None) -> pa.RecordBatch:
    """Parse one batch. ``wanted`` limits the output to some fields (the
    required numbers are still read to decide the status)."""
    n = len(lines)
    wanted_set = set(wanted if wanted is not None else tpl.columns)
    raw_fields, loff, empty = split_fields(_strip_repair(lines))
    vals = _unquote(raw_fields)
    start = loff[:-1]
    ntok = np.diff(loff)
    rtype = pc.take(vals, pa.array(start))

    # Fold the variable-length groups, one vectorised step per group.
    spec = tpl.group_spec()
    shift = np.zeros(n, np.int64)
    ok = np.ones(n, bool)
    shifts, cnts = [], []
    for i, w in spec:
        p = i + shift
        inside = (p >= 0) & (p < ntok)
        c, c_ok = _to_int(pc.take(vals, pa.array(start + np.clip(p, 0, np.maximum(ntok - 1, 0)))))
        cnt = np.where(inside & c_ok, np.clip(c, 0, ntok), 0)
        ok &= inside & c_ok & (p + cnt * w < ntok)
        shifts.append(shift)
        cnts.append(cnt)
        shift = shift + (cnt - 1) * w
    width = ntok - shift
    last = np.maximum(ntok - 1, 0)

    out: dict[str, pa.Array] = {}
    arrays = tpl.array_columns()
    int_missing = np.zeros(n, bool)
    for t, name in enumerate(tpl.columns):
        kind = tpl.kind(t)
        if kind == "array" or (kind == "string" and name not in wanted_set):
            continue
        k = sum(1 for i, _ in spec if i < t)
        sh = shift if k == len(spec) else shifts[k]
        p = t + sh
        inside = (p >= 0) & (p < ntok)
        v = pc.take(vals, pa.array(start + np.clip(p, 0, last)))
        absent = ~inside | (pc.equal(v, "").to_numpy(zero_copy_only=False))
        if kind == "bigint":
            iv, iok = _to_int(v)
            good = iok & ~absent
            int_missing |= ~good
            out[name] = pa.array(iv, pa.int64(), mask=~good)
        elif kind == "double":
            f = _to_float(v)
            good = ~absent & f.is_valid().to_numpy(zero_copy_only=False)
            int_missing |= ~good
            out[name] = pa.array(f.to_numpy(zero_copy_only=False), pa.float64(), mask=~good)
        else:
            out[name] = pc.if_else(pa.array(absent), pa.scalar(None, pa.string()), v)

    # Group arrays: cnt x width values after each count field.
    for g, (i, w) in enumerate(spec):
        cnt = np.where(ok, cnts[g], 0)
        total = int(cnt.sum())
        row = np.repeat(np.arange(n), cnt)
        lo = np.concatenate([[0], np.cumsum(cnt)])
        m = np.arange(total) - lo[:-1][row]
        base = start[row] + i + shifts[g][row] + 1 + m * w
        for j in range(w):
            name = tpl.columns[i + 1 + j]
            if name not in wanted_set:
                continue
            items = pc.take(vals, pa.array(base + j)) if total else pa.array([], pa.string())
            out[name] = pa.ListArray.from_arrays(pa.array(lo.astype(np.int32)), items,
                                                 mask=pa.array(cnt == 0))
    assert len(arrays) == sum(w for _, w in spec)

    rt = rtype.to_numpy(zero_copy_only=False)
    unsupported = np.isin(rt, UNSUPPORTED_TYPES)
    unknown = ~np.isin(rt, known)
    other = rt != record_type
    status = np.select(
        [empty, unsupported, unknown, other, ~ok, width != len(tpl.fields), int_missing],
        ["empty_segment", "unsupported_type", "unknown_type", "other_type", "bad_group",
         "bad_width", "bad_type"], "ok")
    cols = {"status": pa.array(status, pa.string())}
    if keep_line:  # an accepted line's fields say it all
        cols["line"] = pc.if_else(pa.array(status == "ok"), pa.scalar(None, pa.string()), lines)
    cols.update({c: out[c] for c in tpl.columns if c in wanted_set})
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def arrow_schema(tpl: Template, keep_line: bool, wanted: list[str] | None = None) -> pa.Schema:
    fields = [pa.field("status", pa.string())]
    if keep_line:
        fields.append(pa.field("line", pa.string()))
    fields += [pa.field(c, arrow_type(tpl.kind(t))) for t, c in enumerate(tpl.columns)
               if wanted is None or c in wanted]
    return pa.schema(fields)


def batch_parser(tpl: Template, record_type: str, known: list[str], keep_line: bool,
                 line_col: str, wanted: list[str] | None = None, carry: Sequence[str] = ()):
    """The ``mapInArrow`` function: Arrow batches of lines -> parsed batches, with the
    columns ``carry`` of each line behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index(line_col))
            if isinstance(col, pa.ChunkedArray):
                col = col.combine_chunks()
            if col.type != pa.string():
                col = col.cast(pa.string())
            sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(col):
                used = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, used + _SLICE_BYTES, "right")))
                rows = pa.array(np.arange(at, end)) if end - at < len(col) else None
                part = col if rows is None else col.take(rows)
                parsed = parse_batch(part, tpl, record_type, known, keep_line, wanted)
                if carry:
                    more = [b.column(b.schema.get_field_index(c)) for c in carry]
                    more = more if rows is None else [m.take(rows) for m in more]
                    parsed = pa.RecordBatch.from_arrays([*parsed.columns, *more], [*parsed.schema.names, *carry])
                yield parsed
                at = end
            pa.default_memory_pool().release_unused()  # else the worker, which lives on, keeps it
    return run
