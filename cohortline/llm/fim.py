"""Fill-in-middle: texts cut into prefix, middle and suffix and put together in another order.

Each text is cut at two code points that a hash of its id chooses.  ``psm`` texts become
``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` texts ``<S>``suffix``<P>``prefix``<M>``middle,
``plain`` texts stay as they are.

The texts of a batch are one array of bytes.  A scan over lead bytes finds the cuts, a
difference array holds at each cut by how much the shift of the bytes changes, and its
cumulative sum is every byte's shift: one scatter builds all outputs.  ``restore`` finds
the marks in an output, builds the shifts the same way and gathers the text back; it
needs the output and its form alone.

Null text is empty text; empty texts and texts that hold a mark are plain, so exactly
one of each mark stands in an output that is not.  A null id is hashed as no digits.
Rows are mapped one by one: repeated rows give repeated rows, an empty table an empty
one, and texts of any length stay whole.  Other columns pass through; one that has the
name of an output column is replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortline.llm.common import flat, pieces

MARK = 3  # bytes of <P>, <S> and <M>
ORDER = {"psm": b"PSM", "spm": b"SPM"}  # marks as they stand in the output
FORMS = ["plain", "psm", "spm"]


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and row of every mark that lies within one row."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = data[1:-1]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((letter == ord("P")) | (letter == ord("S")) | (letter == ord("M"))))
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + MARK <= offsets[row + 1]
    return at[inside], row[inside]


def draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers for every id."""
    text = (f"{seed}:{'' if i is None else i}".encode() for i in ids)
    return np.frombuffer(b"".join(hashlib.sha256(t).digest()[:16] for t in text), ">u4").reshape(-1, 4).astype(np.int64)


def shifts(total: int, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """By how much each of ``total`` bytes moves: segment k of a row starts at ``starts[:, k]`` and moves by ``values[:, k]``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts.ravel(), np.diff(values.ravel(), prepend=0))  # empty segments share a start; their changes add up
    return np.cumsum(change)[:total]


def cut(data: np.ndarray, offsets: np.ndarray, ids: list, seed: int, rate: int, spm: int):
    """Outputs of all rows: bytes, offsets, form codes, units, units of prefix and middle."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, offsets)
    n = np.diff(first)
    h = draws(ids, seed)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    form = np.where(h[:, 2] % 100 >= rate, 0, np.where(h[:, 3] % 100 < spm, 2, 1))
    form[n == 0] = 0
    form[marks(data, offsets)[1]] = 0

    lead = np.append(lead, len(data))
    begin, end = offsets[:-1], offsets[1:]
    middle, suffix = lead[first[:-1] + low], lead[first[:-1] + high]
    plain = form == 0
    size = end - begin + np.where(plain, 0, 3 * MARK)
    out_offsets = np.append(0, np.cumsum(size))
    out = out_offsets[:-1]
    prefix_bytes, suffix_bytes = middle - begin, end - suffix
    spm_row = form == 2
    mark_p = out + np.where(spm_row, MARK + suffix_bytes, 0)
    mark_s = out + np.where(spm_row, 0, MARK + prefix_bytes)
    mark_m = out + 2 * MARK + prefix_bytes + suffix_bytes
    moved = np.stack([mark_p + MARK - begin, mark_m + MARK - middle, mark_s + MARK - suffix], axis=1)
    moved[plain] = (out - begin)[plain, None]
    target = np.empty(out_offsets[-1], np.uint8)
    target[np.arange(len(data)) + shifts(len(data), np.stack([begin, middle, suffix], axis=1), moved)] = data
    for at, letter in ((mark_p, "P"), (mark_s, "S"), (mark_m, "M")):
        for k, byte in enumerate(f"<{letter}>".encode()):
            target[at[~plain] + k] = byte
    return target, out_offsets, form, n, np.where(plain, -1, low), np.where(plain, -1, high - low)


def put_together(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that ``cut`` was given, from its outputs and their forms."""
    cut_rows = np.flatnonzero(form > 0)
    at, row = marks(data, offsets)
    of_cut = form[row] > 0
    at, row = at[of_cut], row[of_cut]
    if not np.array_equal(row, np.repeat(cut_rows, 3)):
        raise ValueError("an output that is not plain holds one of each mark")
    at = at.reshape(-1, 3)
    letters = data[at + 1]
    spm = form[cut_rows] == 2
    want = np.where(spm[:, None], np.frombuffer(ORDER["spm"], np.uint8), np.frombuffer(ORDER["psm"], np.uint8))
    if not np.array_equal(letters, want):
        raise ValueError("the marks of an output stand in the order of its form")
    begin, end = offsets[:-1], offsets[1:]
    size = end - begin - np.where(form > 0, 3 * MARK, 0)
    text_offsets = np.append(0, np.cumsum(size))
    first, second, third = at[:, 0], at[:, 1], at[:, 2]
    prefix, suffix = np.where(spm, second, first) + MARK, np.where(spm, first, second) + MARK
    prefix_bytes = np.where(spm, third, second) - prefix
    middle, middle_bytes = third + MARK, end[cut_rows] - third - MARK
    text = text_offsets[:-1]
    starts, source = np.repeat(text[:, None], 3, axis=1), np.repeat(begin[:, None], 3, axis=1)
    starts[cut_rows, 1] = text[cut_rows] + prefix_bytes
    starts[cut_rows, 2] = text[cut_rows] + prefix_bytes + middle_bytes
    source[cut_rows] = np.stack([prefix, middle, suffix], axis=1)
    total = int(text_offsets[-1])
    return data[np.arange(total) + shifts(total, starts, source - starts)], text_offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def cut_rows(id_col: str, text_col: str, seed: int, rate: int, spm: int, kept: list[str]):
    def run(batches):
        for batch in pieces(batches, text_col):
            data, offsets = flat(batch.column(text_col))
            target, at, form, n, low, middle = cut(data, offsets, batch.column(id_col).to_pylist(), seed, rate, spm)
            unknown = form == 0
            new = [
                pa.array(n.astype(np.int64)),
                pa.DictionaryArray.from_arrays(form.astype(np.int32), FORMS).cast(pa.string()),
                pa.array(low.astype(np.int64), mask=unknown),
                pa.array(middle.astype(np.int64), mask=unknown),
                strings(target, at),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, kept + OUTPUTS)

    return run


def restore_rows(output_col: str, form_col: str, restored_col: str, kept: list[str]):
    def run(batches):
        for batch in pieces(batches, output_col):
            data, offsets = flat(batch.column(output_col))
            form = np.array([FORMS.index(f) for f in batch.column(form_col).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [strings(*put_together(data, offsets, form))], kept + [restored_col])

    return run


OUTPUTS = ["n", "form", "prefix_chars", "middle_chars", "output"]
OUTPUT_TYPES = "n long, form string, prefix_chars long, middle_chars long, output string"


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns of these names, upper or lower case alike."""
    taken = {c.lower() for c in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def schema_of(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Every row with its form, its cuts and its output; ``rate`` percent are cut, ``spm`` percent of these suffix first."""
    rows = without(docs, [c for c in OUTPUTS if c not in (id_col, text_col)])
    return rows.mapInArrow(cut_rows(id_col, text_col, seed, rate, spm, rows.columns), schema_of(rows, OUTPUT_TYPES))


def restore(cut_docs: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """Every row with the text from which its output was made (empty for null); a damaged output raises."""
    rows = without(cut_docs, [restored_col])
    return rows.mapInArrow(restore_rows(output_col, form_col, restored_col, rows.columns), schema_of(rows, f"`{restored_col}` string"))
