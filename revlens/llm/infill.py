"""Fill-in-the-middle by displacement scatter.

A document is cut at two token borders into prefix, middle and suffix and written as
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm). A batch of
documents is one byte array. Its cuts are found by a scan for token starts; each segment's
way to its new place is entered in a difference array at the segment's first byte, so the
cumulative sum holds every byte's output shift and one numpy scatter moves the whole batch.
:func:`restore` knows only outputs and forms: it scans for the marks, enters the shifts back
and gathers the text.

Each document is worked on alone, so no shuffle is needed and nothing depends on how rows are
dealt. Batches are worked off in slices of about ``SLICE`` bytes (one longer text is a slice
of its own), so the index arrays are bounded by the longest text.

Defined cases: null text counts as empty; empty texts, texts that hold a mark and those the
draw leaves out are ``plain``, i.e. unchanged; a null ``doc_id`` draws as an empty id; rows that
share a ``doc_id`` share their draws (cuts depend on the text's length too); texts are never cut short; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import documents

#: Marks of prefix, suffix and middle.
P, S, M = b"<P>", b"<S>", b"<M>"
SEED = "1:"
PLAIN_FROM, SPM_BELOW = 90, 20
SLICE = 4 << 20

_FORMS = ("plain", "psm", "spm")
#: Order of the segments (0 prefix, 1 middle, 2 suffix) in the output, by form.
_ORDER = {1: (0, 2, 1), 2: (2, 0, 1)}
_MARK = np.array([list(P), list(M), list(S)], dtype=np.uint8)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes each."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        yield i, j
        i = j


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (null: empty) and the offsets of its rows."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _marks(data: np.ndarray) -> np.ndarray:
    """Positions where a mark starts, in order."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    middle = np.isin(data[1:-1], _MARK[:, 1])
    return np.flatnonzero((data[:-2] == _MARK[0, 0]) & middle & (data[2:] == _MARK[0, 2]))


def _inside(marks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marks that end in the row they start in, and their rows."""
    row = np.searchsorted(offsets, marks, side="right") - 1
    whole = marks + 3 <= offsets[row + 1]
    return marks[whole], row[whole]


def _shifts(at: np.ndarray, shift: np.ndarray, length: int) -> np.ndarray:
    """Per byte, the shift of the segment it lies in: a difference array, summed up.

    ``at`` are the segments' first bytes in order; of several at one byte the last counts,
    as the earlier ones are empty.
    """
    steps = np.zeros(length + 1, dtype=np.int64)
    np.add.at(steps, at, np.diff(shift, prepend=0))
    return np.cumsum(steps[:length])


def scatter(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> dict[str, np.ndarray]:
    """The outputs of one slice: bytes, offsets, n, form and the characters of prefix and middle.

    ``draws`` has the four draws of every row. Prefix and middle of plain rows are -1.
    """
    rows, n_bytes = len(offsets) - 1, np.diff(offsets)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    lead = (data & 0xC0) != 0x80  # first byte of a character
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    goes_on = np.zeros(len(data), dtype=bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    starts = np.flatnonzero(lead & ~(goes_on & ~first[:-1]))
    low = np.searchsorted(starts, offsets)
    n = np.diff(low)

    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    held = np.bincount(_inside(_marks(data), offsets)[1], minlength=rows) > 0
    plain = (n_bytes == 0) | held | (draws[:, 2] % 100 >= PLAIN_FROM)
    form = np.where(plain, 0, np.where(draws[:, 3] % 100 < SPM_BELOW, 2, 1))
    border = np.append(starts, len(data))  # a cut behind the last token lies at the row's end
    cuts = [np.where(k == n, offsets[1:], border[np.minimum(low[:-1] + k, len(starts))]) for k in (np.minimum(one, two), np.maximum(one, two))]
    # segments of each row: first byte and length of prefix, middle, suffix
    begin = np.stack([offsets[:-1], *cuts], axis=1)
    size = np.diff(np.column_stack([begin, offsets[1:]]), axis=1)

    out_offsets = np.concatenate([[0], np.cumsum(n_bytes + 9 * (form > 0))])
    to = begin - offsets[:-1, None] + out_offsets[:-1, None]  # plain: as they lie
    out = np.empty(int(out_offsets[-1]), dtype=np.uint8)
    for f, order in _ORDER.items():
        of = np.flatnonzero(form == f)
        at = out_offsets[of]
        for k in order:
            out[at[:, None] + np.arange(3)] = _MARK[k]
            to[of, k] = at + 3
            at = at + 3 + size[of, k]
    shift = _shifts(begin.ravel(), (to - begin).ravel(), len(data))
    out[np.arange(len(data)) + shift] = data

    chars = np.concatenate([[0], np.cumsum(lead)])
    length = chars[begin + size] - chars[begin]
    return {
        "out": out,
        "offsets": out_offsets,
        "n": n,
        "form": form,
        "prefix": np.where(form > 0, length[:, 0], -1),
        "middle": np.where(form > 0, length[:, 1], -1),
    }


def gather(out: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of one slice of outputs (bytes, offsets), from the marks in them and the forms alone."""
    marks, row = _inside(_marks(out), offsets)
    marks = marks[form[row] > 0]
    row = np.flatnonzero(form > 0)
    if len(marks) != 3 * len(row):
        raise ValueError("an output of form psm or spm must hold three marks")
    marks = marks.reshape(-1, 3)
    text_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) - 9 * (form > 0))])
    # plain rows are one segment (the other two empty); others lie behind their marks in the form's order
    begin = np.repeat(text_offsets[:-1, None], 3, axis=1)
    begin[:, 1:] = text_offsets[1:, None]
    source = np.repeat(offsets[:-1, None], 3, axis=1)
    ends = np.column_stack([marks[:, 1:], offsets[row + 1]])
    for f, order in _ORDER.items():
        of = form[row] == f
        size = np.zeros((int(of.sum()), 3), dtype=np.int64)
        for place, k in enumerate(order):
            source[row[of], k] = marks[of, place] + 3
            size[:, k] = ends[of, place] - marks[of, place] - 3
        begin[row[of], 1:] = text_offsets[row[of], None] + np.cumsum(size[:, :2], axis=1)
    shift = _shifts(begin.ravel(), (source - begin).ravel(), int(text_offsets[-1]))
    return out[np.arange(int(text_offsets[-1])) + shift], text_offsets


def transform(docs: DataFrame, seed: str = SEED, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch.column(1))
            drawn = np.column_stack([batch.column(2 + k).to_numpy() for k in range(4)])
            for i, j in _slices(offsets):
                made = scatter(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], drawn[i:j])
                whole = made["form"] == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(made["n"]),
                        pa.array(np.array(_FORMS, dtype=object)[made["form"]], pa.string()),
                        pa.array(made["prefix"], mask=whole),
                        pa.array(made["middle"], mask=whole),
                        _strings(made["out"], made["offsets"]),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text"), *draws).mapInArrow(cut, schema)


def restore(formatted: DataFrame) -> DataFrame:
    """The rows of ``formatted`` (needs form and output) with ``text``: the document each was made from."""
    names = formatted.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formatted.schema.fields)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, offsets = _bytes_of(batch.column(names.index("output")))
            forms = batch.column(names.index("form")).to_pylist()
            form = np.array([_FORMS.index(f) for f in forms], dtype=np.int64)
            for i, j in _slices(offsets):
                text, at = gather(out[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], form[i:j])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(text, at)], [*names, "text"])

    return formatted.mapInArrow(back, f"{schema}, text string")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(transform(documents(spark, sf_dir)))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest("output").alias("output_sha256"), digest("text").alias("restored_sha256"),
    )


#: The same rows by DuckDB: token lists, sliced and joined; the restored text is cut out of the output.
SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
  FROM documents
), draws AS (
  SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
         CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4
  FROM drawn
), parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(tokens[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(tokens[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(tokens[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 :], '') AS suffix
  FROM draws
), outputs AS (
  SELECT *, CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM parts
), places AS (
  SELECT *, strpos(output, '<P>') AS p, strpos(output, '<S>') AS s, strpos(output, '<M>') AS m FROM outputs
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                        WHEN 'psm' THEN substr(output, 4, s - 4) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
                        ELSE substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, 4, p - 4) END) AS restored_sha256
FROM places
"""
