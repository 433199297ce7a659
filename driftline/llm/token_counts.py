"""Token counts by offset-mapped attribution.

A whole document is encoded once. The widths of its ids give each token's bytes
and so its span of characters; a merge of these spans with the sections'
spans, both in order, counts the tokens of each section. The rule for a token
that crosses a boundary is a parameter:

``largest``  the section that holds most of its characters, the earlier on a tie;
``first``    the section that holds its first character inside any section;
``last``     the section that holds its last character inside any section.

So every token counts once; one that touches no section counts as outside
(section -1). A token that is a part of a character spans that character.

Defined cases: a null text counts as empty; a document without sections gives
a row for section -1 alone; sections are sorted by their start, those with a null
start or stop left out; rows that repeat a doc_id are all returned. Where sections overlap or
end before they start, ``broken`` decides: ``raise`` ends the job, ``mark`` gives the document one row, section
-2, with all its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, text_batches
from .encoding import encoder

RULES = ("largest", "first", "last")


def allocate(begin: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token span [begin, end), -1 for none; sections [start, stop) in order."""
    if not len(start):
        return np.full(len(begin), -1)
    # the first section that ends after the token begins, and the last one that starts before it ends
    i = np.searchsorted(stop, begin, side="right")
    j = np.searchsorted(start, end, side="left") - 1
    out = np.where(i <= j, i if rule != "last" else j, -1)
    if rule == "largest":
        for t in np.flatnonzero(i < j):
            k = np.arange(i[t], j[t] + 1)
            share = np.minimum(stop[k], end[t]) - np.maximum(start[k], begin[t])
            out[t] = k[share.argmax()]
    return out


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "largest", broken: str = "raise", tokenizer: str | None = None) -> DataFrame:
    """doc_id, section, start, stop, n_tokens and n_doc_tokens, a row for each section of each row.

    ``sections`` names an array column of structs (start, stop) in code points;
    None stands for the lines of the text. A row for section -1 comes only
    where tokens lie outside, or where there is no section.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if broken not in ("raise", "mark"):
        raise ValueError("broken is raise or mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in blocks(batches, "text"):
            rows: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                raw = np.frombuffer(t.encode(), np.uint8)
                ids = np.frombuffer(enc.ids(t), np.uint32)
                to = np.cumsum(enc.width[ids])
                if len(ids) and to[-1] != len(raw):
                    raise ValueError("the tokens do not spell the text")
                # the character of each byte
                char = np.cumsum((raw & 0xC0) != 0x80) - 1
                begin, end = char[np.r_[0, to[:-1]]] if len(ids) else to, char[to - 1] + 1 if len(ids) else to
                if sections is None:
                    line = np.flatnonzero(raw == 10)
                    start = np.r_[0, char[line] + 1].astype(np.int64)
                    stop = np.r_[start[1:], len(t)]
                else:
                    s = b.column(2)[i].values
                    spans = [x for x in zip(*(s.flatten()[k].to_pylist() for k in (0, 1)), strict=True) if None not in x] if s is not None else []
                    start, stop = np.array(sorted(spans), np.int64).reshape(-1, 2).T
                    if (start[1:] < stop[:-1]).any() or (stop < start).any():
                        if broken == "raise":
                            raise ValueError("sections overlap")
                        for x, y in zip(rows, (i, -2, 0, len(t), len(ids), len(ids)), strict=True):
                            x.append(np.array([y]))
                        continue
                at = allocate(begin, end, start, stop, rule)
                n = np.bincount(at + 1, minlength=len(start) + 1)
                skip = int(n[0] == 0 and len(start) > 0)
                k = np.arange(-1 + skip, len(start))
                for x, y in zip(rows, (np.full(len(k), i), k, np.r_[0, start][skip:], np.r_[len(t), stop][skip:], n[skip:], np.full(len(k), len(ids))), strict=True):
                    x.append(y)
            i, k, start, stop, n, total = map(np.concatenate, rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(k.astype(np.int32)), *map(pa.array, (start, stop, n, total))], ["doc_id", "section", "start", "stop", "n_tokens", "n_doc_tokens"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.col(sections).alias("sections")] if sections else []))
    return text_batches(given).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, section int, start long, stop long, n_tokens long, n_doc_tokens long")
