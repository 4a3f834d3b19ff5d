"""Fill-in-the-middle examples by repeated-capture matching.

A text is a row of units: white space with the word after it, or white space
that nothing follows. One possessive match of ``(unit)*+`` over the whole text
keeps every repetition of its group, so ``ends(1)`` is the list of all unit ends:
its length is n, and the two cuts are entries of it. Nothing is iterated, and
nothing is backtracked over, so a text costs its own length.

Rows, as defined here: a null text is an empty one, and an empty text is plain.
A null id is hashed as if it were the empty string. Repeated rows give repeated
results, as everything depends on id and text alone. A very long text is one
match; its unit ends take about 40 bytes each while it is worked on. An empty
table gives an empty one. An own column of the name ``out`` is replaced; all
others are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, schema_with, with_columns

# White space, and the marks of prefix, suffix and middle.
SPACE = r"\x20\x09-\x0D"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = regex.compile(rf"([{SPACE}]*[^{SPACE}]+|[{SPACE}]+)*+")
MADE = "struct<text:string,form:string,n_units:bigint,prefix_chars:bigint,middle_chars:bigint>"


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id, text: str, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> dict:
    """The example made of one text: ``text``, ``form`` (plain, spm or psm), units, and the code points of prefix and middle."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    a, b, chosen, order = draws(doc_id, seed)
    if not text or chosen % 100 >= fim_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return {"text": text, "form": "plain", "n_units": n, "prefix_chars": None, "middle_chars": None}
    first, second = sorted((a % (n + 1), b % (n + 1)))
    first, second = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    spm = order % 100 < spm_percent
    made = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return {"text": made, "form": "spm" if spm else "psm", "n_units": n, "prefix_chars": len(prefix), "middle_chars": len(middle)}


def fill_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "fim", *, seed: int = 42,
                fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Add ``out``, a struct (text, form, n_units, prefix_chars, middle_chars); the last two are null where the form is plain."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower() and c not in (doc_id, text)])
    kind = pa.struct([("text", pa.string()), ("form", pa.string()), ("n_units", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            ids, texts = piece.column(doc_id).to_pylist(), piece.column(text).to_pylist()
            made = [transform(i, t or "", seed, fim_percent, spm_percent) for i, t in zip(ids, texts)]
            yield with_columns(piece, {out: pa.array(made, kind)})
    return docs.mapInArrow(run, schema_with(docs, f"`{out}` {MADE}"))


def restore(output: Column, form: Column) -> Column:
    """The text an example was made of. A text with a mark stays plain, so each mark occurs once in the other forms."""
    def between(mark: str, end: str | None) -> Column:
        rest = F.split_part(output, F.lit(mark), F.lit(2))
        return F.split_part(rest, F.lit(end), F.lit(1)) if end else rest
    return (F.when(form == "spm", F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX)))
            .when(form == "psm", F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE)))
            .otherwise(output))


def digests(out: str = "fim") -> dict[str, Column]:
    made = F.col(out)
    return {"n": made["n_units"], "form": made["form"], "prefix_chars": made["prefix_chars"], "middle_chars": made["middle_chars"],
            "output_sha256": F.sha2(made["text"], 256), "restored_sha256": F.sha2(restore(made["text"], made["form"]), 256)}
