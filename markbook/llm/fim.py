"""Fill-in-middle: a text's prefix, middle and suffix, reordered with markers between them.

A text is cut into code points by the tokenizers library's ``Split`` pre-tokenizer, whose isolated regex matches come with
code-point offsets; nothing is trained. Its array of offsets is kept by ranks: runs of RUN code points are matched
first, each isolated, and one by one only in the last run and in those where a cut falls. That gives the offsets
of an array of all code points for a tenth of the time (one by one, a code point costs about 750 ns) and a fraction
of the memory. So n is the length of the array, RUN for each whole run and that of the last run's own, and a cut is
the offset of its rank. Texts go through in blocks of BLOCK code points, whatever their length.

Where a text is cut and how it is written follow from four numbers, the first groups of eight hexadecimal digits of the
SHA-256 of ``<seed>:<doc_id>``: the first two modulo n + 1 are the cuts, the third leaves a text plain, the fourth
chooses between prefix-suffix-middle (psm) and suffix-prefix-middle (spm). A text that holds a marker stays plain, so
``restored`` finds the markers again.

Defined cases: a null or empty text is plain, with n = 0 and an empty output; a null doc_id is hashed as an empty one;
rows of one doc_id and one text get the same output; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.llm.arrowtools import pieces

# The markers.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
RUN, BLOCK = 128, 1 << 16
FORMED, SPM = 90, 20
KIND = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Offsets:
    """The code-point offsets of one text, by rank."""

    def __init__(self, text: str):
        self.text = text
        self.runs: list[tuple[int, int]] = []
        for i in range(0, len(text), BLOCK):
            self.runs += [(i + a, i + b) for _, (a, b) in _split(RUN).pre_tokenize_str(text[i : i + BLOCK])]
        self.n = RUN * (len(self.runs) - 1) + len(self._run(len(self.runs) - 1)) if self.runs else 0

    def _run(self, i: int) -> list[int]:
        a, b = self.runs[i]
        return [a + start for _, (start, _) in _split(1).pre_tokenize_str(self.text[a:b])]

    def __getitem__(self, rank: int) -> int:
        """Where the code point of ``rank`` starts; the end of the text for rank n."""
        if rank == self.n:
            return self.runs[-1][1] if self.runs else 0
        return self._run(rank // RUN)[rank % RUN]


_SPLITS: dict[int, object] = {}


def _split(most: int):
    """The pre-tokenizer that isolates runs of up to ``most`` code points."""
    if most not in _SPLITS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, pre_tokenizers

        _SPLITS[most] = pre_tokenizers.Split(Regex(r"[\s\S]{1,%d}" % most), "isolated")
    return _SPLITS[most]


def formed(text: str, h1: int, h2: int, spm: bool, plain: bool) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    at = Offsets(text)
    if plain or not text:
        return at.n, "plain", None, None, text
    low, high = sorted((h1 % (at.n + 1), h2 % (at.n + 1)))
    a, b = at[low], at[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return at.n, "spm" if spm else "psm", low, high - low, "".join(parts)


def _worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 5, 1 << 20):
            rows = zip(*(part.column(i).to_pylist() for i in (5, 1, 2, 3, 4)))
            n, form, prefix, middle, output = zip(*(formed(*r) for r in rows))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, formed_pct: int = FORMED, spm_pct: int = SPM, seed: str = "1", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = [F.contains("text", F.lit(m)) for m in MARKERS]
    plain = marked[0] | marked[1] | marked[2] | (h[2] % 100 >= formed_pct)
    rows = rows.select("doc_id", h[0].alias("h1"), h[1].alias("h2"), (h[3] % 100 < spm_pct).alias("spm"), plain.alias("plain"), "text")
    return rows.mapInArrow(_worker, KIND)


def restored(output: Column, form: Column) -> Column:
    """The text that was formed: a marker's first place is the marker's own, as the text holds none."""
    p, s, m = (re.escape(x) for x in MARKERS)
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(formed: DataFrame) -> DataFrame:
    """The table of ``fill_in_middle`` with SHA-256 of output and restored text in place of the output."""
    hashed = [F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)
