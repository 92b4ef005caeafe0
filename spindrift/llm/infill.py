"""Fill-in-middle transformation: each text is cut in three and put out with its middle last.

The work on a text is done on whole big integers, one bit a byte. ``bytes.translate`` turns the
UTF-8 text into a string of 0 and 1 for each class of bytes (starts of code points, white space,
line ends, the characters of the markers) and ``int(.., 2)`` into a mask whose highest bit is the
first byte. Shifted masks and'ed together mark unit boundaries and marker positions; ``bit_count``
of the boundary mask is the number of units n; the byte at which unit k begins is the k-th set bit,
which is found by halving the mask again and again and counting the upper half. All of it is linear
in the text and takes no per-character Python.

Units: ``codepoint``; ``word``, a word with the white space after it; ``line``, a line with its end.
Each document draws four numbers from the sha256 of a salt and its id, so that a rerun, another
partitioning or a lost executor changes nothing. One narrow pass, no shuffle.

Defined results: a null text is empty; an empty text, one that holds a marker, and one by the draw
are ``plain`` and put out unchanged, with null lengths; a null id draws with an empty id; repeated
rows have equal results, each its own row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table, text_or_empty, utf8_column

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
UNITS = ("codepoint", "word", "line")
SALT = "1:"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of output gathered before a batch is passed on.
BATCH_BYTES = 1 << 23


def class_table(members) -> bytes:
    """A translation table: '1' for the bytes of a class, '0' for all others."""
    return bytes(49 if b in members else 48 for b in range(256))


# UTF-8 continuation bytes are 80 to BF: every other byte begins a code point
LEADS = class_table({b for b in range(256) if b & 0xC0 != 0x80})
GAPS = class_table({9, 10, 11, 12, 13, 32})
LINE_ENDS = class_table({10})
OPENS, NAMES, CLOSES = class_table(b"<"), class_table(b"PSM"), class_table(b">")


def mask_of(text: bytes, table: bytes) -> int:
    """The mask of a class: bit len(text) - 1 - i stands for byte i."""
    return int(text.translate(table), 2) if text else 0


def boundaries(text: bytes, unit: str = "codepoint") -> int:
    """The mask of the bytes at which a unit begins."""
    if not text:
        return 0
    first = 1 << len(text) - 1
    if unit == "codepoint":
        return mask_of(text, LEADS)
    if unit == "line":
        return first | mask_of(text, LINE_ENDS) >> 1
    gaps = mask_of(text, GAPS)
    return first | gaps >> 1 & ~gaps


def has_marker(text: bytes) -> bool:
    """Whether '<', one of P, S and M, and '>' follow one another anywhere."""
    opens = mask_of(text, OPENS)
    if not opens:
        return False
    return bool(opens >> 2 & mask_of(text, NAMES) >> 1 & mask_of(text, CLOSES))


def selected(mask: int, width: int, ranks: list[int]) -> list[int]:
    """The places (from 0, the highest of ``width`` bits first) of the set bits of these ranks, which
    ascend from 0; ``width`` for a rank that no bit has. All ranks go down the halves together."""
    if not ranks:
        return []
    if not mask:
        return [width] * len(ranks)
    if width == 1:
        return [0 if r == 0 else 1 for r in ranks]
    low = width // 2
    upper, lower = mask >> low, mask & (1 << low) - 1
    here = upper.bit_count()
    left = [r for r in ranks if r < here]
    return selected(upper, width - low, left) + [width - low + x for x in selected(lower, low, [r - here for r in ranks[len(left) :]])]


def draws(doc_id: int | None, salt: str = SALT) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearranged(text: bytes, draw: tuple[int, int, int, int], unit: str = "codepoint", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple:
    """(n, form, prefix units, middle units, output) of one text."""
    mask = boundaries(text, unit)
    n = mask.bit_count()
    h1, h2, h3, h4 = draw
    if not text or h3 % 100 >= plain_from or has_marker(text):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut, end = selected(mask, len(text), [a, b])
    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _rearranging(unit: str, salt: str, plain_from: int, spm_below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]

        def out(rows):
            # the output is UTF-8 already: taken as bytes, then seen as text
            parts = [pa.array(c, type=pa.binary() if i == 5 else k) for i, (c, k) in enumerate(zip(zip(*rows, strict=True), kinds, strict=True))]
            return pa.RecordBatch.from_arrays([*parts[:5], parts[5].cast(pa.string())], names=names)

        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), utf8_column(batch.column(1)), strict=True):
                n, form, prefix, middle, output = rearranged(text, draws(doc, salt), unit, plain_from, spm_below)
                rows.append((doc, n, form, prefix, middle, output))
                size += len(output)
                if size >= BATCH_BYTES:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    return run


def fill_in_middle(docs: DataFrame, unit: str = "codepoint", salt: str = SALT, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, output (the rearranged text).

    ``plain_from``: draws of 0 to 99 from which a text stays plain; ``spm_below``: those below which
    the suffix comes first."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_rearranging(unit, salt, plain_from, spm_below), "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a marker stays plain, and no piece ends or
    begins within a marker, so an output holds three markers and splits into four parts, the first
    of them empty."""
    part = F.split(output, f"{PREFIX.decode()}|{SUFFIX.decode()}|{MIDDLE.decode()}", -1)
    psm = F.concat(F.element_at(part, 2), F.element_at(part, 4), F.element_at(part, 3))
    spm = F.concat(F.element_at(part, 3), F.element_at(part, 4), F.element_at(part, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: The same cuts by DuckDB's own characters, which are code points.
OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), x AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e
  FROM d
), f AS (
  SELECT *, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM x
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
                      WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1, n - q) || '<M>' || substr(t, p + 1, q - p)
                      ELSE '<S>' || substr(t, q + 1, n - q) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p) END AS output
  FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
