"""Fill-in-middle transformation: a text is cut at two of its units, and the middle goes to the end.

Units are white space with the word behind it, or white space that ends a text. An Arrow-batched pandas UDF finds them
with the regex library, keeps their end offsets in a compact array and slices the text at two of them. Where the cuts
fall and which form a row takes hang on a digest of a seed and the row's id alone, so a row's output is the same in
every run, partition and order.

Forms: ``plain`` (the text), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part behind its
mark. A text that is empty or holds a mark stays plain. So the first mark of each kind in an output is the one put
there, and ``restored`` gives the exact text back.

Null text is the empty text (n 0, plain, empty output); a null id is the empty string in the digest. Very long texts
are cut whole, 8 bytes a unit at most being held beside them. Repeated rows give repeated rows, an empty table an empty
one; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
_MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, key: str) -> list[int]:
    """Four whole numbers of 32 bits from the digest of seed and id."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def units(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("Q", (m.end() for m in UNIT.finditer(text)))


def rearranged(text: str, key: str, seed: int, percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    ends = units(text)
    if not text or any(m in text for m in MARKS):
        return len(ends), "plain", None, None, text
    h1, h2, h3, h4 = draws(seed, key)
    if h3 % 100 >= percent:
        return len(ends), "plain", None, None, text
    first, last = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output of that form was made from."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} starts with {first}")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars (code points; null where plain), output of each row. ``percent`` of
    the rows that can be are rearranged, ``spm_percent`` of these with the suffix first."""
    common.tune(docs.sparkSession)

    @F.pandas_udf(_MADE)
    def made(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [rearranged(t, k, seed, percent, spm_percent) for k, t in zip(keys, texts, strict=True)]
        n, form, a, b, out = zip(*rows, strict=True) if rows else ((),) * 5
        return pd.DataFrame({"n": n, "form": form, "prefix_chars": pd.array(a, "Int64"), "middle_chars": pd.array(b, "Int64"), "output": out})

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), made(text(id_col), text(text_col)).alias("__made")).select(id_col, "__made.*")


def restore(output: str, form: str) -> Column:
    """Column of the texts that outputs were made from."""

    @F.pandas_udf("string")
    def back(out: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([restored(o, k) for o, k in zip(out, kind, strict=True)], dtype=object)

    return back(output, form)


def digests(output: str, form: str) -> Column:
    """Struct column: SHA-256 of each output and of the text that it gives back."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def both(out: pd.Series, kind: pd.Series) -> pd.DataFrame:
        hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return pd.DataFrame({"output_sha256": [hexed(o) for o in out], "restored_sha256": [hexed(restored(o, k)) for o, k in zip(out, kind, strict=True)]}, dtype=object)

    return both(output, form)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(common.table(spark, sf_dir, "documents"))
    return made.withColumn("__d", digests("output", "form")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "__d.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, list_transform(range(1, 32, 8), lambda i: ('0x' || substr(h, i::INT, 8))::BIGINT) AS x FROM d),
c AS (SELECT *, len(w) AS n, least(x[1] % (len(w) + 1), x[2] % (len(w) + 1)) AS i, greatest(x[1] % (len(w) + 1), x[2] % (len(w) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1 : i], '') AS a, array_to_string(w[i + 1 : j], '') AS b, array_to_string(w[j + 1 :], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
