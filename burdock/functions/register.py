"""SQL functions over sequences, labels and classes: Catalyst inlines their bodies, so queries stay in the JVM."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..schema import CODONS, GROUPS, RESIDUES

_GROUP_DIGITS = "".join(str(i) * len(g) for i, g in enumerate(GROUPS))
_CODON_MAP = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in CODONS.items()) + ")"
#: Name, parameters, result and body.
FUNCTIONS = {
    "clean_seq": ("s STRING", "STRING", f"regexp_replace(upper(s), '[^{RESIDUES}]', '')"),
    "dashed_seq": ("s STRING", "STRING", f"regexp_replace(upper(s), '[^{RESIDUES}-]', '-')"),
    "residue_groups": ("s STRING", "STRING", f"translate(s, '{''.join(GROUPS)}', '{_GROUP_DIGITS}')"),
    "sixmer_code": ("six STRING", "INT", "cast(conv(six, 6, 10) AS INT)"),
    "sixmer_text": ("code INT", "STRING", "lpad(conv(cast(code AS STRING), 10, 6), 6, '0')"),
    "reverse_complement": ("dna STRING", "STRING", "reverse(translate(upper(dna), 'ACGTN', 'TGCAN'))"),
    "translate_dna": ("dna STRING", "STRING", f"substring_index(array_join(transform(regexp_extract_all(upper(dna), '(?s)...', 0), c -> coalesce(try_element_at({_CODON_MAP}, c), 'X')), ''), '*', 1)"),
    "cut_stops": ("s STRING", "STRING", "CASE WHEN length(s) - length(replace(s, '.', '')) <= 1 THEN nullif(substring_index(s, '.', 1), '') END"),
    "strip_version": ("s STRING", "STRING", "substring_index(s, '.', 1)"),
    "probability_label": ("p DOUBLE, threshold DOUBLE", "STRING", "CASE WHEN p > threshold THEN 'AMYLOID' WHEN p IS NOT NULL THEN 'Non-Amyloid' END"),
    "probability_class": ("p DOUBLE, low DOUBLE, high DOUBLE", "STRING", "CASE WHEN p >= high THEN 'Amyloidogenic' WHEN p <= low THEN 'Non-Amyloidogenic' WHEN p IS NOT NULL THEN 'Intermediate' END"),
    "signed_log": ("x DOUBLE", "DOUBLE", "signum(x) * log10(abs(x) + 1)"),
}


class TextWindows:
    """pos (from 1), part: every stretch of ``width`` characters of a text; none where the text is shorter or null."""

    def eval(self, text: str, width: int):
        for i in range(len(text or "") - width + 1) if width and width > 0 else ():
            yield i + 1, text[i : i + width]


class JsonLeaves:
    """path, value: every leaf of a JSON text as a string, numbers as they are written; an empty object or list has none, a
    text that is no JSON neither. Null leaves have a null value."""

    def eval(self, text: str):
        try:
            held = json.loads(text, parse_float=str, parse_int=str) if text is not None else {}
        except ValueError:
            return
        ahead = [("$", held)]
        while ahead:
            path, value = ahead.pop()
            if isinstance(value, dict):
                ahead += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                ahead += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
            else:
                yield path, None if value is None else str(value).lower() if isinstance(value, bool) else value


class MotifHits:
    """motif, start (from 1), part: leftmost matches that do not overlap of each of the comma-joined motifs, regular
    expressions over residues, in a sequence without regard to case."""

    def eval(self, text: str, motifs: str):
        for motif in (motifs or "").split(","):
            for m in re.finditer(motif, text or "", re.IGNORECASE) if motif else ():
                yield motif, m.start() + 1, m[0]


#: Table functions: class and columns.
TABLE_FUNCTIONS = {
    "text_windows": (TextWindows, "pos int, part string"),
    "json_leaves": (JsonLeaves, "path string, value string"),
    "motif_hits": (MotifHits, "motif string, start int, part string"),
}


def register(spark: SparkSession) -> list[str]:
    """Install all functions for the session; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (cls, columns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=columns))
    return [*FUNCTIONS, *TABLE_FUNCTIONS]
