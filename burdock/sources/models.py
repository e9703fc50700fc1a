"""Forest exports and six-mer tables: files of bounded size that are read and written whole."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from ..operators import scoring
from ..schema import SIXMERS

FEATURES = 262


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def feature(name: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(group digits from 0, gaps) of a name such as 3_0, 3.3_1 or 3.6.3_0.0: groups from 1, then the gaps between them."""
    letters, gaps = (tuple(map(int, part.split("."))) for part in name.split("_"))
    return tuple(x - 1 for x in letters), gaps if len(letters) > 1 else ()


def forest(export: dict, features: int = FEATURES) -> tuple[list[str], list[dict]]:
    """Feature names and trees of a forest export; split features are numbered from 0, however the export counts."""
    names, variables = [str(x) for x in export["imp_features"]], [str(x).removeprefix("X") for x in export["independent_variable_names"]]
    if len(names) != features or names != variables:
        raise ValueError(f"expected the same {features} features in both lists")
    if {str(k) for k in export["enc"]} != set("123456"):
        raise ValueError("expected the residue groups 1 to 6")
    trees = export["forest"]
    parts = [trees[k] for k in ("child_node_ids", "split_var_ids", "split_values", "terminal_class_counts")]
    if {len(p) for p in parts} != {int(trees["num_trees"])}:
        raise ValueError("lists of different lengths in the forest")
    inner = [int(v) for (left, right), split in zip(parts[0], parts[1], strict=True) for a, b, v in zip(left, right, split, strict=True) if a or b]
    if not inner:
        raise ValueError("no tree has a split")
    first = 0 if min(inner) == 0 else 1
    if min(inner) < 0 or max(inner) >= features + first:
        raise ValueError(f"split features {min(inner)} to {max(inner)} do not fit {features} features")
    out = []
    for (left, right), split, value, counts in zip(*parts, strict=True):
        left, right = np.asarray(left, int), np.asarray(right, int)
        leaf = (left == 0) & (right == 0)
        out.append({"left": left, "right": right, "feature": np.where(leaf, 0, np.asarray(split, int) - first), "split": np.asarray(value, float), "counts": np.array([c if c else (0, 0) for c in counts], float)})
    return names, out


def tabulate(names: list[str], trees: list[dict]) -> np.ndarray:
    """Probability of every six-mer of residue groups."""
    return scoring.forest_probability(trees, scoring.feature_matrix([feature(n) for n in names], scoring.sixmer_digits()))


def load_forest(spark: SparkSession, path: str, features: int = FEATURES) -> tuple[list[str], list[dict]]:
    return forest(json.loads(read_bytes(spark, path)), features)


def write_table(spark: SparkSession, table: np.ndarray, path: str, magic: bytes | None = None) -> None:
    """JSON list, or with a magic line the binary form: that line, then little-endian doubles. ``readers.lookup_table`` reads both."""
    values = np.asarray(table, "<f8")
    if values.shape != (SIXMERS,):
        raise ValueError(f"{values.shape} instead of {SIXMERS} entries")
    write_bytes(spark, path, json.dumps(values.tolist()).encode() if magic is None else magic.rstrip(b"\n") + b"\n" + values.tobytes())
