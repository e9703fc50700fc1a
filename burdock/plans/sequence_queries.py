"""Sequence scoring, scans and descriptors over the documents' texts."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import descriptors as d
from ..functions import profiles, register
from ..functions import sequence as fs
from ..operators import resilient, scoring
from ..schema import ALPHA, AROMATIC, BETA, CHARGE, CODONS, COMPOSITION_GROUPS, CTD, GROUPS, HELIX, HYDROPATHY, PK_EMBOSS, PK_LEHNINGER, PSEUDO, PSEUDO_ORDER, RESIDUES, SHEET
from ..sources import shared
from .registry import query
from .standins import SEQ, read, rounded, sequences

_DIGITS = "translate(s, '{}', '{}')".format("".join(GROUPS), "".join(str(i) * len(g) for i, g in enumerate(GROUPS)))
_CODE = " + ".join(f"CAST(substr(m, {k + 1}, 1) AS INT) * {6 ** (5 - k)}" for k in range(6))
_SCORED = f"""g AS MATERIALIZED (SELECT doc_id, {_DIGITS} AS g FROM seq),
best AS (SELECT doc_id, length(g) AS clean_length, CASE WHEN length(g) >= 6 THEN list_max(list_transform(range(1, length(g) - 4), lambda i: substr(g, CAST(i AS INT), 6))) END AS m FROM g),
scored AS MATERIALIZED (SELECT doc_id, clean_length, ({_CODE}) / 46655.0::DOUBLE AS prob, CASE WHEN clean_length = 0 THEN 'empty_after_cleaning' WHEN clean_length < 6 THEN 'shorter_than_6' ELSE 'ok' END AS status FROM best)"""
_S = SEQ.strip() + ",\n" + _SCORED


def _n(letters: str) -> str:
    return f"(length(s) - length(translate(s, '{letters}', '')))"


def _share(letters: str) -> str:
    return f"{_n(letters)}::DOUBLE / nullif(length(s), 0)"


def scored(spark, sf):
    return scoring.predict(spark, sequences(spark, sf), scoring.surrogate_table(), "doc_id", "text")


@query("sixmer_score", _S + "SELECT doc_id, clean_length, round(prob, 8) AS prob, CASE WHEN prob > 0.5 THEN 'AMYLOID' WHEN prob IS NOT NULL THEN 'Non-Amyloid' END AS label, status FROM scored")
def sixmer_score(spark, sf):
    return rounded(scored(spark, sf), 8)


@query("sixmer_score_distinct", _S + "SELECT doc_id, round(prob, 8) AS prob FROM scored")
def sixmer_score_distinct(spark, sf):
    return rounded(scoring.predict_distinct(spark, sequences(spark, sf), scoring.surrogate_table(), "doc_id", "text").select("doc_id", "prob"), 8)


@query("sixmer_topk", _S + "SELECT doc_id, round(prob, 8) AS prob, row_number() OVER (ORDER BY prob DESC, doc_id) AS rank FROM (SELECT * FROM scored WHERE status = 'ok' ORDER BY prob DESC, doc_id DESC LIMIT 20)")
def sixmer_topk(spark, sf):
    return rounded(scoring.top_hits(scored(spark, sf), 20, "doc_id").select("doc_id", "prob", "rank"), 8)


@query("scoring_report", _S + "SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS predicted, count(*) FILTER (status <> 'ok') AS skipped, count(*) FILTER (prob > 0.5) AS positive, round(avg(prob), 6) AS mean_prob, round(max(prob), 6) AS max_prob, (SELECT doc_id FROM scored WHERE status = 'ok' ORDER BY prob DESC, doc_id LIMIT 1) AS max_id FROM scored")
def scoring_report(spark, sf):
    return rounded(scoring.run_report(scored(spark, sf), "doc_id"))


@query("sixmer_codes", SEQ.strip() + f", g AS MATERIALIZED (SELECT doc_id, {_DIGITS} AS g FROM seq) SELECT doc_id, sum(c)::BIGINT AS total, count(*) AS n, max(c) AS top FROM (SELECT doc_id, {_CODE} AS c FROM (SELECT doc_id, unnest(list_transform(range(1, length(g) - 4), lambda i: substr(g, CAST(i AS INT), 6))) AS m FROM g WHERE length(g) >= 6)) GROUP BY doc_id")
def sixmer_codes(spark, sf):
    codes = sequences(spark, sf).select("doc_id", F.explode(fs.sixmer_codes(fs.clean(F.col("text")))).alias("c"))
    return codes.groupBy("doc_id").agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.max("c").alias("top"))


@query("sixmer_round_trip", SEQ.strip() + f", g AS MATERIALIZED (SELECT doc_id, {_DIGITS} AS g FROM seq), w AS (SELECT unnest(list_transform(range(1, length(g) - 4), lambda i: substr(g, CAST(i AS INT), 6))) AS m FROM g WHERE length(g) >= 6) SELECT CAST({_CODE} AS INT) AS code, m AS six, count(*) AS n FROM w GROUP BY m")
def sixmer_round_trip(spark, sf):
    """The six-mers of all texts: code to digits and back to the code."""
    codes = scoring.code_counts(sequences(spark, sf), "text").select(F.col("code").alias("c"), "n")
    six = fs.sixmer_text(F.col("c").cast("long"))
    return codes.select(fs.sixmer_code(six).alias("code"), six.alias("six"), "n")


@query("failing_records", _S + "SELECT doc_id, round(prob, 8) AS prob, CASE WHEN clean_length < 6 THEN 'ValueError: ' || clean_length || ' residues, 6 are needed' END AS error FROM scored")
def failing_records(spark, sf):
    """A step that refuses whole batches with a short text: the short ones alone are set apart."""
    return rounded(resilient.predict_isolated(spark, sequences(spark, sf), scoring.surrogate_table(), "doc_id", "text"), 8)


@query("resumed_chunks", _S + "SELECT doc_id, round(prob, 8) AS prob, 'SKIPPED' AS state FROM scored")
def resumed_chunks(spark, sf):
    """Scores by chunk of ids; a second run finds every chunk complete."""
    out = shared.folder(spark) + "/chunks"
    for _ in range(2):
        states = resilient.score_chunks(spark, sequences(spark, sf), out, scoring.surrogate_table(), 16, "doc_id", "text")
    rows = spark.read.parquet(out).select("doc_id", "prob", F.col("chunk").cast("int").alias("chunk"))
    return rounded(rows.join(F.broadcast(states.select("chunk", "state")), "chunk").drop("chunk"), 8)


@query("scan_rejects", "WITH t AS (SELECT item, regexp_replace(upper(replace(item, 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM (SELECT unnest(string_split(text, ' ')) AS item FROM documents)) SELECT CASE WHEN s = '' THEN 'empty_after_cleaning' WHEN length(s) < 6 THEN 'shorter_than_6' ELSE 'ok' END AS status, count(*) AS n, sum(length(item))::BIGINT AS letters FROM t GROUP BY 1")
def scan_rejects(spark, sf):
    items = sequences(spark, sf).select(F.explode(F.split("text", " ")).alias("item"))
    return items.groupBy(fs.scan_status(fs.clean(F.col("item"))).alias("status")).agg(F.count("*").alias("n"), F.sum(F.length("item")).alias("letters"))


@query("dashed_scan", "SELECT item_id, length(d) AS n, length(d) - length(replace(d, '-', '')) AS dashes FROM (SELECT item_id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY-]', '-', 'g') AS d FROM benchmark) WHERE length(d) >= 30")
def dashed_scan(spark, sf):
    rows = read(spark, sf, "benchmark").withColumn("d", fs.dashed(F.col("text"))).where(F.length("d") >= 30)
    return rows.select("item_id", F.length("d").alias("n"), (F.length("d") - F.length(F.replace("d", F.lit("-")))).alias("dashes"))


_DNA = "translate(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
_CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CODONS.items()) + "}"


@query("translate_dna", f"WITH d AS (SELECT item_id, {_DNA} AS dna FROM benchmark), p AS (SELECT item_id, dna, list_aggregate(list_transform(range(0, length(dna) // 3), lambda i: {_CODONS}[substr(dna, CAST(3 * i + 1 AS INT), 3)]), 'string_agg', '') AS aa FROM d) SELECT item_id, split_part(aa, '*', 1) AS protein, reverse(translate(dna, 'ACGTN', 'TGCAN')) AS back FROM p")
def translate_dna(spark, sf):
    letters = F.regexp_replace(F.upper("text"), "[^A-Z]", "")
    dna = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    return read(spark, sf, "benchmark").withColumn("dna", dna).select("item_id", fs.translate_dna(F.col("dna")).alias("protein"), fs.reverse_complement(F.col("dna")).alias("back"))


@query("stop_cleaning", "SELECT doc_id, pos, CASE WHEN length(l) - length(replace(l, '.', '')) <= 1 AND split_part(l, '.', 1) <> '' THEN split_part(l, '.', 1) END AS kept FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS l, unnest(range(0, len(string_split(text, ' ')))) AS pos FROM documents)")
def stop_cleaning(spark, sf):
    """Every word of a text."""
    rows = sequences(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "l"))
    return rows.select("doc_id", "pos", fs.cut_stops(F.col("l")).alias("kept"))


@query("odd_letters", "SELECT item_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '[^ACDEFGHIKLMNPQRSTVWY]'))), 'string_agg', '') AS odd FROM (SELECT item_id, regexp_replace(upper(text), '[^A-Z ]', '', 'g') AS text FROM benchmark)")
def odd_letters(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(fs.odd_residues(F.regexp_replace(F.upper("text"), "[^A-Z ]", "")), "").alias("odd"))


_KD = "(" + " + ".join(f"({v}) * {_n(k)}" for k, v in sorted(HYDROPATHY.items())) + ")::DOUBLE / nullif(length(s), 0)"
_KD2 = "(" + " + ".join(f"({v * v}) * {_n(k)}" for k, v in sorted(HYDROPATHY.items())) + ")::DOUBLE / nullif(length(s), 0)"
_NET = "(" + " + ".join(f"({v}) * {_n(k)}" for k, v in sorted(CHARGE.items())) + ")::DOUBLE"
_TOP = "greatest(" + ", ".join(f"CASE WHEN {_n(k)} > 0 THEN {v} END" for k, v in HYDROPATHY.items()) + ")::DOUBLE"


@query("light_features", SEQ + f"SELECT doc_id, length(s) AS protein_length, round({_KD}, 6) AS KD_mean, round({_TOP}, 6) AS KD_max, round(sqrt(greatest({_KD2} - ({_KD}) * ({_KD}), 0)), 6) AS KD_sd, round({_NET}, 6) AS charge, round({_NET} / nullif(length(s), 0), 6) AS charge_density, round({_share(AROMATIC)}, 6) AS aromaticity, round({_share(ALPHA)}, 6) AS alpha_propensity, round({_share(BETA)}, 6) AS beta_propensity, round(abs({_KD}) + sqrt(greatest({_KD2} - ({_KD}) * ({_KD}), 0)), 6) AS chameleon_score FROM seq")
def light_features(spark, sf):
    return rounded(profiles.light_features(sequences(spark, sf), "text").drop("text"))


@query("aac", SEQ + "SELECT doc_id, " + ", ".join(f"round({_share(r)}, 8) AS f_{r}" for r in RESIDUES) + " FROM seq")
def aac(spark, sf):
    return _wide(spark, sf, "AAC", [f"f_{r}" for r in RESIDUES])


def _wide(spark, sf, block: str, names: list[str]):
    """A block's columns over the texts as they are (the pass cleans them itself)."""
    s = profiles.blocks(sequences(spark, sf), "text", [block])
    return s.select("doc_id", *(F.round(F.nanvl(F.col(block)[i], F.lit(None)), 8).alias(n) for i, n in enumerate(names)))


@query("gaac", SEQ + "SELECT doc_id, " + ", ".join(f"round({_share(g)}, 8) AS {k}" for k, g in COMPOSITION_GROUPS.items()) + " FROM seq")
def gaac(spark, sf):
    return _wide(spark, sf, "GAAC", list(COMPOSITION_GROUPS))


@query("ctdc", SEQ + "SELECT doc_id, " + ", ".join(f"round({_share(a)}, 8) AS {p}_1, round({_share(b)}, 8) AS {p}_2, round(1 - {_share(a)} - {_share(b)}, 8) AS {p}_3" for p, (a, b, _) in CTD.items()) + " FROM seq")
def ctdc(spark, sf):
    return _wide(spark, sf, "CTDC", profiles.names("CTDC"))


def _pairs(expr: str) -> str:
    return f"unnest(list_transform(range(1, length(s)), lambda i: substr({expr}, CAST(i AS INT), 2)))"


@query("ctdt", SEQ.strip() + ",\n" + ",\n".join(f"{p} AS (SELECT doc_id, " + ", ".join(f"round(count(*) FILTER (w IN ('{x}{y}', '{y}{x}'))::DOUBLE / count(*), 8) AS {p}_{x}{y}" for x, y in (("1", "2"), ("1", "3"), ("2", "3"))) + " FROM (SELECT doc_id, " + _pairs("s") + " AS w FROM (SELECT doc_id, " + "translate(s, '{}', '{}')".format("".join(parts), "".join(str(i + 1) * len(g) for i, g in enumerate(parts))) + " AS s FROM seq) WHERE length(s) > 1) GROUP BY doc_id)" for p, parts in CTD.items()) + " SELECT * FROM " + " JOIN ".join(f"{p} USING (doc_id)" if i else p for i, p in enumerate(CTD)))
def ctdt(spark, sf):
    s = profiles.blocks(sequences(spark, sf).select("doc_id", fs.clean(F.col("text")).alias("s")).where(F.length("s") > 1), "s", ["CTDT"]).drop("s")
    return rounded(s.select("doc_id", *(F.col("CTDT")[i].alias(k) for i, k in enumerate(profiles.names("CTDT")))), 8)


@query("dpc", SEQ + f"SELECT doc_id, w AS pair, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY doc_id), 8) AS share FROM (SELECT doc_id, {_pairs('s')} AS w FROM seq WHERE length(s) > 1) GROUP BY 1, 2")
def dpc(spark, sf):
    """Counted by pair and text; the map-valued form serves row-wise use."""
    from pyspark.sql import Window

    pairs = sequences(spark, sf).select("doc_id", F.explode(fs.windows(fs.clean(F.col("text")), 2)).alias("pair")).groupBy("doc_id", "pair").agg(F.count("*").alias("n"))
    return rounded(pairs.select("doc_id", "pair", (F.col("n") / F.sum("n").over(Window.partitionBy("doc_id"))).alias("share")), 8)


_TM = "MAP {" + ", ".join(f"'{r}': {sum(v == r for v in CODONS.values()) / 61!r}::DOUBLE" for r in RESIDUES) + "}"


@query("dde", SEQ + f", n AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {_pairs('s')} AS w FROM seq WHERE length(s) > 1) GROUP BY 1, 2), g AS (SELECT doc_id, length(s) - 1 AS m, a || b AS pair, {_TM}[a] * {_TM}[b] AS tm FROM seq, (SELECT unnest(string_split('{' '.join(RESIDUES)}', ' ')) AS a), (SELECT unnest(string_split('{' '.join(RESIDUES)}', ' ')) AS b) WHERE length(s) > 1) SELECT g.doc_id, pair, round(CASE WHEN tm * (1 - tm) / m > 1e-9 THEN (coalesce(n, 0)::DOUBLE / m - tm) / sqrt(tm * (1 - tm) / m) ELSE 0 END, 6) AS dde FROM g LEFT JOIN n ON n.doc_id = g.doc_id AND n.w = g.pair".replace("\n, n AS", ", n AS"))
def dde(spark, sf):
    """All 400 pairs, long form."""
    s = sequences(spark, sf).select("doc_id", fs.clean(F.col("text")).alias("s")).where(F.length("s") > 1)
    rows = profiles.blocks(s, "s", ["DDE"]).select("doc_id", F.explode(F.arrays_zip(F.array(*(F.lit(n.removeprefix("DDE_")) for n in profiles.names("DDE"))).alias("pair"), F.col("DDE").alias("dde"))).alias("z"))
    return rounded(rows.select("doc_id", "z.pair", "z.dde"))


_KDMAP = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in HYDROPATHY.items()) + "}"


@query("sliding_window_mean", f"WITH seq AS (SELECT item_id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM benchmark), r AS (SELECT item_id, i, {_KDMAP}[substr(s, CAST(i AS INT), 1)] AS v FROM (SELECT item_id, s, unnest(range(1, length(s) + 1)) AS i FROM seq)), w AS (SELECT item_id, avg(v) OVER f AS m, count(*) OVER f AS n FROM r WINDOW f AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT item_id, count(*) AS n_windows, round(max(m), 6) AS top, round(avg(m), 6) AS mean FROM w WHERE n = 7 GROUP BY item_id")
def sliding_window_mean(spark, sf):
    rows = read(spark, sf, "benchmark").select("item_id", F.explode(d.sliding_means(d.scale_values(fs.clean(F.col("text")), HYDROPATHY))).alias("m"))
    return rounded(rows.groupBy("item_id").agg(F.count("*").alias("n_windows"), F.max("m").alias("top"), F.avg("m").alias("mean")))


@query("json_extract_props", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_extract_props(spark, sf):
    return read(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("table_functions", "WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events), w AS (SELECT p_name, unnest(range(1, length(p_name) - 3)) AS i FROM part), m AS (SELECT unnest(regexp_extract_all(p_name, '[aeiou]{2}')) AS part FROM part) SELECT 'leaf' AS kind, '$.' || k || '=' || json_extract_string(props, '$.' || k) AS what, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'window', substr(p_name, i::INT, 5), count(*) FROM w GROUP BY 2 UNION ALL SELECT 'motif', part, count(*) FROM m GROUP BY 2")
def table_functions(spark, sf):
    """Leaves of JSON, windows and motifs of names, by table functions called from SQL."""
    register.register(spark)
    rows = {"e": read(spark, sf, "events"), "p": read(spark, sf, "part")}
    return spark.sql(
        "SELECT 'leaf' AS kind, concat(l.path, '=', l.value) AS what, count(*) AS n FROM {e}, LATERAL json_leaves(props) l GROUP BY 2 "
        "UNION ALL SELECT 'window', w.part, count(*) FROM {p}, LATERAL text_windows(p_name, 5) w GROUP BY 2 "
        "UNION ALL SELECT 'motif', m.part, count(*) FROM {p}, LATERAL motif_hits(p_name, '[aeiou]{{2}}') m GROUP BY 2",
        **rows,
    )


def _standard(name: str) -> str:
    v = PSEUDO[name]
    m = sum(v) / 20
    sd = (sum((x - m) ** 2 for x in v) / 20) ** 0.5
    return "MAP {" + ", ".join(f"'{c}': ({(x - m) / sd!r})::DOUBLE" for c, x in zip(PSEUDO_ORDER, v, strict=True)) + "}"


_RESIDUE_ROWS = SEQ.strip() + ", c AS (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM seq), r AS (SELECT doc_id, i, substr(s, CAST(i AS INT), 1) AS x FROM c), v AS (SELECT doc_id, i, x, {} FROM r)"
_COUNTS = ", ".join(f"count(*) FILTER (x = '{c}') AS n_{c}" for c in PSEUDO_ORDER)
_LAG = "lead({0}, {1}) OVER (PARTITION BY doc_id ORDER BY i)"


def _pseudo_sql(scales: tuple[str, ...], terms: list[str], most: int, names: list[str]) -> str:
    values = ", ".join(f"{_standard(k)}[x] AS v{j}" for j, k in enumerate(scales))
    lagged = ", ".join(f"{_LAG.format(f'v{j}', n)} AS v{j}_{n}" for n in range(1, most + 1) for j in range(len(scales)))
    thetas = ", ".join(f"avg({t}) AS t{k}" for k, t in enumerate(terms))
    total = "(1 + 0.05::DOUBLE * (" + " + ".join(f"t{k}" for k in range(len(terms))) + "))"
    cells = [f"n_{c} / {total}" for c in PSEUDO_ORDER] + [f"0.05::DOUBLE * t{k} / {total}" for k in range(len(terms))]
    return _RESIDUE_ROWS.format(values) + f", l AS (SELECT *, {lagged} FROM v), t AS (SELECT doc_id, {_COUNTS}, {thetas} FROM l GROUP BY doc_id HAVING count(*) > {most}) SELECT doc_id, " + ", ".join(f"round({e}, 6) AS {n}" for e, n in zip(cells, names, strict=True)) + " FROM t"


def _pseudo(spark, sf, block: str, most: int):
    s = sequences(spark, sf).select("doc_id", fs.clean(F.col("text")).alias("s")).where(F.length("s") > most)
    return rounded(profiles.blocks(s, "s", [block]).select("doc_id", *(F.col(block)[i].alias(k) for i, k in enumerate(profiles.names(block)))))


@query("paac", _pseudo_sql(tuple(PSEUDO), [f"((v0 - v0_{n}) ** 2 + (v1 - v1_{n}) ** 2 + (v2 - v2_{n}) ** 2) / 3" for n in range(1, 6)], 5, profiles.names("PAAC")))
def paac(spark, sf):
    return _pseudo(spark, sf, "PAAC", 5)


@query("apaac", _pseudo_sql(tuple(PSEUDO)[:2], [f"v{j} * v{j}_{n}" for n in range(1, 11) for j in (0, 1)], 10, profiles.names("APAAC")))
def apaac(spark, sf):
    return _pseudo(spark, sf, "APAAC", 10)


def _ctdd_sql() -> str:
    """Long form: doc_id, property, class, quarter, place."""
    cls = "SELECT doc_id, i, p, CASE " + " ".join(f"WHEN p = '{p}' AND contains('{g}', x) THEN {k + 1}" for p, parts in CTD.items() for k, g in enumerate(parts)) + " END AS k FROM r, (SELECT unnest([" + ", ".join(f"'{p}'" for p in CTD) + "]) AS p)"
    return SEQ.strip() + f", c AS (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM seq), r AS (SELECT doc_id, i, substr(s, CAST(i AS INT), 1) AS x FROM c), k AS ({cls}), o AS (SELECT doc_id, p, k, i, row_number() OVER (PARTITION BY doc_id, p, k ORDER BY i) AS o, count(*) OVER (PARTITION BY doc_id, p, k) AS n FROM k) SELECT doc_id, p AS property, k::INT AS class, q::INT AS q, round(i * 100.0::DOUBLE / length(s), 8) AS place FROM o JOIN seq USING (doc_id), (SELECT unnest([0, 25, 50, 75, 100]) AS q) WHERE o = greatest(1, (n * q) // 100)"


@query("ctdd", _ctdd_sql())
def ctdd(spark, sf):
    """Places of the classes that occur."""
    s = profiles.blocks(sequences(spark, sf).select("doc_id", fs.clean(F.col("text")).alias("s")), "s", ["CTDD"])
    keys = F.array(*(F.struct(F.lit(p).alias("property"), F.lit(k).alias("class"), F.lit(q).alias("q")) for p in CTD for k in (1, 2, 3) for q in (0, 25, 50, 75, 100)))
    rows = s.select("doc_id", F.explode(F.arrays_zip(keys.alias("k"), F.col("CTDD").alias("place"))).alias("z"))
    return rounded(rows.where("z.place > 0").select("doc_id", "z.k.property", "z.k.class", "z.k.q", "z.place"), 8)


def _feature_sql() -> str:
    """The columns of three blocks and the pairs that occur, as (doc_id, place in the vector, value)."""
    third = lambda a, b: f"1 - {_share(a)} - {_share(b)}"
    values = {
        "AAC": [_share(r) for r in RESIDUES], "GAAC": [_share(g) for g in COMPOSITION_GROUPS.values()],
        "CTDC": [x for a, b, _ in CTD.values() for x in (_share(a), _share(b), third(a, b))],
    }
    at = profiles.spans()
    cells = ", ".join(f"{{'place': {at[k][0] + i}, 'value': {x}}}" for k, xs in values.items() for i, x in enumerate(xs))
    pairs = ", ".join(f"'{a}{b}'" for a in RESIDUES for b in RESIDUES)
    return SEQ.strip() + f""", p AS (SELECT doc_id, w, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY doc_id) AS v FROM (SELECT doc_id, {_pairs("s")} AS w FROM seq WHERE length(s) > 1) GROUP BY 1, 2),
a AS (SELECT doc_id, x.place AS place, x.value AS value FROM (SELECT doc_id, unnest([{cells}]) AS x FROM seq WHERE length(s) > 1) UNION ALL SELECT doc_id, {at["DPC"][0]} + list_position([{pairs}], w) - 1, v FROM p)
SELECT doc_id, place::INT AS place, round(value, 8) AS value FROM a WHERE round(value, 8) > 0"""


@query("feature_vector", _feature_sql())
def feature_vector(spark, sf):
    """Composition, grouped composition, classes and pairs by their places in the assembled vector, all values above 0."""
    rows = profiles.assemble(sequences(spark, sf).select("doc_id", fs.clean(F.coalesce("text", F.lit(""))).alias("s")).where("length(s) > 1"), "s")
    at = [profiles.spans()[b] for b in ("AAC", "GAAC", "CTDC", "DPC")]
    held = rows.where(F.size("features") == 1849).select("doc_id", F.posexplode(F.concat(*(F.slice("features", a + 1, b - a) for a, b in at))).alias("i", "value"))
    place = F.element_at(F.array(*(F.lit(i) for a, b in at for i in range(a, b))), F.col("i") + 1)
    return rounded(held.select("doc_id", place.alias("place"), "value"), 8).where("value > 0")


def _charge(ph: str, pk: dict[str, float]) -> str:
    plus = [f"{'1' if k == 'n' else 'n_' + k} / (1 + 10 ** ({ph} - {pk[k]}::DOUBLE))" for k in "nHKR"]
    return "(" + " + ".join(plus) + " - " + " - ".join(f"{'1' if k == 'c' else 'n_' + k} / (1 + 10 ** ({pk[k]}::DOUBLE - {ph}))" for k in "cCDEY") + ")"


def _scale(scale: dict[str, float]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in scale.items()) + "}[x]"


_FULL = (
    "WITH RECURSIVE " + (_RESIDUE_ROWS.removeprefix("WITH ").format(f"{_scale(HYDROPATHY)} AS kd, {_scale(HELIX)} AS h, {_scale(SHEET)} AS b"))
    + ", w AS (SELECT doc_id, " + ", ".join(f"avg({c}) OVER f AS {c}" for c in ("kd", "h", "b")) + ", count(*) OVER f AS n FROM v WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"
    + ", win AS (SELECT doc_id, avg(kd) AS m, max(kd) AS t, stddev_samp(kd) AS sd, avg(h) AS h, avg(b) AS b, avg(1 - abs(h - b) / (h + b)) AS ch FROM w WHERE n = 7 GROUP BY doc_id)"
    + f", cnt AS MATERIALIZED (SELECT doc_id, count(*) AS n, {_COUNTS} FROM r GROUP BY doc_id)"
    + ", pi AS (SELECT doc_id, n_H, n_K, n_R, n_C, n_D, n_E, n_Y, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi, 0 AS k FROM cnt UNION ALL SELECT doc_id, n_H, n_K, n_R, n_C, n_D, n_E, n_Y, CASE WHEN q > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN q > 0 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (SELECT *, " + _charge("(lo + hi) / 2", PK_EMBOSS) + " AS q FROM pi WHERE k < 40))"
    + f" SELECT doc_id, n::DOUBLE AS protein_length, round(m, 6) AS KD_mean, round(t, 6) AS KD_max, round(sd, 6) AS KD_sd, round({_charge('7.0', PK_LEHNINGER)}, 6) AS charge, round({_charge('7.0', PK_LEHNINGER)} / n, 6) AS charge_density, round(100 * (n_A + 2.9::DOUBLE * n_V + 3.9::DOUBLE * (n_I + n_L)) / n, 6) AS aromaticity, round(win.h, 6) AS alpha_propensity, round(win.b, 6) AS beta_propensity, round(ch, 6) AS chameleon_score, round(pI.pI, 6) AS pI FROM cnt LEFT JOIN win USING (doc_id) JOIN (SELECT doc_id, (lo + hi) / 2 AS pI FROM pi WHERE k = 40) pI USING (doc_id)"
)


@query("full_features", _FULL)
def full_features(spark, sf):
    s = sequences(spark, sf).select("doc_id", fs.clean(F.col("text")).alias("s")).where(F.length("s") > 0)
    return rounded(profiles.full_features(s, "s").drop("s"))
