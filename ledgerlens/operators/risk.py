"""Risk scores of chunks from measured findings only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.tables import holes as grid_holes

#: Weight of each factor, and the count at which it has full weight.
WEIGHTS = {
    "number_drift": 1.0, "number_mismatch": 0.55, "number_added": 0.25, "number_structural": 0.30, "merge_conflict": 0.40, "grid_hole": 0.45, "table_warning": 0.20,
    "untranslated_labels": 0.30, "chart_unresolved": 0.55, "numeric_density": 0.35, "unknown_terms": 0.30, "terminology_remaining": 0.40, "error": 1.0,
}
SATURATION = {"number_mismatch": 2.0, "number_added": 2.0, "number_structural": 3.0, "merge_conflict": 2.0, "grid_hole": 4.0, "table_warning": 5.0, "untranslated_labels": 5.0, "unknown_terms": 15.0, "terminology_remaining": 3.0}
THRESHOLD, FINANCIAL_RELIEF, LEAST_THRESHOLD, WATCH = 0.45, 0.15, 0.10, 0.6
#: Numeric density counts from the first value on, and in full after the second more.
DENSITY_FROM, DENSITY_RANGE = 0.12, 0.25


#: What is said of a factor; %s stands for its measure.
DETAIL = {
    "number_drift": "%s of source figures did not match the target", "number_mismatch": "%s figure(s) changed value (digit slip or restatement)", "number_added": "%s figure(s) appear in the target only (fabrication, or a reformatted date / cross-reference)",
    "number_structural": "%s structural number issue(s), e.g. a dropped unit note", "merge_conflict": "%s merge conflict(s): two cells claimed the same slot", "grid_hole": "%s uncovered grid slot(s): a cell may be missing", "table_warning": "%s parser warning(s) on tables",
    "untranslated_labels": "%s table label cell(s) left untranslated", "chart_unresolved": "%s of the charts yielded no data points", "numeric_density": "numeric density %s (dense figure section)", "unknown_terms": "%s term(s) with no approved translation",
    "terminology_remaining": "%s approved term(s) still not applied after repair", "error": "%s",
}
SHARES = ("number_drift", "chart_unresolved", "numeric_density")
CRITICAL, WARN = ("number_mismatch", "number_structural", "merge_conflict", "error"), ("number_added", "grid_hole", "untranslated_labels", "chart_unresolved", "terminology_remaining")
FACTOR = "array<struct<name: string, contribution: double, detail: string, severity: string>>"


def factors(features: list[str], weights: dict[str, float] | None = None, saturation: dict[str, float] | None = None) -> Column:
    """Array of (name, contribution, detail, severity) above zero, for the feature columns given; a weight of zero leaves a factor out."""
    weights, saturation = WEIGHTS | (weights or {}), SATURATION | (saturation or {})
    out = []
    for name in features:
        given = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        v = given
        if name in saturation:
            v = given / saturation[name] if saturation[name] > 0 else given
        elif name == "numeric_density":
            v = F.greatest(F.lit(0.0), (given - DENSITY_FROM) / DENSITY_RANGE)
        told = F.concat((F.round(given * 100, 0 if name != "numeric_density" else 1)).cast("string"), F.lit("%")) if name in SHARES else given.cast("bigint").cast("string")
        detail = F.replace(F.lit(DETAIL.get(name, "%s")), F.lit("%s"), told)
        severity = F.when(given >= 0.1, "critical").otherwise("warn") if name == "number_drift" else F.lit("critical" if name in CRITICAL else "warn" if name in WARN else "info")
        out.append(F.struct(F.lit(name).alias("name"), (F.least(F.lit(1.0), v) * weights.get(name, 0.0)).alias("contribution"), detail.alias("detail"), severity.alias("severity")))
    return F.filter(F.array(*out).cast(FACTOR), lambda f: f["contribution"] > 0)


def score(
    df: DataFrame, features: list[str], financial: Column | None = None, hard: Column | None = None, weights: dict[str, float] | None = None, saturation: dict[str, float] | None = None, threshold: float = THRESHOLD, errors: Column | None = None
) -> DataFrame:
    """Adds reasons (largest first), risk (0 to 1), threshold, band (blocked, review, watch, auto), needs_review.

    `errors` (array of strings) are reasons of full weight each, and like `hard` make the risk 1 and the band blocked. The financial relief lowers the threshold, to LEAST_THRESHOLD at least.
    """
    financial = F.lit(False) if financial is None else financial
    hard = F.lit(False) if hard is None else hard
    order = lambda a, b: F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    found = factors(features, weights, saturation)
    if errors is not None:
        hard = hard | (F.size(errors) > 0)
        full_weight = (WEIGHTS | (weights or {}))["error"]
        found = F.concat(found, F.transform(errors, lambda e: F.struct(F.lit("error").alias("name"), F.lit(full_weight).alias("contribution"), e.alias("detail"), F.lit("critical").alias("severity"))))
    out = df.withColumn("reasons", F.array_sort(found, order))
    total = F.aggregate("reasons", F.lit(0.0), lambda s, f: s + f["contribution"])
    # six places: sums of doubles differ beyond by the order of their terms
    out = out.withColumn("risk", F.round(F.when(hard, 1.0).otherwise(F.least(F.lit(1.0), total)), 6))
    out = out.withColumn("threshold", F.when(financial, max(LEAST_THRESHOLD, round(threshold - FINANCIAL_RELIEF, 4))).otherwise(threshold))
    band = F.when(hard, "blocked").when(F.col("risk") >= F.col("threshold"), "review").when(F.col("risk") >= WATCH * F.col("threshold"), "watch").otherwise("auto")
    return out.withColumn("band", band).withColumn("needs_review", F.col("band").isin("blocked", "review"))


#: Measures of a chunk, by the factor that each feeds.
MEASURES = {
    "number_drift": "number_drift", "number_mismatch": "numbers_mismatched", "number_added": "numbers_added", "number_structural": "number_structural", "merge_conflict": "table_merge_conflicts", "grid_hole": "table_holes", "table_warning": "table_warnings",
    "untranslated_labels": "untranslated_label_cells", "numeric_density": "numeric_density", "unknown_terms": "unknown_terms", "terminology_remaining": "terminology_remaining",
}


def features(results: DataFrame, chunks: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, chunk_id) with the measures of each chunk: of its figures, tables, charts, terms, density and errors.

    results: of agents.translate; chunks, blocks: of chunks.build; tables, cells: of tables.build_tables. One aggregate for each source, joined by chunk.
    """
    key = ["doc_id", "chunk_id"]
    owner = blocks.where("table_id is not null").select(*key, "table_id")
    gaps = grid_holes(cells).groupBy("table_id").agg(F.count(F.lit(1)).alias("holes"))
    per = owner.join(tables.select("table_id", "n_conflicts", F.size("warnings").alias("w")), "table_id").join(gaps, "table_id", "left")
    per = per.groupBy(*key).agg(F.count(F.lit(1)).alias("table_count"), F.sum("n_conflicts").alias("table_merge_conflicts"), F.coalesce(F.sum("holes"), F.lit(0)).alias("table_holes"), F.sum("w").alias("table_warnings"))
    unresolved = F.expr("kind = 'chart' and (coalesce(size(chart.series), 0) <= 0)")
    charts = blocks.groupBy(*key).agg(F.count_if(F.col("kind") == "chart").alias("chart_count"), F.count_if(unresolved).alias("charts_unresolved"))
    r = results.select(
        *key, F.col("drift").alias("number_drift"), F.col("missing").alias("numbers_missing"), F.col("mismatched").alias("numbers_mismatched"), F.col("added").alias("numbers_added"), F.col("structural").alias("number_structural"),
        F.col("labels_missing").alias("untranslated_label_cells"), F.col("terms_after").alias("terminology_remaining"), "errors", "source_total", "target_total", "matched", "target_text", "ok",
    )
    c = chunks.select(*key, "chunk_no", "path", "page_start", "page_end", "is_financial", F.col("density").alias("numeric_density"), F.size("terms").alias("glossary_terms"), F.size("unknown_terms").alias("unknown_terms"), "source_text")
    out = c.join(r, key, "left").join(per, key, "left").join(charts, key, "left")
    counts = [n for n, t in out.dtypes if t in ("bigint", "int", "double") and n not in ("page_start", "page_end")]
    return out.na.fill(0, counts)


def score_chunks(measured: DataFrame, weights: dict[str, float] | None = None, saturation: dict[str, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """measured (of `features`) with reasons, risk, threshold, band and needs_review."""
    named = measured.withColumns({f: F.col(m) for f, m in MEASURES.items() if f != m})
    named = named.withColumn("chart_unresolved", F.col("charts_unresolved") / F.greatest(F.lit(1), F.col("chart_count")))
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    out = score(named, [*MEASURES, "chart_unresolved"], F.col("is_financial"), None, weights, saturation, threshold, errors)
    return out.drop(*[f for f, m in MEASURES.items() if f != m], "chart_unresolved")


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row: n, one column for each band, max_risk, mean_risk."""
    bands = [F.count_if(F.col("band") == b).alias(b) for b in ("blocked", "review", "watch", "auto")]
    return scored.agg(F.count(F.lit(1)).alias("n"), *bands, F.coalesce(F.max("risk"), F.lit(0.0)).alias("max_risk"), F.coalesce(F.avg("risk"), F.lit(0.0)).alias("mean_risk"))


def explain(scored: DataFrame) -> DataFrame:
    """scored with `explanation`: a line with risk, threshold and band, then one for each reason."""
    lines = F.transform("reasons", lambda r: F.concat(F.format_string("\n  +%.2f ", r["contribution"]), r["name"], F.lit(": "), r["detail"]))
    head = F.concat(F.format_string("risk=%.2f threshold=%.2f band=", "risk", "threshold"), "band")
    return scored.withColumn("explanation", F.concat(head, F.when(F.size(lines) > 0, F.array_join(lines, "")).otherwise(" (no findings)")))
