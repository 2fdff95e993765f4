"""Configurations as tables: requirements of a document and options of the application, in JSON whose scalars are strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys of a requirements file, and what its choices may be.
REQUIREMENTS = "interlinia string, minimalna_liczba_stron string, maksymalna_liczba_stron string, rozmiar_czcionki string, margines string, format string, orientacja string, justowanie string, czcionka map<string,string>"
MARGINS, FORMATS, ORIENTATIONS, YES_NO = ("lustrzany", "standardowy"), ("a3", "a4", "a5"), ("pionowa", "pozioma"), ("tak", "nie")
# Options of the application with their defaults; those without one must be given.
OPTIONS = (("device", None), ("n_gpu_layers", None), ("model_dir", None), ("language", "pl"), ("thesis_path", None), ("output_dir", "output"), ("embedding_model", "paraphrase-multilingual-MiniLM-L12-v2"))
NEEDED = ("device", "n_gpu_layers", "model_dir")
# Switches of the language rules, which are on unless they are switched off.
TOGGLES = ("sprawdzanie_formy_osobowej", "sprawdzanie_wg_bibtex")


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """Requirements files below a path, one JSON object a file, with their error."""
    return requirements(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def requirements(rows: DataFrame, json: str = "json") -> DataFrame:
    """rows with the requirements of their JSON, and error: the first thing that is wrong with them, or null."""
    r = rows.withColumn("__c", F.from_json(json, REQUIREMENTS))
    get = lambda n: F.col(f"__c.{n}")
    spacing, least, most, size = get("interlinia").try_cast("double"), get("minimalna_liczba_stron").try_cast("int"), get("maksymalna_liczba_stron").try_cast("int"), get("rozmiar_czcionki").try_cast("int")
    one_of = lambda n, values: F.lower(get(n)).isin(*values)
    missing = F.array_compact(F.array(*(F.when(get(n).isNull(), n) for n in REQUIREMENTS.replace(" string", "").split(", ")[:8])))
    wrong = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.element_at(missing, 1)))
    wrong = wrong.when(spacing.isNull() | least.isNull() | most.isNull() | size.isNull(), "not a number").when(least > most, "min > max").when(~one_of("margines", MARGINS), "margin")
    wrong = wrong.when(~one_of("format", FORMATS), "format").when(~one_of("orientacja", ORIENTATIONS), "orientation").when(~one_of("justowanie", YES_NO), "justification")
    fonts = F.coalesce(F.array_sort(F.map_values(get("czcionka"))), F.array().cast("array<string>"))
    named = {"line_spacing": spacing, "min_pages": least, "max_pages": most, "font_size": size, "margin_type": F.lower(get("margines")), "format": F.lower(get("format")), "orientation": F.lower(get("orientacja")), "justified": F.lower(get("justowanie")) == "tak", "fonts": fonts, "error": F.when(get("interlinia").isNull() & F.from_json(json, "map<string,string>").isNull(), "not JSON").otherwise(wrong)}
    return r.select(*(F.col(c) for c in rows.columns if c not in named), *(v.alias(k) for k, v in named.items()))


def options(rows: DataFrame, json: str = "json") -> DataFrame:
    """rows with the application's options of their JSON, defaults filled in, and error: the first needed option that is missing."""
    m = F.from_json(json, "map<string,string>")
    value = lambda n, default: F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(default).cast("string"))
    clean: dict[str, Column] = {n: value(n, d) for n, d in OPTIONS}
    clean |= {n: F.lower(F.trim(clean[n])) for n in ("device", "language")} | {"n_gpu_layers": clean["n_gpu_layers"].try_cast("int")}
    missing = F.array_compact(F.array(*(F.when(clean[n].isNull(), n) for n in NEEDED)))
    return rows.select(*(F.col(c) for c in rows.columns if c not in clean), *(v.alias(k) for k, v in clean.items()), F.try_element_at(missing, F.lit(1)).alias("error"))


def toggles(given: dict[str, bool] | None = None) -> dict[str, bool]:
    """The switches of the language rules: on unless given otherwise. Unknown names raise."""
    given = given or {}
    if unknown := set(given) - set(TOGGLES):
        raise ValueError(f"unknown switches: {sorted(unknown)}")
    return {n: given.get(n, True) for n in TOGGLES}
