"""Tabular sources: annotation TSV, mapping TSV, submission CSV and GAF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.vocab import ANNOTATION_COLUMNS, MAPPING_RELATIONS, SUBMISSION_COLUMNS
from claimweave.functions.web import namespace
from claimweave.operators.filters import lookup
from claimweave.operators.graph import transitive_closure
from claimweave.operators.joins import resolve_ids
from claimweave.operators.similarity import information_content
from claimweave.session import cut_lineage
from claimweave.sources.ontology import edges_of
from claimweave.sources.lines import cell, header_of, number_rows, read_lines
from claimweave.sources.split import quoted_records


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, metadata) of annotation files. A row with another number of cells than its header fails the job."""
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    body = F.trim(F.regexp_replace("value", "^#+", ""))
    hashed = F.col("value").startswith("#")
    header = column_places(header_of(lines, ~hashed | body.contains("\t")))
    j = lines.join(header, "file")
    meta = j.filter((F.col("line_no") < F.col("header_no")) & hashed & body.contains(":") & ~body.contains("\t")).select(
        "file", F.lower(F.trim(F.substring_index(body, ":", 1))).alias("key"),
        F.trim(F.regexp_replace(body, r"^[^:]*:", "")).alias("value"))
    rows = j.filter(F.col("line_no") > F.col("header_no")).select("line_no", checked_cells(j).alias("cells"), "place")

    def picked(name: str):
        return F.get("cells", F.col("place")[name] - 1)

    wanted = [w for w in ANNOTATION_COLUMNS.values() if w != "database_id"]
    return rows.select("line_no", namespace(picked("database_id")).alias("database_id"), picked("database_id").alias("original_database_id"),
                       *[picked(w).alias(w) for w in wanted]), meta


def column_places(header: DataFrame) -> DataFrame:
    """Adds the number of columns and a struct with each wanted column's 1-based place: worked out once per file."""
    plain = F.transform(F.split(F.regexp_replace("header", r"^#+\s*", ""), "\t"), lambda c: F.trim(c))
    names = F.transform(plain, lambda c: F.coalesce(lookup(ANNOTATION_COLUMNS, F.replace(F.lower(c), F.lit("_"), F.lit(""))), c))
    place = F.struct(*[F.array_position(names, w).cast("int").alias(w) for w in ANNOTATION_COLUMNS.values()])
    lacking = F.array_except(F.array(*[F.lit(w) for w in ANNOTATION_COLUMNS.values()]), names)
    return header.select("file", "header_no", F.size(names).alias("width"), place.alias("place"), F.array_join(lacking, ", ").alias("lacking"))


def checked_cells(j: DataFrame):
    """Cells of a data line; fails on a lacking column or another number of cells.

    The optimizer may evaluate cells before it drops head lines, so the checks look at data lines only.
    """
    cells = F.split("value", "\t", -1)
    return (
        F.when(F.col("line_no") <= F.col("header_no"), F.lit(None).cast("array<string>"))
        .when(F.col("lacking") != "", F.raise_error(F.concat(F.lit("header lacks columns "), "lacking")))
        .when(F.size(cells) != F.col("width"), F.raise_error(F.format_string(
            "line %d: expected %d columns, got %d", F.col("line_no"), F.col("width"), F.size(cells))))
        .otherwise(cells)
    )


def read_mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, metadata) of mapping files: typed relation, object id in canonical spelling, original kept."""
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    hashed = F.col("value").startswith("#")
    body = F.trim(F.substr("value", F.lit(2)))
    meta = lines.filter(hashed & body.contains(":") & ~body.startswith("-")).select(
        "file", F.trim(F.substring_index(body, ":", 1)).alias("key"), F.trim(F.regexp_replace(body, r"^[^:]*:", "")).alias("value")
    ).filter("value <> ''")
    data = lines.filter(~hashed)
    header = header_of(data, F.lit(True))
    names = F.split("header", "\t")
    required = F.array(*[F.lit(c) for c in ("subject_id", "predicate_id", "object_id")])
    lacking = F.array_except(required, names)
    cells = F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("header lacks "), F.array_join(lacking, ", ")))).otherwise(F.split("value", "\t", -1))
    rows = data.join(header, "file").filter("line_no > header_no").select("line_no", names.alias("names"), cells.alias("cells"))

    def col(name: str):
        return cell(F.col("cells"), F.col("names"), name)

    return rows.select(
        "line_no", col("subject_id").alias("subject_id"), col("predicate_id").alias("predicate_id"),
        lookup(MAPPING_RELATIONS, col("predicate_id")).alias("relation"), namespace(col("object_id")).alias("object_id"),
        col("object_id").alias("original_object_id"), F.nullif(col("mapping_justification"), F.lit("")).alias("mapping_justification")), meta


def read_submissions(spark: SparkSession, path: str, symbols: DataFrame | None = None) -> DataFrame:
    """Submission CSV with 1-based data-row numbers, for selected symbols only when given: (symbol).

    Values may hold line breaks inside quotes; one large file is read by many tasks all the same (``split.quoted_records``).
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = reader.csv(path).columns  # from the first record alone
    schema = ", ".join(f"`{n}` string" for n in names)
    cells = F.from_csv("value", schema, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    raw = quoted_records(spark, path).filter("record > 1").select((F.col("record") - 1).alias("row"), cells.alias("c")).select("row", "c.*")
    have = [c for c in SUBMISSION_COLUMNS if c in raw.columns]
    rows = raw.select("row", *[F.coalesce(c, F.lit("")).alias(c) for c in have])
    if symbols is None:
        return rows
    return rows.join(symbols.select(F.col("symbol").alias("gene_symbol")), "gene_symbol", "left_semi")


def read_gaf(spark: SparkSession, path: str, symbols: DataFrame | None = None, processes: DataFrame | None = None) -> DataFrame:
    """Process annotations of GAF 2.x files for selected symbols or processes, with physical line numbers."""
    cells = F.split("value", "\t", -1)
    rows = read_lines(spark, path).filter(~F.col("value").startswith("!")).withColumn("c", cells).filter(
        (F.size("c") >= 15) & (F.get("c", F.lit(8)) == "P"))
    out = rows.select(
        "line_no", F.get("c", F.lit(2)).alias("symbol"), F.get("c", F.lit(3)).alias("qualifier"), F.get("c", F.lit(4)).alias("process"),
        F.get("c", F.lit(5)).alias("reference"), F.get("c", F.lit(6)).alias("evidence_code"), F.get("c", F.lit(14)).alias("assigned_by"))
    if symbols is not None:
        out = out.join(symbols.select("symbol"), "symbol", "left_semi")
    if processes is not None:
        out = out.join(processes.select("process"), "process", "left_semi")
    return out


def ic_reference_rows(annotations: DataFrame, resolved: DataFrame, prefix: str = "OMIM:") -> DataFrame:
    """(entity, term) of the reference population: positive phenotype rows whose term resolves."""
    kept = annotations.filter((F.col("aspect") == "P") & (F.upper("qualifier") != "NOT") & F.col("database_id").startswith(prefix))
    return kept.join(resolved.filter("resolved is not null").withColumnRenamed("id", "hpo_id"), "hpo_id").select(
        F.col("database_id").alias("entity"), F.col("resolved").alias("term"))


def reference_terms(terms: DataFrame, annotations: DataFrame | None) -> DataFrame:
    """(term, n, total, ic) of every term of a pinned ontology; without annotations there is no reference and all is null."""
    named = terms.select(F.col("id").alias("term"))
    if annotations is None:
        return named.select("term", *[F.lit(None).cast(kind).alias(c) for c, kind in (("n", "bigint"), ("total", "bigint"), ("ic", "double"))])
    alternates = terms.select(F.explode("alt_ids").alias("alt_id"), F.col("id").alias("term"))
    resolved = resolve_ids(annotations.select(F.col("hpo_id").alias("id")), terms.select(F.col("id").alias("term"), "is_obsolete", "replaced_by"), alternates)
    closure = cut_lineage(transitive_closure(edges_of(terms)), "closure")
    return named.join(information_content(ic_reference_rows(annotations, resolved), closure), "term", "left")
