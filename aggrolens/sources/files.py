"""Reading and writing of corpora, models and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED = T.StructType([T.StructField("comment_text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"))])

MODEL = "token string, c0 long, c1 long, ll0 double, ll1 double, prior0 double, prior1 double"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """A CSV table with quoted, multi-line fields; rows of another width fail, or go where strict is off."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST" if strict else "DROPMALFORMED")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV, JSON or Parquet by the path's ending."""
    if path.endswith(".csv"):
        return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    if path.endswith(".json"):
        return spark.read.json(path, schema=schema, multiLine=True)
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


def prepare_labelled(raw: DataFrame) -> DataFrame:
    """text and label (any flag set) from a raw labelled source; flags that it lacks don't count, blank texts go."""
    flags = [c for c in LABELLED.names[1:] if c in raw.columns]
    text = F.regexp_replace("comment_text", r"(?U)^\s+|\s+$", "")
    label = F.greatest(*[F.coalesce(c, F.lit(0)) for c in flags]) if len(flags) > 1 else F.coalesce(F.col(flags[0]), F.lit(0))
    return raw.select(text.alias("text"), label.cast("int").alias("label")).where("text is not null and text <> ''")


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    s = c.cast("string")
    return F.when(s.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def safe_export(df: DataFrame) -> DataFrame:
    return df.select(*[safe_cell(F.col(c)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, quote_all: bool = False, crlf: bool = False, bom: bool = False) -> None:
    """CSV files under path, as many as df has partitions; with bom each begins with a byte order mark, as spreadsheets like it."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    w = df.write.option("header", True).option("quoteAll", quote_all).option("escape", '"')
    (w.option("lineSep", "\r\n") if crlf else w).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_lines(df: DataFrame, path: str, line: Column) -> None:
    """A text report, a line per row."""
    df.select(line.alias("value")).write.text(path)


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame | None:
    """The model saved at path; None, with which Naive Bayes gives 0.5, where there is none."""
    try:
        return spark.read.schema(MODEL).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


JSON_MODEL = "log_prior map<string,double>, log_likelihood map<string,map<string,double>>, class_counts map<string,long>, total_words map<string,long>, vocab_size long"


def read_json_model(spark: SparkSession, path: str) -> DataFrame:
    """The model table of a JSON object of nested maps: log_prior by class, log_likelihood by class and token, and, if they are there, total_words by class and vocab_size, from which raw counts are got back (else they are null).

    A token that one class lacks counts 0 there, as a score does that finds nothing to add. Other members are passed over.
    """
    d = spark.read.json(path, schema=JSON_MODEL, multiLine=True)
    of = lambda k: d.select(F.explode(F.try_element_at("log_likelihood", F.lit(str(k)))).alias("token", f"ll{k}"))
    by = lambda c, k: F.try_element_at(c, F.lit(str(k)))
    one = d.select(*[by("log_prior", k).alias(f"prior{k}") for k in (0, 1)], *[(by("total_words", k) + F.col("vocab_size")).alias(f"_t{k}") for k in (0, 1)]).limit(1)
    m = of(0).join(of(1), "token", "full").crossJoin(F.broadcast(one))  # one row
    count = lambda k: F.when(F.col(f"ll{k}").isNotNull(), F.round(F.exp(f"ll{k}") * F.col(f"_t{k}") - 1).cast("long")).alias(f"c{k}")
    return m.select("token", count(0), count(1), *[F.coalesce(f"ll{k}", F.lit(0.0)).alias(f"ll{k}") for k in (0, 1)], "prior0", "prior1")


def json_model(model: DataFrame) -> DataFrame:
    """One row of text, a model table as that JSON object. The format holds the whole vocabulary in one value; models larger than that belong in save_model."""
    pairs = lambda k: F.map_from_entries(F.collect_list(F.struct("token", f"ll{k}")))
    both = lambda a, b: F.create_map(F.lit("0"), a, F.lit("1"), b)
    members = [both(F.max("prior0"), F.max("prior1")).alias("log_prior"), both(pairs(0), pairs(1)).alias("log_likelihood"), both(F.sum("c0"), F.sum("c1")).alias("total_words"), F.count("*").alias("vocab_size")]
    return model.agg(*members).where("vocab_size > 0").select(F.to_json(F.struct("log_prior", "log_likelihood", "total_words", "vocab_size")).alias("value"))


def write_json_model(model: DataFrame, path: str) -> None:
    json_model(model).write.text(path)


def read_lexicon(spark: SparkSession, path: str, most: int = 50_000) -> dict[str, float]:
    """A lexicon of lower-case terms from a CSV table of term and valence. It becomes a literal of plans, so more than `most` terms are refused."""
    rows = read_csv(spark, path, "term string, valence double").where("term is not null and valence is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} holds more than {most} terms")
    return {r["term"].strip().lower(): r["valence"] for r in rows}


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """name and SHA-256 of each file under path."""
    d = spark.read.format("binaryFile").load(path)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
