"""Sources and sinks: table folders, buffered exports, JDBC, artifacts."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.registry import Registry
from ..plans.runtime import new_path, table

#: Old dates are read as they are written, without a change of calendar.
REBASE = {"datetimeRebaseMode": "CORRECTED", "int96RebaseMode": "CORRECTED"}
#: Text files that keep blanks, line breaks, empty texts and nulls apart.
CSV = {"header": True, "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\\N", "emptyValue": "", "multiLine": True, "escape": '"'}
JDBC_BATCH, JDBC_PARTITIONS, JDBC_TIMEOUT = 200_000, 10, 500


def read_folder(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a folder that exist, by name; a table is a parquet file or folder ``name`` or ``name.parquet``."""
    out = {}
    for n in names:
        for path in (f"{folder}/{n}", f"{folder}/{n}.parquet"):
            if exists(spark, path):
                out[n] = spark.read.options(**REBASE).parquet(path)
                break
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything stands at a path of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of parquet files; Spark counts from the footers' row groups without reading columns."""
    return spark.read.parquet(path).count()


def pooled(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All files of a pattern below a folder, at any depth."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(folder)


def run_query(spark: SparkSession, text: str, tables: dict[str, DataFrame], parameters: dict | None = None) -> DataFrame:
    """SQL over given tables, named as ``{name}``, with ``:parameters``; nothing is registered globally."""
    return spark.sql(text, args=parameters or {}, **tables)


#: Bounds that every built table may refer to: its dates and the ages of its persons.
BOUNDS = {"date_lower_bound": "1900-01-01", "date_upper_bound": "2026-06-30", "age_lower_bound": 0, "age_upper_bound": 200}


def build_table(spark: SparkSession, text: str, tables: dict[str, DataFrame], bounds: dict | None = None) -> DataFrame:
    """A table from a query over others, which may use the bounds as ``:date_lower_bound`` and so on."""
    return run_query(spark, text, tables, BOUNDS | (bounds or {}))


#: Columns of a sequence that later steps read; of the optional ones those that are there.
REQUIRED, OPTIONAL = ["person_id", "concept_ids"], ["num_of_concepts", "num_of_visits", "index_date", "label"]


def pruned(df: DataFrame, required: list[str] = REQUIRED, optional: list[str] = OPTIONAL) -> DataFrame:
    """The columns of a list: the required ones, which must be there, and the optional ones that are."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.select(*required, *[c for c in optional if c in df.columns])


def build(spark: SparkSession, path: str, df: DataFrame, resume: bool = False) -> bool:
    """Writes a table; with ``resume`` not if it exists. Returns whether it was written."""
    if resume and exists(spark, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def export(tables: dict[str, DataFrame], folder: str, csv: bool = False, partition_by: dict[str, list[str]] | None = None) -> None:
    """One folder per table, as parquet or CSV with a header; arrays cannot go into CSV."""
    for n, d in tables.items():
        w = d.write.mode("overwrite")
        if partition_by and n in partition_by:
            w = w.partitionBy(*partition_by[n])
        w.options(**CSV).csv(f"{folder}/{n}") if csv else w.parquet(f"{folder}/{n}")


def to_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str], partitions: int = JDBC_PARTITIONS) -> None:
    """Overwrites a database table in batches, with a bounded number of connections."""
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=JDBC_BATCH, numPartitions=partitions, queryTimeout=JDBC_TIMEOUT, **properties).mode("overwrite").save()


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path, or what ``make`` returns, written there first."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Appends results; a partly filled last batch is written like any other."""
    df.write.mode("append").parquet(path)


def save_artifacts(folder: str, **tables: DataFrame) -> None:
    """A tokenizer's parts (vocabulary, time and value vocabularies, statistics), or an embedding store, as parquet tables."""
    export(tables, folder)


def load_artifacts(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    found = read_folder(spark, folder, names)
    missing = [n for n in names if n not in found]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return found


def nested_visits(df: DataFrame) -> DataFrame:
    """Nested patient records to events: ``person_id, birth, gender, race, visit_no, visit_type, start, end, discharge, time, code, number, text, unit``.

    One row per event; visits without events give one row with null event columns. Persons without visits give none.
    """
    v = df.select(F.col("patient_id").alias("person_id"), F.col("birth_datetime").alias("birth"), "gender", "race", F.posexplode("visits").alias("visit_no", "v"))
    e = v.select("*", F.explode_outer("v.events").alias("e"))
    return e.select("person_id", "birth", "gender", "race", "visit_no", "v.visit_type", F.col("v.visit_start_datetime").alias("start"), F.col("v.visit_end_datetime").alias("end"), F.col("v.discharge_facility").alias("discharge"), "e.time", "e.code", F.col("e.numeric_value").alias("number"), F.col("e.text_value").alias("text"), "e.unit")


R = Registry()
_NAMES = ["person", "visit_occurrence", "condition_occurrence", "measurement", "processed_dataset", "patient_splits", "lab_stats", "concept"]


@R.query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _NAMES))
def table_counts(spark, sf_dir: str) -> DataFrame:
    """Rows of each table of the folder, from the files' footers."""
    return spark.createDataFrame([(n, row_count(spark, f"{sf_dir}/{n}.parquet")) for n in _NAMES], "name string, n bigint")


@R.query("table_export", "SELECT visit_occurrence_id, person_id, visit_concept_id, visit_start_date FROM visit_occurrence")
def table_export(spark, sf_dir: str) -> DataFrame:
    """Visits, exported by year of start and read again from all folders."""
    v = table(spark, sf_dir, "visit_occurrence").select("visit_occurrence_id", "person_id", "visit_concept_id", "visit_start_date").withColumn("year", F.year("visit_start_date"))
    path = new_path(spark, "export")
    export({"visit_occurrence": v}, path, partition_by={"visit_occurrence": ["year"]})
    return read_folder(spark, path, ["visit_occurrence"])["visit_occurrence"].drop("year")


@R.query("csv_export", "SELECT person_id, year_of_birth, person_source_value FROM person")
def csv_export(spark, sf_dir: str) -> DataFrame:
    """Persons through CSV files."""
    p = table(spark, sf_dir, "person").select("person_id", "year_of_birth", "person_source_value")
    path = new_path(spark, "csv")
    export({"person": p}, path, csv=True)
    return spark.read.options(**CSV).schema(p.schema).csv(f"{path}/person")


@R.query("sql_over_tables", "SELECT v.visit_concept_id, count(*) AS n, count(DISTINCT v.person_id) AS n_persons FROM visit_occurrence v JOIN person p ON v.person_id = p.person_id WHERE v.visit_start_date >= DATE '2015-01-01' GROUP BY 1")
def sql_over_tables(spark, sf_dir: str) -> DataFrame:
    """A parameterised SQL text over given tables."""
    text = "SELECT v.visit_concept_id, count(*) AS n, count(DISTINCT v.person_id) AS n_persons FROM {v} v JOIN {p} p ON v.person_id = p.person_id WHERE v.visit_start_date >= :since GROUP BY 1"
    import datetime

    return run_query(spark, text, {"v": table(spark, sf_dir, "visit_occurrence"), "p": table(spark, sf_dir, "person")}, {"since": datetime.date(2015, 1, 1)})


@R.query("embedding_store", "SELECT vec_id, label, round(sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])), 4) AS norm FROM embeddings")
def embedding_store(spark, sf_dir: str) -> DataFrame:
    """Vectors saved and loaded as an artifact, with their norms."""
    path = new_path(spark, "store")
    save_artifacts(path, vectors=table(spark, sf_dir, "embeddings"))
    v = load_artifacts(spark, path, ["vectors"])["vectors"]
    return v.select("vec_id", "label", F.round(F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


@R.query("nested_visits", """WITH v AS (SELECT DISTINCT visit_occurrence_id, person_id, visit_concept_id, visit_start_datetime, visit_end_datetime FROM visit_occurrence WHERE visit_occurrence_id IS NOT NULL AND person_id IS NOT NULL),
c AS (SELECT DISTINCT visit_occurrence_id, condition_concept_id, condition_start_datetime FROM condition_occurrence WHERE visit_occurrence_id IS NOT NULL)
SELECT person_id, visit_concept_id::VARCHAR AS visit_type, visit_start_datetime AS start, condition_concept_id::VARCHAR AS code, condition_start_datetime AS time FROM v LEFT JOIN c USING (visit_occurrence_id)""")
def nested_visits_query(spark, sf_dir: str) -> DataFrame:
    """Visits and their conditions, nested into one record a person and read from it again."""
    none = lambda kind: F.lit(None).cast(kind)
    v = table(spark, sf_dir, "visit_occurrence").where("visit_occurrence_id is not null and person_id is not null").select("visit_occurrence_id", "person_id", "visit_concept_id", "visit_start_datetime", "visit_end_datetime").distinct()
    c = table(spark, sf_dir, "condition_occurrence").where("visit_occurrence_id is not null").select("visit_occurrence_id", "condition_concept_id", "condition_start_datetime").distinct()
    event = F.struct(F.col("condition_start_datetime").alias("time"), F.col("condition_concept_id").cast("string").alias("code"), none("double").alias("numeric_value"), none("string").alias("text_value"), none("string").alias("unit"))
    e = c.groupBy("visit_occurrence_id").agg(F.collect_list(event).alias("events"))
    visit = F.struct(F.col("visit_concept_id").cast("string").alias("visit_type"), "visit_start_datetime", "visit_end_datetime", none("string").alias("discharge_facility"), "events")
    nested = v.join(e, "visit_occurrence_id", "left").groupBy(F.col("person_id").alias("patient_id")).agg(F.collect_list(visit).alias("visits"))
    nested = nested.select("patient_id", none("timestamp_ntz").alias("birth_datetime"), none("string").alias("gender"), none("string").alias("race"), "visits")
    return nested_visits(cached(spark, new_path(spark, "nested"), lambda: nested)).select("person_id", "visit_type", "start", "code", "time")


_BOUNDED = """SELECT v.visit_occurrence_id, v.person_id, year(v.visit_start_date) - p.year_of_birth AS age FROM {v} v JOIN {p} p ON v.person_id = p.person_id
WHERE v.visit_start_date BETWEEN CAST({date_lower_bound} AS DATE) AND CAST({date_upper_bound} AS DATE) AND year(v.visit_start_date) - p.year_of_birth BETWEEN {age_lower_bound} AND {age_upper_bound}"""


@R.query("bounded_table", _BOUNDED.format(v="visit_occurrence", p="person", **{k: f"'{x}'" if isinstance(x, str) else x for k, x in BOUNDS.items()}))
def bounded_table(spark, sf_dir: str) -> DataFrame:
    """Visits within the bounds of dates and ages."""
    text = _BOUNDED.format(v="{v}", p="{p}", **{k: f":{k}" for k in BOUNDS})
    return build_table(spark, text, {"v": table(spark, sf_dir, "visit_occurrence"), "p": table(spark, sf_dir, "person")})


@R.query("pruned_sequences", "SELECT person_id, len(concept_ids) AS n, num_of_concepts, num_of_visits FROM processed_dataset")
def pruned_sequences(spark, sf_dir: str) -> DataFrame:
    """The columns that later steps read, of the sequences."""
    return pruned(table(spark, sf_dir, "processed_dataset")).select("person_id", F.when(F.col("concept_ids").isNotNull(), F.size("concept_ids")).alias("n"), "num_of_concepts", "num_of_visits")
