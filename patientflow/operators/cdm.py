"""Complete relational tables from sequences, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import Registry
from ..plans.runtime import persisted
from . import derive, omop

# The columns of the common data model, in its order. Names that end in _id and counts are numbers, those in _date and _datetime
# times, all others texts; NUMBERS and MEASURES are the exceptions, UNKNOWN stays null. What a sequence does not tell is 0 or an empty text.
COLUMNS = {
    "person": "person_id gender_concept_id year_of_birth month_of_birth day_of_birth birth_datetime race_concept_id ethnicity_concept_id location_id provider_id care_site_id person_source_value gender_source_value gender_source_concept_id race_source_value race_source_concept_id ethnicity_source_value ethnicity_source_concept_id",
    "visit_occurrence": "visit_occurrence_id visit_concept_id person_id visit_start_date visit_start_datetime visit_end_date visit_end_datetime visit_type_concept_id provider_id care_site_id visit_source_value visit_source_concept_id admitted_from_concept_id admitted_from_source_value discharged_to_concept_id discharged_to_source_value preceding_visit_occurrence_id",
    "condition_occurrence": "condition_occurrence_id person_id condition_concept_id condition_start_date condition_start_datetime condition_end_date condition_end_datetime condition_type_concept_id stop_reason provider_id visit_occurrence_id visit_detail_id condition_source_value condition_source_concept_id condition_status_source_value condition_status_concept_id",
    "drug_exposure": "drug_exposure_id person_id drug_concept_id drug_exposure_start_date drug_exposure_start_datetime drug_exposure_end_date drug_exposure_end_datetime verbatim_end_date drug_type_concept_id stop_reason refills quantity days_supply sig route_concept_id lot_number provider_id visit_occurrence_id visit_detail_id drug_source_value drug_source_concept_id route_source_value dose_unit_source_value",
    "procedure_occurrence": "procedure_occurrence_id person_id procedure_concept_id procedure_date procedure_datetime procedure_type_concept_id modifier_concept_id quantity provider_id visit_occurrence_id visit_detail_id procedure_source_value procedure_source_concept_id qualifier_source_value",
    "death": "person_id death_date death_datetime death_type_concept_id cause_concept_id cause_source_value cause_source_concept_id",
    "measurement": "measurement_id person_id measurement_concept_id measurement_date measurement_datetime measurement_type_concept_id operator_concept_id value_as_number value_as_concept_id unit_concept_id range_low range_high provider_id visit_occurrence_id visit_detail_id measurement_source_value measurement_source_concept_id unit_source_value value_source_value",
}
NUMBERS = {"year_of_birth", "month_of_birth", "day_of_birth", "refills", "quantity", "days_supply"}
MEASURES = {"value_as_number", "range_low", "range_high"}
UNKNOWN = {"refills", "days_supply", "range_low", "range_high", ("drug_exposure", "quantity")}


def kind_of(column: str) -> str:
    """The type of a column, from its name."""
    if column in MEASURES:
        return "double"
    if column.endswith("_id") or column in NUMBERS:
        return "bigint"
    return "date" if column.endswith("_date") else "timestamp_ntz" if column.endswith("_datetime") else "string"


def completed(rows: DataFrame, name: str) -> DataFrame:
    """The rows with all columns of the table ``name`` in its order; columns that are not there get the default of their type."""
    out = []
    for c in COLUMNS[name].split():
        kind = kind_of(c)
        if c in rows.columns:
            value = F.col(c)
        elif c in UNKNOWN or (name, c) in UNKNOWN:
            value = F.lit(None)
        else:
            value = F.lit(0 if kind == "bigint" else "")
        out.append(value.cast(kind).alias(c))
    return rows.select(*out)


class CdmTables:
    """The seven tables of a set of sequences, with keys that refer to each other: visits are numbered by person and visit, events by person and place.

    Rejected sequences (see :class:`omop.OmopTables`) give nothing.
    """

    def __init__(self, tables: omop.OmopTables):
        self.tables = tables
        v = tables.visits()
        self._visits = persisted(tables.with_ids(v, "visit_occurrence_id", ["person_id", "visit"]), "visits")

    def person(self) -> DataFrame:
        p = self.tables.person()
        return completed(p.withColumns({"month_of_birth": F.lit(1), "day_of_birth": F.lit(1), "birth_datetime": F.make_timestamp_ntz("year_of_birth", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))}), "person")

    def visit_occurrence(self) -> DataFrame:
        v = self._visits.withColumns({"visit_start_date": F.to_date("visit_start_datetime"), "visit_end_date": F.to_date("visit_end_datetime"), "visit_source_concept_id": F.col("visit_concept_id")})
        return completed(v, "visit_occurrence")

    def _events(self, rows: DataFrame, name: str, stem: str, start: str, ends: tuple[str, ...] = ()) -> DataFrame:
        """``stem``: of the concept's column; ``start``: of the columns of the event's date and time; ``ends``: of those that repeat them."""
        j = rows.join(self._visits.select("person_id", "visit", "visit_occurrence_id"), ["person_id", "visit"])
        j = self.tables.with_ids(j, f"{name}_id", ["person_id", "pos"])
        new = {f"{stem}_concept_id": F.col("concept_id"), f"{stem}_source_concept_id": F.col("concept_id")}
        for t in (start, *ends):
            new |= {f"{t}_date": F.to_date("datetime"), f"{t}_datetime": F.col("datetime")}
        return j.withColumns(new)

    def condition_occurrence(self) -> DataFrame:
        e = self._events(self.tables.conditions(), "condition_occurrence", "condition", "condition_start", ("condition_end",))
        return completed(e.withColumnRenamed("type_concept_id", "condition_type_concept_id"), "condition_occurrence")

    def drug_exposure(self) -> DataFrame:
        e = self._events(self.tables.drugs(), "drug_exposure", "drug", "drug_exposure_start", ("drug_exposure_end",))
        return completed(e.withColumnRenamed("type_concept_id", "drug_type_concept_id").withColumn("verbatim_end_date", F.to_date("datetime")), "drug_exposure")

    def procedure_occurrence(self) -> DataFrame:
        e = self._events(self.tables.procedures(), "procedure_occurrence", "procedure", "procedure")
        return completed(e.withColumnRenamed("type_concept_id", "procedure_type_concept_id").withColumn("quantity", F.lit(1)), "procedure_occurrence")

    def measurement(self) -> DataFrame:
        e = self._events(self.tables.measurements(), "measurement", "measurement", "measurement")
        return completed(e.withColumn("operator_concept_id", F.coalesce("operator_concept_id", F.lit(0))), "measurement")

    def death(self) -> DataFrame:
        """The time of a death is the last moment of its day."""
        d = self.tables.deaths()
        return completed(d.withColumn("death_datetime", F.expr("CAST(date_add(death_date, 1) AS TIMESTAMP_NTZ) - INTERVAL 1 MICROSECOND")), "death")


def cdm_tables(spark, sf_dir: str) -> CdmTables:
    return CdmTables(omop.omop_tables(spark, sf_dir))


R = Registry()


def _select(name: str, given: dict[str, str]) -> str:
    """The SQL of all columns of a table: those given, else the defaults."""
    out = []
    for c in COLUMNS[name].split():
        kind = {"bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR"}[kind_of(c)]
        value = given.get(c, "NULL" if c in UNKNOWN or (name, c) in UNKNOWN else "0" if kind == "BIGINT" else "''")
        out.append(f"CAST({value} AS {kind}) AS {c}")
    return ", ".join(out)


_OTHER = ", ".join(map(str, omop.OTHER_DOMAINS))
_VISITS = """, en AS (SELECT person_id, no, min(tm) AS until FROM g WHERE ve AND stay GROUP BY ALL),
dd AS (SELECT person_id, no, max_by(k, i) AS d FROM g WHERE ev AND (domain = 'Visit' OR k IN (4216643, 4021968, 4146681, 4161979)) GROUP BY ALL),
vo AS (SELECT row_number() OVER (ORDER BY g.person_id, g.no) AS id, g.person_id, g.no, vt, tm, coalesce(until, tm) AS until, CASE WHEN until IS NOT NULL THEN coalesce(d, 0) ELSE 0 END AS d
FROM g LEFT JOIN en ON g.person_id = en.person_id AND g.no = en.no LEFT JOIN dd ON g.person_id = dd.person_id AND g.no = dd.no WHERE visit)
"""


def _events_sql(domain: str, name: str, stem: str, times: tuple[str, ...], given: dict[str, str]) -> str:
    dates = {f"{t}_{k}": f"tm::{'DATE' if k == 'date' else 'TIMESTAMP'}" for t in times for k in ("date", "datetime")}
    all_ = {f"{name}_id": "id", "person_id": "person_id", f"{stem}_concept_id": "k", f"{stem}_source_concept_id": "k", "visit_occurrence_id": "vid", **dates, **given}
    rows = f"""SELECT row_number() OVER (ORDER BY g.person_id, i) AS id, g.person_id, k, g.tm, w, vo.id AS vid FROM g JOIN vo USING (person_id, no)
 WHERE ev AND op IS NOT NULL AND coalesce(domain, CASE WHEN k IN ({_OTHER}) THEN 'Drug' END) = '{domain}' AND k NOT IN ({", ".join(map(str, omop.DISCHARGES))})"""
    return f"{omop._FACTS}{_VISITS}, ee AS ({rows}) SELECT {_select(name, all_)} FROM ee"


CDM_SQL = {
    "person": omop._FACTS + "SELECT " + _select("person", {"person_id": "person_id", "gender_concept_id": "coalesce(TRY_CAST(replace(g0, 'Gender/', '') AS BIGINT), 0)", "race_concept_id": "coalesce(TRY_CAST(replace(r0, 'Race/', '') AS BIGINT), 0)", "year_of_birth": "CAST(substr(y0, 6) AS INT) - CAST(substr(a0, 5) AS INT)", "month_of_birth": "1", "day_of_birth": "1", "birth_datetime": "make_timestamp(CAST(substr(y0, 6) AS INT) - CAST(substr(a0, 5) AS INT), 1, 1, 0, 0, 0)"}) + " FROM p WHERE person_id NOT IN (FROM bad)",
    "visit_occurrence": omop._FACTS + _VISITS + "SELECT " + _select("visit_occurrence", {"visit_occurrence_id": "id", "visit_concept_id": "vt", "person_id": "person_id", "visit_start_date": "tm::DATE", "visit_start_datetime": "tm", "visit_end_date": "until::DATE", "visit_end_datetime": "until", "visit_type_concept_id": str(omop.VISIT_TYPE), "visit_source_concept_id": "vt", "discharged_to_concept_id": "d"}) + " FROM vo",
    "condition_occurrence": _events_sql("Condition", "condition_occurrence", "condition", ("condition_start", "condition_end"), {"condition_type_concept_id": str(omop.CONDITION_TYPE)}),
    "drug_exposure": _events_sql("Drug", "drug_exposure", "drug", ("drug_exposure_start", "drug_exposure_end"), {"drug_type_concept_id": str(omop.DRUG_TYPE), "verbatim_end_date": "tm::DATE"}),
    "procedure_occurrence": _events_sql("Procedure", "procedure_occurrence", "procedure", ("procedure",), {"procedure_type_concept_id": str(omop.PROCEDURE_TYPE), "quantity": "1"}),
    "measurement": _events_sql("Measurement", "measurement", "measurement", ("measurement",), {"operator_concept_id": f"CASE WHEN w.v IS NOT NULL THEN {omop.NUMERIC_OPERATOR} ELSE 0 END", "value_as_number": "w.v", "unit_source_value": "w.u"}),
    "death": omop._FACTS + "SELECT " + _select("death", {"person_id": "person_id", "death_date": "tm::DATE", "death_datetime": "tm::DATE + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND", "death_type_concept_id": str(omop.DEATH_TYPE)}) + " FROM g WHERE dying",
}

for _name, _text in CDM_SQL.items():
    R.query(f"cdm_{_name}", _text)(lambda spark, sf_dir, name=_name: getattr(cdm_tables(spark, sf_dir), name)())


def _over_cdm(names: list[str], text: str) -> str:
    """A query over the tables made from sequences instead of the given ones."""
    return "WITH " + ", ".join(f"{n} AS ({CDM_SQL[n]})" for n in names) + " " + text


@R.query("cdm_condition_era", _over_cdm(["condition_occurrence"], "SELECT * FROM (" + derive._ERA.format(extra="") + ")"))
def cdm_condition_era(spark, sf_dir: str) -> DataFrame:
    """Sequences to tables to condition eras."""
    return derive.condition_era(cdm_tables(spark, sf_dir).condition_occurrence())


@R.query("cdm_observation_period", _over_cdm(["person", *[d.name for d in derive.DOMAINS]], derive._period_sql(derive.DOMAINS)))
def cdm_observation_period(spark, sf_dir: str) -> DataFrame:
    """Sequences to tables to observation periods over visits, conditions, procedures and drugs."""
    t = cdm_tables(spark, sf_dir)
    return derive.observation_period(t.person(), {d.name: getattr(t, d.name)() for d in derive.DOMAINS}, derive.DOMAINS)
