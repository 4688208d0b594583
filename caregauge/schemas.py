"""Staging schemas (text as delivered) and the star handed to every query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .operators.storage import BROADCAST_LIMIT, source_bytes


def _text(names: str, **other) -> StructType:
    return StructType([StructField(n, other.get(n, StringType())) for n in names.split()])


# Column order of the delivered files.
HOSPITAL_FILE = _text(
    "facility_id facility_name address city state zip_code county_name phone_number"
    " hospital_type hospital_ownership emergency_services meets_criteria_ehr"
    " hospital_overall_rating mortality_group safety_group readmission_group"
    " patient_exp_group timeliness_group",
    hospital_overall_rating=IntegerType(),
)
READMISSION_FILE = _text(
    "facility_id facility_name state measure_name number_of_discharges footnote"
    " excess_readmission_ratio predicted_readmission_rate expected_readmission_rate"
    " number_of_readmissions start_date end_date"
)
SURVEY_FILE = _text(
    "facility_id facility_name address city state zip_code county_name phone_number"
    " hcahps_measure_id hcahps_question hcahps_answer_description"
    " patient_survey_star_rating patient_survey_star_rating_footnote"
    " hcahps_answer_percent hcahps_answer_percent_footnote"
    " number_of_completed_surveys number_of_completed_surveys_footnote"
    " survey_response_rate_percent survey_response_rate_percent_footnote"
    " start_date end_date"
)
QUALITY_FILE = _text(
    "facility_id facility_name address city state zip_code county_name phone_number"
    " condition measure_id measure_name compared_to_national denominator score"
    " lower_estimate higher_estimate footnote start_date end_date"
)

# Headers whose snake_case form is not the staging name.
HEADER_NAMES = {
    "Meets criteria for meaningful use of EHRs": "meets_criteria_ehr",
    "Mortality national comparison": "mortality_group",
    "Safety of care national comparison": "safety_group",
    "Readmission national comparison": "readmission_group",
    "Patient experience national comparison": "patient_exp_group",
    "Timeliness of care national comparison": "timeliness_group",
}


_KEYS = "hospital_key BIGINT, measure_key BIGINT, unknown_measure BIGINT, start_date_key INT, end_date_key INT"

# Columns of the saved core tables, by their place in the star. Stated, so that reading
# needs no look into files and works on a table without rows.
CORE = {
    "hospitals": "hospital_key BIGINT, facility_id STRING, facility_name STRING, city STRING,"
    " state STRING, zip_code STRING, county_name STRING, hospital_type STRING,"
    " hospital_ownership STRING, emergency_services BOOLEAN, overall_rating INT,"
    " mortality_group STRING, safety_group STRING, readmission_group STRING,"
    " patient_exp_group STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "dates": "date_key INT, full_date DATE, year INT, quarter INT, month INT, month_name STRING,"
    " week_of_year INT, day_of_week INT, day_name STRING, is_weekend BOOLEAN, fiscal_year INT,"
    " fiscal_quarter INT",
    "measures": "measure_key BIGINT, measure_id STRING, measure_name STRING,"
    " measure_category STRING, higher_is_better BOOLEAN, unit_of_measure STRING",
    "readmissions": f"readmission_key BIGINT, {_KEYS}, number_of_discharges INT,"
    " number_of_readmissions INT, predicted_readmission_rate DECIMAL(8,4),"
    " expected_readmission_rate DECIMAL(8,4), excess_readmission_ratio DECIMAL(8,4),"
    " readmission_rate_pct DECIMAL(8,4), created_at TIMESTAMP, end_year INT",
    "satisfaction": f"satisfaction_key BIGINT, {_KEYS}, star_rating DECIMAL(3,1),"
    " answer_percent DECIMAL(5,2), completed_surveys INT, response_rate_pct DECIMAL(5,2),"
    " created_at TIMESTAMP, end_year INT",
    "quality": f"quality_key BIGINT, {_KEYS}, condition STRING, score DECIMAL(10,4),"
    " lower_estimate DECIMAL(10,4), higher_estimate DECIMAL(10,4), denominator INT,"
    " compared_to_national STRING, created_at TIMESTAMP, end_year INT",
}


class Star:
    """Dimensions and facts of one data set.

    ``hospitals`` is keyed by hospital_key (unique facility_id), ``measures`` by
    measure_key (unique measure_id), ``dates`` by date_key (yyyyMMdd). The facts
    ``readmissions``, ``satisfaction`` and ``quality`` carry hospital_key, measure_key
    (may be NULL; loaded facts then say in ``unknown_measure`` which one was delivered),
    start_date_key and end_date_key. Each is a frame, or a function that
    returns one and is called when a query first needs it.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        self._tables = tables
        self._small: dict[str, bool] = {}

    def _table(self, name: str) -> DataFrame:
        found = self._tables[name]
        if callable(found):
            found = self._tables[name] = found()
        return found

    def side(self, name: str, df: DataFrame) -> DataFrame:
        """A frame made from dimension ``name``, as a side to join facts to.

        Broadcast if the dimension's source files are small, which is looked up once;
        else left to a shuffled join, which splits hot keys.
        """
        if name not in self._small:
            self._small[name] = source_bytes(self._table(name)) <= BROADCAST_LIMIT
        return F.broadcast(df) if self._small[name] else df

    def hospitals_with(self, *columns: str) -> DataFrame:
        """Key and columns of the hospitals, as a side to join to."""
        return self.side("hospitals", self.hospitals.select("hospital_key", *columns))

    hospitals = property(lambda self: self._table("hospitals"))
    dates = property(lambda self: self._table("dates"))
    measures = property(lambda self: self._table("measures"))
    readmissions = property(lambda self: self._table("readmissions"))
    satisfaction = property(lambda self: self._table("satisfaction"))
    quality = property(lambda self: self._table("quality"))
