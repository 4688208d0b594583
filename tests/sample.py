"""A small set of deliveries: ten hospitals, readmission, quality and survey rows.

Fixed values: ids, codes and numbers; names and addresses are invented.
"""

from pyspark.sql import functions as F

from caregauge import constants as K
from caregauge.plans import dimensions, facts
from caregauge.schemas import HOSPITAL_FILE, QUALITY_FILE, READMISSION_FILE, SURVEY_FILE, Star
from caregauge.sources.generated import date_dimension

ACUTE, CRITICAL = "Acute Care Hospitals", "Critical Access Hospitals"

# id, city, state, type, rating
HOSPITALS = [
    ("010001", "DOTHAN", "AL", ACUTE, 3),
    ("010005", "BOAZ", "AL", ACUTE, 4),
    ("010006", "FLORENCE", "AL", ACUTE, 3),
    ("010007", "OPP", "AL", ACUTE, 2),
    ("010008", "LUVERNE", "AL", CRITICAL, 3),
    ("060001", "ROCHESTER", "MN", ACUTE, 5),
    ("140010", "CHICAGO", "IL", ACUTE, 5),
    ("330101", "NEW YORK", "NY", ACUTE, 4),
    ("050625", "LOS ANGELES", "CA", ACUTE, 4),
    ("450639", "SAN ANTONIO", "TX", ACUTE, 3),
]

FEW, NOT_AVAILABLE = "Too Few to Report", "Not Available"

# id -> measure code, discharges, excess ratio, predicted, expected, readmissions
READMISSIONS = {
    "010001": [
        ("READM-30-HF-HRRP", 487, "0.9823", "21.2", "21.6", 103),
        ("READM-30-AMI-HRRP", 312, "1.0245", "14.8", "14.5", 46),
        ("READM-30-PN-HRRP", 623, "0.9512", "16.4", "17.2", 102),
        ("READM-30-COPD-HRRP", 289, "1.0678", "20.1", "18.8", 58),
    ],
    "010005": [
        ("READM-30-HF-HRRP", 298, "0.8934", "19.8", "22.2", 59),
        ("READM-30-AMI-HRRP", 189, "0.9123", "13.4", "14.7", 25),
        ("READM-30-PN-HRRP", 445, "0.8756", "15.1", "17.2", 67),
        ("READM-30-COPD-HRRP", 176, "0.9234", "17.6", "19.1", 31),
    ],
    "010007": [
        ("READM-30-HF-HRRP", FEW, NOT_AVAILABLE, NOT_AVAILABLE, NOT_AVAILABLE, FEW),
        ("READM-30-PN-HRRP", 156, "1.1823", "19.8", "16.7", 31),
    ],
    "060001": [
        ("READM-30-HF-HRRP", 2341, "0.8102", "17.2", "21.2", 403),
        ("READM-30-AMI-HRRP", 1876, "0.7834", "11.4", "14.6", 214),
        ("READM-30-PN-HRRP", 1543, "0.7923", "13.2", "16.7", 204),
        ("READM-30-COPD-HRRP", 987, "0.8234", "15.8", "19.2", 156),
        ("READM-30-HIP-KNEE", 3456, "0.8012", "4.8", "6.0", 166),
        ("READM-30-CABG", 1234, "0.7645", "10.2", "13.3", 126),
    ],
    "140010": [
        ("READM-30-HF-HRRP", 1987, "0.8634", "18.3", "21.2", 364),
        ("READM-30-AMI-HRRP", 1456, "0.8912", "12.6", "14.1", 184),
        ("READM-30-PN-HRRP", 1876, "0.8723", "14.5", "16.6", 272),
    ],
    "330101": [
        ("READM-30-HF-HRRP", 3456, "0.9523", "20.1", "21.1", 695),
        ("READM-30-AMI-HRRP", 2345, "0.9234", "13.2", "14.3", 310),
    ],
    "050625": [
        ("READM-30-HF-HRRP", 2123, "0.9012", "19.0", "21.1", 403),
        ("READM-30-AMI-HRRP", 1789, "0.8834", "12.5", "14.2", 224),
    ],
    "450639": [
        ("READM-30-HF-HRRP", 1234, "1.0234", "21.6", "21.1", 267),
        ("READM-30-AMI-HRRP", 987, "1.0456", "14.8", "14.2", 146),
    ],
}

# id -> measure, comparison, denominator, score (lower and higher estimates left out)
QUALITY = {
    "010001": [
        ("MORT-30-HF", K.SAME, 487, "12.4"), ("MORT-30-AMI", K.SAME, 312, "13.2"),
        ("MORT-30-PN", K.SAME, 623, "14.8"), ("HAI-1", K.SAME, 156, "0.934"),
        ("HAI-2", K.SAME, 289, "1.024"),
    ],
    "010005": [
        ("MORT-30-HF", K.BETTER, 298, "10.2"), ("MORT-30-PN", K.BETTER, 445, "12.1"),
        ("HAI-1", K.BETTER, 89, "0.621"), ("HAI-5", K.BETTER, 89, "0.534"),
    ],
    "010007": [("MORT-30-HF", K.WORSE, FEW, NOT_AVAILABLE), ("HAI-2", K.WORSE, 76, "1.834")],
    "060001": [
        ("MORT-30-HF", K.BETTER, 2341, "8.4"), ("MORT-30-AMI", K.BETTER, 1876, "9.1"),
        ("MORT-30-PN", K.BETTER, 1543, "10.2"), ("HAI-1", K.BETTER, 876, "0.423"),
        ("HAI-2", K.BETTER, 1234, "0.534"), ("HAI-5", K.BETTER, 543, "0.312"),
    ],
    "140010": [
        ("MORT-30-HF", K.BETTER, 1987, "9.2"), ("MORT-30-AMI", K.BETTER, 1456, "9.8"),
        ("HAI-1", K.BETTER, 712, "0.534"),
    ],
    "330101": [("MORT-30-HF", K.SAME, 3456, "11.8"), ("HAI-2", K.SAME, 1567, "0.912")],
    "050625": [("MORT-30-HF", K.SAME, 2123, "11.2"), ("HAI-3", K.SAME, 678, "0.856")],
    "450639": [("MORT-30-HF", K.SAME, 1234, "12.8"), ("HAI-1", K.WORSE, 432, "1.456")],
}

# id, measure, stars, answer percent, surveys, response rate, end date
SURVEY = [
    (h, m, stars, answer, surveys, "23", end)
    for h, end, base in (("010001", "12/31/2024", 70), ("060001", "12/31/2024", 88), ("060001", "12/31/2023", 80))
    for m, stars, answer, surveys in [
        ("H-COMP-1-A-P", "4", str(base), "512"),
        ("H-COMP-2-A-P", "4", str(base + 1), "512"),
        ("H-COMP-3-A-P", "3", str(base + 2), "512"),
        ("H-COMP-5-A-P", NOT_AVAILABLE, NOT_AVAILABLE, FEW),
        ("H-CLEAN-HSP-A-P", "3", str(base - 5), "512"),
        ("H-QUIET-HSP-A-P", "3", str(base - 10), "512"),
        ("H-HSP-RATING-9-10", "3" if base < 75 else "5", str(base + 4), "600"),
        ("H-RECMND-DY", "4", str(base + 5), "600"),
        ("H-UNKNOWN", "1", "1", "1"),
    ]
]


def _frame(spark, schema, records):
    """Records as staging text, columns not given being NULL."""
    rows = [
        tuple(
            r.get(f.name) if f.dataType.typeName() == "integer" or r.get(f.name) is None
            else str(r[f.name])
            for f in schema.fields
        )
        for r in records
    ]
    loaded = F.to_timestamp(F.lit("2024-10-01 00:00:00"))
    return spark.createDataFrame(rows, schema).withColumn("raw_load_ts", loaded)


def staged_hospitals(spark):
    return _frame(
        spark,
        HOSPITAL_FILE,
        [
            {
                "facility_id": i, "facility_name": f"HOSPITAL {i} ", "city": city, "state": state,
                "county_name": "SAINT CLAIR", "hospital_type": kind, "hospital_ownership": "Private",
                "emergency_services": "Yes", "hospital_overall_rating": rating,
                "mortality_group": "Same", "safety_group": "Same", "readmission_group": "Same",
                "patient_exp_group": "Same",
            }
            for i, city, state, kind, rating in HOSPITALS
        ],
    )


def staged_readmissions(spark):
    return _frame(
        spark,
        READMISSION_FILE,
        [
            {
                "facility_id": i, "measure_name": m, "number_of_discharges": d,
                "excess_readmission_ratio": x, "predicted_readmission_rate": p,
                "expected_readmission_rate": e, "number_of_readmissions": n,
                "start_date": "07/01/2021", "end_date": "06/30/2024",
            }
            for i, found in READMISSIONS.items()
            for m, d, x, p, e, n in found
        ],
    )


def staged_quality(spark):
    return _frame(
        spark,
        QUALITY_FILE,
        [
            {
                "facility_id": i, "condition": "any", "measure_id": m, "compared_to_national": label,
                "denominator": d, "score": score,
                "start_date": "01/01/2023" if m.startswith("HAI") else "07/01/2021",
                "end_date": "12/31/2023" if m.startswith("HAI") else "06/30/2024",
            }
            for i, found in QUALITY.items()
            for m, label, d, score in found
        ],
    )


def staged_survey(spark, records=SURVEY):
    return _frame(
        spark,
        SURVEY_FILE,
        [
            {
                "facility_id": i, "hcahps_measure_id": m, "patient_survey_star_rating": stars,
                "hcahps_answer_percent": answer, "number_of_completed_surveys": surveys,
                "survey_response_rate_percent": rate, "start_date": end, "end_date": end,
            }
            for i, m, stars, answer, surveys, rate, end in records
        ],
    )


def loaded_star(spark, survey=(), match_ids=False):
    hospitals = dimensions.clean_hospitals(staged_hospitals(spark))
    measures = dimensions.load_measures(spark)
    return Star(
        hospitals=hospitals,
        measures=measures,
        dates=date_dimension(spark),
        readmissions=facts.load_readmissions(
            staged_readmissions(spark), hospitals, measures, match_ids
        ).cache(),
        satisfaction=facts.load_satisfaction(
            staged_survey(spark, list(survey)), hospitals, measures
        ).cache(),
        quality=facts.load_quality(staged_quality(spark), hospitals, measures).cache(),
    )
