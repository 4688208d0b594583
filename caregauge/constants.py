"""Texts, codes and cut-offs that results depend on."""

from decimal import Decimal

# Texts that stand for a suppressed number (compared without case).
SUPPRESSED = (
    "N/A",
    "Not Available",
    "Not Applicable",
    "Too Few to Report",
    "Footnote Applies",
    "--",
    "",
)

# Labels of the comparison against the national average.
BETTER = "Better than the National average"
SAME = "No Different than the National average"
WORSE = "Worse than the National average"

# Measure categories.
READMISSION = "Readmission"
MORTALITY = "Mortality"
SAFETY = "Safety"
EXPERIENCE = "Patient Experience"

# Measure seed (id, name, category, higher is better, unit).
MEASURE_SEED = [
    ("READM-30-HF-HRRP", "30-Day Readmission Rate - Heart Failure", READMISSION, False, "%"),
    ("READM-30-AMI-HRRP", "30-Day Readmission Rate - Acute MI", READMISSION, False, "%"),
    ("READM-30-PN-HRRP", "30-Day Readmission Rate - Pneumonia", READMISSION, False, "%"),
    ("READM-30-HIP-KNEE", "30-Day Readmission Rate - Hip/Knee Replacement", READMISSION, False, "%"),
    ("READM-30-CABG", "30-Day Readmission Rate - CABG Surgery", READMISSION, False, "%"),
    ("READM-30-COPD-HRRP", "30-Day Readmission Rate - COPD", READMISSION, False, "%"),
    ("MORT-30-HF", "30-Day Mortality Rate - Heart Failure", MORTALITY, False, "Rate"),
    ("MORT-30-AMI", "30-Day Mortality Rate - Acute MI", MORTALITY, False, "Rate"),
    ("MORT-30-PN", "30-Day Mortality Rate - Pneumonia", MORTALITY, False, "Rate"),
    ("MORT-30-CABG", "30-Day Mortality Rate - CABG", MORTALITY, False, "Rate"),
    ("MORT-30-COPD", "30-Day Mortality Rate - COPD", MORTALITY, False, "Rate"),
    ("HAI-1", "Central Line-Associated Bloodstream Infection", SAFETY, False, "Rate"),
    ("HAI-2", "Catheter-Associated Urinary Tract Infection", SAFETY, False, "Rate"),
    ("HAI-3", "Surgical Site Infection - Colon Surgery", SAFETY, False, "Rate"),
    ("HAI-4", "Surgical Site Infection - Abdominal Hysterectomy", SAFETY, False, "Rate"),
    ("HAI-5", "MRSA Bacteremia", SAFETY, False, "Rate"),
    ("HAI-6", "Clostridioides difficile Infection", SAFETY, False, "Rate"),
    ("H-COMP-1-A-P", "Communication with Nurses - Always", EXPERIENCE, True, "%"),
    ("H-COMP-2-A-P", "Communication with Doctors - Always", EXPERIENCE, True, "%"),
    ("H-COMP-3-A-P", "Responsiveness of Hospital Staff - Always", EXPERIENCE, True, "%"),
    ("H-COMP-5-A-P", "Communication about Medicines - Always", EXPERIENCE, True, "%"),
    ("H-CLEAN-HSP-A-P", "Cleanliness of Hospital Environment - Always", EXPERIENCE, True, "%"),
    ("H-QUIET-HSP-A-P", "Quietness of Hospital Environment - Always", EXPERIENCE, True, "%"),
    ("H-HSP-RATING-9-10", "Overall Hospital Rating 9-10", EXPERIENCE, True, "%"),
    ("H-RECMND-DY", "Would Recommend Hospital - Definitely Yes", EXPERIENCE, True, "%"),
]

# Survey measures with a role of their own.
OVERALL_RATING = "H-HSP-RATING-9-10"
RECOMMEND = "H-RECMND-DY"
COMMUNICATION = ("H-COMP-1-A-P", "H-COMP-2-A-P", "H-COMP-3-A-P", "H-COMP-5-A-P")
ENVIRONMENT = ("H-CLEAN-HSP-A-P", "H-QUIET-HSP-A-P")
DOMAINS = COMMUNICATION + ENVIRONMENT

# Output column -> measure id of the two outcome tables.
MORTALITY_COLUMNS = {
    "mort_heart_failure": "MORT-30-HF",
    "mort_acute_mi": "MORT-30-AMI",
    "mort_pneumonia": "MORT-30-PN",
    "mort_copd": "MORT-30-COPD",
    "mort_cabg": "MORT-30-CABG",
}
INFECTION_COLUMNS = {
    "clabsi_sir": "HAI-1",
    "cauti_sir": "HAI-2",
    "ssi_colon_sir": "HAI-3",
    "ssi_hysterectomy_sir": "HAI-4",
    "mrsa_sir": "HAI-5",
    "cdiff_sir": "HAI-6",
}

# Ordered keyword rules (keywords, label); the first hit wins.
CATEGORY_RULES = [
    (("Heart Failure",), "Heart Failure"),
    (("Acute Myocardial", "Heart Attack"), "Acute MI"),
    (("Pneumonia",), "Pneumonia"),
    (("Hip", "Knee"), "Orthopaedics"),
    (("CABG", "Bypass"), "Cardiac Surgery"),
    (("COPD", "Pulmonary"), "Pulmonary"),
]
# The trend view knows neither "Bypass" nor "Pulmonary".
CATEGORY_RULES_SHORT = CATEGORY_RULES[:4] + [
    (("CABG",), "Cardiac Surgery"),
    (("COPD",), "Pulmonary"),
]
# The seed says "Acute MI", which no rule above finds; this list does.
CATEGORY_RULES_CORRECTED = [
    (words + ("Acute MI",), label) if label == "Acute MI" else (words, label)
    for words, label in CATEGORY_RULES
]
CATEGORIES = [label for _, label in CATEGORY_RULES] + ["Other"]
MEASURE_ID_RULES = [
    (("Heart Failure",), "READM-30-HF-HRRP"),
    (("Acute Myocardial", "Heart Attack"), "READM-30-AMI-HRRP"),
    (("Pneumonia",), "READM-30-PN-HRRP"),
    (("Hip", "Knee"), "READM-30-HIP-KNEE"),
    (("CABG", "Bypass"), "READM-30-CABG"),
    (("COPD", "Pulmonary"), "READM-30-COPD-HRRP"),
]

# Volume tiers by descending threshold, and the rest.
VOLUME_TIERS = [(10000, "High Volume"), (5000, "Mid Volume"), (1000, "Low-Mid Volume")]
VOLUME_REST = "Low Volume"

# Performance tier labels.
TOP, ABOVE, AVERAGE, BELOW, NO_DATA = (
    "Top Performer",
    "Above Average",
    "Average",
    "Below Average",
    "Insufficient Data",
)

# Fixed value: average stay in days behind the bed-day estimate.
BED_DAYS_PER_READMISSION = Decimal("4.6")

# Calendar covered by the date dimension.
CALENDAR_START = "2019-01-01"
CALENDAR_END = "2026-12-31"
