"""Fixed values.

Every value here must equal the published behaviour for results to agree:
identifiers, word lists, lookup tables, thresholds, patterns and formats.
"""

# --- enumerations -----------------------------------------------------------
PASS, FAIL, INFO, NOT_APPLICABLE = "PASS", "FAIL", "INFO", "NOT_APPLICABLE"
FACTORS = ["MRZ_VALIDATION", "TAMPER", "FACE", "CONSISTENCY", "WATCHLIST", "IDENTITY"]
TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
STATUS_RANK = {"FAIL": 0, "INFO": 1, "PASS": 2, "NOT_APPLICABLE": 3}

# --- document types and their issuer markers, in matching order --------------
DOCUMENT_MARKERS = {
    "AADHAAR": ["AADHAAR", "UIDAI", "UNIQUE IDENTIFICATION AUTHORITY", "ENROLMENT"],
    "PAN": ["INCOME TAX DEPARTMENT", "PERMANENT ACCOUNT NUMBER"],
    "DRIVING_LICENSE": ["DRIVING LICENCE", "DRIVING LICENSE", "TRANSPORT DEPARTMENT"],
    "VOTER_ID": ["ELECTION COMMISSION OF INDIA", "ELECTORS PHOTO IDENTITY CARD", "EPIC NO"],
    "VISA": ["ENTRY VISA", "BUREAU OF IMMIGRATION"],
    "PERMIT": ["RESIDENCE PERMIT", "WORK PERMIT", "ENTRY PERMIT", "TRANSIT PERMIT"],
}
DEFAULT_DOCUMENT_TYPE = "PASSPORT"
NON_MRZ_TYPES = ["AADHAAR", "PAN", "DRIVING_LICENSE", "VOTER_ID", "VISA", "PERMIT"]
INDIAN_TYPES = ["AADHAAR", "PAN", "DRIVING_LICENSE", "VOTER_ID"]
UTOPIAN_TYPES = ["VISA", "PERMIT"]

# --- text patterns ------------------------------------------------------------
DATE_PATTERN = r"(\d{1,2})\D{0,2}(\d{1,2})\D{0,2}(\d{4})"
AADHAAR_CLUSTER = r"(?<![\d/])\d(?:\s?\d){8,19}(?![\d/])"
PAN_PATTERN = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
LICENCE_PATTERN = r"\b([A-Z]{2})[\s-]?(\d{2})[\s-]?(\d{4})[\s-]?(\d{7})\b"
VOTER_PATTERN = r"\b([A-Z]{3}[0-9]{7})\b"
PASSPORT_PATTERN = r"\b([A-Z]{1,2}\d{7,8})\b"
AADHAAR_BOILERPLATE = [
    "GOVERNMENT", "UNIQUE", "IDENTIFICATION", "AUTHORITY", "AADHAAR", "ENROLMENT", "UIDAI",
]
PASSPORT_BOILERPLATE = ["PASSPORT", "REPUBLIC", "DEMO", "TRAVEL", "DOCUMENT"]

# --- MRZ (ICAO 9303) ----------------------------------------------------------
MRZ_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER_TO_DIGIT = ("ODQILZSB<", "000112580")
DIGIT_TO_LETTER = ("01258", "OIZSB")
CHECKSUM_FIELDS = [
    "Document Number Checksum",
    "Date of Birth Checksum",
    "Expiry Date Checksum",
    "Composite Checksum",
]
CENTURY_PIVOT = 45

# --- document rules -----------------------------------------------------------
PAN_ENTITY_CODES = {
    "P": "Individual",
    "C": "Company",
    "H": "Hindu Undivided Family (HUF)",
    "F": "Firm",
    "A": "Association of Persons (AOP)",
    "T": "Trust",
    "B": "Body of Individuals (BOI)",
    "L": "Local Authority",
    "J": "Artificial Juridical Person",
    "G": "Government",
}
VISA_ENTRY_TYPES = ["SINGLE ENTRY", "DOUBLE ENTRY", "MULTIPLE ENTRY", "TRANSIT"]
JURISDICTION_CODES = {
    "REPUBLIC OF UTOPIA": "UTO",
    "DEMO STATE": "DEM",
    "ATLANTIS FEDERATION": "ATL",
    "INDIA": "IND",
    "UNITED KINGDOM": "GBR",
}

# --- forensic and face signals --------------------------------------------------
EXIF_EDITORS = [
    "PHOTOSHOP", "GIMP", "PAINT.NET", "AFFINITY PHOTO", "LIGHTROOM",
    "SNAPSEED", "PIXLR", "CANVA", "PICSART",
]
EXIF_SOFTWARE, EXIF_DATETIME, EXIF_ORIGINAL, EXIF_DIGITIZED = 305, 306, 36867, 36868
EXIF_DATE_FORMAT = "yyyy:MM:dd HH:mm:ss"
ELA_THRESHOLD = 0.22
REGION_THRESHOLD = 0.5
FACE_MATCH_THRESHOLD = 0.72
GALLERY_MATCH_THRESHOLD = 0.80
FREQUENCY_BAND = (0.12, 0.55)
FREQUENCY_TOP_BINS = 8
ARTIFACT_THRESHOLD = 0.25

# --- risk policy defaults --------------------------------------------------------
DEFAULT_POLICY = {
    "weight_mrz": 0.25,
    "weight_tamper": 0.30,
    "weight_face": 0.30,
    "weight_consistency": 0.10,
    "weight_watchlist": 0.05,
    "threshold_low": 24.0,
    "threshold_medium": 49.0,
    "threshold_high": 74.0,
}
RECOMMENDATIONS = {
    "LOW": "CLEAR FOR ENTRY — Routine processing permitted",
    "MEDIUM": "ROUTINE VERIFICATION — Officer visual confirmation recommended",
    "HIGH": "SECONDARY INSPECTION — Multiple document risk indicators detected",
    "CRITICAL": "SUPERVISOR ESCALATION — Significant anomalies requiring physical document review",
}
CASE_STATUS = {
    "LOW": "LOW_RISK",
    "MEDIUM": "MEDIUM_RISK",
    "HIGH": "REQUIRES_REVIEW",
    "CRITICAL": "CRITICAL",
}
BREAKDOWN_FACTORS = [
    "MRZ & Document Validation",
    "Forensic Tamper AI",
    "Biometric Face Verification",
    "Data Consistency Crosscheck",
    "Simulated Watchlist Adapter",
    "Cross-Case Duplicate Identity",
    "Critical Signal Floor",
]

# --- ledger -----------------------------------------------------------------------
GENESIS = "0" * 64
SYSTEM_CASE = "SYSTEM"
LATENCY_STEPS = [
    ("DOCUMENT_UPLOADED", "OCR_COMPLETED", "OCR Extraction"),
    ("OCR_COMPLETED", "MRZ_VALIDATED", "MRZ Checksums"),
    ("MRZ_VALIDATED", "TAMPER_ANALYSIS_COMPLETED", "Tamper AI (ELA)"),
    ("TAMPER_ANALYSIS_COMPLETED", "FACE_VERIFIED", "Face Verification"),
    ("FACE_VERIFIED", "RISK_CALCULATED", "Risk Engine"),
]

# --- lifecycle ----------------------------------------------------------------------
OFFICER_DECISIONS = ["CLEARED", "REQUIRES_INSPECTION", "ESCALATED"]
PURGED_MARKER = "[PURGED_PRIVACY_COMPLIANCE]"
CHANGE_FIELDS = {
    "document_number": ("Document Number", "CRITICAL"),
    "surname": ("Surname", "CRITICAL"),
    "given_names": ("Given Names", "CRITICAL"),
    "birth_date": ("Date of Birth", "HIGH"),
    "expiry_date": ("Date of Expiry", "HIGH"),
    "sex": ("Sex", "MEDIUM"),
    "nationality": ("Nationality", "MEDIUM"),
    "country": ("Issuing Country", "MEDIUM"),
}
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]
MAX_IMAGE_BYTES = 10 * 1024 * 1024
