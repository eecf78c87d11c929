"""The taxonomy, its groups, and the patterns of the rule cascade."""

from __future__ import annotations

# --- Fixed values: field types with coarse type (None: outside the benchmark), sensitivity and group. ---
TAXONOMY = {
    "PERSON_NAME": ("PERSON", "HIGH", "SENSITIVE_PII"),
    "ORG_NAME": ("ORG", "MEDIUM", "ENTITY"),
    "LOCATION": (None, "MEDIUM", "ENTITY"),
    "ADDRESS": ("CONTACT_ADR", "HIGH", "SENSITIVE_PII"),
    "DATE_TIME": ("DATE", "MEDIUM", "NUMERIC_FACTUAL"),
    "MONEY": ("AMOUNT", "MEDIUM", "NUMERIC_FACTUAL"),
    "PERCENTAGE": ("AMOUNT", "LOW", "NUMERIC_FACTUAL"),
    "QUANTITY": ("AMOUNT", "LOW", "NUMERIC_FACTUAL"),
    "IDENTIFIER": ("ID", "HIGH", "SENSITIVE_PII"),
    "CONTACT": ("CONTACT_ADR", "HIGH", "SENSITIVE_PII"),
    "DOCUMENT_REFERENCE": ("ID", "LOW", "STRUCTURAL"),
    "TITLE_HEADER": (None, "LOW", "STRUCTURAL"),
    "ROLE_TITLE": (None, "LOW", "ENTITY"),
    "CATEGORY_LABEL": (None, "LOW", "STRUCTURAL"),
    "FREE_TEXT": (None, "LOW", "OPEN_TEXT"),
    "BOOLEAN": (None, "LOW", "OPEN_TEXT"),
    "OTHER": (None, "LOW", "OPEN_TEXT"),
}
DEFAULT_GROUP, DEFAULT_SENSITIVITY = "OPEN_TEXT", "LOW"

# --- Fixed values: other names of labels. ---
LABEL_ALIASES = {
    "DATE": "DATE_TIME", "TIME": "DATE_TIME", "YEAR": "DATE_TIME", "AMOUNT": "MONEY", "NUMBER": "QUANTITY", "NUMERIC": "QUANTITY",
    "PHONE": "CONTACT", "EMAIL": "CONTACT", "FAX": "CONTACT", "PERSON": "PERSON_NAME", "NAME": "PERSON_NAME", "ORG": "ORG_NAME",
    "ORGANIZATION": "ORG_NAME", "PAGE_NUMBER": "DOCUMENT_REFERENCE", "REFERENCE": "DOCUMENT_REFERENCE", "HEADER": "TITLE_HEADER",
    "TITLE": "TITLE_HEADER", "ROLE": "ROLE_TITLE", "CATEGORY": "CATEGORY_LABEL", "TEXT": "FREE_TEXT", "SERVICE_TYPE": "CATEGORY_LABEL",
    "ABBREVIATION": "CATEGORY_LABEL",
}

# --- Fixed values: the closed list of the pilot's language-model answers. ---
PILOT_TYPES = ("DATE", "AMOUNT", "NAME", "ID", "ADDRESS", "PHONE", "ORG", "PERCENTAGE", "REFERENCE", "OTHER")

# --- Fixed values: patterns of answers, in the dialect that Java and RE2 share. ---
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
MONEY = r"(?i)^\s*([\$€£¥₹₽]\s*[\d,]+(?:\.\d+)?|[\d,]+(?:\.\d+)?\s*(usd|eur|gbp|rub|rs\.?|million|billion|thousand|/hour))\s*$"
PERCENT = r"^\s*[+-]?\d+(?:[.,]\d+)?\s*%\s*$"
PHONE = r"^\s*(?:\+?\d[\d\-\(\)\s]{5,}\d|\d{3,5})\s*$"
EMAIL = r"(?i)^[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}$"
URL = r"(?i)^(https?://)?(www\.)?[a-z0-9\-]+\.[a-z]{2,}(/[^\s]*)?$"
DATE_LIKE = (
    r"(?i)^\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}|" + MONTH + r"[a-z]*|" + MONTH + r"[a-z]*\.?\s+\d{1,2}(,\s*\d{2,4})?"
    r"|\d{1,2}\s*(a\.?m\.?|p\.?m\.?)|\d{1,2}:\d{2}\s*(a\.?m\.?|p\.?m\.?)?|\d{4}\s*[~\-–]\s*\d{4})\s*$"
)
NUMERIC = r"^\s*[+-]?\d+(?:[.,]\d+)?\s*$"
#: Together with a digit anywhere.
IDENTIFIER = r"(?i)^\s*[A-Z0-9][A-Z0-9\-/ ]{1,}\s*$"
ZIP = r"^\s*\d{4,10}(?:-\d{4})?\s*$"
CLOCK_OR_DAY = r"\b(am|pm|a\.m\.|p\.m\.)\b|\d{1,2}[:\-]\d{1,2}|[a-z]{3,9}\s+\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"

# --- Fixed values: patterns of questions, by type. ---
QUESTIONS = {
    "DOCUMENT_REFERENCE": [r"\bpage number\b", r"\bpage no\b", r"\bpage mentioned\b", r"\bfigure number\b", r"\btable number\b", r"\bannex\b", r"\bsection number\b", r"\bfootnote number\b"],
    "LOCATION": [r"\bwhich country\b", r"\bfrom which state\b", r"\bwhere are .* from\b", r"\blocated in which country\b", r"\bwhich state\b", r"\bwhich city\b", r"\bclinical center\b", r"\bwhich center\b", r"\bdealer is located\b"],
    "CONTACT": [r"\bphone\b", r"\btelephone\b", r"\bfax\b", r"\bemail\b", r"\bwebsite\b", r"\bvoice mail\b"],
    "ROLE_TITLE": [r"\brole\b", r"\bposition\b", r"\bchairman\b", r"\bpresident\b", r"\bsecretary\b", r"\bconsultant\b", r"\bceo\b", r"\bmanager\b", r"\bvice president\b", r"\bdirector\b"],
    "PERSON_NAME": [r"^\s*who\b", r"\bwhose name\b", r"\bname of a person\b", r"\bclient\b", r"\bsender\b"],
    "ORG_NAME": [r"\bname of the company\b", r"\bname of the bank\b", r"\bname of the university\b", r"\bname of the society\b", r"\bname of the airline\b", r"\bname of the consulting agency\b", r"\badvertising agency\b", r"\bchain corporate\b", r"\bvenue name\b", r"\bfederation\b", r"\bhead quartered\b", r"\bheadquartered\b", r"\borganization\b"],
    "TITLE_HEADER": [r"\bheading\b", r"\btitle of the document\b", r"\btitle of the given\b", r"\btitle of the graph\b", r"\btitle of the bar graph\b", r"\bheading of the table\b", r"\bsubheading\b", r"\bwhat is printed below the logo\b", r"\bwhat is this notice about\b", r"\bwhat type of report is this\b", r"\bjournal of publication\b", r"\bfirst hot issue\b", r"\bsubject of this correspondence\b", r"\bwhat is ['‘\"]?table \d+['’\"]?\b", r"\bwhat is the footnote of\b", r"\by-axis indicate\b", r"\bx-axis\b", r"\btitle in the first rectangle\b", r"\btitle in the last rectangle\b"],
    "ADDRESS": [r"\baddress\b", r"\bstreet\b", r"\bmailing address\b", r"\bzip ?code\b", r"\bzipcode\b"],
    "DATE_TIME": [r"\bwhat date\b", r"\bwhen\b", r"\bwhat year\b", r"\bwhat month\b", r"\btime\b", r"\beffective date\b", r"\bdate mentioned\b", r"\bdate on\b"],
    "MONEY": [r"\bexpense\b", r"\bexpenses\b", r"\bsalary\b", r"\bsalaries\b", r"\bamount paid\b", r"\bfare amount\b", r"\btax amount\b", r"\btotal including tax\b", r"\bsales\b", r"\brevenue\b", r"\bincome\b", r"\bearn(?:ing|ings)?\b", r"\bgross profit\b", r"\bnet profit\b", r"\bbudget\b", r"\bbudgeted\b", r"\bactual salaries\b", r"\bamount incurred\b", r"\bcost\b", r"\btotal intrinsic value\b", r"\bpbt\b", r"\bpat\b"],
    "PERCENTAGE": [r"\bpercentage\b", r"\bshare\b", r"\bpercent\b"],
    "QUANTITY": [r"\bhow many\b", r"\btotal number\b", r"\bpages scanned\b", r"\bnumber of participants\b", r"\byears of experience\b", r"\bnet pounds\b", r"\bpound infeed\b", r"\bpounds out\b", r"\binfeed\b", r"\bout\b", r"\bvolume\b", r"\blocations\b", r"\bcartons\b", r"\bstores\b", r"\bparticipants lost to follow-up\b", r"\bacceptable daily intake\b", r"\bresidue limit\b", r"\bage of\b", r"\by-axis\b"],
    "IDENTIFIER": [r"\baccount number\b", r"\baccount no\b", r"\border number\b", r"\bprocedure note number\b", r"\bchain id\b", r"\bchain id no\b", r"\bvenue code\b", r"\bbox number\b", r"\bqqq number\b", r"\bcode\b", r"\bid\b", r"^\s*what is the [a-z]{2,6}\??\s*$"],
    "CATEGORY_LABEL": [r"\bwhat type of\b", r"\bwhat kind of\b", r"\btype of research\b", r"\bservice provided\b", r"\bstand for\b", r"\bfull form\b", r"\bwhat does .* stand for\b", r"\bpesticide used for\b", r"\btype of mailing\b", r"\bconvenience store\b"],
    "NON_MONEY_NUMERIC": [r"\bnet pounds\b", r"\bpound infeed\b", r"\bpounds out\b", r"\binfeed\b", r"\bout\b", r"\bparticipants\b", r"\bpages scanned\b", r"\byears of experience\b", r"\bvolume\b", r"\blocations\b", r"\bcartons\b", r"\bstores\b", r"\bacceptable daily intake\b", r"\bresidue limit\b", r"\bage of\b", r"\by-axis\b"],
    "NON_MONEY_MEASURE": [r"\binterest rate\b", r"\bcomposite value\b", r"\bproduction\b", r"\bpopulation\b", r"\bbed days\b", r"\bdissolved solids\b", r"\bvitamin\b", r"\bserum\b", r"\bfrequency\b", r"\byield\b", r"\bpurity\b", r"\bvalue on the y axis\b", r"\bvalue on the x axis\b", r"\bhighest value on the y axis\b", r"\bhighest value on the x axis\b", r"\blowest value on the y axis\b", r"\blowest value on the x axis\b", r"\bthickening of conjunctivae\b", r"\bself care bed days\b"],
}
#: Literal parts of a question that also mark it as one for an identifier.
IDENTIFIER_WORDS = ["pageid", "auth. no", "auth no", "invoice no", "voucher no", "promo no", "item#", "item no", "upc"]
#: Words in an answer that show that it is no person.
NO_PERSON = [r"\bmembers?\b", r"\bunion\b", r"\boffice\b", r"\bdepartment\b", r"\bcenter\b", r"\bcommittee\b", r"\bassociation\b", r"\bservices\b", r"\bprogram\b", r"\bstate of\b", r"\buniversity\b", r"\binstitute\b", r"\brestaurant\b", r"\bresort\b", r"\binn\b", r"\bcompany\b", r"\bfoundation\b", r"\bcalifornia\b", r"\bohio\b", r"\bmichigan\b", r"\bcolorado\b", r"\bvirginia\b"]
BOOLEAN_VALUES = ("yes", "no", "true", "false", "y", "n")
SPECIAL_LABELS = ("none", "other", "yes", "no", "suspension", "syrup")
ACCEPT_CONFIDENCE = 0.93

# --- Fixed values: redaction scenarios. ---
OCR_STRATEGIES = ("none", "drop", "mask")
IMAGE_VARIANTS = (("none", None), ("black", None), ("white", None), ("blur", 10.0), ("blur", 20.0), ("blur", 50.0))
CONTEXT_WINDOWS = (0, 20)
MASK_TEXT = "[REDACTED]"
IMAGE_IDS = ("original", "img_none", "img_black", "img_white", "img_blur_10", "img_blur_20", "img_blur_50")
OCR_IDS = ("original", "ocr_none", "ocr_drop_k0", "ocr_drop_k20", "ocr_mask_k0", "ocr_mask_k20")


def fused(patterns: list[str]) -> str:
    """One alternation, so that a text is searched once."""
    return "|".join(patterns)
