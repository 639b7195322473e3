"""Types, label maps and lexicons of the redaction engine."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("engines", T.ArrayType(T.StringType())),
])
GOLD = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])
DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gold", T.ArrayType(GOLD)), T.StructField("is_dup", T.BooleanType()),
    T.StructField("dup_kind", T.StringType()), T.StructField("src_id", T.StringType()), T.StructField("source", T.StringType()),
])

# The entity types and the names by which other corpora call them.
FINANCE_TYPES = ("ACCOUNT_NUMBER", "ADDRESS", "CREDIT_CARD", "DOB", "EMAIL", "IBAN", "PERSON", "PHONE", "SSN")
CANONICAL_TYPES = (*FINANCE_TYPES, "INSURANCE_ID", "MRN")
CHECKSUMMED_TYPES = ("CREDIT_CARD", "IBAN")
GRETEL_LABELS = {
    "name": "PERSON", "first_name": "PERSON", "last_name": "PERSON", "middle_name": "PERSON", "customer_id": "ACCOUNT_NUMBER", "account_number": "ACCOUNT_NUMBER",
    "bank_account_number": "ACCOUNT_NUMBER", "iban": "IBAN", "credit_card_number": "CREDIT_CARD", "credit_debit_number": "CREDIT_CARD", "email": "EMAIL", "phone_number": "PHONE",
    "street_address": "ADDRESS", "date_of_birth": "DOB", "ssn": "SSN", "national_id": "SSN",
}
NEMOTRON_LABELS = {
    "PERSON": "PERSON", "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON", "EMAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "PHONE": "PHONE", "STREET_ADDRESS": "ADDRESS",
    "ADDRESS": "ADDRESS", "DATE_OF_BIRTH": "DOB", "DOB": "DOB", "SSN": "SSN", "IBAN": "IBAN", "CREDIT_CARD_NUMBER": "CREDIT_CARD", "CREDIT_DEBIT_CARD": "CREDIT_CARD",
    "ACCOUNT_NUMBER": "ACCOUNT_NUMBER", "BANK_ROUTING_NUMBER": "ACCOUNT_NUMBER",
}
PRESIDIO_LABELS = {
    "PERSON": "PERSON", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "US_SSN": "SSN", "CREDIT_CARD": "CREDIT_CARD", "IBAN_CODE": "IBAN", "US_BANK_NUMBER": "ACCOUNT_NUMBER",
    "DATE_TIME": "DOB", "LOCATION": "ADDRESS",
}

# Lexicons of the person tests.
GIVEN_NAMES = tuple(
    """alex jordan riley casey morgan avery quinn rowan sage ellis harper reese emerson finley skyler dakota peyton kendall marlow tatum greta ingrid katy
    melanie james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen
    nancy lisa margaret betty sandra ashley dorothy kimberly emily donna michelle carol amanda helen anna maria daniel matthew anthony mark donald steven paul
    andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jacob gary nicholas eric stephen jonathan larry justin scott brandon
    benjamin samuel gregory frank alexander raymond patrick jack dennis jerry aayush raghavendra priya rahul ananya arjun kavya rohan divya""".split()
)
SURNAME_SUFFIXES = tuple("son sen berg burg ford field wood worth ton ley man mann stein smith wick well combe bury more hart row dale shaw brook hill lane moor".split())
STOP_WORDS = tuple(
    """the this that these those and or but for with from into under over january february march april may june july august september october november
    december monday tuesday wednesday thursday friday saturday sunday account number identifier report summary statement notice memo bank branch credit debit
    card loan wire transfer payment customer client borrower applicant beneficiary holder compliance risk tier date name address phone email total amount
    balance interest rate term schedule details information safety data sheet product manufacturer contact emergency hazard classification composition
    ingredients first aid measures fire fighting identification toxicity assessment substance harmful""".split()
)
ROLE_WORDS = tuple(
    "mr mrs ms dr prof borrower applicant client customer beneficiary guarantor holder contact cosigner co signer signer payee payer remitter patient physician account compliance officer manager representative".split()
)
# Names of form fields and their types.
FIELDS = {
    "first name": "PERSON", "last name": "PERSON", "middle name": "PERSON", "full name": "PERSON", "name": "PERSON", "customer": "PERSON", "borrower": "PERSON", "client": "PERSON",
    "holder": "PERSON", "email": "EMAIL", "e-mail": "EMAIL", "phone": "PHONE", "phone number": "PHONE", "address": "ADDRESS", "street address": "ADDRESS", "date of birth": "DOB",
    "dob": "DOB", "ssn": "SSN", "social security": "SSN", "social security number": "SSN", "iban": "IBAN", "account number": "ACCOUNT_NUMBER", "account no": "ACCOUNT_NUMBER",
    "account no.": "ACCOUNT_NUMBER", "bank routing number": "ACCOUNT_NUMBER", "card": "CREDIT_CARD", "card number": "CREDIT_CARD", "credit/debit card": "CREDIT_CARD", "credit debit card": "CREDIT_CARD",
}
# Shapes of tokens, their types and scores.
SHAPES = {
    "d-d-d": ("SSN", 0.72), "d/d/d": ("DOB", 0.66), "d-d-d-d": ("DOB", 0.52), "(d)d-d": ("PHONE", 0.70), "d-d": ("PHONE", 0.44), "+dd": ("PHONE", 0.58), "Ud": ("IBAN", 0.60),
    "d": ("ACCOUNT_NUMBER", 0.34), "Ul": ("PERSON", 0.36), "Ul.Ul": ("PERSON", 0.40), "l@l.l": ("EMAIL", 0.74), "l.l@l.l": ("EMAIL", 0.78),
}
# The rule patterns.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
CARD = r"\b(?:\d[ \-]?){12,18}\d\b"
IBAN = r"\b[A-Z]{2}\d{2}[ ]?[A-Z0-9][A-Z0-9 ]{8,32}[A-Z0-9]\b"
SSN_DASHED = r"\b\d{3}-\d{2}-\d{4}\b"
SSN_BARE = r"\b\d{9}\b"
PHONE = r"(?:\+?1[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}\b"
DATE = r"\b(?:\d{1,2}[/\-]\d{1,2}[/\-](?:19|20)\d{2}|(?:19|20)\d{2}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? (?:19|20)\d{2})\b"
ACCOUNT = r"\b\d{8,17}\b"
ADDRESS = r"\b\d{1,5}\s+[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)?\s(?:St|Street|Ave|Avenue|Rd|Road|Ln|Lane|Blvd|Boulevard|Dr|Drive|Ct|Court|Way|Lock|Place|Pl)\b(?:,?\s[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)?,?\s[A-Z]{2}\s\d{5})?"
NAME = r"[A-Z][a-z]+(?:\s[A-Z]\.)?(?:\s[A-Z][a-z]+){1,2}"
HONORIFIC = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s(?:" + NAME + ")"
ROLE = r"(?i:borrower|applicant|client|customer|beneficiary|guarantor|holder|contact|account\s+holder|payee|payer|remitter)\s*[,:]?\s+(?:" + NAME + ")"
CAP_BIGRAM = r"\b[A-Z][a-z]{2,}\s[A-Z][a-z]{2,}\b"
TITLE_RUN = r"\b(?:[A-Z][a-z]{1,15}|[A-Z]\.)(?:\s+(?:[A-Z][a-z]{1,15}|[A-Z]\.)){0,3}\b"
FIELD_KEY = (
    r"first\s*name|last\s*name|middle\s*name|full\s*name|name|customer|borrower|client|holder|email|e-mail|phone(?:\s*number)?|address|street\s*address|date\s*of\s*birth|dob|ssn|"
    r"social\s*security(?:\s*number)?|iban|account\s*(?:number|no\.?)|card(?:\s*number)?|credit[/ ]?debit\s*card|bank\s*routing\s*number"
)
# Words that speak for a type near a match.
CONTEXT = {
    "SSN": "ssn|social security", "PHONE": "phone|tel|call|fax|mobile|contact|cell", "DOB": r"\bdob\b|birth|born", "ACCOUNT_NUMBER": "account|acct|a/c|routing|wire|iban",
}
