"""Dictionaries.

Every operator takes its dictionary as an argument; nothing below is read
implicitly.  Two kinds live here:

* reference dictionaries small enough to state as fixed values (themes, news
  sites, acronyms);
* binding dictionaries of our own, used by the registered queries over the
  driver's test tables (the news words of the reference do not occur there).

Larger reference dictionaries (the 282 place names and the 335 headline
patterns of the current profile) are data: load them with
:func:`load_dictionary` from a JSON file the user supplies.
"""

from __future__ import annotations

import json
from pathlib import Path

# ---------------------------------------------------------------------------
# These must equal the reference's dictionaries for right
# results.  Stated verbatim, in the reference's order.
# ---------------------------------------------------------------------------

CRIME_THEMES = (
    'CRIME', 'VIOLENCE', 'POLICE', 'LAW_ENFORCEMENT', 'SECURITY', 'ASSAULT', 'MURDER',
    'HOMICIDE', 'SHOOTING', 'STABBING', 'KIDNAPPING', 'ROBBERY', 'BURGLARY', 'ARSON', 'ARREST',
    'RAID', 'INVESTIGATION', 'SECURITY_FORCES', 'TERROR', 'EXTREMISM', 'BOMBING', 'EXPLOSION',
    'COURT', 'TRIAL', 'SENTENCING', 'PROSECUTION', 'JUDICIARY', 'PUBLIC_SAFETY',
    'EMERGENCY_SERVICES', 'FIRE_DEPARTMENT', 'VIOLENT_CRIME', 'GANG_VIOLENCE',
    'ORGANIZED_CRIME', 'CARTELS', 'DRUG_VIOLENCE', 'SEXUAL_VIOLENCE', 'DOMESTIC_VIOLENCE',
    'HATE_CRIME', 'RACIAL_VIOLENCE', 'ETHNIC_VIOLENCE', 'WEAPONS', 'GUN_VIOLENCE',
    'ILLEGAL_WEAPONS', 'ARMS_TRAFFICKING', 'DRUG_TRAFFICKING', 'NARCOTICS', 'HUMAN_TRAFFICKING',
    'SMUGGLING', 'SEX_TRAFFICKING', 'CYBERCRIME', 'CYBER_ATTACK', 'HACKING', 'DATA_BREACH',
    'RANSOMWARE', 'LAW_CRIME', 'CRIMINAL_JUSTICE', 'PRISON', 'INCARCERATION', 'DETENTION',
    'FORENSICS', 'LEGAL_ACTION', 'JUDICIAL_PROCESS', 'RIOT', 'UNREST', 'CIVIL_DISORDER',
    'PROTEST_VIOLENCE', 'NATIONAL_SECURITY', 'PUBLIC_ORDER', 'THREAT', 'RISK', 'INSURGENCY',
    'MILITANCY', 'FIRST_RESPONDERS', 'MEDICAL_EMERGENCY', 'DISASTER_RESPONSE', 'FRAUD',
    'CORRUPTION', 'MONEY_LAUNDERING', 'BRIBERY', 'FINANCIAL_CRIME', 'ABUSE', 'HARASSMENT',
    'SEX_OFFENSES', 'CHILD_ABUSE', 'ELDER_ABUSE', 'EXPLOITATION', 'MISCONDUCT',
    'SECURITY_SERVICES', 'TAX_FNCACT_POLICE', 'TAX_FNCACT_OFFICERS', 'TAX_FNCACT_DETECTIVES',
    'TAX_FNCACT_INSPECTOR', 'TAX_FNCACT_MAGISTRATES', 'TAX_FNCACT_VICTIM', 'TAX_FNCACT_KILLER',
    'WB_840_JUSTICE', 'WB_1014_CRIMINAL_JUSTICE', 'SOC_GENERALCRIME', 'CRISISLEX_T02_INJURED',
    'CRISISLEX_T03_DEAD', 'WOUND', 'KILL', 'WB_1428_INJURY', 'WB_2433_CONFLICT_AND_VIOLENCE',
    'WB_2432_FRAGILITY_CONFLICT_AND_VIOLENCE', 'UNGP_CRIME_VIOLENCE',
    'MANMADE_DISASTER_IMPLIED', 'SEIZE', 'BAN', 'CRISISLEX_C07_SAFETY',
)

UK_SITES = (
    'ALJAZEERA.COM', 'BANBURYGUARDIAN.CO.UK', 'BARKINGANDDAGENHAMPOST.CO.UK', 'BBC.CO.UK',
    'BECKHILLADVERTISER.NET', 'BEXLEYTIMES.CO.UK', 'BIGGIN-HILL-TODAY.CO.UK',
    'BOREHAMWOODTIMES.CO.UK', 'BROMLEYTIMES.CO.UK', 'BUZZFEEDNEWS.COM', 'CAMDENNEWJOURNAL.COM',
    'CNN.COM', 'CROYDONGUARDIAN.CO.UK', 'EALINGGAZETTE.CO.UK', 'EALINGTIMES.CO.UK',
    'EASTLONDONADVERTISER.CO.UK', 'ENFIELDINDEPENDENT.CO.UK', 'EPSOMGUARDIAN.CO.UK', 'FT.COM',
    'FULHAMCHRONICLE.CO.UK', 'GBNEWS.COM', 'GETSURREY.CO.UK', 'GOOGLE.NEWS.COM',
    'GUARDIAN-SERIES.CO.UK', 'HAMHIGH.CO.UK', 'HARLOWTIMES.CO.UK', 'HARINGEYINDEPENDENT.CO.UK',
    'HILLINGDONTIMES.CO.UK', 'HUFFPOST.COM', 'ILFORDRECORDER.CO.UK', 'INDEPENDENT.CO.UK',
    'ISLINGTONGAZETTE.CO.UK', 'ITV.COM/NEWS', 'KILBURNTIMES.CO.UK', 'KINGSTONGUARDIAN.CO.UK',
    'LADBIBLE.COM', 'METRO.CO.UK', 'MIRROR.CO.UK', 'MSN.COM', 'NEWHAMRECORDER.CO.UK',
    'NEWS.GOOGLE.COM', 'NEWS.SKY.COM', 'NEWS.YAHOO.COM', 'NEWSSHOPPER.CO.UK',
    'RICHMONDANDTWICKENHAMTIMES.CO.UK', 'ROMFORDRECORDER.CO.UK', 'SURREYCOMET.CO.UK',
    'SUTTONGUARDIAN.CO.UK', 'TELEGRAPH.CO.UK', 'THEGUARDIAN.COM', 'THESUN.CO.UK',
    'THETIMES.CO.UK', 'THISISCROYDONTODAY.CO.UK', 'TIMES-SERIES.CO.UK',
    'TOTTENHAMJOURNAL.CO.UK', 'UXBRIDGEGAZETTE.CO.UK', 'WANDSWORTHGUARDIAN.CO.UK',
    'WESTENDEXTRA.COM', 'WIMBLEDONGUARDIAN.CO.UK', 'YELLOWADVERTISER-TODAY.CO.UK',
    'YOURLOCALGUARDIAN.CO.UK',
)

ACRONYMS_LIST = (
    'uk', 'us', 'eu', 'un', 'uae', 'nato', 'covid', 'covid-19', 'nhs', 'bbc', 'nyc', 'lgbt',
    'lgbtq', 'met', 'g7', 'g20', 'pm', 'mp', 'mps', 'tory', 'lab', 'labour', 'snp', 'dup',
    'uup', 'pla', 'gov', 'dwp', 'hmrc', 'moj', 'mod', 'hoc', 'hol', 'nca', 'sfo', 'cps', 'npcc',
    'psni', 'btp', 'tfl', 'dlr', 'm25', 'a40', 'a406', 'a1m', 'm1', 'm4', 'm11', 'lhr', 'lgw',
    'ltn', 'stn', 'city', 'heathrow', 'gatwick', 'sky', 'itv', 'cnn', 'ft', 'nyt', 'ai', 'vr',
    '5g', 'cctv', 'asbo', 'foi', 'sos', '999', 'who', 'wto', 'imf', 'opec', 'gaza', 'isis',
    'idf', 'ukip', 'brexit', 'covid19', 'covid-19', 'fifa', 'uefa', 'pr', 'hr', 'ceo', 'cfo',
    'ngo',
)

ACRONYMS = frozenset(ACRONYMS_LIST)

# ---------------------------------------------------------------------------
# Binding dictionaries (ours) for the driver tables.
# ---------------------------------------------------------------------------

#: sources kept by ``filter_source`` over ``documents.source`` (upper-cased)
BINDING_SITES = ("SRC1", "SRC2", "SRC3", "SRC5", "SRC8", "SRC13", "SRC17")

#: themes over the word tokens of ``documents.text``; nested entries
#: (``THE`` inside ``THER``/``OTHER``) exercise the double count of F6
BINDING_THEMES = ("THE", "OF", "AND", "THAT", "TION", "THER", "ERTH", "DER", "QUE", "ING")

#: place-like terms matched as whole words in upper-cased ``documents.text``;
#: multi-word entries overlap single ones and ``THE`` is listed twice, so it
#: counts double, as repeated place names do in the reference
BINDING_LOCATIONS = ("THE", "OF THE", "AND", "DER", "DIE", "LA", "DE LA", "THE", "QUE",
                     "EN", "CI", "IT IS", "IS", "UND", "DES")

#: headline categories over ``part.p_name`` (article headlines); ``\bSmall\b``
#: has an upper-case letter, so like one reference entry it never matches the
#: lower-cased headline but does count once lower-cased in the keyword count
BINDING_HEADLINE_CATEGORIES = {
    "METAL": (r"\bbolt\b", r"\brod\b", r"\banvil\b"),
    "ROTARY": (r"\bgear\b", r"\bring\b", r"\bwidget\b"),
    "COLOUR": (r"\bred\b", r"\bblue\b"),
    "TEMPERATURE": (r"\bhot\b", r"\bcold\b", r"\bhot rod\b"),
    "AGE": (r"\bnew\b", r"\bold\b", r"\bold gear\b"),
    "SIZE": (r"\bSmall\b", r"\blarge\b"),
}

#: categories over lower-cased ``documents.text`` (long multilingual texts)
BINDING_TEXT_CATEGORIES = {
    "ENGLISH": (r"\bthe\b", r"\band\b", r"\bof the\b"),
    "FRENCH": (r"\bla\b", r"\bdes\b", r"\bque\b"),
    "GERMAN": (r"\bder\b", r"\bund\b", r"\bdie\b"),
    "SPANISH": (r"\bel\b", r"\blos\b", r"\bde la\b"),
    "RARE": (r"\bthoroughly\b",),
}

#: acronyms for the url-slug headline over ``pages.url`` paths
BINDING_ACRONYMS = frozenset({"en", "fr", "de", "es", "html"})


def load_dictionary(path: str | Path) -> dict:
    """Load a user dictionary file (JSON).

    Accepted shapes: ``{"terms": [...]}`` for term lists (repeats kept: they
    count with their multiplicity) or ``{"categories": {name: [regex, ...]}}``
    for headline categories (order kept).
    """
    with open(path, encoding="utf-8") as fh:
        data = json.load(fh)
    if not isinstance(data, dict) or not ({"terms", "categories"} & set(data)):
        raise ValueError(f"{path}: expected a 'terms' list or a 'categories' mapping")
    return data
