"""Fixed values that results depend on, as plain literals."""

# Legal forms, honorifics and fillers that are no part of a core name.
NAME_STOP = [
    "inc", "incorporated", "llc", "ltd", "limited", "pvt", "private", "corp", "corporation", "co", "company", "llp", "lp",
    "pllc", "plc", "pc", "the", "dr", "mr", "mrs", "ms", "smt", "shri", "sri", "m", "s", "sarl", "sas", "sasu", "eurl", "sa",
    "sci", "eirl", "snc", "and", "of", "lnc", "l",
]

# Phrases that introduce another name of the same entity; a longer one stands before one it begins with.
ALIAS_WORDS = [
    "doing business as", "d/b/a", "dba", "also known as", "a/k/a", "aka", "formerly known as", "formerly", "f/k/a", "fka",
    "nee", "trading as", "t/a",
]

# Ends of web addresses that are no part of a core name.
TOP_DOMAINS = [
    "com", "net", "org", "in", "co", "biz", "info", "fr", "us",
]

# Patterns of a record number in a name, and of a street after its number (without or with one letter between).
RECORD_NUMBER = r"\(\s*id\s*:?\s*\p{Nd}+\s*\)"
STREET = r"\p{Nd}+[a-z]?\s+(?:[a-z]\s+)?(\p{L}{2,})"

# Address words and what they become; an empty one is dropped.
ADDRESS_CANON = {
    "street": "st", "str": "st", "saint": "st", "road": "rd", "avenue": "ave", "av": "ave", "drive": "dr", "lane": "ln",
    "court": "ct", "place": "pl", "boulevard": "blvd", "bd": "blvd", "bld": "blvd", "circle": "cir", "highway": "hwy",
    "parkway": "pkwy", "terrace": "ter", "trail": "trl", "square": "sq", "apartment": "apt", "suite": "ste", "north": "n",
    "south": "s", "east": "e", "west": "w", "mount": "mt", "fort": "ft", "number": "no", "sector": "sec", "plot": "plt",
    "building": "bldg", "floor": "fl", "rue": "r", "allee": "all", "route": "rte", "chemin": "ch", "impasse": "imp",
    "cours": "crs", "city": "", "town": "", "of": "", "village": "", "null": "", "na": "", "n/a": "",
}

# Legal suffixes and their short forms.
LEGAL_CANON = {
    "pvt": "pvt", "private": "pvt", "ltd": "ltd", "limited": "ltd", "corp": "corp", "corporation": "corp", "inc": "inc",
    "incorporated": "inc", "llc": "llc", "llp": "llp",
}

# Words too common to find candidates by.
GENERIC_WORDS = [
    "limited", "llc", "private", "inc", "ltd", "com", "center", "pvt", "services", "corp", "group", "india", "holdings", "care",
    "associates", "llp",
]

# Abbreviations in names and what they stand for.
NAME_EXPAND = {
    "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company", "grp": "group", "pvt": "private",
    "assocs": "associates", "llc": "limited liability company", "llp": "limited liability partnership", "prop": "proprietor",
    "proprietorship": "proprietorship", "sa": "societe anonyme", "sarl": "societe a responsabilite limitee",
    "sasu": "societe par actions simplifiee unipersonnelle", "sas": "societe par actions simplifiee",
    "eurl": "entreprise unipersonnelle a responsabilite limitee", "sci": "societe civile immobiliere",
    "snc": "societe en nom collectif", "gie": "groupement d interet economique", "ste": "societe", "assoc": "association",
    "gmbh": "gesellschaft mit beschrankter haftung",
}

# Abbreviations in addresses and what they stand for.
ADDRESS_EXPAND = {
    "st": "street", "rd": "road", "ave": "avenue", "dr": "drive", "ln": "lane", "apt": "apartment", "ste": "suite",
    "fl": "floor", "no": "number", "blvd": "boulevard", "ct": "court", "pl": "place", "sq": "square", "hwy": "highway",
    "pkwy": "parkway", "opp": "opposite", "near": "near", "hno": "house number", "bd": "boulevard", "av": "avenue",
    "imp": "impasse", "rte": "route", "all": "allee", "che": "chemin", "bat": "batiment", "etg": "etage", "res": "residence",
    "bis": "bis",
}

# Words of a French street line that do not name the street.
FRENCH_SKIP = [
    "rue", "r", "avenue", "av", "ave", "allee", "all", "boulevard", "bd", "blvd", "place", "pl", "chemin", "ch", "impasse",
    "imp", "route", "rte", "cours", "crs", "quai", "square", "sq", "passage", "sentier", "ruelle", "residence", "res", "rond",
    "point", "voie", "cite", "lotissement", "lot", "hameau", "parc", "promenade", "esplanade", "faubourg", "fg", "bis", "ter",
    "quater", "de", "du", "des", "la", "le", "les", "l", "d", "et", "saint", "st", "ste",
]

# First words that are passed over.
FIRST_WORD_STOP = [
    "the", "a", "an", "mr", "shri", "mrs", "ms",
]

# Words of a French street line that say what kind of street it is, and what may stand before its number.
FRENCH_TYPES = [
    "rue", "r", "avenue", "av", "ave", "allee", "all", "boulevard", "bd", "blvd", "place", "pl", "chemin", "ch", "impasse",
    "imp", "route", "rte", "cours", "crs", "quai", "square", "sq", "passage", "sentier", "ruelle", "residence", "res", "rond",
    "voie", "cite", "lotissement", "lot", "hameau", "parc", "promenade", "esplanade", "faubourg", "fg",
]
FRENCH_NUMBER = ["n", "no", "nd"]

# Words of a place that do not name it.
PLACE_WORDS = ["city", "town", "village", "township", "twp", "of", "cdp", "cpd"]
