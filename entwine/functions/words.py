"""Word tables of the normaliser."""

# Results depend on these words, so they are stated as they must be.
STOPWORDS = (
    "and the of for inc llc ltd limited corp corporation company co private pvt services service "
    "solutions group business center centre enterprise holdings trading international industries partners systems products "
    "sa sas sarl sasu sci eurl et france ste societe"
).split()

GENERIC_ADDRESS_WORDS = (
    "c o so do wo care plot no flat shop h house survey khasra kheta po box pobox suite ste building bldg room "
    "rm floor fl nr near opp opposite behind at post dist district tehsil taluk taluka road rd street st lane ln "
    "avenue ave boulevard blvd drive dr highway hwy court ct nagar colony marg gali sector sec phase block "
    "rue bd chemin route allee place de des du la le les d"
).split()

GENERIC_NAME_WORDS = (
    "hospital clinic center centre church temple express deli store shop care auto motors associates group partners "
    "foundation institute cardiology dental medical health wellness realty properties capital holdings enterprises trading solutions"
).split()

ADDRESS_ALIASES = {
    "st": "street",
    "rd": "road",
    "ave": "avenue",
    "blvd": "boulevard",
    "dr": "drive",
    "ln": "lane",
    "ct": "court",
    "pl": "place",
    "trl": "trail",
    "hwy": "highway",
    "apt": "apartment",
}

WEB_SUFFIXES = ("com", "c0m", "in", "org", "net", "co", "io", "fr")

TRADING_MARKERS = ("trading as", "t/a", "dba", "d/b/a", "doing business as", "formerly known as", "fka", "c/o")

#: What pandas' documented defaults read as missing.
MISSING_MARKS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
