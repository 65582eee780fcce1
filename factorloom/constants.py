"""Word lists, lookup tables, formats and thresholds.

Everything in this module must equal the published behaviour for results to
match, so it is stated plainly and kept in one place.
"""

# --- Fixed values: canonical columns ---------------------------------------

CANONICAL_COLUMNS = [
    "entity_id",
    "entity_name",
    "entity_type",
    "ef_value",
    "ef_unit",
    "region",
    "source_dataset",
    "confidence",
    "timestamp",
    "tags",
]

REQUIRED_COLUMNS = CANONICAL_COLUMNS[:8]

STRING_COLUMNS = [
    "entity_id",
    "entity_name",
    "entity_type",
    "ef_unit",
    "region",
    "source_dataset",
    "id",
]

NUMERIC_COLUMNS = ["ef_value", "confidence"]

MERGED_COLUMNS = [
    "entity_id",
    "entity_name",
    "entity_type",
    "ef_value",
    "ef_unit",
    "region",
    "source_dataset",
    "confidence",
    "timestamp",
    "tags",
    "is_outlier",
    "metadata",
    "multiplier_applied",
    "rationale",
    "source_page",
    "id",
]

DUPLICATE_KEYS = ["entity_id", "entity_type", "ef_value", "region", "source_dataset"]

VALID_RECORD_FIELDS = ["entity_id", "entity_name", "ef_value", "ef_unit"]

# --- Fixed values: dataset labels, id prefixes and default confidences ------

SOURCE_LABELS = {
    "product": "Agribalyse_3.1",
    "period": "Climate_TRACE",
    "product_region": "EXIOBASE_3.8",
    "flow": "USEEIO_v2.1",
    "multiplier": "IPCC_AR6",
    "predefined": "IPCC_AR6",
    "factor": "IPCC_EFDB",
    "pathway": "GREET_Model",
    "process": "OpenLCA",
}

DEFAULT_CONFIDENCE = {
    "product": 0.8,
    "product_region": 0.75,
    "flow": 0.7,
    "process": 0.7,
}

MULTIPLIER_ID_PREFIX = "IPCC_AR6_"
PATHWAY_ID_PREFIX = "GREET_"
PROCESS_ID_PREFIX = "OPENLCA_"
PRODUCT_REGION_TAG_PREFIX = "EXIOBASE region:"
MULTIPLIER_METADATA_VERSION = "AR6"

# --- Fixed values: null tokens of delimited text ----------------------------

NULL_TOKENS = ["", "NA", "N/A", "null", "None", "nan", "NaN", "NULL", "n/a"]

# --- Fixed values: header keywords, in the order they are tried -------------

PRODUCT_ROLES = {
    "name": ["product", "name", "nom", "produit"],
    "id": ["code", "id", "lci", "identifiant"],
    "category": ["categor", "group", "type", "classe"],
    "quality": ["quality", "dqr", "score", "qualité"],
    "unit": ["unit", "unité", "mesure"],
    "value": ["climate", "co2", "carbon", "ghg", "emission", "change", "impact"],
}

PRODUCT_REGION_ROLES = {
    "region": ["country", "region", "nation"],
    "product": ["product", "commodity", "sector"],
    "value": ["co2", "ghg", "carbon", "emission", "climate"],
}

FLOW_ROLES = {
    "id": ["code", "sector", "industry", "naics"],
    "name": ["name", "description", "label"],
    "value": ["ghg", "co2", "carbon", "emission", "impact", "factor", "flowamount"],
}

FLOW_SIGNATURE = ["Sector", "Flowable", "FlowAmount"]

# --- Fixed values: file discovery and sanity checks -------------------------

TABLE_FILE_KEYWORDS = ["emission", "ghg", "co2", "carbon"]
TABLE_FILE_SUFFIXES = [".csv", ".txt", ".xlsx"]
FLOW_FILE_KEYWORDS = ["GHG", "emission", "carbon", "import_factor"]
JSON_FILE_KEYWORDS = [
    "process",
    "flow",
    "emission",
    "co2",
    "carbon",
    "ghg",
    "climate",
]
EXCHANGE_FLOW_KEYWORDS = [
    "co2",
    "carbon dioxide",
    "methane",
    "ch4",
    "nitrous oxide",
    "n2o",
    "ghg",
]
TABLE_HEADER_PREFIXES = ["emission", "ghg", "co2", "ch4"]
ENCODINGS = ["utf-8", "latin1", "ISO-8859-1", "cp1252"]
DELIMITERS = [",", ";", "\t"]
SANITY_MIN_COLUMNS = 5
SANITY_MIN_LINES = 1000
SANITY_PREFIX_CHARS = 1000

# --- Fixed values: allowed characters kept by each name-cleaning variant -----

NAME_KEEP = {
    "plain": "",
    "hyphen": "-",
    "hyphen_parens": "-()",
}

# --- Fixed values: units ----------------------------------------------------

BASE_UNIT = "kg CO2e"
BASE_UNIT_PER_KG = "kg CO2e/kg"

# mass word -> kilograms, longest spelling first
EXACT_UNIT_FACTORS = [
    ("Gt CO2e", 1e12),
    ("Mt CO2e", 1e9),
    ("kt CO2e", 1e6),
    ("kg CO2e", 1.0),
    ("g CO2e", 0.001),
    ("t CO2e", 1000.0),
]

PER_KG_FACTORS = {
    "g CO2e/kg": 0.001,
    "ton CO2e/kg": 1000.0,
    "kg CO2e/ton": 0.001,
}

MEGATONNE_IN_KG = 1e9

# --- Fixed values: countries in lookup order --------------------------------

COUNTRY_CODES = {
    "AT": "Austria",
    "BE": "Belgium",
    "BG": "Bulgaria",
    "CY": "Cyprus",
    "CZ": "Czech Republic",
    "DE": "Germany",
    "DK": "Denmark",
    "EE": "Estonia",
    "ES": "Spain",
    "FI": "Finland",
    "FR": "France",
    "GR": "Greece",
    "HR": "Croatia",
    "HU": "Hungary",
    "IE": "Ireland",
    "IT": "Italy",
    "LT": "Lithuania",
    "LU": "Luxembourg",
    "LV": "Latvia",
    "MT": "Malta",
    "NL": "Netherlands",
    "PL": "Poland",
    "PT": "Portugal",
    "RO": "Romania",
    "SE": "Sweden",
    "SI": "Slovenia",
    "SK": "Slovakia",
    "GB": "United Kingdom",
    "US": "United States",
    "JP": "Japan",
    "CN": "China",
    "CA": "Canada",
    "KR": "South Korea",
    "BR": "Brazil",
    "IN": "India",
    "MX": "Mexico",
    "RU": "Russia",
    "AU": "Australia",
    "CH": "Switzerland",
    "TR": "Turkey",
    "TW": "Taiwan",
    "NO": "Norway",
    "ID": "Indonesia",
    "ZA": "South Africa",
    "WA": "RoW Asia and Pacific",
    "WF": "RoW Africa",
    "WL": "RoW America",
    "WM": "RoW Middle East",
    "WE": "RoW Europe",
}

# keywords (any of) -> rest-of-world code, first match wins
REST_OF_WORLD_LADDER = [
    (["ASIA", "PACIFIC"], "WA"),
    (["AFRICA"], "WF"),
    (["AMERICA", "LATIN"], "WL"),
    (["MIDDLE", "EAST"], "WM"),
    (["EUROPE"], "WE"),
]
REST_OF_WORLD_DEFAULT = "ROW"

MULTIPLIER_REGION_CODES = {
    "North America": "NAM",
    "Europe": "EUR",
    "East Asia": "EAS",
    "South Asia": "SAS",
    "Latin America": "LAC",
    "Africa": "AFR",
    "Middle East": "MEA",
    "Oceania": "OCE",
    "Southeast Asia": "SEA",
    "Global": "GLB",
    "United States": "USA",
    "Canada": "CAN",
    "Mexico": "MEX",
    "Brazil": "BRA",
    "European Union": "EUN",
    "United Kingdom": "GBR",
    "Russia": "RUS",
    "China": "CHN",
    "Japan": "JPN",
    "India": "IND",
    "Australia": "AUS",
    "South Africa": "ZAF",
    "Middle East and North Africa": "MENA",
    "Sub-Saharan Africa": "SSA",
    "Least Developed Countries": "LDC",
}

FACTOR_REGION_CODES = {
    "Global": "GLB",
    "Africa": "AFR",
    "Asia": "ASI",
    "Europe": "EUR",
    "North America": "NAM",
    "Oceania": "OCE",
    "South America": "SAM",
}
FACTOR_REGION_DEFAULT = "GLB"

# code, name, continent, economic group
REGION_MAPPING = [
    ("FR", "France", "Europe", "EU"),
    ("DE", "Germany", "Europe", "EU"),
    ("IT", "Italy", "Europe", "EU"),
    ("ES", "Spain", "Europe", "EU"),
    ("GB", "United Kingdom", "Europe", "Non-EU"),
    ("US", "United States", "North America", "NAFTA"),
    ("CA", "Canada", "North America", "NAFTA"),
    ("MX", "Mexico", "North America", "NAFTA"),
    ("CN", "China", "Asia", "BRICS"),
    ("IN", "India", "Asia", "BRICS"),
    ("BR", "Brazil", "South America", "BRICS"),
    ("RU", "Russia", "Europe/Asia", "BRICS"),
    ("ZA", "South Africa", "Africa", "BRICS"),
    ("JP", "Japan", "Asia", "G7"),
    ("AU", "Australia", "Oceania", "G20"),
    ("ID", "Indonesia", "Asia", "G20"),
    ("TR", "Turkey", "Europe/Asia", "G20"),
    ("WA", "Rest of Asia and Pacific", "Asia/Oceania", "ROW"),
    ("WF", "Rest of Africa", "Africa", "ROW"),
    ("WL", "Rest of America", "Americas", "ROW"),
    ("WM", "Rest of Middle East", "Asia", "ROW"),
    ("WE", "Rest of Europe", "Europe", "ROW"),
]

# child, parent, relation
REGION_HIERARCHY = [
    ("USA", "NAM", "COUNTRY_IN_CONTINENT"),
    ("FR", "EUR", "COUNTRY_IN_CONTINENT"),
    ("NAM", "GLB", "CONTINENT_IN_GLOBAL"),
    ("EUR", "GLB", "CONTINENT_IN_GLOBAL"),
    ("ASI", "GLB", "CONTINENT_IN_GLOBAL"),
    ("AFR", "GLB", "CONTINENT_IN_GLOBAL"),
    ("SAM", "GLB", "CONTINENT_IN_GLOBAL"),
    ("OCE", "GLB", "CONTINENT_IN_GLOBAL"),
]

GRAPH_REGION_NAMES = {"USA": "United States", "FR": "France", "GLB": "Global"}
GRAPH_REGION_CONTINENTS = {"USA": "North America", "FR": "Europe", "GLB": "Global"}
GRAPH_SOURCE_URL_PREFIX = "https://example.com/datasets/"

# --- Fixed values: predefined regional multipliers --------------------------

# region, sector, multiplier_factor, rationale, source_page
PREDEFINED_MULTIPLIERS = [
    ("IN", "agriculture", 1.2, "Higher methane emissions from rice cultivation", "IPCC AR6 WG III, Chapter 7"),
    ("IN", "electricity", 1.3, "Coal-dominated energy mix", "IPCC AR6 WG III, Chapter 6"),
    ("CN", "manufacturing", 1.1, "Coal-based industrial processes", "IPCC AR6 WG III, Chapter 11"),
    ("US", "transportation", 1.2, "Higher vehicle miles traveled", "IPCC AR6 WG III, Chapter 10"),
    ("BR", "forestry", 1.4, "Deforestation impacts", "IPCC AR6 WG III, Chapter 7"),
    ("AU", "agriculture", 1.15, "Extensive livestock farming", "IPCC AR6 WG III, Chapter 7"),
    ("ZA", "electricity", 1.25, "Coal-dominated energy mix", "IPCC AR6 WG III, Chapter 6"),
    ("RU", "oil_and_gas", 1.3, "Methane leakage from infrastructure", "IPCC AR6 WG III, Chapter 6"),
    ("ID", "forestry", 1.35, "Peatland conversion", "IPCC AR6 WG III, Chapter 7"),
    ("CA", "oil_and_gas", 1.2, "Oil sands extraction", "IPCC AR6 WG III, Chapter 6"),
]

MULTIPLIER_RANGE = (0.5, 2.0)
RATIONALE_MIN_CHARS = 20
RATIONALE_CONFIDENCE = (0.9, 0.7)
GLOBAL_REGION = "Global"

# sector text contains any keyword -> entity type, first match wins
FACTOR_TYPE_LADDER = [
    (["Energy"], "energy"),
    (["Industrial"], "industrial_process"),
    (["Agriculture", "Forestry"], "agriculture"),
    (["Waste"], "waste"),
]
FACTOR_TYPE_DEFAULT = "other"

# --- Fixed values: statistics -----------------------------------------------

OUTLIER_MIN_VALUES = 10
OUTLIER_Z = 3.0
OUTLIER_Z_GROUPED = 3.5
OUTLIER_IQR_FACTOR = 1.5
CROSSWALK_CONFIDENCE = 0.9
SUMMARY_MIN_REGION_COUNT = 10
VALUE_BANDS = [
    (1.0, "Very Low (<1)"),
    (10.0, "Low (1-10)"),
    (100.0, "Medium (10-100)"),
    (1000.0, "High (100-1000)"),
]
VALUE_BAND_LAST = "Very High (>1000)"

# --- Fixed values: instruction sets -----------------------------------------

FAMILY_SHARES = [
    ("basic_lookup", 0.30),
    ("regional_comparison", 0.25),
    ("multi_entity_analysis", 0.15),
    ("methodological", 0.15),
    ("edge_cases", 0.10),
    ("verification", 0.05),
]
INSTRUCTION_TOTAL = 3000
TRAIN_SHARE = 0.8
TEST_SHARE = 0.1

CONFIDENCE_BANDS = [(0, 30, "low"), (30, 70, "medium"), (70, 100, "high")]

PARAPHRASES = [
    (
        "What is",
        [
            "Can you tell me",
            "I need to know",
            "Please provide",
            "Could you give me information about",
        ],
    ),
    (
        "Compare",
        [
            "What is the difference between",
            "How do",
            "Can you contrast",
            "What's the comparison between",
        ],
    ),
    (
        "How should I",
        [
            "What's the best way to",
            "What is the recommended approach for",
            "How do I",
            "What's the proper method for",
        ],
    ),
    (
        "What are",
        [
            "Could you list",
            "Please identify",
            "Can you enumerate",
            "I need to know about",
        ],
    ),
]

# --- Fixed values: response scoring patterns, tried in order -----------------

NUMBER_PATTERNS = [
    r"(\d+(?:\.\d+)?)\s*kg\s*CO2e",
    r"(\d+(?:\.\d+)?)\s*kg\s*CO2e/kg",
    r"(\d+(?:\.\d+)?)\s*kg\s*CO2e/kWh",
    r"(\d+(?:\.\d+)?)\s*kg\s*CO2e/km",
    r"(\d+(?:\.\d+)?)\s*kg\s*CO2e/USD",
    r"(\d+(?:\.\d+)?)\s*tons?\s*CO2e",
    r"(\d+(?:\.\d+)?)\s*g\s*CO2e",
]
ANY_NUMBER_PATTERN = r"(\d+(?:\.\d+)?)"

SOURCE_LEADS = [
    r"from\s+",
    r"sourced\s+from\s+",
    r"according\s+to\s+",
    r"based\s+on\s+",
    r"source:\s+",
    r"data\s+from\s+",
]

# --- Fixed values: prompt layouts --------------------------------------------

PROMPT_CHAT_OPEN = "<s>[INST] "
PROMPT_CHAT_CLOSE = " [/INST]"
PROMPT_CHAT_END = " </s>"

# --- Fixed values: instruction texts ------------------------------------------
# Named fields in braces are filled from columns.

BASIC_QUESTION = "What is the emission factor for {entity_name} in {region}?"
BASIC_ANSWER = (
    "The emission factor for {entity_name} in {region} is {ef_value} {ef_unit}. "
    "This data is sourced from {source}."
)

COMPARISON_QUESTION = "Compare the emission factor for {entity_name} between {region1} and {region2}."
COMPARISON_ANSWER = (
    "In {region1}, the emission factor for {entity_name} is {value1} {unit1}, "
    "while in {region2} it is {value2} {unit2}. "
    "This represents a {relation} carbon intensity in {region1} compared to {region2}. "
    "The data for {region1} is sourced from {source1}, while the data for {region2} is from {source2}."
)

TOP_QUESTION = "What are the top 3 {entity_type} entities with the highest emission factors in {region}?"
TOP_ANSWER = (
    "The top 3 {entity_type} entities with the highest emission factors in {region} are: {listing}. "
    "This data is sourced from {sources}."
)

METHOD_QUESTION = "How should I adjust the global emission factor for {entity_name} when using it in {region}?"
METHOD_ANSWER = (
    "When using the global emission factor for {entity_name} in {region}, "
    "you should apply a regional adjustment factor. "
    "The global dataset may not account for specific conditions in {region} "
    "such as energy mix, production methods, or regulatory environment. "
    "Based on our analysis, a multiplier has been applied to account for these regional differences. "
    "Always refer to local data sources when available, "
    "as they provide more accurate emission factors for region-specific calculations."
)

EDGE_QUESTION = "What emission factor should I use for a {new_entity}?"
EDGE_INPUT = (
    "I'm working on a project involving a {new_entity} which doesn't have established emission factors yet."
)
EDGE_ANSWER = (
    "For a {new_entity} without established emission factors, I recommend the following approach: "
    "1. Start with the emission factor for conventional {lower_name} as a baseline ({ef_value} {ef_unit}). "
    "2. Apply an adjustment factor based on available lifecycle assessment studies "
    "for similar sustainable alternatives. "
    "3. Document your assumptions and data sources clearly. "
    "4. Consider using sensitivity analysis to understand "
    "how variations in the emission factor might impact your overall results. "
    "5. Update your calculations when more specific emission factors become available. "
    "This approach provides a reasonable estimate "
    "while acknowledging the uncertainty in emerging product categories."
)
EDGE_ENTITY_PREFIX = "new sustainable "

VERIFY_QUESTION = "How reliable is the emission factor data for {entity_name} in {region}?"
VERIFY_ANSWER = (
    "The emission factor data for {entity_name} in {region} has a {band} confidence score of {confidence}%. "
    "This data is sourced from {source}.{caution} "
    "When using this emission factor, consider the confidence level "
    "and potentially conduct sensitivity analysis if it's critical to your calculations."
)
VERIFY_CAUTION = (
    " However, this value has been flagged as a potential outlier, so additional verification is recommended."
)
