"""Code dimensions as small DataFrames.

Every table here is a fixed, bounded list (at most 170 rows), so joining it with
``F.broadcast`` is safe at any data size: the broadcast side never grows with the data.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# FIXED VALUES - must equal the published NS 3457 building classification, the building
# status and ownership code lists, the simplified-category mapping and the Norwegian
# building-regulation cut-over dates. Do not edit.
# ---------------------------------------------------------------------------------------

# NS 3457 building type names: level 1 (main group), level 2 (group), level 3 (type).
NS3457_NAMES: dict[int, str] = {
    1: "Bolig",
    2: "Industri og lagerbygning",
    3: "Kontor- og forretningsbygning",
    4: "Samferdsels- og kommunikasjonsbygning",
    5: "Hotell- og restaurantbygning",
    6: "Kultur- og forskningsbygning",
    7: "Helsebygning",
    8: "Fengsel, beredskapsbygning mv.",
    11: "Enebolig",
    12: "Tomannsbolig",
    13: "Rekkehus, kjedehus, andre småhus",
    14: "Store boligbygg",
    15: "Bygning for bofellesskap",
    16: "Fritidsbolig",
    17: "Koie, seterhus og lignende",
    18: "Garasje og uthus til bolig",
    19: "Annen boligbygning",
    21: "Industribygning",
    22: "Energiforsyningsbygning",
    23: "Lagerbygning",
    24: "Fiskeri- og landbruksbygning",
    31: "Kontorbygning",
    32: "Forretningsbygning",
    41: "Ekspedisjonsbygning, terminal",
    42: "Telekommunikasjonsbygning",
    43: "Garasje- og hangarbygning",
    44: "Veg- og trafikktilsynsbygning",
    51: "Hotellbygning",
    52: "Bygning for overnatting",
    53: "Restaurantbygning",
    61: "Skolebygning",
    62: "Universitets- og høgskolebygning",
    64: "Museums- og biblioteksbygning",
    65: "Idrettsbygning",
    66: "Kulturhus",
    67: "Bygning for religiøse aktiviteter",
    71: "Sykehus",
    72: "Sykehjem",
    73: "Primærhelsebygning",
    81: "Fengselsbygning",
    82: "Beredskapsbygning",
    83: "Monument",
    84: "Offentlig toalett",
    111: "Enebolig",
    112: "Enebolig med hybelleilighet, sokkelleilighet o.l.",
    113: "Våningshus",
    121: "Tomannsbolig, vertikaldelt",
    122: "Tomannsbolig, horisontaldelt",
    123: "Våningshus, tomannsbolig, vertikaldelt",
    124: "Våningshus, tomannsbolig, horisontaldelt",
    131: "Rekkehus",
    133: "Kjedehus inkl. atriumhus",
    135: "Terrassehus",
    136: "Andre småhus med 3 boliger eller flere",
    141: "Store frittliggende boligbygg på 2 etasjer",
    142: "Store frittliggende boligbygg på 3 og 4 etasjer",
    143: "Store frittliggende boligbygg på 5 etasjer eller over",
    144: "Store sammenbygde boligbygg på 2 etasjer",
    145: "Store sammenbygde boligbygg på 3 og 4 etasjer",
    146: "Store sammenbygde boligbygg på 5 etasjer og over",
    151: "Bo- og servicesenter",
    152: "Studenthjem/studentboliger",
    159: "Annen bygning for bofellesskap",
    161: "Fritidsbygning (hytter, sommerhus o.l.)",
    162: "Helårsbolig benyttet som fritidsbolig",
    163: "Våningshus benyttet som fritidsbolig",
    171: "Seterhus, sel, rorbu o.l.",
    172: "Skogs- og utmarkskoie, gamme",
    181: "Garasje, uthus, anneks knyttet til bolig",
    182: "Garasje, uthus, anneks knyttet til fritidsbolig",
    183: "Naust, båthus, sjøbu",
    193: "Boligbrakker",
    199: "Annen boligbygning (f.eks. sekundærbolig reindrift)",
    211: "Fabrikkbygning",
    212: "Verkstedbygning",
    214: "Bygning for renseanlegg",
    216: "Bygning for vannforsyning, bl.a. pumpestasjon",
    219: "Annen industribygning",
    221: "Kraftstasjon (>15 000 kVA)",
    223: "Transformatorstasjon (>10 000 kVA)",
    229: "Annen energiforsyningsbygning",
    231: "Lagerhall",
    232: "Kjøle- og fryselager",
    233: "Silobygning",
    239: "Annen lagerbygning",
    241: "Hus for dyr, fôrlager, strølager, frukt- og grønnsakslager, landbrukssilo, høy-/korntørke",
    243: "Veksthus",
    244: "Driftsbygning for fiske og fangst, inkl. oppdrettsanlegg",
    245: "Naust/redskapshus for fiske",
    248: "Annen fiskeri- og fangstbygning",
    249: "Annen landbruksbygning",
    311: "Kontor- og administrasjonsbygning, rådhus",
    312: "Bankbygning, posthus",
    313: "Mediebygning",
    319: "Annen kontorbygning",
    321: "Kjøpesenter, varehus",
    322: "Butikkbygning",
    323: "Bensinstasjon",
    329: "Annen forretningsbygning",
    330: "Messe- og kongressbygning",
    411: "Ekspedisjonsbygning, flyterminal, kontrolltårn",
    412: "Jernbane- og T-banestasjon",
    415: "Godsterminal",
    416: "Postterminal",
    419: "Annen ekspedisjons- og terminalbygning",
    429: "Telekommunikasjonsbygning",
    431: "Parkeringshus",
    439: "Annen garasje- hangarbygning",
    441: "Trafikktilsynsbygning",
    449: "Annen veg- og trafikktilsynsbygning",
    511: "Hotellbygning",
    512: "Motellbygning",
    519: "Annen hotellbygning",
    521: "Hospits, pensjonat",
    522: "Vandrerhjem, feriehjem/-koloni, turisthytte",
    523: "Appartement",
    524: "Campinghytte/utleiehytte",
    529: "Annen bygning for overnatting",
    531: "Restaurantbygning, kafébygning",
    532: "Sentralkjøkken, kantinebygning",
    533: "Gatekjøkken, kioskbygning",
    539: "Annen restaurantbygning",
    611: "Lekepark",
    612: "Barnehage",
    613: "Barneskole",
    614: "Ungdomsskole",
    615: "Kombinert barne- og ungdomsskole",
    616: "Videregående skole",
    619: "Annen skolebygning",
    621: "Universitets- og høgskolebygning med integrerte funksjoner, auditorium, lesesal o.a.",
    623: "Laboratoriebygning",
    629: "Annen universitets-, høgskole- og forskningsbygning",
    641: "Museum, kunstgalleri",
    642: "Bibliotek, mediatek",
    643: "Zoologisk og botanisk hage",
    649: "Annen museums- og bibliotekbygning",
    651: "Idrettshall",
    652: "Ishall",
    653: "Svømmehall",
    654: "Tribune og idrettsgarderobe",
    655: "Helsestudio",
    659: "Annen idrettsbygning",
    661: "Kinobygning, teaterbygning, opera/konserthus",
    662: "Samfunnshus, grendehus",
    663: "Diskotek",
    669: "Annet kulturhus",
    671: "Kirke, kapell",
    672: "Bedehus, menighetshus",
    673: "Krematorium, gravkapell, bårehus",
    674: "Synagoge, moské",
    675: "Kloster",
    679: "Annen bygning for religiøse aktiviteter",
    719: "Sykehus",
    721: "Sykehjem",
    722: "Bo- og behandlingssenter, aldershjem",
    723: "Rehabiliteringsinstitusjon, kurbad",
    729: "Annet sykehjem",
    731: "Klinikk, legekontor/-senter/-vakt",
    732: "Helse- og sosialsenter, helsestasjon",
    739: "Annen primærhelsebygning",
    819: "Fengselsbygning",
    821: "Politistasjon",
    822: "Brannstasjon, ambulansestasjon",
    823: "Fyrstasjon, losstasjon",
    824: "Stasjon for radarovervåkning av fly- og/eller skipstrafikk",
    825: "Tilfluktsrom/bunker",
    829: "Annen beredskapsbygning",
    830: "Monument",
    840: "Offentlig toalett",
    999: "Ukjent bygningstype",
}

# Building status code -> name.
BUILDING_STATUS: dict[int, str] = {
    0: "Rammetillatelse",
    1: "Igangsettingstillatelse",
    2: "Midlertidig brukstillatelse",
    3: "Ferdigattest",
    4: "Tatt i bruk",
    5: "Meldingssak registrer tiltak",
    6: "Meldingssak tiltak fullført",
    7: "Tiltak unntatt fra byggesaksbehandling",
    8: "Bygning godkjent for riving/brenning",
    9: "Bygning revet/brent",
    10: "Bygging avlyst",
    11: "Bygning flyttet",
    12: "Bygningsnummer utgått",
    13: "Fritatt for søknadsplikt",
    14: "Endre bygningsdata",
    15: "Tilbygg opprettet som egen bygning",
    16: "Bygg etablert som tilbygg på annen bygning",
    17: "Splitt bygning",
    18: "Data fra bygningsendring overført",
}

# Status ids whose buildings are kept in the analysis; every other id (and no id) is excluded.
INCLUDED_STATUS_IDS: tuple[int, ...] = (2, 3, 4, 6, 7, 8, 13, 14, 15, 16, 17, 18)

# Ownership type code -> name.
OWNERSHIP_TYPES: dict[int, str] = {
    0: "Hjemmelshaver",
    1: "Kommune/offentlig eier",
    11: "Fester",
    18: "Rettighetsforhold",
    19: "Annet tinglyst eierforhold",
}

# NS 3457 code -> simplified category (codes not listed map to the fallback).
SIMPLIFIED_CATEGORY: dict[int, str] = {
    111: "Boliger", 112: "Boliger", 113: "Boliger", 121: "Boliger", 122: "Boliger",
    123: "Boliger", 124: "Boliger", 131: "Boliger", 133: "Boliger", 135: "Boliger",
    136: "Boliger", 141: "Boliger", 142: "Boliger", 143: "Boliger", 144: "Boliger",
    145: "Boliger", 146: "Boliger", 151: "Boliger for eldre", 152: "Boliger", 159: "Boliger",
    161: "Boliger", 162: "Boliger", 163: "Boliger", 171: "Boliger", 172: "Boliger",
    181: "Boliger", 182: "Boliger", 183: "Boliger", 193: "Asylmottak", 199: "Boliger",
    211: "Verksteder", 212: "Verksteder", 214: "Tekniske anlegg", 216: "Tekniske anlegg",
    219: "Tekniske anlegg", 221: "Tekniske anlegg", 223: "Tekniske anlegg", 229: "Tekniske anlegg",
    231: "Lagerbygninger", 232: "Lagerbygninger", 233: "Lagerbygninger", 239: "Lagerbygninger",
    241: "Landbruksbygg", 243: "Landbruksbygg", 244: "Landbruksbygg", 245: "Landbruksbygg",
    248: "Landbruksbygg", 249: "Landbruksbygg",
    311: "Administrasjonsbygg", 312: "Administrasjonsbygg", 313: "Administrasjonsbygg",
    319: "Administrasjonsbygg",
    321: "Forretningsbygg", 322: "Forretningsbygg", 323: "Forretningsbygg", 329: "Forretningsbygg",
    330: "Forretningsbygg",
    411: "Samferdselsbygg", 412: "Samferdselsbygg", 415: "Samferdselsbygg", 416: "Samferdselsbygg",
    419: "Samferdselsbygg", 429: "Tekniske anlegg", 431: "Samferdselsbygg", 439: "Samferdselsbygg",
    441: "Samferdselsbygg", 449: "Samferdselsbygg",
    511: "Hoteller og overnattingssteder", 512: "Hoteller og overnattingssteder",
    519: "Hoteller og overnattingssteder", 521: "Hoteller og overnattingssteder",
    522: "Hoteller og overnattingssteder", 523: "Hoteller og overnattingssteder",
    524: "Hoteller og overnattingssteder", 529: "Asylmottak",
    531: "Restauranter og serveringssteder", 532: "Restauranter og serveringssteder",
    533: "Restauranter og serveringssteder", 539: "Restauranter og serveringssteder",
    611: "Barnehager", 612: "Barnehager",
    613: "Skoler", 614: "Skoler", 615: "Skoler", 616: "Skoler", 619: "Skoler",
    621: "Universiteter og høgskoler", 623: "Universiteter og høgskoler",
    629: "Universiteter og høgskoler",
    641: "Museer og biblioteker", 642: "Museer og biblioteker", 643: "Museer og biblioteker",
    649: "Museer og biblioteker",
    651: "Idrettsanlegg", 652: "Idrettsanlegg", 653: "Idrettsanlegg", 654: "Idrettsanlegg",
    655: "Idrettsanlegg", 659: "Idrettsanlegg",
    661: "Kulturbygg", 662: "Kulturbygg", 663: "Kulturbygg", 669: "Kulturbygg",
    671: "Religiøse bygg", 672: "Religiøse bygg", 673: "Religiøse bygg", 674: "Religiøse bygg",
    675: "Religiøse bygg", 679: "Religiøse bygg",
    719: "Helsebygg",
    721: "Sykehjem og omsorgsboliger", 722: "Sykehjem og omsorgsboliger",
    723: "Sykehjem og omsorgsboliger", 729: "Sykehjem og omsorgsboliger",
    731: "Helsebygg", 732: "Helsebygg", 739: "Helsebygg",
    819: "Fengselsbygg",
    821: "Beredskapsbygg", 822: "Beredskapsbygg", 823: "Beredskapsbygg", 824: "Beredskapsbygg",
    825: "Beredskapsbygg", 829: "Beredskapsbygg",
    830: "Annet", 840: "Annet", 999: "Annet",
}
CATEGORY_FALLBACK = "Annet"

# Building regulations, newest first: (standard, in force from, in-force text, period text).
REGULATIONS: list[tuple[str, _dt.date, str, str]] = [
    ("TEK17", _dt.date(2017, 7, 1), "1. jul 2017", "2017–i dag"),
    ("TEK10", _dt.date(2010, 7, 1), "1. jul 2010", "2010–2017"),
    ("TEK07", _dt.date(2007, 2, 1), "1. feb 2007", "2007–2010"),
    ("TEK97", _dt.date(1997, 7, 1), "1. jul 1997", "1997–2007"),
    ("BF87", _dt.date(1987, 7, 1), "1. jul 1987", "1987–1997"),
    ("BF85", _dt.date(1985, 1, 1), "1. jan 1985", "1985–1987"),
    ("BF69", _dt.date(1969, 8, 1), "1. aug 1969", "1969–1985"),
    ("BF49", _dt.date(1949, 12, 15), "15. des 1949", "1949–1969"),
]
REGULATION_FALLBACK = ("Pre-1949", "Før 1949", "Før 1949")

# ---------------------------------------------------------------------------------------
# Derived tables (rules over the fixed values above)
# ---------------------------------------------------------------------------------------

# FIXED VALUES: internal building-type id -> NS 3457 code (0 means "unknown").
INTERNAL_ID_TO_NS3457: dict[int, int | None] = {
    0: None, 1: 111, 2: 112, 3: 113, 4: 121, 5: 122, 6: 123, 7: 124, 8: 131, 9: 133, 10: 135, 11: 136,
    12: 141, 13: 142, 14: 143, 15: 144, 16: 145, 17: 146, 18: 151, 19: 152, 20: 159, 21: 161, 22: 162, 23: 163,
    24: 171, 25: 172, 26: 181, 27: 182, 28: 183, 29: 193, 30: 199, 31: 211, 32: 212, 33: 214, 34: 216, 35: 219,
    36: 221, 37: 223, 38: 229, 39: 231, 40: 232, 41: 233, 42: 239, 43: 241, 44: 243, 45: 244, 46: 245, 47: 248,
    48: 249, 49: 311, 50: 312, 51: 313, 52: 319, 53: 321, 54: 322, 55: 323, 56: 329, 57: 330, 58: 411, 59: 412,
    60: 415, 61: 416, 62: 419, 63: 429, 64: 431, 65: 439, 66: 441, 67: 449, 68: 511, 69: 512, 70: 519, 71: 521,
    72: 522, 73: 523, 74: 524, 75: 529, 76: 531, 77: 532, 78: 533, 79: 539, 80: 611, 81: 612, 82: 613, 83: 614,
    84: 615, 85: 616, 86: 619, 87: 621, 88: 623, 89: 629, 90: 641, 91: 642, 92: 643, 93: 649, 94: 651, 95: 652,
    96: 653, 97: 654, 98: 655, 99: 659, 100: 661, 101: 662, 102: 663, 103: 669, 104: 671, 105: 672, 106: 673, 107: 674,
    108: 675, 109: 679, 110: 719, 111: 721, 112: 722, 113: 723, 114: 729, 115: 731, 116: 732, 117: 739, 118: 819, 119: 821,
    120: 822, 121: 823, 122: 824, 123: 825, 124: 829, 125: 830, 126: 840, 127: 999,
}


def hierarchy_of(ns3457: int | None) -> tuple[str, str, str]:
    """(main group, group, type) names of a three-digit code; '' where a level has no name."""
    if ns3457 is None:
        return ("", "", "")
    return (
        NS3457_NAMES.get(ns3457 // 100, ""),
        NS3457_NAMES.get(ns3457 // 10, ""),
        NS3457_NAMES.get(ns3457, ""),
    )


_BUILDING_TYPE_SCHEMA = T.StructType(
    [
        T.StructField("bt_internal_id", T.IntegerType(), False),
        T.StructField("bt_ns3457", T.IntegerType(), True),
        T.StructField("bt_hovedgruppe", T.StringType(), False),
        T.StructField("bt_bygningsgruppe", T.StringType(), False),
        T.StructField("bt_bygningstype", T.StringType(), False),
    ]
)


def building_types(spark: SparkSession) -> DataFrame:
    """internal id -> NS 3457 code and its three-level names (128 rows)."""
    rows = [(i, ns, *hierarchy_of(ns)) for i, ns in INTERNAL_ID_TO_NS3457.items()]
    return spark.createDataFrame(rows, _BUILDING_TYPE_SCHEMA)


def categories(spark: SparkSession) -> DataFrame:
    """NS 3457 code -> simplified category (127 rows)."""
    return spark.createDataFrame(
        sorted(SIMPLIFIED_CATEGORY.items()),
        "cat_ns3457 INT, cat_category STRING",
    )


def statuses(spark: SparkSession) -> DataFrame:
    """status id -> name, included flag (19 rows)."""
    return spark.createDataFrame(
        [(k, v, k in INCLUDED_STATUS_IDS) for k, v in sorted(BUILDING_STATUS.items())],
        "st_id INT, st_name STRING, st_included BOOLEAN",
    )


def ownership_types(spark: SparkSession) -> DataFrame:
    """ownership type id -> name (5 rows)."""
    return spark.createDataFrame(sorted(OWNERSHIP_TYPES.items()), "ot_id INT, ot_name STRING")


def ns3457_names(spark: SparkSession) -> DataFrame:
    """NS 3457 code -> name (170 rows, all three levels)."""
    return spark.createDataFrame(sorted(NS3457_NAMES.items()), "code INT, name STRING")


def regulations(spark: SparkSession) -> DataFrame:
    """Building regulations with their in-force dates (8 rows)."""
    return spark.createDataFrame(REGULATIONS, "standard STRING, in_force DATE, in_force_text STRING, period_text STRING")


# SQL VALUES lists of the same tables, for the DuckDB oracles.
def _sql_str(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    body = ", ".join(
        "(" + ", ".join(_sql_str(v) if isinstance(v, str) or v is None else str(v) for v in r) + ")" for r in rows
    )
    return f"(VALUES {body}) AS t({', '.join(columns)})"


def building_types_sql() -> str:
    rows = [
        (i, "NULL" if ns is None else ns, *hierarchy_of(ns)) for i, ns in INTERNAL_ID_TO_NS3457.items()
    ]
    body = ", ".join(
        f"({i}, CAST({ns} AS INTEGER), {_sql_str(a)}, {_sql_str(b)}, {_sql_str(c)})" for i, ns, a, b, c in rows
    )
    return f"(VALUES {body}) AS t(bt_internal_id, bt_ns3457, bt_hovedgruppe, bt_bygningsgruppe, bt_bygningstype)"


def categories_sql() -> str:
    return values_sql(sorted(SIMPLIFIED_CATEGORY.items()), ["cat_ns3457", "cat_category"])


def statuses_sql() -> str:
    body = ", ".join(
        f"({k}, {_sql_str(v)}, {'TRUE' if k in INCLUDED_STATUS_IDS else 'FALSE'})" for k, v in sorted(BUILDING_STATUS.items())
    )
    return f"(VALUES {body}) AS t(st_id, st_name, st_included)"


def ownership_types_sql() -> str:
    return values_sql(sorted(OWNERSHIP_TYPES.items()), ["ot_id", "ot_name"])
