"""Raw source schemas and the two airport lists (airfare configuration)."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Column names of the public source files.
FLIGHTS = _struct(
    ("Date", _S), ("Origin", _S), ("Dest", _S), ("Carrier", _S), ("Airline Name", _S),
    ("Dep_Time", _S), ("Actual_Dep", _S), ("Delay", _S), ("Cancelled", _S),
)
FARES = _struct(
    ("YEAR", _I), ("QUARTER", _I), ("ORIGIN", _S), ("DEST", _S),
    ("PASSENGERS", _S), ("MARKET_FARE", _S), ("MARKET_DISTANCE", _S),
)
DELAY_MEASURES = [
    "arr_flights", "arr_del15", "carrier_ct", "weather_ct", "nas_ct", "security_ct", "late_aircraft_ct",
    "arr_cancelled", "arr_diverted", "arr_delay", "carrier_delay", "weather_delay", "nas_delay",
    "security_delay", "late_aircraft_delay",
]
DELAYS = _struct(
    ("year", _I), ("month", _I), ("carrier", _S), ("carrier_name", _S), ("airport", _S), ("airport_name", _S),
    *[(m, _S) for m in DELAY_MEASURES],
)
FUEL = _struct(("observation_date", _S), ("DJFUELUSGULF", _S))
CAPACITY = _struct(
    ("YEAR", _I), ("QUARTER", _I), ("ORIGIN", _S), ("DEST", _S),
    ("DEPARTURES_PERFORMED", _S), ("SEATS", _S), ("PASSENGERS", _S),
)

# The states that the files are split by.
STATES = ["CA", "GA", "TX"]

# Airports whose rows are kept when cleaning, by state.
CA_AIRPORTS = ["LAX", "SFO", "SAN", "OAK", "ONT", "BUR", "SJC", "SMF", "PSP", "FAT", "BFL"]
GA_AIRPORTS = ["ATL", "SAV", "AGS", "ABY"]
TX_AIRPORTS = ["DFW", "IAH", "DAL", "HOU", "AUS", "SAT", "ELP", "MAF", "ABI", "AMA", "GRK"]
TARGET_AIRPORTS = CA_AIRPORTS + GA_AIRPORTS + TX_AIRPORTS

# Airports that get a state label, a wider list than the one above.
STATE_AIRPORTS = {
    "TX": [
        "AUS", "DFW", "DAL", "HOU", "IAH", "SAT", "ELP", "LBB", "MAF", "AMA", "CRP", "HRL",
        "GRK", "ACT", "SPS", "TYR", "GGG", "BPT", "ABI", "SJT", "CLL", "LRD", "MFE", "BRO",
    ],
    "GA": ["ATL", "SAV", "AGS", "CSG", "ABY", "VLD", "MCN", "BQK"],
    "CA": [
        "LAX", "SFO", "SAN", "SJC", "OAK", "SMF", "ONT", "BUR", "SNA", "LGB", "FAT", "PSP",
        "SBP", "MRY", "RDD", "ACV", "STS", "IYK", "CEC", "MOD", "SCK", "BFL",
    ],
}
AIRPORT_STATE = {airport: state for state, airports in STATE_AIRPORTS.items() for airport in airports}

# Weekdays in the order shown.
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

ROUTE_KEYS = ["YEAR", "QUARTER", "ORIGIN", "DEST"]

# File places below the raw data folder.
RAW_FILES = {
    "competition": "Competition (Airline Count)/US Flights Data (2025, Q1) - Flight Dataset.csv",
    "db1b": "DB1BMarket Airline Ticket Data/{key}_T_DB1B_MARKET.csv",
    "delays": "Flight Delays/ot_delaycause1_DL/Airline_Delay_Cause.csv",
    "fuel": "Fuel Prices/DJFUELUSGULF.csv",
    "t100": "T-100 (Load Factor)/{key}_T_T100D_SEGMENT_US_CARRIER_ONLY.csv",
}
