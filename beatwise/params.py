"""Parameters of the planning rules: small dataclasses that become literals in plans."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Workday:
    """What a day of work looks like in minutes."""
    shift: float = 480.0
    pause: float = 30.0
    commute: float = 40.0
    speed_kmh: float = 25.0
    detour: float = 1.3
    road_time_factor: float = 1.6

    @property
    def productive(self) -> float:
        return self.shift - self.pause - self.commute


@dataclass(frozen=True)
class Band:
    """Visits a day: the floor and the ceiling."""
    low: int = 15
    high: int = 25


@dataclass(frozen=True)
class PlanSettings:
    week: tuple[int, ...] = (1, 2, 3, 4, 5)
    repeats: int = 4
    day_groups: int = 5
    start_slot: int = 0
    band: Band = Band()
    hop_km: float = 4.0
    workday: Workday = Workday()
    #: 'visits' or 'time': what territories, days and weeks are evened out by.
    balance: str = "visits"
    #: Whether a plan compares several cuts and improves them, or takes the plain cut along the curve (a draft).
    search: bool = True
    #: Widest zone, as a radius.
    zone_km: float = 15.0

    @property
    def cycle_days(self) -> int:
        return self.repeats * self.day_groups


EARTH_KM = 6371.0
KM_PER_LAT = 110.57
KM_PER_LNG = 111.32
ROAD_DETOUR = 1.3
BARRIER_KM = 4.0
TOUR_CONSTANT = 0.7124  # Beardwood-Halton-Hammersley

# ---- fixed values: they must equal the published rules for equal results ----

# Call minutes of each trade channel.
CHANNEL_MINUTES = {
    "hypermarket": 45, "supermarket": 30, "minimarket": 20, "grocery": 12, "kiosk": 8, "wholesale": 25,
    "pharmacy": 15, "petrol": 12, "horeca": 15, "specialist": 15, "other": 15,
}

# Word patterns of each channel, first match wins.
CHANNEL_PATTERNS = [
    ("hypermarket", r"hyper|هايبر|هيبر"),
    ("minimarket", r"mini\s*-?\s*market|minimarket|ميني\s*ماركت|ميني"),
    ("supermarket", r"super\s*-?\s*market|supermarket|\bsm\b|سوبر\s*ماركت|سوبرماركت|سوبر"),
    ("wholesale", r"whole\s*sale|wholesaler|cash\s*&?\s*carry|distributor|جملة|جمله|موزع"),
    ("pharmacy", r"pharma|drug\s*store|صيدلي"),
    ("petrol", r"petrol|gas\s*station|fuel|محطة|محطه|وقود"),
    ("horeca", r"horeca|hotel|restaurant|cafe|café|coffee|bakery|مطعم|مقهى|كافيه|فندق|مخبز|افران|فرن"),
    ("kiosk", r"kiosk|newel|stall|كشك|بسطة"),
    ("specialist", r"special|butcher|roaster|nuts|مكسرات|محمص|ملحمة"),
    ("grocery", r"grocery|retail|traditional|corner|market|mart|بقال|بقالة|مفرد|ماركت|مواد غذائية|دكان"),
]

# Shop words that carry no identity, dropped before names are compared.
SHOP_WORDS = [
    "سوبر ?ماركت", "ميني ?ماركت", "ماركت", "مركز", "محل", "بقالية", "بقاليه", "سوبرماركت",
    "super ?market", "mini ?market", "market", "center", "centre", "shop", "store", "grocery",
]

# Working weeks (ISO weekdays) and the coarse boxes (lat from/to, lng from/to) they apply in;
# earlier boxes win. Lebanon is tested by outline instead of by its box.
SATURDAY_WEEK = (6, 7, 1, 2, 3, 4)
MONDAY_WEEK = (1, 2, 3, 4, 5, 6)
COUNTRY_BOXES = [
    ("Lebanon", 33.05, 34.7, 35.1, 36.65, MONDAY_WEEK),
    ("Kuwait", 28.5, 30.1, 46.5, 48.5, SATURDAY_WEEK),
    ("Qatar", 24.4, 26.2, 50.7, 51.7, SATURDAY_WEEK),
    ("Bahrain", 25.7, 26.4, 50.3, 50.9, SATURDAY_WEEK),
    ("UAE", 22.6, 26.1, 51.5, 56.4, MONDAY_WEEK),
    ("Jordan", 29.2, 33.4, 34.9, 39.3, SATURDAY_WEEK),
    ("Syria", 32.3, 37.35, 35.6, 42.4, SATURDAY_WEEK),
    ("Iraq", 29.0, 37.4, 38.8, 48.6, SATURDAY_WEEK),
    ("Egypt", 22.0, 31.7, 24.7, 36.9, SATURDAY_WEEK),
    ("Saudi Arabia", 16.3, 32.2, 34.5, 55.7, SATURDAY_WEEK),
    ("Oman", 16.6, 26.4, 52.0, 59.9, SATURDAY_WEEK),
    ("Turkey", 35.8, 42.2, 25.6, 44.9, MONDAY_WEEK),
]
# Outline of Lebanon as (lng, lat).
LEBANON_OUTLINE = [
    (35.10, 33.09), (35.62, 33.07), (35.82, 33.28), (36.03, 33.55), (36.07, 33.80), (36.40, 34.05),
    (36.62, 34.20), (36.45, 34.45), (36.35, 34.65), (35.97, 34.65), (35.80, 34.45), (35.65, 34.25),
    (35.48, 33.90), (35.38, 33.55), (35.20, 33.27),
]
WEEKDAY_SHORT = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# A river with few bridges, as (lat, lng): the example barrier.
TIGRIS = [
    (33.488, 44.375), (33.455, 44.392), (33.440, 44.400), (33.410, 44.420), (33.390, 44.430),
    (33.370, 44.440), (33.340, 44.490), (33.300, 44.520), (33.250, 44.580),
]

# Header spellings of an uploaded outlet list, per target field, in order of preference.
HEADER_SYNONYMS = {
    "name": ["outletname", "name", "outlet", "clientname", "client", "shopname", "shop", "storename", "store",
             "customername", "customer", "location", "site", "account", "clientcode", "outletcode", "code"],
    "code": ["clientcode", "outletcode", "code", "customercode", "shopcode", "storecode"],
    "latitude": ["latitude", "lat", "y", "gpslat", "gpslatitude", "geolat", "geolatitude", "coordlat", "coordy",
                 "poslat", "posy"],
    "longitude": ["longitude", "lng", "lon", "x", "gpslong", "gpslongitude", "gpslng", "geolong", "geolongitude",
                  "geolng", "coordlong", "coordx", "coordlng", "poslong", "posx", "poslng"],
    "vf": ["vf", "visitfrequency"],
    "channel": ["channel", "outlettype", "type", "storetype", "shoptype", "clienttag", "clienttag1", "category",
                "segment", "subchannel", "class"],
    "call_time": ["timepervisit", "visittime", "calltime", "callduration", "visitduration", "duration", "time",
                  "minutes"],
    "value": ["vc", "value", "volume", "volumeclass", "sales", "salesvalue"],
    "territory": ["district", "territory", "zone", "region"],
    "address": ["address", "addr", "streetaddress", "fulladdress", "location"],
}

# Role presets: (role, role name, offset in working days, sort order).
ROLE_PRESETS = [("rep", "Sales Rep", 0, 0), ("merchandiser", "Merchandiser", 1, 1),
                ("collection_agent", "Collection Agent", 2, 2)]
# ---- end of fixed values ----
