"""Keyword lists, column patterns and thresholds.

They are parameters of the operators; every operator accepts other lists.
"""

# --- fixed values: relevance words of a catalog search, by caller ---
RELEVANCE_WIDE = ["crime", "police", "incident", "offense", "arrest", "criminal"]
RELEVANCE_LISTING = ["crime", "police", "incident", "offense"]
RELEVANCE_CORE = ["crime", "police", "incident"]
RELEVANCE_NAME_ONLY = ["crime", "incident", "police"]

# --- fixed values: terms that mark a coordinate column ---
COORDINATE_TERMS = ["latitude", "longitude", "lat", "lon", "y_coord", "x_coord", "coordinates", "location"]
COORDINATE_TERMS_KNOWN = ["latitude", "longitude", "lat", "lon", "y_coord", "x_coord"]
COORDINATE_TERMS_SAMPLE = [
    "latitude", "longitude", "lat", "lon", "y_coord", "x_coord", "point", "location", "coordinates",
]

# --- fixed values: search keys of the coordinate column finder, in order ---
LATITUDE_KEYS = ["latitude", "lat", "y_coord", "y"]
LONGITUDE_KEYS = ["longitude", "long", "lon", "x_coord", "x"]
LOCATION_KEYS = ["location", "point", "coordinates", "geom", "geometry"]

# --- fixed values: seven column categories, keywords and hits required ---
COLUMN_CATEGORIES = {
    "coordinates": (
        ["latitude", "lat", "longitude", "lon", "lng", "coordinates", "location", "geocoded",
         "x_coordinate", "y_coordinate"], 2),
    "date": (["date", "occurred", "incident", "reported", "datetime", "timestamp"], 1),
    "time": (["time", "hour", "minute", "datetime", "timestamp", "occurred", "date"], 1),
    "location_description": (
        ["location_description", "location", "description", "premise", "place", "address", "block"], 1),
    "crime_type": (
        ["primary_type", "primary type", "crime_type", "crime type", "offense", "incident_type",
         "incident type", "classification", "category"], 1),
    "crime_description": (
        ["description", "offense_description", "incident_description", "crime_description", "detail"], 1),
    "arrest": (["arrest", "arrested", "custody", "apprehended", "cleared"], 1),
}

# --- fixed values: column detector, per standard field: exact names, contained words, ratio above which a
# fuzzy match counts ---
FIELD_PATTERNS = {
    "latitude": (["latitude", "lat", "y", "point_y", "y_coordinate", "y_coord"], ["lat", "latitude", "y_coord"], 80),
    "longitude": (
        ["longitude", "lon", "lng", "long", "x", "point_x", "x_coordinate", "x_coord"],
        ["lon", "lng", "longitude", "x_coord"], 80),
    "date": (
        ["date", "occurred_date", "incident_date", "report_date", "datetime"], ["date", "occurred", "incident"], 75),
    "time": (["time", "occurred_time", "incident_time", "hour"], ["time", "hour"], 75),
    "crime_type": (
        ["crime_type", "primary_type", "offense", "category", "crime_class"],
        ["type", "offense", "crime", "category"], 70),
    "description": (["description", "narrative", "details", "offense_description"], ["desc", "narr", "detail"], 70),
    "location": (
        ["location", "address", "block", "street", "location_description"], ["location", "address", "street"], 70),
    "arrest": (["arrest", "arrested", "arrest_made", "clearance"], ["arrest"], 85),
}

# --- fixed values: incident categories in order of precedence ---
INCIDENT_CATEGORIES = {
    "VIOLENT": ["murder", "homicide", "assault", "battery", "robbery", "rape", "kidnapping"],
    "PROPERTY": ["burglary", "theft", "larceny", "motor vehicle", "arson", "shoplifting"],
    "DRUG": ["narcotics", "drug", "possession", "trafficking", "marijuana", "cocaine"],
    "WEAPON": ["weapon", "firearm", "gun", "concealed carry", "armed"],
    "FRAUD": ["fraud", "forgery", "counterfeiting", "embezzlement", "identity"],
    "SEX_OFFENSE": ["sex offense", "prostitution", "indecent", "sexual"],
    "PUBLIC_ORDER": ["disorderly", "vandalism", "trespass", "disturbing", "loitering"],
}

# --- fixed values: candidate source columns of the standard incident schema ---
INCIDENT_ID = ["incident_id", "case_number", "report_number", "id", "incident_number"]
DATETIME = ["datetime", "occurred_date", "incident_date", "date", "reported_date"]
TIME_OF_DAY = ["time", "occurred_time", "incident_time"]
NUMERIC_FIELDS = {
    "latitude": ["latitude", "lat", "y", "y_coordinate", "point_y"],
    "longitude": ["longitude", "lon", "lng", "x", "x_coordinate", "point_x"],
}
LOCATION_FIELDS = {
    "address": ["address", "location", "street_address", "block"],
    "city": ["city", "municipality", "town"],
    "state": ["state", "province"],
    "zip_code": ["zip", "zip_code", "postal_code"],
}
TYPE_FIELDS = {
    "crime_type": ["crime_type", "primary_type", "offense", "offense_type", "category"],
    "crime_description": ["description", "offense_description", "narrative", "details"],
    "ucr_code": ["ucr_code", "ucr", "fbi_code", "offense_code"],
}
DIVISION_FIELDS = {
    "beat": ["beat", "sector"],
    "district": ["district", "precinct"],
    "ward": ["ward"],
    "community_area": ["community", "neighborhood"],
    "location_type": ["location_description", "premise", "place"],
}
FLAG_FIELDS = {
    "arrest_made": ["arrest", "arrested", "clearance"],
    "domestic": ["domestic", "family"],
}
TRUE_WORDS = ["true", "yes", "y", "1"]

# --- fixed values: points of the record quality score ---
QUALITY_REQUIRED = ["datetime", "latitude", "longitude", "crime_type"]
QUALITY_OPTIONAL = ["address", "arrest_made", "crime_description", "district"]
QUALITY_REQUIRED_POINTS = 15
QUALITY_OPTIONAL_POINTS = 10

# --- fixed values: words that mark a date or time column ---
DATE_WORDS = ["date", "time", "datetime", "timestamp"]

# --- fixed values: score bands of the missing-combination report (low, high) ---
SCORE_BANDS = [(87.5, 100.0), (62.5, 75.0), (37.5, 50.0), (12.5, 25.0)]

# --- fixed values: bounding box of the map view (lat low, lat high, lon low, lon high) ---
MAP_BOX = (41.6, 42.1, -88.0, -87.4)

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
